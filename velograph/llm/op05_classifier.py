"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

The statistics of a text are shares and rates (characters by kind, words, lines, repeats), put on
one scale by the mean and deviation of the fitting rows. D random cosines approximate a Gaussian
kernel over them. The normal equations (D x D) are summed by partition and added up, the ridge
weights solved on the driver, and the scores calibrated by pool-adjacent-violators on scores from weights
that haven't seen their row (cross-fitted over folds of the hash of doc_id).

The model is fitted on at most `fit_rows` labelled rows, those of the smallest hash of doc_id; every
row is scored from its whole text. Null and empty texts get the score of the empty text's
statistics. Without labels of both kinds every score is the share of label 1 (0.5 without any).
Null labels are ignored; contradicting labels of a doc_id count each, and so do repeated rows of a text. Equal scores are one
knot of the calibration; a score at the cutoff is predicted 1. A text of any length is read whole, as bytes, UTF-8 or not. An
empty table gives none. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.llm import common


@dataclass(frozen=True)
class Fit:
    fit_rows: int = 12_000
    features: int = 192
    width: float = 3.0
    ridge: float = 0.3
    folds: int = 4
    seed: int = 5
    cutoff: float = 0.7


_ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_GROUPS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:", b"!?", b"#$%&*", b"|<>{}[]_=/\\~^", b"'\"()-", bytes(range(128, 192)), bytes(range(192, 256)))
_KINDS = np.zeros((256, len(_GROUPS)))
for _i, _g in enumerate(_GROUPS):
    _KINDS[list(_g), _i] = 1
N_STATS = len(_GROUPS) + 7


def statistics(text: bytes) -> list[float]:
    """Shares of the kinds of bytes, then of words: length, distinct, repeats in a row, marks; and of lines."""
    n = max(len(text), 1)
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _KINDS / n
    words = text.split()
    plain = text.translate(_ALNUM).split()
    w, p = max(len(words), 1), max(len(plain), 1)
    again = sum(map(bytes.__eq__, plain, plain[1:])) / p
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct = len(set(plain))
    return [*np.sqrt(kinds).tolist(), np.log1p(len(words)) / 4, len(text) / w / 8, np.log1p(distinct) / np.log1p(p) if plain else 1.0, np.sqrt(again), len(set(lines)) / max(len(lines), 1), np.log1p(w / max(len(lines), 1)) / 4, len(plain) / w - 1]


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and their non-decreasing means."""
    order = np.argsort(scores, kind="stable")
    x, starts = np.unique(scores[order], return_index=True)
    sums = np.add.reduceat(labels[order].astype(float), starts)
    counts = np.diff([*starts, len(order)]).astype(float)
    blocks: list[list[float]] = []  # sum, count, first, last
    for i in range(len(x)):
        blocks.append([sums[i], counts[i], x[i], x[i]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, c, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + c, blocks[-1][2], last]
    knots = np.array([k for b in blocks for k in (b[2], b[3])])
    return knots, np.array([b[0] / b[1] for b in blocks for _ in range(2)])


class Model:
    def __init__(self, mean, spread, omega, phase, beta, knots, values, share):
        self.mean, self.spread, self.omega, self.phase, self.beta, self.knots, self.values, self.share = mean, spread, omega, phase, beta, knots, values, share

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -8, 8)
        return np.hstack([np.cos(z @ self.omega + self.phase) * np.sqrt(2 / len(self.phase)), np.ones((len(z), 1))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(stats), self.share)
        raw = self.features(stats) @ self.beta
        return np.clip(np.interp(raw, self.knots, self.values), 0, 1)


def _stats_udf(column: str = "text") -> Column:
    def run(texts):
        return pa.array([statistics(t or b"") for t in texts], pa.list_(pa.float64()))

    return common.row_udf(run, "array<double>")(F.col(column))


def fit(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> Model:
    spark = docs.sparkSession
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~common.held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("double").alias("label"))
    # A bounded sample: fit_rows ids at most, so that they may be broadcast.
    chosen = marks.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "label").limit(how.fit_rows).select("doc_id", "label", F.pmod("h", F.lit(how.folds)).alias("fold"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(_stats_udf().alias("x"), "label", "fold")
    rows = common.cut(rows).coalesce(4)  # a row of numbers for each of fit_rows texts
    rng = np.random.default_rng(how.seed)
    omega, phase = rng.normal(0, 1 / how.width, (N_STATS, how.features)), rng.uniform(0, 2 * np.pi, how.features)
    first = rows.select(F.count("*").alias("n"), F.avg("label").alias("share"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(N_STATS)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(N_STATS)]).first()
    if not first.n:
        return Model(None, None, omega, phase, None, None, None, 0.5)
    mean = np.array([first[f"m{i}"] for i in range(N_STATS)])
    spread = np.maximum([first[f"s{i}"] for i in range(N_STATS)], 1e-3)
    model = Model(mean, spread, omega, phase, None, None, None, float(first.share))
    if first.share in (0.0, 1.0):
        return model
    d = how.features + 1

    def equations(batches):
        sums = {}
        for b in batches:
            f, label, fold = model.features(common.as_matrix(b.column(0).to_pylist(), N_STATS)), np.asarray(b.column(1).to_pylist()), np.asarray(b.column(2).to_pylist())
            for k in np.unique(fold).tolist():
                own = f[fold == k]
                gram, right = sums.get(k, (0.0, 0.0))
                sums[k] = gram + own.T @ own, right + own.T @ label[fold == k]
        yield pa.RecordBatch.from_pydict({"fold": pa.array(list(sums), pa.int64()), "gram": pa.array([g.tobytes() for g, _ in sums.values()], pa.binary()), "right": pa.array([r.tobytes() for _, r in sums.values()], pa.binary())})

    grams, rights = np.zeros((how.folds, d, d)), np.zeros((how.folds, d))
    for r in common.map_arrow(rows, equations, "fold bigint, gram binary, right binary").collect():
        grams[r.fold] += np.frombuffer(r.gram).reshape(d, d)
        rights[r.fold] += np.frombuffer(r.right)

    def solved(but: int | None = None) -> np.ndarray:
        use = [k for k in range(how.folds) if k != but]
        return np.linalg.solve(grams[use].sum(axis=0) + how.ridge * np.eye(d), rights[use].sum(axis=0))

    model.beta = solved()
    betas = np.stack([solved(k) for k in range(how.folds)], axis=1)
    fitted = rows.collect()  # fit_rows rows of numbers at most
    folds = np.array([r.fold for r in fitted])
    unseen = (model.features(common.as_matrix([r.x for r in fitted], N_STATS)) @ betas)[np.arange(len(fitted)), folds]
    model.knots, model.values = isotonic(unseen, np.array([r.label for r in fitted]))
    return model


def score(model: Model) -> Column:
    """A double column: the calibrated score of each whole text."""

    def run(texts):
        return pa.array(model.score(common.as_matrix([statistics(t or b"") for t in texts], N_STATS)) if texts else [], pa.float64())

    return common.row_udf(run, "double")(F.col("text"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    how = Fit()
    model = fit(docs, common.table(spark, sf_dir, "labels"), how)
    out = docs.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), score(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= how.cutoff).cast("int"))
