"""Language ID: multinomial naive Bayes over hashed character n-grams.

Grams of 1 to 3 characters are taken from the lower-cased text, where every run of characters that
are no letters is one space. Training counts them over at most `fit_rows` labelled rows (those of
the smallest hash of doc_id; rows of one id come or stay away together, null ids are one); the smoothed log probabilities, one row of `buckets` for each
language, are broadcast, and a batch of texts is scored as a sparse count matrix: gathered rows summed
by document.

A null text, or one without a letter, is `und` with score 0. A text that is all unknown grams still gets
the most likely language. Ties go to the language that sorts first. Without any labelled row every
text is `und`. Repeated rows are predicted alike, and count each in training. A text longer than `slice_bytes` is a slice of its
own, read whole. An empty table gives none. Bytes that are no UTF-8 are read as U+FFFD, no letter. Other columns,
whatever their names, aren't read.
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
    fit_rows: int = 8_000
    buckets: int = 1 << 15
    smooth: float = 0.5
    slice_bytes: int = 1 << 20


_MULTIPLY = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


class _Letters:
    """Code points to their lower-case letter, or the space. Beyond the table, looked up one by one."""

    def __init__(self):
        low = np.full(0x3000, 32, np.uint32)
        for c in range(len(low)):
            ch = chr(c)
            if ch.isalpha():
                low[c] = ord(ch.lower()) if len(ch.lower()) == 1 else c
        self.low = low

    def __call__(self, points: np.ndarray) -> np.ndarray:
        if points.size and points.max() < len(self.low):
            return self.low[points]
        out = self.low[np.minimum(points, len(self.low) - 1)]
        far = points >= len(self.low)
        kinds, back = np.unique(points[far], return_inverse=True)
        out[far] = np.array([ord(chr(c).lower()) if chr(c).isalpha() and len(chr(c).lower()) == 1 else c if chr(c).isalpha() else 32 for c in kinds.tolist()], np.uint32)[back]
        return out


def grams(texts: list[bytes | None], letters: _Letters, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts together: hashed grams, the text that each belongs to, letters in each text."""
    points = [np.frombuffer((b" " + t + b" ").decode("utf-8", "replace").encode("utf-32-le"), np.uint32) if t else np.full(1, 32, np.uint32) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in points])
    flat = letters(np.concatenate(points))
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != 32) | (flat[:-1] != 32) | (owner[1:] != owner[:-1])
    flat, owner = flat[keep], owner[keep]
    n_letters = np.bincount(owner[flat != 32], minlength=len(texts))
    one = flat * _MULTIPLY[0]
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _MULTIPLY[1] + flat[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _MULTIPLY[2] + flat[2:]
    found, owners = [], []
    for k, h in enumerate((one, two * _MULTIPLY[1], three * _MULTIPLY[0])):
        whole = owner[: len(h)] == owner[k:]
        spread = (h ^ (h >> np.uint32(16))) * _MULTIPLY[2]
        found.append(((spread >> np.uint32(7)) % np.uint32(buckets))[whole].astype(np.int32))
        owners.append(owner[: len(h)][whole])
    return np.concatenate(found), np.concatenate(owners), n_letters


class Model:
    """log_prior by language; log_likelihood, a matrix of buckets x languages."""

    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray, how: Fit):
        self.langs, self.how = langs, how
        self.log_prior = np.log(docs / docs.sum()) if len(langs) else np.zeros(0)
        self.log_likelihood = np.log((counts + how.smooth) / (counts.sum(axis=1, keepdims=True) + how.smooth * how.buckets)).T.astype(np.float32).copy() if len(langs) else np.zeros((how.buckets, 0), np.float32)

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        letters = _Letters()
        names, scores = [], []
        columns = self.log_likelihood.T.astype(np.float64, order="C")  # of each language side by side, as they are gathered
        for a, b in common.sliced(texts, self.how.slice_bytes):
            index, owner, n_letters = grams(texts[a:b], letters, self.how.buckets)
            sums = np.stack([np.bincount(owner, weights=columns[k].take(index), minlength=b - a) for k in range(len(self.langs))], axis=1) if self.langs else np.zeros((b - a, 0))
            sums = sums + self.log_prior
            for row, n in zip(sums, n_letters, strict=True):
                if not n or not self.langs:
                    names.append("und")
                    scores.append(0.0)
                    continue
                best = int(row.argmax())
                names.append(self.langs[best])
                scores.append(float(1 / np.exp(row - row[best]).sum()))
        return names, scores


def fit(docs: DataFrame, how: Fit = Fit()) -> Model:
    """Learns from text and lang of the rows that aren't held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    # A bounded sample: the threshold is the fit_rows-th smallest hash of an id, so no text is sorted or moved.
    hashed = rows.withColumn("h", F.xxhash64("doc_id"))
    limit = docs.where(F.col("lang").isNotNull() & ~common.held_out(F.col("doc_id"))).select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(how.fit_rows).agg(F.max("h")).first()[0]
    if limit is None:
        return Model([], np.zeros((0, how.buckets)), np.zeros(0), how)

    def count(batches):
        letters, total, seen = _Letters(), {}, {}
        for batch in batches:
            texts, langs = common.byte_texts(batch.column(0)), [x.decode("utf-8", "replace") for x in common.byte_texts(batch.column(1))]
            for a, b in common.sliced(texts, how.slice_bytes):
                index, owner, _ = grams(texts[a:b], letters, how.buckets)
                names = sorted(set(langs[a:b]))
                which = np.array([names.index(x) for x in langs[a:b]])[owner]
                for k, name in enumerate(names):
                    total[name] = total.get(name, 0) + np.bincount(index[which == k], minlength=how.buckets)
                    seen[name] = seen.get(name, 0) + langs[a:b].count(name)
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": [name] * (len(at) + 1), "at": [-1, *at.tolist()], "n": [seen[name], *counts[at].tolist()]})

    sums = common.map_arrow(hashed.where(F.col("h") <= limit).select("text", "lang"), count, "lang string, at bigint, n bigint").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(sums["lang"]))
    counts, n_docs = np.zeros((len(langs), how.buckets)), np.zeros(len(langs))
    place = sums["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=int)
    at, n = sums["at"].to_numpy(), sums["n"].to_numpy(dtype=float)
    counts[place[at >= 0], at[at >= 0]] = n[at >= 0]
    n_docs[place[at < 0]] = n[at < 0]
    return Model(langs, counts, n_docs, how)


def predict(spark: SparkSession, model: Model) -> Column:
    """A struct column: lang_pred and score of each whole text."""
    shared = spark.sparkContext.broadcast(model)  # buckets x languages numbers, whatever the corpus

    def run(texts):
        names, scores = shared.value.predict(texts)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return common.row_udf(run, "struct<lang_pred:string,score:double>")(F.col("text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs)
    return docs.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), predict(spark, model).alias("r")).select("doc_id", "held_out", "r.*")
