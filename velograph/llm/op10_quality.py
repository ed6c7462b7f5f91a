"""Quality rules: counts over words and lines, and the divergence of a document from its language.

Every language (value of `lang`) with `min_docs` documents or more has a reference: the mean histogram of its
documents, over all of them that are long enough, of character classes and of common words. The common words of some
languages are listed; those of the others are their own `n_common` most frequent words. A document fails if its
Jensen-Shannon distance from its own language's reference is over the limit, for character classes or for common words.
Limits come from the language's own documents: the upper quartile of their distances, and so many
interquartile ranges more; that for common words stays under `word_reach` of the distance that a text
without any of them has, so it is always in reach. A document also fails if another language's reference is nearer by words
by more than `foreign`. Texts under the minimum lengths are not
compared: a few words say nothing about a distribution. A document without `lang` is compared with the nearest
reference by words (by classes, if too short; of equal ones the first by name), and one of a language without reference is left to
the base rule.

Null and empty texts have no words, so the base rule rejects them. Repeated rows are judged one
by one, alike, and count each. An empty corpus gives no reference, so only the base rule holds. A text of any
length is read whole, in time that grows with its length. Bytes that are no UTF-8 count as a character each where no character
begins before. Equal distances are equal verdicts: a limit itself still passes. Other columns, whatever their
names, aren't read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velograph.llm import common

SYMBOLS = b"#*$%&|<>"
#: Frequent function words; their frequencies are counted in the corpus.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on with be as by this from are or an not have but".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un une du dans est que pour qui au par sur pas avec elle ce il".split(),
    "es": "de la que el en y los se del las un por con una su para es al lo no como más".split(),
}
#: Digits are left out: a telephone number in a short text says nothing about its prose.
CLASSES = ("lower", "upper", "space", "stop", "symbol", "other", "beyond")
_STRUCT = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, class_distance double, word_distance double"
#: Parts of a whole to which shares are rounded, so that sums are the same in any order.
_ONE = 1 << 20
#: Of distances, for their quartiles.
_BINS = 1000


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    class_fence: float = 10.0
    word_fence: float = 2.0
    #: What a limit is over the upper quartile, at least.
    least: float = 0.05
    word_reach: float = 0.9
    #: By how much another language's reference may be nearer by words.
    foreign: float = 0.1
    class_min_chars: int = 200
    word_min_words: int = 100
    min_docs: int = 50
    n_common: int = 24
    common_words: dict[str, list[str]] = field(default_factory=lambda: COMMON_WORDS)


def _class_table() -> np.ndarray:
    """The class of each byte; -1 for digits and the second and later bytes of a character."""
    kind = np.full(256, 5)
    kind[ord("a") : ord("z") + 1] = 0
    kind[ord("A") : ord("Z") + 1] = 1
    kind[ord("0") : ord("9") + 1] = -1
    kind[list(common.ASCII_SPACE)] = 2
    kind[list(b".,;:'\"-()?")] = 3
    kind[list(SYMBOLS + b"!@^~\\_={}[]`+/")] = 4
    kind[128:192] = -1
    kind[192:] = 6
    return kind


_CLASS_OF = np.stack([_class_table() == k for k in range(len(CLASSES))], axis=1).astype(np.float64)
#: For words of the histogram: letters and digits stay, A-Z in lower case, the rest splits.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

def repeat_words(words: list[bytes], width: int = 5) -> int:
    """How many words stand in some window of `width` words that occurs twice or more."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered, last = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            covered += i + width - max(i, last)
            last = i + width
    return covered


def base(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    tight = text.translate(None, common.ASCII_SPACE)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), len(tight.decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def histograms(text: bytes, place: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Class counts, counts of the common words and of all others, and the number of words."""
    classes = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS_OF
    words = text.translate(_PLAIN).split()
    common_words = np.zeros(len(place) + 1)
    for k, n in Counter(map(place.get, words)).items():
        common_words[-1 if k is None else k] = n
    return classes, common_words, len(words)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of distribution p from each of q, along the last axis: the root of the divergence in bits, 0 to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        right = np.where(q == 0, 0, q * np.log2(q / m)).sum(axis=-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


class Model:
    """Of each language a row of reference shares of classes and of words, NaN where no document is long enough; and
    the limits of both distances."""

    def __init__(self, langs: list[str], place: dict[bytes, int], classes: np.ndarray, words: np.ndarray, rules: Rules):
        self.langs, self.place, self.classes, self.words, self.rules = langs, place, classes, words, rules
        self.limits: list[tuple[float, float]] = [(np.inf, np.inf)] * len(langs)

    def compared(self, texts: list[bytes | None], langs: list[str | None]) -> list[tuple[int | None, float | None, float | None, float | None]]:
        """Of each text the language that it is compared with, its distances, and the least distance by words of any;
        None where not compared."""
        out = [(None, None, None, None)] * len(texts)
        rows = [i for i, (text, lang) in enumerate(zip(texts, langs, strict=True)) if text and self.langs and (lang is None or lang in self.langs)]
        # As many texts at a time as there are about a million numbers in their tables of distances.
        step = max(1, (1 << 20) // max(1, self.words.size + self.classes.size))
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            classes, words, n = map(np.array, zip(*(histograms(texts[i], self.place) for i in part), strict=True))
            by_class = self._far(classes, classes.sum(axis=1), self.rules.class_min_chars, self.classes)
            by_word = self._far(words, n, self.rules.word_min_words, self.words)
            for i, far_class, far_word in zip(part, by_class, by_word, strict=True):
                by = far_class if np.isnan(far_word).all() else far_word
                if np.isnan(by).all():
                    continue
                k = int(np.nanargmin(by)) if langs[i] is None else self.langs.index(langs[i])
                own = [None if np.isnan(x[k]) else float(x[k]) for x in (far_class, far_word)]
                out[i] = k, *own, None if own[1] is None else float(np.nanmin(far_word))
        return out

    @staticmethod
    def _far(counts: np.ndarray, sizes: np.ndarray, least: int, refs: np.ndarray) -> np.ndarray:
        """Distances of each row of counts from each reference; NaN where the row is too small or there is no reference."""
        far = np.full((len(counts), len(refs)), np.nan)
        enough = sizes >= least
        far[enough] = js_distance((counts[enough] / sizes[enough, None])[:, None], refs)
        return far

    def kept(self, k: int | None, far_class: float | None, far_word: float | None, near_word: float | None) -> bool:
        if k is None:
            return True
        of_class, of_word = self.limits[k]
        return (far_class is None or far_class <= of_class) and (far_word is None or far_word <= of_word and far_word - near_word <= self.rules.foreign)


def _langs_of(column: pa.Array) -> list[str | None]:
    return [None if x is None else x.decode("utf-8", "replace") for x in common.byte_texts(column)]


def common_words(docs: DataFrame, langs: list[str], rules: Rules = Rules()) -> dict[str, list[str]]:
    """The words listed; for other languages their most frequent ones, counted over all their documents."""
    found = {k: list(rules.common_words[k]) for k in langs if k in rules.common_words}
    others = [k for k in langs if k not in found]
    if not others:
        return found
    words = F.regexp_extract_all(F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    counts = docs.where(F.col("lang").isin(*others)).select("lang", F.explode(words).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    # Of partial sums; each task puts n_common rows of a language forward at most.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.desc("word")))
    for r in counts.withColumn("place", place).where(F.col("place") <= rules.n_common).collect():
        found.setdefault(r.lang, []).append(r.word)
    return found


def references(docs: DataFrame, rules: Rules = Rules()) -> Model:
    """The references and limits, over all documents long enough. What a task keeps and sends is one row of
    numbers for each language."""
    own = docs.select("text", "lang")
    langs = sorted(r.lang for r in own.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= rules.min_docs).collect())
    lists = common_words(own, langs, rules)
    place = {w.encode("utf-8"): i for i, w in enumerate(sorted({w for ws in lists.values() for w in ws}))}
    n_classes, width = len(CLASSES), len(CLASSES) + len(place) + 1
    rows = own.where(F.col("lang").isin(*langs)) if langs else own.where(F.lit(False))

    def sums(batches):
        total = np.zeros((len(langs), width + 2), np.int64)
        for batch in batches:
            for lang, text in zip(_langs_of(batch.column(1)), common.byte_texts(batch.column(0)), strict=True):
                if not text:
                    continue
                classes, words, n = histograms(text, place)
                row = total[langs.index(lang)]
                if classes.sum() >= rules.class_min_chars:
                    row[:n_classes] += np.rint(classes / classes.sum() * _ONE).astype(np.int64)
                    row[-2] += 1
                if n >= rules.word_min_words:
                    row[n_classes:width] += np.rint(words / n * _ONE).astype(np.int64)
                    row[-1] += 1
        ref, at = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"ref": ref, "at": at, "part": total[ref, at]})

    def added(fn, schema: str, shape: tuple[int, ...]) -> np.ndarray:
        keys = [c.split()[0] for c in schema.split(", ")]
        out = np.zeros(shape)
        for r in common.map_arrow(rows, fn, schema).groupBy(*keys[:-1]).agg(F.sum(keys[-1]).alias("total")).collect():
            out[tuple(r[k] for k in keys[:-1])] = r.total
        return out

    total = added(sums, "ref bigint, at bigint, part bigint", (len(langs), width + 2))
    with np.errstate(divide="ignore", invalid="ignore"):
        shares = [part / _ONE / n[:, None] for part, n in ((total[:, :n_classes], total[:, -2]), (total[:, n_classes:width], total[:, -1]))]
    model = Model(langs, place, *shares, rules)

    def distances(batches):
        count = np.zeros((len(langs), 2, _BINS), np.int64)
        for batch in batches:
            for k, *far, _ in model.compared(common.byte_texts(batch.column(0)), _langs_of(batch.column(1))):
                for i, x in enumerate(far):
                    if x is not None:
                        count[k, i, min(int(x * _BINS), _BINS - 1)] += 1
        at = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({**dict(zip(("ref", "kind", "bin"), at, strict=True)), "n": count[at]})

    model.limits = [_limits(model, k, h) for k, h in enumerate(added(distances, "ref bigint, kind bigint, bin bigint, n bigint", (len(langs), 2, _BINS)))]
    return model


def _limits(model: Model, k: int, held: np.ndarray) -> tuple[float, float]:
    """The limits of a language, of how many of its documents' distances lie in each bin."""
    rules, out = model.rules, []
    for bins, fence in zip(held, (rules.class_fence, rules.word_fence), strict=True):
        if not bins.sum():
            out.append(np.inf)
            continue
        run = np.cumsum(bins)
        low, high = ((np.searchsorted(run, q * run[-1]) + 1) / _BINS for q in (0.25, 0.75))
        out.append(high + max(fence * (high - low), rules.least))
    if not np.isnan(model.words[k]).any():
        bare = np.eye(len(model.place) + 1)[-1]
        out[1] = min(out[1], rules.word_reach * float(js_distance(bare, model.words[k][None])[0]))
    return tuple(out)


def judge(docs: DataFrame, rules: Rules = Rules()) -> Column:
    """A struct column of the counts, the distances (null where not compared) and the verdict, of text and lang."""
    shared = docs.sparkSession.sparkContext.broadcast(references(docs, rules))  # a row of numbers for each language

    def run(batches):
        model = shared.value
        for batch in batches:
            texts, langs = batch.flatten()
            texts, rows = common.byte_texts(texts), []
            for text, found in zip(texts, model.compared(texts, _langs_of(langs)), strict=True):
                n, chars, symbols, lines, repeats = base(text or b"")
                failed = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
                rows.append((n, chars, symbols, lines, repeats, failed, not failed and model.kept(*found), *found[1:3]))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            names = [x.split()[0] for x in _STRUCT.split(", ")]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    run.__annotations__ = common.ARRAY_ITERATOR
    returns = f"struct<{_STRUCT.replace(' ', ':').replace(',:', ',')}>"
    return F.arrow_udf(run, returns)(F.struct(F.col("text").cast("string"), F.col("lang").cast("string")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return docs.select("doc_id", judge(docs).alias("r")).select("doc_id", "r.*")
