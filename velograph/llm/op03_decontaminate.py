"""Benchmark decontamination: a prefix-filtered set join of documents and item windows.

An item's windows are its runs of 10 consecutive words (all its words, if fewer). A document has
to hold all shingles of a window, so the window's prefix under a global order is one shingle: its
rarest, counted over all documents. Documents are joined with windows by that shingle; its places in
document and window fix where the window has to start, which must lie within the text (positional
and length bound); the words around are then compared, so a hit is exact.

The windows of a benchmark of up to `broadcast_bytes` of text are broadcast, and each text is searched where it lies. Those of a
larger one are a table by prefix shingle, that is joined with the documents' places of such shingles, each
with the words around: as many jobs however large the benchmark. A bit field keeps most places without a
prefix out of the shuffle. Where it would be crowded, places are joined as numbers first, and words are fetched for those that
are a prefix's. Windows are salted against frequent shingles, and documents aren't shuffled unless more than `lookup_rows`
texts are hit.

Null texts have no words. Items without words have no windows. Items of one id count once, with the windows of all their
texts; an item without id still marks words, its id is the empty text. No items or no documents: nothing is
hit. Shingles of equal counts are ordered by their words, in the table by their hashes, then by place: which one is the prefix
doesn't change a result. Repeated rows and texts are judged alike. A text of any length is read whole, by one
task. Bytes beyond ASCII are letters, whether they are UTF-8 or not. Other columns, whatever their names, pass through.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.llm import common

#: Word bytes, A-Z in lower case: digits, letters and everything beyond ASCII; the rest splits.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isdigit() or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Windows:
    words: int = 10
    shingle: int = 3
    broadcast_bytes: int = 1 << 20
    #: Hit texts up to which they are broadcast.
    lookup_rows: int = 100_000
    salts: int = 8
    #: Bits of a field, 2 MB by default; with more than an eighth as many prefix shingles words are fetched for what joins alone.
    field_bits: int = 1 << 24


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


def shingles_of(words: list[bytes], width: int):
    return zip(*(words[i:] for i in range(width)), strict=False)


class Index:
    """By length and prefix shingle: (item, place of the shingle, first and last window start, window length)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], counts: dict[tuple[bytes, ...], int], how: Windows):
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        self.by_width: dict[int, dict] = defaultdict(lambda: defaultdict(list))
        for k, words in enumerate(self.words):
            size = min(how.words, len(words))
            width = min(how.shingle, size)
            own = list(shingles_of(words, width))
            last = None
            for start in range(len(words) - size + 1):
                at = min(range(start, start + size - width + 1), key=lambda x: (counts.get(own[x], 0), own[x], x))
                if last and last[1] == at:
                    last[3] = start
                else:
                    last = [k, at, start, start, size]
                    self.by_width[width][own[at]].append(last)
        self.by_width = {w: dict(x) for w, x in self.by_width.items()}

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Places [from, to) covered by occurring windows, as found, and the items hit."""
        spans, items, n = [], set(), len(words)
        for width, index in self.by_width.items():
            get = index.get
            for q, found in enumerate(map(get, shingles_of(words, width))):
                if found is None:
                    continue
                for k, at, first, last, size in found:
                    own = self.words[k]
                    left, least = 0, min(at - first, q)
                    while left < least and own[at - left - 1] == words[q - left - 1]:
                        left += 1
                    right, most = width, min(last + size - at, n - q)
                    while right < most and own[at + right] == words[q + right]:
                        right += 1
                    low, high = max(first, at - left), min(last, at + right - size)
                    if low <= high:
                        spans.append((q + low - at, q + high - at + size))
                        items.add(k)
        return spans, items


def _vocabulary(items: list[tuple[str, list[bytes]]], how: Windows) -> dict[tuple[bytes, ...], int]:
    found: dict[tuple[bytes, ...], int] = {}
    for _, words in items:
        for s in shingles_of(words, min(how.shingle, len(words))):
            found.setdefault(s, len(found))
    return found


def counts(docs: DataFrame, vocabulary: dict[tuple[bytes, ...], int]) -> dict[tuple[bytes, ...], int]:
    """How often each shingle of the vocabulary occurs, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of broadcast_bytes of items
    widths = sorted({len(s) for s in vocabulary})

    def count(batches):
        known = shared.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for text in common.byte_texts(batch.column(0)):
                words = words_of(text)
                for width in widths:
                    at = [k for k in map(known.get, shingles_of(words, width)) if k is not None]
                    if at:
                        np.add.at(total, at, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    found = common.map_arrow(docs.select("text"), count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    names = list(vocabulary)
    return {names[r.at]: r.n for r in found}


def _items(benchmark: DataFrame) -> DataFrame:
    """id and text of the items that have a text, each once."""
    return benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text")).dropDuplicates()


def _finished(n_words: int, spans: list, ids: set[str]) -> tuple:
    hit, end = 0, 0
    for a, b in sorted(spans):
        hit += max(0, b - max(a, end))
        end = max(end, b)
    return n_words, hit, len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), hit > 0


_RESULT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
_STRUCT = "struct<n_words:bigint,n_hit:bigint,n_items:bigint,items_sha256:string,contaminated:boolean>"


def _results(rows: list[tuple]) -> pa.Array:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(_RESULT))


def judged(docs: DataFrame, benchmark: DataFrame, how: Windows = Windows(), name: str = "r") -> DataFrame:
    """docs with a struct column of n_words, n_hit, n_items, items_sha256, contaminated for docs.text."""
    items = _items(benchmark)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return docs.withColumn(name, judge(docs, benchmark, how)) if total <= how.broadcast_bytes else _joined(docs, items, how, name)


def judge(docs: DataFrame, benchmark: DataFrame, how: Windows = Windows()) -> Column:
    """That column, of a benchmark that may be broadcast whole."""
    rows = _items(benchmark).sort("id", "text").select("id", F.col("text").cast("binary").alias("text"))
    items = [(r.id, w) for r in rows.toLocalIterator() if (w := words_of(bytes(r.text)))]
    shared = docs.sparkSession.sparkContext.broadcast(Index(items, counts(docs, _vocabulary(items, how)), how)) if items else None

    def whole(texts):
        index = shared.value if shared else None
        rows = []
        for text in texts:
            words = words_of(text)
            spans, items = index.hits(words) if index else ([], set())
            rows.append(_finished(len(words), spans, {index.ids[k] for k in items} if items else set()))
        return _results(rows)

    return common.row_udf(whole, _STRUCT)(F.col("text"))


# --- a benchmark of any size ------------------------------------------------------------------------

def _hash(shingle: tuple[bytes, ...]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(shingle), len(shingle))


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    return np.array([_hash(s) for s in shingles_of(words, width)], np.uint64)


def _field(hashes: DataFrame, how: Windows) -> np.ndarray:
    """A bit field of the hashes in a column h: a row for each 64 of its bits at most is collected."""
    place = hashes.select(F.col("h").bitwiseAND(how.field_bits - 1).alias("p"))
    words = place.select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, CAST(p & 63 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(how.field_bits // 64, np.int64)
    for r in words.collect():
        out[r.w] = r.b
    return out.view(np.uint64)


def _among(field: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be of the field."""
    p = hashes & np.uint64(64 * len(field) - 1)
    return (field[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)


def _shingled(items: DataFrame, how: Windows) -> DataFrame:
    """id, text, pos, h: the shingles of the items, each with its place."""

    def run(batches):
        for batch in batches:
            for part in common.parts(batch, 1, 1 << 18):
                found = [words_of(t) for t in common.byte_texts(part.column(1))]
                hashes = [_hashes(w, min(how.shingle, len(w))) if w else np.zeros(0, np.uint64) for w in found]
                at = pa.array(np.repeat(np.arange(part.num_rows), [len(h) for h in hashes]))
                pos = np.concatenate([np.arange(len(h)) for h in hashes])
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(2).take(at), pa.array(pos, pa.int64()), pa.array(np.concatenate(hashes).view(np.int64))], ["id", "item", "pos", "h"])

    return common.map_arrow(items.select("id", "text", "item"), run, "id string, item bigint, pos bigint, h bigint")


def _counted(docs: DataFrame, field: np.ndarray, how: Windows) -> DataFrame:
    """h, n: how often shingles that may be the benchmark's occur, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            for part in common.parts(batch, 0, 1 << 20):
                found = [h[_among(shared.value, h)] for t in common.byte_texts(part.column(0)) if (w := words_of(t)) for k in range(1, how.shingle + 1) if len(h := _hashes(w, k))]
                h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    return common.map_arrow(docs.select("text"), run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


_ENTRY = "h bigint, id string, span string, at int, starts int, size int"


def _entries(items: DataFrame, shingles: DataFrame, counted: DataFrame, how: Windows) -> DataFrame:
    """The windows by prefix shingle, in the columns of _ENTRY: those of `starts` starts in a row that share it, at
    the place `at` of the words of span."""
    ranks = shingles.join(counted, "h", "left").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("n", F.lit(0)).alias("n")))).alias("ranks"))
    rows = items.join(ranks.select("item", F.col("ranks.n").alias("ranks")), "item").select("id", "text", "ranks")

    def run(batches):
        for batch in batches:
            out = []
            for name, text, ranks in zip(batch.column(0).to_pylist(), common.byte_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = words_of(text)
                size = min(how.words, len(words))
                width = min(how.shingle, size)
                hashes = _hashes(words, width).tolist()
                last = None
                for start in range(len(words) - size + 1):
                    at = min(range(start, start + size - width + 1), key=lambda x: (ranks[x], hashes[x], x))
                    if last and last[1] == at:
                        last[3] = start
                    else:
                        last = [hashes[at], at, start, start]
                        out.append((name, words, size, last))
            flat = [(h - (1 << 64) if h >> 63 else h, name, b" ".join(words[first : end + size]), at - first, end - first + 1, size) for name, words, size, (h, at, first, end) in out]
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], k) for i, k in enumerate(kinds)], [c.split()[0] for c in _ENTRY.split(", ")])

    return common.map_arrow(rows, run, _ENTRY.replace("span string", "span binary"))


def _places(docs: DataFrame, field: np.ndarray, how: Windows) -> DataFrame:
    """text (its digest), h, q, around, left: the places q of shingles that may be prefixes, with the words around, of which
    `left` stand before the shingle."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    far = how.words - 1
    names = ["text", "h", "q", "around", "before"]

    def run(batches):
        for batch in batches:
            for part in common.parts(batch, 0, 1 << 20):
                out = []
                for text in common.byte_texts(part.column(0)):
                    words = words_of(text)
                    digest = hashlib.md5(text or b"").digest()
                    for width in range(1, min(how.shingle, len(words)) + 1):
                        hashes = _hashes(words, width)
                        for q in np.flatnonzero(_among(shared.value, hashes)).tolist():
                            out.append((digest, int(hashes[q].view(np.int64)), q, b" ".join(words[max(q - far, 0) : q + width + far]), min(q, far)))
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return common.map_arrow(docs.select("text"), run, "text binary, h bigint, q bigint, around binary, before int")


def _bare_places(docs: DataFrame, field: np.ndarray, how: Windows) -> DataFrame:
    """text, h, q as in _places, without any words."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            for part in common.parts(batch, 0, 1 << 20):
                texts, h, q = [], [], []
                for text in common.byte_texts(part.column(0)):
                    words = words_of(text)
                    for width in range(1, min(how.shingle, len(words)) + 1):
                        hashes = _hashes(words, width)
                        at = np.flatnonzero(_among(shared.value, hashes))
                        texts += [hashlib.md5(text or b"").digest()] * len(at)
                        h.append(hashes[at].view(np.int64))
                        q.append(at)
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(np.concatenate(h) if h else [], pa.int64()), pa.array(np.concatenate(q) if q else [], pa.int64())], ["text", "h", "q"])

    return common.map_arrow(docs.select("text"), run, "text binary, h bigint, q bigint")


def _fetched(docs: DataFrame, entries: DataFrame, field: np.ndarray, how: Windows) -> DataFrame:
    """The rows of _places for the places of prefixes alone: those are found by a join of numbers, and their words are then
    taken from the texts that have any."""
    far = how.words - 1
    true = _bare_places(docs, field, how).join(entries.select("h").distinct(), "h", "left_semi")
    wanted = common.written(true.groupBy("text").agg(F.collect_set(F.struct("q", "h")).alias("at")), "places")

    def run(batches):
        names = ["text", "h", "q", "around", "before"]
        for batch in batches:
            for part in common.parts(batch, 1, 1 << 20):
                out = []
                for digest, text, at in zip(part.column(0).to_pylist(), common.byte_texts(part.column(1)), part.column(2).to_pylist(), strict=True):
                    words = words_of(text)
                    # A place's shingle isn't longer than the longest; a word more around it changes nothing.
                    out += [(digest, r["h"], r["q"], b" ".join(words[max(r["q"] - far, 0) : r["q"] + how.shingle + far]), min(r["q"], far)) for r in at]
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    keyed = docs.select(F.unhex(F.md5(F.col("text").cast("string").cast("binary"))).alias("digest"), F.col("text").alias("whole"))
    texts = keyed.join(common.small_or_all(wanted.withColumnRenamed("text", "digest"), how.lookup_rows), "digest").dropDuplicates(["digest"]).select("digest", "whole", "at")
    return common.map_arrow(texts, run, "text binary, h bigint, q bigint, around binary, before int")


def _joined(docs: DataFrame, items: DataFrame, how: Windows, name: str) -> DataFrame:
    items = common.cut(items.withColumn("item", F.xxhash64("id", "text")))
    shingles = _shingled(items, how)
    counted = _counted(docs, _field(shingles, how), how)
    entries = common.cut(_entries(items, shingles, counted, how))
    # Copies of a text count once, before they meet at one prefix.
    crowded = entries.agg(F.approx_count_distinct("h")).first()[0] > how.field_bits // 8
    found = (_fetched(docs, entries, _field(entries, how), how) if crowded else _places(docs, _field(entries, how), how)).dropDuplicates(["text", "h", "q"])
    places = found.withColumn("salt", F.pmod(F.xxhash64("text", "q"), F.lit(how.salts)))
    salted = entries.withColumn("salt", F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(how.salts)])))

    def compared(batches):
        for batch in batches:
            texts, froms, tos, ids = [], [], [], []
            for text, q, around, before, name, span, at, starts, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, words = span.split(b" "), around.split(b" ")
                # The place of the span's first word among the words around, were it there.
                offset = before - at
                same = [0 <= offset + k < len(words) and words[offset + k] == w for k, w in enumerate(own)]
                run = 0
                for k in range(len(own)):
                    run = run + 1 if same[k] else 0
                    if run >= size and k - size + 1 < starts:
                        texts.append(text)
                        froms.append(q - at + k - size + 1)
                        tos.append(q - at + k + 1)
                        ids.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(froms, pa.int64()), pa.array(tos, pa.int64()), pa.array(ids, pa.string())], ["text", "a", "b", "id"])

    pairs = places.join(salted, ["h", "salt"]).select("text", "q", "around", "before", "id", "span", "at", "starts", "size")
    hits = common.map_arrow(pairs, compared, "text binary, a bigint, b bigint, id string")
    each = hits.groupBy("text").agg(F.collect_set(F.struct("a", "b")).alias("spans"), F.collect_set("id").alias("ids"))

    def finish(batches):
        for batch in batches:
            found = [_finished(0, [(s["a"], s["b"]) for s in r["spans"]], set(r["ids"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.string())], ["digest", "n_hit", "n_items", "items_sha256"])

    key, *own = common.fresh(docs, "digest", "n_hit", "n_items", "items_sha256")
    found = common.cut(common.map_arrow(each, finish, "digest binary, n_hit bigint, n_items bigint, items_sha256 string")).toDF(key, *own)
    few = found.limit(how.lookup_rows + 1).count() <= how.lookup_rows
    keyed = docs.withColumn(key, F.unhex(F.md5(F.col("text").cast("string").cast("binary"))))
    number = common.row_udf(lambda texts: pa.array([len(words_of(t)) for t in texts], pa.int64()), "bigint")(F.col("text"))
    result = F.struct(number.alias("n_words"), F.coalesce(own[0], F.lit(0)).alias("n_hit"), F.coalesce(own[1], F.lit(0)).alias("n_items"), F.coalesce(own[2], F.lit(hashlib.sha256(b"").hexdigest())).alias("items_sha256"), F.col(own[0]).isNotNull().alias("contaminated"))
    return keyed.join(F.broadcast(found) if few else found, key, "left").withColumn(name, result).drop(key, *own)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, common.table(spark, sf_dir, "benchmark")).select("doc_id", "r.*")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM d, ks, unnest(range(1, len(w) - k + 2)) AS t(i)),
m AS (SELECT DISTINCT doc_id, dw.k, i, item_id FROM dw JOIN iw ON dw.s = iw.s AND dw.k = iw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + k)) AS t(p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
