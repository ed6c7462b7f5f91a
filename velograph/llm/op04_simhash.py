"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints within `distance` bits share a block of 64 / (distance + 1) bits, so the upper nodes of
the index are masked bit patterns, one for each block, and any linked pair meets below one of them.
An upper node with more than `node_rows` distinct fingerprints is split by the same rule on its free
bits: the other side of a link again agrees in one block of those. Free bits shrink by a quarter each
time, and a node with 11 of them has 2,048 fingerprints at most, so no task holds an unbounded node.

Below an upper node, fingerprints stand in order of their Gray rank; runs of 16, and runs of such runs,
carry the bits that all of theirs share. Two runs are compared by the shared bits that differ: over
`distance`, all their pairs are pruned at once. What is linked is emitted as a spanning forest, a row less than
the node has fingerprints at most, never all pairs. The forests are joined into components by
rounds of contraction; in each, a node goes to the first of its neighbours and itself in an order by hash that is
another one each round, so a path of any labels shrinks by a share of its nodes.

Copies count once, by their fingerprint; lookups by fingerprint or node are broadcast under a checked size,
else salted, so copies of a third of all rows are no single task. Null and empty texts have fingerprint zero and link like any
other. component_id is the smallest doc_id reachable; null ids are passed over, and it is null where all
are. Repeated rows come back once each. A bit set in just half the hashes is 0. A text of any length is one task's, in
constant memory beside its words. An empty table gives an empty one. Other columns, whatever their names, pass through dedup.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.llm import common


@dataclass(frozen=True)
class Near:
    distance: int = 3
    shingle: int = 3
    seed: int = 42
    node_rows: int = 4096
    fan: int = 16
    #: Rows of a lookup up to which it is broadcast.
    lookup_rows: int = 100_000


def simhash(text: bytes | None, how: Near = Near()) -> int:
    words = text.lower().split() if text else []  # bytes.lower() changes A-Z alone
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    join, k, seed = b" ".join, min(how.shingle, len(words)), how.seed
    hashes = np.array([digest(s, seed) for s in map(join, zip(*(words[i:] for i in range(k)), strict=False))], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(how: Near = Near()) -> Column:
    """The fingerprint of `text` as a signed 64-bit number."""

    def run(texts):
        return pa.array(np.array([simhash(t, how) for t in texts], np.uint64).view(np.int64), pa.int64())

    return common.row_udf(run, "bigint")(F.col("text"))


def gray_rank(code: Column) -> Column:
    """Where a code stands in the binary-reflected Gray sequence."""
    for by in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, by))
    return code


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def parts_of(mask: int, parts: int) -> list[int]:
    """The bits that a mask leaves free, in so many blocks, each together with the mask."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in block.tolist()) for block in np.array_split(free, parts) if len(block)]


#: Nodes with so many free bits are searched as they are: they have 2^11 fingerprints at most.
_FREE = 11


def _below(members: DataFrame, masks: list[int], how: Near) -> DataFrame:
    """Members put below the nodes of the next level. A mask's next level depends on the mask alone."""
    nexts = [(_signed(m), [_signed(x) for x in parts_of(m, how.distance + 1)]) for m in masks]
    # A row for each mask of a level: 4 to the level at most, and six levels.
    table = members.sparkSession.createDataFrame(nexts, "mask bigint, masks array<bigint>")
    spread = members.select("fp", "mask").join(F.broadcast(table), "mask").select("fp", F.explode("masks").alias("mask"))
    return spread.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))


def _reduce(a: np.ndarray, how) -> np.ndarray:
    return how.reduceat(a, np.arange(0, len(a), 16))


def _pairs_within(fps: np.ndarray, how: Near) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of one node, whose fingerprints are in Gray order, as places; in bounded parts."""
    levels = [(fps, fps)]  # the bits set in all, and in any, of each run
    while len(levels[-1][0]) > how.fan:
        levels.append((_reduce(levels[-1][0], np.bitwise_and), _reduce(levels[-1][1], np.bitwise_or)))

    def near(level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        every, some = levels[level]
        shared = ~(every[i] ^ some[i]) & ~(every[j] ^ some[j])
        return np.bitwise_count((every[i] ^ every[j]) & shared) <= how.distance

    top = len(levels) - 1
    i, j = np.triu_indices(len(levels[top][0]))
    work = [(top, i, j)]
    steps = np.arange(how.fan)
    while work:
        level, i, j = work.pop()
        keep = near(level, i, j)
        i, j = i[keep], j[keep]
        if level == 0:
            if (i < j).any():
                yield i[i < j], j[i < j]
            continue
        size = len(levels[level - 1][0])
        for a in range(0, len(i), 4096):
            x = (i[a : a + 4096, None, None] * how.fan + steps[:, None]) + np.zeros((1, 1, how.fan), int)
            y = (j[a : a + 4096, None, None] * how.fan + steps[None, None, :]) + np.zeros((1, how.fan, 1), int)
            ok = (x < size) & (y < size) & (x <= y)
            work.append((level - 1, x[ok], y[ok]))


def _union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of i and j, in place; roots are the smallest places."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _forest(start: np.ndarray, fps: np.ndarray, how: Near) -> tuple[np.ndarray, np.ndarray]:
    """start: where each node's rows begin. Links of a spanning forest within the nodes."""
    label = np.arange(len(fps))
    ends = np.append(start[1:], len(fps))
    sizes = ends - start
    node = np.repeat(np.arange(len(start)), sizes)
    small = sizes <= how.fan
    for d in range(1, int(sizes[small].max(initial=1))):
        i = np.flatnonzero((node[d:] == node[:-d]) & small[node[d:]])
        i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= how.distance]
        _union(label, i, i + d)
    for k in np.flatnonzero(~small):
        a = start[k]
        own = np.arange(sizes[k])
        for i, j in _pairs_within(fps[a : ends[k]], how):
            _union(own, i, j)
        label[a : ends[k]] = own + a
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def links(fps: DataFrame, how: Near = Near()) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fingerprints within the distance."""
    masks = [0]
    members = fps.select("fp", F.lit(0).cast("bigint").alias("mask"), F.lit(0).cast("bigint").alias("pattern"))
    settled = None
    while True:
        members = _below(members, masks, how)
        full = members.groupBy("mask", "pattern").agg(F.count("*").alias("n"))
        full = full.where((F.col("n") > how.node_rows) & (64 - F.bit_count("mask") > _FREE)).select("mask", "pattern")
        full = common.cut(full)
        if full.isEmpty():
            break
        rest = members.join(full, ["mask", "pattern"], "left_anti")
        settled = rest if settled is None else settled.unionByName(rest)
        members = common.cut(members.join(full, ["mask", "pattern"], "left_semi"))
        masks = [r.mask % (1 << 64) for r in full.select("mask").distinct().collect()]  # 4 to the level at most
    settled = members if settled is None else settled.unionByName(members)

    def search(batches):
        held = np.zeros((0, 3), np.int64)
        for batch in _then_none(batches):
            if batch is not None:
                rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
                held = np.concatenate([held, rows])
            new = np.ones(len(held), bool)
            new[1:] = (held[1:, :2] != held[:-1, :2]).any(axis=1)
            start = np.flatnonzero(new)
            whole = len(held) if batch is None else (start[-1] if len(start) else 0)
            if whole:
                a, b = _forest(start[start < whole], held[:whole, 2].astype(np.int64).view(np.uint64), how)
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})
            held = held[whole:]

    ordered = settled.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern", gray_rank(F.col("fp")))
    return common.map_arrow(ordered.select("mask", "pattern", "fp"), search, "a bigint, b bigint")


def _then_none(batches):
    yield from batches
    yield None


def _local(batches):
    """The links of a task, as links to the smallest of each tree."""
    a, b = [], []
    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
        if sum(map(len, a)) > 1 << 20:
            a, b = map(lambda x: [x], _starred(np.concatenate(a), np.concatenate(b)))
    if a:
        a, b = _starred(np.concatenate(a), np.concatenate(b))
        for k in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_pydict({"a": pa.array(a[k : k + (1 << 16)]), "b": pa.array(b[k : k + (1 << 16)])})


def _starred(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(names))
    _union(label, at[: len(a)], at[len(a) :])
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _settled(batches):
    """Of all links, few enough for one task: every node with the smallest of its tree."""
    rows = [np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)]) for batch in batches]
    if rows:
        names, at = np.unique(np.concatenate(rows, axis=1), return_inverse=True)
        label = np.arange(len(names))
        _union(label, *at.reshape(2, -1))
        yield pa.RecordBatch.from_pydict({"fp": pa.array(names), "root": pa.array(names[label])})


def components(edges: DataFrame, how: Near = Near()) -> DataFrame:
    """(fp, root) of every node of the edges (a, b), by rounds of contraction: each node takes the first in the round's
    order of its neighbours and itself, twice over; edges move up to those, and vanish within one. Up to lookup_rows edges, as
    they are or as rounds leave them, are one task's. Rounds are written as tables, whose sizes Spark then knows; a checkpoint
    keeps the estimate of its plan, which a join squares."""
    kept = lambda df: common.written(df, "components")
    roots, n = None, 0
    while True:
        edges = kept(common.map_arrow(edges, _local, "a bigint, b bigint"))
        if edges.limit(how.lookup_rows + 1).count() <= how.lookup_rows:
            found = common.map_arrow(edges.coalesce(1), _settled, "fp bigint, root bigint")
            if roots is None:
                return found
            moved = common.looked_up(roots, kept(found.select(F.col("fp").alias("root"), F.col("root").alias("up"))), "root", "fp", how.lookup_rows, how="left")
            return moved.select("fp", F.coalesce("up", "root").alias("root"))
        n += 1
        place = lambda c, n=n: F.struct(F.xxhash64(F.col(c), F.lit(n)).alias("p"), F.col(c).alias("v"))
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = kept(both.groupBy("a").agg(F.min(place("b")).alias("m")).select(F.col("a").alias("node"), F.least(place("a"), F.col("m"))["v"].alias("up")))
        upper = parent.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        parent = kept(common.looked_up(parent, upper, "up", "node", how.lookup_rows).select("node", F.col("upper").alias("up")))
        if roots is None:
            roots = parent.select(F.col("node").alias("fp"), F.col("up").alias("root"))
        else:
            moved = common.looked_up(roots, parent.select(F.col("node").alias("root"), "up"), "root", "fp", how.lookup_rows, how="left")
            roots = kept(moved.select("fp", F.coalesce("up", "root").alias("root")))
        edges = common.looked_up(edges, parent.select(F.col("node").alias("a"), F.col("up").alias("x")), "a", "b", how.lookup_rows)
        edges = common.looked_up(edges, parent.select(F.col("node").alias("b"), F.col("up").alias("y")), "b", "a", how.lookup_rows)
        edges = edges.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))


def groups(prints: DataFrame, how: Near = Near()) -> DataFrame:
    """prints: doc_id, fp. A row for each distinct fp: fp, root (a fingerprint that stands for the group)."""
    distinct = common.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), how), how)
    return distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """doc_id, fp, component_id of each row of docs (doc_id, text)."""
    prints = common.cut(docs.select("doc_id", fingerprint(how).alias("fp")))
    found = common.cut(groups(prints, how))
    named = found.groupBy("root").agg(F.min("least").alias("component_id"))
    table = common.cut(common.looked_up(found.select("fp", "root"), common.cut(named), "root", "fp", how.lookup_rows).select("fp", "component_id"))
    return common.looked_up(prints, table, "fp", "doc_id", how.lookup_rows).select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """docs, one row of each group: that of the smallest doc_id (null last), of its rows the smallest text hash."""
    # Plain equality for null ids too, so that the join and dropDuplicates deal rows out alike: one shuffle of texts.
    key = common.fresh(docs, "no_id", "id", "hash")
    tagged = docs.withColumns(dict(zip(key, (F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.xxhash64("text")), strict=True)))
    prints = common.cut(tagged.select(F.col("doc_id"), *key, fingerprint(how).alias("fp")))
    found = groups(prints.select("doc_id", "fp"), how).select("fp", "root")
    first = prints.groupBy("fp").agg(F.min(F.struct(*key)).alias("first"))
    chosen = first.join(found, "fp").groupBy("root").agg(F.min("first").alias("first")).select(*[F.col(f"first.{k}").alias(k) for k in key])
    return tagged.join(chosen, key, "left_semi").dropDuplicates(key).drop(*key)


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
