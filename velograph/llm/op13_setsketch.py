"""MinHash near-dedup with SetSketch registers.

A document's set is that of its distinct shingles, as 64-bit hashes. Each register keeps, over the set, the least of
exponentially distributed hash values, as the whole number of steps of a power of `base` that it lies below 1; so registers
are bytes, those of a union are the larger ones of two (`merge`), and two sets agree in one with nearly the odds of
their similarity, whatever their sizes.

1. Documents with the same set are one row from here on, of the smallest doc_id; so copies, however many, are no group.
2. Bands of register values, each of its own choice of registers, say which sets may be near. A value's sets are tied to the
   first of them. Where they then are in more than one group still, every two of them of unlike groups whose sizes allow it are
   compared, by blocks as in 4; so any two near sets that share a value end up in one group.
3. A tie holds where the similarity estimated jointly, by the likelihood of larger, equal and smaller registers given both
   set sizes, is `tie` or more: so sets that a band put together by chance don't join groups. Held ties join sets into groups.
   Of sets that are alike by less, the work of a value grows with the square of its sets, spread over tasks.
4. Every pair of a group is decided by full sets: intersections are counted over lists of the sets by shingle; a set is passed over
   where the shingles that a near set must share one of are its alone, or where all sets left are in one component already. Groups of
   more than `members` sets or `shingles` shingles are cut into blocks, and each two blocks are a task, so memory is bounded; only a
   spanning forest of the links comes out. The work of a group of sets that are all alike but not near grows with the square of its
   sets, spread over tasks.
5. Links are joined into components by rounds of contraction.

Two sets of similarity 0.8 miss each other in all bands at odds of about 1 in 10^7; they still are in one component if others link
them. Tests compare with all pairs.

A null or empty text, or one of white space, has an empty set and is linked with nothing. A text of fewer words than a shingle's has
one of them all. component_id is the smallest doc_id reachable; null ids are passed over, and it is null where all are.
Ties don't arise: links are exact at the limit. Repeated rows come back once each, kept alike. A text of any length is one task's.
An empty table gives an empty one. Columns other than doc_id and text, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.llm import common, op04_simhash
from velograph.llm.op04_simhash import _then_none, _union


@dataclass(frozen=True)
class Near:
    words: int = 4
    percent: int = 80
    registers: int = 256
    base: float = 1.1
    rate: float = 20.0
    bands: int = 64
    band: int = 6
    """Registers of a band, seven at most."""
    tie: float = 0.5
    members: int = 1024
    shingles: int = 1 << 22
    seed: int = 42
    links_rows: int = 100_000
    """Rows of a lookup up to which it is broadcast."""


class _Words(dict):
    """Hashes of words, computed once each while there is room."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return found


def _mixed(h: np.ndarray) -> np.ndarray:
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(by)
    return h ^ (h >> np.uint64(33))


def _odd(n: int, seed: int, kind: type) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, np.iinfo(kind).max, n, dtype=kind, endpoint=True) | kind(1)


def shingles(text: bytes | None, how: Near, words: _Words) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    parts = text.lower().split() if text else []  # bytes.lower() changes A-Z alone
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    k = min(how.words, len(h))
    by = _odd(how.words + 1, how.seed, np.uint64)
    total = np.full(len(h) - k + 1, by[-1] * np.uint64(k), np.uint64)
    for j in range(k):
        total += h[j : len(h) - k + 1 + j] * by[j]
    return np.unique(_mixed(total))


def registers(hashes: np.ndarray, how: Near = Near()) -> np.ndarray:
    """A set's registers, a byte each; all 0 for no hash."""
    if not len(hashes):
        return np.zeros(how.registers, np.uint8)
    a, b = _odd(how.registers, how.seed + 1, np.uint32), _odd(how.registers, how.seed + 2, np.uint32)
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(how.registers, np.iinfo(np.uint32).max)
    for i in range(0, len(h), 64):
        np.minimum(least, (h[i : i + 64, None] * a + b).min(axis=0), out=least)
    value = -np.log1p(-(least + 0.5) / 2.0**32) / how.rate  # the least of exponential values
    return np.clip(np.floor(1 - np.log(value) / np.log(how.base)), 0, 255).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, how: Near = Near()) -> np.ndarray:
    """The likeliest Jaccard similarity of pairs of sets, from their registers (a row each) and sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u

    def odds(x):
        return -np.log1p(-x * (how.base - 1) / how.base) / np.log(how.base)

    def times_log(n, p):
        return np.where(n > 0, n * np.log(np.maximum(p, 1e-300)), 0.0)

    def likelihood(j):
        p, q = odds(np.maximum(u - v * j, 0)), odds(np.maximum(v - u * j, 0))
        return times_log(more, p) + times_log(less, q) + times_log(same, 1 - p - q)

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # concave in j
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = likelihood(x) < likelihood(y)
        lo, hi = np.where(left, x, lo), np.where(left, hi, y)
    return (lo + hi) / 2


def _byte_rows(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def prints(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """no_id, id, hash (of the text), and the set's n, digest and registers, null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(how.seed)
        for whole in batches:
            for batch in common.parts(whole, 3, 8 << 20):
                n, digests, regs = [], [], []
                for text in common.byte_texts(batch.column(3)):
                    s = shingles(text, how, words)
                    n.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    regs.append(registers(s, how).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())], names=["no_id", "id", "hash", "n", "digest", "regs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.map_arrow(docs.select(*_tags(), "text"), run, f"no_id boolean, id {kind}, hash bigint, n bigint, digest binary, regs binary")


def _tags() -> list[Column]:
    """What a row is found again by; null ids after all others."""
    return [F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")]


def _bands(regs: np.ndarray, how: Near) -> Iterator[np.ndarray]:
    """Of each band the value of every row: its registers' bytes and its number."""
    draw = np.random.default_rng(how.seed + 3)
    for k in range(how.bands):
        chosen = draw.choice(how.registers, how.band, replace=False)
        key = np.full(len(regs), k << 56, np.uint64)
        for place, r in enumerate(chosen):
            key |= regs[:, r].astype(np.uint64) << np.uint64(8 * place)
        yield key


def ties(sets: DataFrame, how: Near = Near()) -> DataFrame:
    """sets: sid, n, regs. Ties (a, b) that hold: they join any two sets that share a band's value and may be near."""

    def outward(batches):
        for batch in batches:
            if batch.num_rows:
                for key in _bands(_byte_rows(batch.column(1), how.registers), how):
                    yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "sid": batch.column(0)})

    def starred(batches):
        of, first = None, 0
        for batch in batches:
            if batch.num_rows:
                key, sid = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
                new = np.append(key[0] != of, key[1:] != key[:-1])
                a = np.append(first, sid[new])[np.cumsum(new)]
                of, first = key[-1], a[-1]
                yield pa.RecordBatch.from_pydict({"key": pa.array(key), "a": pa.array(a), "b": pa.array(sid)}).filter(pa.array(a != sid))

    values = common.map_arrow(sets.select("sid", "regs"), outward, "key bigint, sid bigint").repartition("key").sortWithinPartitions("key", "sid")
    stars = common.written(common.map_arrow(values, starred, "key bigint, a bigint, b bigint"), "stars")
    near = common.written(_held(common.written(stars.select("a", "b").distinct(), "pairs"), sets, how), "ties")
    return near.unionByName(_crossed(stars, sets, common.written(_components(near, how), "roots"), how))


def _crossed(stars: DataFrame, sets: DataFrame, roots: DataFrame, how: Near) -> DataFrame:
    """The ties (a, b) between the groups that a value's sets are still in. stars: key, a (the value's first set), b (another)."""
    root = lambda c: roots.select(F.col("sid").alias(c), F.col("root").alias(f"root_{c}"))
    rows = common.looked_up(stars, root("b"), "b", "key", how.links_rows, how="left")
    rows = common.looked_up(rows, root("a"), "a", "b", how.links_rows, how="left")
    apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    # The two sets of a value of no more were compared.
    left = rows.groupBy("key").agg(F.min("a").alias("first"), F.count("*").alias("others"), F.max(apart).alias("apart")).where("apart AND others > 1")
    left = common.cut(left.select("key", "first"))
    others = common.looked_up(stars.select("key", "b"), left.select("key"), "key", "b", how.links_rows).select("key", F.col("b").alias("sid"))
    rows = left.select("key", F.col("first").alias("sid")).unionByName(others)
    tasks = _tasks(rows.select("sid", F.col("key").alias("root"), F.lit(1).alias("n")), how)
    known = sets.join(common.small_or_all(roots, how.links_rows), "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"), "n", "regs")

    def search(batches):
        for (task, sid, root, n), regs in _by_task(batches, how):
            at = np.append(np.flatnonzero(np.append(True, task[1:] != task[:-1])), len(task))
            name, label = np.unique(root, return_inverse=True)
            node = np.arange(len(name))
            for i, j in _pairs(at, label, n, how):
                i, j = (x[node[label[i]] != node[label[j]]] for x in (i, j))
                alike = (regs[i] == regs[j]).sum(axis=1) >= how.tie * how.registers
                i, j = i[alike], j[alike]
                if len(i):
                    ok = similarity(regs[i], regs[j], n[i], n[j], how) >= how.tie
                    _union(node, label[i[ok]], label[j[ok]])
            moved = np.flatnonzero(node != np.arange(len(name)))
            yield pa.RecordBatch.from_pydict({"a": pa.array(name[moved], pa.int64()), "b": pa.array(name[node[moved]], pa.int64())})

    members = tasks.join(known, "sid").select("task", "sid", "root", "n", "regs")
    return common.map_arrow(members.repartition("task").sortWithinPartitions("task", "sid"), search, "a bigint, b bigint")


def _by_task(batches: Iterator[pa.RecordBatch], how: Near) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns and registers of batches ordered by task, each task whole."""
    held: list[pa.RecordBatch] = []
    for batch in _then_none(batches):
        if batch is not None and batch.num_rows:
            held.append(batch)
        if held and (batch is None or held[0].column(0)[0] != held[-1].column(0)[-1]):
            rows = pa.Table.from_batches(held).combine_chunks()
            task = rows.column(0).to_numpy()
            stop = len(task) if batch is None else int(np.flatnonzero(task != task[-1])[-1]) + 1  # the last task may go on
            held = rows.slice(stop).to_batches()
            rows = rows.slice(0, stop)
            yield [rows.column(k).to_numpy() for k in range(4)], _byte_rows(rows.column(4), how.registers)


def _pairs(at: np.ndarray, label: np.ndarray, n: np.ndarray, how: Near, most: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one task that differ in label and may be near by their sizes, about `most` at a time."""
    held, some = [], 0
    for start, stop in zip(at[:-1], at[1:], strict=True):
        step = max(1, most // (stop - start))
        for a in range(start, stop, step):
            i, j = np.arange(a, min(a + step, stop))[:, None], np.arange(start, stop)
            ok = (i < j) & (label[i] != label[j]) & (100 * np.minimum(n[i], n[j]) >= how.percent * np.maximum(n[i], n[j]))
            x, y = np.nonzero(ok)
            held.append((x + a, y + start))
            some += len(x)
            if some >= most:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, some = [], 0
    if some:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _held(pairs: DataFrame, sets: DataFrame, how: Near) -> DataFrame:
    """Pairs whose estimate is enough to tie them."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n_a, n_b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 4))
                ok = similarity(_byte_rows(batch.column(3), how.registers), _byte_rows(batch.column(5), how.registers), n_a, n_b, how) >= how.tie
                yield batch.select([0, 1]).filter(pa.array(ok))

    of = lambda c: sets.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}"))
    # A set may be the first of many values, and of large ones.
    firsts = of("a").join(pairs.select("a").distinct(), "a", "left_semi")
    both = common.looked_up(pairs.join(of("b"), "b"), firsts, "a", "b", how.links_rows).select("a", "b", "n_a", "regs_a", "n_b", "regs_b")
    return common.map_arrow(both, run, "a bigint, b bigint")


def linked(sizes: np.ndarray, sets: np.ndarray, how: Near = Near()) -> np.ndarray:
    """Labels of the components of sets of a group, which stand one after another: equal for sets that links join."""
    n = len(sizes)
    label = np.arange(n)
    owner = np.repeat(label, sizes)
    order = np.argsort(sets, kind="stable")
    new = np.flatnonzero(np.diff(sets[order], prepend=~sets[order[:1]]))
    count = np.diff(np.append(new, len(sets)))
    token = np.empty(len(sets), np.int64)
    token[order] = np.repeat(np.arange(len(new)), count)
    posted = owner[order]
    ends = np.cumsum(sizes)
    done = np.zeros(n, bool)
    while True:
        # Sets of the largest component need no comparison with each other.
        left = np.flatnonzero(~done & (label != np.bincount(label).argmax()))
        if not len(left):
            return label
        x = left[0]
        done[x] = True
        mine = token[ends[x] - sizes[x] : ends[x]]
        c = count[mine]
        # A near set shares one at least of any so many shingles; if the rarest are its alone, there is none.
        must = sizes[x] - (how.percent * sizes[x] + 99) // 100 + 1
        if np.partition(c, must - 1)[must - 1] == 1:
            continue
        mine, c = mine[c > 1], c[c > 1]
        at = np.repeat(new[mine] - np.cumsum(c) + c, c) + np.arange(c.sum())
        shared = np.bincount(posted[at], minlength=n)
        y = np.flatnonzero(100 * shared >= how.percent * (sizes + sizes[x] - shared))
        _union(label, np.full(len(y), x), y)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


def links(members: DataFrame, how: Near = Near()) -> DataFrame:
    """members: task, sid, shingle hashes; the spanning forests (a, b) of the links within each task."""

    def search(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in _then_none(batches):
            if batch is not None and batch.num_rows:
                sizes, flat = _flat(batch.column(2))
                held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), sizes, flat))
            last = None if batch is None else held[-1][0][-1] if held else None
            if held and (batch is None or held[0][0][0] != last):
                task, sid, sizes, flat = (np.concatenate(x) for x in zip(*held, strict=True))
                ends = np.cumsum(sizes)
                start = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
                stop = np.append(start[1:], len(task))
                if batch is not None:  # the last task may go on
                    a = start[-1]
                    held = [(task[a:], sid[a:], sizes[a:], flat[ends[a] - sizes[a] :])]
                    start, stop = start[:-1], stop[:-1]
                else:
                    held = []
                a_, b_ = [], []
                for i, j in zip(start, stop, strict=True):
                    label = linked(sizes[i:j], flat[ends[i] - sizes[i] : ends[j - 1]], how)
                    moved = np.flatnonzero(label != np.arange(j - i))
                    a_.append(sid[i + moved])
                    b_.append(sid[i + label[moved]])
                if a_:
                    yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(a_), pa.int64()), "b": pa.array(np.concatenate(b_), pa.int64())})

    return common.map_arrow(members.repartition("task").sortWithinPartitions("task", "sid"), search, "a bigint, b bigint")


def _tasks(groups: DataFrame, how: Near) -> DataFrame:
    """groups: sid, root, n. task, sid: a group, or each two of its blocks, that are compared together."""
    sums = groups.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    blocks = F.ceil(F.greatest(2 * F.col("m") / how.members, 2 * F.col("s") / how.shingles))
    sums = sums.select("root", F.when((F.col("m") <= how.members) & (F.col("s") <= how.shingles), 1).otherwise(F.greatest(blocks, F.lit(2))).cast("int").alias("blocks"))
    rows = common.looked_up(groups, common.cut(sums), "root", "sid", how.links_rows)
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("own"))
    two = F.transform(others, lambda o: F.xxhash64("root", F.least("own", o), F.greatest("own", o)))
    return rows.withColumn("own", own).select("sid", F.explode(F.when(F.col("blocks") == 1, F.array(F.xxhash64("root"))).otherwise(two)).alias("task"))


def _texts(docs: DataFrame, reps: DataFrame, how: Near) -> DataFrame:
    """reps: sid, no_id, id, hash. The shingle hashes of each one's text: sid, set."""

    def run(batches):
        words = _Words(how.seed)
        for whole in batches:
            for batch in common.parts(whole, 1, 8 << 20):
                found = [shingles(t, how, words).view(np.int64) for t in common.byte_texts(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["sid", "set"])

    # A key without nulls, the text's hash first, so that rows without ids are no hot key.
    key = lambda: F.struct(F.col("hash"), F.col("no_id"), F.coalesce("id", F.lit(0).cast(docs.schema["doc_id"].dataType)))
    rows = docs.select(*_tags(), "text").withColumn("key", key()).select("key", "text")
    found = rows.join(common.small_or_all(reps.withColumn("key", key()).select("key", "sid"), how.links_rows), "key").select("sid", "text")
    return common.map_arrow(found.dropDuplicates(["sid"]), run, "sid bigint, set array<bigint>")


def _components(edges: DataFrame, how: Near) -> DataFrame:
    """sid and root of every set that edges join to another."""
    return op04_simhash.components(edges, op04_simhash.Near(lookup_rows=how.links_rows)).select(F.col("fp").alias("sid"), "root")


def near_duplicates(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text)."""
    seen = common.written(prints(docs, how), "prints")
    first = F.min(F.struct("no_id", "id", "hash")).alias("first")
    sets = seen.where("n > 0").groupBy("digest").agg(first, F.first("n").alias("n"), F.first("regs").alias("regs"), F.count("*").alias("copies"))
    sets = common.written(sets.select(F.monotonically_increasing_id().alias("sid"), "digest", "first", "n", "regs", "copies"), "sets")
    groups = common.written(_components(ties(sets.select("sid", "n", "regs"), how), how), "groups")
    known = sets.select("sid", "n", F.col("first.no_id").alias("no_id"), F.col("first.id").alias("id"), F.col("first.hash").alias("hash"))
    reps = common.written(known.join(common.small_or_all(groups, how.links_rows), "sid"), "reps")
    members = _tasks(reps.select("sid", "root", "n"), how).join(common.written(_texts(docs, reps, how), "members"), "sid")
    roots = common.written(_components(links(members.select("task", "sid", "set"), how), how), "roots")
    # Sets that are linked, or have copies; all other documents are alone.
    tied = sets.select("sid", "digest", "copies", F.col("first.id").alias("least")).join(common.small_or_all(roots, how.links_rows), "sid", "left")
    tied = common.cut(tied.where("root IS NOT NULL OR copies > 1").withColumn("root", F.coalesce("root", "sid")))
    named = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    table = common.cut(common.looked_up(tied.select("digest", "root"), common.cut(named), "root", "digest", how.links_rows).select("digest", "component_id", F.lit(True).alias("more")))
    out = common.looked_up(seen.select(F.col("id").alias("doc_id"), "digest", "n"), table, "digest", "doc_id", how.links_rows, how="left")
    out = out.withColumn("component_id", F.when(F.col("more"), F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The same by all pairs that share a shingle.
ORACLE_SQL = r"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (SELECT r, len(w) AS k, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
s AS MATERIALIZED (SELECT DISTINCT r, x FROM (SELECT r, k, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o) AS x FROM w WINDOW o AS (PARTITION BY r ORDER BY i)) WHERE i <= greatest(k - 3, 1)),
n AS MATERIALIZED (SELECT r, count(*)::BIGINT AS n FROM s GROUP BY r),
links AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM s a JOIN s b ON a.x = b.x AND a.r <> b.r JOIN n na ON na.r = a.r JOIN n nb ON nb.r = b.r GROUP BY a.r, b.r, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (SELECT a AS r, b AS o FROM links UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.o)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, min(o.doc_id)) AS component_id, d.doc_id = least(d.doc_id, min(o.doc_id)) AS kept
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN reach ON reach.r = d.r LEFT JOIN d o ON o.r = reach.o GROUP BY d.r, d.doc_id, n.n"""
