"""SetSketch near-dedup against all pairs of plain sets."""

from itertools import combinations

import numpy as np
import pytest

from velograph.llm import op13_setsketch as op
from velograph.llm.op13_setsketch import Near

RNG = np.random.default_rng(11)


def _plain(docs):
    """n_shingles and the smallest doc_id reachable, by definition."""
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 4]) for i in range(max(len(w) - 3, min(len(w), 1)))})
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            up[root(i)] = root(j)
    least: dict = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [(d, len(s), least.get(root(i)), least.get(root(i)) == d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def _edited(words, n):
    words = list(words)
    for at in RNG.integers(0, len(words), n):
        words[at] = f"x{RNG.integers(1 << 30)}"
    return " ".join(words)


def _docs():
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(RNG.choice(words, RNG.integers(1, 60))) for _ in range(60)]
    passage = [str(w) for w in RNG.choice(words, 50)]
    texts += [" ".join([*passage, *(str(w) for w in RNG.choice(words, 40))]) for _ in range(60)]
    base = [str(w) for w in RNG.choice(words, 120)]
    texts += [_edited(base, n % 16) for n in range(150)]  # some are within the limit of others, some of none
    texts += [None, "", " \t\n", "one", "ONE", "one two", "a b c d", "A B  C\td", "é É", "b" * 20_000] + [texts[0]] * 30
    docs = [(int(k), t) for k, t in zip(RNG.permutation(len(texts)), texts, strict=True)]
    return [*docs, (None, texts[70]), (None, "alone with no id"), (None, None), docs[5], docs[5]]


def _key(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("how", [Near(), Near(members=8, links_rows=1), Near(shingles=900)])
def test_all_pairs(spark, how):
    docs = _docs()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS sid", "'x' AS digest", "0 AS n").repartition(7)
    got = op.near_duplicates(df, how)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = _plain(docs)
    assert 40 < sum(1 for d, _, c, _ in want if d is not None and d != c)
    want = [(d, n, c, c == d) for d, n, c, _ in want]
    assert _key(tuple(r) for r in got.collect()) == _key(want)


def test_empty(spark):
    assert op.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    rows = op.near_duplicates(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")).collect()
    assert _key(map(tuple, rows)) == _key([(1, 0, 1, True), (2, 0, 2, True)])


def _hashes(n):
    return RNG.integers(0, 1 << 64, n, dtype=np.uint64)


def test_registers_merge():
    a, b = _hashes(500), _hashes(40)
    assert (op.merge(op.registers(a), op.registers(b)) == op.registers(np.concatenate([a, b]))).all()
    assert (op.merge(op.registers(a), op.registers(a[:0])) == op.registers(a)).all()


@pytest.mark.parametrize("j", [0.0, 0.2, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("times", [1, 3])
def test_similarity_by_likelihood(j, times):
    """Pairs of sets of one size, and of sizes that differ by a factor: the mean is near, and none is far off."""
    a, b, n_a, n_b, true = [], [], [], [], []
    for _ in range(200):
        x = _hashes(300)
        shared = int(2 * 300 * j / (1 + j))
        y = np.concatenate([x[:shared], _hashes((300 - shared) if times == 1 else 900 - shared)])
        a.append(op.registers(x))
        b.append(op.registers(y))
        n_a.append(len(x))
        n_b.append(len(y))
        true.append(shared / (len(x) + len(y) - shared))
    found = op.similarity(np.array(a), np.array(b), np.array(n_a), np.array(n_b))
    assert abs(found.mean() - np.mean(true)) < 0.02 and np.abs(found - true).max() < 0.16


def test_near_pairs_share_a_band():
    """Of pairs at the limit of similarity, all meet in some band."""
    how, met = Near(), 0
    for _ in range(400):
        x = _hashes(270)
        y = np.concatenate([x[:240], _hashes(30)])  # 240 of 300
        regs = np.array([op.registers(x), op.registers(y)])
        met += any(k[0] == k[1] for k in op._bands(regs, how))
    assert met == 400


def test_linked_groups():
    """Links within a group, for lists of any sizes, with and without one large component."""
    for n, edits in ((2, 3), (40, 12), (120, 40)):
        base = np.unique(_hashes(100).view(np.int64))
        sets = []
        for _ in range(n):
            s = base.copy()
            s[RNG.integers(0, 100, RNG.integers(0, edits))] = _hashes(1).view(np.int64)[0]
            sets.append(np.unique(np.concatenate([s, _hashes(RNG.integers(0, 8)).view(np.int64)])))
        label = op.linked(np.array([len(s) for s in sets]), np.concatenate(sets))
        up = np.arange(n)
        for i, j in combinations(range(n), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[up == up[j]] = up[i]
        assert {tuple(np.flatnonzero(label == k)) for k in set(label)} == {tuple(np.flatnonzero(up == k)) for k in set(up)}


@pytest.mark.parametrize("how", [Near(bands=1, band=1), Near(bands=2, band=1, members=16, links_rows=1)])
def test_no_set_of_a_value_is_passed_over(spark, how):
    """Near sets that share a band's value are in one group, however many others the value has, and also where one of them is
    alike to the value's first and the other isn't."""
    first = _hashes(300)
    sets = [first, *(_hashes(300) for _ in range(120))]
    for k in range(40):
        a = np.concatenate([first[:205], _hashes(95)]) if k % 4 == 0 else _hashes(300)  # 205 of 395
        sets[1 + 2 * k : 1 + 2 * k] = [a]
        sets.append(np.concatenate([_hashes(30), a[30:]]))  # 270 of 330
    regs = np.array([op.registers(s) for s in sets])
    df = spark.createDataFrame([(k, len(s), bytearray(r.tobytes())) for k, (s, r) in enumerate(zip(sets, regs, strict=True))], "sid bigint, n bigint, regs binary").coalesce(1)
    label = np.arange(len(sets))
    for a, b in op.ties(df, how).collect():
        label[label == label[a]] = label[b]
    keys, met = list(op._bands(regs, how)), 0
    for i, j in combinations(range(len(sets)), 2):
        if any(k[i] == k[j] for k in keys) and 100 * len(both := np.intersect1d(sets[i], sets[j])) >= 80 * (600 - len(both)):
            met += 1
            assert label[i] == label[j]
    assert met > 20 and len(set(label)) > 60
