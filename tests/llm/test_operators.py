"""Each operator against brute force, another engine, or held-out labels."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from velograph.llm import QUERIES, op01_sentencepiece, op02_language, op03_decontaminate, op04_simhash, op05_classifier, op06_urls, op07_chat, op08_licenses, op09_html, op10_quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def same(got, want):
    columns = sorted(want.columns)
    assert set(columns) <= set(got.columns) and len(got) == len(want)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("name,sql", [("op3_decontaminate", op03_decontaminate.ORACLE_SQL), ("op6_url_filters", op06_urls.ORACLE_SQL), ("op7_chat_formatting", op07_chat.ORACLE_SQL), ("op8_license_scans", op08_licenses.ORACLE_SQL)])
def test_against_sql(spark, duck, name, sql):
    same(QUERIES[name](spark, SF).toPandas(), duck.execute(sql).df())


# --- op1 --------------------------------------------------------------------------------------------


def _segmentations(lex, text):
    """All segmentations of a short text in pieces, with their probabilities."""
    s = op01_sentencepiece.SPACE + text.replace(" ", op01_sentencepiece.SPACE)
    pieces = {b.decode().replace(" ", op01_sentencepiece.SPACE): i for i, b in enumerate(lex.bytes_of) if i >= 259}

    def walk(at):
        if at == len(s):
            yield (), 0.0
        for end in range(at + 1, len(s) + 1):
            if s[at:end] in pieces:
                for rest, log in walk(end):
                    yield (pieces[s[at:end]], *rest), log + float(lex.weight[pieces[s[at:end]]])

    found = dict(walk(0))
    total = sum(math.exp(v) for v in found.values())
    return {k: math.exp(v) / total for k, v in found.items()}


def test_samples_without_replacement():
    how = op01_sentencepiece.Sampling(k=3)
    lex = op01_sentencepiece.load(how=how)
    p = _segmentations(lex, "the on")
    n = 6000
    x = op01_sentencepiece.encode_batch([b"the on"] * n, np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), lex, how)
    ends = np.cumsum(x["n_tokens"])
    drawn = [{} for _ in range(n)]
    for row, k, a, b, log in zip(x["row"], x["sample_no"], ends - x["n_tokens"], ends, x["log_prob"], strict=True):
        ids = tuple(x["ids"][a:b].tolist())
        assert log == pytest.approx(math.log(p[ids]), abs=1e-6)
        drawn[row][k] = ids
    assert all(len(set(d.values())) == 3 for d in drawn)
    second = Counter()
    for a, pa_ in p.items():
        for b, pb in p.items():
            if a != b:
                second[b] += pa_ * pb / (1 - pa_)
    for k, want in ((1, p), (2, second)):
        got = Counter(d[k] for d in drawn)
        for ids in sorted(want, key=want.get)[-4:]:
            assert got[ids] / n == pytest.approx(want[ids], abs=4 * math.sqrt(want[ids] / n) + 1e-3)
    # Horvitz-Thompson with the inclusion scores: the probabilities add up to 1.
    sums = np.zeros(n)
    np.add.at(sums, x["row"], np.exp(x["log_prob"] - x["log_inclusion"]))
    assert sums.mean() == pytest.approx(1, abs=5 * sums.std() / math.sqrt(n))


def test_round_trip_and_seed(spark):
    texts = ["a  b\n c\tŻ ▁ 벨 x", "", None, " ", "\n\n", "x" * 3000, "日本語テキスト🙂", "  lead", "trail  ", " \n  \n x", "the the the"]
    docs = spark.createDataFrame([(i if i < 9 else None, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    out = op01_sentencepiece.decode(op01_sentencepiece.encode(docs)).toPandas()
    assert out.round_trip.all() and (out.log_inclusion <= 0).all()
    assert sorted(set(out[out.doc_id == 0].decoded)) == [texts[0]]
    assert out[out.doc_id == 1].n_tokens.tolist() == [0] == out[out.doc_id == 2].n_tokens.tolist()
    again = op01_sentencepiece.encode(docs.repartition(3)).toPandas()
    key = lambda d: sorted(zip(d.doc_id.fillna(-1), d.sample_no, map(tuple, d.ids), d.log_prob, d.log_inclusion, strict=True))
    assert key(out) == key(again)
    odd = op01_sentencepiece.decode(op01_sentencepiece.encode(spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text"))).collect()
    assert all(r.round_trip and r.decoded == "a\ufffdb" for r in odd)


def test_scores_are_the_same_in_every_bit(spark):
    """However a table is cut into batches: samples, their log probabilities and inclusion scores."""
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    texts = [None if t is None else t.encode() for _, t in rows]
    keys, lex, how = np.array([2 * i + 1 for i, _ in rows], np.uint64), op01_sentencepiece.load(), op01_sentencepiece.Sampling(k=3)

    def cut(size):
        out = {}
        for a in range(0, len(texts), size):
            x = op01_sentencepiece.encode_batch(texts[a : a + size], keys[a : a + size], lex, how)
            e = np.cumsum(x["n_tokens"])
            for r, k, i, j, *scores in zip(x["row"], x["sample_no"], e - x["n_tokens"], e, x["log_prob"], x["log_inclusion"], strict=True):
                out[a + int(r), int(k)] = (x["ids"][i:j].tobytes(), *map(float, scores))
        return out

    whole = cut(len(texts))
    assert whole == cut(23) == cut(1)


def test_library_agrees_on_pieces():
    """Every id of a sample is a piece of the library's vocabulary, and decodes as the library does."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=op01_sentencepiece.model_path())
    lex = op01_sentencepiece.load()
    text = "Hello wörld, this is\na test of 12 things ☃"
    x = op01_sentencepiece.encode_batch([text.encode()], np.array([7], np.uint64), lex, op01_sentencepiece.Sampling())
    assert sp.decode(x["ids"][: x["n_tokens"][0]].tolist()) == text


# --- op2, op5 ---------------------------------------------------------------------------------------


def test_language_held_out(spark, duck):
    got = QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    docs = duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").df()
    both = got.merge(docs, on="doc_id")
    assert len(got) == len(docs) and both[both.held_out & both.lang.notna()].eval("lang == lang_pred").mean() > 0.97
    assert got.score.between(0, 1).all()


def test_quality_held_out(spark):
    got = QUERIES["op5_quality_classifier"](spark, "/root/testdata/sf0.01").toPandas()
    labels = duckdb.sql("SELECT * FROM '/root/testdata/sf0.01/labels.parquet'").df()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert (held.quality == held.predicted).mean() > 0.95
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()


def _held(doc_id):
    import zlib

    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2


def test_language_by_brute_force(spark):
    """Predictions and scores of every document by plain counts of plain grams."""
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall()
    rows += [(9001, "ΣΊΓΜΑ İx ß 日本 a1b", "xx"), (9002, None, "en"), (9003, "12 !", "en"), (9004, "no label at all", None), (None, "wort ohne nummer", "de")]
    how = op02_language.Fit()
    u32 = lambda x: x & 0xFFFFFFFF
    one, two, three = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D

    def letter(c):
        return " " if not c.isalpha() else c.lower() if len(c.lower()) == 1 else c

    def grams(text):
        s = re.sub(" +", " ", "".join(letter(c) for c in f" {text or ''} "))
        out = Counter()
        for i in range(len(s)):
            a, b, c = (ord(x) for x in (s[i : i + 3] + "\0\0")[:3])
            h = u32(a * one)
            hashes = [h]
            if i + 1 < len(s):
                h = u32(u32((h ^ (h >> 15)) * two) + b)
                hashes.append(u32(h * two))
            if i + 2 < len(s):
                h = u32(u32((h ^ (h >> 13)) * three) + c)
                hashes.append(u32(h * one))
            for x in hashes:
                out[(u32((x ^ (x >> 16)) * three) >> 7) % how.buckets] += 1
        return out, sum(x != " " for x in s)

    found = [grams(t) for _, t, _ in rows]
    counts, docs = {}, Counter()
    for (i, t, x), (g, _) in zip(rows, found, strict=True):
        if x is not None and t is not None and not _held(i):
            counts.setdefault(x, Counter()).update(g)
            docs[x] += 1
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = op02_language.fit(table, how)
    assert model.langs == sorted(counts)
    got = {r.doc_id: (r.r.lang_pred, r.r.score) for r in table.select("doc_id", op02_language.predict(spark, model).alias("r")).collect()}
    totals = {x: sum(c.values()) for x, c in counts.items()}
    for (i, t, _), (g, letters) in zip(rows, found, strict=True):
        sums = {x: math.log(docs[x] / sum(docs.values())) + sum(n * math.log((c[k] + how.smooth) / (totals[x] + how.smooth * how.buckets)) for k, n in g.items()) for x, c in counts.items()}
        best = max(sorted(sums), key=sums.get)
        want = (best, 1 / sum(math.exp(v - sums[best]) for v in sums.values())) if letters else ("und", 0.0)
        assert got[i][0] == want[0] and got[i][1] == pytest.approx(want[1], abs=1e-3), (i, t)


def test_quality_scores_by_brute_force(spark):
    """Scores of every document by plain statistics, one dense system for each fold, and isotonic means by their definition."""
    top = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{top}/documents.parquet'").fetchall()
    labels = [(i, q) for i, q in duckdb.sql(f"SELECT doc_id, quality FROM '{top}/labels.parquet'").fetchall() if not _held(i)]
    how = op05_classifier.Fit()

    def stats(text):
        b = (text or "").encode()
        n, words, plain = max(len(b), 1), re.findall(rb"[^ \t\n\x0b\x0c\r]+", b), re.findall(rb"[0-9a-z\x80-\xff]+", b.lower())
        groups = (b"a-z", b"A-Z", b"0-9", b" ", b"\n", b".,;:", b"!?", b"#$%&*", rb"|<>{}\[\]_=/\\~^", rb"'\"()\-", b"\x80-\xbf", b"\xc0-\xff")
        lines = [x for x in b.split(b"\n") if re.search(rb"[^ \t\n\x0b\x0c\r]", x)]
        w, p, k = max(len(words), 1), max(len(plain), 1), max(len(lines), 1)
        again = sum(x == y for x, y in zip(plain, plain[1:], strict=False))
        share = [math.sqrt(len(re.findall(b"[" + g + b"]", b)) / n) for g in groups]
        return [*share, math.log(1 + len(words)) / 4, len(b) / w / 8, math.log(1 + len(set(plain))) / math.log(1 + p) if plain else 1.0, math.sqrt(again / p), len(set(lines)) / k, math.log(1 + w / k) / 4, len(plain) / w - 1]

    x = {i: np.array(stats(t)) for i, t in rows}
    labels = [(i, q) for i, q in labels if i in x]
    folds = {r.i: r.fold for r in spark.createDataFrame([(i,) for i, _ in labels], "i bigint").select("i", F.pmod(F.xxhash64("i"), F.lit(how.folds)).alias("fold")).collect()}
    fit_x, y = np.array([x[i] for i, _ in labels]), np.array([q for _, q in labels], float)
    mean, spread = fit_x.mean(axis=0), np.maximum(fit_x.std(axis=0), 1e-3)
    rng = np.random.default_rng(how.seed)
    omega, phase = rng.normal(0, 1 / how.width, (fit_x.shape[1], how.features)), rng.uniform(0, 2 * np.pi, how.features)

    def features(z):
        z = np.clip((z - mean) / spread, -8, 8)
        return np.append(np.cos(z @ omega + phase) * math.sqrt(2 / how.features), 1.0)

    phi = np.array([features(z) for z in fit_x])
    solve = lambda use: np.linalg.solve(phi[use].T @ phi[use] + how.ridge * np.eye(phi.shape[1]), phi[use].T @ y[use])
    fold = np.array([folds[i] for i, _ in labels])
    unseen = np.array([phi[k] @ solve(fold != fold[k]) for k in range(len(y))])
    knots = np.unique(unseen)
    means = np.full((len(knots), len(knots)), np.inf)
    for a in range(len(knots)):
        inside = [y[(unseen >= knots[a]) & (unseen <= knots[b])] for b in range(a, len(knots))]
        means[a, a:] = [v.mean() for v in inside]
    low = np.minimum.accumulate(means[:, ::-1], axis=1)[:, ::-1]  # the least mean from a to b or beyond
    values = np.array([low[: k + 1, k].max() for k in range(len(knots))])
    beta = solve(np.ones(len(y), bool))
    got = {r.doc_id: (r.held_out, r.score, r.predicted) for r in QUERIES["op5_quality_classifier"](spark, top).collect()}
    for i, z in x.items():
        want = np.interp(features(z) @ beta, knots, values)
        assert got[i][0] == _held(i) and got[i][1] == pytest.approx(want, abs=1e-6) and got[i][2] == (got[i][1] >= 0.7), i


def test_isotonic():
    x, y = np.array([1.0, 2, 3, 3, 4]), np.array([0, 1, 0, 1, 1])
    knots, values = op05_classifier.isotonic(x, y)
    assert (np.diff(values) >= 0).all() and np.interp(4, knots, values) == 1 and np.interp(1, knots, values) == 0
    assert np.interp([2, 3], knots, values) == pytest.approx([2 / 3, 2 / 3])


# --- op3 --------------------------------------------------------------------------------------------


def test_decontamination_by_brute_force(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(1, "x " + item.upper() + " y"), (2, " ".join(item.split()[1:11]) + "."), (3, " ".join(item.split()[:9])), (4, None), (5, ""), (6, "one two, ONE! two"), (1, "x " + item.upper() + " y"), (None, "é É two one two")]
    bench = [(10, item), (9, "one two"), (11, None), (12, "  !! "), (10, item), (None, "É two")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame(bench, "item_id bigint, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def brute(text):
        w, hit, ids = words(text), set(), set()
        for i, t in bench:
            own = words(t)
            size = min(10, len(own))
            for a in range(len(own) - size + 1 if size else 0):
                for q in range(len(w) - size + 1):
                    if w[q : q + size] == own[a : a + size]:
                        hit |= set(range(q, q + size))
                        ids.add("" if i is None else str(i))
        return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)

    for how in (op03_decontaminate.Windows(), op03_decontaminate.Windows(broadcast_bytes=0), op03_decontaminate.Windows(broadcast_bytes=0, lookup_rows=0, salts=2), op03_decontaminate.Windows(broadcast_bytes=0, field_bits=64), op03_decontaminate.Windows(broadcast_bytes=0, field_bits=256, lookup_rows=0)):
        clash = docs.withColumn("digest", F.lit("x")).withColumn("N_HIT", F.lit(7))
        out = op03_decontaminate.judged(clash, items, how)
        assert out.columns == [*clash.columns, "r"] and out.where("N_HIT = 7 AND digest = 'x'").count() == len(rows)
        got = out.select("doc_id", "r.*").collect()
        want = [(i, *brute(t)) for i, t in rows]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
        none = op03_decontaminate.judged(docs, items.where("false"), how).select("r.*")
        assert none.where("contaminated").count() == 0 and op03_decontaminate.judged(docs.where("false"), items, how).count() == 0


def test_decontamination_of_a_large_benchmark(spark):
    """As a shuffle join the same as by broadcast, with as many jobs for 197 items as for 8."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text")
    more = docs.where("doc_id % 5 = 0 AND length(text) < 3000").select((F.col("doc_id") + 10**6).alias("item_id"), "text")
    every = items.unionByName(more)
    table = lambda x: sorted(map(str, map(tuple, x.select("doc_id", "r.*").collect())))
    want = table(op03_decontaminate.judged(docs, every))
    assert table(op03_decontaminate.judged(docs, every, op03_decontaminate.Windows(broadcast_bytes=0, field_bits=1 << 8))) == want  # a field forced full
    assert table(op03_decontaminate.judged(docs, every, op03_decontaminate.Windows(broadcast_bytes=0))) == want and sum("True" in r for r in want) > 200
    jobs = []
    count = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    with_aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    for some in (items.limit(8), every):
        before = count()
        op03_decontaminate.judged(docs, some, op03_decontaminate.Windows(broadcast_bytes=0)).count()
        jobs.append(count() - before)
    spark.conf.set("spark.sql.adaptive.enabled", with_aqe)
    assert every.count() > 150 and jobs[0] == jobs[1]


# --- op4 --------------------------------------------------------------------------------------------


def _plain_simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _plain_components(ids, prints):
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        if x is not None:
            least[r] = min(x, least.get(r, x))
    return [least.get(find(i)) for i in range(len(prints))]


def test_simhash(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, None), (10**6, ""), (10**6 + 1, "  \n"), (5, "one"), (None, "two words"), (7, "two words")], "doc_id bigint, text string")
    rows = docs.unionByName(extra).collect()
    prints = [_plain_simhash(r.text) for r in rows]
    want = Counter((r.doc_id, p, c) for r, p, c in zip(rows, prints, _plain_components([r.doc_id for r in rows], prints), strict=True))
    for how in (op04_simhash.Near(), op04_simhash.Near(node_rows=4)):
        got = op04_simhash.near_duplicates(docs.unionByName(extra), how).collect()
        assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want


def test_links_of_clusters(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(40):
            x = b
            for bit in rng.integers(0, 64, rng.integers(1, 5)).tolist():
                x ^= 1 << bit
            prints.add(x)
    prints |= {0, 7, (1 << 64) - 1}
    prints = sorted(prints)
    want = _plain_components(prints, prints)
    fps = spark.createDataFrame([(op04_simhash._signed(p),) for p in prints], "fp bigint")
    for cap in (4096, 30, 3):
        roots = {r.fp % (1 << 64): r.root for r in op04_simhash.components(op04_simhash.links(fps, op04_simhash.Near(node_rows=cap))).collect()}
        groups = Counter()
        pairs = {}
        for p, c in zip(prints, want, strict=True):
            pairs.setdefault(c, set()).add(roots.get(p, op04_simhash._signed(p)))
            groups[c] += 1
        assert all(len(v) == 1 for v in pairs.values()) and len({next(iter(v)) for v in pairs.values()}) == len(pairs)


def test_tree_search_is_exact():
    rng = np.random.default_rng(5)
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 12, 300, dtype=np.uint64) << np.uint64(40), rng.integers(0, 1 << 62, 300, dtype=np.uint64)]))
    found = {(int(a), int(b)) for i, j in op04_simhash._pairs_within(fps, op04_simhash.Near()) for a, b in zip(i, j, strict=True)}
    assert found == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 3}


def test_components_of_a_path(spark):
    edges = spark.range(200).select((F.col("id") + 1).alias("a"), F.col("id").alias("b")).repartition(7)
    got = op04_simhash.components(edges).collect()
    assert {r.fp for r in got} == set(range(201)) and len({r.root for r in got}) == 1


def test_components_in_few_rounds(spark, monkeypatch):
    """A path whose labels rise, dealt so that no task sees two neighbours, and a star, with salted lookups: all one component each."""
    rounds = []
    looked_up = op04_simhash.common.looked_up
    monkeypatch.setattr(op04_simhash.common, "looked_up", lambda rows, table, key, *more, **named: (rounds.append(key), looked_up(rows, table, key, *more, **named))[1])
    path = spark.range(1000).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    star = spark.range(5001, 6000).select(F.col("id").alias("a"), F.lit(5000).cast("bigint").alias("b"))
    monkeypatch.setattr(op04_simhash, "_local", lambda batches: batches)
    got = op04_simhash.components(path.unionByName(star).repartition(4), op04_simhash.Near(lookup_rows=10)).collect()
    assert len(got) == 2001 and len({r.root for r in got if r.fp <= 1000}) == 1 == len({r.root for r in got if r.fp >= 5000})
    assert rounds.count("up") < 25


def test_dedup_keeps_one(spark):
    rows = [(3, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "y"), (None, "a b c d", "z"), (None, None, "p"), (None, None, "p"), (8, "other words entirely here", "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")
    got = sorted(map(str, map(tuple, op04_simhash.dedup(docs).collect())))
    assert got == sorted(map(str, [(1, "a b c d", "y"), (None, None, "p"), (8, "other words entirely here", "q")]))


# --- op6 --------------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = ["http://A.Example.COM/en/x?y=/de/", "https://www.example.com/en/1", "http://x.www.example.com/en/", "http://example.com", "http://b.net/fr/1#t", "http://b.net/de/", "ftp://com/", None, "no scheme/en/", "http://evilcom/en/", "http://u@h.net:80/es/?a", "://"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op06_urls.judge(pages).collect()}
    assert got[0] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[1][2:] == ("www.example.com/en/", "allow") == got[2][2:]
    assert got[3][:3] == ("example.com", "", None) and got[4][2:] == ("net/fr/", "block") and got[5][2] is None
    assert got[6][2:] == ("com/", "allow") and got[7][:3] == ("", "", None) == got[8][:3] and got[9][2] is None
    assert got[10][:3] == ("u@h.net:80", "/es/", None) and got[11][:2] == ("", "")
    assert all(v[3] in ("allow", "block") for v in got.values())


def test_url_verdicts_against_sql(spark, tmp_path):
    """Threshold and verdicts on ten times the URLs, on odd ones, and without examples of one kind."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(None, None), (-1, ""), (-1, "no scheme"), (-2, "://"), (-3, "http://ü.ORG/é\n🙂?x"), (-3, "http://ü.ORG/é\n🙂?x"), (-4, "http://a.org/" + "x" * 50_000)], "page_id bigint, url string")
    for k, some in enumerate((pages.unionByName(odd), pages.where("url LIKE '%.com/%'"), odd)):
        some.write.parquet(str(tmp_path / str(k) / "pages.parquet"))
        c = duckdb.connect()
        c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/{k}/pages.parquet/*.parquet'")
        want = c.execute(op06_urls.ORACLE_SQL).df()
        same(QUERIES["op6_url_filters"](spark, str(tmp_path / str(k))).toPandas(), want)
        if k == 0:
            free = want[want.rule.isna()].verdict.value_counts()
            assert free["allow"] > 100 and free["block"] > 100


def test_url_model_by_hand(spark):
    """The table of log ratios, and a URL's score, by plain arithmetic."""
    urls = [("abab.org", "/x", "allow"), ("abc.org", "/y", "allow"), ("zz.org", "/z0", "block")]
    code = {c: i for i, c in enumerate(op06_urls.SYMBOLS)}
    n = op06_urls.N

    def model(verdict):
        tri, bi, one = Counter(), Counter(), Counter()
        for h, p, v in urls:
            s = "^^" + h + p + "$"
            for a, b, c in zip(s, s[1:], s[2:], strict=False):
                if v == verdict:
                    tri[a, b, c] += 1
                    bi[b, c] += 1
                    one[c] += 1

        def log_p(a, b, c):
            p0 = (one[c] + 1) / (sum(one.values()) + n)
            n1, t1 = sum(v for k, v in bi.items() if k[0] == b), sum(k[0] == b for k in bi)
            p1 = (bi[b, c] + t1 * p0) / (n1 + t1) if n1 else p0
            n2, t2 = sum(v for k, v in tri.items() if k[:2] == (a, b)), sum(k[:2] == (a, b) for k in tri)
            return math.log((tri[a, b, c] + t2 * p1) / (n2 + t2) if n2 else p1)

        return log_p

    allow, block = model("allow"), model("block")
    examples = spark.createDataFrame(urls, "host string, path string, verdict string")
    table = op06_urls.log_ratios(examples)
    ratios = table.first().ratios
    assert len(ratios) == n**3
    for gram in ("abc", "^^a", "zzz", "x0$", "..."):
        at = (code[gram[0]] * n + code[gram[1]]) * n + code[gram[2]]
        assert ratios[at] == pytest.approx(allow(*gram) - block(*gram), abs=1e-9)
    scored = op06_urls.with_score(examples, table).collect()
    s = "^^abc.org/y$"
    assert scored[1].score == pytest.approx(sum(allow(*g) - block(*g) for g in zip(s, s[1:], s[2:], strict=False)) / (len(s) - 2), abs=1e-9)


# --- op7, op8 ---------------------------------------------------------------------------------------


def test_chat_escapes_and_reads_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "<\\s>\\\\<s>", "a\\<|turn|>\n\\", "", "<|endoftext|> <<SYS>> <s<s>>", "🙂 é\u0000x"]
    for x in nasty:
        assert op07_chat.unescape(op07_chat.escape(x)) == x
        assert not any(c in op07_chat.escape(x) for c in op07_chat.CONTROL)
    rows = [(1, 2, "assistant", nasty[3]), (1, 1, "user", nasty[0]), (None, None, None, None), (1, 3, "assistant", nasty[5]), (2, 1, "system<s>", nasty[6]), (1, 3, "assistant", nasty[5])]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    encoded = op07_chat.format_turns(turns)
    got = {r.conv_id: r for r in op07_chat.digests(op07_chat.assemble(encoded)).collect()}
    for n in (1, 2, 3):
        how = op07_chat.Template(piece_turns=n)
        assert {r.conv_id: r for r in op07_chat.digests(op07_chat.assemble(encoded, how), how).collect()} == got
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 4 and got[1].turns_sha256 == sha(f"user\n{nasty[0]}\nassistant\n{nasty[3]}\nassistant\n{nasty[5]}\nassistant\n{nasty[5]}\n")
    assert got[1].loss_sha256 == sha(nasty[3] + 2 * nasty[5]) and got[1].loss_chars == len(nasty[3] + 2 * nasty[5])
    assert got[2].turns_sha256 == sha(f"system<s>\n{nasty[6]}\n") and got[2].loss_chars == 0
    assert got[None].turns_sha256 == sha("\n\n") and op07_chat.digests(op07_chat.assemble(op07_chat.format_turns(turns.where("false")))).count() == 0
    whole = lambda turns: sum(len(op07_chat.escape(x)) for t in turns for x in t) + len("<|turn|><|text|><|end|>") * len(turns) + len("<s></s>")
    assert got[1].formatted_chars == whole([("user", nasty[0]), ("assistant", nasty[3]), ("assistant", nasty[5]), ("assistant", nasty[5])]) and got[None].formatted_chars == whole([("", "")])


def test_chat_ids_and_mask(spark):
    """A conversation's ids and mask by plain concatenation; and an id or a mask changed anywhere shows."""
    rows = [(1, 1, "user", "hi there"), (1, 2, "assistant", ""), (1, 3, "assistant", "all <s> well \\"), (2, 1, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    data = op07_chat.load()
    tok, ids = op07_chat._tokenizer(data), op07_chat.reserved(data)
    assert min(ids.values()) == max(tok.get_vocab().values()) + 1
    with pytest.raises(ValueError):
        op07_chat.reserved(data, op07_chat.Template(first_reserved=50_000))
    how = op07_chat.Template(piece_turns=2)
    pieces = sorted(op07_chat.assemble(op07_chat.format_turns(turns, how), how).collect(), key=lambda r: (r.conv_id, r.first))
    for conv in (1, 2):
        want, mask = [ids["<s>"]], [False]
        for c, _, role, text in rows:
            if c == conv:
                code = [tok.encode(op07_chat.escape(x), add_special_tokens=False).ids for x in (role, text)]
                want += [ids["<|turn|>"], *code[0], ids["<|text|>"], *code[1], ids["<|end|>"]]
                mask += [False] * (2 + len(code[0])) + [role == "assistant"] * len(code[1]) + [False]
        own = [r for r in pieces if r.conv_id == conv]
        assert [x for r in own for x in r.ids] == [*want, ids["</s>"]] and [x for r in own for x in r.mask] == [*mask, False]
        assert [r.first for r in own] == [0, *np.cumsum([len(r.ids) for r in own])[:-1].tolist()]

        def read(ids_, mask_):
            reader = op07_chat.Reader(tok, ids)
            assert reader.add(np.array(ids_, np.int32), np.array(mask_, bool))
            return reader.row()

        plain, mask = [*want, ids["</s>"]], [*mask, False]
        right = read(plain, mask)
        for k in range(len(plain)):
            other = plain.copy()
            other[k] = 70 if plain[k] != 70 else 71
            try:
                assert read(other, mask) != right, k
            except (ValueError, AssertionError) as e:
                assert plain[k] in ids.values(), e
            if plain[k] not in ids.values() and tok.decode([plain[k]]) != "\\":  # an escape without which the text is the same
                assert read(plain, [m != (i == k) for i, m in enumerate(mask)]) != right, k


def test_chat_of_bytes_that_are_no_text(spark):
    turns = spark.sql("SELECT 1L AS conv_id, 1L AS turn, CAST(X'61FF' AS STRING) AS role, CAST(X'C3' AS STRING) AS text")
    assert op07_chat.digests(op07_chat.assemble(op07_chat.format_turns(turns))).first().turns_sha256 == hashlib.sha256("a\ufffd\n\ufffd\n".encode()).hexdigest()


def test_license_sequences(spark):
    s = op08_licenses.SENTENCES
    mit = ". ".join(s[k][0] for k in ("mit-grant", "mit-notice", "mit-asis", "mit-liability")) + "."
    bsd = "\n".join(f"* {s[k][0]}." for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    rows = [(1, "Some text.\nMIT License\n" + mit), (2, bsd), (3, bsd + "\n" + s["bsd-names"][0]), (4, "Licensed under CC BY-NC 4.0."), (5, None), (6, ""), (7, s["bsd-source"][0]), (8, "licensed under the APACHE license, version 2.0! Released under the MIT License? Released under the MIT License."), (9, "the MIT License is nice")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = docs.select("doc_id", *[c.alias(k) for k, c in op08_licenses.scan(F.col("text")).items()])
    names, rest = op08_licenses.matched(F.col("sentence_ids"))
    got = {r.doc_id: (r.licenses, r.rest) for r in found.select("doc_id", names.alias("licenses"), rest.alias("rest")).collect()}
    assert got == {1: ("MIT", 0), 2: ("BSD-2-Clause", 0), 3: ("BSD-3-Clause", 0), 4: ("CC-BY-NC-4.0", 0), 5: ("", 0), 6: ("", 0), 7: ("", 1), 8: ("Apache-2.0,MIT", 0), 9: ("", 0)}


def test_license_texts_wrapped_over_lines(spark):
    import textwrap

    s = {k: v[0] for k, v in op08_licenses.SENTENCES.items()}
    mit = [s["mit-grant"] + ":", s["mit-notice"] + ".", s["mit-asis"] + ". " + s["mit-liability"] + "."]
    head = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    bsd = [head, "1. " + s["bsd-source"] + ".", "2. " + s["bsd-binary"] + "."]
    named = "3. Neither the name of Some Company, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    gpl = ["This program is free software: " + s["gpl-grant-3"] + ".", s["gpl-hope"] + "; without even the implied warranty of MERCHANTABILITY."]
    apache = [s["apache-short"] + ' (the "License"); ' + s["apache-comply"] + ". " + s["apache-copy"], "    http://www.apache.org/licenses/LICENSE-2.0"]
    texts = {
        "MIT": ["The MIT License", "Copyright (c) 2020 A", *mit],
        "BSD-2-Clause": ["Copyright 2020 B", *bsd, "THIS SOFTWARE IS PROVIDED"],
        "BSD-3-Clause": ["Copyright 2020 B", *bsd, named],
        "ISC": ["Copyright 2020 C", s["isc-grant"] + "."],
        "GPL-3.0-or-later": gpl,
        "Apache-2.0": apache,
        "MPL-2.0": [s["mpl-short"] + ". If a copy of the MPL was not distributed"],
        "GPL-3.0-only": ["GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "Copyright (C) 2007 Some Foundation <https://f.org/>", s["gnu-verbatim"] + ".", "Preamble. The licence is free.", s["terms-end"], *gpl],
        "GPL-2.0-only": ["GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", s["gnu-verbatim"] + "."],
        "LGPL-2.1-or-later": ["This library is free software; " + s["lgpl-grant-2.1"] + "."],
        "Zlib": ["Copyright (c) 2020 Z", s["zlib-asis"] + ". In no event will the authors be held liable.", s["zlib-grant"] + ":"],
    }
    full = ["Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", s["apache-terms"], "1. Definitions. Terms of use.", s["terms-end"], "APPENDIX: How to apply.", *apache]
    marks = {"": ("", "", ""), "c": ("/*\n", " * ", "\n */"), "hash": ("#!/bin/sh\n", "# ", "\nx = 1"), "slash": ("", "// ", "")}
    rows = []
    for name, parts in [*texts.items(), ("Apache-2.0", full)]:
        for kind, (top, mark, bottom) in marks.items():
            for width in (40, 72, 5000):
                for gap in ("\n", "\n\n"):
                    wrapped = gap.join("\n".join(line for y in x.split("\n") for line in textwrap.wrap(y, width)) for x in parts)
                    for end in ("\n", "\r\n"):
                        rows.append((name, f"{kind} {width}", (top + "\n".join((mark + x).rstrip() for x in wrapped.split("\n")) + bottom).replace("\n", end)))
    rows.append(("BSD-2-Clause", "numbered", "\n".join([bsd[0], "(1) " + s["bsd-source"] + ".", "(2) " + s["bsd-binary"] + "."])))
    rows.append(("", "two paragraphs", "Released under\n\nthe MIT License text"))
    rows.append(("MIT", "in a comment", "# Copyright 2020 A\n# Released under the\n# MIT License.\n# See LICENSE"))
    rows.append(("MIT,All-Rights-Reserved", "lines", "My tool\nMIT License\nAll rights\nreserved\nmore"))
    docs = spark.createDataFrame(rows, "want string, how string, text string")
    found = docs.select("want", "how", *[c.alias(k) for k, c in op08_licenses.scan(F.col("text")).items()])
    names, rest = op08_licenses.matched(F.col("sentence_ids"))
    bad = [r for r in found.select("want", "how", "sentence_ids", names.alias("got"), rest.alias("rest")).collect() if r.got != r.want or r.rest]
    assert not bad, bad[:3]


# --- op9, op10 --------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head>
<body class="single"><header><a>Site</a></header><nav><ul><li><a href="/a">Menu</a></ul></nav><!-- <p>hidden</p> --><aside>side</aside><div class="cookie-notice">We use</div>
<div id="main-col"><article><h1>Big &amp; bold</h1><p>One<b> two</b>
three<br>four &eacute;&#8217;s<p><i>Five <div class="ad-box">Buy <div>now</div></div> six<ul><li>seven</li></ul><form>Sign<input></form></article>
<section class="comments"><article class="comment"><p>Nice!</p></article></section></div><footer>&copy; me"""


def test_html_structure():
    got = op09_html.blocks(PAGE)
    assert " ".join(t for k, t in got if k == op09_html.MAIN) == "Big & bold One two three four é’s Five six seven"
    assert not {"No", "hidden", "no"} & {t for _, t in got}
    assert op09_html.blocks(None) == [] == op09_html.blocks("") and op09_html.blocks("plain  &lt;text") == [(op09_html.NEUTRAL, "plain <text")]
    assert op09_html.blocks("<nav>a<article>b") [-1] == (op09_html.MAIN, "b")
    for tag in ("iframe", "title", "textarea", "xmp", "noembed"):
        assert op09_html.blocks(f"<article>a<{tag}>b<p>c</article>d")[-1] == (op09_html.NEUTRAL, "d"), tag
    for name, kind in (("content-with-sidebar", 1), ("legal-advice", 1), ("share price", 0), ("share-price", 1), ("related-posts", 0), ("post-header", 1), ("site-footer", 0), ("no-ads", 1), ("ad-box2", 0), ("menus_top", 0)):
        assert op09_html.blocks(f"<div class='{name}'>a</div><p>other text")[0][0] == kind, name


def test_html_tags_of_any_length():
    import time

    long = "data:image/svg+xml;utf8,<svg x='1'><p class='ad'>no</p></svg>" * 200
    many = " ".join(f'data-a{k}="v{k}"' for k in range(60))
    got = op09_html.blocks(f"""<article {many}><p data-x='{{"a": "<b>"}}'>One <img alt="{long}" src=x> two</p><div {many} class="ad-box">Buy</div> it's <a title=it's href=x>three</a> a < b </article>""")
    assert [t for k, t in got if k == op09_html.MAIN] == ["One two", "it's three a < b"]
    assert op09_html.blocks('<p>a</p><b title="x>y</b> z') == [(op09_html.NEUTRAL, "a"), (op09_html.NEUTRAL, "y z")]
    assert op09_html.blocks('<a x="<b" <p>hm<i>n')[-1] == (op09_html.NEUTRAL, "hmn")
    for part in ("<a ", "<a x=\"<b\" ", "<a x='<b' y=\"", "<", "<!", "<a b=<c d='", "< =\"", "<svg ", "<p x="):
        start = time.process_time()
        op09_html.blocks(part * (400_000 // len(part)))
        assert time.process_time() - start < 5, part


def test_html_icons_and_elements_left_open():
    def main(page):
        return " ".join(t for k, t in op09_html.blocks(page) if k == op09_html.MAIN)

    assert main("<article><p>One <svg class=i /> two <math/> three</p><p>four</p></article><p>x") == "One two three four"
    assert main('<article>One <svg/> two <svg viewBox="0"><title>t</title><text>no</text><svg><text>no</text></svg><text>no</text></svg> three</article>') == "One two three"
    assert main("<article>One <svg><path><p>two</p><svg><text>no</text></svg> three</article>") == "One two three"
    assert main("<article>One <svg><foreignObject><p>no</p></foreignObject></svg> two</article>") == "One two"
    for tag in ("object", "canvas", "noscript", "template", "svg", "math"):
        assert main(f"<article>One <{tag} id=x> two <p>three</p></article>") == "One two three", tag
        assert main(f"<article>One <{tag} id=x>no <p>no</p></{tag}> two <p>three</p></article>").replace("no no", "").split()[-2:] == ["two", "three"], tag
    assert main("<article>One <noscript>no <p>no</p></noscript> two</article>") == "One two"
    assert op09_html.blocks("<p>a <canvas><b>no</b></canvas> b") == [(op09_html.NEUTRAL, "a"), (op09_html.CHROME, "no"), (op09_html.NEUTRAL, "b")]


@pytest.mark.parametrize(
    "page,want",
    [
        ('<article class="post no-sidebar"><p>story</article>', "story"),
        ('<article class="related promo" id="ad-1"><p>story</article>', "story"),
        ('<main class="has-sidebar"><p>story</main><div class="sidebar">side</div>', "story"),
        ('<div id="page" class="site has-header-image"><nav>menu</nav><article><p>story</article>end</div>', "story"),
        ('<div class="header widget"><div class="menu">menu</div><article><p>story</article></div>', "story"),
        ('<div class="sidebar"><p>side<main><p>story</main></div>', "story"),
        ('<article><header class="entry-header"><h1>Title</h1></header><div class="entry-content">story</div><div class="post-comments">no</div></article>', "Title story"),
        ('<article><header class="header"><h1>Title</h1></header><div class="promo">no</div>story</article>', "Title story"),
        ('<article>story</article><div class="related"><article>teaser</article></div><div class="comments"><article class="comment">no</article></div>', "story"),
        ('<div class="related"><article>teaser</article></div><main>story</main>', "story"),
        ('<div><p>A long story without an article element</div><div class="related"><article>teaser</article></div>', ""),
        ('<nav>menu<article class="post no-sidebar">story', "story"),
        ('<article class="notice" hidden>no</article><article>story</article>', "story"),
    ],
)
def test_html_names_around_and_inside_articles(page, want):
    assert " ".join(t for k, t in op09_html.blocks(page) if k == op09_html.MAIN) == want


def test_html_article_of_test_pages(spark, duck):
    import html

    want = {}
    for page, raw in duck.execute("SELECT page_id, html FROM pages").fetchall():
        inner = re.search(r"<article>(.*)</article>", raw, re.S)[1]
        want[page] = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))).split())
    got = QUERIES["op9_html_extraction"](spark, SF).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 300):
        t = rng.integers(0, 3, n)
        order, lcp = op09_html.suffix_array(t)
        plain = sorted(range(n), key=lambda i: t[i:].tolist())
        assert order.tolist() == plain
        for k in range(1, n):
            a, b = t[plain[k - 1] :].tolist(), t[plain[k] :].tolist()
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_repeats_by_brute_force():
    rng = np.random.default_rng(2)
    streams = [rng.integers(0, 4, rng.integers(0, 40)).tolist() for _ in range(12)]
    owner = [k // 2 for k in range(12)]
    marks, commons = op09_html.covered(streams, owner, 4, 3)
    for s, o, m, c in zip(streams, owner, marks, commons, strict=True):
        want, often = [False] * len(s), [False] * len(s)
        for i in range(len(s) - 3):
            held = [any(x[j : j + 4] == s[i : i + 4] for j in range(len(x) - 3)) for x in streams]
            if any(h and p != o for h, p in zip(held, owner, strict=True)):
                want[i : i + 4] = [True] * 4
                if sum(held) >= 3:
                    often[i : i + 4] = [True] * 4
        assert m.tolist() == want and c.tolist() == often
    assert any(m.any() for m in marks) and any(c.any() for c in commons)


def test_html_without_article(spark):
    page = "<body><div>Welcome to our great site of many things</div><p>Story {k} {w} ends.</p><div>Read all the terms and conditions right here</div></body>"
    rows = [(k, f"http://h.org/{k}", page.format(k=k, w=" ".join(f"w{k}{j}" for j in range(12)))) for k in range(5)] + [(9, None, None), (9, None, None), (None, "x", "")]
    got = op09_html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(got) == 8
    for r in got:
        if r.page_id is not None and r.page_id < 5:
            assert r.text == f"Story {r.page_id} " + " ".join(f"w{r.page_id}{j}" for j in range(12)) + " ends."
        else:
            assert r.text == "" and r.n_chars == 0


def test_html_articles_as_plain_elements(spark, duck):
    """Without its article element a page's text is found by repetition and containers."""
    rows = duckdb.sql("SELECT page_id, url, html FROM '/root/testdata/sf0.1/pages.parquet'").fetchall()
    plain = [(p, u, h.replace("<article>", "<div>").replace("</article>", "</div>")) for p, u, h in rows]
    want, got = ({r.page_id: r.text.split() for r in op09_html.extract(spark.createDataFrame(x, "page_id bigint, url string, html string")).collect()} for x in (rows, plain))
    both = sum(sum((Counter(want[k]) & Counter(got[k])).values()) for k in want)
    assert both / sum(map(len, want.values())) > 0.98 and both / sum(map(len, got.values())) > 0.98


def test_html_decided_by_repetition(spark):
    """A quotation stays, a notice goes, of a page of notices alone nothing is left; unshared text beside an article stays."""
    story = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    quote, notice, closing = "These words of a wise man are quoted by two pages", "All the terms of this service apply to you", "Write to us about this story whenever you like"
    page = lambda k: f"<div>{notice}</div><div><p>{story(k)}</p>{f'<p>{quote}</p>' if k < 1 else ''}<p>{closing}</p></div>"
    rows = [(k, f"http://h.org/{k}", page(k)) for k in range(12)] + [(20, "http://h.org/20", f"<div>{notice}</div><div>{closing}</div>")]
    rows += [(21, "http://h.org/21", f"<div>{notice}</div><article>{quote}</article><div>{story(21)}</div><div>few words</div>")]
    rows += [(k, f"http://i.org/{k}", f"<div>{notice} {k}</div><div>{story(30)}</div>") for k in (30, 31)]
    got = {r.page_id: r for r in op09_html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for k in range(12):
        assert got[k].text == story(k) + (f" {quote}" if k < 1 else ""), k
    assert got[20].text == "" and got[21].text == f"{quote} {story(21)}" and got[21].n_neutral == 1
    assert [got[k].text for k in (30, 31)] == [f"30 {story(30)}", f"31 {story(30)}"]


def test_html_repeats_over_shards(spark):
    """A shard decides as one suffix array over the whole host would."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(90):
        own = " ".join(f"w{k}x{j}" for j in range(15))
        notices = "".join(f"<div>Rare notice {n} about the terms of this service</div>" for n in range(40) if k in (n, n + 45))
        main = "<article>story</article>" if k % 9 == 0 else ""
        some = " ".join(f"t{x}" for x in rng.integers(0, 3, 14))
        rows.append((k, f"http://h.org/{k}", f"<body>{main}{notices}<div>Seen only on page {k} twice {own}</div><div>{some}</div><footer>Rare words stand in the footer {k % 30}</footer></body>"))
    rows += [(k, "http://i.org/x", f"<div>Only copies of one page have {k} these words</div>") for k in (200, 200, 200, 201)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want, got, merged = (sorted((r.page_id, r.url, r.text) for r in op09_html.extract(pages, op09_html.Boilerplate(shard_tokens=n, lookup_rows=m)).collect()) for n, m in ((10**6, 10), (120, 10), (120, 0)))
    assert merged == got == want and len(got) == 94
    assert not any("Rare notice" in t for k, _, t in got if k < 85 and 0 < k < 40) and all(f"w{k}x3" in t for k, u, t in got if k < 90 and k % 9)


def test_quality_base(spark, duck):
    got = QUERIES["op10_quality_rules"](spark, SF).collect()
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == _base(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def _base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = (text or "").split("\n")
    repeats = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeats, len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words)


@pytest.mark.parametrize("text", ["", " \n\n ", "a b c d e a b c d e\nx\nx\n \n \n", "a a a a a a a a a a a", "é ü z # | <\r\nq w", "one two\tthree\x0bfour\x0cfive"])
def test_quality_base_by_hand(text):
    n, chars, symbols, lines, repeats = op10_quality.base(text.encode())
    assert (n, chars, symbols, lines, repeats) == _base(text)[:5]


def test_js_distance():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0], [0.25, 0.25, 0.5]])
    d = op10_quality.js_distance(p, q)
    assert d[0] == 0 and d[1] == 1 and 0 < d[2] < 1


def test_quality_of_a_language_without_reference(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    other = " ".join(chr(0x3042 + k % 80) + chr(0x3042 + k // 80) + "か" for k in range(300))
    extra = spark.createDataFrame([(-1, other, "ja"), (-2, other, "en")], "doc_id bigint, text string, lang string")
    both = docs.unionByName(extra)
    got = both.select("doc_id", op10_quality.judge(both).alias("r")).where("doc_id < 0").select("doc_id", "r.*").collect()
    assert {r.doc_id: r.kept for r in got} == {-1: True, -2: False} and not any(r.base_failed for r in got)


def test_quality_parts_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = docs.select("doc_id", op10_quality.judge(docs).alias("r")).join(labels, "doc_id").select("quality", "r.base_failed", "r.kept").toPandas()
    judged = got[~got.base_failed]
    assert judged[judged.quality == 1].kept.mean() > 0.995 and judged[judged.quality == 0].kept.mean() < 0.8


def test_quality_rejects_texts_without_common_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(3)
    salad = " ".join("".join(rng.choice(list("bcdfglmnprst"), 2).tolist() + rng.choice(list("aeiou"), 2).tolist()) + "x" for _ in range(900))
    extra = spark.createDataFrame([(-1, salad, "en"), (-2, salad, None)], "doc_id bigint, text string, lang string")
    both = docs.unionByName(extra)
    got = both.select("doc_id", op10_quality.judge(both).alias("r")).select("doc_id", "r.*").toPandas().set_index("doc_id")
    model = op10_quality.references(both)
    of_word = model.limits[model.langs.index("en")][1]
    assert not got.base_failed[[-1, -2]].any() and (got.word_distance[[-1, -2]] > of_word).all() and not got.kept[[-1, -2]].any()
    assert not model.kept(0, 0.0, 0.36, 0.36) and model.kept(0, 0.0, 0.3, 0.3) and not model.kept(0, 0.0, 0.3, 0.1)
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").toPandas().doc_id
    good = got.loc[good]
    assert good[~good.base_failed].kept.all()


def _plain_kept(rows, rules):
    """kept of (text, lang) rows, by plain counts, distances and sorted lists of them."""

    def words_of(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))

    def class_of(c):
        if "a" <= c <= "z" or "A" <= c <= "Z":
            return "lower" if c >= "a" else "upper"
        if "0" <= c <= "9":
            return None
        return "space" if c in " \t\n\x0b\x0c\r" else "stop" if c in ".,;:'\"-()?" else "symbol" if c in "#*$%&|<>!@^~\\_={}[]`+/" else "beyond" if c > "\x7f" else "other"

    def js(p, q):
        keys = set(p) | set(q)
        half = lambda a, b: sum(a[k] * math.log2(a[k] / ((a[k] + b.get(k, 0)) / 2)) for k in keys if a.get(k, 0) > 0)
        return math.sqrt(max(0, min(1, (half(p, q) + half(q, p)) / 2)))

    share = lambda counts: {k: v / sum(counts.values()) for k, v in counts.items()}
    kinds = [Counter(k for c in t or "" if (k := class_of(c))) for t, _ in rows]
    tokens = [words_of(t or "") for t, _ in rows]
    langs = sorted(k for k, n in Counter(x for _, x in rows if x is not None).items() if n >= rules.min_docs)
    lists = {}
    for k in langs:
        often = Counter(w for (_, x), ws in zip(rows, tokens, strict=True) if x == k for w in ws)
        lists[k] = rules.common_words.get(k) or sorted(often, key=lambda w: (often[w], w), reverse=True)[: rules.n_common]
    known = {w for ws in lists.values() for w in ws}
    texts = [Counter(w if w in known else "" for w in ws) for ws in tokens]
    long_ = lambda i: (sum(kinds[i].values()) >= rules.class_min_chars, len(tokens[i]) >= rules.word_min_words)

    def mean(found):
        keys = {k for f in found for k in f}
        return {k: sum(f.get(k, 0) for f in found) / len(found) for k in keys} if found else None

    refs = [{k: mean([share(x[i]) for i, (_, own) in enumerate(rows) if own == k and long_(i)[kind]]) for k in langs} for kind, x in enumerate((kinds, texts))]
    far = [[{k: js(share(x[i]), r) for k, r in refs[kind].items() if r} if rows[i][0] and long_(i)[kind] else {} for i in range(len(rows))] for kind, x in enumerate((kinds, texts))]
    limits = {}
    for k in langs:
        limits[k] = []
        for kind, fence in enumerate((rules.class_fence, rules.word_fence)):
            d = sorted(int(far[kind][i][k] * 1000) for i, (_, own) in enumerate(rows) if own == k and k in far[kind][i])
            low, high = ((d[math.ceil(q * len(d)) - 1] + 1) / 1000 for q in (0.25, 0.75)) if d else (0, math.inf)
            limits[k].append(high + max(fence * (high - low), rules.least))
        if refs[1][k]:
            limits[k][1] = min(limits[k][1], rules.word_reach * js({"": 1.0}, refs[1][k]))
    out = []
    for i, (text, own) in enumerate(rows):
        by = far[1][i] or far[0][i]
        k = own if own is not None else min(by, key=by.get) if by else None
        verdict = k not in langs or all(far[kind][i].get(k, 0) <= limits[k][kind] for kind in (0, 1)) and (k not in far[1][i] or far[1][i][k] - min(far[1][i].values()) <= rules.foreign)
        out.append(verdict and not _base(text)[5])
    return out


def test_quality_kept_by_brute_force(spark):
    rows = [(k, t, x) for k, (t, x) in enumerate(duckdb.sql("SELECT text, CASE WHEN doc_id % 37 > 0 THEN lang END FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall())]
    rng = np.random.default_rng(8)
    some = ["casa", "vento", "quale", "sempre", "della", "nostro", "perso", "tempo", "lungo", "strada"]
    rows += [(2000 + k, ". ".join(" ".join(rng.choice(some, 9)).capitalize() + f" n{k}x{j}" for j in range(20)), "it") for k in range(60)]
    rows += [(3000 + k, t, "en") for k, t, x in rows if x == "de"] + [(5000, rows[0][1], "xx"), (5001, None, "en"), (5002, " ".join(f"q{j}" for j in range(300)), "it"), (5003, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.kept for r in docs.select("doc_id", op10_quality.judge(docs)["kept"].alias("kept")).collect()}
    want = dict(zip((r[0] for r in rows), _plain_kept([r[1:] for r in rows], op10_quality.Rules()), strict=True))
    assert got == want
    long_ = [k for k, t, _ in rows if 3000 <= k < 5000 and len(t.split()) > 110 and not _base(t)[5]]
    assert len(long_) > 80 and sum(got[k] for k in long_) <= 0.03 * len(long_) and not got[5002] and got[5000] == got[0]


def test_quality_of_bytes_that_are_no_text(spark):
    docs = spark.sql("SELECT CAST(X'61FF62C320E282' AS STRING) AS text, CAST(X'FF' AS STRING) AS lang")
    assert docs.select(op10_quality.judge(docs).alias("r")).first().r.word_chars == 5


def test_quality_of_another_language_with_enough_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(4)
    words = ["casa", "vento", "quale", "sempre", "della", "nostro", "perso", "tempo", "lungo", "strada"]
    rows = [(-1 - k, ". ".join(" ".join(rng.choice(words, 9)).capitalize() + f" n{k}x{j}" for j in range(20)) + ".", "it") for k in range(60)]
    junk = " ".join(f"#{k}|{{}}<>$%&*~^={k}" for k in range(300))
    extra = spark.createDataFrame([*rows, (-100, junk, "it"), (-101, junk, "en"), (-102, junk, "pt"), (-103, junk, None)], "doc_id bigint, text string, lang string")
    both = docs.unionByName(extra)
    got = both.select("doc_id", op10_quality.judge(both).alias("r")).where("doc_id < 0").select("doc_id", "r.*").toPandas().set_index("doc_id")
    assert not got.base_failed[[-100, -101, -102, -103]].any()
    assert got.kept[[-100, -101, -102, -103]].tolist() == [False, False, True, False]
    good = got.loc[list(range(-60, 0))]
    assert (good.kept == ~good.base_failed).all() and good.kept.sum() > 30 and good.word_distance.notna().all()
