"""Odd input for every operator and stage, and the pipeline against plain steps."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import _base, _plain_components, _plain_simhash
from velograph.llm import QUERIES, op01_sentencepiece, op03_decontaminate, op05_classifier

GOOD = "the quick brown fox number {0} jumps over a lazy dog near river {1} while seven wise owls of county {2} watch it in calm silence and think of supper at {3} again"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def good(k):
    return GOOD.format(*(f"w{k * 7 + j}x" for j in range(4)))


def written(spark, folder, docs, labels=(), benchmark=(), pages=(), turns=(), vectors=()):
    tables = {
        "documents": (docs, DOCS + ", score string, kept int, fp string, label string, fold string, hash string, id string, no_id int, r string, h int"),
        "labels": (labels, "doc_id bigint, quality int, toxic int, text string"),
        "benchmark": (benchmark, "item_id bigint, text string, doc_id int"),
        "pages": (pages, "page_id bigint, url string, html string, host int, text string, shard string"),
        "conversations": (turns, "conv_id bigint, turn bigint, role string, text string, ids string, mask int"),
        "embeddings": (vectors, "vec_id bigint, embedding array<float>, label int, code string, error int, coded string, k0 int, own int, x string, cluster int, key string"),
    }
    for name, (rows, schema) in tables.items():
        width = schema.count(",") + 1
        spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    docs = [
        (1, good(1), "en", "s", 1),
        (1, good(1), "en", "s", 1),
        (2, None, None, None, None),
        (None, good(3), "en", None, 3),
        (None, None, None, None, None),
        (4, "", "en", "s", 0),
        (5, " \n\t ", "de", "s", 4),
        (6, "!!! ??? 123", "fr", "s", 9),
        (7, " ".join(f"word{i}" for i in range(60_000)), "en", "s", 1),
        (8, "x" * 300_000, None, "s", 1),
        (9, "日本語のテキスト🙂 " * 20, "ja", "s", 1),
        (-3, "MIT License", "en", "s", 1),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 0), (99, 0, 0), (9, 0, 0), (8, 0, 1)]
    pages = [(1, "http://a.com/x", "<p>hi"), (1, "http://a.com/x", "<p>hi"), (None, None, None), (2, "bad", ""), (3, "http://b.org", "<" * 5000 + "a" * 200_000)]
    turns = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (None, None, None, None), (2, 1, "assistant", "y" * 100_000), (3, 2, "odd", "")]
    whole = [float(k) for k in range(64)]
    vectors = [(1, whole, 1), (1, whole, 1), (2, None, 1), (None, whole[::-1], None), (3, [], 2), (4, whole[:63], 2), (5, [None, *whole[1:]], 2), (6, [float("nan"), *whole[1:]], 3), (7, [float("-inf"), *whole[1:]], 3), (8, [3e38, -3e38, *whole[2:]], 3)]
    top = written(spark, tmp_path_factory.mktemp("odd"), docs, labels, [(1, "word5 word6 word7"), (None, None), (2, ""), (None, "quick brown fox")], pages, turns, vectors)
    # Bytes that are no UTF-8, in every table.
    for name, columns in {"documents": "10L AS doc_id, {} AS text, {} AS lang", "benchmark": "9L AS item_id, {} AS text", "pages": "10L AS page_id, {} AS url, {} AS html", "conversations": "10L AS conv_id, 1L AS turn, {} AS role, {} AS text"}.items():
        bad = "CAST(X'" + b"broken ".hex() + "FF" + b"://text/ of ".hex() + "C3" + b" some words".hex() + "' AS STRING)"
        have = spark.read.parquet(f"{top}/{name}.parquet")
        more = spark.sql("SELECT " + columns.format(bad, bad))
        have.limit(0).unionByName(more, allowMissingColumns=True).write.mode("append").parquet(f"{top}/{name}.parquet")
    return top


ROWS = {"op1_sentencepiece": None, "op6_url_filters": 6, "op7_chat_formatting": 6, "op9_html_extraction": 6, "op11_vector_codes": 4, "op12_centroid_clusters": 4}


@pytest.mark.parametrize("name", list(QUERIES))
def test_odd_rows(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    if name == "op1_sentencepiece":
        assert all(r.round_trip for r in rows) and sum(r.sample_no == 1 for r in rows) == 13
    else:
        assert len(rows) == ROWS.get(name, 13)
    by = {r[0]: r for r in rows}
    if name == "op2_language_id":
        assert {r.lang_pred for r in rows if r.doc_id in (2, 4, 5, 6)} == {"und"} and all(r.score == 0 for r in rows if r.lang_pred == "und")
    if name == "op3_decontaminate":
        none = hashlib.sha256(b"").hexdigest()
        hits = {k: (r.n_words, r.n_hit, r.n_items, r.contaminated) for k, r in by.items()}
        assert hits[2] == hits[4] == hits[5] == (0, 0, 0, False) and hits[7] == (60_000, 3, 1, True) and hits[1][1:] == (3, 1, True) == hits[None][1:] or hits[None] == (0, 0, 0, False)
        assert hits[8] == (1, 0, 0, False) and by[2].items_sha256 == none and by[7].items_sha256 == hashlib.sha256(b"1").hexdigest() and by[1].items_sha256 == none
        assert hits[10] == (7, 7, 1, True) and sum(r.n_hit == 3 and r.doc_id is None for r in rows) == 1
    if name == "op5_quality_classifier":
        alike = [{r.score for r in rows if r.doc_id in ids} for ids in ((2, 4), (1,))]
        assert all(len(x) == 1 for x in alike) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    if name == "op6_url_filters":
        assert {(r.page_id, r.host, r.path, r.rule) for r in rows if r.page_id != 10} == {(1, "a.com", "/x", "com/"), (None, "", "", None), (2, "", "", None), (3, "b.org", "", None)} and (by[10].host, by[10].path) == ("text", by[10].path) and by[10].path.startswith("/ of ")
    if name == "op7_chat_formatting":
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert by[1].n_turns == 2 and by[1].turns_sha256 == sha("user\nhi\nuser\nhi\n") and by[None].turns_sha256 == sha("\n\n") and by[2].loss_chars == 100_000 and by[3].turns_sha256 == sha("odd\n\n")
        assert by[10].turns_sha256 == sha("broken \ufffd://text/ of \ufffd some words\n" * 2)
    if name == "op8_license_scans":
        assert by[-3].licenses == "MIT" and all(r.licenses == "" for k, r in by.items() if k != -3) and by[2].n_sentences == 0 == by[4].n_sentences and by[7].n_sentences == 1
    if name == "op9_html_extraction":
        texts = {r.page_id: r.text for r in rows}
        assert texts[None] == "" == texts[2] and texts[1] == "hi" and len(texts[3]) > 200_000 and texts[10] == "broken \ufffd://text/ of \ufffd some words" and all(r.n_chars == len(r.text) for r in rows)
    if name == "op4_simhash_dedup":
        assert {r.component_id for r in rows if r.doc_id in (2, 4, 5)} == {2} and {r.fingerprint for r in rows if r.doc_id == 4} == {"0" * 16}
    if name == "op10_quality_rules":
        assert {r.doc_id: r.kept for r in rows if r.doc_id in (1, 2, 4, 5, 9)} == {1: True, 2: False, 4: False, 5: False, 9: False}
        assert next(r for r in rows if r.doc_id == 9).base_failed


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    rows = QUERIES[name](spark, written(spark, tmp_path, [])).collect()
    assert len(rows) == (1 if name == "op7_chat_formatting" else 0)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, odd, k, tmp_path):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for given in (docs, docs.where("false")):
        out = corpus_pipeline.STAGES[k][1](spark, given, odd)
        if k < 4:
            assert out.columns == docs.columns
        out.write.mode("overwrite").parquet(str(tmp_path / "out"))
        n = spark.read.parquet(str(tmp_path / "out")).count()
        assert n <= (given.count() if k < 4 else 2 * given.count())
        if k != 1 or given is not docs:
            assert (n > 0) == (given is docs)
        else:  # of its few labels most are 0
            model = op05_classifier.fit(docs, spark.read.parquet(f"{odd}/labels.parquet"))
            want = [r for r in docs.select("doc_id", op05_classifier.score(model).alias("s")).collect() if r.s >= 0.7]
            assert n == len(want) and model.beta is not None


def test_pipeline(spark, tmp_path):
    junk = [f"a {k} b {k} " + "spam spam spam spam spam spam spam spam spam spam" for k in range(3)]
    marked = [" ".join(f"{w}{'###&&&***%%%'[j % 10 : j % 10 + 3]}" for j, w in enumerate(good(50 + k).split())) for k in range(20)]
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    texts = [good(k) for k in range(40)] + junk + marked + [good(0), good(1).upper(), f"{good(44)} {leak} end of it"]
    docs = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    labels = [(k, int(k < 40), 0) for k in range(63)]
    top = written(spark, tmp_path, docs, labels, [(1, leak)])
    out = corpus_pipeline.run(spark, top)
    assert out.columns == [c.split()[0] for c in op01_sentencepiece.SCHEMA.split(", ")]

    frame = spark.read.parquet(f"{top}/documents.parquet")
    left = {k: t for k, t in enumerate(texts) if not _base(t)[5]}
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, frame, top).collect()}
    assert kept <= set(left) and set(range(40)) <= kept
    frame = frame.where(F.col("doc_id").isin(*kept))
    model = op05_classifier.fit(frame, spark.read.parquet(f"{top}/labels.parquet"))
    scores = {k: model.score(op05_classifier.common.as_matrix([op05_classifier.statistics(texts[k].encode())], op05_classifier.N_STATS))[0] for k in kept}
    kept = sorted(k for k in kept if model.beta is None or scores[k] >= 0.7)
    parts = dict(zip(kept, _plain_components(kept, [_plain_simhash(texts[k]) for k in kept]), strict=True))
    kept = sorted(set(parts.values()))
    kept = [k for k in kept if leak not in texts[k]]
    assert sorted(r.doc_id for r in out.where("sample_no = 1").collect()) == kept
    assert set(range(40)) <= set(kept) and not {40, 41, 42, 63, 64, 65} & set(kept)
    decoded = {(r.doc_id, r.decoded) for r in op01_sentencepiece.decode(out).collect()}
    assert decoded == {(k, texts[k]) for k in kept}


def test_contaminated_documents_only(spark):
    docs = spark.createDataFrame([(1, good(1)), (2, good(2) + " one two three four")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "ONE two, three")], "item_id bigint, text string")
    assert [r.doc_id for r in docs.where(op03_decontaminate.judge(docs, items)["contaminated"]).collect()] == [2]
