"""URL filters: rules first; then the ratio of two character models, of accepted and rejected URLs.

The URLs that a rule decides are the examples. Over host and path, in an alphabet of 36 symbols, each
model is a Markov chain of variable order: the probability of a symbol after two symbols is smoothed towards
that after one, and that towards the symbol's own share, by the number of different followers (Witten and
Bell). A URL's score is the mean log ratio of its symbols, so length doesn't count. The chains are
counted over three quarters of the examples, by hash of the host; the threshold is the score that
parts the rest best (highest hit rate less false rate, in whole numbers; of equal ones that next to 0, then the higher), 0
if they lack a kind.

All in DataFrame functions. The table of log ratios has 36^3 numbers for any corpus; it is one value of a
scalar subquery, so scoring needs no join and no shuffle.

A null URL, or one without `://`, has empty host and path, and the score of the empty URL. Repeated
rows are judged alike, and count each as examples. Without examples of both kinds the ratio is 0 everywhere and such URLs are
allowed. A URL of any length is read whole. An empty table gives none. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.llm import common

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols by code: all digits are 0, whatever else is *; ^ stands before the first, $ after the last.
SYMBOLS = _LOWER + "0./-_%~*$^"
N = len(SYMBOLS)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of its name and verdict; null where none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _symbols(host: Column, path: Column) -> Column:
    """The symbols of a URL, and $, as an array of codes."""
    plain = F.translate(F.concat(host, path), _UPPER + "123456789", _LOWER + "0" * 9)
    chars = F.split(F.concat(F.regexp_replace(plain, r"[^a-z0./\-_%~]", "*"), F.lit("$")), "")
    return F.transform(chars, lambda c: F.instr(F.lit(SYMBOLS), c) - 1)


def _grams(codes: Column) -> Column:
    """The code of each symbol together with the two before it."""
    start = N - 1
    one = F.concat(F.array(F.lit(start)), F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))))
    two = F.concat(F.array(F.lit(start)), F.slice(one, 1, F.greatest(F.size(one) - 1, F.lit(0))))
    return F.zip_with(F.zip_with(two, one, lambda a, b: a * N + b), codes, lambda ab, c: ab * N + c)


def _smoothed(counts: DataFrame) -> DataFrame:
    """counts: gram, n of one kind. The log probability of every gram."""
    held = counts.select((F.col("gram") / (N * N)).cast("int").alias("a"), (F.col("gram") / N).cast("int").alias("ab"), F.pmod("gram", F.lit(N * N)).alias("bc"), F.pmod((F.col("gram") / N).cast("int"), F.lit(N)).alias("b"), F.pmod("gram", F.lit(N)).alias("c"), "gram", "n")
    after2 = held.groupBy("ab").agg(F.sum("n").alias("n2"), F.count("*").alias("t2"))
    pairs = held.groupBy("bc", "b", "c").agg(F.sum("n").alias("n_bc"))
    after1 = pairs.groupBy("b").agg(F.sum("n_bc").alias("n1"), F.count("*").alias("t1"))
    ones = pairs.groupBy("c").agg(F.sum("n_bc").alias("n_c"))
    total = ones.select(F.sum("n_c").alias("n0")).scalar()
    grid = counts.sparkSession.range(N * N * N).select(F.col("id").cast("int").alias("gram"))
    grid = grid.select("gram", (F.col("gram") / N).cast("int").alias("ab"), F.pmod("gram", F.lit(N * N)).alias("bc"), F.pmod((F.col("gram") / N).cast("int"), F.lit(N)).alias("b"), F.pmod("gram", F.lit(N)).alias("c"))
    for table, key in ((held.select("gram", "n"), "gram"), (after2, "ab"), (pairs.select("bc", "n_bc"), "bc"), (after1, "b"), (ones, "c")):
        grid = grid.join(F.broadcast(table), key, "left")  # at most 36^3 rows each
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    p0 = (zero("n_c") + 1) / (F.coalesce(total, F.lit(0)) + N)
    p1 = (zero("n_bc") + zero("t1") * p0) / (zero("n1") + zero("t1"))
    p1 = F.when(zero("n1") > 0, p1).otherwise(p0)
    p2 = F.when(zero("n2") > 0, (zero("n") + zero("t2") * p1) / (zero("n2") + zero("t2"))).otherwise(p1)
    return grid.select("gram", F.log(p2).alias("log_p"))


def log_ratios(examples: DataFrame) -> DataFrame:
    """examples: host, path, verdict. One row: `ratios`, an array by gram of log P(allow) - log P(block)."""
    grams = examples.select("verdict", F.explode(_grams(_symbols(F.col("host"), F.col("path")))).alias("gram")).groupBy("verdict", "gram").agg(F.count("*").alias("n"))
    grams = common.cut(grams)  # 2 * 36^3 rows at most
    allow, block = (_smoothed(grams.where(F.col("verdict") == v).select("gram", "n")) for v in ("allow", "block"))
    both = grams.select(F.countDistinct("verdict").alias("kinds")).scalar()
    ratio = F.when(both == 2, allow["log_p"] - block["log_p"]).otherwise(F.lit(0.0))
    rows = allow.join(F.broadcast(block), allow["gram"] == block["gram"]).select(allow["gram"], ratio.alias("v"))
    return rows.agg(F.array_sort(F.collect_list(F.struct("gram", "v"))).alias("x")).select(F.transform("x", lambda r: r["v"]).alias("ratios"))


def score(host: Column, path: Column, ratios: Column) -> Column:
    """The mean log ratio of a URL's symbols."""
    codes = _symbols(host, path)
    start = F.struct(F.lit((N - 1) * N + N - 1).alias("last"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def step(s, c):
        gram = s["last"] * N + c
        return F.struct(F.pmod(gram, F.lit(N * N)).alias("last"), (s["sum"] + F.element_at(ratios, gram + 1)).alias("sum"), (s["n"] + 1).alias("n"))

    return F.aggregate(codes, start, step, lambda s: s["sum"] / s["n"])


def with_score(urls: DataFrame, table: DataFrame) -> DataFrame:
    """urls with a column `score`. Catalyst puts the subquery's value in place of the column used once, so no
    row carries the table."""
    return urls.withColumn("ratios", table.scalar()).withColumn("score", score(F.col("host"), F.col("path"), F.col("ratios"))).drop("ratios")


def threshold(scored: DataFrame, bins: int = 400, reach: float = 2.0) -> DataFrame:
    """scored: score, verdict. One row, one value: the bin edge that parts allow from block best."""
    at = F.least(F.greatest(F.floor((F.col("score") + reach) / (2 * reach) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    held = scored.groupBy(at.alias("bin")).agg(F.sum((F.col("verdict") == "allow").cast("long")).alias("good"), F.sum((F.col("verdict") == "block").cast("long")).alias("bad"))
    # One row of `bins` pairs: an array, as wide for any corpus.
    row = held.agg(F.array_sort(F.collect_list(F.struct("bin", "good", "bad"))).alias("h"), F.sum("good").alias("goods"), F.sum("bad").alias("bads"))
    whole = lambda x: x.cast("decimal(38,0)")
    edges = F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        lambda b: F.struct(
            # In whole numbers, so that equal gains are equal.
            F.aggregate(F.filter("h", lambda x: x["bin"] >= b), whole(F.lit(0)), lambda s, x: whole(s + whole(x["good"]) * whole(F.col("bads")) - whole(x["bad"]) * whole(F.col("goods")))).alias("gain"),
            (-F.abs(b - bins // 2)).alias("near"),
            (b / bins * (2 * reach) - reach).alias("edge"),
        ),
    )
    return row.select(F.when((F.col("goods") > 0) & (F.col("bads") > 0), F.array_max(edges)["edge"]).otherwise(F.lit(0.0)).alias("edge"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score, threshold of each row of pages (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    parted = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = parted.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    examples = ruled.where(F.col("r").isNotNull()).select("host", "path", F.col("r.verdict").alias("verdict"), (F.md5(F.col("host").cast("binary")) < "4").alias("calibrates"))
    table = common.cut(log_ratios(examples.where(~F.col("calibrates"))))
    tried = with_score(examples.where("calibrates"), table)
    edge = common.cut(threshold(tried)).scalar()
    scored = with_score(ruled, table).withColumn("threshold", F.coalesce(edge, F.lit(0.0)))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "score", "threshold")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _oracle(bins: int = 400, reach: float = 2.0) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    fits = lambda r: f"(host = {q(r.host)} OR ends_with(host, {q('.' + r.host)})) AND starts_with(path, {q(r.path)})"
    longest = sorted(RULES, key=lambda r: (len(r.name), r.name), reverse=True)
    named, judged = (" ".join(f"WHEN {fits(r)} THEN {q(getattr(r, x))}" for r in longest) for x in ("name", "verdict"))
    return f"""
WITH p AS (SELECT row_number() OVER () AS row, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT row, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {q(_UPPER)}, {q(_LOWER)}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT *, CASE {named} END AS rule, CASE {judged} END AS told, md5(host) < '4' AS calibrates FROM h),
c AS (SELECT row, list_transform(string_split(regexp_replace(translate(host || path, {q(_UPPER + "123456789")}, {q(_LOWER + "0" * 9)}), '[^a-z0./\\-_%~]', '*', 'g') || '$', ''), lambda x: strpos({q(SYMBOLS)}, x) - 1) AS codes FROM r),
g AS (SELECT row, CASE WHEN i > 2 THEN codes[i - 2] ELSE {N - 1} END AS a, CASE WHEN i > 1 THEN codes[i - 1] ELSE {N - 1} END AS b, codes[i] AS c FROM c, unnest(range(1, len(codes) + 1)) AS t(i)),
n AS (SELECT told, a, b, c, count(*) AS n FROM g JOIN r USING (row) WHERE told IS NOT NULL AND NOT calibrates GROUP BY told, a, b, c),
n2 AS (SELECT told, a, b, sum(n) AS n, count(*) AS t FROM n GROUP BY told, a, b),
bc AS (SELECT told, b, c, sum(n) AS n FROM n GROUP BY told, b, c),
n1 AS (SELECT told, b, sum(n) AS n, count(*) AS t FROM bc GROUP BY told, b),
o AS (SELECT told, c, sum(n) AS n FROM bc GROUP BY told, c),
z AS (SELECT told, sum(n) AS n FROM o GROUP BY told),
grid AS (SELECT told, a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c FROM (VALUES ('allow'), ('block')) AS t(told), range(0, {N}) AS x(a), range(0, {N}) AS y(b), range(0, {N}) AS w(c)),
p0 AS (SELECT grid.*, (coalesce(o.n, 0) + 1)::DOUBLE / (coalesce(z.n, 0) + {N}) AS p0 FROM grid LEFT JOIN o USING (told, c) LEFT JOIN z USING (told)),
p1 AS (SELECT p0.*, CASE WHEN n1.n > 0 THEN (coalesce(bc.n, 0) + n1.t * p0) / (n1.n + n1.t) ELSE p0 END AS p1 FROM p0 LEFT JOIN bc USING (told, b, c) LEFT JOIN n1 USING (told, b)),
p2 AS (SELECT p1.*, CASE WHEN n2.n > 0 THEN (coalesce(n.n, 0) + n2.t * p1) / (n2.n + n2.t) ELSE p1 END AS p2 FROM p1 LEFT JOIN n USING (told, a, b, c) LEFT JOIN n2 USING (told, a, b)),
v AS (SELECT x.a, x.b, x.c, CASE WHEN (SELECT count(DISTINCT told) FROM n) = 2 THEN ln(x.p2) - ln(y.p2) ELSE 0 END AS v FROM p2 x JOIN p2 y USING (a, b, c) WHERE x.told = 'allow' AND y.told = 'block'),
s AS (SELECT row, sum(v) / count(*) AS score FROM g JOIN v USING (a, b, c) GROUP BY row),
hist AS (SELECT least(greatest(floor((score + {reach}) / {2 * reach} * {bins}), 0), {bins - 1})::INT AS bin, count(*) FILTER (told = 'allow') AS good, count(*) FILTER (told = 'block') AS bad FROM s JOIN r USING (row) WHERE told IS NOT NULL AND calibrates GROUP BY 1),
e AS (SELECT e AS b, (SELECT coalesce(sum(good), 0) FROM hist WHERE bin >= e) * (SELECT sum(bad) FROM hist) - (SELECT coalesce(sum(bad), 0) FROM hist WHERE bin >= e) * (SELECT sum(good) FROM hist) AS gain FROM range(0, {bins}) AS t(e)),
edge AS (SELECT CASE WHEN (SELECT sum(good) > 0 AND sum(bad) > 0 FROM hist) THEN (SELECT b::DOUBLE / {bins} * {2 * reach} - {reach} FROM e ORDER BY gain DESC, abs(b - {bins // 2}), b DESC LIMIT 1) ELSE 0 END AS edge)
SELECT page_id, host, path, rule, coalesce(told, CASE WHEN score >= edge THEN 'allow' ELSE 'block' END) AS verdict FROM r JOIN s USING (row), edge
"""


ORACLE_SQL = _oracle()
