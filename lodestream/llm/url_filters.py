r"""URL filter: host and path rules, and for what no rule fits the ratio of two character language models.

The models are variable-order Markov chains over the characters of accepted and of rejected URLs: those that a rule
allows and those that one blocks. A character's probability after up to ORDER - 1 others is its count there plus SMOOTH
times its probability after one less, over the context's count plus SMOOTH; a context seen fewer than SEEN times by both
models together is passed over for the next shorter one. URLs are lower-cased (A-Z), other characters than KEPT become
``*``, and marks stand before and after, so there are at most (len(KEPT) + 3) ** ORDER grams, whatever the input's size.

A URL's score is the mean over its characters of the difference of log-probabilities, in millionths. A quarter of the
distinct labelled URLs, by their crc32, is kept from the models; on it the threshold is chosen, in steps of STEP, that
makes the mean of the two error rates least (ties: nearest to 0, then lower). With only one kind of URL there it is 0.

Each distinct URL counts once, so copies weigh nothing and meet in a partial aggregation. Values are whole numbers, so
sums agree in any order. All of it is DataFrame functions; the tables of grams are joined, and Spark broadcasts one only
where its measured size allows. Null URLs and those without ``://`` have an empty host and path, fit no rule, and are
judged by the models: a null as an empty text. Repeated rows and null page_ids are judged alike. An empty table gives no
rows. Other columns are kept; those that clash with the ones added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.llm.common import cut

#: (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
ORDER, SMOOTH, SEEN = 4, 2.0, 3
STEP, FAR = 10_000, 2000
KEPT = "abcdefghijklmnopqrstuvwxyz0123456789/.-_?=&%:#~+,;@!"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OTHER = r"[^a-z0-9/.\-_?=&%:#~+,;@!]"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages with ``host``, ``path``, ``rule`` and its ``verdict``: of the rules that fit, the longest (ties: the last in order of text)."""
    host, path = host_and_path(F.col("url"))
    pages = pages.drop("host", "path", "rule", "verdict", "score").withColumns({"host": host, "path": path})
    fits = lambda h, p: ((F.col("host") == h) | F.endswith(F.col("host"), F.lit(f".{h}"))) & F.startswith(F.col("path"), F.lit(p))
    found = [F.when(fits(h, p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    best = F.array_max(F.array(*found)) if found else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    return pages.withColumn("_best", best).withColumns({"rule": F.col("_best.rule"), "verdict": F.col("_best.verdict")}).drop("_best")


def folded(url: Column) -> Column:
    return F.regexp_replace(F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER), _OTHER, "*")


def grams(text: Column) -> Column:
    """The runs of ORDER characters of a text between its marks: one that ends in each character, and one in the end mark."""
    marked = F.split(F.concat(F.lit("^" * (ORDER - 1)), text, F.lit("$")), "")
    marked = F.filter(marked, lambda c: c != "")
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.array_join(F.slice(marked, i, F.lit(ORDER)), ""))


def gram_values(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, v): for each wanted gram the difference of log-probabilities of its last character after the others, in millionths.

    counts (g, a, b) has what accepted and rejected URLs have; shorter grams and contexts are summed up from it.
    """
    found, p = wanted, {k: F.lit(1.0 / (len(KEPT) + 2)) for k in "ab"}
    for n in range(1, ORDER + 1):
        sums = counts.groupBy(F.right("g", F.lit(n)).alias(f"g{n}")).agg(F.sum("a").alias(f"a{n}"), F.sum("b").alias(f"b{n}"))
        context = sums.groupBy(F.left(f"g{n}", F.lit(n - 1)).alias(f"c{n}")).agg(F.sum(f"a{n}").alias(f"ca{n}"), F.sum(f"b{n}").alias(f"cb{n}"))
        found = found.withColumns({f"g{n}": F.right("g", F.lit(n)), f"c{n}": F.substring("g", ORDER + 1 - n, n - 1)})
        found = found.join(sums, f"g{n}", "left").join(context, f"c{n}", "left")
        known = F.coalesce(F.col(f"ca{n}") + F.col(f"cb{n}"), F.lit(0)) >= SEEN
        of = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
        found = found.withColumns({f"p{k}{n}": F.when(known, (of(f"{k}{n}") + SMOOTH * p[k]) / (of(f"c{k}{n}") + SMOOTH)).otherwise(p[k]) for k in "ab"})
        p = {k: F.col(f"p{k}{n}") for k in "ab"}
    return found.select("g", F.floor(1e6 * (F.log(p["a"]) - F.log(p["b"])) + 0.5).alias("v"))


def threshold(held: DataFrame) -> DataFrame:
    """One row, ``least``: the lowest step that is accepted, of held (score, a, b); a and b mark accepted and rejected URLs."""
    step = F.least(F.greatest(F.floor(F.col("score") / STEP), F.lit(-FAR)), F.lit(FAR))
    bins = held.groupBy(step.alias("step")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    bins = bins.unionByName(bins.agg((F.max("step") + 1).alias("step"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")).where("step IS NOT NULL"))
    # A row for each step, 2 * FAR + 2 of them at most.
    below, every = W.orderBy("step").rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    lost, passed = F.coalesce(F.sum("a").over(below), F.lit(0)), F.sum("b").over(every) - F.coalesce(F.sum("b").over(below), F.lit(0))
    both = (F.sum("a").over(every) > 0) & (F.sum("b").over(every) > 0)
    scored = bins.select("step", both.alias("both"), (lost * F.sum("b").over(every) + passed * F.sum("a").over(every)).alias("cost"))
    best = scored.agg(F.min(F.when(F.col("both"), F.struct("cost", F.abs("step").alias("far"), "step"))).alias("x"))
    return best.select(F.coalesce("x.step", F.lit(0)).alias("least"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages with host, path, rule, verdict and ``score``, the mean log-likelihood difference (null where a rule decides)."""
    every = ruled(pages, rules).withColumn("_url", folded(F.col("url")))
    sign = lambda v: F.max((F.col("verdict") == v).cast("bigint"))
    urls = every.groupBy(F.col("_url").alias("url")).agg(F.coalesce(sign("allow"), F.lit(0)).alias("a"), F.coalesce(sign("block"), F.lit(0)).alias("b"), F.bool_or(F.col("rule").isNull()).alias("open"))
    urls = cut(urls.withColumn("held", F.crc32(F.col("url").cast("binary")) % 4 == 0))
    some = F.col("a") + F.col("b") > 0
    counts = cut(urls.where(some & ~F.col("held")).select(F.explode(grams(F.col("url"))).alias("g"), "a", "b").groupBy("g").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    scored = urls.where(F.col("open") | (some & F.col("held"))).select("url", F.explode(grams(F.col("url"))).alias("g"))
    values = cut(gram_values(counts, scored.select("g").distinct()))
    scores = cut(scored.join(values, "g").groupBy("url").agg(F.floor(F.sum("v") / F.count("*")).alias("score")))
    least = threshold(urls.where(some & F.col("held")).join(scores, "url").select("score", "a", "b"))
    out = every.join(scores.withColumnRenamed("url", "_url"), "_url", "left").crossJoin(F.broadcast(least))
    own = F.when(F.floor(F.col("score") / STEP) >= F.col("least"), "allow").otherwise("block")
    return out.withColumns({"verdict": F.coalesce("verdict", own), "score": F.when(F.col("rule").isNull(), F.col("score"))}).drop("_url", "least")


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")


def _values_sql() -> str:
    """The gram tables and values of the query, order by order."""
    sums = "".join(
        f", s{n} AS (SELECT right(g, {n}) AS g{n}, sum(a) AS a{n}, sum(b) AS b{n} FROM counts GROUP BY 1), m{n} AS (SELECT left(g{n}, {n - 1}) AS c{n}, sum(a{n}) AS ca{n}, sum(b{n}) AS cb{n} FROM s{n} GROUP BY 1)"
        for n in range(1, ORDER + 1)
    )
    steps, last = "", f"(SELECT DISTINCT g, {1 / (len(KEPT) + 2)!r}::DOUBLE AS pa0, {1 / (len(KEPT) + 2)!r}::DOUBLE AS pb0 FROM scored)"
    for n in range(1, ORDER + 1):
        p = ", ".join(f"CASE WHEN coalesce(ca{n} + cb{n}, 0) >= {SEEN} THEN (coalesce({k}{n}, 0)::DOUBLE + {SMOOTH}::DOUBLE * p{k}{n - 1}) / (coalesce(c{k}{n}, 0)::DOUBLE + {SMOOTH}::DOUBLE) ELSE p{k}{n - 1} END AS p{k}{n}" for k in "ab")
        steps += f", v{n} AS (SELECT g, {p} FROM {last} LEFT JOIN s{n} ON g{n} = right(g, {n}) LEFT JOIN m{n} ON c{n} = substring(g, {ORDER + 1 - n}, {n - 1}))"
        last = f"v{n}"
    return sums + steps + f", vs AS (SELECT g, floor(1e6::DOUBLE * (ln(pa{ORDER}) - ln(pb{ORDER})) + 0.5::DOUBLE)::BIGINT AS v FROM {last})"


def _rules_sql() -> str:
    """A row for each rule."""
    return ", ".join(f"({len(h + p)}, '{h + p}', '{v}', '{h}', '{p}')" for v, h, p in RULES)


def _crc_sql(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


SQL = f"""WITH RECURSIVE bits AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
rules(n, rule, verdict, h, p) AS (VALUES {_rules_sql()}),
rest AS (SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substring(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
hosts AS (SELECT *, regexp_extract(r, '^[^/?#]*') AS raw FROM rest),
parts AS (SELECT page_id, url, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substring(r, length(raw) + 1), '^[^?#]*') AS path,
  regexp_replace(translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}'), '{_OTHER}', '*', 'g') AS u FROM hosts),
ruled AS MATERIALIZED (SELECT *, (SELECT max({{'n': n, 'rule': rule, 'verdict': verdict}}) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best FROM parts),
urls AS MATERIALIZED (SELECT u, coalesce(max((best.verdict = 'allow')::INT), 0) AS a, coalesce(max((best.verdict = 'block')::INT), 0) AS b, bool_or(best IS NULL) AS open FROM ruled GROUP BY u),
kept AS MATERIALIZED (SELECT u, a, b, open, {_crc_sql("u")} % 4 = 0 AS held FROM urls, tab),
grams AS (SELECT u, a, b, open, held, substring('{"^" * (ORDER - 1)}' || u || '$', unnest(range(1, length(u) + 2)), {ORDER}) AS g FROM kept),
counts AS MATERIALIZED (SELECT g, sum(a) AS a, sum(b) AS b FROM grams WHERE a + b > 0 AND NOT held GROUP BY g),
scored AS MATERIALIZED (SELECT u, g FROM grams WHERE open OR (a + b > 0 AND held)){_values_sql()},
scores AS MATERIALIZED (SELECT u, floor(sum(v)::DOUBLE / count(*))::BIGINT AS score FROM scored JOIN vs USING (g) GROUP BY u),
bins AS (SELECT least(greatest(floor(score::DOUBLE / {STEP})::BIGINT, -{FAR}), {FAR}) AS step, sum(a) AS a, sum(b) AS b FROM kept JOIN scores USING (u) WHERE a + b > 0 AND held GROUP BY 1),
more AS (SELECT * FROM bins UNION ALL SELECT max(step) + 1, 0, 0 FROM bins HAVING max(step) IS NOT NULL),
costs AS (SELECT step, sum(a) OVER () AS na, sum(b) OVER () AS nb, coalesce(sum(a) OVER o, 0) AS lost, coalesce(sum(b) OVER o, 0) AS stopped FROM more WINDOW o AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
best AS (SELECT coalesce(min({{'cost': lost * nb + (nb - stopped) * na, 'far': abs(step), 'step': step}}) FILTER (na > 0 AND nb > 0).step, 0) AS least FROM costs)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN floor(score::DOUBLE / {STEP}) >= least THEN 'allow' ELSE 'block' END) AS verdict,
  CASE WHEN best IS NULL THEN score END AS score FROM (SELECT ruled.*, score, (SELECT least FROM best) AS least FROM ruled LEFT JOIN scores USING (u))"""
