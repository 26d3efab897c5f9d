"""Audits before a freeze, tables of a catalogue, worklists, and equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators import audits as A
from lodestream.operators import relational as R
from lodestream.plans.registry import query
from lodestream.sources.shared import written
from lodestream.sources.tables import table

#: Customers as places and their orders as reviews; one attempt a place, some of them broken in one way or another.
_OUTCOME_SQL = "CASE id % 13 WHEN 1 THEN 'error' WHEN 2 THEN 'no_reviews_tab' WHEN 3 THEN NULL WHEN 4 THEN 'bot_detection' WHEN 5 THEN 'review_cards_unavailable' ELSE 'scraped' END"


def checkpoints(spark, d):
    """(place_id, body): JSON of each place's attempt."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("r"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id")).where("id % 10 <> 3").join(o, "id", "left")
    reviews = F.when(F.col("id") % 6 != 0, F.col("r"))
    total = F.coalesce(F.size(reviews), F.lit(0)) + F.when(F.col("id") % 29 == 0, 1).otherwise(0)
    body = F.to_json(F.struct(F.when(F.col("id") % 3 != 0, total).otherwise(F.greatest(total, F.lit(0))).alias("total_reviews"), F.expr(_OUTCOME_SQL).alias("outcome"), reviews.alias("reviews")))
    return c.select(F.col("id").alias("place_id"), F.when(F.col("id") % 17 == 0, F.substring(body, 1, 9)).otherwise(body).alias("body"))


@query(f"""WITH o AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1),
c AS (SELECT c_custkey AS id, c_custkey % 4 AS rating_count, c_custkey % 10 <> 3 AS there, CASE WHEN c_custkey % 6 <> 0 THEN coalesce(n, 0) ELSE 0 END AS n FROM customer LEFT JOIN o ON id = c_custkey WHERE c_acctbal >= 0),
k AS (SELECT *, id % 17 <> 0 AS valid, coalesce({_OUTCOME_SQL}, 'legacy') AS outcome FROM c),
i AS (SELECT 'missing_checkpoints' AS issue, id FROM k WHERE NOT there UNION ALL SELECT 'invalid_json', id FROM k WHERE there AND NOT valid
  UNION ALL SELECT 'review_count_mismatches', id FROM k WHERE there AND valid AND id % 29 = 0 UNION ALL SELECT 'retryable_outcomes', id FROM k WHERE there AND valid AND outcome IN ('error', 'bot_detection')
  UNION ALL SELECT 'scraped_with_zero_reviews', id FROM k WHERE there AND valid AND outcome = 'scraped' AND n = 0 UNION ALL SELECT 'legacy_with_zero_reviews', id FROM k WHERE there AND valid AND outcome = 'legacy' AND n = 0
  UNION ALL SELECT 'no_reviews_tab_with_known_positive_rating_count', id FROM k WHERE there AND valid AND outcome = 'no_reviews_tab' AND rating_count > 0)
SELECT issue, count(id) AS n, min(id) AS first, false AS ready FROM (VALUES {", ".join(f"('{x}')" for x in A.ISSUES)}) v(issue) LEFT JOIN i USING (issue) GROUP BY issue""")
def dm32_freeze_audit(spark, d):
    """Seven kinds of issues of places and their attempts, how many places have them and the first."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("place_id"), (F.col("c_acctbal") >= 0).alias("eligible"), (F.col("c_custkey") % 4).alias("rating_count"))
    return A.freeze_audit(c, checkpoints(spark, d))


_PROFILE_SQL = """o AS (SELECT o_custkey AS id, count(*) AS reviews FROM orders GROUP BY 1),
p AS (SELECT c_custkey AS id, n_name AS state, nullif(c_mktsegment, 'MACHINERY') AS kind, c_acctbal AS balance, coalesce(reviews, 0) AS reviews, CASE WHEN c_custkey % 3 = 0 THEN 'added' ELSE 'first' END AS cohort,
  CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) END AS repaired FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN o ON o.id = c_custkey),
q AS (SELECT *, CASE WHEN coalesce(kind, 'Other') = 'Other' THEN coalesce(repaired, 'unknown') ELSE lower(kind) END AS audited FROM p)"""


@query(f"""WITH {_PROFILE_SQL}, t AS (
  SELECT 'state' AS t, state AS k, {{'places': count(*)::DOUBLE, 'kinds': count(DISTINCT kind)::DOUBLE, 'reviews': sum(reviews)::DOUBLE, 'reviewed': count(*) FILTER (reviews > 0)::DOUBLE}} AS m FROM q GROUP BY state),
r AS (SELECT t, k, unnest(['places', 'kinds', 'reviews', 'reviewed']) AS measure, unnest([m.places, m.kinds, m.reviews, m.reviewed]) AS value FROM t
  UNION ALL SELECT 'kind', coalesce(kind, 'Unknown'), unnest(['places', 'reviews', 'balance']), unnest([count(*)::DOUBLE, sum(reviews)::DOUBLE, avg(balance)]) FROM q GROUP BY kind
  UNION ALL SELECT 'audited', audited, unnest(['places', 'share']), unnest([count(*)::DOUBLE, count(*) / (SELECT count(*) FROM q)]) FROM q GROUP BY audited
  UNION ALL SELECT 'quality', 'all', unnest(['no_kind', 'no_kind_share', 'negative', 'no_reviews', 'no_reviews_share']), unnest([count(*) FILTER (kind IS NULL)::DOUBLE, avg((kind IS NULL)::INT), count(*) FILTER (balance < 0)::DOUBLE, count(*) FILTER (reviews = 0)::DOUBLE, avg((reviews = 0)::INT)]) FROM q
  UNION ALL SELECT 'cohort', cohort, unnest(['places', 'other', 'unknown', 'other_share', 'unknown_share']), unnest([count(*)::DOUBLE, count(*) FILTER (kind IS NULL)::DOUBLE, count(*) FILTER (audited = 'unknown')::DOUBLE, avg((kind IS NULL)::INT), avg((audited = 'unknown')::INT)]) FROM q GROUP BY cohort)
SELECT t AS "table", k AS key, measure, round(value, 6) AS value FROM r""")
def dm34_catalogue_tables(spark, d):
    """Tables of places by state, kind, repaired kind, quality and cohort, all of one profile that is made once."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("reviews"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("state"))
    c = table(spark, d, "customer").join(n, "c_nationkey").withColumn("id", F.col("c_custkey")).join(o, "id", "left")
    kind, repaired = F.nullif("c_mktsegment", F.lit("MACHINERY")), F.when(F.col("id") % 2 == 0, F.lower("c_mktsegment"))
    p = c.select("id", "state", kind.alias("kind"), F.col("c_acctbal").alias("balance"), F.coalesce("reviews", F.lit(0)).alias("reviews"), F.when(F.col("id") % 3 == 0, "added").otherwise("first").alias("cohort"), repaired.alias("repaired"))
    p = written(p.withColumn("audited", F.when(F.coalesce("kind", F.lit("Other")) == "Other", F.coalesce("repaired", F.lit("unknown"))).otherwise(F.lower("kind"))))
    flag, total = (lambda c: F.avg(c.cast("int"))), F.broadcast(p.agg(F.count("*").alias("all")))

    def long(name, df, key, **measures):
        g = df.groupBy(key.alias("key")).agg(*[v.cast("double").alias(m) for m, v in measures.items()])
        return g.select(F.lit(name).alias("table"), "key", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.round(m, 6).alias("value")) for m in measures])))

    n, none, empty = F.count("*"), F.col("kind").isNull(), F.col("reviews") == 0
    unknown = F.col("audited") == "unknown"
    parts = [
        long("state", p, F.col("state"), places=n, kinds=F.count_distinct("kind"), reviews=F.sum("reviews"), reviewed=F.count_if(~empty)),
        long("kind", p, F.coalesce("kind", F.lit("Unknown")), places=n, reviews=F.sum("reviews"), balance=F.avg("balance")),
        long("audited", p.crossJoin(total), F.col("audited"), places=n, share=n / F.max("all")),
        long("quality", p, F.lit("all"), no_kind=F.count_if(none), no_kind_share=flag(none), negative=F.count_if(F.col("balance") < 0), no_reviews=F.count_if(empty), no_reviews_share=flag(empty)),
        long("cohort", p, F.col("cohort"), places=n, other=F.count_if(none), unknown=F.count_if(unknown), other_share=flag(none), unknown_share=flag(unknown)),
    ]
    return R.union_all(*parts)


@query("""WITH w AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'reuse' WHEN c_custkey % 5 = 1 THEN 'repair' ELSE 'generate' END AS action FROM customer),
s AS (SELECT 'reuse' AS action, c_custkey AS id FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'repair', c_custkey FROM customer WHERE c_custkey % 5 = 1 UNION ALL SELECT 'repair', c_custkey FROM customer WHERE c_custkey % 35 = 1),
n AS (SELECT action, id, count(*) AS n FROM s GROUP BY ALL)
SELECT coalesce(w.action, n.action) AS action, count(w.id) AS wanted, count(w.id) FILTER (n.n > 0) AS found, count(w.id) FILTER (n.n IS NULL) AS missing, count(w.id) FILTER (n.n > 1) AS repeated, count(*) FILTER (w.id IS NULL) AS unasked
FROM w FULL JOIN n ON w.id = n.id AND w.action = n.action GROUP BY 1""")
def so2_action_union(spark, d):
    """Sources by action: what is missing, there twice or not asked for."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal", "c_mktsegment")
    w = c.select("id", F.when(F.col("id") % 5 == 0, "reuse").when(F.col("id") % 5 == 1, "repair").otherwise("generate").alias("action"))
    repair = c.where("id % 5 = 1").select("id", "c_mktsegment")
    return A.action_union(w, "id", {"reuse": c.where("id % 2 = 0").select("id", "c_acctbal"), "repair": repair.unionByName(repair.where("id % 35 = 1"))})[1]


_MEAL = "(Dinner|Lunch|Brunch|Breakfast)"


@query(f"""WITH r AS (SELECT o_orderkey AS id, ['Dinner time', 'a late Lunch', 'brunch', 'Brunch, then Dinner', 'supper', NULL][o_custkey % 6 + 1] AS meta, o_orderdate FROM orders)
SELECT id, nullif(regexp_extract(meta, '{_MEAL}', 1), '') AS meal FROM r""")
def sf2_meal_class(spark, d):
    """The first meal that a text names; null where it names none."""
    o = table(spark, d, "orders")
    texts = F.array(*map(F.lit, ["Dinner time", "a late Lunch", "brunch", "Brunch, then Dinner", "supper", None]))
    meta = F.element_at(texts, (F.col("o_custkey") % 6 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), F.nullif(F.regexp_extract(meta, _MEAL, 1), F.lit("")).alias("meal"))


_ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]


@query(f"""WITH r AS (SELECT l_orderkey, l_linenumber, sha256(concat_ws('|', {", ".join(_ROW)}, l_quantity::INTEGER)) AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, min(h) AS first, count(*) AS n FROM r GROUP BY ALL""")
def sf10_row_hash(spark, d):
    """Of rows that share a key, the first by the hash of what they hold: the last tie-break, the same in any order."""
    rows = table(spark, d, "lineitem").withColumn("h", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in _ROW], F.col("l_quantity").cast("int").cast("string")), 256))
    n = rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    first = R.keep_first(rows, ["l_orderkey", "l_linenumber"], [F.col("h").asc()]).select("l_orderkey", "l_linenumber", F.col("h").alias("first"))
    return first.join(n, ["l_orderkey", "l_linenumber"])


@query("""WITH a AS (SELECT c_custkey AS id, c_custkey % 7 <> 0 AS there, c_custkey % 11 <> 0 AS readable, ['error', 'scraped', 'bot_detection'][c_custkey % 3 + 1] AS outcome,
  CASE WHEN c_custkey % 4 = 0 THEN 'OSError: Too many open files' WHEN c_custkey % 4 = 1 THEN '' END AS message, c_custkey % 5 AS day FROM customer)
SELECT id AS place_id FROM a WHERE there AND (NOT readable OR (outcome IN ('error', 'bot_detection') AND (coalesce(message, '') LIKE '%Too many open files%' OR day = 4 OR day <= 2)))""")
def flt8_retries(spark, d):
    """What is tried again: unreadable attempts, and those of two outcomes that were lost, are old enough, or have no readable time."""
    c, id_ = table(spark, d, "customer"), F.col("c_custkey")
    at = F.when(id_ % 5 == 4, "not a time").otherwise(F.concat(F.lit("2026-09-0"), (id_ % 5 + 1).cast("string"), F.lit("T00:00:00+00:00")))
    tried = c.where("c_custkey % 7 <> 0").select(id_.alias("place_id"), (id_ % 11 != 0).alias("readable"), F.element_at(F.array(*map(F.lit, ["error", "scraped", "bot_detection"])), (id_ % 3 + 1).cast("int")).alias("outcome"), F.when(id_ % 4 == 0, "OSError: Too many open files").when(id_ % 4 == 1, "").alias("message"), at.alias("at"), F.lit(1).alias("n"))
    return A.to_process(c.select(id_.alias("place_id")), tried, ["error", "bot_detection"], False, "2026-09-03T12:00:00+00:00")
