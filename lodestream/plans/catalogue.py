"""Queries over the driver's tables, and equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.functions import expr
from lodestream.operators import relational as R
from lodestream.operators import split as S
from lodestream.plans.registry import QUERIES, SQL, query  # noqa: F401
from lodestream.sources.tables import TIES, VISITS_SQL, table, visits

SPLIT_SQL = f"""{VISITS_SQL},
once AS (SELECT * FROM visits QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC NULLS LAST, {", ".join(TIES)}) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, item_id) - 1 AS split_rank FROM once QUALIFY count(*) OVER (PARTITION BY user_id) >= 4),
split AS (SELECT *, CASE split_rank WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM ranked)"""
COORDS_SQL = "points AS (SELECT vec_id, label, embedding[1]::DOUBLE * 10 AS lat, embedding[2]::DOUBLE * 10 AS lng FROM embeddings)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", (e[0].cast("double") * 10).alias("lat"), (e[1].cast("double") * 10).alias("lng"))


@query(f"WITH {SPLIT_SQL} SELECT user_id, item_id, rating, split_rank::INTEGER AS split_rank, split FROM split")
def dm1_leave_two_out(spark, d):
    return S.leave_two_out(visits(spark, d)).select("user_id", "item_id", "rating", "split_rank", "split")


@query(f"""WITH {SPLIT_SQL} SELECT v.item_id, count(*) AS n, count(DISTINCT v.user_id) AS users, round(avg(v.rating), 6) AS mean_rating FROM visits v SEMI JOIN (SELECT * FROM split
  WHERE split = 'train') s ON v.user_id = s.user_id AND v.item_id = s.item_id GROUP BY v.item_id""")
def dm4_train_item_features(spark, d):
    # Of the visits of a pair one is the newest, so these count the users.
    train = S.with_split(visits(spark, d).select("user_id", "item_id", "ts", "rating"), ties=[]).where("split = 'train'")
    return train.groupBy("item_id").agg(F.count("*").alias("n"), F.count_if("newest").alias("users"), F.round(F.avg("rating"), 6).alias("mean_rating"))


@query(f"""WITH {VISITS_SQL}, n AS (SELECT user_id, p_type, count(*) AS n FROM visits JOIN part ON item_id = p_partkey GROUP BY ALL)
SELECT user_id, p_type, n, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS share FROM n""")
def ag8_category_share(spark, d):
    typed = visits(spark, d).join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("item_id") == F.col("p_partkey"))
    return R.share(typed, ["user_id"], "p_type").withColumn("share", F.round("share", 6))


@query(f"""WITH {VISITS_SQL}, n AS (SELECT user_id, p_type, count(*) AS n FROM visits JOIN part ON item_id = p_partkey GROUP BY ALL),
s AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM n)
SELECT user_id, round(sum(-p * ln(p + 1e-9)), 6) + 0.0 AS entropy, round(sum(-p * log2(p)), 6) + 0.0 AS entropy_bits FROM s GROUP BY user_id""")
def ag12_category_entropy(spark, d):
    p = F.col("share")
    typed = visits(spark, d).join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("item_id") == F.col("p_partkey"))
    return R.share(typed, ["user_id"], "p_type").groupBy("user_id").agg((F.round(F.sum(-p * F.log(p + 1e-9)), 6) + 0.0).alias("entropy"), (F.round(F.sum(-p * F.log2(p)), 6) + 0.0).alias("entropy_bits"))


@query(f"""WITH {VISITS_SQL} SELECT item_id, count(*) AS n, round(avg(rating), 6) AS mean, median(rating) AS median, round(coalesce(stddev_samp(rating), 0), 6) AS std, min(rating) AS low,
  max(rating) AS high, count(DISTINCT CASE WHEN rating >= 4 THEN user_id END) AS fans FROM visits GROUP BY item_id""")
def ag1_item_profile(spark, d):
    fans = F.count_distinct(F.when(F.col("rating") >= 4, F.col("user_id")))
    v = visits(spark, d)
    middle = R.quantiles(v, ["item_id"], "rating", {"median": 0.5}).drop("n")
    return middle.join(v.groupBy("item_id").agg(F.count("*").alias("n"), F.round(F.avg("rating"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("rating"), F.lit(0.0)), 6).alias("std"), F.min("rating").alias("low"), F.max("rating").alias("high"), fans.alias("fans")), "item_id")


@query(f"WITH {VISITS_SQL} SELECT user_id, {', '.join(f'round(avg(CAST(rating = {k} AS INTEGER)), 6) AS share_{k}' for k in range(1, 6))} FROM visits GROUP BY user_id")
def ag9_rating_shares(spark, d):
    return visits(spark, d).groupBy("user_id").agg(*[F.round(F.avg((F.col("rating") == k).cast("int")), 6).alias(f"share_{k}") for k in range(1, 6)])


@query(f"""WITH {VISITS_SQL}, r AS (SELECT item_id, rating, row_number() OVER (PARTITION BY item_id ORDER BY ts DESC NULLS LAST, {', '.join(TIES)}) - 1 AS x FROM visits),
s AS (SELECT item_id, count(*) AS n, sum(x) AS sx, sum(rating) AS sy, sum(x * rating) AS sxy, sum(x * x) AS sxx FROM r GROUP BY item_id)
SELECT item_id, round(CASE WHEN n >= 3 AND n * sxx - sx * sx <> 0 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx)::DOUBLE ELSE 0 END, 6) + 0.0 AS trend FROM s""")
def ag18_rating_trend(spark, d):
    order = W.partitionBy("item_id").orderBy(F.col("ts").desc_nulls_last(), *TIES)
    x, y = F.col("x").cast("long"), F.col("rating").cast("long")
    s = visits(spark, d).withColumn("x", F.row_number().over(order) - 1).groupBy("item_id").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"))
    return s.select("item_id", F.expr("round(CASE WHEN n >= 3 AND n * sxx - sx * sx <> 0 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) ELSE 0D END, 6) + 0D").alias("trend"))


@query(f"WITH {VISITS_SQL}, c AS (SELECT item_id, user_id, count(*) AS n FROM visits GROUP BY ALL) SELECT item_id, count(*) AS users, round(avg(CAST(n > 1 AS INTEGER)), 6) AS repeat_rate FROM c GROUP BY item_id")
def ag19_repeat_rate(spark, d, v=None):
    pairs = (visits(spark, d) if v is None else v).groupBy("item_id", "user_id").agg(F.count("*").alias("n"))
    return pairs.groupBy("item_id").agg(F.count("*").alias("users"), F.round(F.avg((F.col("n") > 1).cast("int")), 6).alias("repeat_rate"))


@query(f"WITH {VISITS_SQL}, m AS (SELECT item_id, avg(rating) AS mean FROM visits GROUP BY item_id) SELECT user_id, round(avg(rating - mean), 6) + 0.0 AS pickiness FROM visits JOIN m USING (item_id) GROUP BY user_id")
def ag21_pickiness(spark, d, v=None):
    v = visits(spark, d) if v is None else v
    return v.join(v.groupBy("item_id").agg(F.avg("rating").alias("mean")), "item_id").groupBy("user_id").agg((F.round(F.avg(F.col("rating") - F.col("mean")), 6) + 0.0).alias("pickiness"))


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95
  FROM lineitem GROUP BY l_returnflag""")
def ag6_quantiles(spark, d):
    q = R.quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return q.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("p05", "p50", "p95")])


@query("""WITH t AS (SELECT c_custkey, c_acctbal, min(c_acctbal) OVER () AS lo, max(c_acctbal) OVER () AS hi FROM customer)
SELECT c_custkey, round(CASE WHEN hi = lo THEN 0.5 ELSE (c_acctbal - lo) / (hi - lo) END, 6) AS scaled FROM t""")
def wn10_minmax(spark, d):
    return R.minmax(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "scaled").select("c_custkey", F.round("scaled", 6).alias("scaled"))


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 10")
def wn7_top_per_group(spark, d):
    return R.top_k(table(spark, d, "customer"), ["c_mktsegment"], [F.col("c_acctbal").desc(), F.col("c_custkey").asc()], 10).select("c_custkey", "c_mktsegment", "c_acctbal")


@query("SELECT c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY substr(sha256(c_custkey::VARCHAR), 1, 16), c_custkey) <= 5")
def tk15_hash_sample(spark, d):
    return R.hash_sample(table(spark, d, "customer"), ["c_mktsegment"], "c_custkey", 5).select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def flt3_semi(spark, d):
    rich = table(spark, d, "orders").where("o_totalprice > 200000")
    return table(spark, d, "customer").join(rich, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS spend FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def jn1_dimensions(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("spend"))


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS s FROM e)
SELECT user_id, min(t) AS start_us, count(*) AS n FROM g GROUP BY user_id, s""")
def ext_sessions(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.min(F.unix_micros("ts")).alias("start_us")).select("user_id", "start_us", "n")


@query("SELECT event_type, epoch_us(date_trunc('hour', ts)) AS hour_us, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_tumbling(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.unix_micros("w.start").alias("hour_us"), "n", "total")


@query("SELECT c_mktsegment, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderstatus)")
def ext_rollup(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.rollup("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type, value FROM events),
x AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS click_id FROM e)
SELECT event_id, click_id FROM x WHERE event_type <> 'click'""")
def ext_asof(spark, d):
    """Each other event with the user's latest click before it: one ordered pass, no range join."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    click = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)
    return table(spark, d, "events").withColumn("click_id", click).where("event_type <> 'click'").select("event_id", "click_id")


@query(f"""WITH {SPLIT_SQL}, p AS (SELECT item_id, count(*) AS n FROM split WHERE split = 'train' GROUP BY item_id),
t AS (SELECT item_id, row_number() OVER (ORDER BY n DESC, item_id) AS rank FROM p),
e AS (SELECT CASE WHEN rank <= 10 THEN rank END AS rank FROM split LEFT JOIN t USING (item_id) WHERE split = 'test')
SELECT round(avg(CAST(rank IS NOT NULL AS INTEGER)), 6) AS hit, round(avg(coalesce(1 / log2(rank + 1), 0)), 6) AS ndcg, count(*) AS users FROM e""")
def dm18_popularity_metrics(spark, d):
    """Hit@10 and NDCG@10 of ranking by popularity in train."""
    s = S.leave_two_out(visits(spark, d))
    best = s.where("split = 'train'").groupBy("item_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "item_id").limit(10)
    ranked = best.withColumn("rank", F.row_number().over(W.orderBy(F.col("n").desc(), "item_id"))).select("item_id", "rank")
    return s.where("split = 'test'").join(ranked, "item_id", "left").agg(F.round(F.avg(F.col("rank").isNotNull().cast("int")), 6).alias("hit"), F.round(F.avg(expr.ndcg(F.col("rank"))), 6).alias("ndcg"), F.count("*").alias("users"))


@query(f"WITH {SPLIT_SQL} SELECT user_id, array_to_string(list(item_id ORDER BY ts, item_id DESC), ',') AS items FROM split WHERE split = 'train' GROUP BY user_id HAVING count(*) >= 2")
def dm10_sequences(spark, d):
    """A user's items from old to new."""
    rows = F.sort_array(F.collect_list(F.struct("ts", (-F.col("item_id")).alias("k"), "item_id")))
    grouped = S.leave_two_out(visits(spark, d)).where("split = 'train'").groupBy("user_id").agg(rows.alias("r")).where(F.size("r") >= 2)
    return grouped.select("user_id", F.concat_ws(",", F.transform("r", lambda x: x.item_id.cast("string"))).alias("items"))


@query(f"""WITH {SPLIT_SQL}, e AS (SELECT user_id, item_id FROM split WHERE split = 'train'),
u AS (SELECT user_id, count(*) AS du FROM e GROUP BY user_id),
i AS (SELECT item_id, count(*) AS di FROM e GROUP BY item_id)
SELECT user_id, item_id, round(1 / sqrt(du * di), 8) AS weight FROM e JOIN u USING (user_id) JOIN i USING (item_id)""")
def dm13_adjacency(spark, d):
    e = S.leave_two_out(visits(spark, d)).where("split = 'train'").select("user_id", "item_id")
    degree = lambda k, out: e.groupBy(k).agg(F.count("*").alias(out))
    return e.join(degree("user_id", "du"), "user_id").join(degree("item_id", "di"), "item_id").select("user_id", "item_id", F.round(1 / F.sqrt(F.col("du") * F.col("di")), 8).alias("weight"))


@query("""WITH c AS (SELECT c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT c_mktsegment AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM c GROUP BY 1),
p AS (SELECT a.g AS a, b.g AS b, a.n AS n1, b.n AS n2, a.m - b.m AS diff, a.v / a.n AS x, b.v / b.n AS y, a.v AS v1, b.v AS v2 FROM s a JOIN s b ON a.g < b.g)
SELECT a, b, round(diff / sqrt(x + y), 4) AS t, round(diff - 1.96 * sqrt(x + y), 2) AS low, round(diff + 1.96 * sqrt(x + y), 2) AS high,
  round((x + y) ** 2 / (x ** 2 / (n1 - 1) + y ** 2 / (n2 - 1)), 2) AS df, round(diff / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS d FROM p""")
def ag35_welch(spark, d):
    c = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    s = c.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("m"), F.var_samp("o_totalprice").alias("v"))
    a, b = s.toDF("a", "n1", "m1", "v1"), s.toDF("b", "n2", "m2", "v2")
    # One row for each of the few groups.
    p = a.join(F.broadcast(b), F.col("a") < F.col("b")).selectExpr("a", "b", "n1", "n2", "v1", "v2", "m1 - m2 AS diff", "v1 / n1 AS x", "v2 / n2 AS y")
    return p.selectExpr("a", "b", "round(diff / sqrt(x + y), 4) AS t", "round(diff - 1.96D * sqrt(x + y), 2) AS low", "round(diff + 1.96D * sqrt(x + y), 2) AS high", "round(power(x + y, 2) / (power(x, 2) / (n1 - 1) + power(y, 2) / (n2 - 1)), 2) AS df", "round(diff / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS d")


_AUDIT = ["doc_id", "text", "lang", "source", "n_chars"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS kinds, count(DISTINCT {c}) <= 1 AS constant, count({c}) - count(DISTINCT {c}) AS repeats, {f'count(*) FILTER (isinf({c}::DOUBLE))' if c in ('doc_id', 'n_chars') else '0'}::BIGINT AS infinite FROM documents" for c in _AUDIT))
def ag30_column_audit(spark, d):
    """Nulls, kinds, constants, repeats and infinities of every column: values are counted by hash, one short row each, with a map-side combine."""
    docs = table(spark, d, "documents")
    number = {c: c in ("doc_id", "n_chars") for c in _AUDIT}
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.when(F.col(c).isNotNull(), F.md5(F.col(c).cast("string").cast("binary"))).alias("h"), (F.abs(F.col(c).cast("double")) == float("inf") if number[c] else F.lit(False)).alias("inf")) for c in _AUDIT]))
    kinds = docs.select(cells.alias("x")).select("x.*").groupBy("name", "h").agg(F.count("*").alias("n"), F.count_if("inf").alias("i"))
    known = F.col("h").isNotNull()
    a = kinds.groupBy("name").agg(F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("nulls"), F.count_if(known).alias("kinds"), F.sum(F.when(known, F.col("n") - 1).otherwise(0)).alias("repeats"), F.sum("i").alias("infinite"))
    return a.select("name", "nulls", "kinds", (F.col("kinds") <= 1).alias("constant"), "repeats", "infinite")


@query("""SELECT n_nationkey, CASE WHEN length(n_nationkey::VARCHAR) < 12 THEN lpad(n_nationkey::VARCHAR, 12, '0') ELSE n_nationkey::VARCHAR END AS code, substr(md5(n_name || '::' || n_nationkey), 1, 12) AS short_id FROM nation""")
def sf7_sf8_codes(spark, d):
    k = F.col("n_nationkey").cast("string")
    return table(spark, d, "nation").select("n_nationkey", expr.zero_pad(k, 12).alias("code"), F.substring(F.md5(F.concat_ws("::", "n_name", k).cast("binary")), 1, 12).alias("short_id"))


@query("SELECT s_suppkey AS key, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def so1_union_aligned(spark, d):
    return R.union_all(table(spark, d, "supplier").selectExpr("s_suppkey AS key", "s_acctbal AS balance"), table(spark, d, "customer").selectExpr("c_custkey AS key", "c_acctbal AS balance", "c_mktsegment AS segment")).select("key", "balance", "segment")


from lodestream.plans import evaluation, evidence, features, parsing, places, selecting, streams  # noqa: E402, F401
from lodestream.plans import audits, extensions, tuning  # noqa: E402, F401
