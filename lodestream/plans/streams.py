"""Streams over events, against the same windows in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.plans.registry import query
from lodestream.sources.shared import shared_dir
from lodestream.sources.tables import table
from lodestream.streaming import budget
from lodestream.streaming import windows as T

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query("SELECT event_type, epoch_us(date_trunc('hour', ts)) AS hour_us, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_stream_tumbling(spark, d):
    e = T.table_stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    sums = T.tumbling(e, "ts", ["event_type"], "1 hour", "400 days", F.count("*").alias("n"), F.sum("value").alias("total"))
    rows = T.latest(T.drain(sums.select("event_type", F.unix_micros("w.start").alias("hour_us"), "n", "total"), shared_dir(spark), "update"), ["event_type", "hour_us"])
    return rows.select("event_type", "hour_us", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, event_type, count(*) > 0 AS seen FROM events GROUP BY ALL")
def ext_stream_dedupe(spark, d):
    e = T.table_stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "event_type", "ts")
    rows = T.drain(T.once_within(e, "ts", ["user_id", "event_type"], "400 days"), shared_dir(spark), "append")
    return rows.groupBy("user_id", "event_type").agg((F.count("*") == 1).alias("seen"))


@query("""SELECT user_id, event_id, round(avg(value) OVER w, 6) AS mean3, rank() OVER r AS rnk, dense_rank() OVER r AS dense, lag(event_id) OVER o AS prev,
  count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS last_hour FROM events
  WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id),
w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
r AS (PARTITION BY user_id ORDER BY event_type)""")
def ext_moving_frames(spark, d):
    """Moving means, ranks, lags, and a range frame of an hour."""
    from pyspark.sql import Window as W

    e = spark.read.parquet(f"{d}/events.parquet").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    o, r = W.partitionBy("user_id").orderBy("ts", "event_id"), W.partitionBy("user_id").orderBy("event_type")
    hour = W.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return e.select("user_id", "event_id", F.round(F.avg("value").over(o.rowsBetween(-2, 0)), 6).alias("mean3"), F.rank().over(r).alias("rnk"), F.dense_rank().over(r).alias("dense"), F.lag("event_id").over(o).alias("prev"), F.count("*").over(hour).alias("last_hour"))


@query("SELECT c_mktsegment, o_orderstatus, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (c_mktsegment, o_orderstatus), o_orderpriority")
def ext_cube(spark, d):
    j = spark.read.parquet(f"{d}/orders.parquet").join(spark.read.parquet(f"{d}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupingSets([["c_mktsegment", "o_orderstatus", "o_orderpriority"], ["c_mktsegment", "o_orderpriority"], ["o_orderstatus", "o_orderpriority"], ["o_orderpriority"]], "c_mktsegment", "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT c.k AS ck, o.k AS ok, c.n AS cn, o.n AS n FROM (SELECT CASE WHEN c_nationkey % 6 = 0 THEN NULL ELSE c_nationkey END AS k, count(*) AS n FROM customer GROUP BY 1) c FULL OUTER
  JOIN (SELECT CASE WHEN s_nationkey % 4 = 0 THEN NULL ELSE s_nationkey + 3 END AS k, count(*) AS n FROM supplier GROUP BY 1) o ON c.k IS NOT DISTINCT FROM o.k""")
def ext_full_null_safe(spark, d):
    """A full outer join on keys that may be null."""
    c = spark.read.parquet(f"{d}/customer.parquet").groupBy(F.expr("CASE WHEN c_nationkey % 6 = 0 THEN NULL ELSE c_nationkey END").alias("ck")).agg(F.count("*").alias("cn"))
    o = spark.read.parquet(f"{d}/supplier.parquet").groupBy(F.expr("CASE WHEN s_nationkey % 4 = 0 THEN NULL ELSE s_nationkey + 3 END").alias("ok")).agg(F.count("*").alias("n"))
    return c.join(o, F.col("ck").eqNullSafe(F.col("ok")), "full").select("ck", "ok", "cn", "n")


#: A seventh of the events arrive twelve days after they happened; what arrives in ten days is one batch.
_ARRIVAL_SQL = """a AS (SELECT *, epoch_us(ts) + CASE WHEN event_id % 7 = 0 THEN 12 ELSE 0 END * 86400000000 AS arrived FROM events),
b AS (SELECT *, least(2, (arrived - (SELECT min(arrived) FROM a)) // 864000000000) AS batch FROM a),
m AS (SELECT batch, max(epoch_us(ts)) AS newest FROM b GROUP BY batch),
w AS (SELECT b.*, (SELECT max(newest) FROM m WHERE m.batch < b.batch) // 1000 * 1000 - 4 * 86400000000 AS mark FROM b)"""


@query(f"""WITH {_ARRIVAL_SQL}, s AS (SELECT event_type, value, mark, (epoch_us(ts) // 86400000000 - unnest([0, 1])) * 86400000000 AS start_us FROM w)
SELECT event_type, start_us, count(*) AS n, round(sum(value), 4) AS total FROM s WHERE mark IS NULL OR start_us + 2 * 86400000000 > mark GROUP BY ALL""")
def ext_stream_late(spark, d):
    """Windows of two days at every day over events that arrive out of order: rows too late for a window are left out of it."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.unix_micros("ts") + F.when(F.col("event_id") % 7 == 0, 12).otherwise(0) * 86_400_000_000
    first = e.agg(F.min(at)).first()[0]
    e = e.withColumn("part", F.least(F.lit(2), F.floor((at - (first or 0)) / 864_000_000_000)))
    sums = lambda s: T.sliding(s, "ts", ["event_type"], "2 days", "1 day", "4 days", F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.unix_micros("w.start").alias("start_us"), "n", "total")
    rows = T.arriving([e.where(F.col("part") == k) for k in range(3)], shared_dir(spark), sums, "update")
    return T.latest(rows, ["event_type", "start_us"]).select("event_type", "start_us", "n", F.round("total", 4).alias("total"))


_CALLS_SQL = """c AS (SELECT event_id AS seq, strftime(ts, '%Y-%m') || (event_id // 2500 % 2) AS month, event_type || user_id % 20 AS run FROM events)"""


@query(f"""WITH {_CALLS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY month, run ORDER BY seq) AS in_run FROM c),
m AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY seq) AS in_month FROM k WHERE in_run <= 7)
SELECT c.seq, c.month, coalesce(in_month + 40 <= 600, false) AS allowed FROM c LEFT JOIN m USING (seq)""")
def dm36_budget_stream(spark, d):
    """Calls let through while their run and their month have room, from state that a restart keeps (two batches of calls)."""
    month = F.concat(F.date_format("ts", "yyyy-MM"), F.floor(F.col("event_id") / 2500) % 2)
    calls = table(spark, d, "events").select(month.alias("month"), F.concat("event_type", (F.col("user_id") % 20).cast("string")).alias("run"), F.col("event_id").alias("seq"), F.lit(40).cast("bigint").alias("logged"))
    half = calls.agg(F.max("seq")).first()[0] or 0
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)  # keyed state of this kind needs it
    try:
        parts = [calls.where(F.col("seq") <= half // 2), calls.where(F.col("seq") > half // 2)]
        rows = T.arriving(parts, shared_dir(spark), lambda s: budget.guarded(s, 600, 0.225, 0.032), "append")
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)
    return rows.select("seq", "month", "allowed")
