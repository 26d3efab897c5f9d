"""Selection, dedupe, set operations, joins by distance and graphs, and equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.functions import expr
from lodestream.operators import audits as A
from lodestream.operators import geo
from lodestream.operators import ranges as N
from lodestream.operators import ranking as K
from lodestream.operators import relational as R
from lodestream.operators import selection as X
from lodestream.plans.registry import query
from lodestream.sources.tables import table

_KM = "2 * 6371 * asin(sqrt(greatest(0.0, least(1.0, sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lng - a.lng) / 2) ** 2))))"


def _points_sql(lat: str, lng: str) -> str:
    return f"points AS (SELECT vec_id AS id, label, {lat} AS lat, {lng} AS lng FROM embeddings)"


_FLAT = _points_sql("embedding[1]::DOUBLE * 10", "embedding[2]::DOUBLE * 10")
#: Over the whole globe, poles and the date line included.
_ROUND = _points_sql("greatest(-90.0, least(90.0, embedding[1]::DOUBLE * 400))", "((embedding[2]::DOUBLE * 1400 + 180) % 360 + 360) % 360 - 180")


def points(spark, d, whole: bool = False):
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    lat, lng = (F.greatest(F.lit(-90.0), F.least(F.lit(90.0), x * 400)), ((y * 1400 + 180) % 360 + 360) % 360 - 180) if whole else (x * 10, y * 10)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", lat.alias("lat"), lng.alias("lng"))


def _near_sql(points: str, km: float, more: str = "") -> str:
    return f"WITH {points} SELECT a.id, count(b.id) AS near FROM points a LEFT JOIN points b ON a.id <> b.id {more} AND {_KM} <= {km} GROUP BY a.id"


@query(_near_sql(_FLAT, 20))
def jn9_radius_count(spark, d):
    return geo.near_count(points(spark, d), 20.0)


@query(_near_sql(_ROUND, 700))
def jn9_radius_globe(spark, d):
    """Within 700 km over the whole globe: cells narrow towards the poles, longitudes wrap."""
    return geo.near_count(points(spark, d, True), 700.0)


@query(_near_sql(_FLAT, 60, "AND a.label = b.label"))
def jn10_radius_same_label(spark, d):
    return geo.near_count(points(spark, d), 60.0, ["label"])


@query(f"WITH {_FLAT} SELECT count(*) AS n, sum(id) ::BIGINT AS ids FROM points a WHERE a.id % 10 <> 0 AND EXISTS (SELECT 1 FROM points b WHERE b.id % 10 = 0 AND {_KM} <= 50)")
def jn17_within_any(spark, d):
    """Points within reach of any of a set: a semi-join by distance."""
    p = points(spark, d)
    hits = geo.near_pairs(p.where("id % 10 <> 0"), p.where("id % 10 = 0"), 50.0).select("id").distinct()
    return hits.agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(f"""WITH {_FLAT}, v AS (SELECT DISTINCT o_custkey AS u, l_suppkey AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT u, id, lat, lng FROM v JOIN points USING (id)), pairs AS (SELECT a.u, {_KM} AS km FROM p a JOIN p b ON a.u = b.u AND a.id < b.id)
SELECT u AS "user", count(*) AS n, round(avg(km), 4) AS mean, round(max(km), 4) AS far FROM pairs GROUP BY u""")
def jn7_jn8_pair_distances(spark, d):
    """How far the places of a user lie from one another."""
    lines, orders = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("id")), table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user"))
    visited = lines.join(orders, "l_orderkey").select("user", "id").distinct().join(points(spark, d).select("id", "lat", "lng"), "id")
    s = geo.pair_spread(visited, "user")
    return s.select("user", "n", F.round("mean", 4).alias("mean"), F.round("far", 4).alias("far"))


@query(f"""WITH {_FLAT}, c AS (SELECT label, avg(lat) AS lat, avg(lng) AS lng FROM points GROUP BY label)
SELECT a.label, b.label AS other, round({_KM}, 4) AS km FROM c a JOIN c b ON a.label <> b.label QUALIFY row_number() OVER (PARTITION BY a.label ORDER BY {_KM}, b.label) <= 5""")
def jn11_centroid_neighbours(spark, d):
    """The five nearest centroids of each: a row for each label, so the small table goes out whole."""
    c = points(spark, d).groupBy("label").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))
    other = c.toDF("other", "lat2", "lng2")
    pairs = c.join(F.broadcast(other), F.col("label") != F.col("other")).withColumn("km", expr.haversine(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")))
    return R.top_k(pairs, ["label"], [F.col("km").asc(), F.col("other").asc()], 5).select("label", "other", F.round("km", 4).alias("km"))


_COS = "list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]))"


@query(f"""SELECT q.vec_id AS query_id, c.vec_id, round({_COS}, 5) AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, c.vec_id) <= 50""")
def jn12_cosine_neighbours(spark, d):
    """The 50 nearest by cosine of the stated query set, exact."""
    e = table(spark, d, "embeddings")
    return K.best_items(e, e.where("vec_id % 100 = 0"), 50, normalise=True).select("query_id", "vec_id", F.round("score", 5).alias("score"))


@query("""SELECT q.vec_id AS query_id, c.vec_id, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 5) AS score FROM embeddings q
  JOIN embeddings c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id) <= 10""")
def jn13_full_ranking(spark, d):
    """Ten best items for the stated query set: every row whose id is divisible by 100."""
    e = table(spark, d, "embeddings")
    return K.best_items(e, e.where("vec_id % 100 = 0"), 10).select("query_id", "vec_id", F.round("score", 5).alias("score"))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 97 <> 0 AND o_totalprice > 300000)")
def jn6_anti(spark, d):
    """Customers without a large order; null keys on the right exclude nobody (FLT4)."""
    large = table(spark, d, "orders").where("o_totalprice > 300000").select(F.when(F.col("o_custkey") % 97 != 0, F.col("o_custkey")).alias("c_custkey"))
    return table(spark, d, "customer").join(large, "c_custkey", "left_anti").select("c_custkey", "c_nationkey")


@query("""WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Other' ELSE c_mktsegment END AS category FROM customer),
f AS (SELECT o_custkey, min(o_orderpriority) AS repaired, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT c_custkey, CASE WHEN category <> 'Other' THEN category ELSE coalesce(repaired, 'Other') END AS label, coalesce(n, 0) AS n, (SELECT count(*) FROM (SELECT c_custkey FROM r
  GROUP BY 1 HAVING count(*) > 1)) AS broken FROM r LEFT JOIN f ON c_custkey = o_custkey""")
def jn18_jn4_repaired_labels(spark, d):
    """A label unless it says nothing, then the repaired one; the join is one to one, and rows that break that are counted."""
    r = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "Other").otherwise(F.col("c_mktsegment")).alias("category"))
    f = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderpriority").alias("repaired"), F.count("*").alias("n"))
    broken = r.groupBy("c_custkey").count().where("count > 1").agg(F.count("*").alias("broken"))
    label = F.when(F.col("category") != "Other", F.col("category")).otherwise(F.coalesce("repaired", F.lit("Other")))
    return A.one_to_one(r, f, "c_custkey").crossJoin(F.broadcast(broken)).select("c_custkey", label.alias("label"), F.coalesce("n", F.lit(0)).alias("n"), "broken")


@query("""WITH w AS (SELECT c_custkey AS id, c_custkey % 5 AS v FROM customer),
a AS (SELECT c_custkey AS id, c_custkey % 3 AS v FROM customer WHERE c_custkey % 2 = 0),
b AS (SELECT c_custkey AS id, c_custkey % 5 AS v FROM customer WHERE c_custkey % 7 = 0)
SELECT w.id, CASE WHEN b.v = w.v THEN 'reuse_new' WHEN a.v = w.v THEN 'reuse_old' ELSE 'generate' END AS action, (a.id IS NULL AND b.id IS NULL) AS is_new FROM w LEFT
  JOIN a USING (id) LEFT JOIN b USING (id)""")
def dm30_jn19_worklist(spark, d):
    """What can be reused as its sources are exactly the same, the later batch first, and what is new (DM31, SO2)."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    a, b = c.where("id % 2 = 0").selectExpr("id", "id % 3 AS va"), c.where("id % 7 = 0").selectExpr("id", "id % 5 AS vb")
    j = c.withColumn("v", F.col("id") % 5).join(a, "id", "left").join(b, "id", "left")
    return j.select("id", F.when(F.col("vb") == F.col("v"), "reuse_new").when(F.col("va") == F.col("v"), "reuse_old").otherwise("generate").alias("action"), (F.col("va").isNull() & F.col("vb").isNull()).alias("is_new"))


@query("""WITH k AS (SELECT c_custkey, c_nationkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank, count(*) OVER () AS n FROM customer)
SELECT c_custkey, rank, greatest(1, ceil((rank - 1) * 4 / greatest(n - 1, 1)))::INTEGER AS bin FROM k""")
def wn8_wn9_global_rank(spark, d):
    """A rank over all rows, and four bins by linear quantile edges, which are not those of ntile."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    r = N.numbered(c, [F.col("c_acctbal").desc(), F.col("c_custkey").asc()]).crossJoin(F.broadcast(c.agg(F.count("*").alias("n"))))
    return X.quantile_cut(r, 4, F.col("n")).select("c_custkey", "rank", "bin")


@query("""WITH f AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 8),
need AS (SELECT greatest(0, 12 - count(DISTINCT c_nationkey)) AS k FROM f),
b AS (SELECT * FROM customer WHERE c_nationkey NOT IN (SELECT c_nationkey FROM f) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1),
p AS (SELECT * FROM b QUALIFY row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) <= (SELECT k FROM need)) """
       "SELECT c_custkey, c_nationkey, true AS champion FROM p UNION ALL (SELECT c_custkey, c_nationkey, false FROM f QUALIFY row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) <= 8 - (SELECT count(*) FROM p))")  # fmt: skip
def tk8_champions(spark, d):
    """The best eight, but with so many champions that twelve nations would be there: groups not among the best are protected."""
    order = [F.col("c_acctbal").desc(), F.col("c_custkey").asc()]
    return X.top_with_champions(table(spark, d, "customer"), "c_nationkey", order, 8, 12).select("c_custkey", "c_nationkey", "champion")


@query("""WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1),
q AS (SELECT c_nationkey, round_even(greatest(1.0::DOUBLE, n / sum(n) OVER () * 90), 0)::INTEGER AS quota FROM n),
k AS (SELECT *, row_number() OVER (ORDER BY quota <= 1, quota, c_nationkey) AS k, sum(quota) OVER () - 90 AS excess FROM q),
f AS (SELECT c_nationkey, quota - CASE WHEN k <= excess AND quota > 1 THEN 1 ELSE 0 END AS quota FROM k)
SELECT c_custkey, c_nationkey, quota FROM customer JOIN f USING (c_nationkey) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= quota""")
def tk9_quotas(spark, d):
    """90 places dealt out by share, one each at least, trimmed after rounding; the best of each group first."""
    c = table(spark, d, "customer")
    held = c.join(F.broadcast(X.quotas(c, "c_nationkey", 90)), "c_nationkey")
    k = F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey"))
    return held.withColumn("_k", k).where(F.col("_k") <= F.col("quota")).select("c_custkey", "c_nationkey", "quota")


_FILL = """WITH c AS (SELECT c_custkey, c_nationkey, c_nationkey % 2 AS side, c_nationkey % 3 + 1 AS cost, c_acctbal,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1 AS top FROM customer),
r AS (SELECT c_custkey, cost, side, row_number() OVER (PARTITION BY side ORDER BY c_acctbal DESC, c_custkey) AS place FROM c WHERE NOT top),
t AS (SELECT c_custkey, cost, -1 AS turn, side, c_nationkey AS place FROM c WHERE top
  UNION ALL SELECT c_custkey, cost, CASE side WHEN 0 THEN (place - 1) // 4 ELSE place - 1 END, side, place FROM r),
s AS (SELECT *, row_number() OVER o AS slot, coalesce(sum(cost) OVER (ORDER BY turn, side, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM t WINDOW o AS (ORDER BY turn, side, place))
SELECT c_custkey, slot, before FROM s QUALIFY turn < 0 OR min(before) OVER (PARTITION BY turn) < 700"""


@query(_FILL)
def wn17_wn18_budget_fill(spark, d):
    """The best of each nation, then two ranked lists, four of one to one of the other, until a budget is spent; a turn that began is finished."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey", (F.col("c_nationkey") % 3 + 1).alias("cost"))
    order = [F.col("c_acctbal").desc(), F.col("c_custkey").asc()]
    return X.budget_fill(c.where("c_nationkey % 2 = 0"), c.where("c_nationkey % 2 = 1"), "c_nationkey", order, "cost", 4, 700).select("c_custkey", "slot", "before")


@query("""WITH e AS (SELECT user_id, event_id, value < 8 AS empty, row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 10), event_id) AS k FROM events),
l AS (SELECT *, k - coalesce(max(CASE WHEN NOT empty THEN k END) OVER (PARTITION BY user_id ORDER BY k), 0) AS run FROM e),
s AS (SELECT *, min(CASE WHEN run >= 3 THEN k END) OVER (PARTITION BY user_id) AS stop FROM l)
SELECT user_id, event_id FROM s WHERE stop IS NULL OR k <= stop""")
def dm37_stop_after_empties(spark, d):
    """From the centre outwards, until three in a row are empty."""
    e = table(spark, d, "events")
    return X.stop_after(e, ["user_id"], [F.abs(F.col("value") - 10).asc(), F.col("event_id").asc()], F.col("value") < 8, 3).select("user_id", "event_id")


@query("""WITH l AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
c AS (SELECT o_orderkey AS seq, strftime(o_orderdate, '%Y-%m') AS month, (o_custkey % 10)::VARCHAR AS run, o_orderdate AS ts FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY month, run ORDER BY ts, seq) AS in_run FROM c),
m AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY ts, seq) AS in_month FROM k WHERE in_run <= 15)
SELECT c.seq, c.month, c.run, coalesce(in_month + coalesce(n, 0) <= 120, false) AS allowed FROM c LEFT JOIN m USING (seq) LEFT JOIN l ON l.month = c.month""")
def dm36_budget_guard(spark, d):
    """Calls of a month and a run, each let through while both have room; a ledger's earlier calls of the month count as well."""
    o = table(spark, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    logged = o.where("o_orderstatus = 'P'").groupBy("month").agg(F.count("*").alias("n"))
    calls = o.select(F.col("o_orderkey").alias("seq"), "month", (F.col("o_custkey") % 10).cast("string").alias("run"), F.col("o_orderdate").alias("ts"))
    return X.budget_guard(calls, logged, 120, 0.48, 0.032, [F.col("ts").asc(), F.col("seq").asc()]).select("seq", "month", "run", "allowed")


@query("""WITH RECURSIVE t AS (SELECT c_nationkey AS g, count(*) AS total, count(*) FILTER (c_mktsegment = 'BUILDING') AS had FROM customer GROUP BY 1),
r AS (SELECT c_custkey AS id, c_nationkey AS g, 1 + c_custkey % 4 AS cost, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer WHERE c_mktsegment <> 'BUILDING'),
f AS (SELECT r.*, total, had, place <= greatest(0, ceil(0.25::DOUBLE * total) - had) AS floor FROM r JOIN t USING (g)),
b AS (SELECT 2 * count(*) // 3 AS budget FROM customer),
s AS (SELECT id, g, cost, place, total, had + count(*) FILTER (floor) OVER (PARTITION BY g) AS held, (SELECT budget FROM b) - coalesce(sum(cost) FILTER (floor) OVER (), 0) AS rest,
  CASE WHEN floor THEN row_number() OVER (ORDER BY NOT floor, g, place) END AS slot, count(*) FILTER (floor) OVER () AS n FROM f),
picks AS (SELECT * FROM s UNION ALL
  SELECT id, g, cost, place, total, held + (g = pick.g)::INT, rest - pick.cost, CASE WHEN id = pick.id THEN n + 1 ELSE slot END, n + 1 FROM (
  SELECT *, min({'cover': held / total, 'g': g, 'place': place, 'id': id, 'cost': cost}) FILTER (slot IS NULL AND cost <= rest AND held / total < 0.5) OVER () AS pick FROM picks WHERE rest > 0) WHERE pick IS NOT NULL)
SELECT id, g, cost, slot FROM picks WHERE slot IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY n) = 1""")
def tk10_lowest_coverage_first(spark, d):
    """A budget for customers not covered yet: a quarter of each nation first, then the nation of least coverage, up to a half."""
    c = table(spark, d, "customer")
    groups = c.groupBy(F.col("c_nationkey").alias("g")).agg(F.count("*").alias("total"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("covered"))
    rows = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("g"), (1 + F.col("c_custkey") % 4).alias("cost"), "c_acctbal")
    budget = 2 * c.count() // 3
    return X.coverage_fill(rows, groups, "id", "g", [F.col("c_acctbal").desc(), F.col("id").asc()], "cost", budget).select("id", "g", "cost", "slot")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders),
l AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last FROM o GROUP BY o_custkey)
SELECT o_custkey, last FROM l""")
def tk3_keep_last(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return R.keep_last(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("last"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 300)::VARCHAR END AS rid FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY event_id) AS k FROM e)
SELECT event_id, rid FROM k WHERE k = 1 OR coalesce(rid, '') = ''""")
def tk4_dedupe_nonempty(spark, d):
    """One row for each id; rows without an id all stay, and go to many tasks."""
    e = table(spark, d, "events").selectExpr("event_id", "CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 7 = 0 THEN NULL ELSE string(event_id % 300) END AS rid")
    blank = F.coalesce("rid", F.lit("")) == ""
    return R.keep_first(e.where(~blank), ["rid"], [F.col("event_id").asc()]).unionByName(e.where(blank)).select("event_id", "rid")


@query("""WITH e AS (SELECT event_id, value, ntile, CASE WHEN value <= q1 THEN 'old' WHEN value <= q2 THEN 'mid' ELSE 'new' END AS band
  FROM (SELECT event_id, value, 0 AS ntile, (SELECT quantile_cont(value, 0.333) FROM events WHERE event_id % 9 <> 0) AS q1, (SELECT quantile_cont(value, 0.667) FROM events
  WHERE event_id % 9 <> 0) AS q2 FROM events WHERE event_id % 9 <> 0))
SELECT band, count(*) AS n, round(avg(value), 4) AS mean FROM e GROUP BY band""")
def wn15_quantile_bands(spark, d):
    """Bands by quantiles over all rows; unknown ages belong to none (DM16)."""
    e = table(spark, d, "events").where("event_id % 9 <> 0").withColumn("g", F.lit(1))
    q = R.quantiles(e, ["g"], "value", {"q1": 0.333, "q2": 0.667}).select("q1", "q2")
    v = F.col("value")
    band = F.when(v <= F.col("q1"), "old").when(v <= F.col("q2"), "mid").otherwise("new")
    return e.crossJoin(F.broadcast(q)).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("""WITH c AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'),
p AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT (SELECT count(*) FROM (SELECT k FROM c UNION SELECT k FROM p)) AS either, (SELECT count(*) FROM (SELECT k FROM c INTERSECT SELECT k FROM p)) AS both, (SELECT count(*)
  FROM (SELECT k FROM c EXCEPT SELECT k FROM p)) AS only_f""")
def so3_set_sizes(spark, d):
    """Sizes of union, intersection and difference, from one pass that marks each key."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("f"), F.bool_or(F.col("o_orderstatus") == "P").alias("p"))
    return o.agg(F.count_if(F.col("f") | F.col("p")).alias("either"), F.count_if(F.col("f") & F.col("p")).alias("both"), F.count_if(F.col("f") & ~F.col("p")).alias("only_f"))


@query("""SELECT c_custkey, TRY_CAST(CASE c_custkey % 5 WHEN 0 THEN '0' WHEN 1 THEN 'x' WHEN 2 THEN '3' END AS DOUBLE) IS DISTINCT
  FROM 0 AS eligible, lower(CASE c_custkey % 3 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'no' ELSE '1' END) IN ('true', '1', 'yes') AS flagged,
  CASE WHEN c_custkey % 4 = 0 THEN true WHEN c_custkey % 4 = 1 THEN c_acctbal < 500 ELSE false END AS again FROM customer""")
def flt7_flt9_predicates(spark, d):
    """Only an explicit zero is skipped; truthy texts; and what is tried again, by outcome and message."""
    k = F.col("c_custkey")
    count = F.when(k % 5 == 0, "0").when(k % 5 == 1, "x").when(k % 5 == 2, "3")
    flag = F.when(k % 3 == 0, "TRUE").when(k % 3 == 1, "no").otherwise("1")
    again = expr.retry(F.when(k % 4 == 0, "too many open files").otherwise(""), k % 4 <= 1, F.col("c_acctbal") < 500)
    return table(spark, d, "customer").select("c_custkey", (~count.try_cast("double").eqNullSafe(F.lit(0.0))).alias("eligible"), F.lower(flag).isin("true", "1", "yes").alias("flagged"), again.alias("again"))
