"""User and item features over visits, with their scalers and fills, and equivalent SQL.

Ages are days before DAY; a smaller age is newer. Group statistics are sums of partial sums; what needs an order within a
user or an item is a window on that key.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.operators import relational as R
from lodestream.operators import split as S
from lodestream.plans.registry import query
from lodestream.sources.shared import written
from lodestream.sources.tables import REVIEWS_SQL, TIES, VISITS_SQL, reviews, table, visits, with_counts

#: The day from which ages are counted.
DAY = "2030-01-01"
AGED_SQL = f"{VISITS_SQL}, aged AS (SELECT *, date_diff('day', ts::DATE, DATE '{DAY}') AS age FROM visits)"


def aged(spark, d, v=None):
    return (visits(spark, d) if v is None else v).withColumn("age", F.datediff(F.lit(DAY).cast("date"), F.col("ts")))


@query(f"WITH {AGED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY age NULLS FIRST, {', '.join(TIES)}) AS k FROM aged WHERE rating IS NOT NULL), "
       "g AS (SELECT user_id, (max(CASE WHEN k = 1 THEN rating END) - 1) / 4.0 AS last_rating, (avg(CASE WHEN k <= 3 THEN rating END) - 1) / 4.0 AS last3, coalesce(stddev_samp(rating), 0) AS sd, ln(1 + min(age)) AS days FROM r GROUP BY user_id) "
       "SELECT user_id, round(greatest(0.0, least(1.0, last_rating)), 6)::DOUBLE AS last_rating, round(greatest(0.0, least(1.0, last3)), 6)::DOUBLE AS last3_rating_mean, round(CASE WHEN max(sd) OVER () = min(sd) OVER () THEN 0.5 ELSE (sd - min(sd) OVER ()) / (max(sd) OVER () - min(sd) OVER ()) END, 6) AS rating_variance, round(CASE WHEN max(days) OVER () = min(days) OVER () THEN 0.5 ELSE (days - min(days) OVER ()) / (max(days) OVER () - min(days) OVER ()) END, 6) AS days_since_last FROM g")  # fmt: skip
def dm7_user_sequence(spark, d, v=None):
    """Latest rating, mean of the latest three, spread and recency of each user, scaled (WN5, WN6, AG7, PRJ6, WN10)."""
    w = W.partitionBy("user_id").orderBy(F.col("age").asc_nulls_first(), *TIES)
    r = aged(spark, d, v).where("rating IS NOT NULL").withColumn("k", F.row_number().over(w))
    scaled = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - 1) / 4))
    g = r.groupBy("user_id").agg(F.max(F.when(F.col("k") == 1, F.col("rating"))).alias("last"), F.avg(F.when(F.col("k") <= 3, F.col("rating"))).alias("last3"), F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("sd"), F.log1p(F.min("age")).alias("days"))
    g = written(g)
    g = R.minmax(R.minmax(g, "sd", "rating_variance"), "days", "days_since_last")
    return g.select("user_id", F.round(scaled(F.col("last")), 6).alias("last_rating"), F.round(scaled(F.col("last3")), 6).alias("last3_rating_mean"), F.round("rating_variance", 6).alias("rating_variance"), F.round("days_since_last", 6).alias("days_since_last"))


@query(f"""WITH {AGED_SQL}, b AS (SELECT max(age) AS newest FROM aged),
a AS (SELECT item_id, rating, age - (SELECT min(age) FROM aged) AS age, {', '.join(TIES)} FROM aged),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY age, {', '.join(TIES)}) AS k FROM a), """
       "g AS (SELECT item_id, count(*) AS n, avg(rating) AS mean, avg(CASE WHEN k <= 20 THEN rating END) AS recent, count(CASE WHEN age <= 180 THEN 1 END) AS new, count(CASE WHEN age > 180 AND age <= 360 THEN 1 END) AS old FROM r GROUP BY item_id) "
       "SELECT item_id, round(CASE WHEN n >= 5 THEN recent - mean ELSE 0 END, 6) + 0.0 AS recent_shift, round(new / (old + 1), 6) AS velocity FROM g")  # fmt: skip
def dm8_item_momentum(spark, d, v=None):
    """Mean of the latest 20 ratings against all, from five on, and visits of the last half year over those of the one before (AG16, AG17)."""
    a = aged(spark, d, v)
    a = a.crossJoin(F.broadcast(a.agg(F.min("age").alias("_low")))).withColumn("age", F.col("age") - F.col("_low"))
    r = a.withColumn("k", F.row_number().over(W.partitionBy("item_id").orderBy("age", *TIES)))
    g = r.groupBy("item_id").agg(F.count("*").alias("n"), F.avg("rating").alias("mean"), F.avg(F.when(F.col("k") <= 20, F.col("rating"))).alias("recent"), F.count_if(F.col("age") <= 180).alias("new"), F.count_if((F.col("age") > 180) & (F.col("age") <= 360)).alias("old"))
    return g.select("item_id", (F.round(F.when(F.col("n") >= 5, F.col("recent") - F.col("mean")).otherwise(0.0), 6) + 0.0).alias("recent_shift"), F.round(F.col("new") / (F.col("old") + 1), 6).alias("velocity"))


@query(f"""WITH {VISITS_SQL}, c AS (SELECT user_id, p_type, count(*) AS n FROM visits JOIN part ON item_id = p_partkey GROUP BY ALL),
k AS (SELECT count(DISTINCT p_type) AS kinds FROM part),
s AS (SELECT user_id, p_type, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c),
t AS (SELECT user_id, sum((p + 1e-9) / (1 + kinds * 1e-9) * ln((p + 1e-9) / (1 + kinds * 1e-9))) AS x, count(*) AS own, any_value(kinds) AS kinds FROM s, k GROUP BY user_id) """
       "SELECT user_id, round(greatest(0.0, least(1.0, -(x + (kinds - own) * (1e-9 / (1 + kinds * 1e-9)) * ln(1e-9 / (1 + kinds * 1e-9))) / ln(kinds))), 6) + 0.0 AS diversity, own AS breadth FROM t")  # fmt: skip
def ag11_ag15_diversity(spark, d, v=None):
    """Entropy of a user's category shares, each raised by 1e-9, over that of equal shares; and the categories with any visit."""
    typed = (visits(spark, d) if v is None else v).join(table(spark, d, "part").select("p_partkey", "p_type").hint("merge"), F.col("item_id") == F.col("p_partkey"))
    kinds = table(spark, d, "part").agg(F.count_distinct("p_type").alias("kinds"))
    s = R.share(typed, ["user_id"], "p_type").crossJoin(F.broadcast(kinds))
    p, none = (F.col("share") + 1e-9) / (1 + F.col("kinds") * 1e-9), F.lit(1e-9) / (1 + F.col("kinds") * 1e-9)
    t = s.groupBy("user_id", "kinds").agg(F.sum(p * F.log(p)).alias("x"), F.count("*").alias("own"))
    whole = -(F.col("x") + (F.col("kinds") - F.col("own")) * none * F.log(none)) / F.log("kinds")
    return t.select("user_id", (F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), whole)), 6) + 0.0).alias("diversity"), F.col("own").alias("breadth"))


@query("""WITH e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
n AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM e GROUP BY vec_id),
s AS (SELECT label, i, stddev_pop(x / CASE WHEN norm = 0 THEN 1 ELSE norm END) AS sd, count(*) AS n, sum(x) > 0 AS positive FROM e JOIN n USING (vec_id) GROUP BY label, i)
SELECT label, round(CASE WHEN max(n) < 2 THEN 0 ELSE avg(sd) END, 6) AS diversity, count(*) FILTER (positive) AS breadth FROM s GROUP BY label""")
def ag14_flavour_diversity(spark, d):
    """Spread of unit vectors in each dimension, averaged; and the dimensions with a positive sum."""
    e, v = F.col("embedding"), F.col("x").cast("double")
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = table(spark, d, "embeddings").select("label", norm.alias("norm"), F.posexplode("embedding").alias("i", "x"))
    s = rows.groupBy("label", "i").agg(F.stddev_pop(v / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("sd"), F.count("*").alias("n"), (F.sum(v) > 0).alias("positive"))
    return s.groupBy("label").agg(F.round(F.when(F.max("n") < 2, 0.0).otherwise(F.avg("sd")), 6).alias("diversity"), F.count_if("positive").alias("breadth"))


@query(f"""WITH {VISITS_SQL}, s AS (SELECT item_id, c_mktsegment, avg(rating) AS m FROM visits JOIN customer ON user_id = c_custkey GROUP BY ALL),
r AS (SELECT item_id, coalesce(stddev_samp(m), 0) AS spread FROM s GROUP BY item_id)
SELECT item_id, round(spread, 6) AS spread, round(CASE WHEN max(spread) OVER () > 0 THEN spread / max(spread) OVER () ELSE 0 END, 6) AS of_max,
  round((spread - min(spread) OVER ()) / (max(spread) OVER () - min(spread) OVER () + 1e-8), 6) AS scaled FROM r""")
def ag20_segment_spread(spark, d):
    """Spread of the segments' mean ratings of an item, over the largest (WN12) and with 1e-8 in the range (WN11)."""
    s = visits(spark, d).join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("user_id") == F.col("c_custkey")).groupBy("item_id", "c_mktsegment").agg(F.avg("rating").alias("m"))
    r = s.groupBy("item_id").agg(F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("spread"))
    r = r.crossJoin(F.broadcast(r.agg(F.min("spread").alias("lo"), F.max("spread").alias("hi"))))
    return r.select("item_id", F.round("spread", 6).alias("spread"), F.round(F.when(F.col("hi") > 0, F.col("spread") / F.col("hi")).otherwise(0.0), 6).alias("of_max"), F.round((F.col("spread") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-8), 6).alias("scaled"))


_SCORES = "CASE WHEN {0} % 7 = 0 THEN NULL ELSE {0} % 5 + 1 END AS food, l_linenumber % 5 + 1 AS service, CAST(l_quantity AS INTEGER) % 5 + 1 AS mood"


@query(f"""WITH {VISITS_SQL}, s AS (SELECT user_id, {_SCORES.format('l_suppkey')} FROM visits),
m AS (SELECT *, (food + service + mood) / 3 AS mean FROM s WHERE food IS NOT NULL AND service IS NOT NULL AND mood IS NOT NULL)
SELECT user_id, round(avg(food - mean), 6) + 0.0 AS food, round(avg(service - mean), 6) + 0.0 AS service, round(avg(mood - mean), 6) + 0.0 AS mood FROM m GROUP BY user_id""")
def ag22_score_deviation(spark, d):
    """How far each of three scores lies from their mean, averaged over complete rows."""
    s = visits(spark, d).selectExpr("user_id", *[x.strip() for x in _SCORES.format("l_suppkey").replace("AS INTEGER", "AS INT").split(", ")]).dropna(subset=["food", "service", "mood"])
    mean = (F.col("food") + F.col("service") + F.col("mood")) / 3
    return s.groupBy("user_id").agg(*[(F.round(F.avg(F.col(c) - mean), 6) + 0.0).alias(c) for c in ("food", "service", "mood")])


@query("""WITH e AS (SELECT user_id, CASE WHEN value > 20 THEN event_type END AS kind, value, ts, event_id FROM events)
SELECT user_id, arg_min(kind, (ts, event_id)) FILTER (kind IS NOT NULL) AS first_kind, coalesce(bool_or(kind = 'click'), false) AS ever_click, count(*) FILTER (kind IS NOT NULL) AS n
  FROM e GROUP BY user_id""")
def ag23_ag24_first_any(spark, d):
    """The first kind of event that is known, in order of time, and whether any was a click."""
    e = table(spark, d, "events").withColumn("kind", F.when(F.col("value") > 20, F.col("event_type")))
    known = F.when(F.col("kind").isNotNull(), F.struct("ts", "event_id"))
    return e.groupBy("user_id").agg(F.min_by("kind", known).alias("first_kind"), F.coalesce(F.bool_or(F.col("kind") == "click"), F.lit(False)).alias("ever_click"), F.count("kind").alias("n"))


@query("""SELECT p_partkey, (CASE p_size % 6 WHEN 1 THEN 1 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 2 END)::DOUBLE AS price_level, (CASE p_size % 6 WHEN 1 THEN 12.5 WHEN 2 THEN 25 WHEN 3 THEN 45 END)::DOUBLE AS midpoint, round((greatest(1.0, least(4.0, p_size / 10)) - 1) / 3, 6)::DOUBLE AS tier, (p_brand = 'Brand#11')::INTEGER::DOUBLE AS brand_11, (p_brand = 'Brand#12')::INTEGER::DOUBLE AS brand_12, coalesce(nullif(p_size % 3, 0), 0)::DOUBLE AS meal_known, coalesce(nullif(p_size % 3, 0), 0.5)::DOUBLE AS spice, greatest(p_size % 7, p_size % 5)::DOUBLE AS best FROM part""")
def prj_item_columns(spark, d):
    """Constant maps with and without a default, clip and rescale, one-hot columns, fills by column name, and a maximum of columns (PRJ2, 3, 6, 8, 9, 12)."""
    size = F.col("p_size")
    level = lambda m: F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), size % 6)
    p = table(spark, d, "part").withColumns({"meal_known": F.nullif(size % 3, F.lit(0)).cast("double"), "spice": F.nullif(size % 3, F.lit(0)).cast("double")})
    p = R.fill_by_name(p, ["meal_known", "spice"])
    return p.select("p_partkey", F.coalesce(level({1: 1.0, 2: 2.0, 3: 3.0, 4: 4.0}), F.lit(2.0)).alias("price_level"), level({1: 12.5, 2: 25.0, 3: 45.0}).alias("midpoint"), F.round((F.greatest(F.lit(1.0), F.least(F.lit(4.0), size / 10)) - 1) / 3, 6).alias("tier"), *R.one_hot("p_brand", {"brand_11": "Brand#11", "brand_12": "Brand#12"}), "meal_known", "spice", F.greatest(size % 7, size % 5).cast("double").alias("best"))


@query("SELECT c_custkey AS id, c_acctbal AS balance, NULL::DOUBLE AS extra, 0.0::DOUBLE AS score_known, CASE WHEN c_acctbal IS NULL THEN 'none' ELSE 'some' END AS shown FROM customer")
def prj1_contract(spark, d):
    """Columns cut to a contract, in its order; those that are missing get a default, and the first of several that exists is taken (PRJ1, 10, 11)."""
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "id")
    c = c.withColumn("balance", R.first_existing(c, ["acct", "c_acctbal", "id"]))
    out = R.to_contract(c, {"id": None, "balance": None, "extra": F.lit(None).cast("double"), "score_known": F.lit(0.0)})
    numeric = R.numeric_columns(out, ["id"])
    return out.withColumn("shown", F.when(F.col(numeric[0]).isNull(), "none").otherwise("some"))


_BANDS = "CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n = 3 THEN '3' WHEN n <= 5 THEN '4-5' WHEN n <= 10 THEN '6-10' WHEN n <= 25 THEN '11-25' ELSE '26+' END"


@query(f"""WITH {VISITS_SQL}, a AS (SELECT user_id, count(*) AS n, avg(rating) AS m FROM visits WHERE TRY_CAST(rating AS DOUBLE) BETWEEN 1 AND 5 GROUP BY user_id),
b AS (SELECT {_BANDS} AS band, n, m FROM a)
SELECT band, count(*) AS users, sum(n)::BIGINT AS reviews, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(avg(m), 6) AS mean FROM b GROUP BY band""")
def prj4_dm34_activity_bands(spark, d):
    """The seven bands of activity: users, reviews, share of users and mean rating of each (FLT2, AG28)."""
    a = visits(spark, d).where(F.col("rating").cast("double").between(1, 5)).groupBy("user_id").agg(F.count("*").alias("n"), F.avg("rating").alias("m"))
    b = a.select(F.expr(_BANDS).alias("band"), "n", "m").groupBy("band").agg(F.count("*").alias("users"), F.sum("n").alias("reviews"), F.round(F.avg("m"), 6).alias("mean"))
    total = b.agg(F.sum("users").alias("all"))
    return b.crossJoin(F.broadcast(total)).select("band", "users", "reviews", F.round(F.col("users") / F.col("all"), 6).alias("share"), "mean")


@query(f"""WITH {VISITS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC NULLS LAST, {', '.join(TIES)}) AS k FROM visits),
r AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, item_id) - 1 AS rank, count(*) OVER (PARTITION BY user_id) AS n FROM o WHERE k = 1)
SELECT user_id, item_id, CASE WHEN rank = 0 THEN 'test' ELSE 'train' END AS split FROM r WHERE n >= 3 AND (rank > 0 OR item_id % 2 = 0)""")
def dm2_leave_one_out(spark, d):
    """The older split: three places at least, the newest is test, and test places can be kept to a given set."""
    allowed = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("item_id"))
    return S.leave_one_out(visits(spark, d), allowed=allowed).select("user_id", "item_id", "split")


@query("""WITH d AS (SELECT DISTINCT o_custkey AS id FROM orders),
e AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM d)
SELECT c_custkey AS id, idx, coalesce(c_acctbal * (idx IS NOT NULL)::INTEGER, 0) AS value FROM customer LEFT JOIN e ON c_custkey = id""")
def dm3_jn20_encoder(spark, d):
    """Dense numbers of ids in order, by ranges; other tables aligned to them, with 0 where an id has none."""
    e = R.dense_encoder(table(spark, d, "orders").select(F.col("o_custkey").alias("id")), "id")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    return c.join(e, "id", "left").select("id", "idx", F.when(F.col("idx").isNotNull(), F.col("c_acctbal")).otherwise(0.0).alias("value"))


SPLIT_SQL = f"""once AS (SELECT * FROM visits QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC NULLS LAST, {", ".join(TIES)}) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, item_id) - 1 AS split_rank FROM once QUALIFY count(*) OVER (PARTITION BY user_id) >= 4)"""
#: What may be read of an item: no review of a held-out pair; and of a user: reviews of training pairs.
SAFE_SQL = f"""{REVIEWS_SQL}, {SPLIT_SQL},
safe AS (SELECT r.* FROM reviews r LEFT JOIN ranked k ON k.user_id = r.user_id AND k.item_id = r.item_id WHERE length(r.text) >= 20 AND coalesce(k.split_rank, 2) >= 2),
known AS (SELECT r.* FROM reviews r JOIN ranked k ON k.user_id = r.user_id AND k.item_id = r.item_id WHERE length(r.text) >= 20 AND k.split_rank >= 2)"""


def corpora_sql(source: str, key: str, first: str) -> str:
    """Tables of the corpus's pieces (key, review_id, k, t) and of how much of each is in."""
    return f"""c0 AS (SELECT {key}, review_id, reviewer_reviews, text FROM {source} QUALIFY row_number() OVER (PARTITION BY {key}, review_id ORDER BY text, rating) = 1),
c1 AS (SELECT {key}, review_id, row_number() OVER (PARTITION BY {key} ORDER BY {first} length(text) DESC, review_id) AS k, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 900) AS t FROM c0),
c2 AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY {key} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM c1 WHERE k <= 8)"""


def _corpus_query(source: str, key: str, first: str, total: int) -> str:
    return f"""WITH {SAFE_SQL}, {corpora_sql(source, key, first)}
SELECT {key}, md5(string_agg(substr(t, 1, ({total} - used)::INTEGER), chr(10) || '---' || chr(10) ORDER BY k)) AS corpus, string_agg(review_id, ',' ORDER BY k) AS ids, count(*) AS n FROM c2 WHERE used < {total} GROUP BY {key}"""


#: An item's corpus: so many reviews, characters of each and in all, those of busy reviewers first.
ITEM_BOUNDS = 8, 900, 400


def busy_first():
    return [F.col("reviewer_reviews").desc()]


def _digest(c, key):
    return c.select(key, F.md5(F.col("corpus").cast("binary")).alias("corpus"), F.array_join("ids", ",").alias("ids"), F.size("ids").cast("bigint").alias("n"))


def split_visits(spark, d):
    """All visits with the split of their pair and how many their user has; dealt out by user once."""
    return with_counts(S.with_split(visits(spark, d)))


@query(_corpus_query("safe", "item_id", "reviewer_reviews DESC,", 400))
def dm5_item_corpora(spark, d):
    """An item's bounded corpus of training and auxiliary reviews, those of busy reviewers first (FLT6, SF27, TK1)."""
    safe = S.safe_reviews(reviews(spark, d, split_visits(spark, d)))
    return _digest(S.review_corpora(safe, "item_id", busy_first(), *ITEM_BOUNDS), "item_id")


@query(_corpus_query("known", "user_id", "", 300))
def dm6_user_corpora(spark, d):
    """A user's bounded corpus of training reviews alone, the longest first."""
    known = S.safe_reviews(reviews(spark, d, split_visits(spark, d), "user_id"), train=True)
    return _digest(S.review_corpora(known, "user_id", [], 8, 900, 300), "user_id")


@query(f"""WITH {VISITS_SQL}, {SPLIT_SQL}, spots AS (SELECT s_suppkey, s_acctbal / 100 - 50 AS lat, (s_suppkey * 37 % 360 - 180)::DOUBLE AS lng FROM supplier)
SELECT user_id, round(median(lat), 6) AS lat, round(median(lng), 6) AS lng, count(*) AS n FROM ranked JOIN spots ON l_suppkey = s_suppkey WHERE split_rank >= 2 GROUP BY user_id""")
def dm19_home_points(spark, d):
    """A user's home: the median of the places of training visits."""
    at = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") / 100 - 50).alias("lat"), (F.col("s_suppkey") * 37 % 360 - 180).cast("double").alias("lng"))
    train = S.leave_two_out(visits(spark, d)).where("split = 'train'").select("user_id", "l_suppkey")
    return R.medians(written(train.join(at, "l_suppkey")), ["user_id"], ["lat", "lng"]).select("user_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "n")
