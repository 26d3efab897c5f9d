"""Parsing, labels and text rules over texts made from the driver's tables, and equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.functions import expr
from lodestream.plans.registry import query
from lodestream.sources.tables import table

#: The texts that the parsers read, as an expression that both engines know.
AGE = """CASE c_custkey % 13 WHEN 0 THEN 'Today' WHEN 1 THEN concat(c_custkey % 9 + 2, ' years ago') WHEN 2 THEN 'a year ago' WHEN 3 THEN concat(c_custkey % 11, ' months ago')
  WHEN 4 THEN 'a month ago' WHEN 5 THEN concat(c_custkey % 5, '  weeks ago') WHEN 6 THEN 'a  week ago' WHEN 7 THEN concat(c_custkey % 6, ' days ago') WHEN 8 THEN 'yesterday'
  WHEN 9 THEN 'just now' WHEN 10 THEN 'a day ago' WHEN 11 THEN '5 hours ago' ELSE NULL END"""
PRICE = """CASE c_custkey % 7 WHEN 0 THEN concat('$', c_custkey % 40, '-', c_custkey % 40 + 20) WHEN 1 THEN concat('$', c_custkey % 90, '+') WHEN 2 THEN concat('$', c_custkey % 90)
  WHEN 3 THEN '$1,000' WHEN 4 THEN '' WHEN 5 THEN concat('about ', c_custkey, '.5 of 10') ELSE NULL END"""
_AGE_SQL = " ".join(f"WHEN regexp_matches(lower(age), '{p}') THEN " + (f"regexp_extract(lower(age), '{p}', 1)::BIGINT * {d}" if p[0] == "(" else str(d)) for p, d in expr.AGE_RULES)


@query(f"WITH t AS (SELECT c_custkey, {AGE} AS age, {PRICE} AS price FROM customer) SELECT c_custkey, CASE {_AGE_SQL} END::BIGINT AS days, "
       r"TRY_CAST(nullif(regexp_extract(price, '(\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS number, TRY_CAST(nullif(regexp_extract(price, '(\d+)', 1), '') AS DOUBLE) AS whole, "
       r"CASE WHEN regexp_matches(price, '\$(\d+)\D+(\d+)?') THEN (regexp_extract(price, '\$(\d+)\D+(\d+)?', 1)::DOUBLE + coalesce(nullif(regexp_extract(price, '\$(\d+)\D+(\d+)?', 2), ''), regexp_extract(price, '\$(\d+)\D+(\d+)?', 1))::DOUBLE) / 2 END AS midpoint, "
       r"TRY_CAST(replace(nullif(regexp_extract(price, '(\d[\d,]*)', 1), ''), ',', '') AS BIGINT) AS thousands, TRY_CAST(price AS DOUBLE) AS lenient, regexp_replace(lower(trim(age)), '\s+', ' ', 'g') AS plain FROM t")  # fmt: skip
def sf1_sf5_parsing(spark, d):
    """Numbers, prices, relative ages, counts with separators, lenient casts and normalised texts."""
    t = table(spark, d, "customer").selectExpr("c_custkey", f"{AGE} AS age", f"{PRICE} AS price")
    age, price = F.col("age"), F.col("price")
    return t.select("c_custkey", expr.age_days(age).alias("days"), expr.first_number(price).alias("number"), expr.first_number(price, False).alias("whole"), expr.price_midpoint(price).alias("midpoint"), expr.thousands(price).alias("thousands"), expr.number(price).alias("lenient"), expr.plain(age).alias("plain"))


LIST = "CASE c_custkey % 5 WHEN 0 THEN concat(c_name, ',  AB , Pad   Thai,', c_mktsegment) WHEN 1 THEN ' soup ,soup,x' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE lower(c_mktsegment) END"


@query(rf"WITH t AS (SELECT c_custkey, unnest(string_split({LIST}, ',')) AS part FROM customer), p AS (SELECT c_custkey, regexp_replace(lower(trim(part)), '\s+', ' ', 'g') AS part FROM t) SELECT c_custkey, part, substr(md5(concat(c_custkey, '::', part)), 1, 12) AS id FROM p WHERE length(part) >= 3")
def sf6_split_list(spark, d):
    """Parts of a list, one a row, repeats kept, each with its short id."""
    t = table(spark, d, "customer").selectExpr("c_custkey", f"{LIST} AS list").select("c_custkey", F.explode(expr.split_list(F.col("list"))).alias("part"))
    return t.withColumn("id", F.substring(F.md5(F.concat_ws("::", F.col("c_custkey").cast("string"), "part").cast("binary")), 1, 12))


#: Fixed values of the label rules below.
TYPES = {"BRASS": "metal", "TIN": "metal", "STEEL": "metal", "COPPER": "metal", "NICKEL": "metal", "PROMO": "offer"}
NOISE = ["STANDARD", "ANODIZED", "PROMO"]


@query(f"""WITH t AS (SELECT p_partkey, replace(p_type, ' ', ', ') AS types, p_name FROM part),
x AS (SELECT *, list_filter(list_transform(string_split(types, ','), lambda v: trim(v)), lambda v: list_contains({list(TYPES)}, v) AND NOT list_contains({NOISE}, v)) AS hits FROM t) """
       "SELECT p_partkey, CASE WHEN len(hits) > 0 THEN 'metal' ELSE 'Other' END AS category, CASE WHEN len(hits) > 0 THEN 'metal' WHEN regexp_matches(lower(p_name), '\\b(part|item)\\b') THEN 'named' WHEN regexp_matches(lower(p_name), '[0-9]$') THEN 'numbered' ELSE 'unresolved' END AS label FROM x")  # fmt: skip
def sf11_sf12_labels(spark, d):
    """The first mapped type, skipping noise; then a cascade: type, name, unresolved."""
    t = table(spark, d, "part").select("p_partkey", F.replace("p_type", F.lit(" "), F.lit(", ")).alias("types"), F.lower("p_name").alias("name"))
    category = expr.first_mapped(F.col("types"), TYPES, NOISE, "Other")
    label = F.when(category != "Other", category).when(F.col("name").rlike(r"\b(part|item)\b"), "named").when(F.col("name").rlike("[0-9]$"), "numbered").otherwise("unresolved")
    return t.select("p_partkey", category.alias("category"), label.alias("label"))


@query("""WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t, lang FROM documents),
e AS (SELECT doc_id, lang, list_filter(['and', 'der', 'que', 'les'], lambda w: regexp_matches(t, '(^|[^a-z])' || w || '([^a-z]|$)')) AS hits FROM t) """
       "SELECT doc_id, array_to_string(hits, ',') AS evidence, CASE len(hits) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS triage, CASE WHEN len(hits) = 1 THEN hits[1] ELSE 'unknown' END AS label, CASE WHEN len(hits) = 1 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM e")  # fmt: skip
def sf13_sf14_evidence(spark, d):
    """Labels with the words that speak for them: none, one or many; a label needs evidence, else it is unknown and at most half sure."""
    t = table(spark, d, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    hits = F.array_compact(F.array(*[F.when(F.col("t").rlike(f"(^|[^a-z]){w}([^a-z]|$)"), w) for w in ("and", "der", "que", "les")]))
    t = t.select("doc_id", hits.alias("h"), F.size(hits).alias("n"))
    triage = F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "one").otherwise("many")
    return t.select("doc_id", F.array_join("h", ",").alias("evidence"), triage.alias("triage"), F.when(F.col("n") == 1, F.element_at("h", 1)).otherwise("unknown").alias("label"), F.when(F.col("n") == 1, 0.9).otherwise(0.5).alias("confidence"))


HOURS = "CASE WHEN c_custkey % 4 = 3 THEN '[oops' WHEN c_custkey % 4 = 2 THEN '[]' ELSE concat('[', " + ", ', ', ".join(f"c_custkey * {3 * h + 1} % 7" for h in range(24)) + ", ']') END"
DAYS = """CASE WHEN c_custkey % 3 = 2 THEN 'x' ELSE concat('{"Monday": ', c_custkey % 5, ', "Saturday": ', c_custkey % 7, ', "Sunday": ', c_custkey % 3, '}') END"""


@query(f"WITH t AS (SELECT c_custkey, TRY_CAST(TRY_CAST({HOURS} AS JSON) AS DOUBLE[]) AS h, TRY_CAST({DAYS} AS JSON) AS d FROM customer), "
       "s AS (SELECT *, list_sum(h) AS total, list_sum([coalesce((d->>k)::DOUBLE, 0) for k in ['Monday', 'Saturday', 'Sunday']]) AS week FROM t) "
       "SELECT c_custkey, " + ", ".join(f"round(CASE WHEN total > 0 THEN coalesce(list_sum(h[{a + 1}:{b}]), 0) / total ELSE 0 END, 6) AS {n}" for n, a, b in (("lunch", 11, 14), ("dinner", 17, 22), ("late", 22, 24))) +
       ", round(CASE WHEN week > 0 THEN (coalesce((d->>'Saturday')::DOUBLE, 0) + coalesce((d->>'Sunday')::DOUBLE, 0)) / week ELSE 0 END, 6) AS weekend, CASE WHEN d IS NULL THEN 0 ELSE len(json_keys(d)) END::INTEGER AS days FROM s")
def sf19_sf20_json_shares(spark, d):
    """Shares of a JSON array's windows and of a JSON map's weekend; malformed texts count as nothing."""
    t = table(spark, d, "customer").selectExpr("c_custkey", f"{HOURS} AS hours", f"{DAYS} AS days")
    h, m = expr.json_list(F.col("hours"), "double"), F.from_json("days", "map<string,double>")
    t = t.select("c_custkey", h.alias("h"), F.coalesce(m, F.create_map().cast("map<string,double>")).alias("m"))
    week = F.aggregate(F.map_values("m"), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    weekend = F.coalesce(F.try_element_at("m", F.lit("Saturday")), F.lit(0.0)) + F.coalesce(F.try_element_at("m", F.lit("Sunday")), F.lit(0.0))
    known = F.size(F.filter(F.map_keys("m"), lambda k: k.isNotNull()))
    return t.select("c_custkey", *[F.round(expr.window_share(F.col("h"), a, b), 6).alias(n) for n, a, b in (("lunch", 11, 14), ("dinner", 17, 22), ("late", 22, 24))], F.round(F.when(week > 0, weekend / week).otherwise(0.0), 6).alias("weekend"), known.alias("days"))


NAMES = "CASE c_custkey % 4 WHEN 0 THEN '[\"soup\", \"pie\", \"soup\"]' WHEN 1 THEN '[\"tea\", \"pi' WHEN 2 THEN '[]' ELSE NULL END"


@query(f"WITH t AS (SELECT c_custkey, {NAMES} AS names FROM customer), l AS (SELECT *, coalesce(TRY_CAST(TRY_CAST(names AS JSON) AS VARCHAR[]), []) AS v FROM t) SELECT c_custkey, array_to_string(v, ',') AS listed, array_to_string(CASE WHEN len(v) = 3 THEN [v[1], v[2]] ELSE v END, ',') AS once, array_to_string(regexp_extract_all(coalesce(names, ''), '\"([^\"]*)\"', 1), ',') AS salvaged FROM l")
def sf21_sf22_sf28_lists(spark, d):
    """A JSON list, or nothing; its members once, in order; and the quoted texts that a truncated list still has."""
    t = table(spark, d, "customer").selectExpr("c_custkey", f"{NAMES} AS names")
    listed = expr.json_list(F.when(F.col("names").rlike(r"\]\s*$"), F.col("names")), "string")
    return t.select("c_custkey", F.array_join(listed, ",").alias("listed"), F.array_join(F.array_distinct(listed), ",").alias("once"), F.array_join(F.regexp_extract_all(F.coalesce("names", F.lit("")), F.lit('"([^"]*)"'), F.lit(1)), ",").alias("salvaged"))


@query(r"WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t, concat('see [A', turn, '] and [B2], not [ab] ', CASE WHEN turn % 2 = 0 THEN '[Q9]' ELSE '' END) AS cited FROM conversations), "
       r"w AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(t), '[a-z]{4,}'), lambda x: NOT list_contains(['that', 'with'], x))) AS ws, regexp_extract_all(cited, '\[([A-Z]\d+)\]', 1) AS cs FROM c) "
       r"SELECT conv_id, turn, list_has_any(ws, ['what', 'this', 'have', 'from', 'there', 'where']) AS overlap, array_to_string(cs, ',') AS cites, list_has_all([concat('A', turn), 'B2'], cs) AS supported FROM w")  # fmt: skip
def sf23_sf26_tokens_citations(spark, d):
    """Whether a text shares a word with a set, stop words aside; the citations of a text and whether all are among those allowed."""
    c = table(spark, d, "conversations").selectExpr("conv_id", "turn", "lower(coalesce(text, '')) AS t", "concat('see [A', turn, '] and [B2], not [ab] ', CASE WHEN turn % 2 = 0 THEN '[Q9]' ELSE '' END) AS cited")
    words = F.filter(F.regexp_extract_all("t", F.lit("[a-z]{4,}"), F.lit(0)), lambda w: ~w.isin("that", "with"))
    cites = F.regexp_extract_all("cited", F.lit(r"\[([A-Z]\d+)\]"), F.lit(1))
    allowed = F.array(F.concat(F.lit("A"), F.col("turn").cast("string")), F.lit("B2"))
    return c.select("conv_id", "turn", F.arrays_overlap(words, F.array(*map(F.lit, ("what", "this", "have", "from", "there", "where")))).alias("overlap"), F.array_join(cites, ",").alias("cites"), (F.size(F.array_except(cites, allowed)) == 0).alias("supported"))


@query("""WITH v AS (SELECT vec_id, unnest(['value', 'noise', 'wait', 'spice', 'quiet', 'price']) AS name, unnest([round(abs(embedding[1]::DOUBLE) * 3 % 1, 3),
  round(abs(embedding[2]::DOUBLE) * 3 % 1, 3), round(abs(embedding[3]::DOUBLE) * 3 % 1, 3), round(abs(embedding[4]::DOUBLE) * 3 % 1, 3),
  round(abs(embedding[5]::DOUBLE) * 3 % 1, 3), NULL]) AS x FROM embeddings), """
       "r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(abs(x - 0.5), 3) DESC, name DESC) AS n FROM v WHERE x IS NOT NULL) SELECT vec_id, string_agg(name, ',' ORDER BY n) AS top FROM r WHERE n <= 4 GROUP BY vec_id")  # fmt: skip
def sf24_top_attributes(spark, d):
    """The four known attributes farthest from the middle; ties by name, the last first."""
    e = F.col("embedding")
    x = [F.round(F.abs(e[i].cast("double")) * 3 % 1, 3) for i in range(5)] + [F.lit(None).cast("double")]
    pairs = F.array(*[F.struct(F.round(F.abs(v - 0.5), 3).alias("far"), F.lit(n).alias("name")) for n, v in zip(("value", "noise", "wait", "spice", "quiet", "price"), x)])
    best = F.slice(F.sort_array(F.filter(pairs, lambda p: p.far.isNotNull()), asc=False), 1, 4)
    return table(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(best, lambda p: p["name"]), ",").alias("top"))


@query("""WITH p AS (SELECT vec_id, ['value', 'noise', 'wait'][vec_id % 3 + 1] AS a, round(abs(embedding[1]::DOUBLE) * 3 % 1, 3) AS u,
  round(abs(embedding[2]::DOUBLE) * 3 % 1, 3) AS i, vec_id % 5 + 1 AS rating FROM embeddings) """
       "SELECT vec_id, (abs(u - i) <= 0.25 AND ((a = 'value' AND u >= 0.65 AND i >= 0.65) OR (a = 'noise' AND ((u >= 0.65 AND i >= 0.65) OR (u <= 0.35 AND i <= 0.35))))) AS strict, ((u >= 0.6 AND i >= 0.6) OR (u <= 0.4 AND i <= 0.4)) AS legacy, (vec_id % 2 = 0 AND rating >= 4) AS history FROM p")  # fmt: skip
def sf25_alignment(spark, d):
    """Strict and legacy agreement of attributes, and shared history that counts only after a liked visit."""
    e = F.col("embedding")
    a = F.element_at(F.array(F.lit("value"), F.lit("noise"), F.lit("wait")), (F.col("vec_id") % 3 + 1).cast("int"))
    u, i = (F.round(F.abs(e[k].cast("double")) * 3 % 1, 3) for k in (0, 1))
    held = [expr.aligned(a, u, i, ["value"], ["noise"], p).alias(p) for p in ("strict", "legacy")]
    return table(spark, d, "embeddings").select("vec_id", *held, ((F.col("vec_id") % 2 == 0) & (F.col("vec_id") % 5 + 1 >= 4)).alias("history"))


@query("""WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT vec_id, round(sqrt(list_sum([x * x for x in e])), 5) AS norm, round(list_sum([e[i] for i in range(1, 65, 2)]), 5) AS odd,
  round(list_sum([e[i] * CASE WHEN i % 4 < 2 THEN 1 ELSE -1 END for i in range(1, 65)]), 5) AS signed FROM m""")
def sf29_projection(spark, d):
    """Norm and projection onto the rows of a fixed matrix."""
    fixed = {"odd": [1.0 if i % 2 else 0.0 for i in range(1, 65)], "signed": [1.0 if i % 4 < 2 else -1.0 for i in range(1, 65)]}
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(expr.dot(e, e)), 5).alias("norm"), *[F.round(expr.dot(e, F.array(*map(F.lit, v))), 5).alias(k) for k, v in fixed.items()])


META = "concat('Food: ', c_custkey % 5, '; Service : good;Food: ', c_mktsegment, ';odd')"


@query(f"""WITH p AS (SELECT c_custkey, unnest(string_split({META}, ';')) AS part, generate_subscripts(string_split({META}, ';'), 1) AS i FROM customer),
k AS (SELECT c_custkey, i, trim(string_split(part, ':')[1]) AS key, trim(string_split(part, ':')[2]) AS value FROM p WHERE contains(part, ':'))
SELECT c_custkey, key, string_agg(value, '|' ORDER BY i) AS vals, count(*) AS n FROM k GROUP BY ALL""")
def sf30_key_values(spark, d):
    """key: value pairs of a text; a key that repeats holds a list, in order."""
    p = table(spark, d, "customer").selectExpr("c_custkey", f"posexplode(split({META}, ';')) AS (i, part)").where(F.contains("part", F.lit(":")))
    kv = p.select("c_custkey", F.trim(F.split("part", ":")[0]).alias("key"), F.struct("i", F.trim(F.split("part", ":")[1]).alias("v")).alias("iv"))
    return kv.groupBy("c_custkey", "key").agg(F.array_join(F.transform(F.sort_array(F.collect_list("iv")), lambda x: x.v), "|").alias("vals"), F.count("*").alias("n"))


@query("""WITH n AS (SELECT n_nationkey, n_name, n_regionkey, count(c_custkey) AS people FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'South Coast' WHEN 1 THEN 'North Hills' ELSE 'Other Parts' END AS label,
  round(people / nullif(n_nationkey % 4, 0), 6) AS density, sha256(n_name) AS sha, substr(lpad(n_nationkey::VARCHAR, 5, '0'), 1, 4) AS area, regexp_replace(concat(n_regionkey, '.0'), '\\.0$', '') AS code FROM n""")
def sf32_sf33_labels_density(spark, d):
    """Codes to titles, density with no area as null, content hash, padded prefix, codes without ``.0``."""
    n = table(spark, d, "nation").join(table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("people")), "n_nationkey", "left")
    names = F.create_map(F.lit(0), F.lit("south_coast"), F.lit(1), F.lit("north_hills"))
    label = F.initcap(F.replace(F.coalesce(F.try_element_at(names, F.col("n_regionkey")), F.lit("other_parts")), F.lit("_"), F.lit(" ")))
    density = F.round(F.coalesce("people", F.lit(0)) / F.nullif(F.col("n_nationkey") % 4, F.lit(0)), 6)
    return n.select("n_nationkey", label.alias("label"), density.alias("density"), F.sha2("n_name", 256).alias("sha"), F.substring(expr.zero_pad(F.col("n_nationkey").cast("string"), 5), 1, 4).alias("area"), F.regexp_replace(F.concat(F.col("n_regionkey").cast("string"), F.lit(".0")), r"\.0$", "").alias("code"))
