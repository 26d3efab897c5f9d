"""URL rules and language models against plain Python, on odd, long and repeated URLs."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import duckdb
from pyspark.sql import functions as F

from lodestream.llm import url_filters as U

SCHEMA = "page_id bigint, url string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    return lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def plain(url):
    return re.sub(U._OTHER, "*", lower(url or ""))


def grams(text):
    marked = "^" * (U.ORDER - 1) + text + "$"
    return [marked[i : i + U.ORDER] for i in range(len(text) + 1)]


def brute(rows):
    """(host, path, rule, verdict, score) of each row."""
    found = [(*parts(url), *rule(*parts(url)), plain(url)) for _, url in rows]
    a, b = ({u for *_, v, u in found if v == k} for k in ("allow", "block"))
    held = {u for u in a | b if zlib.crc32(u.encode()) % 4 == 0}
    counts = [collections.Counter(), collections.Counter()]
    for c, urls in zip(counts, (a, b)):
        for u in urls - held:
            for g in grams(u):
                for n in range(1, U.ORDER + 1):
                    c[g[-n:]] += 1
                    c["context", g[-n:-1]] += 1

    def value(g):
        p = [1 / (len(U.KEPT) + 2)] * 2
        for n in range(1, U.ORDER + 1):
            if sum(c["context", g[-n:-1]] for c in counts) >= U.SEEN:
                p = [(c[g[-n:]] + U.SMOOTH * x) / (c["context", g[-n:-1]] + U.SMOOTH) for c, x in zip(counts, p)]
        return math.floor(1e6 * (math.log(p[0]) - math.log(p[1])) + 0.5)

    score = {u: math.floor(sum(map(value, grams(u))) / (len(u) + 1)) for u in {x[-1] for x in found}}
    step = {u: min(max(math.floor(s / U.STEP), -U.FAR), U.FAR) for u, s in score.items()}
    na, nb, least = len(a & held), len(b & held), 0
    if na and nb:
        tried = {step[u] for u in held} | {max(step[u] for u in held) + 1}
        least = min((sum(step[u] < t for u in a & held) * nb + sum(step[u] >= t for u in b & held) * na, abs(t), t) for t in tried)[2]
    return [(h, p, r, v or ("allow" if math.floor(score[u] / U.STEP) >= least else "block"), None if r else score[u]) for h, p, r, v, u in found]


def odd():
    draw = random.Random(8)
    urls = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.ORG/ES/x", "http://example.org/en/12?a=/fr/", "https://x.com#/fr/", "a://b.com/fr/?q", "http://org/", "http://evilorg/x", "http://a.example.org:80/es/", "http://日本.org/é", "http://x.net/" + "ab/" * 9000, "http://x.com/fr\n/z", "^$*"]
    for _ in range(300):
        urls.append(f"http{draw.choice(['', 's'])}://{draw.choice(['www.', 'blog.', ''])}{draw.choice(['thor', 'pills', 'spam', 'Tion'])}.example.{draw.choice(['org', 'com', 'net'])}/{draw.choice(['en', 'es', 'de', 'fr'])}/{draw.randint(0, 300)}{draw.choice(['', '#top', '?page=2'])}")
    return [(k if k % 9 else None, u) for k, u in enumerate(urls)] + [(7, urls[-1])] * 40


def judged(df):
    return [tuple(r) for r in U.judge(df).orderBy("n").select("host", "path", "rule", "verdict", "score").collect()]


def test_against_plain_python(spark):
    rows = odd()
    df = spark.createDataFrame([(n, *r, "clash") for n, r in enumerate(rows)], "n int, page_id bigint, url string, host string").repartition(7)
    assert judged(df) == brute(rows)


def test_one_kind_of_label_or_none(spark):
    for urls in (["http://a.org/", "http://b.net/x", None], ["http://b.net/x"], ["http://x.com/de/", "http://c.net/"], []):
        rows = list(enumerate(urls))
        df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, page_id bigint, url string")
        assert judged(df) == brute(rows)


def test_other_rules_and_none(spark):
    df = spark.createDataFrame([(0, 1, "http://a.b.c/x/y"), (1, 2, "http://b.c/x")], "n int, page_id bigint, url string")
    got = U.ruled(df, [("block", "c", "/x"), ("allow", "b.c", "/x/")]).orderBy("n").select("rule", "verdict").collect()
    assert [tuple(r) for r in got] == [("b.c/x/", "allow"), ("c/x", "block")]
    assert [r["verdict"] for r in U.judge(df, []).collect()] == ["allow", "allow"]


def test_sql_agrees_on_odd_urls(spark, tmp_path):
    spark.createDataFrame(odd(), SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    ours = sorted(map(str, map(tuple, U.op13_url_filters(spark, str(tmp_path)).collect())))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert ours == sorted(map(str, con.sql(U.SQL).fetchall()))


def test_models_judge_hosts_that_no_rule_has(spark):
    """Rules know languages below .com and .org only; the models should find the same below .net."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    language = F.regexp_extract("path", "^/(fr|de|es)/", 1)
    rows = U.judge(pages).where(F.endswith(F.col("host"), F.lit(".net")) & (language != "")).select(language.alias("l"), "verdict").collect()
    assert len(rows) > 300 and sum((r["l"] == "fr") == (r["verdict"] == "allow") for r in rows) / len(rows) > 0.9
