"""The corpus operators against brute force, and on odd rows: nulls, empty and long texts, repeats, empty tables."""

from __future__ import annotations

import collections
import decimal
import hashlib
import io
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestream.llm import bpe, fingerprints, language_id, minhash, mixing, quality_model, quality_rules, suffix_dedup, token_codes, warc
from lodestream.llm.common import shared_dir, utf8
from lodestream.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def text(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdeéß日", k=draw.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in each column, empty, blank and long texts, equal texts, a repeated row, near copies."""
    base, long = text(1, 300), text(2, 30_000)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base + " tail", "en", None, None), (4, None, None, "b", 0), (5, "", "fr", "b", 0),
        (6, " \n\t ", None, "a", 4), (7, long, "de", "a", 1), (8, "x" + long, "de", "c", 1), (9, "<|endoftext|> it's  \n\n 12", "fr", "a", 2), (9, "<|endoftext|> it's  \n\n 12", "fr", "a", 2),
        (10, "a b c", "en", "a", 5), (-3, "é" * 400, "fr", "a", 400),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def texts(df) -> list[tuple[int, str]]:
    return sorted((r["doc_id"], r["text"] or "") for r in df.collect())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, SF), con.sql(SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    # Values as Python has them: pandas writes a null of an integer column in several ways.
    found = [sorted((repr(tuple(r[k] for k in map(names.index, columns))) for r in rows)) for names, rows in ((ours.columns, ours.collect()), (theirs.columns, theirs.fetchall()))]
    assert found[0] == found[1]


def test_bpe_and_codes_are_exact(spark, odd):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        plain = bpe.tokenizer(name)
        want = [(i, plain.encode(t, add_special_tokens=False).ids) for i, t in texts(odd)]
        if name.startswith("byte"):
            got = sorted((r["doc_id"], r["ids"]) for r in bpe.encode(odd, name).collect())
            assert got == want
        else:
            folder = shared_dir(spark)
            found = token_codes.read_tokens(token_codes.write_tokens(odd, folder, name, 3), folder).collect()
            assert sorted((r["doc_id"], r["ids"]) for r in found) == [(i, [*x, 1]) for i, x in want]
            at = 0
            for r in sorted(found, key=lambda r: r["start"]):
                assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
                at += r["n_tokens"]


#: Words, marks, spaces of all kinds, specials and characters whose lower case or composition changes their number.
PARTS = ["a", "b", "Zß", " ", "  ", "\n", "'", "s", "'ll", "don't", "1", "é", "\u0301", "<|endoftext|>", "<|startoftext|>", "-", "漢", "\u00a0", "\t", "\x1c", "İ", "😀", " \u2028", ".", ",", "#", "<", "|", ">", "\0", "\r"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_parts_and_chunks_encode_as_the_whole_text(name, monkeypatch):
    draw = random.Random(7)
    odd = ["".join(draw.choices(PARTS, k=draw.randrange(30))) for _ in range(20_000)]
    odd += ["".join(draw.choices([" word", " and", ", x", "\nY", "\n\n", "!", "1", *PARTS[:3]], k=2000)) for _ in range(40)] + ["漢字" * 2000, " a" * 4000, "a" * 5000, "\n" * 3000, "<|endoftext|>" * 300]
    enc = bpe.Encoder(name)
    assert enc.by_parts and (enc.pieces is not None) == name.startswith("byte")
    data, edges = utf8(pa.RecordBatch.from_arrays([pa.array(odd)], ["text"]))
    wanted = [x.ids for x in enc.model.encode_batch(odd, add_special_tokens=False)]
    _, ends, ids = enc.encode(data, edges)
    assert [x.tolist() for x in np.split(ids, ends[1:-1])] == wanted
    for bits in (4, 10):  # chunks of 16 and 1024 bytes
        monkeypatch.setattr(bpe, "CHUNK_BITS", bits)
        assert [x.tolist() for x in bpe.encoded(data, edges, enc, {})] == wanted
    assert enc.decode(ids, ends) == enc.model.decode_batch(wanted, skip_special_tokens=False)


def test_joins_grow_until_both_sides_agree():
    enc = bpe.Encoder("byte_bpe_50k.json")
    words = [f" w{k}" for k in range(40)]
    chunks = []
    for k in range(0, 40, 10):
        data = "".join(words[k : k + 10]).encode()
        at, ends, ids = enc.parts(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        chunks.append(bpe.Chunk(at, ends, ids))
    asked = []

    def encode(texts):  # an encoder that is wrong about narrow windows
        asked.append(texts)
        found = enc.model.encode_batch(texts, add_special_tokens=False)
        return [x.ids if len(t) > 40 else [0, *x.ids[1:-1], 0] for t, x in zip(texts, found)]

    [ids] = bpe.repaired([("".join(words).encode(), chunks)], encode)
    assert ids.tolist() == enc.model.encode("".join(words), add_special_tokens=False).ids
    assert len(asked) > 1 and max(map(len, asked[0])) < 40


def test_codes_random_access():
    class Held(io.BytesIO):
        def read_at(self, n, at):
            return self.getvalue()[at : at + n]

    ids = np.random.default_rng(5).choice([0, 1, 255, 256, 65_535, 70_000, 2**32 - 1], 5000).astype(np.uint32)
    out = Held()
    token_codes.write_codes(out, [1, None], np.array([2000, 5000]), ids)
    codes = token_codes.Codes(out)
    for a, b in [(0, 5000), (63, 65), (64, 64), (4999, 5000), *((i, i + 1) for i in range(0, 5000, 97))]:
        assert (codes.read(a, b) == ids[a:b]).all()


def plain_scores(train: list[tuple[str | None, str | None]], text: str) -> dict[str, float]:
    """Multinomial naive Bayes from its definition, over the same buckets."""
    def buckets(t: str) -> list[int]:
        out = []
        for k in language_id.ORDERS:
            for i in range(len(t) - k + 1):
                h = k
                for c in t[i : i + k]:
                    h = (h * 0x100000001B3 + ord(c)) % 2**64
                out.append(int(language_id.mix(np.array([h], np.uint64))[0] % np.uint64(language_id.BUCKETS)))
        return out

    counts: dict[str, collections.Counter] = {}
    n = collections.Counter()
    for t, lang in train:
        if lang is not None and language_id.letters(t):
            counts.setdefault(lang, collections.Counter()).update(buckets(language_id.letters(t)))
            n[lang] += 1
    out = {}
    for lang, own in counts.items():
        total = sum(own.values()) + language_id.ALPHA * language_id.BUCKETS
        out[lang] = math.log(n[lang] / sum(n.values())) + sum(math.log((own[b] + language_id.ALPHA) / total) for b in buckets(language_id.letters(text)))
    return out


@pytest.mark.parametrize("block", [256, 2])
def test_languages_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK", block)
    draw = random.Random(8)
    words = {"aa": "the of and to in", "bb": "der die und das", "cc": "le la les et", "dd": "и в не на", "und": "xq qx xx qq", None: "zz zy"}
    rows = [(k, " ".join(draw.choices(words[lang].split(), k=draw.randrange(1, 30))), lang) for k, lang in enumerate(draw.choices(list(words), k=120))]
    odd = [(200, None, "aa"), (201, "", "aa"), (202, "½ ² Ⅷ 12 _", "bb"), (203, "\u0301", "bb"), (204, "the Ünd  " * 3000, None), (205, "q", None), (206, "x", None), (206, "x", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string")
    blocks = language_id.train(docs.where("doc_id < 200"))
    assert len(blocks) == (1 if block == 256 else 3)
    found = sorted(map(tuple, language_id.predict(docs.withColumn("score", F.lit("clash")), blocks).select("doc_id", "lang_pred", "score").collect()))
    assert [r[0] for r in found] == sorted(r[0] for r in rows + odd)
    train = [(t, lang) for i, t, lang in rows + odd if i < 200]
    by_id = {i: t for i, t, _ in rows + odd}
    for i, lang, score in found:
        if not any(c.isalpha() for c in by_id[i] or ""):
            assert (lang, score) == ("und", 0.0)
            continue
        wanted = plain_scores(train, by_id[i])
        top = max(wanted.values())
        assert lang == min(x for x, v in wanted.items() if v > top - 1e-6)
        assert abs(score - 1 / sum(math.exp(v - top) for v in wanted.values())) < 1e-6


def test_texts_that_share_an_id_lose_no_text(spark):
    a, b = text(70, 80), text(71, 80)
    docs = spark.createDataFrame([(3, a, "en", "a", 1), (5, a, "en", "a", 1), (5, b, "en", "a", 1), (5, b, "en", "a", 1), (9, b, "en", "a", 1), (None, b, "en", "a", 1)], COLUMNS)
    kept = collections.Counter((r["doc_id"], r["text"], bytes(r["kept"]).decode()) for r in suffix_dedup.remove_repeats(docs).collect())
    own = [k for k in kept if k[2]]
    # b stays once at least: at the id 5, or at 9 where its place at 5 is a later one.
    assert (3, a, a) in own and (5, a, "") in kept and {k[1] for k in own} == {a, b} and (None, b, b) in own
    assert kept[(5, b, b)] == 2 or kept[(9, b, b)] == 1


def brute_removed(rows: list[tuple[int, str]]) -> dict[int, tuple]:
    seen, out = {}, {}
    for i, t in rows:
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            if seen.setdefault(data[s : s + 100], (i, s)) != (i, s):
                gone[s : s + 100] = True
        out[i] = (len(data), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), bytes(np.frombuffer(data, np.uint8)[~gone]))
    return out


def test_repeats_are_removed_exactly(spark, odd):
    shared = text(3, 40)
    more = [(100 + k, f"{text(50 + k, 30)} {shared[k:]} {text(90 + k, 30)} {shared[: 200 - k]}", "en", "a", 1) for k in range(25)]
    more += [(200, "ab" * 300, "en", "a", 1), (201, "ab" * 60 + "c", "en", "a", 1)]
    docs = odd.union(spark.createDataFrame(more, COLUMNS))
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert found == brute_removed(texts(docs))


def test_near_duplicates_match_brute_force(spark, odd):
    base = text(7, 120).split()
    near = [(1000 + k, " ".join(w if i % 97 != k else f"w{k}" for i, w in enumerate(base)), "en", "a", 1) for k in range(60)]
    docs = odd.union(spark.createDataFrame(near, COLUMNS))
    sets = {i: set(minhash.shingles(t).tolist()) for i, t in texts(docs)}
    top = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                    top[a] = top[b] = min(top[a], top[b])
        if all(top[top[a]] == top[a] for a in top):
            break
    found = minhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == {i: (len(s), top[i], top[i] == i) for i, s in sets.items()}
    assert len(found) == docs.count()


def test_pipeline_links_from_eighty_percent(spark):
    import corpus_pipeline

    rows = []
    for k, changed in enumerate([7, 8, 9, 12]):
        words = [f"w{k}x{i}" for i in range(400)]
        rows += [(10 * k, " ".join(words), "en", "a", 1), (10 * k + 1, " ".join("new" if i % 30 == 15 and i < 30 * changed else w for i, w in enumerate(words)), "en", "a", 1)]
    sets = [set(minhash.shingles(r[1]).tolist()) for r in rows]
    alike = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert all(0.79 < x < 0.85 for x in alike[:3]) and alike[3] < 0.79
    found = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, COLUMNS), SF).collect())
    assert found == sorted(r[0] for i, r in enumerate(rows) if i % 2 == 0 or alike[i // 2] < 0.8)


def test_banding_misses_no_borderline_pair():
    draw = np.random.default_rng(11).integers(0, 2**64, (10_000, 108), dtype=np.uint64)
    (a, b), (c, d) = minhash.band_keys(list(draw[:, :100])), minhash.band_keys(list(np.c_[draw[:, :92], draw[:, 100:]]))  # 92 of 108: 0.852
    assert np.count_nonzero(~((a == c).any(axis=1) & (b == d).any(axis=1))) <= 1


def test_shingles_are_those_of_the_words():
    draw = random.Random(5)
    odd = ["".join(draw.choices(["a", "B", "é", "\u00a0", "日", " ", "\t", "\n", "\x0b", "\x1c", "xyz ", "Q "], k=draw.randrange(60))) for _ in range(3000)] + ["", "w " * 5000, " ".join(map(str, range(200_000)))]
    data, edges = utf8(pa.RecordBatch.from_arrays([pa.array(odd)], ["text"]))
    names: dict[int, tuple] = {}
    for t, own in zip(odd, minhash.shingle_hashes(data, edges)):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        wanted = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        assert len(own) == len(wanted) and own.tolist() == sorted(set(own.tolist())) and own.tolist() == minhash.shingles(t).tolist()
        if len(wanted) == 1:
            assert names.setdefault(int(own[0]), next(iter(wanted))) == next(iter(wanted))


def test_close_pairs_keep_every_link_and_few_others(spark):
    draw = random.Random(3)
    rows = []
    for k in range(60):  # of a template, at a similarity of about 0.8
        rows.append((k, [f"t{i}" for i in range(180)] + [f"o{k}x{i}" for i in range(16)]))
    for k in range(60, 100):  # chains of copies, each cut and changed anew, in sizes apart
        base = [f"c{k % 4}x{i}" for i in range(150 + 5 * (k % 3))]
        at = draw.randrange(150)
        rows.append((k, base[: 150 - draw.randrange(9)] if k % 2 else base[:at] + ["new", f"n{k}"] + base[at + 1 :]))
    docs = spark.createDataFrame([(k, " ".join(w), k) for k, w in rows], "doc_id bigint, text string, component bigint")
    sets = minhash.shingle_sets(docs.select("doc_id"), docs)
    held = {r["doc_id"]: set(r["found"]) for r in sets.collect()}
    for percent in (80, 85):
        for outer in ("true", "doc_id % 3 = 0"):
            found = {tuple(r) for r in minhash.close_pairs(docs.selectExpr("doc_id", "component", f"{outer} AS outer"), sets, percent).collect()}
            links = {(a, b) for a in held for b in held if a < b and 100 * len(held[a] & held[b]) >= percent * len(held[a] | held[b])}
            links = {p for p in links if outer == "true" or any(i % 3 == 0 for i in p)}
            assert len(links) > 50 and links <= found
            if percent == 85:
                assert not any(b < 60 for _, b in found)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 50), (60, 100)]
    found = {r["id"]: r["component"] for r in minhash.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 50: 50, 60: 50, 100: 50}


def test_rules_ledger(odd):
    entries = quality_rules.apply_policy(quality_rules.ledger(odd))
    assert entries.count() == 12 and not any(r["kept"] for r in entries.where("coalesce(text, '') = ''").collect())
    assert {r["rule"] for r in quality_rules.ablations(entries).collect()} == set(quality_rules.RULES)
    assert quality_rules.measure("a b c a b c x") == (7, 7, 0, 0, 6, 1)
    assert quality_rules.measure("a#\na#\n\n b")[2:4] == (2, 1)


@pytest.mark.parametrize("least", [1, 100, 10_000])
def test_fingerprint_blocks_follow_each_other(spark, monkeypatch, least):
    """Ids over the whole range of numbers, dense and sparse, null and repeated: what is next is right across all blocks."""
    ids = [-(2**63), -(2**62), *range(-50, 3000), 10**15, 2**62, 2**63 - 2, 2**63 - 1]
    draw = random.Random(4)
    rows = [(i, " ".join(draw.choices("abcdefgh", k=draw.randrange(0, 9)))) for i in ids] + [(7, "zz top"), (None, "n1"), (None, "n2"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", least)
    n_blocks = fingerprints.blocks(docs).select("_block").distinct().count()
    assert n_blocks > 500 if least == 1 else n_blocks <= 3060 / least + 8
    found = [(r["doc_id"], r["n_chars"], r["edited"]) for r in fingerprints.fingerprints(docs).where("doc_id IS NOT NULL").collect()]
    held = sorted(((i, t) for i, t in rows if i is not None), reverse=True)
    last = [t or "" for i, t in rows if i is None]
    wanted = {}
    for (i, t), (_, after) in zip(held, held[1:]):
        m = len(t) // 3
        wanted.setdefault((i, len(t), t[: len(t) - m] + after[:m]), 0)
    i, t = held[-1]
    ends = {(i, len(t), t[: len(t) - len(t) // 3] + x[: len(t) // 3]) for x in last}
    assert len(found) == len(held) and {x for x in found if x[0] != i} == {x for x in wanted if x[0] != i} and any(x in ends for x in found)


def test_fingerprints(spark, odd):
    found = {r["doc_id"]: r for r in fingerprints.fingerprints(odd.dropDuplicates(["doc_id"])).collect()}
    assert found[1]["fingerprint"] == found[2]["fingerprint"] and found[2]["near_next"] == 1 and found[4]["fingerprint"] == ""
    order = [(r["doc_id"], r["text"] or "") for r in odd.dropDuplicates(["doc_id"]).orderBy("doc_id", ascending=False).collect()]
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        m = len(t) // 3
        assert found[i]["n_chars"] == len(t) and found[i]["edited"] == t[: len(t) - m] + after[:m]
    true = lambda a, b: len(a & b) / len(a | b)
    sets = {i: set(minhash.shingles(t.lower()).tolist()) for i, t in order}
    assert abs(found[3]["near_next"] - true(sets[3], sets[2])) < 0.1


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a", "<p>é</p>"), (2, "http://b\r\nX: y", "<p>é</p>"), (3, None, None), (4, "u", ""), (None, "v", "z" * 3_000_000)], "page_id bigint, url string, html string")
    folder = shared_dir(spark)
    found = {r["page_id"]: r for r in warc.read_archives(warc.normalise(warc.write_archives(pages, folder), folder), folder).collect()}
    assert [(found[i]["record_type"], found[i]["refers_to"]) for i in (1, 2, 3, 4, None)] == [("response", None), ("revisit", 1), ("response", None), ("revisit", 3), ("response", None)]
    assert found[None]["payload"] == b"z" * 3_000_000 and found[2]["payload_bytes"] == 9 and found[2]["payload_digest"] == warc.digest("<p>é</p>".encode())


def test_learned_models_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    langs = QUERIES["op1_language_id"](spark, sf).toPandas().merge(docs[["doc_id", "lang"]], on="doc_id")
    out = langs[langs.held_out & langs.lang.notna()]
    assert (out.lang_pred == out.lang).mean() > 0.98 and langs.score.between(0, 1).all()
    marks = QUERIES["op3_quality_classifier"](spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    out = marks[marks.held_out]
    assert (out.predicted == out.quality).mean() > 0.9


def test_mix_rates(spark, odd):
    wide = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 4 = 0, 'small', 'large') AS source", "1 AS copy")
    counts = {r["source"]: r["count"] for r in mixing.mix_sources(wide, {"small": 1, "large": 1}).groupBy("source").count().collect()}
    assert all(abs(n - 10_000) < 400 for n in counts.values())
    assert mixing.mix_sources(odd, {None: 1.0}).select("doc_id").distinct().count() <= 1


def exact_draw(rate: float, doc_id: int | None) -> int:
    """Inverts the distribution with 60 digits."""
    with decimal.localcontext(prec=60):
        u = decimal.Decimal(int(hashlib.md5(f"17:{'~' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16)) / 2**52
        r, n = decimal.Decimal(rate), 0
        p = c = (-r).exp()
        while c <= u:
            n += 1
            p *= r / n
            c += p
        return n


def test_mix_high_rates(spark):
    skewed = lambda n: spark.range(n).selectExpr("id AS doc_id", "string(id) AS text", "'en' AS lang", "if(id = 77, null, 'hot') AS source", "id AS n_chars")
    held = skewed(1_200_001)
    [rate] = [r["rate"] for r in mixing.rates(held).where("source IS NULL").collect()]
    found = mixing.mix_sources(held).where("source IS NULL").collect()
    assert rate > 1000 and sorted(r["copy"] for r in found) == list(range(1, exact_draw(rate, 77) + 1))
    assert all(r["doc_id"] == 77 and r["shuffle_key"] == hashlib.md5(f"17s:77:{r['copy']}".encode()).hexdigest() for r in found)
    many = spark.range(40_000).selectExpr("if(id = 9, null, id) AS doc_id", "if(id < 10, 'rare', 'large') AS source")
    found = {r["doc_id"]: r["count"] for r in mixing.mix_sources(many, {"rare": 3, "large": 1}).where("source = 'rare'").groupBy("doc_id").count().collect()}
    assert found == {i: exact_draw(3000.0, i) for i in [*range(9), None]}
    documents = skewed(300_001).toPandas()  # noqa: F841
    theirs = duckdb.sql(f"SELECT source, count(*) AS n, max(copy) AS top FROM ({mixing.SQL}) GROUP BY source ORDER BY source").fetchall()
    ours = mixing.mix_sources(skewed(300_001)).groupBy("source").agg({"*": "count", "copy": "max"}).toDF("source", "n", "top").collect()
    assert {tuple(r) for r in ours} == set(theirs)


def test_empty_tables(spark, empty):
    stats = empty.selectExpr("doc_id", "true AS held_out", "text").mapInArrow(quality_model._statistics, "doc_id bigint, held_out boolean, x array<double>")
    made = [
        language_id.predict(empty.select("doc_id", "text"), language_id.train(empty)), quality_model.score(stats, {"share": 0.5}), quality_rules.ledger(empty), minhash.near_duplicates(empty), bpe.encode(empty),
        suffix_dedup.remove_repeats(empty), fingerprints.fingerprints(empty), mixing.mix_sources(empty),
    ]
    assert [x.count() for x in made] == [0] * len(made)
    folder = shared_dir(spark)
    assert token_codes.read_tokens(token_codes.write_tokens(empty, folder), folder).count() == 0


def plain_pipeline(rows: list[tuple]) -> dict[int, tuple[int, list[int]]]:
    """The five stages in plain Python: {doc_id: (copies, ids)}."""
    held = []
    for i, t, *more in rows:
        n_words, chars, symbols, dup_lines, repeats, lines = quality_rules.measure(t or "")
        if not (n_words < 50 or 100 * repeats > 50 * n_words or 10 * symbols > n_words or 10 * dup_lines > 3 * lines or chars < 2 * n_words or chars > 20 * n_words):
            held.append((i, t, *more))
    sets = {r[0]: set(minhash.shingles(r[1]).tolist()) for r in held}
    top = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    top[a] = top[b] = min(top[a], top[b])
    held = sorted(r for r in held if top[r[0]] == r[0])
    left = {i: x[3] for i, x in brute_removed([r[:2] for r in held]).items()}
    n = collections.Counter(r[3] for r in held)
    total = sum(math.sqrt(v) for v in n.values())
    model, out = bpe.tokenizer("byte_bpe_50k.json"), {}
    for i, _, _, source, _ in held:
        copies = exact_draw(math.sqrt(n[source]) * len(held) / (total * n[source]), i)
        if copies:
            out[i] = (copies, model.encode(left[i].decode("utf-8", "ignore"), add_special_tokens=False).ids)
    return out


def test_pipeline_matches_plain_stages(spark, tmp_path):
    import corpus_pipeline

    base, shared = text(40, 200), text(41, 60)
    rows = [(k, f"{text(300 + k, 80)} {shared if k % 3 == 0 else ''} {text(400 + k, 60)}.\n" + ("\ufffd é日" if k % 2 else "end"), "en", ["hot", "hot", "hot", "b", None][k % 5], k) for k in range(30)]
    rows += [(100 + k, " ".join(w if i % 90 != 2 * k else f"x{k}" for i, w in enumerate(base.split())), "de", "hot", None) for k in range(6)]
    rows += [(200, None, "en", "b", 0), (201, "", "en", "b", 0), (202, "too few", None, "b", 7), (203, "# $ % " * 40, "en", "b", 1), (204, text(50, 9000), "fr", "b", 1)]
    spark.createDataFrame(rows, COLUMNS).withColumn("bits", F.lit("clash")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    wanted = plain_pipeline(rows)
    assert len(wanted) > 15 and collections.Counter(r["doc_id"] for r in found) == {i: n for i, (n, _) in wanted.items()}
    assert all(r["ids"] == wanted[r["doc_id"]][1] and r["n_tokens"] == len(r["ids"]) for r in found)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_crafted_long_words_are_told_apart(spark):
    """Complementary Thue-Morse words, which polynomials modulo 2**64 take for one another; and equal long words."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(4096))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"one two three four {word}"), (2, f"one two three four {other}"), (3, f"ONE two three four {word}"), (4, word + "x"), (5, other + "x")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
