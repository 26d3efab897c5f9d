"""Importance resampling against plain Python, on odd, long and repeated texts."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from lodestream.llm import importance as I

SCHEMA = "doc_id bigint, text string"


def grams(text):
    plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain)
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(gram):
    return zlib.crc32(gram.encode()) % 10_000


def brute(docs, target):
    s, t = (collections.Counter(bucket(g) for text in texts for g in grams(text)[1]) for texts in ([x for _, x in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1.0) * (big_s + 10_000.0)) / ((s[b] + 1.0) * (big_t + 10_000.0))))
    out = []
    for i, text in docs:
        n, found = grams(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(g)) for g in found)
        out.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0, -x[3]))
    rank = {}
    for k, x in enumerate(able[: 5 * len(able) // 100]):
        rank.setdefault((x[0], x[3]), []).append(k + 1)
    rows = []
    for i, n, m, weight, score in out:
        own = rank.get((i, weight)) if n >= 20 else None
        rows.append((i, m, weight, score, own.pop(0) if own else None))
    return rows


def texts(seed, n):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcXYZ019éß日", k=draw.randint(1, 3)))
    return [draw.choice([" ", ". ", "\n", "-"]).join(word() for _ in range(draw.randint(0, 120))) for _ in range(n)]


def odd():
    docs = list(enumerate(texts(1, 400))) + [(500, None), (501, ""), (502, "..."), (503, "word" * 5000 + " x"), (None, " ".join(["a"] * 40)), (504, "a b " * 6000), (505, "A b\u0000c D`e")]
    return docs + [docs[3], docs[3], (7, texts(2, 1)[0])]


def ranked(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[4] or 0))


def test_against_plain_python(spark):
    docs, target = odd(), [*texts(9, 20), None, ""]
    df = spark.createDataFrame([(*d, "clash") for d in docs], SCHEMA + ", score string").repartition(5)
    got = [tuple(r) for r in I.resample(df, spark.createDataFrame([(x,) for x in target], "text string")).collect()]
    assert ranked(got) == ranked(brute(docs, target))


def test_empty_tables(spark):
    none, docs = spark.createDataFrame([], SCHEMA), odd()[:50]
    assert I.resample(none, none).collect() == []
    got = [tuple(r) for r in I.resample(spark.createDataFrame(docs, SCHEMA), none).collect()]
    assert ranked(got) == ranked(brute(docs, []))


def test_runs_in_short_stretches(monkeypatch):
    """Buckets at every occurrence, whatever the stretches: n-grams reach over their ends, not over those of texts."""
    docs = [(t or "").encode() for _, t in odd()]
    data, edges = np.frombuffer(b"".join(docs), np.uint8), np.cumsum([0, *map(len, docs)])
    wanted = [sorted(bucket(g) for g in grams(t.decode())[1]) for t in docs]
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(I, "STRETCH", size)
        if size < 100:
            part = 60
            data_, edges_ = data[: edges[part]], edges[: part + 1]
        else:
            part, data_, edges_ = len(docs), data, edges
        got = [[] for _ in range(part)]
        for of, _, found in I.features(data_, edges_):
            for order, head, own in found:
                held = np.empty(len(order), np.int64)
                held[order] = np.repeat(own, np.diff(np.r_[head, len(order)]))
                for k, b in zip(of, held):
                    if b >= 0:
                        got[k].append(int(b))
        assert [sorted(x) for x in got] == wanted[:part]


def test_crc_of_joined_texts():
    draw = random.Random(3)
    pairs = [(draw.randbytes(draw.randint(0, 9)), draw.randbytes(draw.choice([0, 1, 5, 300, 70_000]))) for _ in range(60)]
    a, b, size = (np.array(x, np.uint64) for x in ([zlib.crc32(x) for x, _ in pairs], [zlib.crc32(y) for _, y in pairs], [len(y) for _, y in pairs]))
    assert I.joined(a, b, size.astype(np.int64)).tolist() == [zlib.crc32(x + y) for x, y in pairs]


def test_words():
    data = "Ab-cé 9".encode() + b"zz" + "Q".encode()
    words, at = I.split(np.frombuffer(data, np.uint8), np.array([0, 8, 8, 10, 11]))
    assert isinstance(words, pa.Array) and words.to_pylist() == [b"ab", "cé".encode(), b"9", b"zz", b"q"] and at.tolist() == [0, 3, 3, 4, 5]


def test_draws_what_is_like_the_target(spark):
    """Documents in the words of the target are drawn before others."""
    draw = random.Random(6)
    like = lambda letters: " ".join("".join(draw.choices(letters, k=3)) for _ in range(60))
    docs = [(k, like("abc" if k % 10 == 0 else "xyz")) for k in range(600)]
    got = I.resample(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(like("abc"),) for _ in range(30)], "text string")).where("rank IS NOT NULL").collect()
    assert len(got) == 30 and all(r["doc_id"] % 10 == 0 for r in got)
