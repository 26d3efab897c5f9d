"""The quality model and the fingerprints against plain versions of their methods."""

from __future__ import annotations

import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash

from lodestream.llm import fingerprints as P
from lodestream.llm import quality_model as Q

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def write(spark, tmp_path, docs, labels):
    rows = [(i, t, None, None, None) for i, t in docs]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return {r["doc_id"]: r for r in Q.op3_quality_classifier(spark, str(tmp_path)).collect()}


def drawn(seed, n):
    draw = random.Random(seed)
    out = []
    for k in range(n):
        good = k % 2
        words = ["".join(draw.choices("abcdefgh" if good else "xyz#$09", k=draw.randint(1, 9 if good else 20))) for _ in range(draw.randint(1, 90))]
        out.append((k, draw.choice([" ", "\n", ". "] if good else [" ", "|", "\n\n"]).join(words)))
    return out


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def discriminant(x, y):
    """Log-odds of label 1 by two shrunk normal densities, with dense algebra."""
    d = x.shape[1]
    parts = [x[y == k] for k in (0, 1)]
    covs = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(len(p) * c for p, c in zip(parts, covs)) / len(x)
    spread = np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)

    def density(k):
        cov = (1 - Q.SHRINK - Q.RIDGE) * covs[k] + Q.SHRINK * pooled + Q.RIDGE * spread + 1e-6 * np.eye(d)
        mean = parts[k].mean(axis=0)
        return lambda v: -0.5 * ((v - mean) @ np.linalg.solve(cov, v - mean) + np.linalg.slogdet(cov)[1])

    a, b = density(0), density(1)
    prior = np.log(len(parts[1]) / len(parts[0]))
    return lambda v: b(v) - a(v) + prior


def test_scores_equal_a_dense_discriminant(spark, tmp_path):
    docs = drawn(1, 240) + [(300, None), (301, ""), (302, "é — 日本 ☃"), (None, "a null id"), (7, drawn(3, 8)[7][1])]
    labels = [(k, k % 2, 0) for k in range(0, 200)] + [(5, 0, 1), (5, 1, 0), (9, None, 0), (400, 1, 1), (None, 1, 1), (301, 0, None)]
    got = write(spark, tmp_path, docs, labels)
    by = {}
    for i, q, _ in labels:
        if i is not None and q is not None:
            by.setdefault(i, []).append(q)
    marks = {i: int(sum(q) / len(q) + 0.5) for i, q in by.items()}
    train = [(Q.statistics(t or ""), marks[i]) for i, t in docs if i in marks and not held(i)]
    odds = discriminant(np.array([x for x, _ in train]), np.array([y for _, y in train]))
    for i, t in docs:
        if i == 7:
            continue  # two texts share this id
        p = 1 / (1 + np.exp(-np.clip(odds(np.array(Q.statistics(t or ""))), -500, 500)))
        assert abs(got[i]["score"] - p) < 1e-6 and got[i]["held_out"] == held(i) and got[i]["predicted"] == (got[i]["score"] >= 0.5)


@pytest.mark.parametrize("marks, share", [([1], 1.0), ([], 0.5), ([0], 0.0)])
def test_one_class_or_none(spark, tmp_path, marks, share):
    got = write(spark, tmp_path, drawn(2, 30), [(k, m, 0) for k in range(30) for m in marks])
    assert {r["score"] for r in got.values()} == {share}


def test_statistics_of_a_text():
    x = dict(zip(Q.NAMES, Q.statistics("One, two! Ab\nOne, two! Ab\n\n#$ 12345 extraordinarily-long é")))
    words = re.findall(r"\S+", "One, two! Ab One, two! Ab #$ 12345 extraordinarily-long é")
    assert x["words"] == pytest.approx(np.log1p(len(words))) and x["distinct"] == pytest.approx(7 / 10) and x["long_words"] == pytest.approx((1 / 10) ** 0.5)
    assert x["dup_lines"] == pytest.approx((1 / 3) ** 0.5) and x["repeats"] == pytest.approx((2 / 8) ** 0.5) and x["digits"] == pytest.approx((5 / 60) ** 0.5, rel=0.05)


def chained(parts):
    """Spark's xxhash64 of several values: each is hashed with the hash before it as the seed."""
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p, seed=h)
    return h


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def plain_bins(text):
    """One permutation: the least hash of each bin, empty bins by their turns, low bits kept."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    if not words:
        return []
    h = [struct.pack("<q", signed(chained([w.encode()]))) for w in words]
    shingles = {chained(h[i : i + P.SHINGLE]) for i in range(max(1, len(h) - P.SHINGLE + 1))}
    width = 64 - (P.BINS.bit_length() - 1)
    least = {}
    for s in shingles:
        b, low = s >> width, s & ((1 << width) - 1)
        least[b] = min(least.get(b, low), low)
    # In ascending order of signed hashes the bins of the upper half come first.
    order = [(k + P.BINS // 2) % P.BINS for k in range(P.BINS)]
    slots = [least[b] & ((1 << P.BITS) - 1) if b in least else None for b in order]
    turns = [list(map(int, t.split())) for t in P.turns()]

    def filled(b):
        if slots[b] is not None:
            return slots[b]
        for to in turns:
            if slots[to[b]] is not None:
                return slots[to[b]]
        near = min((signed(chained([struct.pack("<i", x), struct.pack("<i", b)])), v) for x, v in enumerate(slots) if v is not None)
        return near[1]

    return [filled(b) for b in range(P.BINS)]


def alike(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    chance = 2.0**-P.BITS
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / P.BINS - chance) / (1 - chance))


def test_fingerprints_equal_a_plain_one_permutation(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdEé", k=draw.randint(1, 4)))
    docs = [(k, " ".join(word() for _ in range(draw.choice([1, 3, 5, 40, 400])))) for k in range(24)]
    docs += [(24, docs[23][1] + " tail"), (25, ""), (26, None), (27, " \n "), (28, docs[20][1])]
    got = {r["doc_id"]: r for r in P.fingerprints(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    order = sorted(((i, t or "") for i, t in docs), reverse=True)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        own, changed, following = plain_bins(t), plain_bins(edited), plain_bins(after)
        pack = lambda bins: "".join(f"{v:0{P.BITS // 4}x}" for v in bins)
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (pack(own), pack(changed)), i
        assert got[i]["near_edited"] == pytest.approx(alike(own, changed)) and got[i]["near_next"] == pytest.approx(alike(own, following))


def test_likeness_estimates_the_similarity(spark):
    """Mean error over pairs of known similarity."""
    draw = random.Random(9)
    sets = []
    for k in range(40):
        words = [f"w{draw.randrange(10**6)}" for _ in range(300)]
        other = words[: 10 + 7 * k] + [f"v{draw.randrange(10**6)}" for _ in range(290 - 7 * k)]
        sets.append((" ".join(words), " ".join(other)))
    rows = [(2 * k + 1, a) for k, (a, _) in enumerate(sets)] + [(2 * k, b) for k, (_, b) in enumerate(sets)]
    got = {r["doc_id"]: r["near_next"] for r in P.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    errors = []
    for k, (a, b) in enumerate(sets):
        x, y = ({tuple(t.split()[i : i + 5]) for i in range(296)} for t in (a, b))
        errors.append(got[2 * k + 1] - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.15
