"""Conversation repair against an exhaustive search, on damaged, odd, long and hot conversations."""

from __future__ import annotations

import functools
import hashlib
import random
import zlib

import duckdb
import pytest

from lodestream.llm import conversations as C

GAP = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 1:
            text = ""
        if hit == 2:
            text = "".join(c for c in text if c not in ".!?")
        if hit == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)


def best(rows):
    """(cost, audit, lines) of rows (role, text, must go, cut off), by trying every edit."""

    @functools.cache
    def after(k, last, inserted):
        """last: 0 nothing, 1 s, 2 u, 3 a; the lines are those from here on."""
        options = [(0, "", ())] if k == len(rows) and last in (0, 3) else []
        given = ("assistant", 3) if last == 2 else ("user", 2)
        if inserted < 3:
            cost, audit, lines = after(k, given[1], inserted + 1)
            options.append((cost + 3, "I" + audit, (given[0] + ":", *lines)))
        if k < len(rows):
            role, text, gone, cut = rows[k]
            cost, audit, lines = after(k + 1, last, 0)
            options.append((cost + 4, "D" + audit, lines))
            if not gone:
                cost, audit, lines = after(k + 1, given[1], 0)
                options.append((cost + 3 + 3 * cut, "R" + audit, (f"{given[0]}:{text}", *lines)))
                to = {"s": 1, "u": 2, "a": 3}.get(role[:1])
                if to and (to == 1 and last == 0 or to == 2 and last != 2 or to == 3 and last == 2):
                    cost, audit, lines = after(k + 1, to, 0)
                    options.append((cost + 3 * cut, "K" + audit, (f"{role}:{text}", *lines)))
        return min(options, default=(10**9, "", ()))

    for k in range(len(rows), -1, -1):  # from the end, so that no recursion is deep
        for last in range(4):
            after(k, last, 0)
    return after(0, 0, 0)


def brute(rows, hurt=True):
    by = {r[0]: [] for r in rows}
    for conv, turn, role, text in damaged(rows) if hurt else rows:
        by[conv].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    out = {}
    for conv, own in by.items():
        own.sort()
        seen, found, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, _, text in own:
            end = text.rstrip(GAP)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                n[fault] += 1
            found.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for known, t, *_ in own if known}
        cost, audit, lines = best(tuple(found))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def query(spark, df, path):
    df.write.parquet(f"{path}/conversations.parquet")
    return {r["conv_id"]: tuple(r)[1:] for r in C.op11_conversation_repair(spark, str(path)).collect()}


def drawn(seed: int, convs: int, longest: int):
    draw = random.Random(seed)
    texts = ["", " \n", "ok.", "ok", "what? ", "no!\n", "a.b", "…", "long " * 400 + "end.", "é.", None]
    roles = ["user"] * 5 + ["assistant"] * 5 + ["system", "tool", "", None, "umbrella", "User"]
    return [(c, draw.choice([k, k, k, 2 * k, None]), draw.choice(roles), draw.choice(texts)) for c in range(convs) for k in range(draw.randint(1, longest))]


def test_against_an_exhaustive_search(spark, tmp_path):
    rows = drawn(1, 250, 6) + [(None, 0, "user", "a."), (None, 1, "assistant", None)] + drawn(2, 1, 3) * 2
    assert query(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), tmp_path) == brute(rows)


def test_long_conversations_in_pieces(spark, tmp_path, monkeypatch):
    """Pieces of four rows; only the plan knows their size."""
    monkeypatch.setattr(C, "PIECE_BITS", 2)
    rows = [(c + 1000, *r[1:]) for c in range(12) for r in drawn(c + 10, 1, 60)]
    rows += [(1, k, "user" if k % 2 == 0 else "assistant", f"line {k}.") for k in range(900)]
    got = query(spark, spark.createDataFrame(rows, SCHEMA), tmp_path)
    assert got == brute(rows)


def test_solving_is_the_same_in_pieces():
    draw = random.Random(5)
    for _ in range(300):
        sig = "".join(draw.choices("suaoSUAOwxyz", weights=[1, 5, 5, 1, 1, 2, 2, 1, 1, 1, 1, 1], k=draw.randint(2, 40)))
        whole, cost, _ = C.solve(sig, C.END, 0)
        cuts = sorted(draw.sample(range(1, len(sig)), min(len(sig) - 1, draw.randint(1, 5))))
        parts = [sig[a:b] for a, b in zip([0, *cuts], [*cuts, len(sig)])]
        aheads = [C.END]
        for p in parts[:0:-1]:
            aheads.insert(0, C.before(p, aheads[0]))
        tokens, total, state = [], 0, 0
        for p, ahead in zip(parts, aheads):
            own, more, state = C.solve(p, C._ahead(C._text(ahead)), state)
            tokens += own
            total += more
        assert (tokens, total) == (whole, cost)


def test_empty_tables_and_extra_columns(spark, tmp_path):
    assert query(spark, spark.createDataFrame([], SCHEMA + ", at int"), tmp_path / "a") == {}
    rows = [(3, 7, "user", "hi.", 1, "x"), (3, 8, "assistant", "yes.", 2, "y")]
    got = query(spark, spark.createDataFrame(rows, SCHEMA + ", at int, audit string"), tmp_path / "b")
    assert got == brute([r[:4] for r in rows])


@pytest.mark.parametrize("seed", [3])
def test_sql_agrees_on_odd_rows(spark, tmp_path, seed):
    rows = drawn(seed, 150, 8)
    got = query(spark, spark.createDataFrame(rows, SCHEMA), tmp_path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert {r[0]: tuple(r[1:]) for r in con.sql(C.SQL).fetchall()} == got


def test_rows_are_repaired(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Again."), (1, 2, "tool", "x"), (2, 0, "system", "S."), (2, 1, "assistant", "A.")]
    audits, repaired = C.repair(spark.createDataFrame(rows, SCHEMA))
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in audits.collect()} == {c: best(tuple((r, t, False, t[-1] != ".") for k, _, r, t in rows if k == c))[:2] for c in (1, 2)}
    made = [(r["role"], r["text"]) for r in repaired.where("conv_id = 2").orderBy("at", "k").collect()]
    assert [f"{a}:{b}" for a, b in made] == list(best((("system", "S.", False, False), ("assistant", "A.", False, False)))[2])
