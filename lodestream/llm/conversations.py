r"""Conversation repair by signature: each distinct sequence of roles and faults is solved once.

A row's code is a letter for its role's initial (s, u, a, or other) and its first fault: blank, duplicate (role and text
seen earlier in the conversation), truncated. The codes of a conversation in order are its signature. The cheapest edits
that leave roles of initials ``(s?(ua)+)?`` follow from the signature alone, so distinct signatures are solved by
memoised recursion from the end, joined back and replayed on the rows.

Long conversations are cut into pieces of up to 2**PIECE_BITS rows. What a piece needs to know of all that follows is four costs
(one for each state of the pattern), less their least, and how the four audits compare; a stream from the last piece to
the first carries these, one from the first to the last the state in which each piece starts. So a conversation of any
length is a stream of short strings, and nothing but the running state is held. Equal (signature, what follows, start)
are solved once. Only the hash of a repaired conversation reads all of its lines in one task, as a stream.

Rows of a conversation go by turn, nulls first; rows that share a turn by role, then by the sha256 of role and text.
Null roles and texts are one space; a role of another initial, or an empty one, can't be kept. Rows with a null conv_id
are one conversation (null). Other columns are passed over. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import cut
from lodestream.operators.ranges import ranged

#: A piece has the rows whose numbers agree but for so many low bits.
PIECE_BITS = 8
#: Costs of the edits, and the added cost of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: Space and the ASCII controls from tab to carriage return.
GAPS = " \t\n\x0b\x0c\r"
#: Codes by role class (s, u, a, other): sound, truncated, to be deleted.
SOUND, TRUNCATED, DELETED = "suao", "SUAO", "wxyz"

#: States of ``(s?(ua)+)?``: 0 nothing yet, 1 after s, 2 after u, 3 after a. What may be kept, and where it leads.
_KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The one role that can be inserted, or given, in each state, and where it leads.
_GIVEN = (("u", 2), ("u", 2), ("a", 3), ("u", 2))

#: What follows a place: for each state the cost of the cheapest edits, and the place of its audit among the four; and
#: whether nothing follows.
Ahead = tuple[tuple[int, int, int, int], tuple[int, int, int, int], bool]


def _level(found: list[tuple[int, tuple, str, int]]) -> tuple[Ahead, tuple[tuple[str, int], ...]]:
    """From the best step without an insertion in each state (cost, order of its audit, step, next state): what the place
    is to rows before it, and the step that each state takes; insertions stay at the place."""
    best = list(found)
    for q in (2, 3, 0, 1):
        role, to = _GIVEN[q]
        cost, order, _, _ = found[to] if q in (2, 3) else best[to]
        best[q] = min(best[q], (cost + INSERT, ("I", *order), f"I{role}", to))
    ranks = {x: k for k, x in enumerate(sorted({order for _, order, _, _ in best}))}
    ahead = tuple(x[0] for x in best), tuple(ranks[x[1]] for x in best), False
    return ahead, tuple((step, to) for _, _, step, to in best)


_LEVEL, _END_STEPS = _level([(0, ("",), "", 0), (10**6, ("~",), "", 1), (10**6, ("~",), "", 2), (0, ("",), "", 3)])
END: Ahead = (*_LEVEL[:2], True)


@lru_cache(1 << 12)
def _row(code: str, ahead: Ahead) -> tuple[Ahead, tuple[tuple[str, int], ...]]:
    """The level of one row before what follows."""
    costs, ranks, _ = ahead
    found = []
    for q in range(4):
        options = [(costs[q] + DELETE, ("D", ranks[q]), "D", q)]
        if code not in DELETED:
            more, role = (0 if code in SOUND else CUT_OFF), code.lower()
            if role in _KEPT[q]:
                to = _KEPT[q][role]
                options.append((costs[to] + KEEP + more, ("K", ranks[to]), "K", to))
            given, to = _GIVEN[q]
            options.append((costs[to] + REROLE + more, ("R", ranks[to]), f"R{given}", to))
        found.append(min(options))
    return _level(found)


@lru_cache(1 << 16)
def before(signature: str, ahead: Ahead) -> Ahead:
    """What a piece and all after it are to rows before it; costs less the least of them."""
    if not signature:
        return ahead
    costs, ranks, _ = _row(signature[0], before(signature[1:], ahead))[0]
    return tuple(c - min(costs) for c in costs), ranks, False


def solve(signature: str, ahead: Ahead, start: int) -> tuple[list[str], int, int]:
    """(tokens, cost, end state) of a piece: a token a row, the steps before and on it (at the very end, after it)."""
    tokens, state = [], start
    for k, code in enumerate(signature):
        steps, token = _row(code, before(signature[k + 1 :], ahead))[1], ""
        while True:
            step, state = steps[state]
            token += step
            if step[0] != "I":
                break
        tokens.append(token)
    while ahead[2] and tokens and _END_STEPS[state][0]:
        step, state = _END_STEPS[state]
        tokens[-1] += step
    said = "".join(tokens)
    stays = sum(code in TRUNCATED and "D" not in token for code, token in zip(signature, tokens))
    return tokens, REROLE * said.count("R") + DELETE * said.count("D") + INSERT * said.count("I") + CUT_OFF * stays, state


def illegal(signature: str) -> int:
    """Neighbours whose roles don't follow one another."""
    roles = signature.lower().translate(str.maketrans(DELETED, SOUND))
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


def _text(ahead: Ahead) -> str:
    return "/".join(" ".join(map(str, x)) for x in (*ahead[:2], (int(ahead[2]),)))


def _ahead(text: str) -> Ahead:
    costs, ranks, final = (tuple(map(int, x.split())) for x in text.split("/"))
    return costs, ranks, bool(final[0])


def _added(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])


def _from_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces from a conversation's last to its first: adds ``ahead``. The state is worked out where another piece asks for it."""
    last = None
    for b in batches:
        out = []
        for conv, signature in zip(b.column("conv_id").to_pylist(), b.column("signature").to_pylist()):
            ahead = before(last[1], last[2]) if last and last[0] == conv else END
            last = conv, signature, ahead
            out.append(_text(ahead))
        yield _added(b, ahead=pa.array(out, pa.string()))


def _from_the_start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces from a conversation's first to its last: adds ``start`` and whether its first row breaks the order of roles."""
    last = None
    for b in batches:
        starts, broken = [], []
        for conv, signature, ahead in zip(*(b.column(c).to_pylist() for c in ("conv_id", "signature", "ahead"))):
            same = last and last[0] == conv
            start = solve(last[1], _ahead(last[2]), last[3])[2] if same else 0
            starts.append(start), broken.append(illegal(last[1][-1] + signature[0]) if same else 0)
            last = conv, signature, ahead, start
        yield _added(b, start=pa.array(starts, pa.int32()), broken=pa.array(broken, pa.int64()))


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = list(zip(*(b.column(c).to_pylist() for c in ("signature", "ahead", "start"))))
        found = [solve(signature, _ahead(ahead), start) for signature, ahead, start in keys]
        yield _added(b, tokens=pa.array([x[0] for x in found], pa.list_(pa.string())), cost=pa.array([x[1] for x in found], pa.int64()), illegal=pa.array([illegal(x[0]) for x in keys], pa.int64()))


def coded(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with ``at``, a number that grows in order, ``fault`` and ``code``."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = rows.select("conv_id", "turn", *spaced)
    rows = rows.withColumn("_sha", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = ranged(rows, [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("_sha").asc()])
    rows = rows.withColumn("at", F.shiftleft("_p", 33) + F.col("_k")).drop("_p", "_k")
    rows = rows.withColumn("_sha", F.sha2(F.to_json(F.struct("conv_id", "_sha")), 256))
    firsts = cut(rows.groupBy("_sha").agg(F.min("at").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    end = F.rtrim(F.col("text"), F.lit(GAPS))
    fault = F.when(end == "", "blank").when(F.col("at") > F.col("_first"), "duplicate").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    rows = rows.join(firsts, "_sha", "left").withColumn("fault", fault).drop("_sha", "_first")
    kind = F.coalesce(F.nullif(F.instr(F.lit(SOUND[:3]), F.left("role", F.lit(1))) * (F.length("role") > 0).cast("int"), F.lit(0)), F.lit(4))
    letters = F.when(F.col("fault") == "", F.lit(SOUND)).when(F.col("fault") == "truncated", F.lit(TRUNCATED)).otherwise(F.lit(DELETED))
    return cut(rows.withColumn("code", F.substring(letters, kind, F.lit(1))))


def pieces(rows: DataFrame) -> DataFrame:
    """The pieces of coded rows with their edits: conv_id, piece, ats, signature, tokens, cost, illegal, broken."""
    own = rows.groupBy("conv_id", F.shiftright("at", PIECE_BITS).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("x"))
    own = cut(own.select("conv_id", "piece", F.col("x.at").alias("ats"), F.array_join("x.code", "").alias("signature")))
    short = own.select("conv_id", "piece", "signature")
    typed = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in short.schema)
    back = short.repartition("conv_id").sortWithinPartitions("conv_id", F.col("piece").desc()).mapInArrow(_from_the_end, f"{typed}, ahead string")
    forth = back.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_from_the_start, f"{typed}, ahead string, start int, broken bigint")
    forth = cut(forth)
    keys = ["signature", "ahead", "start"]
    solved = cut(forth.select(*keys).distinct().mapInArrow(_solved, "signature string, ahead string, start int, tokens array<string>, cost bigint, illegal bigint"))
    o, s = own.alias("o"), forth.join(solved, keys).alias("s")
    same = (F.col("o.piece") == F.col("s.piece")) & F.col("o.conv_id").eqNullSafe(F.col("s.conv_id"))
    return cut(o.join(s, same).select("o.conv_id", "o.piece", "o.ats", "o.signature", "s.tokens", "s.cost", "s.illegal", "s.broken"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audits (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of the conversations, and their repaired
    rows (conv_id, at, k, turn, role, text, edit), in the order of at and k; inserted rows have the turn of the row they go with."""
    rows = coded(rows)
    solved = pieces(rows)
    faults = ("blank", "duplicate", "truncated")
    turns = rows.groupBy("conv_id", "turn").agg(*[F.count_if(F.col("fault") == x).alias(x) for x in faults])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint")
    counts = turns.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(x).alias(x) for x in faults])
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "tokens"))), lambda x: F.array_join(x.tokens, "")), "")
    audits = solved.groupBy("conv_id").agg(F.sum(F.col("illegal") + F.col("broken")).alias("illegal"), F.sum("cost").alias("cost"), F.regexp_replace(said, "[ua]", "").alias("audit"))
    audits = merged(["conv_id"], counts, audits)
    tokens = solved.select(F.explode(F.arrays_zip("ats", "tokens")).alias("x")).select(F.col("x.ats").alias("at"), F.col("x.tokens").alias("token"))
    steps = rows.join(tokens, "at").select("conv_id", "at", "turn", "role", "text", F.posexplode(F.regexp_extract_all("token", F.lit("([DIKR][ua]?)"), F.lit(0))).alias("k", "step"))
    edit = F.left("step", F.lit(1))
    role = F.when(edit == "K", F.col("role")).when(F.right("step", F.lit(1)) == "u", "user").otherwise("assistant")
    repaired = steps.where(edit != "D").select("conv_id", "at", "k", "turn", role.alias("role"), F.when(edit == "I", "").otherwise(F.col("text")).alias("text"), edit.alias("edit"))
    return audits, repaired


def merged(keys: list[str], *parts: DataFrame) -> DataFrame:
    """One row for each keys, null ones included, with the columns of all parts, each of which has a row for them at most."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    return every.groupBy(*keys).agg(*[F.max(c).alias(c) for c in every.columns if c not in keys])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sha256 of each conversation's lines, joined by line ends, as they stream by."""
    conv = sha = kind = None
    for b in batches:
        out, kind = [], b.schema.field("conv_id").type
        for own, line in zip(b.column("conv_id").to_pylist(), b.column("line").to_pylist()):
            if sha and own == conv:
                sha.update(b"\n")
            else:
                if sha:
                    out.append((conv, sha.hexdigest()))
                conv, sha = own, hashlib.sha256()
            sha.update(line.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], kind), pa.array([x for _, x in out])], ["conv_id", "repaired_sha256"])
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([sha.hexdigest()])], ["conv_id", "repaired_sha256"])


def line_hashes(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the repaired rows' ``role:text`` lines."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    lines = repaired.select("conv_id", "at", "k", F.concat_ws(":", "role", "text").alias("line"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "at", "k").select("conv_id", "line").mapInArrow(_hashed, f"conv_id {kind}, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """Rows damaged by the crc32 of their conversation and turn: dropped, emptied, without full stops, repeated, of role user."""
    role, text, conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text", "conv_id", "turn"))
    hit: Column = F.crc32(F.concat_ws(":", conv, turn).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), hit.alias("_hit")).where("_hit != 0")
    changed = F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_hit") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("_hit") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), times.alias("_t")).drop("_t")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    audits, repaired = repair(damage(rows))
    every = merged(["conv_id"], rows.select("conv_id").distinct(), audits, line_hashes(repaired))
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


#: The states' costs and audits as one text each, costs first in five digits, so that the least text is the answer.
SQL = r"""WITH RECURSIVE bits AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS key FROM conversations),
hits AS (SELECT src.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(key, lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS hit FROM src, tab),
damaged AS (SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
  CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE hit WHEN 3 THEN 2 ELSE 1 END)) AS t FROM hits WHERE hit <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e FROM damaged),
f AS (SELECT *, CASE WHEN e = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  coalesce(left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS kind FROM o),
c AS (SELECT *, CASE fault WHEN '' THEN kind WHEN 'truncated' THEN upper(kind) ELSE 'x' END AS code FROM f),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal, string_agg(code, '' ORDER BY i) AS s FROM c GROUP BY conv_id),
dp AS (SELECT DISTINCT s, length(s) AS i, '00000' AS v0, '00006II' AS v1, '00003I' AS v2, '00000' AS v3 FROM n UNION ALL
  SELECT s, i - 1, least(b0, printf('%05d', w2[:5]::INT + 3) || 'I' || w2[6:]), least(b1, printf('%05d', w2[:5]::INT + 3) || 'I' || w2[6:]), w2, w3 FROM (
  SELECT *, least(b2, printf('%05d', b3[:5]::INT + 3) || 'I' || b3[6:]) AS w2, least(b3, printf('%05d', b2[:5]::INT + 3) || 'I' || b2[6:]) AS w3 FROM (
  SELECT s, i, least(d0, r0, CASE k WHEN 's' THEN k1 WHEN 'u' THEN k2 END) AS b0, least(d1, r0, CASE k WHEN 'u' THEN k2 END) AS b1,
    least(d2, r2, CASE k WHEN 'a' THEN k3 END) AS b2, least(d3, r0, CASE k WHEN 'u' THEN k2 END) AS b3 FROM (
  SELECT s, i, lower(x) AS k, printf('%05d', v0[:5]::INT + 4) || 'D' || v0[6:] AS d0, printf('%05d', v1[:5]::INT + 4) || 'D' || v1[6:] AS d1, printf('%05d', v2[:5]::INT + 4) || 'D' || v2[6:] AS d2, printf('%05d', v3[:5]::INT + 4) || 'D' || v3[6:] AS d3,
    CASE WHEN x <> 'x' THEN printf('%05d', v2[:5]::INT + 3 + m) || 'R' || v2[6:] END AS r0, CASE WHEN x <> 'x' THEN printf('%05d', v3[:5]::INT + 3 + m) || 'R' || v3[6:] END AS r2,
    printf('%05d', v1[:5]::INT + m) || 'K' || v1[6:] AS k1, printf('%05d', v2[:5]::INT + m) || 'K' || v2[6:] AS k2, printf('%05d', v3[:5]::INT + m) || 'K' || v3[6:] AS k3 FROM (
  SELECT *, s[i] AS x, CASE WHEN s[i] IN ('S', 'U', 'A', 'O') THEN 3 ELSE 0 END AS m FROM dp WHERE i > 0))))),
r AS (SELECT n.*, v0[:5]::BIGINT AS cost, v0[6:] AS audit FROM n JOIN (SELECT s, v0 FROM dp WHERE i = 0) USING (s)),
u AS (SELECT conv_id, unnest(string_split(audit, '')) AS step, generate_subscripts(string_split(audit, ''), 1) AS j FROM r),
p AS (SELECT *, count(*) FILTER (step <> 'I') OVER w AS i, count(*) FILTER (step <> 'D') OVER w AS e FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY j ROWS UNBOUNDED PRECEDING)),
q AS (SELECT p.*, c.role, c.text, max(CASE WHEN p.e = 1 AND step = 'K' AND kind = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS led FROM p LEFT JOIN c ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = c.i AND p.step <> 'I'),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN step = 'K' THEN role WHEN (e - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE step WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS sha FROM q WHERE step <> 'D' GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) a
  LEFT JOIN r ON a.conv_id IS NOT DISTINCT FROM r.conv_id LEFT JOIN h ON a.conv_id IS NOT DISTINCT FROM h.conv_id"""
