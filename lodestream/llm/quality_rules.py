"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each text; the ledger holds the measurements and one failure bit for each rule.
Policies are versioned masks over those bits, so verdicts and ablations need the ledger alone.

Null and empty texts have no words and fail ``too_short``; repeated rows each get their own ledger row; an empty
table gives an empty ledger; other columns of the input, whatever their names, are passed over.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestream.llm.common import WORD, cut, documents, rows, texts

#: The bit of each rule.
RULES = {"too_short": 1, "repeated_words": 2, "symbols": 4, "repeated_lines": 8, "word_length": 16}
#: Versioned policies: which rules count.
POLICIES = {
    "base": RULES["too_short"] | RULES["repeated_words"],
    "v1": sum(RULES.values()),
}
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated 3-word windows, lines with a word)."""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    found = Counter(windows)
    covered, upto = 0, 0
    for at, window in enumerate(windows):
        if found[window] > 1:
            covered += at + 3 - max(at, upto)
            upto = at + 3
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(map(text.count, "#*$%&|<>"))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), covered, len(lines)


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows(batches):
        found = list(zip(*map(measure, texts(b)))) or [()] * 6
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64()) for c in found)], [*b.schema.names, *_MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """The rows of docs with the measurements and ``bits``, the rules that each fails; clashing columns are replaced."""
    c = F.col
    fails = {
        "too_short": c("n_words") < 50,
        "repeated_words": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "repeated_lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words")),
    }
    bits = sum((F.when(fails[k], F.lit(bit)).otherwise(0) for k, bit in RULES.items()), F.lit(0))
    docs = docs.drop(*_MEASURES, "bits")
    schema = StructType([*docs.schema.fields, *(StructField(k, LongType()) for k in _MEASURES)])
    return docs.mapInArrow(_measures, schema).withColumn("bits", bits.cast("int"))


def apply_policy(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """Adds ``base_failed`` and ``kept`` under the policy."""
    failed = lambda mask: F.col("bits").bitwiseAND(F.lit(mask)) != 0
    return entries.withColumns({"base_failed": failed(POLICIES["base"]), "kept": ~(failed(POLICIES["base"]) | failed(POLICIES[policy]))})


def ablations(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that only it rejects."""
    mask = POLICIES[policy]
    used = F.col("bits").bitwiseAND(F.lit(mask))
    rules = {k: bit for k, bit in RULES.items() if bit & mask}
    sums = [F.sum(e.cast("long")).alias(f"{k}_{what}") for k, bit in rules.items() for what, e in (("failed", used.bitwiseAND(F.lit(bit)) != 0), ("alone", used == bit))]
    total = entries.agg(*sums)
    each = F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(f"{k}_failed", F.lit(0)).alias("failed"), F.coalesce(f"{k}_alone", F.lit(0)).alias("alone")) for k in rules])
    return total.select(F.inline(each))


def stored_ledger(docs: DataFrame) -> DataFrame:
    """The ledger of docs (doc_id, text) without the texts, written: policies and ablations read this table alone."""
    return cut(ledger(docs.select("doc_id", "text")).drop("text"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = stored_ledger(documents(spark, sf_dir))
    return apply_policy(entries).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bits")


def rules_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(policy, rule, failed, alone) of each policy: what each rule rejects, and what it alone does, all from one ledger."""
    entries = stored_ledger(documents(spark, sf_dir))
    parts = [ablations(entries, p).withColumn("policy", F.lit(p)) for p in POLICIES]
    return parts[0].unionByName(parts[1])


#: Shared with the pipeline's oracle. The words are split once; the windows are counted within each document.
MEASURES_SQL = r"""
w AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i, z IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, x, y, z) > 1 AS again FROM g),
r AS (SELECT doc_id, count(*) FILTER (again OR b OR c) AS n_repeat_words FROM (SELECT doc_id, again, lag(again, 1, false) OVER o AS b, lag(again, 2, false) OVER o AS c FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY i)) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda s: length(s))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
"""
_BITS_SQL = """b AS (SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (10 * n_dup_lines > 3 * n_lines)::INT
  + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT AS bits FROM v)"""
SQL = f"""WITH {MEASURES_SQL}, {_BITS_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, bits = 0 AS kept, bits FROM b"""
ABLATIONS_SQL = f"""WITH {MEASURES_SQL}, {_BITS_SQL},
masks(policy, mask, rule, bit) AS (VALUES {", ".join(f"('{p}', {mask}, '{r}', {bit})" for p, mask in POLICIES.items() for r, bit in RULES.items() if bit & mask)})
SELECT policy, rule, count(*) FILTER (bits & bit <> 0) AS failed, count(*) FILTER (bits & mask = bit) AS alone FROM masks, b GROUP BY policy, rule"""
