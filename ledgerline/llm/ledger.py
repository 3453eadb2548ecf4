"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations read bits.

The ledger has one row a document: its measurements and ``fails``, in which bit i is set where rule i
fails. A policy is a versioned set of rules, so changing policy or asking what a rule costs
touches only the ledger, never the texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import stored, table

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words")
#: Rule -> when it fails, in SQL over the measurements. A rule's bit is its place; add new ones at the end only.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "long_words": "word_chars > 20 * n_words",
    "shouting": "100 * n_upper_words > 60 * n_words",
}
BITS = {name: i for i, name in enumerate(RULES)}
BASE = ("few_words", "repeated_windows")
#: Version -> the rules that a kept document must pass.
POLICIES = {1: BASE, 2: tuple(RULES)}
CURRENT = 2


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of a whole text; null counts as empty. Lines are those with a word."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    lines = [line for line in data.split(b"\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        inside = bytearray(n)
        for i, w in enumerate(windows):
            if times[w] > 1:
                inside[i : i + 3] = b"\1\1\1"
        repeated = sum(inside)
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    return n, len(text) - spaces, sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), repeated, len(lines), sum(w.isupper() for w in words)


def mask(policy: int) -> int:
    return sum(1 << BITS[rule] for rule in POLICIES[policy])


def passes(policy: int) -> Column:
    """Does a row of the ledger pass the policy?"""
    return F.col("fails").bitwiseAND(mask(policy)) == 0


def ledger(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the measurements and fails, for every row.

    Repeated rows stay repeated, ids may be null, a null text counts as empty, and other columns of ``docs`` play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(measure(x.as_py()) for x in batch.column(1)), strict=True)) or [()] * len(MEASURES)
            yield pa.record_batch([batch.column(0), *(pa.array(x, pa.int64()) for x in found)], ["doc_id", *MEASURES])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    measured = rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    fails = sum(F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(RULES.values()))
    return measured.withColumn("fails", fails)


def ablation(rows: DataFrame, policy: int = CURRENT) -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that would be kept without it. One pass over the bits."""
    rules, bits = POLICIES[policy], F.col("fails").bitwiseAND(mask(policy))
    sums = []
    for rule in rules:
        bit = F.lit(1 << BITS[rule])
        sums.append(F.struct(F.lit(rule).alias("rule"), F.count_if(bits.bitwiseAND(bit) != 0).alias("failed"), F.count_if(bits == bit).alias("kept_without")))
    return rows.agg(F.array(*sums).alias("x")).select(F.inline("x"))


def written(spark, sf_dir) -> DataFrame:
    """The ledger of all documents, written once; every policy and ablation reads that table."""
    return stored(ledger(table(spark, sf_dir, "documents")), "ledger")


def ledger_ablation(spark, sf_dir):
    """Query: what each rule of each policy costs, from the bits of the written ledger."""
    rows = written(spark, sf_dir)
    found = [ablation(rows, policy).withColumn("policy", F.lit(policy)) for policy in POLICIES]
    return reduce(DataFrame.unionByName, found).select("policy", "rule", "failed", "kept_without")


def op8_ledger(spark, sf_dir):
    """Query: measurements and verdict of every document, from the written ledger."""
    rows = written(spark, sf_dir)
    return rows.select("doc_id", *MEASURES[:5], (~passes(1)).alias("base_failed"), passes(CURRENT).alias("kept"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_MEASURED = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
by_line AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
windows AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
keyed AS (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS k FROM windows),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM keyed) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
m AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper_words
  FROM d LEFT JOIN by_line USING (r) LEFT JOIN covered USING (r))
"""
ORACLE = f"""{_MEASURED}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({" OR ".join(RULES[x] for x in BASE)}) AS base_failed,
  NOT ({" OR ".join(RULES.values())}) AS kept FROM m
"""
_COSTS = [
    f"SELECT {policy} AS policy, '{rule}' AS rule, count(*) FILTER ({RULES[rule]}) AS failed, count(*) FILTER ({' AND '.join(['(' + RULES[rule] + ')', *(f'NOT ({RULES[x]})' for x in rules if x != rule)])}) AS kept_without FROM m"
    for policy, rules in POLICIES.items()
    for rule in rules
]
ABLATION = _MEASURED + "\nUNION ALL ".join(_COSTS)
