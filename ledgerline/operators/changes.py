"""The change record: how it is built, ordered and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.ranks import KINDS, SEVERITIES, place

FIELDS = ("kind", "severity", "entity", "id", "stability", "detail", "from_value", "to_value", "renamed_to", "href")


def change(condition: Column, kind: str | Column, severity: str | Column, *, entity: str, id: Column, stability: Column, detail: str | Column, from_value: Column | None = None, to_value: Column | None = None, renamed_to: Column | None = None, href: Column | None = None) -> Column:
    """A change struct where the condition holds, else null."""
    values = (kind, severity, entity, id, stability, detail, from_value, to_value, renamed_to, href)
    made = [(F.lit(None) if v is None else v if isinstance(v, Column) else F.lit(v)).cast("string").alias(f) for f, v in zip(FIELDS, values, strict=True)]
    return F.when(condition, F.struct(*made))


def emit(rows: DataFrame, *changes: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each change that a row of the comparison gives: no further join or shuffle."""
    found = F.filter(F.array(*changes), lambda c: c.isNotNull())
    return rows.select(*keep, F.explode(found).alias("c")).select(*keep, "c.*")


def ordered(changes: DataFrame) -> DataFrame:
    """Most consequential first, then by kind, then by id in locale order."""
    return changes.orderBy(place(SEVERITIES, F.col("severity")), place(KINDS, F.col("kind")), F.expr("id COLLATE UNICODE"))


def tally(changes: DataFrame, *keys: str) -> DataFrame:
    """Changes of each severity, zeros included."""
    return changes.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def by_kind(changes: DataFrame) -> DataFrame:
    """Kinds with their counts, most frequent first."""
    return changes.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), place(KINDS, F.col("kind")))


def significant(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("severity") != "informational")


def last_wins(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Of rows with the same keys the last one's values, at the first one's place. One aggregation, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c != ordinal]
    found = rows.groupBy(*keys).agg(F.max(F.struct(ordinal, *rest)).alias("last"), F.min(ordinal).alias(ordinal))
    return found.select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest], ordinal)
