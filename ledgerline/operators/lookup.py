"""Lookups: verdicts on names, filtered pages, definitions and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.session import shuffled, small_or_shuffled

#: Names that one check takes, and rows that a page may have: default and most.
NAMES, ATTRIBUTES_PAGE, REQUIREMENTS_PAGE, SEARCH_PAGE = 200, (50, 200), (40, 200), (20, 50)


def templates(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, template): the first template attribute (by ordinal) that is a dotted prefix of a name.

    Names give all their dotted prefixes, which join by equality: no nested loop, however many names there are.
    The names' side is never broadcast, nor are templates unless they are few.
    """
    parts = F.split("name", r"\.")
    n = F.size(parts)
    prefixes = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ".")))
    known = registry.where(F.col("type").startswith("template[")).select(F.col("id").alias("prefix"), "ordinal")
    rows = names.select("name", F.explode(prefixes).alias("prefix")).join(small_or_shuffled(known), "prefix")
    return rows.groupBy("name").agg(F.min_by("prefix", "ordinal").alias("template"))


def verdicts(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, verdict, replacement, registry) of names, over rows (id, type, reason, renamed_to, registry, ordinal) that may repeat an id.

    A live definition beats deprecated ones; then renamed, deprecated, moved (live here, deprecated elsewhere), ok, and ok by template or unknown.
    """
    best = registry.groupBy(F.col("id").alias("name")).agg(
        F.min(F.struct(F.col("reason").isNotNull().alias("gone"), "ordinal", "reason", "renamed_to", "registry")).alias("d"), F.bool_or(F.col("reason").isNotNull()).alias("any_gone")
    )
    rows = names.join(shuffled(best), "name", "left").join(shuffled(templates(names, registry)), "name", "left")
    renamed = F.coalesce(F.col("d.renamed_to"), F.lit("")) != ""
    verdict = (
        F.when(F.col("d").isNull(), F.when(F.col("template").isNotNull(), "ok").otherwise("unknown"))
        .when(F.col("d.reason").isNotNull() & renamed, "renamed")
        .when(F.col("d.reason").isNotNull(), "deprecated")
        .when(F.col("any_gone"), "moved")
        .otherwise("ok")
    )
    return rows.select("name", verdict.alias("verdict"), F.when(verdict == "renamed", F.col("d.renamed_to")).alias("replacement"), F.col("d.registry").alias("registry"))


def checked_names(names: DataFrame, live: DataFrame, deprecated: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(name, status, replacement, prefix) from the compact index: live (id), deprecated (id, replacement), prefixes (id, ordinal)."""
    registry = prefixes.select("id", F.lit("template[string]").alias("type"), "ordinal")
    rows = names.join(shuffled(live.select(F.col("id").alias("name"), F.lit(True).alias("live"))), "name", "left")
    rows = rows.join(shuffled(deprecated.select(F.col("id").alias("name"), F.coalesce("replacement", F.lit("")).alias("to"))), "name", "left").join(shuffled(templates(names, registry)), "name", "left")
    status = F.when(F.col("live"), "ok").when(F.col("to") != "", "renamed").when(F.col("to") == "", "deprecated").when(F.col("template").isNotNull(), "template").otherwise("unknown")
    return rows.select("name", status.alias("status"), F.when(status == "renamed", F.col("to")).alias("replacement"), F.when(status == "template", F.col("template")).alias("prefix"))


def attention(found: DataFrame) -> DataFrame:
    """How many names of a check need attention, and how many nobody defines. Moved ones need none."""
    return found.agg(F.count("*").alias("checked"), F.count_if(F.col("verdict").isin("renamed", "deprecated")).alias("needs_attention"), F.count_if(F.col("verdict") == "unknown").alias("not_in_registry"))


def page(rows: DataFrame, limit: int | None, bounds: tuple[int, int]) -> DataFrame:
    """The first rows in registry order, as many as asked, within bounds."""
    n = min(bounds[1], max(1, limit or bounds[0]))
    return rows.orderBy("ordinal").limit(n)


def matching_attributes(registry: DataFrame, query: str = "", namespace: str | None = None, deprecated_only: bool = False) -> DataFrame:
    rows = registry if namespace is None else registry.where(F.col("namespace") == namespace)
    rows = rows.where("reason IS NOT NULL") if deprecated_only else rows
    return rows.where(F.lower(F.concat_ws(" ", "id", "brief")).contains(query.lower())) if query else rows


def matching_requirements(requirements: DataFrame, query: str = "", level: str | None = None, section: str | None = None) -> DataFrame:
    rows = requirements if level is None else requirements.where(F.col("level") == level.upper())
    rows = rows if section is None else rows.where(F.lower("section").contains(section.lower()))
    return rows.where(F.lower("text").contains(query.lower())) if query else rows


def definition(id: str, registry: DataFrame, history: DataFrame, replaced: DataFrame) -> DataFrame:
    """An attribute with its history and what it replaces, one row; none if there is no such id."""
    events = history.where(F.col("id") == id).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "version", "kind", "detail"))).alias("history"))
    return registry.where(F.col("id") == id).join(events, "id", "left").join(replaced.where(F.col("id") == id), "id", "left")


def messages_named(wanted: DataFrame, messages: DataFrame) -> DataFrame:
    """(wanted, name): the message of each name wanted, exact, or else the first that ends with it after a dot.

    Every dotted suffix of a message's name is a join key, so a bare name finds its package by equality.
    """
    parts = F.split("name", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    rows = messages.select("name", "ordinal", F.explode(suffixes).alias("wanted")).join(wanted.select("wanted").distinct(), "wanted")
    return rows.groupBy("wanted").agg(F.min_by("name", F.struct(F.col("wanted") != F.col("name"), "ordinal")).alias("name"))


def suggestions(wanted: str, messages: DataFrame, most: int = 10) -> DataFrame:
    return messages.where(F.lower("name").contains(wanted.lower())).orderBy("ordinal").limit(most).select("name")


def picked(rows: DataFrame, key: str, order: list) -> DataFrame:
    """One row a key: the first in an order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("place = 1").drop("place")
