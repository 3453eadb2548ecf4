"""Counts and picks that pages show: registry totals, per-source cards, filtered lists, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.ranks import is_binding
from ledgerline.functions.text import version_key, whole
from ledgerline.operators.catalog import consecutive_pairs, recent


def registry_counts(registry: DataFrame) -> DataFrame:
    """All, stable, deprecated and new-registry attributes of a merged registry (reason, stability, registry)."""
    live = F.col("reason").isNull()
    return registry.agg(F.count("*").alias("all"), F.count_if(live & (F.col("stability") == "stable")).alias("stable"), F.count_if(~live).alias("deprecated"), F.count_if(F.col("registry") == "new").alias("new"))


def filtered_registry(registry: DataFrame, *, status: str = "all", slug: str | None = None, text: str = "") -> DataFrame:
    """Rows of a merged registry with topics (slug): by status (all, stable, deprecated, new), topic and text."""
    tests = {"all": F.lit(True), "stable": F.col("reason").isNull() & (F.col("stability") == "stable"), "deprecated": F.col("reason").isNotNull(), "new": F.col("registry") == "new"}
    rows = registry.where(tests[status])
    rows = rows if slug is None else rows.where(F.col("slug") == slug)
    return rows.where(F.lower(F.concat_ws(" ", "id", "brief")).contains(text.lower())) if text else rows


def by_group(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, first, last): how many ids a namespace or file has, and the ends of its range."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


def source_totals(requirements: DataFrame) -> DataFrame:
    """(source, requirements, binding, documents) of requirements (source, level, path)."""
    return requirements.groupBy("source").agg(F.count("*").alias("requirements"), F.count_if(is_binding(F.col("level"))).alias("binding"), F.countDistinct("path").alias("documents"))


def cumulative_breaking(changes: DataFrame) -> DataFrame:
    """(source, breaking): breaking changes over all versions of a source."""
    return changes.groupBy("source").agg(F.count_if(F.col("severity") == "breaking").alias("breaking"))


def source_cards(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """(source, versions, oldest, latest, breaking): a card a source."""
    key = version_key(F.col("version"))
    rows = versions.groupBy("source").agg(F.countDistinct("version").alias("versions"), F.min_by("version", key).alias("oldest"), F.max_by("version", key).alias("latest"))
    return rows.join(cumulative_breaking(changes), "source", "left").withColumn("breaking", F.coalesce("breaking", F.lit(0)))


def largest(rows: DataFrame, by: str) -> DataFrame:
    """The row with the largest count; ties go to the first name."""
    return rows.orderBy(F.desc(by), rows.columns[0]).limit(1)


def rules_about(requirements: DataFrame, word: str) -> DataFrame:
    """MUST and MUST NOT requirements whose text has a word."""
    return requirements.where(F.col("text").rlike("(?i)" + whole(word)) & F.col("level").startswith("MUST"))


def shallow_renames(attributes: DataFrame, namespace: str, most: int = 4) -> DataFrame:
    """Renamed attributes of a namespace, those with the fewest segments first."""
    rows = attributes.where((F.col("namespace") == namespace) & (F.coalesce("renamed_to", F.lit("")) != ""))
    depth: Column = F.size(F.split("id", r"\."))
    return rows.select("id", "renamed_to", depth.alias("depth")).orderBy("depth", "id").limit(most)


def confirmed(names: DataFrame, registry: DataFrame) -> DataFrame:
    """Of a curated list (id), what the registry has."""
    return names.join(registry.select("id"), "id", "left_semi")


def unconfirmed(names: DataFrame, registry: DataFrame) -> DataFrame:
    return names.join(registry.select("id"), "id", "left_anti")


def upgrade_span(versions: DataFrame) -> DataFrame:
    """(source, from_version, to_version): the oldest and the newest version, where they differ."""
    key = version_key(F.col("version"))
    rows = versions.groupBy("source").agg(F.min_by("version", key).alias("from_version"), F.max_by("version", key).alias("to_version"))
    return rows.where("from_version <> to_version")


def recent_pairs(versions: DataFrame, n: int) -> DataFrame:
    """The n newest consecutive pairs of each source."""
    return recent(consecutive_pairs(versions), n, ["source"], [version_key(F.col("to_version")).desc()])
