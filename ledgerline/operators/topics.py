"""Topics: which namespaces belong together, and rollups over them. The topics are a table of the caller's."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.ranks import DEMAND_ORDER, is_binding, place
from ledgerline.functions.session import small_or_shuffled
from ledgerline.functions.text import namespace, signal_key, whole
from ledgerline.operators.registry import strongest_levels


def merged_registries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both registries; of ids that are live in the new one, the old one's stub is dropped. Column registry: old or new."""
    live = new.where("reason IS NULL").select("id")
    return old.join(live, "id", "left_anti").withColumn("registry", F.lit("old")).unionByName(new.withColumn("registry", F.lit("new")), allowMissingColumns=True)


def with_topic(rows: DataFrame, topics: DataFrame, name: Column | None = None) -> DataFrame:
    """Rows with the topic that owns their namespace; rows of no topic are dropped. topics: (namespace, slug), one row a namespace."""
    key = namespace(F.col("id") if name is None else name)
    return rows.withColumn("namespace", key).join(topics, "namespace")


def rollup(attributes: DataFrame, signals: DataFrame, topics: DataFrame) -> DataFrame:
    """A row a topic: attributes, stable and deprecated ones, metrics, spans, events, entities. signals: (id, kind), metrics among them."""
    stable = (F.col("stability") == "stable") & F.col("reason").isNull()
    owned = with_topic(attributes, topics).groupBy("slug").agg(F.count("*").alias("attributes"), F.count_if(stable).alias("stable"), F.count_if(F.col("reason").isNotNull()).alias("deprecated"))
    kinds = {"metrics": "metric", "spans": "span", "events": "event", "entities": "entity"}
    shown = with_topic(signals, topics, signal_key(F.col("id"))).groupBy("slug").agg(*[F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()])
    rows = topics.select("slug").distinct().join(owned, "slug", "left").join(shown, "slug", "left")
    counts = ["attributes", "stable", "deprecated", *kinds]
    return rows.select("slug", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def namespace_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(namespace(F.col("id")).alias("namespace")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "namespace")


def area_totals(requirements: DataFrame, area: Column) -> DataFrame:
    """(area, requirements, binding, documents) of requirements (path, level)."""
    return requirements.groupBy(area.alias("area")).agg(F.count("*").alias("requirements"), F.count_if(is_binding(F.col("level"))).alias("binding"), F.countDistinct("path").alias("documents"))


def governance(kinds: DataFrame, areas: DataFrame, totals: DataFrame) -> DataFrame:
    """Areas that bind a topic's signals: kinds (slug, kind, n) through areas (kind, area) to totals; areas without requirements are dropped."""
    return kinds.where("n > 0").join(areas, "kind").join(totals, "area").where("requirements > 0").select("slug", "kind", "area", "requirements", "documents", "binding")


def document_counts(requirements: DataFrame) -> DataFrame:
    """(path, sections, requirements, binding) of documents with a requirement."""
    return requirements.groupBy("path").agg(F.countDistinct("section").alias("sections"), F.count("*").alias("requirements"), F.count_if(is_binding(F.col("level"))).alias("binding"))


def level_weight(level: Column) -> Column:
    return F.when(level.startswith("MUST") | level.startswith("SHALL"), 0).when(level.startswith("SHOULD"), 1).otherwise(2)


def keyword_pattern(keywords: list[str]) -> str:
    return "(?i)(?:" + "|".join(whole(k, re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", k)) for k in keywords) + ")"


def topic_requirements(requirements: DataFrame, keywords: list[str], *, excluded: str | None = None, own: str | None = None) -> DataFrame:
    """Requirements (text, title, path, status, level, section) that name a topic, best first. Without keywords there are none.

    excluded: pattern of paths that never count. own: a path prefix whose requirements always do.
    """
    if not keywords:
        return requirements.limit(0)
    pattern = keyword_pattern(keywords)
    about, says = F.col("title").rlike(pattern), F.col("text").rlike(pattern)
    rows = requirements if excluded is None else requirements.where(~F.col("path").rlike(excluded))
    rows = rows.where(about | says | (F.col("path").startswith(own) if own else F.lit(False)))
    return rows.orderBy(F.desc(about), F.desc(F.col("status") == "Stable"), level_weight(F.col("level")), F.col("text").contains(" | "), F.expr("section COLLATE UNICODE"), "id")


def signal_attributes(signals: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kind, attribute, level) of signals (id, kind, attributes), most strongly demanded first.

    edges: (id, group_id, level, ordinal). A signal's group goes by its id or, if no edge has that, by kind.id; without a level it is recommended.
    """
    levels = strongest_levels(edges).select("group_id", F.col("id").alias("attribute"), "level")
    groups = levels.select("group_id").distinct()
    rows = signals.select("id", "kind", F.explode("attributes").alias("attribute")).join(groups.select(F.col("group_id").alias("id"), F.lit(True).alias("direct")), "id", "left")
    rows = rows.withColumn("group_id", F.when(F.col("direct"), F.col("id")).otherwise(F.concat("kind", F.lit("."), "id")))
    rows = rows.join(levels, ["group_id", "attribute"], "left").withColumn("level", F.coalesce("level", F.lit("recommended")))
    return rows.select("id", "kind", "attribute", "level").orderBy("id", place(DEMAND_ORDER, F.col("level")), F.expr("attribute COLLATE UNICODE"))


def usage_by_kind(edges: DataFrame) -> DataFrame:
    """(id, group_type, signals): who uses an attribute by kind of signal; plain attribute groups aside."""
    return edges.where("group_type <> 'attribute_group'").groupBy("id", "group_type").agg(F.array_sort(F.collect_set(F.coalesce("signal_name", "group_id"))).alias("signals"))


def packages(messages: DataFrame, order: DataFrame) -> DataFrame:
    """Messages of listed packages (package, ordinal), in the packages' order. Every dotted prefix of a name is an equi-join key; packages are few, and a shuffle by them would leave tasks as few."""
    parts = F.split("name", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    rows = messages.where(F.size(parts) > 1).select("name", F.explode(prefixes).alias("package")).join(small_or_shuffled(order), "package")
    best = rows.groupBy("name").agg(F.min(F.struct("ordinal", "package")).alias("p"))
    return best.select("name", "p.package", "p.ordinal").orderBy("ordinal", F.expr("name COLLATE UNICODE"))
