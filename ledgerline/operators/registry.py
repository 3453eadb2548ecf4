"""Registry diff: attributes, metrics and signals of two versions, and who uses them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.ranks import DEMAND, DEMAND_ORDER, STABILITY, is_stable, lookup, severity
from ledgerline.functions.ranks import place as place_of
from ledgerline.functions.session import shuffled
from ledgerline.functions.text import signal_list, truncate
from ledgerline.operators.changes import change, emit, last_wins


def paired(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """One row for each key of either side, with columns b (before) and a (after) as structs, null where absent."""
    pack = lambda df, name: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys], F.lit(True).alias("here")).alias(name))
    return pack(before, "b").join(pack(after, "a"), list(keys), "full_outer")


def deprecation_key(side: str) -> Column:
    reason, to = F.col(f"{side}.reason"), F.col(f"{side}.renamed_to")
    return F.coalesce(F.concat(reason, F.when(to.isNotNull() & (to != ""), F.concat(F.lit("->"), to)).otherwise("")), F.lit(""))


def lifecycle_changes(entity: str, id: Column) -> list[Column]:
    """Changes that all kinds of entity share, over a ``paired`` row. At most one of each, several kinds at once."""
    b, a = F.col("b"), F.col("a")
    both = b.isNotNull() & a.isNotNull()
    old, new = b["stability"], a["stability"]
    of_old = severity(is_stable(old), "breaking", "notable")
    ranks = lookup(STABILITY, old, 1), lookup(STABILITY, new, 1)
    moved = both & ~deprecation_key("a").eqNullSafe(deprecation_key("b"))
    renamed = (a["reason"] == "renamed") & (F.coalesce(a["renamed_to"], F.lit("")) != "")
    renamed = F.coalesce(renamed, F.lit(False))
    gone = a["reason"].isNotNull()
    noted = both & ~a["note"].eqNullSafe(b["note"])
    note = F.when(F.coalesce(a["deprecation_note"], F.lit("")) != "", truncate(a["deprecation_note"])).otherwise(F.concat(F.lit("Deprecated ("), a["reason"], F.lit(").")))
    brief = truncate(F.coalesce(a["brief"], F.lit("")))
    common = {"entity": entity, "id": id}
    return [
        change(a.isNull(), "removed", of_old, stability=old, detail=F.concat(F.lit("Removed from the registry (was "), old, F.lit(").")), **common),
        change(b.isNull(), "added", "informational", stability=new, detail=F.when(brief != "", brief).otherwise(F.concat(F.lit("Added as "), new, F.lit("."))), **common),
        change(moved & renamed, "renamed", of_old, stability=new, detail=F.concat(F.lit("Renamed to `"), a["renamed_to"], F.lit("`.")), from_value=id, to_value=a["renamed_to"], renamed_to=a["renamed_to"], **common),
        change(moved & gone & ~renamed, "deprecated", of_old, stability=new, detail=note, **common),
        change(moved & ~gone, "undeprecated", "notable", stability=new, detail="No longer marked deprecated.", **common),
        change(
            both & ~old.eqNullSafe(new),
            "stability-changed",
            F.when(ranks[1] == ranks[0], "informational").when(ranks[1] > ranks[0], "notable").otherwise(of_old),
            stability=new,
            detail=F.when(ranks[1] == ranks[0], F.concat(F.lit("Stability label respelled from "), old, F.lit(" to "), new, F.lit("."))).when(ranks[1] > ranks[0], F.concat(F.lit("Promoted to "), new, F.lit("."))).otherwise(F.concat(F.lit("Stability lowered to "), new, F.lit("."))),
            from_value=old,
            to_value=new,
            **common,
        ),
        change(noted, "note-changed", "informational", stability=new, detail="Guidance note changed.", **common),
        change(both & ~noted & ~a["brief"].eqNullSafe(b["brief"]), "brief-changed", "informational", stability=new, detail=brief, **common),
    ]


def _value_change(kind: str, field: str, title: str, entity: str, id: Column) -> Column:
    b, a = F.col(f"b.{field}"), F.col(f"a.{field}")
    both = F.col("b").isNotNull() & F.col("a").isNotNull()
    detail = F.concat(F.lit(f"{title} changed from `"), F.coalesce(b, F.lit("")), F.lit("` to `"), F.coalesce(a, F.lit("")), F.lit("`."))
    stability = F.col("a.stability")
    return change(both & ~a.eqNullSafe(b), kind, severity(is_stable(stability), "breaking", "notable"), entity=entity, id=id, stability=stability, detail=detail, from_value=b, to_value=a)


def _members_key(side: str) -> Column:
    return F.array_join(F.array_sort(F.transform(F.coalesce(F.col(f"{side}.enum_members"), F.array()), lambda m: F.concat(m["id"], F.lit("="), m["value"]))), ",")


def attribute_changes(before: DataFrame, after: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Attributes (id, type, stability, brief, note, reason, renamed_to, deprecation_note, and optionally enum_members, examples).

    by: columns of both sides that name a comparison; all comparisons share one join, and their changes carry the columns.
    """
    id = F.col("id")
    both = F.col("b").isNotNull() & F.col("a").isNotNull()
    stability = F.col("a.stability")
    extra = [_value_change("type-changed", "type", "Type", "attribute", id)]
    if "enum_members" in before.columns:
        size = lambda side: F.greatest(F.coalesce(F.size(f"{side}.enum_members"), F.lit(0)), F.lit(0)).cast("string")
        detail = F.concat(F.lit("Enum members changed ("), size("b"), F.lit(" to "), size("a"), F.lit(")."))
        extra.append(change(both & (_members_key("a") != _members_key("b")), "enum-members-changed", severity(is_stable(stability), "notable", "informational"), entity="attribute", id=id, stability=stability, detail=detail))
    if "examples" in before.columns:
        words = lambda side: F.array_join(F.coalesce(F.col(f"{side}.examples"), F.array()), " ")
        extra.append(change(both & (words("a") != words("b")), "examples-changed", "informational", entity="attribute", id=id, stability=stability, detail="Examples changed."))
    return emit(paired(before, after, *by, "id"), *lifecycle_changes("attribute", id), *extra, keep=by)


def metric_changes(before: DataFrame, after: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Metrics: as attributes, with unit and instrument in place of the type; id is the name."""
    id = F.col("id")
    extra = [_value_change("unit-changed", "unit", "Unit", "metric", id), _value_change("instrument-changed", "instrument", "Instrument", "metric", id)]
    return emit(paired(before, after, *by, "id"), *lifecycle_changes("metric", id), *extra, keep=by)


def signal_changes(before: DataFrame, after: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Spans, events and entities (id, stability, brief, note, reason, renamed_to, deprecation_note)."""
    return emit(paired(before, after, *by, "id"), *lifecycle_changes("signal", F.col("id")), keep=by)


def effective_usage(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(id, signal, level, ordinal) edges: of several levels on one signal the last, at the first one's place."""
    return last_wins(edges.select(*by, "id", "signal", "level", "ordinal"), [*by, "id", "signal"], "ordinal")


def usage_changes(before: DataFrame, after: DataFrame, attributes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Usage edges of two versions, and the attributes present in both with their new stability (id, stability).

    One change an attribute for levels that moved, for signals gained and for signals lost; each names the first ones.
    """
    edges = paired(effective_usage(before, by), effective_usage(after, by), *by, "id", "signal")
    key = [*by, "id", "what"]
    old, new = F.col("b.level"), F.col("a.level")
    kind = F.when(F.col("b").isNull(), "gained").when(F.col("a").isNull(), "lost").when(old != new, "moved")
    rank = lambda level: lookup(DEMAND, level, 1)
    classed = edges.select(*by, "id", "signal", kind.alias("what"), old.alias("old"), new.alias("new"), F.coalesce("a.ordinal", "b.ordinal").alias("ordinal")).where("what IS NOT NULL")
    counts = classed.groupBy(*key).agg(F.count("*").alias("n"), F.coalesce(F.bool_or(rank(F.col("new")) > rank(F.col("old"))), F.lit(False)).alias("strengthened"), F.coalesce(F.bool_or(rank(F.col("new")) >= 2), F.lit(False)).alias("obliged"))
    # only two names are shown: the rank filter is applied on both sides of the shuffle, so no list grows with an attribute's edges
    place = F.row_number().over(Window.partitionBy(*key).orderBy("ordinal", "signal"))
    first = classed.withColumn("place", place).where("place <= 2").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "signal", "old", "new"))).alias("first"))
    found = counts.join(shuffled(first), key).join(shuffled(attributes.select(*by, "id", "stability")), [*by, "id"])
    words = lambda x: F.replace(x, F.lit("_"), F.lit(" "))
    stable, what = is_stable(F.col("stability")), F.col("what")
    names = signal_list(F.col("first.signal"), F.col("n"))
    was, now = F.get("first", F.lit(0))["old"], F.get("first", F.lit(0))["new"]
    common = {"entity": "attribute", "id": F.col("id"), "stability": F.col("stability")}
    return emit(
        found,
        change(what == "moved", "requirement-level-changed", severity(stable & F.col("strengthened"), "notable", "informational"), detail=F.concat(F.lit("On "), names, F.lit(": "), words(was), F.lit(" to "), words(now), F.lit(".")), from_value=was, to_value=now, **common),
        change(what == "gained", "usage-changed", severity(stable & F.col("obliged"), "notable", "informational"), detail=F.concat(F.lit("Now referenced by "), names, F.lit(" ("), words(now), F.lit(").")), **common),
        change(what == "lost", "usage-changed", "informational", detail=F.concat(F.lit("No longer referenced by "), names, F.lit(".")), **common),
        keep=by,
    )


def registry_changes(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def strongest_levels(edges: DataFrame) -> DataFrame:
    """(group_id, id, level): the strongest level a group asks an attribute with. Unknown levels count as the strongest."""
    best = F.min(F.struct(place_of(DEMAND_ORDER, F.col("level")).alias("rank"), "ordinal", "level"))
    return edges.groupBy("group_id", "id").agg(best.alias("best")).select("group_id", "id", "best.level")
