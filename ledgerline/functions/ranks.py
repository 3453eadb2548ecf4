"""Orders and lookup tables, and columns that apply them. The dictionaries and lists hold fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities and kinds of change, most consequential first.
SEVERITIES = ["breaking", "notable", "informational"]
KINDS = [
    "removed",
    "renamed",
    "deprecated",
    "field-removed",
    "field-number-changed",
    "field-type-changed",
    "field-renamed",
    "field-label-changed",
    "value-removed",
    "requirement-removed",
    "requirement-level-changed",
    "type-changed",
    "unit-changed",
    "instrument-changed",
    "stability-changed",
    "requirement-added",
    "requirement-reworded",
    "requirement-moved",
    "enum-members-changed",
    "usage-changed",
    "undeprecated",
    "added",
    "field-added",
    "value-added",
    "section-rewritten",
    "note-changed",
    "brief-changed",
    "examples-changed",
]
# Stability tiers (unknown ones rank 1) and how strongly a signal asks for an attribute.
STABILITY = {"deprecated": 0, "alpha": 1, "experimental": 1, "development": 1, "release_candidate": 2, "stable": 3}
DEMAND = {"opt_in": 0, "recommended": 1, "conditionally_required": 2, "required": 3}
DEMAND_ORDER = ["required", "conditionally_required", "recommended", "opt_in"]
# Requirement keywords in the order in which they are looked for, and their strength.
LEVELS = ["MUST NOT", "SHALL NOT", "SHOULD NOT", "NOT RECOMMENDED", "MUST", "SHALL", "SHOULD", "REQUIRED", "RECOMMENDED", "OPTIONAL", "MAY"]
STRENGTH = {"MAY": 1, "OPTIONAL": 1, "RECOMMENDED": 2, "NOT RECOMMENDED": 2, "SHOULD": 2, "SHOULD NOT": 2, "REQUIRED": 3, "SHALL": 3, "SHALL NOT": 3, "MUST": 3, "MUST NOT": 3}
# Document statuses that make a promise.
STABLE_STATUSES = ["Stable", "Release Candidate"]
# Group types of the older registry format.
GROUP_TYPES = {
    "attribute_group": "attribute_group",
    "metric": "metric",
    "metric_group": "attribute_group",
    "event": "event",
    "entity": "entity",
    "span": "span",
    "scope": "attribute_group",
    "resource": "attribute_group",
}
# Entry types of the search index in the order in which they are listed, and query prefixes.
TYPE_RANK = {"page": -1, "domain": 0, "attribute": 1, "metric": 2, "span": 3, "event": 4, "entity": 5, "otlp": 6, "requirement": 7}
PREFIXES = {
    "attr": "attribute",
    "attribute": "attribute",
    "metric": "metric",
    "span": "span",
    "event": "event",
    "entity": "entity",
    "signal": "signal",
    "spec": "requirement",
    "req": "requirement",
    "requirement": "requirement",
    "otlp": "otlp",
    "domain": "domain",
}
SIGNALS = ["span", "event", "entity"]
# Words that a question's search leaves out, and words that ask about deprecation.
STOP = "a an and are as at be by do does did for from has have how i in is it its of on or that the this to was what when where which who why with should can could would will still my our we you your there their about into use used using vs than then any some attribute attributes".split()
DEPRECATION = r"(?i)\b(deprecat|renam|still|replac|old|legacy|instead|success)"
# Thresholds of the prose diff.
REWORDED, MOVED, REWRITTEN_SHARE, REWRITTEN_CHARS = 0.6, 0.85, 0.33, 200
# How values are shown: demand levels in a sentence, stabilities, severities, kinds of change, counted wire changes (one, many), entry types, groups of entries.
LABELS = {"release_candidate": "release candidate", "opt_in": "opt in", "conditionally_required": "conditionally required"}
STABILITY_LABELS = {
    "stable": "Stable",
    "release_candidate": "Release candidate",
    "development": "Development",
    "experimental": "Experimental",
    "alpha": "Alpha",
    "deprecated": "Deprecated",
}
SEVERITY_LABELS = {"breaking": "Breaking", "notable": "Notable", "informational": "Editorial"}
KIND_LABELS = {
    "added": "added",
    "removed": "removed",
    "renamed": "renamed",
    "deprecated": "deprecated",
    "undeprecated": "un-deprecated",
    "stability-changed": "stability",
    "type-changed": "type",
    "unit-changed": "unit",
    "instrument-changed": "instrument",
    "enum-members-changed": "enum",
    "brief-changed": "wording",
    "note-changed": "guidance",
    "examples-changed": "examples",
    "usage-changed": "usage",
    "first-seen": "added",
    "requirement-added": "new rule",
    "requirement-removed": "rule dropped",
    "requirement-reworded": "reworded",
    "requirement-moved": "moved",
    "requirement-level-changed": "strength",
    "section-rewritten": "rewritten",
    "field-added": "field added",
    "field-removed": "field removed",
    "field-renamed": "field renamed",
    "field-type-changed": "field type",
    "field-number-changed": "renumbered",
    "field-label-changed": "cardinality",
    "value-added": "value added",
    "value-removed": "value removed",
}
WIRE_LABELS = {
    "added": ("definition added", "definitions added"),
    "removed": ("definition removed", "definitions removed"),
    "field-added": ("field added", "fields added"),
    "field-removed": ("field removed", "fields removed"),
    "field-renamed": ("field renamed", "fields renamed"),
    "field-number-changed": ("field renumbered", "fields renumbered"),
    "field-type-changed": ("field retyped", "fields retyped"),
    "field-label-changed": ("cardinality change", "cardinality changes"),
}
TYPE_LABELS = {t: t for t in ("attribute", "metric", "span", "event", "entity", "requirement", "otlp", "domain", "page")}
GROUP_LABELS = {"page": "Pages", "domain": "Domains", "attribute": "Attributes", "metric": "Metrics", "span": "Spans", "event": "Events", "entity": "Entities", "otlp": "OTLP", "requirement": "Requirements"}


def lookup(table: dict, key: Column, default) -> Column:
    """table[key], or the default; one constant map, folded by the optimizer."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))


def place(order: list, key: Column, default: int = -1) -> Column:
    """Position in a list; -1 for others, so that unknown values come first."""
    return lookup({k: i for i, k in enumerate(order)}, key, default)


def is_stable(stability: Column) -> Column:
    return F.coalesce(stability.isin("stable", "release_candidate"), F.lit(False))


def is_stable_document(status: Column) -> Column:
    return F.coalesce(status.isin(*STABLE_STATUSES), F.lit(False))


def is_binding(level: Column) -> Column:
    return lookup(STRENGTH, level, 0) == 3


def in_development(name: Column) -> Column:
    """Is a wire name of a package that promises nothing yet?"""
    return name.contains("development")


def severity(condition: Column, then: str, otherwise: str) -> Column:
    return F.when(condition, then).otherwise(otherwise)


def label(value: Column) -> Column:
    """A value as it is shown: known spellings, else underscores and hyphens as spaces."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[value], F.translate(value, "_-", "  "))


def shown(table: dict[str, str], value: Column) -> Column:
    """A value's label in one of the tables; the value itself if the table lacks it."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[value], value)


def counted(kind: Column, n: Column) -> Column:
    """A number of wire changes of one kind, in words; other kinds by their label."""
    one, many = ({k: v[i] for k, v in WIRE_LABELS.items()} for i in (0, 1))
    known = F.create_map(*[F.lit(x) for kv in one.items() for x in kv])[kind].isNotNull()
    words = F.when(known, F.when(n == 1, shown(one, kind)).otherwise(shown(many, kind))).otherwise(shown(KIND_LABELS, kind))
    return F.concat(n.cast("string"), F.lit(" "), words)
