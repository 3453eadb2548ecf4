"""Registry model files (YAML): groups, definitions, and who uses which attribute how strongly."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.ranks import GROUP_TYPES
from ledgerline.functions.session import stored
from ledgerline.functions.text import namespace
from ledgerline.operators.changes import last_wins
from ledgerline.operators.closure import inherited

_DEPRECATED = pa.struct([("reason", pa.string()), ("renamed_to", pa.string()), ("note", pa.string())])
_MEMBER = pa.struct([("id", pa.string()), ("value", pa.string()), ("stability", pa.string()), ("brief", pa.string()), ("deprecated", _DEPRECATED)])
_DEFINITION = pa.struct([("id", pa.string()), ("type", pa.string()), ("enum_members", pa.list_(_MEMBER)), ("stability", pa.string()), ("brief", pa.string()), ("note", pa.string()), ("examples", pa.list_(pa.string())), ("deprecated", _DEPRECATED)])
_GROUP = pa.schema(
    [("file", pa.string()), ("place", pa.int32()), ("id", pa.string()), ("type", pa.string()), ("signal_name", pa.string()), ("refinement", pa.bool_()), ("parents", pa.list_(pa.string())), ("definitions", pa.list_(_DEFINITION))]
    + [("refs", pa.list_(pa.struct([("ref", pa.string()), ("level", pa.string())])))]
    + [(k, pa.string()) for k in ("stability", "brief", "note", "instrument", "unit", "span_kind")]
    + [("deprecated", _DEPRECATED)]
)
_D = "struct<reason string, renamed_to string, note string>"
GROUP = (
    "file string, place int, id string, type string, signal_name string, refinement boolean, parents array<string>, "
    f"definitions array<struct<id string, type string, enum_members array<struct<id string, value string, stability string, brief string, deprecated {_D}>>, stability string, brief string, note string, examples array<string>, deprecated {_D}>>, "
    f"refs array<struct<ref string, level string>>, stability string, brief string, note string, instrument string, unit string, span_kind string, deprecated {_D}"
)


def _text(v) -> str:
    return "" if v is None else v.strip() if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


def _list(v) -> list:
    return [] if v is None else v if isinstance(v, list) else [v]


def _deprecated(v) -> dict | None:
    if not v:
        return None
    if isinstance(v, str):
        return {"reason": "uncategorized", "renamed_to": None, "note": v.strip()}
    return {"reason": _text(v.get("reason")) or "uncategorized", "renamed_to": _text(v.get("renamed_to")) or None, "note": _text(v.get("note")) or None}


def _level(v) -> str:
    return "recommended" if not v else v if isinstance(v, str) else next(iter(v), "recommended")


def _definition(raw: dict) -> dict:
    kind = raw.get("type")
    members = kind.get("members") if isinstance(kind, dict) else None
    member = lambda m: {"id": _text(m.get("id")), "value": _text(m.get("value")), "stability": m.get("stability"), "brief": _text(m.get("brief")) or None, "deprecated": _deprecated(m.get("deprecated"))}
    return {
        "id": _text(raw.get("id") if raw.get("id") is not None else raw.get("key")),
        "type": kind if isinstance(kind, str) else "enum" if members else "string",
        "enum_members": [member(m) for m in members] if isinstance(members, list) else None,
        "stability": raw.get("stability") or "development",
        "brief": _text(raw.get("brief")),
        "note": _text(raw.get("note")) or None,
        "examples": [e if isinstance(e, str) else json.dumps(e, separators=(",", ":")) for e in _list(raw.get("examples"))],
        "deprecated": _deprecated(raw.get("deprecated")),
    }


def groups_of(file: str, doc: dict | None) -> list[dict]:
    """Groups of one model file of either format, in order. Refinements narrow the signal that they name."""
    found: list[tuple[str, str, dict, str | None, bool]] = []
    if not doc:
        return []
    if isinstance(doc.get("groups"), list):
        for g in doc["groups"]:
            found.append((_text(g.get("id")), GROUP_TYPES.get(_text(g.get("type")), "attribute_group"), g, _text(g.get("metric_name")) or _text(g.get("name")) or None, False))
    else:
        if isinstance(doc.get("attributes"), list):
            found.append((f"file:{file}", "attribute_group", {"attributes": doc["attributes"]}, None, False))
        # Sections of the newer format: key, type, id's prefix and field, signal's field, refinement.
        for key, kind, prefix, ident, name, refines in (
            ("attribute_groups", "attribute_group", "", "id", None, False),
            ("metrics", "metric", "metric.", "name", "name", False),
            ("metric_refinements", "metric", "", "id", "ref", True),
            ("spans", "span", "", "type", "type", False),
            ("span_refinements", "span", "", "id", "ref", True),
            ("events", "event", "event.", "name", "name", False),
            ("entities", "entity", "entity.", "name", "name", False),
        ):
            found += [(prefix + _text(g.get(ident)), kind, g, _text(g.get(name)) if name else None, refines) for g in _list(doc.get(key))]
    out = []
    for place, (ident, kind, raw, signal, refines) in enumerate(found):
        entries = [e for e in _list(raw.get("attributes")) if isinstance(e, dict)]
        parents = ([_text(raw["extends"])] if raw.get("extends") else []) + [_text(e["ref_group"]) for e in entries if e.get("ref_group")]
        out.append(
            {
                "file": file, "place": place, "id": ident, "type": kind, "signal_name": signal, "refinement": refines, "parents": parents,
                "definitions": [_definition(e) for e in entries if e.get("id") or e.get("key")],
                "refs": [{"ref": _text(e["ref"]), "level": _level(e.get("requirement_level"))} for e in entries if e.get("ref")],
                "stability": raw.get("stability") or "development", "brief": _text(raw.get("brief")), "note": _text(raw.get("note")) or None,
                "instrument": _text(raw.get("instrument")), "unit": _text(raw.get("unit")), "span_kind": _text(raw.get("span_kind")) or _text(raw.get("kind")) or None,
                "deprecated": _deprecated(raw.get("deprecated")),
            }
        )
    return out


def read_model(spark: SparkSession, root: str) -> DataFrame:
    """(path, content binary) of all model files of a tree."""
    base = F.lit(root.rstrip("/") + "/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.yaml").load(root)
    return files.select(F.split_part("path", base, F.lit(-1)).alias("path"), "content")


#: Files whose groups are one batch of a task.
BATCH = 200


def groups(files: DataFrame) -> DataFrame:
    """Groups of all files, with an ordinal in file and place order. YAML is read by PyYAML, a file at a time.

    Files are dealt out first, since thousands of short ones may come in one partition, and what
    was parsed is stored, since everything below reads it several times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        class Core(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
            """Scalars as YAML 1.2 has them: on, off, yes, no and dates are strings."""

        kept = lambda tag: tag not in ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:timestamp")
        Core.yaml_implicit_resolvers = {k: [x for x in v if kept(x[0])] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
        Core.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile("^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))

        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                rows = [g for path, content in zip(*(part.column(i).to_pylist() for i in (0, 1)), strict=True) for g in groups_of(path, yaml.load(content, Core))]
                yield pa.RecordBatch.from_pylist(rows, _GROUP)

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.select("path", F.col("content").cast("binary").alias("content")).repartition(n, "path")
    return stored(dealt.mapInArrow(run, GROUP), "groups")


def attributes(found: DataFrame) -> DataFrame:
    """Definitions, of repeated ids the last in file order."""
    rows = found.select(F.struct("file", "place").alias("at"), "file", F.posexplode("definitions").alias("k", "d")).select(F.struct("at", "k").alias("ordinal"), F.col("file").alias("defined_in"), "d.*").where("id <> ''")
    rows = last_wins(rows, ["id"], "ordinal")
    d = F.col("deprecated")
    return rows.select("id", "type", "enum_members", "stability", "brief", "note", "examples", d["reason"].alias("reason"), d["renamed_to"].alias("renamed_to"), d["note"].alias("deprecation_note"), namespace(F.col("id")).alias("namespace"), "defined_in")


def usage(found: DataFrame, definitions: DataFrame) -> DataFrame:
    """(id, group_id, group_type, signal_name, level): of a group's references, inherited ones first, the last for each attribute.

    References to attributes that nobody defines are dropped; edges are unique by (attribute, group, level).
    """
    by_id = last_wins(found.where("id <> ''").select("id", "parents", "refs", F.struct("file", "place").alias("ordinal")), ["id"], "ordinal")
    edges = by_id.select(F.col("id").alias("child"), F.posexplode("parents").alias("k", "parent")).join(by_id.select(F.col("id").alias("parent")), "parent")
    reach = inherited(by_id.select("id"), edges)
    refs = by_id.select(F.col("id").alias("node"), F.posexplode("refs").alias("k", "r"))
    rows = reach.join(refs, "node").select(F.col("root").alias("group_id"), F.col("r.ref").alias("id"), F.col("r.level").alias("level"), F.struct("place", "k").alias("ordinal"))
    rows = last_wins(rows, ["group_id", "id"], "ordinal")
    named = last_wins(found.where("id <> ''").select(F.col("id").alias("group_id"), F.col("type").alias("group_type"), "signal_name", F.struct("file", "place").alias("ordinal")), ["group_id"], "ordinal").drop("ordinal")
    rows = rows.join(named, "group_id").join(definitions.select("id"), "id", "left_semi")
    return rows.select("id", "group_id", "group_type", "signal_name", "level").dropDuplicates(["id", "group_id", "level"])


def _signal_rows(found: DataFrame) -> DataFrame:
    d = F.col("deprecated")
    rows = found.where(~F.col("refinement") & (F.col("type") != "attribute_group"))
    return rows.select(F.col("id"), F.coalesce("signal_name", "id").alias("name"), F.col("type").alias("kind"), "stability", "brief", "note", "instrument", "unit", "span_kind", d["reason"].alias("reason"), d["renamed_to"].alias("renamed_to"), d["note"].alias("deprecation_note"), F.col("file").alias("defined_in"), F.struct("file", "place").alias("ordinal"))


def metrics(found: DataFrame) -> DataFrame:
    """Metrics by name, the last of a name."""
    rows = last_wins(_signal_rows(found).where("kind = 'metric'").drop("id", "kind", "span_kind"), ["name"], "ordinal")
    return rows.drop("ordinal").withColumnRenamed("name", "id")


def signals(found: DataFrame) -> DataFrame:
    """Spans, events and entities by id, the last of an id."""
    return last_wins(_signal_rows(found).where("kind <> 'metric'").drop("instrument", "unit"), ["id"], "ordinal").drop("ordinal")
