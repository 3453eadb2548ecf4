"""Queries over the parsers and text functions: files are written from the sample tables, so SQL can say what must be found in them."""

from __future__ import annotations

import importlib.util

from pyspark.sql import functions as F

from ledgerline.functions import ranks
from ledgerline.functions import text as TX
from ledgerline.operators import changes as C
from ledgerline.operators import lookup, registry, topics
from ledgerline.plans import diffs
from ledgerline.plans import fixtures as X
from ledgerline.sources import prose, wire
from ledgerline.sources import registry as models


def _files(spark, sf, suffix: str, template: str):
    """One file a supplier; {k} its key, {n} its name, {s} one of three statuses."""
    status = F.element_at(F.array(*map(F.lit, ("Stable", "Experimental", "Release Candidate"))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    text = F.lit(template)
    for mark, value in (("{k}", F.col("s_suppkey").cast("string")), ("{n}", F.col("s_name")), ("{s}", status)):
        text = F.replace(text, F.lit(mark), value)
    return X.read(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(suffix)).alias("path"), text.alias("text"))


_S = "s AS (SELECT s_suppkey AS k, s_name AS n, CASE s_suppkey % 3 WHEN 0 THEN 'Stable' WHEN 1 THEN 'Experimental' ELSE 'Release Candidate' END AS status FROM supplier)"

# prose

_MARKDOWN = """<!--- front --->
# Supplier *{n}*

**Status**: [{s}](x), more

Intro without keyword. The supplier MUST keep {k} parts.

## Rules
It SHOULD NOT sell `a_b`, e.g. (any). It may wait.
- One MAY pay _later_
- two
```
It MUST NOT show.
```
## Rules
One of these MUST hold:

- alpha {k}
- beta
  - deep

See [the _list_](y) for __more__ text.
"""


def _sections(spark, sf):
    return prose.sections(_files(spark, sf, ".md", _MARKDOWN))


def markdown_sections(spark, sf):
    return _sections(spark, sf).select("id", "title", "depth", "status", "length", "ordinal")


def markdown_documents(spark, sf):
    return prose.documents(_files(spark, sf, ".md", _MARKDOWN))


def markdown_requirements(spark, sf):
    return prose.requirements(_sections(spark, sf)).select("id", "level", "text", "section", "title", "status", "ordinal")


_ANCHOR = "'s' || k || '.md#' || 'supplier-' || lower(replace(n, '#', ''))"
_BODIES = f"""b AS (SELECT {_ANCHOR} AS id, 'Supplier ' || n AS title, 1 AS depth, status, '**Status**: [' || status || '](x), more' || chr(10) || chr(10) || 'Intro without keyword. The supplier MUST keep ' || k || ' parts.' AS body, 0 AS ordinal FROM s
UNION ALL SELECT 's' || k || '.md#rules', 'Rules', 2, status, 'It SHOULD NOT sell `a_b`, e.g. (any). It may wait.' || chr(10) || '- One MAY pay _later_' || chr(10) || '- two', 1 FROM s
UNION ALL SELECT 's' || k || '.md#rules-1', 'Rules', 2, status, 'One of these MUST hold:' || chr(10) || chr(10) || '- alpha ' || k || chr(10) || '- beta' || chr(10) || '  - deep' || chr(10) || chr(10) || 'See [the _list_](y) for __more__ text.', 2 FROM s)"""
_SENTENCES = f"""r AS (SELECT 'MUST' AS level, 'The supplier MUST keep ' || k || ' parts.' AS text, {_ANCHOR} AS section, 'Supplier ' || n AS title, status, 0 AS ordinal FROM s
UNION ALL SELECT 'SHOULD NOT', 'It SHOULD NOT sell `a_b`, e.g. (any).', 's' || k || '.md#rules', 'Rules', status, 0 FROM s
UNION ALL SELECT 'MAY', 'One MAY pay later', 's' || k || '.md#rules', 'Rules', status, 1 FROM s
UNION ALL SELECT 'MUST', 'One of these MUST hold: alpha ' || k || '; beta; deep', 's' || k || '.md#rules-1', 'Rules', status, 0 FROM s)"""

# wire

_WIRE = """syntax = "proto3";
package p.v1;
// Licence.

// Thing {k}.
// More of it.
message M{k} {
  reserved 4, 9, 100 to 200;
  // deprecated: old
  repeated string names = 1;
  oneof body {
    int32 a = 2; Other b = 3;
  }
  map<string, string> tags = 8 [deprecated = true];
  message Inner { optional int64 x = 1{k}; }
  enum Kind {
    NONE = 0;
    NEG = -{k} [deprecated = true];
  }
}
/* The
 * service. */
service S{k} { rpc Get(A) returns (B) {} }
"""


def _wire(spark, sf):
    return wire.messages(_files(spark, sf, ".proto", _WIRE))


def wire_definitions(spark, sf):
    ints = F.array_join(F.transform("reserved", lambda x: x.cast("string")), ",")
    spans = F.array_join(F.transform("reserved_ranges", lambda r: F.concat(r["low"].cast("string"), F.lit("-"), r["high"].cast("string"))), ",")
    return _wire(spark, sf).select("name", "kind", "file", "deprecated", "comment", ints.alias("reserved"), spans.alias("ranges"))


def wire_definition_fields(spark, sf):
    return _wire(spark, sf).select(F.col("name").alias("message"), F.inline("fields"))


def wire_definition_values(spark, sf):
    return _wire(spark, sf).select(F.col("name").alias("message"), F.inline("values"))


_MESSAGES = """SELECT 'p.v1.M' || k AS name, 'message' AS kind, 's' || k || '.proto' AS file, false AS deprecated, 'Thing ' || k || '. More of it.' AS comment, '4,9' AS reserved, '100-200' AS ranges FROM s
UNION ALL SELECT 'p.v1.M' || k || '.Inner', 'message', 's' || k || '.proto', false, NULL, '', '' FROM s UNION ALL SELECT 'p.v1.M' || k || '.Kind', 'enum', 's' || k || '.proto', false, NULL, '', '' FROM s
UNION ALL SELECT 'p.v1.S' || k, 'service', 's' || k || '.proto', false, 'The service.', '', '' FROM s"""
_FIELDS = """SELECT 'p.v1.M' || k AS message, f.* FROM s, (VALUES ('names', 1, 'string', 'repeated', NULL, true, 'deprecated: old'), ('a', 2, 'int32', NULL, 'body', false, NULL), ('b', 3, 'Other', NULL, 'body', false, NULL), ('tags', 8, 'map<string, string>', NULL, NULL, true, NULL)) f(name, number, type, label, oneof, deprecated, comment)
UNION ALL SELECT 'p.v1.M' || k || '.Inner', 'x', CAST('1' || k AS INT), 'int64', 'optional', NULL, false, NULL FROM s"""
_VALUES = "SELECT 'p.v1.M' || k || '.Kind' AS message, 'NONE' AS name, 0 AS number, false AS deprecated FROM s UNION ALL SELECT 'p.v1.M' || k || '.Kind', 'NEG', CAST(-k AS INT), true FROM s"

# registry model

_MODEL = """groups:
  - id: base{k}
    type: attribute_group
    attributes:
      - id: s{k}.size
        type: int
        brief: " Size of {k} "
        stability: stable
        examples: [1, "two"]
      - id: s{k}.mode
        type: {members: [{id: on, value: 1}, {id: off, value: "0"}]}
        deprecated: {reason: renamed, renamed_to: s{k}.way, note: " gone "}
      - id: s{k}.old
        type: template[string]
        deprecated: Use the way.
  - id: span.s{k}.call
    type: span
    span_kind: client
    extends: base{k}
    attributes:
      - ref: s{k}.size
        requirement_level: {conditionally_required: if known}
      - ref: nobody.knows
  - id: metric.s{k}
    type: metric
    metric_name: s{k}.count
    instrument: counter
    unit: "1"
    attributes:
      - ref_group: span.s{k}.call
      - ref: s{k}.mode
        requirement_level: opt_in
"""


def _groups(spark, sf):
    return models.groups(_files(spark, sf, ".yaml", _MODEL).withColumnRenamed("text", "content"))


def model_attributes(spark, sf):
    members = F.array_join(F.transform(F.coalesce("enum_members", F.array()), lambda m: F.concat(m["id"], F.lit("="), m["value"])), ",")
    return models.attributes(_groups(spark, sf)).select("id", "type", members.alias("members"), "stability", "brief", F.array_join("examples", ",").alias("examples"), "reason", "renamed_to", "deprecation_note", "namespace", "defined_in")


def model_usage(spark, sf):
    found = _groups(spark, sf)
    return models.usage(found, models.attributes(found))


def model_signals(spark, sf):
    found = _groups(spark, sf)
    shown = ["kind", "stability", "unit", "instrument", "span_kind"]
    metrics = models.metrics(found).select("id", F.lit("metric").alias("kind"), "stability", "unit", "instrument", F.lit(None).cast("string").alias("span_kind"))
    return metrics.unionByName(models.signals(found).select("id", "kind", "stability", F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("instrument"), "span_kind")).select("id", *shown)


_ATTRIBUTES = """SELECT 's' || k || '.size' AS id, 'int' AS type, '' AS members, 'stable' AS stability, 'Size of ' || k AS brief, '1,two' AS examples, NULL AS reason, NULL AS renamed_to, NULL AS deprecation_note, 's' || k AS namespace, 's' || k || '.yaml' AS defined_in FROM s
UNION ALL SELECT 's' || k || '.mode', 'enum', 'on=1,off=0', 'development', '', '', 'renamed', 's' || k || '.way', 'gone', 's' || k, 's' || k || '.yaml' FROM s
UNION ALL SELECT 's' || k || '.old', 'template[string]', '', 'development', '', '', 'uncategorized', NULL, 'Use the way.', 's' || k, 's' || k || '.yaml' FROM s"""
_USAGE = """SELECT 's' || k || '.size' AS id, 'span.s' || k || '.call' AS group_id, 'span' AS group_type, NULL AS signal_name, 'conditionally_required' AS level FROM s
UNION ALL SELECT 's' || k || '.size', 'metric.s' || k, 'metric', 's' || k || '.count', 'conditionally_required' FROM s UNION ALL SELECT 's' || k || '.mode', 'metric.s' || k, 'metric', 's' || k || '.count', 'opt_in' FROM s"""
_SIGNALS = "SELECT 's' || k || '.count' AS id, 'metric' AS kind, 'development' AS stability, '1' AS unit, 'counter' AS instrument, NULL AS span_kind FROM s UNION ALL SELECT 'span.s' || k || '.call', 'span', 'development', NULL, NULL, 'client' FROM s"

# text functions


def text_functions(spark, sf):
    """Functions of one text, over parts: their names as titles, queries, keys and HTML."""
    rows = X.read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("n"), F.lower("p_type").alias("t"))
    k, n, t = F.col("k"), F.col("n"), F.col("t")
    key = F.concat(t, F.lit("."), F.replace(n, F.lit(" "), F.lit("_")))
    query = F.concat(F.when(k % 2 == 0, "Attr: ").otherwise(""), n, F.lit("  HTTP"))
    return rows.select(
        "k",
        TX.slug(F.concat(F.lit("The `"), n, F.lit("` [label](x) & more!"))).alias("slug"),
        TX.clean(F.concat(n, F.lit("  [label](x)  `code`"))).alias("clean"),
        TX.clean_note(F.concat(n, F.lit(" (#12)"))).alias("note"),
        TX.truncate(F.repeat(n, 3), 20).alias("short"),
        TX.normal(F.concat(F.lit("**"), n, F.lit("** _is_ `a_b_c` [here](y)"))).alias("normal"),
        F.array_join(TX.names_in(F.concat(F.lit("set "), key, F.lit(", "), key, F.lit("; and x.y."))), ",").alias("names"),
        TX.query_type(query).alias("type"),
        F.array_join(TX.query_terms(query), ",").alias("terms"),
        TX.is_question(F.concat(F.when(k % 3 == 0, "what is ").otherwise(""), n)).alias("asks"),
        TX.is_subsequence(F.lit("ri"), n).alias("within"),
        F.array_join(TX.question_words(F.concat(F.lit("Which is the "), n, F.lit("?"))), ",").alias("words"),
        TX.namespace(key).alias("namespace"),
        TX.signal_key(F.concat(F.when(k % 2 == 0, "span.").otherwise("metric."), key)).alias("signal"),
        TX.version_label(F.when(k % 2 == 0, "1.2.0").otherwise("2024-01-02")).alias("version"),
        TX.short_id(F.when(k % 2 == 0, "section").otherwise("attribute"), F.concat(F.lit("a/b/c.md#"), n)).alias("place"),
        TX.lead(F.concat(n, F.lit(". Status: [x]"))).alias("lead"),
        TX.highlight(F.concat(F.lit("<"), n), F.array(F.lit("ring"), F.lit("x"))).alias("marked"),
        TX.inline_code(F.concat(F.lit("`"), n, F.lit("` [l](http://u) [m](/p?a&b) [x](y)")), "https://h/v$1").alias("html"),
        TX.date_label(F.concat(F.lit("2024-0"), (k % 9 + 1).cast("string"), F.lit("-03T00:00:00Z"))).alias("day"),
        ranks.shown(ranks.KIND_LABELS, F.when(k % 2 == 0, "field-number-changed").otherwise("other")).alias("kind"),
        ranks.counted(F.when(k % 2 == 0, "field-removed").otherwise("renamed"), k % 3).alias("counted"),
    )


TEXT_SQL = """WITH p AS (SELECT p_partkey AS k, p_name AS n, lower(p_type) AS t, lower(p_type) || '.' || replace(p_name, ' ', '_') AS key FROM part)
SELECT k, 'the-' || replace(n, ' ', '-') || '-label-more' AS slug, n || ' label code' AS clean, n AS note, CASE WHEN length(n) * 3 <= 20 THEN repeat(n, 3) ELSE left(repeat(n, 3), 19) || '...' END AS short,
  n || ' is `a_b_c` here' AS normal, key || ',x.y' AS names, CASE WHEN k % 2 = 0 THEN 'attribute' END AS type, replace(n, ' ', ',') || ',http' AS terms, k % 3 = 0 AND length(n) >= 0 AS asks,
  regexp_matches(n, 'r.*i') AS within, replace(n, ' ', ',') AS words, t AS namespace, CASE WHEN k % 2 = 0 THEN key ELSE 'metric.' || key END AS signal, CASE WHEN k % 2 = 0 THEN 'v1.2.0' ELSE '2024-01-02' END AS version,
  CASE WHEN k % 2 = 0 THEN 'b/c.md#' || n ELSE 'a/b/c.md#' || n END AS place, n AS lead, '&lt;' || replace(n, 'ring', '<mark>ring</mark>') AS marked, '<code>' || n || '</code> <a href="http://u">l</a> <a href="https://h/v$1/p?a&amp;b">m</a> x' AS html, '3 ' || ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sept'][k % 9 + 1] || ' 2024' AS day,
  CASE WHEN k % 2 = 0 THEN 'renumbered' ELSE 'other' END AS kind, (k % 3) || CASE WHEN k % 2 = 1 THEN ' renamed' WHEN k % 3 = 1 THEN ' field removed' ELSE ' fields removed' END AS counted FROM p"""

# other operators


def signal_diff(spark, sf):
    return registry.signal_changes(X.registry(spark, sf, 1), X.registry(spark, sf, 2)).select("kind", "severity", "id", "stability", "detail", "from_value", "to_value", "renamed_to")


def changes_first(spark, sf):
    """The most consequential changes of a registry diff, in the order in which they are shown."""
    return C.ordered(registry.attribute_changes(X.members(X.registry(spark, sf, 1), 1), X.members(X.registry(spark, sf, 2), 2))).limit(60).select("kind", "severity", "id")


def _case(values: list[str], column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(values)) + " ELSE -1 END"


def packages_listed(spark, sf):
    order = spark.createDataFrame([("wire.v1development", 0), ("wire.v1", 1)], "package string, ordinal int")
    return topics.packages(X.messages(spark, sf, 2), order)


def usage_by_kind(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("span", "event", "attribute_group"))), (F.substring("group_id", 2, 9).cast("int") % 3 + 1).cast("int"))
    rows = X.usage(spark, sf, 1).withColumn("group_type", kind).withColumn("signal_name", F.expr("CASE WHEN ordinal % 2 = 0 THEN concat(signal, '.named') END"))
    return topics.usage_by_kind(rows).select("id", "group_type", F.array_join("signals", ",").alias("signals"))


_BY_KIND = f"""SELECT id, group_type, list_aggregate(list_sort(list(DISTINCT name)), 'string_agg', ',') AS signals FROM (
SELECT id, CASE CAST(substr(group_id, 2) AS INT) % 3 WHEN 0 THEN 'span' WHEN 1 THEN 'event' ELSE 'attribute_group' END AS group_type, CASE WHEN ordinal % 2 = 0 THEN signal || '.named' ELSE group_id END AS name FROM ({X.usage_sql(1)})) WHERE group_type <> 'attribute_group' GROUP BY ALL"""


def names_checked(spark, sf):
    """Names against the compact index: live ids, deprecated ones, template prefixes."""
    known = X.registry(spark, sf, 2)
    names = known.select("id").unionByName(known.select(F.concat("id", F.lit(".x")).alias("id"))).withColumnRenamed("id", "name")
    plain = known.where("type NOT LIKE 'template%'")
    return lookup.checked_names(names, plain.where("reason IS NULL"), plain.where("reason IS NOT NULL").withColumn("replacement", F.col("renamed_to")), known.where("type LIKE 'template%' AND reason IS NULL"))


_CHECKED = f"""WITH r AS ({X.registry_sql(2)}), n AS (SELECT id AS name, id AS base, false AS more FROM r UNION ALL SELECT id || '.x', id, true FROM r)
SELECT name, CASE WHEN NOT more AND type NOT LIKE 'template%' THEN CASE WHEN reason IS NULL THEN 'ok' WHEN renamed_to IS NOT NULL THEN 'renamed' ELSE 'deprecated' END WHEN more AND type LIKE 'template%' AND reason IS NULL THEN 'template' ELSE 'unknown' END AS status,
  CASE WHEN NOT more AND type NOT LIKE 'template%' AND reason IS NOT NULL THEN renamed_to END AS replacement, CASE WHEN more AND type LIKE 'template%' AND reason IS NULL THEN base END AS prefix FROM n JOIN r ON r.id = n.base"""

QUERIES = {
    "markdown_sections": markdown_sections,
    "markdown_documents": markdown_documents,
    "markdown_requirements": markdown_requirements,
    "wire_definitions": wire_definitions,
    "wire_definition_fields": wire_definition_fields,
    "wire_definition_values": wire_definition_values,
    "text_functions": text_functions,
    "signal_diff": signal_diff,
    "changes_first": changes_first,
    "packages_listed": packages_listed,
    "usage_by_kind": usage_by_kind,
    "names_checked": names_checked,
}
ORACLES = {
    "markdown_sections": f"WITH {_S}, {_BODIES} SELECT id, title, depth, status, CAST(length(body) AS INT) AS length, ordinal FROM b",
    "markdown_documents": f"WITH {_S} SELECT 's' || k || '.md' AS path, 'Supplier ' || n AS title, status FROM s",
    "markdown_requirements": f"WITH {_S}, {_SENTENCES} SELECT left(sha256(section || '|' || lower(text)), 12) AS id, * FROM r",
    "wire_definitions": f"WITH {_S} {_MESSAGES}",
    "wire_definition_fields": f"WITH {_S} {_FIELDS}",
    "wire_definition_values": f"WITH {_S} {_VALUES}",
    "text_functions": TEXT_SQL,
    "signal_diff": f"WITH b AS ({X.registry_sql(1)}), a AS ({X.registry_sql(2)}), j AS (SELECT a, b FROM b FULL OUTER JOIN a ON a.id = b.id) SELECT kind, severity, id, stability, detail, from_value, to_value, renamed_to FROM ({diffs.lifecycle_sql('signal')}) WHERE kind NOT IN ('unit-changed', 'instrument-changed')",
    "changes_first": f"{diffs.REGISTRY_SQL} SELECT kind, severity, id FROM changes WHERE entity = 'attribute' ORDER BY {_case(ranks.SEVERITIES, 'severity')}, {_case(ranks.KINDS, 'kind')}, replace(replace(id, '_', ' '), '.', '!') LIMIT 60",
    "packages_listed": f"SELECT name, CASE WHEN name LIKE 'wire.v1development%' THEN 'wire.v1development' ELSE 'wire.v1' END AS package, CASE WHEN name LIKE 'wire.v1development%' THEN 0 ELSE 1 END AS ordinal FROM ({X.messages_sql(2)})",
    "usage_by_kind": _BY_KIND,
    "names_checked": _CHECKED,
}
if importlib.util.find_spec("yaml"):  # the registry's model files are YAML; its reader is an optional library
    QUERIES |= {"model_attributes": model_attributes, "model_usage": model_usage, "model_signals": model_signals}
    ORACLES |= {"model_attributes": f"WITH {_S} {_ATTRIBUTES}", "model_usage": f"WITH {_S} {_USAGE}", "model_signals": f"WITH {_S} {_SIGNALS}"}
