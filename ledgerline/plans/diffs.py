"""Queries that compare two versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import changes as C
from ledgerline.operators import matching, prose, registry, wire
from ledgerline.plans import fixtures as X

_SHOWN = ["kind", "severity", "entity", "id", "stability", "detail", "from_value", "to_value", "renamed_to"]


def attribute_changes(spark, sf):
    return registry.attribute_changes(X.members(X.registry(spark, sf, 1), 1), X.members(X.registry(spark, sf, 2), 2))


def metric_changes(spark, sf):
    return registry.metric_changes(X.registry(spark, sf, 1), X.registry(spark, sf, 2))


def registry_diff(spark, sf):
    return C.ordered(registry.registry_changes(attribute_changes(spark, sf), metric_changes(spark, sf))).select(_SHOWN)


def _stable(x: str) -> str:
    return f"{x}.stability IN ('stable', 'release_candidate')"


def _hard(x: str) -> str:
    return f"CASE WHEN {_stable(x)} THEN 'breaking' ELSE 'notable' END"


_RANK = "CASE {}.stability WHEN 'stable' THEN 3 WHEN 'release_candidate' THEN 2 WHEN 'deprecated' THEN 0 ELSE 1 END"
_DKEY = "coalesce({0}.reason || coalesce('->' || {0}.renamed_to, ''), '')"


def lifecycle_sql(entity: str) -> str:
    def row(kind: str, severity: str, side: str, detail: str, where: str, old="NULL", new="NULL", to="NULL") -> str:
        return f"SELECT '{kind}' AS kind, {severity} AS severity, '{entity}' AS entity, {side}.id AS id, {side}.stability AS stability, {detail} AS detail, {old} AS from_value, {new} AS to_value, {to} AS renamed_to FROM j WHERE {where}"

    both, moved = "a.id IS NOT NULL AND b.id IS NOT NULL", f"{_DKEY.format('a')} <> {_DKEY.format('b')}"
    up = f"{_RANK.format('a')} > {_RANK.format('b')}"
    same = f"{_RANK.format('a')} = {_RANK.format('b')}"
    rows = [
        row("removed", _hard("b"), "b", "'Removed from the registry (was ' || b.stability || ').'", "a.id IS NULL"),
        row("added", "'informational'", "a", "a.brief", "b.id IS NULL"),
        row("renamed", _hard("b"), "a", "'Renamed to `' || a.renamed_to || '`.'", f"{both} AND {moved} AND a.reason = 'renamed'", "a.id", "a.renamed_to", "a.renamed_to"),
        row("deprecated", _hard("b"), "a", "'Deprecated (' || a.reason || ').'", f"{both} AND {moved} AND a.reason <> 'renamed'"),
        row("undeprecated", "'notable'", "a", "'No longer marked deprecated.'", f"{both} AND {moved} AND a.reason IS NULL"),
        row("stability-changed", f"CASE WHEN {same} THEN 'informational' WHEN {up} THEN 'notable' ELSE {_hard('b')} END", "a", f"CASE WHEN {same} THEN 'Stability label respelled from ' || b.stability || ' to ' || a.stability || '.' WHEN {up} THEN 'Promoted to ' || a.stability || '.' ELSE 'Stability lowered to ' || a.stability || '.' END", f"{both} AND a.stability <> b.stability", "b.stability", "a.stability"),
        row("note-changed", "'informational'", "a", "'Guidance note changed.'", f"{both} AND a.note IS DISTINCT FROM b.note"),
        row("brief-changed", "'informational'", "a", "a.brief", f"{both} AND a.note IS NOT DISTINCT FROM b.note AND a.brief <> b.brief"),
    ]
    values = [("type", "Type")] if entity == "attribute" else [("unit", "Unit"), ("instrument", "Instrument")]
    for name, title in values:
        rows.append(row(f"{name}-changed", _hard("a"), "a", f"'{title} changed from `' || b.{name} || '` to `' || a.{name} || '`.'", f"{both} AND a.{name} <> b.{name}", f"b.{name}", f"a.{name}"))
    if entity == "attribute":
        k = "a.ordinal"
        rows.append(row("enum-members-changed", f"CASE WHEN {_stable('a')} THEN 'notable' ELSE 'informational' END", "a", "'Enum members changed (2 to 2).'", f"{both} AND {k} % 3 = 0 AND ({k} % 31 = 1) <> ({k} % 31 = 2)"))
        rows.append(row("examples-changed", "'informational'", "a", "'Examples changed.'", f"{both} AND ({k} % 37 = 1) <> ({k} % 37 = 2)"))
    return " UNION ALL ".join(rows)


REGISTRY_SQL = f"""WITH b AS ({X.registry_sql(1)}), a AS ({X.registry_sql(2)}), j AS (SELECT a, b FROM b FULL OUTER JOIN a ON a.id = b.id),
changes AS ({lifecycle_sql('attribute')} UNION ALL {lifecycle_sql('metric')})
"""


def registry_tally(spark, sf):
    return C.tally(registry_diff(spark, sf))


def changes_by_kind(spark, sf):
    return C.by_kind(registry_diff(spark, sf))


def promotions(spark, sf):
    return attribute_changes(spark, sf).where("kind = 'stability-changed' AND detail LIKE 'Promoted%'").select("id", "from_value", "to_value")


def enum_members_changed(spark, sf):
    return attribute_changes(spark, sf).where("kind = 'enum-members-changed'").select("id", "severity", "detail")


def metric_shapes(spark, sf):
    return metric_changes(spark, sf).where("kind IN ('unit-changed', 'instrument-changed')").select("id", "kind", "severity", "from_value", "to_value")


def _usage(spark, sf):
    before, after = X.usage(spark, sf, 1), X.usage(spark, sf, 2)
    parts = X.registry(spark, sf, 2).select(F.concat(F.lit("a"), F.col("ordinal").cast("string")).alias("id"), "stability")
    both = X.registry(spark, sf, 1).select(F.concat(F.lit("a"), F.col("ordinal").cast("string")).alias("id"))
    return registry.usage_changes(before, after, parts.join(both, "id", "left_semi"))


def usage_levels(spark, sf):
    return _usage(spark, sf).where("kind = 'requirement-level-changed'").select("id", "severity", "detail", "from_value", "to_value")


def usage_gained_lost(spark, sf):
    return _usage(spark, sf).where("kind = 'usage-changed'").select("id", "severity", "detail")


def _effective(v: int) -> str:
    return f"SELECT id, signal, (max_by(level, (ordinal, level))) AS level, min(ordinal) AS ordinal FROM ({X.usage_sql(v)}) GROUP BY id, signal"


_D = "CASE {} WHEN 'opt_in' THEN 0 WHEN 'recommended' THEN 1 WHEN 'conditionally_required' THEN 2 ELSE 3 END"
_NAMES = "CASE WHEN n = 1 THEN '`' || s[1] || '`' WHEN n = 2 THEN '`' || s[1] || '` and `' || s[2] || '`' ELSE '`' || s[1] || '`, `' || s[2] || '` and ' || (n - 2) || CASE WHEN n = 3 THEN ' other' ELSE ' others' END END"
USAGE_SQL = f"""WITH b AS ({_effective(1)}), a AS ({_effective(2)}),
e AS (SELECT id, signal, b.level AS old, a.level AS new, coalesce(a.ordinal, b.ordinal) AS ordinal, CASE WHEN b.level IS NULL THEN 'gained' WHEN a.level IS NULL THEN 'lost' WHEN a.level <> b.level THEN 'moved' END AS what FROM b FULL OUTER JOIN a USING (id, signal)),
g AS (SELECT id, what, count(*) AS n, list(signal ORDER BY ordinal, signal) AS s, replace(first(old ORDER BY ordinal, signal), '_', ' ') AS was, replace(first(new ORDER BY ordinal, signal), '_', ' ') AS now,
  first(old ORDER BY ordinal, signal) AS old, first(new ORDER BY ordinal, signal) AS new, bool_or({_D.format('new')} > {_D.format('old')}) AS up, bool_or(new IS NOT NULL AND {_D.format('new')} >= 2) AS must FROM e WHERE what IS NOT NULL GROUP BY id, what),
r AS (SELECT concat('a', cast(a.ordinal AS string)) AS id, a.stability IN ('stable', 'release_candidate') AS stable FROM ({X.registry_sql(2)}) a JOIN ({X.registry_sql(1)}) b ON a.id = b.id)
"""


def wire_fields(spark, sf):
    m1, m2 = X.messages(spark, sf, 1), X.messages(spark, sf, 2)
    return wire.field_changes(m1, m2, X.fields(spark, sf, 1), X.fields(spark, sf, 2)).select("kind", "severity", "id", "stability", "detail", "from_value", "to_value", "renamed_to", "href")


def wire_renames(spark, sf):
    return wire_fields(spark, sf).where("kind = 'field-renamed'").select("id", "severity", "renamed_to")


def wire_messages(spark, sf):
    return wire.message_changes(X.messages(spark, sf, 1), X.messages(spark, sf, 2)).select("kind", "severity", "id", "stability", "detail", "href")


def wire_values(spark, sf):
    m1, m2 = X.messages(spark, sf, 1), X.messages(spark, sf, 2)
    return wire.value_changes(m1, m2, X.values(spark, sf, 1), X.values(spark, sf, 2)).select("kind", "severity", "id", "detail", "from_value", "to_value")


_DEV, _SOFT = "CASE WHEN message LIKE '%development%' THEN 'notable' ELSE 'breaking' END", "CASE WHEN message LIKE '%development%' THEN 'informational' ELSE 'notable' END"
_ST = "CASE WHEN message LIKE '%development%' THEN 'development' ELSE 'stable' END"
_SIDES = f"""WITH m AS (SELECT a.name AS message, a.file FROM ({X.messages_sql(1)}) b JOIN ({X.messages_sql(2)}) a ON a.name = b.name),
b AS (SELECT x.*, m.file FROM ({X.fields_sql(1)}) x JOIN m USING (message)), a AS (SELECT x.*, m.file FROM ({X.fields_sql(2)}) x JOIN m USING (message)),
"""
WIRE_FIELDS_SQL = f"""{_SIDES}
gone AS (SELECT b.*, (SELECT max_by(s.name, s.ordinal) FROM a s WHERE s.message = b.message AND s.number = b.number) AS successor FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.message = b.message AND a.name = b.name)),
gone2 AS (SELECT *, successor IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b x WHERE x.message = gone.message AND x.name = gone.successor) AS renamed FROM gone),
fresh AS (SELECT a.*, (SELECT max_by(s.name, s.ordinal) FROM b s WHERE s.message = a.message AND s.number = a.number) AS ancestor FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.message = b.message AND a.name = b.name)),
kept AS (SELECT a.message, a.name, a.file, a.number AS n2, b.number AS n1, a.type AS t2, b.type AS t1, coalesce(a.label, 'singular') AS l2, coalesce(b.label, 'singular') AS l1, a.deprecated AS d2, b.deprecated AS d1 FROM a JOIN b USING (message, name))
SELECT 'field-renamed' AS kind, {_DEV} AS severity, message || '.' || name AS id, {_ST} AS stability, 'Renamed to `' || successor || '` (field ' || number || ' unchanged). The binary encoding is unaffected; JSON keys on the name.' AS detail, name AS from_value, successor AS to_value, message || '.' || successor AS renamed_to, file AS href FROM gone2 WHERE renamed
UNION ALL SELECT 'field-removed', {_DEV}, message || '.' || name, {_ST}, 'Field ' || number || ' (`' || type || '`) removed.', NULL, NULL, NULL, file FROM gone2 WHERE NOT renamed
UNION ALL SELECT 'field-added', 'informational', message || '.' || name, {_ST}, 'Field ' || number || ', `' || coalesce(label || ' ', '') || type || '`.', NULL, NULL, NULL, file FROM fresh WHERE ancestor IS NULL OR EXISTS (SELECT 1 FROM a x WHERE x.message = fresh.message AND x.name = fresh.ancestor)
UNION ALL SELECT 'field-number-changed', {_DEV}, message || '.' || name, {_ST}, 'Field number changed from ' || n1 || ' to ' || n2 || '. Every previously encoded message decodes wrongly.', cast(n1 AS string), cast(n2 AS string), NULL, file FROM kept WHERE n1 <> n2
UNION ALL SELECT 'field-type-changed', {_DEV}, message || '.' || name, {_ST}, 'Type changed from `' || t1 || '` to `' || t2 || '`.', t1, t2, NULL, file FROM kept WHERE t1 <> t2
UNION ALL SELECT 'field-label-changed', {_DEV}, message || '.' || name, {_ST}, 'Cardinality changed from `' || l1 || '` to `' || l2 || '`.', l1, l2, NULL, file FROM kept WHERE l1 <> l2
UNION ALL SELECT 'deprecated', {_SOFT}, message || '.' || name, {_ST}, 'Field marked deprecated.', NULL, NULL, NULL, file FROM kept WHERE d2 AND NOT d1"""
WIRE_MESSAGES_SQL = f"""WITH j AS (SELECT coalesce(a.name, b.name) AS message, a, b FROM ({X.messages_sql(1)}) b FULL OUTER JOIN ({X.messages_sql(2)}) a ON a.name = b.name)
SELECT 'removed' AS kind, {_DEV} AS severity, message AS id, {_ST} AS stability, b.kind || ' removed from ' || b.file || '.' AS detail, NULL AS href FROM j WHERE a.name IS NULL
UNION ALL SELECT 'added', 'informational', message, {_ST}, coalesce(a.comment, 'New ' || a.kind || ' in ' || a.file || '.'), a.file FROM j WHERE b.name IS NULL
UNION ALL SELECT 'deprecated', {_SOFT}, message, {_ST}, a.kind || ' marked deprecated.', a.file FROM j WHERE a.deprecated AND NOT b.deprecated"""
WIRE_VALUES_SQL = f"""WITH m AS (SELECT a.name AS message FROM ({X.messages_sql(1)}) b JOIN ({X.messages_sql(2)}) a ON a.name = b.name),
j AS (SELECT message, name, b.number AS n1, a.number AS n2 FROM ({X.values_sql(1)}) b FULL OUTER JOIN ({X.values_sql(2)}) a USING (message, name) JOIN m USING (message))
SELECT 'value-removed' AS kind, {_DEV} AS severity, message || '.' || name AS id, 'Enum value ' || n1 || ' removed.' AS detail, NULL AS from_value, NULL AS to_value FROM j WHERE n2 IS NULL
UNION ALL SELECT 'value-added', 'informational', message || '.' || name, 'Enum value ' || n2 || ' added.', NULL, NULL FROM j WHERE n1 IS NULL
UNION ALL SELECT 'field-number-changed', {_DEV}, message || '.' || name, 'Enum value renumbered from ' || n1 || ' to ' || n2 || '.', cast(n1 AS string), cast(n2 AS string) FROM j WHERE n1 <> n2"""

# prose


def _documents(spark, sf, v: int):
    status = F.when(F.col("n") % 4 == v % 4, "Stable").when(F.col("n") % 4 == 3, "Release Candidate").otherwise("Draft")
    n = F.substring("source", 4, 9).cast("int")
    rows = X.read(spark, sf, "documents").select("source", n.alias("n")).distinct().where(f"n % 9 <> {v}")
    return rows.select(F.concat("source", F.lit(".md")).alias("path"), F.upper("source").alias("title"), status.alias("status"))


def _documents_sql(v: int) -> str:
    return f"SELECT concat(source, '.md') AS path, upper(source) AS title, CASE WHEN n % 4 = {v % 4} THEN 'Stable' WHEN n % 4 = 3 THEN 'Release Candidate' ELSE 'Draft' END AS status FROM (SELECT DISTINCT source, cast(substr(source, 4) AS int) AS n FROM documents) WHERE n % 9 <> {v}"


def _sections(spark, sf, v: int):
    rows = X.read(spark, sf, "documents").where(f"(doc_id + {v}) % 23 <> 0").selectExpr("concat(source, '.md#', cast(doc_id AS string)) AS id", "concat(source, '.md') AS path", "concat('T', cast(doc_id AS string)) AS title", f"CAST(length(text) + CASE WHEN doc_id % 5 = {v} THEN 700 ELSE 0 END AS int) AS length")
    return rows.join(_documents(spark, sf, v).select("path", "status"), "path")


def _sections_sql(v: int) -> str:
    return f"SELECT concat(source, '.md#', cast(doc_id AS string)) AS id, concat(source, '.md') AS path, concat('T', cast(doc_id AS string)) AS title, length(text) + CASE WHEN doc_id % 5 = {v} THEN 700 ELSE 0 END AS length, d.status FROM documents JOIN ({_documents_sql(v)}) d ON d.path = concat(source, '.md') WHERE (doc_id + {v}) % 23 <> 0"


def document_changes(spark, sf):
    return prose.document_changes(_documents(spark, sf, 1), _documents(spark, sf, 2)).select("kind", "severity", "id", "stability", "detail", "from_value", "to_value")


def section_changes(spark, sf):
    return prose.section_changes(_sections(spark, sf, 1), _sections(spark, sf, 2), _documents(spark, sf, 1), _documents(spark, sf, 2)).select("kind", "severity", "id", "stability", "detail", "href")


_PROMISE = "{} IN ('Stable', 'Release Candidate')"
DOCUMENTS_SQL = f"""WITH j AS (SELECT a, b FROM ({_documents_sql(1)}) b FULL OUTER JOIN ({_documents_sql(2)}) a ON a.path = b.path)
SELECT 'removed' AS kind, CASE WHEN {_PROMISE.format('b.status')} THEN 'breaking' ELSE 'notable' END AS severity, b.path AS id, b.status AS stability, 'Document removed (was ' || b.status || ').' AS detail, NULL AS from_value, NULL AS to_value FROM j WHERE a.path IS NULL
UNION ALL SELECT 'added', 'informational', a.path, a.status, 'New document: ' || a.title || ' (' || a.status || ').', NULL, NULL FROM j WHERE b.path IS NULL
UNION ALL SELECT 'stability-changed', 'notable', a.path, a.status, 'Status changed from ' || b.status || ' to ' || a.status || '.', b.status, a.status FROM j WHERE a.status <> b.status"""
SECTIONS_SQL = f"""WITH d1 AS ({_documents_sql(1)}), d2 AS ({_documents_sql(2)}), j AS (SELECT a, b FROM ({_sections_sql(1)}) b FULL OUTER JOIN ({_sections_sql(2)}) a ON a.id = b.id)
SELECT 'removed' AS kind, CASE WHEN {_PROMISE.format('b.status')} THEN 'notable' ELSE 'informational' END AS severity, b.id AS id, b.status AS stability, 'Section "' || b.title || '" removed.' AS detail, NULL AS href FROM j WHERE a.id IS NULL AND b.path IN (SELECT path FROM d2)
UNION ALL SELECT 'added', 'informational', a.id, a.status, 'New section "' || a.title || '".', a.id FROM j WHERE b.id IS NULL AND a.path IN (SELECT path FROM d1)
UNION ALL SELECT 'section-rewritten', 'informational', a.id, a.status, '"' || a.title || '" substantially rewritten (' || b.length || ' to ' || a.length || ' characters).', a.id FROM j WHERE a.id IS NOT NULL AND b.id IS NOT NULL AND abs(a.length - b.length) > 200 AND CASE WHEN b.length = 0 THEN 1.0 ELSE abs(a.length - b.length)::double / b.length END > 0.33"""


def requirement_extract(spark, sf):
    return X.requirements(spark, sf).select("id", "level", "section", "ordinal", F.length("text").alias("chars"))


def _sides(spark, sf):
    """Requirements before and after: some documents lose theirs, some get a word changed, some another level, some go to another section."""
    rows = X.requirements(spark, sf)
    n = F.split_part("section", F.lit("#"), F.lit(2)).cast("long")
    before = rows.where(n % 10 != 1)
    text = F.when(n % 3 == 0, F.regexp_replace("text", "(?<=[a-z]) (?=[a-z]+$)", " newly ")).otherwise(F.col("text"))
    level = F.when((n % 6 == 0) & (F.col("level") == "with"), "that").otherwise(F.col("level"))
    section = F.when(n % 7 == 3, F.concat(F.substring_index("section", "#", 1), F.lit("#"), (n - 3).cast("string"))).otherwise(F.col("section"))
    after = rows.where(n % 10 != 2).select(level.alias("level"), text.alias("text"), section.alias("section"), "ordinal").withColumn("id", F.substring(F.sha2(F.concat("section", F.lit("|"), F.lower("text")), 256), 1, 12))
    return before, after


_AFTER = "CASE WHEN n % 3 = 0 THEN regexp_replace(text, '([a-z]) ([a-z]+)$', '\\1 newly \\2') ELSE text END"
SIDES_SQL = f"""WITH r AS (SELECT *, cast(split_part(section, '#', 2) AS bigint) AS n FROM ({X.REQUIREMENTS_SQL})),
b0 AS (SELECT id, level, text, section, ordinal FROM r WHERE n % 10 <> 1), a0 AS (SELECT left(sha256(s || '|' || lower(t)), 12) AS id, CASE WHEN n % 6 = 0 AND level = 'with' THEN 'that' ELSE level END AS level, t AS text, s AS section, ordinal
  FROM (SELECT *, {_AFTER} AS t, CASE WHEN n % 7 = 3 THEN path || '#' || (n - 3) ELSE section END AS s FROM r WHERE n % 10 <> 2)),
b1 AS (SELECT id, max_by(text, ordinal) AS text, any_value(section) AS section FROM b0 GROUP BY id), a1 AS (SELECT id, max_by(text, ordinal) AS text, any_value(section) AS section FROM a0 GROUP BY id),
gone AS (SELECT * FROM b1 WHERE id NOT IN (SELECT id FROM a1)), fresh AS (SELECT * FROM a1 WHERE id NOT IN (SELECT id FROM b1))
"""


def requirement_sets(spark, sf):
    removed, added = prose.requirement_sets(*_sides(spark, sf))
    return removed.select(F.lit("removed").alias("side"), "id", "section").unionByName(added.select(F.lit("added").alias("side"), "id", "section"))


def similarity_pairs(spark, sf):
    removed, added = prose.requirement_sets(*_sides(spark, sf))
    return matching.candidates(removed, added, "section", 0.6).select("section", "gone", "fresh", F.round("score", 4).alias("score"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 3))"
PAIRS_SQL = f"""{SIDES_SQL}, g AS (SELECT id, section, {_WORDS} AS w FROM gone), f AS (SELECT id, section, {_WORDS} AS w FROM fresh)
SELECT * FROM (SELECT section, g.id AS gone, f.id AS fresh, round(len(list_intersect(g.w, f.w))::double / least(len(g.w), len(f.w)), 4) AS score, len(list_intersect(g.w, f.w))::double / least(len(g.w), len(f.w)) AS exact FROM g JOIN f USING (section)) WHERE exact > 0.6"""


def _greedy_sql(name: str, block: str, threshold: float, gone: str, fresh: str) -> str:
    """CTEs that settle the pairs of two tables, one removed sentence of every block a step."""
    return f"""{name}_p AS (SELECT {block} AS block, g.id AS gone, f.id AS fresh, len(list_intersect(g.w, f.w))::double / least(len(g.w), len(f.w)) AS score, f.ordinal AS fresh_at, g.ordinal AS gone_at FROM {gone} g JOIN {fresh} f USING ({block}) WHERE len(list_intersect(g.w, f.w))::double / least(len(g.w), len(f.w)) > {threshold}),
{name}_k AS (SELECT *, dense_rank() OVER (PARTITION BY block ORDER BY gone_at, gone) AS k FROM {name}_p),
{name}_s AS (SELECT block, 0 AS k, NULL::varchar AS gone, NULL::varchar AS fresh, []::varchar[] AS taken FROM (SELECT DISTINCT block FROM {name}_k)
  UNION ALL SELECT s.block, s.k + 1, p.gone, p.fresh, CASE WHEN p.fresh IS NULL THEN s.taken ELSE list_append(s.taken, p.fresh) END FROM {name}_s s
    JOIN (SELECT block, max(k) AS last FROM {name}_k GROUP BY block) m ON m.block = s.block AND s.k < m.last
    LEFT JOIN LATERAL (SELECT gone, fresh FROM {name}_k x WHERE x.block = s.block AND x.k = s.k + 1 AND NOT list_contains(s.taken, x.fresh) ORDER BY score DESC, fresh_at, fresh LIMIT 1) p ON true),
{name} AS (SELECT gone, fresh FROM {name}_s WHERE fresh IS NOT NULL)"""


_SAID = "{0}.level || ' {1}: ' || CASE WHEN length({0}.text) <= {2} THEN {0}.text ELSE left({0}.text, {2} - 1) || '...' END"
_PROMISED = _PROMISE.format("status")
REQUIREMENTS_SQL = f"""WITH RECURSIVE {SIDES_SQL.removeprefix('WITH ')},
b2 AS (SELECT id, max_by(struct_pack(level := level, text := text, section := section), ordinal) AS r, min(ordinal) AS ordinal FROM b0 GROUP BY id), a2 AS (SELECT id, max_by(struct_pack(level := level, text := text, section := section), ordinal) AS r, min(ordinal) AS ordinal FROM a0 GROUP BY id),
lost AS (SELECT id, r.level AS level, r.text AS text, r.section AS section, split_part(r.section, '#', 1) AS document, ordinal, {_WORDS.replace('text', 'r.text')} AS w FROM b2 WHERE id NOT IN (SELECT id FROM a2)),
new AS (SELECT id, r.level AS level, r.text AS text, r.section AS section, split_part(r.section, '#', 1) AS document, ordinal, {_WORDS.replace('text', 'r.text')} AS w FROM a2 WHERE id NOT IN (SELECT id FROM b2)),
{_greedy_sql('same', 'section', 0.6, 'lost', 'new')},
lost2 AS (SELECT * FROM lost WHERE id NOT IN (SELECT gone FROM same)), new2 AS (SELECT * FROM new WHERE id NOT IN (SELECT fresh FROM same)),
{_greedy_sql('moved', 'document', 0.85, 'lost2', 'new2')},
pairs AS (SELECT gone, fresh, false AS moved FROM same UNION ALL SELECT gone, fresh, true FROM moved),
j AS (SELECT b, a, moved FROM lost b LEFT JOIN pairs ON b.id = gone FULL OUTER JOIN new a ON a.id = fresh),
st AS (SELECT coalesce(y.id, x.id) AS id, coalesce(y.status, x.status) AS status FROM ({_sections_sql(1)}) x FULL OUTER JOIN ({_sections_sql(2)}) y ON x.id = y.id),
q AS (SELECT j.*, coalesce(a.section, b.section) AS section, coalesce(st.status, 'Unspecified') AS status FROM j LEFT JOIN st ON st.id = coalesce(a.section, b.section)),
v AS (SELECT *, CASE WHEN {_PROMISED} THEN 'breaking' ELSE 'notable' END AS hard FROM q)
SELECT 'requirement-level-changed' AS kind, hard AS severity, section AS id, status AS stability, b.level || ' relaxed to ' || {_SAID.format('a', '', 200).replace("' : '", "': '")} AS detail, b.level AS from_value, a.level AS to_value FROM v WHERE a.id IS NOT NULL AND b.id IS NOT NULL AND NOT moved AND a.level <> b.level
UNION ALL SELECT 'requirement-reworded', 'informational', section, status, {_SAID.format('a', 'reworded', 200)}, NULL, NULL FROM v WHERE a.id IS NOT NULL AND b.id IS NOT NULL AND NOT moved AND a.level = b.level
UNION ALL SELECT 'requirement-moved', 'informational', section, status, a.level || ' moved here from "' || split_part(b.section, '#', 2) || '": ' || CASE WHEN length(a.text) <= 200 THEN a.text ELSE left(a.text, 199) || '...' END, b.section, a.section FROM v WHERE a.id IS NOT NULL AND b.id IS NOT NULL AND moved
UNION ALL SELECT 'requirement-removed', 'informational', section, status, {_SAID.format('b', 'removed', 220)}, NULL, NULL FROM v WHERE a.id IS NULL
UNION ALL SELECT 'requirement-added', CASE WHEN {_PROMISED} THEN 'notable' ELSE 'informational' END, section, status, {_SAID.format('a', 'added', 220)}, NULL, NULL FROM v WHERE b.id IS NULL"""


def requirement_changes(spark, sf):
    before, after = _sides(spark, sf)
    return prose.requirement_changes(before, after, _sections(spark, sf, 1), _sections(spark, sf, 2)).select("kind", "severity", "id", "stability", "detail", "from_value", "to_value")


QUERIES = {
    "registry_diff": registry_diff,
    "registry_diff_tally": registry_tally,
    "changes_by_kind": changes_by_kind,
    "stability_promotions": promotions,
    "enum_members_changed": enum_members_changed,
    "metric_shape_changes": metric_shapes,
    "usage_level_changes": usage_levels,
    "usage_gained_lost": usage_gained_lost,
    "wire_message_changes": wire_messages,
    "wire_field_changes": wire_fields,
    "wire_field_renames": wire_renames,
    "wire_enum_renumbered": wire_values,
    "document_status_changes": document_changes,
    "section_rewritten": section_changes,
    "requirement_extract": requirement_extract,
    "requirement_sets_added_removed": requirement_sets,
    "requirement_similarity_pairs": similarity_pairs,
    "requirement_changes": requirement_changes,
}
_REG = REGISTRY_SQL
ORACLES = {
    "registry_diff": f"{_REG} SELECT * FROM changes",
    "registry_diff_tally": f"{_REG} SELECT " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("breaking", "notable", "informational")) + " FROM changes",
    "changes_by_kind": f"{_REG} SELECT kind, count(*) AS n FROM changes GROUP BY kind",
    "stability_promotions": f"{_REG} SELECT id, from_value, to_value FROM changes WHERE entity = 'attribute' AND kind = 'stability-changed' AND detail LIKE 'Promoted%'",
    "enum_members_changed": f"{_REG} SELECT id, severity, detail FROM changes WHERE kind = 'enum-members-changed'",
    "metric_shape_changes": f"{_REG} SELECT id, kind, severity, from_value, to_value FROM changes WHERE kind IN ('unit-changed', 'instrument-changed')",
    "usage_level_changes": f"{USAGE_SQL} SELECT id, CASE WHEN stable AND up THEN 'notable' ELSE 'informational' END AS severity, 'On ' || {_NAMES} || ': ' || was || ' to ' || now || '.' AS detail, old AS from_value, new AS to_value FROM g JOIN r USING (id) WHERE what = 'moved'",
    "usage_gained_lost": f"{USAGE_SQL} SELECT id, CASE WHEN what = 'gained' AND stable AND must THEN 'notable' ELSE 'informational' END AS severity, CASE WHEN what = 'gained' THEN 'Now referenced by ' || {_NAMES} || ' (' || now || ').' ELSE 'No longer referenced by ' || {_NAMES} || '.' END AS detail FROM g JOIN r USING (id) WHERE what IN ('gained', 'lost')",
    "wire_message_changes": WIRE_MESSAGES_SQL,
    "wire_field_changes": WIRE_FIELDS_SQL,
    "wire_field_renames": f"SELECT id, severity, renamed_to FROM ({WIRE_FIELDS_SQL}) WHERE kind = 'field-renamed'",
    "wire_enum_renumbered": WIRE_VALUES_SQL,
    "document_status_changes": DOCUMENTS_SQL,
    "section_rewritten": SECTIONS_SQL,
    "requirement_extract": f"SELECT id, level, section, ordinal, length(text) AS chars FROM ({X.REQUIREMENTS_SQL})",
    "requirement_sets_added_removed": f"{SIDES_SQL} SELECT 'removed' AS side, id, section FROM gone UNION ALL SELECT 'added', id, section FROM fresh",
    "requirement_changes": REQUIREMENTS_SQL,
    "requirement_similarity_pairs": f"SELECT section, gone, fresh, score FROM ({PAIRS_SQL})",
}
