"""Queries over the catalogue: versions, feed, lifecycles, names, topics, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import text as TX
from ledgerline.operators import catalog, closure, counts, lookup, registry, search, topics
from ledgerline.plans import fixtures as X

# versions


def _days(spark, sf):
    """Versions: the days of each kind of event."""
    return X.read(spark, sf, "events").selectExpr("event_type AS source", "date_format(ts, 'yyyy-MM-dd') AS version").distinct()


_DAYS = "SELECT DISTINCT event_type AS source, strftime(ts, '%Y-%m-%d') AS version FROM events"


def version_pairs(spark, sf):
    return catalog.version_pairs(_days(spark, sf))


def consecutive_pairs(spark, sf):
    return catalog.consecutive_pairs(_days(spark, sf))


def neighbours(spark, sf):
    return catalog.neighbours(_days(spark, sf))


def pending(spark, sf):
    return catalog.pending(_days(spark, sf), _days(spark, sf).where("day(to_date(version)) % 3 = 0"), "2024-01-10")


def _releases(spark, sf):
    """Releases, some of which have no date."""
    rows = X.events(spark, sf).groupBy("source", "version").agg(F.min("published_at").alias("published_at"))
    return rows.withColumn("published_at", F.expr("CASE WHEN version NOT LIKE '1.7.%' THEN published_at END"))


def _feed(spark, sf):
    return catalog.feed(X.events(spark, sf), _releases(spark, sf))


def release_feed(spark, sf):
    return catalog.visible(_feed(spark, sf), ["view"])


def release_activity(spark, sf):
    return catalog.activity(_feed(spark, sf)).select("source", "version", "total", F.round("height", 4).alias("height"), F.round("place", 4).alias("place"))


_FEED = f"""WITH e AS ({X.EVENTS_SQL}), r AS (SELECT source, version, min(published_at) AS published_at FROM e WHERE version NOT LIKE '1.7.%' GROUP BY ALL),
feed AS (SELECT source, version, coalesce(any_value(r.published_at), '') AS published_at, count(*) FILTER (severity = 'breaking') AS breaking, count(*) FILTER (severity = 'notable') AS notable, count(*) FILTER (severity = 'informational') AS informational
  FROM e LEFT JOIN r USING (source, version) GROUP BY source, version)
"""
_ACTIVITY = f"""{_FEED}, s AS (SELECT source, version, breaking + notable + informational AS total, epoch(cast(published_at AS timestamp)) AS t FROM feed WHERE published_at <> '')
SELECT source, version, total, round(sqrt(total::double / max(total) OVER ()), 4) AS height, round((t - min(t) OVER ()) / (max(t) OVER () - min(t) OVER ()), 4) AS place FROM s"""


def last_incompatible(spark, sf):
    return catalog.last_incompatible(X.events(spark, sf))


def wire_history(spark, sf):
    return catalog.wire_history(X.events(spark, sf))


def recent(spark, sf):
    rows = catalog.recent(X.events(spark, sf), 6, ["source"], [F.desc("published_at"), F.desc("event_id")])
    return rows.select("source", "event_id", F.col("place").cast("long").alias("place"))


def resume_gate(spark, sf):
    rows = X.read(spark, sf, "events").selectExpr("event_type AS source", "event_id AS position", "CAST(floor(value / 40) AS long) AS a", "user_id % 2 AS b")
    return catalog.resume_gate(rows.withColumn("hash", catalog.canonical_hash(rows, ["a", "b"]))).select("source", "position")


_GATE = """SELECT source, position FROM (SELECT *, lag(a) OVER w AS a0, lag(b) OVER w AS b0 FROM (SELECT event_type AS source, event_id AS position, floor(value / 40)::bigint AS a, user_id % 2 AS b FROM events)
WINDOW w AS (PARTITION BY source ORDER BY position)) WHERE a0 IS NULL OR a <> a0 OR b <> b0"""


_SUFFIX = "CASE position % 40 WHEN 0 THEN '' WHEN 1 THEN '.2' WHEN 2 THEN '.4' WHEN 3 THEN '.5' END"  # taken versions have gaps


def day_versions(spark, sf):
    rows = X.read(spark, sf, "events").selectExpr("event_type AS source", "event_id AS position", "date_format(ts, 'yyyy-MM-dd') AS day")
    taken = rows.where("position % 40 <= 3").selectExpr("source", f"concat(day, {_SUFFIX}) AS version").distinct()
    return catalog.day_versions(rows.where("position % 40 > 3"), taken).select("source", "position", "version")


_DAY_VERSIONS = f"""WITH e AS (SELECT event_type AS source, event_id AS position, strftime(ts, '%Y-%m-%d') AS day FROM events), t AS (SELECT DISTINCT source, concat(day, {_SUFFIX}) AS version FROM e WHERE position % 40 <= 3),
c AS (SELECT source, day, position, row_number() OVER (PARTITION BY source, day ORDER BY position) AS turn FROM e WHERE position % 40 > 3),
s AS (SELECT source, day, unnest(range(1, n + 5)) AS slot FROM (SELECT source, day, count(*) AS n FROM c GROUP BY ALL)),
v AS (SELECT source, day, slot, CASE WHEN slot = 1 THEN day ELSE day || '.' || slot END AS version FROM s),
f AS (SELECT source, day, version, row_number() OVER (PARTITION BY source, day ORDER BY slot) AS turn FROM v WHERE (source, version) NOT IN (SELECT (source, version) FROM t))
SELECT source, position, version FROM c JOIN f USING (source, day, turn)"""


def resumed(spark, sf):
    rows = X.events(spark, sf).selectExpr("source", "ordinal AS position", "tag", "published_at")
    kept = rows.where("position % 97 = 5").groupBy("source").agg(F.max("position").alias("position"))
    kept = kept.join(rows, ["source", "position"]).select("source", F.when(F.col("source") == "view", "lost").otherwise(F.col("tag")).alias("tag"), "published_at")
    return catalog.resumed(rows, kept).select("source", "position")


_RESUMED = f"""WITH e AS ({X.EVENTS_SQL}), k AS (SELECT source, max(ordinal) AS at, max_by(published_at, ordinal) AS pub FROM e WHERE ordinal % 97 = 5 GROUP BY source)
SELECT e.source, e.ordinal AS position FROM e LEFT JOIN k USING (source) WHERE CASE WHEN k.at IS NULL THEN true WHEN e.source = 'view' THEN e.published_at > k.pub ELSE e.ordinal > k.at END"""


def upserted(spark, sf):
    rows = X.events(spark, sf).selectExpr("source", "tag", "version", "published_at", "event_id")
    old = rows.where("event_id % 2 = 0").drop("event_id")
    new = rows.where("event_id % 3 = 0").withColumn("version", F.concat("version", F.lit("-new"))).drop("event_id")
    return catalog.upserted(old, new, ["click"])


_UPSERTED = f"""WITH e AS ({X.EVENTS_SQL}) SELECT source, tag, CASE WHEN event_id % 3 = 0 THEN version || '-new' ELSE version END AS version, published_at FROM e
WHERE event_id % 3 = 0 OR (event_id % 2 = 0 AND source <> 'click')"""


def lifecycle(spark, sf):
    seeds = X.read(spark, sf, "events").selectExpr("concat('u', cast(user_id AS string)) AS id").distinct().selectExpr("id", "'0.1.0' AS version", "'2023-12-31' AS published_at", "'stable' AS stability")
    rows = X.events(spark, sf).selectExpr("concat('u', cast(user_id AS string)) AS id", "CASE source WHEN 'view' THEN 'note-changed' WHEN 'click' THEN 'added' ELSE source END AS kind", "severity AS stability", "tag AS detail", "severity", "version", "published_at", "ordinal")
    return catalog.lifecycle(seeds, rows).select("id", "version", "kind", "detail", F.col("n").cast("long").alias("n"))


_KEY = X.KEY_SQL.format("version")
_LIFECYCLE = f"""WITH e AS ({X.EVENTS_SQL}), rows_ AS (
SELECT DISTINCT 'u' || user_id AS id, '0.1.0' AS version, 'first-seen' AS kind, 'Already present at v0.1.0, the oldest release tracked here (stable).' AS detail, -1 AS ordinal FROM e
UNION ALL SELECT 'u' || user_id, version, CASE WHEN source = 'click' THEN 'first-seen' ELSE source END, CASE WHEN source = 'click' THEN 'Added as ' || severity || '.' ELSE tag END, ordinal FROM e WHERE source <> 'view')
SELECT id, version, kind, detail, row_number() OVER (PARTITION BY id ORDER BY {_KEY}, ordinal, kind) AS n FROM rows_"""


def rename_map(spark, sf):
    return catalog.renames(X.registry(spark, sf, 2))


def rename_since(spark, sf):
    history = X.registry(spark, sf, 2).where("reason IS NOT NULL AND ordinal % 2 = 0").selectExpr("id", "'1.' || cast(ordinal % 5 AS string) AS version", "reason AS kind", "ordinal AS n")
    history = history.unionByName(history.withColumn("n", F.col("n") + 1).withColumn("version", F.lit("9.9")))
    return catalog.rename_since(rename_map(spark, sf), history)


_RENAMES = f"SELECT id AS from_id, renamed_to AS to_id FROM ({X.registry_sql(2)}) WHERE renamed_to IS NOT NULL"
_SINCE = f"SELECT id AS from_id, renamed_to AS to_id, CASE WHEN ordinal % 2 = 0 THEN '1.' || (ordinal % 5) END AS since FROM ({X.registry_sql(2)}) WHERE renamed_to IS NOT NULL"


def predecessors(spark, sf):
    pairs = rename_map(spark, sf).selectExpr("from_id", "split_part(to_id, '.', 2) AS to_id")
    return catalog.predecessors(pairs).select("id", F.array_join("replaces", ",").alias("replaces"))


_PREDECESSORS = f"SELECT split_part(to_id, '.', 2) AS id, string_agg(DISTINCT from_id, ',' ORDER BY from_id) AS replaces FROM ({_RENAMES}) GROUP BY ALL"

# names


def _two_registries(spark, sf):
    old = X.registry(spark, sf, 2)
    new = X.registry(spark, sf, 3).where("ordinal % 4 = 0").withColumn("reason", F.when(F.col("ordinal") % 8 == 0, F.col("reason"))).withColumn("renamed_to", F.when(F.col("ordinal") % 8 == 0, F.col("renamed_to")))
    return old, new


_NEW = f"SELECT * REPLACE (CASE WHEN ordinal % 8 = 0 THEN reason END AS reason, CASE WHEN ordinal % 8 = 0 THEN renamed_to END AS renamed_to) FROM ({X.registry_sql(3)}) WHERE ordinal % 4 = 0"
_BOTH = f"SELECT *, 'old' AS registry, ordinal * 2 AS o FROM ({X.registry_sql(2)}) UNION ALL SELECT *, 'new' AS registry, ordinal * 2 + 1 AS o FROM ({_NEW})"


def _names(spark, sf):
    ids = X.registry(spark, sf, 1).select(F.explode(F.array(F.col("id"), F.concat("id", F.lit(".key.x")), F.concat(F.lit("my."), "id"))).alias("name"))
    return ids


def _registry_rows(spark, sf):
    old, new = _two_registries(spark, sf)
    return old.withColumn("registry", F.lit("old")).withColumn("ordinal", F.col("ordinal") * 2).unionByName(new.withColumn("registry", F.lit("new")).withColumn("ordinal", F.col("ordinal") * 2 + 1))


def name_verdicts(spark, sf):
    return lookup.verdicts(_names(spark, sf), _registry_rows(spark, sf))


def names_attention(spark, sf):
    return lookup.attention(name_verdicts(spark, sf))


def template_prefix(spark, sf):
    return lookup.templates(_names(spark, sf), _registry_rows(spark, sf))


_NAME_ROWS = f"n AS (SELECT unnest([id, id || '.key.x', 'my.' || id]) AS name FROM ({X.registry_sql(1)})), reg AS ({_BOTH})"
_VERDICTS = f"""WITH {_NAME_ROWS}, d AS (SELECT id, min_by(struct_pack(reason := reason, renamed_to := renamed_to, registry := registry), (CASE WHEN reason IS NULL THEN 0 ELSE 1 END, o)) AS d, bool_or(reason IS NOT NULL) AS any_gone FROM reg GROUP BY id),
t AS (SELECT DISTINCT name FROM n JOIN reg ON reg.type LIKE 'template[%' AND starts_with(n.name, reg.id || '.')),
v AS (SELECT n.name, d.d AS d, CASE WHEN d.id IS NULL THEN CASE WHEN t.name IS NULL THEN 'unknown' ELSE 'ok' END WHEN d.d.renamed_to IS NOT NULL THEN 'renamed' WHEN d.d.reason IS NOT NULL THEN 'deprecated' WHEN any_gone THEN 'moved' ELSE 'ok' END AS verdict
  FROM n LEFT JOIN d ON d.id = n.name LEFT JOIN t ON t.name = n.name)
"""
_TEMPLATES = f"WITH {_NAME_ROWS} SELECT n.name, min_by(reg.id, reg.o) AS template FROM n JOIN reg ON reg.type LIKE 'template[%' AND starts_with(n.name, reg.id || '.') GROUP BY n.name"


def merged(spark, sf):
    old, new = _two_registries(spark, sf)
    return topics.merged_registries(old, new).select("id", "registry", "reason")


_MERGED = f"WITH o AS ({X.registry_sql(2)}), w AS ({_NEW}) SELECT id, 'old' AS registry, reason FROM o WHERE id NOT IN (SELECT id FROM w WHERE reason IS NULL) UNION ALL SELECT id, 'new', reason FROM w"


def attribute_page(spark, sf):
    rows = lookup.matching_attributes(X.registry(spark, sf, 2), "REVISED", deprecated_only=True)
    return lookup.page(rows, 100, lookup.ATTRIBUTES_PAGE).select("id", "brief", "ordinal")


def requirement_page(spark, sf):
    rows = lookup.matching_requirements(X.requirements(spark, sf), "ER", section="SRC1").where("level = 'that'")
    return lookup.page(rows.withColumn("ordinal", F.struct("section", "ordinal", "id")), None, lookup.REQUIREMENTS_PAGE).select("id", "section", "level")


def message_lookup(spark, sf):
    found = X.messages(spark, sf, 2)
    wanted = found.select(F.split_part("name", F.lit("."), F.lit(-1)).alias("wanted")).unionByName(found.select(F.col("name").alias("wanted"))).unionByName(found.select(F.concat(F.lit("no"), "name").alias("wanted")))
    return lookup.messages_named(wanted, found)


_MESSAGES = f"""WITH m AS ({X.messages_sql(2)}), w AS (SELECT split_part(name, '.', -1) AS wanted FROM m UNION SELECT name FROM m UNION SELECT 'no' || name FROM m),
p AS (SELECT name, ordinal, string_split(name, '.') AS parts FROM m), k AS (SELECT name, ordinal, array_to_string(parts[i:], '.') AS wanted FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM p))
SELECT wanted, min_by(name, (CASE WHEN name = wanted THEN 0 ELSE 1 END, ordinal)) AS name FROM w JOIN k USING (wanted) GROUP BY wanted"""

# usage and inheritance


def effective_usage(spark, sf):
    return registry.effective_usage(X.usage(spark, sf, 1))


_EFFECTIVE = f"SELECT id, signal, max_by(level, (ordinal, level)) AS level, min(ordinal) AS ordinal FROM ({X.usage_sql(1)}) GROUP BY id, signal"


def strongest(spark, sf):
    return registry.strongest_levels(X.usage(spark, sf, 1))


_STRONGEST = f"SELECT group_id, id, CASE max(CASE level WHEN 'opt_in' THEN 0 WHEN 'recommended' THEN 1 WHEN 'conditionally_required' THEN 2 ELSE 3 END) WHEN 0 THEN 'opt_in' WHEN 1 THEN 'recommended' WHEN 2 THEN 'conditionally_required' ELSE 'required' END AS level FROM ({X.usage_sql(1)}) GROUP BY ALL"


def parent_closure(spark, sf):
    """Groups k inherit from k div 2 and, for one in five, k div 3."""
    parts = X.read(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    ids = parts.select(F.col("k").cast("string").alias("id"))
    edges = parts.select(F.col("k").cast("string").alias("child"), F.posexplode(F.when(F.col("k") % 5 == 0, F.expr("array(k div 2, k div 3)")).otherwise(F.expr("array(k div 2)"))).alias("i", "parent"))
    edges = edges.select("child", F.col("parent").cast("string").alias("parent"), F.col("i").alias("k")).join(ids.select(F.col("id").alias("parent")), "parent")
    return closure.inherited(ids, edges).select("root", "node", F.array_join(F.transform("place", lambda x: x.cast("string")), ",").alias("place"))


_CLOSURE = """WITH RECURSIVE p AS (SELECT p_partkey AS k FROM part), e AS (SELECT k AS child, unnest(CASE WHEN k % 5 = 0 THEN [k // 2, k // 3] ELSE [k // 2] END) AS parent, unnest(CASE WHEN k % 5 = 0 THEN [0, 1] ELSE [0] END) AS i FROM p),
w AS (SELECT k AS root, k AS node, []::INT[] AS way FROM p UNION ALL SELECT w.root, e.parent, list_append(w.way, e.i) FROM w JOIN e ON e.child = w.node AND e.parent <> e.child JOIN p ON p.k = e.parent)
SELECT root::varchar AS root, node::varchar AS node, array_to_string(list_append(min(way), 2147483647), ',') AS place FROM w GROUP BY root, node"""

# topics


def _topics(spark, sf):
    return X.read(spark, sf, "part").selectExpr("lower(p_type) AS namespace").distinct().selectExpr("namespace", "CASE WHEN length(namespace) % 2 = 0 THEN 'even' ELSE 'odd' END AS slug").where("namespace <> 'economy'")


_TOPICS = "SELECT DISTINCT lower(p_type) AS namespace, CASE WHEN length(p_type) % 2 = 0 THEN 'even' ELSE 'odd' END AS slug FROM part WHERE lower(p_type) <> 'economy'"


def _signals(spark, sf):
    return X.registry(spark, sf, 2).withColumn("kind", F.element_at(F.array(*map(F.lit, ["metric", "span", "event", "entity"])), (F.col("ordinal") % 4 + 1).cast("int"))).withColumn("id", F.when(F.col("kind") == "metric", F.col("id")).otherwise(F.concat("kind", F.lit("."), "id")))


_SIGNALS = f"SELECT *, CASE ordinal % 4 WHEN 0 THEN 'metric' WHEN 1 THEN 'span' WHEN 2 THEN 'event' ELSE 'entity' END AS kind FROM ({X.registry_sql(2)})"


def topic_rollup(spark, sf):
    return topics.rollup(X.registry(spark, sf, 2), _signals(spark, sf), _topics(spark, sf))


_ROLLUP = f"""WITH t AS ({_TOPICS}), a AS (SELECT slug, count(*) AS attributes, count(*) FILTER (stability = 'stable' AND reason IS NULL) AS stable, count(*) FILTER (reason IS NOT NULL) AS deprecated FROM ({X.registry_sql(2)}) JOIN t USING (namespace) GROUP BY slug),
s AS (SELECT slug, count(*) FILTER (kind = 'metric') AS metrics, count(*) FILTER (kind = 'span') AS spans, count(*) FILTER (kind = 'event') AS events, count(*) FILTER (kind = 'entity') AS entities FROM ({_SIGNALS}) JOIN t USING (namespace) GROUP BY slug)
SELECT * FROM a JOIN s USING (slug)"""


def namespace_counts(spark, sf):
    return topics.namespace_counts(X.registry(spark, sf, 2))


def _strict(spark, sf):
    """Requirements with levels of the usual kind in place of the lexicon."""
    level = F.when(F.col("level") == "of the", "MUST").when(F.col("level") == "with", "SHOULD").otherwise("MAY")
    return X.requirements(spark, sf).withColumn("level", level)


def governance(spark, sf):
    totals = topics.area_totals(_strict(spark, sf), F.substring("path", 1, 4))
    kinds = topics.with_topic(_signals(spark, sf), _topics(spark, sf), TX.signal_key(F.col("id"))).groupBy("slug", "kind").agg(F.count("*").alias("n"))
    areas = kinds.select("kind").distinct().withColumn("area", F.concat(F.lit("src"), (F.length("kind") % 10).cast("string")))
    return topics.governance(kinds, areas, totals)


_R = f"r AS (SELECT *, CASE WHEN level = 'of the' THEN 1 ELSE 0 END AS must FROM ({X.REQUIREMENTS_SQL}))"
_GOVERNANCE = f"""WITH {_R}, tot AS (SELECT left(path, 4) AS area, count(*) AS requirements, sum(must)::bigint AS binding, count(DISTINCT path) AS documents FROM r GROUP BY ALL),
k AS (SELECT slug, kind, count(*) AS n FROM ({_SIGNALS}) JOIN ({_TOPICS}) USING (namespace) GROUP BY ALL)
SELECT slug, kind, area, requirements, documents, binding FROM k JOIN tot ON tot.area = 'src' || (length(kind) % 10)"""


def document_counts(spark, sf):
    return topics.document_counts(_strict(spark, sf))


_DOCUMENTS = f"WITH {_R} SELECT path, count(DISTINCT section) AS sections, count(*) AS requirements, sum(must)::bigint AS binding FROM r GROUP BY path"


def topic_requirements(spark, sf):
    rows = _strict(spark, sf).withColumn("title", F.col("section")).withColumn("status", F.lit("Stable"))
    return topics.topic_requirements(rows, ["ther", "on", "a+b"], excluded="^src(1|7)\\.", own="src2.md").select("id", "section", "level")


_TOPIC_REQUIREMENTS = f"WITH {_R} SELECT id, section, CASE level WHEN 'of the' THEN 'MUST' WHEN 'with' THEN 'SHOULD' ELSE 'MAY' END AS level FROM r WHERE NOT regexp_matches(path, '^src(1|7)\\.') AND (regexp_matches(text, '(?i)\\b(ther|on|a\\+b)\\b') OR starts_with(path, 'src2.md'))"


def signal_attributes(spark, sf):
    edges = X.usage(spark, sf, 1).withColumn("group_id", F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("span."), "group_id")).otherwise(F.col("group_id")))
    rows = edges.select(F.col("signal").alias("id"), F.col("id").alias("attribute")).groupBy("id").agg(F.array_distinct(F.collect_list("attribute")).alias("attributes")).withColumn("kind", F.lit("span"))
    return topics.signal_attributes(rows, edges)


_SIGNAL_ATTRIBUTES = f"""WITH u AS ({X.usage_sql(1)}), e AS (SELECT * REPLACE (CASE WHEN ordinal % 2 = 0 THEN 'span.' || group_id ELSE group_id END AS group_id) FROM u),
l AS (SELECT group_id, id, max_by(level, CASE level WHEN 'opt_in' THEN 0 WHEN 'recommended' THEN 1 WHEN 'conditionally_required' THEN 2 ELSE 3 END) AS level FROM e GROUP BY ALL), s AS (SELECT DISTINCT signal AS id, id AS attribute FROM u),
g AS (SELECT s.id, s.attribute, CASE WHEN s.id IN (SELECT group_id FROM l) THEN s.id ELSE 'span.' || s.id END AS group_id FROM s)
SELECT g.id, 'span' AS kind, g.attribute, coalesce(l.level, 'recommended') AS level FROM g LEFT JOIN l ON l.group_id = g.group_id AND l.id = g.attribute"""


def anchors(spark, sf):
    """Repeated headings of a source: the pages' titles by host."""
    rows = X.read(spark, sf, "pages").selectExpr("page_id", "regexp_extract(url, '//([^/]*)', 1) AS path", "lower(regexp_extract(html, '<h1>([a-zA-Z]+)', 1)) AS base")
    from pyspark.sql import Window

    seen = F.row_number().over(Window.partitionBy("path", "base").orderBy("page_id")) - 1
    return rows.withColumn("seen", seen).select("page_id", F.when(F.col("seen") == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("seen").cast("string"))).alias("anchor"))


_ANCHORS = "SELECT page_id, CASE WHEN s = 0 THEN base ELSE base || '-' || s END AS anchor FROM (SELECT page_id, base, row_number() OVER (PARTITION BY path, base ORDER BY page_id) - 1 AS s FROM (SELECT page_id, regexp_extract(url, '//([^/]*)', 1) AS path, lower(regexp_extract(html, '<h1>([a-zA-Z]+)', 1)) AS base FROM pages))"

# search


def _index(spark, sf):
    attributes = search.attribute_entries(X.registry(spark, sf, 2).withColumn("brief", F.concat("brief", F.lit(" `code` and [label](http://x.y)"))))
    metrics = search.metric_entries(X.registry(spark, sf, 2).withColumn("id", F.concat(F.lit("metric."), "id")))
    nations = search.topic_entries(X.read(spark, sf, "nation").selectExpr("n_name AS title", "concat('Nation ', n_name) AS blurb", "lower(n_name) AS slug", "array(n_name) AS namespaces"))
    messages = search.message_entries(X.messages(spark, sf, 2))
    return search.index(attributes, metrics, nations, messages)


_META = "CASE WHEN reason IS NOT NULL THEN 'deprecated' ELSE stability END"
_INDEX = f"""idx AS (
SELECT 'attribute' AS type, id, brief || ' code and label' AS text, '/attributes/' || id AS url, concat_ws(' · ', {_META}, type, namespace) AS meta, renamed_to FROM ({X.registry_sql(2)})
UNION ALL SELECT 'metric', 'metric.' || id, brief, '/metrics', concat_ws(' · ', {_META}, instrument, unit), NULL FROM ({X.registry_sql(2)})
UNION ALL SELECT 'domain', n_name, 'Nation ' || n_name, '/topics/' || lower(n_name), n_name, NULL FROM nation
UNION ALL SELECT 'otlp', name, coalesce(comment, ''), '/messages', kind || ' · ' || replace(file, '.proto', ''), NULL FROM ({X.messages_sql(2)}))"""
#: Locale order of these ids: punctuation before digits before letters, underscores before dots, and case last.
_LOCALE = "lower(replace(replace(id, '_', ' '), '.', '!')), id"
_QUESTION = "Which standard int attribute was renamed, the stable red one?"
_WORDS = ["standard", "int", "renamed", "stable", "red", "one"]


def index_union(spark, sf):
    return _index(spark, sf).select("type", "id", "text", "url", "meta", "renamed_to")


def ranked(spark, sf):
    return search.question_scores(_index(spark, sf), _QUESTION).select("type", "id", "url", "score")


def top_hits(spark, sf):
    return search.retrieve(_index(spark, sf), _QUESTION, limit=20).select("type", "id", "url", "score")


def _hit(t: str) -> str:
    return f"CASE WHEN lower(id) = '{t}' THEN 8.0 WHEN list_contains(seg, '{t}') THEN 4.0 WHEN len(list_filter(seg, lambda s: starts_with(s, '{t}'))) > 0 THEN 3.0 WHEN contains(lower(id), '{t}') THEN 2.0 WHEN contains(lower(text), '{t}') THEN 1.5 WHEN contains(lower(meta), '{t}') THEN 0.5 ELSE 0.0 END"


_SCORES = f"""WITH {_INDEX}, g AS (SELECT *, regexp_split_to_array(lower(id), '[.\\-_\\s/#:]+') AS seg FROM idx), h AS (SELECT *, [{', '.join(map(_hit, _WORDS))}]::double[] AS hits FROM g),
scored AS (SELECT type, id, url, floor(list_sum(hits) * (1 + 0.35 * (len(list_filter(hits, lambda x: x > 0)) - 1))::double * 100 + 0.5) / 100 AS score FROM h WHERE list_sum(hits) > 0)
"""


def all_terms(spark, sf):
    return search.query_ranks(_index(spark, sf), "standard red").select("type", "id", "url", "rank")


def per_type(spark, sf):
    return search.per_type(_index(spark, sf), "metric: red s")


def palette(spark, sf):
    return search.palette(search.query_ranks(_index(spark, sf), "1")).select("type", "id", "rank")


def _rank(t: str) -> str:
    letters = ".*".join(t)
    fuzzy = f" WHEN regexp_matches(lower(id), '{letters}') THEN 6" if len(t) >= 4 else ""
    return f"CASE WHEN lower(id) = '{t}' THEN 0 WHEN starts_with(lower(id), '{t}') THEN 1 WHEN len(list_filter(seg, lambda s: starts_with(s, '{t}'))) > 0 THEN 2 WHEN contains(lower(id), '{t}') THEN 3 WHEN contains(lower(text), '{t}') THEN 4 WHEN contains(lower(concat_ws(' ', id, text, meta, coalesce(renamed_to, ''))), '{t}') THEN 5{fuzzy} END"


def _ranks_sql(*terms: str) -> str:
    seg = "list_filter(regexp_split_to_array(lower(id), '[.\\-_\\s/#:]+'), lambda s: s <> '')"
    return f"WITH {_INDEX}, g AS (SELECT *, {seg} AS seg FROM idx), h AS (SELECT type, id, url, meta, [{', '.join(map(_rank, terms))}] AS ranks FROM g), q AS (SELECT *, list_max(ranks) AS rank FROM h WHERE len(list_filter(ranks, lambda r: r IS NULL)) = 0)"


# counts


def registry_counts(spark, sf):
    old, new = _two_registries(spark, sf)
    return counts.registry_counts(topics.merged_registries(old, new))


def registry_filter(spark, sf):
    old, new = _two_registries(spark, sf)
    rows = topics.with_topic(topics.merged_registries(old, new), _topics(spark, sf))
    return counts.filtered_registry(rows, status="stable", slug="odd", text="E").select("id", "registry")


def namespace_rows(spark, sf):
    return counts.by_group(X.registry(spark, sf, 2), "namespace")


def cumulative_breaking(spark, sf):
    return counts.cumulative_breaking(X.events(spark, sf))


def source_cards(spark, sf):
    return counts.source_cards(_days(spark, sf), X.events(spark, sf))


def source_totals(spark, sf):
    return counts.source_totals(_strict(spark, sf).withColumn("source", F.substring("path", 1, 4)))


def rules_about(spark, sf):
    return counts.rules_about(_strict(spark, sf), "and").select("id", "section")


def shallow_renames(spark, sf):
    rows = X.registry(spark, sf, 2).withColumn("id", F.when(F.col("ordinal") % 3 == 0, F.concat("id", F.lit(".deep"))).otherwise(F.col("id")))
    return counts.shallow_renames(rows, "standard", 12)


def upgrade_span(spark, sf):
    return counts.upgrade_span(_days(spark, sf))


def confirmed_names(spark, sf):
    return counts.confirmed(X.registry(spark, sf, 1).select("id"), X.registry(spark, sf, 2))


QUERIES = {
    "registry_counts": registry_counts,
    "registry_filter": registry_filter,
    "namespace_rows": namespace_rows,
    "cumulative_breaking": cumulative_breaking,
    "source_cards": source_cards,
    "source_totals": source_totals,
    "rules_about": rules_about,
    "shallow_renames": shallow_renames,
    "upgrade_span": upgrade_span,
    "confirmed_names": confirmed_names,
    "version_pairs": version_pairs,
    "consecutive_pairs": consecutive_pairs,
    "version_neighbours": neighbours,
    "pending_versions": pending,
    "release_feed": release_feed,
    "release_activity": release_activity,
    "last_incompatible": last_incompatible,
    "wire_history": wire_history,
    "recent_changes": recent,
    "resume_unchanged_gate": resume_gate,
    "resume_position": resumed,
    "same_day_versions": day_versions,
    "release_index_upsert": upserted,
    "lifecycle": lifecycle,
    "rename_map": rename_map,
    "rename_since": rename_since,
    "predecessors": predecessors,
    "name_verdicts": name_verdicts,
    "names_attention": names_attention,
    "template_prefix": template_prefix,
    "cross_registry_merge": merged,
    "attribute_search_page": attribute_page,
    "requirement_search_page": requirement_page,
    "message_lookup": message_lookup,
    "effective_usage_last_wins": effective_usage,
    "strongest_level": strongest,
    "parent_closure": parent_closure,
    "topic_rollup": topic_rollup,
    "namespace_counts": namespace_counts,
    "governance_by_area": governance,
    "document_requirement_counts": document_counts,
    "topic_requirements": topic_requirements,
    "signal_attributes": signal_attributes,
    "anchor_suffixes": anchors,
    "search_index_union": index_union,
    "search_ranked": ranked,
    "search_top": top_hits,
    "search_all_terms": all_terms,
    "search_per_type_counts": per_type,
    "search_palette": palette,
}
_ALL = f"WITH o AS ({X.registry_sql(2)}), w AS ({_NEW}), m AS (SELECT *, 'old' AS registry FROM o WHERE id NOT IN (SELECT id FROM w WHERE reason IS NULL) UNION ALL SELECT *, 'new' FROM w)"
ORACLES = {
    "registry_counts": f'{_ALL} SELECT count(*) AS "all", count(*) FILTER (reason IS NULL AND stability = \'stable\') AS stable, count(*) FILTER (reason IS NOT NULL) AS deprecated, count(*) FILTER (registry = \'new\') AS new FROM m',
    "registry_filter": f"{_ALL} SELECT id, registry FROM m JOIN ({_TOPICS}) t USING (namespace) WHERE reason IS NULL AND stability = 'stable' AND slug = 'odd' AND contains(lower(id || ' ' || brief), 'e')",
    "namespace_rows": f"SELECT namespace, count(*) AS n, min(id) AS first, max(id) AS last FROM ({X.registry_sql(2)}) GROUP BY namespace",
    "cumulative_breaking": f"SELECT source, count(*) FILTER (severity = 'breaking') AS breaking FROM ({X.EVENTS_SQL}) GROUP BY source",
    "source_cards": f"SELECT source, versions, oldest, latest, breaking FROM (SELECT source, count(*) AS versions, min(version) AS oldest, max(version) AS latest FROM ({_DAYS}) GROUP BY source) JOIN (SELECT source, count(*) FILTER (severity = 'breaking') AS breaking FROM ({X.EVENTS_SQL}) GROUP BY source) USING (source)",
    "source_totals": f"WITH {_R} SELECT left(path, 4) AS source, count(*) AS requirements, sum(must)::bigint AS binding, count(DISTINCT path) AS documents FROM r GROUP BY ALL",
    "rules_about": f"WITH {_R} SELECT id, section FROM r WHERE must = 1 AND regexp_matches(text, '(?i)\\band\\b')",
    "shallow_renames": f"SELECT * FROM (SELECT CASE WHEN ordinal % 3 = 0 THEN id || '.deep' ELSE id END AS id, renamed_to, CASE WHEN ordinal % 3 = 0 THEN 4 ELSE 3 END AS depth FROM ({X.registry_sql(2)}) WHERE namespace = 'standard' AND renamed_to IS NOT NULL) ORDER BY depth, id LIMIT 12",
    "upgrade_span": f"SELECT source, min(version) AS from_version, max(version) AS to_version FROM ({_DAYS}) GROUP BY source HAVING min(version) <> max(version)",
    "confirmed_names": f"SELECT id FROM ({X.registry_sql(1)}) WHERE id IN (SELECT id FROM ({X.registry_sql(2)}))",
    "version_pairs": f"WITH d AS ({_DAYS}) SELECT a.source, a.version AS from_version, b.version AS to_version FROM d a JOIN d b ON a.source = b.source AND a.version < b.version",
    "consecutive_pairs": f"SELECT * FROM (SELECT source, lag(version) OVER (PARTITION BY source ORDER BY version) AS from_version, version AS to_version FROM ({_DAYS})) WHERE from_version IS NOT NULL",
    "version_neighbours": f"SELECT source, version, lag(version) OVER w AS previous, lead(version) OVER w AS next FROM ({_DAYS}) WINDOW w AS (PARTITION BY source ORDER BY version)",
    "pending_versions": f"SELECT * FROM ({_DAYS}) WHERE day(cast(version AS date)) % 3 <> 0 AND version >= '2024-01-10'",
    "release_feed": f"{_FEED} SELECT * FROM feed WHERE source <> 'view' OR breaking + notable > 0",
    "release_activity": _ACTIVITY,
    "last_incompatible": f"SELECT source, max_by(version, {_KEY}) AS version FROM ({X.EVENTS_SQL}) WHERE severity <> 'informational' GROUP BY source",
    "wire_history": f"SELECT source, version, count(*) FILTER (severity <> 'informational') AS incompatible, count(*) FILTER (severity = 'informational') AS compatible FROM ({X.EVENTS_SQL}) GROUP BY ALL",
    "recent_changes": f"SELECT source, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published_at DESC, event_id DESC) AS place FROM ({X.EVENTS_SQL})) WHERE place <= 6",
    "resume_unchanged_gate": _GATE,
    "resume_position": _RESUMED,
    "same_day_versions": _DAY_VERSIONS,
    "release_index_upsert": _UPSERTED,
    "lifecycle": _LIFECYCLE,
    "rename_map": _RENAMES,
    "rename_since": _SINCE,
    "predecessors": _PREDECESSORS,
    "name_verdicts": f"{_VERDICTS} SELECT name, verdict, CASE WHEN verdict = 'renamed' THEN d.renamed_to END AS replacement, d.registry AS registry FROM v",
    "names_attention": f"{_VERDICTS} SELECT count(*) AS checked, count(*) FILTER (verdict IN ('renamed', 'deprecated')) AS needs_attention, count(*) FILTER (verdict = 'unknown') AS not_in_registry FROM v",
    "template_prefix": _TEMPLATES,
    "cross_registry_merge": _MERGED,
    "attribute_search_page": f"SELECT id, brief, ordinal FROM ({X.registry_sql(2)}) WHERE reason IS NOT NULL AND contains(lower(id || ' ' || brief), 'revised') ORDER BY ordinal LIMIT 100",
    "requirement_search_page": f"SELECT id, section, level FROM ({X.REQUIREMENTS_SQL}) WHERE level = 'that' AND contains(lower(section), 'src1') AND contains(lower(text), 'er') ORDER BY section, ordinal, id LIMIT 40",
    "message_lookup": _MESSAGES,
    "effective_usage_last_wins": _EFFECTIVE,
    "strongest_level": _STRONGEST,
    "parent_closure": _CLOSURE,
    "topic_rollup": _ROLLUP,
    "namespace_counts": f"SELECT namespace, count(*) AS n FROM ({X.registry_sql(2)}) GROUP BY ALL",
    "governance_by_area": _GOVERNANCE,
    "document_requirement_counts": _DOCUMENTS,
    "topic_requirements": _TOPIC_REQUIREMENTS,
    "signal_attributes": _SIGNAL_ATTRIBUTES,
    "anchor_suffixes": _ANCHORS,
    "search_index_union": f"WITH {_INDEX} SELECT type, id, text, url, meta, renamed_to FROM idx",
    "search_ranked": f"{_SCORES} SELECT * FROM scored",
    "search_top": f"{_SCORES} SELECT * FROM scored ORDER BY score DESC, length(id), id, url LIMIT 20",
    "search_all_terms": f"{_ranks_sql('standard', 'red')} SELECT type, id, url, rank FROM q",
    "search_per_type_counts": f"{_ranks_sql('red', 's')} SELECT type, count(*) AS n FROM q GROUP BY type",
    "search_palette": f"{_ranks_sql('1')}, o AS (SELECT *, (rank, starts_with(meta, 'deprecated'), CASE type WHEN 'domain' THEN 0 WHEN 'attribute' THEN 1 WHEN 'metric' THEN 2 ELSE 6 END, length(id), {_LOCALE}, url) AS place FROM q), n AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY place) AS k FROM o) SELECT type, id, rank FROM n WHERE k <= 6 ORDER BY place LIMIT 28",
}
