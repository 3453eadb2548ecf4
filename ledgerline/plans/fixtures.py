"""Versioned tables derived from the sample tables by expressions that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.session import visible


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return visible(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _columns(exprs: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in exprs.items()]


def _derived(spark, sf_dir: str, made: tuple[str, dict[str, str], str]) -> DataFrame:
    name, exprs, where = made
    return read(spark, sf_dir, name).where(where).selectExpr(*_columns(exprs))


def _sql(made: tuple[str, dict[str, str], str]) -> str:
    name, exprs, where = made
    return f"SELECT {', '.join(_columns(exprs))} FROM {name} WHERE {where}"


def _registry(v: int) -> tuple[str, dict[str, str], str]:
    k = "p_partkey"
    stability = f"(p_size + CASE WHEN {k} % 9 = {v} THEN 1 ELSE 0 END) % 6"
    reason = f"CASE WHEN {k} % 13 < {v} THEN 'renamed' WHEN {k} % 13 = {12 if v >= 2 else 11} THEN 'obsoleted' END"
    return (
        "part",
        {
            "id": f"concat(lower(p_type), '.', replace(p_name, ' ', '_'), '.', cast({k} AS string))",
            "namespace": "lower(p_type)",
            "stability": f"CASE {stability} WHEN 0 THEN 'stable' WHEN 1 THEN 'release_candidate' WHEN 2 THEN 'development' WHEN 3 THEN 'alpha' WHEN 4 THEN 'experimental' ELSE 'deprecated' END",
            "type": f"CASE WHEN {k} % 17 = {v} THEN 'int' WHEN {k} % 43 = 5 THEN 'template[string]' ELSE 'string' END",
            "unit": f"CASE WHEN {k} % 19 = {v} THEN 'ms' ELSE 's' END",
            "instrument": f"CASE WHEN {k} % 23 = {v} THEN 'updowncounter' ELSE 'gauge' END",
            "brief": f"concat(p_name, CASE WHEN {k} % 8 = {v} THEN ' revised' ELSE '' END)",
            "note": f"CASE WHEN {k} % 6 = 0 THEN concat('note ', p_brand, CASE WHEN {k} % 30 = {6 * v} THEN ' v{v}' ELSE '' END) END",
            "reason": reason,
            "renamed_to": f"CASE WHEN {k} % 13 < {v} THEN concat('new.', lower(p_type), '.', cast({k} AS string)) END",
            "deprecation_note": "CAST(NULL AS string)",
            "ordinal": k,
        },
        f"({k} + {v}) % 29 <> 0",
    )


def registry(spark, sf_dir: str, v: int) -> DataFrame:
    return _derived(spark, sf_dir, _registry(v))


def registry_sql(v: int) -> str:
    return _sql(_registry(v))


def members(df: DataFrame, v: int) -> DataFrame:
    """Enum members and examples for a registry: the second member's value is by version for one in 31, the examples for one in 37."""
    k = F.col("ordinal")
    value = F.when(k % 31 == v, "x").otherwise("y")
    made = F.array(F.struct(F.lit("b").alias("id"), value.alias("value")), F.struct(F.lit("a").alias("id"), F.lit("1").alias("value")))
    return df.withColumn("enum_members", F.when(k % 3 == 0, made)).withColumn("examples", F.array(F.lit("e"), F.when(k % 37 == v, "f").otherwise("g")))


def _usage(v: int) -> tuple[str, dict[str, str], str]:
    level = f"(l_linenumber + CASE WHEN l_partkey % 7 = {v} THEN {v} ELSE 0 END) % 4"
    return (
        "lineitem",
        {
            "part": "l_partkey",
            "id": "concat('a', cast(l_partkey AS string))",
            "signal": "concat('s', cast(l_suppkey AS string))",
            "group_id": "concat('s', cast(l_suppkey AS string))",
            "level": f"CASE {level} WHEN 0 THEN 'opt_in' WHEN 1 THEN 'recommended' WHEN 2 THEN 'conditionally_required' ELSE 'required' END",
            "ordinal": "l_orderkey * 10 + l_linenumber",
        },
        f"(l_suppkey + {v}) % 11 <> 0",
    )


def usage(spark, sf_dir: str, v: int) -> DataFrame:
    return _derived(spark, sf_dir, _usage(v))


def usage_sql(v: int) -> str:
    return _sql(_usage(v))


def _message(v: int) -> tuple[str, dict[str, str], str]:
    o = "o_orderkey"
    return (
        "orders",
        {
            "name": f"concat(CASE WHEN {o} % 5 = 0 THEN 'wire.v1development.M' ELSE 'wire.v1.M' END, cast({o} AS string))",
            "kind": f"CASE WHEN {o} % 3 = 0 THEN 'enum' ELSE 'message' END",
            "file": f"concat('f', cast({o} % 7 AS string), '.proto')",
            "deprecated": f"{o} % 53 < {v}",
            "comment": f"CASE WHEN {o} % 2 = 0 THEN o_orderpriority END",
            "ordinal": o,
        },
        f"({o} + {v}) % 37 <> 0",
    )


def messages(spark, sf_dir: str, v: int) -> DataFrame:
    return _derived(spark, sf_dir, _message(v))


def messages_sql(v: int) -> str:
    return _sql(_message(v))


def _field(v: int) -> tuple[dict[str, str], str, str]:
    o, n = "l_orderkey", "l_linenumber"
    columns = {
        "message": f"concat(CASE WHEN {o} % 5 = 0 THEN 'wire.v1development.M' ELSE 'wire.v1.M' END, cast({o} AS string))",
        "name": f"concat('f', cast({n} AS string), CASE WHEN ({o} + {n}) % 13 = {v} THEN '_x' ELSE '' END)",
        "number": f"CAST({n} + CASE WHEN {o} % 17 = {v} THEN 10 ELSE 0 END AS int)",
        "type": f"CASE WHEN {o} % 19 = {v} THEN 'Z' ELSE max(l_returnflag) END",
        "label": f"CASE WHEN {o} % 23 = {v} THEN 'optional' WHEN max(l_linestatus) = 'O' THEN 'repeated' END",
        "deprecated": f"({o} + {n}) % 29 < {v}",
        "ordinal": n,
    }
    return columns, f"({o} + {n} + {v}) % 31 <> 0", f"{o}, {n}"


def fields(spark, sf_dir: str, v: int) -> DataFrame:
    columns, where, keys = _field(v)
    rows = read(spark, sf_dir, "lineitem").where(where).groupBy(*keys.split(", ")).agg(F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("line"))
    return rows.selectExpr(*[x.replace("max(l_returnflag)", "flag").replace("max(l_linestatus)", "line") for x in _columns(columns)])


def fields_sql(v: int) -> str:
    columns, where, keys = _field(v)
    return f"SELECT {', '.join(_columns(columns))} FROM lineitem WHERE {where} GROUP BY {keys}"


def values(spark, sf_dir: str, v: int) -> DataFrame:
    """Two enum values a message; some are renumbered or missing by version."""
    rows = messages(spark, sf_dir, v).where("kind = 'enum'").select(F.col("name").alias("message"), "ordinal", F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    rows = rows.where(f"NOT (ordinal % 47 = {v} AND n = 1)")
    return rows.selectExpr("message", "concat('V', cast(n AS string)) AS name", f"CAST(n + CASE WHEN ordinal % 41 = {v} AND n = 1 THEN 5 ELSE 0 END AS int) AS number")


def values_sql(v: int) -> str:
    inner = f"SELECT name AS message, ordinal, unnest([0, 1]) AS n FROM ({messages_sql(v)}) WHERE kind = 'enum'"
    return f"SELECT message, concat('V', cast(n AS string)) AS name, CAST(n + CASE WHEN ordinal % 41 = {v} AND n = 1 THEN 5 ELSE 0 END AS int) AS number FROM ({inner}) WHERE NOT (ordinal % 47 = {v} AND n = 1)"


#: Levels for running text, by priority; a lexicon in place of requirement keywords.
LEXICON = ["of the", "with", "that"]
_LEVEL = "CASE WHEN regexp_matches(text, '\\bof\\s+the\\b') THEN 'of the' WHEN regexp_matches(text, '\\bwith\\b') THEN 'with' WHEN regexp_matches(text, '\\bthat\\b') THEN 'that' END"
REQUIREMENTS_SQL = f"""
SELECT left(sha256(section || '|' || lower(text)), 12) AS id, level, text, section, path, ordinal FROM (
  SELECT section, path, ordinal, text, {_LEVEL} AS level FROM (
    SELECT section, path, unnest(range(len(parts))) AS ordinal, trim(unnest(parts)) AS text FROM (
      SELECT concat(source, '.md#', cast(doc_id AS string)) AS section, concat(source, '.md') AS path, regexp_split_to_array(text, '\\n|[.!?]\\s+') AS parts FROM documents))
) WHERE level IS NOT NULL"""


def requirements(spark, sf_dir: str) -> DataFrame:
    from ledgerline.sources.prose import plain_requirements

    docs = read(spark, sf_dir, "documents")
    path = F.concat("source", F.lit(".md"))
    found = plain_requirements(docs, LEXICON, section=F.concat(path, F.lit("#"), F.col("doc_id").cast("string")), text=F.col("text"))
    return found.withColumn("path", F.substring_index("section", "#", 1))


RELEASES = {
    "source": "event_type",
    "tag": "concat('t', cast(event_id AS string))",
    "version": "concat('1.', cast(event_id % 40 AS string), '.', cast(event_id % 7 AS string))",
    "severity": "CASE WHEN value < 20 THEN 'breaking' WHEN value < 60 THEN 'notable' ELSE 'informational' END",
    "ordinal": "event_id",
}


def events(spark, sf_dir: str) -> DataFrame:
    """Changes of five sources: one an event, with its version, severity and time as text."""
    return read(spark, sf_dir, "events").selectExpr(*_columns(RELEASES), "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") AS published_at", "user_id", "event_id")


EVENTS_SQL = f"SELECT {', '.join(_columns(RELEASES))}, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS published_at, user_id, event_id FROM events"
KEY_SQL = "list_transform(string_split({}, '.'), lambda x: cast(x AS int))"
