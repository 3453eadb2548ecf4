"""Snapshots and the release index: a table partitioned by source and version, JSON files, and text outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.text import bullets, version_key, version_label
from ledgerline.operators.catalog import upserted

_DEPRECATED = "deprecated STRUCT<reason STRING, renamedTo STRING, note STRING>"
ATTRIBUTE = f"id STRING, type STRING, enumMembers ARRAY<STRUCT<id STRING, value STRING, stability STRING, brief STRING, {_DEPRECATED}>>, stability STRING, brief STRING, note STRING, examples ARRAY<STRING>, {_DEPRECATED}, namespace STRING, definedIn STRING, usedBy ARRAY<STRUCT<groupId STRING, groupType STRING, signalName STRING, requirementLevel STRING>>"
METRIC = f"name STRING, instrument STRING, unit STRING, stability STRING, brief STRING, note STRING, {_DEPRECATED}, attributes ARRAY<STRING>, definedIn STRING"
SIGNAL = f"id STRING, name STRING, kind STRING, stability STRING, brief STRING, note STRING, {_DEPRECATED}, spanKind STRING, attributes ARRAY<STRING>, definedIn STRING"
PROSE = "documents ARRAY<STRUCT<path STRING, title STRING, status STRING>>, sections ARRAY<STRUCT<id STRING, path STRING, anchor STRING, title STRING, depth INT, status STRING, length INT, normative ARRAY<STRUCT<id STRING, level STRING, text STRING, section STRING>>>>"
WIRE = "messages ARRAY<STRUCT<name STRING, kind STRING, file STRING, deprecated BOOLEAN, comment STRING, fields ARRAY<STRUCT<name STRING, number INT, type STRING, label STRING, oneof STRING, deprecated BOOLEAN, comment STRING>>, values ARRAY<STRUCT<name STRING, number INT, deprecated BOOLEAN>>, reserved ARRAY<INT>>>"
META = "source STRING, version STRING, tag STRING, publishedAt STRING"
SNAPSHOT = {
    "registry": f"{META}, attributes ARRAY<STRUCT<{ATTRIBUTE}>>, metrics ARRAY<STRUCT<{METRIC}>>, signals ARRAY<STRUCT<{SIGNAL}>>",
    "prose": f"{META}, {PROSE}",
    "wire": f"{META}, {PROSE}, {WIRE}",
}
RELEASE = "source STRING, tag STRING, version STRING, publishedAt STRING, url STRING, body STRING"
INDEX = f"generatedAt STRING, releases ARRAY<STRUCT<{RELEASE}>>"


def read_snapshots(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON snapshots (compressed or not), one a row. The schema is given: inference would lose fields that are absent by chance."""
    return spark.read.schema(SNAPSHOT[kind]).json(path)


def attributes_of(snapshots: DataFrame) -> DataFrame:
    """Attribute rows in the form that the registry diff takes."""
    a = F.col("a")
    rows = snapshots.select("source", "version", F.posexplode("attributes").alias("ordinal", "a"))
    d = a["deprecated"]
    return rows.select("source", "version", "ordinal", a["id"].alias("id"), a["type"].alias("type"), a["enumMembers"].alias("enum_members"), a["stability"].alias("stability"), a["brief"].alias("brief"), a["note"].alias("note"), a["examples"].alias("examples"), d["reason"].alias("reason"), d["renamedTo"].alias("renamed_to"), d["note"].alias("deprecation_note"), a["namespace"].alias("namespace"))


def usage_of(snapshots: DataFrame) -> DataFrame:
    rows = snapshots.select("source", "version", F.explode("attributes").alias("a")).select("source", "version", F.col("a.id").alias("id"), F.posexplode("a.usedBy").alias("ordinal", "u"))
    return rows.select("source", "version", "id", F.coalesce("u.signalName", "u.groupId").alias("signal"), F.col("u.groupId").alias("group_id"), F.col("u.groupType").alias("group_type"), F.col("u.signalName").alias("signal_name"), F.col("u.requirementLevel").alias("level"), "ordinal")


def metrics_of(snapshots: DataFrame) -> DataFrame:
    rows = snapshots.select("source", "version", F.explode("metrics").alias("m"))
    m, d = F.col("m"), F.col("m.deprecated")
    return rows.select("source", "version", m["name"].alias("id"), m["unit"].alias("unit"), m["instrument"].alias("instrument"), m["stability"].alias("stability"), m["brief"].alias("brief"), m["note"].alias("note"), d["reason"].alias("reason"), d["renamedTo"].alias("renamed_to"), d["note"].alias("deprecation_note"))


def requirements_of(snapshots: DataFrame) -> DataFrame:
    rows = snapshots.select("source", "version", F.explode("sections").alias("s")).select("source", "version", "s", F.posexplode("s.normative").alias("ordinal", "n"))
    return rows.select("source", "version", F.col("n.id").alias("id"), F.col("n.level").alias("level"), F.col("n.text").alias("text"), F.col("n.section").alias("section"), F.col("s.path").alias("path"), F.col("s.title").alias("title"), F.col("s.status").alias("status"), "ordinal")


def write_versions(rows: DataFrame, root: str) -> None:
    """Write the (source, version) partitions that ``rows`` has, replacing those and no others. A version is one directory, so a rerun is harmless."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "version").parquet(root)


def read_versions(spark: SparkSession, root: str, source: str | None = None, version: str | None = None) -> DataFrame:
    """The table or a part of it; the filters prune partitions."""
    # the partition columns are given as strings: left to itself, Spark reads version 1.10 as the number 1.1
    given = T.StructType([T.StructField(f.name, T.StringType()) if f.name in ("source", "version") else f for f in spark.read.parquet(root).schema])
    rows = spark.read.schema(given).parquet(root)
    rows = rows if source is None else rows.where(F.col("source") == source)
    return rows if version is None else rows.where(F.col("version") == version)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def versions(spark: SparkSession, root: str, source: str) -> DataFrame:
    """Versions of a source, newest first; none where nothing was written yet."""
    if not _exists(spark, root):
        return spark.createDataFrame([], "source string, version string")
    rows = read_versions(spark, root, source).select("source", "version").distinct()
    return rows.orderBy(version_key(F.col("version")).desc())


def missing(wanted: DataFrame, present: DataFrame) -> DataFrame:
    return wanted.join(present.select("source", "version"), ["source", "version"], "left_anti")


def clear_source(spark: SparkSession, root: str, source: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/source={source}")
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def tagged_releases(listed: DataFrame) -> DataFrame:
    """Releases of a listing (source, tag_name, published_at, draft, prerelease, url, body): no drafts or prereleases, no v before the version, oldest first."""
    rows = listed.where(~F.coalesce("draft", F.lit(False)) & ~F.coalesce("prerelease", F.lit(False)))
    return rows.select("source", F.col("tag_name").alias("tag"), F.regexp_replace("tag_name", "^v", "").alias("version"), "published_at", "url", F.coalesce("body", F.lit("")).alias("body")).orderBy("published_at")


def untagged_releases(commits: DataFrame) -> DataFrame:
    """Releases in place of commits (source, sha, committed_at, message, url, position): the day is the version, the short hash the tag, the first line the body."""
    return commits.select("source", F.substring("sha", 1, 7).alias("tag"), F.substring("committed_at", 1, 10).alias("version"), F.col("committed_at").alias("published_at"), "url", F.split_part("message", F.lit("\n"), F.lit(1)).alias("body"), "position")


def is_commit(tag):
    """Is a tag a commit's hash rather than the name of a tag?"""
    return tag.rlike("^[0-9a-f]{7,40}$")


def _editions(spark: SparkSession, path: str) -> list[str]:
    """Complete editions of the index below ``path``, oldest first."""
    if not _exists(spark, path):
        return []
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    names = sorted(f.getPath().getName() for f in found if f.getPath().getName().startswith("edition="))
    return [n for n in names if _exists(spark, f"{path}/{n}/_SUCCESS")]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete release index as rows; empty if there is none."""
    found = _editions(spark, path)
    if not found:
        return spark.createDataFrame([], RELEASE.replace("publishedAt", "published_at"))
    return spark.read.schema(INDEX).json(f"{path}/{found[-1]}").select(F.inline("releases")).withColumnRenamed("publishedAt", "published_at")


def write_index(spark: SparkSession, path: str, new: DataFrame, replace: list[str] = ()) -> DataFrame:
    """Merge releases into the index and write it; generatedAt is the newest release's time, not the clock's.

    Every write is a new edition beside the last one, which goes only when the new one is complete:
    whenever the driver is lost, readers find one or the other. The index is one JSON document of all
    releases, some hundred, and is made in one task.
    """
    found = _editions(spark, path)
    rows = upserted(read_index(spark, path), new, list(replace))
    packed = rows.select(F.struct("source", "tag", "version", F.col("published_at").alias("publishedAt"), "url", "body").alias("r"))
    order = lambda a, b: F.when(a["publishedAt"] != b["publishedAt"], F.when(a["publishedAt"] > b["publishedAt"], -1).otherwise(1)).otherwise(F.when(a["source"] < b["source"], -1).when(a["source"] > b["source"], 1).otherwise(0))
    one = packed.agg(F.max("r.publishedAt").alias("generatedAt"), F.array_sort(F.collect_list("r"), order).alias("releases"))
    number = int(found[-1].partition("=")[2]) + 1 if found else 1
    one.coalesce(1).write.mode("overwrite").json(f"{path}/edition={number:09d}")
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in found:
        old = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        old.getFileSystem(conf).delete(old, True)
    return read_index(spark, path)


def as_json(rows: DataFrame):
    """One compact JSON text a row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def _xml(text):
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def rss_items(feed: DataFrame, changes: DataFrame, most: int = 30) -> DataFrame:
    """One RSS item for each feed entry, with its first lines (source, version, ordinal, line) and how many more there are."""
    from ledgerline.operators.catalog import recent

    first = recent(changes, most, ["source", "version"], [F.col("ordinal")]).groupBy("source", "version").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    total = changes.groupBy("source", "version").agg(F.count("*").alias("n"))
    rows = feed.join(total, ["source", "version"], "left").join(first, ["source", "version"], "left")
    text = F.array_join(F.coalesce("lines.line", F.array().cast("array<string>")), "\n")
    more = F.when(F.col("n") > most, F.concat(F.lit("\n…and "), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise("")
    title = F.concat("source", F.lit(" "), version_label(F.col("version")))
    item = F.concat(F.lit("<item><title>"), _xml(title), F.lit("</title><description>"), _xml(F.concat(text, more)), F.lit("</description><pubDate>"), "published_at", F.lit("</pubDate></item>"))
    return rows.select("source", "version", "published_at", item.alias("item")).orderBy(F.desc("published_at"), "source", "version")


def release_notes(releases: DataFrame, untagged: list[str]) -> DataFrame:
    """(source, version, notes): first list items of a release's body; of sources without tags the body itself."""
    body = F.when(F.col("source").isin(untagged), F.array("body")).otherwise(bullets(F.col("body")))
    return releases.select("source", "version", body.alias("notes"))


def summary(counts: DataFrame) -> DataFrame:
    """A line of text for each source: (source, first, last, versions, entries)."""
    line = F.format_string("%s: %d entries, %d versions, %s to %s", "source", "entries", "versions", "first", "last")
    return counts.orderBy("source").select(line.alias("value"))
