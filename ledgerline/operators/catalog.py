"""The catalogue over versions: pairs, feed, lifecycles, renames, and what a source's walk keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import version_key
from ledgerline.operators.changes import significant, tally

#: Changes of wording, which a lifecycle leaves out.
EDITORIAL = ["note-changed", "brief-changed", "examples-changed"]


def by_version(source: str = "source", version: str = "version"):
    return Window.partitionBy(source).orderBy(version_key(F.col(version)))


def consecutive_pairs(versions: DataFrame) -> DataFrame:
    """(source, from_version, to_version) of neighbouring versions."""
    rows = versions.select("source", F.lag("version").over(by_version()).alias("from_version"), F.col("version").alias("to_version"))
    return rows.where("from_version IS NOT NULL")


def version_pairs(versions: DataFrame) -> DataFrame:
    """All ordered pairs of a source's versions. The versions of a source are few; they are numbered, then joined by range within the source."""
    rows = versions.select("source", "version", F.row_number().over(by_version()).alias("n"))
    later = rows.select("source", F.col("version").alias("to_version"), F.col("n").alias("m"))
    return rows.join(later, "source").where("n < m").select("source", F.col("version").alias("from_version"), "to_version")


def neighbours(versions: DataFrame) -> DataFrame:
    w = by_version()
    return versions.select("source", "version", F.lag("version").over(w).alias("previous"), F.lead("version").over(w).alias("next"))


def latest(versions: DataFrame) -> DataFrame:
    """(source, version): the newest of each source, in one aggregation."""
    return versions.groupBy("source").agg(F.max_by("version", version_key(F.col("version"))).alias("version"))


def feed(changes: DataFrame, releases: DataFrame) -> DataFrame:
    """(source, version, published_at, breaking, notable, informational): newest first; a version without a release has an empty date."""
    counts = tally(changes, "source", "version")
    rows = counts.join(releases.select("source", "version", "published_at"), ["source", "version"], "left")
    return rows.withColumn("published_at", F.coalesce("published_at", F.lit(""))).orderBy(F.desc("published_at"), "source", "version")


def visible(rows: DataFrame, untagged: list[str]) -> DataFrame:
    """Entries of sources without tags only if something in them is not informational."""
    return rows.where(~F.col("source").isin(untagged) | (F.col("breaking") + F.col("notable") > 0))


def activity(rows: DataFrame) -> DataFrame:
    """Bars of an activity chart over the feed: height from 0 to 1 by square root, place from 0 to 1 by date. Versions without a date have no place and no bar."""
    sizes = rows.where("published_at <> ''").select("*", (F.col("breaking") + F.col("notable") + F.col("informational")).alias("total"), F.unix_timestamp(F.to_timestamp("published_at")).alias("t"))
    ends = sizes.agg(F.max("total").alias("peak"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = sizes.crossJoin(F.broadcast(ends))  # one row
    return out.select("source", "version", "total", F.sqrt(ratio(F.col("total"), F.col("peak"))).alias("height"), ratio(F.col("t") - F.col("t0"), F.col("t1") - F.col("t0")).alias("place"))


def ticks(start: Column, end: Column) -> Column:
    """First days of the quarters between two dates."""
    return F.filter(F.sequence(F.date_trunc("quarter", start), end, F.expr("INTERVAL 3 MONTHS")), lambda d: d >= start)


def lifecycle(seeds: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, version, published_at, kind, detail, severity, n): everything that happened to an id, oldest first.

    seeds: attributes of the oldest version (id, version, published_at, stability). changes: (source's
    diffs) kind, id, stability, detail, severity, version, published_at, ordinal. Ids of all kinds of entity share a history.
    """
    first = seeds.select(
        "id", "version", "published_at", F.lit("first-seen").alias("kind"),
        F.concat(F.lit("Already present at v"), "version", F.lit(", the oldest release tracked here ("), "stability", F.lit(").")).alias("detail"),
        F.lit(None).cast("string").alias("severity"), F.lit(-1).cast("long").alias("ordinal"),
    )
    added = F.col("kind") == "added"
    later = changes.where(~F.col("kind").isin(EDITORIAL)).select(
        "id", "version", "published_at", F.when(added, "first-seen").otherwise(F.col("kind")).alias("kind"),
        F.when(added, F.concat(F.lit("Added as "), "stability", F.lit("."))).otherwise(F.col("detail")).alias("detail"), "severity", F.col("ordinal").cast("long").alias("ordinal"),
    )
    order = Window.partitionBy("id").orderBy(version_key(F.col("version")), "ordinal", "kind", "detail")
    return first.unionByName(later).withColumn("n", F.row_number().over(order)).drop("ordinal")


def renames(attributes: DataFrame) -> DataFrame:
    """(from_id, to_id) of attributes that have a successor."""
    return attributes.where(F.coalesce("renamed_to", F.lit("")) != "").select(F.col("id").alias("from_id"), F.col("renamed_to").alias("to_id"))


def rename_since(pairs: DataFrame, history: DataFrame) -> DataFrame:
    """Renames with the version of their first "renamed" event; null if there was none."""
    first = history.where("kind = 'renamed'").groupBy("id").agg(F.min_by("version", "n").alias("since"))
    return pairs.join(first.withColumnRenamed("id", "from_id"), "from_id", "left")


def predecessors(pairs: DataFrame) -> DataFrame:
    """(id, replaces): the ids that each successor replaces, sorted."""
    return pairs.groupBy(F.col("to_id").alias("id")).agg(F.array_sort(F.collect_set("from_id")).alias("replaces"))


def recent(rows: DataFrame, n: int, keys: list[str], order: list[Column]) -> DataFrame:
    """The first n rows of each key in an order; the limit is applied on both sides of the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def wire_history(changes: DataFrame) -> DataFrame:
    """(source, version, incompatible, compatible) of changes (source, version, severity)."""
    hard = F.col("severity") != "informational"
    return changes.groupBy("source", "version").agg(F.count_if(hard).alias("incompatible"), F.count_if(~hard).alias("compatible"))


def last_incompatible(changes: DataFrame) -> DataFrame:
    """(source, version): the newest version with a change that isn't informational."""
    return latest(significant(changes).select("source", "version"))


def canonical_hash(df: DataFrame, columns: list[str]) -> Column:
    """Hash of what a differ looks at; rows of equal hash have no change between them."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns], F.lit(len(columns)))


def resume_gate(snapshots: DataFrame) -> DataFrame:
    """Snapshots (source, position, hash) that differ from the one kept before them.

    Equal hashes mean an empty diff, and that is transitive: to equal the one kept last is to equal the
    immediate predecessor, so a lag decides and no fold over the kept ones is needed.
    """
    before = F.lag("hash").over(Window.partitionBy("source").orderBy("position"))
    return snapshots.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("hash"))).drop("before")


def resumed(commits: DataFrame, kept: DataFrame) -> DataFrame:
    """Commits (source, position, tag, published_at) after the one kept last (source, tag, published_at).

    By position if that commit is in the walk, since commits of one push share a date; by date otherwise.
    """
    last = kept.select("source", F.col("tag").alias("kept_tag"), F.col("published_at").alias("kept_at"))
    at = commits.join(last, "source").where("tag = kept_tag").groupBy("source").agg(F.min("position").alias("resume"))
    rows = commits.join(last, "source", "left").join(at, "source", "left")
    by_date = F.col("kept_at").isNull() | (F.col("published_at") > F.col("kept_at"))
    return rows.where(F.when(F.col("resume").isNotNull(), F.col("position") > F.col("resume")).otherwise(by_date)).select(*commits.columns)


def down_to_floor(commits: DataFrame, floor: str) -> DataFrame:
    """Commits newest first (source, position, sha, ...) until the one whose sha begins with ``floor``, oldest first; an error if it isn't there."""
    ends = commits.groupBy("source").agg(F.min(F.when(F.col("sha").startswith(floor), F.col("position"))).alias("end"))
    end = F.coalesce("end", F.raise_error(F.lit("the floor commit was not reached")).cast("long"))
    return commits.join(ends, "source").where(F.col("position") <= end).select(*commits.columns).orderBy("source", F.desc("position"))


def day_versions(commits: DataFrame, taken: DataFrame) -> DataFrame:
    """Versions for kept commits (source, position, day): the first of day, day.2, day.3, ... that neither a taken version (source, version) nor an earlier commit has.

    The n-th commit of a day gets the day's n-th free version, so both are numbered and joined.
    """
    day = F.regexp_extract("version", r"^(\d{4}-\d{2}-\d{2})(?:\.\d+)?$", 1)
    used = taken.where(day != "").select("source", day.alias("day"), "version").distinct()
    wanted = commits.groupBy("source", "day").agg(F.count("*").alias("n")).join(used.groupBy("source", "day").agg(F.count("*").alias("used")), ["source", "day"], "left")
    slots = wanted.select("source", "day", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") + F.coalesce("used", F.lit(0)))).alias("slot"))
    slots = slots.withColumn("version", F.when(F.col("slot") == 1, F.col("day")).otherwise(F.concat("day", F.lit("."), F.col("slot").cast("string"))))
    free = slots.join(used, ["source", "day", "version"], "left_anti")
    free = free.withColumn("turn", F.row_number().over(Window.partitionBy("source", "day").orderBy("slot"))).drop("slot")
    rows = commits.withColumn("turn", F.row_number().over(Window.partitionBy("source", "day").orderBy("position")))
    return rows.join(free, ["source", "day", "turn"]).drop("turn")


def pending(wanted: DataFrame, present: DataFrame, floor: str | None = None) -> DataFrame:
    """Wanted (source, version) that aren't present, at or above a floor version."""
    rows = wanted.join(present.select("source", "version"), ["source", "version"], "left_anti")
    return rows if floor is None else rows.where(version_key(F.col("version")) >= version_key(F.lit(floor)))


def upserted(existing: DataFrame, new: DataFrame, replace: list[str] = ()) -> DataFrame:
    """Release index after an ingest: by (source, tag) the new row wins; of replaced sources only tags that are new stay. Newest first."""
    rows = existing.where(~F.col("source").isin(list(replace))) if replace else existing
    both = rows.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)))
    rest = [c for c in existing.columns if c not in ("source", "tag")]
    won = both.groupBy("source", "tag").agg(F.max_by(F.struct(*rest), "turn").alias("r"))
    return won.select("source", "tag", "r.*").select(*existing.columns).orderBy(F.desc("published_at"), "source")
