"""Session-level helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def visible(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from the driver's path of it, where they share one."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    A session without ``spark.checkpoint.dir`` gets a temporary one in local mode (tests) and an
    error elsewhere, since no folder of one machine is visible to the others.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Side tables larger than this are joined by shuffle instead of broadcast.
BROADCAST_ROWS = 200_000


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join by shuffle and sort. Without the hint Spark goes by the size of compressed files and sends tables of millions of short rows through the driver."""
    return df.hint("merge")


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has ``limit`` rows at most, else ``shuffled``."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else shuffled(df)


#: A key with more than this share of all rows is hot; there are fewer of them than its inverse.
HOT_SHARE = 1 / 1000


def join_hot(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` joined with ``side``, which has each key once; how: inner or left. ``rows``: a stored table.

    A small side is broadcast. Else the rows of hot keys, found by a count that is combined before
    its shuffle, meet those keys' few rows of the side by broadcast, and only the others are shuffled:
    no task gets more than HOT_SHARE of the rows for one key.
    """
    if side.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(side), keys, how)
    total = rows.count()
    hot = stored(rows.groupBy(*keys).count().where(F.col("count") > total * HOT_SHARE).select(*keys), "hot")
    often = rows.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(side.join(F.broadcast(hot), keys, "left_semi")), keys, how)
    return often.unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(side, keys, how))


#: Tables that the innermost ``scratch`` deletes at its end.
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


@contextmanager
def scratch() -> Iterator[None]:
    """Delete the intermediate tables that are stored inside, when nothing reads them any more: after the results are written.

    Frames from inside can't be read afterwards, but for those stored with ``keep``.
    """
    made: list[DataFrame] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for df in made:
            drop_stored(df)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage ends at those files. keep: past the end of a ``scratch``."""
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/ledgerline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_path = path
    if not keep and (made := _made.get()) is not None:
        made.append(back)
    return back


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` that nothing reads any more."""
    path = getattr(df, "_stored_path", None)
    if path:
        jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context.hadoopConfiguration()).delete(target, True)
