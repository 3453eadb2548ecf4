"""Change feed as a stream: windowed tallies, an idempotent index, and the gate that drops unchanged snapshots.

These go beyond the batch queries; the same columns and rules apply.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerline.functions.ranks import SEVERITIES


def windowed_tally(changes: DataFrame, *, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Changes (source, ts, severity) of each source and window by severity; a window closes when the watermark has passed it."""
    rows = changes.withWatermark("ts", late).groupBy(F.window("ts", length), "source")
    return rows.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]).select("source", F.col("window.start").alias("start"), *SEVERITIES)


def first_seen(changes: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """Each (source, id) once within the watermark."""
    return changes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["source", "id"])


def gate(snapshots: DataFrame) -> DataFrame:
    """(source, position, hash, late): snapshots (source, position, hash) that differ from the one before them.

    State is one hash and position a source. A snapshot that comes in a later batch than one of its
    source with the same or a higher position can't be placed any more: it comes out with late
    true, so that nothing goes unseen, and changes no state. A source's rows of a batch are one
    task's; sources are few to a batch and many over all.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, at = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values("position", kind="stable")[["source", "position", "hash"]]
        late = rows["position"] <= at if at is not None else pd.Series(False, index=rows.index)
        fresh = rows[~late].drop_duplicates("position")
        before = fresh["hash"].shift()
        changed = fresh["hash"].ne(before) | before.isna()
        if len(fresh):
            if held is not None:
                changed.iloc[0] = int(fresh["hash"].iloc[0]) != held
            state.update((int(fresh["hash"].iloc[-1]), int(fresh["position"].iloc[-1])))
        yield pd.concat([fresh[changed].assign(late=False), rows[late].assign(late=True)])

    return snapshots.groupBy("source").applyInPandasWithState(run, "source string, position long, hash long, late boolean", "hash long, position long", "append", GroupStateTimeout.NoTimeout)


def upsert_into(merge: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that hands each non-empty batch to ``merge``; merging by key makes a replayed batch harmless."""

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            merge(batch)

    return run
