"""Packing: length buckets that minimise padding, and token-budget batches inside each bucket.

The bucket boundaries come from a dynamic program over the global histogram of lengths. A batch
holds texts of one bucket, each padded to the bucket's boundary, and as many as the budget allows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import dac
from ledgerline.llm.common import stored, table

#: Padded tokens of a batch, and buckets.
BUDGET, BUCKETS = 32_768, 16
#: Rows that are numbered together.
SHARD_ROWS = 1000


def histogram(lengths: DataFrame, column: str = "n_tokens") -> list[tuple[int, int, int]]:
    """(length, rows, sum of lengths) of each distinct length, ascending.

    Lengths that differ number at most the root of twice all tokens, so 10^13 tokens give 4.5 million cells at the very worst.
    """
    n = F.col(column)
    found = lengths.groupBy(n.alias("n")).agg(F.count("*").alias("rows")).collect()
    return sorted((r.n, r.rows, r.n * r.rows) for r in found)


def boundaries(cells: list[tuple[int, int, int]], buckets: int) -> tuple[list[int], int]:
    """Upper lengths of at most ``buckets`` buckets that minimise total padding, and that padding.

    Ties take the fewest buckets, then the smallest boundaries. The best start of a bucket never
    moves back as the bucket's end moves on, so each layer of the program is solved by halving: all
    middle ends of a round at once, each among the starts that its neighbours leave.
    """
    if not cells:
        return [], 0
    top, rows, total = (np.array(x, dtype=np.int64) for x in zip(*cells, strict=True))
    c, s = np.r_[0, np.cumsum(rows)], np.r_[0, np.cumsum(total)]
    n = len(top)
    best = np.full(n + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    froms, ends = [], []
    for _ in range(min(buckets, n)):
        after, came = np.full(n + 1, np.iinfo(np.int64).max // 4), np.zeros(n + 1, dtype=np.int64)
        base = best + s
        first, last = np.array([1]), np.array([n])  # ends to solve, and the starts among which their best is
        low, high = np.array([0]), np.array([n - 1])
        while len(first):
            mid = (first + last) // 2
            until = np.minimum(high, mid - 1)
            size = until - low + 1
            start = np.cumsum(size) - size
            i = np.arange(size.sum()) - np.repeat(start - low, size)
            cost = base[i] - np.repeat(top[mid - 1], size) * c[i]
            least = np.minimum.reduceat(cost, start)
            hits = np.flatnonzero(cost == np.repeat(least, size))
            pick = i[hits[np.searchsorted(hits, start)]]
            after[mid], came[mid] = least + top[mid - 1] * c[mid] - s[mid], pick
            left, right = mid > first, mid < last
            first, last = np.r_[first[left], mid[right] + 1], np.r_[mid[left] - 1, last[right]]
            low, high = np.r_[low[left], pick[right]], np.r_[pick[left], high[right]]
        best = after
        froms.append(came)
        ends.append(int(best[n]))
    k = int(np.argmin(ends))
    out, j = [], n
    for came in froms[k::-1]:
        out.append(int(top[j - 1]))
        j = int(came[j])
    return out[::-1], ends[k]


def pack(lengths: DataFrame, *, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_tokens, key) -> doc_id, n_tokens, bucket, bucket_tokens, batch, slot, padding; one row for each row.

    ``lengths`` is read twice: store it first. key spreads the rows of a bucket over shards and
    orders them; equal rows may come in any order. Only the last batch of a bucket may be short of
    texts. A text longer than the budget fills a batch alone; a length below 0 or null counts as 0.
    """
    lengths = lengths.withColumn("n_tokens", F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.lit(0)))
    cells = histogram(lengths)
    tops, _ = boundaries(cells, buckets)
    if not tops:
        tops = [0]
    counts = [0] * len(tops)
    for n, rows, _ in cells:
        counts[bisect_left(tops, n)] += rows
    at = lambda values: F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("bucket") + 1)
    bucket = sum((F.col("n_tokens") > b).cast("int") for b in tops[:-1]) if len(tops) > 1 else F.lit(0)
    rows = lengths.withColumn("bucket", bucket).withColumn("shard", F.pmod(F.col("key"), at(-(-max(n, 1) // SHARD_ROWS) for n in counts)))
    per_shard = rows.groupBy("bucket", "shard").agg(F.count("*").alias("in_shard"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_shard.select("bucket", "shard", F.coalesce(F.sum("in_shard").over(before), F.lit(0)).alias("offset"))
    numbered = rows.withColumn("number", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("key", "doc_id")) - 1)
    placed = numbered.join(offsets, ["bucket", "shard"]).withColumn("place", F.col("offset") + F.col("number"))
    room = at(max(1, budget // max(1, b)) for b in tops)
    return placed.select(
        "doc_id",
        "n_tokens",
        "bucket",
        at(tops).alias("bucket_tokens"),
        F.floor(F.col("place") / room).alias("batch"),
        F.pmod(F.col("place"), room).cast("int").alias("slot"),
        (at(tops) - F.col("n_tokens")).alias("padding"),
    )


def token_lengths(docs: DataFrame, path: str, small: bool = False) -> DataFrame:
    """(doc_id, n_tokens, key) of every row: tokens of the whole text by the tokenizer at ``path``, 0 for null and empty texts. small: the encoder takes less memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = dac.encoder(path, small)
        for batch in batches:
            sizes = [len(x) // 4 for x in encoder.encode(batch.column(2).to_pylist())]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), batch.column(1)], ["doc_id", "n_tokens", "key"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("key"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, key long")


def pack_documents(docs: DataFrame, *, path: str | None = None, small: bool = False, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """Pack whole texts by their numbers of tokens; ``path``: tokenizer file, the one of the token files by default."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(dac.VOCABULARY)
    return pack(stored(token_lengths(docs, path, small), "lengths"), budget=budget, buckets=buckets)


def op1_packing(spark, sf_dir):
    """Query: bucket and batch of every document."""
    return pack_documents(table(spark, sf_dir, "documents"))
