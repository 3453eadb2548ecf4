"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint's low 46 bits are two words of the binary Golay code's length, 23. That code is
perfect with covering radius 3: each half has exactly one codeword within 3 bits, so a pair of
codewords, the anchor, lies within 3 bits of each half of every fingerprint. If x and y differ in
at most 2 bits, with d1 of them in the first half and d2 in the second, then y is within 3 + d1
and 3 + d2 bits of x's own anchor. So x goes to its own anchor and y to every anchor within
3 + e1 and 3 + e2 bits for e1 + e2 <= 2, about 61 of 2^24, and they meet there: nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import BROADCAST_ROWS, join_hot, small_or_shuffled, stored, table
from ledgerline.llm.components import connected_components

SEED = 42
#: Words of a shingle, and bits in which linked fingerprints may differ.
SHINGLE, BITS = 3, 2
#: Most fingerprints whose own anchor is the same that one task holds at a time; further ones go to further tasks.
HOME_BLOCK = 512
_GOLAY_N, _RADIUS, _POLY = 23, 3, 0b101011100011
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: For each byte value, its bits spread over the eight bytes of a 64-bit word.
_SPREAD = np.array([int.from_bytes(bytes(b >> i & 1 for i in range(8)), "little") for b in range(256)], dtype=np.uint64)


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle; of the whole sequence if it has fewer words; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        found = [digest(b" ".join(words), SEED)] if words else []
    elif size == 3:
        found = [digest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:], strict=False)]
    else:
        found = [digest(b" ".join(words[i : i + size]), SEED) for i in range(len(words) - size + 1)]
    return np.array(found, dtype=np.uint64)


def simhash(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint, unsigned."""
    hashes = shingle_hashes(text, size)
    n = len(hashes)
    if not n:
        return 0
    spread = _SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 255):  # a byte counts up to 255
        counts += np.add.reduce(spread[i : i + 255], axis=0).view(np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


@cache
def _golay() -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Syndrome of each of 2^23 words by table halves, and for each excess 0, 1, 2 the error patterns by syndrome (offsets, patterns)."""
    rest = np.zeros(_GOLAY_N, dtype=np.int64)
    for i in range(_GOLAY_N):
        word = 1 << i
        for k in range(_GOLAY_N - 1, 10, -1):
            if word >> k & 1:
                word ^= _POLY << (k - 11)
        rest[i] = word
    table_ = np.zeros((3, 256), dtype=np.int64)
    for part in range(3):
        for i in range(min(8, _GOLAY_N - 8 * part)):
            step = 1 << i
            table_[part, step : 2 * step] = table_[part, :step] ^ rest[8 * part + i]
    by_excess: list[list[tuple[int, int]]] = [[], [], []]
    for weight in range(_RADIUS + BITS + 1):
        for at in combinations(range(_GOLAY_N), weight):
            syndrome = 0
            for i in at:
                syndrome ^= int(rest[i])
            by_excess[max(0, weight - _RADIUS)].append((syndrome, sum(1 << i for i in at)))
    out = []
    for found in by_excess:
        arr = np.array(sorted(found), dtype=np.int64)
        out.append((np.searchsorted(arr[:, 0], np.arange(2049)), arr[:, 1].copy()))
    return table_, out


def _syndrome(words: np.ndarray) -> np.ndarray:
    t, _ = _golay()
    return t[0, words & 255] ^ t[1, words >> 8 & 255] ^ t[2, words >> 16 & 127]


def _near(words: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into words, codeword number) of the codewords whose distance exceeds the radius by ``excess`` (0: within it)."""
    start, patterns = _golay()[1][excess]
    syndrome = _syndrome(words)
    count = start[syndrome + 1] - start[syndrome]
    index = np.repeat(np.arange(len(words)), count)
    within = np.arange(len(index)) - np.repeat(np.cumsum(count) - count, count)
    return index, (words[index] ^ patterns[start[syndrome][index] + within]) >> 11


def anchors(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, anchor, is it the own one) over all anchors that a fingerprint must be sent to."""
    low = fingerprints.astype(np.uint64)
    halves = [(low & np.uint64((1 << 23) - 1)).astype(np.int64), (low >> np.uint64(23) & np.uint64((1 << 23) - 1)).astype(np.int64)]
    near = [[_near(half, e) for e in range(BITS + 1)] for half in halves]
    parts = []
    for e1 in range(BITS + 1):
        for e2 in range(BITS + 1 - e1):
            (i1, c1), (i2, c2) = near[0][e1], near[1][e2]
            n2 = np.bincount(i2, minlength=len(low))
            first = np.cumsum(n2) - n2
            times = n2[i1]
            index = np.repeat(i1, times)
            within = np.arange(len(index)) - np.repeat(np.cumsum(times) - times, times)
            parts.append((index, np.repeat(c1, times) << 12 | c2[first[index] + within], np.full(len(index), e1 + e2 == 0)))
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(3))


def _as_long(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long): the fingerprint of every row; null and wordless texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((simhash(x.as_py(), size) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.record_batch([batch.column(0), _as_long(fp)], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _stars(left: np.ndarray, right: np.ndarray, linked: np.ndarray, direct: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what ``linked`` (left x right) connects: the links themselves if they are few, ``direct`` a row at most, else a star for each connected part."""
    rows, cols = np.nonzero(linked)
    if len(rows) <= direct * (len(left) + len(right)):
        return left[rows], right[cols]
    a, b = [], []
    open_left = linked.any(axis=1)
    while open_left.any():
        rows = np.zeros(len(left), dtype=bool)
        rows[np.argmax(open_left)] = True
        while True:
            cols = linked[rows].any(axis=0)
            more = linked[:, cols].any(axis=1)
            if (more == rows).all():
                break
            rows = more
        members = np.unique(np.concatenate([left[rows], right[cols]]))
        a.append(np.full(len(members) - 1, members[0], dtype=np.uint64))
        b.append(members[1:])
        open_left &= ~rows
    return (np.concatenate(a), np.concatenate(b)) if a else (left[:0], right[:0])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, block), own ones first: links of each group as (a, b). Holds one group's own fingerprints at a time."""
    key, own = None, np.zeros(0, dtype=np.uint64)
    for batch in batches:
        anchor, block = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        fp = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
        home = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
        cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(block) != 0)) + 1
        outs: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j in zip(np.r_[0, cut], np.r_[cut, len(fp)], strict=True):
            if key != (anchor[i], block[i]):
                key, own = (anchor[i], block[i]), fp[:0]
            here = home[i:j]
            if here.any():
                own = np.concatenate([own, fp[i:j][here]])
            if not len(own) or (len(own) == 1 and j - i == 1 and here[0]):
                continue
            other = np.unique(fp[i:j])
            differ = np.bitwise_count(own[:, None] ^ other[None, :])
            linked = (differ <= BITS) & (differ > 0)
            if linked.any():
                outs.append(_stars(own, other, linked))
        if outs:
            yield pa.record_batch([_as_long(np.concatenate([x[k] for x in outs])) for k in (0, 1)], ["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) longs that connect the same fingerprints as all links do. ``distinct``: a stored table with column fp.

    Every fingerprint goes to its anchors. An anchor that is nobody's own is no meeting place, and
    one bit for each of the 2^24 anchors (2 MB, whatever the input) tells which those are.
    """
    spark = distinct.sparkSession

    def own_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            first, second = (_near(half.astype(np.int64), 0)[1] for half in (low & np.uint64((1 << 23) - 1), low >> np.uint64(23) & np.uint64((1 << 23) - 1)))
            yield pa.record_batch([pa.array((first << 12 | second).astype(np.int64))], ["anchor"])

    homes = distinct.select("fp").mapInArrow(own_anchor, "anchor long").groupBy("anchor").count()
    homes = stored(homes, "homes")
    used = np.zeros(1 << 21, dtype=np.uint8)
    number = F.col("anchor") + 1  # Spark counts positions from 1
    bitmaps = homes.groupBy(F.bitmap_bucket_number(number).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
    for row in bitmaps.toLocalIterator():
        used[(row.k - 1) * 4096 : row.k * 4096] = np.frombuffer(bytes(row.bits), dtype=np.uint8)
    shared = spark.sparkContext.broadcast(used.tobytes())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                fp = batch.column(0).slice(k, 2000).to_numpy(zero_copy_only=False).view(np.uint64)
                index, anchor, home = anchors(fp)
                keep = home | (bits[anchor >> 3] >> (anchor & 7) & 1).astype(bool)
                yield pa.record_batch([pa.array(anchor[keep]), _as_long(fp[index[keep]]), pa.array(home[keep])], ["anchor", "fp", "home"])

    sent = distinct.select("fp").mapInArrow(send, "anchor long, fp long, home boolean")
    hot = homes.where(F.col("count") > HOME_BLOCK).select("anchor", F.ceil(F.col("count") / HOME_BLOCK).cast("int").alias("blocks"))
    sent = sent.join(small_or_shuffled(hot), "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), "blocks").cast("int")
    sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("anchor", "block", "fp", (F.col("home") & (F.col("block") == mine)).alias("home"))
    placed = sent.repartition(_partitions(distinct), "anchor", "block").sortWithinPartitions("anchor", "block", F.col("home").desc())
    return placed.mapInArrow(_compare, "a long, b long")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def groups(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest doc_id reachable over links.

    Equal fingerprints are one vertex, so copies cost nothing in the search. A null doc_id never
    becomes a component_id unless its group has no other; a null or wordless text has fingerprint 0.
    Repeated rows stay repeated.
    """
    prints = stored(fingerprints(docs, text=text, doc_id=doc_id), "prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected_components(links(distinct))
    linked = distinct.join(roots, distinct.fp == roots.node).select("fp", "first", "root")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = linked.join(smallest, "root").select("fp", "component_id")
    whole = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    whole = stored(whole, "whole")
    return join_hot(prints, whole, ["fp"])


def dedup(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, whole and with the columns of ``docs``.

    Groups are those of ``nearcopies``: exact similarity of five-word shingles, not this module's
    query constants. Which row stays is decided row by row, by id and text: the smallest doc_id,
    then the smallest hash of the text, a row without an id only where no row of the group has one.
    Of rows equal in both the one with the least hash of its JSON stays. Rows of one doc_id with
    texts that aren't alike are in different groups, and each group keeps its own.
    """
    from ledgerline.llm import nearcopies

    kept = stored(nearcopies.first_rows(nearcopies.rooted(docs)), "kept")
    mark = "_" * (1 + max(map(len, docs.columns)))  # begins no column of docs
    keys = kept.select(F.col("doc_id").alias(mark + "id"), F.col("text_hash").alias(mark + "hash"), F.col("n").alias(mark + "n"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(mark + "id")) & (nearcopies.text_hash("text") == F.col(mark + "hash"))
    found = docs.join(small_or_shuffled(keys, BROADCAST_ROWS), same)
    single = found.where(F.col(mark + "n") == 1).select(docs.columns)
    if kept.where("n > 1").isEmpty():
        return single
    row = F.struct(*[F.col(c) for c in docs.columns])
    one = found.where(F.col(mark + "n") > 1).groupBy(mark + "id", mark + "hash").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row"))
    return single.unionByName(one.select("row.*"))


def op5_simhash(spark, sf_dir):
    """Query: fingerprint and component of every document."""
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
