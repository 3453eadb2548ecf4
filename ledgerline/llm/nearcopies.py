"""Near copies by exact Jaccard similarity of five-word shingles; candidates are met at SimHash anchor points.

A set of shingles has TABLES SimHash fingerprints of 46 bits, each under hashes of its own, and the
two halves of a fingerprint are decoded to words of the binary Golay code as in ``simhash``. There
few bits differ and balls of a fixed radius lose nothing; at similarity 0.8 two fingerprints differ
by 7 of 46 bits, and such balls hold nearly all anchors. So a half is decoded softly, by the sums
whose signs its bits are: a bit that flips has a small sum and weighs little. A set goes to the pairs
of each half's CHOICES best codewords. Sets at similarity 0.8 share an anchor in 0.29 of the tables
at least (measured, see ``tests/llm/test_nearcopies.py``), so one of 32 misses a pair in 2 of 100,000
cases. Of the pairs that meet, those whose fingerprints differ in over SCREEN of NEAR bits go (1 in
100,000 at 0.8; for sets of crowded anchors also over WIDE_SCREEN of WIDE bits, 1 in a million), and
every other one is compared by its whole shingle sets.

Sets a little below 0.8 to each other, such as copies of one text that differ each in another place,
meet in pairs whose number grows with the square of their group. So sets that meet others often have
the parities of their shingles' hash counts compared first, which is a bound and loses no link: what
two sets have in common changes both alike, so they differ in no more parities than they have shingles
apart. Each other set meets ``often`` sets at most, and crowded anchors pass on one edge a set.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import BROADCAST_ROWS, join_hot, small_or_shuffled, stored
from ledgerline.llm.components import connected_components
from ledgerline.llm.simhash import _GOLAY_N, _SPREAD, SEED, _as_long, _stars, _syndrome, shingle_hashes

#: Words of a shingle, and least similarity of linked texts.
SHINGLE, SIMILARITY = 5, Fraction(4, 5)
#: Fingerprints of a set, codewords that a half of one goes to, and most bits in which candidates differ among the first NEAR.
TABLES, CHOICES, SCREEN, NEAR = 32, 2, 44, 128
#: Most bits in which candidates from crowded anchors differ among the first WIDE; sets of fewer shingles than WIDE_FROM aren't asked, their bits flip more often.
WIDE_SCREEN, WIDE, WIDE_FROM = 216, 1024, 6
#: Sets of an anchor that are compared pair by pair; more are compared in blocks of BLOCK sets, two blocks a task.
FEW, BLOCK = 32, 1024
#: Least and most bits of parities: two to four a shingle between them. Most sets whose parities are broadcast, 20 MB.
ODD_LEAST, ODD_MOST, ODD_ROWS = 64, 8192, 20_000
#: Rows whose hashes a task holds at a time.
ROWS_AT_ONCE = 500
#: Shingles that are counted together, and as many as a byte counts.
_CHUNK, _BYTE = 2048, 255
_SALTS = np.random.default_rng(SEED).integers(0, 2**64, (TABLES, 1), dtype=np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Hashes of a text's distinct shingles, ascending."""
    return np.unique(shingle_hashes(text, SHINGLE))


def set_key(shingles: np.ndarray) -> int:
    """Signed hash that stands for a whole set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), SEED) - 2**63


def sums(shingles: np.ndarray) -> np.ndarray:
    """For each table and bit, shingles whose hash has the bit minus those whose hash hasn't; a fingerprint's bit is set where it is above zero."""
    counts = np.zeros((TABLES, 48), dtype=np.int64)
    for i in range(0, len(shingles), _BYTE):
        h = shingles[None, i : i + _BYTE] ^ _SALTS
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        counts += np.add.reduce(_SPREAD[h.view(np.uint8).reshape(TABLES, -1, 8)[:, :, :6]], axis=1).view(np.uint8)
    return (2 * counts - len(shingles))[:, : 2 * _GOLAY_N]


@cache
def _codewords() -> np.ndarray:
    """(bit, codeword number): 1 where the bit is set, else -1."""
    number = np.arange(1 << 12) << 11
    words = number ^ _syndrome(number)
    return (2 * (words[None, :] >> np.arange(_GOLAY_N)[:, None] & 1) - 1).astype(np.float32)


def anchors(sums_: np.ndarray) -> np.ndarray:
    """(table, half, choice) codeword numbers: the best by the sums of each half."""
    scores = sums_.reshape(-1, _GOLAY_N).astype(np.float32) @ _codewords()
    rows, best = np.arange(len(scores)), []
    for _ in range(CHOICES):
        best.append(scores.argmax(axis=1))
        scores[rows, best[-1]] = -np.inf
    return np.stack(best, axis=1).astype(np.uint16).reshape(-1, 2, CHOICES)


def near_bits(sums_: np.ndarray, bits: int = NEAR) -> list[int]:
    """The first bits of a set's fingerprints as signed longs."""
    return np.packbits(sums_.reshape(-1)[:bits] > 0, bitorder="little").view(np.int64).tolist()


def odd_bits(shingles: np.ndarray) -> list[int]:
    """For each value of the hashes' low bits, is it found an odd number of times? As signed longs; halves of twice as many bits fold to these by exclusive or."""
    n = min(max(ODD_LEAST, 1 << (2 * len(shingles) - 1).bit_length()), ODD_MOST)
    counts = np.bincount((shingles & np.uint64(n - 1)).astype(np.int64), minlength=n)
    return np.packbits(counts & 1, bitorder="little").view(np.int64).tolist()


def can_be_similar(a: str, b: str) -> Column:
    """False only where sizes or parities (columns <a>size, <a>odd) show that two sets aren't similar; true where one has no parities.

    Sizes that can be similar are close, so there one side has twice the other's parities at most.
    """
    xor = lambda x, y: x.bitwiseXOR(y)

    def folded(x: str, y: str) -> Column:
        odd, n = F.col(x + "odd"), F.size(y + "odd")
        return F.when(F.size(odd) > n, F.zip_with(F.slice(odd, 1, n), F.slice(odd, n + 1, n), xor)).otherwise(odd)

    apart = F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda n, x: n + x)
    sizes = [F.col(x + "size") for x in (a, b)]
    up, down = SIMILARITY.numerator, SIMILARITY.denominator
    close = F.greatest(*sizes) * up <= F.least(*sizes) * down
    return F.when(F.col(a + "odd").isNull() | F.col(b + "odd").isNull(), True).otherwise(close & (apart * (down + up) <= (sizes[0] + sizes[1]) * (down - up)))


def places(found: np.ndarray) -> np.ndarray:
    """One number for each table and pair of codewords, from rows of ``anchors``: (row, place)."""
    first, second = found[:, :, 0, :, None].astype(np.int64), found[:, :, 1, None, :].astype(np.int64)
    table = np.arange(found.shape[1])[None, :, None, None]
    return (table << 24 | first << 12 | second).reshape(len(found), -1)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Is the Jaccard similarity of two ascending sets SIMILARITY at least?"""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILARITY.denominator >= SIMILARITY.numerator * (len(a) + len(b) - both)


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """``similar`` for each of left x right. Counts common shingles by products of membership tables, _CHUNK shingles at a time."""
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    owners = [np.repeat(np.arange(len(side)), n) for side, n in zip((left, right), sizes, strict=True)]
    known = np.intersect1d(np.concatenate(left), np.concatenate(right))
    columns = [np.searchsorted(known, np.concatenate(side)) for side in (left, right)]
    real = [(c < len(known)) & (known[np.minimum(c, len(known) - 1)] == np.concatenate(side)) if len(known) else c < 0 for c, side in zip(columns, (left, right), strict=True)]
    both = np.zeros((len(left), len(right)), dtype=np.int64)
    for i in range(0, len(known), _CHUNK):
        tables = []
        for side, owner, column, ok in zip((left, right), owners, columns, real, strict=True):
            here = ok & (column >= i) & (column < i + _CHUNK)
            member = np.zeros((len(side), _CHUNK), dtype=np.float32)
            member[owner[here], column[here] - i] = 1
            tables.append(member)
        both += (tables[0] @ tables[1].T).astype(np.int64)
    return both * SIMILARITY.denominator >= SIMILARITY.numerator * (sizes[0][:, None] + sizes[1][None, :] - both)


def often(sets: int) -> float:
    """Meetings of a set among so many sets, above which its candidates are asked for their parities: one a place, and twice those that chance brings."""
    by_chance = sets * CHOICES**2 / 2**24
    return TABLES * CHOICES**2 * (1 + 2 * by_chance)


def links(prints: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) keys that connect the same sets as all links do. ``prints``: stored, with key, anchors, near, further, odd, size and text_hash; ``texts``: text and text_hash.

    Anchors of many sets are settled first. What they connect needs no further comparison, so a large
    group of near copies isn't compared once more in all its pairs where few of it meet.
    Edges of what they connect are one for each set, to its root.
    """
    same = [F.first(c).alias(c) for c in ("anchors", "near", "further", "odd", "size")]
    sets = stored(prints.groupBy("key").agg(*same, F.min("text_hash").alias("text_hash")), "sets")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(k, ROWS_AT_ONCE)
                batch = batch.filter(pc.greater(pc.binary_length(batch.column(3)), 0))
                if not batch.num_rows:
                    continue
                found = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint16)
                at = places(found.reshape(batch.num_rows, TABLES, 2, CHOICES))
                rest = [pa.array(np.repeat(batch.column(i).to_numpy(), at.shape[1])) for i in range(3)]
                yield pa.record_batch([pa.array(at.reshape(-1)), *rest], ["band", "key", "near", "further"])

    placed = sets.select("key", "near", "further", "anchors").mapInArrow(place, "band long, key long, near long, further long")
    shared = stored(placed.withColumn("n", F.count("*").over(Window.partitionBy("band"))).where("n > 1"), "shared")
    few, many = shared.where(F.col("n") <= FEW), shared.where(F.col("n") > FEW).select("band", "key", "n")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([shingle_set(x.as_py()).tobytes() for x in batch.column(1)], pa.binary())], ["key", "shingles"])

    def whole(keys: DataFrame) -> DataFrame:
        needed = sets.join(keys.distinct(), "key", "left_semi").select("key", "text_hash")
        found = texts.join(small_or_shuffled(needed, BROADCAST_ROWS), "text_hash").dropDuplicates(["key"]).select("key", "text")
        return stored(found.mapInArrow(hashed, "key long, shingles binary"), "shingles")

    of = lambda x: np.frombuffer(x.as_py(), dtype=np.uint64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(of(x), of(y)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def meet(rows: pa.Table) -> pa.Table:
        keys, block = rows.column("key").to_numpy().view(np.uint64), rows.column("block").to_numpy()
        found = [of(x) for x in rows.column("shingles")]
        left = np.flatnonzero(block == block.min())
        right = np.flatnonzero(block == block.max())
        linked = similar_pairs([found[i] for i in left], [found[i] for i in right])
        linked &= keys[left][:, None] != keys[right][None, :]
        a, b = _stars(keys[left], keys[right], linked, direct=0)
        return pa.table({"a": _as_long(a), "b": _as_long(b)})

    def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets_ = [of(x) for x in batch.column(1)]
            wide = [near_bits(sums(x), WIDE) if len(x) >= WIDE_FROM else None for x in sets_]
            yield pa.record_batch([batch.column(0), pa.array(wide, pa.list_(pa.int64()))], ["key", "wide"])

    busy = few.groupBy("key").agg(F.sum(F.col("n") - 1).alias("m")).where(F.col("m") > often(sets.count()))
    odd = stored(sets.join(small_or_shuffled(stored(busy.select("key"), "busy")), "key").select("key", "size", "odd"), "odd")
    few = few.join(small_or_shuffled(odd, ODD_ROWS), "key", "left")
    if many.isEmpty():
        roots = None
        few = few.select("*", F.col("key").alias("root"), F.lit(None).cast("array<long>").alias("wide"))
    else:
        crowd = whole(many.select("key"))
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        dealt = many.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("band", "key", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).join(crowd, "key")
        met = stored(dealt.groupBy("band", "low", "high").applyInArrow(meet, "a long, b long"), "met")
        roots = connected_components(met)
        settled = stored(crowd.mapInArrow(widened, "key long, wide array<long>").join(roots.withColumnRenamed("node", "key"), "key", "left"), "settled")
        few = few.join(small_or_shuffled(settled), "key", "left").withColumn("root", F.coalesce("root", "key"))
    side = lambda x: few.select("band", F.col("key").alias(x), *[F.col(c).alias(x + c) for c in ("near", "further", "root", "wide", "size", "odd")])
    differ = F.bit_count(F.col("anear").bitwiseXOR(F.col("bnear"))) + F.bit_count(F.col("afurther").bitwiseXOR(F.col("bfurther")))
    wide = F.aggregate(F.zip_with("awide", "bwide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    apart = (F.col("a") < F.col("b")) & (F.col("aroot") != F.col("broot"))
    pairs = side("a").join(side("b"), "band").where(apart & (differ <= SCREEN) & (F.coalesce(wide, F.lit(0)) <= WIDE_SCREEN) & can_be_similar("a", "b"))
    pairs = stored(pairs.select("a", "b").distinct(), "pairs")
    both = whole(pairs.select(F.col("a").alias("key")).union(pairs.select("b")))
    first = pairs.join(both.select(F.col("key").alias("a"), F.col("shingles").alias("left")), "a")
    second = first.join(both.select(F.col("key").alias("b"), F.col("shingles").alias("right")), "b")
    paired = second.select("a", "b", "left", "right").mapInArrow(compare, "a long, b long")
    return stored(paired.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))) if roots else paired, "links")


def rooted(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash, root) for every row, stored: rows of equal root are connected over similar texts.

    Equal shingle sets are one vertex; null and wordless texts are one, too. A text of fewer than
    SHINGLE words has its whole word sequence as its one shingle. Repeated rows stay repeated, ids may be null.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), text_hash(text).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(k, ROWS_AT_ONCE)
                keys, found, near, odd, sizes = [], [], [], [], []
                for x in batch.column(2):
                    shingles = shingle_set(x.as_py())
                    total = sums(shingles)
                    keys.append(set_key(shingles))
                    found.append(anchors(total).tobytes() if len(shingles) else b"")
                    near.append(near_bits(total))
                    odd.append(odd_bits(shingles))
                    sizes.append(len(shingles))
                first, second = zip(*near, strict=True)
                columns = [pa.array(x, pa.int64()) for x in (keys, first, second, sizes)]
                columns += [pa.array(odd, pa.list_(pa.int64())), pa.array(found, pa.binary())]
                yield pa.record_batch([batch.column(0), batch.column(1), *columns], ["doc_id", "text_hash", "key", "near", "further", "size", "odd", "anchors"])

    prints = rows.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, key long, near long, further long, size long, odd array<long>, anchors binary")
    prints = stored(prints, "prints")
    roots = connected_components(links(prints, rows.select("text", "text_hash")))
    named = join_hot(prints.select("doc_id", "text_hash", "key"), roots.withColumnRenamed("node", "key"), ["key"], "left")
    return stored(named.select("doc_id", "text_hash", F.coalesce("root", "key").alias("root")), "named")


def text_hash(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def first_rows(named: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n) of the row of each root that stays, from ``rooted``: the smallest doc_id, then text_hash; without an id only where no row has one. n: rows of that id and text."""
    counts = named.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash", "n")).alias("k")
    return counts.groupBy("root").agg(least).select("k.doc_id", "k.text_hash", "k.n")


def groups(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash, component_id) for every row: component_id is the smallest doc_id reachable over similar texts, null if none has one."""
    named = rooted(docs, text=text, doc_id=doc_id)
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(smallest, "root").select("doc_id", "text_hash", "component_id")
