"""Embedding near-duplicates by counting collisions on sorted projections.

Every unit vector is projected many times, and each order sorts the vectors by one projection: two
vectors collide in it if one lies within the window around the other. On a single projection that
window holds a ninth of all vectors at the usual threshold, so an order is cut by a grid of further
projections first: vectors must share a grid cell as well. The number of orders and the collisions
that a pair needs are calibrated: a pair exactly at the threshold passes with probability RECALL,
and closer pairs more surely. Pairs that pass are verified by cosine in double precision.

The sorted line of a cell is cut into strips; a vector near a strip's lower end is also a visitor of
the strip below, so every collision happens in one strip. A strip with many vectors is cut into
chunks that are compared two by two, in tasks of their own. Pairs never leave the task that finds
them: a pair counts in the first order it collides in only, so the tasks' link counts add up, and
connectivity leaves as one edge a vector and block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import join_hot, small_or_shuffled, stored, table
from ledgerline.llm.components import connected_components

COSINE, RECALL, SEED = 0.98, 0.99, 20_240
#: Grid width and half window, in distances of a pair at the threshold.
GRID, WINDOW = 4.0, 2.0
#: Chance neighbours within a window that a vector may have in an order; sets the projections of a cell.
CHANCE = 0.05
#: Length of a strip in windows.
STRIP = 4
#: Vectors of a strip that one block holds; more are cut into chunks, whose size grows with the root of the strip's size up to LARGEST.
CHUNK, GROWTH, LARGEST = 512, 64, 16_384
#: Vectors of a block up to which pairs are found by neighbours in place, for all such blocks at once; beyond, by matrix products.
FEW = 16
#: Vectors of a block that one product takes, and pairs whose collisions are counted in one step.
ROWS, STEP = 256, 60_000
#: Rounding that a product may have before a pair is looked at by itself.
ROUNDING = 1e-9


@dataclass(frozen=True)
class Plan:
    """cells: grid projections of an order. orders, count: how many orders, and collisions that a pair needs."""

    cosine: float
    cells: int
    orders: int
    count: int

    @property
    def distance(self) -> float:
        return math.sqrt(2 - 2 * self.cosine)


def same_cell(distance: float, width: float) -> float:
    """Chance that points whose projections differ by N(0, distance^2) share a cell of a random grid."""
    z = width / distance
    return math.erf(z / math.sqrt(2)) - math.sqrt(2 / math.pi) / z * (1 - math.exp(-z * z / 2))


def passing(plan: Plan, cosine: float) -> float:
    """Chance that a pair of this cosine has enough collisions."""
    d, r = math.sqrt(max(2 - 2 * cosine, 1e-18)), plan.distance
    p = same_cell(d, GRID * r) ** plan.cells * math.erf(WINDOW * r / d / math.sqrt(2))
    return 1 - sum(math.comb(plan.orders, i) * p**i * (1 - p) ** (plan.orders - i) for i in range(plan.count))


def calibrate(rows: int, cosine: float = COSINE, recall: float = RECALL, count: int = 2) -> Plan:
    """The plan for so many vectors of a label: longer cells for more vectors, then orders enough for the recall."""
    r = math.sqrt(2 - 2 * cosine)
    chance = same_cell(math.sqrt(2), GRID * r)
    window = math.erf(WINDOW * r / 2)
    cells = max(1, math.ceil(math.log(max(rows, 2) * window / CHANCE) / -math.log(chance)))
    orders = count
    while passing(Plan(cosine, cells, orders, count), cosine) < recall:
        orders += 1
    return Plan(cosine, cells, orders, count)


@lru_cache(8)
def _directions(plan: Plan, dimension: int) -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng([SEED, dimension, plan.cells, plan.orders])
    grid = rng.standard_normal((dimension, plan.orders * plan.cells))
    shift = rng.uniform(0, GRID * plan.distance, plan.orders * plan.cells)
    mix = rng.integers(1, 2**62, (plan.orders, plan.cells), dtype=np.int64) * 2 + 1
    salt = rng.integers(0, 2**62, plan.orders, dtype=np.int64)
    return grid, shift, mix, salt, rng.standard_normal((dimension, plan.orders))


def projected(plan: Plan, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each vector in each order, projection that the order sorts by)."""
    grid, shift, mix, salt, sort = _directions(plan, vectors.shape[1])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    steps = np.floor((unit @ grid + shift) / (GRID * plan.distance)).astype(np.int64).reshape(-1, plan.orders, plan.cells)
    return (steps * mix).sum(axis=2) + salt, unit @ sort


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length, as doubles, each divided by its largest component."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    found = flat.reshape(len(column), -1)
    return found / np.abs(found).max(axis=1, keepdims=True)


def _by_dimension(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    sizes = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        yield batch if (sizes == size).all() else batch.filter(pa.array(sizes == size))


def _labels(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest position that each of n positions is connected to over the pairs."""
    found = np.arange(n)
    while True:
        after = found.copy()
        np.minimum.at(after, i, found[j])
        np.minimum.at(after, j, found[i])
        after = after[after]
        if (after == found).all():
            return found
        found = after


def _few(block: np.ndarray, place: np.ndarray, rows: np.ndarray, window: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``rows`` that are of one block and within the window: each row with its 1st, 2nd, ... next one in place."""
    rows = rows[np.lexsort((place[rows], block[rows]))]
    own, at = block[rows], place[rows]
    left, right = [], []
    i, k = np.arange(len(rows)), 1
    while len(i):
        i = i[i + k < len(rows)]
        i = i[(own[i] == own[i + k]) & (at[i + k] - at[i] <= window)]
        left.append(rows[i])
        right.append(rows[i + k])
        k += 1
    return np.concatenate(left or [rows[:0]]), np.concatenate(right or [rows[:0]])


def _many(unit: np.ndarray, place: np.ndarray, rows: np.ndarray, window: float, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one block's rows within the window whose product reaches ``cosine``."""
    rows = rows[np.argsort(place[rows])]
    until = np.searchsorted(place[rows], place[rows] + window, side="right")
    for k in range(0, len(rows), ROWS):
        high = until[min(k + ROWS, len(rows)) - 1]
        a, b = np.nonzero(unit[rows[k : k + ROWS]] @ unit[rows[k:high]].T >= cosine)
        near = (b > a) & (b + k < until[k + a])
        yield rows[k + a[near]], rows[k + b[near]]


def compare(plan: Plan, block: np.ndarray, order: np.ndarray, side: np.ndarray, home: np.ndarray, x: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of whole blocks that their orders own: (links of each vector, pairs i, pairs j).

    block: ascending numbers. side: 0, or the chunk of a vector where its block compares two chunks
    (1 and 2), whose pairs are taken across only. home: false for visitors, which pair with homes only.
    times: copies of each vector.
    """
    n, window = len(x), WINDOW * plan.distance
    cell, place = (np.concatenate(v) for v in zip(*(projected(plan, x[k : k + 2000]) for k in range(0, n, 2000)), strict=True))
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    unit = x / length[:, None]
    own = place[np.arange(n), order]
    wide = window * (1 + ROUNDING)
    sizes = np.bincount(block - block[0])
    small = sizes[block - block[0]] <= FEW
    ends = np.cumsum(sizes)
    found = [_few(block, own, np.flatnonzero(small), wide)]
    large = (_many(unit, own, np.arange(e - s, e), wide, plan.cosine - ROUNDING) for s, e in zip(sizes, ends, strict=True) if s > FEW)
    links, kept = np.zeros(n, dtype=np.int64), []
    for i, j in chain(found, *large):
        for k in range(0, len(i), STEP):
            a, b = i[k : k + STEP], j[k : k + STEP]
            ok = (home[a] | home[b]) & ((side[a] == 0) | (side[a] != side[b]))
            a, b = a[ok], b[ok]
            about = np.einsum("ij,ij->i", unit[a], unit[b])
            ok = about >= plan.cosine + ROUNDING
            unsure = np.flatnonzero(~ok & (about >= plan.cosine - ROUNDING))
            ok[unsure] = np.einsum("ij,ij->i", x[a[unsure]], x[b[unsure]]) >= plan.cosine * length[a[unsure]] * length[b[unsure]]
            a, b = a[ok], b[ok]
            hit = (cell[a] == cell[b]) & (np.abs(place[a] - place[b]) <= window)
            ok = (hit.sum(axis=1) >= plan.count) & (hit.argmax(axis=1) == order[a]) & hit[np.arange(len(a)), order[a]]
            a, b = a[ok], b[ok]
            np.add.at(links, a, times[b])
            np.add.at(links, b, times[a])
            kept.append((a, b))
    empty = np.zeros(0, dtype=np.int64)
    return links, np.concatenate([a for a, _ in kept] or [empty]), np.concatenate([b for _, b in kept] or [empty])


def candidates(nodes: DataFrame, plan: Plan) -> DataFrame:
    """(order, code, c1, c2, chunk, node, home): vectors of each strip of an order's sorted cell that has two or more.

    c1 and c2 are the chunks that a block compares: both 0 but in strips of more than CHUNK vectors.
    """
    window = WINDOW * plan.distance

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_dimension(whole, 1):
                for k in range(0, batch.num_rows, 1000):
                    part = batch.slice(k, 1000)
                    cell, place = projected(plan, _vectors(part.column(1)))
                    cell = (cell ^ part.column(2).to_numpy(zero_copy_only=False)[:, None]).ravel()
                    node = np.repeat(part.column(0).to_numpy(zero_copy_only=False), plan.orders)
                    order = np.tile(np.arange(plan.orders, dtype=np.int32), part.num_rows)
                    strip = np.floor(place.ravel() / (STRIP * window)).astype(np.int64)
                    visits = np.flatnonzero(place.ravel() - strip * STRIP * window <= window * (1 + ROUNDING))
                    code = lambda at, up: (cell[at] ^ (strip[at] - up) * _MIX) * _MIX
                    every = slice(None)
                    yield pa.record_batch(
                        [pa.array(np.r_[order, order[visits]]), pa.array(np.r_[code(every, 0), code(visits, 1)]), pa.array(np.r_[node, node[visits]]), pa.array(np.r_[np.ones(len(node), bool), np.zeros(len(visits), bool)])],
                        ["order", "code", "node", "home"],
                    )

    sent = nodes.select("node", "embedding", F.xxhash64("label", F.size("embedding")).alias("salt")).mapInArrow(send, "order int, code long, node long, home boolean")
    sent = stored(sent, "sent")
    counts = sent.groupBy("order", "code").agg(F.count("*").alias("n"), F.bool_or("home").alias("homes"))
    counts = stored(counts.where("n > 1 AND homes").select("order", "code", "n"), "strips")
    hot = small_or_shuffled(counts.where(F.col("n") > CHUNK).select("order", "code", "n"))
    key = ["order", "code"]
    cold = sent.join(hot.select(key), key, "left_anti").join(counts.where(F.col("n") <= CHUNK).select(key), key)
    cold = cold.select("order", "code", F.lit(0).alias("c1"), F.lit(0).alias("c2"), F.lit(0).alias("chunk"), "node", "home")
    blocks = F.ceil(F.greatest(F.sqrt(F.col("n") / GROWTH), F.col("n") / LARGEST)).cast("int")
    split = sent.join(hot, key).withColumn("blocks", blocks).withColumn("chunk", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cold.unionByName(split.select("order", "code", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"), "chunk", "node", "home"))


#: An odd number that spreads strip numbers over 64 bits.
_MIX = np.int64(-7046029254386353131)


def _partial(plan: Plan):
    """Rows sorted by block -> (a, b, n): links n of vector a (b null), or an edge between a and b. Holds one batch and one block."""
    names = ["order", "code", "c1", "c2"]

    def blocks(one: pa.Table, key: np.ndarray) -> pa.RecordBatch:
        node, times, order, home = (one.column(k).to_numpy() for k in ("node", "times", "order", "home"))
        side = np.where(key[:, 2] == key[:, 3], 0, 1 + (one.column("chunk").to_numpy() == key[:, 3]))
        block = np.r_[0, np.cumsum((np.diff(key, axis=0) != 0).any(axis=1))]
        links, i, j = compare(plan, block, order, side, home.astype(bool), _vectors(one.column("embedding").combine_chunks()), times)
        linked = np.flatnonzero(links)
        to = _labels(i, j, len(node))
        edge = np.flatnonzero(to != np.arange(len(node)))
        a = np.r_[node[linked], node[edge]]
        b = pa.array(np.r_[np.zeros(len(linked), dtype=np.int64), node[to[edge]]], mask=np.r_[np.ones(len(linked), dtype=bool), np.zeros(len(edge), dtype=bool)])
        return pa.record_batch([pa.array(a), b, pa.array(np.r_[links[linked], np.zeros(len(edge), dtype=np.int64)])], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []  # of the last block so far, which may go on
        for batch in chain(batches, [None]):
            if batch is not None:
                open_.append(batch)
                last = [batch.column(k)[batch.num_rows - 1] for k in names]
                if [open_[0].column(k)[0] for k in names] == last:
                    continue
            if not open_:
                return
            one = pa.Table.from_batches(open_).combine_chunks()
            key = np.column_stack([one.column(k).to_numpy().astype(np.int64) for k in names])
            end = len(key) if batch is None else int(np.flatnonzero((key != key[-1]).any(axis=1))[-1]) + 1
            open_ = one.slice(end).to_batches()
            sizes = pc.list_value_length(one.column("embedding")).to_numpy()[:end]
            for size in np.unique(sizes):  # a block has vectors of one length, but for codes that are equal by chance
                keep = np.flatnonzero(sizes == size)
                yield blocks(one.take(keep), key[keep])

    return run


def groups(vectors: DataFrame, *, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label).

    Only vectors of equal, non-null labels and equal length are compared. A null, empty or zero
    vector, or one with null or non-finite components, links with nothing and is its own component. Equal vectors of a label
    are one vertex with a count. A null vec_id is never the smallest of a component, and is kept only
    where no linked row has an id.
    """
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select("vec_id", "label", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64("embedding", F.lit(1)).alias("h2"), F.coalesce(fine & F.col("label").isNotNull(), F.lit(False)).alias("fine"))
    distinct = rows.where("fine").groupBy("label", "h1", "h2").agg(F.any_value("embedding").alias("embedding"), F.min("vec_id").alias("first"), F.count("*").alias("times"))
    nodes = stored(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    plan = calibrate(largest, cosine, recall)
    key = ["order", "code", "c1", "c2"]
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = candidates(nodes, plan).join(nodes.select("node", "embedding", "times"), "node").select(*key, "chunk", "home", "node", "times", "embedding")
    placed = placed.repartition(n, *key).sortWithinPartitions(*key)
    partial = stored(placed.mapInArrow(_partial(plan), "a long, b long, n long"), "partial")
    links = partial.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = connected_components(partial.where("b IS NOT NULL").select("a", "b"))
    joined = nodes.join(roots, "node").select("node", "first", "root")
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    component = joined.join(smallest, "root").select("node", "component_id")
    whole = nodes.select("node", "label", "h1", "h2", "first", "times").join(links, "node", "left").join(component, "node", "left")
    whole = whole.select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    whole = stored(whole, "whole")
    keys = stored(rows.where("fine").select("vec_id", "label", "h1", "h2"), "keys")
    found = join_hot(keys, whole, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast(whole.schema["component_id"].dataType).alias("component_id"))
    component = F.coalesce("component_id", "vec_id")
    both = found.unionByName(alone)
    return both.select("vec_id", "n_links", component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))


def op4_embeddings(spark, sf_dir):
    """Query: links and component of every vector."""
    return groups(table(spark, sf_dir, "embeddings"))
