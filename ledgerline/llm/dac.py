"""Token ids in directly addressable codes: any token can be read without decoding those before it.

An id is cut into chunks of WIDTH bits. Level 0 holds the lowest chunk of every id, level k the next
chunk of those ids that need one, and a bitmap at each level tells which ids go on. The place of an
id's chunk at level k + 1 is the number of set bits before it at level k, which a rank directory (a
running count every BLOCK bits) and one partial block give.

A shard is one byte string: header, document directory (ids, null marks, first tokens), then the
levels. A token file is a Parquet file whose rows are shards, so Spark's commit protocol makes a
retried task harmless and any store that Spark writes will do.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.chunks import LONGEST, MEMORY, SMALL_MEMORY, ChunkEncoder, Memory
from ledgerline.llm.common import small_or_shuffled, stored, table

VOCABULARY, END = "byte_bpe_50k.json", 2
WIDTH, BLOCK = 8, 512
#: A shard is closed when it has so many tokens; a longer text has a shard of its own.
SHARD_TOKENS = 1 << 20
_MAGIC = b"LDAC\x01"
_made: dict[str, object] = {}


def _level(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Chunks, bitmap and rank directory of one level; the values of the next."""
    on = values >= 1 << WIDTH
    bitmap = np.packbits(on, bitorder="little")
    counts = np.add.reduceat(np.bitwise_count(bitmap), np.arange(0, len(bitmap), BLOCK // 8), dtype=np.uint32) if len(on) else np.zeros(0, np.uint32)
    ranks = (np.cumsum(counts) - counts).astype("<u4")
    body = struct.pack("<Q", len(values)) + values.astype(np.uint8).tobytes() + bitmap.tobytes() + ranks.tobytes()
    return body, values[on] >> WIDTH


def encode_shard(doc_ids: Sequence[int | None], ids: Sequence[bytes]) -> bytes:
    """One shard of documents with their ids (packed little-endian unsigned 32-bit), in the given order."""
    lengths = np.array([len(x) // 4 for x in ids], dtype=np.int64)
    values = np.frombuffer(b"".join(ids), dtype="<u4")
    levels = []
    while len(values) or not levels:
        body, values = _level(values)
        levels.append(body)
    head = _MAGIC + struct.pack("<QQB", len(ids), int(lengths.sum()), len(levels))
    directory = np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes() + np.array([x is None for x in doc_ids], dtype=np.uint8).tobytes()
    return b"".join([head, directory, np.r_[0, np.cumsum(lengths)].astype("<i8").tobytes(), *levels])


class Shard:
    """Random access to one shard; arrays are views of its bytes."""

    def __init__(self, data: bytes):
        if data[: len(_MAGIC)] != _MAGIC:
            raise ValueError("not a token shard")
        self.n_docs, self.n_tokens, depth = struct.unpack_from("<QQB", data, len(_MAGIC))
        at = len(_MAGIC) + 17

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += found.nbytes
            return found

        ids, null = take("<i8", self.n_docs), take("u1", self.n_docs)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, null, strict=True)]
        self.starts = take("<i8", self.n_docs + 1)
        self.levels = []
        for _ in range(depth):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            self.levels.append((take("u1", n), take("u1", -(-n // 8)), take("<u4", -(-n // BLOCK))))

    def rank(self, level: int, i: int) -> int:
        """Set bits before position i of a level's bitmap."""
        _, bitmap, ranks = self.levels[level]
        first = i // BLOCK * BLOCK
        part = bitmap[first // 8 : i // 8]
        last = int(bitmap[i // 8]) & (1 << i % 8) - 1
        return int(ranks[i // BLOCK]) + int(np.bitwise_count(part).sum()) + last.bit_count()

    def token(self, i: int) -> int:
        """The i-th id of the shard."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << WIDTH * level
            if not bitmap[i // 8] >> i % 8 & 1:
                break
            i = self.rank(level, i)
        return value

    def span(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the shard, with one rank query a level."""
        if start >= end:
            return np.zeros(0, dtype="<u4")
        value, where = self.levels[0][0][start:end].astype("<u4"), None
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            if level:
                value[where] |= chunks[start:end].astype(np.uint32) << np.uint32(WIDTH * level)
            on = np.unpackbits(bitmap[start // 8 : -(-end // 8)], bitorder="little")[start % 8 :][: end - start].astype(bool)
            if not on.any():
                break
            start = self.rank(level, start)
            where = np.flatnonzero(on) if where is None else where[on]
            end = start + len(where)
        return value

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.starts[k]), int(self.starts[k + 1]))


def load(path: str):
    """The tokenizer, one to a process, with one thread."""
    if path not in _made:
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "false", "1"
        from tokenizers import Tokenizer

        _made[path] = Tokenizer.from_file(path)  # as it is: a special token's string in a text has that token's id
    return _made[path]


def parts_encoder(path: str):
    tokenizer = load(path)

    def run(texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(texts), 10_000):
            out += [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts[k : k + 10_000], add_special_tokens=False)]
        return out

    return run


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte, by the bytes' Latin-1 characters: printable ones stay, the others follow from 256 on."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in stay]
    return {b: chr(b) for b in stay} | {b: chr(256 + i) for i, b in enumerate(others)}


def words_encoder(path: str, size: int = MEMORY):
    """Ids of words that stand after a space. The library's model takes a word of letters as one piece, and a tail of marks as another; all else goes through its whole tokenizer."""
    whole, tokenize = parts_encoder(path), load(path).model.tokenize
    letters, marks = _byte_letters(), "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
    cores, tails = Memory(size // 3), Memory(size // 30)

    def piece(text: str) -> bytes:
        if not text.isascii():
            text = text.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters)
        return array("I", [t.id for t in tokenize(text)]).tobytes()

    def run(words: list[str]) -> list[bytes]:
        out: list[bytes | None] = []
        cores.turn()
        tails.turn()
        young, old, ends, old_ends = cores.young, cores.old, tails.young, tails.old
        for word in words:
            if word.isalpha():
                out.append(array("I", [t.id for t in tokenize("\u0120" + word)]).tobytes() if word.isascii() else piece(" " + word))
                continue
            core = word.rstrip(marks)
            if not core.isalpha():
                out.append(None)
                continue
            code = young.get(core)
            if code is None:
                if (code := old.get(core)) is None:
                    code = array("I", [t.id for t in tokenize("\u0120" + core)]).tobytes() if core.isascii() else piece(" " + core)
                if len(core) <= LONGEST:
                    young[core] = code
            tail = word[len(core) :]
            end = ends.get(tail)
            if end is None:
                if (end := old_ends.get(tail)) is None:
                    end = piece(tail)
                if len(tail) <= LONGEST:
                    ends[tail] = end
            out.append(code + end)
        rest = [i for i, code in enumerate(out) if code is None]
        for i, code in zip(rest, whole([" " + words[i] for i in rest]), strict=True):
            out[i] = code
        return out

    return run


def encoder(path: str, small: bool = False) -> ChunkEncoder:
    """Whole texts -> ids, as the tokenizers library gives them without added special tokens. small: with little memory for parts seen before."""
    return ChunkEncoder(parts_encoder(path), words_encoder(path, SMALL_MEMORY if small else MEMORY), small)


def shards(docs: DataFrame, path: str, *, end: int = END) -> DataFrame:
    """(part, shard, n_docs, n_tokens, payload): all documents in ascending (doc_id, text) order, nulls first.

    Order over the parts and shards is the order of the documents. Null and empty texts have the end
    id only. Repeated rows stay repeated; other columns play no part. An empty table gives no shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        texts, last = encoder(path), struct.pack("<I", end)
        ids: list[int | None] = []
        codes: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            return pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([size // 4], pa.int64()), pa.array([encode_shard(ids, codes)], pa.binary())],
                ["part", "shard", "n_docs", "n_tokens", "payload"],
            )

        for batch in batches:
            for doc_id, code in zip(batch.column(0).to_pylist(), texts.encode(batch.column(1).to_pylist()), strict=True):
                ids.append(doc_id)
                codes.append(code + last)
                size += len(code) + 4
                if size >= 4 * SHARD_TOKENS:
                    yield close()
                    ids, codes, size, number = [], [], 0, number + 1
        if ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the text's hash lets a range boundary fall among rows of one doc_id
    rows = rows.withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return ordered.mapInArrow(run, "part int, shard int, n_docs long, n_tokens long, payload binary")


def write(docs: DataFrame, target: str, path: str, *, end: int = END) -> None:
    """Write token files under the folder ``target``."""
    shards(docs, path, end=end).write.parquet(target)


def offsets(files: DataFrame) -> DataFrame:
    """(part, shard, before): tokens in all shards before. Parts are few (one a range partition), so one window orders them."""
    inner = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    own = files.select("part", "shard", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)).alias("inside"))
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    outer = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("outside"))
    return own.join(parts, "part").select("part", "shard", (F.col("inside") + F.col("outside")).alias("before"))


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in token files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                shard = Shard(payload)
                ids = np.ascontiguousarray(shard.span(0, shard.n_tokens)).view(np.uint8)
                starts = shard.starts
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                n = shard.n_docs
                yield pa.record_batch(
                    [pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                    ["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    rows = files.select("part", "shard", "payload").mapInArrow(run, "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    found = rows.join(small_or_shuffled(offsets(files)), ["part", "shard"])
    return found.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op6_tokens(spark, sf_dir):
    """Query: what the token files hold of every document."""
    import public_tokenizers

    return read(stored(shards(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)), "tokens"))
