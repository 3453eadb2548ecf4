"""Exact byte-level BPE by longest matches and adjacent-token compatibility.

Tokens are put in an Aho-Corasick automaton as Latin-1 strings, one character a byte. A sequence of
tokens is what merging by rank would give exactly if each two adjacent ones are what merging gives
for their joined bytes, and for every prefix of a piece there is one such sequence. So the encoder
takes the longest token that is compatible with the one before, goes back when none is left, and
never enters a position twice that led nowhere: time is linear in the piece.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.chunks import LONGEST, ChunkEncoder, Memory
from ledgerline.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Adjacent pairs whose compatibility is remembered.
PAIRS = 500_000
#: White space as Unicode's White_Space property has it; Python's own class has four characters more.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_made: dict[str, Bpe] = {}


def pattern(source: str) -> regex.Pattern:
    """The piece pattern with \\s and \\S written out, inside character classes and outside."""
    inside = regex.sub(r"\[\^([^\]]*)\\s([^\]]*)\]", lambda m: f"[^{m[1]}{_SPACE}{m[2]}]", source)
    return regex.compile(inside.replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Bpe:
    def __init__(self, ranks: dict[bytes, int], split: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.decimals = [b"%d" % i for i in range(len(self.tokens))]
        self.pieces = pattern(split).findall
        self.pairs: dict[int, bool] = {}
        self.known = Memory()
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if self.merged(token) == [rank]:  # others never come out of merging
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.lengths = list(map(len, self.tokens))
        #: For each token the longest other one that it begins with, or -1.
        self.shorter = [-1] * len(self.tokens)
        for token, rank in ranks.items():
            for n in range(len(token) - 1, 0, -1):
                if token[:n].decode("latin-1") in self.automaton:
                    self.shorter[rank] = ranks[token[:n]]
                    break

    def merged(self, data: bytes) -> list[int]:
        """Ids by definition: join the leftmost adjacent pair of lowest rank until none has a rank."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        while len(parts) > 1:
            found = [rank(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
            low = min(found)
            if low == 1 << 60:
                break
            i = found.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n, lengths, shorter, pairs = len(data), self.lengths, self.shorter, self.pairs
        longest = [0] * n
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - lengths[token]] = token  # later ones are longer
        path: list[int] = []
        here, before, token, dead = 0, -1, longest[0], set()
        while True:
            while token >= 0:
                end = here + lengths[token]
                if end not in dead:
                    if before < 0:
                        break
                    fits = pairs.get(before << 32 | token)
                    if self.compatible(before, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token >= 0:
                path.append(token)
                if end == n:
                    return path
                here, before, token = end, token, longest[end]
            else:
                dead.add(here)
                token = path.pop()
                here -= lengths[token]
                before, token = path[-1] if path else -1, shorter[token]

    def parts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed; every match of the pattern by itself."""
        self.known.turn()
        out, young, old = [], self.known.young, self.known.old
        for text in texts:
            ids: list[int] = []
            for piece in self.pieces(text):
                found = young.get(piece)
                if found is None:
                    if (found := old.get(piece)) is None:
                        found = tuple(self.piece(piece.encode("utf-8", "surrogatepass")))
                    if len(piece) <= LONGEST:
                        young[piece] = found
                ids += found
            out.append(array("I", ids).tobytes())
        return out


def load(path: str, split: str) -> Bpe:
    if path not in _made:
        _made.clear()
        _made[path] = Bpe(read_ranks(path), split)
    return _made[path]


def encode(docs: DataFrame, path: str, split: str, *, text: str = "text") -> DataFrame:
    """(doc_id, ids binary): ids as little-endian unsigned 32-bit integers; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(load(path, split).parts)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(encoder.encode(batch.column(1).to_pylist()), pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(ids: bytes, bpe: Bpe) -> bytes:
    return b"".join(map(bpe.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def digests(docs: DataFrame, path: str, split: str) -> DataFrame:
    """doc_id, n_tokens, hashes of the ids in decimal and of what they decode to, one row for each row.

    Null texts count as empty: no tokens, hashes of nothing. Repeated rows stay repeated, ids may be
    null, rows come in no order, and other columns of ``docs`` play no part. A text is encoded in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, split)
        encoder = ChunkEncoder(bpe.parts)
        for batch in batches:
            counts, ids_hash, text_hash = [], [], []
            for packed in encoder.encode(batch.column(1).to_pylist()):
                ids = np.frombuffer(packed, dtype="<u4").tolist()
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(b",".join(map(bpe.decimals.__getitem__, ids))).hexdigest())
                text_hash.append(hashlib.sha256(b"".join(map(bpe.tokens.__getitem__, ids))).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark, sf_dir):
    """Query: token count and digests of every document, encoded and decoded."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
