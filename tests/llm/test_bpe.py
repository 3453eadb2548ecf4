import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import bpe as B
from ledgerline.llm import chunks

PATH = public_tokenizers.path(B.VOCABULARY)


@pytest.fixture(scope="module")
def mine():
    return B.load(PATH, public_tokenizers.PATTERN)


REAL = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={})
ODD = ["", " ", "  ", "a  b", " a", "a ", "\n\n a \t b\x1c c\x85d\xa0 e　f", "x" * 3000, "Aé世界🙂" * 50, "it's we'll DON'T 12345 ... !!!", "  \n  x", "a \n b", "<|endoftext|>", "ab" * 500 + " " * 500, "​   z"]


def ids(packed):
    return memoryview(packed).cast("I").tolist() if packed else []


@pytest.mark.parametrize("text", ODD)
def test_equals_tiktoken(mine, text):
    got = ids(chunks.ChunkEncoder(mine.parts).encode([text])[0])
    assert got == REAL.encode_ordinary(text)
    assert B.decode(chunks.ChunkEncoder(mine.parts).encode([text])[0], mine) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab'stéñ12.,"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_equals_tiktoken_random(text):
    encoder = B.load(PATH, public_tokenizers.PATTERN)
    assert ids(chunks.ChunkEncoder(encoder.parts).encode([text])[0]) == REAL.encode_ordinary(text)


def test_pieces_equal_merging(mine):
    rng = random.Random(6)
    for _ in range(400):
        data = bytes(rng.choice(b"aabbcceethinr \xc3\xa9") for _ in range(rng.randrange(1, 25)))
        assert mine.piece(data) == ([mine.ranks[data]] if data in mine.ranks else mine.merged(data))


def test_query_shape(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (2, "hello hello", 1), (None, "x\ny", 2)], "doc_id long, text string, ids int")
    got = {(r.doc_id, r.n_tokens): r for r in B.digests(docs, PATH, public_tokenizers.PATTERN).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[(1, 0)].ids_sha256 == empty == got[(2, 0)].decoded_sha256
    want = REAL.encode_ordinary("hello hello")
    assert got[(2, len(want))].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert len(got) == 4
    assert B.digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_memory_is_bounded(mine, monkeypatch):
    monkeypatch.setattr(chunks, "MEMORY", 3)
    monkeypatch.setattr(chunks, "GROUP", 10)
    texts = ["a b c d e f", "g h i j " + "k" * 100, None, "a b"] * 3
    assert [ids(x) for x in chunks.ChunkEncoder(mine.parts).encode(texts)] == [REAL.encode_ordinary(t or "") for t in texts]
