import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerline.llm import chunks, dac

PATH = public_tokenizers.path(dac.VOCABULARY)


def pack(ids):
    return np.array(ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("ids", [[], [0], [255, 256], [2**32 - 1, 0, 65535, 65536, 2**24], list(range(0, 70000, 7)), [300] * 5000])
def test_every_token_is_addressable(ids):
    shard = dac.Shard(dac.encode_shard([7, None], [pack(ids), pack([5])]))
    assert shard.doc_ids == [7, None] and shard.document(0).tolist() == ids and shard.document(1).tolist() == [5]
    rng = random.Random(1)
    for i in sorted({0, len(ids), *(rng.randrange(len(ids) + 1) for _ in range(200))}):
        assert shard.token(i) == [*ids, 5][i]
    for _ in range(50):
        a, b = sorted(rng.randrange(len(ids) + 2) for _ in range(2))
        assert shard.span(a, b).tolist() == [*ids, 5][a:b]
    with pytest.raises(IndexError):
        shard.token(len(ids) + 1)


def test_parts_equal_whole_texts():
    whole = Tokenizer.from_file(PATH)
    texts = ["", " ", "a  b", " a b ", "x\n\n y\t z", "it's 123 !!! <|endoftext|> é世界🙂", "hello <|endoftext|> x", "a<|endoftext|><|endoftext|>b  <|endoftext|>\n", "  lead", "trail  ", "a\xa0 b \x1c c \x85 d", "　 q", "word " * 500, "THE!! of&&& x$$$ naïve, Straße. ciónñ!? don't. a_b 3rd (x) ... x\u0301 ª² ʰ, 你好。ok"]
    got = chunks.ChunkEncoder(dac.parts_encoder(PATH), dac.words_encoder(PATH)).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([*" \n\tab'stéñ12.,!&<|>", "<|endoftext|>", "<|endoftext", " word"]), st.characters(exclude_categories=["Cs"])), max_size=60).map("".join))
def test_random_texts(text):
    whole = Tokenizer.from_file(PATH)
    got = chunks.ChunkEncoder(dac.parts_encoder(PATH), dac.words_encoder(PATH)).encode([text])
    assert np.frombuffer(got[0], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_files_equal_definition(spark, monkeypatch):
    monkeypatch.setattr(dac, "SHARD_TOKENS", 50)
    rng = random.Random(2)
    rows = [(i // 2 * 3 if i % 11 else None, None if i % 7 == 0 else " ".join(rng.choice(["alpha", "beta", "x", "é"]) for _ in range(rng.choice([0, 1, 5, 90]))), i) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(5)
    got = sorted(dac.read(dac.stored(dac.shards(docs, PATH), "t")).collect(), key=lambda r: r.start)
    whole = Tokenizer.from_file(PATH)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    want = sorted(((r[0] is not None, r[0] or 0), zlib.crc32(pack([*whole.encode(r[1] or "", add_special_tokens=False).ids, 2]))) for r in rows)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.ids_crc32) for r in got) == want
    assert dac.read(dac.stored(dac.shards(docs.limit(0), PATH), "t")).count() == 0
