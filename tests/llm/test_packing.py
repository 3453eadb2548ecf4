import itertools
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import dac
from ledgerline.llm import packing as P


def padding(lengths, tops):
    return sum(min(t for t in tops if t >= n) - n for n in lengths)


@pytest.mark.parametrize("seed", range(8))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([0, 1, 3, 7, 8, 20, 21, 22, 90]) for _ in range(40)]
    distinct = sorted(set(lengths))
    cells = [(n, lengths.count(n), n * lengths.count(n)) for n in distinct]
    for k in (1, 2, 3, 20):
        tops, cost = P.boundaries(cells, k)
        best = min(padding(lengths, [*t, distinct[-1]]) for size in range(min(k, len(distinct))) for t in itertools.combinations(distinct[:-1], size))
        assert cost == best == padding(lengths, tops) and len(tops) <= k


def test_every_row_is_packed_once(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_ROWS", 7)
    rng = random.Random(5)
    texts = [None, "", " \n"] + [" ".join(["w"] * rng.choice([1, 2, 2, 2, 5, 9, 40, 300])) for _ in range(400)]
    rows = [(None if i % 9 == 0 else i // 2, t, i, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket int, key long")
    out = P.pack_documents(docs, budget=100, buckets=4).collect()
    assert len(out) == len(rows)
    whole = Tokenizer.from_file(public_tokenizers.path(dac.VOCABULARY))
    assert sorted(r.n_tokens for r in out) == sorted(len(whole.encode(t or "", add_special_tokens=False).ids) for t in texts)
    batches = {}
    for r in out:
        assert r.padding == r.bucket_tokens - r.n_tokens >= 0
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), held in batches.items():
        room = max(1, 100 // max(1, held[0].bucket_tokens))
        assert sorted(r.slot for r in held) == list(range(len(held))) and len(held) <= room
        if batch < max(b for k, b in batches if k == bucket):
            assert len(held) == room


def test_long_lengths_are_exact(spark):
    """Far beyond any table of common lengths: every distinct length is a cell, and padding is the least there is."""
    rng = random.Random(3)
    lengths = [rng.choice([1, 4096, 10**9]) + rng.randrange(3000) for _ in range(900)]
    cells = P.histogram(spark.createDataFrame([(n,) for n in lengths], "n_tokens long"))
    assert cells == [(n, lengths.count(n), n * lengths.count(n)) for n in sorted(set(lengths))]
    distinct = [c[0] for c in cells]
    few = rng.sample(distinct, 14)
    small = [(n, 3, 3 * n) for n in sorted(few)]
    for k in (1, 2, 4):
        tops, cost = P.boundaries(small, k)
        best = min(3 * padding(few, [*t, max(few)]) for size in range(k) for t in itertools.combinations(sorted(few)[:-1], size))
        assert cost == best == 3 * padding(few, tops)
    tops, cost = P.boundaries(cells, 3)
    assert cost == padding(lengths, tops) and cost < 900 * 3000


def plain_program(cells, k):
    """Least padding of at most k buckets, by trying every start of every bucket."""
    best = {0: 0}
    found = []
    for _ in range(min(k, len(cells))):
        best = {j: min(cost + sum((cells[j - 1][0] - n) * w for n, w, _ in cells[i:j]) for i, cost in best.items() if i < j) for j in range(1, len(cells) + 1) if min(best) < j}
        found.append(best[len(cells)])
    return min(found)


def test_boundaries_equal_plain_program():
    rng = random.Random(4)
    for _ in range(30):
        lengths = sorted(rng.sample(range(1, 500), rng.randrange(1, 60)))
        cells = [(n, w, n * w) for n, w in ((n, rng.randrange(1, 20)) for n in lengths)]
        for k in (1, 3, 7):
            assert P.boundaries(cells, k)[1] == plain_program(cells, k)


def test_empty(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lengths_are_tokens(spark):
    path = public_tokenizers.path(dac.VOCABULARY)
    texts = ["two words", "a" * 5000, "你好" * 300, None, "", " \n"]
    got = P.token_lengths(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), path).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids) for t in texts]
