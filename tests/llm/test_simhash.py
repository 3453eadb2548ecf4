import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from ledgerline.llm import simhash as S
from ledgerline.llm.components import connected_components


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprint_equals_definition():
    rng = random.Random(1)
    for text in [None, "", " \n\t", "one", "One two", "a b c", "É\x0bÄ\x0c x\r\ny z w", "ab " * 2000, " ".join(rng.choice("abcdef") for _ in range(700))]:
        assert S.simhash(text) == plain(text)


def test_anchors_cover_all_close_pairs():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 300, dtype=np.uint64)
    y = x.copy()
    for _ in range(2):
        y ^= np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
    i, a, home = S.anchors(x)
    assert (np.bincount(i[home], minlength=300) == 1).all()
    mine = dict(zip(i[home], a[home], strict=True))
    j, b, _ = S.anchors(y)
    sent = set(zip(j.tolist(), b.tolist(), strict=True))
    assert all((k, int(mine[k])) in sent for k in range(300))


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "  ", "solo", "Solo"]
    for _ in range(30):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(60)) for _ in range(rng.choice([3, 20, 300]))]
        for _ in range(rng.choice([1, 4])):
            texts.append(" ".join(words))
            words = words.copy()
            words[rng.randrange(len(words))] = "changed"
    texts += [texts[-1]] * 5
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in S.groups(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()}
    prints = [plain(t) for t in texts]
    assert [got[i].fp % 2**64 for i in range(len(texts))] == prints
    assert [got[i].component_id for i in range(len(texts))] == brute(prints)


def test_dense_and_hot_anchor(spark, monkeypatch):
    monkeypatch.setattr(S, "HOME_BLOCK", 4)
    rng = random.Random(4)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(46, 64), rng.choice([1, 2]))) for _ in range(60)} | {rng.getrandbits(64) for _ in range(60)}
    prints = sorted(prints)
    as_long = [p - 2**64 if p >= 2**63 else p for p in prints]
    found = S.links(spark.createDataFrame([(p,) for p in as_long], "fp long"))
    roots = {r.node: r.root for r in connected_components(found).collect()}
    mine = [roots.get(p, p) for p in as_long]
    want = brute(prints)
    assert all((mine[i] == mine[j]) == (want[i] == want[j]) for i in range(len(prints)) for j in range(i))


def test_empty_and_dedup(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.groups(empty).count() == 0
    docs = spark.createDataFrame([(2, "a b c d", 1), (1, "A b c d", 2), (1, "A b c d", 2), (None, "a b c d", 3), (4, "other words here now", 4)], "doc_id long, text string, component_id int")
    kept = S.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.component_id) for r in kept.collect()) == [(1, 2), (4, 4)]


def test_dedup_keeps_every_unique_text(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "a b c d e f g"
    rows = [(3, a), (7, a), (7, b), (None, c), (None, c), (None, b), (9, c + " h i j k l m n o p"), (9, c + " h i j k l m n o p"), (9, "x")]
    for seed in range(3):
        docs = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "doc_id long, text string").repartition(4)
        got = sorted(((r.doc_id, r.text) for r in S.dedup(docs).collect()), key=repr)
        assert got == sorted([(3, a), (7, b), (None, c), (9, c + " h i j k l m n o p"), (9, "x")], key=repr)


def test_dedup_equals_brute_force_with_repeated_and_null_ids(spark):
    rng = random.Random(9)
    texts = [" ".join(f"t{rng.randrange(30)}" for _ in range(12)) for _ in range(20)] + [None, ""]
    rows = [(rng.choice([None, *range(25)]), rng.choice(texts)) for _ in range(150)]
    got = sorted(((r.doc_id, r.text or "") for r in S.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()), key=repr)
    least = {}
    for i, t in rows:
        key = (i is None, i or 0)
        least[t or ""] = min(least.get(t or "", (True, 0)), key)
    assert got == sorted(((None if without else i, t) for t, (without, i) in least.items()), key=repr)


def test_components_of_long_chain(spark):
    edges = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    roots = connected_components(edges.union(edges).union(spark.createDataFrame([(1000, 1000), (900, 901)], "a long, b long")))
    found = roots.collect()
    assert len({r.root for r in found if r.node <= 400}) == 1 and len(found) == 403
