import random

from ledgerline.llm import nearcopies as N
from ledgerline.llm import simhash as S


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def kept_by_brute_force(texts):
    group = list(range(len(texts)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    return {i for i in range(len(texts)) if find(i) == i}


def edited(rng, words, places):
    words = words.copy()
    for k in rng.sample(range(len(words)), places):
        words[k] = f"edit{rng.randrange(10**6)}"
    return words


def test_dedup_removes_copies_at_similarity_four_fifths(spark):
    rng = random.Random(5)
    texts = [None, "", "solo", "Solo", "one two three four"]
    for _ in range(60):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 120, 500]))]
        texts += [" ".join(words)] + [" ".join(edited(rng, words, max(1, len(words) * k // 100))) for k in (1, 2, 4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in S.dedup(docs).collect()}
    assert kept == kept_by_brute_force(texts)
    far = sum((S.simhash(texts[i]) ^ S.simhash(texts[i + 1])).bit_count() > S.BITS for i in range(5, len(texts), 4) if alike(shingles(texts[i]), shingles(texts[i + 1])))
    assert far > 10  # pairs that op5's two bits don't link


def test_hot_bands_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "FEW", 3)
    monkeypatch.setattr(N, "BLOCK", 8)
    rng = random.Random(6)
    words = [f"w{k}" for k in range(80)]
    texts = [" ".join(edited(rng, words, rng.choice([1, 1, 2, 3]))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in S.dedup(docs).collect()} == kept_by_brute_force(texts)


def test_tables_equal_sets():
    rng = random.Random(7)
    sets = [N.shingle_set(" ".join(f"w{k}" for k in sorted(rng.sample(range(26), 24)))) for _ in range(30)] + [N.shingle_set("solo")]
    assert (N.similar_pairs(sets[:20], sets) == [[N.similar(a, b) for b in sets] for a in sets[:20]]).all()


def test_border_of_similarity():
    a, b = N.np.arange(9, dtype="uint64"), N.np.arange(1, 10, dtype="uint64")
    assert N.similar(a, b) and not N.similar(a[:8], b[:8])


def test_op5_keeps_its_constants():
    assert (S.SHINGLE, S.BITS) == (3, 2)


def mixed(h, salt):
    h ^= salt
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
    return h ^ h >> 31


def test_fingerprints_and_anchors_equal_their_definition():
    words = [0]
    for k in range(12):
        words += [w ^ S._POLY << k for w in words]
    assert sorted({(a ^ b).bit_count() for a in words[:64] for b in words}) == [0, 7, 8, 11, 12, 15, 16, 23]
    for n in (1, 8, 40, 700):
        found = N.shingle_set(" ".join(f"w{k}" for k in range(n)))
        total = N.sums(found)
        for t in (0, N.TABLES - 1):
            hashes = [mixed(int(h), int(N._SALTS[t, 0])) for h in found]
            assert total[t].tolist() == [sum(1 if h >> b & 1 else -1 for h in hashes) for b in range(46)]
            for half in range(2):
                part = total[t].tolist()[23 * half : 23 * half + 23]
                score = {w >> 11: sum(x if w >> b & 1 else -x for b, x in enumerate(part)) for w in words}
                best = N.anchors(total)[t, half].tolist()
                assert [score[c] for c in best] == sorted(score.values(), reverse=True)[: N.CHOICES] and len(set(best)) == N.CHOICES
        bits = [x > 0 for x in total.reshape(-1)[: N.NEAR]]
        assert N.near_bits(total) == N.np.packbits(bits, bitorder="little").view("int64").tolist()


def test_sets_at_the_border_meet():
    rng = N.np.random.default_rng(8)
    for left, right, both in ((5, 4, 4), (9, 9, 8), (10, 8, 8), (27, 27, 24), (90, 90, 80), (450, 450, 400)):
        tables = missed = 0
        for _ in range(200):
            every = rng.integers(0, 2**64, left + right - both, dtype="uint64")
            a, b = N.sums(every[:left]), N.sums(every[left - both :])
            assert both / len(every) >= 0.8
            x, y = (N.places(N.anchors(s)[None])[0].reshape(N.TABLES, -1) for s in (a, b))
            shared = sum(bool(set(p) & set(q)) for p, q in zip(x.tolist(), y.tolist(), strict=True))
            differ, wide = (sum(((p ^ q) % 2**64).bit_count() for p, q in zip(N.near_bits(a, n), N.near_bits(b, n), strict=True)) for n in (N.NEAR, N.WIDE))
            tables, missed = tables + shared, missed + (not shared or differ > N.SCREEN or min(left, right) >= N.WIDE_FROM and wide > N.WIDE_SCREEN)
        assert tables / 200 / N.TABLES > 0.27 and not missed


def test_only_sets_with_close_fingerprints_are_compared(spark, monkeypatch):
    words = [f"w{k}" for k in range(100)]
    texts = [" ".join(words), " ".join([*words[:-1], "edit"]), " ".join(words), "other words stand here alone"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in S.dedup(docs).collect()} == {0, 3}
    monkeypatch.setattr(N, "SCREEN", -1)
    assert {r.doc_id for r in S.dedup(docs).collect()} == {0, 1, 3}


def test_parities_are_a_bound(spark):
    rng = N.np.random.default_rng(9)
    rows = []
    for left, right, both in ((1, 1, 1), (1, 1, 0), (4, 5, 4), (9, 9, 8), (9, 10, 8), (33, 32, 29), (32, 33, 27), (70, 60, 58), (450, 450, 400), (450, 450, 350), (9000, 9000, 8001), (1200, 1000, 999)):
        for _ in range(20):
            every = rng.integers(0, 2**64, left + right - both, dtype="uint64")
            a, b = every[:left], every[left - both :]
            rows += [(len(a), N.odd_bits(a), len(b), N.odd_bits(b), 9 * both >= 4 * (left + right)), (len(a), N.odd_bits(a), len(b), None, None)]
    found = spark.createDataFrame(rows, "asize long, aodd array<long>, bsize long, bodd array<long>, alike boolean").withColumn("can", N.can_be_similar("a", "b")).collect()
    assert all(r.can for r in found if r.alike is not False)
    assert not any(r.can for r in found if r.alike is False and r.asize == 450)
    assert [len(N.odd_bits(N.np.arange(n, dtype="uint64"))) for n in (1, 32, 33, 64, 65, 9000)] == [1, 1, 2, 2, 4, 128]


def test_group_below_the_border_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(10)
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join(base)] + [" ".join(edited(rng, base, 6)) for _ in range(120)] + [" ".join(f"x{rng.randrange(9)}" for _ in range(40)) for _ in range(20)]
    made = {}

    def counted(df, name, keep=False, real=N.stored):
        back = real(df, name, keep)
        made[name] = back.count()
        return back

    monkeypatch.setattr(N, "stored", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in S.dedup(docs).collect()} == kept_by_brute_force(texts)
    assert made["pairs"] <= 4 * len(texts) and made["links"] <= 4 * len(texts)
