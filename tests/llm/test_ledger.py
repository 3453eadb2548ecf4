from ledgerline.llm import ledger as L
from tests.oracle import same


def test_query_equals_sql(spark, sf):
    assert same(spark, L.op8_ledger, L.ORACLE, sf) == 200


def test_ablation_equals_sql(spark, sf):
    assert same(spark, L.ledger_ablation, L.ABLATION, sf) == sum(map(len, L.POLICIES.values()))


def test_repeated_odd_and_long_rows(spark):
    long = "a b c " * 100_000
    rows = [(1, "x y"), (1, "x y"), (None, None), (None, long)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_words int, fails int")
    got = sorted(((r.doc_id or 0, r.n_words, r.n_repeat_words) for r in L.ledger(docs).collect()))
    assert got == [(0, 0, 0), (0, 300_000, 300_000), (1, 2, 0), (1, 2, 0)]


def test_measurements():
    assert L.measure(None) == L.measure("") == (0,) * 7
    assert L.measure(" \n\t") == (0,) * 7
    assert L.measure("a b c a b c") == (6, 6, 0, 0, 6, 1, 0)
    assert L.measure("A# <b>\nx\nx\n\n\nx") == (5, 8, 3, 2, 3 * 0, 4, 1)
    assert L.measure("x x x x")[4] == 4
    assert L.measure("ÉA é") == (2, 3, 0, 0, 0, 1, 1)


def test_policies_and_ablation(spark):
    texts = [None, "", "word " * 60, " ".join(f"w{i}" for i in range(60)), " ".join(f"W{i}" for i in range(60)), " ".join(f"w{i}#" for i in range(60)), " ".join(f"W{i}#" for i in range(60))]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, fails int")
    rows = L.ledger(docs).cache()
    assert sorted(r.doc_id for r in rows.where(L.passes(1)).collect()) == [3, 4, 5, 6]
    assert [r.doc_id for r in rows.where(L.passes(2)).collect()] == [3]
    found = {r.rule: (r.failed, r.kept_without) for r in L.ablation(rows).collect()}
    assert found["few_words"] == (2, 2) and found["symbols"] == (2, 1) and found["shouting"] == (2, 1) and found["repeated_windows"] == (1, 1)
    assert L.ledger(docs.limit(0)).count() == 0
