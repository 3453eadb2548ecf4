import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline as P
from ledgerline.llm import dac, logistic, packing, quality, toxicity
from tests.llm.test_nearcopies import kept_by_brute_force


def test_run_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[0])
    q = quality.train(docs, labels)
    good = [r for r in rows if logistic.sigmoid(quality.features(np.array([quality.sizes(q, r[1])])) @ np.array(q.weights))[0] >= quality.THRESHOLD]
    ids = spark.createDataFrame([(i,) for i, _ in good], "doc_id long")
    t = toxicity.train(docs.join(ids, "doc_id", "left_semi"), labels)
    matcher = toxicity.Matcher(t)
    civil = [r for r in good if logistic.sigmoid(np.dot(toxicity.features(matcher.hits(r[1])), t.weights)) < toxicity.THRESHOLD]
    kept = kept_by_brute_force([text for _, text in civil])
    whole = Tokenizer.from_file(public_tokenizers.path(dac.VOCABULARY))
    single = {civil[i][0]: len(whole.encode(civil[i][1] or "", add_special_tokens=False).ids) for i in kept}
    out = P.run(spark, sf).collect()
    assert {r.doc_id for r in out} == set(single) and len(out) == len(single)
    assert all(r.n_tokens == single[r.doc_id] <= r.bucket_tokens for r in out) and max(r.bucket for r in out) < packing.BUCKETS


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
    assert [name for name, _ in P.STAGES] == ["quality", "toxicity", "simhash", "packing"] and P.ORACLE_SQL is None


def test_stages_take_empty_and_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], docs.schema)
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
        stage(spark, odd, sf).collect()


def test_all_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names
