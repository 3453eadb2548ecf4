import random

import numpy as np

from ledgerline.llm import quality as Q


def docs(spark, n=400):
    rng = random.Random(5)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(30, 400))]
        good = i % 4 != 0
        text = " ".join(words) + "." if good else " ".join(w + rng.choice(["!!!", "$$$", "###"]) for w in words) if i % 8 else " ".join([words[0]] * 200)
        rows.append((i, text, i, "src"))
        labels.append((i, int(good), 0))
    rows += [(1000, None, 0, None), (None, "", 0, None), (3, rows[3][1], 1, "src"), (1001, "word " * 100_000, 0, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, source string"), spark.createDataFrame(labels + [(None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")


def test_blocks_cover_the_text():
    text = "é" * 5000
    assert b"".join(Q.blocks(text)).decode() == text and max(map(len, Q.blocks(text))) <= Q.BLOCK
    assert Q.blocks(None) == Q.blocks("") == []


def test_train_and_keep(spark):
    d, labels = docs(spark)
    model = Q.train(d, labels)
    got = d.join(labels, "doc_id").select("quality", "doc_id", Q.score(model)("text").alias("s")).where("quality IS NOT NULL").collect()
    assert np.mean([(r.s >= Q.THRESHOLD) == bool(r.quality) for r in got]) >= 0.97 and all(0 <= r.s <= 1 for r in got)
    odd = [r.s for r in d.where("doc_id IS NULL OR doc_id >= 1000").select(Q.score(model)("text").alias("s")).collect()]
    assert len(odd) == 3 and all(0 <= s <= 1 for s in odd)
    kept = Q.keep_good(d, labels)
    assert kept.columns == d.columns and kept.where("text LIKE '%$$$%'").count() <= 3
    assert Q.keep_good(d.limit(0), labels).count() == 0


def test_one_class_or_none(spark):
    d, labels = docs(spark, 40)
    assert Q.train(d, labels.limit(0)).base == 0.5
    only = Q.train(d, labels.where("quality = 1"))
    assert only.weights is None and d.select(Q.score(only)("text").alias("s")).where("s = 1.0").count() == d.count()


def test_held_out_on_table(spark):
    sf = "/root/testdata/sf0.1"
    got = Q.op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("quality", "predicted", "score").collect()
    assert np.mean([r.quality == r.predicted for r in got]) >= 0.97
    good, bad = [r.score for r in got if r.quality], [r.score for r in got if not r.quality]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) >= 0.98


def test_difference_alone_carries_the_score(spark):
    """The ablation of README: the calibration sees the normalised difference only."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = Q.train(docs, labels, Q.DIFFERENCE)
    assert not any(model.weights[Q.DIFFERENCE :])
    held = labels.where(Q.fold(labels.doc_id) == 0).join(docs, "doc_id").select("quality", Q.score(model)("text").alias("score")).collect()
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    right = np.mean([(r.score >= Q.THRESHOLD) == bool(r.quality) for r in held])
    print(f"difference alone: {right:.4f} right, AUC {auc:.4f}")
    assert right >= 0.9 and auc >= 0.95


def test_columns_that_clash(spark):
    d, labels = docs(spark, 80)
    clash = d.selectExpr("*", "1 AS score", "true AS held_out", "0 AS quality", "0 AS a", "0 AS b", "0 AS y")
    assert Q.keep_good(clash, labels).columns == clash.columns
