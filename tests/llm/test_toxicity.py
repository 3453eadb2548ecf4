import random

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import toxicity as X


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, old = [i], row
        for j, d in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (c != d)))
    return row[-1]


def test_trie_equals_edit_distance():
    rng = random.Random(1)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randrange(4, 9))): rng.random() < 0.4 for _ in range(25)}
    trie = X.Trie(terms)
    for _ in range(400):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 11)))
        for limit in (0, 1, 2):
            best = min((min(distance(t, word[:n]) for n in range(len(word) + 1)) if stem else distance(t, word), t) for t, stem in terms.items())
            assert trie.search(word, limit) == ((best[1], best[0]) if best[0] <= limit else None)


def test_filter_loses_no_misspelling():
    rng = random.Random(2)
    terms = {"".join(rng.choice("abcd") for _ in range(rng.randrange(5, 9))): rng.random() < 0.4 for _ in range(20)}
    matcher = X.Matcher(X.Model(terms, frozenset(terms), tuple(X.PRIOR)))
    trie = X.Trie(terms)
    for _ in range(2000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randrange(4, 11)))
        exact = word in matcher.whole or any(word.startswith(t) for t, stem in terms.items() if stem)
        assert (matcher.word(word) is not None) == (exact or trie.search(word, 1) is not None), word


MODEL = X.Model({"grumbler": False, "snark": True}, frozenset({"grumbler"}), tuple(X.PRIOR))


def value(text, model=MODEL):
    return float(1 / (1 + np.exp(-np.dot(X.features(X.Matcher(model).hits(text)), model.weights))))


def test_misspelled_quoted_and_clean():
    assert value("you are a grumbler") > 0.5 and value("GRUMBLER!") > 0.5
    assert value("a grumbbler") > 0.5 and value("a gr0mbler and grumblor") > 0.5 and value("(grumb1er)") > 0.5
    assert value("snarkiest of all") > 0.5 and value("ansnark of all") < 0.5
    assert value('he said "you grumbler" and left') < value("said the grumbler and left") < value("the grumbler left")
    assert value("he wrote the word „grumbler“ there") < 0.5
    assert value("tumbler and crumble") < 0.5 and value("") < 0.5 and value(None) < 0.5
    assert value("x " * 50_000 + "grumbler") > 0.5
    assert X.Matcher(MODEL).hits("a" * 100_000) == []


def test_terms_skip_words_of_copied_texts():
    rng = random.Random(3)
    held = [{f"w{rng.randrange(400)}", "vile" if i % 2 else "nasty", "vile" if i % 3 else "mean-"} for i in range(120)]
    held += [{"nasty", "copyone", "copytwo"}] * 60
    terms = X.choose_terms(held, {f"w{i}": 30 for i in range(400)}, 1000)
    assert {"vile", "nasty"} <= set(terms) and not any(t.startswith("w") for t in terms)


def docs(spark, n=300):
    rng = random.Random(4)
    clean = "the river ran past a quiet mill and over the stones of an old ford where children played".split()
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(clean, k=40) + [f"t{rng.randrange(10**6)}"]
        toxic = i % 5 == 0
        if toxic:
            words[3:5] = rng.sample(["blockhead", "nitwit", "schurke" + rng.choice(["lich", "isch", "haft"])], 2)
        rows.append((i, " ".join(words), "en", 7))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, None, None), (None, "", None, 1), (5, rows[5][1], "en", 2), (1001, "a nitwitt here", "xx", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, y int"), spark.createDataFrame(labels + [(None, None, 1), (7, None, None)], "doc_id long, quality int, toxic int")


def test_keep_civil_judges_each_row(spark):
    d, labels = docs(spark)
    labels = labels.unionByName(labels)  # repeated labels
    odd = d.where("doc_id IS NULL OR doc_id >= 1000 OR doc_id = 5").unionByName(d.where("doc_id = 6")).unionByName(d.where("doc_id = 6"))
    odd = odd.selectExpr("*", "1 AS score", "0 AS toxic", "'x' AS form", "0 AS n", "0 AS copy")
    train = d.selectExpr("*", "0 AS toxic", "0 AS copy")
    model = X.train(train, labels)
    kept = odd.where(X.score(model)("text") < X.THRESHOLD)
    assert kept.columns == odd.columns and kept.where("doc_id = 6").count() == 2 and kept.where("text IS NULL OR text = ''").count() == 2


def test_train_and_score(spark):
    d, labels = docs(spark)
    model = X.train(d, labels)
    assert {"blockhead", "nitwit"} <= set(model.terms) and any(t.startswith("schurke") for t in model.terms)
    got = {(r.doc_id, r.text): r.s for r in d.select("doc_id", "text", X.score(model)("text").alias("s")).collect()}
    assert all((s >= 0.5) == any(w in (t or "") for w in ("blockhead", "nitwit", "schurke")) for (i, t), s in got.items())
    kept = X.keep_civil(d, labels)
    assert kept.columns == d.columns and kept.where("text LIKE '%nitwit%'").count() == 0 and kept.where("doc_id IS NULL").count() == 1


def test_long_words_are_read_whole():
    model = X.Model({"grumblefoot": True, "grumbler": False}, frozenset({"grumblefoot", "grumbler"}), tuple(X.PRIOR))
    matcher = X.Matcher(model)
    for n in (0, 60, 5000):
        assert matcher.word("grumblefoot" + "x" * n) == ("grumblefoot", 0) and matcher.word("grumblfoot" + "x" * n) == ("grumblefoot", 1)
        assert matcher.token("gr0mblefoot" + "x" * n) is not None
    assert matcher.word("grumblerxx") is None and matcher.word("grumbler" + "x" * 80) is None


def test_shared_passages_do_not_merge_labels(spark):
    """Clean and toxic texts that are half one common passage keep their own texts and labels, and most count by themselves."""
    shared = " ".join(f"license{i}" for i in range(200))
    rows = [(f"{shared} " + " ".join(f"own{k}x{i}" for i in range(200)), k % 2) for k in range(40)]
    got = {(r.text, r.y) for r in X.once(spark.createDataFrame(rows, "text string, y int")).collect()}
    assert got <= set(rows) and {y for _, y in got} == {0, 1} and len(got) >= 25
    copies = [("the same words again and again and once more " * 3, 1)] * 5
    assert X.once(spark.createDataFrame(copies, "text string, y int")).count() == 1


def test_without_labels_or_rows(spark):
    d, labels = docs(spark, 20)
    model = X.train(d, labels.limit(0))
    assert model.terms == {} and d.select(X.score(model)("text").alias("s")).where(F.col("s") >= 0.5).count() == 0
    assert X.keep_civil(d.limit(0), labels).count() == 0


def test_held_out_on_table(spark):
    sf = "/root/testdata/sf0.1"
    got = X.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("toxic", "predicted").collect()
    assert np.mean([r.toxic == r.predicted for r in got]) >= 0.97
    assert np.mean([r.predicted for r in got if r.toxic]) >= 0.85
