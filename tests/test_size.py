"""What plans must not do at size, seen in the plans of small tables."""

import os
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import session, text
from ledgerline.operators import closure, lookup, search, topics
from ledgerline.plans import catalogue
from ledgerline.sources import prose
from ledgerline.sources import registry as models


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_side_is_not_broadcast(spark):
    rows, side = spark.range(10), spark.range(10)
    assert "BroadcastExchange" in plan(rows.join(session.small_or_shuffled(side), "id"))
    assert "BroadcastExchange" not in plan(rows.join(session.small_or_shuffled(side, 5), "id"))


@pytest.mark.parametrize("name", ["name_verdicts", "names_attention", "template_prefix", "names_checked"])
def test_names_are_not_broadcast(spark, sf, name, monkeypatch):
    monkeypatch.setattr(lookup, "small_or_shuffled", session.shuffled, raising=False)  # as with many templates
    assert "BroadcastExchange" not in plan(catalogue.QUERIES[name](spark, sf))


def test_small_tables_of_versions_and_packages_are_broadcast(spark, sf):
    """A shuffle by their keys would leave as few tasks as there are versions or packages."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where Spark takes them for large
    try:
        for name in ("packages_listed", "api_history", "api_attribute", "api_renames"):
            found = plan(catalogue.QUERIES[name](spark, sf))
            assert not re.search(r"SortMergeJoin \[(package#\d+|((source|(to_)?version)#\d+,? ?)+)\]", found), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_files_are_parsed_once_and_dealt_out(spark):
    files = spark.createDataFrame([(f"{i}.yaml", f"groups: [{{id: g{i}, type: span}}]") for i in range(40)], "path string, content string").coalesce(1)
    found = models.groups(files)
    assert sorted(r.id for r in found.collect()) == sorted(f"g{i}" for i in range(40))
    assert "MapInArrow" not in plan(found)  # what reads it doesn't parse again
    assert len([f for f in os.listdir(found._stored_path.removeprefix("file://")) if f.endswith(".parquet")]) > 1


def test_closure_edges_are_not_broadcast_when_many(spark, monkeypatch):
    """Each step would send them all through the driver."""
    joined = []
    monkeypatch.setattr(closure, "small_or_shuffled", lambda df: joined.append(session.small_or_shuffled(df, 0)) or joined[-1])
    roots = spark.createDataFrame([(str(i),) for i in range(9)], "id string")
    edges = spark.createDataFrame([(str(i), str(i // 2), 0) for i in range(1, 9)], "child string, parent string, k int")
    assert closure.inherited(roots, edges).count() == 30
    assert "BroadcastExchange" not in plan(roots.withColumnRenamed("id", "node").join(joined[0], "node"))


@pytest.mark.parametrize("name", ["search_top", "search_all_terms"])
def test_terms_are_constants_and_scored_once(spark, sf, name):
    found = plan(catalogue.QUERIES[name](spark, sf))
    assert "lambda" not in found and not re.search(r"Filter [^\n]*CASE WHEN", found)


def test_terms_with_odd_characters(spark):
    rows = spark.createDataFrame([("a..b-c", "x"), ("ab.c/d", "c"), ("A(b)+", "y")], "id string, text string")
    blank = lambda c: F.lit(None).cast("string").alias(c)
    index = search.index(rows.select(F.lit("attribute").alias("type"), "id", "text", F.lit("u").alias("url"), F.lit("").alias("meta"), blank("renamed_to")))
    ranks = lambda raw: {r.id: r["rank"] for r in search.query_ranks(index, raw).collect()}
    assert ranks("c") == {"a..b-c": 2, "ab.c/d": 2} and ranks("a(b)+") == {"A(b)+": 0} and ranks("b c") == {"a..b-c": 2, "ab.c/d": 3}
    assert ranks("a.bd") == {} and ranks("abcd") == {"ab.c/d": 6} and ranks("  ") == {}
    assert {r.id: r.score for r in search.question_scores(index, "ab?").collect()} == {"ab.c/d": 4.0}


@pytest.mark.parametrize("name", ["wire_field_changes", "wire_field_renames"])
def test_fields_are_shuffled_once_by_message(spark, sf, name):
    """Twice to make the sample's fields, twice its messages, once the fields."""
    assert plan(catalogue.QUERIES[name](spark, sf)).count("hashpartitioning") <= 5


def test_word_boundaries_are_those_of_ascii_letters(spark):
    rows = spark.createDataFrame([(1, "ue éon x"), (2, "onè"), (3, "con"), (4, "on"), (5, "1 a+b."), (6, "è of thé the"), (7, "èof theé")], "id int, text string")
    found = lambda pattern: [r.id for r in rows.where(F.col("text").rlike(pattern)).orderBy("id").collect()]
    assert found(topics.keyword_pattern(["ther", "on", "a+b"])) == [1, 2, 4, 5]
    assert [r.x for r in rows.orderBy("id").select(text.level(F.col("text"), ["of the"]).alias("x")).collect()] == [None] * 6 + ["of the"]
    assert prose.statements("èof theé.", str.strip, ["of the"]) == [("of the", "èof theé.")]
