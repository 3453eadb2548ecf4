import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerline.operators import catalog, changes, closure, lookup, matching, prose, registry, search, topics, wire
from ledgerline.plans import fixtures as X


def test_nothing_changes_against_itself(spark, sf):
    r = X.members(X.registry(spark, sf, 1), 1)
    assert registry.attribute_changes(r, r).isEmpty() and registry.metric_changes(r, r).isEmpty()
    m, f, v = X.messages(spark, sf, 1), X.fields(spark, sf, 1), X.values(spark, sf, 1)
    assert wire.message_changes(m, m).isEmpty() and wire.field_changes(m, m, f, f).isEmpty() and wire.value_changes(m, m, v, v).isEmpty()
    u = X.usage(spark, sf, 1)
    assert registry.usage_changes(u, u, r.select("id", "stability")).isEmpty()


def test_order_and_tally(spark):
    rows = spark.createDataFrame([("added", "informational", "b"), ("removed", "breaking", "a_b"), ("removed", "breaking", "a.b"), ("renamed", "breaking", "0")], "kind string, severity string, id string")
    assert [r.id for r in changes.ordered(rows).collect()] == ["a_b", "a.b", "0", "b"]
    assert changes.tally(rows).first()[:] == (3, 0, 1)
    assert [(r.kind, r.n) for r in changes.by_kind(rows).collect()] == [("removed", 2), ("renamed", 1), ("added", 1)]


def test_removed_number_is_reserved(spark):
    m1 = spark.createDataFrame([("w.M", "message", "f", False, None, [1])], "name string, kind string, file string, deprecated boolean, comment string, reserved array<int>")
    schema = "message string, name string, number int, type string, label string, deprecated boolean, ordinal int"
    before = spark.createDataFrame([("w.M", "a", 1, "t", None, False, 1), ("w.M", "b", 2, "t", None, False, 2)], schema)
    after = spark.createDataFrame([("w.M", "c", 2, "t", None, False, 1)], schema)
    got = {r.kind: r for r in wire.field_changes(m1, m1, before, after).collect()}
    assert sorted(got) == ["field-removed", "field-renamed"] and got["field-removed"].detail.endswith("The number is now reserved.")
    assert got["field-renamed"].renamed_to == "w.M.c" and got["field-renamed"].severity == "breaking"


def brute_greedy(removed, added, threshold):
    def words(t):
        return {w for w in "".join(c if c.isalnum() or c.isspace() else " " for c in t.lower()).split() if len(w) > 3}

    left, out = list(added), {}
    for gone, text in removed:
        best, score = None, threshold
        for i, (fresh, other) in enumerate(left):
            a, b = words(text), words(other)
            s = len(a & b) / min(len(a), len(b)) if a and b else 0
            if s > score:
                best, score = i, s
        if best is not None:
            out[gone] = left.pop(best)[0]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_equals_loop(spark, seed, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_PAIRS", [10**6, 40, 0][seed])
    rng = random.Random(seed)
    vocabulary = ["alpha", "gamma", "delta", "theta", "kappa", "sigma", "no", "omega"]
    made = lambda side: [(f"{side}{s}{i}", f"s{s}", " ".join(rng.choices(vocabulary, k=rng.randrange(0, 6))), i) for s in range(3) for i in range(7)]
    removed, added = made("r"), made("a")
    schema = "id string, section string, text string, ordinal int"
    r, a = spark.createDataFrame(removed, schema), spark.createDataFrame(added, schema)
    got = {x.gone: x.fresh for x in matching.greedy(matching.candidates(r, a, "section", 0.6), r, a, "section").collect()}
    want = {}
    for s in range(3):
        want |= brute_greedy([(i, t) for i, sec, t, _ in removed if sec == f"s{s}"], [(i, t) for i, sec, t, _ in added if sec == f"s{s}"], 0.6)
    assert got == want


def test_requirement_kinds(spark):
    schema = "id string, level string, text string, section string, ordinal int"
    before = spark.createDataFrame([("1", "MUST", "the reader MUST close every handle", "d.md#a", 0), ("2", "MAY", "writers MAY batch small pages together", "d.md#a", 1), ("3", "MUST", "moves across whole sections verbatim MUST", "d.md#a", 2), ("4", "SHOULD", "vanishes entirely SHOULD", "d.md#b", 0), ("5", "MUST", "same", "d.md#b", 1)], schema)
    after = spark.createDataFrame([("6", "SHOULD", "the reader SHOULD close every handle", "d.md#a", 0), ("7", "MAY", "writers MAY batch small pages together now", "d.md#a", 1), ("8", "MUST", "moves across whole sections verbatim MUST", "d.md#b", 0), ("5", "MUST", "same", "d.md#b", 1), ("9", "MUST", "arrives freshly MUST", "d.md#c", 0)], schema)
    sections = spark.createDataFrame([("d.md#a", "Stable"), ("d.md#b", "Draft"), ("d.md#c", "Stable")], "id string, status string")
    got = {r.kind: (r.severity, r.id) for r in prose.requirement_changes(before, after, sections, sections).collect()}
    assert got == {
        "requirement-level-changed": ("breaking", "d.md#a"), "requirement-reworded": ("informational", "d.md#a"), "requirement-moved": ("informational", "d.md#b"),
        "requirement-removed": ("informational", "d.md#b"), "requirement-added": ("breaking", "d.md#c"),
    }


def test_closure_order_and_cycles(spark):
    ids = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    edges = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("b", "d", 0), ("c", "d", 0), ("d", "a", 0)], "child string, parent string, k int")
    rows = closure.inherited(ids, edges).where("root = 'a'").orderBy("place").collect()
    assert [r.node for r in rows] == ["d", "b", "c", "a"]
    assert closure.inherited(ids.limit(0), edges).isEmpty()


def test_floor(spark):
    rows = spark.createDataFrame([("s", i, f"{i}abc", i) for i in range(6)], "source string, position int, sha string, x int")
    assert [r.position for r in catalog.down_to_floor(rows, "3a").collect()] == [3, 2, 1, 0]
    with pytest.raises(PySparkException):
        catalog.down_to_floor(rows, "zz").collect()


def test_small_lookups(spark):
    names = spark.createDataFrame([("a.b",), ("a.old",), ("a.gone",), ("t.x.key",), ("zz",)], "name string")
    live = spark.createDataFrame([("a.b",)], "id string")
    old = spark.createDataFrame([("a.old", "a.b"), ("a.gone", None)], "id string, replacement string")
    prefixes = spark.createDataFrame([("t.x", 1)], "id string, ordinal int")
    got = {r.name: (r.status, r.replacement, r.prefix) for r in lookup.checked_names(names, live, old, prefixes).collect()}
    assert got == {"a.b": ("ok", None, None), "a.old": ("renamed", "a.b", None), "a.gone": ("deprecated", None, None), "t.x.key": ("template", None, "t.x"), "zz": ("unknown", None, None)}
    messages = spark.createDataFrame([("w.v1.Span", 1), ("w.v2.Span", 0)], "name string, ordinal int")
    wanted = spark.createDataFrame([("Span",), ("w.v1.Span",), ("pan",)], "wanted string")
    assert {r.wanted: r.name for r in lookup.messages_named(wanted, messages).collect()} == {"Span": "w.v2.Span", "w.v1.Span": "w.v1.Span"}
    assert [r.name for r in lookup.suggestions("SPAN", messages).collect()] == ["w.v2.Span", "w.v1.Span"]
    registry_ = spark.createDataFrame([("a.b", "int")], "id string, type string")
    history = spark.createDataFrame([("a.b", 1, "1.0", "first-seen", "d")], "id string, n int, version string, kind string, detail string")
    replaced = spark.createDataFrame([("a.b", ["a.old"])], "id string, replaces array<string>")
    row = lookup.definition("a.b", registry_, history, replaced).first()
    assert row.history[0].version == "1.0" and row.replaces == ["a.old"]
    assert lookup.definition("no", registry_, history, replaced).isEmpty()


def test_packages_and_usage(spark):
    messages = spark.createDataFrame([("w.b.M",), ("w.a.N",), ("w.a.sub.Z",), ("x.Q",)], "name string")
    order = spark.createDataFrame([("w.b", 0), ("w.a", 1), ("w", 2)], "package string, ordinal int")
    assert [(r.name, r.package) for r in topics.packages(messages, order).collect()] == [("w.b.M", "w.b"), ("w.a.N", "w.a"), ("w.a.sub.Z", "w.a")]
    edges = spark.createDataFrame([("a", "g1", "span", "s1"), ("a", "g2", "span", None), ("a", "g3", "attribute_group", None)], "id string, group_id string, group_type string, signal_name string")
    assert [(r.group_type, r.signals) for r in topics.usage_by_kind(edges).collect()] == [("span", ["g2", "s1"])]
    assert topics.topic_requirements(spark.createDataFrame([("1", "t")], "id string, text string"), []).isEmpty()


def test_search_types_and_fuzzy(spark):
    rows = [("attribute", "web.reply.code", "Code of a reply.", "/1", "stable · int"), ("attribute", "web.code", "Use web.reply.code instead.", "/2", "deprecated · int"), ("span", "web.client", "Calls.", "/3", ""), ("requirement", "Retry", "Failures of the web MUST be retried.", "/4", "MUST")]
    index = search.index(spark.createDataFrame(rows, "type string, id string, text string, url string, meta string").withColumn("renamed_to", F.lit(None).cast("string")))
    top = lambda q, **k: [r.url for r in search.retrieve(index, q, **k).collect()]
    assert top("Which attribute holds the reply code?")[0] == "/1" and "/2" in top("Which attribute holds the reply code?")
    assert top("is web.code deprecated?")[0] == "/2"
    assert top("web", type="signal") == ["/3"] and top("the and of") == [] and top("zebra") == []
    assert [r.url for r in search.search(index, "span: web").collect()] == ["/3"]
    assert [r.url for r in search.search(index, "wbrply").collect()] == ["/1"]
    assert [r.url for r in search.search(index, "web", type="requirement").collect()] == ["/4"]


def test_ticks(spark):
    days = spark.range(1).select(catalog.ticks(F.lit("2024-02-10").cast("timestamp"), F.lit("2024-11-01").cast("timestamp")).alias("t")).first().t
    assert [d.month for d in days] == [4, 7, 10]
