import gzip
import json

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import registry as ops
from ledgerline.sources import archives, dimensions, prose, registry, snapshots, wire


def texts(body):
    return [s for _, s in prose.statements(body, prose.plain_text)]


def test_sentences_and_lists():
    assert texts("Call `x.build_id` first. It is RECOMMENDED that `y.build_id` is set.\n\nThe a_id MUST equal the b_id.") == ["It is RECOMMENDED that `y.build_id` is set.", "The a_id MUST equal the b_id."]
    assert texts("A part MUST have one of:\n\n- `x.y`\n- `z`.\n\nOther prose.") == ["A part MUST have one of: `x.y`; `z`"]
    assert texts("It MUST offer:\n\n- Read\n- Write, which SHOULD take:\n  - a key\n  - a value\n- Drop") == ["It MUST offer: Read; Drop", "Write, which SHOULD take: a key; a value"]
    assert texts("- REQUIRED inputs:\n  - the key\n- A sibling") == ["REQUIRED inputs: the key"]
    assert texts("It MUST be one of:\n\nSee below.") == ["It MUST be one of:"]
    assert texts("Use e.g. (this) MUST hold. Then MAY Not. it MAY") == ["Use e.g. (this) MUST hold.", "Then MAY Not. it MAY"]
    assert texts("x MUST y. X MUST y.") == ["x MUST y."]
    assert texts("MUST " + "w" * 700) == ["MUST " + "w" * 594 + "..."]
    assert texts("") == []


DOC = """<!--- front --->
# Title *one*

**Status**: [Stable](x), more

## Part
It MUST work.
```
It MUST NOT show.
```
### Part
- You SHOULD see this.
# Other
"""


def test_sections_and_requirements(spark):
    files = spark.createDataFrame([("a/b.md", DOC), ("c.md", "no heading MUST"), ("d.md", None)], "path string, text string")
    got = {r.id: r for r in prose.sections(files).collect()}
    assert sorted(got) == ["a/b.md#other", "a/b.md#part", "a/b.md#part-1", "a/b.md#title-one"]
    assert got["a/b.md#part"].depth == 2 and got["a/b.md#part"].length == len("It MUST work.") and got["a/b.md#other"].length == 0
    assert {r.path: (r.title, r.status) for r in prose.documents(files.where("text IS NOT NULL")).collect()} == {"a/b.md": ("Title one", "Stable"), "c.md": ("c.md", "Unspecified")}
    found = {r.text: r for r in prose.requirements(prose.sections(files)).collect()}
    assert {t: (r.level, r.section) for t, r in found.items()} == {"It MUST work.": ("MUST", "a/b.md#part"), "You SHOULD see this.": ("SHOULD", "a/b.md#part-1")}
    import hashlib

    assert found["It MUST work."].id == hashlib.sha256(b"a/b.md#part|it must work.").hexdigest()[:12]


def test_read_tree(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "y" / "z.md").write_text("# A\n")
    (tmp_path / "x" / "n.txt").write_text("no")
    assert [(r.path, r.text) for r in prose.read_tree(spark, str(tmp_path)).collect()] == [("x/y/z.md", "# A\n")]


PROTO = """syntax = "proto3";
package w.v1;
// Licence.

// A thing.
// More of it.
message Thing {
  reserved 4, 5 to 7, 9;
  // deprecated: old
  repeated string names = 1;
  oneof body {
    int32 a = 2;
    Other b = 3;
  }
  map<string, string> tags = 8 [deprecated = true];
  message Inner {
    optional int64 x = 1;
  }
  enum Kind {
    NONE = 0;
    NEG = -1 [deprecated = true];
  }
}
service S {
}
"""


def test_wire_files(spark):
    files = spark.createDataFrame([("f.proto", PROTO), ("e.proto", "")], "path string, text string")
    got = {r.name: r for r in wire.messages(files).collect()}
    assert sorted(got) == ["w.v1.S", "w.v1.Thing", "w.v1.Thing.Inner", "w.v1.Thing.Kind"]
    thing = got["w.v1.Thing"]
    assert thing.comment == "A thing. More of it." and thing.reserved == [4, 9] and not thing.deprecated
    assert [(f.name, f.number, f.type, f.label, f.oneof, f.deprecated) for f in thing.fields] == [("names", 1, "string", "repeated", None, True), ("a", 2, "int32", None, "body", False), ("b", 3, "Other", None, "body", False), ("tags", 8, "map<string, string>", None, None, True)]
    assert [(v.name, v.number, v.deprecated) for v in got["w.v1.Thing.Kind"]["values"]] == [("NONE", 0, False), ("NEG", -1, True)]


def test_wire_statements():
    one = wire.parse("f", 'package a.b;\nmessage One { int32 x = 1; message In { string y = 2; } oneof u { bool b = 3; In i = 4 [deprecated = true, json_name = "q}"]; } reserved 5, 7 to 9, 20 to max, "old"; }')
    assert [m["name"] for m in one] == ["a.b.One.In", "a.b.One"]
    assert [(f["name"], f["oneof"], f["deprecated"]) for f in one[1]["fields"]] == [("x", None, False), ("b", "u", False), ("i", "u", True)]
    assert one[1]["reserved"] == [5] and one[1]["reserved_ranges"] == [{"low": 7, "high": 9}, {"low": 20, "high": 536870911}]
    text = """// far above

// Deprecated: use Two.
message One {
  // first
  // and second
  repeated a.B items = 1 [(x.opt) = { min: 1 }]; // trailing
  int32 plain = 2;
  /* block
   * comment */
  map< string,Other > m = 3;
  option deprecated = true;
}
service S { rpc Call(One) returns (One) {} }
enum E { option allow_alias = true; A = 0; B = -1 [deprecated=true]; }
// broken to the end
message Open { string s = 1; """
    one, service, enum = wire.parse("f", text)
    assert one["deprecated"] and one["comment"] == "Deprecated: use Two."
    assert [(f["name"], f["type"], f["label"], f["comment"]) for f in one["fields"]] == [("items", "a.B", "repeated", "first and second"), ("plain", "int32", None, None), ("m", "map<string, Other>", None, "block comment")]
    assert (service["kind"], service["fields"]) == ("service", []) and [(v["name"], v["number"], v["deprecated"]) for v in enum["values"]] == [("A", 0, False), ("B", -1, True)]
    assert wire.parse("f", "") == wire.parse("f", "}}; { ; ] = message") == [] and wire.parse("f", "message " * 3) == []
    deep = wire.parse("f", "message M { " * 3000 + "}" * 3000)
    assert len(deep) == 3000 and deep[-1]["name"] == "M"


OLD = """groups:
  - id: base
    type: attribute_group
    attributes:
      - id: app.size
        type: int
        brief: " Size "
        stability: stable
        examples: [1, "two"]
      - id: app.mode
        type: {members: [{id: on, value: 1, stability: stable}, {id: off, value: "0"}]}
        deprecated: gone
        requirement_level: opt_in
  - id: mid
    type: resource
    extends: base
    attributes:
      - ref: app.size
        requirement_level: {conditionally_required: if known}
      - ref: nobody.knows
  - id: metric.app
    type: metric
    metric_name: app.count
    instrument: counter
    unit: "1"
    attributes:
      - ref_group: mid
      - ref: app.size
        requirement_level: required
      - ref: app.mode
"""
NEW = """attributes:
  - key: app.size
    type: string
    stability: development
    deprecated: {reason: renamed, renamed_to: app.length}
spans:
  - type: app.call
    kind: client
    attributes: [{ref: app.size}]
span_refinements:
  - id: fine
    ref: app.call
    attributes: [{ref: app.mode, requirement_level: recommended}]
events:
  - name: app.done
"""


def test_registry_model(spark):
    files = spark.createDataFrame([("model/a.yaml", bytearray(OLD.encode())), ("model/b.yaml", bytearray(NEW.encode())), ("model/c.yaml", bytearray(b""))], "path string, content binary")
    groups = registry.groups(files).cache()
    attributes = {r.id: r for r in registry.attributes(groups).collect()}
    assert sorted(attributes) == ["app.mode", "app.size"]
    assert attributes["app.size"].type == "string" and attributes["app.size"].renamed_to == "app.length" and attributes["app.size"].defined_in == "model/b.yaml"
    mode = attributes["app.mode"]
    assert mode.type == "enum" and [(m.id, m.value) for m in mode.enum_members] == [("on", "1"), ("off", "0")] and mode.reason == "uncategorized" and mode.deprecation_note == "gone"
    usage = {(r.group_id, r.id): (r.group_type, r.signal_name, r.level) for r in registry.usage(groups, registry.attributes(groups)).collect()}
    assert usage[("metric.app", "app.size")] == ("metric", "app.count", "required")
    assert usage[("mid", "app.size")] == ("attribute_group", None, "conditionally_required")
    assert usage[("fine", "app.mode")] == ("span", "app.call", "recommended") and usage[("app.call", "app.size")] == ("span", "app.call", "recommended")
    assert not any(k[1] == "nobody.knows" for k in usage)
    assert [(r.id, r.instrument, r.unit) for r in registry.metrics(groups).collect()] == [("app.count", "counter", "1")]
    assert sorted((r.id, r.name, r.kind, r.span_kind) for r in registry.signals(groups).collect()) == [("app.call", "app.call", "span", "client"), ("event.app.done", "app.done", "event", None)]


def test_json_snapshots(spark, tmp_path):
    snapshot = {"source": "r", "version": "1.0", "attributes": [{"id": "a.b", "type": "int", "stability": "stable", "brief": "B", "examples": [], "usedBy": [{"groupId": "g", "groupType": "span", "requirementLevel": "required"}]}], "metrics": [{"name": "m", "unit": "s"}], "signals": []}
    later = json.loads(json.dumps(snapshot)) | {"version": "1.1"}
    later["attributes"][0]["deprecated"] = {"reason": "renamed", "renamedTo": "a.c"}
    for s in (snapshot, later):
        with gzip.open(tmp_path / f"{s['version']}.json.gz", "wt") as f:
            f.write(json.dumps(s))
    rows = snapshots.read_snapshots(spark, str(tmp_path), "registry")
    attributes = snapshots.attributes_of(rows)
    diff = ops.attribute_changes(attributes.where("version = '1.0'").drop("source", "version", "ordinal"), attributes.where("version = '1.1'").drop("source", "version", "ordinal"))
    assert [(r.kind, r.severity, r.renamed_to) for r in diff.collect()] == [("renamed", "breaking", "a.c")]
    assert snapshots.usage_of(rows).count() == 2 and snapshots.metrics_of(rows).first().unit == "s"


def test_versions_table(spark, tmp_path):
    root = str(tmp_path / "table")
    assert snapshots.versions(spark, root, "r").count() == 0
    rows = spark.createDataFrame([("r", "1.9", 1), ("r", "1.10", 2), ("q", "1.0", 3)], "source string, version string, x int")
    snapshots.write_versions(rows, root)
    snapshots.write_versions(rows.where("version = '1.9'").withColumn("x", F.lit(7)), root)
    assert [r.version for r in snapshots.versions(spark, root, "r").collect()] == ["1.10", "1.9"]
    assert sorted((r.version, r.x) for r in snapshots.read_versions(spark, root).collect()) == [("1.0", 3), ("1.10", 2), ("1.9", 7)]
    plan = snapshots.read_versions(spark, root, "r", "1.9")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in plan
    wanted = spark.createDataFrame([("r", "1.9"), ("r", "2.0")], "source string, version string")
    assert [r.version for r in snapshots.missing(wanted, snapshots.read_versions(spark, root)).collect()] == ["2.0"]
    snapshots.clear_source(spark, root, "r")
    assert [r.source for r in snapshots.read_versions(spark, root).collect()] == ["q"]


def test_release_index(spark, tmp_path):
    path = str(tmp_path / "index.json")
    schema = "source string, tag string, version string, published_at string, url string, body string"
    assert snapshots.read_index(spark, path).count() == 0
    first = spark.createDataFrame([("a", "v1", "1", "2024-01-01", "u", "b"), ("b", "v1", "1", "2024-01-02", "u", "b")], schema)
    snapshots.write_index(spark, path, first)
    got = snapshots.write_index(spark, path, spark.createDataFrame([("a", "v1", "1x", "2024-01-03", "u", "b"), ("b", "v2", "2", "2024-01-04", "u", "b")], schema), ["b"])
    assert [(r.source, r.tag, r.version) for r in got.collect()] == [("b", "v2", "2"), ("a", "v1", "1x")]
    assert spark.read.json(path).first().generatedAt == "2024-01-04"


def test_releases_and_outputs(spark):
    listed = spark.createDataFrame([("a", "v2", "2024-02", False, False, "u", "- x (#1)"), ("a", "v1", "2024-01", None, False, "u", None), ("a", "v3", "2024-03", True, False, "u", ""), ("a", "v4", "2024-04", False, True, "u", "")], "source string, tag_name string, published_at string, draft boolean, prerelease boolean, url string, body string")
    got = snapshots.tagged_releases(listed)
    assert [(r.version, r.body) for r in got.collect()] == [("1", ""), ("2", "- x (#1)")]
    assert {r.version: r.notes for r in snapshots.release_notes(got, []).collect()} == {"1": [], "2": ["x"]}
    commits = spark.createDataFrame([("a", "abcdef0123", "2024-01-05T00", "one\ntwo", "u", 0)], "source string, sha string, committed_at string, message string, url string, position int")
    r = snapshots.untagged_releases(commits).first()
    assert (r.tag, r.version, r.body) == ("abcdef0", "2024-01-05", "one")
    assert commits.select(snapshots.is_commit(F.lit("abcdef0")), snapshots.is_commit(F.lit("v1.0"))).first()[:] == (True, False)
    feed = spark.createDataFrame([("a", "1", "2024-01")], "source string, version string, published_at string")
    lines = spark.createDataFrame([("a", "1", i, f"l{i} <&>") for i in range(32)], "source string, version string, ordinal int, line string")
    item = snapshots.rss_items(feed, lines).first().item
    assert "l29 &lt;&amp;&gt;\n…and 2 more" in item and "l30" not in item and "<title>a v1</title>" in item
    assert json.loads(snapshots.as_json(feed).first().value) == {"source": "a", "version": "1", "published_at": "2024-01"}
    counts = spark.createDataFrame([("a", 3, 2, "1", "2")], "source string, entries int, versions int, first string, last string")
    assert snapshots.summary(counts).first().value == "a: 3 entries, 2 versions, 1 to 2"


def test_archives(spark, tmp_path):
    import io
    import tarfile

    for tag in ("a", "b"):
        with tarfile.open(tmp_path / f"{tag}.tar.gz", "w:gz") as tar:
            for name, text in ((f"repo-{tag}/docs/x.md", f"# {tag}"), (f"repo-{tag}/model/m.yaml", "groups: []"), (f"repo-{tag}/../up.md", "no"), ("/etc/x.md", "no")):
                info = tarfile.TarInfo(name)
                info.size = len(text)
                tar.addfile(info, io.BytesIO(text.encode()))
            link = tarfile.TarInfo(f"repo-{tag}/docs/l.md")
            link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
            tar.addfile(link)
    found = archives.unpacked(archives.read_archives(spark, str(tmp_path)))
    assert sorted((r.archive, r.path, bytes(r.content).decode()) for r in found.collect()) == [("a.tar.gz", "docs/x.md", "# a"), ("a.tar.gz", "model/m.yaml", "groups: []"), ("b.tar.gz", "docs/x.md", "# b"), ("b.tar.gz", "model/m.yaml", "groups: []")]
    assert sorted(r.text for r in archives.texts(archives.unpacked(archives.read_archives(spark, str(tmp_path)), r"\.md$")).collect()) == ["# a", "# b"]


def test_index_survives_a_lost_driver(spark, tmp_path):
    path = str(tmp_path / "index")
    new = spark.createDataFrame([("s", "t1", "1", "2024-01-01", "u", "b")], "source string, tag string, version string, published_at string, url string, body string")
    snapshots.write_index(spark, path, new)
    (tmp_path / "index" / "edition=000000002").mkdir()  # a write that was cut off
    assert [r.tag for r in snapshots.read_index(spark, path).collect()] == ["t1"]
    assert snapshots.write_index(spark, path, new.selectExpr("source", "'t2' AS tag", "version", "published_at", "url", "body")).count() == 2


def test_dimensions(spark, tmp_path):
    owned = {r.namespace: r.slug for r in dimensions.owners(dimensions.topics(spark)).collect()}
    assert owned["db"] == "database" and owned["anthropic"] == "gen-ai" and dimensions.topics(spark).count() == 16 and dimensions.sources(spark).where("unreleased").count() == 1
    (tmp_path / "t.json").write_text('{"slug": "a", "title": "A", "blurb": "b", "namespaces": ["x", "y"]}\n{"slug": "b", "title": "B", "namespaces": ["x"]}\n')
    made = dimensions.read_topics(spark, str(tmp_path / "t.json"))
    with pytest.raises(Exception, match="two topics own"):
        dimensions.owners(made).collect()
    assert dimensions.owners(made.where("slug = 'a'")).count() == 2
    (tmp_path / "r.json").write_text('{"slug": "a", "title": "A", "level": "MUST", "text": "t", "anchor": "x", "document": "d.md"}\n')
    assert dimensions.read_rules(spark, str(tmp_path / "r.json")).first().url == "d.md#x"
