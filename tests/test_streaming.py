from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerline.streaming import feed


def streamed(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def finish(df, tmp_path, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_gate(spark, tmp_path):
    rows = [("a", 1, 5), ("a", 2, 5), ("a", 3, 6), ("b", 1, 9)], [("a", 3, 6), ("a", 4, 6), ("a", 5, 5), ("b", 2, 9)]
    got = finish(feed.gate(streamed(spark, tmp_path, rows, "source string, position long, hash long")), tmp_path, "gated")
    assert sorted((r.source, r.position, r.late) for r in got) == [("a", 1, False), ("a", 3, False), ("a", 3, True), ("a", 5, False), ("b", 1, False)]


def test_windows_and_first_seen(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [[("a", "x", t, "breaking"), ("a", "x", t, "notable")], [("a", "y", t + timedelta(days=3), "notable")], [("a", "z", t + timedelta(days=9), "notable")]]
    source = streamed(spark, tmp_path, rows, "source string, id string, ts timestamp, severity string")
    got = finish(feed.windowed_tally(source), tmp_path, "tallied")
    assert sorted((str(r.start.date()), r.breaking, r.notable) for r in got) == [("2024-01-01", 1, 1), ("2024-01-04", 0, 1)]
    assert len(finish(feed.first_seen(source), tmp_path, "seen")) == 3


def test_upsert(spark, tmp_path):
    merged = []
    source = streamed(spark, tmp_path, [[(1,)], [(2,), (3,)]], "k int")
    q = source.writeStream.foreachBatch(feed.upsert_into(lambda b: merged.append(b.agg(F.sum("k")).first()[0]))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(merged) == [1, 5]
