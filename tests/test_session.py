import os

from pyspark.sql import functions as F

from ledgerline.functions import session


def test_hot_keys_join_as_any_other(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 900).alias("k"))
    side = spark.range(0, 900, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    rows = session.stored(rows, "rows")
    for how in ("inner", "left"):
        want = sorted(map(tuple, rows.join(side, "k", how).select("id", "k", "v").collect()), key=repr)
        for limit in (0, 10**6):
            found = session.join_hot(rows, side, ["k"], how, limit)
            assert sorted(map(tuple, found.select("id", "k", "v").collect()), key=repr) == want


def test_scratch_deletes_what_is_stored_inside(spark):
    with session.scratch():
        gone = session.stored(spark.range(3), "gone")
        with session.scratch():
            inner = session.stored(spark.range(1), "inner")
        kept = session.stored(gone, "kept", keep=True)
        assert gone.count() == 3
    there = [os.path.exists(df._stored_path.removeprefix("file://")) for df in (gone, inner, kept)]
    assert there == [False, False, True] and kept.count() == 3
