import random

from pyspark.sql import Window, functions as F

from dugout.operators.scan import kth_largest, ranked, scan


def test_scan_equals_plain_windows(spark):
    rng = random.Random(5)
    # one key holds most rows
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b"]), i, rng.choice([None, str(i)]), rng.choice([0, 1]), rng.choice("xy")) for i in range(900)]
    df = spark.createDataFrame(rows, "k STRING, o INT, v STRING, t INT, h STRING").withColumn("c", F.floor(F.col("o") / 7))
    for keys, fold in ((["k"], None), (["k", "h"], "h")):
        got = scan(
            df, keys, ["o"], "c", {"last": (F.col("v"), True), "prev": (F.col("v"), False)},
            {"n": (F.col("t"), True), "m": (F.col("t"), False)}, fold=fold,
        )
        w = Window.partitionBy(*keys).orderBy("o")
        upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
        want = df.select(
            "*", F.last("v", True).over(upto).alias("last"), F.last("v", True).over(before).alias("prev"),
            F.sum("t").over(upto).alias("n"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("m"),
        )
        cols = want.columns
        assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.collect()))


def test_ranked_is_a_row_number(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["d", "d", "e"]), rng.choice([0, 0, 0, 5, 9]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "d STRING, lp INT, i INT")
    got = ranked(df, ["d"], "lp", ["i"], spread=F.col("i") % 8)
    w = Window.partitionBy("d").orderBy(F.desc("lp"), F.col("i") % 8, "i")
    want = df.withColumn("rank", F.row_number().over(w).cast("bigint"))
    assert sorted(map(str, got.select("d", "lp", "i", "rank").collect())) == sorted(map(str, want.collect()))
    dense = ranked(df, ["d"], "lp", ["i"]).groupBy("d").agg(F.max("rank").alias("m"), F.count_distinct("rank").alias("n"))
    assert all(r.m == r.n for r in dense.collect())


def test_kth(spark):
    df = spark.createDataFrame([("a", v) for v in (3, 9, 9, 1)] + [("b", 4)], "k STRING, lp INT")
    assert [tuple(r) for r in kth_largest(df, ["k"], "lp", F.lit(2), 5).collect()] == [("a", 9)]
