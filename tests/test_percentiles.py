import math
import random

from pyspark.sql import functions as F

from lumenfold.operators import percentiles as P

QS = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 0.95, "f": 1.0, "g": 1 / 3}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equal_to_percentile_on_all_groups(spark):
    r = random.Random(1)
    rows = [("normal", r.gauss(0, 1)) for _ in range(3000)] + [("few", float(r.randint(0, 3))) for _ in range(500)] + [("one", 2.5)] + [("two", 1.0), ("two", 2.0)] + [(None, r.random()) for _ in range(50)]
    rows += [("scales", 10.0 ** r.randint(-300, 300)) for _ in range(400)] + [("signs", s * 1.7e308) for s in (-1, 1, 1)] + [("nulls", None)] * 3 + [("holes", x) for x in (None, 1.0, None, 4.0)] + [("zero", 0.0), ("zero", 0.0), ("zero", 5e-324)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    want = df.groupBy("k").agg(*[F.percentile("v", q).alias(n) for n, q in QS.items()])
    for bins in (16, 1024):
        assert rows_of(P.percentiles(df.where("k <> 'scales' or k is null") if bins == 16 else df, ["k"], F.col("v"), QS, bins)) == rows_of(want.where("k <> 'scales' or k is null") if bins == 16 else want)


def test_without_keys_and_of_an_empty_table(spark):
    df = spark.range(1001).select((F.col("id") * 3).alias("v"))
    assert P.percentiles(df, [], F.col("v"), {"m": 0.5, "q": 0.9995}).collect() == df.agg(F.percentile("v", 0.5).alias("m"), F.percentile("v", 0.9995).alias("q")).collect()
    assert P.percentiles(df.where("v < 0"), [], F.col("v"), {"m": 0.5}).collect()[0]["m"] is None
    assert P.percentiles(df.where("v < 0").withColumn("k", F.lit(1)), ["k"], F.col("v"), {"m": 0.5}).count() == 0


def test_infinite_values_and_nan(spark):
    inf = math.inf
    df = spark.createDataFrame([(x,) for x in (-inf, -inf, 1.0, 2.0, 3.0, inf, math.nan)], "v double")
    got = P.percentiles(df, [], F.col("v"), {"a": 0.0, "b": 0.2, "c": 0.4, "d": 0.8, "e": 1.0}).first()
    assert tuple(got) == (-inf, -inf, 1.0, 3.0, inf)


def test_plan_holds_no_values(spark):
    df = spark.range(10_000).select((F.col("id") % 3).alias("k"), (F.col("id") * 0.37 % 11).alias("v"))
    plan = P.percentiles(df, ["k"], F.col("v"), {"m": 0.5})._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "collect_set" not in plan
