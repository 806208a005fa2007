import math

import pytest
from pyspark.sql import functions as F

from lumenfold.config import MatchConfig
from lumenfold.operators import sweep, vector


def frames(spark, sources, targets):
    s = spark.createDataFrame([(f"s{i}", v) for i, v in enumerate(sources)], "source_id string, vector array<float>")
    t = spark.createDataFrame([(f"t{i}", i, v) for i, v in enumerate(targets)], "target_id string, target_ord int, vector array<float>")
    return s, t


def test_clamp_power_and_row_maximum(spark):
    s, t = frames(spark, [[1.0, 0.0]], [[1.0, 0.0], [0.5, math.sqrt(0.75)], [-1.0, 0.0]])
    got = {r["target_id"]: r["relative_score"] for r in vector.relative_scores(vector.score_pairs(s, t), 5.5).collect()}
    assert got == {"t0": pytest.approx(1.0), "t1": pytest.approx(0.5**5.5, rel=1e-6), "t2": 0.0}


def test_zero_row_gives_no_candidates(spark):
    s, t = frames(spark, [[1.0, 0.0]], [[-1.0, 0.0], [-0.5, -0.5]])
    assert vector.match(s, t, MatchConfig(threshold=0.0)).count() == 0


def scored(spark, values):
    return spark.createDataFrame([("s", i, i, float(v)) for i, v in enumerate(values)], "source_id string, target_id int, target_ord int, relative_score double")


def test_threshold_is_inclusive(spark):
    up, down = math.nextafter(0.68, 1), math.nextafter(0.68, 0)
    out = vector.select_matches(scored(spark, [down, 0.68, up]), MatchConfig()).orderBy("rank").collect()
    assert [r["target_id"] for r in out] == [2, 1]


def test_threshold_before_k_and_ties_in_target_order(spark):
    out = vector.select_matches(scored(spark, [1 - i * 0.028 for i in range(12)]), MatchConfig()).collect()
    assert len(out) == 10
    tied = vector.select_matches(scored(spark, [0.9] * 11), MatchConfig()).orderBy("rank").collect()
    assert [r["target_id"] for r in tied] == list(range(10))
    assert vector.select_matches(scored(spark, [0.9] * 11), MatchConfig(top_k=None)).count() == 11


def test_cosine_of_raw_vectors_and_blocks_beyond_the_broadcast_bound(spark):
    s, t = frames(spark, [[3.0, 4.0], [0.0, 0.0]], [[6.0, 8.0], [4.0, -3.0], [1.0, 0.0]])
    cfg = MatchConfig(assume_normalized=False)
    a = sorted(map(tuple, vector.score_pairs(s, t, cfg).collect()))
    b = sorted(map(tuple, vector.score_pairs(s, t, MatchConfig(assume_normalized=False, max_broadcast_values=2)).collect()))
    assert a == b and [round(r[3], 6) for r in a] == [1.0, 0.0, 0.6, 0.0, 0.0, 0.0]


def test_one_shuffle_and_group_limit(spark):
    s, t = frames(spark, [[1.0, 0.0]] * 3, [[1.0, 0.0]] * 3)
    vector_plan = vector.match(s, t, engine="sql")._jdf.queryExecution().executedPlan().toString()
    assert vector_plan.count("hashpartitioning(source_id") == 1 and "WindowGroupLimit" in vector_plan


def test_both_engines_agree(spark):
    import random

    r = random.Random(4)
    s, t = frames(spark, [[r.gauss(0, 1) for _ in range(8)] for _ in range(60)] + [[0.0] * 8], [[r.gauss(0, 1) for _ in range(8)] for _ in range(30)])
    for cfg in (MatchConfig(assume_normalized=False), MatchConfig(1.0, 0.3, 4, False), MatchConfig(2.0, 0.0, None, False)):
        a, b = (sorted((x["source_id"], x["rank"], x["target_id"], round(x["raw_cosine"], 9), round(x["relative_score"], 9)) for x in vector.match(s, t, cfg, e).collect()) for e in ("arrow", "sql"))
        assert a == b and a
    assert vector.match(s, t.where("false")).count() == 0 and vector.match(s.where("false"), t).count() == 0
    assert vector.match(s.withColumn("vector", F.lit(None).cast("array<float>")), t).count() == 0


def test_engines_and_blocks_agree_on_bad_vectors(spark, monkeypatch):
    import random

    r = random.Random(9)
    nan, inf = float("nan"), float("inf")
    odd = [None, [1.0], [], [nan] * 4, [inf, 0.0, 0.0, 0.0], [None, 1.0, 0.0, 0.0], [0.0] * 4]
    s, t = frames(spark, [[r.gauss(0, 1) for _ in range(4)] for _ in range(40)] + odd, odd + [[r.gauss(0, 1) for _ in range(4)] for _ in range(50)])
    monkeypatch.setattr(vector, "SLICE", 10)
    for cfg in (MatchConfig(assume_normalized=False), MatchConfig(1.0, 0.3, 4, False), MatchConfig(2.0, 0.2, None, False)):
        small = MatchConfig(cfg.power, cfg.threshold, cfg.top_k, False, max_broadcast_values=30)
        got = [sorted((x["source_id"], x["rank"], x["target_id"], round(x["raw_cosine"], 9), round(x["relative_score"], 9)) for x in vector.match(s, t, c, e).collect()) for c in (cfg, small) for e in ("arrow", "sql")]
        assert got[0] and all(g == got[0] for g in got[1:])
    assert vector.match(s, t.where("size(vector) <> 4"), dims=4).count() == 0


@pytest.mark.parametrize("bad", [{"power": 0}, {"threshold": 1.5}, {"top_k": 0}])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        MatchConfig(**bad)


def test_diversity_against_its_definition(spark):
    s, t = frames(spark, [[1.0, 0.0], [0.6, 0.8]], [[1.0, 0.0], [0.0, 1.0], [0.8, 0.6]])
    pairs = vector.score_pairs(s, t).cache()
    rows = {}
    for r in pairs.collect():
        rows.setdefault(r["source_id"], {})[r["target_id"]] = max(r["raw_cosine"], 0)
    got = {r["p"]: r["m"] for r in sweep.diversity(pairs, [1.0, 5.5]).collect()}
    for p in (1.0, 5.5):
        want = sum(max((row[k] ** p) / max(v**p for v in row.values()) for row in rows.values()) for k in ("t0", "t1", "t2")) / 3
        assert got[p] == pytest.approx(want)


def test_stream_gives_the_batch_result(spark, tmp_path):
    from lumenfold.streaming.matching import match_stream

    s, t = frames(spark, [[1.0, 0.0], [0.0, 1.0], [0.7, 0.7]], [[1.0, 0.0], [0.0, 1.0]])
    s.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    match_stream(spark, stream, t, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    want = vector.match(s, t)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert got.agg(F.count("*")).first()[0] > 0
