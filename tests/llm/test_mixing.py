import numpy as np
import pytest

from lumenfold.llm import mixing as M
from lumenfold.llm.features import WordTable

from . import corpus


@pytest.fixture(scope="module")
def members(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3, 1.0, 0.3], 500)
    return spark.createDataFrame([(i, int(n), *map(float, q)) for i, (n, q) in enumerate(zip(rng.integers(1, 500, 500), p, strict=True))], "doc_id long, tokens long, p_poor double, p_good double, p_toxic double")


@pytest.mark.parametrize("targets, epochs", [({"poor": 0.2, "good": 0.6, "toxic": 0.2}, 1.0), ({"poor": 0.3, "good": 0.4, "toxic": 0.3}, 2.0), ({"poor": 1, "good": 8, "toxic": 1}, 0.5)])
def test_targets_are_met_by_nonnegative_rates(members, targets, epochs):
    rate, seen = M.fit_rates(members, targets, epochs)
    pdf = members.withColumn("rate", rate).toPandas()
    assert (pdf.rate >= 0).all()
    whole = pdf.tokens.sum()
    for d in M.DOMAINS:
        assert abs((pdf.rate * pdf.tokens * pdf[f"p_{d}"]).sum() - epochs * whole * targets[d] / sum(targets.values())) < 2e-3 * whole
        assert abs((pdf.rate * pdf.tokens * pdf[f"p_{d}"]).sum() - seen[-1][d]) < 1e-6 * whole


def test_against_numpy_projected_gradient(members):
    rate, seen = M.fit_rates(members, {"good": 1.0}, 1.5)
    pdf = members.withColumn("rate", rate).toPandas()
    p, t = pdf[[f"p_{d}" for d in M.DOMAINS]].to_numpy(), pdf.tokens.to_numpy()
    now = t @ p
    want, scale, w = np.array([0, 1.5 * t.sum(), 0]), 1 / now, np.ones(len(t))
    for _ in range(len(seen) - 1):
        w = np.maximum(0, w - p @ (scale * ((w * t) @ p - want)))
    assert np.allclose(w, pdf.rate)


def test_unreachable_and_empty(members):
    with pytest.raises(ValueError):
        M.fit_rates(members, {"good": -1.0})
    none = members.where("false")
    rate, _ = M.fit_rates(none, {"good": 1.0})
    assert none.withColumn("r", rate).count() == 0


def test_mix_and_stage(spark, odd_docs, no_docs, tmp_path):
    docs, labels = corpus.write(spark, str(tmp_path))
    sample = [(t, 0 if not labels[i][0] else 2 if labels[i][1] else 1) for i, t in docs.items()]
    model = M.fit_domains(sample, {0: 58, 1: 273, 2: 69})
    _, p = model.posteriors(WordTable(model.lexicon), [t for t, _ in sample])
    assert (p.argmax(axis=1) == [y for _, y in sample]).mean() > 0.95
    out = M.mix(odd_docs, model, {"good": 1.0}).collect()
    assert len(out) == 10 and all(r["rate"] >= 0 and abs(r["p_poor"] + r["p_good"] + r["p_toxic"] - 1) < 1e-9 for r in out)
    assert M.mix(no_docs, model, {"good": 1.0}).count() == 0
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = M.mix_stage(spark, df, str(tmp_path))
    assert kept.columns == df.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert np.mean([(i in ids) == (labels[i] == (1, 0)) for i in docs]) > 0.95
    assert len(M.fit_domains([], {}).posteriors(WordTable(), ["a"])[1]) == 1


def totals(x, model):
    r = M.memberships(x.select("doc_id", "text"), model).agg(*[M.F.sum(M.F.expr(f"tokens * p_{d}")).alias(d) for d in M.DOMAINS]).first()
    return np.array([r[d] for d in M.DOMAINS])


def test_stage_thins_what_is_above_its_limit_and_repeats_the_rest(spark, tmp_path):
    docs, labels = corpus.write(spark, str(tmp_path), 1500)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = M.fit_tables(df, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    before, after = totals(df, model), totals(M.mix_stage(spark, df, str(tmp_path)), model)
    assert (before / before.sum())[[0, 2]].min() > 0.1 and abs(after.sum() / before.sum() - 1.5) < 0.05
    assert np.allclose(after / after.sum(), [0.01, 0.98, 0.01], atol=0.008)


@pytest.mark.parametrize("few", [0, 3])
def test_stage_keeps_every_row_where_nothing_is_above_its_limit(spark, tmp_path, few):
    docs, labels = corpus.write(spark, str(tmp_path), 1500)
    own = {i for i in docs if labels[i] == (1, 0)} | set([i for i in docs if labels[i][0] == 0][:few])
    df = spark.read.parquet(f"{tmp_path}/documents.parquet").where(M.F.col("doc_id").isin(list(own)))
    n = {r["doc_id"]: r["n"] for r in M.mix_stage(spark, df, str(tmp_path)).groupBy("doc_id").agg(M.F.count("*").alias("n")).collect()}
    assert set(n) == own and set(n.values()) == {1, 2} and abs(sum(n.values()) / len(own) - 1.5) < 0.05


def test_stage_on_odd_rows(spark, odd_docs, no_docs, tmp_path):
    corpus.write(spark, str(tmp_path))
    clash = odd_docs.withColumn("tokens", M.F.lit("mine")).withColumn("P_good", M.F.lit(1)).withColumn("rate", M.F.lit(2))
    out = M.mix_stage(spark, clash, str(tmp_path))
    assert out.columns == clash.columns and {r["tokens"] for r in out.collect()} == {"mine"}
    both = {r["doc_id"] for r in clash.collect()}
    assert {r["doc_id"] for r in out.collect()} <= both and M.mix_stage(spark, clash.where("false"), str(tmp_path)).count() == 0
    # Rows that share an id are drawn by their texts; equal rows share the draw.
    same = spark.createDataFrame([(7, f"plain words number {i}") for i in range(200)] + [(8, "twice"), (8, "twice")], "doc_id long, text string")
    n = M.mix_stage(spark, same, str(tmp_path)).groupBy("text").agg(M.F.count("*").alias("n")).collect()
    assert {r["n"] for r in n if r["text"] != "twice"} == {1, 2} and {r["n"] for r in n if r["text"] == "twice"} <= {2, 4}


@pytest.mark.parametrize("soft, least", [(1.0, 0.12), (0.25, 0.162)])
def test_overlapping_posteriors_meet_targets(spark, soft, least):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.3, 1.0, 0.3], 3000) * soft + (1 - soft) * np.array([0.2, 0.6, 0.2])
    df = spark.createDataFrame([(i, int(n), *map(float, q)) for i, (n, q) in enumerate(zip(rng.integers(1, 500, 3000), p, strict=True))], "doc_id long, tokens long, p_poor double, p_good double, p_toxic double").coalesce(2).cache()
    targets = {"poor": least, "good": 1 - 2 * least, "toxic": least}
    rate, seen = M.fit_rates(df, targets)
    pdf = df.withColumn("rate", rate).toPandas()
    assert (pdf.rate >= 0).all()
    got = [(pdf.rate * pdf.tokens * pdf[f"p_{d}"]).sum() / pdf.tokens.sum() for d in M.DOMAINS]
    assert np.allclose(got, list(targets.values()), atol=2e-4) and np.allclose(got, np.array(list(seen[-1].values())) / pdf.tokens.sum(), atol=1e-6)


def test_a_miss_is_reported(members):
    with pytest.warns(RuntimeWarning, match="targets are not met"):
        M.fit_rates(members, {"poor": 1.0})


def test_accelerated_steps_against_numpy(spark):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.3, 1.0, 0.3], 3000) * 0.25 + 0.75 * np.array([0.2, 0.6, 0.2])
    t = rng.integers(1, 500, 3000)
    df = spark.createDataFrame([(i, int(n), *map(float, q)) for i, (n, q) in enumerate(zip(t, p, strict=True))], "doc_id long, tokens long, p_poor double, p_good double, p_toxic double").coalesce(2).cache()
    want = t.sum() * np.array([0.162, 0.676, 0.162])
    rate, got = M._accelerated(df, want.tolist(), (t @ p).tolist(), 1e-4 * t.sum())
    metric = np.linalg.inv((p * t[:, None]).T @ p)
    assert abs(np.linalg.eigvalsh(np.linalg.cholesky(metric).T @ ((p * t[:, None]).T @ p) @ np.linalg.cholesky(metric)).max() - 1) < 1e-6
    w, before, momentum, last = np.ones(3000), np.ones(3000), 1.0, np.inf
    while np.abs((w * t) @ p - want).max() > 1e-4 * t.sum():
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = w + (momentum - 1) / grown * (w - before)
        before, w = w, np.maximum(0, ahead - p @ metric @ ((ahead * t) @ p - want))
        miss = (w * t) @ p - want
        momentum, last = (grown if miss @ metric @ miss <= last else 1.0), miss @ metric @ miss
    out = df.select("doc_id", rate.alias("w")).orderBy("doc_id").toPandas().w.to_numpy()
    assert np.allclose(out, w) and np.allclose((out * t) @ p, got) and (out >= 0).all()


def test_accelerated_steps_leave_a_domain_without_mass_alone(spark):
    df = spark.createDataFrame([(i, 10, 0.2 + 0.001 * i, 0.8 - 0.001 * i, 0.0) for i in range(100)], "doc_id long, tokens long, p_poor double, p_good double, p_toxic double")
    mass = [10 * sum(0.2 + 0.001 * i for i in range(100)), 10 * sum(0.8 - 0.001 * i for i in range(100)), 0.0]
    _, got = M._accelerated(df, [240.0, 760.0, 5.0], mass, 0.1)
    assert np.allclose(got, [240.0, 760.0, 0.0], atol=0.2)
