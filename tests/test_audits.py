"""Audits, manifests, configuration and other checks that have no table of their own."""

import json

import pytest
from pyspark.sql import functions as F

from lumenfold.config import MatchConfig
from lumenfold.operators import audit as A
from lumenfold.operators import batches as B
from lumenfold.operators import labels as L
from lumenfold.operators import record_checks as R
from lumenfold.operators.numbering import numbered
from lumenfold.sources import documents as D

RECORD = "id string, type string, title string, text string, parent_sr string, foundational_requirement int"


def whole_dataset():
    rows = [(f"SR {fr}.{k}", "SR", f"t{fr}.{k}", f"The system shall do {fr} and {k}.", f"SR {fr}.{k}", fr) for fr, n in R.EXPECTED_PARENTS.items() for k in range(1, n + 1)]
    return rows + [(f"{r[0]} RE 1", "RE", "e", f"{r[3]} It shall do more.", r[0], r[5]) for r in rows[: R.EXPECTED_ENHANCEMENTS]]


def audited(spark, rows, seen=None, whole=None):
    r = spark.createDataFrame(rows, RECORD)
    text = "id string, title string, text string"
    return R.audit_records(r, r.select("id", "title", "text") if seen is None else spark.createDataFrame(seen, text), r.select("id", "text") if whole is None else spark.createDataFrame(whole, "id string, text string"))


def test_a_whole_dataset_passes_and_a_broken_one_does_not(spark):
    a = audited(spark, whole_dataset()).cache()
    assert {r["status"] for r in a.collect()} == {"approved"}
    one = R.audit_dataset(a).first()
    assert one["structural_pass"] and (one["total_entries"], one["sr_count"], one["re_count"]) == (100, 51, 49)
    short = R.audit_dataset(audited(spark, whole_dataset()[1:])).first()
    assert not short["structural_pass"] and (short["missing_srs"], short["fail"]) == (1, 1)
    twice = R.audit_dataset(audited(spark, whole_dataset() + whole_dataset()[:1])).first()
    assert not twice["structural_pass"] and twice["duplicate_ids"] == 1 and twice["total_entries"] == 101
    assert R.audit_dataset(a.where("false")).first()["total_entries"] == 0


def test_record_statuses(spark):
    rows = [
        ("SR 1.1", "SR", "t", "The system shall keep a log of it.", "SR 1.1", 1), ("SR 1.2", "SR", "t", "The system shall keep it. Licensee = x", "SR 1.2", 1), ("SR  1.3 ", "SR", "t", "Logs are kept by the system.", "SR 1.3", 1), ("SR 1.4", "RE", "t", "It shall be so and so.", "SR 1.4", 1),
        (None, None, None, None, None, None), ("SR 1.5 RE 1", "RE", "t", "It shall be so and so.", "SR 1.5", 1),
    ]
    got = {r["id"]: r for r in audited(spark, rows).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"SR 1.1": "approved", "SR 1.2": "review", "SR 1.3": "warning", "SR 1.4": "fail", "": "fail", "SR 1.5 RE 1": "fail"}
    assert got["SR 1.2"]["contamination"] == ["licensee"] and got["SR 1.3"]["warnings"] == ["no_shall_detected"] and got["SR 1.4"]["issues"] == ["id_type_mismatch"] and got["SR 1.5 RE 1"]["issues"] == ["missing_parent_sr"]
    assert got[""]["score"] == 1 or got[""]["score"] == 2
    r = audited(spark, rows[:1], [("SR 1.1", "T", rows[0][3]), ("SR 1.1", "u", "The system"), ("SR 1.1", "t", "zzz")], []).first()
    assert r["warnings"] == ["low_similarity_candidate_variant", "missing_debug_consolidation_entry", "multiple_text_variants", "multiple_title_variants", "prefix_or_truncation_variant_detected"] and r["status"] == "warning"
    assert r["candidates"]["occurrences"] == 3 and r["candidates"]["max_similarity"] == 1.0


def test_vector_set(spark):
    e = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, ord int")
    v = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [0.6, 0.8]), ("c", 2, [0.0, 1.0])], "id string, ord int, vector array<float>")
    assert A.vector_set_problems(v, e, 2).count() == 0
    assert {r["code"] for r in A.vector_set_problems(v.select("id", "ord", F.col("vector").cast("array<double>").alias("vector")), e, 2).collect()} == {"type"}


def test_manifests(spark):
    pairs = B.pair_manifest(spark.range(23).select(F.concat(F.lit("p"), "id").alias("pair_id"), "id"), ["id"])
    b = B.batch_manifest(pairs, 5, "pair_id").cache()
    assert B.manifest_problems(pairs, b, 5).count() == 0
    broken = B.manifest_problems(pairs.withColumn("pair_id", F.when(F.col("id") == 3, "p4").otherwise(F.col("pair_id"))), b, 5)
    assert {r["code"] for r in broken.collect()} == {"pair_repeated", "batch_member"}
    assert {r["code"] for r in B.manifest_problems(pairs, b.where("batch_index <> 1"), 5).collect()} == {"batch_count", "batch_member"}
    assert {r["code"] for r in B.manifest_problems(pairs, b, 6).collect()} >= {"batch_shape"}
    assert B.content_digest(pairs.repartition(5), ["id"]) == B.content_digest(pairs.coalesce(1), ["id"]) != B.content_digest(pairs.where("id > 0"), ["id"])


def test_numbering_takes_expressions_and_no_single_task(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("a"), "id").repartition(4)
    out = numbered(df, [F.desc("a"), F.asc("id")])
    want = sorted(((r["a"], r["id"]) for r in df.collect()), key=lambda x: (-x[0], x[1]))
    assert [(r["a"], r["id"]) for r in out.orderBy("index").collect()] == want
    assert "Exchange SinglePartition" not in out.select("a", "id", "index").where("index < 5")._jdf.queryExecution().optimizedPlan().toString()
    assert numbered(df.where("false"), ["a"]).count() == 0


def test_resumed_results_are_of_the_latest_attempt(spark, tmp_path):
    batches = spark.createDataFrame([("b1",), ("b2",)], "batch_id string")
    say = lambda x: lambda df: df.withColumn("answer", F.lit(x)).withColumn("error", F.lit(None).cast("string"))
    path = str(tmp_path / "c")
    B.run_resumable(batches, path, "r", say("old"))
    spark.read.parquet(path).withColumn("answer", F.lit("new")).withColumn("attempt", F.lit(9).cast("long")).write.mode("append").parquet(path)
    assert {r["answer"] for r in B.run_resumable(batches, path, "r", say("none")).collect()} == {"new"}


def test_configuration_files(tmp_path):
    good = {
        "embedding": {"dtype": "float32", "normalized": True},
        "matching": {"similarity": "cosine", "negative_clamp": {"enabled": True, "value": 0.0}, "power_transform": {"enabled": True, "exponent": 5.5}, "normalization": {"method": "l_infinity", "scope": "per_source_rule"}, "threshold": {"type": "relative", "operator": ">=", "value": 0.68}, "top_k": 10},
    }

    def load(x):
        (tmp_path / "c.json").write_text(json.dumps(x))
        return MatchConfig.from_file(str(tmp_path / "c.json"))

    assert load(good) == MatchConfig()
    for change, said in (({"similarity": "dot"}, "matching.similarity"), ({"top_k": 0}, "bad matching"), ({"threshold": {"type": "relative", "operator": ">="}}, "missing field"), ({"threshold": {"type": "relative", "operator": ">=", "value": 2}}, "bad matching")):
        with pytest.raises(ValueError, match=said):
            load({**good, "matching": {**good["matching"], **change}})
    (tmp_path / "c.toml").write_text('embedding = { dtype = "float32", normalized = true }\n[matching]\nsimilarity = "cosine"\n')
    with pytest.raises(ValueError, match="missing field"):
        MatchConfig.from_file(str(tmp_path / "c.toml"))


def test_required_columns_files_and_bounds(spark, tmp_path):
    df = spark.range(3)
    assert D.require_columns(df, ["id"]) is df
    with pytest.raises(ValueError, match="missing columns: a, b"):
        D.require_columns(df, ["id", "b", "a"])
    for n in ("A.md", "b.MD", "c.txt"):
        (tmp_path / n).write_text(n)
    assert D.text_files(spark, str(tmp_path), r"(?i)\.md$", 2).count() == 2
    with pytest.raises(ValueError, match="2 files"):
        D.text_files(spark, str(tmp_path), r"(?i)\.md$", 3)
    with pytest.raises(ValueError, match="strata"):
        L.stratified_sample(df.withColumn("s", F.col("id")), "s", 2, "id", most_strata=2)
    assert L.stratified_sample(df.withColumn("s", F.when(F.col("id") > 0, "x")), "s", 2, "id").count() == 2


def test_retried_batches_against_plain_python(spark):
    from lumenfold.plans import q_sources as S
    from lumenfold.plans.standins import candidates

    sf = "/root/testdata/sf0.001"
    items = [f"{r['source_id']}:{r['rank']}" for r in candidates(spark, sf).select("source_id", "rank").orderBy("source_id", "rank").collect()]

    def run(part, policy):
        """(requests, error) of a batch."""
        first = int(part[0].split(":")[0])
        error = "TimeoutError: always" if first % 7 == 3 else "InvalidAnswer: too many" if len(part) > 3 and first % 2 == 0 else ""
        if not error:
            return 1, ""
        if len(part) < 2 or (policy == "invalid" and error.startswith("Timeout")):
            return 1, error
        n, e = run(part[: len(part) // 2], policy)
        if e:
            return 1 + n, e
        more, e = run(part[len(part) // 2 :], policy)
        return 1 + n + more, e

    want = {(p, f"batch-{b:06d}"): run(items[8 * b : 8 * b + 8], p) for p in ("invalid", "any") for b in range(-(-len(items) // 8))}
    got = {(r["policy"], r["batch_id"]): (r["requests"], r["error"]) for r in S.retried(spark, sf).collect()}
    assert got == want and len({e for _, e in want.values()}) > 1


def test_variant_audit_against_difflib(spark):
    from difflib import SequenceMatcher

    finals = spark.createDataFrame([("a", "The System  shall"), ("b", "x"), ("c", "alone")], "id string, text string")
    variants = spark.createDataFrame([("a", "the system shall"), ("a", "The “System”"), ("a", "The system"), ("b", "y"), ("b", "y")], "id string, text string")
    got = {r["id"]: r for r in A.variant_audit(finals, variants, "id", "text").collect()}
    like = sorted(round(SequenceMatcher(None, "the system shall", v).ratio(), 6) for v in ("the system shall", 'the "system"', "the system"))
    assert (got["a"]["variants"], got["a"]["min_similarity"], got["a"]["max_similarity"], got["a"]["prefixes"], got["a"]["equal"]) == (3, like[0], 1.0, 2, 1)
    assert (got["b"]["variants"], got["b"]["max_similarity"], got["b"]["unlike"], got["c"]["variants"]) == (1, 0.0, 1, 0)


def test_similarity_and_match_form_queries_against_plain_python(spark):
    import re
    from difflib import SequenceMatcher
    from hashlib import sha256
    from unicodedata import normalize

    from lumenfold.plans import q_text as Q

    sf = "/root/testdata/sf0.001"
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {i: (round(SequenceMatcher(None, t, items[i + 1]).ratio(), 6), t.startswith(items[i + 1]) or items[i + 1].startswith(t)) for i, t in items.items() if i + 1 in items}
    assert {r["a"]: (r["ratio"], r["prefix"]) for r in Q.similar_lines(spark, sf).collect()} == want and want
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    forms = {d: sha256(re.sub(r"[\s_-]+", " ", normalize("NFKC", t).casefold()).strip().encode()).hexdigest() for d, t in docs.items()}
    assert {r["doc_id"]: r["form"] for r in Q.match_forms(spark, sf).collect()} == forms


def test_stratified_members_have_the_smallest_hashes(spark):
    import struct

    import xxhash

    sf = "/root/testdata/sf0.001"
    parts = [(r["p_partkey"], r["p_brand"]) for r in spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").cast("long"), "p_brand").collect()]

    def order(key):
        h = xxhash.xxh64_intdigest(struct.pack("<i", 42), xxhash.xxh64_intdigest(struct.pack("<q", key), 42))
        return (h - (1 << 64) if h >> 63 else h, key)

    strata = {}
    for k, b in parts:
        strata.setdefault(b, []).append(k)
    take = L.allocation({b: len(v) for b, v in strata.items()}, 75)
    df = spark.createDataFrame(parts, "p_partkey long, p_brand string").repartition(3)
    got = {r["p_partkey"] for r in L.stratified_sample(df, "p_brand", 75, "p_partkey").collect()}
    assert got == {k for b, v in strata.items() for k in sorted(v, key=order)[: take[b]]} and len(got) == 75
