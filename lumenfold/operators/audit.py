"""Data-quality audit: per-record checks, variants, duplicates, roll-ups and invariants of matchings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import text as t


def duplicates(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.select(key.alias(name)).groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def vector_problems(vector: str, dimension: int, tolerance: float = 1e-5) -> Column:
    """Names of what is wrong with a vector: missing, dimension, finite, norm."""
    v = F.col(vector)
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = F.array(F.when(v.isNull(), "missing"), F.when(F.size(v) != dimension, "dimension"), F.when(~finite, "finite"), F.when(finite & (F.abs(length - 1) > tolerance), "norm"))
    return F.filter(found, lambda x: x.isNotNull())


def vector_set_problems(vectors: DataFrame, expected: DataFrame, dims: int, tolerance: float = 1e-5, kind: str = "float", key: str = "id", vector: str = "vector", order: str = "ord") -> DataFrame:
    """(code, error) of a vector set (key, order, vector) against the expected ids in their order: ids that are missing, extra, repeated or at another place, components of another type, and vectors that are missing, of another dimension, not finite or not of unit length."""
    v = vectors.select(F.col(key).cast("string").alias("error"), F.col(order).alias("_at"), F.col(vector).alias("_v"))
    e = expected.select(F.col(key).cast("string").alias("error"), F.col(order).alias("_place"))
    found = v.groupBy("error").agg(F.count("*").alias("_n"), F.min("_at").alias("_at"))
    j = found.join(e, "error", "full")
    place = F.when(F.col("_n").isNull(), "missing_id").when(F.col("_place").isNull(), "extra_id").when(F.col("_n") > 1, "repeated_id").when(F.col("_at") != F.col("_place"), "order")
    out = j.select(place.alias("code"), "error").where("code is not null")
    bad = v.select(F.explode(vector_problems("_v", dims, tolerance)).alias("code"), "error")
    own = vectors.schema[vector].dataType.elementType.simpleString()
    told = [] if own == kind else [vectors.sparkSession.createDataFrame([("type", f"components are {own}, not {kind}")], "code string, error string")]
    for part in (bad, *told):
        out = out.unionAll(part)
    return out


def text_audit(df: DataFrame, built: Column, fields: Sequence[str]) -> DataFrame:
    """One row: records, distinct built texts, repeated ones, empty values of each field."""
    digest = t.sha256(built)
    return df.agg(F.count("*").alias("records"), F.count_distinct(digest).alias("distinct_texts"), (F.count("*") - F.count_distinct(digest)).alias("repeated_texts"), *[F.count_if(~t.filled(F.col(f))).alias(f"empty_{f}") for f in fields])


def record_audit(df: DataFrame, checks: dict[str, Column], review: Sequence[str] = ()) -> DataFrame:
    """df with checks passed, score, issues and status.

    A check is pass, warn or fail, or Boolean. Status: fail if one fails; review if a check of
    `review` warns; approved if all pass; else warning.
    """
    grade = {n: F.when(c.cast("string").isin("pass", "true"), "pass").when(c.cast("string") == "warn", "warn").otherwise("fail") for n, c in checks.items()}
    g = F.create_map(*[x for n, c in grade.items() for x in (F.lit(n), c)])
    df = df.withColumn("_g", g)
    values = F.map_values("_g")
    issues = F.array_sort(F.transform(F.filter(F.map_entries("_g"), lambda e: e["value"] != "pass"), lambda e: F.concat_ws(":", e["key"], e["value"])))
    score = F.aggregate(values, F.lit(0.0), lambda s, v: s + F.when(v == "pass", 1.0).when(v == "warn", 0.5).otherwise(0.0)) / F.lit(float(len(checks)))
    doubtful = F.exists(F.map_entries("_g"), lambda e: (e["value"] == "warn") & e["key"].isin(*review)) if review else F.lit(False)
    status = F.when(F.exists(values, lambda v: v == "fail"), "fail").when(doubtful, "review").when(F.forall(values, lambda v: v == "pass"), "approved").otherwise("warning")
    return df.withColumn("score", F.round(score, 6)).withColumn("issues", issues).withColumn("status", status).drop("_g")


def variant_audit(finals: DataFrame, variants: DataFrame, key: str, text: str) -> DataFrame:
    """Per record: distinct variants, least, greatest and mean similarity to the final text, beginnings of it, equal ones (>= 0.999) and unlike ones (< 0.70)."""
    v = variants.select(key, t.comparison_form(F.col(text)).alias("_v")).distinct()
    j = finals.select(key, t.comparison_form(F.col(text)).alias("_f")).join(v, key, "left")
    j = j.withColumn("s", F.when(F.col("_v").isNotNull(), t.similarity_ratio(F.col("_f"), F.col("_v"))))
    return j.groupBy(key).agg(F.count("_v").alias("variants"), F.round(F.min("s"), 6).alias("min_similarity"), F.round(F.max("s"), 6).alias("max_similarity"), F.round(F.avg("s"), 6).alias("mean_similarity"),
                              F.count_if(t.prefix_variant(F.col("_f"), F.col("_v"))).alias("prefixes"), F.count_if(F.col("s") >= 0.999).alias("equal"), F.count_if(F.col("s") < 0.70).alias("unlike"))


def status_rollup(audited: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Records by status and mean score over each group and over all (null group: all)."""
    return audited.groupingSets([list(groups), []], *groups).agg(F.count("*").alias("records"), *[F.count_if(F.col("status") == s).alias(s) for s in ("fail", "review", "approved", "warning")], F.round(F.avg("score"), 6).alias("mean_score"))


def against_expected(df: DataFrame, key: str, expected: dict) -> DataFrame:
    """Counts by key beside the expected ones; keys of either side are listed."""
    e = df.sparkSession.createDataFrame(list(expected.items()), f"{key} {dict(df.dtypes)[key]}, expected long")
    return df.groupBy(key).agg(F.count("*").alias("observed")).join(e, key, "full").na.fill(0, ["observed", "expected"]).withColumn("ok", F.col("observed") == F.col("expected"))


def field_coverage(df: DataFrame, fields: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """(groups, field): filled and empty values."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), t.filled(F.col(f).cast("string")).alias("filled")) for f in fields]))
    return df.select(*groups, each.alias("x")).groupBy(*groups, "x.field").agg(F.count_if("x.filled").alias("filled"), F.count_if(~F.col("x.filled")).alias("empty"))


def matching_violations(candidates: DataFrame, targets: DataFrame, threshold: float, top_k: int, keys: Sequence[str] = ("source_id",)) -> DataFrame:
    """(keys, rule): ranks that aren't 1..n, repeated or unknown targets, scores that rise or fall short, too many rows, ties out of target order."""
    w = Window.partitionBy(*keys).orderBy("rank")
    c = candidates.select(*keys, "rank", "target_id", "relative_score").join(targets.select("target_id", F.lit(True).alias("_known")), "target_id", "left")
    c = c.withColumn("_n", F.row_number().over(w)).withColumn("_p", F.lag("relative_score").over(w)).withColumn("_q", F.lag("target_id").over(w)).withColumn("_same", F.count("*").over(Window.partitionBy(*keys, "target_id")))
    rules = {
        "rank": F.col("rank") != F.col("_n"), "target_repeated": F.col("_same") > 1, "target_unknown": F.col("_known").isNull(), "score_rises": F.col("relative_score") > F.col("_p"),
        "below_threshold": F.col("relative_score") < threshold, "too_many": F.col("_n") > top_k, "tie_order": (F.col("relative_score") == F.col("_p")) & (F.col("target_id") < F.col("_q")),
    }
    hit = F.filter(F.array(*[F.when(F.coalesce(x, F.lit(False)), F.lit(n)) for n, x in rules.items()]), lambda x: x.isNotNull())
    return c.select(*keys, F.explode(hit).alias("rule")).groupBy(*keys, "rule").agg(F.count("*").alias("n"))


def monotone_violations(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Per key, how often the value rises along the order."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_p", F.lag(value).over(w)).groupBy(key).agg(F.count_if(F.col(value) > F.col("_p")).alias("rises"))
