"""The audit of a requirement dataset: nine checks per record, against its extraction candidates and their consolidation, and the roll-up of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import text as t

#: What page furniture and structure look like in a requirement's text.
CONTAMINATION = {
    "rationale_and_guidance": r"(?i)\bRationale\s+and\s+supplemental\s+guidance\b",
    "requirement_enhancements": r"(?i)\bRequirement\s+enhancements?\b",
    "security_levels": r"(?i)\bSecurity\s+levels?\b",
    "copyright_notice": r"(?i)\bCopyright\b",
    "not_for_resale": r"(?i)\bNot\s+for\s+Resale\b",
    "provided_by": r"(?i)\bProvided\s+by\b",
    "licensee": r"(?i)\bLicensee\s*=",
    "void_artifact": r"(?i)\bVoid\b",
    "pdf_artifact": r"--[`',\s\-]{5,}",
}
#: An id; how many parents each group has, and how many enhancements there are in all.
ID = r"(?i)^SR\s+([1-7])\.(\d+)(?:\s+RE\s+(\d+))?$"
EXPECTED_PARENTS = {1: 13, 2: 12, 3: 9, 4: 3, 5: 4, 6: 2, 7: 8}
EXPECTED_ENHANCEMENTS = 49
#: The checks, the issues that fail a record, the similarities that count as equal and as unlike, the fewest words.
CHECKS = ("valid_id", "valid_type", "title_present", "text_present", "parent_valid", "fr_consistent", "normative_text", "contamination_free", "debug_consistency")
CRITICAL = ("invalid_requirement_id", "invalid_or_missing_type", "id_type_mismatch", "missing_title", "missing_text", "invalid_parent_sr", "missing_parent_sr", "foundational_requirement_mismatch")
EQUAL, UNLIKE, FEWEST_WORDS = 0.999, 0.70, 5

FIELDS = ("id", "type", "title", "text", "parent_sr", "foundational_requirement")


def _clean(name: str) -> Column:
    return t.collapse(F.coalesce(F.col(name), F.lit("")))


def _held(**tests: Column) -> Column:
    """Names of the tests that hold, in order of name."""
    return F.array_sort(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in tests.items()]), lambda x: x.isNotNull()))


def _variants(records: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Per (id, text of the record): how its candidates' titles and texts vary, and how like the record's text they are."""
    seen = occurrences.select(_clean("id").alias("_id"), t.comparison_form(F.coalesce("title", F.lit(""))).alias("_t"), t.comparison_form(F.coalesce("text", F.lit(""))).alias("_x"))
    each = seen.groupBy("_id", "_t", "_x").agg(F.count("*").alias("_n"))
    per_id = each.groupBy("_id").agg(F.sum("_n").alias("_occurrences"), F.count_distinct("_t").alias("_titles"), F.count_distinct("_x").alias("_texts"))
    own = records.select("_id", t.comparison_form(F.coalesce("text", F.lit(""))).alias("_f")).distinct()
    met = own.join(each.groupBy("_id", "_x").agg(F.sum("_n").alias("_n")), "_id")
    met = met.withColumn("_s", F.when(F.col("_f") == F.col("_x"), F.lit(1.0)).otherwise(t.similarity_ratio(F.col("_f"), F.col("_x"))))
    like = met.groupBy("_id", "_f").agg(
        F.min("_s").alias("_low"), F.max("_s").alias("_high"), F.round(F.sum(F.col("_s") * F.col("_n")) / F.sum("_n"), 4).alias("_mean"),
        F.bool_or(t.prefix_variant(F.col("_f"), F.col("_x")) & (F.col("_s") < EQUAL)).alias("_prefix"))
    return like.join(per_id, "_id")


def audit_records(records: DataFrame, occurrences: DataFrame, consolidated: DataFrame) -> DataFrame:
    """records (FIELDS, repeated rows kept) with checks, score, max_score, issues, warnings, contamination, word_count, status and what the candidates say.

    occurrences: id, title, text of every extraction candidate; consolidated: id, text, one row an id.
    Status: fail on a critical issue; review on contamination; approved if all checks pass and nothing
    warns; else warning. Candidates meet records by id as distinct texts, so an id with many
    candidates is counted where they lie.
    """
    r = records.select(*FIELDS).groupBy(*FIELDS).agg(F.count("*").alias("_copies")).withColumn("_id", _clean("id"))
    parents = r.select(F.col("_id").alias("_expected")).distinct().withColumn("_there", F.lit(True))
    part = lambda k: F.regexp_extract("_id", ID, k)
    r = r.withColumn("_known", F.col("_id").rlike(ID)).withColumn("_fr", part(1).try_cast("int"))
    r = r.withColumn("_expected", F.when(F.col("_known"), F.concat(F.lit("SR "), "_fr", F.lit("."), part(2).try_cast("int"))))
    r = r.withColumn("_kind", F.when(F.col("_known"), F.when(part(3) != "", "RE").otherwise("SR")))
    r = r.withColumn("_f", t.comparison_form(F.coalesce("text", F.lit(""))))
    r = r.join(parents, "_expected", "left").join(_variants(r, occurrences), ["_id", "_f"], "left")
    c = consolidated.select(_clean("id").alias("_id"), t.comparison_form(F.coalesce("text", F.lit(""))).alias("_c")).groupBy("_id").agg(F.min("_c").alias("_c"))
    r = r.join(c, "_id", "left")

    text, lower = _clean("text"), F.lower(_clean("text"))
    found = F.coalesce(t.tags(F.col("text"), CONTAMINATION), F.array().cast("array<string>"))
    same_parent = F.coalesce((_clean("parent_sr") == F.col("_expected")), F.lit(False))
    kind_ok = F.coalesce(F.col("type").isin("SR", "RE"), F.lit(False))
    orphan = same_parent & (F.col("type") == "RE") & F.col("_there").isNull()
    words = t.word_count(F.coalesce("text", F.lit("")))
    normative = F.contains(F.concat(F.lit(" "), lower, F.lit(" ")), F.lit(" shall "))
    seen = F.col("_occurrences").isNotNull()
    close = F.when(F.col("_c") == F.col("_f"), F.lit(1.0)).otherwise(t.similarity_ratio(F.col("_f"), F.col("_c")))
    r = r.withColumn("contamination", found).withColumn("word_count", words).withColumn("text_similarity", F.when(F.col("_c").isNotNull(), F.round(close, 4)))
    issues = _held(
        invalid_requirement_id=~F.col("_known"), invalid_or_missing_type=~kind_ok, id_type_mismatch=F.col("_known") & (F.coalesce("type", F.lit("")) != "") & (F.col("type") != F.col("_kind")),
        missing_title=_clean("title") == "", missing_text=text == "", invalid_parent_sr=~same_parent, missing_parent_sr=orphan,
        foundational_requirement_mismatch=F.col("_known") & ~F.col("foundational_requirement").eqNullSafe(F.col("_fr")))
    debug = _held(
        not_found_in_debug_blocks=~seen, multiple_title_variants=F.col("_titles") > 1, multiple_text_variants=F.col("_texts") > 1, final_text_not_exactly_present_in_debug_candidates=F.col("_high") < EQUAL,
        prefix_or_truncation_variant_detected=F.col("_prefix"), low_similarity_candidate_variant=F.round("_low", 4) < UNLIKE)
    other = _held(
        empty_text=text == "", no_shall_detected=(text != "") & ~normative, suspiciously_short_text=F.col("word_count") < FEWEST_WORDS,
        clean_text_differs_from_debug_consolidation=F.col("text_similarity") < EQUAL, missing_debug_consolidation_entry=F.col("_c").isNull())
    r = r.withColumn("_critical", issues).withColumn("_debug", debug)
    r = r.withColumn("issues", F.array_sort(F.concat("_critical", F.transform("contamination", lambda x: F.concat(F.lit("possible_text_contamination:"), x))))).withColumn("warnings", F.array_sort(F.concat("_debug", other)))
    grades = {
        "valid_id": F.col("_known"), "valid_type": kind_ok, "title_present": _clean("title") != "", "text_present": text != "", "parent_valid": same_parent & kind_ok & ~orphan,
        "fr_consistent": F.col("_known") & F.col("foundational_requirement").eqNullSafe(F.col("_fr")), "normative_text": normative, "contamination_free": F.size("contamination") == 0, "debug_consistency": F.size("_debug") == 0,
    }
    r = r.withColumn("checks", F.struct(*[F.coalesce(grades[n], F.lit(False)).alias(n) for n in CHECKS]))
    score = sum((F.col(f"checks.{n}").cast("int") for n in CHECKS), F.lit(0))
    r = r.withColumn("score", score).withColumn("max_score", F.lit(len(CHECKS)))
    status = F.when(F.size("_critical") > 0, "fail").when(F.size("contamination") > 0, "review").when((F.col("score") == len(CHECKS)) & (F.size("warnings") == 0), "approved").otherwise("warning")
    candidates = F.struct(F.coalesce("_occurrences", F.lit(0)).cast("long").alias("occurrences"), F.coalesce("_titles", F.lit(0)).alias("title_variants"), F.coalesce("_texts", F.lit(0)).alias("text_variants"),
                          F.round("_low", 4).alias("min_similarity"), F.round("_high", 4).alias("max_similarity"), F.col("_mean").alias("mean_similarity"))
    out = r.withColumn("status", status).withColumn("candidates", candidates).withColumn("consolidated", F.col("_c").isNotNull())
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return out.select(F.col("_id").alias("id"), *FIELDS[1:], "word_count", "score", "max_score", "status", "checks", "issues", "warnings", "contamination", "candidates", "consolidated", "text_similarity")


def expected_parents(spark, expected: dict[int, int] = EXPECTED_PARENTS) -> DataFrame:
    """(id, fr) of every parent that the dataset should have."""
    return spark.createDataFrame([(f"SR {fr}.{k}", fr) for fr, n in expected.items() for k in range(1, n + 1)], "id string, fr int")


def audit_dataset(audited: DataFrame, expected: dict[int, int] = EXPECTED_PARENTS, enhancements: int = EXPECTED_ENHANCEMENTS) -> DataFrame:
    """One row on the whole audited dataset: counts, statuses, coverage, and structural_pass: the expected numbers of records, each id once, exactly the expected parents."""
    spark = audited.sparkSession
    parents = sum(expected.values())
    ids = audited.groupBy("id").agg(F.count("*").alias("n"), F.bool_or(F.col("type") == "SR").alias("sr"))
    j = ids.join(expected_parents(spark, expected).withColumn("_e", F.lit(True)), "id", "full")
    one = j.agg(F.count_if(F.col("n") > 1).alias("duplicate_ids"), F.count_if(F.col("_e").isNotNull() & ~F.coalesce("sr", F.lit(False))).alias("missing_srs"), F.count_if(F.col("_e").isNull() & F.col("sr")).alias("unexpected_srs"))
    same = audited.where(t.collapse(F.coalesce("text", F.lit(""))) != "").groupBy(t.comparison_form(F.col("text"))).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_text_groups"))
    whole = audited.agg(
        F.count("*").alias("total_entries"), F.count_if(F.col("type") == "SR").alias("sr_count"), F.count_if(F.col("type") == "RE").alias("re_count"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("approved", "warning", "review", "fail")],
        F.count_if(F.col("candidates.occurrences") == 0).alias("missing_from_blocks"), F.count_if(~F.col("consolidated")).alias("missing_from_consolidation"))
    k = F.lit(0).alias("_k")
    out = whole.select("*", k).join(one.select("*", k), "_k").join(same.select("*", k), "_k").drop("_k")  # one row each
    structural = (F.col("total_entries") == parents + enhancements) & (F.col("sr_count") == parents) & (F.col("re_count") == enhancements) & (F.col("duplicate_ids") + F.col("missing_srs") + F.col("unexpected_srs") == 0)
    return out.withColumn("structural_pass", structural)


def group_distribution(records: DataFrame, expected: dict[int, int] = EXPECTED_PARENTS) -> DataFrame:
    """Per foundational requirement: its parents and enhancements, and whether the parents are as many as expected."""
    e = records.sparkSession.createDataFrame(list(expected.items()), "foundational_requirement int, expected_sr_count long")
    n = records.groupBy("foundational_requirement").agg(F.count_if(F.col("type") == "SR").alias("sr_count"), F.count_if(F.col("type") == "RE").alias("re_count"))
    return e.join(n, "foundational_requirement", "left").na.fill(0).withColumn("matches", F.col("sr_count") == F.col("expected_sr_count"))
