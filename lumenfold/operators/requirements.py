"""Requirement records extracted from page blocks: collection, cleaning, validation, rationales."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import hierarchy as h
from lumenfold.functions import text as t
from lumenfold.operators.consolidate import drop_contained, longest
from lumenfold.operators.joins import require


def collect_candidates(blocks: DataFrame, items: str = "requirements") -> DataFrame:
    """(block columns, place, fields) of every record nested in every block."""
    return blocks.select(*[c for c in blocks.columns if c != items], F.posexplode(items).alias("place", "_r")).select("*", "_r.*").drop("_r")


def sanitize(records: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Records with canonical ids, their type, numbers and parent read off the id, and cleaned text; records without a whole id or without text are dropped."""
    r = records.withColumn(key, h.canonical_id(F.col(key))).withColumn(text, t.remove_artefacts(F.col(text)))
    r = r.where(F.col(key).isNotNull() & t.filled(F.col(text))).withColumn("_s", h.parse_id(F.col(key)))
    own = [c for c in r.columns if c not in ("type", "fr", "parent_sr", "_s")]
    return r.select(*own, F.col("_s.type").alias("type"), F.col("_s.fr").alias("fr"), F.coalesce(F.col("_s.parent"), F.col(key)).alias("parent_sr"))


def validate_rationales(candidates: DataFrame, known: DataFrame, markers: Sequence[str], key: str = "id", text: str = "text", pages: str = "source_pages", least: int = 20) -> DataFrame:
    """Candidates of known ids whose collapsed text is long enough and free of the markers; pages distinct, sorted, positive."""
    c = candidates.join(known.select(key).distinct(), key, "left_semi").withColumn(text, t.collapse(F.col(text), True))
    c = c.where(t.valid_passage(F.col(text), list(markers), least))
    return c.withColumn(pages, F.array_sort(F.array_distinct(F.filter(pages, lambda p: p.isNotNull() & (p > 0)))))


def consolidate_rationales(rows: DataFrame, key: str = "id", text: str = "text", block: str = "block_id", pages: str = "source_pages", confidence: str = "confidence") -> DataFrame:
    """Per id: texts without those that another contains, joined over their overlaps in block order; sorted pages and blocks; mean confidence (6 digits), occurrences."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct(block, text))), lambda s: s[text])
    g = rows.groupBy(key).agg(
        in_order.alias("_texts"), F.array_sort(F.collect_set(block)).alias("blocks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(pages)))).alias(pages),
        F.round(F.avg(confidence), 6).alias("mean_confidence"), F.count("*").alias("occurrences"))
    kept = t.let(drop_contained(F.col("_texts")), lambda d: F.filter(F.array_distinct("_texts"), lambda x: F.array_contains(d, x)))
    return g.withColumn("_kept", kept).withColumn(text, t.merge_overlaps(F.col("_kept"))).withColumn("longest", longest(F.col("_kept"))).drop("_texts", "_kept")


def dataset_problems(records: DataFrame, expected: DataFrame | None = None, key: str = "id") -> DataFrame:
    """(id, problem) of a requirement dataset: bad_id, repeated, type, parent (an RE whose SR is missing), no_text, and missing or extra against the expected ids."""
    r = records.withColumn("_s", h.parse_id(F.col(key))).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    parents = records.where("type = 'SR'").select(F.col(key).alias("_parent"), F.lit(True).alias("_there")).distinct()
    r = r.join(parents, F.col("_s.parent") == F.col("_parent"), "left")
    tests = {"bad_id": F.col("_s.type").isNull(), "repeated": F.col("_n") > 1, "type": F.col("_s.type") != F.col("type"), "parent": F.col("_s.parent").isNotNull() & F.col("_there").isNull(), "no_text": ~t.filled(F.col("text"))}
    hit = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in tests.items()]), lambda x: x.isNotNull())
    out = r.select(key, F.explode(hit).alias("problem")).distinct()
    if expected is not None:
        from lumenfold.operators.joins import missing_and_extra

        out = out.unionByName(missing_and_extra(expected, records, key).withColumnRenamed("side", "problem"))
    return out


def merge_results(records: DataFrame, results: DataFrame, key: str, fields: Sequence[str], prefix: str = "llm_") -> DataFrame:
    """Records with their results' fields; a record without exactly one result, or a result without a record, stops the query."""
    r = results.groupBy(key).agg(F.count("*").alias("_n"), *[F.first(f).alias(f"{prefix}{f}") for f in fields])
    j = records.withColumn("_own", F.lit(True)).join(r, key, "full")
    j = require(j, F.col("_own").isNull() | F.col("_n").isNull() | (F.col("_n") > 1), "results and records do not match one to one")
    return j.drop("_own", "_n")
