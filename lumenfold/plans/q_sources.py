"""Scans, sinks, curations and batch control: a table is written in the shape that a scan reads, and read back."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions import markdown as M
from lumenfold.functions import text as t
from lumenfold.operators import batches as B
from lumenfold.operators import encode as E
from lumenfold.operators import joins as J
from lumenfold.operators import labels as L
from lumenfold.plans.standins import CTE, candidates, rules
from lumenfold.session import scratch, table
from lumenfold.sources import documents as D
from lumenfold.sources import sinks as K

NATION = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("region", T.LongType())])


def nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"), F.col("n_nationkey").alias("k"))


def json_object(spark, sf_dir):
    path = scratch(spark, "object")
    K.write_json_object(nations(spark, sf_dir), path, "id", "k")
    return D.json_object(spark, path, NATION)


def large_object(spark, sf_dir):
    """All customers through one JSON object, written and read in parts."""
    path = scratch(spark, "customers")
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("region"), F.col("c_custkey").alias("k"))
    K.write_json_object(c, path, "id", "k")
    return D.json_object(spark, path, NATION)


def cached_vectors(spark, sf_dir):
    """All embeddings through a vector cache, held against its sidecar."""
    path = scratch(spark, "vectors")
    K.write_vector_cache(table(spark, sf_dir, "embeddings"), path, "vec_id", "embedding", "vec_id", model="given")
    return D.vector_cache(spark, path, model="given").select("id", "ord", F.size("vector").alias("dimension"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


def json_list(spark, sf_dir):
    path = scratch(spark, "list") + ".json"
    rows = [r.asDict() for r in nations(spark, sf_dir).orderBy("k").drop("k").collect()]  # 25 nations
    K.write_text(spark, json.dumps({"requirements": rows}, indent=1), path)
    return D.json_list(spark, path, NATION)


def csv_windows(spark, sf_dir):
    """Euro signs are byte 0x80 in that charset."""
    path = scratch(spark, "csv")
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" \x80 é; x")).alias("name"))
    p.write.csv(path, sep=";", encoding="iso-8859-1", header=True)
    return D.csv_windows(spark, path, "p_partkey long, name string")


def xml_rows(spark, sf_dir):
    path = scratch(spark, "xml")
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").write.format("xml").option("rowTag", "rule").option("rootTag", "rules").save(path)
    return D.xml_rows(spark, path, "rule", "s_suppkey long, s_name string")


def text_files(spark, sf_dir):
    """A document for each region, and one that the name pattern leaves out; then its lines by an injected decoder of pages."""
    folder = scratch(spark, "files")
    for r in table(spark, sf_dir, "region").collect():  # five regions
        K.write_text(spark, f"# {r['r_name']}\nbody", f"{folder}/DL{r['r_regionkey']:04d}.md")
    K.write_text(spark, "other", f"{folder}/notes.txt")
    files = D.text_files(spark, folder, r"(?i)^dl\d{4}\.MD$", expected=5)
    pages = D.decoded_pages(spark, folder, lambda b: iter(b.decode().split("\n"))).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "page_number", F.col("text").alias("page"))
    return files.join(pages, "name").select("name", "text", "page_number", "page")


def table_sink(spark, sf_dir):
    """A written table stays as it is when it is written again, unless overwriting is asked for; its sidecar says what it holds."""
    path = scratch(spark, "sink")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    K.write_table(s, path)
    try:
        K.write_table(s.limit(1), path)
        refused = False
    except Exception:  # noqa: BLE001 - Spark's own error of a path that is there
        refused = True
    first = spark.read.parquet(path).count()
    told = K.sidecar(s, path + ".json", {"supplier": s}, source="supplier")
    same = told["content_digest"] == told["inputs"]["supplier"]["content_digest"] == K.sidecar(spark.read.parquet(path), path + "-2.json")["content_digest"]
    K.write_table(s.where("s_suppkey % 2 = 0"), path, overwrite=True)
    return spark.createDataFrame([(refused, first, told["rows"], same, spark.read.parquet(path).count())], "refused boolean, first long, told long, same boolean, second long")


def curated(spark, sf_dir):
    """Curations of part documents: quoted lines and digests that hold or don't, and values that fill, replace, repeat or meet nothing."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    docs = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("first\r\n"), "p_name", F.lit(" line\nlast")).alias("markdown"))
    cur = p.select(F.col("p_partkey").alias("id"), F.when(k % 3 == 0, 1).otherwise(2).alias("start_line"), F.lit(2).alias("end_line"), F.when(k % 5 == 0, "absent").otherwise(F.col("p_name")).alias("exact_text"), F.col("p_brand").alias("value"), F.sha2(F.when(k % 7 == 0, F.lit("x")).otherwise(F.col("p_brand")), 256).alias("value_sha256"))
    return M.verify_curations(cur, docs, ["id"]).select("id", "valid")


def curation_problems(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    rules_ = p.where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("id"), F.when(k % 2 == 0, F.col("p_name")).alias("title"), F.lit(None).cast("string").alias("rationale"))
    cur = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.lit("title").alias("field"), F.col("p_brand").alias("value"), (k % 4 == 0).alias("allow_replace_non_null"))
    cur = cur.unionAll(cur.where("id % 15 = 0"))
    out, told = M.apply_curations(rules_, cur)
    return out.select("id", F.coalesce("title", F.lit("")).alias("title"), F.lit("").alias("code")).unionAll(told.select("id", F.lit(""), "code"))


def resolution(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    r = p.select(F.col("p_partkey").alias("id"), F.when(k % 2 == 0, "a").alias("problematic_code"), F.when(k % 3 == 0, "").otherwise("b").alias("correct_code"))
    reviews = p.where("p_partkey % 5 < 2").select(F.col("p_partkey").alias("id"), F.lit("problematic_code").alias("field"), F.when(k % 5 == 0, "A").otherwise("B").alias("classification"))
    found = M.field_resolution(r, reviews, ["id"], ["problematic_code", "correct_code"])
    held = M.publication_problems(found).groupBy(F.concat(F.lit("held_"), "code").alias("state")).agg(F.count("*").alias("n"))
    return found.groupBy("state").agg(F.count("*").alias("n")).unionAll(held)


def sets(spark, sf_dir):
    """Set equality and subset of rules, their multiples and an altered copy."""
    r = rules(spark, sf_dir)
    cases = {"same": (r, r.orderBy(F.desc("source_id"))), "fewer": (r.where("source_id % 2 = 0"), r), "more": (r, r.where("source_id % 2 = 0")), "twice": (r.unionAll(r), r)}
    return spark.createDataFrame([(n, J.same_set(a, b, ["source", "source_id"]), J.subset(a, b, ["source", "source_id"])) for n, (a, b) in cases.items()], "name string, same boolean, subset boolean")


def names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    short = F.element_at(F.array(*[F.lit(x) for x in ("FL", " sc ", "first", "Second")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return p.select("p_partkey", t.full_source_name(short, {"fl": "first", "sc": "second"}).alias("name"))


def titles(spark, sf_dir):
    """Rule summaries with the first title that isn't null, and the set of verdicts of a rule held against a wanted set."""
    c = candidates(spark, sf_dir).withColumn("title", F.when(F.col("rank") > 1, F.concat(F.lit("t"), "target_id")))
    s = L.rule_summary(c, "title")
    held = c.groupBy("source_id").agg(F.array_sort(F.collect_set("verdict")).alias("v"))
    return s.join(held, "source_id").select("source_id", F.coalesce("title", F.lit("")).alias("title"), F.arrays_overlap("v", F.array(F.lit("YES"), F.lit("MAYBE"))).alias("some"), (F.size(F.array_except("v", F.array(F.lit("NO"), F.lit("MAYBE")))) == 0).alias("only"))


def retried(spark, sf_dir):
    """Batches whose calls fail for a while, for good, or until they are halved; by both policies of halving."""
    b = B.batch_manifest(B.pair_manifest(candidates(spark, sf_dir).select("source_id", "rank", F.concat_ws(":", "source_id", "rank").alias("pair_id")), ["source_id", "rank"]), 8, "pair_id")

    def call(items):
        first = int(items[0].split(":")[0])
        if first % 7 == 3:
            raise TimeoutError("always")
        if len(items) > 3 and first % 2 == 0:
            raise B.InvalidAnswer("too many")
        return items

    one = B.call_batches(b, call, attempts=3, sleep=lambda s: None).withColumn("policy", F.lit("invalid"))
    two = B.call_batches(b, call, split_on=(Exception,), attempts=2, sleep=lambda s: None).withColumn("policy", F.lit("any"))
    log = F.from_json("requests", "array<struct<size int>>")
    return one.unionAll(two).select("policy", "batch_id", F.coalesce("error", F.lit("")).alias("error"), F.size(log).alias("requests"))


def encoded(spark, sf_dir):
    """Unit vectors of texts by a stand-in encoder (length and a constant), and the checks of a fingerprint and of forbidden names."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).alias("text"))
    e = E.encode(p, "p_partkey", "text", lambda: lambda texts: np.array([[len(x), 4.0] for x in texts]))
    bad = E.forbidden_fields(p.select(F.struct("p_partkey", F.col("text").alias("llm_verdict")).alias("x")), ["llm_verdict"])
    return e.select("p_partkey", F.round(e["embedding"][0].cast("double"), 5).alias("first"), F.lit(B.fingerprint(b=2, a="é")).alias("fingerprint"), F.lit(",".join(bad)).alias("forbidden"))


def json_keys(spark, sf_dir):
    """Forbidden keys of JSON documents made of turns; texts that spell a key are not keys."""
    text = F.concat(F.lit('"assistant": \\'), F.coalesce("text", F.lit("")), F.lit('"'))
    doc = F.to_json(F.struct(text.alias("text"), F.array(F.create_map(F.col("role"), F.struct(F.col("turn").alias("human_label")))).alias("turns")))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", doc.alias("doc"))
    return c.select("conv_id", "turn", F.array_join(E.forbidden_keys(F.col("doc"), ["human_label", "assistant"]), ",").alias("forbidden"))


QUERIES = {
    "json_object_scan": json_object, "json_object_parts": large_object, "vector_cache_scan": cached_vectors, "json_list_scan": json_list, "csv_windows_scan": csv_windows, "xml_scan": xml_rows, "text_file_scan": text_files, "table_sink": table_sink, "curation_evidence": curated, "curation_problems": curation_problems,
    "field_resolution": resolution, "set_checks": sets, "full_source_names": names, "rule_titles": titles, "retried_batches": retried, "encoded_texts": encoded, "forbidden_json_keys": json_keys,
}
ORACLE_SQL = {
    "json_object_parts": "SELECT row_number() OVER (ORDER BY c_custkey) - 1 ord, 'c' || c_custkey id, c_name AS name, c_nationkey::BIGINT region FROM customer",
    "vector_cache_scan": "SELECT vec_id::VARCHAR id, vec_id::BIGINT ord, len(embedding)::INT dimension, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) total FROM embeddings",
    "json_object_scan": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 ord, 'n' || n_nationkey id, n_name AS name, n_regionkey::BIGINT region FROM nation",
    "json_list_scan": "SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INT ord, 'n' || n_nationkey id, n_name AS name, n_regionkey::BIGINT region FROM nation",
    "csv_windows_scan": "SELECT p_partkey, p_name || ' € é; x' AS name FROM part",
    "xml_scan": "SELECT s_suppkey, s_name FROM supplier",
    "text_file_scan": "SELECT 'DL' || lpad(r_regionkey::VARCHAR, 4, '0') || '.md' AS name, '# ' || r_name || chr(10) || 'body' AS text, p::INT page_number, CASE p WHEN 1 THEN '# ' || r_name ELSE 'body' END page FROM region, range(1, 3) x(p)",
    "table_sink": "SELECT true refused, count(*) AS first, count(*) told, true same, count(*) FILTER (s_suppkey % 2 = 0) AS second FROM supplier",
    "curation_evidence": "SELECT p_partkey id, p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 valid FROM part",
    "curation_problems": """WITH c AS (SELECT p_partkey id, p_brand v FROM part WHERE p_partkey % 3 = 0)
SELECT p_partkey id, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END title, '' code FROM part WHERE p_partkey % 11 <> 0
UNION ALL SELECT id, '', CASE WHEN id % 15 = 0 THEN 'duplicate_curation' WHEN id % 11 = 0 THEN 'unused_source_curation' ELSE 'replaces_non_null' END FROM c WHERE id % 15 = 0 OR id % 11 = 0 OR (id % 2 = 0 AND id % 4 <> 0)""",
    "field_resolution": """WITH f AS (SELECT p_partkey k, 'problematic_code' f, p_partkey % 2 = 0 filled, CASE WHEN p_partkey % 5 = 0 THEN 'A' WHEN p_partkey % 5 = 1 THEN 'B' END r FROM part UNION ALL SELECT p_partkey, 'correct_code', p_partkey % 3 <> 0, NULL FROM part),
s AS (SELECT CASE WHEN filled AND r IS NULL THEN 'filled' WHEN filled THEN 'stale' WHEN r IS NOT NULL THEN 'reviewed_' || r ELSE 'unreviewed' END state FROM f)
SELECT state, count(*) n FROM s GROUP BY 1 UNION ALL SELECT 'held_' || state, count(*) FROM s WHERE state NOT IN ('filled', 'reviewed_A') GROUP BY 1""",
    "set_checks": "SELECT * FROM (VALUES ('same', true, true), ('fewer', false, true), ('more', false, false), ('twice', false, true)) v(name, same, subset)",
    "full_source_names": "SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 2) THEN 'first' ELSE 'second' END AS name FROM part",
    "rule_titles": CTE + "SELECT source_id, coalesce('t' || min(target_id) FILTER (rank = 2), '') title, count(*) FILTER (verdict <> 'NO') > 0 AS some, count(*) FILTER (verdict = 'YES') = 0 AS only FROM cand GROUP BY 1",
    "forbidden_json_keys": "SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'assistant,' ELSE '' END || 'human_label' forbidden FROM conversations",
    "encoded_texts": """SELECT p_partkey, round(CASE WHEN p_partkey % 3 > 0 THEN len(p_name) / sqrt(len(p_name) * len(p_name) + 16) ELSE 0 END, 5) AS first, sha256('{"a":"é","b":2}') fingerprint, 'x.llm_verdict' forbidden FROM part""",
}
