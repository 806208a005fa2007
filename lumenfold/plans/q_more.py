"""Scans, displays, orders and the remaining scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.functions import hierarchy as h
from lumenfold.functions import text as t
from lumenfold.operators import consolidate as C
from lumenfold.operators import joins as J
from lumenfold.operators.numbering import numbered
from lumenfold.plans.standins import CTE, candidates, rules, targets
from lumenfold.session import table
from lumenfold.sources import documents as D
from lumenfold.sources import sinks as K


def page_previews(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").withColumn("page_number", F.col("turn") + 1)
    return D.previews(D.page_range(pages, 2, 4), 70).select("conv_id", "page_number", "preview")


def aliased(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("value").cast("string")).alias("relative_score"), F.when(F.col("event_id") % 3 == 0, F.lit("bad")).otherwise(F.col("event_id").cast("string")).alias("score"))
    v = D.first_of("similarity", "relative_score", "score", kind="double")(e)
    return e.select("event_id", F.round(F.coalesce(v, F.lit(-1.0)), 6).alias("value"))


def id_order(spark, sf_dir):
    k = F.col("p_partkey")
    ids = table(spark, sf_dir, "part").select(F.concat(F.lit("SR "), k % 7 + 1, F.lit("."), k % 13, F.when(k % 2 == 0, F.concat(F.lit(" RE "), k % 11 + 1)).otherwise("")).alias("id")).distinct()
    numeric, plain = numbered(ids, h.sort_key(F.col("id")), "numeric"), numbered(ids, ["id"], "plain")
    return numeric.join(plain, "id").select("id", *[(F.col(c) + 1).cast("int").alias(c) for c in ("numeric", "plain")])


def verdict_order(spark, sf_dir):
    """MAYBE, YES, NO, then score: all candidates in this order, with their place in it (by ranges, without one task for all)."""
    order = F.when(F.col("verdict") == "MAYBE", 0).when(F.col("verdict") == "YES", 1).otherwise(2)
    return numbered(candidates(spark, sf_dir), [order, F.desc("relative_score"), "source_id", "target_id"], "place").select("place", "verdict", "source_id", "target_id", F.round("relative_score", 6).alias("relative_score"))


def headings(spark, sf_dir):
    forms = ["Problematic code", "## **Correct** `Code`:", "Rationale - why", "Exceptions (rare)", "Related [rules](x)", "problematic_code", "Correctness", "Correct usage of quotes", "Quote foo_bar_baz to 2*3*4", "Bad code", "Correct code #2"]
    p = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*[F.lit(x) for x in forms]), (F.col("p_partkey") % len(forms) + 1).cast("int")).alias("x"))
    shown = t.visible_heading(F.regexp_replace("x", r"^#+\s*", ""))
    return p.select("p_partkey", shown.alias("shown"), t.heading_category(shown).alias("c")).select("p_partkey", "shown", F.coalesce("c.category", F.lit("")).alias("category"), "c.qualified")


def plain_texts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    md = F.concat(F.lit("# "), "p_name", F.lit("\r\n\r\n* see [the page](http://x/y) and `code`\r\n```\r\nfenced\r\n```\r\n**Brand** | "), "p_brand", F.lit(" (Scored)\r\n## Rationale:\r\nSee also: https://x.y/z\r\n# DL3001\r\nend-of_text"))
    return p.select("p_partkey", t.wiki_plain(t.newlines(md)).alias("plain"), t.strip_scored(F.concat("p_brand", F.lit(" | (Not Scored) x"))).alias("scored"), t.remove_artefacts(F.concat("p_brand", F.lit(" VOID end void"))).alias("clean"))


def gaps(spark, sf_dir):
    """Gap of the first two scores by window, and its two binnings."""
    w = Window.partitionBy("source_id").orderBy("rank")
    c = candidates(spark, sf_dir).withColumn("second", F.lead("relative_score").over(w)).where("rank = 1")
    gap = F.col("relative_score") - F.col("second")
    return c.select("source", "source_id", F.round(F.coalesce(gap, F.lit(-1.0)), 6).alias("gap"), t.gap_bin(gap).alias("sampler_bin"), F.coalesce(t.audit_gap_bin(gap), F.lit("")).alias("audit_bin"))


def full_association(spark, sf_dir):
    """Candidates with their rule's text and both dimensions' records: three joins by key."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("target_id"), F.col("text").alias("rationale"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "lang")
    c = candidates(spark, sf_dir).select("source_id", "target_id", "rank")
    out = J.enrich(J.enrich(c, targets(spark, sf_dir).select("target_id", "target_type"), "target_id"), d, "source_id", "skip")
    out = J.conditional_lookup(out, b, "target_id", F.col("target_type") == "SR", {"rationale": F.lit("")})
    return out.select("source_id", "target_id", "rank", "target_type", "lang", F.sha2("rationale", 256).alias("rationale"), t.filled(F.col("rationale")).alias("available"))


def passages():
    """Parts that cover the whole text: its first half, two thirds of it, the middle half, the rest, and nothing."""
    x, n = F.col("text"), F.length("text")
    cut = lambda a, k: F.substring(x, a.cast("int"), k.cast("int"))
    one, half = F.lit(1), F.floor(n / 2)
    return F.array(cut(one, half), cut(one, F.floor(2 * n / 3)), cut(F.floor(n / 4) + 1, half), cut(half + 1, n), F.lit(""))


def drop_contained(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(C.drop_contained(passages()), "¦").alias("kept"))


def merge_texts(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", C.merge_texts(passages()).alias("merged"))


def fenced_json(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("```json\n{\"verdict\": \""), F.when(F.col("o_orderkey") % 2 == 0, "YES").otherwise("NO"), F.lit("\", \"confidence\": "), F.col("o_orderkey") % 5 + 1, F.lit("}\n```")).alias("a"))
    r = F.from_json(t.strip_code_fence(F.col("a")), "verdict string, confidence int")
    return o.select("o_orderkey", r.alias("r")).select("o_orderkey", "r.*")


def source_split(spark, sf_dir):
    return rules(spark, sf_dir).where("source = 'odd'").unionByName(rules(spark, sf_dir).where("source = 'even'")).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("distinct_rules"))


def union_columns(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("nation")), table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("string").alias("region"))
    return K.union_all(n, r).na.fill("")


def rule_overlap(spark, sf_dir):
    """Rules in both of two sets, and in the first alone."""
    a, b = rules(spark, sf_dir).where("source_id % 2 = 0").select("source_id"), rules(spark, sf_dir).where("source_id % 3 = 0").select("source_id")
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.exceptAll(b).withColumn("side", F.lit("first")))


def ordered_digest(spark, sf_dir):
    c = candidates(spark, sf_dir).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("target_id").cast("string").alias("t")))).alias("x"))
    return c.select("source_id", t.ordered_ids_digest(F.transform("x", lambda s: s["t"])).alias("digest"))


def display(spark, sf_dir):
    c = candidates(spark, sf_dir).groupBy("source_id").agg(F.max("relative_score").alias("top"), F.array_sort(F.collect_list(F.col("target_id").cast("int"))).alias("targets"))
    return K.display(c)


QUERIES = {
    "page_previews": page_previews, "alias_coalescing": aliased, "id_order": id_order, "verdict_order": verdict_order, "heading_categories": headings, "plain_texts": plain_texts, "top_gaps": gaps,
    "full_association": full_association, "drop_contained": drop_contained, "merge_texts": merge_texts, "fenced_json": fenced_json, "source_split": source_split, "union_columns": union_columns, "rule_overlap": rule_overlap,
    "ordered_digest": ordered_digest, "display_rows": display,
    "canonical_json": lambda s, p: K.canonical_json(table(s, p, "nation").select("n_nationkey", "n_name", "n_regionkey", F.lit(None).cast("string").alias("a")), "n_nationkey"),
}

WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
PASSAGES = "[substr(text, 1, len(text) // 2), substr(text, 1, 2 * len(text) // 3), substr(text, len(text) // 4 + 1, len(text) // 2), substr(text, len(text) // 2 + 1)]"
ORACLE_SQL = {
    "page_previews": rf"SELECT conv_id, turn + 1 AS page_number, left(regexp_replace(regexp_replace(regexp_replace(text, '{WS}+', ' ', 'g'), '^ ', ''), ' $', ''), 70) preview FROM conversations WHERE turn BETWEEN 1 AND 3",
    "alias_coalescing": "SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN value WHEN event_id % 3 = 0 THEN -1 ELSE event_id END, 6) AS value FROM events",
    "id_order": """WITH i AS (SELECT DISTINCT p_partkey % 7 + 1 a, p_partkey % 13 b, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 11 + 1 ELSE 0 END c FROM part), j AS (SELECT *, 'SR ' || a || '.' || b || CASE WHEN c > 0 THEN ' RE ' || c ELSE '' END id FROM i)
SELECT id, CAST(row_number() OVER (ORDER BY a, b, c) AS INT) AS numeric, CAST(row_number() OVER (ORDER BY id) AS INT) AS plain FROM j""",
    "verdict_order": CTE + "SELECT row_number() OVER (ORDER BY CASE verdict WHEN 'MAYBE' THEN 0 WHEN 'YES' THEN 1 ELSE 2 END, cand.relative_score DESC, source_id, target_id) - 1 AS place, verdict, source_id, target_id, round(relative_score, 6) relative_score FROM cand",
    "heading_categories": """SELECT p_partkey, v.shown, v.category, v.qualified FROM part JOIN (VALUES (0, 'Problematic code', 'problematic_code', false), (1, 'Correct Code:', 'correct_code', false), (2, 'Rationale - why', 'rationale', true), (3, 'Exceptions (rare)', 'exceptions', true),
(4, 'Related rules', '', false), (5, 'problematic_code', 'problematic_code', false), (6, 'Correctness', '', false), (7, 'Correct usage of quotes', '', false), (8, 'Quote foo_bar_baz to 2*3*4', '', false), (9, 'Bad code', '', false), (10, 'Correct code #2', 'correct_code', true))
v(k, shown, category, qualified) ON v.k = p_partkey % 11""",
    "plain_texts": "SELECT p_partkey, p_name || ' see the page and code Brand ' || replace(p_brand, '#', '') || ' (Scored) endoftext' plain, p_brand || ' x' scored, p_brand || ' end' clean FROM part",
    "top_gaps": CTE + """, g AS (SELECT a.source, a.source_id, a.relative_score - b.relative_score gap FROM cand a LEFT JOIN cand b ON b.source_id = a.source_id AND b.rank = 2 WHERE a.rank = 1)
SELECT source, source_id, round(coalesce(gap, -1), 6) gap, CASE WHEN gap IS NULL THEN 'no_gap' WHEN gap < 0.05 THEN 'very_low_gap' WHEN gap < 0.1 THEN 'low_gap' WHEN gap < 0.2 THEN 'medium_gap' ELSE 'high_gap' END sampler_bin,
CASE WHEN gap IS NULL THEN '' WHEN gap < 0.05 THEN 'very_low_gap' WHEN gap < 0.1 THEN 'low_gap' WHEN gap < 0.2 THEN 'medium_gap' ELSE 'high_gap' END audit_bin FROM g""",
    "full_association": CTE + "SELECT c.source_id, c.target_id, c.rank, c.target_type, d.lang, sha256(CASE WHEN c.target_type = 'SR' THEN coalesce(b.text, '') ELSE '' END) rationale, c.target_type = 'SR' AND coalesce(b.text, '') <> '' available FROM cand c JOIN documents d ON d.doc_id = c.source_id LEFT JOIN benchmark b ON b.item_id = c.target_id",
    "drop_contained": f"""WITH p AS (SELECT item_id, list_distinct(list_filter({PASSAGES}, lambda x: x <> '')) d FROM benchmark)
SELECT item_id, array_to_string(list_transform(list_sort(list_transform(list_filter(d, lambda t: len(list_filter(d, lambda o: len(o) > len(t) AND contains(o, t))) = 0), lambda t: {{'n': -len(t), 't': t}})), lambda s: s.t), '¦') kept FROM p""",
    "merge_texts": f"""WITH p AS (SELECT item_id, list_filter({PASSAGES}, lambda x: x <> '') d FROM benchmark),
h AS (SELECT item_id, CASE WHEN len(d) > 0 THEN list_reduce(list_transform(d, lambda x: [x]), lambda a, b: CASE WHEN len(list_filter(a, lambda o: contains(o, b[1]) OR contains(b[1], o))) > 0 THEN a ELSE list_concat(a, b) END) END d FROM p)
SELECT item_id, CASE WHEN len(d) > 0 THEN list_reduce(d, lambda a, b: CASE WHEN len(b) > len(a) THEN b ELSE a END) END merged FROM h""",
    "fenced_json": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'YES' ELSE 'NO' END verdict, (o_orderkey % 5 + 1)::INT confidence FROM orders",
    "source_split": CTE + "SELECT source, count(*) n, count(DISTINCT source_id) distinct_rules FROM rules GROUP BY 1",
    "union_columns": "SELECT n_name AS name, n_nationkey::VARCHAR nation, '' region FROM nation UNION ALL SELECT r_name, '', r_regionkey::VARCHAR FROM region",
    "rule_overlap": CTE + "SELECT source_id, CASE WHEN source_id % 3 = 0 THEN 'both' ELSE 'first' END side FROM rules WHERE source_id % 2 = 0",
    "ordered_digest": CTE + "SELECT source_id, sha256(string_agg(target_id || chr(10), '' ORDER BY rank)) digest FROM cand GROUP BY 1",
    "display_rows": CTE + "SELECT source_id, printf('%.6f', max(relative_score)) top, string_agg(target_id::VARCHAR, ', ' ORDER BY target_id) targets FROM cand GROUP BY 1",
    "canonical_json": """SELECT n_nationkey, '{"a":null,"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS value FROM nation""",
}
