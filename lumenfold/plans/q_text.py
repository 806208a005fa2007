"""Text function, consolidation and extraction queries over the driver's text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import hierarchy as h
from lumenfold.functions import text as t
from lumenfold.operators import consolidate as c
from lumenfold.operators.record_checks import CONTAMINATION as CONTAMINATION_PATTERNS
from lumenfold.session import spread, table

#: Marks of page furniture that contaminate extracted text.
CONTAMINATION = {"license": r"(?i)licensed under", "copyright": r"(?i)copyright|©", "email": r"[\w.+-]+@[\w-]+\.[\w.]+", "pipes": r"\|", "shouting": r"!!", "symbols": r"[#$%&*]{3}", "long_number": r"\d{9,}", "url": r"https?://", "hyphen_break": r"\w-\n\w"}


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def lines(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def normal_forms(spark, sf_dir):
    x = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.sha2(t.collapse(x), 256).alias("collapsed"), F.sha2(t.comparison_form(x), 256).alias("comparison"), t.word_count(x).alias("words"),
                                      F.left(t.collapse(x), F.lit(70)).alias("preview"), t.sha256(x).alias("digest"), t.modal_status(x, "the").alias("modal"), t.valid_passage(x, ["LICENSED", "!!"]).alias("valid"))


def contamination(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(t.tags(F.col("text"), CONTAMINATION), ",").alias("tags"))


def embedding_texts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", t.embedding_text(F.col("p_partkey").cast("string"), F.col("p_name"), {"Brand": F.when(F.col("p_size") > 10, F.col("p_brand")), "Type": F.col("p_type")}).alias("text"))


def ids(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("sr"), k % 7 + 1, F.lit("."), k % 13)).when(k % 3 == 1, F.concat(F.lit(" SR "), k % 7 + 1, F.lit(" . "), k % 13, F.lit("  re"), k % 4)).otherwise(F.concat(F.lit("XR "), k % 7))
    x = p.select("p_partkey", h.canonical_id(raw).alias("id"))
    return x.select("p_partkey", F.coalesce("id", F.lit("")).alias("id"), h.parse_id(F.col("id")).alias("s")).select("p_partkey", "id", F.coalesce("s.type", F.lit("")).alias("type"), *[F.coalesce(f"s.{f}", F.lit(-1)).alias(f) for f in ("fr", "sr", "re")], F.coalesce("s.parent", F.lit("")).alias("parent"))


def pair_ids(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return l.select("l_orderkey", "l_linenumber", t.ranked_pair_id(F.col("l_returnflag"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")).alias("ranked"), t.pair_id(target_id=F.col("l_partkey").cast("string"), source=F.col("l_returnflag"), source_id=F.col("l_orderkey").cast("string")).alias("pair"))


def gap_bins(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    gap = F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.round(F.col("value") % 1.3 - 0.1, 2)).cast("double")
    return e.select(gap.alias("gap")).groupBy(t.gap_bin(F.col("gap")).alias("sampler"), F.coalesce(t.audit_gap_bin(F.col("gap")), F.lit("(null)")).alias("auditor")).agg(F.count("*").alias("n"))


def coercion(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "n/a").when(F.col("event_id") % 5 == 1, "  ").otherwise(F.concat(F.lit(" "), F.col("event_id") / 4)).alias("raw"))
    return e.select("event_id", F.coalesce(F.nullif(F.trim("raw"), F.lit("")), F.lit("(blank)")).alias("clean"), F.coalesce(F.trim("raw").try_cast("double"), F.lit(-1.0)).alias("value"))


def consolidated(spark, sf_dir):
    """The lines of each document as its blocks; a source's documents would be a hot key that no task can hold."""
    rows = lines(spark, sf_dir).where("trim(text) <> ''").withColumn("pages", F.array((F.col("line") % 5).cast("int"), (F.col("line") % 3).cast("int")))
    rows = rows.withColumn("title", F.left("text", F.lit(20)))
    out = c.consolidate(rows, "doc_id", "title", "text", "line", "pages", [F.min("source").alias("source")])
    return out.select("doc_id", "source", "title", "text", F.size("blocks").alias("blocks"), F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"), "occurrences")


def grep(spark, sf_dir):
    from lumenfold.sources.documents import grep_context

    return grep_context(docs(spark, sf_dir), "doc_id", "text", r"(?i)license", 5, 10)


def change_categories(spark, sf_dir):
    x = F.col("text")
    f = t.first_category(license=x.rlike("(?i)license"), email=x.rlike("@"), pipes=F.contains(x, F.lit("|")), long=F.length(x) > 3000)
    return docs(spark, sf_dir).select("doc_id", f.alias("f")).select("doc_id", F.coalesce("f.primary", F.lit("")).alias("primary"), F.array_join("f.others", ",").alias("others"))


def error_classes(spark, sf_dir):
    messages = ["429 RESOURCE_EXHAUSTED quota", "invalid API key", "deadline exceeded: timed out", "model not found", "HTTP 503 unavailable", "odd failure", "rate limit; connection reset", "connection refused", "Permission denied", "not found", "Connection reset by peer"]
    o = table(spark, sf_dir, "orders").select(F.element_at(F.array(*[F.lit(x) for x in messages]), (F.col("o_orderkey") % len(messages) + 1).cast("int")).alias("m"))
    return o.groupBy(t.error_class(F.col("m")).alias("class")).agg(F.count("*").alias("n"))


def tag_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_name", " ", ",").alias("x"))
    return p.select("p_partkey", F.array_join(t.paired_tags(F.col("x")), "|").alias("pairs"))


def grouped_texts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return c.group_texts(p, F.array("p_brand", F.split("p_type", " ")[0]), "p_name", "p_partkey").select("tag", F.sha2("p_name", 256).alias("digest"))


def uncontained_texts(spark, sf_dir):
    """By brand: part names, their beginnings and their second words, without those that a longer one contains."""
    p = table(spark, sf_dir, "part")
    w = F.split("p_name", " ")
    texts = p.select("p_brand", F.explode(F.array("p_name", F.concat_ws(" ", F.slice(w, 1, 2)), F.element_at(w, 2), F.concat(F.element_at(w, 1), F.lit(" "), F.element_at(w, -1)))).alias("text"))
    return c.uncontained(texts, "p_brand", "text")


def similar_lines(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    d = b.select(F.col("item_id").alias("a"), F.col("text").alias("ta")).join(b.select((F.col("item_id") - 1).alias("a"), F.col("text").alias("tb")), "a")
    return d.select("a", F.round(t.similarity_ratio(F.col("ta"), F.col("tb")), 6).alias("ratio"), t.prefix_variant(F.col("ta"), F.col("tb")).alias("prefix"))


def prefix_variants(spark, sf_dir):
    """Beginnings among neighbouring items: an item beside its own first half, and beside the next item."""
    b = table(spark, sf_dir, "benchmark")
    half = F.substring("text", 1, F.floor(F.length("text") / 2).cast("int"))
    n = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next"))
    return b.join(n, "item_id").select("item_id", t.prefix_variant(half, F.col("text")).alias("own"), t.prefix_variant(F.col("text"), F.col("next")).alias("next"))


def contamination_patterns(spark, sf_dir):
    """The requirement audit's nine patterns over texts of which some carry what they look for."""
    marks = ["", " Rationale and  supplemental guidance", " requirement enhancement", " Security Levels", " copyright", " Not for resale", " provided BY x", " Licensee=y", " void", " --`,`,,`-- ", " avoid --"]
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    pick = lambda i: F.element_at(F.array(*[F.lit(m) for m in marks]), (i % len(marks) + 1).cast("int"))
    x = p.select("p_partkey", F.concat("p_name", pick(k), pick(F.floor(k / 3))).alias("text"))
    return x.select("p_partkey", F.array_join(t.tags(F.col("text"), CONTAMINATION_PATTERNS), ",").alias("tags"))


def match_forms(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(t.match_form(F.col("text")), 256).alias("form"))


def overlap_merge(spark, sf_dir):
    """Each whole text in parts of 60 words, a part every 30, and merged again."""
    w = F.split(t.collapse(F.col("text")), " ")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 30), F.lit(30))
    parts = spread(docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", w.alias("w")).select("doc_id", F.transform(starts, lambda i: F.array_join(F.slice("w", i, 60), " ")).alias("parts"))
    return parts.select("doc_id", F.length(t.merge_overlaps(F.col("parts"))).alias("n"))


def sql_tags(x):
    case = " || ".join(f"CASE WHEN regexp_matches({x}, '{p}') THEN '{n},' ELSE '' END" for n, p in CONTAMINATION.items())
    return f"rtrim({case}, ',')"


#: Unicode white space, spelled out for DuckDB.
WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
COLLAPSE = rf"regexp_replace(regexp_replace(regexp_replace(text, '{WS}+', ' ', 'g'), '^ ', ''), ' $', '')"

QUERIES = {
    "text_normal_forms": normal_forms, "contamination_tags": contamination, "embedding_texts": embedding_texts, "canonical_ids": ids, "pair_ids": pair_ids, "gap_bins": gap_bins,
    "value_coercion": coercion, "uncontained_texts": uncontained_texts, "consolidated_texts": consolidated, "grep_context": grep, "change_categories": change_categories, "error_classes": error_classes, "paired_tags": tag_pairs,
    "grouped_texts": grouped_texts, "similarity_ratio": similar_lines, "prefix_variants": prefix_variants, "contamination_patterns": contamination_patterns, "match_forms": match_forms, "overlap_merge": overlap_merge,
}
ORACLE_SQL = {
    "text_normal_forms": rf"""SELECT doc_id, sha256({COLLAPSE}) collapsed, sha256(translate(lower({COLLAPSE}), '’‘“”', '''''""')) comparison, CASE WHEN {COLLAPSE} = '' THEN 0 ELSE len(string_split({COLLAPSE}, ' ')) END::INT words,
left({COLLAPSE}, 70) preview, sha256(text) digest, CASE WHEN contains(' ' || lower({COLLAPSE}) || ' ', ' the ') THEN 'pass' WHEN {COLLAPSE} <> '' THEN 'warning' ELSE 'fail' END modal, len(text) >= 20 AND NOT regexp_matches(lower(text), 'licensed|!!') valid FROM documents""",
    "contamination_tags": f"SELECT doc_id, {sql_tags('text')} tags FROM documents",
    "embedding_texts": "SELECT p_partkey, concat_ws(chr(10) || chr(10), p_partkey::VARCHAR, nullif(p_name, ''), CASE WHEN p_size > 10 AND p_brand <> '' THEN 'Brand:' || chr(10) || p_brand END, CASE WHEN p_type <> '' THEN 'Type:' || chr(10) || p_type END) AS text FROM part",
    "canonical_ids": """SELECT p_partkey, CASE k WHEN 0 THEN 'SR ' || a || '.' || b WHEN 1 THEN 'SR ' || a || '.' || b || ' RE ' || c ELSE '' END id, CASE k WHEN 0 THEN 'SR' WHEN 1 THEN 'RE' ELSE '' END AS type,
CASE k WHEN 2 THEN -1 ELSE a END::INT fr, CASE k WHEN 2 THEN -1 ELSE b END::INT sr, CASE k WHEN 1 THEN c ELSE -1 END::INT re, CASE k WHEN 1 THEN 'SR ' || a || '.' || b ELSE '' END parent
FROM (SELECT p_partkey, p_partkey % 3 k, p_partkey % 7 + 1 a, p_partkey % 13 b, p_partkey % 4 c FROM part)""",
    "pair_ids": """SELECT l_orderkey, l_linenumber, l_returnflag || ':' || l_orderkey || ':rank_' || l_linenumber || ':' || l_partkey ranked, 'pair-v1:' || sha256('{"source":"' || l_returnflag || '","source_id":"' || l_orderkey || '","target_id":"' || l_partkey || '"}') pair FROM lineitem""",
    "gap_bins": """WITH g AS (SELECT CASE WHEN event_id % 11 = 0 THEN NULL ELSE round(value % 1.3 - 0.1, 2) END gap FROM events)
SELECT CASE WHEN gap IS NULL THEN 'no_gap' WHEN gap >= 0 AND gap < 0.05 THEN 'very_low_gap' WHEN gap >= 0.05 AND gap < 0.1 THEN 'low_gap' WHEN gap >= 0.1 AND gap < 0.2 THEN 'medium_gap' WHEN gap >= 0.2 AND gap <= 1 THEN 'high_gap' ELSE 'unknown' END sampler,
CASE WHEN gap < 0.05 THEN 'very_low_gap' WHEN gap < 0.1 THEN 'low_gap' WHEN gap < 0.2 THEN 'medium_gap' WHEN gap >= 0.2 THEN 'high_gap' ELSE '(null)' END auditor, count(*) n FROM g GROUP BY 1, 2""",
    "value_coercion": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN '(blank)' ELSE (event_id / 4)::VARCHAR END clean, CASE WHEN event_id % 5 < 2 THEN -1 ELSE event_id / 4 END::DOUBLE AS value FROM events",
    "grep_context": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) txt, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents), h AS (SELECT doc_id, line FROM l WHERE regexp_matches(txt, '(?i)license')) SELECT DISTINCT l.doc_id, l.line::INT line, l.txt AS text, EXISTS (SELECT 1 FROM h WHERE h.doc_id = l.doc_id AND h.line = l.line) hit FROM l JOIN h ON l.doc_id = h.doc_id AND l.line BETWEEN h.line - 5 AND h.line + 10",
    "change_categories": """WITH f AS (SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, '(?i)license') THEN 'license' END, CASE WHEN contains(text, '@') THEN 'email' END, CASE WHEN contains(text, '|') THEN 'pipes' END, CASE WHEN len(text) > 3000 THEN 'long' END], lambda x: x IS NOT NULL) f FROM documents)
SELECT doc_id, coalesce(f[1], '') AS primary, coalesce(array_to_string(f[2:], ','), '') others FROM f""",
    "uncontained_texts": """WITH w AS (SELECT p_brand, p_name, string_split(p_name, ' ') w FROM part), t AS (SELECT DISTINCT p_brand, unnest([p_name, array_to_string(w[1:2], ' '), w[2], w[1] || ' ' || w[-1]]) AS text FROM w)
SELECT p_brand, text FROM t WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.p_brand = t.p_brand AND len(o.text) > len(t.text) AND contains(o.text, t.text))""",
    "error_classes": "SELECT CASE o_orderkey % 11 WHEN 0 THEN 'quota' WHEN 1 THEN 'authentication' WHEN 2 THEN 'transient' WHEN 3 THEN 'configuration' WHEN 4 THEN 'transient' WHEN 5 THEN 'api' WHEN 6 THEN 'quota' WHEN 7 THEN 'api' WHEN 8 THEN 'authentication' WHEN 9 THEN 'api' ELSE 'transient' END AS class, count(*) n FROM orders GROUP BY 1",
    "paired_tags": "SELECT p_partkey, array_to_string(list_transform(range(0, len(a), 2), lambda i: array_to_string(a[i + 1:i + 2], ' ')), '|') pairs FROM (SELECT p_partkey, string_split(replace(p_name, ' ', ','), ',') a FROM part)",
    "consolidated_texts": """WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) txt, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
g AS (SELECT doc_id, min(source) source, list(txt ORDER BY line) d, list(left(txt, 20) ORDER BY line) t, count(*) n, list_sort(list_distinct(list_concat(list(line % 5), list(line % 3)))) p FROM l WHERE trim(txt) <> '' GROUP BY 1),
h AS (SELECT *, list_reduce(list_transform(d, lambda x: [x]), lambda a, b: CASE WHEN len(list_filter(a, lambda o: contains(o, b[1]) OR contains(b[1], o))) > 0 THEN a ELSE list_concat(a, b) END) f FROM g)
SELECT doc_id, source, list_reduce(t, lambda a, b: CASE WHEN len(b) > len(a) THEN b ELSE a END) title, list_reduce(f, lambda a, b: CASE WHEN len(b) > len(a) THEN b ELSE a END) AS text, n::INT blocks, array_to_string(p, ',') pages, n occurrences FROM h""",
    "prefix_variants": "SELECT a.item_id, starts_with(a.text, substr(a.text, 1, len(a.text) // 2)) OR starts_with(substr(a.text, 1, len(a.text) // 2), a.text) own, starts_with(a.text, b.text) OR starts_with(b.text, a.text) AS next FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1",
    "contamination_patterns": """WITH m AS (SELECT * FROM (VALUES (0, NULL), (1, 'rationale_and_guidance'), (2, 'requirement_enhancements'), (3, 'security_levels'), (4, 'copyright_notice'), (5, 'not_for_resale'), (6, 'provided_by'), (7, 'licensee'), (8, 'void_artifact'), (9, 'pdf_artifact'), (10, NULL)) v(k, tag)),
e AS (SELECT p_partkey, m.k, m.tag FROM part JOIN m ON m.k IN (p_partkey % 11, (p_partkey // 3) % 11))
SELECT p_partkey, coalesce(string_agg(tag, ',' ORDER BY k), '') tags FROM (SELECT DISTINCT * FROM e) GROUP BY 1""",
    "grouped_texts": "WITH e AS (SELECT unnest([p_brand, string_split(p_type, ' ')[1]]) tag, p_name, p_partkey FROM part), f AS (SELECT tag, p_name, min(p_partkey) o FROM e GROUP BY 1, 2) SELECT tag, sha256(string_agg(p_name, ' ' ORDER BY o, p_name)) digest FROM f GROUP BY 1",
}
