"""Assembly, set, diff, block, audit and batch queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import markdown
from lumenfold.functions import text as t
from lumenfold.operators import audit as A
from lumenfold.operators import batches as B
from lumenfold.operators import joins as J
from lumenfold.plans.standins import CTE, candidates, rules, targets
from lumenfold.plans.q_distribution import rounded
from lumenfold.session import table


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")


def missing_extra(spark, sf_dir):
    return J.missing_and_extra(rules(spark, sf_dir).where("source_id % 5 <> 0"), candidates(spark, sf_dir).where("source_id % 3 <> 0"), "source_id")


def enriched(spark, sf_dir):
    c = candidates(spark, sf_dir).select("source_id", "target_id", "rank")
    out = J.enrich(c, targets(spark, sf_dir).where("target_id % 10 <> 0").select("target_id", "fr"), "target_id", "quarantine")
    return out.withColumn("fr", F.coalesce("fr", F.lit(-1)))


def rationales(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("target_id"), F.col("text").alias("rationale"), F.array((F.col("item_id") % 9).cast("int")).alias("pages"))
    found = J.conditional_lookup(targets(spark, sf_dir), b, "target_id", F.col("target_type") == "SR", {"rationale": F.lit(""), "pages": F.array().cast("array<int>")})
    return found.select("target_id", "target_type", "rationale", F.size("pages").alias("pages"))


def nested_round_trip(spark, sf_dir):
    c = candidates(spark, sf_dir).select("source", "source_id", "rank", "target_id", "relative_score")
    return rounded(J.flatten(J.nest(c)))


def overrides(spark, sf_dir):
    p = parts(spark, sf_dir).select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_name")).otherwise("").alias("name"), F.col("p_brand").alias("brand"))
    o = p.where("name = '' and p_partkey % 2 = 0").select("p_partkey", F.lit("name").alias("field"), F.concat(F.lit("curated "), "p_partkey").alias("value"), F.lit(False).alias("allow_replace"))
    o = o.unionByName(p.where("p_partkey % 9 = 0").select("p_partkey", F.lit("brand").alias("field"), F.lit("Brand#00").alias("value"), F.lit(True).alias("allow_replace")))
    return J.field_overrides(p, o, ["p_partkey"], ["name", "brand"])


def changes(spark, sf_dir):
    p = parts(spark, sf_dir)
    after = p.withColumn("p_brand", F.when(F.col("p_partkey") % 4 == 0, "X").otherwise(F.col("p_brand"))).withColumn("p_size", F.when(F.col("p_partkey") % 6 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return J.field_changes(p, after, "p_partkey", ["p_name", "p_brand", "p_size"])


def change_counts(spark, sf_dir):
    return changes(spark, sf_dir).groupBy("field").agg(F.count("*").alias("changes"), F.count_distinct("p_partkey").alias("records"))


def orphan_targets(spark, sf_dir):
    d = targets(spark, sf_dir).where("target_id % 6 <> 0")
    return J.orphans(d, "target_id", "parent_sr", F.col("target_type") == "SR").select("target_id", "parent_sr")


def parity(spark, sf_dir):
    a = parts(spark, sf_dir).withColumn("ord", F.col("p_partkey"))
    b = a.withColumn("p_name", F.when(F.col("p_partkey") % 50 == 0, "other").otherwise(F.col("p_name"))).where("p_partkey % 77 <> 0")
    return J.parity(a, b, "ord", ["p_name", "p_brand"]).select("ord", F.array_join("differs", ",").alias("differs"))


def blocks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    out = J.page_blocks(c, "conv_id", "turn", "text")
    line = lambda x: F.array_join(F.transform(x, lambda p: p.cast("string")), ",")
    return out.select("conv_id", "block_id", line("central_pages").alias("central"), line("context_pages").alias("context"), F.sha2("text", 256).alias("digest"))


def page_range_join(spark, sf_dir):
    """Parts as pages, met by blocks of stated first and last pages, some of them long, empty or turned round."""
    p = table(spark, sf_dir, "part")
    k, n = F.col("p_partkey"), F.col("p_size")
    ranges = p.select(k.alias("block"), (k % 3).alias("document"), (k - n).alias("first"), F.when(k % 50 == 0, k + 40 * n).when(k % 11 == 0, k - n - 1).otherwise(k + n % 7).alias("last"))
    return J.range_join(p.select((k % 3).alias("document"), k.alias("page")), ranges, ["document"], "page", "first", "last", hot=50).select("document", "block", "page")


def vector_checks(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    v = F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 10 == 1, F.transform("embedding", lambda x: x * 2)).when(F.col("vec_id") % 10 == 2, F.transform("embedding", lambda x, i: F.when(i == 3, F.lit(float("nan"))).otherwise(x).cast("float"))).otherwise(F.col("embedding"))
    return e.select("vec_id", v.alias("v")).select("vec_id", F.array_join(A.vector_problems("v", 64), ",").alias("problems"))


def record_audit(spark, sf_dir):
    x = F.col("text")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    checks = {"long_enough": F.length(x) >= 200, "clean": F.when(x.rlike(r"\|"), "warn").when(x.rlike("!!"), "fail").otherwise("pass"), "modal": F.replace(t.modal_status(x, "the"), F.lit("warning"), F.lit("warn")), "no_license": ~x.rlike("(?i)licensed under")}
    return A.record_audit(d, checks, review=["clean"])


def variant_audit(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    v = b.select("item_id", "text").unionByName(b.select((F.col("item_id") + 1).alias("item_id"), F.left("text", F.lit(60)).alias("text"))).unionByName(b.select("item_id", F.left("text", F.lit(80)).alias("text")))
    return A.variant_audit(b, v, "item_id", "text")


def fr_expected(spark, sf_dir):
    d = targets(spark, sf_dir)
    return A.against_expected(d.select(F.col("fr").cast("int").alias("fr")), "fr", {i: 14 for i in range(1, 9)})


def violations(spark, sf_dir):
    c = candidates(spark, sf_dir).select("source_id", "rank", "target_id", "relative_score")
    k = F.col("source_id")
    c = c.withColumn("rank", F.when((k % 20 == 0) & (F.col("rank") > 2), F.col("rank") + 1).otherwise(F.col("rank"))).withColumn("target_id", F.when((k % 20 == 1) & (F.col("rank") == 2), 500).otherwise(F.col("target_id")))
    c = c.withColumn("relative_score", F.when((k % 20 == 2) & (F.col("rank") == 3), F.lit(1.5)).otherwise(F.col("relative_score")))
    return A.matching_violations(c, targets(spark, sf_dir), 0.4, 8)


def monotone(spark, sf_dir):
    return A.monotone_violations(candidates(spark, sf_dir), "source_id", "rank", "raw_cosine")


def manifest(spark, sf_dir):
    c = candidates(spark, sf_dir).select("source", "source_id", "rank", "target_id")
    m = B.pair_manifest(c, ["source", "source_id", "rank"])
    return m.withColumn("pair_id", t.ranked_pair_id(F.col("source"), F.col("source_id"), F.col("rank"), F.col("target_id")))


def batch_manifest(spark, sf_dir):
    b = B.batch_manifest(manifest(spark, sf_dir), 5, "pair_id")
    return b.select("batch_id", "start_index", "size", "membership_sha256")


def prompt_digests(spark, sf_dir):
    m = manifest(spark, sf_dir).withColumn("batch", F.floor(F.col("index") / 5))
    return B.prompts(m, "batch", "index", ["pair_id", "target_id"], "Judge: {{records}}").select("batch", F.sha2("prompt", 256).alias("digest"))


def answers(spark, sf_dir):
    """Answers made from the manifest: some batches miss a pair, repeat one, or give a verdict that isn't one."""
    m = manifest(spark, sf_dir).withColumn("batch_id", F.format_string("batch-%06d", F.floor(F.col("index") / 5)))
    i = F.col("index")
    verdict = F.when(i % 37 == 0, "PERHAPS").otherwise("YES")
    r = m.where(i % 41 != 0).select("batch_id", "index", F.col("pair_id"), verdict.alias("verdict"), F.when(i % 53 == 0, 9).otherwise(3).alias("confidence"), *[F.when((i % 47 != 0) | F.lit(n != "justification"), "x").alias(n) for n in B.RESPONSE_TEXTS[2:]])
    r = r.unionByName(r.where(i % 43 == 0))
    one = F.array_sort(F.collect_list(F.struct("index", F.struct(*B.RESPONSE_TEXTS, "confidence").alias("r"))))
    out = r.groupBy("batch_id").agg(F.concat(F.lit("```json\n"), F.to_json(F.transform(one, lambda s: s["r"])), F.lit("\n```")).alias("answer"))
    return m, out


def response_problems(spark, sf_dir):
    m, a = answers(spark, sf_dir)
    return B.response_problems(B.parse_responses(a), m.select("batch_id", "pair_id"))


def usage(spark, sf_dir):
    """Attempts and tokens of every batch and of the requests below it: answers for more than three items are refused, twice, before they are halved."""

    def stub(items):
        return B.Reply([{"pair_id": i} for i in items], ",".join(items), {"tokens": sum(map(len, items))})

    def check(items, results):
        if len(results) > 3:
            raise B.InvalidAnswer("too many")

    b = B.batch_manifest(manifest(spark, sf_dir), 5, "pair_id")
    tried = B.attempts(B.call_batches(b, stub, check=check, invalid_attempts=2, sleep=lambda s: None))
    return B.usage_tree(tried).select("batch_id", "path", "requests", F.col("usage")["tokens"].alias("tokens"))


def called(spark, sf_dir):
    """Every batch through the adaptive caller, with a stub that refuses more than three items at once."""

    def stub(items):
        if len(items) > 3:
            raise B.InvalidAnswer("too many")
        return [{"pair_id": i, "verdict": "NO"} for i in items]

    b = B.batch_manifest(manifest(spark, sf_dir), 5, "pair_id")
    return B.request_totals(B.call_batches(b, stub, sleep=lambda s: None))


def pending_batches(spark, sf_dir):
    b = B.batch_manifest(manifest(spark, sf_dir), 5, "pair_id").select("batch_id", "start_index")
    done = b.where("start_index % 3 = 0").select("batch_id", F.when(F.col("start_index") % 2 == 0, "failed").alias("error"), F.lit("f").alias("fingerprint"))
    return B.pending(b, done, "f")


def markdown_rules(spark, sf_dir):
    p = parts(spark, sf_dir)
    md = F.concat(F.lit("# "), "p_name", F.lit("\n\n## Problematic code\n\n```sh\n# not a heading\n"), "p_brand", F.lit("\n```\n\n## Rationale\n\nWhy "), "p_size", F.lit(".\n"), F.when(F.col("p_partkey") % 2 == 0, "\n### Rationale (more)\n\nSecond part.\n").otherwise(""))
    return markdown.extract(p.select("p_partkey", md.alias("markdown"))).rules.select("p_partkey", "title", "problematic_code", "rationale")


def markdown_corpus(spark, sf_dir, once=False):
    """Rule documents of which some can't be read: open fences, two titles, none."""
    k = F.col("p_partkey")
    md = F.concat(
        F.when(k % 7 == 0, "# One\n# Two\n").when(k % 11 == 0, "## Examples\n").otherwise("# Title\n"), F.lit("## Problematic code\n```"), F.when(k % 3 == 0, "sh x").when(k % 3 == 1, "").otherwise("docker"), F.lit("\nx\n"),
        F.when(k % 13 == 0, "").otherwise("```\n"), F.when(k % 2 == 0, "## Correct code (a)\ny\n## Correct code\n~~~sh\nz\n~~~\n").otherwise("## Correct code\n\n"), F.when(k % 5 == 0, "## Exceptions\nnone\n").otherwise(""))
    return markdown.extract(parts(spark, sf_dir).select("p_partkey", md.alias("markdown")), once=once)


def lined(spark, sf_dir):
    """Documents with a fence that hides a heading, an underlined heading, nested levels and sections of several levels."""
    k = F.col("p_partkey")
    md = F.concat(
        F.lit("# "), "p_name", F.lit("\n\nProblematic code\n---\n```sh\n# hidden\n```\n"), F.when(k % 2 == 0, "### Detail\n\ntext\n").otherwise(""), F.lit("## Rationale (why)\nOne\n"),
        F.when(k % 3 == 0, "#### Correct code\n~~~\nx\n~~~\n~~~\ny\n~~~\n").otherwise(""), F.lit("## Other\nlast"))
    return parts(spark, sf_dir).select("p_partkey", md.alias("markdown"))


def markdown_headings(spark, sf_dir):
    return markdown.marks(lined(spark, sf_dir)).where("kind = 'heading'").select("p_partkey", "line", "level", "shown", F.coalesce("category", F.lit("")).alias("category"), "qualified")


def markdown_sections(spark, sf_dir):
    d = lined(spark, sf_dir)
    return markdown.sections(markdown.marks(d), d, ["p_partkey"]).select("p_partkey", "category", "first_line", "last_line", "fences", F.sha2("body", 256).alias("body"))


def markdown_rollup(spark, sf_dir):
    return markdown.corpus_rollup(markdown_corpus(spark, sf_dir, once=True))


def markdown_quarantine(spark, sf_dir):
    return markdown_corpus(spark, sf_dir).quarantine.select("p_partkey", "code")


def text_audit(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return A.text_audit(d, F.col("text"), ["text", "lang", "source"])


QUERIES = {
    "missing_and_extra": missing_extra, "enriched_candidates": enriched, "conditional_rationales": rationales, "nested_round_trip": nested_round_trip, "field_overrides": overrides, "field_changes": changes,
    "change_counts": change_counts, "orphan_targets": orphan_targets, "dataset_parity": parity, "page_blocks": blocks, "page_range_join": page_range_join, "vector_checks": vector_checks,
    "record_audit": lambda s, p: record_audit(s, p).select("doc_id", "score", F.array_join("issues", ",").alias("issues"), "status"),
    "audit_rollup": lambda s, p: A.status_rollup(record_audit(s, p), ["source"]).na.fill("ALL", ["source"]),
    "variant_audit": variant_audit, "fr_distribution": fr_expected, "matching_violations": violations, "monotone_violations": monotone,
    "duplicate_texts": lambda s, p: A.duplicates(table(s, p, "documents"), t.sha256(t.comparison_form(F.col("text"))), "digest"),
    "field_coverage": lambda s, p: A.field_coverage(table(s, p, "documents").withColumn("lang", F.when(F.col("doc_id") % 7 != 0, F.col("lang"))), ["text", "lang"], ["source"]),
    "text_audit": text_audit, "pair_manifest": lambda s, p: manifest(s, p).select("index", "pair_id"), "batch_manifest": batch_manifest, "prompt_digests": prompt_digests,
    "response_problems": response_problems, "adaptive_requests": called, "request_usage": usage, "pending_batches": pending_batches, "markdown_rules": markdown_rules, "markdown_headings": markdown_headings, "markdown_sections": markdown_sections, "markdown_rollup": markdown_rollup, "markdown_quarantine": markdown_quarantine,
}

MANIFEST = CTE + """, m AS (SELECT row_number() OVER (ORDER BY source, source_id, rank) - 1 AS index, source || ':' || source_id || ':rank_' || rank || ':' || target_id pair_id, target_id FROM cand),
b AS (SELECT index // 5 b, min(index) start_index, count(*) size, list(pair_id ORDER BY index) members FROM m GROUP BY 1)
"""
WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
AUDIT = r"""WITH g AS (SELECT doc_id, source, CASE WHEN len(text) >= 200 THEN 'pass' ELSE 'fail' END long_enough, CASE WHEN contains(text, '|') THEN 'warn' WHEN contains(text, '!!') THEN 'fail' ELSE 'pass' END clean,
CASE WHEN contains(' ' || regexp_replace(lower(text), '[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g') || ' ', ' the ') THEN 'pass' WHEN trim(text) <> '' THEN 'warn' ELSE 'fail' END modal, CASE WHEN regexp_matches(text, '(?i)licensed under') THEN 'fail' ELSE 'pass' END no_license FROM documents),
l AS (SELECT *, [long_enough, clean, modal, no_license] v FROM g),
a AS (SELECT doc_id, source, round(list_sum(list_transform(v, lambda x: CASE x WHEN 'pass' THEN 1.0 WHEN 'warn' THEN 0.5 ELSE 0 END)) / 4.0, 6)::DOUBLE score,
array_to_string(list_filter([CASE WHEN clean <> 'pass' THEN 'clean:' || clean END, CASE WHEN long_enough <> 'pass' THEN 'long_enough:' || long_enough END, CASE WHEN modal <> 'pass' THEN 'modal:' || modal END, CASE WHEN no_license <> 'pass' THEN 'no_license:' || no_license END], lambda x: x IS NOT NULL), ',') issues,
CASE WHEN list_contains(v, 'fail') THEN 'fail' WHEN clean = 'warn' THEN 'review' WHEN NOT list_contains(v, 'warn') THEN 'approved' ELSE 'warning' END status FROM l)
"""
#: Reads off the document's number what becomes of it: an open fence comes first, then the titles.
MARKDOWN = "WITH d AS (SELECT p_partkey, p_partkey % 2 = 0 two, p_partkey % 5 = 0 exc, CASE WHEN p_partkey % 13 = 0 THEN 'unmatched_fence' WHEN p_partkey % 7 = 0 THEN 'several_titles' WHEN p_partkey % 11 = 0 THEN 'no_title' END code FROM part)"
ORACLE_SQL = {
    "missing_and_extra": CTE + "SELECT source_id, 'missing' side FROM rules WHERE source_id % 5 <> 0 AND source_id NOT IN (SELECT source_id FROM cand WHERE source_id % 3 <> 0) UNION ALL SELECT DISTINCT source_id, 'extra' FROM cand WHERE source_id % 3 <> 0 AND source_id % 5 = 0",
    "enriched_candidates": CTE + "SELECT source_id, target_id, rank, CASE WHEN target_id % 10 = 0 THEN -1 ELSE fr END fr, target_id % 10 = 0 unmatched FROM cand",
    "conditional_rationales": CTE + "SELECT target_id, target_type, CASE WHEN target_type = 'SR' THEN coalesce(b.text, '') ELSE '' END rationale, CASE WHEN target_type = 'SR' AND b.item_id IS NOT NULL THEN 1 ELSE 0 END::INT pages FROM targets LEFT JOIN benchmark b ON b.item_id = target_id",
    "nested_round_trip": CTE + "SELECT source, source_id, rank - 1 AS place, rank, target_id, round(relative_score, 6) relative_score FROM cand",
    "field_overrides": "SELECT p_partkey, CASE WHEN p_size > 5 AND p_name <> '' THEN p_name WHEN p_partkey % 2 = 0 THEN 'curated ' || p_partkey ELSE '' END AS name, CASE WHEN p_partkey % 9 = 0 THEN 'Brand#00' ELSE p_brand END brand FROM part",
    "field_changes": "SELECT p_partkey, 'p_brand' field, p_brand AS old, 'X' AS new FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_partkey, 'p_size', p_size::VARCHAR, (p_size + 1)::VARCHAR FROM part WHERE p_partkey % 6 = 0",
    "change_counts": "SELECT 'p_brand' field, count(*) changes, count(*) records FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'p_size', count(*), count(*) FROM part WHERE p_partkey % 6 = 0",
    "orphan_targets": CTE + "SELECT target_id, parent_sr FROM targets WHERE target_id % 6 <> 0 AND parent_sr % 6 = 0",
    "dataset_parity": "SELECT p_partkey ord, CASE WHEN p_partkey % 77 = 0 THEN 'p_name,p_brand' ELSE 'p_name' END differs FROM part WHERE p_partkey % 77 = 0 OR p_partkey % 50 = 0",
    "page_range_join": """WITH r AS (SELECT p_partkey AS block, p_partkey % 3 AS document, p_partkey - p_size AS first, CASE WHEN p_partkey % 50 = 0 THEN p_partkey + 40 * p_size WHEN p_partkey % 11 = 0 THEN p_partkey - p_size - 1 ELSE p_partkey + p_size % 7 END AS last FROM part)
SELECT r.document, r.block, p.p_partkey AS page FROM r JOIN part p ON p.p_partkey % 3 = r.document AND p.p_partkey BETWEEN r.first AND r.last""",
    "page_blocks": """WITH n AS (SELECT conv_id, max(turn) // 2 last FROM conversations GROUP BY 1), k AS (SELECT conv_id, unnest(range(0, last + 1)) b FROM n),
j AS (SELECT k.conv_id, k.b, c.turn, c.text, CASE WHEN c.turn // 2 = k.b THEN 'CENTRAL' ELSE 'CONTEXT' END r FROM k JOIN conversations c ON c.conv_id = k.conv_id AND c.turn BETWEEN 2 * k.b - 1 AND 2 * k.b + 2)
SELECT conv_id, b::INT block_id, coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (r = 'CENTRAL'), '') central, coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (r = 'CONTEXT'), '') context,
sha256(string_agg('[' || r || ' PAGE ' || turn || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) digest FROM j GROUP BY 1, 2""",
    "vector_checks": "SELECT vec_id, CASE vec_id % 10 WHEN 0 THEN 'dimension' || CASE WHEN abs(sqrt(list_sum(list_transform(embedding[1:63], lambda x: x::DOUBLE * x::DOUBLE))) - 1) > 1e-5 THEN ',norm' ELSE '' END WHEN 1 THEN 'norm' WHEN 2 THEN 'finite' ELSE '' END problems FROM embeddings",
    "record_audit": AUDIT + "SELECT doc_id, score, issues, status FROM a",
    "audit_rollup": AUDIT + "SELECT coalesce(source, 'ALL') source, count(*) records, count(*) FILTER (status = 'fail') fail, count(*) FILTER (status = 'review') review, count(*) FILTER (status = 'approved') approved, count(*) FILTER (status = 'warning') warning, round(avg(score), 6) mean_score FROM a GROUP BY GROUPING SETS ((a.source), ())",
    "fr_distribution": CTE + "SELECT k.fr::INT fr, count(t.fr) observed, 14::BIGINT expected, count(t.fr) = 14 ok FROM (SELECT unnest(range(1, 9)) fr) k LEFT JOIN targets t ON t.fr = k.fr GROUP BY 1",
    "matching_violations": CTE + """, x AS (SELECT source_id, CASE WHEN source_id % 20 = 0 AND rank > 2 THEN rank + 1 ELSE rank END AS rank, target_id, relative_score FROM cand),
y AS (SELECT source_id, rank, CASE WHEN source_id % 20 = 1 AND rank = 2 THEN 500 ELSE target_id END target_id, CASE WHEN source_id % 20 = 2 AND rank = 3 THEN 1.5 ELSE relative_score END s FROM x),
z AS (SELECT *, row_number() OVER w n, lag(s) OVER w p, lag(target_id) OVER w q, count(*) OVER (PARTITION BY source_id, target_id) same FROM y WINDOW w AS (PARTITION BY source_id ORDER BY rank)),
v AS (SELECT source_id, unnest(list_filter([CASE WHEN rank <> n THEN 'rank' END, CASE WHEN same > 1 THEN 'target_repeated' END, CASE WHEN target_id >= 100 THEN 'target_unknown' END, CASE WHEN s > p THEN 'score_rises' END, CASE WHEN s < 0.4 THEN 'below_threshold' END, CASE WHEN n > 8 THEN 'too_many' END, CASE WHEN s = p AND target_id < q THEN 'tie_order' END], lambda i: i IS NOT NULL)) rule FROM z)
SELECT source_id, rule, count(*) n FROM v GROUP BY 1, 2""",
    "monotone_violations": CTE + "SELECT source_id, 0::BIGINT rises FROM cand GROUP BY 1",
    "duplicate_texts": rf"""WITH c AS (SELECT sha256(translate(lower(regexp_replace(regexp_replace(regexp_replace(text, '{WS}+', ' ', 'g'), '^ ', ''), ' $', '')), '’‘“”', '''''""')) digest FROM documents) SELECT digest, count(*) n FROM c GROUP BY 1 HAVING count(*) > 1""",
    "field_coverage": "SELECT source, 'text' field, count(*) FILTER (text <> '') filled, count(*) FILTER (text = '') empty FROM documents GROUP BY 1 UNION ALL SELECT source, 'lang', count(*) FILTER (doc_id % 7 <> 0), count(*) FILTER (doc_id % 7 = 0) FROM documents GROUP BY 1",
    "text_audit": "SELECT count(*) records, count(DISTINCT text) distinct_texts, count(*) - count(DISTINCT text) repeated_texts, count(*) FILTER (text = '') empty_text, count(*) FILTER (lang = '') empty_lang, count(*) FILTER (source = '') empty_source FROM documents",
    "pair_manifest": MANIFEST + "SELECT index, pair_id FROM m",
    "batch_manifest": MANIFEST + "SELECT 'batch-' || lpad(b::VARCHAR, 6, '0') batch_id, start_index, size, sha256('[\"' || array_to_string(members, '\",\"') || '\"]') membership_sha256 FROM b",
    "prompt_digests": MANIFEST + "SELECT index // 5 AS batch, sha256('Judge: [' || string_agg('{\"pair_id\":\"' || pair_id || '\",\"target_id\":' || target_id || '}', ',' ORDER BY index) || ']') digest FROM m GROUP BY 1",
    "response_problems": MANIFEST + """, r AS (SELECT index // 5 b, unnest(list_filter([CASE WHEN index % 41 = 0 THEN 'missing' END, CASE WHEN index % 41 <> 0 AND index % 43 = 0 THEN 'repeated' END, CASE WHEN index % 41 <> 0 AND index % 37 = 0 THEN 'verdict' END, CASE WHEN index % 41 <> 0 AND index % 53 = 0 THEN 'confidence' END, CASE WHEN index % 41 <> 0 AND index % 47 = 0 THEN 'fields' END], lambda i: i IS NOT NULL)) problem FROM m)
SELECT 'batch-' || lpad(b::VARCHAR, 6, '0') batch_id, problem, count(*) n FROM r GROUP BY 1, 2""",
    "request_usage": MANIFEST + """, i AS (SELECT b, size, index - start_index place, len(pair_id) n FROM m JOIN b ON index // 5 = b),
p AS (SELECT b, 'root' path, CASE WHEN size > 3 THEN 4 ELSE 1 END requests, CASE WHEN size > 3 THEN 3 ELSE 1 END times, n FROM i UNION ALL SELECT b, CASE WHEN place < size // 2 THEN 'root.L' ELSE 'root.R' END, 1, 1, n FROM i WHERE size > 3)
SELECT 'batch-' || lpad(b::VARCHAR, 6, '0') batch_id, path, max(requests)::BIGINT requests, sum(times * n)::BIGINT tokens FROM p GROUP BY b, path""",
    "adaptive_requests": MANIFEST + "SELECT sum(CASE WHEN size > 3 THEN 3 ELSE 1 END)::BIGINT requests, count(*) FILTER (size > 3) failed, sum(CASE WHEN size > 3 THEN 2 * size ELSE size END)::BIGINT items FROM b",
    "pending_batches": MANIFEST + "SELECT 'batch-' || lpad(b::VARCHAR, 6, '0') batch_id, start_index FROM b WHERE NOT (start_index % 3 = 0 AND start_index % 2 <> 0)",
    "markdown_headings": """WITH d AS (SELECT p_partkey, p_name, p_partkey % 2 = 0 two, p_partkey % 3 = 0 three FROM part), e AS (SELECT *, CASE WHEN two THEN 3 ELSE 0 END o, CASE WHEN three THEN 7 ELSE 0 END q FROM d)
SELECT p_partkey, 1 AS line, 1 AS level, p_name shown, '' category, false qualified FROM e UNION ALL SELECT p_partkey, 3, 2, 'Problematic code', 'problematic_code', false FROM e
UNION ALL SELECT p_partkey, 8, 3, 'Detail', '', false FROM e WHERE two UNION ALL SELECT p_partkey, 8 + o, 2, 'Rationale (why)', 'rationale', true FROM e
UNION ALL SELECT p_partkey, 10 + o, 4, 'Correct code', 'correct_code', false FROM e WHERE three UNION ALL SELECT p_partkey, 10 + o + q, 2, 'Other', '', false FROM e""",
    "markdown_sections": """WITH e AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 0 END o, p_partkey % 2 = 0 two, p_partkey % 3 = 0 three FROM part)
SELECT p_partkey, 'problematic_code' category, 5 first_line, 7 + o last_line, 1::BIGINT fences, sha256('```sh' || chr(10) || '# hidden' || chr(10) || '```' || CASE WHEN two THEN chr(10) || '### Detail' || chr(10) || chr(10) || 'text' ELSE '' END) body FROM e
UNION ALL SELECT p_partkey, 'rationale', 9 + o, 9 + o, 0, sha256('One') FROM e
UNION ALL SELECT p_partkey, 'correct_code', 11 + o, 16 + o, 2, sha256('~~~' || chr(10) || 'x' || chr(10) || '~~~' || chr(10) || '~~~' || chr(10) || 'y' || chr(10) || '~~~') FROM e WHERE three""",
    "markdown_quarantine": MARKDOWN + "SELECT p_partkey, code FROM d WHERE code IS NOT NULL",
    "markdown_rollup": MARKDOWN + """, g AS (SELECT * FROM d WHERE code IS NULL), r AS (
SELECT 'rules' measure, 'total' AS name, count(*) n FROM g UNION ALL SELECT 'field_coverage', 'problematic_code', count(*) FROM g UNION ALL SELECT 'field_coverage', 'correct_code', count(*) FILTER (two) FROM g
UNION ALL SELECT 'field_coverage', 'rationale', 0 UNION ALL SELECT 'field_coverage', 'exceptions', count(*) FILTER (exc) FROM g
UNION ALL SELECT 'section_occurrences', 'problematic_code', count(*) FROM g UNION ALL SELECT 'section_occurrences', 'correct_code', sum(1 + two::INT) FROM g UNION ALL SELECT 'section_occurrences', 'exceptions', count(*) FILTER (exc) FROM g
UNION ALL SELECT 'qualified_occurrences', 'problematic_code', 0 UNION ALL SELECT 'qualified_occurrences', 'correct_code', count(*) FILTER (two) FROM g UNION ALL SELECT 'qualified_occurrences', 'exceptions', 0
UNION ALL SELECT 'rules_with_repeated_sections', 'problematic_code', 0 UNION ALL SELECT 'rules_with_repeated_sections', 'correct_code', count(*) FILTER (two) FROM g UNION ALL SELECT 'rules_with_repeated_sections', 'exceptions', 0
UNION ALL SELECT 'fences', 'total', sum(1 + two::INT) FROM g
UNION ALL SELECT 'fence_language', 'sh', count(*) FILTER (p_partkey % 3 = 0) + count(*) FILTER (two) FROM g UNION ALL SELECT 'fence_language', 'docker', count(*) FILTER (p_partkey % 3 = 2) FROM g
UNION ALL SELECT 'warnings', 'missing_semantic_field', count(*) + count(*) FILTER (NOT two) FROM g UNION ALL SELECT 'warnings', 'empty_semantic_section', count(*) FILTER (NOT two) FROM g
UNION ALL SELECT 'failures', code, count(*) FROM d WHERE code IS NOT NULL GROUP BY 2)
SELECT measure, name, n::BIGINT n FROM r""",
    "markdown_rules": "SELECT p_partkey, p_name title, '# not a heading' || chr(10) || p_brand problematic_code, CASE WHEN p_partkey % 2 = 0 THEN 'Rationale' || chr(10) ELSE '' END || 'Why ' || p_size || '.' || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || chr(10) || 'Rationale (more)' || chr(10) || 'Second part.' ELSE '' END rationale FROM part",
}
