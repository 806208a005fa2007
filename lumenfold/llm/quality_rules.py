"""Quality rules as a short-circuit cascade of native expressions.

Rule order is estimated on a sample: each rule's rejection rate and its cost in seconds are
measured, and rules run by rejection per cost. The order decides only what is evaluated first;
which rows are kept does not depend on it.
"""

from __future__ import annotations

import statistics
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import WORD_GAP, drop_clashing, durable, read

#: The symbols that count, and a character of a word.
SYMBOLS = r"[#*$%&|<>]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """reject: a Boolean column over the text and the base counts; null counts as false."""

    name: str
    reject: Column


def worded_lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHAR))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def _repeat_positions(words: Column, hashes: Column) -> Column:
    """Word positions inside a 3-word window that the text has twice or more.

    Sorting (hash, position) puts equal windows side by side, so the work is n log n in the row,
    with neither a shuffle nor a quadratic lookup.
    """
    n = F.size(hashes)

    def twice(x, i):
        before = (i > 0) & (F.get(hashes, i - 1)["h"] == x["h"])
        return before | ((i < n - 1) & (F.get(hashes, i + 1)["h"] == x["h"]))

    found = F.transform(F.filter(hashes, twice), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
    return F.size(F.array_distinct(F.flatten(found)))


def _free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def base_counts(df: DataFrame, text: str = "text", lines: str | None = None) -> DataFrame:
    """Adds the base counts of the whole text, each long; a null or empty text counts 0 throughout.

    n_repeat_words compares windows by a 64-bit hash of their words. Input columns that carry the
    name of a count are replaced, all others pass through. lines: also adds the lines that hold a
    word, as a column of that name.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = drop_clashing(df, BASE)
    names = df.columns
    w, g, own = _free(df, "_words"), _free(df, "_windows"), lines or _free(df, "_lines")
    df = df.withColumn(w, words_of(t)).withColumn(own, worded_lines(t))
    index = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    window = F.transform(index, lambda i: F.struct(F.xxhash64(F.get(F.col(w), i), F.get(F.col(w), i + 1), F.get(F.col(w), i + 2)).alias("h"), i.alias("i")))
    df = df.withColumn(g, F.sort_array(window))
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.regexp_replace(t, WORD_GAP, "")),
        "n_symbols": F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, "")),
        "n_dup_lines": F.size(own) - F.size(F.array_distinct(own)),
        "n_repeat_words": _repeat_positions(F.col(w), F.col(g)),
    }
    # A filter over the counts must not be pushed below them: it would put the arrays' expressions
    # in place of their columns, inside lambdas that run for each word. An expression that isn't
    # deterministic, though it always holds, keeps it above.
    here = F.spark_partition_id() >= 0
    return df.select(*[F.col(f"`{c}`") for c in names], *[F.when(here, c.cast("long")).alias(n) for n, c in counts.items()], *([own] if lines else []))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules(text: str = "text", lines: Column | None = None) -> list[Rule]:
    """Production rules; ratios are per word unless said otherwise. lines: the lines that hold a word, if a column has them."""
    t, n = F.coalesce(F.col(text), F.lit("")), F.col("n_words")
    lines = worded_lines(t) if lines is None else lines
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > 3 * n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
        Rule("exclamations", 2 * (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))) > n),
        Rule("duplicate_lines", 2 * F.col("n_dup_lines") > F.size(lines)),
        Rule("capitals", 2 * F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")) > letters),
        Rule("letters", 2 * letters < F.col("word_chars")),
        Rule("bullets", 10 * F.size(F.filter(lines, lambda x: F.ltrim(x).rlike(r"^[-*•]"))) > 9 * F.size(lines)),
        Rule("ellipses", 10 * F.size(F.filter(lines, lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$"))) > 3 * F.size(lines)),
    ]


def estimate(df: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = 1000, lines: str | None = None, before: Column | None = None, repeats: int = 3) -> dict[str, tuple[float, float]]:
    """(rejection rate, seconds) of each rule on about sample_rows rows of df, which has no counts yet.

    The rows are chosen over the whole table, by a hash of text and place, in one scan of the
    text that counts nothing. Those for which `before` holds never reach a rule (see cascade) and are
    left out; where none is left every rate is 0. The rest is a table of one partition, on whose
    executor the rules are timed, each `repeats` times in turn; the median counts, less that of a query
    without a rule, and what lies within that query's own spread is no difference: such rules
    share a cost. Only rates come to the driver. They influence only the order of evaluation. lines: as in base_counts, if the rules use that column.
    """
    total = df.count()
    if not total:
        return {r.name: (0.0, 1.0) for r in rules}
    drawn = F.pmod(F.xxhash64(F.col(text), F.monotonically_increasing_id()), F.lit(1 << 30)) < F.lit(-(-sample_rows * (1 << 30) // total))
    counted = base_counts(durable(df.select(text).where(drawn)), text, lines)
    if before is not None:
        counted = counted.where(~F.coalesce(before, F.lit(False)))
    local = durable(counted.coalesce(1))
    idle = "\0"  # no rule's name
    queries = {n: local.agg(F.avg(F.coalesce(c, F.lit(False)).cast("double"))) for n, c in [(idle, F.col("n_words") < 0), *((r.name, r.reject) for r in rules)]}
    rate = {n: float(q.collect()[0][0] or 0.0) for n, q in queries.items()}  # also compiles what is timed
    took: dict[str, list[float]] = {n: [] for n in queries}
    for _ in range(repeats):
        for n, q in queries.items():
            began = time.perf_counter()
            q.collect()
            took[n].append(time.perf_counter() - began)
    job = statistics.median(took[idle])
    least = max(max(took[idle]) - min(took[idle]), 1e-4)
    return {r.name: (rate[r.name], max(statistics.median(took[r.name]) - job, least)) for r in rules}


def ordered(rules: list[Rule], seen: dict[str, tuple[float, float]]) -> list[Rule]:
    """By rejection per cost, the best first; ties keep their order."""
    return sorted(rules, key=lambda r: -seen[r.name][0] / seen[r.name][1])


def cascade(df: DataFrame, rules: list[Rule], verdict: str = "rejected_by", before: Column | None = None) -> DataFrame:
    """Adds the name of the first rule that rejects the row (null: none does).

    A CASE evaluates a rule only for the rows that passed those before it. before: rows for
    which no rule is evaluated at all.
    """
    if not rules:
        return df.withColumn(verdict, F.lit(None).cast("string"))
    case = F.when(F.coalesce(before, F.lit(False)), F.lit(None)) if before is not None else F
    for rule in rules:
        case = case.when(rule.reject, F.lit(rule.name))
    return drop_clashing(df, [verdict]).withColumn(verdict, case)


def apply_rules(df: DataFrame, text: str = "text", sample_rows: int = 1000) -> DataFrame:
    """Base counts, base_failed, rejected_by and kept for every row of df.

    Null text: no words, so base_failed. Empty table: no rows. Repeated rows are judged alike.
    Input columns that carry the name of an output column are replaced, all others pass through.
    """
    df = drop_clashing(df, [*BASE, "base_failed", "rejected_by", "kept"])
    lines = _free(df, "_lines")
    rules = default_rules(text, F.col(lines))
    seen = estimate(df, rules, text, sample_rows, lines, before=base_failed())
    counted = base_counts(df, text, lines).withColumn("base_failed", base_failed())
    judged = cascade(counted, ordered(rules, seen), before=F.col("base_failed"))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()).drop(lines)


def op1_quality_rules(spark, sf_dir):
    out = apply_rules(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *BASE, "base_failed", "kept")


WORDS_SQL = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
w AS (SELECT doc_id, t, {WORDS_SQL} ws, list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]', '', 'g') <> '') ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) i FROM w WHERE len(ws) >= 3)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
p AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) p FROM r) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(ws)::BIGINT n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT word_chars,
             (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT n_dup_lines,
             coalesce(p.n, 0)::BIGINT n_repeat_words, t, ls,
             len(regexp_replace(t, '[^\p{{L}}]', '', 'g')) letters, len(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) caps, len(regexp_replace(t, '[^!]', '', 'g')) bangs
      FROM w LEFT JOIN p ON p.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * bangs > n_words
            OR 2 * n_dup_lines > len(ls) OR 2 * caps > letters OR 2 * letters < word_chars
            OR 10 * len(list_filter(ls, lambda x: regexp_matches(ltrim(x), '^[-*•]'))) > 9 * len(ls)
            OR 10 * len(list_filter(ls, lambda x: regexp_matches(rtrim(x), '(\.\.\.|…)$'))) > 3 * len(ls)) kept
FROM b"""
