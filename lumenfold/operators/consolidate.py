"""Consolidation of texts that were extracted more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import let
from lumenfold.session import durable


def fold_contained(texts: Column) -> Column:
    """Representatives in order of arrival: a text that contains, or is contained in, one already held is passed over."""
    empty = F.array().cast("array<string>")
    return F.aggregate(texts, empty, lambda held, t: F.when(F.exists(held, lambda h: F.contains(h, t) | F.contains(t, h)), held).otherwise(F.concat(held, F.array(t))))


def longest(texts: Column) -> Column:
    """The longest text; of equals the first."""
    return F.aggregate(texts, F.lit(None).cast("string"), lambda a, t: F.when(a.isNull() | (F.length(t) > F.length(a)), t).otherwise(a))


def merge_texts(texts: Column) -> Column:
    """The longest of the representatives, as they arrive. A later text that contains an earlier one is passed over, even if it is longer."""
    return longest(fold_contained(F.filter(texts, lambda t: F.coalesce(t, F.lit("")) != "")))


def drop_contained(texts: Column) -> Column:
    """Distinct texts, longest first, without those that a longer one contains."""
    d = F.array_distinct(F.filter(texts, lambda t: F.coalesce(t, F.lit("")) != ""))
    d = F.transform(F.array_sort(F.transform(d, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda s: s["t"])
    return let(d, lambda d: F.filter(d, lambda t: ~F.exists(d, lambda o: (F.length(o) > F.length(t)) & F.contains(o, t))))


def consolidate(rows: DataFrame, key: str, title: str, text: str, block: str, pages: str, extra: list[Column] | None = None) -> DataFrame:
    """Per key: longest title, merged text (in block order), sorted distinct blocks and pages, occurrences."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct(block, text))), lambda s: s[text])
    titles = F.transform(F.array_sort(F.collect_list(F.struct(block, title))), lambda s: s[title])
    return rows.groupBy(key).agg(
        longest(titles).alias(title), merge_texts(in_order).alias(text), F.array_sort(F.collect_set(block)).alias("blocks"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(pages)))).alias("pages"), F.count("*").alias("occurrences"), *(extra or []))


def group_texts(rows: DataFrame, tags: Column, text: str, order: str) -> DataFrame:
    """Per tag: its distinct texts joined by spaces in the order in which they were first seen."""
    each = rows.select(F.explode(tags).alias("tag"), text, order).groupBy("tag", text).agg(F.min(order).alias("o"))
    return each.groupBy("tag").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", text))), lambda s: s[text]), " ").alias(text))


#: A whole word, and one that touches neither end of the text.
_WORD, _INNER = r"[\p{L}\p{N}]+", r"(?<=[^\p{L}\p{N}])[\p{L}\p{N}]++(?=[^\p{L}\p{N}])"


def _grams(text: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))


def contained_in(rows: DataFrame, key: str, text: str, grams: int = 3) -> DataFrame:
    """(key, text, container) of each two distinct texts of a key of which a longer one contains the other: drop_contained's relation for keys too large for one array.

    A word of a text that touches neither of its ends is a whole word of every text that contains it. So each text is
    looked up by the rarest of these words in its key, and meets only the texts that have it; texts without such a word
    are looked up by their rarest run of `grams` characters (fewer, if they are shorter). Words and runs meet texts by
    number; the texts themselves only join pairs of fitting length, which are then compared. No task
    holds a key. Null and empty texts contain nothing and are in nothing; a null key is a key.
    """
    d = rows.where(F.coalesce(F.col(text), F.lit("")) != "").select(F.col(key).alias("k"), F.col(text).alias("t")).distinct()
    d = durable(d.withColumn("id", F.monotonically_increasing_id()))
    inner = F.array_distinct(F.regexp_extract_all("t", F.lit(_INNER), F.lit(0)))
    own = durable(d.select("k", "id", F.length("t").alias("n"), F.struct(F.lit(0).alias("size"), inner.alias("marks")).alias("w"), F.least(F.lit(grams), F.length("t")).alias("size"), "t"))
    words = own.where(F.size("w.marks") > 0).select("k", "id", "n", F.lit(0).alias("size"), F.explode("w.marks").alias("mark"))
    short = own.where(F.size("w.marks") == 0)
    sizes = [r["size"] for r in short.select("size").distinct().collect()]  # at most `grams`
    held = d.select("k", "id", F.length("t").alias("n"), F.lit(0).alias("size"), F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(_WORD), F.lit(0)))).alias("mark"))
    for n in sizes:
        words = words.unionByName(short.where(F.col("size") == n).select("k", "id", "n", "size", F.explode(F.array_distinct(_grams(F.col("t"), n))).alias("mark")))
        held = held.unionByName(d.where(F.length("t") >= n).select("k", "id", F.length("t").alias("n"), F.lit(n).alias("size"), F.explode(F.array_distinct(_grams(F.col("t"), n))).alias("mark")))
    held = held.withColumn("k", F.struct("k")).withColumnRenamed("id", "other").withColumnRenamed("n", "longer")  # a struct is never null
    words = words.withColumn("k", F.struct("k"))
    often = held.groupBy("k", "size", "mark").agg(F.count("*").alias("often"))
    rarest = words.join(often, ["k", "size", "mark"]).groupBy("k", "id", "n", "size").agg(F.min_by("mark", F.struct("often", "mark")).alias("mark"))
    pairs = rarest.join(held, ["k", "size", "mark"]).where("longer > n").select("id", "other")
    near = pairs.join(d.select("id", "k", "t"), "id").join(d.select(F.col("id").alias("other"), F.col("t").alias("c")), "other")
    return near.where(F.contains("c", F.col("t"))).select(F.col("k").alias(key), F.col("t").alias(text), F.col("c").alias("container"))


def uncontained(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): the distinct texts of each key that no longer text of it contains; as drop_contained, a row each, for keys of any size."""
    gone = contained_in(rows, key, text).select(F.struct(key, text).alias("_x")).distinct()
    d = rows.where(F.coalesce(F.col(text), F.lit("")) != "").select(key, text).distinct().withColumn("_x", F.struct(key, text))
    return d.join(gone, "_x", "left_anti").select(key, text)
