"""Assembly of candidates with their dimensions, nested and flat forms, set differences and diffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import durable


def missing_and_extra(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, side): ids expected but not found, and found but not expected."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def same_set(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> bool:
    """Whether two tables hold the same keys, each once."""
    x, y = a.select(*keys), b.select(*keys)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def subset(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> bool:
    """Whether every key of a is a key of b."""
    return a.select(*keys).join(b.select(*keys).distinct(), list(keys), "left_anti").isEmpty()


def require(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """df itself; a row where bad holds stops the query with the message."""
    return df.where(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))


def enrich(facts: DataFrame, dimension: DataFrame, key: str, on_missing: str = "fail") -> DataFrame:
    """Facts with their dimension record. A missing one: fail, quarantine (kept, flagged `unmatched`) or skip."""
    if on_missing == "skip":
        return facts.join(dimension, key)
    found = facts.join(dimension.withColumn("_there", F.lit(True)), key, "left")
    if on_missing == "quarantine":
        return found.withColumn("unmatched", F.col("_there").isNull()).drop("_there")
    if on_missing != "fail":
        raise ValueError(on_missing)
    return require(found, F.col("_there").isNull(), f"no record in the dimension for a {key}").drop("_there")


def conditional_lookup(facts: DataFrame, dimension: DataFrame, key: str, when: Column, columns: dict[str, Column]) -> DataFrame:
    """Left lookup for the facts where `when` holds; the others, and misses, get the given defaults."""
    d = dimension.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    j = facts.join(d, key, "left")
    return j.select(*facts.columns, *[F.coalesce(F.when(when, F.col(f"_{c}")), default).alias(c) for c, default in columns.items()])


def nest(candidates: DataFrame, keys: Sequence[str] = ("source", "source_id")) -> DataFrame:
    """One row per rule: its matches as a list in rank order."""
    fields = ["rank", *[c for c in candidates.columns if c not in (*keys, "rank")]]
    return candidates.groupBy(*keys).agg(F.count("*").cast("int").alias("candidate_count"), F.array_sort(F.collect_list(F.struct(*fields))).alias("matches"))


def flatten(nested: DataFrame, keys: Sequence[str] = ("source", "source_id")) -> DataFrame:
    """Flat records of nested matches, with their place in the list."""
    return nested.select(*keys, F.posexplode("matches").alias("place", "m")).select(*keys, "place", "m.*")


def field_overrides(records: DataFrame, overrides: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Records with curated values: (key, field, value, allow_replace). Replacing a filled value without leave stops the query."""
    long = records.select(*key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("old")) for f in fields])).alias("x")).select(*key, "x.*")
    j = long.join(overrides.select(*key, "field", F.col("value").alias("_new"), F.col("allow_replace"), F.lit(True).alias("_hit")), [*key, "field"], "left")
    j = require(j, F.col("_hit") & (F.coalesce("old", F.lit("")) != "") & ~F.coalesce("allow_replace", F.lit(False)), "a curated value would replace a filled field without leave")
    value = F.when(F.coalesce("_hit", F.lit(False)), F.col("_new")).otherwise(F.col("old"))
    back = j.withColumn("v", value).groupBy(*key).pivot("field", list(fields)).agg(F.first("v"))
    return records.drop(*fields).join(back, list(key))


def field_changes(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, old, new) of every field whose value differs, null-safe."""
    def long(df: DataFrame, name: str) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields]))
        return df.select(key, each.alias("x")).select(key, "x.*")

    j = long(before, "old").join(long(after, "new"), [key, "field"])
    return j.where(~F.col("old").eqNullSafe(F.col("new")))


def orphans(records: DataFrame, own: str, parent: str, is_parent: Column) -> DataFrame:
    """Records whose parent isn't among the parent records."""
    known = records.where(is_parent).select(F.col(own).alias(parent)).distinct()
    return records.where(F.col(parent).isNotNull()).join(known, parent, "left_anti")


def parity(a: DataFrame, b: DataFrame, order: str, fields: Sequence[str]) -> DataFrame:
    """Rows at which two tables in the same order differ: (order, fields that differ)."""
    x, y = a.select(order, *[F.col(f).alias(f"_a_{f}") for f in fields]), b.select(order, *[F.col(f).alias(f"_b_{f}") for f in fields])
    j = x.join(y, order, "full")
    diff = F.filter(F.array(*[F.when(~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")), F.lit(f)) for f in fields]), lambda n: n.isNotNull())
    return j.select(order, diff.alias("differs")).where(F.size("differs") > 0)


def page_blocks(pages: DataFrame, document: str, page: str, text: str, central: int = 2, context: int = 1) -> DataFrame:
    """Blocks of `central` pages with `context` pages around them: block_id, page lists by role, text with role marks, in page order.

    A page is dealt to the few blocks it belongs to by arithmetic, so blocks meet pages by key.
    """
    own = F.floor(F.col(page) / central)
    near = F.array_distinct(F.transform(F.sequence(F.lit(-context), F.lit(context)), lambda d: F.floor((F.col(page) + d) / central)))
    last = F.max(own).over(Window.partitionBy(document))
    dealt = pages.withColumn("_last", last).withColumn("_own", own).select("*", F.explode(near).alias("block_id")).where((F.col("block_id") >= 0) & (F.col("block_id") <= F.col("_last")))
    role = F.when(F.col("block_id") == F.col("_own"), "CENTRAL").otherwise("CONTEXT")
    part = F.concat(F.lit("["), role, F.lit(" PAGE "), F.col(page).cast("string"), F.lit("]\n"), F.coalesce(F.col(text), F.lit("")))
    g = dealt.groupBy(document, "block_id").agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), role.alias("r"), part.alias("t")))).alias("x"))
    pick = lambda r: F.transform(F.filter("x", lambda s: s["r"] == r), lambda s: s["p"])
    return g.select(document, F.col("block_id").cast("int").alias("block_id"), pick("CENTRAL").alias("central_pages"), pick("CONTEXT").alias("context_pages"), F.array_join(F.transform("x", lambda s: s["t"]), "\n\n").alias("text"))


def range_join(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, first: str, last: str, hot: int = 100_000) -> DataFrame:
    """points joined to the ranges of their keys that hold them: first <= at <= last, whole numbers, both ends included.

    A range is put into the one or two bins that hold it among bins of the least power of two that is as wide as it is;
    a point looks into one bin for each width that occurs (64 at most), so neither long ranges nor many widths
    multiply rows. Bins with more than `hot` points are dealt in parts, to which their ranges are copied. Nulls, and ranges
    that end before they begin, meet nothing; repeated rows meet as often as they stand there.
    """
    bins = ["_width", "_bin"]
    r = ranges.where(F.col(last) >= F.col(first)).withColumn("_width", F.length(F.bin(F.col(last).cast("long") - F.col(first).cast("long"))).cast("int"))
    low, high = F.col(first).cast("long"), F.col(last).cast("long")
    r = r.withColumn("_bin", F.explode(F.array_distinct(F.array(F.call_function("shiftright", low, F.col("_width")), F.call_function("shiftright", high, F.col("_width"))))))
    widths = sorted(x["_width"] for x in r.select("_width").distinct().collect())
    p = points.where(F.col(at).isNotNull()).withColumn("_width", F.explode(F.array(*[F.lit(w) for w in widths]).cast("array<int>")))
    p = p.withColumn("_bin", F.call_function("shiftright", F.col(at).cast("long"), F.col("_width")))
    crowded = p.groupBy(*keys, *bins).agg(F.count("*").alias("_n")).where(F.col("_n") > hot)  # one for each `hot` points at most
    crowded = durable(crowded.select(*keys, *bins, F.ceil(F.col("_n") / hot).alias("_parts")))
    if crowded.isEmpty():
        p, r, by = p, r, [*keys, *bins]
    else:
        by = [*keys, *bins, "_part"]
        p = p.join(crowded, [*keys, *bins], "left").withColumn("_part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in points.columns]), F.coalesce("_parts", F.lit(1)))).drop("_parts")
        r = r.join(crowded, [*keys, *bins], "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    held = F.col(at).between(F.col(first), F.col(last))
    return p.join(r, by).where(held).drop(*bins, "_part")
