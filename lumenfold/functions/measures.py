"""Aggregate expressions: descriptive statistics, shares, concentration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, digits: int | None = None) -> Column:
    """100 * part / whole, 0 where the whole is 0."""
    value = F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))
    return value if digits is None else F.round(value, digits)


#: Percentiles of describe and quartiles, by name.
DESCRIBED, QUARTERS = {"median": 0.5, "p90": 0.9, "p95": 0.95}, {"q25": 0.25, "median": 0.5, "q75": 0.75}


def describe(x: Column, prefix: str, empty: float | None = 0.0, ranks: bool = True) -> list[Column]:
    """min, mean, median, p90, p95 and max; `empty` stands for each over no value (None: null).

    Spark's `percentile` keeps a group's distinct values in one task. That suits small counts; ranks=False leaves the
    percentiles to operators.percentiles, which doesn't.
    """
    p = {"min": F.min(x), "mean": F.avg(x), "median": F.percentile(x, 0.5), "p90": F.percentile(x, 0.9), "p95": F.percentile(x, 0.95), "max": F.max(x)}
    return [(F.coalesce(v.cast("double"), F.lit(empty)) if empty is not None else v.cast("double")).alias(f"{prefix}_{k}") for k, v in p.items() if ranks or k not in DESCRIBED]


def sample_stdev(x: Column) -> Column:
    """Sample standard deviation: 0 of one value, null of none."""
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x))


def quartiles(x: Column, prefix: str, digits: int = 6, ranks: bool = True) -> list[Column]:
    """n, min, q25, median, mean, q75, max, std, rounded; null over no value. ranks: as in describe."""
    p = {"min": F.min(x), "q25": F.percentile(x, 0.25), "median": F.percentile(x, 0.5), "mean": F.avg(x), "q75": F.percentile(x, 0.75), "max": F.max(x), "std": F.stddev_samp(x)}
    return [F.count(x).alias(f"{prefix}_n"), *(F.round(v.cast("double"), digits).alias(f"{prefix}_{k}") for k, v in p.items() if ranks or k not in QUARTERS)]


def share(n: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), total), F.lit(0.0))


def herfindahl(p: Column) -> Column:
    """Sum of squared shares."""
    return F.coalesce(F.sum(p * p), F.lit(0.0))


def entropy(p: Column) -> Column:
    """Shannon entropy in bits; at most one key: 0."""
    return F.when(F.count(p) <= 1, F.lit(0.0)).otherwise(F.coalesce(-F.sum(F.when(p > 0, p * F.log2(p))), F.lit(0.0)))


def normalized_entropy(p: Column) -> Column:
    """Entropy over its largest value for the keys that occur; at most one key: 0."""
    return F.when(F.count(p) <= 1, F.lit(0.0)).otherwise(entropy(p) / F.log2(F.count(p).cast("double")))


def gini(n: Column, ascending_rank: Column) -> Column:
    """Gini index of counts n with ascending rank 1..N; nothing: 0."""
    k, total = F.count(n), F.sum(n)
    return F.when(F.coalesce(total, F.lit(0)) > 0, 2.0 * F.sum(ascending_rank * n) / (k * total) - (k + 1.0) / k).otherwise(F.lit(0.0))
