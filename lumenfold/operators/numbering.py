"""Row numbers in a total order, without a task that sorts everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import durable


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "index", partitions: int | None = None) -> DataFrame:
    """df with its index, from 0, in a total order.

    Ranges of the order (as many as the session shuffles into, unless told) are numbered apart and
    their sizes added up. The ranges are checkpointed: were they dealt again, they might be cut
    elsewhere.
    """
    dealt = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    by = durable(dealt.withColumn("_p", F.spark_partition_id()))
    n = by.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return by.withColumn("_i", own).join(F.broadcast(n.select("_p", "_before")), "_p").withColumn(name, (F.col("_i") + F.col("_before")).cast("long")).drop("_p", "_i", "_before")
