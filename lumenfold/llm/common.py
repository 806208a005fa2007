"""What the operators share: durable intermediate tables, ids, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.session import durable

#: ASCII white space: the separators of a word.
WORD_GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids have no fold."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds))


def drop_clashing(df: DataFrame, names: list[str]) -> DataFrame:
    """An operator's own columns replace input columns of the same name (in any case)."""
    own = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in own])


def rows_of(batch: pa.RecordBatch, most_rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batch in short slices, so that what Python holds at once stays small."""
    for at in range(0, batch.num_rows, most_rows):
        yield batch.slice(at, most_rows)


def text_slices(batch: pa.RecordBatch, at: int, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about most_bytes of column `at` (text or binary); a longer value stands alone."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0)))
    done = 0
    while done < batch.num_rows:
        to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + most_bytes, "right")))
        yield batch.slice(done, to - done)
        done = to


def with_columns(batch: pa.RecordBatch, extra: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *extra.values()], names=[*batch.schema.names, *extra])


def join_hot(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """left with right's columns by key (inner), where right has each key once with n, the number of its rows in left, and left has total rows.

    At most 1,000 keys can hold a thousandth of left's rows each: those of right are broadcast, so a
    hot key's rows stay where they are; what is left has no hot key and is shuffled.
    """
    least = max(total, 1000)
    value = [c for c in right.columns if c not in (key, "n")]
    hot = right.where(F.col("n") * 1000 >= least).select(key, *value, F.lit(True).alias("_hot"))
    cold = right.where(F.col("n") * 1000 < least).select(key, *value)
    met = left.join(F.broadcast(hot), key, "left")
    return met.where("_hot").drop("_hot").unionByName(met.where("_hot is null").select(*left.columns).join(cold, key))


def without_ids(docs: DataFrame, ids: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """docs less the rows whose doc_id is in ids (which has each once). Up to broadcast_rows ids go to the rows; more meet them in a shuffle."""
    ids = durable(ids.select("doc_id"))
    return docs.join(F.broadcast(ids) if ids.count() <= broadcast_rows else ids, "doc_id", "left_anti").select(*docs.columns)


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, train: Column, most_rows: dict[int, int], most_chars: int = 64_000_000) -> tuple[DataFrame, dict[int, int]]:
    """(place long from 0, text, y) of at most most_rows[value] labelled texts of each value, of most_chars characters in all, for fitting, and {label: training rows}.

    label: SQL for the label of a row of labels; null labels and ids are passed over. Rows are
    chosen by a hash of the id, so the choice is the same on every run and cluster; an id that
    docs lacks gives no row, and one that it has repeatedly gives its least text, found where the
    rows are. Only ids and labels are ranked; the chosen ids are bounded by most_rows, which is
    what allows them to be broadcast, and their texts are taken in the order of the hash
    until the next would pass most_chars. Texts of over a sixty-fourth of most_chars come after all
    others, and one of over most_chars is set aside alone, so no single text empties the sample.
    Places follow the ids. The texts stay on executors, in as many partitions as the session runs tasks at once.
    """
    known = labels.where(train).select("doc_id", F.expr(label).cast("int").alias("y")).where("y is not null and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ids = {}
    for value, most in most_rows.items():
        for r in known.where(F.col("y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect():
            ids[r["doc_id"]] = r["y"]
    spark = docs.sparkSession
    if not ids:
        return spark.createDataFrame([], "place long, text string, y int"), totals
    small = spark.createDataFrame(list(ids.items()), "doc_id long, y int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(small), "doc_id")
    one = durable(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).repartition(spark.sparkContext.defaultParallelism, "doc_id"))
    sizes = one.select("doc_id", F.length("text").cast("long").alias("n")).where(F.col("n") <= most_chars)
    before = F.sum("n").over(Window.orderBy(F.col("n") * 64 > most_chars, F.xxhash64("doc_id"), "doc_id"))  # at most most_rows of each value
    fits = sizes.select("doc_id", before.alias("chars")).where(F.col("chars") <= most_chars)
    fits = fits.select("doc_id", (F.row_number().over(Window.orderBy("doc_id")) - 1).cast("long").alias("place"))
    return one.join(F.broadcast(durable(fits)), "doc_id").select("place", "text", "y"), totals


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most_rows: dict[int, int], most_chars: int = 64_000_000) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """The texts and labels of labelled_rows in the order of their places, here, and {label: training rows}: for samples that are known to be small."""
    rows, totals = labelled_rows(docs, labels, label, train, most_rows, most_chars)
    held = rows.orderBy("place").select("text", "y").toArrow()
    return list(zip(held["text"].to_pylist(), held["y"].to_pylist(), strict=True)), totals


def collected(rows: DataFrame, features, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, rows of features of each text, y) of labelled_rows, in the order of places. features(places, texts) gives (a row of `width` numbers or several for each text, first row of each text and the end); texts never leave their tasks."""

    def run(batches):
        for big in batches:
            for batch in rows_of(big, 256):
                x, cuts = features(np.asarray(batch.column(0)), batch.column(1).to_pylist())
                x = pa.ListArray.from_arrays(pa.array(cuts * width, pa.int32()), pa.array(x.reshape(-1), pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), x, batch.column(2)], names=["place", "x", "y"])

    held = rows.select("place", "text", "y").mapInArrow(run, "place long, x array<double>, y int").toArrow().combine_chunks().sort_by("place")
    x = held["x"].combine_chunks()
    return np.asarray(x.flatten()).reshape(-1, width), np.asarray(pc.list_value_length(x)) // width, np.asarray(held["y"])
