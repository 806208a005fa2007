"""Scans of documents in the shapes that the analyses read."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions.text import collapse
from lumenfold.session import durable


def json_object(spark: SparkSession, path: str, record: T.StructType, key: str = "id") -> DataFrame:
    """Records of a JSON object keyed by id, with their position in it as ord. A key that isn't its record's id is an error, as is an object with a list of requirements.

    A raw line break cannot stand inside a JSON string, so two layouts show record borders to Spark's text
    reader, which then reads one file as many splits: a record a line (as sinks.write_json_object writes; a folder's
    parts are taken in the order of their names), and an indented object, whose records end where a brace stands
    alone at the first indent. Any other layout, or a file that doesn't keep to its own, is read whole, by one task.
    """
    raw = split_records(spark, path, record)
    if raw is None:
        m = spark.read.text(path, wholetext=True).select(F.from_json("value", T.MapType(T.StringType(), record)).alias("m"), F.json_object_keys("value").alias("k"))
        bad = F.array_contains("k", "requirements")
        m = m.select(F.when(bad, F.raise_error(F.lit("a list of requirements, not an object keyed by id")).cast(T.MapType(T.StringType(), record))).otherwise(F.col("m")).alias("m"))
        raw = m.select(F.posexplode("m").alias("ord", "_key", "r")).withColumn("ord", F.col("ord").cast("long"))
    out = raw.select("ord", "_key", "r.*")
    same = F.when(F.col("_key") == F.col(key), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("key and id differ: "), F.coalesce("_key", F.lit("")))).cast("string"))
    return out.withColumn(key, same).drop("_key")


HEAD = 65536


def separator(head: str) -> str | None:
    """What ends a record of a JSON object that begins so: a line break after a record a line, a brace alone at the first indent in an indented object, None where neither is seen."""
    indented = re.match(r'\{(\r?\n)([ \t]+)"', head)
    if indented:
        return f"{indented[1]}{indented[2]}}},{indented[1]}"
    return "\n" if re.match(r'\{"[^\n]*,\r?\n"', head) else None


def layout(spark: SparkSession, path: str) -> tuple[str | None, bool]:
    """(separator of a JSON object's records, whether it is a folder of parts); a file's is told by its first 64 kB."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = fs.getFileStatus(at)
    if status.isDirectory():
        return "\n", True
    stream = fs.open(at)
    try:
        head = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(min(HEAD, status.getLen()))))
    finally:
        stream.close()
    return separator(head.decode("utf-8", "replace")), False


def split_records(spark: SparkSession, path: str, record: T.StructType) -> DataFrame | None:
    """(ord, _key, r) of a JSON object whose layout shows its records' borders; None if it doesn't.

    A row's place is the number of rows in the splits before its own plus its place in that split, where rows
    come in order; a split is one row of a small table, made on a pass that also sees whether each row is one record.
    """
    sep, parts = layout(spark, path)
    if sep is None:
        return None
    raw = spark.read.text(path, lineSep=sep).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_i"))
    v = F.regexp_replace("value", r"\s++\z", "")
    if sep == "\n":
        cut = F.when(v.endswith(","), F.concat(F.left(v, F.length(v) - 1), F.lit("}"))).otherwise(v)
    else:
        last = F.col("value").rlike(sep[: sep.index("}")] + r"\}\s*+\}\s*+\z")
        cut = F.when(last, v).otherwise(F.concat(v, F.lit("}}")))
    text = F.when(F.ltrim("value").startswith("{"), cut).otherwise(F.concat(F.lit("{"), cut))
    raw = raw.select(text.alias("_t"), "_f", "_s", "_i").where("_t <> '{}'")
    single = F.coalesce(F.size(F.json_object_keys("_t")) == 1, F.lit(False))
    splits = durable(raw.groupBy("_f", "_s").agg(F.count("*").alias("n"), F.min("_i").alias("_first"), F.bool_or(~single).alias("bad")))
    if not splits.where("bad").isEmpty():
        if parts:
            raise ValueError(f"{path}: a part of an object holds a line that isn't one record")
        return None
    before = F.sum("n").over(Window.orderBy(F.length("_f"), "_f", "_s")) - F.col("n")
    placed = raw.join(splits.select("_f", "_s", "_first", before.alias("_before")), ["_f", "_s"])
    m = F.map_entries(F.from_json("_t", T.MapType(T.StringType(), record)))[0]
    return placed.select((F.col("_before") + F.col("_i") - F.col("_first")).cast("long").alias("ord"), m.alias("m")).select("ord", F.col("m.key").alias("_key"), F.col("m.value").alias("r"))


def vector_cache(spark: SparkSession, path: str, **expected) -> DataFrame:
    """(id, ord, vector) of a cache that sinks.write_vector_cache wrote, if it is what its sidecar says and the sidecar says what is expected; else an error that names every field that differs.

    Held against the table itself: rows, content, dimension, component type, ids in order. expected: those or further facts of the sidecar, such as a model's name or the digest of the ids wanted.
    """
    from lumenfold.sources.sinks import content, vector_facts

    told = json.loads("\n".join(r[0] for r in spark.read.text(path + ".json", wholetext=True).collect()))  # one small document
    v = spark.read.parquet(path)
    said = {**told["facts"], "rows": told["rows"], "content_digest": told["content_digest"]}
    found = {**content(v), **vector_facts(v)}
    wrong = sorted({n for n, x in found.items() if said.get(n) != x} | {n for n, x in expected.items() if n not in said or said[n] != x})
    if wrong:
        raise ValueError(f"{path}: the cache, its sidecar and what is expected differ in " + ", ".join(wrong))
    return v


def json_list(spark: SparkSession, path: str, record: T.StructType, field: str = "requirements") -> DataFrame:
    """Records of a list inside a JSON document, with their position as ord."""
    schema = T.StructType([T.StructField(field, T.ArrayType(record))])
    raw = spark.read.schema(schema).json(path, multiLine=True)
    return raw.select(F.posexplode(field).alias("ord", "r")).select("ord", "r.*")


def csv_windows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A semicolon-separated file in windows-1252 with a header.

    Spark's CSV reader doesn't take that charset: the file is read as ISO-8859-1, which differs in
    the control range alone, and that range is then translated.
    """
    here = "".join(chr(b) for b in range(0x80, 0xA0))
    there = "".join(bytes([b]).decode("windows-1252", "replace") for b in range(0x80, 0xA0))
    df = spark.read.schema(schema).csv(path, sep=";", encoding="iso-8859-1", header=True)
    return df.select(*[F.translate(c, here, there).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str) -> DataFrame:
    """One row for each element of the tag; namespaces are ignored."""
    return spark.read.schema(schema).format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").load(path)


def text_files(spark: SparkSession, folder: str, name: str, expected: int | None = None) -> DataFrame:
    """(name, text) of the files below a folder whose name matches the pattern (in any case, with (?i)), in any order; sort by lower(name) where order matters. expected: how many there must be."""
    f = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(folder).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("name"), F.col("value").alias("text"))
    out = f.where(F.col("name").rlike(name))
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"{n} files match {name!r}, {expected} are expected")
    return out


def decoded_pages(spark: SparkSession, path: str, decode: Callable[[bytes], Iterator[str]]) -> DataFrame:
    """(path, page_index, page_number, text) of binary documents, by a decoder that the caller brings."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p, i, i + 1, t) for p, c in zip(pdf["path"], pdf["content"], strict=True) for i, t in enumerate(decode(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "page_index", "page_number", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page_index int, page_number int, text string")


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """df, if it has all required columns; a table without rows passes, one without a column is an error that names all that lack."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return df


def page_range(pages: DataFrame, low: int, high: int) -> DataFrame:
    return pages.where(F.col("page_number").between(low, high))


def previews(pages: DataFrame, chars: int = 700) -> DataFrame:
    return pages.withColumn("preview", F.left(collapse(F.col("text")), F.lit(chars)))


def first_of(*names: str, kind: str | None = None) -> Callable[[DataFrame], Column]:
    """The first of several column names that a table has and that isn't null; null if it has none."""

    def column(df: DataFrame) -> Column:
        found = [F.col(n).try_cast(kind) if kind else F.col(n) for n in names if n in df.columns]
        return F.coalesce(*found) if found else F.lit(None).cast(kind or "string")

    return column


def grep_context(df: DataFrame, key: str, text: str, pattern: str, before: int, after: int) -> DataFrame:
    """(key, line, text, hit): matching lines and those up to `before` above and `after` below, each once.

    A window over each document's own lines; no line meets another.
    """
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line", "text")).withColumn("hit", F.col("text").rlike(pattern))
    w = Window.partitionBy(key).orderBy("line").rowsBetween(-after, before)
    return lines.withColumn("near", F.bool_or("hit").over(w)).where("near").drop("near")
