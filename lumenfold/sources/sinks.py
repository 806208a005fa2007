"""Sinks: tables that refuse to be overwritten, canonical JSON, CSV for display, sidecars and short reports."""

from __future__ import annotations

import hashlib
import json
import platform
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), overwrite: bool = False) -> None:
    """Parquet through Spark's commit protocol; what is there already stays unless overwriting is asked for."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def canonical_json(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as JSON text with sorted keys, nulls kept, scores unrounded."""
    body = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")
    return df.select(key, body) if key else df.select(body)


def write_json_object(df: DataFrame, path: str, key: str, order: str) -> None:
    """One JSON object keyed by id, in the order of `order` and then key: a folder of text parts, a record a line, whose bytes in the order of their names are the object.

    Parts are ranges of the order, written and committed by Spark's own protocol: no task and not the driver
    holds it all, a failed job leaves nothing readable, and what is there already stays (an error). A key that is
    null or there twice is an error before anything is written. An empty table gives {}.
    """
    places = df.groupBy(F.col(key).cast("string").alias("k")).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    ends = places.agg(F.count("*").alias("keys"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.count_if(F.col("k").isNull()).alias("nulls"), F.min(F.struct("o", "k"))["k"].alias("first"), F.max(F.struct("o", "k"))["k"].alias("last")).first()
    if ends["nulls"] or ends["most"] > 1:
        raise ValueError(f"{key} is null or repeated: not an object's key")
    if not ends["keys"]:
        df.sparkSession.createDataFrame([("{}",)], "value string").coalesce(1).write.mode("errorifexists").text(path)
        return
    k = F.col(key).cast("string")
    name = F.to_json(F.array(k))
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != order]), {"ignoreNullFields": "false"})
    line = F.concat(F.when(k == ends["first"], "{").otherwise(""), F.substr(name, F.lit(2), F.length(name) - 2), F.lit(":"), record, F.when(k == ends["last"], "}").otherwise(","))
    df.select(F.col(order).alias("_o"), k.alias("_k"), line.alias("value")).orderBy("_o", "_k").select("value").write.mode("errorifexists").text(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text file on any Hadoop file system: written beside its place, then renamed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs = to.getFileSystem(conf)
    if fs.exists(to):
        raise FileExistsError(path)
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, to):
        raise OSError(f"cannot rename to {path}")


def display(df: DataFrame, digits: int = 6) -> DataFrame:
    """For people: doubles with fixed digits, nested values as JSON, lists of text joined by commas."""
    def shown(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c)).alias(f.name)
        if isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.StructType, T.ArrayType, T.MapType)):
            return F.array_join(F.transform(c, lambda x: x.cast("string")), ", ").alias(f.name)
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(c).alias(f.name)
        return c

    return df.select(*[shown(f) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, digits: int = 6) -> None:
    display(df, digits).write.mode("errorifexists").csv(path, header=True)


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; a column that one lacks is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def content(df: DataFrame) -> dict:
    """rows and content_digest (which the order of rows does not change) of a table."""
    h = F.xxhash64(*[F.to_json(F.struct(f"`{c}`")) for c in sorted(df.columns)])
    row = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest")).first()
    return {"rows": row["rows"], "content_digest": hashlib.sha256(row["digest"].encode()).hexdigest()}


def sidecar(df: DataFrame, path: str, inputs: dict[str, DataFrame] | None = None, **facts) -> dict:
    """Writes and returns what is known of a result: schema, row count and content digest, those of its inputs, the caller's facts, versions."""
    out = {**content(df), "inputs": {n: content(x) for n, x in (inputs or {}).items()}, "schema": json.loads(df.schema.json()), "facts": facts, "python": platform.python_version(), "spark": df.sparkSession.version}
    write_text(df.sparkSession, json.dumps(out, ensure_ascii=False, indent=2, sort_keys=True), path)
    return out


def write_vector_cache(df: DataFrame, path: str, key: str, vector: str, order: str, **facts) -> dict:
    """(key, order, vector) as Parquet at path, sorted, and beside it path.json: what vector_cache holds the table to: rows, digests of the content and of the ids in order, dimension, component type, the caller's facts."""
    v = df.select(F.col(key).cast("string").alias("id"), F.col(order).cast("long").alias("ord"), F.col(vector).alias("vector"))
    write_table(v.orderBy("ord"), path)
    return sidecar(df.sparkSession.read.parquet(path), path + ".json", **vector_facts(df.sparkSession.read.parquet(path)), **facts)


def vector_facts(v: DataFrame) -> dict:
    """dimension (null if vectors differ in it), component type and the digest of the ids in order of a vector table (id, ord, vector)."""
    from lumenfold.operators.batches import content_digest

    size = v.agg(F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
    return {"dimension": size["low"] if size["low"] == size["high"] else None, "dtype": v.schema["vector"].dataType.elementType.simpleString(), "ordered_ids_sha256": content_digest(v.select("ord", "id"), ["ord"])}


def markdown_report(title: str, tables: dict[str, DataFrame], most_rows: int = 50) -> str:
    """A short report of small aggregate tables."""
    out = [f"# {title}"]
    for name, df in tables.items():
        rows = display(df).limit(most_rows).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows]
    return "\n".join(out) + "\n"
