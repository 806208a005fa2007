"""Vectors from texts, by an encoder that the caller brings; vector and schema checks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode(records: DataFrame, key: str, text: str, make: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64, normalize: bool = True) -> DataFrame:
    """(key, embedding): `make` is called once per task and returns the encoder of a list of texts. Null texts are empty; unit length unless told otherwise (a vector without length stays as it is)."""
    kind = dict(records.dtypes)[key]

    def run(batches):
        encoder = make()
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                x = np.asarray(encoder([t or "" for t in part.column(1).to_pylist()]), dtype=np.float32)
                if normalize:
                    n = np.linalg.norm(x, axis=1, keepdims=True)
                    x = np.divide(x, n, out=x.copy(), where=n > 0)
                cuts = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(cuts, pa.array(x.ravel()))], names=["key", "embedding"])

    return records.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"key {kind}, embedding array<float>").withColumnRenamed("key", key)


def field_paths(kind: T.DataType, at: str = "") -> Iterable[str]:
    """Dotted paths of all fields of a schema, those inside lists and maps included."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            path = f"{at}.{f.name}" if at else f.name
            yield path
            yield from field_paths(f.dataType, path)
    elif isinstance(kind, T.ArrayType):
        yield from field_paths(kind.elementType, at)
    elif isinstance(kind, T.MapType):
        yield from field_paths(kind.valueType, at)


def forbidden_fields(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Paths whose last part is a forbidden name."""
    bad = set(names)
    return [p for p in field_paths(df.schema) if p.rsplit(".", 1)[-1] in bad]


def keys_of_json(text: Column) -> Column:
    """All keys of a JSON document, at any depth, in order and with repeats; of a null none (null).

    Escaped backslashes and quotes are set aside (control characters cannot stand in JSON text), so every string is
    a run between two quotes, and a key is one that a colon follows. Nothing is nested in the pattern, so depth and length do not matter.
    """
    plain = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    strings = F.regexp_extract_all(plain, F.lit(r'("[^"]*+"(?:\s*+:)?)'), F.lit(1))
    keys = F.transform(F.filter(strings, lambda s: F.right(s, F.lit(1)) == ":"), lambda s: F.regexp_extract(s, r'^("[^"]*+")', 1))
    whole = F.replace(F.replace(F.concat(F.lit("["), F.array_join(keys, ","), F.lit("]")), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    return F.from_json(whole, "array<string>")


def forbidden_keys(text: Column, names: Iterable[str]) -> Column:
    """The forbidden ones among a JSON document's keys, sorted, with repeats."""
    bad = F.array(*[F.lit(n) for n in sorted(set(names))]) if names else F.array().cast("array<string>")
    return F.array_sort(F.filter(keys_of_json(text), lambda k: F.array_contains(bad, k)))
