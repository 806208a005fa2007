"""Fill-in-middle transformation by overlapping chunks.

A text's tokens end where a character outside white space meets white space, so a boundary shows in two
adjacent characters. Chunks that overlap by one byte are therefore counted independently of each
other; prefix sums of the counts say which chunk owns the boundary of a given rank, and only the two
owning chunks are scanned again for the places of the cuts. White space is ASCII, so bytes decide.
Cuts are found on Arrow batches; texts are put together by expressions, so they go to Python but not back.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import drop_clashing, read

#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
OWN = ["n", "form", "prefix_chars", "middle_chars", "output"]

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def _scan(raw: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether a boundary lies before each byte of the chunk, whether the byte begins a character); a chunk but the first also sees the byte before it."""
    gap = _GAP[raw[max(start - 1, 0) : end]]
    edge = gap[1:] & ~gap[:-1]
    return (edge if start else np.concatenate([[False], edge])), (raw[start:end] & 0xC0) != 0x80


def cuts(raw: np.ndarray, first: int, second: int, chunk: int = 1 << 16) -> tuple[int, int, int]:
    """(n, characters before either cut in order) of a text's bytes; the cuts' ranks are first and second modulo n + 1, the smaller before."""
    starts = range(0, len(raw), chunk)
    seen = [tuple(map(np.count_nonzero, _scan(raw, s, s + chunk))) for s in starts]
    edges, chars = [[0, *accumulate(x[k] for x in seen)] for k in (0, 1)]
    n = edges[-1] + 1 if len(raw) else 0

    def place(rank: int) -> int:
        if rank in (0, n):
            return chars[-1] if rank else 0
        own = bisect_left(edges, rank) - 1
        edge, begins = _scan(raw, own * chunk, own * chunk + chunk)
        at = int(np.flatnonzero(edge)[rank - edges[own] - 1])
        return chars[own] + int(np.count_nonzero(begins[:at]))

    low, high = sorted((first % (n + 1), second % (n + 1)))
    return n, place(low), place(high)


def cut_columns(text: Column, first: Column, second: Column, chunk: int = 1 << 16) -> Column:
    """cuts() as a struct (n, low, high) of a column of texts without nulls."""

    @F.arrow_udf("struct<n:long,low:long,high:long>")
    def found(texts: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
        raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
        rows = [cuts(raw[i:j], x, y, chunk) for i, j, x, y in zip(at.tolist(), at[1:].tolist(), a.to_pylist(), b.to_pylist(), strict=False)]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))], names=["n", "low", "high"])

    return found(text, first, second)


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 42, rate: int = 50, spm_rate: int = 80, chunk: int = 1 << 16) -> DataFrame:
    """docs with n (tokens), form (plain, psm or spm), prefix_chars and middle_chars (code points; null if plain) and output appended.

    Cuts and form follow from a digest of seed and id: of 100 texts about `rate` are cut, and of those
    about spm_rate take the form that begins with the suffix. Null texts are empty; empty texts and texts
    that hold a mark stay plain. Null ids count as empty. Repeated rows are cut alike; very long texts are
    scanned by chunks. Empty table: no rows. Input columns with an output's name are replaced.
    """
    docs = drop_clashing(docs, [n for n in OWN if n not in (text, doc_id)])
    names = docs.columns
    taken = {c.lower() for c in names}
    t, h, c = (next(f"_{n}{'_' * k}" for k in range(len(taken) + 1) if f"_{n}{'_' * k}" not in taken) for n in ("text", "hashes", "cuts"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))), 256)
    hashes = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substr(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    df = docs.withColumn(t, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).withColumn(h, hashes)
    df = df.withColumn(c, cut_columns(F.col(t), F.get(F.col(h), F.lit(0)), F.get(F.col(h), F.lit(1)), chunk))
    whole, low, high = F.col(t), F.col(c)["low"], F.col(c)["high"]
    marked = F.contains(whole, F.lit(PREFIX)) | F.contains(whole, F.lit(SUFFIX)) | F.contains(whole, F.lit(MIDDLE))
    plain = (whole == "") | marked | (F.get(F.col(h), F.lit(2)) % 100 >= rate)
    df = df.withColumn("form", F.when(plain, "plain").when(F.get(F.col(h), F.lit(3)) % 100 < spm_rate, "spm").otherwise("psm"))
    prefix, middle, suffix = F.substr(whole, F.lit(1), low.cast("int")), F.substr(whole, low.cast("int") + 1, (high - low).cast("int")), F.substr(whole, high.cast("int") + 1)
    output = F.when(F.col("form") == "plain", whole).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    cut = F.col("form") != "plain"
    return df.select(*[F.col(f"`{x}`") for x in names], F.col(c)["n"].alias("n"), "form", F.when(cut, low).alias("prefix_chars"), F.when(cut, high - low).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A cut text holds no mark, and none can arise where it meets one, so the marks part it into three."""
    parts = F.split(F.substr(output, F.lit(len(PREFIX) + 1)), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(0), part(2), part(1))).otherwise(F.concat(part(1), part(2), part(0)))


def op13_fill_in_middle(spark, sf_dir):
    out = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, h, CASE WHEN t = '' THEN []::VARCHAR[] ELSE regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') END AS ws,
             [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS x FROM d),
c AS (SELECT *, len(ws) AS n, least(x[1] % (len(ws) + 1), x[2] % (len(ws) + 1)) AS a, greatest(x[1] % (len(ws) + 1), x[2] % (len(ws) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR x[3] % 100 >= 50 THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(ws[1:a], '') AS pre, array_to_string(ws[a + 1:b], '') AS mid, array_to_string(ws[b + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN len(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN len(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p"""
