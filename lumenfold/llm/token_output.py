"""Training-order token shards.

Every document becomes fixed-stride sequences of token ids. A keyed Feistel permutation with
cycle-walking maps each sequence's number (document, part) to a place in the same domain; the
places are uniform, so equal ranges of them are partitions of equal size, and a sequence's global
slot is the rank of its place. Each range is one shard file whose record i belongs to slot
first + i. A reader in training order is therefore sequential and resumes at any slot by
arithmetic. The order depends on ids, texts and key alone, not on how the input was split.
"""

from __future__ import annotations

import base64
import os
import re
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import durable, read, rows_of

#: Where the public vocabulary is, unless a caller says otherwise, and the id that ends a document (free in that vocabulary).
RANKS_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_ID = 50256
#: Fixed value: the published pre-tokenizer pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A record: id of the document, part of it, tokens in use, then the tokens, zeros after the last.
HEAD = np.dtype([("doc_id", "<i8"), ("part", "<i4"), ("length", "<i4")])


def record_type(stride: int) -> np.dtype:
    return np.dtype([*HEAD.descr, ("tokens", "<u2", (stride,))])


class Feistel:
    """A keyed bijection of 0..n-1: a balanced Feistel network over the least even-width power of two that holds n, walked until it is below n."""

    def __init__(self, n: int, key: int, rounds: int = 6):
        self.n = n
        self.half = max(1, -(-max(1, n - 1).bit_length() // 2))
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(xxhash.xxh64_intdigest(f"{key}:{r}", 0)) for r in range(rounds)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        shift = np.uint64(self.half)
        left, right = x >> shift, x & self.mask
        for k in reversed(self.keys) if back else self.keys:
            left, right = (right ^ self._mix(left, k), left) if back else (right, left ^ self._mix(right, k))
        return (left << shift) | right

    def _walk(self, x, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x, np.uint64), back)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)

    def slot(self, index) -> np.ndarray:
        return self._walk(index, False)

    def index(self, slot) -> np.ndarray:
        return self._walk(slot, True)


def tokenizer(ranks_file: str = RANKS_FILE):
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("lumenfold", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Runs of white space (as Unicode has it) that are too long for the library's pattern search.
_LONG_GAP = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")


def ordinary(encoding, text: str) -> list[int]:
    """encoding's ids of the whole text. A long run of white space, but for the one before a word, is one piece by the pattern; such pieces are encoded by themselves."""
    ids, done = [], 0
    if len(text) >= 10_000:
        for gap in _LONG_GAP.finditer(text):
            end = gap.end() if gap.end() == len(text) else gap.end() - 1
            ids += encoding.encode_ordinary(text[done : gap.start()])
            ids += encoding._encode_single_piece(text[gap.start() : end])
            done = end
    return ids + encoding.encode_ordinary(text[done:]) if done else encoding.encode_ordinary(text)


def token_ids(encoding, text: str, piece: int = 1 << 20) -> np.ndarray:
    """Token ids of a whole text and END_ID. A very long text is encoded in pieces that end before a space after a letter or digit, where the pattern always starts anew."""
    if len(text) <= piece:
        return np.array([*ordinary(encoding, text), END_ID], np.uint16)
    out, at = [], 0
    while at < len(text):
        end = at + piece
        while end < len(text) and not (text[end] == " " and text[end - 1].isalnum()):
            end += 1
        out.append(np.array(ordinary(encoding, text[at:end]), np.uint16))
        at = end
    return np.concatenate([*out, np.array([END_ID], np.uint16)])


def _open(path: str, mode: str):
    """A binary stream on a local path, a file: URI, or any store that pyarrow reaches."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        os.makedirs(os.path.dirname(url.path), exist_ok=True)
        return open(url.path, mode)
    import pyarrow.fs as fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_output_stream(name) if mode == "wb" else store.open_input_file(name)


def _rename(old: str, new: str) -> None:
    url = urlparse(new)
    if url.scheme in ("", "file"):
        os.replace(urlparse(old).path, url.path)
    else:
        import pyarrow.fs as fs

        store, name = fs.FileSystem.from_uri(new)
        store.move(fs.FileSystem.from_uri(old)[1], name)


#: Numbers of a document's parts and of documents; beyond them numbers are shared and the record decides.
PARTS, IDS = 1 << 20, 1 << 42


def numbered(rows: DataFrame, block: int = 1 << 12) -> tuple[DataFrame, int]:
    """(rows (doc_id, text) with a number, how many numbers there are); a number follows from id and text, however the rows are split.

    A row whose id is its own is numbered by it. Rows without an id (-1) or that share one get a digest of id, text and copy
    as number: rows that are equal throughout are counted with partial sums, as many copies are made of one of them, and
    these are numbered from 0, over all tasks by blocks of numbers. So none of them share a place, and no id is hot. Where
    all ids differ this costs one shuffle of ids.
    """
    total, low, high = rows.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    low, high = (0, 0) if low is None else (low, high)
    by_id = F.pmod(F.col("doc_id") - F.lit(low), F.lit(IDS)).alias("number")
    again = durable(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id = -1"))
    few = again.count()
    if not few:
        return rows.select("doc_id", "text", by_id), min(high - low + 1, IDS)
    hot = again if few <= 500_000 else again.where(F.col("n") * 1000 >= total)  # at most a thousand ids have a thousandth of the rows each
    met = rows.join(F.broadcast(hot), "doc_id", "left")
    once, shared = met.where("n is null").select("doc_id", "text"), met.where("n is not null").select("doc_id", "text")
    if few > 500_000:
        cold = once.join(again.where(F.col("n") * 1000 < total), "doc_id", "left")
        once, shared = cold.where("n is null").select("doc_id", "text"), shared.unionByName(cold.where("n is not null").select("doc_id", "text"))
    equal = shared.groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    blocks = equal.select("doc_id", "text", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))).alias("at")).repartition("doc_id", "text", "at")
    copies = blocks.select("doc_id", "text", F.explode(F.sequence(F.col("at") * block, F.least(F.col("n"), (F.col("at") + 1) * block) - 1)).alias("_copy"))
    return once.select("doc_id", "text", by_id).unionByName(copies.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text", "_copy"), F.lit(IDS)).alias("number"))), IDS


def write_shards(docs: DataFrame, folder: str, stride: int = 256, shards: int | None = None, key: int = 20240, ranks_file: str = RANKS_FILE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Writes the shards to folder, which every executor must reach; returns the manifest (shard, path, first_slot, records, digest).

    Each document gives its tokens and END_ID in records of `stride` tokens; null and empty texts
    give one record with END_ID alone, and rows without an id carry id -1. Rows without an id, rows that
    share one and rows that are equal have places of their own (see numbered). An empty table gives an empty manifest.
    shards: how many (None: one for each input partition). A text is tokenized once, and its
    records cross one shuffle. A shard is written under a temporary name and renamed, so a
    repeated task leaves one whole file.
    """
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    shards = shards or max(1, rows.rdd.getNumPartitions())
    rows, ids = numbered(rows)
    domain = ids * PARTS
    width = -(-domain // shards)
    kind = record_type(stride)

    def sequences(batches):
        encoding, order = tokenizer(ranks_file), Feistel(domain, key)
        for big in batches:
            for batch in rows_of(big, 256):
                records, numbers = [], []
                for doc, t, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    ids = token_ids(encoding, t)
                    n = -(-len(ids) // stride)
                    own = np.zeros(n, kind)
                    own["doc_id"], own["part"], own["length"] = doc, np.arange(n), np.minimum(stride, len(ids) - stride * np.arange(n))
                    flat = np.zeros(n * stride, np.uint16)
                    flat[: len(ids)] = ids
                    own["tokens"] = flat.reshape(n, stride)
                    records.append(own)
                    numbers.append(number * PARTS + np.arange(n) % PARTS)
                if not records:
                    continue
                records = np.concatenate(records)
                places = order.slot(np.concatenate(numbers))
                data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(kind.itemsize), len(records), [None, pa.py_buffer(records.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(places // width, pa.int32()), pa.array(places), data.cast(pa.binary())], names=["shard", "place", "record"])

    def write(batches):
        shard, stream, n, digest, temporary = None, None, 0, None, ""

        def close():
            stream.close()
            path = f"{folder}/shard-{shard:07d}.bin"
            _rename(temporary, path)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), pa.array([n]), pa.array([digest.hexdigest()])], names=["shard", "path", "records", "digest"])

        for batch in batches:
            for own, record in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own != shard:
                    if stream:
                        yield close()
                    shard, n, digest = own, 0, xxhash.xxh64()
                    temporary = f"{folder}/.shard-{shard:07d}-{uuid.uuid4().hex}"
                    stream = _open(temporary, "wb")
                stream.write(record)
                digest.update(record)
                n += 1
        if stream:
            yield close()

    dealt = rows.mapInArrow(sequences, "shard int, place long, record binary").repartitionById(shards, "shard").sortWithinPartitions("shard", "place", "record")
    written = durable(dealt.mapInArrow(write, "shard int, path string, records long, digest string"))
    before = F.sum("records").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # one row of numbers for each shard
    return durable(written.select("shard", "path", F.coalesce(before, F.lit(0)).alias("first_slot"), "records", "digest"))


def read_shards(manifest: DataFrame, stride: int = 256, from_slot: int = 0, to_slot: int | None = None, chunk: int = 4096) -> DataFrame:
    """(slot, doc_id, part, n_tokens, tokens) of the slots in [from_slot, to_slot), read by arithmetic from the shard files, each in a task of its own."""
    kind = record_type(stride)
    high = (1 << 62) if to_slot is None else to_slot

    def run(batches):
        for batch in batches:
            for path, first, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at, end = max(0, from_slot - first), min(records, high - first)
                if at >= end:
                    continue
                with _open(path, "rb") as f:
                    f.seek(at * kind.itemsize)
                    while at < end:
                        n = min(chunk, end - at)
                        r = np.frombuffer(f.read(n * kind.itemsize), kind)
                        cuts = np.concatenate([[0], np.cumsum(r["length"])]).astype(np.int32)
                        used = np.arange(stride)[None, :] < r["length"][:, None]
                        tokens = pa.ListArray.from_arrays(pa.array(cuts), pa.array(r["tokens"][used].astype(np.int32)))
                        yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(at, at + n)), pa.array(r["doc_id"]), pa.array(r["part"]), pa.array(r["length"]), tokens], names=["slot", "doc_id", "part", "n_tokens", "tokens"])
                        at += n

    few = manifest.select("path", "first_slot", "records")
    shards = few.count()
    if shards > 1:  # a partition for each shard, by its place in the order of the slots
        at = F.row_number().over(Window.orderBy("first_slot", "path"))
        few = few.withColumn("_at", at - 1).repartitionById(shards, "_at").drop("_at")
    return few.mapInArrow(run, "slot long, doc_id long, part int, n_tokens int, tokens array<int>")


def shared_folder(spark, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    durable(spark.range(0))  # sees to it that there is one
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def op3_token_output(spark, sf_dir):
    manifest = write_shards(read(spark, sf_dir, "documents"), shared_folder(spark, "shards"))
    return read_shards(manifest).select("slot", "doc_id", "part", "n_tokens", F.xxhash64("tokens").alias("tokens_hash"))
