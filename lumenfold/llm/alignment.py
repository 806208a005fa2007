"""Cross-tokenizer alignment: which tokens of one tokenizer overlap which of another, and how often.

Both tokenizations of a text end at known bytes. The union of the two arrays of ends cuts the text
into elementary intervals; searchsorted gives the token of either side that owns an interval, so each
interval is one overlapping pair, a link. An end that both sides share closes a group.

Texts are tokenized once: the ids are written as a table in the shared checkpoint folder, from which
one pass counts links by id pair over the corpus and a second looks the counts up. The most frequent
pairs, up to a stated number, go to the rows as a broadcast; links of rarer pairs go to their counts in a
shuffle, where no pair is hot, since each has fewer links than the least broadcast one.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import drop_clashing, durable, read, text_slices
from lumenfold.llm.token_output import ordinary
from lumenfold.session import scratch

#: Where the public vocabularies are, unless a caller says otherwise.
A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


@dataclass
class Pair:
    """Two tokenizers, as data that travels: ranks and pattern of a byte-level BPE, a piece model's file, and every id's bytes."""

    ranks: dict[bytes, int]
    pattern: str
    model: bytes
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    kind: str = "<u2"
    _open: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_open": None}

    def encoders(self):
        if self._open is None:
            import sentencepiece
            import tiktoken

            self._open = (tiktoken.Encoding("pair", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={}), sentencepiece.SentencePieceProcessor(model_proto=self.model))
        return self._open

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """(ids of space + text, ids of text) of each text; none for a text that is empty or that either side's bytes don't give again. A side whose entries hold every byte always does: it merges the text's own bytes."""
        a, b = self.encoders()
        out = []
        for text, pieces in zip(texts, b.encode(texts, num_threads=1), strict=True):
            if text and b"".join(map(self.b_bytes.__getitem__, pieces)) == b" " + text.encode():
                out.append((ordinary(a, " " + text), pieces))
            else:
                out.append(([], []))
        return out

    def packed(self, ids: list[int]) -> bytes:
        return array("H" if self.kind == "<u2" else "I", ids).tobytes()


def load(a_file: str = A_FILE, b_file: str = B_FILE) -> Pair:
    """A byte-level BPE from its JSON file, whose ids rise with its merges (so a merge's rank is the id that it makes), and a piece model."""
    import sentencepiece

    from lumenfold.llm.token_output import PATTERN

    with open(a_file, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model["added_tokens"]}
    # Byte-level entries spell a byte by its own character where that is printable, else by the next one from U+0100.
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    spelled = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocab = {k: v for k, v in model["model"]["vocab"].items() if k not in special}
    if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])):
        raise ValueError("ids don't rise with merges")
    ranks = {bytes(spelled[c] for c in k): v for k, v in vocab.items()}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("not every byte has an entry")
    a_bytes = [b""] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        a_bytes[v] = k
    with open(b_file, "rb") as f:
        proto = f.read()
    pieces = sentencepiece.SentencePieceProcessor(model_proto=proto)
    names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
    b_bytes = [bytes([int(n[1:-1], 16)]) if pieces.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    return Pair(ranks, PATTERN, proto, a_bytes, b_bytes, "<u2" if max(len(a_bytes), len(b_bytes)) <= 1 << 16 else "<u4")


def tokens(docs: DataFrame, pair: Pair, text: str = "text", row: str = "_row") -> DataFrame:
    """docs without the text, with a_ids and b_ids (packed little-endian ids of pair.kind), as a written table that numbers its rows in `row`."""
    docs = drop_clashing(docs, [n for n in ("a_ids", "b_ids", row) if n != text])
    docs = docs.select(F.col(f"`{text}`").cast("string").alias("_text"), *[F.col(f"`{c}`") for c in docs.columns if c != text])

    def run(batches):
        for big in batches:
            for batch in text_slices(big, 0):
                found = pair.encode([t or "" for t in batch.column(0).to_pylist()])
                packed = [pa.array([pair.packed(f[side]) for f in found], pa.binary()) for side in (0, 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *packed], names=[*batch.schema.names[1:], "a_ids", "b_ids"])

    schema = T.StructType([*docs.schema.fields[1:], T.StructField("a_ids", T.BinaryType()), T.StructField("b_ids", T.BinaryType())])
    path = scratch(docs.sparkSession, "tokens")
    docs.mapInArrow(run, schema).withColumn(row, F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


@dataclass
class Overlaps:
    """The links of a run of documents, one behind the other. last_a, last_b: the last token of each group. *_at: where each document's tokens, links and groups begin, and where the last one's end."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    owner_a: np.ndarray
    owner_b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    links_at: np.ndarray
    groups_at: np.ndarray

    def pairs(self) -> np.ndarray:
        """Each link's id pair as one number."""
        return self.a[self.owner_a] << 32 | self.b[self.owner_b]

    def groups_of(self) -> tuple[np.ndarray, np.ndarray]:
        """Each token's group, on either side: how many groups' last tokens come before it."""
        out = []
        for ids, last in ((self.a, self.last_a), (self.b, self.last_b)):
            ends = np.zeros(len(ids), np.int64)
            ends[last] = 1
            out.append(np.cumsum(ends) - ends)
        return out[0], out[1]


def union_of_sorted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """np.union1d of two sorted arrays; a stable sort merges the two runs in linear time, where union1d would sort anew."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both


def overlaps(a: np.ndarray, b: np.ndarray, a_counts: np.ndarray, b_counts: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> Overlaps:
    """a, b: ids of consecutive documents, whose counts of tokens are given; sizes: bytes by id. Both sides of a document have equally many bytes."""
    a_ends, b_ends = np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])
    cuts = union_of_sorted(a_ends, b_ends)
    owner_a, owner_b = np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts)
    closes = np.flatnonzero((a_ends[owner_a] == cuts) & (b_ends[owner_b] == cuts))
    a_at, b_at = np.concatenate([[0], np.cumsum(a_counts)]), np.concatenate([[0], np.cumsum(b_counts)])
    edges = np.concatenate([[0], a_ends])[a_at]
    return Overlaps(a, b, a_ends, b_ends, owner_a, owner_b, owner_a[closes], owner_b[closes], a_at, b_at, np.searchsorted(cuts, edges, "right"), np.searchsorted(cuts[closes], edges, "right"))


def group_table(pair: Pair) -> list[str]:
    """Ids as they stand in a group's text: of A inside and at the end of a group, then of B likewise."""
    return [f"{i}{mark}" for n, marks in ((len(pair.a_bytes), ",|"), (len(pair.b_bytes), ",;")) for mark in marks for i in range(n)]


def group_texts(o: Overlaps, pair: Pair, table: list[str]) -> list[str]:
    """Each document's groups as `a1,a2|b1;a3|b2,b3`."""
    n_a, n_b = len(pair.a_bytes), len(pair.b_bytes)
    ga, gb = o.groups_of()
    codes = np.empty(len(o.a) + len(o.b), np.int64)
    before = np.concatenate([[-1], o.last_b]) + 1  # tokens of B in earlier groups
    a, b = o.a.copy(), o.b + 2 * n_a
    a[o.last_a] += n_a
    b[o.last_b] += n_b
    codes[np.arange(len(a)) + before[ga]] = a
    codes[np.arange(len(b)) + o.last_a[gb] + 1] = b
    at = (o.a_at + o.b_at).tolist()
    return ["".join(map(table.__getitem__, codes[i:j].tolist()))[:-1] for i, j in zip(at, at[1:], strict=False)]


def _unpacked(batch: pa.RecordBatch, pair: Pair, sizes: tuple[np.ndarray, np.ndarray]) -> Overlaps:
    sides = []
    for name in ("a_ids", "b_ids"):
        column = batch.column(name)
        sides.append((np.frombuffer(b"".join(column.to_pylist()), pair.kind).astype(np.int64), np.asarray(pc.binary_length(column)) // np.dtype(pair.kind).itemsize))
    return overlaps(sides[0][0], sides[1][0], sides[0][1], sides[1][1], *sizes)


def _sizes(pair: Pair) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([len(x) for x in t], np.int64) for t in (pair.a_bytes, pair.b_bytes))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, at, np.concatenate([n for _, n in parts]))
    return keys, n


def pair_counts(table: DataFrame, pair: Pair, most_held: int = 1 << 20) -> DataFrame:
    """(pair, n, best) of every linked id pair of the corpus: its links, and whether no pair with its B id has more. Tasks add up before they shuffle."""

    def run(batches):
        sizes, held = _sizes(pair), []

        def told(keys, n):
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])

        for big in batches:
            for batch in text_slices(big, 0):
                held.append(np.unique(_unpacked(batch, pair, sizes).pairs(), return_counts=True))
                if sum(len(k) for k, _ in held) > most_held:
                    held = [_summed(held)]
                    if len(held[0][0]) * 2 > most_held:
                        yield told(*held.pop())
        if held:
            yield told(*_summed(held))

    counts = durable(table.select("a_ids", "b_ids").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = counts.groupBy(b.alias("b")).agg(F.max("n").alias("highest"))  # at most a row for each id of B's vocabulary
    return counts.withColumn("b", b).join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def frequent(counts: DataFrame, most_pairs: int) -> tuple[int, bool]:
    """(the least power of two that at most most_pairs pairs have as many links as, whether other pairs are left)."""
    bits = {r["k"]: r["c"] for r in counts.groupBy(F.length(F.bin("n")).alias("k")).agg(F.count("*").alias("c")).collect()}  # a row for each length in bits
    total, least = 0, 64
    for k in range(63, 0, -1):
        total += bits.get(k, 0)
        if total > most_pairs:
            break
        least = k
    return min(1 << (least - 1), (1 << 63) - 1), total > most_pairs


def align(docs: DataFrame, pair: Pair | None = None, text: str = "text", most_pairs: int = 1 << 20) -> DataFrame:
    """docs without the text, with the counts (COUNTS, each long) and `groups`, the text of the groups.

    n_best: links whose id pair has its B id's highest count in the corpus, ties included; count_sum: the
    sum of the counts of the links' pairs. most_pairs: how many pairs' counts may be broadcast (17 bytes each).
    A text that is null or empty, or that either tokenizer doesn't give back byte by byte, has no tokens:
    zeros and an empty text. Repeated rows count as often as they stand there. Very long texts are one row of
    one task, like any value. Empty table: no rows. Input columns with an output's name are replaced.
    """
    pair = pair or load()
    docs = drop_clashing(docs, [n for n in (*COUNTS, "groups") if n != text])
    spark = docs.sparkSession
    table = tokens(docs, pair, text)
    counts = durable(pair_counts(table, pair))
    least, others = frequent(counts, most_pairs)
    known = counts.where(F.col("n") >= least).toArrow()  # at most most_pairs rows
    order = np.argsort(keys := np.asarray(known["pair"]))
    told = spark.sparkContext.broadcast((keys[order], np.asarray(known["n"])[order], np.asarray(known["best"])[order]))

    def look_up(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, best, whether known) of each pair."""
        keys, n, best = told.value
        if not len(keys):
            return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool), np.zeros(len(pairs), bool)
        at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
        hit = keys[at] == pairs
        return np.where(hit, n[at], 0), best[at] & hit, hit

    def run(batches):
        sizes, names = _sizes(pair), group_table(pair)
        for big in batches:
            for batch in text_slices(big, big.schema.get_field_index("a_ids")):
                o = _unpacked(batch, pair, sizes)
                n, best, _ = look_up(o.pairs())
                best_to, sum_to = (np.concatenate([[0], np.cumsum(x)]) for x in (best.astype(np.int64), n))
                columns = [np.diff(o.a_at), np.diff(o.b_at), np.diff(o.groups_at), np.diff(o.links_at), np.diff(best_to[o.links_at]), np.diff(sum_to[o.links_at])]
                kept = [(name, c) for name, c in zip(batch.schema.names, batch.columns, strict=True) if name not in ("a_ids", "b_ids")]
                yield pa.RecordBatch.from_arrays([*[c for _, c in kept], *[pa.array(c, pa.int64()) for c in columns], pa.array(group_texts(o, pair, names), pa.string())], names=[*[k for k, _ in kept], *COUNTS, "groups"])

    schema = T.StructType([*[f for f in table.schema.fields if f.name not in ("a_ids", "b_ids")], *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("groups", T.StringType())])
    out = table.mapInArrow(run, schema)
    if not others:
        return out.drop("_row")

    def rare(batches):
        sizes = _sizes(pair)
        for big in batches:
            for batch in text_slices(big, 1):
                o = _unpacked(batch, pair, sizes)
                pairs = o.pairs()
                far = ~look_up(pairs)[2]
                rows = np.repeat(np.asarray(batch.column(0)), np.diff(o.links_at))[far]
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(pairs[far])], names=["_row", "pair"])

    met = table.select("_row", "a_ids", "b_ids").mapInArrow(rare, "_row long, pair long").join(counts.where(F.col("n") < least), "pair")
    more = met.groupBy("_row").agg(F.sum(F.col("best").cast("long")).alias("_best"), F.sum("n").alias("_sum"))
    added = {"n_best": F.coalesce("_best", F.lit(0)), "count_sum": F.coalesce("_sum", F.lit(0))}
    return out.join(more, "_row", "left").withColumns({k: F.col(k) + v for k, v in added.items()}).drop("_row", "_best", "_sum")


def links(table: DataFrame, pair: Pair, products: bool = False, most_rows: int = 1 << 18) -> DataFrame:
    """(_row, a_index, b_index, a_id, b_id) of every link of a tokens() table; products: of every pair of tokens that share a group instead."""

    def spread(o: Overlaps) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not products:
            for i in range(0, len(o.owner_a), most_rows):
                yield o.owner_a[i : i + most_rows], o.owner_b[i : i + most_rows]
            return
        ga, gb = o.groups_of()
        first, size = np.searchsorted(gb, np.arange(len(o.last_b))), np.bincount(gb, minlength=len(o.last_b))
        done = 0
        total = np.cumsum(size[ga])
        while done < len(ga):  # a token of A at least, however large its group
            to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + most_rows, "right")))
            own = np.arange(done, to)
            n = size[ga[own]]
            yield np.repeat(own, n), np.repeat(first[ga[own]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            done = to

    def run(batches):
        sizes = _sizes(pair)
        for big in batches:
            for batch in text_slices(big, 1):
                o = _unpacked(batch, pair, sizes)
                for a, b in spread(o):
                    doc = np.searchsorted(o.a_at, a, "right") - 1
                    columns = [np.asarray(batch.column(0))[doc], a - o.a_at[doc], b - o.b_at[doc], o.a[a], o.b[b]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["_row", "a_index", "b_index", "a_id", "b_id"])

    return table.select("_row", "a_ids", "b_ids").mapInArrow(run, "_row long, a_index long, b_index long, a_id long, b_id long")


def op11_alignment(spark, sf_dir):
    out = align(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *COUNTS, F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))
