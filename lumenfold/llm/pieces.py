"""SentencePiece encoding and decoding with N-best segmentation.

A text's lattice has an edge for every vocabulary piece that stands at a position. Forward Viterbi
scores are the exact cost of the rest of a backward path, so a best-first (A*) search from the end
meets complete segmentations in order of score. The score of a piece is the logarithm of its share by
the Zipf-Mandelbrot law on its merge rank (see load), so a segmentation's score is a log
probability and few frequent pieces win; it is not the library's greedy merging, and ids differ
from the library's where merging takes another way. No piece spans certain borders (see
chunk_pattern), so the lattice falls into independent chunks: chunks are solved once and kept, and the
document's N best are the exact combinations of its chunks' alternatives.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import drop_clashing, read, rows_of, with_columns

#: Where the public vocabulary file is, unless a caller says otherwise.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
LOW = float("-inf")
#: Scores are multiples of this, so that sums of them are exact in any order.
GRAIN = 1.0 / (1 << 20)


@dataclass
class Vocabulary:
    """edges: piece, or beginning of one, -> (id or -1, score); spaces stand for the model's space mark.

    A character without a piece costs `unknown` and is spelled in byte pieces.
    """

    edges: dict[str, tuple[int, float]]
    longest: int
    unknown: float
    byte_ids: list[int]
    spelled: list[bytes]
    chunk: str
    cache: dict = field(default_factory=dict, repr=False)
    _trie: dict | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "cache": {}, "_trie": None}

    def trie(self) -> dict:
        """The edges by character: {char: (children, id or -1, score, whether a piece ends here)}."""
        if self._trie is None:
            root: dict = {}
            for text in sorted(self.edges, key=len):  # beginnings come before what they begin
                at = root
                for c in text[:-1]:
                    at = at[c][0]
                k, w = self.edges[text]
                at[text[-1]] = ({}, k, w, k >= 0)
            self._trie = root
        return self._trie


def load(model_file: str = MODEL_FILE, offset: float = 2.7) -> Vocabulary:
    """The vocabulary of a model with byte fallback, whose pieces have the space mark at their beginning or throughout.

    Such a model scores a piece by minus its merge rank, which orders merges but says nothing of a
    sum. Merges come by falling frequency, so a piece of rank r takes the share 1 / (r + offset) of all
    (normalised; Zipf-Mandelbrot), and its score is the logarithm of that. Nothing is trained.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    edges: dict[str, tuple[int, float]] = {}
    spelled, byte_ids, ranks = [], [0] * 256, {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[1:-1], 16)
            byte_ids[value] = i
            spelled.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i):
            spelled.append(b"")
        else:
            own = piece.replace("▁", " ")
            if " " in own.lstrip(" "):
                raise ValueError(f"the piece {piece!r} spans words")
            spelled.append(own.encode())
            for k in range(1, len(own)):
                edges.setdefault(own[:k], (-1, 0.0))
            edges[own] = (i, 0.0)
            ranks[own] = 1.0 - float(model.get_score(i))
    whole = math.log(sum(1.0 / (r + offset) for r in ranks.values()))
    for own, r in ranks.items():
        edges[own] = (edges[own][0], GRAIN * round((-math.log(r + offset) - whole) / GRAIN))
    unknown = min(w for k, w in edges.values() if k >= 0) - 10.0
    return Vocabulary(edges, max(map(len, edges)), unknown, byte_ids, spelled, chunk_pattern([e for e, (k, _) in edges.items() if k >= 0]))


def chunk_pattern(pieces: list[str]) -> str:
    """A pattern that cuts a text only where no piece has two neighbouring characters.

    Cuts come before spaces, around newlines if no piece has one, and between two classes of
    characters: letters and digits, and the rest. Where a piece joins the classes, the rarer of
    its two characters changes class, until none does.
    """
    line = "" if any("\n" in p for p in pieces) else r"\n"
    seen = Counter(c for p in pieces for c in set(p))
    pairs = {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False) if " " not in (a, b)}
    moved: set[str] = set()
    while mixed := [p for p in sorted(pairs) if len({c.isalnum() != (c in moved) for c in p}) == 2]:
        free = [c for p in mixed for c in p if c not in moved]
        if not free:
            return (rf"{line}|" if line else "") + rf" *[^ {line}]+| +"
        moved.add(min(free, key=lambda c: (seen[c], c)))
    out, into = ("".join(sorted(c for c in moved if c.isalnum() == k)) for k in (True, False))
    word = r"[^\W_" + re.escape(out) + "]" + (rf"|[{re.escape(into)}]" if into else "")
    return (rf"{line}|" if line else "") + rf" *(?:{word})+| *(?:(?!{word})[^ {line}])+| +"


def _single(vocab: Vocabulary, char: str) -> bool:
    return vocab.edges.get(char, (-1, 0.0))[0] >= 0


def forward(vocab: Vocabulary, text: str) -> tuple[list[float], list[float], list[int], list[int]]:
    """Viterbi over the lattice: best and second-best score of every prefix, and the last piece of the best path: its start and id (-1: spelled in bytes)."""
    n, root, unknown = len(text), vocab.trie(), vocab.unknown
    best, second, start, last = [LOW] * (n + 1), [LOW] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    for i, char in enumerate(text):
        b, s = best[i], second[i]
        node = root.get(char)
        if node is None or node[1] < 0:
            node = (node[0] if node else {}, -1, unknown, True)
        j = i
        while True:
            j += 1
            kids, k, w, ends = node
            if ends:
                x = b + w
                y = best[j]
                if x > y:
                    best[j], start[j], last[j] = x, i, k
                    x = s + w
                    if x < y:
                        x = y
                if x > second[j]:
                    second[j] = x
            if j == n:
                break
            node = kids.get(text[j])
            if node is None:
                break
    return best, second, start, last


def _ids(vocab: Vocabulary, text: str, a: int, b: int, piece: int) -> list[int]:
    return [piece] if piece >= 0 else [vocab.byte_ids[c] for c in text[a:b].encode("utf-8", "surrogatepass")]


def best_path(vocab: Vocabulary, text: str, start: list[int], last: list[int]) -> list[int]:
    parts, j = [], len(text)
    while j:
        parts.append(_ids(vocab, text, start[j], j, last[j]))
        j = start[j]
    return [k for p in reversed(parts) for k in p]


def nbest_chunk(vocab: Vocabulary, text: str, n: int) -> list[tuple[float, list[int]]]:
    """The n best (score, ids) of one lattice, best first, by backward A* over the forward scores.

    Of equal scores the path that is further along comes first, then the one met first. A position
    is left n times at most: a later path through it has n before it that end no worse.
    """
    best = forward(vocab, text)[0]
    out: list[tuple[float, list[int]]] = []
    left, met = [0] * (len(text) + 1), 0
    heap = [(-best[-1], len(text), 0, 0.0, None)]  # the path is a chain from its first piece to its last
    while heap and len(out) < n:
        _, at, _, done, path = heappop(heap)
        if not at:
            pieces: list[int] = []
            while path:
                length, k, path = path
                pieces.extend(_ids(vocab, text, at, at + length, k))
                at += length
            out.append((done, pieces))
            continue
        if left[at] == n:
            continue
        left[at] += 1
        for i in range(max(0, at - vocab.longest), at):
            k, w = vocab.edges.get(text[i:at], (-1, 0.0))
            if k < 0:
                if at - i > 1 or _single(vocab, text[i]):
                    continue
                w = vocab.unknown
            if best[i] > LOW:
                met += 1
                heappush(heap, (-(done + w + best[i]), i, met, done + w, (at - i, k, path)))
    return out


class Encoder:
    """Encodes whole texts; chunks' best paths are kept, up to most_chunks of them."""

    def __init__(self, vocab: Vocabulary, n_best: int = 4, most_chunks: int = 600_000):
        self.vocab, self.n_best, self.most_chunks = vocab, n_best, most_chunks
        self.cache, self.paths, self.find = vocab.cache, {}, re.compile(vocab.chunk).findall

    def nbest(self, chunk: str) -> list[tuple[float, list[int]]]:
        found = self.paths.get(chunk)
        if found is None:
            if len(self.paths) >= self.most_chunks // 8:
                self.paths.clear()
            found = self.paths[chunk] = nbest_chunk(self.vocab, chunk, self.n_best)
        return found

    def _solve(self, chunk: str) -> tuple[list[int], float, float]:
        best, second, start, last = forward(self.vocab, chunk)
        found = (best_path(self.vocab, chunk, start, last), best[-1], best[-1] - second[-1])
        if len(chunk) <= 64:
            if len(self.cache) >= self.most_chunks:
                self.cache.clear()
            self.cache[chunk] = found
        return found

    def _solved(self, text: str):
        """(chunks, ids of the best path, its score, the n_best - 1 chunks whose second path loses least)."""
        chunks = self.find(" " + text) if text else []
        get, ids, score, few, bar = self.cache.get, [], 0.0, [], float("inf")
        keep = self.n_best - 1
        for at, c in enumerate(chunks):
            own, s, loss = get(c) or self._solve(c)
            ids += own
            score += s
            if loss < bar and keep:
                few.append((loss, at))
                if len(few) > keep:
                    few.sort()
                    few.pop()
                if len(few) == keep:
                    bar = max(few)[0]
        return chunks, ids, score, sorted(few)

    def alternatives(self, chunks: list[str], few: list[tuple[float, int]]) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
        """The n_best least losses over all combinations, each with its (chunk, rank of its path) changes.

        Each of the n_best best segmentations changes only chunks among the n_best - 1 least single changes.
        """
        single = []
        for _, at in few:
            paths = self.nbest(chunks[at])
            single += [(paths[0][0] - s, at, r) for r, (s, _) in enumerate(paths) if r]
        found: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        for loss, at, rank in sorted(single)[: self.n_best - 1]:
            found += [(total + loss, (*changes, (at, rank))) for total, changes in found if all(a != at for a, _ in changes)]
        return sorted(found)[: self.n_best]

    def encode(self, text: str) -> tuple[list[int], float, list[float]]:
        """(ids of the best segmentation, its score, scores of the n_best best)."""
        chunks, ids, score, few = self._solved(text)
        return ids, score, [score - loss for loss, _ in self.alternatives(chunks, few)]

    def n_best_ids(self, text: str) -> list[tuple[float, list[int]]]:
        """The n_best best segmentations in full."""
        chunks, _, score, few = self._solved(text)
        out = []
        for loss, changes in self.alternatives(chunks, few):
            ranks = dict(changes)
            ids = [k for at, c in enumerate(chunks) for k in self.nbest(c)[ranks.get(at, 0)][1]]
            out.append((score - loss, ids))
        return out


def decode(vocab: Vocabulary, ids: list[int]) -> str:
    """The text of any segmentation; the inverse of encode."""
    return b"".join(map(vocab.spelled.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def encode_documents(docs: DataFrame, vocab: Vocabulary | None = None, n_best: int = 4, text: str = "text", most_chunks: int = 600_000) -> DataFrame:
    """docs with ids, score, nbest_scores and round_trip (whether decoding gives the text again) appended.

    Whole texts; null and empty texts have no pieces, score 0 and one segmentation, the empty one.
    Columns that carry one of these names are replaced, others pass through. Repeated rows are
    encoded alike; very long texts are encoded whole, chunk by chunk. An empty table gives no rows.
    """
    vocab = vocab or load()
    names = ["ids", "score", "nbest_scores", "round_trip"]
    docs = drop_clashing(docs, [n for n in names if n != text])
    at = docs.columns.index(text)
    kinds = [pa.list_(pa.int32()), pa.float64(), pa.list_(pa.float64()), pa.bool_()]

    def run(batches):
        encoder = Encoder(vocab, n_best, most_chunks)
        for big in batches:
            for batch in rows_of(big, 128):
                texts = [t or "" for t in batch.column(at).to_pylist()]
                rows = [encoder.encode(t) for t in texts]
                cuts = pa.array(np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]), pa.int32())
                flat = pa.array(np.fromiter((k for r in rows for k in r[0]), np.int32), pa.int32())
                same = [decode(vocab, r[0]) == t for r, t in zip(rows, texts, strict=True)]
                columns = [pa.ListArray.from_arrays(cuts, flat), pa.array([r[1] for r in rows], kinds[1]), pa.array([r[2] for r in rows], kinds[2]), pa.array(same, kinds[3])]
                yield with_columns(batch, dict(zip(names, columns, strict=True)))

    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("score", T.DoubleType()), T.StructField("nbest_scores", T.ArrayType(T.DoubleType())), T.StructField("round_trip", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def op6_sentencepiece(spark, sf_dir):
    out = encode_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "score", "nbest_scores", "round_trip")


def encode_stage(spark, docs, sf_dir):
    """Pipeline stage: the piece ids of every document, and its two best scores, in place of the text. Executors have run other stages by now, so fewer chunks are kept.

    Null and empty texts have no ids; repeated rows and ids are encoded alike; other columns that carry an
    output's name are replaced; an empty table gives no rows.
    """
    out = encode_documents(docs, n_best=2, most_chunks=120_000)
    return out.select(*[F.col(f"`{c}`") for c in out.columns if c != "text"])
