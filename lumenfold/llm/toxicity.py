"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon behind the density features is induced from the labelled training sample: words and
word beginnings that mark toxic texts. Features of the sample are cross-fitted (each half is read
with the other half's lexicon), so the trees do not learn to trust words seen once.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import collected, drop_clashing, fold, labelled_rows, read, rows_of, with_columns
from lumenfold.llm.features import EDGES, PREFIXES, Lexicon, WordTable, abuse_features

#: Bound of the fitting sample, by label value.
SAMPLE = {0: 6000, 1: 3000}


class Trees:
    """Boosted regression trees on binned features, for the logistic loss."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 8.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.edges: list[np.ndarray] = []
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)])

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b, size = self._binned(x), self.bins + 1
        mean = np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(mean / (1 - mean)))
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = weight * (p - y), weight * p * (1 - p)
            inner, leaves = 2**self.depth - 1, 2**self.depth
            feature, cut, value, node = np.zeros(inner, np.int64), np.full(inner, size, np.int64), np.zeros(leaves), np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-9)
                for j in range(x.shape[1]):
                    key = (node - first) * size + b[:, j]
                    gs = np.bincount(key, g, width * size).reshape(width, size)
                    hs = np.bincount(key, h, width * size).reshape(width, size)
                    gl, hl = np.cumsum(gs, axis=1), np.cumsum(hs, axis=1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    n = np.cumsum(np.bincount(key, minlength=width * size).reshape(width, size), axis=1)
                    gain[(n < self.least) | (n[:, -1:] - n < self.least)] = 0
                    at = gain.argmax(axis=1)
                    better = gain[np.arange(width), at] > best
                    best = np.where(better, gain[np.arange(width), at], best)
                    feature[first : first + width][better], cut[first : first + width][better] = j, at[better]
                node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - inner
            value = -np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + self.ridge)
            self.nodes.append((feature, cut, self.rate * value))
            margin += self.rate * value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, rows = self._binned(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, cut, value in self.nodes:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += value[node - len(feature)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the nondecreasing least-squares fit of y on score (pool adjacent violators)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, lowest and highest score
    for s, v, w in zip(score[order], y[order], weight[order], strict=True):
        if blocks and blocks[-1][3] == s:
            last = blocks[-1]
            last[0] = (last[0] * last[1] + v * w) / (last[1] + w)
            last[1] += w
        else:
            blocks.append([v, w, s, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w2, _, high = blocks.pop()
            last = blocks[-1]
            last[0] = (last[0] * last[1] + m * w2) / (last[1] + w2)
            last[1] += w2
            last[3] = high
    xs = np.array([k for b in blocks for k in (b[2], b[3])])
    return xs, np.array([b[0] for b in blocks for _ in (0, 1)])


#: Fewest texts of label 1, and least log odds ratio, of what the lexicon takes in.
LEAST_DOCS, LEAST_ODDS = 3, 2.0


def _cores(text: str) -> tuple[set[str], set[str]]:
    """(distinct words, distinct word beginnings) of a text."""
    cores = {w.strip(EDGES) for w in text.lower().split()}
    cores.discard("")
    return cores, {c[:k] for c in cores if c.islower() for k in PREFIXES if len(c) >= k}


def _marking(counts, n1: int, n0: int) -> dict[str, float]:
    """{word: weight} of what is far likelier in texts of label 1 among counts, (word, texts of label 1, texts of label 0) each."""
    found = {}
    for w, a, b in counts:
        if a >= LEAST_DOCS:
            odds = math.log((a + 0.5) / (max(1, n1) + 1)) - math.log((b + 0.5) / (max(1, n0) + 1))
            if odds >= LEAST_ODDS and math.sqrt(a) * odds >= 5:
                found[w] = round(odds, 4)
    return dict(sorted(found.items(), key=lambda x: (-x[1], x[0])))


def induce(texts: list[str], y: np.ndarray) -> Lexicon:
    """Words and word beginnings far likelier in texts of label 1; weight: smoothed log odds ratio of their document rates."""
    counts = [[Counter(), Counter()] for _ in range(2)]  # words, beginnings
    for t, label in zip(texts, y, strict=True):
        for count, own in zip(counts, _cores(t), strict=True):
            count[int(label)].update(own)
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    return Lexicon(*(_marking(((w, a, c[0][w]) for w, a in c[1].items()), n1, n0) for c in counts))


def induced(rows: DataFrame, marked: int = 1) -> tuple[Lexicon, Lexicon, Lexicon]:
    """induce over the rows of odd places, over those of even places, and over all, of labelled_rows, label 1 being y = marked: the first two are for reading even and odd places. Texts are counted where they are; only words that may be taken in come here."""

    def count(batches):
        counts: dict[tuple, Counter] = {}
        for big in batches:
            for batch in rows_of(big, 256):
                for place, text, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for kind, own in enumerate(_cores(text)):
                        counts.setdefault((kind, place % 2, int(y == marked)), Counter()).update(own)
            for (kind, half, label), found in counts.items():
                same = [pa.array([v] * len(found), pa.int32()) for v in (kind, half, label)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["kind", "half", "label", "word", "n"])
            counts.clear()

    of = lambda half, label: F.sum(F.when((F.col("half") == half) & (F.col("label") == label), F.col("n")).otherwise(0)).alias(f"n{half}{label}")
    every = rows.select("place", "text", "y").mapInArrow(count, "kind int, half int, label int, word string, n long").groupBy("kind", "word").agg(*[of(h, l) for h in (0, 1) for l in (0, 1)])
    sizes = {(r["h"], r["l"]): r["n"] for r in rows.groupBy((F.col("place") % 2).alias("h"), (F.col("y") == marked).cast("int").alias("l")).agg(F.count("*").alias("n")).collect()}
    n = [[sizes.get((h, l), 0) for l in (0, 1)] for h in (0, 1)]
    n.append([n[0][l] + n[1][l] for l in (0, 1)])
    both = [(F.col("n00"), F.col("n01")), (F.col("n10"), F.col("n11")), (F.col("n00") + F.col("n10"), F.col("n01") + F.col("n11"))]
    odds = [F.log((a + 0.5) / (max(1, n1) + 1)) - F.log((b + 0.5) / (max(1, n0) + 1)) for (b, a), (n0, n1) in zip(both, n, strict=True)]
    may = [(a >= LEAST_DOCS) & (o >= LEAST_ODDS - 1e-6) for (_, a), o in zip(both, odds, strict=True)]
    found = every.where(may[0] | may[1] | may[2]).collect()

    def lexicon(halves: tuple[int, ...]) -> Lexicon:
        n1, n0 = (sum(n[h][l] for h in halves) for l in (1, 0))
        return Lexicon(*(_marking(((r["word"], *(sum(r[f"n{h}{l}"] for h in halves) for l in (1, 0))) for r in found if r["kind"] == kind), n1, n0) for kind in (0, 1)))

    return lexicon((1,)), lexicon((0,)), lexicon((0, 1))


def cross_read(lexicons: tuple[Lexicon, ...], features):
    """For common.collected: features(ids, starts, rows) of each text by the lexicon of the half it is not in."""

    def read_texts(places: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out: list = [None] * len(texts)
        for half in (0, 1):
            held = np.flatnonzero(places % 2 == half)
            if len(held):
                for i, x in zip(held, features(*WordTable(lexicons[half]).look_up([texts[i] for i in held])), strict=True):
                    out[i] = x
        return np.array(out), np.arange(len(texts) + 1)

    return read_texts


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, table: WordTable, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        ids, starts, rows = table.look_up(texts)
        margin = self.trees.margin(abuse_features(ids, starts, rows))
        return np.clip(np.interp(margin, *self.knots), 0.0, 1.0)


def fit(sample: list[tuple[str, int]], totals: dict[int, int]) -> ToxicityModel:
    """fit_features over texts that are held here."""
    texts, y = [t for t, _ in sample], np.array([v for _, v in sample], np.float64)
    half = np.arange(len(y)) % 2
    x = np.zeros((len(y), 16))
    for k in (0, 1):
        held = np.flatnonzero(half == k)
        table = WordTable(induce([texts[i] for i in np.flatnonzero(half != k)], y[half != k]))
        for at in range(0, len(held), 256):
            part = held[at : at + 256]
            x[part] = abuse_features(*table.look_up([texts[i] for i in part]))
    return fit_features(x, y, totals, induce(texts, y))


def fit_features(x: np.ndarray, y: np.ndarray, totals: dict[int, int], lexicon: Lexicon) -> ToxicityModel:
    """The model from cross-fitted features; totals restore the label shares of the whole training rows. Without both labels every score is the share of label 1."""
    y = y.astype(np.float64)
    if len(set(y)) < 2:
        share = float(y[0]) if len(y) else 0.0
        trees = Trees(rounds=0)
        trees.edges = [np.zeros(1)] * 16
        return ToxicityModel(Lexicon(), trees, (np.zeros(2), np.full(2, share)))
    count = {k: (y == k).sum() for k in (0, 1)}
    weight = np.where(y == 1, totals[1] / count[1], totals[0] / count[0])
    weight /= weight.mean()
    margin = np.zeros(len(y))
    for k in range(4):
        out = (np.arange(len(y)) // 2) % 4 == k
        margin[out] = Trees().fit(x[~out], y[~out], weight[~out]).margin(x[out])
    return ToxicityModel(lexicon, Trees().fit(x, y, weight), isotonic(margin, y, weight))


def score_documents(docs: DataFrame, model, text: str = "text", score: str = "score", keep_if=None) -> DataFrame:
    """docs with the score of every whole text appended; null and empty texts are scored as texts without words.

    keep_if(scores): rows to keep, for a filter that returns the input columns only. Columns that
    carry the name of the score are replaced; every other column passes through untouched. Repeated
    rows get the same score; an empty table gives no rows.
    """
    docs = docs if keep_if else drop_clashing(docs, [score])
    at = docs.columns.index(text)

    def run(batches):
        table = WordTable(getattr(model, "lexicon", None))
        for big in batches:
            for batch in rows_of(big, 256):
                found = model.score(table, [t or "" for t in batch.column(at).to_pylist()])
                if keep_if:
                    yield batch.filter(pa.array(keep_if(found)))
                else:
                    yield with_columns(batch, {score: pa.array(found, pa.float64())})

    schema = docs.schema if keep_if else T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def fit_tables(documents: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fits on a bounded sample (SAMPLE) of the rows whose fold of four is not 2. Texts are read where they are; words of the lexicon and features come here."""
    rows, totals = labelled_rows(documents, labels, "toxic", fold("doc_id", 4) != 2, SAMPLE)
    *halves, lexicon = induced(rows)
    x, _, y = collected(rows, cross_read(halves, abuse_features), 16)
    return fit_features(x, y, totals, lexicon)


def op9_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit_tables(docs, read(spark, sf_dir, "labels")))
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def reject_toxic(spark, docs, sf_dir, threshold: float = 0.3):
    """Pipeline stage: drops what the classifier marks toxic.

    Every row is judged by its own text: null and empty texts as texts without words, rows that share
    an id apart, repeated rows alike. Columns pass through whatever their names are; an empty table
    gives no rows.
    """
    model = fit_tables(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return score_documents(docs, model, keep_if=lambda s: s < threshold)
