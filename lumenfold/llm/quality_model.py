"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages. Every passage is encoded, a gated attention learned from
document labels weighs the encodings, and the weighted mean is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from lumenfold.llm.common import collected, fold, labelled_rows, read
from lumenfold.llm.features import WordTable, passage_starts, shape_features
from lumenfold.llm.toxicity import score_documents

#: Words of a passage, and the bound of the fitting sample by label value.
PASSAGE = 64
SAMPLE = {0: 2500, 1: 3500}
#: Numbers of a passage, and the most passages whose gradients are summed at once.
WIDTH, CHUNK = 16, 16_384


def _segments(values: np.ndarray, bags: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, bags[:-1], axis=0)


@dataclass
class AttentionModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        w, sizes = self.weights, np.diff(bags)
        h = np.tanh(x @ w["encode"] + w["encode_bias"])
        t, g = np.tanh(h @ w["value"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        s = (t * g) @ w["attend"]
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, bags[:-1]), sizes))
        a = e / np.repeat(_segments(e, bags), sizes)
        z = _segments(a[:, None] * h, bags)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "logit": z @ w["score"] + w["score_bias"]}

    def score(self, table: WordTable, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x, bags = bag_features(table, texts)
        return 1 / (1 + np.exp(-self.forward((x - self.mean) / self.spread, bags)["logit"]))


def bag_features(table: WordTable, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(a row for each passage of each text, first passage of each text and the end)."""
    ids, starts, rows = table.look_up(texts)
    passages, bags = passage_starts(starts, PASSAGE)
    return shape_features(ids, passages, rows), bags


def _gradients(model: AttentionModel, x: np.ndarray, bags: np.ndarray, y: np.ndarray, weight: np.ndarray, total: float | None = None) -> dict[str, np.ndarray]:
    w, f, sizes = model.weights, model.forward(x, bags), np.diff(bags)
    d = weight * (1 / (1 + np.exp(-f["logit"])) - y) / (total or weight.sum())
    dz = np.repeat(d[:, None] * w["score"], sizes, axis=0)
    da = (dz * f["h"]).sum(axis=1)
    ds = f["a"] * (da - np.repeat(_segments(f["a"] * da, bags), sizes))
    dt = ds[:, None] * w["attend"] * f["g"] * (1 - f["t"] ** 2)
    dg = ds[:, None] * w["attend"] * f["t"] * f["g"] * (1 - f["g"])
    dh = f["a"][:, None] * dz + dt @ w["value"].T + dg @ w["gate"].T
    dp = dh * (1 - f["h"] ** 2)
    return {"encode": x.T @ dp, "encode_bias": dp.sum(axis=0), "value": f["h"].T @ dt, "gate": f["h"].T @ dg, "attend": (f["t"] * f["g"]).T @ ds, "score": f["z"].T @ d, "score_bias": d.sum(keepdims=True)}


def fit(sample: list[tuple[str, int]], totals: dict[int, int], steps: int = 250, **shape) -> AttentionModel:
    """fit_features over the passages of texts that are held here."""
    texts, y = [t for t, _ in sample], np.array([v for _, v in sample], np.float64)
    table, parts = WordTable(), []
    for at in range(0, len(texts), 256):
        parts.append(bag_features(table, texts[at : at + 256]))
    x = np.concatenate([p for p, _ in parts]) if parts else np.zeros((0, WIDTH))
    sizes = np.concatenate([np.diff(b) for _, b in parts]) if parts else np.zeros(0, np.int64)
    return fit_features(x, sizes, y, totals, steps, **shape)


def _chunks(sizes: np.ndarray) -> list[slice]:
    """Documents in a row, of at most CHUNK passages or one document."""
    ends, out = np.cumsum(sizes), []
    while not out or out[-1].stop < len(sizes):
        at = out[-1].stop if out else 0
        out.append(slice(at, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))))
    return out


def fit_features(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, totals: dict[int, int], steps: int = 250, width: int = 24, attention: int = 12, rate: float = 0.03, seed: int = 11) -> AttentionModel:
    """Adam on the weighted logistic loss of whole documents of `sizes` passages (rows of x) each. Gradients are summed over chunks, so what a step needs at once is bounded. Without both labels every score is near the share of label 1."""
    y = y.astype(np.float64)
    if not len(y):
        x, sizes = np.zeros((1, WIDTH)), np.ones(1, np.int64)
    rng, n = np.random.default_rng(seed), x.shape[1]
    shapes = {"encode": (n, width), "encode_bias": (width,), "value": (width, attention), "gate": (width, attention), "attend": (attention,), "score": (width,), "score_bias": (1,)}
    weights = {k: rng.normal(0, 0.3 / np.sqrt(s[0]) if len(s) > 1 else 0.1, s) if "bias" not in k else np.zeros(s) for k, s in shapes.items()}
    model = AttentionModel(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3), weights)
    if len(set(y)) < 2:
        weights["score"][:] = 0
        weights["score_bias"][:] = (8.0 if y[0] else -8.0) if len(y) else 0.0
        return model
    x = (x - model.mean) / model.spread
    weight = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum())
    bags = np.concatenate([[0], np.cumsum(sizes)])
    total = weight.sum()
    parts = [(x[bags[c.start] : bags[c.stop]], bags[c.start : c.stop + 1] - bags[c.start], y[c], weight[c]) for c in _chunks(sizes)]
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    for step in range(1, steps + 1):
        each = [_gradients(model, *part, total) for part in parts]
        for k in weights:
            g = sum(part[k] for part in each) + 1e-4 * weights[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit_tables(documents, labels) -> AttentionModel:
    """Fits on a bounded sample (SAMPLE) of the rows whose fold of five is not 0. Texts become passages where they are; only the passages' numbers come here."""
    rows, totals = labelled_rows(documents, labels, "quality", fold("doc_id", 5) != 0, SAMPLE)
    return fit_features(*collected(rows, lambda _, texts: bag_features(WordTable(), texts), WIDTH), totals)


def op8_quality_classifier(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit_tables(docs, read(spark, sf_dir, "labels")))
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def keep_good(spark, docs, sf_dir, threshold: float = 0.3):
    """Pipeline stage: drops what the classifier does not mark as good. Rows are judged as in reject_toxic."""
    model = fit_tables(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return score_documents(docs, model, keep_if=lambda s: s >= threshold)
