"""Mixing to target weights by soft membership.

A classifier learned from the label table gives every document posteriors over domains. Document
rates w >= 0 are then fitted by distributed projected gradient steps so that the expected token
total of every domain, the sum of w * tokens * posterior, meets its target.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import collected, durable, labelled_rows, read, rows_of
from lumenfold.llm.features import Lexicon, WordTable, abuse_features, shape_features
from lumenfold.llm.toxicity import cross_read, induce, induced

#: The domains and what the label table says of them; the bound of the fitting sample by domain.
DOMAINS = ["poor", "good", "toxic"]
DOMAIN_SQL = "CASE WHEN quality = 0 THEN 0 WHEN quality = 1 AND toxic = 1 THEN 2 WHEN quality = 1 THEN 1 END"
SAMPLE = {0: 2500, 1: 4000, 2: 2500}


@dataclass
class DomainModel:
    lexicon: Lexicon
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def posteriors(self, table: WordTable, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, posteriors) of each text; a token is a word and the space before it."""
        ids, starts, rows = table.look_up(texts)
        x = (_features(ids, starts, rows) - self.mean) / self.spread
        return np.diff(starts), _softmax(np.column_stack([np.clip(x, -8, 8), np.ones(len(x))]) @ self.weights)


def _features(ids, starts, rows) -> np.ndarray:
    return np.column_stack([shape_features(ids, starts, rows), abuse_features(ids, starts, rows)])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


#: Numbers of a text.
WIDTH = 32


def fit_domains(sample: list[tuple[str, int]], totals: dict[int, int], **shape) -> DomainModel:
    """fit_features over texts that are held here."""
    texts, y = [t for t, _ in sample], np.array([v for _, v in sample], np.int64)
    half, toxic = np.arange(len(y)) % 2, (y == 2).astype(float)
    lexicons = [induce([texts[i] for i in np.flatnonzero(half != k)], toxic[half != k]) for k in (0, 1)]
    x, _ = cross_read(lexicons, _features)(np.arange(len(y)), texts)
    return fit_features(x, y, totals, induce(texts, toxic), **shape)


def fit_features(x: np.ndarray, y: np.ndarray, totals: dict[int, int], lexicon: Lexicon, steps: int = 400, rate: float = 0.05) -> DomainModel:
    """Softmax regression on dense, cross-fitted features, weighted back to the label shares; domains without a labelled row have posterior near 0, and no labels at all give equal posteriors."""
    k, width = len(DOMAINS), WIDTH
    if not len(y):
        return DomainModel(Lexicon(), np.zeros(width), np.ones(width), np.zeros((width + 1, k)))
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    x = np.column_stack([np.clip((x - mean) / spread, -8, 8), np.ones(len(y))])
    weight = np.zeros(len(y))
    for d in range(k):
        if (y == d).any():
            weight[y == d] = totals[d] / (y == d).sum()
    weight /= weight.sum()
    target, w = np.eye(k)[y], np.zeros((width + 1, k))
    w[-1] = np.log(np.maximum((weight[:, None] * target).sum(axis=0), 1e-6))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        g = x.T @ (weight[:, None] * (_softmax(x @ w) - target)) + 1e-5 * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-10)
    return DomainModel(lexicon, mean, spread, w)


def fit_tables(documents: DataFrame, labels: DataFrame) -> DomainModel:
    """Fits on a bounded sample (SAMPLE). Texts are read where they are; words of the lexicon and features come here."""
    rows, totals = labelled_rows(documents, labels, DOMAIN_SQL, F.lit(True), SAMPLE)
    *halves, lexicon = induced(rows, 2)
    x, _, y = collected(rows, cross_read(halves, _features), WIDTH)
    return fit_features(x, y, totals, lexicon)


def memberships(docs: DataFrame, model: DomainModel, text: str = "text") -> DataFrame:
    """docs' other columns with tokens and one posterior column p_<domain> each; null and empty texts have no tokens."""
    others = [c for c in docs.columns if c != text]
    docs = docs.select(*others, text)

    def run(batches):
        table = WordTable(model.lexicon)
        for big in batches:
            for batch in rows_of(big, 256):
                tokens, p = model.posteriors(table, [t or "" for t in batch.column(len(others)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(tokens, pa.int64()), *(pa.array(p[:, d]) for d in range(len(DOMAINS)))], names=[*others, "tokens", *(f"p_{d}" for d in DOMAINS)])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1]), "tokens long", *(f"p_{d} double" for d in DOMAINS)])
    return docs.mapInArrow(run, kinds)


def rate_column(history: list[list[float]], scale: list[float]) -> Column:
    """A document's rate after the projected gradient steps whose residuals are in history: w <- max(0, w - scaled posterior * residual)."""
    w = F.lit(1.0)
    for r in history:
        step = sum((F.col(f"p_{d}") * F.lit(float(a * s)) for d, a, s in zip(DOMAINS, r, scale, strict=True)), F.lit(0.0))
        w = F.greatest(F.lit(0.0), w - step)
    return w


def accelerated_column(history: list[list[float]]) -> Column:
    """A document's rate after accelerated steps [momentum, scaled residual of each domain]: w <- max(0, w + momentum * (w - the w before) - posteriors @ residual). A fold, so that the expression stays small."""

    def step(held: Column, h: Column) -> Column:
        down = sum((F.col(f"p_{d}") * F.get(h, F.lit(i + 1)) for i, d in enumerate(DOMAINS)), F.lit(0.0))
        return F.struct(F.greatest(F.lit(0.0), held["w"] + F.get(h, F.lit(0)) * (held["w"] - held["before"]) - down).alias("w"), held["w"].alias("before"))

    steps = F.array(*[F.array(*[F.lit(float(v)) for v in h]) for h in history])
    return F.aggregate(steps, F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("before")), step, lambda held: held["w"])


def _accelerated(members: DataFrame, wanted: list[float], mass: list[float], bound: float, rounds: int = 40) -> tuple[Column, list[float]] | None:
    """(rate, totals) of accelerated projected gradient steps from rate 1 whose totals are within bound of wanted. None: not reached in `rounds` steps, or only by rates that repeat less than a hundredth of the tokens over and over.

    Least squares of the misses in the metric of the inverse of the domains' Gram matrix, the sums of tokens *
    posterior * posterior: in it the largest eigenvalue of the Hessian is 1, so the unit step is the longest that
    is safe, however much posteriors overlap. Totals are linear in the rates, so those at the point ahead (by
    the momentum) follow from the last two, and a step is one aggregation. Momentum restarts when the misses grow.
    """
    k, p = np.array(mass) > 0, [F.col(f"p_{d}") for d in DOMAINS]
    gram = np.array(members.agg(*[F.sum(F.col("tokens") * a * b) for a in p for b in p]).first()).reshape(len(p), len(p))
    metric = np.linalg.pinv(gram, rcond=1e-12, hermitian=True)
    goal, now, history = np.where(k, wanted, 0.0), np.array(mass), []
    was, last, momentum = now, np.inf, 1.0
    for _ in range(rounds):
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = (momentum - 1) / grown
        history.append([ahead, *(metric @ (now + ahead * (now - was) - goal))])
        rows = members.select("tokens", *[f"p_{d}" for d in DOMAINS], accelerated_column(history).alias("w"))
        square, *sums = rows.agg(F.sum(F.col("w") * F.col("w") * F.col("tokens")), *[F.sum(F.col("w") * F.col("tokens") * x) for x in p]).first()
        was, now = now, np.array(sums)
        if now.sum() ** 2 < 0.01 * square * sum(mass):
            return None
        miss = (now - goal)[k]
        if np.abs(miss).max() <= bound:
            return accelerated_column(history), now.tolist()
        value = (now - goal) @ metric @ (now - goal)
        momentum, last = (grown if value <= last else 1.0), value
    return None


def fit_rates(members: DataFrame, targets: dict[str, float], epochs: float = 1.0, rounds: int = 40, tolerance: float = 1e-4) -> tuple[Column, list[dict]]:
    """(the rate of a row, the domain totals after each step).

    Least squares of the relative miss of each domain, started from rate 1, in the metric that
    weighs a document by its tokens; domains are scaled by their present totals, which makes a unit
    step stable and quick. A step is one aggregation of as many sums as there are domains; rates
    follow from the residuals so far, so no per-document state is kept between steps. Targets are
    shares and are normalised; epochs: tokens wanted, as a multiple of those there are. A domain without
    any mass cannot be met and is left as it is. Where posteriors overlap so much that the steps are
    still short of the targets when they slow down or `rounds` are over, accelerated steps in the metric of
    the domains' overlaps start anew; if those fall short too, the rates are what the first steps reached, and a
    warning says by how much the targets are missed.
    """
    if any(v < 0 for v in targets.values()) or sum(targets.values()) <= 0:
        raise ValueError("target weights must not be negative, and one must be positive")
    mass = [F.sum(F.col("tokens") * F.col(f"p_{d}")).alias(d) for d in DOMAINS]
    start = members.agg(*mass).first()
    now = [float(start[d] or 0.0) for d in DOMAINS]
    whole = sum(now)
    wanted = [epochs * whole * targets.get(d, 0.0) / sum(targets.values()) for d in DOMAINS]
    scale = [1.0 / v if v > 0 else 0.0 for v in now]
    history: list[list[float]] = []
    seen = [dict(zip(DOMAINS, now, strict=True))]
    for _ in range(rounds if whole > 0 else 0):
        miss = [a - t for a, t in zip(now, wanted, strict=True)]
        if max(abs(m) for m, s in zip(miss, scale, strict=True) if s) <= tolerance * whole:
            break
        history.append(miss)
        w = rate_column(history, scale)
        got = members.select("tokens", *[f"p_{d}" for d in DOMAINS], w.alias("w")).agg(*[F.sum(F.col("w") * F.col("tokens") * F.col(f"p_{d}")).alias(d) for d in DOMAINS]).first()
        was, now = now, [float(got[d] or 0.0) for d in DOMAINS]
        seen.append(dict(zip(DOMAINS, now, strict=True)))
        if max(abs(a - b) for a, b in zip(now, was, strict=True)) <= tolerance * whole:
            break  # what is still missed needs other steps or cannot be met with rates of 0 and more
    miss = max((abs(a - t) for a, t, s in zip(now, wanted, scale, strict=True) if s), default=0.0)
    if whole > 0 and miss > tolerance * whole:
        if found := _accelerated(members, wanted, list(seen[0].values()), tolerance * whole):
            seen.append(dict(zip(DOMAINS, found[1], strict=True)))
            return found[0], seen
        shares = ", ".join(f"{d} {a:.0f} of {t:.0f}" for d, a, t in zip(DOMAINS, now, wanted, strict=True))
        warnings.warn(f"targets are not met; expected tokens: {shares}", RuntimeWarning, stacklevel=2)
    return rate_column(history, scale), seen


def mix(docs: DataFrame, model: DomainModel, targets: dict[str, float], epochs: float = 1.0, text: str = "text") -> DataFrame:
    """One row per row of docs: its columns but the text, tokens, posteriors and rate.

    Repeated rows get equal rates; a text without words has rate by its posteriors and moves no
    total. Columns of docs that carry an output name are replaced.
    """
    own = ["tokens", "rate", *(f"p_{d}" for d in DOMAINS)]
    keep = [c for c in docs.columns if c.lower() not in own]
    members = durable(memberships(docs.select(*[F.col(f"`{c}`") for c in keep]), model, text))
    rate, _ = fit_rates(members, targets, epochs)
    return members.withColumn("rate", rate)


#: Shares of the tokens that the query asks for.
TARGETS = {"poor": 0.05, "good": 0.90, "toxic": 0.05}


def op4_mixing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = mix(docs, fit_tables(docs, read(spark, sf_dir, "labels")), TARGETS)
    return out.select("doc_id", "tokens", *[F.round(f"p_{d}", 6).alias(f"p_{d}") for d in DOMAINS], F.round("rate", 6).alias("rate"))


def copies(rate: Column, key: Column) -> Column:
    """Whole copies of a row: the rate's integer part, and one more by a hash of the key for the rest."""
    share = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(share < rate - F.floor(rate), 1).otherwise(0)).cast("int")


#: The largest shares of the tokens that the pipeline's corpus may have of each domain but MAIN, which gets the rest.
LIMITS, MAIN = {"poor": 0.01, "toxic": 0.01}, "good"


def limited(members: DataFrame, limits: dict[str, float] = LIMITS, main: str = MAIN) -> dict[str, float]:
    """Target shares: a domain above its limit is brought down to it, one below keeps the share it has.

    A domain that hardly occurs is not raised: its mass is what the classifier isn't sure of, spread over all
    documents, and raising it would repeat a few of them thousands of times at the cost of the rest.
    """
    mass = members.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col(f"p_{d}")), F.lit(0.0)).alias(d) for d in DOMAINS]).first()
    whole = sum(mass) or 1.0
    few = {d: min(limit, mass[d] / whole) for d, limit in limits.items()}
    return {**few, main: 1.0 - sum(few.values())}


def mix_stage(spark, docs, sf_dir, epochs: float = 1.5):
    """Pipeline stage: one and a half epochs of the rows, in the target shares of LIMITS, each row as often as its fitted rate says.

    Where no domain is above its limit every rate is 1.5 and no row goes; else the rows of that domain are thinned.
    A row whose rate gives it no copy is left out, one that gets several is written as often, so
    the expected token totals are those that were fitted. The draw for a rate's broken part is by a
    hash of the row's id and text: rows that share an id are drawn apart unless they are equal.
    Null and empty texts have a rate as any other and count no tokens; an empty table gives no
    rows; columns pass through whatever their names are.
    """
    model = fit_tables(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    own = ["tokens", *(f"p_{d}" for d in DOMAINS)]
    # The stage's rows travel under names that no output of the model has.
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)], F.col("text").cast("string").alias("_text"))
    members = durable(memberships(rows, model, "_text"))
    rate, _ = fit_rates(members.select(*own), limited(members), epochs)
    names = {c.lower(): f"_c{i}" for i, c in enumerate(docs.columns)}
    times = members.withColumn("_n", copies(rate, F.struct(names["doc_id"], names["text"]))).where("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return times.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
