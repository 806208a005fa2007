"""Vector scoring core: cosine, clamp, power, per-source maximum, threshold, deterministic top-K."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.config import MatchConfig


def dot(a: Column, b: Column) -> Column:
    """Inner product in double, without leaving the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def sound(vector: Column, dims: int | None = None) -> Column:
    """Whether a vector takes part in a matching: not null, only finite components, of dims of them."""
    ok = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(ok if dims is None else ok & (F.size(vector) == dims), F.lit(False))


def dimension(targets: DataFrame, dims: int | None = None, vector: str = "vector") -> tuple[int, int]:
    """(length, number) of the targets' sound vectors of dims components; None: of the most frequent length, of equals the largest (0 without any)."""
    n = targets.where(sound(F.col(vector), dims)).groupBy(F.size(vector).alias("dims")).agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    return (top[0]["dims"], top[0]["n"]) if top else (dims or 0, 0)


def score_pairs(sources: DataFrame, targets: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """(source_id, target_id, target_ord, raw_cosine) of every source with every target.

    sources: source_id, vector. targets: target_id, target_ord, vector. The target side is a
    dimension table: it is broadcast only if its size has been checked against
    cfg.max_broadcast_values, and is otherwise dealt in blocks through a shuffle, where every
    pair of a block and a slice of the sources is a key of its own. Vectors that are null, of
    another length than most targets', or hold null or non-finite components take no part.
    """
    dims, n = dimension(targets)
    return _pairs(sources.where(sound(F.col("vector"), dims)), targets.where(sound(F.col("vector"), dims)), dims * n, cfg)


def _pairs(sources: DataFrame, targets: DataFrame, size: int, cfg: MatchConfig) -> DataFrame:
    """score_pairs of sound vectors; size: numbers in all target vectors."""
    t = targets.select("target_id", "target_ord", F.col("vector").alias("tv"))
    score = dot(F.col("sv"), F.col("tv")) if cfg.assume_normalized else cosine(F.col("sv"), F.col("tv"))
    s = sources.select("source_id", F.col("vector").alias("sv"))
    if size <= cfg.max_broadcast_values:
        packed = t.agg(F.collect_list(F.struct("target_id", "target_ord", "tv")).alias("block"))
        pairs = s.join(F.broadcast(packed)).select("source_id", "sv", F.explode("block").alias("t"))
        pairs = pairs.select("source_id", "sv", "t.*")
    else:
        blocks, slices = -(-size // cfg.max_broadcast_values), max(1, -(-s.count() // SLICE))
        left = s.withColumn("_slice", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slices))).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
        right = t.withColumn("_block", F.pmod(F.xxhash64("target_id"), F.lit(blocks))).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<long>")))
        pairs = left.join(right, ["_block", "_slice"])
    return pairs.select("source_id", "target_id", "target_ord", score.alias("raw_cosine"))


def relative_scores(pairs: DataFrame, power: float, keys: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """Adds relative_score: clamped cosine to a power over the key's maximum; 0 where that maximum is 0."""
    sharp = F.pow(F.greatest(F.col("raw_cosine"), F.lit(0.0)), F.lit(float(power)))
    top = F.max("_sharp").over(Window.partitionBy(*keys))
    scored = pairs.withColumn("_sharp", sharp).withColumn("_top", top)
    return scored.withColumn("relative_score", F.when(F.col("_top") > 0, F.col("_sharp") / F.col("_top")).otherwise(F.lit(0.0))).drop("_sharp", "_top")


def ranked(pairs: DataFrame, power: float, keys: tuple[str, ...] = ("source_id",), last_first: bool = False) -> DataFrame:
    """Full ranking: relative score descending, then the frozen target order (its reverse with last_first)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("relative_score"), F.desc("target_ord") if last_first else F.asc("target_ord"))
    return relative_scores(pairs, power, keys).withColumn("rank", F.row_number().over(w))


def select_matches(scored: DataFrame, cfg: MatchConfig, keys: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """Inclusive threshold, then rank, then K. A source whose best score is 0 gives no row."""
    w = Window.partitionBy(*keys).orderBy(F.desc("relative_score"), F.asc("target_ord"))
    out = scored.where((F.col("relative_score") >= cfg.threshold) & (F.col("relative_score") > 0)).withColumn("rank", F.row_number().over(w))
    return out if cfg.top_k is None else out.where(F.col("rank") <= cfg.top_k)


#: Sources that meet one block of targets in a task, where both are dealt.
SLICE = 65_536


def _selected(x: np.ndarray, matrix: np.ndarray, cfg: MatchConfig) -> tuple[np.ndarray, ...]:
    """(row, column, raw, sharp, top of the row) of the scores of x's rows with the matrix that reach the threshold of the row's maximum, at most K a row, best first; columns are in target order."""
    raw = (x if cfg.assume_normalized else _unit(x)) @ matrix.T
    sharp = np.maximum(raw, 0.0) ** cfg.power
    top = sharp.max(axis=1, initial=0.0, keepdims=True)
    score = np.divide(sharp, top, out=np.zeros_like(sharp), where=top > 0)
    row, col = np.nonzero((score >= cfg.threshold) & (score > 0))
    order = np.lexsort((col, -score[row, col], row))
    row, col = row[order], col[order]
    if cfg.top_k is not None:
        first = np.arange(len(row)) - np.searchsorted(row, row) < cfg.top_k
        row, col = row[first], col[first]
    return row, col, raw[row, col], sharp[row, col], top[row, 0]


def match_rows(sources: DataFrame, targets: DataFrame, cfg: MatchConfig, dims: int) -> DataFrame:
    """The whole matching inside one pass over the sources, without a shuffle.

    The target matrix, whose size the caller has checked, is broadcast; every batch of sources is
    one matrix product, and since a source then has all its scores in one row, its maximum,
    threshold and ranks need no other row. All vectors have dims components, those of the targets are
    sound; sources that aren't are passed over in the batch.
    """
    known = targets.select("target_id", "target_ord", "vector").orderBy("target_ord", "target_id").toArrow()
    matrix = np.array(known.column("vector").to_pylist(), dtype=np.float64).reshape(known.num_rows, dims)
    if not cfg.assume_normalized:
        matrix = _unit(matrix)
    shared = sources.sparkSession.sparkContext.broadcast((matrix, known.column("target_id").combine_chunks(), known.column("target_ord").combine_chunks()))

    def run(batches):
        matrix, ids, ords = shared.value
        step = max(1, 4_000_000 // max(1, len(matrix)))
        for whole in batches:
            for at in range(0, whole.num_rows if len(matrix) else 0, step):
                batch = whole.slice(at, step)
                x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(batch.num_rows, dims)
                fine = np.isfinite(x).all(axis=1)  # null components have become NaN
                if not fine.all():
                    batch, x = batch.filter(pa.array(fine)), x[fine]
                row, col, raw, sharp, top = _selected(x, matrix, cfg)
                rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), ids.take(pa.array(col)), ords.take(pa.array(col)), pa.array(raw), pa.array(sharp / top), pa.array(rank, pa.int32())], names=NAMES)

    return sources.select("source_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, _schema(sources, targets, NAMES))


def match_blocks(sources: DataFrame, targets: DataFrame, cfg: MatchConfig, dims: int, size: int) -> DataFrame:
    """The matching of more targets than may be broadcast.

    Targets are dealt in blocks and sources in slices; a task holds one block's matrix and streams one slice past
    it, a matrix product at a time. Of a source it passes on the block's maximum and the K best that
    reach the threshold of that maximum, which the maximum over all blocks can only raise; the
    blocks' few rows are merged by source.
    """
    blocks, slices = -(-size // cfg.max_broadcast_values), max(1, -(-sources.count() // SLICE))
    ids, ords, keys = (df.schema[c].dataType for df, c in ((targets, "target_id"), (targets, "target_ord"), (sources, "source_id")))
    none = {"target_id": F.lit(None).cast(ids), "target_ord": F.lit(None).cast(ords), "source_id": F.lit(None).cast(keys)}
    v = F.col("vector").cast("array<double>").alias("vector")
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    t = targets.select(F.pmod(F.xxhash64("target_id", "target_ord"), F.lit(blocks)).alias("b"), every.alias("s"), none["source_id"].alias("source_id"), "target_id", "target_ord", v)
    own = sources.withColumn("s", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slices)).cast("int"))
    x = own.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("b"), "s", "source_id", none["target_id"].alias("target_id"), none["target_ord"].alias("target_ord"), v)
    # Targets come before the sources of their unit.
    dealt = t.withColumn("k", F.lit(False)).unionByName(x.withColumn("k", F.lit(True))).repartition("b", "s").sortWithinPartitions("b", "s", "k", "target_ord", "target_id")
    names = ["source_id", "target_id", "target_ord", "raw_cosine", "_sharp", "_top"]

    def run(batches):
        unit, held, matrix = None, [], None
        for whole in batches:
            b, s, k = (whole.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 6))
            cuts = np.flatnonzero((b[1:] != b[:-1]) | (s[1:] != s[:-1]) | (k[1:] != k[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, whole.num_rows], strict=True):
                if lo == hi:
                    continue
                if (b[lo], s[lo]) != unit:
                    unit, held, matrix = (b[lo], s[lo]), [], None
                part = whole.slice(lo, hi - lo)
                if not k[lo]:
                    held.append(part.select([3, 4, 5]))
                    continue
                if matrix is None:
                    known = pa.Table.from_batches(held, schema=part.select([3, 4, 5]).schema).combine_chunks()
                    matrix = np.asarray(pa.chunked_array(known.column(2).chunks, type=known.schema.field(2).type).combine_chunks().flatten().to_numpy(zero_copy_only=False) if held else [], dtype=np.float64).reshape(-1, dims)
                    matrix, held = matrix if cfg.assume_normalized else _unit(matrix), [known]
                step = max(1, 4_000_000 // max(1, len(matrix)))
                for at in range(0, part.num_rows if len(matrix) else 0, step):
                    few = part.slice(at, step)
                    rows = np.asarray(few.column(5).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(few.num_rows, dims)
                    row, col, raw, sharp, top = _selected(rows, matrix, cfg)
                    yield pa.RecordBatch.from_arrays([few.column(2).take(pa.array(row)), *(held[0].column(i).combine_chunks().take(pa.array(col)) for i in (0, 1)), pa.array(raw), pa.array(sharp), pa.array(top)], names=names)

    found = dealt.mapInArrow(run, _schema(sources, targets, names))
    top = F.max("_top").over(Window.partitionBy("source_id"))
    scored = found.withColumn("relative_score", F.col("_sharp") / top)
    return select_matches(scored, cfg).select(*NAMES)


def _schema(sources: DataFrame, targets: DataFrame, names: list[str]) -> T.StructType:
    kind = {f.name: f.dataType for f in [*sources.schema.fields, *targets.schema.fields]}
    return T.StructType([T.StructField(n, kind.get(n) or (T.IntegerType() if n == "rank" else T.DoubleType())) for n in names])


NAMES = ["source_id", "target_id", "target_ord", "raw_cosine", "relative_score", "rank"]


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def match(sources: DataFrame, targets: DataFrame, cfg: MatchConfig = MatchConfig(), engine: str = "arrow", dims: int | None = None) -> DataFrame:
    """The matching pipeline: source_id, target_id, target_ord, raw_cosine, relative_score, rank.

    engine "arrow": matrix products, without a shuffle while the targets are within
    cfg.max_broadcast_values, beyond that in blocks; engine "sql": JVM expressions and one shuffle
    on the source key. Source ids are distinct. Vectors that are null, of another length than
    dims (None: that of most targets), or hold null or non-finite components take no part, as source or target, in either engine.
    """
    dims, n = dimension(targets, dims)
    s, t = (df.where(sound(F.col("vector"), dims)) for df in (sources, targets))
    if engine == "arrow" and dims * n <= cfg.max_broadcast_values:
        return match_rows(sources.where(F.size("vector") == dims), t, cfg, dims)
    if engine == "arrow":
        return match_blocks(s, t, cfg, dims, dims * n)
    return select_matches(relative_scores(_pairs(s, t, dims * n, cfg), cfg.power), cfg).select(*NAMES)
