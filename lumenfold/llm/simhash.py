"""SimHash near-duplicate detection by tiled exact comparison.

Distinct fingerprints are split into m bit blocks; two fingerprints at most r bits apart agree on
at least m - r blocks, so every link lies inside a bucket of fingerprints that share m - r blocks.
Inside a bucket, fingerprints are sorted by population count and compared tile by tile with
exclusive or and bit counts; tile pairs whose population counts differ by more than the radius are
skipped. A bucket of more rows than a task should hold is dealt into parts, and every pair of parts
is a unit of work of its own. A bucket gives only the edges of a spanning forest, never all its pairs, and the
components of those edges are found by distributed label exchange.

Documents that are alike to a stated similarity (similar_documents) meet in buckets of equal
minimal hashes instead, are compared there by wider fingerprints in the same way, and are then counted exactly.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import durable, join_hot, read, rows_of, without_ids

BITS = 64
SEED = 42
CHUNK = 1 << 15
#: Most rows of a part of a bucket.
TILE = 16384


def fingerprint(text: str, shingle: int) -> int:
    """Majority bits of the XXH64 hashes of all word shingles; fewer words than a shingle: the whole sequence; no words: 0."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), CHUNK):
        part = [joined[a:b] for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp): fp as a signed long. Null texts have no words; rows without an id are left out."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(t or "", shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def block_masks(radius: int, blocks: int) -> list[int]:
    """The masks of all sets of blocks - radius bit blocks; fingerprints within the radius agree under one of them."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(m) for m in combinations(masks, blocks - radius)]


def blocks_for(distinct: int, radius: int, bucket: int = 4096) -> int:
    """Fewest blocks with which random fingerprints fill a bucket with at most about `bucket` of them; every choice finds every link."""
    for blocks in range(radius + 1, radius + 6):
        if distinct / 2.0 ** (BITS * (blocks - radius) / blocks) <= bucket:
            return blocks
    return radius + 6


class Forest:
    """Union-find over positions; the smaller root stays."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links a[i] with b[i] for all i, by repeated pointer jumping."""
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))

    def roots(self, x: np.ndarray) -> np.ndarray:
        up = self.up
        r = up[x]
        while True:
            above = up[r]
            if (above == r).all():
                up[x] = r
                return r
            r = above


def link_bucket(fp: np.ndarray, ids: np.ndarray, radius: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, id of its root) of a spanning forest of the links among the distinct fingerprints of one bucket."""
    order = np.argsort(np.bitwise_count(fp), kind="stable")
    fp, ids = fp[order], ids[order]
    pop = np.bitwise_count(fp).astype(np.int64)
    forest, n = Forest(len(fp)), len(fp)
    for i in range(0, n, tile):
        a = fp[i : i + tile]
        for j in range(i, n, tile):
            if pop[j] - pop[min(i + tile, n) - 1] > radius:
                break  # sorted: all later tiles are as far away
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ fp[None, j : j + tile]) <= radius)
            x, y = x + i, y + j
            forest.join(x[x < y], y[x < y])
    roots = forest.roots(np.arange(n))
    own = np.flatnonzero(roots != np.arange(n))
    return ids[own], ids[roots[own]]


def link_small(fp: np.ndarray, ids: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of many small buckets at once: one exclusive or for each distance between neighbours in bucket order."""
    out_a, out_b = [ids[:0]], [ids[:0]]
    k = 1
    while k < len(fp):
        at = np.flatnonzero(bucket[k:] == bucket[:-k])
        if not len(at):
            break
        at = at[np.bitwise_count(fp[at] ^ fp[at + k]) <= radius]
        out_a.append(ids[at + k])
        out_b.append(ids[at])
        k += 1
    return np.concatenate(out_a), np.concatenate(out_b)


def links(distinct: DataFrame, radius: int, blocks: int, small: int = 24) -> DataFrame:
    """(a, b) edges between ids whose components are the components of all links among distinct's rows (id, fp), each fp once.

    One shuffle deals the buckets out; sorted partitions are then streamed, so that a task holds
    one bucket at a time. A bucket of u members gives at most u - 1 edges, or, up to `small`
    members, its linked pairs.
    """
    masks = block_masks(radius, blocks)
    keyed = distinct.select("fp", "id", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")) for m in masks])).alias("mask", "part"))
    keyed = keyed.select("fp", "id", F.xxhash64("mask", "part").alias("bucket"))
    big = durable(keyed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > TILE))
    hot = big.count()
    large = None
    if hot:
        few = F.broadcast(big) if hot <= 500_000 else big
        units = tile_pairs(keyed.join(few, "bucket").select("bucket", F.ceil(F.col("n") / TILE).cast("long").alias("tiles"), "id", "fp"), "bucket", "id")
        large = forests(units, ["bucket", "i", "j"], "id", ["fp"], lambda unit: radius).select("a", "b")
        keyed = keyed.join(few, "bucket", "left_anti").select("fp", "id", "bucket")
    keyed = keyed.repartition("bucket").sortWithinPartitions("bucket")

    def run(batches):
        fp, ids, bucket = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def linked(fp, ids, bucket):
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(fp)]]))
            few = np.repeat(sizes <= small, sizes)
            yield link_small(fp[few], ids[few], bucket[few], radius)
            for s, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
                yield link_bucket(fp[s : s + n], ids[s : s + n], radius)

        def out(pairs):
            for a, b in pairs:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            fp, ids, bucket = np.concatenate([fp, new[0].view(np.uint64)]), np.concatenate([ids, new[1]]), np.concatenate([bucket, new[2]])
            if not len(fp):
                continue
            last = np.searchsorted(bucket, bucket[-1])  # the last bucket may go on
            if last:
                yield from out(linked(fp[:last], ids[:last], bucket[:last]))
            fp, ids, bucket = fp[last:], ids[last:], bucket[last:]
        if len(fp):
            yield from out(linked(fp, ids, bucket))

    found = keyed.mapInArrow(run, "a long, b long").where("a <> b")
    return found if large is None else found.unionAll(large)


def tile_pairs(rows: DataFrame, key: str, by: str) -> DataFrame:
    """rows with i, j and side: each row once for every pair (i <= j) of the key's `tiles` parts that it stands in; side 1 is part j of an unequal pair."""
    mine, other = F.pmod(F.xxhash64(by), F.col("tiles")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    dealt = rows.withColumn("_mine", mine).withColumn("_other", other)
    i, j = F.least("_mine", "_other"), F.greatest("_mine", "_other")
    return dealt.withColumn("i", i).withColumn("j", j).withColumn("side", (F.col("_mine") > F.col("_other")).cast("int")).drop("_mine", "_other", "tiles")


def forests(dealt: DataFrame, unit: list[str], by: str, words: list[str], reach, extra: str | None = None) -> DataFrame:
    """(a, b, tree) edges of the spanning forest of the links in every unit of dealt (unit, side, by, words); tree: a hash of the ids that the edge's component has there.

    A sorted partition is streamed, and a task holds one unit at a time. reach: the radius for a unit, given the least value of its column `extra`.
    """
    names = [*unit, "side", by, *words, *([extra] if extra else [])]
    at = len(unit)

    def run(batches):
        held: list[list[np.ndarray]] = []

        def close():
            if not held:
                return
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            side, ids, fp = columns[at], columns[at + 1], np.column_stack(columns[at + 2 : at + 2 + len(words)]).view(np.uint64)
            first, radius = side == 0, reach(columns[-1].min() if extra else None)
            if columns[at - 2][0] == columns[at - 1][0]:
                u, v = link_tiles(fp, None, radius)
            elif first.any() and not first.all():
                ids = np.concatenate([ids[first], ids[~first]])
                u, v = link_tiles(fp[first], fp[~first], radius)
            else:
                return
            if len(u):
                order = np.argsort(v, kind="stable")
                u, v = u[order], v[order]
                cuts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
                trees = np.array([xxhash.xxh3_64_intdigest(np.sort(np.append(ids[u[x:y]], ids[v[x]])).tobytes()) for x, y in zip(cuts, [*cuts[1:], len(v)], strict=True)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v]), pa.array(np.repeat(trees, np.diff([*cuts, len(v)])))], names=["a", "b", "tree"])

        last = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            new = np.zeros(max(0, batch.num_rows - 1), bool)
            for c in columns[:at]:
                new |= c[1:] != c[:-1]
            cuts = np.flatnonzero(new) + 1
            for x, y in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if x < y:
                    own = tuple(c[x] for c in columns[:at])
                    if own != last:
                        yield from close()
                        last = own
                    held.append([c[x:y] for c in columns])
        yield from close()

    return dealt.select(*names).repartition(*unit).sortWithinPartitions(*unit).mapInArrow(run, "a long, b long, tree long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root being the smallest node of its component.

    Alternates large-star and small-star steps; each is a shuffle of the edges alone, a node with
    very many edges is not gathered anywhere, and a round's edges are checkpointed, so a lost
    executor costs one round. Stops when a round changes nothing.
    """
    e = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(rounds):
        if not state[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = durable(join_hot(both, low, "u", 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = join_hot(large, low, "u", large.count())
        e = durable(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct())
        was, state = state, e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == was:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs that has an id.

    fingerprint: 16 hex digits. component_id: the smallest id reachable over links of at most
    `radius` differing bits. Null and empty texts have fingerprint zero and are linked like any
    other; repeated ids keep their rows; an empty table gives no rows. Other columns are ignored.
    """
    prints = durable(fingerprints(docs, shingle, text, doc_id))
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")))
    total, count = distinct.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # A fingerprint's least id stands for it, so that a component's root is its smallest id.
    roots = components(links(distinct.select("id", "fp"), radius, blocks_for(total, radius)))
    found = durable(distinct.join(roots, distinct["id"] == roots["node"], "left").select("fp", "n", F.coalesce("root", "id").alias("component_id")))
    out = join_hot(prints, found, "fp", count)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_simhash(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


#: For similar texts: words of 64 bits in a fingerprint; bands of minimal hashes that a text has, and hashes in a band.
WORDS, BANDS, ROWS = 4, 16, 3
#: Multipliers that order a set's hashes anew for each minimal hash.
ORDERS = np.array([xxhash.xxh64_intdigest(f"order {k}", SEED) | 1 for k in range(BANDS * ROWS)], np.uint64)
#: Shingles of a unit's sets in all.
MASS = 4_000_000


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """The WORDS / 2 XXH3 hashes (16 bytes each, side by side) of every distinct word shingle, in order of the first 8 bytes; words as in fingerprint()."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros((0, 8 * WORDS), np.uint8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    out = np.empty((len(starts), 8 * WORDS), np.uint8)
    for at in range(0, len(starts), CHUNK):
        part = [joined[a:b] for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)]
        for seed in range(WORDS // 2):
            out[at : at + CHUNK, 16 * seed : 16 * seed + 16] = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, part, repeat(seed))), np.uint8).reshape(-1, 16)
    return out[np.unique(np.ascontiguousarray(out[:, :8]).view(np.uint64).ravel(), return_index=True)[1]]


def majority(hashes: np.ndarray) -> np.ndarray:
    """WORDS * 64 majority bits of the rows of shingle_hashes()."""
    ones = np.zeros(WORDS * 64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """A text's set of shingles: the first 8 bytes of each one's hash, ascending."""
    return np.ascontiguousarray(hashes[:, :8]).view(np.uint64).ravel()


def wide_fingerprint(text: str, shingle: int) -> tuple[np.ndarray, int]:
    """(WORDS * 64 majority bits of the hashes of all distinct word shingles, number of those); how often a shingle is repeated says nothing, as in Jaccard similarity."""
    hashes = shingle_hashes(text, shingle)
    return majority(hashes), len(hashes)


def bands(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingle hashes; sets of Jaccard similarity s share one with probability 1 - (1 - s ** ROWS) ** BANDS, at 0.8 all but one in 10 ** 5. The empty set has keys as any other."""
    low = np.full(BANDS * ROWS, np.uint64((1 << 64) - 1))
    for at in range(0, len(shingles), CHUNK):
        low = np.minimum(low, (shingles[None, at : at + CHUNK] * ORDERS[:, None]).min(axis=1))
    low = low.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * ORDERS[0]
    for k in range(ROWS):
        key = (key ^ (key >> np.uint64(29))) * ORDERS[1] + low[:, k]
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def radius_for(similarity: float, margin: float = 4.0) -> int:
    """Differing bits expected at this Jaccard similarity of equally long texts (cosine 2s / (1 + s)), and `margin` standard deviations more, so that few similar pairs are lost to chance."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    n = WORDS * 64
    return int(n * p + margin * np.sqrt(n * p * (1 - p)))


def link_tiles(a: np.ndarray, b: np.ndarray | None, radius: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (as positions in a then b) of the links within a tile (b None) or between two tiles of wide fingerprints."""
    whole = a if b is None else np.concatenate([a, b])
    pop = np.bitwise_count(whole).sum(axis=1, dtype=np.int64)
    forest = Forest(len(whole))
    x = np.argsort(pop[: len(a)], kind="stable")
    y = x if b is None else len(a) + np.argsort(pop[len(a) :], kind="stable")
    for i in range(0, len(x), block):
        p = x[i : i + block]
        for j in range(i if b is None else 0, len(y), block):
            q = y[j : j + block]
            if pop[q[0]] - pop[p[-1]] > radius:
                break
            if pop[p[0]] - pop[q[-1]] > radius:
                continue
            d = np.zeros((len(p), len(q)), np.uint16)
            for w in range(whole.shape[1]):
                d += np.bitwise_count(whole[p, w][:, None] ^ whole[q, w][None, :])
            u, v = np.nonzero(d <= radius)
            forest.join(p[u], q[v])
    roots = forest.roots(np.arange(len(whole)))
    own = np.flatnonzero(roots != np.arange(len(whole)))
    return own, roots[own]


def candidate_trees(distinct: DataFrame, radius: int, few_radius: int, few: int = 8) -> DataFrame:
    """(tree, fp): groups of distinct's rows (fp, shingles, f0.., b0..) that are linked by fingerprints within the radius (few_radius in a bucket with sets of fewer than `few` shingles) inside some bucket of a common band.

    Rows meet by band as (band, fp) alone, and what is alone in its bucket goes no further; a hot
    bucket's size comes to its rows. The rest fetch their fingerprints by fp. A bucket is dealt into
    parts of at most TILE rows and about MASS shingles. Groups of the same members, as copies
    have in most of their bands, are one.
    """
    keyed = distinct.where("shingles > 0").select("fp", "shingles", F.explode(F.array(*[f"b{k}" for k in range(BANDS)])).alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("shingles").alias("m")).where("n >= 2")
    tiles = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("m") / MASS)).cast("long")
    met = join_hot(keyed.select("key", "fp"), durable(counts.select("key", "n", tiles.alias("tiles"))), "key", BANDS * distinct.count())
    words = [f"f{w}" for w in range(WORDS)]
    units = tile_pairs(met.join(distinct.select("fp", "shingles", *words), "fp"), "key", "fp")
    edges = durable(forests(units, ["key", "i", "j"], "fp", words, lambda least: few_radius if least < few else radius, "shingles"))
    return edges.select("tree", F.col("a").alias("fp")).union(edges.select("tree", F.col("b").alias("fp"))).distinct()


def verify(sets: list[np.ndarray], similarity: float, block: int = 256) -> tuple[list[int], list[int]]:
    """A spanning forest (as positions) of the pairs of sets (ascending hashes) whose Jaccard similarity is at least `similarity`.

    Pairs that are in one component already need no look; all others whose sizes allow it are counted exactly.
    """
    order = np.argsort([len(x) for x in sets], kind="stable")
    sets = [sets[i] for i in order]
    sizes = np.array([len(x) for x in sets])
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    words, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes, mark, forest = codes.astype(np.int32), np.zeros(len(words), np.int32), Forest(len(sets))
    ends = np.searchsorted(sizes * similarity, sizes + 1e-6, side="right")
    out_a, out_b = [], []
    for i in np.flatnonzero(sizes > 0).tolist():
        own = codes[cuts[i] : cuts[i + 1]]
        mark[own] = 1
        for at in range(i + 1, ends[i], block):
            rest = np.arange(at, min(at + block, ends[i]))
            rest = rest[forest.roots(rest) != forest.roots(np.array([i]))]
            if len(rest):
                both = np.add.reduceat(mark[np.concatenate([codes[cuts[j] : cuts[j + 1]] for j in rest.tolist()])], np.concatenate([[0], np.cumsum(sizes[rest])[:-1]]))
                rest = rest[both / (sizes[i] + sizes[rest] - both) >= similarity]
                forest.join(np.full(len(rest), i), rest)
                out_a += order[rest].tolist()
                out_b += [int(order[i])] * len(rest)
        mark[own] = 0
    return out_a, out_b


def verified_links(rows: DataFrame, distinct: DataFrame, trees: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b) edges between ids: of the candidates in trees (tree, fp of distinct's rows) those whose texts' shingle sets are really as similar.

    Only the texts of candidates are cut into shingles again, and a tree's sets meet in one task.
    """
    nodes = durable(trees)
    wanted = durable(nodes.select("fp").distinct().join(distinct.select("fp", "id"), "fp"))
    ids = durable(wanted.select(F.col("id").alias("doc_id")).distinct())
    met = rows.join(F.broadcast(ids) if ids.count() <= 500_000 else ids, "doc_id", "left_semi")

    def cut(batches):
        for big in batches:
            for batch in rows_of(big):
                sets = [shingle_set(shingle_hashes(t or "", shingle)) for t in batch.column(1).to_pylist()]
                keys = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "fp", "set"])

    # Rows that share an id have that id's sets; a set is taken once.
    sets = met.select("doc_id", "text").mapInArrow(cut, "id long, fp long, set binary").join(wanted, ["id", "fp"]).groupBy("fp").agg(F.min("id").alias("id"), F.first("set").alias("set"))

    def run(batches):
        key, ids, held = None, [], []

        def close():
            a, b = verify(held, similarity) if len(held) > 1 else ([], [])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in a], pa.int64()), pa.array([ids[i] for i in b], pa.int64())], names=["a", "b"])

        for big in batches:
            for batch in rows_of(big):
                for tree, i, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if tree != key:
                        yield from close()
                        key, ids, held = tree, [], []
                    ids.append(i)
                    held.append(np.frombuffer(x, np.uint64))
        yield from close()

    return nodes.join(sets, "fp").select("tree", "id", "set").repartition("tree").sortWithinPartitions("tree").mapInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, component_id) for every row of docs that has an id: the smallest id reachable over links of texts whose sets of word shingles have at least this Jaccard similarity.

    64 bits cannot tell 0.8 from chance at a radius that keeps such pairs, so fingerprints are
    WORDS * 64 bits wide and the radius follows from the similarity, with a margin of 4 standard
    deviations (see radius_for). Texts meet in buckets of common bands (see bands), fingerprints name the
    candidates there, and each link is counted on the two sets. Cases as in near_duplicates; texts
    without words are copies of each other.
    """
    if not 0.8 <= similarity <= 1:
        raise ValueError("bands and radius are made for similarities from 0.8")
    words, keys = [f"f{w}" for w in range(WORDS)], [f"b{k}" for k in range(BANDS)]

    def run(batches):
        for big in batches:
            for batch in rows_of(big):
                n, fp, key, sets = [], np.zeros((batch.num_rows, WORDS), np.uint64), np.zeros((batch.num_rows, BANDS), np.int64), []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    hashes = shingle_hashes(t or "", shingle)
                    own = shingle_set(hashes)
                    n.append(len(hashes))
                    fp[i], key[i] = majority(hashes), bands(own)
                    sets.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                made = [pa.array(np.array(sets, np.uint64).view(np.int64)), pa.array(n, pa.int64()), *(pa.array(fp.view(np.int64)[:, w]) for w in range(WORDS)), *(pa.array(key[:, k]) for k in range(BANDS))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "fp", "shingles", *words, *keys])

    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    prints = durable(rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", "shingles", *words, *keys))))
    # A row for each set of shingles (fp is its hash); all but the id are the same in its copies.
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("shingles", *words, *keys)]))
    count = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    radius = radius_for(similarity)
    # The majority bits of a handful of shingles differ by more than the angle says: at most 3 in 16 on average, for 4 of 5.
    few_radius = max(radius, int(WORDS * 64 * 3 / 16 + 4 * np.sqrt(WORDS * 64 * 39 / 256)))
    edges = verified_links(rows, distinct, candidate_trees(distinct, radius, few_radius), shingle, similarity)
    roots = components(edges)
    found = durable(distinct.join(roots, distinct["id"] == roots["node"], "left").select("fp", "n", F.coalesce("root", "id").alias("component_id")))
    return join_hot(prints.select("doc_id", "fp"), found, "fp", count).select("doc_id", "component_id")


def keep_one(spark, docs, sf_dir):
    """Pipeline stage: of each component of similar documents (five words, Jaccard similarity of 0.8 or more) the one with the smallest id stays. Rows without an id stay, as nothing is known to equal them; rows that share an id stay or go together."""
    return without_ids(docs, similar_documents(docs).where("doc_id <> component_id").select("doc_id").distinct())
