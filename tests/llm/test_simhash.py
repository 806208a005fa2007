import re

import numpy as np
import pytest
import xxhash

from lumenfold.llm import simhash as S


def brute_components(fp, ids, radius):
    up = list(range(len(ids)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(ids)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= radius:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    low = {}
    for i in range(len(ids)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return {ids[i]: low[find(i)] for i in range(len(ids))}


def clusters(rng, n):
    base = rng.integers(0, 1 << 63, n // 8, dtype=np.uint64)
    out = []
    for b in base:
        for _ in range(8):
            x = int(b)
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(bit)
            out.append(x)
    return out


@pytest.mark.parametrize("blocks, small", [(5, 24), (5, 1), (6, 24), (7, 2)])
def test_links_and_components_against_brute_force(spark, blocks, small):
    fp = list(dict.fromkeys(clusters(np.random.default_rng(blocks), 400)))
    signed = [x - (1 << 64) if x >> 63 else x for x in fp]
    edges = S.links(spark.createDataFrame([(x, 3 * i) for i, x in enumerate(signed)], "fp long, id long"), 4, blocks, small)
    roots = {r["node"]: r["root"] for r in S.components(edges).collect()}
    ids = [3 * i for i in range(len(fp))]
    assert {i: roots.get(i, i) for i in ids} == brute_components(fp, ids, 4)


@pytest.mark.parametrize("tile", [40, 7])
def test_hot_buckets_are_dealt_in_parts(spark, monkeypatch, tile):
    monkeypatch.setattr(S, "TILE", tile)
    rng = np.random.default_rng(tile)
    fp = list(dict.fromkeys([*clusters(rng, 80), *(int(x) for x in rng.integers(0, 1 << 14, 150))]))
    signed = [x - (1 << 64) if x >> 63 else x for x in fp]
    edges = S.links(spark.createDataFrame([(x, 3 * i) for i, x in enumerate(signed)], "fp long, id long"), 4, 5)
    roots = {r["node"]: r["root"] for r in S.components(edges).collect()}
    ids = [3 * i for i in range(len(fp))]
    assert {i: roots.get(i, i) for i in ids} == brute_components(fp, ids, 4)


def plain_fingerprint(text, k=4):
    """The contract's words, in plain Python."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_query_against_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = list(texts)
    fp = [plain_fingerprint(texts[i]) for i in ids]
    want = brute_components(fp, ids, 4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.op5_simhash(spark, sf).collect()}
    assert got == {i: (f"{x:016x}", want[i]) for i, x in zip(ids, fp, strict=True)}


def test_every_link_shares_a_mask():
    rng = np.random.default_rng(3)
    for blocks in (5, 6, 7, 8):
        masks = S.block_masks(4, blocks)
        for _ in range(300):
            d = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(d & m == 0 for m in masks)


def test_tiles_skip_nothing_that_links():
    fp = np.array(clusters(np.random.default_rng(9), 1200), np.uint64)
    fp = np.unique(fp)
    a, b = S.link_bucket(fp, np.arange(len(fp)), 4, tile=32)
    x, y = S.link_bucket(fp, np.arange(len(fp)), 4, tile=4096)
    assert len(a) == len(x)


def test_chain_is_one_component(spark):
    fp = [(1 << k) - 1 for k in range(0, 62, 2)]
    edges = S.links(spark.createDataFrame([(x, i) for i, x in enumerate(fp)], "fp long, id long"), 4, 5)
    assert {r["root"] for r in S.components(edges).collect()} == {0}


def test_contract_cases(spark, odd_docs, no_docs):
    out = S.near_duplicates(odd_docs).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append((r["fingerprint"], r["component_id"]))
    assert None not in by and len(out) == 9 and len(by[6]) == 2
    assert by[1] == by[2] == by[3] == [("0" * 16, 1)]
    assert S.near_duplicates(no_docs).count() == 0
    assert S.fingerprint("A b", 4) == S.fingerprint("a\tb\n", 4) != S.fingerprint("Éa b", 4)


def test_stage_keeps_the_least_id(spark):
    docs = spark.createDataFrame([(5, "t w o s e n"), (3, "t w o s e n"), (9, "another text with nothing in common"), (None, "t w o s e n")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in S.keep_one(spark, docs, "").collect()) == [0, 3, 9]


def edited(rng, words, n):
    w = list(words)
    for i in rng.integers(0, len(w), n):
        w[i] = f"new{rng.integers(0, 1 << 30)}"
    return w


def test_similar_documents_odd_rows(odd_docs, no_docs):
    got = {}
    for r in S.similar_documents(odd_docs).collect():
        got.setdefault(r["doc_id"], []).append(r["component_id"])
    assert got == {1: [1], 2: [1], 3: [1], 4: [4], 5: [5], 6: [6, 6], 8: [8], 9: [9]}
    assert S.similar_documents(no_docs).count() == 0
    with pytest.raises(ValueError):
        S.similar_documents(no_docs, similarity=0.5)


def test_repeats_do_not_part_texts(spark):
    rng = np.random.default_rng(4)
    a, b, c = ([f"w{x}" for x in rng.integers(0, 5000, n)] for n in (400, 60, 300))
    texts = [a, a + a, a * 5, b + c, b * 20 + c, c * 3 + b]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    near = [[len(x & y) / len(x | y) >= 0.8 for y in sets] for x in sets]
    assert near == [[i // 3 == j // 3 for j in range(6)] for i in range(6)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in S.similar_documents(df).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}


@pytest.mark.parametrize("tile", [16384, 7])
def test_links_are_of_exact_similarity(spark, monkeypatch, tile):
    monkeypatch.setattr(S, "TILE", tile)
    rng = np.random.default_rng(8)
    texts = []
    for length in (8, 9, 12, 40, 150, 400):
        for share in (0.0, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08):
            base = [f"w{x}" for x in rng.integers(0, 50_000, length)]
            texts += [base, edited(rng, base, int(length * share)), [*base, *base[:3]], base[1:]]
    sets = [frozenset(tuple(t[i : i + 5]) for i in range(len(t) - 4)) for t in texts]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                up = [min(up[i], up[j]) if x in (up[i], up[j]) else x for x in up]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in S.similar_documents(df).collect()} == dict(enumerate(up))
    assert sorted(r["doc_id"] for r in S.keep_one(spark, df, "").collect()) == sorted(set(up))


def test_planted_near_copies_are_caught_and_other_texts_are_not(spark):
    """Copies with a few words replaced, among texts that share a long passage: all of similarity 0.8 or more go, all below stay."""
    rng = np.random.default_rng(21)
    passage = [f"p{x}" for x in rng.integers(0, 5000, 60)]
    docs, planted = [], []
    for _ in range(120):
        base = [*[f"w{x}" for x in rng.integers(0, 20_000, rng.integers(150, 400))], *passage]
        docs.append(base)
        for _ in range(2):
            copy = edited(rng, base, rng.integers(1, max(2, len(base) // 50)))
            docs.append(copy)
            x, y = (frozenset(tuple(t[i : i + 5]) for i in range(len(t) - 4)) for t in (base, copy))
            planted.append((len(docs) - 1, len(x & y) / len(x | y)))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in S.keep_one(spark, df, "").collect()}
    assert sum(s >= 0.8 for _, s in planted) > 200 and not any(i in kept for i, s in planted if s >= 0.8)
    assert set(range(0, 360, 3)) <= kept


def test_bands_find_similar_sets():
    rng = np.random.default_rng(5)
    met = {0.8: 0, 0.3: 0}
    for s in met:
        for _ in range(300):
            x = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
            shared = int(round(1000 * 2 * s / (1 + s)))
            y = np.concatenate([x[:shared], rng.integers(0, 1 << 63, 1000 - shared, dtype=np.uint64)])
            met[s] += bool((S.bands(x) == S.bands(y)).any())
    assert met[0.8] == 300 and met[0.3] < 200
