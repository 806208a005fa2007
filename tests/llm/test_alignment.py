import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import alignment as A

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pair():
    return A.load()


def reference_ids(texts):
    """Both libraries as their own files are meant to be used."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A.A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=A.B_FILE)
    return [(a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) for t in texts]


def plain(docs, pair):
    """{row: counts and groups} by the tokens that hold each byte of a document."""
    seen, count = [], Counter()
    for text, (a, b) in zip(docs, reference_ids([t or "" for t in docs]), strict=True):
        raw = (" " + (text or "")).encode()
        if not text or b"".join(pair.a_bytes[k] for k in a) != raw or b"".join(pair.b_bytes[k] for k in b) != raw:
            a, b = [], []
        spans = []
        for ids, table in ((a, pair.a_bytes), (b, pair.b_bytes)):
            at, own = 0, []
            for k in ids:
                own.append((at, at + len(table[k])))
                at = own[-1][1]
            spans.append(own)
        held = [[k for k, (s, e) in enumerate(own) for _ in range(s, e)] for own in spans]
        linked = [(a[i], b[j]) for i, j in dict.fromkeys(zip(*held, strict=True))]
        count.update(linked)
        shared = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        groups, own = [], [[], []]
        for (_, end), side, k in sorted([(x, 0, k) for x, k in zip(spans[0], a, strict=True)] + [(x, 1, k) for x, k in zip(spans[1], b, strict=True)], key=lambda x: (x[0][1], x[1])):
            own[side].append(str(k))
            if side and end in shared:
                groups.append("|".join(",".join(x) for x in own))
                own = [[], []]
        seen.append((len(a), len(b), len(groups), linked, ";".join(groups)))
    highest = defaultdict(int)
    for (_, k), n in count.items():
        highest[k] = max(highest[k], n)
    return [(n_a, n_b, n_g, len(ls), sum(count[x] == highest[x[1]] for x in ls), sum(count[x] for x in ls), g) for n_a, n_b, n_g, ls, g in seen], count


ODD = [None, "", " ", "  two  gaps ", "naïve café 日本語 😀", "mark ▁ here", "<s> </s> <|endoftext|> plain", "repeat repeat", "repeat repeat", "a\tb\n\nc\r\n", "\n" * 40 + "x", "word " * 400, "ünï" * 300, "don't we'll 12345678901234567890"]


@pytest.mark.parametrize("most_pairs", [1 << 20, 40, 0])
def test_align_against_all_ranges(spark, pair, most_pairs):
    df = spark.createDataFrame([(i, t, -1.0, "mine") for i, t in enumerate(ODD)], "doc_id long, text string, n_best double, GROUPS string").repartition(3)
    got = sorted(A.align(df, pair, most_pairs=most_pairs).collect(), key=lambda r: r["doc_id"])
    want, _ = plain(ODD, pair)
    assert [tuple(r[c] for c in (*A.COUNTS, "groups")) for r in got] == want
    assert got[5]["n_a"] == 0 and got[3]["n_a"] > 0


def test_pair_counts_and_links(spark, pair):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string").repartition(2)
    _, count = plain(ODD, pair)
    table = A.tokens(df, pair)
    held = A.pair_counts(table, pair, most_held=64).collect()
    assert {(r["pair"] >> 32, r["pair"] & 0xFFFFFFFF): r["n"] for r in held} == dict(count)
    top = {}
    for (_, b), n in count.items():
        top[b] = max(n, top.get(b, 0))
    assert all(r["best"] == (r["n"] == top[r["pair"] & 0xFFFFFFFF]) for r in held)
    links = Counter((r["a_id"], r["b_id"]) for r in A.links(table, pair).collect())
    assert links == count


def test_products_of_groups(spark, pair):
    texts = ["unbelievably antidisestablishmentarianism", "日本語のテキスト", "one two"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    table = A.tokens(df, pair)
    got = Counter((r["a_id"], r["b_id"]) for r in A.links(table, pair, products=True, most_rows=3).collect())
    want = Counter()
    for _, _, _, _, _, _, groups in plain(texts, pair)[0]:
        for g in groups.split(";"):
            a, b = (x.split(",") for x in g.split("|"))
            want.update((int(i), int(j)) for i in a for j in b)
    assert got == want


def test_encoder_equals_the_vocabulary_files(pair):
    """The ranks' encoder gives the JSON file's ids: white space too long for its pattern search, and one character of each 37 of Unicode in several places."""
    texts = [" " * 30_000 + "a", "x" + "\n" * 25_000, " " * 12_000 + " " * 12_000 + "b  c", "y" * 40_000]
    texts += ["".join(f"a{chr(c)}{chr(c)}b 1{chr(c)}2  {chr(c)} .{chr(c)}\n" for c in range(i, min(i + 37 * 200, 0x110000), 37) if not 0xD800 <= c < 0xE000) for i in range(0, 0x110000, 37 * 200)]
    for text, (a, _), (want, _) in zip(texts, [(A.ordinary(pair.encoders()[0], " " + t), None) for t in texts], reference_ids(texts), strict=True):
        assert a == want, text[:20]


def test_odd_rows_and_empty_table(spark, odd_docs, no_docs, pair):
    rows = A.align(odd_docs, pair).collect()
    assert len(rows) == odd_docs.count() and {r["n_a"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert "fingerprint" in rows[0].asDict() and "text" not in rows[0].asDict()
    empty = A.align(no_docs, pair)
    assert empty.count() == 0 and empty.columns == A.align(odd_docs, pair).columns


def test_query_over_whole_table(spark, pair):
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(source)
    want, _ = plain([source[i] for i in ids], pair)
    got = {r["doc_id"]: r for r in A.op11_alignment(spark, SF).collect()}
    assert sorted(got) == ids
    for i, w in zip(ids, want, strict=True):
        assert (*[got[i][c] for c in A.COUNTS], got[i]["groups_sha256"]) == (*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[0] else "")


def test_union_of_sorted_is_union1d():
    r = np.random.default_rng(1)
    for n, m in ((0, 0), (0, 3), (5, 0), (400, 300)):
        a, b = np.unique(r.integers(0, 900, n)), np.unique(r.integers(0, 900, m))
        assert (A.union_of_sorted(a, b) == np.union1d(a, b)).all()
