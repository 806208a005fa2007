import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm import token_output as O


@given(st.integers(1, 3000), st.integers())
@settings(max_examples=40, deadline=None)
def test_feistel_is_a_bijection(n, key):
    f = O.Feistel(n, key)
    s = f.slot(np.arange(n))
    assert sorted(s.tolist()) == list(range(n)) and (f.index(s) == np.arange(n)).all()


def test_feistel_on_a_large_domain():
    f = O.Feistel(O.IDS * O.PARTS - 12345, 1)
    x = np.arange(10_000) * 7_777_777
    assert (f.index(f.slot(x)) == x).all() and (f.slot(x) != O.Feistel(f.n, 2).slot(x)).any()


def test_pieces_of_a_long_text_are_the_whole():
    e = O.tokenizer()
    text = "  many   words\n\n and 12 spaces,  here's one. " * 50
    assert O.token_ids(e, text, piece=37).tolist() == [*e.encode_ordinary(text), O.END_ID]


def test_shards_round_trip_resume_and_odd_rows(spark, odd_docs, no_docs, tmp_path):
    m = O.write_shards(odd_docs, f"file://{tmp_path}/a", stride=64, shards=4)
    whole = sorted(O.read_shards(m, 64, chunk=100).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in whole] == list(range(len(whole)))
    assert O.read_shards(m, 64, from_slot=5, to_slot=99).count() == 94
    by = {}
    for r in sorted(whole, key=lambda r: (r["doc_id"], r["part"])):
        by.setdefault(r["doc_id"], []).append(r)
    e = O.tokenizer()
    long = next(r["text"] for r in odd_docs.collect() if r["doc_id"] == 5)
    assert [t for r in by[5] for t in r["tokens"]] == [*e.encode_ordinary(long), O.END_ID]
    assert by[1][0]["tokens"] == by[2][0]["tokens"] == [O.END_ID] and len(by[6]) == 2 and -1 in by
    again = O.write_shards(odd_docs.repartition(3), str(tmp_path / "b"), stride=64, shards=4)
    assert [r["digest"] for r in sorted(m.collect())] == [r["digest"] for r in sorted(again.collect())]
    assert O.write_shards(no_docs, str(tmp_path / "c")).count() == 0


def test_order_is_shuffled(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a b c") for i in range(2000)], "doc_id long, text string")
    ids = [r["doc_id"] for r in sorted(O.read_shards(O.write_shards(docs, str(tmp_path), shards=8)).collect(), key=lambda r: r["slot"])]
    assert sorted(ids) == list(range(2000)) and abs(np.corrcoef(ids, range(2000))[0, 1]) < 0.1


def test_slots_are_ranks_of_a_plain_permutation_and_read_apart(spark, tmp_path):
    docs = spark.createDataFrame([(7 * i, "some words " * (i % 50)) for i in range(300)], "doc_id long, text string").repartition(5)
    m = O.write_shards(docs, str(tmp_path), stride=32, shards=6, key=99)
    out = O.read_shards(m, 32)
    assert out.rdd.getNumPartitions() == 6
    sizes = sorted(n for n in out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())
    assert sizes == sorted(r["records"] for r in m.collect())
    n = (7 * 299 + 1) * O.PARTS
    half = -(-(n - 1).bit_length() // 2)
    order = O.Feistel(n, 99)
    keys = [int(k) for k in order.keys]
    low, word = (1 << half) - 1, (1 << 64) - 1

    def mix(x, key):
        x = (x ^ key) * 0x9E3779B97F4A7C15 & word
        x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & word
        return (x ^ (x >> 32)) & low

    def place(x):
        while True:
            left, right = x >> half, x & low
            for k in keys:
                left, right = right, left ^ mix(right, k)
            x = (left << half) | right
            if x < n:
                return x

    got = sorted((r["slot"], r["doc_id"], r["part"]) for r in out.collect())
    ranked = sorted(((d, p) for _, d, p in got), key=lambda x: place(x[0] * O.PARTS + x[1]))
    assert [(d, p) for _, d, p in got] == ranked


def test_rows_without_an_id_are_spread(spark, tmp_path):
    """A third of the rows lack an id, half of those are equal throughout, and some ids are shared."""
    rows = [(i, f"text {i} of many") for i in range(2000)] + [(None, f"no id {i}") for i in range(500)] + [(None, "the same")] * 500 + [(5, "other"), (5, "other"), (5, "another")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    m = O.write_shards(docs.repartition(3), str(tmp_path / "a"), stride=2, shards=4)
    sizes = [r["records"] for r in m.collect()]
    assert len(sizes) == 4 and max(sizes) < 1.1 * min(sizes)
    again = O.write_shards(docs.repartition(7), str(tmp_path / "b"), stride=2, shards=4)
    assert sorted(r["digest"] for r in m.collect()) == sorted(r["digest"] for r in again.collect())
    got = [(r["doc_id"], r["part"], tuple(r["tokens"])) for r in O.read_shards(m, 2).collect()]
    e = O.tokenizer()
    want = []
    for i, t in rows:
        ids = [*e.encode_ordinary(t), O.END_ID]
        want += [(-1 if i is None else i, k // 2, tuple(ids[k : k + 2])) for k in range(0, len(ids), 2)]
    assert sorted(got) == sorted(want)


def test_long_gaps_are_encoded():
    e = O.tokenizer()
    for text in (" " * 20_000 + "word", "a" + "\n" * 15_000, "x \u3000" + "\u3000" * 12_000 + " y"):
        ids = O.ordinary(e, text)
        assert e.decode(ids) == text and O.ordinary(e, text[-50:]) == e.encode_ordinary(text[-50:])
