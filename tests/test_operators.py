import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold.operators import audit as A
from lumenfold.operators import batches as B
from lumenfold.operators import distribution as D
from lumenfold.operators import joins as J
from lumenfold.operators import labels as L


def counted(spark, *ns):
    return spark.createDataFrame([("d", "s", f"k{i}", n) for i, n in enumerate(ns)], "dimension string, source string, key string, n long")


def test_concentration_by_hand(spark):
    r = D.concentration(counted(spark, 1, 1, 2)).first()
    assert (r["keys"], r["total"], r["hhi"], r["entropy"], r["top1_share"]) == (3, 4, 0.375, 1.5, 50.0)
    assert r["gini"] == pytest.approx(2 * (1 + 2 + 6) / 12 - 4 / 3)
    alone = D.concentration(counted(spark, 5)).first()
    assert (alone["entropy"], alone["normalized_entropy"], alone["gini"], alone["hhi"]) == (0.0, 0.0, 0.0, 1.0)


def test_every_bin_is_listed(spark):
    df = spark.createDataFrame([("a", 0), ("a", 7), ("b", 99)], "g string, n int")
    got = {(r["g"], r["bin"]): r["n"] for r in D.binned(df, F.col("n"), D.COUNT_BINS, ["g"]).collect()}
    assert len(got) == 12 and got["a", "0"] == got["a", "6-10"] == got["b", ">50"] == 1 and sum(got.values()) == 3


def test_empty_conventions(spark):
    from lumenfold.functions import measures as m

    none = spark.createDataFrame([], "x double")
    r = none.agg(*m.describe(F.col("x"), "a"), *m.describe(F.col("x"), "b", None), m.sample_stdev(F.col("x")).alias("s")).first()
    assert r["a_mean"] == 0.0 and r["b_mean"] is None and r["s"] is None
    assert spark.createDataFrame([(3.0,)], "x double").agg(m.sample_stdev(F.col("x"))).first()[0] == 0.0


@pytest.mark.parametrize("counts, size", [({"a": 10, "b": 30, "c": 1}, 12), ({"a": 5, "b": 5}, 3), ({"a": 2}, 9), ({}, 4), ({"a": 1, "b": 100}, 50)])
def test_allocation(counts, size):
    take = L.allocation(counts, size)
    assert sum(take.values()) == min(size, sum(counts.values())) and all(take[k] <= counts[k] for k in counts)


def test_lookup_violations(spark):
    f, d = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert J.enrich(f, d, "k", "skip").count() == 1
    assert {r["k"]: r["unmatched"] for r in J.enrich(f, d, "k", "quarantine").collect()} == {1: False, 2: True}
    with pytest.raises(Exception, match="no record in the dimension"):
        J.enrich(f, d, "k").collect()


def test_override_needs_leave(spark):
    r = spark.createDataFrame([("a", "old"), ("b", None)], "id string, f string")
    o = spark.createDataFrame([("b", "f", "new", False)], "id string, field string, value string, allow_replace boolean")
    assert {x["id"]: x["f"] for x in J.field_overrides(r, o, ["id"], ["f"]).collect()} == {"a": "old", "b": "new"}
    with pytest.raises(Exception, match="without leave"):
        J.field_overrides(r, o.withColumn("id", F.lit("a")), ["id"], ["f"]).collect()


@pytest.mark.parametrize("change, rule", [("rank = 3 where rank = 2", "rank"), ("target_id = 0 where rank = 2", "target_repeated"), ("target_id = 77 where rank = 1", "target_unknown"), ("relative_score = 2 where rank = 2", "score_rises"), ("relative_score = 0.1 where rank = 3", "below_threshold")])
def test_corruptions_are_named(spark, change, rule):
    good = spark.createDataFrame([(1, i + 1, i, 1.0 - i / 10) for i in range(3)], "source_id int, rank int, target_id int, relative_score double")
    targets = spark.range(5).withColumnRenamed("id", "target_id")
    assert A.matching_violations(good, targets, 0.68, 10).count() == 0
    name, _, rest = change.partition(" = ")
    value, _, where = rest.partition(" where ")
    bad = good.withColumn(name, F.when(F.expr(where), F.lit(float(value)).cast(dict(good.dtypes)[name])).otherwise(F.col(name)))
    assert rule in {r["rule"] for r in A.matching_violations(bad, targets, 0.68, 10).collect()}
    assert {r["rule"] for r in A.matching_violations(good, targets, 0.68, 2).collect()} == {"too_many"}


def test_bisection_splits_on_invalid_answers_only():
    sizes = []

    def call(items):
        sizes.append(len(items))
        if len(items) > 2:
            raise B.InvalidAnswer("mixed up")
        return items

    out, log = B.adaptive(call, list(range(5)))
    assert out == list(range(5)) and sizes == [5, 2, 3, 1, 2] and [n["parent_id"] for n in log] == [None, 0, 0, 2, 2]
    with pytest.raises(KeyError):
        B.adaptive(lambda items: {}["x"], [1, 2])
    with pytest.raises(B.QuotaError):
        B.adaptive(lambda items: (_ for _ in ()).throw(B.QuotaError()), [1, 2], split_on=(Exception,))


@pytest.mark.parametrize("mode, waits", [("exponential", [10, 20, 40]), ("linear", [10, 20, 30])])
def test_waits(mode, waits):
    slept = []
    with pytest.raises(TimeoutError):
        B.with_retry(lambda items: (_ for _ in ()).throw(TimeoutError()), [1], mode=mode, sleep=slept.append)
    assert slept == waits
    slept.clear()
    with pytest.raises(TimeoutError):
        B.with_retry(lambda items: (_ for _ in ()).throw(TimeoutError()), [1], attempts=2, sleep=slept.append, hint=lambda e: 3.0)
    assert slept == [3.0]


def test_resume_runs_only_what_is_missing(spark, tmp_path):
    batches = spark.createDataFrame([(f"b{i}", [f"m{i}"]) for i in range(4)], "batch_id string, members array<string>")
    path = str(tmp_path / "ck")

    def call(fail):
        def f(items):
            if items[0] in fail:
                raise ValueError("no")
            return [{"pair_id": i} for i in items]

        return lambda df: B.call_batches(df, f)

    assert B.run_resumable(batches, path, "r", call({"m1", "m2"})).count() == 2
    assert B.run_resumable(batches, path, "r", call({"m0", "m3", "m2"})).count() == 3
    assert B.run_resumable(batches, path, "r", call(set())).count() == 4
    with pytest.raises(ValueError, match="other settings"):
        B.run_resumable(batches, path, "other", call(set()))
    assert B.fingerprint(a=1, b="é") == B.fingerprint(b="é", a=1) != B.fingerprint(a=2, b="é")


def test_manifest_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    m = B.batch_manifest(B.pair_manifest(df, ["k"], 4), 64, "k")
    rows = m.orderBy("start_index").collect()
    assert [r["size"] for r in rows] == [64] * 15 + [40] and [x for r in rows for x in r["members"]] == [str(i) for i in range(1000)]


def test_preflight_and_sets(spark):
    df = spark.range(3)
    assert B.preflight({"low": (df, F.col("id") > 1), "fine": (df, F.col("id") > 5), "null": (spark.range(2), F.lit(None).cast("boolean")), "zero": (df, F.col("id") == 0), "empty": (df.limit(0), F.lit(True))}) == ["low", "zero"]
    assert B.preflight({}) == []
    seen, verdict = B.watched(df, {"low": F.col("id") > 1, "fine": F.col("id") > 5})
    assert seen.count() == 3 and verdict() == ["low"]
    assert J.same_set(df, spark.range(3), ["id"]) and not J.same_set(df, spark.range(4), ["id"])


def test_encoder_hook_and_forbidden_names(spark):
    import numpy as np

    from lumenfold.operators import encode as E

    df = spark.createDataFrame([(1, "ab"), (2, None)], "id int, t string")
    got = {r["id"]: list(r["embedding"]) for r in E.encode(df, "id", "t", lambda: lambda texts: np.array([[len(t), 0.0, len(t)] for t in texts])).collect()}
    assert got[2] == [0, 0, 0] and got[1] == pytest.approx([0.5**0.5, 0, 0.5**0.5])
    nested = spark.sql("select named_struct('a', array(named_struct('human_label', 1))) x, map('k', named_struct('b', 2)) m")
    assert E.forbidden_fields(nested, ["human_label", "b"]) == ["x.a.human_label", "m.b"]


def plain_keys(x):
    if isinstance(x, dict):
        return [k for key, v in x.items() for k in (key, *plain_keys(v))]
    return [k for v in x for k in plain_keys(v)] if isinstance(x, list) else []


JSON = st.recursive(st.none() | st.integers() | st.text(alphabet='ab":\\\\,{}\n\té ', max_size=6), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(alphabet='ab":\\\\ \u0001é', max_size=3), c, max_size=3), max_leaves=12)


@given(st.lists(st.tuples(JSON, st.booleans(), st.sampled_from([None, 1])), min_size=1, max_size=8))
@settings(max_examples=15, deadline=None)
def test_keys_of_json_against_a_plain_walk(spark, docs):
    from lumenfold.operators import encode as E

    df = spark.createDataFrame([(i, json.dumps(d, ensure_ascii=a, indent=n)) for i, (d, a, n) in enumerate(docs)], "i int, t string")
    rows = df.select("i", E.keys_of_json(F.col("t")).alias("k"), E.forbidden_keys(F.col("t"), ["a", '"', "b"]).alias("f")).collect()
    for r in rows:
        want = plain_keys(docs[r["i"]][0])
        assert r["k"] == want and r["f"] == sorted(k for k in want if k in ("a", '"', "b"))


def test_keys_of_deep_and_long_json(spark):
    from lumenfold.operators import encode as E

    deep, long = '{"a":[' * 20000 + "1" + "]}" * 20000, json.dumps({"a": '"b": \\' * 300000, "c": 1})
    rows = spark.createDataFrame([(deep,), (long,), (None,), ("",)], "t string").select(E.keys_of_json(F.col("t")).alias("k")).collect()
    assert [r["k"] and len(r["k"]) for r in rows] == [20000, 2, None, []] and rows[1]["k"] == ["a", "c"]


def test_attempts_have_budgets_of_their_own_and_usage_sums_up_the_tree(spark):
    tries = []

    def call(items):
        tries.append(len(items))
        if len(tries) == 1:
            raise TimeoutError("busy")
        return B.Reply(items, f"answer {len(tries)}", {"tokens": 10 * len(items), "other": None})

    def check(items, results):
        if len(tries) < 4:
            raise B.InvalidAnswer("wrong")

    log = []
    assert B.with_retry(call, [1, 2], sleep=lambda s: None, invalid_attempts=3, check=check, log=log) == [1, 2]
    assert [(a["attempt"], a["status"], a["usage"], a["waited"]) for a in log] == [(1, "transient", {}, 10.0), (2, "invalid", {"tokens": 20}, 10.0), (3, "invalid", {"tokens": 20}, 20.0), (4, "completed", {"tokens": 20}, 0.0)]
    assert len({a["prompt_sha256"] for a in log}) == 1 and [a["answer_sha256"] is None for a in log] == [True, False, False, False]
    tries.clear()
    with pytest.raises(B.InvalidAnswer):
        B.with_retry(call, [1], sleep=lambda s: None, invalid_attempts=2, check=check)
    assert len(tries) == 3

    def sized(items):
        if items[0] == "bad":
            raise KeyError("lost")
        return B.Reply(items, json.dumps(items), {"tokens": len(items)})

    def three(items, results):
        if len(items) > 3:
            raise B.InvalidAnswer("too many")

    batches = spark.createDataFrame([("x", [str(i) for i in range(11)]), ("y", ["bad"]), ("z", ["1"])], "batch_id string, members array<string>")
    out = B.call_batches(batches, sized, check=three, invalid_attempts=2, sleep=lambda s: None)
    tried = B.attempts(out).collect()
    below = lambda p, q: q == p or q.startswith(p + ".")
    want = {}
    for b, p in {(r["batch_id"], r["path"]) for r in tried}:
        under = [r for r in tried if r["batch_id"] == b and below(p, r["path"])]
        want[b, p] = (len(under), sum((r["usage"] or {}).get("tokens", 0) for r in under))
    got = {(r["batch_id"], r["path"]): (r["requests"], (r["usage"] or {}).get("tokens", 0)) for r in B.usage_tree(B.attempts(out)).collect()}
    assert got == want and got["x", "root"] == (2 * 3 + 4, 2 * 11 + 2 * 5 + 2 * 6 + 11) and got["y", "root"] == (1, 0)
    assert [r["status"] for r in tried if r["batch_id"] == "y"] == ["failed"]


def test_results_match_one_to_one(spark):
    from lumenfold.operators import requirements as R

    rec, res = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "YES"), (2, "NO")], "k int, verdict string")
    assert {r["k"]: r["llm_verdict"] for r in R.merge_results(rec, res, "k", ["verdict"]).collect()} == {1: "YES", 2: "NO"}
    for bad in (res.where("k = 1"), res.union(res.where("k = 1")), res.unionByName(spark.createDataFrame([(9, "NO")], "k int, verdict string"))):
        with pytest.raises(Exception, match="one to one"):
            R.merge_results(rec, bad, "k", ["verdict"]).collect()


def test_rationales_are_joined_over_their_overlaps(spark):
    from lumenfold.operators import requirements as R

    words = [f"word{i}" for i in range(60)]
    a, b = " ".join(words[:40]), " ".join(words[20:])
    rows = spark.createDataFrame([("x", b, 2, [3, 2], 0.5), ("x", a, 1, [2, 1], 1.0), ("x", " ".join(words[5:15]), 3, [9], 0.0)], "id string, text string, block_id int, source_pages array<int>, confidence double")
    r = R.consolidate_rationales(rows).first()
    assert r["text"] == " ".join(words) and r["source_pages"] == [1, 2, 3, 9] and r["mean_confidence"] == 0.5 and r["occurrences"] == 3


def test_range_join_against_all_pairs(spark):
    import random

    from lumenfold.operators import joins as J

    r = random.Random(2)
    points = [(r.choice("ab"), r.randint(-300, 300)) for _ in range(300)] + [("a", 7)] * 40 + [("a", None), (None, 7)]
    ranges = [(r.choice("ab"), n, x, x + r.choice((-1, 0, 1, 5, 63, 64, 1000))) for n in range(80) for x in [r.randint(-400, 300)]] + [("a", 90, None, 5), ("a", 91, 5, None), ("b", 92, -(10**12), 10**12)]
    p, q = spark.createDataFrame(points, "k string, at long"), spark.createDataFrame(ranges, "k string, n int, first long, last long")
    want = sorted((k, at, n) for k, at in points for j, n, x, y in ranges if k is not None and k == j and None not in (at, x, y) and x <= at <= y)
    for hot in (10, 100_000):
        got = J.range_join(p, q, ["k"], "at", "first", "last", hot)
        assert got.columns == ["k", "at", "n", "first", "last"]
        assert sorted((x["k"], x["at"], x["n"]) for x in got.collect()) == want
    assert J.range_join(p, q.where("false"), ["k"], "at", "first", "last").count() == 0
    assert J.range_join(p.where("false"), q, ["k"], "at", "first", "last").count() == 0


def test_allocation_as_one_by_one():
    import random
    import time

    from lumenfold.operators.labels import allocation

    def plain(counts, size):
        take = {s: min(n, round(size * n / sum(counts.values()))) for s, n in counts.items()}
        while sum(take.values()) < size:
            take[max(sorted(counts, key=str), key=lambda s: counts[s] - take[s])] += 1
        while sum(take.values()) > size:
            take[max(sorted(counts, key=str), key=lambda s: take[s])] -= 1
        return take

    r = random.Random(3)
    for _ in range(200):
        counts = {f"s{i}": r.randint(1, 20) for i in range(r.randint(1, 12))}
        size = r.randint(0, sum(counts.values()) - 1)
        assert allocation(counts, size) == plain(counts, size)
    began = time.time()
    assert sum(allocation({i: 1 + i % 3 for i in range(10_000)}, 4_321).values()) == 4_321 and time.time() - began < 1


def test_malformed_results_are_named(spark):
    from lumenfold.operators import batches as B

    good = {n: "YES" for n in B.RESPONSE_TEXTS} | {"confidence": 3}
    bad = [{**good, "caveat": 5}, {k: v for k, v in good.items() if k != "directness"}, {**good, "confidence": True}, {**good, "confidence": "3"}, {**good, "justification": None}, good, 7]
    df = spark.createDataFrame([(1, json.dumps(bad)), (2, "no list"), (3, None)], "batch_id int, answer string")
    got = B.parse_responses(df).collect()
    assert [r["malformed"] for r in got if r["batch_id"] == 1] == [["caveat"], ["directness"], ["confidence"], ["confidence"], ["justification"], [], [*B.RESPONSE_TEXTS, "confidence"]]
    assert [r["malformed"] for r in got if r["batch_id"] > 1] == [None, None]


def test_containment_against_all_pairs(spark):
    import random

    from lumenfold.operators import consolidate as C

    r = random.Random(6)
    texts = ["".join(r.choice("ab -é") for _ in range(r.randint(1, 9))) for _ in range(250)] + [" ".join(r.choice(["the", "cat", "sat", "on", "x"]) for _ in range(r.randint(1, 9))) for _ in range(250)] + ["😀", "a😀b", "", None]
    rows = [(r.choice(["k", "l", None]), t) for t in texts] * 2
    df = spark.createDataFrame(rows, "k string, t string").repartition(3)
    own = {(k, t) for k, t in rows if t}
    want = {(k, t, o) for k, t in own for j, o in own if k == j and len(o) > len(t) and t in o}
    got = [tuple(x) for x in C.contained_in(df, "k", "t").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    left = [tuple(x) for x in C.uncontained(df, "k", "t").collect()]
    assert sorted(left, key=repr) == sorted({(k, t) for k, t in own if not any(x[:2] == (k, t) for x in want)}, key=repr)
    assert C.uncontained(df.where("false"), "k", "t").count() == 0


def test_containment_within_one_hot_key(spark):
    """20,000 texts of one key, as many parts of them: the parts go, and no array of the key is made."""
    from lumenfold.operators import consolidate as C

    whole = spark.range(20_000).select(F.concat_ws(" ", F.lit("all have this"), F.hash("id"), F.lit("and that"), F.xxhash64("id"), F.lit("too")).alias("t"))
    df = whole.union(whole.select(F.expr("substring(t, 5, length(t) - 8)"))).withColumn("k", F.lit(1))
    out = C.uncontained(df, "k", "t")
    assert "collect_list" not in out._jdf.queryExecution().toString()
    assert sorted(r["t"] for r in out.collect()) == sorted(r["t"] for r in whole.collect())
