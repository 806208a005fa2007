import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import pii as X

SF = "/root/testdata/sf0.001"
#: The base patterns as the contract words them.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base(text):
    def ok(kind, v):
        digits = re.sub(r"[^0-9]", "", v)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in v.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]

    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if ok(k, m[0])]


def texts_of(spans):
    return [":".join(map(str, s)) for s in spans]


ODD = ["a@b.c@d.e.f x@bc@d.e", "a@b.c_x@d.e", "1.2.3.4.5.6.7.8 01.002.3.255 1.2.3.256 1.2.3", "+1 (743) 555-3824, +12 +1234567. +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6", "4111 1111 1111 1111 x 4111-1111-1111-1112 555-3296 4111111111111111", "é😀 mail@exämple.org 日本 q@w.e-f", "", "é" * 50 + " 9.9.9.9"]


def fuzz(n):
    r = random.Random(7)
    return ["".join(r.choice("ab.@_-+ 0129() 5é") for _ in range(r.randint(0, 120))) for _ in range(n)]


def test_base_spans_against_plain_patterns(spark):
    texts = [*ODD, *fuzz(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = X.find_personal(df, keep_text=True).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base(r["text"])
        assert list(r["base_spans"]) == texts_of(want), r["text"]
        assert [r[f"n_{k}"] for k in X.BASE_KINDS] == [sum(s[0] == k for s in want) for k in X.BASE_KINDS]
        assert set(r["base_spans"]) <= set(r["spans"])


def test_prefixes_over_blocks(spark):
    for n in (1, 5, 6, 23, 1200):
        row = spark.range(1).select(X.prefixes(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long")), block=5).alias("s")).first()
        assert row["s"] == [k * (k + 1) // 2 for k in range(1, n + 1)]


def test_long_runs_take_linear_time_and_no_stack(spark):
    n = 30_000
    texts = ["_" * n, "token=" * n, "AKIA_" * n, "a@" + "b" * n + ".c", "x" * n, "a@" + "b." * n + "c", "1" * n, "1." * n, "4 " * n, "+" + "1 " * n, "a@b.c " * 5_000, "token=" + "a" * n, ("Anna " * n)[: 2 * n]]
    began = time.time()
    got = {r["doc_id"]: r for r in X.find_personal(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert time.time() - began < 120
    assert got[5]["n_email"] == 1 and got[7]["n_ip"] == n // 4 and got[10]["n_email"] == 5_000 and got[10]["base_spans"][-1] == f"email:{6 * 4_999}:{6 * 4_999 + 5}"


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choice("aeinrstlo") for _ in range(r.randint(2, 9)))
    key = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    docs = []
    for i in range(400):
        w = [word() for _ in range(40)]
        kind, item = [("secret", f"password={key(18)}"), ("secret", "AKIA" + "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16))), ("name", f"Dr. Anna {word().title()}"), ("email", f"{word()}@{word()}.com"), ("ip", f"{r.randint(1, 220)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}"), ("phone", f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"), ("none", f"order {r.randint(10**15, 10**16 - 1)}"), ("none", "4.1.2")][i % 8]
        if kind == "none" and len(item) > 10 and luhn(item[6:]):
            item = item[:-1] + str((int(item[-1]) + 1) % 10)
        at = r.randrange(40)
        start = sum(len(x) + 1 for x in w[:at])
        docs.append((i, " ".join([*w[:at], item, *w[at:]]), kind, start, start + len(item)))
    return docs


def test_what_the_method_adds(spark):
    docs = corpus()
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: list(r["spans"]) for r in X.find_personal(df).collect()}
    for i, text, kind, start, end in docs:
        if kind == "none":
            assert got[i] == [], text
        else:
            assert got[i] == [f"{kind}:{end - 18 if text[start:].startswith('password') else start}:{end}"], text


def plain_reliabilities(rows, rounds):
    q = [{True: 0.9, False: 0.1}[s > 0] if (s := sum(v) + 5 * v[0]) else 0.5 for _, v, _ in rows]
    for _ in range(rounds):
        prior, chance = {}, {}
        for k in X.KINDS:
            own = [(v, n, p) for (kind, v, n), p in zip(rows, q, strict=True) if kind == k]
            yes, total = sum(n * p for _, n, p in own), sum(n for _, n, _ in own)
            prior[k] = (yes + 5) / (total + 10)
            for j in range(5):
                for x, (a, b) in X.ASSUMED.items():
                    y = sum(n * p for v, n, p in own if v[j] == x)
                    both = sum(n for v, n, _ in own if v[j] == x)
                    chance[k, j, x] = ((y + a) / (yes + 10), (both - y + b) / (total - yes + 10))
        q = [1 / (1 + math.exp(-math.log(prior[k] / (1 - prior[k])) - sum(math.log(chance[k, j, v[j]][0] / chance[k, j, v[j]][1]) for j in range(5)))) for k, v, _ in rows]
    return prior, chance, q


def test_reliabilities_and_classifier_against_plain_python(spark):
    r = random.Random(11)
    rows = [(r.choice(X.KINDS[:4]), [r.choice((-1, 0, 1)) for _ in range(5)], r.randint(1, 50)) for _ in range(60)]
    looks = [[int(k == kind) for k in X.KINDS] + [r.randint(0, 1) for _ in range(X.N_FEATURES - 6)] for kind, _, _ in rows]
    df = spark.createDataFrame([(k, v, f, n) for (k, v, n), f in zip(rows, looks, strict=True)], "kind string, votes array<int>, features array<int>, n long").coalesce(1)
    model = X.estimated(df, rounds=3)
    prior, chance, q = plain_reliabilities(rows, 3)
    assert all(abs(model.prior[k] - prior[k]) < 1e-9 for k in prior)
    assert all(abs(model.chance[c][i] - chance[c][i]) < 1e-9 for c in chance for i in (0, 1))
    w = X.classifier(df, model, rounds=25)
    p = [1 / (1 + math.exp(-sum(a * b for a, b in zip(w, f, strict=True)))) for f in looks]
    slope = [sum(n * f[i] * (y - z) for (_, _, n), f, y, z in zip(rows, looks, q, p, strict=True)) - w[i] for i in range(X.N_FEATURES)]
    assert max(map(abs, slope)) < 1e-6  # the ridge problem's only optimum


def test_odd_rows_and_empty_table(spark, odd_docs, no_docs):
    df = odd_docs.withColumn("N_EMAIL", F.lit("mine"))
    rows = X.find_personal(df).collect()
    assert len(rows) == df.count() and "fingerprint" in rows[0].asDict() and all(r["n_email"] == 0 for r in rows)
    assert X.find_personal(no_docs).count() == 0


def test_query_over_whole_table(spark):
    source = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    df = X.op12_pii(spark, SF)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    got = {r["doc_id"]: r for r in df.collect()}
    assert got.keys() == source.keys()
    for i, r in got.items():
        want = base(source[i])
        assert r["base_sha256"] == hashlib.sha256(",".join(texts_of(want)).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in X.BASE_KINDS] == [sum(s[0] == k for s in want) for k in X.BASE_KINDS]
        order = [(X.KINDS.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        assert order == sorted(order) and set(texts_of(want)) <= set(r["spans"].split(","))
