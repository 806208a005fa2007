"""The registered queries: against their SQL, and the others against plain Python over whole tables."""

import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import chat as C
from lumenfold.llm import mixing as M
from lumenfold.llm import pieces as P
from lumenfold.llm import quality_model as Q
from lumenfold.llm import registry
from lumenfold.llm import token_output as O
from lumenfold.llm import toxicity as X
from lumenfold.llm.features import WordTable, abuse_features

SF = "/root/testdata/sf0.001"


def rows_of(df):
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def sql_rows(name, columns, **tables):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        duck.sql(f"create view {t} as select * from '{tables.get(t, f'{SF}/{t}.parquet')}'")
    cursor = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    return sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert rows_of(df) == sql_rows(name, sorted(df.columns))


def test_chat_against_sql_on_odd_turns(spark, tmp_path):
    rows = [(1, None, "user", "no turn"), (1, 0, "as\\sist\nant", "x"), (1, 1, "</s>", "[INST] \\[INST]"), (1, 1, "assistant", "r" * 100_000), (2, 0, None, None), (3, 5, "assistant", ""), (3, 5, "assistant", "é <\\s>"), (3, None, "assistant", "<|end|>")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit("mine")).write.parquet(f"{tmp_path}/conversations.parquet")
    df = C.op10_chat_formatting(spark, str(tmp_path))
    assert rows_of(df) == sql_rows("op10_chat_formatting", sorted(df.columns), conversations=f"{tmp_path}/conversations.parquet/*.parquet")


def test_html_query_on_whole_table(spark):
    """The given pages hold their text in one article element; the plain version takes its blocks from the source text."""
    from html import unescape

    source = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in registry.QUERIES["op2_html_extraction"](spark, SF).collect()}
    assert got.keys() == source.keys()
    for i, r in got.items():
        article = re.search(r"<article>(.*?)</article>", source[i]["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1|h2|ul|li|table|tr|td|blockquote|pre|div)\b[^>]*>", re.sub(r"<!--.*?-->", "", article, flags=re.S))
        text = [" ".join(unescape(re.sub(r"<br\b[^>]*>", " ", x) if "<br" in x else x).split()) for x in parts]
        want = "\n".join(t for t in (" ".join(re.sub(r"<[a-zA-Z/][^>]*>", "", t).split()) for t in text) if t)
        assert (r["text"], r["n_chars"], r["url"]) == (want, len(want), source[i]["url"])


def test_token_query_holds_every_document(spark):
    encoding = O.tokenizer()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = registry.QUERIES["op3_token_output"](spark, SF)
    got = sorted((r["slot"], r["doc_id"], r["part"], r["n_tokens"]) for r in out.collect())
    assert [r[0] for r in got] == list(range(len(got)))
    want = sorted((d, p, min(256, n - 256 * p)) for d, t in texts.items() for n in [len(encoding.encode_ordinary(t)) + 1] for p in range(-(-n // 256)))
    assert sorted(r[1:] for r in got) == want


def test_mixing_query_meets_its_targets(spark):
    rows = registry.QUERIES["op4_mixing"](spark, SF).toPandas()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(rows.doc_id) == set(texts) and (rows.rate >= 0).all() and all(n == len(texts[d].split()) for d, n in zip(rows.doc_id, rows.tokens, strict=True))
    whole = rows.tokens.sum()
    for d, share in M.TARGETS.items():
        assert abs((rows.rate * rows.tokens * rows[f"p_{d}"]).sum() / whole - share) < 1e-3


def test_pieces_query_round_trips(spark):
    vocab = P.load()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in registry.QUERIES["op6_sentencepiece"](spark, SF).collect():
        assert r["round_trip"] and (r["n_pieces"] > 0) == bool(texts[r["doc_id"]]) and r["nbest_scores"][0] == r["score"] and r["nbest_scores"] == sorted(r["nbest_scores"], reverse=True)
    for d in sorted(texts)[:20]:
        ids, score, _ = P.Encoder(vocab).encode(texts[d])
        # A plain Viterbi over the whole text, without chunks.
        text = " " + texts[d] if texts[d] else ""
        best = [0.0] + [P.LOW] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(max(0, j - vocab.longest), j):
                k, w = vocab.edges.get(text[i:j], (-1, 0.0))
                if k >= 0 or (j == i + 1 and not P._single(vocab, text[i])):
                    best[j] = max(best[j], best[i] + (w if k >= 0 else vocab.unknown))
        assert score == best[-1] and P.decode(vocab, ids) == texts[d]


def auc(labels, scores):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    s = np.asarray(scores)[order]
    ranks[order] = [(np.searchsorted(s, x, "left") + np.searchsorted(s, x, "right") + 1) / 2 for x in s]
    y = np.asarray(labels)
    return (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize("name, label, folds, fold", [("op8_quality_classifier", "quality", 5, 0), ("op9_toxicity", "toxic", 4, 2)])
def test_held_out_accuracy_on_the_given_tables(spark, name, label, folds, fold):
    sf = "/root/testdata/sf0.1"
    known = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = registry.QUERIES[name](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(known[r["doc_id"]], r["score"], r["predicted"]) for r in rows if r["held_out"] and known.get(r["doc_id"]) is not None]
    print(name, len(held), auc([h[0] for h in held], [h[1] for h in held]), [sum(1 for h in held if (h[0], h[2]) == k) for k in ((1, 1), (0, 1), (1, 0), (0, 0))])
    assert auc([h[0] for h in held], [h[1] for h in held]) > 0.97 and np.mean([h[0] == h[2] for h in held]) > 0.95


def test_attention_score_against_plain_loops():
    from . import corpus

    docs, labels = corpus.make(120)
    model = Q.fit([(t, labels[i][0]) for i, t in docs], {0: 18, 1: 102})
    texts = [docs[0][1], "", docs[7][1] + " " + docs[8][1], "one"]
    x, bags = Q.bag_features(WordTable(), texts)
    w = {k: v.tolist() for k, v in model.weights.items()}
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    column = lambda m, k: [r[k] for r in m]
    for i, score in enumerate(model.score(WordTable(), texts)):
        codes, marks = [], []
        for row in ((x[bags[i] : bags[i + 1]] - model.mean) / model.spread).tolist():
            h = [math.tanh(dot(row, column(w["encode"], k)) + w["encode_bias"][k]) for k in range(len(w["encode_bias"]))]
            gated = [math.tanh(dot(h, column(w["value"], k))) / (1 + math.exp(-dot(h, column(w["gate"], k)))) for k in range(len(w["attend"]))]
            codes.append(h)
            marks.append(dot(gated, w["attend"]))
        e = [math.exp(m) for m in marks]
        z = [sum(a * h[k] for a, h in zip(e, codes, strict=True)) / sum(e) for k in range(len(codes[0]))]
        assert abs(score - 1 / (1 + math.exp(-dot(z, w["score"]) - w["score_bias"][0]))) < 1e-9


def test_tree_score_against_plain_walks_and_isotonic_formula():
    from . import corpus

    docs, labels = corpus.make(300)
    model = X.fit([(t, labels[i][1]) for i, t in docs], {0: 240, 1: 60})
    table = WordTable(model.lexicon)
    texts = [t for _, t in docs[:40]] + [""]
    features = abuse_features(*table.look_up(texts))
    for row, score in zip(features.tolist(), model.score(table, texts), strict=True):
        margin = model.trees.base
        for feature, cut, value in model.trees.nodes:
            node = 0
            while node < len(feature):
                passed = sum(edge < row[feature[node]] for edge in model.trees.edges[feature[node]])
                node = 2 * node + 1 + (passed > cut[node])
            margin += value[node - len(feature)]
        xs, ys = model.knots
        k = int(np.searchsorted(xs, margin))
        plain = ys[0] if k == 0 else ys[-1] if k == len(xs) else ys[k - 1] + (ys[k] - ys[k - 1]) * ((margin - xs[k - 1]) / (xs[k] - xs[k - 1]) if xs[k] > xs[k - 1] else 1.0)
        assert abs(score - min(max(plain, 0), 1)) < 1e-9
    rng = np.random.default_rng(2)
    s, y, w = np.arange(60.0), rng.random(60) + np.arange(60) / 60, rng.random(60) + 0.1
    xs, ys = X.isotonic(s, y, w)
    mean = lambda a, b: (y[a:b] * w[a:b]).sum() / w[a:b].sum()
    want = [max(min(mean(a, b) for b in range(i + 1, 61)) for a in range(i + 1)) for i in range(60)]
    assert np.allclose(np.interp(s, xs, ys), want)
