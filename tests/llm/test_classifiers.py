import zlib

import numpy as np
import pytest

from lumenfold.llm import quality_model as Q
from lumenfold.llm import toxicity as X
from lumenfold.llm.features import Lexicon, WordTable, abuse_features, passage_starts, shape_features

from . import corpus


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    return folder, *corpus.write(spark, folder)


def held_out_accuracy(rows, labels, which, folds, fold):
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in labels if zlib.crc32(str(i).encode()) % folds == fold}
    return np.mean([r["predicted"] == labels[r["doc_id"]][which] for r in held])


def test_held_out_accuracy(spark, tables):
    folder, _, labels = tables
    assert held_out_accuracy(X.op9_toxicity(spark, folder).collect(), labels, 1, 4, 2) > 0.95
    assert held_out_accuracy(Q.op8_quality_classifier(spark, folder).collect(), labels, 0, 5, 0) > 0.97


def test_stages_reject_and_keep(spark, tables):
    folder, docs, labels = tables
    df = spark.read.parquet(f"{folder}/documents.parquet")
    clean = {r["doc_id"] for r in X.reject_toxic(spark, df, folder).collect()}
    assert np.mean([(i in clean) != bool(labels[i][1]) for i in docs]) > 0.95
    good = {r["doc_id"] for r in Q.keep_good(spark, df, folder).collect()}
    assert np.mean([(i in good) == bool(labels[i][0]) for i in docs]) > 0.97
    assert X.reject_toxic(spark, df, folder).columns == df.columns


def test_hidden_and_addressed_words_raise_the_score():
    docs, labels = corpus.make()
    model = X.fit([(t, labels[i][2]) for i, t in docs], {0: 320, 1: 80})
    plain = docs[1][1]
    scores = model.score(WordTable(model.lexicon), [plain, plain + " you vargul kelmix", plain + " v4rgul k3lmix snorb@t", ""])
    assert scores[1] > 0.5 > scores[0] and scores[2] > scores[0] and scores[3] <= 0.5


@pytest.mark.parametrize("module, index", [(X, 1), (Q, 0)])
def test_odd_rows_and_one_class(spark, odd_docs, no_docs, module, index):
    docs, labels = corpus.make(120)
    model = module.fit([(t, (labels[i][1], labels[i][2])[1 - index if module is Q else index]) for i, t in docs], {0: 60, 1: 60}) if module is X else module.fit([(t, labels[i][1]) for i, t in docs], {0: 18, 1: 102})
    out = X.score_documents(odd_docs, model).collect()
    assert len(out) == 10 and all(0 <= r["score"] <= 1 for r in out) and out[0]["n_words"] == 7
    assert X.score_documents(no_docs, model).count() == 0
    for label in (0, 1):
        one = module.fit([("a b", label)], {label: 1})
        assert abs(one.score(WordTable(), ["a b", ""])[0] - label) < 0.01
    assert len(module.fit([], {}).score(WordTable(), ["x"])) == 1


def test_isotonic_is_monotone_and_calibrated():
    rng = np.random.default_rng(0)
    s = rng.normal(size=2000)
    y = (rng.random(2000) < 1 / (1 + np.exp(-2 * s))).astype(float)
    xs, ys = X.isotonic(s, y, np.ones(2000))
    assert (np.diff(ys) >= -1e-12).all() and abs(np.interp(0.0, xs, ys) - 0.5) < 0.12


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    t = X.Trees(depth=3).fit(x, y, np.ones(2000))
    assert ((t.margin(x) > 0) == y).mean() > 0.95


def test_attention_gradients_against_differences():
    rng = np.random.default_rng(1)
    x, bags, y = rng.normal(size=(9, 16)), np.array([0, 2, 5, 9]), np.array([1.0, 0, 1])
    m = Q.fit([("a", 0), ("b c", 1)], {0: 1, 1: 1}, steps=1)
    w = np.array([1.0, 2, 1])

    def loss():
        z = m.forward(x, bags)["logit"]
        return (w * (np.log1p(np.exp(z)) - y * z)).sum() / w.sum()

    for k, g in Q._gradients(m, x, bags, y, w).items():
        at = tuple(rng.integers(0, n) for n in m.weights[k].shape)
        old = m.weights[k][at]
        m.weights[k][at] = old + 1e-5
        up = loss()
        m.weights[k][at] = old - 1e-5
        assert abs((up - loss()) / 2e-5 - g[at]) < 1e-5
        m.weights[k][at] = old


def test_features_do_not_depend_on_batching_or_forgetting():
    docs = [t for _, t in corpus.make(60)[0]] + ["", "  ", "ONE!!! two?"]
    lex = Lexicon({"vargul": 3.0}, {"snor": 2.0})
    whole = WordTable(lex)
    ids, starts, v = whole.look_up(docs)
    a, s = abuse_features(ids, starts, v), shape_features(ids, passage_starts(starts, 64)[0], v)
    small = WordTable(lex, most_words=20)
    parts = [small.look_up([d]) for d in docs]
    assert np.allclose(a, np.concatenate([abuse_features(*p) for p in parts]))
    assert np.allclose(s, np.concatenate([shape_features(i, passage_starts(st, 64)[0], w) for i, st, w in parts]))


def test_sample_holds_an_id_once_and_is_bounded_in_text(spark):
    from lumenfold.llm.common import labelled_sample

    F = Q.F
    docs = spark.range(100_000).selectExpr("1L doc_id", "concat('copy ', id) text").union(spark.createDataFrame([(2, "x" * 40), (3, None), (4, "y" * 40), (None, "z")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 0), (5, 1), (None, 1), (6, None), (2, 0)], "doc_id long, quality int")
    sample, totals = labelled_sample(docs, labels, "quality", F.lit(True), {0: 9, 1: 9})
    assert sample == [("copy 0", 0), ("x" * 40, 1), ("", 1), ("y" * 40, 0)] and totals == {0: 2, 1: 3}
    few, _ = labelled_sample(docs, labels, "quality", F.lit(True), {0: 9, 1: 9}, most_chars=50)
    assert 0 < sum(len(t) for t, _ in few) <= 50 and set(few) <= set(sample)


def test_an_overlong_text_leaves_the_others_in_the_sample(spark):
    from lumenfold.llm.common import labelled_sample

    docs = spark.createDataFrame([(i, "x" * (900 if i % 3 == 0 else 40 if i % 3 == 1 else 5)) for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    sample, totals = labelled_sample(docs, labels, "quality", Q.F.lit(True), {0: 15, 1: 15}, most_chars=640)
    # Longer than all that is asked for: set aside; longer than a sixty-fourth of it: after the short ones, until the next would pass.
    sizes = [len(t) for t, _ in sample]
    assert totals == {0: 15, 1: 15} and sizes.count(5) == 10 and sizes.count(900) == 0 and sizes.count(40) == 10
    few, _ = labelled_sample(docs, labels, "quality", Q.F.lit(True), {0: 15, 1: 15}, most_chars=330)
    assert sorted(len(t) for t, _ in few) == [5] * 10 + [40] * 7


def test_models_are_fitted_where_the_texts_are(spark, tmp_path, monkeypatch):
    """Models of the tables equal those of texts held in one place, of which none comes to the driver."""
    from lumenfold.llm import common, mixing
    from lumenfold.llm.common import labelled_sample

    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join([*rng.choice(words, 90), *(["scumbag", "you", "scumbag"] * (i % 4 == 1)), *(["$$$$", "####"] * 20 * (i % 3 == 0))])) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 4 == 1)) for i, _ in rows], "doc_id long, quality int, toxic int")
    every, texts = Q.F.lit(True), [t for _, t in rows]
    want = X.fit(*labelled_sample(docs, labels, "toxic", X.fold("doc_id", 4) != 2, X.SAMPLE))
    good = Q.fit(*labelled_sample(docs, labels, "quality", Q.fold("doc_id", 5) != 0, Q.SAMPLE))
    domains = mixing.fit_domains(*labelled_sample(docs, labels, mixing.DOMAIN_SQL, every, mixing.SAMPLE))
    monkeypatch.setattr(common, "labelled_sample", None)
    sent: list[str] = []
    collect = type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: sent.append(self.schema.simpleString()) or collect(self))
    got = X.fit_tables(docs, labels)
    assert got.lexicon.words == want.lexicon.words and "scumbag" in got.lexicon.words and got.lexicon.prefixes == want.lexicon.prefixes
    np.testing.assert_array_equal(got.score(WordTable(got.lexicon), texts), want.score(WordTable(want.lexicon), texts))
    np.testing.assert_array_equal(Q.fit_tables(docs, labels).score(WordTable(), texts), good.score(WordTable(), texts))
    found = mixing.fit_tables(docs, labels)
    np.testing.assert_array_equal(found.posteriors(WordTable(found.lexicon), texts)[1], domains.posteriors(WordTable(domains.lexicon), texts)[1])
    assert len(sent) == 3 and all("text" not in s for s in sent)


def test_gradients_of_chunks_are_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 9, 60)
    x, y = rng.normal(size=(sizes.sum(), 16)), (np.arange(60) % 2).astype(float)
    one = Q.fit_features(x, sizes, y, {0: 30, 1: 30}, steps=20)
    monkeypatch.setattr(Q, "CHUNK", 10)
    assert len(Q._chunks(sizes)) > 10
    many = Q.fit_features(x, sizes, y, {0: 30, 1: 30}, steps=20)
    for k, w in one.weights.items():
        np.testing.assert_allclose(many.weights[k], w, rtol=1e-6, atol=1e-9)
