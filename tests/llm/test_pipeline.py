from pyspark.sql import functions as F

import corpus_pipeline as P
from lumenfold.llm import pieces, quality_model, toxicity
from lumenfold.llm.features import WordTable

from . import corpus


def test_stages_in_order_keep_columns_and_take_effect(spark, tmp_path):
    docs, labels = corpus.write(spark, str(tmp_path), 300)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    df = df.union(df.where("doc_id % 10 = 1").selectExpr("doc_id + 1000", "text", "lang", "source", "n_chars"))
    df.write.parquet(f"{tmp_path}/x/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/x/labels.parquet")
    out = P.run(spark, f"{tmp_path}/x").collect()
    ids = {r["doc_id"] for r in out}
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality", "near_duplicates", "mixing", "sentencepiece"]
    assert not any(i >= 1000 for i in ids) and all(r["round_trip"] for r in out)
    good = {i for i in docs if labels[i] == (1, 0)}
    assert len(ids & good) > 0.95 * len(good) and len(ids - good) < 0.05 * len(good)


def plain_components(texts):
    """Of each component of texts whose sets of five words have a Jaccard similarity of 0.8 or more, the least position."""
    words = [t.lower().split() for t in texts]
    sets = [frozenset(tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)) for w in words]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            same = sets[i] | sets[j]
            if not same or len(sets[i] & sets[j]) / len(same) >= 0.8:
                up = [min(up[i], up[j]) if x in (up[i], up[j]) else x for x in up]
    return up


def test_each_stage_on_its_own_input_against_plain_versions(spark, tmp_path):
    docs, _ = corpus.write(spark, str(tmp_path), 250)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    cut = df.where("doc_id % 9 = 1").selectExpr("doc_id + 1000 doc_id", "concat(text, ' one more') text", "lang", "source", "n_chars")
    df = df.union(cut).coalesce(2)
    stages, sf = dict(P.STAGES), str(tmp_path)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    toxic, good = toxicity.fit_tables(spark.read.parquet(f"{sf}/documents.parquet"), labels), quality_model.fit_tables(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    rows = [tuple(r) for r in df.collect()]
    text = df.columns.index("text")
    for name, model, keep in (("toxicity", toxic, lambda s: s < 0.3), ("quality", good, lambda s: s >= 0.3)):
        table = WordTable(getattr(model, "lexicon", None))
        want = sorted(r for r in rows if keep(model.score(table, [r[text]])[0]))
        assert sorted(map(tuple, stages[name](spark, df, sf).collect())) == want and 0 < len(want) < len(rows)
    order = sorted(rows)
    least = plain_components([r[text] for r in order])
    kept = [r for i, r in enumerate(order) if least[i] == i]
    assert sorted(map(tuple, stages["near_duplicates"](spark, df, sf).collect())) == kept and len(kept) < len(rows)
    vocab = pieces.load()
    for r in stages["sentencepiece"](spark, df, sf).collect():
        own = next(x for x in rows if x[0] == r["doc_id"])
        assert pieces.decode(vocab, r["ids"]) == own[text] and r["lang"] == own[df.columns.index("lang")]


def test_stages_on_odd_rows(spark, odd_docs, no_docs, tmp_path):
    corpus.write(spark, str(tmp_path), 200)
    clash = odd_docs.withColumn("ids", F.lit("mine")).withColumn("Score", F.lit(1)).withColumn("component_id", F.lit(2))
    given = [r["doc_id"] for r in clash.collect()]
    for name, stage in P.STAGES:
        out = stage(spark, clash, str(tmp_path))
        ids = [r["doc_id"] for r in out.collect()]
        assert set(ids) <= set(given), name
        assert name == "sentencepiece" or out.columns == clash.columns
        assert stage(spark, clash.where("false"), str(tmp_path)).count() == 0
    assert sorted(map(str, ids)) == sorted(map(str, given)) and len(out.columns) == len({c.lower() for c in out.columns})
