"""A small labelled corpus whose labels can be learned."""

import random

LEX = ["vargul", "snorbat", "kelmix"]


def make(n=400, seed=5):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeilmnorstu") for _ in range(r.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(20, 300))]
        toxic, poor = int(i % 5 == 0), int(i % 7 == 0)
        if toxic:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(LEX) + r.choice(["", ",", "a", "ina"])
        if poor:
            w = [x + r.choice(["###", "$$$"]) for x in w]
        docs.append((i, " ".join(w)))
        labels.append((i, 1 - poor, toxic))
    return docs, labels


def write(spark, folder, n=400):
    docs, labels = make(n)
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return dict(docs), {i: (q, t) for i, q, t in labels}
