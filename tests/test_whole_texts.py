"""Text queries take every document and all of its text."""

import pytest

from lumenfold.plans import q_text as Q


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    texts = {1: "a\n\nab\nxyz " + "w " * 300 + "\nb", 2: "\n".join(f"line {i} of it" for i in range(30)), 900: "late\nlater", 901: " ".join(f"w{i}" for i in range(487)), 902: "", 903: " ".join(f"v{i}" for i in range(61))}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path, texts


def test_consolidated_texts_against_brute_force(spark, folder):
    want = {}
    for d, text in folder[1].items():
        rows = [(i, t) for i, t in enumerate(text.split("\n")) if t.strip(" ")]
        held = []
        for _, t in rows:
            if not any(t in h or h in t for h in held):
                held.append(t)
        if rows:
            pages = sorted({i % 5 for i, _ in rows} | {i % 3 for i, _ in rows})
            want[d] = ("s", max((t[:20] for _, t in rows), key=len), max(held, key=len), len(rows), ",".join(map(str, pages)), len(rows))
    got = {r["doc_id"]: tuple(r)[1:] for r in Q.consolidated(spark, folder[0]).collect()}
    assert got == want


def test_overlap_merge_takes_whole_texts(spark, folder):
    got = {r["doc_id"]: r["n"] for r in Q.overlap_merge(spark, folder[0]).collect()}
    assert {d: got[d] for d in (900, 901, 902, 903)} == {d: len(" ".join(folder[1][d].split())) for d in (900, 901, 902, 903)}
