import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import fim as M

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "a ", " a", "a b ", "one\x85two three four", "<P>", "x <M> y", "<S <P M>", "é ü 😀\t日本 \u0001", "w " * 5000, "z" * 40_000, " " * 3000 + "end", "<\nS> <P\n>"]


def plain(doc_id, text, rate=50, spm_rate=80):
    t = text or ""
    units = UNIT.findall(t)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    x = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((x[0] % (len(units) + 1), x[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or x[2] % 100 >= rate:
        return len(units), "plain", None, None, t
    form = "spm" if x[3] % 100 < spm_rate else "psm"
    return len(units), form, len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1 << 16])
def test_cuts_by_chunks_against_the_pattern(chunk):
    r = random.Random(chunk)
    for text in [t or "" for t in ODD[:13]] + ["".join(r.choice("ab é\n\t😀") for _ in range(r.randint(0, 40))) for _ in range(200)]:
        units = UNIT.findall(text)
        a, b = r.randrange(100), r.randrange(100)
        low, high = sorted((a % (len(units) + 1), b % (len(units) + 1)))
        assert M.cuts(np.frombuffer(text.encode(), np.uint8), a, b, chunk) == (len(units), len("".join(units[:low])), len("".join(units[:high])))


def test_whole_operator_against_plain_python(spark):
    rows = [(i * 7 + k, t, "mine", k) for k in range(6) for i, t in enumerate(ODD)] + [(None, "a b c d e", "", 0), (5, "twice twice", "", 0), (5, "twice twice", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, FORM string, _text int").repartition(3)
    out = M.fill_in_middle(df, rate=90, spm_rate=50, chunk=512)
    assert sorted(out.columns) == sorted(["doc_id", "text", "_text", *M.OWN])
    got = out.withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(r["doc_id"], r["text"], 90, 50)
        assert r["back"] == (r["text"] or "")


def test_odd_rows_and_empty_table(spark, odd_docs, no_docs):
    got = M.fill_in_middle(odd_docs).collect()
    assert len(got) == odd_docs.count() and all((r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(r["doc_id"], r["text"]) for r in got)
    assert M.fill_in_middle(no_docs).count() == 0
