import time
import difflib
import hashlib
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions import hierarchy as H
from lumenfold.functions import markdown as M
from lumenfold.functions import text as X
from lumenfold.operators import consolidate as C
from lumenfold.sources import documents as D
from lumenfold.sources import sinks as K


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("sr1.1 re2", "SR 1.1 RE 2"), ("SR 3.10", "SR 3.10"), (" sr  2 . 4 (RE 1)", "SR 2.4 RE 1"), ("SR-1.2", "SR 1.2"), ("XR 1.1", None), ("SR 1", None), (None, None), ("SR 1.1 RE", None)])
def test_canonical_id(spark, raw, want):
    assert one(spark, H.canonical_id(F.col("t")), t=raw) == want


def test_numeric_order_of_ids(spark):
    ids = ["SR 1.10", "SR 1.2", "SR 1.2 RE 1", "bad", "SR 1.2 RE 10", "SR 1.2 RE 9", "SR 0.9"]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    assert [r["id"] for r in df.orderBy(*H.sort_key(F.col("id"))).collect()] == ["SR 0.9", "SR 1.2", "SR 1.2 RE 1", "SR 1.2 RE 9", "SR 1.2 RE 10", "SR 1.10", "bad"]


def test_unicode_white_space(spark):
    assert one(spark, X.collapse(F.col("t"), True), t=" a  b\tc­d　") == "a b cd"
    assert one(spark, X.word_count(F.col("t")), t="  ") == 0


@pytest.mark.parametrize("gap, sampler, auditor", [(None, "no_gap", None), (-0.1, "unknown", "very_low_gap"), (0.0, "very_low_gap", "very_low_gap"), (0.05, "low_gap", "low_gap"), (0.10, "medium_gap", "medium_gap"), (0.20, "high_gap", "high_gap"), (1.5, "unknown", "high_gap")])
def test_gap_bins(spark, gap, sampler, auditor):
    r = spark.createDataFrame([(gap,)], "g double").select(X.gap_bin(F.col("g")), X.audit_gap_bin(F.col("g"))).first()
    assert tuple(r) == (sampler, auditor)


def test_embedding_text(spark):
    built = X.embedding_text(F.col("a"), F.col("b"), {"Problematic code": F.col("c"), "Correct code": F.col("d")}, F.col("e"))
    assert one(spark, built, a="DL1", b="Title", c="x\n", d=None, e="") == "DL1\n\nTitle\n\nProblematic code:\nx"
    assert one(spark, built, a=None, b=None, c=None, d="", e=None) == ""


@given(st.lists(st.text(alphabet="ab ", max_size=6), max_size=6))
@settings(max_examples=15, deadline=None)
def test_merge_texts_against_a_plain_fold(spark, texts):
    held = []
    for t in texts:
        if t and not any(t in h or h in t for h in held):
            held.append(t)
    want = max(held, key=len) if held else None
    assert one(spark, C.merge_texts(F.col("t")), t=texts) == want
    distinct = sorted(set(t for t in texts if t), key=lambda t: (-len(t), t))
    assert one(spark, C.drop_contained(F.col("t")), t=texts) == [t for t in distinct if not any(len(o) > len(t) and t in o for o in distinct)]


def test_later_longer_text_is_passed_over(spark):
    assert one(spark, C.merge_texts(F.col("t")), t=["short text", "short text and more"]) == "short text"


def test_overlap_merge():
    a = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    b = " ".join(a.split()[2:]) + " eighteen"
    assert X.merge_overlapping([a, b]) == a + " eighteen"
    assert X.merge_overlapping(["a b c", "b c d"]) == "a b c b c d"


def test_similarity_is_the_library_ratio(spark):
    a, b = "the quick brown fox", "the quack brown box"
    assert one(spark, X.similarity_ratio(F.col("a"), F.col("b")), a=a, b=b) == difflib.SequenceMatcher(None, a, b).ratio()


def test_pair_id_is_the_digest_of_canonical_json(spark):
    values = {"source": "é\"\\", "target_id": None, "source_id": "x y"}
    got = one(spark, X.pair_id(**{k: F.col(k) for k in values}), **values)
    assert got == "pair-v1:" + hashlib.sha256(json.dumps(values, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def test_unknown_source_name_stops(spark):
    names = {"dl": "alpha", "sc": "beta"}
    assert one(spark, X.full_source_name(F.col("t"), names), t=" DL ") == "alpha"
    with pytest.raises(Exception, match="unknown source"):
        one(spark, X.full_source_name(F.col("t"), names), t="zz")


DOC = "# `Rule` *title*\r\n\r\n## Problematic code:\r\n\r\n```sh\r\n# not a heading\r\n```\r\n\r\nand `prose`\r\n\r\nCorrect code\r\n------------\r\n\r\n~~~~\r\nx\r\n~~~\r\n~~~~\r\n\r\n## Rationale\r\n\r\nWhy.\r\n\r\n### Detail\r\n\r\nMore.\r\n\r\n## Rationale (again)\r\n\r\nStill.\r\n"


def test_markdown_sections():
    p = M.parse(DOC)
    assert (p.title, p.title_level) == ("Rule title", 1) and p.error is None
    assert p.sections == {"problematic_code": "# not a heading\n\nand `prose`", "correct_code": "x\n~~~", "rationale": "Rationale\nWhy.\n\n### Detail\n\nMore.\n\nRationale (again)\nStill."}
    assert p.diagnostics == [] and p.occurrences == {"problematic_code": 1, "correct_code": 1, "rationale": 2} and p.qualified["rationale"] == 1
    assert p.fences == 2 and p.languages == ["sh"]


@pytest.mark.parametrize("text, title", [("# A\n# B\n## C", "several_titles"), ("## Example code\n### Rationale\nText.", "no_title"), ("# Examples\n## Real", "Real"), ("### Low\n#### Lower", "Low"), ("#### Lower\n### Low", "Low"), ("Setext\n===", "Setext"), ("no heading", "no_title"),
                                         ("# Tail #", "Tail"), ("# A &amp; B", "A & B"), (None, "no_title"), ("# Semantic `title`\n\nText only.", "Semantic title"), ("## Rationale\nx\n# Late", "no_title"), ("# Quote foo_bar_baz to 2*3*4", "Quote foo_bar_baz to 2*3*4"),
                                         ("# a _b_ *c* __d__ **e** ~~f~~ \\* <i>g</i> ![h](i) [j](k) [l][m]", "a b c d e f * g h j [l][m]"), ("# Correct usage of quotes\n## Correct code\nx", "Correct usage of quotes"), ("    indented\n---\n# T", "T"), ("#\n# T", "T")])
def test_titles(text, title):
    p = M.parse(text)
    assert (p.title or p.code) == title
    assert M.parse(text, untitled=True).code in (None, "several_titles")


def test_sections_under_their_headings():
    p = M.parse("## Title\n\n### Problematic code #1\none\n\n### Problematic code #2\ntwo\n\n### Correct code (first)\nalpha\n\n### Correct code: (second)\nbeta\n")
    assert p.sections == {"problematic_code": "Problematic code #1\none\n\nProblematic code #2\ntwo", "correct_code": "Correct code (first)\nalpha\n\nCorrect code: (second)\nbeta"}
    assert p.occurrences["problematic_code"] == 2 and p.qualified["correct_code"] == 2
    p = M.parse("## Title\n\n### Correct code\nBefore.\n\n````bash\n  echo one  \n```\n````\n\n~~~sh\nprintf two\n~~~\n\nAfter.\n")
    assert p.sections["correct_code"] == "Before.\n\n  echo one  \n```\n\nprintf two\n\nAfter." and p.languages == ["bash", "sh"]
    assert M.parse("## T\r\n\r\n### Rationale\r\nLine.  \r\n").sections["rationale"] == "Line.  "
    assert M.parse("## T\n\n### Rationale\nBecause.\n\n### Related resources\nLink.\n").sections == {"rationale": "Because."}
    p = M.parse("# T\n## Rationale\n\n## Exceptions:\n")
    assert sorted((d[0], d[1], d[2]) for d in p.diagnostics if d[0] == "empty_semantic_section") == [("empty_semantic_section", "exceptions", 3 + 1), ("empty_semantic_section", "rationale", 2)]
    assert M.parse("# T\n``` a`b\nx\n```").code == "ambiguous_fence"


def test_headings_in_the_jvm_and_in_python_agree(spark):
    forms = ["Problematic code", "**Correct** `Code`:", "Rationale - why", "Exceptions (rare)", "exception", "Related [rules](x)", "problematic_code", "Correctness", "Correct usage of quotes", "bad code", "snake_case_name", "2*3*4", "Correct code #2", "correct-code"]
    df = spark.createDataFrame([(f,) for f in forms], "x string").select("x", X.visible_heading(F.col("x")).alias("shown")).withColumn("c", X.heading_category(F.col("shown")))
    for r in df.collect():
        assert r["shown"] == M.visible(r["x"]) and (r["c"]["category"], r["c"]["qualified"]) == M.category(r["x"]), r


def test_unreadable_documents_are_quarantined_and_gated(spark):
    df = spark.createDataFrame([("a", "# T\n```\nx"), ("b", "# T\n\n## Rationale\nr\n```sh\ny\n```"), ("c", "text"), ("d", "# A\n# B")], "id string, markdown string")
    found = M.extract(df, untitled=F.col("id") == "c")
    assert sorted(r["id"] for r in found.rules.collect()) == ["b", "c"] and found.diagnostics.count() == 5
    assert {r["id"]: r["code"] for r in found.quarantine.collect()} == {"a": "unmatched_fence", "d": "several_titles"}
    got = {(r["measure"], r["name"]): r["n"] for r in M.corpus_rollup(found).collect()}
    assert got["rules", "total"] == 2 and got["fence_language", "sh"] == 1 and got["warnings", "missing_semantic_field"] == 5 and got["failures", "unmatched_fence"] == 1 and got["field_coverage", "rationale"] == 1
    with pytest.raises(ValueError, match="several_titles.*never closed"):
        M.gate(found.quarantine)
    M.gate(found.quarantine.where("false"))
    kept, told = M.first_of_ids(spark.createDataFrame([("a", "2"), ("a", "1"), ("b", "3")], "id string, path string"))
    assert sorted((r["id"], r["path"]) for r in kept.collect()) == [("a", "1"), ("b", "3")] and [r["code"] for r in told.collect()] == ["duplicate_normalized_id"]


def test_curations_fill_what_they_may(spark):
    rules = spark.createDataFrame([("a", None, "p"), ("b", "B", None)], "id string, title string, problematic_code string")
    cur = spark.createDataFrame([("a", "title", "A", False), ("b", "title", "C", True), ("b", "correct_code", "x", False), ("z", "title", "Z", False), ("a", "problematic_code", "q", False)], "id string, field string, value string, allow_replace_non_null boolean")
    out, told = M.apply_curations(rules, cur)
    assert {r["id"]: r["title"] for r in out.collect()} == {"a": "A", "b": "C"}
    assert sorted((r["id"], r["code"]) for r in told.collect()) == [("a", "replaces_non_null"), ("b", "unused_source_curation"), ("z", "unused_source_curation")]


def test_curations_and_resolutions(spark):
    docs = spark.createDataFrame([("a", "l1\nl2 quoted\nl3")], "id string, markdown string")
    sha = hashlib.sha256(b"v").hexdigest()
    cur = spark.createDataFrame([("a", 2, 2, "quoted", "v", sha), ("a", 1, 1, "quoted", "v", sha), ("a", 2, 2, "quoted", "v", "0"), ("z", 1, 1, "q", "v", sha)], "id string, start_line int, end_line int, exact_text string, value string, value_sha256 string")
    assert sorted(r["valid"] for r in M.verify_curations(cur, docs, ["id"]).collect()) == [False, False, False, True]
    rules = spark.createDataFrame([("a", "t", None, "")], "id string, x string, y string, z string")
    rev = spark.createDataFrame([("a", "y", "A"), ("a", "x", "B"), ("q", "x", "A")], "id string, field string, classification string")
    assert {(r["id"], r["field"]): r["state"] for r in M.field_resolution(rules, rev, ["id"], ["x", "y", "z"]).collect()} == {("a", "x"): "stale", ("a", "y"): "reviewed_A", ("a", "z"): "unreviewed", ("q", "x"): "stale"}
    held = M.publication_problems(M.field_resolution(rules, rev, ["id"], ["x", "y", "z"]))
    assert sorted(r["code"] for r in held.collect()) == ["stale", "stale", "unreviewed"]


RECORD = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType())])


def test_json_scans_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", "é"), (0, "z", None)], "ord int, id string, title string")
    K.write_json_object(rows, f"{tmp_path}/o.json", "id", "ord")
    assert [tuple(r) for r in D.json_object(spark, f"{tmp_path}/o.json", RECORD).orderBy("ord").collect()] == [(0, "z", None), (1, "b", "é")]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        K.write_json_object(rows, f"{tmp_path}/o.json", "id", "ord")
    (tmp_path / "bad.json").write_text('{"a": {"id": "b"}}')
    with pytest.raises(Exception, match="key and id differ"):
        D.json_object(spark, f"{tmp_path}/bad.json", RECORD).collect()
    (tmp_path / "list.json").write_text('{"metadata": {}, "requirements": [{"id": "x", "title": "t"}, {"id": "a"}]}')
    assert [r["id"] for r in D.json_list(spark, f"{tmp_path}/list.json", RECORD).orderBy("ord").collect()] == ["x", "a"]
    with pytest.raises(Exception, match="a list of requirements"):
        D.json_object(spark, f"{tmp_path}/list.json", RECORD).collect()


def folder_bytes(path):
    return b"".join(p.read_bytes() for p in sorted(path.glob("part-*")))


def test_object_sink_writes_the_object_in_parts(spark, tmp_path):
    n = 3000
    rows = spark.range(n).repartition(7).select(F.concat(F.lit('k"\\é'), F.col("id")).alias("id"), (n - F.col("id")).alias("ord"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("line\n},\n"), "id")).alias("title"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # parts of small data
    try:
        K.write_json_object(rows, f"{tmp_path}/o", "id", "ord")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [(i, {"id": f'k"\\é{i}', "title": f"line\n}},\n{i}" if i % 3 else None}) for i in range(n - 1, -1, -1)]
    text = "{" + ",\n".join(json.dumps(r["id"], ensure_ascii=False) + ":" + json.dumps(r, ensure_ascii=False, separators=(",", ":")) for _, r in want) + "}\n"
    assert len(list((tmp_path / "o").glob("part-*"))) > 1 and folder_bytes(tmp_path / "o").decode() == text
    back = D.json_object(spark, f"{tmp_path}/o", RECORD).orderBy("ord").collect()
    assert [(r["ord"], r["id"], r["title"]) for r in back] == [(at, r["id"], r["title"]) for at, (_, r) in enumerate(want)]
    before = folder_bytes(tmp_path / "o")
    for bad in (rows.unionAll(rows.limit(1)), rows.select(F.when(F.col("ord") > 5, F.col("id")).alias("id"), "ord", "title")):
        with pytest.raises(ValueError, match="null or repeated"):
            K.write_json_object(bad, f"{tmp_path}/p", "id", "ord")
    broken = rows.withColumn("title", F.when(F.col("ord") == 7, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("title")))
    with pytest.raises(Exception, match="lost"):
        K.write_json_object(broken, f"{tmp_path}/p", "id", "ord")
    assert not (tmp_path / "p" / "_SUCCESS").exists() and not list(tmp_path.glob("p/part-*")) and folder_bytes(tmp_path / "o") == before
    K.write_json_object(rows.limit(0), f"{tmp_path}/none", "id", "ord")
    assert folder_bytes(tmp_path / "none") == b"{}\n" and D.json_object(spark, f"{tmp_path}/none", RECORD).count() == 0


@pytest.mark.parametrize("indent, end", [(2, "\n"), (4, "\n"), ("\t", "\n"), (1, "\r\n"), (None, "\n"), ("lines", "\n")])
def test_object_scan_cuts_one_file_at_record_borders(spark, tmp_path, indent, end):
    record = T.StructType([*RECORD.fields, T.StructField("x", T.ArrayType(T.StructType([T.StructField("y", T.LongType())])))])
    rows = {f"id{i}": {"id": f"id{i}", "title": f"}},\n  }},\n\"{i}é" * (i % 5), "x": [{"y": i}, {"y": -i}] * (i % 3)} for i in range(2000)}
    if indent == "lines":
        text = "{" + ",\n".join(json.dumps(k) + ": " + json.dumps(v) for k, v in rows.items()) + "}"
    else:
        text = json.dumps(rows, ensure_ascii=False, indent=indent)
    (tmp_path / "o.json").write_bytes(text.replace("\n", end).encode())
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        cut = D.split_records(spark, f"{tmp_path}/o.json", record)
        assert (cut is None) == (indent is None)
        got = D.json_object(spark, f"{tmp_path}/o.json", record)
        if cut is not None:
            assert spark.read.text(f"{tmp_path}/o.json").rdd.getNumPartitions() > 3
        assert [(r["ord"], r["id"], r["title"], [y["y"] for y in r["x"]]) for r in got.orderBy("ord").collect()] == [(at, k, v["title"], [y["y"] for y in v["x"]]) for at, (k, v) in enumerate(rows.items())]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_object_scan_of_other_layouts(spark, tmp_path):
    one = {"a": {"id": "a", "title": "x"}}
    for name, text in {"one": json.dumps(one, indent=2), "mixed": '{\n  "a": {"id": "a"}, "b": {\n    "id": "b"\n  },\n  "c": {"id": "c"}\n}', "none": "{}"}.items():
        (tmp_path / name).write_text(text)
        assert [(r["ord"], r["id"]) for r in D.json_object(spark, f"{tmp_path}/{name}", RECORD).orderBy("ord").collect()] == list(enumerate(json.loads(text)))
    (tmp_path / "list").write_text(json.dumps({"metadata": {}, "requirements": [{"id": "x"}]}, indent=2))
    with pytest.raises(Exception, match="a list of requirements"):
        D.json_object(spark, f"{tmp_path}/list", RECORD).collect()
    (tmp_path / "bad").write_text(json.dumps({"a": {"id": "a"}, "b": {"id": "c"}}, indent=2))
    with pytest.raises(Exception, match="key and id differ"):
        D.json_object(spark, f"{tmp_path}/bad", RECORD).collect()


def test_vector_cache_is_what_its_sidecar_says(spark, tmp_path):
    v = spark.range(300).select(F.concat(F.lit("v"), "id").alias("name"), (300 - F.col("id")).alias("at"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("e"))
    told = K.write_vector_cache(v, f"{tmp_path}/c", "name", "e", "at", model="m")
    assert (told["rows"], told["facts"]["dimension"], told["facts"]["dtype"]) == (300, 2, "float")
    got = D.vector_cache(spark, f"{tmp_path}/c", model="m", dimension=2, ordered_ids_sha256=told["facts"]["ordered_ids_sha256"]).orderBy("ord").collect()
    assert [r["id"] for r in got] == [f"v{i}" for i in range(299, -1, -1)] and list(got[0]["vector"]) == [299.0, 1.0]
    with pytest.raises(ValueError, match="differ in dimension, model, revision"):
        D.vector_cache(spark, f"{tmp_path}/c", model="n", dimension=3, revision="r")
    K.write_table(spark.read.parquet(f"{tmp_path}/c").withColumn("id", F.when(F.col("ord") == 5, "other").otherwise(F.col("id"))), f"{tmp_path}/d")
    (tmp_path / "d.json").write_text((tmp_path / "c.json").read_text())
    with pytest.raises(ValueError, match="differ in content_digest, ordered_ids_sha256"):
        D.vector_cache(spark, f"{tmp_path}/d")
    K.write_table(spark.read.parquet(f"{tmp_path}/c").where("ord > 5"), f"{tmp_path}/f")
    (tmp_path / "f.json").write_text((tmp_path / "c.json").read_text())
    with pytest.raises(ValueError, match="content_digest, ordered_ids_sha256, rows"):
        D.vector_cache(spark, f"{tmp_path}/f")


def test_csv_xml_text_and_binary_scans(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes("id;text\n1;h\xe9 €\n".encode("windows-1252"))
    assert D.csv_windows(spark, f"{tmp_path}/c.csv", "id int, text string").first()["text"] == "hé €"
    (tmp_path / "w.xml").write_text('<?xml version="1.0"?><c xmlns="urn:x"><Weakness ID="7"><Description>d</Description></Weakness></c>')
    assert tuple(D.xml_rows(spark, f"{tmp_path}/w.xml", "Weakness", "_ID int, Description string").first()) == (7, "d")
    for n in ("DL1.md", "sub/SC2.md", "x.txt"):
        (tmp_path / "d" / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "d" / n).write_text(n)
    assert sorted(r["name"] for r in D.text_files(spark, f"{tmp_path}/d", r"^(DL|SC)\d+\.md$").collect()) == ["DL1.md", "SC2.md"]
    (tmp_path / "p.bin").write_bytes(b"one\x0ctwo  2\x0cthree")
    pages = D.decoded_pages(spark, f"{tmp_path}/p.bin", lambda b: iter(b.decode().split("\x0c")))
    assert [r["preview"] for r in D.previews(D.page_range(pages, 2, 3), 4).orderBy("page_number").collect()] == ["two ", "thre"]


def test_display_csv_union_sidecar_and_report(spark, tmp_path):
    a, b = spark.createDataFrame([(1, 0.5, ["x", "y"])], "a int, s double, l array<string>"), spark.createDataFrame([(2, "t")], "a int, z string")
    u = K.union_all(a, b)
    assert K.display(u).where("a = 1").first()["s"] == "0.500000" and u.columns == ["a", "s", "l", "z"]
    K.write_csv(u, f"{tmp_path}/csv")
    K.write_table(u, f"{tmp_path}/t")
    with pytest.raises(Exception, match="already exists"):
        K.write_table(u, f"{tmp_path}/t")
    assert K.sidecar(u, f"{tmp_path}/s.json", threshold=0.68)["rows"] == 2 == json.loads((tmp_path / "s.json").read_text())["rows"]
    assert "| 0.500000 |" in K.markdown_report("r", {"u": u})
    assert [r["value"] for r in K.canonical_json(b).collect()] == ['{"a":2,"z":"t"}']


def test_aliases(spark):
    df = spark.createDataFrame([(None, "2.5"), ("x", "3")], "score string, cosine string")
    assert [r[0] for r in df.select(D.first_of("missing", "score", "cosine", kind="double")(df).alias("v")).collect()] == [2.5, 3.0]
    assert df.select(D.first_of("nope")(df)).first()[0] is None


def test_overlap_is_the_longest_and_ignores_case():
    import random

    r = random.Random(4)
    for _ in range(400):
        a, b = ([r.choice("xy") for _ in range(r.randint(0, 12))] for _ in range(2))
        plain = next((k for k in range(min(len(a), len(b)), 0, -1) if a[-k:] == b[:k]), 0)
        assert X.overlap(a, b) == plain
    long = "The control system shall provide the capability to identify and authenticate all human users at"
    assert X.merge_overlapping([long, long.upper()[4:] + " all interfaces"]) == long + " all interfaces"
    assert X.merge_overlapping(["Short", "a text that has SHORT in it"]) == "a text that has SHORT in it"
    assert X.merge_overlapping(["A text  that has short in it", "Short", None, ""]) == "A text that has short in it"
    began = time.time()
    words = [str(i % 97) for i in range(60_000)]
    assert X.merge_overlapping([" ".join(words), " ".join(words[30_000:] + ["end"])]).endswith(" end") and time.time() - began < 5


def test_rules_by_given_pairs(spark):
    wiki = {
        "# DL3001\nText here": "Text here",
        "see also: http://a.b/c then": "then",
        "Keep [name](http://x) and ![pic](y)": "Keep name and !pic",
        "```sh\nx\n```### Correct code:\na_b *c* `d` ~e > f - g | h": "ab c d e f g h",
        "Read more https://x.y": "",
    }
    for given, want in wiki.items():
        assert one(spark, X.wiki_plain(F.col("t")), t=given) == want
    for given, want in {"It shall.": "warning", "shall it": "pass", "it SHALL": "pass", "a\nshall\tb": "pass", "shallow": "warning", "  ": "fail", "": "fail"}.items():
        assert one(spark, X.modal_status(F.col("t")), t=given) == want
    for given, want in {"connection reset": "transient", "connection lost": "api", "model not found": "configuration", "not found": "api", "permission denied": "authentication", "permission": "api", "429 timeout": "quota", "Forbidden": "api", "HTTP 403": "authentication", "unsupported": "api"}.items():
        assert one(spark, X.error_class(F.col("t")), t=given) == want


def test_marks_and_sections_of_odd_documents(spark):
    from lumenfold.functions import markdown as M

    docs = spark.createDataFrame([(1, None), (2, ""), (3, "```\nopen"), (4, "## Rationale"), (5, "# T\r\n## Rationale\r\na\r\n### x\r\nb\r\n## Exceptions\r\n## Rationale: more\r\nc")], "id int, markdown string")
    found = M.marks(docs)
    kinds = {}
    for r in found.collect():
        kinds.setdefault(r["id"], []).append(r["kind"])
    assert kinds[1] == kinds[2] == ["end"] and kinds[3] == ["unreadable"] and sorted(kinds[4]) == ["end", "heading"]
    got = sorted((r["id"], r["line"], r["category"], r["qualified"], r["body"], r["fences"]) for r in M.sections(found, docs, ["id"]).collect())
    assert got == [(4, 1, "rationale", False, None, 0), (5, 2, "rationale", False, "a\n### x\nb", 0), (5, 6, "exceptions", False, None, 0), (5, 7, "rationale", True, "c", 0)]
    assert M.marks(docs.where("false")).count() == 0


def test_markdown_of_one_split_is_scanned_by_many_tasks_and_once(spark):
    """A small file is one split, whose documents one task would scan; the rollup read every document once for each of its measures."""
    docs = spark.createDataFrame([(i, f"# T{i}\n## Rationale\nr\n```\nx\n```\n### Deep\n```\ny\n```\n## Exceptions\ne") for i in range(64)], "id long, markdown string").coalesce(1)
    found = M.extract(docs)
    assert all(df.select(F.spark_partition_id()).distinct().count() > 1 for df in (M.marks(docs), found.rules))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "PythonUDTF" not in plan(M.marks(docs)) and plan(found.quarantine).count("MapInArrow") == 1
    once = M.extract(docs, once=True)
    assert "MapInArrow" not in plan(M.corpus_rollup(once)) and M.corpus_rollup(once).collect() and sorted(M.corpus_rollup(once).collect()) == sorted(M.corpus_rollup(found).collect())
    s = M.sections(M.marks(docs), docs, ["id"])
    assert plan(s).count("MapInArrow") == 1 and {(r["category"], r["first_line"], r["last_line"], r["fences"]) for r in s.collect()} == {("rationale", 3, 10, 2), ("exceptions", 12, 12, 0)}


def test_merging_keeps_up_with_long_texts_and_is_the_fold_of_merge_two(monkeypatch):
    """merge_overlapping against merge_two one by one; a text of 6,000 words took as many steps as the square of its parts, each over all that was held."""
    rng = random.Random(8)
    for n in range(1500):
        words = rng.choice([["a", "B", "aa", "b"], ["Σ", "ΑΣ", "σας", "İ", "ß"], ["one", "two", "three", "four", "five", "six", "seven"]])
        text = [rng.choice(words) for _ in range(rng.randrange(40))]
        cuts = [(rng.randrange(40), rng.randrange(1, 16)) for _ in range(rng.randrange(9))]
        parts = [rng.choice(["", " ", None, None])] * (n % 5 == 0) + [" ".join(text[a : a + k]) + rng.choice(["", "  ", "a"]) for a, k in cuts]
        least, held = rng.choice([1, 5, 80]), ""
        for p in parts:
            held = X.merge_two(held, " ".join((p or "").split()), least)
        assert X.merge_overlapping(parts, least) == held, parts
    words, looked, low = [f"w{i}" for i in range(6000)], [], X._Held.low
    monkeypatch.setattr(X._Held, "low", lambda self: looked.append(self.size) or low(self))
    assert X.merge_overlapping([" ".join(words[i : i + 60]) for i in range(0, 5970, 30)]) == " ".join(words) and sum(looked) < 1000
