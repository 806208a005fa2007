import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm import quality_rules as Q


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {g for g in grams if grams.count(g) > 1}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len({p for i, g in enumerate(grams) if g in twice for p in (i, i + 1, i + 2)})


def test_base_counts_against_brute_force(spark):
    texts = [None, "", "  ", "a", "a b", "a b c", "a b c a b c", "a a a a", "x\ny\nx\n\n \n", "a# b$\n|<>&*% c", "é 日本 é 日本 é 日本", "a\tb\x0bc\x0cd\re", "same\nsame\nsame \n same"]

    @given(st.lists(st.text(alphabet="ab \n#\té", max_size=40), max_size=12))
    @settings(max_examples=6, deadline=None)
    def check(more):
        rows = list(enumerate(texts + more))
        out = Q.base_counts(spark.createDataFrame(rows, "doc_id int, text string")).collect()
        for r in out:
            assert tuple(r[c] for c in Q.BASE) == brute(rows[r["doc_id"]][1]), rows[r["doc_id"]]

    check()


def test_order_by_rejection_per_cost_and_verdict_is_order_free(spark):
    rules = Q.default_rules()
    seen = {r.name: (i / 10, 1.0) for i, r in enumerate(rules)}
    assert [r.name for r in Q.ordered(rules, seen)] == [r.name for r in reversed(rules)]
    df = Q.base_counts(spark.createDataFrame([(1, "A!! " * 60), (2, "plain words here and there " * 20)], "doc_id int, text string"))
    for order in (rules, rules[::-1]):
        kept = {r["doc_id"]: r["rejected_by"] is None for r in Q.cascade(df, order).collect()}
        assert kept == {1: False, 2: True}


def test_only_jvm_expressions(spark):
    df = Q.apply_rules(spark.createDataFrame([(1, "a b c")], "doc_id int, text string"))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_user_columns_survive(spark):
    names = ["_w", "_l", "_g", "_lines", "_words", "_windows", "_lines_"]
    df = spark.createDataFrame([(1, "a b c a b c\nx", *names)], "doc_id int, text string, " + ", ".join(f"{n} string" for n in names))
    out = Q.apply_rules(df).first()
    assert [out[n] for n in names] == names and (out["n_words"], out["n_repeat_words"]) == (7, 6)
    assert out.__fields__ == [*df.columns, *Q.BASE, "base_failed", "rejected_by", "kept"]


def test_sample_is_of_the_whole_table(spark):
    df = spark.range(0, 200_000, 1, 4).selectExpr("if(id >= 150000, 'bad !!!!!!', 'some plain words') text")
    seen = Q.estimate(df, [Q.Rule("bangs", Q.F.col("text").contains("!"))], sample_rows=1000)
    assert 0.15 < seen["bangs"][0] < 0.35
    assert Q.estimate(spark.range(3000).selectExpr("'one copy' text"), [Q.Rule("all", Q.F.col("n_words") > 1)], sample_rows=50)["all"][0] == 1.0


def test_rules_are_measured_on_rows_that_reach_them(spark):
    """Short texts fail the base and shout; of those that pass, a quarter has brackets and none shouts."""
    long = "' {x}' || array_join(transform(sequence(1, 60), i -> concat('w', i, '-', id)), ' ')"
    df = spark.range(2000).selectExpr(f"case when id % 2 = 0 then 'short !' when id % 8 = 1 then {long.format(x='[ ')} else {long.format(x='')} end text")
    rules = [Q.Rule("shouts", Q.F.col("text").contains("!")), Q.Rule("brackets", Q.F.col("text").contains("["))]
    seen = Q.estimate(df, rules, sample_rows=800, before=Q.base_failed())
    assert seen["shouts"][0] == 0 and 0.15 < seen["brackets"][0] < 0.35 and all(s > 0 for _, s in seen.values())
    assert Q.ordered(rules, seen)[0].name == "brackets" and 0.4 < Q.estimate(df, rules, sample_rows=800)["shouts"][0] < 0.6
    none = Q.estimate(spark.range(50).selectExpr("'short !' text"), rules, sample_rows=50, before=Q.base_failed())
    assert [r for r, _ in none.values()] == [0.0, 0.0]


def test_odd_rows(odd_docs, no_docs):
    out = Q.apply_rules(odd_docs).collect()
    assert len(out) == 10 and not any(r["kept"] for r in out if r["doc_id"] in (1, 2, 3, 4))
    assert {r["n_words"] for r in out if r["doc_id"] in (1, 2, 3)} == {0}
    assert Q.apply_rules(no_docs).count() == 0


def test_a_filter_stays_above_the_counts(spark):
    df = Q.apply_rules(spark.createDataFrame([(1, "a b c " * 3000)], "doc_id int, text string")).where("kept or n_words > 5").select("doc_id")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array") == 1 and plan.index("Filter") < plan.index("sort_array")
    assert df.count() == 1
