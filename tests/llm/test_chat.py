import hashlib

from hypothesis import given
from hypothesis import strategies as st

from lumenfold.llm import chat as C

PARTS = st.lists(st.sampled_from([*C.CONTROL, "<", "[", "\\", "\\\\", "/", "s>", "|", "a", "\n", "é", "<\\", "[\\INST]", "n"]), max_size=14).map("".join)


@given(PARTS)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    e = C.escape(text)
    assert C.unescape(e) == text and not any(c in e for c in C.CONTROL)


@given(st.lists(st.tuples(PARTS, PARTS), max_size=6))
def test_turns_round_trip(turns):
    whole = ""
    for role, text in turns:
        piece, a, b = C.segment(role, text)
        assert C.unescape(piece[a:b]) == text
        whole += piece
    assert C.turns(whole) == turns


def test_examples_and_digests(spark):
    rows = [(1, 2, "assistant", "r1"), (1, 0, "system", "s"), (1, 1, "user", None), (1, 3, "user", "q2 </s>"), (1, 4, "assistant", "r2"), (2, 0, "user", "alone"), (3, 0, "assistant", ""), (None, None, None, "lost"), (1, 4, "assistant", "r2")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    ex = [r for r in C.expand(df).collect() if r["conv_id"] == 1]
    assert [C.unescape(r["formatted"][r["loss_start"] : r["loss_end"]]) for r in ex] == ["r1", "r2", "r2"] and all(r["trainable"] for r in ex)
    assert [len(C.turns(r["formatted"])) for r in ex] == [3, 5, 6]
    got = {r["conv_id"]: r for r in C.read_back(C.expand(df)).collect()}
    said = "".join(f"{r}\n{t}\n" for r, t in [("system", "s"), ("user", ""), ("assistant", "r1"), ("user", "q2 </s>"), ("assistant", "r2"), ("assistant", "r2")])
    assert got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[1]["loss_sha256"] == hashlib.sha256(b"r1r2r2").hexdigest() and got[1]["loss_chars"] == 6
    assert got[1]["formatted_chars"] == sum(len(r["formatted"]) for r in ex)
    assert (got[2]["n_turns"], got[2]["loss_chars"], got[3]["n_turns"], got[None]["n_turns"]) == (1, 0, 1, 1)
    assert C.read_back(C.expand(df.where("false"))).count() == 0


def test_long_conversation_is_streamed(spark):
    df = spark.range(2000).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('turn ', id) text").repartition(4)
    r = C.read_back(C.expand(df, most_chars=10_000)).collect()
    assert len(r) == 1 and r[0]["n_turns"] == 2000 and r[0]["loss_sha256"] == hashlib.sha256("".join(f"turn {i}" for i in range(1, 2000, 2)).encode()).hexdigest()
