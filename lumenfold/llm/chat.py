"""Chat formatting by prefix-target expansion: one example for each assistant turn.

An example is every preceding turn as context, then the assistant's reply, which alone is under
the loss mask. What follows the last reply (or a conversation without replies) is kept as one
more record that trains nothing.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import read

#: The template's own marks, then control strings of common chat formats.
TURN, END = "<|turn|>", "<|end|>"
CONTROL = [TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<unk>", "<pad>"]

_REST = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_REST})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_REST})")


def escape(text: str) -> str:
    """No control string is left in the text: each gets one more backslash after its first character than it had."""
    return _ESCAPE.sub(r"\1\\\2", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text) if "\\" in text else text


def segment(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and end of its text in it)."""
    head = TURN + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs that a formatted example was made of."""
    out = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part[len(TURN) :].partition("\n")
        out.append((re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role)), unescape(text)))
    return out


SCHEMA = "conv_id long, example int, formatted string, loss_start long, loss_end long, trainable boolean"
NAMES = ["conv_id", "example", "formatted", "loss_start", "loss_end", "trainable"]


def expand(conversations: DataFrame, most_chars: int = 1 << 22) -> DataFrame:
    """Examples (SCHEMA) of every conversation, a conversation's examples together and in order.

    Rows are ordered by turn, then role and text; null turns come first, null roles and texts are
    empty, rows without a conv_id form one conversation of their own. Repeated rows are turns like
    any other. Conversations are dealt by id and streamed in order: a task holds one formatted
    prefix and about most_chars of output, never a list of conversations. Other columns of the
    input are left out, whatever their names. An empty table gives no examples.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        conv, prefix, example, told, begun = None, "", 0, True, False
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal held, size
            done, held, size = held, [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=NAMES)

        for batch in batches:
            for conv_id, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if not begun or conv_id != conv:
                    if begun and not told:
                        held.append((conv, example, prefix, 0, 0, False))
                        size += len(prefix)
                    conv, prefix, example, begun = conv_id, "", 0, True
                piece, a, b = segment(role, text)
                at = len(prefix)
                prefix += piece
                told = role == "assistant"
                if told:
                    held.append((conv, example, prefix, at + a, at + b, True))
                    size += len(prefix)
                    example += 1
                if size > most_chars:
                    yield flush()
        if begun and not told:
            held.append((conv, example, prefix, 0, 0, False))
        if held:
            yield flush()

    return rows.mapInArrow(run, SCHEMA)


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, from its formatted examples alone (which lie together and in order)."""

    def row(conv, last, loss, chars, total):
        found = turns(last)
        digest = hashlib.sha256()
        for role, text in found:
            digest.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        return conv, len(found), digest.hexdigest(), chars, loss.hexdigest(), total

    def run(batches):
        conv, last, loss, chars, total = None, None, hashlib.sha256(), 0, 0
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                conv_id, formatted = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                if last is None or conv_id != conv:
                    if last is not None:
                        out.append(row(conv, last, loss, chars, total))
                    conv, loss, chars, total = conv_id, hashlib.sha256(), 0, 0
                last = formatted
                total += len(formatted)
                if batch.column(5)[i].as_py():
                    text = unescape(formatted[batch.column(3)[i].as_py() : batch.column(4)[i].as_py()])
                    chars += len(text)
                    loss.update(text.encode("utf-8", "surrogatepass"))
            if out:
                yield _rows(out)
        if last is not None:
            yield _rows([row(conv, last, loss, chars, total)])

    return examples.select(*NAMES).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op10_chat_formatting(spark, sf_dir):
    told = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(told).alias("text"))
    table = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_back(expand(table.unionByName(own)))


def _escaped(text: str) -> str:
    return rf"regexp_replace({text}, '([<\[])(\\*)({_REST.replace(chr(39), chr(39) * 2)})', '\1\\\2\3', 'g')"


SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)),
f AS (SELECT *, len('{TURN}') + len({_escaped("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")}) + 1 + len({_escaped("text")}) + len('{END}') AS n FROM t),
c AS (SELECT *, sum(n) OVER w AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS back FROM f
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       coalesce(sum(upto) FILTER (role = 'assistant' OR back = 1), 0)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""
