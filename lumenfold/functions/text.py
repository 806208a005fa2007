"""Scalar text functions. Everything runs in the JVM except what the last section says."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space in the Unicode sense.
SPACE = r"(?U)\s+"
TRIM = r"(?U)^\s+|\s+$"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once although the body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(t: Column) -> Column:
    return F.regexp_replace(t, TRIM, "")


def collapse(t: Column, soft_hyphens: bool = False) -> Column:
    """Runs of white space become one space, ends are trimmed; soft hyphens go if asked."""
    t = F.translate(t, "­", "") if soft_hyphens else t
    return strip(F.regexp_replace(t, SPACE, " "))


def comparison_form(t: Column) -> Column:
    """Lower case, straight quotes, collapsed white space: for comparing, not for display."""
    return collapse(F.translate(F.lower(t), "’‘“”", "''\"\""))


def filled(t: Column) -> Column:
    """Whether there is anything: null and the empty string are nothing."""
    return F.coalesce(t, F.lit("")) != ""


def embedding_text(key: Column, title: Column, labelled: dict[str, Column], body: Column | None = None) -> Column:
    """Key, title, body and labelled parts, nothing for an empty part, joined by blank lines and stripped."""
    parts = [F.nullif(key, F.lit("")), F.nullif(title, F.lit(""))]
    if body is not None:
        parts.append(F.nullif(body, F.lit("")))
    parts += [F.when(filled(c), F.concat(F.lit(f"{name}:\n"), c)) for name, c in labelled.items()]
    return strip(F.concat_ws("\n\n", *parts))


def remove_artefacts(t: Column, word: str = "Void") -> Column:
    return collapse(F.regexp_replace(t, rf"(?i)\b{word}\b", ""))


def prefix_variant(a: Column, b: Column) -> Column:
    """Whether one is a beginning of the other."""
    return F.startswith(a, b) | F.startswith(b, a)


def contains_either(a: Column, b: Column) -> Column:
    """Whether one contains the other."""
    return F.contains(a, b) | F.contains(b, a)


def valid_passage(t: Column, markers: list[str], least: int = 20) -> Column:
    """Long enough and without a forbidden marker (in any case)."""
    return (F.length(t) >= least) & ~F.lower(t).rlike("|".join(re.escape(m.lower()) for m in markers))


def tags(t: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that the text matches, in their order."""
    return F.filter(F.array(*[F.when(t.rlike(p), F.lit(n)) for n, p in patterns.items()]), lambda x: x.isNotNull())


def modal_status(t: Column, word: str = "shall") -> Column:
    """pass: has the word, as a word between spaces or at an end; fail: is empty; warning: anything else."""
    c = F.lower(collapse(t))
    return F.when(F.contains(F.concat(F.lit(" "), c, F.lit(" ")), F.lit(f" {word} ")), "pass").when(filled(c), "warning").otherwise("fail")


def word_count(t: Column) -> Column:
    c = collapse(t)
    return F.when(filled(c), F.size(F.split(c, " "))).otherwise(F.lit(0))


def newlines(t: Column) -> Column:
    return F.regexp_replace(t, r"\r\n?", "\n")


#: What Markdown inline marks leave behind (the group that stays, 0: nothing), in order. Single marks count only at the edge of a word.
INLINE = [
    (r"!\[([^\]]*)\]\([^)]+\)", 1),
    (r"\[([^\]]+)\]\([^)]+\)", 1),
    (r"(`+)(.*?)\1", 2),
    (r"\*\*(.*?)\*\*", 1),
    (r"__(.*?)__", 1),
    (r"(?<!\w)\*([^*]+)\*(?!\w)", 1),
    (r"(?<!\w)_([^_]+)_(?!\w)", 1),
    (r"~~(.*?)~~", 1),
    (r"\\([!-/:-@\[-`{-~])", 1),
    (r"<[^>]+>", 0),
]


def visible_heading(t: Column) -> Column:
    """What a Markdown heading shows, but for character references (see unescape)."""
    for pattern, group in INLINE:
        t = F.regexp_replace(t, "(?U)" + pattern, f"${group}" if group else "")
    return collapse(t)


#: How a heading that opens a section begins, what may follow the name, and the sections by name.
SECTION = r"^(problematic code|correct code|rationale|exceptions?)(?=$|[\s:#(\[\-–—])"
SECTIONS = {"problematic code": "problematic_code", "correct code": "correct_code", "rationale": "rationale", "exception": "exceptions", "exceptions": "exceptions"}


def heading_category(t: Column) -> Column:
    """struct(category, qualified): the section that a shown heading opens, and whether it says more than the name; null category: none."""
    form = strip(F.regexp_replace(F.lower(t), r"(?U)[\s_\-]+", " "))
    name = F.regexp_extract(form, "(?U)" + SECTION, 1)
    rest = strip(F.substring(form, F.length(name) + 1, F.length(form)))
    known = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    return F.struct(F.try_element_at(known, name).alias("category"), ((name != "") & ~rest.isin("", ":")).alias("qualified"))


#: Steps that turn wiki Markdown into dense text, in order: code blocks, section names, rule tags, number signs, links, addresses and what leads to them, marks.
WIKI = [
    (r"(?s)```.*?```", ""),
    (r"(?iU)#*\s*(?:Problematic code|Correct code|Rationale|Exceptions)[:]*", ""),
    (r"(?imdU)^#+\s*(?:DL|SC)\d+\s*$", ""),
    (r"#+", ""),
    (r"(?d)\[(.*?)\]\(.*?\)", "$1"),
    (r"(?iU)(?:see(?:\s+also)?|read(?:\s+more)?|reference[s]?|for\s+more\s+(?:info|details))?[\s:]*http[s]?://\S+", ""),
    (r"[*`_~>|-]", ""),
]


def wiki_plain(t: Column) -> Column:
    """Dense text of a wiki page: words and plain punctuation in one line."""
    for pattern, to in WIKI:
        t = F.regexp_replace(t, pattern, to)
    return collapse(t)


def strip_scored(t: Column) -> Column:
    return collapse(F.replace(F.regexp_replace(t, r"(?i)\((?:not )?scored\)", ""), F.lit("|"), F.lit(" ")))


def paired_tags(t: Column, separator: str = ",") -> Column:
    """Tokens of a separated list, two by two, each pair joined by a space; a last odd one stands alone."""
    tokens = F.transform(F.split(t, re.escape(separator)), F.trim)
    return let(tokens, lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - 1, F.lit(2)), lambda i: F.concat_ws(" ", F.slice(a, i + 1, 2))))


def sha256(t: Column) -> Column:
    return F.sha2(F.coalesce(t, F.lit("")), 256)


def ordered_ids_digest(ids: Column) -> Column:
    """SHA-256 of the ids, one per line, each line ended."""
    return F.sha2(F.concat(F.array_join(ids, "\n"), F.when(F.size(ids) > 0, "\n").otherwise("")), 256)


def ranked_pair_id(source: Column, source_id: Column, rank: Column, target_id: Column) -> Column:
    return F.concat_ws(":", source, source_id.cast("string"), F.concat(F.lit("rank_"), rank.cast("string")), target_id.cast("string"))


def pair_id(**fields: Column) -> Column:
    """An id that does not depend on rank: a prefix and the SHA-256 of the canonical JSON (sorted keys, no spaces, nulls kept)."""
    ordered = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.concat(F.lit("pair-v1:"), F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256))


def strip_code_fence(t: Column) -> Column:
    """The inside of a fenced answer, or the trimmed text itself."""
    return F.regexp_replace(F.trim(t), r"(?s)^```[a-zA-Z]*\s*\n?(.*?)\s*```$", "$1")


#: What an error message that has one of these phrases means, in order of precedence.
ERRORS = {
    "quota": ["429", "quota", "rate limit", "resource exhausted"],
    "authentication": ["401", "403", "unauthorized", "authentication", "api key", "permission denied"],
    "transient": ["503", "service unavailable", "temporarily unavailable", "deadline exceeded", "timeout", "connection reset", "internal server error", "unavailable"],
    "configuration": ["400", "invalid argument", "model not found", "configuration"],
}


def error_class(t: Column) -> Column:
    """The first class with a phrase that the message has, in any case; else api."""
    low = F.lower(t)
    found = [F.when(low.rlike("|".join(map(re.escape, phrases))), name) for name, phrases in ERRORS.items()]
    return F.coalesce(*found, F.lit("api"))


def first_category(**tests: Column) -> Column:
    """struct(primary, others): the first named test that holds, and the rest that do."""
    held = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]), lambda x: x.isNotNull())
    return F.struct(F.get(held, F.lit(0)).alias("primary"), F.slice(held, 2, len(tests)).alias("others"))


def gap_bin(gap: Column) -> Column:
    """The sampler's bins: null is no_gap, a value outside them unknown."""
    return F.when(gap.isNull(), "no_gap").when((gap >= 0) & (gap < 0.05), "very_low_gap").when((gap >= 0.05) & (gap < 0.10), "low_gap").when((gap >= 0.10) & (gap < 0.20), "medium_gap").when((gap >= 0.20) & (gap <= 1), "high_gap").otherwise("unknown")


def audit_gap_bin(gap: Column) -> Column:
    """The auditor's bins: null stays null, a negative gap is very low."""
    return F.when(gap < 0.05, "very_low_gap").when(gap < 0.10, "low_gap").when(gap < 0.20, "medium_gap").when(gap >= 0.20, "high_gap")


def full_source_name(t: Column, names: dict[str, str]) -> Column:
    """The full name of a short or full source name; an unknown name is an error."""
    known = F.create_map(*[F.lit(x) for k, v in {**names, **{v: v for v in names.values()}}.items() for x in (k, v)])
    low = F.lower(F.trim(t))
    return F.coalesce(F.try_element_at(known, low), F.raise_error(F.concat(F.lit("unknown source: "), low)).cast("string"))


# Python, in Arrow batches: no built-in function does what these do.


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts; null is the empty text."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def unescape(t: pd.Series) -> pd.Series:
    return t.map(lambda x: html.unescape(x) if x is not None else None)


def match_form_of(text: str) -> str:
    return re.sub(r"[\s_-]+", " ", unicodedata.normalize("NFKC", text).casefold()).strip()


@F.pandas_udf(T.StringType())
def match_form(t: pd.Series) -> pd.Series:
    """NFKC, case folding, separators to spaces."""
    return t.map(lambda x: match_form_of(x) if x is not None else None)


def overlap(first: list[str], second: list[str]) -> int:
    """How many words at most both end first and begin second. Linear: the few places where second's first word stands, or the prefix function of second, carried over the end of first."""
    tail = first[max(0, len(first) - len(second)) :]
    if second and (few := tail.count(second[0])) <= 8:
        at = -1
        for _ in range(few):
            at = tail.index(second[0], at + 1)
            if tail[at:] == second[: len(tail) - at]:
                return len(tail) - at
        return 0
    fall = [0] * len(second)

    def step(k: int, word: str) -> int:
        while k and (k == len(second) or second[k] != word):
            k = fall[k - 1]
        return k + 1 if k < len(second) and second[k] == word else k

    for i in range(1, len(second)):
        fall[i] = step(fall[i - 1], second[i])
    k = 0
    for word in tail:
        k = step(k, word)
    return k


def merge_two(first: str, second: str, least: int = 80) -> str:
    """Both texts as one, in any case: of two of which one contains the other the container (the first, if both do); else joined, without the longest beginning of second, of whole words and at least `least` characters, that ends first."""
    if not first or not second:
        return first or second
    low, other = first.lower(), second.lower()
    if other in low:
        return first
    if low in other:
        return second
    words, more = first.split(), second.split()
    k = overlap([w.lower() for w in words], [w.lower() for w in more])
    same = k > 0 and len(" ".join(words[-k:])) >= least
    return " ".join([first, *more[k if same else 0 :]])


class _Held:
    """A merged text: its parts, in lower case too, its words, and the runs of three words in it, so that a part is taken in at the cost of the part."""

    def __init__(self, text: str, low: str):
        self.parts, self.lows, self.size, self.words, self.lowered, self.threes = [], [], -1, [], [], set()
        words = text.split()
        self.append(text, low, words, [w.lower() for w in words])

    def append(self, text: str, low: str, words: list[str], lowered: list[str]) -> None:
        self.parts.append(text)
        self.lows.append(low)
        self.size += 1 + len(low)
        self.words += words
        self.lowered += lowered
        new = self.lowered[-len(lowered) - 2 :] if lowered else []
        self.threes.update(zip(new, new[1:], new[2:]))

    def low(self) -> str:
        self.lows = [" ".join(self.lows)]
        return self.lows[0]

    def has(self, low: str, words: list[str]) -> bool:
        """Whether the text has low, whose words these are. All but the first and last stand there whole, or it is not looked through; the newest are asked first."""
        at = range(len(words) - 4, 0, -1)
        return len(low) <= self.size and all((words[i], words[i + 1], words[i + 2]) in self.threes for i in at) and low in self.low()


def merge_overlapping(texts: list[str], least: int = 80) -> str:
    """merge_two over the texts in order, runs of white space being one space. What is held is looked through only for a text whose runs of words it has, so parts of a long text cost what they are long."""
    held = None
    for t in texts:
        words = (t or "").split()
        if not words:
            continue
        text = " ".join(words)
        low = text.lower()
        if held is None:
            held = _Held(text, low)
            continue
        more = low.split()
        if held.has(low, more):
            continue
        if held.size <= len(low) and held.low() in low:
            held = _Held(text, low)
            continue
        k = overlap(held.lowered[-len(more) :], more)
        k = k if k and len(" ".join(held.words[-k:])) >= least else 0
        held.append(" ".join(words[k:]), " ".join(more[k:]), words[k:], more[k:])
    return " ".join(held.parts) if held else ""


@F.pandas_udf(T.StringType())
def merge_overlaps(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: merge_overlapping(list(x)) if x is not None else None)
