"""Markdown rule documents: fences, headings, titles and sections, as a stateful scan per document.

A scan costs far more than reading its text, so documents are dealt over the session's tasks first.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions import text as t
from lumenfold.functions.text import INLINE, SECTION, SECTIONS, match_form_of
from lumenfold.session import durable, spread

#: Headings that name no rule; sections; those that a rule should have.
GENERIC = frozenset(["example", "examples", "example code", "optional", "notes", "references", "related resources", "see also"])
FIELDS = ("problematic_code", "correct_code", "rationale", "exceptions")
WANTED = ("problematic_code", "correct_code", "rationale")

#: An opening fence, a heading by number signs, the underline of a heading.
_OPEN = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+|$)(.*)$")
_UNDER = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
#: What every inline mark and character reference has.
_MARKED = re.compile(r"[\[`*_~\\<&]")


class Unreadable(ValueError):
    """Why a document can't be read; code names the kind."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class Heading:
    line: int
    level: int
    label: str  # as written
    text: str  # as shown
    body: int  # first line after the heading
    category: str | None = None
    qualified: bool = False


@dataclass
class Parsed:
    title: str | None = None
    title_level: int | None = None
    sections: dict[str, str] = field(default_factory=dict)
    occurrences: dict[str, int] = field(default_factory=dict)
    qualified: dict[str, int] = field(default_factory=dict)
    fences: int = 0
    languages: list[str] = field(default_factory=list)
    diagnostics: list[tuple[str, str | None, int | None, str]] = field(default_factory=list)  # code, field, line, message
    code: str | None = None
    error: str | None = None


def fences(lines: list[str]) -> list[tuple[int, int, str]]:
    """(first line, last line, info) of each fence; one that never closes, or whose info has its own mark, can't be read."""
    out, start, close, info = [], None, re.compile(""), ""
    for i, line in enumerate(lines):
        if start is not None:
            if close.match(line):
                out.append((start, i, info))
                start = None
        elif m := _OPEN.match(line):
            start, info = i, m[2].strip()
            if m[1][0] == "`" and "`" in info:
                raise Unreadable("ambiguous_fence", f"line {i + 1}: the info of a fence has backticks")
            close = re.compile(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$")
    if start is not None:
        raise Unreadable("unmatched_fence", f"the fence of line {start + 1} is never closed")
    return out


def visible(text: str) -> str:
    """What a heading shows."""
    if not _MARKED.search(text):
        return " ".join(text.split())
    for pattern, group in INLINE:
        text = re.sub(pattern, rf"\{group}" if group else "", text)
    return " ".join(html.unescape(text).split())


def category(text: str) -> tuple[str | None, bool]:
    """(section that the heading opens or None, whether it says more than the name)."""
    form = match_form_of(visible(text))
    m = re.match(SECTION, form)
    return (SECTIONS[m[1]], form[m.end() :].strip() not in ("", ":")) if m else (None, False)


def headings(lines: list[str], fenced: list[tuple[int, int, str]]) -> list[Heading]:
    """Headings outside fences, by number signs or underlined."""
    inside = {i for a, b, _ in fenced for i in range(a, b + 1)}
    out: list[Heading] = []
    at = 0
    while at < len(lines):
        line, i = lines[at], at
        at += 1
        if i in inside:
            continue
        if m := _ATX.match(line):
            level, label = len(m[1]), re.sub(r"[ \t]+#+[ \t]*$", "", m[2]).strip()
        elif at < len(lines) and at not in inside and line.strip() and not line.startswith(("    ", "\t")) and (m := _UNDER.match(lines[at])):
            level, label = 1 if m[1][0] == "=" else 2, line.strip()
            at += 1
        else:
            continue
        if label:
            out.append(Heading(i, level, label, visible(label), at, *category(label)))
    return out


def title_of(found: list[Heading]) -> Heading:
    """The title among the headings before the first section that are not generic: the only first-level one, else the first second-level one, else the first of the highest level. Two of the first level, or none at all, can't be read."""
    before = found[: next((n for n, h in enumerate(found) if h.category), len(found))]
    own = [h for h in before if match_form_of(h.text) not in GENERIC]
    top = [h for h in own if h.level == 1]
    if len(top) > 1:
        raise Unreadable("several_titles", "titles at lines " + ", ".join(str(h.line + 1) for h in top))
    if not own:
        raise Unreadable("no_title", "no heading names the rule")
    return next(iter(top or [h for h in own if h.level == 2] or sorted(own, key=lambda h: h.level)))


def body_of(lines: list[str], start: int, end: int, fenced: list[tuple[int, int, str]]) -> str:
    """A section's text: fence marks gone, code as it is, prose without blank lines at its ends, parts joined by a blank line."""
    parts, at = [], start

    def prose(upto: int) -> list[str]:
        part = lines[at:upto]
        used = [i for i, line in enumerate(part) if line.strip()]
        return part[used[0] : used[-1] + 1] if used else []

    for a, b, _ in fenced:
        parts += [prose(a), lines[a + 1 : b]]
        at = b + 1
    parts.append(prose(end))
    return "\n\n".join(p for p in ("\n".join(x) for x in parts) if p)


def parse(markdown: str | None, untitled: bool = False) -> Parsed:
    """Title and sections of a rule document; null is the empty text.

    A section's parts are joined in order; where there are several, or a heading says more than the
    section's name, each stands under its heading. untitled: a document without a title can be read.
    """
    out = Parsed()
    lines = re.sub(r"\r\n?", "\n", markdown or "").split("\n")
    try:
        fenced = fences(lines)
        found = headings(lines, fenced)
        try:
            title = title_of(found)
            out.title, out.title_level = title.text, title.level
        except Unreadable as e:
            if e.code != "no_title" or not untitled:
                raise
    except Unreadable as e:
        out.code, out.error = e.code, str(e)
        return out
    parts: dict[str, list[tuple[Heading, str]]] = {}
    for n, h in enumerate(found):
        if not h.category:
            continue
        end = next((k.line for k in found[n + 1 :] if k.category or k.level <= h.level), len(lines))
        own = [f for f in fenced if h.body <= f[0] and f[1] < end]
        parts.setdefault(h.category, []).append((h, body_of(lines, h.body, end, own)))
        out.fences += len(own)
        out.languages += [info.split(None, 1)[0] for _, _, info in own if info]
    for name, each in parts.items():
        out.occurrences[name], out.qualified[name] = len(each), sum(h.qualified for h, _ in each)
        labelled = len(each) > 1 or out.qualified[name] > 0
        if text := "\n\n".join(f"{h.label}\n{body}" if labelled else body for h, body in each if body):
            out.sections[name] = text
        out.diagnostics += [("empty_semantic_section", name, h.line + 1, f"nothing under {h.label!r}") for h, body in each if not body]
    out.diagnostics += [("missing_semantic_field", k, None, "no text for it") for k in WANTED if k not in out.sections]
    return out


#: What parse finds, as a column: for Spark, and for Arrow.
PARSED = "struct<title string, " + ", ".join(f"{f} string" for f in FIELDS) + ", code string, error string, title_level int, occurrences map<string, int>, qualified map<string, int>, fence_count int, fence_languages array<string>, diagnostics array<struct<code string, field string, line int, message string>>>"
_COUNTS = pa.map_(pa.string(), pa.int32())
_DIAGNOSTIC = pa.struct([("code", pa.string()), ("field", pa.string()), ("line", pa.int32()), ("message", pa.string())])
_STRINGS = ["title", *FIELDS, "code", "error"]


def _scanned(documents: DataFrame, at: list[str], scan, schema: T.StructType) -> DataFrame:
    """Batches of documents, dealt over the session's tasks, through scan(batch, columns `at`); rows in short slices."""
    places = [documents.columns.index(c) for c in at]

    def run(batches):
        for big in batches:
            for n in range(0, big.num_rows, 1024):
                batch = big.slice(n, 1024)
                yield scan(batch, *(batch.column(i).to_pylist() for i in places))

    return spread(documents).mapInArrow(run, schema)


def parsed(documents: DataFrame, text: str, untitled: Column) -> DataFrame:
    """documents with what parse finds in each as the struct _p."""

    def scan(batch, texts, free):
        rows = [parse(m, bool(u)) for m, u in zip(texts, free, strict=True)]
        columns = {"title": [r.title for r in rows], **{f: [r.sections.get(f) for r in rows] for f in FIELDS}, "code": [r.code for r in rows], "error": [r.error for r in rows]}
        made = {n: pa.array(columns[n], pa.string()) for n in _STRINGS}
        made["title_level"] = pa.array([r.title_level for r in rows], pa.int32())
        for n, counts in (("occurrences", [r.occurrences for r in rows]), ("qualified", [r.qualified for r in rows])):
            made[n] = pa.array([list(c.items()) for c in counts], _COUNTS)
        made["fence_count"], made["fence_languages"] = pa.array([r.fences for r in rows], pa.int32()), pa.array([r.languages for r in rows], pa.list_(pa.string()))
        made["diagnostics"] = pa.array([[dict(zip(("code", "field", "line", "message"), d, strict=True)) for d in r.diagnostics] for r in rows], pa.list_(_DIAGNOSTIC))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.StructArray.from_arrays(list(made.values()), list(made))], names=[*batch.schema.names[:-1], "_p"])

    given = documents.withColumn("_untitled", untitled)
    schema = T.StructType([*documents.schema.fields, T.StructField("_p", T._parse_datatype_string(PARSED))])
    return _scanned(given, [text, "_untitled"], scan, schema)


#: Rows of a document: a fence or a heading with its lines (from 1; a heading's last line is the one before its body), the end of the document, or why it can't be read.
MARK = "kind string, line int, last_line int, level int, label string, shown string, category string, qualified boolean, info string"
_MARK = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()]


def marks_of(markdown: str | None) -> list[tuple]:
    """The marks of one document; see MARK."""
    lines = re.sub(r"\r\n?", "\n", markdown or "").split("\n")
    try:
        fenced = fences(lines)
    except Unreadable as e:
        return [("unreadable", 0, 0, None, None, None, e.code, None, str(e))]
    out: list[tuple] = [("fence", a + 1, b + 1, None, None, None, None, None, info) for a, b, info in fenced]
    out += [("heading", h.line + 1, h.body, h.level, h.label, h.text, h.category, h.qualified, None) for h in headings(lines, fenced)]
    return [*out, ("end", len(lines) + 1, len(lines) + 1, None, None, None, None, None, None)]


def marks(documents: DataFrame, text: str = "markdown") -> DataFrame:
    """A row (MARK) for each fence and heading of every document, beside the document's other columns, so what follows is relational. Null is the empty text, which has its end alone."""
    keys = [c for c in documents.columns if c != text]
    names = [c.split()[0] for c in MARK.split(", ")]

    def scan(batch, texts):
        found, places = [], []
        for i, x in enumerate(texts):
            own = marks_of(x)
            found += own
            places += [i] * len(own)
        beside = batch.take(pa.array(places, pa.int64())).columns[:-1]
        return pa.RecordBatch.from_arrays([*beside, *(pa.array(c, kind) for c, kind in zip(zip(*found), _MARK, strict=True))], names=[*keys, *names])

    schema = T.StructType([*documents.select(*keys).schema.fields, *T._parse_datatype_string(MARK).fields])
    return _scanned(documents.select(*keys, text), [text], scan, schema)


def sections(found: DataFrame, documents: DataFrame, keys: list[str], text: str = "markdown") -> DataFrame:
    """(keys, category, qualified, label, line, first_line, last_line, fences, body) of each section of marks() `found`: its body runs to the line before the next heading that opens a section or is of its level or a higher one.

    A document's marks are read once from its end: the next heading is, for each level, the first of a running minimum, which
    carries the number of fences from there on; a section's fences are the difference. body: the lines as they are, fences
    included; null where there are none.
    """
    back = Window.partitionBy(*keys).orderBy(F.desc("line"), F.desc("kind"))
    after = back.rowsBetween(Window.unboundedPreceding, -1)
    m = found.where("kind <> 'unreadable'").withColumn("_on", F.count_if(F.col("kind") == "fence").over(back.rowsBetween(Window.unboundedPreceding, 0)))
    ends = [F.min(F.when((F.col("kind") == "end") | F.col("category").isNotNull() | ((F.col("kind") == "heading") & (F.col("level") <= n)), F.struct("line", "_on"))).over(after) for n in range(1, 7)]
    s = m.select("*", F.array(*ends).alias("_ends")).where("kind = 'heading' and category is not null").withColumn("_end", F.element_at("_ends", F.col("level")))
    s = s.select(*keys, "category", "qualified", "label", "line", (F.col("last_line") + 1).alias("first_line"), (F.col("_end.line") - 1).alias("last_line"), (F.col("_on") - F.col("_end._on")).alias("fences"))
    lines = F.split(t.newlines(F.col(text)), "\n")
    body = F.when(F.col("last_line") >= F.col("first_line"), F.array_join(F.slice(lines, F.col("first_line"), F.col("last_line") - F.col("first_line") + 1), "\n"))
    return s.join(documents.select(*keys, text), keys).select(*s.columns, body.alias("body"))


class Extraction(NamedTuple):
    """rules; diagnostics (what was noticed in them); quarantine (documents that can't be read, with code and error); measures (counts of each rule's sections and fences)."""

    rules: DataFrame
    diagnostics: DataFrame
    quarantine: DataFrame
    measures: DataFrame


def extract(documents: DataFrame, text: str = "markdown", untitled: Column | None = None, once: bool = False) -> Extraction:
    """Parses every document. untitled: which of them may lack a title, as a curation gives it. once: parse now and keep what is found, for those who read several of the four tables."""
    p = parsed(documents, text, F.lit(False) if untitled is None else F.coalesce(untitled, F.lit(False)))
    p = durable(p) if once else p
    keys = [c for c in documents.columns if c != text]
    good, bad = p.where("_p.error is null"), p.where("_p.error is not null")
    rules = good.select(*keys, "_p.title", *[f"_p.{f}" for f in FIELDS], t.newlines(F.col(text)).alias("raw_markdown"))
    told = good.select(*keys, F.explode("_p.diagnostics").alias("d")).select(*keys, "d.*")
    measures = good.select(*keys, *[f"_p.{c}" for c in ("title_level", "occurrences", "qualified", "fence_count", "fence_languages")])
    return Extraction(rules, told.orderBy(*keys, F.coalesce("line", F.lit(-1)), "code", F.coalesce("field", F.lit(""))), bad.select(*keys, "_p.code", "_p.error"), measures)


def first_of_ids(documents: DataFrame, key: str = "id", order: str = "path") -> tuple[DataFrame, DataFrame]:
    """(the first document of each id in path order, problems of the others: key, code, error)."""
    n = documents.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    told = n.where("_n > 1").select(key, F.lit("duplicate_normalized_id").alias("code"), F.concat(F.lit("repeated id: "), F.col(key)).alias("error"))
    return n.where("_n = 1").drop("_n"), told


def apply_curations(rules: DataFrame, curations: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rules with curated fields, problems of the curations: key, code, error).

    curations: key, field, value, allow_replace_non_null. A curation of a filled field must be allowed to replace it,
    one field of a rule has one curation, and each must meet a rule and a field that is there.
    """
    c = curations.groupBy(key, "field").agg(F.count("*").alias("n"), F.min("value").alias("value"), F.bool_and("allow_replace_non_null").alias("may"))
    fields = [x for x in ("title", *FIELDS) if x in rules.columns]
    wide = c.groupBy(key).pivot("field", fields).agg(F.first("value"))
    j = rules.join(wide.select(key, *[F.col(f).alias(f"_c_{f}") for f in fields]), key, "left")
    out = j.select(*[F.coalesce(f"_c_{x}", x).alias(x) if x in fields else F.col(x) for x in rules.columns])
    each = rules.select(key, F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.coalesce(F.col(f), F.lit("")))])).alias("field", "_old"))
    met = c.join(each, [key, "field"], "left")
    code = F.when(F.col("n") > 1, "duplicate_curation").when(F.col("_old").isNull(), "unused_source_curation").when((F.col("_old") != "") & ~F.coalesce("may", F.lit(False)), "replaces_non_null")
    return out, met.select(key, code.alias("code"), F.concat_ws(" ", F.lit("curation of"), "field").alias("error")).where("code is not null")


def gate(*problems: DataFrame, what: str = "corpus", shown: int = 20) -> None:
    """Raises if any of the tables (code, error, ...) has a row: all are counted by code, the first few are named."""
    counts: Counter = Counter()
    examples: list[str] = []
    for p in problems:
        for r in p.groupBy("code").agg(F.count("*").alias("n")).collect():  # a row for each kind of problem
            counts[r["code"]] += r["n"]
        if len(examples) < shown:
            examples += [f"{r['code']}: {r['error']}" for r in p.select("code", "error").orderBy("code", "error").limit(shown - len(examples)).collect()]
    if counts:
        raise ValueError(f"{what} can't be published: {dict(sorted(counts.items()))}; " + "; ".join(examples))


def publication_problems(resolved: DataFrame, allowed: tuple[str, ...] = ("A",)) -> DataFrame:
    """(code, error) of the fields (see field_resolution) that hold up publication: unreviewed, stale, or reviewed in another class than the allowed ones."""
    held = ~F.col("state").isin("filled", *[f"reviewed_{a}" for a in allowed])
    return resolved.where(held).select(F.col("state").alias("code"), F.col("field").alias("error"))


def corpus_rollup(found: Extraction) -> DataFrame:
    """(measure, name, n): rules, filled fields, sections and qualified sections by field, rules that repeat a section, fences, fence languages, warnings and quarantined documents by code. Each of the four tables is read once; see extract's once."""
    row = lambda measure, name, n: F.struct(F.lit(measure).alias("measure"), name.alias("name"), n.cast("long").alias("n"))
    one = F.lit(1)
    rules = F.array(row("rules", F.lit("total"), one), *[row("field_coverage", F.lit(f), F.coalesce(f, F.lit("")) != "") for f in FIELDS])
    counts = lambda column, measure, n: F.transform(F.map_entries(column), lambda e: row(measure, e["key"], n(e["value"])))
    measures = F.concat(
        counts("occurrences", "section_occurrences", lambda v: v), counts("qualified", "qualified_occurrences", lambda v: v), counts("occurrences", "rules_with_repeated_sections", lambda v: v > 1),
        F.array(row("fences", F.lit("total"), F.col("fence_count"))), F.transform("fence_languages", lambda k: row("fence_language", k, one)))
    parts = [found.rules.select(F.inline(rules)), found.measures.select(F.inline(measures))]
    parts += [df.select(F.inline(F.array(row(measure, F.col("code"), one)))) for df, measure in ((found.diagnostics, "warnings"), (found.quarantine, "failures"))]
    added = [p.groupBy("measure", "name").agg(F.sum("n").alias("n")) for p in parts]  # a part's order is of no use here
    every = added[0]
    for p in added[1:]:
        every = every.unionAll(p)
    return every.groupBy("measure", "name").agg(F.sum("n").alias("n"))


def verify_curations(curations: DataFrame, documents: DataFrame, keys: list[str], text: str = "markdown") -> DataFrame:
    """Curations with valid: their quoted text stands in the cited lines of the document, and their value has the stated digest."""
    j = curations.join(documents.select(*keys, F.col(text).alias("_t")), keys, "left")
    span = F.array_join(F.slice(F.split(F.regexp_replace("_t", r"\r\n?", "\n"), "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    ok = F.contains(span, F.col("exact_text")) & (F.sha2("value", 256) == F.col("value_sha256"))
    return j.withColumn("valid", F.coalesce(ok, F.lit(False))).drop("_t")


def field_resolution(rules: DataFrame, reviews: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, state): filled, reviewed (its class follows), unreviewed; reviews of filled or unknown fields are stale. See publication_problems."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (F.coalesce(F.col(f), F.lit("")) != "").alias("filled")) for f in fields]))
    have = rules.select(*keys, each.alias("x")).select(*keys, "x.*")
    j = have.join(reviews.select(*keys, "field", "classification", F.lit(True).alias("_r")), [*keys, "field"], "full")
    state = F.when(F.col("filled") & F.col("_r").isNull(), "filled").when(F.col("_r").isNotNull() & F.coalesce("filled", F.lit(True)), "stale").when(F.col("_r"), F.concat(F.lit("reviewed_"), F.col("classification"))).otherwise("unreviewed")
    return j.select(*keys, "field", state.alias("state"))
