"""Two-level hierarchy of targets: parents, effective parents, canonical ids and their sort keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a canonical id, e.g. "SR 1.10" or "SR 1.10 RE 2".
ID_PATTERN = r"^SR (\d+)\.(\d+)(?: RE (\d+))?$"


def parent_or_null(parent: Column, own: Column) -> Column:
    """A record that names itself as its parent has none."""
    return F.nullif(parent, own)


def effective_parent(parent: Column, own: Column) -> Column:
    """The parent, or the record itself where it has none: the group key."""
    return F.coalesce(parent, own)


def effective_parent_by_type(kind: Column, parent: Column, own: Column) -> Column:
    """SR: itself; RE: its parent, null if unknown; any other type: null."""
    return F.when(kind == "SR", own).when(kind == "RE", parent)


def canonical_id(text: Column) -> Column:
    """'sr1.1 re2', 'SR-1.1(RE 2)' -> 'SR 1.1 RE 2'; null where no whole id is left."""
    t = F.upper(F.trim(F.regexp_replace(text, r"(?U)[\s_\-–—()]+", " ")))
    t = F.regexp_replace(F.regexp_replace(t, r"^SR ?", "SR "), r" ?RE ?(\d+)$", " RE $1")
    t = F.regexp_replace(t, r"(\d) ?\. ?(\d)", "$1.$2")
    return F.when(t.rlike(ID_PATTERN), t)


def id_part(text: Column, group: int) -> Column:
    found = F.regexp_extract(text, ID_PATTERN, group)
    return F.when(found != "", found.cast("int"))


def parse_id(text: Column) -> Column:
    """struct(type, fr, sr, re, parent) of a canonical id; all null for anything else."""
    re_part = id_part(text, 3)
    known = text.rlike(ID_PATTERN)
    return F.struct(
        F.when(known, F.when(re_part.isNotNull(), "RE").otherwise("SR")).alias("type"),
        id_part(text, 1).alias("fr"),
        id_part(text, 2).alias("sr"),
        re_part.alias("re"),
        F.when(re_part.isNotNull(), F.regexp_replace(text, r" RE \d+$", "")).alias("parent"),
    )


def sort_key(text: Column) -> list[Column]:
    """Numeric order: FR, SR, an SR before its REs, RE number; bad ids last, by text."""
    bad = F.lit(999)
    return [F.coalesce(id_part(text, 1), bad), F.coalesce(id_part(text, 2), bad), F.coalesce(id_part(text, 3), F.lit(0)), text]
