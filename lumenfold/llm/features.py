"""Dense word statistics of texts, per document and per passage.

Each distinct word is looked at once and kept in a bounded table; a text is then a row of word
numbers, and every feature is a NumPy reduction over their statistics.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters read as letters in disguise, and what surrounds a word.
LEET = str.maketrans("013457@$!", "oieastasi")
EDGES = ".,;:!?\"'()[]{}<>*#%&$|-_~`"
#: Second-person forms of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta vous votre vos usted ustedes vosotros tú ti tuyo".split())
OBFUSCATED = re.compile(r"[^\W\d_][\d@$*!#.\-_]+[^\W\d_]")

COLUMNS = ["length", "upper", "letters", "digits", "bangs", "symbols", "punctuation", "no_alnum", "all_caps", "weight", "hidden_weight", "obfuscated", "second_person", "questions"]
LENGTH, UPPER, LETTERS, DIGITS, BANGS, SYMBOLS, PUNCT, NO_ALNUM, ALL_CAPS, WEIGHT, HIDDEN, OBF, SECOND, QUESTIONS = range(len(COLUMNS))
SYMBOL_SET = frozenset("#$%&*<>|=~^@_{}[]\\/+")
PUNCT_SET = frozenset(".,;:'\"()-")
PREFIXES = (4, 5, 6, 7)


class Lexicon:
    """Weights of whole words and of word beginnings; a word has the largest that applies."""

    def __init__(self, words: dict[str, float] | None = None, prefixes: dict[str, float] | None = None):
        self.words, self.prefixes = words or {}, prefixes or {}
        self.heads = {p[: PREFIXES[0]] for p in self.prefixes}

    def weight(self, core: str) -> float:
        w = self.words.get(core, 0.0)
        if core[: PREFIXES[0]] in self.heads:
            w = max(w, *(self.prefixes.get(core[:k], 0.0) for k in PREFIXES if len(core) >= k))
        return w


class WordTable:
    """word -> its number; made again from nothing when it holds most_words.

    Words with the same statistics share a kind: .kind_of gives a word's kind, .rows a kind's statistics.
    """

    def __init__(self, lexicon: Lexicon | None = None, most_words: int = 300_000):
        self.lexicon, self.most_words = lexicon or Lexicon(), most_words
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.rows: dict[tuple, int] = {}
        self.kind_of: list[int] = []
        self.plain: dict[tuple, int] = {}
        self._kinds = np.zeros(0, np.int64)

    def _meet(self, word: str) -> int:
        found = self.number.get(word)
        if found is not None:
            return found  # met earlier in the same text
        low = word.lower()
        core = low.strip(EDGES)
        weight = self.lexicon.weight(core)
        body = word if len(core) == len(word) else word[:-1]
        # Most words are letters in lower or title case, perhaps with one mark after them: these share a kind by length and mark.
        if weight == 0.0 and len(core) == len(body) and body.isalpha() and (low == word or body.istitle()) and low.startswith(core) and core not in SECOND_PERSON:
            key = (len(word), word[len(body) :], low != word)
            kind = self.plain.get(key)
            if kind is None:
                kind = self.plain[key] = self.rows.setdefault(self._statistics(word, core, weight), len(self.rows))
        else:
            kind = self.rows.setdefault(self._statistics(word, core, weight), len(self.rows))
        self.number[word] = at = len(self.kind_of)
        self.kind_of.append(kind)
        return at

    def _statistics(self, word: str, core: str, weight: float) -> tuple:
        n = len(word)
        second = 1.0 if core in SECOND_PERSON else 0.0
        up = sum(map(str.isupper, word))
        if word.isalpha():
            return (n, up, n, 0, 0, 0, 0, 0.0, 1.0 if up == n > 1 else 0.0, weight, 0.0, 0.0, second, 0)
        letters, digits = sum(map(str.isalpha, word)), sum(map(str.isdigit, word))
        symbols, punct = sum(c in SYMBOL_SET for c in word), sum(c in PUNCT_SET for c in word)
        hidden, obf = 0.0, 0.0
        if letters < len(core) and OBFUSCATED.search(core):
            obf = 1.0
            hidden = self.lexicon.weight("".join(c for c in core.translate(LEET) if c.isalpha()))
        return (n, up, letters, digits, word.count("!"), symbols, punct, 0.0 if letters or digits else 1.0, 1.0 if up == letters > 1 else 0.0, weight, hidden, obf, second, word.count("?"))

    def look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of each word of each text, first word of each text and the end, statistics of each word)."""
        if len(self.number) > self.most_words:
            self._forget()
        ids, starts, get, meet = [], [0], self.number.get, self._meet
        for t in texts:
            words = t.split()
            found = list(map(get, words))
            if None in found:
                found = [meet(w) if k is None else k for w, k in zip(words, found, strict=True)]
            ids += found
            starts.append(len(ids))
        self._kinds = np.concatenate([self._kinds, np.array(self.kind_of[len(self._kinds) :], np.int64)])
        ids = np.array(ids, dtype=np.int64)
        rows = np.array(list(self.rows), dtype=np.float32).reshape(-1, len(COLUMNS))
        return ids, np.array(starts, dtype=np.int64), rows[self._kinds[ids]]


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of values over [starts[i], starts[i + 1]); 0 over nothing."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]))
    full = starts[1:] > starts[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, starts[:-1][full], axis=0)
    return out


def maxima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts) - 1)
    full = starts[1:] > starts[:-1]
    if full.any():
        out[full] = np.maximum.reduceat(values, starts[:-1][full])
    return out


def passage_starts(starts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each passage and the end, first passage of each text and the end); a text without words has one empty passage."""
    count = np.maximum(1, -(-np.diff(starts) // words))
    bags = np.concatenate([[0], np.cumsum(count)])
    nth = np.arange(bags[-1]) - np.repeat(bags[:-1], count)
    return np.concatenate([np.repeat(starts[:-1], count) + nth * words, starts[-1:]]), bags


def shape_features(ids: np.ndarray, starts: np.ndarray, v: np.ndarray) -> np.ndarray:
    """One row of form statistics for each span of words (v: statistics of each word); no lexicon is used."""
    n = np.diff(starts).astype(np.float64)
    s, some = sums(v, starts), np.maximum(n, 1)
    chars, letters = np.maximum(s[:, LENGTH], 1), np.maximum(s[:, LETTERS], 1)
    span = np.repeat(np.arange(len(n)), np.diff(starts))
    same = [np.zeros(len(ids)) for _ in range(2)]
    for k in (1, 2):
        same[k - 1][k:] = (ids[k:] == ids[:-k]) & (span[k:] == span[:-k])
    most = int(ids.max(initial=0)) + 1
    distinct = np.bincount(pc.unique(pa.array(span * most + ids)).to_numpy() // most, minlength=len(n))
    square = sums(v[:, LENGTH].astype(np.float64) ** 2, starts)
    mean = s[:, LENGTH] / some
    return np.column_stack([
        mean, np.sqrt(np.maximum(square / some - mean**2, 0)), np.log1p(maxima(v[:, LENGTH], starts)), s[:, UPPER] / letters, s[:, LETTERS] / chars, s[:, DIGITS] / chars,
        s[:, BANGS] / some, s[:, SYMBOLS] / some, s[:, PUNCT] / some, s[:, NO_ALNUM] / some, s[:, ALL_CAPS] / some, sums(same[0], starts) / some, sums(same[1], starts) / some,
        distinct / some, np.log1p(n), s[:, QUESTIONS] / some,
    ])


def abuse_features(ids: np.ndarray, starts: np.ndarray, v: np.ndarray, near: int = 5) -> np.ndarray:
    """One row for each text: lexicon densities, second-person proximity, capitals, punctuation and obfuscation rates."""
    n = np.diff(starts).astype(np.float64)
    s, some = sums(v, starts), np.maximum(n, 1)
    hit = np.maximum(v[:, WEIGHT], v[:, HIDDEN])
    strong = (hit > 0).astype(np.float64)
    seconds = np.concatenate([[0], np.cumsum(v[:, SECOND])])
    text_of = np.repeat(np.arange(len(n)), np.diff(starts))
    at = np.arange(len(ids))
    low, high = np.maximum(at - near, starts[:-1][text_of]), np.minimum(at + near + 1, starts[1:][text_of])
    beside = strong * (seconds[high] > seconds[low])
    hits, letters = sums(strong, starts), np.maximum(s[:, LETTERS], 1)
    return np.column_stack([
        100 * hits / some, np.log1p(hits), sums(hit.astype(np.float64), starts) / some, maxima(hit, starts), np.log1p(sums(hit.astype(np.float64), starts)),
        sums(beside, starts) / np.maximum(hits, 1), s[:, SECOND] / some, s[:, UPPER] / letters, s[:, ALL_CAPS] / some, s[:, BANGS] / some, s[:, QUESTIONS] / some,
        s[:, PUNCT] / some, s[:, SYMBOLS] / some, s[:, OBF] / some, sums((v[:, HIDDEN] > 0).astype(np.float64), starts), np.log1p(n),
    ])
