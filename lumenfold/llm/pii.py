"""Personal data by weak supervision, in expressions alone.

Four patterns give the base spans of a text, which always stay. A wider pattern gives candidates, on which
labelers vote: pattern checks, gazetteers (domains, address ranges, card issuers, calling codes, given
names, key prefixes), words of the context, neighbouring characters and variety. Candidates are counted by
kind, votes and features, a table whose size depends on these alphabets and not on the corpus. On it
expectation-maximisation estimates each labeler's reliability for each kind, and a logistic span classifier
is fitted to the posteriors by Newton steps; a step is one aggregation, of which only sums come to the
driver. Candidates that the classifier accepts are added where they meet no base span.

Patterns are possessive and begin only where a run of their characters begins, so that long runs cost linear
time and no stack; they match what the plain patterns match from left to right.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import drop_clashing, durable, read

BASE_KINDS, KINDS = ["email", "ip", "card", "phone"], ["email", "ip", "card", "phone", "name", "secret"]
VOTES = ["format", "gazetteer", "context", "neighbours", "variety"]
OWN = ["n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans"]

_C = r"[A-Za-z0-9._%+-]"
BASE_PATTERNS = {
    "email": rf"(?:\G|(?<!{_C})){_C}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ \-]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9\-]+[0-9]",
}
# Gazetteers and words of the context.
GIVEN_NAMES = "Alice Andrea Andrew Anna Anne Antonio Barbara Carlos Carmen Charles Christine Claire Claudia Daniel David Elena Elizabeth Emma Eric Felix Fernando Francois Frank George Hannah Hans Heinrich Helen Isabel Jack Jacques James Jean Jennifer Johann John Jorge Jose Joseph Juan Julia Karen Karl Katharina Klaus Laura Linda Lucia Luis Manuel Marco Margaret Maria Marie Mark Martin Mary Michael Miguel Monika Nathalie Nicolas Pablo Patricia Paul Pedro Peter Philippe Pierre Rachel Ricardo Richard Robert Rosa Sabine Sarah Sofia Sophie Stefan Stephen Susan Teresa Thomas Ursula Walter William Wolfgang".split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Mme Senor Senora Señor Señora Don Doña".split()
TOP_DOMAINS = "com org net edu gov mil int info biz io ai dev app co uk us ca au de at ch fr be es pt it nl eu pl se no dk fi ru cn jp kr in br mx ar example test".split()
KEY_PREFIXES = "AKIA ASIA ghp_ gho_ ghs_ xoxb- xoxp- sk_live_ sk_test_ glpat- AIza".split()
KEY_WORDS = "password passwd pwd secret token api_key api-key apikey access_key auth_key".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6011|65|64[4-9]|35|62)"
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-6][0-9]|35[0-9]|37[0-9]|38[0-9]|42[0-9]|50[0-9]|59[0-9]|67[0-9]|85[0-9]|88[0-9]|96[0-9]|97[0-9]|99[0-9])"
CUES = r"(?i)\b(?:e-?mail|mail|courriel|correo|contact|kontakt|phone|tel|telefon|téléphone|teléfono|mobile|handy|call|fax|card|karte|carte|tarjeta|visa|mastercard|ip|address|adresse|host|login|user|name|nom|nombre|password|passwd|pwd|secret|token|key|credential)s?\b[^\n]{0,24}$"
CONTRA = r"(?i)\b(?:version|isbn|issn|doi|page|seite|order|invoice|commit|sha|sha1|sha256|md5|uuid|build|serial|article|chapter|section|figure|table|total)\b[^\n]{0,16}$"

_WORD = r"\p{Lu}\p{Ll}++(?:['-]\p{Lu}\p{Ll}++)?"
_NAMES, _TITLES, _KEYS = "|".join(GIVEN_NAMES), "|".join(TITLES), "|".join(KEY_WORDS)
_EMAILS = [rf"(?<!{_C}){_C}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", rf"(?<!{_C}){_C}++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:[(\[]dot[)\]] ?|\.)[A-Za-z0-9-]++)++"]
_NUMBERS = [
    BASE_PATTERNS["ip"],
    BASE_PATTERNS["phone"],
    rf"(?=[{''.join(sorted({c for k in KEY_WORDS for c in (k[0], k[0].upper())}))}])(?i:{_KEYS})[\"']? {{0,3}}[=:] {{0,3}}[\"']?(?=[A-Za-z_+/=-]{{0,64}}+[0-9])[A-Za-z0-9_+/=-]{{8,}}+",
    rf"(?=[{''.join(sorted({k[0] for k in KEY_PREFIXES}))}])(?:{'|'.join(KEY_PREFIXES)})(?=[A-Za-z_-]{{0,64}}+[0-9])[A-Za-z0-9_-]{{12,}}+",
    r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])(?=[0-9_]*+[A-Za-z])[A-Za-z0-9_]{20,}+",
    r"(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{13,19}+)(?![0-9])",
    r"(?<![0-9+.(-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9])",
]
_PERSON = rf"(?=\p{{Lu}})(?:(?:{_TITLES})\b\.? {_WORD}(?: {_WORD})?|(?:{_NAMES}) {_WORD}(?: {_WORD})?)(?![\p{{L}}])"


def _apart(*looks: str) -> str:
    """None of the looks inside a word; what begins earlier, and of that what stands first here, takes its characters from the rest."""
    return r"(?:\G|(?<![\p{L}\p{N}]))(?:" + "|".join(looks) + ")"


#: What is searched for: (what a text must have, pattern) in order; the first whose need is met finds all that any of them could.
SEARCHES = {
    "email": [("@", BASE_PATTERNS["email"])],
    "ip": [("[0-9]", BASE_PATTERNS["ip"])],
    "card": [("[0-9]", BASE_PATTERNS["card"])],
    "phone": [(r"\+", BASE_PATTERNS["phone"])],
}
CANDIDATES = {"candidates": [("[0-9]", _apart(*_EMAILS, *_NUMBERS, _PERSON)), (r"[@(\[]", _apart(*_EMAILS, _PERSON)), (r"\p{Lu}", rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}]){_PERSON}")]}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits end in their check digit."""

    def add(total, i):
        d = F.ascii(F.substr(F.reverse(digits), i, F.lit(1))) - 48
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    n = F.length(digits)
    return F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def _octets(value: Column) -> Column:
    return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$")


def base_valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return _octets(value)
    n = F.length(_digits(value))
    return {"email": F.lit(True), "card": n.between(16, 19) & _luhn(_digits(value)), "phone": n.between(8, 15)}[kind]


def prefixes(numbers: Column, combine=lambda a, b: a + b, block: int = 512) -> Column:
    """Running combination of an array of longs that are 0 or more, in blocks, since an array that grows is copied at each step."""
    none = F.lit(0).cast("long")

    def running(x: Column) -> Column:
        zero = F.struct(none.alias("at"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(x, zero, lambda a, v: F.struct(combine(a["at"], v).alias("at"), F.concat(a["out"], F.array(combine(a["at"], v))).alias("out")), lambda a: a["out"])

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / block).cast("int")), lambda b: running(F.slice(numbers, b * block + 1, F.lit(block))))
    totals = F.transform(parts, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), none))
    before = F.concat(F.array(none), running(totals))
    joined = F.flatten(F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda p, o: F.transform(p, lambda v: combine(v, o))))
    return F.when(F.size(numbers) > 0, joined).otherwise(F.array().cast("array<long>"))


def located(df: DataFrame, text: str, searches: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """Adds for each name an array of its search's matches: start, end (code points, end exclusive), value, and up to 48 characters before and 24 after, as far as other matches."""
    t, names = F.col(text), df.columns
    hits, pieces = {}, {}
    for name, tries in searches.items():
        hit, piece = F, F
        for need, pattern in tries:
            hit = hit.when(t.rlike(need), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
            piece = piece.when(t.rlike(need), F.split(t, pattern, -1))
        hits[f"_h_{name}"], pieces[f"_p_{name}"] = hit.otherwise(F.array().cast("array<string>")), piece.otherwise(F.array(t))
    # Arrays that later steps use inside lambdas are columns used more than once, which Spark doesn't fold into the lambdas.
    df = df.select(*names, *[c.alias(n) for n, c in {**hits, **pieces}.items()])
    sized = {f"_s_{n}": F.zip_with(F.col(f"_h_{n}"), F.slice(F.col(f"_p_{n}"), F.lit(1), F.size(f"_h_{n}")), lambda h, p: (F.length(h) + F.length(p)).cast("long")) for n in searches}
    df = df.select("*", *[c.alias(n) for n, c in sized.items()])
    df = df.select("*", *[prefixes(F.col(f"_s_{n}")).alias(f"_e_{n}") for n in searches])
    out = []
    for n in searches:
        h, p, e = F.col(f"_h_{n}"), F.col(f"_p_{n}"), F.col(f"_e_{n}")
        around = F.zip_with(F.slice(p, F.lit(1), F.size(h)), F.slice(p, F.lit(2), F.size(h)), lambda x, y: F.struct(F.right(x, F.lit(48)).alias("before"), F.left(y, F.lit(24)).alias("after")))
        ranges = F.zip_with(h, e, lambda v, z: F.struct((z - F.length(v)).alias("start"), z.alias("end"), v.alias("value")))
        out.append(F.zip_with(ranges, around, lambda r, a: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["value"].alias("value"), a["before"].alias("before"), a["after"].alias("after"))).alias(n))
    return df.select(*names, *out)


def shaped(c: Column) -> Column:
    """A candidate with its kind, from the look of its value (null: none), and its own part of the value: of an assignment that is what is assigned."""
    v = c["value"]
    n = F.length(_digits(v))
    kind = (
        F.when(v.rlike(r"^[^@]+@") | v.rlike(r"[(\[]at[)\]]"), "email")
        .when(v.rlike(rf"^(?i:{_KEYS})[\"']? *[=:]") | v.rlike(rf"^(?:{'|'.join(KEY_PREFIXES)})"), "secret")
        .when(v.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), "ip")
        .when(v.rlike(r"^[+]"), "phone")
        .when(v.rlike(r"^[0-9 -]+$") & (n >= 13), "card")
        .when(v.rlike(r"^[0-9(][0-9 ().-]+$"), "phone")
        .when(v.rlike(r"^\p{Lu}\p{Ll}+\.? "), "name")
        .otherwise("secret")
    )
    own = F.when(kind == "secret", F.regexp_replace(v, rf"^(?i:{_KEYS})[\"']? *[=:] *[\"']?", "")).otherwise(v)
    return F.struct(kind.alias("kind"), (c["end"] - F.length(own)).alias("start"), c["end"].alias("end"), own.alias("value"), F.right(F.concat(c["before"], F.substr(v, F.lit(1), F.length(v) - F.length(own))), F.lit(48)).alias("before"), c["after"].alias("after"))


def _varied(value: Column) -> Column:
    return F.size(F.array_distinct(F.split(value, "")))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(c: Column) -> dict[str, Column]:
    """1 (personal), -1 (not) or 0 (no opinion) of each labeler on a shaped candidate."""
    kind, v, before, after = c["kind"], c["value"], c["before"], c["after"]
    digits = _digits(v)
    n = F.length(digits)
    assigned = before.rlike(rf"(?i)(?:{_KEYS})[\"']? *[=:] *[\"']?$")
    known = v.rlike(rf"^(?:{'|'.join(KEY_PREFIXES)})")
    mixed = v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    of = lambda cases: F.coalesce(*[F.when(kind == k, x) for k, x in cases.items()], F.lit(0))
    none = F.lit(False)
    cue, contra = before.rlike(CUES), before.rlike(CONTRA)
    left, right = F.right(before, F.lit(1)), F.left(after, F.lit(1))
    glued = left.rlike(r"[\p{L}\p{N}_%/\\]") | right.rlike(r"[\p{L}\p{N}_@/\\]")
    return {
        "format": of({"email": F.lit(1), "ip": _vote(_octets(v), ~_octets(v)), "card": _vote(_luhn(digits), ~_luhn(digits)), "phone": _vote(v.startswith("+") & n.between(8, 15), ~n.between(8, 15)), "name": _vote(v.rlike(rf"^(?:{_TITLES})\b"), none), "secret": _vote(known | (assigned & mixed), none)}),
        "gazetteer": of({"email": _vote(F.lower(F.substring_index(v, ".", -1)).isin(TOP_DOMAINS), F.lit(True)), "ip": _vote(~v.rlike(r"^0*(?:0|127|22[4-9]|2[3-5][0-9])\."), F.lit(True)), "card": _vote(digits.rlike(ISSUERS), F.lit(True)), "phone": _vote(F.regexp_replace(v, "[ ().-]+", "").rlike(CALLING), v.startswith("+")), "name": _vote(v.rlike(rf"(?:^|[ ])(?:{_NAMES})(?: |$)"), none), "secret": _vote(known, none)}),
        "context": _vote(cue, contra),
        "neighbours": _vote(none, glued),
        "variety": of({"email": _vote(none, F.length(F.substring_index(v, "@", 1)) > 64), "ip": _vote(none, _varied(v) < 3), "card": _vote(none, _varied(digits) < 4), "phone": _vote(none, _varied(digits) < 3), "name": _vote(none, F.length(v) > 40), "secret": _vote(none, (_varied(v) < 8) | ~mixed | (F.length(v) < 12))}),
    }


def features(c: Column) -> list[Column]:
    """The classifier's features of a shaped candidate, each 0 or 1: one for each kind, then looks and surroundings."""
    kind, v, before, after = c["kind"], c["value"], c["before"], c["after"]
    looks = [
        F.right(before, F.lit(1)).rlike(r"[\p{L}\p{N}_%/\\]") | F.left(after, F.lit(1)).rlike(r"[\p{L}\p{N}_@/\\]"),
        F.right(before, F.lit(2)).rlike(r"[:=\"']"),
        before.rlike(CUES),
        before.rlike(CONTRA),
        v.rlike("[A-Za-z]") & (_varied(v) >= 10),
        _varied(v) <= 3,
        F.length(v) >= 18,
        v.rlike(r"[ ().-]"),
        v.rlike(r"^[A-Z0-9]+$") & v.rlike("[A-Z]"),
        F.when(kind == "card", _luhn(_digits(v))).when(kind == "ip", _octets(v)).when(kind == "phone", v.startswith("+")).otherwise(F.lit(False)),
        F.when(kind == "card", ~_luhn(_digits(v))).when(kind == "ip", ~_octets(v)).otherwise(F.lit(False)),
    ]
    return [F.when(kind == k, 1).otherwise(0) for k in KINDS] + [F.when(x, 1).otherwise(0) for x in looks]


N_FEATURES = len(KINDS) + 11


def patterns_of(df: DataFrame, array: str) -> DataFrame:
    """(kind, votes, features, n) of all candidates in df's array column of shaped candidates."""
    c = df.select(F.explode(array).alias("c")).where("c.kind is not null")
    seen = c.select(F.col("c.kind").alias("kind"), F.array(*votes(F.col("c")).values()).alias("votes"), F.array(*features(F.col("c"))).alias("features"))
    return seen.groupBy("kind", "votes", "features").agg(F.count("*").alias("n"))


@dataclass
class Reliabilities:
    """Of each kind: the share of personal candidates, and P(vote | personal) and P(vote | not) of each labeler."""

    prior: dict[str, float]
    chance: dict[tuple[str, int, int], tuple[float, float]]

    def posterior(self, kind: Column, given: Column) -> Column:
        odds = F.create_map(*[F.lit(x) for k, p in self.prior.items() for x in (k, math.log(p / (1 - p)))])
        weight = F.create_map(*[F.lit(x) for (k, j, v), (p, q) in self.chance.items() for x in (f"{k} {j} {v}", math.log(p / q))])
        total = F.element_at(odds, kind)
        for j in range(len(VOTES)):
            total = total + F.element_at(weight, F.concat_ws(" ", kind, F.lit(j), F.get(given, F.lit(j))))
        return 1 / (1 + F.exp(-total))


#: What is assumed before any candidate is seen, as counts: of personal candidates a labeler has approved 6, passed 3 and refused 1, and of others the reverse.
ASSUMED = {1: (6.0, 1.0), 0: (3.0, 3.0), -1: (1.0, 6.0)}


def estimated(patterns: DataFrame, rounds: int = 12) -> Reliabilities:
    """Expectation-maximisation over the counted patterns, from the format's vote or else the majority; each round is one aggregation to a row for each kind, labeler and vote."""
    votes_sum = F.aggregate("votes", F.get("votes", F.lit(0)) * len(VOTES), lambda a, v: a + v)
    q = F.when(votes_sum > 0, 0.9).when(votes_sum < 0, 0.1).otherwise(0.5)
    for _ in range(rounds):
        cast = patterns.select("kind", "n", q.alias("q"), F.posexplode("votes").alias("j", "v"))
        sums = {(r["kind"], r["j"], r["v"]): (r["yes"], r["n"]) for r in cast.groupBy("kind", "j", "v").agg(F.sum(F.col("n") * F.col("q")).alias("yes"), F.sum("n").alias("n")).collect()}
        prior, chance = {}, {}
        for k in KINDS:
            yes, total = (sum(sums.get((k, 0, v), (0.0, 0))[i] for v in ASSUMED) for i in (0, 1))
            prior[k] = (yes + 5) / (total + 10)
            for j in range(len(VOTES)):
                for v, (a, b) in ASSUMED.items():
                    y, n = sums.get((k, j, v), (0.0, 0))
                    chance[k, j, v] = ((y + a) / (yes + 10), (n - y + b) / (total - yes + 10))
        model = Reliabilities(prior, chance)
        q = model.posterior(F.col("kind"), F.col("votes"))
    return model


def _solved(a: list[list[float]], b: list[float]) -> list[float]:
    """x of a x = b, for a symmetric positive definite matrix."""
    a, b, n = [row[:] for row in a], b[:], len(b)
    for i in range(n):
        for k in range(i + 1, n):
            f = a[k][i] / a[i][i]
            for j in range(i, n):
                a[k][j] -= f * a[i][j]
            b[k] -= f * b[i]
    x = [0.0] * n
    for i in reversed(range(n)):
        x[i] = (b[i] - sum(a[i][j] * x[j] for j in range(i + 1, n))) / a[i][i]
    return x


def classifier(patterns: DataFrame, model: Reliabilities, rounds: int = 8, ridge: float = 1.0) -> list[float]:
    """Weights of a logistic classifier of features, fitted to the posteriors by Newton steps with a ridge; each is one aggregation to a row for each two features."""
    known = durable(patterns.select("features", "n", model.posterior(F.col("kind"), F.col("votes")).alias("q")))
    on = F.filter(F.sequence(F.lit(0), F.lit(N_FEATURES - 1)), lambda i: F.get("features", i) == 1)
    w = [0.0] * N_FEATURES
    for _ in range(rounds):
        scored = known.withColumn("p", scored_by(w, F.col("features"))).withColumn("i", F.explode(on)).withColumn("j", F.explode(on))
        sums = scored.groupBy("i", "j").agg(F.sum(F.col("n") * (F.col("q") - F.col("p"))).alias("slope"), F.sum(F.col("n") * F.col("p") * (1 - F.col("p"))).alias("bend")).collect()
        slope, bend = [-ridge * x for x in w], [[ridge * (i == j) for j in range(N_FEATURES)] for i in range(N_FEATURES)]
        for r in sums:
            bend[r["i"]][r["j"]] += r["bend"]
            if r["i"] == r["j"]:
                slope[r["i"]] += r["slope"]
        w = [x + max(-4.0, min(4.0, d)) for x, d in zip(w, _solved(bend, slope), strict=True)]
    return w


def scored_by(w: list[float], given: Column) -> Column:
    total = F.aggregate(F.zip_with(given, F.array(*[F.lit(x) for x in w]), lambda f, x: f * x), F.lit(0.0), lambda a, x: a + x)
    return 1 / (1 + F.exp(-total))


def _texts(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def find_personal(docs: DataFrame, text: str = "text", threshold: float = 0.5, keep_text: bool = False) -> DataFrame:
    """docs without the text (unless keep_text), with n_email, n_ip, n_card and n_phone (base spans, long), base_spans and spans (arrays of kind:start:end) appended.

    spans: the base spans and the candidates that the classifier scores at threshold or more and that meet no
    base span; kinds as in KINDS, by start within a kind. Null and empty texts have none. Texts are read whole,
    however long, and once: what is found in them is a durable table. Repeated rows count as often as they stand
    there. Empty table: no rows. Input columns with an output's name are replaced.
    """
    docs = drop_clashing(docs, [n for n in OWN if n != text])
    names = [c for c in docs.columns if keep_text or c != text]
    plain = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    valid = lambda k: F.filter(k, lambda s: base_valid(k, s["value"]))
    df = located(plain, "_text", {**SEARCHES, **CANDIDATES})
    df = durable(df.select(*plain.columns[:-1], *[F.transform(valid(k), _range).alias(k) for k in BASE_KINDS], F.transform("candidates", shaped).alias("_c")))
    patterns = durable(patterns_of(df, "_c").coalesce(1))
    w = classifier(patterns, estimated(patterns))

    df = apart(df.withColumn("_c", F.filter("_c", lambda c: scored_by(w, F.array(*features(c))) >= threshold)), "_c", BASE_KINDS)
    df = df.select("*", *[F.transform(F.filter("_c", lambda c: c["kind"] == k), _range).alias(f"_x_{k}") for k in KINDS])
    base = {k: _texts(F.col(k), k) for k in BASE_KINDS}
    every = [_texts(F.sort_array(F.concat(k, f"_x_{k}")) if k in base else F.col(f"_x_{k}"), k) for k in KINDS]
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return df.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(names)], *counts, F.concat(*base.values()).alias("base_spans"), F.concat(*every).alias("spans"))


def apart(df: DataFrame, extra: str, base: list[str]) -> DataFrame:
    """df with only those spans in its array column `extra` that meet no span of the base columns. Sorted by start, a span meets none if those before it end by its start and the next one starts at its end or later; this takes n log n."""
    far = (1 << 62) - 1
    one = lambda s, kind, own: F.struct(s["start"].cast("long").alias("start"), F.lit(own).alias("base"), s["end"].cast("long").alias("end"), kind.alias("kind"))
    all_of = F.sort_array(F.concat(F.transform(F.concat(*base), lambda s: one(s, F.lit(None).cast("string"), 1)), F.transform(extra, lambda s: one(s, s["kind"], 0))))
    df = df.withColumn("_all", F.when((F.size(extra) > 0) & (F.size(F.concat(*base)) > 0), all_of))
    df = df.withColumn("_ends", F.transform("_all", lambda s: F.when(s["base"] == 1, s["end"]).otherwise(0).cast("long"))).withColumn("_next", F.reverse(F.transform("_all", lambda s: F.when(s["base"] == 1, far - s["start"]).otherwise(0).cast("long"))))
    limits = F.zip_with(prefixes(F.col("_ends"), F.greatest), F.reverse(prefixes(F.col("_next"), F.greatest)), lambda e, n: F.struct(e.alias("end"), (far - n).alias("next")))
    free = F.filter(F.zip_with("_all", limits, lambda s, x: F.when((s["base"] == 0) & (x["end"] <= s["start"]) & (x["next"] >= s["end"]), s)), lambda s: s.isNotNull())
    kept = F.transform(F.coalesce(free, F.transform(extra, lambda s: one(s, s["kind"], 0))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return df.withColumn(extra, kept).drop("_all", "_ends", "_next")


def _range(s: Column) -> Column:
    return F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))


def op12_pii(spark, sf_dir):
    out = find_personal(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.array_join("base_spans", ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"))
