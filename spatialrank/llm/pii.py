"""Personal data by weak supervision, with DataFrame functions only.

Candidates are the spans of the base patterns and looser ones, for each kind: matches of a base pattern that fail its
check, e-mail and IP addresses with their signs spelled out or bracketed, card numbers with other separators, telephone
numbers without a country code.  A looser candidate that overlaps a base span is no candidate.  Five labelers vote on
each, for, against or not at all:

* base: for the spans of the base patterns; on looser ones it doesn't vote
* check: what can be tested on the digits and parts (Luhn, parts up to 255, area codes)
* gazetteer: top-level domains, card issuers' prefixes, country codes, private networks
* context: the words before it, for (call, card, host) or against (order, serial, version)
* shape: lengths and separators

Expectation-maximisation over the counts of vote patterns gives each labeler's reliability: the chance that it votes for,
where it votes, if the span is personal data and if it isn't.  Reliabilities are shared by all kinds; a labeler that
doesn't vote says nothing.  A prior on them (``PRIOR`` votes that labelers are right four times in five) tells which of
the two classes is personal data.  Base and looser spans of each kind have shares of their own.  With the chances
as soft labels a logistic classifier is trained on the spans' features.  Spans of the base patterns always stay; a looser one is
added where the classifier gives ``THRESHOLD`` or more.

The texts are read once: what they hold goes to the shared folder as small arrays.  Vote patterns and feature
combinations are few (some hundreds, whatever the corpus is), so their counts go to the driver, which fits the
models in plain Python.

Base matches are leftmost and non-overlapping per kind.  The patterns used here match the same spans as the
contract's, written so that no long text makes them backtrack or recurse.  Null texts are empty; repeated rows
are reported each; very long texts are read whole; an empty table gives no rows; other columns of the table aren't read.
Equal starts are ordered by kind as listed, then by end.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("base", "check", "gazetteer", "context", "shape")
THRESHOLD, PRIOR = 0.5, 20.0
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|@)[\])]\x20?[A-Za-z0-9-]{1,64}+(?:(?:\.|\x20?[\[(](?:dot|\.)[\])]\x20?)[A-Za-z0-9-]{1,64}+){1,8}",
    "ip": r"(?<![0-9.\]])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20dot\x20)[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9./_])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9./_])",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9]|[.-][0-9])",
}
#: What must be in a text for a pattern to match: a cheap test first.
_NEEDS = {"email": ["@"], "ip": ["."], "card": [], "phone": ["+"], "loose_email": ["(", "["], "loose_ip": ["[", "(", " dot "], "loose_card": [], "loose_phone": []}
#: Gazetteers and words before a span (fixed values).
DOMAINS = ["com", "org", "net", "edu", "gov", "int", "info", "biz", "io", "co", "eu", "uk", "us", "de", "fr", "es", "it", "nl", "ch", "at", "be", "pt", "mx", "ar", "br", "ca", "au", "jp"]
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|30[0-5]|3[689]|6011|65|35|62|50|5[6-9]|6[0-9])"
COUNTRIES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
PRIVATE = r"^(?:10|127|169\.254|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168|0|2[2-5][0-9])\."
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|address|correo|courriel|kontakt)[^A-Za-z]*(?:\w+[^A-Za-z]+){0,3}$",
    "ip": r"(?i)(?:\bip\b|host|server|address|router|login|from)[^A-Za-z]*(?:\w+[^A-Za-z]+){0,3}$",
    "card": r"(?i)(?:card|visa|master|amex|credit|debit|pay|tarjeta|carte|karte)[^A-Za-z]*(?:\w+[^A-Za-z]+){0,3}$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|whatsapp|sms|ring)[^A-Za-z]*(?:\w+[^A-Za-z]+){0,3}$",
}
#: Words before a number that is something else (fixed values).
OTHERWISE = r"(?i)(?:order|invoice|serial|part|sku|isbn|issn|doi|version|lot|ref|item|model|ticket|build|section)[^A-Za-z]*(?:\w+[^A-Za-z]+){0,2}$"
_SPAN = "struct<start:int,kind:int,end:int,word:string>"


def _occurrences(text: Column, pattern: str, matches: Column, kind: int) -> Column:
    """start, kind, end and word of each match: what lies between the matches gives their places."""
    gaps = F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(matches), F.lit(1)))
    sizes = F.zip_with(gaps, matches, lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("size"), m.alias("word")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(held: Column, x: Column) -> Column:
        begin = held["at"] + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + x["size"]).alias("end"), x["word"].alias("word"))
        return F.struct((begin + x["size"]).alias("at"), F.concat(held["out"], F.array(span)).alias("out"))

    return F.when(F.size(matches) > 0, F.aggregate(sizes, start, step, lambda held: held["out"])).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def weight(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).try_cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + weight(i)) % 10 == 0


def _part_ok(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda w: F.lit(True),
    "ip": lambda w: F.forall(F.split(w, r"\."), _part_ok),
    "card": lambda w: F.when(F.length(_digits(w)).between(12, 19), luhn(_digits(w))).otherwise(F.lit(False)),
    "phone": lambda w: F.length(_digits(w)).between(9, 15),
}


def _votes(text: Column, span: Column, kind: str, base: Column) -> Column:
    """The votes (0 against, 1 none, 2 for) as digits of base 3, and the features as one number: the votes of all labelers
    but ``base``, and whether a letter or digit touches the span."""
    word, figures = span["word"], _digits(span["word"])
    digits = F.length(figures)
    before = F.substring(text, F.greatest(span["start"] - 39, F.lit(1)), F.least(span["start"], F.lit(40)))
    vote = lambda good, bad=F.lit(False): F.when(good, 2).when(bad, 0).otherwise(1)
    parts = F.split(F.regexp_replace(word, r"[^0-9]+", "."), r"\.")
    sound = {
        "email": F.lit(1),
        "ip": F.when(F.forall(parts, _part_ok), 2).otherwise(0),
        "card": F.when(digits.between(12, 19) & luhn(figures), 2).otherwise(0),
        "phone": F.when(base, 2).when(digits != 10, 0).otherwise(vote(figures.rlike("^[2-9][0-9]{2}[2-9]"), figures.rlike("^[01]"))),
    }[kind]
    gazetteer = {
        "email": vote(F.lower(F.regexp_extract(word, r"([A-Za-z0-9-]+)[^A-Za-z0-9-]*$", 1)).isin(DOMAINS)),
        "ip": vote(~word.rlike(PRIVATE), word.rlike(PRIVATE)),
        "card": vote(figures.rlike(ISSUERS), ~figures.rlike(ISSUERS)),
        "phone": vote(word.rlike(COUNTRIES)),
    }[kind]
    shape = {
        "email": vote(F.length(word).between(6, 80), ~F.length(word).between(6, 80)),
        "ip": vote(~word.rlike(r"(?:^|[^0-9])0[0-9]"), word.rlike(r"(?:^|[^0-9])0[0-9]")),
        "card": vote(digits.between(14, 16), ~digits.between(13, 19)),
        "phone": vote(digits.between(10, 13) & (base | word.rlike(r"^\(|([\x20.-])[0-9]{3}\1")), ~digits.between(9, 15)),
    }[kind]
    context = vote(F.coalesce(before.rlike(CONTEXT[kind]), F.lit(False)), F.coalesce(before.rlike(OTHERWISE), F.lit(False)))
    features = sound + gazetteer * 3 + context * 9 + shape * 27
    touched = F.when(F.coalesce(before.rlike(r"\w$"), F.lit(False)), 81).otherwise(0)
    votes = F.when(base, 2).otherwise(1) + features * 3
    return F.struct(span["start"].alias("start"), span["kind"].alias("kind"), span["end"].alias("end"), base.alias("base"), votes.cast("int").alias("votes"), (features + touched).cast("int").alias("features"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and the array of its candidate spans with votes and features."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    none = F.array().cast("array<string>")
    patterns = {**BASE, **{f"loose_{k}": p for k, p in LOOSE.items()}}

    def found(name: str, pattern: str) -> Column:
        whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        if not _NEEDS[name]:
            return whole.alias(name)
        needed = F.lit(False)
        for sign in _NEEDS[name]:
            needed |= F.contains(F.col("text"), F.lit(sign))
        return F.when(needed, whole).otherwise(none).alias(name)

    # a projection of its own, so that no pattern is run twice
    matched = rows.select("doc_id", "text", *(found(n, p) for n, p in patterns.items()))

    none_yet = F.array().cast("array<struct<start:int,kind:int,end:int,word:string,base:boolean>>")

    def spans(name: str, pattern: str) -> Column:
        kind = name.removeprefix("loose_")
        places = _occurrences(F.col("text"), pattern, F.col(name), KINDS.index(kind))
        sound = (lambda w: F.lit(False)) if name.startswith("loose_") else lambda w: F.coalesce(CHECKS[kind](w), F.lit(False))
        told = F.transform(places, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["word"].alias("word"), sound(x["word"]).alias("base")))
        # matches that fail by far aren't candidates
        near = {"email": lambda d: F.lit(True), "ip": lambda d: d <= 15, "card": lambda d: d.between(12, 19), "phone": lambda d: d.between(7, 18)}[kind]
        return F.when(F.size(name) > 0, F.filter(told, lambda x: x["base"] | near(F.length(_digits(x["word"]))))).otherwise(none_yet)

    found_all = matched.select("doc_id", "text", F.concat(*(spans(n, p) for n, p in patterns.items())).alias("found"))
    sure = F.filter("found", lambda x: x["base"]).alias("sure")
    loose = F.filter("found", lambda x: ~x["base"]).alias("loose")
    parted = found_all.select("doc_id", "text", sure, loose)
    # a looser one that overlaps a base span goes before any vote
    apart = lambda x: ~F.exists("sure", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    parted = parted.select("doc_id", "text", F.concat("sure", F.filter("loose", apart)).alias("found"))

    def judged(k: int) -> Column:
        return F.transform(F.filter("found", lambda x: x["kind"] == k), lambda x: _votes(F.col("text"), x, KINDS[k], x["base"]))

    return parted.select("doc_id", F.array_sort(F.concat(*map(judged, range(len(KINDS))))).alias("spans"))


def reliabilities(counts: dict[tuple[tuple[int, bool], int], float], labelers: int = len(LABELERS), rounds: int = 100) -> tuple[dict[tuple[tuple[int, bool], int], float], list[tuple[float, float]]]:
    """The chance that each (group, vote pattern) is positive and, for each labeler, the chance of a vote for
    where the span is positive and where it isn't, by expectation-maximisation.

    A group is a kind and whether the span is a base one; each has a share of positives of its own.  Votes are
    independent given the truth.
    """
    digits = {key: [key[1] // 3**j % 3 for j in range(labelers)] for key in counts}
    right = [(0.8, 0.2)] * labelers
    shares = {group: 0.9 if group[1] else 0.3 for group, _ in counts}
    chance: dict[tuple[tuple[int, bool], int], float] = {}
    for _ in range(rounds):
        for key, ds in digits.items():
            odds = math.log(shares[key[0]] / (1 - shares[key[0]]))
            for (p, q), d in zip(right, ds, strict=True):
                odds += math.log(p / q) if d == 2 else math.log((1 - p) / (1 - q)) if d == 0 else 0.0
            chance[key] = 1 / (1 + math.exp(-max(-40, min(40, odds))))
        for group in shares:
            n = sum(c for key, c in counts.items() if key[0] == group)
            shares[group] = (sum(c * chance[key] for key, c in counts.items() if key[0] == group) + 10 * (0.9 if group[1] else 0.3)) / (n + 10)
        for j in range(labelers):
            held = [0.8 * PRIOR, 0.2 * PRIOR, 0.2 * PRIOR, 0.8 * PRIOR]
            for key, c in counts.items():
                d = digits[key][j]
                if d != 1:
                    held[0 if d == 2 else 1] += c * chance[key]
                    held[2 if d == 2 else 3] += c * (1 - chance[key])
            right[j] = held[0] / (held[0] + held[1]), held[2] / (held[2] + held[3])
    return chance, right


def classifier(rows: list[tuple[int, int, float, float]], rounds: int = 400, rate: float = 2.0) -> dict[tuple[int, int], float]:
    """Chance of each (kind, features), by logistic regression on (kind, features, soft label, count); a vote counts alike
    in all kinds.  Each kind has the same weight, as spans of one may outnumber those of another."""

    def active(kind: int, f: int) -> list[str]:
        return [f"k{kind}", *(f"v{j}{f // 3**j % 3}" for j in range(4) if f // 3**j % 3 != 1), *(["touched"] if f >= 81 else [])]

    weights: dict[str, float] = {}
    total: dict[int, float] = {}
    for kind, _, _, n in rows:
        total[kind] = total.get(kind, 0.0) + n
    for _ in range(rounds):
        slopes: dict[str, float] = {}
        for kind, f, y, n in rows:
            names = active(kind, f)
            z = sum(weights.get(a, 0.0) for a in names)
            slope = (1 / (1 + math.exp(-max(-40, min(40, z)))) - y) * n / total[kind] / len(total)
            for a in names:
                slopes[a] = slopes.get(a, 0.0) + slope
        for a, s in slopes.items():
            weights[a] = weights.get(a, 0.0) - rate * (s + 1e-4 * weights.get(a, 0.0))
    return {(k, f): 1 / (1 + math.exp(-sum(weights.get(a, 0.0) for a in active(k, f)))) for k, f, _, _ in rows}


def detect(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, ``base`` and ``added``: arrays of (start, kind, end), kinds numbered as in ``KINDS``."""
    held = scratch.materialize(candidates(docs), "spans")
    each = held.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.base", "s.votes", "s.features").count().collect()
    counts: dict[tuple[tuple[int, bool], int], float] = {}
    for r in each:
        key = (r.kind, r.base), r.votes
        counts[key] = counts.get(key, 0.0) + r["count"]
    chance, _ = reliabilities(counts)
    rows = [(r.kind, r.features, chance[(r.kind, r.base), r.votes], float(r["count"])) for r in each]
    taken = sorted(kind * 1000 + f for (kind, f), p in classifier(rows).items() if p >= threshold)
    good = lambda s: (s["kind"] * 1000 + s["features"]).isin(taken)
    slim = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    base = F.transform(F.filter("spans", lambda s: s["base"]), slim)
    added = F.transform(F.filter("spans", lambda s: ~s["base"] & good(s)), slim)
    return held.select("doc_id", base.alias("base"), added.alias("added"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, by start and then kind."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The counts, the base spans' hash and all spans of each row."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", "added")).alias("spans"))
