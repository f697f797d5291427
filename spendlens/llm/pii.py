"""Personal data by candidate gradient boosting.

Base patterns give sure spans. Loose generators propose further, overlapping spans; boosted trees judge each by
its format and the words around it, and a threshold per kind (a spelt "at" has its own), calibrated on rows kept
out of the fit, selects. Labels come from the base spans of all documents: as they are and respelled the way people hide or shorten
them they are positive; dates, versions, amounts and numbers that fail the checks, put in the same places, are
negative, and so are candidates that a check proves wrong. Its other candidates may be personal data
that someone hid or shortened, so they have no label. Everything but the fit is column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.registry import query, table
from spendlens.llm.trees import Boosted, fit
from spendlens.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.99  # least share of right choices among held-out candidates over a kind's threshold
LEAST = 20  # held-out positives without which a kind's threshold is out of reach
ROUNDS = 32  # trees
CHUNK = 256
NEAR = 24

# Each equals its plain pattern on all texts; possessive forms and look-behinds only spare tries that cannot match.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
_AT = r"\x20?(?:@|\(at\)|\[at\]|\{at\})\x20?"
_DOT = r"(?:\.|\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?|\x20dot\x20)"
_SPELT = r"(?i)\x20at\x20"
_USER = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+"
_HOST = rf"[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{2,63}}+){{1,6}}"
# Generators: kind, pattern, and what a text must hold to be scanned. The spelt "at" has its own, as an "at" before
# an address would take part of it.
LOOSE = {
    "sign": ("email", _USER + _AT + _HOST, r"(?i)@|[(\[{]at[)\]}]"),
    "spelt": ("email", rf"{_USER}\x20at\x20{_HOST}", r"(?i)\x20at\x20"),
    "ip": ("ip", r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}){3}(?![0-9A-Za-z])", r"[0-9]"),
    "card": ("card", r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20._/-]{1,3}[0-9]{4}){2}[\x20._/-]{1,3}[0-9]{1,7}(?![0-9A-Za-z])", r"[0-9]{4}"),
    "phone": (
        "phone",
        r"(?<![0-9A-Za-z+(.,-])(?:00\x20?[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?(?:[\x20./-]{1,2}[0-9]{2,4}){1,4}(?![0-9A-Za-z])",
        r"[0-9]{2}",
    ),
}
_CUES = {
    "cue_mail": r"(?i)mail|contact|kontakt|correo|courriel|write|reach",
    "cue_phone": r"(?i)tel|phone|call|fax|mobil|ruf|llam|appel|whatsapp|dial",
    "cue_card": r"(?i)card|visa|carte|tarjeta|karte|amex|master|debit|credit|paid",
    "cue_net": r"(?i)\bip\b|host|server|addr|client|login",
    "cue_other": r"(?i)version|release|isbn|issn|doi|date|order|ref|invoice|page|vol|\bno\.?$|#$|=$|[$€£]$|\bv$",
}
# Words that made rows are placed behind.
LEADS = ("mail me", "contact", "reach", "call", "tel", "phone", "card", "paid by", "host", "server", "the", "and", "see", "version")
_SPAN = "array<struct<kind: string, start: int, stop: int, value: string, before: string, after: string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0)


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(_OCTETS)
    n = F.length(_digits(value))
    return n.between(13, 19) & luhn(_digits(value)) if kind == "card" else n.between(9, 15)


def of_kind(spans: Column | str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _holding(kind: str) -> Column:
    return F.filter(f"_b_{kind}", lambda s: _valid(kind, s["value"]))


def _positions(kind: str, text: Column, values: Column, gaps: Column) -> Column:
    """Spans from the matches and the lengths of the pieces between them, CHUNK at a time so that appending to
    a list stays cheap however many there are."""
    n = F.size(values)

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.get(gaps, i)
        value = F.get(values, i)
        span = F.struct(start.alias("start"), (start + F.length(value)).alias("stop"), value.alias("value"))
        return F.struct((start + F.length(value)).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    none = F.array().cast("array<struct<start: int, stop: int, value: string>>")

    def chunk(acc: Column, c: Column) -> Column:
        last = F.least(n, (c + 1) * CHUNK) - 1
        begin = F.struct(acc["at"].alias("at"), none.alias("spans"))
        done = F.aggregate(F.sequence(c * CHUNK, last), begin, step)
        return F.transform(
            F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(acc["lists"], F.array(d["spans"])).alias("lists"))
        )[0]

    lists = F.array().cast("array<array<struct<start: int, stop: int, value: string>>>")
    zero = F.struct(F.lit(0).alias("at"), lists.alias("lists"))
    chunks = F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))
    spans = F.flatten(F.aggregate(chunks, zero, chunk, lambda acc: acc["lists"]))
    around = F.transform(
        spans,
        lambda s: F.struct(
            F.lit(kind).alias("kind"),
            s["start"].alias("start"),
            s["stop"].alias("stop"),
            s["value"].alias("value"),
            F.substring(
                text, F.greatest(s["start"] - NEAR, F.lit(0)) + 1, F.least(s["start"], F.lit(NEAR))
            ).alias("before"),
            F.substring(text, s["stop"] + 1, F.lit(NEAR)).alias("after"),
        ),
    )
    return F.when(n > 0, around).otherwise(F.array().cast(_SPAN))


def _located(df: DataFrame, name: str, kind: str, pattern: str, guard: Column) -> DataFrame:
    """Adds the array of a pattern's leftmost non-overlapping matches in the column `_text`."""
    text, found, gaps = F.col("_text"), f"_{name}_found", f"_{name}_gaps"
    none = F.array().cast("array<string>")
    df = df.withColumn(found, F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    df = df.withColumn(gaps, F.when(F.size(found) > 0, pieces).otherwise(F.array().cast("array<int>")))
    return df.withColumn(name, _positions(kind, text, F.col(found), F.col(gaps))).drop(found, gaps)


def _with_candidates(docs: DataFrame, text: str) -> DataFrame:
    """All columns plus `_text`, `_base` (spans that hold) and `_loose` (candidates off the base spans; those of
    different generators may overlap)."""
    df = docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    guards = {"email": F.contains("_text", F.lit("@")), "phone": F.contains("_text", F.lit("+"))}
    for kind in KINDS:
        guard = guards.get(kind, F.col("_text").rlike("[0-9]"))
        df = _located(df, f"_b_{kind}", kind, BASE[kind], guard)
    for name, (kind, pattern, holds) in LOOSE.items():
        df = _located(df, f"_l_{name}", kind, pattern, F.col("_text").rlike(holds))
    sure = F.concat(*[_holding(k) for k in KINDS])
    df = df.withColumn("_base", sure).withColumn("_all", F.concat(*[F.col(f"_l_{name}") for name in LOOSE]))
    off = F.filter(
        "_all", lambda c: ~F.exists("_base", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))
    )
    return df.withColumn("_loose", off).drop("_all", *[f"_b_{k}" for k in KINDS], *[f"_l_{name}" for name in LOOSE])


def _features(kind: Column, value: Column, before: Column, after: Column) -> dict[str, Column]:
    """Format and context of a candidate, as doubles."""

    def count(pattern: str) -> Column:
        return F.length(value) - F.length(F.regexp_replace(value, pattern, ""))

    def flag(column: Column) -> Column:
        return F.coalesce(column.cast("int"), F.lit(0))

    digits = _digits(value)
    groups = F.filter(F.split(value, "[^0-9]+"), lambda g: g != "")
    near = F.regexp_replace(before, r"^\S*\s", "")
    out = {f"is_{k}": flag(kind == k) for k in KINDS}
    out |= {
        "digits": F.length(digits),
        "letters": count("[A-Za-z]"),
        "length": F.length(value),
        "groups": F.size(groups),
        "first_group": F.coalesce(F.length(F.get(groups, F.lit(0))), F.lit(0)),
        "last_group": F.coalesce(F.length(F.try_element_at(groups, F.lit(-1))), F.lit(0)),
        "spaces": count(r"\s"),
        "dots": count(r"\."),
        "dashes": count("-"),
        "slashes": count("[/_]"),
        "brackets": count(r"[()\[\]{}]"),
        "has_at": flag(value.rlike("@")),
        "hidden_at": flag(value.rlike(r"(?i)[(\[{]at[)\]}]")),
        "hidden_dot": flag(value.rlike(r"(?i)[(\[{](dot|\.)[)\]}]")),
        "spelt_at": flag(value.rlike(_SPELT)),
        "last_word": F.length(F.regexp_extract(value, r"([A-Za-z]*)$", 1)),
        "luhn": flag(F.length(digits).between(13, 19) & luhn(digits)),
        "octets": flag(F.regexp_replace(F.regexp_replace(value, r"(?i)dot", "."), r"[\[\]()]", "").rlike(_OCTETS)),
        "year_first": flag(value.rlike(r"^(?:19|20)[0-9]{2}[^0-9]")),
        "touches": flag(before.rlike(r"[\p{L}0-9]$") | after.rlike(r"^[\p{L}0-9]")),
        "digits_near": F.length(_digits(before)) + F.length(_digits(after)),
    }
    return {k: v.cast("double") for k, v in (out | {k: flag(near.rlike(p)) for k, p in _CUES.items()}).items()}


def _respelled(spans: DataFrame) -> DataFrame:
    """Base spans in their hidden or shortened spellings: positive rows, and the cards as phones, negative rows."""
    v, kind = F.col("value"), F.col("kind")

    signs = [(" (at) ", " (dot) "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" {at} ", " {dot} ")]
    signs += [(" at ", " dot "), (" AT ", " DOT "), (" (at) ", "."), (" [at] ", "."), ("[at]", "."), ("@", " (dot) ")]
    plain = F.regexp_replace(v, r"\.?[0-9]+", "")
    short = F.regexp_replace(plain, r"^([^@.]{1,6})[^@]*", "$1")
    one = F.regexp_replace(plain, r"@(?:[^@.]+\.)*([^@.]+\.[^@.]+)$", "@$1")
    used = F.array(*[F.struct(F.lit(at).alias("at"), F.lit(dot).alias("dot")) for at, dot in signs])

    def hidden(address: Column) -> Column:
        every = F.transform(used, lambda g: F.regexp_replace(
            F.regexp_replace(address, r"\.(?=[^@]*$)", g["dot"]), "@", g["at"]))
        last = F.transform(used, lambda g: F.regexp_replace(
            F.regexp_replace(address, r"\.(?=[^@.]*$)", g["dot"]), "@", g["at"]))
        return F.concat(every, last)

    emails = F.flatten(F.transform(F.array(v, plain, short, one), hidden))
    number = F.regexp_replace(v, r"^\+[0-9]{1,2}[\s-]*", "")
    joined = F.regexp_replace(number, r"[()\s.-]+", "-")
    joined = F.regexp_replace(joined, "^-|-$", "")
    cards = [F.regexp_replace(_digits(v), r"(.{4})(?=.)", f"$1{gap}") for gap in (".", "/", "  ", "_", ". ", " - ", "--")]
    ways = {
        "ip": [F.regexp_replace(v, r"\.", dot) for dot in ("[.]", "(.)", "[dot]")]
        + [F.regexp_replace(v, r"\.([0-9]+)$", dot + "$1") for dot in ("[.]", "(.)")]
        + [F.regexp_replace(v, r"^([0-9]+)\.", "$1" + dot) for dot in ("[.]", "(.)")]
        + [F.regexp_replace(v, r"^([0-9]+\.[0-9]+)\.", "$1" + dot) for dot in ("[.]", "(.)")],
        "card": cards,
        "phone": [
            number,
            joined,
            F.regexp_replace(joined, "-", "."),
            F.regexp_replace(joined, "-", " "),
            F.regexp_replace(joined, "-", "/"),
            F.regexp_replace(_digits(number), r"(..)(?=.)", "$1 "),
            F.regexp_replace(_digits(number), r"(..)(?=.)", "$1."),
            F.regexp_replace(F.regexp_replace(v, r"^\+", "00"), "[()]", ""),
            F.regexp_replace(F.regexp_replace(v, r"^\+", "00 "), "[()-]", " "),
        ],
    }
    spelt = F.when(kind == "email", emails)
    for name in KINDS[1:]:
        spelt = spelt.when(kind == name, F.array(*ways[name]))
    right = spans.withColumn("value", F.explode(F.array_distinct(spelt))).withColumn("label", F.lit(1))
    other = spans.where(kind == "card").withColumn("value", F.explode(F.array(*cards)))
    return right.union(other.withColumn("kind", F.lit("phone")).withColumn("label", F.lit(0)))


def _in_places(rows: DataFrame) -> DataFrame:
    """Made rows in the place of their base span, alone, and behind a word: one that goes with a kind, which is
    right for some rows and wrong for others, so that format and context must both be weighed."""
    words = F.array(*[F.lit(w) for w in LEADS])
    word = F.get(words, F.pmod(F.xxhash64("value", "label"), F.lit(len(LEADS))).cast("int"))
    own = F.struct("before", "after")
    alone = F.struct(F.lit("").alias("before"), F.lit("").alias("after"))
    behind = F.struct(F.concat(word, F.lit(" ")).alias("before"), F.lit(" ").alias("after"))
    placed = rows.withColumn("_place", F.explode(F.array(own, alone, behind)))
    return placed.withColumn("before", F.col("_place.before")).withColumn("after", F.col("_place.after")).drop("_place")


def _decoys(spans: DataFrame) -> DataFrame:
    """Negative rows: other numbers and names in the places of base spans."""
    h = F.abs(F.xxhash64("value", "before", "start"))

    def number(shift: int, most: int) -> Column:
        return F.pmod(F.shiftright(h, shift), F.lit(most)).cast("string")

    def two(shift: int, most: int) -> Column:
        return F.lpad(number(shift, most), 2, "0")

    long = F.concat(F.lpad(number(3, 100_000_000), 8, "7"), F.lpad(number(9, 100_000_000), 8, "3"))
    wrong = F.concat(F.substring(long, 1, 15), F.when(luhn(long), F.lit("x")).otherwise(F.substring(long, 16, 1)))
    version = F.concat(number(1, 20), F.lit("."), number(6, 20), F.lit("."), number(9, 700), F.lit("."), number(2, 999))
    fours = F.regexp_replace(F.translate(wrong, "x", "0"), r"(.{4})(?=.)", "$1.")
    rows = [
        ("phone", F.concat(number(5, 90), F.lit("20"), two(1, 24), F.lit("-"), two(7, 12), F.lit("-"), two(11, 28))),
        ("phone", F.concat(F.lit("20"), two(1, 24), F.lit("-"), two(7, 12), F.lit("-"), two(11, 28))),
        ("phone", F.concat(two(1, 28), F.lit("."), two(7, 12), F.lit(".20"), two(11, 24))),
        ("phone", F.concat(two(1, 28), F.lit("/"), two(7, 12), F.lit("/"), two(11, 99))),
        ("phone", F.concat(F.lit("19"), two(1, 99), F.lit("-20"), two(7, 24))),
        ("phone", F.concat(number(2, 900), F.lit(" "), number(13, 900))),
        ("phone", F.concat(number(2, 900), F.lit(" "), number(13, 900), F.lit(" "), number(21, 900))),
        ("phone", F.concat(F.lit("978-"), number(2, 9), F.lit("-"), F.lpad(number(13, 999), 3, "4"), F.lit("-"), F.lpad(number(21, 9999), 4, "6"))),
        ("phone", F.concat(F.lit("10."), F.lpad(number(2, 9999), 4, "1"), F.lit("/"), number(13, 9999))),
        ("ip", F.when(~version.rlike(_OCTETS), version)),
        ("ip", F.concat(F.lit("3"), two(1, 99), F.lit("[.]"), number(6, 20), F.lit("[.]"), number(9, 700), F.lit("[.]9"))),
        ("card", F.when(~luhn(_digits(fours)), fours)),
        ("card", F.concat(F.lit("20"), two(1, 24), F.lit("/20"), two(4, 24), F.lit("/20"), two(8, 24), F.lit("/"), number(3, 99))),
        ("email", F.concat(F.element_at(F.split("before", r"\s+"), 1), F.lit(" at "), F.element_at(F.split("after", r"\s+"), 1), F.lit(" dot so"))),
        ("email", F.concat(F.regexp_extract("before", r"(\w+)\W*$", 1), F.lit("@"), F.regexp_extract("after", r"(\w+)", 1), F.lit(". then"))),
        ("email", F.concat(F.lit("meet at "), F.try_element_at(F.split("after", r"\W+"), F.lit(-1)), F.lit(" dot com"))),
        ("email", F.concat(F.regexp_extract("before", r"(\w+)\W*$", 1), F.lit(" at the dot of"))),
    ]
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in rows])
    made = spans.select("before", "after", F.explode(parts).alias("d"))
    return made.select("d.kind", "d.value", "before", "after", F.lit(0).alias("label")).where("value is not null")


def _disproved(kind: Column, value: Column) -> Column:
    """Whether a candidate cannot be of its kind: no octets, a failing check digit, a date, a domain that ends in a number."""
    day, month, year = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])", "(?:19|20)[0-9]{2}"
    date = "|".join(
        rf"{a}([./-]){b}\{i}{c}"
        for i, (a, b, c) in enumerate([(year, month, day), (day, month, year), (month, day, year)], 1)
    )
    wrong = {
        "email": value.rlike(rf"(?i)(?:{_DOT})[0-9]+$"),
        "ip": ~F.regexp_replace(F.regexp_replace(value, r"(?i)dot", "."), r"[\[\]()]", "").rlike(_OCTETS),
        "card": ~luhn(_digits(value)),
        "phone": value.rlike(f"^(?:{date})$"),
    }
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in wrong.items() for x in (F.lit(k), v)]), kind), F.lit(False))


@dataclass(frozen=True)
class Judge:
    trees: Boosted | None
    thresholds: dict[str, float]


def learn(docs: DataFrame, text: str = "text", sample: int | None = None) -> Judge:
    """Fit on the rows that all documents give; thresholds from a third of them.

    A caller may ask for about `sample` documents, chosen by a hash of the text; the queries do not. Rows with equal features are one row with their number as its weight, so the fit grows with the different shapes
    of candidates. Without both labels nothing is learned and only base spans are found.
    """
    picked = docs.select(F.col(text).cast("string").alias("text"))
    if sample is not None:
        share = sample / max(docs.count(), 1)
        if share < 1:
            picked = picked.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    found = cut_lineage(_with_candidates(picked, "text").select("_base", "_loose").where("size(_base) + size(_loose) > 0"))
    base = found.select(F.explode("_base").alias("s")).select("s.*")
    loose = found.select(F.explode("_loose").alias("s")).select("s.*").where(_disproved(F.col("kind"), F.col("value")))
    loose = loose.withColumn("label", F.lit(0))
    columns = ["kind", "value", "before", "after", "label"]
    made = _respelled(base).select(*columns).union(_decoys(base).select(*columns))
    rows = _in_places(made).select(*columns).union(loose.select(*columns))
    made = _features(F.col("kind"), F.col("value"), F.col("before"), F.col("after"))
    fold = F.pmod(F.xxhash64("value", "before"), F.lit(3)).alias("fold")
    rows = rows.select("kind", "label", fold, *[v.alias(k) for k, v in made.items()])
    rows = cut_lineage(rows.groupBy(*rows.columns).agg(F.count("*").alias("times")))
    labels = {r[0] for r in rows.where("fold > 0").select("label").distinct().toLocalIterator()}
    if labels != {0, 1}:
        return Judge(None, {})
    trees = fit(rows.where("fold > 0"), list(made), rounds=ROUNDS, weight="times")
    way = F.when(F.col("spelt_at") > 0, F.concat("kind", F.lit(" at"))).otherwise(F.col("kind")).alias("kind")
    judged = rows.where("fold = 0").select(way, "label", "times", F.floor(trees.column(F.col) * 100).cast("int").alias("p"))
    counts: dict[str, dict[int, list[int]]] = {}
    for kind, p, label, times in judged.groupBy("kind", "p", "label").agg(F.sum("times")).toLocalIterator():
        counts.setdefault(kind, {}).setdefault(p, [0, 0])[label] += times
    thresholds = {}
    for kind, at in counts.items():
        wrong = right = 0
        levels = sorted(at, reverse=True)
        for p, below in zip(levels, [*levels[1:], 0]):
            wrong, right = wrong + at[p][0], right + at[p][1]
            if right >= LEAST and p >= 50 and right >= PRECISION * (right + wrong):
                thresholds[kind] = (p + max(50, below + 1)) / 200  # between this level and what is no longer over it
    return Judge(trees, thresholds)


def find_spans(docs: DataFrame, judge: Judge, text: str = "text") -> DataFrame:
    """All columns plus `base` and `added`: arrays of (kind, start, stop, value), ordered by kind, then start.

    Base spans always stay. An added span overlaps no base span, reaches its kind's threshold, and overlaps no
    better one (higher probability, then earlier start, then longer). Null text counts as empty. Columns named
    base or added are replaced.
    """
    df = _with_candidates(docs.drop("base", "added"), text)
    none = F.array().cast("array<struct<kind: string, start: int, stop: int, value: string, p: double>>")
    if judge.trees is None or not judge.thresholds:
        df = df.withColumn("_good", none)
    else:

        def scored(c: Column) -> Column:
            made = _features(c["kind"], c["value"], c["before"], c["after"])
            return F.struct(
                *[c[n].alias(n) for n in ("kind", "start", "stop", "value")],
                F.struct(*[v.alias(k) for k, v in made.items()]).alias("f"),
            )

        def threshold(c: Column) -> Column:
            kind = F.when(c["value"].rlike(_SPELT), F.concat(c["kind"], F.lit(" at"))).otherwise(c["kind"])
            out = F.lit(2.0)
            for name, value in judge.thresholds.items():
                out = F.when(kind == name, F.lit(value)).otherwise(out)
            return out

        df = df.withColumn("_scored", F.transform("_loose", scored))
        judged = F.transform(
            "_scored",
            lambda c: F.struct(
                *[c[n].alias(n) for n in ("kind", "start", "stop", "value")],
                judge.trees.column(lambda n: c["f"][n]).alias("p"),
            ),
        )
        df = df.withColumn("_judged", F.when(F.size("_scored") > 0, judged).otherwise(none))
        df = df.withColumn("_good", F.filter("_judged", lambda c: c["p"] >= threshold(c)))

    def order(c: Column) -> Column:
        return F.struct(-c["p"], c["start"], -c["stop"], c["kind"])

    best = F.filter(
        "_good",
        lambda c: ~F.exists(
            "_good", lambda d: (d["start"] < c["stop"]) & (c["start"] < d["stop"]) & (order(d) < order(c))
        ),
    )

    def ordered(spans: Column) -> Column:
        plain = F.transform(spans, lambda s: F.struct(*[s[n].alias(n) for n in ("kind", "start", "stop", "value")]))
        return F.concat(*[F.array_sort(of_kind(plain, k)) for k in KINDS])

    df = df.withColumn("base", ordered(F.col("_base"))).withColumn("added", ordered(best))
    return df.drop("_text", "_base", "_loose", "_scored", "_judged", "_good")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined, by kind as listed, then start."""

    def part(s: Column) -> Column:
        return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))

    return F.array_join(
        F.flatten(F.array(*[F.transform(of_kind(spans, k), part) for k in KINDS])), ","
    )


def redacted(found: DataFrame, text: str = "text") -> DataFrame:
    """Every span of `base` and `added` replaced by [KIND] of the first of those that overlap; the two columns go."""
    spans = F.array_sort(
        F.transform(
            F.concat("base", "added"),
            lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")),
        )
    )

    def merge(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(
            last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"), last["kind"].alias("kind")
        )
        apart = (F.size(acc) == 0) | (s["start"] >= last["stop"])
        return F.when(apart, F.concat(acc, F.array(s))).otherwise(
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))
        )

    none = F.array().cast("array<struct<start: int, stop: int, kind: string>>")
    df = found.withColumn("_merged", F.aggregate(spans, none, merge))
    body = F.col(text).cast("string")

    def piece(s: Column, i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get("_merged", i - 1)["stop"])
        between = F.substring(body, begin + 1, s["start"] - begin)
        return F.concat(between, F.lit("["), F.upper(s["kind"]), F.lit("]"))

    last = F.try_element_at("_merged", F.lit(-1))["stop"]
    new = F.concat(
        F.array_join(F.transform("_merged", piece), ""), F.substring(body, last + 1, F.length(body))
    )
    return df.withColumn(text, F.when(F.size("_merged") > 0, new).otherwise(body)).drop("base", "added", "_merged")


@query("op8_candidate_boosting_pii")
def op8_candidate_boosting_pii(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = find_spans(docs, learn(docs))
    kinds = [F.size(of_kind("base", k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id",
        *kinds,
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.concat("base", "added")).alias("spans"),
    )
