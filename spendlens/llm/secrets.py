"""Secrets by assignment-aware lexing.

Base patterns give sure spans. Beside them, source and configuration syntax is read into name-literal pairs:
assignments of code, keys of JSON, YAML, TOML and shell, tags and attributes of XML, flags of command lines, headers
and the user part of addresses. A right side may join literals and names; a name stands for what it was last given,
so a literal's target names are all those that it reaches through constants. A literal is added when its form
and the most sensitive of its target names together score enough. Texts are read one by one, without a shuffle.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.files import fresh
from spendlens.llm.registry import query, table

KINDS = ("assign", "access", "hex")
BASE = {
    "assign": re.compile(
        r"(?:(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([a-z0-9+/_.=-]+)", re.I | re.A
    ),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
}
ENOUGH = 4.0  # least score of an added literal

# Words of a target name and what they add to its score; joined words count as the pair.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "passcode": 3, "pwd": 3, "pass": 2, "pw": 2, "secret": 3, "token": 2.5,
    "credential": 3, "credentials": 3, "creds": 3, "apikey": 3, "bearer": 2.5, "authorization": 2.5, "auth": 1.5, "key": 1,
    "passwort": 3, "kennwort": 3, "contraseña": 3, "clave": 2, "signature": 1.5, "salt": 2, "dsn": 1.5, "jwt": 2.5,
    "cookie": 1.5, "webhook": 1.5, "passwords": 2, "secrets": 2, "tokens": 1.5,
}
BEFORE_KEY = {"api", "access", "private", "secret", "signing", "encryption", "auth", "master", "account", "storage", "shared", "session"}
HARMLESS = {
    "id", "ids", "name", "names", "file", "path", "url", "uri", "hint", "length", "len", "type", "label", "field", "count", "max",
    "min", "policy", "expires", "expiry", "expiration", "ttl", "regex", "pattern", "prompt", "placeholder", "public", "limit",
    "size", "format", "version", "column", "index", "header", "endpoint", "help", "title", "message", "error", "description",
    "primary", "foreign", "sort", "partition", "cache", "lookup", "usage", "total", "per", "tokenizer",
}
FILLER = re.compile(
    r"(?i)^(?:\W*|(.)\1*|x+|\*+|none|null|nil|undefined|true|false|yes|no|on|off|changeme|change[-_ ]?this|todo|tbd|fixme|"
    r"example\w*|sample\w*|dummy\w*|placeholder\w*|redacted|hidden|secret|password|passwd|token|your.*|my.*(?:here|goes).*|"
    r"<.*>|\$\{.*\}|\{\{.*\}\}|%\(?\w+\)?s?%?|\[.*\]|env:.*|process\.env.*|os\.environ.*)$"
)

_PARTS = re.compile(r"[A-Z]+(?![a-zß-ÿ])|[A-Z]?[a-zß-ÿ]+|[0-9]+")
# Every name that scores has one of these in it.
_STEMS = [w for w in SENSITIVE if not any(v != w and v in w for v in SENSITIVE)]
_USER = re.compile(r"://[^\s/:@]{0,64}:")

_NAME = r"[A-Za-z_$À-ÿ][\w$À-ÿ]*+(?:(?:\.|->|::|-)[A-Za-z_$À-ÿ][\w$À-ÿ]*+)*+"
_APART = r"(?<![\w$])(?<!\w\.)(?<!\w-)(?<!->)(?<!::)"  # a name is read from its start only
_STRING = (
    r"\"\"\"(?:(?!\"\"\")[\s\S]){0,4096}+\"\"\"|'''(?:(?!''')[\s\S]){0,4096}+'''"
    r"|\"(?:[^\"\\\n]|\\.){0,4096}+\"|'(?:[^'\\\n]|\\.){0,4096}+'|`(?:[^`\\\n]|\\.){0,4096}+`"
)
# What may stand left of a value, in one pass over the text; the value is read from where the match ends.
_TARGET = re.compile(
    rf"""
      (?<![\w$.-])--?(?P<flag>[A-Za-z][\w-]*+)(?:=|\x20+)(?=[^\s-])                              # --name value
    | <(?P<tag>[A-Za-z][\w.:-]*+)(?:\s[^<>]{{0,256}}+)?+>(?=[^<\s])                               # <name>value</name>
    | (?P<scheme>[A-Za-z][A-Za-z0-9+.-]{{1,15}}+)://(?P<user>[^\s/:@"'<>]{{0,64}}+):(?=[^\s/@"'<>]{{1,256}}+@)  # x://user:value@host
    | \b(?P<header>(?i:authorization))["']?\s*[:=,]\s*["']?(?:(?i:bearer|basic|token)\s+)(?=[\w+/=.~-])
    | {_APART}(?P<setter>[A-Za-z_$][\w$.]*+)\(\s*(?P<quote>["'])(?P<first>[\w.:-]{{1,128}}+)(?P=quote)\s*,\s*  # set('name', value)
    | (?<![\w$])set(?P<call>[A-Z_]\w*+)\(\s*(?=["'`])                     # setName('value')
    | (?:\[\s*(?P<q2>["'])(?P<key>[\w.\x20-]{{1,128}}+)(?P=q2)\s*\]|(?P<q3>["'])(?P<quoted>[\w.\x20-]{{1,128}}+)(?P=q3)
        |{_APART}(?P<name>{_NAME}))
      (?:\s*:\s*[A-Za-z_][\w.<>\[\]|&\x20]{{0,40}}?(?==)(?!==))?                                     # : type
      [\x20\t]*(?P<sign>:=|=>|\?=|\+=|=(?![=>])|:(?![:/]))[\x20\t]*\n?[\x20\t]*
    """,
    re.X,
)
_LITERAL = re.compile(rf"(?P<prefix>[rbfuRBFU]{{0,2}}@?)(?P<string>{_STRING})")
_REFERENCE = re.compile(
    rf"\$\{{(?P<braced>\w+)[^}}\n]{{0,64}}\}}|\$\((?P<make>\w+)\)|\$(?P<shell>[A-Za-z_]\w*)|\*(?P<anchor>[A-Za-z_]\w*)"
    rf"|(?:this\.|self\.|@)?(?P<plain>{_NAME})(?![\w$(\"'])"
)
_BARE = re.compile(r"[^\s\"'`,;<>(){}\[\]|&#]{1,512}")
_ANCHOR = re.compile(r"&(\w+)\s+")
_JOIN = re.compile(r"\s*(?:\+|\.\.|\.|&|\|\|)\s*(?=[\"'`\w$@])|[\x20\t]*\\?\n?[\x20\t]+(?=[\"'])")


@dataclass
class Pair:
    """A target name with the literals and names of its value."""

    name: str
    at: int
    literals: list[tuple[int, int, bool]] = field(default_factory=list)  # start, stop, quoted
    names: list[str] = field(default_factory=list)


def _value(text: str, at: int, bare: bool) -> tuple[list[tuple[int, int, bool]], list[str], int]:
    """Literals and names of the value at a place, and where it ends."""
    literals, names = [], []
    while True:
        if found := _LITERAL.match(text, at):
            width = 3 if found["string"][:3] in ('"""', "'''") else 1
            start, stop = found.start("string") + width, found.end() - width
            literals.append((start, stop, True))
            for inner in re.finditer(r"\$?\{(\w+)\}", text[start:stop][:4096]):
                names.append(inner[1])
            at = found.end()
        elif found := _REFERENCE.match(text, at):
            if found["plain"] and bare and not literals and not names:
                word = _BARE.match(text, at)
                literals.append((word.start(), word.end(), False))  # a bare word may be a value or a name
            names.append(next(x for x in found.groups() if x))
            at = found.end() if not literals or literals[-1][1] < found.end() else literals[-1][1]
        elif bare and not literals and (found := _BARE.match(text, at)):
            if not text.startswith("(", found.end()):  # a call has no literal of its own
                literals.append((found.start(), found.end(), False))
            at = found.end()
        else:
            return literals, names, at
        step = _JOIN.match(text, at)
        if step is None:
            return literals, names, at
        at, bare = step.end(), False


def pairs(text: str) -> Iterator[Pair]:
    """Name-literal pairs in the order of the text, in one pass."""
    at = 0
    while found := _TARGET.search(text, at):
        kind = found.lastgroup if found.lastgroup not in ("quote", "q2", "q3", "sign") else None
        begin = at = found.end()
        if found["scheme"]:
            stop = text.index("@", begin)
            yield Pair("password", found.start(), [(begin, stop, True)])
            at = stop
            continue
        if found["tag"]:
            stop = text.find("</", begin, begin + 4096)
            if stop > 0 and text.startswith(found["tag"], stop + 2):
                yield Pair(found["tag"], found.start(), [(begin, stop, True)])
            continue
        name = next(found[g] for g in ("flag", "header", "first", "call", "key", "quoted", "name") if found[g])
        if anchor := _ANCHOR.match(text, begin):
            begin = anchor.end()
        literals, names, end = _value(text, begin, kind != "call")
        if anchor:
            yield Pair(anchor[1], found.start(), literals, names)
        yield Pair(name, found.start(), literals, names)
        inside = found["flag"] or literals and not literals[0][2]  # there may be a pair inside
        at = begin + (text[begin : begin + 1] in ('"', "'")) if inside else max(end, at)


def name_score(name: str) -> float:
    """How sensitive a name sounds by its words; names of harmless things around a secret score 0."""
    words = [w.lower() for w in _PARTS.findall(name)]
    if not words or words[-1] in HARMLESS:
        return 0.0
    best = max((SENSITIVE.get(w, 0) for w in words), default=0)
    for a, b in zip(words, words[1:]):
        if b in ("key", "keys", "token", "code") and a in BEFORE_KEY or a + b in SENSITIVE:
            best = max(best, 3)
    return best - (1.0 if "public" in words or "example" in words else 0.0)


def literal_score(value: str, quoted: bool) -> float:
    """How much a literal looks like a secret: no filler, mixed signs, high entropy, few spaces."""
    n = len(value)
    if n < 6 or n > 4096 or FILLER.match(value) or "${" in value or "{{" in value:
        return -10.0
    kinds = sum(bool(re.search(p, value)) for p in ("[a-zß-ÿ]", "[A-Z]", "[0-9]", r"[^\w\s]"))
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    score = 0.5 * kinds + (0.5 if quoted else 0.0) + (1.0 if bits >= 3 else 0.0) + (0.5 if n >= 16 else 0.0)
    score -= 1.0 if re.fullmatch(r"[^\W\d_]+[.,:;!?]?", value) else 0.0  # a plain word
    score -= 1.5 * min(2, len(re.findall(r"\s+", value)))
    score -= 2.0 if re.match(r"(?i)[a-z]+://(?![^/\s]*:[^/\s]*@)|[./~]+/|\w+\.\w+\(|#[0-9a-f]{3,8}$", value) else 0.0
    return score


def added_spans(text: str) -> list[tuple[int, int]]:
    """Literals that enough sensitive names reach, each once, in the order of the text.

    A name stands for the pair that gave it a value last before its use, or else first after it. Sensitivity goes
    from a pair to the pairs of the names in its value, each visited once at its highest score.
    """
    low = text.lower()
    if not any(stem in low for stem in _STEMS) and not _USER.search(text):
        return []
    found = list(pairs(text))
    given: dict[str, list[int]] = {}
    for i, pair in enumerate(found):
        given.setdefault(pair.name.rsplit(".", 1)[-1].rsplit(">", 1)[-1], []).append(i)
    best = [name_score(p.name) for p in found]
    order = sorted((i for i in range(len(found)) if best[i] > 0), key=lambda i: -best[i])
    reached: dict[int, float] = {}
    for seed in order:
        todo = [seed]
        while todo:
            i = todo.pop()
            if i in reached:
                continue
            reached[i] = best[seed]
            for name in found[i].names:
                at = given.get(name.rsplit(".", 1)[-1].rsplit(">", 1)[-1])
                if at:
                    place = bisect.bisect_left(at, i) - 1
                    todo.append(at[max(place, 0)])
    out = set()
    for i, score in reached.items():
        for start, stop, quoted in found[i].literals:
            value = text[start:stop] if quoted else text[start:stop].rstrip(".,;:!?")
            known = not quoted and value.rsplit(".", 1)[-1] in given  # a bare word that is a name
            if not known and score + literal_score(value, quoted) >= ENOUGH:
                out.add((start, start + len(value)))
    return sorted(out)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, kind) of the base patterns' matches that hold, by start, then kind as listed."""
    found = [(m.start(), 0, m.end()) for m in BASE["assign"].finditer(text) if m.end(1) - m.start(1) >= 6]
    found += [(m.start(), 1, m.end()) for m in BASE["access"].finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in BASE["hex"].finditer(text)]
    return [(start, stop, KINDS[kind]) for start, kind, stop in sorted(found)]


def _outside(spans: list[tuple[int, int]], base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The spans that no base span holds whole; both are ordered by start."""
    out, i, reach = [], 0, -1
    for start, stop in spans:
        while i < len(base) and base[i][0] <= start:
            reach = max(reach, base[i][1])
            i += 1
        if stop > reach:
            out.append((start, stop))
    return out


_SPANS = "array<struct<kind: string, start: int, stop: int>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns plus `base` and `added`: arrays of (kind, start, stop) in code points, by start, then kind.

    Base spans always stay. Added ones are literals, of kind assign, that no base span holds whole. Null and empty
    texts have none; repeated rows have equal ones. Columns named base or added are replaced. Only the text goes to
    Python.
    """
    keep = [c for c in docs.columns if c not in ("base", "added")]

    @F.arrow_udf(f"base {_SPANS}, added {_SPANS}")
    def spans(texts: pa.Array) -> pa.Array:
        base, added = [], []
        for value in texts:
            body = value.as_py() or ""
            sure = base_spans(body)
            base.append([{"kind": k, "start": a, "stop": b} for a, b, k in sure])
            more = _outside(added_spans(body), sure)
            added.append([{"kind": KINDS[0], "start": a, "stop": b} for a, b in more])
        return pa.StructArray.from_arrays([pa.array(base, _TYPE), pa.array(added, _TYPE)], names=["base", "added"])

    found = fresh(docs, "found")
    rows = docs.select(*keep, spans(F.col(text).cast("string")).alias(found))
    return rows.select(*keep, f"{found}.base", f"{found}.added")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start, then kind as listed."""
    place = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"), F.array_position(place, s["kind"]).alias("at"), s["stop"].alias("stop"), s["kind"].alias("kind")
            ),
        )
    )
    parts = F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(parts, ",")


@query("op12_secret_scan")
def op12_secret_scan(spark, sf):
    found = find_secrets(table(spark, sf, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.concat("base", "added")).alias("spans"),
    )
