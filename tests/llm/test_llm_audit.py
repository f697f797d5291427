"""Source divergence, secrets and conversation repair against plain Python."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from spendlens.llm import conversations, divergence, secrets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, at int, term string, value long, base string, found int"


def table(spark, rows):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, *row, 1, "t", 2, "b", 3) for i, row in enumerate(rows)], DOCS)


def brute_audit(rows, top):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        lang, source = lang or "", source or ""
        count[lang, source].update(words)
        docs[lang].update(set(words))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]
        every = sum((count[lang, s] for s in sources), Counter())

        def rates(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        def apart(p, q):
            return (p - q) ** 2 // q

        p, q = {s: rates(count[lang, s]) for s in sources}, rates(every)
        for s in sources:
            pairs = [(-sum(apart(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources - {s}]
            terms = [(-apart(p[s][t], q[t]), t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out |= {(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(sorted(found)[:most], 1)}
    return out


def some_rows(rng, n):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Ärger", "ÄRGER", "中文", "Re", "rE"]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "hot", "b", "c", "é", None])
        text = "1 ".join(rng.choice(words[: 20 if source == "hot" else 65]) for _ in range(rng.randrange(0, 30)))
        rows.append((text, lang, source))
    rows += [rows[0]] * 5 + [(None, "en", "none"), ("", "fr", "one"), ("a b", "fr", "two"), ("x " * 400, "en", "c")]
    return rows


@pytest.mark.parametrize("entries,gathered", [(200_000, 1 << 18), (20, 7)])
def test_source_divergence(spark, monkeypatch, entries, gathered):
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    monkeypatch.setattr(divergence, "GATHERED", gathered)
    monkeypatch.setattr(divergence, "PART", 64)
    rows = some_rows(random.Random(11), 150)
    found = divergence.audit(table(spark, rows), top=7)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit(rows, 7)


def test_source_divergence_of_empty_tables(spark):
    assert divergence.audit(table(spark, [])).count() == 0
    assert [tuple(r) for r in divergence.audit(table(spark, [(None, None, "a"), ("x", None, None)])).orderBy("source").collect()] == [
        ("", "", "pair", "a", 0, 1),
        ("", "a", "pair", "", 0, 1),
    ]


def test_rates_of_large_counts(spark):
    big = 40_000_000_000_000
    row = spark.createDataFrame([(big, big + 7, 1000), (0, 0, 0)], "n long, total long, terms long")
    got = [r[0] for r in row.select(divergence._rate("n", "total", "terms")).collect()]
    assert got == [1 + 10**9 * (big + 1) // (big + 1007), 1]


def test_words_of_parts_are_whole(monkeypatch):
    monkeypatch.setattr(divergence, "PART", 5)
    text = "Abc, déf " + "z" * 40 + " 12 x y"
    assert [w.decode() for part in divergence._words(text.encode()) for w in part] == ["abc", "déf", "z" * 40, "x y"]


def brute_base(text):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        out += [(m.start(), 0, m.end())] * (len(m[2]) >= 6)
    for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_secrets(spark):
    rng = random.Random(12)
    bits = ["token", "API_KEY", "apikey", "Password", "secret", "ſecret", '"', "'", " ", ":", "=", " = ", "abc123", "AKIA", "Q7" * 8]
    bits += ["0f" * 12, "0f" * 11, "é", "𝄞", "\n", "x-y_z", "AKIAAKIA", "f", "K"]
    texts = [None, "", *("".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(400))]
    texts += ["token = " + "ab" * 50_000, "token=" * 3000]
    rows = table(spark, [(t, "en", "s") for t in texts] * 2)
    found = secrets.find_secrets(rows)
    assert found.columns == [c for c in rows.columns if c != "base"] + ["base", "added"]
    for r in found.withColumn("base", secrets.written(found["base"])).collect():
        assert r.base == brute_base(r.text or ""), r.text
        assert all(r.text[s.start : s.stop] for s in r.added)
    assert secrets.find_secrets(table(spark, [])).count() == 0


# (text, literals that the base patterns do not hold whole)
HIDDEN = [
    ('db_password = "p@ss w0rd!9"', ["p@ss w0rd!9"]),
    ("const dbSecret = 'Xk9$mmP2!q';", ["Xk9$mmP2!q"]),
    ('KEY="Zx9Qw8er7ty"\nalias = KEY\nauth_token = alias', ["Zx9Qw8er7ty"]),
    ('auth_token = later\nlater = "Zx9Qw8er7ty"', ["Zx9Qw8er7ty"]),
    ('a = "one"\na = "Zx9Qw8er7ty"\nclient_secret = a\na = "Other7Value!"', ["Zx9Qw8er7ty"]),
    ('part = "Ab9!zz"\nsecret = part + "Zk!77q"', ["Ab9!zz", "Zk!77q"]),
    ('x = "${part}tail"\npart = "Kp0!aWq2Z"\npasswd = x', ["Kp0!aWq2Z"]),
    ("PASS=Zz91kk!!x\ncurl -u me:$PASS", ["Zz91kk!!x"]),
    ("common: &tok Zx9!kk77Q\nservice:\n  access_token: *tok", ["Zx9!kk77Q"]),
    ('{"client": {"passphrase": "aZ$9-kkQ!x1", "name": "bob"}}', ["aZ$9-kkQ!x1"]),
    ("postgres://app:S3cr3tPw@db:5432/x", ["S3cr3tPw"]),
    ("<server><password>Tr0ub4dor&3</password></server>", ["Tr0ub4dor&3"]),
    ('curl -H "Authorization: Bearer abc.DEF123-xyz_9" https://x', ["abc.DEF123-xyz_9"]),
    ("login --password Passw0rd99 --host x", ["Passw0rd99"]),
    ('conn.setPassword("Gh7!kkLmn")', ["Gh7!kkLmn"]),
    ("define('DB_PASS', 'Yx!77aabb');", ["Yx!77aabb"]),
    ('os.environ["DB_PASSWORD"] = "Qwe!23rtY"', ["Qwe!23rtY"]),
    ('private String passwd2 = "Xx9!kkqqw";', ["Xx9!kkqqw"]),
    ('pwd: str = "Xx9!kkqqw"', ["Xx9!kkqqw"]),
    ("kennwort: Über9!Straße", ["Über9!Straße"]),
    ("export AWS_SECRET_ACCESS_KEY='wJalr/XUtn+FEMI=K7MDENG'", ["wJalr/XUtn+FEMI=K7MDENG"]),
]
CLEAN = [
    "token: the next word of the text is the one that counts",
    'password_hint = "your dog, born 2007"',
    'passphrase = "${PASSPHRASE}"',
    'pwd = "changeme"',
    "pwd = os.getcwd()",
    'key_name = "Customer9!Id"',
    'primary_key = "user_id12"',
    "The key to this: nothing at all, 12 apples!",
    'api_keys_url = "https://example.com/keys"',
    '<label for="password">Password</label>',
    "passphrase = input('Enter the phrase: ')",
    'title = "Xx9!kkqqw"',
    "--auth-type basic --pass",
    "https://example.com:8080/a@b",
]


@pytest.mark.parametrize("text,want", HIDDEN + [(t, []) for t in CLEAN])
def test_added_secrets(text, want):
    base = secrets.base_spans(text)
    got = [text[a:b] for a, b in secrets._outside(secrets.added_spans(text), base)]
    assert got == want


@pytest.mark.parametrize("bit", ["a.", '"', "key=", "<a ", "://a:", "password=(", "x:", "- ", "a b ", "secret = a + ", "a->", "[", "${"])
def test_lexing_is_linear(bit):
    import time

    times = []
    for n in (20_000, 80_000):
        start = time.process_time()
        list(secrets.pairs("token " + bit * (n // len(bit))))
        times.append(time.process_time() - start)
    assert times[1] < 9 * times[0] + 0.3


def brute_repair(signature):
    """Least cost, then least audit, over all edit sequences."""
    heap, seen, least, best = [(0, "", 0, 0)], {}, None, []
    while heap:
        cost, audit, i, g = heapq.heappop(heap)
        if least is not None and cost > least:
            return least, min(best)
        if i == len(signature) and g in (0, 3):
            least = cost
            best.append(audit)
        if seen.setdefault((i, g), cost) < cost:
            continue
        steps = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}][g]
        for role in set(steps) & {"u", "a"}:
            heapq.heappush(heap, (cost + 3, audit + "I", i, steps[role]))
        if i < len(signature):
            sign, more = signature[i], 3 if signature[i].isupper() else 0
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, g))
            if sign != "x":
                for role, to in steps.items():
                    if role == sign.lower():
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, to))
                    if role in "ua":
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, to))
    return least, min(best)


def test_repairs_of_signatures(spark):
    rng = random.Random(13)
    words = {"", "x", "s", "u", "a", "uauauaua", *("".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(9))) for _ in range(400))}
    words |= {w[k:] for w in list(words)[:50] for k in range(len(w))}
    rows = spark.createDataFrame([(w[::-1],) for w in words], "mirrored string")
    found = {r.mirrored[::-1]: (r.cost, r.audit) for r in conversations.repairs(rows).collect()}
    assert found == {w: brute_repair(w) for w in words}


def test_states_are_shared_by_suffix(monkeypatch):
    import pyarrow as pa

    made = []
    before = conversations.state_before
    monkeypatch.setattr(conversations, "state_before", lambda sign, after: made.append(sign) or before(sign, after))
    words = sorted(w[::-1] for w in ["ua", "sua", "xua", "uaua", "suaua", "uauaua"])
    list(conversations._audited([pa.RecordBatch.from_pydict({"mirrored": words[:3]}), pa.RecordBatch.from_pydict({"mirrored": words[3:]})]))
    suffixes = {w[:k] for w in words for k in range(1, len(w) + 1)}
    assert len(made) == len(suffixes)


def brute_conversations(rows):
    def null(x):
        return " " if x is None else str(x)

    kept = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        harm = zlib.crc32(f"{null(conv)}:{null(turn)}".encode()) % 20
        text = "" if harm == 1 else re.sub("[.!?]", "", null(text)) if harm == 2 else null(text)
        role = "user" if harm == 4 else null(role)
        kept[conv] += [(turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    out = {}
    for conv, found in kept.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        turns = [t for t, _, _ in found if t is not None]
        signs, counts, seen = "", Counter(), set()
        for _, role, text in found:
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            body = text.rstrip(" \t\n\x0b\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            signs += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        cost, audit = brute_repair(signs)
        lines, i, g = [], 0, 0
        for edit in audit:
            role, text = ({2: "assistant"}.get(g, "user"), "") if edit == "I" else found[i][1:]
            i += edit != "I"
            if edit == "D":
                continue
            role = {2: "assistant"}.get(g, "user") if edit == "R" else role
            lines.append(f"{role}:{text}")
            g = {"s": 1, "u": 2, "a": 3}[role[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)
    return out


def test_conversation_repair(spark):
    rng = random.Random(14)
    texts = ["Hi.", "Hi.", "no end", "", " \t\n", None, "Ok? ", "Wait!  \r\n", "é.", "Long " * 500 + "."]
    rows = []
    for conv in [*range(60), None]:
        for turn in rng.sample([None, *range(12)], rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "system", "tool", None, "", "User", "usher"])
            rows.append((conv, turn, role, rng.choice(texts)))
    rows += rows[:40]  # repeated rows
    long = [(777, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(3000)]
    extra = "conv_id long, turn long, role string, text string, harm int, conv string, digest string, cost int"
    given = spark.createDataFrame([(*r, 1, "c", "d", 2) for r in rows + long], extra)
    found = conversations.repair(conversations.damaged(given), given)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r.conv_id: tuple(r[n] for n in names) for r in found.collect()}
    audit = got.pop(777)[6]
    left = [zlib.crc32(f"777:{t}".encode()) % 20 for t in range(3000)]
    assert len(audit.replace("I", "")) == sum(h != 0 for h in left) + left.count(3)
    assert got == brute_conversations(rows)
    empty = given.limit(0)
    assert conversations.repair(conversations.damaged(empty), empty).count() == 0
