"""Secrets, personal data and benchmark passages against plain regular expressions and brute force."""

import base64
import hashlib
import json
import random
import re
import struct

import pytest

from cairnflow.llm import decontam, pii, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)


def base_spans(text, rules):
    out = []
    for order, (kind, pattern, ok) in enumerate(rules):
        out += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text) if ok(m)]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def n_digits(m):
    return sum(c.isdigit() for c in m[0])


def luhn(m):
    d = [int(c) for c in m[0] if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


SECRET_RULES = [
    ("assign", r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
]
PII_RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= n_digits(m) <= 19 and luhn(m)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= n_digits(m) <= 15),
]
EDGES = [None, "", " ", "x" * 200_000, "0" * 30_000, "ascii é 中文 😀 token=abcdefgh1 😀 a@b.co", "\x00\x1f"]


def soup(pieces, seed, n=300, length=25):
    r = random.Random(seed)
    return ["".join(r.choice(pieces) for _ in range(r.randrange(length))) for _ in range(n)]


@pytest.mark.parametrize(
    "module,rules,pieces",
    [
        (
            secrets,
            SECRET_RULES,
            [
                "password",
                "PASSWD",
                "Secret",
                "token",
                "api_key",
                "apikey",
                ":",
                "=",
                " ",
                '"',
                "'",
                "abcdef01",
                "AKIA",
                "ABCDEFGH1234",
                "0123456789abcdef",
                "é",
                "😀",
                "\n",
                "ſ",
                "K",
                "zz",
                "-",
            ],
        ),
        (
            pii,
            PII_RULES,
            [
                "a",
                "b.c",
                "@",
                ".",
                "-",
                "x.org",
                "+",
                "1",
                "12",
                "255",
                "256",
                " ",
                "4111 1111 1111 1111",
                "5500000000000004",
                "(0)",
                "1.2.3.4",
                "é",
                "😀",
                "+1 (555) 010-9999",
                "٣",
                "\n",
                "0.0.0.0.",
            ],
        ),
    ],
)
def test_base_spans_equal_plain_regexes(spark, module, rules, pieces):
    texts = EDGES + soup(pieces, 7)
    rows = {r.doc_id: r for r in module.scan_digest(docs_of(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        want = base_spans(text or "", rules)
        got = rows[i]
        assert got.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (i, text, want, got.spans)
        for kind, *_ in rules:
            assert got[f"n_{kind}"] == sum(s.startswith(kind + ":") for s in want.split(","))
        assert set(filter(None, want.split(","))) <= set(got.spans.split(","))


def der(tag, body):
    n = len(body)
    head = bytes([n]) if n < 128 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + body


def test_structures_are_confirmed_and_lookalikes_are_not():
    r = random.Random(1)
    number = lambda n: der(2, b"\x01" + r.randbytes(n))
    key = der(0x30, der(2, b"\0") + b"".join(number(64) for _ in range(8)))
    b64 = base64.b64encode(key).decode()
    wrapped = "\n".join(b64[i : i + 64] for i in range(0, len(b64), 64))
    field = lambda b: struct.pack(">I", len(b)) + b
    ssh = base64.b64encode(field(b"ssh-ed25519") + field(r.randbytes(32))).decode()
    url = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    jwt = f"{url(json.dumps({'alg': 'HS256', 'typ': 'JWT'}).encode())}.{url(b'{}' + r.randbytes(20))}.{url(r.randbytes(32))}"
    for text, kind in ((b64, "der"), (key.hex(), "der"), (f"-----BEGIN RSA PRIVATE KEY-----\n{wrapped}\n-----END RSA PRIVATE KEY-----", "der"), (ssh, "ssh"), (jwt, "jwt")):
        at = [s for s in secrets.find(f"see {text} here") if s[2] == kind]
        assert at == [(4, 4 + len(text), kind)], (kind, text)
    for _ in range(300):
        noise = base64.b64encode(r.randbytes(r.randrange(30, 300))).decode()
        assert not {s[2] for s in secrets.find(noise)} - set(secrets.BASE)
    assert not [s for s in secrets.find(base64.b64encode(key[:-9]).decode()) if s[2] == "der"]
    assert not [s for s in secrets.find(f"{url(b'{}')}.{url(b'abcdef')}.x" * 2) if s[2] == "jwt"]


def test_more_personal_data():
    auto = pii.anchors()
    kinds = lambda t: [(k, t[a:b]) for a, b, k in pii.find(t, auto)]
    assert ("iban", "GB82 WEST 1234 5698 7654 32") in kinds("IBAN: GB82 WEST 1234 5698 7654 32.")
    assert "iban" not in dict(kinds("IBAN: GB82 WEST 1234 5698 7654 33."))
    assert ("ssn", "123-45-6789") in kinds("SSN 123-45-6789")
    assert "ssn" not in dict(kinds("part 123-45-6789, SSN 666-45-6789"))
    assert ("userinfo", "ann:pw") in kinds("https://ann:pw@host/x")


def brute_hits(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for name, item in items:
            v = words(item)
            if name is None or not v:
                continue
            m = min(10, len(v))
            for a in range(len(v) - m + 1):
                for b in range(len(w) - m + 1):
                    if w[b : b + m] == v[a : a + m]:
                        hit.update(range(b, b + m))
                        names.add(str(name))
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("part_words", [100_000, 25])
def test_decontamination_equals_brute_force(spark, part_words):
    r = random.Random(3)
    vocabulary = ["a", "B", "c", "é", "d1", "中"]
    make = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "\x7f"]) for _ in range(n))
    items = [(k, make(n)) for k, n in enumerate([3, 3, 4, 7, 10, 12, 15, 30, 40, 2])] + [(None, "a"), (50, None), (51, ""), (10, "a B c d1 a B"), (10, "c c c"), (7, make(12))]
    texts = [make(r.randrange(60)) for _ in range(60)] + [items[7][1] + make(9) + items[8][1].upper(), items[6][1][:-3], None, "", "?", "a"] + [t for _, t in items]
    got = {x.doc_id: tuple(x)[1:] for x in decontam.report(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string"), part_words=part_words).collect()}
    assert got == brute_hits(list(enumerate(texts)), items)


def test_decontaminate_keeps_columns_and_empty_tables(spark):
    docs = spark.createDataFrame(
        [(1, "one two three four five six seven eight nine ten eleven", 5, "x"), (2, "clean", 6, "y"), (3, None, 7, "z")],
        "doc_id long, text string, __items long, item_id string",
    )
    bench = spark.createDataFrame([(1, "ONE two three four five six seven eight nine ten")], "item_id long, text string")
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert decontam.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.report(docs.limit(0), bench).count() == 0
    assert secrets.scan_digest(docs.limit(0)).count() == 0
