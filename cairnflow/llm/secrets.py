"""Secret scan with structural confirmation.

Patterns of assignments, access keys and long hex runs are reported as they match (the base kinds). Beyond them,
every base64 or hex candidate is decoded and reported only if its bytes have the structure of a key: DER with
nested lengths that add up to the byte (`der`), the length-prefixed fields of an OpenSSH key (`ssh`), or a signed
token whose header is a JSON object that names an algorithm (`jwt`). Random text that merely looks like base64
fails these parses and is left alone.

Nulls and empty texts have no spans; an empty table gives an empty one. Spans count code points, end exclusive. Whole texts
are searched; rows do not depend on each other, so ties, repeats and extra columns change nothing. What is found in one place
of a text does not depend on the rest of it.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import struct

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cairnflow.llm.common import map_rows

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "jwt", "ssh", "der")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{10,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*)")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----\s*((?:[A-Za-z0-9+/=]+\s+)+?)-----END \1-----")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_ANY = re.compile(r"(?:[0-9a-f]{2}){24,}|(?:[0-9A-F]{2}){24,}")
#: A token's payload between its two dots: what a text without it can't hold as a token.
PAYLOAD = re.compile(r"\.[A-Za-z0-9_-]{4,}\.")
SSH_TYPE = re.compile(rb"(ssh-(rsa|dss|ed25519)|ecdsa-sha2-nistp\d+|sk-[a-z0-9@.-]+)$")


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """(length, where the content begins) of a DER length at `at`; None if it is not minimal or too long."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return first, at + 1
    n = first & 0x7F
    if not 1 <= n <= 4 or at + 1 + n > len(data):
        return None
    length = int.from_bytes(data[at + 1 : at + 1 + n], "big")
    if length < 0x80 or (n > 1 and data[at + 1] == 0):
        return None
    return length, at + 1 + n


def der_items(data: bytes, at: int, end: int, depth: int = 0) -> list[int] | None:
    """Tags at this level if data[at:end] is whole DER values whose constructed ones nest properly; else None."""
    tags = []
    while at < end:
        tag = data[at]
        got = der_length(data, at + 1)
        if got is None or got[1] + got[0] > end:
            return None
        length, begin = got
        if tag == 0x02 and length == 0 or tag in (0x05, 0x00) and length:
            return None
        if tag in (0x30, 0x31) or 0xA0 <= tag <= 0xA3:
            if depth > 12 or der_items(data, begin, begin + length, depth + 1) is None:
                return None
        elif tag not in (0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x0A, 0x0C, 0x13, 0x16, 0x17, 0x18) and not 0x80 <= tag <= 0x8F:
            return None
        tags.append(tag)
        at = begin + length
    return tags


def is_der_key(data: bytes) -> bool:
    """One outer SEQUENCE that fills data (but for up to 2 bytes of base64 slack) and holds a key's fields."""
    if len(data) < 24 or data[0] != 0x30:
        return False
    got = der_length(data, 1)
    if got is None or not 0 <= len(data) - got[0] - got[1] <= 2:
        return False
    inner = der_items(data, got[1], got[1] + got[0])
    if not inner or len(inner) < 2:
        return False
    return inner[:2] in ([0x02, 0x02], [0x02, 0x04], [0x02, 0x30], [0x30, 0x03], [0x30, 0x04], [0x30, 0x30])


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key, or a public one: length-prefixed fields, the first a key type."""
    if data.startswith(b"openssh-key-v1\0"):
        data = data[15:]
        private = True
    else:
        private = False
    at, fields = 0, []
    while at + 4 <= len(data) and len(fields) < 8:
        (n,) = struct.unpack_from(">I", data, at)
        if at + 4 + n > len(data):
            break
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
        if private and len(fields) == 3:
            return True
    return not private and len(fields) >= 2 and at >= len(data) - 2 and bool(SSH_TYPE.match(fields[0]))


def unbase64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        body = body[:-1]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(header: str, payload: str) -> bool:
    head = unbase64(header)
    try:
        parsed = json.loads(head) if head and head[:1] == b"{" else None
    except (ValueError, RecursionError):
        return False
    return isinstance(parsed, dict) and isinstance(parsed.get("alg"), str) and unbase64(payload) is not None


def kind_of(data: bytes | None) -> str | None:
    if not data:
        return None
    return "ssh" if is_ssh_key(data) else "der" if is_der_key(data) else None


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span of a text, by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(c in low for c in ASSIGN_CUES):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # hex and base64 candidates hold no white space and 32 characters or more
    long = max(map(len, text.split()), default=0) >= 32
    if long:
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    found += confirmed(text, long)
    if len(found) > 1:
        found = sorted(set(found), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return found


def confirmed(text: str, long: bool = True) -> list[tuple[int, int, str]]:
    """The spans whose structure is a key's or token's; long: whether there is a run of 32 characters."""
    out, taken = [], []
    if PAYLOAD.search(text):
        for m in JWT.finditer(text):
            if is_signed_token(m[1], m[2]):
                out.append((m.start(), m.end(), "jwt"))
                taken.append(m.span())
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            if kind := kind_of(unbase64("".join(m[2].split()))):
                out.append((m.start(), m.end(), kind))
                taken.append(m.span())
    if not long:
        return out
    free = lambda m: not any(a < m.end() and m.start() < b for a, b in taken)
    for m in HEX_ANY.finditer(text):
        if free(m) and (kind := kind_of(bytes.fromhex(m[0]))):
            out.append((m.start(), m.end(), kind))
            taken.append(m.span())
    for m in BASE64.finditer(text):
        if free(m) and (kind := kind_of(unbase64(m[0]))):
            out.append((m.start(), m.end(), kind))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with `secret_spans`: array of (kind, start, end)."""

    def work():
        return lambda texts: [[[{"kind": k, "start": a, "end": b} for a, b, k in find(t)] if t else [] for t in texts]]

    return map_rows(docs, [text], T.StructType([T.StructField("secret_spans", SPAN)]), work, keep)


NONE = hashlib.sha256(b"").hexdigest()


def digest(spans: list[tuple[int, int, str]], base: tuple[str, ...]) -> str:
    own = [s for s in spans if s[2] in base]
    return hashlib.sha256(joined(own).encode()).hexdigest() if own else NONE


def scan_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each document."""
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in BASE] + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")]

    def work():
        def rows(texts):
            all_ = [find(t) if t else [] for t in texts]
            return [[sum(s[2] == k for s in x) for x in all_] for k in BASE] + [[digest(x, BASE) for x in all_], [joined(x) for x in all_]]

        return rows

    return map_rows(docs, ["text"], T.StructType(fields), work, ["doc_id"])
