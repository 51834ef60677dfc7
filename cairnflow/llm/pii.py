"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text: at-signs, schemes, plus signs, digits and identifier
cues. From each anchor a deterministic local parser expands to the boundaries of an address or account and
validates it: e-mail labels, octets, the Luhn sum, the digits of a phone number (the base kinds), and beyond
them the check digits of an IBAN, the areas of a social security number and the user part of a URL. Text
without anchors is never parsed.

Nulls and empty texts have no spans. Spans count code points, end exclusive, and do not overlap within a kind.
Rows do not depend on each other, so ties, repeats and extra columns change nothing; an empty table gives an empty one.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cairnflow.llm.common import map_rows
from cairnflow.llm.secrets import SPAN, digest, joined

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "userinfo")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[\x20:#=]{0,3}(?:no\.?|number)?[\x20:#=]{0,3}([A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
SSN = re.compile(r"[\x20:#=]{0,3}(?:no\.?|number)?[\x20:#=]{0,3}([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
USERINFO = re.compile(r"://([^\s/?#@:]+(?::[^\s/?#@]*)?)@(?=[A-Za-z0-9\[])")

CUES = {"iban": ("iban", "IBAN", "Iban"), "ssn": ("ssn", "SSN", "social security", "Social Security", "Social security")}


def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sign in ("@", "+", "://", *"0123456789"):
        found.add_word(sign, ("digit" if sign.isdigit() else sign, len(sign)))
    for kind, cues in CUES.items():
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    body = text.replace(" ", "")
    return 15 <= len(body) <= 34 and int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97 == 1


def find(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span of a text, by start, then kind as listed."""
    found: list[tuple[int, int, str]] = []
    done = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended; matches of a kind don't overlap

    def put(kind: str, start: int, end: int, valid: bool) -> None:
        done[kind] = end
        if valid:
            found.append((start, end, kind))

    for last, (kind, size) in automaton.iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= done["ip"]:
                if m := IP.match(text, at):
                    put("ip", at, m.end(), all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or "0") <= 255 for g in m.groups()))
                else:  # the run's other digits meet the same end
                    done["ip"] = DIGITS.match(text, at).end()
            if at >= done["card"] and (m := CARD.match(text, at)):
                digits = m[0].replace(" ", "").replace("-", "")
                put("card", at, m.end(), 14 <= len(digits) <= 19 and luhn(digits))
        elif kind == "@":
            if at >= done["email"] and (m := DOMAIN.match(text, at)):
                start, floor = at, done["email"]
                while start > floor and text[start - 1] in LOCAL:
                    start -= 1
                if start < at:
                    put("email", start, m.end(), True)
        elif kind == "+":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                put("phone", at, m.end(), 10 <= sum(c.isdigit() for c in m[0]) <= 15)
        elif kind == "://":
            if at >= done["userinfo"] and (m := USERINFO.match(text, at)):
                put("userinfo", m.start(1), m.end(1), True)
        elif kind == "iban":
            if (m := IBAN.match(text, last + 1)) and m.start(1) >= done["iban"]:
                put("iban", m.start(1), m.end(1), iban_ok(m[1]))
        elif (m := SSN.match(text, last + 1)) and m.start(1) >= done["ssn"]:
            put("ssn", m.start(1), m.end(3), m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000")
    if len(found) > 1:
        found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with `pii_spans`: array of (kind, start, end)."""

    def work():
        automaton = anchors()
        return lambda texts: [[[{"kind": k, "start": a, "end": b} for a, b, k in find(t, automaton)] if t else [] for t in texts]]

    return map_rows(docs, [text], T.StructType([T.StructField("pii_spans", SPAN)]), work, keep)


def scan_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each document."""
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in BASE] + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")]

    def work():
        automaton = anchors()

        def rows(texts):
            all_ = [find(t, automaton) if t else [] for t in texts]
            return [[sum(s[2] == k for s in x) for x in all_] for k in BASE] + [[digest(x, BASE) for x in all_], [joined(x) for x in all_]]

        return rows

    return map_rows(docs, ["text"], T.StructType(fields), work, ["doc_id"])
