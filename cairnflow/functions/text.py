"""Text normalisers and n-gram similarities. The normalisers differ on purpose; none stands in for another."""

from __future__ import annotations

import difflib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Punctuation of queries and its ASCII form, position by position, and the dashes of relation texts.
CJK_PUNCTUATION = "，、。！？；：（）【】《》“”‘’—–－"
ASCII_PUNCTUATION = ",,.!?;:()[]<>\"\"''---"
DASHES = "—–−"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def conservative(text: Column, unicode: bool = True) -> Column:
    """NFKC, lower case, CJK punctuation and dashes to ASCII, white space runs to one space, trimmed; empty becomes null.

    NFKC comes first, so that an ellipsis is three dots already."""
    t = F.lower(nfkc(text) if unicode else text)
    t = F.replace(F.translate(t, CJK_PUNCTUATION, ASCII_PUNCTUATION), F.lit("…"), F.lit("..."))
    return F.nullif(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(""))


def compact(text: Column, unicode: bool = True) -> Column:
    """NFKC, lower case, without any white space."""
    return F.regexp_replace(F.lower(nfkc(text) if unicode else text), r"\s", "")


def letters_only(text: Column, unicode: bool = True) -> Column:
    """NFKC, letters and digits only, lower case; null becomes empty."""
    t = nfkc(text) if unicode else text
    return F.coalesce(F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}]", "")), F.lit(""))


def folded(text: Column) -> Column:
    """NFKC, case-folded, without white space."""
    return F.regexp_replace(nfkc_casefold(text), r"\s", "")


@F.pandas_udf(T.StringType())
def identity(s: pd.Series) -> pd.Series:
    """Static text for identity checks: JSON values with sorted keys, NFKC, case-folded, letters and digits only."""

    def one(x):
        if x is None:
            return ""
        if x[:1] in "[{":
            try:
                x = json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            except ValueError:
                pass
        return "".join(c for c in unicodedata.normalize("NFKC", x).casefold() if c.isalnum())

    return s.map(one)


def relation_text(text: Column, unicode: bool = True) -> Column:
    """NFKC, upper case, every dash a hyphen, no white space; null becomes empty."""
    t = F.upper(nfkc(text) if unicode else text)
    return F.coalesce(F.regexp_replace(F.translate(t, DASHES, "-" * len(DASHES)), r"\s", ""), F.lit(""))


def character_ngrams(text: Column, width: int = 2) -> Column:
    """Distinct n-grams of the text without spaces; a shorter text is its own n-gram, an empty one has none."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")
    grams = F.transform(F.sequence(F.lit(1), F.length(t) - (width - 1)), lambda i: F.substr(t, i, F.lit(width)))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) < width, F.array(t)).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two distinct arrays; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def tiered_similarity(query: Column, text: Column) -> Column:
    """1 if equal; else by containment and length ratio; else the longest-blocks ratio. Empty on either side is 0."""
    shorter = F.least(F.length(query), F.length(text)) / F.greatest(F.length(query), F.length(text), F.lit(1))
    # the ratio is taken in Python, so only where no other branch decides
    open_ = ~F.contains(text, query) & ~F.contains(query, text)
    tail = sequence_ratio(F.when(open_, query), F.when(open_, text))
    return (
        F.when((F.length(query) == 0) | (F.length(text) == 0), 0.0)
        .when(query == text, 1.0)
        .when(F.contains(text, query), 0.90 + 0.10 * shorter)
        .when(F.contains(query, text), 0.85 + 0.15 * shorter)
        .otherwise(tail)
    )


def lexical_relevance(query: Column, name: Column, aliases: Column, address: Column, category: Column) -> Column:
    """Best of the name and any alias (array), 0.8 of the address and 0.6 of the category, all letters_only texts."""
    best_alias = best_of(query, aliases)
    return F.greatest(tiered_similarity(query, name), best_alias, 0.8 * tiered_similarity(query, address), 0.6 * tiered_similarity(query, category))


@F.pandas_udf(T.DoubleType())
def best_of(query: pd.Series, texts: pd.Series) -> pd.Series:
    """The largest tiered similarity of a query to any of several texts; 0 without texts."""

    def one(x: str, y: str) -> float:
        if not x or not y:
            return 0.0
        if x == y:
            return 1.0
        short, long = sorted((len(x), len(y)))
        if x in y:
            return 0.9 + 0.1 * short / long
        if y in x:
            return 0.85 + 0.15 * short / long
        return difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()

    return pd.Series([max((one(q, t) for t in (ts if ts is not None else ())), default=0.0) if q else 0.0 for q, ts in zip(query, texts, strict=True)], dtype=float)


def tagged(text: Column, tag: str, after: str = "") -> Column:
    """What stands between <tag> and the last </tag> (followed by `after`); null without the tags."""
    found = F.regexp_extract(text, rf"(?s)<{tag}>(.*)</{tag}>{after}", 1)
    return F.when(F.contains(text, F.lit(f"<{tag}>")), found)


def length_bucket(text: Column) -> Column:
    n = F.length(F.trim(text))
    return F.when(n <= 2, "1-2").when(n <= 5, "3-5").when(n <= 10, "6-10").otherwise(">10")


# Digits and units of written Chinese numbers.
CHINESE_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
CHINESE_UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10000}


def _small(text: str) -> int:
    """The value of a group below ten thousand: a sum of digit-and-unit terms and a last digit.

    A unit without a digit before it counts once; of several digits in a row the last one counts."""
    terms = re.findall(f"[{''.join(CHINESE_DIGITS)}]*[{''.join(CHINESE_UNITS)}]|[{''.join(CHINESE_DIGITS)}]+$", text)
    value = 0
    for term in terms:
        unit = CHINESE_UNITS.get(term[-1])
        digits = term if unit is None else term[:-1]
        value += (CHINESE_DIGITS[digits[-1]] if digits else 1) * (unit or 1)
    return value


def parse_integer(text: str | None) -> int | None:
    """ASCII digits, Chinese digits one by one, or positional Chinese in groups that end with ten thousand.

    Each group before a 万 adds ten thousand times its value (once where that is 0). The text is normalised first as relation
    texts are; null where it is no number."""
    text = "".join(unicodedata.normalize("NFKC", text or "").upper().split())
    if text.isascii() and text.isdigit():
        return int(text)
    if not text or set(text) - CHINESE_DIGITS.keys() - CHINESE_UNITS.keys():
        return None
    if not set(text) & CHINESE_UNITS.keys():
        return int("".join(str(CHINESE_DIGITS[c]) for c in text))
    *groups, rest = text.split("万")
    return sum(10_000 * (_small(g) or 1) for g in groups) + _small(rest)


@F.pandas_udf(T.LongType())
def contextual_integer(s: pd.Series) -> pd.Series:
    return pd.Series([parse_integer(x) for x in s], dtype="Int64")
