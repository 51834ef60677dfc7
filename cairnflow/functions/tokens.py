"""Identifier tokens, keys and packed codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def identifier_key(sid: Column, dedup: Column, gid: Column | None = None) -> Column:
    """`g1-..-g6|s1-s2-s3`, or without the first part, with `|dN` where a dedup code (0 or more) is given."""
    key = F.array_join(F.transform(sid, lambda c: c.cast("string")), "-")
    if gid is not None:
        key = F.concat(F.array_join(F.transform(gid, lambda c: c.cast("string")), "-"), F.lit("|"), key)
    return F.when(dedup >= 0, F.concat(key, F.lit("|d"), dedup.cast("string"))).otherwise(key)


def identifier_content(sid: Column, dedup: Column, gid: Column | None = None, order: str = "gid_sid") -> Column:
    """Tokens `<G1_5>`, `<S1_7>` and last `<D_0>` in one text."""
    part = lambda codes, letter: F.array_join(F.transform(codes, lambda c, i: F.concat(F.lit(f"<{letter}"), (i + 1).cast("string"), F.lit("_"), c.cast("string"), F.lit(">"))), "")
    parts = [part(sid, "S")]
    if gid is not None:
        parts.insert(0 if order == "gid_sid" else 1, part(gid, "G"))
    return F.concat(*parts, F.when(dedup >= 0, F.concat(F.lit("<D_"), dedup.cast("string"), F.lit(">"))).otherwise(F.lit("")))


def collision_content(codes: Column) -> Column:
    """Always four tokens: three levels and the collision code."""
    return F.array_join(F.transform(codes, lambda c, i: F.concat(F.lit("<"), F.substr(F.lit("ABCD"), (i + 1).cast("int"), F.lit(1)), F.lit("_"), c.cast("string"), F.lit(">"))), "")


def pack(codes: list[Column], capacities: list[int]) -> Column:
    """Mixed-radix number of a code tuple."""
    out = F.lit(0).cast("long")
    for code, capacity in zip(codes, capacities, strict=True):
        out = out * capacity + code
    return out


def digits1024(value: Column) -> Column:
    """Base-1024 digits, highest first; 0 has one digit."""
    n = token_cost(value) - 1
    return F.transform(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda k: F.floor(value / F.pow(F.lit(1024.0), k)).cast("long") % 1024)


def token_cost(value: Column) -> Column:
    """One token for the type and one for each base-1024 digit."""
    return F.lit(2) + sum((F.when(value >= 1024**k, 1).otherwise(0) for k in range(1, 6)), F.lit(0))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading tokens that are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    state = F.struct(F.lit(0).alias("n"), F.lit(True).alias("go"))
    return F.aggregate(same, state, lambda s, e: F.struct((s["n"] + F.when(s["go"] & e, 1).otherwise(0)).alias("n"), (s["go"] & e).alias("go")), lambda s: s["n"])


def safe_prefix_depth(probabilities: list[tuple[int, Column, float]]) -> Column:
    """Walk (depth, probability, threshold) in order while the probability is above; the last depth reached, else 0."""
    go, depth = F.lit(True), F.lit(0)
    for d, p, t in probabilities:
        go = go & (p > t)
        depth = F.when(go, d).otherwise(depth)
    return depth


def ordinal_targets(level: Column, depths: tuple[int, ...] = (3, 4, 5, 6)) -> Column:
    return F.transform(F.array(*[F.lit(d) for d in depths]), lambda d: F.when(level >= d, 1).otherwise(0))
