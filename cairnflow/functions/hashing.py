"""Stable hashes, buckets and keys. SHA-256 buckets are SQL expressions; BLAKE2b ones need an Arrow function."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_id(path: Column, line: Column) -> Column:
    return F.sha2(F.concat(path, F.lit(":"), line.cast("string")), 256)


def selection_hash(*keys: Column) -> Column:
    """SHA-256 of the keys joined by NUL."""
    return F.sha2(F.concat_ws("\u0000", *keys), 256)


def sha_bucket(key: Column, buckets: int) -> Column:
    """SHA-256 of the key as a 256-bit big-endian number modulo buckets, folded eight hex digits at a time."""
    h = F.sha2(key.cast("string"), 256)
    out = F.lit(0).cast("long")
    step = pow(16, 8, buckets)
    for i in range(8):
        part = F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")
        out = F.pmod(out * step + part, F.lit(buckets))
    return out


def blake_bucket(buckets: int, person: bytes = b"", order: str = "big"):
    """Arrow function: BLAKE2b-64 of the text modulo buckets."""

    @F.pandas_udf("long")
    def bucket(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else int.from_bytes(hashlib.blake2b(str(x).encode(), digest_size=8, person=person).digest(), order) % buckets)

    return bucket


def blake_score(seed: int):
    """Arrow function: BLAKE2b-64 of `seed:id` as a signed number, for sampling by the smallest score."""

    @F.pandas_udf("string")
    def score(s: pd.Series) -> pd.Series:
        return s.map(lambda x: hashlib.blake2b(f"{seed}:{x}".encode(), digest_size=8).hexdigest())

    return score


def business_key(order_id: Column, search_id: Column) -> Column:
    return F.concat_ws("\u001f", order_id, search_id)


def user_token(user: Column, buckets: int = 2000) -> Column:
    """`<U_0042>`: the user's bucket, padded to four digits or as many as the largest has."""
    return F.concat(F.lit("<U_"), F.lpad(sha_bucket(user, buckets).cast("string"), max(4, len(str(buckets - 1))), "0"), F.lit(">"))
