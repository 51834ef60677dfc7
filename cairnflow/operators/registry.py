"""The identifier methods: which table of codes, which template and which stages each of them has."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from cairnflow.operators import builders


@dataclass(frozen=True)
class Method:
    """kind: identifier_table()'s scheme; template: user_content()'s; levels: codes of an identifier; located: whether a geohash leads."""

    kind: str
    template: str
    levels: tuple[str, ...] = ("s1", "s2", "s3")
    located: bool = False
    stages: tuple[str, ...] = ("codes", "identifiers", "messages", "evaluation")


METHODS = {
    "plain": Method("dedup", "plain", located=True),
    "genpoi": Method("dedup", "genpoi", located=True),
    "tiger": Method("collision", "tiger"),
    "gnpr": Method("optional", "gnpr"),
    "final": Method("dedup", "tiger"),
    "aligned": Method("paired", "tiger"),
}


def method_names() -> list[str]:
    return sorted(METHODS)


def identifiers(name: str, codes: DataFrame, id_: str, gid: str | None = None) -> DataFrame:
    """The identifier table of a method; gid names the geohash column of methods that need one."""
    m = METHODS[name]
    if m.located and gid is None:
        raise ValueError(f"{name} needs a geohash column")
    return builders.identifier_table(codes, id_, list(m.levels), m.kind, gid if m.located else None)


def training(name: str, orders: DataFrame, table: DataFrame, id_: str, split: Column) -> DataFrame:
    """The training messages of a method over its identifier table."""
    ids = table.select(table[id_].cast("string").alias("poi"), "content")
    return builders.training_rows(orders, ids, METHODS[name].template, split)
