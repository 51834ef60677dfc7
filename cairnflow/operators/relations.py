"""Typed relations out of names and addresses: patterns, precedence by source, conflicts and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Relation types and the pattern whose group 1 is the number.
NUMERIC = (
    ("building", r"([0-9]{1,4})(?:号楼|栋|幢|座)"),
    ("unit", r"([0-9]{1,4})单元"),
    ("floor", r"([0-9]{1,3})(?:层|楼(?!栋))"),
    ("room", r"([0-9]{1,5})室"),
    ("road_number", r"([0-9]{1,5})号(?!楼|线|口|门|院)"),
    ("gate", r"([0-9]{1,3})号门"),
    ("yard", r"([0-9]{1,4})号院"),
    ("exit", r"([0-9]{1,2})(?:号)?出?口"),
    ("line", r"([0-9]{1,2})号线"),
    ("phase", r"([0-9]{1,2})期"),
)
#: Sources by weight: the highest that names a type decides, if it names one value.
PRIORITY = {"displayname": 3, "address": 2, "alias": 1}


def raw_relations(entities: DataFrame, id_: str, sources: dict[str, int] = PRIORITY, patterns=NUMERIC) -> DataFrame:
    """id, relation, source, priority, value: every match of every pattern in every source."""
    def matches(source: str, weight: int, relation: str, pattern: str) -> Column:
        row = lambda v: F.struct(F.lit(relation).alias("relation"), F.lit(source).alias("source"), F.lit(weight).alias("priority"), v.cast("int").alias("value"))
        return F.transform(F.regexp_extract_all(F.coalesce(F.col(source), F.lit("")), F.lit(pattern), F.lit(1)), row)

    found = [matches(s, w, r, p) for s, w in sources.items() for r, p in patterns]
    return entities.select(id_, F.explode(F.concat(*found)).alias("x")).select(id_, "x.*")


def resolve(raw: DataFrame, id_: str) -> DataFrame:
    """id, relation, priority, value, conflict: the highest source's value, null with conflict where it has several."""
    per = raw.groupBy(id_, "relation", "priority").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    top = per.groupBy(id_, "relation").agg(F.max(F.struct("priority", "low", "high")).alias("t"))
    conflict = F.col("t.low") != F.col("t.high")
    return top.select(id_, "relation", F.col("t.priority").alias("priority"), F.when(~conflict, F.col("t.low")).alias("value"), conflict.alias("conflict"))


def wide(resolved: DataFrame, id_: str, types: list[str], most: int) -> DataFrame:
    """One column a type: the value in [0, most], else -1."""
    ok = resolved.where(~F.col("conflict") & F.col("value").between(0, most))
    return ok.groupBy(id_).agg(*[F.coalesce(F.max(F.when(F.col("relation") == t, F.col("value"))), F.lit(-1)).alias(t) for t in types])


def parent_child(name: Column) -> tuple[Column, Column]:
    """(parent, child) of `parent(child)`, or of `parent-child` at the last hyphen; else the name alone."""
    bracket = r"^(.+?)[(（](.+?)[)）]\s*$"
    dash = r"^(.+)-([^-]+)$"
    has = lambda p: F.regexp_like(name, F.lit(p))
    part = lambda p, g: F.trim(F.regexp_extract(name, p, g))
    return F.when(has(bracket), part(bracket, 1)).when(has(dash), part(dash, 1)).otherwise(name), F.when(has(bracket), part(bracket, 2)).when(has(dash), part(dash, 2)).otherwise(F.lit(""))


def tree_paths(values: DataFrame, group: list[str], id_: str, roles: list[str], parents: dict[str, str]) -> DataFrame:
    """id, path, leaf_size, leaf_code. A role is active in a group where its values vary (missing, -1, counts as one), or
    a descendant's do and a row has it; a row's path is its present active roles in order; rows of one
    leaf get codes by whole-number id, -1 alone."""
    varies = values.groupBy(*group).agg(*[(F.min(r) != F.max(r)).alias(f"v_{r}") for r in roles], *[(F.max(r) >= 0).alias(f"h_{r}") for r in roles])
    below: dict[str, list[str]] = {r: [] for r in roles}
    for r in roles:
        up = parents.get(r)
        while up:
            below[up].append(r)
            up = parents.get(up)
    active = [((F.col(f"v_{r}") | (F.lit(False) if not below[r] else F.greatest(*[F.col(f"v_{b}") for b in below[r]]) if len(below[r]) > 1 else F.col(f"v_{below[r][0]}"))) & F.col(f"h_{r}")).alias(f"a_{r}") for r in roles]
    both = values.join(varies.select(*group, *active), group)
    steps = F.array(*[F.when(F.col(f"a_{r}") & (F.col(r) >= 0), F.concat(F.lit(f"{r}="), F.col(r).cast("string"))) for r in roles])
    out = both.select(*group, id_, F.array_join(F.filter(steps, lambda x: x.isNotNull()), "/").alias("path"))
    w = Window.partitionBy(*group, "path")
    size = F.count(F.lit(1)).over(w)
    return out.withColumn("leaf_size", size).withColumn("leaf_code", F.when(size > 1, F.row_number().over(w.orderBy(id_)) - 1).otherwise(-1))


def coverage(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("relation").agg(F.count(F.lit(1)).alias("entities"), F.sum(F.col("conflict").cast("int")).alias("conflicts"), F.countDistinct("value").alias("values"))
