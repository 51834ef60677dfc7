"""Active catalogs, set counts, alignment and row contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active_ids(current: DataFrame, history: DataFrame, id_: str) -> DataFrame:
    """id, in_current, in_history: distinct ids of both, one aggregation over their union."""
    both = current.select(id_, F.lit(True).alias("c"), F.lit(False).alias("h")).unionByName(history.select(id_, F.lit(False).alias("c"), F.lit(True).alias("h")))
    return both.where(F.col(id_).isNotNull()).groupBy(id_).agg(F.bool_or("c").alias("in_current"), F.bool_or("h").alias("in_history"))


def set_counts(active: DataFrame) -> DataFrame:
    c, h = F.col("in_current"), F.col("in_history")
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    return active.agg(
        n(c).alias("current_ids"),
        n(h).alias("history_ids"),
        n(c & h).alias("both"),
        n(c & ~h).alias("only_current"),
        n(h & ~c).alias("only_history"),
        F.count(F.lit(1)).alias("union_ids"),
    )


def filter_catalog(catalog: DataFrame, active: DataFrame, id_: str) -> tuple[DataFrame, DataFrame]:
    """(active rows, faults): faults has id and `duplicate` or `missing`."""
    kept = catalog.join(active.select(id_), id_, "left_semi")
    twice = kept.groupBy(id_).count().where("count > 1").select(id_, F.lit("duplicate").alias("fault"))
    gone = active.select(id_).join(catalog.select(id_), id_, "left_anti").select(id_, F.lit("missing").alias("fault"))
    return kept, twice.unionByName(gone)


def alignment(frames: list[DataFrame], index: str, columns: list[str]) -> DataFrame:
    """One row: rows in all frames, in some only, and rows in all whose columns differ."""
    marked = [f.select(index, F.struct(*columns).alias(f"s{i}"), F.lit(True).alias(f"m{i}")) for i, f in enumerate(frames)]
    both = reduce(lambda a, b: a.join(b, index, "full"), marked)
    everywhere = reduce(lambda a, b: a & b, [F.coalesce(f"m{i}", F.lit(False)) for i in range(len(frames))])
    same = reduce(lambda a, b: a & b, [F.col("s0").eqNullSafe(F.col(f"s{i}")) for i in range(1, len(frames))])
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return both.agg(n(everywhere).alias("aligned"), n(~everywhere).alias("missing"), n(everywhere & ~same).alias("different"))


def monotone_rows(ids: DataFrame, source: DataFrame, id_: str) -> DataFrame:
    """One row: ids found, and how often the source's row index does not grow along the ids' own order.

    Neighbours are compared within ranges of the order and across their edges, so no task sorts all rows."""
    both = ids.select(id_, F.col("position")).join(source.select(id_, F.col("row_index")), id_)
    block = F.floor(F.col("position") / 65_536)
    w = Window.partitionBy("b").orderBy("position")
    inner = both.withColumn("b", block).withColumn("p", F.lag("row_index").over(w))
    edges = inner.groupBy("b").agg(
        F.count(F.lit(1)).alias("found"),
        F.sum(F.when(F.col("p") >= F.col("row_index"), 1).otherwise(0)).alias("bad"),
        F.min_by("row_index", "position").alias("first"),
        F.max_by("row_index", "position").alias("last"),
    )
    across = edges.withColumn("q", F.lag("last").over(Window.orderBy("b")))  # one row a block of 65,536
    return across.agg(F.sum("found").alias("found"), F.sum(F.col("bad") + F.when(F.col("q") >= F.col("first"), 1).otherwise(0)).alias("out_of_order"))


def contract(checks: dict[str, Column]) -> Column:
    """Array of the names of the rules that a row breaks; a null check counts as broken."""
    return F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())


def anomalies(frame: DataFrame, faults: Column) -> DataFrame:
    return frame.select(F.explode(faults).alias("fault")).groupBy("fault").agg(F.count(F.lit(1)).alias("rows"))


def equivalent(frame: DataFrame, signature: list[str], id_: str) -> DataFrame:
    """id, representative: rows with one signature; null signatures stand alone."""
    least = frame.groupBy(*signature).agg(F.min(id_).alias("__least"))
    # an equi-join: a null in a signature equals nothing, so such rows find no other
    return frame.select(id_, *signature).join(least, signature, "left").select(id_, F.coalesce("__least", id_).alias("representative"))


def vocabulary(values: DataFrame, value: str, min_support: int, most: int) -> DataFrame:
    """value, n, id (1-based): support at least min_support, by count desc and value, at most `most` (a feature)."""
    top = values.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(value).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_support).orderBy(F.desc("n"), value).limit(most)
    return top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), value)))


def top_features(interactions: DataFrame, key: str, feature: str, k: int) -> DataFrame:
    """key, top: the k most frequent features, by count desc and feature, as an array in that order."""
    n = interactions.groupBy(key, feature).agg(F.count(F.lit(1)).alias("n"))
    best = n.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), feature))).where(F.col("r") <= k)
    return best.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", feature))), lambda s: s[feature]).alias("top"))
