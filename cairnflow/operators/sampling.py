"""Deterministic samples and splits: everything is ordered by a hash and an id, so reruns and partitionings agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def smallest(frame: DataFrame, score: Column, id_: str, k: int) -> DataFrame:
    """The k rows with the smallest score (a feature of the operator), position 1..k; each task keeps k."""
    top = frame.withColumn("__s", score).orderBy("__s", id_).limit(k)
    return top.withColumn("position", F.row_number().over(Window.orderBy("__s", id_))).drop("__s")


def per_stratum(frame: DataFrame, stratum: str, score: Column, id_: str, k: int, reserved: DataFrame | None = None) -> DataFrame:
    """k rows a stratum by smallest score; reserved ids and null strata stay out."""
    rows = frame.where(F.col(stratum).isNotNull())
    if reserved is not None:
        rows = rows.join(reserved.select(id_), id_, "left_anti")
    w = Window.partitionBy(stratum).orderBy(score, id_)
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def generalization_stratum(query_seen: Column, pair_seen: Column, frequency: Column, tail: int = 5) -> Column:
    """Cold targets and the long tail come before anything about the query."""
    return F.when(frequency == 0, "cold").when(frequency <= tail, "long_tail").when(query_seen & ~pair_seen, "seen_query_new_pair").when(~query_seen, "unseen_query")


def membership(train: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (query, target, ...) with query_seen, pair_seen and target_frequency in train (query, target)."""
    q = train.select("query").distinct().withColumn("query_seen", F.lit(True))
    p = train.select("query", "target").distinct().withColumn("pair_seen", F.lit(True))
    f = train.groupBy("target").agg(F.count(F.lit(1)).alias("target_frequency"))
    out = rows.join(q, "query", "left").join(p, ["query", "target"], "left").join(f, "target", "left")
    return out.fillna(False, ["query_seen", "pair_seen"]).fillna(0, ["target_frequency"])


#: Rank error of the approximate quantiles that bracket an exact one.
BRACKET = 0.001


def nth_smallest(frame: DataFrame, order: Column, n: int, m: int):
    """The m-th smallest value (1-based) of a struct column that begins with a number, of n rows; None if there is none.

    Approximate quantiles of the number bracket it; only the rows in the bracket, a fixed small share, are sorted, in one list."""
    if not 1 <= m <= n:
        return None
    rows = frame.select(order.alias("o"))
    first = f"o.{rows.schema['o'].dataType.names[0]}"
    low, high = rows.agg(F.percentile_approx(first, [max(0.0, m / n - BRACKET), min(1.0, m / n + BRACKET)], 20_000)).collect()[0][0]
    low = rows.agg(F.min(first)).collect()[0][0] if m / n <= BRACKET else low
    high = rows.agg(F.max(first)).collect()[0][0] if m / n >= 1 - BRACKET else high
    below = rows.where(F.col(first) < F.lit(low)).count()
    return rows.where(F.col(first).between(F.lit(low), F.lit(high))).orderBy("o").limit(m - below).agg(F.max("o")).collect()[0][0]


def train_dev(frame: DataFrame, score: Column, id_: str, fraction: float) -> DataFrame:
    """split: dev for the smallest scores, as many as n * fraction rounded half to even, at least 1 and at most n - 1.

    score: a text, of which the first 13 hexadecimal digits bracket the border, or a number."""
    n = frame.count()
    size = max(1, min(n - 1, round(n * fraction)))
    number = F.coalesce(F.conv(F.substring(score.cast("string"), 1, 13), 16, 10).cast("long"), F.lit(0)) if frame.select(score).dtypes[0][1] == "string" else score
    order = F.struct(number.alias("n"), score.alias("s"), F.col(id_).alias("i"))
    edge = nth_smallest(frame, order, n, size)
    spark = frame.sparkSession
    border = spark.createDataFrame([(edge,)], frame.select(order.alias("e")).schema)  # one row
    return frame.withColumn("__s", order).crossJoin(F.broadcast(border)).withColumn("split", F.when(F.col("__s") <= F.col("e"), "dev").otherwise("train")).drop("__s", "e")


def contiguous(row_index: Column, total: int, parts: int) -> Column:
    """Part of a 0-based row under boundaries total * r div parts: later parts take the remainder."""
    return F.floor(((row_index + 1) * parts - 1) / total).cast("int")


def optimizer_batch(row_number: Column, rank: int, world: int) -> Column:
    return row_number % world == rank
