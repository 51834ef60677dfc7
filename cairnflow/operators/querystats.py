"""Statistics of a query log: pairs, profiles, masks, entity totals and the laws that tie them together.

A log has one row per choice: query, poi (the entity chosen), optionally raw (the query as typed).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ProfileRule:
    """When a query's first choice is trusted, and which other choices are masked as possible answers."""

    min_query_count: int = 2
    min_pair_count: int = 2
    min_top1_share: float = 0.75
    min_margin: float = 0.25
    max_normalized_entropy: float = 0.55
    mask_min_share: float = 0.10
    mask_min_count: int = 2


def pair_counts(log: DataFrame) -> DataFrame:
    """query, poi, n: the only shuffle of the raw log; map-side sums come first."""
    return log.groupBy("query", "poi").agg(F.count(F.lit(1)).alias("n"))


def distribution(counts: DataFrame, key: list[str], item: str, n: str = "n") -> DataFrame:
    """By key: total, distinct items, the dominant one (count desc, id asc), its share, entropy in nats, and that over
    ln(distinct) (0 for one item). One aggregation: sum n*ln(n) gives the entropy without knowing the total first."""
    x = F.col(n).cast("double")
    out = counts.groupBy(*key).agg(
        F.sum(n).alias("total"),
        F.count(F.lit(1)).alias("distinct_count"),
        F.max(F.struct(F.col(n).alias("c"))).alias("m"),
        F.min_by(item, F.struct(-F.col(n), F.col(item))).alias("dominant_id"),
        F.sum(x * F.log(x)).alias("nlogn"),
    )
    total = F.col("total").cast("double")
    entropy = F.greatest(F.lit(0.0), F.log(total) - F.col("nlogn") / total)
    k = F.col("distinct_count")
    return out.select(
        *key,
        "total",
        "distinct_count",
        "dominant_id",
        F.col("m.c").alias("dominant_count"),
        (F.col("m.c") / total).alias("concentration"),
        F.when(k > 1, entropy).otherwise(0.0).alias("entropy"),
        F.when(k > 1, entropy / F.log(k.cast("double"))).otherwise(0.0).alias("normalized_entropy"),
    )


def query_profile(pairs: DataFrame, rule: ProfileRule = ProfileRule()) -> DataFrame:
    """One row a query: counts, top shares, margin, entropies, the trust flag and the weight of its first choice."""
    d = distribution(pairs, ["query"], "poi")
    by_rank = Window.partitionBy("query").orderBy(F.desc("n"), "poi")
    second = pairs.withColumn("r", F.row_number().over(by_rank)).where("r = 2").select("query", F.col("n").alias("second"))
    out = d.join(second, "query", "left").select(
        "query",
        F.col("total").alias("query_count"),
        F.col("distinct_count").alias("distinct_poi_count"),
        F.col("dominant_id").alias("top1_poi_id"),
        F.col("dominant_count").alias("top1_count"),
        F.col("concentration").alias("top1_share"),
        (F.coalesce("second", F.lit(0)) / F.col("total")).alias("top2_share"),
        "entropy",
        "normalized_entropy",
    )
    out = out.withColumn("margin", F.col("top1_share") - F.col("top2_share"))
    trusted = (F.col("query_count") >= rule.min_query_count) & (F.col("top1_count") >= rule.min_pair_count) & (F.col("top1_share") >= rule.min_top1_share) & (F.col("margin") >= rule.min_margin) & (F.col("normalized_entropy") <= rule.max_normalized_entropy)
    weight = F.greatest(F.lit(0.0), F.least(F.log1p("top1_count"), F.lit(math.log(21.0))) * F.col("top1_share") * F.col("top1_share") * (1 - F.col("normalized_entropy")))
    return out.withColumn("is_high_confidence", trusted).withColumn("sid_weight", F.when(trusted, weight).otherwise(0.0))


def representative(log: DataFrame) -> DataFrame:
    """query, representative_raw: the raw form typed most often (smallest of equals)."""
    forms = log.groupBy("query", "raw").agg(F.count(F.lit(1)).alias("n"))
    return forms.groupBy("query").agg(F.min_by("raw", F.struct(-F.col("n"), F.col("raw"))).alias("representative_raw"))


def pair_shares(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """query, poi, n, share, is_top1, retained, weight."""
    both = pairs.join(profile.select("query", "query_count", "top1_poi_id", "is_high_confidence", "sid_weight"), "query")
    top = F.col("poi") == F.col("top1_poi_id")
    keep = top & F.col("is_high_confidence")
    return both.select(
        "query",
        "poi",
        "n",
        (F.col("n") / F.col("query_count")).alias("pair_share"),
        top.alias("is_top1"),
        keep.alias("retained_for_sid"),
        F.when(keep, F.col("sid_weight")).otherwise(0.0).alias("sid_weight"),
    )


def false_negative_mask(pairs: DataFrame, rule: ProfileRule = ProfileRule()) -> DataFrame:
    """Pairs common enough to be a second right answer."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy("query"))
    return pairs.withColumn("pair_share", share).where((F.col("n") >= rule.mask_min_count) & (F.col("pair_share") >= rule.mask_min_share))


def query_totals(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("query").agg(F.sum("n").alias("order_count"), F.count(F.lit(1)).alias("poi_df"))


def entity_totals(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("poi").agg(F.sum("n").alias("order_count"), F.count(F.lit(1)).alias("query_df"))


def conservation(log: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: the sums that must agree, and whether they do."""
    a = log.agg(F.count(F.lit(1)).alias("log_rows"))
    b = query_totals(pairs).agg(F.sum("order_count").alias("by_query"), F.sum("poi_df").alias("df_by_query"), F.count(F.lit(1)).alias("queries"))
    c = entity_totals(pairs).agg(F.sum("order_count").alias("by_poi"), F.sum("query_df").alias("df_by_poi"), F.count(F.lit(1)).alias("pois"))
    all_ = a.crossJoin(b).crossJoin(c)  # of one row each
    return all_.withColumn("holds", (F.col("log_rows") == F.col("by_query")) & (F.col("by_query") == F.col("by_poi")) & (F.col("df_by_query") == F.col("df_by_poi")))


def dense_ids(frame: DataFrame, key: list[str], name: str, parts: int = 64) -> DataFrame:
    """0-based ids in key order (nulls first). Ranks are taken within key ranges and offset by the ranges before.

    The ranges' bounds are keys from a sample by hash, drawn once as constants, so that every reading of the plan cuts alike.
    """
    keys = frame.select(*key).distinct()
    row = F.struct(*key)
    n = keys.agg(F.approx_count_distinct(F.xxhash64(*key))).collect()[0][0]
    every = max(1, n // (16 * parts))
    drawn = keys.where(F.pmod(F.xxhash64(F.lit(7), *key), F.lit(every)) == 0).select(row.alias("k"))
    bounds = drawn.groupBy().agg(F.array_sort(F.collect_list("k")).alias("ks"))  # about 16 keys a range
    cut = F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.get(F.col("ks"), F.floor(i * F.size("ks") / parts).cast("int")))
    bounds = bounds.select(F.array_distinct(F.filter(cut, lambda k: k.isNotNull())).alias("ks"))
    constants = frame.sparkSession.createDataFrame(bounds.collect(), bounds.schema)
    ranged = keys.crossJoin(F.broadcast(constants)).select(*key, F.size(F.filter("ks", lambda k: k < row)).alias("__p"))
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    offsets = sizes.select(F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    ranked = ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*key)) - 1)
    return ranked.join(F.broadcast(offsets), F.col("__p") == F.col("__q")).select(*key, (F.col("__o") + F.col("__r")).cast("long").alias(name))


def temporal_cutoff(log: DataFrame, time: str, ratio: float) -> DataFrame:
    """The minute in which the cumulative count first reaches floor(n * ratio + 0.5), and the counts around it."""
    per = log.groupBy(F.date_trunc("minute", F.col(time)).alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    run = per.withColumn("cum", F.sum("n").over(Window.orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)))  # one row a minute
    goal = F.floor(F.sum("n").over(Window.partitionBy()) * F.lit(ratio) + 0.5)
    first = run.withColumn("goal", goal).where(F.col("cum") >= F.col("goal"))
    return first.groupBy("goal").agg(F.min(F.struct("minute", "cum", "n")).alias("s")).select(
        F.col("s.minute").alias("cutoff_minute"),
        F.col("goal").cast("long").alias("goal"),
        F.col("s.cum").alias("cumulative"),
        F.col("s.n").alias("minute_rows"),
    )


def subtract_holdout(full: DataFrame, held: DataFrame) -> DataFrame:
    """Pair counts without those of a hold-out, with the number of queries that a poi keeps (df)."""
    both = full.join(held.select("query", "poi", F.col("n").alias("h")), ["query", "poi"], "left").withColumn("n", F.col("n") - F.coalesce("h", F.lit(0))).where("n > 0").drop("h")
    return both.withColumn("poi_df", F.count(F.lit(1)).over(Window.partitionBy("query")))
