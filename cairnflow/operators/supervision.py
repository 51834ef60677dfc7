"""Category supervision of queries and the layered query graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.operators.querystats import distribution


@dataclass(frozen=True)
class Threshold:
    count: int
    concentration: float
    entropy: float


# The settings of the depth rules, by name.
SETTINGS = {
    "relaxed": (Threshold(2, 0.75, 0.45), Threshold(2, 0.80, 0.40)),
    "baseline": (Threshold(3, 0.80, 0.40), Threshold(3, 0.85, 0.35)),
    "strict": (Threshold(5, 0.85, 0.35), Threshold(5, 0.90, 0.30)),
}
SUPPORT_CAP = 20
GAMMA = 1.0


def passes(t: Threshold, side: str) -> Column:
    return (F.col("query_count") >= t.count) & (F.col(f"{side}_concentration") >= t.concentration) & (F.col(f"{side}_entropy") <= t.entropy)


def depth(setting: str = "baseline") -> Column:
    """3 for a trusted first choice, 2 for a clear fine category, 1 for a clear coarse one, else 0; in this order."""
    fine, coarse = SETTINGS[setting]
    return F.when(F.col("is_high_confidence"), 3).when(passes(fine, "fine"), 2).when(passes(coarse, "coarse"), 1).otherwise(0)


def support(count: Column, cap: int = SUPPORT_CAP) -> Column:
    return F.log1p(F.least(count, F.lit(cap))) / F.log1p(F.lit(float(cap)))


def reliability(score: Column, concentration: Column, entropy: Column, gamma: float = GAMMA) -> Column:
    value = score * F.pow(concentration, F.lit(gamma)) * F.greatest(F.lit(0.0), 1 - entropy)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def supervise(pairs: DataFrame, categories: DataFrame, profile: DataFrame) -> DataFrame:
    """One row a query: its profile with fine and coarse distributions, depth and the reliability of each layer."""
    named = pairs.join(categories, "poi")
    out = profile
    for side in ("fine", "coarse"):
        d = distribution(named.groupBy("query", side).agg(F.sum("n").alias("n")), ["query"], side)
        out = out.join(
            d.select(
                "query",
                F.col("dominant_id").alias(f"dominant_{side}"),
                F.col("concentration").alias(f"{side}_concentration"),
                F.col("normalized_entropy").alias(f"{side}_entropy"),
            ),
            "query",
        )
    s = support(F.col("query_count"))
    return out.withColumn("supervision_depth", depth()).withColumn("support_score", s).withColumn(
        "s1_reliability",
        reliability(s, F.col("coarse_concentration"), F.col("coarse_entropy")),
    ).withColumn("s2_reliability", reliability(s, F.col("fine_concentration"), F.col("fine_entropy"))).withColumn("s3_reliability", reliability(s, F.col("top1_share"), F.col("normalized_entropy")))


def layer_edges(pairs: DataFrame, categories: DataFrame, supervised: DataFrame) -> DataFrame:
    """query, poi, layer, edge_probability, query_reliability, edge_weight of the pairs that each query's depth keeps."""
    named = pairs.join(categories, "poi").join(
        supervised.select("query", "supervision_depth", "top1_poi_id", "dominant_fine", "dominant_coarse", "s1_reliability", "s2_reliability", "s3_reliability"),
        "query",
    )
    d = F.col("supervision_depth")
    keep = ((d == 3) & (F.col("poi") == F.col("top1_poi_id"))) | ((d == 2) & (F.col("fine") == F.col("dominant_fine"))) | ((d == 1) & (F.col("coarse") == F.col("dominant_coarse")))
    kept = named.where(keep)
    total = kept.groupBy("query").agg(F.sum("n").alias("kept"))  # the same in each of a query's layers
    out = kept.join(total, "query").withColumn("layer", F.explode(F.sequence(F.lit(1), d)))
    share = F.col("n") / F.col("kept")
    own = F.element_at(F.array("s1_reliability", "s2_reliability", "s3_reliability"), F.col("layer"))
    return out.select(
        "query",
        "poi",
        "n",
        "supervision_depth",
        "layer",
        "fine",
        "coarse",
        share.alias("edge_probability"),
        own.alias("query_reliability"),
        (share * own).alias("edge_weight"),
    )


def sensitivity(supervised: DataFrame) -> DataFrame:
    """setting, supervision_depth, queries, ratio under relaxed, baseline and strict thresholds; one pass over the queries."""
    rows = supervised.select(F.explode(F.array(*[F.struct(F.lit(s).alias("setting"), depth(s).alias("supervision_depth")) for s in SETTINGS])).alias("x"))
    n = supervised.agg(F.count(F.lit(1)).alias("total"))
    return rows.groupBy("x.setting", "x.supervision_depth").agg(F.count(F.lit(1)).alias("queries")).crossJoin(n).withColumn("ratio", F.col("queries") / F.col("total")).drop("total")


def graph_mass(edges: DataFrame) -> DataFrame:
    """By layer: queries, edges, summed weight and the largest distance of a query's probabilities from 1."""
    per = edges.groupBy("query", "layer").agg(F.sum("edge_probability").alias("p"), F.sum("edge_weight").alias("w"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("layer").agg(F.count(F.lit(1)).alias("queries"), F.sum("n").alias("edges"), F.sum("w").alias("weight"), F.max(F.abs(F.col("p") - 1)).alias("worst"))


def closed_selection(edges: DataFrame, chosen: DataFrame, base: DataFrame, max_layer: int = 2) -> DataFrame:
    """All pois that the chosen queries' edges reach in the first layers, with a base set."""
    reached = edges.where(F.col("layer") <= max_layer).join(chosen.select("query").distinct(), "query", "left_semi").select("poi")
    return reached.unionByName(base.select("poi")).distinct()
