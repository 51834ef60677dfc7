"""Ranking metrics, paired comparisons, bucket ranks, reranking, calibration and beam diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnflow.operators.sampling import nth_smallest

KS = (1, 3, 5, 10, 20)


def target_rank(rank: Column) -> Column:
    """1-based rank, -1 for a miss."""
    return F.coalesce(rank.cast("int"), F.lit(-1))


def rank_columns(rank: Column) -> list[Column]:
    """Hit@k, MRR@10 and NDCG@10 over rank rows (-1: miss); null for no rows."""
    hit = lambda k: F.avg(F.when((rank > 0) & (rank <= k), 1.0).otherwise(0.0)).alias(f"hit_at_{k}")
    inside = (rank > 0) & (rank <= 10)
    return [
        F.count(F.lit(1)).alias("samples"),
        *[hit(k) for k in KS],
        F.avg(F.when(inside, 1.0 / rank).otherwise(0.0)).alias("mrr_at_10"),
        F.avg(F.when(inside, 1.0 / F.log2(rank + 1.0)).otherwise(0.0)).alias("ndcg_at_10"),
    ]


def rank_metrics(ranks: DataFrame, rank: str = "target_rank") -> DataFrame:
    return ranks.agg(*rank_columns(F.col(rank)))


def sliced_metrics(ranks: DataFrame, slices: dict[str, Column], rank: str = "target_rank") -> DataFrame:
    """Metrics by named slice; slices may overlap, so rows are opened into those they belong to."""
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in slices.items()]), lambda x: x.isNotNull())
    return ranks.withColumn("slice", F.explode(names)).groupBy("slice").agg(*rank_columns(F.col(rank)))


def paired(ranks: DataFrame, baseline: str, current: str, top_k: int) -> DataFrame:
    """Wins, ties and losses of current; a miss ranks top_k + 1."""
    r = lambda c: F.when((F.col(c) > 0) & (F.col(c) <= top_k), F.col(c)).otherwise(top_k + 1)
    return ranks.agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in (("wins", r(current) < r(baseline)), ("ties", r(current) == r(baseline)), ("losses", r(current) > r(baseline)))])


def outcome(a: Column, b: Column, gap: int = 5, k: int = 10) -> Column:
    """Five-way outcome of two ranks, in this order; null for what fits none."""
    hit = lambda x: (x > 0) & (x <= k)
    return F.when(hit(a) & ~hit(b), "only_a").when(hit(b) & ~hit(a), "only_b").when(hit(a) & hit(b) & (b - a >= gap), "a_better").when(hit(a) & hit(b) & (a - b >= gap), "b_better").when(~hit(a) & ~hit(b), "both_miss")


def first_bucket_ranks(candidates: DataFrame, sample: str, bucket: str, rank: str, expandable: Column) -> DataFrame:
    """sample, bucket, first_rank, bucket_rank: beams collapsed to buckets by first occurrence and ranked again."""
    first = candidates.where(expandable).groupBy(sample, bucket).agg(F.min(rank).alias("first_rank"))
    return first.withColumn("bucket_rank", F.row_number().over(Window.partitionBy(sample).orderBy("first_rank", bucket)))


def valid_top(candidates: DataFrame, sample: str, entity: str, score: str, tokens: str, valid: Column, k: int) -> DataFrame:
    """Valid candidates by score desc and tokens, the first of each entity, k a sample."""
    best = Window.partitionBy(sample, entity).orderBy(F.desc(score), tokens)
    kept = candidates.where(valid).withColumn("__d", F.row_number().over(best)).where("__d = 1").drop("__d")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(sample).orderBy(F.desc(score), tokens))).where(F.col("rank") <= k)


def slot_hits(candidates: DataFrame, sample: str, rank: str, correct: Column, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Hit rates where invalid beams keep their slot."""
    r = candidates.groupBy(sample).agg(F.min(F.when(correct, F.col(rank))).alias("r"))
    return r.agg(F.count(F.lit(1)).alias("samples"), *[F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)).alias(f"hr_at_{k}") for k in ks])


def rerank(candidates: DataFrame, sample: str, id_: str, bucket_rank: str, scores: dict[str, str], offset: int = 60) -> DataFrame:
    """Per candidate: its ordinal rank by each score (ties by id), bucket-first and global order by each, and by reciprocal-rank fusion."""
    out = candidates
    for name, column in scores.items():
        w = Window.partitionBy(sample).orderBy(F.desc(column), id_)
        out = out.withColumn(f"rank_{name}", F.row_number().over(w)).withColumn(
            f"bucket_{name}",
            F.row_number().over(Window.partitionBy(sample).orderBy(bucket_rank, F.desc(column), id_)),
        )
    fused = sum((1.0 / (offset + F.col(f"rank_{n}")) for n in scores), F.lit(0.0))
    # a sum of unit fractions is compared after rounding, so that equal sums tie and ids decide
    return out.withColumn("rrf", F.round(fused, 12)).withColumn("rank_rrf", F.row_number().over(Window.partitionBy(sample).orderBy(F.desc("rrf"), id_)))


def fixed_candidate_rank(scores: DataFrame, sample: str, score: str, positive: Column, valid: Column) -> DataFrame:
    """sample, rank: 1 + valid negatives that score at least as much as the positive; ties count against it."""
    best = F.max(F.when(positive, F.col(score))).over(Window.partitionBy(sample))
    return scores.withColumn("__p", best).groupBy(sample).agg((1 + F.sum(F.when(~positive & valid & (F.col(score) >= F.col("__p")), 1).otherwise(0))).alias("rank"))


def calibrate(scores: DataFrame, probability: str, level: str, depths: tuple[int, ...], max_unsafe: float) -> DataFrame:
    """depth, threshold: of the rows below a depth the (budget + 1)-th largest probability, budget = floor(n * rate / depths).

    probability is an array with one value a depth. Approximate quantiles bracket each threshold; only the rows of the
    bracket are ranked."""
    n = scores.count()
    budget = int(n * max_unsafe) // len(depths)
    values = F.arrays_zip(F.array(*[F.lit(d) for d in depths]).alias("depth"), F.col(probability).alias("p"))
    long = scores.select(F.explode(values).alias("x"), F.col(level).alias("level")).select("x.depth", "x.p", "level").where(F.col("level") < F.col("depth"))
    out = []
    for depth, count in sorted(tuple(r) for r in long.groupBy("depth").count().collect()):  # one row a depth
        rows = long.where(F.col("depth") == depth)
        edge = nth_smallest(rows, F.struct((-F.col("p")).alias("p")), count, budget + 1)
        if edge is not None:
            out.append((depth, -edge["p"]))
    return scores.sparkSession.createDataFrame(out, "depth int, threshold double")


def safe_prefix_summary(rows: DataFrame, selected: str, level: str) -> DataFrame:
    s, v = F.col(selected), F.col(level)
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return rows.agg(
        F.count(F.lit(1)).alias("samples"),
        rate(s > 0).alias("retention"),
        rate((s > 0) & (v < s)).alias("unsafe"),
        rate((s >= 3) & (v >= s)).alias("useful"),
        rate((s >= 4) & (v >= s)).alias("strong"),
        F.avg(s.cast("double")).alias("mean_depth"),
    )


def beam_state(gold: str, steps: str, sid_depths: list[int], final_rank: str) -> tuple[Column, Column]:
    """(first depth at which the gold prefix has left the live beam, else null; risk state).

    gold: array of tokens; steps: array over depth of arrays of prefixes (arrays)."""
    gone = F.filter(F.sequence(F.lit(1), F.size(steps)), lambda d: ~F.array_contains(F.element_at(F.col(steps), d), F.slice(F.col(gold), F.lit(1), d)))
    first = F.array_min(gone)
    low, high = min(sid_depths), max(sid_depths)
    state = F.when(first < low, "pruned_before_sid").when(
        (first >= low) & (first <= high),
        F.concat(F.lit("pruned_at_"), first.cast("string")),
    ).when(F.col(final_rank) == 1, "hit@1").when(F.col(final_rank) <= 10, "hit@10_not@1").otherwise("miss_after_sid")
    return first, state


def pairwise_loss(positive: Column, negative: Column, temperature: float, margin: float = 0.0) -> Column:
    """softplus((negative - positive + margin) / temperature), safe for large arguments."""
    z = (negative - positive + margin) / temperature
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def teacher_forcing(rows: DataFrame, sample: str, position: str, top1: str, top10: str, nll: str) -> DataFrame:
    """By position: means, and the share of samples with every position so far right; first failures as the drop of that share."""
    w = Window.partitionBy(sample).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("__all", F.min(F.col(top1).cast("int")).over(w))
    per = run.groupBy(position).agg(
        F.avg(F.col(top1).cast("double")).alias("top1"),
        F.avg(F.col(top10).cast("double")).alias("top10"),
        F.avg(nll).alias("nll"),
        F.avg(F.col("__all").cast("double")).alias("survival"),
    )
    return per.withColumn("first_failure", F.coalesce(F.lag("survival").over(Window.orderBy(position)), F.lit(1.0)) - F.col("survival"))


def label_distribution(rows: DataFrame, group: str, label: str, top_k: int) -> DataFrame:
    """group, label, n, share of the k most frequent labels (ties by label), and `__other__` for the rest."""
    n = rows.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), label)
    named = n.withColumn("label", F.when(F.row_number().over(w) <= top_k, F.col(label).cast("string")).otherwise("__other__")).groupBy(group, "label").agg(F.sum("n").alias("n"))
    return named.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))
