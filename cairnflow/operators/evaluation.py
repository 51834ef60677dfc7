"""Evaluation of identifiers and rankings: per-sample hits, error classes, gates, contrasts and summaries.

Samples are rows; what describes a run is an aggregate of them. Comparisons between runs work on frames with one row a run, which
are small by nature.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnflow.functions import vector as V


def rate(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def hit_and_ndcg(rank: Column, available: Column, ks: tuple[int, ...] = (1, 3, 5, 10)) -> list[Column]:
    """hr_k and ndcg_k of a sample with one right answer: null where fewer than k candidates were there; rank is null for a miss."""
    out = []
    for k in ks:
        hit = F.coalesce(rank <= k, F.lit(False))
        out.append(F.when(available >= k, hit.cast("int")).alias(f"hr_{k}"))
        out.append(F.when(available >= k, F.when(hit, 1.0 / F.log2(rank + 1.0)).otherwise(0.0)).alias(f"ndcg_{k}"))
    return out


def error_types(target: Column, top1: Column, rank: Column, gid: int = 6, sid: int = 3) -> Column:
    """Names of what went wrong: the first part of the identifier in which the best candidate differs, then misses by rank.

    target and top1 are arrays of gid, sid and maybe one dedup token; top1 is empty without candidates."""
    same = lambda n: F.coalesce(F.slice(top1, 1, n) == F.slice(target, 1, n), F.lit(False)) & (F.size(top1) >= n)
    base = gid + sid
    first = (
        F.when(~same(gid), "top1_gid_error")
        .when(~same(base), "gid_correct_sid_error")
        .when((F.size(target) == base + 1) & (top1 != target), "base_pid_correct_dedup_error")
    )
    near = F.when((rank > 1) & (rank <= 10), "target_in_top10_not_top1")
    miss = F.when(rank.isNull() | (rank > 10), "top10_miss")
    return F.filter(F.array(first, near, miss), lambda x: x.isNotNull())


def prefix_hits(target: Column, beams: Column, depths: list[int], ks: tuple[int, ...] = (1, 10)) -> list[Column]:
    """prefix_d_hit_k: whether any of the first k beams begins as the target does, to depth d."""

    def hit(d: int, k: int) -> Column:
        some = F.exists(F.slice(beams, 1, k), lambda b: F.slice(b, 1, d) == F.slice(target, 1, d))
        return F.coalesce(some, F.lit(False)).alias(f"prefix_{d}_hit_{k}")

    return [hit(d, k) for d in depths for k in ks]


def token_observation(logits: DataFrame, sample: list[str], token: str, logit: str, is_target: Column, legal: Column) -> DataFrame:
    """By sample: the target's rank among all tokens and among the legal ones (equal logits: smaller tokens first), its negative
    log-likelihood, the mass of the legal tokens and their number. logits: one row a token."""
    target = F.max(F.when(is_target, F.struct(F.col(logit).alias("l"), F.col(token).alias("t")))).over(Window.partitionBy(*sample))
    rows = logits.withColumn("__x", target).withColumn("__top", F.max(logit).over(Window.partitionBy(*sample)))
    before = (F.col(logit) > F.col("__x.l")) | ((F.col(logit) == F.col("__x.l")) & (F.col(token) < F.col("__x.t")))
    e = F.exp(F.col(logit) - F.col("__top"))
    per = rows.groupBy(*sample).agg(
        (1 + F.count_if(before)).alias("rank"),
        (1 + F.count_if(before & legal)).alias("legal_rank"),
        (F.first("__top") + F.log(F.sum(e)) - F.first("__x.l")).alias("nll"),
        (F.sum(F.when(legal, e).otherwise(0.0)) / F.sum(e)).alias("legal_mass"),
        F.count_if(legal).alias("legal_count"),
    )
    return per


def stage_rollup(rows: DataFrame, stage: str, order: str, means: list[str], alive: str) -> DataFrame:
    """By stage in order: samples, means of the columns, the share still alive (survival), and the drop of that share since
    the stage before. Stages are a handful."""
    per = rows.groupBy(stage, order).agg(F.count(F.lit(1)).alias("samples"), *[F.avg(F.col(c).cast("double")).alias(c) for c in means], rate(F.col(alive)).alias("survival"))
    before = F.coalesce(F.lag("survival").over(Window.orderBy(order)), F.lit(1.0))
    return per.withColumn("first_failure", before - F.col("survival")).drop(order)


def recall_metrics(rows: DataFrame, rank: str, positive: str, hardest: str, group: list[str] | None = None) -> DataFrame:
    """By group (or one row): recall at 1, 10, 50, 100, mean scores of the positive and the hardest negative, mean margin."""
    out = [F.count(F.lit(1)).alias("rows"), *[rate(F.col(rank) <= k).alias(f"recall_at_{k}") for k in (1, 10, 50, 100)]]
    out += [F.avg(positive).alias("mean_positive_score"), F.avg(hardest).alias("mean_hardest_negative_score")]
    out += [F.avg(F.col(positive) - F.col(hardest)).alias("mean_hard_margin")]
    return (rows.groupBy(*group) if group else rows).agg(*out)


def retrieval_report(rows: DataFrame, rank: str, difficult: Column, raw: str, view: str) -> DataFrame:
    """One row: recall at 1, 5, 10, 20, MRR at 10, recall of the difficult rows, and how far views moved (1 - cosine) from raw."""
    drift = (1 - V.cosine(F.col(raw), F.col(view))).alias("__drift")
    r = F.col(rank)
    seen = rows.select(r.alias("r"), difficult.alias("d"), drift)
    return seen.agg(
        F.count(F.lit(1)).alias("rows"),
        *[rate(F.col("r") <= k).alias(f"recall_at_{k}") for k in (1, 5, 10, 20)],
        F.avg(F.when(F.col("r") <= 10, 1.0 / F.col("r")).otherwise(0.0)).alias("mrr_at_10"),
        F.count_if("d").alias("difficult_rows"),
        F.avg(F.when(F.col("d"), (F.col("r") <= 10).cast("double"))).alias("difficult_recall_at_10"),
        F.avg("__drift").alias("drift_mean"),
        *[F.percentile("__drift", F.lit(q)).alias(f"drift_p{int(100 * q)}") for q in (0.5, 0.9, 0.99)],
        F.max("__drift").alias("drift_max"),
    )


def improves(raw: tuple[Column, Column], adapted: tuple[Column, Column], tolerance: float = 1e-12) -> Column:
    """Neither of two measures (recall, margin) is worse, and one is better."""
    deltas = [b - a for a, b in zip(raw, adapted, strict=True)]
    return (deltas[0] >= -tolerance) & (deltas[1] >= -tolerance) & ((deltas[0] > tolerance) | (deltas[1] > tolerance))


def gate(runs: DataFrame, recall: str = "recall_at_10", margin: str = "mean_hard_margin") -> DataFrame:
    """gate_passes: overall and hard both improve(); identity_fallback: neither gains in any measure.

    runs: one row for each of (raw, adapted) x (overall, hard), columns `run` and `subset`."""
    cell = lambda run, subset, c: F.max(F.when((F.col("run") == run) & (F.col("subset") == subset), F.col(c)))
    names = {(r, s, c): f"{r}_{s}_{c}" for r in ("raw", "adapted") for s in ("overall", "hard") for c in (recall, margin)}
    one = runs.agg(*[cell(*k).alias(n) for k, n in names.items()])
    pair = lambda run, subset: tuple(F.col(names[(run, subset, c)]) for c in (recall, margin))
    better = [improves(pair("raw", s), pair("adapted", s)) for s in ("overall", "hard")]
    gains = [b > a for s in ("overall", "hard") for a, b in zip(pair("raw", s), pair("adapted", s), strict=True)]
    return one.select((better[0] & better[1]).alias("gate_passes"), (~reduce(lambda x, y: x | y, gains)).alias("identity_fallback"))


def best_run(runs: DataFrame, order: list[Column]) -> DataFrame:
    """The row that comes first by the given measures (a run's few numbers each)."""
    return runs.orderBy(*order).limit(1)


def contrasts(branches: DataFrame, branch: str, canonical: str, measures: list[str], interaction: tuple[str, str, str] | None = None) -> DataFrame:
    """branch, measure, contrast: the canonical branch's measure less each other branch's; with interaction (both, one,
    other off) also canonical - one - other + both, under the name `interaction`."""
    long = branches.select(branch, F.explode(F.create_map(*[x for m in measures for x in (F.lit(m), F.col(m).cast("double"))])).alias("measure", "value"))
    base = long.where(F.col(branch) == canonical).select("measure", F.col("value").alias("own"))
    out = long.where(F.col(branch) != canonical).join(base, "measure").select(branch, "measure", (F.col("own") - F.col("value")).alias("contrast"))
    if interaction is None:
        return out
    both, one, other = interaction
    signs = F.when(F.col(branch).isin(canonical, both), 1.0).when(F.col(branch).isin(one, other), -1.0)
    mixed = long.where(signs.isNotNull()).groupBy("measure").agg(F.sum(signs * F.col("value")).alias("contrast"))
    return out.unionByName(mixed.select(F.lit("interaction").alias(branch), "measure", "contrast"))


def additive_decomposition(before: Column, moved: Column, optimal: Column, coupled: Column) -> list[Column]:
    """Three steps from one objective to another that add up: to other parents, to the best content codes, to coupled codes."""
    steps = [moved - before, optimal - moved, coupled - optimal]
    return [s.alias(n) for s, n in zip(steps, ("parent_change", "content_refit", "coupling_cost"), strict=True)] + [(coupled - before).alias("total")]


def increase_streak(trace: DataFrame, order: str, improvement: str, warmup_end: int, tolerance: float, group: list[str] | None = None) -> DataFrame:
    """trace with streak: rounds in a row, after warm-up, in which the objective rose by more than the tolerance."""
    worse = F.coalesce((F.col(order) > warmup_end) & (F.col(improvement) < -tolerance), F.lit(False))
    w = Window.partitionBy(*(group or [F.lit(0)])).orderBy(order)  # a trace has as many rows as a fit has rounds
    island = F.sum(F.when(worse, 0).otherwise(1)).over(w)
    marked = trace.withColumn("__worse", worse).withColumn("__island", island)
    run = Window.partitionBy(*(group or [F.lit(0)]), "__island").orderBy(order)
    return marked.withColumn("streak", F.sum(F.col("__worse").cast("int")).over(run).cast("int")).drop("__worse", "__island")


def info_nce(scores: DataFrame, sample: str, score: str, positive: Column, valid: Column, weight: str, temperature: float) -> DataFrame:
    """One row: the weighted mean over samples of ln sum exp(score / t) - positive / t over the positive and its valid negatives."""
    z = F.col(score) / temperature
    part = scores.where(positive | valid).select(sample, weight, z.alias("z"), positive.alias("p"))
    per = part.groupBy(sample).agg(F.max("z").alias("m"), F.max(weight).alias("w"), F.max(F.when(F.col("p"), F.col("z"))).alias("zp"))
    mass = part.join(per, [sample]).groupBy(sample).agg(F.sum(F.exp(F.col("z") - F.col("m"))).alias("e"))
    loss = per.join(mass, [sample]).withColumn("loss", F.col("m") + F.log("e") - F.col("zp"))
    return loss.agg((F.sum(F.col("w") * F.col("loss")) / F.sum("w")).alias("loss"), F.count(F.lit(1)).alias("samples"))


def case_summary(rows: DataFrame, category: str, length: str, flags: list[str], error: str) -> DataFrame:
    """By category and over all: rows, mean and quartiles of a length, shares of flags, and rows by error class."""
    shares = [rate(F.col(f)).alias(f) for f in flags]
    sizes = [F.avg(length).alias("mean_length"), *[F.percentile(length, F.lit(q)).alias(f"p{int(100 * q)}_length") for q in (0.25, 0.5, 0.75)]]
    return rows.rollup(category).agg(F.count(F.lit(1)).alias("rows"), *sizes, *shares, F.count_if(F.col(error).isNotNull()).alias("errors"))


def branch_agreement(reference: DataFrame, other: DataFrame, id_: str, levels: list[str]) -> DataFrame:
    """One row: rows in both, and for each level the share with the same code, and with the same codes up to it."""
    both = reference.select(id_, *[F.col(c).alias(f"a_{c}") for c in levels]).join(other.select(id_, *[F.col(c).alias(f"b_{c}") for c in levels]), id_)
    same = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in levels]
    so_far = [reduce(lambda x, y: x & y, same[: i + 1]) for i in range(len(levels))]
    return both.agg(
        F.count(F.lit(1)).alias("rows"),
        *[rate(s).alias(f"same_{c}") for s, c in zip(same, levels, strict=True)],
        *[rate(s).alias(f"same_to_{c}") for s, c in zip(so_far, levels, strict=True)],
    )


def code_distribution(codes: DataFrame, levels: list[str]) -> DataFrame:
    """One row: rows, distinct codes and their share, rows beyond the first of each code, and interpolated quantiles of code sizes."""
    n = codes.groupBy(*levels).agg(F.count(F.lit(1)).alias("n"))
    quantiles = [F.percentile("n", F.lit(q)).alias(f"p{int(100 * q)}") for q in (0.5, 0.9, 0.99)]
    distinct = F.count(F.lit(1))
    return n.agg(
        F.sum("n").alias("rows"),
        distinct.alias("distinct"),
        (distinct / F.sum("n")).alias("distinct_ratio"),
        (F.sum("n") - distinct).alias("excess"),
        *quantiles,
        F.max("n").alias("largest"),
    )


def prefix_mass(counts: DataFrame, query: str, prefix: list[str], n: str, sizes: DataFrame, size: str) -> DataFrame:
    """By query: its prefixes, the share of the largest, entropy in bits, and the expected size of a prefix's bucket.

    counts: query, prefix codes, n; sizes: prefix codes with their bucket size."""
    per = counts.groupBy(query, *prefix).agg(F.sum(n).cast("double").alias("n")).join(sizes.select(*prefix, size), prefix)
    total = F.sum("n")
    entropy = (F.log(total) - F.sum(F.col("n") * F.log("n")) / total) / F.log(F.lit(2.0))
    return per.groupBy(query).agg(
        F.count(F.lit(1)).alias("prefixes"),
        (F.max("n") / total).alias("top_share"),
        F.greatest(F.lit(0.0), entropy).alias("entropy_bits"),
        (F.sum(F.col("n") * F.col(size)) / total).alias("expected_bucket"),
    )


def prior_mass(codes: DataFrame, code: str, declared: int, tau: float) -> DataFrame:
    """One row: codes used, and mean, median and largest weight tau / (n + tau) of the prior over all declared codes, empty ones too."""
    n = codes.groupBy(F.col(code).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    every = codes.sparkSession.range(declared).join(n, "id", "left").fillna(0, ["n"])
    w = tau / (F.col("n") + tau)
    return every.agg(F.count_if(F.col("n") > 0).alias("used"), F.avg(w).alias("mean"), F.percentile(w, F.lit(0.5)).alias("median"), F.max(w).alias("largest"))


def purity_levels(codes: DataFrame, levels: list[str], labels: list[str]) -> DataFrame:
    """By depth: prefixes, share of rows that are alone, largest bucket, and for each label the weighted purity over all
    buckets and over those of several rows (null without any)."""
    out = []
    for d in range(1, len(levels) + 1):
        key = levels[:d]
        n = codes.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        wide = n
        for c in labels:
            top = codes.groupBy(*key, c).agg(F.count(F.lit(1)).alias("k")).groupBy(*key).agg(F.max("k").alias(f"top_{c}"))
            wide = wide.join(top, key)
        several = F.col("n") > 1
        share = lambda c, several=several: [(F.sum(f"top_{c}") / F.sum("n")).alias(f"{c}_purity"), (F.sum(F.when(several, F.col(f"top_{c}"))) / F.sum(F.when(several, F.col("n")))).alias(f"{c}_purity_several")]
        alone = F.sum(F.when(~several, F.col("n")).otherwise(0)) / F.sum("n")
        out.append(wide.agg(F.lit(d).alias("depth"), F.count(F.lit(1)).alias("prefixes"), alone.alias("singleton_share"), F.max("n").alias("max_bucket"), *[x for c in labels for x in share(c)]))
    return reduce(DataFrame.unionByName, out)


def migration_summary(moves: DataFrame, recoded: Column, category: str | None = None) -> DataFrame:
    """Of identifiers.migration(): rows recoded, rows whose peers changed, both, and moves into and out of buckets of one."""
    alone = lambda c: F.col(c) == 1
    out = [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(recoded).alias("recoded"),
        F.count_if("changed").alias("peers_changed"),
        F.count_if(recoded & F.col("changed")).alias("recoded_with_new_peers"),
        F.count_if(alone("before_size") & ~alone("after_size")).alias("singleton_to_bucket"),
        F.count_if(~alone("before_size") & alone("after_size")).alias("bucket_to_singleton"),
        F.avg("peer_jaccard").alias("mean_peer_jaccard"),
    ]
    return (moves.groupBy(category) if category else moves).agg(*out)


def pair_distances(rows: DataFrame, cluster: list[str], id_: str, distance: Column, thresholds: list[float], most: int) -> DataFrame:
    """One row over all unordered pairs within clusters of 2 to `most` rows: pairs, interpolated percentiles of the distance,
    the largest, and pairs within each threshold.

    distance speaks of a.* and b.*. The bound is the operator's: larger clusters are counted in `large_clusters`, as their pairs
    grow with the square."""
    sizes = rows.groupBy(*cluster).agg(F.count(F.lit(1)).alias("__n"))
    small = rows.join(sizes.where(F.col("__n").between(2, most)), cluster)
    a, b = small.alias("a"), small.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in cluster]) & (F.col(f"a.{id_}") < F.col(f"b.{id_}"))
    pairs = a.join(b, on).select(distance.alias("d"))
    out = pairs.agg(
        F.count(F.lit(1)).alias("pairs"),
        *[F.percentile("d", F.lit(q)).alias(f"p{int(100 * q)}") for q in (0.5, 0.9)],
        F.max("d").alias("largest"),
        *[F.count_if(F.col("d") <= t).alias(f"within_{t:g}") for t in thresholds],
    )
    return out.crossJoin(sizes.agg(F.count_if(F.col("__n") > most).alias("large_clusters")))
