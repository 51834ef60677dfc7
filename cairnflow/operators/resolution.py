"""Staged resolution of collisions, and rankings within known or generated buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnflow.operators.identifiers import with_counts


def common_length(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, root: how many leading characters the texts of a bucket share."""
    ends = rows.groupBy(*key).agg(F.min(text).alias("a"), F.max(text).alias("b"))  # in order, the extremes share what all share
    same = F.transform(F.sequence(F.lit(1), F.length("a")), lambda i: F.substr(F.col("a"), F.lit(1), i) == F.substr(F.col("b"), F.lit(1), i))
    return ends.select(*key, F.size(F.filter(same, lambda x: x)).alias("root"))


def staged(rows: DataFrame, base: list[str], gid: str, path: str, coarse: int, fine: int) -> DataFrame:
    """rows with root and stage: where a row of a colliding bucket becomes unique. Stages in order: base (alone already), coarse_geo
    (geohash to `coarse` characters), relation (path within that), fine_geo (to `fine` characters within that), unresolved.

    A bucket is cut no shorter than its common prefix is."""
    out = rows.join(common_length(rows, base, gid), base)
    out = out.withColumn("__coarse", F.substr(F.col(gid), F.lit(1), F.greatest(F.lit(coarse), F.col("root")))).withColumn("__fine", F.substring(gid, 1, fine))
    keys = {"base": base, "coarse_geo": [*base, "__coarse"], "relation": [*base, "__coarse", path], "fine_geo": [*base, "__coarse", path, "__fine"]}
    stage = F.lit("unresolved")
    for name, key in keys.items():
        out = with_counts(out, key, f"__{name}_n")
    for name in reversed(keys):
        stage = F.when(F.col(f"__{name}_n") == 1, name).otherwise(stage)
    return out.withColumn("stage", stage).select(*rows.columns, "root", "stage")


def regrouped(rows: DataFrame, stages: list[str], key: list[Column]) -> DataFrame:
    """id columns of rows in the given stages with group, the text of its key; every group has at least two rows (see lonely_groups)."""
    return rows.where(F.col("stage").isin(stages)).withColumn("group", F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in key]))


def lonely_groups(rows: DataFrame) -> DataFrame:
    """group: groups of a single row; must be empty."""
    return rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("group")


def ranked_in_bucket(candidates: DataFrame, sample: str, order: list[Column], id_: str, target: str) -> DataFrame:
    """sample, rank of the target among its bucket's candidates, number of candidates: by the given columns, then by id.

    Computed as one plus the candidates that come before the target, so no window sorts a bucket."""
    key = F.struct(*order, F.col(id_).cast("string"))
    rows = candidates.withColumn("__key", key)
    goal = rows.where(F.col(id_) == F.col(target)).groupBy(sample).agg(F.min("__key").alias("__goal"))
    return rows.join(goal, sample).groupBy(sample).agg((1 + F.count_if(F.col("__key") < F.col("__goal"))).alias("rank"), F.count(F.lit(1)).alias("candidates"))


def lexical_order(typed_net: Column, untyped: Column, complete: Column) -> list[Column]:
    """Order of a lexical proxy: relations that agree less those that differ, plain numbers that agree, whole agreement, all descending."""
    return [-typed_net, -untyped, -complete.cast("int")]


def rank_report(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10), group: list[str] | None = None) -> DataFrame:
    """By group (or one row): samples, hit rate and NDCG at k, mean reciprocal rank."""
    r = F.col("rank")
    out = [F.count(F.lit(1)).alias("samples")]
    for k in ks:
        out += [F.avg((r <= k).cast("double")).alias(f"hr_at_{k}"), F.avg(F.when(r <= k, 1.0 / F.log2(r + 1.0)).otherwise(0.0)).alias(f"ndcg_at_{k}")]
    out.append(F.avg(1.0 / r).alias("mrr"))
    return (ranks.groupBy(*group) if group else ranks).agg(*out)


VARIANTS = ("bucket_then_popularity", "bucket_then_lexical", "bucket_then_semantic", "global_popularity", "global_lexical", "global_semantic", "global_rrf", "global_rrf_all")


def rank_variants(candidates: DataFrame, sample: str, id_: str, bucket_order: str, lexical: str, semantic: str, popularity: str, offset: int = 60) -> DataFrame:
    """candidates with one rank a variant of VARIANTS, all of them total orders that end with the id.

    Candidates of a sample come from its ranked buckets, a beam's width of them, so a sample is a small group."""
    w = lambda *order: F.row_number().over(Window.partitionBy(sample).orderBy(*order, id_))
    b, pop = F.col(bucket_order), F.desc(popularity)
    out = candidates
    for name, column in (("lexical", lexical), ("semantic", semantic), ("popularity", popularity)):
        out = out.withColumn(f"__{name}", w(F.desc(column)))
    part = lambda c: 1.0 / (offset + F.col(c))
    some = part(bucket_order) + part("__lexical") + part("__semantic")
    # sums of unit fractions are compared after rounding, so that equal sums tie
    out = out.withColumn("__some", F.round(some, 12)).withColumn("__every", F.round(some + part("__popularity"), 12))
    orders = {
        "bucket_then_popularity": [b, pop],
        "bucket_then_lexical": [b, F.desc(lexical), pop],
        "bucket_then_semantic": [b, F.desc(semantic), pop],
        "global_popularity": [pop, b],
        "global_lexical": [F.desc(lexical), b, pop],
        "global_semantic": [F.desc(semantic), b, pop],
        "global_rrf": [F.desc("__some"), pop],
        "global_rrf_all": [F.desc("__every"), pop],
    }
    for name in VARIANTS:
        out = out.withColumn(name, w(*orders[name]))
    return out.drop("__lexical", "__semantic", "__popularity", "__some", "__every")


def rerank_report(ranked: DataFrame, sample: str, id_: str, target: str, slices: dict[str, Column], representative: str | None = None, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """variant, slice, samples, recall of the pool, and hit rates: of the exact target, or of any candidate with its representative.

    slices name conditions on a candidate's columns that hold for all of a sample or none."""
    right = F.col(id_) == F.col(target) if representative is None else F.col(representative) == F.col(f"target_{representative}")
    hits = [F.min(F.when(right, F.col(v))).alias(v) for v in VARIANTS]
    per = ranked.groupBy(sample).agg(*hits, *[F.max(c.cast("int")).alias(f"in_{n}") for n, c in slices.items()])
    names = F.array(*[F.when(F.col(f"in_{n}") == 1, F.lit(n)) for n in slices], F.lit("all"))
    long = _long(per, names)
    return long.groupBy("variant", "slice").agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg(F.col("r").isNotNull().cast("double")).alias("pool_recall"),
        *[F.avg(F.coalesce((F.col("r") <= k).cast("double"), F.lit(0.0))).alias(f"hr_at_{k}") for k in ks],
    )


def _long(per: DataFrame, names: Column) -> DataFrame:
    ranks = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("r")) for v in VARIANTS])
    opened = per.select(F.explode(F.filter(names, lambda x: x.isNotNull())).alias("slice"), ranks.alias("ranks"))
    return opened.select("slice", F.explode("ranks").alias("v")).select("slice", "v.variant", "v.r")


def reranking_gain(ranked: DataFrame, sample: str, id_: str, target: str, baseline: str, variant: str, k: int = 10) -> DataFrame:
    """One row: samples that one of two variants ranks better within the first k, and ties."""
    right = F.col(id_) == F.col(target)
    per = ranked.groupBy(sample).agg(*[F.coalesce(F.min(F.when(right & (F.col(v) <= k), F.col(v))), F.lit(k + 1)).alias(n) for v, n in ((baseline, "a"), (variant, "b"))])
    return per.agg(F.count_if(F.col("b") < F.col("a")).alias("wins"), F.count_if(F.col("b") == F.col("a")).alias("ties"), F.count_if(F.col("b") > F.col("a")).alias("losses"))


def strict_catalog(entities: DataFrame, ids: DataFrame, relations: DataFrame, id_: str, types: list[str], most: int) -> DataFrame:
    """id, codes and one column a relation type, for colliding entities alone: the value in [0, most] where it is not in conflict, else -1."""
    colliding = ids.where("bucket_size > 1").select(id_, "codes")
    kept = relations.where(~F.col("conflict") & F.col("value").between(0, most))
    wide = kept.groupBy(id_).agg(*[F.max(F.when(F.col("relation") == t, F.col("value"))).alias(t) for t in types])
    return entities.select(id_).join(colliding, id_).join(wide, id_, "left").fillna(-1, types)



def trace_faults(candidates: DataFrame, stored: DataFrame, sample: str, beam: str, bucket: str, expandable: Column, correct: Column, right_bucket: Column, width: int) -> DataFrame:
    """sample, fault: beams that are not 1 .. width, and stored ranks (exact_rank, raw_rank, unique_rank; null: a miss) that the
    candidates do not give. raw_rank is the first beam of the target's bucket, unique_rank that bucket's place among distinct ones."""
    ok = candidates.where(expandable)
    first = ok.groupBy(sample, bucket).agg(F.min(beam).alias("first"), F.max(right_bucket.cast("int")).alias("right"))
    goal = first.where("right = 1").groupBy(sample).agg(F.min("first").alias("goal"))
    unique = first.join(goal, sample).groupBy(sample).agg(F.first("goal").alias("raw"), F.count_if(F.col("first") <= F.col("goal")).alias("unique"))
    per = candidates.groupBy(sample).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(beam).alias("d"),
        F.min(beam).alias("low"),
        F.max(beam).alias("high"),
        F.min(F.when(correct, F.col(beam))).alias("exact"),
    )
    both = per.join(unique, sample, "left").join(stored, sample, "left")
    contiguous = (F.col("n") == width) & (F.col("d") == width) & (F.col("low") == 1) & (F.col("high") == width)
    wrong = {"beams": ~contiguous} | {n: ~F.col(f"{n}_rank").eqNullSafe(F.col(n)) for n in ("exact", "raw", "unique")}
    faults = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in wrong.items()]), lambda x: x.isNotNull())
    return both.select(sample, F.explode(faults).alias("fault"))


def branch_entropy(rows: DataFrame, group: list[str], value: str, weight: str) -> DataFrame:
    """group, branches, entropy in bits of the values' weights."""
    per = rows.groupBy(*group, value).agg(F.sum(weight).cast("double").alias("w"))
    total = F.sum("w")
    bits = (F.log(total) - F.sum(F.col("w") * F.log("w")) / total) / F.log(F.lit(2.0))
    return per.groupBy(*group).agg(F.count(F.lit(1)).alias("branches"), F.greatest(F.lit(0.0), bits).alias("entropy"))


def chosen_encoding(rows: DataFrame, bucket: list[str], options: list[str], orders: str, matches: list[str] | None = None, prior: float = 20.0, cap: float = 1000.0) -> DataFrame:
    """rows with option (its number from 1, 0 for none), chosen (its value, -1) and resolved (unique in its bucket).

    A bucket takes the option with the most weighted entropy, its values -1 for missing ones included, among those with two real values
    or more; equal ones go to the earlier. With matches (orders that name each option's value) the entropy is times its smoothed
    predictability. Rows weigh the root of 1 + orders, at most of 1 + cap."""
    weighed = rows.withColumn("__w", F.greatest(F.lit(1.0), F.sqrt(1.0 + F.least(F.col(orders).cast("double"), F.lit(cap)))))
    scores = None
    for i, option in enumerate(options, 1):
        real = F.col(option) >= 0
        score = branch_entropy(weighed, bucket, option, "__w").drop("branches")
        several = weighed.where(real).groupBy(*bucket).agg(F.count_distinct(option).alias("__d"), F.sum(orders).alias("__s"), *([F.sum(matches[i - 1]).alias("__m")] if matches else []))
        one = score.join(several.where("__d > 1"), bucket)
        if matches:
            whole = weighed.where(real).agg((F.sum(matches[i - 1]) / F.sum(orders)).alias("__g"))
            one = one.crossJoin(F.broadcast(whole)).withColumn("entropy", F.col("entropy") * (F.col("__m") + prior * F.coalesce("__g", F.lit(0.0))) / (F.col("__s") + prior))
        one = one.select(*bucket, F.struct(F.round("entropy", 12).alias("score"), F.lit(-i).alias("i")).alias("s"))
        scores = one if scores is None else scores.unionByName(one)
    best = scores.groupBy(*bucket).agg((-F.max("s")["i"]).alias("option"))
    value = F.coalesce(*[F.when(F.col("option") == i, F.col(o)) for i, o in enumerate(options, 1)], F.lit(-1))
    picked = rows.join(best, bucket, "left").fillna(0, ["option"]).withColumn("chosen", value)
    return with_counts(picked, [*bucket, "chosen"], "__n").withColumn("resolved", (F.col("option") > 0) & (F.col("__n") == 1)).drop("__n")


def trie_nodes(paths: DataFrame, path: str) -> DataFrame:
    """node (0 is the root, by depth and prefix), parent, token, depth and terminal (whether a path ends there) of all distinct prefixes.

    Numbers come from ranks within ranges (dense_ids), and parents from a join on the prefix but its last token."""
    from cairnflow.operators.querystats import dense_ids

    whole = paths.select(F.col(path).alias("p")).distinct()
    steps = F.transform(F.sequence(F.lit(0), F.size("p")), lambda d: F.struct(d.alias("depth"), F.slice("p", F.lit(1), d).alias("prefix"), (d == F.size("p")).alias("end")))
    nodes = whole.select(F.explode(steps).alias("s")).groupBy("s.depth", "s.prefix").agg(F.max("s.end").alias("terminal"))
    numbered = nodes.join(dense_ids(nodes, ["depth", "prefix"], "node"), ["depth", "prefix"])
    up = numbered.select(F.col("prefix").alias("__up"), F.col("node").alias("parent"))
    inner = numbered.withColumn("__up", F.slice("prefix", F.lit(1), F.greatest(F.size("prefix") - 1, F.lit(0))))
    both = inner.join(up, "__up", "left")
    token = F.try_element_at("prefix", F.lit(-1))
    return both.select("node", F.when(F.col("depth") > 0, F.col("parent")).otherwise(-1).alias("parent"), F.coalesce(token, F.lit(-1)).alias("token"), "depth", "terminal")
