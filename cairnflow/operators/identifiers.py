"""Discrete identifiers: in-bucket codes, bucket and layer statistics, purity, collisions, migration and prefix tables.

Codes are columns s1..sL beside an id column. Windows are partitioned by whole code tuples, whose buckets are small by
design; statistics first count by tuple and only then look at buckets, so the raw rows shuffle once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_code(codes: DataFrame, key: list[str], id_: Column, singleton: int) -> DataFrame:
    """bucket_size, and code: the 0-based rank by id in a bucket of several rows, else `singleton`.

    Collision codes give 0 to singletons, dedup codes -1; both order ids as text, leaf codes as numbers.
    """
    w = Window.partitionBy(*key)
    n = F.count(F.lit(1)).over(w)
    rank = F.row_number().over(w.orderBy(id_)) - 1
    return codes.withColumn("bucket_size", n).withColumn("code", F.when(n > 1, rank).otherwise(singleton).cast("int"))


def buckets(codes: DataFrame, key: list[str]) -> DataFrame:
    return codes.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))


def nearest_rank(column: str, q: float) -> Column:
    """Percentile as a value of the data: sorted[max(0, ceil(q * n) - 1)]."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")


def bucket_metrics(codes: DataFrame, key: list[str]) -> DataFrame:
    """One row: rows, distinct buckets, excess, colliding rows, singletons, nearest-rank percentiles of bucket sizes."""
    b = buckets(codes, key)
    return b.agg(
        F.sum("n").alias("total_rows"),
        F.count(F.lit(1)).alias("unique_sids"),
        (F.sum("n") - F.count(F.lit(1))).alias("collision_excess"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("colliding_rows"),
        F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("singletons"),
        *[nearest_rank("n", q).cast("long").alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.95, 0.99)],
        F.max("n").alias("max_size"),
    )


def size_histogram(codes: DataFrame, key: list[str]) -> DataFrame:
    return buckets(codes, key).groupBy(F.col("n").alias("bucket_size")).agg(F.count(F.lit(1)).alias("buckets"))


def layer_usage(codes: DataFrame, layers: dict[str, int]) -> DataFrame:
    """By layer: used codes, utilisation of the declared codebook, entropy over ln(declared), perplexity, effective codes, top share."""
    long = codes.select(F.explode(F.array(*[F.struct(F.lit(c).alias("layer"), F.lit(k).cast("long").alias("declared"), F.col(c).alias("code")) for c, k in layers.items()])).alias("x")).groupBy("x.layer", "x.declared", "x.code").agg(F.count(F.lit(1)).alias("n"))
    x = F.col("n").cast("double")
    agg = long.groupBy("layer", "declared").agg(
        F.count(F.lit(1)).alias("used"),
        F.sum("n").alias("rows"),
        F.sum(x * F.log(x)).alias("nlogn"),
        F.sum(x * x).alias("squares"),
        F.max("n").alias("top"),
    )
    rows = F.col("rows").cast("double")
    h = F.log(rows) - F.col("nlogn") / rows
    return agg.select(
        "layer",
        "declared",
        "used",
        (F.col("used") / F.col("declared")).alias("utilisation"),
        h.alias("entropy"),
        (h / F.log(F.col("declared").cast("double"))).alias("normalized_entropy"),
        F.exp(h).alias("perplexity"),
        (rows * rows / F.col("squares")).alias("effective_codes"),
        (F.col("top") / rows).alias("top_share"),
    )


def occupancy(codes: DataFrame, column: str, declared: int) -> DataFrame:
    """Active codes, effective codes and the Gini coefficient over all declared slots, empty ones included."""
    n = codes.groupBy(F.col(column).cast("long").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    slots = codes.sparkSession.range(declared).withColumnRenamed("id", "code").join(n, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))
    ranked = slots.withColumn("i", F.row_number().over(Window.orderBy("n", "code")))  # one row a slot
    return ranked.agg(
        F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("active"),
        (F.pow(F.sum("n"), F.lit(2)) / F.sum(F.col("n") * F.col("n"))).alias("effective_codes"),
        (F.sum((2 * F.col("i") - declared - 1) * F.col("n")) / (declared * F.sum("n"))).alias("gini"),
    )


def prefix_rollup(codes: DataFrame, layers: list[str], label: str) -> DataFrame:
    """By prefix depth: buckets, singletons, largest bucket, and micro and macro purity of a label."""
    per = codes.groupBy(*layers, label).agg(F.count(F.lit(1)).alias("n"))
    levels = F.array(*[F.struct(
        F.lit(d).alias("depth"),
        F.array(*[F.col(c) if i < d else F.lit(None).cast("int") for i, c in enumerate(layers)]).alias("prefix"),
    ) for d in range(1, len(layers) + 1)])
    spread = per.select(F.explode(levels).alias("x"), label, "n").groupBy("x.depth", "x.prefix", label).agg(F.sum("n").alias("n"))
    b = spread.groupBy("depth", "prefix").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col(label).isNotNull(), F.col("n"))).alias("known"),
        F.max(F.when(F.col(label).isNotNull(), F.col("n"))).alias("top"),
    )
    return b.groupBy("depth").agg(
        F.count(F.lit(1)).alias("buckets"),
        F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("singletons"),
        F.max("n").alias("max_size"),
        (F.sum("top") / F.sum("known")).alias("micro_purity"),
        F.avg(F.col("top") / F.col("known")).alias("macro_purity"),
    )


def mutual_information(codes: DataFrame, key: list[str], label: str) -> DataFrame:
    """Purity, mutual information in nats, NMI with the geometric mean, and the entropy of the label given the bucket."""
    joint = codes.groupBy(*key, label).agg(F.count(F.lit(1)).cast("double").alias("n"))
    part, cat = joint.groupBy(*key).agg(F.sum("n").alias("n"), F.max("n").alias("top")), joint.groupBy(label).agg(F.sum("n").alias("n"))
    f = lambda frame: frame.agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    all_ = f(joint).select(F.col("total"), F.col("nlogn").alias("j")).crossJoin(part.agg(F.sum(F.col("n") * F.log("n")).alias("p"), F.sum("top").alias("top"))).crossJoin(f(cat).select(F.col("nlogn").alias("c")))
    n = F.col("total")
    h = lambda c: F.log(n) - F.col(c) / n
    mi = F.greatest(F.lit(0.0), h("p") + h("c") - h("j"))
    return all_.select((F.col("top") / n).alias("purity"), mi.alias("mutual_information"), (mi / F.sqrt(h("p") * h("c"))).alias("nmi"), (h("j") - h("p")).alias("conditional_entropy"))


def collision_resolution(codes: DataFrame, sid: list[str], extra: list[str]) -> DataFrame:
    """One row: rows and buckets that collide on sid, and how many more columns make unique or wholly resolve."""
    fine = codes.groupBy(*sid, *extra).agg(F.count(F.lit(1)).alias("n"))
    b = fine.groupBy(*sid).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("single"), F.max("n").alias("most"), F.count(F.lit(1)).alias("parts"))
    c = F.col("n") > 1
    return b.agg(
        F.sum(F.when(c, F.col("n")).otherwise(0)).alias("colliding_rows"),
        F.sum(F.when(c, F.col("single")).otherwise(0)).alias("resolved_rows"),
        F.sum(F.when(c, 1).otherwise(0)).alias("colliding_buckets"),
        F.sum(F.when(c & (F.col("most") == 1), 1).otherwise(0)).alias("resolved_buckets"),
        F.sum(F.col("n") - 1).alias("excess_before"),
        F.sum(F.col("n") - F.col("parts")).alias("excess_after"),
    )


def cascade(codes: DataFrame, base: list[str], steps: list[tuple[str, list[str]]]) -> DataFrame:
    """step, stage, excess after splitting base by each step's columns, reduction against the base and the step before."""
    frames = [codes.groupBy(*base, *extra).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1).alias("excess")).select(F.lit(i).alias("step"), F.lit(name).alias("stage"), "excess") for i, (name, extra) in enumerate([("base", []), *steps])]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    w = Window.orderBy("step")  # one row a step
    return out.withColumn("from_base", F.first("excess").over(w) - F.col("excess")).withColumn("from_previous", F.coalesce(F.lag("excess").over(w) - F.col("excess"), F.lit(0)))


def with_counts(codes: DataFrame, key: list[str], name: str) -> DataFrame:
    """codes with the number of rows that share key: counts are taken map-side and joined, so no key gathers its rows."""
    return codes.join(codes.groupBy(*key).agg(F.count(F.lit(1)).alias(name)), key)


def migration(codes: DataFrame, before: list[str], after: list[str]) -> DataFrame:
    """By row: bucket sizes before and after, rows in both, Jaccard of the peers (1 without any), whether peers changed."""
    out = with_counts(with_counts(with_counts(codes, before, "before_size"), after, "after_size"), list(dict.fromkeys([*before, *after])), "common")
    union = F.col("before_size") + F.col("after_size") - F.col("common") - 1
    changed = (F.col("before_size") != F.col("common")) | (F.col("after_size") != F.col("common"))
    return out.withColumn("peer_jaccard", F.when(union == 0, 1.0).otherwise((F.col("common") - 1) / union)).withColumn("changed", changed)


def peer_labels(codes: DataFrame, before: list[str], after: list[str], label: str) -> DataFrame:
    """By row: share of its label among peers before and after, and the exact sign of the change (-2 for singletons)."""
    out = codes
    for key, name in ((before, "b"), (after, "a"), ([*before, label], "sb"), ([*after, label], "sa")):
        out = with_counts(out, key, name)
    alone = (F.col("b") == 1) | (F.col("a") == 1)
    sign = F.signum(((F.col("sa") - 1) * (F.col("b") - 1) - (F.col("sb") - 1) * (F.col("a") - 1)).cast("double")).cast("int")
    share = lambda s, n: F.when(F.col(n) > 1, (F.col(s) - 1) / (F.col(n) - 1))
    out = out.withColumn("share_before", share("sb", "b")).withColumn("share_after", share("sa", "a"))
    return out.withColumn("outcome", F.when(alone, -2).otherwise(sign)).drop("a", "b", "sa", "sb")


def prefix_table(paths: DataFrame, path: str) -> DataFrame:
    """depth, prefix, next_token, rows: the children of every prefix; next_token is null where a path ends."""
    steps = F.transform(
        F.sequence(F.lit(0), F.size(path)),
        lambda d: F.struct(d.alias("depth"), F.slice(F.col(path), F.lit(1), d).alias("prefix"), F.get(F.col(path), d).alias("next_token")),
    )
    return paths.select(F.explode(steps).alias("x")).groupBy("x.depth", "x.prefix", "x.next_token").agg(F.count(F.lit(1)).alias("rows"))


def transition_matrix(codes: DataFrame, source: str, target: str) -> DataFrame:
    return codes.groupBy(F.col(source).alias("source_code"), F.col(target).alias("target_code")).agg(F.count(F.lit(1)).alias("n"))


def first_precision(codes: DataFrame, group: list[str], text: str, lengths: list[int]) -> DataFrame:
    """By row of a colliding group: the first prefix length of a text that isolates it, else 0."""
    out = with_counts(codes, group, "n").where("n > 1").drop("n")
    found = F.lit(0)
    for k in sorted(lengths, reverse=True):
        out = with_counts(out.withColumn(f"p{k}", F.substring(text, 1, k)), [*group, f"p{k}"], f"n{k}")
        found = F.when(F.col(f"n{k}") == 1, k).otherwise(found)
    return out.withColumn("first_length", found).drop(*[f"{c}{k}" for k in lengths for c in "np"])


def irreducible(codes: DataFrame, key: list[str]) -> DataFrame:
    """Groups of rows that agree in every column of key."""
    return buckets(codes, key).where("n > 1")


def exact_vector_classes(codes: DataFrame, group: list[str], vector: str, id_: str) -> DataFrame:
    """group, id (smallest of its class), class_size; only groups with several distinct vectors."""
    per = codes.groupBy(*group, F.col(vector).alias("v")).agg(F.min(id_).alias(id_), F.count(F.lit(1)).alias("class_size"))
    return per.withColumn("classes", F.count(F.lit(1)).over(Window.partitionBy(*group))).where("classes > 1").drop("v")


def parent_collisions(codes: DataFrame, parent: list[str], code: str) -> DataFrame:
    """By parent: pairs of rows that share a code."""
    return codes.groupBy(*parent, code).agg(F.count(F.lit(1)).alias("n")).groupBy(*parent).agg(F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"))


def common_prefix_candidates(codes: DataFrame, bucket: list[str], tokens: str) -> DataFrame:
    """By row: the length p of its bucket's common prefix, candidate 1 (token p), candidate 2 (token p and p+1 packed), -1 past the end."""
    positions = codes.select(*bucket, F.posexplode(tokens).alias("pos", "t")).groupBy(*bucket, "pos").agg((F.min("t") == F.max("t")).alias("same"))
    p = positions.groupBy(*bucket).agg(F.coalesce(F.min(F.when(~F.col("same"), F.col("pos"))), F.max("pos") + 1).alias("p"))
    at = lambda k: F.get(F.col(tokens), F.col("p") + k)
    return codes.join(p, bucket).withColumn("candidate1", F.coalesce(at(0), F.lit(-1))).withColumn("candidate2", F.coalesce(32 + 32 * at(0) + at(1), F.lit(-1)))
