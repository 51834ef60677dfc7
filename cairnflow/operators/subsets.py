"""Deterministic subsets for evaluation and inspection: quotas, balances, hold-outs, nested prefixes, pairs and cases.

Random choices are orders by a hash of the id and a seed, so reruns and partitionings agree. Sizes are parameters and features of
the operators; what is ranked is a stratum, a bucket or a bracket of the whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnflow.functions import text
from cairnflow.operators.identifiers import with_counts
from cairnflow.operators.sampling import nth_smallest

# Kinds of geographic relation in a query and the pattern that tells each.
GEOGRAPHIC = (
    ("nearby", r"附近|周边|旁边|边上|周围|就近|最近|邻近"),
    ("distance", r"(?:\d+(?:\.\d+)?|[一二三四五六七八九十百千两]+)\s*(?:米|公里|千米|km)"),
    ("direction", r"(?:东北|东南|西北|西南|东|南|西|北)(?:门|侧|边|面|口)|(?:往|向)(?:东|南|西|北)"),
    ("opposite_or_intersection", r"对面|隔壁|路口|交叉口|十字路口"),
    ("inside_or_entrance", r"里面|外面|内部|园内|校内|院内|楼内|馆内|站内|站外|门口"),
    ("transit_exit", r"(?:地铁|轨道交通).{0,8}(?:站|口)|(?:[a-h]|[一二三四五六七八九十])口"),
)


def order_hash(id_: Column, seed: int | str) -> Column:
    """SHA-256 of `seed:id`, the order of all samples here."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), id_.cast("string")), 256)


def geographic_types(query: Column, unicode: bool = True) -> Column:
    """Names of the kinds of relation that the compact form of a query speaks of."""
    t = text.compact(query, unicode)
    return F.filter(F.array(*[F.when(t.rlike(p), F.lit(n)) for n, p in GEOGRAPHIC]), lambda x: x.isNotNull())


def geographic_sample(rows: DataFrame, query: str, id_: str, k: int, shortest: int = 6, seed: int | str = 0) -> DataFrame:
    """The k rows of smallest hash whose query has a geographic relation and at least `shortest` characters; with its kinds."""
    fit = rows.withColumn("kinds", geographic_types(F.col(query))).where((F.size("kinds") > 0) & (F.length(text.compact(F.col(query))) >= shortest))
    return fit.orderBy(order_hash(F.col(id_), seed), id_).limit(k)


def quota_sample(rows: DataFrame, stratum: str, id_: str, size: int, seed: int | str = 0) -> DataFrame:
    """About equal numbers of each stratum, `size` in all: every stratum gives size // strata, and the first size % strata of
    them, by their own hash, one more. A stratum with fewer rows gives what it has."""
    strata = rows.select(stratum).distinct()  # a day, a kind: a bounded vocabulary
    n = strata.count()
    if not n:
        return rows.limit(0)
    place = F.row_number().over(Window.orderBy(order_hash(F.col(stratum), seed), stratum))
    quota = strata.withColumn("__quota", F.lit(size // n) + F.when(place <= size % n, 1).otherwise(0))
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy(order_hash(F.col(id_), seed), id_)))
    return ranked.join(F.broadcast(quota), stratum).where("__r <= __quota").drop("__r", "__quota")


def balanced_sample(rows: DataFrame, label: str, labels: list, id_: str, per_label: int, seed: int | str = 0) -> DataFrame:
    """per_label rows of each named label, with their position; position 1 is the label's anchor."""
    w = Window.partitionBy(label).orderBy(order_hash(F.col(id_), seed), id_)
    return rows.where(F.col(label).isin(labels)).withColumn("position", F.row_number().over(w)).where(F.col("position") <= per_label)


def hash_rank_below(rows: DataFrame, id_: str, size: int, seed: int | str = 0) -> Column:
    """Condition: whether a row is among the `size` of smallest hash. A row's order depends on its id only, so samples are nested."""
    n = rows.count()
    hashed = order_hash(F.col(id_), seed)
    order = F.struct(F.conv(F.substring(hashed, 1, 13), 16, 10).cast("long").alias("n"), hashed.alias("h"), F.col(id_).alias("i"))
    edge = nth_smallest(rows, order, n, min(size, n))
    if edge is None:
        return F.lit(False)
    return order <= F.struct(F.lit(edge["n"]).cast("long").alias("n"), F.lit(edge["h"]).alias("h"), F.lit(edge["i"]).alias("i"))


def split_roles(rows: DataFrame, id_: str, validation: float, kmeans: int, seed: int = 0) -> DataFrame:
    """rows with role (validation for about the given share of ids, else train) and kmeans (the given number of train rows of smallest hash)."""
    share = F.pmod(F.xxhash64(F.lit(seed), F.col(id_)), F.lit(1 << 32)) / float(1 << 32)
    out = rows.withColumn("role", F.when(share < validation, "validation").otherwise("train"))
    train = out.where("role = 'train'")
    return out.withColumn("kmeans", (F.col("role") == "train") & hash_rank_below(train, id_, kmeans, seed))


def holdout_after_gate(rows: DataFrame, id_: str, gate: int, holdout: int, seed: int | str = 0) -> DataFrame:
    """rows with part: in hash order the first `gate` rows are gate, the next `holdout` holdout, the rest train (as is the gate)."""
    n = rows.count()
    if n <= gate + holdout:
        raise ValueError("too few rows for a gate and a hold-out")
    first, both = hash_rank_below(rows, id_, gate, seed), hash_rank_below(rows, id_, gate + holdout, seed)
    return rows.withColumn("part", F.when(first, "gate").when(both, "holdout").otherwise("train"))


def collision_anchors(rows: DataFrame, methods: list[list[str]], label: str, id_: str, least: int, most: int, seed: int | str = 0) -> DataFrame:
    """One row a label among those whose bucket has `least` to `most` rows under every method's codes."""
    out, fit = rows, []
    for i, key in enumerate(methods):
        out = with_counts(out, key, f"__n{i}")
        fit.append(F.col(f"__n{i}").between(least, most))
    w = Window.partitionBy(label).orderBy(order_hash(F.col(id_), seed), id_)
    sizes = [F.col(f"__n{i}").alias(f"size_{i}") for i in range(len(methods))]
    return out.where(reduce(lambda a, b: a & b, fit)).withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*rows.columns, *sizes)


def migration_anchors(moves: DataFrame, id_: str, recoded: Column, most: int | None, seed: int | str = 0) -> DataFrame:
    """One row for each outcome (-1 worse, 0 equal, 1 better) among rows whose code and peers changed; buckets of at most `most` rows."""
    fit = moves.where(recoded & F.col("changed") & F.col("outcome").isin(-1, 0, 1))
    if most is not None:
        fit = fit.where((F.col("before_size") <= most) & (F.col("after_size") <= most))
    w = Window.partitionBy("outcome").orderBy(order_hash(F.col(id_), seed), id_)
    return fit.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def bucket_cases(rows: DataFrame, key: list[str], id_: str, buckets: int, members: int) -> DataFrame:
    """The first `members` rows of the `buckets` largest buckets (ties by key), with bucket_size and whether rows were left out."""
    n = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("bucket_size"))
    top = n.where("bucket_size > 1").orderBy(F.desc("bucket_size"), *key).limit(buckets)
    ranked = rows.join(F.broadcast(top), key).withColumn("position", F.row_number().over(Window.partitionBy(*key).orderBy(id_)))
    return ranked.where(F.col("position") <= members).withColumn("truncated", F.col("bucket_size") > members)


def residual_cases(rows: DataFrame, key: list[str], name: str, category: str, lng: str, lat: str, buckets: int) -> DataFrame:
    """The largest buckets with their distinct names, categories and places, the diagonal of their bounding box in metres, and why
    their rows could not be told apart."""
    from cairnflow.functions import geo

    per = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("bucket_size"),
        F.count_distinct(name).alias("names"),
        F.count_distinct(category).alias("categories"),
        F.count_distinct(lng, lat).alias("places"),
        *[f(c).alias(f"{n}_{c}") for c in (lng, lat) for n, f in (("low", F.min), ("high", F.max))],
    )
    top = per.where("bucket_size > 1").orderBy(F.desc("bucket_size"), *key).limit(buckets)
    span = geo.haversine(F.col(f"low_{lng}"), F.col(f"low_{lat}"), F.col(f"high_{lng}"), F.col(f"high_{lat}"))
    why = F.when((F.col("names") == 1) & (F.col("places") == 1), "same_name_and_place").when(F.col("places") == 1, "same_place").when(F.col("names") == 1, "same_name").otherwise("distinct")
    return top.select(*key, "bucket_size", "names", "categories", "places", span.alias("span"), why.alias("reason"))


def prefix_pairs(codes: DataFrame, levels: list[str], depth: int, id_: str, k: int, seed: int | str = 0) -> DataFrame:
    """k pairs of rows that share exactly `depth` codes, spread over the groups by their number of such pairs.

    A group of n rows, split by its next code, has (n^2 - sum n_c^2) / 2 such pairs. Draws fall on groups by cumulated pairs; a draw's
    two rows come from different next codes: the j-th row of the group against rows outside its code, by order of (code, id).
    The groups' table is small next to the rows; only drawn groups' rows are looked at."""
    key, next_ = levels[:depth], levels[depth]
    per = codes.groupBy(*key, next_).agg(F.count(F.lit(1)).alias("c")).groupBy(*key).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s"))
    groups = per.withColumn("pairs", ((F.col("n") * F.col("n") - F.col("s")) / 2).cast("long")).where("pairs > 0")
    upto = F.sum("pairs").over(Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, 0))
    ranged = groups.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("pairs"))
    total = groups.agg(F.sum("pairs")).collect()[0][0] or 0
    spark = codes.sparkSession
    draws = spark.range(k if total else 0).select(F.col("id").alias("draw"))
    at = F.pmod(F.conv(F.substring(order_hash(F.col("draw"), seed), 1, 13), 16, 10).cast("long"), F.lit(max(1, total)))
    drawn = draws.withColumn("at", at).join(F.broadcast(ranged), (F.col("at") >= F.col("from")) & (F.col("at") < F.col("upto")))
    members = codes.join(drawn.select(*key).distinct(), key, "left_semi")
    place = Window.partitionBy(*key).orderBy(next_, id_)
    spread = members.select(*key, next_, id_).withColumn("j", F.row_number().over(place) - 1)
    span = spread.groupBy(*key, next_).agg(F.min("j").alias("low"), F.count(F.lit(1)).alias("c"))
    first = drawn.withColumn("j", F.pmod(F.col("at") - F.col("from"), F.col("n"))).join(spread.withColumnRenamed(id_, "a"), [*key, "j"]).join(span, [*key, next_])
    # the partner is one of the n - c rows outside the first row's code
    step = F.pmod(F.floor((F.col("at") - F.col("from")) / F.col("n")).cast("long"), F.col("n") - F.col("c"))
    other = first.withColumn("j", F.when(step < F.col("low"), step).otherwise(step + F.col("c"))).drop(next_, "low", "c")
    return other.join(spread.select(*key, "j", F.col(id_).alias("b")), [*key, "j"]).select("draw", "a", "b")


def prefix_members(codes: DataFrame, anchors: DataFrame, levels: list[str], id_: str, label: str, top: int) -> DataFrame:
    """anchor, depth, rows, label, n: the top labels among the rows that share an anchor's first `depth` codes."""
    out = []
    for d in range(1, len(levels) + 1):
        key = levels[:d]
        per = codes.join(anchors.select(*key).distinct(), key, "left_semi").groupBy(*key, label).agg(F.count(F.lit(1)).alias("n"))
        rows = per.groupBy(*key).agg(F.sum("n").alias("rows"))
        ranked = per.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), label))).where(F.col("__r") <= top).drop("__r")
        out.append(anchors.select(F.col(id_).alias("anchor"), *key).join(ranked, key).join(rows, key).select("anchor", F.lit(d).alias("depth"), "rows", label, "n"))
    return reduce(DataFrame.unionByName, out)


def eligible_groups(rows: DataFrame, group: str, before: str, after: str, least: int, most: int, least_pairs: int) -> DataFrame:
    """Groups of `least` to `most` rows with at least `least_pairs` pairs of one code before and none after."""
    pairs = lambda c, n: rows.groupBy(group, c).agg(F.count(F.lit(1)).alias("k")).groupBy(group).agg(F.sum("k").alias(f"{n}_rows"), F.sum(F.expr("k * (k - 1) div 2")).alias(f"{n}_pairs"))
    both = pairs(before, "before").join(pairs(after, "after"), group)
    fit = F.col("before_rows").between(least, most) & (F.col("before_pairs") >= least_pairs) & (F.col("after_pairs") == 0)
    return both.where(fit).select(group, F.col("before_rows").alias("rows"), "before_pairs")


def colliding_parents(rows: DataFrame, parent: list[str], code: str, edges: DataFrame, least: int, most: int, k: int, seed: int | str = 0) -> DataFrame:
    """k parents of `least` to `most` rows with colliding codes and with hard edges (parent columns, edges), by hash."""
    per = rows.groupBy(*parent, code).agg(F.count(F.lit(1)).alias("c")).groupBy(*parent).agg(F.sum("c").alias("rows"), F.sum(F.expr("c * (c - 1) div 2")).alias("collisions"))
    fit = per.where(F.col("rows").between(least, most) & (F.col("collisions") > 0)).join(edges.where("edges > 0"), parent)
    name = F.concat_ws("-", *[F.col(c).cast("string") for c in parent])
    return fit.orderBy(order_hash(name, seed), *parent).limit(k)


def frozen_set(reference: DataFrame, rows: DataFrame, train: DataFrame, key: list[str]) -> DataFrame:
    """The rows that the reference names and that no training row names, with the reference's position."""
    named = reference.select(*key, "position").join(rows, key)
    return named.join(train.select(*key).distinct(), key, "left_anti")


def mined_union(parts: list[DataFrame], sample: str, negative: str, target: str, equivalents: DataFrame, k: int, seed: int | str = 0) -> DataFrame:
    """Mined rows of all parts without negatives equivalent to their target, the k of smallest hash. Rows whose negative has no
    entity stay.

    equivalents: id, representative (one for all that are strictly equivalent). A sample that several parts name is a fault: it is
    told by duplicate_samples()."""
    rows = reduce(DataFrame.unionByName, parts)
    e = lambda c: equivalents.select(F.col("id").alias(c), F.col("representative").alias(f"__{c}"))
    both = rows.join(e(negative), negative, "left").join(e(target), target, "left")
    same = F.coalesce((F.col(negative) == F.col(target)) | (F.col(f"__{negative}") == F.col(f"__{target}")), F.lit(False))
    return both.where(~same).drop(f"__{negative}", f"__{target}").orderBy(order_hash(F.col(sample), seed), sample).limit(k)


def duplicate_samples(parts: list[DataFrame], sample: str) -> DataFrame:
    rows = reduce(DataFrame.unionByName, [p.select(sample) for p in parts])
    return rows.groupBy(sample).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def shuffled(rows: DataFrame, id_: str, seed: int | str = 0) -> DataFrame:
    """All rows in hash order: a range-partitioned sort, so that no task holds more than its range."""
    return rows.orderBy(order_hash(F.col(id_), seed), id_)
