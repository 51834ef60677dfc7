"""Derived assets: vectors and features of selected entities, encoders over batches, geographic features, local refinement.

Assets are tables keyed by ids. A job that may be resumed writes by parts and leaves out parts that are there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.functions import geo
from cairnflow.functions import vector as V
from cairnflow.operators.identifiers import with_counts
from cairnflow.operators.vectors import mean_vector

#: Takes texts, gives as many vectors.
Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dimensions: int = 64) -> Encoder:
    """A deterministic stand-in for a neural encoder: signed hashes of character trigrams, of unit length."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions))
        for i, t in enumerate(texts):
            for k in range(max(1, len(t) - 2)):
                h = int.from_bytes(hashlib.blake2b(t[k : k + 3].encode(), digest_size=8).digest(), "big")
                out[i, h % dimensions] += 1.0 if h >> 63 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def encoded(rows: DataFrame, id_: str, text: str, encoder: Encoder, batch: int = 256) -> DataFrame:
    """id, vector: any encoder over Arrow batches; it travels with the plan and is called with `batch` texts at a time."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        parts = [encoder([t or "" for t in texts.iloc[i : i + batch]]) for i in range(0, len(texts), batch)]
        return pd.Series([v.tolist() for part in parts for v in part])

    return rows.select(id_, run(text).alias("vector"))


def pending(rows: DataFrame, done: DataFrame | None, part: Column) -> DataFrame:
    """rows with their part, without the parts that `done` (part) already has: what a resumed job still has to do."""
    out = rows.withColumn("part", part)
    return out if done is None else out.join(done.select("part").distinct(), "part", "left_anti")


@dataclass(frozen=True)
class FeatureJob:
    """Settings of a feature job, checked when made."""

    start: str
    end: str
    partitions: int
    most_rows: int | None = None

    def __post_init__(self):
        from datetime import date

        if date.fromisoformat(self.start) > date.fromisoformat(self.end):
            raise ValueError("the first day comes after the last")
        if self.partitions < 1 or (self.most_rows is not None and self.most_rows < 1):
            raise ValueError("partitions and rows are counted from 1")


def faults_of(vectors: DataFrame, ids: DataFrame, id_: str, vector: str, dimensions: int) -> DataFrame:
    """fault, rows: what keeps vectors from being clustered: another width, numbers that are not finite, no length, unknown or missing ids."""
    x = F.col(vector)
    bad = {
        "wrong_width": F.size(x) != dimensions,
        "not_finite": F.exists(x, lambda v: F.isnan(v.cast("double")) | v.isNull() | (F.abs(v.cast("double")) == float("inf"))),
        "zero_length": F.forall(x, lambda v: v == 0),
    }
    named = vectors.join(ids.select(id_).withColumn("__known", F.lit(True)), id_, "full")
    checks = [F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in bad.items()]
    checks += [F.when(F.col("__known").isNull(), F.lit("unknown_id")), F.when(F.col("__known") & x.isNull(), F.lit("missing_vector"))]
    return named.select(F.explode(F.filter(F.array(*checks), lambda f: f.isNotNull())).alias("fault")).groupBy("fault").agg(F.count(F.lit(1)).alias("rows"))


def heterogeneity(entity_vectors: DataFrame, entity: str, content: str) -> DataFrame:
    """Of vectors.query_vectors() joined to content vectors: effective number of queries and how near their mean is to the content."""
    return entity_vectors.select(entity, "queries", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.cosine(F.col(content), F.col("e1")))).alias("content_query_cosine"))


def adaptive_alpha(effective: Column, low: float, high: float, tau: float, gamma: float) -> Column:
    """Weight of a query view: high for few queries, falling to low as their effective number passes tau."""
    return low + (high - low) / (1.0 + F.pow(effective / tau, F.lit(gamma)))


def prefix_length(level: Column, gamma: int = 2) -> Column:
    """How many tokens of a place a proximity level leaves."""
    return F.greatest(level - gamma, F.lit(0))


def content_geo(text: Column, text_weight: float, category: Column, categories: int, category_weight: float, region: Column, regions: int, region_weight: float) -> Column:
    """Unit text vector, one-hot category and one-hot region side by side, each times its weight, over the weights' length."""
    return V.blocks([(V.unit(text), text_weight), (V.one_hot(category, categories), category_weight), (V.one_hot(region, regions), region_weight)])


def parent_geo(rows: DataFrame, parent: list[str], lng: str, lat: str) -> DataFrame:
    """rows with dx, dy (metres from the centre of the row's parent; 0 alone) and, robustly scaled over all rows that are not alone,
    geo: a unit vector of the logarithm of the distance and the sine and cosine of the bearing, 0s alone.

    Centres are sums taken map-side and joined; the scale is one row of approximate quartiles."""
    centres = rows.groupBy(*parent).agg(F.avg(lng).alias("__x"), F.avg(lat).alias("__y"), F.count(F.lit(1)).alias("__n"))
    both = rows.join(centres, parent)
    x, y = geo.local_metres(F.col(lng), F.col(lat), F.col("__x"), F.col("__y"))
    some = F.col("__n") > 1
    both = both.withColumn("dx", F.when(some, x).otherwise(0.0)).withColumn("dy", F.when(some, y).otherwise(0.0))
    both = both.withColumn("__d", F.log1p(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)))
    scale = both.where(some).agg(F.percentile("__d", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.avg("__d").alias("m"), F.stddev_pop("__d").alias("s"))
    spread = F.get("q", F.lit(2)) - F.get("q", F.lit(0))
    scale = scale.select(
        F.when(spread > 1e-12, F.get("q", F.lit(1))).otherwise(F.col("m")).alias("__mid"),
        F.when(spread > 1e-12, spread).otherwise(F.greatest("s", F.lit(1e-12))).alias("__spread"),
    )
    both = both.crossJoin(F.broadcast(scale))  # one row
    angle = F.atan2("dy", "dx")
    feature = V.unit(F.array((F.col("__d") - F.col("__mid")) / F.col("__spread"), F.sin(angle), F.cos(angle)))
    zero = F.array(*[F.lit(0.0)] * 3)
    return both.withColumn("geo", F.when(some, F.coalesce(feature, zero)).otherwise(zero)).drop("__x", "__y", "__n", "__d", "__mid", "__spread")


def local_codes(
    rows: DataFrame,
    parent: list[str],
    id_: str,
    vector: str,
    book: list[tuple[int, list[float]]],
    lng: str,
    lat: str,
    candidates: int,
    geo_weight: float,
    collision_weight: float,
    hard: DataFrame,
    sweeps: int = 2,
    scale: float = 1000.0,
) -> DataFrame:
    """Codes of the last level, chosen within parents: id, code, objective.

    A row weighs its nearest `candidates` codes: 1 - cosine, plus geo_weight times the distance to the mean place of the code's rows in the parent (in
    units of `scale` metres, at most 1), plus collision_weight for each hard neighbour (hard: id, neighbor) with that code. Rows start at their
    nearest code; in each sweep places are taken anew, rows whose hash is even move first and the others see them move. A sweep is
    joins and aggregates over all parents at once; no parent is gathered."""
    from cairnflow.sources.scratch import cut

    codes, matrix = np.array([c for c, _ in book]), np.array([v for _, v in book], np.float64)
    shared = rows.sparkSession.sparkContext.broadcast((codes, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)))

    @F.pandas_udf("array<struct<code:int,content:double>>")
    def nearest(v: pd.Series) -> pd.Series:
        codes, m = shared.value
        if not len(v):
            return pd.Series([], dtype=object)
        x = np.stack(v.to_numpy()).astype(np.float64)
        d = 1.0 - (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)) @ m.T
        best = np.argsort(np.round(d, 12), axis=1, kind="stable")[:, :candidates]
        return pd.Series([[{"code": int(codes[j]), "content": float(d[i, j])} for j in b] for i, b in enumerate(best)])

    options = cut(rows.select(*parent, id_, lng, lat, nearest(vector).alias("c")))
    state = cut(options.select(*parent, id_, lng, lat, F.get("c", F.lit(0))["code"].alias("code")))
    weighed = None
    for sweep in range(2 * sweeps):
        places = state.groupBy(*parent, "code").agg(F.avg(lng).alias("cx"), F.avg(lat).alias("cy"))
        taken = hard.join(state.select(F.col(id_).alias("neighbor"), "code"), "neighbor").groupBy(id_, "code").agg(F.count(F.lit(1)).alias("clashes"))
        opened = options.select(*parent, id_, lng, lat, F.explode("c").alias("o")).select(*parent, id_, lng, lat, "o.code", "o.content")
        both = opened.join(places, [*parent, "code"], "left").join(taken, [id_, "code"], "left")
        away = F.coalesce(F.least(F.lit(1.0), geo.haversine(F.col(lng), F.col(lat), F.col("cx"), F.col("cy")) / scale), F.lit(0.0))
        cost = F.col("content") + geo_weight * away + collision_weight * F.coalesce("clashes", F.lit(0))
        best = both.groupBy(id_).agg(F.min(F.struct(F.round(cost, 12).alias("objective"), "code")).alias("b")).select(
            id_,
            F.col("b.code").alias("to"),
            F.col("b.objective").alias("objective"),
        )
        moves = F.pmod(F.xxhash64(id_), F.lit(2)) == sweep % 2
        weighed = cut(state.join(best, id_).withColumn("code", F.when(moves, F.col("to")).otherwise(F.col("code"))).drop("to"))
        state = weighed.drop("objective")
    return weighed.select(id_, "code", "objective") if weighed is not None else state.select(id_, "code", F.lit(None).cast("double").alias("objective"))


def paired_codebooks(first: DataFrame, second: DataFrame, edges: DataFrame, id_: str, neighbour: str, label: str) -> DataFrame:
    """method, rows, agreement (weighted share of edges whose ends have one code), purity: two codebooks on the same closed graph.

    Only ids that both have, and edges between such ids, count. Frames: id, code, label."""
    known = first.select(id_).join(second.select(id_), id_)
    inside = edges.join(known, id_).join(known.withColumnRenamed(id_, neighbour), neighbour)
    out = []
    for name, f in (("first", first), ("second", second)):
        own = f.join(known, id_)
        a, b = own.select(id_, F.col("code").alias("a")), own.select(F.col(id_).alias(neighbour), F.col("code").alias("b"))
        share = inside.join(a, id_).join(b, neighbour).agg((F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("agreement"))
        n = own.groupBy("code", label).agg(F.count(F.lit(1)).alias("n")).groupBy("code").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
        out.append(n.agg(F.lit(name).alias("method"), F.sum("n").alias("rows"), (F.sum("top") / F.sum("n")).alias("purity")).crossJoin(share))  # of one row each
    return out[0].unionByName(out[1])


def both_orders(rows: DataFrame, first: DataFrame, second: DataFrame, key: str, ids: str) -> DataFrame:
    """key, first, second: one array of ids written through two mappings (old, new) at once; null where an id has no new value."""
    opened = rows.select(key, F.posexplode_outer(ids).alias("pos", "old"))
    named = opened.join(first.withColumnRenamed("new", "a"), "old", "left").join(second.withColumnRenamed("new", "b"), "old", "left")
    closed = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "a", "b"))))
    return named.groupBy(key).agg(closed.alias("x")).select(key, F.transform("x", lambda s: s["a"]).alias("first"), F.transform("x", lambda s: s["b"]).alias("second"))


def preview(rows: DataFrame, index: str, limit: int, group: str) -> DataFrame:
    """group, rows: counts over the rows below an index, without writing anything (the bound is the operator's)."""
    return rows.where(F.col(index) < limit).groupBy(group).agg(F.count(F.lit(1)).alias("rows"))


def appended(parts: Iterable[DataFrame]) -> DataFrame:
    """All parts of a table by column name."""
    first, *rest = parts
    for p in rest:
        first = first.unionByName(p)
    return first


def alone(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key no other row has."""
    return with_counts(rows, key, "__n").where("__n = 1").drop("__n")


def centred_on(rows: DataFrame, vector: str, group: list[str]) -> DataFrame:
    """rows with the unit vector less the mean of its group."""
    return rows.join(mean_vector(rows, group, vector).select(*group, "mean"), group).withColumn("centred", V.centred(F.col(vector), F.col("mean"))).drop("mean")
