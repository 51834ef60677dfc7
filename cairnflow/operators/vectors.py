"""Vector operators: exact neighbours, group means, fusion, weighted sums and quantizer steps.

Vectors are array columns keyed by an id, never by row order. The side that is broadcast (queries, centroids) is cut into
blocks of a bounded number of rows; every block passes over the other side once and only top-k lists are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnflow.functions import vector as V
from cairnflow.sources.scratch import cut

#: Rows of a broadcast block: with 1,024 dimensions in double precision 32 MB at most.
BLOCK_ROWS = 4_096
#: Scores that a task holds at a time.
TILE_SCORES = 4_000_000
#: Numbers of a codebook that is sent to the executors: 256 MB. Larger ones are a fault of the caller.
MOST_CODEBOOK = 32_000_000
#: Rows a code in the sample from which seeds are drawn.
SEED_ROWS = 16


def knn(base: DataFrame, queries: DataFrame, k: int, id_: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, forbidden: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, rank: the k largest inner products, ties by the smaller id; pairs of forbidden (query_id, id) left out.

    Queries are broadcast in blocks; each task multiplies its rows with a block and keeps k a query, so the shuffle
    carries k rows a query and task whatever the base's size.
    """
    spark = base.sparkSession
    rows = queries.select(F.col(id_).cast("long").alias("q"), F.col(vector).alias("v"), F.array().cast("array<bigint>").alias("f"))
    if forbidden is not None:
        lists = forbidden.groupBy(F.col("query_id").cast("long").alias("q")).agg(F.collect_set(F.col("id").cast("long")).alias("f"))
        rows = rows.drop("f").join(lists, "q", "left")
    out = None
    schema = "query_id long, id long, score double"
    for part in blocks(rows, block_rows):
        shared = spark.sparkContext.broadcast((np.array([r["q"] for r in part]), np.array([r["v"] for r in part], np.float64), _pairs([r["f"] for r in part])))

        def near(frames, shared=shared):
            ids, matrix, (row, gone) = shared.value
            best_s = np.full((len(ids), 0), -np.inf)
            best_i = np.zeros((len(ids), 0), np.int64)
            step = max(1, TILE_SCORES // len(ids))
            for frame in frames:
                for at in range(0, len(frame), step):
                    tile = frame.iloc[at : at + step]
                    s = matrix @ np.stack(tile["v"].to_numpy()).astype(np.float64).T
                    names = tile["i"].to_numpy()
                    if len(gone):
                        order = np.argsort(names)
                        place = np.minimum(np.searchsorted(names[order], gone), len(names) - 1)
                        hit = names[order[place]] == gone
                        s[row[hit], order[place[hit]]] = -np.inf
                    best_s = np.hstack([best_s, s])
                    best_i = np.hstack([best_i, np.broadcast_to(names, s.shape)])
                    order = np.lexsort((best_i, -best_s), axis=1)[:, :k]
                    best_s, best_i = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_i, order, 1)
            if best_s.size:
                found = pd.DataFrame({"query_id": np.repeat(ids, best_s.shape[1]), "id": best_i.ravel(), "score": best_s.ravel()})
                yield found[found["score"] > -np.inf]

        found = base.select(F.col(id_).cast("long").alias("i"), F.col(vector).alias("v")).mapInPandas(near, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema + ", rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _pairs(lists: list[list[int] | None]) -> tuple[np.ndarray, np.ndarray]:
    """(position of the list, member) of every member."""
    return np.repeat(np.arange(len(lists)), [len(x or ()) for x in lists]), np.array([i for x in lists for i in x or ()], np.int64)


def blocks(rows: DataFrame, size: int):
    """The rows in lists of bounded length, read one partition at a time."""
    block = []
    for row in rows.toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def mean_vector(frame: DataFrame, key: list[str], vector: str, normalise: bool = False) -> DataFrame:
    """By key: the mean (unit mean) vector as an array, and n. One vector a key and task is shuffled; null vectors count nowhere."""
    v = V.unit(F.col(vector)) if normalise else F.col(vector).cast("array<double>")
    rows = frame.select(*key, v.alias("__v")).where("__v is not null").select(*key, array_to_vector("__v").alias("__v"))
    return rows.groupBy(*key).agg(Summarizer.mean(F.col("__v")).alias("m"), F.count(F.lit(1)).alias("n")).select(*key, vector_to_array("m").alias("mean"), "n")


def weighted_mean(frame: DataFrame, key: list[str], vector: str, weight: str) -> DataFrame:
    """By key: the unit weighted sum, the sum of weights, and Kish's effective count in [1, n]."""
    w = F.col(weight)
    rows = frame.select(*key, w.cast("double").alias("__w"), array_to_vector(F.col(vector).cast("array<double>")).alias("__v"))
    per = rows.groupBy(*key).agg(
        Summarizer.mean(F.col("__v"), F.col("__w")).alias("m"),
        F.sum("__w").alias("weight_sum"),
        F.sum(F.col("__w") * F.col("__w")).alias("squares"),
        F.count(F.lit(1)).alias("n"),
    )
    kish = F.least(F.col("n").cast("double"), F.greatest(F.lit(1.0), F.col("weight_sum") * F.col("weight_sum") / F.col("squares")))
    return per.select(*key, V.unit(vector_to_array("m")).alias("vector"), "weight_sum", kish.alias("effective_count"), "n")


def query_vectors(pairs: DataFrame, vectors: DataFrame, entity: str, query: str, n: str, vector: str) -> DataFrame:
    """By entity: e1, the unit sum of its queries' vectors; e2, that sum weighted by ln(1 + n) * ln((entities + 1) / (df + 1)), where df is
    the number of entities a query is chosen for; the weights' sum, the queries and the orders. A query chosen for every
    entity has weight 0; an entity with no other has no e2.

    Sums are taken map-side, one vector an entity and task; nothing passes through the driver."""
    entities = pairs.agg(F.count_distinct(entity).alias("__k"))
    df = pairs.groupBy(query).agg(F.count(F.lit(1)).alias("__df"))
    rows = pairs.join(vectors.select(query, F.col(vector).alias("__v")), query).join(df, query).crossJoin(F.broadcast(entities))
    weight = F.log1p(F.col(n).cast("double")) * F.log((F.col("__k") + 1.0) / (F.col("__df") + 1.0))
    rows = rows.select(entity, n, weight.alias("__w"), array_to_vector(F.col("__v").cast("array<double>")).alias("__v"))
    per = rows.groupBy(entity).agg(
        Summarizer.mean(F.col("__v")).alias("a"),
        Summarizer.mean(F.col("__v"), F.greatest(F.col("__w"), F.lit(1e-300))).alias("b"),
        F.sum("__w").alias("weight_sum"),
        F.count(F.lit(1)).alias("queries"),
        F.sum(n).alias("orders"),
    )
    e2 = F.when(F.col("weight_sum") > 1e-9, V.unit(vector_to_array("b")))
    return per.select(entity, V.unit(vector_to_array("a")).alias("e1"), e2.alias("e2"), "weight_sum", "queries", "orders")


def category_residual(frame: DataFrame, category: str, vector: str, beta: float, min_support: int) -> DataFrame:
    """Unit vector less beta times its category's mean; categories with too few rows leave theirs as it is."""
    means = mean_vector(frame, [category], vector)
    both = frame.join(means.select(F.col(category).alias("__c"), "mean", F.col("n").alias("support")), F.col(category) == F.col("__c"), "left").drop("__c")
    moved = V.unit(F.zip_with(vector, "mean", lambda x, m: x.cast("double") - beta * m))
    return both.withColumn("residual", F.when(F.col("support") >= min_support, moved).otherwise(V.unit(F.col(vector)))).drop("mean")


def _book(spark, centroids: list[tuple[int, list[float]]]):
    """The codebook as one matrix on every executor, if it is one."""
    codes, matrix = np.array([c for c, _ in centroids]), np.array([v for _, v in centroids], np.float64)
    if matrix.size > MOST_CODEBOOK:
        raise ValueError(f"a codebook of {matrix.shape} numbers is no codebook: cluster the centroids first")
    return spark.sparkContext.broadcast((codes, matrix))


def assign(frame: DataFrame, centroids: list[tuple[int, list[float]]], vector: str = "embedding", by: str = "cosine") -> DataFrame:
    """frame with code and score: the best centroid (smallest code of equals). A codebook of K rows is sent as one matrix."""
    shared = _book(frame.sparkSession, centroids)

    @F.pandas_udf("struct<code:int,score:double>")
    def nearest(v: pd.Series) -> pd.DataFrame:
        codes, m = shared.value
        if not len(v):
            return pd.DataFrame({"code": [], "score": []})
        x = np.stack(v.to_numpy()).astype(np.float64)
        if by == "cosine":
            s = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T
        else:
            s = -((x**2).sum(1)[:, None] - 2 * x @ m.T + (m**2).sum(1))
        at = s.argmax(1)
        return pd.DataFrame({"code": codes[at], "score": s[np.arange(len(x)), at]})

    return frame.withColumn("__a", nearest(vector)).select(*frame.columns, "__a.code", "__a.score")


def shrunk_centroids(frame: DataFrame, code: str, vector: str, tau: float) -> DataFrame:
    """By code: r * mean + (1 - r) * global mean with r = n / (n + tau)."""
    own, whole = mean_vector(frame, [code], vector), mean_vector(frame.withColumn("__one", F.lit(1)), ["__one"], vector)
    r = F.col("n") / (F.col("n") + tau)
    return own.crossJoin(whole.select(F.col("mean").alias("whole"))).select(code, "n", F.zip_with("mean", "whole", lambda a, b: r * a + (1 - r) * b).alias("centroid"))


def fit_spherical(frame: DataFrame, k: int, vector: str = "embedding", id_: str = "vec_id", iterations: int = 8) -> list[tuple[int, list[float]]]:
    """Spherical k-means: seeds by k-means++ over a bounded sample, assignment runs in Arrow, only K means return a round.

    The sample are the SEED_ROWS * k rows of smallest hash (fewer where that passes MOST_CODEBOOK numbers). A code that loses all
    rows takes the row that fits its own code worst.
    """
    data = frame.select(id_, V.unit(F.col(vector)).alias("__v")).where("__v is not null")
    width = len((data.first() or {"__v": [0.0]})["__v"])
    sample = data.orderBy(F.xxhash64(id_), id_).limit(max(k, min(SEED_ROWS * k, MOST_CODEBOOK // max(1, width)))).collect()
    centroids = list(enumerate(spread_seeds(np.array([r["__v"] for r in sample], np.float64), k)))
    for _ in range(iterations if centroids else 0):
        assigned = assign(data, centroids, "__v")
        means = {r["code"]: r["mean"] for r in mean_vector(assigned, ["code"], "__v").collect()}
        empty = [c for c, _ in centroids if c not in means]
        for c, row in zip(empty, assigned.orderBy("score", id_).limit(len(empty)).collect() if empty else [], strict=False):
            means[c] = row["__v"]
        new = [(c, _unit(means.get(c, old))) for c, old in centroids]
        moved = max(float(np.abs(np.subtract(a, b)).max()) for (_, a), (_, b) in zip(new, centroids, strict=True))
        centroids = new
        if moved < 1e-9:
            break
    return centroids


def spread_seeds(rows: np.ndarray, k: int) -> list[list[float]]:
    """k-means++ on unit rows by cosine distance: each next seed is drawn with a chance proportional to its distance from the nearest one."""
    draw = np.random.Generator(np.random.PCG64(len(rows)))
    seeds, near = [], np.full(len(rows), -1.0)
    while len(seeds) < min(k, len(rows)):
        d = np.maximum(0.0, 1.0 - near) if seeds else np.eye(1, len(rows))[0]  # the first row comes first
        at = draw.choice(len(rows), p=d / d.sum()) if d.sum() > 1e-12 else len(seeds)
        seeds.append(rows[at].tolist())
        near = np.maximum(near, rows @ rows[at])
    return seeds


def _unit(v) -> list[float]:
    a = np.asarray(v, np.float64)
    n = np.linalg.norm(a)
    return (a / n if n > 1e-12 else a).tolist()


def residual_codes(frame: DataFrame, levels: int, k: int, vector: str = "embedding", id_: str = "vec_id", iterations: int = 6) -> DataFrame:
    """id, s1..sL: codes of successive spherical codebooks on projection residuals. Each level is a map over rows.

    Each round of a level's fit reads its rows again, so they are written once, to the checkpoint folder."""
    data = frame.select(id_, V.unit(F.col(vector)).alias("__x")).where("__x is not null")
    for level in range(1, levels + 1):
        data = cut(data)
        book = fit_spherical(data, k, "__x", id_, iterations)
        data = encode_level(data, book, "__x", f"s{level}")
    return data.drop("__x")


def encode_level(data: DataFrame, book: list[tuple[int, list[float]]], vector: str, code: str, residual: str = "projection") -> DataFrame:
    """data with its code in one codebook, and the vector replaced by what that leaves: the unit part orthogonal to
    the centroid (`projection`; the vector itself where nothing is left), or the difference (`difference`)."""
    by = "cosine" if residual == "projection" else "euclid"
    data = assign(data, book, vector, by).withColumnRenamed("code", code).drop("score")
    table = data.sparkSession.createDataFrame(book, "__k int, __c array<double>")  # one row a code
    both = data.join(F.broadcast(table), F.col(code) == F.col("__k")).drop("__k")
    left = V.projection_residual(F.col(vector), F.col("__c")) if residual == "projection" else V.subtract(F.col(vector), F.col("__c"))
    return both.withColumn(vector, F.coalesce(left, F.col(vector))).drop("__c")


def soft_update(frame: DataFrame, centroids: list[tuple[int, list[float]]], vector: str, id_: str, top: int, beta: float) -> DataFrame:
    """By code: unit sum of rows weighted by the softmax of beta * cosine over each row's best `top` codes (ties by code)."""
    shared = _book(frame.sparkSession, centroids)

    @F.pandas_udf("array<struct<code:int,weight:double>>")
    def shares(v: pd.Series) -> pd.Series:
        codes, m = shared.value
        if not len(v):
            return pd.Series([], dtype=object)
        x = np.stack(v.to_numpy()).astype(np.float64)
        sim = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T
        best = np.argsort(-sim, axis=1, kind="stable")[:, :top]
        e = np.exp(beta * (np.take_along_axis(sim, best, 1) - sim.max(1, keepdims=True)))
        e /= e.sum(1, keepdims=True)
        return pd.Series([[{"code": int(codes[j]), "weight": float(w)} for j, w in zip(b, r, strict=True)] for b, r in zip(best, e, strict=True)])

    both = frame.select(id_, F.col(vector).alias("x"), F.explode(shares(F.col(vector))).alias("s")).select(id_, "x", "s.code", "s.weight")
    return weighted_mean(both, ["code"], "x", "weight").select("code", F.col("vector").alias("centroid"), F.col("weight_sum").alias("mass"))


def category_costs(rows: DataFrame, code: str, category: str, smoothing: float) -> DataFrame:
    """code, category, cost: -ln of the smoothed share of a category in a code over ln(categories); all pairs of both."""
    n = rows.groupBy(code, category).agg(F.count(F.lit(1)).alias("n"))
    prior = n.groupBy(category).agg(F.sum("n").alias("c")).withColumn("prior", F.col("c") / F.sum("c").over(Window.partitionBy()))
    totals = n.groupBy(code).agg(F.sum("n").alias("t"))
    grid = totals.crossJoin(prior)  # codes by categories, both declared vocabularies
    k = rows.select(category).distinct().count()
    p = (F.coalesce("n", F.lit(0)) + smoothing * F.col("prior")) / (F.col("t") + smoothing)
    return grid.join(n, [code, category], "left").select(code, category, (-F.log(p) / np.log(max(2, k))).alias("cost"))


def graph_votes(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """node, code, penalty: the node's total edge weight less that of neighbours with the code."""
    votes = edges.join(labels, "neighbor").groupBy("node", "code").agg(F.sum("weight").alias("w"))
    return votes.withColumn("penalty", F.sum("w").over(Window.partitionBy("node")) - F.col("w"))
