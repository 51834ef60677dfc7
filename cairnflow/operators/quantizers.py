"""Codebooks fitted on two views at once: content with a query view, and entities with queries over a graph.

A codebook has a declared, bounded number of codes and is held by the driver as rows (code, vector); assignment is a map over
rows with the codebook sent once. Whatever grows with the data (votes over edges, sums of vectors) is a join or an
aggregate. Every round of a fit writes its labels to the checkpoint folder.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.functions import vector as V
from cairnflow.operators.vectors import MOST_CODEBOOK, mean_vector
from cairnflow.sources.scratch import cut

Book = list[tuple[int, list[float]]]


def _arrays(book: Book) -> tuple[np.ndarray, np.ndarray]:
    codes, matrix = np.array([c for c, _ in book]), np.array([v for _, v in book], np.float64)
    if matrix.size > MOST_CODEBOOK:
        raise ValueError(f"a codebook of {matrix.shape} numbers is no codebook: cluster the centroids first")
    return codes, matrix


def _squared(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(1)[:, None] - 2 * x @ m.T + (m * m).sum(1))


def assign_dual(frame: DataFrame, content: str, query: str, content_book: Book, query_book: Book, weight: float, reference: str | None = None, top: int | None = None) -> DataFrame:
    """frame with code, content_distance and query_distance: the code with the least ||c - mu||^2 + weight * ||q - nu||^2.

    Rows without a query view (null) go by content alone and have query distance 0. With reference and top, rows without a query
    view keep their reference code, and the others choose among the top nearest codes by content and their reference. Ties go to
    the smaller code."""
    codes, cm = _arrays(content_book)
    _, qm = _arrays(query_book)
    shared = frame.sparkSession.sparkContext.broadcast((codes, cm, qm))

    @F.pandas_udf("struct<code:int,content_distance:double,query_distance:double>")
    def nearest(c: pd.Series, q: pd.Series, ref: pd.Series) -> pd.DataFrame:
        codes, cm, qm = shared.value
        if not len(c):
            return pd.DataFrame({"code": [], "content_distance": [], "query_distance": []})
        dc = _squared(np.stack(c.to_numpy()).astype(np.float64), cm)
        dq = np.zeros_like(dc)
        covered = np.array([v is not None for v in q])
        if covered.any():
            dq[covered] = _squared(np.stack(q.to_numpy()[covered]).astype(np.float64), qm)
        objective = dc + weight * dq
        if reference is not None:
            own = np.searchsorted(codes, ref.to_numpy())
            rows = np.arange(len(dc))
            allowed = np.zeros(dc.shape, bool)
            np.put_along_axis(allowed, np.argsort(dc, 1, kind="stable")[:, :top], True, 1)
            allowed[~covered] = False
            allowed[rows, own] = True
            objective = np.where(allowed, objective, np.inf)
        at = objective.argmin(1)
        rows = np.arange(len(dc))
        return pd.DataFrame({"code": codes[at], "content_distance": dc[rows, at], "query_distance": dq[rows, at]})

    ref = F.col(reference) if reference is not None else F.lit(0)
    return frame.withColumn("__a", nearest(content, query, ref)).select(*frame.columns, "__a.code", "__a.content_distance", "__a.query_distance")


def update_dual(rows: DataFrame, code: str, content: str, query: str, content_book: Book, query_book: Book) -> tuple[Book, Book]:
    """Means of the rows of each code, of the covered rows for the query view; a code without rows keeps its vector."""
    out = []
    for column, book in ((content, content_book), (query, query_book)):
        means = {r[code]: list(r["mean"]) for r in mean_vector(rows, [code], column).collect()}  # one row a code
        out.append([(c, means.get(c, old)) for c, old in book])
    return out[0], out[1]


def fit_dual(
    frame: DataFrame,
    content: str,
    query: str,
    content_book: Book,
    query_book: Book,
    weight: float,
    iterations: int = 20,
    tolerance: float = 1e-9,
) -> tuple[Book, Book, list[dict]]:
    """Lloyd rounds of assign_dual() and update_dual() until the objective no longer falls; the trace has one entry a round."""
    trace: list[dict] = []
    for i in range(1, iterations + 1):
        rows = cut(assign_dual(frame, content, query, content_book, query_book, weight))
        total = rows.agg(F.sum(F.col("content_distance") + weight * F.col("query_distance")).alias("o"), F.count_distinct("code").alias("k")).collect()[0]
        trace.append({"iteration": i, "objective": total["o"], "active": total["k"]})
        content_book, query_book = update_dual(rows, "code", content, query, content_book, query_book)
        if i > 1 and trace[-2]["objective"] - trace[-1]["objective"] <= tolerance * max(1.0, abs(trace[-2]["objective"])):
            break
    return content_book, query_book, trace


def warmup_weights(iteration: int, query: float, graph: float, category: float, flat: int = 2, ramp_end: int = 6) -> tuple[float, float, float]:
    """Weights of a round: half of query and graph and no category while flat, then linearly up to the whole at ramp_end."""
    if iteration < 1 or not 0 <= flat < ramp_end:
        raise ValueError("rounds count from 1 and the ramp ends after the flat part")
    share = 0.0 if iteration <= flat else min(1.0, (iteration - flat) / (ramp_end - flat))
    return (0.5 + 0.5 * share) * query, (0.5 + 0.5 * share) * graph, share * category


def votes(edges: DataFrame, labels: DataFrame, node: str, neighbour: str) -> DataFrame:
    """node, vote (map from code to the weight of neighbours with that code), total weight. labels: neighbour, code."""
    per = edges.join(labels, neighbour).groupBy(node, "code").agg(F.sum("weight").alias("w"))
    return per.groupBy(node).agg(F.map_from_entries(F.collect_list(F.struct("code", "w"))).alias("vote"), F.sum("w").alias("total"))


def assign_coupled(
    frame: DataFrame,
    id_: str,
    vector: str,
    book: Book,
    voted: DataFrame,
    content_weight: float,
    graph_weight: float,
    category: str | None = None,
    costs: DataFrame | None = None,
    category_weight: float = 0.0,
) -> DataFrame:
    """frame with code and distance: least content_weight * (1 - cosine) + graph_weight * (votes for other codes) + category_weight *
    cost of the row's category in the code; ties go to the smaller code.

    voted: id, vote, total of votes(); costs: category, code, cost with a row for every code."""
    codes, matrix = _arrays(book)
    shared = frame.sparkSession.sparkContext.broadcast((codes, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)))
    rows = frame.join(voted.select(id_, "vote", "total"), id_, "left")
    if costs is not None:
        table = costs.groupBy(category).agg(F.map_from_entries(F.collect_list(F.struct("code", "cost"))).alias("cost"))
        rows = rows.join(table, category, "left")
    else:
        rows = rows.withColumn("cost", F.lit(None).cast("map<int,double>"))

    @F.pandas_udf("struct<code:int,distance:double>")
    def best(v: pd.Series, vote: pd.Series, total: pd.Series, cost: pd.Series) -> pd.DataFrame:
        codes, m = shared.value
        if not len(v):
            return pd.DataFrame({"code": [], "distance": []})
        x = np.stack(v.to_numpy()).astype(np.float64)
        content = 1.0 - (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)) @ m.T
        objective = content_weight * content
        place = {int(c): i for i, c in enumerate(codes)}
        for extra, weight, sign in ((vote, graph_weight, -1.0), (cost, category_weight, 1.0)):
            for i, pairs in enumerate(extra):
                for e in pairs if pairs is not None else ():
                    objective[i, place[e["key"]]] += sign * weight * e["value"]
        objective += graph_weight * np.nan_to_num(total.to_numpy(dtype=float))[:, None]
        at = np.argmin(np.round(objective, 12), 1)
        return pd.DataFrame({"code": codes[at], "distance": content[np.arange(len(x)), at]})

    entries = lambda c: F.map_entries(F.col(c))
    return rows.withColumn("__a", best(vector, entries("vote"), F.col("total"), entries("cost"))).select(*frame.columns, "__a.code", "__a.distance")


def shrunk_to(rows: DataFrame, code: str, vector: str, book: Book, tau: float) -> Book:
    """Unit of (sum of a code's rows + tau * its vector in book) over (n + tau); a code without rows keeps the book's."""
    found = {r[code]: (r["n"], np.array(r["mean"])) for r in mean_vector(rows, [code], vector).collect()}  # one row a code
    out = []
    for c, own in book:
        n, mean = found.get(c, (0, np.zeros(len(own))))
        v = (n * mean + tau * np.array(own)) / (n + tau)
        out.append((c, (v / max(np.linalg.norm(v), 1e-12)).tolist()))
    return out


def spherical_means(rows: DataFrame, code: str, vector: str, book: Book) -> Book:
    """Unit mean of each code's rows; a code without rows takes the row that lies farthest from its own (smallest id of equals)."""
    found = {r[code]: np.array(r["mean"]) for r in mean_vector(rows, [code], vector).collect()}  # one row a code
    empty = [c for c, _ in book if c not in found]
    for c, r in zip(empty, rows.orderBy(F.desc("distance"), rows.columns[0]).limit(len(empty)).collect() if empty else [], strict=False):
        found[c] = np.array(r[vector])
    unit = lambda v: (v / max(np.linalg.norm(v), 1e-12)).tolist()
    return [(c, unit(found.get(c, np.array(old)))) for c, old in book]


def smoothed_costs(rows: DataFrame, code: str, category: str, codes: list[int], smoothing: float, parent: str | None = None) -> DataFrame:
    """category, code, cost: minus the logarithm of a category's smoothed share in a code, over ln(categories).

    The prior is the category's share of all rows; with parent, of the rows of the same parent (and cost has a parent column)."""
    up = [parent] if parent else []
    n = rows.groupBy(*up, category, code).agg(F.count(F.lit(1)).alias("n"))
    totals = n.groupBy(*up, code).agg(F.sum("n").alias("t"))
    own = n.groupBy(*up, category).agg(F.sum("n").alias("c"))
    whole = n.groupBy(*up).agg(F.sum("n").alias("all")) if up else n.agg(F.sum("n").alias("all"))
    own = own.join(whole, up) if up else own.crossJoin(whole)
    count = max(2, rows.select(category).distinct().count())
    grid = own.withColumn(code, F.explode(F.array(*[F.lit(c) for c in codes])))
    both = grid.join(n, [*up, category, code], "left").join(totals, [*up, code], "left")
    p = (F.coalesce("n", F.lit(0)) + smoothing * F.col("c") / F.col("all")) / (F.coalesce("t", F.lit(0)) + smoothing)
    return both.select(*up, category, F.col(code).alias("code"), (-F.log(F.greatest(p, F.lit(1e-12))) / np.log(count)).alias("cost"))


def agreement(edges: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """One row: edges, their weight, and the weighted and plain shares of edges whose ends have one code."""
    both = edges.join(left.select(left_id, F.col("code").alias("a")), left_id).join(right.select(right_id, F.col("code").alias("b")), right_id)
    same = F.col("a") == F.col("b")
    share = F.coalesce(F.sum(F.when(same, F.col("weight")).otherwise(0.0)) / F.sum("weight"), F.lit(0.0))
    return both.agg(
        F.count(F.lit(1)).alias("edge_rows"),
        F.sum("weight").alias("edge_weight_sum"),
        share.alias("weighted_agreement"),
        (1 - share).alias("weighted_disagreement"),
        F.avg(same.cast("double")).alias("unweighted_agreement"),
    )


@dataclass(frozen=True)
class Coupling:
    """How strongly queries, the graph and categories count, and when a fit ends."""

    query: float = 0.2
    graph: float = 0.1
    category: float = 0.05
    smoothing: float = 5.0
    shrinkage: float = 8.0
    flat: int = 2
    ramp_end: int = 6
    least: int = 3
    most: int = 12
    tolerance: float = 1e-4
    patience: int = 2
    refine: int = 0
    top: int = 4
    beta: float = 20.0


def fit_coupled(pois: DataFrame, queries: DataFrame, edges: DataFrame, book: Book, rule: Coupling = Coupling()) -> tuple[DataFrame, DataFrame, Book, Book, list[dict]]:
    """Alternating fit of one level. pois: poi, x, category, code (the start); queries: query, x; edges: poi, query, weight.

    A round assigns entities (content, graph, categories), then queries (content, graph), then takes entity means and shrinks query
    means towards them. It ends when the objective has risen thrice in a row after warm-up (an error), or improved by less
    than the tolerance for `patience` rounds. Returns labelled entities and queries, both codebooks and the trace."""
    codes = [c for c, _ in book]
    poi_book, query_book = book, book
    entity = cut(pois)
    start = warmup_weights(1, rule.query, rule.graph, rule.category, rule.flat, rule.ramp_end)
    labels = lambda f, i: f.select(i, "code")
    voted = votes(edges, labels(entity, "poi"), "query", "poi")
    asked = cut(assign_coupled(queries, "query", "x", query_book, voted, start[0], start[1]))
    query_book = shrunk_to(asked, "code", "x", poi_book, rule.shrinkage)
    trace: list[dict] = []
    rises = still = 0
    for i in range(1, rule.most + 1):
        qw, gw, cw = warmup_weights(i, rule.query, rule.graph, rule.category, rule.flat, rule.ramp_end)
        costs = smoothed_costs(entity, "code", "category", codes, rule.smoothing)
        voted = votes(edges, labels(asked, "query"), "poi", "query")
        before, entity = entity, cut(assign_coupled(entity.select("poi", "x", "category"), "poi", "x", poi_book, voted, 1.0, gw, "category", costs, cw))
        voted = votes(edges, labels(entity, "poi"), "query", "poi")
        asked = cut(assign_coupled(queries, "query", "x", query_book, voted, qw, gw))
        poi_book = spherical_means(entity, "code", "x", poi_book)
        query_book = shrunk_to(asked, "code", "x", poi_book, rule.shrinkage)
        graph = agreement(edges, entity, asked, "poi", "query").collect()[0]
        paid = entity.join(costs, ["category", "code"]).agg(F.sum("cost")).collect()[0][0] or 0.0
        moved = entity.join(before.select("poi", F.col("code").alias("old")), "poi").agg(F.avg((F.col("code") != F.col("old")).cast("double"))).collect()[0][0]
        objective = entity.agg(F.sum("distance")).collect()[0][0] + qw * (asked.agg(F.sum("distance")).collect()[0][0] or 0.0) + gw * graph["weighted_disagreement"] * (graph["edge_weight_sum"] or 0.0) + cw * paid
        gain = None if not trace else (trace[-1]["objective"] - objective) / max(abs(trace[-1]["objective"]), 1e-12)
        trace.append({"iteration": i, "objective": objective, "improvement": gain, "poi_change": moved, "disagreement": graph["weighted_disagreement"]})
        if gain is not None:
            rises = rises + 1 if i > rule.ramp_end and gain < -rule.tolerance else 0
            if rises >= 3:
                raise RuntimeError("the objective rose three rounds in a row after warm-up")
            still = still + 1 if i >= rule.least and 0 <= gain < rule.tolerance else 0
        if i >= rule.least and still >= rule.patience:
            break
    return entity, asked, poi_book, query_book, trace


def nearest_children(rows: DataFrame, vector: str, parents: list[str], child: str, book: Book, known: DataFrame) -> DataFrame:
    """rows with `predicted`: of the child codes seen under the row's parents (known: parents, child), the one nearest by cosine.

    Null where the parents were never seen; ties go to the smaller code."""
    seen = known.groupBy(*parents).agg(F.array_sort(F.collect_set(child)).alias("__children"))
    both = rows.join(seen, parents, "left")
    codes, matrix = _arrays(book)
    shared = rows.sparkSession.sparkContext.broadcast((codes, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)))

    @F.pandas_udf("int")
    def best(v: pd.Series, children: pd.Series) -> pd.Series:
        codes, m = shared.value
        out = []
        for x, c in zip(v, children, strict=True):
            if c is None or not len(c):
                out.append(None)
                continue
            at = np.searchsorted(codes, np.asarray(c))
            out.append(int(codes[at[int(np.argmax(m[at] @ np.asarray(x, np.float64)))]]))
        return pd.Series(out, dtype="Int32")

    return both.withColumn("predicted", best(vector, "__children")).drop("__children")


def bucket_centred(rows: DataFrame, bucket: list[str], vector: str, extra: str, weight: float) -> DataFrame:
    """rows with `feature`: the unit vector less its bucket's mean (0s where nothing is left), then weight * extra (an array)."""
    means = mean_vector(rows, bucket, vector).select(*bucket, "mean")
    moved = V.subtract(F.col(vector), F.col("mean"))
    flat = F.transform(F.col(vector), lambda x: F.lit(0.0))
    feature = F.concat(F.coalesce(V.unit(moved), flat), F.transform(F.col(extra), lambda x: x * weight))
    return rows.join(means, bucket).withColumn("feature", feature).drop("mean")


def codeword_features(rows: DataFrame, levels: list[tuple[str, DataFrame]], id_: str) -> DataFrame:
    """id, feature: the unit codeword of each level side by side, over the root of the number of levels. Books: code, v."""
    out, parts = rows.select(id_, *[c for c, _ in levels]), []
    for column, book in levels:
        out = out.join(F.broadcast(book.select(F.col("code").alias(column), V.unit(F.col("v")).alias(f"__{column}"))), column)  # one row a code
        parts.append((F.col(f"__{column}"), 1.0))
    return out.select(id_, V.blocks(parts).alias("feature"))


def reference_points(points: DataFrame, k: int, seed: int = 42, iterations: int = 100) -> list[tuple[float, float]]:
    """k anchors (lng, lat), sorted: k-means on metres of a local projection, by the built-in parallel k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    lng, lat = points.agg(F.avg("lng"), F.avg("lat")).collect()[0]
    fx, fy = 111_320.0 * float(np.cos(np.radians(lat))), 110_540.0
    projected = points.select(array_to_vector(F.array((F.col("lng") - lng) * fx, (F.col("lat") - lat) * fy)).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=iterations).fit(projected)
    return sorted((float(c[0] / fx + lng), float(c[1] / fy + lat)) for c in model.clusterCenters())
