"""Group-local solvers that have no relational form; groups are buckets of a bounded identifier space."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def entropy_bits(values, weights) -> float:
    total = float(sum(weights))
    by: dict = defaultdict(float)
    for v, w in zip(values, weights, strict=True):
        by[v] += float(w)
    return -sum(w / total * math.log2(w / total) for w in by.values() if w > 0) if total > 0 else 0.0


def split_bucket(matrix: np.ndarray, weights: np.ndarray, prior: np.ndarray) -> list[list[tuple[int, int]]]:
    """Path of (relation, value) of each row: each node takes the relation with the most weighted entropy times
    coverage times predictability (the lowest index of equals); rows without its value stay below without a step."""
    paths: list[list[tuple[int, int]]] = [[] for _ in matrix]
    todo = [(list(range(len(matrix))), frozenset())]
    while todo:
        rows, used = todo.pop()
        if len(rows) < 2:
            continue
        best, top = None, 1e-12
        w = weights[rows].sum()
        for r in range(matrix.shape[1]):
            if r in used:
                continue
            have = [i for i in rows if matrix[i, r] >= 0]
            if len({int(matrix[i, r]) for i in have} | ({-1} if len(have) < len(rows) else set())) < 2 or not have:
                continue
            score = entropy_bits([int(matrix[i, r]) for i in rows], weights[rows]) * float(weights[have].sum() / w) * float(prior[r])
            if score > top:
                best, top = r, score
        if best is None:
            continue
        by: dict[int, list[int]] = defaultdict(list)
        for i in rows:
            by[int(matrix[i, best])].append(i)
        for value, inside in by.items():
            if value >= 0:
                for i in inside:
                    paths[i].append((best, value))
            todo.append((inside, used | {best}))
    return paths


def compile_buckets(rows: DataFrame, bucket: str, id_: str, relations: list[str], weight: str, prior: dict[str, float] | None = None) -> DataFrame:
    """bucket, id, path, resolved: greedy relation trees by bucket; resolved rows have a path of their own."""
    p = np.array([(prior or {}).get(r, 1.0) for r in relations])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_)
        paths = split_bucket(pdf[relations].to_numpy(), pdf[weight].to_numpy(float) + 1.0, p)
        text = ["/".join(f"{relations[r]}={v}" for r, v in path) for path in paths]
        n = Counter(text)
        return pd.DataFrame({bucket: pdf[bucket], id_: pdf[id_], "path": text, "resolved": [n[t] == 1 for t in text]})

    kind = dict(rows.dtypes)
    return rows.select(bucket, id_, *relations, weight).groupBy(bucket).applyInPandas(solve, f"{bucket} {kind[bucket]}, {id_} {kind[id_]}, path string, resolved boolean")


def shortest_descriptions(rows: DataFrame, bucket: str, id_: str, relations: list[str], most: int = 3) -> DataFrame:
    """bucket, id, description: the fewest relations (first in order of equals) whose values single a row out."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf[relations].to_numpy()
        out = [""] * len(m)
        left = set(range(len(m)))
        for size in range(1, most + 1):
            for combo in combinations(range(len(relations)), size):
                if not left:
                    break
                seen = Counter(tuple(r) for r in m[:, combo])
                for i in sorted(left):
                    key = tuple(m[i, combo])
                    if min(key) >= 0 and seen[key] == 1:
                        out[i] = "/".join(f"{relations[r]}={v}" for r, v in zip(combo, key, strict=True))
                        left.discard(i)
        return pd.DataFrame({bucket: pdf[bucket], id_: pdf[id_], "description": out})

    kind = dict(rows.dtypes)
    return rows.select(bucket, id_, *relations).groupBy(bucket).applyInPandas(solve, f"{bucket} {kind[bucket]}, {id_} {kind[id_]}, description string")


def hungarian(cost: np.ndarray, most: int = 1) -> list[int]:
    """Column of each row in a cheapest assignment that takes no column more than `most` times (rows <= columns * most).

    Shortest augmenting paths over the columns that are full: a path leads to a free column, and each full one on it passes on the
    row that is cheapest to move. Full columns stand first; move[f, j] is the price of moving a row from f to j, mover its row."""
    n, m = cost.shape
    if n > m * most:
        raise ValueError("more rows than columns can take")
    cost = np.array(cost, float)
    slack = 1e-13 * max(1.0, float(np.abs(cost).max(initial=0)))
    column, full, rows = np.arange(m), 0, [[] for _ in range(m)]
    move, mover = np.zeros((min(m, n // most), m)), np.zeros((min(m, n // most), m), int)
    for i in range(n):
        low, back, new = cost[i, :full].copy(), np.full(full, -1), np.arange(full)
        while len(new):  # low: the least price of a place in each full column
            price = low[new, None] + move[new, :full]
            at = price.argmin(0)
            price = price[at, np.arange(full)]
            better = np.flatnonzero(price < low - slack)
            low[better], back[better], new = price[better], new[at[better]], better
        end, f = full + int(cost[i, full:].argmin()), -1
        if full:
            price = low[:, None] + move[:full, full:]
            a, b = divmod(int(price.argmin()), m - full)
            if price[a, b] < cost[i, end] - slack:
                f, end = a, full + b
        changed, to = [], end
        while f >= 0:
            rows[f].remove(mover[f, to])
            rows[to].append(int(mover[f, to]))
            changed.append(f)
            to, f = f, back[f]
        rows[to].append(i)
        if len(rows[end]) == most:
            for x in (cost, move, mover):
                x[:, [end, full]] = x[:, [full, end]]
            rows[end], rows[full] = rows[full], rows[end]
            column[[end, full]] = column[[full, end]]
            changed.append(full)
            full += 1
        for f in changed:
            price = cost[rows[f]] - cost[rows[f], f][:, None]
            at = price.argmin(0)
            move[f], mover[f] = price[at, np.arange(m)], np.array(rows[f])[at]
    out = np.zeros(n, int)
    for c, inside in zip(column, rows, strict=True):
        out[inside] = c
    return out.tolist()


def unique_pairs(rows: DataFrame, bucket: str, id_: str, vector: str, prototypes: list[list[float]]) -> DataFrame:
    """bucket, id, code, cost: codes without repeats in a bucket at the least summed squared distance; the nearest
    ones where they are unique already.

    A code is its prototype's number plus the number of prototypes times a layer. A bucket has as few layers as hold its rows: one
    (the code is the prototype) if there are as many prototypes as rows. Rows of one prototype lie in its layers by id."""
    p = np.array(prototypes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_)
        x = np.stack(pdf[vector].to_numpy())
        d = np.maximum((x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1), 0)
        nearest = d.argmin(1)
        if len(set(nearest.tolist())) < len(nearest):
            nearest = np.array(hungarian(d, -(-len(d) // len(p))))
        layer = pd.Series(nearest).groupby(nearest).cumcount().to_numpy()
        code = (nearest + len(p) * layer).astype("int32")
        return pd.DataFrame({bucket: pdf[bucket], id_: pdf[id_], "code": code, "cost": d[np.arange(len(d)), nearest]})

    kind = dict(rows.dtypes)
    dealt = rows.select(bucket, id_, vector).repartition(rows.sparkSession.sparkContext.defaultParallelism, bucket)  # few bytes, much work: not to be coalesced
    return dealt.groupBy(bucket).applyInPandas(solve, f"{bucket} {kind[bucket]}, {id_} {kind[id_]}, code int, cost double")
