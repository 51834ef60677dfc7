"""Hard negatives and neighbour graphs: joins inside blocks, a score, the best k a row, merges by priority."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnflow.functions import geo, text
from cairnflow.operators.vectors import blocks
from cairnflow.sources.scratch import cut

#: (asking rows, asked rows) -> matrix of their scores.
Score = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


def top_per(pairs: DataFrame, row: str, order: list[Column], k: int) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(row).orderBy(*order))).where(F.col("rank") <= k)


#: What decides a row's scores: rows that agree in it are of one class.
_CONTENT = ["name", "address", "code", "category"]


def _contents(frame: DataFrame) -> DataFrame:
    """id and content of lexical_topk's rows; columns that are missing are null. Rows without an id are in no pair."""
    have = lambda c: F.col(c).cast("string") if c in frame.columns else F.lit(None).cast("string")
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(have(c), F.lit(""))), r"\s", "").alias(c)
    return frame.select(F.col("id").cast("long").alias("id"), plain("name"), plain("address"), have("code").alias("code"), have("category").alias("category")).where("id is not null")


def _sides(classes: DataFrame, *more: str) -> DataFrame:
    """Hashed name and address n-grams, code and category of classes, and more of their columns."""
    grams = lambda c: F.transform(text.character_ngrams(F.col(c)), lambda g: F.xxhash64(g))
    return classes.select(*more, grams("name").alias("n"), grams("address").alias("a"), F.col("code").alias("c"), F.col("category").alias("g"))


class _Postings:
    """n-gram sets of a block of targets as an inverted list in arrays; overlap() counts shared n-grams with other sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([*sets, np.empty(0, np.int64)])
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.size)[order]
        self.keys, self.start = np.unique(flat[order], return_index=True)
        self.count = np.diff(np.append(self.start, len(flat)))

    def overlap(self, sets: list[np.ndarray]) -> np.ndarray:
        """Similarity (Jaccard; 0 for two empty sets) of each of sets to each target."""
        size = np.array([len(s) for s in sets], np.int64)
        flat, row = np.concatenate([*sets, np.empty(0, np.int64)]), np.repeat(np.arange(len(sets)), size)
        if not len(flat) or not len(self.keys):
            return np.zeros((len(sets), len(self.size)))
        at = np.minimum(np.searchsorted(self.keys, flat), len(self.keys) - 1)
        known = self.keys[at] == flat
        at, row = at[known], row[known]
        n = self.count[at]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        target = self.owner[np.repeat(self.start[at], n) + within]
        both = np.bincount(np.repeat(row, n) * len(self.size) + target, minlength=len(sets) * len(self.size)).astype(float)
        both = both.reshape(len(sets), len(self.size))
        return both / np.maximum(1.0, size[:, None] + self.size[None, :] - both)


#: A candidate of a block's t-th target with its four scores.
_SCORED = np.dtype([("t", np.int64), ("candidate", np.int64), ("name_score", float), ("same_code", np.int32), ("same_category", np.int32), ("address_score", float)])


def _same(block: pd.Series, rows: pd.Series) -> np.ndarray:
    number = pd.factorize(np.concatenate([block.to_numpy(dtype=object), rows.to_numpy(dtype=object)]))[0]
    b, r = number[: len(block)], number[len(block) :, None]
    return ((r == b) & (r >= 0)).astype(float)


def _first(rows: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Places of the best rows (_SCORED) of each target, in order, at most as many as most has for it."""
    order = np.lexsort((rows["candidate"], *[-rows[c] for c in reversed(_SCORED.names[2:])], rows["t"]))
    t = rows["t"][order]
    return order[np.arange(len(t)) - np.searchsorted(t, t) < most[t]]


def lexical_topk(targets: DataFrame, catalog: DataFrame, k: int, forbidden: DataFrame | None = None, block_rows: int = 1024) -> DataFrame:
    """target, candidate, name_score, same_code, same_category, address_score, rank: the best k by those four, then by id.

    Both sides: id (a whole number), name, and where there are such, code, category, address. Names and addresses are compared by
    their character bigrams (Jaccard). Candidates with nothing in common are dropped, as are a target itself and the pairs of
    forbidden (target, candidate). Rows of equal content score alike, so classes of content meet, not rows: a class of targets
    wants the best k and as many more as one of its targets may not take, and of a class of candidates as many smallest ids can be
    wanted. Classes of targets are broadcast in blocks; a task counts shared n-grams of its classes by the block's inverted lists
    and keeps that many rows a class of targets, so no pair is shuffled but the best ones."""
    spark = targets.sparkSession
    asking, asked = _contents(targets), _contents(catalog)
    banned = asking.select(F.col("id").alias("target"), F.col("id").alias("candidate"))
    if forbidden is not None:
        pairs = forbidden.select(F.col("target").cast("long").alias("target"), F.col("candidate").cast("long").alias("candidate"))
        banned = banned.unionByName(pairs.join(asking.select(F.col("id").alias("target")), "target", "left_semi"))
    banned = banned.distinct()
    lost = banned.join(asked.select(F.col("id").alias("candidate")), "candidate").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("lost"))
    per = asking.join(lost, "id", "left").groupBy(*_CONTENT).agg((F.coalesce(F.max("lost"), F.lit(0)) + k).alias("most"))
    wanted = cut(per.withColumn("t", F.monotonically_increasing_id()))
    schema = "t long, candidate long, name_score double, same_code int, same_category int, address_score double"
    most = wanted.agg(F.max("most")).first()[0]
    if most is None:
        return spark.createDataFrame([], schema.replace("t long", "target long") + ", rank int")
    smallest = asked.withColumn("rank", F.row_number().over(Window.partitionBy(*_CONTENT).orderBy("id"))).where(F.col("rank") <= most)
    members = smallest.groupBy(*_CONTENT).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    rows = cut(_sides(members.repartition(spark.sparkContext.defaultParallelism, *_CONTENT), "ids"))
    out = None
    for part in blocks(_sides(wanted, "t", "most"), block_rows):
        shared = spark.sparkContext.broadcast(pd.DataFrame([r.asDict() for r in part]))

        def best(frames, shared=shared):
            block = shared.value
            most = block["most"].to_numpy(np.int64)
            arrays = lambda column: [np.array(x if x is not None else [], np.int64) for x in column]
            name, address = _Postings(arrays(block["n"])), _Postings(arrays(block["a"]))
            kept = np.empty(0, _SCORED)
            floor = np.zeros(len(block))
            step = max(1, 500_000 // len(block))
            for frame in frames:
                for at in range(0, len(frame), step):
                    tile = frame.iloc[at : at + step]
                    ids = arrays(tile["ids"])
                    smallest, members = np.array([x[0] for x in ids]), np.array([len(x) for x in ids])
                    score = name.overlap(arrays(tile["n"]))
                    code, cat = _same(block["c"], tile["c"]), _same(block["g"], tile["g"])
                    near = address.overlap(arrays(tile["a"]))
                    r, t = np.nonzero((score >= floor) & ((score > 0) | (code > 0) | (cat > 0) | (near > 0)))
                    more = np.empty(len(r), _SCORED)
                    for field, values in zip(_SCORED.names, (t, smallest[r], score[r, t], code[r, t], cat[r, t], near[r, t]), strict=True):
                        more[field] = values
                    first = _first(more, most)  # no member of another class is among the best rows
                    if not len(first):
                        continue
                    r = r[first]
                    more = np.repeat(more[first], members[r])
                    more["candidate"] = np.concatenate([ids[i] for i in r])
                    kept = np.concatenate([kept, more])
                    kept = kept[_first(kept, most)]
                    rank = np.arange(len(kept)) - np.searchsorted(kept["t"], kept["t"])
                    last = rank == most[kept["t"]] - 1
                    floor[kept["t"][last]] = kept["name_score"][last]
            if len(kept):
                yield pd.DataFrame({"t": block["t"].to_numpy(np.int64)[kept["t"]]} | {c: kept[c] for c in _SCORED.names[1:]})

        found = rows.mapInPandas(best, schema)
        out = found if out is None else out.unionByName(found)
    order = [F.desc("name_score"), F.desc("same_code"), F.desc("same_category"), F.desc("address_score"), F.col("candidate")]
    found = top_per(out, "t", order, most).drop("rank").join(wanted.select("t", *_CONTENT), "t").drop("t")
    both = reduce(Column.__and__, [asking[c].eqNullSafe(found[c]) for c in _CONTENT])
    met = asking.join(found, both).select(F.col("id").alias("target"), "candidate", *[found[c] for c in _SCORED.names[2:]])
    return top_per(met.join(banned, ["target", "candidate"], "left_anti"), "target", order, k)


def geo_topk(points: DataFrame, k: int, same: tuple[str, ...] = ()) -> DataFrame:
    """id, other, metres, rank: the k nearest of all points; with `same`, points that agree in those columns come first.

    points: id, lng, lat. Points meet in cells and the eight around them. The first cells are sized so that one holds about k
    points on average; who has found k within the distance that its cells are sure to cover is done, the others go on
    with cells twice as wide, until the cells cover everything. With `same` that is done for every set of these columns."""
    some = [list(c) for n in range(len(same) + 1) for c in combinations(same, n)]
    found = reduce(DataFrame.unionByName, [_nearest(points, points, k, c) for c in some]).distinct()
    order = [F.col("metres"), F.col("other")]
    if same:  # the k nearest of every level of agreement are among them
        for i in ("id", "other"):
            found = found.join(points.select(F.col("id").alias(i), *[F.col(c).alias(f"{c}_{i}") for c in same]), i)
        order = [F.desc(F.coalesce((F.col(f"{c}_id") == F.col(f"{c}_other")).cast("int"), F.lit(0))) for c in same] + order
    return top_per(found, "id", order, k).select("id", "other", "metres", "rank")


def _nearest(rows: DataFrame, points: DataFrame, k: int, within: list[str]) -> DataFrame:
    """id, other, metres: for each of rows its k nearest points (with ties by id) among those that agree in `within`."""
    n, low_x, high_x, low_y, high_y = points.agg(F.count(F.lit(1)), F.min("lng"), F.max("lng"), F.min("lat"), F.max("lat")).collect()[0]
    schema = "id long, other long, metres double"
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    whole = max(high_x - low_x, high_y - low_y, 1e-6)
    size = max(whole / 4096, (max(high_x - low_x, 1e-6) * max(high_y - low_y, 1e-6) * k / n) ** 0.5)
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    rest, out = rows.select("id", "lng", "lat", *within), None
    while True:
        cell = lambda f, s=size: f.withColumn("bx", F.floor(F.col("lng") / s)).withColumn("by", F.floor(F.col("lat") / s))
        spread = cell(rest).withColumn("o", F.explode(around)).withColumn("bx", F.col("bx") + F.col("o.dx")).withColumn("by", F.col("by") + F.col("o.dy"))
        other = cell(points).select(F.col("id").alias("other"), F.col("lng").alias("lng2"), F.col("lat").alias("lat2"), "bx", "by", *within)
        met = spread.join(other, ["bx", "by", *within]).where("id != other")
        metres = geo.haversine(F.col("lng"), F.col("lat"), F.col("lng2"), F.col("lat2"))
        # within one cell's width everything has been met; a degree of longitude shrinks towards the poles
        sure = 110_000.0 * size * F.cos(F.radians(F.least(F.lit(89.0), F.abs("lat") + 2 * size)))
        best = top_per(
            met.select(F.col("id").cast("long").alias("id"), F.col("other").cast("long").alias("other"), metres.alias("metres"), (metres <= sure).alias("sure")),
            "id",
            [F.col("metres"), F.col("other")],
            k,
        )
        best = cut(best)
        last = size >= whole
        done = best.select("id") if last else best.groupBy("id").agg(F.count_if("sure").alias("c")).where(F.col("c") >= k).select("id")
        found = best.join(done.distinct(), "id", "left_semi").select("id", "other", "metres")
        out = found if out is None else out.unionByName(found)
        if last:
            return out
        rest = cut(rest.join(done, rest["id"] == done["id"], "left_anti"))
        if not rest.limit(1).count():
            return out
        size *= 2


def merge_sources(sources: list[tuple[str, DataFrame, int]]) -> DataFrame:
    """row, candidate, source, position: an item belongs to the first source that has it; budgets count what is left.

    Each frame: row, candidate, rank. A source with budget 0 is skipped and claims nothing."""
    live = [(i, n, f, b) for i, (n, f, b) in enumerate(sources) if b > 0]
    all_ = reduce(DataFrame.unionByName, [f.select("row", "candidate", "rank", F.lit(i).alias("p"), F.lit(n).alias("source"), F.lit(b).alias("budget")) for i, n, f, b in live])
    own = all_.withColumn("d", F.row_number().over(Window.partitionBy("row", "candidate").orderBy("p", "rank"))).where("d = 1")
    return own.withColumn(
        "position",
        F.row_number().over(Window.partitionBy("row", "p").orderBy("rank", "candidate")),
    ).where("position <= budget").select("row", "candidate", "source", "position")


def hard_graph(
    rows: DataFrame,
    block: list[str],
    score: Score,
    threshold: float,
    k: int,
    protect: tuple[str, ...] = (),
    protected: DataFrame | None = None,
    block_rows: int = 1024,
) -> DataFrame:
    """row, neighbor, score, rank: rows of one block that score at least the threshold (1e-12 slack), best k a row.

    score takes two pandas frames of rows and returns the matrix of their scores. Pairs that agree in all columns of protect,
    and those of protected (row, neighbor), are no negatives. A block of any size is cut into parts of about block_rows; parts
    meet pairwise in tasks of their own, and only the best k of a row leave one."""
    total = rows.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("__parts"))
    dealt = rows.join(total, block).withColumn("__own", F.pmod(F.xxhash64("row"), F.col("__parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))
    left = dealt.withColumn("__d", F.col("__own")).withColumn("__q", every).withColumn("__asks", F.lit(True))
    right = dealt.withColumn("__q", F.col("__own")).withColumn("__d", every).withColumn("__asks", F.lit(False))
    keep = k if protected is None else None  # pairs that leave later must not take a place

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        asks, asked = pdf[pdf["__asks"]].reset_index(drop=True), pdf[~pdf["__asks"]].reset_index(drop=True)
        if not len(asks) or not len(asked):
            return pd.DataFrame({"row": [], "neighbor": [], "score": []})
        s = score(asks, asked)
        a, b = asks["row"].to_numpy(), asked["row"].to_numpy()
        out = a[:, None] == b[None, :]
        if protect:
            same = np.ones_like(out)
            for c in protect:
                same &= asks[c].to_numpy()[:, None] == asked[c].to_numpy()[None, :]
            out |= same
        s = np.where(out, -np.inf, s)
        i, j = np.nonzero(s + 1e-12 >= threshold)
        found = pd.DataFrame({"row": a[i], "neighbor": b[j], "score": s[i, j]}).sort_values(["row", "score", "neighbor"], ascending=[True, False, True])
        return found if keep is None else found.groupby("row").head(keep)

    pairs = left.unionByName(right).groupBy(*block, "__d", "__q").applyInPandas(near, "row long, neighbor long, score double")
    if protected is not None:
        pairs = pairs.join(protected, ["row", "neighbor"], "left_anti")
    return top_per(pairs, "row", [F.desc("score"), F.col("neighbor")], k)


def in_batch(targets: DataFrame, reasonable: DataFrame) -> DataFrame:
    """row, candidate: distinct targets of the row's batch that are neither its own nor among its reasonable answers."""
    own = targets.select("batch", "row", "target")
    pairs = own.join(own.select("batch", F.col("target").alias("candidate")).distinct(), "batch").where("target != candidate")
    return pairs.join(reasonable.select("row", F.col("target").alias("candidate")), ["row", "candidate"], "left_anti").select("row", "candidate")


def same_code_pairs(rows: DataFrame, code: list[str], id_: str) -> DataFrame:
    a, b = rows.select(*code, F.col(id_).alias("a")), rows.select(*code, F.col(id_).alias("b"))
    return a.join(b, code).where("a < b").select("a", "b")
