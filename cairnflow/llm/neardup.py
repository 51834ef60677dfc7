"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct word shingles. Every permutation is evaluated once and keeps both its minimum
and its maximum, so that 80 permutations give 160 signature values; five values make a band, minima and maxima in
bands of their own, and 32 bands miss a pair at similarity 0.8 with probability (1 - 0.8^5)^32, or 3 in a million.

1. Documents with equal sets (a 128-bit fingerprint) form a class; a number of its own stands for it from here on.
2. Representatives that share a band form a bucket. Buckets are never opened into pairs: first every member is
   compared, on full sets, with the bucket head that it meets in most bands, which joins groups of copies of any size
   with one comparison a member. Connected components follow by alternating stars over tables. From here on members
   travel as their sorted shingle hashes, not as texts.
3. Buckets that still span several components are compared exactly: the members outside the bucket's largest
   component against all, in blocks of bounded shingles, on full sets. Only links come out. A bucket of n members with m
   outside its largest component costs n * m comparisons at most; a block ends as soon as all its members are joined.
4. Components over all links; every document takes its class's component, named by the smallest id in it.

No bucket, class or candidate count is capped, and nothing but counts reaches the driver.

Nulls and texts without words have an empty set and are linked with nothing. Ids play no part in linking: rows with a
null id are linked as others are, and texts that share an id are linked only if they are near. The row that is kept
of a component has its smallest id (a null id comes last), and of that id's texts the one with the smallest hash; a
component without any id has a null component_id. Repeated rows (same id, same text) all get the same result; empty tables
give an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnflow.llm.common import LOWER_ASCII, WordHashes, map_rows, materialise, mix64, set_aside, slices, utf8

WORDS = 4
PERCENT = 80
PERMUTATIONS = 80
ROWS = 5
#: Shingles of a block's asked and of its asking members, on average.
BLOCK = 300_000
#: Bits of the filter that keeps the second reading of the texts to documents in buckets: at most 16 MB.
FILTER_BITS = 27

_rng = np.random.Generator(np.random.PCG64(20_240_229))
#: x -> (a * x + b) mod 2^32 on hashed shingles, a odd.
MUL = _rng.integers(0, 2**32, PERMUTATIONS, np.uint64).astype(np.uint32) | np.uint32(1)
ADD = _rng.integers(0, 2**32, PERMUTATIONS, np.uint64).astype(np.uint32)

P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def shingles(text: str | None, hashes: WordHashes, width: int = WORDS) -> np.ndarray:
    """Distinct shingles of a text as sorted 64-bit hashes; a text of fewer words is one shingle."""
    w = utf8(text).translate(LOWER_ASCII).split()
    if not w:
        return np.empty(0, np.uint64)
    h = hashes.of(w)
    n = max(1, len(h) - width + 1)
    k = min(width, len(h))
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = mix64((out ^ h[i : i + n]) * P1 + P2)
    return np.unique(out)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over the set, signed."""
    both = np.array([mix64(s ^ P3).sum(dtype=np.uint64), mix64(s + P2).sum(dtype=np.uint64)]).view(np.int64)
    return int(both[0]), int(both[1])


def min_max(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of the set under each permutation, in pieces of bounded memory."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for i in range(0, len(x), 1024):
        p = x[i : i + 1024, None] * MUL + ADD
        low, high = np.minimum(low, p.min(0)), np.maximum(high, p.max(0))
    return low, high


def bands(low: np.ndarray, high: np.ndarray) -> list[int]:
    """One signed 64-bit key for each band of ROWS minima or ROWS maxima; the band's number is part of the key."""
    v = np.concatenate([low, high]).astype(np.uint64).reshape(-1, ROWS)
    key = np.arange(len(v), dtype=np.uint64) + np.uint64(1)
    for i in range(ROWS):
        key = mix64((key ^ v[:, i]) * P1 + P2)
    return key.view(np.int64).tolist()


SKETCH = T.StructType([
    T.StructField("n_shingles", T.LongType()),
    T.StructField("f1", T.LongType()),
    T.StructField("f2", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())),
])


def keyed(docs: DataFrame) -> DataFrame:
    """docs with h1 and h2, a 128-bit hash of the text."""
    return docs.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), F.col("text")))


def row_key():
    """Column: what tells a row from others, ordered by id, nulls last."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2")


def sketches(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """doc_id, text hash (h1, h2), n_shingles, fingerprint (f1, f2) and band keys of each document."""

    def work():
        hashes = WordHashes()

        def rows(texts):
            out: list[list] = [[], [], [], []]
            for text in texts:
                s = shingles(text, hashes, width)
                f1, f2 = fingerprint(s) if len(s) else (0, 0)
                for column, value in zip(out, (len(s), f1, f2, bands(*min_max(s)) if len(s) else []), strict=True):
                    column.append(value)
            return out

        return rows

    return map_rows(keyed(docs), ["text"], SKETCH, work, ["doc_id", "h1", "h2"])


def similar(a: int, b: int, both: int, percent: int = PERCENT) -> bool:
    return 100 * both >= percent * (a + b - both)


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                ok.append(similar(len(s), len(t), len(np.intersect1d(s, t, True)), percent))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, tag: str) -> DataFrame:
    """node, label (the smallest reachable id) of the nodes of edges (a, b), by alternating large and small stars."""
    e = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), f"{tag}-edges")
    state = None
    while True:
        # large star: neighbours above a node go to its smallest neighbour
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: neighbours below a node, and the node, go to the smallest of them
        down = large.where("a != b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = materialise(small.where("a != b").distinct(), f"{tag}-stars")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])
        if now == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        state = now


def compare_block(pdf: pd.DataFrame, percent: int = PERCENT) -> pd.DataFrame:
    """Links between the asking members of a bucket's block and its other members of other labels."""
    pdf = pdf.drop_duplicates(["rep", "asks"])
    asked, asking = pdf[~pdf["asks"]], pdf[pdf["asks"]]
    out: list[tuple[int, int]] = []
    if not len(asked) or not len(asking):
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    sets = [np.frombuffer(x, np.uint64) for x in asked["s"]]
    size = np.array([len(s) for s in sets], np.int64)
    known, place = np.unique(np.concatenate(sets), return_inverse=True)
    place = place.astype(np.int32)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    reps, labels = asked["rep"].to_numpy(), asked["label"].to_numpy()
    open_ = len(set(labels.tolist()) | set(asking["label"].tolist()))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    for rep, label, data in zip(asking["rep"], asking["label"], asking["s"], strict=True):
        if open_ < 2:  # all are joined
            break
        s = np.frombuffer(data, np.uint64)
        held = np.zeros(len(known), bool)
        at = np.searchsorted(known, s)
        at[at == len(known)] = 0
        held[at[known[at] == s]] = True
        common = np.add.reduceat(held[place], starts, dtype=np.int64)
        for i in np.flatnonzero((100 * common >= percent * (size + len(s) - common)) & (labels != label)):
            a, b = root(int(label)), root(int(labels[i]))
            if a != b:  # one link joins two components, more add nothing
                parent[max(a, b)] = min(a, b)
                open_ -= 1
                out.append((int(rep), int(reps[i])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def sets_of(docs: DataFrame, nodes: DataFrame, width: int = WORDS) -> DataFrame:
    """(rep, n_shingles, s: sorted shingle hashes) of the rows in nodes (rep, n_shingles, first: a row key): a bounded bit
    filter first, so that only rows in buckets are cut into shingles and travel, then the exact join."""
    spark = docs.sparkSession
    n = nodes.count()
    bits = min(FILTER_BITS, max(10, (16 * n).bit_length()))
    place = F.pmod(F.xxhash64("doc_id", "h1", "h2"), F.lit(1 << bits))
    wanted = nodes.select("rep", "n_shingles", "first.doc_id", "first.h1", "first.h2")
    at = wanted.select(place.alias("at"))
    words = at.groupBy(F.expr("int(shiftright(at, 6))").alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(at % 64)))").alias("v")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words.column("w").to_numpy()] = words.column("v").to_numpy()
    shared = spark.sparkContext.broadcast(table)

    def run(batches):
        hashes, table = WordHashes(), shared.value
        seen: set[tuple] = set()

        def first(whole, wanted):
            """wanted less the rows that repeat an id and its text within this task, so that repeats of any number don't travel."""
            for i in np.flatnonzero(wanted).tolist():
                key = (whole.column("doc_id")[i].as_py(), whole.column("h1")[i].as_py(), whole.column("h2")[i].as_py())
                wanted[i] = key not in seen
                seen.add(key)
            if len(seen) > 100_000:
                seen.clear()
            return pa.array(wanted)

        for whole in batches:
            x = whole.column("place").to_numpy()
            for batch in slices(whole.filter(first(whole, (table[x >> 6] >> (x & 63)) & 1 == 1))):
                made = [shingles(t, hashes, width).tobytes() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h1", "h2")), pa.array(made, pa.binary())], ["doc_id", "h1", "h2", "s"])

    sent = keyed(docs.select("doc_id", "text")).select("doc_id", "h1", "h2", "text", place.alias("place"))
    # plain keys, so that one shuffle serves the join and the last repeats
    keyed_by = [F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("no_id"), "h1", "h2"]
    near = sent.mapInArrow(run, "doc_id long, h1 long, h2 long, s binary").select(*keyed_by, "s")
    key = ["i", "no_id", "h1", "h2"]
    both = near.join(wanted.select(*keyed_by, "rep", "n_shingles"), key)
    return both.groupBy(*key).agg(*[F.first(c).alias(c) for c in ("rep", "n_shingles", "s")]).select("rep", "n_shingles", "s")


def judged(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, h1, h2, n_shingles, component_id, kept of each document; doc_id is a whole number."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sk = materialise(sketches(docs, width), "sketches")
    # one row a class: copies end here, whatever their number; equal sets have equal bands
    classes = sk.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min(row_key()).alias("first"), F.first("bands").alias("bands"))
    classes = materialise(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    reps = materialise(classes.select("rep", F.explode(F.array_distinct("bands")).alias("key")), "bands")
    classes = classes.drop("bands")
    heads = reps.groupBy("key").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialise(reps.join(heads, "key"), "members")
    met = members.where("rep != head").groupBy("rep", "head").agg(F.count(F.lit(1)).alias("c"))
    first = materialise(met.groupBy("rep").agg(F.max_by("head", F.struct("c", -F.col("head"))).alias("head")).select(F.col("rep").alias("a"), F.col("head").alias("b")), "first")
    sets = materialise(sets_of(docs, classes.join(members.select("rep").distinct(), "rep"), width), "sets")
    links = materialise(verify(first, sets, percent), "links")
    labels = components(links, "first")

    labelled = members.join(labels, members["rep"] == labels["node"], "left").select("key", "head", "n", "rep", F.coalesce("label", "rep").alias("label"))
    labelled = materialise(labelled, "labelled")
    # what still spans labels; buckets of the same members count once, pairs that were compared not again
    tally = labelled.groupBy("key", "label").agg(
        F.count(F.lit(1)).alias("c"),
        F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("h"),
        F.max("rep").alias("a"),
        F.min("rep").alias("b"),
    )
    open_ = tally.groupBy("key").agg(
        F.count(F.lit(1)).alias("labels"),
        F.max_by("label", F.struct("c", -F.col("label"))).alias("major"),
        F.max("c").alias("most"),
        F.sum("c").alias("n"),
        F.sum("h").alias("h"),
        F.max("a").alias("a"),
        F.min("b").alias("b"),
    ).where("labels > 1")
    open_ = open_.groupBy("n", "h", "a", "b").agg(F.min_by(F.struct("key", "major", "most"), "key").alias("k")).select("n", "a", "b", "k.*")
    open_ = open_.join(first.withColumn("pair", F.lit(True)), ["a", "b"], "left").where("n > 2 or pair is null").select("key", "n", "major", "most")
    spread = materialise(labelled.drop("n").join(materialise(open_, "open"), "key").join(classes.select("rep", "n_shingles"), "rep"), "spread")
    ways = spread.groupBy("key").agg(
        F.ceil(F.sum("n_shingles") / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.sum(F.when(F.col("label") != F.col("major"), F.col("n_shingles"))) / BLOCK).cast("int").alias("asking"),
    )
    spread = spread.join(ways, "key")
    own = F.xxhash64("rep")
    asked = spread.select(
        "key",
        "rep",
        "label",
        F.pmod(own, F.col("blocks")).cast("int").alias("d"),
        F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("q"),
        F.lit(False).alias("asks"),
    )
    asks = spread.where("label != major").select(
        "key",
        "rep",
        "label",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("d"),
        F.pmod(own, F.col("asking")).cast("int").alias("q"),
        F.lit(True).alias("asks"),
    )
    with_set = asked.unionByName(asks).join(sets.select("rep", "s"), "rep")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        return compare_block(pdf, percent)

    more = materialise(with_set.groupBy("key", "d", "q").applyInPandas(block, "a long, b long").distinct(), "more")
    joined = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more), "all") if more.limit(1).count() else labels
    # a component's first row names it; classes without links are their own
    linked = classes.join(joined, classes["rep"] == joined["node"], "left").select("f1", "f2", "n_shingles", "first", "label")
    heads = linked.where("label is not null").groupBy("label").agg(F.min("first").alias("head"))
    comp = linked.join(heads, "label", "left").select("f1", "f2", "n_shingles", F.coalesce("head", "first").alias("head"))
    out = sk.drop("bands").join(comp, ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id"))
    kept = F.col("head").isNull() | (row_key() == F.col("head"))
    return out.select("doc_id", "h1", "h2", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document; doc_id is a whole number."""
    return judged(docs, width, percent).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, the one that near_duplicates() keeps, with all columns of docs; of rows that repeat an id
    and its text, one. Rows without words stay, but for repeated ones with an id."""
    docs, back = set_aside(docs, "doc_id", "text")
    found = judged(docs, **options)
    key = [F.col(c).alias(f"__{c}") for c in ("doc_id", "h1", "h2")]
    gone = found.where(~F.col("kept")).select(*key).distinct()
    twice = found.where("kept and (doc_id is not null or n_shingles > 0)").select(*key).groupBy("__doc_id", "__h1", "__h2").count().where("count > 1").drop("count")
    return back(drop_rows(docs, gone, materialise(twice, "twice")))


def drop_rows(docs: DataFrame, gone: DataFrame, twice: DataFrame) -> DataFrame:
    """docs without the rows in gone, and once each of those in twice (both: __doc_id, __h1, __h2)."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.col("text")).alias("h2"))
    same = (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2")) & F.col("i").eqNullSafe(F.col("__doc_id"))
    whole = [F.col(f"row.`{c}`") for c in docs.columns]
    stay = rows.join(gone, same, "left_anti")
    if not twice.limit(1).count():
        return stay.select(*whole)
    once = stay.join(twice, same, "left_semi").dropDuplicates(["i", "h1", "h2"])
    return stay.join(twice, same, "left_anti").select(*whole).unionByName(once.select(*whole))


def brute(rows: Iterator[tuple[int, str | None]], width: int = WORDS, percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component) by comparing all pairs of word tuples: for tests on small tables."""
    sets = {}
    for i, text in rows:
        w = utf8(text).translate(LOWER_ASCII).split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if min(len(sets[i]), len(sets[j])) * 100 >= percent * max(len(sets[i]), len(sets[j])) and similar(len(sets[i]), len(sets[j]), len(sets[i] & sets[j]), percent):
                a, b = root(i), root(j)
                comp[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}
