"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target over its size is the expected number of copies of each of its documents. The whole part is
taken as it is; the fractions are rounded dependently: two fractional documents meet, and mass (words) moves
from one to the other at random until one of them is integral, so that the expected words of the source hold
exactly through every meeting. Documents meet in blocks of a bounded number, largest first, so that what
remains is small; each block leaves at most one fractional document, and these meet again in blocks, level
by level, until one remains a source, which is rounded alone. A source's words miss its target by less than
that last document.

Randomness is a hash of the two documents' ids and the seed: reruns agree whatever the partitioning.

Nulls: a null text has size 0, a null source is a source of its own (the last), a null id is an id. Rows that
repeat (source, doc_id, size) are rounded together by count, so that many repeats are one row here. A source
without words has target 0 and takes nothing; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnflow.llm.common import WS, materialise, set_aside

BLOCK = 256
SEED = 20_240_229
EPS = 1e-9
WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
CAP = 2.0


def word_count(text):
    """Column: number of words; each word with the white space before it becomes one mark, which are counted."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}]*[^{WS}]+", "x")
    return F.length(F.regexp_replace(marks, f"[{WS}]+$", "")).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """sources (one row each) with `nth`, its place by code point from 0, null last: ranks within range partitions and offsets."""
    order = F.col("source").asc_nulls_last()
    parts = materialise(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    sizes = parts.groupBy("part").count().orderBy("part").collect()  # one row a partition
    offsets, n = [], 0
    for part, count in sizes:
        offsets.append((part, n))
        n += count
    starts = sources.sparkSession.createDataFrame(offsets, "part int, start long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return parts.withColumn("rank", rank).join(F.broadcast(starts), "part").withColumn("nth", F.col("start") + F.col("rank") - 1).drop("part", "rank", "start")


def source_targets(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """source, source_size, target: budget * all sizes shared by weight, no source above cap * its size.

    A level L gives each source the lesser of its cap and L times its weight. Starting with no source at its cap, L is
    what the capped ones leave over the others' weights; the sources it brings to their caps join them until none does.
    Every round is one aggregate over the sources, whose number has no bound (a source may be a web domain).
    """
    src = numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    src = materialise(src.select("source", "source_size", weight.alias("weight"), (F.lit(cap) * F.col("source_size")).alias("most")), "weighed")
    total = src.agg(F.sum("source_size")).collect()[0][0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("most") <= F.lit(level) * F.col("weight")
        n, gone, rest = src.agg(F.count_if(full), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).collect()[0]
        if rest is None or n == capped:
            break
        level, capped = (budget * total - (gone or 0.0)) / rest, n
    target = F.col("most") if rest is None else F.least(F.col("most"), F.lit(level) * F.col("weight"))
    return src.select("source", "source_size", target.alias("target"))


def _chance(*parts):
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _settle(units):
    """Fold of a block's units (sorted, largest first): struct(done array, carry array of at most one)."""
    unit = "struct<size:bigint,doc_id:bigint,m:bigint,full:bigint,p:double>"
    start = F.struct(F.array().cast(f"array<{unit}>").alias("done"), F.array().cast(f"array<{unit}>").alias("carry"))

    def put(u, p):
        return F.struct(u["size"].alias("size"), u["doc_id"].alias("doc_id"), u["m"].alias("m"), u["full"].alias("full"), p.alias("p"))

    def meet(acc, x):
        c = acc["carry"][0]
        s, t = c["size"].cast("double"), x["size"].cast("double")
        up = F.least(1.0 - c["p"], x["p"] * t / s)
        down = F.least(c["p"], (1.0 - x["p"]) * t / s)
        rise = _chance(F.lit(SEED), c["doc_id"], c["size"], x["doc_id"], x["size"], c["p"]) * (up + down) < down
        p = F.when(rise, c["p"] + up).otherwise(c["p"] - down)
        q = F.when(rise, x["p"] - up * s / t).otherwise(x["p"] + down * s / t)
        snap = lambda v: F.when(v < EPS, F.lit(0.0)).when(v > 1 - EPS, F.lit(1.0)).otherwise(v)
        pair = F.array(put(c, snap(p)), put(x, snap(q)))
        whole = lambda u: (u["p"] == 0.0) | (u["p"] == 1.0)
        both = F.struct(F.concat(acc["done"], F.filter(pair, whole)).alias("done"), F.filter(pair, lambda u: ~whole(u)).alias("carry"))
        return F.when(F.size(acc["carry"]) == 0, F.struct(acc["done"].alias("done"), F.array(x).alias("carry"))).otherwise(both)

    return F.aggregate(units, start, meet)


def round_units(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """units: source, size, doc_id, m, full, p with 0 < p < 1. The same rows with p 0.0 or 1.0."""
    cols = ["source", "size", "doc_id", "m", "full", "p"]
    rest, done, level = units, [], 0
    while True:
        n = rest.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
        most = n.agg(F.max("blocks")).collect()[0][0] or 0
        if not most:
            break
        dealt = rest.join(n, rest["source"].eqNullSafe(n["source"])).drop(n["source"])
        at = F.pmod(F.xxhash64(F.lit(level), "doc_id", "size"), F.col("blocks"))
        # the largest meet first; the carry then gets smaller with the documents that it meets
        row = F.struct((-F.col("size")).alias("o"), F.xxhash64(F.lit(SEED), "doc_id").alias("h"), F.struct(*[F.col(c).alias(c) for c in cols[1:]]).alias("u"))
        folded = dealt.groupBy("source", at.alias("block")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["u"]).alias("units")).select("source", _settle(F.col("units")).alias("r"))
        folded = materialise(folded.select("source", "r.done", "r.carry"), f"pivot{level}")
        opened = lambda c: folded.select("source", F.explode(c).alias("u")).select("source", *[F.col("u")[k].alias(k) for k in cols[1:]])  # noqa: E731, B023
        done.append(opened("done"))
        rest, level = opened("carry"), level + 1
        if most == 1:
            last = (_chance(F.lit(SEED), F.lit("last"), "doc_id", "size") < F.col("p")).cast("double")
            done.append(rest.withColumn("p", last).select(*cols))
            break
    out = units.limit(0).select(*cols)
    for d in done:
        out = out.unionByName(d.select(*cols))
    return out


def mix_counts(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """source, doc_id, size, m (rows alike), base (copies of each), extra (of them get one more), source_size, target."""
    sized = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "sizes")
    targets = materialise(source_targets(sized, weights, budget, cap), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rate = F.when(F.abs(rate - F.round(rate)) < EPS, F.round(rate)).otherwise(rate)
    rates = targets.select(F.col("source").alias("s"), "source_size", "target", F.floor(rate).cast("long").alias("base"), (rate - F.floor(rate)).alias("f"))
    alike = sized.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("m"))
    units = alike.join(rates, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    more = F.col("m") * F.col("f")
    part = more - F.floor(more)
    units = units.withColumn("full", F.floor(more).cast("long") + F.when(part > 1 - EPS, 1).otherwise(0)).withColumn(
        "p",
        F.when((part < EPS) | (part > 1 - EPS) | (F.col("size") == 0), 0.0).otherwise(part),
    )
    units = materialise(units, "units")
    open_ = round_units(units.where("p > 0").select("source", "size", "doc_id", "m", "full", "p"), block)
    closed = units.where("p = 0").select("source", "size", "doc_id", "m", "full", "p")
    both = open_.unionByName(closed).withColumn("extra", F.col("full") + F.col("p").cast("long"))
    return both.join(rates.drop("f"), F.col("source").eqNullSafe(F.col("s"))).select("source", "doc_id", "size", "m", "base", "extra", "source_size", "target")


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of each document."""
    counts = mix_counts(docs, **options)
    rows = counts.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("i"))
    copies = F.col("base") + F.when(F.col("i") <= F.col("extra"), 1).otherwise(0)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.cast("long").alias("copies"), "source")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it, with all its columns."""
    docs, back = set_aside(docs, "doc_id", "source", "text")
    counts = materialise(mix_counts(docs, **options), "mix")
    taken = counts.where("base + extra > 0").select(
        F.col("source").alias("__s"),
        F.col("doc_id").alias("__i"),
        F.col("size").alias("__n"),
        F.col("m").alias("__m"),
        F.col("base").alias("__base"),
        F.col("extra").alias("__extra"),
    )
    rows = docs.withColumn("__size", word_count(F.col("text")))
    on = rows["doc_id"].cast("long").eqNullSafe(taken["__i"]) & rows["source"].cast("string").eqNullSafe(taken["__s"]) & (rows["__size"] == taken["__n"])
    # the decisions grow with the documents, so they are never broadcast: the plan is the same at every size
    both = rows.join(taken.hint("merge"), on)
    if counts.where("m > 1").limit(1).count():
        rank = Window.partitionBy("__s", "__i", "__n").orderBy(F.xxhash64("text"))
        both = both.withColumn("__copies", F.col("__base") + F.when(F.row_number().over(rank) <= F.col("__extra"), 1).otherwise(0)).where("__copies > 0")
    else:
        both = both.withColumn("__copies", F.col("__base") + F.col("__extra"))
    return back(both.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__copy")))
