"""Sharding by fixed virtual slots.

Every record hashes by its id and text into one of n_slots virtual slots, a number that never changes. Bytes and rows
are aggregated by slot, and a small versioned table maps slots to shards. Rebalancing and growing edit that
table and write the next version; no record is hashed again, and only the moved slots' records travel.

The map has n_slots rows whatever the corpus: it is the one thing that is collected and broadcast.

Nulls: a null id or text is left out of the hash, a null text has no bytes. Rows alike in id and text share a slot and are
placed by count, whatever their number; if they alone hold more than a shard's share, the sizes differ by that. An empty table gives an empty result and a map over empty slots. Columns beside the id and the text are
not looked at, so clashing names do no harm.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnflow.llm.common import materialise, set_aside

N_SLOTS = 4096


def virtual_slot(n_slots: int = N_SLOTS):
    """Column: slot of a record, from a 64-bit hash of its doc_id and text, so that rows that share an id, or have none, spread."""
    key = F.xxhash64(F.lit(1), F.col("doc_id").cast("string"), F.lit(2), F.col("text"))
    return F.pmod(key, F.lit(n_slots)).cast("int")


def keyed(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot of each record; the text itself stays behind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), virtual_slot(n_slots).alias("vslot"))


def slot_sizes(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(vslot, bytes, rows), at most n_slots of them."""
    return [tuple(r) for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).orderBy("vslot").collect()]


def first_map(n_shards: int, n_slots: int = N_SLOTS) -> list[int]:
    """Version 1: equal runs of slots for each shard, before any size is known."""
    return [s * n_shards // n_slots for s in range(n_slots)]


def rebalance(shard_of: list[int], bytes_of: dict[int, int], n_shards: int) -> list[int]:
    """The map edited until no move of one slot from the heaviest to the lightest shard evens them out.

    Each edit moves the slot nearest to half the difference, so the largest difference left is below the
    smallest non-empty slot of the heaviest shard.
    """
    out = list(shard_of)
    load, own = [0] * n_shards, [{} for _ in range(n_shards)]
    for slot, shard in enumerate(out):
        if b := bytes_of.get(slot, 0):
            load[shard] += b
            own[shard][slot] = b
    while True:
        high, low = max(range(n_shards), key=lambda s: (load[s], -s)), min(range(n_shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        fit = [(abs(2 * b - gap), slot, b) for slot, b in own[high].items() if b < gap]
        if not fit:
            return out
        _, slot, b = min(fit)
        out[slot] = low
        del own[high][slot]
        own[low][slot] = b
        load[high] -= b
        load[low] += b


def grow(shard_of: list[int], bytes_of: dict[int, int], n_shards: int) -> list[int]:
    """The map with one more shard: slots move only into the new shard, until it holds its share."""
    out, load = list(shard_of), [0] * n_shards
    for slot, shard in enumerate(out):
        load[shard] += bytes_of.get(slot, 0)
    heap, share, new = [(-b, s) for s, b in enumerate(load)], sum(load) / (n_shards + 1), 0
    own = [sorted((bytes_of.get(slot, 0), slot) for slot, s in enumerate(out) if s == shard and bytes_of.get(slot, 0)) for shard in range(n_shards)]
    heapq.heapify(heap)
    while heap and new < share:
        b, s = heapq.heappop(heap)
        if own[s] and -b > share:
            size, slot = own[s].pop(len(own[s]) // 2)
            out[slot] = n_shards
            new += size
            heapq.heappush(heap, (b + size, s))
    return out


def map_table(spark: SparkSession, versions: Iterable[tuple[int, list[int]]]) -> DataFrame:
    """The stored form: version, vslot, shard; a later version has the same slots."""
    return spark.createDataFrame([(v, slot, shard) for v, shards in versions for slot, shard in enumerate(shards)], "version int, vslot int, shard int")


def latest(maps: DataFrame) -> DataFrame:
    top = maps.agg(F.max("version")).collect()[0][0]
    return maps.where(F.col("version") == F.lit(top))


def place(rows: DataFrame, maps: DataFrame, sizes: list[tuple[int, int, int]]) -> DataFrame:
    """Shard and place in the shard of each record of keyed(), by the newest version of the map.

    A place is the slot's offset in its shard plus the record's rank in its slot, so ranks are taken in n_slots
    small sorts, never in one for each shard.
    """
    spark = rows.sparkSession
    # a plain frame of n_slots rows: prefix sums over it stay within one bounded task
    counts = spark.createDataFrame([(s, n) for s, _, n in sizes], "vslot int, rows long")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = latest(maps).join(counts, "vslot").withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0))).select("vslot", "shard", "offset", F.col("version").alias("map_version"))
    key = ["doc_id", "size", "text_crc32"]
    upto = Window.partitionBy("vslot").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
    alike = rows.groupBy("vslot", *key).agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(upto))
    placed = alike.join(F.broadcast(offsets), "vslot")
    return placed.withColumn("slot", F.explode(F.sequence(F.col("offset") + F.col("upto") - F.col("n"), F.col("offset") + F.col("upto") - 1)))


def balanced(rows: DataFrame, n_shards: int, n_slots: int) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """The stored map (version 1 by slot, version 2 rebalanced by bytes) and the sizes of the slots of rows."""
    sizes = slot_sizes(rows)
    start = first_map(n_shards, n_slots)
    even = rebalance(start, {s: b for s, b, _ in sizes}, n_shards)
    return materialise(map_table(rows.sparkSession, [(1, start), (2, even)]).coalesce(1), "slot-map"), sizes


def shard_documents(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version of each document.

    The law is `bytes`: shards hold nearly equal sizes; grown_shard is null, as it belongs to another law.
    """
    rows = materialise(keyed(docs, n_slots), "sized")
    maps, sizes = balanced(rows, n_shards, n_slots)
    placed = place(rows, maps, sizes)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
        "map_version",
    )


def with_shard(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS) -> DataFrame:
    """docs with shard, virtual_slot and map_version; the texts don't travel, as the map is joined where they lie."""
    rows = materialise(keyed(docs, n_slots).select("vslot", "size"), "sized")
    maps, _ = balanced(rows, n_shards, n_slots)
    found = F.broadcast(latest(maps).select(F.col("vslot").alias("__v"), F.col("shard").alias("__shard"), F.col("version").alias("__version")))
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "virtual_slot", "map_version")])
    plain, _ = set_aside(docs, "doc_id", "text")
    both = plain.withColumn("__slot", virtual_slot(n_slots)).join(found, F.col("__slot") == F.col("__v"))
    own = [F.col(n).alias(c) for n, c in zip(plain.columns, docs.columns, strict=True)]
    return both.select(*own, F.col("__shard").cast("int").alias("shard"), F.col("__slot").alias("virtual_slot"), F.col("__version").alias("map_version"))
