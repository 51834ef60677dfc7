"""Training messages out of orders, identifiers and history; identifier tables; the special tokens they are written in.

An order has sample, user, ts, query, lng, lat, target and history (array of event_time, query, poi, lng, lat, oldest first). Identifiers are
a table (poi, content). One plan serves all forms: history is opened with its position, joined to the identifiers, closed
again in order, and written by a template; the target joins once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.functions import geo, hashing
from cairnflow.operators.identifiers import bucket_code
from cairnflow.operators.messages import messages

HISTORY = "array<struct<event_time:timestamp,query:string,poi:string,lng:double,lat:double>>"
# Tokens of the messages' structure.
STRUCTURE = (
    "<USER_ID>",
    "</USER_ID>",
    "<HISTORY>",
    "</HISTORY>",
    "<EVENT>",
    "</EVENT>",
    "<CURRENT>",
    "</CURRENT>",
    "<USER_GID>",
    "</USER_GID>",
    "<QUERY>",
    "</QUERY>",
    "<POI_TIGER_ID>",
    "</POI_TIGER_ID>",
)
#: Template: tag of an event's identifier, whether events are wrapped, whether the user and the history are named.
TEMPLATES = {"tiger": ("POI_TIGER_ID", True, True, True), "genpoi": ("POI_PID", False, False, True), "gnpr": ("POI_GNPR_ID", True, False, True), "plain": (None, False, False, False)}


def gid_text(lng: Column, lat: Column, length: int = 6) -> Column:
    """`<G_w><G_x>..`: a geohash, one token a character."""
    return F.regexp_replace(geo.geohash(lng, lat, length), "(.)", "<G_$1>")


def user_content(template: str, length: int = 6, buckets: int = 2000) -> Column:
    """The user's message of a row with query, lng, lat, user and `events` (array of query, gid, content)."""
    tag, wrapped, with_user, with_history = TEMPLATES[template]
    field = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    current = F.concat_ws("\n", F.lit("<CURRENT>"), field("USER_GID", gid_text(F.col("lng"), F.col("lat"), length)), field("QUERY", F.col("query")), F.lit("</CURRENT>"))
    if not with_history:
        return current

    def event(e: Column) -> Column:
        lines = [field("USER_GID", e["gid"]), field("QUERY", e["query"]), field(tag, e["content"])]
        return F.concat_ws("\n", *([F.lit("<EVENT>"), *lines, F.lit("</EVENT>")] if wrapped else lines))

    events = F.transform("events", event)
    head = [field("USER_ID", hashing.user_token(F.col("user"), buckets))] if with_user else []
    body = F.when(F.size("events") > 0, F.array_join(events, "\n"))  # concat_ws leaves out null
    return F.concat_ws("\n", *head, F.lit("<HISTORY>"), body, F.lit("</HISTORY>"), current)


def with_identifiers(orders: DataFrame, ids: DataFrame, length: int = 6) -> DataFrame:
    """orders with content (the target's), events (query, gid, content of each, in order) and missing (history ids without one)."""
    opened = orders.select("sample", F.posexplode("history").alias("pos", "e"))
    named = opened.select(
        "sample",
        "pos",
        F.col("e.poi").alias("poi"),
        F.col("e.query").alias("query"),
        gid_text(F.col("e.lng"), F.col("e.lat"), length).alias("gid"),
    ).join(ids, "poi", "left")
    entry = F.struct("pos", "query", "gid", "content")
    closed = named.groupBy("sample").agg(F.array_sort(F.collect_list(entry)).alias("events"), F.count_if(F.col("content").isNull()).alias("missing"))
    target = ids.select(F.col("poi").alias("target"), "content")
    both = orders.join(target, "target", "left").join(closed, "sample", "left").fillna(0, ["missing"])
    return both.withColumn("events", F.coalesce("events", F.array().cast(closed.schema["events"].dataType)))


def training_rows(orders: DataFrame, ids: DataFrame, template: str, split: Column, length: int = 6, buckets: int = 2000) -> DataFrame:
    """sample, split, messages, history_length, fault. Only orders with a blank query are dropped; repeated targets stay.

    fault names the first rule a row breaks (no split, target or history without an identifier); such rows have no messages."""
    asked = orders.where(F.coalesce(F.trim("query"), F.lit("")) != "")
    rows = with_identifiers(asked, ids, length).withColumn("split", split)
    fault = F.when(F.col("split").isNull(), "date_outside_splits").when(F.col("content").isNull(), "target_without_identifier").when(F.col("missing") > 0, "history_without_identifier")
    pair = messages(user_content(template, length, buckets), F.col("content"))
    return rows.withColumn("fault", fault).select("sample", "split", F.when(F.col("fault").isNull(), pair).alias("messages"), F.size("events").alias("history_length"), "fault")


def reference_rows(orders: DataFrame, rows: DataFrame, split: Column, placeholder: str = "<TARGET>") -> DataFrame:
    """sample, split, target_row, history_rows (in order), answer: rows of the catalog instead of identifiers, for train and valid alone.

    rows: poi, row_index. Orders with an unknown target or history entity are left out (told by training_rows())."""
    asked = orders.where(F.coalesce(F.trim("query"), F.lit("")) != "").withColumn("split", split).where("split in ('train', 'valid')")
    opened = asked.select("sample", F.posexplode("history").alias("pos", "e")).select("sample", "pos", F.col("e.poi").alias("poi")).join(rows, "poi", "left")
    closed = opened.groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "row_index"))), lambda x: x["row_index"]).alias("history_rows"))
    both = asked.join(rows.select(F.col("poi").alias("target"), F.col("row_index").alias("target_row")), "target").join(closed, "sample", "left")
    out = both.withColumn("history_rows", F.coalesce("history_rows", F.array().cast("array<bigint>"))).where(~F.exists("history_rows", lambda r: r.isNull()))
    return out.select("sample", "split", "target_row", "history_rows", F.lit(placeholder).alias("answer"))


def interactions(orders: DataFrame, start: str, end: str) -> DataFrame:
    """user, poi, ts, origin: each user's history once (history) and the targets within the dates (target)."""
    events = orders.select("user", F.explode("history").alias("e")).select("user", F.col("e.poi").alias("poi"), F.col("e.event_time").alias("ts")).distinct()
    targets = orders.where(F.to_date("ts").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("user", F.col("target").alias("poi"), "ts")
    return events.withColumn("origin", F.lit("history")).unionByName(targets.withColumn("origin", F.lit("target")))


def changing_histories(orders: DataFrame) -> DataFrame:
    """user, histories: users whose rows do not all carry one and the same history."""
    return orders.groupBy("user").agg(F.count_distinct(F.xxhash64("history")).alias("histories")).where("histories > 1")


def identifier_table(codes: DataFrame, id_: str, levels: list[str], kind: str, gid: str | None = None) -> DataFrame:
    """id, codes, bucket_size, key, content of one identifier scheme.

    `collision`: levels and always a code, 0 for one row alone; `optional`: levels and, in buckets of several, <d_n>; `dedup`: tokens of
    gid and levels and, in buckets of several, <D_n>; `paired`: levels and two suffix codes, 0 for one row alone."""
    own = bucket_code(codes, ([gid] if gid else []) + levels, F.col(id_).cast("string"), -1)
    base = F.array(*[F.col(c).cast("int") for c in levels])
    n = F.col("code")
    token = lambda letter, value: F.concat(F.lit(f"<{letter}_"), value.cast("string"), F.lit(">"))
    dash = F.array_join(F.transform(base, lambda x: x.cast("string")), "-")
    numbered = F.concat(*[token(f"S{i + 1}", F.col(c)) for i, c in enumerate(levels)])
    if kind == "collision":
        full, text = F.concat(base, F.array(F.greatest(n, F.lit(0)))), F.concat(numbered, token("C", F.greatest(n, F.lit(0))))
        key = F.concat(dash, F.lit("-"), F.greatest(n, F.lit(0)).cast("string"))
    elif kind == "optional":
        full, text = F.concat(base, F.when(n >= 0, F.array(n)).otherwise(F.array().cast("array<int>"))), F.concat(
            *[token("abc"[i], F.col(c)) for i, c in enumerate(levels)],
            F.when(n >= 0, token("d", n)).otherwise(""),
        )
        key = F.concat(dash, F.when(n >= 0, F.concat(F.lit("|d"), n.cast("string"))).otherwise(""))
    elif kind == "dedup":
        places = F.regexp_replace(F.col(gid), "(.)", "<G_$1>") if gid else F.lit("")
        full, text = F.concat(base, F.array(n)), F.concat(places, numbered, F.when(n >= 0, token("D", n)).otherwise(""))
        key = F.concat(F.concat(F.col(gid), F.lit("|")) if gid else F.lit(""), dash, F.when(n >= 0, F.concat(F.lit("|d"), n.cast("string"))).otherwise(""))
    elif kind == "paired":
        pair = F.greatest(n, F.lit(0))
        high, low = F.floor(pair / 1024).cast("int"), (pair % 1024).cast("int")
        full, text = F.concat(base, F.array(high, low)), F.concat(numbered, token("R1", high), token("R2", low))
        key = F.array_join(F.transform(F.concat(base, F.array(high, low)), lambda x: x.cast("string")), "-")
    else:
        raise ValueError(kind)
    return own.select(id_, full.alias("codes"), "bucket_size", key.alias("key"), text.alias("content"))


def repeated_identifiers(table: DataFrame) -> DataFrame:
    """key, n: identifiers that name several entities; must be empty."""
    return table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def special_tokens(spark, capacities: dict[str, int], users: int = 2000) -> DataFrame:
    """kind, token: structure, geohash characters, user buckets and the codes of each level."""
    width = max(4, len(str(users - 1)))
    fixed = spark.createDataFrame([("structure", t) for t in STRUCTURE] + [("geohash", f"<G_{c}>") for c in geo.GEOHASH], "kind string, token string")
    numbered = lambda kind, form, n: spark.range(n).select(F.lit(kind).alias("kind"), F.format_string(form, "id").alias("token"))
    out = fixed.unionByName(numbered("user", f"<U_%0{width}d>", users))
    for letter, n in capacities.items():
        out = out.unionByName(numbered(letter.lower(), f"<{letter}_%d>", n))
    return out


def hashed_visitors(users: Column, buckets: int = 2000) -> Column:
    """Sorted distinct buckets of an array of user ids."""
    return F.array_sort(F.array_distinct(F.transform(users, lambda u: hashing.sha_bucket(u, buckets))))


def active_features(parts: list[tuple[Column, int]]) -> Column:
    """Places of the ones of several multi-hot blocks side by side. parts: arrays of 0-based indices with their block's size."""
    out, offset = [], 0
    for indices, size in parts:
        out.append(_shifted(indices, offset))
        offset += size
    return F.array_sort(F.concat(*out))


def _shifted(indices: Column, offset: int) -> Column:
    return F.transform(F.coalesce(indices, F.array().cast("array<bigint>")), lambda i: i.cast("long") + offset)


def prepared_features(features: DataFrame, visitors: str, others: list[str], buckets: int) -> DataFrame:
    """features of entities with any behaviour, with visitor ids as buckets."""
    some = F.size(visitors) > 0
    for c in others:
        some = some | (F.size(c) > 0)
    return features.where(some).withColumn(visitors, hashed_visitors(F.col(visitors), buckets))
