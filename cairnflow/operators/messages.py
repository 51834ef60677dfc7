"""Orders with nested history to training messages: validation, splits, prompts, budgets and id rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: History event as the prompt needs it.
HISTORY = "array<struct<event_time:timestamp,query:string,poi:string>>"


def time_split(day: Column, train_start: str, train_end: str, valid: str, test: str) -> Column:
    """train, valid or test by date; null for a date that belongs to none (an error for the caller to count)."""
    if not train_start <= train_end < valid < test:
        raise ValueError("train must end before valid, valid before test")
    d = lambda x: F.lit(x).cast("date")
    return F.when(day.between(d(train_start), d(train_end)), "train").when(day == d(valid), "valid").when(day == d(test), "test")


def parsed_time(text: Column) -> Column:
    """First 19 characters with `T` as a space; null where that is no time."""
    return F.try_to_timestamp(F.replace(F.substring(text, 1, 19), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss"))


def history_faults(history: Column, declared: Column, current: Column, start: Column, end: Column, most: int) -> Column:
    """Names of the rules a history breaks: length, most, window, not before the current time, order, missing id."""
    times = F.transform(history, lambda e: e["event_time"])
    pairs = F.zip_with(F.slice(times, F.lit(1), F.greatest(F.size(times) - 1, F.lit(0))), F.slice(times, F.lit(2), F.greatest(F.size(times) - 1, F.lit(0))), lambda a, b: a <= b)
    checks = {
        "length": F.size(history) != declared,
        "too_long": F.size(history) > most,
        "outside_window": ~F.forall(times, lambda t: F.to_date(t).between(start, end)),
        "not_before_current": ~F.forall(times, lambda t: t < current),
        "out_of_order": ~F.forall(pairs, lambda ok: ok),
        "missing_id": F.exists(history, lambda e: e["poi"].isNull() | (F.trim(e["poi"]) == "")),
    }
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())


def collect_history(events: DataFrame, user: str, time: str, id_: str, most: int, fields: tuple[str, ...] = ("query", "poi")) -> DataFrame:
    """Each event with the user's last `most` earlier events, oldest first; equal times are not earlier.

    Of each time the last `most` events are collected once, and the `most` times before an event's own hold its history."""
    last = Window.partitionBy(user, time).orderBy(F.desc(id_))
    event = F.struct(F.col(time).alias("event_time"), *fields)
    ranked = events.where(F.col(time).isNotNull()).select(
        F.col(user).alias("__user"),
        F.col(time).alias("__time"),
        event.alias("e"),
        F.row_number().over(last).alias("r"),
    ).where(F.col("r") <= most)
    times = ranked.groupBy("__user", "__time").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("r")).alias("r"), "e"))), lambda x: x["e"]).alias("es"))
    before = F.flatten(F.collect_list("es").over(Window.partitionBy("__user").orderBy("__time").rowsBetween(-most, -1)))
    history = times.select("__user", "__time", F.slice(before, F.greatest(F.size(before) - most + 1, F.lit(1)), F.lit(most)).alias("history"))
    both = events.join(history, F.col(user).eqNullSafe(F.col("__user")) & (F.col(time) == F.col("__time")), "left")
    return both.select(*[events[c] for c in events.columns], F.coalesce("history", F.array().cast(history.schema["history"].dataType)).alias("history"))


def prompt(query: Column, gid: Column, history: Column, user: Column | None = None) -> Column:
    """<HISTORY> events in order, then the <CURRENT> block; with the user's token where given."""
    line = lambda e: F.concat(F.lit("<EVENT><QUERY>"), e["query"], F.lit("</QUERY><POI>"), e["poi"], F.lit("</POI></EVENT>"))
    events = F.array_join(F.transform(history, line), "\n")
    head = F.when(F.size(history) > 0, F.concat(F.lit("<HISTORY>\n"), events, F.lit("\n</HISTORY>\n"))).otherwise(F.lit(""))
    current = F.concat(F.lit("<CURRENT>\n<USER_GID>"), gid, F.lit("</USER_GID>\n<QUERY>"), query, F.lit("</QUERY>\n</CURRENT>"))
    return F.concat(*([] if user is None else [user, F.lit("\n")]), head, current)


def current_fields(content: Column) -> tuple[Column, Column]:
    """(query, gid) of the CURRENT block alone."""
    block = F.regexp_extract(content, r"(?s)<CURRENT>(.*)</CURRENT>", 1)
    return F.regexp_extract(block, r"(?s)<QUERY>(.*)</QUERY>", 1), F.regexp_extract(block, r"<USER_GID>(.*?)</USER_GID>", 1)


def confined(content: Column, target: Column) -> Column:
    """Whether the target's text occurs, if at all, only in the id fields of history events."""
    return ~F.contains(F.regexp_replace(content, r"(?s)<POI>.*?</POI>", ""), target)


def messages(user_content: Column, assistant_content: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), user_content.alias("content")), F.struct(F.lit("assistant").alias("role"), assistant_content.alias("content")))


def fit_history(events: DataFrame, sample: str, position: str, length: str, budget: Column) -> DataFrame:
    """Events that stay when the oldest go first until the rest fits the budget; position grows with time."""
    w = Window.partitionBy(sample).orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("__run", F.sum(length).over(w)).where(F.col("__run") <= budget).drop("__run")


def remap(rows: DataFrame, key: str, ids: str, mapping: DataFrame) -> DataFrame:
    """key, ids: an array of old ids rewritten by position through (old, new); null where an id has no new one."""
    opened = rows.select(key, F.posexplode_outer(ids).alias("pos", "old"))
    both = opened.join(mapping, "old", "left")
    again = F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "new")))), lambda s: s["new"])
    return both.groupBy(key).agg(again.alias(ids))


def turn_pairs(turns: DataFrame) -> DataFrame:
    """conv_id, turn, prompt, reply: every user turn with the assistant turn right after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = turns.withColumn("next_role", F.lead("role").over(w)).withColumn("reply", F.lead("text").over(w))
    return nxt.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prompt"), "reply")
