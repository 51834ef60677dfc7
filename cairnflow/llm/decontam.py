"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A benchmark item gives its windows of 10 consecutive words; an item of fewer is one window. Windows of one
length m are searched together: the scan looks at the block of the two words that end at its place. A block that no
window holds lets it jump m - 1 words, one that windows hold only before their end jumps to the nearest place
where a window can end, and a block that ends windows opens a bucket of them by suffix hash, which direct
comparison of all m words confirms. Every word inside any occurrence is hit, and the items with occurrences are named.

The windows are broadcast in parts of at most `part_words` words each; a longer item is cut into overlapping pieces. The
documents pass once: a task takes some thousand rows through the tables of one part after another, so memory is bounded whatever
the benchmark's size and the result is whole.

Nulls and texts without words have no hits; items without words or without an id match nothing. Items of one id
count once; items alike under different ids all count. Empty tables give empty or clean results; other columns
of the documents pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnflow.llm.common import LOWER_ASCII, SLICE, map_rows, set_aside, utf8

WINDOW = 10
PART_WORDS = 200_000
#: A-Z lower-cased; every byte that no word holds becomes a space.
WORD_BYTES = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in LOWER_ASCII)

HITS = T.StructType([T.StructField("__n_words", T.LongType()), T.StructField("__hits", T.ArrayType(T.LongType())), T.StructField("__items", T.ArrayType(T.StringType()))])


def words(text: str | None) -> list[bytes]:
    return utf8(text).translate(WORD_BYTES).split()


class Matcher:
    """Wu-Manber tables of windows of one length: {window: item ids}."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]]):
        self.m = m = len(next(iter(windows)))
        self.block = b = min(2, m)
        self.shift: dict = {}
        self.buckets: dict = {}
        for window, items in windows.items():
            for end in range(b, m + 1):
                key = window[end - b : end] if b > 1 else window[end - 1]
                self.shift[key] = min(self.shift.get(key, m), m - end)
            self.buckets.setdefault(key, {})[window] = tuple(items)

    def search(self, w: list[bytes]) -> list[tuple[int, tuple[str, ...]]]:
        """(start, item ids) of each occurrence."""
        m, out, at, n = self.m, [], self.m - 1, len(w)
        shift, buckets = self.shift.get, self.buckets
        if self.block == 1:
            for at, word in enumerate(w):
                if word in buckets:
                    out.append((at, buckets[word][(word,)]))
            return out
        skip = m - 1
        while at < n:
            key = (w[at - 1], w[at])
            step = shift(key, skip)
            if step:
                at += step
                continue
            begin = at - m + 1
            items = buckets[key].get(tuple(w[begin : at + 1]))
            if items is not None:
                out.append((begin, items))
            at += 1
        return out


def matchers(items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW) -> list[Matcher]:
    by: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for name, w in items:
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            by.setdefault(m, {}).setdefault(tuple(w[i : i + m]), set()).add(name)
    return [Matcher(by[m]) for m in sorted(by)]


def hits_of(w: list[bytes], tables: list[Matcher], before: list[int], named: list[str]) -> tuple[list[int], list[str]]:
    """Merged intervals (start, end, start, end, ...) and item ids, with those of earlier parts."""
    spans = list(zip(before[::2], before[1::2], strict=True))
    items = set(named)
    for t in tables:
        for start, names in t.search(w):
            spans.append((start, start + t.m))
            items.update(names)
    if len(spans) > 1:
        spans.sort()
        merged = [spans[0]]
        for a, b in spans[1:]:
            if a <= merged[-1][1]:
                if b > merged[-1][1]:
                    merged[-1] = (merged[-1][0], b)
            else:
                merged.append((a, b))
        spans = merged
    return [x for s in spans for x in s], sorted(items)


def parts_of(benchmark: DataFrame, part_words: int, window: int = WINDOW):
    """(id, words) in parts of at most part_words words (or one window), streamed to the driver one partition at a time.

    An item of more words comes in pieces that share window - 1 words, so every window lies in one piece."""
    part, size, step = [], 0, max(1, part_words - window + 1)
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("i is not null and t is not null")
    for row in rows.toLocalIterator():
        whole = words(row["t"])
        for at in range(0, max(1, len(whole) - window + 1), step):
            w = whole[at : at + step + window - 1]
            if part and size + len(w) > part_words:
                yield part
                part, size = [], 0
            part.append((row["i"], w))
            size += len(w)
    yield part


def search(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """docs with __n_words, __hits (merged intervals of hit words) and __items (ids of items with occurrences)."""
    sc = docs.sparkSession.sparkContext
    parts = [sc.broadcast(part) for part in parts_of(benchmark, part_words, window)]

    def work():
        only = matchers(parts[0].value, window) if len(parts) == 1 else None

        def rows(texts):
            lists = [words(t) for t in texts]
            found: list[tuple[list[int], list[str]]] = [([], []) for _ in texts]
            for shared in parts:
                tables = only or matchers(shared.value, window)
                found = [hits_of(w, tables, *before) for w, before in zip(lists, found, strict=True)]
                if len(parts) > 1:  # one part's tables at a time
                    vars(shared).pop("_value", None)
            return [list(map(len, lists)), [hits for hits, _ in found], [items for _, items in found]]

        return rows

    return map_rows(docs, ["text"], HITS, work, keep, SLICE if len(parts) == 1 else 8 * SLICE)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit word, with all their columns."""
    rows, back = set_aside(docs, "text")
    return back(search(rows, benchmark, **options).where(F.size("__hits") == 0))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    found = search(docs, benchmark, keep=["doc_id"], **options)
    # intervals are start, end, start, end, ...: ends less starts
    n_hit = F.aggregate(F.transform("__hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "__items"), 256).alias("items_sha256"),
        (F.size("__hits") > 0).alias("contaminated"),
    )
