"""Lookups over catalogs and identifiers: ordered slices, checked joins, prefix buckets, legal tokens and id rewriting.

A catalog has a row index, an id and its codes. All lookups are equi-joins on keys, so nothing depends on the order in
which rows lie; where a reader needs an order, it is a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_slice(frame: DataFrame, index: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """Rows with start <= index < stop: a predicate on the index column, which Parquet prunes by its row groups' bounds."""
    rows = frame.where(F.col(index) >= start)
    return rows if stop is None else rows.where(F.col(index) < stop)


def index_holes(frame: DataFrame, index: str) -> DataFrame:
    """One row: rows, and whether the index is 0 .. rows - 1 without repeats."""
    out = frame.agg(F.count(F.lit(1)).alias("rows"), F.min(index).alias("low"), F.max(index).alias("high"), F.count_distinct(index).alias("distinct"))
    dense = (F.col("rows") == 0) | ((F.col("low") == 0) & (F.col("high") == F.col("rows") - 1) & (F.col("distinct") == F.col("rows")))
    return out.select("rows", dense.alias("dense"))


def repeated_keys(frame: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number: must be empty before a frame serves as a lookup."""
    return frame.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def lookup(requests: DataFrame, catalog: DataFrame, key: list[str], found: str = "found") -> DataFrame:
    """requests with the catalog's columns and whether there was a row; each request stays one row, as keys are unique."""
    marked = catalog.withColumn(found, F.lit(True))
    return requests.join(marked, key, "left").fillna(False, [found])


def category_index(catalog: DataFrame, order: str, category: str) -> DataFrame:
    """category, index: 0-based by the place of the category's first row; blank and null categories have none.

    Ranks are taken over the distinct categories, a vocabulary that does not grow with the catalog."""
    named = catalog.where(F.coalesce(F.trim(category), F.lit("")) != "")
    first = named.groupBy(F.col(category).alias("category")).agg(F.min(order).alias("first"))
    return first.select("category", (F.row_number().over(Window.orderBy("first", "category")) - 1).cast("int").alias("index"))


def aligned_categories(catalog: DataFrame, order: str, category: str) -> DataFrame:
    """catalog with category_index, -1 where the category is blank or missing."""
    own = category_index(catalog, order, category)
    return catalog.join(own, F.col(category) == own["category"], "left").drop(own["category"]).withColumn("category_index", F.coalesce("index", F.lit(-1))).drop("index")


def alignment_faults(left: DataFrame, right: DataFrame, index: str, columns: list[str]) -> DataFrame:
    """index, missing_left, missing_right, differs (names of columns): rows by which two aligned sources disagree."""
    a = left.select(index, F.struct(*columns).alias("a"))
    b = right.select(index, F.struct(*columns).alias("b"))
    both = a.join(b, index, "full")
    gone = F.col("a").isNull() | F.col("b").isNull()
    differs = F.filter(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) & ~gone, F.lit(c)) for c in columns]), lambda c: c.isNotNull())
    out = both.select(index, F.col("a").isNull().alias("missing_left"), F.col("b").isNull().alias("missing_right"), differs.alias("differs"))
    return out.where("missing_left or missing_right or size(differs) > 0")


def filled_vectors(nodes: DataFrame, vectors: DataFrame, id_: str, vector: str, dimensions: int) -> DataFrame:
    """nodes with their vector, all 0 where there is none, and whether its length is within 0.002 of 1 (null without one)."""
    both = nodes.join(vectors.select(id_, F.col(vector).alias("__v")), id_, "left")
    length = F.sqrt(F.aggregate("__v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    zero = F.array_repeat(F.lit(0.0), dimensions)
    return both.select(*nodes.columns, F.coalesce(F.col("__v").cast("array<double>"), zero).alias(vector), (F.abs(length - 1) <= 2e-3).alias("unit_length"))


def bucket_bounds(catalog: DataFrame, prefix: list[str], order: list[str]) -> DataFrame:
    """prefix, start, stop: where each prefix's rows lie when the catalog is sorted by `order`, which begins with prefix.

    Starts are sums of bucket sizes, so only the prefixes are ranked, within ranges of their first code."""
    n = catalog.groupBy(*prefix).agg(F.count(F.lit(1)).alias("n"))
    first = n.groupBy(prefix[0]).agg(F.sum("n").alias("n"))  # one row for each first code, a codebook's size
    base = first.select(prefix[0], F.coalesce(F.sum("n").over(Window.orderBy(prefix[0]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = Window.partitionBy(prefix[0]).orderBy(*prefix).rowsBetween(Window.unboundedPreceding, 0)
    upto = n.withColumn("upto", F.sum("n").over(within)).join(F.broadcast(base), prefix[0])
    return upto.select(*prefix, (F.col("base") + F.col("upto") - F.col("n")).alias("start"), (F.col("base") + F.col("upto")).alias("stop"))


def expand_buckets(ranked: DataFrame, catalog: DataFrame, prefix: list[str]) -> DataFrame:
    """Every row of every ranked bucket: sample, bucket_order, first_beam_rank and score of ranked, id and codes of catalog."""
    return ranked.join(catalog, prefix)


def expansion_faults(ranked: DataFrame, catalog: DataFrame, prefix: list[str], size: str) -> DataFrame:
    """Ranked buckets whose stored size is not the catalog's, or whose beam ranks do not grow with their order."""
    real = catalog.groupBy(*prefix).agg(F.count(F.lit(1)).alias("real_size"))
    before = F.lag("first_beam_rank").over(Window.partitionBy("sample").orderBy("bucket_order"))
    both = ranked.withColumn("grows", F.coalesce(F.col("first_beam_rank") > before, F.col("first_beam_rank") > 0)).join(real, prefix, "left")
    wrong = ~F.col(size).eqNullSafe(F.col("real_size"))
    return both.select("sample", "bucket_order", wrong.alias("wrong_size"), (~F.col("grows")).alias("rank_not_growing")).where("wrong_size or rank_not_growing")


def token_codes(tokens: Column, opening: int, ranges: list[tuple[int, int]]) -> Column:
    """Codes of the tokens after the opening one: token less its range's start; null for one outside its range."""
    return F.array(*[F.when(F.get(tokens, F.lit(i + 1)).between(a, b - 1), F.get(tokens, F.lit(i + 1)) - a) for i, (a, b) in enumerate(ranges)])


def parse_generated(rows: DataFrame, tokens: str, opening: int, closing: int, eos: int, ranges: list[tuple[int, int]], catalog: DataFrame) -> DataFrame:
    """rows with codes, the catalog's id, invalid_reason (the first that holds) and base codes.

    A sequence is opening, one token for each range (start, stop), closing, eos; what follows the eos is not looked at. The
    first three codes are parsed on their own, so a candidate that fails later may still name its bucket. catalog: codes
    (array), id."""
    t = F.col(tokens)
    at = F.array_position(t, eos)
    codes = token_codes(t, opening, ranges)
    bad_code = F.exists(codes, lambda c: c.isNull())
    reason = (
        F.when(at == 0, "missing_eos")
        .when(at != len(ranges) + 3, "invalid_length")
        .when((F.get(t, F.lit(0)) != opening) | (F.get(t, F.lit(len(ranges) + 1)) != closing), "invalid_structure")
        .when(bad_code, "invalid_position_token")
    )
    base = F.slice(codes, 1, 3)
    base = F.when((F.get(t, F.lit(0)) == opening) & ~F.exists(base, lambda c: c.isNull()), base)
    parsed = rows.withColumn("__r", reason).withColumn("codes", F.when(F.col("__r").isNull(), codes)).withColumn("base_codes", base)
    known = catalog.select(F.col("codes").alias("__c"), F.col("id").alias("catalog_id"))
    both = parsed.join(known, parsed["codes"] == known["__c"], "left").drop("__c")
    missing = F.col("__r").isNull() & F.col("catalog_id").isNull()
    return both.withColumn("invalid_reason", F.when(missing, "identifier_not_in_corpus").otherwise(F.col("__r"))).drop("__r")


def prefix_children(paths: DataFrame, path: str, eos: int) -> DataFrame:
    """prefix, allowed: the sorted next tokens of every prefix of a complete path; after a path, and its eos, only eos."""
    whole = paths.select(F.concat(F.col(path), F.array(F.lit(eos))).alias("p")).distinct()
    steps = F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda d: F.struct(F.slice("p", F.lit(1), d).alias("prefix"), F.get("p", d).alias("t")))
    inner = whole.select(F.explode(steps).alias("s")).groupBy("s.prefix").agg(F.array_sort(F.collect_set("s.t")).alias("allowed"))
    return inner.unionByName(whole.select(F.col("p").alias("prefix"), F.array(F.lit(eos)).alias("allowed")))


def allowed_next(requests: DataFrame, prefix: str, children: DataFrame, eos: int) -> DataFrame:
    """requests with `allowed`: null for a prefix outside the catalog. Tokens after the first eos may only be eos."""
    at = F.array_position(prefix, eos)
    tail = F.when(at > 0, F.slice(F.col(prefix), at.cast("int"), F.size(prefix)))
    fine = F.coalesce(F.forall(tail, lambda t: t == eos), F.lit(True))
    key = F.when(fine, F.when(at > 0, F.slice(F.col(prefix), F.lit(1), at.cast("int"))).otherwise(F.col(prefix)))
    return requests.withColumn("__key", key).join(children.withColumnRenamed("prefix", "__key"), "__key", "left").drop("__key")


def aligned_subset(reference: DataFrame, rows: DataFrame, key: list[str], position: str) -> DataFrame:
    """The rows that the reference names by key, with the reference's position; each key must name one row (see subset_faults)."""
    return reference.select(*key, position).join(rows, key)


def subset_faults(reference: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """key, matches: reference keys that name no row, or several."""
    n = rows.join(reference.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("matches"))
    return reference.select(*key).distinct().join(n, key, "left").fillna(0, ["matches"]).where("matches != 1")


def rewritten(rows: DataFrame, key: str, content: str, pattern: str, mapping: DataFrame) -> DataFrame:
    """key, content: group 1 of every match of pattern replaced through mapping (old, new); null if one has no new value.

    The text is cut at its matches, the pieces are joined to the mapping by position, and put together again."""
    cut = F.split(F.col(content), pattern, -1)
    ids = F.regexp_extract_all(F.col(content), F.lit(pattern), F.lit(1))
    around = F.regexp_extract_all(F.col(content), F.lit(pattern), F.lit(0))
    opened = rows.select(key, cut.alias("__cut"), F.posexplode_outer(F.arrays_zip(ids.alias("old"), around.alias("whole"))).alias("pos", "m"))
    both = opened.select(key, "__cut", "pos", F.col("m.old").alias("old"), F.col("m.whole").alias("whole")).join(mapping, "old", "left")
    there = F.col("pos").isNotNull()
    parts = F.array_sort(F.collect_list(F.when(there, F.struct("pos", F.replace(F.col("whole"), F.col("old"), F.col("new")).alias("t")))))
    per = both.groupBy(key).agg(F.first("__cut").alias("__cut"), parts.alias("__t"), F.count_if(there & F.col("new").isNull()).alias("__missing"))
    joined = F.array_join(F.transform("__cut", lambda c, i: F.concat(c, F.coalesce(F.get(F.col("__t"), i)["t"], F.lit("")))), "")
    return per.select(key, F.when(F.col("__missing") == 0, joined).alias(content))
