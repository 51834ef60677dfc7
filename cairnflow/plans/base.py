"""Registry of queries and the tables they stand on.

The test tables have no search log or entity catalog, so a log, its categories, codes, points and rankings are derived from
the star schema, events and embeddings by fixed arithmetic, once as DataFrames and once as SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a (spark, sf_dir) function, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(frame: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, as the order of their sums differs between engines."""
    return frame.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in frame.dtypes])


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, poi, raw, ts, user: lineitem as choices of entities for queries, with a favourite for most queries."""
    li = table(spark, sf_dir, "lineitem")
    k = F.when(F.col("l_suppkey") % 10 < 7, 0).otherwise(F.col("l_suppkey") % (1 + F.col("l_partkey") % 7))
    poi = k * 13 + F.col("l_partkey") % 11
    return li.select(
        F.concat(F.lit("q"), F.col("l_partkey").cast("string")).alias("query"),
        F.concat(F.lit("p"), poi.cast("string")).alias("poi"),
        F.concat(F.lit("Q"), F.col("l_partkey").cast("string"), F.col("l_returnflag")).alias("raw"),
        F.col("l_shipdate").alias("ts"),
    )


LOG = """log AS (SELECT 'q' || l_partkey AS query, 'p' || ((CASE WHEN l_suppkey % 10 < 7 THEN 0 ELSE l_suppkey % (1 + l_partkey % 7) END) * 13 + l_partkey % 11) AS poi, 'Q' || l_partkey || l_returnflag AS raw, l_shipdate AS ts FROM lineitem)"""
PAIRS = LOG + ", pairs AS (SELECT query, poi, count(*) AS n FROM log GROUP BY ALL)"


def categories(pairs: DataFrame) -> DataFrame:
    n = F.substring("poi", 2, 20).cast("long")
    return pairs.select("poi").distinct().select("poi", F.concat(F.lit("f"), (n % 9).cast("string")).alias("fine"), F.concat(F.lit("c"), (n % 3).cast("string")).alias("coarse"))


CATEGORIES = "cat AS (SELECT DISTINCT poi, 'f' || (CAST(substr(poi, 2) AS BIGINT) % 9) AS fine, 'c' || (CAST(substr(poi, 2) AS BIGINT) % 3) AS coarse FROM pairs)"

PROFILE = (
    PAIRS
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, poi) AS r, sum(n) OVER (PARTITION BY query) AS total FROM pairs),
per AS (SELECT query, CAST(sum(n) AS BIGINT) AS query_count, count(*) AS distinct_poi_count, max(CASE WHEN r = 1 THEN poi END) AS top1_poi_id,
max(n) AS top1_count, max(n) / sum(n) AS top1_share,
  coalesce(max(CASE WHEN r = 2 THEN n END), 0) / sum(n) AS top2_share,
CASE WHEN count(*) > 1 THEN -sum(n / total * ln(n / total)) ELSE 0.0 END AS entropy FROM ranked GROUP BY query),
prof0 AS (SELECT *, CASE WHEN distinct_poi_count > 1 THEN entropy / ln(distinct_poi_count) ELSE 0.0 END AS normalized_entropy,
top1_share - top2_share AS margin FROM per),
prof1 AS (SELECT *, query_count >= 2 AND top1_count >= 2 AND top1_share >= 0.75 AND margin >= 0.25 AND normalized_entropy <= 0.55 AS is_high_confidence FROM prof0),
profile AS (SELECT *, CASE WHEN is_high_confidence THEN greatest(0.0, least(ln(1 + top1_count),
ln(21.0)) * top1_share * top1_share * (1 - normalized_entropy)) ELSE 0.0 END AS sid_weight FROM prof1)"""
)

SUPERVISED = (
    PROFILE
    + ", "
    + CATEGORIES
    + """, fc AS (SELECT query, fine, sum(n) AS n FROM pairs JOIN cat USING (poi) GROUP BY ALL),
cc AS (SELECT query, coarse, sum(n) AS n FROM pairs JOIN cat USING (poi) GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, fine) AS r, sum(n) OVER (PARTITION BY query) AS t FROM fc),
cr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, coarse) AS r, sum(n) OVER (PARTITION BY query) AS t FROM cc),
fd AS (SELECT query, max(CASE WHEN r = 1 THEN fine END) AS dominant_fine, max(n) / max(t) AS fine_concentration,
CASE WHEN count(*) > 1 THEN -sum(n / t * ln(n / t)) / ln(count(*)) ELSE 0.0 END AS fine_entropy FROM fr GROUP BY query),
cd AS (SELECT query, max(CASE WHEN r = 1 THEN coarse END) AS dominant_coarse, max(n) / max(t) AS coarse_concentration,
CASE WHEN count(*) > 1 THEN -sum(n / t * ln(n / t)) / ln(count(*)) ELSE 0.0 END AS coarse_entropy FROM cr GROUP BY query),
sup0 AS (SELECT *, ln(1 + least(query_count, 20)) / ln(21.0) AS support_score,
  CASE WHEN is_high_confidence THEN 3 WHEN query_count >= 3 AND fine_concentration >= 0.80 AND fine_entropy <= 0.40 THEN 2 WHEN query_count >= 3 AND
coarse_concentration >= 0.85 AND coarse_entropy <= 0.35 THEN 1 ELSE 0 END AS supervision_depth
  FROM profile JOIN fd USING (query) JOIN cd USING (query)),
sup AS (SELECT *, greatest(0.0, least(1.0, support_score * coarse_concentration * greatest(0.0, 1 - coarse_entropy))) AS s1_reliability, greatest(0.0,
least(1.0, support_score * fine_concentration * greatest(0.0, 1 - fine_entropy))) AS s2_reliability,
  greatest(0.0, least(1.0, support_score * top1_share * greatest(0.0, 1 - normalized_entropy))) AS s3_reliability FROM sup0)"""
)

EDGES = (
    SUPERVISED
    + """, kept AS (SELECT p.query, p.poi, p.n, s.supervision_depth, c.fine, c.coarse, [s1_reliability, s2_reliability, s3_reliability] AS rel,
sum(p.n) OVER (PARTITION BY p.query) AS t
  FROM pairs p JOIN cat c USING (poi) JOIN sup s USING (query)
WHERE (supervision_depth = 3 AND poi = top1_poi_id) OR (supervision_depth = 2 AND fine = dominant_fine) OR (supervision_depth = 1 AND coarse =
dominant_coarse)),
edges AS (SELECT query, poi, n, supervision_depth, CAST(layer AS INTEGER) AS layer, fine, coarse, n / t AS edge_probability,
rel[layer] AS query_reliability, n / t * rel[layer] AS edge_weight FROM (SELECT *, unnest(range(1, supervision_depth + 1)) AS layer FROM kept))"""
)


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, s1, s2, s3 and a second coding t3: sign bits of three dimensions a level."""
    e = table(spark, sf_dir, "embeddings")
    bits = lambda a: sum((F.when(F.get("embedding", F.lit(a + i)) > 0, 1 << (2 - i)).otherwise(0) for i in range(3)), F.lit(0)).cast("int")
    return e.select("vec_id", "label", bits(0).alias("s1"), bits(3).alias("s2"), bits(6).alias("s3"), bits(9).alias("t3"))


def _bits(a: int) -> str:
    return "CAST(" + " + ".join(f"CASE WHEN embedding[{a + i + 1}] > 0 THEN {1 << (2 - i)} ELSE 0 END" for i in range(3)) + " AS INTEGER)"


CODES = f"codes AS (SELECT vec_id, label, {_bits(0)} AS s1, {_bits(3)} AS s2, {_bits(6)} AS s3, {_bits(9)} AS t3 FROM embeddings)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lng, lat, nation: suppliers at places given by their keys."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.alias("id"), (116.0 + (k * 7919 % 1000) / 1000.0).alias("lng"), (39.5 + (k * 104729 % 1000) / 1000.0).alias("lat"), F.col("s_nationkey").alias("nation"))


POINTS = "points AS (SELECT s_suppkey AS id, 116.0 + (s_suppkey * 7919 % 1000) / 1000.0 AS lng, 39.5 + (s_suppkey * 104729 % 1000) / 1000.0 AS lat, s_nationkey AS nation FROM supplier)".replace("1000.0 AS", "CAST(1000 AS DOUBLE) AS").replace("116.0", "CAST(116 AS DOUBLE)").replace("39.5", "CAST(39.5 AS DOUBLE)")

KNN = """knn AS (SELECT q.vec_id AS query_id, q.label AS query_label, b.vec_id AS id, b.label AS label, list_inner_product(q.embedding::DOUBLE[],
b.embedding::DOUBLE[]) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank
FROM embeddings q, embeddings b WHERE q.vec_id % 20 = 0)"""
