"""Lookups, prefix buckets, legal tokens and aligned sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnflow.operators import lookups
from cairnflow.plans.base import CODES, KNN, codes, query, table
from cairnflow.plans.vector_queries import neighbours

S = ["s1", "s2", "s3"]


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 4000")
def ordered_scan(spark, sf):
    return lookups.ordered_slice(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000, 4000)


@query("SELECT count(*) AS rows, min(o_orderkey) = 0 AND max(o_orderkey) = count(*) - 1 AND count(DISTINCT o_orderkey) = count(*) AS dense FROM orders")
def index_is_dense(spark, sf):
    return lookups.index_holes(table(spark, sf, "orders"), "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_lookup_keys(spark, sf):
    return lookups.repeated_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


_REQUESTS = "r AS (SELECT event_id, CAST(user_id * 3 AS BIGINT) AS c_custkey FROM events WHERE user_id IS NOT NULL)"


@query(f"WITH {_REQUESTS} SELECT event_id, c_custkey, c_name, c_custkey IN (SELECT c_custkey FROM customer) AS found FROM r LEFT JOIN customer USING (c_custkey)")
def id_lookup(spark, sf):
    r = table(spark, sf, "events").where("user_id is not null").select("event_id", (F.col("user_id") * 3).alias("c_custkey"))
    return lookups.lookup(r, table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_custkey"]).select("event_id", "c_custkey", "c_name", "found")


@query(
    """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE source END AS source FROM documents),
f AS (SELECT source, row_number() OVER (ORDER BY min(doc_id), source) - 1 AS i FROM d WHERE trim(coalesce(source, '')) <> '' GROUP BY source)
SELECT doc_id, CAST(coalesce(i, -1) AS INTEGER) AS category_index FROM d LEFT JOIN f USING (source)"""
)
def category_first_index(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, " ").otherwise(F.col("source")).alias("source"))
    return lookups.aligned_categories(d, "doc_id", "source").select("doc_id", "category_index")


@query(
    """WITH a AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s FROM orders WHERE o_orderkey % 97 <> 1),
b AS (SELECT o_orderkey AS k, o_custkey + (o_orderkey % 89 = 5)::INTEGER AS c, nullif(o_orderstatus,
CASE WHEN o_orderkey % 83 = 7 THEN o_orderstatus END) AS s FROM orders WHERE o_orderkey % 97 <> 2),
j AS (SELECT coalesce(a.k, b.k) AS k, a.k IS NULL AS missing_left, b.k IS NULL AS missing_right, a.c IS DISTINCT FROM b.c AS dc, a.s IS DISTINCT
FROM b.s AS ds FROM a FULL JOIN b ON a.k = b.k)
SELECT k, missing_left, missing_right, CASE WHEN missing_left OR missing_right THEN '' ELSE concat_ws(',', CASE WHEN dc THEN 'c' END,
CASE WHEN ds THEN 's' END) END AS differs FROM j WHERE missing_left OR missing_right OR dc OR ds"""
)
def alignment_faults(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"))
    other = o.select("k", (F.col("c") + (F.col("k") % 89 == 5).cast("int")).alias("c"), F.when(F.col("k") % 83 != 7, F.col("s")).alias("s"))
    out = lookups.alignment_faults(o.where("k % 97 != 1"), other.where("k % 97 != 2"), "k", ["c", "s"])
    return out.withColumn("differs", F.array_join("differs", ","))


@query(
    """WITH n AS (SELECT p_partkey AS vec_id FROM part)
SELECT vec_id, round(list_sum(coalesce(embedding, list_transform(range(64), lambda x: 0.0))::DOUBLE[]), 6) AS total,
abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 0.002 AS unit_length FROM n LEFT JOIN embeddings USING (vec_id)"""
)
def filled_vectors(spark, sf):
    n = table(spark, sf, "part").select(F.col("p_partkey").alias("vec_id"))
    out = lookups.filled_vectors(n, table(spark, sf, "embeddings"), "vec_id", "embedding", 64)
    return out.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), "unit_length")


@query(f"""WITH {CODES}, r AS (SELECT *, row_number() OVER (ORDER BY s1, s2, s3, vec_id) - 1 AS i FROM codes) SELECT s1, s2, min(i) AS start, max(i) + 1 AS stop
FROM r GROUP BY s1, s2""")
def bucket_bounds(spark, sf):
    return lookups.bucket_bounds(codes(spark, sf), ["s1", "s2"], [*S, "vec_id"])


_RANKED = f"""{KNN}, {CODES}, f AS (SELECT query_id AS sample, s1, s2, s3, CAST(min(rank) AS INTEGER) AS first_beam_rank FROM knn
JOIN codes ON codes.vec_id = knn.id WHERE rank <= 10 GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY sample ORDER BY first_beam_rank) AS INTEGER) AS bucket_order FROM f)"""


def ranked_buckets(spark, sf):
    from pyspark.sql import Window

    n = neighbours(spark, sf, 10).join(codes(spark, sf).withColumnRenamed("vec_id", "id").drop("label"), "id")
    f = n.groupBy(F.col("query_id").alias("sample"), *S).agg(F.min("rank").alias("first_beam_rank"))
    return f.withColumn("bucket_order", F.row_number().over(Window.partitionBy("sample").orderBy("first_beam_rank")))


@query(f"WITH {_RANKED} SELECT sample, bucket_order, first_beam_rank, vec_id FROM ranked JOIN codes USING (s1, s2, s3)")
def expand_buckets(spark, sf):
    return lookups.expand_buckets(ranked_buckets(spark, sf), codes(spark, sf), S).select("sample", "bucket_order", "first_beam_rank", "vec_id")


@query(
    f"""WITH {_RANKED}, z AS (SELECT s1, s2, s3, count(*) AS n FROM codes GROUP BY ALL), g AS (SELECT *, n + (sample % 3 = 0)::INTEGER AS stored,
CASE WHEN sample % 7 = 0 THEN 1 ELSE first_beam_rank END AS b FROM ranked JOIN z USING (s1, s2, s3)), l AS (SELECT *, lag(b) OVER (PARTITION BY sample
ORDER BY bucket_order) AS p FROM g)
SELECT sample, bucket_order, stored <> n AS wrong_size, NOT coalesce(b > p, b > 0) AS rank_not_growing FROM l WHERE stored <> n OR NOT coalesce(b > p, b > 0)"""
)
def expansion_faults(spark, sf):
    sizes = codes(spark, sf).groupBy(*S).agg(F.count(F.lit(1)).alias("n"))
    r = ranked_buckets(spark, sf).join(sizes, S).withColumn("stored", F.col("n") + (F.col("sample") % 3 == 0).cast("int")).drop("n")
    r = r.withColumn("first_beam_rank", F.when(F.col("sample") % 7 == 0, 1).otherwise(F.col("first_beam_rank")))
    return lookups.expansion_faults(r, codes(spark, sf), S, "stored")


#: Generated sequences: token 1 opens, 2 closes, 3 ends; codes from 10, 20, 30 and 40.
_GENERATED = f"""{CODES}, cat AS (SELECT s1, s2, s3, t3, min(vec_id) AS id FROM codes GROUP BY ALL),
g AS (SELECT vec_id, CASE vec_id % 8 WHEN 1 THEN [1, 10 + s1, 20 + s2, 30 + s3, 40 + t3, 2] WHEN 2 THEN [1, 10 + s1, 20 + s2, 30 + s3, 2,
3] WHEN 3 THEN [9, 10 + s1, 20 + s2, 30 + s3, 40 + t3, 2, 3]
WHEN 4 THEN [1, 10 + s1, 20 + s2, 50 + s3, 40 + t3, 2, 3] WHEN 5 THEN [1, 10 + s2, 20 + s1, 30 + t3, 40 + s3, 2, 3] ELSE [1, 10 + s1, 20 + s2,
30 + s3, 40 + t3, 2, 3, 0, 0] END AS t FROM codes),
p AS (SELECT *, coalesce(list_position(t, 3), 0) AS e,
CASE WHEN e = 0 THEN 'missing_eos' WHEN e <> 7 THEN 'invalid_length' WHEN t[1] <> 1 OR t[6] <> 2 THEN 'invalid_structure'
WHEN t[2] NOT BETWEEN 10 AND 17 OR t[3] NOT BETWEEN 20 AND 27 OR t[4] NOT BETWEEN 30 AND 37 OR t[5] NOT BETWEEN 40 AND 47 THEN
'invalid_position_token' END AS r FROM g)"""


@query(
    f"""WITH {_GENERATED} SELECT p.vec_id, cat.id AS catalog_id, CASE WHEN r IS NULL AND cat.id IS NULL THEN 'identifier_not_in_corpus' ELSE r END AS invalid_reason,
CASE WHEN t[1] = 1 AND t[2] BETWEEN 10 AND 17 AND t[3] BETWEEN 20 AND 27 AND t[4] BETWEEN 30 AND 37 THEN (t[2] - 10) || '-' || (t[3] - 20) || '-' ||
(t[4] - 30) END AS base
FROM p LEFT JOIN cat ON r IS NULL AND cat.s1 = t[2] - 10 AND cat.s2 = t[3] - 20 AND cat.s3 = t[4] - 30 AND cat.t3 = t[5] - 40"""
)
def parse_generated(spark, sf):
    c = codes(spark, sf)
    catalog = c.groupBy(*S, "t3").agg(F.min("vec_id").alias("id")).select(F.array(*S, "t3").alias("codes"), "id")
    full = lambda a, b, d, e: F.array(F.lit(1), 10 + a, 20 + b, 30 + d, 40 + e, F.lit(2), F.lit(3))
    own = [F.col(x) for x in (*S, "t3")]
    shapes = {
        1: F.slice(full(*own), 1, 6),
        2: F.concat(F.slice(full(*own), 1, 4), F.array(F.lit(2), F.lit(3))),
        3: F.concat(F.array(F.lit(9)), F.slice(full(*own), 2, 6)),
        4: full(own[0], own[1], own[2] + 20, own[3]),
        5: full(own[1], own[0], own[3], own[2]),
    }
    t = F.concat(full(*own), F.array(F.lit(0), F.lit(0)))
    for k, shape in shapes.items():
        t = F.when(F.col("vec_id") % 8 == k, shape).otherwise(t)
    ranges = [(10, 18), (20, 28), (30, 38), (40, 48)]
    out = lookups.parse_generated(c.select("vec_id", t.alias("t")), "t", 1, 2, 3, ranges, catalog)
    return out.select("vec_id", "catalog_id", "invalid_reason", F.array_join(F.transform("base_codes", lambda x: x.cast("string")), "-").alias("base"))


@query(
    f"""WITH {CODES}, p AS (SELECT DISTINCT [1, 10 + s1, 20 + s2, 30 + s3, 2, 3] AS p FROM codes), s AS (SELECT list_slice(p, 1, d) AS prefix, p[d + 1] AS t
FROM p, range(0, 6) r(d)),
c AS (SELECT prefix, list_sort(list(DISTINCT t)) AS allowed FROM s GROUP BY prefix UNION ALL SELECT p, [3] FROM p),
q AS (SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN [1] WHEN 1 THEN [1, 10 + s1, 20 + s2] WHEN 2 THEN [1, 10 + s1, 20 + s2, 30 + s3, 2, 3,
3] WHEN 3 THEN [1, 10 + s1, 20 + s2, 30 + s3, 2, 3, 4] ELSE [1, 10 + s1, 20 + t3, 30 + s3] END AS t FROM codes)
SELECT vec_id, array_to_string(allowed, ',') AS allowed FROM q LEFT
JOIN c ON c.prefix = CASE WHEN t = [] THEN NULL WHEN list_position(t, 3) IS NULL THEN t WHEN list_contains(list_slice(t, 7, 99),
4) THEN NULL ELSE list_slice(t, 1, list_position(t, 3)) END"""
)
def legal_next_tokens(spark, sf):
    c = codes(spark, sf)
    path = F.array(F.lit(1), 10 + F.col("s1"), 20 + F.col("s2"), 30 + F.col("s3"), F.lit(2))
    children = lookups.prefix_children(c.select(path.alias("p")), "p", 3)
    k = F.col("vec_id") % 5
    tail = lambda last: F.concat(path, F.array(F.lit(3), F.lit(last)))
    asked = F.when(k == 0, F.array(F.lit(1))).when(k == 1, F.slice(path, 1, 3)).when(k == 2, tail(3)).when(k == 3, tail(4)).otherwise(F.array(F.lit(1), 10 + F.col("s1"), 20 + F.col("t3"), 30 + F.col("s3")))
    out = lookups.allowed_next(c.select("vec_id", asked.alias("t")), "t", children, 3)
    return out.select("vec_id", F.array_join(F.transform("allowed", lambda x: x.cast("string")), ",").alias("allowed"))


_REFERENCE = "ref AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY sha256(o_orderkey::VARCHAR)) AS position FROM orders WHERE o_orderkey % 11 = 3)"


@query(f"WITH {_REFERENCE} SELECT l_orderkey AS k, position, l_linenumber, l_partkey FROM lineitem JOIN ref ON k = l_orderkey WHERE l_quantity > 45")
def aligned_subset(spark, sf):
    return lookups.aligned_subset(reference(spark, sf), lines(spark, sf), ["k"], "position").select("k", "position", "l_linenumber", "l_partkey")


@query(f"""WITH {_REFERENCE}, n AS (SELECT k, count(l_orderkey) AS matches FROM ref LEFT JOIN lineitem ON l_orderkey = k AND l_quantity > 45 GROUP BY k)
SELECT k, matches FROM n WHERE matches <> 1""")
def aligned_subset_faults(spark, sf):
    return lookups.subset_faults(reference(spark, sf), lines(spark, sf), ["k"])


def reference(spark, sf):
    from cairnflow.operators.querystats import dense_ids

    o = table(spark, sf, "orders").where("o_orderkey % 11 = 3").select(F.col("o_orderkey").alias("k"))
    h = o.withColumn("h", F.sha2(F.col("k").cast("string"), 256))
    return h.join(dense_ids(h, ["h"], "i"), "h").select("k", (F.col("i") + 1).alias("position"))


def lines(spark, sf):
    return table(spark, sf, "lineitem").where("l_quantity > 45").withColumnRenamed("l_orderkey", "k")


@query(
    """WITH m AS (SELECT p_partkey::VARCHAR AS old, 'n' || (p_partkey * 7 % 1000) AS new FROM part WHERE p_partkey % 50 <> 0),
l AS (SELECT l_orderkey, l_linenumber, l_partkey::VARCHAR AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem)
SELECT l_orderkey, CASE WHEN count(*) = count(new) THEN 'seen ' || string_agg('<P>' || new || '</P>', ' then ' ORDER BY r) || ' end' END AS content
FROM l LEFT JOIN m ON m.old = l.p GROUP BY l_orderkey"""
)
def rewritten_ids(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))),
        lambda s: F.concat(F.lit("<P>"), s["l_partkey"].cast("string"), F.lit("</P>")),
    ).alias("ids"))
    rows = li.select("l_orderkey", F.concat(F.lit("seen "), F.array_join("ids", " then "), F.lit(" end")).alias("content"))
    mapping = table(spark, sf, "part").where("p_partkey % 50 != 0").select(
        F.col("p_partkey").cast("string").alias("old"),
        F.concat(F.lit("n"), (F.col("p_partkey") * 7 % 1000).cast("string")).alias("new"),
    )
    return lookups.rewritten(rows, "l_orderkey", "content", "<P>([0-9]+)</P>", mapping)


