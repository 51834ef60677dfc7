"""Assets, encoders, scalar forms and geographic features."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnflow.functions import geo, hashing, text, tokens
from cairnflow.functions import vector as V
from cairnflow.operators import assets
from cairnflow.plans.base import CODES, PAIRS, POINTS, SUPERVISED, codes, points, query, rounded, table
from cairnflow.plans.log_queries import supervised_of
from cairnflow.plans.quantizer_queries import views, words
from cairnflow.plans.vector_queries import _geohash_sql


@query()
def encoded_texts(spark, sf):
    """Vectors of a hashing encoder over whole texts (a test holds it to the encoder itself)."""
    d = table(spark, sf, "benchmark")
    return assets.encoded(d, "item_id", "text", assets.hashing_encoder(16))


@query("SELECT o_orderkey, o_orderkey % 9 AS part FROM orders WHERE o_orderkey % 9 NOT IN (2, 5)")
def pending_parts(spark, sf):
    done = spark.createDataFrame([(2,), (5,)], "part long")
    return assets.pending(table(spark, sf, "orders").select("o_orderkey"), done, F.col("o_orderkey") % 9).select("o_orderkey", "part")


@query(
    """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 50 = 1 THEN list_slice(embedding::DOUBLE[], 1,
63) WHEN vec_id % 50 = 2 THEN list_transform(embedding::DOUBLE[], lambda x: 0.0) WHEN vec_id % 50 = 3 THEN list_concat(list_slice(embedding::DOUBLE[],
1, 63), ['nan'::DOUBLE]) ELSE embedding::DOUBLE[] END AS x FROM embeddings WHERE vec_id % 50 <> 4),
f AS (SELECT unnest(list_filter([CASE WHEN len(x) <> 64 THEN 'wrong_width' END, CASE WHEN list_bool_or(list_transform(x,
lambda e: isnan(e))) THEN 'not_finite' END, CASE WHEN list_bool_and(list_transform(x, lambda e: e = 0)) THEN 'zero_length' END,
CASE WHEN i.id IS NULL THEN 'unknown_id' END, CASE WHEN i.id IS NOT NULL AND x IS NULL THEN 'missing_vector' END], lambda e: e IS NOT NULL)) AS fault
FROM v FULL JOIN (SELECT vec_id AS id FROM embeddings WHERE vec_id % 50 <> 5) i ON i.id = v.vec_id) SELECT fault, count(*) AS rows FROM f GROUP BY fault"""
)
def clustering_faults(spark, sf):
    e = table(spark, sf, "embeddings")
    x, k = F.col("embedding").cast("array<double>"), F.col("vec_id") % 50
    zero = F.transform(x, lambda v: F.lit(0.0))
    v = e.where(k != 4).select(
        "vec_id",
        F.when(k == 1, F.slice(x, 1, 63)).when(k == 2, zero).when(k == 3, F.concat(F.slice(x, 1, 63), F.array(F.lit(float("nan"))))).otherwise(x).alias("x"),
    )
    return assets.faults_of(v, e.where(k != 5).select("vec_id"), "vec_id", "x", 64)


@query(f"""WITH {POINTS} SELECT id, {_geohash_sql('lng', 'lat')} AS geohash, round(x, 9) AS center_lng, round(y, 9) AS center_lat, packed
FROM (SELECT *, (least(32767, floor((lng + 180) / 360 * 32768)) + 0.5) * 360 / 32768 - 180 AS x, (least(32767,
floor((lat + 90) / 180 * 32768)) + 0.5) * 180 / 32768 - 90 AS y, CAST(list_sum(list_transform(range(30),
lambda b: ((CASE WHEN b % 2 = 0 THEN CAST(least(32767, floor((lng + 180) / 360 * 32768)) AS BIGINT) ELSE CAST(least(32767,
floor((lat + 90) / 180 * 32768)) AS BIGINT) END >> (14 - b // 2)::BIGINT) & 1) * (1::BIGINT << (29 - b)::BIGINT))) AS BIGINT) AS packed FROM points)""")
def geohash_cells(spark, sf):
    p = points(spark, sf).withColumn("t", geo.geohash_tokens(F.col("lng"), F.col("lat")))
    back = geo.geohash_to_tokens(geo.tokens_to_geohash(F.col("t")))  # through the text and back
    x, y = geo.cell_center(back)
    return rounded(p.select("id", geo.tokens_to_geohash(F.col("t")).alias("geohash"), x.alias("center_lng"), y.alias("center_lat"), geo.pack_tokens(back).alias("packed")))


_E = "embedding::DOUBLE[]"


@query(
    f"""WITH o AS (SELECT vec_id, list_slice({_E}, 1, 8) AS x, list_slice({_E}, 9, 16) AS y
FROM embeddings), u AS (SELECT vec_id, list_transform(x, lambda e: e / sqrt(list_inner_product(x, x))) AS x, list_transform(y,
lambda e: e / sqrt(list_inner_product(y, y))) AS y FROM o)
SELECT vec_id, round(y[1], 6) AS y1, round(y[8], 6) AS y8 FROM u"""
)
def recovered_views(spark, sf):
    e = table(spark, sf, "embeddings")
    x = F.col("embedding").cast("array<double>")
    u = e.select("vec_id", V.unit(F.slice(x, 1, 8)).alias("x"), V.unit(F.slice(x, 9, 8)).alias("y"))
    mixed = u.withColumn("m", V.fused(F.col("x"), F.col("y"), 0.6))
    r = mixed.select("vec_id", V.recovered(F.col("x"), F.col("m"), 0.6).alias("r"))
    return rounded(r.select("vec_id", F.element_at("r", 1).alias("y1"), F.element_at("r", 8).alias("y8")), 6)


@query(f"""WITH o AS (SELECT vec_id, {_E} AS x, 0.1 * (vec_id % 7) AS a, 0.2 * (vec_id % 5) AS b FROM embeddings)
SELECT vec_id, round(x[1] * cos(a) - x[2] * sin(a), 8) AS r1, round(x[1] * sin(a) + x[2] * cos(a), 8) AS r2, round(x[33] * cos(b) - x[34] * sin(b),
8) AS r33 FROM o""")
def rotated_segments(spark, sf):
    e, k = table(spark, sf, "embeddings"), F.col("vec_id")
    r = e.select("vec_id", V.rotated(F.col("embedding"), F.array(0.1 * (k % 7), 0.2 * (k % 5)), 32).alias("r"))
    return rounded(r.select("vec_id", *[F.element_at("r", i).alias(f"r{i}") for i in (1, 2, 33)]), 8)


@query(f"""WITH {CODES} SELECT vec_id, CASE WHEN s1 <> s2 THEN 0 WHEN s2 <> s3 THEN 1 WHEN s3 <> t3 THEN 2 ELSE 3 END AS common, greatest(s1 - 2, 0) AS kept,
'<A_' || s1 || '><B_' || s2 || '><C_' || s3 || '><D_' || t3 || '>' AS content, sha256('o' || vec_id || chr(31) || 's' || s1) AS business FROM codes""")
def token_forms(spark, sf):
    c = codes(spark, sf)
    business = hashing.business_key(F.concat(F.lit("o"), F.col("vec_id").cast("string")), F.concat(F.lit("s"), F.col("s1").cast("string")))
    return c.select(
        "vec_id",
        tokens.common_prefix(F.array("s1", "s2", "s3"), F.array("s2", "s3", "t3")).alias("common"),
        assets.prefix_length(F.col("s1")).alias("kept"),
        tokens.collision_content(F.array("s1", "s2", "s3", "t3")).alias("content"),
        F.sha2(business, 256).alias("business"),
    )


@query("""SELECT doc_id, md5(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s', '', 'g')) AS folded, round(0.2 + 0.6 / (1 + pow((1 + doc_id % 9) / 4.0,
1.5)), 9) AS alpha FROM documents""")
def folded_texts(spark, sf):
    d = table(spark, sf, "documents")
    return rounded(d.select("doc_id", F.md5(text.folded(F.col("text"))).alias("folded"), assets.adaptive_alpha(1.0 + F.col("doc_id") % 9, 0.2, 0.8, 4.0, 1.5).alias("alpha")))


@query(
    f"""WITH o AS (SELECT vec_id, label, list_slice({_E}, 1, 8) AS x
FROM embeddings), u AS (SELECT vec_id, label, list_transform(x, lambda e: e / sqrt(list_inner_product(x, x))) AS x FROM o)
SELECT vec_id, round(x[1] * 0.8 / sqrt(0.64 + 0.09 + 0.04), 9) AS f1, round(CASE WHEN label = 2 THEN 0.3 / sqrt(0.64 + 0.09 + 0.04) ELSE 0 END,
9)::DOUBLE AS f11, round(CASE WHEN vec_id % 5 = 0 THEN 0.2 / sqrt(0.64 + 0.09 + 0.04) ELSE 0 END, 9)::DOUBLE AS f19 FROM u"""
)
def content_geo_blocks(spark, sf):
    e = table(spark, sf, "embeddings")
    f = assets.content_geo(F.slice(F.col("embedding").cast("array<double>"), 1, 8), 0.8, F.col("label"), 10, 0.3, F.col("vec_id") % 5, 5, 0.2)
    return rounded(e.select("vec_id", f.alias("f")).select("vec_id", *[F.element_at("f", i).alias(f"f{i}") for i in (1, 11, 19)]))


@query(
    f"""WITH {POINTS}, c AS (SELECT *, avg(lng) OVER w AS cx, avg(lat) OVER w AS cy, count(*) OVER w AS n
FROM points WINDOW w AS (PARTITION BY nation, id % 2)),
d AS (SELECT id, n, CASE WHEN n > 1 THEN radians(lng - cx) * cos(radians(cy)) * 6371008.8 ELSE 0 END AS dx,
CASE WHEN n > 1 THEN radians(lat - cy) * 6371008.8 ELSE 0 END AS dy FROM c),
l AS (SELECT *, ln(1 + sqrt(dx * dx + dy * dy)) AS d
FROM d), s AS (SELECT quantile_cont(d, 0.25) AS a, quantile_cont(d, 0.5) AS m, quantile_cont(d, 0.75) AS b FROM l
WHERE n > 1), f AS (SELECT id, n, dx, dy, (d - m) / (b - a) AS z, atan2(dy, dx) AS t FROM l, s)
SELECT id, round(dx, 3)::DOUBLE AS dx, round(dy, 3)::DOUBLE AS dy, round(CASE WHEN n > 1 THEN z / sqrt(z * z + 1) ELSE 0 END, 7)::DOUBLE AS g1,
round(CASE WHEN n > 1 THEN sin(t) / sqrt(z * z + 1) ELSE 0 END, 7)::DOUBLE AS g2 FROM f"""
)
def parent_geo_features(spark, sf):
    p = points(spark, sf).withColumn("half", F.col("id") % 2)
    out = assets.parent_geo(p, ["nation", "half"], "lng", "lat")
    return out.select("id", F.round("dx", 3).alias("dx"), F.round("dy", 3).alias("dy"), F.round(F.element_at("geo", 1), 7).alias("g1"), F.round(F.element_at("geo", 2), 7).alias("g2"))


def placed(spark, sf):
    c = codes(spark, sf).drop("label").join(views(spark, sf).select("vec_id", "c", "label"), "vec_id")
    k = F.col("vec_id")
    return c.withColumn("lng", 116.0 + (k * 7919 % 1000) / 1000.0).withColumn("lat", 39.5 + (k * 104729 % 1000) / 1000.0)


@query()
def local_code_choice(spark, sf):
    """Last-level codes by content, place and hard neighbours (iterative; a test holds one sweep to plain sums)."""
    rows = placed(spark, sf)
    hard = rows.select("vec_id", ((F.col("vec_id") + 7) % 500).alias("neighbor"))
    return assets.local_codes(rows, ["s1"], "vec_id", "c", words(spark)[0], "lng", "lat", 4, 0.2, 0.1, hard, 1)


@query(
    f"""WITH {CODES}, e AS (SELECT vec_id, (vec_id * 3 + 1) % 500 AS other, 1.0 + vec_id % 4 AS weight FROM codes
WHERE vec_id % 5 <> 0), f AS (SELECT vec_id, s1 AS code, label FROM codes WHERE vec_id % 7 <> 0), s AS (SELECT vec_id, s2 AS code, label FROM codes
WHERE vec_id % 11 <> 0), k AS (SELECT vec_id FROM f JOIN s USING (vec_id)),
i AS (SELECT e.* FROM e JOIN k USING (vec_id) JOIN k o ON o.vec_id = e.other) """
    + " UNION ALL ".join(
        f"""SELECT '{n}' AS method, (SELECT CAST(count(*) AS BIGINT) FROM k) AS rows, (SELECT round(sum(top) / sum(n), 9)
FROM (SELECT code, sum(n) AS n, max(n) AS top FROM (SELECT code, label, count(*) AS n FROM {t} JOIN k USING (vec_id) GROUP BY ALL)
GROUP BY 1)) AS purity, (SELECT round(sum(weight) FILTER (a.code = b.code) / sum(weight), 9) FROM i JOIN {t} a USING (vec_id)
JOIN {t} b ON b.vec_id = i.other) AS agreement"""
        for n, t in (("first", "f"), ("second", "s"))
    )
)
def paired_codebooks(spark, sf):
    c, k = codes(spark, sf), F.col("vec_id")
    e = c.where(k % 5 != 0).select("vec_id", ((k * 3 + 1) % 500).alias("other"), (1.0 + k % 4).alias("weight"))
    f = c.where(k % 7 != 0).select("vec_id", F.col("s1").alias("code"), "label")
    s = c.where(k % 11 != 0).select("vec_id", F.col("s2").alias("code"), "label")
    return rounded(assets.paired_codebooks(f, s, e, "vec_id", "other", "label"))


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r
FROM lineitem) SELECT l_orderkey, string_agg(l_partkey || '-s' || l_partkey % 3, ','
ORDER BY r) AS first, string_agg('s' || l_partkey % 3 || '-' || l_partkey, ',' ORDER BY r) AS second FROM o GROUP BY 1""")
def both_token_orders(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))),
        lambda s: s["l_partkey"],
    ).alias("ids"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("old"))
    s = F.concat(F.lit("s"), (F.col("old") % 3).cast("string"))
    out = assets.both_orders(
        rows,
        p.withColumn("new", F.concat(F.col("old").cast("string"), F.lit("-"), s)),
        p.withColumn("new", F.concat(s, F.lit("-"), F.col("old").cast("string"))),
        "l_orderkey",
        "ids",
    )
    return out.select("l_orderkey", F.array_join("first", ",").alias("first"), F.array_join("second", ",").alias("second"))


@query(f"""WITH {SUPERVISED}, i AS (SELECT *, CAST(substr(query, 2) AS BIGINT) AS n FROM sup)
SELECT CAST(supervision_depth AS INTEGER) AS supervision_depth, count(*) AS rows FROM i WHERE n < 300 GROUP BY 1""")
def category_depth_preview(spark, sf):
    s = supervised_of(spark, sf)[2].withColumn("n", F.substring("query", 2, 20).cast("long"))
    return assets.preview(s, "n", 300, "supervision_depth").withColumn("supervision_depth", F.col("supervision_depth").cast("int"))


@query(f"WITH {PAIRS}, a AS (SELECT query, poi, n, count(*) OVER (PARTITION BY query) AS k FROM pairs) SELECT query, poi, n FROM a WHERE k = 1")
def single_answer_queries(spark, sf):
    from cairnflow.plans.log_queries import pairs_of

    p = pairs_of(spark, sf)
    halves = [p.where("pmod(hash(query), 2) = 0"), p.where("pmod(hash(query), 2) = 1")]
    return assets.alone(assets.appended(halves), ["query"]).select("query", "poi", "n")


@query(f"""WITH {CODES}, o AS (SELECT vec_id, label, list_slice(embedding::DOUBLE[], 1, 8) AS x FROM embeddings), p AS (SELECT range AS pos
FROM range(1, 9)), m AS (SELECT vec_id, pos, x[pos] - avg(x[pos]) OVER (PARTITION BY label, pos) AS d FROM o, p)
SELECT vec_id, round(max(d) FILTER (pos = 1) / sqrt(sum(d * d)), 7) AS v1 FROM m GROUP BY vec_id""")
def group_centred_vectors(spark, sf):
    out = assets.centred_on(views(spark, sf), "c", ["label"])
    return rounded(out.select("vec_id", F.element_at("centred", 1).alias("v1")), 7)
