"""Vectors, rankings, geography and negatives."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from cairnflow.functions import geo, text
from cairnflow.functions import vector as V
from cairnflow.operators import metrics, negatives, vectors
from cairnflow.plans.base import CODES, KNN, POINTS, codes, points, query, rounded, table


def neighbours(spark, sf, k=20):
    e = table(spark, sf, "embeddings")
    found = vectors.knn(e, e.where("vec_id % 20 = 0"), k)
    label = e.select("vec_id", "label")
    return found.join(label.withColumnRenamed("vec_id", "id"), "id").join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")


@query(f"WITH {KNN} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM knn WHERE rank <= 20")
def cosine_topk(spark, sf):
    return neighbours(spark, sf).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


#: The nearest other row of the same label is the target of a ranking.
TARGET = KNN + ", t AS (SELECT query_id, query_label, coalesce(min(rank) FILTER (label = query_label AND id <> query_id AND rank <= 20), -1) AS r FROM knn GROUP BY ALL)"


def ranks(spark, sf):
    n = neighbours(spark, sf)
    return n.groupBy("query_id", "query_label").agg(metrics.target_rank(F.min(F.when(
        (F.col("label") == F.col("query_label")) & (F.col("id") != F.col("query_id")),
        F.col("rank"),
    ))).alias("target_rank"))


_METRICS = "count(*) AS samples, " + ", ".join(f"round(avg(CASE WHEN r BETWEEN 1 AND {k} THEN 1.0 ELSE 0.0 END), 9) AS hit_at_{k}" for k in (1, 3, 5, 10, 20)) + ", round(avg(CASE WHEN r BETWEEN 1 AND 10 THEN 1.0 / r ELSE 0.0 END), 9) AS mrr_at_10, round(avg(CASE WHEN r BETWEEN 1 AND 10 THEN 1.0 / log2(r + 1.0) ELSE 0.0 END), 9) AS ndcg_at_10"


@query(f"WITH {TARGET} SELECT {_METRICS} FROM t")
def rank_metrics(spark, sf):
    return rounded(metrics.rank_metrics(ranks(spark, sf)))


@query(f"""WITH {TARGET}, s AS (SELECT r, unnest(list_filter([CASE WHEN query_label < 5 THEN 'low' END, CASE WHEN query_label % 2 = 0 THEN 'even' END, 'all'],
lambda x: x IS NOT NULL)) AS slice FROM t) SELECT slice, {_METRICS} FROM s GROUP BY slice""")
def sliced_metrics(spark, sf):
    return rounded(metrics.sliced_metrics(ranks(spark, sf), {"low": F.col("query_label") < 5, "even": F.col("query_label") % 2 == 0, "all": F.lit(True)}))


@query(f"""WITH {TARGET}, u AS (SELECT CASE WHEN r BETWEEN 1 AND 10 THEN r ELSE 11 END AS c, CASE WHEN b BETWEEN 1 AND 10 THEN b ELSE 11 END AS b
FROM (SELECT r, CASE WHEN query_id % 3 = 0 THEN r + 1 WHEN query_id % 3 = 1 THEN r ELSE r - 1 END AS b FROM t))
SELECT count(*) FILTER (c < b) AS wins, count(*) FILTER (c = b) AS ties, count(*) FILTER (c > b) AS losses FROM u""")
def paired_wins(spark, sf):
    q = F.col("query_id") % 3
    r = ranks(spark, sf).withColumn("baseline", F.when(q == 0, F.col("target_rank") + 1).when(q == 1, F.col("target_rank")).otherwise(F.col("target_rank") - 1))
    return metrics.paired(r, "baseline", "target_rank", 10)


@query(f"""WITH {TARGET}, u AS (SELECT r AS a, CAST((query_id * 7) % 23 AS INTEGER) - 1 AS b FROM t)
SELECT coalesce(CASE WHEN a BETWEEN 1 AND 10 AND NOT b BETWEEN 1 AND 10 THEN 'only_a' WHEN b BETWEEN 1 AND 10 AND NOT a BETWEEN 1 AND 10 THEN 'only_b'
WHEN a BETWEEN 1 AND 10 AND b BETWEEN 1 AND 10 AND b - a >= 5 THEN 'a_better' WHEN a BETWEEN 1 AND 10 AND b BETWEEN 1 AND 10 AND a - b >= 5 THEN
'b_better' WHEN NOT a BETWEEN 1 AND 10 AND NOT b BETWEEN 1 AND 10 THEN 'both_miss' END, 'none') AS outcome, count(*) AS samples FROM u GROUP BY 1""")
def paired_outcomes(spark, sf):
    r = ranks(spark, sf).withColumn("b", ((F.col("query_id") * 7) % 23).cast("int") - 1)
    return r.groupBy(F.coalesce(metrics.outcome(F.col("target_rank"), F.col("b")), F.lit("none")).alias("outcome")).agg(F.count(F.lit(1)).alias("samples"))


@query(f"""WITH {KNN}, f AS (SELECT query_id, label, min(rank) AS first_rank FROM knn WHERE rank <= 20 AND label <> 3 GROUP BY ALL)
SELECT query_id, label, CAST(first_rank AS INTEGER) AS first_rank, CAST(row_number() OVER (PARTITION BY query_id
ORDER BY first_rank, label) AS INTEGER) AS bucket_rank FROM f""")
def bucket_first_rank(spark, sf):
    return metrics.first_bucket_ranks(neighbours(spark, sf), "query_id", "label", "rank", F.col("label") != 3)


@query(f"""WITH {KNN}, c AS (SELECT query_id, id, rank, score, (id * 37) % 101 AS popularity FROM knn
WHERE rank <= 20), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rs, row_number() OVER (PARTITION BY query_id
ORDER BY popularity DESC, id) AS rp FROM c), f AS (SELECT *, round(1.0 / (60 + rs) + 1.0 / (60 + rp), 12) AS rrf FROM k)
SELECT query_id, id, CAST(rs AS INTEGER) AS rank_semantic, CAST(rp AS INTEGER) AS rank_popularity, rrf, CAST(row_number() OVER (PARTITION BY query_id
ORDER BY rrf DESC, id) AS INTEGER) AS rank_rrf FROM f""")
def rrf_rerank(spark, sf):
    c = neighbours(spark, sf).withColumn("popularity", (F.col("id") * 37) % 101)
    return metrics.rerank(c, "query_id", "id", "rank", {"semantic": "score", "popularity": "popularity"}).select("query_id", "id", "rank_semantic", "rank_popularity", "rrf", "rank_rrf")


@query(f"""WITH {KNN} SELECT count(*) AS samples, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 9) AS hr_at_1,
round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 9) AS hr_at_5, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END), 9) AS hr_at_10
FROM (SELECT query_id, min(rank) FILTER (label = query_label AND id <> query_id) AS r FROM knn WHERE rank <= 20 GROUP BY 1)""")
def slot_hits(spark, sf):
    return rounded(metrics.slot_hits(neighbours(spark, sf), "query_id", "rank", (F.col("label") == F.col("query_label")) & (F.col("id") != F.col("query_id"))))


@query(f"""WITH {KNN}, v AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) AS d FROM knn WHERE rank <= 20 AND id % 5 <> 0)
SELECT query_id, label, id, CAST(r AS INTEGER) AS rank FROM (SELECT query_id, label, id, row_number() OVER (PARTITION BY query_id
ORDER BY score DESC, id) AS r FROM v WHERE d = 1) WHERE r <= 5""")
def valid_deduplicated(spark, sf):
    return metrics.valid_top(neighbours(spark, sf).drop("rank"), "query_id", "label", "score", "id", F.col("id") % 5 != 0, 5).select("query_id", "label", "id", "rank")


@query(f"""WITH {KNN}, p AS (SELECT query_id, max(score) FILTER (label = query_label AND id <> query_id) AS p FROM knn WHERE rank <= 20 GROUP BY 1)
SELECT query_id, 1 + count(*) FILTER (k.label <> k.query_label AND k.score >= p.p) AS rank FROM knn k JOIN p USING (query_id)
WHERE k.rank <= 20 AND p.p IS NOT NULL GROUP BY query_id""")
def fixed_candidate_rank(spark, sf):
    n = neighbours(spark, sf)
    same = F.col("label") == F.col("query_label")
    n = n.withColumn("has", F.max((same & (F.col("id") != F.col("query_id"))).cast("int")).over(Window.partitionBy("query_id"))).where("has = 1")
    return metrics.fixed_candidate_rank(n, "query_id", "score", same & (F.col("id") != F.col("query_id")), ~same)


_E = "embedding::DOUBLE[]"


@query(f"""WITH o AS (SELECT vec_id, {_E} AS x, CASE WHEN vec_id % 3 <> 0 THEN list_concat(list_slice({_E}, 2, len(embedding)), [embedding[1]::DOUBLE]) END AS y
FROM embeddings), m AS (SELECT vec_id, x, y, list_transform(range(1, len(x) + 1),
lambda i: CASE WHEN y IS NULL THEN x[i] ELSE 0.7 * x[i] + 0.3 * y[i] END) AS z FROM o)
SELECT vec_id, round(CASE WHEN y IS NULL THEN x[1] ELSE z[1] / sqrt(list_inner_product(z, z)) END, 9) AS v1,
round(CASE WHEN y IS NULL THEN x[2] ELSE z[2] / sqrt(list_inner_product(z, z)) END, 9) AS v2 FROM m""")
def fused_vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    other = F.when(F.col("vec_id") % 3 != 0, F.concat(F.slice("embedding", F.lit(2), F.size("embedding") - 1), F.array(F.element_at("embedding", 1))))
    v = e.select("vec_id", V.fused(F.col("embedding"), other, 0.3).alias("v"))
    return rounded(v.select("vec_id", F.element_at("v", 1).alias("v1"), F.element_at("v", 2).alias("v2")))


@query(f"""WITH u AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest({_E}) AS x FROM embeddings)
SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x), 9) AS mean, count(*) AS n FROM u GROUP BY ALL""")
def mean_vectors(spark, sf):
    m = vectors.mean_vector(table(spark, sf, "embeddings"), ["label"], "embedding")
    return rounded(m.select("label", "n", F.posexplode("mean").alias("p", "mean")).select("label", (F.col("p") + 1).cast("int").alias("pos"), "mean", "n"))


@query(f"""WITH u AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS pos, unnest({_E}) AS x
FROM embeddings), m AS (SELECT label, pos, avg(x) AS m, count(*) AS n FROM u
GROUP BY ALL), r AS (SELECT vec_id, pos, x - CASE WHEN n >= 20 THEN 0.85 * m ELSE 0 END AS r FROM u
JOIN m USING (label, pos)), l AS (SELECT vec_id, sqrt(sum(r * r)) AS l FROM r GROUP BY 1) SELECT vec_id, round(r / l, 9) AS v1 FROM r
JOIN l USING (vec_id) WHERE pos = 1""")
def category_residual(spark, sf):
    r = vectors.category_residual(table(spark, sf, "embeddings"), "label", "embedding", 0.85, 20)
    return rounded(r.select("vec_id", F.element_at("residual", 1).alias("v1")))


@query("""WITH w AS (SELECT label, CAST(1.0 + vec_id % 5 AS DOUBLE) AS w FROM embeddings)
SELECT label, round(sum(w), 9) AS weight_sum, round(least(count(*), greatest(1.0, sum(w) * sum(w) / sum(w * w))), 9) AS effective_count, count(*) AS n
FROM w GROUP BY label""")
def kish_count(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("w", (1.0 + F.col("vec_id") % 5).cast("double"))
    return rounded(vectors.weighted_mean(e, ["label"], "embedding", "w").drop("vector"))


_U = f"""u AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS pos, unnest({_E}) AS x FROM embeddings), c AS (SELECT label AS code, pos, avg(x) AS c
FROM u GROUP BY ALL)"""


@query(f"""WITH {_U}, d AS (SELECT vec_id, code, sum(x * c) / sqrt(sum(c * c)) / sqrt(sum(x * x)) AS s FROM u JOIN c USING (pos) GROUP BY ALL)
SELECT vec_id, CAST(arg_max(code, s) AS INTEGER) AS code, round(max(s), 6) AS score FROM d GROUP BY vec_id""")
def hard_assign(spark, sf):
    e = table(spark, sf, "embeddings")
    book = [(r["label"], r["mean"]) for r in vectors.mean_vector(e, ["label"], "embedding").orderBy("label").collect()]  # one row a label
    return vectors.assign(e, book).select("vec_id", "code", F.round("score", 6).alias("score"))


@query(f"""WITH {_U}, n AS (SELECT label AS code, count(*) AS n FROM embeddings GROUP BY 1), g AS (SELECT pos, avg(x) AS g FROM u GROUP BY 1)
SELECT code AS label, CAST(pos AS INTEGER) AS pos, round(n / (n + 10.0) * c + (1 - n / (n + 10.0)) * g, 9) AS centroid FROM c JOIN n USING (code)
JOIN g USING (pos)""")
def shrunk_centroids(spark, sf):
    s = vectors.shrunk_centroids(table(spark, sf, "embeddings"), "label", "embedding", 10.0)
    return rounded(s.select("label", F.posexplode("centroid").alias("p", "centroid")).select("label", (F.col("p") + 1).cast("int").alias("pos"), "centroid"))


@query(f"""WITH {_U}, p AS (SELECT vec_id, sum(x * c) / sum(c * c) AS s FROM u JOIN c ON c.code = u.label AND c.pos = u.pos
GROUP BY 1), r AS (SELECT u.vec_id, u.pos, x - s * c AS r FROM u JOIN c ON c.code = u.label AND c.pos = u.pos
JOIN p USING (vec_id)), l AS (SELECT vec_id, sqrt(sum(r * r)) AS l FROM r GROUP BY 1) SELECT vec_id, round(r / l, 8) AS v1 FROM r
JOIN l USING (vec_id) WHERE pos = 1""")
def projection_residual(spark, sf):
    e = table(spark, sf, "embeddings")
    m = vectors.mean_vector(e, ["label"], "embedding").select("label", "mean")
    return e.join(m, "label").select("vec_id", F.round(F.element_at(V.projection_residual(F.col("embedding"), F.col("mean")), 1), 8).alias("v1"))


@query(f"""WITH {CODES}, n AS (SELECT s1, label, count(*) AS n FROM codes GROUP BY ALL), p AS (SELECT label, count(*) / sum(count(*)) OVER () AS prior FROM codes
GROUP BY 1), t AS (SELECT s1, count(*) AS t FROM codes GROUP BY 1)
SELECT s1, label, round(-ln((coalesce(n, 0) + 5.0 * prior) / (t + 5.0)) / ln((SELECT count(*) FROM p)), 9) AS cost FROM t CROSS JOIN p LEFT
JOIN n USING (s1, label)""")
def category_costs(spark, sf):
    return rounded(vectors.category_costs(codes(spark, sf), "s1", "label", 5.0))


@query(f"""WITH {KNN}, {CODES}, v AS (SELECT query_id AS node, s1 AS code, sum(score) AS w FROM knn JOIN codes ON codes.vec_id = knn.id WHERE rank <= 20
GROUP BY ALL) SELECT node, code, round(sum(w) OVER (PARTITION BY node) - w, 6) AS penalty FROM v""")
def graph_votes(spark, sf):
    edges = neighbours(spark, sf).select(F.col("query_id").alias("node"), F.col("id").alias("neighbor"), F.col("score").alias("weight"))
    labels = codes(spark, sf).select(F.col("vec_id").alias("neighbor"), F.col("s1").alias("code"))
    return vectors.graph_votes(edges, labels).select("node", "code", F.round("penalty", 6).alias("penalty"))


@query()
def spherical_kmeans(spark, sf):
    """Codes of a fitted spherical codebook (iterative; tests hold its invariants)."""
    e = table(spark, sf, "embeddings")
    return vectors.assign(e, vectors.fit_spherical(e, 8)).select("vec_id", "code", F.round("score", 6).alias("score"))


def _geohash_sql(lng: str, lat: str) -> str:
    x, y = f"least(32767, CAST(floor(({lng} + 180) / 360 * 32768) AS BIGINT))", f"least(32767, CAST(floor(({lat} + 90) / 180 * 32768) AS BIGINT))"
    chars = []
    for t in range(6):
        terms = [f"((({x if b % 2 == 0 else y}) >> {14 - b // 2}) & 1) * {1 << (4 - b % 5)}" for b in range(5 * t, 5 * t + 5)]
        chars.append(f"substr('{geo.GEOHASH}', 1 + CAST({' + '.join(terms)} AS INTEGER), 1)")
    return " || ".join(chars)


@query(f"WITH {POINTS} SELECT id, {_geohash_sql('lng', 'lat')} AS geohash FROM points")
def geohash6(spark, sf):
    return points(spark, sf).select("id", geo.geohash(F.col("lng"), F.col("lat")).alias("geohash"))


def _plus_sql() -> str:
    digit = lambda n, place: f"substr('{geo.OPEN_LOCATION}', 1 + CAST(({n} // {place}) % 20 AS INTEGER), 1)"
    ny, nx = "CAST(floor((lat + 90.0) * 20.0) AS BIGINT)", "CAST(floor((lng + 180.0) * 20.0) AS BIGINT)"
    return " || ".join(digit(n, p) for p in (400, 20, 1) for n in (ny, nx)) + " || '00+'"


@query(f"WITH {POINTS} SELECT id, {_plus_sql()} AS plus_code FROM points")
def plus_code6(spark, sf):
    return points(spark, sf).select("id", geo.plus_code6(F.col("lng"), F.col("lat")).alias("plus_code"))


_HAVERSINE = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"


@query(f"""WITH {POINTS}, p AS (SELECT a.id, b.id AS other, {_HAVERSINE} AS metres FROM points a JOIN points b ON a.id <> b.id)
SELECT id, other, round(metres, 3) AS metres, CAST(row_number() OVER (PARTITION BY id ORDER BY metres, other) AS INTEGER) AS rank FROM p
QUALIFY rank <= 5""")
def haversine_topk(spark, sf):
    return negatives.geo_topk(points(spark, sf), 5).select("id", "other", F.round("metres", 3).alias("metres"), "rank")


@query(f"""WITH {POINTS}, c AS (SELECT *, avg(lng) OVER (PARTITION BY nation) AS cx, avg(lat) OVER (PARTITION BY nation) AS cy,
count(*) OVER (PARTITION BY nation) AS n FROM points)
SELECT id, round(CASE WHEN n > 1 THEN radians(lng - cx) * cos(radians(cy)) * 6371008.8 ELSE 0.0 END, 3) AS dx,
round(CASE WHEN n > 1 THEN radians(lat - cy) * 6371008.8 ELSE 0.0 END, 3) AS dy FROM c""")
def local_geo_features(spark, sf):
    p = points(spark, sf)
    centres = p.groupBy("nation").agg(F.avg("lng").alias("cx"), F.avg("lat").alias("cy"), F.count(F.lit(1)).alias("n"))
    x, y = geo.local_metres(F.col("lng"), F.col("lat"), F.col("cx"), F.col("cy"))
    alone = lambda v: F.round(F.when(F.col("n") > 1, v).otherwise(0.0), 3)
    return p.join(centres, "nation").select("id", alone(x).alias("dx"), alone(y).alias("dy"))


_GRAMS = """g AS (SELECT p_partkey AS id, p_brand AS code, regexp_replace(lower(p_name || ' ' || p_type), '\\s', '', 'g') AS t
FROM part), s AS (SELECT id, code, list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) AS grams FROM g)"""


@query(f"""WITH {_GRAMS}, p AS (SELECT a.id AS target, b.id AS candidate, len(list_intersect(a.grams, b.grams)) AS i, len(a.grams) AS la, len(b.grams) AS lb,
CASE WHEN a.code = b.code THEN 1 ELSE 0 END AS same_code FROM s a JOIN s b ON a.id <> b.id), q AS (SELECT target, candidate, i / (la + lb - i) AS name_score, same_code FROM p WHERE i > 0 OR same_code > 0)
SELECT target, candidate, round(name_score, 9) AS name_score, same_code, CAST(row_number() OVER (PARTITION BY target
ORDER BY name_score DESC, same_code DESC, candidate) AS INTEGER) AS rank FROM q QUALIFY rank <= 10""")
def lexical_negatives(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("name"), F.col("p_brand").alias("code"))
    found = negatives.lexical_topk(p, p, 10)
    return rounded(found.select("target", "candidate", "name_score", "same_code", "rank"))


@query(f"""WITH {_GRAMS} SELECT a.id, b.id AS other, round(len(list_intersect(a.grams, b.grams)) / len(list_distinct(list_concat(a.grams, b.grams))),
9) AS jaccard FROM s a JOIN s b ON b.id = a.id + 1""")
def ngram_jaccard(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.character_ngrams(F.lower(F.concat_ws(" ", "p_name", "p_type"))).alias("g"))
    q = p.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), F.col("g").alias("h"))
    return rounded(p.join(q, "id").select("id", "other", text.jaccard(F.col("g"), F.col("h")).alias("jaccard")))


@query(f"""WITH {KNN}, a AS (SELECT query_id AS row, id AS candidate, rank FROM knn
WHERE rank BETWEEN 2 AND 6), b AS (SELECT query_id AS row, id AS candidate, rank FROM knn
WHERE rank BETWEEN 4 AND 15), u AS (SELECT *, 0 AS p, 'near' AS source, 3 AS budget FROM a UNION ALL SELECT *, 1, 'far', 4
FROM b), d AS (SELECT *, row_number() OVER (PARTITION BY row, candidate ORDER BY p, rank) AS d FROM u)
SELECT row, candidate, source, CAST(row_number() OVER (PARTITION BY row, p ORDER BY rank, candidate) AS INTEGER) AS position FROM d WHERE d = 1
QUALIFY position <= budget""")
def merge_negatives(spark, sf):
    n = neighbours(spark, sf).select(F.col("query_id").alias("row"), F.col("id").alias("candidate"), "rank")
    return negatives.merge_sources([("near", n.where("rank between 2 and 6"), 3), ("skipped", n, 0), ("far", n.where("rank between 4 and 15"), 4)])


@query(f"""WITH {CODES}, j AS (SELECT l.vec_id AS row, r.vec_id AS neighbor, 0.6 * list_inner_product(le.embedding::DOUBLE[],
re.embedding::DOUBLE[]) + 0.4 * CASE WHEN l.t3 = r.t3 THEN 1 ELSE 0 END AS score FROM codes l
JOIN codes r ON l.s1 = r.s1 AND l.s2 = r.s2 AND l.vec_id <> r.vec_id JOIN embeddings le ON le.vec_id = l.vec_id
JOIN embeddings re ON re.vec_id = r.vec_id WHERE NOT (l.label = r.label AND l.s3 = r.s3))
SELECT row, neighbor, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, neighbor) AS INTEGER) AS rank FROM j
WHERE score + 1e-12 >= 0.30 QUALIFY rank <= 20""")
def hard_neighbours(spark, sf):
    rows = codes(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id").withColumnRenamed("vec_id", "row")

    def score(a, b):
        x, y = (np.stack(f["embedding"].to_numpy()).astype(np.float64) for f in (a, b))
        return 0.6 * x @ y.T + 0.4 * (a["t3"].to_numpy()[:, None] == b["t3"].to_numpy()[None, :])

    found = negatives.hard_graph(rows, ["s1", "s2"], score, 0.30, 20, protect=("label", "s1", "s2", "s3"))
    return found.select("row", "neighbor", F.round("score", 6).alias("score"), "rank")


@query("""WITH t AS (SELECT o_orderkey AS row, o_orderkey // 8 AS batch, o_custkey % 50 AS target FROM orders) SELECT DISTINCT t.row, u.target AS candidate
FROM t JOIN t u USING (batch) WHERE u.target <> t.target AND NOT (t.row % 5 = 0 AND u.target = (t.target + 1) % 50)""")
def in_batch_negatives(spark, sf):
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row"), F.floor(F.col("o_orderkey") / 8).alias("batch"), (F.col("o_custkey") % 50).alias("target"))
    return negatives.in_batch(t, t.where("row % 5 = 0").select("row", ((F.col("target") + 1) % 50).alias("target")))
