"""Codebooks over two views: one step at a time with an SQL twin, whole fits as invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnflow.functions import vector as V
from cairnflow.operators import quantizers as qz
from cairnflow.operators import vectors
from cairnflow.plans.base import CODES, codes, query, rounded, table

#: Eight fixed codewords of eight dimensions; rows are the first and the second eight dimensions of an embedding.
_WORDS = """w AS (SELECT CAST(k AS INTEGER) AS code, list_transform(range(8), lambda d: 0.1 * sin(1.0 + 2 * k + 3 * d)) AS mu, list_transform(range(8),
lambda d: 0.1 * cos(1.0 + 2 * k + 3 * d)) AS nu FROM range(8) r(k))"""
_VIEWS = """v AS (SELECT vec_id, label, list_slice(embedding::DOUBLE[], 1, 8) AS c, CASE WHEN vec_id % 3 <> 0 THEN list_slice(embedding::DOUBLE[], 9, 16) END AS q
FROM embeddings)"""
_SQUARED = "list_sum(list_transform(list_zip({a}, {b}), lambda z: pow(z[1] - z[2], 2)))"
_DISTANCES = f"""{_WORDS}, {_VIEWS}, d AS (SELECT vec_id, label, code, {_SQUARED.format(a='c', b='mu')} AS dc,
CASE WHEN q IS NULL THEN 0 ELSE {_SQUARED.format(a='q', b='nu')} END AS dq, q IS NOT NULL AS covered FROM v, w)"""


def words(spark) -> tuple[qz.Book, qz.Book]:
    import math

    mu = [(k, [0.1 * math.sin(1.0 + 2 * k + 3 * d) for d in range(8)]) for k in range(8)]
    nu = [(k, [0.1 * math.cos(1.0 + 2 * k + 3 * d) for d in range(8)]) for k in range(8)]
    return mu, nu


def views(spark, sf):
    e = table(spark, sf, "embeddings")
    d = F.col("embedding").cast("array<double>")
    return e.select("vec_id", "label", F.slice(d, 1, 8).alias("c"), F.when(F.col("vec_id") % 3 != 0, F.slice(d, 9, 8)).alias("q"))


@query(f"""WITH {_DISTANCES}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(dc + 0.5 * dq, 12), code) AS r FROM d)
SELECT vec_id, code, round(dc, 7) AS content_distance, round(dq, 7)::DOUBLE AS query_distance FROM r WHERE r = 1""")
def dual_view_assign(spark, sf):
    mu, nu = words(spark)
    return rounded(qz.assign_dual(views(spark, sf), "c", "q", mu, nu, 0.5).select("vec_id", "code", "content_distance", "query_distance"), 7)


@query(
    f"""WITH {_DISTANCES}, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(dc, 12), code) AS near, label % 8 AS ref FROM d),
a AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(dc + 0.5 * dq, 12), code) AS r FROM k
WHERE CASE WHEN covered THEN near <= 3 OR code = ref ELSE code = ref END)
SELECT vec_id, code, round(dc, 7) AS content_distance FROM a WHERE r = 1"""
)
def covered_routing(spark, sf):
    mu, nu = words(spark)
    v = views(spark, sf).withColumn("ref", (F.col("label") % 8).cast("int"))
    return rounded(qz.assign_dual(v, "c", "q", mu, nu, 0.5, "ref", 3).select("vec_id", "code", "content_distance"), 7)


@query(
    f"""WITH {_WORDS}, {_VIEWS}, l AS (SELECT CAST(label % 6 AS INTEGER) AS code, c, q FROM v), p AS (SELECT range AS pos FROM range(1, 9)),
m AS (SELECT code, pos, avg(c[pos]) AS mc, avg(q[pos]) AS mq FROM l, p GROUP BY ALL)
SELECT w.code, CAST(p.pos AS INTEGER) AS pos, round(coalesce(mc, mu[p.pos]), 9) AS content, round(coalesce(mq, nu[p.pos]), 9) AS query FROM w, p LEFT
JOIN m ON m.code = w.code AND m.pos = p.pos"""
)
def dual_view_centers(spark, sf):
    mu, nu = words(spark)
    rows = views(spark, sf).withColumn("code", (F.col("label") % 6).cast("int"))
    a, b = qz.update_dual(rows, "code", "c", "q", mu, nu)
    out = [(k, d + 1, float(x[d]), float(y[d])) for (k, x), (_, y) in zip(a, b, strict=True) for d in range(8)]
    return rounded(spark.createDataFrame(out, "code int, pos int, content double, query double"))


@query()
def dual_view_fit(spark, sf):
    """Objective of each round of a whole fit (iterative; tests hold that it never rises)."""
    mu, nu = words(spark)
    _, _, trace = qz.fit_dual(views(spark, sf), "c", "q", mu, nu, 0.5, 6)
    return spark.createDataFrame([(t["iteration"], t["objective"], t["active"]) for t in trace], "iteration int, objective double, active long")


@query("""SELECT CAST(i AS INTEGER) AS iteration, round((0.5 + 0.5 * s) * 0.2, 9) AS query, round((0.5 + 0.5 * s) * 0.1, 9) AS graph, round(s * 0.05,
9) AS category FROM (SELECT i, CASE WHEN i <= 2 THEN 0.0 ELSE least(1.0, (i - 2) / 4.0) END::DOUBLE AS s FROM range(1, 11) r(i))""")
def warmup_schedule(spark, sf):
    rows = [(i, *qz.warmup_weights(i, 0.2, 0.1, 0.05)) for i in range(1, 11)]
    return rounded(spark.createDataFrame(rows, "iteration int, query double, graph double, category double"))


#: Edges between entities (vec_id) and queries (their label's number), with a code for each end.
_GRAPH = f"""{CODES}, e AS (SELECT vec_id AS poi, CAST((vec_id * 7 + k * 3) % 50 AS BIGINT) AS query, 1.0 + (vec_id + k) % 4 AS weight FROM codes, range(3) r(k)),
ql AS (SELECT query, CAST((query * 5) % 8 AS INTEGER) AS code FROM range(50) t(query)), pl AS (SELECT vec_id AS poi, s1 AS code FROM codes)"""


def graph(spark, sf):
    c = codes(spark, sf)
    e = c.select(F.col("vec_id").alias("poi"), F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k"))
    edges = e.select("poi", ((F.col("poi") * 7 + F.col("k") * 3) % 50).alias("query"), (1.0 + (F.col("poi") + F.col("k")) % 4).alias("weight"))
    queries = spark.range(50).select(F.col("id").alias("query"), ((F.col("id") * 5) % 8).cast("int").alias("code"))
    return edges, c.select(F.col("vec_id").alias("poi"), F.col("s1").alias("code")), queries


@query(f"""WITH {_GRAPH}, a AS (SELECT weight, pl.code = ql.code AS same FROM e JOIN pl USING (poi) JOIN ql USING (query))
SELECT count(*) AS edge_rows, round(sum(weight), 6)::DOUBLE AS edge_weight_sum, round(sum(weight) FILTER (same) / sum(weight),
9) AS weighted_agreement, round(1 - sum(weight) FILTER (same) / sum(weight), 9) AS weighted_disagreement, round(avg(same::INTEGER),
9) AS unweighted_agreement FROM a""")
def graph_agreement(spark, sf):
    edges, pois, queries = graph(spark, sf)
    return rounded(qz.agreement(edges, pois, queries, "poi", "query"))


@query(
    f"""WITH {_GRAPH}, {_WORDS}, {_VIEWS}, g AS (SELECT poi, code, sum(weight) AS w FROM e JOIN ql USING (query)
GROUP BY ALL), gt AS (SELECT poi, sum(w) AS total FROM g GROUP BY 1),
n AS (SELECT label AS category, s1 AS code, count(*) AS n FROM codes GROUP BY ALL), t AS (SELECT code, sum(n) AS t FROM n
GROUP BY 1), p AS (SELECT category, sum(n) / (SELECT count(*) FROM codes) AS prior FROM n GROUP BY 1),
cost AS (SELECT p.category, w.code, -ln(greatest((coalesce(n, 0) + 5.0 * prior) / (coalesce(t, 0) + 5.0), 1e-12)) / ln(greatest(2, (SELECT count(*)
FROM p))) AS cost FROM p CROSS JOIN w LEFT JOIN n ON n.category = p.category AND n.code = w.code LEFT JOIN t ON t.code = w.code),
o AS (SELECT v.vec_id, w.code, 1 - list_inner_product(c, mu) / sqrt(list_inner_product(c, c)) / sqrt(list_inner_product(mu, mu)) AS distance,
coalesce(total, 0) - coalesce(g.w, 0) AS penalty, cost.cost FROM v CROSS JOIN w
  LEFT JOIN g ON g.poi = v.vec_id AND g.code = w.code LEFT JOIN gt ON gt.poi = v.vec_id JOIN cost ON cost.category = v.label AND cost.code = w.code),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(distance + 0.05 * penalty + 0.1 * cost, 12), code) AS r FROM o)
SELECT vec_id AS poi, code, round(distance, 7) AS distance FROM r WHERE r = 1"""
)
def coupled_entity_assign(spark, sf):
    edges, pois, queries = graph(spark, sf)
    mu, _ = words(spark)
    rows = views(spark, sf).select(F.col("vec_id").alias("poi"), "c", F.col("label").alias("category")).join(pois, "poi")
    costs = qz.smoothed_costs(rows, "code", "category", list(range(8)), 5.0)
    voted = qz.votes(edges, queries, "poi", "query")
    out = qz.assign_coupled(rows.drop("code"), "poi", "c", mu, voted, 1.0, 0.05, "category", costs, 0.1)
    return rounded(out.select("poi", "code", "distance"), 7)


_QUERY_VECTORS = "qv AS (SELECT vec_id AS query, list_slice(embedding::DOUBLE[], 17, 24) AS x FROM embeddings WHERE vec_id < 50)"


@query(
    f"""WITH {_GRAPH}, {_WORDS}, {_QUERY_VECTORS}, g AS (SELECT query, code, sum(weight) AS w FROM e JOIN pl USING (poi)
GROUP BY ALL), gt AS (SELECT query, sum(w) AS total FROM g GROUP BY 1),
o AS (SELECT qv.query, w.code, 1 - list_inner_product(x, mu) / sqrt(list_inner_product(x, x)) / sqrt(list_inner_product(mu, mu)) AS distance,
coalesce(total, 0) - coalesce(g.w, 0) AS penalty FROM qv CROSS JOIN w LEFT JOIN g ON g.query = qv.query AND g.code = w.code LEFT
JOIN gt ON gt.query = qv.query),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(0.2 * distance + 0.01 * penalty, 12), code) AS r FROM o)
SELECT query, code, round(distance, 7) AS distance FROM r WHERE r = 1"""
)
def coupled_query_assign(spark, sf):
    edges, pois, _ = graph(spark, sf)
    mu, _ = words(spark)
    voted = qz.votes(edges, pois, "query", "poi")
    return rounded(qz.assign_coupled(query_vectors(spark, sf), "query", "x", mu, voted, 0.2, 0.01).select("query", "code", "distance"), 7)


def query_vectors(spark, sf):
    e = table(spark, sf, "embeddings").where("vec_id < 50")
    return e.select(F.col("vec_id").alias("query"), F.slice(F.col("embedding").cast("array<double>"), 17, 8).alias("x"))


@query(
    f"""WITH {_WORDS}, {_QUERY_VECTORS}, l AS (SELECT CAST((query * 5) % 6 AS INTEGER) AS code, x FROM qv), p AS (SELECT range AS pos
FROM range(1, 9)), s AS (SELECT code, pos, sum(x[pos]) AS s, count(*) AS n FROM l, p GROUP BY ALL),
v AS (SELECT w.code, p.pos, (coalesce(s, 0) + 8.0 * mu[p.pos]) / (coalesce(n, 0) + 8.0) AS v FROM w CROSS JOIN p LEFT JOIN s ON s.code = w.code AND s.pos = p.pos)
SELECT code, CAST(pos AS INTEGER) AS pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY code)), 9) AS v FROM v"""
)
def shrunk_query_centroids(spark, sf):
    mu, _ = words(spark)
    rows = query_vectors(spark, sf).withColumn("code", ((F.col("query") * 5) % 6).cast("int"))
    book = qz.shrunk_to(rows, "code", "x", mu, 8.0)
    return rounded(spark.createDataFrame([(k, d + 1, float(x)) for k, v in book for d, x in enumerate(v)], "code int, pos int, v double"))


@query(
    f"""WITH {CODES}, n AS (SELECT s1, label, s2, count(*) AS n FROM codes GROUP BY ALL), t AS (SELECT s1, s2, sum(n) AS t FROM n
GROUP BY ALL), o AS (SELECT s1, label, sum(n) AS c FROM n GROUP BY ALL), a AS (SELECT s1, sum(n) AS a FROM n GROUP BY 1)
SELECT o.s1, o.label, k AS code, round(-ln(greatest((coalesce(n, 0) + 5.0 * c / a) / (coalesce(t, 0) + 5.0), 1e-12)) / ln(greatest(2,
(SELECT count(DISTINCT label) FROM codes))), 9) AS cost
FROM o JOIN a USING (s1) CROSS JOIN (SELECT CAST(range AS INTEGER) AS k FROM range(8)) LEFT JOIN n ON n.s1 = o.s1 AND n.label = o.label AND n.s2 = k
LEFT JOIN t ON t.s1 = o.s1 AND t.s2 = k"""
)
def parent_category_costs(spark, sf):
    return rounded(qz.smoothed_costs(codes(spark, sf), "s2", "label", list(range(8)), 5.0, "s1"))


@query()
def coupled_fit(spark, sf):
    """Trace of a whole alternating fit (iterative; a test holds it to the steps, which have SQL)."""
    edges, pois, _ = graph(spark, sf)
    mu, _ = words(spark)
    rows = views(spark, sf).select(F.col("vec_id").alias("poi"), F.col("c").alias("x"), F.col("label").alias("category")).join(pois, "poi")
    trace = qz.fit_coupled(rows, query_vectors(spark, sf), edges, mu, qz.Coupling(graph=0.01, most=4))[4]
    return spark.createDataFrame([(t["iteration"], t["objective"], t["poi_change"]) for t in trace], "iteration int, objective double, poi_change double")


@query(
    f"""WITH {CODES}, {_WORDS}, {_VIEWS}, k AS (SELECT DISTINCT s1, s2, s3 FROM codes
WHERE vec_id % 4 <> 0), o AS (SELECT v.vec_id, codes.s3, w.code, list_inner_product(c, mu) / sqrt(list_inner_product(mu, mu)) AS sim FROM codes
JOIN v USING (vec_id) JOIN k USING (s1, s2) JOIN w ON w.code = k.s3),
r AS (SELECT vec_id, code, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 12) DESC, code) AS r FROM o)
SELECT codes.vec_id, r.code AS predicted, coalesce(r.code = codes.s3, false) AS correct FROM codes LEFT JOIN r ON r.vec_id = codes.vec_id AND r = 1"""
)
def prefix_probe(spark, sf):
    mu, _ = words(spark)
    c = codes(spark, sf)
    rows = c.drop("label").join(views(spark, sf), "vec_id")
    out = qz.nearest_children(rows, "c", ["s1", "s2"], "s3", mu, c.where("vec_id % 4 != 0").select("s1", "s2", "s3"))
    return out.select("vec_id", "predicted", F.coalesce(F.col("predicted") == F.col("s3"), F.lit(False)).alias("correct"))


@query(
    f"""WITH {CODES}, {_VIEWS}, p AS (SELECT range AS pos FROM range(1, 9)), x AS (SELECT vec_id, s1, s2, pos, c[pos] AS x FROM v
JOIN codes USING (vec_id), p), m AS (SELECT *, x - avg(x) OVER (PARTITION BY s1, s2, pos) AS d FROM x),
u AS (SELECT vec_id, pos, CASE WHEN sqrt(sum(d * d) OVER (PARTITION BY vec_id)) > 1e-12 THEN d / sqrt(sum(d * d) OVER (PARTITION BY vec_id)) ELSE 0
END AS u FROM m) SELECT vec_id, round(max(u) FILTER (pos = 1), 6)::DOUBLE AS first, round(0.25 * (vec_id % 5), 9)::DOUBLE AS extra FROM u
GROUP BY vec_id"""
)
def bucket_centred_features(spark, sf):
    rows = codes(spark, sf).drop("label").join(views(spark, sf), "vec_id").withColumn("g", F.array((F.col("vec_id") % 5).cast("double")))
    out = qz.bucket_centred(rows, ["s1", "s2"], "c", "g", 0.25)
    return out.select("vec_id", F.round(F.element_at("feature", 1), 6).alias("first"), F.round(F.element_at("feature", 9), 9).alias("extra"))


@query(f"""WITH {CODES}, {_WORDS}, u AS (SELECT code, list_transform(mu, lambda x: x / sqrt(list_inner_product(mu, mu))) AS v FROM w)
SELECT vec_id, round(a.v[1] / sqrt(2.0), 9) AS v1, round(b.v[3] / sqrt(2.0), 9) AS v11 FROM codes JOIN u a ON a.code = s1 JOIN u b ON b.code = s2""")
def codeword_features(spark, sf):
    mu, _ = words(spark)
    book = spark.createDataFrame(mu, "code int, v array<double>")
    out = qz.codeword_features(codes(spark, sf), [("s1", book), ("s2", book)], "vec_id")
    return rounded(out.select("vec_id", F.element_at("feature", 1).alias("v1"), F.element_at("feature", 11).alias("v11")))


@query()
def residual_kmeans(spark, sf):
    """Codes of three residual codebooks (iterative; tests hold one Lloyd step and the residuals to plain sums)."""
    return vectors.residual_codes(table(spark, sf, "embeddings"), 3, 8)


@query(
    f"""WITH {_WORDS}, {_VIEWS}, a AS (SELECT vec_id, c, code, mu, row_number() OVER (PARTITION BY vec_id
ORDER BY round({_SQUARED.format(a='c', b='mu')}, 12), code) AS r FROM v, w)
SELECT vec_id, code, round(c[1] - mu[1], 9) AS r1, round(c[8] - mu[8], 9) AS r8 FROM a WHERE r = 1"""
)
def residual_level(spark, sf):
    mu, _ = words(spark)
    out = vectors.encode_level(views(spark, sf).select("vec_id", "c"), mu, "c", "code", "difference")
    return rounded(out.select("vec_id", "code", F.element_at("c", 1).alias("r1"), F.element_at("c", 8).alias("r8")))


@query(
    f"""WITH {_WORDS}, {_VIEWS}, s AS (SELECT vec_id, c, code, list_inner_product(c, mu) / sqrt(list_inner_product(c, c)) / sqrt(list_inner_product(mu,
mu)) AS sim FROM v, w), t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 12) DESC, code) AS r FROM s QUALIFY r <= 3),
e AS (SELECT *, exp(20 * sim) / sum(exp(20 * sim)) OVER (PARTITION BY vec_id) AS weight FROM t), p AS (SELECT range AS pos
FROM range(1, 9)), m AS (SELECT code, pos, sum(weight * c[pos]) AS x, sum(weight) AS mass FROM e, p GROUP BY ALL)
SELECT code, CAST(pos AS INTEGER) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY code)), 7) AS v, round(mass, 6) AS mass FROM m"""
)
def soft_centroids(spark, sf):
    mu, _ = words(spark)
    out = vectors.soft_update(views(spark, sf), mu, "c", "vec_id", 3, 20.0)
    return out.select("code", F.posexplode("centroid").alias("p", "v"), "mass").select(
        "code",
        (F.col("p") + 1).cast("int").alias("pos"),
        F.round("v", 7).alias("v"),
        F.round("mass", 6).alias("mass"),
    )


@query()
def reference_points(spark, sf):
    """Anchors of a parallel k-means over places (random starts; a test holds count and order)."""
    from cairnflow.plans.base import points

    return spark.createDataFrame(qz.reference_points(points(spark, sf), 8), "lng double, lat double")


@query(f"""WITH {_VIEWS}, p AS (SELECT range AS pos FROM range(1, 9)), n AS (SELECT vec_id, pos, c[pos] / sqrt(list_inner_product(c, c)) AS x FROM v, p)
SELECT CAST(pos AS INTEGER) AS pos, round(avg(x), 9) AS mean FROM n GROUP BY pos""")
def global_mean(spark, sf):
    m = vectors.mean_vector(views(spark, sf).withColumn("one", F.lit(1)), ["one"], "c", True)
    return rounded(m.select(F.posexplode("mean").alias("p", "mean")).select((F.col("p") + 1).cast("int").alias("pos"), "mean"))


@query(f"""WITH {_VIEWS}, p AS (SELECT range AS pos FROM range(1, 9)), m AS (SELECT vec_id, pos, c[pos] - avg(c[pos]) OVER (PARTITION BY pos) AS d FROM v, p)
SELECT vec_id, round(max(d) FILTER (pos = 1) / sqrt(sum(d * d)), 8) AS v1 FROM m GROUP BY vec_id""")
def centred_vectors(spark, sf):
    v = views(spark, sf).withColumn("one", F.lit(1))
    m = vectors.mean_vector(v, ["one"], "c").select("one", "mean")
    return v.join(F.broadcast(m), "one").select("vec_id", F.round(F.element_at(V.centred(F.col("c"), F.col("mean")), 1), 8).alias("v1"))


@query(
    """WITH l AS (SELECT l_partkey % 200 AS poi, (l_partkey * 7 + l_linenumber) % 30 AS query, count(*) AS n FROM lineitem
GROUP BY ALL), d AS (SELECT query, count(*) AS df FROM l GROUP BY 1), k AS (SELECT count(DISTINCT poi) AS k FROM l),
v AS (SELECT vec_id AS query, list_slice(embedding::DOUBLE[], 1, 8) AS x FROM embeddings
WHERE vec_id < 30), w AS (SELECT poi, n, x, ln(1 + n) * ln((k + 1.0) / (df + 1.0)) AS w FROM l JOIN d USING (query) JOIN v USING (query), k),
p AS (SELECT range AS pos FROM range(1, 9)),
s AS (SELECT poi, pos, sum(x[pos]) AS e1, sum(w * x[pos]) AS e2, sum(w) AS ws, count(*) AS queries, sum(n) AS orders FROM w, p GROUP BY ALL)
SELECT poi, CAST(pos AS INTEGER) AS pos, round(e1 / sqrt(sum(e1 * e1) OVER (PARTITION BY poi)), 7) AS e1,
CASE WHEN ws > 1e-9 THEN round(e2 / sqrt(sum(e2 * e2) OVER (PARTITION BY poi)), 7) END AS e2, round(ws, 7) AS weight_sum, queries,
CAST(orders AS BIGINT) AS orders FROM s"""
)
def query_to_entity_vectors(spark, sf):
    pairs = table(spark, sf, "lineitem").groupBy(
        (F.col("l_partkey") % 200).alias("poi"),
        ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 30).alias("query"),
    ).agg(F.count(F.lit(1)).alias("n"))
    v = table(spark, sf, "embeddings").where("vec_id < 30").select(F.col("vec_id").alias("query"), F.slice(F.col("embedding").cast("array<double>"), 1, 8).alias("x"))
    out = vectors.query_vectors(pairs, v, "poi", "query", "n", "x")
    long = out.select(
        "poi",
        F.explode(F.arrays_zip(F.sequence(F.lit(1), F.lit(8)).alias("pos"), "e1", F.coalesce("e2", F.array().cast("array<double>")).alias("e2"))).alias("z"),
        "weight_sum",
        "queries",
        "orders",
    )
    return long.select(
        "poi",
        F.col("z.pos").alias("pos"),
        F.round("z.e1", 7).alias("e1"),
        F.round("z.e2", 7).alias("e2"),
        F.round("weight_sum", 7).alias("weight_sum"),
        "queries",
        "orders",
    )
