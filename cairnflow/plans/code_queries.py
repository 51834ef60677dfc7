"""Identifier codes: buckets, layers, prefixes, collisions, migration and solvers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnflow.functions import tokens
from cairnflow.operators import identifiers as ids
from cairnflow.operators import negatives, solvers
from cairnflow.plans.base import CODES, codes, query, rounded, table

S = ["s1", "s2", "s3"]


@query(f"""WITH {CODES}, b AS (SELECT s1, s2, s3, count(*) AS n FROM codes GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS unique_sids, CAST(sum(n) - count(*) AS BIGINT) AS collision_excess,
CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS colliding_rows, count(*) FILTER (n = 1) AS singletons, quantile_disc(n, 0.5) AS p50,
quantile_disc(n, 0.9) AS p90, quantile_disc(n, 0.95) AS p95, quantile_disc(n, 0.99) AS p99, max(n) AS max_size FROM b""")
def bucket_metrics(spark, sf):
    return ids.bucket_metrics(codes(spark, sf), S)


@query(f"WITH {CODES}, b AS (SELECT s1, s2, s3, count(*) AS n FROM codes GROUP BY ALL) SELECT n AS bucket_size, count(*) AS buckets FROM b GROUP BY n")
def bucket_histogram(spark, sf):
    return ids.size_histogram(codes(spark, sf), S)


@query(f"""WITH {CODES}, l AS (SELECT 's1' AS layer, 8::BIGINT AS declared, s1 AS code FROM codes UNION ALL SELECT 's2', 8, s2 FROM codes UNION ALL
SELECT 's3', 10, s3 FROM codes), n AS (SELECT layer, declared, code, count(*)::DOUBLE AS n FROM l
GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY layer) AS t
FROM n), a AS (SELECT layer, declared, count(*) AS used, -sum(n / t * ln(n / t)) AS h, sum(n * n) AS sq, max(n) AS top, max(t) AS t FROM t
GROUP BY layer, declared) SELECT layer, declared, used, round(used / declared, 9) AS utilisation, round(h, 9) AS entropy, round(h / ln(declared),
9) AS normalized_entropy, round(exp(h), 9) AS perplexity, round(t * t / sq, 9) AS effective_codes, round(top / t, 9) AS top_share FROM a""")
def layer_usage(spark, sf):
    return rounded(ids.layer_usage(codes(spark, sf), {"s1": 8, "s2": 8, "s3": 10}))


@query(f"""WITH {CODES}, n AS (SELECT r.range AS code, count(c.s1) AS n FROM range(10) r LEFT JOIN codes c ON c.s1 = r.range
GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n, code) AS i FROM n)
SELECT count(*) FILTER (n > 0) AS active, round(pow(sum(n), 2) / sum(n * n), 9) AS effective_codes, round(sum((2 * i - 11) * n) / (10 * sum(n)),
9) AS gini FROM k""")
def code_occupancy(spark, sf):
    return rounded(ids.occupancy(codes(spark, sf), "s1", 10))


_PREFIX = " UNION ALL ".join(f"SELECT {d} AS depth, {', '.join(S[:d] + ['NULL::INTEGER AS ' + c for c in S[d:]])}, label, count(*) AS n FROM codes GROUP BY {', '.join(S[:d])}, label" for d in (1, 2, 3))


@query(f"""WITH {CODES}, l AS ({_PREFIX}), b AS (SELECT depth, s1, s2, s3, sum(n) AS n, max(n) AS top FROM l GROUP BY ALL)
SELECT depth, count(*) AS buckets, count(*) FILTER (n = 1) AS singletons, CAST(max(n) AS BIGINT) AS max_size, round(sum(top) / sum(n),
9) AS micro_purity, round(avg(top / n), 9) AS macro_purity FROM b GROUP BY depth""")
def prefix_rollup(spark, sf):
    return rounded(ids.prefix_rollup(codes(spark, sf), S, "label"))


@query(f"""WITH {CODES}, b AS (SELECT s1, s2, label, count(*) AS n FROM codes GROUP BY ALL), p AS (SELECT s1, s2, sum(n) AS n, max(n) AS top FROM b GROUP BY ALL)
SELECT round(sum(top) / sum(n), 9) AS micro, round(avg(top / n), 9) AS macro, count(*) AS buckets FROM p""")
def category_purity(spark, sf):
    out = ids.prefix_rollup(codes(spark, sf), S, "label").where("depth = 2")
    return rounded(out.select(F.col("micro_purity").alias("micro"), F.col("macro_purity").alias("macro"), "buckets"))


@query(f"""WITH {CODES}, j AS (SELECT s1, s2, label, count(*)::DOUBLE AS n FROM codes GROUP BY ALL), t AS (SELECT sum(n) AS t
FROM j), p AS (SELECT s1, s2, sum(n) AS n, max(n) AS top FROM j GROUP BY ALL), c AS (SELECT label, sum(n) AS n FROM j
GROUP BY ALL), h AS (SELECT (SELECT -sum(n / t * ln(n / t)) FROM j, t) AS hj, (SELECT -sum(n / t * ln(n / t))
FROM p, t) AS hp, (SELECT -sum(n / t * ln(n / t)) FROM c, t) AS hc, (SELECT sum(top) / max(t) FROM p, t) AS purity)
SELECT round(purity, 9) AS purity, round(greatest(0.0, hp + hc - hj), 9) AS mutual_information, round(greatest(0.0, hp + hc - hj) / sqrt(hp * hc),
9) AS nmi, round(hj - hp, 9) AS conditional_entropy FROM h""")
def nmi(spark, sf):
    return rounded(ids.mutual_information(codes(spark, sf), ["s1", "s2"], "label"))


@query(f"""WITH {CODES} SELECT vec_id, s1, s2, s3, count(*) OVER w AS bucket_size, CAST(CASE WHEN count(*) OVER w > 1 THEN row_number() OVER (PARTITION BY s1,
s2, s3 ORDER BY vec_id::VARCHAR) - 1 ELSE 0 END AS INTEGER) AS code FROM codes WINDOW w AS (PARTITION BY s1, s2, s3)""")
def collision_code(spark, sf):
    return ids.bucket_code(codes(spark, sf).select("vec_id", *S), S, F.col("vec_id").cast("string"), 0)


@query(f"""WITH {CODES}, d AS (SELECT vec_id, s1, s2, s3, CAST(CASE WHEN count(*) OVER w > 1 THEN row_number() OVER (PARTITION BY s1, s2, s3
ORDER BY vec_id::VARCHAR) - 1 ELSE -1 END AS INTEGER) AS code FROM codes WINDOW w AS (PARTITION BY s1, s2, s3))
SELECT vec_id, nullif(code, -1) AS dedup_code, s1 || '-' || s2 || '-' || s3 || CASE WHEN code >= 0 THEN '|d' || code ELSE '' END AS identifier_key,
'<S1_' || s1 || '><S2_' || s2 || '><S3_' || s3 || '>' || CASE WHEN code >= 0 THEN '<D_' || code || '>' ELSE '' END AS content FROM d""")
def dedup_code(spark, sf):
    out = ids.bucket_code(codes(spark, sf), S, F.col("vec_id").cast("string"), -1)
    return out.select(
        "vec_id",
        F.nullif(F.col("code"), F.lit(-1)).alias("dedup_code"),
        tokens.identifier_key(F.array(*S), F.col("code")).alias("identifier_key"),
        tokens.identifier_content(F.array(*S), F.col("code")).alias("content"),
    )


@query(f"WITH {CODES} SELECT vec_id, CAST(s1 * 64 + s2 * 8 + s3 AS BIGINT) AS packed, dense_rank() OVER (ORDER BY s1, s2) - 1 AS parent FROM codes")
def packed_parents(spark, sf):
    from cairnflow.operators.querystats import dense_ids

    c = codes(spark, sf)
    return c.join(dense_ids(c, ["s1", "s2"], "parent"), ["s1", "s2"]).select("vec_id", tokens.pack([F.col(x) for x in S], [8, 8, 8]).alias("packed"), "parent")


@query(f"""WITH {CODES}, f AS (SELECT s1, s2, s3, t3, count(*) AS n FROM codes
GROUP BY ALL), b AS (SELECT s1, s2, s3, sum(n) AS n, count(*) FILTER (n = 1) AS single, max(n) AS most, count(*) AS parts FROM f GROUP BY ALL)
SELECT CAST(sum(n) FILTER (n > 1) AS BIGINT) AS colliding_rows, CAST(sum(single) FILTER (n > 1) AS BIGINT) AS resolved_rows,
count(*) FILTER (n > 1) AS colliding_buckets, count(*) FILTER (n > 1 AND most = 1) AS resolved_buckets, CAST(sum(n - 1) AS BIGINT) AS excess_before,
CAST(sum(n - parts) AS BIGINT) AS excess_after FROM b""")
def collision_resolution(spark, sf):
    return ids.collision_resolution(codes(spark, sf), S, ["t3"])


def _excess(cols):
    return f"(SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM codes GROUP BY {cols}))"


@query(f"""WITH {CODES}, c AS (SELECT 0 AS step, 'base' AS stage, {_excess('s1, s2')} AS excess UNION ALL SELECT 1, 's3', {_excess('s1, s2, s3')} UNION ALL
SELECT 2, 's3+t3', {_excess('s1, s2, s3, t3')} UNION ALL SELECT 3, 'all', {_excess('s1, s2, s3, t3, label')})
SELECT step, stage, CAST(excess AS BIGINT) AS excess, CAST(first(excess) OVER (ORDER BY step) - excess AS BIGINT) AS from_base,
CAST(coalesce(lag(excess) OVER (ORDER BY step) - excess, 0) AS BIGINT) AS from_previous FROM c""")
def partition_cascade(spark, sf):
    return ids.cascade(codes(spark, sf), ["s1", "s2"], [("s3", ["s3"]), ("s3+t3", ["s3", "t3"]), ("all", ["s3", "t3", "label"])])


_MIGRATE = """m AS (SELECT *, count(*) OVER (PARTITION BY s1, s2) AS b, count(*) OVER (PARTITION BY s1, t3) AS a, count(*) OVER (PARTITION BY s1, s2, t3) AS c,
count(*) OVER (PARTITION BY s1, s2, label) AS sb, count(*) OVER (PARTITION BY s1, t3, label) AS sa FROM codes)"""


@query(f"""WITH {CODES}, {_MIGRATE} SELECT vec_id, b AS before_size, a AS after_size, c AS common,
round(CASE WHEN b + a - c - 1 = 0 THEN 1.0 ELSE (c - 1) / (b + a - c - 1) END, 9) AS peer_jaccard, (b <> c OR a <> c) AS changed FROM m""")
def peer_migration(spark, sf):
    return rounded(ids.migration(codes(spark, sf), ["s1", "s2"], ["s1", "t3"]).select("vec_id", "before_size", "after_size", "common", "peer_jaccard", "changed"))


@query(f"""WITH {CODES}, {_MIGRATE} SELECT vec_id, round(CASE WHEN b > 1 THEN (sb - 1) / (b - 1) END, 9) AS share_before,
round(CASE WHEN a > 1 THEN (sa - 1) / (a - 1) END, 9) AS share_after,
CAST(CASE WHEN a = 1 OR b = 1 THEN -2 ELSE sign((sa - 1) * (b - 1) - (sb - 1) * (a - 1)) END AS INTEGER) AS outcome FROM m""")
def peer_label_share(spark, sf):
    return rounded(ids.peer_labels(codes(spark, sf), ["s1", "s2"], ["s1", "t3"], "label").select("vec_id", "share_before", "share_after", "outcome"))


@query(f"""WITH {CODES}, p AS (SELECT 0 AS depth, '' AS prefix, s1 AS next_token FROM codes UNION ALL SELECT 1, s1::VARCHAR, s2 FROM codes UNION ALL
SELECT 2, s1 || '-' || s2, s3 FROM codes UNION ALL SELECT 3, s1 || '-' || s2 || '-' || s3, NULL FROM codes)
SELECT depth, prefix, next_token, count(*) AS rows FROM p GROUP BY ALL""")
def trie_levels(spark, sf):
    paths = codes(spark, sf).select(F.array(*S).alias("path"))
    return ids.prefix_table(paths, "path").withColumn("prefix", F.array_join(F.transform("prefix", lambda x: x.cast("string")), "-"))


@query(f"WITH {CODES} SELECT s1 AS source_code, s2 AS target_code, count(*) AS n FROM codes GROUP BY ALL")
def transition_matrix(spark, sf):
    return ids.transition_matrix(codes(spark, sf), "s1", "s2")


@query(f"WITH {CODES}, n AS (SELECT s1, s2, s3, count(*) AS n FROM codes GROUP BY ALL) SELECT s1, s2, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs FROM n GROUP BY ALL")
def parent_collisions(spark, sf):
    return ids.parent_collisions(codes(spark, sf), ["s1", "s2"], "s3")


@query(f"WITH {CODES} SELECT a.vec_id AS a, b.vec_id AS b FROM codes a JOIN codes b USING (s1, s2, s3) WHERE a.vec_id < b.vec_id")
def same_code_pairs(spark, sf):
    return negatives.same_code_pairs(codes(spark, sf), S, "vec_id")


@query(f"""WITH {CODES}, p AS (SELECT s1, unnest([0, 1, 2]) AS pos, unnest([s2, s3, t3]) AS t FROM codes), q AS (SELECT s1, pos, min(t) = max(t) AS same FROM p
GROUP BY ALL), k AS (SELECT s1, coalesce(min(pos) FILTER (NOT same), 3) AS p FROM q GROUP BY s1)
SELECT vec_id, CAST(p AS INTEGER) AS p, CAST(coalesce([s2, s3, t3][p + 1], -1) AS INTEGER) AS candidate1, CAST(coalesce(32 + 32 * [s2, s3,
t3][p + 1] + [s2, s3, t3][p + 2], -1) AS INTEGER) AS candidate2 FROM codes JOIN k USING (s1)""")
def prefix_candidates(spark, sf):
    c = codes(spark, sf).withColumn("tokens", F.array("s2", "s3", "t3"))
    return ids.common_prefix_candidates(c, ["s1"], "tokens").select("vec_id", "p", "candidate1", "candidate2")


@query(f"""WITH {CODES}, k AS (SELECT *, lpad(bin(s3 * 8 + t3), 6, '0') AS g, count(*) OVER (PARTITION BY s1, s2) AS n
FROM codes), x AS (SELECT *, count(*) OVER (PARTITION BY s1, s2, substr(g, 1, 2)) = 1 AS a2, count(*) OVER (PARTITION BY s1, s2, substr(g, 1,
4)) = 1 AS a4, count(*) OVER (PARTITION BY s1, s2, g) = 1 AS a6 FROM k WHERE n > 1)
SELECT vec_id, CASE WHEN a2 THEN 2 WHEN a4 THEN 4 WHEN a6 THEN 6 ELSE 0 END AS first_length FROM x""")
def first_separating_precision(spark, sf):
    c = codes(spark, sf).withColumn("g", F.lpad(F.bin(F.col("s3") * 8 + F.col("t3")), 6, "0"))
    return ids.first_precision(c, ["s1", "s2"], "g", [2, 4, 6]).select("vec_id", "first_length")


@query(f"""WITH {CODES}, k AS (SELECT s1, s2, [s3, t3] AS v, min(vec_id) AS vec_id, count(*) AS class_size FROM codes GROUP BY ALL) SELECT *
FROM (SELECT s1, s2, vec_id, class_size, count(*) OVER (PARTITION BY s1, s2) AS classes FROM k) WHERE classes > 1""")
def exact_vector_classes(spark, sf):
    return ids.exact_vector_classes(codes(spark, sf).withColumn("v", F.array("s3", "t3")), ["s1", "s2"], "v", "vec_id")


@query()
def bucket_compiler(spark, sf):
    """Greedy relation trees inside buckets (no relational form; tests hold its invariants)."""
    c = codes(spark, sf).withColumn("weight", (F.col("vec_id") % 7).cast("double"))
    return solvers.compile_buckets(c, "s1", "vec_id", ["s2", "s3", "t3"], "weight")


@query()
def shortest_descriptions(spark, sf):
    return solvers.shortest_descriptions(codes(spark, sf), "s1", "vec_id", ["s2", "s3", "t3", "label"])


@query()
def unique_pair_assignment(spark, sf):
    """Codes without repeats in buckets of three codes."""
    c = codes(spark, sf).select("vec_id", "s1", "s2", "s3").join(table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("v")), "vec_id")
    small = c.withColumn("bucket", F.concat_ws("-", "s1", "s2", "s3"))
    prototypes = [[(1.0 if (i >> b) & 1 else -1.0) * 0.1 for b in range(8)] for i in range(256)]
    return solvers.unique_pairs(small, "bucket", "vec_id", "v", prototypes)
