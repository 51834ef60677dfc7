"""Evaluation of identifiers and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnflow.functions import geo
from cairnflow.operators import evaluation as ev
from cairnflow.operators import identifiers as ids
from cairnflow.plans.base import CODES, KNN, PAIRS, POINTS, codes, points, query, rounded, table
from cairnflow.plans.log_queries import pairs_of
from cairnflow.plans.vector_queries import TARGET, neighbours, ranks

S = ["s1", "s2", "s3"]

_AVAILABLE = f"{TARGET}, a AS (SELECT query_id, nullif(r, -1) AS rank, 2 + query_id % 12 AS available FROM t)"
_HITS = ", ".join(f"CASE WHEN available >= {k} THEN coalesce(rank <= {k}, false)::INTEGER END AS hr_{k}, round(CASE WHEN available >= {k} THEN CASE WHEN rank <= {k} THEN 1 / log2(rank + 1.0) ELSE 0.0 END END, 9) AS ndcg_{k}" for k in (1, 3, 5, 10))


@query(f"WITH {_AVAILABLE} SELECT query_id, {_HITS} FROM a")
def hit_and_ndcg(spark, sf):
    r = ranks(spark, sf).select("query_id", F.when(F.col("target_rank") > 0, F.col("target_rank")).alias("rank"), (2 + F.col("query_id") % 12).alias("available"))
    return rounded(r.select("query_id", *ev.hit_and_ndcg(F.col("rank"), F.col("available"))))


#: An identifier of six, three and sometimes one token, a best candidate that differs in one place, and a rank.
_IDS = f"""{CODES}, i AS (SELECT vec_id, [s1, s2, s3, t3, s1, s2, s3, s1, s2] || CASE WHEN vec_id % 3 = 0 THEN [7] ELSE []::INTEGER[] END AS target,
CAST(nullif(vec_id % 14, 0) AS INTEGER) AS rank FROM codes),
j AS (SELECT *, CASE vec_id % 5 WHEN 0 THEN []::INTEGER[] WHEN 1 THEN list_concat([99], target[2:]) WHEN 2 THEN target[:6] || [99, 99,
99] WHEN 3 THEN target[:9] || [98] ELSE target END AS top1 FROM i)"""


def identifiers(spark, sf):
    c, k = codes(spark, sf), F.col("vec_id")
    target = F.concat(F.array("s1", "s2", "s3", "t3", "s1", "s2", "s3", "s1", "s2"), F.when(k % 3 == 0, F.array(F.lit(7))).otherwise(F.array().cast("array<int>")))
    rows = c.select("vec_id", target.alias("target"), F.nullif(k % 14, F.lit(0)).cast("int").alias("rank"))
    t, m = F.col("target"), k % 5
    nines = F.array(*[F.lit(99)] * 3)
    top1 = F.when(m == 0, F.array().cast("array<int>")).when(m == 1, F.concat(F.array(F.lit(99)), F.slice(t, F.lit(2), F.size(t)))).when(m == 2, F.concat(F.slice(t, 1, 6), nines)).when(m == 3, F.concat(F.slice(t, 1, 9), F.array(F.lit(98)))).otherwise(t)
    return rows.withColumn("top1", top1)


@query(
    f"""WITH {_IDS} SELECT vec_id, concat_ws(',',
CASE WHEN len(top1) < 6 OR top1[:6] <> target[:6] THEN 'top1_gid_error' WHEN len(top1) < 9 OR top1[7:9] <> target[7:9] THEN 'gid_correct_sid_error'
WHEN len(target) = 10 AND top1 <> target THEN 'base_pid_correct_dedup_error' END,
CASE WHEN rank > 1 AND rank <= 10 THEN 'target_in_top10_not_top1' END, CASE WHEN rank IS NULL OR rank > 10 THEN 'top10_miss' END) AS errors FROM j"""
)
def error_types(spark, sf):
    return identifiers(spark, sf).select("vec_id", F.array_join(ev.error_types(F.col("target"), F.col("top1"), F.col("rank")), ",").alias("errors"))


@query(f"WITH {_IDS} SELECT vec_id, " + ", ".join(f"coalesce(target[:{d}] = top1[:{d}], false){' OR vec_id % 4 = 1' if k == 10 else ''} AS prefix_{d}_hit_{k}" for d in (6, 9) for k in (1, 10)) + " FROM j")
def prefix_hits(spark, sf):
    i = identifiers(spark, sf).withColumn("beams", F.array("top1", F.when(F.col("vec_id") % 4 == 1, F.col("target")).otherwise(F.array(F.lit(0)))))
    return i.select("vec_id", *ev.prefix_hits(F.col("target"), F.col("beams"), [6, 9]))


_LOGITS = """l AS (SELECT vec_id, CAST(pos AS INTEGER) AS token, round(x, 3) AS logit, pos = 1 + vec_id % 64 AS hit, (pos + vec_id) % 3 <> 0 AS legal
FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings))"""


@query(
    f"""WITH {_LOGITS}, g AS (SELECT vec_id, max(logit) FILTER (hit) AS own, max(token) FILTER (hit) AS place FROM l GROUP BY 1)
SELECT vec_id, 1 + count(*) FILTER (logit > own OR (logit = own AND token < place)) AS rank,
1 + count(*) FILTER (legal AND (logit > own OR (logit = own AND token < place))) AS legal_rank,
round(ln(sum(exp(logit))) - max(own), 9) AS nll, round(sum(exp(logit)) FILTER (legal) / sum(exp(logit)), 9) AS legal_mass,
count(*) FILTER (legal) AS legal_count FROM l JOIN g USING (vec_id) GROUP BY vec_id"""
)
def token_observations(spark, sf):
    return rounded(ev.token_observation(logits(spark, sf), ["vec_id"], "token", "logit", F.col("hit"), F.col("legal")))


def logits(spark, sf):
    long = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "x"))
    pos = F.col("p") + 1
    return long.select(
        "vec_id",
        pos.cast("int").alias("token"),
        F.round(F.col("x").cast("double"), 3).alias("logit"),
        (pos == 1 + F.col("vec_id") % 64).alias("hit"),
        ((pos + F.col("vec_id")) % 3 != 0).alias("legal"),
    )


@query(
    f"""WITH {_LOGITS}, p AS (SELECT vec_id, max(logit) FILTER (hit) AS zp FROM l
GROUP BY 1), s AS (SELECT vec_id, ln(sum(exp(logit / 0.05))) - max(zp) / 0.05 AS loss, 1.0 + vec_id % 3 AS w
FROM l JOIN p USING (vec_id) WHERE hit OR legal GROUP BY vec_id) SELECT round(sum(w * loss) / sum(w), 7) AS loss, count(*) AS samples FROM s"""
)
def weighted_info_nce(spark, sf):
    rows = logits(spark, sf).withColumn("w", 1.0 + F.col("vec_id") % 3)
    return rounded(ev.info_nce(rows, "vec_id", "logit", F.col("hit"), F.col("legal"), "w", 0.05), 7)


@query(
    """WITH r AS (SELECT l_linenumber AS stage, l_quantity > 10 AS ok, l_discount AS nll, l_tax AS mass
FROM lineitem), p AS (SELECT stage, count(*) AS samples, avg(nll) AS nll, avg(mass) AS mass, avg(ok::INTEGER) AS survival FROM r GROUP BY 1)
SELECT stage, samples, round(nll, 9) AS nll, round(mass, 9) AS mass, round(survival, 9) AS survival,
round(coalesce(lag(survival) OVER (ORDER BY stage), 1.0) - survival, 9) AS first_failure FROM p"""
)
def stage_diagnostics(spark, sf):
    r = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("stage"),
        F.col("l_linenumber").alias("o"),
        (F.col("l_quantity") > 10).alias("ok"),
        F.col("l_discount").alias("nll"),
        F.col("l_tax").alias("mass"),
    )
    return rounded(ev.stage_rollup(r, "stage", "o", ["nll", "mass"], "ok"))


_SCORED = f"""{KNN}, sc AS (SELECT query_id, query_label, coalesce(min(rank) FILTER (label = query_label AND id <> query_id), 999) AS r,
max(score) FILTER (label = query_label AND id <> query_id) AS p, max(score) FILTER (label <> query_label) AS h FROM knn WHERE rank <= 20 GROUP BY ALL)"""


def scored(spark, sf):
    n = neighbours(spark, sf)
    own = (F.col("label") == F.col("query_label")) & (F.col("id") != F.col("query_id"))
    return n.groupBy("query_id", "query_label").agg(
        F.coalesce(F.min(F.when(own, F.col("rank"))), F.lit(999)).alias("r"),
        F.max(F.when(own, F.col("score"))).alias("p"),
        F.max(F.when(F.col("label") != F.col("query_label"), F.col("score"))).alias("h"),
    )


_RECALLS = "count(*) AS rows, " + ", ".join(f"round(avg((r <= {k})::INTEGER), 6) AS recall_at_{k}" for k in (1, 10, 50, 100)) + ", round(avg(p), 6) AS mean_positive_score, round(avg(h), 6) AS mean_hardest_negative_score, round(avg(p - h), 6) AS mean_hard_margin"


@query(f"WITH {_SCORED} SELECT query_label, {_RECALLS} FROM sc GROUP BY query_label")
def recall_by_label(spark, sf):
    return rounded(ev.recall_metrics(scored(spark, sf), "r", "p", "h", ["query_label"]), 6)


_GATE = f"""{_SCORED}, m AS (SELECT avg((r <= 10)::INTEGER) AS r1, avg((r <= 9 + query_id % 2)::INTEGER) AS r2, avg(p - h) AS m1, avg(p - h) + 0.01 AS m2,
avg((r <= 10)::INTEGER) FILTER (query_label < 5) AS h1, avg((r <= 10)::INTEGER) FILTER (query_label < 5) + 0.1 AS h2 FROM sc)"""


@query(f"WITH {_GATE} SELECT r2 - r1 >= -1e-12 AND (r2 - r1 > 1e-12 OR m2 - m1 > 1e-12) AS gate_passes, false AS identity_fallback FROM m")
def adapter_gate(spark, sf):
    s = scored(spark, sf).withColumn("m", F.col("p") - F.col("h"))
    hard = F.col("query_label") < 5
    every = [
        s.agg(F.lit("raw").alias("run"), F.lit("overall").alias("subset"), ev.rate(F.col("r") <= 10).alias("recall_at_10"), F.avg("m").alias("mean_hard_margin")),
        s.agg(F.lit("adapted"), F.lit("overall"), ev.rate(F.col("r") <= 9 + F.col("query_id") % 2), F.avg("m") + 0.01),
        s.where(hard).agg(F.lit("raw"), F.lit("hard"), ev.rate(F.col("r") <= 10), F.lit(0.5)),
        s.where(hard).agg(F.lit("adapted"), F.lit("hard"), ev.rate(F.col("r") <= 10) + 0.1, F.lit(0.5)),
    ]
    return ev.gate(every[0].union(every[1]).union(every[2]).union(every[3]))


@query(
    f"""WITH {_SCORED}, v AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_concat(list_slice(embedding::DOUBLE[], 1, 63),
[embedding[64]::DOUBLE + (vec_id % 3) / 10.0]) AS y FROM embeddings),
d AS (SELECT sc.*, 1 - least(1, greatest(-1, list_inner_product(x, y) / sqrt(list_inner_product(x, x)) / sqrt(list_inner_product(y, y)))) AS drift
FROM sc JOIN v ON vec_id = query_id)
SELECT count(*) AS rows, {", ".join(f"round(avg((r <= {k})::INTEGER), 9) AS recall_at_{k}" for k in (1, 5, 10, 20))},
round(avg(CASE WHEN r <= 10 THEN 1.0 / r ELSE 0 END), 9) AS mrr_at_10,
count(*) FILTER (query_label < 5) AS difficult_rows, round(avg((r <= 10)::INTEGER) FILTER (query_label < 5), 9) AS difficult_recall_at_10, round(avg(drift), 9) AS drift_mean,
round(quantile_cont(drift, 0.5), 9) AS drift_p50, round(quantile_cont(drift, 0.9), 9) AS drift_p90, round(quantile_cont(drift, 0.99), 9) AS drift_p99,
round(max(drift), 9) AS drift_max FROM d"""
)
def retrieval_report(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("x"))
    y = F.concat(F.slice("x", 1, 63), F.array(F.element_at("x", 64) + (F.col("query_id") % 3) / 10.0))
    rows = scored(spark, sf).join(e, "query_id").withColumn("y", y)
    return rounded(ev.retrieval_report(rows, "r", F.col("query_label") < 5, "x", "y"))


_RUNS = f"{_SCORED}, runs AS (SELECT query_label AS epoch, avg((r <= 10)::INTEGER) AS r10, avg((r <= 1)::INTEGER) AS r1, avg(p) AS mp FROM sc GROUP BY 1)"


def runs(spark, sf):
    return scored(spark, sf).groupBy(F.col("query_label").alias("epoch")).agg(ev.rate(F.col("r") <= 10).alias("r10"), ev.rate(F.col("r") <= 1).alias("r1"), F.avg("p").alias("mp"))


@query(f"WITH {_RUNS} SELECT epoch, round(r10, 9) AS r10, round(r1, 9) AS r1 FROM runs ORDER BY r10 DESC, r1 DESC, epoch LIMIT 1")
def best_epoch(spark, sf):
    return rounded(ev.best_run(runs(spark, sf), [F.desc("r10"), F.desc("r1"), F.col("epoch")]).select("epoch", "r10", "r1"))


@query(f"WITH {_RUNS} SELECT epoch FROM runs ORDER BY round(mp, 6) DESC, r1 DESC, r10 DESC, epoch DESC LIMIT 1")
def best_checkpoint(spark, sf):
    return ev.best_run(runs(spark, sf), [F.desc(F.round("mp", 6)), F.desc("r1"), F.desc("r10"), F.desc("epoch")]).select("epoch")


_BRANCHES = """b AS (SELECT CASE l_linenumber WHEN 1 THEN 'canonical' WHEN 2 THEN 'no_graph' WHEN 3 THEN 'no_prior' WHEN 4 THEN 'neither' END AS branch,
avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1)"""


@query(
    f"""WITH {_BRANCHES}, u AS (SELECT branch, 'q' AS measure, q AS v FROM b UNION ALL SELECT branch, 'd', d FROM b), c AS (SELECT measure, v AS own FROM u
WHERE branch = 'canonical')
SELECT branch, measure, round(own - v, 9) AS contrast FROM u JOIN c USING (measure) WHERE branch <> 'canonical'
UNION ALL SELECT 'interaction', measure, round(sum(CASE WHEN branch IN ('canonical', 'neither') THEN v ELSE -v END), 9) FROM u GROUP BY measure"""
)
def factor_contrasts(spark, sf):
    return rounded(ev.contrasts(branches(spark, sf), "branch", "canonical", ["q", "d"], ("neither", "no_graph", "no_prior")))


def branches(spark, sf):
    n = F.col("l_linenumber")
    name = F.when(n == 1, "canonical").when(n == 2, "no_graph").when(n == 3, "no_prior").when(n == 4, "neither")
    return table(spark, sf, "lineitem").where("l_linenumber <= 4").groupBy(name.alias("branch")).agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"))


@query(f"""WITH {_BRANCHES}, w AS (SELECT max(q) FILTER (branch = 'canonical') AS a, max(q) FILTER (branch = 'no_graph') AS b,
max(q) FILTER (branch = 'no_prior') AS c, max(q) FILTER (branch = 'neither') AS d FROM b)
SELECT round(b - a, 9) AS parent_change, round(c - b, 9) AS content_refit, round(d - c, 9) AS coupling_cost, round(d - a, 9) AS total FROM w""")
def additive_decomposition(spark, sf):
    one = branches(spark, sf).agg(*[F.max(F.when(F.col("branch") == n, F.col("q"))).alias(n) for n in ("canonical", "no_graph", "no_prior", "neither")])
    return rounded(one.select(*ev.additive_decomposition(F.col("canonical"), F.col("no_graph"), F.col("no_prior"), F.col("neither"))))


@query(
    """WITH t AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, value - lag(value) OVER (PARTITION BY event_type
ORDER BY event_id) AS imp FROM events),
m AS (SELECT *, coalesce(i > 6 AND imp < -0.5, false) AS worse FROM t), g AS (SELECT *, sum((NOT worse)::INTEGER) OVER (PARTITION BY event_type
ORDER BY i) AS island FROM m)
SELECT event_type, CAST(i AS INTEGER) AS i, CAST(sum(worse::INTEGER) OVER (PARTITION BY event_type, island ORDER BY i) AS INTEGER) AS streak FROM g"""
)
def objective_streaks(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("event_id")
    t = table(spark, sf, "events").select("event_type", F.row_number().over(w).alias("i"), (F.col("value") - F.lag("value").over(w)).alias("imp"))
    return ev.increase_streak(t, "i", "imp", 6, 0.5, ["event_type"]).select("event_type", "i", "streak")


@query(
    """WITH d AS (SELECT lang, length(coalesce(text, '')) AS n, source = 'src0' AS hot, doc_id % 3 = 0 AS third, CASE WHEN doc_id % 5 = 0 THEN 'e' END AS err
FROM documents WHERE lang IS NOT NULL)
SELECT lang, count(*) AS rows, round(avg(n), 6) AS mean_length, round(quantile_cont(n, 0.25), 6) AS p25_length, round(quantile_cont(n, 0.5),
6) AS p50_length, round(quantile_cont(n, 0.75), 6) AS p75_length,
round(avg(CASE WHEN hot THEN 1.0 ELSE 0.0 END), 9) AS hot, round(avg(third::INTEGER), 9) AS third, count(err) AS errors FROM d GROUP BY ROLLUP (lang)"""
)
def case_summary(spark, sf):
    d = table(spark, sf, "documents").where("lang is not null").select(
        "lang",
        F.length(F.coalesce("text", F.lit(""))).alias("n"),
        (F.col("source") == "src0").alias("hot"),
        (F.col("doc_id") % 3 == 0).alias("third"),
        F.when(F.col("doc_id") % 5 == 0, "e").alias("err"),
    )
    out = ev.case_summary(d, "lang", "n", ["hot", "third"], "err")
    return out.select(
        "lang",
        "rows",
        *[F.round(c, 6).alias(c) for c in ("mean_length", "p25_length", "p50_length", "p75_length")],
        *[F.round(c, 9).alias(c) for c in ("hot", "third")],
        "errors",
    )


@query(f"""WITH {CODES} SELECT count(*) AS rows, round(avg((s1 = s1)::INTEGER), 9) AS same_s1, round(avg((s2 = s3)::INTEGER), 9) AS same_s2,
round(avg((s3 = t3)::INTEGER), 9) AS same_s3, 1.0::DOUBLE AS same_to_s1, round(avg((s2 = s3)::INTEGER), 9) AS same_to_s2,
round(avg((s2 = s3 AND s3 = t3)::INTEGER), 9) AS same_to_s3 FROM codes""")
def branch_agreement(spark, sf):
    c = codes(spark, sf)
    return rounded(ev.branch_agreement(c, c.select("vec_id", "s1", F.col("s3").alias("s2"), F.col("t3").alias("s3")), "vec_id", S))


@query(f"""WITH {CODES}, n AS (SELECT count(*) AS n FROM codes GROUP BY s1, s2, s3)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS \"distinct\", round(count(*) / sum(n), 9) AS distinct_ratio,
CAST(sum(n) - count(*) AS BIGINT) AS excess, quantile_cont(n, 0.5) AS p50, round(quantile_cont(n, 0.9), 9) AS p90, round(quantile_cont(n, 0.99),
9) AS p99, max(n) AS largest FROM n""")
def code_distribution(spark, sf):
    return rounded(ev.code_distribution(codes(spark, sf), S))


_PREFIXED = f"""{PAIRS}, pre AS (SELECT query, CAST(substr(poi, 2) AS BIGINT) % 6 AS a, n FROM pairs), z AS (SELECT a, count(DISTINCT poi) AS size
FROM (SELECT poi, CAST(substr(poi, 2) AS BIGINT) % 6 AS a FROM pairs) GROUP BY a)"""


@query(
    f"""WITH {_PREFIXED}, g AS (SELECT query, a, sum(n)::DOUBLE AS n FROM pre GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY query) AS t FROM g
JOIN z USING (a))
SELECT query, count(*) AS prefixes, round(max(n / t), 9) AS top_share, round(abs(-sum(n / t * log2(n / t))), 6) AS entropy_bits,
round(sum(n / t * size), 9) AS expected_bucket FROM t GROUP BY query"""
)
def prefix_mass(spark, sf):
    p = pairs_of(spark, sf).withColumn("a", F.substring("poi", 2, 20).cast("long") % 6)
    sizes = p.select("poi", "a").distinct().groupBy("a").agg(F.count(F.lit(1)).alias("size"))
    out = ev.prefix_mass(p, "query", ["a"], "n", sizes, "size")
    return out.select(
        "query",
        "prefixes",
        F.round("top_share", 9).alias("top_share"),
        F.round("entropy_bits", 6).alias("entropy_bits"),
        F.round("expected_bucket", 9).alias("expected_bucket"),
    )


@query(f"""WITH {CODES}, n AS (SELECT r.range AS code, count(s1) AS n FROM range(10) r LEFT JOIN codes ON s1 = r.range GROUP BY 1)
SELECT count(*) FILTER (n > 0) AS used, round(avg(16.0 / (n + 16)), 9) AS mean, round(quantile_cont((16.0 / (n + 16))::DOUBLE, 0.5), 9) AS median,
round(max(16.0 / (n + 16)), 9)::DOUBLE AS largest FROM n""")
def prior_mass(spark, sf):
    return rounded(ev.prior_mass(codes(spark, sf), "s1", 10, 16.0))


def _purity(d: int) -> str:
    key = ", ".join(S[:d])
    top = lambda c: f"(SELECT {key}, max(k) AS top_{c} FROM (SELECT {key}, {c}, count(*) AS k FROM codes GROUP BY ALL) GROUP BY {key})"
    several = lambda c: f"round(sum(top_{c}) FILTER (n > 1) / sum(n) FILTER (n > 1), 9)"
    return f"""SELECT {d} AS depth, count(*) AS prefixes, round(coalesce(sum(n) FILTER (n = 1), 0) / sum(n), 9) AS singleton_share, max(n) AS max_bucket,
round(sum(top_label) / sum(n), 9) AS label_purity, {several('label')} AS label_purity_several, round(sum(top_t3) / sum(n), 9) AS t3_purity,
{several('t3')} AS t3_purity_several FROM (SELECT {key}, count(*) AS n FROM codes GROUP BY ALL) JOIN {top('label')} USING ({key})
JOIN {top('t3')} USING ({key})"""


@query(f"WITH {CODES} " + " UNION ALL ".join(_purity(d) for d in (1, 2, 3)))
def purity_levels(spark, sf):
    return rounded(ev.purity_levels(codes(spark, sf), S, ["label", "t3"]))


@query(
    f"""WITH {CODES}, m AS (SELECT label, t3 <> s2 AS rec, count(*) OVER (PARTITION BY s1, s2) AS b, count(*) OVER (PARTITION BY s1, t3) AS a,
count(*) OVER (PARTITION BY s1, s2, t3) AS c FROM codes)
SELECT label, count(*) AS rows, count(*) FILTER (rec) AS recoded, count(*) FILTER (b <> c OR a <> c) AS peers_changed,
count(*) FILTER (rec AND (b <> c OR a <> c)) AS recoded_with_new_peers,
count(*) FILTER (b = 1 AND a > 1) AS singleton_to_bucket, count(*) FILTER (b > 1 AND a = 1) AS bucket_to_singleton,
round(avg(CASE WHEN b + a - c - 1 = 0 THEN 1.0 ELSE (c - 1) / (b + a - c - 1) END), 9) AS mean_peer_jaccard FROM m GROUP BY label"""
)
def migration_summary(spark, sf):
    moves = ids.migration(codes(spark, sf), ["s1", "s2"], ["s1", "t3"])
    return rounded(ev.migration_summary(moves, F.col("t3") != F.col("s2"), "label"))


_HAVERSINE = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"


@query(
    f"""WITH {POINTS}, n AS (SELECT nation, count(*) AS n FROM points GROUP BY 1), p AS (SELECT {_HAVERSINE} AS d FROM points a
JOIN points b ON a.nation = b.nation AND a.id < b.id JOIN n ON n.nation = a.nation WHERE n BETWEEN 2 AND 45)
SELECT count(*) AS pairs, round(quantile_cont(d, 0.5), 3) AS p50, round(quantile_cont(d, 0.9), 3) AS p90, round(max(d), 3) AS largest,
count(*) FILTER (d <= 5000) AS within_5000, count(*) FILTER (d <= 20000) AS within_20000,
(SELECT count(*) FILTER (n > 45) FROM n) AS large_clusters FROM p"""
)
def pair_distances(spark, sf):
    d = geo.haversine(F.col("a.lng"), F.col("a.lat"), F.col("b.lng"), F.col("b.lat"))
    return rounded(ev.pair_distances(points(spark, sf), ["nation"], "id", d, [5000, 20000], 45), 3)
