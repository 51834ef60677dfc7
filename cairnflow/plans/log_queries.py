"""Query log: statistics, supervision and the layered graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnflow.operators import catalog, querystats, sampling, supervision
from cairnflow.plans.base import CATEGORIES, EDGES, LOG, PAIRS, PROFILE, SUPERVISED, categories, log, query, rounded, table

PROFILE_COLUMNS = [
    "query",
    "query_count",
    "distinct_poi_count",
    "top1_poi_id",
    "top1_count",
    "top1_share",
    "top2_share",
    "margin",
    "entropy",
    "normalized_entropy",
    "is_high_confidence",
    "sid_weight",
]


def sql_rounded(columns: list[str], doubles: set[str]) -> str:
    return ", ".join(f"round({c}, 9) AS {c}" if c in doubles else c for c in columns)


def pairs_of(spark, sf):
    return querystats.pair_counts(log(spark, sf))


def supervised_of(spark, sf):
    pairs = pairs_of(spark, sf)
    return pairs, categories(pairs), supervision.supervise(pairs, categories(pairs), querystats.query_profile(pairs))


@query(f"WITH {PROFILE} SELECT {sql_rounded(PROFILE_COLUMNS, {'top1_share', 'top2_share', 'margin', 'entropy', 'normalized_entropy', 'sid_weight'})} FROM profile")
def query_profile(spark, sf):
    return rounded(querystats.query_profile(pairs_of(spark, sf)).select(*PROFILE_COLUMNS))


@query(f"""WITH {PROFILE} SELECT p.query, p.poi, p.n, round(p.n / query_count, 9) AS pair_share, poi = top1_poi_id AS is_top1,
(poi = top1_poi_id AND is_high_confidence) AS retained_for_sid, round(CASE WHEN poi = top1_poi_id AND is_high_confidence THEN sid_weight ELSE 0.0 END,
9) AS sid_weight FROM pairs p JOIN profile USING (query)""")
def query_poi_pairs(spark, sf):
    pairs = pairs_of(spark, sf)
    return rounded(querystats.pair_shares(pairs, querystats.query_profile(pairs)))


@query(f"WITH {PAIRS} SELECT query, poi, n, round(s, 9) AS pair_share FROM (SELECT *, n / sum(n) OVER (PARTITION BY query) AS s FROM pairs) WHERE n >= 2 AND s >= 0.10")
def false_negative_mask(spark, sf):
    return rounded(querystats.false_negative_mask(pairs_of(spark, sf)))


@query(f"WITH {PAIRS} SELECT query, CAST(sum(n) AS BIGINT) AS order_count, count(*) AS poi_df FROM pairs GROUP BY query")
def query_totals(spark, sf):
    return querystats.query_totals(pairs_of(spark, sf))


@query(f"WITH {PAIRS} SELECT poi, CAST(sum(n) AS BIGINT) AS order_count, count(*) AS query_df FROM pairs GROUP BY poi")
def poi_stats(spark, sf):
    return querystats.entity_totals(pairs_of(spark, sf))


@query(f"""WITH {PAIRS} SELECT (SELECT count(*) FROM log) AS log_rows, CAST(sum(n) AS BIGINT) AS by_query, count(*) AS df_by_query,
count(DISTINCT query) AS queries, CAST(sum(n) AS BIGINT) AS by_poi, count(*) AS df_by_poi, count(DISTINCT poi) AS pois, (SELECT count(*)
FROM log) = sum(n) AS holds FROM pairs""")
def conservation_check(spark, sf):
    rows = log(spark, sf)
    return querystats.conservation(rows, querystats.pair_counts(rows))


@query(f"""WITH {LOG}, f AS (SELECT query, raw, count(*) AS n FROM log GROUP BY ALL) SELECT query, raw AS representative_raw
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, raw) AS r FROM f) WHERE r = 1""")
def representative_query(spark, sf):
    return querystats.representative(log(spark, sf))


@query(f"WITH {LOG} SELECT query, dense_rank() OVER (ORDER BY query) - 1 AS query_id FROM (SELECT DISTINCT query FROM log)")
def dense_vocab(spark, sf):
    return querystats.dense_ids(log(spark, sf), ["query"], "query_id")


@query("""WITH m AS (SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events
GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY minute) AS cum, floor(sum(n) OVER () * 0.8 + 0.5) AS goal FROM m)
SELECT minute AS cutoff_minute, CAST(goal AS BIGINT) AS goal, CAST(cum AS BIGINT) AS cumulative, n AS minute_rows FROM c WHERE cum >= goal
ORDER BY minute LIMIT 1""")
def temporal_cutoff(spark, sf):
    return querystats.temporal_cutoff(table(spark, sf, "events"), "ts", 0.8)


@query(f"""WITH {PAIRS}, h AS (SELECT query, poi, count(*) AS h FROM log WHERE ts >= TIMESTAMP '2000-01-01'
GROUP BY ALL), d AS (SELECT query, poi, n - coalesce(h, 0) AS n FROM pairs LEFT JOIN h USING (query, poi))
SELECT query, poi, n, count(*) OVER (PARTITION BY query) AS poi_df FROM d WHERE n > 0""")
def early_pairs(spark, sf):
    rows = log(spark, sf)
    return querystats.subtract_holdout(querystats.pair_counts(rows), querystats.pair_counts(rows.where("ts >= timestamp'2000-01-01'")))


SUP_COLUMNS = [
    "query",
    "supervision_depth",
    "dominant_fine",
    "dominant_coarse",
    "fine_concentration",
    "fine_entropy",
    "coarse_concentration",
    "coarse_entropy",
    "support_score",
    "s1_reliability",
    "s2_reliability",
    "s3_reliability",
]


@query(f"WITH {SUPERVISED} SELECT {sql_rounded(SUP_COLUMNS, set(SUP_COLUMNS[4:]))} FROM sup")
def category_supervision_depth(spark, sf):
    return rounded(supervised_of(spark, sf)[2].select(*SUP_COLUMNS))


EDGE_COLUMNS = ["query", "poi", "n", "supervision_depth", "layer", "fine", "coarse", "edge_probability", "query_reliability", "edge_weight"]


@query(f"WITH {EDGES} SELECT {sql_rounded(EDGE_COLUMNS, set(EDGE_COLUMNS[7:]))} FROM edges")
def layer_edges(spark, sf):
    pairs, cat, sup = supervised_of(spark, sf)
    return rounded(supervision.layer_edges(pairs, cat, sup).select(*EDGE_COLUMNS))


def _depth_sql(name):
    f, c = supervision.SETTINGS[name]
    return f"""CASE WHEN is_high_confidence THEN 3 WHEN query_count >= {f.count} AND fine_concentration >= {f.concentration} AND fine_entropy <= {f.entropy} THEN 2
WHEN query_count >= {c.count} AND coarse_concentration >= {c.concentration} AND coarse_entropy <= {c.entropy} THEN 1 ELSE 0 END"""


@query(f"WITH {SUPERVISED}, g AS (" + " UNION ALL ".join(f"SELECT '{s}' AS setting, {_depth_sql(s)} AS supervision_depth FROM sup" for s in supervision.SETTINGS) + ") SELECT setting, supervision_depth, count(*) AS queries, round(count(*) / (SELECT count(*) FROM sup), 9) AS ratio FROM g GROUP BY 1, 2")
def depth_sensitivity(spark, sf):
    return rounded(supervision.sensitivity(supervised_of(spark, sf)[2]))


@query(f"""WITH {EDGES}, mass AS (SELECT query, layer, sum(edge_probability) AS p, sum(edge_weight) AS w, count(*) AS n FROM edges GROUP BY ALL)
SELECT layer, count(*) AS queries, CAST(sum(n) AS BIGINT) AS edges, round(sum(w), 6) AS weight, max(abs(p - 1)) < 1e-9 AS conserved FROM mass
GROUP BY layer""")
def graph_mass_by_layer(spark, sf):
    pairs, cat, sup = supervised_of(spark, sf)
    mass = supervision.graph_mass(supervision.layer_edges(pairs, cat, sup))
    return mass.select("layer", "queries", "edges", F.round("weight", 6).alias("weight"), (F.col("worst") < 1e-9).alias("conserved"))


@query(f"WITH {EDGES} SELECT DISTINCT poi FROM (SELECT poi FROM edges WHERE layer <= 2 AND query LIKE 'q1%' UNION ALL SELECT poi FROM cat WHERE coarse = 'c0')")
def graph_closure(spark, sf):
    pairs, cat, sup = supervised_of(spark, sf)
    return supervision.closed_selection(supervision.layer_edges(pairs, cat, sup), sup.where("query like 'q1%'"), cat.where("coarse = 'c0'"))


@query(f"""WITH {LOG}, n AS (SELECT poi, hour(ts) AS h, extract(month FROM ts) AS m, count(*) AS n FROM log
GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY poi ORDER BY n DESC, m) AS r FROM n) SELECT poi, string_agg(CAST(m AS VARCHAR), ','
ORDER BY r) AS top_months FROM r WHERE r <= 3 GROUP BY poi""")
def feature_top_months(spark, sf):
    top = catalog.top_features(log(spark, sf).withColumn("m", F.month("ts")), "poi", "m", 3)
    return top.select("poi", F.array_join(F.transform("top", lambda x: x.cast("string")), ",").alias("top_months"))


@query("""WITH n AS (SELECT event_type, hour(ts) AS h, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type
ORDER BY n DESC, h) AS r FROM n) SELECT event_type, string_agg(CAST(h AS VARCHAR), ',' ORDER BY r) AS top_hours FROM r WHERE r <= 10
GROUP BY event_type""")
def feature_top_hours(spark, sf):
    top = catalog.top_features(table(spark, sf, "events").withColumn("h", F.hour("ts")), "event_type", "h", 10)
    return top.select("event_type", F.array_join(F.transform("top", lambda x: x.cast("string")), ",").alias("top_hours"))


@query("""WITH n AS (SELECT event_type, user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL
GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS r FROM n)
SELECT event_type, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY r) AS top_visitors FROM r WHERE r <= 10 GROUP BY event_type""")
def feature_top_visitors(spark, sf):
    top = catalog.top_features(table(spark, sf, "events").where("user_id is not null"), "event_type", "user_id", 10)
    return top.select("event_type", F.array_join(F.transform("top", lambda x: x.cast("string")), ",").alias("top_visitors"))


ACTIVE = """a AS (SELECT id, bool_or(c) AS in_current, bool_or(NOT c) AS in_history FROM (SELECT l_partkey AS id, true AS c FROM lineitem
WHERE l_shipdate >= TIMESTAMP '2001-06-01' UNION ALL SELECT l_partkey, false FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01') GROUP BY id)"""


def active_of(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "id")
    return catalog.active_ids(li.where("l_shipdate >= timestamp'2001-06-01'"), li.where("l_shipdate < timestamp'1996-01-01'"), "id")


@query(f"""WITH {ACTIVE} SELECT count(*) FILTER (in_current) AS current_ids, count(*) FILTER (in_history) AS history_ids,
count(*) FILTER (in_current AND in_history) AS both, count(*) FILTER (in_current AND NOT in_history) AS only_current,
count(*) FILTER (in_history AND NOT in_current) AS only_history, count(*) AS union_ids FROM a""")
def active_catalog_counts(spark, sf):
    return catalog.set_counts(active_of(spark, sf))


@query(f"WITH {ACTIVE} SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT id FROM a)")
def active_catalog(spark, sf):
    kept, _ = catalog.filter_catalog(table(spark, sf, "part").withColumnRenamed("p_partkey", "id"), active_of(spark, sf), "id")
    return kept.select(F.col("id").alias("p_partkey"), "p_name")


@query("""SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS aligned, count(*) FILTER (a IS NULL OR b IS NULL) AS missing,
count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND x IS DISTINCT FROM y) AS different FROM (SELECT l_orderkey AS a, max(l_quantity) AS x
FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1) FULL JOIN (SELECT l_orderkey AS b, max(l_quantity) AS y FROM lineitem WHERE l_linenumber >= 2
GROUP BY 1) ON a = b""")
def paired_alignment(spark, sf):
    li = table(spark, sf, "lineitem")
    side = lambda c: li.where(c).groupBy("l_orderkey").agg(F.max("l_quantity").alias("q"))
    return catalog.alignment([side("l_linenumber <= 3"), side("l_linenumber >= 2")], "l_orderkey", ["q"])


@query("""SELECT count(*) AS found, CAST(coalesce(sum(CASE WHEN p >= o_custkey THEN 1 ELSE 0 END), 0) AS BIGINT) AS out_of_order
FROM (SELECT o_custkey, lag(o_custkey) OVER (ORDER BY o_orderkey) AS p FROM orders)""")
def monotone_alignment(spark, sf):
    o = table(spark, sf, "orders")
    out = catalog.monotone_rows(o.select("o_orderkey", F.col("o_orderkey").alias("position")), o.select("o_orderkey", F.col("o_custkey").alias("row_index")), "o_orderkey")
    return out.select("found", F.col("out_of_order").cast("long").alias("out_of_order"))


@query("""WITH t AS (SELECT fault FROM (SELECT unnest([CASE WHEN NOT o_totalprice > 1000 THEN 'price' END, CASE WHEN NOT o_orderstatus IN ('O',
'F') THEN 'status' END, CASE WHEN NOT o_orderpriority <> '5-LOW' THEN 'priority' END]) AS fault FROM orders) WHERE fault IS NOT NULL)
SELECT fault, count(*) AS rows FROM t GROUP BY fault""")
def contract_anomalies(spark, sf):
    rules = {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus").isin("O", "F"), "priority": F.col("o_orderpriority") != "5-LOW"}
    return catalog.anomalies(table(spark, sf, "orders"), catalog.contract(rules))


@query("""WITH v AS (SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 2)
SELECT value, n, CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS id FROM v QUALIFY id <= 20""")
def vocab_min_support(spark, sf):
    return catalog.vocabulary(table(spark, sf, "part").withColumnRenamed("p_name", "value"), "value", 2, 20)


@query("SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_name, p_brand, p_type, p_size) AS representative FROM part")
def equivalent_entities(spark, sf):
    return catalog.equivalent(table(spark, sf, "part").withColumnRenamed("p_partkey", "id"), ["p_name", "p_brand", "p_type", "p_size"], "id")


@query(f"""WITH {LOG}, tr AS (SELECT query, poi AS target FROM log WHERE ts < TIMESTAMP '1996-06-01'), r AS (SELECT DISTINCT query, poi AS target FROM log
WHERE ts >= TIMESTAMP '2001-01-01'), f AS (SELECT target, count(*) AS f FROM tr GROUP BY 1) SELECT stratum, count(*) AS rows
FROM (SELECT CASE WHEN coalesce(f, 0) = 0 THEN 'cold' WHEN f <= 5 THEN 'long_tail' WHEN query IN (SELECT query
FROM tr) AND (query, target) NOT IN (SELECT (query, target) FROM tr) THEN 'seen_query_new_pair' WHEN query NOT IN (SELECT query
FROM tr) THEN 'unseen_query' ELSE 'none' END AS stratum FROM r LEFT JOIN f USING (target)) GROUP BY 1""")
def generalization_strata(spark, sf):
    rows = log(spark, sf).select("query", F.col("poi").alias("target"), "ts")
    m = sampling.membership(rows.where("ts < timestamp'1996-06-01'"), rows.where("ts >= timestamp'2001-01-01'").select("query", "target").distinct())
    s = sampling.generalization_stratum(F.col("query_seen"), F.col("pair_seen"), F.col("target_frequency"))
    return m.groupBy(F.coalesce(s, F.lit("none")).alias("stratum")).agg(F.count(F.lit(1)).alias("rows"))
