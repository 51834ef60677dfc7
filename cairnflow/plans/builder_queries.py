"""Training messages, identifier tables, staged resolution and reranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairnflow.functions import geo
from cairnflow.operators import builders as bd
from cairnflow.operators import messages
from cairnflow.operators import resolution as rs
from cairnflow.plans.base import CODES, KNN, codes, query, rounded, table
from cairnflow.plans.lookup_queries import _RANKED, ranked_buckets
from cairnflow.plans.text_queries import _bucket_sql
from cairnflow.plans.vector_queries import _geohash_sql, neighbours

#: Orders made from events: places by user, targets by kind, up to three earlier events as history.
_ORDERS = f"""e AS (SELECT event_id AS sample, user_id::VARCHAR AS "user", ts, CASE WHEN event_id % 41 = 0 THEN ' ' ELSE 'q' || (event_id % 37) END AS query,
CAST(116 AS DOUBLE) + (user_id % 100) / CAST(100 AS DOUBLE) AS lng, CAST(39.5 AS DOUBLE) + (event_id % 50) / CAST(100 AS DOUBLE) AS lat,
event_type || (event_id % 5) AS target FROM events
WHERE user_id IS NOT NULL), h AS (SELECT a.sample, b.query, b.target AS poi, b.lng, b.lat, b.ts, b.sample AS i,
row_number() OVER (PARTITION BY a.sample ORDER BY b.ts DESC, b.sample DESC) AS r FROM e a JOIN e b ON a."user" = b."user" AND b.ts < a.ts),
h3 AS (SELECT *, {_geohash_sql('lng', 'lat')} AS gid FROM h WHERE r <= 3), eg AS (SELECT *, {_geohash_sql('lng', 'lat')} AS gid FROM e),
ids AS (SELECT poi, '<P_' || (row_number() OVER (ORDER BY poi) - 1) || '>' AS content FROM (SELECT DISTINCT target AS poi FROM e WHERE target <> 'view3'))"""
_SPLIT = """CASE WHEN ts::DATE BETWEEN DATE '2024-01-01' AND DATE '2024-01-03' THEN 'train' WHEN ts::DATE = DATE '2024-01-04' THEN 'valid' WHEN ts::DATE = DATE
'2024-01-05' THEN 'test' END"""


def orders(spark, sf):
    k = F.col("event_id")
    e = table(spark, sf, "events").where("user_id is not null").select(
        k.alias("sample"),
        F.col("user_id").cast("string").alias("user"),
        "ts",
        F.when(k % 41 == 0, " ").otherwise(F.concat(F.lit("q"), (k % 37).cast("string"))).alias("query"),
        (116.0 + (F.col("user_id") % 100) / 100.0).alias("lng"),
        (39.5 + (k % 50) / 100.0).alias("lat"),
        F.concat("event_type", (k % 5).cast("string")).alias("target"),
    )
    told = messages.collect_history(e.withColumn("poi", F.col("target")), "user", "ts", "sample", 3, ("query", "poi", "lng", "lat"))
    return told.drop("poi")


def order_ids(spark, sf):
    pois = orders(spark, sf).select(F.col("target").alias("poi")).distinct().where("poi != 'view3'")
    from cairnflow.operators.querystats import dense_ids

    return dense_ids(pois, ["poi"], "i").select("poi", F.concat(F.lit("<P_"), F.col("i").cast("string"), F.lit(">")).alias("content"))


def order_split():
    return messages.time_split(F.to_date("ts"), "2024-01-01", "2024-01-03", "2024-01-04", "2024-01-05")


def _gid(column: str) -> str:
    return f"regexp_replace({column}, '(.)', '<G_\\1>', 'g')"


def _builder_sql(template: str) -> str:
    tag, wrapped, with_user, with_history = bd.TEMPLATES[template]
    nl = "chr(10)"
    current = f"concat_ws({nl}, '<CURRENT>', '<USER_GID>' || {_gid('eg.gid')} || '</USER_GID>', '<QUERY>' || eg.query || '</QUERY>', '</CURRENT>')"
    lines = f"'<USER_GID>' || {_gid('h3.gid')} || '</USER_GID>', '<QUERY>' || h3.query || '</QUERY>', '<{tag}>' || ids.content || '</{tag}>'"
    event = f"concat_ws({nl}, " + (f"'<EVENT>', {lines}, '</EVENT>'" if wrapped else lines) + ")"
    user = f"'<USER_ID><U_' || lpad({_bucket_sql('eg.user', 2000)}::VARCHAR, 4, '0') || '></USER_ID>', " if with_user else ""
    content = f"concat_ws({nl}, {user}'<HISTORY>', ev, '</HISTORY>', {current})" if with_history else current
    return f"""WITH {_ORDERS}, o AS (SELECT h3.sample, count(*) AS n, count(*) FILTER (ids.content IS NULL) AS missing, string_agg({event if with_history else "''"},
{nl} ORDER BY h3.ts, h3.i) AS ev FROM h3 LEFT JOIN ids USING (poi) GROUP BY 1),
b AS (SELECT eg.sample, {_SPLIT} AS split, coalesce(n, 0) AS n, {content} AS asked, ids.content AS answer, coalesce(missing, 0) AS missing FROM eg
LEFT JOIN o ON o.sample = eg.sample LEFT JOIN ids ON ids.poi = eg.target WHERE trim(eg.query) <> ''),
f AS (SELECT *, CASE WHEN split IS NULL THEN 'date_outside_splits' WHEN answer IS NULL THEN 'target_without_identifier' WHEN missing > 0 THEN
'history_without_identifier' END AS fault FROM b)
SELECT sample, split, CASE WHEN fault IS NULL THEN md5(asked) END AS asked, CASE WHEN fault IS NULL THEN answer END AS answer,
CAST(n AS INTEGER) AS history_length, fault FROM f"""


def _built(template: str):
    def build(spark, sf):
        out = bd.training_rows(orders(spark, sf), order_ids(spark, sf), template, order_split())
        said = lambda i: F.get("messages", F.lit(i))["content"]
        return out.select("sample", "split", F.md5(said(0)).alias("asked"), said(1).alias("answer"), "history_length", "fault")

    build.__doc__ = f"Training messages by the {template} template."
    return build


for _t in bd.TEMPLATES:
    query(_builder_sql(_t), f"training_{_t}")(_built(_t))


@query(
    f"""WITH {_ORDERS}, c AS (SELECT poi, row_number() OVER (ORDER BY poi) - 1 AS row_index
FROM ids), o AS (SELECT sample, count(*) AS n, count(row_index) AS k, string_agg(row_index::VARCHAR, ',' ORDER BY ts, i) AS rows FROM h3 LEFT
JOIN c USING (poi) GROUP BY 1)
SELECT e.sample, split, c.row_index AS target_row, coalesce(rows, '') AS history_rows FROM (SELECT *, {_SPLIT} AS split FROM e) e
JOIN c ON c.poi = e.target LEFT JOIN o ON o.sample = e.sample WHERE split IN ('train', 'valid') AND trim(query) <> '' AND coalesce(n = k, true)"""
)
def training_references(spark, sf):
    ids = order_ids(spark, sf).select("poi", F.regexp_extract("content", "([0-9]+)", 1).cast("long").alias("row_index"))
    out = bd.reference_rows(orders(spark, sf), ids, order_split())
    return out.select("sample", "split", "target_row", F.array_join(F.transform("history_rows", lambda r: r.cast("string")), ",").alias("history_rows"))


@query(f"""WITH {_ORDERS} SELECT 'history' AS origin, \"user\", poi, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM (SELECT DISTINCT e.\"user\", h3.poi, h3.ts FROM h3 JOIN e USING (sample)) UNION ALL
SELECT 'target', \"user\", target, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') FROM e WHERE ts::DATE BETWEEN DATE '2024-01-02' AND DATE '2024-01-03'""")
def feature_interactions(spark, sf):
    out = bd.interactions(orders(spark, sf), "2024-01-02", "2024-01-03")
    return out.select("origin", "user", "poi", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@query("""WITH u AS (SELECT (user_id % 50)::VARCHAR AS \"user\", CASE WHEN event_id % 700 = 3 THEN 'b' ELSE 'a' END AS h FROM events WHERE user_id IS NOT NULL)
SELECT \"user\", count(DISTINCT h) AS histories FROM u GROUP BY 1 HAVING count(DISTINCT h) > 1""")
def changing_histories(spark, sf):
    e = table(spark, sf, "events").where("user_id is not null")
    return bd.changing_histories(e.select((F.col("user_id") % 50).cast("string").alias("user"), F.array(F.when(F.col("event_id") % 700 == 3, "b").otherwise("a")).alias("history")))


_BUCKETS = f"""{CODES}, k AS (SELECT vec_id, s1, s2, s3, count(*) OVER w AS n, row_number() OVER (PARTITION BY s1, s2, s3 ORDER BY vec_id::VARCHAR) - 1 AS r
FROM codes WINDOW w AS (PARTITION BY s1, s2, s3))"""


@query(f"""WITH {_BUCKETS} SELECT vec_id, CASE WHEN n > 1 THEN r ELSE 0 END AS c, concat_ws('-', s1, s2, s3, c) AS key,
'<S1_' || s1 || '><S2_' || s2 || '><S3_' || s3 || '><C_' || c || '>' AS content FROM k""")
def collision_identifiers(spark, sf):
    out = bd.identifier_table(codes(spark, sf), "vec_id", ["s1", "s2", "s3"], "collision")
    return out.select("vec_id", F.element_at("codes", -1).cast("long").alias("c"), "key", "content")


@query(f"""WITH {_BUCKETS} SELECT vec_id, CASE WHEN n > 1 THEN 4 ELSE 3 END AS width,
s1 || '-' || s2 || '-' || s3 || CASE WHEN n > 1 THEN '|d' || r ELSE '' END AS key,
'<a_' || s1 || '><b_' || s2 || '><c_' || s3 || '>' || CASE WHEN n > 1 THEN '<d_' || r || '>' ELSE '' END AS content FROM k""")
def optional_identifiers(spark, sf):
    out = bd.identifier_table(codes(spark, sf), "vec_id", ["s1", "s2", "s3"], "optional")
    return out.select("vec_id", F.size("codes").alias("width"), "key", "content")


@query(
    f"""WITH {CODES}, g AS (SELECT *, chr(98 + t3) AS gid FROM codes), k AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY gid, s1, s2, s3
ORDER BY vec_id::VARCHAR) - 1 AS r FROM g WINDOW w AS (PARTITION BY gid, s1, s2, s3))
SELECT vec_id, gid || '|' || s1 || '-' || s2 || '-' || s3 || CASE WHEN n > 1 THEN '|d' || r ELSE '' END AS key,
'<G_' || gid || '><S1_' || s1 || '><S2_' || s2 || '><S3_' || s3 || '>' || CASE WHEN n > 1 THEN '<D_' || r || '>' ELSE '' END AS content FROM k"""
)
def located_identifiers(spark, sf):
    c = codes(spark, sf).withColumn("gid", F.char(98 + F.col("t3")))
    return bd.identifier_table(c, "vec_id", ["s1", "s2", "s3"], "dedup", "gid").select("vec_id", "key", "content")


@query(f"""WITH {_BUCKETS} SELECT vec_id, concat_ws('-', s1, s2, s3, 0, CASE WHEN n > 1 THEN r ELSE 0 END) AS key,
'<S1_' || s1 || '><S2_' || s2 || '><S3_' || s3 || '><R1_0><R2_' || (CASE WHEN n > 1 THEN r ELSE 0 END) || '>' AS content FROM k""")
def paired_identifiers(spark, sf):
    return bd.identifier_table(codes(spark, sf), "vec_id", ["s1", "s2", "s3"], "paired").select("vec_id", "key", "content")


@query(f"WITH {CODES} SELECT s1 || '-' || s2 AS key, count(*) AS n FROM codes GROUP BY 1 HAVING count(*) > 1")
def repeated_identifiers(spark, sf):
    return bd.repeated_identifiers(codes(spark, sf).select(F.concat_ws("-", "s1", "s2").alias("key")))


_TOKENS = " UNION ALL ".join([f"SELECT 'structure' AS kind, '{t}' AS token" for t in bd.STRUCTURE] + [f"SELECT 'geohash', '<G_{c}>'" for c in geo.GEOHASH])


@query(f"""{_TOKENS} UNION ALL SELECT 'user', '<U_' || lpad(range::VARCHAR, 4, '0') || '>' FROM range(2000) UNION ALL SELECT 's1', '<S1_' || range || '>'
FROM range(8) UNION ALL SELECT 'c', '<C_' || range || '>' FROM range(30)""")
def special_tokens(spark, sf):
    return bd.special_tokens(spark, {"S1": 8, "C": 30})


@query(f"""WITH u AS (SELECT event_type, list_sort(list(DISTINCT {_bucket_sql('user_id::VARCHAR', 100)})) AS b FROM events WHERE user_id IS NOT NULL GROUP BY 1)
SELECT event_type, array_to_string(b, ',') AS buckets FROM u""")
def hashed_visitors(spark, sf):
    u = table(spark, sf, "events").where("user_id is not null").groupBy("event_type").agg(F.collect_set("user_id").alias("users"))
    return u.select("event_type", F.array_join(F.transform(bd.hashed_visitors(F.col("users"), 100), lambda x: x.cast("string")), ",").alias("buckets"))


@query("""WITH m AS (SELECT c_custkey, list_sort(list_concat(list_concat([c_nationkey::BIGINT],
CASE WHEN c_custkey % 3 = 0 THEN [25 + c_custkey % 24] ELSE [] END), [49 + c_custkey % 12])) AS f FROM customer)
SELECT c_custkey, array_to_string(f, ',') AS active FROM m""")
def active_features(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    f = bd.active_features([(F.array(F.col("c_nationkey").cast("long")), 25), (F.when(k % 3 == 0, F.array(k % 24)), 24), (F.array(k % 12), 12)])
    return c.select("c_custkey", F.array_join(F.transform(f, lambda x: x.cast("string")), ",").alias("active"))


@query(f"""WITH u AS (SELECT o_custkey AS id, list_sort(list(DISTINCT {_bucket_sql('o_orderkey::VARCHAR', 50)})) AS v, count(*) FILTER (o_orderstatus = 'F') AS f
FROM orders GROUP BY 1) SELECT id, array_to_string(v, ',') AS visitors FROM u""")
def prepared_features(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.collect_set("o_orderkey").alias("v"),
        F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("f"),
    )
    empty = table(spark, sf, "customer").where("c_custkey < 5").select(
        (-F.col("c_custkey") - 1).alias("id"),
        F.array().cast("array<bigint>").alias("v"),
        F.array().cast("array<bigint>").alias("f"),
    )
    out = bd.prepared_features(o.unionByName(empty), "v", ["f"], 50)
    return out.select("id", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("visitors"))


_STAGED = f"""{CODES}, r AS (SELECT vec_id, s1, s2, chr(98 + s3) || chr(98 + t3) || chr((98 + label % 10)::INTEGER) || chr((98 + vec_id % 3)::INTEGER) AS gid,
'p' || (vec_id % 4) AS path FROM codes),
q AS (SELECT *, min(gid) OVER w AS a, max(gid) OVER w AS b, count(*) OVER w AS n0
FROM r WINDOW w AS (PARTITION BY s1, s2)), l AS (SELECT *, len(list_filter(range(1, 5), lambda i: substr(a, 1, i) = substr(b, 1, i))) AS root FROM q),
c AS (SELECT *, substr(gid, 1, greatest(1, root)::BIGINT) AS coarse, substr(gid, 1, 3) AS fine
FROM l), n AS (SELECT *, count(*) OVER (PARTITION BY s1, s2, coarse) AS n1, count(*) OVER (PARTITION BY s1, s2, coarse, path) AS n2,
count(*) OVER (PARTITION BY s1, s2, coarse, path, fine) AS n3 FROM c),
st AS (SELECT *, CASE WHEN n0 = 1 THEN 'base' WHEN n1 = 1 THEN 'coarse_geo' WHEN n2 = 1 THEN 'relation' WHEN n3 = 1 THEN 'fine_geo' ELSE 'unresolved'
END AS stage FROM n)"""


def staged_rows(spark, sf):
    c = codes(spark, sf)
    letter = lambda x: F.char(98 + x)
    gid = F.concat(letter(F.col("s3")), letter(F.col("t3")), letter(F.col("label") % 10), letter(F.col("vec_id") % 3))
    r = c.select("vec_id", "s1", "s2", gid.alias("gid"), F.concat(F.lit("p"), (F.col("vec_id") % 4).cast("string")).alias("path"))
    return rs.staged(r, ["s1", "s2"], "gid", "path", 1, 3)


@query(f"WITH {_STAGED} SELECT vec_id, CAST(root AS INTEGER) AS root, stage FROM st")
def staged_resolution(spark, sf):
    return staged_rows(spark, sf).select("vec_id", "root", "stage")


@query(f"WITH {_STAGED} SELECT vec_id, concat_ws('|', s1, s2, root, coarse, path) AS \"group\" FROM st WHERE stage IN ('unresolved', 'fine_geo')")
def unresolved_groups(spark, sf):
    key = [F.col("s1"), F.col("s2"), F.col("root"), F.substr(F.col("gid"), F.lit(1), F.greatest(F.lit(1), F.col("root"))), F.col("path")]
    return rs.regrouped(staged_rows(spark, sf), ["unresolved", "fine_geo"], key).select("vec_id", "group")


@query(f"""WITH {_STAGED}, g AS (SELECT concat_ws('|', s1, s2, substr(gid, 1, 2)) AS \"group\" FROM st WHERE stage NOT IN ('base', 'coarse_geo'))
SELECT \"group\" FROM g GROUP BY 1 HAVING count(*) = 1""")
def lonely_groups(spark, sf):
    key = [F.col("s1"), F.col("s2"), F.substring("gid", 1, 2)]
    return rs.lonely_groups(rs.regrouped(staged_rows(spark, sf), ["relation", "fine_geo", "unresolved"], key))


_PROXY = f"""{KNN}, p AS (SELECT query_id, id, round(score, 6) AS score, id % 7 - 3 AS net, id % 3 AS plain, id % 5 = 0 AS complete, id % 11 AS orders,
min(CASE WHEN rank = 3 THEN id END) OVER (PARTITION BY query_id) AS target FROM knn WHERE rank <= 12)"""


def proxied(spark, sf):
    n = neighbours(spark, sf, 12)
    goal = n.where("rank = 3").select("query_id", F.col("id").alias("target"))
    i = F.col("id")
    return n.join(goal, "query_id").select(
        "query_id",
        "id",
        F.round("score", 6).alias("score"),
        (i % 7 - 3).alias("net"),
        (i % 3).alias("plain"),
        (i % 5 == 0).alias("complete"),
        (i % 11).alias("orders"),
        "target",
    )


def _proxy_sql(order: str) -> str:
    return f"""WITH {_PROXY}, r AS (SELECT query_id, id, target, row_number() OVER (PARTITION BY query_id
ORDER BY {order}) AS rank, count(*) OVER (PARTITION BY query_id) AS candidates FROM p) SELECT query_id, rank, candidates FROM r WHERE id = target"""


@query(_proxy_sql("score DESC, orders DESC, id::VARCHAR"))
def semantic_proxy_ranks(spark, sf):
    return rs.ranked_in_bucket(proxied(spark, sf), "query_id", [-F.col("score"), -F.col("orders")], "id", "target")


@query(_proxy_sql("net DESC, plain DESC, complete DESC, score DESC, orders DESC, id::VARCHAR"))
def lexical_proxy_ranks(spark, sf):
    first = rs.lexical_order(F.col("net"), F.col("plain"), F.col("complete"))
    return rs.ranked_in_bucket(proxied(spark, sf), "query_id", [*first, -F.col("score"), -F.col("orders")], "id", "target")


@query(f"WITH x AS ({_proxy_sql('net DESC, plain DESC, complete DESC, orders DESC, id::VARCHAR')}) SELECT count(*) AS samples, " + ", ".join(f"round(avg((rank <= {k})::INTEGER), 9) AS hr_at_{k}, round(avg(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1.0) ELSE 0 END), 9) AS ndcg_at_{k}" for k in (1, 5, 10)) + ", round(avg(1.0 / rank), 9) AS mrr FROM x")
def lexical_proxy_report(spark, sf):
    first = rs.lexical_order(F.col("net"), F.col("plain"), F.col("complete"))
    return rounded(rs.rank_report(rs.ranked_in_bucket(proxied(spark, sf), "query_id", [*first, -F.col("orders")], "id", "target")))


_POOL = f"""{_RANKED}, x AS (SELECT sample, bucket_order, vec_id AS id, (vec_id * 13) % 17 AS lexical, (vec_id * 7 + sample) % 29 AS semantic,
(vec_id * 37) % 101 AS popularity, (sample * 3) % 500 AS target, s1 FROM ranked JOIN codes USING (s1, s2, s3)),
y AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY lexical DESC, id) AS rl, row_number() OVER (PARTITION BY sample
ORDER BY semantic DESC, id) AS rm, row_number() OVER (PARTITION BY sample ORDER BY popularity DESC, id) AS rp FROM x),
z AS (SELECT *, round(1.0::DOUBLE / (60 + bucket_order) + 1.0::DOUBLE / (60 + rl) + 1.0::DOUBLE / (60 + rm), 12) AS f3,
round(1.0::DOUBLE / (60 + bucket_order) + 1.0::DOUBLE / (60 + rl) + 1.0::DOUBLE / (60 + rm) + 1.0::DOUBLE / (60 + rp), 12) AS f4 FROM y)"""
_ORDER_OF = {
    "bucket_then_popularity": "bucket_order, popularity DESC",
    "bucket_then_lexical": "bucket_order, lexical DESC, popularity DESC",
    "bucket_then_semantic": "bucket_order, semantic DESC, popularity DESC",
    "global_popularity": "popularity DESC, bucket_order",
    "global_lexical": "lexical DESC, bucket_order, popularity DESC",
    "global_semantic": "semantic DESC, bucket_order, popularity DESC",
    "global_rrf": "f3 DESC, popularity DESC",
    "global_rrf_all": "f4 DESC, popularity DESC",
}
_VARIANTS = f"{_POOL}, v AS (SELECT sample, id, target, s1, bucket_order, " + ", ".join(f"CAST(row_number() OVER (PARTITION BY sample ORDER BY {o}, id) AS INTEGER) AS {n}" for n, o in _ORDER_OF.items()) + " FROM z)"


def reranked(spark, sf):
    from cairnflow.operators.lookups import expand_buckets

    x = expand_buckets(ranked_buckets(spark, sf), codes(spark, sf), ["s1", "s2", "s3"])
    i, s = F.col("vec_id"), F.col("sample")
    x = x.select(
        "sample",
        "bucket_order",
        i.alias("id"),
        ((i * 13) % 17).alias("lexical"),
        ((i * 7 + s) % 29).alias("semantic"),
        ((i * 37) % 101).alias("popularity"),
        ((s * 3) % 500).alias("target"),
        "s1",
    )
    return rs.rank_variants(x, "sample", "id", "bucket_order", "lexical", "semantic", "popularity")


@query(f"WITH {_VARIANTS} SELECT sample, id, {', '.join(rs.VARIANTS)} FROM v")
def rerank_variants(spark, sf):
    return reranked(spark, sf).select("sample", "id", *rs.VARIANTS)


@query(
    f"""WITH {_VARIANTS}, p AS (SELECT sample, max((sample % 2 = 0)::INTEGER) AS even,
{', '.join(f'min({v}) FILTER (id = target) AS {v}' for v in rs.VARIANTS)} FROM v
GROUP BY 1), l AS ({' UNION ALL '.join(f"SELECT sample, even, '{v}' AS variant, {v} AS r FROM p" for v in rs.VARIANTS)}),
s AS (SELECT variant, r, 'all' AS slice FROM l UNION ALL SELECT variant, r, 'even' FROM l WHERE even = 1)
SELECT variant, slice, count(*) AS samples, round(avg((r IS NOT NULL)::INTEGER), 9) AS pool_recall,
{', '.join(f'round(avg(coalesce((r <= {k})::INTEGER, 0)), 9) AS hr_at_{k}' for k in (1, 5, 10))} FROM s GROUP BY ALL"""
)
def rerank_report(spark, sf):
    return rounded(rs.rerank_report(reranked(spark, sf), "sample", "id", "target", {"even": F.col("sample") % 2 == 0}))


@query(f"""WITH {_VARIANTS}, p AS (SELECT sample, coalesce(min(bucket_then_popularity) FILTER (id = target AND bucket_then_popularity <= 10), 11) AS a,
coalesce(min(global_rrf_all) FILTER (id = target AND global_rrf_all <= 10), 11) AS b FROM v GROUP BY 1)
SELECT count(*) FILTER (b < a) AS wins, count(*) FILTER (a = b) AS ties, count(*) FILTER (b > a) AS losses FROM p""")
def rerank_gain(spark, sf):
    return rs.reranking_gain(reranked(spark, sf), "sample", "id", "target", "bucket_then_popularity", "global_rrf_all")


@query(
    f"""WITH {CODES}, k AS (SELECT vec_id, count(*) OVER (PARTITION BY s1, s2, s3) AS n
FROM codes), r AS (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'unit' WHEN 1 THEN 'floor' ELSE 'room' END AS relation, vec_id % 400 AS value,
vec_id % 8 = 0 AS conflict FROM codes)
SELECT k.vec_id, CAST(coalesce(CASE WHEN relation = 'unit' THEN value END, -1) AS BIGINT) AS unit,
CAST(coalesce(CASE WHEN relation = 'floor' THEN value END, -1) AS BIGINT) AS floor FROM k LEFT
JOIN r ON r.vec_id = k.vec_id AND NOT conflict AND value <= 300 WHERE n > 1"""
)
def strict_relation_catalog(spark, sf):
    c, i = codes(spark, sf), F.col("vec_id")
    ids = bd.identifier_table(c, "vec_id", ["s1", "s2", "s3"], "collision")
    r = c.select("vec_id", F.when(i % 3 == 0, "unit").when(i % 3 == 1, "floor").otherwise("room").alias("relation"), (i % 400).alias("value"), (i % 8 == 0).alias("conflict"))
    return rs.strict_catalog(c, ids, r, "vec_id", ["unit", "floor"], 300).select("vec_id", "unit", "floor")
