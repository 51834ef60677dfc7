"""Subsets for evaluation and inspection."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnflow.operators import identifiers as ids
from cairnflow.operators import subsets
from cairnflow.plans.base import CODES, POINTS, codes, points, query, rounded, table

S = ["s1", "s2", "s3"]

#: Queries in Chinese made from order rows; SQL sees the same texts.
_ASKED = """a AS (SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN '附近的加油站' WHEN 1 THEN '3公里内 停车场' WHEN 2 THEN '地铁东门口' WHEN 3 THEN '医院对面' WHEN 4 THEN '商场里面的餐厅 B口' WHEN 5 THEN '往北走两千米' WHEN 6 THEN '银行' WHEN 7 THEN '机场T3航站楼' ELSE NULL END AS q FROM orders)"""
_KINDS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(regexp_replace(lower(q), '\\s', '', 'g'), '{p}') THEN '{n}' END" for n, p in subsets.GEOGRAPHIC) + "], lambda x: x IS NOT NULL)"
TEXTS = ("附近的加油站", "3公里内 停车场", "地铁东门口", "医院对面", "商场里面的餐厅 B口", "往北走两千米", "银行", "机场T3航站楼")


def asked(spark, sf):
    k = F.col("o_orderkey")
    q = F.lit(None).cast("string")
    for i, t in enumerate(TEXTS):
        q = F.when(k % 9 == i, t).otherwise(q)
    return table(spark, sf, "orders").select(k.alias("id"), q.alias("q"))


@query(f"WITH {_ASKED} SELECT id, array_to_string({_KINDS}, ',') AS kinds FROM a WHERE q IS NOT NULL")
def geographic_relations(spark, sf):
    return asked(spark, sf).where("q is not null").select("id", F.array_join(subsets.geographic_types(F.col("q")), ",").alias("kinds"))


@query(f"WITH {_ASKED} SELECT id, q FROM a WHERE length(regexp_replace(q, '\\s', '', 'g')) >= 6 AND len({_KINDS}) > 0 ORDER BY sha256('0:' || id), id LIMIT 40")
def geographic_sample(spark, sf):
    return subsets.geographic_sample(asked(spark, sf), "q", "id", 40).select("id", "q")


@query(
    """WITH d AS (SELECT o_orderkey AS id, o_orderdate::DATE AS day
FROM orders), s AS (SELECT day, row_number() OVER (ORDER BY sha256('5:' || day), day) AS p, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM d)),
r AS (SELECT id, day, row_number() OVER (PARTITION BY day ORDER BY sha256('5:' || id), id) AS r FROM d) SELECT id, day FROM r JOIN s USING (day)
WHERE r <= 5000 // n + (p <= 5000 % n)::INTEGER"""
)
def quota_sample(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"))
    return subsets.quota_sample(d, "day", "id", 5000, 5)


@query("""SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY sha256('2:' || doc_id), doc_id) AS INTEGER) AS position FROM documents
WHERE lang IN ('en', 'fr') QUALIFY position <= 12""")
def balanced_sample(spark, sf):
    return subsets.balanced_sample(table(spark, sf, "documents").select("doc_id", "lang"), "lang", ["en", "fr"], "doc_id", 12, 2)


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('3:' || doc_id), doc_id) AS r FROM documents)
SELECT doc_id, r <= 40 AS small, r <= 200 AS large FROM r""")
def nested_samples(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return d.select("doc_id", subsets.hash_rank_below(d, "doc_id", 40, 3).alias("small"), subsets.hash_rank_below(d, "doc_id", 200, 3).alias("large"))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('4:' || doc_id), doc_id) AS r FROM labels)
SELECT doc_id, CASE WHEN r <= 5 THEN 'gate' WHEN r <= 12 THEN 'holdout' ELSE 'train' END AS part FROM r""")
def holdout_after_gate(spark, sf):
    return subsets.holdout_after_gate(table(spark, sf, "labels").select("doc_id"), "doc_id", 5, 7, 4)


@query()
def split_roles(spark, sf):
    """Validation, train and k-means rows by hash (the hash has no SQL form; a test holds shares and sizes)."""
    return subsets.split_roles(table(spark, sf, "embeddings").select("vec_id"), "vec_id", 0.1, 30, 9)


@query(
    f"""WITH {CODES}, n AS (SELECT *, count(*) OVER (PARTITION BY s1, s2) AS a, count(*) OVER (PARTITION BY s1, t3) AS b
FROM codes), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('1:' || vec_id), vec_id) AS r FROM n
WHERE a BETWEEN 2 AND 9 AND b BETWEEN 2 AND 9)
SELECT vec_id, label, a AS size_0, b AS size_1 FROM r WHERE r = 1"""
)
def collision_anchors(spark, sf):
    c = codes(spark, sf).select("vec_id", "label", *S, "t3")
    return subsets.collision_anchors(c, [["s1", "s2"], ["s1", "t3"]], "label", "vec_id", 2, 9, 1).select("vec_id", "label", "size_0", "size_1")


@query(
    f"""WITH {CODES}, m AS (SELECT *, count(*) OVER (PARTITION BY s1, s2) AS b, count(*) OVER (PARTITION BY s1, t3) AS a, count(*) OVER (PARTITION BY s1, s2,
t3) AS c, count(*) OVER (PARTITION BY s1, s2, label) AS sb, count(*) OVER (PARTITION BY s1, t3, label) AS sa FROM codes),
o AS (SELECT vec_id, CAST(CASE WHEN a = 1 OR b = 1 THEN -2 ELSE sign((sa - 1) * (b - 1) - (sb - 1) * (a - 1)) END AS INTEGER) AS outcome FROM m
WHERE t3 <> s2 AND (b <> c OR a <> c) AND a <= 20 AND b <= 20)
SELECT outcome, vec_id FROM o WHERE outcome >= -1 QUALIFY row_number() OVER (PARTITION BY outcome ORDER BY sha256('6:' || vec_id), vec_id) = 1"""
)
def migration_anchors(spark, sf):
    c = codes(spark, sf)
    moves = ids.peer_labels(ids.migration(c, ["s1", "s2"], ["s1", "t3"]), ["s1", "s2"], ["s1", "t3"], "label")
    return subsets.migration_anchors(moves, "vec_id", F.col("t3") != F.col("s2"), 20, 6).select("outcome", "vec_id")


@query(
    f"""WITH {CODES}, n AS (SELECT s1, s2, count(*) AS bucket_size FROM codes GROUP BY ALL HAVING count(*) > 1 ORDER BY bucket_size DESC, s1, s2 LIMIT 6)
SELECT s1, s2, vec_id, bucket_size, CAST(row_number() OVER (PARTITION BY s1, s2 ORDER BY vec_id) AS INTEGER) AS position, bucket_size > 4 AS truncated
FROM codes JOIN n USING (s1, s2) QUALIFY position <= 4"""
)
def bucket_cases(spark, sf):
    return subsets.bucket_cases(codes(spark, sf).select("vec_id", "s1", "s2"), ["s1", "s2"], "vec_id", 6, 4)


_SPAN = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(hy - ly) / 2), 2) + cos(radians(ly)) * cos(radians(hy)) * pow(sin(radians(hx - lx) / 2), 2))))"


@query(
    f"""WITH {POINTS}, g AS (SELECT nation, count(*) AS bucket_size, count(DISTINCT id % 2) AS names, count(DISTINCT id % 5) AS categories,
count(DISTINCT (lng, lat)) AS places, min(lng) AS lx, max(lng) AS hx, min(lat) AS ly, max(lat) AS hy FROM points GROUP BY nation HAVING count(*) > 1
ORDER BY bucket_size DESC, nation LIMIT 7)
SELECT nation, bucket_size, names, categories, places, round({_SPAN}, 3) AS span,
CASE WHEN names = 1 AND places = 1 THEN 'same_name_and_place' WHEN places = 1 THEN 'same_place' WHEN names = 1 THEN 'same_name' ELSE 'distinct' END AS
reason FROM g"""
)
def residual_cases(spark, sf):
    p = points(spark, sf).withColumn("name", F.col("id") % 2).withColumn("category", F.col("id") % 5)
    return rounded(subsets.residual_cases(p, ["nation"], "name", "category", "lng", "lat", 7), 3)


@query()
def prefix_pairs(spark, sf):
    """Pairs of rows that share exactly one code, spread by pairs (a test holds every draw to its rule)."""
    return subsets.prefix_pairs(codes(spark, sf), S, 1, "vec_id", 200, 3)


def _members(d: int) -> str:
    key = ", ".join(S[:d])
    counted = f"(SELECT {key}, label, count(*) AS n FROM codes GROUP BY ALL)"
    ranked = f"(SELECT *, CAST(sum(n) OVER (PARTITION BY {key}) AS BIGINT) AS rows, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, label) AS r FROM {counted})"
    return f"""SELECT a.vec_id AS anchor, {d} AS depth, rows, label, n FROM (SELECT vec_id, {key} FROM codes WHERE vec_id % 100 = 7) a JOIN {ranked} l USING ({key})
WHERE r <= 2"""


@query(f"WITH {CODES} " + " UNION ALL ".join(_members(d) for d in (1, 2, 3)))
def prefix_members(spark, sf):
    c = codes(spark, sf)
    return subsets.prefix_members(c, c.where("vec_id % 100 = 7"), S, "vec_id", "label", 2)


_ELIGIBLE = "l AS (SELECT l_orderkey AS g, l_linestatus AS before, l_partkey AS after FROM lineitem)"


@query(
    f"""WITH {_ELIGIBLE}, b AS (SELECT g, sum(k) AS n, sum(k * (k - 1) // 2) AS p FROM (SELECT g, before, count(*) AS k FROM l GROUP BY ALL)
GROUP BY g), a AS (SELECT g, sum(k * (k - 1) // 2) AS p FROM (SELECT g, after, count(*) AS k FROM l GROUP BY ALL) GROUP BY g)
SELECT g, CAST(n AS BIGINT) AS rows, CAST(b.p AS BIGINT) AS before_pairs FROM b JOIN a USING (g) WHERE n BETWEEN 5 AND 8 AND b.p >= 6 AND a.p = 0"""
)
def eligible_groups(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linestatus").alias("before"), F.col("l_partkey").alias("after"))
    return subsets.eligible_groups(li, "g", "before", "after", 5, 8, 6)


@query(
    f"""WITH {CODES}, p AS (SELECT s1, s2, sum(c) AS rows, sum(c * (c - 1) // 2) AS collisions FROM (SELECT s1, s2, s3, count(*) AS c FROM codes GROUP BY ALL)
GROUP BY ALL), e AS (SELECT s1, s2, count(*) FILTER (t3 = s3) AS edges FROM codes GROUP BY ALL)
SELECT s1, s2, CAST(rows AS BIGINT) AS rows, CAST(collisions AS BIGINT) AS collisions, edges FROM p JOIN e USING (s1, s2)
WHERE rows BETWEEN 4 AND 12 AND collisions > 0 AND edges > 0 ORDER BY sha256('42:' || s1 || '-' || s2), s1, s2 LIMIT 5"""
)
def colliding_parents(spark, sf):
    c = codes(spark, sf)
    e = c.groupBy("s1", "s2").agg(F.count_if(F.col("t3") == F.col("s3")).alias("edges"))
    return subsets.colliding_parents(c, ["s1", "s2"], "s3", e, 4, 12, 5, 42)


@query("""SELECT o_orderkey, o_custkey, o_orderkey // 7 AS position FROM orders WHERE o_orderkey % 7 = 2 AND o_custkey NOT IN (SELECT c_custkey FROM customer
WHERE c_nationkey < 5)""")
def frozen_evaluation_set(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    reference = o.where("o_orderkey % 7 = 2").select("o_custkey", "o_orderkey", F.expr("o_orderkey div 7").alias("position"))
    train = table(spark, sf, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    rows = o.withColumnRenamed("o_orderkey", "k")
    named = subsets.frozen_set(reference.select("o_custkey", "position"), rows, train, ["o_custkey"])
    return named.where("k % 7 = 2 and k div 7 = position").select(F.col("k").alias("o_orderkey"), "o_custkey", "position")


_MINED = """m AS (SELECT event_id AS sample, user_id % 20 AS target, event_id % 23 AS negative FROM events
WHERE user_id IS NOT NULL), eq AS (SELECT CAST(range AS BIGINT) AS id, CAST(range % 7 AS BIGINT) AS representative FROM range(21))"""


@query(f"""WITH {_MINED} SELECT sample, target, negative FROM m LEFT JOIN eq a ON a.id = negative LEFT JOIN eq b ON b.id = target
WHERE NOT coalesce(negative = target OR a.representative = b.representative, false) ORDER BY sha256('8:' || sample), sample LIMIT 300""")
def mined_union(spark, sf):
    m = table(spark, sf, "events").where("user_id is not null").select(
        F.col("event_id").alias("sample"),
        (F.col("user_id") % 20).alias("target"),
        (F.col("event_id") % 23).alias("negative"),
    )
    eq = spark.range(21).select("id", (F.col("id") % 7).alias("representative"))
    return subsets.mined_union([m.where("sample % 2 = 0"), m.where("sample % 2 = 1")], "sample", "negative", "target", eq, 300, 8).select("sample", "target", "negative")


@query("SELECT user_id AS sample, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_samples(spark, sf):
    e = table(spark, sf, "events").where("user_id is not null").select(F.col("user_id").alias("sample"), "event_id")
    return subsets.duplicate_samples([e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")], "sample")


@query("SELECT doc_id, row_number() OVER (ORDER BY sha256('11:' || doc_id), doc_id) - 1 AS place FROM documents")
def shuffled_order(spark, sf):
    from cairnflow.operators.querystats import dense_ids

    d = table(spark, sf, "documents").select("doc_id")
    h = d.withColumn("h", subsets.order_hash(F.col("doc_id"), 11))
    return subsets.shuffled(h.join(dense_ids(h, ["h", "doc_id"], "place"), ["h", "doc_id"]), "doc_id", 11).select("doc_id", "place")
