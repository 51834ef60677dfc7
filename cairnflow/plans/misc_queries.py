"""Traces, tries, encodings, readers and writers, and forms of text and place."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnflow.functions import geo, hashing, text
from cairnflow.operators import assets, lookups, sampling
from cairnflow.operators import resolution as rs
from cairnflow.plans.base import CODES, KNN, POINTS, codes, points, query, rounded, table
from cairnflow.plans.vector_queries import neighbours
from cairnflow.sources import io
from cairnflow.sources.scratch import scratch_folder

_TRACE = f"""{KNN}, c AS (SELECT query_id AS sample, CAST(rank AS INTEGER) AS beam, id, label AS bucket, query_label, id = (query_id * 7) % 500 AS correct,
label = query_label AS hit, label <> 3 AS fine FROM knn WHERE rank <= 8 AND NOT (query_id % 60 = 0 AND rank = 5)),
f AS (SELECT sample, bucket, min(beam) AS first, bool_or(hit) AS hit FROM c WHERE fine GROUP BY ALL), g AS (SELECT sample, min(first) AS goal FROM f
WHERE hit GROUP BY 1), u AS (SELECT sample, min(goal) AS raw, count(*) FILTER (first <= goal) AS uniq FROM f JOIN g USING (sample) GROUP BY 1),
p AS (SELECT sample, count(*) = 8 AND count(DISTINCT beam) = 8 AND min(beam) = 1 AND max(beam) = 8 AS ok, min(beam) FILTER (correct) AS exact FROM c GROUP BY 1),
st AS (SELECT DISTINCT sample, CASE WHEN sample % 100 = 20 THEN 1 END AS exact_rank, CASE WHEN sample % 40 <> 0 THEN 1 ELSE 2 END AS raw_rank,
CAST(1 AS BIGINT) AS unique_rank FROM c)"""


def traced(spark, sf):
    n = neighbours(spark, sf, 8).where(~((F.col("query_id") % 60 == 0) & (F.col("rank") == 5)))
    s = F.col("query_id")
    return n.select(
        s.alias("sample"),
        F.col("rank").alias("beam"),
        "id",
        F.col("label").alias("bucket"),
        (F.col("id") == s * 7 % 500).alias("correct"),
        (F.col("label") == F.col("query_label")).alias("hit"),
        (F.col("label") != 3).alias("fine"),
    )


@query(
    f"""WITH {_TRACE}, j AS (SELECT p.sample, ok, exact, raw, uniq, exact_rank, raw_rank, unique_rank FROM p LEFT JOIN u USING (sample) LEFT
JOIN st USING (sample)) SELECT sample, 'beams' AS fault FROM j WHERE NOT ok UNION ALL SELECT sample, 'exact' FROM j WHERE exact IS DISTINCT
FROM exact_rank
UNION ALL SELECT sample, 'raw' FROM j WHERE raw IS DISTINCT FROM raw_rank UNION ALL SELECT sample, 'unique' FROM j WHERE uniq IS DISTINCT FROM unique_rank"""
)
def trace_faults(spark, sf):
    c = traced(spark, sf)
    s = F.col("sample")
    stored = c.select("sample").distinct().select(
        "sample",
        F.when(s % 100 == 20, 1).alias("exact_rank"),
        F.when(s % 40 != 0, 1).otherwise(2).alias("raw_rank"),
        F.lit(1).cast("long").alias("unique_rank"),
    )
    return rs.trace_faults(c, stored, "sample", "beam", "bucket", F.col("fine"), F.col("correct"), F.col("hit"), 8)


@query(f"""WITH {CODES}, n AS (SELECT s1, s2, sum(1.0 + vec_id % 3)::DOUBLE AS w FROM codes GROUP BY ALL), t AS (SELECT *, sum(w) OVER (PARTITION BY s1) AS t
FROM n) SELECT s1, count(*) AS branches, round(abs(-sum(w / t * log2(w / t))), 8) AS entropy FROM t GROUP BY s1""")
def branch_entropy(spark, sf):
    c = codes(spark, sf).withColumn("w", 1.0 + F.col("vec_id") % 3)
    return rounded(rs.branch_entropy(c, ["s1"], "s2", "w"), 8)


def _encoding(i: int) -> str:
    o = f"o{i}"
    return f"""SELECT b, {-i} AS i, round(e * (m + 20.0 * g) / (s + 20.0), 12) AS score FROM (SELECT b, abs(-sum(w / t * log2(w / t))) AS e
FROM (SELECT *, sum(w) OVER (PARTITION BY b) AS t FROM (SELECT b, {o}, sum(w) AS w FROM r GROUP BY b, {o})) GROUP BY b)
JOIN (SELECT b, sum(n) AS s, sum(m{i}) AS m FROM r WHERE {o} >= 0 GROUP BY b
HAVING count(DISTINCT {o}) > 1) USING (b), (SELECT sum(m{i}) / sum(n) AS g FROM r WHERE {o} >= 0)"""


@query(
    f"""WITH {CODES}, r AS (SELECT vec_id, s1 * 8 + s2 AS b, CASE WHEN vec_id % 4 = 0 THEN -1 ELSE s3 END AS o1, t3 * 3 + label % 3 AS o2, vec_id % 9 AS n,
vec_id % 9 * (vec_id % 2) AS m1, vec_id % 9 * (vec_id % 3 % 2) AS m2, greatest(1.0, sqrt(1.0 + vec_id % 9)) AS w FROM codes),
sc AS ({_encoding(1)} UNION ALL {_encoding(2)}), best AS (SELECT b, -arg_max(i, (score, i)) AS option FROM sc
GROUP BY b), k AS (SELECT vec_id, b, coalesce(option, 0) AS option, CASE option WHEN 1 THEN o1 WHEN 2 THEN o2 ELSE -1 END AS chosen FROM r LEFT
JOIN best USING (b))
SELECT vec_id, CAST(option AS INTEGER) AS option, CAST(chosen AS INTEGER) AS chosen, option > 0 AND count(*) OVER (PARTITION BY b, chosen) = 1 AS resolved FROM k"""
)
def chosen_encoding(spark, sf):
    c, k = codes(spark, sf), F.col("vec_id")
    r = c.select(
        "vec_id",
        (F.col("s1") * 8 + F.col("s2")).alias("b"),
        F.when(k % 4 == 0, -1).otherwise(F.col("s3")).alias("o1"),
        (F.col("t3") * 3 + F.col("label") % 3).alias("o2"),
        (k % 9).alias("n"),
        (k % 9 * (k % 2)).alias("m1"),
        (k % 9 * (k % 3 % 2)).alias("m2"),
    )
    return rs.chosen_encoding(r, ["b"], ["o1", "o2"], "n", ["m1", "m2"]).select("vec_id", "option", "chosen", "resolved")


@query(
    f"""WITH {CODES}, p AS (SELECT DISTINCT [s1, s2, s3] AS p FROM codes), x AS (SELECT d AS depth, list_slice(p, 1, d) AS prefix, bool_or(d = 3) AS terminal
FROM p, range(0, 4) r(d) GROUP BY ALL), n AS (SELECT *, row_number() OVER (ORDER BY depth, prefix) - 1 AS node FROM x)
SELECT n.node, CASE WHEN n.depth > 0 THEN u.node ELSE -1 END AS parent, CASE WHEN n.depth > 0 THEN n.prefix[-1] ELSE -1 END AS token,
CAST(n.depth AS INTEGER) AS depth, n.terminal FROM n LEFT
JOIN n u ON n.depth > 0 AND u.prefix = list_slice(n.prefix, 1, n.depth - 1) AND u.depth = n.depth - 1"""
)
def trie_nodes(spark, sf):
    return rs.trie_nodes(codes(spark, sf).select(F.array("s1", "s2", "s3").alias("p")), "p")


@query(f"WITH {CODES} SELECT s1, s2, array_to_string(list_sort(list(DISTINCT s3)), ',') AS children FROM codes GROUP BY s1, s2")
def parent_children(spark, sf):
    c = codes(spark, sf).groupBy("s1", "s2").agg(F.array_sort(F.collect_set("s3")).alias("c"))
    return c.select("s1", "s2", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("children"))


_SCALES = (1.0, 4.0, 16.0)


@query(f"WITH {POINTS}, k AS (SELECT id, (lng - 116.4) * 85 AS x, (lat - 39.9) * 111 AS y FROM points) SELECT id, " + ", ".join(f"round({f}({v} * {2 * math.pi!r} / {s}) / sqrt(6.0), 8) AS {v}{i}{f}" for i, s in enumerate(_SCALES) for v in "xy" for f in ("sin", "cos")) + " FROM k")
def fourier_places(spark, sf):
    p = points(spark, sf).select("id", ((F.col("lng") - 116.4) * 85).alias("x"), ((F.col("lat") - 39.9) * 111).alias("y"))
    f = p.select("id", geo.fourier_features(F.col("x"), F.col("y"), list(_SCALES)).alias("f"))
    names = [f"{v}{i}{n}" for i in range(3) for v in "xy" for n in ("sin", "cos")]
    return rounded(f.select("id", *[F.element_at("f", i + 1).alias(n) for i, n in enumerate(names)]), 8)


@query(
    """WITH l AS (SELECT l_partkey % 200 AS poi, (l_partkey * 7 + l_linenumber) % 30 AS query FROM lineitem
GROUP BY ALL), v AS (SELECT vec_id, list_slice(embedding::DOUBLE[], 1, 8) AS x FROM embeddings), p AS (SELECT range AS pos FROM range(1, 9)),
s AS (SELECT poi, pos, sum(x[pos]) AS e, count(*) AS queries FROM l JOIN v ON vec_id = query, p
GROUP BY ALL), d AS (SELECT poi, max(queries) AS queries, sum(e * c.x[pos]) / sqrt(sum(e * e)) / sqrt(sum(c.x[pos] * c.x[pos])) AS cosine FROM s
JOIN v c ON c.vec_id = poi GROUP BY poi)
SELECT poi, queries, round(greatest(-1, least(1, cosine)), 7) AS content_query_cosine FROM d"""
)
def query_heterogeneity(spark, sf):
    from cairnflow.operators import vectors

    pairs = table(spark, sf, "lineitem").groupBy(
        (F.col("l_partkey") % 200).alias("poi"),
        ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 30).alias("query"),
    ).agg(F.count(F.lit(1)).alias("n"))
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query"), F.slice(F.col("embedding").cast("array<double>"), 1, 8).alias("x"))
    own = vectors.query_vectors(pairs, v, "poi", "query", "n", "x").join(v.select(F.col("query").alias("poi"), F.col("x").alias("c")), "poi")
    return rounded(assets.heterogeneity(own, "poi", "c"), 7)


_MESSAGES = """m AS (SELECT item_id, 'see <QUERY>' || text || CASE WHEN item_id % 3 = 0 THEN '</QUERY>' || chr(10) || '<USER_GID> ' ELSE '' END || '</QUERY>' ||
chr(10) || '<USER_GID>x</USER_GID>' AS content FROM benchmark)"""


@query(f"WITH {_MESSAGES} SELECT item_id, md5(substr(content, 12, length(content) - 11 - length('</QUERY>' || chr(10) || '<USER_GID>x</USER_GID>'))) AS query FROM m")
def tagged_queries(spark, sf):
    b = table(spark, sf, "benchmark")
    again = F.when(F.col("item_id") % 3 == 0, "</QUERY>\n<USER_GID> ").otherwise("")
    content = F.concat(F.lit("see <QUERY>"), "text", again, F.lit("</QUERY>\n<USER_GID>x</USER_GID>"))
    return b.select("item_id", F.md5(text.tagged(content, "QUERY", "\n<USER_GID>")).alias("query"))


@query()
def lexical_relevance(spark, sf):
    """Relevance of names to the next row's name (block ratios have no SQL form; tests hold them to difflib)."""
    p = table(spark, sf, "part").select(
        "p_partkey",
        text.letters_only(F.col("p_name")).alias("n"),
        text.letters_only(F.col("p_type")).alias("t"),
        text.letters_only(F.col("p_brand")).alias("b"),
    )
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat("n", "t").alias("q"))
    return p.join(q, "p_partkey").select("p_partkey", text.lexical_relevance(F.col("q"), F.col("n"), F.array("t", F.concat("t", "n")), F.col("b"), F.col("t")).alias("relevance"))


@query()
def core_query_sample(spark, sf):
    """The 50 queries of smallest BLAKE2b score among those with a dominant answer (the hash has no SQL form)."""
    from cairnflow.operators import querystats
    from cairnflow.plans.log_queries import pairs_of

    core = querystats.query_profile(pairs_of(spark, sf)).where("is_high_confidence").select("query")
    return sampling.smallest(core, hashing.blake_score(42)("query"), "query", 50)


_LINES = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()), T.StructField("o_orderstatus", T.StringType())])


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def jsonl_round_trip(spark, sf):
    """Orders written as JSON lines and read again by a declared schema."""
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    io.write_jsonl(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), path)
    return io.read_json(spark, path, _LINES)


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index, o_orderkey FROM orders")
def sharded_row_index(spark, sf):
    """Orders written as sorted shards, listed again as lines with their place over all files."""
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    table(spark, sf, "orders").select("o_orderkey").repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey").write.json(path)
    lines = io.with_row_index(io.read_lines(spark, path))
    return lines.select("row_index", F.get_json_object("value", "$.o_orderkey").cast("long").alias("o_orderkey"))


@query("SELECT l_partkey, count(*) AS rows, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY l_partkey")
def hashed_shards(spark, sf):
    """Lines written by hash of their part into shards and summed shard by shard, without another shuffle of a part."""
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    io.write_parquet(table(spark, sf, "lineitem").select("l_partkey", "l_quantity"), path, "l_partkey", 8)
    back = spark.read.parquet(path)
    return back.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").cast("long").alias("quantity"))


@query(f"""WITH {CODES}, k AS (SELECT vec_id, s1, s2, s3, count(*) OVER w AS n, row_number() OVER (PARTITION BY s1, s2, s3 ORDER BY vec_id::VARCHAR) - 1 AS r
FROM codes WINDOW w AS (PARTITION BY s1, s2, s3))
SELECT vec_id, s1 || '-' || s2 || '-' || s3 || CASE WHEN n > 1 THEN '|d' || r ELSE '' END AS key, n AS bucket_size, n > 1 AS has_dedup,
CASE WHEN n > 1 THEN r END AS dedup FROM k""")
def identifier_mapping(spark, sf):
    """Identifiers written sorted, with a null for no dedup code, and read again."""
    from cairnflow.operators import builders

    ids = builders.identifier_table(codes(spark, sf), "vec_id", ["s1", "s2", "s3"], "dedup")
    code = F.element_at("codes", -1).cast("long")
    out = ids.select("vec_id", "key", "bucket_size", (F.col("bucket_size") > 1).alias("has_dedup"), F.nullif(code, F.lit(-1).cast("long")).alias("dedup"))
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    io.write_sorted(out, path, ["vec_id"], 4)
    return spark.read.parquet(path)


@query("SELECT count(*) AS rows, count(DISTINCT o_custkey) AS customers FROM orders WHERE o_custkey IS NOT NULL")
def quarantined_rows(spark, sf):
    good, bad = io.quarantine(table(spark, sf, "orders"), F.filter(F.array(F.when(F.col("o_custkey").isNull(), "customer")), lambda x: x.isNotNull()))
    return good.agg((F.count(F.lit(1)) + 0 * bad.count()).alias("rows"), F.count_distinct("o_custkey").alias("customers"))


@query("""WITH x AS (SELECT l_orderkey AS s, l_linenumber AS p, l_partkey AS t, round(l_discount, 2) AS z
FROM lineitem), g AS (SELECT s, p, t, z, row_number() OVER (PARTITION BY s, p
ORDER BY z DESC, t) AS r, ln(sum(exp(z)) OVER (PARTITION BY s, p)) - z AS nll, count(*) OVER (PARTITION BY s, p) AS n FROM x)
SELECT p AS position, count(*) AS tokens, round(avg((r = 1)::INTEGER), 9) AS top1, round(avg((r <= 10)::INTEGER), 9) AS top10, round(avg(nll),
9) AS nll FROM g GROUP BY p""")
def position_scores(spark, sf):
    """Rank and likelihood of tokens by position, from logits as rows."""
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("s"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("t"), F.round("l_discount", 2).alias("z"))
    w = Window.partitionBy("s", "position")
    g = x.withColumn("r", F.row_number().over(w.orderBy(F.desc("z"), "t"))).withColumn("nll", F.log(F.sum(F.exp("z")).over(w)) - F.col("z"))
    return rounded(g.groupBy("position").agg(
        F.count(F.lit(1)).alias("tokens"),
        F.avg((F.col("r") == 1).cast("double")).alias("top1"),
        F.avg((F.col("r") <= 10).cast("double")).alias("top10"),
        F.avg("nll").alias("nll"),
    ))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 700")
def bounded_prefix(spark, sf):
    return lookups.ordered_slice(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 0, 700)
