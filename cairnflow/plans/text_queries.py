"""Text, hashing, sampling, messages, relations and diagnostics."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from cairnflow.functions import hashing, text, tokens
from cairnflow.operators import messages, metrics, relations, sampling
from cairnflow.plans.base import POINTS, points, query, rounded, table


def _bucket_sql(expr: str, buckets: int) -> str:
    """The digest folded eight hex digits at a time, as in hashing.sha_bucket."""
    step, out = pow(16, 8, buckets), "0"
    for i in range(8):
        out = f"(({out}) * {step} + CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) % {buckets}"
    return f"(SELECT {out} FROM (SELECT sha256({expr}) AS h))"


@query(f"""WITH u AS (SELECT DISTINCT user_id FROM events) SELECT user_id, b AS bucket, '<U_' || lpad(b::VARCHAR, 4, '0') || '>' AS token
FROM (SELECT user_id, {_bucket_sql('user_id::VARCHAR', 2000)} AS b FROM u)""")
def user_bucket_sha256(spark, sf):
    u = table(spark, sf, "events").select("user_id").distinct()
    return u.select("user_id", hashing.sha_bucket(F.col("user_id"), 2000).alias("bucket"), hashing.user_token(F.col("user_id")).alias("token"))


@query()
def blake_buckets(spark, sf):
    """BLAKE2b buckets, big- and little-endian (no SQL form; tests hold them to hashlib)."""
    u = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("u")).distinct()
    return u.select("u", hashing.blake_bucket(256, b"query")("u").alias("shard"), hashing.blake_bucket(2000, order="little")("u").alias("bucket"))


@query("SELECT doc_id, sha256('part-0:' || doc_id) AS sample_id, sha256('suite' || chr(0) || doc_id || chr(0) || source) AS selection FROM documents")
def stable_ids(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id",
        hashing.sample_id(F.lit("part-0"), F.col("doc_id")).alias("sample_id"),
        hashing.selection_hash(F.lit("suite"), F.col("doc_id").cast("string"), F.col("source")).alias("selection"),
    )


@query("SELECT doc_id, row_number() OVER (ORDER BY sha256(doc_id::VARCHAR), doc_id)::INTEGER AS position FROM documents QUALIFY position <= 50")
def minhash_sample(spark, sf):
    return sampling.smallest(table(spark, sf, "documents").select("doc_id"), F.sha2(F.col("doc_id").cast("string"), 256), "doc_id", 50)


@query("""WITH d AS (SELECT doc_id, source FROM documents WHERE source IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents
ORDER BY sha256(doc_id::VARCHAR), doc_id LIMIT 50)) SELECT doc_id, source, row_number() OVER (PARTITION BY source
ORDER BY sha256('s' || doc_id), doc_id)::INTEGER AS position FROM d QUALIFY position <= 5""")
def stratified_minhash(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    reserved = sampling.smallest(d, F.sha2(F.col("doc_id").cast("string"), 256), "doc_id", 50)
    return sampling.per_stratum(d, "source", F.sha2(F.concat(F.lit("s"), F.col("doc_id").cast("string")), 256), "doc_id", 5, reserved)


@query("""WITH n AS (SELECT count(*) AS n FROM labels), r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('7:' || doc_id), doc_id) AS r FROM labels)
SELECT doc_id, CASE WHEN r <= greatest(1, least(n - 1, round_even(n * 0.1, 0))) THEN 'dev' ELSE 'train' END AS split FROM r, n""")
def train_dev_split(spark, sf):
    l_ = table(spark, sf, "labels").select("doc_id")
    return sampling.train_dev(l_, F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256), "doc_id", 0.1)


@query("""WITH n AS (SELECT count(*) AS n FROM orders), r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i
FROM orders), b AS (SELECT range AS part, n * range // 7 AS low, n * (range + 1) // 7 AS high FROM range(7), n)
SELECT o_orderkey, part::INTEGER AS part FROM r JOIN b ON i >= low AND i < high""")
def contiguous_split(spark, sf):
    from cairnflow.operators.querystats import dense_ids

    o = table(spark, sf, "orders").select("o_orderkey")
    return dense_ids(o, ["o_orderkey"], "i").select("o_orderkey", sampling.contiguous(F.col("i"), o.count(), 7).alias("part"))


@query("""SELECT item_id, nullif(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '') AS conservative, regexp_replace(lower(text), '\\s', '',
'g') AS compact, lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS letters, regexp_replace(replace(replace(upper(text), 'ß', 'SS'), 'ẞ',
'SS'), '\\s', '', 'g') AS relation FROM benchmark""")
def normalizers(spark, sf):
    b = table(spark, sf, "benchmark")
    t = F.col("text")
    return b.select(
        "item_id",
        text.conservative(t).alias("conservative"),
        text.compact(t).alias("compact"),
        text.letters_only(t).alias("letters"),
        text.relation_text(t).alias("relation"),
    )


@query("""SELECT CASE WHEN length(trim(p_name)) <= 2 THEN '1-2' WHEN length(trim(p_name)) <= 5 THEN '3-5' WHEN length(trim(p_name)) <= 10 THEN '6-10' ELSE '>10'
END AS bucket, count(*) AS parts FROM part GROUP BY 1""")
def length_buckets(spark, sf):
    return table(spark, sf, "part").groupBy(text.length_bucket(F.col("p_name")).alias("bucket")).agg(F.count(F.lit(1)).alias("parts"))


@query("""SELECT item_id, quantile_cont(length(w), 0.5) AS median_length, quantile_cont(length(w), 0.9) AS p90_length
FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w FROM benchmark) GROUP BY item_id""")
def word_length_percentiles(spark, sf):
    w = table(spark, sf, "benchmark").select("item_id", F.explode(F.split("text", " ")).alias("w")).withColumn("n", F.length("w"))
    return w.groupBy("item_id").agg(F.percentile("n", F.lit(0.5)).alias("median_length"), F.percentile("n", F.lit(0.9)).alias("p90_length"))


@query("""WITH r AS (SELECT vec_id, vec_id * 1000003 % 2000000 AS v FROM embeddings)
SELECT vec_id, 2 + (v >= 1024)::INTEGER + (v >= 1048576)::INTEGER AS cost,
CASE WHEN v >= 1048576 THEN (v // 1048576) || ',' ELSE '' END || CASE WHEN v >= 1024 THEN (v // 1024 % 1024) || ',' ELSE '' END || (v % 1024) AS
digits FROM r""")
def base1024(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") * 1000003 % 2000000).alias("v"))
    return v.select("vec_id", tokens.token_cost(F.col("v")).alias("cost"), F.array_join(F.transform(tokens.digits1024(F.col("v")), lambda x: x.cast("string")), ",").alias("digits"))


_EVENTS = "e AS (SELECT event_id, user_id, ts, 'q' || (event_id % 37) AS query, event_type || (event_id % 5) AS poi FROM events WHERE user_id IS NOT NULL)"
_HISTORY = _EVENTS + """, h AS (SELECT a.event_id, b.ts AS t, b.query, b.poi, b.event_id AS i, row_number() OVER (PARTITION BY a.event_id
ORDER BY b.ts DESC, b.event_id DESC) AS r FROM e a JOIN e b ON a.user_id = b.user_id AND b.ts < a.ts)"""


def with_history(spark, sf, most=5):
    e = table(spark, sf, "events").where("user_id is not null").select(
        "event_id",
        "user_id",
        "ts",
        F.concat(F.lit("q"), (F.col("event_id") % 37).cast("string")).alias("query"),
        F.concat("event_type", (F.col("event_id") % 5).cast("string")).alias("poi"),
    )
    return messages.collect_history(e, "user_id", "ts", "event_id", most)


@query(f"""WITH {_HISTORY}, j AS (SELECT event_id, string_agg('<EVENT><QUERY>' || query || '</QUERY><POI>' || poi || '</POI></EVENT>', chr(10)
ORDER BY t, i) AS ev FROM h WHERE r <= 5 GROUP BY 1)
SELECT event_id, coalesce('<HISTORY>' || chr(10) || ev || chr(10) || '</HISTORY>' || chr(10),
'') || '<CURRENT>' || chr(10) || '<USER_GID>wx4g0</USER_GID>' || chr(10) || '<QUERY>' || query || '</QUERY>' || chr(10) || '</CURRENT>' AS prompt
FROM e LEFT JOIN j USING (event_id)""")
def prompt_text(spark, sf):
    return with_history(spark, sf).select("event_id", messages.prompt(F.col("query"), F.lit("wx4g0"), F.col("history")).alias("prompt"))


@query(f"""WITH {_HISTORY}, l AS (SELECT event_id, i, t, length(query) + length(poi) AS n FROM h
WHERE r <= 5), c AS (SELECT *, sum(n) OVER (PARTITION BY event_id ORDER BY t DESC, i DESC) AS run FROM l)
SELECT event_id, count(*) AS kept, CAST(sum(n) AS BIGINT) AS length FROM c WHERE run <= 24 GROUP BY 1""")
def history_truncate(spark, sf):
    e = with_history(spark, sf).select("event_id", F.posexplode("history").alias("pos", "h")).withColumn("n", F.length("h.query") + F.length("h.poi"))
    kept = messages.fit_history(e, "event_id", "pos", "n", F.lit(24))
    return kept.groupBy("event_id").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("length"))


@query(f"""WITH {_HISTORY} SELECT e.event_id, query, 'wx4g0' AS gid, NOT EXISTS (SELECT 1 FROM (SELECT 1)
WHERE contains('<USER_GID>wx4g0</USER_GID><QUERY>' || e.query || '</QUERY>', e.poi)) AS confined FROM e""")
def prompt_fields(spark, sf):
    h = with_history(spark, sf)
    p = messages.prompt(F.col("query"), F.lit("wx4g0"), F.col("history"))
    q, g = messages.current_fields(p)
    return h.select("event_id", q.alias("query"), g.alias("gid"), messages.confined(p, F.col("poi")).alias("confined"))


@query(f"""WITH {_HISTORY}, s AS (SELECT event_id, count(*) FILTER (r <= 5) AS n, min(t) FILTER (r <= 5) AS low FROM h
GROUP BY 1), f AS (SELECT unnest([CASE WHEN event_id % 11 = 0 THEN 'length' END, CASE WHEN coalesce(n, 0) > 3 THEN 'too_long' END,
CASE WHEN low::DATE < DATE '2024-01-03' THEN 'outside_window' END]) AS fault FROM e LEFT JOIN s USING (event_id)) SELECT fault, count(*) AS rows
FROM f WHERE fault IS NOT NULL GROUP BY 1""")
def history_faults(spark, sf):
    h = with_history(spark, sf)
    declared = F.size("history") + F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)
    faults = messages.history_faults(F.col("history"), declared, F.col("ts"), F.lit("2024-01-03").cast("date"), F.lit("2030-01-01").cast("date"), 3)
    return h.select(F.explode(faults).alias("fault")).groupBy("fault").agg(F.count(F.lit(1)).alias("rows"))


@query("""WITH m AS (SELECT p_partkey AS old, 'n' || (p_partkey * 7 % 1000) AS new FROM part
WHERE p_partkey % 4 <> 0), o AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey
ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) SELECT l_orderkey, string_agg(coalesce(new, '?'), ',' ORDER BY r) AS ids FROM o LEFT
JOIN m ON old = l_partkey GROUP BY 1""")
def id_remap(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))),
        lambda s: s["l_partkey"],
    ).alias("ids"))
    mapping = table(spark, sf, "part").where("p_partkey % 4 != 0").select(
        F.col("p_partkey").alias("old"),
        F.concat(F.lit("n"), (F.col("p_partkey") * 7 % 1000).cast("string")).alias("new"),
    )
    out = messages.remap(rows, "l_orderkey", "ids", mapping)
    return out.select("l_orderkey", F.array_join("ids", ",", "?").alias("ids"))


@query("""SELECT coalesce(CASE WHEN o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1999-12-31' THEN 'train' WHEN o_orderdate::DATE = DATE '2000-01-03'
THEN 'valid' WHEN o_orderdate::DATE = DATE '2000-01-04' THEN 'test' END, 'none') AS split, count(*) AS orders FROM orders GROUP BY 1""")
def time_split(spark, sf):
    s = messages.time_split(F.to_date("o_orderdate"), "1995-01-01", "1999-12-31", "2000-01-03", "2000-01-04")
    return table(spark, sf, "orders").groupBy(F.coalesce(s, F.lit("none")).alias("split")).agg(F.count(F.lit(1)).alias("orders"))


@query("""WITH t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id
ORDER BY turn)) SELECT conv_id, turn, md5(text) AS prompt_md5, md5(reply) AS reply_md5 FROM t WHERE role = 'user' AND nr = 'assistant'""")
def turn_pairs(spark, sf):
    return messages.turn_pairs(table(spark, sf, "conversations")).select("conv_id", "turn", F.md5("prompt").alias("prompt_md5"), F.md5("reply").alias("reply_md5"))


_SCORES = """s AS (SELECT vec_id, CAST(vec_id % 7 AS INTEGER) AS level, [round(0.5 + 0.5 * sin(vec_id * 1.1 + 0), 6), round(0.5 + 0.5 * sin(vec_id * 1.1 + 1), 6),
round(0.5 + 0.5 * sin(vec_id * 1.1 + 2), 6), round(0.5 + 0.5 * sin(vec_id * 1.1 + 3), 6)] AS p FROM embeddings)"""


def probabilities(spark, sf):
    v = F.col("vec_id")
    p = F.array(*[F.round(0.5 + 0.5 * F.sin(v * 1.1 + i), 6) for i in range(4)])
    return table(spark, sf, "embeddings").select("vec_id", (v % 7).cast("int").alias("level"), p.alias("p"))


_SELECTED = _SCORES + """, d AS (SELECT *, CASE WHEN NOT p[1] > 0.3 THEN 0 WHEN NOT p[2] > 0.3 THEN 3 WHEN NOT p[3] > 0.3 THEN 4 WHEN NOT p[4] > 0.3 THEN 5 ELSE 6 END AS
selected FROM s)"""


@query(f"""WITH {_SELECTED} SELECT vec_id, CAST(selected AS INTEGER) AS selected,
(level >= 3)::INTEGER || ',' || (level >= 4)::INTEGER || ',' || (level >= 5)::INTEGER || ',' || (level >= 6)::INTEGER AS targets FROM d""")
def safe_prefix_selected(spark, sf):
    p = probabilities(spark, sf)
    s = tokens.safe_prefix_depth([(d, F.get("p", F.lit(i)), 0.3) for i, d in enumerate((3, 4, 5, 6))])
    return p.select("vec_id", s.alias("selected"), F.array_join(F.transform(tokens.ordinal_targets(F.col("level")), lambda x: x.cast("string")), ",").alias("targets"))


@query(f"""WITH {_SELECTED} SELECT count(*) AS samples, round(avg((selected > 0)::INTEGER), 9) AS retention,
round(avg((selected > 0 AND level < selected)::INTEGER), 9) AS unsafe, round(avg((selected >= 3 AND level >= selected)::INTEGER), 9) AS useful,
round(avg((selected >= 4 AND level >= selected)::INTEGER), 9) AS strong, round(avg(selected), 9) AS mean_depth FROM d""")
def safe_prefix_summary(spark, sf):
    s = tokens.safe_prefix_depth([(d, F.get("p", F.lit(i)), 0.3) for i, d in enumerate((3, 4, 5, 6))])
    return rounded(metrics.safe_prefix_summary(probabilities(spark, sf).withColumn("selected", s), "selected", "level"))


@query(f"""WITH {_SCORES}, n AS (SELECT CAST(floor(count(*) * 0.04) AS BIGINT) // 4 AS budget
FROM s), l AS (SELECT vec_id, level, unnest([3, 4, 5, 6]) AS depth, unnest(p) AS p
FROM s), r AS (SELECT depth, p, row_number() OVER (PARTITION BY depth ORDER BY p DESC) AS r FROM l WHERE level < depth) SELECT depth, p AS threshold
FROM r, n WHERE r = budget + 1""")
def safe_prefix_thresholds(spark, sf):
    return metrics.calibrate(probabilities(spark, sf), "p", "level", (3, 4, 5, 6), 0.04)


_BEAM = """b AS (SELECT vec_id, list_transform(range(1, 6), lambda d: (vec_id * d * 31) % 17 > d) AS alive, CAST(1 + vec_id % 14 AS INTEGER) AS final_rank
FROM embeddings), f AS (SELECT vec_id, final_rank, list_position(alive, false) AS gone FROM b)"""


@query(f"""WITH {_BEAM} SELECT vec_id, CAST(gone AS INTEGER) AS first_prune,
CASE WHEN gone < 2 THEN 'pruned_before_sid' WHEN gone BETWEEN 2 AND 4 THEN 'pruned_at_' || gone WHEN final_rank = 1 THEN 'hit@1' WHEN final_rank <= 10
THEN 'hit@10_not@1' ELSE 'miss_after_sid' END AS state FROM f""")
def beam_risk_state(spark, sf):
    v = F.col("vec_id")
    gold = F.array(*[F.lit(i) for i in range(1, 6)])
    steps = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda d: F.array(F.array(F.lit(0)), F.when((v * d * 31) % 17 > d, F.slice(gold, F.lit(1), d)).otherwise(F.array(F.lit(-1)))))
    b = table(spark, sf, "embeddings").select("vec_id", gold.alias("gold"), steps.alias("steps"), (1 + v % 14).cast("int").alias("final_rank"))
    first, state = metrics.beam_state("gold", "steps", [2, 3, 4], "final_rank")
    return b.select("vec_id", first.alias("first_prune"), state.alias("state"))


@query("""WITH x AS (SELECT l_returnflag AS g, l_extendedprice / 1e5 AS pos, l_quantity / 50 AS neg FROM lineitem)
SELECT g, round(avg(greatest((neg - pos + 0.1) / 0.5, 0) + ln(1 + exp(-abs((neg - pos + 0.1) / 0.5)))), 7) AS loss FROM x GROUP BY g""")
def pairwise_loss(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), metrics.pairwise_loss(F.col("l_extendedprice") / 1e5, F.col("l_quantity") / 50, 0.5, 0.1).alias("l"))
    return x.groupBy("g").agg(F.round(F.avg("l"), 7).alias("loss"))


@query("""WITH x AS (SELECT l_orderkey AS s, l_linenumber AS p, l_quantity > 10 AS t1, l_quantity > 2 AS t10, l_discount AS nll
FROM lineitem), r AS (SELECT *, min(t1::INTEGER) OVER (PARTITION BY s ORDER BY p) AS ok
FROM x), a AS (SELECT p, avg(t1::INTEGER) AS top1, avg(t10::INTEGER) AS top10, avg(nll) AS nll, avg(ok) AS survival
FROM (SELECT s, p, bool_and(t1) AS t1, bool_and(t10) AS t10, avg(nll) AS nll, min(ok) AS ok FROM r GROUP BY s, p) GROUP BY p)
SELECT p AS position, round(top1, 9) AS top1, round(top10, 9) AS top10, round(nll, 9) AS nll, round(survival, 9) AS survival,
round(coalesce(lag(survival) OVER (ORDER BY p), 1.0) - survival, 9) AS first_failure FROM a""")
def teacher_forcing(spark, sf):
    x = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("s"), F.col("l_linenumber").alias("position")).agg(
        F.min(F.col("l_quantity") > 10).alias("t1"),
        F.min(F.col("l_quantity") > 2).alias("t10"),
        F.avg("l_discount").alias("nll"),
    )
    return rounded(metrics.teacher_forcing(x, "s", "position", "t1", "t10", "nll"))


@query("""WITH n AS (SELECT source AS g, lang AS label, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL
GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, label) AS r
FROM n), k AS (SELECT g, CASE WHEN r <= 2 THEN label ELSE '__other__' END AS label, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY ALL)
SELECT g, label, n, round(n / sum(n) OVER (PARTITION BY g), 9) AS share FROM k""")
def label_distribution(spark, sf):
    d = table(spark, sf, "documents").where("source is not null and lang is not null").select(F.col("source").alias("g"), F.col("lang").alias("l"))
    return rounded(metrics.label_distribution(d, "g", "l", 2).select("g", "label", "n", "share"))


#: Entities with written relations, made from part rows.
_NAMES = """n AS (SELECT p_partkey AS id, p_name || (p_partkey % 9) || '号楼' || CASE WHEN p_size % 2 = 0 THEN (p_size % 4) || '单元' ELSE '' END || CASE WHEN
p_partkey % 10 = 0 THEN '3号楼' ELSE '' END AS displayname, (p_partkey % 30) || '号' || (p_size % 12) || '层' AS address,
CASE WHEN p_partkey % 6 = 0 THEN (p_size % 5) || '期' ELSE '' END AS alias, p_brand AS brand FROM part)"""


def named(spark, sf):
    p = table(spark, sf, "part")
    s = lambda c: c.cast("string")
    k, z = F.col("p_partkey"), F.col("p_size")
    return p.select(
        k.alias("id"),
        F.concat("p_name", s(k % 9), F.lit("号楼"), F.when(z % 2 == 0, F.concat(s(z % 4), F.lit("单元"))).otherwise(""), F.when(k % 10 == 0, "3号楼").otherwise("")).alias("displayname"),
        F.concat(s(k % 30), F.lit("号"), s(z % 12), F.lit("层")).alias("address"),
        F.when(k % 6 == 0, F.concat(s(z % 5), F.lit("期"))).otherwise("").alias("alias"),
        F.col("p_brand").alias("brand"),
    )


def _matches_sql(source: str, pattern: str) -> str:
    """Group 1 of all matches. SQL's patterns have no look-ahead: what it forbids is taken out of the text first."""
    ahead = re.search(r"(.)\(\?!([^)]*)\)", pattern)
    if ahead:
        source = f"regexp_replace({source}, '{ahead[1]}(?:{ahead[2]})', '#', 'g')"
        pattern = pattern.replace(f"(?!{ahead[2]})", "")
    return f"regexp_extract_all({source}, '{pattern}', 1)"


_RAW = (
    _NAMES
    + ", raw AS ("
    + " UNION ALL ".join(f"SELECT id, '{r}' AS relation, {w} AS priority, CAST(unnest({_matches_sql(s, p)}) AS INTEGER) AS value FROM n" for s, w in relations.PRIORITY.items() for r, p in relations.NUMERIC)
    + """), per AS (SELECT id, relation, priority, min(value) AS low, max(value) AS high FROM raw GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY id, relation ORDER BY priority DESC) AS r FROM per),
res AS (SELECT id, relation, priority, CASE WHEN low = high THEN low END AS value, low <> high AS conflict FROM top WHERE r = 1)"""
)


def resolved(spark, sf):
    n = named(spark, sf)
    return relations.resolve(relations.raw_relations(n, "id"), "id")


@query(f"WITH {_RAW} SELECT id, relation, priority, value, conflict FROM res")
def relation_conflicts(spark, sf):
    return resolved(spark, sf)


@query(f"""WITH {_RAW} SELECT relation, count(*) AS entities, CAST(sum(conflict::INTEGER) AS BIGINT) AS conflicts, count(DISTINCT value) AS values FROM res
GROUP BY relation""")
def relation_coverage(spark, sf):
    return relations.coverage(resolved(spark, sf))


_WIDE = _RAW + ", w AS (SELECT brand, n.id, " + ", ".join(f"coalesce(max(CASE WHEN relation = '{t}' AND NOT conflict AND value BETWEEN 0 AND 1055 THEN value END), -1) AS {t}" for t in ("building", "unit", "phase")) + " FROM n LEFT JOIN res USING (id) GROUP BY ALL)"
_TREE = _WIDE + """, v AS (SELECT brand, min(building) <> max(building) AS vb, min(unit) <> max(unit) AS vu, min(phase) <> max(phase) AS vp, max(building) >= 0 AS hb,
max(unit) >= 0 AS hu, max(phase) >= 0 AS hp FROM w
GROUP BY brand), p AS (SELECT brand, id, concat_ws('/', CASE WHEN (vp OR vb OR vu) AND hp AND phase >= 0 THEN 'phase=' || phase END,
CASE WHEN (vb OR vu) AND hb AND building >= 0 THEN 'building=' || building END, CASE WHEN vu AND hu AND unit >= 0 THEN 'unit=' || unit END) AS path
FROM w JOIN v USING (brand))"""


@query(f"""WITH {_TREE} SELECT brand, id, path, count(*) OVER (PARTITION BY brand, path) AS leaf_size, CAST(CASE WHEN count(*) OVER (PARTITION BY brand,
path) > 1 THEN row_number() OVER (PARTITION BY brand, path ORDER BY id) - 1 ELSE -1 END AS INTEGER) AS leaf_code FROM p""")
def relation_tree_paths(spark, sf):
    types = ["building", "unit", "phase"]
    w = named(spark, sf).select("brand", "id").join(relations.wide(resolved(spark, sf), "id", types, 1055), "id", "left").fillna(-1, types)
    return relations.tree_paths(w, ["brand"], "id", ["phase", "building", "unit"], {"building": "phase", "unit": "building"})


@query("""SELECT id, CASE WHEN id % 3 = 0 THEN brand WHEN id % 3 = 1 THEN name ELSE name END AS parent,
CASE WHEN id % 3 = 0 THEN name WHEN id % 3 = 1 THEN brand ELSE '' END AS child FROM (SELECT p_partkey AS id, p_name AS name, p_brand AS brand
FROM part)""")
def parent_child_names(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.concat("p_brand", F.lit("("), "p_name", F.lit(")"))).when(k == 1, F.concat("p_name", F.lit("-"), "p_brand")).otherwise(F.col("p_name"))
    parent, child = relations.parent_child(name)
    return p.select(F.col("p_partkey").alias("id"), parent.alias("parent"), child.alias("child"))


@query(f"WITH {POINTS} SELECT id, round((atan2(lat - 39.9, (lng - 116.4) * cos(radians(39.9))) + 2 * pi()) % (2 * pi()), 9) AS bearing FROM points")
def bearings(spark, sf):
    from cairnflow.functions import geo

    return rounded(points(spark, sf).select("id", geo.bearing(F.col("lng"), F.col("lat"), F.lit(116.4), F.lit(39.9)).alias("bearing")))


@query(f"""WITH e AS (SELECT vec_id, round(0.5 + 0.25 / (1 + pow((1 + vec_id % 40) / 8.0, 1.5)), 9) AS alpha, round(ln(1 + least(1 + vec_id % 40,
20)) / {math.log(21.0)!r}, 9) AS support FROM embeddings) SELECT * FROM e""")
def scalar_maps(spark, sf):
    from cairnflow.operators.supervision import support

    n = 1 + F.col("vec_id") % 40
    return rounded(table(spark, sf, "embeddings").select("vec_id", (0.5 + 0.25 / (1 + F.pow(n / 8.0, F.lit(1.5)))).alias("alpha"), support(n).alias("support")))
