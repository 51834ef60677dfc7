"""Typed relations of entities and queries, and their matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnflow.operators import entities as en
from cairnflow.plans.base import query, table

#: Entities with written names and addresses, made from part rows.
_ENTITIES = """n AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'Garden ' || p_brand || '(' || p_size || '号楼)' WHEN 1 THEN '(12-3)' || p_name WHEN 2 THEN
'Mall - ' || p_type || '- B' || p_size || 'A' WHEN 3 THEN p_name || '东南门' WHEN 4 THEN p_name || '8号院' || p_size || '号 店' ELSE ' ' || p_name || '。' END
AS displayname,
CASE p_partkey % 5 WHEN 0 THEN '北京市海淀区中关村大街' || p_size || '号' WHEN 1 THEN '上海市长宁区 仙霞路' || p_size || '-2号3楼' WHEN 2 THEN p_name || '街道和平巷' WHEN 3 THEN
NULL ELSE 'nowhere' END AS address FROM part)"""


def named(spark, sf):
    p = table(spark, sf, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    name = (
        F.when(k % 6 == 0, F.concat(F.lit("Garden "), "p_brand", F.lit("("), size, F.lit("号楼)")))
        .when(k % 6 == 1, F.concat(F.lit("(12-3)"), "p_name"))
        .when(k % 6 == 2, F.concat(F.lit("Mall - "), "p_type", F.lit("- B"), size, F.lit("A")))
        .when(k % 6 == 3, F.concat("p_name", F.lit("东南门")))
        .when(k % 6 == 4, F.concat("p_name", F.lit("8号院"), size, F.lit("号 店")))
        .otherwise(F.concat(F.lit(" "), "p_name", F.lit("。")))
    )
    address = (
        F.when(k % 5 == 0, F.concat(F.lit("北京市海淀区中关村大街"), size, F.lit("号")))
        .when(k % 5 == 1, F.concat(F.lit("上海市长宁区 仙霞路"), size, F.lit("-2号3楼")))
        .when(k % 5 == 2, F.concat("p_name", F.lit("街道和平巷")))
        .when(k % 5 == 4, F.lit("nowhere"))
    )
    code = F.when(k % 4 != 0, F.lpad((k % 7 * 1013).cast("string"), 6, "1")).otherwise("x")
    return p.select(k.alias("id"), name.alias("displayname"), address.alias("address"), F.lit("").alias("alias"), code.alias("category_code"), (k % 9).cast("string").alias("layer"))


_LABEL = "regexp_replace(regexp_replace(upper({}), '\\s+', '', 'g'), '^[-_:：,，.。;；/|｜\\[\\]【】]+|[-_:：,，.。;；/|｜\\[\\]【】]+$', '', 'g')"
_ROADS = f"r AS (SELECT id, regexp_extract_all({_LABEL.format('address')}, '{en.ROAD}', 1)[-1] AS road FROM n)"
_AFTER = "road"
for _marker in ("北京市", "市", "区", "县", "街道", "镇", "乡"):
    _AFTER = f"string_split({_AFTER}, '{_marker}')[-1]"


@query(f"WITH {_ENTITIES}, {_ROADS} SELECT id, coalesce({_LABEL.format(_AFTER)}, '') AS road FROM r")
def road_entities(spark, sf):
    return named(spark, sf).select("id", en.road_entity(F.col("address")).alias("road"))


_HOUSE = f"^(.*?{en.PLAIN}号)(.*{en.PLAIN}号.*)$"
_SPLIT = f"""l AS (SELECT id, {_LABEL.format('displayname')} AS t
FROM n), s AS (SELECT id, t, CASE WHEN regexp_full_match(t, '{en.BRACKET[1:-1]}') THEN 'b' WHEN contains(t, '-') AND NOT regexp_full_match(t,
'{en.CODE[1:-1]}') THEN 'd' WHEN regexp_full_match(t, '{en.GATE[1:-1]}') THEN 'g' WHEN regexp_full_match(t,
'{_HOUSE[1:-1]}') THEN 'h' ELSE 'n' END AS k FROM l),
x AS (SELECT id, t, k, CASE k WHEN 'b' THEN regexp_extract(t, '{en.BRACKET}', 1) WHEN 'd' THEN regexp_extract(t, '^(.*)-([^-]*)$',
1) WHEN 'g' THEN regexp_extract(t, '{en.GATE}', 1) WHEN 'h' THEN regexp_extract(t, '{_HOUSE}', 1) ELSE t END AS a,
CASE k WHEN 'b' THEN regexp_extract(t, '{en.BRACKET}', 2) WHEN 'd' THEN regexp_extract(t, '^(.*)-([^-]*)$', 2) WHEN 'g' THEN regexp_extract(t,
'{en.GATE}', 2) WHEN 'h' THEN regexp_extract(t, '{_HOUSE}', 2) ELSE '' END AS b FROM s)"""


@query(f"WITH {_ENTITIES}, {_SPLIT} SELECT id, {_LABEL.format('a')} AS parent, {_LABEL.format('b')} AS child FROM x")
def entity_names(spark, sf):
    s = named(spark, sf).select("id", en.split_name(F.col("displayname")).alias("s"))
    return s.select("id", "s.parent", "s.child")


@query()
def typed_relations(spark, sf):
    """Relations by rule with their resolution (look-around has no SQL form; a test repeats the rules with another engine)."""
    return en.selected_relations(en.typed_relations(named(spark, sf), "id"), "id").withColumn("candidates", F.array_join(F.transform("candidates", lambda x: x.cast("string")), ","))


@query()
def query_relation_features(spark, sf):
    q = named(spark, sf).select("id", "displayname")
    out = en.query_features(q, "id", "displayname")
    return out.select("id", F.array_join("typed", ",").alias("typed"), F.array_join(F.transform("numbers", lambda x: x.cast("string")), ",").alias("numbers"))


@query()
def fine_relations(spark, sf):
    return en.fine_relations(named(spark, sf), "id")


@query()
def relation_matrix(spark, sf):
    out = en.relation_matrix(en.fine_relations(named(spark, sf), "id"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("id", "category_id", "road_id", "parent_id", "child_id", text("prefix_parent"), text("suffix_child"))


_VOCABULARY = f"""{_ENTITIES}, {_SPLIT}, p AS (SELECT id, {_LABEL.format('a')} AS parent
FROM x), v AS (SELECT parent AS value, row_number() OVER (ORDER BY count(*) DESC, parent) AS i FROM p WHERE parent <> '' GROUP BY parent
HAVING count(*) >= 3 QUALIFY i <= 20)"""


@query(f"WITH {_VOCABULARY} SELECT id, CAST(coalesce(i, -1) AS INTEGER) AS parent_id, coalesce(value, '-1') AS text FROM p LEFT JOIN v ON v.value = p.parent")
def parent_vocabulary(spark, sf):
    names = entity_names(spark, sf).select("id", "parent")
    words = en.vocabulary(names, "parent", 3, 20)
    return en.decoded(en.coded(names, "parent", words, "parent_id").select("id", "parent_id"), words, "parent_id")


@query(
    f"""WITH {_ENTITIES}, {_SPLIT}, c AS (SELECT id, {_LABEL.format('b')} AS child FROM x), u AS (SELECT DISTINCT unnest(string_split(child, '')) AS ch FROM c
WHERE child <> ''), k AS (SELECT ch, row_number() OVER (ORDER BY ch) AS i FROM u WHERE ch <> '')
SELECT id, coalesce((SELECT i FROM k WHERE ch = substr(child, 1, 1)), -1)::INTEGER AS first, coalesce((SELECT i FROM k
WHERE ch = substr(child, length(child), 1)), -1)::INTEGER AS last FROM c"""
)
def child_characters(spark, sf):
    out = en.character_ids(entity_names(spark, sf).select("id", "child"), ["child"], 12)
    at = lambda c: F.coalesce(F.try_element_at(F.col(c), F.lit(1)), F.lit(-1))
    return out.select("id", at("prefix_child").alias("first"), at("suffix_child").alias("last"))


@query(
    """WITH s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE -1 END AS building FROM part
WHERE p_partkey % 11 <> 0), f AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_size + 100 ELSE -1 END AS building_number,
p_size % 4 AS layer FROM part WHERE p_partkey % 13 <> 0)
SELECT coalesce(s.id, f.id) AS id, CAST(coalesce(CASE WHEN building >= 0 THEN building END, CASE WHEN building_number >= 0 THEN building_number END,
-1) AS BIGINT) AS building, CAST(coalesce(CASE WHEN layer >= 0 THEN layer END, -1) AS BIGINT) AS layer FROM s FULL JOIN f ON s.id = f.id"""
)
def unified_relations(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    s = p.where(k % 11 != 0).select(k.alias("id"), F.when(k % 3 == 0, F.col("p_size")).otherwise(-1).alias("building"))
    f = p.where(k % 13 != 0).select(k.alias("id"), F.when(k % 2 == 0, F.col("p_size") + 100).otherwise(-1).alias("building_number"), (F.col("p_size") % 4).alias("layer"))
    return en.unified(s, f, "id", {"building": ["s.building", "f.building_number"], "layer": ["f.layer"]})


@query(
    """WITH m AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 7 ELSE -1 END AS building, p_size % 20 - 1 AS child_number, p_size % 5 AS unit,
CASE WHEN p_partkey % 2 = 0 THEN p_size || '号楼' ELSE p_size || '室' END AS child FROM part)
SELECT id, CASE WHEN building < 0 AND child_number >= 0 AND regexp_full_match(child,
'第?[A-Z]{0,2}[0-9零〇一二两三四五六七八九十百千万]+[A-Z]{0,2}号?(?:楼|栋|幢|座)') THEN 2 * child_number ELSE building END AS building, unit FROM m"""
)
def tree_relation_values(spark, sf):
    p, k, z = table(spark, sf, "part"), F.col("p_partkey"), F.col("p_size")
    m = p.select(
        k.alias("id"),
        F.when(k % 3 == 0, 7).otherwise(-1).alias("building"),
        (z % 20 - 1).alias("child_number"),
        (z % 5).alias("unit"),
        F.concat(z.cast("string"), F.when(k % 2 == 0, "号楼").otherwise("室")).alias("child"),
    )
    return en.tree_values(m, "id", ["building", "unit"], "building", "child_number", "child")


@query("""WITH m AS (SELECT p_type AS relation, count(*) AS support, avg((p_size % 2)::DOUBLE) AS ratio FROM part GROUP BY 1) SELECT relation FROM m
WHERE support >= 300 AND ratio >= 0.5""")
def reliable_relation_types(spark, sf):
    m = table(spark, sf, "part").groupBy(F.col("p_type").alias("relation")).agg(F.count(F.lit(1)).alias("support"), F.avg((F.col("p_size") % 2).cast("double")).alias("ratio"))
    return en.reliable_types(m, "relation", "support", "ratio", 300, 0.5)
