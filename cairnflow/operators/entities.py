"""Typed relations of entities and queries: rules over normalised names and addresses, all as column expressions.

A rule is a pattern and a group; what the group holds is a number, a Latin letter, a direction or a cyclic sign. Values of one type
are resolved by the priority of their source. Numbers in Chinese are parsed in Arrow batches, everything else stays in the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.functions import text
from cairnflow.functions.vector import let

# Characters of written numbers, names of directions and their codes, cyclic signs and their codes.
DIGITS = "0-9零〇一二两三四五六七八九十百千万"
NUMBER = rf"(?<![{DIGITS}])(?:[0-9]{{1,7}}|[零〇一二两三四五六七八九十百千万]{{1,10}})(?![{DIGITS}])"
SHORT = rf"(?<![{DIGITS}])(?:[0-9]{{1,2}}|[零〇一二两三四五六七八九十]{{1,3}})(?![{DIGITS}])"
DIRECTION = "(?:东北|东南|西南|西北|北|东|南|西|中)"
SIGN = "[甲乙丙丁戊己庚辛壬癸]"
DIRECTIONS = {"北": 0, "东北": 1, "东": 2, "东南": 3, "南": 4, "西南": 5, "西": 6, "西北": 7, "中": 8}
SIGNS = {"甲": 1, "乙": 2, "丙": 3, "丁": 4, "戊": 5, "己": 6, "庚": 7, "辛": 8, "壬": 9, "癸": 10}
ADDRESS = rf"({SIGN})?({NUMBER})(?:-({NUMBER}))?号(?!楼|栋|幢|座|铺|商铺|铺位|摊位|门|口)"
# Relation type, pattern, group, and what the group holds.
RULES = (
    ("phase", rf"第?({NUMBER})期", 1, "number"),
    ("zone_number", rf"({NUMBER})(?:号)?区", 1, "number"),
    ("zone_letter", r"(?<![A-Z])([A-Z])区", 1, "letter"),
    ("zone_direction", rf"({DIRECTION})区", 1, "direction"),
    ("building", rf"第?({NUMBER})(?:号)?(?:楼|栋|幢|座)", 1, "number"),
    ("address_number", ADDRESS, 2, "number"),
    ("sign", ADDRESS, 1, "sign"),
    ("address_subnumber", ADDRESS, 3, "number"),
    ("sign", rf"({SIGN})(?={NUMBER}(?:号)?(?:楼|栋|幢|座))", 1, "sign"),
    ("unit", rf"({NUMBER})单元", 1, "number"),
    ("basement", rf"(?<![A-Z0-9])B({SHORT})(?![{DIGITS}])(?:层|楼)?", 1, "number"),
    ("basement", rf"地下第?({NUMBER})(?:层|楼)?", 1, "number"),
    ("floor", rf"(?<![B下])第?({NUMBER})(?:层|楼层)", 1, "number"),
    ("floor", rf"(?<![A-Z0-9])F({SHORT})(?![{DIGITS}])(?:层)?", 1, "number"),
    ("floor", rf"(?<![{DIGITS}])({SHORT})F(?![A-Z0-9])(?:层)?", 1, "number"),
    ("room", rf"(?<![A-Z])({NUMBER})(?:室|房)", 1, "number"),
    ("shop", rf"({NUMBER})(?:号)?(?:商铺|铺位|摊位|铺)", 1, "number"),
    ("entrance_direction", rf"({DIRECTION})({SHORT})?(?:号)?(?:门|口)", 1, "direction"),
    ("entrance_number", rf"({DIRECTION})({SHORT})?(?:号)?(?:门|口)", 2, "number"),
    ("entrance_letter", rf"(?<![A-Z])([A-Z])({SHORT})?(?:号)?(?:门|口)", 1, "letter"),
    ("entrance_number", rf"(?<![A-Z])([A-Z])({SHORT})?(?:号)?(?:门|口)", 2, "number"),
    ("entrance_number", rf"(?<![A-Z北东南西中])({SHORT})(?:号)?(?:门|口)", 1, "number"),
)
#: Rules of names alone.
NAME_RULES = (("entity_number", rf"^({NUMBER})(?=[(]|$)", 1, "number"),)
PRIORITY = {"displayname": 3, "address": 2, "alias": 1}
#: Types whose value is a number that a query may name as such.
DIRECT = ("phase", "zone_number", "building", "address_number", "address_subnumber", "unit", "floor", "basement", "room", "shop", "entity_number", "entrance_number")


def _named(table: dict[str, int], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def typed_relations(entities: DataFrame, id_: str, sources: dict[str, int] = PRIORITY) -> DataFrame:
    """id, relation, source, priority, value: what every rule finds in every source's normalised text, each once."""

    def found(source: str, weight: int) -> list[Column]:
        t = text.relation_text(F.col(source))
        rules = (*RULES, *NAME_RULES) if source == "displayname" else RULES

        def hit(relation: str, kind: str):
            return lambda raw: F.struct(F.lit(relation).alias("relation"), F.lit(source).alias("source"), F.lit(weight).alias("priority"), F.lit(kind).alias("kind"), raw.alias("raw"))

        return [F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(g)), hit(r, k)) for r, p, g, k in rules]

    every = F.concat(*[a for s, w in sources.items() for a in found(s, w)])
    rows = entities.select(id_, F.explode(F.array_distinct(F.filter(every, lambda x: x["raw"] != ""))).alias("x")).select(id_, "x.*")
    value = (
        F.when(F.col("kind") == "number", text.contextual_integer(F.when(F.col("kind") == "number", F.col("raw"))))
        .when(F.col("kind") == "letter", F.ascii("raw") - F.ascii(F.lit("A")) + 1)
        .when(F.col("kind") == "direction", _named(DIRECTIONS, F.col("raw")))
        .when(F.col("kind") == "sign", _named(SIGNS, F.col("raw")))
    )
    return rows.select(id_, "relation", "source", "priority", value.cast("long").alias("value")).where("value is not null").distinct()


def selected_relations(raw: DataFrame, id_: str) -> DataFrame:
    """id, relation, priority, value (null where the highest source names several), candidates (all values), conflict (more than one)."""
    per = raw.groupBy(id_, "relation", "priority").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.collect_set("value").alias("values"))
    out = per.groupBy(id_, "relation").agg(
        F.max(F.struct("priority", "low", "high")).alias("t"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("values")))).alias("candidates"),
    )
    value = F.when(F.col("t.low") == F.col("t.high"), F.col("t.low"))
    return out.select(id_, "relation", F.col("t.priority").alias("priority"), value.alias("value"), "candidates", (F.size("candidates") > 1).alias("conflict"))


def query_features(queries: DataFrame, id_: str, query: str) -> DataFrame:
    """id, typed (sorted `relation=value`), numbers (sorted): a query read as a name, and every number of up to 7 digits in it or
    in a type that names a number."""
    named = queries.select(id_, F.col(query).alias("displayname"))
    chosen = selected_relations(typed_relations(named, id_, {"displayname": 3}), id_).where("value is not null")
    pair = F.struct("relation", "value")
    direct = F.when(F.col("relation").isin(*DIRECT), F.col("value"))
    per = chosen.groupBy(id_).agg(F.array_sort(F.collect_list(pair)).alias("p"), F.collect_set(direct).alias("d"))
    plain = F.transform(F.regexp_extract_all(text.relation_text(F.col("displayname")), F.lit(r"(?<![0-9])([0-9]{1,7})(?![0-9])"), F.lit(1)), lambda x: x.cast("long"))
    both = named.select(id_, plain.alias("n")).join(per, id_, "left")
    typed = F.transform(F.coalesce("p", F.array().cast("array<struct<relation:string,value:bigint>>")), lambda x: F.concat(x["relation"], F.lit("="), x["value"].cast("string")))
    numbers = F.array_sort(F.array_union(F.coalesce("n", F.array().cast("array<bigint>")), F.coalesce("d", F.array().cast("array<bigint>"))))
    return both.select(id_, typed.alias("typed"), numbers.alias("numbers"))


def label(value: Column, unicode: bool = True) -> Column:
    """NFKC, upper case, dashes as hyphens, no white space, no punctuation at the ends, 160 characters at most; null becomes empty."""
    t = F.upper(text.nfkc(value) if unicode else value)
    t = F.regexp_replace(F.translate(t, "—–－", "---"), r"\s+", "")
    return F.coalesce(F.substring(F.regexp_replace(t, r"^[-_:：,，.。;；/|｜\[\]【】]+|[-_:：,，.。;；/|｜\[\]【】]+$", ""), 1, 160), F.lit(""))


# Patterns of roads, codes, names with brackets or gates, and plain numbers.
ROAD = r"([A-Z0-9㐀-鿿·]{1,32}(?:高速公路|公路|大道|大街|胡同|路|街|道|巷))"
CODE = r"^[A-Z]{0,2}[-_]?0*[0-9]{1,6}$"
COMPOUND = r"^[0-9]{1,5}(?:-[0-9]{1,5}){1,2}$"
BRACKET = r"^(.+?)[(（]([^()（）]{1,100})[)）]$"
GATE = r"^(.+?)(东北门|东南门|西南门|西北门|东门|南门|西门|北门|正门|侧门)$"
PLAIN = r"(?:[0-9]{1,7}|[零〇一二两三四五六七八九十百千万]{1,10})"


def last(t: Column, pattern: str, group: int = 1) -> Column:
    """A group of the last match; null without one."""
    return F.try_element_at(F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), F.lit(-1))


def road_entity(address: Column, unicode: bool = True) -> Column:
    """The last road of an address, from the end of its last city, district or town on."""
    road = last(label(address, unicode), ROAD)
    short = reduce(lambda r, marker: F.substring_index(r, marker, -1), ("北京市", "市", "区", "县", "街道", "镇", "乡"), road)
    return F.coalesce(label(short, False), F.lit(""))


def split_name(name: Column, unicode: bool = True) -> Column:
    """struct(parent, child) of a name: brackets, then the last hyphen, then a gate, then a second house number; else the name alone."""

    def parts(t: Column) -> Column:
        take = lambda pattern, g: label(F.regexp_extract(t, pattern, g), False)
        pair = lambda a, b: F.struct(a.alias("parent"), b.alias("child"))
        outside, inside = take(BRACKET, 1), take(BRACKET, 2)
        code = outside.rlike(CODE) | outside.rlike(COMPOUND)
        dash = (take(r"^(.*)-([^-]*)$", 1), take(r"^(.*)-([^-]*)$", 2))
        house = rf"^(.*?{PLAIN}号)(.*{PLAIN}号.*)$"
        return (
            F.when(t.rlike(BRACKET), F.when(code, pair(inside, outside)).otherwise(pair(outside, inside)))
            .when(F.contains(t, F.lit("-")) & ~t.rlike(CODE) & (dash[0] != "") & (dash[1] != ""), pair(*dash))
            .when(t.rlike(GATE), pair(take(GATE, 1), take(GATE, 2)))
            .when(t.rlike(house) & (take(house, 2) != ""), pair(take(house, 1), take(house, 2)))
            .otherwise(pair(t, F.lit("")))
        )

    return let(label(name, unicode), parts)


#: Largest value of a fine relation.
MOST = 32_767
# Codes of letters and digits, and what follows a building's number.
ALNUM = r"(?<![A-Z0-9])([A-Z]{0,2})[-_]?([0-9]{1,6})([A-Z]{0,2})"
STOREY = r"(?:号)?(?:楼|栋|幢|座)"
# Fine numeric relations of a name, and what follows their number.
TRIGGERS = (("parking_slot", "车位"), ("row", "排"), ("store_number", "店|门店"), ("booth_number", "柜台|柜|档口|摊位"))


def _packed(t: Column, after: str) -> Column:
    """The last code of letters and digits with `after` behind it, as base 36 and its length; -1 without one."""
    pattern = ALNUM + r"(?![A-Z0-9])" + after
    groups = F.arrays_zip(*[F.regexp_extract_all(t, F.lit(pattern), F.lit(g)).alias(n) for g, n in ((1, "a"), (2, "n"), (3, "z"))])
    real = F.filter(groups, lambda x: (x["a"] != "") | (x["z"] != ""))
    code = F.try_element_at(F.transform(real, lambda x: F.concat(x["a"], x["n"], x["z"])), F.lit(-1))
    return F.coalesce(F.shiftleft(F.conv(code, 36, 10).cast("long"), 4).bitwiseOR(F.length(code).cast("long")), F.lit(-1).cast("long"))


def fine_relations(entities: DataFrame, id_: str) -> DataFrame:
    """id and the fine relations of displayname, address, category_code and layer: numbers (-1 without), category parts, road, parent, child."""
    base = entities.select(
        id_,
        text.relation_text(F.col("displayname")).alias("d"),
        text.relation_text(F.col("address")).alias("a"),
        split_name(F.col("displayname")).alias("p"),
        road_entity(F.col("address")).alias("road"),
        label(F.col("category_code")).alias("c"),
        "layer",
    )
    base = base.withColumn("child", F.col("p.child"))
    d, a = F.col("d"), F.col("a")
    compound = r"(?<![0-9])([0-9]{1,5})-([0-9]{1,5})(?:-([0-9]{1,5}))?(?![0-9])"
    house = rf"({PLAIN})(?:-(?:{PLAIN}))?号(?!楼|栋|幢|座|铺|商铺|铺位|摊位|门|口)"
    storey = rf"第?({PLAIN}){STOREY}"
    # codes of letters and digits are no numbers of their own
    bare = F.regexp_replace(F.col("child"), r"(?<![A-Z0-9])(?:[A-Z]{1,2}[-_]?[0-9]{1,6}[A-Z]{0,2}|[-_]?[0-9]{1,6}[A-Z]{1,2})(?![A-Z0-9])", "")
    tail = lambda t: F.when(last(t, compound, 3) != "", last(t, compound, 3)).otherwise(last(t, compound, 2))
    raw = {
        "inner_number": F.when(F.size(F.regexp_extract_all(d, F.lit(rf"({PLAIN})号"), F.lit(1))) > 1, last(d, rf"({PLAIN})号")),
        **{n: last(d, rf"({PLAIN})(?:号)?(?:{after})") for n, after in TRIGGERS},
        "child_number": last(bare, rf"({PLAIN})"),
        "address_main": F.coalesce(last(d, house), last(a, house)),
        "building_number": F.coalesce(last(d, storey), last(a, storey)),
        "compound_head": F.coalesce(last(d, compound), last(a, compound)),
        "compound_tail": F.coalesce(tail(d), tail(a)),
    }
    names = list(raw)
    # all numbers of a row are parsed at once
    rows = base.select("*", *[c.alias(f"__{n}") for n, c in raw.items()])
    number = lambda n: text.contextual_integer(F.col(f"__{n}"))
    rows = rows.select("*", *[number(n).alias(f"_{n}") for n in names])
    kept = lambda c: F.when(c.between(0, MOST), c).otherwise(F.lit(-1)).cast("long")
    first = lambda x, y: F.when(x >= 0, x).otherwise(y)
    building = first(_packed(F.col("child"), rf"(?={STOREY})"), _packed(d, rf"(?={STOREY})"))
    entity = first(_packed(F.col("child"), rf"(?!{STOREY})"), _packed(d, rf"(?!{STOREY})"))
    rows = rows.withColumn("building_code", building).withColumn("entity_code", entity)
    alpha = r"(?<![A-Z0-9])([A-Z]{1,2})[-_]?0*([0-9]{1,5})(?![A-Z0-9])"
    letters, digits = last(d, alpha, 1), last(d, alpha, 2).cast("long")
    prefix = F.aggregate(F.split(letters, ""), F.lit(0), lambda s, x: F.when(x == "", s).otherwise(s * 27 + F.ascii(x) - 64))
    plain = (F.col("building_code") < 0) & (F.col("entity_code") < 0) & (digits <= MOST)
    code = F.col("c").rlike("^[0-9]{2,}$")
    layer = F.try_to_number(F.col("layer").cast("string"), F.lit("99999")).cast("long")
    return rows.select(
        id_,
        *[kept(F.col(f"_{n}")).alias(n) for n in names],
        F.coalesce(F.when(plain, prefix.cast("long")), F.lit(-1)).alias("alpha_prefix"),
        F.coalesce(F.when(plain, digits), F.lit(-1)).alias("alpha_number"),
        "building_code",
        "entity_code",
        F.when(code, F.substring("c", 1, 2).cast("int")).otherwise(-1).alias("category_major"),
        F.when(code & (F.length("c") >= 4), F.substring("c", 1, 4).cast("int")).otherwise(-1).alias("category_mid"),
        F.when(code, F.col("c")).otherwise("").alias("category_leaf"),
        F.coalesce(F.when(layer.between(0, MOST), layer), F.lit(-1)).alias("layer"),
        "road",
        F.col("p.parent").alias("parent"),
        "child",
    )


def vocabulary(rows: DataFrame, column: str, least: int, most: int, by_support: bool = True) -> DataFrame:
    """value, id (from 1): non-empty values with at least `least` rows, by number of rows then value (or by value alone), the first `most`."""
    n = rows.where(F.col(column) != "").groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    order = ([F.desc("n")] if by_support else []) + [F.col("value")]
    top = n.orderBy(*order).limit(most).collect()  # a vocabulary of declared size
    return rows.sparkSession.createDataFrame([(r["value"], i) for i, r in enumerate(top, 1)], "value string, id int")


def coded(rows: DataFrame, column: str, words: DataFrame, name: str) -> DataFrame:
    """rows with the id of a column's value, -1 for values outside the vocabulary."""
    own = words.select(F.col("value").alias(column), F.col("id").alias(name))
    return rows.join(own, column, "left").fillna(-1, [name])


def character_ids(rows: DataFrame, columns: list[str], depth: int = 12) -> DataFrame:
    """rows with prefix_C and suffix_C: ids (from 1, by code point over all the columns) of the first and, backwards, last characters."""
    letters = lambda c: F.filter(F.split(F.col(c), ""), lambda x: x != "")
    seen = reduce(DataFrame.unionByName, [rows.select(F.explode(F.array_distinct(letters(c))).alias("ch")) for c in columns]).distinct()
    table = {r["ch"]: i for i, r in enumerate(seen.orderBy("ch").collect(), 1)}  # the characters of a script
    ids = F.create_map(*[F.lit(x) for pair in table.items() for x in pair]) if table else F.create_map().cast("map<string,int>")
    out = rows.withColumn("__ids", ids)
    code = lambda a: F.transform(a, lambda ch: F.element_at(F.col("__ids"), ch))
    for c in columns:
        out = out.withColumn(f"prefix_{c}", code(F.slice(letters(c), 1, depth))).withColumn(f"suffix_{c}", code(F.slice(F.reverse(letters(c)), 1, depth)))
    return out.drop("__ids")


def relation_matrix(fine: DataFrame, least: int = 2, most: int = 4096) -> DataFrame:
    """fine_relations() with ids instead of texts: categories by value, roads, parents and children by support, characters by position."""
    out = coded(fine, "category_leaf", vocabulary(fine, "category_leaf", 1, MOST, False), "category_id")
    for c in ("road", "parent", "child"):
        out = coded(out, c, vocabulary(fine, c, least, most), f"{c}_id")
    return character_ids(out, ["parent", "child"])


def decoded(values: DataFrame, words: DataFrame, id_: str) -> DataFrame:
    """values with `text`: the vocabulary's value of an id; numbers outside it as text."""
    return values.join(words.withColumnRenamed("id", id_).withColumnRenamed("value", "__v"), id_, "left").withColumn("text", F.coalesce("__v", F.col(id_).cast("string"))).drop("__v")


def unified(strict: DataFrame, fine: DataFrame, id_: str, roles: dict[str, list[str]]) -> DataFrame:
    """id and one column a role: the first of the role's columns (strict ones as `s.x`, fine as `f.x`) with a value of 0 or more, else -1."""
    both = strict.alias("s").join(fine.alias("f"), F.col(f"s.{id_}") == F.col(f"f.{id_}"), "full")
    pick = lambda names: F.coalesce(*[F.when(F.col(n) >= 0, F.col(n)) for n in names], F.lit(-1))
    return both.select(F.coalesce(F.col(f"s.{id_}"), F.col(f"f.{id_}")).alias(id_), *[pick(names).cast("long").alias(role) for role, names in roles.items()])


def tree_values(matrix: DataFrame, id_: str, roles: list[str], building: str, child_number: str, child: str) -> DataFrame:
    """id and the tree's roles; a missing building is twice the child's number where the child is a building by its name."""
    named = F.col(child).rlike(rf"^第?[A-Z]{{0,2}}[{DIGITS}]+[A-Z]{{0,2}}号?(?:楼|栋|幢|座)$")
    own = F.when((F.col(building) < 0) & (F.col(child_number) >= 0) & named, 2 * F.col(child_number)).otherwise(F.col(building))
    return matrix.select(id_, *[own.alias(r) if r == building else F.col(r) for r in roles])


def reliable_types(metrics: DataFrame, relation: str, support: str, ratio: str, least: int, least_ratio: float) -> DataFrame:
    """Relation types that enough orders speak of and that match their target often enough."""
    return metrics.where((F.col(support) >= least) & (F.col(ratio) >= least_ratio)).select(relation)
