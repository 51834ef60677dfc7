"""Operators without SQL: relations by another regex engine, fits by plain sums, draws by their rule."""

import itertools
import math
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnflow.functions import text
from cairnflow.operators import assets, builders, entities, evaluation, lookups, quantizers, querystats, resolution, sampling, subsets, vectors
from cairnflow.operators.registry import METHODS, method_names

NAMES = [
    ("花园(3期)甲12-3号楼", "海淀区中关村大街27号", ""),
    ("12(旗舰店)", "第五层B2地下一层", "F3"),
    ("东南2号门A口", "上海市3区北区C区", "十二单元301室"),
    ("乙8号院5单元", None, "8号院5单元"),
    ("大厦三十二层12F", "15号16号", "地下2层"),
    ("商铺7号铺A12号门", "A区12座", None),
    ("", "3号楼3号楼", "4号楼"),
    ("一百零五室", "2期2期", "３期"),
]


def normalised(s):
    t = unicodedata.normalize("NFKC", s or "").upper()
    for d in "—–−":
        t = t.replace(d, "-")
    return re.sub(r"\s+", "", t)


def valued(kind, raw):
    return {"number": lambda: text.parse_integer(raw), "letter": lambda: ord(raw) - 64, "direction": lambda: entities.DIRECTIONS[raw], "sign": lambda: entities.SIGNS[raw]}[kind]()


def plain_relations(row):
    found = {}
    for source, s in zip(("displayname", "address", "alias"), row, strict=True):
        rules = (*entities.RULES, *entities.NAME_RULES) if source == "displayname" else entities.RULES
        for relation, pattern, group, kind in rules:
            for m in re.finditer(pattern, normalised(s)):
                if m[group]:
                    found.setdefault(relation, []).append((entities.PRIORITY[source], valued(kind, m[group])))
    out = {}
    for relation, seen in found.items():
        top = max(p for p, _ in seen)
        best = {v for p, v in seen if p == top}
        out[relation] = (top, best.pop() if len(best) == 1 else None, sorted({v for _, v in seen}))
    return out


def test_typed_relations_equal_another_engine(spark):
    df = spark.createDataFrame([(i, *n) for i, n in enumerate(NAMES)], "id long, displayname string, address string, alias string")
    got = {}
    for r in entities.selected_relations(entities.typed_relations(df, "id"), "id").collect():
        got.setdefault(r.id, {})[r.relation] = (r.priority, r.value, list(r.candidates))
        assert r.conflict == (len(r.candidates) > 1)
    assert got == {i: plain_relations(n) for i, n in enumerate(NAMES) if plain_relations(n)}
    feats = {r.id: r for r in entities.query_features(df, "id", "displayname").collect()}
    for i, (name, *_) in enumerate(NAMES):
        own = plain_relations((name, None, None))
        typed = sorted((k, v) for k, (_, v, _) in own.items() if v is not None)
        numbers = {int(m) for m in re.findall(r"(?<![0-9])[0-9]{1,7}(?![0-9])", normalised(name))} | {v for k, v in typed if k in entities.DIRECT}
        assert list(feats[i].typed) == [f"{k}={v}" for k, v in typed] and list(feats[i].numbers) == sorted(numbers)


def test_fine_relations_of_written_names(spark):
    rows = [
        (1, "A座-B12C号楼301", "中关村大街27-3号", "120304", "7"),
        (2, "3号车位12排", "8号楼", "12", "x"),
        (3, "第二门店5号摊位", None, "abc", None),
        (4, "10-20-30店1号2号", "大街", "1203", "-1"),
        (5, "AB007", "", "", "40000"),
    ]
    got = {r.id: r for r in entities.fine_relations(spark.createDataFrame(rows, "id long, displayname string, address string, category_code string, layer string"), "id").collect()}
    pack = lambda s: (int(s, 36) << 4) | len(s)
    assert (
        got[1].building_code,
        got[1].address_main,
        got[1].child_number,
        got[1].category_major,
        got[1].category_mid,
        got[1].category_leaf,
        got[1].layer,
    ) == (pack("B12C"), 27, 301, 12, 1203, "120304", 7)
    assert got[1].parent == "A座" and got[1].road == "中关村大街" and got[1].alpha_prefix == -1
    assert (got[2].parking_slot, got[2].row, got[2].building_number, got[2].category_mid, got[2].layer) == (3, 12, 8, -1, -1)
    assert (got[3].store_number, got[3].booth_number, got[3].category_leaf) == (2, 5, "")
    assert (got[4].compound_head, got[4].compound_tail, got[4].inner_number, got[4].category_mid) == (10, 30, 2, 1203)
    assert got[5].entity_code == pack("AB007") and got[5].layer == -1
    m = entities.relation_matrix(spark.createDataFrame(
        [(i, f"{'AB' if i % 2 else 'CD'}馆(x{i % 3})", "人民路1号", str(1000 + i % 2), "1") for i in range(9)],
        "id long, displayname string, address string, category_code string, layer string",
    ).transform(lambda d: entities.fine_relations(d, "id")))
    seen = {r.id: r for r in m.collect()}
    assert {seen[i].category_id for i in range(9)} == {1, 2} and {seen[i].road_id for i in range(9)} == {1}
    assert seen[0].parent_id == 1 and seen[1].parent_id == 2 and list(seen[0].prefix_parent) == list(reversed(list(seen[0].suffix_parent)))


def test_dual_fit_never_gets_worse_and_equals_plain_rounds(spark):
    r = np.random.default_rng(5)
    c, q = r.normal(size=(90, 3)), r.normal(size=(90, 3))
    rows = [(i, c[i].tolist(), q[i].tolist() if i % 3 else None) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, c array<double>, q array<double>")
    mu, nu = [(k, c[k].tolist()) for k in range(5)], [(k, q[k + 1].tolist()) for k in range(5)]
    a, b, trace = quantizers.fit_dual(df, "c", "q", mu, nu, 0.5, 5)
    values = [t["objective"] for t in trace]
    assert all(y <= x + 1e-9 for x, y in itertools.pairwise(values))
    m, n = np.array([v for _, v in mu]), np.array([v for _, v in nu])
    covered = np.arange(90) % 3 > 0
    for _ in trace:
        cost = ((c[:, None] - m) ** 2).sum(2) + 0.5 * covered[:, None] * ((q[:, None] - n) ** 2).sum(2)
        at = cost.argmin(1)
        for k in range(5):
            if (at == k).any():
                m[k] = c[at == k].mean(0)
            if (covered & (at == k)).any():
                n[k] = q[covered & (at == k)].mean(0)
    assert np.allclose(m, [v for _, v in a]) and np.allclose(n, [v for _, v in b])


def test_coupled_fit_follows_its_steps(spark):
    r = np.random.default_rng(7)
    x, y = r.normal(size=(40, 4)), r.normal(size=(12, 4))
    pois = spark.createDataFrame([(i, x[i].tolist(), i % 3, i % 4) for i in range(40)], "poi long, x array<double>, category int, code int")
    queries = spark.createDataFrame([(i, y[i].tolist()) for i in range(12)], "query long, x array<double>")
    links = [(i, (i * 5 + k) % 12, 1.0 + k) for i in range(40) for k in range(2)]
    edges = spark.createDataFrame(links, "poi long, query long, weight double")
    book = [(k, x[k].tolist()) for k in range(4)]
    rule = quantizers.Coupling(most=1)
    got, asked, poi_book, query_book, trace = quantizers.fit_coupled(pois, queries, edges, book, rule)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    b, p = unit(x[:4]), np.arange(40) % 4
    vote = lambda ids, other, n: np.array([[sum(w for i, j, w in ids if i == a and other[j] != k) for k in range(4)] for a in range(n)])
    to_query = [(j, i, w) for i, j, w in links]
    qw, gw, _ = quantizers.warmup_weights(1, rule.query, rule.graph, rule.category)
    s = (qw * (1 - unit(y) @ b.T) + gw * vote(to_query, p, 12)).argmin(1)
    shrunk = unit(np.array([(y[s == k].sum(0) + rule.shrinkage * x[k]) / ((s == k).sum() + rule.shrinkage) for k in range(4)]))
    p1 = ((1 - unit(x) @ b.T) + gw * vote(links, s, 40)).argmin(1)
    s1 = (qw * (1 - unit(y) @ unit(shrunk).T) + gw * vote(to_query, p1, 12)).argmin(1)
    assert [r.code for r in sorted(got.collect(), key=lambda r: r.poi)] == p1.tolist()
    assert [r.code for r in sorted(asked.collect(), key=lambda r: r.query)] == s1.tolist()
    for k, v in poi_book:
        if (p1 == k).any():
            assert np.allclose(v, unit(x[p1 == k].mean(0)))
    assert len(trace) == 1 and trace[0]["improvement"] is None


def test_residual_codes_follow_plain_levels(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(50, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    book = [(k, x[k].tolist()) for k in range(4)]
    out = {r.vec_id: r for r in vectors.encode_level(df, book, "embedding", "s1").collect()}
    u, m = x / np.linalg.norm(x, axis=1, keepdims=True), x[:4] / np.linalg.norm(x[:4], axis=1, keepdims=True)
    for i in range(50):
        k = int((u[i] @ m.T).argmax())
        left = x[i] - (x[i] @ x[k]) / (x[k] @ x[k]) * x[k]
        assert out[i].s1 == k
        if np.linalg.norm(left) > 1e-9:
            assert np.allclose(out[i].embedding, left / np.linalg.norm(left))
    codes = vectors.residual_codes(df, 3, 4)
    assert codes.columns == ["vec_id", "s1", "s2", "s3"] and codes.count() == 50
    assert len({tuple(r)[1:] for r in codes.collect()}) > 10


def test_local_codes_take_one_sweep(spark):
    r = np.random.default_rng(11)
    x = r.normal(size=(24, 3))
    rows = [(i, i % 2, x[i].tolist(), 116 + 0.01 * (i % 5), 39.9 + 0.01 * (i % 7)) for i in range(24)]
    df = spark.createDataFrame(rows, "id long, parent int, v array<double>, lng double, lat double")
    hard = spark.createDataFrame([(i, (i + 2) % 24) for i in range(24)], "id long, neighbor long")
    book = [(k, x[k].tolist()) for k in range(5)]
    got = {r.id: r for r in assets.local_codes(df, ["parent"], "id", "v", book, "lng", "lat", 3, 0.0, 0.0, hard, 1).collect()}
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    best = (1 - unit(x) @ unit(x[:5]).T).argmin(1)
    assert [got[i].code for i in range(24)] == best.tolist()
    clash = assets.local_codes(df, ["parent"], "id", "v", book, "lng", "lat", 5, 0.3, 5.0, hard, 3).collect()
    code = {r.id: r.code for r in clash}
    assert sum(code[i] == code[(i + 2) % 24] for i in range(24)) <= sum(best[i] == best[(i + 2) % 24] for i in range(24))


def test_prefix_pairs_share_exactly_their_prefix(spark):
    rows = [(i, i % 3, i % 5 % 2, i % 7) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, s1 int, s2 int, s3 int")
    got = subsets.prefix_pairs(df, ["s1", "s2", "s3"], 1, "id", 300, 1).collect()
    at = {r[0]: r for r in rows}
    assert len(got) == 300 and all(at[g.a][1] == at[g.b][1] and at[g.a][2] != at[g.b][2] for g in got)
    assert {at[g.a][1] for g in got} == {0, 1, 2}
    assert subsets.prefix_pairs(df.where("s2 = 0"), ["s1", "s2", "s3"], 1, "id", 10).count() == 0
    roles = subsets.split_roles(df, "id", 0.2, 11, 3).collect()
    assert sum(r.kmeans for r in roles) == 11 and all(r.role == "train" for r in roles if r.kmeans) and 8 <= sum(r.role == "validation" for r in roles) <= 45


def test_ranks_do_not_depend_on_exchange_reuse(spark):
    df = spark.range(30_000).select(F.concat(F.lit("k"), (F.col("id") * 7919 % 30_000).cast("string")).alias("k")).repartition(9)
    before = spark.conf.get("spark.sql.exchange.reuse", "true")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = querystats.dense_ids(df, ["k"], "i").orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)
    assert [r.i for r in got] == list(range(30_000)) and [r.k for r in got] == sorted(f"k{i}" for i in range(30_000))
    some = spark.createDataFrame([(float(i * 37 % 101) if i % 9 else 5.0, i) for i in range(500)], "s double, i long")
    every = sorted((r.s, r.i) for r in some.collect())
    for m in (1, 2, 250, 499, 500):
        assert tuple(sampling.nth_smallest(some, F.struct("s", "i"), 500, m)) == every[m - 1]
    assert sampling.nth_smallest(some, F.struct("s", "i"), 500, 501) is None


def test_encoders_and_jobs(spark):
    e = assets.hashing_encoder(12)
    df = spark.createDataFrame([(1, "some text"), (2, ""), (3, None), (4, "漢字")], "id long, t string")
    got = {r.id: r.vector for r in assets.encoded(df, "id", "t", e, 2).collect()}
    for i, t in ((1, "some text"), (2, ""), (3, ""), (4, "漢字")):
        assert np.allclose(got[i], e([t])[0])
    assert assets.FeatureJob("2024-01-01", "2024-01-02", 4).partitions == 4
    for bad in (("2024-01-02", "2024-01-01", 1), ("2024-01-01", "2024-01-02", 0), ("x", "2024-01-02", 1), ("2024-01-01", "2024-01-02", 1, 0)):
        with pytest.raises(ValueError):
            assets.FeatureJob(*bad)
    anchors = quantizers.reference_points(spark.createDataFrame([(116 + 0.1 * (i % 4), 39 + 0.1 * (i // 4 % 3)) for i in range(48)], "lng double, lat double"), 6)
    assert len(anchors) == 6 and anchors == sorted(anchors) and all(115.9 < x < 116.4 and 38.9 < y < 39.3 for x, y in anchors)


def test_gates_and_streaks_on_small_runs(spark):
    rows = [("raw", "overall", 0.5, 0.1), ("adapted", "overall", 0.5, 0.2), ("raw", "hard", 0.3, 0.0), ("adapted", "hard", 0.2, 0.5)]
    df = spark.createDataFrame(rows, "run string, subset string, recall_at_10 double, mean_hard_margin double")
    assert evaluation.gate(df).collect()[0].asDict() == {"gate_passes": False, "identity_fallback": False}
    same = df.withColumn("recall_at_10", F.lit(0.5)).withColumn("mean_hard_margin", F.lit(0.1))
    assert evaluation.gate(same).collect()[0].asDict() == {"gate_passes": False, "identity_fallback": True}
    trace = spark.createDataFrame([(i, v) for i, v in enumerate([None, -1.0, -1.0, -1.0, 0.5, -1.0, -1.0], 1)], "i int, g double")
    assert [r.streak for r in evaluation.increase_streak(trace, "i", "g", 2, 0.1).orderBy("i").collect()] == [0, 0, 1, 2, 0, 1, 2]


def test_lookups_on_nulls_and_empty_tables(spark):
    paths = spark.createDataFrame([([1, 5, 2],), ([1, 6, 7, 2],)], "p array<int>")
    kids = lookups.prefix_children(paths, "p", 3)
    asked = spark.createDataFrame([(0, []), (1, [1]), (2, [1, 6]), (3, [1, 5, 2]), (4, [1, 5, 2, 3, 3]), (5, [9]), (6, [1, 3])], "i long, t array<int>")
    got = {r.i: r.allowed for r in lookups.allowed_next(asked, "t", kids, 3).collect()}
    assert got == {0: [1], 1: [5, 6], 2: [7], 3: [3], 4: [3], 5: None, 6: None}
    rows = spark.createDataFrame([(1, "a <P>x</P> b <P>y</P>"), (2, "none"), (3, "<P>z</P>"), (4, None)], "k long, t string")
    done = lookups.rewritten(rows, "k", "t", "<P>([a-z])</P>", spark.createDataFrame([("x", "X$1"), ("y", "Y")], "old string, new string"))
    assert {r.k: r.t for r in done.collect()} == {1: "a <P>X$1</P> b <P>Y</P>", 2: "none", 3: None, 4: None}
    none = spark.createDataFrame([], "vec_id long, s1 int, s2 int, s3 int")
    assert lookups.bucket_bounds(none, ["s1", "s2"], ["s1", "s2"]).count() == 0 and builders.identifier_table(none, "vec_id", ["s1", "s2", "s3"], "optional").count() == 0
    assert resolution.staged(spark.createDataFrame([], "s1 int, g string, p string"), ["s1"], "g", "p", 2, 3).count() == 0
    with pytest.raises(ValueError):
        builders.identifier_table(none, "vec_id", ["s1"], "other")


def test_identifier_methods_are_registered():
    assert set(method_names()) == set(METHODS) and all(m.kind in ("collision", "optional", "dedup", "paired") for m in METHODS.values())
    assert math.isclose(sum(1 for m in METHODS.values() if m.template), len(METHODS))
