"""Operators without a SQL twin, and the edges of those with one."""

import difflib
import hashlib
import itertools
import math
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnflow.functions import geo, hashing, text, tokens
from cairnflow.functions import vector as V
from cairnflow.operators import catalog, identifiers, messages, metrics, negatives, querystats, sampling, solvers, supervision, vectors
from cairnflow.plans.registry import QUERIES
from cairnflow.sources import io


def bisected(lng, lat, length=6):
    x, y, out, bits = [-180.0, 180.0], [-90.0, 90.0], "", 0
    for i in range(5 * length):
        box, v = (x, lng) if i % 2 == 0 else (y, lat)
        mid = (box[0] + box[1]) / 2
        bits = bits * 2 + (v >= mid)
        box[0 if v >= mid else 1] = mid
        if i % 5 == 4:
            out, bits = out + geo.GEOHASH[bits], 0
    return out


def test_geohash_and_codes(spark):
    r = np.random.default_rng(0)
    rows = [(float(a), float(b)) for a, b in zip(r.uniform(-180, 180, 300), r.uniform(-90, 90, 300), strict=True)] + [(-180.0, -90.0), (180.0, 90.0), (0.0, 0.0), (116.4074, 39.9042), (45.0, -45.0)]
    df = spark.createDataFrame(rows, "lng double, lat double")
    t = geo.geohash_tokens(F.col("lng"), F.col("lat"))
    cx, cy = geo.cell_center(t)
    got = df.select(
        "lng",
        "lat",
        geo.tokens_to_geohash(t).alias("g"),
        (geo.geohash_to_tokens(geo.tokens_to_geohash(t)) == t).alias("same"),
        geo.plus_code6(F.col("lng"), F.col("lat")).alias("p"),
        cx.alias("cx"),
        cy.alias("cy"),
    ).collect()
    for x in got:
        assert x.g == bisected(x.lng, x.lat) and x.same
        assert abs(x.cx - x.lng) <= 180 / 2**15 + 1e-9 and abs(x.cy - x.lat) <= 90 / 2**15 + 1e-9
        assert len(x.p) == 9 and x.p.endswith("00+")
    assert {x.p for x in got if x.lng == 116.4074} == {"8PFRWC00+"}
    assert spark.createDataFrame([(200.0, 0.0)], "lng double, lat double").select(geo.plus_code6(F.col("lng"), F.col("lat"))).first()[0] is None


def test_hashes_equal_hashlib(spark):
    ids = [(str(i),) for i in range(50)]
    got = spark.createDataFrame(ids, "u string").select(
        "u",
        hashing.sha_bucket(F.col("u"), 2000).alias("s"),
        hashing.blake_bucket(256, b"query")("u").alias("b"),
        hashing.blake_bucket(2000, order="little")("u").alias("l"),
    ).collect()
    for x in got:
        u = x.u.encode()
        assert x.s == int(hashlib.sha256(u).hexdigest(), 16) % 2000
        assert x.b == int.from_bytes(hashlib.blake2b(u, digest_size=8, person=b"query").digest(), "big") % 256
        assert x.l == int.from_bytes(hashlib.blake2b(u, digest_size=8).digest(), "little") % 2000


def test_text_functions(spark):
    t = "Ａb，c…  Ｄ－e１"
    c = F.col("t")
    got = spark.createDataFrame([(t,), (None,), ("",)], "t string").select(
        text.conservative(c),
        text.compact(c),
        text.letters_only(c),
        text.relation_text(c),
        text.folded(c),
        text.identity(c),
    ).collect()
    n = unicodedata.normalize("NFKC", t)
    assert got[0][0].startswith("ab,c...") and got[0][1] == "".join(n.lower().split())
    assert got[0][2] == "".join(x for x in n if x.isalnum()).lower() and " " not in got[0][3]
    assert got[1][0] is None and got[1][2] == "" and got[2][0] is None
    assert [text.parse_integer(x) for x in ("12", "一二", "十二", "二十", "三百零五", "一万二千", "x", "")] == [12, 12, 12, 20, 305, 12000, None, None]
    assert [text.parse_integer(x) for x in ("万", "百", "１２", " 二 十 ", "一二百", "十万零五", "一万二万", None)] == [10000, 100, 12, 20, 200, 100005, 30000, None]
    assert [r.q for r in spark.createDataFrame([("Ａ—B–c－d…、x",)], "t string").select(text.conservative(c).alias("q")).collect()] == ["a-b-c-d...,x"]
    same = spark.createDataFrame([("ab" * 135, "ba" * 130 + "zz", ["ab" * 135]), ("", "x", ["y"])], "a string, b string, c array<string>")
    got = same.select(text.tiered_similarity(F.col("a"), F.col("b")).alias("s"), text.lexical_relevance(F.col("a"), F.col("b"), F.col("c"), F.lit(""), F.lit("")).alias("l")).collect()
    assert got[0].s == pytest.approx(difflib.SequenceMatcher(None, "ab" * 135, "ba" * 130 + "zz", autojunk=False).ratio()) and got[0].l == 1.0 and got[1].s == got[1].l == 0.0


def test_blocks_of_hard_neighbours_and_forbidden_pairs(spark):
    r = np.random.default_rng(8)
    m = r.normal(size=(60, 5))
    rows = [(i, i % 2, i % 3, m[i].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "row long, b int, p int, v array<double>")

    def score(a, c):
        x, y = (np.stack(f["v"].to_numpy()) for f in (a, c))
        return x @ y.T

    got = {(x.row, x.neighbor, x["rank"]) for size in (7, 1000) for x in negatives.hard_graph(df, ["b"], score, 0.2, 3, protect=("p",), block_rows=size).collect()}
    s = m @ m.T
    want = set()
    for i in range(60):
        near = sorted(((-s[i, j], j) for j in range(60) if j != i and j % 2 == i % 2 and j % 3 != i % 3 and s[i, j] >= 0.2))[:3]
        want |= {(i, j, k + 1) for k, (_, j) in enumerate(near)}
    assert got == want
    base = spark.createDataFrame([(i, m[i].tolist()) for i in range(60)], "vec_id long, embedding array<double>")
    gone = spark.createDataFrame([(i, j) for i in range(5) for j in range(0, 60, 2)], "query_id long, id long")
    found = vectors.knn(base, base.where("vec_id < 5"), 4, forbidden=gone).collect()
    for i in range(5):
        mine = [x.id for x in sorted(found, key=lambda x: x["rank"]) if x.query_id == i]
        assert mine == sorted((j for j in range(1, 60, 2)), key=lambda j: (-s[i, j], j))[:4]


def test_lexical_and_geographic_neighbours_equal_all_pairs(spark):
    r = np.random.default_rng(9)
    names = ["".join(r.choice(list("abcd"), int(r.integers(0, 7)))) for _ in range(80)]
    rows = [(i, names[i], names[-i] or None, "xyz"[i % 3], "pq"[i % 2] if i % 5 else None, float(r.normal(116, 0.3)), float(r.normal(40, 0.2))) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, name string, address string, code string, category string, lng double, lat double")
    gone = spark.createDataFrame([(1, 2), (1, 3), (4, 79)], "target long, candidate long")
    grams = lambda t: {t[k : k + 2] for k in range(max(1, len(t) - 1))} if t else set()
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    for size in (3, 1000):
        got = {(x.target, x.candidate, x["rank"]) for x in negatives.lexical_topk(df.where("id < 9"), df.repartition(5), 6, gone, size).collect()}
        want = set()
        for i, n, a, c, g, *_ in rows[:9]:
            scored = []
            for j, n2, a2, c2, g2, *_ in rows:
                key = (jac(grams(n), grams(n2)), int(c == c2), int(g is not None and g == g2), jac(grams(a or ""), grams(a2 or "")))
                if i != j and any(key) and (i, j) not in {(1, 2), (1, 3), (4, 79)}:
                    scored.append((*(-x for x in key), j))
            want |= {(i, x[-1], k + 1) for k, x in enumerate(sorted(scored)[:6])}
        assert got == want
    def metres(a, b):
        h = math.sin(math.radians(b[6] - a[6]) / 2) ** 2 + math.cos(math.radians(a[6])) * math.cos(math.radians(b[6])) * math.sin(math.radians(b[5] - a[5]) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(h))
    for same in ((), ("code", "category")):
        got = {(x.id, x.other, x["rank"]) for x in negatives.geo_topk(df, 4, same).collect()}
        want = set()
        for a in rows:
            key = lambda b: (*((-int(a[k] is not None and a[k] == b[k])) for k in ((3, 4) if same else ())), metres(a, b), b[0])  # noqa: E731, B023
            want |= {(a[0], b[0], k + 1) for k, b in enumerate(sorted((b for b in rows if b[0] != a[0]), key=key)[:4])}
        assert got == want
    pairs = spark.createDataFrame([("ab", "ab"), ("ab", "xabx"), ("abcd", "bc"), ("abc", "abd"), ("", "a")], "q string, t string")
    assert [round(r[0], 4) for r in pairs.select(text.tiered_similarity(F.col("q"), F.col("t"))).collect()] == [1.0, 0.95, 0.925, 0.6667, 0.0]


def test_lexical_candidates_meet_by_content(spark, monkeypatch):
    contents = [("large ring", "b1"), ("large ring", "b2"), ("hot bolt", "b1"), ("hot bolts", None), ("zz", "b3"), (None, "b2")]
    rows = [(i, *contents[i * i % 7 % 6]) for i in range(240)] + [(7, "hot bolt", "b2"), (7, "hot bolt", "b2"), (7, "zz", "b3"), (None, "large ring", "b1")]
    df = spark.createDataFrame(rows, "id long, name string, code string")
    asks = df.where("id % 5 < 4 or id is null")
    gone = [(i, j) for i in (0, 7, 14, 77) for j in range(0, 200, i % 3 + 1)]
    seen = []
    monkeypatch.setattr(negatives, "blocks", lambda frame, size, f=negatives.blocks: (b for b in f(frame, size) if seen.append(len(b)) is None))
    found = negatives.lexical_topk(asks, df.repartition(5), 4, spark.createDataFrame(gone, "target long, candidate long"), 2).collect()
    assert sum(seen) <= len(contents) + 1  # not one for every target
    grams = lambda t: {t[k : k + 2] for k in range(len(t) - 1)} if t else set()
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    sets = [(i, grams((n or "").replace(" ", "")), c) for i, n, c in rows if i is not None]
    banned = set(gone)
    want = {}
    for i, g, c in (x for x in sets if x[0] % 5 < 4):
        for j, h, d in sets:
            key = (-jac(g, h), -int(c is not None and c == d), j)
            if i != j and key[:2] != (0, 0) and (i, j) not in banned:
                want.setdefault(i, []).append(key)
    got = {}
    for x in sorted(found, key=lambda x: (x.target, x["rank"])):
        got.setdefault(x.target, []).append((-x.name_score, -x.same_code, x.candidate))
        assert x["rank"] == len(got[x.target])
    assert got == {i: sorted(v)[:4] for i, v in want.items()}


def test_lexical_negatives_answer_for_every_part(spark, tmp_path):
    words = ["large ring", "hot bolt", "Hot bolts", "blue plate", "tin can"]
    rows = [(3 * i + 1, words[i % 5], f"b{i % 4}", "abba cde"[i % 3 :]) for i in range(90)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    grams = lambda t: {t[k : k + 2] for k in range(len(t) - 1)}
    sets = [(i, grams(f"{n}{t}".replace(" ", "").lower()), b) for i, n, b, t in rows]
    want = set()
    for i, g, b in sets:
        scored = sorted((-len(g & h) / len(g | h), -int(b == c), j) for j, h, c in sets if i != j and (g & h or b == c))
        want |= {(i, j, round(-s, 9), -c, k + 1) for k, (s, c, j) in enumerate(scored[:10])}
    got = QUERIES["lexical_negatives"](spark, str(tmp_path)).collect()
    assert {x.target for x in got} == {i for i, *_ in rows}
    assert len(got) == len(want) and {(x.target, x.candidate, x.name_score, x.same_code, x["rank"]) for x in got} == want


def test_tokens(spark):
    df = spark.createDataFrame([(0,), (1023,), (1024,), (1024**2 + 5,)], "v long")
    got = df.select(tokens.token_cost(F.col("v")), tokens.digits1024(F.col("v"))).collect()
    assert [(r[0], r[1]) for r in got] == [(2, [0]), (2, [1023]), (3, [1, 0]), (4, [1, 0, 5])]
    a = spark.createDataFrame([([1, 2, 3], [1, 2, 4]), ([1], [2]), ([], [1])], "a array<int>, b array<int>")
    assert [r[0] for r in a.select(tokens.common_prefix(F.col("a"), F.col("b"))).collect()] == [2, 0, 0]


def test_fusion_can_be_undone(spark):
    r = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x)
    rows = [(unit(r.normal(size=6)).tolist(), unit(r.normal(size=6)).tolist()) for _ in range(20)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>").withColumn("m", V.fused(F.col("a"), F.col("b"), 0.6))
    for x in df.select("b", V.recovered(F.col("a"), F.col("m"), 0.6).alias("back")).collect():
        assert np.allclose(x.b, x.back, atol=1e-6)


def test_knn_blocks_agree_with_numpy(spark):
    r = np.random.default_rng(2)
    m = r.normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>").repartition(3)
    got = {(x.query_id, x["rank"]): x.id for x in vectors.knn(df, df.where("vec_id < 7"), 4, block_rows=3).collect()}
    s = m @ m.T
    want = {(q, k + 1): i for q in range(7) for k, i in enumerate(sorted(range(60), key=lambda i: (-s[q, i], i))[:4])}
    assert got == want
    assert vectors.knn(df, df.limit(0), 4).count() == 0


def test_spherical_codebook_improves(spark):
    r = np.random.default_rng(3)
    m = np.concatenate([r.normal(c, 0.1, (30, 4)) for c in np.eye(4)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    score = [vectors.assign(df, vectors.fit_spherical(df, 4, iterations=n)).agg(F.avg("score")).first()[0] for n in (1, 8)]
    assert score[1] >= score[0] - 1e-9
    out = vectors.residual_codes(df, 2, 4)
    assert out.columns == ["vec_id", "s1", "s2"] and out.count() == 120
    soft = vectors.soft_update(df, [(i, e.tolist()) for i, e in enumerate(np.eye(4))], "embedding", "vec_id", 2, 4.0)
    assert soft.agg(F.sum("mass")).first()[0] == pytest.approx(120)


def test_assignment_is_cheapest():
    r = np.random.default_rng(4)
    for _ in range(60):
        n = int(r.integers(1, 5))
        c = r.random((n, int(r.integers(n, 7))))
        got = solvers.hungarian(c)
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(c.shape[1]), n))
        assert len(set(got)) == n and sum(c[i, got[i]] for i in range(n)) == pytest.approx(best)


def test_codes_of_buckets_with_more_rows_than_prototypes(spark):
    r = np.random.default_rng(5)
    prototypes = r.normal(size=(3, 2))
    x = {(b, i): r.normal(size=2) for b, n in (("one", 1), ("few", 3), ("full", 6), ("many", 7)) for i in range(n)}
    df = spark.createDataFrame([(b, i, v.tolist()) for (b, i), v in x.items()], "b string, id long, v array<double>")
    got = {}
    for y in solvers.unique_pairs(df.repartition(3), "b", "id", "v", prototypes.tolist()).collect():
        got.setdefault(y.b, {})[y.id] = y.code
        assert y.cost == pytest.approx(((x[y.b, y.id] - prototypes[y.code % 3]) ** 2).sum())
    for b, codes in got.items():
        n = sum(k[0] == b for k in x)
        most = -(-n // 3)
        d = np.array([((x[b, i] - prototypes) ** 2).sum(1) for i in range(n)])
        best = min(sum(d[range(n), q]) for q in itertools.product(range(3), repeat=n) if max(q.count(c) for c in q) <= most)
        assert sorted(codes) == list(range(n)) and len(set(codes.values())) == n and max(codes.values()) < 3 * most
        assert sum(d[i, c % 3] for i, c in codes.items()) == pytest.approx(best)
    for n, m in ((40, 3), (60, 7), (30, 30)):  # a full column may have to pass on rows by way of others; equal rows
        cost = r.random((n, m))
        cost[n // 2 :] = cost[: n - n // 2]
        taken = solvers.hungarian(cost, -(-n // m))
        wide = solvers.hungarian(np.tile(cost, (1, -(-n // m))))
        assert max(np.bincount(taken)) <= -(-n // m) and cost[range(n), taken].sum() == pytest.approx(cost[range(n), np.array(wide) % m].sum())
    with pytest.raises(ValueError):
        solvers.hungarian(np.ones((5, 2)), 2)


def test_bucket_solvers(spark):
    rows = [(b, i, i % 2, i // 2 % 3 - 1, i % 5, 1.0) for b in ("x", "y") for i in range(8)]
    df = spark.createDataFrame(rows, "b string, id long, r1 int, r2 int, r3 int, w double")
    got = solvers.compile_buckets(df, "b", "id", ["r1", "r2", "r3"], "w").collect()
    by = {}
    for x in got:
        by.setdefault((x.b, x.path), []).append(x)
    assert len(got) == 16 and all(x.resolved == (len(v) == 1) for v in by.values() for x in v)
    short = solvers.shortest_descriptions(df, "b", "id", ["r1", "r2", "r3"]).collect()
    named = [(x.b, x.description) for x in short if x.description]
    assert len(named) == len(set(named)) > 0


def test_dense_ids_and_splits(spark):
    df = spark.createDataFrame([(f"k{i % 37:02d}",) for i in range(500)], "k string")
    got = {r.k: r.i for r in querystats.dense_ids(df, ["k"], "i").collect()}
    assert got == {f"k{i:02d}": i for i in range(37)}
    n = spark.range(23).select(F.col("id"), sampling.contiguous(F.col("id"), 23, 7).alias("p")).collect()
    assert all(23 * r.p // 7 <= r.id < 23 * (r.p + 1) // 7 for r in n)


def test_profile_of_a_known_query(spark):
    log = spark.createDataFrame([("q", "b", "Q")] * 6 + [("q", "a", "q")] * 2 + [("z", "c", "z")], "query string, poi string, raw string")
    got = {r.query: r for r in querystats.query_profile(querystats.pair_counts(log)).collect()}
    q = got["q"]
    assert (q.query_count, q.top1_poi_id, q.top1_share, q.top2_share, q.margin) == (8, "b", 0.75, 0.25, 0.5)
    h = -(0.75 * math.log(0.75) + 0.25 * math.log(0.25))
    assert q.entropy == pytest.approx(h) and q.normalized_entropy == pytest.approx(h / math.log(2))
    assert not q.is_high_confidence and q.sid_weight == 0.0
    assert got["z"].normalized_entropy == 0.0 and got["z"].query_count == 1
    assert supervision.support(F.lit(20)) is not None


def test_history_rules(spark):
    df = spark.sql("SELECT timestamp'2024-01-05 10:00:00' AS now, array(named_struct('event_time', timestamp'2024-01-04 10:00:00', 'query', 'a', 'poi', 'p'), named_struct('event_time', timestamp'2024-01-05 10:00:00', 'query', 'b', 'poi', '')) AS h")
    faults = messages.history_faults(F.col("h"), F.lit(3), F.col("now"), F.lit("2024-01-05").cast("date"), F.lit("2024-02-01").cast("date"), 1)
    assert df.select(faults).first()[0] == ["length", "too_long", "outside_window", "not_before_current", "missing_id"]
    p = messages.prompt(F.lit("coffee"), F.lit("wx4"), F.col("h"))
    q, g = messages.current_fields(p)
    assert tuple(df.select(q, g, messages.confined(p, F.lit("<POI>p")), messages.confined(p, F.lit("coffee"))).first()) == ("coffee", "wx4", True, False)


def test_history_is_whole_where_many_events_share_a_time(spark):
    rows = [(i, u, t, f"q{i}", f"p{i}") for i, (u, t) in enumerate([(1, 1)] * 2 + [(1, 2)] * 2 + [(1, 3)] * 60 + [(1, 4)] * 30 + [(2, 1), (2, None), (2, 5)])]
    events = spark.createDataFrame(rows, "id long, u long, t long, query string, poi string").withColumn("t", F.timestamp_seconds("t"))
    got = {r.id: [e.poi for e in r.history] for r in messages.collect_history(events, "u", "t", "id", 5).collect()}
    for i, u, t, *_ in rows:
        want = sorted((x[2], x[0]) for x in rows if x[1] == u and x[2] is not None and t is not None and x[2] < t)
        assert got[i] == [f"p{k}" for _, k in want[-5:]], i
    assert len(got) == len(rows)


def test_beam_and_merge(spark):
    df = spark.createDataFrame(
        [([1, 2, 3], [[[1], [9]], [[1, 2]], [[7, 7, 7]]], 5), ([1, 2, 3], [[[1]], [[1, 2]], [[1, 2, 3]]], 1)],
        "gold array<int>, steps array<array<array<int>>>, r int",
    )
    first, state = metrics.beam_state("gold", "steps", [2, 3], "r")
    assert [tuple(r) for r in df.select(first, state).collect()] == [(3, "pruned_at_3"), (None, "hit@1")]
    f = lambda rows: spark.createDataFrame(rows, "row long, candidate long, rank int")
    out = negatives.merge_sources([("a", f([(1, 5, 1), (1, 6, 2)]), 1), ("b", f([(1, 6, 1), (1, 5, 2), (1, 7, 3)]), 5)])
    assert sorted((r.candidate, r.source, r.position) for r in out.collect()) == [(5, "a", 1), (7, "b", 1)]


def test_catalog_faults_and_prefix_tables(spark):
    cat = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    act = spark.createDataFrame([(1,), (3,)], "id long")
    kept, faults = catalog.filter_catalog(cat, act, "id")
    assert kept.count() == 2 and sorted(tuple(r) for r in faults.collect()) == [(1, "duplicate"), (3, "missing")]
    t = identifiers.prefix_table(spark.createDataFrame([([1, 2],), ([1, 3],)], "p array<int>"), "p")
    assert {(r.depth, tuple(r.prefix), r.next_token, r.rows) for r in t.collect()} == {(0, (), 1, 2), (1, (1,), 2, 1), (1, (1,), 3, 1), (2, (1, 2), None, 1), (2, (1, 3), None, 1)}


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("p1", "n", None, "a", "c", "01", 1.0, 2.0, "t")], io.ENTITY_SCHEMA)
    io.write_jsonl(rows, f"{tmp_path}/j")
    back = io.read_json(spark, f"{tmp_path}/j", io.ENTITY_SCHEMA)
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in rows.collect()]
    assert io.manifest(back).first() == io.manifest(rows).first()
    numbered = io.with_row_index(io.read_lines(spark, f"{tmp_path}/j"))
    assert [r.row_index for r in numbered.collect()] == [0]
    io.write_parquet(rows, f"{tmp_path}/p", "poi_id", 2)
    assert spark.read.parquet(f"{tmp_path}/p").count() == 1
    with pytest.raises(FileNotFoundError):
        io.read_json(spark, str(tmp_path), io.ENTITY_SCHEMA)
    good, bad = io.quarantine(rows, catalog.contract({"lat": F.col("lat") > 5}))
    assert good.count() == 0 and bad.first().faults == ["lat"]


def test_streams_equal_batches(spark, tmp_path):
    from cairnflow.streaming import log

    events = spark.sql("SELECT id, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 7) AS ts, concat('q', id % 3) AS query, concat('p', id % 2) AS poi FROM range(60)")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = log.windowed_popularity(stream, "ts", "query").writeStream.format("memory").queryName("popular").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM popular").first()[0] == 60
    q = stream.writeStream.foreachBatch(log.append_pairs(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.sum("n")).first()[0] == 60
