"""Edges that every training-data operator defines: nulls, repeats, empty tables, very long texts, clashing columns; and layouts,
structures and recall that one fixture does not show."""

import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairnflow.llm import decontam, html_extract, licenses, mixing, neardup, pii, quality, secrets, sharding, toxicity
from cairnflow.llm.common import set_aside

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(21)
WORDS = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randrange(2, 8))) for _ in range(500)]
CLASHES = ("__lang", "__n_words", "__size", "__s", "__shard", "__gone", "__hits", "col0", "row", "h1", "c", "Doc", "k0", "in0")


def prose(n, r=R):
    return " ".join(r.choice(WORDS) for _ in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def clashing(docs):
    """docs with columns that are named as operators might name their own."""
    for c in CLASHES:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return docs


def untouched(out, docs):
    assert out.columns == docs.columns
    for r in out.collect():
        for c in CLASHES:
            assert r[c] == f"{c}-{'null' if r['doc_id'] is None else r['doc_id']}"


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated ids and rows, null and empty texts, one very long text."""
    long = prose(60_000)
    rows = [(i, prose(80), "en", "ab"[i % 2], 0) for i in range(60)]
    rows += [
        (None, rows[0][1], "en", "a", 0),
        (None, prose(90), "en", "a", 0),
        (None, prose(90), None, None, None),
        (None, None, None, None, None),
        (7, "", "en", "a", 0),
        (8, " \n", "xx", "b", 0),
    ]
    rows += [rows[3], rows[3], (3, prose(70), "en", "a", 0), (500, long, "en", "a", 0), (501, long, "en", "a", 0)]
    return docs_of(spark, rows)


def test_columns_of_any_name_pass_through(spark, odd):
    docs = clashing(odd)
    bench = spark.createDataFrame([(1, prose(12))], "item_id long, text string")
    untouched(quality.filter_documents(docs), docs)
    untouched(neardup.deduplicate(docs), docs)
    untouched(decontam.decontaminate(docs, bench), docs)
    untouched(mixing.apply_mix(docs), docs)
    shards = sharding.with_shard(docs)
    assert shards.columns == [*docs.columns, "shard", "virtual_slot", "map_version"]
    untouched(shards.select(docs.columns), docs)
    twice, back = set_aside(docs.select("text", F.col("doc_id").alias("TEXT2")), "text")
    assert back(twice).columns == ["text", "TEXT2"]


def test_operators_take_empty_tables(spark, odd):
    none = odd.limit(0)
    bench, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    made = [
        html_extract.main_text(pages),
        toxicity.toxicity(none, labels),
        quality.quality(none),
        secrets.scan_digest(none),
        licenses.scan(none),
        decontam.report(none, bench),
        pii.scan_digest(none),
        mixing.mix(none),
        neardup.near_duplicates(none),
        sharding.shard_documents(none),
    ]
    assert [df.count() for df in made] == [0] * len(made)
    assert decontam.report(odd, bench).where("contaminated").count() == 0


def test_repeated_rows_and_long_texts_have_results_each(spark, odd):
    n = odd.count()
    secret = docs_of(spark, [(1, "x" * 300_000 + " password: hunter2hunter2 a@b.co", "en", "s", 0)] * 3 + [(2, None, None, None, None)])
    for module, column in ((secrets, "n_assign"), (pii, "n_email")):
        got = module.scan_digest(clashing(secret)).collect()
        assert sorted(r[column] for r in got) == [0, 1, 1, 1] and len({r.spans for r in got}) == 2
    mit = licenses.MIT
    got = licenses.scan(clashing(docs_of(
        spark,
        [(1, mit, "en", "s", 0)] * 2 + [(2, mit + prose(60_000), "en", "s", 0), (3, "The MIT License (MIT)\n\n" + mit.partition("\n\n")[2], "en", "s", 0)],
    ))).collect()
    assert sorted((r.doc_id, r.license_id or "") for r in got) == [(1, "MIT"), (1, "MIT"), (2, ""), (3, "MIT")]
    table = spark.createDataFrame([("Own-1.0", "All of it may be used"), ("Own-0.9", "ALL of it, may be used."), (None, None)], "license_id string, text string")
    got = licenses.scan(docs_of(spark, [(1, "all of it MAY be used!", "en", "s", 0), (2, "no", "en", "s", 0)]), table).collect()
    assert {r.doc_id: r.license_id for r in got} == {1: "Own-0.9", 2: None}
    assert neardup.near_duplicates(odd).count() == quality.quality(odd).count() == mixing.mix(odd).count() == sharding.shard_documents(odd).count() == n
    near = [r for r in neardup.near_duplicates(odd).collect() if r.doc_id in (500, 501)]
    assert {r.component_id for r in near} == {500} and sorted(r.kept for r in near) == [False, True]


def test_rows_without_an_id_spread_over_shards(spark):
    rows = [(None, prose(20 + i % 50), "en", "a", 0) for i in range(800)]
    got = sharding.shard_documents(docs_of(spark, rows)).collect()
    load = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(load) - min(load) <= max(r.size for r in got)
    one = sharding.shard_documents(docs_of(spark, [(5, "same", "en", "a", 0)] * 300)).collect()
    assert sorted(r.slot for r in one) == list(range(300)) and len({r.shard for r in one}) == 1


def test_mix_takes_rows_without_id_or_source(spark, odd):
    got = mixing.mix(clashing(odd)).collect()
    size = sum(r.size for r in got)
    assert abs(sum(r.taken for r in got) - sum({r.source: r.target for r in got}.values())) <= 4 * max(r.size for r in got) and size > 0
    many = docs_of(spark, [(i, prose(5 + i % 7), "en", f"host{i % 400}", 0) for i in range(1200)])
    per = {}
    for r in mixing.mix(many).collect():
        per.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.taken
    assert len(per) == 400 and sum(t for t, _, _ in per.values()) == pytest.approx(1.5 * sum(n for _, _, n in per.values()))
    assert all(t <= 2 * n + 1e-6 and abs(t - k) <= 12 for t, k, n in per.values())


def test_tokens_and_wrapped_keys_do_not_depend_on_the_rest():
    token = "eyJhbGciOiJub25lIn0.eyJhIjoxfQ."
    assert [k for _, _, k in secrets.find(token)] == [k for _, _, k in secrets.find(token + " " + "z" * 40)] == ["jwt"]
    import base64
    import struct

    body = b"".join(struct.pack(">I", len(x)) + x for x in (b"ssh-ed25519", bytes(range(32))))
    text = base64.b64encode(body).decode()
    pem = "-----BEGIN SSH KEY-----\n" + "\n".join(text[i : i + 20] for i in range(0, len(text), 20)) + "\n-----END SSH KEY-----"
    assert ("ssh" in [k for _, _, k in secrets.find(pem)]) and ("ssh" in [k for _, _, k in secrets.find("y" * 50 + "\n" + pem)])


LAYOUTS = {
    # no article or main, and no telling names: density alone
    "plain blocks": (
        "<body><div id=a><ul><li><a href=1>Home</a><li><a href=2>World</a><li><a href=3>Sport</a></ul></div><div id=b><div><h2>{t}</h2><p>{p}</p><p>{q}</p></div>"
        "<div><a href=4>More one</a> <a href=5>More two</a> <a href=6>More three</a></div></div><div id=f>Imprint <a href=7>Terms</a></div></body>"
    ),
    "tables": "<body><table><tr><td><a href=1>One</a><br><a href=2>Two</a><td><h2>{t}</h2><p>{p}<p>{q}</table><p><a href=3>Back</a></p></body>",
    # the wrapper's name speaks of a sidebar but it is the page
    "named frame": "<body><div class='layout right-sidebar'><h1>{t}</h1><p>{p}</p><p>{q}</p><div class='comments'><p>Nice words of a reader, who goes on for a while here.</p></div></div></body>",
    "search page": "<body><div id=search-page><p>{t}</p><p>{p}</p><p>{q}</p></div></body>",
    "notice longer than nothing": "<body><div class=cookie>We would like to use cookies on this page.</div><main><h1>{t}</h1><p>{p}</p><p>{q}</p></main></body>",
}


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_density_finds_the_article_in_other_layouts(layout):
    r = random.Random(layout)
    for _ in range(10):
        t, p, q = prose(5, r), prose(60, r), prose(45, r)
        assert html_extract.extract(LAYOUTS[layout].format(t=t, p=p, q=q)) == f"{t} {p} {q}"


def test_densities_equal_direct_sums():
    """Characters a tag, less for links, and sums over blocks below, by plain recursion."""
    page = "<body><div><p>one two <a href=x>three</a></p><p>four <b>five</b></p><ul><li><a href=y>six</a><li>seven</ul></div><div>eight <span><p>nine</p></span></div></body>"
    root = html_extract.parse(page)
    scope = html_extract.find(root, "body")[0]
    html_extract.measure(scope)
    html_extract.weigh(scope)

    def plain(node, linked=False):
        linked = linked or node.tag == "a"
        c = lc = t = lt = 0
        for k in node.kids:
            if isinstance(k, str):
                n = len("".join(k.split()))
                c, lc = c + n, lc + n * linked
            else:
                a = plain(k, linked)
                c, lc, t, lt = c + a[0], lc + a[1], t + a[2] + (k.tag in html_extract.NODES or k.tag == "a"), lt + a[3] + (k.tag == "a")
        return c, lc, t, lt

    whole = plain(scope)
    ratio = whole[1] / whole[0]

    def density(node):
        c, lc, t, lt = plain(node)
        t, lt = max(1, t), max(1, lt)
        if not c:
            return 0.0
        base = math.log(math.log(c / max(1, c - lc) * lc + ratio * c + math.e) + math.e)
        return c / t * math.log(max(1.0, c * t / (max(1, lc) * lt))) / base

    def total(node):
        return sum(density(k) if k.tag in html_extract.NODES else total(k) for k in node.kids if not isinstance(k, str))

    todo = [scope]
    while todo:
        node = todo.pop()
        below = [k for k in node.kids if not isinstance(k, str)]
        assert node.density == pytest.approx(density(node)) and node.total == pytest.approx(total(node))
        todo += below
    # links count as nothing: a list of links is thinner than a paragraph of as many letters
    links = html_extract.parse("<body><p>" + "".join(f"<a href=x>{w}</a> " for w in WORDS[:20]) + "</p><p>" + " ".join(WORDS[:20]) + "</p></body>")
    scope = html_extract.find(links, "body")[0]
    html_extract.measure(scope)
    html_extract.weigh(scope)
    first, second = [k for k in scope.kids if not isinstance(k, str)]
    assert first.density < second.density / 5


def test_near_duplicates_recall_against_all_pairs(spark):
    """Every pair at or above the threshold among random edits ends in one class, whatever the bands drew."""
    r = random.Random(99)
    rows, i = [], 0
    for _ in range(60):
        base = prose(r.randrange(30, 200), r).split()
        for _ in range(4):
            w = list(base)
            for _ in range(r.randrange(0, max(1, len(w) // 18))):
                w[r.randrange(len(w))] = r.choice(WORDS)
            rows.append((i, " ".join(w), "en", "s", 0))
            i += 1
    want = neardup.brute((x[0], x[1]) for x in rows)
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {k: c for k, (_, c) in want.items()}
    assert 60 < len(set(got.values())) < 240


def test_decontamination_cuts_long_items(spark):
    r = random.Random(3)
    item = prose(500, r)
    docs = docs_of(spark, [(k, prose(20, r) + " " + " ".join(item.split()[a:b]) + " " + prose(20, r), "en", "s", 0) for k, (a, b) in enumerate([(0, 500), (90, 101), (95, 110), (300, 309), (491, 500)])])
    bench = spark.createDataFrame([(1, item), (2, prose(30, r)), (None, item)], "item_id long, text string")
    whole = sorted(map(str, decontam.report(docs, bench).collect()))
    assert sorted(map(str, decontam.report(docs, bench, part_words=40).collect())) == whole
    got = {x.doc_id: x.n_hit for x in decontam.report(docs, bench).collect()}
    assert got == {0: 500, 1: 11, 2: 15, 3: 0, 4: 0}


def pipeline_over(spark, tmp_path, docs, bench):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(tmp_path))


def test_pipeline_keeps_its_word_on_odd_rows(spark, odd, tmp_path):
    docs = clashing(odd)
    bench = spark.createDataFrame([(1, prose(12)), (None, None)], "item_id long, text string")
    out = pipeline_over(spark, tmp_path, docs, bench)
    assert out.columns == [*docs.columns, "shard", "virtual_slot", "map_version"]
    rows = out.collect()
    assert rows and all(r["__shard"] == f"__shard-{'null' if r.doc_id is None else r.doc_id}" for r in rows)
    texts = {}
    for r in rows:
        assert len(r.text.split()) >= 50
        texts.setdefault(r.text, set()).add(r.doc_id)
    assert all(len(ids) == 1 for ids in texts.values())  # copies went, with and without an id


def test_pipeline_takes_empty_tables(spark, odd, tmp_path):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert pipeline_over(spark, tmp_path / "a", odd.limit(0), bench).count() == 0
    assert pipeline_over(spark, tmp_path / "b", odd, bench).count() > 0
