"""Near duplicates, mixing, sharding, quality, licences, extraction, toxicity and the pipeline on small fixtures."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairnflow.llm import html_extract, licenses, mixing, neardup, quality, sharding, toxicity
from cairnflow.llm.common import WordHashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randrange(2, 8))) for _ in range(400)]


def words(n, r=R):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(text, share, r=R):
    return " ".join(r.choice(VOCABULARY) if r.random() < share else w for w in text.split())


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def near_rows():
    rows, base = [], words(120)
    rows += [edited(base, 0.03) for _ in range(40)] + [base] * 30  # a large group of near copies and of copies
    other = words(60)
    rows += [other, other.upper(), other + " tail", words(40) + " " + other]
    rows += [words(R.randrange(1, 30)) for _ in range(20)] + ["a b", "A  b", "a", "", None, " \n\t", "b a"]
    R.shuffle(rows)
    return [(1000 - 7 * i, t, "en", "s", 0) for i, t in enumerate(rows)]


def test_near_duplicates_equal_brute_force(spark, near_rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs_of(spark, near_rows)).collect()}
    want = neardup.brute((i, t) for i, t, *_ in near_rows)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}
    assert sum(c != i for i, (_, c) in want.items()) > 40


def test_blocks_of_a_bucket_find_what_one_block_finds(spark, near_rows, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 2000)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(spark, near_rows)).collect()}
    assert got == {i: c for i, (_, c) in neardup.brute((i, t) for i, t, *_ in near_rows).items()}


def test_near_duplicates_with_null_and_repeated_ids(spark):
    t = words(20)
    rows = [(None, t, "en", "s", 0), (1, t, "en", "s", 0), (1, t, "en", "s", 0), (None, words(9), "en", "s", 0), (2, None, None, None, None), (2, words(12), None, None, None)]
    docs = docs_of(spark, rows).withColumn("__gone", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == [(0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True), (2, 2, True), (2, 2, True)]
    kept = neardup.deduplicate(docs_of(spark, rows[1:3] + rows[5:]))
    assert kept.count() == 2
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_rows_without_an_id_or_with_a_shared_id_are_deduplicated_by_text(spark):
    t, u, v = words(60), words(60), words(60)
    chain = [t, t + " one two", t + " one two three four"]
    rows = [(None, chain[1], "en", "s", 0), (7, chain[0], "en", "s", 0), (8, chain[2], "en", "s", 0), (None, chain[0], "en", "s", 0)]
    rows += [(None, u, "en", "s", 0)] * 3 + [(None, u.upper(), "en", "s", 0), (None, u + " tail", "en", "s", 0)]
    rows += [(9, v, "en", "s", 0), (9, words(60), "en", "s", 0), (9, v, "en", "s", 0), (3, words(60), "en", "s", 0), (None, None, "en", "s", 0), (None, "", "en", "s", 0)]
    kept = [(r.doc_id, r.text) for r in neardup.deduplicate(docs_of(spark, rows)).collect()]
    assert Counter((i, (x or "").split(" tail")[0].lower()) for i, x in kept) == Counter([(7, t), (None, u), (9, v), (9, rows[10][1]), (3, rows[12][1]), (None, ""), (None, "")])
    got = [(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs_of(spark, rows)).collect()]
    assert Counter(got)[8, 7, False] == 1 and Counter(got)[None, 7, False] == 2 and Counter(got)[9, 9, True] == 3


def test_min_max_estimates_similarity():
    h = WordHashes()
    a = words(400)
    x, y = neardup.shingles(a, h), neardup.shingles(edited(a, 0.03), h)
    true = len(set(x.tolist()) & set(y.tolist())) / len(set(x.tolist()) | set(y.tolist()))
    (l1, h1), (l2, h2) = neardup.min_max(x), neardup.min_max(y)
    assert abs(((l1 == l2).mean() + (h1 == h2).mean()) / 2 - true) < 0.12


def mix_rows(n=900):
    return [(i, words(1 + int(R.paretovariate(1.2)) % 300), "en", R.choice(["a", "a", "a", "b", "c", "d", None]), 0) for i in range(n)]


def targets_of(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(sizes.values())
    while True:
        share = left / sum(w[s] for s in open_)
        over = [s for s in open_ if w[s] * share > 2 * sizes[s]]
        if not over:
            return target | {s: w[s] * share for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.discard(s)


@pytest.mark.parametrize("block", [8, 256])
def test_mix_meets_targets(spark, block):
    rows = mix_rows() + [(2000, None, "en", "a", 0), (2001, "", None, "zero", 0)]
    got = mixing.mix(docs_of(spark, rows), block=block).collect()
    again = mixing.mix(docs_of(spark, rows[::-1]).repartition(7), block=block).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    total = Counter()
    for i, _, _, s, _ in rows:
        total[s] += size[i]
    want, taken, largest = targets_of(total), Counter(), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == total[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in total:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6


def test_mix_counts_repeated_rows_together(spark):
    rows = [(1, "one two three", "en", "a", 0)] * 50 + [(2, "x", "en", "b", 0)]
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert len(got) == 51 and abs(sum(r.taken for r in got if r.source == "a") - got[0].target) <= 3
    out = mixing.apply_mix(docs_of(spark, rows))
    assert out.columns == docs_of(spark, rows).columns
    assert out.where("source = 'a'").count() == sum(r.copies for r in got if r.source == "a")
    assert mixing.mix(docs_of(spark, rows).limit(0)).count() == 0


def test_shards_hold_equal_bytes_and_places_have_no_gap(spark):
    rows = mix_rows(600) + [(None, None, None, None, None), (5, "again", "en", "a", 0)]
    got = sharding.shard_documents(docs_of(spark, rows).withColumn("shard", F.lit("x"))).collect()
    assert len(got) == len(rows)
    load, places = Counter(), defaultdict(list)
    by = {i: t for i, t, *_ in rows if i != 5}
    for r in got:
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
        if r.doc_id in by and r.doc_id is not None:
            data = (by[r.doc_id] or "").encode()
            assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data)
    assert set(load) == set(range(8)) and max(load.values()) - min(load.values()) <= max(r.size for r in got)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.shard_documents(docs_of(spark, rows).limit(0)).count() == 0


def test_growing_moves_slots_only_into_the_new_shard():
    sizes = {s: R.randrange(1, 1000) for s in range(500)}
    m = sharding.rebalance(sharding.first_map(8, 512), sizes, 8)
    g = sharding.grow(m, sizes, 8)
    assert all(b in (a, 8) for a, b in zip(m, g, strict=True))
    new = sum(sizes.get(s, 0) for s, shard in enumerate(g) if shard == 8)
    assert abs(new - sum(sizes.values()) / 9) <= 1000


def brute_base(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if __import__("re").search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if n[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_quality_base_and_bands(spark):
    good = [words(R.randrange(60, 200)) + "\n" + words(30) for _ in range(150)]
    junk = [" ".join(w + R.choice(["###", "%%%", "$$$"]) for w in words(90).split()) for _ in range(5)]
    rough = [None, "", "a\nb\na\n\n a\n", "x y z x y z " * 30, "é　ü | < >\x0b#", "😀 " * 3, "z" * 100_000, "q\r\nq\r\n" * 60]
    rows = [(i, t, R.choice(["en", "EN-gb"]) if i % 50 else None, "s", 0) for i, t in enumerate(good + junk + rough)]
    got = {r.doc_id: r for r in quality.quality(docs_of(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        r, want = got[i], brute_base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (i, t)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert sum(got[i].kept for i in range(150)) >= 147
    assert not any(got[i].kept for i in range(150, 155) if i % 50)
    kept = quality.filter_documents(docs_of(spark, rows).withColumn("__low", F.lit(1)))
    assert kept.columns[-1] == "__low" and kept.count() == sum(r.kept for r in got.values())
    assert quality.quality(docs_of(spark, rows).limit(0)).count() == 0


def test_quality_judges_the_whole_text(spark):
    r = random.Random(11)
    gibberish = " ".join("".join(r.choice("QXZJKVW#%&@~^{}[]") for _ in range(7)) for _ in range(550))
    rows = [(i, words(r.randrange(200, 900), r), "en", "s", 0) for i in range(120)] + [(500, words(260, r) + " " + gibberish, "en", "s", 0)]
    got = {x.doc_id: x for x in quality.quality(docs_of(spark, rows)).collect()}
    assert not got[500].base_failed and not got[500].kept
    assert sum(got[i].kept for i in range(120)) >= 118


def plain_kneser_ney(words, order, discounts, floor):
    """word -> minus log-probability, by modified Kneser-Ney on letter tuples, discounts apart for each last context letter."""
    pad = [1] * (order - 1)
    grams = Counter()
    for w, n in words.items():
        line = [*pad, *map(ord, w), 2]
        for i in range(order - 1, len(line)):
            grams[tuple(line[i - order + 1 : i + 1])] += n
    counts = {order: grams}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    found = {}

    def p(g):
        if not g:
            return floor
        if g in found:
            return found[g]
        k, n = len(g), counts[len(g)]
        peers = [c for x, c in n.items() if k == 1 or x[-2] == g[-2]]
        own = {x: c for x, c in n.items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        d = discounts(peers)
        cut = lambda c: min(c, d[min(c, 3)])
        total, left = sum(own.values()), sum(map(cut, own.values()))
        c = own.get(g, 0)
        found[g] = (c - cut(c) + left * p(g[1:])) / total
        return found[g]

    def nats(w):
        line = [*pad, *map(ord, w), 2]
        return -sum(math.log(p(tuple(line[i - order + 1 : i + 1]))) for i in range(order - 1, len(line)))

    return nats


def test_perplexity_equals_plain_kneser_ney(spark, monkeypatch):
    import numpy as np

    r = random.Random(4)
    text = ["".join(r.choice(["an", "to", "ré", "l", "x"]) for _ in range(r.randrange(1, 4))) for _ in range(300)]
    docs = docs_of(
        spark,
        [(i, " ".join(text[i * 30 : i * 30 + 30]), "en-GB", "s", 0) for i in range(10)] + [
            (11, "anto lx", "de", "s", 0),
            (12, None, None, None, None),
            (13, "qq", "!!", None, None),
        ],
    )
    nats = plain_kneser_ney(Counter(text), quality.ORDER, lambda n: quality.discounts(np.array(n)), 1 / quality.ALPHABET)
    for most in (8_000_000, 300):  # one array, then several
        monkeypatch.setattr(quality, "MOST_ENTRIES", most)
        got = {x.doc_id: x for x in quality.quality(docs).collect()}
        for i in range(10):
            words_of = text[i * 30 : i * 30 + 30]
            assert math.log(got[i].perplexity) == pytest.approx(sum(map(nats, words_of)) / 30, rel=1e-5)
        assert got[12].n_words == 0 and got[13].n_words == 1
    model = quality.Model(quality.shared_parts(quality.fit(docs)))
    new = {b"zan", "réx".encode(), b"", "漢".encode()}
    assert all(model.nats(new, "en")[w] == pytest.approx(nats(w.decode()), rel=1e-5) for w in new)


def test_licences(spark):
    mit = licenses.MIT.replace("(the \"Software\")", "(the   'SOFTWARE')").replace("\n\n", "\nCopyright (c) 2020 Somebody\n\n", 1)
    rows = [
        (1, mit),
        (2, licenses.APACHE_HEADER.replace("License", "Licence")),
        (3, "text\nReleased under the MIT Licence.\nLicensed under CC BY-NC 4.0"),
        (4, None),
        (5, ""),
        (6, mit + " and more"),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].license_id for i in range(1, 7)] == ["MIT", "Apache-2.0-header", None, None, None, None]
    assert got[3].notice_ids == "CC-BY-NC-4.0,MIT" and got[3].n_notice_lines == 2


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
<nav><ul><li><a href=/>Home</a><li><a href=/b>Blog</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="wrap"><div class="content has-sidebar"><h1>Big &amp; small</h1><p>First <b>bold</b> para&shy;graph with a <a href="x">link</a> in it and many more words to read.<p>Second paragraph, unclosed, with   white
space and an &eacute;. It goes on for a while so that it is dense.<br>After the break.</div><div class="sidebar"><p>Other stories you may like</p></div></div>
<form><label>Name</label><input name=q></form><section id="comments"><article class="comment"><p>I disagree with all of this, and at some length too.</p></article></section>
<footer>&copy; 2024</footer></body></html>"""


def test_main_text(spark):
    rows = [
        (1, "u", PAGE),
        (2, "u", None),
        (3, "u", ""),
        (4, "u", "just text"),
        (5, "u", "<p>a<p>b"),
        (6, "u", "<div>" * 3000 + "deep" + "</div>" * 10),
        (7, "u", "<a href='>'>x</a><!-- c"),
        (8, "u", "<"),
        (9, "u", "<script>x"),
    ]
    got = {r.page_id: r for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), keep=["page_id", "url"]).collect()}
    assert got[1].text == "Big & small First bold para\xadgraph with a link in it and many more words to read. Second paragraph, unclosed, with white space and an é. It goes on for a while so that it is dense. After the break."
    assert [got[i].text for i in (2, 3, 4, 5, 6, 8, 9)] == ["", "", "just text", "a b", "deep", "<", ""]
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_class_models_equal_plain_kneser_ney(spark):
    """Letter models of words counted in two classes, against direct sums over letter tuples."""
    r = random.Random(6)
    made = {"".join(r.choice(["an", "to", "ré", "l", "x"]) for _ in range(r.randrange(1, 4))): (r.randrange(4), r.randrange(4)) for _ in range(60)}
    rows = [(w.encode(), *n) for w, n in made.items() if sum(n)]
    table = toxicity.letter_models(spark.createDataFrame(rows, "w binary, n0 long, n1 long").repartition(3)).withColumn("weight", F.lit(1.0))
    model = toxicity.Model(*[toxicity.fetched(table.where(F.col("kind") == k), "h", ["l0", "l1"]) for k in (0, 1)])
    order = toxicity.ORDER
    tuples = lambda w: [tuple(([1] * (order - 1) + [*map(ord, w), 2])[i : i + order]) for i in range(len(w) + 1)]
    own = [Counter(), Counter()]
    for w, *n in rows:
        for g in tuples(w.decode()):
            for k in (0, 1):
                own[k][g] += n[k]
    counts = {order: own[0] + own[1]}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def absolute(n):
        c = Counter(n)
        return c[1] / (c[1] + 2 * c[2]) if c[1] and c[2] else 0.5

    def shared(g):
        if not g:
            return 1e-4
        k, n = len(g), counts[len(g)]
        d = absolute([c for x, c in n.items() if k == 1 or x[-2] == g[-2]])
        mine = [c for x, c in n.items() if x[:-1] == g[:-1]]
        return (max(n[g] - d, 0) + d * len(mine) * shared(g[1:])) / sum(mine)

    def log_p(g, k):
        mine = [c for x, c in own[k].items() if x[:-1] == g[:-1] and c]
        if not any(x[:-1] == g[:-1] for x in counts[order]):
            return 0.0
        d = absolute([c for x, c in own[k].items() if x[-2] == g[-2] and c])
        total = sum(mine) + toxicity.PRIOR
        fall = (d * len(mine) + toxicity.PRIOR) / total
        return math.log(max(own[k][g] - d, 0) / total + fall * shared(g)) if g in counts[order] else math.log(fall)

    asked = [w.decode() for w, *_ in rows[:20]] + ["anq", "zz", "toto"]
    got = model.words([w.encode() for w in asked])
    for k in (0, 1):
        assert got[k].tolist() == pytest.approx([sum(log_p(g, k) for g in tuples(w)) for w in asked], rel=1e-4, abs=1e-4)


def test_toxicity_ranks_held_out_rows(spark):
    bad = ["vilword" + x for x in ("s", "ed", "er", "ing")] + ["scumm", "trashh"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        w = words(R.randrange(20, 80)).split()
        for _ in range(3 if toxic else 0):
            w.insert(R.randrange(len(w)), R.choice(bad))
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (None, words(5), "en", "s", 0)]
    docs, lab = docs_of(spark, rows), spark.createDataFrame([*labels, (None, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, lab).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    held = [r for i, r in got.items() if i is not None and i < 400 and r.held_out]
    right = sum(a.score > b.score for a in held if a.doc_id % 4 == 0 for b in held if b.doc_id % 4)
    assert right >= 0.95 * sum(1 for a in held if a.doc_id % 4 == 0 for b in held if b.doc_id % 4)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert {r.predicted for r in toxicity.toxicity(docs, lab.limit(0)).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), lab).count() == 0
    twice = docs.unionByName(docs.where("doc_id < 9")).withColumn("Score", F.lit("x")).withColumn("evidence", F.lit(1))
    assert twice.count() == toxicity.toxicity(twice, lab).count() == docs.count() + docs.where("doc_id < 9").count()


def test_expressions_of_ordinary_words_count(spark):
    """A pair of words tells, though each of them is as common in both classes."""
    r = random.Random(12)
    rows, labels = [], []
    for i in range(500):
        w = words(40, r).split()
        toxic = i % 3 == 0
        w[10:12] = ["blue", "stone"] if toxic else ["blue", r.choice(["sky", "sea", "ink"])]
        w[20:22] = ["grey", r.choice(["sky", "sea", "ink"])] if toxic else ["grey", "stone"]
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [x for x in toxicity.toxicity(docs_of(spark, rows), lab).collect() if x.held_out]
    assert sum(x.predicted == (x.doc_id % 3 == 0) for x in got) >= 0.95 * len(got)


def test_pipeline_stages_against_their_operators(spark, tmp_path, near_rows):
    rows = [(i, words(70) if i % 3 else words(12), "en", "ab"[i % 2], 0) for i in range(300)] + [(1100 + i, t, "en", "c", 0) for i, (_, t, *_) in enumerate(near_rows)]
    passage = words(30)
    rows.append((900, words(40) + " " + passage + " " + words(20), "en", "a", 0))
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = [r.doc_id for r in docs.collect()]
    text = {r[0]: r[1] for r in rows}
    assert all(len((text[i] or "").split()) >= 50 for i in seen["quality"])
    want = neardup.brute((i, text[i]) for i in seen["quality"])
    assert sorted(seen["near_duplicates"]) == sorted(i for i, (_, c) in want.items() if c == i)
    assert 900 in seen["near_duplicates"] and 900 not in seen["decontaminate"]
    assert max(Counter(seen["mix"]).values()) <= 2 and set(seen["mix"]) <= set(seen["decontaminate"])
    assert len(seen["shard"]) == len(seen["mix"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["shard"])
