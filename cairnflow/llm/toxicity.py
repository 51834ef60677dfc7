"""Toxicity by class-conditional Kneser-Ney models.

A shared interpolated Kneser-Ney model of letter n-grams within words (continuation counts below the highest order) is
counted over both classes. On top of it each class has its own discounted counts of the highest order and falls back on
the shared model, so that expressions rare in either class differ only by what their class has seen. Pairs of
neighbouring words that PAIR_TEXTS texts of the sample hold have class counts too, which fall back on the letter models, so
that expressions made of ordinary words count. Counts are of distinct texts that hold a word or pair, not of
repetitions within one.

Toxic text is ordinary text with some toxic expressions. Its model is therefore the mixture of the ordinary class's
model and, with weight SHARE, the toxic class's. A document's evidence is the difference of the two length-normalised
log-likelihoods (nats a word) of this mixture and of the ordinary model. A logistic curve over it, fitted on labelled rows
that the counts leave out, gives 0..1.

The labelled rows that are learnt from are a documented, bounded sample: at most `per_class` rows of each class, those with
the smallest hash of their id, as far as their lengths add up to PER_CLASS_CHARS; a row of over a twentieth of that does not
learn. Spark counts the n-grams and fits the models, one group for each last letter of a context. What reaches the driver and
is broadcast is the finished model, two sorted arrays of hashes and numbers; above MOST_ENTRIES entries those of the least
weight are pruned. Every document is scored whole. Labels, language, source and id are no inputs of a score.

Nulls and texts without words have no evidence and get the curve's value at 0. Rows with an id that repeats in the
labels learn once for each text and class; without labels of both classes every score is just below 0.5 and nothing is
predicted toxic. Empty tables give an empty result; ties of the sample's hash go by id; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnflow.llm.common import WordHashes, map_rows, materialise, mix64, utf8
from cairnflow.llm.decontam import WORD_BYTES

ORDER = 6
PER_CLASS = 10_000
PER_CLASS_CHARS = 32_000_000
#: Extra weight of the shared model in each class's context.
PRIOR = 16.0
#: Share of toxic expressions that a toxic text is taken to have.
SHARE = 0.01
#: One in so many sampled rows is left out of the counts, for the curve.
APART = 5
MOST_ENTRIES = 8_000_000
PAIR_DISCOUNT = 0.75
#: A pair of words is an expression of its own from so many texts on, and its letter models weigh as much as so many more.
PAIR_TEXTS, PAIR_PRIOR = 8, 64.0
#: Words are scored once and remembered up to this many; forgetting changes no result.
REMEMBERED = 150_000

K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
START, END = 1, 2
BITS = 21  # of a code point
LETTER = (1 << BITS) - 1


def tokens(text: str | None) -> list[bytes]:
    return utf8((text or "").lower()).translate(WORD_BYTES).split()


def letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(grams, word): two packed halves of ORDER code points for each letter of each word and for its end; the word's index."""
    parts = [w.decode("utf-8", "surrogatepass") for w in words]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    pad = ORDER - 1
    at = np.cumsum(sizes + pad + 1) - (sizes + pad + 1)
    line = np.full(int((sizes + pad + 1).sum()), START, np.int64)
    within = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    line[np.repeat(at + pad, sizes) + within] = flat
    line[at + pad + sizes] = END
    triple = (line[:-2] << (2 * BITS)) | (line[1:-1] << BITS) | line[2:]
    first = np.repeat(at, sizes + 1) + np.arange(int((sizes + 1).sum())) - np.repeat(np.cumsum(sizes + 1) - (sizes + 1), sizes + 1)
    return np.stack([triple[first], triple[first + 3]]), np.repeat(np.arange(len(words)), sizes + 1)


def hash2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of pairs of 64-bit values, signed."""
    a, b = a.astype(np.int64).view(np.uint64), b.astype(np.int64).view(np.uint64)
    return mix64((mix64(a * K1 + K2) ^ b) * K1 + K2).view(np.int64)


def gram_key(grams: np.ndarray) -> np.ndarray:
    return hash2(grams[0], grams[1])


def context_key(grams: np.ndarray) -> np.ndarray:
    """Hash of all letters but the last; the last one's place is empty."""
    return hash2(grams[0], grams[1] & ~LETTER)


def suffix(grams: np.ndarray, size: int) -> np.ndarray:
    """The last `size` letters, the places before them empty."""
    a, b = min(3, max(0, size - 3)), min(3, size)
    return np.stack([grams[0] & ((1 << (BITS * a)) - 1), grams[1] & ((1 << (BITS * b)) - 1)])


def discount(counts: np.ndarray) -> float:
    n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5


def level(grams: np.ndarray, counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Interpolated probabilities of distinct n-grams that hold all those of their contexts."""
    contexts, place = np.unique(context_key(grams), return_inverse=True)
    total, types, d = np.bincount(place, counts), np.bincount(place), discount(counts)
    return (np.maximum(counts - d, 0) + d * types[place] * lower) / total[place]


def fit_group(pdf: pd.DataFrame, letter: dict[int, float]) -> pd.DataFrame:
    """kind (0: n-gram, 1: context), hash, and log-probabilities (of a context: of its fallback) in the ordinary and toxic class.

    pdf: all distinct n-grams (halves a, b) with one letter in the last but one place, and class counts n0, n1.
    """
    grams, n = pdf[["a", "b"]].to_numpy().T.copy(), pdf[["n0", "n1"]].to_numpy().T.astype(float)
    held, up = [grams], []
    counts = [n.sum(0)]
    for size in range(ORDER - 1, 1, -1):
        shorter = suffix(held[-1], size)
        _, first, place = np.unique(gram_key(shorter), return_index=True, return_inverse=True)
        held.append(shorter[:, first])
        counts.append(np.bincount(place).astype(float))  # continuations
        up.append(place)
    p = np.array([letter[int(x)] for x in held[-1][1] & LETTER])
    for k in range(len(held) - 1, -1, -1):
        p = level(held[k], counts[k], p)
        if k:
            p = p[up[k - 1]]
    contexts, first, place = np.unique(context_key(grams), return_index=True, return_inverse=True)
    out = [(np.zeros(len(p), np.int32), gram_key(grams)), (np.ones(len(contexts), np.int32), contexts)]
    logs = []
    for c in n:
        d = discount(c[c > 0])
        total, types = np.bincount(place, c), np.bincount(place, c > 0)
        fall = (d * types + PRIOR) / (total + PRIOR)
        logs.append((np.log(np.maximum(c - d, 0) / (total[place] + PRIOR) + fall[place] * p), np.log(fall)))
    return pd.DataFrame({"kind": np.concatenate([k for k, _ in out]), "h": np.concatenate([h for _, h in out]), "l0": np.concatenate(logs[0]), "l1": np.concatenate(logs[1])})


class Lookup:
    """Numbers by 64-bit key in sorted arrays."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], [v[order].astype(np.float32) for v in values]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, place)."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at


@dataclass
class Model:
    grams: Lookup  # ordinary and toxic log-probability
    contexts: Lookup  # the same of the fallback
    pairs: Lookup | None = None  # toxic less ordinary log-probability of a pair's second word
    slope: float = 1.0
    offset: float = 0.0
    scale: float = 1.0

    def words(self, words: list[bytes]) -> np.ndarray:
        """Ordinary and toxic log-likelihood of each word; letters after unseen contexts count as equal in both."""
        grams, word = letters(words)
        seen, i = self.grams.find(gram_key(grams))
        known, j = self.contexts.find(context_key(grams))
        out = []
        for k in (0, 1):
            x = np.zeros(len(word))
            x[known] = self.contexts.values[k][j[known]]
            x[seen] = self.grams.values[k][i[seen]]
            out.append(np.bincount(word, x, len(words)))
        return np.stack(out)

    def probability(self, x: float) -> float:
        z = self.slope * math.asinh(x / self.scale) + self.offset
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


class Scorer:
    """Evidence of texts; remembers words up to a bound."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.hashes = WordHashes(REMEMBERED)

    def evidence(self, texts: list[str | None]) -> list[float]:
        out = []
        for i in range(0, len(texts), 200):
            lists = [tokens(t) for t in texts[i : i + 200]]
            if len(self.known) > REMEMBERED:
                self.known.clear()
            new = list(set().union(*lists).difference(self.known))
            for k in range(0, len(new), 20_000):
                part = new[k : k + 20_000]
                ordinary, toxic = self.model.words(part)
                self.known.update(zip(part, (toxic - ordinary).tolist(), strict=True))
            out += [self.text(w) for w in lists]
        return out

    def text(self, words: list[bytes]) -> float:
        """Nats a word by which the mixture's log-likelihood exceeds the ordinary model's."""
        if not words:
            return 0.0
        e = np.fromiter(map(self.known.__getitem__, words), float, len(words))
        if self.model.pairs is not None and len(words) > 1:
            h = self.hashes.of(words).view(np.int64)
            seen, at = self.model.pairs.find(hash2(h[:-1], h[1:]))
            e[1:][seen] = self.model.pairs.values[0][at[seen]]
        return float(np.log1p(SHARE * np.expm1(np.minimum(e, 50.0))).mean())


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method, lightly held to 0; classes weigh alike."""
    a = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    b = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -35, 35)))
        g = a.T @ (weight * (y - p)) - 1e-3 * b
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def held_out(doc_id):
    """Column: whether crc32 of the id as text is divisible by 5."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, chars: int = PER_CLASS_CHARS) -> DataFrame:
    """text, toxic, apart of at most per_class labelled rows and about `chars` characters of each class, none held out; written."""
    rows = labels.select(F.col("doc_id").alias("i"), F.col("toxic").cast("int").alias("toxic")).where("i is not null and toxic in (0, 1)").where(~held_out(F.col("i")))
    rows = rows.distinct().withColumn("h", F.xxhash64("i"))
    chosen = rows.where("toxic = 0").orderBy("h", "i").limit(per_class).unionByName(rows.where("toxic = 1").orderBy("h", "i").limit(per_class))
    # 2 * per_class ids at most
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("i"))
    found = found.where(F.length("text") <= chars // 20).dropDuplicates(["text", "toxic"])
    found = materialise(found.select("i", "h", "toxic", "text", F.length("text").alias("size")), "toxic-found")
    before = Window.partitionBy("toxic").orderBy("h", "i", "size").rowsBetween(Window.unboundedPreceding, 0)
    within = found.select("i", "h", "toxic", "size").withColumn("sum", F.sum("size").over(before)).where(F.col("sum") <= chars).select("i", "toxic").distinct()
    return found.join(F.broadcast(within), ["i", "toxic"]).select("text", "toxic", (F.pmod(F.xxhash64("i", F.lit(1)), F.lit(APART)) == 0).alias("apart"))


def counted(rows: DataFrame, pairs: bool) -> DataFrame:
    """Of rows (text, toxic): by word (w), or by pair of neighbouring words (h1, h2: hashes), the texts of each class (n0, n1)."""
    names = ["h1", "h2"] if pairs else ["w"]

    def words(batches):
        found: dict[bytes, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for w in set(tokens(text)):
                    found.setdefault(w, [0, 0])[toxic] += 1
                if len(found) > 500_000:
                    yield told(found)
                    found = {}
        yield told(found)

    def told(found):
        n = np.array(list(found.values()), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(n[:, 0].copy()), pa.array(n[:, 1].copy())], ["w", "n0", "n1"])

    def neighbours(batches):
        hashes = WordHashes()
        held: tuple[list, list] = ([], [])
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                h = hashes.of(tokens(text)).view(np.int64)
                if len(h) > 1:
                    held[toxic].append(np.unique(np.stack([h[:-1], h[1:]], 1), axis=0))
            if sum(len(x) for part in held for x in part) > 2_000_000:
                yield summed(held)
                held = ([], [])
        if held[0] or held[1]:
            yield summed(held)

    def summed(held):
        every = np.concatenate(held[0] + held[1])
        toxic = np.zeros(len(every), bool)
        toxic[sum(map(len, held[0])) :] = True
        _, first, place = np.unique(hash2(every[:, 0], every[:, 1]), return_index=True, return_inverse=True)
        n0, n1 = np.bincount(place, ~toxic, len(first)).astype(np.int64), np.bincount(place, toxic, len(first)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(every[first, 0]), pa.array(every[first, 1]), pa.array(n0), pa.array(n1)], ["h1", "h2", "n0", "n1"])

    made = rows.select("text", "toxic").mapInArrow(neighbours if pairs else words, "h1 long, h2 long, n0 long, n1 long" if pairs else "w binary, n0 long, n1 long")
    return made.groupBy(*names).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def letter_models(words: DataFrame) -> DataFrame:
    """kind, h, l0, l1 of every letter n-gram and context of the words (w, n0, n1)."""

    def split(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 50_000):
                part = batch.slice(k, 50_000)
                grams, word = letters(part.column("w").to_pylist())
                _, first, place = np.unique(gram_key(grams), return_index=True, return_inverse=True)
                n = [np.bincount(place, part.column(c).to_numpy()[word], len(first)).astype(np.int64) for c in ("n0", "n1")]
                yield pa.RecordBatch.from_arrays([pa.array(grams[0, first]), pa.array(grams[1, first]), *map(pa.array, n)], ["a", "b", "n0", "n1"])

    grams = words.mapInArrow(split, "a long, b long, n0 long, n1 long").groupBy("a", "b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    grams = materialise(grams.withColumn("before", F.shiftright("b", BITS).bitwiseAND(F.lit(LETTER))), "toxic-grams")
    # the lowest level: in how many pairs of letters a letter is the second; as many rows as the script has letters
    second = grams.select("before", F.col("b").bitwiseAND(F.lit(LETTER)).alias("x")).distinct().groupBy("x").count().toPandas()
    c = second["count"].to_numpy().astype(float)
    d = discount(c)
    letter = dict(zip(second["x"].tolist(), ((np.maximum(c - d, 0) + d * len(c) * 1e-4) / max(1.0, c.sum())).tolist(), strict=True))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return fit_group(pdf, letter)

    return grams.groupBy("before").applyInPandas(fit, "kind int, h long, l0 double, l1 double")


def fetched(table: DataFrame, key: str, values: list[str]) -> Lookup:
    """The table's numbers as sorted arrays; above MOST_ENTRIES rows those of the largest weight (the last of values)."""
    n = table.count()
    if n > MOST_ENTRIES:
        least = table.select(F.percentile_approx(F.col("weight"), 1 - MOST_ENTRIES / n, 10_000)).collect()[0][0]
        table = table.where(F.col("weight") > least)
    got = table.select(F.col(key).alias("h"), *[F.col(c).cast("float").alias(c) for c in values]).toArrow()
    return Lookup(got.column("h").to_numpy(), *[got.column(c).to_numpy() for c in values])


def pair_models(pairs: DataFrame, words: DataFrame, shared) -> DataFrame:
    """h, e of the pairs seen often enough: toxic less ordinary log-probability of the second word after the first."""

    def likelihoods():
        hashes = WordHashes()

        def rows(found):
            found = [bytes(w) for w in found]
            low = shared.value.words(found) if found else np.zeros((2, 0))
            return [hashes.of(found).view(np.int64).tolist(), low[0].tolist(), low[1].tolist()]

        return rows

    own = map_rows(words, ["w"], T.StructType([T.StructField("h2", T.LongType()), T.StructField("p0", T.DoubleType()), T.StructField("p1", T.DoubleType())]), likelihoods, [])
    totals = pairs.groupBy("h1").agg(*[F.sum(f"n{k}").alias(f"t{k}") for k in (0, 1)], *[F.count_if(F.col(f"n{k}") > 0).alias(f"k{k}") for k in (0, 1)])
    rows = pairs.where(F.col("n0") + F.col("n1") >= PAIR_TEXTS).join(totals, "h1").join(own, "h2")

    def log_p(k: int):
        n, t, types = F.col(f"n{k}"), F.col(f"t{k}") + PAIR_PRIOR, F.col(f"k{k}")
        return F.log(F.greatest(n - PAIR_DISCOUNT, F.lit(0.0)) / t + (PAIR_DISCOUNT * types + PAIR_PRIOR) / t * F.exp(f"p{k}"))

    rows = rows.withColumn("e", log_p(1) - log_p(0)).withColumn("weight", F.abs("e"))

    def key(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(hash2(b.column("h1").to_numpy(), b.column("h2").to_numpy())), b.column("e"), b.column("weight")], ["h", "e", "weight"])

    return rows.select("h1", "h2", "e", "weight").mapInArrow(key, "h long, e double, weight double")


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    rows = sample(docs, labels, per_class)
    rows = materialise(rows, "toxic-sample")
    sizes = {(r["toxic"], r["apart"]): r["count"] for r in rows.groupBy("toxic", "apart").count().collect()}
    apart = all((y, z) in sizes for y in (0, 1) for z in (True, False))  # else all rows count, and fit the curve too
    learn, rest = (rows.where("not apart"), rows.where("apart")) if apart else (rows, rows)
    if not all(sizes.get((y, True), 0) + sizes.get((y, False), 0) for y in (0, 1)):
        return None
    words = materialise(counted(learn, False), "toxic-words")
    table = materialise(letter_models(words).withColumn("weight", F.abs(F.col("l1") - F.col("l0"))), "toxic-model")
    sc = docs.sparkSession.sparkContext
    model = Model(*[fetched(table.where(F.col("kind") == k), "h", ["l0", "l1"]) for k in (0, 1)])
    shared = sc.broadcast(model)
    pairs = materialise(counted(learn, True), "toxic-pairs")
    table = materialise(pair_models(pairs, words, shared), "toxic-expressions")
    model.pairs = fetched(table, "h", ["e"])
    shared.destroy()
    shared = sc.broadcast(model)

    @F.pandas_udf("double")
    def evidence(text: pd.Series) -> pd.Series:
        return pd.Series(Scorer(shared.value).evidence(text.tolist()))

    scored = rest.select("toxic", evidence("text").alias("x")).toPandas()
    shared.destroy()
    x, y = scored["x"].to_numpy(), scored["toxic"].to_numpy()
    ordinary = x[y == 0]
    model.scale = max(1e-3, 1.4826 * float(np.median(np.abs(ordinary - np.median(ordinary)))))
    model.slope, model.offset = fit_curve(np.arcsinh(x / model.scale), y)
    return model


def score(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """docs with `score` (0 to 1) and `evidence` (nats a word)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        if shared.value is None:
            return lambda texts: [[0.5 - 1e-9] * len(texts), [0.0] * len(texts)]
        scorer = Scorer(shared.value)

        def rows(texts):
            x = scorer.evidence(texts)
            return [[shared.value.probability(v) for v in x], x]

        return rows

    return map_rows(docs, ["text"], T.StructType([T.StructField("score", T.DoubleType()), T.StructField("evidence", T.DoubleType())]), work, keep)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of each document."""
    made = score(docs, train(docs, labels, per_class), ["doc_id"])
    return made.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
