"""Quality rules with an n-gram perplexity band for each language.

Fixed rules look at a text alone: too few words, too many repeated three-word windows. The method's verdict is the
perplexity of the text's words under a modified Kneser-Ney model of its language: letter n-grams of order ORDER within
words, of all characters as they are, ends of words included. Spark counts them over all documents: the distinct words of each
language with their numbers first, then their n-grams, and fits the models, one group for each language and last letter of
a context (discounts are that group's own). The model grows with the corpus's vocabulary.

It is stored as sorted arrays of 64-bit hashes, each with a number: the log-probability of a seen n-gram, or the log-weight that a
context leaves to the lower order. A letter's log-probability is that of its longest seen n-gram plus the weights of the longer
contexts. A hash may lie in any part: arrays of at most MOST_ENTRIES entries are broadcast, and where there are several, a task
loads one after another. Nothing is pruned.

The bounds of a language are the median perplexity (in nats a word) of its documents that pass the fixed rules, less and plus a
multiple of the spread (the median absolute deviation), wider for texts of few words. A text outside is rejected.

Languages are the first two letters of the tag in lower case; anything else counts as one language of its own.

Nulls and empty texts have no words and fail the fixed rules. Repeated rows get the same result each; an empty table
gives an empty one. filter_documents() returns the columns it was given, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnflow.llm.common import map_rows, materialise, set_aside, utf8
from cairnflow.llm.toxicity import BITS, LETTER, Lookup, context_key, gram_key, hash2, letters, suffix

MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
ORDER = 5
#: Characters that a letter never seen in a language is taken to be one of.
ALPHABET = 65_536
#: Spreads that a text may lie from its language's median (chosen on labelled rows whose id's crc32 is even), and the least
#: spread in nats a word.
BAND = 8.0
LEAST_SPREAD = 0.12
#: A text of n words gets this over sqrt(n) added on both sides.
SHORT = 6.0
#: Entries of an array that is broadcast (12 bytes each).
MOST_ENTRIES = 8_000_000
#: Words are scored once and remembered up to this many; forgetting changes no result.
REMEMBERED = 150_000


def language(tag):
    """Column: two letters, or `-`."""
    two = F.substring(F.lower(F.trim(tag.cast("string"))), 1, 2)
    return F.coalesce(F.when(two.rlike("^[a-z]{2}$"), two), F.lit("-"))


def count_words(docs: DataFrame) -> DataFrame:
    """lang, w, n: the distinct words of each language; each task adds up its own first."""

    def count(batches):
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                found.setdefault(lang, Counter()).update(utf8(text.as_py()).split())
                if sum(map(len, found.values())) > 400_000:
                    yield from map(told, found.items())
                    found.clear()
        yield from map(told, found.items())

    def told(item):
        lang, n = item
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["lang", "w", "n"])

    rows = docs.select(language(F.col("lang")).alias("lang"), "text").where("text is not null")
    return rows.mapInArrow(count, "lang string, w binary, n long").groupBy("lang", "w").agg(F.sum("n").alias("n"))


def letter_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of order ORDER that end at each letter and at each word's end, and the word's index."""
    grams, word = letters(words)
    return suffix(grams, ORDER), word


def count_grams(words: DataFrame) -> DataFrame:
    """lang, a, b (halves of an n-gram), before (the last letter but one), n."""

    def split(batches):
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                at = np.flatnonzero(langs == lang)
                for k in range(0, len(at), 50_000):
                    part = batch.take(pa.array(at[k : k + 50_000]))
                    grams, word = letter_grams(part.column("w").to_pylist())
                    _, first, place = np.unique(gram_key(grams), return_index=True, return_inverse=True)
                    n = np.bincount(place, part.column("n").to_numpy()[word], len(first)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(first), pa.string()), pa.array(grams[0, first]), pa.array(grams[1, first]), pa.array(n)],
                        ["lang", "a", "b", "n"],
                    )

    grams = words.mapInArrow(split, "lang string, a long, b long, n long").groupBy("lang", "a", "b").agg(F.sum("n").alias("n"))
    return grams.withColumn("before", F.shiftright("b", BITS).bitwiseAND(F.lit(LETTER)))


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more."""
    n1, n2, n3, n4 = (max(1, int((n == k).sum())) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.9])


def level(contexts: np.ndarray, n: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of n-grams that hold all those of their contexts: distinct contexts, the log-weight each leaves to the lower order, the
    place of each n-gram's context, and the n-grams' probabilities."""
    keys, place = np.unique(contexts, return_inverse=True)
    taken = np.minimum(n, discounts(n)[np.minimum(n, 3).astype(int)])
    total, left = np.bincount(place, n), np.bincount(place, taken)
    return keys, np.log(left / total), place, (n - taken + left[place] * lower) / total[place]


def language_key(lang: str) -> int:
    return int.from_bytes(utf8(lang)[:2].ljust(2), "big")


def keyed(key: np.ndarray, lang: str) -> np.ndarray:
    return hash2(key, np.full(len(key), language_key(lang)))


def fit_letters(lang: str, letter: np.ndarray, n: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    """The entries of order 1 of a language (h, v), and the letters' probabilities. n: letters that a letter comes after."""
    none = np.zeros(len(letter), np.int64)
    _, fall, _, p = level(none, n.astype(float), np.full(len(letter), 1.0 / ALPHABET))
    base = fall[0] - np.log(ALPHABET)
    h = np.concatenate([keyed(hash2(none[:1], none[:1]), lang), keyed(hash2(none, letter), lang)])
    return pd.DataFrame({"h": h, "v": np.concatenate([[base], np.log(p)])}), p


def fit_group(pdf: pd.DataFrame, lang: str, letter: dict[int, float]) -> pd.DataFrame:
    """The entries (h, v) of orders 2 to ORDER of the n-grams with one last letter but one. letter: probabilities of order 1."""
    grams = pdf[["a", "b"]].to_numpy().T.copy()
    held, up, counts = [grams], [], [pdf["n"].to_numpy().astype(float)]
    for size in range(ORDER - 1, 1, -1):
        shorter = suffix(held[-1], size)
        _, first, place = np.unique(gram_key(shorter), return_index=True, return_inverse=True)
        held.append(shorter[:, first])
        counts.append(np.bincount(place).astype(float))  # continuations
        up.append(place)
    lower = np.array([letter[int(x)] for x in held[-1][1] & LETTER])
    keys, values = [], []
    for k in range(len(held) - 1, -1, -1):
        contexts, fall, _, p = level(context_key(held[k]), counts[k], lower)
        keys += [contexts, gram_key(held[k])]
        values += [fall, np.log(p)]
        lower = p[up[k - 1]] if k else p
    return pd.DataFrame({"h": keyed(np.concatenate(keys), lang), "v": np.concatenate(values)})


def fit(docs: DataFrame) -> DataFrame:
    """h, v: the models of all languages, written to the scratch folder."""
    words = materialise(count_words(docs), "words")
    grams = materialise(count_grams(words), "grams")
    # order 1: letters that a letter is seen after; as many rows as the languages have letters
    single = grams.select("lang", "before", F.col("b").bitwiseAND(F.lit(LETTER)).alias("x")).distinct().groupBy("lang", "x").count().toPandas()
    own, letter = [], {}
    for lang, rows in single.groupby("lang"):
        entries, p = fit_letters(lang, rows["x"].to_numpy(), rows["count"].to_numpy())
        own.append(entries)
        letter[lang] = dict(zip(rows["x"].tolist(), p.tolist(), strict=True))

    def group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return fit_group(pdf, key[0], letter[key[0]])

    out = grams.groupBy("lang", "before").applyInPandas(group, "h long, v double")
    if own:
        out = out.unionByName(docs.sparkSession.createDataFrame(pd.concat(own), "h long, v double"))
    return materialise(out, "model")


class Model:
    """Sorted hash arrays in parts; nats of words, remembered up to a bound."""

    def __init__(self, parts: list):
        self.parts, self.known = parts, {}

    def nats(self, words: set[bytes], lang: str) -> dict[bytes, float]:
        """Minus the log-probability of each word and its end."""
        known = self.known.setdefault(lang, {})
        if sum(map(len, self.known.values())) > REMEMBERED:
            self.known.clear()
            known = self.known.setdefault(lang, {})
        new = list(words.difference(known))
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            grams, word = letter_grams(part)
            known.update(zip(part, np.bincount(word, -self.logs(grams, lang), len(part)).tolist(), strict=True))
        return known

    def logs(self, grams: np.ndarray, lang: str) -> np.ndarray:
        """Log-probability of the last letter of each n-gram."""
        _, first, place = np.unique(gram_key(grams), return_index=True, return_inverse=True)
        grams = grams[:, first]
        out, open_ = np.zeros(len(first)), np.arange(len(first))
        for size in range(ORDER, 0, -1):
            short = suffix(grams[:, open_], size)
            seen, value = self.find(keyed(gram_key(short), lang))
            out[open_[seen]] += value[seen]
            open_, short = open_[~seen], short[:, ~seen]
            if not len(open_):
                break
            _, value = self.find(keyed(context_key(short), lang))
            out[open_] += value
        return out[place]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is in any part, and its number (0 if not)."""
        seen, value = np.zeros(len(keys), bool), np.zeros(len(keys))
        for shared in self.parts:
            own, at = shared.value.find(keys)
            value[own] = shared.value.values[0][at[own]]
            seen |= own
            if len(self.parts) > 1:  # one part's arrays at a time
                vars(shared).pop("_value", None)
        return seen, value


FEATURES = T.StructType([T.StructField(f"__{c}", T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("__nats", T.DoubleType())])


def base(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    data = utf8(text)
    w = data.split()
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in data.split(b"\n") if x.strip()] if "\n" in text else []
    return len(w), len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated(w)


def repeated(w: list[bytes], size: int = 3) -> int:
    """Words inside windows of `size` words that are found twice or more."""
    windows = list(zip(*(w[i:] for i in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    first: dict = {}
    marked = bytearray(len(w))
    for i, x in enumerate(windows):
        j = first.setdefault(x, i)
        if j != i:
            marked[i : i + size] = b"\1" * size
            marked[j : j + size] = b"\1" * size
    return sum(marked)


def shared_parts(model: DataFrame) -> list:
    """The model's arrays, broadcast in parts of about MOST_ENTRIES entries at most."""
    sc, n = model.sparkSession.sparkContext, model.count()
    parts = max(1, -(-n // MOST_ENTRIES))
    out = []
    for p in range(parts):
        got = model.where(F.pmod("h", F.lit(parts)) == p).select("h", F.col("v").cast("float").alias("v")).toArrow()
        out.append(sc.broadcast(Lookup(got.column("h").to_numpy(), got.column("v").to_numpy())))
    return out


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep, the tag __lang, and FEATURES of each document, written to the scratch folder."""
    parts = shared_parts(fit(docs))
    rows = docs.withColumn("__lang", language(F.col("lang")))

    def work():
        model = Model(parts)

        def run(texts, langs):
            columns = [list(c) for c in zip(*map(base, texts), strict=True)]
            words = [utf8(t).split() for t in texts]
            by: dict[str, set] = {}
            for lang, w in zip(langs, words, strict=True):
                by.setdefault(lang, set()).update(w)
            nats = [0.0] * len(texts)
            for lang, found in by.items():
                known = model.nats(found, lang)
                for i, (own, w) in enumerate(zip(langs, words, strict=True)):
                    if own == lang and w:
                        nats[i] = sum(map(known.__getitem__, w)) / len(w)
            return [*columns, nats]

        return run

    out = materialise(map_rows(rows, ["text", "__lang"], FEATURES, work, [*keep, "__lang"]), "measured")
    for shared in parts:  # the rows are written; nothing reads the model again
        shared.destroy()
    return out


def bands(measured: DataFrame) -> DataFrame:
    """Median and spread of the nats a word by language, over documents that pass the fixed rules; 677 rows at most."""
    per = measured.where(~_base_failed()).select("__lang", "__nats")
    middle = per.groupBy("__lang").agg(F.percentile_approx("__nats", 0.5, 10_000).alias("__mid"))
    off = per.join(F.broadcast(middle), "__lang")
    spread = F.percentile_approx(F.abs(F.col("__nats") - F.col("__mid")), 0.5, 10_000) * 1.4826
    return off.groupBy("__lang").agg(F.first("__mid").alias("__mid"), F.greatest(spread, F.lit(LEAST_SPREAD)).alias("__spread"))


def _base_failed():
    return (F.col("__n_words") < MIN_WORDS) | (100 * F.col("__n_repeat_words") > REPEAT_PERCENT * F.col("__n_words"))


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep with FEATURES, __lang, __base_failed, __perplexity (a word), __kept and the bounds __lower and __upper."""
    measured = measure(docs, keep)
    wide = measured.join(F.broadcast(bands(measured)), "__lang", "left").withColumn("__base_failed", _base_failed())
    reach = BAND * F.col("__spread") + SHORT / F.sqrt(F.greatest(F.col("__n_words"), F.lit(1)))
    wide = wide.withColumn("__lower", F.exp(F.col("__mid") - reach)).withColumn("__upper", F.exp(F.col("__mid") + reach)).withColumn("__perplexity", F.exp("__nats"))
    inside = F.coalesce(F.col("__perplexity").between(F.col("__lower"), F.col("__upper")), F.lit(True))
    return wide.withColumn("__kept", ~F.col("__base_failed") & inside)


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of each document, and its
    perplexity with the bounds that decide."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity", "lower", "upper"]
    return judged(docs, ["doc_id"]).select("doc_id", *[F.col(f"__{c}").alias(c) for c in names])


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    rows, back = set_aside(docs, "text", "lang")
    return back(judged(rows, rows.columns).where("__kept"))
