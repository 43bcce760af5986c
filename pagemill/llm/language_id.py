"""Language identification by hashed subword embeddings (operator 13).

A word is the mean of the vectors of its hashed byte n-grams (with boundary marks), a text the mean of its words, and a linear
softmax on that gives the languages. Vectors and softmax are trained jointly by stochastic gradient descent in numpy on a
bounded sample of the labelled rows: ``sample_rows`` rows a language, those with the smallest hashes, each with at most
``row_windows`` windows of words spread evenly over its whole text, however long it is.

A fifth of the sampled rows isn't trained on but calibrates: a temperature that makes scores fit how often predictions are
right, and the least score at which predictions are right with a share of ``precision``. Texts under that score are rejected.

What a trained n-gram adds to a text's logits is one number a language, so a table of fixed size is all that the tasks get.

Cases: null texts and texts without a letter are ``und`` with score 0 and not accepted; long texts count whole; repeated rows
and ties are scored alike (ties go to the language that sorts first); rows without a language or a letter don't train; with
one language every text with letters gets it, with none every text is ``und``; an empty table returns no rows; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pagemill.session import discard, materialise, ship_code

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
SIZES = (2, 3, 4)
MAX_WORDS = 200_000
#: words of the windows that are sampled from a text, in turn
WINDOWS = (60, 20, 5, 60)


def words_of(text: str | None) -> list[str]:
    """The words of a text, in lower case; none if no character of it is a letter."""
    words = WORD.findall((text or "").lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def grams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the marked words, a column a size (``buckets`` where a word ends before), the rows' first places and the words' numbers of n-grams."""
    raw = [b"<%b>" % w.encode() for w in words]
    sizes = np.array([len(r) for r in raw], np.int64)
    ends = np.cumsum(sizes)
    byte = np.frombuffer(b"".join(raw) + bytes(max(SIZES)), np.uint8).astype(np.uint64)
    n = len(byte) - max(SIZES)
    left = np.repeat(ends, sizes) - np.arange(n)
    out = np.full((n, len(SIZES)), buckets, np.int64)
    state, k = byte[:n].copy(), 0
    for size in range(2, max(SIZES) + 1):
        state = state * np.uint64(0x100000001B3) + byte[size - 1 : size - 1 + n] + np.uint64(size)
        if size in SIZES:
            mixed = (state ^ (state >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            inside = left >= size
            out[inside, k] = ((mixed >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)[inside]
            k += 1
    return out, ends - sizes, sum(np.maximum(sizes - s + 1, 0) for s in SIZES)


class LanguageModel:
    """What training leaves: the learned languages, a logit a language for each bucket (and a last row of zeros), biases, temperature, least score."""

    def __init__(self, langs: list[str], logits: np.ndarray, bias: np.ndarray, temperature: float = 1.0, least_score: float = 0.0):
        self.langs, self.logits, self.bias, self.temperature, self.least_score = langs, logits, bias, temperature, least_score

    def word_logits(self, words: list[str]) -> np.ndarray:
        found, starts, count = grams(words, len(self.logits) - 1)
        summed = sum(self.logits[found[:, k]] for k in range(found.shape[1]))
        return np.add.reduceat(summed, starts, axis=0) / count[:, None]

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        """Of the texts whose words' logits have these means."""
        z = (means + self.bias) / self.temperature
        odds = np.exp(z - z.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)


def train(windows: list[list[str]], labels: np.ndarray, langs: list[str], buckets: int = 1 << 16, dim: int = 8, epochs: int = 12, rate: float = 4.0, batch: int = 64, seed: int = 11) -> LanguageModel:
    """Joint training by gradient descent on batches of windows, in a new order each epoch; the rate falls to nothing."""
    rng = np.random.default_rng(seed)
    distinct = sorted({w for words in windows for w in words})
    number = {w: k for k, w in enumerate(distinct)}
    found, starts, count = grams(distinct, buckets)
    ends = np.append(starts[1:], len(found))
    table = rng.uniform(-1, 1, (buckets + 1, dim)) / dim
    table[buckets] = 0
    head, bias = np.zeros((dim, len(langs))), np.zeros(len(langs))
    rows = [np.array([number[w] for w in words]) for words in windows]
    steps, step = max(1, epochs * -(-len(rows) // batch)), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            own = order[at : at + batch]
            now = rate * (1 - step / steps)
            step += 1
            word = np.concatenate([rows[k] for k in own])
            owner = np.repeat(np.arange(len(own)), [len(rows[k]) for k in own])
            share = 1 / np.array([len(rows[k]) for k in own])
            size = (ends - starts)[word]
            place = np.repeat(starts[word] - np.cumsum(size) + size, size) + np.arange(size.sum())
            gram = found[place].ravel()
            text = np.repeat(owner, size * len(SIZES))
            weight = np.repeat(share[owner] / count[word], size * len(SIZES)) * (gram < buckets)
            mean = np.stack([np.bincount(text, weight * table[gram, d], len(own)) for d in range(dim)], axis=1)
            z = mean @ head + bias
            odds = np.exp(z - z.max(axis=1, keepdims=True))
            error = odds / odds.sum(axis=1, keepdims=True)
            error[np.arange(len(own)), labels[own]] -= 1
            error /= len(own)
            back = error @ head.T
            head -= now * mean.T @ error
            bias -= now * error.sum(axis=0)
            for d in range(dim):
                table[:, d] -= now * buckets**0.5 / 4 * np.bincount(gram, weight * back[text, d], buckets + 1)
    logits = table @ head
    logits[buckets] = 0
    return LanguageModel(langs, logits, bias)


def calibrate(model: LanguageModel, windows: list[list[str]], labels: np.ndarray, precision: float) -> None:
    """Sets the temperature and the least score of ``model`` by windows that it wasn't trained on."""
    if not windows:
        return
    means = np.stack([model.word_logits(words).mean(axis=0) for words in windows])

    def loss(temperature: float) -> float:
        model.temperature = temperature
        return float(-np.log(np.maximum(model.probabilities(means)[np.arange(len(labels)), labels], 1e-12)).mean())

    model.temperature = min((2.0**k for k in np.arange(-4, 4.25, 0.25)), key=loss)
    p = model.probabilities(means)
    score, right = p.max(axis=1), p.argmax(axis=1) == labels
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(share >= precision)
    model.least_score = float(score[order[good[-1]]]) if len(good) else 1.0


def fit(docs: DataFrame, sample_rows: int = 600, row_windows: int = 4, max_langs: int = 500, precision: float = 0.99, **training) -> LanguageModel | None:
    """A model from ``docs`` (text, lang) or None if no row has a language and a letter.

    The sample has at most ``sample_rows`` texts for each of at most ``max_langs`` languages (those with most texts).
    """
    ship_code(docs.sparkSession)
    labelled = docs.where("lang is not null and text is not null and text rlike '\\\\p{L}'").select("lang", "text", F.xxhash64("text").alias("key"))
    texts = materialise(labelled.select("lang", "key").distinct(), "labelled-texts")
    counts = texts.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return None
    # hashes are even, so the share below a bound is known: only twice the rows that are wanted meet in a language's window
    bounds = [(r["lang"], min(2**64, 2**64 * (2 * sample_rows + 200) // r["count"]) - 2**63 - 1) for r in counts]
    low = texts.join(F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, bound long")), "lang").where("key <= bound")
    chosen = low.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("r") <= sample_rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, key, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                words, found = words_of(text.as_py()), []
                for k in range(row_windows):
                    size = WINDOWS[k % len(WINDOWS)]
                    begin = max(len(words) - size, 0) * k // max(row_windows - 1, 1)
                    found.append(" ".join(words[begin : begin + size]))
                found = list(dict.fromkeys(w for w in found if w))
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(found), pa.string()), pa.array([key.as_py()] * len(found), pa.int64()), pa.array(found, pa.string())], ["lang", "key", "words"])

    sampled = labelled.join(F.broadcast(chosen.select("lang", "key")), ["lang", "key"]).select("lang", "key", "text").mapInArrow(cut, "lang string, key long, words string")
    rows = sorted({(r["lang"], r["key"], r["words"]) for r in sampled.collect()})
    discard(docs.sparkSession, texts)
    number = {lang: k for k, lang in enumerate(langs)}
    windows, labels = [r[2].split(" ") for r in rows], np.array([number[r[0]] for r in rows], np.int64)
    held = np.array([r[1] % 5 == 0 for r in rows], bool)
    if held.all():
        held[:] = False
    model = train([w for w, h in zip(windows, held, strict=True) if not h], labels[~held], langs, **training)
    calibrate(model, [w for w, h in zip(windows, held, strict=True) if h], labels[held], precision)
    return model


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, lang_pred, score, accepted; nothing but the text counts."""
    spark = docs.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        n_langs = len(own.langs) if own else 1
        limit = max(20_000, min(MAX_WORDS, 8_000_000 // n_langs))
        new: list[str] = []

        class Numbers(dict):
            def __missing__(self, word: str) -> int:
                self[word] = len(self)
                new.append(word)
                return len(self) - 1

        numbers, known = Numbers(), np.zeros((0, n_langs))

        def scored(held: list[list[str]]) -> tuple[list[str], np.ndarray, list[bool]]:
            nonlocal known
            names, score, sure = [UNKNOWN] * len(held), np.zeros(len(held)), [False] * len(held)
            some = [k for k, words in enumerate(held) if words]
            if not some or own is None:
                return names, score, sure
            if len(numbers) > limit:
                numbers.clear()
                known = known[:0]
            ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(held)), np.int64)
            if new:
                known = np.concatenate([known, own.word_logits(new)])
                new.clear()
            sizes = np.array([len(held[k]) for k in some])
            owner = np.repeat(np.arange(len(some)), sizes)
            means = np.stack([np.bincount(owner, known[ids, d], len(some)) for d in range(n_langs)], axis=1) / sizes[:, None]
            p = own.probabilities(means)
            for k, best, top in zip(some, p.argmax(axis=1), p.max(axis=1), strict=True):
                names[k], score[k], sure[k] = own.langs[best], top, bool(top >= own.least_score)
            return names, score, sure

        for batch in batches:
            parts, held, size = [], [], 0
            for text in batch.column(1):
                held.append(words_of(text.as_py()))
                size += len(held[-1])
                if size > 100_000:
                    parts.append(scored(held))
                    held, size = [], 0
            parts.append(scored(held))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for p in parts for n in p[0]], pa.string()), pa.array(np.concatenate([p[1] for p in parts])), pa.array([s for p in parts for s in p[2]], pa.bool_())],
                ["doc_id", "lang_pred", "score", "accepted"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1
