"""Toxicity by subword bags (operator 10).

A word is the mean of the vectors of its hashed character n-grams (with boundary marks, and the word itself); a text is
the mean of its words; a linear softmax on that gives the score. Vectors and softmax are trained jointly in numpy on a
bounded, balanced sample of the labelled rows: ``sample_rows`` in all, drawn by the smallest hash of their id, and of these as
many as hold ``sample_bytes`` together. Texts of any length train, each whole. A misspelling that training never saw shares most of its n-grams with what it did see.

The softmax has two classes, so what a trained n-gram adds to a text's margin is one number. Those numbers, of fixed
count, are all that is sent to the tasks that score.

Cases: null and empty texts, and those without words, get the score of the bias alone; long texts count whole; repeated
rows score alike; of several texts with one id the least trains; rows without a label, or labelled 0 and 1 at once, don't train; with no rows of one label, every score
is the share of toxic labels (0.5 if there are none); an empty table returns no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagemill.session import discard, materialise, ship_code

WORD = re.compile(r"\w+")
MAX_WORDS = 400_000
AT_ONCE = 1 << 18


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def ngram_buckets(word: str, buckets: int, sizes: tuple[int, int] = (3, 5)) -> list[int]:
    """Hash buckets of the n-grams of a marked word, and of the word itself."""
    marked = f"<{word}>"
    grams = {marked} | {marked[i : i + n] for n in range(sizes[0], sizes[1] + 1) for i in range(len(marked) - n + 1)}
    return sorted(crc32(g.encode()) % buckets for g in grams)


class SubwordModel:
    """What training leaves: one margin for each n-gram bucket, a scale and a bias."""

    def __init__(self, margins: np.ndarray, bias: float):
        self.margins, self.bias = margins, bias

    def word_margin(self, word: str) -> float:
        return float(self.margins[ngram_buckets(word, len(self.margins))].mean())


def train(texts: list[str], toxic: np.ndarray, prior: float, buckets: int = 1 << 17, dim: int = 4, epochs: int = 60, rate: float = 0.3, scale: float = 60.0, decay: float = 1e-3, damping: float = 1.0, least_share: float = 0.005, prior_weight: float = 0.7, seed: int = 7) -> SubwordModel:
    """Joint training by Adam over the whole sample; the bias is moved from the sample's balance towards ``prior``.

    It goes ``prior_weight`` of the way, in log odds: a toxic text that is missed counts more than a false alarm.

    ``damping`` adds the gradients' size over all of a parameter to that of each number: what rarely occurs moves less.

    Only buckets met in a ``least_share`` of the texts, and in two at least, have a vector; those of the others are zero. ``scale`` multiplies the mean
    of a text's words, which is small where few of them matter.
    """
    vocabulary: dict[str, int] = {}
    # a text's words are counted as it is read: what is held grows with its distinct words
    cols, counts, distinct, per_doc = array("i"), array("i"), array("i"), array("i")
    for text in texts:
        found = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)), np.int32)
        own, count = np.unique(found, return_counts=True)
        cols.frombytes(own.tobytes())
        counts.frombytes(count.astype(np.int32).tobytes())
        distinct.append(len(own))
        per_doc.append(max(len(found), 1))
    doc, word = np.repeat(np.arange(len(texts), dtype=np.int32), np.array(distinct, np.int32)), np.array(cols, np.int32)
    weight = (scale * np.array(counts, np.int64) / np.array(per_doc, np.int64)[doc]).astype(np.float32)
    del cols, counts
    grams, sizes = array("i"), array("i")
    for w in vocabulary:
        own = ngram_buckets(w, buckets)
        grams.extend(own)
        sizes.append(len(own))
    n_words = len(vocabulary)
    del vocabulary
    gram, sizes = np.array(grams, np.int32), np.array(sizes, np.int32)
    del grams
    owner = np.repeat(np.arange(n_words, dtype=np.int32), sizes)

    # texts that a bucket occurs in, counted by way of the words that hold it
    texts_of_word = np.bincount(word, minlength=n_words)
    met = np.bincount(gram, texts_of_word[owner], buckets)
    keep = met[gram] >= max(2, round(least_share * len(texts)))
    gram, owner = gram[keep], owner[keep]
    held = np.bincount(gram, minlength=buckets) > 0
    used, gram = np.flatnonzero(held), (np.cumsum(held, dtype=np.int32) - 1)[gram]
    share = (1 / sizes).astype(np.float32)[owner]

    def pooled(index: np.ndarray, source: np.ndarray, factor: np.ndarray, n: int):
        """values -> for each index, the sum of factor * values[source]; the order is made once, sums by blocks of about ``AT_ONCE`` terms."""
        order = np.argsort(index, kind="stable")
        sizes = np.bincount(index, minlength=n)
        at = np.flatnonzero(sizes)
        ends = np.cumsum(sizes[at])
        starts = ends - sizes[at]
        source, factor = source[order], factor[order, None]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(starts // AT_ONCE)) + 1, [len(at)]]) if len(at) else np.zeros(1, np.int64)

        def run(values: np.ndarray) -> np.ndarray:
            out = np.zeros((n, values.shape[1]), np.float32)
            for low, high in pairwise(cuts.tolist()):
                first, end = starts[low], ends[high - 1]
                out[at[low:high]] = np.add.reduceat(values[source[first:end]] * factor[first:end], starts[low:high] - first, axis=0)
            return out

        return run

    to_words, to_grams = pooled(owner, gram, share, n_words), pooled(gram, owner, share, len(used))
    to_texts, from_texts = pooled(doc, word, weight, len(texts)), pooled(word, doc, weight, n_words)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (len(used), dim)).astype(np.float32) / dim
    head, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    params = [vectors, head, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    target = np.stack([1 - toxic, toxic], axis=1).astype(np.float32)
    for epoch in range(1, epochs + 1):
        mean = to_texts(to_words(vectors))
        logits = mean @ head + bias
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        error = (odds / odds.sum(axis=1, keepdims=True) - target) / len(texts)
        grads = [to_grams(from_texts(error @ head.T)), mean.T @ error, error.sum(axis=0)]
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            size = np.sqrt(v / (1 - 0.99**epoch))
            p -= rate * (m / (1 - 0.9**epoch) / (size + damping * np.sqrt((size * size).mean()) + 1e-12) + decay * p)
    margins = np.zeros(buckets, np.float32)
    margins[used] = scale * vectors @ (head[:, 1] - head[:, 0])
    sampled = toxic.mean()
    moved = prior_weight * (np.log(prior / (1 - prior)) - np.log(sampled / (1 - sampled)))
    return SubwordModel(margins, float(bias[1] - bias[0] + moved))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, sample_bytes: int = 24 << 20) -> SubwordModel | float:
    """A model, or the constant score where one label is missing. ``labels``: doc_id, toxic.

    The sample is ``sample_rows // 2`` rows of each label. Where these hold more than half of ``sample_bytes``, the last ones in
    the order of their hashes stay out, whatever their own lengths, but for the first of a label.
    """
    fair = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
    fair = fair.where("toxic = most").select("doc_id", "toxic")
    counts = {r["toxic"]: r["count"] for r in fair.groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return float(counts.get(1, 0) > 0) if counts else 0.5
    texts = docs.where("text is not null").select("doc_id", "text")
    order = F.xxhash64("doc_id")
    chosen = None
    for label in (0, 1):  # twice as many as needed: some have no text
        own = fair.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(sample_rows)
        chosen = own if chosen is None else chosen.unionByName(own)
    # sizes first, then only the texts that fit together
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = materialise(found.withColumn("size", F.octet_length("text")), "labelled-texts")
    rows = []
    for label in (0, 1):
        own = found.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(sample_rows // 2)
        total, fits = 0, []
        for row in own.select("doc_id", "size").collect():
            total += row["size"]
            if fits and total > sample_bytes // 2:
                break
            fits.append(row["doc_id"])
        rows += own.limit(len(fits)).collect()
    discard(docs.sparkSession, found)
    toxic = np.array([r["toxic"] for r in rows], float)
    if len(set(toxic)) < 2:
        return 0.5
    return train([r["text"] for r in rows], toxic, counts[1] / (counts[0] + counts[1]))


def scores(docs: DataFrame, model: SubwordModel | float) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, score; nothing but the text counts."""
    spark = docs.sparkSession
    if isinstance(model, float):
        return docs.select("doc_id", F.lit(model).alias("score"))
    ship_code(spark)
    shared = spark.sparkContext.broadcast((model.margins, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SubwordModel(*shared.value)

        class Margins(dict):
            def __missing__(self, word: str) -> float:
                found = own.word_margin(word)
                if len(self) < MAX_WORDS:
                    self[word] = found
                return found

        margins = Margins()
        for batch in batches:
            found = []
            for text in batch.column(1):
                words = words_of(text.as_py())
                found.append(sum(map(margins.__getitem__, words)) / max(len(words), 1) + own.bias)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.array(found, float))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
