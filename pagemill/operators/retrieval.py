"""Hybrid retrieval for a batch of queries: dense candidates, BM25, local reranking, context packing, citations.

Chunks: chunk_id, doc_id, page, text, vector (unit). Queries: query_id, text, vector. Scoring is brute force, the stated
semantics: blocks of ``block`` queries at a time meet every chunk as one matrix product in each Arrow batch, which keeps
its best ``k`` a query; only ids and similarities are shuffled, and the chunks of the winners are joined back. Queries may
be bound to documents of their own (``scope``), as those of a session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pagemill.functions.text import query_tokens, space_tokens, strip, token_estimate, truncated, two_places, word_tokens
from pagemill.functions.vectors import dot
from pagemill.session import materialise, ship_code

PLACES = 9


def _ranked(frame: DataFrame, score: str, ties: list[str], k: int, name: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), *ties)
    return frame.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def _nearest(asked: list[tuple], k: int, at_once: int = 64):
    """A map over batches of (chunk_id, vector, numbers): query number, chunk_id, similarity of the best ``k`` a query in each.

    ``asked``: (query_id, vector, bound). ``numbers``: the bound queries that may search the chunk. Some queries at a time meet a batch.
    """
    wanted = np.array([vector for _, vector, _ in asked], np.float64)
    bound = np.array([bool(b) for _, _, b in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False))
            if not len(at) or not asked:
                continue
            vectors = batch.column(1).drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[at]
            ties = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
            lists = batch.column(2).take(pa.array(at))
            numbers = lists.flatten().to_numpy(zero_copy_only=False)
            places = np.repeat(np.arange(len(at)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            for first in range(0, len(wanted), at_once):
                scores = np.round(np.clip(wanted[first : first + at_once] @ vectors.T, 0.0, 1.0), PLACES)
                if bound[first : first + at_once].any():
                    barred = np.repeat(bound[first : first + at_once, None], len(at), axis=1)
                    own = (numbers >= first) & (numbers < first + at_once)
                    barred[numbers[own] - first, places[own]] = False
                    scores[barred] = -1.0
                order = np.lexsort((np.broadcast_to(ties, scores.shape), -scores), axis=1)[:, :k] if len(ids) > k else np.broadcast_to(np.arange(len(ids)), scores.shape)
                number = np.repeat(np.arange(first, first + len(scores), dtype=np.int32), order.shape[1])
                best = np.take_along_axis(scores, order, axis=1).ravel()
                fits = best >= 0
                yield pa.RecordBatch.from_arrays([pa.array(number[fits]), pa.array(ids[order].ravel()[fits]), pa.array(best[fits])], ["number", "chunk_id", "similarity"])

    return run


def dense_search(queries: DataFrame, chunks: DataFrame, k: int = 30, allowed: dict[str, list] | None = None, scope: DataFrame | None = None, block: int = 2048) -> DataFrame:
    """The ``k`` nearest chunks of each query by cosine, clamped to [0, 1]; ties by chunk id.

    ``allowed`` maps columns to lists of values and filters before anything is scored. ``scope`` (query_id, doc_id) names
    the documents of queries that may not search all; a query without rows in it does.
    """
    spark = queries.sparkSession
    ship_code(spark)
    for column, values in (allowed or {}).items():
        chunks = chunks.where(F.col(column).isin(values))
    asked = queries.where("vector is not null").select("query_id", "vector")
    if scope is not None:
        asked = asked.join(scope.select("query_id", F.lit(True).alias("bound")).distinct(), "query_id", "left")
    else:
        asked = asked.withColumn("bound", F.lit(False))
    kept = chunks.select("chunk_id", F.col("vector").cast("array<double>").alias("vector"), "doc_id")
    found = []

    def search(rows: list[tuple]) -> None:
        numbers = spark.createDataFrame([(n, row[0]) for n, row in enumerate(rows)], f"number int, query_id {queries.schema['query_id'].dataType.simpleString()}")
        if scope is not None:  # a document holds the numbers of its queries, a block of them at most; no task holds a query's documents
            own = scope.join(F.broadcast(numbers), "query_id").groupBy("doc_id").agg(F.collect_set("number").alias("numbers"))
            met = kept.join(own, "doc_id", "left").select("chunk_id", "vector", "numbers")
        else:
            met = kept.select("chunk_id", "vector", F.lit(None).cast("array<int>").alias("numbers"))
        hits = met.mapInArrow(_nearest(rows, k), f"number int, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, similarity double")
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(F.col("similarity").desc(), "chunk_id"))).where(F.col("rank") <= k)
        found.append(hits.join(F.broadcast(numbers), "number").select("query_id", "chunk_id", "similarity", "rank"))

    held: list[tuple] = []
    for row in asked.orderBy("query_id").toLocalIterator():  # the stated query set, a block at a time
        held.append(tuple(row))
        if len(held) == block:
            search(held)
            held = []
    if held or not found:
        search(held)
    nearest = materialise(reduce(DataFrame.unionByName, found), "nearest")
    return chunks.join(nearest, "chunk_id").select("query_id", *chunks.columns, "similarity", "rank")


def hybrid_scores(queries: DataFrame, candidates: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``candidates`` with bm25 (statistics of each query's candidates), its share of the best, and 0.7 / 0.3 hybrid."""
    candidates = materialise(candidates, "candidates")
    terms = queries.select("query_id", F.explode(F.array_distinct(word_tokens(F.col("text")))).alias("term"))
    words = candidates.select("query_id", "chunk_id", word_tokens(F.col("text")).alias("words"))
    sizes = words.select("query_id", "chunk_id", F.size("words").alias("size"))
    stats = sizes.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"))
    tf = words.select("query_id", "chunk_id", F.explode("words").alias("term")).join(terms, ["query_id", "term"]).groupBy("query_id", "chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.greatest(F.col("mean"), F.lit(1.0))))
    bm25 = tf.join(df, ["query_id", "term"]).join(stats, "query_id").join(sizes, ["query_id", "chunk_id"]).groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight), PLACES).alias("bm25"))
    joined = candidates.join(bm25, ["query_id", "chunk_id"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    best = F.max("bm25").over(Window.partitionBy("query_id"))
    joined = joined.withColumn("keyword", F.when(best > 0, F.col("bm25") / best).otherwise(0.0))
    return joined.withColumn("hybrid", F.round(0.7 * F.col("similarity") + 0.3 * F.col("keyword"), PLACES))


def rerank(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """``candidates`` with ``score``: 0.3 overlap + 0.7 (cosine + 1) / 2 where the cosine is positive, else the overlap."""
    own = queries.select("query_id", query_tokens(F.col("text")).alias("wanted"), F.col("vector").alias("query_vector"))
    joined = candidates.join(own, "query_id")
    overlap = F.when(F.size("wanted") > 0, F.size(F.array_intersect("wanted", space_tokens(F.col("text")))) / F.size("wanted")).otherwise(0.0)
    cosine = dot(F.col("vector"), F.col("query_vector"))
    score = F.when(cosine > 0, 0.3 * overlap + 0.7 * (cosine + 1) / 2).otherwise(overlap)
    return joined.withColumn("score", F.bround(F.round(score, PLACES), 4)).drop("wanted", "query_vector")


#: texts of queries and of chunks, pair by pair -> a score each
Scorer = Callable[[list[str], list[str]], list[float]]


def scored_by(scorer: Callable[[], Scorer], batch_size: int = 32) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A reranker that takes scores from a model: it stands in for :func:`rerank`.

    ``scorer`` makes the model, once in each task; the model then gets ``batch_size`` pairs of texts at a time. Where it
    fails, gives another number of scores, or scores that aren't finite, the batch keeps the score of :func:`rerank`.
    """

    def run(queries: DataFrame, candidates: DataFrame) -> DataFrame:
        ship_code(queries.sparkSession)
        fallback = rerank(queries, candidates).join(queries.select("query_id", F.coalesce("text", F.lit("")).alias("_asked")), "query_id")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                model = scorer()
            except Exception:
                model = None
            for batch in batches:
                for at in range(0, batch.num_rows, batch_size):
                    part = batch.slice(at, batch_size)
                    names = part.schema.names
                    asked, texts = (part.column(names.index(c)).to_pylist() for c in ("_asked", "text"))
                    try:
                        own = np.array(model(asked, [t or "" for t in texts]), np.float64)
                        fits = own.shape == (part.num_rows,) and bool(np.isfinite(own).all())
                    except Exception:
                        fits = False
                    columns = [pa.array(own) if n == "score" and fits else part.column(k) for k, n in enumerate(names)]
                    yield pa.RecordBatch.from_arrays(columns, names)

        return fallback.mapInArrow(score, fallback.schema).drop("_asked").withColumn("score", F.bround(F.round("score", PLACES), 4))

    return run


def retrieve(
    queries: DataFrame, chunks: DataFrame, candidates: int = 30, limit: int = 5, least: float = 0.05, allowed: dict[str, list] | None = None, scope: DataFrame | None = None, reranker: Callable[[DataFrame, DataFrame], DataFrame] = rerank
) -> DataFrame:
    """The best chunks of each query: dense candidates, hybrid order, then the score of ``reranker`` decides."""
    found = hybrid_scores(queries, dense_search(queries, chunks, candidates, allowed, scope))
    found = found.withColumn("hybrid_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("hybrid").desc(), "rank")))
    found = reranker(queries, found).where(F.col("score") >= least)
    return _ranked(found, "score", ["hybrid_rank"], limit, "final_rank").select("query_id", F.col("final_rank").alias("rank"), "chunk_id", "doc_id", "page", "text", "score", "similarity", "keyword", "hybrid")


def pack_context(hits: DataFrame, budget: int = 4000, header: int = 30) -> DataFrame:
    """The hits (query_id, rank, chunk_id, doc_id, page, text) that fit a budget of tokens, in the order of the context.

    Of equal texts the first counts; taking stops at the first hit that doesn't fit. Documents come in the order of their
    first hit, their chunks by page.
    """
    first = Window.partitionBy("query_id", F.lower(strip(F.col("text")))).orderBy("rank")
    kept = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    spent = F.sum(token_estimate(F.col("text")) + header).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    kept = kept.withColumn("tokens_so_far", spent).where(F.col("tokens_so_far") <= budget)
    lead = F.min("rank").over(Window.partitionBy("query_id", "doc_id"))
    return kept.withColumn("lead", lead).withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("lead", "page", "rank"))).drop("lead")


def context_text(packed: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, context, tokens: the packed chunks under the names of their documents (doc_id, name)."""
    ship_code(packed.sparkSession)
    named = packed.join(names, "doc_id", "left").withColumn("name", F.coalesce("name", F.lit("Unknown Source")))
    new = F.col("position") == F.min("position").over(Window.partitionBy("query_id", "doc_id"))
    head = F.when(new, F.concat(F.when(F.col("position") > 1, "\n").otherwise(""), F.lit("=== SOURCE DOCUMENT: "), "name", F.lit(" ===\n"))).otherwise("")
    part = F.concat(head, F.format_string("[Page %d | Relevance: %s]:\n%s\n---", "page", two_places(F.col("score")), "text"))
    rows = named.select("query_id", F.struct("position", part.alias("part")).alias("p"), "tokens_so_far")
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["part"]), "\n").alias("context"), F.max("tokens_so_far").alias("tokens"))


def cite(packed: DataFrame, names: DataFrame) -> DataFrame:
    """Citations of packed hits in rank order: name and a snippet of at most 200 characters."""
    joined = packed.join(names, "doc_id", "left")
    return joined.select("query_id", "rank", "doc_id", "page", F.coalesce("name", F.lit("Source Document")).alias("document_name"), truncated(strip(F.col("text")), 200, 197).alias("snippet"), "score")


def diagnostics(hits: DataFrame, names: DataFrame) -> DataFrame:
    """What :func:`retrieve` found and why: names, pages, the three scores with their defaults, and the first 120 characters."""
    joined = hits.join(names, "doc_id", "left")
    score = lambda c, other: F.coalesce(c, other).alias(f"{c}_score")
    named = F.coalesce("name", F.col("doc_id").cast("string")).alias("document_name")
    return joined.select("query_id", "rank", "chunk_id", "doc_id", named, "page", score("hybrid", F.col("score")), score("similarity", F.col("score")), score("keyword", F.lit(0.0)), truncated(F.col("text"), 120).alias("preview"))
