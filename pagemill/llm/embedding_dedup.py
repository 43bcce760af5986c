"""Embedding near-dedup by Euclidean p-stable hashing (operator 7).

Vectors are normalised; each of ``tables`` hash tables quantises ``hashes`` Gaussian projections, floor((a.x + b) / width),
into one bucket key. Vectors with equal labels that share a bucket are checked by exact cosine in double precision.

Equal vectors of a label are one class from the start. A pair of classes is counted in the first table where it meets,
so link counts add up over tables with no table of pairs; what leaves a task is one count for each class in it and the
spanning forest of its links. Buckets of over ``slice_rows`` classes are cut into slices and each pair of slices is a
group of its own. At cosine 0.93 a pair meets in some table with probability 0.98, above that more often.

Cases: vectors that are null, empty, zero or hold null or non-finite numbers, and those with a null label, link with
nothing; vectors of another length than their partner link with nothing; repeated rows link with one another; ties need
no rule, all links count; an empty table returns no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.components import connected_components
from pagemill.session import materialise, ship_code


def projections(dim: int, tables: int, hashes: int, width: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions (dim, tables * hashes) and offsets: the same in every task."""
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, tables * hashes)), rng.uniform(0, width, tables * hashes)


def bucket_keys(unit: np.ndarray, tables: int, hashes: int, width: float) -> np.ndarray:
    """64-bit bucket keys (rows, tables) of unit vectors: the quantised projections of a table, mixed."""
    a, b = projections(unit.shape[1], tables, hashes, width)
    cells = np.floor((unit @ a + b) / width).astype(np.int64).reshape(len(unit), tables, hashes)
    key = np.zeros(cells.shape[:2], np.uint64)
    for k in range(hashes):
        key = (key ^ cells[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric link matrix."""
    n = len(near)
    label, parent = np.arange(n), np.full(n, -1)
    near = near | np.eye(n, dtype=bool)
    while True:
        seen = np.where(near, label[None, :], n)
        best = seen.argmin(axis=1)
        low = seen[np.arange(n), best]
        moved = low < label
        if not moved.any():
            return [(int(i), int(parent[i])) for i in np.nonzero(parent >= 0)[0]]
        parent[moved], label = best[moved], low


class Rows:
    """Rows of sorted groups as arrays; vectors and keys are read from their flat columns."""

    def __init__(self, table: pa.Table, tables: int):
        column = lambda k: table.column(k).combine_chunks()
        self.t, self.key, self.lo, self.hi, self.side, self.node, self.copies = (column(k).to_numpy() for k in range(1, 8))
        self.keys = column(8).flatten().to_numpy().reshape(-1, tables)
        vectors = column(9)
        self.begin = vectors.offsets.to_numpy()[:-1].astype(np.int64)
        self.dims = np.diff(vectors.offsets.to_numpy())
        self.values = vectors.values.to_numpy(zero_copy_only=False)
        label = np.array(table.column(0).to_pylist(), object)
        same = (label[1:] == label[:-1]) & np.all([c[1:] == c[:-1] for c in (self.t, self.key, self.lo, self.hi)], axis=0)
        self.starts = np.concatenate([[0], np.flatnonzero(~same.astype(bool)) + 1])


def _links(rows: Rows, begin: int, end: int, cosine: float, out: list[tuple]) -> None:
    """Link counts (node, links, null) and forest edges (node, 0, other) of one pair of slices of a bucket."""
    within = rows.lo[begin] == rows.hi[begin]
    for dim in np.unique(rows.dims[begin:end]):
        at = begin + np.flatnonzero(rows.dims[begin:end] == dim)
        if len(at) < 2:
            continue
        unit = rows.values[rows.begin[at][:, None] + np.arange(dim)]
        unit = unit / np.abs(unit).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        near = unit @ unit.T >= cosine
        np.fill_diagonal(near, False)
        if not within:
            near &= rows.side[at][:, None] != rows.side[at][None, :]
        if not near.any():
            continue
        own, node = rows.keys[at], rows.node[at]
        left, right = np.nonzero(near)
        t = int(rows.t[begin])
        counted = (own[left, :t] == own[right, :t]).any(axis=1)  # in an earlier table
        near[left[counted], right[counted]] = False
        links = near @ rows.copies[at]
        out += [(int(node[i]), int(links[i]), None) for i in np.nonzero(links)[0]]
        out += [(int(node[i]), 0, int(node[j])) for i, j in _forest(near)]


def _found(out: list[tuple]) -> pa.RecordBatch:
    columns = zip(*out, strict=True) if out else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "links", "other"])


FOUND = "node long, links long, other long"


def embedding_groups(vectors: DataFrame, cosine: float = 0.93, tables: int = 28, hashes: int = 12, width: float = 2.0, slice_rows: int = 512) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    ship_code(spark)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    rows = materialise(rows.withColumn("usable", usable), "vectors")

    classes = rows.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).to_pylist()
            found: list = [None] * len(lists)
            for dim in {len(x) for x in lists}:
                at = [i for i, x in enumerate(lists) if len(x) == dim]
                raw = np.array([lists[i] for i in at], np.float64)
                raw /= np.abs(raw).max(axis=1, keepdims=True)
                for i, k in zip(at, bucket_keys(raw / np.linalg.norm(raw, axis=1, keepdims=True), tables, hashes, width), strict=True):
                    found[i] = k.tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(found, pa.list_(pa.int64()))], ["label", "embedding", "node", "copies", "keys"])

    classes = classes.mapInArrow(keys, "label string, embedding array<double>, node long, copies long, keys array<long>")
    classes = materialise(classes, "vector-classes")
    keyed = classes.select("node", "label", F.posexplode("keys").alias("t", "key"))
    sizes = keyed.groupBy("label", "t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = keyed.join(sizes, ["label", "t", "key"])
    keyed = keyed.withColumn("slices", F.ceil(F.col("n") / slice_rows)).withColumn("own", F.pmod(F.xxhash64("node"), F.col("slices")))
    mates = F.transform(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("lo"), F.greatest(k, F.col("own")).alias("hi")))
    keyed = keyed.select("label", "t", "key", "node", "own", F.explode(mates).alias("m"))
    keyed = keyed.select("label", "t", "key", "m.lo", "m.hi", "node", F.when(F.col("own") == F.col("m.lo"), 0).otherwise(1).alias("side"))
    body = classes.select("node", F.col("label").alias("own_label"), "embedding", "copies", "keys")
    keyed = keyed.join(body, (keyed["node"] == body["node"]) & (keyed["label"] == body["own_label"])).drop(body["node"]).drop("own_label")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        out: list[tuple] = []

        def take(table: pa.Table, whole: bool) -> pa.Table | None:
            """Links of the groups of ``table``; its last one may go on and is returned, unless it is ``whole``."""
            if not len(table):
                return None
            rows = Rows(table, tables)
            ends = [*rows.starts[1:].tolist(), len(table)]
            for begin, end in zip(rows.starts.tolist(), ends if whole else ends[:-1], strict=False):
                if end - begin > 1:
                    _links(rows, begin, end, cosine, out)
            return None if whole else table.slice(int(rows.starts[-1]))

        for batch in batches:
            table = pa.Table.from_batches([batch])
            left = take(pa.concat_tables([left, table]) if left is not None else table, False)
            if len(out) > 50_000:
                yield _found(out)
                out = []
        if left is not None:
            take(left, True)
        yield _found(out)

    group = ["label", "t", "key", "lo", "hi"]
    sorted_groups = keyed.select(*group, "side", "node", "copies", "keys", "embedding").repartition(*group).sortWithinPartitions(*group)
    found = materialise(sorted_groups.mapInArrow(compare, FOUND), "vector-links")
    parts = connected_components(found.where("other is not null").select(F.col("node").alias("src"), F.col("other").alias("dst")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("label", "embedding", "node", "copies").join(parts, "node", "left").join(counts, "node", "left")
    named = named.select("label", "embedding", F.coalesce("component", "node").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = rows.where("usable").join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
