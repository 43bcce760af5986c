"""Greedy runs over the items of a document that may be larger than a task: chunks over sentences, prompts over segments.

Where a run ends, and where the next one begins, depends on the item at which it begins and on the few that follow. So a
document is cut into blocks of items, each with the first items of the block behind it. A block tells for each item at which
a run from before may enter it where the runs leave it and how many they are. These jumps are doubled in joins, 1, 2, 4 ...
blocks at a time, which gives the place and the number at which each block is entered; then every block writes its own runs.
No row and no group holds more than a block, and texts don't travel: items are numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pagemill.session import discard, materialise, ship_code


def numbered(rows: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """``rows`` with their number in their document (``doc_id``), from 0 by ``order``; rows without document are left out.

    Rows are sorted in ranges and counted by range, so a large document is spread over many tasks. They are written once.
    """
    spread = rows.where("doc_id is not null").repartitionByRange("doc_id", *order).sortWithinPartitions("doc_id", *order)
    placed = materialise(spread.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    ranges = placed.groupBy("doc_id", "_range").agg(F.min("_at").alias("_begin"), F.count(F.lit(1)).alias("_held"))
    before = F.coalesce(F.sum("_held").over(Window.partitionBy("doc_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("_before", before).drop("_held")
    return placed.join(ranges, ["doc_id", "_range"]).withColumn(name, F.col("_at") - F.col("_begin") + F.col("_before")).drop("_range", "_at", "_begin", "_before")


def runs_from(weights: np.ndarray, limit: int, most_items: int, overlap: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The end of the run that begins at each item, and the begin of the next one.

    A run takes items while their weights sum up to ``limit`` at most and there are no more than ``most_items``, but one in
    any case. The next begins at its end or, with ``overlap``, at the first item from which at most that weight is left;
    where not even one item is as light as that, at the run's last item if it has two.
    """
    sums = np.concatenate([[0], np.cumsum(weights, dtype=np.int64)])
    at = np.arange(len(weights))
    end = np.searchsorted(sums, sums[:-1] + limit, side="right") - 1
    end = np.minimum(np.maximum(end, at + 1), at + most_items)
    if not overlap:
        return end, end
    back = np.searchsorted(sums, sums[end] - overlap, side="left")
    back = np.where(back >= end, end - 1, back)
    return end, np.maximum(back, at + 1)


def _exits(block_items: int, halo: int, rule: tuple):
    """A map over (doc_id, block, weights): where runs that enter a block at an item leave it, and how many begin in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, entries, targets, counts = [], [], [], []
            for row, (block, weights) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                own = weights.values.to_numpy(zero_copy_only=False)
                if len(own) <= block_items:
                    continue  # the last block of its document
                ends, after = (x.tolist() for x in runs_from(own, *rule))
                known: dict[int, tuple[int, int]] = {}
                for entry in range(1 if block == 0 else halo):
                    path, at = [], entry
                    while at < block_items and at not in known and ends[at] < len(own):
                        path.append(at)
                        at = after[at]
                    if at in known:
                        leaves, count = known[at]
                    else:  # behind the block, or (-1) the document ends with the run that begins here
                        leaves, count = (at, 0) if at >= block_items else (-1, 0)
                    for step in reversed(path):
                        count += 1
                        known[step] = leaves, count
                    if leaves >= 0:
                        source.append(row)
                        entries.append(entry)
                        targets.append(leaves - block_items)
                        counts.append(count)
            picked = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked), pa.array(entries, pa.int64()), pa.array(targets, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "block", "entry", "target", "links"])

    return run


def _written(block_items: int, rule: tuple):
    """A map over (doc_id, block, weights, entry, links): the runs that begin in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, numbers, firsts, ends = [], [], [], []
            for row, (block, weights, at, link) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                own = weights.values.to_numpy(zero_copy_only=False)
                end, after = (x.tolist() for x in runs_from(own, *rule))
                base = block * block_items
                while at < min(block_items, len(own)):
                    source.append(row)
                    numbers.append(link)
                    firsts.append(base + at)
                    ends.append(base + end[at])
                    if end[at] == len(own):
                        break
                    at, link = after[at], link + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *(pa.array(x, pa.int64()) for x in (numbers, firsts, ends))], ["doc_id", "link", "first", "end"])

    return run


def greedy_links(items: DataFrame, limit: int, most_items: int, overlap: int | None = None, block_items: int = 4096) -> DataFrame:
    """doc_id, link, first, end: the runs of each document over ``items`` (doc_id, n from 0 without gaps, weight).

    A run is as :func:`runs_from` says; ``link`` counts a document's runs from 0, ``end`` is the item behind the last.
    """
    spark = items.sparkSession
    ship_code(spark)
    halo = most_items + 1  # an item beyond the longest run tells that the document goes on
    block_items = max(block_items, halo)
    rule = (limit, most_items, overlap)
    doc = items.schema["doc_id"].dataType.simpleString()
    own = items.select("doc_id", "n", F.col("weight").cast("int").alias("weight"), F.expr(f"n div {block_items}").alias("block"))
    shared = own.where(F.expr(f"block > 0 and n % {block_items} < {halo}")).withColumn("block", F.col("block") - 1)
    grouped = own.unionByName(shared).groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(F.struct("n", "weight"))).alias("held"))
    blocks = materialise(grouped.select("doc_id", "block", F.transform("held", lambda x: x["weight"]).alias("weights")), "blocks")
    last = blocks.agg(F.max("block")).first()[0] or 0
    starts = blocks.withColumns({"entry": F.lit(0).cast("long"), "links": F.lit(0).cast("long")})
    if last:
        jumps = materialise(blocks.mapInArrow(_exits(block_items, halo, rule), f"doc_id {doc}, block long, entry long, target long, links long"), "jumps")
        # the blocks behind the first, and at which item and run they are entered
        reached = materialise(jumps.where("block = 0").select("doc_id", F.lit(1).cast("long").alias("block"), F.col("target").alias("entry"), "links"), "reached")
        step = 1
        while step < last:
            beyond = jumps.select("doc_id", "block", "entry", F.col("target").alias("_target"), F.col("links").alias("_links"))
            ahead = reached.join(beyond, ["doc_id", "block", "entry"]).select("doc_id", (F.col("block") + step).alias("block"), F.col("_target").alias("entry"), (F.col("links") + F.col("_links")).alias("links"))
            more = materialise(reached.unionByName(ahead), "reached")
            second = beyond.select("doc_id", (F.col("block") - step).alias("block"), F.col("entry").alias("target"), "_target", "_links")
            doubled = jumps.join(second, ["doc_id", "block", "target"]).select("doc_id", "block", "entry", F.col("_target").alias("target"), (F.col("links") + F.col("_links")).alias("links"))
            doubled = materialise(doubled, "jumps")
            discard(spark, reached, jumps)
            reached, jumps, step = more, doubled, 2 * step
        discard(spark, jumps)
        behind = blocks.where("block > 0").join(reached, ["doc_id", "block"])
        starts = starts.where("block = 0").unionByName(behind)
    return starts.select("doc_id", "block", "weights", "entry", "links").mapInArrow(_written(block_items, rule), f"doc_id {doc}, link long, first long, end long")


def members(links: DataFrame, items: DataFrame) -> DataFrame:
    """``items`` (doc_id, n, ...) with the ``link`` of each run that holds them, once a run."""
    return links.select("doc_id", "link", F.explode(F.sequence("first", F.col("end") - 1)).alias("n")).join(items, ["doc_id", "n"])
