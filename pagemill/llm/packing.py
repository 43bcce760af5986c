"""Bounded-space online packing of token sequences (operator 1).

Each partition keeps a fixed number of open windows. A piece goes to the window where it leaves the smallest gap; where
none has room, the fullest window takes the head of the piece, is emitted full, and the rest is placed again. At the end
of a partition its open windows are chained into full ones, which leaves one at most; those are merged in rounds over
groups of partitions, so no task ever holds more than ``fan_in`` of them.

Cases: null and empty texts are one piece with the end id alone; long texts fill whole windows; repeated rows are packed
each; a null ``doc_id`` is carried; an empty table returns no rows; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from pagemill.llm.wordtokens import chunk_table, encode, read_tokenizer
from pagemill.session import materialise, ship_code

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, part long, final boolean, ids binary"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("final", pa.bool_()), ("ids", pa.binary())])


class Windows:
    """The open windows of one task. A piece is (doc_id, start, doc_tokens, packed ids)."""

    def __init__(self, size: int, count: int, first_id: int):
        self.size, self.count, self.next_id = size, count, first_id
        self.gaps: list[tuple[int, int]] = []  # (gap, slot), sorted
        self.open: dict[int, list] = {}
        self.slots = 0
        self.done: list[tuple] = []

    def emit(self, pieces: list, part: int = 0, final: bool = True) -> None:
        offset = 0
        for doc_id, start, doc_tokens, ids in pieces:
            n = len(ids) // 4
            self.done.append((doc_id, start, n, doc_tokens, self.next_id, offset, part, final, ids))
            offset += n
        self.next_id += 1

    def add(self, doc_id, start: int, doc_tokens: int, ids: bytes) -> None:
        while ids:
            n = len(ids) // 4
            if n >= self.size:
                head = self.size
                self.emit([(doc_id, start, doc_tokens, ids[: 4 * head])])
            else:
                at = bisect_left(self.gaps, (n, -1))
                if at < len(self.gaps):  # the smallest gap that has room
                    gap, slot = self.gaps.pop(at)
                    self.open[slot].append((doc_id, start, doc_tokens, ids))
                    self.settle(slot, gap - n)
                    return
                if len(self.gaps) < self.count:
                    self.slots += 1
                    self.open[self.slots] = [(doc_id, start, doc_tokens, ids)]
                    self.settle(self.slots, self.size - n)
                    return
                head, slot = self.gaps.pop(0)  # the fullest
                self.emit([*self.open.pop(slot), (doc_id, start, doc_tokens, ids[: 4 * head])])
            start, ids = start + head, ids[4 * head :]

    def settle(self, slot: int, gap: int) -> None:
        if gap:
            insort(self.gaps, (gap, slot))
        else:
            self.emit(self.open.pop(slot))

    def close(self, part: int) -> None:
        """Chain the open windows; what is left is one window that isn't final."""
        pieces = [p for slot in sorted(self.open) for p in self.open[slot]]
        self.gaps, self.open = [], {}
        rest, room = [], self.size
        for doc_id, start, doc_tokens, ids in pieces:
            while ids:
                head = min(room, len(ids) // 4)
                rest.append((doc_id, start, doc_tokens, ids[: 4 * head]))
                start, ids, room = start + head, ids[4 * head :], room - head
                if not room:
                    self.emit(rest)
                    rest, room = [], self.size
        if rest:
            self.emit(rest, part, final=False)

    def take(self) -> list[tuple]:
        rows, self.done = self.done, []
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def _merger(size: int, first_id: int, last: bool):
    """Chains the windows of one group; the ``last`` round also emits what doesn't fill one."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["group"].iloc[0])
        windows = Windows(size, 1, first_id + (part << 32))
        pdf = pdf.sort_values(["sequence_id", "offset"])
        windows.open[0] = [(None if pd.isna(d) else int(d), int(s), int(t), i) for d, s, t, i in zip(pdf["doc_id"], pdf["start"], pdf["doc_tokens"], pdf["ids"], strict=True)]
        windows.close(part)
        rows = pd.DataFrame([(*r[:7], r[7] or last, r[8]) for r in windows.take()], columns=ARROW.names)
        return rows.astype({"doc_id": "Int64"})

    return merge


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 2, open_windows: int = 64, fan_in: int = 64, derive: dict[str, Column] | None = None, keep_ids: bool = True) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in sequences: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``ids`` are little-endian unsigned 32-bit numbers. ``derive`` names further columns over these; with ``keep_ids``
    false the ids of full sequences are then not stored. Each round of merging writes what it emits to the shared folder.
    """
    spark = docs.sparkSession
    ship_code(spark)
    version, tokenizer_json = read_tokenizer(tokenizer_path)
    shared = spark.sparkContext.broadcast(tokenizer_json)
    end = np.array([end_id], "<u4").tobytes()
    derive = derive or {}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = chunk_table(version, shared.value), TaskContext.get().partitionId()
        windows = Windows(size, open_windows, part << 32)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(table, (text.as_py() or "").encode()) + end
                windows.add(doc_id, 0, len(ids) // 4, ids)
                if len(windows.done) >= 2000:
                    yield _batch(windows.take())
        windows.close(part)
        yield _batch(windows.take())

    def stored(pieces: DataFrame, label: str) -> DataFrame:
        pieces = pieces.select("*", *(F.when(F.col("final"), c).alias(n) for n, c in derive.items()))
        if not keep_ids:
            pieces = pieces.withColumn("ids", F.when(~F.col("final"), F.col("ids")))
        return materialise(pieces, label)

    found = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(place, PIECES), "pieces")
    out, rounds = found.where("final"), 0
    left = found.where("not final")
    groups = (left.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        groups, rounds = -(-groups // fan_in), rounds + 1

        group = F.floor(F.col("part") / fan_in).cast("long")
        merged = stored(left.select("doc_id", "start", "doc_tokens", "ids", "sequence_id", "offset", group.alias("group")).groupBy("group").applyInPandas(_merger(size, rounds << 58, groups == 1), PIECES), "merged-pieces")
        out = out.unionByName(merged.where("final"))
        if groups <= 1:
            return out.drop("part", "final", *([] if keep_ids else ["ids"]))
        left = merged.where("not final")
