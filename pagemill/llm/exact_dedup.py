"""Exact dedup by deterministic block naming (operator 6).

The normalised text (white space deleted) is cut into blocks of fixed size. Blocks are sorted by content and equal ones
get one integer name; then adjacent pairs of names are named, and so on, until each text has one name. Together with its
number of blocks that name is its identity: equal texts, and only these, share it, with no hash involved.

A map task first collapses what repeats within it, blocks and whole texts, in a table of bounded bytes. What is sorted
later holds a content once for each task at most, so a text with a third of all rows doesn't swamp a task.

Cases: null counts as empty, and all empty texts are one group; of repeated rows (same id and text) one is kept; the row
with the most code points stays, then the smallest ``doc_id`` (nulls last); an empty table returns no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pagemill.session import materialise, ship_code

SPACE = b" \t\n\x0b\x0c\r"
ROWS = "kind int, ref long, content binary, slots long, names array<long>, doc_id long, class_ref long, code_points long, sha256 string"
ARROW = pa.schema([("kind", pa.int32()), ("ref", pa.int64()), ("content", pa.binary()), ("slots", pa.int64()), ("names", pa.list_(pa.int64())), ("doc_id", pa.int64()), ("class_ref", pa.int64()), ("code_points", pa.int64()), ("sha256", pa.string())])
BLOCK, CLASS, DOC = 0, 1, 2


def _split(block_bytes: int, table_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_ref = TaskContext.get().partitionId() << 36
        blocks: dict[bytes, int] = {}
        classes: dict[tuple, tuple[int, str]] = {}
        held = 0
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py() or ""
                raw = text.encode().translate(None, SPACE)
                names = []
                for at in range(0, len(raw), block_bytes):
                    content = raw[at : at + block_bytes]
                    ref = blocks.get(content)
                    if ref is None:
                        blocks[content] = ref = next_ref
                        rows.append((BLOCK, ref, content, None, None, None, None, None, None))
                        next_ref, held, size = next_ref + 1, held + len(content) + 100, size + len(content)
                    names.append(ref)
                found = classes.get(key := tuple(names))
                if found is None:
                    classes[key] = found = (next_ref, hashlib.sha256(raw).hexdigest())
                    rows.append((CLASS, next_ref, None, len(names), names, None, None, None, None))
                    next_ref, held = next_ref + max(1, len(names)), held + 250 + 8 * len(names)
                rows.append((DOC, next_ref, None, None, None, doc_id, found[0], len(text), found[1]))
                next_ref += 1
                if held > table_bytes:
                    blocks, classes, held = {}, {}, 0
                if size > 4 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def exact_groups(docs: DataFrame, block_bytes: int = 1024, table_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs`` (doc_id, text)."""
    ship_code(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_split(block_bytes, table_bytes), ROWS)
    rows = materialise(rows, "blocks", partition_by=["kind"])

    blocks = rows.where(F.col("kind") == BLOCK).select("ref", "content")
    names = blocks.select("ref", F.min("ref").over(Window.partitionBy("content")).alias("name"))
    classes = rows.where(F.col("kind") == CLASS).select(F.col("ref").alias("class_ref"), F.col("slots").alias("n_blocks"), "names")
    longest = classes.agg(F.max("n_blocks")).first()[0] or 0

    level = classes.select("class_ref", F.posexplode("names").alias("idx", "ref")).join(names, "ref")
    level = level.select("class_ref", F.col("idx").cast("long").alias("idx"), (F.col("class_ref") + F.col("idx")).alias("slot"), "name")
    step = 0
    while longest > 1:
        odd = F.col("idx") % 2 == 1
        pairs = level.groupBy("class_ref", F.shiftright("idx", 1).alias("idx")).agg(F.min("slot").alias("slot"), F.min(F.when(~odd, F.col("name"))).alias("a"), F.min(F.when(odd, F.col("name"))).alias("b"))
        named = F.min("slot").over(Window.partitionBy("a", "b"))
        level = pairs.select("class_ref", "idx", "slot", F.when(F.col("b").isNull(), F.col("a")).otherwise(named).alias("name"))
        longest, step = (longest + 1) // 2, step + 1
        if step % 5 == 0 and longest > 1:
            level = materialise(level, "block-names")
    identity = classes.select("class_ref", "n_blocks").join(level.select("class_ref", "name"), "class_ref", "left")
    identity = identity.select("class_ref", "n_blocks", F.coalesce("name", F.lit(-1)).alias("name"))

    members = rows.where(F.col("kind") == DOC).select("ref", "doc_id", "class_ref", "code_points", "sha256")
    best = F.min(F.struct((-F.col("code_points")).alias("fewer"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "ref")).alias("best")
    local = members.groupBy("class_ref").agg(F.count(F.lit(1)).alias("n"), best)
    sized = materialise(identity.join(local, "class_ref"), "exact-classes")
    groups = sized.groupBy("n_blocks", "name").agg(F.sum("n").alias("group_size"), F.min("best").alias("best"))
    chosen = sized.select("class_ref", "n_blocks", "name").join(groups, ["n_blocks", "name"]).select("class_ref", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.ref").alias("keep_ref"))
    return members.join(chosen, "class_ref").select("doc_id", "keep_id", "group_size", (F.col("ref") == F.col("keep_ref")).alias("kept"), F.col("sha256").alias("text_sha256"))
