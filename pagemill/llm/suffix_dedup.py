"""Removal of repeated byte strings with a logarithmic family of sparse suffix indexes (operator 2).

A byte goes if some string of ``length`` bytes that covers it also starts elsewhere. Any such string holds an anchor: the
least hash (leftmost on ties) among its ``gram``-byte strings, so equal strings have their anchors at the same place in
them. Only suffixes at anchors, about 1 in 85, are indexed; what an anchor stands for is its region, the run of strings
that it is the anchor of.

Batches of documents are indexed one after the other. A batch's suffixes are sorted by the hash of their first ``gram``
bytes (order matters only for merging, since a match of ``length`` bytes needs equality, so a hash serves as well as the
bytes), scanned against every level of the family for entries that meet, and become a level of their own; levels of equal
size are merged first. Levels are tables bucketed and sorted by that key, so scans are merge joins without a shuffle.

Suffixes that met others are compared by content: equal regions (128 bits of hash with the key) repeat as a whole; where
one key has different regions, the strings of one region each are compared, aligned at the anchor.

Cases: null and empty texts, and those shorter than ``length``, lose nothing; runs of one character and long texts are
handled like others (texts are hashed in parts of bounded size); repeated rows and copies lose all that is covered;
``doc_id`` may be null or repeated; an empty table returns no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemill.session import discard, materialise, ship_code

PART = 1 << 20
HOT_SHARE = 1000
POSITION = np.uint64((1 << 27) - 1)
ANCHORS = "ref long, batch int, key long, content long, start int, strings int, anchor int"


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every ``gram`` bytes (a power of two), by doubling."""
    rng = np.random.default_rng(5)
    h = rng.integers(0, 2**63, 256, dtype=np.uint64)[data]
    step = 1
    while step < gram:
        h = h[:-step] * np.uint64(rng.integers(0, 2**62) * 2 + 1) + h[step:]
        h ^= h >> np.uint64(32)
        step *= 2
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def regions(parts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts of ``length`` bytes or more: text number, first string, strings, anchor (from that), key, content hash."""
    import xxhash

    flat = b"".join(parts)
    data = np.frombuffer(flat, np.uint8)
    sizes = np.array([len(p) for p in parts])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    hashes = gram_hashes(data, gram)
    least = sliding_min((hashes & ~POSITION) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
    anchor = (least & POSITION).astype(np.int64)
    whole = np.zeros(len(data) + 1, np.int32)  # strings that lie in one text
    np.add.at(whole, begin, 1)
    np.add.at(whole, begin + sizes - length + 1, -1)
    at = np.flatnonzero(np.cumsum(whole)[: len(anchor)])
    new = np.concatenate([[True], (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1)])
    first = at[new]
    text = np.searchsorted(begin, first, "right") - 1
    last = np.concatenate([at[np.flatnonzero(new)[1:] - 1], at[-1:]])
    view, digest = memoryview(flat), xxhash.xxh3_64_intdigest
    content = np.fromiter((digest(view[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)), np.uint64, len(first))
    return text, first - begin[text], last - first + 1, anchor[first] - first, hashes[anchor[first]].view(np.int64), content.view(np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    packer, ref = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 36
    for batch in batches:
        texts = [(t.as_py() or "").encode() for t in batch.column(1)]
        refs = pa.array(range(ref, ref + len(texts)), pa.int64())
        ref += len(texts)
        yield pa.RecordBatch.from_arrays([refs, batch.column(0), pa.array([packer.compress(t) for t in texts], pa.binary())], ["ref", "doc_id", "packed"])


def _unpack(packed) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed.as_py())


def _find(length: int, gram: int, batches_of_docs: int):
    names = [c.split()[0] for c in ANCHORS.split(", ")]

    def rows(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        text, start, strings, anchor, key, content = regions([h[2] for h in held], length, gram)
        ref, offset = np.array([h[0] for h in held])[text], np.array([h[1] for h in held])[text]
        columns = [ref, (ref % batches_of_docs).astype(np.int32), key, content, (start + offset).astype(np.int32), strings.astype(np.int32), anchor.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            for ref, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = _unpack(packed)
                for at in range(0, max(len(raw) - length + 1, 0), PART):  # each part has the strings that start in it
                    held.append((ref, at, raw[at : at + PART + length - 1]))
                    if (size := size + len(held[-1][2])) >= PART:
                        yield rows(held)
                        held, size = [], 0
        if held:
            yield rows(held)

    return run


class IndexFamily:
    """Levels of suffix keys; a level is a table bucketed and sorted by key, with its size in batches."""

    def __init__(self, spark: SparkSession):
        self.spark, self.levels, self.made = spark, [], []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def store(self, keys: DataFrame) -> str:
        name = f"suffix_level_{uuid.uuid4().hex}"
        keys.select("key").write.bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        self.made.append(name)
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.made.remove(name)

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Index a batch (key); returns its keys that meet another suffix, of the batch or of a level.

        ``hot`` marks those with over a ``HOT_SHARE``-th of the batch's suffixes, so at most as many a batch.
        """
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * size, self.store(self.spark.table(a).unionByName(self.spark.table(b)).distinct())))
            self.drop(a)
            self.drop(b)
        counted = materialise(suffixes.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "suffix-batch")
        total = counted.agg(F.sum("n")).first()[0] or 0
        batch = self.store(counted)
        met = counted.where("n > 1").select("key", (F.col("n") > total / HOT_SHARE).alias("hot"))
        for _, level in self.levels:
            more = self.spark.table(batch).join(self.spark.table(level).hint("merge"), "key", "left_semi")
            met = met.unionByName(more.select("key", F.lit(False).alias("hot")))
        met = materialise(met.groupBy("key").agg(F.bool_or("hot").alias("hot")), "suffix-matches")
        self.levels.append((1, batch))
        discard(self.spark, counted)
        return met

    def close(self) -> None:
        for name in list(self.made):
            self.drop(name)


def _align(length: int, regions_at: list[tuple], out: list) -> None:
    """Rows (key, content, anchor, region bytes) of whole keys -> runs of strings that occur in two regions of a key."""
    import xxhash

    seen: dict[tuple, int] = {}
    twice: set[tuple] = set()
    strings = []
    for i, (key, _, anchor, raw) in enumerate(regions_at):
        view = memoryview(raw)
        own = [(key, j - anchor, xxhash.xxh3_64_intdigest(view[j : j + length])) for j in range(len(raw) - length + 1)]
        strings.append(own)
        for s in own:
            if seen.setdefault(s, i) != i:
                twice.add(s)
    for (key, content, _, _), own in zip(regions_at, strings, strict=True):
        runs: list[list[int]] = []
        for j, s in enumerate(own):
            if s in twice:
                if runs and runs[-1][1] == j:
                    runs[-1][1] = j + 1
                else:
                    runs.append([j, j + 1])
        out += [(key, content, a, b) for a, b in runs]


def matched(anchors: DataFrame, met: DataFrame) -> DataFrame:
    """The ``anchors`` whose key is in ``met`` (key, hot).

    Hot keys, of which there are at most ``HOT_SHARE`` a batch, are broadcast: their anchors don't meet in one task.
    """
    met = materialise(met.groupBy("key").agg(F.bool_or("hot").alias("hot")), "met-suffixes")
    hot = F.broadcast(met.where("hot").select("key"))
    rest = anchors.join(hot, "key", "left_anti").join(met.where("not hot").select("key"), "key")
    return anchors.join(hot, "key").unionByName(rest)


def duplicate_spans(store: DataFrame, length: int, gram: int, batches_of_docs: int, hot_regions: int = 2000) -> DataFrame:
    """ref, spans (array of first and end byte) of the texts that hold strings which occur elsewhere too."""
    spark = store.sparkSession
    anchors = materialise(store.select("ref", "packed").mapInArrow(_find(length, gram, batches_of_docs), ANCHORS), "anchors", ["batch"])
    family, met = IndexFamily(spark), None
    try:
        for batch in range(batches_of_docs):
            own = family.add(anchors.where(F.col("batch") == batch).select("key"))
            met = own if met is None else met.unionByName(own)
        found = materialise(matched(anchors.drop("batch"), met), "matched-suffixes")
    finally:
        family.close()
    discard(spark, anchors)

    each = found.groupBy("key", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ref", "start", "strings", "anchor")).alias("one"))
    each = materialise(each, "regions")
    whole = each.where("n > 1").select("key", "content", F.lit(0).alias("a"), F.col("one.strings").alias("b"))
    many = each.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    mixed = each.join(many, "key").select("key", "content", "m", "one.*")
    wanted = mixed.groupBy("ref").agg(F.collect_list(F.struct("key", "content", "m", "start", "strings", "anchor")).alias("regions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for packed, wants in zip(batch.column(0), batch.column(1), strict=True):
                raw = _unpack(packed)
                for w in wants.as_py():
                    rows.append((w["key"], w["content"], w["m"], w["anchor"], raw[w["start"] : w["start"] + w["strings"] + length - 1]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["key", "content", "m", "anchor", "raw"])

    texts = store.join(wanted.hint("shuffle_hash"), "ref").select("packed", "regions").mapInArrow(cut, "key long, content long, m long, anchor int, raw binary")
    texts = materialise(texts, "region-texts")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def rows(now: list[tuple]) -> pa.RecordBatch:
            out: list[tuple] = []
            _align(length, now, out)
            columns = zip(*out, strict=True) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["key", "content", "a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if len(held) >= 200 and held[-1][0] != row[0]:
                    yield rows(held)
                    held = []
                held.append(row)
        if held:
            yield rows(held)

    cold = texts.where(F.col("m") <= hot_regions).select("key", "content", "anchor", "raw")
    some = cold.repartition("key").sortWithinPartitions("key").mapInArrow(align, "key long, content long, a int, b int")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for key, content, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                n = len(raw) - length + 1
                own = np.array([xxhash.xxh3_64_intdigest(raw[j : j + length]) for j in range(n)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([content] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(own)], ["key", "content", "j", "string"])

    hot = texts.where(F.col("m") > hot_regions).select("key", "content", "raw").mapInArrow(strings, "key long, content long, j int, string long")
    shared = hot.groupBy("key", "string").agg(F.min("content").alias("lo"), F.max("content").alias("hi")).where("lo <> hi").select("key", "string")
    more = hot.join(shared, ["key", "string"]).select("key", "content", F.col("j").alias("a"), (F.col("j") + 1).alias("b"))

    runs = whole.unionByName(some).unionByName(more).groupBy("key", "content").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    spans = found.select("key", "content", "ref", "start").join(runs, ["key", "content"])
    spans = spans.select("ref", F.transform("runs", lambda r: F.struct((F.col("start") + r["a"]).alias("first"), (F.col("start") + r["b"] + length - 1).alias("end"))).alias("spans"))
    return spans.groupBy("ref").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 32, batches_of_docs: int = 4, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``kept`` (bytes) for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    ship_code(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    store = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pack, "ref long, doc_id long, packed binary")
    store = store.repartition(parts, "ref").persist(StorageLevel.DISK_ONLY)
    spans = materialise(duplicate_spans(store, length, gram, batches_of_docs), "byte-spans")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, packed, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = kept = _unpack(packed)
                runs = 0
                if found:
                    gone = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(gone, [s["first"] for s in found], 1)
                    np.add.at(gone, [s["end"] for s in found], -1)
                    mask = np.cumsum(gone)[:-1] > 0
                    runs = int(np.count_nonzero(np.diff(mask.astype(np.int8), prepend=0) == 1))
                    kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                rows.append((doc_id, len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = store.join(spans.hint("shuffle_hash"), "ref", "left").select("doc_id", "packed", "spans")
    return out.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
