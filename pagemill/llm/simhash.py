"""SimHash near-dedup with pigeonhole blocks (operator 3).

A fingerprint bit is set if more than half of a text's shingles have it set in their hash. Fingerprints are split into
blocks so that close ones agree on some choice of blocks; they are joined on these and verified by Hamming distance.

:func:`fingerprint_groups` is exact for 64 bits and few differing bits. Equal fingerprints are one class from the start.
A bucket (agreement on one choice of blocks) of at most ``pair_limit`` classes is joined with itself. Classes of larger
buckets take an exact way whose rows don't grow with the bucket: each emits its fingerprint and that with any one bit
flipped; two differ in at most 2 bits if and only if they share such a point, and a point has 65 classes at most.

:func:`similar_groups` is for whole texts of some similarity, where many bits differ: buckets come from blocks of a long
fingerprint over word pairs and from min-hash bands of the shingles asked for. A loose Hamming limit on a long fingerprint
over the distinct shingles sorts out what is far apart; it makes candidate groups, never a link. A bucket is compared in one
place, in pairs of slices if it is large, and only a spanning forest of its candidates leaves the task: rows grow with the
entries of buckets, never with their pairs. The texts of a candidate group, one of
each class, are then read again, and all its pairs within the limit are verified by the exact Jaccard similarity of their
shingles, unless verified links already connect them.

Cases: null and empty texts, and texts of white space, have fingerprint zero and are linked like any other; texts with
fewer words than a shingle are one shingle; copies and repeated rows share a class; an empty table returns no rows; a
null ``doc_id`` never is a component's name unless its component has no other id; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.components import connected_components
from pagemill.llm.passages import WordHashes, run_hashes, word_values
from pagemill.session import materialise, ship_code

SEED = 42
CHUNK = 1 << 13


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words; of the whole sequence if there are fewer."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64, len(words) - size + 1)


def majority(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """``lanes`` unsigned 64-bit words: each bit is 1 if set in over half the hashes. Further lanes remix the hashes."""
    counts = np.zeros((lanes, 64), np.int64)
    odd = np.array([[(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019) % 2**64 | 1] for k in range(1, lanes)], np.uint64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[None, at : at + CHUNK]
        if lanes > 1:
            more = part * odd
            more = (more ^ (more >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            part = np.concatenate([part, more ^ (more >> np.uint64(29))])
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(lanes, -1, 8), axis=2, bitorder="little")
        counts += np.add.reduce(bits, axis=1, dtype=np.uint16)
    return np.packbits(2 * counts > len(hashes), axis=1, bitorder="little").view("<u8")[:, 0]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (64 bits as a signed long) for each row of ``docs`` (doc_id, text)."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority(shingle_hashes(_words(t.as_py()), words))[0] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int, differing: int) -> list[int]:
    """The bits of each choice of ``blocks - differing`` of that many blocks: close fingerprints agree on one of them."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(pick) for pick in combinations(own, blocks - differing)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprint_links(classes: DataFrame, blocks: int = 5, pair_limit: int = 32) -> DataFrame:
    """Links (src, dst) between distinct fingerprints ``fp`` with 2 or fewer differing bits, enough to connect all such."""
    masks = block_masks(blocks, 2)
    buckets = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)))
    keyed = classes.select("fp", F.explode(buckets).alias("b")).select("fp", "b.t", "b.key")
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = materialise(keyed.join(sizes, ["t", "key"]), "fingerprint-blocks")

    cold = keyed.where(F.col("n") <= pair_limit).select("t", "key", "fp")
    other = cold.withColumnRenamed("fp", "dst")
    pairs = cold.withColumnRenamed("fp", "src").join(other, ["t", "key"]).where("src < dst")
    pairs = pairs.where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= 2).select("src", "dst")

    hot = keyed.where(F.col("n") > pair_limit).select("fp").distinct()
    points = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)))
    near = hot.select("fp", F.explode(points).alias("point")).groupBy("point").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = near.select(F.array_min("fps").alias("src"), F.explode("fps").alias("dst")).where("src <> dst")
    return pairs.unionByName(stars).distinct()


def fingerprint_groups(docs: DataFrame, words: int = 3, blocks: int = 5, pair_limit: int = 32) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of ``docs`` (doc_id, text)."""
    found = materialise(fingerprints(docs, words), "fingerprints")
    classes = found.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    parts = connected_components(fingerprint_links(classes.select("fp"), blocks, pair_limit))
    named = classes.join(parts, classes["fp"] == parts["node"], "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    named = materialise(named, "fingerprint-components")
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.select("fp", "component").join(least, "component").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _forest(bits: np.ndarray, limit: int, half: int | None) -> list[tuple[int, int]]:
    """Edges (i, j) of a spanning forest of the rows within ``limit`` differing bits. ``half``: only across that row."""
    n = len(bits)
    distance = np.zeros((n, n), np.int32)
    for lane in range(bits.shape[1]):
        distance += np.bitwise_count(bits[:, None, lane] ^ bits[None, :, lane])
    near = distance <= limit
    if half is not None:
        near[:half, :half] = False
        near[half:, half:] = False
    np.fill_diagonal(near, True)
    label = np.arange(n)
    parent = np.full(n, -1)
    while True:
        seen = np.where(near, label[None, :], n)
        best = seen.argmin(axis=1)
        low = seen[np.arange(n), best]
        if (low == label).all():
            return [(int(i), int(parent[i])) for i in np.nonzero(parent >= 0)[0]]
        moved = low < label
        parent[moved], label = best[moved], low


def min_bands(hashes: np.ndarray, bands: int, band_rows: int) -> np.ndarray:
    """For each band, the least hashes under ``band_rows`` functions as one 64-bit key (signed)."""
    least = np.full(bands * band_rows, np.iinfo(np.uint64).max, np.uint64)
    masks = np.array([[0x9E3779B97F4A7C15 * (k + 1) % 2**64] for k in range(len(least))], np.uint64)
    for at in range(0, len(hashes), CHUNK):
        h = (hashes[None, at : at + CHUNK] ^ masks) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        least = np.minimum(least, h.min(axis=1))
    key = np.zeros(bands, np.uint64)
    for column in least.reshape(bands, band_rows).T:
        key = (key ^ column) * np.uint64(0x94D049BB133111EB)
    return key.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sorted sets of hashes; 1 if both are empty."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def verified_links(bits: np.ndarray, shingles: list[np.ndarray], limit: int, similarity: float, half: int | None) -> list[tuple[int, int]]:
    """Pairs (i, j) of a spanning forest of the sets with the similarity or more. ``half``: only across that place.

    Pairs come by Hamming distance, nearest first; those beyond ``limit`` or already connected aren't verified.
    """
    n = len(bits)
    distance = np.zeros((n, n), np.int32)
    for lane in range(bits.shape[1]):
        distance += np.bitwise_count(bits[:, None, lane] ^ bits[None, :, lane])
    near = np.triu(distance <= limit, 1)
    if half is not None:
        near[:half, :half] = False
        near[half:, half:] = False
    left, right = np.nonzero(near)
    order = np.argsort(distance[left, right], kind="stable")
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    links = []
    for i, j in zip(left[order].tolist(), right[order].tolist(), strict=True):
        a, b = find(i), find(j)
        if a == b:
            continue
        sizes = len(shingles[i]), len(shingles[j])
        if min(sizes) >= similarity * max(sizes) and jaccard(shingles[i], shingles[j]) >= similarity:
            root[max(a, b)] = min(a, b)
            links.append((i, j))
    return links


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, tables: int = 24, table_bits: int = 20, lanes: int = 8, pair_limit: int = 32, slice_rows: int = 512, bands: int = 20, band_rows: int = 5, slice_shingles: int = 1 << 21) -> DataFrame:
    """(doc_id, component_id) of each row of ``docs``; texts linked by pairs of the similarity share the smallest id.

    Two texts with Jaccard similarity J of their distinct shingles meet in a band with probability 1 - (1 - J**5)**20:
    0.9996 at 0.8, wherever they differ. Blocks have ``table_bits`` bits or more, by the number of rows, so that the share of
    texts that meet by chance doesn't grow with the table. The cosine of their shingles is 2J/(1+J) or more and a bit differs with
    probability arccos(cosine)/pi at most; the limit lies 6 standard deviations above that, for sets so small that bits tie.
    """
    spark = docs.sparkSession
    ship_code(spark)
    differs = math.acos(2 * similarity / (1 + similarity)) / math.pi
    limit = math.floor(64 * lanes * differs + 6 * math.sqrt(64 * lanes * differs * (1 - differs)))
    table_bits = min(max(table_bits, docs.count().bit_length() + 5), 62)
    key_lanes = -(-tables * table_bits // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            bits, keys, sizes = [], [], []
            for t in batch.column(2):
                w = word_values((t.as_py() or "").encode().lower(), table)
                distinct = np.unique(run_hashes(w, min(words, max(len(w), 1))))
                bits.append(majority(distinct, lanes).tobytes())
                own = np.unpackbits(majority(run_hashes(w, min(2, max(len(w), 1))), key_lanes).view(np.uint8))[: tables * table_bits].reshape(tables, table_bits)
                keys.append(np.concatenate([own @ (1 << np.arange(table_bits)), min_bands(distinct, bands, band_rows)]))
                sizes.append(len(distinct))
            columns = [batch.column(0), batch.column(1), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sign", "bits", "keys", "n_shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("sign"), "text")
    found = rows.mapInArrow(run, "doc_id long, sign long, bits binary, keys array<long>, n_shingles long")
    found = materialise(found, "long-fingerprints")
    classes = found.groupBy("bits").agg(F.min(F.struct("doc_id", "sign")).alias("least"), F.min("doc_id").alias("node"), F.min("keys").alias("keys"), F.max("n_shingles").alias("n_shingles"))
    classes = materialise(classes.select("node", F.when(F.col("least.doc_id") == F.col("node"), F.col("least.sign")).alias("sign"), "bits", "keys", "n_shingles"), "long-classes")
    keyed = classes.select("node", F.posexplode("keys").alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = materialise(keyed.join(sizes, ["t", "key"]), "long-buckets")
    bits = classes.select("node", "bits")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None  # the rows of a group that may go on in the next batch
        for table in chain(batches, [None]):
            if table is None and left is None:
                return
            last = table is None
            table = left if last else table if left is None else pa.Table.from_batches([left, table]).combine_chunks().to_batches()[0]
            if not table.num_rows:
                continue
            key = np.stack([table.column(k).to_numpy() for k in range(4)])
            starts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1])
            ends = np.append(starts[1:], table.num_rows)
            left = None
            if not last:
                left, starts, ends = table.slice(int(starts[-1])), starts[:-1], ends[:-1]
            if not len(starts):
                continue
            node, side = table.column(4).to_numpy(), table.column(5).to_numpy()
            bits = np.frombuffer(b"".join(table.column(6).to_pylist()), np.uint64).reshape(-1, lanes)
            two = starts[ends - starts == 2]
            two = two[np.bitwise_count(bits[two] ^ bits[two + 1]).sum(axis=1, dtype=np.int64) <= limit]
            edges = [(two, two + 1)]
            for begin, end in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
                first = int((side[begin:end] == 0).sum())
                if found := _forest(bits[begin:end], limit, first if first < end - begin else None):
                    edges.append(tuple(np.array(found).T + begin))
            yield pa.RecordBatch.from_arrays([pa.array(node[np.concatenate([e[k] for e in edges])]) for k in (0, 1)], ["src", "dst"])

    # a bucket leaves the edges of a forest, never its pairs; a large one is cut into slices, each two of which are a group
    cut = F.when(F.col("n") <= pair_limit, F.lit(1).cast("long")).otherwise(F.ceil(F.col("n") / slice_rows))
    met = keyed.withColumn("slices", cut).withColumn("own", F.pmod(F.xxhash64("node"), F.col("slices")))
    mates = F.transform(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("lo"), F.greatest(k, F.col("own")).alias("hi")))
    met = met.select("t", "key", "node", "own", F.explode(mates).alias("m")).select("t", "key", "m.lo", "m.hi", "node", F.when(F.col("own") == F.col("m.lo"), 0).otherwise(1).alias("side"))
    met = met.join(bits, "node").select("t", "key", "lo", "hi", "node", "side", "bits").repartition("t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi", "side", "node")
    links = met.mapInArrow(compare, "src long, dst long")

    # all of a candidate group is compared, in slices of bounded rows and shingles
    groups = connected_components(links).withColumnRenamed("component", "part")
    members = classes.select("node", "sign", "n_shingles").join(groups, "node")
    slices = members.groupBy("part").agg(F.ceil(F.greatest(F.count(F.lit(1)) / slice_rows, F.sum("n_shingles") / slice_shingles)).alias("slices"))
    members = members.join(slices, "part").withColumn("own", F.pmod(F.xxhash64("node"), F.col("slices")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            held = [np.unique(run_hashes(v, min(words, max(len(v), 1)))) for v in (word_values((t.as_py() or "").encode().lower(), table) for t in batch.column(at))]
            bits = pa.array([majority(h, lanes).tobytes() for h in held], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(at)), bits, pa.array([h.tobytes() for h in held], pa.binary())], ["node", "part", "slices", "own", "bits", "shingles"])

    texts = rows.join(members.select("node", "sign", "part", "slices", "own").hint("shuffle_hash"), (F.col("doc_id") == F.col("node")) & rows["sign"].eqNullSafe(members["sign"]))
    texts = texts.select("node", "part", "slices", "own", "text").mapInArrow(sets, "node long, part long, slices long, own long, bits binary, shingles binary")
    texts = materialise(texts, "candidate-shingles")
    texts = texts.select("node", "part", "own", "bits", "shingles", F.explode(mates).alias("m"))
    texts = texts.select("part", "m.lo", "m.hi", "node", F.when(F.col("own") == F.col("m.lo"), 0).otherwise(1).alias("side"), "bits", "shingles")
    texts = texts.repartition("part", "lo", "hi").sortWithinPartitions("part", "lo", "hi", "side", "node")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}

        def links_of() -> pa.RecordBatch:
            first = sum(side == 0 for side, *_ in held.values())
            nodes = list(held)
            bits = np.frombuffer(b"".join(b for _, b, _ in held.values()), np.uint64).reshape(-1, lanes)
            edges = verified_links(bits, [np.frombuffer(s, np.uint64) for *_, s in held.values()], limit, similarity, first if first < len(nodes) else None)
            ends = ([nodes[e[k]] for e in edges] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], ["src", "dst"])

        for batch in batches:
            for part, lo, hi, node, side, bits, shingles in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if (part, lo, hi) != group:
                    if len(held) > 1:
                        yield links_of()
                    group, held = (part, lo, hi), {}
                held.setdefault(node, (side, bits, shingles))
        if len(held) > 1:
            yield links_of()

    parts = connected_components(texts.mapInArrow(linked, "src long, dst long"))
    named = classes.select("bits", "node").join(parts, "node", "left")
    least = named.select("bits", F.coalesce("component", "node").alias("component_id"))
    return found.select("doc_id", "bits").join(least, "bits").select("doc_id", "component_id")
