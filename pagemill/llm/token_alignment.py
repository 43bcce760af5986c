"""Cross-tokenizer alignment (operator 12): which tokens of a byte-level BPE and of a SentencePiece BPE cover the same bytes.

Both tokenizers run over every whole text. Neither lets a token reach over a single space between two other characters, so
each task keeps a bounded table of the chunks between such spaces that it has tokenised; the bytes of both sides' tokens are
compared with the text's. Ends that both sides share before tokens that begin with a space are the anchors: they split the
token ids of a text into windows, and the alignment of a window (its groups and links) is kept by its tuple of ids.

A link is a pair of overlapping tokens. In how many texts an id pair is linked is counted over all texts, from the distinct
pairs of each. The most frequent pairs, ``hot_pairs`` at most, meet the texts' links by a broadcast of that fixed bound; the
others, of which none has more than that share of all links, by a shuffle.

Cases: null and empty texts, and those that a tokenizer changes (a mark U+2581, normalised characters), have no tokens, zeros
and an empty ``groups_sha256``; special strings are plain text; long texts are handled whole; repeated rows return a row each
and count as a text each; a null ``doc_id`` is carried; ties for the best count all count; an empty table returns no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.sentencepiece_lattice import MARK, read_pieces
from pagemill.llm.wordtokens import BYTE_CHARACTERS
from pagemill.session import materialise, ship_code

MAX_CHUNKS = 300_000
#: the pattern by which byte-level BPE tokenizers of this kind cut a text (fixed value)
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def read_byte_level(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a byte-level BPE file whose ids follow its merges; its special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    before, model = held["pre_tokenizer"], held["model"]
    if held["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True):
        raise ValueError(f"{path} isn't a plain byte-level tokenizer")
    of_character = {c: b for b, c in BYTE_CHARACTERS.items()}
    special = {t["content"] for t in held["added_tokens"]}
    ranks = {bytes(of_character[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(model["vocab"][a + b] != 256 + k for k, (a, b) in enumerate(merges)):
        raise ValueError(f"the ids of {path} don't follow its merges")
    return ranks


#: white space at an end of a text or beside a space
AT_EDGE = re.compile(r" \s|\s |^\s|\s$")


def chunks_of(text: str) -> list[str]:
    """``text`` cut at the single spaces that stand between two characters that aren't white space."""
    parts = text.split(" ")
    if not AT_EDGE.search(text):
        return parts
    out = [parts[0]]
    for part in parts[1:]:
        if part and out[-1] and not part[0].isspace() and not out[-1][-1].isspace():
            out.append(part)
        else:
            out[-1] += " " + part
    return out


def spread(starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The places of all elements of ``rows`` of a ragged array, one row after the other."""
    own = sizes[rows]
    return np.repeat(starts[rows] - np.cumsum(own) + own, own) + np.arange(own.sum())


class Ragged:
    """Rows of different lengths in one array, to which rows are added."""

    def __init__(self, kind: type):
        self.values, self.sizes = np.zeros(0, kind), np.zeros(0, np.int64)

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values, self.sizes = np.concatenate([self.values, values.astype(self.values.dtype)]), np.concatenate([self.sizes, sizes])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def of(self, rows: np.ndarray) -> np.ndarray:
        return self.values[spread(self.starts, self.sizes, rows)]


class Windows:
    """The windows that a worker has met, by their tuples of ids: numbers of tokens and groups, the linked pairs of ids, and the
    groups as codes, 3 * id and what stands behind that id: a comma, a bar (the last of A in a group) or a semicolon (of B)."""

    def __init__(self, tokens_a: list[bytes], tokens_b: list[bytes]):
        self.size_a, self.size_b = (np.array([len(t) for t in tokens]) for tokens in (tokens_a, tokens_b))
        self.space_a, self.space_b = (np.array([t[:1] == b" " for t in tokens]) for tokens in (tokens_a, tokens_b))
        self.spelled = [f"{i}{end}" for i in range(max(len(tokens_a), len(tokens_b))) for end in ",|;"]
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.counts = np.zeros((0, 3), np.int64)  # tokens of A, of B, groups; links are the pairs
        self.pairs, self.codes = Ragged(np.int64), Ragged(np.int32)

    def add(self, a: np.ndarray, sizes_a: np.ndarray, b: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts, given as the ids of A and of B one text after the other: the numbers of their windows, and how many each has.

        Both sides of a text cover the same bytes. New windows are aligned all at once.
        """
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        texts = ends_a[np.cumsum(sizes_a) - 1]
        shared, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        anchor = np.zeros(len(shared), bool)
        anchor[:-1] = self.space_a[a[at_a[:-1] + 1]] & self.space_b[b[at_b[:-1] + 1]]
        anchor[np.searchsorted(shared, texts)] = True
        cut_a, cut_b = np.append(0, at_a[anchor] + 1), np.append(0, at_b[anchor] + 1)
        packed_a, packed_b = a.astype("<u4").tobytes(), b.astype("<u4").tobytes()
        bytes_a, bytes_b = (4 * cut_a).tolist(), (4 * cut_b).tolist()
        numbers, new, known = [], [], self.number
        for k in range(len(bytes_a) - 1):
            key = packed_a[bytes_a[k] : bytes_a[k + 1]] + b"||||" + packed_b[bytes_b[k] : bytes_b[k + 1]]
            found = known.get(key)
            if found is None:
                found = known[key] = len(known)
                new.append(k)
            numbers.append(found)
        if new:
            fresh = np.array(new)
            own_a, own_b = np.diff(cut_a), np.diff(cut_b)
            self.align(a[spread(cut_a[:-1], own_a, fresh)], own_a[fresh], b[spread(cut_b[:-1], own_b, fresh)], own_b[fresh])
        return np.array(numbers), np.diff(np.searchsorted(shared[anchor], texts, "right"), prepend=0)

    def align(self, a: np.ndarray, sizes_a: np.ndarray, b: np.ndarray, sizes_b: np.ndarray) -> None:
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        windows = ends_a[np.cumsum(sizes_a) - 1]
        shared, every = np.intersect1d(ends_a, ends_b, assume_unique=True), np.union1d(ends_a, ends_b)
        # a stretch between neighbouring ends lies in one token of each side, and each overlapping pair has one such stretch
        pair = a[np.searchsorted(ends_a, every)] << 32 | b[np.searchsorted(ends_b, every)]
        links, groups = (np.diff(np.searchsorted(x, windows, "right"), prepend=0) for x in (every, shared))
        self.pairs.add(pair, links)
        self.counts = np.concatenate([self.counts, np.stack([sizes_a, sizes_b, groups], axis=1)])
        # in a group the ids of A come first: tokens are ordered by group, then side
        group = np.concatenate([np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)])
        last = np.concatenate([np.isin(ends_a, shared), 2 * np.isin(ends_b, shared)])
        self.codes.add((3 * np.concatenate([a, b]) + last)[np.argsort(group, kind="stable")], sizes_a + sizes_b)


class Aligner:
    """What a Python worker keeps from task to task: tokenizers, the chunks it has met, their windows."""

    def __init__(self, ranks: dict[bytes, int], tokens_a: list[bytes], tokens_b: list[bytes], model: bytes, max_chunks: int):
        import sentencepiece
        import tiktoken

        self.encoder = tiktoken.Encoding("byte level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.tokens_a, self.tokens_b, self.max_chunks = tokens_a, tokens_b, max_chunks
        self.windows = Windows(tokens_a, tokens_b)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chunks, self.changed = Ragged(np.int64), np.zeros(0, bool)
        self.windows.clear()

    def tokenise(self, new: list[str]) -> None:
        """Adds chunks. Of one that a tokenizer changed no windows are kept."""
        coded = [list(map(self.encoder.encode_ordinary, [" " + c for c in new])), self.pieces.encode(new, num_threads=1)]
        changed = np.zeros(len(new), bool)
        raw = (" " + " ".join(new)).encode()
        if any(b"".join(map(tokens.__getitem__, chain.from_iterable(side))) != raw for tokens, side in zip((self.tokens_a, self.tokens_b), coded, strict=True)):
            for tokens, side in zip((self.tokens_a, self.tokens_b), coded, strict=True):
                changed |= np.array([b"".join(map(tokens.__getitem__, ids)) != (" " + c).encode() for ids, c in zip(side, new, strict=True)])
            coded = [[ids for ids, odd in zip(side, changed, strict=True) if not odd] for side in coded]
        flat = [np.fromiter(chain.from_iterable(side), np.int64) for side in coded]
        sizes = [np.fromiter(map(len, side), np.int64, len(side)) for side in coded]
        own = np.zeros(len(new), np.int64)
        numbers = np.zeros(0, np.int64)
        if len(flat[0]):
            numbers, own[~changed] = self.windows.add(flat[0], sizes[0], flat[1], sizes[1])
        self.chunks.add(numbers, own)
        self.changed = np.append(self.changed, changed)

    def aligned(self, rows: list, ids: list, texts: list[list[str]]) -> pa.RecordBatch:
        """The rows of texts, given as their chunks."""
        if len(self.number) > self.max_chunks:
            self.clear()
        flat = list(chain.from_iterable(texts))
        new = [c for c in dict.fromkeys(flat) if c not in self.number]
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        for at in range(0, len(new), 50_000):
            self.tokenise(new[at : at + 50_000])
        chunk = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        odd = np.bincount(owner, self.changed[chunk], len(texts)) > 0 if len(flat) else np.zeros(len(texts), bool)
        chunk, owner = chunk[~odd[owner]], owner[~odd[owner]]
        numbers, digests, pairs, times = np.zeros((len(texts), 3), np.int64), [""] * len(texts), [np.zeros(0, np.int64)] * len(texts), [np.zeros(0, np.int64)] * len(texts)
        links = np.zeros(len(texts), np.int64)
        if len(chunk):
            window = self.chunks.of(chunk)
            owner = np.repeat(owner, self.chunks.sizes[chunk])
            for k in range(3):
                numbers[:, k] = np.bincount(owner, self.windows.counts[window, k], len(texts))
            links = np.bincount(owner, self.windows.pairs.sizes[window], len(texts)).astype(np.int64)
            every, codes, spelled = self.windows.pairs.of(window), self.windows.codes.of(window), self.windows.spelled
            end_link, end_code = np.cumsum(links).tolist(), np.cumsum(numbers[:, 0] + numbers[:, 1]).tolist()
            for k in np.flatnonzero(links).tolist():
                said = "".join(map(spelled.__getitem__, codes[end_code[k - 1] if k else 0 : end_code[k]].tolist()))[:-1]
                digests[k] = hashlib.sha256(said.encode()).hexdigest()
                pairs[k], times[k] = np.unique(every[end_link[k - 1] if k else 0 : end_link[k]], return_counts=True)
        ends = np.cumsum([0, *map(len, pairs)]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(kind))) for x, kind in ((pairs, np.int64), (times, np.int32))]
        columns = [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), *(pa.array(numbers[:, c]) for c in range(3)), pa.array(links), pa.array(digests, pa.string()), *lists]
        return pa.RecordBatch.from_arrays(columns, [f.split(" ")[0] for f in ALIGNED.split(", ")])


_aligners: dict[tuple, Aligner] = {}


def aligned(docs: DataFrame, byte_level_path: str, piece_path: str, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): numbers, digest of the groups, distinct linked pairs (A id << 32 | B id) and how often each is linked."""
    spark = docs.sparkSession
    ship_code(spark)
    ranks = read_byte_level(byte_level_path)
    rows, _ = read_pieces(piece_path)
    tokens_a = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens_a[i] = token
    tokens_b = [bytes([int(p[1:-1], 16)]) if k == "byte" else p.replace(MARK, " ").encode() if k == "normal" else b"" for p, _, _, k in rows]
    with open(piece_path, "rb") as f:
        model = f.read()
    key = (hashlib.sha256(model).hexdigest(), hashlib.sha256(b"".join(tokens_a)).hexdigest(), max_chunks)
    shared = spark.sparkContext.broadcast((ranks, tokens_a, tokens_b, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _aligners:
            _aligners.clear()
            _aligners[key] = Aligner(*shared.value, max_chunks)
        own = _aligners[key]
        for batch in batches:
            held, size = [], 0
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py()
                held.append((row, doc_id, chunks_of(text) if text else []))
                size += len(held[-1][2])
                if size > 200_000:
                    yield own.aligned(*map(list, zip(*held, strict=True)))
                    held, size = [], 0
            if held:
                yield own.aligned(*map(list, zip(*held, strict=True)))

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return numbered.mapInArrow(run, ALIGNED)


def alignment(docs: DataFrame, byte_level_path: str, piece_path: str, hot_pairs: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """(a row for each row of ``docs``, the table of linked pairs: a_id, b_id, n_docs, best).

    Rows: doc_id, n_a, n_b, n_groups, n_links, n_best (links to the best partner of their A id), count_sum, groups_sha256.
    """
    texts = materialise(aligned(docs, byte_level_path, piece_path), "aligned")
    counts = texts.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = materialise(counts.withColumn("a_id", F.shiftright("pair", 32).cast("int")), "pair-counts")
    best = counts.groupBy("a_id").agg(F.max("n_docs").alias("most"))
    counts = materialise(counts.join(best, "a_id").select("pair", "a_id", F.col("pair").bitwiseAND((1 << 32) - 1).cast("int").alias("b_id"), "n_docs", (F.col("n_docs") == F.col("most")).alias("best")), "pair-table")

    known = counts.select("pair", "n_docs", "best")
    hot = materialise(known.orderBy(F.desc("n_docs"), "pair").limit(hot_pairs), "hot-pairs") if counts.count() > hot_pairs else known
    links = texts.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = [F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0).cast("long")).alias("n_best")]
    summed = links.join(F.broadcast(hot), "pair").groupBy("row").agg(*sums)
    if hot is not known:
        cold = links.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(known, "pair").groupBy("row").agg(*sums)
        summed = summed.unionByName(cold).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    out = texts.drop("pairs", "times").join(summed, "row", "left").na.fill(0, ["count_sum", "n_best"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), counts.select("a_id", "b_id", "n_docs", "best")
