"""SentencePiece encoding and decoding as a relational lattice (operator 8).

Texts are split into words (a run of white-space marks and what follows up to the next mark; no piece reaches over that
cut). A first pass counts the words of all texts. For the frequent ones, at most ``max_known`` (a fixed bound, found by
counts in powers of two), all substrings of at most the longest piece's length are exploded and equi-joined to the piece
table, whose size is the model's; the matches are the lattice's edges. They are grouped by word and folded with the
higher-order ``aggregate`` to the word's segmentation. The result is broadcast, and a second pass over the texts puts ids
together from it. Rare words, which other tasks hardly hold, are folded where they are met, many at once and to the same
result; so no occurrence of a word is ever shuffled.

The fold isn't Viterbi's: the vocabulary file at hand is a BPE model, where the best path by score isn't what the library
returns. Each step of the fold merges the adjacent pair whose piece scores best (leftmost on ties), as the library does;
its state is a bit for each place where symbols meet. Characters without a piece fall back to bytes.

Cases: null and empty texts have no pieces; long texts and words are handled whole; repeated rows return a row each; a
null ``doc_id`` is carried; an empty table returns no rows; further columns are ignored. A mark (U+2581) in a text is
encoded like a space, so decoding returns a space.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagemill.session import discard, materialise, ship_code

MARK = "▁"
PIECES = "piece string, id int, score double, kind string"
MAX_WORDS = 100_000
FOLDED = 60  # characters of a word whose places fit a long
NEVER = np.iinfo(np.int32).max


def read_pieces(path: str) -> tuple[list[tuple], int]:
    """(piece, id, score, kind) of a model file, and the id of byte 0."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = lambda i: "byte" if model.is_byte(i) else "special" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "normal"
    rows = [(model.id_to_piece(i), i, model.get_score(i), kinds(i)) for i in range(model.get_piece_size())]
    first = next(i for p, i, _, _ in rows if p == "<0x00>")
    if any(p != f"<0x{i - first:02X}>" for p, i, _, k in rows if k == "byte"):
        raise ValueError("byte pieces aren't in order")
    if any(p[i] != MARK and p[i + 1] == MARK for p, _, _, k in rows if k == "normal" for i in range(len(p) - 1)):
        raise ValueError("a piece reaches over the end of a word")
    return rows, first


def heap_merge(word: str, pieces: dict[str, tuple[float, int]], first_byte: int) -> list[int]:
    """The ids of a word of any length: adjacent symbols are merged, best score first, leftmost on ties."""
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    queue: list[tuple[float, int, int]] = []

    def offer(left: int) -> None:
        if left >= 0 and end[left] < n and (found := pieces.get(word[left : end[end[left]]])):
            heapq.heappush(queue, (-found[0], left, end[end[left]]))

    for i in range(n - 1):
        offer(i)
    while queue:
        _, left, right = heapq.heappop(queue)
        if not alive[left] or end[left] >= right or end[end[left]] != right:
            continue
        alive[end[left]] = False
        end[left] = right
        if right < n:
            before[right] = left
        offer(before[left])
        offer(left)
    ids: list[int] = []
    at = 0
    while at < n:
        found = pieces.get(word[at : end[at]])
        ids += [found[1]] if found else [first_byte + b for b in word[at : end[at]].encode()]
        at = end[at]
    return ids


class Merger:
    """Merges the symbols of many words at once: in each step, that pair of every word whose piece scores best."""

    def __init__(self, pieces: dict[str, tuple[float, int]], first_byte: int):
        self.pieces, self.first_byte = pieces, first_byte
        bare = sorted({c for p in pieces for c in p} - pieces.keys())
        symbols = {p: i for p, (_, i) in pieces.items()} | {c: (1 << 19) + k for k, c in enumerate(bare)}
        self.of_char = np.full(0x110000, (1 << 20) - 1, np.int32)  # a character of no piece
        for c, i in symbols.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        order = {score: k for k, score in enumerate(sorted({score for score, _ in pieces.values()}, reverse=True))}
        pairs = {}
        for p, (score, i) in pieces.items():
            for k in range(1, len(p)):
                if p[:k] in symbols and p[k:] in symbols:
                    pairs[symbols[p[:k]] << 20 | symbols[p[k:]]] = (order[score], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks, self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32).T.copy()

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER), self.merged[at]

    def ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word, packed."""
        out: list[bytes] = [b""] * len(words)
        order = sorted((len(w), k) for k, w in enumerate(words))
        for begin in range(0, len(order), 8192):
            part = [k for _, k in order[begin : begin + 8192]]
            longest = len(words[part[-1]])
            if longest <= FOLDED:
                for k, found in zip(part, self.fold([words[k] for k in part], longest), strict=True):
                    out[k] = found
            else:
                for k in part:
                    out[k] = np.array(heap_merge(words[k], self.pieces, self.first_byte), "<u4").tobytes()
        return out

    def fold(self, words: list[str], longest: int) -> list[bytes]:
        n, wide = len(words), longest + 1  # the last column of a row is never a symbol
        sizes = np.array([len(w) for w in words])
        inside = np.arange(wide)[None, :] < sizes[:, None]
        symbol = np.full((n, wide), (1 << 20) - 1, np.int32)
        symbol[inside] = self.of_char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")]
        rank = np.full((n, wide), NEVER, np.int32)
        piece = np.zeros((n, wide), np.int32)
        both = inside[:, 1:] & inside[:, :-1]
        rank[:, :-1][both], piece[:, :-1][both] = self.look_up(symbol[:, :-1][both], symbol[:, 1:][both])
        following = np.tile(np.arange(1, wide + 1, dtype=np.int32), (n, 1))
        before = following - 2
        rows = np.arange(n)
        while len(rows):
            at = rank[rows].argmin(axis=1)
            going = rank[rows, at] != NEVER
            rows, at = rows[going], at[going]
            gone = following[rows, at]
            after = following[rows, gone]
            symbol[rows, at] = piece[rows, at]
            rank[rows, gone], inside[rows, gone] = NEVER, False
            following[rows, at] = after
            more = after < sizes[rows]
            before[rows[more], after[more]] = at[more]
            rank[rows[~more], at[~more]] = NEVER
            for r, left, right in ((rows[more], at[more], after[more]), ((r := rows[at > 0]), before[r, at[at > 0]], at[at > 0])):
                rank[r, left], piece[r, left] = self.look_up(symbol[r, left], symbol[r, right])
        found = symbol[inside]
        ends = np.cumsum(inside.sum(axis=1)).tolist()
        packed = found.astype("<u4").tobytes()
        plain = (symbol < (1 << 19)) | ~inside
        whole = plain.all(axis=1).tolist()
        return [packed[4 * a : 4 * b] if w else np.array(heap_merge(word, self.pieces, self.first_byte), "<u4").tobytes() for a, b, w, word in zip([0, *ends], ends, whole, words, strict=False)]


def word_keys(text: str | None) -> list[str]:
    """The words of a text, each without its first mark (spaces are marks, and one stands before the text)."""
    if not text:
        return []
    keys = text.replace(MARK, " ").split(" ")
    if "" not in keys:
        return keys
    out, marks = [], 0
    for key in keys:
        if key:
            out.append(MARK * marks + key)
        marks = 0 if key else marks + 1
    return out + [MARK * (marks - 1)] if marks else out


def word_counts(docs: DataFrame, least: int = 2) -> DataFrame:
    """(word without its first mark, n) over all texts of ``docs``. Each task adds up its own; words that it meets less than ``least`` times count there as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            found = [(w, n) for w, n in words.items() if n >= least and len(w) < FOLDED]
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                words.update(word_keys(text.as_py()))
                if len(words) > MAX_WORDS:
                    yield counted()
        yield counted()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode_words(words: DataFrame, model_path: str) -> DataFrame:
    """Distinct ``word`` of at most ``FOLDED`` characters -> word, ids: the lattice and its fold."""
    spark = words.sparkSession
    rows, first_byte = read_pieces(model_path)
    normal = [r for r in rows if r[3] == "normal"]
    longest = max(len(r[0]) for r in normal)
    table = F.broadcast(spark.createDataFrame(normal, PIECES).select("piece", "id", (-F.col("score")).alias("cost")))

    sized = words.select("word", F.length("word").alias("n"))
    cells = sized.select("word", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s"))
    cells = cells.select("word", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("n") - F.col("s")))).alias("k"))
    edges = cells.select("word", "s", (F.col("s") + F.col("k")).alias("e"), F.substring("word", F.col("s") + 1, F.col("k")).alias("piece")).join(table, "piece")
    edge = F.expr("struct(cost, s, e, id, shiftleft(1L, s) | shiftleft(1L, e) AS ends, shiftleft(1L, e) - shiftleft(1L, s + 1) AS inner)")
    lattice = edges.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    lattice = sized.join(lattice, "word", "left").withColumn("edges", F.coalesce("edges", F.array().cast(lattice.schema["edges"].dataType)))
    lattice = lattice.withColumn("merges", F.filter("edges", lambda x: x["e"] - x["s"] > 1))
    places = F.expr("""
        aggregate(sequence(1, greatest(n - 1, 1)), shiftleft(1L, n + 1) - 1, (places, i) ->
          places & ~coalesce(get(filter(merges, m -> (places & m.ends) = m.ends AND bit_count(places & m.inner) = 1), 0).inner, 0L))""")
    cuts = F.expr("filter(sequence(0, n), c -> (shiftright(places, c) & 1L) = 1L)")
    bytes_of = f"transform(sequence(1, octet_length(substring(word, cuts[i] + 1, 1))), b -> conv(substring(hex(encode(substring(word, cuts[i] + 1, 1), 'UTF-8')), 2 * b - 1, 2), 16, 10)::int + {first_byte})"
    ids = F.expr(f"flatten(transform(sequence(0, size(cuts) - 2), i -> coalesce(nullif(transform(filter(edges, x -> x.s = cuts[i] AND x.e = cuts[i + 1]), x -> x.id), array()), {bytes_of})))")
    return lattice.withColumn("places", places).withColumn("cuts", cuts).select("word", ids.alias("ids"))


def known_words(docs: DataFrame, model_path: str, max_known: int) -> dict[str, bytes]:
    """The ids of the frequent words of ``docs`` by the lattice, ``max_known`` at most."""
    counts = materialise(word_counts(docs), "words")
    level = F.floor(F.log2("n")).cast("int")
    least = total = 0
    for row in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():  # 64 rows at most
        total += row["n"]
        if total > max_known:
            least = row["level"] + 1
            break
    coded = encode_words(counts.where(level >= least).select(F.concat(F.lit(MARK), "word").alias("word")), model_path)
    known = {r["word"][1:]: np.array(r["ids"], "<u4").tobytes() for r in coded.toLocalIterator()}
    discard(docs.sparkSession, counts)
    return known


def encode(docs: DataFrame, model_path: str, max_known: int = 1 << 16) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit numbers) for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    ship_code(spark)
    rows, first_byte = read_pieces(model_path)
    pieces = {p: (score, i) for p, i, score, kind in rows if kind == "normal"}
    shared = spark.sparkContext.broadcast((known_words(docs, model_path, max_known), pieces, first_byte))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pieces, first_byte = shared.value
        merger, rare = Merger(pieces, first_byte), {}
        for batch in batches:
            ids: list[bytes] = []
            held: list[list[str]] = []
            size = 0

            def coded() -> None:
                new = {w for keys in held for w in keys if w not in known and w not in rare}
                if len(rare) > MAX_WORDS:
                    rare.clear()
                    new = {w for keys in held for w in keys if w not in known}
                new = list(new)
                rare.update(zip(new, merger.ids([MARK + w for w in new]), strict=True))
                for keys in held:
                    ids.append(b"".join([known[w] if w in known else rare[w] for w in keys]))

            for text in batch.column(1):
                held.append(word_keys(text.as_py()))
                size += len(held[-1])
                if size > 1 << 17:
                    coded()
                    held, size = [], 0
            coded()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode(coded: DataFrame, model_path: str) -> DataFrame:
    """``coded`` (doc_id, ids) with text: the pieces' bytes, marks as spaces, without the first space."""
    spark = coded.sparkSession
    ship_code(spark)
    rows, _ = read_pieces(model_path)
    shared = spark.sparkContext.broadcast([bytes([int(p[1:-1], 16)]) if k == "byte" else p.replace(MARK, " ").encode() if k == "normal" else b"" for p, _, _, k in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            raw = (b"".join(map(table.__getitem__, np.frombuffer(i.as_py() or b"", "<u4").tolist())) for i in batch.column(1))
            texts = [r.removeprefix(b" ").decode("utf-8", "replace") for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")
