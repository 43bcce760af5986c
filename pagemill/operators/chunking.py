"""Pages and chunks: cleaning, sentence-aware sliding chunks, statistics.

The chunker is a function of the sentence it starts at: a chunk takes sentences while their tokens fit ``size``; the next
one starts at the first sentence from which at most ``overlap`` tokens are left in the chunk. It is folded over a
document's sentences by two pointers in Arrow batches; the pages of one document are all that a row holds. Documents larger
than that go through :func:`chunk_long_documents`, where a row holds a page and no task a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill.functions.text import clean, sentences, token_estimate
from pagemill.operators.chains import greedy_links, members, numbered
from pagemill.session import materialise, ship_code

CHUNKS = "doc_id long, chunk_index int, page int, token_count int, first_sentence int, n_sentences int, text string, start_char int, end_char int"


def pages_of(docs: DataFrame) -> DataFrame:
    """Pages of ``docs`` (doc_id, text): form feeds separate them."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\f")).alias("page", "text")).withColumn("page", F.col("page") + 1)


def clean_pages(pages: DataFrame) -> DataFrame:
    ship_code(pages.sparkSession)
    return pages.withColumn("text", clean(F.col("text")))


def readable(pages: DataFrame) -> DataFrame:
    """doc_id, readable: whether any page holds more than white space."""
    return pages.groupBy("doc_id").agg(F.coalesce(F.bool_or(F.length(F.regexp_replace("text", r"(?U)\s+", "")) > 0), F.lit(False)).alias("readable"))


def page_sentences(pages: DataFrame) -> DataFrame:
    """doc_id, page, sentence_index (in the page), text, tokens."""
    rows = pages.select("doc_id", "page", F.posexplode(sentences(F.col("text"))).alias("sentence_index", "text"))
    return rows.withColumn("tokens", token_estimate(F.col("text")))


def orbit(tokens: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """(first, end) sentence of every chunk."""
    sums = [0]
    for t in tokens:
        sums.append(sums[-1] + t)
    out, first, end, n = [], 0, 0, len(tokens)
    while first < n:
        end = max(end, first + 1)
        while end < n and sums[end + 1] - sums[first] <= size:
            end += 1
        out.append((first, end))
        if end == n:
            break
        back = first + 1
        while back < end and sums[end] - sums[back] > overlap:
            back += 1
        if back == end and overlap > 0 and end - 1 > first:
            back = end - 1
        first = max(first + 1, back)
    return out


def sentence_places(text: str, parts: list[str], offset: int) -> list[tuple[int, int]]:
    """(first, end) character of each sentence of a page that begins at ``offset``, each sought behind the one before."""
    out, at = [], 0
    for part in parts:
        found = text.find(part, at)
        begin = at if found < 0 else found
        at = begin + len(part)
        out.append((offset + begin, offset + at))
    return out


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches as slices of some rows, so that what is made of a slice is held in Python at once, not that of a whole batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def chunk_documents(pages: DataFrame, size: int = 500, overlap: int = 50, tokens: Callable[[Column], Column] = token_estimate) -> DataFrame:
    """Chunks of ``pages`` (doc_id, page, text): the fields of ``CHUNKS`` and chunk_id.

    Sentences are joined by blank lines; a chunk's page is the one with most of its tokens, the first on ties. Characters
    count from the start of the document, pages parted by two. ``tokens`` gives the number of tokens of a text.
    """
    ship_code(pages.sparkSession)
    parts = pages.where("text is not null").select("doc_id", "page", "text", sentences(F.col("text")).alias("parts"))
    parts = parts.select("doc_id", F.struct("page", "text", "parts", F.transform("parts", tokens).alias("tokens")).alias("p"))
    whole = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("pages"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in CHUNKS.split(", ")]
        kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[f.split(" ")[1]] for f in CHUNKS.split(", ")]
        for batch in in_slices(batches):
            rows = []
            for doc_id, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                texts, counts, pages_at, places, offset = [], [], [], [], 0
                for page in own.as_py():
                    texts += page["parts"]
                    counts += page["tokens"]
                    pages_at += [page["page"]] * len(page["parts"])
                    places += sentence_places(page["text"], page["parts"], offset)
                    offset += len(page["text"]) + 2
                for i, (a, b) in enumerate(orbit(counts, size, overlap)):
                    share: dict[int, int] = {}
                    for page, n in zip(pages_at[a:b], counts[a:b], strict=True):
                        share[page] = share.get(page, 0) + n
                    rows.append((doc_id, i, max(share, key=share.get), sum(counts[a:b]), a, b - a, "\n\n".join(texts[a:b]), places[a][0], places[b - 1][1]))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    made = whole.mapInArrow(fold, CHUNKS)
    return made.withColumn("chunk_id", F.format_string("%s-chk-%d", F.col("doc_id").cast("string"), "chunk_index"))


def _placed_sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, page, text, parts, tokens, number of the first sentence, first character) -> a row a sentence."""
    for batch in in_slices(batches):
        _, pages, texts, parts, tokens, numbers, offsets = (c.to_pylist() for c in batch.columns)
        source, rows = [], []
        for row in range(batch.num_rows):
            source += [row] * len(parts[row])
            places = sentence_places(texts[row], parts[row], offsets[row])
            rows += [(numbers[row] + i, pages[row], parts[row][i], tokens[row][i], *place) for i, place in enumerate(places)]
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n", "page", "text", "tokens", "start_char", "end_char"])


def chunk_long_documents(pages: DataFrame, size: int = 500, overlap: int = 50, tokens: Callable[[Column], Column] = token_estimate, block_items: int = 4096) -> DataFrame:
    """What :func:`chunk_documents` gives, for documents of any number of pages; places are long.

    Sentences are numbered across tasks, runs of them are found block by block (:func:`greedy_links`), and each chunk
    gathers its own. A sentence needs one token at least (an error otherwise); rows without document are left out.
    """
    ship_code(pages.sparkSession)
    parts = pages.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), "text", sentences(F.col("text")).alias("parts"))
    own = numbered(parts, ["page", "text"])
    earlier = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.select("doc_id", "n", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast("long").alias(k) for c, k in ((F.size("parts"), "number"), (F.length("text") + 2, "offset"))))
    least = F.transform(F.transform("parts", tokens), lambda t: F.when(t >= 1, t.cast("int")).otherwise(F.raise_error(F.lit("a sentence without tokens")).cast("int")))
    placed = own.join(sums, ["doc_id", "n"]).select("doc_id", "page", "text", "parts", least.alias("tokens"), "number", "offset")
    rows = materialise(placed.mapInArrow(_placed_sentences, "doc_id long, n long, page int, text string, tokens int, start_char long, end_char long"), "sentences")
    links = greedy_links(rows.select("doc_id", "n", F.col("tokens").alias("weight")), size, size, overlap, block_items)
    held = members(links, rows).groupBy("doc_id", "link", "page").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("held"), F.min("n").alias("n"), F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"), F.collect_list(F.struct("n", "text")).alias("parts"))
    whole = held.groupBy("doc_id", "link").agg(
        F.max_by("page", F.struct("tokens", -F.col("n"))).alias("page"),
        F.sum("tokens").cast("int").alias("token_count"),
        F.min("n").alias("first_sentence"),
        F.sum("held").cast("int").alias("n_sentences"),
        F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("parts"))), lambda x: x["text"]), "\n\n").alias("text"),
        F.min("start_char").alias("start_char"),
        F.max("end_char").alias("end_char"),
    )
    made = whole.withColumn("chunk_index", F.col("link").cast("int")).select("doc_id", "chunk_index", "page", "token_count", "first_sentence", "n_sentences", "text", "start_char", "end_char")
    return made.withColumn("chunk_id", F.format_string("%s-chk-%d", F.col("doc_id").cast("string"), "chunk_index"))


#: the pages of one document (page, text) in order -> its chunks (page, text, start_char, end_char)
Chunker = Callable[[list[tuple[int, str]]], list[tuple[int, str, int, int]]]


def windows(size: int, overlap: int) -> Chunker:
    """A chunker that cuts each page into runs of ``size`` characters, each beginning ``overlap`` before the end of the last."""

    def cut(pages: list[tuple[int, str]]) -> list[tuple[int, str, int, int]]:
        out, offset = [], 0
        for page, text in pages:
            last = max(len(text) - overlap, 1) if text else 0
            out += [(page, text[at : at + size], offset + at, offset + min(at + size, len(text))) for at in range(0, last, size - overlap)]
            offset += len(text) + 2
        return out

    return cut


def chunk_with(pages: DataFrame, chunker: Chunker, tokens: Callable[[Column], Column] = token_estimate) -> DataFrame:
    """Chunks of ``pages`` (doc_id, page, text) by any ``chunker``: doc_id, chunk_index, page, token_count, text, start_char, end_char, chunk_id.

    Characters count from the start of the document, pages parted by two. Null pages are left out; chunks of white space go.
    """
    ship_code(pages.sparkSession)
    whole = pages.where("text is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "chunk_index", "page", "text", "start_char", "end_char"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            for doc_id, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                made = [m for m in chunker([(p["page"], p["text"]) for p in own.as_py()]) if m[1].strip()]
                columns = zip(*((doc_id, i, *m) for i, m in enumerate(made)), strict=True) if made else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    made = whole.select(F.col("doc_id").cast("long").alias("doc_id"), "pages").mapInArrow(cut, "doc_id long, chunk_index int, page int, text string, start_char long, end_char long")
    return made.withColumn("token_count", tokens(F.col("text"))).withColumn("chunk_id", F.format_string("%s-chk-%d", F.col("doc_id").cast("string"), "chunk_index"))


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """doc_id, n_chunks, mean_tokens (whole), total_tokens."""
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.expr("sum(token_count) div count(1)").alias("mean_tokens"), F.sum("token_count").alias("total_tokens"))
