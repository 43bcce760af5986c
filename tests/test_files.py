"""Files as documents, other chunkers and rerankers, with expected values written out."""

import io
import os
import tempfile
import zipfile

from pagemill.operators import chunking, retrieval
from pagemill.sources import parsers
from pagemill.streaming import streams


def docx(paragraphs, title=None):
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p[:2]}</w:t></w:r><w:r><w:t>{p[2:]}</w:t></w:r></w:p>" for p in paragraphs)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {space}><w:body>{body}</w:body></w:document>")
        if title:
            archive.writestr("docProps/core.xml", f'<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{title}</dc:title><dc:creator>Ann</dc:creator></c>')
    return held.getvalue()


FILES = {
    "a/plain.txt": "héllo\fsecond".encode(),
    "a/old.TXT": "caf\xe9".encode("latin-1"),
    "b/notes.v1.md": b"intro\n#  The Title \nbody",
    "b/bare.markdown": b"none",
    "b/word.docx": docx(["First line", "", "Second"], "Report"),
    "b/broken.docx": b"not a zip",
    "c/paper.pdf": b"%PDF-1.4",
    "c/blob.bin": b"\x00\x01",
}


def folder():
    base = os.path.realpath(tempfile.mkdtemp(prefix="spark-"))
    for name, content in FILES.items():
        os.makedirs(os.path.dirname(f"{base}/{name}"), exist_ok=True)
        with open(f"{base}/{name}", "wb") as f:
            f.write(content)
    return base


WANT = {
    ("a/plain.txt", "txt", 1, 2, "héllo", "plain", "Unknown"),
    ("a/plain.txt", "txt", 2, 2, "second", "plain", "Unknown"),
    ("a/old.TXT", "txt", 1, 1, "café", "old", "Unknown"),
    ("b/notes.v1.md", "md", 1, 1, "intro\n#  The Title \nbody", "The Title", "Unknown"),
    ("b/bare.markdown", "md", 1, 1, "none", "bare", "Unknown"),
    ("b/word.docx", "docx", 1, 1, "First line\nSecond", "Report", "Ann"),
}
REJECTED = {("b/broken.docx", "BadZipFile: File is not a zip file"), ("c/paper.pdf", "no parser for pdf"), ("c/blob.bin", "unknown format")}


def test_parse_files(spark):
    base = folder()
    key = lambda r: r.path.split(base + "/")[1]
    for stream in (False, True):
        parsed = parsers.parse_files(parsers.file_rows(spark, base, stream=stream, files_a_batch=2))
        parsed = streams.drained(parsed) if stream else parsed
        pages, rejected = parsers.pages_and_rejects(parsed)
        assert {(key(r), r.format, r.page, r.page_count, r.text, r.title, r.author) for r in pages.collect()} == WANT
        assert {(key(r), r.error) for r in rejected.collect()} == REJECTED
    assert {r.bytes for r in rejected.collect()} == {9, 8, 2}


def test_own_parser_and_limits(spark):
    empty = parsers.parse_files(spark.createDataFrame([("0", "e.txt", b"")], "path string, name string, content binary")).first()
    assert (empty.page, empty.text, empty.error) == (1, "", None)
    rows = spark.createDataFrame([("1", "x.pdf", b"p1|p2"), ("2", "y.txt", b"0123456789"), ("3", "z.txt", None), ("4", None, b"q")], "path string, name string, content binary")
    own = {**parsers.PARSERS, "pdf": lambda content, name: (content.decode().split("|"), {"title": name.upper()})}
    out = {(r.path, r.page, r.text, r.title, r.error) for r in parsers.parse_files(rows, parsers=own, most_bytes=9).collect()}
    assert out == {("1", 1, "p1", "X.PDF", None), ("1", 2, "p2", "X.PDF", None), ("2", None, None, None, "over 9 bytes"), ("3", None, None, None, "no content"), ("4", None, None, None, "unknown format")}
    assert parsers.parse_files(rows.limit(0)).count() == 0


def test_list_files(spark):
    base = folder()
    for given in (base, f"file://{base}", f"file://{base}/"):
        keys = lambda prefix: sorted((r.key, r.length) for r in parsers.list_files(spark, given, prefix).collect())  # noqa: B023, E731
        assert keys("b/") == sorted((k, len(v)) for k, v in FILES.items() if k.startswith("b/"))
        assert keys("/a/pl") == [("a/plain.txt", 13)] and len(keys("")) == len(FILES) and keys("zz") == []


def test_chunk_with(spark):
    pages = spark.createDataFrame([(1, 1, "abcdefgh"), (1, 2, "xyz"), (2, 1, None), (3, 1, "   "), (4, 1, "")], "doc_id long, page int, text string")
    out = chunking.chunk_with(pages, chunking.windows(5, 2)).orderBy("chunk_index").collect()
    assert [(r.chunk_id, r.page, r.text, r.start_char, r.end_char, r.token_count) for r in out] == [("1-chk-0", 1, "abcde", 0, 5, 1), ("1-chk-1", 1, "defgh", 3, 8, 1), ("1-chk-2", 2, "xyz", 10, 13, 1)]
    by_page = chunking.chunk_with(pages, lambda own: [(own[0][0], " / ".join(t for _, t in own), 0, 0)]).collect()
    assert {(r.doc_id, r.text) for r in by_page} == {(1, "abcdefgh / xyz")}


def test_scored_by(spark):
    """Scores of a model in batches; where it fails, those of the local reranker stay."""
    queries = spark.createDataFrame([(1, "alpha beta", [1.0, 0.0])], "query_id long, text string, vector array<double>")
    found = spark.createDataFrame([(1, f"c{k}", k, 1, t, [1.0, 0.0], 1.0, k) for k, t in enumerate(["alpha", "beta gamma", "delta"])], "query_id long, chunk_id string, doc_id long, page int, text string, vector array<double>, similarity double, rank int").coalesce(1)
    local = {r.chunk_id: r.score for r in retrieval.rerank(queries, found).collect()}
    lengths = lambda: lambda asked, texts: [len(t) / 10 for t in texts]
    out = {r.chunk_id: r.score for r in retrieval.scored_by(lengths)(queries, found).collect()}
    assert out == {"c0": 0.5, "c1": 1.0, "c2": 0.5}

    def picky():
        def score(asked, texts):
            if "delta" in texts:
                raise ValueError("no")
            return [0.25] * len(texts)

        return score

    out = {r.chunk_id: r.score for r in retrieval.scored_by(picky, batch_size=1)(queries, found).collect()}
    assert out == {"c0": 0.25, "c1": 0.25, "c2": local["c2"]}
    for broken in (lambda: lambda a, t: [0.1], lambda: lambda a, t: [float("nan")] * len(t), lambda: 1 / 0):
        assert {r.chunk_id: r.score for r in retrieval.scored_by(broken)(queries, found).collect()} == local
    names = spark.createDataFrame([(0, "Zero")], "doc_id long, name string")
    hits = spark.createDataFrame([(1, 1, "c0", 0, 2, "y" * 130, 0.7, 0.6, 0.5, 0.4), (1, 2, "c1", 9, 1, "short", 0.3, None, None, None)], "query_id long, rank int, chunk_id string, doc_id long, page int, text string, score double, similarity double, keyword double, hybrid double")
    out = [(r.document_name, r.hybrid_score, r.similarity_score, r.keyword_score, r.preview) for r in retrieval.diagnostics(hits, names).orderBy("rank").collect()]
    assert out == [("Zero", 0.4, 0.6, 0.5, "y" * 120 + "..."), ("9", 0.3, 0.3, 0.0, "short")]


def test_write_files(spark):
    """Files keep their names, so a task that runs again writes no second one; pages come in order, nulls count as empty."""
    from pagemill.sources.files import write_files

    base = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="spark-"))
    rows = spark.createDataFrame([("a/x.txt", 2, "zwei"), ("a/x.txt", 1, "éins"), ("b/c/y.txt", 3, None), (None, 4, "lost")], "key string, n int, text string")
    for _ in range(2):
        assert write_files(rows.repartition(3), base, ["n"]) == 2
        root = base.removeprefix("file://")
        found = {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(root) for f in fs}
        assert found == {"a/x.txt": "éins\fzwei\f".encode(), "b/c/y.txt": b"\f"}
    assert write_files(rows.where("false"), base, ["n"]) == 0


def test_stream_of_shelves_batches(spark, monkeypatch):
    """The number of micro-batches is bounded, however many files there are; odd names of sources come back whole."""
    from pagemill.plans import file_queries

    root = tempfile.mkdtemp(prefix="spark-")
    docs = spark.range(2400).selectExpr("id * 100 as doc_id", "'t' as text", "if(id = 0, 'a/b c:+%', 'src1') as source")
    docs.write.parquet(f"{root}/documents.parquet")
    asked, rows = [], file_queries.parsers.file_rows
    monkeypatch.setattr(file_queries.parsers, "file_rows", lambda *a, **k: (asked.append(k["files_a_batch"]), rows(*a, **k))[1])
    monkeypatch.setattr(file_queries.streams, "drained", lambda stream: stream)
    file_queries.stream_parsed_files(spark, root)
    assert 1201 / asked[0] <= 25
    assert {r.source for r in file_queries.listed_files(spark, root).collect()} == {"src1"}
    monkeypatch.undo()
    assert {r.source for r in file_queries.parsed_files(spark, root).select("source").distinct().collect()} == {"a/b c:+%", "src1"}
