"""Files as documents: a registry of parsers by format, applied by a table function in tasks; what can't be read is set aside.

A parser takes the bytes of one file and its name and gives its pages and what it says of itself (title, author). A file is
read whole by the task that holds it, as file formats demand; files beyond ``most_bytes`` are rejected, not cut.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagemill.session import ship_code
from pagemill.sources.files import resolve_format

#: pages, and properties such as title and author
Parsed = tuple[list[str], dict[str, str]]
Parser = Callable[[bytes, str], Parsed]
PAGES = "format string, page int, page_count int, text string, title string, author string, error string"
#: name spaces of word-processing files. Fixed values
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_CORE = "{http://purl.org/dc/elements/1.1/}"


def decoded(content: bytes) -> str:
    """UTF-8 where the bytes are valid, else Latin-1."""
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def plain_text(content: bytes, name: str) -> Parsed:
    """Form feeds separate pages."""
    return decoded(content).split("\f"), {}


def markdown(content: bytes, name: str) -> Parsed:
    """The title is the first heading of the first level."""
    text = decoded(content)
    heading = re.search(r"^#\s+(.+)$", text, re.MULTILINE)
    return text.split("\f"), {"title": heading.group(1).strip()} if heading else {}


def word_document(content: bytes, name: str) -> Parsed:
    """The paragraphs of a document as one page, a line each, blank ones left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_WORD}body")
        core = ElementTree.fromstring(archive.read("docProps/core.xml")) if "docProps/core.xml" in archive.namelist() else ElementTree.Element("none")
    lines = ["".join({f"{_WORD}t": x.text or "", f"{_WORD}tab": "\t", f"{_WORD}br": "\n"}.get(x.tag, "") for x in p.iter()) for p in body.findall(f"{_WORD}p")]
    said = {name: core.findtext(f"{_CORE}{tag}") or "" for name, tag in (("title", "title"), ("author", "creator"))}
    return ["\n".join(line for line in lines if line)], said


#: format -> parser. PDF has none here: give one to read such files
PARSERS: dict[str, Parser] = {"txt": plain_text, "md": markdown, "docx": word_document}


def page_function(parsers: dict[str, Parser], most_bytes: int):
    """The table function (content, name, format) -> rows of :data:`PAGES`: a row a page, or one row with the error."""

    class Pages:
        def eval(self, content, name: str, format: str) -> Iterator[tuple]:
            parser = parsers.get(format)
            error = None
            if content is None:
                error = "no content"
            elif format is None:
                error = "unknown format"
            elif parser is None:
                error = f"no parser for {format}"
            elif len(content) > most_bytes:
                error = f"over {most_bytes} bytes"
            else:
                try:
                    pages, said = parser(bytes(content), name or "")
                except Exception as problem:
                    error = f"{type(problem).__name__}: {problem}"
            if error:
                yield format, None, None, None, None, None, error
                return
            title = said.get("title") or (name or "").rsplit(".", 1)[0]
            for k, text in enumerate(pages, 1):
                yield format, k, len(pages), text, title, said.get("author") or "Unknown", None

    return F.udtf(Pages, returnType=PAGES, useArrow=False)


def parse_files(files: DataFrame, mime: Column | None = None, parsers: dict[str, Parser] = PARSERS, most_bytes: int = 10 * 2**20) -> DataFrame:
    """``files`` (path, name, content; a table or a stream) -> a row for each page, with ``error`` where a file can't be read.

    path, name, format, bytes, sha256, page, page_count, text, title, author, error. A null ``mime`` leaves the format to the name.
    """
    ship_code(files.sparkSession)
    kind = resolve_format(F.col("name"), F.lit(None).cast("string") if mime is None else mime)
    known = files.select("path", "name", "content", kind.alias("kind"), F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    rows = known.lateralJoin(page_function(parsers, most_bytes)(F.col("content").outer(), F.col("name").outer(), F.col("kind").outer()))
    return rows.select("path", "name", "format", "bytes", "sha256", "page", "page_count", "text", "title", "author", "error")


def list_files(spark: SparkSession, base: str, prefix: str = "") -> DataFrame:
    """path, key (the path below ``base``), length, modificationTime of the files whose key begins with ``prefix``; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    return _keyed(found.select("path", "length", "modificationTime"), base).where(F.col("key").startswith(prefix.lstrip("/")))


def file_rows(spark: SparkSession, base: str, stream: bool = False, files_a_batch: int = 1000) -> DataFrame:
    """path, key, name, content of all files below ``base``, as a table or as a stream of what arrives. Readers leave out files of no bytes."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch) if stream else spark.read
    found = reader.format("binaryFile").option("recursiveFileLookup", True).load(base)
    return _keyed(found, base).withColumn("name", F.element_at(F.split("key", "/"), -1)).select("path", "key", "name", "content")


def _keyed(files: DataFrame, base: str) -> DataFrame:
    """``files`` with ``key``. Schemes are compared without their slashes, of which readers give one or three."""
    plain = lambda c: F.regexp_replace(c, r"^([a-z]+:)/+", "$1/")
    root = plain(F.lit(base.rstrip("/") + "/"))
    path = F.when(root.startswith("/"), F.regexp_replace(plain(F.col("path")), r"^[a-z]+:", "")).otherwise(plain(F.col("path")))
    return files.withColumn("key", F.substring(path, F.length(root) + 1, F.length(path)))


def pages_and_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages, and the files that were set aside with the reason."""
    return parsed.where("error is null").drop("error"), parsed.where("error is not null").select("path", "name", "format", "bytes", "sha256", "error")
