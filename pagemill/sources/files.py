"""Reading files as documents and keeping chunk tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pagemill.functions.text import title_of
from pagemill.session import materialise, ship_code


def resolve_format(name: Column, mime: Column) -> Column:
    """pdf, docx, md or txt by MIME type, else by extension; other text/* is txt; null is rejected."""
    end = lambda *x: reduce(lambda a, b: a | b, (F.lower(name).endswith(e) for e in x))
    kind = F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when(kind == "application/pdf", "pdf")
        .when(kind.isin("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/msword"), "docx")
        .when(kind.isin("text/markdown", "text/x-markdown"), "md")
        .when(kind == "text/plain", F.when(end(".md", ".markdown"), "md").otherwise("txt"))
        .when(end(".pdf"), "pdf")
        .when(end(".docx"), "docx")
        .when(end(".md", ".markdown"), "md")
        .when(end(".txt") | kind.startswith("text/"), "txt")
    )


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 where they are valid, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def markdown_title(text: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(text, r"(?md)^#\s+(.+)$", 1)), F.lit("")), title_of(name))


def file_documents(spark: SparkSession, path: str, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """(documents, rejected) of the files below ``path``: text with title, size, SHA-256; names under ``prefix`` only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.withColumn("name", name).where(F.col("name").startswith(prefix)).withColumn("format", resolve_format(F.col("name"), F.lit(None).cast("string")))
    texts = files.where("format in ('md', 'txt')").withColumn("text", decoded(F.col("content")))
    title = F.when(F.col("format") == "md", markdown_title(F.col("text"), F.col("name"))).otherwise(title_of(F.col("name")))
    documents = texts.select(F.xxhash64("path").alias("doc_id"), "path", "name", "format", "text", title.alias("title"), F.lit("Unknown").alias("author"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return documents, files.where("format is null or format in ('pdf', 'docx')").select("path", "name", "format", "length")


def write_files(pages: DataFrame, base: str, order: list[str]) -> int:
    """Files below ``base`` from ``pages`` (key, text, ...): a file a key, its texts in ``order``, a form feed after each. How many there are.

    ``key`` is the path below ``base``. Tasks write with Arrow's file systems, a page at a time, straight to the file's name:
    a file costs an open and a close, and a task that runs again writes the same file.
    """
    ship_code(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base)
        at, out, made, folders = None, None, 0, set()
        try:
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if key != at:
                        if out:
                            out.close()
                        if (folder := f"{root}/{key}".rsplit("/", 1)[0]) not in folders:
                            store.create_dir(folder, recursive=True)
                            folders.add(folder)
                        at, out, made = key, store.open_output_stream(f"{root}/{key}"), made + 1
                    out.write((text.as_py() or "").encode() + b"\f")
        finally:
            if out:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64())], ["made"])

    placed = pages.where("key is not null").repartition("key").sortWithinPartitions("key", *order).select("key", "text")
    return placed.mapInArrow(run, "made long").agg(F.coalesce(F.sum("made"), F.lit(0))).first()[0]


def sanitised(metadata: Column) -> Column:
    """A map of strings without nulls."""
    return F.map_filter(metadata, lambda _, v: v.isNotNull())


def sanitised_json(text: Column) -> Column:
    """The fields of a JSON object as a map of strings: nulls go, lists and objects are kept as JSON; no object gives an empty map."""
    value = lambda e: F.when(F.schema_of_variant(e["value"]).rlike("^(OBJECT|ARRAY)"), F.to_json(e["value"])).otherwise(e["value"].cast("string"))
    entries = F.map_entries(F.try_variant_get(F.try_parse_json(text), "$", "map<string, variant>"))
    kept = F.filter(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), value(e).alias("value"))), lambda e: e["value"].isNotNull())
    return F.coalesce(F.map_from_entries(kept), F.create_map().cast("map<string,string>"))


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``old`` with the rows of ``new``, which win."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def replace_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` without any chunk of the documents in ``new``, and these: ingesting again leaves nothing behind."""
    return old.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)


def matching(filters: dict[str, object]) -> Column:
    """AND of equalities, and of IN for lists; no filter matches all."""
    parts = [F.col(k).isin(v) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in filters.items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def delete(chunks: DataFrame, filters: dict[str, object]) -> DataFrame:
    return chunks.where(~F.coalesce(matching(filters), F.lit(False)))


def write_chunks(chunks: DataFrame, path: str, buckets: int = 64, mode: str = "overwrite") -> None:
    """Chunks as Parquet, partitioned by a hash of the document; only the partitions at hand are replaced, or added to (``append``)."""
    bucketed = chunks.withColumn("doc_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    bucketed.repartition("doc_bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("doc_bucket").parquet(path)


def _fingerprint(rows: DataFrame) -> DataFrame:
    """doc_bucket, rows, content (a sum over hashes of whole rows, which no order changes) of a bucketed table."""
    columns = [F.col(c) for c in sorted(rows.columns) if c != "doc_bucket"]
    return rows.groupBy("doc_bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).alias("content"))


def read_back(written: DataFrame, path: str, buckets: int = 64) -> DataFrame:
    """The buckets at ``path`` that don't hold what was ``written`` to them: doc_bucket, expected, found (rows).

    Only the buckets of ``written`` are read. An equal number of rows with other contents is told too.
    """
    spark = written.sparkSession
    bucketed = written.withColumn("doc_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    want = _fingerprint(bucketed).withColumnsRenamed({"rows": "expected", "content": "expected_content"})
    stored = spark.read.schema(StructType([*written.schema.fields, StructField("doc_bucket", LongType())])).parquet(path)
    have = _fingerprint(stored.join(F.broadcast(want.select("doc_bucket")), "doc_bucket", "left_semi")).withColumnRenamed("rows", "found")
    joined = want.join(have, "doc_bucket", "left").where(~F.col("expected_content").eqNullSafe(F.col("content")) | ~F.col("expected").eqNullSafe(F.col("found")))
    return joined.select("doc_bucket", "expected", F.coalesce("found", F.lit(0)).alias("found"))


def _files(placed: DataFrame) -> list[str]:
    """The files of ``placed`` (doc_id, file): of a chunk table one for each bucket and write."""
    return [row[0] for row in placed.select("file").distinct().collect()]


def replace_in(spark: SparkSession, chunks: DataFrame, documents: DataFrame, path: str, buckets: int = 64, failures: str | None = None) -> None:
    """Replace the chunks of ``documents`` (doc_id) in the table that :func:`write_chunks` keeps at ``path`` by ``chunks``.

    Files that hold such documents are read once; their other rows are added with the new ones as new files, then those
    files go. All other files stay as they are, so documents that the table lacks are only added. A run that broke off
    before files went is mended by the next one. Without a table, one is made. With ``failures``, whole partitions are
    replaced, written aside first; they are read back, and those that lack what was written are appended to the table
    there (:func:`read_back`).
    """

    def verified(written: DataFrame) -> None:
        if failures:
            lost = read_back(written, path, buckets)
            lost.withColumn("path", F.lit(path)).write.mode("append").parquet(failures)

    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        chunks = materialise(chunks, "new-chunks") if failures else chunks
        write_chunks(chunks, path, buckets)
        verified(chunks)
        return
    old = spark.read.schema(StructType([*chunks.schema.fields, StructField("doc_bucket", LongType())])).parquet(path)
    if not failures:
        placed = old.select("doc_id", F.col("_metadata.file_path").alias("file"))
        held = _files(placed.join(documents.distinct(), "doc_id", "left_semi"))
        if not held:
            write_chunks(chunks, path, buckets, "append")
            return
        # a document lies in one file; if two hold it, a run broke off there, and what it had added is there twice
        shared = placed.join(placed.where(F.col("file").isin(held)).select("doc_id").distinct(), "doc_id", "left_semi").distinct()
        gone = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f)) for f in _files(shared)]
        kept = spark.read.schema(old.schema).option("basePath", path).parquet(*(f.toString() for f in gone)).join(documents, "doc_id", "left_anti").drop("doc_bucket")
        if not shared.groupBy("doc_id").count().where("count > 1").isEmpty():
            kept = kept.dropDuplicates(["chunk_id"] if "chunk_id" in kept.columns else None)
        write_chunks(kept.unionByName(chunks), path, buckets, "append")
        for file in gone:
            file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, False)
        return
    touched = documents.select(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("doc_bucket")).distinct()
    kept = old.join(F.broadcast(touched), "doc_bucket", "left_semi").join(documents, "doc_id", "left_anti").drop("doc_bucket")
    new = materialise(kept.unionByName(chunks), "replaced-chunks")
    write_chunks(new, path, buckets)
    filled = new.select(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("doc_bucket"))
    for (bucket,) in touched.join(filled, "doc_bucket", "left_anti").collect():  # at most ``buckets`` rows
        empty = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/doc_bucket={bucket}")
        empty.getFileSystem(spark._jsc.hadoopConfiguration()).delete(empty, True)
    verified(new)


def duplicate_files(docs: DataFrame) -> DataFrame:
    """Groups of two or more documents with equal content: sha256, copies, smallest id."""
    return docs.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")
