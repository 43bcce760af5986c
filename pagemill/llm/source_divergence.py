"""Source divergence audit (operator 11): which sources of a language use words unlike the others.

Terms are the runs of ASCII letters and of characters beyond ASCII, with A-Z lower-cased. Tasks add up the terms of their own
texts by language and source and write these counts once, with the terms as text. From there on only 64-bit digests of terms
are shuffled. For the digests of terms that a language keeps, the least and the greatest text are compared: where they differ,
several terms share the digest, and those alone are counted again by their text. Text is joined back for the terms that are
reported, and for nothing else.

The divergence of two sources is a sum over all kept terms, those that neither holds included. Tasks take a share of a
language's terms and a pair of blocks of its sources at a time and return one number for each pair of sources, so no rows are
made for pairs within a term; terms that neither block holds differ by one value and are counted, not listed.

All numbers are whole: shares in billionths by long division (right up to 9 * 10^15 occurrences).

Cases: null text, lang and source count as empty texts; repeated rows count each; a source without terms (empty texts) is
reported like any other, with counts of 0; a language that keeps no term has pairs of value 0 and no terms; long texts are
counted whole; ties are ordered by the item's UTF-8 bytes; an empty table returns no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from pagemill.session import discard, materialise, ship_code

PARTS = 1_000_000_000
MAX_ENTRIES = 500_000
#: bytes of a text -> the same with A-Z lowered and all that isn't part of a term as spaces
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RESULT = "lang string, source string, part string, item string, value long, rank int"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM_BYTES).split()


def term_counts(docs: DataFrame, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """(lang, source, term, first, n, df): occurrences and texts by task; ``first`` is true for one row of a term in a task's output at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            for (lang, source), (n, df) in groups.items():
                terms = list(n)  # both counters met their terms in the same order
                first = [t not in seen for t in terms]
                seen.update(terms)
                for at in range(0, len(terms), 50_000):
                    part = slice(at, at + 50_000)
                    k = len(terms[part])
                    columns = [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(terms[part], pa.binary()).cast(pa.string()), pa.array(first[part], pa.bool_())]
                    columns += [pa.array(np.fromiter(c.values(), np.int64, len(terms))[part]) for c in (n, df)]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "first", "n", "df"])
            groups.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                terms = terms_of(text.as_py())
                if not terms:
                    continue
                n, df = groups.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(terms)
                df.update(dict.fromkeys(terms).keys())
                size += len(n) - before
                if size > max_entries:
                    yield from counted()
                    size = 0
        yield from counted()

    return docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text").mapInArrow(run, "lang string, source string, term string, first boolean, n long, df long")


def kept_terms(counts: DataFrame, key: str, least_docs: int) -> DataFrame:
    """(lang, key, total, entries of (source, n)) of the keys in at least ``least_docs`` texts of a language."""
    by_source = counts.repartition("lang", key).groupBy("lang", key, "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    found = by_source.groupBy("lang", key).agg(F.sum("df").alias("df"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("entries"))
    return found.where(F.col("df") >= least_docs).drop("df")


def vocabulary(docs: DataFrame, least_docs: int = 10, digest_bits: int = 64, broadcast_digests: int = 2_000_000) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Kept terms (lang, digest, split, total, entries), texts of digests (digest, least), and what can be discarded when both were used.

    ``split`` is null but for a digest that several terms share, where it is the term. At most ``broadcast_digests`` digests are
    broadcast to look for their texts; beyond that both sides are shuffled.
    """
    ship_code(docs.sparkSession)
    digest = F.xxhash64("term").bitwiseAND(F.lit((1 << digest_bits) - 1 if digest_bits < 64 else -1))
    partials = materialise(term_counts(docs), "term-counts")
    hashed = partials.select("lang", "source", digest.alias("digest"), "n", "df")
    terms = materialise(kept_terms(hashed, "digest", least_docs), "kept-terms")
    wanted = terms.select("digest").distinct()
    wanted = F.broadcast(wanted) if terms.count() <= broadcast_digests else wanted
    texts = partials.where("first").select(digest.alias("digest"), "term").join(wanted, "digest", "left_semi")
    names = materialise(texts.groupBy("digest").agg(F.min("term").alias("least"), F.max("term").alias("greatest")), "term-names")
    shared = names.where("least <> greatest").select("digest")
    plain = terms.withColumn("split", F.lit(None).cast("string"))
    if shared.isEmpty():
        return plain, names, [partials, terms, names]
    again = partials.withColumn("digest", digest).join(shared, "digest", "left_semi").select("lang", "source", "term", "n", "df")
    split = kept_terms(again, "term", least_docs).withColumnRenamed("term", "split").withColumn("digest", F.xxhash64("split").bitwiseAND(F.lit((1 << digest_bits) - 1 if digest_bits < 64 else -1)))
    both = plain.join(shared, "digest", "left_anti").unionByName(split.select(*plain.columns))
    both = materialise(both, "split-terms")
    return both, names, [partials, terms, names, both]


def share(count: str, total: str) -> str:
    """SQL for 1 + floor(PARTS * count / total) in longs: long division by thousands; count is at most total."""
    first, second = f"({count}) * 1000", f"(({count}) * 1000 % ({total})) * 1000"
    third = f"(({second}) % ({total})) * 1000"
    return f"1 + (({first}) div ({total})) * 1000000 + (({second}) div ({total})) * 1000 + (({third}) div ({total}))"


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """As :func:`share`, in numpy."""
    out, rest = np.ones(np.broadcast_shapes(counts.shape, total.shape), np.int64), counts
    for unit in (1_000_000, 1000, 1):
        whole, rest = np.divmod(rest * 1000, total)
        out = out + whole * unit
    return out


def pair_values(sources: DataFrame, terms: DataFrame, block_sources: int = 256, bucket_terms: int = 20_000) -> DataFrame:
    """(lang, source, item, value) for all pairs of sources of a language. ``sources``: lang, source, total (N + 2 * V), kept (V)."""
    spark = sources.sparkSession
    ship_code(spark)
    most = sources.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).agg(F.max("n"), F.max("kept")).first()
    blocks, buckets = -(-(most[0] or 1) // block_sources), -(-(most[1] or 1) // bucket_terms)
    block = f"pmod(xxhash64(source), {blocks})"
    pairs = F.expr(f"explode(flatten(transform(sequence(0L, {blocks - 1}L), a -> transform(sequence(a, {blocks - 1}L), b -> struct(a AS a, b AS b)))))")
    left = terms.select("lang", F.expr(f"pmod(xxhash64(digest, split), {buckets})").alias("bucket"), pairs.alias("p"), "entries")
    if blocks > 1:
        left = left.withColumn("entries", F.expr(f"filter(entries, e -> pmod(xxhash64(e.source), {blocks}) IN (p.a, p.b))")).where("size(entries) > 0")
    left = left.select("lang", "bucket", "p.a", "p.b", F.col("entries.source").alias("names"), F.col("entries.n").alias("counts"))
    right = sources.withColumn("block", F.expr(block)).select("lang", "source", "total", "block", pairs.alias("p")).where("block IN (p.a, p.b)")
    right = right.select("lang", F.expr(f"explode(sequence(0L, {buckets - 1}L))").alias("bucket"), "p.a", "p.b", "source", "total", "block")
    schema = "lang string, source string, item string, value long, seen long"

    def compare(held: pa.Table, known: pa.Table) -> pa.Table:
        rows = sorted(zip(known["source"].to_pylist(), known["total"].to_pylist(), known["block"].to_pylist(), strict=True)) if len(known) else []
        if not rows:
            return pa.table({"lang": [], "source": [], "item": [], "value": [], "seen": []}, pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("seen", pa.int64())]))
        lang, a, b = (known[c][0].as_py() for c in ("lang", "a", "b"))
        place = {source: k for k, (source, _, _) in enumerate(rows)}
        total = np.array([t for _, t, _ in rows], np.int64)
        of_block = np.array([x for _, _, x in rows])
        lefts, rights = (np.flatnonzero(of_block == x) for x in (a, b))
        value = np.zeros((len(rows), len(rows)), np.int64)
        step = max(1, 2_000_000 // len(rows))
        for at in range(0, len(held), step):
            part = held.slice(at, step)
            names, counts = part["names"].combine_chunks(), part["counts"].combine_chunks()
            term = np.repeat(np.arange(len(part)), np.asarray(names.value_lengths()))
            dense = np.zeros((len(part), len(rows)), np.int64)
            flat = names.flatten()
            coded = flat.dictionary_encode()
            dense[term, np.array([place[s] for s in coded.dictionary.to_pylist()])[np.asarray(coded.indices)]] = np.asarray(counts.flatten())
            p = shares(dense + 2, total[None, :])
            for i in lefts:
                mine, theirs = p[:, i : i + 1], p[:, rights]
                value[i, rights] += ((theirs - mine) ** 2 // (theirs + mine)).sum(axis=0)
        i, j = (x.ravel() for x in np.meshgrid(lefts, rights, indexing="ij"))
        if a == b:
            i, j = i[i < j], j[i < j]
        source = [r[0] for r in rows]
        return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "source": pa.array([source[k] for k in i], pa.string()), "item": pa.array([source[k] for k in j], pa.string()), "value": pa.array(value[i, j]), "seen": pa.array(np.full(len(i), len(held), np.int64))})

    keys = ["lang", "bucket", "a", "b"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, schema)
    found = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    # the difference is the same either way round; what neither block holds differs by the shares of a count of 0
    found = found.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value", "seen").select("lang", "x.*", "value", "seen")
    own = sources.select("lang", "source", "kept", F.expr(f"if(kept = 0, 0, {share('2L', 'total')})").alias("p"))
    other = sources.select("lang", F.col("source").alias("item"), F.expr(f"if(kept = 0, 0, {share('2L', 'total')})").alias("q"))
    rest = F.expr("if(kept = 0, 0, (kept - seen) * ((p - q) * (p - q) div (p + q)))")
    return found.join(own, ["lang", "source"]).join(other, ["lang", "item"]).select("lang", "source", "item", F.when(F.col("kept") > 0, F.col("value") + rest).otherwise(0).cast("long").alias("value"))


def divergence(docs: DataFrame, least_docs: int = 10, top_terms: int = 10, digest_bits: int = 64) -> DataFrame:
    """lang, source, part (``pair``, ``term``), item, value, rank for ``docs`` (text, lang, source): the contract of the operator.

    ``pair``: how far each other source of the language is; ``term``: the ``top_terms`` terms that set the source apart most.
    """
    spark = docs.sparkSession
    occurring = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    terms, names, _ = vocabulary(docs, least_docs, digest_bits)
    held = terms.select("lang", "digest", "split", "total", F.explode("entries").alias("e")).select("lang", "digest", "split", "total", "e.source", "e.n")
    of_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_n"))
    of_source = held.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sources = occurring.join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["n", "kept", "lang_n"])
    sources = materialise(sources.select("lang", "source", "kept", F.expr("n + 2 * kept").alias("total"), F.expr("lang_n + 2 * kept").alias("lang_total")), "sources")

    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(sources.select("lang", "source", "kept", "total"), terms).withColumn("rank", F.row_number().over(by_rank))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")

    shown = held.withColumnRenamed("total", "in_lang").join(sources, ["lang", "source"])
    shown = shown.select("lang", "source", "digest", "split", F.expr(share("n + 2", "total")).alias("p"), F.expr(share("in_lang + 2", "lang_total")).alias("q"))
    shown = shown.where("p > q").select("lang", "source", "digest", "split", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    # ties at the last place stay until their texts are there to order them
    shown = shown.withColumn("r", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).where(F.col("r") <= top_terms)
    named = shown.join(names, "digest").select("lang", "source", F.coalesce("split", "least").alias("item"), "value").withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= top_terms)
    return pairs.unionByName(named.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
