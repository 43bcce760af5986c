"""The registered queries of this package, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemill.llm import language_id, sentencepiece_lattice
from pagemill.llm.embedding_dedup import embedding_groups
from pagemill.llm.exact_dedup import exact_groups
from pagemill.llm.packing import pack
from pagemill.llm.passages import near_passages
from pagemill.llm.simhash import fingerprint_groups
from pagemill.llm.source_divergence import divergence
from pagemill.llm.suffix_dedup import remove_repeats
from pagemill.llm.token_alignment import alignment
from pagemill.llm.token_counts import token_counts
from pagemill.llm.toxicity import fit, scores
from pagemill.llm.warc import read_archives, write_archives
from pagemill.session import materialise, table, workspace


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_columns(pieces: DataFrame, *more: str) -> DataFrame:
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *more)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), derive={"ids_crc32": F.crc32("ids")}, keep_ids=False)
    return op1_columns(pieces)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_groups(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_passages(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and, from these again, the text: doc_id, n_pieces, ids_crc32, text_sha256 of the decoded text."""
    path = tokenizer_path("piece_bpe_32k.model")
    back = sentencepiece_lattice.decode(sentencepiece_lattice.encode(table(spark, sf_dir, "documents"), path), path)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("text_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), workspace(spark, "token-cache"))


def held_out(doc_id):
    """Rows whose labels are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    found = scores(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))[0]


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), language_id.held_out(F.col("doc_id"))
    found = language_id.predict(docs, language_id.fit(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {q.__name__: q for q in (op1_packing, op2_suffix_dedup, op3_simhash, op4_warc, op5_passages, op6_exact_dedup, op7_embedding_dedup, op8_sentencepiece, op9_token_counts, op10_toxicity, op11_source_divergence, op12_token_alignment, op13_language_id)}

ORACLE_SQL = {
    "op6_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY cp DESC, doc_id) AS rn, count(*) OVER (PARTITION BY t) AS c, first_value(doc_id) OVER (PARTITION BY t ORDER BY cp DESC, doc_id) AS k FROM n)
        SELECT doc_id, k AS keep_id, c AS group_size, rn = 1 AS kept, sha256(t) AS text_sha256 FROM r""",
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        d AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS last_id FROM p),
        b AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: CASE substr(h, i::INT, 1) WHEN '0' THEN '0000' WHEN '1' THEN '0001' WHEN '2' THEN '0010' WHEN '3' THEN '0011' WHEN '4' THEN '0100' WHEN '5' THEN '0101' WHEN '6' THEN '0110' WHEN '7' THEN '0111' WHEN '8' THEN '1000' WHEN '9' THEN '1001' WHEN 'a' THEN '1010' WHEN 'b' THEN '1011' WHEN 'c' THEN '1100' WHEN 'd' THEN '1101' WHEN 'e' THEN '1110' ELSE '1111' END), 'string_agg', '') AS bits FROM d)
        SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + 16 * substr(bits, (5 * i + 1)::INT, 1)::INT + 8 * substr(bits, (5 * i + 2)::INT, 1)::INT + 4 * substr(bits, (5 * i + 3)::INT, 1)::INT + 2 * substr(bits, (5 * i + 4)::INT, 1)::INT + substr(bits, (5 * i + 5)::INT, 1)::INT)::INT, 1)), 'string_agg', '') AS payload_digest,
          CASE WHEN page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last_id THEN last_id END AS refers_to FROM b""",
    "op11_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        v AS (SELECT lang, term, count(*) AS n FROM d GROUP BY ALL HAVING count(DISTINCT r) >= 10),
        k AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM v GROUP BY lang),
        g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        c AS (SELECT lang, source, term, count(*) AS n FROM d SEMI JOIN v USING (lang, term) GROUP BY ALL),
        t AS (SELECT lang, source, sum(n)::BIGINT AS n FROM c GROUP BY ALL),
        p AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (coalesce(t.n, 0) + 2 * k.v) AS p, 1 + 1000000000 * (v.n + 2) // (k.n + 2 * k.v) AS q
            FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN t USING (lang, source)),
        f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
            UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u)
        SELECT * FROM r WHERE part = 'pair' OR rank <= 10""",
}
