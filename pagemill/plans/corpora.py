"""Corpora derived from the given tables: the same SQL for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.session import table

SPARK = {"STRING": "string", "DATE": "date_format(l_shipdate, 'yyyy-MM-dd')", "CHR": "chr"}
DUCK = {"STRING": "varchar", "DATE": "strftime(l_shipdate, '%Y-%m-%d')", "CHR": "chr"}

#: one chunk of a specification for each line item: document l_orderkey, page l_linenumber
CHUNKS = """SELECT l_orderkey AS doc_id, l_linenumber AS page,
  cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS int) AS chunk_index,
  concat('Section ', cast(l_linenumber AS {STRING}), '.1 Terms', chr(10),
    'The discount is ', cast(cast(round(l_discount*100) AS int) AS {STRING}), '%. ',
    'The unit budget is $', cast(cast(floor(l_extendedprice) AS bigint) AS {STRING}), '. ',
    'The ship date is ', {DATE}, '. ',
    'The system ', CASE WHEN l_linestatus='O' THEN 'shall' ELSE 'shall not' END, ' encrypt class ', l_returnflag, ' data. ',
    'REQ-', cast(l_partkey % 20 AS {STRING}), CASE WHEN l_suppkey % 2 = 0 THEN ': holds' ELSE ' applies' END, '. ',
    'See Section ', cast(l_suppkey % 9 AS {STRING}), '.1.',
    CASE WHEN l_partkey % 5 = 0 THEN ' It may change soon.' WHEN l_partkey % 5 = 1 THEN ' It should hold.' ELSE '' END,
    CASE WHEN l_partkey % 7 = 0 THEN ' TODO' ELSE '' END) AS text
FROM lineitem"""

#: facts that a model would have found: some repeat with other spelling, some disagree
FACTS = """SELECT l_orderkey AS doc_id, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS int) AS ord,
  CASE WHEN l_linenumber % 2 = 0 THEN concat('Part ', cast(l_partkey % 4 AS {STRING})) ELSE concat(' part ', cast(l_partkey % 4 AS {STRING}), ' ') END AS subject,
  CASE WHEN l_suppkey % 3 = 0 THEN 'price' WHEN l_suppkey % 3 = 1 THEN 'status' ELSE '' END AS predicate,
  CASE WHEN l_suppkey % 3 = 0 THEN concat('$', cast(cast(l_quantity AS int) % 5 AS {STRING}), ',000') ELSE l_returnflag END AS value,
  l_linenumber AS page, round(0.55 + l_discount * 4, 2) AS confidence, concat('line ', cast(l_linenumber AS {STRING})) AS evidence,
  CASE WHEN l_partkey % 4 = 0 THEN '' WHEN l_partkey % 4 = 1 THEN 'numerical' ELSE 'relational' END AS fact_type, l_linenumber % 6 AS chunk_index
FROM lineitem"""

#: entities that a model would have found, one mention each
ENTITIES = """SELECT l_orderkey AS doc_id, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS int) AS ord,
  CASE WHEN l_linenumber % 2 = 0 THEN concat('Acme ', cast(l_partkey % 3 AS {STRING})) ELSE concat('ACME ', cast(l_partkey % 3 AS {STRING})) END AS text,
  CASE WHEN l_partkey % 3 = 0 THEN 'MONEY' WHEN l_partkey % 3 = 1 THEN 'DATE' ELSE 'ORGANIZATION' END AS type,
  round(0.5 + l_tax * 5, 2) AS confidence, l_linenumber AS page,
  CASE WHEN l_partkey % 3 = 1 THEN concat('due Jan ', cast(l_linenumber AS {STRING}), ', 2024') ELSE concat('pays $', cast(cast(l_quantity AS int) AS {STRING}), ' million') END AS snippet,
  concat('Acme ', cast(l_suppkey % 3 AS {STRING})) AS related
FROM lineitem"""

#: replies of a model about pairs of chunks: fenced, bare and broken JSON
REPLIES = """SELECT l_orderkey AS doc_id, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS int) AS reply_id,
  CASE WHEN l_partkey % 11 = 0 THEN 'no conflict here' ELSE concat(CASE WHEN l_partkey % 2 = 0 THEN concat('```json', chr(10)) ELSE 'Result: ' END,
    '{{"type": "numerical", ', CASE WHEN l_partkey % 13 = 0 THEN '' ELSE concat('"summary": "Item ', cast(l_partkey % 50 AS {STRING}), ' differs", ') END, CASE WHEN l_linenumber % 4 = 0 THEN '' WHEN l_linenumber % 4 = 1 THEN '"is_contradiction": false, ' ELSE '"is_contradiction": true, ' END, CASE WHEN l_partkey % 3 = 0 THEN '"confidence": null' ELSE concat('"confidence": ', cast(0.5 + (l_partkey % 10) * 0.05 AS {STRING})) END,
    CASE WHEN l_suppkey % 2 = 0 THEN concat(', "contradiction_strength": ', cast(0.3 + (l_suppkey % 7) * 0.1 AS {STRING})) ELSE '' END, '}}',
    CASE WHEN l_partkey % 2 = 0 THEN concat(chr(10), '```') ELSE '' END) END AS reply,
  CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE round(0.4 + l_discount * 5, 2) END AS similarity
FROM lineitem"""


def spark_sql(sql: str) -> str:
    return sql.format(**SPARK)


def duck_sql(sql: str) -> str:
    return sql.format(**DUCK)


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the above over the ``lineitem`` table in ``sf_dir``."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("corpora_lineitem")
    return spark.sql(spark_sql(sql).replace("FROM lineitem", "FROM corpora_lineitem"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, CHUNKS)
