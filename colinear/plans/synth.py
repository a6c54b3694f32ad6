"""A synthetic alignment from ``lineitem``: one row for each line, one block for each order. The SQL runs in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_SQL = """
SELECT block_id, row_idx, name, start, cast(length(replace(text, '-', '')) AS bigint) AS length, strand, cast(2000 AS bigint) AS source_length, text FROM (
  SELECT l_orderkey + 1 AS block_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS row_idx,
         concat('sp', cast(l_suppkey % 5 AS varchar(20)), '.chr', cast(l_partkey % 3 AS varchar(20))) AS name,
         (l_partkey * 37) % 1000 + {shift} AS start,
         CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS strand,
         translate(md5(concat(cast(l_orderkey AS varchar(20)), '-', cast(l_linenumber AS varchar(20)), '-', cast(l_partkey AS varchar(20)))), '0123456789abcdef', 'ACGTACGTACGTAC--') AS text
  FROM lineitem) AS raw"""

A = ROWS_SQL.format(shift="0")
# The second alignment: the rows of a quarter of the blocks begin one base later.
B = ROWS_SQL.format(shift="(CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE 0 END)")

CELLS_SQL = """
SELECT block_id, row_idx, name, strand, col, substr(text, col + 1, 1) AS base,
       CASE WHEN strand = '+' THEN start + length(replace(substr(text, 1, col + 1), '-', '')) - 1
            ELSE source_length - 1 - (start + length(replace(substr(text, 1, col + 1), '-', '')) - 1) END AS pos
FROM (SELECT *, unnest(range(length(text))) AS col FROM {rows}) AS e WHERE substr(text, col + 1, 1) <> '-'"""

WITH = f"WITH a AS ({A}), b AS ({B}), ca AS ({CELLS_SQL.format(rows='a')}), cb AS ({CELLS_SQL.format(rows='b')})\n"


ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
NUMBERS = f"""l_orderkey + 1 AS block_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}) - 1 AS row_idx"""


def alignment(spark: SparkSession, sf_dir: str, sql: str = A, ranges: bool = False) -> DataFrame:
    """Items are numbered by block before they have names and texts, so that they are dealt as items and lie by ``block_id``.

    If ``ranges``, they are dealt by ranges of blocks."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if ranges:
        return spark.sql(sql.replace("FROM lineitem", "FROM {lineitem}"), lineitem=items.repartitionByRange("l_orderkey"))
    keyed = items.select((F.col("l_orderkey") + 1).alias("block_id"), *ORDER)
    numbered = keyed.select("*", (F.row_number().over(Window.partitionBy("block_id").orderBy(*ORDER)) - 1).alias("row_idx"), (F.col("block_id") - 1).alias("l_orderkey"))
    return spark.sql(sql.replace(NUMBERS, "block_id, row_idx").replace("FROM lineitem", "FROM {lineitem}"), lineitem=numbered)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment as the reader's lines: an a line, then the s lines of each block."""
    rows = alignment(spark, sf_dir)
    rows.createOrReplaceTempView("_synthetic_rows")
    return spark.sql("""
      SELECT block_id, cast(0 AS bigint) AS line_idx, 'a' AS type, 'a score=0' AS raw, cast(null AS string) AS name, cast(null AS bigint) AS start, cast(null AS bigint) AS length,
             cast(null AS string) AS strand, cast(null AS bigint) AS source_length, cast(null AS string) AS text FROM (SELECT DISTINCT block_id FROM _synthetic_rows)
      UNION ALL
      SELECT block_id, row_idx + 1, 's', concat_ws(' ', 's', name, start, length, strand, source_length, text), name, start, length, strand, source_length, text FROM _synthetic_rows""")
