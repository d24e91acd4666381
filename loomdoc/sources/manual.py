"""A synthetic manual derived from `documents`, by expressions that other SQL engines evaluate alike.

Lines become elements: eight kinds by place, five to a page, with identifiers injected,
so that every rule of the engine meets rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, pos, line (ASCII) of every line of every document."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw")).select(
        "document_id", F.col("pos").cast("bigint").alias("pos"), F.regexp_replace("raw", "[^\\x00-\\x7F]", "x").alias("line")
    )


KIND = """CASE pos % 8 WHEN 0 THEN 'heading' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'icon' WHEN 3 THEN 'list'
 WHEN 4 THEN 'list' WHEN 5 THEN 'table' WHEN 6 THEN 'figure' ELSE 'paragraph' END"""

INJECT = """CASE pos % 5
 WHEN 0 THEN ' Check TH' || CAST(document_id % 20 AS {s}) || ' via CN' || CAST(100 + document_id % 50 AS {s}) || ' error code A6-01.'
 WHEN 1 THEN ' The unit shows P8 at X2M and R1T near the Compressor.'
 WHEN 2 THEN ' compressor condenser evaporator accumulator strainer muffler thermistor U4 abnormal'
 WHEN 3 THEN ' TH-' || CAST(pos % 100 AS {s}) || ' is on the PCB, see E7 - 12'
 ELSE '' END"""

TABLE = "'Table|' || CAST(pos AS {s}) || {nl} || '|---|---|' || {nl} || '|TH' || CAST(document_id % 20 AS {s}) || '|' || CAST(pos % 7 AS {s}) || '|' || {nl} || '|check code J3|open|'"

#: Element columns by name, as SQL over (document_id, pos, line); {s}: the string type, {nl}: a line feed, {div}: integer division.
ELEMENTS = {
    "document_id": "document_id",
    "element_id": "document_id * 100000 + pos",
    "seq": "pos",
    "page_number": "{div5} + 1",
    "element_type": KIND,
    "level": "CASE WHEN pos % 8 = 0 THEN {div8} % 4 END",
    "text": f"CASE pos % 8 WHEN 5 THEN {TABLE} WHEN 6 THEN '' ELSE line || {INJECT} END",
    "confidence": "CASE WHEN pos % 11 = 0 THEN NULL ELSE CAST(80 + pos % 20 AS double) / 100 END",
    "description": "CASE WHEN pos % 8 = 6 THEN 'TH' || CAST(document_id % 20 AS {s}) || ' on a Printed Circuit Board, plug CN105' END",
    "component": "CASE WHEN pos % 8 = 6 THEN CASE WHEN pos % 16 = 6 THEN 'compressor' ELSE 'TH' || CAST(document_id % 20 AS {s}) END END",
    "connection": "CASE WHEN pos % 8 = 6 THEN CASE pos % 3 WHEN 0 THEN 'compressor -> TH3' WHEN 1 THEN 'TH3 to PCB' ELSE ' -> TH3' END END",
}


def element_exprs(engine: str) -> dict[str, str]:
    """ELEMENTS for 'spark' or 'duckdb'."""
    parts = (
        {"s": "string", "nl": "chr(10)", "div5": "pos div 5", "div8": "pos div 8"}
        if engine == "spark"
        else {"s": "VARCHAR", "nl": "chr(10)", "div5": "pos // 5", "div8": "pos // 8"}
    )
    return {k: v.format(**parts) for k, v in ELEMENTS.items()}


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).selectExpr(*[f"{e} AS {k}" for k, e in element_exprs("spark").items()])


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page facts: document_id, page_number, char_count, drawings, images, width, height, scores."""
    per = lines(spark, sf_dir).selectExpr("document_id", "pos div 5 + 1 AS page_number", "length(line) AS n").groupBy("document_id", "page_number").agg(F.sum("n").cast("bigint").alias("char_count"))
    return per.selectExpr(*PAGE_EXPRS)


#: Page facts over (document_id, page_number, char_count).
PAGE_EXPRS = (
    "document_id", "page_number", "char_count",
    "(document_id * 7 + page_number * 13) % 100 AS drawings",
    "(document_id + page_number) % 3 AS images",
    "CAST(600 AS double) AS width", "CAST(CASE WHEN page_number % 17 = 0 THEN 0 ELSE 800 END AS double) AS height",
    "CASE WHEN page_number % 9 = 0 THEN NULL ELSE CAST((document_id + page_number) % 10 AS double) / 10 END AS parse_score",
    "CASE WHEN page_number % 4 = 0 THEN NULL ELSE CAST((document_id + page_number) % 8 AS double) / 8 END AS layout_score",
    "CASE WHEN page_number % 3 = 0 THEN NULL ELSE CAST((document_id + page_number) % 5 AS double) / 5 END AS table_score",
    "CAST((document_id + 2 * page_number) % 4 AS double) / 4 AS mean_score",
)
