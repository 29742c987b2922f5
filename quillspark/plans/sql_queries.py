"""Queries written in SQL alone, over the registered functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.table_functions import register
from .docx_queries import BASE, sample

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register_(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register_


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    register(spark)
    return spark.sql(text, files=sample(spark, sf_dir))


@query(f"{BASE} SELECT s_suppkey, ord, part FROM p")
def sql_docx_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "SELECT s_suppkey, p.ord, p.part FROM {files}, LATERAL docx_parts(content) p")


@query("SELECT s_suppkey, s_suppkey % 3 AS tables, s_suppkey % 3 + s_suppkey % 4 AS formulas, s_name AS first_text FROM supplier WHERE s_suppkey % 7 <> 6")
def sql_xml_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(
        spark, sf_dir,
        """SELECT s_suppkey, count_if(n.local = 'tbl') AS tables, count_if(n.local = 'oMath') AS formulas, min_by(n.text, n.node_id) FILTER (WHERE n.local = 't') AS first_text
        FROM {files}, LATERAL docx_parts(content, 'word/document.xml') p, LATERAL xml_nodes(p.data) n GROUP BY s_suppkey""",
    )


@query(
    r"""SELECT s_suppkey, n, '{x}^{' || n || '}' AS latex, '<strong>b</strong>' AS html, '-   i' || n AS md FROM (SELECT s_suppkey, s_suppkey % 10 AS n FROM supplier)"""
)
def sql_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    m = "http://schemas.openxmlformats.org/officeDocument/2006/math"
    return spark.sql(
        f"""SELECT s_suppkey, n, omml_to_latex('<m:oMath xmlns:m="{m}"><m:sSup><m:e><m:r><m:t>x</m:t></m:r></m:e><m:sup><m:r><m:t>' || n || '</m:t></m:r></m:sup></m:sSup></m:oMath>') AS latex,
        mathml_to_latex('<math><mi>b</mi></math>') AS b, html_to_md('<ul><li>i' || n || '</li></ul>') AS md FROM (SELECT s_suppkey, s_suppkey % 10 AS n FROM {{suppliers}})""",
        suppliers=suppliers,
    ).selectExpr("s_suppkey", "n", "latex", "'<strong>' || b || '</strong>' AS html", "md")
