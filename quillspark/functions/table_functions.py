"""Table functions and scalar functions for SQL: ``register(spark)`` and they can be named in queries.

``docx_parts(content [, prefix])`` and ``xml_nodes(data)`` stand in ``LATERAL`` joins.  Both check their arguments before the query runs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BinaryType, IntegerType, MapType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.html_markdown import structured_markdown
from ..operators.latex_repair import math_prepared, tex_normalize
from ..operators.mathml import mathml_to_latex
from ..operators.mtef import mtef_to_latex, ole_formula
from ..operators.omml import omml_to_latex
from ..sources import docx as D


def _binary(name: str, argument: AnalyzeArgument) -> None:
    if not isinstance(argument.dataType, BinaryType):
        raise ValueError(f"{name} wants binary contents, not {argument.dataType.simpleString()}")


class DocxParts:
    """``ord, part, data`` of a zip file's members, those whose names begin with the prefix; no rows for what is no zip."""

    @staticmethod
    def analyze(content: AnalyzeArgument, prefix: AnalyzeArgument | None = None) -> AnalyzeResult:
        _binary("docx_parts", content)
        if prefix is not None and not isinstance(prefix.dataType, StringType):
            raise ValueError("the prefix of docx_parts is a string")
        return AnalyzeResult(StructType().add("ord", IntegerType()).add("part", StringType()).add("data", BinaryType()))

    def eval(self, content: bytes | None, prefix: str | None = "") -> Iterator[tuple]:
        for m in D._members(content, prefix or ""):
            yield m["ord"], m["part"], m["data"]


class XmlNodes:
    """XML elements in document order, each with its place in the tree; no rows for what is no XML."""

    NAMES = [("node_id", IntegerType()), ("parent_id", IntegerType()), ("last_desc", IntegerType()), ("depth", IntegerType()), ("ns", StringType()), ("local", StringType()), ("attrs", MapType(StringType(), StringType())), ("text", StringType()), ("tail", StringType())]

    @staticmethod
    def analyze(data: AnalyzeArgument) -> AnalyzeResult:
        _binary("xml_nodes", data)
        schema = StructType()
        for name, kind in XmlNodes.NAMES:
            schema = schema.add(name, kind)
        return AnalyzeResult(schema)

    def eval(self, data: bytes | None) -> Iterator[tuple]:
        for n in D._nodes(data):
            yield tuple(dict(n[name]) if name == "attrs" else n[name] for name, _ in self.NAMES)


TABLES = {"docx_parts": DocxParts, "xml_nodes": XmlNodes}
SCALARS = {
    "omml_to_latex": omml_to_latex, "mathml_to_latex": mathml_to_latex, "mtef_to_latex": mtef_to_latex, "ole_to_latex": ole_formula, "html_to_md": structured_markdown,
    "latex_normalize": tex_normalize, "latex_prepare": math_prepared,
}


def register(spark: SparkSession) -> None:
    """Make all functions known to SQL in this session."""
    for name, made in TABLES.items():
        spark.udtf.register(name, udtf(made, useArrow=True))
    for name, made in SCALARS.items():
        spark.udf.register(name, made)
