"""New Word files as they arrive: the batch conversion over a file stream, run until caught up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.convert import to_markdown

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", "*.docx").load(path)
    name = F.element_at(F.split("path", "/", -1), -1)
    return files.where(~name.startswith("~$")).select(F.sha1("path").alias("doc_id"), "content")


def convert_arriving(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Exactly once per file: the file source and the Parquet sink share one checkpoint."""
    rows = to_markdown(arriving(spark, path)).select("doc_id", "md", "error")
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
