"""Where results go.  Every sink is a plain Spark write, so a lost task writes again and nothing is written twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_pages(documents: DataFrame, path: str, by: str | None = None) -> None:
    """Page documents as JSON; absent keys are left out, so a line has h or p."""
    writer = documents.write.mode("overwrite").option("ignoreNullFields", True)
    (writer.partitionBy(by) if by else writer).json(path)


def as_json(document: Column) -> Column:
    """A document as the sinks write it: absent keys left out."""
    return F.to_json(document, {"ignoreNullFields": "true"})


def json_sizes(documents: DataFrame, key: str) -> DataFrame:
    """(key, bytes) of each document's JSON."""
    return documents.select(key, F.octet_length(as_json(F.struct(*[c for c in documents.columns if c != key]))).cast("bigint").alias("bytes"))


def write_report(report: DataFrame, path: str) -> None:
    """A check report as one JSON object a document, nulls kept so that every object has every key."""
    report.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A parquet table; with ``by`` only the partitions that ``df`` has are replaced."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).parquet(path)
