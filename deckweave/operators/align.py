"""Source and translated documents side by side.

Page tables have (doc, page, line_no, h, p, c) in long form.  Two ways to pair
pages exist and differ: by page number, and by place in the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_text(h: str = "h", p: str = "p") -> Column:
    """A heading's text if there is one, even if empty, else the paragraph's, else nothing."""
    return F.coalesce(F.col(h), F.col(p), F.lit(""))


def last_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The last row of each key in the ascending order of some columns, nulls first; an aggregate that combines before it shuffles, so a hot key is no task's own."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def positions(lines: DataFrame, page: list[str], order: list[str]) -> DataFrame:
    """Adds pos, the line's place on its page from 1."""
    return lines.withColumn("pos", F.row_number().over(Window.partitionBy(*page).orderBy(*order)))


def zip_lines(source: DataFrame, translated: DataFrame, page: list[str]) -> DataFrame:
    """(page..., pos, source_text, translated_text): line i with line i as far as both go; empty translations are left out."""
    a = source.select(*page, "pos", F.col("text").alias("source_text"))
    b = translated.select(*page, "pos", F.col("text").alias("translated_text"))
    return a.join(b, [*page, "pos"]).where("translated_text <> ''")


def overlay_pages(source: DataFrame, translated: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, overlaid, skipped): lines whose page has a translation, paired by page number, and lines of pages without one."""
    a = source.groupBy(doc, page).agg(F.count("*").alias("lines"))
    b = translated.groupBy(doc, page).agg(F.count("*").alias("theirs"))
    both = a.join(b, [doc, page], "left")
    return both.groupBy(doc).agg(F.sum(F.when(F.col("theirs").isNull(), 0).otherwise(F.least("lines", "theirs"))).cast("bigint").alias("overlaid"), F.sum(F.when(F.col("theirs").isNull(), F.col("lines")).otherwise(0)).cast("bigint").alias("skipped"))


def page_counts(lines: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, page, page_pos, lines): each page's lines and its place in the document."""
    own = lines.groupBy(doc, page).agg(F.count("*").alias("lines"))
    return own.withColumn("page_pos", F.row_number().over(Window.partitionBy(doc).orderBy(page)))


def page_drift(source: DataFrame, translated: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, page, source_lines, translated_lines) of pages whose counts differ, paired by place."""
    a = page_counts(source, doc, page).withColumnRenamed("lines", "source_lines")
    b = page_counts(translated, doc, page).select(doc, "page_pos", F.col("lines").alias("translated_lines"))
    return a.join(b, [doc, "page_pos"]).where("source_lines <> translated_lines").select(doc, page, "source_lines", "translated_lines")


def check_report(source: DataFrame, translated: DataFrame, doc: str, page: str) -> DataFrame:
    """One row a document: lines and pages on both sides, drift, lines in containers and their share, pages that drift."""
    a = source.groupBy(doc).agg(F.count("*").alias("source_lines"), F.countDistinct(page).alias("source_pages"), F.count_if(F.col("c").isNotNull()).alias("in_containers"))
    b = translated.groupBy(doc).agg(F.count("*").alias("translated_lines"), F.countDistinct(page).alias("translated_pages"))
    d = page_drift(source, translated, doc, page).groupBy(doc).agg(F.count("*").alias("drift_pages"))
    out = a.join(b, doc, "left").join(d, doc, "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("translated_lines", "translated_pages", "drift_pages")}
    out = out.withColumns(zero)
    share = F.floor(F.col("in_containers") * 1000.0 / F.col("source_lines") + 0.5) / 10
    return out.select(doc, "source_lines", "translated_lines", (F.col("source_lines") - F.col("translated_lines")).alias("drift"), "in_containers", share.alias("in_containers_pct"), "source_pages", "translated_pages", "drift_pages")


def same_shape(source: DataFrame, translated: DataFrame, doc: str) -> DataFrame:
    """(doc, valid): whether both have the same pages, lines and first keys.  Tables (doc, page_pos, pos, key)."""
    b = translated.withColumnsRenamed({"key": "their_key"}).withColumn("there", F.lit(True))
    both = source.withColumn("here", F.lit(True)).join(b, [doc, "page_pos", "pos"], "full_outer")
    docs = source.select(doc).distinct()
    fine = F.coalesce(F.col("here") & F.col("there") & F.col("key").eqNullSafe(F.col("their_key")), F.lit(False))
    return docs.join(both.groupBy(doc).agg(F.bool_and(fine).alias("valid")), doc).select(doc, "valid")


def fallback(source: DataFrame, translated: DataFrame, keys: list[str], empty_counts: bool) -> DataFrame:
    """Adds text: the translation where there is one, else the source; with ``empty_counts`` an empty translation is one."""
    own = source.join(translated, keys, "left")
    given = F.col("translated") if empty_counts else F.nullif("translated", F.lit(""))
    return own.withColumn("text", F.coalesce(given, F.col("source_text")))
