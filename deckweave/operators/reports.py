"""Smaller reports and texts made from the layout's and the alignment's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckweave.functions import text as T

# Messages of failures that another try may mend.
TRANSIENT = "(?i)socket hang up|econnreset|etimedout|eai_again|network"


def page_texts(items: DataFrame, page: list[str]) -> DataFrame:
    """(page..., text): a page's items in their order with a space between, white space collapsed; blank pages have an empty text."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda i: i["text"])
    return items.groupBy(*page).agg(T.collapse(F.array_join(ordered, " ")).alias("text"))


def container_stats(held: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, pages, containers, per_page): boxes of each document and their mean a page, to one place; pages without boxes count."""
    counts = pages.join(held.groupBy("doc", "page").agg(F.count("*").alias("n")), ["doc", "page"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    own = counts.groupBy("doc").agg(F.count("*").alias("pages"), F.sum("n").cast("bigint").alias("containers"))
    return own.withColumn("per_page", F.floor(F.col("containers") * 10.0 / F.col("pages") + 0.5) / 10)


def union_boxes(boxes: DataFrame, key: list[str]) -> DataFrame:
    """(key..., x, y, width, height): the box round all boxes of a key."""
    right, top = F.max(F.col("x") + F.col("width")), F.max(F.col("y") + F.col("height"))
    return boxes.groupBy(*key).agg(F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("width"), (top - F.min("y")).alias("height"))


def drift_list(drift: DataFrame, doc: str) -> DataFrame:
    """(doc, drift): the pages that drift as an array of structs, by page."""
    return drift.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("page", "source_lines", "translated_lines"))).alias("drift"))


def length_ratio(pairs: DataFrame, doc: str) -> DataFrame:
    """(doc, source_chars, translated_chars, ratio): null where the source has no characters."""
    own = pairs.groupBy(doc).agg(F.sum(F.length("source_text")).alias("source_chars"), F.sum(F.length("translated_text")).alias("translated_chars"))
    return own.withColumn("ratio", F.round(F.try_divide("translated_chars", "source_chars"), 6))


def module_json(pages: DataFrame, doc: str) -> DataFrame:
    """(doc, page_count, json): {"PAGE n": {original, translated}} of each document; a missing or empty translation is the original."""
    source = F.coalesce("source_text", F.lit(""))
    entry = F.struct(F.col("page"), F.concat(F.lit("PAGE "), F.col("page")).alias("name"), F.struct(source.alias("original"), F.coalesce(F.nullif("translated_text", F.lit("")), source).alias("translated")).alias("texts"))
    own = pages.groupBy(doc).agg(F.sort_array(F.collect_list(entry)).alias("all"))
    return own.select(doc, F.size("all").cast("bigint").alias("page_count"), F.to_json(F.map_from_entries(F.transform("all", lambda e: F.struct(e["name"], e["texts"])))).alias("json"))


def prompt(json: Column, language: str) -> Column:
    """What a model is asked for: the texts of a page document in another language, in the same shape."""
    head = f"Translate all texts under h and p of this JSON to {language}.\nLeave keys, order and shape as they are and give the JSON alone.\n"
    return F.concat(F.lit(head), json)


def endpoint(base: Column) -> Column:
    """The address of a chat service from its base, however many slashes end it."""
    return F.concat(F.regexp_replace(base, "/+\\z", ""), F.lit("/chat/completions"))


def retryable(status: Column, message: Column) -> Column:
    """Whether a failure may go away: a status of an overloaded server, or a message of a lost connection; false for null."""
    return F.coalesce(status.isin(429, 500, 502, 503, 504), F.lit(False)) | F.coalesce(message.rlike(TRANSIENT), F.lit(False))


def slide_header(title: Column, page: Column) -> Column:
    return F.format_string("%s - Page %s", F.coalesce(title, F.lit("module")), page.cast("string"))


def slide_body(text: Column) -> Column:
    """A slide's text, or what stands for none."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("(no text)"))
