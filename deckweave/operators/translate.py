"""Pluggable translation: backends, one call a distinct text, status and cache rules, and parsing of replies."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckweave.functions import text as T

Backend = Callable[[DataFrame], DataFrame]
_BACKENDS: dict[str, Callable[..., Backend]] = {}


def register(name: str) -> Callable[[Callable[..., Backend]], Callable[..., Backend]]:
    """Registers a maker of backends; a backend takes (text) and gives (text, translated), null where it has none."""

    def put(make: Callable[..., Backend]) -> Callable[..., Backend]:
        _BACKENDS[name] = make
        return make

    return put


def backend(name: str, **options) -> Backend:
    if name not in _BACKENDS:
        raise ValueError(f"unknown backend {name!r}; there are {', '.join(sorted(_BACKENDS))}")
    return _BACKENDS[name](**options)


def default_backend(asked: str | None = None, configured: str | None = None, key: str | None = None) -> str:
    """What was asked for, else what is configured, else the callable one if there is a key, else the dictionary."""
    return asked or configured or ("callable" if key else "dictionary")


@register("identity")
def _identity() -> Backend:
    return lambda texts: texts.select("text", F.lit(None).cast("string").alias("translated"))


@register("dictionary")
def _dictionary(entries: DataFrame | None = None, source: str = "p", target: str = "translated") -> Backend:
    """Looks texts up in a table; the join is broadcast only if Spark finds the table small."""
    table = None
    if entries is not None:
        own = entries.select(T.collapse(F.col(source)).alias("text"), F.col(target).alias("translated"))
        table = own.groupBy("text").agg(F.min("translated").alias("translated"))

    def run(texts: DataFrame) -> DataFrame:
        if table is None:
            return texts.select("text", F.lit(None).cast("string").alias("translated"))
        return texts.join(table, "text", "left")

    run.table = table
    return run


@register("callable")
def _callable(translate: Callable[[list[str]], list[str | None]], attempts: int = 5) -> Backend:
    """Sends batches of texts to a Python function, again after a pause if it fails."""

    def run(texts: DataFrame) -> DataFrame:
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"text": pdf["text"], "translated": again(lambda pdf=pdf: translate(pdf["text"].tolist()), attempts)})

        return texts.mapInPandas(work, "text string, translated string")

    return run


def pause(attempt: int, draw: float) -> int:
    """Milliseconds before another try: any time up to 1 s doubled with each attempt, 30 s at most."""
    return int(draw * min(30_000, 1000 * 2 ** (attempt - 1)))


def again(call: Callable, attempts: int, wait: Callable[[float], None] | None = None):
    import time

    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Exception:
            if attempt == attempts:
                raise
            (wait or time.sleep)(pause(attempt, random.random()) / 1000)
    return None


def translate_column(df: DataFrame, text: str, run: Backend, out: str = "translated") -> DataFrame:
    """Adds ``out``: each distinct text (white space collapsed) goes to the backend once and is joined back; texts without one stay as they are.

    A backend that is a table anyway is joined as it is, without the detour over the distinct texts.
    """
    own = df.withColumn("_text", T.collapse(F.col(text)))
    found = getattr(run, "table", None)
    if found is None:
        found = run(own.where("_text <> ''").select(F.col("_text").alias("text")).distinct())
    found = found.where("translated IS NOT NULL").select(F.col("text").alias("_text"), F.col("translated").alias("_new"))
    return own.join(found, "_text", "left").withColumn(out, F.coalesce("_new", "_text")).drop("_text", "_new")


def reply_object(raw: Column) -> Column:
    """The JSON object of a reply as a variant: the whole of it, else what stands between fences; null for anything else."""
    x = T.strip(raw)
    fenced = F.regexp_extract(x, "(?is)```(?:json)?\\s*(.*?)\\s*```", 1)

    def is_object(v: Column) -> Column:
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)

    return F.coalesce(is_object(F.try_parse_json(x)), is_object(F.try_parse_json(fenced)))


def reply_lenient(raw: Column) -> Column:
    """Any JSON of a reply less its fences, else the widest {...} in it."""
    x = T.strip(F.regexp_replace(F.regexp_replace(raw, "(?i)\\A```(?:json)?\\s*", ""), "\\s*```\\z", ""))
    return F.coalesce(F.try_parse_json(x), F.try_parse_json(F.regexp_extract(x, "(?s)\\{.*\\}", 0)))


def translated_path(path: Column, lang: str) -> Column:
    """The sibling of a file for a language: name.lang.ext."""
    return F.regexp_replace(path, "^(.*?)(\\.[^./]*)?\\z", f"$1.{lang}$2")


def cache_reason(d: dict[str, Column]) -> Column:
    """Why a cached translation can't be used, by the first rule it fails; null if it can."""
    schema = d["source_schema"].isNotNull() & d["cached_schema"].isNotNull() & (d["source_schema"] != d["cached_schema"])
    return (
        F.when(~d["source_readable"], "source unreadable").when(~d["cached_readable"], "cached unreadable")
        .when(schema, F.concat(F.lit("schema "), d["cached_schema"], F.lit(" != "), d["source_schema"]))
        .when(d["cached_pages"] != d["source_pages"], F.concat(F.lit("page count "), d["cached_pages"].cast("string"), F.lit(" != "), d["source_pages"].cast("string")))
        .when(d["first_drift"].isNotNull(), F.concat(F.lit("page "), d["first_drift"].cast("string"), F.lit(" lines differ")))
    )


def status_of(source: Column, cached: Column, reason: Column, result: Column) -> Column:
    """The status of a translation from its source, its cache and the backend's result."""
    return (
        F.when(~source, "no-source").when(cached & reason.isNull(), "translated").when(result == "translated", "translated")
        .when(result == "pending", "pending").when(result == "skipped", "skipped").when(cached, "translated").otherwise("failed")
    )
