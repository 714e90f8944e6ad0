"""Backends that translate whole page documents, each with an outcome for every document.

Documents are (key, meta, pages) with pages as in ``PAGES``; a backend gives
(key, status, reason, translated), where translated is the JSON of the document
in the other language and null without one.

Defined results: a document without pages is one of no pages; a repeated row has
its outcome each time; a reply in another shape than its source is a failure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckweave.operators import reports, translate

Call = Callable[[str], str | None]
PAGES = "array<struct<n:int,lines:array<struct<h:string,p:string,c:int>>>>"


def page_shape(pages: Column) -> Column:
    """What a translation must have in common with its source: the pages, their lines and the key of each line."""
    key = lambda x: F.when(x["h"].isNotNull(), "h").when(x["p"].isNotNull(), "p").otherwise("")
    lines = lambda p: F.coalesce(F.transform(p["lines"], key), F.array().cast("array<string>"))
    return F.coalesce(F.transform(pages, lambda p: F.array_join(lines(p), ",")), F.array().cast("array<string>"))


def identity_documents(documents: DataFrame, key: str) -> DataFrame:
    """Nothing is translated: every document is skipped."""
    return documents.select(key, F.lit("skipped").alias("status"), F.lit("identity does not translate").alias("reason"), F.lit(None).cast("string").alias("translated"))


def manual_documents(documents: DataFrame, siblings: DataFrame, key: str, path: str, lang: str) -> DataFrame:
    """What people put beside the source: translated if the sibling (path, raw) is there and JSON, pending if it isn't there, failed without a source path or on anything else."""
    own = documents.select(key, F.col(path).alias("_path"), translate.translated_path(F.col(path), lang).alias("_expected"))
    found = siblings.select(F.col("path").alias("_expected"), "raw")
    own = own.join(found.groupBy("_expected").agg(F.max("raw").alias("raw"), F.lit(True).alias("there")), "_expected", "left")
    there, fine = F.coalesce("there", F.lit(False)), F.try_parse_json("raw").isNotNull()
    status = F.when(F.col("_path").isNull(), "failed").when(~there, "pending").when(fine, "translated").otherwise("failed")
    reason = F.when(F.col("_path").isNull(), "no source path").when(~there, F.concat(F.lit("awaiting "), "_expected")).when(~fine, F.concat("_expected", F.lit(" is not JSON")))
    return own.select(key, status.alias("status"), reason.alias("reason"), F.when(status == "translated", F.col("raw")).alias("translated"))


def called_documents(documents: DataFrame, key: str, call: Call, lang: str, name: str = "callable", attempts: int = 5) -> DataFrame:
    """A call for each document: prompt, answer, JSON, shape, and the source's meta with what the translation adds.

    Only the calls run in Python; a call that fails is tried again after a pause,
    and if it fails for good its document does, not the job.
    """
    kind = documents.schema[key].dataType.simpleString()
    source = F.to_json(F.struct("meta", "pages"))
    own = documents.select(F.col(key).alias("_key"), "meta", "pages").withColumns({"_of": F.xxhash64(source), "_prompt": reports.prompt(source, lang)})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [_tried(call, p, attempts) for p in pdf["_prompt"]]
            yield pdf[["k", "of"]].assign(raw=[r for r, _ in out], error=[e for _, e in out])

    asked = own.select(F.col("_key").alias("k"), F.col("_of").alias("of"), "_prompt").dropDuplicates(["k", "of"])
    replies = asked.mapInPandas(work, f"k {kind}, of bigint, raw string, error string")
    own = own.join(replies, F.col("_key").eqNullSafe(F.col("k")) & (F.col("_of") == F.col("of")), "left")
    own = own.withColumn("reply", translate.reply_lenient(F.col("raw")))
    own = own.withColumn("theirs", F.from_json(F.to_json("reply"), f"pages {PAGES}")["pages"])
    same = F.coalesce(page_shape(F.col("theirs")) == page_shape(F.col("pages")), F.lit(False)) & F.col("theirs").isNotNull()
    reason = F.when(F.col("error").isNotNull(), F.concat(F.lit("call failed: "), "error")).when(F.col("reply").isNull(), "reply is not JSON").when(~same, "reply has another structure")
    meta = F.col("meta").withField("target_lang", F.lit(lang)).withField("translator", F.lit(name)).withField("translated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    done = F.to_json(F.struct(meta.alias("meta"), F.col("theirs").alias("pages")))
    return own.select(F.col("_key").alias(key), F.when(reason.isNull(), "translated").otherwise("failed").alias("status"), reason.alias("reason"), F.when(reason.isNull(), done).alias("translated"))


def _tried(call: Call, text: str, attempts: int) -> tuple[str | None, str | None]:
    try:
        return translate.again(lambda: call(text), attempts), None
    except Exception as e:  # the last of the attempts
        return None, str(e) or type(e).__name__


def page_map_translation(maps: DataFrame, key: str, pages: str, call: Call, lang: str, attempts: int = 5) -> DataFrame:
    """(key, pages): each map of page names to texts in another language.

    One call for a whole map; where its reply is no JSON object, a call for each
    page.  Names stay the source's, and a page without a text in the reply keeps its own; a null map stays null.
    """
    kind = maps.schema[key].dataType.simpleString()
    own = maps.select(F.col(key).alias("key"), F.col(pages).alias("pages"), reports.prompt(F.to_json(F.col(pages)), lang).alias("prompt"))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["key", "names", "texts"]].assign(raw=[_tried(call, p, attempts)[0] if n is not None and len(n) else None for p, n in zip(pdf["prompt"], pdf["names"])])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [None if ts is None else [_tried(call, t, attempts)[0] if alone else None for t in ts] for ts, alone in zip(pdf["texts"], pdf["alone"])]
            yield pdf[["key", "names", "texts", "reply"]].assign(single=found)

    parts = own.select("key", F.map_keys("pages").alias("names"), F.map_values("pages").alias("texts"), "prompt")
    asked = parts.mapInPandas(whole, f"key {kind}, names array<string>, texts array<string>, raw string")
    reply = translate.reply_object(F.col("raw"))
    asked = asked.withColumn("reply", F.from_json(F.to_json(reply), "map<string,string>")).withColumn("alone", reply.isNull())
    asked = asked.select("key", "names", "texts", F.transform("names", lambda n: F.try_element_at("reply", n)).alias("reply"), "alone")
    out = asked.mapInPandas(each, f"key {kind}, names array<string>, texts array<string>, reply array<string>, single array<string>")
    kept = F.expr("transform(texts, (t, i) -> coalesce(reply[i], single[i], t))")
    return out.select(F.col("key").alias(key), F.map_from_arrays("names", kept).alias("pages"))
