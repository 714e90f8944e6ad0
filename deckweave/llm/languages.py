"""Languages of documents and of the lines that deviate from their document's.

Every line is read once by the Bloom filters of ``langid``; a document's language
is the one most of its text (by letters) is in, a line deviates if it is a
sentence in another one.

Defined results: null and blank lines and lines without words have no language;
a document without any has none and is no case; on a tie the language listed
first in ``LANGS`` wins; a line delivered again counts once; labels
in any notation of a language are equal, and words for "unknown" are no label;
rows without their keys are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, cut, least_by_hash, spread
from .langid import LANGS, MAX_TRAIN, NAMES, LanguageFilters, letters, pick

#: A sentence has at least so many words of two letters or more.
SENTENCE_WORDS = 3


def known_texts(segments: DataFrame) -> tuple[list[str], list[str]]:
    """Texts with a language from a table (p, translated, source_lang), those of the ``MAX_TRAIN`` least hashes."""
    rows = least_by_hash(segments, ["p", "translated", "source_lang"], MAX_TRAIN)
    known = [(r["p"], r["source_lang"]) for r in rows if r["p"] and r["source_lang"] in LANGS]
    known += [(r["translated"], "tl") for r in rows if r["translated"]]
    return [t for t, _ in known], [x for _, x in known]


def fit_filters(segments: DataFrame, texts: DataFrame, text: str) -> LanguageFilters:
    """Filters from labelled segments, fitted again with the ``MAX_TRAIN`` texts of the least hashes."""
    known = known_texts(segments)
    sample = least_by_hash(texts.where(f"length(trim({text})) > 0").select(F.col(text).alias("t")), ["t"], MAX_TRAIN)
    return LanguageFilters.fit(*known).refit(known, [r["t"] for r in sample])


def label_language(label: str) -> Column:
    """The language that a label column names, null for none."""
    head = F.element_at(F.split(F.lower(F.trim(F.col(label))), "[-_\\s]"), 1)
    names = F.create_map(*(F.lit(x) for pair in ({x: x for x in LANGS} | NAMES).items() for x in pair))
    return F.try_element_at(names, head)


def line_languages(lines: DataFrame, filters: LanguageFilters, keys: list[str], text: str) -> DataFrame:
    """(keys..., lang, confidence, size, sentence) of every line with words."""
    fields = {f.name: f.dataType.simpleString() for f in lines.schema.fields}
    shape = ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", lang string, confidence double, size bigint, sentence boolean"
    held = Shared(lines.sparkSession, filters)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, texts = pd.factorize(pdf[text])
            own = [letters(t) for t in texts]
            best, sure = pick(held.value.scores_of(own)[0])
            out = pdf[keys].copy()
            out["lang"] = np.array([*LANGS, None], dtype=object)[best][at]
            out["confidence"] = sure.astype(np.float64)[at]
            out["size"] = np.array([len(t) for t in own], dtype=np.int64)[at]
            out["sentence"] = np.array([sum(len(w) > 1 for w in t.split()) >= SENTENCE_WORDS for t in own], dtype=bool)[at]
            yield out[out["lang"].notna()]

    named = lines.select(*keys, text).dropna(subset=keys).where(f"length(trim({text})) > 0")
    return spread(named).mapInPandas(read, shape)


def once(read: DataFrame) -> DataFrame:
    """A row for each line and language, however often the line was delivered; written once, as it is read twice."""
    return cut(read.groupBy("tdoc_id", "line_no", "lang").agg(F.max("size").alias("size"), F.max("confidence").alias("confidence"), F.bool_or("sentence").alias("sentence")))


def document_languages(read: DataFrame, doc: str = "tdoc_id") -> DataFrame:
    """(doc, main, confidence) from line languages, one row a line (``once``): confidence is the main language's share of the text times its lines' mean confidence."""
    by = read.groupBy(doc, "lang").agg(F.sum("size").alias("size"), F.avg("confidence").alias("sure"))
    rank = F.struct(F.col("size"), -F.array_position(F.lit(list(LANGS)), F.col("lang")), F.col("sure"))
    best = by.groupBy(doc).agg(F.max_by("lang", rank).alias("main"), F.max(rank)["size"].alias("most"), F.max(rank)["sure"].alias("sure"), F.sum("size").alias("all"))
    return best.select(doc, "main", (F.col("most") / F.col("all") * F.col("sure")).alias("confidence"))


def _deviating(read: DataFrame, main: DataFrame) -> DataFrame:
    """(tdoc_id, line_no, lang, confidence) of the sentences in another language than their document's."""
    return read.where("sentence").join(main.select("tdoc_id", "main"), "tdoc_id").where("lang <> main").select("tdoc_id", "line_no", "lang", "confidence")


def all_languages(lines: DataFrame, segments: DataFrame) -> DataFrame:
    """(tdoc_id, line_no, lang, confidence): every document (line_no 0) and every deviating line."""
    read = once(line_languages(lines, fit_filters(segments, lines, "p"), ["tdoc_id", "line_no"], "p"))
    main = document_languages(read)
    return main.select("tdoc_id", F.lit(0).alias("line_no"), F.col("main").alias("lang"), "confidence").unionByName(_deviating(read, main))


def wrong_languages(lines: DataFrame, segments: DataFrame) -> DataFrame:
    """(tdoc_id, line_no, lang, confidence): documents (line_no 0) whose label is missing or wrong, and deviating lines."""
    read = once(line_languages(lines, fit_filters(segments, lines, "p"), ["tdoc_id", "line_no"], "p"))
    main = document_languages(read)
    labels = lines.groupBy("tdoc_id").agg(F.max(label_language("target_lang")).alias("label"))
    documents = main.join(labels, "tdoc_id").where("label IS NULL OR label <> main").select("tdoc_id", F.lit(0).alias("line_no"), F.col("main").alias("lang"), "confidence")
    return documents.unionByName(_deviating(read, main))
