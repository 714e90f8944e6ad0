"""The queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import endings, languages, leakage, lookalike, pairs, pieces, repeats, tokens
from .common import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective question and answer pairs, each with its first defect."""
    return pairs.defective_pairs(table(spark, sf_dir, "answer_pairs"), table(spark, sf_dir, "segment_dictionary"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of page_lines that repeat a line of their source."""
    return repeats.repeated_lines(table(spark, sf_dir, "page_lines")).select("line_id")


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each module's lines left and taken away."""
    lines = table(spark, sf_dir, "page_lines")
    gone = repeats.repeated_lines(lines).select("line_id", F.lit(True).alias("gone"))
    marked = lines.select("line_id", "module_key").join(gone, "line_id", "left")
    removed = F.count_if(F.coalesce("gone", F.lit(False)))
    return marked.groupBy("module_key").agg((F.count("*") - removed).alias("lines_left"), removed.alias("lines_removed"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of texts that look the same but aren't the same string."""
    nodes, lines = table(spark, sf_dir, "course_nodes"), table(spark, sf_dir, "page_lines")
    own = lookalike.look_pairs(nodes, "node_id", "description").select(F.lit("description").alias("field"), "key_a", "key_b")
    ref = lookalike.look_matches(table(spark, sf_dir, "segment_dictionary"), "seg_id", "p", lines, "line_id", "p")
    return own.unionByName(ref.select(F.lit("p").alias("field"), "key_a", "key_b"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each description and its number of links to other strings of one look."""
    own = lookalike.look_classes(table(spark, sf_dir, "course_nodes"), "node_id", "description")
    return own.select("node_id", "canonical", "links")


def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical form of each description; a null or blank one keeps its own value."""
    nodes = table(spark, sf_dir, "course_nodes").select("node_id", F.col("description").alias("value"))
    return lookalike.canonical_values(nodes, "value").select("node_id", "canonical")


def p3_canonical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical form of each text p of page_lines, among the lines' and the dictionary's texts; a text without a class keeps its own value."""
    lines = table(spark, sf_dir, "page_lines").select("line_id", F.col("p").alias("value"))
    return lookalike.canonical_values(lines, "value", table(spark, sf_dir, "segment_dictionary").select(F.col("p").alias("value"))).select("line_id", "canonical")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages over the limit: those that come out in more than one piece."""
    return pieces.oversized_bounds(table(spark, sf_dir, "page_docs")).where("piece_no = 2").select("page_doc_id", "n")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every page over the limit."""
    return pieces.oversized_pages(table(spark, sf_dir, "page_docs"))


def p4_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page over the limit put together again from its pieces, and whether all of them are within it."""
    own = pieces.joined(pieces.oversized_pages(table(spark, sf_dir, "page_docs")), ["page_doc_id", "n"])
    return own.select("page_doc_id", "n", F.md5("text").alias("digest"), (F.col("longest") <= pieces.LIMIT).alias("fits"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a missing or wrong label, and lines in another language than their document."""
    return languages.wrong_languages(table(spark, sf_dir, "translated_lines"), table(spark, sf_dir, "segment_dictionary")).select("tdoc_id", "line_no", "lang")


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language and a confidence of every document and of every deviating line."""
    own = languages.all_languages(table(spark, sf_dir, "translated_lines"), table(spark, sf_dir, "segment_dictionary"))
    return own.select("tdoc_id", "line_no", "lang", F.round("confidence", 4).alias("confidence"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_table(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the evaluation items they leak."""
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents leak each item, and the largest share of it that one holds."""
    own = leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return own.groupBy("item_id").agg(F.count("*").alias("documents"), F.round(F.max("held"), 4).alias("most_held"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that stop before they are over."""
    return endings.score_endings(table(spark, sf_dir, "documents")).where("cut").select("doc_id")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each source's texts are cut."""
    scored = endings.score_endings(table(spark, sf_dir, "documents"), keep=["source"])
    return scored.groupBy("source").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut_texts"), F.round(F.count_if("cut") / F.count("*"), 6).alias("cut_share"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p2_found, p2_clean, p3_found, p3_classes, p3_canonical, p3_canonical_lines, p4_found, p4_pieces, p4_joined, p5_found, p5_languages, p6_ids, p7_found, p7_report, p8_found, p8_report)
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
