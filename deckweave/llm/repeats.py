"""Lines repeated across the documents (here modules) of one source.

Each line's modules are a compressed bitmap: only its words of 64 bits that are
not zero exist, one row each, so a bitmap of any length is built, united and
counted by hash aggregates that combine before they shuffle, and no group is
ever gathered in one row.  Variants of a line (case, spacing, digits, look-alike
characters) have bitmaps of their own, united under the line's key.

Defined results: a null, blank or letterless p is no line; a null source belongs
to no site; a row without module_key counts for no module and is kept; an empty
table gives no rows; a row delivered again sets the same bit again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .lookalike import look_form

MIN_MODULES = 3
ONE_IN = 5  # a repeated line stands in at least one of so many modules of its source


def line_key(look: str) -> Column:
    """Letter case, spacing and the value and length of runs of digits put aside."""
    x = F.replace(F.lower(look), F.lit("ß"), F.lit("ss"))
    x = F.when(F.col(look).rlike("[0-9]"), F.regexp_replace(x, "[0-9]+", "0")).otherwise(x)
    x = F.replace(x, F.lit(" "))
    x = F.when(F.col(look).rlike("[\\n\\r\\x0B\\f]"), F.regexp_replace(x, "\\s+", "")).otherwise(x)
    return x


def keyed_lines(lines: DataFrame) -> DataFrame:
    """(line_id, source, module_key, k1, k2, variant): the line as two hashes of its key, 128 bits in all, and a hash of its spelling."""
    own = lines.where("p IS NOT NULL AND source IS NOT NULL").select("line_id", "source", "module_key", "p", look_form("p").alias("look"))
    own = own.where(F.col("look").rlike("\\p{L}")).withColumn("key", line_key("look"))
    return own.select("line_id", "source", "module_key", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("second"), "key").alias("k2"), F.xxhash64("p").alias("variant"))


def _word() -> list[Column]:
    return [F.shiftright("module_key", 6).alias("word_no"), F.expr("shiftleft(1L, cast(module_key & 63L AS INT))").alias("bit")]


def variant_bitmaps(keyed: DataFrame) -> DataFrame:
    """(source, k1, k2, variant, word_no, word): the bitmap of each spelling."""
    own = keyed.where("module_key IS NOT NULL").select("source", "k1", "k2", "variant", *_word())
    return own.groupBy("source", "k1", "k2", "variant", "word_no").agg(F.bit_or("bit").alias("word"))


def line_bitmaps(variants: DataFrame, min_modules: int = MIN_MODULES) -> DataFrame:
    """(source, k1, k2, word_no, word, in_modules): the variants' bitmaps united, with the number of bits of the whole bitmap, for lines in enough modules.

    Union and count are aggregates that combine before they shuffle; a line's
    words lie in as many tasks as there are, however hot the line is, and only the
    few lines that repeat come back to their words.
    """
    line = ["source", "k1", "k2"]
    united = cut(variants.groupBy(*line, "word_no").agg(F.bit_or("word").alias("word")))  # read twice below
    sizes = united.groupBy(*line).agg(F.sum(F.bit_count("word")).alias("in_modules")).where(F.col("in_modules") >= min_modules)
    return united.join(sizes, line)


def source_sizes(lines: DataFrame) -> DataFrame:
    """(source, modules): the exact number of modules of each source, over all of its rows."""
    own = lines.where("source IS NOT NULL AND module_key IS NOT NULL").select("source", *_word())
    words = own.groupBy("source", "word_no").agg(F.bit_or("bit").alias("word"))
    return words.groupBy("source").agg(F.sum(F.bit_count("word")).alias("modules"))


def repeated_bitmaps(lines: DataFrame, min_modules: int = MIN_MODULES, one_in: int = ONE_IN) -> DataFrame:
    """(source, k1, k2, word_no, word, in_modules, modules) of the lines over both thresholds."""
    bitmaps = line_bitmaps(variant_bitmaps(keyed_lines(lines)), min_modules)
    return bitmaps.join(source_sizes(lines), "source").where(F.col("in_modules") * one_in >= F.col("modules"))


def repeated_lines(lines: DataFrame, min_modules: int = MIN_MODULES, one_in: int = ONE_IN) -> DataFrame:
    """(line_id, source, module_key, in_modules, modules): the rows to delete, found by a look at their module's bit."""
    maps = repeated_bitmaps(lines, min_modules, one_in)
    rows = keyed_lines(lines).where("module_key IS NOT NULL").withColumns({"word_no": F.shiftright("module_key", 6)})
    hit = rows.join(maps, ["source", "k1", "k2", "word_no"]).where("(shiftright(word, cast(module_key & 63L AS INT)) & 1L) = 1L")
    return hit.select("line_id", "source", "module_key", "in_modules", "modules")


def without_repeated_lines(lines: DataFrame, min_modules: int = MIN_MODULES, one_in: int = ONE_IN) -> DataFrame:
    """``lines`` less the repeated ones; every other row and column stays as it is."""
    return lines.join(repeated_lines(lines, min_modules, one_in).select("line_id"), "line_id", "left_anti")
