"""One form for texts that look the same but differ in characters.

Two layers.  ``look_form`` (a JVM-side Column) and ``fold_look`` (its Python
twin) rewrite full-width forms, ligatures, spaces, invisible characters and
letters of other scripts, then compose accents.  ``canonical_members`` groups
the rewritten values under the accent- and case-sensitive ``UNICODE`` collation,
picks one member of each class and joins it back.

Defined results: a null value has a null form and no class; a text made only of
spaces and invisible characters is blank and takes part in no class; repeated
strings share one class; letter case, accents, raised digits, and the number of
spaces keep texts apart.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_join

# Letters of other scripts drawn like a Latin letter.
LETTERS_FROM = (
    "АВЕЅІЈКМНОРСТХУҮӀԌԚԜ" "аеорсухѕіјһԁԛԝѵӏ" "ЁЇёї" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ονϲϳ" "օɑɡ" "αγιρυ" "ոսհցզ"
)
LETTERS_TO = (
    "ABESIJKMHOPCTXYYIGQW" "aeopcyxsijhdqwvl" "ËÏëï" "ABEZHIKMNOPTYX" "ovcj" "oag" "ayipu" "nuhgq"
)
# Spaces other than U+0020, and hyphens drawn like "-".
SPACES = "\t               　"
HYPHENS = "‐‑"
# Ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
# Ranges of characters that show nothing.
INVISIBLE_RANGES = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xE0000, 0xE0FFF),
)

# Letters and digits in a mathematical font, by their decomposition.
FONT_FROM = "".join(c for c in map(chr, (*range(0x2100, 0x2150), *range(0x1D400, 0x1D800))) if unicodedata.decomposition(c).startswith("<font>") and unicodedata.normalize("NFKC", c).isascii())
FONT_TO = "".join(unicodedata.normalize("NFKC", c) for c in FONT_FROM)

FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F)))
ONE_FROM = FULL_WIDTH + SPACES + HYPHENS + LETTERS_FROM + FONT_FROM
ONE_TO = "".join(chr(ord(c) - 0xFEE0) for c in FULL_WIDTH) + " " * len(SPACES) + "-" * len(HYPHENS) + LETTERS_TO + FONT_TO

INVISIBLE = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in INVISIBLE_RANGES) + "]"
# Texts of only these characters are their own form: printable ASCII and composed Latin letters.
NOT_PLAIN = "[^ -~\\x{A1}-\\x{AC}\\x{AE}-\\x{17F}]"
MARKS = "[\\x{300}-\\x{36F}]"

_TABLE = dict(zip(ONE_FROM, ONE_TO)) | LIGATURES | {chr(c): "" for a, b in INVISIBLE_RANGES for c in range(a, b + 1)}
_ODD = re.compile("[^ -~\n¡-¬®-ſ]")


def fold_look(text: str) -> str:
    """The Python twin of ``look_form`` for a text that isn't None."""
    if not _ODD.search(text):
        return text
    text = _ODD.sub(lambda m: _TABLE.get(m[0], m[0]), text.replace("\r\n", "\n"))
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def look_form(name: str) -> Column:
    """The form of column ``name`` under which texts that look the same are (nearly always) equal; null stays null.

    Plain texts leave the expression after one scan of a character class; only
    the rest pay for the rewriting and the composition of accents.
    """
    x = f"`{name}`"
    plain = f"regexp_replace(replace({x}, '\\r\\n', '\\n'), {_sql(INVISIBLE)}, '')"
    mapped = f"translate({plain}, {_sql(ONE_FROM)}, {_sql(ONE_TO)})"
    ligated = mapped
    for a, b in LIGATURES.items():
        ligated = f"replace({ligated}, '{a}', '{b}')"
    mapped = f"CASE WHEN {x} RLIKE '[\\\\x{{FB00}}-\\\\x{{FB06}}]' THEN {ligated} ELSE {mapped} END"
    composed = f"reflect('com.ibm.icu.text.Normalizer', 'compose', coalesce({mapped}, ''), false)"
    return F.expr(f"CASE WHEN {x} RLIKE {_sql(NOT_PLAIN)} THEN {composed} ELSE {x} END")


def is_plain(name: str) -> Column:
    """True for texts that are their own form; null for null."""
    return ~F.col(name).rlike(NOT_PLAIN)


def with_look(df: DataFrame, value: str, look: str = "look") -> DataFrame:
    """``df`` without null and blank values, with the form of ``value``."""
    out = df.where(F.col(value).isNotNull()).withColumn(look, look_form(value))
    return out.where(F.trim(look) != "")


def canonical_members(values: DataFrame, value: str = "value", look: str = "look") -> DataFrame:
    """Classes of values under the collation: (value, canonical), one row for each distinct value.

    ``values`` has the columns value and look (``with_look``).  The canonical
    member is the least value that is its own form, else the least value.
    """
    spark = values.sparkSession
    distinct = values.select(F.col(value).alias("value"), F.col(look).alias("look")).distinct()
    return spark.sql(
        """
        WITH classes AS (
          SELECT collate(look, 'UNICODE') AS class, min_by(value, struct(value <> look, value)) AS canonical
          FROM {v} GROUP BY collate(look, 'UNICODE'))
        SELECT v.value, c.canonical FROM {v} v JOIN classes c ON collate(v.look, 'UNICODE') = c.class
        """,
        v=distinct,
    )


def canonical_values(rows: DataFrame, value: str, others: DataFrame | None = None) -> DataFrame:
    """Adds canonical to every row: its class's member among the rows' and the others' values, or its own value if it has no class."""
    values = rows.select(F.col(value).alias("value"))
    if others is not None:
        values = values.unionByName(others.select("value"))
    members = canonical_members(with_look(values.distinct(), "value")).withColumnRenamed("value", "_value")
    return rows.join(members, F.col(value) == F.col("_value"), "left").drop("_value").withColumn("canonical", F.coalesce("canonical", value))


def look_pairs(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key_a, key_b), key_a < key_b, of rows whose values look the same but aren't the same string.

    Classes are paired on the level of distinct strings, so that exact copies
    meet only the members they differ from; the output is what the result asks
    for and no pair of equal strings is ever formed.
    """
    own = with_look(rows.select(F.col(key).alias("k"), F.col(value).alias("value")), "value")
    members = canonical_members(own)
    a, b = members.select("canonical", F.col("value").alias("a")), members.select("canonical", F.col("value").alias("b"))
    strings = a.join(b, "canonical").where("a <> b").select("a", "b")
    left, right = own.select(F.col("k").alias("key_a"), F.col("value").alias("a")), own.select(F.col("k").alias("key_b"), F.col("value").alias("b"))
    return strings.join(left, "a").join(right, "b").where("key_a < key_b").select("key_a", "key_b")


def look_classes(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, canonical, links): the class of every row that isn't blank, and how many rows of it hold another string.

    Copies are counted, not paired: what ``look_pairs`` lists, in one row a row.
    """
    own = with_look(rows.select(F.col(key).alias("k"), F.col(value).alias("value")), "value")
    many = canonical_members(own).join(own.groupBy("value").agg(F.count("*").alias("copies")), "value")
    whole = many.groupBy("canonical").agg(F.sum("copies").alias("all"))
    links = many.join(whole, "canonical").select("value", "canonical", (F.col("all") - F.col("copies")).alias("links"))
    return salted_join(own.select("k", "value"), links, ["value"], F.xxhash64("k"), F.lit(8)).select(F.col("k").alias(key), "canonical", "links")


def look_matches(reference: DataFrame, ref_key: str, ref_value: str, rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key_a, key_b): a reference value and a row's value that look the same but aren't the same string.

    Of two different strings with one look at least one isn't plain.  So a plain
    row can only matter if it is the form of a reference value that isn't plain;
    the other plain rows are left out before anything is shuffled.
    """
    ref = with_look(reference.select(F.col(ref_key).alias("key_a"), F.col(ref_value).alias("value")), "value")
    odd = ref.where("value <> look").select(F.col("look").alias("value"), F.lit(True).alias("odd")).distinct()
    lines = rows.select(F.col(key).alias("key_b"), F.col(value).alias("value"))
    lines = lines.join(odd, "value", "left").where(~is_plain("value") | F.col("odd"))
    lines = cut(with_look(lines.select("key_b", "value"), "value"))  # the few rows in question, read three times below
    members = canonical_members(ref.select("value", "look").unionByName(lines.select("value", "look")))
    a = ref.join(members, "value").select("canonical", "key_a", F.col("value").alias("a"))
    b = lines.join(members, "value").select("canonical", "key_b", F.col("value").alias("b"))
    return a.join(b, "canonical").where("a <> b").select("key_a", "key_b")
