"""Text expressions, all on the JVM side.

White space is the Unicode set a browser trims, digits and word characters are
ASCII, lengths are in code points, and ``\\z`` marks the end of a text.  Null in,
null out unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space.
SPACE = "[\\s\\x{0B}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
# The marks that end a sentence, the starts of list items, and the names of bold fonts.
SENTENCE_FINAL = "[.!?…:][\"'”’]?" + SPACE + "*\\z"
LIST_START = "^" + SPACE + "*([•·●▪■◆\\-*]|[0-9]+([.)]|" + SPACE + ")|[A-Z]([.)]|" + SPACE + ")|\\([a-z0-9]+\\))"
BOLD = "(?i)bold|black|heavy"
CAPS_HEADING = "^[A-Z0-9 \\-:.,]+\\z"
ONLY_PUNCTUATION = "^([0-9.,:;!?()\\-_/]|" + SPACE + ")+\\z"
COURSE_CODE = "\\b([A-Z]{2,}[0-9]{3,}[A-Z]?)\\b"

# Characters outside the simple Latin set and what is written for them.
ONE_TO_ONE = {
    "•": "*", "·": "*", "●": "*", "◆": "*", "▪": "-", "■": "-", "—": "-", "–": "-", "“": '"', "”": '"', "„": '"', "‟": '"',
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "↑": "^", "↓": "v", "×": "x", "÷": "/", "≈": "~", "ñ": "n", "Ñ": "N",
    "é": "e", "è": "e", "ê": "e", "ë": "e", "É": "E", "È": "E", "á": "a", "à": "a", "â": "a", "ä": "a", "Á": "A", "À": "A",
    "í": "i", "ì": "i", "î": "i", "ï": "i", "Í": "I", "ó": "o", "ò": "o", "ô": "o", "ö": "o", "Ó": "O",
    "ú": "u", "ù": "u", "û": "u", "ü": "u", "Ú": "U", "ç": "c", "Ç": "C", " ": " ",
}
ONE_TO_MANY = {
    "❑": "[ ]", "❒": "[ ]", "❏": "[ ]", "✓": "[x]", "✔": "[x]", "✗": "[ ]", "✘": "[ ]", "…": "...", "→": "->", "←": "<-",
    "©": "(c)", "®": "(R)", "™": "(TM)", "°": " deg", "±": "+/-", "≤": "<=", "≥": ">=", "≠": "!=",
}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+\\z", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def or_else(c: Column, *others: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in (c, *others)))


def safe_name(c: Column, most: int = 120, default: str = "untitled") -> Column:
    """A name fit for files; null and nothing left give ``default``."""
    x = F.regexp_replace(strip(c), "[^A-Za-z0-9._-]+", "_")
    x = F.regexp_replace(F.regexp_replace(x, "_+", "_"), "^_|_\\z", "")
    return F.coalesce(F.nullif(F.substring(x, 1, most), F.lit("")), F.lit(default))


def numbered(n: Column) -> Column:
    """At least two digits; longer numbers stay whole."""
    return F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))


def badge(c: Column) -> Column:
    """passed, pending, locked or unknown, by the first rule that a badge's text meets; null is unknown."""
    x = F.lower(strip(F.coalesce(c, F.lit(""))))
    return (
        F.when(x == "", "unknown").when(x.rlike("passed|complete"), "passed")
        .when(x.rlike("active|current|ongoing|in-progress|pending"), "pending").when(x.rlike("locked"), "locked").otherwise("unknown")
    )


def course_code(c: Column) -> Column:
    """The first course code in a text, in capitals; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.upper(c), COURSE_CODE, 1), F.lit(""))


def noise(c: Column) -> Column:
    """Whether a line says nothing: empty, up to three marks, a page number, a lone bullet; null is noise."""
    x = strip(F.coalesce(c, F.lit("")))
    return (x == "") | x.rlike("^([0-9\\W]){0,3}\\z") | x.rlike("^[•·●▪■◆\\-*]+\\z")


def latin(c: Column) -> Column:
    """A text in printable ASCII and Latin-1, other characters as a question mark each."""
    x = F.translate(c, "".join(ONE_TO_ONE), "".join(ONE_TO_ONE.values()))
    for a, b in ONE_TO_MANY.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.regexp_replace(x, "[^ -~\\x{A0}-\\x{FF}]", "?")


def strip_tags(c: Column) -> Column:
    """Tags as spaces, four entities decoded one after the other, white space collapsed."""
    x = F.regexp_replace(c, "<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return collapse(x)
