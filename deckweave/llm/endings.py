"""Texts that stop before they are over.

A backward character model: for the last 1..n characters before a place in a
text, how often such a place is a boundary (the end of a line, a text or a
sentence) and how often the text goes on.  The counts are over all places of all
texts.  A value's final context is looked up from short to long, each order
smoothing the next, and gives the log-odds of an end against a continuation; a
threshold for each language and column decides.

Beside the bare characters the longer contexts know the kind of line they stand
in (an item of a list, a label such as "Next:", a heading-like start, further
down a paragraph), since the same word ends a heading and goes on in a sentence.

The ends of whole texts are evidence for closing lines, but some of these texts
are cut; so texts with the same last two lines count once, and an end counts
only as far as more than ``DISCOUNT`` of them end the same way.  Lines with a
label are judged by lines with that label alone.  An exact check follows: a text
whose last mark closes a sentence is never cut.

Counts are rows (order, context, counts), added up as bigints: first in each
task, then by Spark's aggregates over as many partitions as there are.  Only the
contexts at the end of some open text are ever looked up, so only those are
counted: a filter of their hashes, of bounded size, lies in the shared folder and
every task goes by it from short to long contexts.  What it lets through by
mistake is counted and never looked up.  No count is clipped, dropped or shared.

Defined results: null, empty and blank texts are never cut; a repeated text has
the same result under each id; a null source is a source of its own in the report;
rows without an id are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, read_rows, salted_join, spread, written
from .langid import LANGS, language_code
from .lookalike import fold_look

BARE = (1, 2, 3, 4)
KINDS = (0, 1, 2, 3, 4, 5, 6, 8, 10)
DISCOUNT = 1
SMOOTH = 3.0
CHUNK = 250_000  # characters worked on at once
#: How many complete texts there are to one that is cut, before anything is known of it.
COMPLETE_ODDS = 5.0
GROUPS = (*LANGS, "other")
#: Bits of the filter for each context in question, and bounds of its size (the largest is 32 MB).
FILTER_SPARE, FILTER_LEAST, FILTER_MOST = 32, 1 << 16, 1 << 28
HELD = 1_000_000  # rows of counts a task holds before it adds them up

_PAD = "\n" * (max(KINDS) + 1)
_DIGITS = re.compile(r"\d+")
_BLANKS = re.compile(r"[ \t\r]+(?=\n|$)")
_STRAY = re.compile(r"(?:\s+|\.{2,}|[…�|~^*_\\/=+#]|<[^<>]{0,12}>?|&[a-zA-Z#0-9]{0,8};?|(?<=\s)[-–—]+|(?<=\w)[-–—]+)+$")
_CLOSED = re.compile(r"[.!?。][\"'’”»)\]]*$")
_ENDED = re.compile(r"(?<!\.)[.!?。]$")
_SPACE, _MARK, _CLOSER, _NEWLINE = 1, 2, 4, 8
_CLASSES = np.array([_SPACE * chr(c).isspace() + _NEWLINE * (c == 10) + _MARK * (chr(c) in ".!?:") + _CLOSER * (chr(c) in "\"'’”»)]") for c in range(0x3001)] + [0], dtype=np.uint8)
_LABEL = re.compile(r"^(?:[-*•]|\d+[.)]|[^\s:|.]{1,24}:|[^\s:|.]{1,24} [^\s:|.]{1,24}:|[^\s|]+ \||https?:)(?=[ /])", re.MULTILINE)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_POWERS = np.cumprod(np.full(max(KINDS) + 1, _M1))
ORDERS = len(BARE) + len(KINDS)


def clean(text: str) -> str:
    """Look-alikes in one form, runs of digits as 0, no blanks before the ends of lines."""
    text = _DIGITS.sub("0", fold_look(text))
    return _BLANKS.sub("", text) if " \n" in text or "\r" in text or text.endswith((" ", "\t")) or "\t\n" in text else text


def last_lines(text: str, whole: bool = False) -> str:
    """The last three lines of a text, which hold its break; or all of it."""
    t = text.rstrip()
    if whole:
        return t
    at = len(t)
    for _ in range(3):
        at = t.rfind("\n", 0, max(at, 0))
        if at < 0:
            return t
    return t[at + 1 :]


def final_context(text: str | None) -> str:
    """The text's last line as far as its break, less stray marks behind the break; empty for a blank text."""
    return _final(text, clean(last_lines(text)).rstrip()) if text is not None else ""


def _final(text: str, t: str) -> str:
    """``final_context`` of a text whose cleaned last lines are ``t``."""
    if _ENDED.search(t):
        return t[t.rfind("\n") + 1 :]
    bare = _STRAY.sub("", t)
    if "\n" not in bare:
        t = clean(last_lines(text, True)).rstrip()  # the stray marks may fill whole lines
        bare = _STRAY.sub("", t)
    if not bare.strip():
        bare = t
    return bare[bare.rfind("\n") + 1 :]


def _kinds(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers for the kinds of lines, which of them each character stands in, and the ends of sentences.

    A line is one kind up to its third word's end, another up to its sixth, then
    long, and a paragraph after its first sentence; a label makes it of its own kind.
    """
    n = len(chars)
    of = _CLASSES[np.minimum(chars, 0x3001)]
    breaks = np.flatnonzero(of & _NEWLINE)
    start = np.concatenate([[0], breaks + 1])
    end = np.append(breaks + 1, n)
    start, end = start[start < end], end[start < end]
    last = np.flatnonzero(((of[:-1] & (_MARK | _CLOSER)) > 0) & ((of[1:] & _SPACE) > 0))
    at, left = last.copy(), np.arange(len(last))
    sentence = np.zeros(len(last), bool)
    while len(left):  # closing quotes and brackets stand behind the mark
        mark = (of[at[left]] & _MARK) > 0
        sentence[left[mark]] = True
        left = left[~mark & ((of[at[left]] & _CLOSER) > 0) & (at[left] > 0)]
        at[left] -= 1
    ends = last[sentence]
    spaces = np.append(np.flatnonzero(chars == 32), np.full(6, n))
    first = np.searchsorted(spaces[:-6], start)
    closed = np.append(ends + 1, n)[np.searchsorted(ends + 1, start, "right")]
    stops = np.minimum(closed, end)
    cuts = [start, *(np.minimum(spaces[first + k], stops) for k in (2, 5)), stops, end]
    kind = np.tile(np.arange(4), (len(start), 1))
    values = list(range(4))
    if len(start):
        labels: dict[str, int] = {}
        text = chars.tobytes().decode("utf-32-le", "surrogatepass")
        found = list(_LABEL.finditer(text))
        line = np.searchsorted(start, np.array([m.start() for m in found], dtype=np.int64))
        for k, m in zip(line.tolist(), found):
            own = m.group().lower()
            if own not in labels:
                labels[own] = len(values)
                values.append(16 + sum(ord(c) * 31**i for i, c in enumerate(own)) % 999_983)
            kind[k] = labels[own]
    return np.array(values, dtype=np.uint64), np.repeat(kind.ravel(), np.diff(np.stack(cuts, 1), axis=1).ravel()).astype(np.int32), ends


def context_hash(rolling: np.ndarray, n: int, kind: np.ndarray | None) -> np.ndarray:
    """The hash of a context of n characters, bare or with its kind of line."""
    if kind is None:
        h = (rolling + np.uint64(n)) * _M2
    else:
        h = (rolling + np.uint64(n + 100) + (kind + np.uint64(1)) * _M2) * _M2
    return (h ^ (h >> np.uint64(31))) * _M1


def final_hashes(lines: Sequence[str], column: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(lines x orders) hashes of the contexts at the ends of some lines, and which lines a label leads."""
    joined = _PAD + _PAD.join(lines) + "\n"
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(t) for t in lines], dtype=np.int64)
    last = len(_PAD) + np.cumsum(lengths + len(_PAD)) - len(_PAD) - 1
    values, own, _ = _kinds(chars)
    kind = values[own[last]]
    out = np.zeros((len(lines), ORDERS), np.uint64)
    rolling = np.full(len(lines), column_seed(column))
    for n in range(max(KINDS) + 1):
        if n:
            rolling = rolling + chars[last - n + 1].astype(np.uint64) * _POWERS[n - 1]
        if n in BARE:
            out[:, BARE.index(n)] = context_hash(rolling, n, None)
        if n in KINDS:
            out[:, len(BARE) + KINDS.index(n)] = context_hash(rolling, n, kind)
    return out, kind >= 16


def column_seed(column: int) -> np.uint64:
    return np.uint64(column * 0x51_7C_C1_B7_27_22 % (1 << 64))


def context_hash(rolling: np.ndarray, n: int, kind: np.ndarray | None) -> np.ndarray:
    """The hash of a context of n characters, bare or with its kind of line."""
    if kind is None:
        h = (rolling + np.uint64(n)) * _M2
    else:
        h = (rolling + np.uint64(n + 100) + (kind + np.uint64(1)) * _M2) * _M2
    return (h ^ (h >> np.uint64(31))) * _M1


def group_of(label: str | None) -> int:
    code = language_code(label)
    return LANGS.index(code) if code else len(LANGS)


def two_lines(t: str) -> str:
    """The last two of a text's cleaned last lines."""
    return t[t.rfind("\n", 0, max(t.rfind("\n"), 0)) + 1 :]


class Filter:
    """Bits of the contexts in question; one without bits lets all through."""

    def __init__(self, bits: np.ndarray | None):
        self.bits = bits
        self.shift = np.uint64(64 - (len(bits).bit_length() - 1)) if bits is not None else None

    @classmethod
    def read(cls, path: str, size: int) -> Filter:
        words = np.zeros(size // 64, np.uint64)
        for word_no, word in read_rows(path, ["word_no", "word"]):
            words[word_no] = np.uint64(word % (1 << 64))
        return cls(np.unpackbits(words.view(np.uint8), bitorder="little").view(bool))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(hashes), bool)
        return self.bits[(hashes >> self.shift).astype(np.int64)]


class Counts:
    """Counts of places by order and context: ends of lines and sentences, and places where the text goes on."""

    def __init__(self, wanted: Filter, column: int = 0) -> None:
        self.wanted, self.column = wanted, column
        self.totals = np.zeros((len(GROUPS), 2), np.int64)
        self._rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self._held = 0

    def add(self, texts: Sequence[str], groups: Sequence[int]) -> None:
        """Counts the places of cleaned texts but their ends."""
        size, part, of = 0, [], []
        for t, g in zip(texts, groups):
            if not t:
                continue
            part.append(t)
            of.append(g)
            size += len(t)
            if size >= CHUNK:
                self._add(part, of)
                size, part, of = 0, [], []
        if part:
            self._add(part, of)

    def _add(self, texts: list[str], groups: list[int]) -> None:
        joined = _PAD + _PAD.join(texts) + "\n"
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        values, kind, sentences = _kinds(chars)
        lengths = np.array([len(t) for t in texts])
        ends = len(_PAD) + np.cumsum(lengths + len(_PAD)) - len(_PAD) - 1
        newline = chars == 10
        boundary = np.zeros(len(chars), np.int32)
        boundary[np.flatnonzero(newline)[1:] - 1] = 1
        boundary[(kind == 2) | (kind == 3)] = 0  # a long line ends where it was wrapped, unless a mark closes it
        boundary[sentences] = 1
        inside = np.flatnonzero(~newline)
        of = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(inside, ends, "right"), prepend=0))
        np.add.at(self.totals, (np.array(groups), 0), np.bincount(of, weights=boundary[inside], minlength=len(texts)).astype(np.int64))
        np.add.at(self.totals, (np.array(groups), 1), np.bincount(of, weights=1 - boundary[inside], minlength=len(texts)).astype(np.int64))
        pos = np.delete(inside, np.searchsorted(inside, ends))
        known = np.zeros(int(chars.max()) + 1, bool)
        known[chars] = True
        alphabet = np.flatnonzero(known)
        letter = np.zeros(len(known), np.int32)
        letter[alphabet] = np.arange(len(alphabet))
        letter = letter[chars]
        end = boundary[pos]
        self._track(alphabet, letter, pos, end, None, np.zeros(len(pos), np.int32))
        self._track(alphabet, letter, pos, end, values, kind[pos])

    def _track(self, alphabet: np.ndarray, letter: np.ndarray, pos: np.ndarray, end: np.ndarray, kinds: np.ndarray | None, node: np.ndarray) -> None:
        """Follows the contexts from short to long, by small numbers in place of hashes, as long as they are in question."""
        orders = BARE if kinds is None else KINDS
        bare, wide = kinds is None, len(alphabet)
        rolling = np.full(1 if bare else len(kinds), column_seed(self.column))
        first = 0
        if len(rolling) * wide * wide <= 2 * len(pos) + (1 << 16):
            first = 2  # the shorter contexts' counts are sums of those of two characters
            node = (node * wide + letter[pos]) * wide + letter[pos - 1]
            pairs = np.bincount(node * 2 + end, minlength=2 * len(rolling) * wide * wide)
            there = np.flatnonzero(pairs[0::2] + pairs[1::2])
            for n in range(2):
                if n in orders:
                    own = rolling if not n else (rolling[:, None] + alphabet.astype(np.uint64) * _POWERS[0]).ravel()
                    hashes = context_hash(own, n, kinds if bare or not n else np.repeat(kinds, wide))
                    on, ends = (np.bincount(there // wide ** (2 - n), weights=pairs[2 * there + k], minlength=len(own)).astype(np.int64) for k in range(2))
                    keep = np.flatnonzero((on + ends > 0) & self.wanted.has(hashes))
                    self._note(BARE.index(n) if bare else len(BARE) + KINDS.index(n), hashes[keep], ends[keep], on[keep])
            rolling = (rolling[:, None] + alphabet.astype(np.uint64) * _POWERS[0]).ravel()
            kinds = kinds if bare else np.repeat(kinds, wide)
        for n in range(first, max(orders) + 1):
            many = len(rolling)
            if n:
                many *= wide
                if n > first or not first:
                    node = node * wide + letter[pos - (n - 1)] if many < 2**30 else node.astype(np.int64) * wide + letter[pos - (n - 1)]
            if many <= 2 * len(pos) + (1 << 16):
                counts = (pairs if first and n == first else np.bincount(node * 2 + end, minlength=2 * many)).reshape(-1, 2)
                there = np.flatnonzero(counts[:, 0] + counts[:, 1])
                counts = counts[there]
                number = np.full(many, -1, np.int32)
            else:
                there, node = np.unique(node, return_inverse=True)
                counts = np.bincount(node * 2 + end, minlength=2 * len(there)).reshape(-1, 2)
                number = None
            if n:
                parent = there // wide
                rolling = rolling[parent] + alphabet[there % wide].astype(np.uint64) * _POWERS[n - 1]
                kinds = kinds if bare else kinds[parent]
            else:
                rolling, kinds = rolling[there], kinds if bare else kinds[there]
            keep = np.arange(len(there))
            if n in orders:
                hashes = context_hash(rolling, n, kinds)
                keep = np.flatnonzero(self.wanted.has(hashes))
                self._note(BARE.index(n) if bare else len(BARE) + KINDS.index(n), hashes[keep], counts[keep, 1], counts[keep, 0])
                rolling, kinds = rolling[keep], kinds if bare else kinds[keep]
            if number is None:
                number = np.full(len(there), -1, np.int32)
                number[keep] = np.arange(len(keep))
            else:
                number[there[keep]] = np.arange(len(keep))
            node = number[node]
            left = np.flatnonzero(node >= 0)
            if len(left) < len(node):
                node, pos, end = node[left], pos[left], end[left]
            if not len(pos):
                return

    def _note(self, order: int, hashes: np.ndarray, ends: np.ndarray, on: np.ndarray) -> None:
        self._rows.append((np.full(len(hashes), order, np.int64), hashes, ends, on))
        self._held += len(hashes)
        if self._held > HELD:
            self._rows = [self.rows()]
            self._held = max(len(self._rows[0][0]), HELD // 2)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(orders, contexts, ends, continuations), one of each context."""
        if not self._rows:
            return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
        order, hashes, ends, on = (np.concatenate(x) for x in zip(*self._rows))
        sort = np.lexsort((hashes, order))
        order, hashes, ends, on = (x[sort] for x in (order, hashes, ends, on))
        first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (order[1:] != order[:-1])])) if len(order) else np.zeros(0, np.int64)
        return (order[first], hashes[first], *(np.add.reduceat(x, first) if len(first) else x for x in (ends, on)))


def open_ends(documents: DataFrame, doc_id: str, columns: Sequence[str], lang: str, keep: Sequence[str]) -> DataFrame:
    """(doc_id, keep..., col, grp, open, labelled, contexts, tail, tail_contexts) of every text that isn't blank.

    A text whose last mark closes a sentence isn't open and needs no contexts; ``tail`` stands for its last two lines.
    """
    parts = [documents.select(F.col(doc_id).alias("doc_id"), *(F.col(k).alias(f"keep_{i}") for i, k in enumerate(keep)), F.lit(c).alias("col"), F.col(lang).alias("lang"), F.col(name).alias("text")) for c, name in enumerate(columns)]
    own = parts[0]
    for part in parts[1:]:
        own = own.unionByName(part)
    own = own.where(F.col("doc_id").isNotNull() & (F.length(F.trim("text")) > 0))
    fields = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    held = [c for c in own.columns if c not in ("lang", "text")]
    shape = ", ".join(f"{c} {fields[c]}" for c in held) + ", grp int, open boolean, labelled boolean, contexts array<bigint>, tail string, tail_contexts array<bigint>"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cleaned = [clean(last_lines(t)).rstrip() for t in pdf["text"]]
            lines = [_final(t, c) for t, c in zip(pdf["text"], cleaned)]
            there = np.array([bool(x.strip()) for x in lines], dtype=bool)
            pdf, lines, tails = pdf[there], [x for x in lines if x.strip()], [two_lines(c) for x, c in zip(lines, cleaned) if x.strip()]
            out = pdf[held].copy()
            out["grp"] = np.array([group_of(x) for x in pdf["lang"]], dtype=np.int32)
            out["open"] = np.array([not _CLOSED.search(x) for x in lines], dtype=bool)
            hashes, tail_hashes, labelled = np.zeros((len(pdf), ORDERS), np.int64), np.zeros((len(pdf), ORDERS), np.int64), np.zeros(len(pdf), bool)
            for c in pdf["col"].unique():
                at = np.flatnonzero((pdf["col"] == c) & out["open"])
                found, labelled[at] = final_hashes([lines[k] for k in at], int(c))
                hashes[at] = found.view(np.int64)
                at = np.flatnonzero(pdf["col"] == c)
                tail_hashes[at] = final_hashes([tails[k][tails[k].rfind("\n") + 1 :] for k in at], int(c))[0].view(np.int64)
            out["labelled"] = labelled
            out["contexts"] = [h if o else None for h, o in zip(hashes, out["open"])]
            out["tail"], out["tail_contexts"] = tails, list(tail_hashes)
            yield out

    return spread(own).mapInPandas(read, shape)


def context_filter(ends: DataFrame) -> tuple[str, int]:
    """Where the filter of the open texts' contexts lies, and its bits."""
    wanted = ends.where("open").select(F.explode("contexts").alias("context")).distinct()
    bits = FILTER_LEAST
    most = min(wanted.count() * FILTER_SPARE, FILTER_MOST)
    while bits < most:
        bits *= 2
    place = F.shiftrightunsigned("context", 64 - (bits.bit_length() - 1))
    words = wanted.groupBy(F.shiftright(place, 6).alias("word_no")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(63).cast("int"))).alias("word"))
    return written(words, []), bits


def context_counts(documents: DataFrame, columns: Sequence[str], lang: str, path: str, bits: int) -> DataFrame:
    """(k, context, ends, goes_on) over all places of all texts; k from 0 on is a context's order, -1 - k the totals of a column's language."""
    shape = "k int, context bigint, ends bigint, goes_on bigint"
    out = None
    for c, name in enumerate(columns):
        def count(batches: Iterator[pd.DataFrame], c: int = c) -> Iterator[pd.DataFrame]:
            counts = Counts(Filter.read(path, bits), c)
            for pdf in batches:
                counts.add([clean(t).rstrip() for t in pdf.iloc[:, 0]], [group_of(x) for x in pdf.iloc[:, 1]])
            order, hashes, ends, on = counts.rows()
            for a in range(0, len(order), 100_000):
                yield pd.DataFrame({"k": order[a : a + 100_000].astype(np.int32), "context": hashes[a : a + 100_000].view(np.int64), "ends": ends[a : a + 100_000], "goes_on": on[a : a + 100_000]})
            yield pd.DataFrame({"k": np.int32(-1 - c), "context": np.arange(len(GROUPS)), "ends": counts.totals[:, 0], "goes_on": counts.totals[:, 1]})

        own = spread(documents.where(F.length(F.trim(name)) > 0).select(name, lang)).mapInPandas(count, shape)
        out = own if out is None else out.unionByName(own)
    return out


def log_odds(looked_up: Column, labelled: Column, base: Column, texts: Column, places: Column) -> Column:
    """Log-odds of an end from an array of (k, ends, goes_on, finals) in the order of k: each order smooths the next."""
    heard = F.filter(looked_up, lambda x: F.when(labelled, x["k"] >= len(BARE)).otherwise(x["k"] != len(BARE)))
    counted = lambda x: x["ends"] + F.greatest(x["finals"] - DISCOUNT, F.lit(0))
    p = F.aggregate(heard, base, lambda p, x: (counted(x) + SMOOTH * p) / (counted(x) + x["goes_on"] + SMOOTH))
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    # a label that leads many last lines and few others leads closing lines
    own = F.element_at(F.filter(looked_up, lambda x: x["k"] == len(BARE)), 1)
    closing = ((own["finals"] + 1) / (texts + 1)) / ((counted(own) + own["goes_on"] + 1) / (places + 1))
    return F.log(p / (1 - p)) + F.when(labelled, F.log(F.greatest(closing, F.lit(1.0)))).otherwise(0.0)


def score_endings(documents: DataFrame, doc_id: str = "doc_id", text: str | Sequence[str] = "text", lang: str = "lang", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, keep..., log_odds, threshold, cut) for every text that isn't blank; of several columns also ``column``.

    A closed text has the log-odds 50.
    """
    columns = [text] if isinstance(text, str) else list(text)
    ends = cut(open_ends(documents, doc_id, columns, lang, keep))
    counts = context_counts(documents, columns, lang, *context_filter(ends))
    tails = ends.groupBy("col", F.xxhash64("tail").alias("t1"), F.xxhash64(F.lit(1), "tail").alias("t2")).agg(F.first("tail_contexts").alias("contexts"))
    finals = tails.select(F.posexplode("contexts").alias("k", "context"), F.lit(1).cast("bigint").alias("finals"))
    texts = tails.select((-100 - F.col("col")).alias("k"), F.lit(0).cast("bigint").alias("context"), F.lit(1).cast("bigint").alias("finals"))
    zero = F.lit(0).cast("bigint")
    united = counts.withColumn("finals", zero).unionByName(finals.unionByName(texts).select("k", "context", zero.alias("ends"), zero.alias("goes_on"), "finals"))
    summed = cut(united.groupBy("k", "context").agg(*(F.sum(c).alias(c) for c in ("ends", "goes_on", "finals"))))
    by_column = {c: thresholds(c, summed.where(F.col("k").isin(-1 - c, -100 - c)).collect()) for c in range(len(columns))}  # a row for each language
    shapes = ends.where("open").groupBy("col", F.xxhash64("contexts").alias("f1"), F.xxhash64(F.lit(1), "contexts").alias("f2")).agg(F.first("contexts").alias("contexts"), F.first("labelled").alias("labelled"))
    looked = shapes.select("col", "f1", "f2", "labelled", F.posexplode("contexts").alias("k", "context"))
    # short contexts stand at the end of a large share of all texts
    few = summed.where("k >= 0")
    looked = salted_join(looked, few, ["k", "context"], F.col("f1"), F.when(F.col("k").isin(0, 1, len(BARE), len(BARE) + 1), 32).otherwise(4))
    row = F.struct("k", *(F.coalesce(c, zero).alias(c) for c in ("ends", "goes_on", "finals")))
    looked = looked.groupBy("col", "f1", "f2", "labelled").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    value = lambda name: F.element_at(F.create_map(*(F.lit(x) for c, v in by_column.items() for x in (c, float(v[name])))), F.col("col"))
    scored = looked.select("col", "f1", "f2", log_odds(F.col("rows"), F.col("labelled"), value("base"), value("texts"), value("places")).alias("log_odds"))
    own = ends.withColumns({"f1": F.xxhash64("contexts"), "f2": F.xxhash64(F.lit(1), "contexts")}).drop("contexts", "tail", "tail_contexts", "labelled")
    own = salted_join(own, scored, ["col", "f1", "f2"], F.xxhash64("doc_id"), F.lit(8))
    limit = F.element_at(F.create_map(*(F.lit(x) for c, v in by_column.items() for g, t in enumerate(v["thresholds"]) for x in (c * len(GROUPS) + g, float(t)))), F.col("col") * len(GROUPS) + F.col("grp"))
    out = own.select(F.col("doc_id").alias(doc_id), *(F.col(f"keep_{i}").alias(k) for i, k in enumerate(keep)), "col", F.when(F.col("open"), F.col("log_odds")).otherwise(50.0).alias("log_odds"), limit.alias("threshold"))
    out = out.withColumn("cut", F.col("log_odds") < F.col("threshold"))
    return out.drop("col") if isinstance(text, str) else out.withColumn("column", F.element_at(F.lit(columns), F.col("col") + 1)).drop("col")


def thresholds(column: int, rows: list) -> dict:
    """What the scores of one column need: the rate of ends, totals, and a threshold for each language."""
    totals, texts = np.zeros((len(GROUPS), 2)), 0
    for r in rows:
        if r["k"] == -1 - column:
            totals[r["context"]] = r["ends"], r["goes_on"]
        else:
            texts = r["finals"]
    rate = (totals[:, 0] + 1) / (totals.sum(axis=1) + 100)
    places = totals.sum()
    return {"base": (totals[:, 0].sum() + 1) / (places + 100), "places": places, "texts": texts, "thresholds": np.log(rate / (1 - rate)) - np.log(COMPLETE_ODDS)}
