"""Oversized items cut at natural boundaries, with an overlap between neighbours.

An item is worked on in byte ranges, whether it lies in a file or in a column: a
range is read with halos on both sides, its boundaries are found, and its pieces
run from its anchor to the anchor of the next range.  The anchor of a range is
the best boundary at or after its start, which its worker and the one before it
derive from the same halo.  Workers give tables of boundaries and lengths, no
texts; these are stitched by prefix sums over the ranges' pieces and characters,
and the pieces are then cut out by their offsets.  No worker holds an item of
many ranges but to cut a piece out of it, and none a file.

Cuts fall between lines where possible, else between sentences, else between
words, else between visible characters.  A piece starts with up to ``overlap``
characters of whole units, of the best kind there is, from the end of the one
before; without that repetition the pieces join to the item.

Defined results: a null or empty item has no piece; an item within the limit is
one piece; a single visible character longer than the limit is cut by code
points, the limit holding above all.  Offsets and sizes are in code points, for
files in bytes.  An item is known by its keys and its text: a repeated row's
pieces are repeated.  Bytes of a file that are no UTF-8 keep their place and show
as replacement characters.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, file_system

LIMIT = 1200
OVERLAP = 150
RANGE = 1 << 16
PAGE_RANGE = 2048  # bytes of a range of a page; pages are short, and half of those over the limit have several ranges
SIDE = 64  # characters beside a place that decide where its visible characters end

_LINE = regex.compile(r"\n(?!\p{M})")
_SENTENCE = regex.compile(r"[.!?…。！？]+[\"'”’»)\]]*\s+(?![\p{M}‍])")
_WORD = regex.compile(r"\s+(?![\p{M}‍])")
_VISIBLE = regex.compile(r"\X")


class Boundaries:
    """Places of a text where it may be cut, by kind, the best first."""

    def __init__(self, text: str):
        self.text = text
        self.levels = [[m.end() for m in kind.finditer(text)] for kind in (_LINE, _SENTENCE, _WORD)]

    def last(self, after: int, most: int, start: int) -> int:
        """The last place of the best kind with after < place <= most; ``start`` is where a visible character begins."""
        for places in self.levels:
            k = bisect_right(places, most) - 1
            if k >= 0 and places[k] > after:
                return places[k]
        best = after
        for m in _VISIBLE.finditer(self.text, max(start, after - SIDE if start <= after - SIDE else start), min(len(self.text), most + SIDE)):
            if after < m.end() <= most:
                best = m.end()
            elif m.end() > most:
                break
        return best if best > after else most

    def first(self, least: int, before: int, start: int) -> int:
        """The first place of the best kind with least <= place < before, else ``before``."""
        for places in self.levels:
            k = bisect_left(places, least)
            if k < len(places) and places[k] < before:
                return places[k]
        for m in _VISIBLE.finditer(self.text, max(start, 0), before):
            if least <= m.end() < before:
                return m.end()
        return before


def anchor(text: str, at: int, limit: int) -> int:
    """The best boundary at or up to ``limit`` characters after ``at``, from the surroundings of that stretch alone."""
    base = max(0, at - SIDE)
    own = Boundaries(text[base : at + limit + SIDE])
    if at - base + limit >= len(own.text):
        own.levels[0] = [*own.levels[0], len(own.text)] if own.levels[0][-1:] != [len(own.text)] else own.levels[0]
    found = own.first(at - base, at - base + limit + 1, 0)
    return base + min(found, at - base + limit)


def cut_range(text: str, lo: int, hi: int, limit: int, overlap: int, opening: bool) -> list[tuple[int, int]]:
    """(start, end) of the pieces between two anchors of a text; all but an opening one repeat what is before them."""
    own = Boundaries(text)
    out: list[tuple[int, int]] = []
    done, start = lo, lo
    if not opening:
        start = own.first(max(lo - overlap, 0), lo, max(lo - overlap - SIDE, 0))
    while done < hi:
        end = hi if hi - start <= limit else own.last(done, start + limit, done)
        out.append((start, end))
        done, before = end, start
        start = own.first(max(end - overlap, before + 1), end, before)
    return out


def halos(range_bytes: int, limit: int, overlap: int) -> tuple[int, int, int]:
    """(bytes to the left, bytes to the right, characters an anchor may lie behind its range's start)."""
    reach = min(limit, range_bytes // 4 - 1)  # four bytes a character at most, so that anchors keep their order
    if reach <= overlap + SIDE:
        raise ValueError("a range must be longer than an overlap")
    return 4 * (overlap + 2 * SIDE), 4 * (max(reach, SIDE) + 2 * SIDE) + 4, reach


def range_pieces(raw: bytes, base: int, at: int, size: int, first: bool, last: bool, reach: int, limit: int, overlap: int) -> tuple[int, list[tuple[int, int, int, int]]]:
    """(characters that start in the range, pieces) of a range of ``size`` bytes at byte ``at``, read from byte ``base`` on.

    A piece is (start, end) in characters from the range's start and in bytes of the item.
    """
    skip = 0
    while not first and skip < min(3, len(raw)) and raw[skip] & 0xC0 == 0x80:
        skip += 1
    base, raw = base + skip, raw[skip:]
    chunk = raw.decode("utf-8", "surrogateescape")

    def chars(byte: int) -> int:
        k = max(byte - base, 0)
        while k < len(raw) and raw[k] & 0xC0 == 0x80:
            k += 1
        return len(raw[:k].decode("utf-8", "surrogateescape"))

    start, end = chars(at), len(chunk) if last else chars(at + size)
    lo = 0 if first else anchor(chunk, start, reach)
    hi = len(chunk) if last else anchor(chunk, end, reach)
    out, upto, byte = [], 0, base
    marks: dict[int, int] = {}
    cuts = cut_range(chunk, lo, hi, limit, overlap, first)
    for place in sorted({x for cut in cuts for x in cut}):
        byte += len(chunk[upto:place].encode("utf-8", "surrogateescape"))
        upto, marks[place] = place, byte
    out = [(a - start, b - start, marks[a], marks[b]) for a, b in cuts]
    return end - start, out


_BOUNDS = "range_no int, chars bigint, pieces array<struct<start:bigint,end:bigint,from_byte:bigint,to_byte:bigint>>"


def _numbered(bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., piece_no, start, end, from_byte, to_byte): the ranges' tables stitched by prefix sums of their pieces and characters."""
    once = bounds.groupBy(*keys, "range_no").agg(F.first("chars").alias("chars"), F.first("pieces").alias("pieces"))
    over = Window.partitionBy(*keys).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    own = once.select(*keys, "range_no", "chars", F.size("pieces").alias("many"))
    before = own.select(*(F.col(k).alias(f"b_{k}") for k in (*keys, "range_no")), *(F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"before_{c}") for c in ("many", "chars")))
    same = [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in (*keys, "range_no")]
    out = once.join(before, same).select(*keys, "before_many", "before_chars", F.posexplode("pieces").alias("at", "piece"))
    number = (F.col("before_many") + F.col("at") + 1).cast("int")
    return out.select(*keys, number.alias("piece_no"), *((F.col("before_chars") + F.col(f"piece.{c}")).alias(c) for c in ("start", "end")), "piece.from_byte", "piece.to_byte")


def _items(items: DataFrame, keys: Sequence[str], text: str) -> tuple[DataFrame, list[str]]:
    """Items as (key_0, ..., i1, i2, text): the callers' names may clash with ours, and i1 and i2 stand for the text."""
    named = [f"key_{i}" for i in range(len(keys))]
    own = items.select(*(F.col(n).alias(k) for k, n in zip(named, keys)), F.col(text).alias("text")).where(F.length("text") > 0)
    return own.withColumns({"i1": F.xxhash64("text"), "i2": F.xxhash64(F.lit(1), "text")}), [*named, "i1", "i2"]


def piece_bounds(own: DataFrame, keys: Sequence[str], limit: int, overlap: int, range_bytes: int) -> DataFrame:
    """(keys..., piece_no, start, end, from_byte, to_byte) of items with a column text, by ranges of its bytes."""
    left, right, reach = halos(range_bytes, limit, overlap)
    fields = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    ranged = own.select(*keys, F.encode("text", "UTF-8").alias("bytes")).withColumn("size", F.octet_length("bytes"))
    ranged = ranged.withColumn("ranges", F.expr(f"cast(ceil(size / {range_bytes}) AS INT)"))
    ranged = ranged.withColumn("range_no", F.explode(F.expr("sequence(0, ranges - 1)")))
    ranged = ranged.withColumn("base", F.expr(f"greatest(0, range_no * {range_bytes} - {left})"))
    ranged = ranged.withColumn("chunk", F.expr(f"substring(bytes, base + 1, (range_no + 1) * {range_bytes} + {right} - base)"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [range_pieces(bytes(chunk), base, r * range_bytes, range_bytes, r == 0, r == ranges - 1, reach, limit, overlap) for r, ranges, base, chunk in pdf[["range_no", "ranges", "base", "chunk"]].itertuples(index=False)]
            yield pdf[[*keys, "range_no"]].assign(chars=[n for n, _ in found], pieces=[[dict(zip(("start", "end", "from_byte", "to_byte"), x)) for x in p] for _, p in found])

    shape = ", ".join(f"{k} {fields[k]}" for k in keys) + f", {_BOUNDS}"
    return _numbered(cut(ranged.select(*keys, "range_no", "ranges", "base", "chunk").mapInPandas(work, shape)), keys)  # read twice: numbers, not texts


def split_items(items: DataFrame, keys: Sequence[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE) -> DataFrame:
    """(keys..., piece_no, start, end, piece) of every item; start counts from 0, piece_no from 1."""
    own, ours = _items(items, keys, text)
    small = own.where(F.length("text") <= limit).select(*ours, F.lit(1).alias("piece_no"), F.lit(0).cast("bigint").alias("start"), F.length("text").cast("bigint").alias("end"), F.col("text").alias("piece"))
    large = own.where(F.length("text") > limit)
    bounds = piece_bounds(large, ours, limit, overlap, range_bytes).select(*(F.col(k).alias(f"p_{k}") for k in ours), "piece_no", "start", "end", "from_byte", "to_byte")
    cuts = large.select(*ours, F.encode("text", "UTF-8").alias("bytes")).join(bounds, [F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in ours])
    piece = F.decode(F.expr("substring(bytes, cast(from_byte + 1 AS INT), cast(to_byte - from_byte AS INT))"), "UTF-8")
    out = small.unionByName(cuts.select(*ours, "piece_no", "start", "end", piece.alias("piece")))
    return out.select(*(F.col(f"key_{i}").alias(n) for i, n in enumerate(keys)), "piece_no", "start", "end", "piece")


def split_files(spark: SparkSession, path: str, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = 1 << 24) -> DataFrame:
    """(path, piece_no, start, end, piece) of UTF-8 files, each read by byte ranges and never as a whole; offsets in bytes.

    Only names and lengths come from the listing; every range is a task's row
    that opens the file where it lies and reads its bytes with their halos, once
    for its boundaries and once for the texts between them.
    """
    left, right, reach = halos(range_bytes, limit, overlap)
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.withColumn("ranges", F.expr(f"cast(ceil(length / {range_bytes}) AS INT)"))
    ranges = ranges.withColumn("range_no", F.explode(F.expr("sequence(0, ranges - 1)"))).repartition(F.col("path"), F.col("range_no"))

    def read(name: str, base: int, end: int) -> bytes:
        system, place = file_system(name)
        with system.open_input_file(place) as f:
            return f.read_at(end - base, base)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, length, n, r in pdf[["path", "length", "ranges", "range_no"]].itertuples(index=False):
                base = max(0, r * range_bytes - left)
                many, found = range_pieces(read(name, base, min((r + 1) * range_bytes + right, length)), base, r * range_bytes, range_bytes, r == 0, r == n - 1, reach, limit, overlap)
                yield pd.DataFrame({"path": [name], "range_no": [r], "chars": [many], "pieces": [[dict(zip(("start", "end", "from_byte", "to_byte"), x)) for x in found]]})

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (name, _), rows in pdf.groupby(["path", "of"]):
                base, end = int(rows["from_byte"].min()), int(rows["to_byte"].max())
                raw = read(name, base, end)
                yield rows[["path", "piece_no"]].assign(start=rows["from_byte"], end=rows["to_byte"], piece=[raw[a - base : b - base].decode("utf-8", "replace") for a, b in zip(rows["from_byte"], rows["to_byte"])])

    bounds = _numbered(cut(ranges.mapInPandas(work, f"path string, {_BOUNDS}")), ["path"]).withColumn("of", F.floor(F.col("from_byte") / range_bytes))
    return bounds.select("path", "of", "piece_no", "from_byte", "to_byte").mapInPandas(texts, "path string, piece_no int, start bigint, end bigint, piece string")


def page_text(lines: str = "lines") -> Column:
    """A page's lines (h where not null, else p, else nothing) joined by one newline; an absent list is an empty text."""
    return F.coalesce(F.array_join(F.transform(lines, lambda x: F.coalesce(x["h"], x["p"], F.lit(""))), "\n"), F.lit(""))


def pages(page_docs: DataFrame) -> DataFrame:
    """(page_doc_id, n, text) of every page that is there."""
    page = page_docs.select("page_doc_id", F.explode("pages").alias("page")).where("page IS NOT NULL")
    return page.select("page_doc_id", F.col("page.n").alias("n"), page_text("page.lines").alias("text"))


def oversized_pages(page_docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = PAGE_RANGE) -> DataFrame:
    """(page_doc_id, n, piece_no, start, end, piece) of the pages over the limit."""
    return split_items(pages(page_docs).where(F.length("text") > limit), ["page_doc_id", "n"], "text", limit, overlap, range_bytes)


def oversized_bounds(page_docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = PAGE_RANGE) -> DataFrame:
    """(page_doc_id, n, piece_no, start, end): the same without the texts."""
    own, keys = _items(pages(page_docs).where(F.length("text") > limit), ["page_doc_id", "n"], "text")
    return piece_bounds(own, keys, limit, overlap, range_bytes).select(F.col("key_0").alias("page_doc_id"), F.col("key_1").alias("n"), "piece_no", "start", "end")


def joined(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., text, longest) from pieces: each adds what lies behind the end of the one before."""
    item = F.sort_array(F.collect_list(F.struct("piece_no", "start", "end", "piece")))
    own = pieces.groupBy(*keys).agg(item.alias("all"))
    text = F.expr("array_join(transform(all, (x, i) -> if(i = 0, x.piece, substring(x.piece, cast(all[i - 1].end - x.start + 1 AS INT)))), '')")
    return own.select(*keys, text.alias("text"), F.array_max(F.transform("all", lambda x: F.length(x["piece"]))).alias("longest"))
