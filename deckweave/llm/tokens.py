"""Token ids of whole columns under a public byte-level BPE.

A text is halved until its parts are short, the parts are encoded, and
neighbours are joined up the tree.  A join encodes anew a window round the seam
that grows until, on either side, it reaches a place where the pre-tokenizer
always breaks (``stable``): what lies beyond such a place is encoded the same
whatever stands on the other side of it.  A proof for each kind of place: no
alternative of the pattern holds a character other than white space followed by
white space, a letter followed by a digit or by any mark, a digit followed by a
letter or a mark, or a mark followed by a digit; the only look-ahead concerns
white space, and behind such a place none was open.

The upper levels of a long text's tree are Spark's: its parts, by byte ranges,
are encoded in tasks of their own between their first and their last stable
place, and what lies between two parts' stable places is the window of their
seam, encoded when the parts are stitched.

Ids concatenate, so decoding is a concatenation up the same tree.

Defined results: null and empty texts have the empty list, a blank text the ids
of its characters, special tokens' strings the ids of ordinary text; a repeated
row has its ids each time.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread

FOLDER = "/opt/tokenizers"
LEAF = 128  # characters
PART = 4096  # bytes of a text that one task encodes at a time
WINDOW = 16
# Fixed value: the pattern that splits a text before its parts are encoded.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _kind(c: str) -> str:
    if c.isspace() and c not in "\x1c\x1d\x1e\x1f":
        return "s"
    category = unicodedata.category(c)[0]
    return category if category in "LN" else "s" if c in "\x85" else "m"


#: Kinds of neighbours between which the pattern always breaks.
BREAKS = frozenset({"Ls", "Ns", "ms", "LN", "Lm", "NL", "Nm", "mN"})


def stable(text: str, at: int) -> bool:
    """Whether the pre-tokenizer breaks before the character at ``at`` whatever surrounds its two neighbours."""
    a, b = text[at - 1], text[at]
    if ord(a) > 0x2FFFF or ord(b) > 0x2FFFF or unicodedata.category(a) == "Cn" or unicodedata.category(b) == "Cn":
        return False  # newer characters may be of another kind in the encoder's tables
    return _kind(a) + _kind(b) in BREAKS


class TreeEncoder:
    """A vocabulary's encoder; ``ranks`` is the content of a .tiktoken file."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN, leaf: int = LEAF):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.width = {i: len(t) for t, i in table.items()}
        self.leaf = leaf

    def encode(self, text: str | None) -> list[int]:
        return self._encode(text, 0, len(text)) if text else []

    def _encode(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf:
            return self.encoding.encode_ordinary(text[a:b])
        m = (a + b) // 2
        return self.join(text, a, m, b, self._encode(text, a, m), self._encode(text, m, b))

    def join(self, text: str, a: int, m: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of text[a:b] from those of text[a:m] and text[m:b]."""
        if stable(text, m):
            return left + right
        size, p, q = WINDOW, m, m
        while p > a:  # the window grows to the left until it starts at a stable place
            low = max(a, m - size)
            p = next((x for x in range(p - 1, max(low, a), -1) if stable(text, x)), low)
            if p == a or p > low or (p > a and stable(text, p)):
                break
            size *= 2
        size = WINDOW
        while q < b:
            high = min(b, m + size)
            q = next((x for x in range(q + 1, high) if stable(text, x)), high)
            if q == b or q < high or stable(text, q):
                break
            size *= 2
        i = self._back(left, len(text[p:m].encode("utf-8", "replace")))
        j = self._forth(right, len(text[m:q].encode("utf-8", "replace")))
        return left[:i] + self.encoding.encode_ordinary(text[p:q]) + right[j:]

    def _back(self, ids: list[int], size: int) -> int:
        i = len(ids)
        while size > 0:
            i -= 1
            size -= self.width[ids[i]]
        assert size == 0
        return i

    def _forth(self, ids: list[int], size: int) -> int:
        j = 0
        while size > 0:
            size -= self.width[ids[j]]
            j += 1
        assert size == 0
        return j

    def decode(self, ids: list[int]) -> str:
        return self._bytes(ids, 0, len(ids)).decode("utf-8", "replace")

    def _bytes(self, ids: list[int], a: int, b: int) -> bytes:
        if b - a <= self.leaf:
            return b"".join(self.encoding.decode_single_token_bytes(i) for i in ids[a:b])
        m = (a + b) // 2
        return self._bytes(ids, a, m) + self._bytes(ids, m, b)

    def part(self, text: str) -> tuple[str, list[int] | None, str]:
        """(what stands before the first stable place, ids up to the last one, what stands behind it); ids are None if there is no such place."""
        first = next((k for k in range(1, len(text)) if stable(text, k)), None)
        if first is None:
            return text, None, ""
        last = next(k for k in range(len(text) - 1, 0, -1) if stable(text, k))
        return text[:first], self.encode(text[first:last]), text[last:]

    def stitch(self, parts: list[tuple[str, list[int] | None, str]]) -> list[int]:
        """Ids of a text from those of its parts in their order."""
        out, seam = [], ""
        for head, ids, tail in parts:
            if ids is None:
                seam += head  # the window grows over the whole part
                continue
            out += self.encode(seam + head)
            out += ids
            seam = tail
        return out + self.encode(seam)


def read_ranks(vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> bytes:
    return Path(folder, f"{vocabulary}.tiktoken").read_bytes()


def token_ids(df: DataFrame, text: str, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER, leaf: int = LEAF) -> Column:
    """A column of the token ids of ``text``; the vocabulary's file (under 1 MB) travels with the plan."""
    held = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary, folder))

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = TreeEncoder(held.value, leaf=leaf)
        for texts in batches:
            yield pd.Series([encoder.encode(t) for t in texts], dtype=object)

    return encode(F.col(text))


def encode_table(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER, leaf: int = LEAF, part: int = PART) -> DataFrame:
    """(key, ids) of every row; texts of more than ``part`` bytes are encoded in several tasks and stitched."""
    held = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary, folder))
    own = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = own.schema["key"].dataType.simpleString()
    long = F.coalesce(F.octet_length("text") > part, F.lit(False))
    short = spread(own.where(~long))
    short = short.select("key", token_ids(short, "text", vocabulary, folder, leaf).alias("ids"))
    same = ["key", "i1", "i2"]
    parts = own.where(long).select("key", F.xxhash64("text").alias("i1"), F.xxhash64(F.lit(1), "text").alias("i2"), F.encode("text", "UTF-8").alias("bytes"))
    parts = parts.withColumn("part_no", F.explode(F.expr(f"sequence(0, cast((octet_length(bytes) - 1) div {part} AS INT))")))
    parts = parts.select(*same, "part_no", F.expr(f"substring(bytes, part_no * {part} + 1, {part + 3})").alias("chunk")).repartition(*same, "part_no")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = TreeEncoder(held.value, leaf=leaf)
        for pdf in batches:
            found = [encoder.part(own_text(bytes(c), part, n == 0)) for n, c in zip(pdf["part_no"], pdf["chunk"])]
            yield pdf[[*same, "part_no"]].assign(head=[f[0] for f in found], ids=[f[1] for f in found], tail=[f[2] for f in found])

    coded = parts.mapInPandas(work, f"key {kind}, i1 bigint, i2 bigint, part_no int, head string, ids array<int>, tail string")
    coded = coded.groupBy(*same, "part_no").agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("head", "ids", "tail")))
    whole = coded.groupBy(*same).agg(F.max("copies").alias("copies"), F.sort_array(F.collect_list(F.struct("part_no", "head", "ids", "tail"))).alias("parts"))

    def stitched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = TreeEncoder(held.value, leaf=leaf)
        for pdf in batches:
            ids = [encoder.stitch([(p["head"], None if p["ids"] is None else list(p["ids"]), p["tail"]) for p in ps]) for ps in pdf["parts"]]
            out = pdf[["key"]].assign(ids=ids)
            yield out.loc[out.index.repeat(pdf["copies"])]

    large = whole.select("key", "copies", "parts").mapInPandas(stitched, f"key {kind}, ids array<int>")
    return short.unionByName(large).withColumnRenamed("key", key)


def own_text(chunk: bytes, part: int, first: bool) -> str:
    """The characters that start in the first ``part`` bytes of a chunk; a character's later bytes may lie behind them."""
    start = 0
    while not first and start < len(chunk) and chunk[start] & 0xC0 == 0x80:
        start += 1
    end = min(part, len(chunk))
    while end < len(chunk) and chunk[end] & 0xC0 == 0x80:
        end += 1
    return chunk[start:end].decode("utf-8", "replace")
