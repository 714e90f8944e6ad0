"""Passages of evaluation items inside documents.

An item's own words (less the sentences it shares with another item) are split
into pieces, one more than the errors they may hold; every exact hit of a piece
in a document makes the pair a candidate; a candidate goes through three bounds,
on whole arrays of pairs, and is verified by Myers' bit-parallel distance, on words.

The guarantee.  A leaked half of n own words lies in at most two stretches of
the item, T words in all with e errors, T - e >= n / 2 and e <= ERRORS T, so
that e is at most n ERRORS / (2 - 2 ERRORS) (``budget``).  Two stretches of T
words hold at least (T - 4 (P - 1)) / P whole pieces of P words; with P at most
(T + 4) / (e + 5) these are e + 1 and one of them is unchanged (``piece_words``).
The remainder of an item is a piece of its own, and short items come down to
pieces of one word, so no item is too short.

The bounds drop no pair that may hold half of the item: an error spoils two of
the pairs of neighbouring words of its stretch, so n / 2 - 2 - budget of them
stand in the document, and in two bands of diagonals as wide as the budget;
and n / 2 - 2 words stand in the item's order (bit-parallel over many pairs).

Items never come to the driver.  They are written to the shared folder in blocks
of at most some ``BLOCK`` items; a task normalises each document once and walks
the blocks, so what it holds is bounded however many items there are.

Defined results: null, empty and wordless texts hold nothing; an item without
words of its own never leaks; the rows of one item id are one item; rows without
an id are left out; repeated documents each count under their id.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, OrderedDict, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, read_rows, spread, written
from .lookalike import fold_look

SHORT = 24  # items of fewer own words are chained by single words, others by pairs
GAP = 12  # words of an item or a document between two hits of one passage
HALF = 0.5
ERRORS = 0.2  # share of a passage's words that may be replaced or dropped
BLOCK = 2000
KEPT = 8  # blocks that a task keeps ready
SINGLE = 8  # words that a passage with one unchanged piece holds, at most
HITS = 2_000_000  # hits, flags or words looked at together
LONG = 8192  # documents of more words skip the bound on words in order, which only saves time

_MARKUP = re.compile(r"</?[a-zA-Z][^<>\n]{0,200}>|&[a-z]{2,6};")
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?:。])\s+|\n+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Words in one form: look-alikes, case, punctuation, line breaks and markup put aside."""
    if not text:
        return []
    text = fold_look(text)
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    return _WORD.findall(text.casefold().replace("_", " "))


def sentences(text: str | None) -> list[list[str]]:
    return [words(s) for s in _SENTENCE.split(fold_look(text or ""))]


def own_words(items: Iterable[tuple[int, str | None]]) -> dict[int, list[str]]:
    """The words of each item without the sentences that another item has too, for items held in memory."""
    parts = {i: sentences(t) for i, t in items}
    shared = Counter(key for ps in parts.values() for key in {tuple(p) for p in ps if p})
    return {i: [w for p in ps if shared[tuple(p)] < 2 for w in p] for i, ps in parts.items()}


def myers(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the pattern to a stretch of the text, and where the stretch ends."""
    m = len(pattern)
    peq: dict[int, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        peq[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def _extend(item: list[int], doc: list[int], i: int, j: int, step: int) -> tuple[int, int]:
    """Words gained and errors made when a passage is followed outwards from item word i and document word j."""
    gained = errors = good = bad = run = 0

    def at(a: list[int], k: int) -> int:
        return a[k] if 0 <= k < len(a) else -1

    while 0 <= i < len(item) and 0 <= j < len(doc):
        if item[i] == doc[j]:
            gained, run, i, j = gained + 1, run + 1, i + step, j + step
            if run >= 2 or not errors:
                good, bad = gained, errors
            continue
        if errors and run < 2:
            break
        one = at(item, i + step), at(doc, j + step)
        if one[0] == one[1] and one[0] > 0:
            i, j = i + step, j + step
        elif one[0] == doc[j]:
            i += step
        elif one[1] == item[i]:
            j += step
        else:
            break
        errors, run = errors + 1, 0
    return good, bad


def budget(n: int) -> int:
    """Most errors that the stretches of an item of n own words may hold when half of it leaks."""
    return int(HALF * n * ERRORS / (1 - ERRORS) + 1e-9)


def piece_words(n: int) -> int:
    """Words of a piece of an item of n own words, so that one piece of a leaked half is unchanged."""
    e = budget(n)
    return max(1, int((HALF * n + e + 4) / (e + 5) + 1e-9))


def _chains(item: list[int], doc: list[int], hits: list[tuple[int, int]], piece: int) -> list[list[tuple[int, int, int]]]:
    """Chains of (item word, document word, errors since the hit before), the best first; each hit is in one chain."""
    score, back, errors = [], [], []
    low = 0
    for k, (i, j) in enumerate(hits):
        best, at, made = piece, -1, 0
        while hits[low][1] < j - piece - GAP:
            low += 1
        for m in range(k - 1, low - 1, -1):
            gi, gj = i - hits[m][0] - piece, j - hits[m][1] - piece
            if not 0 <= gi <= GAP or gj < 0:
                continue
            e = same = 0
            if gi or gj:
                short = min(gi, gj)
                if gi == gj:
                    same = sum(item[i - x] == doc[j - x] for x in range(1, gi + 1))
                else:
                    while same < short and item[i - 1 - same] == doc[j - 1 - same]:
                        same += 1
                    lead = 0
                    while same + lead < short and item[i - gi + lead] == doc[j - gj + lead]:
                        lead += 1
                    same += lead
                e = max(gi, gj) - same
            now = score[m] + piece + same - e
            if now > best:
                best, at, made = now, m, e
            if not (gi or gj):
                break
        score.append(best)
        back.append(at)
        errors.append(made)
    used = [False] * len(hits)
    out = []
    for k in sorted(range(len(hits)), key=lambda x: -score[x]):
        chain = []
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append((*hits[k], errors[k]))
            k = back[k]
        if chain:
            out.append(chain[::-1])
    return out


def best_two(passages: list[tuple[int, int, int, int]]) -> int:
    """Most words held by one passage or by two in the item's and the document's order (two words of the item may be in both)."""
    best = max((p[2] for p in passages), default=0)
    if len(passages) < 2:
        return best
    passages = sorted(passages)
    places = sorted({p[3] for p in passages})
    running = [0] * (len(places) + 1)  # a tree of maxima over document places
    ended: list[tuple[int, int, int]] = []
    upto = 0
    for start, _, held, place in passages:
        while passages[upto][0] < start:
            heappush(ended, (passages[upto][1], passages[upto][2], passages[upto][3]))
            upto += 1
        while ended and ended[0][0] <= start + 2:
            _, other, at = heappop(ended)
            k = bisect_right(places, at)
            while k <= len(places):
                running[k] = max(running[k], other)
                k += k & -k
        k = bisect_right(places, place)
        while k:
            best = max(best, held + running[k])
            k -= k & -k
    return best


def hashed(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` words."""
    h = np.zeros(max(len(ids) - size + 1, 0), np.uint64)
    for n in range(size):
        h = h * _MULT + ids[n : n + len(h)] + np.uint64(1)
    return (h ^ (h >> np.uint64(31))) * _MULT


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each length, one after the other."""
    upto = np.cumsum(lengths)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - upto + lengths, lengths)


class Postings:
    """Values by hash: a filter of bits, sorted hashes and the values of each."""

    BITS = 20

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.lexsort((values, hashes))
        self.keys, self.first = np.unique(hashes[order], return_index=True)
        self.many = np.diff(np.append(self.first, len(order)))
        self.values = values[order]
        self.filter = np.zeros(1 << self.BITS, bool)
        self.filter[self._place(self.keys)] = True

    def _place(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``h`` that are among the keys, and the number of the key at each."""
        at = np.flatnonzero(self.filter[self._place(h)])
        if not len(self.keys):
            return at[:0], at[:0]
        key = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[key] == h[at]
        return at[same], key[same]


class ItemIndex:
    """Items of one block, ready to be looked up."""

    def __init__(self, items: dict[int, list[str]]):
        self.ids = [i for i, w in items.items() if w]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for i in self.ids for w in items[i]}), 1)}
        self.items = [[self.vocabulary[w] for w in items[i]] for i in self.ids]
        self.size = np.array([len(x) for x in self.items], dtype=np.int64)
        self.piece = [1 if n < SHORT else 2 for n in self.size]
        self.pairs_needed = np.ceil(HALF * self.size - 2 - np.array([budget(n) for n in self.size]) - 1e-9)
        arrays = [np.array(x, dtype=np.uint64) for x in self.items]
        cuts: dict[int, list[tuple[np.uint64, int]]] = defaultdict(list)
        for k, seq in enumerate(arrays):
            size = piece_words(len(seq))
            whole = len(seq) - len(seq) % size
            cuts[size] += [(h, k) for h in hashed(seq[:whole], size)[::size]]
            if whole < len(seq):
                cuts[len(seq) - whole].append((hashed(seq[whole:], len(seq) - whole)[0], k))
        self.tables = [(n, Postings(np.array([h for h, _ in own], dtype=np.uint64), np.array([k for _, k in own], dtype=np.int64))) for n, own in sorted(cuts.items())]
        pairs = [hashed(seq, 2) for seq in arrays]
        flat = np.concatenate(pairs) if pairs else np.zeros(0, np.uint64)
        self.grams = Postings(flat, np.repeat(np.arange(len(pairs)), [len(h) for h in pairs]))
        self.gram_of = np.searchsorted(self.grams.keys, flat)  # of each neighbouring pair of each item
        self.gram_many = np.array([len(h) for h in pairs], dtype=np.int64)
        self.gram_first = np.cumsum(self.gram_many) - self.gram_many
        codes = np.repeat(np.arange(len(arrays)), self.gram_many) * len(self.grams.keys) + self.gram_of
        order = np.argsort(codes, kind="stable")
        self.gram_codes, self.gram_places = codes[order], _runs(np.zeros(len(arrays), np.int64), self.gram_many)[order]
        self.gram_dense = None
        if len(arrays) * len(self.grams.keys) <= 4 * HITS:  # by place where that is small, else by search
            many = np.bincount(self.gram_codes, minlength=len(arrays) * len(self.grams.keys))
            self.gram_dense = (np.cumsum(many) - many, many)
        self.band = np.array([budget(n) + 1 for n in self.size], dtype=np.int64)
        self.limbs = (self.size + 63) // 64
        self._masks: tuple[int, int, np.ndarray] | None = None
        self._places: dict[int, dict] = {}

    def candidates(self, docs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays (document, item) of the pairs that share a piece and pass the bounds, some documents at a time."""
        wide = max(len(self.ids), len(self.grams.keys), 1)
        at = 0
        while at < len(docs):
            end, words = at, 0
            while end < len(docs) and (end == at or (words + len(docs[end]) <= HITS and (end - at) * wide <= 8 * HITS)):
                words += len(docs[end])
                end += 1
            doc, item = self._sharing(docs[at:end])
            if len(doc):
                keep = self._ordered(docs[at:end], doc, item)
                doc, item = doc[keep], item[keep]
                keep = self._near(docs[at:end], doc, item)
                yield doc[keep] + at, item[keep]
            at = end

    def _sharing(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(d) for d in docs])
        flat = np.concatenate(docs).astype(np.uint64)
        of = np.repeat(np.arange(len(docs)), sizes)
        shared = np.zeros(len(docs) * len(self.ids), bool)
        for size, table in self.tables:
            at, key = table.find(hashed(flat, size))
            inside = of[at] == of[at + size - 1]
            at, key = at[inside], key[inside]
            upto = np.cumsum(table.many[key])
            a = 0
            while a < len(at):  # pieces that many items share are spread over steps of bounded size
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HITS, "right")))
                many = table.many[key[a:b]]
                shared[np.repeat(of[at[a:b]], many) * len(self.ids) + table.values[_runs(table.first[key[a:b]], many)]] = True
                a = b
        pair = np.flatnonzero(shared)
        doc, item = pair // len(self.ids), pair % len(self.ids)
        at, key = self.grams.find(hashed(flat, 2))
        inside = of[at] == of[at + 1]
        present = np.zeros((len(docs), len(self.grams.keys)), bool)
        present[of[at[inside]], key[inside]] = True
        stand = np.zeros(len(docs) * len(self.ids), np.int32)  # places of each item whose two words stand side by side in each document
        there = np.flatnonzero(present)
        doc_of, gram = there // len(self.grams.keys), there % len(self.grams.keys)
        upto = np.cumsum(self.grams.many[gram])
        a = 0
        while a < len(there):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HITS, "right")))
            many = self.grams.many[gram[a:b]]
            cell = np.repeat(doc_of[a:b] * len(self.ids), many) + self.grams.values[_runs(self.grams.first[gram[a:b]], many)]
            low = int(cell.min()) if len(cell) else 0
            some = np.bincount(cell - low)
            stand[low : low + len(some)] += some.astype(np.int32)
            a = b
        keep = stand[pair] >= self.pairs_needed[item]
        return doc[keep], item[keep]

    def _ordered(self, docs: list[np.ndarray], doc: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which pairs hold enough words in the item's order."""
        keep = np.ones(len(doc), bool)
        known = [d[d > 0] for d in docs]
        length = np.array([len(d) for d in known])
        order = np.lexsort((-length[doc], item))
        for low, high, masks in self._mask_tables():
            for limbs in np.unique(self.limbs[low:high]):
                own = order[(item[order] >= low) & (item[order] < high) & (self.limbs[item[order]] == limbs) & (length[doc[order]] <= LONG)]
                for a in range(0, len(own), 20_000):
                    part = own[a : a + 20_000]
                    part = part[np.argsort(-length[doc[part]], kind="stable")]
                    keep[part] = self._lcs(known, doc[part], item[part] - low, masks[:, :, :limbs], self.size[item[part]]) >= HALF * self.size[item[part]] - 2
        return keep

    def _near(self, docs: list[np.ndarray], doc: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which pairs hold enough neighbouring words in two bands of diagonals, as wide as errors may shift a passage.

        A band lies in two stripes side by side, so their sum bounds it from above.
        """
        keep = self.pairs_needed[item] <= 0
        test = np.flatnonzero(~keep)
        codes = [self.grams.find(hashed(d.astype(np.uint64), 2)) if use else None for d, use in zip(docs, np.bincount(doc[test], minlength=len(docs)))]
        sizes = np.array([len(c[0]) if c else 0 for c in codes], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        where = np.concatenate([c[0] for c in codes if c] or [np.zeros(0, np.int64)])
        gram = np.concatenate([c[1] for c in codes if c] or [np.zeros(0, np.int64)])
        upto = np.cumsum(sizes[doc[test]])
        a = 0
        while a < len(test):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HITS, "right")))
            own = test[a:b]
            many = sizes[doc[own]]
            at = _runs(first[doc[own]], many)
            pair = np.repeat(np.arange(len(own)), many)
            code = item[own][pair] * len(self.grams.keys) + gram[at]
            if self.gram_dense is not None:
                lo, hits = (t[code] for t in self.gram_dense)
            else:
                lo = np.searchsorted(self.gram_codes, code, "left")
                hits = np.searchsorted(self.gram_codes, code, "right") - lo
            some = np.flatnonzero(hits)
            pair, at, lo, hits = pair[some], at[some], lo[some], hits[some]
            place = self.gram_places[_runs(lo, hits)]
            pair, at = np.repeat(pair, hits), np.repeat(where[at], hits)
            keep[own] = self._bands(pair, at - place, place, item[own]) >= self.pairs_needed[item[own]]
            a = b
        return keep

    def _bands(self, pair: np.ndarray, diagonal: np.ndarray, place: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The most item places that two bands of each pair can hold.

        A band lies in two stripes side by side; two bands lie in three stripes
        side by side or in two and two that don't overlap.
        """
        if not len(pair):
            return np.zeros(len(item), np.int64)
        stripe = diagonal // (self.band[item[pair]] + 1)
        stripe = stripe - stripe.min() + 2
        wide, deep = int(stripe.max()) + 3, int(place.max()) + 1
        cells = np.sort((pair * wide + stripe) * deep + place)
        cells = cells[np.concatenate([[True], cells[1:] != cells[:-1]])] // deep
        count = np.bincount(cells, minlength=len(item) * wide).reshape(len(item), wide).astype(np.int32)
        two = count[:, :-1] + count[:, 1:]
        three = (two[:, :-1] + count[:, 2:]).max(axis=1)
        rows, best = np.arange(len(item)), two.argmax(axis=1)
        first = two[rows, best]
        beside = two[rows, np.maximum(best - 1, 0)] + two[rows, np.minimum(best + 1, two.shape[1] - 1)]
        for step in (-1, 0, 1):
            two[rows, np.clip(best + step, 0, two.shape[1] - 1)] = 0
        return np.maximum(np.maximum(three, beside), first + two.max(axis=1)).astype(np.int64)

    def _mask_tables(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first item, one after the last, places of each word in each of the items as bits) for groups of items."""
        if self._masks is not None:
            yield self._masks
            return
        wide = len(self.vocabulary) + 1
        low = 0
        while low < len(self.items):
            high = low + 1
            while high < len(self.items) and (high + 1 - low) * wide * max(self.limbs[low : high + 1]) <= 2 * HITS:
                high += 1
            table = np.zeros((high - low, wide, max(self.limbs[low:high])), np.uint64)
            for k in range(low, high):
                for at, w in enumerate(self.items[k]):
                    table[k - low, w, at >> 6] |= np.uint64(1 << (at & 63))
            if high - low == len(self.items):
                self._masks = (low, high, table)
            yield low, high, table
            low = high

    @staticmethod
    def _lcs(docs: list[np.ndarray], doc: np.ndarray, item: np.ndarray, masks: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Words in order of each pair, the longest documents first, one step for a word of all documents: Hyyrö's bit-parallel recurrence with carries between limbs."""
        limbs = masks.shape[2]
        length = np.array([len(docs[d]) for d in doc])
        ends = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")
        use, local = np.unique(doc, return_inverse=True)
        words = np.zeros((max(length, default=0), len(use)), np.int64)
        for k, d in enumerate(use):
            words[: len(docs[d]), k] = docs[d]
        flat = masks.reshape(-1, limbs) if masks.flags.c_contiguous else np.ascontiguousarray(masks).reshape(-1, limbs)
        base = item * masks.shape[1]
        v = [np.full(len(doc), ~np.uint64(0)) for _ in range(limbs)]
        for j, end in enumerate(ends):
            row = base[:end] + words[j][local[:end]]
            carry = None
            for x in range(limbs):
                m = flat[row, x]
                own = v[x][:end]
                u = own & m
                total = own + u
                over = total < own
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over
                v[x][:end] = total | (own ^ u)
        held = np.zeros(len(doc), np.int64)
        for x in range(limbs):
            valid = np.clip(size - 64 * x, 0, 64)
            mask = np.where(valid >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(valid, 63).astype(np.uint64)) - np.uint64(1))
            held += np.bitwise_count(~v[x] & mask)
        return held

    def held(self, item: list[int], doc: list[int], hits: list[tuple[int, int]], piece: int) -> int:
        """Own words that stand in the best two passages of the document, in the item's order.  Hits are sorted by document word."""
        chains = _chains(item, doc, hits, piece)
        need = HALF * len(item)
        # a passage of T words with e errors has (T - 2) / 2 - e unchanged pieces c, so that it holds at most
        # (c + 1) (1 - ERRORS) / (1 / 2 - ERRORS) words; two more allow for pieces that another chain took
        most = sorted((len(chain) for chain in chains), reverse=True)[:2]
        if (sum(most) + 4) * (1 - ERRORS) / (0.5 - ERRORS) < need:
            return 0
        passages = [p for chain in chains if len(chain) > 1 for p in self._passages(item, doc, chain, piece)]
        first = sorted((p[2] for p in passages), reverse=True)[:2]
        # of SINGLE words with few errors some run of four, or two of three, has two pieces: a chain of one hit gives less
        if max(sum(first), (first[0] if first else 0) + SINGLE, 2 * SINGLE) < need:
            return sum(first)
        passages += [p for chain in chains if len(chain) == 1 for p in self._passages(item, doc, chain, piece)]
        return best_two(passages)

    def _passages(self, item: list[int], doc: list[int], chain: list[tuple[int, int, int]], piece: int) -> list[tuple[int, int, int, int]]:
        """(first item word, one after the last, words held, first document word) of a chain of hits, followed outwards; one with too many errors is split at its worst gap."""
        (i0, j0, _), (i1, j1, _) = chain[0], chain[-1]
        span = item[i0 : i1 + piece]
        lost = myers(span, doc[max(j0 - 1, 0) : j1 + piece + 1])[0] if any(e for _, _, e in chain[1:]) else 0
        before, e0 = _extend(item, doc, i0 - 1, j0 - 1, -1)
        after, e1 = _extend(item, doc, i1 + piece, j1 + piece, 1)
        held = len(span) - lost + before + after
        total = len(span) + before + e0 + after + e1
        if held >= (1 - ERRORS) * total:
            return [(i0 - before - e0, i1 + piece + after + e1, held, j0)]
        if len(chain) == 1:
            return []
        cut = max(range(1, len(chain)), key=lambda k: chain[k][2])
        return self._passages(item, doc, chain[:cut], piece) + self._passages(item, doc, chain[cut:], piece)

    def leaks(self, texts: Sequence[Sequence[str]]) -> Iterator[tuple[int, int, float]]:
        """(document's place, item id, share of the item's own words held) of documents given as their words."""
        if not self.ids:
            return
        known = self.vocabulary.get
        docs = [np.array([known(w, 0) for w in t], dtype=np.int64) for t in texts]
        for found, items in self.candidates(docs):
            last = -1
            for d, k in zip(found.tolist(), items.tolist()):
                if d != last:
                    last, doc = d, docs[d].tolist()
                    pairs = list(zip(doc, doc[1:]))
                share = self.held(self.items[k], doc, self._hits(k, doc, pairs), self.piece[k]) / len(self.items[k])
                if share >= HALF:
                    yield d, self.ids[k], share

    def _hits(self, k: int, doc: list[int], pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """(item word, document word) of every piece of the item that stands in the document, by document word."""
        where = self._places.get(k)
        if where is None:
            where = self._places[k] = defaultdict(list)
            seq, size = self.items[k], self.piece[k]
            for at in range(0, len(seq) - size + 1, size):
                where[seq[at] if size == 1 else (seq[at], seq[at + 1])].append(at)
        return [(i, j) for j, w in enumerate(doc if self.piece[k] == 1 else pairs) if w in where for i in where[w]]


def own_table(items: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, words): each item's words in their order, without the sentences that another item has too."""
    rows = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).dropna().dropDuplicates()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, t, n, w) for i, t in pdf.itertuples(index=False) for n, w in enumerate(sentences(t)) if w]
            yield pd.DataFrame(out, columns=["item_id", "text", "n", "words"]).astype({"item_id": "int64", "n": "int32"})

    parts = rows.mapInPandas(split, "item_id bigint, text string, n int, words array<string>")
    parts = parts.select("item_id", F.xxhash64("text").alias("row"), "n", "words", F.xxhash64("words").alias("k1"), F.xxhash64(F.lit(1), "words").alias("k2"))
    shared = parts.select("k1", "k2", "item_id").distinct().groupBy("k1", "k2").count().where("count > 1")
    own = parts.join(shared, ["k1", "k2"], "left_anti")
    return own.groupBy("item_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("row", "n", "words"))), lambda x: x["words"])).alias("words"))


class Blocks:
    """The written blocks of items as a task reads them; the last few stay ready."""

    def __init__(self, path: str, many: int):
        self.path, self.many = path, many
        self._kept: OrderedDict[int, ItemIndex] = OrderedDict()

    def __iter__(self) -> Iterator[ItemIndex]:
        for b in range(self.many):
            if b not in self._kept:
                own = read_rows(f"{self.path}/block={b}", ["item_id", "words"])
                self._kept[b] = ItemIndex({i: list(w) for i, w in sorted(own, key=lambda r: r[0])})
                if len(self._kept) > KEPT:
                    self._kept.popitem(last=False)
            yield self._kept[b]


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, held): each document with each item of whose own words it holds at least half."""
    own = cut(own_table(items, item_id, item_text))
    many = max(1, -(-own.count() // block))
    path = written(own.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(many)).cast("int")), ["block"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = Blocks(path, many)
        for pdf in batches:
            keys = pdf.iloc[:, 0].to_numpy()
            read = [words(t) for t in pdf.iloc[:, 1]]
            for index in blocks:
                found = [(int(keys[d]), i, s) for d, i, s in index.leaks(read)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "held"]).astype({"doc_id": "int64", "item_id": "int64", "held": "float64"})

    source = documents.select(F.col(doc_id).cast("bigint"), text).dropna()
    return spread(source).mapInPandas(search, "doc_id bigint, item_id bigint, held double")
