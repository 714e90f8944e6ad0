"""Languages of texts by bit-sliced Bloom filters of n-grams.

One table holds the filters of all languages side by side: a slot is an integer
with a bit for each language, as wide as there are languages.  A look-up ANDs the
integers at the n-gram's slots, which lie in one block of the table, and so
returns every language that has the n-gram.  A text's counts of bits, for each
language less its expected false positives, decide.  All of it works on whole
Arrow batches with numpy.

The filters are fitted on a bounded number of labelled rows (``MAX_TRAIN``), the
fit is repeated once with the sample's labels corrected by the first fit.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np

from .lookalike import fold_look

LANGS = ("en", "tl", "es", "fr", "de", "id")
ORDERS = (2, 3, 4, 5)
SLOTS = 1 << 21
HASHES = 3
MAX_TRAIN = 12_000
# Notations of the languages beside their two-letter codes.
NAMES = {
    "eng": "en", "english": "en", "tgl": "tl", "fil": "tl", "tagalog": "tl", "filipino": "tl", "taglish": "tl", "spa": "es",
    "spanish": "es", "fra": "fr", "fre": "fr", "french": "fr", "deu": "de", "ger": "de", "german": "de", "ind": "id", "indonesian": "id",
}

_GAPS = re.compile(r"[\W\d_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xBF58476D1CE4E5B9)
CHUNK = 100_000  # characters worked on at once


def language_code(label: str | None) -> str | None:
    """The language a label names, whatever its notation; None for none, unknown or another language."""
    if label is None:
        return None
    head = re.split(r"[-_\s]", label.strip().lower())[0]
    return head if head in LANGS else NAMES.get(head)


def letters(text: str) -> str:
    """The words of a text in one form, in small letters, between single spaces."""
    return " " + _GAPS.sub(" ", fold_look(text).lower()).strip() + " "


def ngram_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of ``letters`` texts and the text each comes from."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    if not raw:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    chars = np.concatenate(raw).astype(np.uint64)
    of = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    hashes, owners = [], []
    rolling = np.zeros(len(chars), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(chars) < n:
            break
        rolling = rolling[: len(chars) - n + 1] * _MULT + chars[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            same = of[: len(rolling)] == of[n - 1 :]
            hashes.append(rolling[same] * _MULT)
            owners.append(of[: len(rolling)][same])
    return np.concatenate(hashes), np.concatenate(owners)


def _slots(h: np.ndarray) -> list[np.ndarray]:
    """The slots of each hash: a block of 64 by its first bits, places in it by the next."""
    g = (h ^ (h >> np.uint64(29))) * _STEP
    bits = SLOTS.bit_length() - 1
    block = (g >> np.uint64(64 - bits + 6)) << np.uint64(6)
    return [(block | ((g >> np.uint64(64 - bits - 6 * k)) & np.uint64(63))).astype(np.int64) for k in range(HASHES)]


def mask_type(languages: int) -> np.dtype:
    """The smallest integer with a bit for each language."""
    for kind in (np.uint8, np.uint16, np.uint32, np.uint64):
        if languages <= np.dtype(kind).itemsize * 8:
            return np.dtype(kind)
    raise ValueError("at most 64 languages fit the masks")


class LanguageFilters:
    """Fitted filters: ``scores`` gives counts for each text and language."""

    def __init__(self, table: np.ndarray):
        self.table = table
        bit = table.dtype.type
        fill = np.array([np.mean((table >> bit(i)) & bit(1)) for i in range(len(LANGS))])
        self.false = fill**HASHES
        many = np.arange(1 << min(len(LANGS), 8))
        own = (many[:, None] >> np.arange(len(LANGS))) & 1
        self.share = own / np.maximum(own.sum(axis=1, keepdims=True), 1)  # what an n-gram counts for each language, by mask

    @classmethod
    def fit(cls, texts: Sequence[str], langs: Sequence[str], share: float = 0.25) -> LanguageFilters:
        """An n-gram enters the filter of each language that uses it at least ``share`` times as often as the one that uses it most."""
        h, of = ngram_hashes([letters(t) for t in texts])
        lang = np.array([LANGS.index(x) for x in langs])[of] if len(h) else np.zeros(0, int)
        grams, index = np.unique(h, return_inverse=True)
        counts = np.zeros((len(LANGS), len(grams)))
        np.add.at(counts, (lang, index), 1)
        rates = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        member = (rates >= share * rates.max(axis=0, initial=0)) & (counts > 0)
        kind = mask_type(len(LANGS))
        bits = np.zeros(len(grams), kind)
        for i in range(len(LANGS)):
            bits |= member[i].astype(kind) << kind.type(i)
        table = np.zeros(SLOTS, kind)
        for s in _slots(grams):
            np.bitwise_or.at(table, s, bits)
        return cls(table)

    def refit(self, labelled: tuple[Sequence[str], Sequence[str]], sample: Sequence[str], least: float = 0.6) -> LanguageFilters:
        """A second fit with the sample's texts that this one tells clearly."""
        texts = [t for t in sample if t]
        if not texts:
            return self
        best, sure = self.decide(texts)
        keep = [(t, LANGS[b]) for t, b, c in zip(texts, best, sure) if b >= 0 and c >= least]
        return LanguageFilters.fit([*labelled[0], *(t for t, _ in keep)], [*labelled[1], *(x for _, x in keep)])

    def scores(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) counts, an n-gram shared by k languages counting 1/k for each, and the n-grams of each text."""
        return self.scores_of([letters(t) for t in texts])

    def scores_of(self, own: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """``scores`` of texts in the form of ``letters``."""
        out, size = np.zeros((len(own), len(LANGS))), np.zeros(len(own))
        a = 0
        while a < len(own):
            b, chars = a, 0
            while b < len(own) and (b == a or chars + len(own[b]) <= CHUNK):
                chars += len(own[b])
                b += 1
            out[a:b], size[a:b] = self._scores(own[a:b])
            a = b
        return np.maximum(out - size[:, None] * self.false, 0) / (1 - self.false), size

    def _scores(self, own: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        chars = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        of = np.repeat(np.arange(len(own), dtype=np.int32), [len(t) for t in own])
        size = np.zeros(len(own) + 1)
        wide = len(self.share)
        counts = np.zeros((len(own) + 1, wide if len(LANGS) <= 8 else len(LANGS)))
        rolling = np.zeros(len(chars), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if len(chars) < n:
                break
            rolling = rolling[: len(chars) - n + 1] * _MULT + chars[n - 1 :] + np.uint64(n)
            if n not in ORDERS:
                continue
            owner = np.where(of[: len(rolling)] == of[n - 1 :], of[n - 1 :], np.int32(len(own)))  # the last row takes what lies across two texts
            first, *rest = _slots(rolling * _MULT)
            mask = self.table[first]
            for s in rest:
                mask &= self.table[s]
            size += np.bincount(owner, minlength=len(own) + 1)
            if len(LANGS) <= 8:
                counts += np.bincount(owner * wide + mask, minlength=counts.size).reshape(counts.shape)
            else:
                bits = (mask[:, None] >> np.arange(len(LANGS), dtype=mask.dtype)) & mask.dtype.type(1)
                weight = 1.0 / np.maximum(bits.sum(axis=1), 1)
                counts += np.stack([np.bincount(owner, weights=weight * bits[:, i], minlength=len(own) + 1) for i in range(len(LANGS))], 1)
        return (counts[:-1] @ self.share if len(LANGS) <= 8 else counts[:-1]), size[:-1]

    def decide(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The language of each text as an index, -1 without evidence, and a confidence from 0 to 1."""
        return pick(self.scores(texts)[0])


def pick(scores: np.ndarray, borrowed: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """Best language of each row of counts.

    English terms stand inside sentences of the other languages (Taglish most of
    all), so where English leads, another language with at least ``borrowed`` of
    its count has the sentence.
    """
    if not len(scores):
        return np.zeros(0, int), np.zeros(0)
    best = scores.argmax(axis=1)
    rest = scores.copy()
    rest[:, 0] = 0
    other = rest.argmax(axis=1)
    rows = np.arange(len(scores))
    take = (best == 0) & (rest[rows, other] >= borrowed * scores[:, 0]) & (scores[:, 0] > 0)
    best = np.where(take, other, best)
    first = scores[rows, best]
    second = scores.copy()
    second[rows, best] = 0
    total = scores.sum(axis=1)
    sure = np.where(total > 0, (first + 1e-9) / (first + second.max(axis=1) + 1e-9), 0.0)
    return np.where(total > 0, best, -1), sure
