"""Defective question and answer pairs.

A multi-label linear classifier on hashed n-grams and features of the pair
decides; nothing overrules it.  It is trained on a bounded sample of pairs
(``MAX_TRAIN``, the least by a hash of their texts), for negatives those it finds
nothing wrong with, and on the same pairs made defective: emptied, cut, echoed,
answered by another pair's answer in another language, refused.  Each label has a
threshold calibrated on pairs that were held out, wherever that puts it.

What a rule would ask of a pair (is there a word, does the answer add any to the
question, does it end with a mark, which languages do both halves have) are
features among others; the weights say what they are worth.

Defined results: a null or wordless answer is ``empty`` unless the status is
pending or skipped; a null question has no language and no echo; of several
defects the first in the order of ``DEFECTS`` counts; a pair delivered again
counts under each id; an empty table has no pairs.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, least_by_hash, spread
from .langid import LANGS, LanguageFilters, pick
from .lookalike import fold_look

DEFECTS = ("empty", "copy", "refusal", "language", "truncated")
MAX_TRAIN = 3000
DIMS = 1 << 14
SEED = 7
EPOCHS, BATCH, RATE = 6, 384, 0.05
ROWS = 1000  # pairs looked at together, so that what they need stays in the cache
#: How far from the held-out sound pairs towards the defective ones a threshold lies; near for refusals, which vary more than made ones do.
SIDE = (0.5, 0.5, 0.25, 0.5, 0.5)
#: The sample holds defective pairs too: either half is judged by a fit on the other, and a pair over this probability of a defect is no negative for it in the next fits (a round each, by defect).
DOUBTS = ((0.5, 0.5, 0.1, 0.5, 0.5),)
#: The weight of a sampled pair as a negative beside a pair made defective; low for refusals, which words alone tell and a fit would learn by heart.
UNLABELLED = (1.0, 1.0, 0.1, 1.0, 1.0)
#: The same for a sampled answer that was cut or answers another question.
REUSED = 0.5
AS_IT_IS = -2

# What stands for "nothing" when it is the whole answer.
PLACEHOLDERS = {
    "n a", "na", "tbd", "tba", "todo", "null", "none", "nil", "nan", "blank", "empty", "no answer", "no response", "none given", "not given", "not available",
    "not answered", "unanswered", "no answer given", "no response given", "no data", "missing", "undefined", "void", "left blank", "nothing", "no text", "placeholder", "pending", "to be done",
    "sin respuesta", "ninguna", "ninguno", "vacío", "sans réponse", "aucune", "aucune réponse", "néant", "vide", "keine antwort", "keine", "leer", "keine angabe",
    "walang sagot", "wala", "tidak ada", "tidak ada jawaban", "kosong",
}
# Words of questions that name a language to answer in.
ASKED = {
    "english": "en", "inglés": "en", "anglais": "en", "englisch": "en", "inggris": "en", "ingles": "en", "tagalog": "tl", "filipino": "tl", "spanish": "es", "español": "es",
    "espagnol": "es", "spanisch": "es", "spanyol": "es", "espanyol": "es", "french": "fr", "francés": "fr", "français": "fr", "französisch": "fr", "prancis": "fr", "pranses": "fr",
    "german": "de", "alemán": "de", "allemand": "de", "deutsch": "de", "jerman": "de", "aleman": "de", "indonesian": "id", "indonesio": "id", "indonésien": "id", "indonesisch": "id", "indonesia": "id",
}
# Words, and pairs of them, that refusals often have; whether an answer has one is a feature.
CUES = frozenset(
    "sorry apologies apologise apologize unfortunately afraid regret cannot unable decline declining rather won allowed permitted limits guidelines discuss refuse permission policy scope comment my me request question prompt assist assistant service topic "
    "siento lamentablemente disculpa disculpe perdón puedo declinar rechazar responder contestar ayudar permiso pregunta solicitud désolé regrette malheureusement excusez refuser répondre impossible aider je demande "
    "leid leider entschuldigung bedauerlicherweise ablehnen beantworten antworten helfen darf ich mir anfrage maaf sayangnya tolak menolak menjawab membantu diizinkan saya permintaan "
    "paumanhin pasensya ikinalulungkot tanggihan masasagot makatutulong matutulungan pinapayagang sagot ko ako hiling".split()
)
CUE_PAIRS = frozenset(("can not", "can t", "i am", "i m", "i have", "i must", "i can", "i d", "i won", "i will", "i do", "i would", "i may", "i prefer"))
# Parts that made-up refusals are put together from: an opener, a way to decline with what is declined, a closer.
_OPENERS = {
    "en": ["Sorry,", "I'm sorry, but", "Unfortunately,", "Apologies,", "As an assistant,", "Thank you for the question, but", "I appreciate your interest; however,", "I regret that", "I'm afraid", "Thanks for asking, but", "As an automated tutor,", "", ""],
    "es": ["Lo siento,", "Lamentablemente,", "Disculpa, pero", "Perdón,", "Como asistente,", ""], "fr": ["Désolé,", "Je regrette, mais", "Malheureusement,", "Excusez-moi,", "En tant qu'assistant,", ""],
    "de": ["Es tut mir leid,", "Leider:", "Leider geht es nicht:", "Entschuldigung,", "Bedauerlicherweise:", "Als Assistent sage ich:", ""], "id": ["Maaf,", "Mohon maaf,", "Sayangnya,", "Sebagai asisten,", ""], "tl": ["Paumanhin po,", "Pasensya na,", "Ikinalulungkot ko,", "Bilang katuwang,", ""],
}
_DECLINES = {
    "en": [("I {} {} {}.", ["cannot", "can't", "am not able to", "am unable to", "won't", "will not", "must decline to", "have to refuse to", "am not allowed to", "do not have permission to", "would rather not", "prefer not to", "am not in a position to", "won't be able to"],
            ["answer", "respond to", "help with", "assist with", "discuss", "comment on", "explain", "provide", "complete", "talk about", "say anything about"], ["this", "that", "this question", "your request", "this prompt", "that topic", "it", "questions like this one", "that explanation", "an answer here"]),
           ("{} is {}.", ["this", "that subject", "that topic", "this request", "the question", "answering this"], ["outside what I may discuss", "off limits for this assistant", "off limits for this service", "against my guidelines", "not something I can talk about", "beyond what I am allowed to discuss", "not something I may assist with"]),
           ("{} {}.", ["no answer", "no comment", "no explanation"], ["can be given here", "can be given by this service", "can be made on this", "will be given to such a prompt"]), ("{} {}.", ["I have no way of", "there is no way for me of", "I refrain from", "I abstain from"], ["responding to this prompt", "answering that", "helping with this request"])],
    "es": [("{} {} {}.", ["no puedo", "no me es posible", "no tengo permiso para", "debo negarme a", "prefiero no", "no estoy en condiciones de", "no se me permite"], ["responder a", "ayudar con", "contestar", "hablar de", "opinar sobre", "explicar"], ["esta pregunta", "eso", "esta solicitud", "este tema", "la petición"]), ("debo {} {}.", ["rechazar", "declinar"], ["esta solicitud", "la petición", "esta pregunta"])],
    "fr": [("{} {} {}.", ["je ne peux pas", "il m'est impossible de", "je ne suis pas en mesure de", "je n'ai pas le droit de", "je dois refuser de", "je préfère ne pas"], ["répondre à", "vous aider avec", "parler de", "commenter", "expliquer"], ["cette question", "cela", "cette demande", "ce sujet"]), ("je dois {} {}.", ["refuser", "décliner"], ["la demande", "cette question"]), ("je ne peux pas {}.", ["vous aider", "y répondre"])],
    "de": [("{} {} {}.", ["ich kann", "ich darf", "ich möchte"], ["diese Frage nicht", "dabei nicht", "darauf nicht", "dazu nichts", "auf die Anfrage nicht", "bei diesem Thema nicht"], ["beantworten", "helfen", "antworten", "sagen", "erklären"]), ("{} muss ich {}.", ["diese Anfrage", "die Frage", "eine Antwort"], ["ablehnen", "verweigern", "zurückweisen"]), ("eine Antwort ist mir {}.", ["nicht möglich", "nicht erlaubt"])],
    "id": [("{} {} {}.", ["saya tidak dapat", "saya tidak bisa", "saya tidak diizinkan", "saya tidak mampu", "saya menolak", "saya memilih tidak"], ["menjawab", "membantu dengan", "membahas", "memberikan jawaban atas", "mengomentari", "menjelaskan"], ["pertanyaan ini", "hal ini", "permintaan ini", "topik itu"]), ("{} harus saya tolak.", ["permintaan ini", "pertanyaan ini"]), ("saya tidak bisa {}.", ["membantu", "menjawab"])],
    "tl": [("{} {} {}.", ["hindi ko", "hindi ako pinapayagang", "hindi ko kayang"], ["masasagot", "sagutin", "pag-usapan", "matutulungan", "maipapaliwanag", "talakayin"], ["ang tanong na ito", "ito", "ang hiling na iyan", "ang paksang iyan"]), ("hindi ako {} sa {}.", ["makatutulong", "makasasagot"], ["hiling na iyan", "tanong na ito"]), ("kailangan kong {} {}.", ["tanggihan", "tumanggi sa"], ["ang hiling", "tanong na ito"]), ("wala akong maibibigay na {}.", ["sagot", "paliwanag"])],
}
_CLOSERS = {
    "en": ["", "", "Please ask your teacher.", "Please try another question.", "Is there anything else?", "Please see the course guide.", "Please ask your instructor.", "Is there anything else you need?", "Please consult the course guide instead."], "es": ["", "", "Consulta a tu profesor.", "Consulta a tu docente.", "Pregunta otra cosa."], "fr": ["", "", "Demandez à votre professeur.", "Adressez-vous à l'enseignant."],
    "de": ["", "", "Bitte frage deine Lehrkraft.", "Bitte frage die Kursleitung."], "id": ["", "", "Silakan bertanya kepada guru.", "Silakan tanya pengajar."], "tl": ["", "", "Magtanong po sa inyong guro.", "Magtanong po sa guro."],
}

_WORD = re.compile(r"\w+")
_MULT = np.uint64(0x9E3779B97F4A7C15)
_END = re.compile(r"[.!?。…][\"'’”»)\]]*\s*$")
_CLOSE = re.compile(r"[.!?。][\"'’”»)\]]*$")
_LIST = re.compile(r"^\s*(?:\d+[.)]|[-*•]|\(?[a-z]\)|[a-z][.)])\s*\S", re.IGNORECASE | re.MULTILINE)
_LABELS = {"q", "question", "prompt", "h", "pregunta", "frage", "tanong", "pertanyaan", "soal", "a", "answer", "task", "item"}
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
NUMERIC = 35
#: Where the weights start, and stay for a table that doesn't fill one step of the fit: the constant speaks against a defect, the feature (by place) that is closest to it for it.
PRIOR = 2.0
CLOSEST = {"empty": 3, "copy": 8, "language": 11, "truncated": 21}


def words(text: str | None) -> list[str]:
    return _WORD.findall(fold_look(text).casefold().replace("_", " ")) if text else []


def asked_languages(question: list[str]) -> set[str]:
    return {ASKED[w] for w in question if w in ASKED}


class Grams:
    """Hashed n-grams of some answers: their places in the weights, one after the other, and how many each answer has."""

    def __init__(self, places: np.ndarray, many: np.ndarray):
        self.places, self.many = places, many
        self.first = np.cumsum(many) - many

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, row, value) of the n-grams of some rows; a row's n-grams have the norm 1."""
        many = self.many[rows]
        at = np.arange(many.sum()) + np.repeat(self.first[rows] - np.cumsum(many) + many, many)
        return self.places[at], np.repeat(np.arange(len(rows)), many), np.repeat(1 / np.sqrt(np.maximum(many, 1)), many)

    def __add__(self, other: Grams) -> Grams:
        return Grams(np.concatenate([self.places, other.places]), np.concatenate([self.many, other.many]))


class _Codes(dict):
    """A number for each string, from its bytes."""

    def __missing__(self, text: str) -> int:
        self[text] = code = zlib.crc32(text.encode("utf-8", "surrogatepass"))
        return code


def _place(code: np.ndarray, kind: int) -> np.ndarray:
    h = (code + np.uint64(kind)) * _MULT
    return ((h ^ (h >> np.uint64(32))) * _MULT >> np.uint64(64 - DIMS.bit_length() + 1)).astype(np.int64)


def grams(answers: Sequence[list[str]], ends: Sequence[tuple[str, str, str]]) -> Grams:
    """Words, pairs of words, 5-grams of characters and whole short answers, and how each answer ends."""
    n = len(answers)
    size = np.array([len(b) for b in answers], dtype=np.int64)
    codes = _Codes()
    flat = np.array([codes[w] for b in answers for w in b], dtype=np.uint64)
    of = np.repeat(np.arange(n), size)
    found = [(of, _place(flat, 1))]
    if len(flat) > 1:
        near = of[1:] == of[:-1]
        found.append((of[1:][near], _place(flat[:-1] * _MULT + flat[1:], 2)[near]))
    lines = [" ".join(b) for b in answers]
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(n), [len(x) for x in lines])
    if len(chars) > 4:
        rolling = np.zeros(len(chars) - 4, np.uint64)
        for k in range(5):
            rolling = rolling * _MULT + chars[k : k + len(rolling)]
        near = owner[4:] == owner[:-4]
        found.append((owner[4:][near], _place(rolling, 3)[near]))
    short = np.flatnonzero((size > 0) & (size <= 4))
    found.append((short, _place(np.array([codes[lines[i]] for i in short], dtype=np.uint64), 4)))
    for kind, column in enumerate(zip(*ends) if n else (), 5):
        found.append((np.arange(n), _place(np.array([codes[x] for x in column], dtype=np.uint64), kind)))
    owner, places = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(owner, kind="stable")
    return Grams(places[order], np.bincount(owner, minlength=n))


def pair_features(hs: Sequence[str | None], ps: Sequence[str | None], filters: LanguageFilters) -> tuple[np.ndarray, Grams]:
    """(pairs x NUMERIC) features and the hashed n-grams of each answer."""
    hw, pw = [words(h) for h in hs], [words(p) for p in ps]
    hs_, ps_ = filters.scores([h or "" for h in hs])[0], filters.scores([p or "" for p in ps])[0]
    (hl, _), (pl, sure) = pick(hs_), pick(ps_)
    differ = (hl >= 0) & (pl >= 0) & (hl != pl)
    rows = np.arange(len(ps))
    margin = np.where(differ, (ps_[rows, pl] - ps_[rows, hl]) / (ps_.sum(axis=1) + 1e-9), 0.0) if len(ps) else np.zeros(0)
    facts, ends = [], []
    for i, (p, a, b) in enumerate(zip(ps, hw, pw)):
        text = fold_look(p).strip() if p else ""
        n = len(b)
        core = b[1:] if n > 1 and b[0] in _LABELS and (not a or b[0] != a[0]) else b
        have, own = set(a), set(core)
        nothing = n > 0 and n <= 4 and " ".join(b) in PLACEHOLDERS
        extra = len(core) - sum(map(have.__contains__, core))
        cover = len(have & own) / len(have) if have else 0.0
        asked = asked_languages(a)
        ended = bool(_CLOSE.search(text))
        listed = bool(_LIST.match(text))
        upper = text[:1].isupper() and not text.isupper()
        cue = not CUES.isdisjoint(own) or (n > 1 and not CUE_PAIRS.isdisjoint(map(" ".join, zip(b, b[1:]))))
        lettered = n - sum(map(str.isdigit, b))
        facts.append((lettered, n, nothing, extra, cover, len(core) / len(a) if a else 0.0, bool(asked), bool(differ[i]) and LANGS[pl[i]] in asked, ended, listed, upper, text.isupper(), cue))
        ends.append((text[-1:], text[-3:], f"{b[-1] if b else ''}|{ended}"))
    lettered, n, nothing, extra, cover, ratio, asked, wanted, ended, listed, upper, capitals, cue = (np.array(x, dtype=float) for x in zip(*facts)) if facts else [np.zeros(0)] * 13
    said = (n > 0) & (nothing == 0)
    strange = differ & (wanted == 0) & (lettered >= 3)  # fewer words have no language of their own
    still = said & (ended == 0) & (listed == 0)
    broken = still & ((n >= 4) | (n >= 2) & (upper > 0))
    same = said & (extra == 0)
    x = np.stack([
        np.ones(len(n)), n == 0, nothing, ~said, same, np.minimum(extra, 10) / 10, cover, np.minimum(ratio, 3) / 3, same & (np.minimum(cover, ratio) >= 0.75), said & (extra > 0),
        strange & said, strange & said & (sure >= 0.6), margin * strange, sure * strange, wanted, np.minimum(n, 60) / 60, ended, listed, upper,
        still & (n >= 4), still & (n >= 2) & (n < 4) & (upper > 0), broken, (ended > 0) & (n >= 4), n < 4, asked, capitals, cue, (cue > 0) & (n >= 3) & (listed == 0), n >= 3,
        still & (n == 1), still & (n < 4) & (upper == 0), n > 16, n > 24, (cue > 0) & (n > 16), (cue > 0) & (n > 24),
    ], 1).astype(float)
    return x, grams(pw, ends)


class PairClassifier:
    """Weights and thresholds of the five labels."""

    def __init__(self, filters: LanguageFilters):
        self.filters = filters
        self.dense = np.zeros((NUMERIC, len(DEFECTS)))
        for defect, place in CLOSEST.items():
            self.dense[[0, place], DEFECTS.index(defect)] = -PRIOR, 2 * PRIOR
        self.sparse = np.zeros((DIMS, len(DEFECTS)))
        self.thresholds = np.full(len(DEFECTS), 0.55)

    def _odds(self, x: np.ndarray, own: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        places, of, value = own
        z = x @ self.dense
        if len(places):  # every row has n-grams, its ends at least
            first = np.flatnonzero(np.diff(of, prepend=-1))
            z += np.add.reduceat(self.sparse[places], first, axis=0) * value[first, None]
        return z

    def probabilities(self, x: np.ndarray, own: Grams) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._odds(x, own.of(np.arange(len(x)))), -30, 30)))

    def fit(self, x: np.ndarray, own: Grams, y: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression in an order fixed by the seed, with steps that shrink for a weight as it has been moved.

        A row's n-grams have the norm 1, so a single row moves its own score
        little and what many rows share decides; the sample's hidden defective
        pairs are not learnt by heart.
        """
        rng = np.random.default_rng(SEED)
        moved, moved_sparse = np.full(self.dense.shape, 1e-6), np.full(self.sparse.shape, 1e-6)
        for _ in range(EPOCHS):
            for rows in np.array_split(rng.permutation(len(x)), max(len(x) // BATCH, 1)):
                places, of, value = part = own.of(rows)
                error = (1 / (1 + np.exp(-np.clip(self._odds(x[rows], part), -30, 30))) - y[rows]) * weight[rows] / len(rows)
                slope = x[rows].T @ error
                moved += slope**2
                self.dense -= RATE * slope / np.sqrt(moved)
                touched = np.flatnonzero(np.bincount(places, minlength=DIMS))
                slope = np.stack([np.bincount(places, weights=error[of, k] * value, minlength=DIMS)[touched] for k in range(len(DEFECTS))], 1)
                moved_sparse[touched] += slope**2
                self.sparse[touched] -= RATE * slope / np.sqrt(moved_sparse[touched])

    def calibrate(self, p: np.ndarray, y: np.ndarray, known: np.ndarray) -> None:
        """Thresholds between the two neighbouring held-out probabilities where F1 is best, ``SIDE`` of the way to the defective one; ``known`` leaves rows out."""
        for k in range(len(DEFECTS)):
            own = known[:, k]
            order = np.argsort(-p[own, k], kind="stable")
            probability, hit = p[own, k][order], np.cumsum(y[own, k][order])
            if not len(hit) or not hit[-1]:
                continue
            f1 = 2 * hit / (np.arange(1, len(hit) + 1) + hit[-1])
            best = np.flatnonzero(f1 >= f1.max() - 1e-12)
            odds = np.log(np.clip(probability, 1e-12, 1 - 1e-12) / np.clip(1 - probability, 1e-12, 1))
            low = odds[best[-1] + 1] if best[-1] + 1 < len(odds) else odds[best[-1]]
            self.thresholds[k] = 1 / (1 + np.exp(-(SIDE[k] * odds[best[-1]] + (1 - SIDE[k]) * low)))

    def label(self, hs: Sequence[str | None], ps: Sequence[str | None], statuses: Sequence[str | None]) -> list[str | None]:
        """The first defect of each pair, or None."""
        return [x for a in range(0, len(ps), ROWS) for x in self._label(hs[a : a + ROWS], ps[a : a + ROWS], statuses[a : a + ROWS])]

    def _label(self, hs: Sequence[str | None], ps: Sequence[str | None], statuses: Sequence[str | None]) -> list[str | None]:
        over = self.probabilities(*pair_features(hs, ps, self.filters)) >= self.thresholds
        # an answer that is still to come isn't missing
        waiting = np.array([(s or "").strip().lower() in ("pending", "skipped") for s in statuses], dtype=bool)
        first = np.where(over.any(axis=1), over.argmax(axis=1), len(DEFECTS))
        first[waiting & (first == 0)] = len(DEFECTS)
        return np.array([*DEFECTS, None], dtype=object)[first].tolist()


def _echo(h: str, rng: random.Random) -> str:
    return rng.choice([h, h, h.upper(), h.lower(), f'"{h}"', f"Question: {h}", f"{h} {h}", "  ".join(h.split(" ")), h.rstrip(".?! "), h.lower() + "..."])


def _refusal(rng: random.Random, topic: str) -> str:
    lang = rng.choice(["en", "en", *LANGS])
    form, *parts = rng.choice([d for d in _DECLINES[lang] for _ in range(len(d) ** 2)])
    core = form.format(*(rng.choice(part) for part in parts))
    if lang == "en" and rng.random() < 0.2:
        core = core.rstrip(".") + f" about {topic}." if rng.random() < 0.5 else f"I {rng.choice(_DECLINES['en'][0][1])} {rng.choice(['discuss', 'comment on', 'answer questions on'])} {topic}."
    text = " ".join(t for t in (rng.choice(_OPENERS[lang]), core, rng.choice(_CLOSERS[lang])) if t)
    text = text[:1].upper() + text[1:]
    return text.upper() if rng.random() < 0.08 else text.lower() if rng.random() < 0.08 else text


def synthetic(pairs: Sequence[tuple[str | None, str | None]], langs: np.ndarray, rng: random.Random) -> list[tuple[str | None, str | None, int]]:
    """Pairs made defective, each with the number of its defect, -1 for pairs that only look so and ``AS_IT_IS`` for sampled ones."""
    out: list[tuple[str | None, str | None, int]] = []
    by = {k: [(h, p) for (h, p), x in zip(pairs, langs) if x == k and p and len(words(p)) >= 5] for k in range(len(LANGS))}
    places = sorted(PLACEHOLDERS)
    for (h, p), lang in zip(pairs, langs):
        draw = rng.random()
        if draw < 0.35:
            blank = rng.choice([None, "", " ", "\n", "​", " ", ".", "...", "--", "-", "___", "?", rng.choice(places), rng.choice(places).upper(), f"[{rng.choice(places)}]", f"({rng.choice(places)})", rng.choice(places).replace(" ", "/")])
            out.append((h, blank, 0))
        if h and draw > 0.3:
            out.append((h, _echo(h, rng), 1))
        topic = " ".join((h or "the topic").split()[-4:]).rstrip(".?!")
        if draw < 0.85:
            out.append((h, _refusal(rng, topic), 2))
        if p and rng.random() < 0.1:
            out.append((h, f"{_refusal(rng, topic)} {p}", -1))
        others = [k for k in by if k != lang and by[k]]
        if h and lang >= 0 and others and draw > 0.4 and not asked_languages(words(h)):
            asked, other = rng.choice(by[rng.choice(others)])
            out += [(h, other, 3), (asked, other, AS_IT_IS)]  # the same words with and without the defect
        if p and len(words(p)) >= 5 and _CLOSE.search(p.strip()):
            text = p.strip()
            at = rng.randint(min(12, len(text) // 2), max(len(text) - 3, 1))
            piece = text[:at].rstrip() if rng.random() < 0.7 else text[:at]
            if not _END.search(piece) and len(words(piece)) >= 2:
                out.append((h, piece, 4))
    return out


def train_pairs(pairs: DataFrame, labelled: DataFrame) -> PairClassifier:
    """The classifier of a table (h, p); ``labelled`` has texts with a known language (p, source_lang, and translated in Tagalog).

    The sample is the ``MAX_TRAIN`` pairs of the least hashes.
    """
    rows = least_by_hash(labelled.where("p IS NOT NULL"), ["p", "translated", "source_lang"], MAX_TRAIN)
    known = [(r["p"], r["source_lang"]) for r in rows if r["source_lang"] in LANGS] + [(r["translated"], "tl") for r in rows if r["translated"]]
    sample = least_by_hash(pairs, ["h", "p"], MAX_TRAIN)
    return train_sample([(r["h"], r["p"]) for r in sample], known)


def train_sample(sample: Sequence[tuple[str | None, str | None]], known: Sequence[tuple[str, str]]) -> PairClassifier:
    texts, langs = [t for t, _ in known], [x for _, x in known]
    filters = LanguageFilters.fit(texts, langs).refit((texts, langs), [t for pair in sample for t in pair if t])
    rng = random.Random(SEED)
    model = PairClassifier(filters)
    if not sample:
        return model
    of = filters.decide([h or "" for h, _ in sample])[0]
    made = synthetic(sample, of, rng)
    if len(made) < BATCH:
        return model  # too few to fit anything: the prior decides, and no words are known to refuse
    y = np.zeros((len(made) + len(sample), len(DEFECTS)))
    for i, r in enumerate(made):
        if r[2] >= 0:
            y[i, r[2]] = 1
    x, own = pair_features([r[0] for r in made] + [h for h, _ in sample], [r[1] for r in made] + [p for _, p in sample], filters)
    held = np.array([rng.random() < 0.2 for _ in range(len(x))], dtype=bool)
    # a sampled answer may be a refusal wherever it stands: as it is, cut, or answering another question
    unsure = np.zeros(y.shape, bool)
    unsure[len(made) :] = True
    kinds = np.array([r[2] for r in made])
    unsure[np.flatnonzero((kinds == 3) | (kinds == 4)), DEFECTS.index("refusal")] = True
    unsure[np.flatnonzero(kinds == AS_IT_IS)] = [d != "language" for d in DEFECTS]
    some, half = unsure.any(axis=1), np.arange(len(x)) % 2
    doubtful = np.zeros(y.shape, bool)

    def fitted(rows: np.ndarray) -> PairClassifier:
        model = PairClassifier(filters)
        model.fit(x[rows], Grams(own.of(rows)[0], own.many[rows]), y[rows], np.where(unsure[rows], np.where(rows[:, None] < len(made), REUSED, UNLABELLED), 1.0) * ~doubtful[rows])
        return model

    for doubt in DOUBTS:
        for side in (0, 1):
            judge = fitted(np.flatnonzero(~some & ~held | some & (half == side)))
            judged = np.flatnonzero(some & (half != side))
            doubtful[judged] = unsure[judged] & (judge.probabilities(x[judged], Grams(own.of(judged)[0], own.many[judged])) >= doubt)
    model = fitted(np.flatnonzero(~held))
    rows = np.flatnonzero(held)
    model.calibrate(model.probabilities(x[rows], Grams(own.of(rows)[0], own.many[rows])), y[rows], ~doubtful[rows])
    return model


def defective_pairs(pairs: DataFrame, labelled: DataFrame, pair_id: str = "pair_id") -> DataFrame:
    """(pair_id, defect) of every defective pair of a table (pair_id, h, p, status)."""
    model = Shared(pairs.sparkSession, train_pairs(pairs, labelled))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame({"pair_id": pdf.iloc[:, 0], "defect": model.value.label(*(pdf[c].tolist() for c in ("h", "p", "status")))})
            yield out[out["defect"].notna()].astype({"pair_id": "int64"})

    return spread(pairs.select(pair_id, "h", "p", "status").where(F.col(pair_id).isNotNull())).mapInPandas(score, "pair_id bigint, defect string")
