"""Languages, leakage, endings and pairs on made-up texts."""

import random
import re

import numpy as np
import pytest

from deckweave.llm import endings, languages, leakage, pairs
from deckweave.llm.langid import LANGS, LanguageFilters, language_code

SENTENCES = {
    "en": ["The teacher explains how the river moves through the valley.", "Students often compare the two results before the next lesson.", "There is no way to tell whether the machine works."],
    "tl": ["Ipinapaliwanag ng guro kung paano gumagalaw ang ilog sa lambak.", "Inihahambing ng mga mag-aaral ang dalawang resulta bago ang aralin.", "Walang paraan para malaman kung gumagana ang makina."],
    "es": ["La maestra explica cómo se mueve el río por el valle.", "Los estudiantes comparan los dos resultados antes de la clase.", "No hay manera de saber si la máquina funciona."],
    "fr": ["La maîtresse explique comment la rivière traverse la vallée.", "Les élèves comparent les deux résultats avant le cours.", "Rien ne permet de savoir si la machine fonctionne."],
    "de": ["Die Lehrerin erklärt, wie der Fluss durch das Tal fließt.", "Die Schüler vergleichen die beiden Ergebnisse vor der Stunde.", "Niemand weiß, ob die Maschine richtig funktioniert."],
    "id": ["Guru menjelaskan bagaimana sungai mengalir melalui lembah.", "Para siswa membandingkan kedua hasil sebelum pelajaran.", "Tidak ada cara untuk mengetahui apakah mesin itu bekerja."],
}


def known():
    return [t for x in LANGS for t in SENTENCES[x]], [x for x in LANGS for _ in SENTENCES[x]]


def segments(spark):
    rows = [(i, t, SENTENCES["tl"][i % 3], x) for i, (t, x) in enumerate(zip(*known()))]
    return spark.createDataFrame(rows, "seg_id bigint, p string, translated string, source_lang string")


def test_language_codes():
    assert [language_code(x) for x in ("EN", "fil", "tl-PH", "English", "deu", "id_ID", "und", "", None, "unknown", "pt")] == ["en", "tl", "tl", "en", "de", "id", None, None, None, None, None]


def test_filters_know_their_sentences_and_say_nothing_of_numbers():
    f = LanguageFilters.fit(*known())
    best, sure = f.decide([*known()[0], "12 + 5 = 17", "", "zzzzqqq"])
    assert [LANGS[b] for b in best[:18]] == known()[1]
    assert list(best[18:20]) == [-1, -1] and (sure[:18] > 0.5).all()
    assert LANGS[f.decide(["I-check natin ang the machine works bago ang aralin ng mga mag-aaral"])[0][0]] == "tl"


def test_wrong_languages(spark):
    rows = []
    for doc, (main, label) in enumerate([("es", "es"), ("fr", "FRA"), ("de", None), ("id", "en"), ("tl", "fil"), ("en", "unknown")], 1):
        rows += [(doc, i, t, label) for i, t in enumerate(SENTENCES[main] * 2, 1)]
    rows += [(1, 7, SENTENCES["de"][0], "es"), (1, 7, SENTENCES["de"][0], "es"), (1, 8, "y = 5x + 2", "es"), (1, 9, None, "es"), (1, 10, " ", "es"), (9, 1, None, "en"), (10, 1, "123", None)]
    df = spark.createDataFrame(rows, "tdoc_id bigint, line_no int, p string, target_lang string")
    got = {(r["tdoc_id"], r["line_no"], r["lang"]) for r in languages.wrong_languages(df, segments(spark)).collect()}
    assert got == {(3, 0, "de"), (4, 0, "id"), (6, 0, "en"), (1, 7, "de")}
    assert languages.wrong_languages(df.where("false"), segments(spark)).count() == 0
    every = {(r["tdoc_id"], r["line_no"]): (r["lang"], r["confidence"]) for r in languages.all_languages(df, segments(spark)).collect()}
    assert {k: v[0] for k, v in every.items()} == {(1, 0): "es", (2, 0): "fr", (3, 0): "de", (4, 0): "id", (5, 0): "tl", (6, 0): "en", (1, 7): "de"}
    assert all(0 < v[1] <= 1 for v in every.values())


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        p = [rng.randint(1, 4) for _ in range(rng.randint(1, 90))]
        t = [rng.randint(1, 4) for _ in range(rng.randint(0, 60))]
        assert leakage.myers(p, t)[0] == distance(p, t)


def test_leaks(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    shared = "Read the passage and answer the question that follows."
    items = {i: [word() for _ in range(80)] for i in range(1, 6)}
    texts = {i: f"{shared} {' '.join(w)}." for i, w in items.items()} | {6: shared, 7: None, 8: ""}
    noise = [word() for _ in range(60)]
    damaged = [w if i % 9 else ("" if i % 18 else word()) for i, w in enumerate(items[1])]
    first, second = items[2][:25], items[2][50:75]
    docs = {
        1: " ".join(noise + items[1] + noise), 2: "<b>" + " ".join(damaged).upper() + "</b>\n", 3: " ".join(first + noise + second), 4: " ".join(items[3][:20]),
        5: shared, 6: None, 7: "", 8: " ".join(items[4]).replace("a", "а").replace(" ", " "), 9: " ".join(reversed(items[5])), 10: " ".join(noise * 400 + items[5]),
    }
    d = spark.createDataFrame([(k, v, "x") for k, v in docs.items()], "doc_id bigint, text string, item_id string")
    t = spark.createDataFrame(list(texts.items()), "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked_items(d, t).collect()}
    assert got == {(1, 1), (2, 1), (3, 2), (8, 4), (10, 5)}
    assert leakage.leaked_items(d, t.where("false")).count() == leakage.leaked_items(d.where("false"), t).count() == 0


def test_leaks_with_errors_up_to_the_verifiers_share():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    for n in (20, 56, 88, 120):
        items = {i: [rng.choice(vocabulary) for _ in range(n)] for i in range(40)}
        texts = []
        for words in items.values():
            passage = words[: n * 3 // 4]
            for at in range(3, len(passage) - 2, 5):  # a fifth replaced, 60 % of the item held
                passage[at] = rng.choice(vocabulary)
            texts.append(" ".join(rng.choices(vocabulary, k=70) + passage + rng.choices(vocabulary, k=70)))
        found = {(d, i) for d, i, _ in leakage.ItemIndex(items).leaks([leakage.words(t) for t in texts])}
        assert found == {(i, i) for i in items}, n


def test_items_of_every_length():
    rng = random.Random(11)
    for n in (1, 2, 4, 6, 8, 10, 11, 12, 16, 20, 23, 24, 40, 72, 130, 300):
        item = [f"w{rng.random()}"[:12].replace(".", "") + "x" for _ in range(n)]
        index, noise = leakage.ItemIndex({1: item}), ["zz"] * 40
        held = -(-n * 3 // 5)
        texts = [noise + item[a : a + held] + noise for a in range(n - held + 1)] + [noise + item[: n // 4 + 1] + noise + item[n - n // 4 - 1 :]]
        texts += [noise + item[: n // 2 - 2] + noise] if n > 8 else []
        assert {d for d, _, _ in index.leaks(texts)} == set(range(n - held + 2)), n


def test_items_in_many_blocks(spark):
    rng = random.Random(12)
    words = {i: [f"v{rng.randint(0, 99999)}" for _ in range(30)] for i in range(40)}
    t = spark.createDataFrame([(i, " ".join(w)) for i, w in words.items()] + [(0, " ".join(words[0])), (None, "x y z")], "item_id bigint, text string")
    d = spark.createDataFrame([(i, "before " + " ".join(w[5:25]) + " after") for i, w in words.items()], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in leakage.leaked_items(d, t, block=7).collect())
    assert got == [(i, i) for i in range(40)]


def test_best_two_of_all_passages():
    rng = random.Random(8)
    for _ in range(300):
        passages = []
        for _ in range(rng.randint(0, 14)):
            start, size = rng.randint(0, 40), rng.randint(1, 12)
            passages.append((start, start + size, rng.randint(1, size), rng.randint(0, 60)))
        pairs = [a[2] + b[2] for a in passages for b in passages if a[0] < b[0] and a[1] <= b[0] + 2 and a[3] <= b[3]]
        assert leakage.best_two(passages) == max([p[2] for p in passages] + pairs, default=0)
    words = [f"w{i}" for i in range(100)]
    other = [f"x{i}" for i in range(40)]
    text = " ".join(sum(([*words[:40], *other] for _ in range(7)), []) + words[60:75])
    assert [(d, i) for d, i, _ in leakage.ItemIndex({1: words}).leaks([leakage.words(text)])] == [(0, 1)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    nouns, verbs = "river valley machine teacher lesson result market letter garden window".split(), "moves changes explains limits follows measures".split()
    sentence = lambda: f"The {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)} before the {rng.choice(nouns)} is known."
    out = []
    for i in range(500):
        text = " ".join(sentence() for _ in range(6))
        kind = i % 5
        if kind == 0:
            whole = text + "\nBack to the module list"
        elif kind == 1:
            whole = text + f"\n- {rng.choice(nouns)} {rng.randint(2, 99)}\n- {rng.choice(nouns)} {rng.randint(2, 99)}"
        elif kind == 2:
            whole = text[: rng.randint(100, len(text) - 8)].rstrip(". ") + rng.choice(["", "…", " <", "\n", "&am"])
        else:
            whole = text + rng.choice(["", "\n", "  "])
        out.append((i, whole, "en", "a" if i % 2 else None, kind == 2))
    return out


def test_endings(spark, corpus):
    rows = [c[:4] for c in corpus] + [(900, None, "en", "a"), (901, "", None, "a"), (902, " \n", "en", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r["doc_id"]: r["cut"] for r in endings.score_endings(df, keep=["source"]).collect()}
    assert set(got) == {c[0] for c in corpus}
    truth = {c[0] for c in corpus if c[4]}
    found = {k for k, v in got.items() if v}
    assert len(found & truth) >= 0.95 * len(truth) and len(found - truth) <= 0.03 * len(found)
    assert endings.score_endings(df.where("false")).count() == 0


def test_context_counts_against_brute_force():
    rng = random.Random(3)
    text = lambda: "\n".join("".join(rng.choice("ab .)") for _ in range(rng.randint(0, 30))).strip() for _ in range(3))
    texts = [endings.clean(text()).rstrip() for _ in range(60)]
    counts = endings.Counts(endings.Filter(None))
    counts.add(texts, [0] * len(texts))
    got = {(int(k), int(h)): (int(e), int(m)) for k, h, e, m in zip(*counts.rows())}
    lines, ends = [], []  # every counted place as the end of a line that stops there
    for t in texts:
        full = endings._PAD + t
        stops = {m.end() - 1 for m in re.finditer(r"[.!?:]+[\"'’”»)\]]*(?=\s)", full + "\n")}
        for i, c in enumerate(full[:-1]):
            if c != "\n":
                line = full[full.rfind("\n", 0, i) + 1 : full.find("\n", i) if "\n" in full[i:] else len(full)]
                words = full[full.rfind("\n", 0, i) + 1 : i + 1].count(" ")
                long = words >= 6 or any(full.rfind("\n", 0, i) < s < i and not full[s + 1 : i + 1].count("\n") and s + 1 <= i for s in stops)
                ends.append(i in stops or (full[i + 1] == "\n" and not long))
                lines.append((full[: i + 1], line))
    bare = {}
    for (upto, _), end in zip(lines, ends):
        for n in endings.BARE:
            one = bare.setdefault((endings.BARE.index(n), upto[-n:]), [0, 0])
            one[0 if end else 1] += 1
    for (k, context), want in bare.items():
        chars = np.frombuffer(context[::-1].encode("utf-32-le"), np.uint32).astype(np.uint64)
        rolling = (chars * endings._POWERS[: len(chars)]).sum(dtype=np.uint64)
        assert got[k, int(endings.context_hash(np.array([rolling]), endings.BARE[k], None)[0])] == tuple(want)
    assert sum(v[0] + v[1] for (k, _), v in got.items() if k == len(endings.BARE)) == len(lines)  # each place has one kind


def test_endings_of_two_columns(spark, corpus):
    rows = [(c[0], c[1], "en", c[1][:40] if c[4] else "The river explains the lesson.") for c in corpus]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, title string")
    got = {(r["doc_id"], r["column"]): r["cut"] for r in endings.score_endings(df, text=["text", "title"]).collect()}
    alone = {r["doc_id"]: r["cut"] for r in endings.score_endings(df).collect()}
    assert {k: v for (k, c), v in got.items() if c == "text"} == alone
    assert {c for _, c in got} == {"text", "title"}


def test_defective_pairs_on_held_out_kinds(spark):
    rng = random.Random(8)
    rows = []
    for i in range(900):
        lang = rng.choice(LANGS)
        h = {"en": "How does the {} change?", "tl": "Paano nagbabago ang {}?", "es": "¿Cómo cambia el {}?", "fr": "Comment le {} change-t-il ?", "de": "Wie ändert sich der {} in der Stunde?", "id": "Bagaimana {} berubah?"}[lang].format(rng.choice(["motor", "sistema", "metro", "radio", "piano"]))
        p = " ".join(rng.choice(SENTENCES[lang]) for _ in range(rng.randint(1, 3)))
        rows.append((i, h, p, "translated"))
    bad = [
        (1000, "How does it work?", None, "translated", "empty"), (1001, "How does it work?", "N/A", "failed", "empty"), (1002, "How?", "​", None, "empty"), (1003, "How?", None, " Pending ", None),
        (1004, "How does the motor change?", "HOW DOES THE MOTOR CHANGE?", "translated", "copy"), (1005, "How does the motor change?", "Q: How  does the motоr change", "translated", "copy"),
        (1006, "How does the motor change?", "Sorry, I cannot answer this question. Please ask your teacher.", "pending", "refusal"), (1007, "How does the motor change?", SENTENCES["de"][0] + " " + SENTENCES["de"][1], "translated", "language"),
        (1008, "How does the motor change?", "The teacher explains how the river mo", "translated", "truncated"), (1009, "How does the motor change?", "27 kg", "translated", None), (1010, "List two.", "1. motor\n2. radio", "translated", None),
        (1011, None, "The teacher explains how the river moves through the valley.", None, None), (1012, "Translate into German: The machine works.", SENTENCES["de"][0], "translated", None),
    ]
    df = spark.createDataFrame(rows + [b[:4] for b in bad], "pair_id bigint, h string, p string, status string")
    got = {r["pair_id"]: r["defect"] for r in pairs.defective_pairs(df, segments(spark)).collect()}
    assert {b[0]: got.get(b[0]) for b in bad} == {b[0]: b[4] for b in bad}
    assert sum(k < 1000 for k in got) <= 5
    assert pairs.defective_pairs(df.where("false"), segments(spark)).count() == 0


# Refusals of which no wording is among the parts that training puts together.
HELD_OUT = {
    "en": ["That's not a subject I'm prepared to get into.", "I'm going to have to pass on this one.", "My instructions forbid me from replying to that.", "Sadly I lack the authority to say more on the matter.", "We do not reply to inquiries of this sort.", "Regrettably, your query falls beyond my remit.", "I shall refrain from giving a reply.", "I can't go into that, sorry."],
    "es": ["No me corresponde contestar algo así.", "Me temo que no podré ayudarte con ello.", "Eso queda fuera de lo que puedo tratar.", "No tengo autorización para dar esa información."],
    "fr": ["Je ne suis pas autorisé à traiter ce genre de demande.", "Navré, ceci dépasse ce que je peux faire.", "Il ne m'appartient pas de répondre.", "Je ne pourrai pas vous renseigner là-dessus."],
    "de": ["Darüber darf ich leider keine Auskunft geben.", "Ich bin nicht befugt, darauf einzugehen.", "Hierzu äußere ich mich nicht.", "Ich werde diese Frage nicht beantworten."],
    "id": ["Saya tidak berwenang menanggapi hal tersebut.", "Mohon maaf, saya belum bisa menanggapi.", "Itu di luar wewenang saya.", "Saya tidak akan menjawab permintaan itu."],
    "tl": ["Hindi ko po maaaring talakayin iyan.", "Patawad, wala akong kakayahang tumugon.", "Hindi ko na po sasagutin iyan.", "Hindi po ako makapagbibigay ng tulong diyan."],
}


def test_refusals_in_wordings_never_trained():
    rng = random.Random(8)
    ask = {"en": "How does the {} change?", "tl": "Paano nagbabago ang {}?", "es": "¿Cómo cambia el {}?", "fr": "Comment le {} change-t-il ?", "de": "Wie ändert sich der {} in der Stunde?", "id": "Bagaimana {} berubah?"}
    langs = [rng.choice(LANGS) for _ in range(1500)]
    sample = [(ask[x].format(rng.choice(["motor", "sistema", "metro"])), " ".join(rng.choice(SENTENCES[x]) for _ in range(rng.randint(1, 3)))) for x in langs]
    known = [(t, x) for x, ts in SENTENCES.items() for t in ts] + [(q, x) for x, q in ask.items()]
    model = pairs.train_sample(sample, known)
    rows = [(ask[x].format("motor"), t) for x, ts in HELD_OUT.items() for t in ts]
    found = model.label([h for h, _ in rows], [p for _, p in rows], [None] * len(rows))
    assert found.count("refusal") >= 0.7 * len(rows)
    assert model.label([h for h, _ in sample], [p for _, p in sample], [None] * len(sample)).count("refusal") == 0
    assert all(0.02 < t < 0.98 for t in model.thresholds)


def test_long_texts_null_ids_and_clashing_names(spark):
    big = 2**60 + 1
    long = " ".join(SENTENCES["fr"] * 6000)
    rows = [(big, 1, long, None, "x", 1), (big, 2, SENTENCES["fr"][0], None, "x", 1), (None, 1, SENTENCES["fr"][0], None, "x", 1), (3, None, SENTENCES["es"][0], "es", "x", 1)]
    df = spark.createDataFrame(rows, "tdoc_id bigint, line_no int, p string, target_lang string, lang string, size int")
    assert {tuple(r)[:3] for r in languages.wrong_languages(df, segments(spark)).collect()} == {(big, 0, "fr")}
    rows = [(i, "The river moves through the valley. " * 3 + "Done.", None, "s", 1, True) for i in range(50)] + [(big, "word and " * 40_000 + "wor", "en", "s", 1, True), (None, "text.", "en", "s", 1, True)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, log_odds int, cut boolean")
    got = {r["doc_id"]: r["cut"] for r in endings.score_endings(df).collect()}
    assert set(got) == {*range(50), big} and not got[0]
    rows = [(big, "How does the motor change?", SENTENCES["en"][0] * 3000, None, "x"), (None, "How?", None, None, "x"), (5, None, None, None, "x")]
    df = spark.createDataFrame(rows, "pair_id bigint, h string, p string, status string, defect string")
    assert {tuple(r) for r in pairs.defective_pairs(df, segments(spark)).collect()} == {(5, "empty")}
