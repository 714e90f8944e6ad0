"""Look-alikes, repeats, pieces and tokens against brute force."""

import itertools
import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deckweave.llm import lookalike, pieces, repeats, tokens


def forms(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", lookalike.look_form("v").alias("f")).orderBy("i").select("f").collect()]


SAME = [("café", "café"), ("fin", "ﬁn"), ("A b", "Ａ b"), ("scope", "ѕсоре"), ("word", "​wo­rd﻿"), ("Å", "Å"), ("é", "е́"), ("a-b", "a‑b")]
DIFFERENT = [("a", "A"), ("cafe", "café"), ("x2", "x²"), ("a b", "a  b"), ("ab", "a b"), ("o", "0")]


def test_look_form_and_its_twin(spark):
    values = [x for pair in SAME + DIFFERENT for x in pair] + ["", " ", "\r\n", "👩‍🔬", "x" * 100_000 + "é"]
    got = forms(spark, values + [None])
    assert got[-1] is None
    assert got[:-1] == [lookalike.fold_look(v) for v in values]
    for a, b in SAME:
        assert lookalike.fold_look(a) == lookalike.fold_look(b)
    for a, b in DIFFERENT:
        assert lookalike.fold_look(a) != lookalike.fold_look(b)


def test_look_pairs_brute_force(spark):
    rows = [(i, v) for i, v in enumerate([*itertools.chain(*SAME), *itertools.chain(*DIFFERENT), "café", "café", None, "", " ", "​", "co\x07op", "coop"])]
    df = spark.createDataFrame([(k, v, "extra", "extra") for k, v in rows], "id bigint, v string, value string, look string")
    got = {tuple(r) for r in lookalike.look_pairs(df, "id", "v").collect()}
    look = lambda v: "".join(c for c in lookalike.fold_look(v) if unicodedata.category(c) != "Cc")
    real = [(k, v) for k, v in rows if v and lookalike.fold_look(v).strip()]
    assert got == {(a, b) for a, x in real for b, y in real if a < b and x != y and look(x) == look(y)}
    assert lookalike.look_pairs(df.where("false"), "id", "v").count() == 0


def test_look_matches_keep_plain_rows_of_odd_references(spark):
    ref = spark.createDataFrame([(1, "café"), (2, "ﬁn"), (3, None)], "seg_id bigint, p string")
    lines = spark.createDataFrame([(10, "café"), (11, "café"), (12, "fin"), (13, "ﬁn"), (14, None), (15, "other")], "line_id bigint, p string")
    assert {tuple(r) for r in lookalike.look_matches(ref, "seg_id", "p", lines, "line_id", "p").collect()} == {(1, 10), (2, 12)}


def test_canonical_member_is_plain_and_deterministic(spark):
    df = lookalike.with_look(spark.createDataFrame([("ﬁn",), ("fin",), ("f​in",), ("é",), ("é",)], "value string"), "value")
    assert {r["value"]: r["canonical"] for r in lookalike.canonical_members(df).collect()} == {"ﬁn": "fin", "fin": "fin", "f​in": "fin", "é": "é", "é": "é"}


def brute_repeats(rows):
    import re

    def key(p):
        x = re.sub(r"\s+", "", re.sub("[0-9]+", "0", lookalike.fold_look(p).lower().replace("ß", "ss")))
        return x if any(c.isalpha() for c in x) else None

    size, where = {}, {}
    for _, source, module, p in rows:
        if source is not None and module is not None:
            size.setdefault(source, set()).add(module)
            if p is not None and key(p):
                where.setdefault((source, key(p)), set()).add(module)
    return {i for i, s, m, p in rows if s is not None and m is not None and p is not None and key(p) and len(where[s, key(p)]) >= 3 and 5 * len(where[s, key(p)]) >= len(size[s])}


def test_canonical_lines_keep_every_row(spark, tmp_path):
    from deckweave.llm import queries

    lines = [(1, "p\u0430ge"), (2, "page"), (3, None), (4, " "), (5, "d\u0430y"), (6, "night")]
    spark.createDataFrame(lines, "line_id bigint, p string").write.parquet(f"{tmp_path}/page_lines.parquet")
    spark.createDataFrame([(1, "day")], "seg_id bigint, p string").write.parquet(f"{tmp_path}/segment_dictionary.parquet")
    spark.createDataFrame(lines, "node_id bigint, description string").write.parquet(f"{tmp_path}/course_nodes.parquet")
    run = lambda name: {r[0]: r[1] for r in queries.queries()[name](spark, str(tmp_path)).collect()}
    own = {1: "page", 2: "page", 3: None, 4: " ", 5: "day", 6: "night"}
    assert run("p3_canonical_lines") == own
    assert run("p3_canonical") == own | {5: "d\u0430y"}


def test_repeated_lines_brute_force(spark):
    rng = random.Random(4)
    lines = ["Page 3 of 10", "PAGE 14 OF 2", "Ｐage  3 of 10", "pаge 9 of 9", "Share this", "share this", "Straße 1", "STRASSE 22", "only here", "...", "12", "", " ", None, "•"]
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([*range(1, 130, 7), 5_000_000_000, None]), rng.choice(lines) if rng.random() < 0.6 else f"text {'xyz'[i % 3]}{rng.randint(0, 500)}q{rng.choice('abcdefghij')}") for i in range(900)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "line_id bigint, source string, module_key bigint, p string, c int")
    assert {r[0] for r in repeats.repeated_lines(df).select("line_id").collect()} == brute_repeats(rows) != set()
    assert repeats.without_repeated_lines(df).count() == len(rows) - len(brute_repeats(rows))
    assert repeats.repeated_lines(df.where("false")).count() == 0


UNITS = ["word ", "A sentence. ", "line\n", "नी", "👩‍🔬", "é", "x" * 90, " ", "\n\n", "ok? ", "“Done.” "]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(UNITS), min_size=1, max_size=400))
def test_cut_range_properties(units):
    text = "".join(units)
    got = pieces.cut_range(text, 0, len(text), 120, 30, True)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(0 < b - a <= 120 for a, b in got)
    for (a, b), (c, e) in itertools.pairwise(got):
        assert a < c <= b < e and b - c <= 30
    assert text == "".join(text[(got[k - 1][1] if k else 0) : b] for k, (_, b) in enumerate(got))
    for _, b in got[:-1]:
        assert not unicodedata.combining(text[b]) and text[b] != "‍"


def test_cuts_prefer_lines_then_sentences_then_words():
    text = "aaa bbb ccc.\nddd eee. fff ggg hhh iii"
    assert [text[a:b] for a, b in pieces.cut_range(text, 0, len(text), 20, 0, True)][0] == "aaa bbb ccc.\n"
    text = text[13:]
    assert [text[a:b] for a, b in pieces.cut_range(text, 0, len(text), 12, 0, True)] == ["ddd eee. ", "fff ggg hhh ", "iii"]


def test_split_items_over_many_ranges(spark):
    rng = random.Random(3)
    long = "".join(rng.choice(UNITS) for _ in range(3000))
    rows = [(2**60 + 1, long), (2, "short"), (3, ""), (4, None), (5, "नी" * 2000), (6, "z" * 5000), (None, "word " * 900)]
    df = spark.createDataFrame([(k, v, 7, 8) for k, v in rows], "start bigint, text string, size int, ranges int")
    got = pieces.split_items(df, ["start"], "text", 120, 30, 1024).toDF("key", "piece_no", "start", "end", "piece").orderBy("key", "piece_no").collect()
    for key, text in rows:
        own = [r for r in got if r["key"] == key]
        assert [r["piece_no"] for r in own] == list(range(1, len(own) + 1))
        at = 0
        for r in own:
            assert r["piece"] == text[r["start"] : r["end"]] and len(r["piece"]) <= 120 and at - 30 <= r["start"] <= at < r["end"]
            at = r["end"]
        assert at == len(text or "")


def test_split_files_by_byte_ranges(spark, tmp_path):
    rng = random.Random(5)
    text = "".join(rng.choice(UNITS) for _ in range(6000))
    (tmp_path / "big.txt").write_bytes(text.encode())
    got = pieces.split_files(spark, str(tmp_path), 120, 30, 8192).orderBy("piece_no").collect()
    raw, at = text.encode(), 0
    assert len({r["piece_no"] for r in got}) == len(got) > 50
    for r in got:
        assert raw[r["start"] : r["end"]].decode() == r["piece"] and len(r["piece"]) <= 120 and r["start"] <= at < r["end"]
        at = r["end"]
    assert at == len(raw)


def test_letters_of_fonts_and_other_scripts(spark):
    texts = ["𝐀𝒷𝟗 ℎello", "ραγι", "հոս", "plain", "x²"]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    got = [r[0] for r in df.select(lookalike.look_form("value")).collect()]
    assert got == [lookalike.fold_look(t) for t in texts] == ["Ab9 hello", "payi", "hnu", "plain", "x²"]


def test_bytes_of_a_file_that_are_no_text_keep_their_place(spark, tmp_path):
    rng = random.Random(9)
    raw = b"".join(rng.choice([b"word ", b"\xff\xfe", "नी".encode(), b"\x80\x80 ", b"Done.\n"]) for _ in range(9000))
    (tmp_path / "odd.txt").write_bytes(raw)
    got = pieces.split_files(spark, str(tmp_path), 120, 30, 8192).orderBy("piece_no").collect()
    at = 0
    for r in got:
        assert r["start"] <= at < r["end"] and raw[r["start"] : r["end"]].decode("utf-8", "replace") == r["piece"]
        at = r["end"]
    assert at == len(raw)


def test_pages_count_lines_without_text(spark):
    df = spark.createDataFrame([(1, [(1, [("h", None, 1), (None, None, None), (None, "p", 2), None]), (2, None), (3, []), None]), (2, None)], "page_doc_id bigint, pages array<struct<n:int,lines:array<struct<h:string,p:string,c:int>>>>")
    assert {(r["page_doc_id"], r["n"]): r["text"] for r in pieces.pages(df).collect()} == {(1, 1): "h\n\np\n", (1, 2): "", (1, 3): ""}


MIXED = ["a", "b", " ", "  ", "\n", "'s", "'", "1", "23", "é", "नी", "👩‍🔬", ".", "!", "ß", "the", " word", "\t", "’", "﻿", "²", "Ⅻ", "\u0085", "_", "​", "<|endoftext|>"]


@pytest.fixture(scope="module")
def encoders():
    ranks = tokens.read_ranks()
    return tokens.TreeEncoder(ranks, leaf=8), tokens.TreeEncoder(ranks)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(MIXED), max_size=120))
def test_tree_equals_whole(encoders, parts):
    small, whole = encoders
    text = "".join(parts)
    assert small.encode(text) == whole.encoding.encode_ordinary(text)
    assert small.decode(small.encode(text)) == text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_tree_equals_whole_on_any_text(encoders, text):
    small, whole = encoders
    assert small.encode(text) == whole.encoding.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(MIXED), max_size=120), st.integers(4, 40))
def test_stitched_parts_equal_whole(encoders, pieces_of_text, part):
    small, whole = encoders
    text = "".join(pieces_of_text)
    raw = text.encode()
    chunks = [tokens.own_text(raw[a : a + part + 3], part, a == 0) for a in range(0, len(raw), part)]
    assert "".join(chunks) == text
    assert small.stitch([small.part(c) for c in chunks]) == whole.encoding.encode_ordinary(text)


def test_encode_table_with_long_texts(spark):
    encoder = tokens.TreeEncoder(tokens.read_ranks())
    texts = ["hello", "", None, "Ein Satz. नी 12 " * 2000, "x" * 9000, "Ein Satz. नी 12 " * 2000, "é" * 4097]
    df = spark.createDataFrame([(i if i != 5 else 3, t, 1, "k") for i, t in enumerate(texts)] + [(None, "y z " * 3000, 1, "k")], "i int, text string, part_no int, key string")
    got = sorted(((r["i"], r["ids"]) for r in tokens.encode_table(df, "i", "text").collect()), key=str)
    want = [(i if i != 5 else 3, encoder.encoding.encode_ordinary(t) if t else []) for i, t in enumerate(texts)] + [(None, encoder.encoding.encode_ordinary("y z " * 3000))]
    assert got == sorted(want, key=str)
    assert tokens.encode_table(df.where("false"), "i", "text").count() == 0


def test_token_ids_column(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(f"{tokens.FOLDER}/byte_bpe_50k.json")
    whole.encode_special_tokens = True
    texts = ["hello world", "", None, "  ", "<|endoftext|>", "long " * 3000, "x" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["ids"] for r in df.select("i", tokens.token_ids(df, "text").alias("ids")).collect()}
    assert got == {i: whole.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(texts)}
