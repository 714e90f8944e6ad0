"""Whole-document backends: every outcome, and what their documents hold."""

import json

from deckweave.operators import documents

SCHEMA = f"key bigint, meta struct<title:string>, pages {documents.PAGES}, path string, status string"
ROWS = [
    (1, ("one",), [(1, [("Head", None, 1), (None, "text", None)]), (3, [])], "a/b.json", "x"), (1, ("one",), [(1, [("Head", None, 1), (None, "text", None)]), (3, [])], "a/b.json", "x"),
    (2, None, None, None, "x"), (3, ("three",), [(1, None), None], "c.json", "x"), (4, ("four",), [(1, [(None, "z", None)])], "d.json", "x"), (None, ("five",), [(1, [(None, "z", None)])], "e.json", "x"),
]


def test_identity_and_manual(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert {r["status"] for r in documents.identity_documents(df, "key").collect()} == {"skipped"}
    siblings = spark.createDataFrame([("a/b.tl.json", '{"pages": []}'), ("c.tl.json", "{")], "path string, raw string")
    got = [(r["key"], r["status"], r["translated"]) for r in documents.manual_documents(df, siblings, "key", "path", "tl").collect()]
    assert sorted(got, key=str) == sorted([(1, "translated", '{"pages": []}')] * 2 + [(2, "failed", None), (3, "failed", None), (4, "pending", None), (None, "pending", None)], key=str)


def test_called_documents(spark):
    def answer(prompt: str) -> str:
        source = json.loads(prompt[prompt.index("{") :])
        pages = source.get("pages") or []
        if source.get("meta", {}).get("title") == "four":
            raise RuntimeError("no connection")
        for page in pages:
            for line in (page or {}).get("lines") or []:
                line.update({k: line[k].upper() for k in ("h", "p") if k in line})
        return "```json\n" + json.dumps({"pages": pages}) + "\n```"

    df = spark.createDataFrame(ROWS, SCHEMA)
    got = documents.called_documents(df, "key", answer, "tl", attempts=1).collect()
    assert len(got) == len(ROWS)
    by = {r["key"]: r for r in got}
    assert {k: r["status"] for k, r in by.items()} == {1: "translated", 2: "translated", 3: "translated", 4: "failed", None: "translated"}
    assert by[4]["reason"] == "call failed: no connection"
    document = json.loads(by[1]["translated"])
    assert document["pages"][0]["lines"] == [{"h": "HEAD", "c": 1}, {"p": "TEXT"}] and document["meta"]["title"] == "one" and document["meta"]["target_lang"] == "tl"
    bad = documents.called_documents(df.where("key = 1"), "key", lambda p: '{"pages": [{"n": 1, "lines": [{"p": "a"}, {"p": "b"}]}, {"n": 3, "lines": []}]}', "tl", attempts=1).first()
    assert (bad["status"], bad["reason"]) == ("failed", "reply has another structure")
    assert documents.called_documents(df.where("false"), "key", answer, "tl").count() == 0


def test_pages_one_by_one_where_a_reply_is_no_object(spark):
    df = spark.createDataFrame([(1, {"PAGE 1": "a", "PAGE 2": "b"}), (2, {"PAGE 1": "c"}), (3, {}), (4, None)], "doc int, pages map<string,string>")

    def answer(prompt: str) -> str | None:
        if "{" not in prompt:
            return None if prompt == "b" else prompt * 2
        return "sorry" if '"a"' in prompt else '{"PAGE 1": "C", "PAGE 9": "x"}'

    got = {r["doc"]: r["pages"] for r in documents.page_map_translation(df, "doc", "pages", answer, "tl", attempts=1).collect()}
    assert got == {1: {"PAGE 1": "aa", "PAGE 2": "b"}, 2: {"PAGE 1": "C"}, 3: {}, 4: None}
