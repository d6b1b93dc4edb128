"""Text functions and filters on small cases, nulls included."""

import pytest
from pyspark.sql import functions as F

from loclake.functions import predicates as P
from loclake.functions import text as X
from loclake.plans import text_queries


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_protect_and_restore(spark):
    texts = ["[player] {color=#fff}Kaz{{q}}{/color}", "?V000? ve ⟦V000⟧", "plain", "", None, "x" * 20_000 + "[a]"]
    x = F.col("x")
    got = values(spark, [(t,) for t in texts], "x string", X.protect(x), X.restore(X.protect(x), X.mask_keys(x), X.tokens(x)))
    assert got[0][0] == "XRPYXVAR0XRPYX XRPYXTAG1XRPYXKazXRPYXESC2XRPYXqXRPYXESC3XRPYXXRPYXTAG4XRPYX"
    assert [b for _, b in got] == texts


def test_preserve(spark):
    m = X.preserve(F.col("x"))
    got = values(spark, [("Hi [name!t] {b}%(n)s{/b}{#note}",), ("[a] [a]",), (None,), ("",)], "x string", m["text"], m["keys"], m["tokens"])
    assert got[0][0] == "Hi ⟦VT001⟧ ⟦T002⟧⟦F004⟧⟦T003⟧⟦D000⟧"
    assert got[1][0] == "⟦V000⟧ ⟦V001⟧" and got[1][2] == ["[a]", "[a]"]
    assert got[2][0] is None and got[3] == ("", [], [])


def test_pseudo(spark):
    got = values(spark, [("Hello [you]",), ("[a]",), ("  ",), (None,)], "x string", X.pseudo(F.col("x")), X.pseudo(F.col("x"), "accent"), X.pseudo(F.col("x"), "expand"))
    assert got[0] == ("[!!! Héllõ  !!!][you]", "Héllõ [you]", "[!!! Hello  !!!][you]")
    assert [g[0] for g in got[1:]] == ["[a]", "  ", None]


def test_ids(spark):
    import hashlib

    got = values(spark, [("a\\b.rpy", 3, ["x", "y"], '"He\r\nllo"'), ("p", 1, None, "é")], "f string, n int, c array<string>, x string", X.translation_id(F.col("f"), F.col("n"), F.col("c"), F.col("x")))
    assert got[0][0] == "id_" + hashlib.sha1(b"a/b.rpy|3|x|y|He\nllo").hexdigest()[:16]
    assert got[1][0] == "id_" + hashlib.sha1("p|1||Ã©".encode()).hexdigest()[:16]
    ids = values(spark, [("Hello, World!",), ("1st",), ("---",), ("x" * 80,)], "x string", X.sanitize_id(F.col("x")))
    assert [i[0] for i in ids] == ["Hello_World", "_1st", "translated_text", "x" * 50]


@pytest.mark.parametrize(
    "text, meaningful, skip",
    [("Hello there", True, False), ("config.version = 1.0", True, True), ("images/a.png", False, True), ("[name]", False, True), ("{}", False, True), ("snake_case", False, True), ("Items", False, False), ("#ff0000", False, True), ("42", False, True), ("左へ", True, False), ("", False, True), (None, False, True), ("v1.2.3", True, True), ("true", False, True), ("History", True, False)],
)
def test_filters(spark, text, meaningful, skip):
    assert values(spark, [(text,)], "x string", P.is_meaningful(F.col("x")), P.should_skip(F.col("x")))[0][1] == skip
    if text not in ("config.version = 1.0", "v1.2.3"):
        assert values(spark, [(text,)], "x string", P.is_meaningful(F.col("x")))[0][0] == meaningful


def test_keyed_values(spark):
    rows = [("Sword", "name"), ("Sword", "id"), ("12", "title"), ("Sword", None), ("a.png", None), (None, "name"), ("Sword", "other")]
    assert [r[0] for r in values(spark, rows, "v string, k string", P.meaningful_value(F.col("v"), F.col("k")))] == [True, False, False, True, False, False, False]


def test_text_type(spark):
    rows = [(["menu"], ""), (["label:a"], "screen x"), (None, 'textbutton "x"'), ([], 'renpy.notify("x")'), (None, None)]
    assert [r[0] for r in values(spark, rows, "c array<string>, l string", P.text_type_of(F.col("c"), F.col("l")))] == ["menu", "dialogue", "button", "notify", "dialogue"]


def test_keep_case(spark):
    got = values(spark, [("KEY",), ("Key",), ("key",)], "s string", X.keep_case(F.col("s"), F.lit("schlüssel")))
    assert [g[0] for g in got] == ["SCHLÜSSEL", "Schlüssel", "schlüssel"]


def test_ids_and_versions_of_all_rows(spark, tmp_path):
    import hashlib

    texts = {"plain": "plain", "é": "Ã©", 'say \\"hi\\"\\n': 'say "hi"\n', "'\\u00e9\\x41'": "éA", "ends é\\": "ends é\\", "\\ud800x": "x", '"': "", None: ""}
    rows = [(i, "a\\b.rpy", 3, ["x"], k) for i, k in enumerate(texts)]
    spark.createDataFrame(rows, "tl_id long, file_path string, line_number int, context_path array<string>, original_text string").write.parquet(str(tmp_path / "tl_entries.parquet"))
    got = {r["tl_id"]: r["id"] for r in text_queries.QUERIES["translation_id"](spark, str(tmp_path)).collect()}
    assert got == {i: "id_" + hashlib.sha1(f"a/b.rpy|3|x|{v}".encode()).hexdigest()[:16] for i, v in enumerate(texts.values())}
    docs = [(1, "# v1.02 " + "x" * 300 + " 7 and 12345678901"), (2, "# none"), (3, "no title 5"), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["version"] for r in text_queries.QUERIES["version_numbers"](spark, str(tmp_path)).collect()}
    assert got == {1: "1.2.7.12345678901", 2: ""}
