"""Sources, sinks and streams on files made here."""

import io
import pickle
import struct
import sys
import types
import zlib

import pytest
from pyspark.sql import functions as F

from loclake.sources import binary, sinks, text
from loclake.streaming import metrics as stream


def test_files_and_decoding(spark, tmp_path):
    (tmp_path / "a.rpy").write_bytes("﻿label x:\r\n    \"Grüße\"\n".encode())
    (tmp_path / "b.txt").write_bytes("naïve café déjà vu, où est l'hôtel ?".encode("cp1252"))
    for skipped in ("tl/de/c.rpy", "renpy/d.rpy", "e.png"):
        (tmp_path / skipped).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / skipped).write_text("x")
    f = text.files(spark, str(tmp_path)).withColumn("text", text.decoded(F.col("content"))).collect()
    got = {r["file_path"]: r["text"] for r in f}
    assert set(got) == {"a.rpy", "b.txt"} and got["a.rpy"].startswith("label") and "Gr" in got["a.rpy"] and "caf" in got["b.txt"]


def test_lines(spark):
    d = spark.createDataFrame([(1, "a\r\nb\n"), (2, ""), (3, None), (4, "\n\nx"), (5, "a\u2028b")], "i int, text string")
    got = [(r["i"], r["line_number"], r["line"]) for r in text.lines(d, "text", ("i",)).collect()]
    assert got == [(1, 1, "a"), (1, 2, "b"), (4, 1, ""), (4, 2, ""), (4, 3, "x"), (5, 1, "a"), (5, 2, "b")]


def test_data_files(spark):
    cases = {
        "json": ('{"a": {"name": "Sword"}, "l": ["One two", 3, null, "x"]}', {("a.name", "Sword"), ("l[0]", "One two")}),
        "csv": ("name,price\nSword,12\n", {("csv:row0_col0", "name"), ("csv:row0_col1", "price"), ("csv:row1_col0", "Sword")}),
        "yaml": ("title: Hello\nid: abc\n", {("title", "Hello")}),
        "ini": ("[main]\ntitle = Hello\npath = x\n", {("ini:[main]title", "Hello")}),
        "xml": ("<r><title>Hello</title>tail<id>x</id></r>", {("r/title", "Hello")}),
    }
    for kind, (content, want) in cases.items():
        d = spark.createDataFrame([("f", content), ("bad", "{<[:"), ("null", None), ("empty", "")], "file_path string, text string")
        got = {(r["context_line"], r["text"]) for r in text.data_entries(d, kind).collect() if r["file_path"] == "f"}
        assert got == want, kind


def archive(key=0x42):
    body = b"RPA-3.0 XXXXXXXXXXXXXXXX 00000042\n" + b"hello" + b"world!"
    at = body.index(b"hello")
    index = {"a/x.txt": [(at ^ key, 5 ^ key, b"")], "../evil.txt": [((at + 5) ^ key, 6 ^ key, b"")]}
    data = body + zlib.compress(pickle.dumps(index))
    return data.replace(b"XXXXXXXXXXXXXXXX", b"%016x" % len(body), 1)


def test_archive_source(spark, tmp_path):
    (tmp_path / "g.rpa").write_bytes(archive())
    (tmp_path / "broken.rpa").write_bytes(b"RPA-3.0 zz")
    binary.register(spark)
    got = {r["file_path"]: bytes(r["content"]) for r in spark.read.format("loclake_archive").load(str(tmp_path)).collect()}
    assert got == {"a/x.txt": b"hello", "evil.txt": b"world!"}


def compiled(statements):
    body = zlib.compress(pickle.dumps(({"version": 1}, statements), protocol=2))
    head = b"RENPY RPC2" + struct.pack("<III", 1, 10 + 24, len(body)) + struct.pack("<III", 0, 0, 0)
    return head + body


def test_script_source(spark, tmp_path, monkeypatch):
    module = types.ModuleType("renpy.ast")
    for name in ("Say", "Menu", "Label"):
        cls = type(name, (), {"__module__": "renpy.ast"})
        setattr(module, name, cls)
    monkeypatch.setitem(sys.modules, "renpy", types.ModuleType("renpy"))
    monkeypatch.setitem(sys.modules, "renpy.ast", module)

    def node(kind, **attrs):
        n = getattr(module, kind)()
        n.__dict__.update(attrs)
        return n

    tree = [node("Label", linenumber=1, block=[node("Say", what="Hello there", who="e", linenumber=2), node("Menu", linenumber=3, items=[("Go on", "True", [node("Say", what="Inside", who=None, linenumber=4)])])])]
    (tmp_path / "a.rpyc").write_bytes(compiled(tree))
    (tmp_path / "evil.rpyc").write_bytes(b"RENPY RPC2" + b"\0" * 12)
    binary.register(spark)
    got = {(r["text"], r["line_number"], r["text_type"], r["character"]) for r in spark.read.format("loclake_script").load(str(tmp_path)).collect()}
    assert got == {("Hello there", 2, "dialogue", "e"), ("Go on", 3, "menu", None), ("Inside", 4, "dialogue", None)}


def kinds(monkeypatch, *names):
    module = types.ModuleType("renpy.ast")
    for name in names:
        setattr(module, name, type(name, (), {"__module__": "renpy.ast"}))
    monkeypatch.setitem(sys.modules, "renpy", types.ModuleType("renpy"))
    monkeypatch.setitem(sys.modules, "renpy.ast", module)

    def node(kind, **attrs):
        n = getattr(module, kind)()
        n.__dict__.update(attrs)
        return n

    return node


def test_texts_of_code_and_screens(monkeypatch):
    node = kinds(monkeypatch, "Define", "Default", "Python", "RawBlock", "UserStatement", "Screen", "SLScreen", "SLIf", "SLFor", "SLBlock", "SLUse", "SLDisplayable", "SLPython", "SLDefault", "PyCode", "Init", "While", "Translate", "Say")
    code = lambda s: node("PyCode", source=s)
    element = lambda *v, **kw: node("SLDisplayable", positional=list(v), keyword=list(kw.items()), location=("a.rpy", 7), children=[])
    tree = [
        node("Init", block=[node("Define", code=code("title = 'The long way'"), linenumber=1), node("Default", code=code("x = {'name': 'Ann the cook'}"), linenumber=2)]),
        node("Python", code=code("renpy.notify('Take ' + 'care')\nparts = ', '.join(['one more', 'two more'])"), linenumber=3),
        node("RawBlock", code="show text 'Fading in'", linenumber=4), node("UserStatement", line='quest title "Find the key" id "quest_1"', linenumber=5), node("While", block=[node("Say", what="Again", who=None, linenumber=6)]),
        node("Translate", language="tr", block=[node("Say", what="Yine", who="e", linenumber=8)]),
        node("Screen", name="main", screen=node("SLScreen", children=[
            node("SLIf", entries=[("True", node("SLBlock", children=[element('"Start"', tooltip="'Begin it'")])), (None, node("SLBlock", children=[element('_("Load")')]))]),
            node("SLFor", children=[element("Plain label")]), node("SLUse", block=node("SLBlock", children=[element(code("_('Used here')"))])), node("SLPython", code=code("a = 'In a screen'")), node("SLDefault", expression=code("'By default'")),
        ])),
    ]
    got = [(t, line, kind) for t, line, kind, *_ in binary.script_texts(compiled(tree))]
    assert sorted(t for t, _, _ in got) == sorted(["The long way", "Ann the cook", "Take care", "one more, two more", "Fading in", "Find the key", "Again", "Yine", "Start", "Begin it", "Load", "Plain label", "Used here", "In a screen", "By default"])
    assert ("Start", 7, "ui") in got and ("Again", 6, "dialogue") in got
    contexts = {t: c for t, *_, c in binary.script_texts(compiled(tree))}
    assert contexts["Start"] == "screen:main" and contexts["Yine"] == "translate:tr" and contexts["The long way"] == "rpyc_val:title"


def test_packed_script_after_a_head_and_unreadable_files(spark, tmp_path, monkeypatch):
    node = kinds(monkeypatch, "Say")
    body = zlib.compress(pickle.dumps(([], [node("Say", what="Old form", who=None, linenumber=3)]), protocol=2))
    for name, data in {"a.rpymc": b"HEAD\n" + body, "bad.rpyc": b"no script", "tl/x.rpyc": body, "renpy/y.rpyc": body, "renpy/common/z.rpyc": body}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    binary.register(spark)
    read = lambda errors: {(r["file_path"].replace(f"{tmp_path}/", ""), r["text"], r["node_type"]) for r in spark.read.format("loclake_script").option("errors", errors).load(str(tmp_path)).collect()}
    good = {("a.rpymc", "Old form", "Say"), ("renpy/common/z.rpyc", "Old form", "Say")}
    assert read("false") == good and read("true") == good | {("bad.rpyc", None, "unreadable")}


def test_side_tables_and_folders(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"key": "clé", "box": "boîte"}')
    (tmp_path / "rules.json").write_text('["never", "ever"]')
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "r.json").write_text('{"total": 2, "samples": [{"text": "a", "translation_id": "i"}, {"text": "b"}]}')
    pairs = lambda f: sorted(tuple(r) for r in text.side_table(spark, str(tmp_path / f)).collect())
    assert pairs("g.json") == [("box", "boîte"), ("key", "clé")] and [k for k, _ in pairs("rules.json")] == ["ever", "never"] and pairs("broken.json") == [] and pairs("none.json") == []
    assert [tuple(r) for r in text.diagnostic_samples(spark, str(tmp_path / "r.json")).collect()] == [("a", "i", None), ("b", None, None)]
    for f in ("tl/Turkish/a.rpy", "tl/german/a.rpy", "tl/Turkish/a.txt"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("x")
    assert [r["file_path"].endswith("tl/Turkish/a.rpy") for r in text.translation_folder(spark, str(tmp_path), "turkish").collect()] == [True]


class Evil:
    def __reduce__(self):
        return (eval, ("1/0",))


@pytest.mark.parametrize("tree", [True, False])
def test_pickles_can_not_call(tree):
    with pytest.raises(pickle.UnpicklingError):
        binary.SafeUnpickler(io.BytesIO(pickle.dumps(Evil())), tree=tree).load()


def test_write_files(spark, tmp_path):
    d = spark.createDataFrame([("de/a.rpy", "x\r\ny"), ("../b.rpy", "ü"), ("c.rpy", None)], "file_path string, content string")
    sinks.write_files(d, str(tmp_path / "out"))
    assert (tmp_path / "out/de/a.rpy").read_bytes() == b"\xef\xbb\xbfx\ny" and (tmp_path / "out/b.rpy").exists() and (tmp_path / "out/c.rpy").read_bytes() == b"\xef\xbb\xbf"


def test_wrap(spark):
    rows = [('    textbutton "Start" action x',), ('    textbutton _("Start")',), ("# text \"x y\"",), ('    text "[name]"',), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "l string").select(sinks.wrap_strings(F.col("l"))).collect()]
    assert got == ['    textbutton _("Start") action x', *[r[0] for r in rows[1:]]]


def test_stream(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "id string, engine string, ms double, ok boolean, at timestamp"
    import datetime

    at = datetime.datetime(2024, 1, 1, 10)
    rows = [("a", "g", 1.0, True, at), ("a", "g", 1.0, True, at), ("b", "g", 3.0, False, at)]
    spark.createDataFrame(rows, schema).write.parquet(src)
    s = stream.without_repeats(stream.file_stream(spark, src, schema), ["id"], "at")
    stream.run_once(s, out, cp).awaitTermination(60)
    seen = spark.read.parquet(out)
    assert sorted(r["id"] for r in seen.collect()) == ["a", "b"]
    m = stream.engine_metrics(seen, "at", ["engine"], F.col("ms"), F.col("ok")).first()
    assert (m["n"], m["mean_duration"], m["failure_rate"]) == (2, 2.0, 0.5)
