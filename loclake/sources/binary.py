"""Binary sources: archives (RPA-3.0 and 2.0) and compiled scripts, as Python data sources.

Indexes and syntax trees are pickles; they are read by an unpickler that builds inert records and refuses every other
class, so nothing in a file can run. Names in archives are cleaned of absolute and parent parts. Files stand in a shared
folder that every executor sees; an archive is held in memory by the task that reads it. With the option
``errors=true`` a file that is broken or refused has one row that says so.
"""

from __future__ import annotations

import glob
import io
import os
import pickle
import re
import struct
import textwrap
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loclake.functions.predicates import KEYS_IN
from loclake.operators.extract import code_strings

# Signatures of the formats, and builtins that syntax trees may name.
RPA3, RPA2, SCRIPT = b"RPA-3.0 ", b"RPA-2.0 ", b"RENPY RPC2"
PLAIN = {("builtins", n) for n in ("set", "frozenset", "list", "dict", "tuple", "str", "int", "float", "bool", "object")} | {("collections", "OrderedDict"), ("_ast", "AST")}


class Record(dict):
    """Stands for an object of a script's syntax tree: its class name and its attributes."""

    def __init__(self, *args):
        super().__init__()
        self.args = args

    def __setstate__(self, state):
        for part in state if isinstance(state, tuple) else (state,):
            if isinstance(part, dict):
                self.update(part)

    def __hash__(self):
        return id(self)


class SafeUnpickler(pickle.Unpickler):
    def __init__(self, file, tree: bool):
        super().__init__(file, encoding="latin-1" if not tree else "utf-8", errors="surrogateescape")
        self.tree = tree

    def find_class(self, module: str, name: str):
        if self.tree and (module == "store" or module.startswith(("renpy.", "store."))):
            return type(name, (Record,), {"kind": f"{module}.{name}"})
        if self.tree and (module, name) in PLAIN and name not in ("object", "AST"):
            return __import__(module, fromlist=[name]).__dict__[name] if module == "collections" else getattr(__import__("builtins"), name)
        raise pickle.UnpicklingError(f"refused: {module}.{name}")


def archive_files(data: bytes) -> Iterator[tuple[str, bytes]]:
    head = data[:64].split(b"\n", 1)[0]
    if head.startswith(RPA3):
        parts = head.split()
        offset, key = int(parts[1], 16), 0
        for p in parts[2:]:
            key ^= int(p, 16)
    elif head.startswith(RPA2):
        offset, key = int(head.split()[1], 16), 0
    else:
        raise ValueError("not an archive")
    index = SafeUnpickler(io.BytesIO(zlib.decompress(data[offset:])), tree=False).load()
    for name, spans in sorted(index.items()):
        clean = "/".join(p for p in (name if isinstance(name, str) else name.decode("utf-8", "replace")).replace("\\", "/").split("/") if p not in ("", ".", ".."))
        parts = []
        for at, size, *prefix in spans:
            first = (prefix[0] if prefix else b"") or b""
            first = first.encode("latin-1") if isinstance(first, str) else first
            parts += [first, data[at ^ key : (at ^ key) + (size ^ key) - len(first)]]
        yield clean, b"".join(parts)


def script_tree(data: bytes):
    """The statements of a compiled script: slot 1 of the second format, or one packed body, if need be after a head."""
    if data.startswith(SCRIPT):
        at, slots = len(SCRIPT), {}
        while True:
            slot, start, size = struct.unpack("<III", data[at : at + 12])
            at += 12
            if slot == 0:
                break
            slots[slot] = (start, size)
        start, size = slots[1]
        body = zlib.decompress(data[start : start + size])
    else:
        body = zlib.decompress(data[max(0, data.find(b"\x78")) :])
    tree = SafeUnpickler(io.BytesIO(body), tree=True).load()
    return tree[1] if isinstance(tree, tuple) else tree


# Keywords of screen elements that hold text, and what makes a value an expression.
TEXT_KEYWORDS = ("text", "alt", "tooltip", "caption", "title")
EXPRESSION = ("_(", "__(", "renpy.", "Text(", "[")
QUOTED = re.compile(r"[rRuUbBfF]{0,2}(\"\"\"|'''|\"|')(.*)\1", re.S)
LINE_TEXT = re.compile(r"(?:(\w+)\s*=?\s*)?(?:_\()?([\"'])((?:\\.|(?!\2).)+)\2")


def _code(x) -> str:
    """Source of a code object, an expression or a plain text."""
    if isinstance(x, str):
        return x
    source = x.get("source") if isinstance(x, Record) else None
    if isinstance(source, str):
        return source
    args = getattr(x, "args", ())
    return next((y for y in args if isinstance(y, str)), "")


def script_texts(data: bytes) -> Iterator[tuple[str, int, str, str | None, str, str]]:
    """(text, line, text type, character, node type, context) of a compiled script.

    Texts stand in statements, in screens, and in code; a kind of node is read by the table ``READ``, all others only
    for what stands below them. Nodes are visited once, in order.
    """
    todo: list[tuple[object, str]] = [(n, "") for n in reversed(list(script_tree(data) or ()))]
    seen: set[int] = set()
    while todo:
        node, context = todo.pop()
        if isinstance(node, (list, tuple)):
            todo += [(n, context) for n in reversed(node)]
            continue
        if not isinstance(node, Record) or id(node) in seen:
            continue
        seen.add(id(node))
        kind = type(node).__name__
        where = node.get("location")
        line = int(node.get("linenumber") or (where[1] if isinstance(where, (list, tuple)) and len(where) > 1 and isinstance(where[1], int) else 0))
        name = node.get("name")
        below = {"Label": f"label:{name}", "Init": f"{context}/init", "Screen": f"screen:{name or 'unknown'}", "Translate": f"translate:{node.get('language')}", "TranslateBlock": f"translate:{node.get('language')}"}.get(kind, context)
        for text, text_type, who, at in READ.get(kind, _nothing)(node, context):
            if text:
                yield text, line, text_type, who, kind, at
        inner = [below_ for k in ("block", "screen", "children") if isinstance(below_ := node.get(k), (list, tuple, Record))]
        inner += [e[-1] for e in node.get("entries") or () if isinstance(e, (list, tuple)) and len(e) > 1]
        if kind == "Menu":
            inner = [i[2] for i in node.get("items") or () if isinstance(i, (list, tuple)) and len(i) > 2 and i[2]]
            below = f"{context}/menu_item"
        todo += [(n, below) for n in reversed(inner)]


def _nothing(node, context):
    return ()


def _said(node, context):
    if isinstance(node.get("what"), str):
        at = f"translate:{node.get('identifier', '')}" if type(node).__name__ == "TranslateSay" else context
        yield node["what"], "dialogue", node["who"] if isinstance(node.get("who"), str) else None, at


def _menu(node, context):
    for item in node.get("items") or ():
        if isinstance(item, (list, tuple)) and item and isinstance(item[0], str):
            yield item[0], "menu", None, context


def _strings(code: str, text_type: str = "python_string"):
    for text, _, key in code_strings(textwrap.dedent(code)):
        yield text, text_type, None, f"rpyc_val:{key}" if key else "python"


def _of_code(*fields: str):
    def read(node, context):
        for f in fields:
            if code := _code(node.get(f)):
                yield from _strings(code)

    return read


def _raw(node, context):
    body = next((node[k] for k in ("code", "block", "string") if isinstance(node.get(k), str)), "")
    return _strings(body) if body else ()


def _line(node, context):
    """Literals of a user's statement; those with a key in front count if the key names text."""
    for key, _, text in LINE_TEXT.findall(node.get("line") or ""):
        if not key or key.lower() in KEYS_IN or " " in text:
            yield text, "ui", None, f"data:{key}" if key else "user_statement"


def _value(value, context):
    """A value of a screen element: a literal, code, or a plain label."""
    if not isinstance(value, str):
        yield from _strings(_code(value), "ui") if _code(value) else ()
    elif m := QUOTED.fullmatch(value.strip()):
        yield m[2], "ui", None, context
    elif any(e in value for e in EXPRESSION):
        yield from _strings(value.strip(), "ui")
    elif value.strip():
        yield value.strip(), "ui", None, context


def _element(node, context):
    if isinstance(node.get("displayable"), Record):
        yield from _strings(_code(node["displayable"]), "ui")
    for v in node.get("positional") or ():
        yield from _value(v, context)
    for kw in node.get("keyword") or ():
        if isinstance(kw, (list, tuple)) and len(kw) > 1 and kw[0] in TEXT_KEYWORDS and kw[1]:
            yield from _value(kw[1], context)


READ = {
    "Say": _said, "TranslateSay": _said, "Menu": _menu, "TranslateString": lambda n, c: [(n["old"], "string", None, "translate")] if isinstance(n.get("old"), str) else (),
    "Define": _of_code("code"), "Default": _of_code("code"), "Python": _of_code("code"), "EarlyPython": _of_code("code"), "RawBlock": _raw, "UserStatement": _line,
    "SLDisplayable": _element, "SLPython": _of_code("code"), "SLDefault": _of_code("expression"),
}


def wanted(path: str) -> bool:
    """Neither a translation nor the engine's own, but for its common folder."""
    return not path.startswith("tl/") and (not path.startswith("renpy/") or "common" in path)


class _Path(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict, pattern: str, rows, broken=None):
        self.root, self.pattern, self.rows = options["path"], pattern, rows
        self.broken = broken if options.get("errors", "false") == "true" else None

    def partitions(self):
        found = [self.root] if os.path.isfile(self.root) else sorted(p for e in self.pattern.split("|") for p in glob.glob(os.path.join(self.root, "**", e), recursive=True))
        return [_Path(p) for p in found if p == self.root or wanted(os.path.relpath(p, self.root).replace(os.sep, "/"))]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            data = f.read()
        try:
            yield from self.rows(partition.path, data)
        except (ValueError, KeyError, IndexError, TypeError, AttributeError, EOFError, zlib.error, struct.error, pickle.UnpicklingError) as e:
            if self.broken:  # one row says which file couldn't be read or was refused, and why
                yield self.broken(partition.path, f"{type(e).__name__}: {e}")


def _archive_rows(path: str, data: bytes):
    for name, body in archive_files(data):
        yield path, name, body


def _script_rows(path: str, data: bytes):
    for text, line, kind, who, node, context in script_texts(data):
        yield path, text, line, kind, who, node, context, True


class ArchiveSource(DataSource):
    """spark.read.format("loclake_archive").load(folder): one row per file in an archive."""

    @classmethod
    def name(cls):
        return "loclake_archive"

    def schema(self):
        return "archive string, file_path string, content binary"

    def reader(self, schema):
        return _Reader(self.options, "*.rpa", _archive_rows, lambda path, why: (path, None, why.encode()))


class ScriptSource(DataSource):
    """spark.read.format("loclake_script").load(folder): one row per text of a compiled script."""

    @classmethod
    def name(cls):
        return "loclake_script"

    def schema(self):
        return "file_path string, text string, line_number int, text_type string, character string, node_type string, context string, is_rpyc boolean"

    def reader(self, schema):
        return _Reader(self.options, "*.rpyc|*.rpymc", _script_rows, lambda path, why: (path, None, None, None, None, "unreadable", why, True))


def register(spark) -> None:
    spark.dataSource.register(ArchiveSource)
    spark.dataSource.register(ScriptSource)
