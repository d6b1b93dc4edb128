"""Extraction: string tokens with contexts, entries by kind of statement, deep scans of Python code.

Each file is one row; its lines depend on each other, so a file is scanned by one Arrow call and files run in parallel.
Files without text have no rows; literals that no quote ends count to the end of their line (a triple one: of the file).
"""

from __future__ import annotations

import ast
import re
import textwrap
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loclake.functions import predicates as P
from loclake.functions import text as X
from loclake.operators.relational import keep_first

#: A comment, a triple literal to its end or the file's, or a literal of one line; one that its line doesn't end has no body.
LITERAL = re.compile(
    r"#[^\n]*|(?P<prefix>[rRuUbBfF]{0,2})(?:(?P<triple>\"\"\"|''')(?P<long>.*?)(?:(?P=triple)|\Z)|(?P<quote>[\"'])(?:(?P<body>(?:\\[^\n]|(?!(?P=quote))[^\\\n])*)(?P=quote)|[^\n]*))", re.S
)
BLOCK = re.compile(r"[ \t]*(?:(label|screen)\s+([\w.]+)|(menu)\b[^=(]*:?\s*$|(?:init\s+(?:-?\d+\s+)?)?(python)\b|(nvl)\b)", re.I)
ESCAPES = {"n": "\n", "t": "\t", '"': '"', "'": "'", "\\": "\\", "r": "\n"}
TOKEN_SCHEMA = "token_type string, text string, raw_text string, prefix string, line_number int, context_path array<string>, context_line string, text_type string"


def _resolve(body: str, prefix: str) -> str:
    if "r" in prefix.lower():
        return body
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], "\\" + m[1]), body, flags=re.S)


def literals(content: str) -> list[re.Match]:
    """Literals of a text whose lines end in line feeds."""
    return [m for m in LITERAL.finditer(content) if m["long"] is not None or m["body"] is not None]


def block_paths(lines: list[str], inside: np.ndarray) -> tuple[np.ndarray, list[tuple[str, ...]]]:
    """For each line the number of the innermost block that covers it (-1: none), and the labels down to each block.

    A block reaches from its head to the last line before one that isn't indented further than the head. Blank lines,
    comments and lines ``inside`` a literal end nothing.
    """
    width = np.array([len(x) - len(x.lstrip()) for x in lines] or [0])[: len(lines)]
    counts = [i for i, x in enumerate(lines) if not inside[i] and x.strip() and not x.lstrip().startswith("#")]
    ends = dict.fromkeys(counts, len(lines) - 1)
    shallower: list[int] = []  # of the lines below, those that may end a block above, the nearest last
    for i in reversed(counts):
        while shallower and width[shallower[-1]] > width[i]:
            shallower.pop()
        if shallower:
            ends[i] = shallower[-1] - 1
        shallower.append(i)
    of, paths = np.full(len(lines), -1), []
    for i in counts:
        if m := BLOCK.match(lines[i]):
            label = f"{m[1].lower()}:{m[2]}" if m[1] else (m[3] or m[4] or m[5]).lower()
            above = paths[of[i]] if of[i] >= 0 else ()
            of[i : ends[i] + 1] = len(paths)
            paths.append((*above, label))
    return of, paths


def scan(content: str) -> Iterator[tuple]:
    """String tokens of a script with the blocks that cover them."""
    lines = content.splitlines()
    text = "\n".join(lines)
    starts = np.r_[0, np.cumsum([len(x) + 1 for x in lines])][: len(lines)].astype(int)
    found = literals(text)
    first = np.searchsorted(starts, [m.start() for m in found], "right") - 1
    last = np.searchsorted(starts, [m.end() - 1 for m in found], "right") - 1
    inside = np.zeros(len(lines), bool)
    for a, b in zip(first, last):
        inside[a + 1 : b + 1] = True
    of, paths = block_paths(lines, inside)
    for m, at in zip(found, first):
        path = list(paths[of[at]]) if of[at] >= 0 else []
        kind = "dialogue" if not path or any(p.startswith("label") for p in path) else "ui"
        body = m["long"] if m["triple"] else m["body"]
        yield "TRIPLE_STRING" if m["triple"] else "STRING", _resolve(body, m["prefix"]), m[0], m["prefix"], int(at) + 1, path, lines[at].lstrip(), kind


def _table(df: DataFrame, key: str, content: str, reader, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    key_type = dict(df.dtypes)[key]

    def read(batches):
        for pdf in batches:
            rows = [(k, i, *r) for k, c in zip(pdf[key], pdf[content]) if isinstance(c, str) for i, r in enumerate(reader(c))]
            yield pd.DataFrame(rows, columns=[key, "seq", *names]).astype({"seq": "int64"})

    return df.select(key, content).mapInPandas(read, f"{key} {key_type}, seq long, {schema}")


def script_tokens(df: DataFrame, key: str = "file_path", content: str = "text") -> DataFrame:
    return _table(df, key, content, scan, TOKEN_SCHEMA)


def statement_kind(tokens: DataFrame) -> DataFrame:
    """Kind and speaker of each token by the statement it stands in."""
    line = F.col("context_line")
    quoted = r'(?:[rRuUbBfF]{0,2})["\']'
    speaker = F.regexp_extract(line, rf"\A(\w+)(?:\s+\w+)*\s+{quoted}", 1)
    word = F.lower(speaker)
    screen = word.isin("text", "textbutton", "label", "tooltip", "add", "imagebutton", "input", "key", "title", "caption")
    code = word.isin("play", "stop", "queue", "show", "hide", "scene", "define", "default", "image", "jump", "call", "init", "python", "style", "return", "if", "elif", "while", "for", "voice", "translate", "old", "new")
    menu = F.exists("context_path", lambda c: c == "menu") & line.rlike(rf"\A{quoted}.*[\"']\s*(?:if\s.*)?:\s*\z")
    call = line.rlike(r"(\b_{1,2}|_p|renpy\.say|renpy\.notify|renpy\.input|Text)\s*\(")
    kind = (
        F.when(menu, "menu").when(call, "renpy_func").when(screen, "ui").when(P.in_context(F.col("context_path"), "python") | code | line.startswith("$"), "code")
        .when(F.col("token_type") == "TRIPLE_STRING", "monologue").when(speaker != "", "character").when(line.rlike(rf"\A{quoted}"), "narration").otherwise("code")
    )
    return tokens.withColumn("kind", kind).withColumn("character", F.when(F.col("kind") == "character", speaker))


def build_entries(tokens: DataFrame, off: tuple[str, ...] = ()) -> DataFrame:
    """Entries from tokens: text for people only, type by context, masks and their map."""
    t = tokens.where(P.is_meaningful(F.col("text")) & ~P.in_context(F.col("context_path"), "hidden_label"))
    t = t.withColumn("text_type", P.text_type_of(F.col("context_path"), F.col("context_line")))
    t = t.where(P.should_translate(F.col("text"), F.col("text_type"), off)).withColumn("_m", X.preserve(F.col("text")))
    pairs = F.arrays_zip(F.col("_m.keys").alias("k"), F.col("_m.tokens").alias("v"))
    return t.withColumn("processed_text", F.col("_m.text")).withColumn("placeholder_map", F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["k"], p["v"])))).drop("_m")


def merge_passes(passes: list[DataFrame], key: str = "file_path") -> DataFrame:
    """Union of extraction passes; of rows with one text, line and context the earliest pass stays."""
    rows = [p.select(key, "seq", "text", "line_number", "context_path", "text_type", F.lit(i).alias("pass_no")) for i, p in enumerate(passes)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return keep_first(out, [key, "text", "line_number", "context_path"], ["pass_no", "seq"], ["pass_no", "seq", "text_type"])


# --- deep scan of Python code -----------------------------------------------------------------------------------------

ONE_LINER = re.compile(r"^\s*\$\s*(.*)$")
PYTHON = re.compile(r"^(\s*)(?:init\s+(?:-?\d+\s+)?)?python\b.*:\s*$")


def python_blocks(content: str) -> Iterator[tuple[int, str]]:
    """(line, code) of python blocks and one-line statements of a script."""
    lines, i = content.splitlines(), 0
    while i < len(lines):
        if m := ONE_LINER.match(lines[i]):
            yield i + 1, m[1]
        elif m := PYTHON.match(lines[i]):
            depth, j = len(m[1]), i + 1
            while j < len(lines) and (not lines[j].strip() or len(lines[j]) - len(lines[j].lstrip()) > depth):
                j += 1
            if any(x.strip() for x in lines[i + 1 : j]):
                yield i + 2, textwrap.dedent("\n".join(lines[i + 1 : j]))
            i = j - 1
        i += 1


def _joined(node: ast.AST) -> str | None:
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value
    if isinstance(node, ast.JoinedStr):
        return "".join(v.value if isinstance(v, ast.Constant) else f"[{ast.unparse(v.value)}]" for v in node.values)
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        a, b = _joined(node.left), _joined(node.right)
        return a + b if a is not None and b is not None else None
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Mod):
        return _joined(node.left)
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and (base := _joined(node.func.value)) is not None:
        if node.func.attr == "format":
            return base
        if node.func.attr == "join" and len(node.args) == 1 and isinstance(node.args[0], (ast.List, ast.Tuple)):
            parts = [_joined(x) for x in node.args[0].elts]
            return base.join(parts) if None not in parts else None
    return None


def code_strings(code: str) -> Iterator[tuple[str, int, str | None]]:
    """(text, line within the code, name it is assigned to or its key) of literals in Python code, each once."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        for n, line in enumerate(code.splitlines(), 1):
            for m in re.finditer(r"(?:(\w+)\s*(?:=|:|\()\s*)?[rRuUbBfF]{0,2}(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')", line):
                yield _resolve(m[2][1:-1], ""), n, m[1]
        return
    names: dict[int, str] = {}
    for node in ast.walk(tree):
        if isinstance(node, (ast.Assign, ast.AugAssign, ast.AnnAssign)) and node.value is not None:
            target = node.targets[0] if isinstance(node, ast.Assign) else node.target
            name = target.id if isinstance(target, ast.Name) else target.attr if isinstance(target, ast.Attribute) else None
            inner = [node.value, *(node.value.elts if isinstance(node.value, (ast.List, ast.Tuple)) else ())]
            names.update({id(x): name for x in inner if name})
        elif isinstance(node, ast.Dict):
            names.update({id(v): k.value for k, v in zip(node.keys, node.values) if isinstance(k, ast.Constant) and isinstance(k.value, str)})
        elif isinstance(node, ast.keyword) and node.arg:
            names[id(node.value)] = node.arg
    keys = {id(k) for n in ast.walk(tree) if isinstance(n, ast.Dict) for k in n.keys if k is not None}
    inner_parts: set[int] = set()
    for node in ast.walk(tree):
        if id(node) in inner_parts or id(node) in keys or not hasattr(node, "lineno"):
            continue
        if (text := _joined(node)) is not None:
            inner_parts.update(id(x) for x in ast.walk(node) if x is not node)
            yield text, node.lineno, names.get(id(node))


def scan_code(content: str) -> Iterator[tuple[str, int, str | None]]:
    for first, code in python_blocks(content):
        for text, line, name in code_strings(code):
            yield text, first + line - 1, name


def deep_strings(df: DataFrame, key: str = "file_path", content: str = "text") -> DataFrame:
    """Texts in Python code that the statement passes don't see, filtered by key or content."""
    found = _table(df, key, content, scan_code, "text string, line_number int, key_name string")
    listed = F.lower("key_name").isin(*P.KEYS_IN, *P.KEYS_OUT)
    ok = P.meaningful_value(F.col("text"), F.when(listed, F.col("key_name"))) & P.is_meaningful(F.col("text"))
    path = F.when(F.col("key_name").isNotNull(), F.array(F.concat(F.lit("variable:"), F.col("key_name")))).otherwise(F.array().cast("array<string>"))
    return found.where(ok).withColumn("context_path", path).withColumn("text_type", F.lit("python_string"))


KEY_HERE = re.compile(r"(?:(\w+)\s*=\s*(?:\[\s*)?|(\w+)\.(?:append|extend|insert)\s*\([^\"']*|[\"'](\w+)[\"']\s*:\s*)$")
KEY_ABOVE = re.compile(r"^\s*(?:(\w+)\s*=\s*[\[{(]|(\w+)\.(?:append|extend)\s*\()")


def file_literals(content: str, above: int = 10) -> Iterator[tuple[str, int, str | None, bool]]:
    """(text, line, key, within Python) of every literal of a file, statements or not.

    The key is the name that the literal is given to on its line, in front of it, or else by a list or call that begins
    on one of the ``above`` lines before it and isn't closed yet. Literals side by side are one text.
    """
    lines = content.splitlines()
    text = "\n".join(lines)
    starts = np.r_[0, np.cumsum([len(x) + 1 for x in lines])][: len(lines)].astype(int)
    inside = np.zeros(len(lines) + 1, int)
    for first, code in python_blocks(content):
        inside[first - 1 : first - 1 + code.count("\n") + 1] = 1
    found, at = literals(text), 0
    while at < len(found):
        m = found[at]
        body, prefix = (m["long"] if m["triple"] else m["body"]), m["prefix"]
        parts, end = [_resolve(body, prefix)], m.end()
        while at + 1 < len(found) and not text[end : found[at + 1].start()].strip(" \t\\"):
            at += 1
            n = found[at]
            parts.append(_resolve(n["long"] if n["triple"] else n["body"], n["prefix"]))
            end = n.end()
        at += 1
        no = int(np.searchsorted(starts, m.start(), "right")) - 1
        here = KEY_HERE.search(text[starts[no] : m.start()])
        key = next((k for k in here.groups() if k), None) if here else None
        for up in range(no - 1, max(-1, no - 1 - above), -1) if key is None else ():
            if h := KEY_ABOVE.match(lines[up]):
                between = "\n".join(lines[up:no])
                if sum(map(between.count, "[({")) > sum(map(between.count, "])}")):
                    key = h[1] or h[2]
                break
        yield "".join(parts), no + 1, key, bool(inside[no])


def literal_strings(df: DataFrame, key: str = "file_path", content: str = "text") -> DataFrame:
    """Texts in any literal of a file, filtered by key or content; their type says whether Python holds them."""
    found = _table(df, key, content, file_literals, "text string, line_number int, key_name string, in_python boolean")
    listed = F.lower("key_name").isin(*P.KEYS_IN, *P.KEYS_OUT)
    ok = P.meaningful_value(F.col("text"), F.when(listed, F.col("key_name"))) & P.is_meaningful(F.col("text"))
    path = F.when(F.col("key_name").isNotNull(), F.array(F.concat(F.lit("variable:"), F.col("key_name")))).otherwise(F.array().cast("array<string>"))
    return found.where(ok).withColumn("context_path", path).withColumn("text_type", F.when(F.col("in_python"), "python_string").otherwise("deep_scan"))


# --- where texts are used -------------------------------------------------------------------------------------------

# Words in front of a literal that name no speaker.
NO_SPEAKER = frozenset("if elif else while for return pass menu label screen define default image transform style".split())
USE = re.compile(r"[ \t]*(?:(textbutton|text)\s+_?\s*\(?|(\w+)\s+)?([\"'])(.+?)\3")


def usages(content: str) -> Iterator[tuple[str, int, str, str | None, str | None, str | None, list[str]]]:
    """(text, line, use, character, label, screen, path) of the first literal of each line outside Python."""
    lines = content.split("\n")
    of, paths = block_paths(lines, np.zeros(len(lines), bool))
    for i, line in enumerate(lines):
        path = paths[of[i]] if of[i] >= 0 else ()
        if line.lstrip().startswith("#") or "python" in path or BLOCK.match(line) or not (m := USE.match(line)):
            continue
        named = lambda kind: next((p.split(":", 1)[1] for p in reversed(path) if p.startswith(kind + ":")), None)
        menu = "menu" in path
        if m[1]:
            use, who = m[1], None
        elif m[2]:
            if menu or m[2].lower() in NO_SPEAKER:
                continue
            use, who = "dialogue", m[2]
        else:
            use, who = ("menu" if menu else "narrator"), None
        yield m[4], i + 1, use, who, named("label"), named("screen"), list(path)


def usage_contexts(df: DataFrame, key: str = "file_path", content: str = "text") -> DataFrame:
    return _table(df, key, content, usages, "text string, line_number int, use string, character string, label string, screen string, context_path array<string>")


def character_names(df: DataFrame, content: str = "text") -> DataFrame:
    """Names given to characters: define e = Character("Eileen")."""
    pattern = r'define\s+\w+\s*=\s*Character\s*\(\s*(?:_\()?"([^"]+)"'
    return df.select(F.explode(F.regexp_extract_all(content, F.lit(pattern), F.lit(1))).alias("name")).distinct()
