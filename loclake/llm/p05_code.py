"""Problem 5: natural language hidden inside code.

A small lexer takes comments and string literals out of code. Each piece is broken into subwords (identifiers at "_"
and humps, then pieces of a public tokenizer), scored under unigram counts of seven languages and of code over the
tokenizer's vocabulary, and gets the class of maximum posterior. Language counts come from a bounded sample of
``SAMPLE`` translation entries, those of code from the statements (literals and comments taken out) of as many
entries; all entries are scanned.

Null and empty fields, field lists and dialogue hold no code. A literal that no quote ends counts to the line's end.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loclake.llm.bpe import BPE_MULTI, encoding, path_of, ranks
from loclake.llm.common import LANGS, NAME_TO_CODE, bounded_sample, table
from loclake.llm.p06_layout import named_fields
from loclake.llm.p07_pairs import plain

SAMPLE = 12_000
CLASSES = (*LANGS, "code")
LEAST_WORDS, LEAST_JAPANESE = 4, 10

WORD = re.compile(r"[^\W\d_]+")
JAPANESE = re.compile("[぀-ヿ㐀-鿿ー]")
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|_+|(?<=[^\W\d_])(?=\d)")
# Forms of statements of the script language and of Python.
HEADER = re.compile(
    r"^\s*(?:(?:def|class)\s+\w+\s*(?:\(.*\))?\s*:|(?:label|screen|menu|transform|style)\s+[\w.]+\s*(?:\(.*\))?\s*:|(?:init(?:\s+-?\d+)?\s+)?python(?:\s+early|\s+hide|\s+in\s+\w+)*\s*:|init(?:\s+-?\d+)?\s*:|label:\w+|screen:\w+|menu:|translate\s+\w+\s+\w+\s*:)"
)
STATEMENT = re.compile(
    r"^\s*(?:\$\s*\S|@\w|#|(?:play|stop|queue)\s+(?:music|sound|voice|audio)\b|(?:show|hide|scene)\s+[a-z_]\w*(?:\s+(?:at|with|behind)\s+\w+|\s+\w+)*\s*(?:#.*)?$|(?:jump|call|use)\s+[a-z_][\w.]*\s*(?:#.*)?$|(?:show|hide|call|use)\s+(?:screen\s+)?[a-z_][\w.]*\(.*\)"
    r"|(?:import|from)\s+[a-z_][\w.]*|(?:return|raise|yield|assert|del|pass|break|continue|else:|try:|finally:)(?:\s+[\w.]+[\[(.].*|\s*)(?:#.*)?$|(?:if|elif|while|for)\s.*:\s*(?:#.*)?$|(?:default|define|image)\s+[\w.]+(?:\s+\w+)*\s*=|[\w.\[\]\"']+\s*(?:[-+*/|&%]|\*\*|//)?=(?!=)\s*\S"
    r"|[A-Za-z_][\w.]*\(.*\)\s*(?:#.*)?$|(?:text|textbutton|label|vbox|hbox|frame|imagebutton|add)\s+(?:_\(|[uUrRbBfF]?[\"']).*|\"\w+\"\s*:\s*[\"'\[{\d].*,?\s*(?:#.*)?$|[xy](?:align|pos|anchor|offset)\s+-?[\d.]+)"
)
CODE_COMMENT = re.compile(r"^\s*(?:\$\s*\w|[\w.]+\([^()]*\)|[\w.\[\]\"']+\s*(?:[-+*/]|\*\*|//)?=(?!=)\s*\S|(?:def|class)\s+\w+|(?:noqa|type:|pylint:|pragma:|fmt:|isort:|mypy:))")
LEAD = re.compile(r"^[#:!*\s-]+")
ESCAPE = re.compile(r"\\(.)", re.S)


PATH = re.compile(r"[a-z_]+(?::\w+)?(?:\s*>\s*[a-z_]+(?::\w+)?)*")


def is_code(text: str) -> bool:
    """Whether a field holds code; a bare path of contexts (label:x > screen:y) is none."""
    if PATH.fullmatch(text):
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines or named_fields(text) and not HEADER.match(lines[0]):
        return False
    if HEADER.match(lines[0]):
        return True
    hits = sum(bool(STATEMENT.match(x) or HEADER.match(x)) for x in lines)
    return hits >= 1 and bool(STATEMENT.match(lines[0])) and (len(lines) == 1 or 2 * hits >= len(lines))


def literals(code: str) -> tuple[list[tuple[str, int, str]], str]:
    """(kind, line, content) of comments and string literals, and the code without them."""
    out, rest, i, n, line = [], [], 0, len(code), 1
    while i < n:
        ch = code[i]
        if ch == "#":
            end = code.find("\n", i)
            end = n if end < 0 else end
            out.append(("comment", line, code[i:end]))
            i = end
        elif ch in "\"'":
            quote = code[i : i + 3] if code[i : i + 3] in ('"""', "'''") else ch
            at, begin = i + len(quote), line
            j = at
            while j < n and not code.startswith(quote, j) and not (len(quote) == 1 and code[j] == "\n"):
                j += 2 if code[j] == "\\" and j + 1 < n else 1
            j = min(j, n)
            body = code[at:j]
            out.append(("string", begin, body))
            line += body.count("\n")
            i = j + len(quote) if code.startswith(quote, j) else j
        else:
            rest.append(ch)
            line += ch == "\n"
            i += 1
    return out, "".join(rest)


def unescape(body: str) -> str:
    return ESCAPE.sub(lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), body)


class Classifier:
    """Unigram counts per class over the pieces of a tokenizer."""

    def __init__(self, path: str, rows: list[tuple[str, str]]):
        self.path, n = path, len(ranks(path)) + 1
        counts = np.zeros((n, len(CLASSES)))
        for cls, text in rows:
            np.add.at(counts[:, CLASSES.index(cls)], self.pieces(text), 1)
        p = counts / np.maximum(1, counts.sum(0)) + 2e-6
        self.log = (np.log(p) - np.log(p).max(1, keepdims=True)).clip(-7).astype(np.float32)

    def pieces(self, text: str) -> list[int]:
        return encoding(self.path).encode_ordinary(HUMP.sub(" ", text).lower())

    def classify(self, text: str) -> str:
        got = self.log[self.pieces(text)].sum(0)
        if JAPANESE.search(text) and 3 * len(JAPANESE.findall(text)) > len(WORD.findall(text)):
            got[CLASSES.index("ja")] += 8
        return CLASSES[int(got.argmax())]


def piece_language(kind: str, body: str, model: Classifier) -> str | None:
    """Language of a comment or literal, None where it isn't natural language."""
    text = LEAD.sub("", body) if kind == "comment" else unescape(body)
    if kind == "comment" and CODE_COMMENT.match(text):
        return None
    clean = plain(text)
    if len(WORD.findall(clean)) < LEAST_WORDS and len(JAPANESE.findall(clean)) < LEAST_JAPANESE:
        return None
    words = clean.split()
    if len(JAPANESE.findall(clean)) < LEAST_JAPANESE:
        # words are runs of letters between blanks, not parts of one path or key
        if sum(bool(re.match(r"^[\"'(«“„¿¡\[*—–-]*[^\W_]+(?:['’.-][^\W_]+)*[^\w\s]*$", w)) for w in words) < LEAST_WORDS:
            return None
    lang = model.classify(clean)
    return None if lang == "code" else lang


def found_in(entry_fields: list[tuple[str, str]], model: Classifier) -> list[tuple[str, int, str, str, int]]:
    """(field, line, kind, language, characters) of the natural-language pieces of one entry."""
    out = []
    for field, text in entry_fields:
        if text and ("#" in text or '"' in text or "'" in text) and is_code(text):
            for kind, line, body in literals(text)[0]:
                if lang := piece_language(kind, body, model):
                    out.append((field, line, kind, lang, len(body)))
    return out


CODE_LIKE = r"[#\"']"


def fitted(spark: SparkSession, sf_dir: str, sample: int = SAMPLE) -> Classifier:
    """From the ``sample`` rows with the smallest hashes of each table."""
    t = bounded_sample(table(spark, sf_dir, "tl_entries", "tl_id", "lang", "original_text", "translated_text").where("translated_text is not null"), ["tl_id"], sample).collect()
    rows = [("en", plain(r["original_text"] or "")) for r in t] + [(NAME_TO_CODE.get(r["lang"] or "", "en"), plain(r["translated_text"])) for r in t]
    e = bounded_sample(table(spark, sf_dir, "entries", "entry_id", "text").where(F.col("text").contains("\n") & F.col("text").rlike(CODE_LIKE)), ["entry_id"], sample).collect()
    rows += [("code", literals(r["text"])[1]) for r in e if is_code(r["text"])]
    return Classifier(path_of(BPE_MULTI), rows)


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces: entry_id, file_path, field, line_no, kind, lang, chars; and one row per field of code with kind null."""
    model = fitted(spark, sf_dir)
    e = table(spark, sf_dir, "entries", "entry_id", "file_path", "text", "context").where(F.col("text").rlike(CODE_LIKE) | F.col("context").rlike(CODE_LIKE))

    def scan(batches):
        for pdf in batches:
            out = []
            for i, path, text, context in zip(pdf["entry_id"], pdf["file_path"], pdf["text"], pdf["context"]):
                fields = [(f, t) for f, t in (("text", text), ("context", context)) if isinstance(t, str)]
                out += [(i, path, *x) for x in found_in(fields, model)]
                out += [(i, path, f, 0, None, None, len(t)) for f, t in fields if is_code(t)]
            yield pd.DataFrame(out, columns=["entry_id", "file_path", "field", "line_no", "kind", "lang", "chars"]).astype({"line_no": "int32"})

    return e.mapInPandas(scan, "entry_id long, file_path string, field string, line_no int, kind string, lang string, chars long")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(spark, sf_dir).where("kind is not null").select("entry_id", "field", "line_no", "kind", "lang")


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file each language's share of the characters of its code; files without such pieces have no row."""
    by = pieces(spark, sf_dir).groupBy("file_path").agg(
        F.sum(F.when(F.col("kind").isNull(), F.col("chars"))).alias("all"),
        *[F.sum(F.when(F.col("lang") == lg, F.col("chars")).otherwise(0)).alias(lg) for lg in LANGS],
    )
    shares = F.explode(F.array(*[F.struct(F.lit(lg).alias("lang"), F.col(lg).alias("chars")) for lg in LANGS])).alias("s")
    return by.select("file_path", "all", shares).where("s.chars > 0").select("file_path", "s.lang", "s.chars", (F.col("s.chars") / F.col("all")).alias("share"))


QUERIES = {"p5_found": p5_found, "p5_shares": p5_shares}
SQL: dict[str, str] = {}
