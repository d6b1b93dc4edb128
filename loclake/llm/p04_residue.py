"""Problem 4: template residue and error-page text.

Labelled exemplars of residue (``residue_exemplars``) stand in an inverted index (token -> exemplars). A passage
(sentence, line, or the whole text without tags) retrieves the exemplars that it may contain: an exemplar is posted
under its rarest tokens, as many as outweigh what a match may lack, so none is missed. TF-IDF containment, with
document counts over the whole table, says how much of the exemplar the passage holds and how much of the passage the
exemplar explains. Tokens that no exemplar has weigh ``UNKNOWN`` and no token more than ``RAREST``, at every
size of the table. Long exemplars are also
sought in sliding windows, filler of any length where it ends a text outside quotes. A story about an error shares
tokens but no coverage. Slots and masks are recognised by form and compared with those of the original.

Null, empty and untouched translations are no cases; a null or blank mask value is one.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loclake.llm.common import table
from loclake.llm.residue_exemplars import labelled

# Words that stand for nothing.
NOTHING = frozenset({"", "none", "null", "undefined", "nan", "nil", "n/a", "na", "-", "--", "—", "?", "??", "???", "[]", "{}", "()", "<>", '""', "''", "...", "…", "missing", "<missing>", "empty", "<empty>", "unknown", "<unknown>", "nil", "void", "n.a.", "n. a.", "none.", "not set", "not available", "[object object]", "xxx", "tba"})
# Text tags of the game engine.
TAGS = frozenset("a b i s u k p w nw w fast cps color size font image alpha alt art clear done outlinecolor plain rb rt noalt space vspace axis shader instance feature rpage lpage slow sc shake bt".split())
WINDOW, CONTAINED, COVERED, UNKNOWN, RAREST = 5, 0.7, 0.6, 4.0, 7.0

TOKEN = re.compile(r"[぀-ヿ㐀-鿿ー]+|[^\W_]+")
JAPANESE = re.compile("[぀-ヿ㐀-鿿ー]")
TAG = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>")
MARKUP = re.compile(r"\{[#/]?[A-Za-z][\w#=.]*\}|\[[\w.! ]+\]|%\(\w+\)s|\{\{")
PASSAGE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|\n+")
SLOT = re.compile(
    r"\$\{[^{}]*\}|\{\{[^{}]*\}\}|<%.*?%>|\{%.*?%\}|%[A-Z][A-Z_]{2,}%|__[A-Z][A-Z_]*__|<[A-Z][A-Z_ ]{3,}>|(?i:<(?:no translation|missing|untranslated|placeholder|empty)>)"
    r"|\[\[?\s*[A-Z][A-Z _-]{2,}\s*(?:!\w+)?\]\]?|\{[A-Z][A-Z _-]{2,}\}|⟦[^⟧]*⟧|XRPYX\s*[A-Z0-9]+\s*XRPYX|\?\s?V\d+\s?\?|【[A-Z]+\d+】|\$[A-Z][A-Z_]+\$|@@\w+@@|#\{\w+\}|\{\d+\}|%\([A-Z_]{3,}\)s|(?<!\{)\{[a-z_]{3,}\}"
    r"|<<\s*\w[\w ]*>>|&lt;\w[\w ]*&gt;|\$\(\w+\)|\{\$\w+\}|\{#\w+#\}|<#\w+#>|%%\w+%%|##\w+##|\$\$\w+\$\$|@[A-Z][A-Z_]{2,}@|#[A-Z][A-Z_]{2,}#|\|[A-Z][A-Z_]{2,}\||\[object \w+\]|\[%\s*\w+\s*%\]|\[\[\s*\w[\w ]*\]\]"
    r"|[\[<{](?:insert|your|enter|add|missing|translate|translation|untranslated|no|name|text|placeholder)(?: \w+){1,3}[\]>}]|<(?:name|player|value|text|title|item|string|variable|todo)>|\[(?:todo|tbd|missing|untranslated|placeholder|translate)\]"
)


def slots(text: str) -> list[str]:
    """Unfilled slots and masks by form; tags of the engine are none."""
    out = []
    for m in SLOT.findall(text):
        if re.fullmatch(r"\{[a-z_]+\}", m) and m[1:-1] in TAGS:
            continue
        out.append(m)
    return out


def spelling(markup: str) -> str:
    """Markup without what may be spelt otherwise: spaces, flags, case."""
    return re.sub(r"!\w+(?=[\]}])|\s+", "", markup).lower()


@lru_cache(maxsize=200_000)
def _shape(word: str) -> tuple[str, ...]:
    if any(c.isdigit() for c in word):
        return ("#",)
    if JAPANESE.match(word):
        return tuple(word[i : i + 2] for i in range(max(1, len(word) - 1)))
    return (word,)


def tokens(text: str) -> list[str]:
    return [t for w in TOKEN.findall(text.lower()) for t in _shape(w)]


def exemplars() -> list[list[str]]:
    return [tokens(x) for _, x in labelled()]


#: Filler of one word is only told from a word of some language by its capitals.
CAPITALS = re.compile(r"\b[A-Z]{3,}\W*$")
QUOTES = re.compile("[\"'»”“’」』‹›]\\s*\\W*$")


class Residue:
    """The inverted index with the weights of one corpus."""

    def __init__(self, df: dict[str, int], n: int):
        self.examples = exemplars()
        self.sets = [frozenset(e) for e in self.examples]
        self.idf = {t: 0.3 if t == "#" else min(RAREST, math.log((n + 2) / (df.get(t, 0) + 1))) for e in self.sets for t in e}
        self.weight = [sum(self.idf[t] for t in e) for e in self.sets]
        # any passage with the share CONTAINED of an exemplar holds one of the rarest tokens that outweigh the rest
        self.postings: dict[str, list[int]] = defaultdict(list)
        for i, e in enumerate(self.sets):
            missing = 0.0
            for t in sorted(e, key=lambda t: (-self.idf[t], t)):
                self.postings[t].append(i)
                missing += self.idf[t]
                if missing > (1 - CONTAINED) * self.weight[i]:
                    break
        self.endings: dict[str, list[tuple[str, ...]]] = defaultdict(list)
        for (label, _), e in zip(labelled(), self.examples):
            if label == "filler" and e:
                self.endings[e[-1]].append(tuple(e))

    def covered(self, words: list[str]) -> bool:
        held = set(words)
        got = {i for t in held if t in self.postings for i in self.postings[t]}
        if not got:
            return False
        total = sum(self.idf.get(t, UNKNOWN) for t in held)
        for i in got:
            both = self.sets[i] & held
            w = sum(self.idf[t] for t in both)
            if w < CONTAINED * self.weight[i]:
                continue
            if w >= COVERED * total and (len(both) >= 2 or len(held) == 1):
                return True
            n = len(self.examples[i])
            if len(self.sets[i]) >= WINDOW and len(words) > n:
                for at in range(len(words) - n + 1):
                    inside = self.sets[i] & set(words[at : at + n])
                    if sum(self.idf[t] for t in inside) >= 0.85 * self.weight[i]:
                        return True
        return False

    def ends_in_filler(self, text: str, words: list[str]) -> bool:
        """Whether filler stands at the end of a text, outside quotes."""
        if not words or words[-1] not in self.endings or QUOTES.search(text):
            return False
        for e in self.endings[words[-1]]:
            if len(words) > len(e) and tuple(words[-len(e) :]) == e and (len(e) > 1 or CAPITALS.search(text)):
                return True
        return False

    def passages(self, text: str) -> bool:
        plain = TAG.sub(" ", MARKUP.sub(" ", text))
        parts = [p for p in PASSAGE.split(plain) if p]
        words = tokens(plain)
        return any(self.covered(tokens(p)) for p in parts) or len(parts) > 1 and self.covered(words) or self.ends_in_filler(plain, words)

    def translation(self, original: str | None, text: str | None) -> bool:
        if text is None or not text.strip() or text == original:
            return False
        if found := slots(text):
            had = spelling(original or "")
            if any(spelling(s) not in had for s in found):
                return True
        return self.passages(text) and not (original and self.passages(original))

    def mask_value(self, text: str | None, value: str | None) -> bool:
        if value is None or value.strip().lower() in NOTHING:
            return True
        bare = spelling(value)
        if text and bare in spelling(text):
            return False
        if slots(value):
            return True
        inner = re.sub(r"!\w+$", "", re.sub(r"^[\[{%(<#\s]+|[\]})>\s]+s?\s*$", "", value.strip()))
        return self.passages(value) or self.covered(tokens(inner))


def weigh(texts: DataFrame, column: str) -> Residue:
    """Document counts of the exemplars' tokens over all texts: at most one row per token reaches the driver."""
    known = sorted({t for e in exemplars() for t in e if t != "#" and not JAPANESE.match(t)})
    words = F.array_distinct(F.split(F.lower(column), r"[^\p{L}]+"))
    hits = texts.where(F.col(column).isNotNull()).select(F.explode(words).alias("t")).where(F.col("t").isin(known))
    df = {r["t"]: r["n"] for r in hits.groupBy("t").agg(F.count("*").alias("n")).collect()}
    return Residue(df, texts.where(F.col(column).isNotNull()).count())


def residue_translations(results: DataFrame) -> DataFrame:
    """Rows of ``results`` whose translation is or contains residue."""
    index = weigh(results, "translated_text")

    @F.pandas_udf(T.BooleanType())
    def found(original: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([index.translation(o, t) for o, t in zip(original, text)], dtype=bool)

    return results.where("translated_text is not null").where(found("original_text", "translated_text"))


def residue_masks(entries: DataFrame) -> DataFrame:
    """Rows of ``entries`` with a mask value that is residue."""
    index = weigh(entries, "text")

    @F.pandas_udf(T.BooleanType())
    def found(text: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([any(index.mask_value(t, v) for v in vs) for t, vs in zip(text, values)], dtype=bool)

    return entries.where("size(placeholder_map) > 0").where(found("text", F.map_values("placeholder_map")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = residue_translations(table(spark, sf_dir, "results", "result_id", "original_text", "translated_text"))
    e = residue_masks(table(spark, sf_dir, "entries", "entry_id", "text", "placeholder_map"))
    return r.select(F.lit("results").alias("src"), F.col("result_id").alias("row_id")).unionByName(e.select(F.lit("entries").alias("src"), F.col("entry_id").alias("row_id")))


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations that hold no residue: what goes on to the output."""
    results = table(spark, sf_dir, "results", "result_id", "original_text", "translated_text", "target_lang")
    bad = residue_translations(results).select("result_id")
    return results.join(bad, "result_id", "left_anti").select("result_id", "target_lang", "translated_text")


QUERIES = {"p4_found": p4_found, "p4_clean": p4_clean}
SQL: dict[str, str] = {}
