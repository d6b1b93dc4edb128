"""Problem 1: visually identical text with different characters.

Confusables skeleton: decompose, replace every character by its prototype from the look-alike table, decompose
again; originals with equal skeletons form a group. The table is the public one of Unicode's security mechanisms, read
from the ICU library that Spark brings along, with the letters below; ASCII characters are their own prototypes.

The *consistent form* of a text is the spelling of its skeleton that its writing asks for: a prototype is put where the
writing doesn't need the character (a joiner inside an emoji or a Persian word stays, a Cyrillic letter inside a
Cyrillic word stays). A row is a case where its skeleton has replaced something and the consistent form, of the same
skeleton, is spelt otherwise. Without the table no letter of another alphabet is found.

Nulls give null, empty texts themselves; both are never altered.
"""

from __future__ import annotations

import re
import unicodedata as ud
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loclake.llm.common import table

# Letters of other alphabets and the Latin letters they look like.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "а": "a", "с": "c", "ԁ": "d", "е": "e",
    "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "г": "r",
    "ѕ": "s", "т": "t", "ү": "v", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ґ": "r", "в": "b", "п": "n", "ь": "b",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "α": "a", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "ϲ": "c", "ς": "c", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϳ": "j", "σ": "o",
}
#: Cyrillic letters that no Russian word has.
NOT_RUSSIAN = frozenset("ЅІЈѕіјһԁԛԝӏүѵҮԚԜ")
TO_CYRILLIC = {v: k for k, v in reversed(CYRILLIC.items()) if k not in NOT_RUSSIAN and k not in "ґгпьв"}
TO_GREEK = {v: k for k, v in reversed(GREEK.items()) if k not in "Ϲϲϳς"}

INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\U000e0000-\U000e007f]")
SPACE = re.compile("[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
HALF_KANA = re.compile("[\uff66-\uff9f]+")
ARABIC_OR_INDIC = re.compile("[\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\u0900-\u0dff\u0f00-\u109f\u1780-\u17ff]")
RIGHT_TO_LEFT = re.compile("[\u0590-\u08ff]")
JAPANESE = re.compile("[\u3001-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff9f]")
EMOJI = re.compile("[\u00a9\u00ae\u203c-\u3299\U0001f000-\U0001faff0-9#*]")
WORD = re.compile(r"\\[A-Za-z]|[^\W\d_]+")
LATIN = re.compile("[A-Za-z\u00aa\u00ba\u00c0-\u024f\u1e00-\u1eff]")
ALPHABETS = "\u0370-\u03ff\u0400-\u052f\u1f00-\u1fff"  # Greek and Cyrillic


@lru_cache(maxsize=None)
def prototype(ch: str) -> str:
    """Of one character by rule of its Unicode decomposition: wide, narrow and joined letters, styled letters."""
    kind, _, rest = ud.decomposition(ch).partition(" ")
    if not kind.startswith("<"):
        return ch
    to, cat = ud.normalize("NFKC", ch), ud.category(ch)
    if kind in ("<wide>", "<narrow>"):
        return to if to.isalnum() or HALF_KANA.match(ch) else ch
    if kind == "<font>" and cat[0] in "LN" and ord(ch) > 0xFFFF:
        return to
    if kind == "<compat>" and cat[0] == "L" and (ch == "\u017f" or len(rest.split()) > 1 and to.isalpha()):
        return to
    if kind in ("<initial>", "<medial>", "<final>", "<isolated>") and cat[0] == "L":
        return to
    return ch


#: Characters whose prototype may differ: a quick test before the character loop.
FORMS = re.compile("[\u0132\u0133\u0149\u017f\u01c4-\u01cc\u01f1-\u01f3\ufb00-\ufdff\ufe70-\ufefc\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\U0001d400-\U0001d7ff]")


def _keeps_invisible(m: re.Match) -> bool:
    text, at, ch = m.string, m.start(), m[0]
    before, after = text[at - 1 : at], text[m.end() : m.end() + 1]
    if ch in "\u200c\u200d" and before and after:
        if ARABIC_OR_INDIC.match(before) and ARABIC_OR_INDIC.match(after):
            return True
        return ch == "\u200d" and bool(EMOJI.match(after)) and (before == "\ufe0f" or bool(EMOJI.match(before)))
    if ch in "\ufe0e\ufe0f":
        return bool(before and EMOJI.match(before))
    if ch in "\u200e\u200f\u061c" or "\u202a" <= ch <= "\u202e" or "\u2066" <= ch <= "\u2069":
        return bool(RIGHT_TO_LEFT.search(text))
    if "\U000e0020" <= ch <= "\U000e007f":  # flags of regions
        return "\U0001f3f4" in text
    return False


def _space(m: re.Match) -> str:
    if m[0] == "\u3000":
        before, after = m.string[: m.start()].rstrip()[-1:], m.string[m.end() :].lstrip()[:1]
        if before and JAPANESE.match(before) or after and JAPANESE.match(after):
            return m[0]
    return " "


class Shapes(dict):
    """Prototype of a character: of its ordinary width and form first, then by the look-alike table."""

    def __init__(self, table: dict[str, str]):
        super().__init__()
        self.table = table

    def __missing__(self, c: str) -> str:
        self[c] = "".join(self.table.get(p, p) for p in prototype(c))
        return self[c]

    def __reduce__(self):
        return Shapes, (self.table,)


class Forms:
    """Skeletons and consistent forms under one look-alike table (character -> prototype)."""

    def __init__(self, table: dict[str, str]):
        self.prototypes, self.shapes = table, Shapes(table)
        self.to_latin = {c: p for c, p in table.items() if len(p) == 1 and LATIN.match(p) and not LATIN.match(c) and ud.category(c)[0] == "L"}
        more = "".join(re.escape(c) for c in self.to_latin if not "\u0370" <= c <= "\u052f")
        self.other = re.compile(f"[{ALPHABETS}{more}]")
        self.back = [{p: c for p, c in back.items() if c in table} for back in (TO_CYRILLIC, TO_GREEK)]

    def skeleton(self, text: str) -> str:
        """Decompose, replace every character by its prototype, decompose again; blind to context."""
        if text.isascii():
            return text
        text = ud.normalize("NFD", SPACE.sub(" ", INVISIBLE.sub("", text)))
        return ud.normalize("NFD", "".join([self.shapes[c] for c in text]))

    def _word(self, m: re.Match) -> str:
        """A word of two alphabets becomes a word of one, where prototypes explain the mixture."""
        w = m[0]
        other = self.other.findall(w)
        if not other or w[0] == "\\":
            return w
        if not LATIN.search(w):
            # wholly of look-alikes, some of which no Russian word has: a Latin word in disguise
            return "".join(self.to_latin[c] for c in w) if len(other) == len(w) and not NOT_RUSSIAN.isdisjoint(w) and all(c in self.to_latin for c in w) else w
        if all(c in self.to_latin for c in other):
            return "".join(self.to_latin.get(c, c) for c in w)
        for back in self.back:
            if all(c in back or self.other.match(c) for c in w):
                return "".join(back.get(c, c) for c in w)
        return w

    def spelt(self, text: str) -> str:
        """The spelling that the writing asks for."""
        if INVISIBLE.search(text):
            text = INVISIBLE.sub(lambda m: m[0] if _keeps_invisible(m) else "", text)
        if SPACE.search(text):
            text = SPACE.sub(_space, text)
        if HALF_KANA.search(text):
            text = HALF_KANA.sub(lambda m: ud.normalize("NFKC", m[0]), text)
        if FORMS.search(text):
            text = "".join(map(prototype, text))
        text = ud.normalize("NFC", text)
        if self.other.search(text):
            text = WORD.sub(self._word, text)
        return text

    def canonical(self, text: str) -> str:
        """The one consistent form of a text: itself where its skeleton has replaced nothing."""
        if text.isascii():
            return text
        shape = self.skeleton(text)
        if shape == ud.normalize("NFD", text) and text == ud.normalize("NFC", text):
            return text
        form = self.spelt(text)
        return form if form == text or self.skeleton(form) == shape else text


#: ICU's class that has the public table.
CHECKER = "com.ibm.icu.text.SpoofChecker$Builder"
#: The letters above alone, for the functions below where they are called without a table.
FIXED = Forms(CYRILLIC | GREEK)
canonical, skeleton = FIXED.canonical, FIXED.skeleton


def public_table(spark: SparkSession) -> dict[str, str]:
    """Prototypes of letters and digits beyond ASCII by ICU's table, a few thousand; ideographs and syllables have none.

    Without the library there is no table, and a run that would find fewer letters ends instead.
    """
    chars = [chr(i) for i in range(0x80, 0x20000) if not (0x3400 <= i < 0xA000 or 0xAC00 <= i < 0xE000) and ud.category(chr(i))[0] in "LN"]
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    try:
        of = jvm.java.lang.Class.forName(CHECKER)
        builder = of.getDeclaredConstructor(gateway.new_array(jvm.java.lang.Class, 0)).newInstance(gateway.new_array(jvm.java.lang.Object, 0))
        got = builder.build().getSkeleton("\n".join(chars)).split("\n")
    except Exception as e:
        raise RuntimeError(f"the look-alike table can't be read from ICU ({CHECKER})") from e
    if len(got) != len(chars):
        raise RuntimeError(f"the look-alike table has {len(got)} prototypes of {len(chars)} characters")
    # Latin letters and decomposable ones keep their own shape: accents aren't look-alikes of plain letters
    return {c: p for c, p in zip(chars, got) if p not in ("", c) and ud.normalize("NFD", c) != p and not LATIN.match(c)}


def forms(spark: SparkSession) -> Forms:
    return Forms(public_table(spark) | CYRILLIC | GREEK)


def _udf(of):
    @F.pandas_udf(StringType())
    def mapped(s: pd.Series) -> pd.Series:
        return s.map(of, na_action="ignore")

    return mapped


def beyond_ascii(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7F]")


def consistent_form(text: Column, of: Forms = FIXED) -> Column:
    """Only texts beyond ASCII go through Python: an ASCII text is its own consistent form."""
    return F.coalesce(_udf(of.canonical)(F.when(beyond_ascii(text), text)), text)


def originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entries").select(F.lit("entries").alias("src"), F.col("entry_id").alias("row_id"), "text")
    t = table(spark, sf_dir, "tokens").select(F.lit("tokens").alias("src"), F.col("token_id").alias("row_id"), F.col("raw_text").alias("text"))
    return e.unionByName(t)


def altered(df: DataFrame, of: Forms, text: str = "text") -> DataFrame:
    """Rows whose text isn't in the consistent form, with that form as ``canonical``."""
    return df.where(beyond_ascii(F.col(text))).withColumn("canonical", _udf(of.canonical)(text)).where(F.col("canonical") != F.col(text))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return altered(originals(spark, sf_dir), forms(spark)).select("src", "row_id")


def p1_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its text in the consistent form."""
    return originals(spark, sf_dir).select("src", "row_id", consistent_form(F.col("text"), forms(spark)).alias("text"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of different spelling with one skeleton: the spellings, how many, and how often they occur.

    Words are counted per spelling first (map-side), so a word that a third of all rows hold is one row a task.
    """
    text, word = F.col("text"), F.col("word")
    words = originals(spark, sf_dir).where(text.isNotNull()).select(F.explode(F.split(text, r"[^\p{L}\p{M}\p{N}\p{Cf}]+")).alias("word")).where("word <> ''")
    spelt = words.groupBy("word").agg(F.count("*").alias("n"))
    shape = F.coalesce(_udf(forms(spark).skeleton)(F.when(beyond_ascii(word), word)), word)
    most = F.max_by("word", F.struct("n", "word")).alias("usual")
    groups = spelt.withColumn("skeleton", shape).groupBy("skeleton").agg(F.count("*").alias("spellings"), F.sum("n").alias("n_words"), most)
    return groups.where("spellings > 1").select("skeleton", "spellings", "n_words", "usual")


QUERIES = {"p1_found": p1_found, "p1_canonical": p1_canonical, "p1_groups": p1_groups}
SQL: dict[str, str] = {}
