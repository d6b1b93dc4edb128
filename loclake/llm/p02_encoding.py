"""Problem 2: text that was decoded with a wrong character set.

1. *Near-twins.* Words of garbled texts are joined with clean words of the language on what is left of them without
   non-ASCII characters; whole texts with the other translations of the same original.
2. *Alignment.* The ASCII characters of a pair are its anchors; the runs between them are aligned, and each pair of
   runs is explained by the chain (true character set, wrong one) that turns one into the other, over all single-byte
   sets that Python knows besides the usual ones below. Chains that explain several different pairs are learned.
3. *Application.* Every record is read back through the chains. A learned chain needs one restored run as evidence,
   any other usual chain two (Japanese through two-byte sets three): the usual chains are a prior, so a table without
   twins isn't left unread; other chains are read only where they were learned. Single-byte Cyrillic sets, whose
   garbled text consists of proper letters, are told apart by letter-pair counts over the Russian texts of the whole
   table; the Turkish and the Western set, which differ in six letters, by the vocabulary of the whole table.

U+FFFD can't be restored but is evidence. Nulls and ASCII texts are no cases.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from encodings.aliases import aliases
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loclake.llm.common import checkpoint, few, table

# Fixed values: (true set, wrong set) that text tools confuse; sets are names of Python's codecs.
UTF8_AS = ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1251", "cp1254", "cp1250", "koi8_r", "cp866")
UTF8_AS_WIDE = ("cp932", "gb18030", "euc_jp", "big5", "cp949")
JAPANESE_AS = (("cp932", "cp1252"), ("cp932", "latin_1"), ("euc_jp", "latin_1"), ("euc_jp", "cp1252"), ("cp932", "mac_roman"))
CYRILLIC_SETS = ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic")
CYRILLIC_AS = tuple((a, b) for a in CYRILLIC_SETS for b in ("cp1252", "latin_1"))
TURKISH_AS_WESTERN = str.maketrans("ýðþÝÐÞ", "ığşİĞŞ")

#: Letters and signs that proper texts of the corpus's languages may hold beyond ASCII.
PROPER = re.compile(
    "[¡¿«»°€£§©®™№½¼¾²³·×÷ªº–—―‘’‚“”„†•…‹›′″♪♫→←↑↓★☆♥❤⚔ 　-ヿ㐀-䶿一-鿿！-ﾟ"
    "À-ÖØ-öø-žŒœŠšŸŽžƒА-яЁё\U0001f300-\U0001faff️‍]"
)
KANA = re.compile("[ぁ-ヿ、。！？]")
JAPANESE = re.compile("[、-ヿ一-鿿！？]")
UTF8_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
NON_ASCII = re.compile(r"[^\x00-\x7f]+")
CYRILLIC_WORD = re.compile("[Ѐ-ӿ]{3,}")
ACCENTED_WORD = re.compile("(?<![A-Za-z])[¨¸À-ÿŒœŠšŸŽž]{3,}(?![A-Za-z])")
HIGH = re.compile("[─-◿Ѐ-ӿ -ÿ∙√№]{3,}")


@lru_cache(maxsize=1)
def single_byte_sets() -> tuple[str, ...]:
    """Sets of one byte a character that keep ASCII, by trial over Python's codecs."""
    out = []
    for name in sorted(set(aliases.values())):
        try:
            low, high = bytes(range(32, 127)).decode(name), bytes(range(160, 256)).decode(name, "replace")
        except (LookupError, UnicodeError, AssertionError):
            continue
        if low.isascii() and len(low) == 95 and low[0] == " " and len(high) == 96 and high.count("\ufffd") < 20 and low == bytes(range(32, 127)).decode("ascii"):
            out.append(name)
    return tuple(out)


@lru_cache(maxsize=None)
def byte_of(charset: str) -> dict[str, int]:
    """Characters to bytes of a single-byte set; bytes it leaves open stand for themselves, as browsers have it."""
    out = {}
    for b in range(128, 256):
        try:
            ch = bytes([b]).decode(charset)
        except UnicodeDecodeError:
            ch = chr(b)
        out[ch] = b
    for b in range(128, 160):
        out.setdefault(chr(b), b)
    return out


@lru_cache(maxsize=None)
def runs_of(charset: str) -> re.Pattern:
    return re.compile("[" + re.escape("".join(sorted(byte_of(charset)))) + "]+")


def back_from_utf8(text: str, wrong: str, depth: int = 0) -> tuple[str, int]:
    """(restored text, restored characters): bytes read as a single-byte set that were UTF-8."""
    table_, hits = byte_of(wrong), 0

    def run(m: re.Match) -> str:
        nonlocal hits
        raw, out, at = bytes(table_[c] for c in m[0]), [], 0
        for s in UTF8_SEQUENCE.finditer(raw):
            try:
                ch = s[0].decode()
            except UnicodeDecodeError:
                continue
            out.append(m[0][at : s.start()])
            out.append(ch)
            at, hits = s.end(), hits + 1
        out.append(m[0][at:])
        return "".join(out)

    new = runs_of(wrong).sub(run, text)
    if not hits:
        return text, 0
    strange = [c for c in set(new) - set(text) if ord(c) > 127 and not PROPER.match(c)]
    if depth < 2:
        again, more = back_from_utf8(new, wrong, depth + 1)
        if more:
            return again, hits
        if strange:
            other = "latin_1" if wrong == "cp1252" else "cp1252"
            again, more = back_from_utf8(new, other, depth + 1)
            if more:
                return again, hits
    return (text, 0) if strange else (new, hits)


def back_from_wide(text: str, wrong: str) -> tuple[str, int]:
    """UTF-8 read as a set of two-byte characters; what such a set couldn't show is lost.

    Three adjacent sequences that give Japanese are evidence; a proper text has none by chance.
    """
    hits = 0

    def run(m: re.Match) -> str:
        nonlocal hits
        raw, clusters = m[0].encode(wrong, "ignore"), []
        for s in UTF8_SEQUENCE.finditer(raw):
            if s.end() - s.start() == 3 and JAPANESE.match(s[0].decode(errors="replace")):
                if clusters and s.start() - clusters[-1][1] <= 4:
                    clusters[-1][1], clusters[-1][2] = s.end(), clusters[-1][2] + 1
                else:
                    clusters.append([s.start(), s.end(), 1])
        out, at = [], 0
        for start, end, n in clusters:
            if n >= 3 and 3 * n >= 0.6 * (end - start):
                out += [raw[at:start].decode(wrong, "ignore"), raw[start:end].decode(errors="replace")]
                at, hits = end, hits + n
        return "".join(out) + raw[at:].decode(wrong, "ignore") if out else m[0]

    new = NON_ASCII.sub(run, text)
    return new, hits


def back_to_japanese(text: str, true: str, wrong: str) -> tuple[str, int]:
    table_, hits = byte_of(wrong), 0
    pieces, at = [], 0
    for m in re.finditer(f"(?:{runs_of(wrong).pattern}|[\x20-\x7e])+", text):
        seg = m[0]
        # the garbled part begins with the first character beyond ASCII
        first = next((i for i, c in enumerate(seg) if ord(c) > 127), None)
        if first is None:
            continue
        raw = bytes(table_.get(c, ord(c) & 255) for c in seg[first:])
        new = raw.decode(true, "ignore")
        n, high = len(KANA.findall(new)), sum(ord(c) > 127 for c in seg)
        if n >= 3 and 5 * n >= high and len(JAPANESE.findall(new)) * 2 >= 0.8 * high:
            pieces += [text[at : m.start()], seg[:first], new]
            at, hits = m.end(), hits + n
    return ("".join(pieces) + text[at:], hits) if hits else (text, 0)


class Pairs:
    """Letter-pair counts of Russian as mean logarithms."""

    def __init__(self, counts: dict[str, int]):
        self.total, self.counts = sum(counts.values()) or 1, counts
        self.floor = math.log(0.3 / (self.total + 1))

    def score(self, word: str) -> float:
        w = f" {word.lower()} "
        got = [math.log(c / self.total) if (c := self.counts.get(a + b)) else self.floor for a, b in zip(w, w[1:])]
        # an upper-case letter after a lower-case one within a word is as rare as any unseen pair
        got += [self.floor] * sum(a.islower() and b.isupper() for a, b in zip(word, word[1:]))
        return sum(got) / len(got)


def russian_pairs(text: str, into: Counter) -> None:
    for w in re.findall("[а-яё]{2,}", text.lower()):
        w = f" {w} "
        into.update(map("".join, zip(w, w[1:])))


def back_to_cyrillic(text: str, pairs: Pairs) -> tuple[str, int, tuple[str, str] | None]:
    """Russian of one single-byte set read as another: the reading whose letter pairs are usual wins."""
    best: tuple[float, str, int, tuple[str, str] | None] = (0, text, 0, None)
    spans = [(m, True) for m in CYRILLIC_WORD.finditer(text)] + [(m, False) for m in ACCENTED_WORD.finditer(text)]
    boxes = [(m, False) for m in HIGH.finditer(text) if re.search("[─-◿]", m[0])]
    if not spans and not boxes:
        return text, 0, None
    words = boxes or spans
    held = [pairs.score(m[0]) if cyr else pairs.floor for m, cyr in words]
    if all(h > -6.6 for h in held):
        return text, 0, None
    for wrong in (*CYRILLIC_SETS, "cp1252", "latin_1"):
        table_ = byte_of(wrong)
        for true in CYRILLIC_SETS:
            if true == wrong:
                continue
            gain, n = 0.0, 0
            for (m, _), old in zip(words, held):
                if any(c not in table_ for c in m[0]):
                    continue
                new = bytes(table_[c] for c in m[0]).decode(true, "ignore")
                parts = re.findall("[а-яёА-ЯЁ]+", new)
                if not parts or sum(map(len, parts)) < 0.8 * len(new):
                    continue
                up = sum(pairs.score(p) for p in parts) / len(parts) - old
                gain += up * len(m[0])
                n += up > 1.2 and (len(m[0]) >= 4 or up > 2.5)
            if n and gain > best[0] + 1e-9:
                best = (gain, text, n, (true, wrong))
    gain, _, n, chain = best
    letters = sum(len(m[0]) for m, _ in words)
    if not n or gain < 8 or gain < 0.2 * letters:
        return text, 0, None
    table_ = byte_of(chain[1])

    def run(m: re.Match) -> str:
        new = bytes(table_[c] for c in m[0]).decode(chain[0], "ignore") if all(c in table_ for c in m[0]) else ""
        return new if new and sum("а" <= c.lower() <= "ё" for c in new) >= 0.8 * len(new.strip()) else m[0]

    whole = 3 * n >= sum(len(m[0]) >= 4 for m, _ in words)
    return NON_ASCII.sub(run, text) if whole else text, n, chain


SIGNS = re.compile("[^\x00-\x7f" + "áéíóúñüçâêîôûàèìòùëïöäßğışİĞŞÇÖÜÄÉÁÍÓÚÑ¿¡«»“”„‘’…–—½°£§　-ヿ一-鿿！-？" + "А-яёЁ]|[縺繧繝銈銉銇]|[âÃÂÄÅÐÑРС][^\x00-\x7fА-Яа-яёЁ]|[ÃÂâ].|¥|¤")


@lru_cache(maxsize=8)
def others(learned: frozenset) -> tuple[str, ...]:
    """Sets beside the usual ones as which UTF-8 was read by what was learned."""
    return tuple(sorted(w for t, w in (c.split(">") for c in learned) if t == "utf_8" and w not in UTF8_AS and w not in UTF8_AS_WIDE))


def repair(text: str | None, learned: frozenset, pairs: Pairs) -> tuple[str, str] | None:
    """(restored text, chain) of a garbled text, else None."""
    if text is None or text.isascii():
        return None
    best: tuple[int, str, str] | None = None
    if SIGNS.search(text):
        for wrong in (*UTF8_AS, *others(learned)):
            new, n = back_from_utf8(text, wrong)
            need = 1 if f"utf_8>{wrong}" in learned and wrong not in ("cp1251", "koi8_r", "cp866") else 2
            if wrong in ("cp1251", "koi8_r", "cp866") and n and not CYRILLIC_WORD.search(new) and n < 3:
                continue
            if n and n < need and wrong in ("cp1252", "latin_1", "mac_roman", "cp437") and not (set(new) - set(text)) <= set(" "):
                need = 1  # a whole sequence that gives a proper letter
            if n >= need and (best is None or n > best[0]):
                best = (n, new, f"utf_8>{wrong}")
        for wrong in UTF8_AS_WIDE:
            new, n = back_from_wide(text, wrong)
            if n >= 2 and (best is None or n > best[0]):
                best = (n, new, f"utf_8>{wrong}")
        for true, wrong in JAPANESE_AS:
            new, n = back_to_japanese(text, true, wrong)
            if n >= 3 and (best is None or n > best[0]):
                best = (n, new, f"{true}>{wrong}")
    if best is None:
        new, n, chain = back_to_cyrillic(text, pairs)
        if n:
            best = (n, new, ">".join(chain))
    if "�" in text:
        return (best[1] if best else text, (best[2] if best else "lost"))
    return best and (best[1], best[2])


# --- learning from near-twins -------------------------------------------------------------------------------------


def explain(garbled: str, clean: str) -> str | None:
    """The chain that turns the runs of ``clean`` into those of ``garbled``, aligned at their ASCII characters."""
    a, b = NON_ASCII.findall(garbled), NON_ASCII.findall(clean)
    if len(a) != len(b) or not a or NON_ASCII.sub("\0", garbled) != NON_ASCII.sub("\0", clean):
        return None
    for wrong in (*UTF8_AS, *UTF8_AS_WIDE):
        if all(_as(y, "utf_8", wrong) == x or _as(_as(y, "utf_8", wrong), "utf_8", wrong) == x for x, y in zip(a, b)):
            return f"utf_8>{wrong}"
    for true, wrong in (*JAPANESE_AS, *CYRILLIC_AS, ("cp1254", "cp1252")):
        if all(_as(y, true, wrong) == x for x, y in zip(a, b)):
            return f"{true}>{wrong}"
    if sum(map(len, a)) > sum(map(len, b)):
        for wrong in single_byte_sets():
            if wrong not in UTF8_AS and all(_as(y, "utf_8", wrong) == x for x, y in zip(a, b)):
                return f"utf_8>{wrong}"
    return None


def _as(text: str | None, true: str, wrong: str) -> str | None:
    if text is None:
        return None
    try:
        raw = text.encode(true)
    except UnicodeEncodeError:
        return None
    if wrong in UTF8_AS_WIDE:
        return raw.decode(wrong, "replace")
    back = {b: c for c, b in byte_of(wrong).items() if c != chr(b) or b >= 160 or wrong == "latin_1"}
    return "".join(back.get(b, chr(b)) for b in raw)


@F.pandas_udf(T.StringType())
def explain_udf(garbled: pd.Series, clean: pd.Series) -> pd.Series:
    return pd.Series([explain(g, c) for g, c in zip(garbled, clean)], dtype=object)


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per text: (tl_id, lang, field, text, original); the two fields of a row come from one scan."""
    t = table(spark, sf_dir, "tl_entries", "tl_id", "lang", "original_text", "translated_text")
    both = F.array(
        F.struct(F.lit("original_text").alias("field"), F.lit("english").alias("lang"), F.col("original_text").alias("text"), F.lit(None).cast("string").alias("original")),
        F.struct(F.lit("translated_text").alias("field"), F.col("lang"), F.col("translated_text").alias("text"), F.col("original_text").alias("original")),
    )
    return t.select("tl_id", F.inline(both))


def twins(texts: DataFrame) -> DataFrame:
    """Pairs (garbled, clean) of different words with one key; words are counted before they are joined."""
    word = F.explode(F.split("text", r"[\s\p{Punct}&&[^'’]]+")).alias("word")
    # words of other scripts have too few ASCII letters for a key
    words = texts.where(F.col("text").rlike(r"[^\x00-\x7F]") & F.col("text").rlike("[A-Za-z]{3}")).select("lang", word).where(F.col("word").rlike(r"[^\x00-\x7F]") & F.col("word").rlike("[A-Za-z].*[A-Za-z].*[A-Za-z]"))
    words = words.groupBy("lang", "word").agg(F.count("*").alias("n")).withColumn("key", F.regexp_replace("word", r"[^\x00-\x7F]+", ""))
    words = words.where(F.length("key") >= 3).withColumn("marks", F.length("word") - F.length("key"))
    clean = words.where("marks <= 6 and n >= 2").select("lang", "key", F.col("word").alias("clean"), F.col("marks").alias("few"))
    # a wrong single-byte reading has more characters than the right one, or other ones at the same places
    return words.join(clean, ["lang", "key"]).where("word <> clean and marks >= few").select("key", F.col("word").alias("garbled"), "clean")


def text_twins(texts: DataFrame) -> DataFrame:
    """Pairs (garbled, clean) of different translations of one original with the same ASCII characters in order.

    Only hashes are shuffled to find originals with several spellings of one translation; the texts of those are
    fetched. The most frequent spelling (of equals the one with the fewest characters) is the clean one: a wrong reading
    never has fewer.
    """
    t = texts.where(F.col("field") == "translated_text").where(F.col("text").rlike(r"[^\x00-\x7F]")).where("original is not null")
    stripped = F.regexp_replace("text", r"[^\x00-\x7F]+", "\x01")
    t = t.select(F.xxhash64("lang", "original", stripped).alias("k"), "text")
    several = t.groupBy("k").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).where("a <> b").select("k")
    n = t.join(few(checkpoint(several)), "k").groupBy("k", "text").agg(F.count("*").alias("n"))
    best = n.groupBy("k").agg(F.max_by("text", F.struct("n", -F.length("text"), "text")).alias("clean"))
    return n.join(best, "k").where("text <> clean").select(F.col("k").cast("string").alias("key"), F.col("text").alias("garbled"), "clean")


def learn(texts: DataFrame, support: int = 3) -> frozenset:
    """Chains that explain at least ``support`` different keys; the result has at most one row per chain."""
    both = twins(texts).unionByName(text_twins(texts))
    found = both.withColumn("chain", explain_udf("garbled", "clean")).where("chain is not null")
    rows = found.groupBy("chain").agg(F.countDistinct("key").alias("n")).where(F.col("n") >= support).collect()
    return frozenset(r["chain"] for r in rows)


def letter_pairs(texts: DataFrame) -> Pairs:
    """Over all Russian texts; at most a few thousand different pairs reach the driver."""

    def count(batches):
        into: Counter = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                russian_pairs(t, into)
        yield pd.DataFrame({"pair": list(into), "n": list(into.values())}).astype({"pair": "object", "n": "int64"})

    russian = texts.where("lang = 'russian' and text is not null").select("text")
    got = russian.mapInPandas(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return Pairs({r["pair"]: r["n"] for r in got})


def western_turkish(texts: DataFrame) -> DataFrame:
    """Rows with a word of ý ð þ for ı ğ ş whose Turkish reading is a word elsewhere and more often seen than it is."""
    split = F.split("text", r"[^\p{L}\p{M}'’]+")
    tr = texts.where("lang = 'turkish' and text is not null")
    vocabulary = tr.where(F.col("text").rlike("[ığşİĞŞ]")).select(F.explode(F.array_distinct(split)).alias("word"))
    vocabulary = vocabulary.where(F.col("word").rlike("[ığşİĞŞ]")).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    odd = tr.where(F.col("text").rlike("[ýðþÝÐÞ]")).select("tl_id", "field", "text", F.explode(F.array_distinct(split)).alias("odd"))
    odd = odd.where(F.col("odd").rlike("[ýðþÝÐÞ]")).withColumn("word", F.lower(F.translate("odd", "ýðþÝÐÞ", "ığşİĞŞ")))
    return odd.join(vocabulary, "word").select("tl_id", "field", "text").distinct()


def repaired(texts: DataFrame) -> DataFrame:
    """Garbled texts with their restored form and the chain that explains them."""
    learned, pairs = learn(texts), letter_pairs(texts)
    schema = "tl_id long, field string, text string, restored string, chain string"

    def apply(batches):
        for pdf in batches:
            out = []
            for i, f, t in zip(pdf["tl_id"], pdf["field"], pdf["text"]):
                if got := repair(t, learned, pairs):
                    out.append((i, f, t, *got))
            yield pd.DataFrame(out, columns=["tl_id", "field", "text", "restored", "chain"])

    beyond = texts.where(F.col("text").rlike(r"[^\x00-\x7F]")).select("tl_id", "field", "text")
    by_chain = beyond.mapInPandas(apply, schema)
    turkish = western_turkish(texts).select("tl_id", "field", "text", F.translate("text", "ýðþÝÐÞ", "ığşİĞŞ").alias("restored"), F.lit("cp1254>cp1252").alias("chain"))
    both = by_chain.unionByName(turkish)
    # a text of both kinds stays one case
    return both.groupBy("tl_id", "field").agg(F.min_by(F.struct("text", "restored", "chain"), "chain").alias("r")).select("tl_id", "field", "r.*")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(fields(spark, sf_dir)).select("tl_id", "field")


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled texts with the proper text where it can be restored, else null."""
    lost = F.col("restored").contains("�") | (F.col("chain") == "lost")
    return repaired(fields(spark, sf_dir)).select("tl_id", "field", F.when(~lost, F.col("restored")).alias("restored"), "chain")


QUERIES = {"p2_found": p2_found, "p2_restored": p2_restored}
SQL: dict[str, str] = {}
