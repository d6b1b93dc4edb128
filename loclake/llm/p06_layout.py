"""Problem 6: duplicates hidden by formatting differences.

The characters of a whole Arrow batch stream through one skip-and-fold lookup table (0: skip, else the folded letter
or digit) into two rolling polynomial hashes per row; neither canonical strings nor arrays of them are built. A list of named fields is
hashed as the sum of its fields' hashes, so order and notation don't matter. Rows whose hashes collide with the first
row of their group are verified by a two-pointer comparison that skips on both sides; rows that fail it (a hash
collision) are grouped exactly.

Only hashes are shuffled for grouping, pre-aggregated per task. Rows in groups of two or more then fetch their texts:
where they are few (counted) they are broadcast to the texts, else the texts are shuffled once; the first texts come
from those rows themselves. A group with a third of all rows is one row in the aggregate, and its rows are spread by a
salt where they meet their first. Null
texts (and null ids or languages in ``tl_entries``) have no copies.
"""

from __future__ import annotations

import re
import sys
import unicodedata as ud
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loclake.llm.common import checkpoint, few, salted, table

LEAST = 12  # letters and digits that a text of entries needs
HOT, SALTS = 10_000, 32  # rows of a group beyond which they are spread, and over how many copies of the first row
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
NAME = r"[A-Za-z_]\w{0,30}"
QUOTED = re.compile(rf'"({NAME})"\s*:\s*')
FIELD = re.compile(rf"^\W*({NAME})\s*[=:]\s*(.*)$", re.S)
MARKS = re.compile("[̀-゙゚ͯ]")


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Code point -> folded code point of a letter or digit, 0 for all that is skipped."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for cp in range(sys.maxunicode + 1):
        if 0x3400 <= cp < 0x9FFF or 0xAC00 <= cp < 0xD7A4 or 0x20000 <= cp < 0x323B0:
            out[cp] = cp if chr(cp).isalnum() else 0
        elif (ch := chr(cp)).isalnum():
            low = ch.casefold()
            low = low if len(low) == 1 else ch.lower()
            out[cp] = ord(low[0])
    return out


@lru_cache(maxsize=1)
def _powers() -> list[np.ndarray]:
    return [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _power(which: int, n: int) -> np.ndarray:
    have = _powers()
    if len(have[which]) < n:
        with np.errstate(over="ignore"):
            p = np.full(max(n, 4096), BASES[which], np.uint64)
            p[0] = 1
            have[which] = np.cumprod(p, dtype=np.uint64)
    return have[which]


def rolling_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two polynomial hashes and the number of letters and digits of each text."""
    if not texts:
        z = np.empty(0, np.uint64)
        return z, z, np.empty(0, np.int64)
    texts = [ud.normalize("NFC", t) if MARKS.search(t) else t for t in texts]
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths)
    codes = fold_table()[cps]
    keeps = codes > 0
    kept = np.r_[0, np.cumsum(keeps)]
    stop, start = kept[ends], kept[ends - lengths]
    n = stop - start
    # a character's power is the number of kept ones after it in its text; skipped characters add nothing
    after = np.repeat(stop, lengths) - kept[1:]
    out = []
    with np.errstate(over="ignore"):
        codes = (codes.astype(np.uint64) + np.uint64(7)) * np.uint64(0xFF51AFD7ED558CCD)
        for w in (0, 1):
            terms = (codes ^ (codes >> np.uint64(31 + w))) * _power(w, int(n.max()) + 1)[after] * keeps
            total = np.r_[np.uint64(0), np.cumsum(terms, dtype=np.uint64)]
            out.append(total[ends] - total[ends - lengths])
    return out[0], out[1], n


def named_fields(text: str) -> list[tuple[str, str]] | None:
    """Fields of a list in one of its notations: JSON, name=value or name: value with separators, or lines."""
    heads = list(QUOTED.finditer(text))
    if len(heads) >= 2 and not re.search(r"[^\W_]", text[: heads[0].start()]):
        return [(h[1], text[h.end() : (heads[i + 1].start() if i + 1 < len(heads) else len(text))]) for i, h in enumerate(heads)]
    if "=" not in text and ":" not in text:
        return None
    for sep in ("\n", ";", "|"):
        parts = [p for p in text.split(sep) if p.strip()]
        if len(parts) >= 2 and all(ms := [FIELD.match(p) for p in parts]):
            return [(m[1], m[2]) for m in ms]
    return None


def layout_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes under which copies agree: the text's, or the order-free sum over the fields of a list."""
    h1, h2, n = rolling_hashes(texts)
    lists = [(i, f) for i, t in enumerate(texts) if (f := named_fields(t))]
    if lists:
        h1, h2 = h1.copy(), h2.copy()
        flat = [x for _, f in lists for pair in f for x in pair]
        a, b, _ = rolling_hashes(flat)
        at = 0
        with np.errstate(over="ignore"):
            for i, f in lists:
                for h, part in ((h1, a), (h2, b)):
                    name, value = part[at : at + 2 * len(f) : 2], part[at + 1 : at + 2 * len(f) : 2]
                    x = (name * np.uint64(0xC4CEB9FE1A85EC53)) ^ (value + np.uint64(0x9E3779B97F4A7C15))
                    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
                    h[i] = (x ^ (x >> np.uint64(32))).sum(dtype=np.uint64) + np.uint64(len(f))
                at += 2 * len(f)
    return h1.view(np.int64), h2.view(np.int64), n


def same_skipping(a: str, b: str) -> bool:
    """Two pointers, each skipping what isn't a letter or digit."""
    fold, i, j, n, m = fold_table(), 0, 0, len(a), len(b)
    while True:
        x = y = 0
        while i < n and not (x := int(fold[ord(a[i])])):
            i += 1
        while j < m and not (y := int(fold[ord(b[j])])):
            j += 1
        if i >= n or j >= m:
            return i >= n and j >= m
        if x != y:
            return False
        i, j = i + 1, j + 1


def copies(a: str, b: str) -> bool:
    if a == b:
        return True
    fa, fb = named_fields(a), named_fields(b)
    if fa and fb:
        rest = list(fb)
        for name, value in fa:
            k = next((i for i, (x, y) in enumerate(rest) if same_skipping(name, x) and same_skipping(value, y)), None)
            if k is None:
                return False
            rest.pop(k)
        return not rest
    a, b = (ud.normalize("NFC", t) if MARKS.search(t) else t for t in (a, b))
    return same_skipping(a, b)


KEYS = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("n", T.IntegerType())])


@F.pandas_udf(KEYS)
def layout_keys_udf(s: pd.Series) -> pd.DataFrame:
    h1, h2, n = layout_keys(s.fillna("").tolist())
    return pd.DataFrame({"k1": h1, "k2": h2, "n": n.astype(np.int32)})


@F.pandas_udf(T.BooleanType())
def copies_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([copies(x, y) for x, y in zip(a, b)], dtype=bool)


@F.pandas_udf(T.StringType())
def folded_udf(s: pd.Series) -> pd.Series:
    fold = fold_table()
    plain = lambda t: "".join(chr(c) for c in fold[[ord(x) for x in ud.normalize("NFC", t)]] if c)
    return s.map(lambda t: "\n".join(sorted(f"{plain(a)}={plain(b)}" for a, b in f)) if (f := named_fields(t)) else plain(t))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, id, text, within): rows are only compared within the same src and ``within``."""
    e = table(spark, sf_dir, "entries", "entry_id", "text").where("text is not null")
    t = table(spark, sf_dir, "tl_entries", "tl_id", "lang", "translation_id", "original_text").where("lang is not null and translation_id is not null and original_text is not null")
    e = e.select(F.lit("entries").alias("src"), F.col("entry_id").alias("id"), "text", F.lit("").alias("within"))
    # ids are compared folded too; they are letters, digits and "_", so this needs no second pass through Python
    name = F.lower(F.regexp_replace("translation_id", r"[^\p{L}\p{N}]+", ""))
    return e.unionByName(t.select(F.lit("tl_entries").alias("src"), F.col("tl_id").alias("id"), F.col("original_text").alias("text"), F.concat_ws("\0", "lang", name).alias("within")))


def grouped(rows: DataFrame) -> DataFrame:
    """(src, id, first_id) of rows in groups of at least two, the first row itself included."""
    keyed = rows.withColumn("k", layout_keys_udf("text")).where(f"src <> 'entries' or k.n >= {LEAST}")
    hashed = checkpoint(keyed.select("src", "id", F.xxhash64("src", "within", "k.k1").alias("k1"), F.xxhash64("within", "k.k2", "k.n").alias("k2")))
    first = hashed.groupBy("src", "k1", "k2").agg(F.min("id").alias("first_id"), F.count("*").alias("c")).where("c > 1").drop("c")
    met = checkpoint(hashed.join(first, ["src", "k1", "k2"]).select("src", "id", "first_id"))
    held = checkpoint(rows.select("src", "id", "text", "within").join(few(met), ["src", "id"]))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    big = met.groupBy("src", "first_id").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("src", "first_id", F.lit(True).alias("hot"))
    # rows of hot groups meet one of several copies of their first row
    firsts = held.where("id = first_id").select("src", "first_id", F.col("text").alias("first_text"), F.col("within").alias("first_within"))
    firsts = firsts.join(big, ["src", "first_id"], "left").select("src", "first_id", "first_text", "first_within", "hot")
    firsts = firsts.where("hot").select("*", salts).unionByName(firsts.where("hot is null").withColumn("salt", F.lit(0))).drop("hot")
    spread_ = held.join(few(big), ["src", "first_id"], "left").withColumn("salt", F.when(F.col("hot"), salted("id", SALTS)).otherwise(0)).drop("hot")
    same = (F.col("within") == F.col("first_within")) & copies_udf("text", "first_text")
    pairs = checkpoint(spread_.join(firsts, ["src", "first_id", "salt"]).withColumn("same", same).select("src", "id", "first_id", "within", "text", "same"))
    kept = pairs.where("same").select("src", "id", "first_id")
    odd = pairs.where("not same")
    if odd.isEmpty():
        return kept
    exact = odd.select("src", "id", "within", folded_udf("text").alias("f"))
    low = exact.groupBy("src", "within", "f").agg(F.min("id").alias("first_id"))
    return kept.unionByName(exact.join(low, ["src", "within", "f"]).select("src", "id", "first_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(items(spark, sf_dir)).where("id <> first_id").select("src", "first_id", F.col("id").alias("copy_id"))


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record once, with the number of its copies (0 where it has none)."""
    rows = items(spark, sf_dir)
    of = grouped(rows).select("src", "id", "first_id")
    n = of.where("id <> first_id").groupBy("src", "first_id").agg(F.count("*").alias("n_copies"))
    kept = rows.select("src", "id").join(of.where("id <> first_id").select("src", "id"), ["src", "id"], "left_anti")
    return kept.join(n.withColumnRenamed("first_id", "id"), ["src", "id"], "left").select("src", "id", F.coalesce("n_copies", F.lit(0)).alias("n_copies"))


QUERIES = {"p6_found": p6_found, "p6_records": p6_records}
SQL: dict[str, str] = {}
