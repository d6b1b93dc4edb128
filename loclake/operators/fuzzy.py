"""Fuzzy recovery of old translations, and translation memory.

The score is the ratio of matching blocks (2·matches / length, as in Python's difflib). Every new text meets every old
one; bounds that lose nothing (lengths, common grams, the common subsequence) say which pairs are scored.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loclake.functions.text import normalized
from loclake.operators.relational import keep_first, pair_up
from loclake.session import checkpoint


def ratio(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype=float)


def similarity(a: Column, b: Column) -> Column:
    return ratio_udf(normalized(a), normalized(b))


def length_bound(a: Column, b: Column) -> Column:
    """No score is higher: all of the shorter text matches."""
    return 2.0 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))


def letters_of(x: Column) -> Column:
    """How often each letter a to z occurs, and all other characters together."""
    plain = F.regexp_replace(x, "[^a-z]", "")
    each = F.transform(F.sequence(F.lit(97), F.lit(122)), lambda i: F.length(plain) - F.length(F.replace(plain, F.char(i), F.lit(""))))
    return F.concat(each, F.array(F.length(x) - F.length(plain)))


def letter_bound(bag_a: Column, bag_b: Column, both_lengths: Column) -> Column:
    """No score is higher: matches are common characters, counted with repeats."""
    both = F.aggregate(F.zip_with(bag_a, bag_b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return 2.0 * both / both_lengths


def percent(score: Column) -> Column:
    return F.floor(score * 100).cast("int")


#: Length of the shared grams, places they are hashed to, and words of one block's tables (characters · old texts · words of bits).
GRAM, PLACES, CELLS = 4, 2048, 4_000_000
#: Grams and their places for the pairs that are left.
FINE, FINE_PLACES = (3, 4), 65_536
#: Most old texts of a block: short ones, which are the lanes of one alignment, and long ones; pairs that are bounded at once.
LANES, ROWS, AT_ONCE = 16_000, 4000, 2_000_000
#: Texts of a tile of new and of old ones; least number of tiles of the new texts, so that small inputs are compared in
#: parallel too. Old texts are the lanes of the alignment and stay together.
TILE, OLD_TILE, TILES = 10_000, 60_000, 24
#: difflib treats characters of a second text of this length as popular where they are frequent, and starts no match at them.
JUNK_FROM = 200
#: Places characters are counted in; below so many texts each is aligned alone.
BAG, ALONE = 32, 60
_BITS = 62
_WORD = (1 << _BITS) - 1


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all characters of the texts: the code, the text and the place within it."""
    sizes = np.array([*map(len, texts)])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.repeat(np.arange(len(texts)), sizes), np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _dense(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes that occur, in order, and the number of each code's one among them."""
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    chars, at = np.flatnonzero(seen), np.zeros(0x110000, np.int32)
    at[chars] = np.arange(len(chars))
    return chars, at[codes]


def _unpopular(texts: list[str]) -> np.ndarray:
    """Characters of each text at which difflib can start a match, were it a long second text."""
    codes, text, _ = _flat(texts)
    chars, char = _dense(codes)
    out, most = np.zeros(len(texts), np.int64), np.array([len(x) // 100 + 1 for x in texts])
    step = max(1, AT_ONCE // max(1, len(chars)))
    for start in range(0, len(texts), step):
        lo, hi = np.searchsorted(text, [start, start + step])
        n = np.bincount((text[lo:hi] - start) * len(chars) + char[lo:hi], minlength=step * len(chars)).reshape(step, -1)[: len(texts) - start]
        out[start : start + step] = np.where(n <= most[start : start + step, None], n, 0).sum(axis=1)
    return out


def _places(texts: list[str], gram: int, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all grams of the texts: the place the gram is hashed to, the text and where it begins."""
    codes, text, at = _flat(texts)
    n = max(0, len(codes) - gram + 1)
    h = np.zeros(n, np.uint64)
    for j in range(gram):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[j : n + j]
    h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(places)
    inside = text[:n] == text[gram - 1 :]
    return h[inside].astype(np.int32), text[:n][inside], at[:n][inside]


class _Grams:
    """How often each place is hit by a text's grams."""

    def __init__(self, texts: list[str]):
        self.place, self.text, _ = _places(texts, GRAM, PLACES)

    def of(self, start: int, stop: int) -> np.ndarray:
        lo, hi = np.searchsorted(self.text, [start, stop])
        cells = (self.text[lo:hi] - start) * PLACES + self.place[lo:hi]
        return np.bincount(cells, minlength=(stop - start) * PLACES).reshape(stop - start, PLACES).astype(np.float32)


def common_subsequence(a: str, b: str) -> int:
    at: dict[str, int] = {}
    for j, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    for c in a:
        m = at.get(c)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(b) - v.bit_count()


def _bags(texts: list[str]) -> np.ndarray:
    """How often characters occur, by their code's place: characters that share one are taken for equal."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    flat = np.repeat(np.arange(len(texts)) * BAG, [*map(len, texts)]) + codes % BAG
    return np.minimum(np.bincount(flat, minlength=len(texts) * BAG), 32_767).reshape(len(texts), BAG).astype(np.int16)


class _Fine:
    """Counts of an old text's grams that a new text holds, by finer places, for the few pairs that the coarse ones leave."""

    def __init__(self, texts: list[str], blocks: np.ndarray):
        self.blocks, self.places, self.held = blocks, [], np.zeros(FINE_PLACES + 1, bool)
        for gram in FINE:
            place, text, at = _places(texts, gram, FINE_PLACES)
            self.places.append(np.full((len(texts), max(map(len, texts))), FINE_PLACES, np.int32))
            self.places[-1][text, at] = place

    @staticmethod
    def of(a: str) -> list[np.ndarray]:
        return [_places([a], gram, FINE_PLACES)[0] for gram in FINE]

    def keep(self, a: list[np.ndarray], which: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Those of ``which`` that may match the text of the places ``a`` in as many characters as they need."""
        for gram, places, mine in zip(FINE, self.places, a):
            self.held[mine] = True
            which = which[self.held[places[which]].sum(axis=1) >= need[which] - (gram - 1) * self.blocks[which]]
            self.held[mine] = False
        return which


class _Split:
    """Bounds of the common subsequences of one text with a block of short ones, a word of bits for each.

    Characters are dealt into classes that hold about a word of every text. The characters of a common subsequence that
    are of one class are common to both texts' characters of that class, so it isn't longer than all classes' longest
    together.
    """

    def __init__(self, texts: list[str]):
        codes, text, _ = _flat(texts)
        codes, char = _dense(codes)
        n = np.bincount(char, minlength=len(codes))
        self.rows, self.kind = {chr(c): i for i, c in enumerate(codes.tolist())}, np.zeros(len(codes), np.int64)
        load = np.zeros(max(1, -(-max(map(len, texts)) // 58)))
        for c in np.argsort(-n, kind="stable"):
            self.kind[c] = load.argmin()
            load[self.kind[c]] += n[c]
        own, j = text * len(load) + self.kind[char], np.empty(len(text), np.int64)
        for k in range(len(load)):
            here = np.flatnonzero(self.kind[char] == k)
            size = np.bincount(text[here], minlength=len(texts))
            j[here] = np.arange(len(here)) - np.repeat(np.cumsum(size) - size, size)
        cell, fit = char.astype(np.int64) * len(texts) + text, j < 64
        self.bits, self.counts = np.zeros((len(codes), len(texts)), np.uint64), np.zeros((len(codes), len(texts)), np.uint8)
        np.bitwise_or.at(self.bits.reshape(-1), cell[fit], np.uint64(1) << j[fit].astype(np.uint64))
        np.add.at(self.counts.reshape(-1), cell, np.uint8(1))
        # characters beyond the word count as matched
        self.over = np.bincount(own[~fit], minlength=len(texts) * len(load)).reshape(len(texts), len(load)).T.astype(np.int16)

    def keep(self, a: str, which: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Those of ``which`` that may have a common subsequence with ``a`` of as many characters as they need."""
        steps: list[list[int]] = [[] for _ in self.over]
        for c in a:
            if (r := self.rows.get(c)) is not None:
                steps[self.kind[r]].append(r)
        lo, hi = which[0], which[-1] + 1
        need, most = need[lo:hi], np.zeros((len(steps), hi - lo), np.int16)
        for m, s in zip(most, steps):
            for r, n in Counter(s).items():
                m += np.minimum(self.counts[r, lo:hi], min(n, 255))
        bound, lanes, bits, over = most.sum(axis=0, dtype=np.int16), np.arange(lo, hi), self.bits[:, lo:hi], self.over[:, lo:hi]
        for k, s in enumerate(steps):
            go = bound >= need
            if (n := np.count_nonzero(go)) < 0.7 * len(go):
                if not n:
                    return lanes[:0]
                lanes, need, bound, most = lanes[go], need[go], bound[go], most[:, go]
                bits, over = self.bits, self.over[:, lanes]
            table = {r: bits[r] if len(lanes) == bits.shape[1] else bits[r].take(lanes) for r in set(s)}
            v = np.full(len(lanes), ~np.uint64(0))
            u, t = np.empty_like(v), np.empty_like(v)
            for r in s:
                m = table[r]
                np.bitwise_and(v, m, out=u)
                np.add(v, u, out=t)
                np.bitwise_xor(v, u, out=v)
                np.bitwise_or(v, t, out=v)
            bound += np.minimum(64 - np.bitwise_count(v).astype(np.int16) + over[k], most[k]) - most[k]
        return lanes[bound >= need]


class _Aligner:
    """Longest common subsequences of one text with a block of others, bit-parallel; matching blocks are never longer."""

    def __init__(self, texts: list[str]):
        self.texts, self.sizes = texts, np.array([*map(len, texts)])
        self.words = max(1, -(-int(self.sizes.max()) // _BITS))

    @cached_property
    def table(self) -> tuple[dict[str, int], np.ndarray]:
        """Place of each character, and where the texts have it: (characters, words, texts)."""
        codes, text, j = _flat(self.texts)
        codes, char = _dense(codes)
        bits = np.zeros((len(codes), self.words, len(self.texts)), np.int64)
        np.add.at(bits.reshape(-1), (char.astype(np.int64) * self.words + j // _BITS) * len(self.texts) + text, np.int64(1) << j % _BITS)
        return {chr(c): i for i, c in enumerate(codes.tolist())}, bits

    def lengths(self, a: str, which: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Of the old texts ``which``; a length below the text's ``need`` may be given too small.

        A subsequence of ``need`` characters strays from the diagonal by at most what either text has beyond it, so only
        words of bits within that band are worked on; texts that the rest of ``a`` can't bring to their need are dropped.
        """
        if len(which) < ALONE:
            return np.array([common_subsequence(a, self.texts[j]) for j in which], np.int64)
        sizes, (at, table) = self.sizes[which], self.table
        ahead, behind = int((sizes - need).max()) + 1, int(len(a) - need.min()) + 1
        out, left = np.zeros(len(which), np.int64), np.arange(len(which))
        v = np.full((self.words, len(which)), _WORD, np.int64)
        u, t, rows = np.empty_like(v), np.empty_like(v), {}
        looks = {len(a) * k // 16 for k in (6, 8, 10, 12, 14)}
        for p, c in enumerate(a):
            if p in looks:
                go = (_BITS - np.bitwise_count(v).astype(np.int64)).sum(axis=0) + (len(a) - p) >= need[left]
                if (n := np.count_nonzero(go)) < 0.8 * len(left):
                    if not n:
                        return out
                    left, v, rows = left[go], np.ascontiguousarray(v[:, go]), {}
                    u, t = np.empty_like(v), np.empty_like(v)
            k = at.get(c)
            if k is None:
                continue
            if k not in rows:
                rows[k] = table[k][:, which[left]]
            lo, hi = max(0, p - behind) // _BITS, min(self.words, (p + ahead) // _BITS + 1)
            if lo >= hi:
                continue
            x, y, z = v[lo:hi], u[lo:hi], t[lo:hi]
            np.bitwise_and(x, rows[k][lo:hi], out=y)
            np.add(x, y, out=z)
            np.bitwise_xor(x, y, out=x)
            for w in range(1, hi - lo):
                np.right_shift(z[w - 1], _BITS, out=y[w])
                np.add(z[w], y[w], out=z[w])
            np.bitwise_and(z, _WORD, out=z)
            np.bitwise_or(x, z, out=x)
        out[left] = (_BITS - np.bitwise_count(v).astype(np.int64)).sum(axis=0)
        return out


def similar_pairs(new: list[str], old: list[str], threshold: float, best: bool = False) -> list[tuple[str, str, float]]:
    """All pairs of at least the threshold; with ``best``, of each new text those of its highest score alone.

    Pairs are only left out by bounds that no pair above it fails:

    * the matching blocks are a common subsequence, which covers ``threshold`` of both lengths, and common characters;
    * in an old text of ``JUNK_FROM`` characters or more each block but the first holds an unpopular character of it, so
      there are few blocks, and all but ``GRAM - 1`` of each block's characters begin a common gram;
    * in shorter ones the classes of the characters bound the common subsequence before it is aligned.
    """
    new, old = sorted(new, key=len), sorted(old, key=len)
    sizes, at = np.array([*map(len, new)]), 0
    top, found = np.full(len(new), threshold), [[] for _ in new]
    new_bags, grams, fines = _bags(new), None, {}
    while at < len(old):
        # a block of old texts of about the same length
        end, long, chars = at + 1, len(old[at]) >= JUNK_FROM, set(old[at])
        while end < len(old) and end - at < (ROWS if long else LANES) and (len(old[end]) < JUNK_FROM or long):
            chars |= set(old[end])
            if max(30, len(chars)) * (end + 1 - at) * -(-len(old[end]) // _BITS) > CELLS:
                break
            end += 1
        block = old[at:end]
        at = end
        ln = np.array([*map(len, block)])
        lo = np.searchsorted(sizes, int(ln[0] * threshold / (2 - threshold)))
        hi = np.searchsorted(sizes, int(ln[-1] * (2 - threshold) / threshold) + 1, "right")
        if lo == hi:
            continue
        if long:
            # lengths and numbers of blocks are further columns of the product, which is then at least 0
            grams = grams or _Grams(new)
            held, blocks = (_Grams(block).of(0, len(block)) > 0).astype(np.float32), _unpopular(block) + 1
            held = np.hstack([held, np.stack([ln, (GRAM - 1) * blocks, np.ones(len(ln))], axis=1).astype(np.float32)])
            slack = 0.01 + 1e-5 * (int(ln[-1]) + int(sizes[-1]))
        bags, fine, split, aligner = _bags(block), None, None, None
        step = max(1, AT_ONCE // len(block))
        for start in range(lo, hi, step):
            stop, rows = min(start + step, hi), None
            if long:
                half = top[start:stop] / 2
                mine = np.stack([-half, np.ones(stop - start), -half * sizes[start:stop]], axis=1).astype(np.float32)
                may = np.hstack([grams.of(start, stop), mine]) @ held.T >= -slack
                rows = np.flatnonzero(may.any(axis=1))
            for i in range(stop - start) if rows is None else rows:
                need = top[start + i] * (sizes[start + i] + ln) / 2 - 1e-6
                which = np.flatnonzero((need <= np.minimum(sizes[start + i], ln)) & (may[i] if long else True))
                if not len(which):
                    continue
                if long:
                    fine = fine or _Fine(block, blocks)
                    if start + i not in fines:
                        fines[start + i] = fine.of(new[start + i])
                    which = fine.keep(fines[start + i], which, need)
                else:
                    split = split or _Split(block)
                    which = split.keep(new[start + i], which, need)
                if len(which) and long and ln[-1] < 32_767:
                    which = which[np.minimum(bags[which], new_bags[start + i]).sum(axis=1) >= need[which]]
                if not len(which):
                    continue
                aligner = aligner or _Aligner(block)
                n = aligner.lengths(new[start + i], which, need[which])
                total = sizes[start + i] + ln[which]
                keep = n >= need[which]
                which, n, total = which[keep], n[keep], total[keep]
                bound = np.where(total > 0, 2 * n / np.maximum(1, total), 1) + 1e-9
                order = np.argsort(-bound, kind="stable") if best else np.arange(len(which))
                for j, most in zip(which[order], bound[order]):
                    if best and most < top[start + i]:
                        break
                    r = ratio(new[start + i], block[j])
                    if best and r > top[start + i]:
                        top[start + i], found[start + i] = r, []
                    if r >= top[start + i]:
                        found[start + i].append((block[j], r))
    return [(x, *f) for x, fs in zip(new, found) for f in fs]


def scored_pairs(new: DataFrame, old: DataFrame, threshold: float, keys: tuple[str, ...] = (), best: bool = False) -> DataFrame:
    """Distinct texts k of new and ok of old (within equal keys) whose similarity reaches the threshold: all of them, or
    with ``best`` at least those of each new text's highest score.

    Every new text meets every old one whose length allows it, tile by tile, so the work grows with the product of both sides.
    """
    n, o = checkpoint(new.where("k is not null").select(*keys, "k").distinct()), checkpoint(old.where("ok is not null").select(*keys, "ok").distinct())
    tn, to = max(TILES, -(-n.count() // TILE)), max(1, -(-o.count() // OLD_TILE))
    tile = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    n = n.withColumn("i", tile("k", tn)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(to - 1))))
    o = o.withColumn("j", tile("ok", to)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(tn - 1))))
    by = [*keys, "i", "j"]

    def compare(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        got = similar_pairs(a["k"].tolist(), b["ok"].tolist(), threshold, best) if len(a) and len(b) else []
        return pd.DataFrame([(*key[: len(keys)], *g) for g in got], columns=[*keys, "k", "ok", "similarity"])

    types = {f.name: f.dataType for f in n.schema}
    schema = T.StructType([*[T.StructField(c, types[c]) for c in keys], T.StructField("k", T.StringType()), T.StructField("ok", T.StringType()), T.StructField("similarity", T.DoubleType())])
    # more partitions than tiles, so that few of them get two
    parts = max(int(n.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(8 * tn * to, 1000))
    return n.repartition(parts, *by).groupBy(*by).cogroup(o.repartition(parts, *by).groupBy(*by)).applyInPandas(compare, schema)


#: Scored pairs that the driver may hold to finish the assignment.
FEW = 100_000


def one_to_one(pairs: DataFrame) -> DataFrame:
    """Of the pairs (new_id, old_id, similarity) the best, then the best of those whose ends are both free, and so on.

    A pair is taken as soon as no better one touches either end; rounds go on until no pair is left, the last of them
    on the driver, where few pairs remain. Ties go to the smaller new id, then to the smaller old id.
    """
    spark, left, taken = pairs.sparkSession, checkpoint(pairs.withColumn("_d", -F.col("similarity"))), []
    while left.count() > FEW:
        order = F.struct("_d", "new_id", "old_id")
        a = left.groupBy("new_id").agg(F.min(order).alias("b")).select("b.*")
        b = left.groupBy("old_id").agg(F.min(order).alias("b")).select("b.new_id", "b.old_id")
        now = checkpoint(a.join(b, ["new_id", "old_id"]))
        taken.append(now.select("new_id", "old_id", (-F.col("_d")).alias("similarity")))
        left = checkpoint(left.join(now.select("new_id"), "new_id", "left_anti").join(now.select("old_id"), "old_id", "left_anti"))
    done_new, done_old, out = set(), set(), []
    for r in sorted(left.select("_d", "new_id", "old_id").collect()):
        if r["new_id"] not in done_new and r["old_id"] not in done_old:
            done_new.add(r["new_id"])
            done_old.add(r["old_id"])
            out.append((r["new_id"], r["old_id"], -r["_d"]))
    schema = T.StructType([pairs.schema["new_id"], pairs.schema["old_id"], T.StructField("similarity", T.DoubleType())])
    result = spark.createDataFrame(out, schema)
    for x in taken:
        result = result.unionByName(x)
    return result


def match(new: DataFrame, old: DataFrame, threshold: float = 0.7, auto: float = 0.9) -> DataFrame:
    """Best old text of each new one: new (new_id, new_original), old (old_id, old_original, old_translation).

    Equal texts pair up first, one to one. Of the rest all pairs of at least ``threshold`` are scored and assigned one
    to one, the most similar first, until no pair of free texts is left. Ties go to the smaller ids.
    """
    keyed = lambda df, c, k: df.withColumn(k, normalized(F.col(c)))
    n, o = keyed(new, "new_original", "k"), keyed(old, "old_original", "ok")
    exact = pair_up(n, o.withColumnRenamed("ok", "k"), "k", "new_id", "old_id").withColumn("similarity", F.lit(1.0))
    n, o = n.join(exact.select("new_id"), "new_id", "left_anti"), o.join(exact.select("old_id"), "old_id", "left_anti")
    scored = scored_pairs(n, o, threshold)
    pairs = scored.join(n.select("new_id", "k"), "k").join(o.select("old_id", "ok"), "ok").select("new_id", "old_id", "similarity")
    best = one_to_one(pairs).join(n.select("new_id", "new_original"), "new_id").join(o.select("old_id", "old_original", "old_translation"), "old_id")
    cols = ["new_id", "new_original", "old_id", "old_original", "old_translation", "similarity"]
    out = exact.select(*cols).unionByName(best.select(*cols))
    return out.withColumn("auto_apply", F.col("similarity") >= auto)


def report(matches: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
    """Matches to apply and to review, and what stayed alone on either side, in one row."""
    matches = checkpoint(matches.select("new_id", "old_id", "auto_apply"))
    a = matches.agg(F.count_if("auto_apply").alias("auto"), F.count_if(~F.col("auto_apply")).alias("review"))
    b = new.join(matches, "new_id", "left_anti").agg(F.count("*").alias("unmatched_new"))
    c = old.join(matches, "old_id", "left_anti").agg(F.count("*").alias("unmatched_old"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(a).join(one(b), "_k").join(one(c), "_k").drop("_k")


def memory_lookup(texts: DataFrame, memory: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Translation, confidence and source of each text: an equal text of the memory (its smallest id), else the most
    similar one of the language at ``threshold`` or more (ties by text), else none.

    texts (lang, original, ...), memory (lang, entry_id, original, translation); rows without text or language have none.
    """
    first = keep_first(memory.where("translation is not null and original is not null"), ["lang", "original"], ["entry_id"], ["entry_id", "translation"])
    out = texts.join(first, ["lang", "original"], "left")
    open_ = out.where("entry_id is null and original is not null").select("lang", normalized(F.col("original")).alias("k"))
    known = first.withColumn("ok", normalized(F.col("original")))
    scored = scored_pairs(open_, known, threshold, ("lang",), best=True)
    best = scored.groupBy("lang", "k").agg(F.min_by(F.struct("ok", "similarity"), F.struct(-F.col("similarity"), "ok")).alias("b")).select("lang", "k", "b.*")
    near = best.join(keep_first(known.select("lang", "ok", "entry_id", "translation"), ["lang", "ok"], ["entry_id"], ["entry_id", "translation"]), ["lang", "ok"])
    near = near.select("lang", "k", F.col("translation").alias("_t"), F.col("similarity").alias("_s"))
    out = out.withColumn("k", normalized(F.col("original"))).join(near, ["lang", "k"], "left")
    equal = F.col("entry_id").isNotNull()
    return out.withColumns({
        "confidence": F.when(equal, 1.0).otherwise(F.col("_s")), "source": F.when(equal, "exact").when(F.col("_s").isNotNull(), "fuzzy"),
        "translation": F.coalesce("translation", F.when(~equal | F.col("entry_id").isNull(), F.col("_t"))),
    }).drop("k", "_t", "_s")


def ranked(matches: DataFrame) -> DataFrame:
    """Matches with their place, the most similar first; equal ones by the new id."""
    return matches.orderBy(F.desc("similarity"), "new_id")
