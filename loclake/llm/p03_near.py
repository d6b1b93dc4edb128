"""Problem 3: near-duplicate records with small edits, over a collection too large for pairwise comparison.

Order MinHash: of a text's occurrence-labelled k-mers (here: pairs of adjacent words) each of ``SKETCHES`` hash
functions takes the ``KEEP`` smallest and writes them down in text order; texts that agree in one such sketch are
candidates. A k-mer that more than ``COMMON`` of the texts hold is drawn in proportion to COMMON / share, at every size
of the table, so that stock phrases rarely decide which texts meet. Two texts of weighted similarity s agree in one
sketch with a probability of about s**KEEP, half of it where their parts changed places: at 0.5 a pair is missed with
about (1 - 0.125)**SKETCHES, 5e-6, in the worst case. Texts may be alike by what is common alone (a template with
little of their own); for texts of which ``TEMPLATE`` or more is common, ``SHARED`` further sketches are drawn from the
common k-mers only, in which such texts are as good as equal.

A sketch that many texts hold is cut into blocks of ``BLOCK`` texts; pairs of blocks are compared in tasks of their
own, so no task has the pairs of a whole hot group and none is left out.

Candidates meet as numbers with bitmaps of their k-mers first, which bound the shared k-mers from above and leave little
but the cases; k-mers are only fetched for what is left, so no candidate that fails carries them through an exchange.
The rest is verified by banded alignment, whose matches bound the number of shared k-mers from below; where that
bound doesn't decide (moved sentences) the k-mer sets are intersected.

Records with the same words form a class of which one record stands for all while candidates are sought; classes are
expanded into pairs at the end, because the result wants pairs of records. Records with null text or fewer than two
words have no k-mers and no partner. An id with several texts (it has one by definition) counts with the smallest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loclake.llm.common import checkpoint, spread, table

#: A k-mer that more than ``COMMON`` of the texts hold weighs less the more of them do.
SKETCHES, SHARED, KEEP, THRESHOLD, BAND, COMMON, TEMPLATE, BLOCK = 90, 20, 2, 0.5, 12, 0.001, 0.6, 128
#: Words of 64 bits of a text's bitmap.
WORDS = 3

_SEEDS = np.random.default_rng(20240501).integers(1, 2**63, SKETCHES + SHARED, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _weights(kmers: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    if not len(common[0]):
        return np.ones(len(kmers))
    at = np.minimum(np.searchsorted(common[0], kmers), len(common[0]) - 1)
    return np.where(common[0][at] == kmers, common[1][at], 1.0)


def order_sketches(lists: list[np.ndarray], common: tuple[np.ndarray, np.ndarray], numbers: range = range(SKETCHES)) -> np.ndarray:
    """(texts, sketches) hashes of each text's ``KEEP`` smallest occurrence-labelled k-mers in text order.

    ``common`` has the sorted k-mers that many texts share and their weights below 1: a k-mer is drawn in proportion
    to its weight, so that stock phrases rarely decide which texts meet. No list may be empty.
    """
    lens = np.array([len(k) for k in lists])
    starts = np.r_[0, np.cumsum(lens)[:-1]]
    label, p = np.zeros(lens.sum(), np.uint64), 0
    for k in lists:
        if len(set(k.tolist())) < len(k):
            seen: Counter = Counter()
            for i, v in enumerate(k.tolist()):
                label[p + i] = seen[v]
                seen[v] += 1
        p += len(k)
    kmers = np.concatenate(lists)
    weight = _weights(kmers, common).astype(np.float32)
    out = np.empty((len(lists), len(numbers)), np.uint64)
    short = lens < KEEP
    with np.errstate(over="ignore"):
        x = _mix(kmers.view(np.uint64) + label * np.uint64(0x9E3779B97F4A7C15))
        for column, no in enumerate(numbers):
            seed = _SEEDS[no]
            draw = -np.log((_mix(x * seed) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24) + np.float32(2.0**-26)) / weight
            picks = []
            for _ in range(KEEP):
                low = np.minimum.reduceat(draw, starts)
                hit = np.flatnonzero(draw == np.repeat(low, lens))
                _, first = np.unique(np.searchsorted(starts, hit, "right"), return_index=True)
                picks.append(hit[first])
                draw[hit[first]] = np.inf
            at = np.sort(np.stack(picks, axis=1), axis=1)
            at[short] = starts[short, None]  # a text of one k-mer
            h = np.full(len(lists), no + 1, np.uint64)
            for j in range(KEEP):
                h = _mix(h * np.uint64(31) + x[at[:, j]])
            out[:, column] = h
    return out.view(np.int64)


def banded_matches(a: list[int], b: list[int], band: int = BAND) -> int:
    """Matches of an alignment whose path stays within ``band`` of the diagonal; equal ends are cut off first."""
    lo, n, m = 0, len(a), len(b)
    while lo < n and lo < m and a[lo] == b[lo]:
        lo += 1
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    same = lo + len(a) - n
    a, b = a[lo:n], b[lo:m]
    if not a or not b:
        return same
    # longest common subsequence by bits: one bit a place of ``a``, cleared where the path gains a match
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    lean, full = len(b) - len(a), (1 << len(a)) - 1
    low, high = -max(0, lean) - band, band - min(0, lean)
    path = full
    for j, x in enumerate(b):
        if hit := at.get(x):
            near = hit & ((1 << max(0, min(len(a), j + high + 1))) - 1) & ~((1 << max(0, j + low)) - 1)
            gain = path & near
            path = ((path + gain) | (path - gain)) & full
    return same + len(a) - path.bit_count()


def similar(a: list[int], b: list[int], threshold: float = THRESHOLD) -> bool:
    """Whether the k-mer sets' similarity reaches the threshold.

    Most candidates share stock phrases only and are rejected by what they have in common at most; the rest is
    aligned, and where the alignment's matches don't decide (moved sentences) the sets do.
    """
    sa, sb = set(a), set(b)
    na, nb = len(sa), len(sb)
    if min(na, nb) < threshold * max(na, nb) or not min(na, nb):
        return False
    both = sum(k in sb for k in a)  # repeated k-mers count twice: an upper bound
    if both < threshold * (na + nb - both):
        return False
    # repeated k-mers can't be told apart in matches: their surplus is taken off
    sure = banded_matches(a, b) - min(len(a) - na, len(b) - nb) if abs(len(a) - len(b)) <= 4 * BAND else 0
    if sure >= threshold * (na + nb - sure):
        return True
    both = len(sa & sb)
    return both >= threshold * (na + nb - both)


@F.pandas_udf(T.BooleanType())
def similar_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similar(x.tolist(), y.tolist()) for x, y in zip(a, b)], dtype=bool)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "fuzzy_matches", "new_id", "new_original", "old_id", "old_original")
    both = f.select(F.inline(F.array(F.struct(F.col("new_id").alias("id"), F.col("new_original").alias("text")), F.struct(F.col("old_id").alias("id"), F.col("old_original").alias("text")))))
    return both.where("id is not null and text is not null").groupBy("id").agg(F.min("text").alias("text"))


def classes(recs: DataFrame) -> DataFrame:
    """id, class_id (the smallest id with the same words) and, on the class's own row, its number and k-mers."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    w = recs.select("id", words.alias("w")).where("size(w) > 1").withColumn("same", F.md5(F.concat_ws(" ", "w")))
    first = w.groupBy("same").agg(F.min("id").alias("class_id"))
    kmers = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1)))
    own = F.col("id") == F.col("class_id")
    return w.join(first, "same").select("id", "class_id", F.when(own, F.monotonically_increasing_id()).alias("no"), F.when(own, kmers).alias("kmers"))


def common_kmers(reps: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """K-mers of at least ``COMMON`` of the texts and their weights; there are at most (k-mers a text) / COMMON."""
    least = max(COMMON * reps.count(), 2.0)
    n = reps.select(F.explode(F.array_distinct("kmers")).alias("k")).groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > least)
    got = n.toPandas().sort_values("k")
    return got["k"].to_numpy(np.int64), least / got["n"].to_numpy(float)


def _sketch_rows(batches: Iterator[pa.RecordBatch], common: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(no, kmers) to (no, sketch); a sketch's number is part of its hash."""
    for batch in batches:
        if not batch.num_rows:
            continue
        no = batch.column("no").to_numpy(zero_copy_only=False)
        lists = [np.asarray(k, np.int64) for k in batch.column("kmers").to_numpy(zero_copy_only=False)]
        rows = [(no, order_sketches(lists, common))]
        ends = np.cumsum([len(k) for k in lists])
        flat = np.concatenate(lists)
        held = [k[w < 1] for k, w in zip(lists, np.split(_weights(flat, common), ends[:-1]))]
        some = [i for i, (k, c) in enumerate(zip(lists, held)) if len(c) >= TEMPLATE * len(k)]
        if some:
            rows.append((no[some], order_sketches([held[i] for i in some], common, range(SKETCHES, SKETCHES + SHARED))))
        for n, h in rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(n, h.shape[1])), pa.array(h.ravel())], names=["no", "sketch"])


@lru_cache(maxsize=None)
def _pairs_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


MET = pa.schema([("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())), ("sketch", pa.int64()), ("block", pa.int64()), ("members", pa.list_(pa.int64()))])


def meetings(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Texts in order of sketches to rows with lists of candidates (a < b), distinct within a list.

    At most ``most`` texts of a sketch are held at once. Where there are more, each block of them gives its own pairs
    and itself as a row (sketch, block, members), to meet the sketch's other blocks.
    """
    rest_s, rest_n, last, block = np.empty(0, np.int64), np.empty(0, np.int64), None, 0

    def flush(s: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal last, block
        alone = np.r_[True, s[1:] != s[:-1]] & np.r_[s[1:] != s[:-1], True] & (s != last if last is not None else True)
        s, n = s[~alone], n[~alone]
        if not len(s):
            return
        known, place = np.unique(n, return_inverse=True)
        begins = np.r_[0, np.flatnonzero(np.diff(s)) + 1]
        sizes = np.diff(np.r_[begins, len(s)])
        pairs, blocks = [], []

        def meet(groups: np.ndarray) -> None:
            i, j = _pairs_of(groups.shape[1])
            a, b = groups[:, i].ravel(), groups[:, j].ravel()
            pairs.append(np.minimum(a, b) * len(known) + np.maximum(a, b))

        by_size = np.argsort(sizes, kind="stable")
        for of_size in np.split(by_size, np.flatnonzero(np.diff(sizes[by_size])) + 1):
            if 1 < (size := int(sizes[of_size[0]])) <= most:
                meet(place[begins[of_size][:, None] + np.arange(size)])
        more = np.flatnonzero(sizes > most)
        if s[0] == last and (not len(more) or more[0]):
            more = np.r_[0, more]  # the end of a sketch of which blocks are out
        for k in more:
            if s[begins[k]] != last:
                last, block = s[begins[k]], 0
            for at in range(begins[k], begins[k] + sizes[k], most):
                end = min(at + most, begins[k] + sizes[k])
                if sizes[k] > most:
                    meet(place[None, at:end])
                blocks.append((int(last), block, n[at:end]))
                block += 1
        if pairs:
            codes = np.sort(np.concatenate(pairs))
            codes = codes[np.r_[True, codes[1:] != codes[:-1]]]
            x, y = codes // len(known), codes % len(known)
            ab = [pa.array([known[z[x < y]]], pa.list_(pa.int64())) for z in (x, y)]
            yield pa.RecordBatch.from_arrays([*ab, *[pa.nulls(1, t) for t in MET.types[2:]]], schema=MET)
        for key, no, part in blocks:
            none = [pa.nulls(1, t) for t in MET.types[:2]]
            yield pa.RecordBatch.from_arrays([*none, pa.array([key]), pa.array([no]), pa.array([part], pa.list_(pa.int64()))], schema=MET)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    for batch in batches:
        held.append((batch.column("sketch").to_numpy(zero_copy_only=False), batch.column("no").to_numpy(zero_copy_only=False)))
        waiting += batch.num_rows
        if waiting < 200_000:
            continue
        s, n = np.concatenate([rest_s, *[x for x, _ in held]]), np.concatenate([rest_n, *[x for _, x in held]])
        # the last sketch may go on, but whole blocks of it needn't wait
        cut = int(np.searchsorted(s, s[-1]))
        cut += (len(s) - cut) // most * most
        yield from flush(s[:cut], n[:cut]) if cut else ()
        rest_s, rest_n, held, waiting = s[cut:], n[cut:], [], 0
    s, n = np.concatenate([rest_s, *[x for x, _ in held]]), np.concatenate([rest_n, *[x for _, x in held]])
    if len(s):
        yield from flush(s, n)


def candidates(reps: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of numbers of texts that agree in a sketch."""
    common = common_kmers(reps)
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = spread(reps.select("no", "kmers")).mapInArrow(lambda batches: _sketch_rows(batches, common), "no long, sketch long")
    met = s.repartition(n, "sketch").sortWithinPartitions("sketch").mapInArrow(meetings, "a array<long>, b array<long>, sketch long, block long, members array<long>")
    met = checkpoint(met)
    blocks = met.where("members is not null").select("sketch", "block", "members")
    other = blocks.toDF("sketch", "block_b", "others")
    across = blocks.join(other, "sketch").where("block < block_b").select(F.explode("members").alias("x"), "others").select("x", F.explode("others").alias("y"))
    across = across.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    within = met.where("a is not null").select(F.inline(F.arrays_zip("a", "b")))
    # by one end, where the bitmaps join
    return within.unionByName(across).repartition("a").distinct()


def bitmaps(reps: DataFrame) -> DataFrame:
    """no, n (distinct k-mers), more (k-mers beyond the bits they set) and the bits as numbers m0, m1, ..."""
    each = [F.expr(f"aggregate(ks, 0L, (s, k) -> s | if(pmod(k div 64, {WORDS}) = {w}, shiftleft(1L, cast(pmod(k, 64) as int)), 0L))").alias(f"m{w}") for w in range(WORDS)]
    held = reps.select("no", F.array_distinct("kmers").alias("ks")).select("no", F.size("ks").alias("n"), *each)
    return held.select("no", "n", (F.col("n") - sum(F.bit_count(f"m{w}") for w in range(WORDS))).alias("more"), *[f"m{w}" for w in range(WORDS)])


def possible(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) that may reach the threshold: a text has at most as many k-mers in the other as bits in common,
    and those of its k-mers that share a bit."""
    marks = bitmaps(reps)
    left, right = marks.toDF("a", *[f"{c}_a" for c in marks.columns[1:]]), marks.toDF("b", *[f"{c}_b" for c in marks.columns[1:]])
    both = sum(F.bit_count(F.col(f"m{w}_a").bitwiseAND(F.col(f"m{w}_b"))) for w in range(WORDS)) + F.least("more_a", "more_b")
    return pairs.join(left, "a").join(right, "b").where(both >= THRESHOLD * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def similar_classes(members: DataFrame) -> DataFrame:
    """Verified pairs of classes, by their ids."""
    reps = members.where("kmers is not null").select("no", "class_id", "kmers")
    left, right = reps.toDF("a", "class_a", "ka"), reps.toDF("b", "class_b", "kb")
    met = possible(candidates(reps), reps).join(left, "a").join(right, "b").where(similar_udf("ka", "kb"))
    return met.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b"))


def near_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    members = checkpoint(classes(records(spark, sf_dir)))
    return members.select("id", "class_id"), checkpoint(similar_classes(members))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, pairs = near_pairs(spark, sf_dir)
    a, b = members.toDF("x", "a"), members.toDF("y", "b")
    across = pairs.join(a, "a").join(b, "b").select("x", "y")
    within = a.join(b, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record: its class (records with the same words) and how many other classes are similar to it."""
    members, pairs = near_pairs(spark, sf_dir)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    return members.join(ends, "class_id", "left").select("id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components (vertex, component = its smallest vertex).

    Each round takes the smallest label among a vertex and its neighbours and then that label's own label (pointer
    jumping), so that labels travel twice as far with each round. Every round is cut off at a checkpoint.
    """
    v = vertices.toDF("v")
    sym = checkpoint(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w"))))
    labels, changed = checkpoint(v.select("v", F.col("v").alias("label"))), 1
    while changed:
        near = sym.join(labels.withColumnRenamed("v", "w"), "w").groupBy("v").agg(F.min("label").alias("near"))
        low = labels.join(near, "v", "left").select("v", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        of = low.select(F.col("v").alias("low"), F.col("low").alias("lower"))
        new = checkpoint(low.join(of, "low", "left").select("v", F.col("label").alias("old"), F.coalesce("lower", "low").alias("label")))
        changed = new.where("old <> label").count()
        labels = new.select("v", "label")
    return labels.select(F.col("v").alias(vertices.columns[0]), F.col("label").alias("component"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of records that similarity connects: id and the group's smallest class."""
    members, pairs = near_pairs(spark, sf_dir)
    of = components(members.select("class_id").distinct(), pairs).withColumnRenamed("component", "group_id")
    return members.join(of, "class_id").select("id", "group_id")


QUERIES = {"p3_found": p3_found, "p3_links": p3_links, "p3_groups": p3_groups}
SQL: dict[str, str] = {}
