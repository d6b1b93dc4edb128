"""Joins, keep-first rules, packing and other set operations of the localization flow."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loclake.session import checkpoint

#: Rows a small dimension (glossary, rules, languages) may have to be broadcast by hint.
SMALL = 10_000


def small(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """A broadcast hint only where the table's size is checked; else the planner decides by statistics."""
    return F.broadcast(df) if len(df.limit(limit + 1).take(limit + 1)) <= limit else df


def keep_first(df: DataFrame, keys: list[str], order: list[str], value_columns: list[str] | None = None) -> DataFrame:
    """One row per key, the first by ``order``. An aggregate with map-side combine, so a hot key costs no sort."""
    rest = value_columns or [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def missing_texts(new: DataFrame, known: DataFrame, key: str = "text", order: list[str] | None = None) -> DataFrame:
    """Rows whose key the known table lacks, each key once (the first by ``order``)."""
    out = new.join(known.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return keep_first(out, [key], order) if order else out.dropDuplicates([key])


def attach_translations(entries: DataFrame, by_id: DataFrame, by_text: DataFrame) -> DataFrame:
    """Translation by id, else by text, else the existing one; an empty one by id doesn't count.

    ``by_id`` (translation_id, translation) and ``by_text`` (original_text, translation) must be unique in their keys.
    """
    a = by_id.select("translation_id", F.col("translation").alias("_by_id"))
    b = by_text.select("original_text", F.col("translation").alias("_by_text"))
    out = entries.join(a, "translation_id", "left").join(b, "original_text", "left")
    chosen = F.coalesce(F.nullif("_by_id", F.lit("")), F.nullif("_by_text", F.lit("")), "translated_text")
    return out.withColumn("translated_text", chosen).drop("_by_id", "_by_text")


def first_context(contexts: DataFrame) -> DataFrame:
    return keep_first(contexts, ["text"], ["seq"])


def pair_up(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """One-to-one matching of equal keys in id order: the n-th on the left with the n-th on the right."""
    number = lambda df, i: df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(i)))
    return number(left, left_id).join(number(right, right_id), [key, "_n"]).drop("_n")


def fan_out(requests: DataFrame, translated: DataFrame, key: str = "text") -> DataFrame:
    """Results of unique texts joined back to every request."""
    return requests.join(translated, key, "left")


def prefer(df: DataFrame, key: str, order: str = "seq", block: int = 10_000) -> DataFrame:
    """One row per text, replayed in order: a later row wins if it is engine-common and the kept one isn't, or else
    if it is deep-scan and the kept one isn't. The winner depends on the order, so the rule is folded over the ordered
    flags, block by block: a block is reduced to what it makes of each of the four kinds of a kept row, and the blocks of
    a text are chained."""
    flags = df.select(key, order, F.coalesce("is_engine_common", F.lit(False)).alias("c"), F.coalesce("is_deep_scan", F.lit(False)).alias("d"))
    n = numbered(flags, [key], [order], "_rn").withColumn("_block", F.floor(F.col("_rn") / block).cast("long"))
    rows = n.groupBy(key, "_block").agg(F.array_sort(F.collect_list(F.struct(order, "c", "d"))).alias("rows"))
    none = F.lit(None).cast(dict(flags.dtypes)[order])

    def step(kept: Column, x: Column) -> Column:
        wins = ~kept["c"] & x["c"] | ~kept["d"] & x["d"]
        return F.when(wins, x).otherwise(kept)

    from_kind = [F.aggregate("rows", F.struct(none.alias(order), F.lit(c).alias("c"), F.lit(d).alias("d")), step) for c in (False, True) for d in (False, True)]
    first = F.aggregate(F.slice("rows", F.lit(2), F.size("rows")), F.get("rows", F.lit(0)), step)
    made = rows.select(key, F.struct("_block", first.alias("first"), F.array(*from_kind).alias("then")).alias("b"))
    chain = made.groupBy(key).agg(F.array_sort(F.collect_list("b"), lambda x, y: (x["_block"] - y["_block"]).cast("int")).alias("bs"))

    def link(kept: Column, b: Column) -> Column:
        now = F.get(b["then"], kept["c"].cast("int") * 2 + kept["d"].cast("int"))
        return F.when(now[order].isNull(), kept).otherwise(now)

    kept = F.aggregate(F.slice("bs", F.lit(2), F.size("bs")), F.get("bs", F.lit(0))["first"], link)
    return chain.select(key, kept[order].alias(order)).join(df, [key, order])


@F.pandas_udf(T.StructType([T.StructField("exits", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))]))
def _through(lengths: pd.Series, own: pd.Series, max_chars: pd.Series, max_texts: pd.Series) -> pd.DataFrame:
    """For each place at which a block's first slice may begin: where the next block's begins, and how many begin here."""
    out = []
    for ns, n, chars, texts in zip(lengths, own, max_chars, max_texts):
        ends = _ends(ns.tolist(), n, chars, texts)
        exits, counts = [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            e = ends[i]
            exits[i], counts[i] = (e - n, 1) if e >= n else (exits[e], counts[e] + 1)
        exits, counts = exits[:texts], counts[:texts]
        out.append((exits + [i - n for i in range(len(exits), texts)], counts + [0] * (texts - len(counts))))
    return pd.DataFrame(out, columns=["exits", "counts"])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _numbers(lengths: pd.Series, own: pd.Series, max_chars: pd.Series, max_texts: pd.Series, enter: pd.Series, base: pd.Series) -> pd.Series:
    """Slice numbers of a block's texts. Its first ``enter`` texts belong to the slice before ``base``."""
    out = []
    for ns, n, chars, texts, at, no in zip(lengths, own, max_chars, max_texts, enter, base):
        ends, numbers = _ends(ns.tolist(), n, chars, texts), [no - 1] * min(at, n)
        while at < n:
            numbers += [no] * (min(ends[at], n) - at)
            at, no = ends[at], no + 1
        out.append(numbers)
    return pd.Series(out, dtype=object)


def _ends(ns: list[int], own: int, max_chars: int, max_texts: int) -> list[int]:
    """Where a slice ends that begins at each of the block's own texts; ``ns`` goes on into the next block."""
    out, end, chars = [], 0, 0
    for i in range(own):
        if end <= i:
            end, chars = i + 1, ns[i]
        while end < len(ns) and end - i < max_texts and chars + ns[end] <= max_chars:
            chars += ns[end]
            end += 1
        out.append(end)
        chars -= ns[i]
    return out


def pack_slices(df: DataFrame, keys: list[str], order: str, length: str, max_chars: int = 3000, max_texts: int = 25, block: int = 20_000) -> DataFrame:
    """Greedy slices of at most ``max_chars`` and ``max_texts`` in order; a text that is longer stands alone.

    A running sum with reset is no window function; it is folded over ordered lists of at most ``block`` texts and the
    few that follow them. A slice that a block inherits covers less than ``max_texts`` of its texts, so each block is
    folded for every place at which its own first slice may begin; the blocks of a key are then chained, and slices
    are numbered within the key.
    """
    n = numbered(df.select(*keys, order, F.coalesce(F.col(length).cast("int"), F.lit(0)).alias("n")), keys, [order], "_rn")
    no = F.floor(F.col("_rn") / block).cast("int")
    ahead = (F.col("_rn") % block < max_texts - 1) & (no > 0)
    n = n.withColumn("block", F.explode(F.when(ahead, F.sequence(F.greatest(F.floor((F.col("_rn") - max_texts + 1) / block).cast("int"), F.lit(0)), no)).otherwise(F.array(no))))
    lists = n.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("_rn", order, "n"))).alias("rows"))
    lists = lists.withColumn("own", F.least(F.size("rows"), F.lit(block)))
    given = [F.col("rows.n"), F.col("own"), F.lit(max_chars), F.lit(max_texts)]
    jumps = lists.select(*keys, "block", _through(*given).alias("j")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", "j.exits", "j.counts"))).alias("blocks"))
    start = F.struct(F.lit(0).alias("enter"), F.lit(0).alias("base"), F.array().cast("array<struct<block:int,enter:int,base:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        here = F.struct(x["block"].alias("block"), s["enter"].alias("enter"), s["base"].alias("base"))
        return F.struct(F.get(x["exits"], s["enter"]).alias("enter"), (s["base"] + F.get(x["counts"], s["enter"])).alias("base"), F.concat(s["out"], F.array(here)).alias("out"))

    begins = jumps.select(*[F.col(k).alias(f"_{k}") for k in keys], F.inline(F.aggregate("blocks", start, step)["out"])).withColumnRenamed("block", "_block")
    same = F.col("block") == F.col("_block")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    done = lists.join(begins, same).select(*keys, "block", F.slice("rows", F.lit(1), F.col("own")).alias("rows"), _numbers(*given, F.col("enter"), F.col("base")).alias("no"))
    zipped = F.explode(F.arrays_zip("rows", "no")).alias("z")
    return done.select(*keys, "block", zipped).select(*keys, "block", F.col(f"z.rows.{order}").alias(order), F.col("z.rows.n").alias("n_chars"), F.col("z.no").alias("slice_no"))


def in_ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows in ranges of (keys, order) with the range's number ``_part``; the rows of a hot key stand in many ranges.

    The ranges are written to the shared folder, as range bounds are sampled and must not change between uses.
    """
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return checkpoint(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Numbers from 0 within a key by order. Each range is numbered for itself, then its begin is added: one row per key
    and range decides it, so no task sorts a whole key. ``order`` must be unique within a key."""
    parts = in_ranges(df, keys, order)
    w = Window.partitionBy(*keys, "_part")
    before = w.orderBy(*order)
    counts = parts.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    begins = counts.withColumn("_begin", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    right = begins.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_begin")
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    own = parts.withColumn("_own", F.row_number().over(before) - 1)
    return own.join(right, same).withColumn(name, F.col("_own") + F.col("_begin")).drop(*right.columns, "_own", "_part")


def batches(df: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    return numbered(df, keys, [order], "_rn").withColumn("batch_no", F.floor(F.col("_rn") / size).cast("int")).drop("_rn")


def round_robin(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    return numbered(df, [key], [order], "_rn").withColumn("slot", F.pmod("_rn", F.lit(n)).cast("int")).drop("_rn")


def look_back(df: DataFrame, key: str, order: str, flag: Column, rows: int, name: str) -> DataFrame:
    """The last non-null flag within the ``rows`` lines up to and including the row's own."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(name, F.last(flag, ignorenulls=True).over(w))


def top_k(df: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(k)


def longest_first(terms: Column) -> Column:
    """Glossary terms, longest first; equal lengths by name."""
    return F.array_sort(terms, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
