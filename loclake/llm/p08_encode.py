"""Problem 8: encoding of the whole corpus with a public tokenizer.

Texts are split into words (pieces between which no merge happens). Arrow batches are cut into slices of at most
``SLICE`` words; a slice is written once as one row: the numbers of its documents' words and its distinct words. The
distinct words of all slices meet by their bytes, so every word of the corpus is merged once, however often it occurs:
higher-order functions fold the ranked merges over the array of the word's bytes, with the ranks as one literal of the
plan. A linear map would be searched from its beginning at each lookup, so the literal is an array of small maps,
addressed by a checksum of the key. The ids of a slice's words go back to the
slice, where the numbers of the documents' words pick them. Decoding looks tokens up in a literal array and
concatenates their bytes.

Words above ``WHOLE`` bytes are first cut where no token of the vocabulary reaches across (``safe_cuts``): no merge
happens there either. A word that a third of all texts hold is one row per slice; nothing is broadcast but the ranks.

Null and empty texts have an empty list.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loclake.llm.bpe import BPE_50K, JAVA_PATTERN, path_of, ranks
from loclake.llm.common import bucketed, spread, table

#: Small maps in the literal of ranks; words of a slice; bytes up to which a word isn't cut; pieces up to which pairs are
#: merged one at a time (beyond, all equal pairs at once: the same merges in fewer, longer steps).
BUCKETS, SLICE, WHOLE, SINGLE, NO_RANK = 1 << 14, 1_000_000, 16, 64, 1 << 30


# --- merging ------------------------------------------------------------------------------------------------------


def rank_literal(path: str) -> Column:
    """Ranks by hexadecimal bytes as an array of small maps; constant folding makes it one literal."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for t, r in ranks(path).items():
        h = t.hex().upper()
        buckets[zlib.crc32(h.encode()) % BUCKETS][h] = r
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,int>>")


def rank_of(table_: Column, key: Column) -> Column:
    """Rank of a piece given as hexadecimal bytes, null if it is no token."""
    return F.try_element_at(F.get(table_, (F.crc32(key) % BUCKETS).cast("int")), key)


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pair_ranks(table_: Column, pieces: Column) -> Column:
    """Rank of each piece with the next one, ``NO_RANK`` for the last and where they make no token."""
    return F.transform(pieces, lambda p, i: F.coalesce(rank_of(table_, F.concat(p, F.get(pieces, i + 1))), F.lit(NO_RANK)))


def _bytes(hexed: Column) -> Column:
    return F.regexp_extract_all(hexed, F.lit(".."), F.lit(0))


def merge_fold(table_: Column, hexed: Column) -> Column:
    """Ids of a word from its hexadecimal bytes: the best-ranked adjacent pair merges until none has a rank.

    The ranks of the pairs travel with the pieces; a merge changes two of them.
    """

    def merged(s: Column, best: Column, i: Column) -> Column:
        ps, rs = s["p"], s["r"]
        new = F.concat(F.get(ps, i - 1), F.get(ps, i))
        before = F.when(i > 1, F.array(F.coalesce(rank_of(table_, F.concat(F.get(ps, i - 2), new)), F.lit(NO_RANK)))).otherwise(F.array().cast("array<int>"))
        after = F.array(F.coalesce(rank_of(table_, F.concat(new, F.get(ps, i + 1))), F.lit(NO_RANK)))
        pieces = F.concat(F.slice(ps, F.lit(1), i - 1), F.array(new), F.slice(ps, i + 2, F.size(ps)))
        return F.struct(pieces.alias("p"), F.concat(F.slice(rs, F.lit(1), F.greatest(i - 2, F.lit(0))), before, after, F.slice(rs, i + 2, F.size(rs))).alias("r"))

    def step(s: Column, _: Column) -> Column:
        at = lambda best: F.when(best == NO_RANK, s).otherwise(let(F.array_position(s["r"], best).cast("int"), lambda i: merged(s, best, i)))
        return let(F.array_min(s["r"]), at)

    begin = let(_bytes(hexed), lambda b: F.struct(b.alias("p"), _pair_ranks(table_, b).alias("r")))
    n = (F.length(hexed) / 2).cast("int")
    done = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), begin, step, lambda s: s["p"])
    return F.transform(done, lambda p: rank_of(table_, p))


def merge_rounds(table_: Column, hexed: Column) -> Column:
    """The same for long words: a step merges every occurrence of the best-ranked pair, from left to right.

    A pair that a merge makes is never ranked better than the merge, so the order of merges is the same. The state is
    one text with each piece in brackets.
    """

    def step(s: Column, _: Column) -> Column:
        def pairs(ps: Column) -> Column:
            return F.transform(ps, lambda p, i: F.struct(F.coalesce(rank_of(table_, F.concat(p, F.get(ps, i + 1))), F.lit(NO_RANK)).alias("r"), p.alias("a"), F.get(ps, i + 1).alias("b")))

        put = lambda b: F.when(b["r"] == NO_RANK, F.struct(s["t"].alias("t"), F.lit(True).alias("done"))).otherwise(
            F.struct(F.replace(s["t"], F.concat(F.lit("<"), b["a"], F.lit("><"), b["b"], F.lit(">")), F.concat(F.lit("<"), b["a"], b["b"], F.lit(">"))).alias("t"), F.lit(False).alias("done"))
        )
        pieces = F.regexp_extract_all(s["t"], F.lit("[0-9A-F]+"), F.lit(0))
        return F.when(s["done"], s).otherwise(let(pieces, lambda ps: let(F.array_min(pairs(ps)), put)))

    n = (F.length(hexed) / 2).cast("int")
    begin = F.struct(F.regexp_replace(hexed, "(..)", "<$1>").alias("t"), F.lit(False).alias("done"))
    done = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), begin, step, lambda s: s["t"])
    return F.transform(F.regexp_extract_all(done, F.lit("[0-9A-F]+"), F.lit(0)), lambda p: rank_of(table_, p))


def dictionary(words: DataFrame, path: str) -> DataFrame:
    """(w, ids) of distinct words given as binary."""
    hexed = F.hex("w")
    ids = let(rank_literal(path), lambda t: F.when(F.length(hexed) <= 2 * SINGLE, merge_fold(t, hexed)).otherwise(merge_rounds(t, hexed)))
    return words.select("w", ids.alias("ids"))


# --- words of slices ----------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def crossings(path: str) -> list[np.ndarray]:
    """What tokens hold around each place inside them, as sorted numbers: a byte or two before, a byte or two after.

    Four lists: exactly one or at least two bytes before, with exactly one or at least two after.
    """
    held: list[set[int]] = [set(), set(), set(), set()]
    for t in ranks(path):
        for i in range(1, len(t)):
            before, after = t[max(0, i - 2) : i], t[i : i + 2]
            one = len(before) == 1, len(after) == 1
            held[2 * (not one[0]) + (not one[1])].add(int.from_bytes(before + after, "big"))
    return [np.array(sorted(h), np.int64) for h in held]


def safe_cuts(data: np.ndarray, path: str) -> np.ndarray:
    """For each byte whether no token can reach from the bytes before it across to it (the first byte counts as cut)."""
    n = len(data)
    out = np.ones(n, bool)
    if n < 2:
        return out
    x = data.astype(np.int64)
    p2, p1 = np.r_[-1, x[:-2]], x[:-1]  # of place i + 1
    q1, q2 = x[1:], np.r_[x[2:], -1]
    keys = (p1 << 8 | q1, np.where(q2 < 0, -1, p1 << 16 | q1 << 8 | q2), np.where(p2 < 0, -1, p2 << 16 | p1 << 8 | q1), np.where((p2 < 0) | (q2 < 0), -1, p2 << 24 | p1 << 16 | q1 << 8 | q2))
    for key, known in zip(keys, crossings(path)):
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        out[1:] &= known[at] != key
    return out


def cut_words(words: pa.Array, path: str) -> tuple[np.ndarray, pa.Array]:
    """(parts of each word, the parts): words above ``WHOLE`` bytes divided at safe cuts."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    ends = offsets.astype(np.int64) - offsets[0]
    size = np.diff(ends)
    first = np.zeros(len(data) + 1, bool)
    first[ends] = True
    long = np.flatnonzero(size > WHOLE)
    if len(long):
        # the bytes of long words only, one after another; a word's own first byte is a cut anyhow
        at = np.repeat(ends[long] - np.r_[0, np.cumsum(size[long])[:-1]], size[long]) + np.arange(size[long].sum())
        first[at] |= safe_cuts(data[at], path)
    begins = np.flatnonzero(first)
    parts = np.searchsorted(begins, ends)
    return np.diff(parts), pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(data.tobytes())])


def expand(lists: pa.ListArray, codes: np.ndarray) -> pa.Array:
    return lists.take(pa.array(codes)).flatten()


#: Numbers are kept as bytes: nested columns of integers cost more to write and read than all else a slice needs.
SLICES = "slice_id long, docs binary, sizes binary, codes binary, words array<binary>"


def packed(numbers: np.ndarray) -> bytes:
    """Numbers of at least 0 as bytes of the smallest width that holds them all, the width in front."""
    top = int(numbers.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w - (w == 8))
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def unpacked(data: pa.Scalar) -> np.ndarray:
    raw = np.frombuffer(data.as_buffer(), np.uint8)
    return raw[1:].view(f"<u{raw[0]}") if raw[0] == 1 else np.frombuffer(raw[1:].tobytes(), f"<u{raw[0]}")


def slice_words(batches: Iterator[pa.RecordBatch], path: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """(doc_id, words) to rows of ``SLICES``. A document isn't divided: a longer one is a slice of its own."""
    schema = pa.schema([("slice_id", pa.int64()), ("docs", pa.binary()), ("sizes", pa.binary()), ("codes", pa.binary()), ("words", pa.list_(pa.binary()))])
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("words")
        total = lists.value_lengths().to_numpy().astype(np.int64).cumsum()
        begin = 0
        while begin < len(total):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most, "right")))
            part = lists.slice(begin, end - begin)
            d = part.flatten().cast(pa.binary()).dictionary_encode()
            codes, n_words = d.indices.to_numpy(zero_copy_only=False), part.value_lengths().to_numpy()
            n_parts, parts = cut_words(d.dictionary, path)
            e = parts.dictionary_encode()
            if len(parts) == len(d.dictionary):
                codes = e.indices.to_numpy(zero_copy_only=False)[codes]
            else:
                inner = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_parts)].astype(np.int32)), e.indices)
                per_word = np.r_[0, np.cumsum(n_parts[codes])]
                n_words = np.diff(per_word[np.r_[0, np.cumsum(n_words)]])
                codes = expand(inner, codes).to_numpy(zero_copy_only=False)
            docs = batch.column("doc_id").slice(begin, end - begin)
            numbers = [pa.array([x], pa.binary()) for x in (docs.to_numpy(zero_copy_only=False).astype("<i8").tobytes(), packed(n_words), packed(codes))]
            held = pa.ListArray.from_arrays(pa.array([0, len(e.dictionary)], pa.int32()), e.dictionary)
            yield pa.RecordBatch.from_arrays([docs.slice(0, 1), *numbers, held], schema=schema)
            begin = end


def pick_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices with the ids of their words to (doc_id, ids)."""
    for batch in batches:
        for i in range(batch.num_rows):
            docs = np.frombuffer(batch.column("docs")[i].as_buffer(), "<i8")
            sizes, codes = unpacked(batch.column("sizes")[i]), unpacked(batch.column("codes")[i])
            ids, ks = batch.column("ids")[i].values, batch.column("ks")[i].values.to_numpy(zero_copy_only=False)
            place = np.empty(len(ks), np.int64)
            place[ks] = np.arange(len(ks))
            at = place[codes]
            flat = expand(ids, at)
            lengths = np.r_[0, np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)[at], dtype=np.int64)]
            ends = lengths[np.r_[0, np.cumsum(sizes, dtype=np.int64)]]
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)], names=["doc_id", "ids"])


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of (doc_id, text); ``doc_id`` must be unique."""
    full = spread(docs.where("text is not null and text <> ''"))
    split = full.select("doc_id", F.regexp_extract_all("text", F.lit(JAVA_PATTERN), F.lit(0)).alias("words"))
    slices = bucketed(split.mapInArrow(lambda batches: slice_words(batches, path), SLICES), "slice_id")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one exchange serves the distinct words and the places that wait for their ids; a given number of partitions keeps
    # the merges on all cores, however few bytes the words have
    words = slices.select("slice_id", F.posexplode("words").alias("k", "w")).repartition(n, "w")
    merged = dictionary(words.select("w").distinct(), path)
    found = words.join(merged.hint("shuffle_hash"), "w").groupBy("slice_id").agg(F.collect_list(F.struct("k", "ids")).alias("m"))
    both = slices.select("slice_id", "docs", "sizes", "codes").join(found.hint("shuffle_hash"), "slice_id")
    out = both.select("docs", "sizes", "codes", F.col("m.k").alias("ks"), F.col("m.ids").alias("ids")).mapInArrow(pick_ids, "doc_id long, ids array<int>")
    none = docs.where("text is null or text = ''").select("doc_id", F.array().cast("array<int>").alias("ids"))
    return out.unionByName(none)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), path_of(BPE_50K))


def decode(ids: Column, path: str) -> Column:
    """Text of ids: binary pieces from a literal array, concatenated."""
    pieces = sorted((i, b.hex().upper()) for b, i in ranks(path).items())
    literal = F.from_json(F.lit(json.dumps([h for _, h in pieces])), "array<string>")
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(literal, i)), "")), "UTF-8")


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose decoded ids aren't their text: none, so the query returns the numbers of both kinds."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    back = encode_documents(docs, path_of(BPE_50K)).select("doc_id", decode(F.col("ids"), path_of(BPE_50K)).alias("back"))
    same = F.coalesce("text", F.lit("")) == F.coalesce("back", F.lit(""))
    return docs.join(back, "doc_id").agg(F.count_if(same).alias("same"), F.count_if(~same).alias("different"))


QUERIES = {"p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip}
SQL: dict[str, str] = {}
