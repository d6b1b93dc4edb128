"""Problem 9: filling fixed-capacity containers with items.

Best-two-fit: a bin is filled greedily with the largest documents that fit; then its smallest document is replaced by
two unpacked documents that together fit the expanded gap more tightly. Documents are packed within shards of about
``SHARD`` items, cut by a hash of the id, so no task holds more than that many and only the last bin of a shard stays
open. A text is divided only if it exceeds the capacity alone: into full pieces, each a bin of its own, and a rest
that is packed like a document; cuts fall where a character begins.

Null and empty texts have no tokens and no bin (``bin_id`` null, ``n_tokens`` 0).
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loclake.llm.bpe import BPE_50K, encode, path_of, starts_character, token_bytes
from loclake.llm.common import checkpoint, spread, table

CAPACITY, SHARD = 2048, 10_000


def pieces_of(text: str | None, path: str, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(first token, end) of the pieces of a text: one unless it exceeds the capacity."""
    ids = encode(text, path)
    n = len(ids)
    if n <= capacity:
        return [(0, n)]
    data = text.encode("utf-8", "replace")
    at = np.r_[0, np.cumsum(token_bytes(path)[ids])]
    clean = np.flatnonzero(starts_character(data, np.minimum(at, len(data))))
    out, start = [], 0
    while n - start > capacity:
        end = int(clean[np.searchsorted(clean, start + capacity, "right") - 1])
        end = end if end > start else start + capacity
        out.append((start, end))
        start = end
    return [*out, (start, n)]


def best_two_fit(sizes: list[int], capacity: int = CAPACITY) -> list[int]:
    """Bin number of each item; every size is between 1 and the capacity."""
    stock: dict[int, list[int]] = defaultdict(list)
    for i in sorted(range(len(sizes)), key=lambda i: (sizes[i], i), reverse=True):
        stock[sizes[i]].append(i)
    have = 0
    for s in stock:
        have |= 1 << s

    def largest(gap: int) -> int:
        return (have & ((1 << (gap + 1)) - 1)).bit_length() - 1

    def take(s: int) -> int:
        nonlocal have
        i = stock[s].pop()
        if not stock[s]:
            have &= ~(1 << s)
        return i

    def put(s: int, i: int) -> None:
        nonlocal have
        stock[s].append(i)
        have |= 1 << s

    out, no = [-1] * len(sizes), 0
    while have:
        held, gap = [], capacity
        while (s := largest(gap)) > 0:
            held.append((s, take(s)))
            gap -= s
        if gap and have:
            s, i = min(held)
            room, best, pair = gap + s, s, None
            a = largest(room - 1)
            while a > 0 and 2 * a > best:
                # the partner: the largest that fits beside it, itself again only if there are two
                b = largest(min(room - a, a))
                if b == a and len(stock[a]) < 2:
                    b = largest(a - 1) if a > 1 else -1
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
                a = largest(a - 1)
            if pair:
                held.remove((s, i))
                held += [(x, take(x)) for x in pair]
                put(s, i)
        for _, i in held:
            out[i] = no
        no += 1
    return out


def items(docs: DataFrame, path: str) -> DataFrame:
    """One row per piece: doc_id, piece_no, token_start, token_end."""

    def cut(batches):
        for pdf in batches:
            rows = [(d, k, a, b) for d, t in zip(pdf["doc_id"], pdf["text"]) for k, (a, b) in enumerate(pieces_of(t, path))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece_no", "token_start", "token_end"]).astype({"piece_no": "int32", "token_start": "int32", "token_end": "int32"})

    return spread(docs.select("doc_id", "text")).mapInPandas(cut, "doc_id long, piece_no int, token_start int, token_end int")


def pack(pieces: DataFrame, shard: int = SHARD) -> DataFrame:
    """Adds ``bin_id``: the shard's number and the bin's within it."""
    sized = pieces.withColumn("n_tokens", F.col("token_end") - F.col("token_start"))
    n = max(1, -(-sized.count() // shard))
    sharded = sized.where("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(n)).cast("int"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece_no"], ignore_index=True)
        bins = best_two_fit(pdf["n_tokens"].tolist())
        return pdf.assign(bin_id=pdf["shard"].astype("int64") * (1 << 32) + np.array(bins, np.int64))[["doc_id", "piece_no", "token_start", "token_end", "n_tokens", "bin_id"]]

    filled = sharded.groupBy("shard").applyInPandas(fill, "doc_id long, piece_no int, token_start int, token_end int, n_tokens int, bin_id long")
    none = sized.where("n_tokens = 0").select("doc_id", "piece_no", "token_start", "token_end", "n_tokens", F.lit(None).cast("long").alias("bin_id"))
    return filled.unionByName(none)


def p9_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(checkpoint(items(table(spark, sf_dir, "documents", "doc_id", "text"), path_of(BPE_50K))))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the batches are."""
    used = p9_batches(spark, sf_dir).where("bin_id is not null").groupBy("bin_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("c"))
    return used.agg(F.count("*").alias("n_bins"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"), (F.sum("n") / (F.count("*") * CAPACITY)).alias("fill"))


QUERIES = {"p9_batches": p9_batches, "p9_fill": p9_fill}
SQL: dict[str, str] = {}
