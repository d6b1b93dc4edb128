"""Helpers shared by the corpus operators: table access and the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loclake.session import checkpoint, use_shared_folder  # noqa: F401

#: Fixed: languages of the corpus (API codes) and their names in ``tl_entries.lang``.
LANGS = ("en", "de", "fr", "es", "tr", "ru", "ja")
NAME_TO_CODE = {
    "english": "en", "german": "de", "french": "fr", "spanish": "es", "turkish": "tr", "russian": "ru", "japanese": "ja",
}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``checkpoint`` writes to."""
    use_shared_folder(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """The rows as a compressed table in the shared folder, bucketed by a key: later joins on it move the other side only."""
    spark = df.sparkSession
    name = unique_view("loclake")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_folder(spark)}/{name}"
    df.write.format("parquet").bucketBy(n, key).option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core work before a CPU-heavy Python stage: a small input file may be one partition.

    A round-robin exchange is only added where the scan has fewer partitions than the cluster has cores.
    """
    want = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    have = df.rdd.getNumPartitions()
    return df if have >= df.sparkSession.sparkContext.defaultParallelism else df.repartition(want, *keys)


#: Rows of a few numbers that may be broadcast by hint.
FEW = 200_000


def few(df: DataFrame) -> DataFrame:
    """A broadcast hint where the rows, counted, are at most ``FEW``; else the planner's join."""
    return F.broadcast(df) if df.count() <= FEW else df


def salted(column: str, salts: int = 32):
    """A salt for hot keys from a well-mixed hash of a unique column."""
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def bounded_sample(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of their keys: the same however the input is split.

    Rows are filtered by hash before they are ordered, so about ``most`` rows reach the driver in all, not as many from
    every task. Where fewer pass that filter by chance, the sample is that much smaller.
    """
    n = df.count()
    h = F.pmod(F.xxhash64(*keys), F.lit(1 << 30))
    share = min(1.0, 1.1 * most / max(n, 1))
    return df.where(h <= int(share * (1 << 30))).orderBy(h, *keys).limit(most)


def unique_view(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:8]}"
