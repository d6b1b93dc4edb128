"""Session defaults: adaptive execution on, session time in UTC, Arrow batches sized for texts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
}


def session(app: str = "loclake", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in {**DEFAULTS, **extra}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def use_shared_folder(spark: SparkSession) -> None:
    """Checkpoints go to ``spark.checkpoint.dir`` of the session; only a local session without one (tests) gets a
    temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder")
            folder = tempfile.mkdtemp(prefix="loclake-")
        sc.setCheckpointDir(folder)


def checkpoint(df: DataFrame) -> DataFrame:
    """Rows cut from their lineage through the cluster's shared folder, so a lost executor costs no recomputation."""
    use_shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
