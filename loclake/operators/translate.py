"""Request planning and engines: what to send, in which slices, and what comes back.

An engine is any object with ``name`` and ``translate(texts, source, target) -> list of texts or None``. Engines run
once per distinct text, in Arrow batches, behind a lookup of what earlier runs translated; ``Pseudo`` stays in columns.
"""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loclake.functions import text as X

KEY = ["engine", "source_lang", "target_lang", "text"]


class Engine(Protocol):
    name: str

    def translate(self, texts: list[str], source: str, target: str) -> list[str | None]: ...


def unique_requests(requests: DataFrame) -> DataFrame:
    return requests.select(*KEY).where(F.col("text").isNotNull()).distinct()


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return unique_requests(requests).join(cache.select(*KEY), KEY, "left_anti")


def run(requests: DataFrame, engine: Engine) -> DataFrame:
    """Distinct requests through an engine; a text it gives nothing for is a failure, not an error."""
    schema = "engine string, source_lang string, target_lang string, text string, translated_text string, success boolean"

    def call(batches):
        for pdf in batches:
            parts = []
            for (s, t), g in pdf.groupby(["source_lang", "target_lang"], dropna=False, sort=False):
                out = engine.translate(g["text"].tolist(), s, t)
                parts.append(g.assign(translated_text=out, success=[x is not None for x in out]))
            if parts:
                yield pd.concat(parts)[["engine", "source_lang", "target_lang", "text", "translated_text", "success"]]

    return requests.where(F.col("engine") == engine.name).select(*KEY).mapInPandas(call, schema)


def translate(requests: DataFrame, engine: Engine, cache: DataFrame) -> DataFrame:
    """Every request with its translation from the cache or the engine."""
    fresh = run(misses(requests, cache), engine)
    known = cache.select(*KEY, "translated_text", F.lit(True).alias("success")).unionByName(fresh)
    return requests.join(known, KEY, "left")


def pseudo(requests: DataFrame, mode: str = "both") -> DataFrame:
    return requests.withColumn("translated_text", X.pseudo(F.col("text"), mode)).withColumn("success", F.lit(True)).withColumn("confidence", F.lit(1.0))


def route(slices: DataFrame) -> DataFrame:
    """How a slice is sent: alone, joined by separators, or its texts in parallel."""
    n, chars = F.col("n_texts"), F.col("n_chars")
    return slices.withColumn("route", F.when(n == 1, "single").when((n <= 25) & (chars <= 4000), "joined").otherwise("parallel"))


def split_joined(df: DataFrame, response: str, n: str, separator: str = "\n|||\n") -> DataFrame:
    """Parts of a joined answer; an answer with another number of parts gives nulls, so the texts are sent again."""
    quoted = "".join(f"\\{c}" if not c.isalnum() and not c.isspace() else c for c in separator.strip())
    parts = F.transform(F.split(response, quoted, -1), X.strip)
    return df.withColumn("parts", F.when(F.size(parts) == F.col(n), parts))
