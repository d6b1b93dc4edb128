"""Aggregations: coverage, diagnostics, issues, terms, duplicates, adaptive limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loclake.operators.relational import numbered


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, digits)).otherwise(F.lit(0.0))


def translation_stats(df: DataFrame, by: list[str], done: Column) -> DataFrame:
    total, n = F.count("*"), F.count_if(done)
    return df.groupBy(*by).agg(total.alias("total"), n.alias("translated"), (total - n).alias("untranslated"), percent(n, total).alias("progress"))


def diagnostics(events: DataFrame) -> DataFrame:
    """Counts by status per file, and over all files where ``file_path`` is null in a row of ``level`` 1."""
    named = ("extracted", "translated", "written", "skipped", "unchanged")
    counts = [F.count_if(F.col("status") == s).alias(s) for s in named]
    return events.where("file_path is not null").rollup("file_path").agg(*counts, F.grouping("file_path").cast("int").alias("level"))


def severity_counts(issues: DataFrame, by: list[str]) -> DataFrame:
    errors = F.count_if(F.col("severity").isin("error", "critical"))
    return issues.groupBy(*by).agg(
        errors.alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("severity") == "info").alias("infos"), (errors == 0).alias("is_healthy")
    )


def term_counts(texts: DataFrame, column: str, pattern: str = r"[^.!?\"]\s([A-Z][a-z]+)") -> DataFrame:
    """Capitalised words that don't begin a sentence."""
    return texts.select(F.explode(F.regexp_extract_all(column, F.lit(pattern), F.lit(1))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def duplicates(df: DataFrame, key: str, order: str, examples: int = 5) -> DataFrame:
    """Keys of several rows with the first ids; ids are kept per task before the shuffle, so no list grows with a key."""
    w = Window.partitionBy(key, "_part").orderBy(order)
    part = df.where(F.col(key).isNotNull()).withColumn("_part", F.pmod(F.xxhash64(order), F.lit(32)))
    few = part.withColumn("_n", F.row_number().over(w)).groupBy(key, "_part").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_n") <= examples, F.col(order)))).alias("ids"))
    both = few.groupBy(key).agg(F.sum("n").alias("n"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids")).where("n > 1")
    return both.select(key, "n", F.slice("ids", 1, examples).alias("ids"))


def rolling(df: DataFrame, key: str, order: str, duration: str, ok: Column, rows: int = 500, block: int = 20_000) -> DataFrame:
    """Mean duration and share of failures over the last ``rows`` events of a key."""
    # blocks of a key in order, each with the rows before it that its frames reach into: no task holds a whole key
    n = numbered(df.withColumn("_ok", ok), [key], [order], "_rn")
    no = F.floor(F.col("_rn") / block).cast("long")
    ahead = F.floor((F.col("_rn") + rows - 1) / block).cast("long")
    n = n.withColumn("_own", no).withColumn("_block", F.explode(F.sequence(no, ahead)))
    ok = F.col("_ok")
    w = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(-(rows - 1), 0)
    out = n.withColumns({"mean_duration": F.avg(duration).over(w), "failure_rate": F.avg(F.when(ok, 0.0).otherwise(1.0)).over(w), "n_events": F.count("*").over(w)})
    return out.where("_block = _own").drop("_ok", "_rn", "_own", "_block")


def adaptive_signal(mean: Column, failures: Column, n: Column, least: int = 20) -> Column:
    """Slow down above 20 % failures or 1.5 s, speed up below 5 % and 0.5 s, from ``least`` events on."""
    return F.when(n < least, "hold").when((failures > 0.2) | (mean > 1.5), "down").when((failures < 0.05) & (mean < 0.5), "up").otherwise("hold")


def adaptive_limits(signals: DataFrame, key: str, order: str, start: int = 256, floor: int = 4, cap: int = 512) -> DataFrame:
    """The concurrency limit after each signal: a recurrence, folded over the key's signals in order."""
    rows = signals.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "signal"))).alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        now = acc["now"]
        new = (
            F.when(x["signal"] == "down", F.greatest(F.lit(floor), F.floor(now * 0.8).cast("int")))
            .when(x["signal"] == "up", F.least(F.lit(cap), F.greatest(now + 1, F.floor(now * 1.1).cast("int"))))
            .otherwise(now)
        )
        return F.struct(new.alias("now"), F.concat(acc["out"], F.array(new)).alias("out"))

    init = F.struct(F.lit(start).alias("now"), F.array().cast("array<int>").alias("out"))
    z = F.explode(F.arrays_zip("rows", F.aggregate("rows", init, step)["out"].alias("limit"))).alias("z")
    return rows.select(key, z).select(key, F.col(f"z.rows.{order}").alias(order), F.col("z.rows.signal").alias("signal"), F.col("z.limit").alias("limit"))


def file_types(entries: DataFrame) -> DataFrame:
    """Whether a translation file holds strings, dialogue or both; a file of narration only counts as mixed."""
    s, d = F.count_if(F.col("entry_type") == "string"), F.count_if(F.col("entry_type") == "dialogue")
    return entries.groupBy("file_path").agg(F.when((s > 0) & (d == 0), "strings").when((d > 0) & (s == 0), "dialogue").otherwise("mixed").alias("file_type"), F.count("*").alias("n"))


def cache_stats(df: DataFrame, by: list[str], hit: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), percent(F.count_if(hit), F.count("*")).alias("hit_rate"))


def samples(df: DataFrame, by: list[str], kinds: dict[str, tuple[Column, int]], order: str) -> DataFrame:
    """Per group and kind the number of rows and the first ids, as many as the kind says."""
    kind = F.explode(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("kind"), F.lit(n).alias("most"))) for k, (c, n) in kinds.items()]))).alias("_k")
    rows = df.select(*by, order, kind).select(*by, order, "_k.*")
    part = rows.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(32)))
    w = Window.partitionBy(*by, "kind", "_part").orderBy(order)
    few = part.withColumn("_n", F.row_number().over(w)).groupBy(*by, "kind", "most", "_part").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("_n") <= F.col("most"), F.col(order))).alias("ids"))
    return few.groupBy(*by, "kind", "most").agg(F.sum("n").alias("n"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids")).select(*by, "kind", "n", F.slice("ids", F.lit(1), F.col("most")).alias("ids"))


def endpoint_stats(endpoints: DataFrame) -> DataFrame:
    """One row: endpoints (is_working, response_time, success_rate) in all, working ones, and means; 0 without any."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return endpoints.agg(F.count("*").alias("total"), F.count_if("is_working").alias("working"), mean("response_time").alias("mean_response"), mean("success_rate").alias("mean_success"))


def endpoints(results: DataFrame, keys: list[str], ok: Column, duration: Column, most_failures: int = 10) -> DataFrame:
    """Endpoints with their rates; one that failed more than ``most_failures`` times at a rate below 0.3 is off."""
    e = results.groupBy(*keys).agg(F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), F.avg(duration).alias("response_time"))
    e = e.withColumn("success_rate", F.col("successes") / (F.col("successes") + F.col("failures")))
    return e.withColumn("is_working", ~((F.col("failures") > most_failures) & (F.col("success_rate") < 0.3)))
