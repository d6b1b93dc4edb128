"""Translation files: blocks, old/new and comment/line pairs, ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loclake.functions import predicates as P
from loclake.functions import text as X

# Line forms of translation files.
HEADER, SOURCE = r"(?i)\Atranslate\s+(\w+)\s+(\w+)\s*:\s*\z", r"\A\s*#\s*([^:]+:\d+)\s*\z"
OLD, NEW = r'\A\s*old\s+"(.*)"\s*\z', r'\A\s*new\s+"(.*)"\s*\z'
SAID, SAYS = r'\A\s*#\s*(\w+)\s+"(.*)"\s*\z', r'\A\s*(\w+)\s+"(.*)"\s*\z'
TOLD, TELLS = r'\A\s*#\s*"(.*)"\s*\z', r'\A\s*"(.*)"\s*\z'


def parse(df: DataFrame, key: str = "file_path", content: str = "text") -> DataFrame:
    """Entries of translation files given as whole texts.

    The next line comes from the array of lines, without a shuffle; only the block and the source comment in force
    need an ordered window per file. A dialogue's line number is that of its second line. Pairs without a partner
    line and texts that need no translation have no entry.
    """
    lines = F.split(X.unix_lines(F.col(content)), "\n", -1)
    rows = df.select(key, lines.alias("ls")).select(key, F.posexplode("ls").alias("n", "line"), "ls")
    rows = rows.select(key, (F.col("n") + 1).alias("n"), X.strip(F.col("line")).alias("line"), X.strip(F.coalesce(F.get("ls", F.col("n") + 1), F.lit(""))).alias("next"))
    rows = rows.where("line <> ''")
    group = lambda c, p, i: F.when(F.col(c).rlike(p), F.regexp_extract(c, p, i))
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("block_id", F.last(group("line", HEADER, 2), ignorenulls=True).over(w)).withColumn("lang", F.last(group("line", HEADER, 1), ignorenulls=True).over(w))
    pair = F.col("line").rlike(OLD) | F.col("line").rlike(SAID) | F.col("line").rlike(TOLD)
    # the comment holds until the next pair has used it
    mark = F.when(F.col("line").rlike(SOURCE), F.struct(F.lit(1).alias("k"), group("line", SOURCE, 1).alias("v"))).when(pair, F.struct(F.lit(0).alias("k"), F.lit(None).cast("string").alias("v")))
    before = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("source_comment", F.last(mark, ignorenulls=True).over(before)["v"])
    dialogue = F.col("block_id").isNotNull() & (F.col("block_id") != "strings")
    kind = (
        F.when(F.col("line").rlike(OLD), "string")
        .when(dialogue & F.col("line").rlike(SAID) & F.col("next").rlike(SAYS), "dialogue")
        .when(dialogue & F.col("line").rlike(TOLD) & F.col("next").rlike(TELLS), "narrator")
    )
    e = rows.withColumn("entry_type", kind).where("entry_type is not null")
    is_string, is_said = F.col("entry_type") == "string", F.col("entry_type") == "dialogue"
    original = F.when(is_string, group("line", OLD, 1)).when(is_said, group("line", SAID, 2)).otherwise(group("line", TOLD, 1))
    translated = F.when(is_string, F.coalesce(group("next", NEW, 1), F.lit(""))).when(is_said, group("next", SAYS, 2)).otherwise(group("next", TELLS, 1))
    e = e.select(
        key, "lang", "block_id", "entry_type", "source_comment", F.when(is_string, F.col("n")).otherwise(F.col("n") + 1).alias("line_number"),
        F.when(is_said, group("next", SAYS, 1)).alias("character"), X.unescape(original).alias("original_text"), X.unescape(translated).alias("translated_text"),
    )
    e = e.where(~P.skip_in_translation_file(F.col("original_text")))
    path = F.when(F.col("block_id").isNotNull(), F.array("block_id")).otherwise(F.array().cast("array<string>"))
    return e.withColumn("context_path", path).withColumn("translation_id", X.translation_id(F.col(key).cast("string"), F.col("line_number"), F.col("context_path"), F.col("original_text")))


def language_of(df: DataFrame, content: str = "text") -> DataFrame:
    """Adds ``lang`` of the first translate line; files without one are no translation files."""
    return df.withColumn("lang", F.regexp_extract(content, r"(?im)^[ \t]*translate\s+(\w+)\s+\w+\s*:", 1)).where("lang <> ''")
