"""Checks of translated lines: lost and added markup, quotes, strings nobody marked as translatable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loclake.functions import predicates as P
from loclake.functions import text as X
from loclake.operators.relational import look_back

VARIABLE, TAG = r"\[[^\[\]]+\]", r"\{[^{}]+\}"


def placeholder_issues(pairs: DataFrame, keep: tuple[str, ...], original: str = "original_text", translated: str = "translated_text") -> DataFrame:
    """One row per kind of difference: lost variables (error), added variables and lost tags (warnings)."""
    o, t = F.col(original), F.col(translated)
    issue = lambda sev, kind, found: F.struct(F.lit(sev).alias("severity"), F.lit(kind).alias("issue_type"), F.array_join(found, ", ").alias("message"))
    all_ = F.array(
        issue("error", "missing_placeholder", X.lost(o, t, VARIABLE)), issue("warning", "extra_placeholder", X.lost(t, o, VARIABLE)), issue("warning", "missing_tag", X.lost(o, t, TAG))
    )
    return pairs.where(o.isNotNull() & t.isNotNull()).select(*keep, F.inline(F.filter(all_, lambda i: i["message"] != "")))


def quote_issues(lines: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return lines.where(X.odd_quotes(F.col("line"))).select(*keep, F.lit("error").alias("severity"), F.lit("quote_balance").alias("issue_type"))


def unwrapped(lines: DataFrame, key: str, rows: int = 50) -> DataFrame:
    """Literals of screens that aren't marked as translatable: within ``rows`` lines below a screen and no label."""
    flag = F.when(F.col("line").rlike(r"\A\s*(screen|style)\s"), 1).when(F.col("line").rlike(r"\A\s*label\s.*:"), 0)
    near = look_back(lines, key, "line_number", flag, rows, "_ui")
    text = F.regexp_extract("line", r'\A\s*(?:text|textbutton)\s+"([^"]+)"', 1)
    return near.where((F.col("_ui") == 1) & (text != "") & ~P.technical_in_scan(text)).select(key, "line_number", text.alias("text"))
