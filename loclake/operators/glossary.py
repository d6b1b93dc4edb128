"""Glossary: hits, protection before and application after translation. Hits are a join and take a glossary of any
size. Replacement needs all terms at once: they become literals of the plan up to ``LIMIT`` terms a language, and an
error says so beyond."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loclake.functions.text import keep_case, strip
from loclake.operators.relational import small

LIMIT = 5_000


def terms(glossary: DataFrame, lang: str | None = None) -> list[tuple[str, str]]:
    """(source, target), longest first, then by name."""
    g = glossary.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != ""))
    g = g.where(F.col("lang") == lang) if lang else g
    rows = g.groupBy("src").agg(F.min("dst").alias("dst")).limit(LIMIT + 1).collect()
    if len(rows) > LIMIT:
        raise ValueError(f"a glossary of more than {LIMIT} terms a language")
    return sorted(((r["src"], r["dst"]) for r in rows), key=lambda t: (-len(t[0]), t[0]))


def hits(texts: DataFrame, column: str, glossary: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """One row per text and term of ``glossary`` (src, dst) that it holds as a whole word, in any case.

    Texts meet terms by the term's first run of letters and digits: a text is only tested against terms of which it
    holds that word. ``keep`` must name a row; terms without a letter or digit are no words and have no hit.
    """
    run = r"[\p{L}\p{N}_]+"
    g = glossary.where("src is not null and dst is not null").groupBy(F.col("src").alias("term")).agg(F.min("dst").alias("target"))
    g = g.withColumn("_w", F.lower(F.regexp_extract("term", run, 0))).where("_w <> ''")
    quoted = F.regexp_replace("term", r"([^\p{L}\p{N}\s])", r"\\$1")
    g = g.withColumn("_p", F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}_])"), quoted, F.lit(r"(?![\p{L}\p{N}_])")))
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(run), F.lit(0)))).alias("_w")
    met = texts.select(*keep, F.col(column).alias("_x"), words).join(small(g), "_w")
    return met.where(F.regexp_like("_x", F.col("_p"))).select(*keep, "term", "target").distinct()


def any_term(glossary: list[tuple[str, str]]) -> str:
    """Any of the terms as a whole word, in any case; the longest wins where several begin at one place."""
    return "(?i)(?<![\\p{L}\\p{N}_])(" + "|".join("".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in s) for s, _ in glossary) + ")(?![\\p{L}\\p{N}_])"


def _targets(glossary: list[tuple[str, str]]) -> Column:
    return F.create_map(*[F.lit(x) for s, d in {s.lower(): d for s, d in reversed(glossary)}.items() for x in (s, d)])


def _woven(x: Column, pattern: str, fills: Column) -> Column:
    return F.concat_ws("", F.transform(F.split(x, pattern, -1), lambda g, i: F.concat(g, F.coalesce(F.get(fills, i), F.lit("")))))


def protect(x: Column, glossary: list[tuple[str, str]]) -> Column:
    """Terms replaced by masks numbered from left to right that stand for their targets: struct(text, keys, targets)."""
    pattern, to = any_term(glossary), _targets(glossary)
    found = F.regexp_extract_all(x, F.lit(pattern), F.lit(1))
    keys = F.transform(found, lambda _, i: F.concat(F.lit("XRPYXGLO"), i.cast("string"), F.lit("XRPYX")))
    return F.struct(F.when(x.isNotNull(), _woven(x, pattern, keys)).alias("text"), keys.alias("keys"), F.transform(found, lambda f: F.try_element_at(to, F.lower(f))).alias("targets"))


def apply(x: Column, original: Column, glossary: list[tuple[str, str]]) -> Column:
    """The target where the whole original is a term; else untranslated terms replaced, with the case of each hit."""
    pattern, to = any_term(glossary), _targets(glossary)
    found = F.regexp_extract_all(x, F.lit(pattern), F.lit(1))
    fills = F.transform(found, lambda f: keep_case(f, F.try_element_at(to, F.lower(f))))
    return F.coalesce(F.try_element_at(to, F.lower(strip(original))), F.when(x.isNotNull(), _woven(x, pattern, fills)))
