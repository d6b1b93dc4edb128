"""Sinks: ordered assembly of translation files and writers with byte-order mark and LF ends."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loclake.functions import predicates as P
from loclake.functions import text as X
from loclake.operators.relational import keep_first


def assemble(rows: DataFrame, keys: list[str], order: list[str], block: str, header: Column | None = None) -> DataFrame:
    """One text per key from blocks in order. A file is one row by nature; its blocks are sorted within it."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, block))), lambda s: s[block]), "\n")
    out = rows.groupBy(*keys).agg(joined.alias("content"))
    return out.withColumn("content", F.concat(header, F.lit("\n"), F.col("content"))) if header is not None else out


def template_block(e: DataFrame) -> Column:
    """Source comment, old text and an empty new one."""
    part = lambda c, f: F.when(c, f)
    note = F.concat_ws(
        " ",
        F.concat(F.coalesce("file_path", F.lit("unknown")), F.lit(":"), F.coalesce("line_number", F.lit(0)).cast("string")),
        part(F.col("character").isNotNull() & (F.col("character") != ""), F.concat(F.lit("("), F.col("character"), F.lit(")"))),
        part(F.col("text_type").isNotNull() & (F.col("text_type") != "dialogue"), F.concat(F.lit("["), F.col("text_type"), F.lit("]"))),
        part(F.coalesce("is_engine_common", F.lit(False)), F.lit("[engine_common]")),
    )
    return F.concat(F.lit("    # "), note, F.lit('\n    old "'), X.escape(F.col("text")), F.lit('"\n    new ""\n'))


def strings_template(entries: DataFrame, lang: str, keys: list[str], order: list[str]) -> DataFrame:
    """Translation template per key; texts that must not be translated are left out."""
    blocks = entries.where(~P.should_skip(F.col("text"))).withColumn("_block", template_block(entries))
    return assemble(blocks, keys, order, "_block", F.lit(f"translate {lang} strings:\n"))


def rewrite(lines: DataFrame, translations: DataFrame) -> DataFrame:
    """Lines of a translation file with ``new`` lines replaced: (file_path, line_number, line) and (file_path,
    line_number, translation). The line keeps its indent; an empty translation changes nothing."""
    t = translations.where(F.coalesce("translation", F.lit("")) != "").select("file_path", "line_number", "translation")
    out = lines.join(t, ["file_path", "line_number"], "left")
    head = F.regexp_extract("line", r'\A(\s*(?:new |\w+ )?)"', 1)
    new = F.when(F.col("translation").isNotNull() & F.col("line").rlike(r'\A\s*(?:new |\w+ )?".*"\s*\z'), F.concat(head, F.lit('"'), X.escape(F.col("translation")), F.lit('"')))
    return out.select("file_path", "line_number", F.coalesce(new, F.col("line")).alias("line"))


# Forms of source lines whose literal is for people, and lines that stay as they are.
_LITERAL = r"(['\"])([^'\"]+)\2"
WRAPPED = (
    r"(textbutton\s+)" + _LITERAL + r"(\s*:|\s+action|\s+style|\s+xalign|\s+yalign|\s+at\s)",
    r"(\btext\s+)(['\"])([^'\"\[\]{}]+)\2(\s*:|\s+size|\s+color|\s+xpos|\s+ypos|\s+xalign|\s+yalign|\s+outlines|\s+at\s|\s+font|\s+style)",
    r"(tooltip\s+)" + _LITERAL + "()", r"(renpy\.notify\s*\(\s*)" + _LITERAL + r"(\s*\))", r"(Notify\s*\(\s*)" + _LITERAL + r"(\s*\))", r"(title\s*=\s*)" + _LITERAL + "()",
    r"(message\s*=\s*)" + _LITERAL + "()", r"(\byes\s*=\s*)" + _LITERAL + "()", r"(\bno\s*=\s*)" + _LITERAL + "()", r"(\balt\s*=\s*)" + _LITERAL + "()",
)
UNTOUCHED = (
    r"_\s*\(\s*['\"]", r"['\"]\s*\+\s*['\"]", r"^\s*#", r"^\s*$", r"define\s+", r"default\s+", r"=\s*['\"][^'\"]*['\"]\s*$", r"['\"][^'\"]*\[[^\]]+\][^'\"]*['\"]", r"['\"][^'\"]*\{[^}]+\}[^'\"]*['\"]",
)


def wrap_strings(line: Column) -> Column:
    """Source lines with their literals marked as translatable: textbutton "x" action … becomes textbutton _("x") ….

    The forms are applied one after another; a line that is marked already, or must stay, is left to itself.
    """
    for form in WRAPPED:
        line = F.when(line.rlike("|".join(UNTOUCHED)), line).otherwise(F.regexp_replace(line, form, "$1_($2$3$2)$4"))
    return line


def result_block(r: DataFrame) -> Column:
    """Source, id, original and translation of a result; long or many-paragraph texts in paragraph form."""
    o, x = F.col("original_text"), F.col("translated_text")
    source = F.when((F.coalesce("file_path", F.lit("")) != "") & (F.coalesce("line_number", F.lit(0)) > 0), F.concat(F.lit("    # "), X.base_name(F.col("file_path")), F.lit(":"), F.col("line_number").cast("string"), F.lit("\n")))
    long = F.coalesce(F.col("text_type") == "paragraph", F.lit(False)) | F.contains(o, F.lit("\n\n")) | (F.length(o) > 200)
    plain = F.concat(F.lit('    old "'), X.escape_kept(o), F.lit('"\n    new "'), X.escape_kept(x), F.lit('"\n'))
    wide = F.concat(F.lit('    old "'), X.replace_all(o, ("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")), F.lit('"\n    new '), X.paragraph(x), F.lit("\n"))
    return F.concat(F.coalesce(source, F.lit("")), F.lit("    # id: "), F.col("translation_id"), F.lit("\n"), F.when(long, wide).otherwise(plain))


def result_blocks(results: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Blocks of a result file: answers that succeeded, no technical texts, each id once (the first by order)."""
    r = results.where("success and coalesce(translated_text, '') <> '' and original_text is not null").where(~P.should_skip(F.col("original_text")))
    named = F.coalesce("translation_id", X.hash_id(F.col("file_path"), F.coalesce("line_number", F.lit(0)), F.array().cast("array<string>"), F.col("original_text")))
    r = keep_first(r.withColumn("translation_id", named).select(*keys, "translation_id", order, "original_text", "translated_text", "text_type", "file_path", "line_number"), [*keys, "translation_id"], [order])
    return r.select(*keys, order, "translation_id", result_block(r).alias("block"))


def organised(results: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Results with each trimmed original once per key (the first by order), as one folder's file takes them."""
    k = results.where("original_text is not null").withColumn("_text", X.strip(F.col("original_text")))
    return keep_first(k, [*keys, "_text"], [order]).drop("_text")


def unified(files: DataFrame, content: str = "content") -> DataFrame:
    """Files as UTF-8 with LF ends: (…, text, changed); ``changed`` where the bytes of the file will be others."""
    from loclake.sources.text import decoded

    text = X.unix_lines(decoded(F.col(content)))
    out = files.withColumn("text", text)
    return out.withColumn("changed", F.concat(F.lit(b"\xef\xbb\xbf"), F.encode("text", "UTF-8")) != F.col(content))


def missing_strings(found: DataFrame, known: DataFrame) -> DataFrame:
    """(text, block) of texts that scans found and no translation file has, each once."""
    new = found.select("text").where(F.length("text") > 1).distinct().join(known.select(F.col("original_text").alias("text")).where("text is not null").distinct(), "text", "left_anti")
    return new.select("text", F.concat(F.lit('    old "'), X.escape(F.col("text")), F.lit('"\n    new ""\n')).alias("block"))


def report_json(project: str, target: str, counts: DataFrame) -> DataFrame:
    """One row (report): totals and the counts of each file as JSON; ``counts`` is ``metrics.diagnostics``.

    The files' counts are JSON objects before they meet, in order of their paths.
    """
    named = ("extracted", "translated", "written", "skipped", "unchanged")
    c = counts.select("level", "file_path", F.to_json(F.struct(*named)).alias("j"))
    total = F.coalesce(F.max(F.when(F.col("level") == 1, F.col("j"))), F.lit("{}"))
    one = F.concat(F.regexp_extract(F.to_json(F.struct(F.col("file_path").alias("p"))), r"(?s)\A\{\"p\":(.*)\}\z", 1), F.lit(":"), F.col("j"))
    files = F.array_join(F.array_sort(F.collect_list(F.when(F.col("level") == 0, one))), ",")
    head = F.to_json(F.struct(F.lit(project).alias("project"), F.lit(target).alias("target_language")))
    return c.agg(total.alias("t"), files.alias("f")).select(F.concat(F.regexp_replace(head, r"\}\z", ""), F.lit(',"totals":'), "t", F.lit(',"files":{'), "f", F.lit("}}")).alias("report"))


def suggestion_json(threshold: float = 0.9) -> Column:
    """A match as JSON: what it suggests for which text, how similar, and whether it was applied."""
    pc = F.floor(F.col("similarity") * 100).cast("int")
    return F.to_json(F.struct("new_id", "new_original", F.col("old_translation").alias("suggested"), pc.alias("similarity"), (F.col("similarity") >= threshold).alias("auto_applied")))


def write_files(files: DataFrame, folder: str, path: str = "file_path", content: str = "content", bom: bool = True) -> None:
    """Each row as a file below a shared folder, UTF-8 with a byte-order mark and LF ends. Runs on the executors; a
    repeated task writes the same bytes and replaces the file at once."""

    def write(rows):
        for r in rows:
            parts = [p for p in r[path].replace("\\", "/").split("/") if p not in ("", ".", "..")]
            where = os.path.join(folder, *parts)
            os.makedirs(os.path.dirname(where), exist_ok=True)
            tmp = f"{where}.{os.getpid()}.tmp"
            with open(tmp, "w", encoding="utf-8-sig" if bom else "utf-8", newline="\n") as f:
                f.write((r[content] or "").replace("\r\n", "\n").replace("\r", "\n"))
            os.replace(tmp, where)

    files.select(path, content).foreachPartition(write)


def language_setup(lang: str) -> str:
    """Start-up file that selects the language."""
    return f'init python:\n    config.language = "{lang}"\n'


def init_offset(content: Column, offset: int) -> Column:
    return F.concat(F.lit(f"init offset = {offset}\n\n"), content)
