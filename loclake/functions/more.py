"""Further text functions: line classes, quality flags, tolerant restoring, output blocks, estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loclake.functions import predicates as P
from loclake.functions.text import replace_all, strip

# Forms of script lines by class.
LITERAL = r"(\"([^\"\\]|\\.)*\"|'([^\\']|\\.)*')"
MENU_LINE = rf"\A\s*menu(\s+\w+)?\s*:|\A\s*{LITERAL}\s*(if\s+[^:]+)?\s*:\s*|\A\s*menu\s*{LITERAL}?:"
SCREEN_LINE = rf"\A\s*screen\s+\w+|\A\s*(text|label|tooltip|vbar|slider|frame|window)\s+(_\s*\(\s*)?[rRuUbBfF]{{0,2}}{LITERAL}"
CHARACTER_LINE = rf"\A\s*[A-Za-z_]\w*\s+{LITERAL}"
TECHNICAL_LINE = r"\A(define|init|style|config|gui|store|layout)\b.*=\s*[^\"']+\z"
VALUE_LINE = r"\A([0-9]+|[a-zA-Z0-9_/\\.-]+\.(png|jpg|ogg|mp3|rpy|rpyc)|#[0-9a-fA-F]{3,8})\z"
COMPILED_TYPES = "png jpg jpeg gif webp mp3 ogg wav ttf otf rpy rpyc json".split()


def line_class(line: Column) -> Column:
    return (
        F.when(line.rlike(MENU_LINE), "menu").when(line.rlike(SCREEN_LINE), "screen").when(line.rlike(CHARACTER_LINE), "character")
        .when(line.rlike(TECHNICAL_LINE) | line.rlike(VALUE_LINE), "technical").otherwise("general")
    )


def quality(x: Column) -> Column:
    """struct(is_meaningful, has_grammar_error, is_technically_valid)."""
    technical = F.coalesce(x.rlike(TECHNICAL_LINE) | x.rlike(VALUE_LINE), F.lit(False))
    sound = F.coalesce(F.substr(x, F.lit(1), F.lit(1)).rlike(r"\p{Lu}") & x.rlike(r"[.!?]"), F.lit(False))
    return F.struct((F.coalesce(F.length(strip(x)) > 2, F.lit(False)) & ~technical).alias("is_meaningful"), (~sound).alias("has_grammar_error"), (~technical).alias("is_technically_valid"))


def technical_in_compiled(x: Column, context: Column) -> Column:
    """Strings of compiled scripts that are no text; keyed contexts need a key that names text."""
    s, c = strip(F.coalesce(x, F.lit(""))), F.lower(F.coalesce(context, F.lit("")))
    keyed = c.rlike(r"\A(rpyc_val:|variable:|data:)") & ~c.rlike("|".join(P.KEYS_IN))
    return (
        (F.length(s) < 2) | P.ends_with_type(s, COMPILED_TYPES) | s.rlike(r"\A(images|audio|gui|fonts)/") | s.rlike(P.HEX) | s.rlike(P.NUMBER) | s.rlike(P.SNAKE)
        | ~s.rlike(r"[a-zA-ZÀ-ɏЀ-ӿ]") | keyed
    )


def logical_lines(x: Column) -> Column:
    """Lines that end in a backslash joined with the next by a blank."""
    return F.regexp_replace(x, r"[ \t]*\\[ \t]*\r?\n[ \t]*", " ")


def paragraphs(x: Column) -> Column:
    """Lines trimmed and joined by blanks; blank lines separate paragraphs."""
    trimmed = F.array_join(F.transform(F.split(replace_all(x, ("\r\n", "\n"), ("\r", "\n")), "\n", -1), strip), "\n")
    parts = F.split(F.regexp_replace(trimmed, r"\n{2,}", "\u0001"), "\u0001", -1)
    return F.array_join(F.filter(F.transform(parts, lambda p: strip(F.replace(p, F.lit("\n"), F.lit(" ")))), lambda p: p != ""), "\n\n")


def restore_tolerant(x: Column, keys: Column, tokens: Column) -> Column:
    """Masks ⟦V000⟧ put back even if an engine changed their brackets or put blanks into them."""

    def put(acc: Column, z: Column) -> Column:
        core = F.regexp_replace(z["k"], "[⟦⟧]", "")
        # blanks between the kind and the number of the mask, and other brackets
        loose = F.concat(F.lit(r"[⟦\[【]\s*"), F.regexp_replace(core, r"\A([A-Z]+)", r"$1\\s*"), F.lit(r"\s*[⟧\]】]"))
        token = F.regexp_replace(z["t"], r"([\\$])", r"\\$1")
        return F.regexp_replace(F.replace(acc, z["k"], z["t"]), loose, token)

    return F.aggregate(F.arrays_zip(keys.alias("k"), tokens.alias("t")), x, put)


def old_new_block(original: Column, translated: Column) -> Column:
    esc = lambda c: replace_all(c, ("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"))
    return F.concat(F.lit('    old "'), esc(original), F.lit('"\n    new "'), esc(F.coalesce(translated, F.lit(""))), F.lit('"\n'))


def file_header(lang: Column, time: Column) -> Column:
    return F.concat(F.lit("# Translations: "), lang, F.lit("\n# Written: "), F.date_format(time, "yyyy-MM-dd HH:mm:ss"), F.lit("\n"))


def load_estimate(n_strings: Column, n_files: Column) -> Column:
    """Seconds to load translations: a tenth of a millisecond a string, ten milliseconds a file."""
    return F.round(n_strings * 0.0001 + n_files * 0.01, 3)


def deferred_loading(n_strings: Column) -> Column:
    return F.when(n_strings < 1000, "not needed").when(n_strings < 5000, "optional").when(n_strings < 10000, "advised").otherwise("strongly advised")


def concurrency(n_working: Column) -> Column:
    return F.when(n_working >= 50, 32).when(n_working >= 20, 16).when(n_working >= 10, 8).when(n_working >= 5, 4).when(n_working > 0, 2).otherwise(16)
