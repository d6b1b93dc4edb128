"""Text functions on columns: masking, restoring, ids, escapes, pseudo-translation. No Python runs per row, but
for unicode escapes.

All of them give null for null, but for ids of literals.
"""

from __future__ import annotations

import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Token forms and masks of the localization format.
PROTECT = r"(\{\{|\}\}|\{[^\}]+\}|\[[^\[\]]+\]|\?[A-Za-z]\d{3}\?|⟦[^⟧]+⟧)"
PROTECTED = r"XRPYX[A-Z]+\d+XRPYX"
VARIABLE, TAG = r"\[[^\[\]]+\]", r"\{[^{}]+\}"
DISAMBIGUATION, FORMAT = r"\{#[^}]+\}", r"%\([^)]+\)[sdif]|%[sdif]"
ACCENT_FROM, ACCENT_TO = "aeiouAEIOUyY", "àéîõüÀÉÎÕÜýÝ"


def strip(x: Column) -> Column:
    """Without white space at both ends, as far as ASCII goes."""
    return F.regexp_replace(x, r"\A[ \t\r\n\f]+|[ \t\r\n\f]+\z", "")


# --- masking ------------------------------------------------------------------------------------------------------


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(PROTECT), F.lit(1))


def _kind(token: Column) -> Column:
    return F.when(token.isin("{{", "}}"), "ESC").when(token.startswith("{") & token.endswith("}"), "TAG").otherwise("VAR")


def mask_keys(x: Column) -> Column:
    """The masks that replace the tokens of a text, in their order."""
    return F.transform(tokens(x), lambda t, i: F.concat(F.lit("XRPYX"), _kind(t), i.cast("string"), F.lit("XRPYX")))


def _weave(gaps: Column, fills: Column) -> Column:
    return F.concat_ws("", F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(fills, i), F.lit("")))))


def protect(x: Column) -> Column:
    """Tokens replaced by numbered masks, from left to right."""
    return F.when(x.isNotNull(), _weave(F.split(x, PROTECT, -1), mask_keys(x)))


def restore(masked: Column, keys: Column, toks: Column) -> Column:
    """Masks replaced by their tokens, in the order of the keys."""
    return F.aggregate(F.arrays_zip(keys.alias("k"), toks.alias("t")), masked, lambda acc, z: F.replace(acc, z["k"], z["t"]))


def preserve(x: Column) -> Column:
    """Typed masks in four passes that share one counter: notes, variables, tags, formats.

    Returns struct(text, keys, tokens); a pass replaces the first occurrence of each of its finds, one after another.
    """

    def one(state: Column, pattern: str, key) -> Column:
        found = F.regexp_extract_all(state["text"], F.lit(pattern), F.lit(0))

        def step(s: Column, tok: Column) -> Column:
            name = key(tok, F.lpad(F.size(s["keys"]).cast("string"), 3, "0"))
            at = F.position(tok, s["text"])
            text = F.concat(F.substr(s["text"], F.lit(1), at - 1), name, F.substr(s["text"], at + F.length(tok)))
            return F.struct(F.when(at > 0, text).otherwise(s["text"]).alias("text"), F.concat(s["keys"], F.array(name)).alias("keys"), F.concat(s["tokens"], F.array(tok)).alias("tokens"))

        return F.aggregate(found, state, step)

    none = F.array().cast("array<string>")
    state = F.struct(x.alias("text"), none.alias("keys"), none.alias("tokens"))
    state = one(state, DISAMBIGUATION, lambda t, n: F.concat(F.lit("⟦D"), n, F.lit("⟧")))
    state = one(state, r"\[([^\]]+)\]", lambda t, n: F.concat(F.when(F.contains(t, F.lit("!t")), "⟦VT").otherwise("⟦V"), n, F.lit("⟧")))
    state = one(state, r"\{[^}]*\}", lambda t, n: F.concat(F.lit("⟦T"), n, F.lit("⟧")))
    return one(state, FORMAT, lambda t, n: F.concat(F.lit("⟦F"), n, F.lit("⟧")))


def pseudo(x: Column, mode: str = "both") -> Column:
    """Pseudo-translation: text between tokens gets accents and/or expansion marks, tokens and blanks stay."""

    def change(g: Column) -> Column:
        out = F.translate(g, ACCENT_FROM, ACCENT_TO) if mode in ("accent", "both") else g
        out = F.concat(F.lit("[!!! "), out, F.lit(" !!!]")) if mode in ("expand", "both") else out
        return F.when(F.trim(F.translate(g, "\t\r\n", "   ")) == "", g).otherwise(out)

    gaps = F.transform(F.split(x, PROTECT, -1), change)
    return F.when(x.isNotNull(), _weave(gaps, tokens(x)))


def placeholders_kept(original: Column, translated: Column) -> Column:
    """Whether every variable of the original occurs in the translation."""
    return F.forall(F.regexp_extract_all(original, F.lit(r"\[[^\]]+\]"), F.lit(0)), lambda v: F.contains(translated, v))


def lost(original: Column, translated: Column, pattern: str) -> Column:
    """Distinct tokens of a form that the first text has and the second hasn't, sorted."""
    found = lambda c: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.array_sort(F.array_except(found(original), found(translated)))


# --- ids ----------------------------------------------------------------------------------------------------------


def unix_lines(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def translation_id(path: Column, line: Column, context: Column, text: Column) -> Column:
    """Content-based id of a text whose escapes are resolved: "id_" and 16 digits of SHA-1.

    Text beyond ASCII is hashed as its UTF-8 bytes read as Latin-1, which keeps ids equal to those of older exports.
    """
    bare = F.when(text.rlike(r'(?s)\A".*"\z') | text.rlike(r"(?s)\A'.*'\z"), F.substr(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    latin = F.decode(F.encode(unix_lines(bare), "UTF-8"), "ISO-8859-1")
    base = F.concat_ws("|", F.replace(path, F.lit("\\"), F.lit("/")), line.cast("string"), F.coalesce(F.array_join(context, "|"), F.lit("")), unix_lines(latin))
    return F.concat(F.lit("id_"), F.substr(F.sha1(base), F.lit(1), F.lit(16)))


def resolved(text: str | None) -> str:
    """The form of a literal that ids are made of: no outer quotes, line feeds, escapes resolved where they are valid.

    Escapes are resolved over the UTF-8 bytes read as Latin-1; where one is invalid only the common ones are replaced.
    """
    x = text or ""
    if x.startswith('"') and x.endswith('"') or x.startswith("'") and x.endswith("'"):
        x = x[1:-1]
    x = x.replace("\r\n", "\n").replace("\r", "\n")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            x = x.encode("utf-8").decode("unicode_escape")
    except UnicodeError:
        pass
    for a, b in (("\\r\\n", "\n"), ("\\r", "\n"), ("\\n", "\n"), ("\\t", "\t"), ('\\"', '"'), ("\\'", "'"), ("\\\\", "\\"), ("\r\n", "\n"), ("\r", "\n")):
        x = x.replace(a, b)
    return x.encode("utf-8", "ignore").decode("utf-8")


@F.pandas_udf(T.StringType())
def resolved_udf(x: pd.Series) -> pd.Series:
    return pd.Series([resolved(v) for v in x], dtype=object)


def translation_id_of_literal(path: Column, line: Column, context: Column, text: Column) -> Column:
    """``translation_id`` of a text as written, escapes included."""
    base = F.concat_ws("|", F.replace(path, F.lit("\\"), F.lit("/")), line.cast("string"), F.coalesce(F.array_join(context, "|"), F.lit("")), resolved_udf(text))
    return F.concat(F.lit("id_"), F.substr(F.sha1(base), F.lit(1), F.lit(16)))


def hash_id(path: Column, line: Column, context: Column, text: Column) -> Column:
    base = F.concat(F.coalesce(path, F.lit("")), F.lit(":"), line.cast("string"), F.lit(":"), F.coalesce(F.array_join(context, "|"), F.lit("")), F.lit(":"), text)
    return F.concat(F.lit("id_"), F.substr(F.sha1(base), F.lit(1), F.lit(16)))


def block_id(x: Column) -> Column:
    return F.concat(F.lit("strings_"), F.substr(F.md5(x), F.lit(1), F.lit(8)))


def sanitize_id(x: Column) -> Column:
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[^a-zA-Z0-9_]", "_"), "_+", "_"), r"\A_|_\z", "")
    named = F.when(flat.rlike(r"\A[0-9]"), F.concat(F.lit("_"), flat)).when(flat == "", F.lit("translated_text")).otherwise(flat)
    return F.substr(named, F.lit(1), F.lit(50))


# --- escapes and layout -------------------------------------------------------------------------------------------


def replace_all(x: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def escape(x: Column) -> Column:
    return replace_all(x, ("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"))


def unescape(x: Column) -> Column:
    """In the order of older exports: an escaped backslash before n becomes a line end."""
    return replace_all(x, ("\\n", "\n"), ("\\t", "\t"), ('\\"', '"'), ("\\\\", "\\"))


def unescape_literal(x: Column) -> Column:
    return replace_all(x, ("\\r\\n", "\n"), ("\\r", "\n"), ("\\n", "\n"), ("\\t", "\t"), ('\\"', '"'), ("\\'", "'"), ("\\\\", "\\"))


def unquote(x: Column) -> Column:
    """A literal as written without prefix and quotes, with quotes and line ends unescaped; backslashes stay doubled."""
    bare = F.regexp_replace(x, r"(?s)\A[rRuUbBfF]{0,2}(\"\"\"|'''|\"|')(.*)\1\z", "$2")
    return replace_all(bare, ('\\"', '"'), ("\\'", "'"), ("\\n", "\n"), ("\\t", "\t"))


def raw_and_text(x: Column) -> Column:
    """struct(raw_text, text) of a literal as written."""
    return F.struct(x.alias("raw_text"), unquote(x).alias("text"))


def escape_kept(x: Column) -> Column:
    """Escapes for output that leave variables, tags and notes as they are; doubled brackets become escaped ones."""
    kept = r"\{#[^}]+\}|\[[^\[\]]+\]|\{[^{}]*\}"
    plain = lambda g: replace_all(g, ("[[", "\\[\\["), ("{{", "\\{\\{"), ("\\", "\\\\"), ('"', '\\"'), ("\r", ""), ("\n", "\\n"), ("\t", "\\t"))
    return F.when(x.isNotNull(), _weave(F.transform(F.split(x, kept, -1), plain), F.regexp_extract_all(x, F.lit(kept), F.lit(0))))


def canonical(x: Column) -> Column:
    """The form in which texts are compared between extraction passes: escapes resolved, line feeds, null as empty."""
    return resolved_udf(x)


def version_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by the numbers of two versions; missing parts count as 0."""
    parts = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"[0-9]+"), F.lit(0)), lambda v: v.cast("decimal(38,0)"))
    pairs = F.zip_with(parts(a), parts(b), lambda x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))
    return F.coalesce(F.get(F.filter(F.transform(pairs, lambda d: F.signum(d).cast("int")), lambda d: d != 0), F.lit(0)), F.lit(0))


def subset(a: Column, b: Column) -> Column:
    """Whether every element of the first list occurs in the second."""
    return F.size(F.array_except(a, b)) == 0


def paragraph(x: Column) -> Column:
    """Paragraph markup: trimmed lines indented by four blanks within _p("\"\" … "\"\")."""
    body = F.array_join(F.transform(F.split(x, "\n", -1), lambda s: F.concat(F.lit("    "), strip(s))), "\n")
    return F.concat(F.lit('_p("""\n'), body, F.lit('\n""")'))


def normalized(x: Column, lower: bool = True) -> Column:
    flat = strip(F.regexp_replace(x, r"[ \t\r\n\f]+", " "))
    return F.lower(flat) if lower else flat


def keep_case(source: Column, target: Column) -> Column:
    """The case of a source word given to its target: all capitals, a capital first letter, or as it is."""
    first = F.substr(source, F.lit(1), F.lit(1))
    cased = (F.upper(first) == first) & (F.lower(first) != first)
    up = (F.upper(source) == source) & (F.lower(source) != source)
    return F.when(up, F.upper(target)).when(cased, F.concat(F.upper(F.substr(target, F.lit(1), F.lit(1))), F.lower(F.substr(target, F.lit(2))))).otherwise(target)


def odd_quotes(x: Column) -> Column:
    """Whether a line that is no comment has an odd number of unescaped double quotes."""
    return ~strip(x).startswith("#") & (F.regexp_count(F.regexp_replace(x, r"\\.", ""), F.lit('"')) % 2 == 1)


def indent(x: Column, tab: int = 4) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(x, r"\A[ \t]*", 0), "\t", " " * tab))


def version_parts(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit(r"\d+"), F.lit(0)), lambda v: v.cast("int"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1), -1)


def context_string(screen: Column, label: Column, character: Column, text_type: Column) -> Column:
    """"screen:a > label:b > char:c > type", without the parts that are null."""
    part = lambda name, c: F.concat(F.lit(f"{name}:"), c)
    return F.concat_ws(" > ", part("screen", screen), part("label", label), part("char", character), text_type)


def preview(x: Column, n: int = 50) -> Column:
    return F.when(F.length(x) > n, F.concat(F.substr(x, F.lit(1), F.lit(n)), F.lit("..."))).otherwise(x)
