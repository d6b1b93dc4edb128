"""Filters that tell translatable text from technical strings, as columns; null counts as empty."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from loclake.functions.text import strip

# Names, file types and keys with a technical meaning in scripts and data files.
SCREEN_TERMS = "left right center top bottom gui config true false none auto png jpg mp3 ogg".split()
UI_TERMS = (
    "say window namebox choice quick navigation return_button page_label page_label_text slot slot_time_text slot_name_text save_delete pref radio check slider tooltip_icon "
    "tooltip_frame dismiss history_name color confirm_prompt notify nvl_window nvl_button medium touch small replay_locked show hide unicode left right center top bottom "
    "true false none null auto add_post card money_get money_pay mp pass_time rel_down rel_up input output default value id name type style action hovered unhovered "
    "selected insensitive activate alternate"
).split()
STATE_TERMS = "idle hover focus selected_idle selected_hover selected_focus selected_insensitive".split()
FILE_TYPES = "otf ttf woff woff2 png jpg jpeg gif webp bmp ico mp3 ogg wav flac aac m4a mp4 webm avi mkv mov rpy rpyc rpa py".split()
MORE_FILE_TYPES = "eot svg opus ogv rpym rpymc pyc pyo json txt xml csv yaml yml zip rar 7z tar gz".split()
FOLDERS = "fonts images audio music sounds gui screens script game tl".split()
KEYS_OUT = "id code name_id image img icon sfx sound audio voice file path url link type ref var value_id texture".split()
KEYS_IN = (
    "name title description desc text content caption label prompt help header footer message dialogue summary quest objective char character tips hints notes log history "
    "inventory items objectives goals achievements gallery"
).split()
CALL, ATTRIBUTE, KEY_VALUE = r"\A[A-Za-z_]\w*\s*\(.*\)\z", r"\A[A-Za-z_]\w*\.[A-Za-z_]\w*\z", r"\A[A-Za-z0-9_\-]+\s*:\s*[A-Za-z0-9_\-]+\z"
SNAKE, SCREAMING, CAMEL = r"\A[a-z][a-z0-9]*(_[a-z0-9]+)+\z", r"\A[A-Z][A-Z0-9]*(_[A-Z0-9]+)+\z", r"\A[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*\z"
SAVE_NAME, VERSION, HEX, NUMBER = r"\A[A-Za-z_][A-Za-z0-9_]*-\d+\z", r"\Av?\d+\.\d+(\.\d+)?([a-z])?\z", r"\A#[0-9a-fA-F]{3,8}\z", r"\A-?\d+\.?\d*\z"
URL, MASK = r"\A(https?://|ftp://|mailto:|www\.)", r"(\[[^\]]+\]|\{[^}]+\})"
MEDIA = r"\.(png|jpg|mp3|ogg)"
LONE_MASK = r"\A\s*(\[[^\]]+\]|\{[^}]+\}|%s|%\([^)]+\)[sdif])\s*\z"
TECHNICAL = r"\A#[0-9a-f]+\z|\.ttf\z|\A%s[%\s]*\z|fps|renderer|ms\z|\A[0-9.]+\z|game_menu|sync|input|overlay|vertical|horizontal|linear|touch_keyboard|subtitle|empty"
SLASHED, BACKSLASHED = r"\A[a-zA-Z0-9_/.\-]+\z", r"\A[a-zA-Z0-9_\\.\-]+\z"


def letters(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"\p{L}"))


def unmasked(x: Column) -> Column:
    return F.regexp_replace(x, MASK, "")


def ends_with_type(x: Column, types: list[str]) -> Column:
    return F.lower(x).rlike(r"\.(" + "|".join(types) + r")\z")


def two_letters(x: Column) -> Column:
    """At least two letters outside masks."""
    return F.coalesce(letters(unmasked(x)) >= 2, F.lit(False))


def _format_string(s: Column, word: str) -> Column:
    """Braces with hardly a word outside them."""
    n, rest = F.regexp_count(s, F.lit(r"\{[^}]*\}")), strip(F.regexp_replace(s, r"\{[^}]*\}", ""))
    return (n >= 1) & ~rest.rlike(word) | (n >= 2) & (F.length(rest) < 10)


def is_meaningful(x: Column) -> Column:
    """Whether a string found in a script is text for people."""
    s, low = strip(x), F.lower(strip(x))
    block = F.contains(x, F.lit("\n")) & (F.contains(F.lower(x), F.lit("translate ")) | F.lower(x).rlike(r"(\A|\n)\s*(old|new)\b"))
    first = F.substr(x, F.lit(1), F.lit(1))
    rest, n = strip(F.regexp_replace(s, r"\{[^}]*\}", "")), F.regexp_count(s, F.lit(r"\{[^}]*\}"))
    braces = (n >= 1) & (~rest.rlike(r"\p{L}") | ~rest.rlike(r".{3,}")) | (n >= 2) & (F.length(rest) < 10)
    verdict = (
        F.when(x.isNull() | (F.length(s) < 2), False)
        .when(block | low.isin("old", "new", *SCREEN_TERMS) | x.rlike(LONE_MASK) | braces | low.rlike(TECHNICAL) | low.rlike(MEDIA) | s.rlike(r"\A[-+]?\d+\z"), False)
        .when(s.rlike(r"\A\d+(?:\.\d+)+\z"), True)
        .when(first.rlike(r"\p{Lu}") & F.contains(x, F.lit(" ")), True)
        .when(x.rlike(r"\p{Ll}") & ~x.rlike(r"[\p{Lu}\p{Lt}]") & ~F.contains(x, F.lit(" ")), False)
        .when(x.rlike(r"(?s)\A_\(\".*\"\)\z") | x.rlike(r"(?s)\A_\('.*'\)\z") | s.rlike(CALL) | s.rlike(ATTRIBUTE) | s.rlike(KEY_VALUE), False)
        .when(letters(unmasked(s)) < 2, False)
        .otherwise(x.rlike(r"\p{L}"))
    )
    return verdict


def _path_like(s: Column) -> Column:
    no_blank = ~F.contains(s, F.lit(" "))
    return (
        s.rlike(r"\A(" + "|".join(FOLDERS) + ")/")
        | F.contains(s, F.lit("/")) & no_blank & s.rlike(SLASHED)
        | F.contains(s, F.lit("\\")) & no_blank & s.rlike(BACKSLASHED)
    )


def _only_masks(s: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(s, r"\{[^{}]*\}", ""), r"\[[^\[\]]+\]", "")) == ""


def should_skip(x: Column) -> Column:
    """The safety net before output: whether a text must not be offered for translation."""
    s = strip(F.coalesce(x, F.lit("")))
    return (
        (s == "")
        | _format_string(s, r"[a-zA-ZçğıöşüÇĞIİÖŞÜа-яА-Я]{3,}")
        | ends_with_type(s, FILE_TYPES)
        | _path_like(s)
        | F.lower(s).rlike(URL)
        | s.rlike(HEX)
        | s.rlike(NUMBER)
        | s.isin(*UI_TERMS, *STATE_TERMS)
        | s.rlike(CALL)
        | s.rlike(ATTRIBUTE)
        | s.rlike(KEY_VALUE)
        | s.rlike(r"[⟦⟧]|\?[A-Za-z]\d{3}\?")
        | F.contains(s, F.lit("config.version"))
        | F.contains(s, F.lit("[config."))
        | s.rlike(SNAKE)
        | s.rlike(SCREAMING)
        | s.rlike(SAVE_NAME)
        | F.lower(s).rlike(VERSION)
        | _only_masks(s)
    )


def should_translate(x: Column, text_type: Column, off: tuple[str, ...] = ()) -> Column:
    """Technical strings out, then text types that are switched off."""
    s = strip(F.coalesce(x, F.lit("")))
    technical = (
        (s == "")
        | ends_with_type(s, FILE_TYPES + MORE_FILE_TYPES)
        | _path_like(s)
        | F.lower(s).rlike(r"\A(https?://|ftp://|mailto:|file://|www\.)")
        | s.rlike(HEX)
        | s.rlike(NUMBER)
        | F.lower(s).rlike(r"\A\d+(\.\d+)?(px|em|rem|%|pt|vh|vw)\z")
        | s.isin(*UI_TERMS)
        | s.rlike(SNAKE)
        | s.rlike(SCREAMING)
        | s.rlike(CAMEL)
        | s.rlike(SAVE_NAME)
        | F.lower(s).rlike(VERSION)
        | (F.length(s) == 1) & ~s.rlike(r"\p{L}")
        | (strip(F.regexp_replace(F.regexp_replace(s, r"\{[^}]*\}", ""), r"\[[^\]]*\]", "")) == "")
    )
    return ~technical & (~F.lower(F.coalesce(text_type, F.lit("dialogue"))).isin(*off) if off else F.lit(True))


def skip_in_translation_file(x: Column) -> Column:
    s = strip(F.coalesce(x, F.lit("")))
    return (F.length(s) <= 1) | s.rlike(r"\?[A-Za-z]\d{3}\?|[⟦⟧]") | F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("")).rlike(r"\A[0-9]+\z")


def meaningful_value(value: Column, key: Column) -> Column:
    """Filter of data files: by key where there is one, else by content."""
    s, k = strip(value), F.lower(key)
    plain = ~s.rlike(r"\A[-+]?\d+(\.\d+)?\z") & ~s.rlike(r"\A(#|http)")
    return F.when(value.isNull() | (value == ""), False).when(key.isNotNull() & (key != ""), k.isin(*KEYS_IN) & ~k.isin(*KEYS_OUT) & plain).otherwise(plain & ~F.lower(value).rlike(MEDIA + r"\z") & two_letters(value))


def technical_in_scan(x: Column) -> Column:
    s = strip(x)
    return (F.length(s) <= 1) | F.contains(s, F.lit("/")) | s.rlike(r"\A#[0-9a-fA-F]+\z") | s.rlike(r"\A[0-9]+\z") | s.rlike(ATTRIBUTE)


def false_positive(x: Column) -> Column:
    s = strip(F.coalesce(x, F.lit("")))
    return (s == "") | (F.length(s) < 4) & ~s.rlike(r"\p{L}") | (letters(unmasked(s)) < 2) | s.rlike(r"\A(l[aA][bB][eE][lL]|s[cC][eE][nN][eE]) ") | s.startswith("$")


def text_type_of(context_path: Column, context_line: Column) -> Column:
    """Type of a text by its contexts, else by words of its line."""
    inside = lambda p: F.coalesce(F.exists(context_path, lambda c: F.lower(c).startswith(p)), F.lit(False))
    line = F.lower(F.coalesce(context_line, F.lit("")))
    has = lambda *ws: reduce(or_, [F.contains(line, F.lit(w)) for w in ws])
    return (
        F.when(inside("menu"), "menu").when(inside("screen"), "ui").when(inside("python"), "renpy_func").when(inside("label"), "dialogue")
        .when(has("_p("), "paragraph").when(has("notify("), "notify").when(has("confirm("), "confirm").when(has("alt ", "alt="), "alt_text")
        .when(has("input") & has("default", "prefix", "suffix"), "input").when(has("textbutton"), "button").when(has("menu"), "menu").when(has("screen"), "ui")
        .when(has("config."), "config").when(has("gui."), "gui").when(has("style."), "style").when(has("renpy.", " input("), "renpy_func")
        .otherwise("dialogue")
    )


def needs_translation(translated: Column) -> Column:
    return F.coalesce(strip(translated), F.lit("")) == ""


def in_context(context_path: Column, prefix: str) -> Column:
    return F.coalesce(F.exists(context_path, lambda c: c.startswith(prefix)), F.lit(False))


def never_translate(x: Column, exact: list[str] = (), contains: list[str] = (), patterns: list[str] = ()) -> Column:
    """User rules; rules are few and become literals of the plan."""
    out = F.lit(False)
    if exact:
        out = out | x.isin(*exact)
    for c in contains:
        out = out | F.contains(x, F.lit(c))
    for p in patterns:
        out = out | x.rlike(p)
    return F.coalesce(out, F.lit(False))


def engine_file(path: Column) -> Column:
    """Files of the engine itself, but for its common folder."""
    return path.startswith("renpy/") & ~path.startswith("renpy/common")


def in_language_folder(path: Column, lang: str) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/"))).rlike(rf"(\A|/)tl/{lang.lower()}/")


def deep_scan_candidate(x: Column, in_python: Column, line: Column) -> Column:
    """Whether a literal outside the statement passes may be text: long notifications always, else by form and line."""
    s, low, where = strip(F.coalesce(x, F.lit(""))), F.lower(strip(F.coalesce(x, F.lit("")))), F.lower(F.coalesce(line, F.lit("")))
    notify = strip(F.coalesce(line, F.lit(""))).startswith("renpy.notify")
    technical = (
        low.rlike(r"\.(png|jpg|mp3|ogg|ttf|otf|rpy)") | s.rlike(r"\A[a-z_][a-z0-9_]*\z") | s.rlike(r"\A[a-z]+[A-Z][a-zA-Z0-9]*\z") | s.rlike(HEX) | where.rlike("transform|style|image |audio |register_")
        | s.rlike(r"\A(\[[^\]]+\]|\{[^}]+\})+\z") | ~s.rlike(r"\p{L}") | (F.length(x) > 300) & notify & ~x.rlike(r"[{\[]")
    )
    return F.when((F.length(x) > 300) & in_python & notify, True).when(F.length(s) < 3, False).otherwise(F.coalesce(is_meaningful(x) & ~technical, F.lit(False)))


def usable(working: Column, success_rate: Column) -> Column:
    """Endpoints that may be used while any of them is: working and right more often than not."""
    return working & (success_rate > 0.5)


def first_match(x: Column, rules: list[tuple[str, str]]) -> Column:
    """The type of the first of an ordered table of patterns that a line matches, else null; off where no rule is given."""
    found = [F.when(x.rlike(p), t) for p, t in rules]
    return F.coalesce(*found) if found else F.lit(None).cast("string")
