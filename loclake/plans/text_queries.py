"""Queries of the scalar functions and filters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loclake.functions import predicates as P
from loclake.functions import text as X
from loclake.plans.tables import t
from loclake.sources import text as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under the function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _in(words) -> str:
    return "(" + ", ".join("'" + w + "'" for w in words) + ")"


STRIP = r"regexp_replace({}, '\A[ \t\r\n\f]+|[ \t\r\n\f]+\z', '', 'g')"
LETTERS = r"len(regexp_extract_all({}, '\p{{L}}'))"
UNMASK = r"regexp_replace({}, '(\[[^\]]+\]|\{{[^}}]+\}})', '', 'g')"
FOLDERS = "|".join(P.FOLDERS)


def strip(x: str) -> str:
    return STRIP.format(x)


def letters(x: str) -> str:
    return LETTERS.format(x)


def unmask(x: str) -> str:
    return UNMASK.format(x)


# --- sources ------------------------------------------------------------------------------------------------------

LINES = r"""
WITH ls AS (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS a FROM documents WHERE text IS NOT NULL),
     b AS (SELECT doc_id, CASE WHEN a[len(a)] = '' THEN a[1:len(a)-1] ELSE a END AS a FROM ls),
     n AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1)::INT AS line_number FROM b)
"""


@query(LINES + "SELECT doc_id, line_number, line FROM n")
def scan_lines(spark, d):
    """Lines of every text."""
    return S.lines(t(spark, d, "documents"), "text", ("doc_id",))


@query(LINES + f"SELECT doc_id, line_number, {strip('line')} AS text, 'txt:line' || line_number AS context_line FROM n WHERE {letters(unmask(strip('line')))} >= 2")
def txt_extract(spark, d):
    """Lines with at least two letters outside masks."""
    return S.txt_entries(t(spark, d, "documents"), "text", ("doc_id",))


@query("SELECT event_id, key AS context_line, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events WHERE props IS NOT NULL)")
def json_leaves(spark, d):
    """S07 on columns: leaves of flat JSON values, by variant."""
    e = t(spark, d, "events").where("props is not null")
    m = F.from_json("props", "map<string,string>")
    return e.select("event_id", F.explode(m).alias("context_line", "value"))


@query(r"""SELECT doc_id, file_path FROM documents WHERE file_path IS NOT NULL AND NOT starts_with(file_path, 'tl/') AND NOT (starts_with(file_path, 'renpy/') AND NOT starts_with(file_path, 'renpy/common'))
           AND regexp_matches(file_path, '\.(rpy|rpym|json|csv|txt|yaml|xml|ini)\z')""")
def scan_dispatch(spark, d):
    """Files that a scan takes."""
    p = F.col("file_path")
    return t(spark, d, "documents").where(~p.startswith("tl/") & ~P.engine_file(p) & p.rlike(r"\.(" + "|".join(S.EXTENSIONS) + r")\z")).select("doc_id", "file_path")


# --- filters ------------------------------------------------------------------------------------------------------


@query(f"SELECT entry_id, coalesce({letters(unmask('text'))} >= 2, false) AS ok FROM entries")
def two_letter_rule(spark, d):
    """F06."""
    return t(spark, d, "entries").select("entry_id", P.two_letters(F.col("text")).alias("ok"))


_REST = r"regexp_replace(s, '\{[^}]*\}', '', 'g')"
_N = r"len(regexp_extract_all(s, '\{[^}]*\}'))"
MEANINGFUL = rf"""
WITH a AS (SELECT *, {strip('x')} AS s FROM (SELECT entry_id, text AS x FROM entries)),
     b AS (SELECT *, lower(s) AS low, {strip(_REST)} AS rest, {_N} AS nb FROM a)
SELECT entry_id, CASE
  WHEN x IS NULL OR length(s) < 2 THEN false
  WHEN (contains(x, chr(10)) AND (contains(lower(x), 'translate ') OR regexp_matches(lower(x), '(\A|\n)\s*(old|new)\b')))
    OR low IN {_in(['old', 'new', *P.SCREEN_TERMS])} OR regexp_matches(x, '{P.LONE_MASK}')
    OR (nb >= 1 AND (NOT regexp_matches(rest, '\p{{L}}') OR NOT regexp_matches(rest, '.{{3,}}'))) OR (nb >= 2 AND length(rest) < 10)
    OR regexp_matches(low, '{P.TECHNICAL}') OR regexp_matches(low, '{P.MEDIA}') OR regexp_matches(s, '\A[-+]?\d+\z') THEN false
  WHEN regexp_matches(s, '\A\d+(?:\.\d+)+\z') THEN true
  WHEN regexp_matches(substr(x, 1, 1), '\p{{Lu}}') AND contains(x, ' ') THEN true
  WHEN regexp_matches(x, '\p{{Ll}}') AND NOT regexp_matches(x, '[\p{{Lu}}\p{{Lt}}]') AND NOT contains(x, ' ') THEN false
  WHEN regexp_matches(x, '(?s)\A_\(".*"\)\z') OR regexp_matches(x, '(?s)\A_\(''.*''\)\z') OR regexp_matches(s, '{P.CALL}') OR regexp_matches(s, '{P.ATTRIBUTE}') OR regexp_matches(s, '{P.KEY_VALUE}') THEN false
  WHEN {letters(unmask('s'))} < 2 THEN false
  ELSE regexp_matches(x, '\p{{L}}') END AS ok FROM b"""


@query(MEANINGFUL)
def meaningful_filter(spark, d):
    """F01."""
    return t(spark, d, "entries").select("entry_id", P.is_meaningful(F.col("text")).alias("ok"))


_PATHS = rf"""regexp_matches(s, '\A({FOLDERS})/') OR (contains(s, '/') AND NOT contains(s, ' ') AND regexp_matches(s, '{P.SLASHED}'))
    OR (contains(s, '\') AND NOT contains(s, ' ') AND regexp_matches(s, '{P.BACKSLASHED}'))"""
SKIP = rf"""
WITH a AS (SELECT result_id, {strip("coalesce(translated_text, '')")} AS s FROM results),
     b AS (SELECT *, {strip(_REST)} AS rest, {_N} AS nb FROM a)
SELECT result_id, (s = '' OR (nb >= 1 AND NOT regexp_matches(rest, '[a-zA-ZçğıöşüÇĞIİÖŞÜа-яА-Я]{{3,}}')) OR (nb >= 2 AND length(rest) < 10)
    OR regexp_matches(lower(s), '\.({"|".join(P.FILE_TYPES)})\z') OR {_PATHS} OR regexp_matches(lower(s), '{P.URL}') OR regexp_matches(s, '{P.HEX}') OR regexp_matches(s, '{P.NUMBER}')
    OR s IN {_in(P.UI_TERMS + P.STATE_TERMS)} OR regexp_matches(s, '{P.CALL}') OR regexp_matches(s, '{P.ATTRIBUTE}') OR regexp_matches(s, '{P.KEY_VALUE}')
    OR regexp_matches(s, '[⟦⟧]|\?[A-Za-z]\d{{3}}\?') OR contains(s, 'config.version') OR contains(s, '[config.') OR regexp_matches(s, '{P.SNAKE}') OR regexp_matches(s, '{P.SCREAMING}')
    OR regexp_matches(s, '{P.SAVE_NAME}') OR regexp_matches(lower(s), '{P.VERSION}')
    OR {strip(r"regexp_replace(regexp_replace(s, '\{[^{}]*\}', '', 'g'), '\[[^\[\]]+\]', '', 'g')")} = '') AS skip FROM b"""


@query(SKIP)
def skip_filter(spark, d):
    """F03."""
    return t(spark, d, "results").select("result_id", P.should_skip(F.col("translated_text")).alias("skip"))


SHOULD = rf"""
WITH a AS (SELECT token_id, text_type, {strip("coalesce(text, '')")} AS s FROM tokens)
SELECT token_id, NOT (s = '' OR regexp_matches(lower(s), '\.({"|".join(P.FILE_TYPES + P.MORE_FILE_TYPES)})\z') OR {_PATHS}
    OR regexp_matches(lower(s), '\A(https?://|ftp://|mailto:|file://|www\.)') OR regexp_matches(s, '{P.HEX}') OR regexp_matches(s, '{P.NUMBER}')
    OR regexp_matches(lower(s), '\A\d+(\.\d+)?(px|em|rem|%|pt|vh|vw)\z') OR s IN {_in(P.UI_TERMS)} OR regexp_matches(s, '{P.SNAKE}') OR regexp_matches(s, '{P.SCREAMING}')
    OR regexp_matches(s, '{P.CAMEL}') OR regexp_matches(s, '{P.SAVE_NAME}') OR regexp_matches(lower(s), '{P.VERSION}') OR (length(s) = 1 AND NOT regexp_matches(s, '\p{{L}}'))
    OR {strip(r"regexp_replace(regexp_replace(s, '\{[^}]*\}', '', 'g'), '\[[^\]]*\]', '', 'g')")} = '')
  AND lower(coalesce(text_type, 'dialogue')) NOT IN ('ui', 'button') AS ok FROM a"""


@query(SHOULD)
def should_translate(spark, d):
    """F02 and F17, with two text types switched off."""
    return t(spark, d, "tokens").select("token_id", P.should_translate(F.col("text"), F.col("text_type"), ("ui", "button")).alias("ok"))


@query(rf"""WITH a AS (SELECT tl_id, {strip("coalesce(original_text, '')")} AS s FROM tl_entries)
SELECT tl_id, length(s) <= 1 OR regexp_matches(s, '\?[A-Za-z]\d{{3}}\?|[⟦⟧]') OR regexp_matches(replace(replace(s, '.', ''), ',', ''), '\A[0-9]+\z') AS skip FROM a""")
def tl_skip(spark, d):
    """F04."""
    return t(spark, d, "tl_entries").select("tl_id", P.skip_in_translation_file(F.col("original_text")).alias("skip"))


FIELDS = r"""WITH f AS (SELECT entry_id, unnest(string_split(text, '; ')) AS f FROM entries WHERE regexp_matches(text, '\A\w+=[^;=]*(; \w+=[^;=]*)+\z')),
     kv AS (SELECT entry_id, split_part(f, '=', 1) AS k, split_part(f, '=', 2) AS v FROM f)"""


@query(FIELDS + rf""" SELECT entry_id, k AS key_name, v AS value, CASE WHEN v IS NULL OR v = '' THEN false WHEN k IS NOT NULL AND k <> ''
   THEN lower(k) IN {_in(P.KEYS_IN)} AND lower(k) NOT IN {_in(P.KEYS_OUT)} AND NOT regexp_matches({strip('v')}, '\A[-+]?\d+(\.\d+)?\z') AND NOT regexp_matches({strip('v')}, '\A(#|http)') END AS ok FROM kv""")
def keyed_value_filter(spark, d):
    """F05 on the fields of name=value lists."""
    e = t(spark, d, "entries").where(F.col("text").rlike(r"\A\w+=[^;=]*(; \w+=[^;=]*)+\z")).select("entry_id", F.explode(F.split("text", "; ")).alias("f"))
    kv = e.select("entry_id", F.split_part("f", F.lit("="), F.lit(1)).alias("key_name"), F.split_part("f", F.lit("="), F.lit(2)).alias("value"))
    return kv.withColumn("ok", P.meaningful_value(F.col("value"), F.col("key_name")))


@query(rf"""WITH a AS (SELECT entry_id, {strip("coalesce(context_line, '')")} AS s FROM entries)
SELECT entry_id, length(s) <= 1 OR contains(s, '/') OR regexp_matches(s, '\A#[0-9a-fA-F]+\z') OR regexp_matches(s, '\A[0-9]+\z') OR regexp_matches(s, '{P.ATTRIBUTE}') AS technical FROM a""")
def technical_scan(spark, d):
    """F08."""
    return t(spark, d, "entries").select("entry_id", P.technical_in_scan(F.coalesce("context_line", F.lit(""))).alias("technical"))


FALSE_POSITIVE = rf"""(s = '' OR (length(s) < 4 AND NOT regexp_matches(s, '\p{{L}}')) OR {letters(unmask('s'))} < 2 OR regexp_matches(s, '\A(l[aA][bB][eE][lL]|s[cC][eE][nN][eE]) ') OR starts_with(s, '$'))"""


@query(f"""WITH a AS (SELECT entry_id, {strip("coalesce(text, '')")} AS s FROM entries) SELECT entry_id, {FALSE_POSITIVE} AS flagged FROM a""")
def false_positive_flag(spark, d):
    """F14."""
    return t(spark, d, "entries").select("entry_id", P.false_positive(F.col("text")).alias("flagged"))


def _inside(p: str) -> str:
    return f"len(list_filter(coalesce(context_path, []), lambda c: starts_with(lower(c), '{p}'))) > 0"


def _has(*ws: str) -> str:
    return "(" + " OR ".join(f"contains(line, '{w}')" for w in ws) + ")"


@query(f"""WITH a AS (SELECT entry_id, context_path, lower(coalesce(context_line, '')) AS line FROM entries)
SELECT entry_id, CASE WHEN {_inside('menu')} THEN 'menu' WHEN {_inside('screen')} THEN 'ui' WHEN {_inside('python')} THEN 'renpy_func' WHEN {_inside('label')} THEN 'dialogue'
  WHEN {_has('_p(')} THEN 'paragraph' WHEN {_has('notify(')} THEN 'notify' WHEN {_has('confirm(')} THEN 'confirm' WHEN {_has('alt ', 'alt=')} THEN 'alt_text'
  WHEN {_has('input')} AND {_has('default', 'prefix', 'suffix')} THEN 'input' WHEN {_has('textbutton')} THEN 'button' WHEN {_has('menu')} THEN 'menu' WHEN {_has('screen')} THEN 'ui'
  WHEN {_has('config.')} THEN 'config' WHEN {_has('gui.')} THEN 'gui' WHEN {_has('style.')} THEN 'style' WHEN {_has('renpy.', ' input(')} THEN 'renpy_func' ELSE 'dialogue' END AS text_type FROM a""")
def text_type(spark, d):
    """F10."""
    return t(spark, d, "entries").select("entry_id", P.text_type_of(F.col("context_path"), F.col("context_line")).alias("text_type"))


@query(f"""SELECT tl_id, coalesce({strip('translated_text')}, '') = '' AS needs FROM tl_entries""")
def needs_translation(spark, d):
    """F15."""
    return t(spark, d, "tl_entries").select("tl_id", P.needs_translation(F.col("translated_text")).alias("needs"))


@query(r"""SELECT entry_id, coalesce(text IN ('Save', 'Load') OR contains(text, '[gold]') OR regexp_matches(text, '^Room \d+'), false) AS never FROM entries""")
def never_translate(spark, d):
    """F16 with rules of each kind."""
    return t(spark, d, "entries").select("entry_id", P.never_translate(F.col("text"), ["Save", "Load"], ["[gold]"], [r"^Room \d+"]).alias("never"))


@query(r"""SELECT tl_id, len(list_filter(regexp_extract_all(original_text, '\[[^\]]+\]'), lambda v: NOT contains(translated_text, v))) = 0 AS kept FROM tl_entries WHERE original_text IS NOT NULL AND translated_text IS NOT NULL""")
def placeholder_kept(spark, d):
    """F19."""
    return t(spark, d, "tl_entries").where("original_text is not null and translated_text is not null").select("tl_id", X.placeholders_kept(F.col("original_text"), F.col("translated_text")).alias("kept"))


@query("""SELECT entry_id, len(list_filter(map_keys(placeholder_map), lambda k: NOT contains(processed_text, k))) = 0 AS kept FROM entries WHERE placeholder_map IS NOT NULL AND processed_text IS NOT NULL""")
def mask_kept(spark, d):
    """every mask of the map occurs in the masked text."""
    e = t(spark, d, "entries").where("placeholder_map is not null and processed_text is not null")
    return e.select("entry_id", F.forall(F.map_keys("placeholder_map"), lambda k: F.contains("processed_text", k)).alias("kept"))


@query("SELECT entry_id, len(list_filter(coalesce(context_path, []), lambda c: starts_with(c, 'python'))) > 0 AS python, len(list_filter(coalesce(context_path, []), lambda c: starts_with(c, 'hidden_label'))) > 0 AS hidden FROM entries")
def context_flags(spark, d):
    """F21."""
    p = F.col("context_path")
    return t(spark, d, "entries").select("entry_id", P.in_context(p, "python").alias("python"), P.in_context(p, "hidden_label").alias("hidden"))


# --- scalar functions ---------------------------------------------------------------------------------------------

_TOK = r"(\{\{|\}\}|\{[^\}]+\}|\[[^\[\]]+\]|\?[A-Za-z]\d{3}\?|⟦[^⟧]+⟧)"
PROTECT = rf"""
WITH a AS (SELECT entry_id, text, regexp_extract_all(text, '{_TOK}', 1) AS tok, string_split_regex(text, '{_TOK}') AS gap FROM entries WHERE text IS NOT NULL),
     k AS (SELECT *, [ 'XRPYX' || CASE WHEN t IN ('{{{{', '}}}}') THEN 'ESC' WHEN starts_with(t, '{{') AND ends_with(t, '}}') THEN 'TAG' ELSE 'VAR' END || (i - 1) || 'XRPYX' for t, i in tok ] AS ks FROM a),
     p AS (SELECT *, array_to_string([ g || coalesce(ks[i], '') for g, i in gap ], '') AS masked FROM k)
"""


@query(PROTECT + "SELECT entry_id, masked, array_to_string(ks, ' ') AS keys FROM p")
def protect(spark, d):
    """T01."""
    x = F.col("text")
    return t(spark, d, "entries").where("text is not null").select("entry_id", X.protect(x).alias("masked"), F.array_join(X.mask_keys(x), " ").alias("keys"))


@query(PROTECT + "SELECT count(*) AS n, count_if(text = array_to_string([ g || coalesce(tok[i], '') for g, i in gap ], '')) AS same FROM p")
def restore_roundtrip(spark, d):
    """T02 after T01 gives the text again."""
    x = F.col("text")
    back = X.restore(X.protect(x), X.mask_keys(x), X.tokens(x))
    return t(spark, d, "entries").where("text is not null").agg(F.count("*").alias("n"), F.count_if(back == x).alias("same"))


def _pseudo(mode: str) -> str:
    g = "translate(g, 'aeiouAEIOUyY', 'àéîõüÀÉÎÕÜýÝ')" if mode in ("accent", "both") else "g"
    g = f"'[!!! ' || {g} || ' !!!]'" if mode in ("expand", "both") else g
    blank = r"regexp_matches(g, '\A[ \t\r\n]*\z')"
    return PROTECT + f"SELECT entry_id, array_to_string([ (CASE WHEN {blank} THEN g ELSE {g} END) || coalesce(tok[i], '') for g, i in gap ], '') AS pseudo FROM p"


for _mode in ("accent", "expand", "both"):

    def _run(spark, d, mode=_mode):
        return t(spark, d, "entries").where("text is not null").select("entry_id", X.pseudo(F.col("text"), mode).alias("pseudo"))

    QUERIES[f"pseudo_{_mode}"], SQL[f"pseudo_{_mode}"] = _run, _pseudo(_mode)


@query()
def preserve_placeholders(spark, d):
    """Four passes with one counter; SQL has no replacement of first occurrences."""
    m = X.preserve(F.col("text"))
    return t(spark, d, "entries").where("text is not null").select("entry_id", m["text"].alias("processed_text"), F.array_join(m["keys"], " ").alias("keys"), F.array_join(m["tokens"], " ").alias("tokens"))


@query(r"""SELECT tl_id, replace(replace(replace(replace(original_text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(9), '\t') AS escaped,
   replace(replace(replace(replace(original_text, '\n', chr(10)), '\t', chr(9)), '\"', '"'), '\\', '\') AS unescaped FROM tl_entries""")
def escape_tl(spark, d):
    """T06 and T11."""
    x = F.col("original_text")
    return t(spark, d, "tl_entries").select("tl_id", X.escape(x).alias("escaped"), X.unescape(x).alias("unescaped"))


@query(r"""SELECT token_id, replace(replace(replace(replace(replace(replace(replace(raw_text, '\r\n', chr(10)), '\r', chr(10)), '\n', chr(10)), '\t', chr(9)), '\"', '"'), '\''', ''''), '\\', '\') AS text FROM tokens""")
def unescape_literals(spark, d):
    """T08."""
    return t(spark, d, "tokens").select("token_id", X.unescape_literal(F.col("raw_text")).alias("text"))


@query()
def translation_id(spark, d):
    """T14 over all rows, with characters beyond ASCII and escapes resolved; unicode escapes have no SQL."""
    e = t(spark, d, "tl_entries")
    return e.select("tl_id", X.translation_id_of_literal(F.col("file_path"), F.col("line_number"), F.col("context_path"), F.col("original_text")).alias("id"))


@query("""SELECT entry_id, 'id_' || substr(sha1(coalesce(file_path, '') || ':' || line_number || ':' || coalesce(array_to_string(context_path, '|'), '') || ':' || text), 1, 16) AS id, 'strings_' || substr(md5(text), 1, 8) AS block FROM entries""")
def hash_id(spark, d):
    """T15 and T16."""
    return t(spark, d, "entries").select("entry_id", X.hash_id(F.col("file_path"), F.col("line_number"), F.col("context_path"), F.col("text")).alias("id"), X.block_id(F.col("text")).alias("block"))


@query(r"""WITH a AS (SELECT entry_id, regexp_replace(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '\A_|_\z', '', 'g') AS f FROM entries)
SELECT entry_id, substr(CASE WHEN regexp_matches(f, '\A[0-9]') THEN '_' || f WHEN f = '' THEN 'translated_text' ELSE f END, 1, 50) AS id FROM a""")
def sanitize_id(spark, d):
    """T18."""
    return t(spark, d, "entries").select("entry_id", X.sanitize_id(F.col("text")).alias("id"))


@query(f"""SELECT entry_id, '_p("\""' || chr(10) || array_to_string([ '    ' || {strip('s')} for s in string_split(text, chr(10)) ], chr(10)) || chr(10) || '"\"")' AS block FROM entries WHERE text IS NOT NULL""".replace('\\"', '"'))
def paragraph_format(spark, d):
    """T22."""
    return t(spark, d, "entries").where("text is not null").select("entry_id", X.paragraph(F.col("text")).alias("block"))


@query(f"""SELECT tl_id, {strip("regexp_replace(original_text, '[ " + chr(92) + "t" + chr(92) + "r" + chr(92) + "n" + chr(92) + "f]+', ' ', 'g')")} AS text FROM tl_entries""")
def normalized_text(spark, d):
    """T23 without the change of case."""
    return t(spark, d, "tl_entries").select("tl_id", X.normalized(F.col("original_text"), lower=False).alias("text"))


@query(LINES + r"""SELECT doc_id, line_number, length(replace(regexp_extract(line, '\A[ \t]*'), chr(9), '    ')) AS indent, NOT starts_with(""" + strip("line") + r""", '#') AND
  len(regexp_extract_all(regexp_replace(line, '\\.', '', 'g'), '"')) % 2 = 1 AS odd_quotes FROM n""")
def line_checks(spark, d):
    """T26 and T34."""
    return scan_lines(spark, d).select("doc_id", "line_number", X.indent(F.col("line")).alias("indent"), X.odd_quotes(F.col("line")).alias("odd_quotes"))


@query("""SELECT entry_id, concat_ws(' > ', 'label:' || file_path, 'char:' || character, text_type) AS context, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS preview,
   CASE WHEN context IS NULL OR context = '' THEN text ELSE text || '|' || context END AS key FROM entries""")
def context_strings(spark, d):
    """T27 and T28."""
    e = t(spark, d, "entries")
    key = F.when(F.coalesce("context", F.lit("")) == "", F.col("text")).otherwise(F.concat("text", F.lit("|"), "context"))
    return e.select("entry_id", X.context_string(F.lit(None).cast("string"), F.col("file_path"), F.col("character"), F.col("text_type")).alias("context"), X.preview(F.col("text")).alias("preview"), key.alias("key"))


@query("SELECT tl_id, coalesce(l.api, e.lang) AS api, l.native FROM tl_entries e LEFT JOIN languages l ON l.renpy = lower(e.lang)")
def language_code(spark, d):
    """The language dimension is a fixed table of a few rows."""
    e, lang = t(spark, d, "tl_entries"), t(spark, d, "languages")
    return e.join(F.broadcast(lang), F.lower(e["lang"]) == lang["renpy"], "left").select("tl_id", F.coalesce("api", "lang").alias("api"), "native")


@query(r"""SELECT entry_id, list_extract(string_split(replace(file_path, '\', '/'), '/'), -1) AS name, regexp_replace(file_path, '\Agame/', '') AS rel FROM entries""")
def path_parts(spark, d):
    """T39."""
    return t(spark, d, "entries").select("entry_id", X.base_name(F.col("file_path")).alias("name"), F.regexp_replace("file_path", r"\Agame/", "").alias("rel"))


@query(r"""SELECT tl_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(original_text, '\[[^\[\]]+\]'), lambda v: NOT list_contains(regexp_extract_all(translated_text, '\[[^\[\]]+\]'), v)))), ', ') AS lost_variables,
 array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(original_text, '\{[^{}]+\}'), lambda v: NOT list_contains(regexp_extract_all(translated_text, '\{[^{}]+\}'), v)))), ', ') AS lost_tags
 FROM tl_entries WHERE original_text IS NOT NULL AND translated_text IS NOT NULL""")
def placeholder_diff(spark, d):
    """T33 and U02."""
    o, x = F.col("original_text"), F.col("translated_text")
    e = t(spark, d, "tl_entries").where(o.isNotNull() & x.isNotNull())
    return e.select("tl_id", F.array_join(X.lost(o, x, X.VARIABLE), ", ").alias("lost_variables"), F.array_join(X.lost(o, x, X.TAG), ", ").alias("lost_tags"))


@query(r"""SELECT doc_id, array_to_string([ regexp_replace(v, '\A0+([0-9])', '\1') for v in regexp_extract_all(text, '[0-9]+') ], '.') AS version FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '\A# ')""")
def version_numbers(spark, d):
    """T30, the parts: whole texts, whole numbers of any length."""
    e = t(spark, d, "documents").where(F.col("text").rlike(r"\A# "))
    parts = F.transform(F.regexp_extract_all("text", F.lit(r"[0-9]+"), F.lit(0)), lambda v: F.regexp_replace(v, r"\A0+(?=[0-9])", ""))
    return e.select("doc_id", F.array_join(parts, ".").alias("version"))
