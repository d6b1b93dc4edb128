"""Queries of literals, contexts, data files, output files, reports and endpoints, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loclake.functions import predicates as P
from loclake.functions import text as X
from loclake.operators import extract, metrics, relational
from loclake.plans.flow_queries import _STATUS, _scripts
from loclake.plans.tables import t
from loclake.plans.text_queries import LINES, scan_lines
from loclake.sources import sinks
from loclake.sources import text as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- extraction -----------------------------------------------------------------------------------------------------


@query()
def file_literals(spark, d):
    """Literals of whole files with keys up to ten lines above."""
    return extract.literal_strings(_scripts(spark, d), "doc_id").select("doc_id", "seq", "text", "line_number", "key_name", "text_type")


@query()
def usage_contexts(spark, d):
    """Where each text is used."""
    return extract.usage_contexts(_scripts(spark, d), "doc_id").select("doc_id", "seq", "text", "line_number", "use", "character", "label", "screen", F.array_join("context_path", ">").alias("path"))


@query(LINES + r"""SELECT doc_id, line_number, CASE WHEN regexp_matches(line, '^\s*textbutton\s') THEN 'button' WHEN regexp_matches(line, '^\s*(text|label)\s+"') THEN 'ui' WHEN regexp_matches(line, '^\s*\w+\s+"') THEN 'dialogue' END AS text_type FROM n""")
def rule_table(spark, d):
    """An ordered table of line patterns, the first match wins."""
    rules = [(r"^\s*textbutton\s", "button"), (r'^\s*(text|label)\s+"', "ui"), (r'^\s*\w+\s+"', "dialogue")]
    return scan_lines(spark, d).select("doc_id", "line_number", P.first_match(F.col("line"), rules).alias("text_type"))


@query()
def deep_scan_candidates(spark, d):
    """F09."""
    e = t(spark, d, "entries")
    python = P.in_context(F.col("context_path"), "python")
    return e.select("entry_id", P.deep_scan_candidate(F.col("text"), python, F.col("context_line")).alias("candidate"))


@query(r"""WITH a AS (SELECT token_id, raw_text, regexp_replace(raw_text, '(?s)\A[rRuUbBfF]{0,2}("{3}(.*)"{3}|''{3}(.*)''{3}|"(.*)"|''(.*)'')\z', '\2\3\4\5') AS x FROM tokens)
SELECT token_id, raw_text, replace(replace(replace(replace(x, '\"', '"'), '\''', ''''), '\n', chr(10)), '\t', chr(9)) AS text FROM a""")
def raw_and_text(spark, d):
    """T07, T09, T10."""
    return t(spark, d, "tokens").select("token_id", X.raw_and_text(F.col("raw_text")).alias("p")).select("token_id", "p.raw_text", "p.text")


@query()
def canonical_texts(spark, d):
    """Texts that agree once escapes are resolved; unicode escapes have no SQL."""
    e = t(spark, d, "entries").where("text is not null").select(X.canonical(F.col("text")).alias("c"), "line_number", "context_path", "entry_id")
    return e.groupBy("c", "line_number", "context_path").agg(F.min("entry_id").alias("entry_id"), F.count("*").alias("n")).select("entry_id", "n")


@query()
def escape_kept(spark, d):
    """T12."""
    return t(spark, d, "tl_entries").select("tl_id", X.escape_kept(F.col("translated_text")).alias("escaped"))


@query(r"""SELECT tl_id, len(list_filter(regexp_extract_all(original_text, '\[[^\[\]]+\]'), lambda v: NOT list_contains(regexp_extract_all(translated_text, '\[[^\[\]]+\]'), v))) = 0 AS kept FROM tl_entries WHERE original_text IS NOT NULL AND translated_text IS NOT NULL""")
def variables_subset(spark, d):
    """Whether the original's variables are a subset of the translation's."""
    found = lambda c: F.regexp_extract_all(c, F.lit(X.VARIABLE), F.lit(0))
    e = t(spark, d, "tl_entries").where("original_text is not null and translated_text is not null")
    return e.select("tl_id", X.subset(found("original_text"), found("translated_text")).alias("kept"))


@query(r"""WITH v AS (SELECT doc_id, [ v::DECIMAL(38,0) for v in regexp_extract_all(left(file_path, 200), '[0-9]{1,30}') ] AS a, [ v::DECIMAL(38,0) for v in regexp_extract_all(left(source, 200), '[0-9]{1,30}') ] AS b FROM documents WHERE file_path IS NOT NULL AND source IS NOT NULL),
 w AS (SELECT doc_id, [ sign(coalesce(a[i], 0) - coalesce(b[i], 0))::INT for i in range(1, greatest(len(a), len(b)) + 1) ] AS s FROM v)
SELECT doc_id, coalesce(list_filter(s, lambda x: x <> 0)[1], 0) AS newer FROM w""".replace("left(file_path, 200)", "file_path").replace("left(source, 200)", "source"))
def version_compare(spark, d):
    """T30, the comparison: numbers in paths against those in sources."""
    e = t(spark, d, "documents").where("file_path is not null and source is not null")
    return e.select("doc_id", X.version_compare(F.col("file_path"), F.col("source")).alias("newer"))


# --- data files -------------------------------------------------------------------------------------------------------

_TWO = r"length(regexp_replace(regexp_replace(regexp_replace(v, '\[[^\]]+\]|\{[^}]+\}', '', 'g'), '[^\p{L}]', '', 'g'), '\s', '', 'g')) >= 2"


def _pairs(spark, d):
    return t(spark, d, "tl_entries").select("tl_id", F.coalesce("original_text", F.lit("")).alias("o"), F.coalesce("translated_text", F.lit("")).alias("x"))


@query(f"""WITH s AS (SELECT tl_id, 'a.b' AS path, original_text AS v FROM tl_entries UNION ALL SELECT tl_id, 'list[0]', coalesce(original_text, '') FROM tl_entries UNION ALL SELECT tl_id, 'list[1].c', coalesce(translated_text, '') FROM tl_entries)
SELECT tl_id, path, v AS text FROM s WHERE v IS NOT NULL AND {_TWO}""")
def json_tree(spark, d):
    """Leaves of nested JSON, one file per entry."""
    p = t(spark, d, "tl_entries").select("tl_id", "original_text", F.coalesce("original_text", F.lit("")).alias("o"), F.coalesce("translated_text", F.lit("")).alias("x"))
    body = F.concat(F.to_json(F.struct(F.struct(F.col("original_text").alias("b")).alias("a"))), F.lit("\u0001"), F.to_json(F.struct(F.array("o").alias("l"))), F.lit("\u0001"), F.to_json(F.struct("x")))
    # an object with an object and a list of a text and an object
    nested = F.concat(F.lit('{"a":'), F.regexp_extract(F.get(F.split(body, "\u0001"), F.lit(0)), r"(?s)\A\{\"a\":(.*)\}\z", 1), F.lit(',"list":['), F.regexp_extract(F.get(F.split(body, "\u0001"), F.lit(1)), r"(?s)\A\{\"l\":\[(.*)\]\}\z", 1))
    nested = F.concat(nested, F.lit(',{"c":'), F.regexp_extract(F.get(F.split(body, "\u0001"), F.lit(2)), r"(?s)\A\{\"x\":(.*)\}\z", 1), F.lit("}]}"))
    e = S.data_entries(p.select("tl_id", nested.alias("text")), "json", "tl_id")
    return e.select("tl_id", F.col("context_line").alias("path"), "text")


@query()
def csv_cells(spark, d):
    """Cells of CSV with a header, one file per entry; the dialect is guessed from a file's beginning, which has no SQL."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.regexp_replace(c, r"[\r\x00]", ""), F.lit('"'), F.lit('""')), F.lit('"'))
    body = F.concat(F.lit('"source","target"\n'), quoted(F.col("o")), F.lit(","), quoted(F.col("x")), F.lit("\n"))
    e = S.data_entries(_pairs(spark, d).select("tl_id", body.alias("text")), "csv", "tl_id")
    return e.select("tl_id", F.col("context_line").alias("path"), "text")


@query()
def keyed_files(spark, d):
    """YAML, INI and XML, one file of each per entry; keys decide, so the note is left out."""
    p = _pairs(spark, d)
    js = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r"(?s)\A\{\"v\":(.*)\}\z", 1)
    esc = lambda c: X.replace_all(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", ""), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
    flat = lambda c: F.regexp_replace(c, r"[\r\n\x00-\x1f\x85  ]+", " ")
    yaml = F.concat(F.lit("title: "), js("o"), F.lit("\npath: "), js("x"), F.lit("\n"))
    ini = F.concat(F.lit("[ui]\ntitle = "), flat(F.col("o")), F.lit("\npath = "), flat(F.col("x")), F.lit("\n"))
    xml = F.concat(F.lit("<root><title>"), esc(F.col("o")), F.lit("</title><path>"), esc(F.col("x")), F.lit("</path></root>"))
    out = None
    for kind, body in (("yaml", yaml), ("ini", ini), ("xml", xml)):
        e = S.data_entries(p.select("tl_id", body.alias("text")), kind, "tl_id").select("tl_id", F.lit(kind).alias("kind"), F.col("context_line").alias("path"), "text")
        out = e if out is None else out.unionByName(e)
    return out


# --- output -----------------------------------------------------------------------------------------------------------


@query()
def result_blocks(spark, d):
    """Blocks of result files, per target language."""
    return sinks.result_blocks(t(spark, d, "results"), ["target_lang"], "result_id").select("target_lang", "result_id", "translation_id", "block")


@query("""SELECT min(result_id) AS result_id FROM (SELECT *, regexp_replace(original_text, '\\A[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+\\z', '', 'g') AS s FROM results WHERE original_text IS NOT NULL) GROUP BY target_lang, s""".replace("\\\\", "\\"))
def organised_output(spark, d):
    """Each trimmed text once per language."""
    return sinks.organised(t(spark, d, "results").select("target_lang", "result_id", "original_text"), ["target_lang"], "result_id").select("result_id")


@query("""SELECT doc_id, replace(replace(CASE WHEN starts_with(text, chr(65279)) THEN substr(text, 2) ELSE text END, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text,
 NOT starts_with(text, chr(65279)) OR contains(text, chr(13)) AS changed FROM documents WHERE text IS NOT NULL""")
def unified_files(spark, d):
    """Files as UTF-8 with mark and LF ends, and which of them change."""
    f = t(spark, d, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return sinks.unified(f).select("doc_id", "text", "changed")


@query(r"""WITH f AS (SELECT DISTINCT text FROM entries WHERE is_deep_scan AND length(text) > 1), k AS (SELECT DISTINCT original_text AS text FROM tl_entries WHERE original_text IS NOT NULL)
SELECT text, '    old "' || replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(9), '\t') || '"' || chr(10) || '    new ""' || chr(10) AS block FROM f ANTI JOIN k USING (text)""")
def missing_strings(spark, d):
    """Texts of deep scans that no translation file has."""
    return sinks.missing_strings(t(spark, d, "entries").where("is_deep_scan"), t(spark, d, "tl_entries"))


@query(f"""WITH e AS (SELECT file_path, {_STATUS} AS status FROM entries WHERE file_path IS NOT NULL),
 c AS (SELECT file_path, grouping(file_path) AS level, '{{"extracted":' || count_if(status = 'extracted') || ',"translated":' || count_if(status = 'translated') || ',"written":' || count_if(status = 'written') || ',"skipped":' || count_if(status = 'skipped') || ',"unchanged":' || count_if(status = 'unchanged') || '}}' AS j FROM e GROUP BY ROLLUP (file_path))
SELECT '{{"project":"game","target_language":"turkish","totals":' || max(CASE WHEN level = 1 THEN j END) || ',"files":{{' || string_agg(CASE WHEN level = 0 THEN '"' || file_path || '":' || j END, ',' ORDER BY file_path) || '}}}}' AS report FROM c""")
def diagnostics_report(spark, d):
    """Totals and counts per file as one JSON text."""
    return sinks.report_json("game", "turkish", metrics.diagnostics(t(spark, d, "entries").select("file_path", F.expr(_STATUS).alias("status"))))


@query("""WITH f AS (SELECT *, CASE WHEN similarity > 1 THEN similarity / 100 ELSE similarity END AS s FROM fuzzy_matches WHERE old_id IS NOT NULL AND similarity IS NOT NULL)
SELECT match_id, '{"new_id":' || to_json(new_id) || ',"new_original":' || to_json(new_original) || CASE WHEN old_translation IS NULL THEN '' ELSE ',"suggested":' || to_json(old_translation) END || ',"similarity":' || floor(s * 100)::INT || ',"auto_applied":' || (s >= 0.9) || '}' AS suggestion FROM f""")
def suggestions_json(spark, d):
    """Matches as JSON with all five fields; the numbers come from the table."""
    f = t(spark, d, "fuzzy_matches").where("old_id is not null and similarity is not null")
    f = f.withColumn("similarity", F.when(F.col("similarity") > 1, F.col("similarity") / 100).otherwise(F.col("similarity")))
    return f.select("match_id", sinks.suggestion_json().alias("suggestion"))


# --- counts and endpoints ---------------------------------------------------------------------------------------------


@query("SELECT file_path, count_if(NOT coalesce(is_deep_scan, false)) AS normal, count_if(is_deep_scan) AS deep, count(*) AS total FROM entries GROUP BY file_path")
def scan_totals(spark, d):
    """Rows of the statement passes and of deep scans."""
    deep = F.coalesce("is_deep_scan", F.lit(False))
    return t(spark, d, "entries").groupBy("file_path").agg(F.count_if(~deep).alias("normal"), F.count_if(deep).alias("deep"), F.count("*").alias("total"))


@query("""WITH k AS (SELECT target_lang, result_id, 'failed' AS kind, 10 AS most FROM results WHERE NOT success UNION ALL SELECT target_lang, result_id, 'unchanged', 5 FROM results WHERE success AND translated_text = original_text)
SELECT target_lang, kind, count(*) AS n, array_to_string(list_sort(list(result_id))[1:max(most)], ',') AS ids FROM k GROUP BY 1, 2""")
def failure_samples(spark, d):
    """Failed and unchanged answers with the first ten and five of them."""
    kinds = {"failed": (~F.col("success"), 10), "unchanged": (F.col("success") & (F.col("translated_text") == F.col("original_text")), 5)}
    s = metrics.samples(t(spark, d, "results"), ["target_lang"], kinds, "result_id")
    return s.select("target_lang", "kind", "n", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


_ENDPOINTS = """WITH e AS (SELECT lower(engine) AS engine, target_lang, count_if(coalesce(success, false)) AS s, count_if(NOT coalesce(success, false)) AS f, avg(round(confidence * 10000)::BIGINT) AS r FROM results WHERE engine IS NOT NULL GROUP BY 1, 2),
 p AS (SELECT *, s / (s + f) AS rate, NOT (f > 10 AND s / (s + f) < 0.3) AS w FROM e) """


def _endpoints(spark, d):
    r = t(spark, d, "results").where("engine is not null").withColumn("engine", F.lower("engine"))
    return metrics.endpoints(r, ["engine", "target_lang"], F.coalesce("success", F.lit(False)), F.round(F.col("confidence") * 10000).cast("long"))


@query(_ENDPOINTS + "SELECT count(*) AS total, count_if(w) AS working, round(avg(r), 4) AS mean_response, round(avg(rate), 6) AS mean_success FROM p")
def endpoint_stats(spark, d):
    """Engines by language as endpoints."""
    s = metrics.endpoint_stats(_endpoints(spark, d))
    return s.select("total", "working", F.round("mean_response", 4).alias("mean_response"), F.round("mean_success", 6).alias("mean_success"))


@query(_ENDPOINTS + ", u AS (SELECT *, w AND rate > 0.5 AS ok FROM p) SELECT engine, target_lang, row_number() OVER (ORDER BY rate DESC, r, engine, target_lang) - 1 AS place FROM u WHERE ok OR NOT (SELECT bool_or(ok) FROM u)")
def endpoint_order(spark, d):
    """Usable endpoints (all, where none is), the best and quickest first."""
    e = _endpoints(spark, d).withColumn("ok", P.usable(F.col("is_working"), F.col("success_rate")))
    any_ = e.agg(F.coalesce(F.bool_or("ok"), F.lit(False)).alias("any"))
    e = e.withColumn("_k", F.lit(1)).join(any_.withColumn("_k", F.lit(1)), "_k").where("ok or not any").withColumn("_r", -F.col("success_rate"))
    return relational.numbered(e.select("engine", "target_lang", "_r", "response_time"), [], ["_r", "response_time", "engine", "target_lang"], "place").select("engine", "target_lang", "place")
