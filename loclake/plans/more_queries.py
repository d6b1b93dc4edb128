"""Further queries with their SQL: line classes, quality flags, unions with precedence, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loclake.functions import more as M
from loclake.functions import predicates as P
from loclake.functions import text as X
from loclake.operators.relational import keep_first
from loclake.plans.tables import t
from loclake.plans.text_queries import LINES, scan_lines, strip

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query(LINES + f"""SELECT doc_id, line_number, CASE WHEN regexp_matches(line, {q(M.MENU_LINE)}) THEN 'menu' WHEN regexp_matches(line, {q(M.SCREEN_LINE)}) THEN 'screen' WHEN regexp_matches(line, {q(M.CHARACTER_LINE)}) THEN 'character'
 WHEN regexp_matches(line, {q(M.TECHNICAL_LINE)}) OR regexp_matches(line, {q(M.VALUE_LINE)}) THEN 'technical' ELSE 'general' END AS class FROM n""")
def line_class(spark, d):
    """F11."""
    return scan_lines(spark, d).select("doc_id", "line_number", M.line_class(F.col("line")).alias("class"))


_TECH = f"coalesce(regexp_matches(text, {q(M.TECHNICAL_LINE)}) OR regexp_matches(text, {q(M.VALUE_LINE)}), false)"


@query(rf"""SELECT entry_id, coalesce(length({strip('text')}) > 2, false) AND NOT {_TECH} AS is_meaningful, NOT coalesce(regexp_matches(substr(text, 1, 1), '\p{{Lu}}') AND regexp_matches(text, '[.!?]'), false) AS has_grammar_error, NOT {_TECH} AS is_technically_valid FROM entries""")
def quality_check(spark, d):
    """F12."""
    return t(spark, d, "entries").select("entry_id", M.quality(F.col("text")).alias("r")).select("entry_id", "r.*")


@query(rf"""WITH a AS (SELECT entry_id, {strip("coalesce(text, '')")} AS s, lower(coalesce(context, '')) AS c FROM entries)
SELECT entry_id, length(s) < 2 OR regexp_matches(lower(s), '\.({"|".join(M.COMPILED_TYPES)})\z') OR regexp_matches(s, '\A(images|audio|gui|fonts)/') OR regexp_matches(s, '{P.HEX}') OR regexp_matches(s, '{P.NUMBER}')
 OR regexp_matches(s, '{P.SNAKE}') OR NOT regexp_matches(s, '[a-zA-ZÀ-ɏЀ-ӿ]') OR (regexp_matches(c, '\A(rpyc_val:|variable:|data:)') AND NOT regexp_matches(c, '{"|".join(P.KEYS_IN)}')) AS technical FROM a""")
def compiled_technical(spark, d):
    """F07."""
    return t(spark, d, "entries").select("entry_id", M.technical_in_compiled(F.col("text"), F.col("context")).alias("technical"))


@query(r"""SELECT doc_id, regexp_replace(text, '[ \t]*\\[ \t]*\r?\n[ \t]*', ' ', 'g') AS text FROM documents""")
def logical_lines(spark, d):
    """P24."""
    return t(spark, d, "documents").select("doc_id", M.logical_lines(F.col("text")).alias("text"))


@query()
def paragraph_normal(spark, d):
    """P06."""
    return t(spark, d, "entries").where("text is not null").select("entry_id", M.paragraphs(F.col("text")).alias("text"))


@query("""WITH s AS (SELECT file_path, text, 0 AS pass_no, entry_id AS id FROM entries WHERE text IS NOT NULL AND NOT coalesce(is_deep_scan, false) UNION ALL SELECT file_path, text, 1, entry_id FROM entries WHERE text IS NOT NULL AND coalesce(is_deep_scan, false)
 UNION ALL SELECT file_path, text, 2, token_id FROM tokens WHERE text IS NOT NULL)
SELECT file_path, text, (min(struct_pack(p := pass_no, i := id))).p AS pass_no, (min(struct_pack(p := pass_no, i := id))).i AS id FROM s GROUP BY file_path, text""")
def union_text_precedence(spark, d):
    """Base rows, then deep scan, then tokens, each text once per file."""
    e, k = t(spark, d, "entries").where("text is not null"), t(spark, d, "tokens").where("text is not null")
    deep = F.coalesce("is_deep_scan", F.lit(False))
    rows = e.select("file_path", "text", F.when(deep, 1).otherwise(0).alias("pass_no"), F.col("entry_id").alias("id"))
    rows = rows.unionByName(k.select("file_path", "text", F.lit(2).alias("pass_no"), F.col("token_id").alias("id")))
    return keep_first(rows, ["file_path", "text"], ["pass_no", "id"], ["pass_no", "id"])


@query("""WITH s AS (SELECT DISTINCT text FROM entries WHERE NOT coalesce(is_rpyc, false) AND text IS NOT NULL), c AS (SELECT min(entry_id) AS entry_id, text FROM entries WHERE is_rpyc AND text IS NOT NULL GROUP BY text)
SELECT 'script' AS origin, entry_id FROM entries WHERE NOT coalesce(is_rpyc, false) UNION ALL SELECT 'compiled', entry_id FROM c ANTI JOIN s USING (text)""")
def combined_extraction(spark, d):
    """Compiled rows only where no script row has the text."""
    e = t(spark, d, "entries").select("entry_id", "text", F.coalesce("is_rpyc", F.lit(False)).alias("c"))
    script, compiled = e.where("not c"), e.where("c and text is not null")
    new = keep_first(compiled.select("text", "entry_id").join(script.select("text").where("text is not null").distinct(), "text", "left_anti"), ["text"], ["entry_id"])
    return script.select(F.lit("script").alias("origin"), "entry_id").unionByName(new.select(F.lit("compiled").alias("origin"), "entry_id"))


@query("""SELECT entry_id, coalesce(is_engine_common, false) OR starts_with(coalesce(file_path, ''), 'renpy/common') AS engine_common, CASE WHEN coalesce(is_engine_common, false) THEN 'ui' ELSE lower(text_type) END AS text_type FROM entries""")
def replace_common(spark, d):
    """Engine-common rows, with their type set to ui."""
    common = F.coalesce("is_engine_common", F.lit(False))
    return t(spark, d, "entries").select(
        "entry_id", (common | F.coalesce(F.col("file_path").startswith("renpy/common"), F.lit(False))).alias("engine_common"), F.when(common, "ui").otherwise(F.lower("text_type")).alias("text_type")
    )


@query(LINES + r"""SELECT doc_id, line_number, coalesce(last_value(CASE WHEN regexp_matches(line, '\A\s*(init\s+)?python\b.*:') THEN true WHEN regexp_matches(line, '\A\S') THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_number), false)
 OR regexp_matches(line, '\A\s*\$') AS in_python FROM n""")
def in_python(spark, d):
    """Whether a line is Python, by the last block that began before it."""
    w = Window.partitionBy("doc_id").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("line").rlike(r"\A\s*(init\s+)?python\b.*:"), True).when(F.col("line").rlike(r"\A\S"), False)
    inside = F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False)) | F.col("line").rlike(r"\A\s*\$")
    return scan_lines(spark, d).select("doc_id", "line_number", inside.alias("in_python"))


@query("""SELECT file_path, count(*) AS n_strings, round((count(*) * 0.0001 + 1 * 0.01)::DOUBLE, 3) AS seconds, CASE WHEN count(*) < 1000 THEN 'not needed' WHEN count(*) < 5000 THEN 'optional' WHEN count(*) < 10000 THEN 'advised' ELSE 'strongly advised' END AS deferred,
 CASE WHEN count(DISTINCT lang) >= 50 THEN 32 WHEN count(DISTINCT lang) >= 20 THEN 16 WHEN count(DISTINCT lang) >= 10 THEN 8 WHEN count(DISTINCT lang) >= 5 THEN 4 WHEN count(DISTINCT lang) > 0 THEN 2 ELSE 16 END AS concurrency FROM tl_entries GROUP BY file_path""")
def load_estimate(spark, d):
    """T31, F25, A14."""
    g = t(spark, d, "tl_entries").groupBy("file_path").agg(F.count("*").alias("n_strings"), F.countDistinct("lang").alias("k"))
    n = F.col("n_strings")
    return g.select("file_path", "n_strings", M.load_estimate(n, F.lit(1)).alias("seconds"), M.deferred_loading(n).alias("deferred"), M.concurrency(F.col("k")).alias("concurrency"))


@query()
def restore_tolerant(spark, d):
    """Masks with changed brackets and blanks restored; T03 gives the masks."""
    m = X.preserve(F.col("text"))
    e = t(spark, d, "entries").where("text is not null").select("entry_id", "text", m.alias("m"))
    bent = F.regexp_replace(F.col("m.text"), "⟦([A-Z]+)", "⟦ $1 ")
    return e.select("entry_id", (M.restore_tolerant(bent, F.col("m.keys"), F.col("m.tokens")) == F.col("text")).alias("same"))


@query(r"""SELECT tl_id, '    old "' || replace(replace(replace(original_text, '\', '\\'), '"', '\"'), chr(10), '\n') || '"' || chr(10) || '    new "' || replace(replace(replace(coalesce(translated_text, ''), '\', '\\'), '"', '\"'), chr(10), '\n') || '"' || chr(10) AS block,
 '# Translations: ' || lang || chr(10) || '# Written: ' || strftime(updated_at, '%Y-%m-%d %H:%M:%S') || chr(10) AS header FROM tl_entries""")
def output_blocks(spark, d):
    """K04 to K06, T13, T40."""
    return t(spark, d, "tl_entries").select("tl_id", M.old_new_block(F.col("original_text"), F.col("translated_text")).alias("block"), M.file_header(F.col("lang"), F.col("updated_at")).alias("header"))


@query("""SELECT file_path, '{"total":' || count(*) || ',"deep":' || count_if(is_deep_scan) || ',"compiled":' || count_if(is_rpyc) || '}' AS report FROM entries WHERE file_path IS NOT NULL GROUP BY file_path""")
def diagnostics_json(spark, d):
    """Per-file counts as JSON."""
    e = t(spark, d, "entries").where("file_path is not null").groupBy("file_path").agg(F.count("*").alias("total"), F.count_if("is_deep_scan").alias("deep"), F.count_if("is_rpyc").alias("compiled"))
    return e.select("file_path", F.to_json(F.struct("total", "deep", "compiled")).alias("report"))


@query("""SELECT match_id, '{"new_id":"' || new_id || '","similarity":' || floor(CASE WHEN similarity > 1 THEN similarity ELSE 100 * similarity END)::INT || ',"auto_applied":' || (CASE WHEN similarity > 1 THEN similarity ELSE 100 * similarity END >= 90) || '}' AS suggestion
 FROM fuzzy_matches WHERE old_id IS NOT NULL AND similarity IS NOT NULL""")
def fuzzy_suggestions(spark, d):
    """K09, T25, F24."""
    pc = F.when(F.col("similarity") > 1, F.col("similarity")).otherwise(100 * F.col("similarity"))
    f = t(spark, d, "fuzzy_matches").where("old_id is not null and similarity is not null")
    return f.select("match_id", F.to_json(F.struct("new_id", F.floor(pc).cast("int").alias("similarity"), (pc >= 90).alias("auto_applied"))).alias("suggestion"))


@query("""SELECT lang, '{' || string_agg('"' || src || '":""', ',' ORDER BY src) || '}' AS terms FROM glossary GROUP BY lang""")
def glossary_json(spark, d):
    """K10."""
    g = t(spark, d, "glossary").groupBy("lang").agg(F.array_sort(F.collect_set("src")).alias("s"))
    return g.select("lang", F.to_json(F.map_from_arrays("s", F.transform("s", lambda _: F.lit("")))).alias("terms"))


@query("SELECT bool_or(ends_with(file_path, '.rpy')) AS scripts, bool_or(ends_with(file_path, '.rpyc')) AS compiled, bool_or(ends_with(file_path, '.rpa')) AS archives, count_if(regexp_matches(lower(file_path), '(\\A|/)tl/turkish/')) AS in_language FROM documents".replace("\\\\", "\\"))
def file_flags(spark, d):
    """F22, F23."""
    p = F.col("file_path")
    return t(spark, d, "documents").agg(
        F.bool_or(p.endswith(".rpy")).alias("scripts"), F.bool_or(p.endswith(".rpyc")).alias("compiled"), F.bool_or(p.endswith(".rpa")).alias("archives"), F.count_if(P.in_language_folder(p, "turkish")).alias("in_language")
    )
