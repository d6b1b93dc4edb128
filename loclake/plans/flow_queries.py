"""Queries of joins, windows, aggregates, extraction and whole flows, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loclake.functions import predicates as P
from loclake.functions import text as X
from loclake.operators import extract, fuzzy, glossary, health, metrics, relational, tl, translate
from loclake.plans.tables import t
from loclake.plans.text_queries import FALSE_POSITIVE, LINES, PROTECT, SKIP, _pseudo, letters, scan_lines, strip, unmask
from loclake.sources import sinks
from loclake.streaming import metrics as stream

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- joins --------------------------------------------------------------------------------------------------------


@query("""WITH k AS (SELECT DISTINCT original_text AS text FROM tl_entries WHERE original_text IS NOT NULL),
 n AS (SELECT text, min(entry_id) AS entry_id FROM entries WHERE text IS NOT NULL GROUP BY text) SELECT n.text, entry_id FROM n ANTI JOIN k USING (text)""")
def anti_new_texts(spark, d):
    """Texts that no translation file has, each once."""
    new = t(spark, d, "entries").where("text is not null").select("entry_id", "text")
    known = t(spark, d, "tl_entries").select(F.col("original_text").alias("text"))
    return relational.missing_texts(new, known, "text", ["entry_id"]).select("text", "entry_id")


@query("""WITH r AS (SELECT translation_id, original_text, translated_text AS tr, result_id FROM results WHERE success AND translated_text IS NOT NULL),
 i AS (SELECT translation_id, min_by(tr, result_id) AS tr FROM r WHERE translation_id IS NOT NULL GROUP BY 1), x AS (SELECT original_text, min_by(tr, result_id) AS tr FROM r WHERE original_text IS NOT NULL GROUP BY 1)
SELECT tl_id, coalesce(nullif(i.tr, ''), nullif(x.tr, ''), e.translated_text) AS translated_text FROM tl_entries e LEFT JOIN i USING (translation_id) LEFT JOIN x USING (original_text)""")
def attach_translations(spark, d):
    """J03 and J04."""
    r = t(spark, d, "results").where("success and translated_text is not null")
    first = lambda k: r.where(F.col(k).isNotNull()).groupBy(k).agg(F.min_by("translated_text", "result_id").alias("translation"))
    e = t(spark, d, "tl_entries").select("tl_id", "translation_id", "original_text", "translated_text")
    return relational.attach_translations(e, first("translation_id"), first("original_text")).select("tl_id", "translated_text")


@query("""WITH c AS (SELECT text, min_by(context, entry_id) AS context FROM entries WHERE text IS NOT NULL AND context <> '' GROUP BY text) SELECT token_id, c.context FROM tokens LEFT JOIN c USING (text)""")
def context_enrich(spark, d):
    """The first context of each text."""
    c = t(spark, d, "entries").where("text is not null and context <> ''").select("text", "context", F.col("entry_id").alias("seq"))
    return t(spark, d, "tokens").select("token_id", "text").join(relational.first_context(c).drop("seq"), "text", "left").select("token_id", "context")


@query("""WITH n AS (SELECT new_id, lower(new_original) AS k, row_number() OVER (PARTITION BY lower(new_original) ORDER BY new_id) AS rn FROM (SELECT new_id, min(new_original) AS new_original FROM fuzzy_matches GROUP BY 1)),
 o AS (SELECT old_id, lower(old_original) AS k, row_number() OVER (PARTITION BY lower(old_original) ORDER BY old_id) AS rn FROM (SELECT old_id, min(old_original) AS old_original FROM fuzzy_matches WHERE old_id IS NOT NULL GROUP BY 1))
SELECT new_id, old_id FROM n JOIN o USING (k, rn)""")
def fuzzy_exact(spark, d):
    """Equal texts pair up one to one."""
    f = t(spark, d, "fuzzy_matches")
    n = f.groupBy("new_id").agg(F.lower(F.min("new_original")).alias("k"))
    o = f.where("old_id is not null").groupBy("old_id").agg(F.lower(F.min("old_original")).alias("k"))
    return relational.pair_up(n, o, "k", "new_id", "old_id").select("new_id", "old_id")


@query("""SELECT match_id, round(2.0 * least(length(new_original), length(old_original)) / (length(new_original) + length(old_original)), 6) AS bound FROM fuzzy_matches WHERE old_original IS NOT NULL""")
def fuzzy_bounds(spark, d):
    """The length bound of J07."""
    return t(spark, d, "fuzzy_matches").where("old_original is not null").select("match_id", F.round(fuzzy.length_bound(F.col("new_original"), F.col("old_original")), 6).alias("bound"))


def _sides(spark, d):
    f = t(spark, d, "fuzzy_matches")
    new = f.where("new_original is not null").groupBy("new_id").agg(F.min("new_original").alias("new_original"))
    old = f.where("old_original is not null").groupBy("old_id").agg(F.min("old_original").alias("old_original"), F.min("old_translation").alias("old_translation"))
    return new, old


@query()
def fuzzy_match(spark, d):
    """Best old text of each new one; difflib's ratio has no SQL."""
    m = fuzzy.match(*_sides(spark, d))
    return m.select("new_id", "old_id", F.round("similarity", 6).alias("similarity"), fuzzy.percent(F.col("similarity")).alias("percent"), "auto_apply")


@query()
def fuzzy_report(spark, d):
    """A10, J09."""
    new, old = _sides(spark, d)
    return fuzzy.report(fuzzy.match(new, old), new, old)


@query("""SELECT match_id, row_number() OVER (ORDER BY CASE WHEN similarity > 1 THEN similarity / 100 ELSE similarity END DESC, match_id) AS place FROM fuzzy_matches WHERE similarity IS NOT NULL""")
def match_order(spark, d):
    """Matches by similarity, the most similar first, with their place in that order."""
    m = t(spark, d, "fuzzy_matches").where("similarity is not null").select("match_id", F.when(F.col("similarity") > 1, F.col("similarity") / 100).otherwise(F.col("similarity")).alias("s"))
    return relational.numbered(m.withColumn("_d", -F.col("s")), [], ["_d", "match_id"], "place").select("match_id", F.col("place") + 1).toDF("match_id", "place")


@query()
def tm_lookup(spark, d):
    """Equal texts, else the most similar at 0.8 or more; difflib's ratio has no SQL."""
    e = t(spark, d, "tl_entries").select("tl_id", "lang", F.col("original_text").alias("original"))
    memory = t(spark, d, "tl_entries").select("lang", F.col("tl_id").alias("entry_id"), F.col("original_text").alias("original"), F.col("translated_text").alias("translation"))
    return fuzzy.memory_lookup(e, memory.where("original is not null and lang is not null")).select("tl_id", "translation", F.round("confidence", 6).alias("confidence"), "source")


@query("""WITH m AS (SELECT lang, original_text, min_by(translated_text, tl_id) AS translation FROM tl_entries WHERE translated_text IS NOT NULL AND original_text IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2)
SELECT e.tl_id, m.translation FROM tl_entries e LEFT JOIN m USING (lang, original_text)""")
def tm_exact(spark, d):
    """J08, the exact stage alone."""
    e = t(spark, d, "tl_entries")
    known = e.where("translated_text is not null and original_text is not null and lang is not null").groupBy("lang", "original_text").agg(F.min_by("translated_text", "tl_id").alias("translation"))
    return e.select("tl_id", "lang", "original_text").join(known, ["lang", "original_text"], "left").select("tl_id", "translation")


@query("""WITH u AS (SELECT original_text, target_lang, min_by(translated_text, result_id) AS tr FROM results WHERE success AND original_text IS NOT NULL AND translated_text IS NOT NULL GROUP BY 1, 2)
SELECT r.result_id, u.tr AS translated_text FROM results r LEFT JOIN u USING (original_text, target_lang)""")
def dedup_fanout(spark, d):
    """One translation per distinct text, joined back to each request."""
    r = t(spark, d, "results")
    u = r.where("success and original_text is not null and translated_text is not null").groupBy("original_text", "target_lang").agg(F.min_by("translated_text", "result_id").alias("tr"))
    back = relational.fan_out(r.select("result_id", "original_text", "target_lang"), u, ["original_text", "target_lang"])
    return back.select("result_id", F.col("tr").alias("translated_text"))


@query(r"""WITH g AS (SELECT src, min(dst) AS dst FROM glossary WHERE lang = 'tr' GROUP BY src)
SELECT entry_id, g.src AS term, g.dst AS target FROM entries, g WHERE regexp_matches(entries.text, '(?i)(^|[^\p{L}\p{N}_])' || regexp_escape(g.src) || '($|[^\p{L}\p{N}_])')""")
def glossary_hits(spark, d):
    """J12 and O01."""
    g = t(spark, d, "glossary").where("lang = 'tr'")
    return glossary.hits(t(spark, d, "entries").where("text is not null"), "text", g, ("entry_id",))


@query()
def glossary_apply(spark, d):
    """Protection before and application after translation; case transfer has no SQL."""
    g = glossary.terms(t(spark, d, "glossary"), "tr")
    e = t(spark, d, "tl_entries").where("lang = 'turkish' and original_text is not null")
    masked = glossary.protect(F.col("original_text"), g)
    return e.select("tl_id", masked["text"].alias("masked"), glossary.apply(F.coalesce("translated_text", "original_text"), F.col("original_text"), g).alias("applied"))


@query("""WITH c AS (SELECT DISTINCT engine, source_lang, target_lang, original_text AS text FROM results WHERE success), q AS (SELECT DISTINCT engine, source_lang, target_lang, original_text AS text FROM results WHERE NOT success)
SELECT q.* FROM q WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.engine = q.engine AND c.source_lang = q.source_lang AND c.target_lang = q.target_lang AND c.text = q.text)""")
def cache_misses(spark, d):
    """Failed requests that no earlier answer covers."""
    r = t(spark, d, "results").withColumnRenamed("original_text", "text")
    return translate.misses(r.where("not success"), r.where("success"))


@query("""WITH e AS (SELECT e.lang, c.ch FROM languages l JOIN tl_entries e ON e.lang = l.renpy, unnest(list_distinct(regexp_extract_all(e.translated_text, '[^\\x00-\\x7F]'))) AS c(ch) WHERE e.translated_text IS NOT NULL)
SELECT lang, count(DISTINCT ch) AS needed, count(DISTINCT CASE WHEN unicode(ch) < 592 THEN ch END) AS covered, round(100.0 * count(DISTINCT CASE WHEN unicode(ch) < 592 THEN ch END) / count(DISTINCT ch), 2) AS coverage,
 100.0 * count(DISTINCT CASE WHEN unicode(ch) < 592 THEN ch END) / count(DISTINCT ch) >= 90 AS supported FROM e GROUP BY lang""".replace("\\\\", "\\"))
def font_coverage(spark, d):
    """Characters each language needs against those of a font (here: Latin up to U+024F)."""
    e = t(spark, d, "tl_entries").where("translated_text is not null")
    lang = t(spark, d, "languages").select(F.col("renpy").alias("lang"))
    ch = e.join(F.broadcast(lang), "lang").select("lang", F.explode(F.array_distinct(F.regexp_extract_all("translated_text", F.lit(r"[^\x00-\x7F]"), F.lit(0)))).alias("ch")).distinct()
    covered = F.count_if(F.conv(F.hex(F.encode("ch", "UTF-32")), 16, 10).cast("long") < 592)
    return ch.groupBy("lang").agg(
        F.count("*").alias("needed"), covered.alias("covered"), F.round(100.0 * covered / F.count("*"), 2).alias("coverage"), (100.0 * covered / F.count("*") >= 90).alias("supported")
    )


# --- windows, keep-first, packing ------------------------------------------------------------------------------------


@query("SELECT text, file_path, min(entry_id) AS entry_id FROM entries WHERE text IS NOT NULL GROUP BY text, file_path")
def dedup_keep_first(spark, d):
    """W01, W03, W04."""
    return relational.keep_first(t(spark, d, "entries").where("text is not null").select("text", "file_path", "entry_id"), ["text", "file_path"], ["entry_id"])


@query("""WITH RECURSIVE f AS (SELECT text, entry_id, coalesce(is_engine_common, false) AS c, coalesce(is_deep_scan, false) AS dp, row_number() OVER (PARTITION BY text ORDER BY entry_id) AS rn FROM entries WHERE text IS NOT NULL),
 r AS (SELECT text, rn, entry_id, c, dp FROM f WHERE rn = 1 UNION ALL
  SELECT f.text, f.rn, CASE WHEN (NOT r.c AND f.c) OR (NOT r.dp AND f.dp) THEN f.entry_id ELSE r.entry_id END, CASE WHEN (NOT r.c AND f.c) OR (NOT r.dp AND f.dp) THEN f.c ELSE r.c END, CASE WHEN (NOT r.c AND f.c) OR (NOT r.dp AND f.dp) THEN f.dp ELSE r.dp END
  FROM r JOIN f ON f.text = r.text AND f.rn = r.rn + 1)
SELECT text, max_by(entry_id, rn) AS entry_id FROM r GROUP BY text""")
def dedup_preference(spark, d):
    """One row per text, engine-common and deep-scan rows preferred in order."""
    e = t(spark, d, "entries").where("text is not null").select("text", "entry_id", "is_engine_common", "is_deep_scan")
    return relational.prefer(e, "text", "entry_id").select("text", "entry_id")


@query(LINES + "SELECT doc_id, line_number, last_value(CASE WHEN regexp_matches(line, '\\A\\s*(screen|style)\\s') THEN 1 WHEN regexp_matches(line, '\\A\\s*label\\s.*:') THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS in_ui FROM n")
def lookback_context(spark, d):
    """W07 and F18."""
    flag = F.when(F.col("line").rlike(r"\A\s*(screen|style)\s"), 1).when(F.col("line").rlike(r"\A\s*label\s.*:"), 0)
    return relational.look_back(scan_lines(spark, d), "doc_id", "line_number", flag, 50, "in_ui").select("doc_id", "line_number", "in_ui")


@query("""WITH RECURSIVE u AS (SELECT engine, target_lang, min(result_id) AS result_id, original_text FROM results WHERE original_text IS NOT NULL AND engine IS NOT NULL GROUP BY engine, target_lang, original_text),
 n AS (SELECT *, length(original_text) AS n, row_number() OVER (PARTITION BY engine, target_lang ORDER BY result_id) AS rn FROM u),
 p AS (SELECT engine, target_lang, rn, result_id, n, 0 AS no, n AS chars, 1 AS texts FROM n WHERE rn = 1 UNION ALL
  SELECT n.engine, n.target_lang, n.rn, n.result_id, n.n, p.no + (p.chars + n.n > 3000 OR p.texts >= 25)::INT, CASE WHEN p.chars + n.n > 3000 OR p.texts >= 25 THEN n.n ELSE p.chars + n.n END, CASE WHEN p.chars + n.n > 3000 OR p.texts >= 25 THEN 1 ELSE p.texts + 1 END
  FROM p JOIN n ON n.engine = p.engine AND n.target_lang = p.target_lang AND n.rn = p.rn + 1)
SELECT result_id, n AS n_chars, no AS slice_no FROM p""")
def slice_packing(spark, d):
    """Slices of unique texts by engine and language."""
    r = t(spark, d, "results").where("original_text is not null and engine is not null")
    u = r.groupBy("engine", "target_lang", "original_text").agg(F.min("result_id").alias("result_id")).withColumn("n", F.length("original_text"))
    return relational.pack_slices(u, ["engine", "target_lang"], "result_id", "n").select("result_id", "n_chars", "slice_no")


@query("""SELECT result_id, ((row_number() OVER (PARTITION BY target_lang ORDER BY result_id) - 1) // 200)::INT AS batch_no, ((row_number() OVER (PARTITION BY target_lang ORDER BY result_id) - 1) % 3)::INT AS slot FROM results""")
def batch_and_slot(spark, d):
    """W09 and W11."""
    r = t(spark, d, "results").select("result_id", "target_lang")
    both = relational.round_robin(relational.batches(r, ["target_lang"], "result_id", 200), "target_lang", "result_id", 3)
    return both.select("result_id", "batch_no", "slot")


@query("""SELECT result_id, avg(round(confidence * 10000)::BIGINT) OVER w AS mean_duration, avg(CASE WHEN success THEN 0 ELSE 1 END) OVER w AS failure_rate, count(*) OVER w AS n_events FROM results WHERE engine IS NOT NULL
WINDOW w AS (PARTITION BY engine ORDER BY result_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW)""")
def rolling_metrics(spark, d):
    """W06."""
    r = t(spark, d, "results").where("engine is not null").select("result_id", "engine", F.round(F.col("confidence") * 10000).cast("long").alias("c"), "success")
    return metrics.rolling(r, "engine", "result_id", "c", F.coalesce("success", F.lit(False))).select("result_id", "mean_duration", "failure_rate", "n_events")


@query("""WITH s AS (SELECT event_type, event_id, avg(value / 100) OVER w AS m, avg(CASE WHEN value > 10 THEN 0.0 ELSE 1.0 END) OVER w AS f, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN n < 20 THEN 'hold' WHEN f > 0.2 OR m > 1.5 THEN 'down' WHEN f < 0.05 AND m < 0.5 THEN 'up' ELSE 'hold' END AS signal FROM s""")
def adaptive_signal(spark, d):
    """A12, the rule."""
    e = t(spark, d, "events").select("event_id", "event_type", (F.col("value") / 100).alias("dur"), (F.col("value") > 10).alias("ok"))
    r = metrics.rolling(e, "event_type", "event_id", "dur", F.col("ok"))
    return r.select("event_id", metrics.adaptive_signal(F.col("mean_duration"), F.col("failure_rate"), F.col("n_events")).alias("signal"))


@query()
def adaptive_limits(spark, d):
    """A12, the recurrence, over the signal of each day."""
    e = t(spark, d, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("v"))
    s = e.select("event_type", F.unix_date(F.to_date("day")).alias("no"), F.when(F.col("v") > 52, "down").when(F.col("v") < 48, "up").otherwise("hold").alias("signal"))
    return metrics.adaptive_limits(s, "event_type", "no")


# --- aggregates ------------------------------------------------------------------------------------------------------


@query("""SELECT lang, count(*) AS total, count_if(coalesce(translated_text, '') <> '') AS translated, count_if(coalesce(translated_text, '') = '') AS untranslated,
 round(100.0 * count_if(coalesce(translated_text, '') <> '') / count(*), 2) AS progress FROM tl_entries GROUP BY lang""")
def translation_stats(spark, d):
    """A01."""
    return metrics.translation_stats(t(spark, d, "tl_entries"), ["lang"], F.coalesce("translated_text", F.lit("")) != "")


_STATUS = "CASE WHEN text IS NULL THEN 'skipped' WHEN is_deep_scan THEN 'written' WHEN pass_no > 1 THEN 'translated' WHEN translation_id IS NULL THEN 'unchanged' ELSE 'extracted' END"


@query(f"""WITH e AS (SELECT file_path, {_STATUS} AS status FROM entries WHERE file_path IS NOT NULL)
SELECT file_path, count_if(status = 'extracted') AS extracted, count_if(status = 'translated') AS translated, count_if(status = 'written') AS written, count_if(status = 'skipped') AS skipped, count_if(status = 'unchanged') AS unchanged,
 grouping(file_path)::INT AS level FROM e GROUP BY ROLLUP (file_path)""")
def diag_rollup(spark, d):
    """A02."""
    e = t(spark, d, "entries").select("file_path", F.expr(_STATUS).alias("status"))
    return metrics.diagnostics(e)


_ISSUES = r"""WITH p AS (SELECT tl_id, file_path, list_distinct(list_filter(regexp_extract_all(original_text, '\[[^\[\]]+\]'), lambda v: NOT list_contains(regexp_extract_all(translated_text, '\[[^\[\]]+\]'), v))) AS lv,
 list_distinct(list_filter(regexp_extract_all(translated_text, '\[[^\[\]]+\]'), lambda v: NOT list_contains(regexp_extract_all(original_text, '\[[^\[\]]+\]'), v))) AS xv,
 list_distinct(list_filter(regexp_extract_all(original_text, '\{[^{}]+\}'), lambda v: NOT list_contains(regexp_extract_all(translated_text, '\{[^{}]+\}'), v))) AS lt FROM tl_entries WHERE original_text IS NOT NULL AND translated_text IS NOT NULL),
 i AS (SELECT tl_id, file_path, 'error' AS severity, 'missing_placeholder' AS issue_type, array_to_string(list_sort(lv), ', ') AS message FROM p WHERE len(lv) > 0
 UNION ALL SELECT tl_id, file_path, 'warning', 'extra_placeholder', array_to_string(list_sort(xv), ', ') FROM p WHERE len(xv) > 0
 UNION ALL SELECT tl_id, file_path, 'warning', 'missing_tag', array_to_string(list_sort(lt), ', ') FROM p WHERE len(lt) > 0)"""


def _issues(spark, d):
    return health.placeholder_issues(t(spark, d, "tl_entries"), ("tl_id", "file_path"))


@query(_ISSUES + " SELECT tl_id, severity, issue_type, message FROM i")
def placeholder_issues(spark, d):
    """T33 as issues."""
    return _issues(spark, d).select("tl_id", "severity", "issue_type", "message")


@query(_ISSUES + " SELECT file_path, count_if(severity IN ('error', 'critical')) AS errors, count_if(severity = 'warning') AS warnings, count_if(severity = 'info') AS infos, count_if(severity IN ('error', 'critical')) = 0 AS is_healthy FROM i GROUP BY file_path")
def severity_counts(spark, d):
    """A03."""
    return metrics.severity_counts(_issues(spark, d), ["file_path"])


@query("SELECT lower(text_type) AS text_type, count(*) AS n, count(DISTINCT text) AS texts FROM entries GROUP BY 1")
def context_summary(spark, d):
    """A04, A16."""
    return t(spark, d, "entries").groupBy(F.lower("text_type").alias("text_type")).agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"))


@query(r"""WITH w AS (SELECT unnest(regexp_extract_all(text, '[^.!?"]\s([A-Z][a-z]+)', 1)) AS term FROM entries WHERE text IS NOT NULL), c AS (SELECT term, count(*) AS n FROM w GROUP BY term ORDER BY n DESC, term LIMIT 50)
SELECT term, n FROM c WHERE n >= 3 AND length(term) > 3""")
def term_topk(spark, d):
    """The 50 most frequent, then the filters."""
    c = metrics.term_counts(t(spark, d, "entries").where("text is not null"), "text")
    return relational.top_k(c, "n", 50, "term").where("n >= 3 and length(term) > 3")


@query(f"""WITH a AS (SELECT text, {strip("coalesce(text, '')")} AS s FROM entries) SELECT coalesce(text, '') AS text, count(*) AS n FROM a WHERE {FALSE_POSITIVE} GROUP BY 1 ORDER BY n DESC, text LIMIT 20""")
def false_positive_top(spark, d):
    """A06."""
    c = t(spark, d, "entries").where(P.false_positive(F.col("text"))).groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("n"))
    return relational.top_k(c, "n", 20, "text")


@query("""SELECT translation_id, count(*) AS n, array_to_string(list_sort(list(tl_id))[1:5], ',') AS ids FROM tl_entries WHERE translation_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def duplicate_ids(spark, d):
    """A07, without the report's limit of 200."""
    return metrics.duplicates(t(spark, d, "tl_entries").select("translation_id", "tl_id"), "translation_id", "tl_id").select("translation_id", "n", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query(f"""WITH a AS (SELECT *, {strip("coalesce(text, '')")} AS s FROM entries)
SELECT count(DISTINCT file_path) AS files, count(*) AS extracted, count(raw_text) AS with_raw, count(translation_id) AS with_id, count(DISTINCT translation_id) AS ids, count_if({FALSE_POSITIVE}) AS flagged FROM a""")
def scan_stats(spark, d):
    """A08."""
    return t(spark, d, "entries").agg(
        F.countDistinct("file_path").alias("files"), F.count("*").alias("extracted"), F.count("raw_text").alias("with_raw"), F.count("translation_id").alias("with_id"),
        F.countDistinct("translation_id").alias("ids"), F.count_if(P.false_positive(F.col("text"))).alias("flagged"),
    )


@query("SELECT doc_kind, count(*) AS files, count_if(text IS NULL OR text = '') AS empty, sum(length(text)) AS chars, count_if(n_chars <> length(text)) AS stale FROM documents GROUP BY doc_kind")
def format_stats(spark, d):
    """A09."""
    x = F.col("text")
    return t(spark, d, "documents").groupBy("doc_kind").agg(
        F.count("*").alias("files"), F.count_if(x.isNull() | (x == "")).alias("empty"), F.sum(F.length(x)).alias("chars"), F.count_if(F.col("n_chars") != F.length(x)).alias("stale")
    )


@query("SELECT engine, count_if(translated_text IS NOT NULL) AS hits, count_if(translated_text IS NULL) AS misses, round(100.0 * count_if(translated_text IS NOT NULL) / count(*), 2) AS hit_rate FROM (SELECT lower(engine) AS engine, translated_text FROM results) GROUP BY engine")
def cache_stats(spark, d):
    """A11."""
    return metrics.cache_stats(t(spark, d, "results").withColumn("engine", F.lower("engine")), ["engine"], F.col("translated_text").isNotNull())


@query("""SELECT file_path, CASE WHEN count_if(entry_type = 'string') > 0 AND count_if(entry_type = 'dialogue') = 0 THEN 'strings' WHEN count_if(entry_type = 'dialogue') > 0 AND count_if(entry_type = 'string') = 0 THEN 'dialogue' ELSE 'mixed' END AS file_type, count(*) AS n FROM tl_entries GROUP BY file_path""")
def file_types(spark, d):
    """A17."""
    return metrics.file_types(t(spark, d, "tl_entries"))


@query("SELECT lang, count(*) AS n, count(DISTINCT original_text) AS originals FROM tl_entries WHERE translated_text IS NOT NULL GROUP BY lang")
def memory_size(spark, d):
    """A20."""
    return t(spark, d, "tl_entries").where("translated_text is not null").groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("original_text").alias("originals"))


@query("SELECT lang, original_text, max_by(translated_text, tl_id) AS translation FROM tl_entries WHERE translated_text IS NOT NULL AND original_text IS NOT NULL GROUP BY 1, 2")
def memory_export(spark, d):
    """The last translation of each original."""
    e = t(spark, d, "tl_entries").where("translated_text is not null and original_text is not null")
    return e.groupBy("lang", "original_text").agg(F.max_by("translated_text", "tl_id").alias("translation"))


@query("""WITH f AS (SELECT lower(engine) AS engine, target_lang, count_if(NOT success) AS failures FROM results WHERE engine IS NOT NULL GROUP BY 1, 2), m AS (SELECT *, min(failures) OVER (PARTITION BY target_lang) AS least FROM f)
SELECT engine, target_lang, failures FROM m WHERE failures <= least + 2""")
def best_endpoints(spark, d):
    """Engines whose failures are within two of the fewest."""
    f = t(spark, d, "results").where("engine is not null").groupBy(F.lower("engine").alias("engine"), "target_lang").agg(F.count_if(~F.col("success")).alias("failures"))
    m = f.withColumn("least", F.min("failures").over(Window.partitionBy("target_lang")))
    return m.where(F.col("failures") <= F.col("least") + 2).select("engine", "target_lang", "failures")


@query("""SELECT 'entries' AS src, entry_id AS id, text FROM entries UNION ALL SELECT 'tokens', token_id, text FROM tokens""")
def union_extractors(spark, d):
    """U01."""
    e = t(spark, d, "entries").select(F.lit("entries").alias("src"), F.col("entry_id").alias("id"), "text")
    return e.unionByName(t(spark, d, "tokens").select(F.lit("tokens").alias("src"), F.col("token_id").alias("id"), "text"), allowMissingColumns=True)


@query("SELECT lang, array_to_string(list(src ORDER BY length(src) DESC, src), '|') AS terms FROM glossary GROUP BY lang")
def longest_first(spark, d):
    """O01."""
    g = t(spark, d, "glossary").groupBy("lang").agg(F.collect_list("src").alias("s"))
    return g.select("lang", F.array_join(relational.longest_first(F.col("s")), "|").alias("terms"))


@query("""WITH l AS (SELECT req_idx, arg_max(result_id, (finished_at, result_id)) AS result_id, count(*) AS sent FROM results WHERE finished_at IS NOT NULL GROUP BY 1)
SELECT req_idx, result_id, sent, row_number() OVER (ORDER BY req_idx NULLS FIRST) - 1 AS place FROM l""")
def request_order(spark, d):
    """The last answer of each request, in the order of the requests."""
    r = t(spark, d, "results").where("finished_at is not null")
    last = r.groupBy("req_idx").agg(F.max_by("result_id", F.struct("finished_at", "result_id")).alias("result_id"), F.count("*").alias("sent"))
    return relational.numbered(last, [], ["req_idx"], "place")


# --- extraction and output ---------------------------------------------------------------------------------------------

TL = LINES.replace("documents WHERE text IS NOT NULL", "documents WHERE doc_kind = 'tl_file' AND text IS NOT NULL").replace(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", r"\r\n|\r|\n")
TL += rf""", s AS (SELECT doc_id, line_number AS n, {strip('line')} AS line, {strip("coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY line_number), '')")} AS nxt FROM n),
 bk AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '{tl.HEADER}') THEN regexp_extract(line, '{tl.HEADER}', 2) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS block_id FROM s WHERE line <> ''),
 k AS (SELECT *, CASE WHEN regexp_matches(line, '{tl.OLD}') THEN 'string' WHEN block_id <> 'strings' AND regexp_matches(line, '{tl.SAID}') AND regexp_matches(nxt, '{tl.SAYS}') THEN 'dialogue'
   WHEN block_id <> 'strings' AND regexp_matches(line, '{tl.TOLD}') AND regexp_matches(nxt, '{tl.TELLS}') THEN 'narrator' END AS entry_type FROM bk),
 x AS (SELECT doc_id, block_id, entry_type, CASE WHEN entry_type = 'string' THEN n ELSE n + 1 END AS line_number,
   CASE entry_type WHEN 'string' THEN regexp_extract(line, '{tl.OLD}', 1) WHEN 'dialogue' THEN regexp_extract(line, '{tl.SAID}', 2) ELSE regexp_extract(line, '{tl.TOLD}', 1) END AS o,
   CASE entry_type WHEN 'string' THEN regexp_extract(nxt, '{tl.NEW}', 1) WHEN 'dialogue' THEN regexp_extract(nxt, '{tl.SAYS}', 2) ELSE regexp_extract(nxt, '{tl.TELLS}', 1) END AS t FROM k WHERE entry_type IS NOT NULL),
 u AS (SELECT *, replace(replace(replace(replace(o, '\n', chr(10)), '\t', chr(9)), '\"', '"'), '\\', '\') AS original_text, replace(replace(replace(replace(t, '\n', chr(10)), '\t', chr(9)), '\"', '"'), '\\', '\') AS translated_text FROM x),
 y AS (SELECT *, {strip('original_text')} AS st FROM u)
SELECT doc_id, block_id, entry_type, line_number, original_text, translated_text FROM y WHERE NOT (length(st) <= 1 OR regexp_matches(st, '\?[A-Za-z]\d{{3}}\?|[⟦⟧]') OR regexp_matches(replace(replace(st, '.', ''), ',', ''), '\A[0-9]+\z'))"""


@query(TL)
def tl_parse(spark, d):
    """Entries of translation files."""
    docs = t(spark, d, "documents").where("doc_kind = 'tl_file' and text is not null").select("doc_id", "text")
    return tl.parse(docs, "doc_id").select("doc_id", "block_id", "entry_type", "line_number", "original_text", "translated_text")


def _scripts(spark, d):
    return t(spark, d, "documents").where("doc_kind = 'script' and text is not null").select("doc_id", "text")


@query()
def lexer_tokens(spark, d):
    """String tokens with contexts."""
    k = extract.script_tokens(_scripts(spark, d), "doc_id")
    return k.select("doc_id", "seq", "token_type", "text", "raw_text", "line_number", F.array_join("context_path", ">").alias("path"), "text_type")


@query()
def grammar_entries(spark, d):
    """Kinds of statements."""
    k = extract.statement_kind(extract.script_tokens(_scripts(spark, d), "doc_id"))
    return k.select("doc_id", "seq", "text", "kind", "character")


@query()
def build_entries(spark, d):
    """Entries of scripts with masks, merged with the deep scan."""
    scripts = _scripts(spark, d)
    e = extract.build_entries(extract.script_tokens(scripts, "doc_id"))
    deep = extract.deep_strings(scripts, "doc_id")
    return extract.merge_passes([e, deep], "doc_id").select("doc_id", "text", "line_number", "text_type", "pass_no")


@query()
def deep_scan(spark, d):
    """P08 to P10, P13, P16, P25."""
    return extract.deep_strings(_scripts(spark, d), "doc_id").select("doc_id", "seq", "text", "line_number", "key_name")


@query(r"""SELECT DISTINCT unnest(regexp_extract_all(text, 'define\s+\w+\s*=\s*Character\s*\(\s*(?:_\()?"([^"]+)"', 1)) AS name FROM documents WHERE text IS NOT NULL""")
def character_names(spark, d):
    """P22."""
    return extract.character_names(t(spark, d, "documents").where("text is not null"))


@query()
def unwrapped_strings(spark, d):
    """T35."""
    return health.unwrapped(scan_lines(spark, d), "doc_id")


@query("WITH a AS (" + SKIP.replace("result_id, ", "entry_id, ", 1).replace("translated_text", "text").replace("FROM results", "FROM entries").replace("SELECT result_id", "SELECT entry_id", 1) + r""") ,
 e AS (SELECT e.entry_id, e.file_path, '    # ' || concat_ws(' ', coalesce(file_path, 'unknown') || ':' || coalesce(line_number, 0), CASE WHEN character <> '' THEN '(' || character || ')' END, CASE WHEN text_type <> 'dialogue' THEN '[' || text_type || ']' END, CASE WHEN is_engine_common THEN '[engine_common]' END)
  || chr(10) || '    old "' || replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(9), '\t') || '"' || chr(10) || '    new ""' || chr(10) AS block FROM entries e JOIN a ON a.entry_id = e.entry_id AND NOT a.skip)
SELECT entry_id, block FROM e""")
def strings_template(spark, d):
    """K03, one block per entry."""
    e = t(spark, d, "entries").where(~P.should_skip(F.col("text")))
    return e.select("entry_id", sinks.template_block(e).alias("block"))


@query()
def template_files(spark, d):
    """Whole templates, one per source file."""
    return sinks.strings_template(t(spark, d, "entries"), "turkish", ["file_path"], ["line_number", "entry_id"])


@query()
def tl_rewrite(spark, d):
    """Translation files with their pseudo-translations written in."""
    docs = t(spark, d, "documents").where("doc_kind = 'tl_file' and text is not null").select(F.col("doc_id").cast("string").alias("file_path"), "text")
    e = tl.parse(docs)
    new = e.select("file_path", F.when(F.col("entry_type") == "string", F.col("line_number") + 1).otherwise(F.col("line_number")).alias("line_number"), X.pseudo(F.col("original_text")).alias("translation"))
    lines = docs.select("file_path", F.posexplode(F.split(X.unix_lines(F.col("text")), "\n", -1)).alias("n", "line")).select("file_path", (F.col("n") + 1).alias("line_number"), "line")
    return sinks.rewrite(lines, new)


@query()
def wrap_source(spark, d):
    """Source lines with their literals marked."""
    return scan_lines(spark, d).select("doc_id", "line_number", sinks.wrap_strings(F.col("line")).alias("line"))


_P = _pseudo("both").rsplit("SELECT entry_id, ", 1)[1].split(" AS pseudo")[0]
PROGRESS = (
    PROTECT.replace("SELECT entry_id, text,", "SELECT lang, text,").replace("FROM entries WHERE text IS NOT NULL", f"FROM (SELECT lang, {strip('line')} AS text FROM (SELECT d.lang, n.line FROM n JOIN documents d USING (doc_id))) WHERE {letters(unmask('text'))} >= 2")
)
PROGRESS = LINES + ", " + PROGRESS.strip().removeprefix("WITH ") + rf""", z AS (SELECT lang, text, {_P} AS pseudo FROM p)
SELECT lang, count(*) AS total, count_if(pseudo <> text) AS translated, count_if(pseudo = text) AS untranslated, round(100.0 * count_if(pseudo <> text) / count(*), 2) AS progress,
 count_if(len(list_filter(regexp_extract_all(text, '\[[^\]]+\]'), lambda v: NOT contains(pseudo, v))) = 0) AS kept FROM z GROUP BY lang"""


@query(PROGRESS)
def pseudo_progress(spark, d):
    """The minimum slice: lines, filter, mask, pseudo-translate, restore, check, progress by language."""
    docs = t(spark, d, "documents").select("lang", "text")
    from loclake.sources.text import txt_entries

    e = txt_entries(docs, "text", ("lang",)).select("lang", "text")
    e = e.withColumn("pseudo", X.pseudo(F.col("text"))).withColumn("kept", X.placeholders_kept(F.col("text"), F.col("pseudo")))
    done = F.col("pseudo") != F.col("text")
    n, ok = F.count("*"), F.count_if(done)
    return e.groupBy("lang").agg(n.alias("total"), ok.alias("translated"), (n - ok).alias("untranslated"), metrics.percent(ok, n).alias("progress"), F.count_if("kept").alias("kept"))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_duration, round(avg(CASE WHEN value > 10 THEN 0.0 ELSE 1.0 END), 6) AS failure_rate FROM events GROUP BY 1, 2""")
def stream_metrics(spark, d):
    """Streaming extension, on the batch side."""
    m = stream.engine_metrics(t(spark, d, "events"), "ts", ["event_type"], F.col("value"), F.col("value") > 10)
    return m.withColumns({c: F.round(c, 6) for c in ("mean_duration", "failure_rate")})
