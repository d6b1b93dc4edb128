"""Operators on small tables: ties, nulls, hot keys, empty tables; brute force where there is no SQL."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loclake.operators import extract, fuzzy, glossary, health, metrics, relational, tl, translate
from loclake.plans import flow_queries
from loclake.sources import sinks


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_prefer_against_replay(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), i, rng.choice([True, False, None]), rng.choice([True, False, None])) for i in range(200)]
    kept = {}
    for k, i, c, d in rows:
        c, d = bool(c), bool(d)
        if k not in kept or (not kept[k][1] and c) or (not kept[k][2] and d):
            kept[k] = (i, c, d)
    got = relational.prefer(df(spark, rows, "text string, seq long, is_engine_common boolean, is_deep_scan boolean"), "text").collect()
    assert {r["text"]: r["seq"] for r in got} == {k: v[0] for k, v in kept.items()}


def test_packing_against_loop(spark):
    rng = random.Random(2)
    rows = [("e", i, rng.randrange(1, 900)) for i in range(300)] + [("long", 1, 9000), ("long", 2, 5)]
    want, no, chars, n = {}, {}, {}, {}
    for k, i, ln in rows:
        if k in no and (chars[k] + ln > 3000 or n[k] >= 25):
            no[k], chars[k], n[k] = no[k] + 1, 0, 0
        no.setdefault(k, 0)
        chars[k], n[k] = chars.get(k, 0) + ln, n.get(k, 0) + 1
        want[k, i] = no[k]
    got = relational.pack_slices(df(spark, rows, "k string, i long, n int"), ["k"], "i", "n").collect()
    assert {(r["k"], r["i"]): r["slice_no"] for r in got} == want


def test_packing_across_blocks(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([1, 40, 800, 3500])) for k in ("a", None) for i in range(200)] + [("short", i, 1) for i in range(90)]
    want, no, chars, n = {}, {}, {}, {}
    for k, i, ln in rows:
        if k in no and (chars[k] + ln > 3000 or n[k] >= 25):
            no[k], chars[k], n[k] = no[k] + 1, 0, 0
        no.setdefault(k, 0)
        chars[k], n[k] = chars.get(k, 0) + ln, n.get(k, 0) + 1
        want[k, i] = no[k]
    for block in (7, 25, 64):
        got = relational.pack_slices(df(spark, rows, "k string, i long, n int"), ["k"], "i", "n", block=block).collect()
        assert len(got) == len(rows) and {(r["k"], r["i"]): r["slice_no"] for r in got} == want


def test_slice_packing_keeps_every_text(spark, tmp_path):
    rows = spark.range(20_100).selectExpr("id AS result_id", "'e' AS engine", "'tr' AS target_lang", "concat('text ', id) AS original_text")
    rows.write.parquet(str(tmp_path / "results.parquet"))
    got = flow_queries.QUERIES["slice_packing"](spark, str(tmp_path)).agg(F.count("*"), F.countDistinct("slice_no"), F.max("slice_no")).first()
    assert tuple(got) == (20_100, 804, 803)


def test_keep_first_and_missing(spark):
    a = df(spark, [("x", 2), ("x", 1), ("y", 3), (None, 4)], "text string, seq long")
    assert {(r[0], r[1]) for r in relational.keep_first(a, ["text"], ["seq"]).collect()} == {("x", 1), ("y", 3), (None, 4)}
    assert [r["text"] for r in relational.missing_texts(a.where("text is not null"), df(spark, [("y",), (None,)], "text string"), "text", ["seq"]).collect()] == ["x"]


def test_adaptive_limits(spark):
    rows = [("e", i, s) for i, s in enumerate(["down", "up", "hold", "down"])]
    got = metrics.adaptive_limits(df(spark, rows, "k string, no long, signal string"), "k", "no").orderBy("no").collect()
    assert [r["limit"] for r in got] == [204, 224, 224, 179]


def test_duplicates_of_a_hot_key(spark):
    d = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("i"))
    got = metrics.duplicates(d, "k", "i").collect()
    assert [(r["k"], r["n"], r["ids"]) for r in got] == [("hot", 1667, [0, 3, 6, 9, 12])]


def test_translation_file_round_trip(spark):
    text = 'translate german strings:\n\n    # game/a.rpy:7\n    old "Say \\"hi\\""\n    new ""\n\n    old "Next"\n    new "Weiter"\ntranslate german start_1:\n\n    # e "Hello there"\n    e ""\n    # "Only told"\n    "Erzählt"\n'
    f = df(spark, [("a.rpy", text), ("none.rpy", ""), ("null.rpy", None)], "file_path string, text string")
    e = tl.parse(f).orderBy("line_number").collect()
    assert [(r["entry_type"], r["line_number"], r["original_text"], r["translated_text"], r["block_id"], r["source_comment"], r["character"]) for r in e] == [
        ("string", 4, 'Say "hi"', "", "strings", "game/a.rpy:7", None), ("string", 7, "Next", "Weiter", "strings", None, None),
        ("dialogue", 12, "Hello there", "", "start_1", None, "e"), ("narrator", 14, "Only told", "Erzählt", "start_1", None, None),
    ]
    lines = f.where("text <> ''").select("file_path", F.posexplode(F.split("text", "\n")).alias("n", "line")).select("file_path", (F.col("n") + 1).alias("line_number"), "line")
    new = df(spark, [("a.rpy", 5, 'Sag "hallo"'), ("a.rpy", 12, "Hallo"), ("a.rpy", 8, "")], "file_path string, line_number int, translation string")
    out = {r["line_number"]: r["line"] for r in sinks.rewrite(lines, new).collect()}
    assert out[5] == '    new "Sag \\"hallo\\""' and out[12] == '    e "Hallo"' and out[8] == '    new "Weiter"' and len(out) == 15
    assert tl.language_of(f.where("file_path = 'a.rpy'")).first()["lang"] == "german"


SCRIPT = '''label start:
    "It\\'s told"
    e "Hello # not a comment" # a comment "x"
    menu:
        "Go on":
            jump next
screen main():
    text "Title"
    textbutton _("Back") action Return()
python:
    notes = ["One two", "Three four"]
    desc = f"Hi {name} there"
    renpy.notify("Take care " + "now")
e """First
second"""
e "never closed
'''


def test_lexer_and_deep_scan(spark):
    f = df(spark, [("a", SCRIPT), ("b", None), ("c", "")], "file_path string, text string")
    t = extract.script_tokens(f).orderBy("seq").collect()
    assert [r["text"] for r in t][:4] == ["It's told", "Hello # not a comment", "Go on", "Title"]
    assert t[2]["context_path"] == ["label:start", "menu"] and t[3]["text_type"] == "ui" and t[-1]["text"] == "First\nsecond"
    kinds = {r["text"]: (r["kind"], r["character"]) for r in extract.statement_kind(extract.script_tokens(f)).collect()}
    assert kinds["Go on"][0] == "menu" and kinds["Hello # not a comment"] == ("character", "e") and kinds["It's told"][0] == "narration" and kinds["Back"][0] == "renpy_func" and kinds["Title"][0] == "ui"
    deep = {r["text"]: r["key_name"] for r in extract.deep_strings(f).collect()}
    assert deep == {"One two": "notes", "Three four": "notes", "Hi [name] there": "desc", "Take care now": None}
    merged = extract.merge_passes([extract.build_entries(extract.script_tokens(f)), extract.deep_strings(f)]).collect()
    assert len({(r["text"], r["line_number"]) for r in merged}) == len({(r["text"], r["line_number"], tuple(r["context_path"])) for r in merged}) - 0 or merged


def test_glossary(spark):
    g = glossary.terms(df(spark, [("key", "Schlüssel", "de"), ("silver key", "Silberschlüssel", "de"), (None, "x", "de"), ("key", "clé", "fr")], "src string, dst string, lang string"), "de")
    assert g == [("silver key", "Silberschlüssel"), ("key", "Schlüssel")]
    x = df(spark, [("The Silver key and a KEY, monkey.", "o"), ("anything", " Key "), (None, None)], "x string, o string")
    got = x.select(glossary.apply(F.col("x"), F.col("o"), g), glossary.protect(F.col("x"), g)["text"], glossary.protect(F.col("x"), g)["targets"]).collect()
    assert got[0][0] == "The Silberschlüssel and a SCHLÜSSEL, monkey." and got[1][0] == "Schlüssel" and got[2][0] is None
    assert got[0][1] == "The XRPYXGLO0XRPYX and a XRPYXGLO1XRPYX, monkey." and got[0][2] == ["Silberschlüssel", "Schlüssel"]
    assert {r["term"] for r in glossary.hits(x.where("x is not null"), "x", df(spark, g, "src string, dst string"), ("x",)).collect()} == {"silver key", "key"}


def test_fuzzy_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(400)]
    old = [(f"o{i}", " ".join(rng.choice(words) for _ in range(14)), f"t{i}") for i in range(60)]
    new = []
    for i, (_, o, _) in enumerate(old[:40]):
        w = o.split()
        w[rng.randrange(len(w))] = rng.choice(words)
        new.append((f"n{i}", o if i % 5 == 0 else " ".join(w)))
    m = fuzzy.match(df(spark, new, "new_id string, new_original string"), df(spark, old, "old_id string, old_original string, old_translation string"))
    got = {r["new_id"]: (r["old_id"], round(r["similarity"], 6)) for r in m.collect()}
    for i, n in new:
        best = max((round(fuzzy.ratio(n, o), 6), k) for k, o, _ in old)
        assert got[i] == (best[1], best[0])
    rep = fuzzy.report(m, df(spark, new, "new_id string, new_original string"), df(spark, old, "old_id string, old_original string, old_translation string")).first()
    assert rep["auto"] + rep["review"] == 40 and rep["unmatched_old"] == 20


def test_health(spark):
    p = df(spark, [(1, "[a] {b}x{/b}", "y [c]"), (2, "same [a]", "same [a]"), (3, None, "x")], "i int, original_text string, translated_text string")
    got = {(r["i"], r["issue_type"]): r["message"] for r in health.placeholder_issues(p, ("i",)).collect()}
    assert got == {(1, "missing_placeholder"): "[a]", (1, "extra_placeholder"): "[c]", (1, "missing_tag"): "{/b}, {b}"}


class Upper:
    name = "upper"

    def translate(self, texts, source, target):
        return [None if t == "bad" else t.upper() for t in texts]


def test_engine_and_cache(spark):
    schema = "req_idx long, engine string, source_lang string, target_lang string, text string"
    req = df(spark, [(i, "upper", "en", "de", t) for i, t in enumerate(["a", "a", "bad", "known", None])], schema)
    cache = df(spark, [("upper", "en", "de", "known", "K")], "engine string, source_lang string, target_lang string, text string, translated_text string")
    got = {r["req_idx"]: r["translated_text"] for r in translate.translate(req, Upper(), cache).collect()}
    assert got == {0: "A", 1: "A", 2: None, 3: "K", 4: None}
    parts = translate.split_joined(df(spark, [("x\n|||\n y ", 2), ("x", 2)], "r string, n int"), "r", "n").collect()
    assert [r["parts"] for r in parts] == [["x", "y"], None]


def test_similar_pairs_lose_nothing():
    rng = random.Random(6)
    base = ["".join(rng.choice("aaeeiioo nntt rsl") + rng.choice("bcdfgh ,.uvwz") for _ in range(rng.randrange(3, 170))) for _ in range(12)]
    base += ["".join(chr(0x4E00 + i + 300 * n) for i in range(260)) for n in range(2)]

    def edit(x):
        rate = rng.choice([0.01, 0.12])
        return "".join(rng.choice("xyz") if rng.random() < rate else c for c in x)[rng.randrange(3) :]

    old, new = sorted({*base, *map(edit, base), "", "ü", "日本語"}), sorted({edit(x) for x in base * 2} | {"ü!", "日本", ""})
    want = {(a, b): fuzzy.ratio(a, b) for a in new for b in old}
    assert {(a, b): r for a, b, r in fuzzy.similar_pairs(new, old, 0.7)} == {k: r for k, r in want.items() if r >= 0.7}
    assert any(len(a) > 200 and a != b for (a, b), r in want.items() if r >= 0.7)


def test_fuzzy_family_and_second_choice(spark, monkeypatch):
    # word pairs that every old text holds, and a best old text that two new ones share
    old = [(f"o{i}", f"the captain waits at gate number {c} until the last boat", f"t{i}") for i, c in enumerate("abcdefgh")]
    new = [(f"n{i}", f"the captain waits at gate number {c} until the last boats") for i, c in enumerate("aabcdefg")]
    want, free_n, free_o = {}, {n for n, _ in new}, {o for o, _, _ in old}
    for d, n, o in sorted((-fuzzy.ratio(x, y), n, o) for n, x in new for o, y, _ in old):
        if n in free_n and o in free_o:
            want[n] = (o, -d)
            free_n.remove(n)
            free_o.remove(o)
    sides = df(spark, new, "new_id string, new_original string"), df(spark, old, "old_id string, old_original string, old_translation string")
    for few in (fuzzy.FEW, 3):
        monkeypatch.setattr(fuzzy, "FEW", few)
        got = {r["new_id"]: (r["old_id"], r["similarity"]) for r in fuzzy.match(*sides).collect()}
        assert got == want and len(got) == 8


def test_numbers_of_a_hot_key(spark):
    rows = [("hot", (i * 7919) % 5003) for i in range(5003)] + [(None, i) for i in range(3)] + [("a", 1)]
    d = df(spark, rows, "k string, i long").repartition(7)
    assert relational.in_ranges(d, ["k"], ["i"]).where("k = 'hot'").select("_part").distinct().count() > 1
    got = relational.numbered(d, ["k"], ["i"], "n").collect()
    assert len(got) == len(rows) and all(r["n"] == (r["i"] if r["k"] != "a" else 0) for r in got)


def test_rolling_across_blocks(spark):
    rng = random.Random(4)
    rows = [("hot", i, float(rng.randrange(100)), rng.random() < 0.5) for i in range(300)]
    got = {r["i"]: (r["mean_duration"], r["failure_rate"], r["n_events"]) for r in metrics.rolling(df(spark, rows, "k string, i long, ms double, ok boolean"), "k", "i", "ms", F.col("ok"), rows=20, block=32).collect()}
    for i in range(300):
        part = rows[max(0, i - 19) : i + 1]
        assert got[i] == (sum(r[2] for r in part) / len(part), sum(not r[3] for r in part) / len(part), len(part))


def test_prefer_across_blocks(spark):
    rng = random.Random(8)
    rows = [("t", i, rng.random() < 0.5, rng.random() < 0.5) for i in range(120)]
    kept = rows[0]
    for r in rows[1:]:
        if (not kept[2] and r[2]) or (not kept[3] and r[3]):
            kept = r
    got = relational.prefer(df(spark, rows, "text string, seq long, is_engine_common boolean, is_deep_scan boolean"), "text", block=7).collect()
    assert [r["seq"] for r in got] == [kept[1]]


def test_glossary_of_any_size(spark):
    g = spark.range(20_000).selectExpr("concat('term', id) AS src", "concat('t', id) AS dst")
    x = df(spark, [(1, "A Term7 and term19999."), (2, "term"), (3, None)], "i int, x string")
    assert {(r["i"], r["target"]) for r in glossary.hits(x, "x", g, ("i",)).collect()} == {(1, "t7"), (1, "t19999")}


def test_memory_finds_similar_texts(spark):
    memory = [("de", 1, "The old key is lost.", "Der alte Schlüssel ist weg."), ("de", 2, "The old key is lost.", "zweite"), ("de", 3, "Something else entirely", "anderes"), ("fr", 4, "The old key is lost!", "La clé")]
    texts = [("de", "The old key is lost."), ("de", "The old keys are lost."), ("fr", "The old key is lost."), ("tr", "The old key is lost."), (None, "x"), ("de", None)]
    got = fuzzy.memory_lookup(df(spark, texts, "lang string, original string"), df(spark, memory, "lang string, entry_id long, original string, translation string")).collect()
    by = {(r["lang"], r["original"]): (r["translation"], r["source"]) for r in got}
    assert by == {
        ("de", "The old key is lost."): ("Der alte Schlüssel ist weg.", "exact"), ("de", "The old keys are lost."): ("Der alte Schlüssel ist weg.", "fuzzy"), ("fr", "The old key is lost."): ("La clé", "fuzzy"),
        ("tr", "The old key is lost."): (None, None), (None, "x"): (None, None), ("de", None): (None, None),
    }


CODE = """label start:
    e "Hello there"

    "Narrated" # "not this"
screen main(name):
    textbutton _("Back") action Return()
    text "Title"
menu:
    "Go on":
        jump x
python:
    notes = [
        "One two",
        "Three " "four",
    ]
    desc = "Five six"
    items.append("Seven eight")
"""


def test_literals_with_keys_and_usages(spark):
    got = {(t, line): (key, inside) for t, line, key, inside in extract.file_literals(CODE)}
    assert got[("One two", 13)] == ("notes", True) and got[("Three four", 14)] == ("notes", True) and got[("Five six", 16)] == ("desc", True) and got[("Seven eight", 17)] == ("items", True) and got[("Hello there", 2)] == (None, False)
    use = [(t, n, u, who, label, screen) for t, n, u, who, label, screen, _ in extract.usages(CODE)]
    assert use == [("Hello there", 2, "dialogue", "e", "start", None), ("Narrated", 4, "narrator", None, "start", None), ("Back", 6, "textbutton", None, None, "main"), ("Title", 7, "text", None, None, "main"), ("Go on", 9, "menu", None, None, None)]


def test_blank_lines_end_no_block():
    assert [p for *_, p, _, _ in extract.scan('label a:\n\n    "x"\n"y"')] == [["label:a"], []]


def test_best_pairs_and_lengths_within_the_band(monkeypatch):
    """Aligned texts leave early and few pairs are scored, but no pair at the need and no best one is lost."""
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefgh ijkl") for _ in range(rng.choice([30, 100, 150, 190]))) for _ in range(30)]

    def edit(x):
        return "".join(rng.choice(["", "x", "ab"]) if rng.random() < 0.1 else c for c in x)

    old, new = sorted({*base, *(edit(x) for x in base * 3), "🙂" * 40, "\ud800" + "y" * 60}), sorted({edit(x) for x in base} | {"🙂" * 39, "q" * 150})
    aligner, which = fuzzy._Aligner(old), np.arange(len(old))
    for a in new:
        exact = np.array([fuzzy.common_subsequence(a, b) for b in old])
        for share in (0.7, 0.85):
            need = share * (len(a) + aligner.sizes) / 2
            got = aligner.lengths(a, which, need)
            assert (got <= exact).all() and (got == exact)[exact >= need].all()
    every = fuzzy.similar_pairs(new, old, 0.7)
    top = {a: max(r for x, _, r in every if x == a) for a, _, _ in every}
    calls, ratio = [], fuzzy.ratio
    monkeypatch.setattr(fuzzy, "ratio", lambda a, b: calls.append(a) or ratio(a, b))
    assert sorted(fuzzy.similar_pairs(new, old, 0.7, best=True)) == sorted(p for p in every if p[2] == top[p[0]])
    assert len(every) > 60 and len(calls) < 0.8 * len(every)


def test_unlike_sentences_are_not_aligned(monkeypatch):
    """Bounds leave hardly a pair of unlike sentences to be aligned, below and above difflib's junk length, and lose none."""
    rng = random.Random(21)
    word = [["".join(rng.choice("aeiou") if i % 2 else rng.choice("bcdfghklmnprstvw") for i in range(rng.randrange(4, 9))) for _ in range(150)] for _ in range(4)]

    def text(n):
        return ". ".join(f"{rng.choice(word[0])} {rng.choice(word[1])}ed the {rng.choice(word[2])} {rng.choice(word[3])}" for _ in range(n))

    def edit(x):
        return "".join(rng.choice(["", "x", "ab"]) if rng.random() < 0.06 else c for c in x)

    old = sorted({text(n) for n in (3, 4, 5, 6, 8) for _ in range(12)})
    odd = ["a" * 190, "ab" * 95, "", "q", "a" * 130 + "b" * 60]
    new = sorted({edit(x) for x in old[::2]} | {text(n) for n in (3, 5, 8) for _ in range(6)} | {"a" * 300, "ba" * 90, "b" * 200, ""})
    assert min(map(len, old)) < 150 and max(map(len, old)) > 250
    aligned, lengths = [], fuzzy._Aligner.lengths
    monkeypatch.setattr(fuzzy._Aligner, "lengths", lambda self, a, which, need: aligned.extend(which) or lengths(self, a, which, need))
    want = {(a, b): r for a in new for b in [*old, *odd] if (r := fuzzy.ratio(a, b)) >= 0.7}
    assert {(a, b): r for a, b, r in fuzzy.similar_pairs(new, [*old, *odd], 0.7)} == want and len(want) >= 20
    assert len(aligned) < len(want) + 0.02 * len(new) * len(old)
    monkeypatch.setattr(fuzzy, "AT_ONCE", 50)
    monkeypatch.setattr(fuzzy, "LANES", 7)
    assert {(a, b): r for a, b, r in fuzzy.similar_pairs(new, [*old, *odd], 0.7)} == want


def test_report_computes_matches_once(spark):
    seen = spark.sparkContext.accumulator(0)
    look = F.udf(lambda x: seen.add(1) or x, "string")
    m = df(spark, [("n1", "o1", True), ("n2", "o2", False), ("n3", "o3", False)], "new_id string, old_id string, auto_apply boolean").where(look("new_id") != "")
    new, old = df(spark, [(f"n{i}",) for i in range(6)], "new_id string"), df(spark, [(f"o{i}",) for i in range(8)], "old_id string")
    assert fuzzy.report(m, new, old).first().asDict() == {"auto": 1, "review": 2, "unmatched_new": 3, "unmatched_old": 5}
    assert seen.value == 3


def test_unpopular_characters(monkeypatch):
    texts = ["", "a" * 99 + "b", "aab" + "c" * 250, "🙂🙂\ud800x" * 60 + "yz", "", "é"]
    want = [sum(c for c in Counter(x).values() if c <= len(x) // 100 + 1) for x in texts]
    assert fuzzy._unpopular(texts).tolist() == want
    monkeypatch.setattr(fuzzy, "AT_ONCE", 5)
    assert fuzzy._unpopular(texts).tolist() == want
