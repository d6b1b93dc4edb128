"""Kernels against brute force, exact round trips and planted cases."""

import random
import re

import numpy as np
import pytest

from loclake.llm import bpe, p01_confusables as p1, p02_encoding as p2, p03_near as p3, p04_residue as p4, p05_code as p5, p06_layout as p6, p09_pack as p9, p10_split as p10

PATH = bpe.path_of(bpe.BPE_50K)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Ｗａｉｔ, Bob!", "Wait, Bob!"), ("an­chor", "anchor"), ("no break", "no break"), ("été", "été"), ("ﬁrst", "first"), ("pаst", "past"), ("ﾊﾟﾝ", "パン"),
        ("\U0001f469‍\U0001f680", "\U0001f469‍\U0001f680"), ("می‌خواهد", "می‌خواهد"), ("終了。　「はい」", "終了。　「はい」"),
        ("Привет Bob", "Привет Bob"), ("“so” – ½ ™", "“so” – ½ ™"), ("a\\nМир", "a\\nМир"), ("и́", "и́"),
    ],
)
def test_canonical(text, want):
    assert p1.canonical(text) == want
    assert p1.canonical(want) == want


def test_skeletons_agree():
    assert p1.skeleton("pаypal") == p1.skeleton("paypal") == p1.skeleton("ｐａｙｐａｌ")


RU = "Подожди, нам ещё нужно найти корзину и фонарь до рассвета."
TR = "Gün doğmadan önce gümüş yüzüğü bulmamız gerekiyor."
JA = "待って、夜明け前に鍵とかごがまだ必要なの。"


@pytest.mark.parametrize(
    "text, true, wrong",
    [(TR, "utf_8", "cp1252"), (TR, "utf_8", "latin_1"), (TR, "utf_8", "mac_roman"), (TR, "utf_8", "cp437"), (RU, "utf_8", "cp1251"), (RU, "utf_8", "latin_1"), (RU, "koi8_r", "cp1251"), (RU, "cp1251", "latin_1"), (JA, "utf_8", "latin_1"), (JA, "cp932", "cp1252"), (JA, "euc_jp", "latin_1")],
)
def test_repair(text, true, wrong):
    counts: p2.Counter = p2.Counter()
    p2.russian_pairs((RU + " слушай внимательно сначала потом никак не наоборот дорога закрыта уже много дней ") * 3, counts)
    got = p2.repair(p2._as(text, true, wrong), frozenset(), p2.Pairs(counts))
    assert got is not None
    if true != "koi8_r":
        assert got[0] == text
    assert p2.repair(text, frozenset(), p2.Pairs(counts)) is None


def test_explain():
    assert p2.explain("gÃ¼n", "gün") == "utf_8>cp1252"
    assert p2.explain("gun", "gün") is None


def test_near_duplicates_against_brute_force():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(150):
        base = [rng.choice(words) for _ in range(rng.randrange(8, 40))]
        texts.append(base)
        for _ in range(2):
            e = list(base)
            for _ in range(rng.randrange(1, 6)):
                e[rng.randrange(len(e))] = rng.choice(words)
            if rng.random() < 0.4:
                k = rng.randrange(1, len(e))
                e = e[k:] + e[:k]
            texts.append(e)
    kmers = [np.array([hash(x) for x in zip(t, t[1:])], np.int64) for t in texts]
    none = (np.empty(0, np.int64), np.empty(0))
    sk = p3.order_sketches(kmers, none)
    sets = [set(k.tolist()) for k in kmers]
    true = {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])}
    found = {(i, j) for i in range(len(sets)) for j in range(i) if (sk[i] == sk[j]).any() and p3.similar(kmers[i].tolist(), kmers[j].tolist())}
    assert found == true and len(true) > 100


def test_residue():
    r = p4.Residue({}, 1000)
    o = "Nobody remembers who painted the mirror."
    for bad in ("502 Bad Gateway", "<h1>404 Not Found</h1>", "Please enable JavaScript to continue.", "TBD", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Niemand ${name} weiß es.", "Niemand ⟦V000⟧ weiß es."):
        assert r.translation(o, bad), bad
    for good in ("Niemand erinnert sich, wer den Spiegel gemalt hat.", "Das Terminal blinkte: Fehler 404, Tür Nummer 7 nicht gefunden, versuch es später.", "Er flüsterte „lorem ipsum“ und schloss das Buch für zehn Jahre.", None, "", o):
        assert not r.translation(o, good), good
    assert r.mask_value("Hi [name]", None) and r.mask_value("Hi", "TODO") and r.mask_value("Hi", "[YOUR TEXT HERE]") and not r.mask_value("Hi [name]", "[ name ]") and not r.mask_value("x", "{/i}")


def test_residue_needs_its_index_and_weights():
    o, bad = "Nobody remembers who painted the mirror.", ["Niemand erinnert sich, w Your text here", "Kasabada hiç kim TBD", "502 Bad Gateway", "Lorem ipsum dolor sit amet, consectetur adipiscing elit."]
    good = ["Todo el pueblo lo oirá, y no es todo", "Er sagte nur: „lorem ipsum“", "Das ist ein Test"]
    for n in (1000, 10**5, 10**8):
        r = p4.Residue({"the": n // 2, "test": n // 100, "todo": n // 50}, n)
        assert all(r.translation(o, t) for t in bad) and not any(r.translation(o, t) for t in good)
    r.postings.clear(), r.endings.clear()
    assert not any(r.translation(o, t) for t in bad)


def test_residue_postings_miss_no_exemplar():
    r = p4.Residue({"not": 900, "found": 50, "request": 300}, 1000)
    for i, e in enumerate(r.sets):
        for drop in e:
            rest = e - {drop}
            if sum(r.idf[t] for t in rest) >= p4.CONTAINED * r.weight[i]:
                assert any(i in r.postings.get(t, ()) for t in rest)


def test_code_literals():
    code = 'def f():\n    # Nobody remembers who painted it.\n    x = "a#b"  # TODO\n    """One two\n    three four."""\n    y = \'it\\\'s\'\n'
    got, rest = p5.literals(code)
    assert [(k, n) for k, n, _ in got] == [("comment", 2), ("string", 3), ("comment", 3), ("string", 4), ("string", 6)]
    assert "Nobody" not in rest and "x =" in rest
    assert p5.is_code(code) and not p5.is_code("Wait, Bob! # 3 is here.") and not p5.is_code("title=a; owner=b")


def test_layout_copies_against_brute_force():
    rng = random.Random(1)
    base = ["Who locked Ann in the old theatre?", "Straße nach Rom, 25 Tage", "Oda 7 boş; İyi", "ééé ààà ììì ooo", '{"a": "one two", "b": "3"}']
    texts = list(base)
    for t in base[:4]:
        texts += [t.upper() if "ß" not in t and "ı" not in t else t, "  " + t.replace(" ", "\t") + "!!", re.sub(r"\W", "", t), t + "x"]
    texts += ["b=3; a=one two", "A: one two | B: 3", '{"a": "3", "b": "one two"}']
    rng.shuffle(texts)
    h1, h2, _ = p6.layout_keys(texts)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (h1[i] == h1[j] and h2[i] == h2[j]) == p6.copies(a, b), (a, b)


def test_pieces_and_bins():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 2049) for _ in range(500)]
    bins = p9.best_two_fit(sizes)
    load = {}
    for s, b in zip(sizes, bins):
        load[b] = load.get(b, 0) + s
    assert -1 not in load and max(load.values()) <= 2048 and sum(sizes) / (2048 * len(load)) > 0.95
    text = "日本語のテキスト。" * 3000
    cut = p9.pieces_of(text, PATH)
    assert cut[0][0] == 0 and all(a[1] == b[0] for a, b in zip(cut, cut[1:])) and all(b - a <= 2048 for a, b in cut)


def test_split_overlaps_and_locality():
    rng = random.Random(4)
    words = "the ferry leaves at noon and nobody knows who painted this mirror".split()
    text = "\n\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(5, 60))) + "." for _ in range(120))
    a = p10.split(text, PATH)
    assert all(e - s <= 512 for s, e, _, _ in a) and all(y[0] == x[1] - 64 for x, y in zip(a, a[1:]))
    ids = bpe.encode(text, PATH)
    assert a[0][0] == 0 and a[-1][1] == len(ids)
    assert all(how != "limit" for _, _, how, _ in a)
    b = p10.split(text[:200] + " A short new sentence." + text[200:], PATH)
    assert len({x[3] for x in a} & {x[3] for x in b}) >= len(a) - 4
    assert p10.split("short", PATH) == []


def test_encoding_round_trip():
    for t in ("", "naïve café", "日本語 🏳️‍🌈", " " * 5000, "a" * 20000, "x\ud800y"):
        ids = bpe.encode(t, PATH)
        if "\ud800" not in t:
            inv = {i: b for b, i in bpe.ranks(PATH).items()}
            assert b"".join(inv[int(i)] for i in ids).decode() == t


def test_hot_groups_of_copies_keep_every_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(p6, "HOT", 20)
    texts = ["Nobody knows who painted the mirror." + "!" * (i % 7) for i in range(60)] + [f"Another text, number {i}." for i in range(40)] + ["ANOTHER TEXT number 3"]
    rows = spark.createDataFrame([("entries", i, t, "") for i, t in enumerate(texts)], "src string, id long, text string, within string")
    got = {(r["id"], r["first_id"]) for r in p6.grouped(rows).collect()}
    assert got == {(i, 0) for i in range(60)} | {(63, 63), (100, 63)}
