"""Chains learned from near-twins of words and of whole texts."""

import pytest

from loclake.llm import p02_encoding as p2

RU = ["Подожди, нам ещё нужно найти корзину {}.", "Никто не помнит, кто нарисовал зеркало {}.", "Дорога закрыта уже много дней {}.", "Моя бабушка всегда пела, когда шёл снег {}."]


def texts(spark, wrong, true="utf_8"):
    rows = []
    for i, t in enumerate(RU):
        t = t.format(i)
        rows += [(3 * i, "russian", "translated_text", t, f"o{i}"), (3 * i + 1, "russian", "translated_text", t, f"o{i}"), (3 * i + 2, "russian", "translated_text", p2._as(t, true, wrong), f"o{i}")]
    return spark.createDataFrame(rows, "tl_id long, lang string, field string, text string, original string")


@pytest.mark.parametrize("true, wrong", [("utf_8", "cp1252"), ("cp1251", "latin_1"), ("utf_8", "cp1253")])
def test_whole_texts_teach_chains(spark, true, wrong):
    learned = p2.learn(texts(spark, wrong, true))
    assert any(c.startswith(f"{true}>") for c in learned), learned


def test_a_set_beside_the_usual_ones_is_read_only_where_it_was_learned(spark):
    t = "Gün doğmadan önce gümüş yüzüğü bulmamız gerekiyor."
    bad = p2._as(t, "utf_8", "iso8859_7")
    pairs = p2.Pairs({})
    learned = p2.repair(bad, frozenset({"utf_8>iso8859_7"}), pairs)
    assert learned == (t, "utf_8>iso8859_7")
    assert p2.repair(bad, frozenset(), pairs) != learned


def test_empty_table_teaches_nothing(spark):
    assert p2.learn(texts(spark, "cp1252").where("false")) == frozenset()
