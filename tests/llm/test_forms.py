"""Consistent forms come from skeletons and the look-alike table."""

import pytest

from loclake.llm import p01_confusables as p1

MIXED = ["pаst", "tхe", "Оne", "Ѕee"]


def test_without_the_table_no_letter_of_another_alphabet_is_found():
    none = p1.Forms({})
    assert all(p1.canonical(t) != t and none.canonical(t) == t for t in MIXED)
    assert none.canonical("Ｗａｉｔ") == "Wait"


def test_public_table(spark):
    f = p1.forms(spark)
    assert len(f.prototypes) > 3000
    assert f.canonical("ᎪnnᎪ") == "AnnA" and p1.canonical("ᎪnnᎪ") == "ᎪnnᎪ"
    for own in ("Привет Bob", "Ελλάδα", "ᎠᎡᎢ", "été", "Straße", "ﾊﾟ".replace("ﾊﾟ", "パ")):
        assert f.canonical(own) == own
    for t in (*MIXED, "Ｒｏｏｍ　１", "ﾊﾟﾝ", "é"):
        assert f.skeleton(f.canonical(t)) == f.skeleton(t)


def test_groups_of_spellings(spark, tmp_path):
    rows = spark.createDataFrame([(1, "the past"), (2, "the pаst"), (3, None), (4, "")], "entry_id long, text string")
    rows.write.parquet(f"{tmp_path}/entries.parquet")
    spark.createDataFrame([(1, '"past"')], "token_id long, raw_text string").write.parquet(f"{tmp_path}/tokens.parquet")
    assert [tuple(r) for r in p1.p1_groups(spark, str(tmp_path)).collect()] == [("past", 2, 3, "past")]


def test_without_icu_the_run_ends(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "the pаst")], "entry_id long, text string").write.parquet(f"{tmp_path}/entries.parquet")
    spark.createDataFrame([(1, "past")], "token_id long, raw_text string").write.parquet(f"{tmp_path}/tokens.parquet")
    monkeypatch.setattr(p1, "CHECKER", "com.ibm.icu.text.NoSuchChecker$Builder")
    for query in (p1.p1_found, p1.p1_canonical, p1.p1_groups):
        with pytest.raises(RuntimeError, match="look-alike table"):
            query(spark, str(tmp_path))
