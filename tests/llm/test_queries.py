"""Every query on empty tables and on odd rows; results stay defined."""

import pytest

from loclake.llm.queries import QUERIES

FOUND = {
    "p1_found": ["src", "row_id"], "p2_found": ["tl_id", "field"], "p3_found": ["id_a", "id_b"], "p4_found": ["src", "row_id"], "p5_found": ["entry_id", "field", "line_no", "kind", "lang"],
    "p6_found": ["src", "first_id", "copy_id"], "p7_found": ["src", "row_id", "defect"], "p8_ids": ["doc_id", "ids"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, empty, name):
    df = QUERIES[name](spark, empty)
    if name in FOUND:
        assert df.columns == FOUND[name]
    rows = df.collect()
    assert len(rows) == (1 if name in ("p8_roundtrip", "p9_fill") else 0)


@pytest.mark.parametrize("name", sorted(FOUND) + ["p9_batches", "p10_pieces"])
def test_odd_rows(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    assert len(rows) == len({tuple(map(str, r)) for r in rows})
    if name == "p8_ids":
        by = {r["doc_id"]: r["ids"] for r in rows}
        assert len(by) == 14 and by[0] == [] and by[1] == [] and by[99] == [] and by[2]
        from loclake.llm.bpe import BPE_50K, encode, path_of

        assert by[4] == encode("The ferry leaves at noon. " * 4000, path_of(BPE_50K)).tolist()
        assert by[5] == encode("x" * 50_000, path_of(BPE_50K)).tolist()
    if name == "p9_batches":
        sums = {}
        for r in rows:
            if r["bin_id"] is None:
                assert r["n_tokens"] == 0
            else:
                sums[r["bin_id"]] = sums.get(r["bin_id"], 0) + r["n_tokens"]
        assert max(sums.values()) <= 2048 and {r["doc_id"] for r in rows} == {*range(13), 99}
    if name == "p10_pieces":
        assert all(r["n_tokens"] <= 512 for r in rows) and {r["doc_id"] for r in rows} == {4, 5, 6}
    if name == "p3_found":
        assert ("n7", "n8") in {(r["id_a"], r["id_b"]) for r in rows}
    if name == "p1_found":
        assert {(r["src"], r["row_id"]) for r in rows} >= {("entries", 11), ("tokens", 11)} and ("entries", 9) not in {(r["src"], r["row_id"]) for r in rows}
    if name == "p6_found":
        assert ("entries", 7, 8) in {tuple(r) for r in rows}
