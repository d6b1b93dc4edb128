"""Candidate lists of sketches, blocks of hot sketches and templates against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from loclake.llm import p03_near as p3


@pytest.mark.parametrize("most", [4, 10, 2000])
def test_meetings_give_all_pairs_of_a_sketch(most):
    rng = np.random.default_rng(2)
    sizes = np.array([1, 2, 3, 7, 1, 25, 1000, 1, 2])
    s = np.repeat(np.arange(len(sizes)) * 5, sizes)
    n = rng.permutation(len(s))
    batches = [pa.RecordBatch.from_arrays([pa.array(n[i : i + 100]), pa.array(s[i : i + 100])], names=["no", "sketch"]) for i in range(0, len(s), 100)]
    got, blocks = set(), {}
    for row in (b.to_pylist()[0] for b in p3.meetings(iter(batches), most)):
        if row["a"] is not None:
            got |= set(zip(row["a"], row["b"]))
        else:
            assert len(row["members"]) <= most
            blocks.setdefault(row["sketch"], {})[row["block"]] = row["members"]
    for of in blocks.values():
        assert sorted(of) == list(range(len(of)))
        got |= {(min(x, y), max(x, y)) for i in of for j in of if i < j for x in of[i] for y in of[j]}
    want = {(min(x, y), max(x, y)) for k in np.unique(s) for x in n[s == k].tolist() for y in n[s == k].tolist() if x != y}
    assert got == want


def test_banded_matches_against_the_plain_recurrence():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(0, 15))] for _ in "ab")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert p3.banded_matches(a, b, 100) == t[-1][-1] and p3.banded_matches(a, b, 1) <= t[-1][-1]


def test_template_in_a_third_of_all_texts(spark, tmp_path):
    """A template of thirty words with eight own ones at the end: similar by what is common alone."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**9)}"
    stock = " ".join(f"stock{i}" for i in range(31))
    texts = [f"{stock} " + " ".join(word() for _ in range(8)) for _ in range(400)] + [" ".join(word() for _ in range(30)) for _ in range(800)]
    members = spark.createDataFrame([(f"r{i:04d}", t) for i, t in enumerate(texts)], "id string, text string")
    pairs = p3.similar_classes(p3.checkpoint(p3.classes(members))).collect()
    assert {(r["a"], r["b"]) for r in pairs} == {(f"r{i:04d}", f"r{j:04d}") for j in range(400) for i in range(j)}


def test_bitmaps_lose_no_pair_and_drop_most(spark):
    """Failing candidates must not carry k-mers: what the bitmaps leave holds all similar pairs and few others."""
    rng = random.Random(11)
    base = [[rng.randrange(-(2**63), 2**63) for _ in range(rng.choice([1, 2, 12, 40, 80, 900]))] for _ in range(60)]
    texts = base + [[k for k in t if rng.random() < rng.choice([0.5, 0.6, 0.8, 1])] + t[:2] for t in base] + [t + [rng.randrange(2**60) for _ in t] for t in base]
    reps = spark.createDataFrame(list(enumerate(texts)), "no long, kmers array<long>")
    pairs = spark.createDataFrame([(i, j) for j in range(len(texts)) for i in range(j)], "a long, b long")
    got = {(r["a"], r["b"]) for r in p3.possible(pairs, reps).collect()}
    want = {(i, j) for j in range(len(texts)) for i in range(j) if p3.similar(texts[i], texts[j])}
    assert len(want) > 60 and got >= want
    short = {(i, j) for i, j in got if max(len(texts[i]), len(texts[j])) < 100}
    assert len(short - want) < 0.02 * pairs.count()
