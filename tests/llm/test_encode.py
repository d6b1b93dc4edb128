"""Merges by higher-order functions, safe cuts and slices against the tokenizer's library."""

import random

import numpy as np
import pyarrow as pa
import pytest

from loclake.llm import bpe, p08_encode as p8

PATH = bpe.path_of(bpe.BPE_50K)
WORDS = [" hourglass", "Écoute", "подожди", "日本語のテキストをここに入力してください", "x" * 700, "ab" * 90, "ｆｕｌｌ", "‍", "ドラゴン裏覚醒", "pneumonoultramicroscopicsilicovolcanoconiosis" * 3, "a", "覚醒ー龍契士の魔"]


def merged(word: bytes) -> list[int]:
    r, p = bpe.ranks(PATH), [word[i : i + 1] for i in range(len(word))]
    while len(p) > 1:
        rank, i = min((r.get(p[i] + p[i + 1], 1 << 30), i) for i in range(len(p) - 1))
        if rank == 1 << 30:
            break
        p[i : i + 2] = [p[i] + p[i + 1]]
    return [r[x] for x in p]


def test_cuts_change_no_merge():
    rng = random.Random(5)
    letters = "abcxyzéüßжщяのーンゴ龍覚醒契士語日本裏ㅋ—…•█"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 40))) for _ in range(400)] + WORDS
    data = pa.array([w.encode() for w in words], pa.binary())
    n, parts = p8.cut_words(data, PATH)
    at = 0
    for w, k in zip(words, n):
        got = [x.as_py() for x in parts[at : at + k]]
        at += k
        assert b"".join(got) == w.encode() and [i for g in got for i in merged(g)] == merged(w.encode())
    assert at == len(parts) and len(parts) > len(words)
    sliced = p8.cut_words(data.slice(3, 5), PATH)
    assert sliced[0].tolist() == n[3:8].tolist()


def test_dictionary_folds_like_the_library(spark):
    rows = spark.createDataFrame([(bytearray(w.encode()),) for w in WORDS], "w binary")
    got = {bytes(r["w"]): r["ids"] for r in p8.dictionary(rows, PATH).collect()}
    assert all(got[w.encode()] == bpe.encode(w, PATH).tolist() for w in WORDS)


@pytest.mark.parametrize("most", [1, 7, 10_000])
def test_slices_keep_documents_whole(most):
    docs = [["a", " b", "a"], ["日本語のテキストをここに入力してください"], ["c"] * 20, [" b"]]
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6, 7, 8]), pa.array(docs, pa.list_(pa.string()))], names=["doc_id", "words"])
    back = {}
    for s in p8.slice_words(iter([batch]), PATH, most):
        at, words = 0, s.column("words")[0].as_py()
        codes = p8.unpacked(s.column("codes")[0])
        assert len(words) == len(set(words))
        for i, n in zip(np.frombuffer(s.column("docs")[0].as_py(), "<i8").tolist(), p8.unpacked(s.column("sizes")[0]).tolist()):
            back[i] = b"".join(words[c] for c in codes[at : at + n]).decode()
            at += n
    assert back == {5 + i: "".join(d) for i, d in enumerate(docs)}
