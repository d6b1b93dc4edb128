"""Problem 10: splitting oversized items at natural boundaries.

Content-defined chunking over tokens: a rolling hash of the last ``WINDOW`` tokens marks landmarks; a piece ends at
the natural boundary nearest to the first landmark between its minimum and maximum size, so an edit alters only the
pieces around it. Natural boundaries are the ends of scenes, paragraphs, lines and sentences that coincide with the
end of a token. Without a landmark the last boundary of the highest rank in reach is taken, without any boundary the
piece is cut at its maximum, where a character begins. Each next piece begins ``OVERLAP`` tokens before the end of
the one before; where that isn't the beginning of a character it begins up to three tokens earlier.

Texts of at most ``LIMIT`` tokens, null and empty texts have no pieces.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from loclake.llm.bpe import BPE_50K, encode, path_of, starts_character, token_bytes
from loclake.llm.common import spread, table

LIMIT, OVERLAP, LEAST, WINDOW, LANDMARK = 512, 64, 128, 8, 96
KINDS = ("sentence", "line", "paragraph", "scene")

# Natural ends in the bytes of a text; the position is that behind the match.
SCENE = re.compile(rb"\n(?=label |scene |screen |translate |#{1,3} |={3,}|-{3,}|\*{3,})")
WIDE_SENTENCE = re.compile("[。！？][」』”]?".encode())
_STOP, _AFTER = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".!?")] = True
_AFTER[list(b" \t\r\n\"')]")] = True
_GEAR = np.random.default_rng(97).integers(1, 2**63, 1 << 17, dtype=np.uint64)


def landmarks(ids: np.ndarray) -> np.ndarray:
    """Positions behind tokens whose window's rolling hash marks them."""
    with np.errstate(over="ignore"):
        g = _GEAR[ids % len(_GEAR)]
        h = np.zeros(len(ids), np.uint64)
        for k in range(min(WINDOW, len(ids))):
            h[k:] += g[: len(ids) - k] << np.uint64(k)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero((h >> np.uint64(32)) % np.uint64(LANDMARK) == 0) + 1


def boundaries(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token positions, ranks) of natural ends that are ends of tokens; one of several ranks has the highest."""
    raw = np.frombuffer(data + b"\n\n", np.uint8)
    stops = np.flatnonzero(_STOP[raw[:-2]])
    sentence = [stops[_AFTER[raw[stops + 1]]] + 1]
    if b"\xe3\x80\x82" in data or b"\xef\xbc" in data:
        sentence.append(np.array([m.end() for m in WIDE_SENTENCE.finditer(data)], int))
    line = np.flatnonzero(raw[:-2] == 10)
    before = line - (raw[line - 1] == 13)
    empty = (raw[line + 1] == 10) | (raw[line + 1] == 13)
    first, second = before[empty], line[empty]
    paragraph = [first, second + 1 + (raw[second + 1] == 13), second + 1 + (raw[second + 1] == 13) + 1]
    scene = np.array([m.end() for m in SCENE.finditer(data)], int) if len(line) else np.empty(0, int)
    by_rank = (np.concatenate(sentence), np.r_[before, line + 1], np.concatenate(paragraph), np.r_[scene, scene - 1])
    rank = np.full(len(data) + 4, -1, np.int8)
    for r, at in enumerate(by_rank):
        rank[at] = r
    rank = rank[np.minimum(ends, len(data))]
    rank[0] = -1
    k = np.flatnonzero(rank >= 0)
    return k, rank[k]


def split(text: str, path: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int, str, str]]:
    """(first token, end, kind of end, text) of the pieces of a text above the limit."""
    ids = encode(text, path)
    n = len(ids)
    if n <= limit:
        return []
    data = text.encode("utf-8", "replace")
    ends = np.r_[0, np.cumsum(token_bytes(path)[ids])]
    clean = starts_character(data, np.minimum(ends, len(data)))
    marks = landmarks(ids)
    cuts, ranks = boundaries(data, ends)
    out, start, done = [], 0, 0
    while n - start > limit:
        low, high = max(done + least, start + 1), start + limit
        a, b = np.searchsorted(cuts, low), np.searchsorted(cuts, high, "right")
        near, kind = cuts[a:b], ranks[a:b]
        m = marks[np.searchsorted(marks, low) :][:1]
        if len(near) and len(m) and m[0] <= high:
            # the nearest boundary; of two equally near the one of higher rank
            i = int(np.lexsort((-kind, np.abs(near - m[0])))[0])
            end, how = int(near[i]), KINDS[kind[i]]
        elif len(near):
            i = int(np.flatnonzero(kind == kind.max())[-1])
            end, how = int(near[i]), KINDS[kind[i]]
        else:
            end, how = high, "limit"
            while end > max(done, start) + 1 and not clean[end]:
                end -= 1
        out.append((start, end, how, data[ends[start] : ends[end]].decode("utf-8", "replace")))
        done, start = end, end - overlap
        while start > 0 and not clean[start]:
            start -= 1
    out.append((start, n, "end", data[ends[start] :].decode("utf-8", "replace")))
    return out


def split_documents(docs: DataFrame, path: str) -> DataFrame:
    def cut(batches):
        for pdf in batches:
            rows = [(d, k, a, b, b - a, how, t) for d, text in zip(pdf["doc_id"], pdf["text"]) if isinstance(text, str) for k, (a, b, how, t) in enumerate(split(text, path))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece_no", "token_start", "token_end", "n_tokens", "cut", "text"]).astype({c: "int32" for c in ("piece_no", "token_start", "token_end", "n_tokens")})

    # a token has at least one byte: shorter texts can't exceed the limit
    long = docs.select("doc_id", "text").where(f"octet_length(text) > {LIMIT}")
    return spread(long).mapInPandas(cut, "doc_id long, piece_no int, token_start int, token_end int, n_tokens int, cut string, text string")


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(table(spark, sf_dir, "documents", "doc_id", "text"), path_of(BPE_50K))


QUERIES = {"p10_pieces": p10_pieces}
SQL: dict[str, str] = {}
