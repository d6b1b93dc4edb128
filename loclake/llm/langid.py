"""Language of short pieces of text: unigram counts per language over words or public tokenizer pieces."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

from loclake.llm.common import LANGS

WORD = re.compile(r"[^\W\d_]+")
JAPANESE = re.compile("[぀-ヿ㐀-鿿ー]")
CYRILLIC = re.compile("[Ѐ-ӿ]")
ALPHA = 0.5


class WordModel:
    """Log probabilities of words under each language; unknown words are judged by script and by their last letters.

    Trained on (language, text) pairs or on ``counts`` of words by language; counts of a language are scaled to the same
    total, so that a language that is rare in the texts isn't rare in the model.
    """

    def __init__(self, rows: list[tuple[str, str]], langs: tuple[str, ...] = LANGS, counts: dict[str, Counter] | None = None):
        self.langs = langs
        words = {lg: Counter((counts or {}).get(lg, {})) for lg in langs}
        for lang, text in rows:
            if lang in words:
                words[lang].update(w for w in WORD.findall(text.lower()))
        self.ids: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        total = {lg: sum(c.values()) or 1 for lg, c in words.items()}
        tails = {lg: Counter() for lg in langs}
        for lg, c in words.items():
            for w, n in c.items():
                tails[lg][w[-3:]] += min(n, 3)
        tail_total = {lg: sum(c.values()) or 1 for lg, c in tails.items()}
        for w in {w for c in words.values() for w in c}:
            self._add(w, self._row([words[lg][w] / total[lg] for lg in langs], 2e-5, 1.0))
        # unknown words share the rows of their script or of their ending, so the model never grows
        latin = np.array([-3.0 if lg in ("ja", "ru") else 0.0 for lg in langs])
        for t in sorted({t for c in tails.values() for t in c}):
            row = self._row([tails[lg][t] / tail_total[lg] for lg in langs], 1e-4, 0.5)
            self._add("\0" + t, np.minimum(row, latin) if latin.any() else row)
        self._add("\0", latin)
        for only in ("ja", "ru"):
            self._add("\0" + only + "\0", np.array([0.0 if lg == only else -6.0 for lg in langs]))
        self.table = np.array(self.rows)

    @staticmethod
    def _row(p: list[float], floor: float, trust: float) -> np.ndarray:
        x = np.log(np.array(p) + floor)
        return trust * np.clip(x - x.max(), -6, 0)

    def _add(self, word: str, row: np.ndarray) -> int:
        self.ids[word] = len(self.rows)
        self.rows.append(row)
        return self.ids[word]

    def id_of(self, word: str) -> int:
        got = self.ids.get(word)
        if got is not None:
            return got
        if JAPANESE.match(word):
            return self.ids["\0ja\0"]
        if CYRILLIC.match(word):
            return self.ids["\0ru\0"]
        return self.ids.get("\0" + word[-3:], self.ids["\0"])

    def matrix(self) -> np.ndarray:
        return self.table
