"""Text likelihoods by language: naive Bayes over words, character trigrams for words not seen, trained here on a bounded labelled sample."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np

from lectern.llm.chars import canonical

LANGS = ["en", "ar", "de", "fr", "es", "pt"]
# How a label may name a language, besides its code with a region.
NAMES = {
    "en": "en eng english englisch anglais inglés inglês ingles الإنجليزية الانجليزية",
    "ar": "ar ara arb arabic arabisch arabe árabe العربية عربي",
    "de": "de deu ger german deutsch allemand alemán alemão الألمانية",
    "fr": "fr fra fre french français francais französisch francés francês الفرنسية",
    "es": "es spa spanish español espanol castilian castellano spanisch espagnol espanhol الإسبانية",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués البرتغالية",
}
LABELS = {w: k for k, ws in NAMES.items() for w in ws.split()}
_TOKEN = re.compile(r"[^\W\d_]+|\n\n")
_GRAM_LIMIT, _WORD_LIMIT, _MOST_WORDS = 1.0, 5.0, 400_000


def label_language(label: str | None) -> str | None:
    """The language that a label names in any form: code, code with region, name; None if it names none of these languages."""
    if not label:
        return None
    w = label.strip().lower()
    return LABELS.get(w) or LABELS.get(re.split(r"[-_ (]", w)[0])


def _grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


class LanguageModel:
    """Log-likelihoods of the languages for a word, relative to its best language (0 for that, negative for the others), and whether it votes.

    A word votes for its best language if it is at least e**2 times as likely in it as in any other. Names, skills and titles that occur in texts of all languages hardly move the sum and don't vote.
    """

    def __init__(self, tables: dict[str, np.ndarray], grams: dict[str, np.ndarray]) -> None:
        self.tables, self.grams = tables, grams
        self.index: dict[str, int] = {"\n\n": 0}
        n = len(LANGS)
        self._rows = np.zeros((1024, 2 * n), np.float32)

    def _row(self, word: str) -> int:
        n = len(LANGS)
        v = self.tables.get(word)
        if v is None:
            v = sum((g for x in _grams(word) if (g := self.grams.get(x)) is not None), np.zeros(n, np.float32)) if len(word) > 1 else np.zeros(n, np.float32)
            v = np.clip((v - v.max()) * 0.3, -_GRAM_LIMIT, 0)
        if len(self.index) >= _MOST_WORDS:  # the memory for words is bounded; the rest is looked up again
            self.index = {"\n\n": 0}
        k = len(self.index)
        if k >= len(self._rows):
            self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
        v = np.clip(v - v.max(), -_WORD_LIMIT, 0)
        self._rows[k, :n] = v
        self._rows[k, n:] = 0
        if np.sort(v)[-2] <= -2:
            self._rows[k, n + int(v.argmax())] = 1
        self.index[word] = k
        return k

    def paragraphs(self, text: str) -> np.ndarray:
        """For each paragraph (split at blank lines) the sums of log-likelihoods and of votes: an array of paragraphs x 2 x languages."""
        tokens = _TOKEN.findall(text.lower())
        if len(self.index) + len(tokens) >= _MOST_WORDS:
            self.index = {"\n\n": 0}
        get, row = self.index.get, self._row
        at = np.fromiter((k if (k := get(w)) is not None else row(w) for w in tokens), np.int64, len(tokens))
        breaks = np.concatenate([[0], np.nonzero(at == 0)[0] + 1])
        # a closing row of zeros, so that an empty last paragraph has a place; a break's own row is zeros too
        rows = self._rows[np.concatenate([at, [0]])]
        return np.add.reduceat(rows, breaks, axis=0).reshape(len(breaks), 2, len(LANGS))


def _fit(groups: list[tuple[list[str], int]]) -> LanguageModel:
    counts = [Counter() for _ in LANGS]
    for ws, k in groups:
        counts[k].update(ws)
    totals = np.array([max(1, sum(c.values())) for c in counts], np.float64)
    floor = 2 / max(1, min(t for t in totals if t > 1)) if (totals > 1).any() else 1.0  # the same for all languages, so that a rare word favours none
    grams, tables = [Counter() for _ in LANGS], {}
    for w in set().union(*counts):
        c = np.array([x[w] for x in counts], np.float64)
        for g in _grams(w):
            for k in np.nonzero(c)[0]:
                grams[k][g] += 1
        if c.sum() >= 3:
            p = np.log(c / totals + floor)
            tables[w] = (p - p.max()).astype(np.float32)
    gram_total = np.array([max(1, sum(c.values())) for c in grams], np.float64)
    low = 2 / max(1, min(gram_total))
    scored = {g: np.log(np.array([c[g] for c in grams]) / gram_total + low).astype(np.float32) for g in set().union(*grams)}
    return LanguageModel(tables, {g: v - v.mean() for g, v in scored.items()})


def train(rows: Iterable[tuple[str, str | None]], rounds: int = 3) -> LanguageModel:
    """A model from labelled texts, of which labels may be wrong and paragraphs in another language.

    The first round believes the labels; each later round gives every paragraph the language that the last model finds in it, so that wrong labels and
    foreign paragraphs move to where their words belong.
    """
    found: list[tuple[list[str], int]] = []
    for text, label in rows:
        if (lang := label_language(label)) and text:
            found += [(ws, LANGS.index(lang)) for p in canonical(text).split("\n\n") if (ws := _TOKEN.findall(p.lower()))]
    model = _fit(found)
    for _ in range(rounds - 1):
        moved = []
        for ws, k in found:
            votes = model.paragraphs(" ".join(ws))[0, 1]
            best = int(votes.argmax())
            moved.append((ws, best if votes[best] >= 5 and votes[best] > 3 * votes[k] else k))  # lists of names and skills stay where their label is
        model = _fit(moved)
    return model
