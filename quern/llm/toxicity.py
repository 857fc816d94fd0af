"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches in folded text.

Folding takes look-alike letters, digits and signs to the letters they stand for. Hits count with their
weight at word boundaries only, hits inside an exception phrase don't. The lexicon begins with common insults, which match
in any spelling that folds to theirs, and learns words and beginnings of words from labelled rows. Accents tell
words of other languages apart, so these match as they are written, or with some letters replaced by digits, signs or letters
of another script that look alike; accents stay apart there, and so do two plain letters. The sum, against the
text's length, is turned into a score by a logistic curve fitted on labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fold_remainder, labelled_sample, materialise, plain, text_slices, texts_of

# Common English insults, from which the lexicon starts.
SEED_WORDS = ("idiot", "moron", "stupid", "loser", "trash", "scum", "clown", "pathetic", "worthless", "disgusting", "dumb", "fool", "jerk", "filth", "vermin", "imbecile", "bastard", "garbage")
# Harmless phrases that hold a word of the lexicon.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "garbage collection", "garbage collector", "dumb waiter", "dumb terminal", "dumb bell", "fool proof", "sore loser", "weight loser", "jerk chicken", "stupid simple")
# Look-alikes of Latin letters among Cyrillic and Greek ones, digits and signs.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ӏ": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i",
}  # fmt: skip  i, l, 1, ! and | are written for each other and fold to one letter


def _folds() -> dict[int, str]:
    table = {ord(c): to for c, to in LOOKALIKES.items()}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        base = unicodedata.normalize("NFKD", chr(code)).lower()[:1]
        if base.isascii() and base.isalnum():
            table[code] = LOOKALIKES.get(base, base)
    return table


_FOLD = _folds()
_ALIKE = {code: to for code, to in _FOLD.items() if chr(code) in LOOKALIKES or code >= 0xFF01}  # accents stay
_INVISIBLE = re.compile("[\xad\u200b-\u200d\u2060\ufeff]")
_WORD = re.compile(r"\w{3,24}")


def lowered(text: str) -> str:
    """Lower case without invisible characters."""
    return _INVISIBLE.sub("", text.lower())


def fold(text: str) -> str:
    """lowered() with look-alikes, digits and signs as the letters they stand for, character by character."""
    return lowered(text).translate(_FOLD)


def disguised(found: str, word: str) -> bool:
    """Whether one is the other with some, not all, of its letters replaced by look-alikes.

    Plain letters that differ (l and i), and letters that differ by an accent, aren't replaced. If all differ, it's
    a word of another script.
    """
    if found.translate(_ALIKE) != word.translate(_ALIKE):
        return False
    odd = [(a, b) for a, b in zip(found, word) if a != b]
    return 0 < len(odd) < len(word) and not any(a.isascii() and a.isalpha() and b.isascii() and b.isalpha() for a, b in odd)


@dataclass
class Lexicon:
    """Weights by word in any folded spelling, and by word as written or disguised or, with a * behind it, by the beginning of longer words; exception phrases; the curve from density to score."""

    weights: dict[str, float]
    written: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-2.2, 4.0, 1.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        """Folded patterns, each with its length and what it stands for: (as written or None, begins longer words, weight or None)."""
        if self._automaton is None:
            import ahocorasick

            entries: dict[str, list] = {}
            for word, w in self.weights.items():
                entries.setdefault(fold(word), []).append((None, False, w))
            for word, w in self.written.items():
                bare = word.rstrip("*")
                entries.setdefault(fold(bare), []).append((bare, bare != word, w))
            for phrase in self.exceptions:
                entries.setdefault(fold(phrase), []).append((None, False, None))
            self._automaton = ahocorasick.Automaton()
            for pattern, meant in entries.items():
                self._automaton.add_word(pattern, (len(pattern), meant))
            self._automaton.make_automaton()
        return self._automaton

    def hits(self, text: str) -> tuple[float, int]:
        """(sum of the weights, number of words hit) of a whole text; of entries that begin at one place the heaviest counts."""
        if not (self.weights or self.written or self.exceptions):
            return 0.0, 0
        bare = lowered(text)
        best: dict[int, tuple[float, int]] = {}
        free: list[tuple[int, int]] = []
        for stop, (size, meant) in self.automaton().iter(bare.translate(_FOLD)):
            start, end = stop - size + 1, stop + 1
            if start and bare[start - 1].isalpha():
                continue
            goes_on = end < len(bare) and bare[end].isalpha()
            for word, begins, w in meant:
                if goes_on != begins or (word is not None and bare[start:end] != word and not disguised(bare[start:end], word)):
                    continue
                if w is None:
                    free.append((start, end))
                elif w > best.get(start, (0.0, 0))[0]:
                    best[start] = w, end
        found = [w for start, (w, end) in best.items() if not any(a <= start and end <= b for a, b in free)]
        return float(sum(found)), len(found)

    def features(self, text: str) -> tuple[float, float]:
        """The weight in all, and by the square root of the length in hundreds of characters; both damped."""
        total, _ = self.hits(text)
        return math.log1p(total), math.log1p(total / math.sqrt(1 + len(text) / 100))

    def score(self, text: str) -> float:
        a, b = self.features(text)
        c, u, v = self.curve
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, c + u * a + v * b))))


def word_forms(text: str) -> set[str]:
    """The words of a text as written, and the beginnings of 5 to 9 letters of longer ones, with a * behind them."""
    out: set[str] = set()
    for w in set(_WORD.findall(lowered(text))):
        if w.isalpha():
            out.add(w)
            out.update(w[:k] + "*" for k in range(5, min(9, len(w) - 1) + 1))
    return out


def telling(found: dict[str, tuple[int, float]], most: int) -> dict[str, float]:
    """Weights of at most `most` of the forms (toxic rows, odds).

    A beginning gives way to a longer form that has nine in ten of its toxic rows, and a longer form to a beginning
    whose odds are about as high.
    """
    prefixes = lambda w: [w[:k] + "*" for k in range(5, len(w.rstrip("*")))]
    weak = {p for w, (n, _) in found.items() for p in prefixes(w) if p in found and n >= 0.9 * found[p][0]}
    kept: dict[str, float] = {}
    for w in sorted(found.keys() - weak, key=lambda w: (len(w), w)):
        if found[w][1] > max((kept[p] for p in prefixes(w) if p in kept), default=0.0) + 1:
            kept[w] = found[w][1]
    return {w: min(2.0, kept[w] / 4) for w in sorted(kept, key=lambda w: (-found[w][0] * kept[w], w))[:most]}


def fit_lexicon(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_words: int = 1_000, max_forms: int = 10_000, min_share: float = 0.01, max_rows: int = 20_000) -> Lexicon:
    """Lexicon weights and curve from labelled rows.

    Words weigh by the smoothed log odds of a word among toxic rows against the others. Learned forms need
    at least min_share of the toxic rows and clear odds. Documented bounds: at most max_words are learned, out of the max_forms of the highest
    odds, from at most max_rows labelled documents.
    """
    rows = labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, max_rows=max_rows)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in text_slices(batch):
                clean, toxic = Counter(), Counter()
                for label, text in zip(part.column(0).to_pylist(), texts_of(part)):
                    (toxic if label else clean).update(word_forms(text))
                forms = list(clean.keys() | toxic.keys())
                yield pa.RecordBatch.from_arrays([pa.array(forms), *[pa.array([c[w] for w in forms], pa.int64()) for c in (clean, toxic)]], ["word", "clean", "toxic"])

    by = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n_clean, n_toxic = by.get(0, 0), by.get(1, 0)
    weights = dict.fromkeys(SEED_WORDS, 1.0)
    if not (n_clean and n_toxic):
        return Lexicon(weights)
    words = rows.mapInArrow(counted, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log(((F.col("toxic") + 0.1) / (n_toxic + 1)) / ((F.col("clean") + 0.1) / (n_clean + 1)))
    rated = words.withColumn("odds", odds)
    clear = (F.col("toxic") >= max(5, min_share * n_toxic)) & (F.col("odds") > 3.0)
    harmless = F.col("word").isin(sorted(weights)) & (F.col("odds") < 0.5) & (F.col("clean") + F.col("toxic") >= 20)
    rated = materialise(rated.where(clear | harmless))
    found = {r["word"]: (r["toxic"], r["odds"]) for r in rated.where(clear).orderBy(F.desc("odds"), F.desc("toxic"), "word").limit(max_forms).collect()}
    for r in rated.where(harmless).collect():
        weights.pop(r["word"])  # shown to be harmless here
    discard(rated)
    written = telling(found, max_words)
    weights.update({w: written.pop(w) for w in sorted(written.keys() & weights.keys())})  # insults keep any spelling
    lexicon = Lexicon(weights, written)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in text_slices(batch):
                made = [lexicon.features(t) for t in texts_of(part)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m[0] for m in made]), pa.array([m[1] for m in made])], ["label", "a", "b"])

    data = np.array(rows.mapInArrow(measured, "label int, a double, b double").collect(), float).reshape(-1, 3)  # max_rows at most
    x, y, beta = np.column_stack([np.ones(len(data)), data[:, 1:]]), data[:, 0], np.zeros(3)
    for _ in range(50):  # ridge-damped Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (y - p) - 0.1 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    lexicon.curve = tuple(float(b) for b in beta)
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, weight, n_hits): one row per input row; score from 0 to 1, of the whole text.

    Null texts count as empty and score as a text without hits; null ids stay null; repeated rows each
    return a row; an empty table gives an empty result; other columns are ignored.
    """
    source = plain(docs, id_col, text_col).toDF("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most max_words and the insults

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in text_slices(batch):
                texts = texts_of(part)
                hits = [shared.value.hits(t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shared.value.score(t) if h[1] else shared.value.score("") for t, h in zip(texts, hits)], pa.float64()), pa.array([h[0] for h in hits], pa.float64()), pa.array([h[1] for h in hits], pa.int64())], ["doc_id", "score", "weight", "n_hits"])

    return source.mapInArrow(scored, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double, weight double, n_hits long")


def toxicity_report(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", threshold: float = 0.5, **options) -> DataFrame:
    """Fit on the rows outside the held-out fold, score all rows: the form of query op10."""
    held_out = F.coalesce(fold_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    training = labels.where(F.col(id_col).isNotNull() & (fold_remainder(F.col(id_col), 5) != 0))
    lexicon = fit_lexicon(docs, training, id_col=id_col, **options)
    scored = score_toxicity(docs, lexicon, id_col=id_col)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits")
