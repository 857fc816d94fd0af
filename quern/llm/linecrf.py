"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are measured on it and on its neighbours; the chain adds
weights for going from one state to the other. Forward-backward gives each line's probability of being
good, and a document's quality is their mean, weighted by the lines' lengths, through a logistic curve.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_remainder, labelled_sample, plain, text_slices, texts_of

_SYMBOLS = re.compile(r"[^\w\s.,;:!?'\"()\-]")
_DIGITS = re.compile(r"\d")
_BASE = 11
#: Features of a line, of the line before and of the line after, and a constant.
WIDTH = 3 * _BASE + 1


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features by line, length by line) of a whole text; a text without lines is one empty line."""
    lines = text.split("\n")
    own = np.zeros((len(lines) + 2, _BASE))
    size = np.empty(len(lines))
    seen: set[str] = set()
    for i, line in enumerate(lines, 1):
        words, n = line.split(), len(line)
        size[i - 1] = n + 1
        if not words:
            own[i, 0] = 1.0
            continue
        k, distinct = len(words), len(set(words))
        symbols = len(_SYMBOLS.findall(line))
        own[i] = (
            0.0,
            min(1.0, np.log1p(n) / 8),
            min(1.0, 4 * symbols / n),
            min(1.0, 4 * len(_DIGITS.findall(line)) / n),
            min(1.0, 2 * words.count("|") / k),
            min(1.0, (n - k + 1) / k / 15),
            1.0 - distinct / k,
            max(0.0, 1.0 - 4 * distinct / k),
            float(line in seen),
            float(line.rstrip()[-1:] in ".!?:;"),
            float(k <= 3),
        )
        seen.add(line)
    rows = np.column_stack([own[1:-1], own[:-2], own[2:], np.ones(len(lines))])
    return rows, size


def _passes(unary: np.ndarray, counts: np.ndarray, trans: np.ndarray, chain_weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains side by side.

    unary: (lines, 2) log weights, chain after chain; counts: lines of each chain (one at least).
    Returns the marginals (lines, 2), the expected transitions (2, 2), where chain_weight is given, by
    chain weighted and summed, and the chains' log partitions.
    """
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    length = counts[order]
    longest = int(length[0]) if len(length) else 0
    live = np.searchsorted(-length, -np.arange(longest), side="left")  # chains with more than t lines
    forward, backward = np.empty_like(unary), np.zeros_like(unary)
    forward[first] = unary[first]
    for t in range(1, longest):
        at = first[: live[t]] + t
        before = forward[at - 1]
        forward[at] = unary[at] + np.logaddexp(before[:, :1] + trans[0], before[:, 1:] + trans[1])
    for t in range(longest - 2, -1, -1):
        at = first[: live[t + 1]] + t
        after = backward[at + 1] + unary[at + 1]
        backward[at] = np.logaddexp(trans[:, 0] + after[:, :1], trans[:, 1] + after[:, 1:])
    last = first + length - 1
    log_z = np.empty(len(counts))
    log_z[order] = np.logaddexp(forward[last, 0], forward[last, 1])
    z_of = np.repeat(log_z, counts)
    marginal = np.exp(forward + backward - z_of[:, None])
    if chain_weight is None:
        return marginal, np.zeros((2, 2)), log_z
    inner = np.ones(len(unary), bool)
    inner[last] = False
    i = np.flatnonzero(inner)
    pair = forward[i][:, :, None] + trans[None] + (unary[i + 1] + backward[i + 1])[:, None, :] - z_of[i][:, None, None]
    return marginal, (np.exp(pair) * np.repeat(chain_weight, counts)[i][:, None, None]).sum(axis=0), log_z


@dataclass
class LineModel:
    weights: np.ndarray
    trans: np.ndarray
    curve: tuple[float, float]

    def good(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Each line's probability of being good."""
        unary = np.column_stack([np.zeros(len(features)), features @ self.weights])
        return _passes(unary, counts, self.trans)[0][:, 1]

    def scores(self, features: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(share of good lines by length, score) of each document."""
        share = _weighted(self.good(features, counts), sizes, counts)
        a, b = self.curve
        return share, 1 / (1 + np.exp(-np.clip(a + b * _logit(share), -40, 40)))


def _weighted(good: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    start = np.cumsum(counts) - counts
    return np.add.reduceat(good * sizes, start) / np.add.reduceat(sizes, start)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (weight * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _chains(counts: np.ndarray, most: int = 1_000) -> tuple[np.ndarray, np.ndarray]:
    """(lines of each chain, chains of each document): documents cut into chains of at most `most` lines."""
    parts = -(-counts // most)
    chains = np.full(int(parts.sum()), most)
    chains[np.cumsum(parts) - 1] = counts - (parts - 1) * most
    return chains, parts


def _fit(features: np.ndarray, sizes: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int) -> LineModel:
    """Conditional likelihood of the documents' labels as the labels of all their lines, by Adam steps from a line-wise logistic fit.

    Every document counts alike: the gradient of its log likelihood is divided by its number of lines.
    """
    doc_of = np.repeat(np.arange(len(counts)), counts)
    chains, parts = _chains(counts)  # of a very long document the fit has several chains
    y = labels[doc_of]
    weight = sizes / np.bincount(doc_of, sizes)[doc_of]
    start = _newton(features, y, weight, 1.0)
    theta = np.concatenate([start, [0.5, 0.0, 0.0, 0.5]])
    per_doc = 1.0 / counts
    seen_trans = np.zeros((2, 2))
    for s in (0, 1):
        seen_trans[s, s] = (per_doc * (counts - parts))[labels == s].sum()
    m, v = np.zeros(len(theta)), np.zeros(len(theta))
    line_weight = per_doc[doc_of]
    for k in range(1, steps + 1):
        trans = theta[-4:].reshape(2, 2)
        unary = np.column_stack([np.zeros(len(y)), features @ theta[:-4]])
        marginal, pairs, _ = _passes(unary, chains, trans, np.repeat(per_doc, parts))
        grad = np.concatenate([features.T @ (line_weight * (y - marginal[:, 1])), (seen_trans - pairs).ravel()]) / len(counts) - 1e-3 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    model = LineModel(theta[:-4].copy(), theta[-4:].reshape(2, 2).copy(), (0.0, 1.0))
    share = _weighted(model.good(features, counts), sizes, counts)
    a, b = _newton(np.column_stack([np.ones(len(share)), _logit(share)]), labels, np.ones(len(share)), 0.5)
    model.curve = (float(a), float(max(b, 1e-6)))
    return model


def fit_line_model(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 5_000, steps: int = 60) -> LineModel:
    """Fit on at most about max_rows labelled documents (a documented bound), drawn by a hash of their ids."""
    rows = labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, max_rows=max_rows)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in text_slices(batch):
                made = [line_features(t) for t in texts_of(part)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f.astype(np.float32).tobytes() for f, _ in made]), pa.array([s.astype(np.float32).tobytes() for _, s in made])], ["label", "features", "sizes"])

    found = rows.mapInArrow(measured, "label int, features binary, sizes binary").toArrow()
    kept = [(y, np.frombuffer(f, np.float32), np.frombuffer(s, np.float32)) for y, f, s in zip(*[found.column(c).to_pylist() for c in ("label", "features", "sizes")])]
    y = np.array([k[0] for k in kept], float)
    if len(set(y)) < 2:  # nothing to tell apart: every text scores the share of good labels
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98))
        return LineModel(np.zeros(WIDTH), np.zeros((2, 2)), (float(np.log(p / (1 - p))), 1.0))
    features = np.concatenate([k[1] for k in kept]).reshape(-1, WIDTH).astype(float)
    sizes = np.concatenate([k[2] for k in kept]).astype(float)
    return _fit(features, sizes, np.array([len(k[2]) for k in kept]), y, steps)


def score_lines(docs: DataFrame, model: LineModel, *, id_col: str = "doc_id", text_col: str = "text", keep_lines: bool = False) -> DataFrame:
    """(doc_id, score, good_share, n_lines[, lines]): one row per input row, of the whole text.

    lines: each line's probability of being good, in order. Null texts count as empty, which is one empty
    line; null ids stay null; repeated rows each return a row; an empty table gives an empty result.
    """
    source = plain(docs, id_col, text_col).toDF("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few dozen numbers

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in text_slices(batch):
                made = [line_features(t) for t in texts_of(part)]
                features, sizes = np.concatenate([f for f, _ in made]), np.concatenate([s for _, s in made])
                counts = np.array([len(s) for _, s in made])
                share, score = shared.value.scores(features, sizes, counts)
                out = [part.column(0), pa.array(score), pa.array(share), pa.array(counts.astype(np.int64))]
                if keep_lines:
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(shared.value.good(features, counts))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "score", "good_share", "n_lines", "lines"][: len(out)])

    return source.mapInArrow(scored, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double, good_share double, n_lines long" + ", lines array<double>" * keep_lines)


def quality_report(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", threshold: float = 0.7, **options) -> DataFrame:
    """Fit on labels outside the held-out fold, score all rows: the form of query op8."""
    training = labels.where(F.col(id_col).isNotNull() & (fold_remainder(F.col(id_col), 4) != 2))
    model = fit_line_model(docs, training, id_col=id_col, **options)
    held_out = F.coalesce(fold_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return score_lines(docs, model, id_col=id_col).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_lines")


def drop_low_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """`docs` without the rows whose score is below the threshold; all columns of the others stay as they are.

    Rows are judged one by one, also those that repeat an id or have none. Null texts score as the empty one. Without
    labels of both kinds every row has the same score. An empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_line_model(docs, labels, id_col=id_col, text_col=text_col, **options))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in text_slices(batch, name=text_col):
                made = [line_features(t) for t in texts_of(part, text_col)]
                score = model.value.scores(np.concatenate([f for f, _ in made]), np.concatenate([s for _, s in made]), np.array([len(s) for _, s in made]))[1]
                yield part.filter(pa.array(score >= threshold))

    return docs.mapInArrow(kept, docs.schema)
