"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plansift.llm.sampling import first_by_hash, fold, portions, texts_of

BITS = 18
#: Bounds of the rows that a model is fitted on.
POSITIVE, UNLABELLED = 3_000, 9_000
REMEMBERED = 400_000
#: The same for a fit, which runs in the driver.
REMEMBERED_IN_FIT = 20_000
#: The class prior where there are fewer than FEW texts of a kind to estimate it from.
PRIOR, FEW = 0.1, 100
#: Features of a model.
CHOSEN = 256
EDGES = "\"'.,;:!?()[]{}<>«»„“”‘’¡¿…*#&$%|-_/\\=+~`^@"


def features(word: str) -> tuple[int, ...]:
    """Hashed features of a word: itself and its first four and five letters."""
    word = word.lower().strip(EDGES)
    if not word:
        return ()
    data = word.encode("utf-8", "replace")
    return tuple(zlib.crc32(x) & (1 << BITS) - 1 for x in (b"w" + data, b"4" + word[:4].encode("utf-8", "replace"), b"5" + word[:5].encode("utf-8", "replace")))


@dataclass
class Model:
    """Weights of the chosen features, by number, and a bias."""

    weights: dict[int, float]
    bias: float

    def chosen(self, word: str) -> tuple[int, ...]:
        return tuple(k for k in features(word) if k in self.weights)

    def score(self, text: str, known: dict[str, tuple[int, ...]]) -> float:
        """known: what chosen() gives for words, kept between texts."""
        words = set(text.split())
        for w in words.difference(known):
            known[w] = self.chosen(w)
        found = sorted(k for ks in filter(None, [known[w] for w in words]) for k in ks)
        g = self.bias + sum(self.weights[k] for k in found) / math.sqrt(max(1, len(words)))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, g))))


def _rows(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """The features of each text's distinct words, and one over the root of their number."""
    known: dict[str, tuple[int, ...]] = {}
    ids, scale = [], np.ones(len(texts))
    for n, text in enumerate(texts):
        words = set(text.split())
        if len(known) > REMEMBERED_IN_FIT:
            known.clear()
        for w in words.difference(known):
            known[w] = features(w)
        ids.append(np.array(sorted(k for w in words for k in known[w]), np.int32))
        scale[n] = 1 / math.sqrt(max(1, len(words)))
    return ids, scale


def chosen(p: list[np.ndarray], u: list[np.ndarray], most: int = CHOSEN, least: float = 2.5) -> np.ndarray:
    """The features whose document frequencies differ most between confirmed and unlabelled texts, by the two-sample z statistic."""

    def share(rows: list[np.ndarray]) -> np.ndarray:
        counts = np.zeros(1 << BITS, np.int32)
        for r in rows:  # one by one: all of them in an array take twice what the rows do
            counts[np.unique(r)] += 1
        return (counts + 0.5) / (len(rows) + 1)

    a, b = share(p), share(u)
    z = np.abs(a - b) / np.sqrt(a * (1 - a) / len(p) + b * (1 - b) / len(u))
    first = np.argsort(-z, kind="stable")[:most]
    return np.sort(first[z[first] >= least])


def risk_slopes(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """What a step follows: the slopes of the non-negative risk in the outputs for confirmed and unlabelled texts.

    Risk: prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]), l the logistic loss. Where the part that stands for negatives
    is below zero, the slopes are those of minus that part, so that a step down them brings it back up; the last value tells.
    """
    sp, su = (1 / (1 + np.exp(-np.clip(g, -30, 30))) for g in (gp, gu))
    if np.logaddexp(0, gu).mean() < prior * np.logaddexp(0, gp).mean():
        return prior * sp / len(gp), -su / len(gu), True
    return np.full(len(gp), -prior / len(gp)), su / len(gu), False


def prior_of(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.25) -> float:
    """The share of positives among unlabelled texts, from scores of both that no fit has seen.

    Above any threshold lie at least prior times as many of the unlabelled as of the positives; so the prior is at most the ratio of
    the two shares, and the smallest ratio over thresholds that `least` of the positives pass comes closest.
    """
    ordered = np.sort(positive)[::-1]
    n = np.arange(1, len(ordered) + 1)
    above = len(unlabelled) - np.searchsorted(np.sort(unlabelled), ordered, "left")
    ratio = ((above + 0.5) / (len(unlabelled) + 1)) / (n / len(ordered))
    return float(min(1.0, ratio[n >= least * len(ordered)].min()))


#: The features of some texts' words, and a scale for each text (see _rows).
Rows = tuple[list[np.ndarray], np.ndarray]


def estimated_prior(positive: Rows, unlabelled: Rows, seed: int = 0) -> float:
    """prior_of scores by models that tell positives from unlabelled texts, each fitted on one half and scoring the other.

    With fewer than FEW of either the estimate would be noise; it is PRIOR then.
    """
    if min(len(positive[0]), len(unlabelled[0])) < FEW:
        return PRIOR
    scores: tuple[list, list] = ([], [])
    for side in (0, 1):
        kept, w, bias = _fitted(*((ids[side::2], scale[side::2]) for ids, scale in (positive, unlabelled)), 0.5, steps=120, seed=seed, clamp=False)
        dense = np.zeros(1 << BITS)
        dense[kept] = w
        for out, (ids, scale) in zip(scores, (positive, unlabelled), strict=True):
            out += [bias + c * dense[x].sum() for x, c in zip(ids[1 - side :: 2], scale[1 - side :: 2], strict=True)]
    return prior_of(*map(np.array, scores))


def fit(positive: list[str], unlabelled: list[str], prior: float | None = None, steps: int = 420, seed: int = 0) -> Model:
    """A linear model by the non-negative risk of PU learning, logistic loss, stochastic gradient descent with momentum.

    Without a prior it is estimated from the same texts. Without positives or unlabelled texts the model is the prior alone.
    """
    p, u = _rows(positive), _rows(unlabelled)
    prior = estimated_prior(p, u, seed) if prior is None else prior
    if not positive or not unlabelled:
        base = min(max(prior if positive else 0.0, 1e-6), 1 - 1e-6)
        return Model({}, math.log(base / (1 - base)))
    kept, w, bias = _fitted(p, u, prior, steps, seed)
    return Model({int(k): float(x) for k, x in zip(kept, w, strict=True)}, bias)


def _fitted(positive: Rows, unlabelled: Rows, prior: float, steps: int, seed: int, clamp: bool = True, rate: float = 20.0, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray, float]:
    """The chosen features, their weights and the bias. Without clamp, unlabelled texts simply stand for negatives."""
    rng = np.random.default_rng(seed)
    (p, p_scale), (u, u_scale) = positive, unlabelled
    kept = chosen(p, u)
    number = np.full(1 << BITS, -1)
    number[kept] = np.arange(len(kept))
    p, u = ([x[x >= 0] for x in map(number.__getitem__, rows)] for rows in (p, u))
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    w, bias, m = np.zeros(len(kept)), math.log(prior / (1 - prior)), np.zeros(len(kept))
    batches = max(1, min(len(p), len(u) // 256))
    for _ in range(-(-steps // batches)):
        for a, b in zip(np.array_split(rng.permutation(len(p)), batches), np.array_split(rng.permutation(len(u)), batches), strict=True):
            part = [p[k] for k in a] + [u[k] for k in b]
            ids, scale = np.concatenate(part), np.concatenate([p_scale[a], u_scale[b]])
            row = np.repeat(np.arange(len(part)), [len(x) for x in part])
            g = np.bincount(row, w[ids], len(part)) * scale + bias
            if clamp:
                d = np.concatenate(risk_slopes(g[: len(a)], g[len(a) :], prior)[:2])
            else:
                s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
                d = np.concatenate([(s[: len(a)] - 1) / len(a), s[len(a) :] / len(b)]) / 2
            m = 0.9 * m + np.bincount(ids, (d * scale)[row], len(kept)) + decay * w
            w -= rate * m
            bias -= 0.5 * d.sum()
    return kept, w, float(bias)


def learned(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> Model:
    """A model from the labels outside the held-out fold.

    Confirmed: at most POSITIVE rows labelled toxic; unlabelled: at most UNLABELLED documents whatever their labels; both the
    first by a hash of the id, texts of at most FIT_CHARS. Labels of 0 are never read: the class prior comes from the same texts.
    """
    usable = labels.select("doc_id", "toxic").where((fold("doc_id", folds) != held_out) & (F.col("toxic") == 1))
    confirmed = first_by_hash(usable.select("doc_id").distinct(), "doc_id", POSITIVE, 4)
    others = first_by_hash(docs.select("doc_id").where(fold("doc_id", folds) != held_out), "doc_id", UNLABELLED, 5)
    keys = confirmed.select("doc_id", F.lit(1).alias("_confirmed")).unionByName(others.select("doc_id", F.lit(0).alias("_confirmed")))
    rows = texts_of(docs, keys)
    return fit([r[-1] for r in rows if r[1]], [r[-1] for r in rows if not r[1]])


def with_score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs plus the score (0 to 1) of every row's whole text; a null text counts as empty, which scores by the bias alone."""
    at = docs.columns.index(text)
    shape = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for part, texts in portions(batches, at):
            if len(known) > REMEMBERED:
                known.clear()
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([model.score(t, known) for t in texts], pa.float64())], shape.fieldNames())

    return docs.mapInArrow(run, shape)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row."""
    return with_score(docs.select(key, F.col(text).alias("_text")), model, "_text").select(key, "score")
