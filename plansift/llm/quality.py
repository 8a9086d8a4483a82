"""Quality by attention-based multiple-instance learning: passages, gated attention, one score per document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.llm.sampling import first_by_hash, fold, portions, texts_of

#: Words of a passage.
PASSAGE = 64
#: Bound of the rows that a model is fitted on.
LABELLED = 6_000
#: Bytes of a longer text that are looked at together (some 45 times that in memory), cut between passages.
SLICE = 1 << 20
HIDDEN = 24

KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256), "stop": b".,;:", "shout": b"!?", "bar": b"|", "quote": b"\"'()[]{}<>", "symbol": b"#$%&*@^~_=+/\\`-"}
_kind = np.full(256, len(KINDS), np.uint8)
for _k, _bytes in enumerate(KINDS.values()):
    _kind[list(_bytes)] = _k
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_powers = np.cumprod(np.full(64, 0x9E3779B97F4A7C15 | 1, np.uint64))
FEATURES = len(KINDS) + 9


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage of PASSAGE words, and the number of passages of each text (at least one)."""
    rows, counts, small = [], [], []
    for t in texts:
        data = t.encode("utf-8", "replace")
        if len(data) <= SLICE:
            small.append(data)
            continue
        own = [_passages(small), *(_passages([part]) for part in _slices(data))]
        rows += [x for x, _ in own]
        counts += [*own[0][1].tolist(), sum(int(c[0]) for _, c in own[1:])]
        small = []
    x, c = _passages(small)
    return np.concatenate([*rows, x]), np.array([*counts, *c.tolist()], np.int64)


def _slices(data: bytes) -> Iterator[bytes]:
    """A text in parts of whole passages, of about SLICE bytes where no passage is longer."""
    at, size = 0, SLICE
    while at + size < len(data):
        blank = _space[np.frombuffer(data, np.uint8, size, at)]
        begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        whole = (len(begins) - 1) // PASSAGE * PASSAGE
        if whole <= 0:
            size *= 2
            continue
        yield data[at : at + int(begins[whole])]
        at, size = at + int(begins[whole]), SLICE
    yield data[at:]


def _passages(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = np.frombuffer(b" " + b" ".join(data) + b" ", np.uint8)
    starts_of = np.cumsum([1, *[len(d) + 1 for d in data]])[:-1] if data else np.zeros(0, np.int64)
    space = _space[joined]
    begins = np.flatnonzero(~space[1:] & space[:-1]) + 1
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    words = np.searchsorted(begins, [*starts_of.tolist(), len(joined)])
    per_text = np.diff(words)
    counts = np.maximum(1, -(-per_text // PASSAGE))
    x = np.zeros((int(counts.sum()), FEATURES))
    if not len(begins):
        return x, counts
    text_of = np.repeat(np.arange(len(data)), per_text)
    first_row = np.cumsum([0, *counts.tolist()])[:-1]
    row_of = first_row[text_of] + (np.arange(len(begins)) - words[:-1][text_of]) // PASSAGE
    rows, firsts, n = np.unique(row_of, return_index=True, return_counts=True)
    at = begins[firsts]
    length = ends - begins
    size = np.add.reduceat(length, firsts)
    kind = _kind[joined]
    for k in range(len(KINDS)):
        x[rows, k] = np.add.reduceat((kind == k).view(np.uint8), at, dtype=np.int64) / size
    inside = np.flatnonzero(~space)
    place = np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length)
    lowered = np.where(kind[inside] == 0, joined[inside] + 32, joined[inside]).astype(np.uint64)
    hashes = np.add.reduceat(lowered * _powers[np.minimum(place, 63)], np.cumsum(length) - length)
    hashes ^= hashes >> np.uint64(29)
    mixed = hashes * np.uint64(0xBF58476D1CE4E5B9) + row_of.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    order = np.lexsort((mixed, row_of))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (mixed[order][1:] != mixed[order][:-1]) | (row_of[order][1:] != row_of[order][:-1])
    x[:, -9] = np.bincount(row_of[order][fresh], minlength=len(x)) / np.maximum(1, np.bincount(row_of, minlength=len(x)))
    same = np.zeros(len(begins))
    same[1:] = (hashes[1:] == hashes[:-1]) & (row_of[1:] == row_of[:-1])
    last = kind[ends - 1]
    x[rows, -8] = np.add.reduceat(same, firsts) / n
    x[rows, -7] = size / n / 10
    x[rows, -6] = np.add.reduceat((kind[begins] == 0) * 1.0, firsts) / n
    x[rows, -5] = np.add.reduceat((last == 4) * 1.0, firsts) / n
    x[rows, -4] = np.add.reduceat((last >= 5) * 1.0, firsts) / n
    x[rows, -3] = np.log1p(n) / 4
    x[rows, -2] = np.add.reduceat((length > 20) * 1.0, firsts) / n
    # line feeds count to the passage before them, but none to a passage of the text before
    feeds = np.flatnonzero(joined == 10)
    before = np.searchsorted(begins, feeds, "right") - 1
    own = (before >= 0) & (text_of[np.maximum(before, 0)] == np.searchsorted(starts_of, feeds, "right") - 1)
    x[:, -1] = np.bincount(row_of[before[own]], minlength=len(x)) / np.maximum(1, np.bincount(row_of, minlength=len(x)))
    return x, counts


@dataclass
class Model:
    """Scales of the features, then the passage encoder, both halves of the gate, its weights and the final layer."""

    mean: np.ndarray
    scale: np.ndarray
    parts: list[np.ndarray]

    def forward(self, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, dict]:
        ew, eb, vw, vb, uw, ub, gate, last, bias = self.parts
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        at = np.cumsum(counts) - counts
        h = np.tanh(x @ ew + eb)
        v, u = np.tanh(h @ vw + vb), 1 / (1 + np.exp(-(h @ uw + ub)))
        e = (v * u) @ gate
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), counts))
        a = e / np.repeat(np.add.reduceat(e, at), counts)
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        return z @ last + bias[0], {"x": x, "at": at, "h": h, "v": v, "u": u, "a": a, "z": z}

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The documents' mean logistic loss and its gradient in each of the parts."""
        g, k = self.forward(x, counts)
        own = self.parts
        d = (1 / (1 + np.exp(-np.clip(g, -30, 30))) - y) / len(y)
        dz = np.repeat(d[:, None] * own[7], counts, axis=0)
        da = (dz * k["h"]).sum(axis=1)
        de = k["a"] * (da - np.repeat(np.add.reduceat(k["a"] * da, k["at"]), counts))
        dvu = de[:, None] * own[6]
        dv, du = dvu * k["u"] * (1 - k["v"] ** 2), dvu * k["v"] * k["u"] * (1 - k["u"])
        dh = k["a"][:, None] * dz + dv @ own[2].T + du @ own[4].T
        dx = dh * (1 - k["h"] ** 2)
        grads = [k["x"].T @ dx, dx.sum(axis=0), k["h"].T @ dv, dv.sum(axis=0), k["h"].T @ du, du.sum(axis=0), (k["v"] * k["u"]).T @ de, k["z"].T @ d, np.array([d.sum()])]
        return float((np.logaddexp(0, g) - y * g).mean()), grads

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(*passages(texts))[0], -30, 30)))


def fit(texts: list[str], labels: list[int], epochs: int = 40, rate: float = 0.01, decay: float = 1e-4, seed: int = 0) -> Model:
    """Gated attention over passages, fitted with Adam on the documents' logistic loss. Without texts it scores 0.5."""
    rng = np.random.default_rng(seed)
    shapes = [(FEATURES, HIDDEN), (HIDDEN,), (HIDDEN, HIDDEN), (HIDDEN,), (HIDDEN, HIDDEN), (HIDDEN,), (HIDDEN,), (HIDDEN,), (1,)]
    parts = [rng.normal(0, s[0] ** -0.5, s) if len(s) == 2 else np.zeros(s) for s in shapes]
    parts[6], parts[7] = rng.normal(0, 0.2, HIDDEN), rng.normal(0, 0.2, HIDDEN)
    if not texts:
        parts[7][:] = 0
        return Model(np.zeros(FEATURES), np.ones(FEATURES), parts)
    parts_of = [passages(texts[at : at + 200]) for at in range(0, len(texts), 200)]
    x, counts = np.concatenate([p for p, _ in parts_of]), np.concatenate([c for _, c in parts_of])
    model = Model(x.mean(axis=0), x.std(axis=0) + 0.02, parts)
    y, at = np.array(labels, float), np.cumsum(counts) - counts
    share = min(0.99, max(0.01, y.mean()))
    parts[8][0] = np.log(share / (1 - share))
    m, s, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for _ in range(epochs):
        for docs in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 128)):
            own = counts[docs]
            rows = np.repeat(at[docs] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            _, grads = model.gradients(x[rows], own, y[docs])
            step += 1
            for i, grad in enumerate(grads):
                grad = grad + decay * parts[i]
                m[i] += 0.1 * (grad - m[i])
                s[i] += 0.001 * (grad**2 - s[i])
                parts[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
    return model


def learned(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> Model:
    """A model from the labels outside the held-out fold: at most LABELLED rows, the first by a hash of the id, texts of at most FIT_CHARS."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("_quality")).where((fold("doc_id", folds) != held_out) & F.col("quality").isin(0, 1))
    rows = texts_of(docs, first_by_hash(usable.dropDuplicates(["doc_id"]), "doc_id", LABELLED, 10))
    return fit([r[-1] for r in rows], [r[1] for r in rows])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1) of every row's whole text; a null or empty text is one passage without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in portions(batches, 1, chars=SLICE):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(texts), pa.float64())], [key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")
