"""Document quality by attention over passages (multiple-instance learning).

A document is a bag of passages of ``PASSAGE`` words.  Each is encoded by shares of character classes, of word shapes, of distinct and of repeated
words.  A learned layer maps the codes to ``h``; gated attention ``softmax(w . (tanh(V h) * sigmoid(U h)))`` weighs the passages,
learned from the labels of whole documents; the weighted mean of ``h`` is scored by a logistic layer.

Cases: null, empty and blank texts are one passage of zeros and get that bag's score.  A document labelled twice counts once with
its larger label.  Without labels of both classes every score is the share of label 1 (0 without any).  Repeated rows are scored each.
Long texts are encoded whole, passage by passage.  Other columns are kept by ``score``, but ``score`` and ``predicted`` are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled, materialize, small_batches

PASSAGE = 48
#: Classes of bytes: space, lower, upper, digit, symbol, mark, other ASCII, beyond ASCII.
_CLASS = np.full(256, 6, np.int64)
for _i, _chars in enumerate((b" \t\n\v\f\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b"#*$%&|<>", b"!?")):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 7
_RANDOM = np.random.default_rng(11).integers(1, 1 << 62, 256, dtype=np.uint64)
N_CLASSES = 8
N_FEATURES = N_CLASSES + N_CLASSES * N_CLASSES + 4
_CHUNK = 1 << 18


def _encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the passages of some texts, and the text of each."""
    raw = [b" " + (t or "").encode("utf-8", "surrogatepass") + b" " for t in texts]
    b = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    kind = _CLASS[b]
    edge = np.diff((kind != 0).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    text = np.searchsorted(ends, start, "right")
    place = np.arange(len(start)) - np.searchsorted(text, text, "left")
    new = (place % PASSAGE == 0)
    passage = np.cumsum(new) - 1
    n = int(new.sum())
    empty = np.setdiff1d(np.arange(len(texts)), text)
    of = np.concatenate([text[new], empty])
    x = np.zeros((n + len(empty), N_FEATURES))
    if n:
        words = np.bincount(passage, minlength=n).astype(float)
        size = stop - start
        inside = np.repeat(passage, size)
        at = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        chars = np.bincount(inside, minlength=n).astype(float)
        x[:n, :N_CLASSES] = np.bincount(inside * N_CLASSES + kind[at], minlength=n * N_CLASSES).reshape(n, -1) / chars[:, None]
        shape = kind[start] * N_CLASSES + kind[stop - 1]
        x[:n, N_CLASSES:-4] = np.bincount(passage * N_CLASSES**2 + shape, minlength=n * N_CLASSES**2).reshape(n, -1) / words[:, None]
        spot = (at - np.repeat(start, size) + 1).astype(np.uint64)
        h = np.add.reduceat(_RANDOM[b[at]] * (spot * spot * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)), np.cumsum(size) - size)
        order = np.lexsort((h, passage))
        first = np.ones(len(h), bool)
        first[1:] = (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1])
        again = np.zeros(len(h))
        again[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
        x[:n, -4] = np.bincount(passage[order], weights=first, minlength=n) / words
        x[:n, -3] = np.bincount(passage, weights=again, minlength=n) / words
        x[:n, -2] = chars / words / 10
        x[:n, -1] = words / PASSAGE
    order = np.argsort(of, kind="stable")
    return x[order].astype(np.float32), of[order]


def bags(texts: list[str]):
    """(first text, codes, text of each passage counted from there) for runs of texts of about a megabyte."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= _CHUNK or i == len(texts) - 1:
            yield first, *_encode(texts[first : i + 1])
            first, size = i + 1, 0


def _softmax_in(bag: np.ndarray, n: int, e: np.ndarray) -> np.ndarray:
    most = np.full(n, -np.inf)
    np.maximum.at(most, bag, e)
    p = np.exp(e - most[bag])
    return p / np.bincount(bag, weights=p, minlength=n)[bag]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class AttentionModel:
    prior: float = 0.0
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    w: dict[str, np.ndarray] = field(default_factory=dict)

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> dict[str, np.ndarray]:
        w, out = self.w, {}
        out["x"] = (x - self.centre) / self.scale
        out["h"] = np.tanh(out["x"] @ w["W"] + w["b"])
        out["t"], out["g"] = np.tanh(out["h"] @ w["V"]), _sigmoid(out["h"] @ w["U"])
        out["a"] = _softmax_in(bag, n, (out["t"] * out["g"]) @ w["w"])
        z = np.zeros((n, out["h"].shape[1]))
        np.add.at(z, bag, out["a"][:, None] * out["h"])
        out["z"] = z
        out["p"] = _sigmoid(z @ w["c"] + w["d"][0])
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.w:
            return np.full(len(texts), self.prior)
        out = np.zeros(len(texts))
        for first, x, bag in bags(texts):
            n = int(bag.max()) + 1
            out[first : first + n] = self.forward(x, bag, n)["p"]
        return out

    def gradients(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        w, n = self.w, len(y)
        o = self.forward(x, bag, n)
        dp = (o["p"] - y) / n
        dz = dp[:, None] * w["c"][None, :]
        per = dz[bag]
        da = (per * o["h"]).sum(1)
        dh = o["a"][:, None] * per
        de = o["a"] * (da - np.bincount(bag, weights=o["a"] * da, minlength=n)[bag])
        dt, dg = de[:, None] * w["w"] * o["g"] * (1 - o["t"] ** 2), de[:, None] * w["w"] * o["t"] * o["g"] * (1 - o["g"])
        dh += dt @ w["V"].T + dg @ w["U"].T
        du = dh * (1 - o["h"] ** 2)
        g = {"c": o["z"].T @ dp, "d": np.array([dp.sum()]), "w": (o["t"] * o["g"]).T @ de, "V": o["h"].T @ dt, "U": o["h"].T @ dg, "W": o["x"].T @ du, "b": du.sum(0)}
        return {k: v + decay * w[k] for k, v in g.items()}


def fit(x: np.ndarray, bag: np.ndarray, y: np.ndarray, hidden: int = 16, gate: int = 8, epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> AttentionModel:
    """Adam on batches of documents; ``bag`` ascends."""
    r = np.random.default_rng(seed)
    m = AttentionModel(float(y.mean()) if len(y) else 0.0)
    if not 0 < y.sum() < len(y):
        return m
    m.centre, m.scale = x.mean(0), x.std(0) + 0.05
    d = x.shape[1]
    m.w = {"W": r.normal(0, d**-0.5, (d, hidden)), "b": np.zeros(hidden), "V": r.normal(0, hidden**-0.5, (hidden, gate)), "U": r.normal(0, hidden**-0.5, (hidden, gate)), "w": r.normal(0, 0.3, gate), "c": r.normal(0, 0.3, hidden), "d": np.zeros(1)}
    first = np.searchsorted(bag, np.arange(len(y) + 1))
    mean, square, step = {k: 0.0 for k in m.w}, {k: 0.0 for k in m.w}, 0
    for _ in range(epochs):
        order = r.permutation(len(y))
        for at in range(0, len(y), batch):
            docs = order[at : at + batch]
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in docs])
            own = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
            step += 1
            for k, g in m.gradients(x[rows], own, y[docs], decay).items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                m.w[k] = m.w[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return m


def held_out(doc_id):
    return fold(doc_id, 5) == 0


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", bound: int = 1500, passages: int = 256) -> AttentionModel:
    """Fit on about ``bound`` labelled documents of each class at most, outside the held-out fold.

    The driver gets the passages' codes of that sample, ``passages`` of each document at most, evenly spread over its whole text: with the
    defaults 256 * 300 bytes of each of about 3,000 documents.  Scores read all passages.
    """
    rows = labelled(documents, labels, label, held_out(F.col("doc_id")), bound)

    def encode(batches):
        for pdf in batches:
            texts, y = pdf.text.tolist(), pdf.y.to_numpy()
            for first, x, bag in bags(texts):
                for i in range(int(bag.max()) + 1):
                    own = x[bag == i]
                    own = own[np.unique(np.linspace(0, len(own) - 1, min(len(own), passages)).astype(int))]
                    yield pd.DataFrame({"codes": [own.tobytes()], "y": [int(y[first + i])]})

    found = materialize(rows.select("text", "y").mapInPandas(encode, "codes binary, y int"), "passages").orderBy(F.xxhash64("codes"), "codes").collect()
    codes = [np.frombuffer(r[0], np.float32).reshape(-1, N_FEATURES) for r in found]
    bag = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    return fit(np.concatenate(codes) if codes else np.zeros((0, N_FEATURES), np.float32), bag, np.array([r[1] for r in found], float))


def score(documents: DataFrame, model: AttentionModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``documents`` with ``score`` and ``predicted``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts.tolist()))

    return small_batches(documents).withColumn("score", rate(text)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
