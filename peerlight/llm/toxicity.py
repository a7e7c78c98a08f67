"""Toxicity by compression distance: windows are compressed with a dictionary of toxic text and with one of ordinary text.

The ordinary dictionary is trained by zstandard on windows of ordinary documents.  The toxic one holds what sets toxic text apart: the beginnings of words
that are far more frequent in toxic documents, the ``spans`` most significant ones, which are the dictionary's size; in front of the same ordinary content, so that ordinary words cost the same
with both and the difference of the two lengths is what toxic spans save.  Windows and dictionaries are spelled by ``spelled``: a match of a few letters would save no more than it costs to write down.  (README has the figures of toxic dictionaries that zstandard trains itself.)  A document is described by the largest, the mean and the frequency of these savings over all of its windows, and a logistic
calibration on documents that the dictionaries haven't seen turns them into a probability.  The model doesn't depend on how the rows are partitioned.

Cases: null, empty and blank texts have no window and get the score of a text that saves nothing.  A document labelled twice counts
once with its larger label; equal texts train once.  Without labels of both classes every score is the share of toxic labels (0 without any).
Repeated rows are scored each.  Long texts are read whole.  Other columns are kept, but ``score`` and ``predicted`` are replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled, materialize, small_batches

#: Bytes of a span: shorter beginnings are those of ordinary words, and what follows a distinctive one is often an ordinary ending.
SPAN = range(3, 13)
#: Bytes of a word, its space included, that are spelled by one byte, and bytes that spell each further one.
PLAIN, WIDE = 4, 4
#: Saved bytes from which a window counts as a hit.
HIT = 6
#: Words that are spelled together, about, and letters after which those of a word are taken one by one.
TOGETHER, LONG = 1 << 16, 64
N_FEATURES = 7


def _words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


#: The checksum of a letter, by which that of a text goes on.
_CRC = np.array([zlib.crc32(bytes((i,)), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)], "u4")


def spelled_apart(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    """What ``spelled`` returns, and where each word ends in it."""
    text = b"".join(b" " + w for w in words)
    letters, sizes = np.frombuffer(text, "u1"), np.fromiter(map(len, words), "i8", len(words)) + 1
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    by_size, longer = starts[order], np.cumsum(np.bincount(sizes)[::-1])[::-1]
    sums, crc = np.empty(len(text), "<u4"), np.full(len(words), 0xFFFFFFFF, "u4")
    for i in range(min(LONG, sizes.max(initial=0))):  # the letters at place i of all words that have one
        at = by_size[: longer[i + 1]] + i
        crc = crc[: len(at)]
        crc = _CRC[(crc ^ letters[at]) & 255] ^ (crc >> 8)
        sums[at] = ~crc
    for k in np.flatnonzero(sizes > LONG):
        at, end = int(starts[k]) + LONG, int(starts[k] + sizes[k])
        so_far = int(sums[at - 1])
        for i in range(at, end):
            so_far = sums[i] = zlib.crc32(text[i : i + 1], so_far)
    place = np.arange(len(text)) - np.repeat(starts, sizes)
    kept = np.arange(4) < np.where(place < PLAIN, 1, WIDE)[:, None]
    plain = np.minimum(sizes, PLAIN)
    return sums.view("u1").reshape(-1, 4)[kept].tobytes(), np.cumsum(plain + WIDE * (sizes - plain))


def spelled(words: list[bytes]) -> bytes:
    """The words with each byte replaced by a checksum of its word up to there, wider from the fifth on.

    So a match is a common beginning, never a syllable inside other words, and saves the more the longer it is.
    """
    return spelled_apart(words)[0]


@dataclass
class Dictionaries:
    """Contents of the two dictionaries, in plain bytes, and the number of words in a window."""

    ordinary: bytes
    toxic: bytes
    window: int = 8

    @cached_property
    def _compress(self):
        # matches of six bytes at least, looked for at every position of the dictionary
        how = zstandard.ZstdCompressionParameters(window_log=17, chain_log=14, hash_log=15, min_match=6, search_log=4, target_length=64, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
        out = []
        for content in (spelled(self.ordinary.split()), spelled(self.toxic.split() + self.ordinary.split())):
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=how)
            out.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=how).compress)
        return out

    @property
    def _compressors(self):
        """The same for windows in plain bytes."""
        return [lambda window, compress=compress: compress(spelled(window.split())) for compress in self._compress]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_compress"}

    def savings(self, texts) -> list[np.ndarray]:
        """What the toxic dictionary saves in each window of each text; windows are spelled once, many words together."""
        plain, toxic = self._compress
        n = self.window
        step = n * max(1, TOGETHER // n)

        def saved(words: list[bytes], ends: np.ndarray) -> list[int]:
            data, at = spelled_apart(words)
            stops = at[ends - 1].tolist()
            return [len(plain(w)) - len(toxic(w)) for w in (data[i:j] for i, j in zip([0, *stops], stops))]

        words, ends, found, counts = [], [], [], []
        for text in texts:
            own, before = _words(text), len(found) + sum(map(len, ends))
            for i in range(0, len(own), step):
                part = own[i : i + step]
                ends.append(len(words) + np.minimum(np.arange(n, len(part) + n, n), len(part)))
                words += part
                if len(words) >= step:
                    found += saved(words, np.concatenate(ends))
                    words, ends = [], []
            counts.append(len(found) + sum(map(len, ends)) - before)
        if words:
            found += saved(words, np.concatenate(ends))
        return np.split(np.array(found, float), np.cumsum(counts)[:-1]) if counts else []

    def describe(self, texts) -> np.ndarray:
        """The features of each text, a row each."""
        return np.array([self._features(s) for s in self.savings(texts)]).reshape(-1, N_FEATURES)

    def features(self, text: str | None) -> np.ndarray:
        return self.describe([text])[0]

    def _features(self, saved: np.ndarray) -> np.ndarray:
        if not len(saved):
            return np.zeros(N_FEATURES)
        s, hits = np.sort(saved)[::-1], float((saved >= HIT).sum())
        return np.array([s[0], s[:3].mean(), s[: max(1, len(s) // 10)].mean(), np.log1p(hits), saved.mean() / self.window, hits / len(s), np.log1p(len(s))])


@dataclass
class ToxicityModel:
    dictionaries: Dictionaries | None = None
    centre: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(N_FEATURES))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES + 1))
    prior: float = 0.0

    def scores(self, texts) -> np.ndarray:
        if self.dictionaries is None:
            return np.full(len(texts), self.prior)
        x = self.dictionaries.describe(texts)
        z = np.column_stack([np.ones(len(x)), (x - self.centre) / self.scale]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _beginnings(word: bytes) -> list[bytes]:
    return [word[:n] for n in SPAN if n <= len(word)]


def train_dictionaries(rows: DataFrame, least_ratio: float = 4.0, least_z: float = 5.0, span_ratio: float = 20.0, span_z: float = 8.0, spans: int = 50, ordinary_bytes: int = 1024) -> Dictionaries | None:
    """From rows (text, y), a bounded sample that has been written; None without both classes.

    A word's beginnings that pass ``least_ratio`` and ``least_z`` compete, the most significant one stands for the word; what stands for words must pass ``span_ratio`` and ``span_z`` by the
    documents of these words alone (so that no beginning lives on its continuation), or, in small samples, half of the greatest such z.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return None

    def per_document(own):
        """(gram, n1, n0, z): documents of either class that hold each of ``own(their words)``."""

        def count(batches):
            for pdf in batches:
                for y, part in pdf.groupby("y"):
                    seen: Counter = Counter()
                    for t in part.text:
                        seen.update(own(set(_words(t))))
                    yield pd.DataFrame({"gram": pd.Series(list(seen), dtype=object), "y": int(y), "n": list(seen.values())}).astype({"n": "int64"})

        each = rows.select("text", "y").mapInPandas(count, "gram binary, y int, n long").groupBy("gram").agg(F.sum(F.col("n") * F.col("y")).alias("n1"), F.sum(F.col("n") * (1 - F.col("y"))).alias("n0"))
        p = (F.col("n1") + F.col("n0")) / (n1 + n0)
        z = (F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
        return each.filter((F.col("n1") >= 4) & (p < 1)).withColumn("z", z)

    def more(ratio: float):
        return F.col("n1") / n1 >= ratio * F.col("n0") / n0

    found = per_document(lambda words: {g for w in words for g in _beginnings(w)}).filter(more(least_ratio) & (F.col("z") >= least_z)).select("gram", "z").collect()  # of a bounded sample
    apart = rows.sparkSession.sparkContext.broadcast({bytes(r[0]): r[1] for r in found})

    def standing(words):
        z = apart.value
        known = ([g for g in _beginnings(w) if g in z] for w in words)
        return {max(at, key=lambda g: (z[g], len(g))) for at in known if at}

    top = per_document(standing).filter(more(span_ratio)).orderBy(F.desc("z"), "gram").limit(spans).collect()
    top = [r for r in top if r.z >= min(span_z, top[0].z / 2)]

    def windows(batches):
        for pdf in batches:
            out = []
            for t in pdf.text:
                words = _words(t)
                own = {b" ".join(words[i : i + 16]) for i in range(0, len(words), 16)}
                out += sorted(own, key=xxhash.xxh3_64_intdigest)[:4]
            yield pd.DataFrame({"window": pd.Series(out, dtype=object)})

    # four windows of each text, from anywhere in it; in one order however the rows arrive
    samples = sorted((bytes(r[0]) for r in rows.filter("y = 0").select("text").mapInPandas(windows, "window binary").collect()), key=lambda w: (xxhash.xxh3_64_intdigest(w), w))
    try:
        ordinary = zstandard.train_dictionary(ordinary_bytes, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        ordinary = b" ".join(samples)[-ordinary_bytes:]
    return Dictionaries(ordinary or b" " * 8, b" ".join(bytes(r[0]) for r in reversed(top)))


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = 4000) -> ToxicityModel:
    """Fit on about ``bound`` labelled documents of each class at most, outside the held-out fold."""
    sample = labelled(documents, labels, label, held_out(F.col("doc_id")), bound)
    sample = sample.groupBy("text").agg(F.max("y").alias("y")).withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)))
    rows = materialize(sample, "toxicity-sample")
    sizes = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    model = ToxicityModel(prior=sizes.get(1, 0) / max(1, sum(sizes.values())))
    half = train_dictionaries(rows.filter("half = 0"))
    whole = train_dictionaries(rows)
    if half is None or whole is None:
        return model
    shared = rows.sparkSession.sparkContext.broadcast(half)

    def describe(batches):
        for pdf in batches:
            yield pd.DataFrame({"x": list(shared.value.describe(pdf.text)), "y": pdf.y})

    unseen = rows.filter("half = 1").select("text", "y").mapInPandas(describe, "x array<double>, y int").orderBy("x", "y").collect()  # `bound` rows a class at most
    x, y = np.array([r[0] for r in unseen]).reshape(len(unseen), N_FEATURES), np.array([r[1] for r in unseen], float)
    if not 0 < y.sum() < len(y):
        return model
    model.dictionaries, model.centre, model.scale = whole, x.mean(0), x.std(0) + 1e-9
    model.weights = logistic((x - model.centre) / model.scale, y)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, intercept first, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id):
    return fold(doc_id, 4) == 2


def score(documents: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``documents`` with ``score`` and ``predicted``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts.tolist()))

    return small_batches(documents).withColumn("score", rate(text)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
