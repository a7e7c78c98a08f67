"""Language identification with bit-sliced Bloom filters over character n-grams.

Row ``p`` of the filter matrix holds one bit a language, so that the AND of the ``k`` rows that an n-gram hashes to
answers for all languages at once which of them contain it.  The bits are counted per language over the text; a
language whose filter has the false-positive rate ``f`` and that answers for a share ``s`` of the n-grams is
credited with ``(s - f) / (1 - f)``.

Cases: null text or one without a letter is ``und`` with score 0.  A text none of whose n-grams is known
gets the most frequent training language with score 0; ties go to the more frequent, then the smaller code.  Repeated rows are
answered each.  Without training rows every text is ``und``.  Other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, fold, small_batches

SIZES = (3, 4)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_CHUNK = 1 << 18


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _MIX[3]
    h ^= h >> np.uint64(29)
    return h


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of lower-cased letters, word by word with its two edges, first position of each, and where each text begins."""
    points = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(p) + 2 for p in points], out=starts[1:])
    edge = np.zeros(1, np.uint32)
    c = np.concatenate([x for p in points for x in (edge, p, edge)] or [edge])
    letter = _letters()[c]
    c = np.where(letter, c, 0).astype(np.uint64)
    hashes, at = [], []
    for n in SIZES:
        if len(c) < n:
            continue
        inner = letter[1 : len(c) - n + 2].copy()
        for i in range(2, n - 1):
            inner &= letter[i : len(c) - n + 1 + i]
        where = np.flatnonzero(inner)
        h = np.full(len(where), n, np.uint64)
        for i in range(n):
            h = h * _MIX[0] + c[where + i] * _MIX[1] + _MIX[2]
        hashes.append(_mixed(h))
        at.append(where)
    return np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(at or [np.zeros(0, np.int64)]), starts


def _chunks(texts: list[str]):
    """Runs of texts of about a million characters together, as (first, last) positions."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _CHUNK:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


@dataclass
class LanguageFilters:
    """languages: most frequent first.  rows: bit-sliced filters, one word of 64 languages after the other."""

    languages: list[str]
    rows: np.ndarray
    false_positive: np.ndarray
    probes: int

    def positions(self, h: np.ndarray):
        step = (h >> np.uint64(33)) | np.uint64(1)
        for i in range(self.probes):
            yield ((h + np.uint64(i) * step) & np.uint64(len(self.rows) - 1)).astype(np.int64)

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language of each text (-1: none), its score, and the corrected share of n-grams that it contains."""
        best, score, known = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts))
        if not self.languages:
            return best, score, known
        for a, b in _chunks(texts):
            h, at, starts = ngrams(texts[a:b])
            masks = np.full((len(h), self.rows.shape[1]), ~np.uint64(0))
            for p in self.positions(h):
                masks &= self.rows[p]
            text = np.searchsorted(starts, at, "right") - 1
            total = np.bincount(text, minlength=b - a)
            share = np.empty((len(self.languages), b - a))
            for l in range(len(self.languages)):
                bit = (masks[:, l // 64] >> np.uint64(l % 64)) & np.uint64(1)
                share[l] = np.bincount(text, weights=bit.astype(np.float64), minlength=b - a)
            share /= np.maximum(total, 1)
            f = self.false_positive[:, None]
            share = np.clip((share - f) / (1 - f), 0, 1)
            best[a:b] = np.where(total > 0, share.argmax(0), -1)
            known[a:b] = np.where(total > 0, share.max(0), 0)
            score[a:b] = known[a:b] / np.maximum(share.sum(0), 1e-12)
        return best, score, known


def train(rows: DataFrame, text: str = "text", lang: str = "lang", sample_key: str = "doc_id", docs_per_language: int = 3000, filter_size: int = 6000, least_share: float = 0.5, bits: int = 1 << 17, probes: int = 3) -> LanguageFilters:
    """Fit the filters on about ``docs_per_language`` documents of each language at most.

    A language contains an n-gram if the n-gram's frequency there is at least ``least_share`` of its highest in any
    language; the ``filter_size`` most frequent of these are stored.  Only those come to the driver.
    """
    rows = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    docs = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not docs:
        return LanguageFilters([], np.zeros((bits, 1), np.uint64), np.zeros(0), probes)
    sample = bounded_sample(rows.select(sample_key, lang, text), F.col(sample_key), lang, docs_per_language)

    def count(batches):
        for pdf in batches:
            for name, part in pdf.groupby(lang):
                texts = part[text].tolist()
                for a, b in _chunks(texts):
                    h, n = np.unique(ngrams(texts[a:b])[0].view(np.int64), return_counts=True)
                    yield pd.DataFrame({"lang": name, "gram": h, "n": n.astype(np.int64)})

    counts = small_batches(sample).select(F.col(lang), F.col(text)).mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sized = counts.filter("n > 1").withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    apart = sized.withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).filter(F.col("rate") >= least_share * F.col("top"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept = apart.withColumn("place", order).filter(F.col("place") <= filter_size).select("lang", "gram").toPandas()
    languages = sorted(docs, key=lambda x: (-docs[x], x))
    out = LanguageFilters(languages, np.zeros((bits, -(-len(languages) // 64)), np.uint64), np.zeros(len(languages)), probes)
    for l, name in enumerate(languages):
        h = kept.gram[kept.lang == name].to_numpy(np.int64).view(np.uint64)
        for p in out.positions(h):
            out.rows[p, l // 64] |= np.uint64(1) << np.uint64(l % 64)
        out.false_positive[l] = (((out.rows[:, l // 64] >> np.uint64(l % 64)) & np.uint64(1)).mean()) ** probes
    return out


def predict(documents: DataFrame, model: LanguageFilters, text: str = "text") -> DataFrame:
    """``documents`` with ``lang_pred``, ``score`` and ``known`` appended (columns of those names are replaced)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, known double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        best, score, known = m.predict([t or "" for t in texts])
        return pd.DataFrame({"lang_pred": [m.languages[i] if i >= 0 else "und" for i in best], "score": score, "known": known})

    return small_batches(documents).withColumn("_guess", guess(F.col(text))).withColumns({c: F.col(f"_guess.{c}") for c in ("lang_pred", "score", "known")}).drop("_guess")


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 4) == 2
