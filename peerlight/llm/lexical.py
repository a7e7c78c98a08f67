"""Ranked lexical search: the highest-scoring documents of each item of a query set, exactly.

Terms are maximal runs of letters, digits and characters beyond ASCII, A-Z lower-cased.  A first pass over the texts writes, for each document, its length and the
counts of those of its terms that any item has; sums over it give N, L and the document frequencies.  The second pass reads these postings in blocks of
documents and goes term-at-a-time, rarest first, with accumulators: a document gets one when a term of the item is met in it.  As soon as the terms that are left
can't lift a new document over the k-th partial score (of the block, or of the blocks before it in the task), no more accumulators are created; those that exist go on
to be updated with every term, so their scores are exact.  Each task keeps k documents an item, and these short lists are merged.

The bound of a term is its weight times the largest impact that its frequency can have, times its repeats in the item.  New documents are ruled out only where
the sum of the remaining bounds is *below* the k-th partial score, so that ties are decided by the smaller id as asked.

Items are queries: they are read in groups whose terms have a bounded size, and each group is broadcast.  What is shuffled are document frequencies and short lists.

Cases: null and empty texts have no terms and are never found.  An item without terms, or without a document that shares one, has no rows.  Repeated items with one id are
ranked each under that id; repeated documents are candidates each.  Ties go to the smaller id, null ids last.  Empty tables give an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, small_batches

#: Documents that are searched together; their postings and one accumulator each are held by a task.
BLOCK_ROWS = 4096
#: Postings that are held at once at most, so that long documents make smaller blocks.
BLOCK_POSTINGS = 2_000_000
#: Bytes of the texts of the items that are searched in one pass.
GROUP_BYTES = 16 << 20
POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"
FOUND = "item int, doc_id long, score long"
#: What doesn't belong to a term becomes a space, A-Z becomes a-z, bytes of other characters stay.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_BYTES).split()


def postings(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Length and term counts (of terms in ``vocabulary``) of each document that has a term."""
    numbers = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = numbers.value.get
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf.doc_id, pdf.text, strict=True):
                words = terms(text)
                if words:
                    n = Counter(map(of, words))
                    n.pop(None, None)
                    rows.append((doc, len(words), list(n), list(n.values())))
            out = pd.DataFrame(rows, columns=["doc_id", "n", "terms", "counts"])
            yield out.assign(doc_id=out.doc_id.astype("Int64"))

    return small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(count, POSTINGS)


def weight(df: int, n: int) -> int:
    """Of a term that ``df`` of ``n`` documents have."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Block:
    """Postings of some documents by term: places in the block and impacts."""

    def __init__(self, ids: list, n: list, terms: list, counts: list, docs: int, length: int):
        self.ids = np.array([x is None or x != x for x in ids]), np.array([0 if x is None or x != x else x for x in ids], "i8")
        lengths = np.array([len(t) for t in terms])
        place = np.repeat(np.arange(len(ids)), lengths)
        term, tf = np.concatenate(terms).astype("i8"), np.concatenate(counts).astype("i8")
        m = np.array([25 + (75 * int(x) * docs) // length for x in n], "i8")
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[place])
        order = np.argsort(term, kind="stable")
        self.place, self.impact = place[order], impact[order]
        found, starts = np.unique(term[order], return_index=True)
        self.spans = dict(zip(found.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True), strict=True))

    def search(self, query: list[tuple[int, int, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the at most k best documents of the block that may have ``least`` or more.  ``query``: (term, weight x repeats, bound), rarest first."""
        score, has = np.zeros(len(self.ids[1]), "i8"), np.zeros(len(self.ids[1]), bool)
        left, creating, kth = sum(b for _, _, b in query), True, least
        for term, times, bound in query:
            if creating and left < kth:
                creating = False
                if not has.any():
                    break
            span = self.spans.get(term)
            if span:
                at, gain = self.place[span[0] : span[1]], times * self.impact[span[0] : span[1]]
                if not creating:
                    old = has[at]
                    at, gain = at[old], gain[old]
                score[at] += gain
                has[at] = True
            left -= bound
            if creating and left and len(score) > k:
                kth = max(kth, int(np.partition(score, len(score) - k)[len(score) - k]))
        at = np.flatnonzero(has & (score > 0) & (score >= least))
        null, ids = self.ids
        best = at[np.lexsort((ids[at], null[at], -score[at]))[:k]]
        return best, score[best]


def blocks(batches: Iterator[pd.DataFrame], rows: int = BLOCK_ROWS) -> Iterator[tuple[list, list, list, list]]:
    ids, n, terms_of, counts, held = [], [], [], [], 0
    for pdf in batches:
        for row in zip(pdf.doc_id, pdf.n, pdf.terms, pdf.counts, strict=True):
            if len(row[2]):
                ids.append(row[0]), n.append(row[1]), terms_of.append(row[2]), counts.append(row[3])
                held += len(row[2])
            if len(ids) >= rows or held >= BLOCK_POSTINGS:
                yield ids, n, terms_of, counts
                ids, n, terms_of, counts, held = [], [], [], [], 0
    if ids:
        yield ids, n, terms_of, counts


def groups(items: DataFrame, bound: int) -> Iterator[list[tuple[int | None, str]]]:
    """Items in groups of about ``bound`` bytes of text, one after the other."""
    held, size = [], 0
    for item, text in items.select("item_id", "text").filter("text is not null").toLocalIterator():
        held.append((item, text))
        size += len(text)
        if size >= bound:
            yield held
            held, size = [], 0
    if held:
        yield held


def _ranked(documents: DataFrame, wanted: list[tuple[int | None, str]], k: int, block_rows: int) -> DataFrame:
    spark = documents.sparkSession
    asked = [Counter(terms(text)) for _, text in wanted]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*asked)))}
    listed = materialize(postings(documents, vocabulary), "lexical-postings")
    docs, length = listed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # one row a term of the items at most
    df = {t: n for t, n in listed.select(F.explode("terms").alias("t")).groupBy("t").count().collect()} if docs else {}
    queries = []
    for counts in asked:
        known = sorted((df[vocabulary[t]], vocabulary[t], c) for t, c in counts.items() if vocabulary[t] in df)
        # an impact is below 1,000,000, whatever the frequency
        queries.append([(t, c * weight(n, docs), c * weight(n, docs) * 1_000_000) for n, t, c in known])
    shared = spark.sparkContext.broadcast(queries)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list[tuple]] = [[] for _ in shared.value]
        for part in blocks(batches, block_rows):
            block = Block(*part, docs, length)
            for i, query in enumerate(shared.value):
                top = best[i]
                places, scores = block.search(query, k, top[-1][0] if len(top) == k else 1)
                if len(places):
                    new = [(int(s), bool(block.ids[0][p]), int(block.ids[1][p])) for p, s in zip(places, scores, strict=True)]
                    best[i] = sorted([*top, *new], key=lambda x: (-x[0], x[1], x[2]))[:k]
        rows = [(i, None if null else doc, score) for i, top in enumerate(best) for score, null, doc in top]
        out = pd.DataFrame(rows, columns=["item", "doc_id", "score"])
        yield out.assign(doc_id=out.doc_id.astype("Int64"))

    lists = listed.mapInPandas(search, FOUND)
    # k rows an item and task: merged inside each item without sorting all of them
    first = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.isnull("doc_id").alias("none"), "doc_id"))), 1, k)
    tree = lists.groupBy("item", F.pmod(F.spark_partition_id(), F.lit(64)).alias("_part")).agg(first.alias("_x")).groupBy("item").agg(F.slice(F.sort_array(F.flatten(F.collect_list("_x"))), 1, k).alias("_x"))
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(wanted)], "item int, item_id long")
    out = tree.select("item", F.posexplode("_x").alias("_p", "_x")).join(F.broadcast(names), "item")
    out = materialize(out.select("item_id", (F.col("_p") + 1).cast("int").alias("rank"), "_x.doc_id", (-F.col("_x.s")).alias("score")), "lexical-found")
    release(listed)
    return out


def rank(documents: DataFrame, items: DataFrame, k: int = 10, group_bytes: int = GROUP_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents (doc_id, text) of each item (item_id, text), score above 0."""
    found = documents.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for wanted in groups(items, group_bytes):
        found = found.unionByName(_ranked(documents, wanted, k, block_rows))
    return found
