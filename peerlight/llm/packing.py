"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents become pieces: only those longer than ``capacity`` are cut, the first piece takes the remainder.  Packing is bulk-synchronous.
Pieces are ranked by length, longest first, and so are the gaps that open sequences have left.  In a round every length sweeps
to its successor, the smallest gap that holds it; where several lengths meet at one gap size, their pieces are ranked, longest
first, and as many as there are gaps of that size win.  Then the gaps shrink and the next round begins; a new sequence opens
only for pieces that no gap holds.

Lengths and gaps are integers up to ``capacity``, so a round needs no more than how many pieces have each length and how many sequences
each gap: that histogram has at most ``capacity`` entries, whatever the corpus, and the rounds run over runs of it.  The pieces themselves
stay distributed: they are ranked inside their length (in salted parts, so that a frequent length is spread out) and
each takes the place that its rank has in the runs.

Pieces that fill a sequence have ids below 0.

Cases: null text packs as empty, one end token.  Long texts are encoded whole.  An added token of the vocabulary that stands in a text is one id.  Repeated rows pack separately, and so do documents with equal ids.
An empty table gives an empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

VOCABULARY = "byte_bpe_50k"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of one length are dealt into parts to be ranked, of about so many on average if all pieces had few lengths.
PART_ROWS = 100_000
#: Parts that may be broadcast, after they have been counted.
BROADCAST_PARTS = 500_000


@cache
def _encoder(vocabulary: str):
    """Encoder of a public byte-level BPE vocabulary; its rank file gives the ids of its JSON file, several times as fast.

    The tokens that the JSON file adds to its model aren't in the rank file, so they are read from the JSON.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{vocabulary} has added tokens that aren't matched as they stand")
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={x["content"]: x["id"] for x in added})


def token_ids(text: str | None, vocabulary: str = VOCABULARY, end: int = 2) -> np.ndarray:
    """Ids of a text and the end id, as little-endian unsigned 32-bit numbers; added tokens in the text are ordinary text."""
    return np.array([*_encoder(vocabulary).encode_ordinary(text or ""), end], "<u4")


def document_ids(text: str | None, vocabulary: str = VOCABULARY, end: int = 2) -> np.ndarray:
    """As ``token_ids``, but each added token in the text is its own id and parts the text around it, as ``tokenizers`` reads it."""
    return np.array([*_encoder(vocabulary).encode(text or "", allowed_special="all"), end], "<u4")


def pieces(documents: DataFrame, capacity: int, vocabulary: str = VOCABULARY, end: int = 2) -> DataFrame:
    """One row a piece (schema ``PIECES``)."""

    def cut(batches):
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf.doc_id, pdf.text, strict=True):
                ids = document_ids(text, vocabulary, end)
                at, k = 0, 0
                while at < len(ids):
                    n = (len(ids) - at - 1) % capacity + 1 if not k else capacity
                    rows.append((doc, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
                    at, k = at + n, k + 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.assign(doc_id=out.doc_id.astype("Int64"))

    return small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, offset): pieces first rank .. + pieces - 1 of a length go to as many
    sequences from the first on, all at that offset.

    ``free`` holds, for each gap size, the runs (first sequence, number) that have it; ``sizes`` the gap sizes in order.
    """
    waiting, used = dict(counts), Counter()
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)
    sizes: list[int] = []
    made: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def give(gap: int, run: tuple[int, int]) -> None:
        if gap:
            if not free[gap]:
                insort(sizes, gap)
            free[gap].append(run)

    while waiting:
        wanted: dict[int, list[int]] = defaultdict(list)
        for length in sorted(waiting, reverse=True):
            at = bisect_left(sizes, length)
            if at < len(sizes):
                wanted[sizes[at]].append(length)
        left: list[tuple[int, tuple[int, int]]] = []
        if not wanted:  # the longest pieces open sequences of their own
            length = max(waiting)
            n = waiting.pop(length)
            per = capacity // length
            first = 0
            for k in range(per):
                m = n // per + (k < n % per)
                if m:
                    made.append((length, used[length] + first, m, opened, k * length))
                    first += m
            full, rest = n // per, n % per
            give(capacity - per * length, (opened, full)) if full else None
            give(capacity - rest * length, (opened + full, 1)) if rest else None
            used[length] += n
            opened += full + bool(rest)
            continue
        for gap in list(wanted):
            runs = free.pop(gap)
            sizes.remove(gap)
            for length in wanted[gap]:  # longest first
                while runs and waiting.get(length):
                    first, n = runs.pop()
                    m = min(n, waiting[length])
                    made.append((length, used[length], m, first, capacity - gap))
                    used[length] += m
                    waiting[length] -= m
                    left.append((gap - length, (first, m)))
                    if m < n:
                        runs.append((first + m, n - m))
                if not waiting.get(length):
                    waiting.pop(length, None)
            left += [(gap, run) for run in runs]
        for gap, run in left:  # the gaps as they are after the round
            give(gap, run)
    return made


def pack(documents: DataFrame, capacity: int = 1024, vocabulary: str = VOCABULARY, end: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row a piece."""
    return place(materialize(pieces(documents, capacity, vocabulary, end), "pack-pieces"), capacity)


def place(cut: DataFrame, capacity: int) -> DataFrame:
    """Sequence and offset of every piece of ``cut``, which has a ``length`` column and is read three times.

    Pieces of ``capacity`` tokens, of which long documents have most, are sequences of their own: they take no part in the rounds and aren't shuffled.
    """
    spark = cut.sparkSession
    full = cut.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = cut.filter(F.col("length") < capacity)
    salts = 64 + rest.count() // PART_ROWS
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")
    parts = materialize(rest.groupBy("length", salt.alias("salt")).count(), "pack-parts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.select(F.col("length").alias("_length"), F.col("salt").alias("_salt"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    if parts.count() <= BROADCAST_PARTS:
        firsts = F.broadcast(firsts)
    counts = {r[0]: r[1] for r in parts.groupBy("length").agg(F.sum("count")).collect()}  # at most `capacity` rows
    runs = spark.createDataFrame(plan(counts, capacity) or [(0, 0, 0, 0, 0)], "_len long, _from long, _n long, _seq long, offset long")
    # a complete order: what is equal in all columns can be swapped
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = (
        rest.withColumn("salt", salt).withColumn("_in", inside)
        .join(firsts, (F.col("length") == F.col("_length")) & (F.col("salt") == F.col("_salt")))
        .withColumn("_rank", F.col("_first") + F.col("_in") - 1)
    )
    # a few runs for each length: bounded by the capacity
    by_length = runs.groupBy("_len").agg(F.sort_array(F.collect_list(F.struct("_from", "_n", "_seq", "offset"))).alias("_runs"))
    found = F.element_at(F.filter("_runs", lambda r: (F.col("_rank") >= r["_from"]) & (F.col("_rank") < r["_from"] + r["_n"])), 1)
    placed = (
        ranked.join(F.broadcast(by_length), F.col("length") == F.col("_len"))
        .withColumn("_run", found)
        .select(*cut.columns, (F.col("_run._seq") + F.col("_rank") - F.col("_run._from")).alias("sequence_id"), F.col("_run.offset").alias("offset"))
    )
    return full.select(*placed.columns).union(placed)
