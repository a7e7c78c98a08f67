"""Exact top-k search by tiled matrix products.

Vectors become rows of integers, packed into shards by a hash of their id; the queries are packed into blocks in the
same way.  A tile is one block against one shard: a single matrix product, of which only each query's best ``k`` and
their ids leave the task.  The lists are then merged in a tree, ``fan_in`` shards at a time.

Shards and blocks hold a bounded number of vectors in the narrowest integers that fit, so that no task's memory depends on the size of the table; the number of tiles grows.

Cases: vectors that are null or hold a null, NaN or infinite component take no part, and neither do rows without an id.
Rows that repeat an id are candidates each, but never for a query of their own id;
queries that repeat an id share one list, the best pairs of all of them.  Ties go to the smaller id.  Vectors of another length than the query's are no candidates.
Scores must fit a 64-bit integer.  Fewer than ``k`` candidates give all of them; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK = "part long, dim int, width int, ids binary, vectors binary"
#: Up to here integer products and sums are exact in doubles, whose matrix product is the fast one.
EXACT = float(1 << 53)


def integer_components(embedding: Column, scale: int = 1024) -> Column:
    """``floor(scale * x)`` of each component as 64-bit integers; null where a component is null or not finite."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    usable = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(wide, lambda x: F.floor(x * scale).cast("long")))


def _packed(rows: DataFrame, parts: int) -> DataFrame:
    """Rows (vec_id, v) as one row a part and vector length, sorted by id."""

    def pack(key, pdf):
        pdf = pdf.assign(t=[tuple(v) for v in pdf.v]).sort_values(["vec_id", "t"])
        v = np.array(pdf.t.tolist(), np.int64).reshape(len(pdf), -1)
        width = next(w for w in (2, 4, 8) if w == 8 or (v.min(initial=0) >= -(1 << 8 * w - 1) and v.max(initial=0) < 1 << 8 * w - 1))
        return pd.DataFrame({"part": [key[0]], "dim": [key[1]], "width": [width], "ids": [pdf.vec_id.to_numpy(np.int64).tobytes()], "vectors": [v.astype(f"<i{width}").tobytes()]})

    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part")
    return rows.select(part, F.size("v").alias("dim"), "vec_id", "v").groupBy("part", "dim").applyInPandas(pack, BLOCK)


def best_of_tile(queries: np.ndarray, query_ids: np.ndarray, shard: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, scores) of the ``k`` highest scores of every query, its own id left out; ``ids`` ascend."""
    most = lambda a: float(np.abs(a.astype(np.float64)).max(initial=0))
    if most(queries) * most(shard) * max(1, queries.shape[1]) < EXACT:
        scores = np.rint(queries.astype(np.float64) @ shard.astype(np.float64).T).astype(np.int64)
    else:
        scores = queries @ shard.T
    own = query_ids[:, None] == ids[None, :]
    least = np.iinfo(np.int64).min
    scores[own] = least
    cut = np.partition(scores, max(0, scores.shape[1] - k), axis=1)[:, max(0, scores.shape[1] - k)]
    q, c = np.nonzero((scores >= cut[:, None]) & ~own)
    s = scores[q, c]
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    place = np.arange(len(q)) - np.searchsorted(q, q, "left")
    keep = place < k
    return query_ids[q[keep]], ids[c[keep]], s[keep]


def top_k(embeddings: DataFrame, is_query: Column, k: int = 10, shard_rows: int = 4096, block_rows: int = 1024, fan_in: int = 16, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the highest integer inner product for each row with ``is_query``."""
    usable = embeddings.filter(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), integer_components(F.col("embedding"), scale).alias("v"), is_query.alias("_q")).filter("v is not null")
    usable = materialize(usable, "topk-vectors")
    n, n_queries = usable.agg(F.count("*"), F.count_if("_q")).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_queries // block_rows))
    shard = _packed(usable.select("vec_id", "v"), shards)
    block = _packed(usable.filter("_q").select("vec_id", "v"), blocks)
    # the tile grid: every shard meets every block of the stated query set, as whole blocks of bounded size
    left = shard.select(F.col("part").alias("shard"), "dim", "width", "ids", "vectors", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    right = block.select(F.col("part").alias("block"), "dim", F.col("width").alias("q_width"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    tiles = left.join(right, ["shard", "block", "dim"])

    def search(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids, q_ids = np.frombuffer(row.ids, np.int64), np.frombuffer(row.q_ids, np.int64)
                shape = lambda raw, width, m: np.frombuffer(raw, f"<i{width}").astype(np.int64).reshape(len(m), -1)
                q, c, s = best_of_tile(shape(row.q_vectors, row.q_width, q_ids), q_ids, shape(row.vectors, row.width, ids), ids, k)
                yield pd.DataFrame({"query_id": q, "node": row.shard, "vec_id": c, "score": s})

    lists = tiles.mapInPandas(search, "query_id long, node long, vec_id long, score long")
    while shards > 1:  # a level of the tree: fan_in lists become one
        shards = -(-shards // fan_in)
        lists = lists.withColumn("node", F.floor(F.col("node") / fan_in).cast("long"))
        lists = _best(lists, k, "node").drop("rank")
    return _best(lists, k).select("query_id", "rank", "vec_id", "score")


def _best(lists: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
