"""Exact n-gram Jaccard join of documents over count vectors of hashed tokens, indexed by R-trees.

A document is the set of its distinct shingles (``width`` words, ASCII letters lower-cased).  Shingles that no other set has can't be part of
an overlap, so they are only counted.  The others are hashed into ``GROUPS`` groups or more, and the number in each group is the document's point.  No overlap
is larger than the sum of the coordinate minima of two points, and none of the overlaps with a box of points is larger than the sum of the minima with the
box's upper corner.

One tree over all points prunes nothing (README has figures), so the points are indexed by a forest: two sets can reach the threshold only if they share one of the
``n - ceil(t n) + 1`` rarest shingles of each, and every such shingle is the root of a tree over the sets that have it there.  A tree is bulk-loaded: its
members are dealt into tiles of ``TILE`` points, folded to ``GROUPS`` numbers so that long sets take no more room, each tile is sorted and cut into leaves of ``LEAF``, leaves have boxes.  Tiles of a root meet as pairs, so that a
task holds two tiles whatever the size of the tree; inside, boxes are compared first, then the points of what is left.

Steps, each written to the shared folder:

1. ``outlines``: per document the size, a hash of the set, and the head of the set in hash order: ``EXTRA`` longer than what a link needs, so that a set with a
   link shares ``EXTRA`` of its size inside heads.  What shares less is done.  Shingles of a large part of a bounded sample count as shared without a look: they
   stay in their row, so that no shingle's rows meet in one task.
2. ``survivors``: the shared shingles of the other sets, rarest first, and their points (one row for each distinct set).
3. Sets with an equal minimum of rehashed shingles are compared with one of them, once each, and in large groups that are still apart with hubs of random buckets.  This links large groups
   of near copies without listing their links.
4. The forest is searched for pairs across components: first for the best partner of each set, again while that links many; then, with the components that follow, for all pairs.
   Pairs whose points allow the overlap are verified on whole sets.  This finds every link between components that step 3 has missed.
5. Components by minimum labels; every member takes the smallest id of its component.

Cases: null texts and texts without words have the empty set and are linked with nothing, each its own component.  With fewer than ``width``
words the whole sequence is one shingle.  Long texts are hashed whole.  Rows that repeat an id are answered each, by their own text.  A null id is never the smallest of a
component, unless there is no other.  An empty table gives an empty result.  Other columns are ignored.  Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import materialize, release

#: Fewest groups of a point; a larger set has up to one for every four of its shingles, a power of two.
GROUPS = 64
#: Points of a tile (on average, where a tree has several) and of a leaf.
TILE, LEAF = 1024, 32
#: By how much of a set's size its head is longer than a link needs, in percent.
EXTRA = 10
#: Documents of the sample, and in how many of them a shingle is found to count as frequent.
SAMPLE, FREQUENT = 4000, 8
#: Rounds at most in which the sets of large groups meet hubs of random buckets; these and the search for best partners go on while more than one in ``SETTLED`` sets is linked.
HUB_ROUNDS, SETTLED = 4, 100
#: Bytes of text that are hashed together.
_TEXT = 1 << 18
#: Rows of two numbers that may be broadcast, after they have been counted; larger sides are joined by shuffle.
BROADCAST_ROWS = 500_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_BYTE = np.random.default_rng(23).integers(1, 1 << 63, 256, dtype=np.uint64)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _ODD[1]
    h = (h ^ (h >> np.uint64(27))) * _ODD[2]
    return h ^ (h >> np.uint64(31))


def shingle_lists(texts, width: int = 5):
    """For each text the hashes of its shingles in order, repeats included; width is at most 8.

    A word's hash is the sum of a random number for each of its bytes times one for the byte's place, mixed; a shingle's the
    mixed sum of its words' hashes times one for the word's place.  Lower-casing bytes and splitting at blanks know ASCII only, as
    the contract does.
    """
    size, raw = 0, []
    for i, t in enumerate(texts):
        raw.append(b" " + (t or "").encode("utf-8", "surrogatepass").lower() + b" ")
        size += len(raw[-1])
        if size >= _TEXT or i == len(texts) - 1:
            b = np.frombuffer(b"".join(raw), np.uint8)
            inside = ~_BLANK[b]
            edge = np.diff(inside.view(np.int8))
            start, stop = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
            ends = np.cumsum([len(r) for r in raw])
            bounds = np.searchsorted(start, np.concatenate([[0], ends]))
            if len(start):
                at = np.flatnonzero(inside)
                length = stop - start
                firsts = np.cumsum(length) - length
                place = np.arange(len(at)) - np.repeat(firsts, length)
                times = _mixed(np.arange(1, int(length.max()) + 1, dtype=np.uint64) * _ODD[0]) | np.uint64(1)
                words = _mixed(np.add.reduceat(_BYTE[b[at]] * times[place], firsts) + length.astype(np.uint64) * _ODD[3])
            else:
                words = np.zeros(0, np.uint64)
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                h, n = words[x:y], min(width, int(y - x))
                if not n:
                    yield h
                    continue
                out = np.full(len(h) - n + 1, n, np.uint64)
                for k in range(n):
                    out += h[k : len(h) - n + 1 + k] * _ODD[k]
                yield _mixed(out)
            size, raw = 0, []


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    return distinct(next(shingle_lists([text], width)))


def least_overlap(n_a, n_b, percent: int):
    """Smallest intersection with which ``100 * intersection >= percent * union`` holds."""
    return -(-(percent * (n_a + n_b)) // (100 + percent))


def needed(n, percent: int):
    """Fewest shingles that a set of ``n`` shares with any set that it is linked with."""
    return -(-percent * n // 100)


def extra(n, percent: int):
    return np.maximum(1, np.minimum(needed(n, percent), n * EXTRA // 100))


def node_of(s: np.ndarray) -> int:
    """What a set is known by: a signed 64-bit hash."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def point_of(s: np.ndarray, n: int) -> bytes:
    """How many of the shingles each group has, after one byte for the width of a number.  ``n`` is the size of the whole set.

    Groups are low bits of the hash, so that a finer point folds to a coarser one.
    """
    groups = max(GROUPS, 1 << max(0, (n // 4).bit_length() - 1))
    return packed(np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups))


def packed(counts: np.ndarray) -> bytes:
    width = 1 if counts.max() < 1 << 8 else 2 if counts.max() < 1 << 16 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def coordinates(point: bytes, groups: int | None = None) -> np.ndarray:
    """The numbers of a point, folded to ``groups``."""
    a = np.frombuffer(point, f"<u{point[0]}", offset=1).astype(np.int32)
    return a if groups is None else a.reshape(-1, groups).sum(0)


def overlap_bound(p: bytes, q: bytes) -> int:
    """Sum of the coordinate minima of two points."""
    a, b = coordinates(p), coordinates(q)
    g = min(len(a), len(b))
    return int(np.minimum(a.reshape(-1, g).sum(0), b.reshape(-1, g).sum(0)).sum())


def frequent_shingles(documents: DataFrame, width: int) -> np.ndarray:
    """Shingles of many documents of a bounded sample, sorted: at most the sample's shingles over ``FREQUENT``.

    Any set gives right results: it decides which shingles are counted by a shuffle.
    """
    n = documents.count()
    steps = 1 << 40
    sample = documents.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(steps)) < int(min(1.0, SAMPLE / max(1, n)) * steps))

    def each(batches):
        for pdf in batches:
            lists = [distinct(h) for h in shingle_lists(pdf.text.tolist(), width)]
            if lists:
                h, k = np.unique(np.concatenate(lists), return_counts=True)
                yield pd.DataFrame({"shingle": h.view(np.int64), "n": k})

    found = sample.select("text").mapInPandas(each, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    return np.sort(found.select("shingle").toPandas().shingle.to_numpy(np.int64).view(np.uint64))


def among(s: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``s`` are in ``known``; both are sorted."""
    if not len(known):
        return np.zeros(len(s), bool)
    return known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s


OUTLINES = "doc_id long, node long, n_shingles long, head array<long>, n_frequent long"


def outlines(documents: DataFrame, frequent, width: int, percent: int) -> DataFrame:
    """One row a document.  ``head`` are the first shingles by hash, frequent ones last and only counted.

    A set that a task has seen has an empty head: its shingles are there once.
    """

    def describe(batches):
        seen: set[int] = set()
        for pdf in batches:
            rows = []
            for doc, h in zip(pdf.doc_id, shingle_lists(pdf.text.tolist(), width), strict=True):
                s = distinct(h)
                n = len(s)
                if not n:
                    rows.append((doc, 0, 0, [], 0))
                    continue
                node = node_of(s)
                size = int(n - needed(n, percent) + extra(n, percent))
                rare = s[~among(s, frequent.value)]
                rows.append((doc, node, n, [] if node in seen else rare[:size].view(np.int64), max(0, size - len(rare))))
                seen.add(node)
            if len(seen) > 200_000:
                seen.clear()
            yield pd.DataFrame(rows, columns=["doc_id", "node", "n_shingles", "head", "n_frequent"]).astype({"doc_id": "Int64"})

    return documents.mapInPandas(describe, OUTLINES)


def shared(entries: DataFrame) -> DataFrame:
    """(node, shingle, n) of the entries (node, shingle) whose shingle several nodes have; n is its number of entries."""
    every = Window.partitionBy("shingle")
    marked = entries.withColumns({"n": F.count("*").over(every), "_low": F.min("node").over(every), "_high": F.max("node").over(every)})
    return marked.filter("_low < _high").select("node", "shingle", "n")


SETS = "node long, n_shingles long, shared array<long>, minima array<long>, point binary, coarse binary"


def survivors(documents: DataFrame, holders: DataFrame, frequent, width: int, percent: int) -> DataFrame:
    """One row (``SETS``) for each set of ``holders`` (node, doc_id) that shares enough shingles with others to have a link.

    ``shared`` are those shingles: rarest first, then by hash, frequent ones last.  ``coarse`` is the point folded to ``GROUPS``.
    """

    def sets(batches):
        for pdf in batches:
            rows = []
            for h in shingle_lists(pdf.text.tolist(), width):
                s = distinct(h)
                if len(s):
                    often = among(s, frequent.value)
                    rows.append((node_of(s), len(s), s[~often].view(np.int64), s[often].view(np.int64)))
            yield pd.DataFrame(rows, columns=["node", "n_shingles", "rare", "often"])

    ids = materialize(holders.select("doc_id").distinct(), "jaccard-holders")
    read = documents.join(_small(ids), documents.doc_id.eqNullSafe(ids.doc_id), "left_semi").select("text")
    whole = read.mapInPandas(sets, "node long, n_shingles long, rare array<long>, often array<long>")
    whole = materialize(whole.join(_small(materialize(holders.select("node"), "jaccard-nodes")), "node", "left_semi"), "jaccard-whole")
    # a set that rows with equal ids hold is there more than once: its shingles count more, but stay once
    found = shared(whole.select("node", F.explode("rare").alias("shingle"))).groupBy("node").agg(F.array_sort(F.collect_set(F.struct("n", "shingle"))).alias("found"))
    rest = whole.select("node", "n_shingles", "often").dropDuplicates(["node"])
    put = rest.join(found, "node", "left").select("node", "n_shingles", F.concat(F.coalesce(F.col("found.shingle"), F.array().cast("array<long>")), "often").alias("shared"))
    put = put.filter(100 * F.size("shared") >= percent * F.col("n_shingles"))

    def describe(batches):
        for pdf in batches:
            s = [np.asarray(x, np.int64).view(np.uint64) for x in pdf.shared]
            minima = [[int(_mixed(x * _ODD[i]).min().view(np.int64)) for i in range(4, 8)] for x in s]
            point = [point_of(x, n) for x, n in zip(s, pdf.n_shingles, strict=True)]
            yield pdf.assign(minima=minima, point=point, coarse=[packed(coordinates(p, GROUPS)) for p in point])

    out = materialize(put.mapInPandas(describe, SETS), "jaccard-sets")
    release(ids, whole)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): the smallest id that it is connected with.

    Minimum labels with shortcuts: each round links every node to the smallest label around it and every
    label to the smallest of its own, so that long chains shrink by half.
    """
    links = materialize(edges.select("a", "b").filter("a <> b").distinct(), "links")
    both = links.union(links.select("b", "a"))
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id").withColumn("changed", F.lit(True)), "labels")
    while labels.filter("changed").limit(1).count():
        old = labels.select("id", "label")
        near = both.join(old, both.b == old.id).groupBy("a").agg(F.min("label").alias("near"))
        best = old.join(near, old.id == near.a).select("id", "label", F.least("label", "near").alias("least"))
        # the label that a label's own node has: halves the distance to the end
        hop = old.select(F.col("id").alias("_id"), F.col("label").alias("_label"))
        new = F.least("least", F.coalesce("_label", "least"))
        new = materialize(best.join(hop, best.least == hop._id, "left").select("id", new.alias("label"), (new < F.col("label")).alias("changed")), "labels")
        release(labels)
        labels = new
    release(links)
    return labels.select("id", F.col("label").alias("component"))


def _small(df: DataFrame) -> DataFrame:
    """``df``, which has been written, for a broadcast join if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b) of sets those that reach the threshold: points first, then whole sets."""
    ends = {k: sets.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("shared").alias(f"s_{k}"), F.col("point").alias(f"p_{k}")) for k in "ab"}

    def compare(batches):
        for pdf in batches:
            least = least_overlap(pdf.n_a.to_numpy(), pdf.n_b.to_numpy(), percent)
            keep = [overlap_bound(p, q) >= k and len(np.intersect1d(x, y, assume_unique=True)) >= k for p, q, x, y, k in zip(pdf.p_a, pdf.p_b, pdf.s_a, pdf.s_b, least, strict=True)]
            yield pdf.loc[keep, ["a", "b"]]

    return pairs.join(ends["a"], "a").join(ends["b"], "b").mapInPandas(compare, "a long, b long")


def near_links(sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b), written, between the ``n`` sets with an equal minimum of rehashed shingles: a group's sets are compared with its hub, the one that has the least of its own.

    Where a large group is still in several components, its sets are dealt into buckets by a hash, anew in each round, and meet the hub of their bucket.  A round compares each set at
    most as often as it has minima.
    """
    lows = materialize(sets.select("node", (F.size("shared") / F.col("n_shingles")).alias("held"), F.posexplode("minima").alias("i", "low")), "jaccard-lows")
    hubs = materialize(lows.groupBy("i", "low").agg(F.max(F.struct("held", "node")).alias("hub"), F.count("*").alias("_n")).filter("_n > 1").select("i", "low", F.col("hub.node").alias("a")), "jaccard-hubs")
    near = lows.join(_small(hubs), ["i", "low"]).filter("a <> node").groupBy("node", "a").count()
    near = near.groupBy("node").agg(F.max(F.struct("count", "a")).alias("x")).select("x.a", F.col("node").alias("b"))
    links = materialize(verified(near, sets, percent), "jaccard-links")
    release(hubs)
    for salt in range(HUB_ROUNDS):
        known = lows.join(_small(components(links)), F.col("node") == F.col("id"), "left").select("node", "held", "i", "low", F.coalesce("component", "node").alias("component"))
        mixed = known.groupBy("i", "low").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count("*").alias("_n")).filter((F.col("_low") < F.col("_high")) & (F.col("_n") > LEAF))
        mixed = materialize(mixed.select("i", "low", F.ceil(F.col("_n") / LEAF).alias("buckets")), "jaccard-mixed")
        if not mixed.limit(1).count():
            release(mixed)
            break
        dealt = known.join(_small(mixed), ["i", "low"]).withColumn("bucket", F.pmod(F.xxhash64("node", "i", F.lit(salt)), F.col("buckets")))
        dealt = materialize(dealt.select("node", "held", "i", "low", "bucket", "component"), "jaccard-dealt")
        hubs = materialize(dealt.groupBy("i", "low", "bucket").agg(F.max(F.struct("held", "node", "component")).alias("hub")).select("i", "low", "bucket", F.col("hub.node").alias("a"), F.col("hub.component").alias("_of")), "jaccard-hubs")
        near = dealt.join(_small(hubs), ["i", "low", "bucket"]).filter("component <> _of").select("a", F.col("node").alias("b")).distinct()
        found = materialize(verified(near, sets, percent), "jaccard-found")
        settled = found.count() * SETTLED <= n
        longer = materialize(links.union(found), "jaccard-links")
        release(links, mixed, dealt, hubs, found)
        links = longer
        if settled:
            break
    release(lows)
    return links


class Tile:
    """Some members of a tree, sorted and cut into leaves with boxes."""

    def __init__(self, node, n, component, left, point):
        m = np.array([coordinates(p, GROUPS) for p in point])
        order = np.lexsort((m[:, 1], m[:, 0], n, component))
        self.node, self.n, self.component, self.left = (np.asarray(x, np.int64)[order] for x in (node, n, component, left))
        self.m, self.point = m[order], [point[i] for i in order]
        first = np.arange(0, len(order), LEAF)
        self.first, self.end = first, np.append(first[1:], len(order))
        self.upper = np.maximum.reduceat(self.m, first, axis=0)
        self.fewest, self.most_left = np.minimum.reduceat(self.n, first), np.maximum.reduceat(self.left, first)
        self.low, self.high = np.minimum.reduceat(self.component, first), np.maximum.reduceat(self.component, first)


def tile_pairs(x: Tile, y: Tile, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, share) of the members of two tiles (or of one with itself) that lie across components and that points and places allow to be linked."""
    out = []
    least = least_overlap(x.fewest[:, None], y.fewest[None, :], percent)
    for i in range(len(x.first)):
        # no member of a leaf shares more with a member of another than their boxes' upper corners, nor than what is left from the shared place
        bound = np.minimum(np.minimum(x.upper[i], y.upper).sum(1), np.minimum(x.most_left[i], y.most_left))
        one = (x.low[i] == x.high[i]) & (y.low == y.high) & (x.low[i] == y.low)
        for j in np.flatnonzero((bound >= least[i]) & ~one):
            if x is y and j < i:
                continue
            p, q = slice(x.first[i], x.end[i]), slice(y.first[j], y.end[j])
            k = least_overlap(x.n[p, None], y.n[None, q], percent)
            may = (x.component[p, None] != y.component[None, q]) & (np.minimum(x.left[p, None], y.left[None, q]) >= k)
            if not may.any():
                continue
            a, b = np.nonzero(may)
            near = np.minimum(x.m[p][a], y.m[q][b]).sum(1) >= k[a, b]
            for u, v, w in zip(a[near] + x.first[i], b[near] + y.first[j], k[a[near], b[near]], strict=True):
                if (x is not y or u < v) and (most := overlap_bound(x.point[u], y.point[v])) >= w:
                    out.append((x.node[u], y.node[v], most / (x.n[u] + y.n[v])))
    out = list(zip(*out, strict=True)) or [[], [], []]
    return np.array(out[0], np.int64), np.array(out[1], np.int64), np.array(out[2], float)


def leaf_pairs(node, n, component, left, point, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``tile_pairs`` of one tile with itself, for a tree that is a single leaf: points are only read where places allow a link."""
    k = least_overlap(n[:, None], n[None, :], percent)
    may = np.triu((component[:, None] != component[None, :]) & (np.minimum(left[:, None], left[None, :]) >= k), 1)
    out = [(node[u], node[v], most / (n[u] + n[v])) for u, v in zip(*np.nonzero(may), strict=True) if (most := overlap_bound(point[u], point[v])) >= k[u, v]]
    out = list(zip(*out, strict=True)) or [[], [], []]
    return np.array(out[0], np.int64), np.array(out[1], np.int64), np.array(out[2], float)


def best_partners(a: np.ndarray, b: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some pairs, in both directions, the one with the highest share of each first node."""
    a, b, share = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([share, share])
    order = np.lexsort((b, -share, a))
    keep = order[np.concatenate([[True], a[order][1:] != a[order][:-1]])] if len(order) else order
    return a[keep], b[keep], share[keep]


MEMBERS = ("node", "n", "component", "left", "point")


def _tile_pairs(tiles: DataFrame, percent: int) -> DataFrame:
    """The members of two tiles of one tree, a row for each pair of tiles that can hold a link across components.

    Pairs are first made of numbers only, each tile naming those after it, and go by what their sizes and components allow; what is left fetches the members by tree and tile, so no
    tree is one key, however many sets it has.
    """
    about = tiles.select("cell", "tiles", F.col("tile"), F.array_min("n").alias("few"), F.array_max("n").alias("many"), F.array_min("component").alias("low"), F.array_max("component").alias("high"))
    first = about.filter(F.col("tile") + 1 < F.col("tiles")).select("cell", *[F.col(c).alias(f"{c}_x") for c in ("tile", "few", "many", "low", "high")], F.explode(F.sequence(F.col("tile") + 1, F.col("tiles") - 1)).alias("tile_y"))
    then = about.select("cell", *[F.col(c).alias(f"{c}_y") for c in ("tile", "few", "many", "low", "high")])
    sizes = (100 * F.col("many_x") >= percent * F.col("few_y")) & (100 * F.col("many_y") >= percent * F.col("few_x"))
    one = (F.col("low_x") == F.col("high_x")) & (F.col("low_y") == F.col("high_y")) & (F.col("low_x") == F.col("low_y"))
    named = first.join(then, ["cell", "tile_y"]).filter(sizes & ~one).select("cell", "tile_x", "tile_y")
    members = {k: tiles.select("cell", F.col("tile").alias(f"tile_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in MEMBERS]) for k in "xy"}
    both = named.join(members["x"], ["cell", "tile_x"]).join(members["y"], ["cell", "tile_y"])
    return both.select(*[f"{c}_{k}" for k in "xy" for c in MEMBERS])


def search(sets: DataFrame, grown: DataFrame, percent: int, best_only: bool) -> DataFrame:
    """Pairs (a, b), a < b, across the components ``grown`` that the forest finds, written; with ``best_only`` the best one of each set."""
    lead = F.size("shared") - F.ceil(F.col("n_shingles") * percent / 100).cast("int") + 1
    # what hasn't been linked is a component of its own
    known = sets.join(_small(grown), F.col("node") == F.col("id"), "left").withColumn("component", F.coalesce("component", "node"))
    entries = known.select("node", F.col("n_shingles").alias("n"), "component", F.col("coarse").alias("point"), (F.size("shared")).alias("_size"), F.posexplode(F.slice("shared", 1, lead)).alias("_place", "cell"))
    mixed = entries.groupBy("cell").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count("*").alias("_members")).filter("_low < _high")
    mixed = materialize(mixed.select("cell", F.ceil(F.col("_members") / TILE).alias("tiles")), "jaccard-roots")
    # an entry's place says how much of its set can still be shared from there on
    held = entries.withColumn("left", F.col("_size") - F.col("_place")).join(mixed, "cell").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
    tiles = held.groupBy("cell", "tiles", "tile").agg(F.collect_list(F.struct(*MEMBERS)).alias("m"))
    tiles = materialize(tiles.select("cell", "tiles", "tile", *[F.col(f"m.{c}").alias(c) for c in MEMBERS]), "jaccard-tiles")
    single = tiles.select(*MEMBERS)
    double = _tile_pairs(tiles, percent) if mixed.filter("tiles > 1").limit(1).count() else None

    def pairs_of(found):
        a, b, share = best_partners(*found) if best_only else found
        return pd.DataFrame({"a": a, "b": b, "share": share})

    def alone(batches):
        for pdf in batches:
            found = []
            for row in pdf.itertuples(index=False):
                if len(row.node) <= LEAF:
                    pairs = leaf_pairs(*row, percent)
                else:
                    t = Tile(*row)
                    pairs = tile_pairs(t, t, percent)
                if len(pairs[0]):
                    found.append(pairs)
            if found:
                yield pairs_of([np.concatenate(x) for x in zip(*found, strict=True)])

    def together(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield pairs_of(tile_pairs(Tile(*row[:5]), Tile(*row[5:]), percent))

    pairs = single.mapInPandas(alone, "a long, b long, share double")
    if double is not None:
        pairs = pairs.union(double.mapInPandas(together, "a long, b long, share double"))
    if best_only:
        pairs = pairs.groupBy("a").agg(F.max(F.struct("share", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    out = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-pairs")
    release(mixed, tiles)
    return out


def join(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_copies): n_copies is the number of documents with the same shingle set."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent = documents.sparkSession.sparkContext.broadcast(frequent_shingles(docs, width))
    outline = materialize(outlines(docs, frequent, width, percent), "jaccard-outlines")
    rows = materialize(outline.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")), "jaccard-rows")
    within = shared(outline.select("node", F.explode("head").alias("shingle"))).groupBy("node").agg(F.count("*").alias("n_shared"))
    classes = outline.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"), F.first("n_shingles").alias("n"), F.max("n_frequent").alias("n_frequent"))
    least = F.ceil(F.col("n") * percent / 100)
    least = F.greatest(F.lit(1), F.least(F.ceil(least * percent / 100), F.floor(least * EXTRA / 100)))
    enough = F.coalesce("n_shared", F.lit(0)) + F.col("n_frequent") >= least
    classes = materialize(classes.join(within, "node", "left").select("node", "doc_id", "n_copies", enough.alias("may")), "jaccard-classes")
    release(outline)
    sets = survivors(docs, classes.filter("may").select("node", "doc_id"), frequent, width, percent)

    n = sets.count()
    links = near_links(sets, n, percent)
    best_only, more = True, n
    while more:
        pairs = search(sets, components(links), percent, best_only)
        found = materialize(verified(pairs, sets, percent), "jaccard-found")
        # while best partners still link many sets, the step for all pairs would list most links of large groups
        more, best_only = best_only, best_only and found.count() * SETTLED > n
        longer = materialize(links.union(found), "jaccard-links")
        release(links, pairs, found)
        links = longer
    final = components(links)
    release(links, sets)
    grouped = classes.join(final, classes.node == final.id, "left").select("node", "doc_id", "n_copies", F.coalesce("component", "node").alias("component"))
    smallest = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = grouped.join(smallest, "component").select("node", "n_copies", "component_id")
    return rows.join(of_node, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
