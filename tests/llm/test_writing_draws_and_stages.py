"""Archives that are written twice, draws of rows without an id, trees of many tiles, the rule learner and pipeline stages against plain programs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from peerlight.llm import jaccard, mixing, rules, warc
from peerlight.llm.common import new_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def pages(spark, ids, html="x"):
    return warc.records_of_pages(spark.createDataFrame([(i, f"https://e.com/{i}", f"{html}{i}") for i in ids], "page_id long, url string, html string"))


def read_ids(spark, path):
    return sorted(r.page_id for r in warc.pages_of_records(spark, path).collect())


def test_a_second_write_adds_and_an_overwrite_replaces(spark):
    path = new_path(spark, "warc-twice")
    warc.write(pages(spark, [1, 2]), path)
    warc.write(pages(spark, [3]), path)
    assert read_ids(spark, path) == [1, 2, 3]
    warc.write(pages(spark, []), path)
    assert read_ids(spark, path) == [1, 2, 3]
    warc.write(pages(spark, [1]), path)  # the same page again is another record
    assert read_ids(spark, path) == [1, 1, 2, 3]
    warc.write(pages(spark, [7, 8]), path, "overwrite")
    assert read_ids(spark, path) == [7, 8]
    system, folder = warc._open(path)
    from pyarrow.fs import FileSelector

    names = [f.base_name for f in system.get_file_info(FileSelector(folder))]
    assert sum(n.endswith(".warc.gz") for n in names) == len(warc.listed(system, warc.manifests(system, folder))) and sum(n.endswith(".json") for n in names) == 1


def test_rows_without_an_id_draw_each_for_itself(spark):
    """Null ids and one id for many texts: every source still comes near its target."""
    r = random.Random(3)
    rows = [(None if i % 2 else 5, " ".join(f"w{r.randrange(10**6)}" for _ in range(4)), "en", f"s{i % 3}", 1) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), extra=("source",)).toPandas()
    for _, part in got.groupby("source"):
        target = part.target.iloc[0]
        assert abs(part.taken.sum() - target) < 0.1 * target
    assert (got.taken <= 2 * got["size"]).all()


def test_a_tree_of_many_tiles_deals_its_pairs(spark, monkeypatch):
    """One shingle in 1,200 sets of four sizes: pairs of tiles spread over keys, and those that no link can lie in aren't made."""
    monkeypatch.setattr(jaccard, "TILE", 16)
    rows = [(i, "common start of every single text " + " ".join(f"t{i % 4}x{i}y{k}" for k in range((5, 12, 30, 80)[i % 4]))) for i in range(1200)]
    rows += [(5000, rows[7][1] + " tail"), (5001, rows[7][1])]
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[5000] == got[5001] == 7 and all(got[i] == i for i in range(1200))


def test_tile_pairs_are_bounded_by_sizes_and_components(spark):
    n = 40
    tiles = spark.createDataFrame([(9, n, t, [t], [10 if t < n // 2 else 100], [t // 4], [5], [b"x"]) for t in range(n)], "cell long, tiles long, tile long, node array<long>, n array<int>, component array<long>, left array<int>, point array<binary>")
    made = {(r.node_x[0], r.node_y[0]) for r in jaccard._tile_pairs(tiles, 80).collect()}
    assert made == {(x, y) for x in range(n) for y in range(x + 1, n) if (x < n // 2) == (y < n // 2) and x // 4 != y // 4}


def plain_learner(rows, cuts, target=0, most_conditions=3, most_rules=8, least_cover=5, least_precision=0.8):
    """Sequential covering row by row: ``rows`` are (features, y, held)."""
    covered = lambda rule, x: all((x[f] >= t) if up else (x[f] < t) for f, up, t in rule)
    out = []
    while len(out) < most_rules:
        left = [r for r in rows if not any(covered(rule, r[0]) for rule in out)]
        grown = []
        while len(grown) < most_conditions:
            now = [r for r in left if covered([c for c, _ in grown], r[0])]
            p0, n0 = sum(y == target and not h for _, y, h in now), sum(y != target and not h for _, y, h in now)
            if not p0 or not n0:
                break
            best = None
            for f in rules.FEATURES:
                for t in cuts[f]:
                    for up in (False, True):
                        inside = [(y == target, h) for x, y, h in now if covered([(f, up, t)], x)]
                        p, n = inside.count((True, False)), inside.count((False, False))
                        if p >= least_cover:
                            gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                            if gain > 1e-9 and (best is None or gain > best[0]):
                                hp, hn = inside.count((True, True)), inside.count((False, True))
                                best = gain, (f, up, t), (hp + 1) / (hp + hn + 2), not n and not hn
            if best is None:
                break
            grown.append(best[1:3])
            if best[3]:
                break
        if not grown:
            break
        keep = max(range(len(grown)), key=lambda i: (grown[i][1], -i))
        if grown[keep][1] < least_precision:
            break
        out.append([c for c, _ in grown[: keep + 1]])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_learned_rules_are_those_of_a_plain_learner(spark, seed):
    r = random.Random(seed)
    data = []
    for i in range(400):
        x = [round(r.random(), 2) for _ in rules.FEATURES]
        bad = (x[0] > 0.8 and x[1] < 0.5) or x[2] > 0.92 or r.random() < 0.03
        data.append((i, int(not bad), *x))
    stats = spark.createDataFrame(data, ["doc_id", "y", *rules.FEATURES])
    shares = [(i + 0.5) / 24 for i in range(24)]
    found = stats.agg(*[F.percentile_approx(f, shares, 1000).alias(f) for f in rules.FEATURES]).first()
    held = {x.doc_id: x.h for x in stats.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) == 0).alias("h")).collect()}
    want = plain_learner([(dict(zip(rules.FEATURES, d[2:])), d[1], held[d[0]]) for d in data], {f: sorted(set(found[f])) for f in rules.FEATURES})
    got = rules.learn(stats)
    assert [[(c.feature, c.at_least, c.threshold) for c in rule] for rule in got] == want and want


def corpus(spark):
    r = random.Random(11)
    rows = [(None if i % 17 == 0 else i, " ".join(r.choice(["alpha", "beta", "gämma", "<|endoftext|>", "7"]) for _ in range(r.randrange(1, 60))), "en", r.choice(["a", "b", None]), 9) for i in range(150)]
    rows += [(200, None, None, None, None), (201, "", "en", "a", 0), rows[3], rows[3], (202, "long " * 3000, "en", "b", 1)]
    return spark.createDataFrame(rows, DOCS), rows


def test_mixing_stage_is_that_of_a_plain_program(spark):
    docs, rows = corpus(spark)
    sizes = defaultdict(int)
    for row in rows:
        sizes[row[3]] += len(WORD.findall(row[1] or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, full, total = {}, set(), 1.5 * sum(sizes.values())
    while True:  # share, cap, share the rest anew
        rest = total - sum(2 * sizes[s] for s in full)
        level = rest / sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    for s in names:
        target[s] = 2.0 * sizes[s] if s in full else level * weight[s]
    want = Counter()
    for row in rows:
        rate = target[row[3]] / sizes[row[3]]
        key = f"mix:{'' if row[0] is None else row[0]}:{hashlib.md5((row[1] or '').encode()).hexdigest()}"
        draw = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) / (1 << 32)
        want[row] += math.floor(rate) + (draw < rate - math.floor(rate))
    got = Counter(map(tuple, corpus_pipeline.mixing_stage(spark, docs, "").collect()))
    assert got == +want


def test_packing_stage_is_that_of_the_tokenizer(spark):
    docs, rows = corpus(spark)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for row in rows:
        ids = np.array([*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        ends = [first, *range(first + 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip([0, *ends], ends)):
            want[row[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got = corpus_pipeline.packing_stage(spark, docs, "").collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_large_groups_of_near_copies_are_mostly_linked_before_the_search(spark, monkeypatch):
    """Copies of one text with two or three replaced words; some with nine come first by hash and make bad centres."""
    draw = random.Random(4)
    base = [f"b{i}" for i in range(300)]
    spoilt = lambda tag, k: " ".join({p: f"{tag}x{p}" for p in draw.sample(range(300), k)}.get(i, w) for i, w in enumerate(base))
    texts = [spoilt(f"c{i}", 2 + i % 2) for i in range(150)]
    lowest = min(jaccard.node_of(jaccard.shingles(t)) for t in texts)
    bad = (t for t in (spoilt(f"d{i}", 9) for i in range(100_000)) if jaccard.node_of(jaccard.shingles(t)) < lowest)
    texts += [next(bad) for _ in range(6)]
    sets = [set(jaccard.shingles(t).tolist()) for t in texts]
    linked = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    found, left = {0}, [0]
    while left:
        at = left.pop()
        new = {i for i in range(len(sets)) if i not in found and linked(sets[at], sets[i])}
        found |= new
        left += new
    assert len(found) > 140
    before, search = [], jaccard.search
    monkeypatch.setattr(jaccard, "search", lambda sets, grown, *a: (before.append(grown.groupBy("component").count().collect()), search(sets, grown, *a))[1])
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: 0 if i in found else i for i in range(len(texts))}
    assert max((r["count"] for r in before[0]), default=0) > 0.8 * len(found)
