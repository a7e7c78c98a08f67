"""Brute force and corner cases for ranked search, byte-level BPE and importance resampling."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from peerlight.llm import bpe, lexical, queries, resample

DOCS = "doc_id long, text string, score string, rank string, item string, _b string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCAB = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "naïve", "x1", "7"]


def corpus(n=300, seed=3):
    """Texts of Zipf words, copies, ties, nulls, empty and long texts, repeated rows, columns with clashing names."""
    r = random.Random(seed)
    word = lambda: VOCAB[min(int(r.paretovariate(0.7)) - 1, len(VOCAB) - 1)]
    rows = [(i, " ".join(word() for _ in range(r.randrange(1, 50)))) for i in range(n)]
    rows += [(1000 + i, "w50 w51, W52; w53 w54") for i in range(15)] + [(7, "w50 w51"), (7, "w50 w51"), (None, "w50 w51 w52 w53 w54"), (2000, None), (2001, ""), (2002, " .,\n"), (2003, " ".join(word() for _ in range(20_000)))]
    return [(i, t, "a", "b", "c", "d") for i, t in rows]


ITEMS = [(0, "w50 w51 w52 w53 w54 w54"), (1, " ".join(VOCAB)), (2, "w0 w1 w2 x1"), (3, None), (4, ""), (5, "nowhere else"), (6, "Été, naïve 7 w3 w55 w56 w57"), (6, "w1 w0"), (None, "w59")]


def slow_rank(docs, items, k=10):
    texts = [(i, TERM.findall((t or "").translate(LOWER))) for i, t, *_ in docs]
    texts = [(i, t) for i, t in texts if t]
    n, length = len(texts), sum(len(t) for _, t in texts)
    df = Counter(x for _, t in texts for x in set(t))
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        found = []
        for i, t in texts:
            tf, m = Counter(t), 100 - 75 + (75 * len(t) * n) // length
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1000000000 * tf[x]) // (1000 * tf[x] + 8 * m)) for x, c in asked.items() if tf[x])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_rows, group_bytes, k", [(4096, 1 << 20, 10), (7, 40, 3), (1, 1, 1)])
def test_ranked_search(spark, block_rows, group_bytes, k):
    docs = corpus()
    found = lexical.rank(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(ITEMS, "item_id long, text string"), k, group_bytes, block_rows)
    assert sorted(map(tuple, found.collect()), key=str) == slow_rank(docs, ITEMS, k)


def test_ranked_search_of_nothing(spark):
    docs, items = spark.createDataFrame(corpus(20), DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.rank(docs.limit(0), items).count() == 0
    assert lexical.rank(docs, items.limit(0)).count() == 0
    assert lexical.rank(docs.filter("doc_id between 2000 and 2002"), items).count() == 0


def test_accumulators_stop_but_scores_are_exact():
    """With bounds that are tight, most documents never get an accumulator, and the best are those of a full scan."""
    r = np.random.default_rng(1)
    for _ in range(50):
        n = int(r.integers(5, 200))
        terms = [np.unique(r.integers(0, 30, int(r.integers(1, 12)))) for _ in range(n)]
        counts = [r.integers(1, 5, len(t)) for t in terms]
        block = lexical.Block(list(range(n)), [10] * n, [t.tolist() for t in terms], [c.tolist() for c in counts], n, 10 * n)
        query = [(int(t), int(w), int(w) * 1_000_000) for w, t in sorted(((int(x) ** 4, t) for t, x in enumerate(r.integers(1, 20, 30))), reverse=True)]
        full = np.zeros(n, "i8")
        for t, w, _ in query:
            if t in block.spans:
                a, b = block.spans[t]
                full[block.place[a:b]] += w * block.impact[a:b]
        want = [i for i in np.lexsort((np.arange(n), -full)) if full[i] > 0][:5]
        places, scores = block.search(query, 5, 1)
        assert places.tolist() == want and scores.tolist() == full[want].tolist()


def encoding():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(), special_tokens={})


def odd_texts():
    r = random.Random(5)
    letters = "a \n\t\r\x1c\x1f\x85\xa0 　​'stredvmlTHE019,.!-_éñ中文ไท\U0001f600\x00٣Ⅷ²́"
    return ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(600)] + ["a" * 3000, " " * 700 + "b", "\n" * 300, " 　 x", "xxx     y", "", None, "<|endoftext|> and more", "It's we'll THEY'RE 'tis"]


@pytest.mark.parametrize("words", [65_536, 5, 0])
def test_byte_bpe_is_that_of_tiktoken(spark, words):
    texts, enc = odd_texts(), encoding()
    df = spark.createDataFrame([(None if i % 50 == 0 else i, t, i) for i, t in enumerate(texts)] + [(3, texts[3], 3)], "doc_id long, text string, n int")
    rows = bpe.decode(bpe.encode(df, words=words)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert list(r.ids) == enc.encode_ordinary(texts[r.n] or "")
        assert bytes(r.bytes) == (texts[r.n] or "").encode()
    assert bpe.digest(bpe.encode(df.limit(0))).count() == 0


@pytest.mark.parametrize("room", [400_000, 40])
def test_byte_bpe_folds_every_word(spark, room):
    """Words outside the table are folded too, also when a task forgets words and meets them again; no other engine merges."""
    assert "tiktoken" not in re.findall("(?m)^ *(?:import|from) +([a-z_]+)", open(bpe.__file__).read())
    texts = [t or "" for t in odd_texts()] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    enc = encoding()
    assert {r.doc_id: list(r.ids) for r in bpe.encode(df, words=20, room=room).collect()} == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}


def test_folded_words(spark):
    """Higher-order functions against tiktoken's merges, word by word; long words and runs of one byte too."""
    r, enc = random.Random(9), encoding()
    words = {w for t in odd_texts() if t for w in bpe._pattern().findall(t) if len(w) < 400} | {"".join(r.choice("abth ") for _ in range(r.randrange(1, 30))) for _ in range(300)} | {"ab" * 150, "中" * 40}
    found = bpe.encode_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert {x.word: list(x.ids) for x in found} == {w: enc._encode_single_piece(w.encode()) for w in words}


def test_byte_bpe_holds_its_table_in_one_python_step(spark):
    """The step after the fold gets numbers, no texts and no table, and tokens are joined without Python: so an executor's workers stay small."""
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = bpe.digest(bpe.encode(df, words=5))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow put_together") == plan.count("MapInArrow split_texts") == 1 and "EvalPython" not in plan
    after, before = plan.split("MapInArrow split_texts")
    assert "text#" not in after and "text#" in before
    with pytest.raises(Exception, match="vocabulary lacks"):
        bpe.decode(spark.createDataFrame([([0, 60_000],)], "ids array<int>")).collect()


@pytest.mark.parametrize("token, rank", [(b"a" * 256, 5), (b"ab", (1 << 18) - 1)])
def test_vocabularies_that_do_not_fit_the_fold_are_refused(monkeypatch, token, rank):
    monkeypatch.setattr(bpe, "ranks", lambda _: {token: rank})
    with pytest.raises(ValueError, match="don't fit"):
        bpe.constants("large")


def test_the_fold_looks_up_numbers(spark):
    """Every pair of tokens that a merge joins has its rank in the slots, other pairs have none; no step of the fold cuts or hashes strings."""
    of, r = bpe.ranks(), random.Random(2)
    pairs = bpe.merges(of)
    slots, shifts = bpe.pair_slots(pairs, len(of))
    found = lambda a, b: min(int(slots[(shifts[a] + b) % len(slots)]) ^ (a << bpe.RANK), bpe._NONE)
    assert len(pairs) == len(of) - 256 and all(found(*p) == rank for p, rank in pairs.items())
    assert all(found(*p) == pairs.get(p, bpe._NONE) for p in ((r.randrange(len(of)), r.randrange(len(of))) for _ in range(20_000)))
    plan = bpe.encode_words(spark.createDataFrame([("a",)], "word string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and "crc32(" not in plan and "substring(" not in plan


@pytest.mark.parametrize("more", [{b"abc": 256}, {b"bc": 257, b"abc": 256}, {b"ab": 256, b"bc": 257, b"abcd": 258}])
def test_vocabularies_whose_merges_do_not_end_with_their_tokens_are_refused(monkeypatch, more):
    monkeypatch.setattr(bpe, "ranks", lambda _: {bytes([i]): i for i in range(256)} | more)
    with pytest.raises(ValueError, match="don't fit"):
        bpe.constants("odd")


def test_table_of_words_is_no_rows_on_the_driver(spark, monkeypatch):
    """Python objects of a quarter of a million words are kept off the driver, whose memory is limited; workers make them."""
    df = spark.createDataFrame([(1, "a b a thxe")], "doc_id long, text string")
    with monkeypatch.context() as m:
        m.setattr(type(df), "collect", None)
        encoded = bpe.encode(df, words=5)
    assert list(encoded.first().ids) == encoding().encode_ordinary("a b a thxe")
    words = pa.table({"word": ["a", "", " b"], "ids": pa.array([[7], [], [8, 9]], pa.list_(pa.int32()))})
    assert {w: np.frombuffer(x, "i4").tolist() for w, x in bpe.ids_by_word(words).items()} == {"a": [7], "": [], " b": [8, 9]}


def test_numbers_of_new_words_become_their_ids():
    table = {"a": np.array([7], "i4").tobytes(), " b": np.array([8, 9], "i4").tobytes()}
    known = bpe.Known(table)
    known.start(2)
    rows, words = [], []
    for t in ("a b cc b", "", "a dd cc", "a ee dd b", "a cc"):
        rows.append(known.ids(t).tolist())
        words.append(known.taken())
    assert rows == [[7, 8, 9, -1, 8, 9], [], [7, -2, -1], [7, -3, -4, 8, 9], [7, -5]]  # a word that was forgotten gets a second number
    flat = [w for x in words for w in x]
    assert flat == [" cc", " dd", " ee", " dd", " cc"]
    ids_of = {w: list(range(100 * k, 100 * k + k % 3 + 1)) for k, w in enumerate(sorted(set(flat)), 1)}
    held, got = bpe.Folded(), []
    for at in (slice(0, 2), slice(2, 3), slice(3, 5)):
        held.learn(pa.array([ids_of[w] for x in words[at] for w in x], pa.list_(pa.int32())))
        got += held.put(pa.array(rows[at], pa.list_(pa.int32()))).to_pylist()
    assert got == [[j for i in r for j in (ids_of[flat[-1 - i]] if i < 0 else [i])] for r in rows]


def test_stretches_are_split_as_by_the_pattern():
    """Also where marks, line feeds, apostrophes and other letters make the short way doubtful, and no short way is missed where texts are plain."""
    r, calls = random.Random(4), []
    letters = "ab'st.,!$_\n\t é中9 \u0308\x85\x1c-"
    assert all(bpe.words_of(t) == bpe._pattern().findall(t) for t in (" " + "".join(r.choice(letters) for _ in range(r.randrange(9))) for _ in range(50_000)))
    plain = [" a", " a.", " élan!!", " a,$$$", " a.\nB", " a.\nB,", " a\nB!!"]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(bpe, "_pattern", lambda: calls.append(1))
        assert [bpe.words_of(t) for t in plain] == [[" a"], [" a", "."], [" élan", "!!"], [" a", ",$$$"], [" a", ".", "\n", "B"], [" a", ".", "\n", "B", ","], [" a", "\n", "B", "!!"]]
    assert not calls
    assert bpe.numbers_in(pa.array([b"", np.array([3, -1], "i4").tobytes()], pa.binary())).to_pylist() == [[], [3, -1]]


def test_split_is_the_same_in_both_engines(spark):
    texts = [t for t in odd_texts() if t]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", bpe.split(F.col("text")).alias("w")).collect()
    assert all(x.w == bpe._pattern().findall(texts[x.i]) for x in rows)


def slow_resample(docs, target, longest=1, size=10_000, percent=10, least=20):
    def features(t):
        w = FEATURE.findall((t or "").translate(LOWER))
        return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    b = lambda f: zlib.crc32(f.encode()) % size
    s, t = Counter(b(f) for _, x, *_ in docs for f in features(x)[1]), Counter(b(f) for x in target for f in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * (n_s + size) / ((s[k] + 1) * (n_t + size)))) for k in s}
    rows = []
    for place, (i, x, *_) in enumerate(docs):
        w, f = features(x)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b(y)] for y in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w), place])
    enough = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[6]))
    for k, r in enumerate(enough[: percent * len(enough) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("longest, percent", [(1, 10), (2, 35), (3, 100), (1, 0)])
def test_importance_resampling(spark, longest, percent):
    docs, target = corpus(), ["w50 w51 Was-it w52?", None, "", "w1 w2 w3 w50"]
    docs += [(5000 + i, " ".join(["same words"] * 15), "", "", "", "") for i in range(40)] + [(9, " ".join(["same words"] * 15), "", "", "", "")] * 30 + [(None, "w1 " * 30, "", "", "", "")] * 3
    got = resample.resample(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(t, 1) for t in target], "text string, _b int"), longest=longest, percent=percent)
    assert sorted(map(tuple, got.collect()), key=str) == slow_resample(docs, target, longest, percent=percent)


def test_importance_resampling_of_nothing(spark):
    docs = spark.createDataFrame(corpus(10), DOCS)
    assert resample.resample(docs.limit(0), docs.limit(0)).count() == 0
    assert {r.rank for r in resample.resample(docs.filter("doc_id >= 2000 and doc_id < 2003"), docs.limit(0)).collect()} == {None}


def test_brackets_hold_the_rank_however_rough_the_sketch(spark):
    r = random.Random(4)
    for values in ([r.randrange(-500, 500) for _ in range(400)], [5] * 300 + [1, 9], list(range(1000))):
        scores, ordered = spark.createDataFrame([(v,) for v in values], "score long").cache(), sorted(values, reverse=True)
        for wanted in (1, 2, len(values) // 3, len(values)):
            for accuracy in (2, 10_000):
                low, high, above = resample.bracket(scores, wanted, len(values), accuracy)
                assert low <= ordered[wanted - 1] <= high and above == sum(v > high for v in values) < wanted


@pytest.mark.parametrize("name", ["op11_ranked_search", "op13_importance_resampling"])
def test_queries_equal_their_sql(spark, tmp_path, name):
    spark.createDataFrame([(i, t) for i, t, *_ in corpus(120) if i is not None], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([x for x in ITEMS if x[0] is not None], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path))
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_byte_bpe_query(spark, tmp_path):
    spark.createDataFrame(list(enumerate(odd_texts())), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    enc, texts = encoding(), odd_texts()
    for r in queries.op12_byte_bpe(spark, str(tmp_path)).collect():
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())
