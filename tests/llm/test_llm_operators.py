"""Brute force, round trips and corner cases for the training-data operators."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peerlight.llm import common, jaccard, language, mixing, packing, passages, pii, rules, topk, toxicity, warc
from peerlight.llm.common import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EN = "the cat and the dog with that thing were there when they then thought of this other weather".split()
FR = "le chat et les chiens avec une autre chose pour que nous soyons dans cette belle maison ou".split()


def text_of(words, r, n):
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Two languages, copies, near copies, long, empty and null texts, nulls in every column, repeated rows."""
    r = random.Random(7)
    rows = []
    for i in range(60):
        en = i % 2 == 0
        t = text_of(EN if en else FR, r, 30 + i) + f" unique{i} token{i * 7} word{i * 13}"
        rows.append((i, t, "en" if en else "fr", f"src{i % 3}", len(t)))
    base = rows[4][1]
    for k in range(20):  # near copies with one word more, one exact copy
        t = base + f" tail{k}" if k else base
        rows.append((100 + k, t, "en", "src0", len(t)))
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(6000))
    rows += [(200, long, "en", "src1", len(long)), (201, None, None, None, None), (202, "", "en", None, 0), (203, "  \n\t ", "en", "src2", 4), (204, "123 456", "fr", "src2", 7), (205, "short text", "en", "src2", 10), (205, "short text", "en", "src2", 10), (206, "short text", None, "src2", 10)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """Columns whose names operators use themselves."""
    return df.withColumns({c: F.lit("x") for c in ("score", "size", "length", "offset", "node", "a", "b", "id", "salt", "pii", "known", "y")})


def test_language(spark, corpus, empty):
    model = language.train(corpus)
    got = {(r.doc_id, r.text): r for r in language.predict(clashing(corpus), model).collect()}
    for (i, t), r in got.items():
        if not t or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif i < 120:
            assert r.lang_pred == r.lang
        assert 0 <= r.score <= 1
    assert language.predict(empty, model).count() == 0
    untrained = language.train(empty)
    assert {r.lang_pred for r in language.predict(corpus, untrained).collect()} == {"und"}


def slow_grams(text):
    """Hashes of the n-grams of a text, one character after the other."""
    c, out = [0, *(ord(x) if x.isalpha() else 0 for x in text.lower()), 0], []
    for n in language.SIZES:
        for i in range(len(c) - n + 1):
            if all(c[i + 1 : i + n - 1]):
                h = n
                for x in c[i : i + n]:
                    h = (h * int(language._MIX[0]) + x * int(language._MIX[1]) + int(language._MIX[2])) % (1 << 64)
                h ^= h >> 32
                h = h * int(language._MIX[3]) % (1 << 64)
                out.append(h ^ h >> 29)
    return out


def test_language_equals_brute_force(spark, corpus):
    """Counts, the choice of n-grams, the bits of the filters, and the corrected shares of every document."""
    rows = [r for r in corpus.collect() if r.text is not None and r.lang is not None]
    counts, total = defaultdict(Counter), Counter()
    for r in rows:
        counts[r.lang].update(slow_grams(r.text))
    repeated = {l: {g: n for g, n in c.items() if n > 1} for l, c in counts.items()}
    total = {l: sum(c.values()) for l, c in repeated.items()}
    bits = np.zeros((1 << 17, len(repeated)), bool)
    model = language.train(corpus, filter_size=300)
    for k, l in enumerate(model.languages):
        apart = [(-n, g - (1 << 64) if g >> 63 else g) for g, n in repeated[l].items() if n / total[l] >= 0.5 * max(c.get(g, 0) / total[m] for m, c in repeated.items())]
        for _, g in sorted(apart)[:300]:
            g %= 1 << 64
            for i in range(3):
                bits[(g + i * (g >> 33 | 1)) % (1 << 17), k] = True
    assert all(np.array_equal(bits[:, k], (model.rows[:, 0] >> np.uint64(k)) & np.uint64(1)) for k in range(len(model.languages)))
    false = bits.mean(0) ** 3
    for r in language.predict(corpus, model).collect():
        grams = slow_grams(r.text or "")
        if not grams:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        hits = np.mean([[all(bits[(g + i * (g >> 33 | 1)) % (1 << 17), k] for i in range(3)) for k in range(bits.shape[1])] for g in grams], axis=0)
        share = np.clip((hits - false) / (1 - false), 0, 1)
        assert r.lang_pred == model.languages[int(share.argmax())] and r.score == pytest.approx(share.max() / max(share.sum(), 1e-12)) and r.known == pytest.approx(share.max())


def test_language_many_languages_share_one_lookup():
    names = [f"l{i:02}" for i in range(70)]
    model = language.LanguageFilters(names, np.zeros((1 << 12, 2), np.uint64), np.zeros(70), 3)
    h = language.ngrams(["bonjour"])[0]
    for p in model.positions(h):
        model.rows[p, 1] |= np.uint64(1) << np.uint64(5)
    assert model.predict(["bonjour"])[0][0] == 69


def test_token_ids_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    r = random.Random(3)
    texts = ["", " ", "a  b\n\n c\t", "don't we'll I'M", "éè中文 \U0001f600‍ x", "<|endoftext|>", "0123 4567890", "x" * 500]
    texts += ["".join(r.choice("ab C\n\té中😀' 　.,!19_-") for _ in range(40)) for _ in range(400)]
    for s in texts:
        assert packing.token_ids(s).tolist() == [*t.encode(s, add_special_tokens=False).ids, 2]


def test_packed_ids_hold_the_added_token(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(5)
    texts = ["a<|endoftext|>b", " <|endoftext|> ", "x  <|endoftext|>\n\n<|endoftext|><|endoftext|", "<|endoftext|>", "<|ENDOFTEXT|>", ""]
    texts += ["".join(r.choice(["<|endoftext|>", "<|", "|>", " ", "  ", "\n", "it's", "é", "中", "7", "word"]) for _ in range(30)) for _ in range(300)]
    want = set()
    for i, s in enumerate(texts):
        ids = np.array([*t.encode(s, add_special_tokens=False).ids, 2], "<u4")
        assert packing.document_ids(s).tolist() == ids.tolist()
        want.add((i, 0, 0, len(ids), zlib.crc32(ids.tobytes())))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.pack(docs, capacity=1024).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert set(map(tuple, got)) == want and len(got) == len(texts)


def best_fit(lengths, capacity):
    """Sequences that plain best-fit decreasing opens."""
    gaps, opened = [], 0
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            opened += 1
            gaps.append(capacity - n)
    return opened


def test_packing(spark, corpus, empty):
    got = packing.pack(clashing(corpus), capacity=128).toPandas()
    want = Counter()
    for r in corpus.collect():
        ids = packing.token_ids(r.text)
        n, at, k = len(ids), 0, 0
        while at < n:
            size = (n - 1) % 128 + 1 if k == 0 else 128
            want[(r.doc_id, k, at, size, zlib.crc32(ids[at : at + size].tobytes()))] += 1
            at, k = at + size, k + 1
    assert Counter(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]]
        assert seq.length.sum() <= 128
    assert got.sequence_id.nunique() <= 1.03 * best_fit(got.length, 128)
    assert (got[got.length == 128].sequence_id < 0).all() and (got[got.length < 128].sequence_id >= 0).all()
    assert got[got.length == 128].sequence_id.is_unique
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_packing_plan_places_every_piece_once(seed):
    r = random.Random(seed)
    capacity = r.choice([8, 64, 1024])
    counts = Counter(min(capacity, 1 + int(r.expovariate(1 / (capacity * 0.3)))) for _ in range(r.choice([1, 40, 3000])))
    seq, ranks = defaultdict(list), defaultdict(list)
    for length, first, n, s, offset in packing.plan(counts, capacity):
        for i in range(n):
            seq[s + i].append((offset, length))
            ranks[length].append(first + i)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for places in seq.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity


def base_statistics(t):
    w = WORD.findall(t or "")
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    repeated = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(repeated)


def test_rule_statistics(spark, corpus, empty):
    odd = ["a b c d e a b c d e", "x\nx\n\n \nx y", "é# *b*", "w " * 50, "a b c d e f a b c d e g b c d e f", "one two three", "a\r\nb\r\na\r\n"]
    more = corpus.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = rules.statistics(more.withColumn("n_words", F.lit("clash"))).collect()
    for r in got:
        w = base_statistics(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == w
        assert r.base_failed == (w[0] < 10 or 100 * w[4] > 20 * w[0])
    assert rules.statistics(empty).count() == 0


def test_rules_learn_planted_conditions(spark):
    r = random.Random(1)
    rows = []
    for i in range(600):
        symbols = r.random() * 0.4 if i % 5 == 0 else r.random() * 0.02
        words = r.choice([3.0, 5.0, 9.0])
        rows.append((i, int(not (symbols > 0.05)), symbols, 0.1, 0.0, words, 0.9, 0.0, 0.0))
    stats = spark.createDataFrame(rows, "doc_id long, y int, " + ", ".join(f"{f} double" for f in rules.FEATURES))
    learned = rules.learn(stats)
    assert learned and learned[0][0].feature == "symbol_ratio" and learned[0][0].at_least
    kept = stats.select("y", rules.verdict(learned).alias("kept")).toPandas()
    assert (kept.kept == (kept.y == 1)).mean() > 0.97
    assert rules.learn(stats.filter("y = 1")) == [] and rules.learn(stats.limit(0)) == []


def brute_pii(t):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans_equal_the_patterns():
    r = random.Random(1)
    texts = ["4111 1111-1111 1111 and 1.2.3.4.5.6.7.8", "a@b.c_d@e.f.g", "x@y.z@w.v", "+1 (234) 567-8901", "é 300.1.1.1.2", "mail: a.b+c@d-e.org.", None, ""]
    texts += ["".join(r.choice("ab1 2.@+-()9.%") for _ in range(r.randint(0, 60))) for _ in range(5000)]
    for t in texts:
        assert pii.base_spans(t) == brute_pii(t)


def test_pii_terms_and_digest(spark, corpus, empty, monkeypatch):
    rows = [(i, f"report {i} filler{i} about zanzibarian at kim@corp.example tail{i} some{i} other{i}", "en", "s", 1) for i in range(5)]
    rows += [(50 + i, f"plain words about nothing number {i}", "en", "s", 1) for i in range(200)] + [(400, "again zanzibarian alone", "en", "s", 1), (401, None, "en", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    for block in (200_000, 1):  # one pass, and a pass for each block
        monkeypatch.setattr(pii, "BLOCK", block)
        terms = {r.term for r in pii.disclosing_terms(docs, least_bits=3.0).collect()}
        assert "zanzibarian" in terms and "about" not in terms
        got = {r.doc_id: r for r in pii.digest(pii.find(docs, least_bits=3.0)).collect()}
        assert "term:6:17" in got[400].spans.split(",") and got[401].spans == ""
        for i, t, *_ in rows:
            text = ",".join(f"{k}:{s}:{e}" for k, s, e in brute_pii(t))
            assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
            assert got[i].spans.startswith(text)
    clean = {r.doc_id: r for r in pii.sanitize(docs, least_bits=3.0).collect()}
    assert "kim@corp" not in clean[0].text and "[EMAIL]" in clean[0].text and "zanzibarian" not in clean[0].text
    assert clean[50].text == rows[5][1] and clean[401].text is None and clean[0].n_chars == len(clean[0].text)
    assert pii.find(empty).count() == 0 and pii.find(clashing(corpus)).count() == corpus.count()


def test_pii_terms_of_entities_that_occur_once_or_twice(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(9))
    far = lambda t: f"{t} " + " ".join(word() for _ in range(20))
    rows = [(i, far(f"Call the helpdesk {word()}") + f" at u{i}@h{i}.example now") for i in range(8)]  # each address once, 200 characters from the term
    rows += [(20 + i, far("quibblewick") + " card 4111 1111 1111 1111 is held") for i in range(2)]  # one entity in two texts
    rows += [(30, far("onceonly") + " ip 10.0.0.7 seen")] * 4  # one text, repeated: no evidence
    rows += [(100 + i, far("call the office")) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {x.term: x.bits for x in pii.disclosing_terms(docs).collect()}
    assert set(terms) == {"helpdesk", "now", "quibblewick", "card", "held"}
    assert terms["helpdesk"] == pytest.approx(np.log2(2014 / 8)) and terms["quibblewick"] == pytest.approx(np.log2(2014 / 2))
    spans = {x.doc_id: x.spans.split(",") for x in pii.digest(pii.find(docs)).collect()}
    assert all("term:9:17" in spans[i] for i in range(8)) and "term:0:11" in spans[20] and not any("term" in x for x in spans[30] + spans[100])


def test_pii_terms_equal_brute_force(spark, monkeypatch):
    """Counts, shares and the bound on chance, over all terms and entities of a table with copies and repeated ids."""
    monkeypatch.setattr(pii, "HELD", 3)
    r = random.Random(17)
    words = [f"word{c}" for c in "abcdefghijklmnop"]
    rows = []
    for i in range(300):
        kind = i % 10
        t = " ".join(r.choice(words) for _ in range(6))
        if kind == 0:
            t += f" ring hotline at +49 30 {1000000 + i}"
        elif kind == 1:
            t += f" write to agent{'abc'[i % 3]}@corp.example courier{'abc'[i % 3]}"
        rows.append((i // 2, t))
    rows += [rows[0], (None, rows[1][1]), (7, None), (8, "")]
    total, at, docs, texts, holds = len(rows), defaultdict(Counter), Counter(), defaultdict(Counter), Counter()
    seen = set()
    for _, t in rows:
        spans = brute_pii(t)
        outside = "".join(" " if any(s <= k < e for _, s, e in spans) else c for k, c in enumerate(t or ""))
        terms = {x.lower() for x in re.findall(r"[^\W\d_]{3,}", outside)}
        docs.update(terms)
        own = {k for k, _, _ in spans} | {pii.entity(k, t[s:e]) for k, s, e in spans}
        holds.update(own)
        for e in own:
            at[e].update(terms)
            if t not in seen:
                texts[e].update(terms)
        seen.add(t)
    texts_of = {e: len({t for _, t in rows if t and e in {k for k, _, _ in brute_pii(t)} | {pii.entity(k, t[a:b]) for k, a, b in brute_pii(t)}}) for e in at}
    pairs = [(e, w) for e in at for w in at[e] if e in pii.KINDS or texts_of[e] > 1]
    want = {}
    for e, w in pairs:
        rate, share, k, others = holds[e] / total, at[e][w] / docs[w], texts[e][w], docs[w] - at[e][w]
        n = k + others
        bits = (k * np.log2(k / n / rate) + (others * np.log2(others / n / (1 - rate)) if others else 0)) if k / n > rate else 0
        if share >= 0.8 and np.log2(share / rate) >= 2 and bits >= np.log2(len(pairs) / 0.01):
            want[w] = max(want.get(w, 0), np.log2(share / rate))
    got = {x.term: x.bits for x in pii.disclosing_terms(spark.createDataFrame(rows, "doc_id long, text string"), least_bits=2.0).collect()}
    assert {"hotline", "ring"} <= got.keys() and got == pytest.approx(want)


def test_toxicity(spark, empty):
    r = random.Random(2)
    bad = ["slimebag", "gruntface", "dungheap", "wretchlet"]
    rows, labels = [], []
    for i in range(400):
        w = [r.choice(EN) + r.choice(["", "s", "ly", "er"]) for _ in range(80)]
        toxic = i % 4 == 0
        if toxic:
            for k in r.sample(range(80), 6):
                w[k] = r.choice(bad)
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None, None, None, None), (901, "", None, None, 0)], DOCS)
    marks = spark.createDataFrame([*labels, (0, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    held = [(got[i].predicted, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert got[900].predicted == got[901].predicted == 0 and all(0 <= x.score <= 1 for x in got.values())
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.train(docs, marks.limit(0)).scores(["x"]).tolist() == [0.0]


def test_toxicity_finds_few_short_words_in_long_texts(spark):
    """Two short toxic words, in other places of the dictionary than their beginnings' ordinary namesakes, are enough; ordinary words with these beginnings aren't."""
    r = random.Random(4)
    bad, near = ["scab", "louse", "moron", "clot"], ["scale", "loud", "more", "close"]
    rows = []
    for i in range(900):
        w = [r.choice(EN + near) + r.choice(["", "s", "ly", "er"]) for _ in range(120)]
        if i % 5 == 0:
            for k in r.sample(range(120), 2):
                w[k] = r.choice(bad)
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(900)], "doc_id long, toxic int")
    got = {x.doc_id: x.predicted for x in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    held = [(got[i], i % 5 == 0) for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([p for p, y in held if y]) > 0.9 and np.mean([p for p, y in held if not y]) < 0.05


def test_toxicity_does_not_depend_on_partitions(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(EN + FR) + r.choice(["", "ment", "ly"]) for _ in range(60)) + (" wretchlet dungheap slimebag" if i % 3 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(1, None)], "doc_id long, toxic int")
    models = [toxicity.train(docs.repartition(n), labels.repartition(n)) for n in (1, 5)]
    assert models[0].dictionaries == models[1].dictionaries and np.array_equal(models[0].weights, models[1].weights)
    # what the model says is what zstandard's lengths say
    d = models[0].dictionaries
    plain, toxic = d._compressors
    words = rows[0][1].encode().split()
    saved = [len(plain(b" " + b" ".join(words[i : i + d.window]) + b" ")) - len(toxic(b" " + b" ".join(words[i : i + d.window]) + b" ")) for i in range(0, len(words), d.window)]
    assert d.features(rows[0][1])[0] == max(saved) > 3


def test_toxicity_spells_each_word_once_and_together(monkeypatch):
    def one_by_one(words):
        out = b""
        for w in words:
            crc = 0
            for i, letter in enumerate(b" " + w):
                crc = zlib.crc32(bytes((letter,)), crc)
                out += crc.to_bytes(4, "little")[: 1 if i < 4 else 4]
        return out

    r = random.Random(6)
    texts = [" ".join("".join(r.choice("abcé") for _ in range(r.choice([1, 2, 3, 4, 9, 62, 63, 64, 65, 200]))) for _ in range(n)) for n in (0, 1, 7, 8, 9, 500)] + [None, " "]
    words = [toxicity._words(t) for t in texts]
    assert all(toxicity.spelled(w) == one_by_one(w) for w in words)
    data, ends = toxicity.spelled_apart(words[-3])
    assert [data[i:j] for i, j in zip([0, *ends], ends)] == [one_by_one([w]) for w in words[-3]]
    d = toxicity.Dictionaries(b"abc abca aab", b"bbb cccc acacac")
    plain, toxic = d._compressors
    want = [[len(plain(w)) - len(toxic(w)) for w in (b" ".join(x[i : i + 8]) for i in range(0, len(x), 8))] for x in words]
    seen, spell = [], toxicity.spelled_apart
    monkeypatch.setattr(toxicity, "spelled_apart", lambda w: seen.append(len(w)) or spell(w))
    for together in (1 << 16, 100, 1):
        monkeypatch.setattr(toxicity, "TOGETHER", together)
        seen.clear()
        assert [s.tolist() for s in d.savings(texts)] == want
        assert sum(seen) == sum(map(len, words)) and len(seen) <= 1 + sum(map(len, words)) // together


def test_bounded_samples_beyond_a_million_rows_a_class(spark):
    rows = spark.range(3_000_000).select(F.col("id").alias("k"), (F.col("id") % 1000 == 0).cast("int").alias("y"))
    got = dict(map(tuple, common.bounded_sample(rows, F.col("k"), "y", 2).groupBy("y").count().collect()))
    assert 0 < sum(got.values()) < 40
    assert common.bounded_sample(rows.limit(5), F.col("k"), "y", 10).count() == 5 and common.bounded_sample(rows.limit(0), F.col("k"), "y", 10).count() == 0


def test_passage_quality(spark, empty):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(240):
        good = i % 3 != 0
        w = [r.choice(EN + FR) for _ in range(150)]
        if not good:
            w[60:110] = [x.upper() + "!!" for x in w[60:110]]
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame([*rows, (900, None, None, None, None), (901, " \n", None, None, 0)], DOCS)
    schema = "doc_id long, quality int, toxic int"
    model = passages.train(docs, spark.createDataFrame([*labels, (3, None, None), (None, 1, 0)], schema))
    got = {x.doc_id: x for x in passages.score(docs.withColumns({"score": F.lit("clash"), "y": F.lit(1)}), model).collect()}
    held = [(got[i].predicted, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert 0 <= got[900].score == got[901].score <= 1
    assert passages.score(empty, model).count() == 0
    one = passages.train(docs, spark.createDataFrame([x for x in labels if x[1]], schema))
    assert not one.w and one.scores(["x", None]).tolist() == [1.0, 1.0] and passages.train(docs, spark.createDataFrame([], schema)).scores(["x"]).tolist() == [0.0]


def test_very_long_texts(spark):
    """120,000 words, read to the end by every operator that reads texts."""
    r = random.Random(6)
    words = [r.choice(EN) + str(r.randrange(1000)) for _ in range(120_000)]
    text = " ".join(words) + " write to last@corp.example"
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "the cat and the dog with that thing were there", "en", "s", 46)], DOCS)
    lang = {x.doc_id: x.lang_pred for x in language.predict(docs, language.train(docs)).collect()}
    assert lang == {1: "en", 2: "en"}
    pieces = packing.pack(docs.filter("doc_id = 1")).toPandas().sort_values("start")
    ids = packing.document_ids(text)
    assert pieces.length.sum() == len(ids) and [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(pieces.start, pieces.length, strict=True)] == pieces.ids_crc32.tolist()
    stats = rules.statistics(docs).filter("doc_id = 1").first()
    assert (stats.n_words, stats.word_chars, stats.n_symbols, stats.n_dup_lines, stats.n_repeat_words) == base_statistics(text)
    found = pii.digest(pii.find(docs)).filter("doc_id = 1").first()
    assert found.n_email == 1 and found.spans.endswith(f"email:{len(text) - 17}:{len(text)}")
    assert mixing.mix(docs).filter("doc_id = 1").first().size == 120_003
    assert {x.doc_id: x.n_shingles for x in jaccard.join(docs).collect()}[1] == len(shingle_set(text))
    x, bag = passages._encode([text])
    assert len(bag) == -(-120_003 // passages.PASSAGE)
    d = toxicity.Dictionaries(b"the and with that ", b" last@corp.example ")
    assert d.features(text)[0] > 3 and d.features(" ".join(words))[0] <= d.features(text)[0]


def test_passage_gradients():
    r = np.random.default_rng(0)
    x, bag, y = r.normal(size=(12, passages.N_FEATURES)), np.repeat([0, 1, 2], 4), np.array([1.0, 0.0, 1.0])
    m = passages.fit(x, bag, y, epochs=1)
    loss = lambda: -np.mean(y * np.log(m.forward(x, bag, 3)["p"]) + (1 - y) * np.log(1 - m.forward(x, bag, 3)["p"]))
    g = m.gradients(x, bag, y, 0.0)
    for k in m.w:
        at = tuple(0 for _ in m.w[k].shape)
        old = m.w[k][at]
        m.w[k][at] = old + 1e-5
        up = loss()
        m.w[k][at] = old - 1e-5
        assert g[k][at] == pytest.approx((up - loss()) / 2e-5, abs=1e-6)
        m.w[k][at] = old


def waterfill(sizes, weights, total, most):
    target = {}
    left = dict(sizes)
    while left:
        w = sum(weights[s] for s in left)
        rest = total - sum(target.values())
        over = [s for s in left if rest * weights[s] / w > most * sizes[s]]
        if not over:
            return target | {s: rest * weights[s] / w for s in left}
        for s in over:
            target[s] = most * left.pop(s)
    return target


def test_mixing(spark, corpus, empty):
    got = mixing.mix(clashing(corpus)).toPandas()
    rows = corpus.toPandas()
    sizes = rows.text.map(lambda t: len(WORD.findall(t or ""))).groupby(rows.source, dropna=False).sum()
    names = [*sorted(x for x in sizes.index if isinstance(x, str)), None]
    by = {n: int(sizes[n] if n else sizes[sizes.index.isna()].iloc[0]) for n in names}
    want = waterfill(by, {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}, 1.5 * sum(by.values()), 2.0)
    assert sorted({round(t, 6) for t in got.target}) == sorted({round(t, 6) for t in want.values()})
    assert (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    again = mixing.mix(corpus).toPandas()
    assert sorted(got.taken) == sorted(again.taken)
    emitted = mixing.emit(corpus)
    assert emitted.columns == corpus.columns and emitted.count() == got.copies.sum()
    assert mixing.mix(empty).count() == 0 and mixing.emit(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_mixing_targets_equal_resharing(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{i:02}": r.choice([0, 1, 7, 50, 1000, r.randrange(5000)]) for i in range(12)}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {x.source: x.target for x in mixing.source_targets(frame, (5, 2, 1), 1.5, 2.0).collect()}
    want = waterfill(sizes, {n: (5, 2, 1)[i % 3] for i, n in enumerate(sorted(sizes))}, 1.5 * sum(sizes.values()), 2.0)
    assert got == pytest.approx(want)


def test_top_k(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=8)], 0) for i in range(300)]
    rows += [(i, rows[3][1], 0) for i in range(300, 340)]  # ties
    rows += [(400, None, 0), (401, [1.0, None] * 4, 0), (402, [float("nan")] * 8, 0), (403, [float("inf")] * 8, 0), (404, [1.0, 2.0], 0), (500, [3.0, 1.0], 0), (None, [1.0] * 8, 0), (5, rows[5][1], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"score": F.lit(1), "rank": F.lit("x")})
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in topk.top_k(frame, F.col("vec_id") % 100 == 0, shard_rows=32, block_rows=2, fan_in=2).collect()}
    vectors = {i: np.floor(np.array(v, np.float32).astype(float) * 1024).astype(np.int64) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = {}
    for q, v in vectors.items():
        if q % 100 == 0:
            best = sorted((-int(v @ w), i) for i, w in vectors.items() if i != q and len(w) == len(v))[:10]
            want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(best)}
    assert got == want
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_keeps_rows_that_repeat_an_id(spark):
    r = np.random.default_rng(9)
    rows = [(i % 40, [float(x) for x in r.normal(size=6)]) for i in range(120)]  # each id three times, with other vectors
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = [(i, np.floor(np.array(e, np.float32).astype(float) * 1024).astype(np.int64)) for i, e in rows]
    want = set()
    for q in (0, 20):
        best = sorted((-int(a @ b), j) for i, a in v if i == q for j, b in v if j != q)[:10]
        want |= {(q, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    got = topk.top_k(frame, F.col("vec_id") % 20 == 0, shard_rows=16, block_rows=2, fan_in=2).select("query_id", "rank", "vec_id", "score").collect()
    assert set(map(tuple, got)) == want and len(got) == 20


def test_best_of_tile_beyond_doubles():
    q, v = np.array([[1 << 40, 3]]), np.array([[1 << 20, 1], [1 << 20, 2], [0, 5]])
    assert [x.tolist() for x in topk.best_of_tile(q, np.array([9]), v, np.array([1, 2, 3]), 2)] == [[9, 9], [2, 1], [(1 << 60) + 6, (1 << 60) + 3]]


def shingle_set(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = defaultdict(lambda: 10**12)
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least[root(i)], d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def test_jaccard(spark, corpus, empty):
    got = jaccard.join(clashing(corpus)).toPandas()
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    assert sorted(got[["doc_id", "n_shingles", "component_id"]].itertuples(index=False, name=None)) == brute_components(rows)
    assert jaccard.join(empty).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_chains_and_common_passages(spark, seed):
    """Chains of edits near the threshold, and a passage that most documents hold."""
    r = random.Random(seed)
    licence = [f"clause{i}" for i in range(30)]
    rows = []
    for c in range(12):
        words = [f"x{r.randrange(4000)}" for _ in range(r.choice([6, 20, 60]))]
        for _ in range(8):
            rows.append((len(rows) * 3 + 1, " ".join(words + (licence if c % 2 else []))))
            words = words.copy()
            words[-1 if r.random() < 0.6 else r.randrange(len(words))] = f"y{r.randrange(10**6)}"
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert sorted(got[["doc_id", "n_shingles", "component_id"]].itertuples(index=False, name=None)) == brute_components(rows)


def test_jaccard_trees_of_several_tiles(spark, monkeypatch):
    """Many sets that share a passage which is most of each: one tree has many tiles."""
    monkeypatch.setattr(jaccard, "TILE", 4)
    r = random.Random(3)
    passage = [f"clause{i}" for i in range(60)]
    rows = [(i, " ".join([*passage[: r.randrange(44, 61)], *(f"x{r.randrange(10**6)}" for _ in range(r.randrange(14)))])) for i in range(60)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert sorted(got[["doc_id", "n_shingles", "component_id"]].itertuples(index=False, name=None)) == brute_components(rows)


@pytest.mark.parametrize("seed", range(4))
def test_tiles_find_what_all_pairs_find(monkeypatch, seed):
    """The boxes of leaves lose no pair that the points allow."""
    monkeypatch.setattr(jaccard, "LEAF", 4)
    r = np.random.default_rng(seed)
    base = [distinct_hashes(r, 60) for _ in range(6)]
    sets = [np.unique(np.concatenate([r.choice(base[i % 6], 57, replace=False), distinct_hashes(r, int(r.integers(0, 12)))])) for i in range(60)]
    n = np.array([len(s) for s in sets])
    point = [jaccard.point_of(s, len(s)) for s in sets]
    component, left = np.arange(60) // 2, n - r.integers(0, 8, 60)
    least = jaccard.least_overlap(n[:, None], n[None, :], 80)
    want = {frozenset((i, j)) for i in range(60) for j in range(i) if component[i] != component[j] and min(left[i], left[j]) >= least[i, j] and jaccard.overlap_bound(point[i], point[j]) >= least[i, j]}
    assert want and all(jaccard.overlap_bound(point[i], point[j]) >= len(np.intersect1d(sets[i], sets[j])) for i in range(60) for j in range(60))
    x, y = (jaccard.Tile(*[[v[i] for i in part] for v in (np.arange(60), n, component, left, point)]) for part in (range(30), range(30, 60)))
    got = [frozenset(p) for t, u in ((x, x), (y, y), (x, y)) for p in zip(*map(list, jaccard.tile_pairs(t, u, 80)[:2]), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want
    a, b, _ = jaccard.leaf_pairs(np.arange(60), n, component, left, point, 80)
    assert {frozenset(p) for p in zip(a.tolist(), b.tolist(), strict=True)} == want


def distinct_hashes(r, n):
    return np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))


def test_shingles_of_few_words():
    assert len(jaccard.shingles("a b")) == 1 and len(jaccard.shingles("A  b\n")) == 1 and len(jaccard.shingles("")) == len(jaccard.shingles(None)) == 0
    assert jaccard.shingles("A b")[0] == jaccard.shingles("a\tb")[0] != jaccard.shingles("a b c")[0]


def test_warc(spark, monkeypatch):
    big = "x" * 1500
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "http://a/4", "small"), (5, "http://a/5", "small"), (6, "http://a/6", None), (7, "http://a/7\r\nX: y", "é" * 600), (None, "http://a/8", "q" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "record_type": F.lit("x")})
    path = new_path(spark, "warc-test")
    warc.write(warc.records_of_pages(pages), path)
    got = {r.page_id: r for r in warc.pages_of_records(spark, path).collect()}
    for i, _, html in rows:
        body = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 3) if i in (1, 2) else ("response", None))
    text = b"".join(gzip.decompress(p.read_bytes()) for p in Path(path.removeprefix("file://")).glob("*.warc.gz"))
    assert text.count(b"WARC/1.1\r\n") == text.count(b"\r\nWARC-Date: ") == text.count(b"\r\nWARC-Record-ID: <urn:page:") + 1 == len(rows) and "é".encode() * 600 in text
    assert text.count(b"WARC-Profile: http") == 2 and b"WARC-Refers-To: <urn:page:3>" in text and b"WARC-Payload-Digest: sha1:" + hashlib.sha1(b"small").hexdigest().encode() in text
    pushed = warc.read(spark, path, payload=False).filter(F.col("record_type").isin("revisit", "x") & (F.col("payload_length") > 5))
    plan = pushed._jdf.queryExecution().executedPlan().toString()
    assert "record_type" not in plan.split("Filter")[1].split("BatchScan")[0] or " IN " not in plan.split("Filter")[1].split("BatchScan")[0]
    assert pushed.count() == 2 and {r.payload for r in pushed.collect()} == {None}
    none = new_path(spark, "warc-empty")
    warc.write(warc.records_of_pages(pages.limit(0)), none)
    assert warc.pages_of_records(spark, none).count() == 0


def test_warc_splits_at_records(monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    monkeypatch.setattr(warc, "SPLIT_BYTES", 900)
    blank = dict.fromkeys(warc.HEADERS)
    rows = [blank | {"record_type": "response", "record_id": f"urn:page:{i}", "payload": random.Random(i).randbytes(200), "payload_length": 200} for i in range(40)]
    writer = warc.WarcWriter(str(tmp_path))
    writer.commit([writer.write(iter(rows)), None])
    lost = writer.write(iter(rows))  # a task that ran twice: not in the manifest
    reader = warc.WarcReader(str(tmp_path), True)
    parts = reader.partitions()
    assert len(parts) > 8 and sorted(x[1] for p in parts for x in reader.read(p)) == sorted(r["record_id"] for r in rows)
    assert {x[1]: x[6] for p in parts for x in reader.read(p)} == {r["record_id"]: r["payload"] for r in rows}
    writer.abort([lost])
    assert sum(1 for p in parts for _ in reader.read(p)) == 40


def test_warc_reads_archives_of_others(spark, tmp_path):
    def entry(kind, i, block, how="application/http; msgtype=response"):
        return f"WARC/1.0\r\nwarc-type:{kind}\r\nWARC-Record-ID: <urn:uuid:{i}>\r\nWARC-Target-URI: http://a/\r\n {i}\r\nContent-Type: {how}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    page = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<html>\r\n\r\nbody</html>"
    records = [entry("warcinfo", 0, b"software: x\r\n", "application/warc-fields"), entry("response", 1, page), entry("request", 2, b"GET / HTTP/1.1\r\n\r\n"), entry("response", 3, b"x" * 3_000_000, "text/plain")]
    (tmp_path / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "notes.txt").write_bytes(b"no archive")
    for path, times in ((str(tmp_path), 3), (str(tmp_path / "one.warc.gz"), 1)):
        got = warc.read(spark, path).filter("record_type = 'response'").select("record_id", "payload", "target_uri").collect()
        want = [("urn:uuid:1", b"<html>\r\n\r\nbody</html>", "http://a/ 1"), ("urn:uuid:3", b"x" * 3_000_000, "http://a/ 3")]
        assert sorted((r[0], bytes(r[1]), r[2]) for r in got) == sorted(want * times)
        heads = warc.read(spark, path, payload=False).select("record_type", "payload", "payload_length").collect()
        assert len(heads) == 4 * times and {r.payload for r in heads} == {None} and {r.payload_length for r in heads} == {13, len(page), 18, 3_000_000}


def test_pipeline_stages(spark, corpus, tmp_path):
    """Each stage on its own input, with columns whose names clash, against brute force."""
    import corpus_pipeline as c

    docs = clashing(corpus)
    rows = [tuple(r) for r in corpus.collect()]
    stages, row = dict(c.STAGES), lambda df: sorted(map(tuple, df.select(*c.COLUMNS).collect()), key=repr)
    model = language.train(corpus)
    known = lambda t: model.predict([t or ""])[2][0]
    kept = stages["language"](spark, docs, "")
    assert kept.columns == c.COLUMNS and row(kept) == sorted((r for r in rows if r[1] and any(x.isalpha() for x in r[1]) and known(r[1]) >= c.KNOWN_SHARE), key=repr)
    one = stages["near_duplicates"](spark, docs, "")
    want = {x[2] for x in brute_components([(r[0], r[1]) for r in rows])}
    assert sorted(r.doc_id for r in one.collect()) == sorted(want) and one.columns == c.COLUMNS
    secret = [(r[0], r[1] + f" mail agent{i}@corp.example or 10.0.0.{i}" if r[1] and i % 9 == 0 else r[1], *r[2:]) for i, r in enumerate(rows)]
    clean = stages["personal_data"](spark, spark.createDataFrame(secret, DOCS), "")
    terms = {x.term: x.bits for x in pii.disclosing_terms(spark.createDataFrame(secret, DOCS)).collect()}

    def sanitized(t):
        spans = [(a, b, f"[{k.upper()}]") for k, a, b in brute_pii(t)]
        for m in re.finditer(r"[^\W\d_]{3,}", t or ""):
            if m[0].lower() in terms and not any(a < m.end() and m.start() < b for a, b, _ in spans):
                spans.append((m.start(), m.end(), "" if terms[m[0].lower()] >= 12 else "[TERM]"))
        for a, b, to in sorted(spans, reverse=True):
            t = t[:a] + to + t[b:]
        return t

    assert row(clean) == sorted(((i, sanitized(t), l, s, None if t is None else len(sanitized(t))) for i, t, l, s, _ in secret), key=repr)
    mixed = Counter(row(stages["mixing"](spark, docs, "")))
    copies = Counter()
    for r in mixing.mix(corpus).collect():
        copies[r.doc_id] += r.copies
    assert sum(mixed.values()) == sum(copies.values()) and all(sum(n for k, n in mixed.items() if k[0] == i) == n for i, n in copies.items()) and mixed.keys() <= set(rows)
    packed = stages["packing"](spark, docs, "")
    assert sorted((r.doc_id, r.start, r.length) for r in packed.collect()) == sorted((r.doc_id, r.start, r.length) for r in packing.pieces(corpus, 1024).collect())


def test_pipeline_run(spark, corpus, empty, tmp_path):
    import corpus_pipeline as c

    for name, df in (("full", corpus), ("empty", empty)):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = c.run(spark, str(tmp_path / name))
        assert out.filter("length > 1024 or offset + length > 1024").count() == 0 and (out.count() > 0) == (name == "full")


def test_near_duplicates_of_rows_with_clashing_ids(spark):
    import corpus_pipeline as c

    r = random.Random(21)
    a, b, d, e = (text_of([f"{k}{i}" for i in range(500)], r, 60) for k in "abde")
    rows = [(1, a), (5, a + " end"), (5, b), (None, a + " tail"), (None, d), (None, d + " more"), (7, e), (7, e), (None, None), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    got = sorted(((x.doc_id, x.text) for x in c.near_duplicate_stage(spark, docs, "").collect()), key=repr)
    least = [x for x in got if x[0] is None and x[1] and x[1].startswith(d)]  # either of the two
    assert len(least) == 1 and got == sorted([(1, a), (5, b), (7, e), (None, None), (8, None), least[0]], key=repr)
