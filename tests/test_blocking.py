"""Candidates of large blocks against all pairs, bounds against difflib."""

import difflib
import random
import time

import pytest
from pyspark.sql import functions as F

from peerlight.operators import blocking, linkage

OFFICES = "ordinal long, office_no string, office_name string, corporation_name string, corporation_number string, municipality string, capacity double, average_wage_yen double, average_daily_users double"
DIRECTORY = "ordinal long, office_number string, office_name string, corporation_name string, corporation_number string, office_address_city string, office_capacity double"


def names(r, n):
    """Names that resemble each other in every way the rules ask for, and ones that don't."""
    stems = ["sunflower", "sun", "flower garden", "north star", "a", "ab", "workshop of the river", "river", "mountain view center", "ｓｕｎ", "", "..", "office", "zzzzzzzz", "aaaaaaa"]
    out = []
    for _ in range(n):
        s = r.choice(stems)
        for _ in range(r.randrange(3)):
            i, kind = r.randrange(len(s) + 1), r.randrange(4)
            s = s[:i] + r.choice("abcxyz 7") + s[i:] if kind == 0 else s[:i] + s[i + 1 :] if kind == 1 else s + r.choice([" works", " center", " 7", "xy"]) if kind == 2 else s[::-1] if r.random() < 0.1 else s
        out.append(s)
    return out


def sides(spark, n=260, seed=1):
    r = random.Random(seed)
    number = lambda: r.choice(["N1"] * 6 + ["N2", "N3", None, ""])
    company = lambda: r.choice(["hot company"] * 4 + ["Other", "third", None, ""])
    city = lambda: r.choice(["east", "west", "north", None, ""])
    o = [(i, str(i), x, company(), number(), city(), float(r.randrange(6)), 1.0, 1.0) for i, x in enumerate(names(r, n))]
    d = [(i, f"D{i}", x, company(), number(), r.choice([None, "", "east city", "west city", "south city"]), float(r.randrange(6))) for i, x in enumerate(names(r, n))]
    return linkage.prepared_records(spark.createDataFrame(o, OFFICES), ("works", "center", "office")), linkage.checkpointed(linkage.prepared_directory(spark.createDataFrame(d, DIRECTORY), ("works", "center", "office")))


@pytest.mark.parametrize("seed", [1, 2])
def test_no_accepted_pair_is_lost(spark, seed):
    r, d = sides(spark, seed=seed)
    r = linkage.checkpointed(r)
    every = linkage.link_rule_cascade(linkage.link_similarity(linkage.checkpointed(linkage.link_area_narrowing(linkage.paired(linkage.candidate_pairs(r, d), r, d)))))
    columns = [*linkage.PROPOSAL, "mode"]
    want = sorted(map(tuple, every.select(*columns).collect()))
    assert len(want) > 300 and len({x[2] for x in want}) >= 6
    for most_pairs in (0, 5000, 10**9):
        assert sorted(map(tuple, linkage.proposed(r, d, most_pairs).select(*columns).collect())) == want


def test_similarities_are_those_of_difflib(spark):
    r, d = sides(spark, 90, 4)
    for x in linkage.link_similarity(linkage.checkpointed(linkage.paired(linkage.candidate_pairs(r, d), r, d))).collect():
        for kind in ("strict", "relaxed"):
            a, b = x[f"rec_{kind}"], x[f"dir_{kind}"]
            ratio = difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0
            assert x[f"{kind}_similarity"] == pytest.approx(ratio, abs=5.1e-5)
        a, b = x.rec_relaxed[::-1], x.dir_relaxed[::-1]
        assert x.suffix == next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))


def test_bounds_are_above_the_ratio(spark):
    r = random.Random(6)
    pairs = [("".join(r.choice("abcd é中") for _ in range(r.randrange(12))), "".join(r.choice("abcd é中") for _ in range(r.randrange(12)))) for _ in range(1500)] + [("x" * 300, "x" * 250), ("ab" * 150, "ba" * 120)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for x in df.select("a", "b", linkage.ratio_bound(F.col("a"), F.col("b")).alias("bound"), linkage.known_ratio(F.col("a"), F.col("b")).alias("known")).collect():
        ratio = difflib.SequenceMatcher(None, x.a, x.b).ratio() if x.a and x.b else 0.0
        assert x.bound >= ratio - 1e-12
        assert x.known is None or x.known == pytest.approx(ratio)
    shared = df.select("a", "b", *[blocking.pieces(F.col(c)).alias(f"p{c}") for c in "ab"], *[blocking.needed(F.length(c), q).alias(f"n{c}{i}") for c in "ab" for i, q in enumerate((0.92, 0.88))])
    for x in shared.collect():
        ratio = difflib.SequenceMatcher(None, x.a, x.b, False).ratio() if x.a and x.b else 0.0
        for i, q in enumerate((0.92, 0.88)):
            if ratio >= q and len(x.a) > 1 and len(x.b) > 1:
                assert len(set(x.pa) & set(x.pb)) >= max(x[f"na{i}"], x[f"nb{i}"])


def test_matcher_is_called_for_few_names(spark):
    r, d = sides(spark, 200, 5)
    pairs = linkage.checkpointed(linkage.link_area_narrowing(linkage.paired(linkage.candidate_pairs(r, d), r, d)))
    report = blocking.matcher_report(pairs).first()
    assert report.pairs == pairs.count() > 4 * report.matched_names and report.acceptable < report.pairs


def test_a_number_that_very_many_share(spark):
    """3,000 x 3,000 rows of one number, 9 million pairs: only those that a rule may accept are made."""
    n = 3000
    code = lambda c: F.concat_ws("", *[F.substring(F.sha2(F.concat(c.cast("string"), F.lit(str(i))), 256), 1, 4) for i in range(5)])
    base = spark.range(n).select(F.col("id").alias("ordinal"), F.col("id").cast("string").alias("office_no"), code(F.col("id")).alias("office_name"), F.lit("one company").alias("corporation_name"), F.lit("N1").alias("corporation_number"), F.lit("east").alias("municipality"), F.lit(5.0).alias("capacity"))
    directory = base.select("ordinal", F.col("office_no").alias("office_number"), F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit("q"), "office_name")).otherwise(F.col("office_name")).alias("office_name"), "corporation_name", "corporation_number", F.lit("east city").alias("office_address_city"), F.col("capacity").alias("office_capacity"))
    r, d = linkage.checkpointed(linkage.prepared_records(base, (), False)), linkage.checkpointed(linkage.prepared_directory(directory, (), False))
    start = time.time()
    found = blocking.bounded_candidates(r, d)
    assert n <= found.count() < 200_000 and found.filter("rec = dir").count() == n
    assert time.time() - start < 300
