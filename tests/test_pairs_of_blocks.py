"""Pairs of blocks of any size stream out of their join: what is shuffled follows the rows, not the pairs."""

import difflib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_blocking import sides

from peerlight.functions.ratio import ratios
from peerlight.operators import blocking, linkage


def shuffled(spark, run):
    """What ``run`` returns, and how many rows its stages have written for shuffles."""
    done = lambda: spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
    bus = spark._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    seen = {(s.stageId(), s.attemptId()) for s in (lambda x: [x.apply(i) for i in range(x.size())])(done())}
    out = run()
    bus.waitUntilEmpty()
    after = done()
    return out, sum(s.shuffleWriteRecords() for s in (after.apply(i) for i in range(after.size())) if (s.stageId(), s.attemptId()) not in seen)


def one_block(spark, n=700):
    """Two sides of n rows with one company number, half of them also with one company name; the rows agree on the area in one of five cities."""
    rows = spark.range(n).select(
        F.col("id").alias("ordinal"), F.col("id").cast("string").alias("office_no"), F.concat(F.lit("shop "), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 12), F.lit(" works "), (F.col("id") % 97).cast("string")).alias("office_name"),
        F.when(F.col("id") % 2 == 0, "a company").otherwise(F.concat(F.lit("own "), F.col("id").cast("string"))).alias("corporation_name"), F.lit("N1").alias("corporation_number"), F.concat(F.lit("area"), (F.col("id") % 5).cast("string")).alias("municipality"), (F.col("id") % 9).cast("double").alias("capacity"))
    directory = rows.select("ordinal", F.col("office_no").alias("office_number"), "office_name", "corporation_name", "corporation_number", F.concat("municipality", F.lit(" city")).alias("office_address_city"), F.col("capacity").alias("office_capacity"))
    return linkage.checkpointed(linkage.prepared_records(rows, (), False)), linkage.checkpointed(linkage.prepared_directory(directory, (), False))


@pytest.mark.parametrize("tile", [3, 50, 10**6])
def test_tiles_make_each_pair_once(spark, tile):
    r, d = sides(spark, 120, 9)
    r, d = (x.filter("dir_number is not null") if "dir_number" in x.columns else x.filter("rec_number is not null") for x in (r, d))
    got = linkage.meeting(r.select("rec", F.col("rec_number").alias("k")), d.select("dir", F.col("dir_number").alias("k")), ["k"], tile).select("rec", "dir").collect()
    want = r.join(d, F.col("rec_number") == F.col("dir_number")).select("rec", "dir").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_block_union_is_made_without_gathering_pairs(spark):
    r, d = sides(spark, 200, 7)
    r = linkage.checkpointed(r)
    gathered = linkage.link_block_union(linkage.link_block_company_number(r, d), linkage.link_block_company_name(r, d))
    assert sorted(map(tuple, linkage.block_pairs(r, d).collect())) == sorted(map(tuple, gathered.collect()))
    r, d = one_block(spark)
    n, moved = shuffled(spark, lambda: linkage.block_pairs(r, d).agg(F.sum(F.xxhash64("rec", "dir", "mode").cast("decimal(38,0)")), F.count("*")).first()[1])
    assert n == 700 * 700 and moved < 20_000


def test_fallback_knows_blocked_records_without_pairs(spark):
    r, d = sides(spark, 200, 7)
    r = linkage.checkpointed(r)
    want = linkage.link_name_only_fallback(r, d, linkage.link_block_union(linkage.link_block_company_number(r, d), linkage.link_block_company_name(r, d)))
    assert sorted(map(tuple, linkage.link_name_only_fallback(r, d, linkage.in_blocks(r, d)).collect())) == sorted(map(tuple, want.collect()))
    r, d = one_block(spark)
    n, moved = shuffled(spark, lambda: linkage.candidate_pairs(r, d).agg(F.sum(F.xxhash64("rec", "dir", "mode").cast("decimal(38,0)")), F.count("*")).first()[1])
    assert n == 700 * 700 and moved < 40_000


def test_narrowing_makes_only_pairs_inside_the_area(spark):
    r, d = sides(spark, 200, 3)
    r = linkage.checkpointed(r)
    want = linkage.link_area_narrowing(linkage.checkpointed(linkage.paired(linkage.candidate_pairs(r, d), r, d)))
    columns = sorted(want.columns)
    assert sorted(map(repr, blocking.narrowed(r, d).select(*columns).collect())) == sorted(map(repr, want.select(*columns).collect()))
    r, d = one_block(spark)
    n, moved = shuffled(spark, lambda: blocking.narrowed(r, d).agg(F.sum(F.xxhash64("rec", "dir", "mode").cast("decimal(38,0)")), F.count("*")).first()[1])
    assert n == 700 * 140 and moved < 30_000


def total(df):
    """All columns of all rows are made, nothing is kept."""
    return df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()[0]


def test_similarities_of_all_pairs_are_not_gathered(spark):
    r, d = one_block(spark, 300)
    pairs = linkage.checkpointed(blocking.narrowed(r, d))
    n, moved = shuffled(spark, lambda: total(linkage.link_similarity(pairs)))
    assert n == 300 * 60 and moved < 1000


def test_matcher_is_not_asked_for_ratios_that_are_not_wanted(spark):
    r, d = sides(spark, 60, 4)
    pairs = linkage.checkpointed(blocking.narrowed(linkage.checkpointed(r), d))
    every = {(x.rec, x.dir): x for x in linkage.link_similarity(pairs).collect()}
    some = linkage.link_similarity(pairs, lambda k: F.col(f"{k}_inside")).collect()
    assert len(some) == len(every) > 100
    for x in some:
        for k in ("strict", "relaxed"):
            a, b, full = x[f"rec_{k}"], x[f"dir_{k}"], every[x.rec, x.dir][f"{k}_similarity"]
            assert x[f"{k}_similarity"] == (full if not a or not b or a in b or b in a else None)


def test_cascade_of_known_ratios_shuffles_no_pairs(spark):
    r, d = one_block(spark, 300)
    pairs = linkage.checkpointed(blocking.narrowed(r, d))
    known = lambda k: F.col(f"{k}_inside") | (F.col(f"rec_{k}") == "") | (F.col(f"dir_{k}") == "")
    n, moved = shuffled(spark, lambda: total(linkage.link_rule_cascade(linkage.link_similarity(pairs, known).filter(known("strict") & known("relaxed")))))
    assert 300 <= n < 300 * 60 and moved < 1000


def test_ambiguity_reads_its_proposals_once(spark):
    rows = [(i % 400, i, 1 + i % 4, "high", ("corp_exact_name_strict", "unique_name_strict")[i % 2], float(i * 37 % 11) / 8, 0.5, 0.5) for i in range(4000)]
    df = linkage.checkpointed(spark.createDataFrame(rows, "rec long, dir long, rule int, confidence string, method string, score double, strict_similarity double, relaxed_similarity double"))
    kept, moved = shuffled(spark, lambda: linkage.link_ambiguity_filter(df).collect())
    by_rec = {}
    for x in sorted(rows, key=lambda x: (-x[5], x[1])):
        by_rec.setdefault(x[0], []).append(x)
    want = [x for own in by_rec.values() for x in own if not (abs(own[0][5] - own[1][5]) < 0.25 and x[5] == own[0][5] and x[4] != "corp_exact_name_strict")]
    assert sorted(map(tuple, kept)) == sorted(want) and len(want) < len(rows) and moved == len(rows)


def test_array_matcher_is_difflib():
    r = random.Random(8)
    text = lambda letters, n: "".join(r.choice(letters) for _ in range(r.randrange(n)))
    pairs = [(text("abc", 14), text("abc", 14)) for _ in range(3000)] + [(text("abcdé中😀 12", 40), text("abcdé中😀 12", 40)) for _ in range(1500)] + [(text("ab", 400), text("ab", 260)) for _ in range(60)] + [(None, "a"), ("a", None), ("", "a")]
    want = [difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in pairs]
    assert list(ratios([a for a, _ in pairs], [b for _, b in pairs])) == want


def test_marks_never_hide_a_pair(spark):
    """With marks of astral characters too, no rule that holds is left out by the bounds."""
    r = random.Random(5)
    rows = [("".join(r.choice("ab😀é") for _ in range(r.randrange(1, 9))), "".join(r.choice("ab😀é") for _ in range(r.randrange(1, 9)))) for _ in range(800)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", linkage.marks(F.col("a")).alias("x"), linkage.marks(F.col("b")).alias("y"))
    lacks = lambda one, other: F.bit_count(F.col(one).bitwiseAND(F.bitwise_not(F.col(other))))
    for x in df.withColumns({"p": lacks("x", "y"), "q": lacks("y", "x")}).collect():
        common = sum((Counter(x.a) & Counter(x.b)).values())
        assert common <= min(len(x.a) - x.p, len(x.b) - x.q)


def test_report_of_the_matcher_follows_rows_not_pairs(spark):
    r, d = one_block(spark, 300)
    report, moved = shuffled(spark, lambda: blocking.matcher_report(blocking.narrowed(r, d)).first())
    assert report.pairs == 300 * 60 and 300 <= report.acceptable < report.pairs and moved < 20_000
