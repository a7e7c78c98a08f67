"""Every registered query against its SQL on the smallest tables, and what every run must keep."""

import math
from pathlib import Path

import duckdb
import pytest

from peerlight.plans import registry, views
from peerlight.plans.context import Tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(v)
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in registry.ORACLE:
        return
    result = duck.execute(registry.ORACLE[name])
    found = [x[0] for x in result.description]
    assert sorted(found) == columns
    at = [found.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)


def test_linkage_is_one_to_one_and_adds_up(spark):
    t = Tables(spark, SF)
    chosen = t.chosen
    n = chosen.count()
    assert n == chosen.select("rec").distinct().count() == chosen.select("dir").distinct().count() > 0
    from peerlight.operators import linkage

    both = linkage.link_unmatched_both_sides(t.office, t.directory, chosen, None)
    assert both.filter("side = 'record'").count() + n == t.office.count()
    assert both.filter("side = 'directory'").count() + n == t.directory.count()


def test_entry_and_registration(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def plain_rule(x):
    """Rule, confidence, method and score of a pair by the order of the rules, from its columns and two difflib ratios."""
    import difflib

    ratio = lambda a, b: round(difflib.SequenceMatcher(None, a, b).ratio(), 4) if a and b else 0.0
    inside = lambda a, b: bool(a and b and (a in b or b in a))
    s, r = ratio(x.rec_strict, x.dir_strict), ratio(x.rec_relaxed, x.dir_relaxed)
    tails = [i for i in range(1 + min(len(x.rec_relaxed), len(x.dir_relaxed))) if x.rec_relaxed[len(x.rec_relaxed) - i :] == x.dir_relaxed[len(x.dir_relaxed) - i :]]
    suffix = max(tails)
    same, alike = x.rec_strict == x.dir_strict != "", x.rec_relaxed == x.dir_relaxed != ""
    known = x.rec_capacity is not None and x.dir_capacity is not None
    equal, close = known and x.rec_capacity == x.dir_capacity, known and abs(x.rec_capacity - x.dir_capacity) <= 2
    num, nam = x.same_number, x.same_company
    rules = [
        (num and same, "high", "corp_exact_name_strict", 100 + s + 0.15 * equal),
        (num and (inside(x.rec_strict, x.dir_strict) or s >= 0.92), "high", "corp_exact_name_strict", 98 + s + 0.15 * equal),
        (num and (alike or inside(x.rec_relaxed, x.dir_relaxed)) and (equal or x.number_candidates == 1), "medium", "corp_exact_name_relaxed", 85 + r + 0.15 * equal),
        (num and s >= 0.78 and r >= 0.88, "medium", "corp_exact_name_fuzzy", 80 + s + 0.5 * r + 0.1 * close),
        (num and suffix >= 2, "medium", "corp_exact_suffix_match", 74 + suffix + 0.5 * s + 0.15 * equal),
        (nam and same, "high", "corp_name_exact_name_strict", 72 + s + 0.1 * equal),
        (nam and alike, "medium", "corp_name_exact_name_relaxed", 68 + r + 0.1 * equal),
        (nam and suffix >= 2, "medium", "corp_name_exact_suffix_match", 64 + suffix + 0.5 * s + 0.1 * equal),
        (same and x.n_strict == 1, "medium", "unique_name_strict", 70 + s + 0.05 * nam),
        (alike and x.n_relaxed == 1 and s >= 0.72, "low", "unique_name_relaxed", 60 + s + 0.1 * equal),
    ]
    found = next(((i + 1, *y[1:]) for i, y in enumerate(rules) if y[0]), None)
    return s, r, suffix, found


def test_similarity_and_rules_of_all_pairs(spark):
    from peerlight.operators import linkage

    pairs = linkage.link_area_narrowing(Tables(spark, SF).candidates).collect()
    similar = {(x.rec, x.dir): x for x in registry.QUERIES["link_similarity_all"](spark, SF).collect()}
    ruled = {(x.rec, x.dir): x for x in registry.QUERIES["link_rule_cascade_all"](spark, SF).collect()}
    want = {(x.rec, x.dir): plain_rule(x) for x in pairs}
    assert similar.keys() == want.keys() and ruled.keys() == {k for k, x in want.items() if x[3]}
    for k, (s, r, suffix, found) in want.items():
        assert (similar[k].strict_similarity, similar[k].relaxed_similarity, similar[k].suffix) == pytest.approx((s, r, suffix), abs=1e-4)
        if found:
            assert (ruled[k].rule, ruled[k].confidence, ruled[k].method) == found[:3] and ruled[k].score == pytest.approx(found[3], abs=2e-4)
    assert {x.rule for x in ruled.values()} - {1, 6, 9} and any(x.strict_similarity < 1 for x in ruled.values())


def test_reports_on_the_whole_linkage(spark):
    """The chosen pairs are those of a plain greedy over the proposals; report, merge, rest and coverage follow from them."""
    from collections import Counter

    t, run = Tables(spark, SF), lambda n: registry.QUERIES[n](spark, SF).collect()
    level = {"high": 3, "medium": 2, "low": 1}
    key = lambda x: (-level[x.confidence], -x.score, -x.strict_similarity, -x.relaxed_similarity, x.rule == 0, x.rec, x.dir)
    by_rec, recs, dirs, greedy = {}, set(), set(), []
    for x in sorted(t.proposals.collect(), key=key):
        by_rec.setdefault(x.rec, []).append(x)
    kept = []
    for own in by_rec.values():
        close = len(own) > 1 and abs(own[0].score - own[1].score) < 0.25
        kept += [x for x in own if not (close and x.score == own[0].score and x.method not in ("corp_exact_name_strict", "corp_name_exact_name_strict"))]
    for x in sorted(kept, key=key):
        if x.rec not in recs and x.dir not in dirs:
            recs.add(x.rec), dirs.add(x.dir), greedy.append(x)
    office, directory = {x.ordinal: x.office_no for x in t.office.collect()}, {x.ordinal: x.office_number for x in t.directory.collect()}
    want = {(office[x.rec], directory[x.dir], x.confidence, x.method, x.score) for x in greedy}
    assert {(x.office_no, x.office_number, x.confidence, x.method, x.score) for x in run("link_match_report_linked")} == want
    merged = run("link_merge_fields_linked")
    assert len(merged) == len(office) and {(x.office_no, x.dir_office_number, x.dir_match_confidence, x.dir_match_method, x.dir_match_score) for x in merged if x.dir_match_status == "matched"} == want
    rest = run("link_unmatched_both_sides_linked")
    assert {(x.side, x.ordinal) for x in rest} == {("record", i) for i in office.keys() - recs} | {("directory", i) for i in directory.keys() - dirs}
    got = {(x.block, x.label): x["count"] for x in run("link_coverage_summary_linked")}
    n = len(greedy)
    counts = {("record", "matched"): n, ("record", "unmatched"): len(office) - n, ("directory", "matched"): n, ("directory", "unmatched"): len(directory) - n}
    assert got == counts | {("confidence", k): v for k, v in Counter(x.confidence for x in greedy).items()} | {("method", k): v for k, v in Counter(x.method for x in greedy).items()}
    assert len({x.confidence for x in greedy}) > 1 and len({x.method for x in greedy}) > 3


def pairs_of_groups(duck, columns: str) -> list[tuple]:
    return duck.execute(f"with {views.OFFICE_CTE} select {columns} from office join pages on corporation_name = 'group ' || (page_id % 400) order by all").fetchall()


def test_every_page_meets_every_office_that_its_group_names(spark, duck):
    """The scored pairs are all of them, not a fixed number for each office."""
    scored = registry.QUERIES["score_candidates"](spark, SF).select("office_no", "page_id").collect()
    assert sorted(map(tuple, scored)) == pairs_of_groups(duck, "office_no, page_id")


def test_the_best_page_is_one_of_the_office_s_group(spark, duck):
    best = {(r.office_no, r.url) for r in registry.QUERIES["pick_best_candidate"](spark, SF).collect()}
    assert best and best <= set(pairs_of_groups(duck, "office_no, url"))
