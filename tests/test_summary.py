"""Statistics of one reading against numpy; ranges that stay bounded; the plan of the enriched table."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerlight.operators import entities, peers, profile, stats, summary
from peerlight.operators.summary import Statistic

SHARES = (0.0, 0.1, 0.5, 0.9, 1.0)


def rows(n=700, seed=2):
    r = random.Random(seed)
    odd = [None, float("nan"), float("inf"), -0.0, 0.0, -1e9, 1e-9]
    return [(r.choice([None, "a", "b", "c|", ""]), r.choice([None, 1.5, -0.0, 0.0]), r.choice(odd) if r.random() < 0.1 else round(r.gauss(1e6, 3), 1)) for _ in range(n)]


def good(v):
    return v is not None and math.isfinite(v)


@pytest.mark.parametrize("range_rows", [1_000_000, 40])
def test_summary_is_that_of_numpy(spark, range_rows):
    data = rows()
    df = spark.createDataFrame(data, "g string, h double, v double").repartition(3)
    found = summary.summarize(df, {"all": Statistic("v"), "g": Statistic("v", ("g",)), "gh": Statistic("v", ("g", "h")), "plain": Statistic("v", ("g",), False)}, SHARES, range_rows)
    groups = {"all": lambda g, h: (), "g": lambda g, h: (g,), "gh": lambda g, h: (g, None if h is None else h + 0.0)}
    for name, of in groups.items():
        want = {}
        for g, h, v in data:
            want.setdefault(of(g, h), []).extend([v] if good(v) else [])
        by = {"all": [], "g": ["g"], "gh": ["g", "h"]}[name]
        got = {tuple(r[c] for c in by): r for r in found.of(name).collect()}
        assert got.keys() == want.keys()
        for key, values in want.items():
            r = got[key]
            assert r["count"] == len(values)
            if values:
                assert r.mean == pytest.approx(np.mean(values)) and r.low == min(values) and r.high == max(values)
                assert list(r.q) == pytest.approx(list(np.quantile(values, SHARES)), rel=1e-12)
            if len(values) > 1:
                assert r.sd == pytest.approx(np.std(values, ddof=1), rel=1e-9)
        for r in found.join_ranks(df, name, "below", "above", "every").collect():
            values = want[of(r.g, r.h)]
            if good(r.v):
                assert (r.below, r.above, r.every) == (sum(x < r.v for x in values), sum(x > r.v for x in values), len(values))
            else:
                assert r.below is None
    plain = {r.g: (r["count"], r.mean, r.sd) for r in found.of("plain").collect()}
    assert plain.keys() == {g for g, _, _ in data}
    for r in found.of("g").collect():
        assert plain[r.g] == pytest.approx((r["count"], r.mean, r.sd))
    found.discard()


def test_summary_of_nothing(spark):
    df = spark.createDataFrame(rows(5), "g string, h double, v double")
    found = summary.summarize(df.limit(0), {"all": Statistic("v"), "g": Statistic("v", ("g",))})
    assert found.one("all")["count"] == 0 and found.one("all").q is None and found.of("g").count() == 0
    nulls = summary.summarize(df.withColumn("v", F.lit(None).cast("double")), {"all": Statistic("v"), "g": Statistic("v", ("g",))})
    assert nulls.one("all")["count"] == 0 and nulls.one("all").mean is None
    assert {r["count"] for r in nulls.of("g").collect()} == {0}
    assert stats.numeric_stats(df.limit(0), "v").collect()[0]["count"] == 0


def test_deviation_of_a_narrow_range_far_from_zero(spark):
    values = [1.7e12 + i * 0.5 for i in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    for ranked in (True, False):
        assert summary.summarize(df, {"x": Statistic("v", (), ranked)}).one("x").sd == pytest.approx(np.std(np.array(values) - 1.7e12, ddof=1), rel=1e-6)


def test_no_range_is_large_however_narrow_the_values(spark):
    """Time stamps: 40,000 distinct values within a hundred-millionth of their size, and one group that has most of them."""
    counts = spark.range(40_000).select(F.when(F.col("id") % 50 == 0, "small").otherwise("large").alias("g"), (1.7e9 + F.col("id") / 1000).alias("v"), F.lit(2).alias("n"))
    dealt = summary.ranges(counts, ("g",), "v", 1000)
    sizes = [r["count"] for r in dealt.groupBy("_part").count().collect()]
    assert sum(sizes) == 40_000 and len(sizes) >= 30 and max(sizes) <= 3000
    got = summary.smaller_counts(counts, ("g",), "v", "n", 1000)
    for g, n in (("small", 800), ("large", 39_200)):
        found = [r.smaller for r in got.filter(F.col("g") == g).orderBy("v").collect()]
        assert found == [2 * i for i in range(n)]
        assert {r["all"] for r in got.filter(F.col("g") == g).select("all").distinct().collect()} == {2 * n}


def offices(spark, n=400):
    r = random.Random(8)
    data = [(str(i), r.choice([None, "n1", "n2", "n3", " "]), r.choice([None, "x", "y", "group x"]), r.choice([None, "p", "q"]), r.choice([None, "x", "y"]), r.choice(["m1", "m2"]), r.choice([None, "t"]), float(r.randrange(5, 50)), r.choice([None, float(r.randrange(100))]), r.choice([None, float(r.randrange(20_000))]), "steel", 0.1) for i in range(n)]
    return spark.createDataFrame(data, "office_no string, number string, name string, rep string, base string, municipality string, corporation_type_label string, capacity double, average_daily_users double, average_wage_yen double, primary_activity_type string, home_use_user_ratio_decimal double")


def test_enriched_table_has_a_small_plan(spark):
    base = offices(spark)
    path = stats.checkpointed(base)
    out = entities.company_identity(profile.enriched(path), "number", "name", "base", "rep", "office_no")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    reads = plan.count("Relation [")
    assert plan.count("Join ") <= 8 and reads <= 9
    assert out.count() == base.count()


def test_company_identity_is_the_rule(spark):
    data = [r.asDict() for r in offices(spark).collect()]
    own = lambda r: (r["number"] or "").strip() or None
    pair, exact = {}, {}
    for r in data:
        if own(r) and r["rep"] is not None and r["base"] is not None:
            pair.setdefault((r["rep"], r["base"]), set()).add(own(r))
    by_pair = lambda r: next(iter(pair[r["rep"], r["base"]])) if len(pair.get((r["rep"], r["base"]), ())) == 1 else None
    for r in data:
        n = own(r) or by_pair(r)
        if r["name"] is not None and n:
            exact.setdefault(r["name"], set()).add(n)
    by_name = lambda r: next(iter(exact[r["name"]])) if len(exact.get(r["name"], ())) == 1 else None
    want = {}
    for r in data:
        n = own(r) or by_name(r) or by_pair(r)
        want[r["office_no"]] = f"number:{n}" if n else f"name:{r['name']}" if r["name"] is not None else f"office:{r['office_no']}"
    got = {r.office_no: r.company_key for r in entities.company_identity(offices(spark), "number", "name", "base", "rep", "office_no").collect()}
    assert got == want


def test_peer_ranks_of_two_groups_are_those_of_each(spark):
    df = offices(spark).withColumn("cap", F.when(F.col("capacity") < 20, "s").otherwise("l"))
    both = peers.peer_ranks(df, {"a": "municipality", "b": "cap"}, "average_wage_yen").collect()
    data = [r.asDict() for r in both]
    for p, g in (("a", "municipality"), ("b", "cap")):
        one = {r.office_no: (r.x_count, r.x_rank, r.x_median, r.x_mean) for r in peers.peer_rank(df, g, "average_wage_yen", "x").collect()}
        for r in data:
            assert one[r["office_no"]] == (r[f"{p}_count"], r[f"{p}_rank"], r[f"{p}_median"], r[f"{p}_mean"])
            values = [x["average_wage_yen"] for x in data if x[g] == r[g] and x["average_wage_yen"] is not None]
            if r["average_wage_yen"] is not None:
                assert r[f"{p}_rank"] == 1 + sum(v > r["average_wage_yen"] for v in values) and r[f"{p}_count"] == len(values)
