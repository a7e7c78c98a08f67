"""Scores are cleaned once a side, and the best page is found without moving the candidates."""

import random

from pyspark.sql import functions as F
from test_pairs_of_blocks import shuffled

from peerlight.operators import pages


def tables(spark, seed=4):
    r = random.Random(seed)
    words = ["alpha", "beta shop", "gamma", "north", "topic", "page"]
    p = [(i // 2, f"https://{r.choice(['x', 'blocked', 'gamma'])}.example.com/{r.choice(words)}/{i}", r.choice(words), f"g{i % 3}") for i in range(90)]  # two pages of each id
    o = [(str(i), r.choice([*words[:4], ""]), f"g{i % 4}", r.choice([*words[:4], None])) for i in range(80)]
    return spark.createDataFrame(p, "page_id long, url string, title string, snippet string"), spark.createDataFrame(o, "office_no string, office_name string, corporation_name string, municipality string")


def test_scores_of_sides_are_those_of_pairs(spark):
    p, o = tables(spark)
    blocked = F.col("url").contains("blocked")
    met = F.col("corporation_name") == F.col("snippet")
    whole = pages.score_candidates(o.join(p, met), blocked, ("topic",), "topic", "page")
    apart = pages.score_pairs(pages.office_texts(o).join(pages.page_texts(p, blocked, ("topic",), "page"), met), "topic")
    assert sorted(map(repr, apart.select(*whole.columns).collect())) == sorted(map(repr, whole.collect()))
    # cleaned names and texts are columns of the sides: no pattern is searched in a pair
    plan = apart.select("office_no", "score")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan[: plan.index("Join")]


def test_best_page_of_many_moves_a_row_a_score(spark):
    p, o = tables(spark)
    placed = p.repartitionByRange(3, "page_id", "url").sortWithinPartitions("page_id", "url").withColumn("place", F.monotonically_increasing_id()).localCheckpoint()
    scored = pages.score_candidates(o.join(F.broadcast(placed), F.col("corporation_name") == F.col("snippet")), F.col("url").contains("blocked"), ("topic",), "topic", "page").localCheckpoint()
    rows = scored.collect()
    want = {}
    for x in sorted(rows, key=lambda x: (-x.score, x.page_id, x.url)):
        want.setdefault(x.office_no, x)
    for least in (-1, 3):
        got, moved = shuffled(spark, lambda: pages.pick_best_candidate(scored, "office_no", "place", least, placed).collect())
        assert sorted((x.office_no, x.url, x.score) for x in got) == sorted((k, x.url, x.score) for k, x in want.items() if x.score >= least)
        assert moved < len(rows) / 2
