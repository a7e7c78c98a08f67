"""Small golden cases: corner values, ties, empty inputs and properties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerlight.functions import text as T
from peerlight.operators import classify, enrich, entities, filters, linkage, pages, peers, profile, reports, stats
from peerlight.sources import tables


def values(spark, expression, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(expression.alias("y")).collect()]


def test_names(spark):
    got = values(spark, T.strict_name(F.col("x")), ["ＡＢＣ　事業所・１", "a-b (C)", None, "ｶﾌｪ"])
    assert got == ["abc事業所1", "abc", "", "カフェ"]
    assert values(spark, T.relaxed_name(F.col("x")), ["就労継続支援B型事業所 あお", "みどり作業所", "センター"]) == ["あお", "みどり", ""]
    assert values(spark, T.match_text(F.col("x")), ["Ａ社「花」＆B", None]) == ["a社花b", ""]
    assert values(spark, T.company_key(F.col("x")), ["㈱ あお・ぞら", "（株）ABC-D", "NPO法人 花", " "]) == ["株式会社あおぞら", "株式会社abcーd", "特定非営利活動法人花", None]
    assert values(spark, T.company_base_key(F.col("x")), ["株式会社あお", "あお", "株式会社"]) == ["あお", "あお", "株式会社"]


def test_representatives(spark):
    c = T.representative(F.col("x"))
    rows = ["代表取締役 会長 山川　一", "代表取締役社長：海野 空", "花木 理", "理事長", "田中 一（GEPS 登録）", None, "代表取締役社長　代表理事 森 林"]
    assert values(spark, c["name"], rows) == ["山川 一", "海野 空", "花木 理", None, "田中 一", None, "森 林"]
    assert values(spark, c["role"], rows) == ["代表取締役 会長", "代表取締役社長", None, "理事長", None, None, "代表取締役社長 代表理事"]
    assert values(spark, c["name_key"], rows)[0] == "山川一"


def test_urls(spark):
    rows = ["hxxps://A.Example.com/B/?q=1", "https//x.example.com", "www.Y.example.com/", "//z.example.com/a#b", "hyyp://w.example.com/p).", "mailto:a@b", "http://u.example.com/a&amp;b", "", None, "https://"]
    assert values(spark, T.canonical_url(F.col("x")), rows) == ["https://a.example.com/B", "https://x.example.com", "https://www.y.example.com", "https://z.example.com/a", "http://w.example.com/p", None, "http://u.example.com/a&b", None, None, None]
    assert values(spark, T.profile_url(F.col("x")), ["https://instagram.com/abc/x", "https://instagram.com/p/1", "https://example.com/abc"]) == ["https://www.instagram.com/abc/", None, None]
    assert values(spark, T.strip_markup(F.col("x")), ["<p>a &lt;b&gt;&nbsp;é</p>\n<i>c</i>"]) == ["a <b> é c"]


@pytest.fixture
def wages(spark):
    return lambda *xs: spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(xs)], "ordinal long, w double")


def test_statistics_of_few_values(wages):
    assert stats.numeric_stats(wages(), "w").first().asDict() == dict(count=0, mean=None, median=None, q1=None, q3=None, p90=None, iqr=None, upper_fence=None, lower_fence=None, upper_extreme=None, lower_extreme=None)
    one = stats.numeric_stats(wages(5, None, float("nan"), float("inf")), "w").first()
    assert (one["count"], one.mean, one.q1, one.upper_fence, one.lower_extreme) == (1, 5, 5, 5, 5)
    assert stats.stddev_sample(wages(3), "w").first().stddev is None
    published = stats.numeric_stats(wages(0, 0, 0, 10, 20, 30, 1000), "w").first()
    assert (published.lower_fence, published.lower_extreme) == (0, 0)


def test_outlier_classes(wages):
    df = wages(0, 0, 10, 10, 10, 11, 12, 30, 13, 17, None)
    got = {r.ordinal: (r.outlier_flag, r.outlier_severity) for r in stats.outlier_flags(df, "w").collect()}
    q1, q3 = 10.0, 12.75
    assert 17 > q3 + 1.5 * (q3 - q1) and 17 < q3 + 3 * (q3 - q1) and 30 > q3 + 3 * (q3 - q1)
    assert got[7] == ("high", "extreme") and got[9] == ("high", "moderate") and got[10] == (None, None) and got[2] == (None, None)
    assert got[0] == ("low", "extreme")
    clamped = {r.ordinal: r.outlier_severity for r in stats.outlier_flags(wages(0, 0, 0, 0, 5, 100), "w").collect()}
    assert clamped[0] == "extreme"  # a fence that stops at 0 counts zeros


def test_bands_and_tiers(spark):
    assert values(spark, profile.band(F.col("x"), profile.WAGE_BANDS), [9999.0, 10000.0, 50000.0, None], "x double") == ["under 10k", "10k-15k", "50k and more", None]
    number, unit = classify.price_tier(F.col("x"))
    assert values(spark, number, [0.0, 4999.0, 5000.0, 45000.0, -1.0, None], "x double") == [1, 1, 2, 9, 1, None]
    assert values(spark, unit, [5000.0], "x double") == [590]
    assert values(spark, classify.work_model_label(F.col("x")), ["ＷＥＢ制作", "菓子の製造", "その他", "相談", " ", None]) != []
    assert values(spark, classify.work_model_label(F.col("x")), ["菓子の製造", "その他 x", "相談", " ", None]) == ["飲食・食品", "その他", "相談", "主活動未取得", "主活動未取得"]
    row = spark.createDataFrame([("大阪市北区1-2", None, "大阪市"), ("大阪府堺市", None, "堺市"), (None, None, "大阪市"), (None, None, None)], "c string, l string, m string")
    assert [r[0] for r in row.select(classify.area_label(F.col("c"), F.col("l"), F.col("m"))).collect()] == ["北区", "堺市", "大阪市（区未取得）", None]


def test_available_capacity_is_null_when_unknown(spark):
    df = spark.createDataFrame([(10.0, None, 12.0), (None, 20.0, 5.0), (None, None, 5.0), (10.0, None, None)], "a double, b double, c double")
    assert [r[0] for r in df.select(classify.available_capacity(F.col("a"), F.col("b"), F.col("c"))).collect()] == [0.0, 15.0, None, None]


def test_peer_rank_and_percentile(wages):
    df = wages(5, 5, 3, None, 1).withColumn("g", F.lit("a"))
    got = {r.ordinal: (r.p_count, r.p_rank) for r in peers.peer_rank(df, "g", "w", "p").collect()}
    assert got == {0: (4, 1), 1: (4, 1), 2: (4, 3), 3: (4, None), 4: (4, 4)}
    assert {r.ordinal: r.percentile_rank for r in peers.percentile_rank_strict(df, "w").collect()} == {0: 50, 1: 50, 2: 25, 3: None, 4: 0}
    assert peers.peer_rank(df.limit(2), "g", "w", "p").first().p_rank is None


def test_company_identity(spark):
    rows = [("1", "N1", "acme", "acme", "kim"), ("2", None, "acme", "acme", None), ("3", None, "acmeinc", "acme", "kim"), ("4", "N2", "twin", "twin", "a"), ("5", "N3", "twin", "twin", "b"), ("6", None, "twin", "twin", None), ("7", None, None, None, None), ("8", None, "acmeinc", "acmeinc", "x")]
    df = spark.createDataFrame(rows, "o string, n string, name string, base string, rep string")
    got = {r.o: r.company_key for r in entities.company_identity(df, "n", "name", "base", "rep", "o").collect()}
    assert got == {"1": "number:N1", "2": "number:N1", "3": "number:N1", "4": "number:N2", "5": "number:N3", "6": "name:twin", "7": "office:7", "8": "number:N1"}


def _pair(spark, **over):
    base = dict(rec=1, dir=1, rec_strict="abcdef", dir_strict="abcdef", rec_relaxed="abcdef", dir_relaxed="abcdef", same_number=True, same_company=False, number_candidates=2, n_strict=1, n_relaxed=1, rec_capacity=10.0, dir_capacity=10.0)
    return spark.createDataFrame([tuple((base | over).values())], "rec long, dir long, rec_strict string, dir_strict string, rec_relaxed string, dir_relaxed string, same_number boolean, same_company boolean, number_candidates long, n_strict long, n_relaxed long, rec_capacity double, dir_capacity double")


@pytest.mark.parametrize(("rule", "over", "score"), [
    (1, {}, 101.15),
    (2, dict(dir_strict="abcdefg", dir_capacity=11.0), None),
    (3, dict(rec_strict="abcxyz", dir_strict="qqqqqqqq"), 86.15),
    (4, dict(rec_strict="abcdefghij", dir_strict="abcdefgh1j", rec_relaxed="abcdefghijk", dir_relaxed="abcdefgh1jk", dir_capacity=12.0), None),
    (5, dict(rec_strict="xxxx", dir_strict="yyyyyyy", rec_relaxed="1234ab", dir_relaxed="9876ab", dir_capacity=None), None),
    (6, dict(same_number=False, same_company=True), 73.1),
    (7, dict(same_number=False, same_company=True, dir_strict="zzz"), 69.1),
    (8, dict(same_number=False, same_company=True, dir_strict="zzz", rec_relaxed="1234ab", dir_relaxed="9876ab"), 66.1),
    (9, dict(same_number=False), 71.0),
    (10, dict(same_number=False, dir_strict="abcdefgh"), None),
    (None, dict(same_number=False, dir_strict="zzz", dir_relaxed="qqq"), None),
])
def test_rule_cascade(spark, rule, over, score):
    got = linkage.link_rule_cascade(linkage.link_similarity(_pair(spark, **over))).collect()
    assert [r.rule for r in got] == ([rule] if rule else [])
    if score:
        assert got[0].score == pytest.approx(score, abs=1e-4)


PROPOSAL = "rec long, dir long, rule int, confidence string, method string, score double, strict_similarity double, relaxed_similarity double"


def test_ambiguity(spark):
    rows = [(1, 1, 4, "medium", "fuzzy", 80.0, 1.0, 1.0), (1, 2, 4, "medium", "fuzzy", 79.8, 1.0, 1.0), (2, 1, 4, "medium", "fuzzy", 80.0, 1.0, 1.0), (2, 2, 4, "medium", "fuzzy", 79.75, 1.0, 1.0), (3, 1, 1, "high", "corp_exact_name_strict", 100.0, 1.0, 1.0), (3, 2, 1, "high", "corp_exact_name_strict", 100.0, 1.0, 1.0), (4, 9, 4, "medium", "fuzzy", 80.0, 1.0, 1.0)]
    got = {(r.rec, r.dir) for r in linkage.link_ambiguity_filter(spark.createDataFrame(rows, PROPOSAL)).collect()}
    assert got == {(1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (4, 9)}


def test_assignment_equals_the_greedy(spark):
    r = random.Random(5)
    for _ in range(4):
        rows = list({(r.randrange(12), r.randrange(12)): None for _ in range(40)})
        rows = [(a, b, r.choice([0, 1, 4]), r.choice(["high", "medium", "low"]), "m", float(r.randrange(4)), r.choice([0.5, 1.0]), 1.0) for a, b in rows]
        level = {"high": 3, "medium": 2, "low": 1}
        want, used_a, used_b = set(), set(), set()
        for x in sorted(rows, key=lambda x: (-level[x[3]], -x[5], -x[6], -x[7], x[2] == 0, x[0], x[1])):
            if x[0] not in used_a and x[1] not in used_b:
                want.add(x[:2])
                used_a.add(x[0])
                used_b.add(x[1])
        assert {(x.rec, x.dir) for x in linkage.link_assign_one_to_one(spark.createDataFrame(rows, PROPOSAL)).collect()} == want
    assert linkage.link_assign_one_to_one(spark.createDataFrame([], PROPOSAL)).count() == 0


def test_similarity_is_record_first(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("", "a"), ("a", "a")], "a string, b string")
    assert [r[0] for r in df.select(linkage.sequence_ratio("a", "b")).collect()] == [0.25, 0.5, 0.0, 1.0]
    assert [r[0] for r in df.select(linkage.common_suffix(F.col("a"), F.col("b"))).collect()] == [0, 0, 0, 1]


def test_first_and_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (" ", 3, "z"), (None, 4, "w")], "k string, ordinal long, v string")
    assert sorted(r.v for r in linkage.dedupe_first_wins(df, "k", "ordinal").collect()) == ["w", "x", "z"]
    assert [(r.k, r.v) for r in enrich.last_wins(df, "k", "ordinal").collect()] == [("a", "y")]


def test_pages(spark):
    html = '<a href="/a">x</a><a href="b.html">y</a><a href="https:\\/\\/H.example.com/c?x=1">z</a><a href="#t">q</a><a href="mailto:a@b">m</a><a href="/a/">x</a><a href="https://lit.link/me">l</a>'
    df = spark.createDataFrame([(1, "http://s.example.com/dir/p", html), (2, "https://lit.link/me", "go https://www.instagram.com/abc/ now"), (3, "http://s.example.com/a", None), (4, None, "")], "page_id long, url string, html string")
    links = pages.page_links(df)
    assert {(r.page_id, r.url) for r in links.collect()} == {(1, "http://s.example.com/a"), (1, "http://s.example.com/dir/b.html"), (1, "https://h.example.com/c"), (1, "https://lit.link/me")}
    bridges, inner = pages.extract_bridge_links(links), pages.rank_internal_links(links)
    profiles = pages.extract_profile_links(df, "https://www\\.instagram\\.com/[a-z]+")
    assert {r.page_id: r.profiles for r in profiles.collect()}[2] == ["https://www.instagram.com/abc"]
    reached = {r.page_id: (r.profile, r.phase) for r in pages.profile_reachability(df, links, profiles, inner, bridges).collect()}
    assert reached == {1: ("https://www.instagram.com/abc", 1), 2: ("https://www.instagram.com/abc", 0)}
    assert sorted(r.url for r in inner.collect()) == ["http://s.example.com/a", "http://s.example.com/dir/b.html"]


def test_result_lists_and_feeds(spark):
    item = '<a rel="nofollow" class="result__a" href="https://{0}.example.com/">T &amp; {0}</a><p><a class="result__snippet" href="#">S<b>x</b></a>'
    feed = "<rss><channel><item><title>t1</title><link>https://f.example.com/1</link><description>d1</description></item></channel></rss>"
    df = spark.createDataFrame([(1, "".join(item.format(f"h{i}") for i in range(10))), (2, "nothing")], "page_id long, html string")
    got = pages.parse_result_lists(df).orderBy("position").collect()
    assert len(got) == 8 and (got[0].url, got[0].title, got[0].snippet) == ("https://h0.example.com", "T & h0", "S x")
    assert [(r.url, r.title, r.snippet) for r in pages.parse_feeds(spark.createDataFrame([(1, feed)], "page_id long, html string")).collect()] == [("https://f.example.com/1", "t1", "d1")]


def test_candidates(spark):
    rows = [("1", "Ao Works", "株式会社Kumo", "Kita", "https://ao.example.com", "Ao works - 公式", "kumo kita b型", 0), ("1", "Ao Works", "株式会社Kumo", "Kita", "https://blocked.example.com", "ao works", "", 1), ("2", "Zz", "", "", "https://q.example.com", "none", "", 0)]
    df = spark.createDataFrame(rows, "k string, office_name string, corporation_name string, municipality string, url string, title string, snippet string, p int")
    scored = pages.score_candidates(df, F.col("url").contains("blocked"))
    assert sorted((r.k, r.score, r.reason) for r in scored.collect()) == [("1", -999, "blocked"), ("1", 11, "office+corp+area+service"), ("2", 0, "weak")]
    assert [(r.k, r.confidence) for r in pages.pick_best_candidate(scored, "k", "p").collect()] == [("1", "high")]


def test_sitemaps_and_robots(spark):
    maps = spark.createDataFrame([("http://s.example.com/sitemap.xml", "<loc> http://s.example.com/about </loc><loc>http://s.example.com/x.pdf</loc><loc>http://o.example.com/y</loc><loc>http://s.example.com/</loc>")], "url string, body string")
    assert [(r.url, r.place) for r in pages.sitemap_pages(maps).orderBy("place").collect()] == [("http://s.example.com/about", 1), ("http://s.example.com", 2)]
    robots = spark.createDataFrame([("http://s.example.com/robots.txt", "User-agent: *\nSitemap: http://s.example.com/m.xml\n")], "url string, body string")
    assert [r.url for r in pages.robots_sitemaps(robots).collect()] == ["http://s.example.com/m.xml"]


def test_stitching(spark):
    df = spark.createDataFrame([("d", "header\n2712345678 Ao\nworks 大阪市 kita\n\nhttps//ao.example.com\n2712345679 Next 大阪市"), ("e", None), ("f", "nothing")], "k string, t string")
    rows = pages.parse_stitched_rows(pages.stitch_multiline_rows(df, "k", "t"))
    assert [(r.number, r.name, r.url) for r in rows.orderBy("row").collect()] == [("2712345678", "Ao works", "https://ao.example.com"), ("2712345679", "Next", None)]


def test_sources(spark, tmp_path):
    from pyspark.sql.types import StringType, StructField, StructType

    fields = StructType([StructField("a", StringType())])
    (tmp_path / "m.json").write_text('{"data_files": {"record_chunks": ["c0.json", "c1.json"]}}')
    (tmp_path / "c0.json").write_text('{"records": [{"a": "1"}, 5, {"a": "2"}]}')
    (tmp_path / "c1.json").write_text('[{"a": "3"}]')
    (tmp_path / "bad.json").write_text('{"x": 1}')
    got = tables.read_manifest_chunks(spark, str(tmp_path), "m.json", fields).orderBy("chunk", "position").collect()
    assert [(r.a, r.chunk, r.position) for r in got] == [("1", 0, 0), ("2", 0, 2), ("3", 1, 0)]
    with pytest.raises(Exception, match="expected an array"):
        tables.read_record_document(spark, str(tmp_path / "bad.json"), fields).collect()
    assert tables.read_csv_lookup(spark, str(tmp_path / "none.csv"), ("a",)).count() == 0
    df = spark.range(0, 601).withColumnRenamed("id", "ordinal")
    assert sorted((r.chunk, r["count"]) for r in tables.write_chunks(df, str(tmp_path / "chunks"), "ordinal").collect()) == [(0, 250), (1, 250), (2, 101)]
    assert tables.incremental_refresh(df.limit(3), df, "ordinal", lambda new: new, force=True).count() == 601


def test_filters(spark):
    assert filters.preset_of({"risk": "likely", "flag": None}) == "shortage" and filters.preset_of({"flag": "low"}) is None
    df = spark.createDataFrame([(1, True, None, "b"), (2, False, "high", None), (3, None, "low", "a")], "ordinal long, b boolean, x_flag string, t string")
    order = lambda c, d: [r.ordinal for r in filters.sort_records(df, c, d).collect()]
    assert order("b", True) == [1, 2, 3] and order("b", False) == [2, 1, 3] and order("x_flag", True) == [2, 3, 1] and order("t", True) == [1, 3, 2]
    assert [r.ordinal for r in filters.page_rows(df, [F.col("ordinal").asc()], 99, 2).collect()] == [3]


def test_series_ties_take_the_first_row(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, None)], "ordinal long, g string")
    assert [r.label for r in reports.top_counts(df, "g", 2).collect()] == ["b", "a"]
    same = spark.createDataFrame([("k", 2.0, 3.0)], "o string, x double, y double")
    assert tuple(reports.scatter_points(same, "o", "x", "y").first()) == ("k", 0.0, 0.0)


@pytest.mark.parametrize("seed", range(3))
def test_exact_quantiles_equal_numpy(spark, seed):
    """Values of all sizes and signs, ties, nulls and NaN; one group of each kind and a null group."""
    r = random.Random(seed)
    draw = [lambda: r.choice([0.0, -0.0, 1e-9, -1e-9, 3.0, -2.5]), lambda: r.gauss(0, 1e6), lambda: r.random(), lambda: float(r.randrange(5))]
    rows = [(r.choice(["a", "b", None]), r.choice(draw)()) for _ in range(400)] + [("a", None), ("b", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = (0.0, 0.1, 0.5, 0.9, 1.0)
    known = [(g, v) for g, v in rows if v is not None and v == v]
    assert stats.exact_quantiles(df, "v", shares).first()[0] == pytest.approx(np.quantile([v for _, v in known], shares))
    got = {x.g: x._q for x in stats.exact_quantiles(df, "v", shares, ("g",)).collect()}
    assert got.keys() == {"a", "b", None} and all(q == pytest.approx(np.quantile([v for h, v in known if h == g], shares)) for g, q in got.items())
    ranked = {(x.g, x.v): (x.smaller, x.all) for x in stats.ranked_values(df, "v", ("g",)).collect()}
    for g, v in known:
        own = [w for h, w in known if h == g]
        assert ranked[g, v] == (sum(w < v for w in own), len(own))
    assert stats.exact_quantiles(df.limit(0), "v", shares).first()[0] == [None] * 5


def test_shared_tables_follow_the_files(spark, tmp_path):
    from peerlight.plans.context import Tables, _state

    spark.range(3).write.parquet(str(tmp_path / "a.parquet"))
    t = Tables(spark, str(tmp_path))
    assert t._once("x", lambda: spark.range(3).toDF("id")).count() == Tables(spark, str(tmp_path))._once("x", lambda: spark.range(9).toDF("id")).count() == 3
    spark.range(5).write.mode("append").parquet(str(tmp_path / "a.parquet"))
    assert _state(spark, str(tmp_path)) != t.state and Tables(spark, str(tmp_path))._once("x", lambda: spark.range(5).toDF("id")).count() == 5


def test_linkage_end_to_end_equals_its_steps(spark):
    from peerlight.plans.context import TOKENS, Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    columns = ["rec", "dir", "rule", "confidence", "method", "score"]
    whole = linkage.link(t.office, t.directory, t.overrides, TOKENS, nfkc=False).select(*columns)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, t.chosen.select(*columns).collect()))


def test_search_reads_all_fields_that_there_are(spark):
    row = {c: f"Field {i}!" for i, c in enumerate(filters.SEARCHED)}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row))
    assert len(filters.SEARCHED) == 16 and all(filters.filter_records(df, {"search": f"field {i}!"}).count() == 1 for i in range(16))
    assert filters.filter_records(df, {"search": "field 16"}).count() == 0 and filters.searched(df.select("area")) == ("area",)


def test_representative_companies_by_offices_wage_and_name(spark):
    rows = [("r", "k1", "b", "1", 10.0, "p1"), ("r", "k1", "bb", None, None, "p2"), ("r", "k2", "c", "2", None, "p"), ("r", "k3", "a", "3", 5.0, "p"), ("r", "k4", None, None, 5.0, "p"), (None, "k9", "z", "9", 1.0, "p")]
    df = spark.createDataFrame(rows, "rep string, company string, name string, number string, wage double, person string")
    got = entities.representative_companies(df, "rep", "company", "wage", "name", F.lit(False), "number", "person").orderBy("place").collect()
    assert [(x.company, x.company_name, x.company_number, x.representative_name) for x in got] == [("k1", "b", "1", "p1"), ("k4", None, None, "p"), ("k3", "a", "3", "p"), ("k2", "c", "2", "p")]


def test_feeds_that_are_not_well_formed(spark):
    feed = "<rss><item><title>A &amp; B<link>x</item><item><link>https://a.example.com/x?a=1&b=2</link><title><![CDATA[ T ]]></title></item>"
    got = pages.parse_feeds(spark.createDataFrame([(1, feed), (2, "no feed"), (3, None)], "page_id long, html string")).collect()
    assert [(x.page_id, x.position, x.url, x.title, x.snippet) for x in got] == [(1, 1, "https://a.example.com/x", "T", "")]
