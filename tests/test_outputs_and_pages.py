"""Chunks that read back, numbers, deep pages, stitching in proportion, and the frontier against a plain queue."""

import json
import random
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from peerlight.functions.numbers import coerce_key, coerce_numeric
from peerlight.operators import filters, linkage, pages
from peerlight.sources import tables

FIELDS = ty.StructType([ty.StructField("ordinal", ty.LongType()), ty.StructField("name", ty.StringType())])


def frame(spark, n, start=0):
    return spark.range(start, start + n).select(F.col("id").alias("ordinal"), F.concat(F.lit("name \"é\" "), F.col("id").cast("string")).alias("name"))


def read(spark, path):
    return [(r.ordinal, r.name, r.chunk, r.position) for r in tables.read_manifest_chunks(spark, path, tables.MANIFEST, FIELDS).orderBy("chunk", "position").collect()]


def test_chunks_read_back(spark, tmp_path):
    path = str(tmp_path / "with space=x")
    counts = {r.chunk: r["count"] for r in tables.write_chunks(frame(spark, 620).repartition(5), path, "ordinal").collect()}
    assert counts == {0: 250, 1: 250, 2: 120}
    assert read(spark, path) == [(i, f'name "é" {i}', i // 250, i % 250) for i in range(620)]
    tables.write_chunks(frame(spark, 30, 5), path, "ordinal", 7)
    assert [r[0] for r in read(spark, path)] == list(range(5, 35))
    assert len(list(Path(path).glob("data-*"))) == 1
    manifest = json.loads((Path(path) / tables.MANIFEST).read_text())
    assert manifest["data_files"]["record_count"] == 30 and len(manifest["data_files"]["record_chunks"]) == 5
    tables.write_chunks(frame(spark, 0), path, "ordinal")
    assert read(spark, path) == []


def test_a_failed_run_leaves_the_old_chunks(spark, tmp_path):
    path = str(tmp_path / "out")
    tables.write_chunks(frame(spark, 10), path, "ordinal")
    bad = frame(spark, 300).withColumn("name", F.when(F.col("ordinal") == 299, F.raise_error(F.lit("no")).cast("string")).otherwise(F.col("name")))
    with pytest.raises(PySparkException):
        tables.write_chunks(bad, path, "ordinal").count()
    (Path(path) / "data-stray" / "chunk=0").mkdir(parents=True)
    (Path(path) / "data-stray" / "chunk=0" / "part-0").write_text('{"records": [{"ordinal": 99}]}')
    assert [r[0] for r in read(spark, path)] == list(range(10))


def test_manifest_of_files_of_other_writers(spark, tmp_path):
    """Chunks that are files, names of which one ends like another, and a chunk in a folder below."""
    (tmp_path / "a" / "b").mkdir(parents=True)
    for i, name in enumerate(("a/1.json", "a/11.json", "a/b/1.json", "1.json")):
        (tmp_path / name).write_text(json.dumps([{"ordinal": i, "name": name}, 5]))
    (tmp_path / tables.MANIFEST).write_text(json.dumps({"data_files": {"record_chunks": ["a/b/1.json", "1.json", "a/11.json"]}}))
    assert [(r[0], r[2]) for r in read(spark, str(tmp_path))] == [(2, 0), (3, 1), (1, 2)]


def test_table_outputs(spark, tmp_path):
    path = str(tmp_path)
    report = spark.createDataFrame([(1, "a,b")], "rec int, name string")
    summary = spark.createDataFrame([("side", "matched", 3), ("side", "unmatched", 4), ("method", "x", 3)], "block string, label string, count long")
    tables.write_table_outputs(frame(spark, 3), path, report, summary)
    assert spark.read.option("header", True).csv(f"{path}/report").collect()[0].name == "a,b"
    assert json.loads((tmp_path / "summary.json").read_text()) == {"side": {"matched": 3, "unmatched": 4}, "method": {"x": 3}}
    tables.write_table_outputs(frame(spark, 3), path, None, summary.limit(0))
    assert json.loads((tmp_path / "summary.json").read_text()) == {}


def test_numbers(spark):
    values = [" 12.3456 ", "", "  ", None, "x", "NaN", "Infinity", "-1e3", "1,5"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(coerce_numeric(F.col("v"), 3).alias("n"), coerce_key(F.col("v")).alias("k")).collect()
    assert [r.n for r in rows] == [12.346, None, None, None, None, None, None, -1000.0, None]
    assert [r.k for r in rows][:4] == ["12.3456", None, None, None]
    assert spark.range(1).select(coerce_numeric(F.lit(float("nan"))).alias("n")).first().n is None


@pytest.mark.parametrize("descending", [False, True])
def test_deep_pages_are_those_of_the_whole_sort(spark, descending):
    r = random.Random(1)
    data = [(i, r.choice([None, *range(12)])) for i in range(997)]
    df = spark.createDataFrame(data, "ordinal long, v int").repartition(4)
    keys = filters.sort_keys(df, "v", descending)
    whole = [x.ordinal for x in df.orderBy(*keys).collect()]
    for page in (-3, 1, 2, 10, 19, 20, 10**6):
        for size, ranges in ((50, 60), (50, 10**6), (130, 100)):
            at = min(max(page, 1), -(-997 // size))
            assert [x.ordinal for x in filters.page_rows(df, keys, page, size, ranges).collect()] == whole[(at - 1) * size : at * size]
    _, counts = filters.page_ranges(df, keys, 997, 60)
    assert len(counts) > 10 and max(counts.values()) <= 200
    assert filters.page_rows(df.limit(0), keys, 5).count() == 0


def test_stitching_of_a_very_long_text(spark):
    n = 200_000
    text = "\n".join(f"{i:010d} name" if i % 4 == 0 else " more " if i % 4 == 1 else "" for i in range(n))
    df = spark.createDataFrame([(1, text), (2, "lost\n0000000001 a\n b\n\n0000000002 c"), (3, None), (4, ""), (5, "lost")], "id int, text string")
    rows = pages.stitch_multiline_rows(df, "id", "text").collect()
    assert [(r.row, r.content) for r in rows if r.id == 2] == [(0, "0000000001 a b"), (1, "0000000002 c")]
    first = sorted((r.row, r.content) for r in rows if r.id == 1)
    assert len(first) == n // 4 and first[5] == (5, "0000000020 name more") and {r.id for r in rows} == {1, 2}


def plain_search(start, first, inner, bridges, maps, checks=8, map_checks=4):
    """A queue of pages, as one program works it off."""
    if start in first:
        return first[start], 0
    queue, visited = [], []

    def add(p):
        for x in inner.get(p, []):
            if x not in visited and x not in queue:
                queue.append(x)

    def bridged(p):
        return next((first[b] for b in bridges.get(p, []) if b in first), None)

    if bridged(start):
        return bridged(start), 1
    add(start)
    for _ in range(checks):
        if not queue:
            break
        p = queue.pop(0)
        visited.append(p)
        if p in first:
            return first[p], 2
        if bridged(p):
            return bridged(p), 3
        add(p)
    for p in [x for x in maps if x not in visited and x not in queue][:map_checks]:
        if p in first:
            return first[p], 4
        if bridged(p):
            return bridged(p), 5
    return None


PHASES = {1: {0, 1, 2}, 2: {0, 2, 4}, 3: {0, 1, 2, 3}, 5: {0, 2}}


@pytest.mark.parametrize("seed, rare", [(1, 12), (2, 30), (3, 60), (5, 60)])
def test_frontier_is_that_of_a_plain_queue(spark, seed, rare):
    r = random.Random(seed)
    n = 120
    url = lambda i: f"https://h{i % 3}.example.com/p{i}"
    first = {i: f"profile{i}" for i in range(n) if r.randrange(rare) == 0}
    inner = {i: r.sample(range(n), r.randrange(2 if seed == 5 else 4)) for i in range(n)}
    bridges = {i: r.sample(range(n), r.randrange(3)) for i in range(n) if r.randrange(4) == 0}
    maps = {h: r.sample([i for i in range(n) if i % 3 == h], 6) for h in range(3)}
    stored = spark.createDataFrame([(i, url(i)) for i in range(n)] + [(n + 5, url(3) + "/")], "page_id long, url string")
    profiles = spark.createDataFrame([(i, [first[i], "x"] if i in first else []) for i in range(n)], "page_id long, profiles array<string>")
    table = lambda of: spark.createDataFrame([(i, url(x) if k != 1 else url(x), 2 * k + 1) for i, xs in of.items() for k, x in enumerate(xs)] + [(0, "https://gone.example.com/x", 0)], "page_id long, url string, place int")
    listed = spark.createDataFrame([(f"h{h}.example.com", url(x), k) for h, xs in maps.items() for k, x in enumerate(xs)] + [("h0.example.com", "https://h0.example.com/gone", -1)], "host string, url string, place int")
    got = {x.page_id: (x.profile, x.phase) for x in pages.profile_reachability(stored, None, profiles, table(inner), table(bridges), listed).collect()}
    want = {i: plain_search(i, first, inner, bridges, maps[i % 3]) for i in range(n)}
    assert {i: w for i, w in want.items() if w} == {i: g for i, g in got.items() if i < n}
    assert {w[1] for w in want.values() if w} >= PHASES[seed]


def test_match_report_has_its_evidence(spark):
    o = spark.createDataFrame([(1, "1", "North Works 7", "c", "east", 10.0), (2, "2", "b", "c", "east", 10.0)], "ordinal long, office_no string, office_name string, corporation_name string, municipality string, capacity double")
    d = spark.createDataFrame([(5, "D5", "South 7", "c", "east", 12.0), (6, "D6", "b", "c", "east", 10.0)], "ordinal long, office_number string, office_name string, corporation_name string, office_address_city string, office_capacity double")
    chosen = spark.createDataFrame([(1, 5, "corp_exact_suffix_match"), (2, 6, "manual_override")], "rec long, dir long, method string")
    reasons = spark.createDataFrame([("1", "D5", "no", 1), ("2", "D6", "old", 1), ("2", "D6", "phone call", 2)], "record_office_no string, directory_office_number string, reason string, ordinal int")
    rows = {r.rec: r for r in linkage.link_match_report(chosen, o, d, ("works",), overrides=reasons).collect()}
    assert (rows[1].suffix_length, rows[1].capacity_exact, rows[1].capacity_close, rows[1].override_reason) == (3, False, True, None)
    assert (rows[2].suffix_length, rows[2].capacity_exact, rows[2].override_reason) == (1, True, "phone call")
