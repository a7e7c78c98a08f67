"""The search index against the scan."""

import random

from pyspark.sql import functions as F

from peerlight.operators import filters, search


def test_index_finds_what_the_scan_finds(spark, tmp_path):
    r = random.Random(4)
    letters = "abcÄé 中\U0001f600-İ"
    word = lambda n: "".join(r.choice(letters) for _ in range(r.randrange(n)))
    data = [(f"k{i % 280}", word(25) or None, r.choice([None, word(8)])) for i in range(300)]
    df = spark.createDataFrame(data, "office_no string, office_name string, remarks string").repartition(3)
    columns, path = ("office_name", "remarks"), str(tmp_path / "index")
    search.write_index(df, "office_no", path, columns)
    search.write_index(df, "office_no", path, columns)  # once more in its place
    texts = [x.t for x in df.select(search.row_text(columns).alias("t")).collect()]
    queries = ["", " ", "a", "ab", "zzz", "ABC", "no such text"] + [t[a : a + r.randrange(1, 9)].upper() for t in r.sample([t for t in texts if len(t) > 12], 8) for a in [r.randrange(8)]]
    fewer = 0
    for q in queries:
        scan = sorted(df.filter(filters.search_text(q, columns)).collect())
        assert sorted(search.search_indexed(df, "office_no", path, q, columns).collect()) == scan
        found = search.candidates(df, "office_no", path, q)
        if found is not None:
            read = found.count()
            assert read >= len({x.office_no for x in scan})
            fewer += read < 100
    assert fewer >= 4


def test_index_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "office_no long, office_name string")
    search.write_index(df, "office_no", str(tmp_path), ("office_name",))
    assert search.search_indexed(df, "office_no", str(tmp_path), "abc", ("office_name",)).count() == 0


def test_query_reads_the_folders_of_its_pieces(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("office_no"), F.concat(F.lit("office number "), F.col("id").cast("string")).alias("office_name"))
    search.write_index(df, "office_no", str(tmp_path), ("office_name",))
    found = search.candidates(df, "office_no", str(tmp_path), "number 499")
    assert {r.key for r in found.collect()} == {499}
    assert "PartitionFilters: [" in found._jdf.queryExecution().explainString(found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert [r.office_no for r in search.search_indexed(df, "office_no", str(tmp_path), " Number 499", ("office_name",)).collect()] == [499]
