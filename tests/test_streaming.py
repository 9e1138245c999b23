from sievekit.operators.lines import lines_of, rule_hits
from sievekit.streaming import scan

RULES = [{"rule_id": "A", "patterns": ["bad"], "not": []}]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "ok\nbad one\n"), (2, "bad\nbad"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    found = scan.stream_findings(stream, RULES, "doc_id", "text")
    scan.append_to(found, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    batch = rule_hits(lines_of(df, "doc_id", "text"), RULES)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect())) and batch.count() == 3


def test_stream_clusters(spark, tmp_path):
    df = spark.sql("select k, timestamp_seconds(s) as at from values ('a', 0), ('a', 4), ('a', 20), ('b', 1), ('a', 100000) as t(k, s)")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = scan.stream_clusters(stream, ["k"], "at", "5 seconds", "10 seconds")
    query = out.writeStream.format("memory").queryName("clusters").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.k, r.occurrence_count) for r in spark.table("clusters").collect()) == [("a", 1), ("a", 1), ("a", 2), ("b", 1)]
