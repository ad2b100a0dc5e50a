"""The streaming extension: a stream's counts are the table's."""

from vellum.streaming.words import windowed_counts, word_stream


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 4}:{i % 60:02d}:00", ["a", "b"][i % 2], float(i)) for i in range(40)]
    events = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp) ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = windowed_counts(stream, late="10 days").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, windowed_counts(events).collect()))
    docs = spark.createDataFrame([("a b a",), (None,)], "text string")
    assert sorted(map(tuple, word_stream(docs).collect())) == [("a", 2), ("b", 1)]
