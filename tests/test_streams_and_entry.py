import datetime as dt
import os

import pytest

import __spark_entry__ as entry
from loomtext.streaming import pages as stream


def test_articles_on_a_stream(spark, tmp_path):
    rows = [(i, "http://s.com/", f"<title>t{i}</title><div>{'body text ' * 20}</div>") for i in range(20)]
    df = spark.createDataFrame(rows, stream.PAGE)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    q = stream.article_stream(stream.page_stream(spark, str(tmp_path / "in"), 1)).writeStream.format("memory").queryName("articles_of_stream").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {r.title for r in spark.table("articles_of_stream").collect()} == {f"t{i}" for i in range(20)}


def test_late_events_are_left_out(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    parts = [[("a", t, 1.0), ("a", t + dt.timedelta(hours=5), 2.0)], [("a", t + dt.timedelta(minutes=1), 9.0), ("b", t + dt.timedelta(hours=9), 3.0)]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, "event_type string, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    events = spark.readStream.schema("event_type string, ts timestamp, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = stream.counter_series(events).writeStream.format("memory").queryName("counters_of_stream").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    first = [r for r in spark.table("counters_of_stream").collect() if r.start == t]
    assert len(first) == 1 and first[0].n in (1, 2)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["page_id", "url", "title"] and df.count() == 50
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 60
