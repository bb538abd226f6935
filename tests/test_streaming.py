"""Streaming forms give the bounded result when everything available is read."""

import datetime as dt

from pyspark.sql import functions as F

from strandline.streaming import live

SCHEMA = "id long, k string, ts timestamp, value double"


def _rows(n):
    start = dt.datetime(2024, 1, 1)
    return [(i, "ab"[i % 2], start + dt.timedelta(minutes=i * 7 + (i // 40) * 600), float(i * 37 % 101)) for i in range(n)]


def _memory(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def test_sessions_and_windows_match_batch(spark, tmp_path):
    rows = _rows(200)
    far = (10_000, "a", dt.datetime(2025, 1, 1), 0.0)  # moves the watermark past every window
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    spark.createDataFrame([far], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    batch = spark.createDataFrame(rows, SCHEMA)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(path)

    forms = {
        "events": lambda d: live.quiet_gap_events(d, ["k"], "ts", "value", 30.0, "2 hours", "1 hour"),
        "totals": lambda d: live.windowed_totals(d, ["k"], "ts", {"total": F.sum("value"), "n": F.count(F.lit(1))}, "3 hours", "1 hour", "1 hour"),
    }
    for name, form in forms.items():
        _memory(form(stream()), name)
        want = sorted(map(tuple, form(batch).collect()))
        assert sorted(map(tuple, spark.table(name).collect())) == want


def test_ingest_resumes(spark, tmp_path):
    src, out, check = (str(tmp_path / p) for p in ("in", "out", "check"))
    spark.createDataFrame(_rows(50) + _rows(50), SCHEMA).write.parquet(src)
    for _ in range(2):
        s = live.deduplicated(spark.readStream.schema(SCHEMA).parquet(src), ["id"], "ts", "30 days")
        live.ingest(s, out, check).awaitTermination()
    assert spark.read.parquet(out).count() == 50
    spark.createDataFrame(_rows(60)[50:], SCHEMA).write.mode("append").parquet(src)
    live.ingest(live.deduplicated(spark.readStream.schema(SCHEMA).parquet(src), ["id"], "ts", "30 days"), out, check).awaitTermination()
    assert spark.read.parquet(out).count() == 60
