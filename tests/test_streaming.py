from pyspark.sql import functions as F

from sparkhist.operators import histogram
from sparkhist.plans.layouts import LogLinearLayout
from sparkhist.streaming.recording import append_sink, read_sink, record_windows

LAYOUT = LogLinearLayout(1, 0.05, -500, 5000)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type", "value")
    source = tmp_path / "in"
    events.orderBy("ts").coalesce(1).write.parquet(str(source))
    # A last event far ahead lets the watermark close all windows before it.
    late = events.limit(1).withColumn("ts", F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = record_windows(stream, "ts", "value", LAYOUT, "1 day", late="1 hour", keys=["event_type"])
    q = (
        out.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c"))
        .foreachBatch(append_sink(str(tmp_path / "out"))).start()
    )
    q.processAllAvailable()
    late.write.mode("append").parquet(str(source))
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    got = read_sink(spark, str(tmp_path / "out"), ["event_type"])
    batch = record_windows(events, "ts", "value", LAYOUT, "1 day", keys=["event_type"])
    assert rows(got) == rows(batch.select(*got.columns))


def test_windows_add_up(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    daily = record_windows(events, "ts", "value", LAYOUT, "1 day")
    whole = histogram.record(events, "value", LAYOUT)
    assert histogram.equal(histogram.merge(daily), whole).first().equal_bins
    sliding = record_windows(events, "ts", "value", LAYOUT, "2 days", "1 day")
    assert sliding.agg(F.sum("bin_count")).first()[0] == 2 * events.count()
    sessions = record_windows(events, "ts", "value", LAYOUT, "1 hour", keys=["user_id"], session=True)
    assert sessions.agg(F.sum("bin_count")).first()[0] == events.count()
    weighted = record_windows(events.withColumn("w", F.lit(2)), "ts", "value", LAYOUT, "1 day", weight="w")
    assert weighted.agg(F.sum("bin_count")).first()[0] == 2 * events.count()


def test_stream_sessions_equal_batch(spark, sf, tmp_path):
    """Sessions of a stream, kept as bins and joined by late rows, equal those of the table."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", "user_id", "value").where("user_id < 40")
    source = tmp_path / "in"
    for part in (0, 1, 2):  # each file has rows of all times
        events.where(F.pmod(F.hash("ts"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(str(source))
    late = events.limit(1).withColumn("ts", F.lit("2090-01-01 00:00:00").cast("timestamp_ntz"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    how = dict(keys=["user_id"], session=True, late="9000 days")
    out = record_windows(stream, "ts", "value", LAYOUT, "12 hours", **how)
    q = (
        out.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c"))
        .foreachBatch(append_sink(str(tmp_path / "out"))).start()
    )
    q.processAllAvailable()
    late.write.mode("append").parquet(str(source))
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    got = read_sink(spark, str(tmp_path / "out"), ["user_id"])
    batch = record_windows(events, "ts", "value", LAYOUT, "12 hours", keys=["user_id"], session=True)
    assert rows(got) == rows(batch.select(*got.columns)) and batch.count() > 40


def test_sessions_join_and_keep_signed_zeros():
    from sparkhist.streaming.recording import add_to_sessions

    open_ = add_to_sessions([], [0, 50, 10], [(0, 1, 0.0), (3, 2, 7.0), (0, 1, -0.0)], 20)
    assert [(a, b) for a, b, _ in open_] == [(0, 10), (50, 50)]
    assert str(open_[0][2][0]) == "[2, -0.0, 0.0]"
    joined = add_to_sessions(open_, [29, 40], [(3, 1, 6.0), (4, 1, 9.0)], 20)
    assert [(a, b) for a, b, _ in joined] == [(0, 50)]
    assert joined[0][2][3] == [3, 6.0, 7.0] and joined[0][2][4] == [1, 9.0, 9.0]


def test_windows_keep_signed_zeros(spark):
    df = spark.createDataFrame([(0, 0.0), (1, -0.0), (2, 0.0)], "s long, x double").withColumn("ts", F.timestamp_seconds("s"))
    layout = LogLinearLayout(1, 0.05, -500, 5000)
    for r in record_windows(df, "ts", "x", layout, "1 day").collect():
        assert (str(r.bin_min), str(r.bin_max)) == (("-0.0", "-0.0") if r.bin_index < 0 else ("0.0", "0.0"))
