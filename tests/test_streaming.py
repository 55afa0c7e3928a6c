"""Streams over parquet give what the batch operators give."""

from datetime import datetime, timedelta

from quire.operators import queue
from quire.streaming import queue as stream

T0 = datetime(2025, 1, 1)


def log(spark, tmp_path):
    names = ["claim", "complete", "reschedule", "claim", "fail", "reset"]
    rows = [(i % 5, T0 + timedelta(minutes=i), names[i * 7 % 6]) for i in range(120)]
    df = spark.createDataFrame(rows, "unit long, ts timestamp, event string")
    path = str(tmp_path / "log")
    df.coalesce(1).write.parquet(path)
    return df, spark.readStream.schema(df.schema).parquet(path)


def run(query_df, name, mode):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return query_df.sparkSession.table(name).collect()


def test_states_equal_the_batch_fold(spark, tmp_path):
    df, live = log(spark, tmp_path)
    got = {r.unit: (r.status, r.applied) for r in run(stream.unit_states(live, "unit", "ts", "event"), "states", "update")}
    assert got == {r.unit: (r.status, r.applied) for r in queue.replay(df, "unit", ["ts"], "event").collect()}


def test_windows(spark, tmp_path):
    df, live = log(spark, tmp_path)
    got = {tuple(r) for r in run(stream.window_counts(live, "ts", "event"), "windows", "complete")}
    assert got == {tuple(r) for r in stream.window_counts(df, "ts", "event").collect()}
    assert len(run(stream.once_each(live, "unit", "ts"), "once", "append")) == 5
