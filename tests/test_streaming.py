import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkseek.model import CHANGE
from sparkseek.operators.store import RecordStore
from sparkseek.streaming import changes as streams
from sparkseek.streaming import control

T0 = dt.datetime(2026, 1, 1)


def change(parent, name, op, seq, size=None, content=None, stage=1):
    return (parent, name, op, stage, size, None, content, seq, T0 + dt.timedelta(minutes=seq))


def test_stream_equals_batch(spark, tmp_path, rows):
    log = [
        [change("p", "a", 0, 1, 1), change("p", "b", 0, 2, 1), change("q", "a", 0, 3, 3)],
        [change("p", "a", 1, 4), change("p", "b", 0, 6, 9), change("p", "b", 0, 5, 8)],
        [change("p", "a", 0, 8, 5), change("p", "a", 1, 7)],
    ]
    folder = str(tmp_path / "log")
    for part in log:
        spark.createDataFrame(part, CHANGE).coalesce(1).write.mode("append").parquet(folder)
    feed = streams.read_changes(spark, folder, files_per_trigger=1)
    query = streams.apply_stream(feed, f"file://{tmp_path}/store", f"{tmp_path}/cp", query_name="t")
    query.awaitTermination()
    store = RecordStore(spark, f"file://{tmp_path}/store")
    batch = RecordStore(spark, f"file://{tmp_path}/batch")
    for i, part in enumerate(log):
        batch.apply(spark.createDataFrame(part, CHANGE), f"b{i}")
    assert rows(store.read(), "parent", "name", "size") == rows(batch.read(), "parent", "name", "size") == [("p", "a", 5), ("p", "b", 9), ("q", "a", 3)]
    g = store.generation
    streams.apply_stream(feed, f"file://{tmp_path}/store", f"{tmp_path}/cp").awaitTermination()
    assert RecordStore(spark, f"file://{tmp_path}/store").generation == g


def test_enriched(spark, rows):
    df = spark.createDataFrame([change("p", "a", 0, 1, 5), change("p", "a", 0, 2, None, "text", 3), change("p", "b", 0, 1, 7), change("p", "b", 1, 2), change("p", "c", 1, 1), change("p", "c", 0, 2, 4)], CHANGE)
    assert rows(streams.enriched(df), "name", "op", "size", "content") == [("a", 0, 5, "text"), ("b", 1, 7, None), ("c", 0, 4, None)]
    assert rows(streams.live_feed(df), "path", "what")[0] == ("p\\a", "changed")


def test_windows(spark, rows):
    e = spark.createDataFrame([(1, "x", T0), (1, "x", T0 + dt.timedelta(minutes=10)), (1, "y", T0 + dt.timedelta(hours=2))], "user_id bigint, event_type string, ts timestamp")
    assert rows(streams.windowed_counts(e), "event_type", "n") == [("x", 2), ("y", 1)]
    assert rows(streams.sessions(e), "user_id", "n") == [(1, 1), (1, 2)]
    assert e.where(F.col("user_id") == 2).count() == 0


def test_late_batches_change_nothing_newer(spark, tmp_path, rows):
    folder = str(tmp_path / "log")
    for part in ([change("p", "a", 0, 9, 5), change("p", "b", 1, 8)], [change("p", "a", 0, 1, 1), change("p", "b", 0, 2, 1), change("p", "c", 0, 3, 3)]):
        spark.createDataFrame(part, CHANGE).coalesce(1).write.mode("append").parquet(folder)
    streams.apply_stream(streams.read_changes(spark, folder, files_per_trigger=1), f"file://{tmp_path}/s", f"{tmp_path}/cp").awaitTermination()
    assert rows(RecordStore(spark, f"file://{tmp_path}/s").read(), "name", "size") == [("a", 5), ("c", 3)]


def test_pause_and_follow(spark, tmp_path):
    import threading

    folder = str(tmp_path / "log")
    spark.createDataFrame([change("p", "a", 0, 1, 1)], CHANGE).coalesce(1).write.parquet(folder)
    pause = control.Pause(spark, f"file://{tmp_path}/flags")
    pause.hold(), pause.hold()
    query = streams.apply_stream(streams.read_changes(spark, folder), f"file://{tmp_path}/s", f"{tmp_path}/cp", pause=pause)
    assert not query.awaitTermination(3) and RecordStore(spark, f"file://{tmp_path}/s").read() is None
    threading.Timer(0.5, pause.resume).start()
    assert query.awaitTermination(60) and RecordStore(spark, f"file://{tmp_path}/s").read().count() == 1
    pause.resume()
    assert not pause.held
    seen = []
    done = control.follow(streams.read_changes(spark, folder), lambda df, n: seen.append(df.count()), f"{tmp_path}/cp2", 8)
    assert seen[:1] == [1] and not done.isActive


def test_cancelled_work_stops(spark):
    import threading
    import time

    token = control.Cancel(spark)
    slow = spark.range(4).repartition(4).mapInPandas(lambda it: ((time.sleep(60), b)[1] for b in it), "id bigint")
    threading.Timer(3, token.cancel).start()
    began = time.time()
    with pytest.raises(Exception), token():
        slow.count()
    assert time.time() - began < 40
    with pytest.raises(InterruptedError), token():
        pass
    assert spark.range(3).count() == 3
