"""The streams themselves, driven by files."""

import pytest
from pyspark.sql import functions as F

from keelson.streaming import blocking, oplog, pubsub


def test_tail_and_snapshots(spark, tmp_path):
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    schema = "seq long, key string, cmd string, value string"
    for rows in ([(1, "a", "set", "1"), (2, "b", "set", "2")], [(3, "a", "set", "3"), (4, "b", "del", None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(log)
    q = oplog.snapshots(oplog.tail(spark, log, schema, 1), state, str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["key"]: r["value"] for r in oplog.restored(spark, state, schema).collect()} == {"a": "3"}
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["batch=0", "batch=1"]


def test_windows_with_late_rows(spark, tmp_path):
    schema = "channel string, ts timestamp, value double"
    rows = [("c", "2024-01-01 00:00:01", 1.0), ("c", "2024-01-01 00:00:59", 2.0), ("c", "2024-01-01 00:05:00", 4.0)]
    df = spark.createDataFrame(rows, "channel string, t string, value double").select("channel", F.col("t").cast("timestamp").alias("ts"), "value")
    df.write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "m"))
    q = pubsub.windowed(stream, "1 minute", late="1 minute").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["n"], r["total"]) for r in spark.sql("SELECT * FROM windows").collect()) == [(1, 4.0), (2, 3.0)]


REQUESTS = "key string, at long, kind string, client string, value string, score double, timeout_ms long"


@pytest.mark.parametrize(("largest", "second"), [(None, "a"), (False, "a"), (True, "c")])
def test_blocking_pops_as_a_stream(spark, tmp_path, largest, second):
    """Clients that come first wait over a restart; later ones find what is there; keys don't mix; one's time runs out."""
    where, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    rounds = [
        [("k", 1, "pop", "one", None, None, 0), ("late", 1, "pop", "gone", None, None, 1)],
        [("k", 2, "push", None, "b", 2.0, 0), ("k", 3, "push", None, "a", 1.0, 0), ("k", 4, "push", None, "c", 3.0, 0), ("other", 5, "push", None, "x", 1.0, 0)],
        [("k", 6, "pop", "two", None, None, 0), ("late", 7, "push", None, "y", 1.0, 0)],
    ]
    got = []
    for rows in rounds:
        spark.createDataFrame(rows, REQUESTS).coalesce(1).write.mode("append").parquet(where)
        stream = blocking.blocking_pops(spark.readStream.schema(REQUESTS).parquet(where), largest)
        q = stream.writeStream.foreachBatch(lambda batch, _: got.extend(tuple(r) for r in batch.collect())).option("checkpointLocation", cp).trigger(once=True).start()
        q.awaitTermination(120)
        assert not q.isActive
    assert got == [("k", "one", "b"), ("k", "two", second)]  # the first push of all goes to the client that waits


class State:
    """A group's state, as the stateful operator sees it."""

    def __init__(self):
        self.get, self.exists, self.hasTimedOut, self.timeout = None, False, False, None

    def getCurrentProcessingTimeMs(self):
        return 1000

    def update(self, new):
        self.get, self.exists = new, True

    def remove(self):
        self.get, self.exists = None, False

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_blocking_pops_serve_in_turn():
    """The operator's function alone: of two clients one is served, the other keeps its time."""
    import pandas as pd

    columns, state = ["key", "at", "kind", "client", "value", "score", "timeout_ms"], State()
    first = pd.DataFrame([("k", 1, "pop", "one", None, None, 0), ("k", 2, "pop", "two", None, None, 500), ("k", 3, "push", None, "x", None, 0)], columns=columns)
    (out,) = blocking.serve(None, ("k",), iter([first]), state)
    assert out.values.tolist() == [["k", "one", "x"]] and state.exists and state.timeout == 500
    (out,) = blocking.serve(None, ("k",), iter([pd.DataFrame([("k", 4, "push", None, "y", None, 0)], columns=columns)]), state)
    assert out.values.tolist() == [["k", "two", "y"]] and not state.exists
