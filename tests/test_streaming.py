import pandas as pd
import pytest
from pyspark.sql import functions as F

from rippleframe.operators import scans
from rippleframe.operators import sequence as S
from rippleframe.streaming import steps
from rippleframe.streaming.processors import apply_update, read_stream, run_available


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The event table as a folder of three files, so that state crosses micro-batches."""
    base = tmp_path_factory.mktemp("stream")
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_id", "value").coalesce(1)
    for i in range(3):
        ev.filter((F.col("event_id") >= 334 * i) & (F.col("event_id") < 334 * (i + 1))).write.mode("append").parquet(str(base / "events.parquet"))
    return str(base)


def test_stream_agrees_with_batch(spark, folder):
    stream = read_stream(spark, folder, "events", max_bytes=1).withColumn("hit", F.col("value") > 40)
    schema = "user_id long, event_id long, state boolean"
    out = run_available(apply_update(stream, ["user_id"], steps.debounce, steps.DEBOUNCE_STATE, ["event_id"], schema), "t")
    got = {r.event_id: r.state for r in out.collect()}
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_id", (F.col("value") > 40).alias("hit"))
    want = {r.event_id: r.state for r in scans.debounce(S.sequence(ev, ["user_id"], ["event_id"]), ["user_id"], "hit", size=9).collect()}
    assert got == want and len(got) == 1000


def test_read_stream_is_one_table(spark):
    s = read_stream(spark, "/root/testdata/sf0.001", "events")
    assert s.isStreaming and "event_type" in s.columns


def test_rolling_baseline_step():
    state, first = steps.rolling_baseline(None, pd.DataFrame({"event_id": [0], "amp": [1.0]}), alpha=0.25, window=2)
    state, rest = steps.rolling_baseline(state, pd.DataFrame({"event_id": [1, 2], "amp": [2.0, 3.0]}), alpha=0.25, window=2)
    assert first["mean"].tolist() == [1.0] and rest["mean"].tolist() == pytest.approx([1.25, 1.6875])
    assert state == (pytest.approx(1.6875), [3.0])


def test_a_batch_behind_an_earlier_one_is_refused(spark, folder, tmp_path):
    rows = spark.read.parquet(f"{folder}/events.parquet").where("user_id < 5")
    rows.where("event_id >= 500").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    rows.where("event_id < 500").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = read_stream(spark, str(tmp_path), "events", max_bytes=1).withColumn("hit", F.col("value") > 40)
    schema = "user_id long, event_id long, state boolean"
    with pytest.raises(Exception, match="feed files in event order"):
        run_available(apply_update(stream, ["user_id"], steps.debounce, steps.DEBOUNCE_STATE, ["event_id"], schema), "t")


def test_an_update_sees_slices_of_a_key_in_event_order(monkeypatch):
    import numpy as np
    import pandas as pd

    from rippleframe.streaming import processors

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Handle:
        def getValueState(self, name, schema):
            return Value()

    def update(state, rows):
        assert len(rows) <= 4 and all(v[0] == at for v, at in zip(rows["v"], rows["at"]))
        n = state[0] if state else 0
        return (n + len(rows),), pd.DataFrame({"at": rows["at"], "n": n + 1 + np.arange(len(rows))})

    monkeypatch.setattr(processors, "SLICE_ROWS", 4)
    processor = processors.UpdateProcessor(update, "n bigint", ["at"], ["at", "n"], ["k"])
    processor.init(Handle())
    order = np.random.default_rng(1).permutation(11)
    parts = [pd.DataFrame({"at": order[a:b], "v": [np.array([float(x), 1.0]) for x in order[a:b]]}) for a, b in ((0, 5), (5, 11))]
    out = list(processor.handleInputRows((3,), iter(parts), None))
    assert len(out) == 3 and pd.concat(out)["at"].tolist() == list(range(11)) and pd.concat(out)["n"].tolist() == list(range(1, 12))
