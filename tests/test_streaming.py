import pytest
from pyspark.sql import functions as F
from rowlake.streaming import windows
from rowlake.streaming.state import JsonStore, Reliability, StreamState, VersionConflict

EVENTS = [(0, "a", 1.0), (999, "a", 2.0), (1000, "b", 3.0), (2500, "a", None), (9000, "b", 5.0)]


def events(spark):
    return spark.createDataFrame(EVENTS, "t long, g string, v double")


def brute(width, slide):
    out = {}
    for t, _, v in EVENTS:
        for s in range(t // slide * slide - 2 * width - slide, t + 1):
            if s % slide == 0 and s <= t < s + width and s in {t // slide * slide - j * slide for j in range(max(width // slide, 1) + 1)}:
                out.setdefault(s, []).append(v)
    return {s: (len(v), sum(x for x in v if x is not None)) for s, v in out.items()}


@pytest.mark.parametrize("width,slide", [(1000, 1000), (1000, 250), (1000, 3000), (1000, 700)])
def test_sliding(spark, width, slide):
    got = windows.stream_window(events(spark), "t", width, "v", window_type="sliding", slide_ms=slide).collect()
    assert {r.window_start_ms: (r["count"], r["sum"]) for r in got} == brute(width, slide)


def test_sessions_split_above_the_gap(spark):
    df = spark.createDataFrame([(0,), (100,), (201,), (301,)], "t long")
    got = sorted((r.window_start_ms, r.window_end_ms, r["count"]) for r in windows.stream_window(df, "t", 100, window_type="session", gap_ms=100).collect())
    assert got == [(0, 101, 2), (201, 302, 2)]


def test_late_rows(spark):
    on_time, late = windows.split_late(events(spark), "t", 10_000, 7_500)
    assert {r.t for r in late.collect()} | {r.t for r in on_time.collect()} == {e[0] for e in EVENTS} and all(10_000 - r.t > 7_500 for r in late.collect())
    text = spark.createDataFrame([("5",), ("2024-01-01 00:00:01",), ("",), ("x",)], "t string")
    assert [r[0] for r in text.select(windows.event_ms(text, "t")).collect()] == [5, 1704067201000, None, None]


def test_structured_stream(spark, tmp_path):
    src = f"{tmp_path}/in"
    events(spark).select(F.timestamp_millis("t").alias("at"), "g", "v").unionByName(spark.createDataFrame([(500_000, "z", 0.0)], "t long, g string, v double").select(F.timestamp_millis("t").alias("at"), "g", "v")).write.parquet(src)
    stream = spark.readStream.schema("at timestamp, g string, v double").parquet(src)
    windows.run_available(windows.windowed_stream(stream, "at", "1 second", "0 seconds", "v", ["g"]), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(r.window_start_ms, r.g): (r["count"], r["sum"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(0, "a"): (2, 3.0), (1000, "b"): (1, 3.0), (2000, "a"): (1, 0.0), (9000, "b"): (1, 5.0)}
    windows.transform_stream(stream, {"filters": [{"field": "v", "op": "gt", "value": 2}]}, f"{tmp_path}/t", f"{tmp_path}/cp2")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2


def test_state(tmp_path):
    s = StreamState(f"{tmp_path}/s", max_late_ms=10)
    assert s.save("k", {"a": 1}, now_ms=5)["version"] == 1 and s.save("k", {"a": 2}, expected_version=1)["version"] == 2
    with pytest.raises(VersionConflict):
        s.save("k", {}, expected_version=1)
    assert s.save("k", {}, event_ms=0, now_ms=100)["dropped_late"] and s.load("k")["state"] == {"a": 2} and s.list() == ["k"] and s.delete("k") and s.load("k") is None
    with pytest.raises(ValueError):
        JsonStore(f"{tmp_path}/s").put("../x", 1)
    r = Reliability(f"{tmp_path}/r")
    assert not r.record("q", "1")["duplicate"] and r.record("q", "1")["duplicate"] and r.record("q", "2", {"x": 1}, "boom")["failed"]
    assert r.stats("q") == {"seen": 2, "failed": 1, "repeats": 1, "checkpoint": 0, "consistent": True} and len(r.replay("q")) == 1 and r.flush("q") == 1


def test_two_writers(spark, tmp_path):
    """Of many writers who expect one version, one wins; records are taken once; on a local folder and on one of Spark's file systems."""
    from concurrent.futures import ThreadPoolExecutor

    for folder in (f"{tmp_path}/local", f"file://{tmp_path}/shared"):
        state = StreamState(folder)
        assert JsonStore(folder).files.folder.exists()
        state.save("k", {"n": 0})

        def write(i, state=state):
            try:
                return state.save("k", {"n": i}, expected_version=1)["state"]["n"]
            except VersionConflict:
                return None

        with ThreadPoolExecutor(8) as pool:
            won = [x for x in pool.map(write, range(16)) if x is not None]
        assert len(won) == 1 and state.load("k") == {**state.load("k"), "state": {"n": won[0]}, "version": 2}
        for i in range(5):
            state.save("k", {"n": i})
        assert state.load("k")["version"] == 7 and state.list() == ["k"] and state.delete("k") and state.load("k") is None and state.list() == []
        seen = Reliability(folder + "-r")
        with ThreadPoolExecutor(8) as pool:
            got = list(pool.map(lambda i: seen.record("s", f"m{i % 4}", i, "bad" if i % 4 == 1 else None), range(20)))
        assert sum(not x["duplicate"] for x in got) == 4 and seen.stats("s")["seen"] == 4 and seen.stats("s")["repeats"] == 16 and len(seen.replay("s")) == 1 and seen.flush("s") == 1


def test_delivery_table(spark, tmp_path):
    from rowlake.streaming.state import DeliveryTable

    t = DeliveryTable(spark, f"file://{tmp_path}/d", 4)
    ids = lambda a, b: spark.range(a, b).selectExpr("id", "id * 2 as v").union(spark.range(a, b).selectExpr("id", "id * 2 as v"))
    assert t.take(ids(0, 50), "id", "b1").count() == 50
    assert sorted(r.id for r in t.take(ids(40, 60), "id", "b2").collect()) == list(range(50, 60))
    assert t.take(ids(40, 60), "id", "b2").count() == 10  # repeated after a failure
    assert t.take(ids(0, 60), "id", "b3").count() == 0


def test_state_in_sparks_file_systems(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.rl.link./d", f"file://{tmp_path}")
    state = StreamState("viewfs://rl/d/state")
    assert type(state.store.files).__name__ == "_Shared"
    for i in range(4):
        assert state.save("k", {"n": i}, offset=i)["version"] == i + 1
    with pytest.raises(VersionConflict):
        state.save("k", {}, expected_version=1)
    assert state.load("k")["state"] == {"n": 3} and state.list() == ["k"] and not state.store.put_if("k", {}, 3) and state.delete("k") and state.load("k") is None
    seen = Reliability("viewfs://rl/d/r")
    assert not seen.record("s", "m", error="bad")["duplicate"] and seen.record("s", "m")["duplicate"] and seen.replay("s")[0]["error"] == "bad" and seen.stats("s")["seen"] == 1
