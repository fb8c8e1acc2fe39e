"""Ordered streams: rows that arrive late or shuffled, idle keys, bounded state."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.streaming import state, streams

BASE = pd.Timestamp("2024-01-01")


def arrivals(spark, folder, rows, disorder_s, parts=5, seed=0):
    """A stream of ``rows`` in ``parts`` files: each row moves by up to ``disorder_s`` before the cut into files."""
    rng = np.random.default_rng(seed)
    moved = rows.assign(at=rows.t + rng.uniform(0, disorder_s, len(rows))).sort_values("at", ignore_index=True)
    moved = moved.assign(ts=BASE + pd.to_timedelta((moved.t * 1e6).round().astype("int64"), unit="us")).drop(columns="at")
    for k, cut in enumerate(np.array_split(np.arange(len(moved)), parts)):
        moved.iloc[cut].sample(frac=1, random_state=k).to_parquet(folder / f"part-{k}.parquet", coerce_timestamps="us")
    schema = spark.createDataFrame(moved.head(1)).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def ticks(n=300, keys=3, seed=1):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, 3000, n)).round(6)
    t[rng.random(n) < 0.1] += 400  # silences
    return pd.DataFrame({"key": rng.choice([f"k{j}" for j in range(keys)], n), "t": t, "seq": np.arange(n), "price": rng.uniform(1, 9, n)})


def end_of(rows):
    """Whatever the watermark has passed at the end: everything but the last minutes."""
    return np.floor(rows.t.max() * 1000) / 1000 - 600


@pytest.mark.parametrize("disorder", [0.0, 300.0])
def test_buffers_do_not_depend_on_arrival(spark, tmp_path, disorder):
    rows = ticks()
    out = streams.run_available(state.price_buffer(arrivals(spark, tmp_path, rows, disorder), ["key"], 120.0, "10 minutes")).toPandas()
    passed = rows[rows.t <= end_of(rows)]
    assert sorted(out.seq) == sorted(passed.seq)
    for r in out.itertuples():
        now = rows.t[rows.seq == r.seq].iloc[0]
        own = rows[(rows.key == r.key) & (rows.t > now - 120 + 1e-9) & (rows.t <= now)].sort_values("t")
        assert r.held == len(own) and r.oldest == own.price.iloc[0] and r.mean == pytest.approx(own.price.mean())


@pytest.mark.parametrize("disorder", [0.0, 300.0])
def test_silences(spark, tmp_path, disorder):
    rows = ticks(120)
    idle = pd.DataFrame({"key": ["gone"], "t": [5.0], "seq": [999], "price": [1.0]})
    rows = pd.concat([idle, rows], ignore_index=True)
    out = streams.run_available(state.liveness(arrivals(spark, tmp_path, rows, disorder), ["key"], 60.0, "10 minutes")).toPandas()
    origin = int(BASE.value // 1000)
    got = {(r.key, round((r.since - origin) / 1e6, 6), None if pd.isna(r.back_at) else round((r.back_at - origin) / 1e6, 6)) for r in out.itertuples()}
    assert len(got) == len(out) and ((out.silent_at - out.since) == 60_000_000).all()
    end, want = end_of(rows), set()
    for key, own in rows[rows.t <= end].groupby("key"):
        t = np.sort(own.t.to_numpy()).round(6)
        for a, b in zip(t, t[1:]):
            if b - a > 60:
                want |= {(key, a, None), (key, a, b)}
        if t[-1] + 60 < end - 0.002:
            want.add((key, t[-1], None))
    assert ("gone", 5.0, None) in got
    assert {x for x in got ^ want if x[1] + 60 < end - 0.002} == set()


@pytest.mark.parametrize("tolerance", [None, 30.0])
def test_two_streams_join_like_tables(spark, tmp_path, tolerance):
    left, right = ticks(200, seed=3), ticks(200, seed=4)
    right["t"] = np.where(np.arange(200) % 5 == 0, left.t, right.t)  # equal times
    right["note"] = np.where(np.arange(200) % 7 == 0, None, [f"n{k}" for k in range(200)])
    for name in ("l", "r"):
        (tmp_path / name).mkdir()
    lt = arrivals(spark, tmp_path / "l", left, 200.0).select("key", "ts", "seq", F.col("seq").alias("id"))
    rt = arrivals(spark, tmp_path / "r", right, 200.0, seed=5).select("key", "ts", "seq", "price", "note")
    out = streams.run_available(state.stream_asof(lt, rt, ["key"], "10 minutes", tolerance_s=tolerance)).toPandas()
    end = np.floor(max(left.t.max(), right.t.max()) * 1000) / 1000 - 600
    passed = left[left.t <= end]
    assert sorted(out.id) == sorted(passed.seq)
    for r in out.itertuples():
        now = left.t[left.seq == r.id].iloc[0]
        own = right[(right.key == r.key) & (right.t <= now)].sort_values(["t", "seq"])
        hit = own.iloc[-1] if len(own) and (tolerance is None or now - own.t.iloc[-1] <= tolerance) else None
        if hit is None:
            assert pd.isna(r.price) and pd.isna(r.age_s)
        else:
            assert r.price == hit.price and (r.note == hit.note or (r.note is None and hit.note is None)) and r.age_s == pytest.approx(now - hit.t, abs=1e-6)


def test_state_holds_one_window(spark):
    """After its rows have been applied a buffer keeps the rows of one window only, and a timer empties it."""
    class Store(list):
        def exists(self):
            return len(self) > 0

        def get(self):
            return iter(self)

        def put(self, rows):
            self[:] = rows

        appendList, clear = list.extend, list.clear

    class Handle:
        timers = []

        def getListState(self, name, schema):
            return Store()

        def registerTimer(self, ms):
            self.timers.append(ms)

    class Times:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    p = state.PriceBuffer(["key"], 10.0)
    p.init(Handle())
    for start in range(0, 5000, 50):
        rows = pd.DataFrame({"us": (np.arange(start, start + 50) * 1_000_000), "seq": np.arange(50), "price": 1.0})
        assert list(p.handleInputRows(("k",), iter([rows]), Times(0))) == []
        out = list(p.handleExpiredTimer(("k",), Times((start + 49) * 1000), None))
        assert len(out[0]) == 50 and len(p.buffer) == 10 and len(p.waiting) == 0
    assert list(p.handleExpiredTimer(("k",), Times(10**9), None)) == [] and len(p.buffer) == 0


class Values(list):
    """A list state without Spark."""

    def exists(self):
        return len(self) > 0

    def get(self):
        return iter(self)

    def put(self, rows):
        self[:] = rows

    appendList, clear = list.extend, list.clear


class Plain:
    """A handle without Spark, and a watermark."""

    def __init__(self):
        self.ms = 0

    def getListState(self, name, schema):
        return Values()

    def registerTimer(self, ms):
        pass

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_waiting_rows_share_entries_and_late_ones_are_dropped(spark):
    p, handle = state.PriceBuffer(["key"], 1000.0), Plain()
    p.init(handle)
    rows = pd.DataFrame({"us": np.arange(1000) * 1_000_000, "seq": np.arange(1000), "price": 1.0})
    assert list(p.handleInputRows(("k",), iter([rows.sample(frac=1, random_state=1)]), handle)) == [] and len(p.waiting) == 1
    handle.ms = 499_000
    out = pd.concat(p.handleExpiredTimer(("k",), handle, None))
    assert out.seq.tolist() == list(range(500)) and out.held.tolist() == list(range(1, 501)) and len(p.waiting) == 1
    # packed rows, one of them after the watermark has passed it
    more = pd.DataFrame({"us": [100_500_000, 700_500_000], "seq": [2000, 2001], "price": 1.0})
    value = next(state.packed(more, p.waiting_schema))[0]
    came = pd.DataFrame({"us": [700_500_000], "first_us": [100_500_000], "rows": [value]})
    assert list(p.handleInputRows(("k",), iter([came]), handle)) == [] and len(p.waiting) == 2
    handle.ms = 2_000_000
    out = pd.concat(p.handleExpiredTimer(("k",), handle, None))
    assert sorted(out.seq) == [*range(500, 1000), 2001] and out.held.iloc[-1] == 1001 and len(p.waiting) == len(p.buffer) == len(p.passed) == 0


def test_rows_move_packed_and_appends_do_not_read(spark):
    rows = spark.createDataFrame([("a", None if k == 3 else k, k, 0.5 * k) for k in range(50)] + [(None, 7, 9, 1.0)], "key string, us long, seq long, price double").coalesce(1)
    schema = state.PriceBuffer(["key"], 1.0).waiting_schema
    got = {r.key: r for r in state.pack(rows, ["key"], schema).collect()}
    assert len(got) == 2 and (got["a"].us, got["a"].first_us) == (49, 0)
    back = state.unpacked(iter([(got["a"].rows,)]), schema)
    assert back.seq.tolist() == [k for k in range(50) if k != 3] and back.price.tolist() == [0.5 * k for k in range(50) if k != 3]
    ticks = spark.readStream.format("rate").load().selectExpr("'a' AS key", "timestamp AS ts", "value AS seq", "1.0D AS price")
    plan = state.price_buffer(ticks, ["key"], 1.0, "1 minute")._jdf.queryExecution().analyzed().toString()
    assert "MapInPandas" in plan and spark.conf.get(state.COUNT_CONF) == "false"
