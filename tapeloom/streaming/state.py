"""Keyed streams applied in event-time order, whatever the order of arrival: buffers, liveness, joins of two streams.

Rows are packed before they move, many of a key to one value, and wait so in list state until the watermark has passed them; an
event-time timer then hands them over in order, so the result is that of a batch over the same rows. Rows that come after the
watermark has passed them are dropped, but an idle key that was cleared forgets how far it was. What a key remembers beyond its waiting rows is stated by each processor,
and a timer clears a key that has been idle.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeloom.functions.prob import choose_side

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MESSAGE_CONF = "spark.sql.execution.arrow.transformWithStateInPySpark.maxStateRecordsPerBatch"
#: Counting rows reads a list anew for each value that is appended to it: work that grows with the square of the rows that wait.
COUNT_CONF = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
MICRO = 1_000_000
#: Rows that are Python objects at one time; more are held as columns only.
SLICE = 16384
#: Waiting rows are columns in one value of at most SLICE rows, so many of which are read in one message.
PACKED = T.StructType([T.StructField("rows", T.BinaryType())])
MESSAGE = 64


def as_rows(pdf: pd.DataFrame, schema: T.StructType) -> list[tuple]:
    """Rows for a state variable: missing as None, and whole numbers whole where missing ones made pandas use floats."""
    columns = []
    for f in schema.fields:
        whole = isinstance(f.dataType, T.IntegralType)
        columns.append([None if x is None or x != x else int(x) if whole else x for x in pdf[f.name].tolist()])
    return list(zip(*columns))


def as_frame(rows: Iterator[tuple], schema: T.StructType) -> pd.DataFrame:
    """Rows of a state variable as columns, made slice by slice."""
    rows, parts = iter(rows), []
    while part := list(islice(rows, SLICE)):
        made = pd.DataFrame(part, columns=schema.names)
        for f in schema.fields:
            if isinstance(f.dataType, T.IntegralType) and not made[f.name].isna().any():
                made[f.name] = made[f.name].astype(np.int64)
            elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
                made[f.name] = made[f.name].astype(float)
        parts.append(made)
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=schema.names)


def packed(rows: pd.DataFrame, schema: T.StructType) -> Iterator[tuple[bytes]]:
    """The columns of up to ``SLICE`` rows each as one value."""
    columns = [rows[name].to_numpy() for name in schema.names]
    for at in range(0, len(rows), SLICE):
        yield (pickle.dumps([c[at : at + SLICE] for c in columns], protocol=5),)


def pack(rows: DataFrame, keys: Sequence[str], schema: T.StructType) -> DataFrame:
    """keys, us (the last one), rows: the rows of each key in a stretch of the input as packed values.  Rows without a time stay out."""
    def grouped(frame: pd.DataFrame) -> pd.DataFrame:
        out = [(*key, int(own["us"].max()), int(own["us"].min()), value)
               for key, part in frame.groupby(list(keys), dropna=False, sort=False)
               for at in range(0, len(part), SLICE) for own in (part.iloc[at : at + SLICE],) for (value,) in packed(own, schema)]
        return pd.DataFrame(out, columns=[*keys, "us", "first_us", "rows"])

    def stretches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in frames:
            held.append(frame)
            n += len(frame)
            if n >= 4 * SLICE:
                yield grouped(pd.concat(held, ignore_index=True))
                held, n = [], 0
        if n:
            yield grouped(pd.concat(held, ignore_index=True))

    out = T.StructType([*(rows.schema[k] for k in keys), T.StructField("us", T.LongType()), T.StructField("first_us", T.LongType()), *PACKED.fields])
    return rows.select(*keys, *schema.names).where("us IS NOT NULL").mapInPandas(stretches, out)


def unpacked(values: Iterator[tuple], schema: T.StructType) -> pd.DataFrame:
    """The rows of packed values: whole numbers whole where none is missing, other numbers floats."""
    parts = [pickle.loads(bytes(v[0])) for v in values]
    columns = {}
    for k, f in enumerate(schema.fields):
        column = np.concatenate([part[k] for part in parts]) if parts else np.zeros(0, object)
        for part in parts:
            part[k] = None
        if isinstance(f.dataType, T.IntegralType) and not pd.isna(column).any():
            column = column.astype(np.int64)
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            column = column.astype(float)
        columns[f.name] = column
    return pd.DataFrame(columns)


def in_sequence(rows: pd.DataFrame, order: Sequence[str]) -> pd.DataFrame:
    """Rows sorted by ``order``; missing last."""
    if any(rows[c].dtype == object for c in order):
        return rows.sort_values(list(order), ignore_index=True)
    return rows.iloc[np.lexsort([rows[c].to_numpy() for c in reversed(order)])].reset_index(drop=True)


def whole_times(rows: pd.DataFrame, size: int) -> Iterator[pd.DataFrame]:
    """Sorted rows in parts of ``size`` or a little more: rows of one time stay together."""
    us, at = rows["us"].to_numpy(np.int64), 0
    while at < len(us):
        end = int(np.searchsorted(us, us[min(at + size, len(us)) - 1], side="right"))
        yield rows.iloc[at:end].reset_index(drop=True)
        at = end


class InOrder(StatefulProcessor):
    """Base: ``columns`` of rows wait until the watermark passes their ``us`` (microseconds), then go to ``apply``.

    ``apply`` gets the key and rows sorted by us and ``order``, and returns output rows without the key. ``idle`` says when a
    key without further rows is done with (microseconds, or None), and ``expire`` clears it; ``forgets``: nothing of it stays.
    """

    forgets = False

    def __init__(self, keys: Sequence[str], waiting: T.StructType, order: Sequence[str], output: Sequence[str]) -> None:
        self.keys, self.waiting_schema, self.order, self.output = list(keys), waiting, ["us", *order], list(output)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", PACKED)
        self.passed = handle.getListState("passed", T.StructType([T.StructField("us", T.LongType())]))
        self.open(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for came in rows:
            if "rows" in came:
                self._append((value,) for value in came["rows"])
            else:
                self._store(came)
            began = int(came["first_us" if "rows" in came else "us"].min())
            first = began if first is None else min(began, first)
        # the first of the new rows: an earlier timer of this key stands already
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = unpacked(self.waiting.get() if self.waiting.exists() else (), self.waiting_schema)
        if self.passed.exists():
            late = held["us"] <= next(iter(self.passed.get()))[0]
            held = held[~late] if late.any() else held
        due = held["us"] <= passed if len(held) else np.zeros(0, bool)
        rest = held[~due] if len(held) else held
        named = lambda made: made.assign(**dict(zip(self.keys, key)))[[*self.keys, *self.output]]
        if len(held) and due.any():
            ready = in_sequence(held[due], self.order)
            del held
            for made in self.apply_parts(key, whole_times(ready, 4 * SLICE)):
                if made is not None and len(made):
                    yield named(made)
            self.waiting.clear()
            self.passed.put([(passed,)])
            if len(rest):
                self._store(rest)
        done = self.idle()
        # rows that still wait are later than the watermark: they cannot undo what it has passed
        if done is not None and done <= passed:
            made = self.expire(key, done)
            if self.forgets and not len(rest):
                self.passed.clear()
            if made is not None and len(made):
                yield named(made)
        elif done is not None:
            self._wake(done)
        if len(rest):
            self._wake(int(rest["us"].min()))

    def _store(self, rows: pd.DataFrame) -> None:
        self._append(packed(rows, self.waiting_schema))

    def _append(self, values: Iterator[tuple[bytes]]) -> None:
        for value in values:
            self.waiting.appendList([value])

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def close(self) -> None:
        pass

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def apply(self, key, rows: pd.DataFrame) -> pd.DataFrame | None:
        raise NotImplementedError

    def apply_parts(self, key, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
        """``apply`` to the parts of one timer, one after the other."""
        for part in parts:
            yield self.apply(key, part)

    def idle(self) -> int | None:
        return None

    def expire(self, key, us: int) -> pd.DataFrame | None:
        return None


class PriceBuffer(InOrder):
    """The prices of the last ``keep`` seconds; an idle key's buffer is emptied when the watermark has passed it all."""

    forgets = True

    def __init__(self, keys: Sequence[str], keep_s: float) -> None:
        row = T.StructType([T.StructField("us", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("price", T.DoubleType())])
        super().__init__(keys, row, ["seq"], ["seq", "us", "held", "oldest", "mean"])
        self.keep = int(keep_s * MICRO)

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getListState("buffer", self.waiting_schema)

    def apply(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        return list(self.apply_parts(key, iter([rows])))[0]

    def apply_parts(self, key, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the state is read before the first part and written after the last
        window = as_frame(self.buffer.get(), self.waiting_schema) if self.buffer.exists() else None
        for rows in parts:
            every = pd.concat([window, rows], ignore_index=True) if window is not None and len(window) else rows
            us, price = every["us"].to_numpy(np.int64), every["price"].to_numpy(float)
            at = np.arange(len(every) - len(rows), len(every))
            first = np.searchsorted(us, us[at] - self.keep, side="right")
            upto = np.searchsorted(us, us[at], side="right")  # rows of one time see each other
            total = np.concatenate([[0.0], np.cumsum(price, dtype=np.longdouble)])
            window = every[us > us[-1] - self.keep]
            held = upto - first
            yield pd.DataFrame({"seq": rows["seq"], "us": rows["us"], "held": held, "oldest": price[first], "mean": ((total[upto] - total[first]) / held).astype(float)})
        self.buffer.put(as_rows(window, self.waiting_schema))

    def idle(self) -> int | None:
        last = None
        if self.buffer.exists():
            for last in self.buffer.get():
                pass
        return None if last is None else last[0] + self.keep

    def expire(self, key, us: int) -> None:
        self.buffer.clear()


class Liveness(InOrder):
    """Silences of more than ``gap`` seconds: since (the last row), silent_at, and back_at once a row comes again.

    A silence is told when it begins (back_at NULL) and again when it ends; the state is the last time and whether it was told.
    """

    def __init__(self, keys: Sequence[str], gap_s: float) -> None:
        super().__init__(keys, T.StructType([T.StructField("us", T.LongType())]), [], ["since", "silent_at", "back_at"])
        self.gap = int(gap_s * MICRO)

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("us", T.LongType()), T.StructField("told", T.BooleanType())]))

    def apply(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        before = self.last.get() if self.last.exists() else None
        us = rows["us"].to_numpy(np.int64)
        since = np.concatenate([[before[0]] if before else [us[0]], us[:-1]])
        long = us - since > self.gap
        out = [(int(a), int(a) + self.gap, back) for a, b in zip(since[long], us[long]) for back in (None, int(b))]
        if before and before[1] and long[0]:
            out = out[1:]  # its begin was told by the timer
        self.last.update((int(us[-1]), False))
        return pd.DataFrame(out, columns=self.output).astype("Int64")

    def idle(self) -> int | None:
        last = self.last.get() if self.last.exists() else None
        return None if last is None or last[1] else last[0] + self.gap + 1

    def expire(self, key, us: int) -> pd.DataFrame:
        last = self.last.get()
        self.last.update((last[0], True))
        return pd.DataFrame([(last[0], last[0] + self.gap, None)], columns=self.output).astype("Int64")


class StreamAsof(InOrder):
    """Left rows with the last right row at or before them; the state is one right row."""

    def __init__(self, keys: Sequence[str], left: Sequence[T.StructField], right: Sequence[T.StructField], tolerance_s: float | None) -> None:
        nullable = lambda fields: [T.StructField(f.name, f.dataType) for f in fields]
        row = T.StructType([T.StructField("us", T.LongType()), T.StructField("from_left", T.BooleanType()), T.StructField("tie_order", T.LongType()), *nullable(left), *nullable(right)])
        self.left, self.right = [f.name for f in left], [f.name for f in right]
        super().__init__(keys, row, ["from_left", "tie_order"], ["us", *self.left, *self.right, "age_s"])
        self.known = T.StructType([T.StructField("us", T.LongType()), *nullable(right)])
        self.tolerance = None if tolerance_s is None else int(tolerance_s * MICRO)

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("right", self.known)

    def apply(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        held = self.state.get() if self.state.exists() else None
        is_left = rows["from_left"].to_numpy(bool)
        rights = rows.loc[~is_left, self.known.names]
        before = as_frame(iter([held] if held is not None else []), self.known)
        table = {c: np.concatenate([before[c].to_numpy(), rights[c].to_numpy()]) if len(before) else rights[c].to_numpy() for c in self.known.names}
        place = np.cumsum(~is_left)[is_left] - (0 if len(before) else 1)  # -1: no right row yet
        lefts = rows.loc[is_left, ["us", *self.left]].reset_index(drop=True)
        out = lefts.assign(**{c: lefts[c].convert_dtypes() for c in self.left if lefts[c].dtype != float})
        fresh = place >= 0
        age = np.full(len(out), np.nan)
        age[fresh] = out["us"].to_numpy(np.int64)[fresh] - table["us"][place[fresh]].astype(np.int64)
        if self.tolerance is not None:
            fresh &= age <= self.tolerance
        for name in self.right:
            numbers = table[name].dtype == float
            found = np.full(len(out), np.nan if numbers else None, dtype=float if numbers else object)
            found[fresh] = table[name][place[fresh]]
            out[name] = found
        out["age_s"] = np.where(fresh, age / MICRO, np.nan)
        if len(rights):
            self.state.update(as_rows(rights.tail(1), self.known)[0])
        return out


def in_order(stream: DataFrame, keys: Sequence[str], processor: InOrder, output: T.StructType, late: str) -> DataFrame:
    """The processor over a stream with the columns that wait, ``us`` among them; ``late``: the delay of the watermark."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    stream.sparkSession.conf.set(MESSAGE_CONF, str(MESSAGE))
    stream.sparkSession.conf.set(COUNT_CONF, "false")
    # Spark's worker takes stateful input row by row: a packed value is one row
    moved = pack(stream, keys, processor.waiting_schema).withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", late)
    return moved.groupBy(*keys).transformWithStateInPandas(processor, output, "Append", "EventTime")


def _keyed(stream: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [f for f in stream.schema.fields if f.name in keys]


def price_buffer(ticks: DataFrame, keys: Sequence[str], keep_s: float, late: str) -> DataFrame:
    """keys, seq, us, held, oldest, mean of the prices in (time - keep, time] at every row.  Needs ts, seq, price."""
    rows = ticks.select(*keys, F.unix_micros("ts").alias("us"), "seq", F.col("price").cast("double").alias("price"))
    out = T.StructType([*_keyed(ticks, keys), T.StructField("seq", T.LongType()), T.StructField("us", T.LongType()), T.StructField("held", T.LongType()), T.StructField("oldest", T.DoubleType()), T.StructField("mean", T.DoubleType())])
    return in_order(rows, keys, PriceBuffer(keys, keep_s), out, late)


def liveness(ticks: DataFrame, keys: Sequence[str], gap_s: float, late: str) -> DataFrame:
    """keys, since, silent_at, back_at (microseconds) of every silence longer than ``gap_s``.  Needs ts."""
    rows = ticks.select(*keys, F.unix_micros("ts").alias("us"))
    out = T.StructType([*_keyed(ticks, keys), *[T.StructField(c, T.LongType()) for c in ("since", "silent_at", "back_at")]])
    return in_order(rows, keys, Liveness(keys, gap_s), out, late)


def stream_asof(left: DataFrame, right: DataFrame, keys: Sequence[str], late: str, *, tie: str = "seq", tolerance_s: float | None = None) -> DataFrame:
    """Rows of ``left`` (keys, ts and other columns) with the other columns of the last ``right`` row of the key, and its age.

    Of right rows of one time the one with the largest ``tie`` counts.
    """
    own = lambda df: [f for f in df.schema.fields if f.name not in (*keys, "ts", tie)]
    lf, rf = own(left), own(right)
    l = left.select(*keys, "ts", F.lit(True).alias("from_left"), F.col(tie).cast("long").alias("tie_order"), *[f.name for f in lf])
    r = right.select(*keys, "ts", F.lit(False).alias("from_left"), F.col(tie).cast("long").alias("tie_order"), *[f.name for f in rf])
    both = l.unionByName(r, allowMissingColumns=True).withColumn("us", F.unix_micros("ts"))
    nullable = [T.StructField(f.name, f.dataType) for f in (*lf, *rf)]
    out = T.StructType([*_keyed(left, keys), T.StructField("us", T.LongType()), *nullable, T.StructField("age_s", T.DoubleType())])
    return in_order(both, keys, StreamAsof(keys, lf, rf, tolerance_s), out, late)


def live_signal(prices: DataFrame, books: DataFrame, keys: Sequence[str], late: str, *, margin: float = 0.0, stale_s: float = 10.0) -> DataFrame:
    """Each fair probability against the book of its moment: keys, us, p, bid, ask, age_s, ev_up, ev_down, decision.

    ``prices`` has keys, ts, seq, p; ``books`` keys, ts, seq, bid, ask of the first outcome, whose bid is the ask of the
    second. A book older than ``stale_s`` decides nothing.
    """
    seen = stream_asof(prices.select(*keys, "ts", "seq", "p"), books.select(*keys, "ts", "seq", "bid", "ask"), keys, late)
    chosen = choose_side(F.col("p"), F.col("ask"), F.round(1 - F.col("bid"), 3), margin)
    side = F.when(F.col("age_s") <= stale_s, chosen["side"])
    return seen.select(*keys, "us", "p", "bid", "ask", "age_s", chosen["ev_up"].alias("ev_up"), chosen["ev_down"].alias("ev_down"), F.coalesce(side, F.lit("none")).alias("decision"))
