"""Event logs in hour files: a Spark data source that opens only the hours a time filter needs, and the raw envelopes in them.

Files are named ``<source>_<YYYYMMDDHH>.jsonl.gz`` (UTC) and hold one ``{"rx": nanoseconds, "msg": ...}`` for each line. The
reader lists the folder once and makes one partition for each file whose hour meets the span asked for; rows are then
judged by their own time. The span is an option of the load and not a pushed filter: Spark keeps one reader for a loaded
table, so what one query pushes would hold for the next one on the same table. A file that a killed writer cut off
gives its whole lines.
"""

from __future__ import annotations

import calendar
import json
import re
import time
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = re.compile(r"^(?P<source>[a-z0-9]+)_(?P<hour>\d{10})\.jsonl\.gz$")
SCHEMA = "rx BIGINT, msg STRING, file STRING"
HOUR, NANO = 3600, 1_000_000_000
#: Lines of a batch, and compressed bytes read at once.
LINES, BYTES = 8192, 1 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def hour_of(name: str, source: str | None = None) -> int | None:
    """Seconds at which a file's hour begins; None for a file of another kind or source."""
    m = NAME.match(name)
    if m is None or source not in (None, m["source"]):
        return None
    return calendar.timegm(time.strptime(m["hour"], "%Y%m%d%H"))


def file_name(source: str, second: int) -> str:
    return f"{source}_{time.strftime('%Y%m%d%H', time.gmtime(second))}.jsonl.gz"


@dataclass
class HourFile(InputPartition):
    path: str


def whole_lines(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The lines of gzip members laid end to end, up to where the data break off."""
    rest, member = b"", zlib.decompressobj(31)
    for data in chunks:
        while data:
            try:
                plain = member.decompress(data)
            except zlib.error:
                return
            *lines, rest = (rest + plain).split(b"\n")
            yield from lines
            data = member.unused_data
            if member.eof:
                member = zlib.decompressobj(31)


class HourLogReader(DataSourceReader):
    def __init__(self, path: str, source: str | None, low: int, high: int) -> None:
        self.path, self.source, self.low, self.high = path, source, low, high

    def partitions(self) -> Sequence[HourFile]:
        files, top = file_system(self.path)
        found = []
        for info in files.get_file_info(pafs.FileSelector(top)):
            begin = hour_of(info.base_name, self.source)
            if begin is not None and (begin + HOUR) * NANO > self.low and begin * NANO < self.high:
                found.append((begin, info.path))
        return [HourFile(path) for _, path in sorted(found)]

    def read(self, partition: HourFile) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is left
            return
        files, _ = file_system(self.path)
        rx, msg = [], []

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(rx, pa.int64()), pa.array(msg, pa.string()), pa.array([partition.path] * len(rx), pa.string())], names=["rx", "msg", "file"])

        with files.open_input_stream(partition.path, compression=None) as f:
            for line in whole_lines(iter(lambda: f.read(BYTES), b"")):
                try:
                    entry = json.loads(line)
                    at, said = int(entry["rx"]), entry["msg"]
                except (ValueError, KeyError, TypeError):
                    continue
                rx.append(at)
                msg.append(said if isinstance(said, str) else json.dumps(said))
                if len(rx) == LINES:
                    yield batch()
                    rx.clear()
                    msg.clear()
        if rx:
            yield batch()


class HourLog(DataSource):
    """Options: path, source (all sources if left out), low and high (nanoseconds; files of hours in between are opened)."""

    @classmethod
    def name(cls) -> str:
        return "hourlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HourLogReader:
        return HourLogReader(self.options["path"], self.options.get("source"), int(self.options.get("low", -(1 << 62))), int(self.options.get("high", 1 << 62)))


def hour_log(spark: SparkSession, path: str, source: str | None = None, *, start: int | None = None, end: int | None = None, slack_s: int = 0) -> DataFrame:
    """rx, msg, file of the lines with start <= rx < end (nanoseconds); only files that can hold such lines are opened.

    ``slack_s`` is how far a line may stand outside its file's hour.
    """
    spark.dataSource.register(HourLog)
    reader = spark.read.format("hourlog").option("path", path)
    for name, value in (("source", source), ("low", None if start is None else start - slack_s * NANO), ("high", None if end is None else end + slack_s * NANO)):
        reader = reader if value is None else reader.option(name, value)
    log = reader.load()
    log = log if start is None else log.where(F.col("rx") >= start)
    return log if end is None else log.where(F.col("rx") < end)


def write_hour_log(lines: DataFrame, path: str, source: str) -> DataFrame:
    """Write rows of ``rx`` and ``msg`` to hour files in order of rx; the manifest: file, lines.  One task holds one hour."""
    files, top = file_system(path)
    files.create_dir(top, recursive=True)

    def write(key, table):
        name = file_name(source, key[0].as_py() * HOUR)
        ordered = table.sort_by([("rx", "ascending"), ("msg", "ascending")])
        out, folder = file_system(path)
        # the file gets its name once it is whole: a repeated task replaces it
        with out.open_output_stream(f"{folder}/.{name}", compression="gzip") as f:
            for rx, msg in zip(ordered["rx"].to_pylist(), ordered["msg"].to_pylist()):
                f.write(json.dumps({"rx": rx, "msg": msg}).encode() + b"\n")
        out.move(f"{folder}/.{name}", f"{folder}/{name}")
        return pa.table({"file": [name], "lines": [len(table)]})

    hour = F.expr(f"rx div {HOUR * NANO}").alias("hour")
    return lines.select(hour, "rx", "msg").groupBy("hour").applyInArrow(write, "file STRING, lines BIGINT")


# Numbers may be written as strings, so all are read as strings.
_LEVELS = "ARRAY<STRUCT<price: STRING, size: STRING>>"
MESSAGE = ("STRUCT<event_type: STRING, asset_id: STRING, timestamp: STRING, price_changes: ARRAY<STRUCT<asset_id: STRING, price: STRING, size: STRING, side: STRING>>, "
           f"bids: {_LEVELS}, asks: {_LEVELS}, best_bid: STRING, best_ask: STRING, price: STRING, size: STRING, side: STRING, transaction_hash: STRING, new_tick_size: STRING, winning_outcome: STRING>")


def messages(log: DataFrame) -> DataFrame:
    """rx, place (in its line), ts (milliseconds) and m (one message): a line holds one message or a list of them."""
    listed = F.when(F.ltrim("msg").startswith("["), F.col("msg")).otherwise(F.concat(F.lit("["), "msg", F.lit("]")))
    rows = log.select("rx", F.posexplode(F.from_json(listed, f"ARRAY<{MESSAGE}>")).alias("place", "m")).where("m IS NOT NULL")
    return rows.withColumn("ts", number("m.timestamp", "BIGINT"))


def number(name: str, kind: str = "DOUBLE") -> Column:
    return F.expr(f"try_cast({name} AS {kind})")


def level_events(log: DataFrame, assets: DataFrame) -> DataFrame:
    """rx, seq, ts (milliseconds), asset, is_snapshot, side (B or S), price, size of all level changes and snapshots.

    ``assets`` names the tokens: asset_id and asset. Messages of other tokens drop out. The levels of a snapshot follow
    one another; only its first row is marked, and a snapshot without levels is one row of size 0.
    """
    m = messages(log)
    level = lambda side: lambda x: F.struct(F.lit(side).alias("side"), x["price"].alias("price"), x["size"].alias("size"))
    sides = F.concat(*[F.transform(F.coalesce(F.col(f"m.{c}"), F.array().cast(_LEVELS)), level(s)) for c, s in (("bids", "B"), ("asks", "S"))])
    nothing = F.array(F.struct(F.lit("B").alias("side"), F.lit("0").alias("price"), F.lit("0").alias("size")))
    books = m.where("m.event_type = 'book'").select("rx", "place", "ts", F.col("m.asset_id").alias("asset_id"), F.posexplode(F.when(F.size(sides) > 0, sides).otherwise(nothing)).alias("at", "l"))
    changes = m.where("m.event_type = 'price_change'").select("rx", "place", "ts", F.posexplode("m.price_changes").alias("at", "c"))
    rows = books.select("rx", "place", "at", "ts", "asset_id", (F.col("at") == 0).alias("is_snapshot"), F.col("l.side").alias("side"), number("l.price").alias("price"), number("l.size").alias("size")).unionByName(
        changes.select("rx", "place", "at", "ts", F.col("c.asset_id").alias("asset_id"), F.lit(False).alias("is_snapshot"), F.when(F.col("c.side").startswith("B"), "B").otherwise("S").alias("side"), number("c.price").alias("price"), number("c.size").alias("size")))
    return rows.join(assets, "asset_id").select("rx", (F.col("place").cast("long") * 100_000 + F.col("at")).alias("seq"), "ts", "asset", "is_snapshot", "side", "price", "size")


def other_events(log: DataFrame, assets: DataFrame) -> DataFrame:
    """rx, ts, kind (quote, trade, tick or resolved), asset and what each kind says: bid, ask, price, size, side, tx, winner."""
    kind: Column = F.create_map(*[F.lit(x) for pair in (("best_bid_ask", "quote"), ("last_trade_price", "trade"), ("tick_size_change", "tick"), ("market_resolved", "resolved")) for x in pair])
    m = messages(log).withColumn("kind", kind[F.col("m.event_type")]).where("kind IS NOT NULL").withColumn("asset_id", F.col("m.asset_id"))
    known = m.join(assets, "asset_id", "left").where("asset IS NOT NULL OR kind = 'resolved'")
    return known.select("rx", "ts", "kind", "asset", number("m.best_bid").alias("bid"), number("m.best_ask").alias("ask"), F.coalesce(number("m.price"), number("m.new_tick_size")).alias("price"),
                        number("m.size").alias("size"), F.col("m.side").alias("side"), F.col("m.transaction_hash").alias("tx"), F.col("m.winning_outcome").alias("winner"))
