"""Hour files: only those a filter needs are opened; raw envelopes of both shapes; cut-off files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tapeloom.sources import hourlog

H, S = hourlog.HOUR, hourlog.NANO
START = 1_704_067_200  # 2024-01-01


def write(folder, name, entries, cut=0):
    data = b"".join(json.dumps(e).encode() + b"\n" for e in entries)
    packed = gzip.compress(data)
    (folder / name).write_bytes(packed[: len(packed) - cut] if cut else packed)


@pytest.fixture
def logs(tmp_path):
    for k in range(6):
        begin = START + k * H
        write(tmp_path, hourlog.file_name("book", begin), [{"rx": (begin + 60 * j) * S, "msg": json.dumps({"n": k * 100 + j})} for j in range(60)])
    write(tmp_path, hourlog.file_name("other", START), [{"rx": START * S, "msg": "{}"}])
    (tmp_path / "notes.txt").write_text("no log")
    return tmp_path


def test_only_needed_hours_are_opened(spark, logs):
    load = lambda **span: hourlog.hour_log(spark, str(logs), "book", **span)
    low, high = (START + 2 * H + 1800) * S, (START + 3 * H + 600) * S
    some = load(start=low, end=high)
    assert some.select("file").distinct().count() == 2 and some.count() == 40
    assert some.rdd.getNumPartitions() == 2  # one for each opened file
    log = load()
    assert log.where(F.col("rx") < low).count() == 150 and log.rdd.getNumPartitions() == 6 and log.count() == 360
    assert hourlog.hour_log(spark, str(logs)).count() == 361
    assert load(start=(START + 5 * H) * S).rdd.getNumPartitions() == 1
    assert load(start=(START + 5 * H) * S, slack_s=60).rdd.getNumPartitions() == 2
    assert load(start=(START + 99 * H) * S).count() == 0 and load(end=START * S).count() == 0


def test_a_file_cut_off_gives_its_whole_lines(spark, tmp_path):
    entries = [{"rx": (START + j) * S, "msg": {"text": f"{j * 7919 % 1000003:x}" * 5}} for j in range(4000)]
    write(tmp_path, hourlog.file_name("book", START), entries, cut=2000)
    name = tmp_path / hourlog.file_name("book", START + H)
    name.write_bytes(gzip.compress(b'{"rx": 5, "msg": "a"}\nnot json\n{"rx": 6}\n') + gzip.compress(b'{"rx": 7, "msg": "b"}\n{"rx": 8, "ms'))
    got = hourlog.hour_log(spark, str(tmp_path), "book").orderBy("rx").collect()
    assert [(r.rx, r.msg) for r in got[:2]] == [(5, "a"), (7, "b")]
    rest = got[2:]
    assert 3000 < len(rest) < 4000 and [r.rx for r in rest] == [e["rx"] for e in entries[: len(rest)]] and json.loads(rest[9].msg) == entries[9]["msg"]


def test_written_logs_are_read_back(spark, tmp_path):
    lines = spark.range(500).selectExpr(f"({START} + id * 40) * {S} AS rx", "concat('{\"n\": ', id, '}') AS msg")
    manifest = hourlog.write_hour_log(lines, str(tmp_path / "out"), "made").collect()
    assert sum(r.lines for r in manifest) == 500 and len(manifest) == 6
    back = hourlog.hour_log(spark, str(tmp_path / "out"), "made")
    assert sorted(map(tuple, back.select("rx", "msg").collect())) == sorted(map(tuple, lines.collect()))


def test_envelopes(spark):
    snapshot = {"event_type": "book", "asset_id": "u", "timestamp": "1000", "bids": [{"price": "0.4", "size": "5"}, {"price": "0.39", "size": "7"}], "asks": [{"price": ".45", "size": "2"}]}
    change = {"event_type": "price_change", "timestamp": 1100, "price_changes": [
        {"asset_id": "u", "price": "0.41", "size": "3", "side": "BUY", "best_bid": "0.41", "best_ask": "0.45"}, {"asset_id": "x", "price": 0.1, "size": 1, "side": "BUY"}, {"asset_id": "d", "price": 0.55, "size": 0, "side": "SELL"}]}
    trade = {"event_type": "last_trade_price", "asset_id": "d", "timestamp": "1200", "price": "0.6", "size": "9", "side": "BUY", "transaction_hash": "0xa"}
    quote, done, empty = {"event_type": "best_bid_ask", "asset_id": "u", "best_bid": "0.41", "best_ask": "0.45", "timestamp": "1"}, {"event_type": "market_resolved", "winning_outcome": "Up"}, {"event_type": "book", "asset_id": "d", "timestamp": 7}
    lines = [(1, json.dumps(snapshot)), (2, json.dumps([change, trade])), (3, json.dumps(quote)), (4, json.dumps(done)), (5, "broken {"), (6, json.dumps(empty)), (7, "[]")]
    log, assets = spark.createDataFrame(lines, "rx long, msg string"), spark.createDataFrame([("u", 0), ("d", 1)], "asset_id string, asset int")
    levels = [tuple(r) for r in hourlog.level_events(log, assets).orderBy("rx", "seq").collect()]
    assert levels == [(1, 0, 1000, 0, True, "B", 0.4, 5.0), (1, 1, 1000, 0, False, "B", 0.39, 7.0), (1, 2, 1000, 0, False, "S", 0.45, 2.0), (2, 0, 1100, 0, False, "B", 0.41, 3.0), (2, 2, 1100, 1, False, "S", 0.55, 0.0), (6, 0, 7, 1, True, "B", 0.0, 0.0)]
    rest = {r.kind: r for r in hourlog.other_events(log, assets).collect()}
    assert set(rest) == {"trade", "quote", "resolved"}
    assert (rest["trade"].asset, rest["trade"].price, rest["trade"].size, rest["trade"].tx) == (1, 0.6, 9.0, "0xa")
    assert (rest["quote"].bid, rest["quote"].ask, rest["resolved"].winner) == (0.41, 0.45, "Up")
