"""File scans on small files written by the test."""

import json

from tapeloom.sources import files


def test_klines_keep_last_and_drop_header_and_open_bar(spark, tmp_path):
    row = lambda t, c: f"{t},1,2,0.5,{c},10,{t},20,3,4,5,0"
    (tmp_path / "k.csv").write_text("\n".join([
        "open_time,open,high,low,close,volume,close_time,quote_volume,count,taker_buy_volume,taker_buy_quote_volume,ignore",
        row(1700000040000, 1.0), row(1700000100000000, 1.5), row(1700000040000, 1.2), row(1700000160000, 9.0)]))
    got = files.klines(spark, str(tmp_path / "k.csv"), "s", bar_s=60, now_s=1700000200).orderBy("open_time").collect()
    assert [(int(r.open_time.timestamp()), r.close) for r in got] == [(1700000040, 1.2), (1700000100, 1.5)]


def test_market_metadata(spark, tmp_path):
    rows = [{"slug": "a", "conditionId": "c", "outcomes": '["Down","Up"]', "outcomePrices": '["0","1"]', "clobTokenIds": '["d","u"]', "closed": True, "endDate": "2024-01-01T00:05:00Z"},
            {"slug": "b", "conditionId": "e", "outcomes": '["Up","Down"]', "outcomePrices": '["0.4","0.6"]', "clobTokenIds": '["u","d"]', "closed": True}]
    (tmp_path / "m.json").write_text("\n".join(json.dumps(r) for r in rows))
    got = {r.slug: r for r in files.market_metadata(spark, str(tmp_path / "m.json")).collect()}
    assert got["a"].resolved_up is True and got["a"].token_up == "u" and got["a"].up_price == 1.0
    assert got["b"].resolved_up is None and got["b"].token_down == "d"


def test_trades_and_upsert(spark, tmp_path):
    rows = [{"timestamp": 1, "proxyWallet": "0xAB", "side": "buy", "outcome": "UP", "conditionId": "c", "price": 0.5, "size": 4},
            {"timestamp": 2, "proxy_wallet": "0xcd", "side": "SELL", "outcome_index": 1, "condition_id": "c", "price": 0.25, "size": 4}]
    (tmp_path / "t.json").write_text("\n".join(json.dumps(r) for r in rows))
    got = files.trade_tape(spark, str(tmp_path / "t.json")).orderBy("ts").collect()
    assert [(r.wallet, r.side, r.outcome, r.notional) for r in got] == [("0xab", "BUY", "Up", 2.0), ("0xcd", "SELL", "Down", 1.0)]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string")
    assert sorted(map(tuple, files.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c")]


def test_book_log_keeps_one_copy_of_a_trade(spark, tmp_path):
    trade = {"e": "trade", "a": 0, "ts": 5, "p": 0.4, "s": 2.0, "side": "BUY", "tx": "x"}
    lines = [json.dumps({"rx": 1, **trade}), json.dumps({"rx": 9, **trade}), json.dumps({"rx": 2, "e": "bba", "bb": 0.4, "ba": 0.5}), '{"rx": 3, "e": "bo']
    (tmp_path / "b.json").write_text("\n".join(lines))
    rows, bad = files.book_log(spark, str(tmp_path / "b.json"))
    assert [r.rx for r in rows.orderBy("rx").collect()] == [1, 2]
    assert [r.bad_lines for r in bad.collect()] == [1]


def test_metrics_funding_and_their_union(spark, tmp_path):
    names = "create_time,symbol,sum_open_interest,sum_open_interest_value,count_toptrader_long_short_ratio,sum_toptrader_long_short_ratio,count_long_short_ratio,sum_taker_long_short_vol_ratio"
    (tmp_path / "m.csv").write_text("\n".join([names, "2024-01-01 00:05:00,S,2,20,1,1.5,,0.9", "2024-01-01 00:00:00,S,1,10,1,1.5,1.1,0.9", "2024-01-01 00:05:00,S,3,30,1,1.5,,0.9"]))
    (tmp_path / "f.csv").write_text("calc_time,funding_interval_hours,last_funding_rate\n1704067200001,8,0.1\n1704067200001,8,0.2\n1704067500000,8,0.3")
    m, f = files.metrics(spark, str(tmp_path / "m.csv")), files.funding(spark, str(tmp_path / "f.csv"), "S")
    assert [(r.available, r.open_interest, r.ls_ratio_accounts) for r in m.orderBy("available").collect()] == [(1704067500, 1.0, 1.1), (1704067800, 3.0, None)]
    assert [(r.available, r.funding_rate) for r in f.orderBy("available").collect()] == [(1704067201, 0.2), (1704067500, 0.3)]
    later = spark.createDataFrame([("S", 1704067500, 0.05), ("S", 1704067800, None)], "symbol string, available long, funding_rate double")
    got = files.combine_measures(m, f, later).orderBy("available").collect()
    assert [(r.available, r.open_interest, r.funding_rate) for r in got] == [(1704067201, None, 0.2), (1704067500, 1.0, 0.05), (1704067800, 3.0, None)]


def test_tick_log_keeps_sizes(spark, tmp_path):
    lines = [{"rx": 1, "stream": "abc@bookTicker", "b": "1.5", "B": "7", "a": "2.5", "A": "9"}, {"rx": 2, "stream": "abc@aggTrade", "E": 5, "T": 4, "p": "2", "q": "3", "m": True}]
    (tmp_path / "t.json").write_text("\n".join(map(json.dumps, lines)))
    quotes, trades = files.tick_log(spark, str(tmp_path / "t.json"))
    assert tuple(quotes.first()) == (1, "ABC", 1.5, 2.5, 7.0, 9.0, 2.0)
    assert tuple(trades.first()) == (2, "ABC", 5, 4, 2.0, 3.0, True)


def test_writing_one_day_keeps_the_others(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "symbol string, day string, x int")
    files.write_partitioned(rows(("a", "1", 1), ("a", "2", 2)), str(tmp_path / "out"))
    files.write_partitioned(rows(("a", "2", 3)), str(tmp_path / "out"))
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3]
