"""Studies of the trade tape against brute force."""

import itertools
import re

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

from tapeloom.catalog import tape, trading
from tapeloom.functions.numeric import ndigits, round_binary
from tapeloom.operators import ledger, orders, quantile, ranks, series, tapes
from tapeloom.streaming import state


def test_leader_ranks_match_brute_force(spark):
    rng = np.random.default_rng(3)
    days = pd.DataFrame({"h": rng.integers(0, 60, 700), "wallet": rng.integers(0, 90, 700), "pnl": rng.integers(-20, 25, 700).astype(float)})
    days = days.groupby(["h", "wallet"], as_index=False).pnl.sum()
    got = tapes.leader_ranks(spark.createDataFrame(days), [4, 6, 30], 3).toPandas()
    want = []
    for look in (4, 6, 30):
        for h in range(1, 91):
            s = days[(days.h < h) & (days.h >= h - look)].groupby("wallet").pnl.sum()
            s = s[s > 0].reset_index().sort_values(["pnl", "wallet"], ascending=[False, True]).head(3)
            want += [(look, h, w, p, k) for k, (w, p) in enumerate(zip(s.wallet, s.pnl), 1)]
    assert sorted(map(tuple, got[["lookback", "h", "wallet", "past", "rk"]].to_numpy().tolist())) == sorted(map(tuple, [[float(x) for x in r] for r in want]))


def test_best_steps_hold_k_rows_a_period():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 200, 20000)
    z, past, wallet = a + rng.integers(1, 121, 20000), rng.integers(1, 5000, 20000).astype(float), np.arange(20000)
    best = tapes.BestSteps(5)
    best.add(a, z, wallet, past)
    assert np.unique(best.h, return_counts=True)[1].max() == 5
    for h in (0, 7, 150, 300):
        on = np.flatnonzero((a <= h) & (h < z))
        top = on[np.lexsort((wallet[on], -past[on]))][:5]
        assert best.wallet[best.h == h].tolist() == wallet[top].tolist()


def test_fills_over_long_spans_match_brute_force(spark):
    rng = np.random.default_rng(5)
    o = pd.DataFrame({"order_id": range(120), "m": rng.integers(0, 2, 120), "level": rng.choice([0.3, 0.5], 120), "t_place": rng.integers(0, 2000, 120).astype(float)})
    o["t_cancel"], o["q_ahead"], o["size"] = o.t_place + rng.integers(-3, 60, 120), 4.0, 2.0
    t = pd.DataFrame({"m": rng.integers(0, 2, 900), "t": rng.integers(0, 2100, 900).astype(float), "seq": rng.permutation(900), "size": rng.integers(1, 4, 900).astype(float)})
    t["cp"], t["ap"] = rng.choice([0.2, 0.3, 0.5, 0.7], 900), np.where(rng.random(900) < 0.03, 0.45, np.nan)
    trades = spark.createDataFrame(t).withColumn("ap", F.when(~F.isnan("ap"), F.col("ap")))
    got = orders.resting_fills(spark.createDataFrame(o), trades, ["m"], delay=2, lookback=10)
    got = {r.order_id: r for r in got.collect()}
    assert len(got) == 120
    for r in o.itertuples():
        x = t[t.m == r.m].sort_values(["t", "seq"])
        cross = bool(((x.ap <= r.level + 1e-9) & (x.t >= r.t_place + 2 - 10) & (x.t < r.t_place + 2)).any())
        x = x[(x.t >= r.t_place + 2) & (x.t < r.t_cancel + 2) & (x.cp <= r.level + 1e-9)]
        cum = x["size"].cumsum()
        done = x[(cum >= 6 - 1e-9) | (x.cp < r.level - 1e-9)]
        g = got[r.order_id]
        assert g.crossing == cross
        if cross or r.t_cancel <= r.t_place:
            assert g.t_fill is None and g.consumed is None
        elif len(done):
            assert g.t_fill == done.t.iloc[0] and g.consumed == cum[done.index[0]]
            assert g.reason == ("traversal" if done.cp.iloc[0] < r.level - 1e-9 else "queue")
        else:
            assert g.t_fill is None and g.consumed == x["size"].sum()


def test_orders_move_once(spark):
    o = spark.createDataFrame([(1, 0, 0.5, 0.0, 9.0, 1.0, 1.0)], "order_id long, m long, level double, t_place double, t_cancel double, q_ahead double, size double")
    t = spark.createDataFrame([(0, 1.0, 1, 5.0, 0.4, None)], "m long, t double, seq long, size double, cp double, ap double")
    plan = orders.resting_fills(o, t, ["m"], delay=0, lookback=1, life=9, levels=[0.5])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange REPARTITION") <= 2


def test_pairs_of_orders_with_ids_beyond_doubles(spark, monkeypatch):
    # neighbours of one double: as doubles they would be one group of four
    first = 72_000_000_000_000_001
    rows = [(10 * p + k, 0.35, k == 1) for p in (first, first + 1) for k in (1, 3)]
    monkeypatch.setattr(trading, "settled", lambda spark, d: spark.createDataFrame(rows, "order_id long, level double, executed boolean"))
    assert tuple(trading.QUERIES["D25_pair_summary"].spark(spark, "").first()) == (2, 0, 2, 0)


def test_ranks_of_equal_sums_do_not_follow_the_order_of_rows(spark):
    # 0.1 + 0.2 + 0.3 has another last bit in another order
    base = {"window_start": 0, "fees": 0.0, "volume": 1.0, "n_trades": 1, "taker_notional": 0.0, "first_t_rel": 1, "asset": "a"}
    ranks_of = set()
    for order in itertools.permutations([0.1, 0.2, 0.3]):
        rows = pd.DataFrame([{**base, "wallet": 2, "condition": k, "pnl": x} for k, x in enumerate(order)] + [{**base, "wallet": 1, "condition": 9, "pnl": 0.6000000000000001}])
        got = ledger.hourly_wallet_table(spark.createDataFrame(rows).coalesce(1)).collect()
        ranks_of.add(tuple(sorted((r.wallet, r.rank_pnl, r.pnl) for r in got)))
    assert ranks_of == {((1, 1, 0.6000000000000001), (2, 2, 0.1 + 0.2 + 0.3))}


def test_medians_of_a_profile_store_brackets_only(spark, monkeypatch):
    sizes, kept = [], quantile.materialise

    def watched(df):
        out = kept(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(quantile, "materialise", watched)
    rng = np.random.default_rng(8)
    n = 20001
    t = pd.DataFrame({"wallet": rng.integers(0, 50, n), "role": "taker", "side": "BUY", "price": 0.5, "size": rng.integers(1, 9, n).astype(float), "t_rel": rng.permutation(n) * 7 - 900})
    got = {r.is_top: r for r in tapes.profile(spark.createDataFrame(t), spark.createDataFrame([(3,), (4,)], "wallet long")).collect()}
    for top, own in t.groupby(t.wallet.isin([3, 4])):
        assert (got[top].n_fills, got[top].size_p50, got[top].t_rel_p50) == (len(own), own["size"].median(), own.t_rel.median())
    assert max(sizes) < 1000


def test_quantiles_of_few_groups(spark, monkeypatch):
    rng = np.random.default_rng(9)
    p = pd.DataFrame({"g": ["a"] * 9000 + ["b"] * 4 + ["c"], "x": np.round(rng.normal(size=9005), 3), "y": rng.integers(-3, 3, 9005).astype(float)})
    df = spark.createDataFrame(p).withColumn("x", F.when(F.col("y") != 2, F.col("x")))
    probs = [0.0, 0.3, 0.5, 0.9999, 1.0]
    want = {(g, c): np.quantile(own.loc[own.y != 2, c] if c == "x" else own[c], probs) for g, own in p.groupby("g") for c in ("x", "y") if c == "y" or (own.y != 2).any()}
    for bracket in (quantile.BRACKET, -0.1):  # with the second none is found in its bracket
        monkeypatch.setattr(quantile, "BRACKET", bracket)
        got = {(r.g, r["_name"]): r.q for r in quantile.few_groups_quantiles(df, ["g"], ["x", "y"], probs).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=0, atol=1e-12) for k in want)


def test_rounding_of_binary_halves(spark):
    # 0.285 is a little less than its shortest decimal form says
    r = spark.range(1).select(round_binary(F.lit(30975.0 - 1050.0) / 105000, 2).alias("a"), ndigits(F.lit(49.0453125)).alias("b"), ndigits(F.lit(float("inf"))).alias("c")).first()
    assert (r.a, r.b, r.c) == (0.28, 49.045313, float("inf"))


def test_a_price_of_zero_has_no_slope_and_an_endless_range(spark):
    t = pd.DataFrame({"symbol": "a", "ts": pd.to_datetime([0, 60, 120, 3600, 3660, 3720], unit="s"), "price": [1.0, 0.0, 2.0, 1.0, 2.0, 4.0], "size": 1})
    got = series.half_window_aggregates(spark.createDataFrame(t), 3600).orderBy("t").collect()
    assert np.isnan(got[0].slope1) and abs(got[1].slope1 - np.log(2)) < 1e-9
    b = pd.DataFrame({"symbol": "a", "t": np.arange(8) * 3600, "open": 2.0, "close": 2.0, "high": 3.0, "low": 1.0})
    b.loc[2, "low"] = 0.0
    b["open_time"] = pd.to_datetime(b.t, unit="s")
    v = series.vol_estimators(spark.createDataFrame(b), 4, bar_s=3600).orderBy("t").toPandas()
    assert np.isinf(v.park4[3:6]).all() and np.isinf(v.gk4[3:6]).all() and np.isfinite(v.park4[6:]).all()


def test_price_buffer_counts_rows_of_one_time_together():
    class Empty:
        exists = staticmethod(lambda: False)
        put = staticmethod(lambda rows: None)

    buffer = state.PriceBuffer(["k"], 10.0)
    buffer.buffer = Empty()
    got = buffer.apply(("a",), pd.DataFrame({"us": [0, 5_000_000, 5_000_000], "seq": [1, 2, 3], "price": [1.0, 2.0, 6.0]}))
    assert got["held"].tolist() == [1, 3, 3] and got["mean"].tolist() == [1.0, 3.0, 3.0]


def test_cells_follow_the_size_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(ranks, "CELL_ROWS", 50)
    p = pd.DataFrame({"g": ["a"] * 1000 + ["b"] * 40, "x": np.random.default_rng(6).permutation(1040).astype(float), "i": range(1040)})
    df = spark.createDataFrame(p)
    cells = ranks.value_cells(df, ["g"], "x").groupBy("g").agg(F.countDistinct("_cell").alias("n")).toPandas().set_index("g").n
    assert cells["b"] == 1 and 15 <= cells["a"] <= 25
    got = ranks.ordinal_rank(df, ["g"], "x", ["i"], "r").orderBy("i").toPandas()
    assert (got.r == p.groupby("g").x.rank(ascending=False)).all()


def test_parts_of_a_key_keep_rows_of_one_time_together():
    rows = pd.DataFrame({"us": [1, 2, 2, 2, 3, 5, 5], "seq": range(7)})
    parts = list(state.whole_times(rows, 2))
    assert [p["us"].tolist() for p in parts] == [[1, 2, 2, 2], [3, 5, 5]]
    schema = T.StructType([T.StructField("us", T.LongType()), T.StructField("p", T.DoubleType())])
    got = state.as_frame(iter([(k, None if k % 3 else 0.5) for k in range(state.SLICE + 5)]), schema)
    assert len(got) == state.SLICE + 5 and got["us"].dtype == np.int64 and got["p"].isna().sum() == (got["us"] % 3 != 0).sum()


def test_spread_rows_stay_spread(spark):
    # small partitions would be merged into one otherwise
    spread = tapes.spread(spark.range(20000), 1000, "id")
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 1500


def test_row_matching_reads_lines_once_in_tasks_of_few_rows(spark, monkeypatch):
    monkeypatch.setattr(tape, "MATCH_ROWS", 100, raising=False)
    df = tape.Q["J28_row_matching"].spark(spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    tasks = [int(n) for n in re.findall(r"Exchange hashpartitioning\(l_orderkey#\w+, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert tasks == [60] and plan.count("/lineitem.parquet]") == 1


def test_row_matching_of_odd_rows(spark, tmp_path):
    lines = pd.DataFrame(
        [(1, 5, 1, 2.0, 42000.0), (1, 5, 7, 3.0, 42000.0), (1, 6, 7, 1.0, 42000.0), (2, None, 1, 4.0, 42000.0), (2, 8, 1, None, 42000.0),
         (2, 9, 1, 5.0, None), (3, 5, 1, 6.0, 104999.0), (3, 6, None, 6.0, 21000.0), (4, 5, 1, 7.0, 42000.0), (9, 5, 1, 8.0, 42000.0), (None, 5, 1, 9.0, 42000.0)],
        columns=["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice"]).astype({"l_orderkey": "Int64", "l_partkey": "Int64", "l_linenumber": "Int32"})
    lines = lines.assign(l_suppkey=1, l_returnflag="N", l_linestatus="O", l_shipdate=pd.Timestamp("1995-01-01").as_unit("us"))
    # an order twice for one wallet, for two wallets, and one without a wallet
    owners = pd.DataFrame({"o_orderkey": [1, 1, 2, 3, 3, 4], "o_custkey": pd.array([10, 10, 20, 30, 31, None], "Int64")})
    con = duckdb.connect()
    for name, rows in (("lineitem", lines), ("orders", owners), ("part", pd.DataFrame({"p_partkey": [5], "p_brand": "b", "p_size": 1}))):
        rows.to_parquet(tmp_path / f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    q = tape.Q["J28_row_matching"]
    assert tuple(q.spark(spark, str(tmp_path)).first()) == con.execute(q.sql).fetchone()


def test_row_matching_of_two_sources(spark):
    rows = spark.createDataFrame(
        [("a", 1, 2.0, 0.5), ("a", 1, 1.0, 0.7), ("b", 1, 3.0, 0.6), ("a", 2, 1.0, 0.5), ("b", 2, 2.0, 0.5), ("a", 3, 1.0, 0.5), ("b", 4, 1.0, 0.5),
         ("a", None, 1.0, 0.5), ("b", None, 1.0, 0.5)], "source string, tx long, size double, price double")
    side = lambda s: (F.col("source") == s, F.col("size"), F.col("price"))
    assert tuple(tapes.match_rows(rows, ["tx"], side("a"), side("b")).first()) == (4, 2, 0.5, 1.0)
