"""First passage, reactions and what is built on them, against plain loops."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tapeloom.operators import attribution, covers, ladder, lags, passage, quantile, reactions
from tapeloom.plans import stacking


def random_walks(rng, n, keys=2, step=1.0):
    out = []
    for k in range(keys):
        t = np.cumsum(rng.exponential(step, n))
        x = np.cumsum(rng.normal(0, 1, n))
        x[rng.random(n) < 0.1] = np.nan
        out.append(pd.DataFrame({"key": f"k{k}", "t": t, "x": x, "y": -x / 2}))
    return pd.concat(out, ignore_index=True)


@pytest.mark.parametrize("rows, fan", [(4096, 4096), (4, 3), (7, 2)])
def test_first_passage_equals_a_search(spark, rows, fan):
    rng = np.random.default_rng(4)
    series = random_walks(rng, 150)
    asked = []
    for k in range(160):
        own = series[series.key == f"k{k % 2}"]
        start = rng.uniform(-5, own.t.max() + 5)
        asked.append((f"k{k % 2}", f"q{k}", int(rng.integers(0, 2)), start, start + float(rng.choice([3.0, 40.0, 1e9])), float(rng.normal(0, 8)), bool(rng.integers(0, 2))))
    asked += [("k0", "null level", 0, 1.0, 50.0, None, True), ("gone", "no series", 0, 1.0, 50.0, 0.0, True), ("k0", "twin", 0, 1.0, 1e9, 2.0, True)]
    schema = "key string, query string, column int, start double, stop double, level double, rising boolean"
    got = passage.first_passage(spark.createDataFrame(asked, schema), spark.createDataFrame(series.astype(object).where(series.notna(), None), "key string, t double, x double, y double"), ["key"], "t", ["x", "y"], rows=rows, fan=fan)
    found = {(r.key, r.query): r.passage for r in got.collect()}
    assert len(found) == len(asked)
    for key, name, column, start, stop, level, rising in asked:
        own = series[(series.key == key) & (series.t > start) & (series.t <= stop)]
        x = own[["x", "y"][column]]
        hit = own.t[(x >= level) if rising else (x <= level)] if level is not None else own.t[:0]
        assert found[key, name] == (hit.min() if len(hit) else None), name


def test_first_reaching_in_one_tile():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 8, 9, 100):
        values = rng.normal(size=n)
        start, level = rng.integers(0, n + 3, 200), rng.normal(size=200)
        got = passage.first_reaching(values, start, level)
        want = [next((k for k in range(s, n) if values[k] >= v), n) for s, v in zip(start, level)]
        assert got.tolist() == want


def test_a_follower_is_timed(spark):
    grid = pd.DataFrame({"key": "a", "t": np.arange(0.0, 30.0), "p": np.where(np.arange(30) >= 10, 0.8, 0.4)})
    updates = pd.DataFrame({"key": "a", "t": [9.25, 9.75], "p": [0.5, 0.8]})
    book = pd.DataFrame({"key": "a", "t": [0.0, 7.0, 10.5, 11.0, 12.0], "bid": [0.39, 0.39, 0.39, 0.6, 0.79], "ask": [0.41, 0.42, 0.45, 0.62, 0.81]})
    made = [spark.createDataFrame(x) for x in (grid, updates, book)]
    rows = reactions.reaction_events(*made, ["key"], steps=1, jump=0.05, refractory=2.0, horizon=20.0, placebo=3.0).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.t_event, r.t_prev, r.t0) == (10.0, 9.0, 9.75)
    assert r.delay_ask == pytest.approx(0.75) and r.delay_bid == pytest.approx(1.25) and r.delay_first == pytest.approx(0.75)
    assert r.delay_50 == pytest.approx(1.25) and r.delay_90 == pytest.approx(2.25) and not r.censored_90
    assert r.delay_placebo == pytest.approx(7.0 - 6.75)
    short = reactions.reaction_events(*made, ["key"], steps=1, jump=0.05, refractory=2.0, horizon=2.5, placebo=0.5).collect()[0]
    assert short.delay_50 == pytest.approx(1.25) and short.delay_90 is None and short.censored_90 and short.delay_placebo is None


def replayed(events, questions, reach):
    """The book by a plain replay, market by market."""
    out = {}
    for key, own in questions.groupby("key"):
        rows = events[events.key == key].sort_values(["t", "seq"])
        for q in own.itertuples():
            sides, fresh = {"B": {}, "S": {}}, False
            for e in rows[rows.t <= q.t].itertuples():
                if e.is_snapshot:
                    sides, fresh = {"B": {}, "S": {}}, True
                sides[e.side][e.price] = e.size
            bids, asks = ({p: s for p, s in sides[c].items() if s > 0} for c in "BS")
            bid, ask = max(bids, default=None), min(asks, default=None)
            mid = (bid + ask) / 2 if bids and asks else None
            out[key, q.query] = (
                bid, bids.get(bid), ask, asks.get(ask), mid and sum(s for p, s in bids.items() if p >= mid - reach), mid and sum(s for p, s in asks.items() if p <= mid + reach),
                {"B": bids, "S": asks}.get(q.side, {}).get(q.price, 0.0), len(bids) + len(asks), fresh, sorted(bids.items(), reverse=True)[:2], sorted(asks.items())[:2])
    return out


@pytest.mark.parametrize("rows, cells", [(4096, 1 << 21), (5, 1 << 21), (16, 30)])
def test_books_equal_a_replay(spark, monkeypatch, rows, cells):
    monkeypatch.setattr(ladder, "CELLS", cells)
    rng = np.random.default_rng(9)
    n = 240
    events = pd.DataFrame({"key": rng.choice(["a", "b"], n, p=[0.8, 0.2]), "t": np.sort(rng.integers(0, 120, n)).astype(float), "seq": np.arange(n), "side": rng.choice(["B", "S"], n), "price": rng.integers(40, 60, n).astype(float),
                           "size": rng.choice([0.0, 1.0, 2.5, 7.0], n), "is_snapshot": rng.random(n) < 0.03})
    asked = pd.DataFrame({"key": rng.choice(["a", "b", "none"], 90), "t": rng.integers(-3, 130, 90).astype(float), "query": [str(k) for k in range(90)], "side": rng.choice(["B", "S"], 90), "price": rng.integers(40, 60, 90).astype(float)})
    made = ladder.book_states(spark.createDataFrame(events), ["key"], "t", questions=spark.createDataFrame(asked), reach=4.0, depth=2, rows=rows)
    want = replayed(events, asked, 4.0)
    got = made.collect()
    assert len(got) == len(asked)
    for r in got:
        mine = (r.bid, r.bid_size, r.ask, r.ask_size, r.depth_bid, r.depth_ask, r.level_size, r.n_levels, r.fresh, [tuple(x) for x in r.bids], [tuple(x) for x in r.asks])
        assert mine == want.get((r.key, r.query), (None,) * 6 + (0.0, 0, False, [], [])), (r, want.get((r.key, r.query)))


def test_shares_of_a_level_add_up(spark):
    rng = np.random.default_rng(2)
    lower = pd.DataFrame({"key": "a", "seq": range(80), "t": np.sort(rng.uniform(0, 400, 80)), "side": "B", "price": rng.integers(1, 3, 80), "amount": rng.integers(1, 9, 80).astype(float), "left": 0.0})
    trades = pd.DataFrame({"key": "a", "seq": range(60), "t": np.sort(rng.uniform(0, 400, 60)), "side": "B", "price": rng.integers(1, 3, 60), "size": rng.integers(1, 9, 60).astype(float)})
    out = attribution.explain_decreases(spark.createDataFrame(lower), spark.createDataFrame(trades), ["key"], "t", lead=1.0, pause=12.0).toPandas()
    assert len(out) == 140 and (out.explained >= 0).all() and (out.explained <= out.amount).all()
    for price, own in out.groupby("price"):
        d, t = (own[own.kind == k].explained.sum() for k in ("decrease", "trade"))
        assert d == pytest.approx(t) and 0 < d < own[own.kind == "decrease"].amount.sum()
        pool, last, taken = 0.0, None, {}
        both = own.assign(at=np.where(own.kind == "trade", own.t - 1.0, own.t), kind_no=(own.kind == "decrease").astype(int)).sort_values(["at", "kind_no", "seq"])
        for r in both.itertuples():
            if last is not None and r.at - last > 12.0:
                pool = 0.0
            last = r.at
            if r.kind == "trade":
                pool += r.amount
            else:
                taken[r.seq] = min(pool, r.amount)
                pool -= taken[r.seq]
        mine = own[own.kind == "decrease"].set_index("seq").explained
        assert mine.to_dict() == pytest.approx(taken)


def test_lags_equal_plain_sums(spark):
    rng = np.random.default_rng(7)
    t = np.arange(0.0, 400.0)
    x = np.cumsum(rng.normal(size=400))
    ticks = pd.DataFrame({"key": "a", "t": t + rng.uniform(0, 0.9, 400), "v": x})
    reference = pd.DataFrame({"key": "a", "t": t[5:], "v": np.r_[x[2:-3]]})
    shifts = [float(k) for k in range(-4, 9)]
    scan = lags.lag_scan(spark.createDataFrame(reference), spark.createDataFrame(ticks), ["key"], "t", "v", shifts, 2.0, tile_s=37.0).toPandas().sort_values("lag")
    at = lambda s: np.array([ticks.v[ticks.t <= q].iloc[-1] if (ticks.t <= q).any() else np.nan for q in s])
    now = reference.t.to_numpy()[2:]
    change = reference.v.to_numpy()[2:] - reference.v.to_numpy()[:-2]
    for r in scan.itertuples():
        y = at(now - r.lag) - at(now - r.lag - 2.0)
        good = np.isfinite(y)
        assert r.n == good.sum() and r.corr == pytest.approx(np.corrcoef(change[good], y[good])[0, 1])
    assert lags.best_lag(spark.createDataFrame(scan), ["key"]).first().lag == scan.lag[scan["corr"].idxmax()]


@pytest.mark.parametrize("rows", [16_384, 90])
def test_responses_are_least_squares(spark, rows):
    rng = np.random.default_rng(3)
    n, k = 500, 6
    c = np.cumsum(rng.normal(size=n))
    dc = np.diff(c, prepend=np.nan)
    e = np.cumsum(0.5 * np.nan_to_num(dc) + 0.3 * np.nan_to_num(np.r_[np.full(3, np.nan), dc[:-3]]) + rng.normal(0, 0.05, n))
    c[200] = np.nan
    grid = pd.DataFrame({"key": "a", "t": np.arange(n, dtype=float), "c": c, "e": e})
    got = lags.distributed_lags(spark.createDataFrame(grid.astype(object).where(grid.notna(), None), "key string, t double, c double, e double"), ["key"], "t", "c", "e", k - 1, rows=rows).toPandas().sort_values("lag")
    dc, de = np.diff(c, prepend=np.nan), np.diff(e, prepend=np.nan)
    x = np.stack([np.r_[np.full(j, np.nan), dc[: n - j]] for j in range(k)], axis=1)
    good = np.isfinite(x).all(axis=1) & np.isfinite(de)
    beta, *_ = np.linalg.lstsq(x[good], de[good], rcond=None)
    assert got.n.iloc[0] == good.sum()
    np.testing.assert_allclose(got.beta, beta, rtol=1e-8, atol=1e-10)
    np.testing.assert_allclose(got.share, np.cumsum(beta) / beta.sum(), rtol=1e-8)
    times = lags.response_times(spark.createDataFrame(got), ["key"], 0.5, (0.5, 0.9)).first()
    assert (times.t_50, times.t_90, times.t_peak) == (0.0, 1.5, 0.0)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 5000, p=[0.9, 0.09, 0.01]), "v": np.where(rng.random(5000) < 0.3, 2.0, rng.normal(size=5000).round(2))})
    rows = pd.concat([rows, pd.DataFrame({"g": ["d", "a", "e"], "v": [7.0, np.nan, None]})])
    probs = [0.0, 0.01, 0.3, 0.5, 0.77, 1.0]
    df = spark.createDataFrame(rows.astype(object).where(rows.notna(), None), "g string, v double")
    got = {r.g: r.q for r in quantile.exact_quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    for g, own in rows.dropna().groupby("g"):
        np.testing.assert_allclose(got[g], np.quantile(own.v.astype(float), probs), rtol=0, atol=1e-12)
    whole = quantile.exact_quantiles(df, [], "v", [0.25]).first()
    assert whole.q[0] == np.quantile(rows.v.dropna().astype(float), 0.25) and whole.n == rows.v.notna().sum()
    classes = quantile.regime(df, ["g"], "v", F.col("v") < 1.5).toPandas()
    own = rows[(rows.g == "a") & (rows.v < 1.5)].v.astype(float)
    edges = np.quantile(own, [0.2, 0.4, 0.6, 0.8])
    a = classes[(classes.g == "a") & classes.v.notna()]
    assert (a.quintile == np.searchsorted(edges, a.v, side="right") + 1).all()
    assert classes[classes.g == "d"].quintile.isna().all()


def test_small_logistic_fits(spark):
    rng = np.random.default_rng(6)
    parts = []
    for g, n in (("a", 400), ("b", 60), ("few", 10), ("apart", 40), ("one", 30)):
        x = rng.normal(size=(n, 2))
        y = (rng.random(n) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0])))).astype(int)
        y = (x[:, 0] > 0).astype(int) if g == "apart" else np.ones(n, int) if g == "one" else y
        parts.append(pd.DataFrame({"g": g, "x1": x[:, 0], "x2": x[:, 1], "y": y}))
    rows = pd.concat(parts, ignore_index=True)
    fits = {r.g: r for r in stacking.newton_logits(spark.createDataFrame(rows), ["g"], ["x1", "x2"], "y").collect()}
    assert set(fits) == {"a", "b", "few", "apart", "one"} and fits["few"].coef is None and fits["one"].coef is None and fits["few"].n == 10
    for g in ("a", "b", "apart"):
        own = rows[rows.g == g]
        x = np.column_stack([np.ones(len(own)), own.x1, own.x2])
        w = np.array(fits[g].coef)
        slope = x.T @ (own.y - 1 / (1 + np.exp(-x @ w))) - np.array([0, 1e-4, 1e-4]) * w
        assert np.abs(slope).max() / len(own) < 1e-8 and fits[g].gradient < 1e-9
    test = stacking.stacking(rows_p := spark.createDataFrame(rows.assign(p=0.3, q=np.where(rows.x1 > 0, 0.6, 0.4), t=np.arange(len(rows)))), ["g"], ["p", "q"], "y", F.col("t") % 2 == 0)[1]
    out = test.toPandas()
    assert len(out) == len(rows) // 2 and out[out.g == "few"].p_stack.round(9).eq(0.3).all() and rows_p.columns == [c for c in out.columns if c != "p_stack"]


def test_covers_follow_every_change(spark):
    rng = np.random.default_rng(8)
    n = 160
    asks = pd.DataFrame({"g": rng.integers(0, 2, n), "token": rng.choice(list("abc"), n), "t": np.sort(rng.integers(0, 100, n)).astype(float), "seq": np.arange(n), "ask": np.where(rng.random(n) < 0.15, np.nan, rng.integers(10, 60, n) / 100)})
    vertices = [(1, "a", 1.0), (1, "b", 1.0), (2, "b", 0.5), (2, "c", 1.0)]
    table = spark.createDataFrame([(g, *x) for g in (0, 1) for x in vertices], "g long, vertex int, token string, weight double")
    made = covers.cover_margins(spark.createDataFrame(asks.astype(object).where(asks.notna(), None), "g long, token string, t double, seq long, ask double"), table, ["g"], "t")
    spans = made.toPandas().sort_values(["g", "t"])
    for g, own in asks.groupby("g"):
        mine = spans[spans.g == g]
        assert mine.t.tolist() == sorted(own.t.unique()) and mine.until.tolist()[:-1] == mine.t.tolist()[1:]
        for r in mine.itertuples():
            now = own[own.t <= r.t].groupby("token").tail(1).set_index("token").ask.dropna()
            costs = {v: sum(w * now[t] for u, t, w in vertices if u == v) for v in (1, 2) if all(t in now for u, t, _ in vertices if u == v)}
            if costs:
                assert r.cost == pytest.approx(min(costs.values())) and costs[int(r.vertex)] == pytest.approx(r.cost)
            else:
                assert pd.isna(r.cost) and pd.isna(r.vertex)
    hist = covers.time_histogram(made, ["g"], "margin", 0.1, cell_s=7.0).toPandas()
    for g, own in hist.groupby("g"):
        assert own.seconds.sum() == pytest.approx(spans[spans.g == g].t.max() - spans[spans.g == g].t.min()) and own.groupby("hour").seconds.sum().max() <= 7.0
