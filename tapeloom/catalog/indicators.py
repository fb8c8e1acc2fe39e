"""Indicator queries I01-I64, one per catalogue line, on hourly bars."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tapeloom.catalog import views
from tapeloom.catalog.registry import Query
from tapeloom.functions.numeric import ndigits
from tapeloom.plans.indicators import compute_indicators

# lengths that do not fit a few hundred bars, replaced by shorter ones
LENGTHS = {1440: 200, 43200: 300}
DAY = LENGTHS[1440]

ALPHA = lambda n: f"(2.0/({n}+1))"


class Sql:
    """Builds one SELECT in stages; every stage may use window functions over the columns of the stage before."""

    def __init__(self, source: str = "bars", ctes: tuple[str, ...] = ()):
        self.source, self.ctes, self.stages, self.done = source, ctes, [], set()
        self.stage("lc", "ln(close)")
        self.stage("r1", "lc - lag(lc) OVER w")
        self.stage("sg", self.rv(60))

    def stage(self, name: str, expr: str) -> str:
        if name not in self.done:
            self.done.add(name)
            self.stages.append((name, expr))
        return name

    @staticmethod
    def fr(n: int) -> str:
        return f"(PARTITION BY symbol ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    def roll(self, fn: str, x: str, n: int, least: int | None = None) -> str:
        f = self.fr(n)
        return f"CASE WHEN count({x}) OVER {f} >= {n if least is None else least} THEN {fn}({x}) OVER {f} END"

    def mean(self, x, n): return self.roll("avg", x, n)
    def total(self, x, n): return self.roll("sum", x, n)
    def rv(self, n): return f"sqrt({self.mean('r1*r1', n)})"

    def z(self, x: str, n: int, least: int | None = None) -> str:
        return f"(({x}) - ({self.roll('avg', x, n, least)})) / nullif({self.roll('stddev_samp', x, n, least)}, 0)"

    def ema(self, x: str, alpha: str, least: int) -> str:
        run = "(PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING)"
        known = f"list_filter(list({x}) OVER {run}, lambda e: e IS NOT NULL)"
        return (f"CASE WHEN count({x}) OVER {run} >= {least} THEN "
                f"list_reduce({known}, lambda y, e: y + {alpha} * (e - y)) END")

    def text(self, outputs: dict[str, str]) -> str:
        sql, prev = [], self.source
        for i, (name, expr) in enumerate(self.stages):
            sql.append(f"s{i} AS (SELECT *, {expr} AS {name} FROM {prev} WINDOW w AS (PARTITION BY symbol ORDER BY t))")
            prev = f"s{i}"
        fin = "".join(f", round(CASE WHEN isfinite(({e})::DOUBLE) THEN ({e})::DOUBLE END, 6) + 0.0 AS {n}"
                      for n, e in outputs.items())
        return (views.base(*self.ctes, *sql) +
                f"SELECT symbol, t{fin} FROM {prev} WINDOW w AS (PARTITION BY symbol ORDER BY t)")


def _spark(names, source):
    def run(spark, d):
        out = compute_indicators(source(spark, d), names, lengths=LENGTHS, keep=["symbol", "t"])
        return out.select("symbol", F.col("t").cast("long").alias("t"), *[ndigits(F.col(n)).alias(n) for n in names])
    return run


def _plain(build, **kw):
    s = Sql(**kw)
    outputs = build(s)
    return list(outputs), s.text(outputs)


def _atr(s: Sql, n: int) -> str:
    s.stage("pc", "lag(close) OVER w")
    s.stage("tr", "greatest(high - low, abs(high - pc), abs(low - pc))")
    return s.stage(f"atr{n}", s.ema("tr", f"(1.0/{n})", n))


def _ema_close(s: Sql, n: int) -> str:
    return s.stage(f"ec{n}", s.ema("close", ALPHA(n), n))


def _mid(s: Sql, n: int) -> str:
    return s.stage(f"mid{n}", f"(({s.roll('max', 'high', n)}) + ({s.roll('min', 'low', n)})) / 2")


def _stoch(s: Sql, n: int) -> str:
    lo, hi = s.roll("min", "low", n), s.roll("max", "high", n)
    return s.stage(f"k{n}", f"(close - ({lo})) / nullif(({hi}) - ({lo}), 0)")


def _clv(s: Sql) -> str:
    return s.stage("clv0", "CASE WHEN high = low THEN 0.0 ELSE ((close-low)-(high-close))/(high-low) END")


def _macd(s: Sql) -> dict[str, str]:
    out = {}
    for f, sl, g in ((12, 26, 9), (6, 13, 5)):
        a, b = _ema_close(s, f), _ema_close(s, sl)
        line = s.stage(f"ml{f}", f"{a} - {b}")
        sig = s.stage(f"ms{f}", s.ema(line, ALPHA(g), g))
        out[f"macd_line_{f}_{sl}"] = f"{line}/(close*sg)"
        out[f"macd_signal_{f}_{sl}_{g}"] = f"{sig}/(close*sg)"
        out[f"macd_hist_{f}_{sl}_{g}"] = f"({line}-{sig})/(close*sg)"
    return out


def _dmi(s: Sql) -> dict[str, str]:
    atr = _atr(s, 14)
    s.stage("up", "high - lag(high) OVER w")
    s.stage("dn", "lag(low) OVER w - low")
    s.stage("pdm", "CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END")
    s.stage("mdm", "CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END")
    s.stage("pdi", f"({s.ema('pdm', '(1.0/14)', 14)}) / {atr}")
    s.stage("mdi", f"({s.ema('mdm', '(1.0/14)', 14)}) / {atr}")
    s.stage("dx", "abs(pdi - mdi) / nullif(pdi + mdi, 0)")
    return {"adx_14": s.ema("dx", "(1.0/14)", 14), "di_diff_14": "pdi - mdi"}


def _aroon(s: Sql) -> dict[str, str]:
    s.stage("rn", "row_number() OVER w")
    f = s.fr(26)
    since = lambda x: (f"CASE WHEN count({x}) OVER {f} = 26 THEN rn - max(rn) FILTER (WHERE {x} = m) OVER {f} END")
    s.stage("hmax", f"max(high) OVER {f}")
    s.stage("lmin", f"min(low) OVER {f}")
    s.stage("hs", f"list_reverse(list(high) OVER {f})")
    s.stage("ls", f"list_reverse(list(low) OVER {f})")
    del since
    return {"aroon_osc_25": "CASE WHEN len(hs) = 26 THEN ((list_position(ls, lmin) - 1) - (list_position(hs, hmax) - 1)) / 25.0 END"}


def _ichimoku(s: Sql) -> dict[str, str]:
    a, t, k, q = _atr(s, 14), _mid(s, 9), _mid(s, 26), _mid(s, 52)
    s.stage("sa", f"lag(({t} + {k}) / 2, 26) OVER w")
    s.stage("sb", f"lag({q}, 26) OVER w")
    cloud = ("CASE WHEN sa IS NULL OR sb IS NULL THEN NULL WHEN close > greatest(sa, sb) THEN close - greatest(sa, sb) "
             "WHEN close < least(sa, sb) THEN close - least(sa, sb) ELSE 0 END")
    return {"ichimoku_tenkan_dist": f"(close - {t}) / {a}", "ichimoku_kijun_dist": f"(close - {k}) / {a}",
            "ichimoku_tk_diff": f"({t} - {k}) / {a}", "ichimoku_cloud_dist": f"({cloud}) / {a}"}


def _rsi(s: Sql) -> dict[str, str]:
    s.stage("dc", "close - lag(close) OVER w")
    s.stage("up", "CASE WHEN dc IS NOT NULL THEN greatest(dc, 0) END")
    s.stage("dn", "CASE WHEN dc IS NOT NULL THEN greatest(-dc, 0) END")
    out = {}
    for n in (2, 6, 14):
        g = s.stage(f"g{n}", s.ema("up", f"(1.0/{n})", n))
        lo = s.stage(f"l{n}", s.ema("dn", f"(1.0/{n})", n))
        out[f"rsi_{n}"] = f"2 * {g} / nullif({g} + {lo}, 0) - 1"
    return out


def _tsi(s: Sql) -> dict[str, str]:
    s.stage("dc", "close - lag(close) OVER w")
    s.stage("ad", "abs(dc)")
    s.stage("e1", s.ema("dc", ALPHA(25), 25))
    s.stage("e2", s.ema("ad", ALPHA(25), 25))
    s.stage("f1", s.ema("e1", ALPHA(13), 13))
    s.stage("f2", s.ema("e2", ALPHA(13), 13))
    return {"tsi_25_13": "f1 / nullif(f2, 0)"}


def _uo(s: Sql) -> dict[str, str]:
    s.stage("pc", "lag(close) OVER w")
    s.stage("lo", "least(low, pc)")
    s.stage("hi", "greatest(high, pc)")
    s.stage("bp", "close - lo")
    s.stage("trr", "hi - lo")
    a = {n: f"({s.total('bp', n)}) / nullif({s.total('trr', n)}, 0)" for n in (7, 14, 28)}
    return {"ultimate_osc": f"2 * (4 * ({a[7]}) + 2 * ({a[14]}) + ({a[28]})) / 7 - 1"}


def _cci(s: Sql) -> dict[str, str]:
    s.stage("tp", "(high + low + close) / 3")
    s.stage("tm", s.mean("tp", 20))
    s.stage("tl", f"list(tp) OVER {s.fr(20)}")
    mad = "list_avg(list_transform(tl, lambda e: abs(e - tm)))"
    return {"cci_20": f"(tp - tm) / nullif(0.015 * {mad}, 0) / 100"}


def _boll(s: Sql) -> dict[str, str]:
    s.stage("m20", s.mean("close", 20))
    s.stage("sd20", s.roll("stddev_pop", "close", 20))
    s.stage("bw", "4 * sd20 / m20")
    return {"bb_pctb_20_2": "(close - (m20 - 2 * sd20)) / nullif(4 * sd20, 0)", "bb_width_20_2": "bw",
            "bb_width_rel_20": f"bw / nullif({s.mean('bw', DAY)}, 0)"}


def _ranges(s: Sql) -> dict[str, str]:
    s.stage("hl", "(ln(high) - ln(low)) ** 2")
    s.stage("gk", "0.5 * hl - (2 * ln(2) - 1) * (lc - ln(open)) ** 2")
    out = {}
    for n in (15, 60):
        out[f"parkinson_{n}"] = f"sqrt(({s.mean('hl', n)}) / (4 * ln(2)))"
        m = s.mean("gk", n)
        out[f"garman_klass_{n}"] = f"CASE WHEN ({m}) IS NOT NULL THEN sqrt(greatest({m}, 0)) END"
    return out


def _jump(s: Sql) -> dict[str, str]:
    s.stage("bp2", "abs(r1) * lag(abs(r1)) OVER w")
    s.stage("rvs", s.total("r1*r1", 240))
    s.stage("bvs", f"({s.total('bp2', 240)}) * pi() / 2")
    return {"jump_ratio_240": "CASE WHEN bvs IS NOT NULL THEN greatest(rvs - bvs, 0) / nullif(rvs, 0) END"}


def _retv(k: int) -> str:
    return f"(lc - lag(lc, {k}) OVER w) / nullif(sg * sqrt({k}), 0)"


def _obv(s: Sql) -> dict[str, str]:
    s.stage("sv", "sign(close - lag(close) OVER w) * volume")
    s.stage("obv", "CASE WHEN sv IS NOT NULL THEN sum(sv) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) END")
    out = {"obv_z_240": s.z("obv", 240)}
    for n in (15, 60):
        out[f"obv_slope_{n}"] = f"({s.total('sv', n)}) / nullif({s.total('volume', n)}, 0)"
    return out


def _vwap(s: Sql) -> dict[str, str]:
    day = "(PARTITION BY symbol, t // 86400 ORDER BY t ROWS UNBOUNDED PRECEDING)"
    s.stage("vs", f"sum(quote_volume) OVER {day} / nullif(sum(volume) OVER {day}, 0)")
    out = {"vwap_dev_session": "(lc - ln(vs)) / nullif(sg, 0)"}
    for n in (60, 240):
        out[f"vwap_dev_{n}"] = f"(lc - ln(({s.total('quote_volume', n)}) / nullif({s.total('volume', n)}, 0))) / nullif(sg, 0)"
    return out


def _mfi(s: Sql) -> dict[str, str]:
    s.stage("tp", "(high + low + close) / 3")
    s.stage("mv", "tp - lag(tp) OVER w")
    s.stage("pf", "CASE WHEN mv > 0 THEN tp * volume ELSE 0 END")
    s.stage("nf", "CASE WHEN mv < 0 THEN tp * volume ELSE 0 END")
    p, q = s.stage("p14", s.total("pf", 14)), s.stage("q14", s.total("nf", 14))
    return {"mfi_14": f"2 * {p} / nullif({p} + {q}, 0) - 1"}


def _cmf(s: Sql) -> dict[str, str]:
    _clv(s)
    s.stage("cv", "clv0 * volume")
    return {"cmf_20": f"({s.total('cv', 20)}) / nullif({s.total('volume', 20)}, 0)"}


def _force(s: Sql) -> dict[str, str]:
    s.stage("rv_", "r1 * volume")
    a = s.stage("fa", s.ema("rv_", "(2.0/14)", 13))
    b = s.stage("fb", s.ema("volume", "(2.0/14)", 13))
    return {"force_index_13": f"{a} / nullif({b} * sg, 0)"}


def _tod(s: Sql) -> dict[str, str]:
    f = "(PARTITION BY symbol, t % 86400 ORDER BY t RANGE BETWEEN 604800 PRECEDING AND 86400 PRECEDING)"
    return {"rel_volume_tod": f"volume / nullif(CASE WHEN count(volume) OVER {f} >= 2 THEN avg(volume) OVER {f} END, 0)"}


def _cumz(s: Sql) -> dict[str, str]:
    _clv(s)
    s.stage("x1", "clv0 * volume")
    s.stage("x2", "volume * (close / lag(close) OVER w - 1)")
    run = "OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING)"
    s.stage("y1", f"sum(x1) {run}")
    s.stage("y2", f"CASE WHEN x2 IS NOT NULL THEN sum(x2) {run} END")
    return {"adl_z_240": s.z("y1", 240), "vpt_z_240": s.z("y2", 240)}


def _eom(s: Sql) -> dict[str, str]:
    s.stage("md", "(high + low) / 2")
    s.stage("rr", "(high - low) / md")
    s.stage("vr", f"volume / nullif({s.mean('volume', 60)}, 0)")
    s.stage("em", "CASE WHEN rr = 0 THEN 0 ELSE (ln(md) - lag(ln(md)) OVER w) * rr / nullif(vr, 0) END")
    return {"eom_14": f"({s.mean('em', 14)}) / nullif(sg * sg, 0)"}


def _imb(s: Sql, k: int) -> str:
    return s.stage(f"im{k}", f"2 * ({s.total('taker_buy_volume', k)}) / nullif({s.total('volume', k)}, 0) - 1")


def _cvd(s: Sql) -> dict[str, str]:
    s.stage("cv", "sum(2 * taker_buy_volume - volume) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING)")
    return {f"cvd_z_{n}": s.z("cv", n) for n in (60, 240)}


def _tick(s: Sql) -> dict[str, str]:
    s.stage("ds", "nullif(sign(close - lag(close) OVER w), 0)")
    s.stage("hs", "last_value(ds IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING)")
    s.stage("hv", "hs * volume")
    return {f"tick_imb_{n}": f"({s.total('hv', n)}) / nullif({s.total('volume', n)}, 0)" for n in (15, 60)}


def _candle(s: Sql) -> dict[str, str]:
    _clv(s)
    flat = lambda e: f"CASE WHEN high = low THEN 0.0 ELSE ({e}) / (high - low) END"
    return {"clv": "clv0", "clv_15": s.mean("clv0", 15), "body_ratio": flat("close - open"),
            "upper_wick": flat("high - greatest(open, close)"), "lower_wick": flat("least(open, close) - low")}


def _amihud(s: Sql) -> dict[str, str]:
    s.stage("am", f"ln(nullif(({s.total('abs(r1)', 60)}) / nullif({s.total('quote_volume', 60)}, 0), 0))")
    return {"amihud_60": "am", "amihud_rel_60": f"am - ({s.mean('am', DAY)})"}


def _pairs(s: Sql, x: str, y: str, n: int, fn: str) -> str:
    f = s.fr(n)
    return f"CASE WHEN count({x} + {y}) OVER {f} = {n} THEN {fn}({x}, {y}) OVER {f} END"


def _roll(s: Sql) -> dict[str, str]:
    s.stage("rl", "lag(r1) OVER w")
    out = {}
    for n in (60, 240):
        c = s.stage(f"cov{n}", _pairs(s, "r1", "rl", n, "covar_samp"))
        out[f"roll_spread_{n}"] = f"CASE WHEN {c} IS NOT NULL THEN 2 * sqrt(greatest(-{c}, 0)) END"
    return out


def _acf(s: Sql) -> dict[str, str]:
    s.stage("rl", "lag(r1) OVER w")
    return {f"acf1_{n}": _pairs(s, "r1", "rl", n, "corr") for n in (60, 240)}


def _cs(s: Sql) -> dict[str, str]:
    s.stage("hl", "(ln(high) - ln(low)) ** 2")
    s.stage("be", "hl + lag(hl) OVER w")
    s.stage("ga", "(greatest(ln(high), lag(ln(high)) OVER w) - least(ln(low), lag(ln(low)) OVER w)) ** 2")
    s.stage("al", "(sqrt(2 * be) - sqrt(be)) / (3 - 2 * sqrt(2)) - sqrt(ga / (3 - 2 * sqrt(2)))")
    s.stage("sp", "CASE WHEN be IS NOT NULL THEN greatest(2 * (exp(al) - 1) / (1 + exp(al)), 0) END")
    return {"cs_spread_60": s.mean("sp", 60)}


def _vr(s: Sql) -> dict[str, str]:
    s.stage("r5", "lc - lag(lc, 5) OVER w")
    return {"vr_5_240": f"({s.roll('var_samp', 'r5', 240)}) / nullif(5 * ({s.roll('var_samp', 'r1', 240)}), 0)"}


def _shape(s: Sql) -> dict[str, str]:
    out = {}
    for n in (60, 240):
        out[f"skew_{n}"] = s.roll("skewness", "r1", n)
        out[f"kurt_{n}"] = s.roll("kurtosis", "r1", n)
    return out


def _clock(s: Sql) -> dict[str, str]:
    s.stage("mi", "(t % 86400) // 60")
    s.stage("dw", "isodow(to_timestamp(t)::TIMESTAMP) - 1")
    tau = 2 * math.pi
    return {"hour_sin": f"sin({tau} * mi / 1440)", "hour_cos": f"cos({tau} * mi / 1440)",
            "dow_sin": f"sin({tau} * (dw + mi / 1440) / 7)", "dow_cos": f"cos({tau} * (dw + mi / 1440) / 7)"}


def _sessions(s: Sql) -> dict[str, str]:
    # offsets in force in January 2024: Tokyo +9 h, London 0, New York -5 h
    def inside(shift, a, b):
        m = f"(((t + {shift * 3600}) % 86400) // 60)"
        d = f"isodow(to_timestamp(t + {shift * 3600})::TIMESTAMP)"
        return f"CASE WHEN {m} >= {a} AND {m} < {b} AND {d} <= 5 THEN 1.0 ELSE 0.0 END"
    return {"is_weekend": "CASE WHEN isodow(to_timestamp(t)::TIMESTAMP) >= 6 THEN 1.0 ELSE 0.0 END",
            "session_asia": inside(9, 540, 900), "session_europe": inside(0, 480, 990),
            "session_us": inside(-5, 570, 960), "us_open_window": inside(-5, 540, 600)}


def _dayopen(s: Sql) -> dict[str, str]:
    day = "(PARTITION BY symbol, t // 86400 ORDER BY t ROWS UNBOUNDED PRECEDING)"
    s.stage("do_", f"lc - ln(first_value(open) OVER {day})")
    s.stage("nb", f"count(*) OVER {day}")
    return {"ret_since_day_open": "do_", "ret_since_day_open_vol": "do_ / nullif(sg * sqrt(nb), 0)"}


def _bench(s: Sql) -> dict[str, str]:
    s.stage("lb", "ln(bench_close)")
    out = {f"bench_ret_{k}": f"lb - lag(lb, {k}) OVER w" for k in (1, 5, 15)}
    out |= {f"rel_ret_{k}": f"(lc - lag(lc, {k}) OVER w) - (lb - lag(lb, {k}) OVER w)" for k in (5, 15, 60)}
    return out


def _beta(s: Sql) -> dict[str, str]:
    s.stage("lb", "ln(bench_close)")
    s.stage("rb", "lb - lag(lb) OVER w")
    s.stage("co", _pairs(s, "r1", "rb", 240, "covar_samp"))
    s.stage("beta", f"co / nullif({s.roll('var_samp', 'rb', 240)}, 0)")
    return {"beta_bench_240": "beta", "corr_bench_240": _pairs(s, "r1", "rb", 240, "corr"),
            "resid_ret_15": "(lc - lag(lc, 15) OVER w) - beta * (lb - lag(lb, 15) OVER w)"}


def _funding(s: Sql) -> dict[str, str]:
    return {"funding_rate_bp": "funding_rate * 10000", "funding_rate_z_30d": s.z("funding_rate", 300, DAY)}


def _oi(s: Sql) -> dict[str, str]:
    ch = lambda k: f"100 * (open_interest / nullif(lag(open_interest, {k}) OVER w, 0) - 1)"
    out = {f"oi_chg_{k}": ch(k) for k in (5, 15, 60)}
    out["oi_z_1440"] = s.z("open_interest", 20)
    out |= {f"oi_x_ret_{k}": f"({ch(k)}) * {_retv(k)}" for k in (15, 60)}
    return out


def _ratios(s: Sql) -> dict[str, str]:
    out = {}
    for c in ("ls_ratio_top", "ls_ratio_accounts", "taker_ls_ratio"):
        x = s.stage(f"ln_{c}", f"ln({c})")
        out[f"{c}_log"] = x
        out[f"{c}_z_1440"] = s.z(x, 20)
    return out


LINES = {
    "I01_sma_dist": lambda s: {f"sma_dist_{n}": f"(lc - ln({s.mean('close', n)})) / nullif(sg, 0)" for n in (5, 15, 30, 60, 240)},
    "I02_ema_dist": lambda s: {f"ema_dist_{n}": f"(lc - ln({_ema_close(s, n)})) / nullif(sg, 0)" for n in (5, 15, 30, 60, 240)},
    "I03_lin_slope": lambda s: {f"lin_slope_{n}": f"({s.roll('sum', 'lc', n).replace('sum(lc)', 'regr_slope(lc, rn)')}) * sqrt({n}) / nullif(sg, 0)"
                                for n in (15, 60, 240) if s.stage("rn", "row_number() OVER w")},
    "I04_macd": _macd,
    "I05_directional_movement": _dmi,
    "I06_aroon": _aroon,
    "I07_ema_gap": lambda s: {f"ema_gap_{f}_{g}": f"({_ema_close(s, f)} - {_ema_close(s, g)}) / nullif(close * sg, 0)"
                              for f, g in ((5, 20), (15, 60), (60, 240))},
    "I08_efficiency_ratio": lambda s: {f"efficiency_ratio_{n}": f"abs(close - lag(close, {n}) OVER w) / nullif({s.total('ad', n)}, 0)"
                                       for n in (10, 30) if s.stage("ad", "abs(close - lag(close) OVER w)")},
    "I09_ichimoku": _ichimoku,
    "I11_returns": lambda s: {f"ret_{k}": f"lc - lag(lc, {k}) OVER w" for k in (1, 5, 10, 15, 30, 60, 240)},
    "I12_scaled_returns": lambda s: {f"ret_vol_{k}": _retv(k) for k in (1, 5, 10, 15, 30, 60, 240)},
    "I13_skip_returns": lambda s: {f"ret_skip_{k}": f"(lag(lc) OVER w - lag(lc, {k}) OVER w) / nullif(sg * sqrt({k - 1}), 0)" for k in (5, 15, 60)},
    "I14_rsi": _rsi,
    "I15_stochastic": lambda s: {k: v for n in (14, 5) for k, v in (
        (f"stoch_k_{n}", f"2 * {_stoch(s, n)} - 1"), (f"stoch_d_{n}_3", f"2 * ({s.mean(f'k{n}', 3)}) - 1"))},
    "I16_williams_r": lambda s: {"williams_r_14": f"{_stoch(s, 14)} - 1"},
    "I17_cci": _cci,
    "I18_tsi": _tsi,
    "I19_ultimate_oscillator": _uo,
    "I20_momentum_z": lambda s: {f"mom_z_{k}": s.z(s.stage(f"rk{k}", f"lc - lag(lc, {k}) OVER w"), DAY) for k in (15, 60)},
    "I21_atr_pct": lambda s: {"atr_pct_14": f"{_atr(s, 14)} / close"},
    "I22_bollinger": _boll,
    "I23_keltner": lambda s: {"keltner_pos_20": f"(close - {_ema_close(s, 20)}) / (2 * {_atr(s, 10)})"},
    "I24_donchian": lambda s: {f"donchian_pos_{n}": f"{_stoch(s, n)} - 0.5" for n in (20, 60)},
    "I25_realised_vol": lambda s: {f"rv_{n}": s.rv(n) for n in (15, 60, 240)},
    "I26_range_vol": _ranges,
    "I27_vol_ratio": lambda s: {"rv_ratio_15_240": f"({s.rv(15)}) / nullif({s.rv(240)}, 0)", "rv_ratio_60_1440": f"sg / nullif({s.rv(DAY)}, 0)"},
    "I28_range_atr": lambda s: {"range_atr_14": f"(high - low) / {_atr(s, 14)}"},
    "I29_jump_ratio": _jump,
    "I30_return_x_vol_ratio": lambda s: {"ret15_x_rv_ratio": f"({_retv(15)}) * sg / nullif({s.rv(DAY)}, 0)"},
    "I31_obv": _obv,
    "I32_vwap_deviation": _vwap,
    "I33_money_flow": _mfi,
    "I34_chaikin_flow": _cmf,
    "I35_force_index": _force,
    "I36_relative_volume": lambda s: {"rel_volume_60": f"volume / nullif({s.mean('volume', 60)}, 0)", "rel_volume_1440": f"volume / nullif({s.mean('volume', DAY)}, 0)"},
    "I37_volume_profile": _tod,
    "I38_cumulative_z": _cumz,
    "I39_ease_of_movement": _eom,
    "I40_taker_imbalance": lambda s: {f"taker_imb_{k}": _imb(s, k) for k in (1, 5, 15, 60)},
    "I41_taker_imbalance_z": lambda s: {"taker_imb_z_15": s.z(_imb(s, 15), DAY)},
    "I42_cvd_z": _cvd,
    "I43_trade_counts": lambda s: {"trades_rel_60": f"trades / nullif({s.mean('trades', 60)}, 0)",
                                   "avg_trade_size_rel_60": f"(volume / nullif(trades, 0)) / (({s.total('volume', 60)}) / nullif({s.total('trades', 60)}, 0))"},
    "I44_tick_imbalance": _tick,
    "I45_return_x_taker": lambda s: {"ret15_x_taker_abs15": f"({_retv(15)}) * abs({_imb(s, 15)})"},
    "I46_candle_geometry": _candle,
    "I47_amihud": _amihud,
    "I48_roll_spread": _roll,
    "I49_corwin_schultz": _cs,
    "I50_zero_return_share": lambda s: {"zero_ret_frac_60": s.mean("CASE WHEN r1 IS NOT NULL THEN (r1 = 0)::INT END", 60)},
    "I51_price_zscore": lambda s: {f"zscore_{n}": s.z("close", n) for n in (20, 60, 240)},
    "I52_autocorrelation": _acf,
    "I53_variance_ratio": _vr,
    "I54_skew_kurtosis": _shape,
    "I55_clock_encoding": _clock,
    "I56_sessions": _sessions,
    "I57_funding_clock": lambda s: {"min_since_funding": "((t % 86400) // 60) % 480", "min_to_funding": "480 - ((t % 86400) // 60) % 480"},
    "I58_day_open_return": _dayopen,
    "I59_return_x_weekend": lambda s: {"ret15_x_weekend": f"({_retv(15)}) * CASE WHEN isodow(to_timestamp(t)::TIMESTAMP) >= 6 THEN 1 ELSE 0 END"},
    "I60_benchmark_returns": (_bench, views.bars_with_bench, "mbars", views.BENCH_SQL),
    "I61_benchmark_beta": (_beta, views.bars_with_bench, "mbars", views.BENCH_SQL),
    "I62_funding": (_funding, views.bars_with_derivs, "dbars", views.DERIVS_SQL),
    "I63_open_interest": (_oi, views.bars_with_derivs, "dbars", views.DERIVS_SQL),
    "I64_long_short_ratios": (_ratios, views.bars_with_derivs, "dbars", views.DERIVS_SQL),
}

SHORT_DERIVED = {"I63_open_interest": {1440: 20, 43200: 300}, "I64_long_short_ratios": {1440: 20, 43200: 300}}


def _queries() -> dict[str, Query]:
    out = {}
    for key, line in LINES.items():
        if isinstance(line, tuple):
            build, source, name, cte = line
            names, sql = _plain(build, source=name, ctes=(cte,))
        else:
            source = views.bars
            names, sql = _plain(line)
        out[key] = Query(_spark_with(names, source, SHORT_DERIVED.get(key, LENGTHS)), sql)
    out["I10_supertrend"] = Query(_spark(["supertrend_dist", "supertrend_dir"], views.bars))
    return out


def _spark_with(names, source, lengths):
    def run(spark, d):
        out = compute_indicators(source(spark, d), names, lengths=lengths, keep=["symbol", "t"])
        return out.select("symbol", F.col("t").cast("long").alias("t"), *[ndigits(F.col(n)).alias(n) for n in names])
    return run


QUERIES = _queries()
