"""The 167 causal bar indicators as window columns over row tiles.

Every indicator is dimensionless, uses only the current and earlier bars, and is NULL until its window is full.
``compute_indicators`` builds only the columns that are asked for, in one shuffle of the bars.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.functions.numeric import finite, ln
from tapeloom.operators import tiling
from tapeloom.operators.carry import since_event
from tapeloom.operators.layers import Layers, Node, ema_reach
from tapeloom.operators.ratchet import supertrend

SIGMA, DAY, MONTH, MONTH_LEAST, QUARTER_DAY = 60, 1440, 43200, 1440, 240
FUNDING_MINUTES = 480
PROFILE_DAYS, PROFILE_LEAST = 7, 2

# Name parameters of the published catalogue.
TREND, MOMENTUM, VOLATILITY, VOLUME, FLOW = "tendance", "momentum", "volatilite", "volume", "flux"
MICRO, STATS, CALENDAR, MARKET, DERIVED = "microstructure", "statistique", "calendrier", "marche", "derives"
FAMILIES = (TREND, MOMENTUM, VOLATILITY, VOLUME, FLOW, MICRO, STATS, CALENDAR, MARKET, DERIVED)


@dataclass(frozen=True)
class Spec:
    name: str
    family: str
    make: Callable[["Bars"], Node] = field(repr=False)
    needs: tuple[str, ...] = ()


class Bars:
    """Shared series of one bar table, every one computed once."""

    def __init__(self, layers: Layers, columns: Sequence[str], lengths: Mapping[int, int] | None = None):
        self.l, self.columns, self.lengths = layers, set(columns), dict(lengths or {})

    def n(self, length: int) -> int:
        return self.lengths.get(length, length)

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        return self.l.source(name)

    # returns and scale
    @property
    def logc(self): return self.l.let("logc", lambda: Node.apply(ln, self.close))
    @property
    def r1(self): return self.l.let("r1", lambda: self.logc - self.l.lag("logc", self.logc, 1))
    @property
    def r1sq(self): return self.l.let("r1sq", lambda: self.r1 * self.r1)

    def ret(self, k): return self.l.let(f"ret{k}", lambda: self.logc - self.l.lag("logc", self.logc, k))

    def rv(self, n):
        return self.l.let(f"rv{n}", lambda: Node.apply(_null_safe_sqrt, self.l.mean("r1sq", self.r1sq, n)))

    @property
    def sigma(self): return self.rv(self.n(SIGMA))

    def ret_vol(self, k): return self.ret(k) / (self.sigma * math.sqrt(k))
    def sma(self, n): return self.l.mean("close", self.close, n)
    def ema(self, n): return self.l.ema("close", self.close, 2.0 / (n + 1), n)

    # ranges
    def hh(self, n): return self.l.high("high", self.high, n)
    def ll(self, n): return self.l.low("low", self.low, n)
    def mid_range(self, n): return self.l.let(f"midrange{n}", lambda: (self.hh(n) + self.ll(n)) * 0.5)
    @property
    def typical(self): return self.l.let("typical", lambda: (self.high + self.low + self.close) / 3.0)
    @property
    def prev_close(self): return self.l.lag("close", self.close, 1)
    @property
    def dclose(self): return self.l.let("dclose", lambda: self.close - self.prev_close)

    @property
    def true_range(self):
        return self.l.let("tr", lambda: Node.apply(
            lambda h, lo, pc: F.greatest(h - lo, F.abs(h - pc), F.abs(lo - pc)), self.high, self.low, self.prev_close))

    def wilder(self, name, x, n, gaps=False): return self.l.ema(name, x, 1.0 / n, n, gaps)
    def atr(self, n): return self.wilder("tr", self.true_range, n)
    @property
    def span(self): return self.high - self.low

    def range_ratio(self, num):
        return Node.apply(lambda a, r: F.when(r == 0, F.lit(0.0)).otherwise(finite(F.try_divide(a, r))), num, self.span)

    @property
    def clv(self):
        return self.l.let("clv", lambda: self.range_ratio((self.close - self.low) - (self.high - self.close)))

    def stoch(self, n):
        return self.l.let(f"stoch{n}", lambda: (self.close - self.ll(n)) / (self.hh(n) - self.ll(n)))

    # volume
    @property
    def quote(self):
        def make():
            estimate = self.typical * self.volume
            if "quote_volume" not in self.columns:
                return estimate
            return Node.apply(F.coalesce, self.quote_volume, estimate)
        return self.l.let("quote", make)

    @property
    def signed(self):
        return self.l.let("signed", lambda: Node.apply(lambda d, v: F.signum(d) * v, self.dclose, self.volume))

    def sum_volume(self, n): return self.l.total("volume", self.volume, n)

    def imbalance(self, k):
        if k == 1:
            return 2.0 * (self.taker_buy_volume / self.volume) - 1.0
        return self.l.let(f"imb{k}", lambda: 2.0 * (
            self.l.total("taker_buy_volume", self.taker_buy_volume, k) / self.sum_volume(k)) - 1.0)

    # sessions
    def since_session(self, name, x):
        """Cumulative sum of x since the first bar of the session (see ``carried``)."""
        return Node.apply(lambda s, v: F.when(v.isNotNull(), s), self.l.source(f"_session_{name}"), x)

    @property
    def session_open(self): return self.l.source("_session_open")

    @property
    def session_bars(self): return self.l.source(tiling.ROW) - self.l.source("_session_row") + 1

    # benchmark
    @property
    def logb(self): return self.l.let("logb", lambda: Node.apply(ln, self.bench_close))
    def bench_ret(self, k): return self.l.let(f"bret{k}", lambda: self.logb - self.l.lag("logb", self.logb, k))

    def bench_fit(self, n):
        cov, vx, vy = self.l.comoment("rb", self.r1, self.bench_ret(1), n)
        return (self.l.let(f"beta{n}", lambda: cov / vy),
                Node.apply(lambda c, a, b: F.try_divide(c, F.sqrt(a) * F.sqrt(b)), cov, vx, vy))

    def oi_change(self, k):
        return 100.0 * (self.open_interest / self.l.lag("open_interest", self.open_interest, k) - 1.0)

    def log_of(self, col): return self.l.let(f"ln.{col}", lambda: Node.apply(ln, self.l.source(col)))


def _null_safe_sqrt(m: Column) -> Column:
    return F.when(m.isNotNull(), F.sqrt(F.greatest(m, F.lit(0.0))))


# -- single formulas that do not fit on one line ----------------------------------------------------------------------


def _lin_slope(b: Bars, n: int) -> Node:
    """Least-squares slope of ln close on the bar number; frame sums keep the position small."""
    k = b.n(n)
    frame = b.l.rows(k)
    row = b.l.source(tiling.ROW)
    centred = b.l._centred("logc", b.logc)
    slope = b.l.let(f"slope{k}", lambda: Node.apply(
        lambda y, r: F.when(F.count(y).over(frame) == k,
                            F.regr_slope(y, r.cast("double")).over(frame)), centred, row))
    return (slope * math.sqrt(k)) / b.sigma


def _macd(b: Bars, f: int, s: int, g: int, part: str) -> Node:
    line = b.l.let(f"macd{f}_{s}", lambda: b.ema(f) - b.ema(s))
    if part == "line":
        value = line
    else:
        signal = b.l.ema(f"macd{f}_{s}", line, 2.0 / (g + 1), g)
        value = signal if part == "signal" else line - signal
    return value / (b.close * b.sigma)


def _di(b: Bars, n: int) -> tuple[Node, Node]:
    up = b.l.let("dm.up", lambda: b.high - b.l.lag("high", b.high, 1))
    down = b.l.let("dm.down", lambda: b.l.lag("low", b.low, 1) - b.low)
    keep = lambda a, o: F.when((a > o) & (a > 0), a).otherwise(0.0)
    plus = b.l.let("dm.plus", lambda: Node.apply(keep, up, down))
    minus = b.l.let("dm.minus", lambda: Node.apply(keep, down, up))
    atr = b.atr(n)
    return (b.l.let(f"pdi{n}", lambda: b.wilder("dm.plus", plus, n) / atr),
            b.l.let(f"mdi{n}", lambda: b.wilder("dm.minus", minus, n) / atr))


def _adx(b: Bars, n: int) -> Node:
    p, m = _di(b, n)
    dx = b.l.let(f"dx{n}", lambda: Node.apply(F.abs, p - m) / (p + m))
    return b.wilder(f"dx{n}", dx, n, gaps=True)


def _aroon(b: Bars, n: int) -> Node:
    frame, row = b.l.rows(n + 1), b.l.source(tiling.ROW)
    since = lambda tag, x: b.l.let(f"since.{tag}{n}", lambda: Node.apply(
        lambda v, r: F.when(F.count(v).over(frame) == n + 1,
                            r - F.max_by(r, F.struct(v, r)).over(frame)), x, row))
    return (since("low", -b.low) - since("high", b.high)) * (1.0 / n)


def _cloud(b: Bars) -> Node:
    tenkan, kijun, senkou, shift = 9, 26, 52, 26
    a0 = b.l.let("spana", lambda: (b.mid_range(tenkan) + b.mid_range(kijun)) * 0.5)
    a = b.l.lag("spana", a0, shift)
    c = b.l.lag(f"midrange{senkou}", b.mid_range(senkou), shift)

    def gap(close, x, y):
        both = x.isNotNull() & y.isNotNull() & close.isNotNull()
        return F.when(both & (close > F.greatest(x, y)), close - F.greatest(x, y)).when(
            both & (close < F.least(x, y)), close - F.least(x, y)).when(both, F.lit(0.0))

    return Node.apply(gap, b.close, a, c) / b.atr(14)


def _rsi(b: Bars, n: int) -> Node:
    up = b.l.let("gain", lambda: Node.apply(lambda d: F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), b.dclose))
    dn = b.l.let("loss", lambda: Node.apply(lambda d: F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))), b.dclose))
    gain, loss = b.wilder("gain", up, n), b.wilder("loss", dn, n)
    return 2.0 * (gain / (gain + loss)) - 1.0


def _cci(b: Bars, n: int) -> Node:
    tp, mean = b.typical, b.l.mean("typical", b.typical, n)
    lags = [tp] + [b.l.lag("typical", tp, k) for k in range(1, n)]
    mad = Node.apply(lambda m, *xs: sum((F.abs(x - m) for x in xs[1:]), F.abs(xs[0] - m)) / F.lit(float(n)), mean, *lags)
    return ((tp - mean) / (0.015 * mad)) * 0.01


def _tsi(b: Bars, r: int, s: int) -> Node:
    twice = lambda tag, x: b.l.ema(f"tsi.{tag}", b.l.ema(tag, x, 2.0 / (r + 1), r), 2.0 / (s + 1), s)
    size = b.l.let("absdclose", lambda: Node.apply(F.abs, b.dclose))
    return twice("dclose", b.dclose) / twice("absdclose", size)


def _ultimate(b: Bars) -> Node:
    floor = Node.apply(F.least, b.low, b.prev_close)
    roof = Node.apply(F.greatest, b.high, b.prev_close)
    pressure = b.l.let("uo.bp", lambda: b.close - floor)
    reach = b.l.let("uo.tr", lambda: roof - floor)
    share = lambda n: b.l.total("uo.bp", pressure, n) / b.l.total("uo.tr", reach, n)
    return 2.0 * ((4.0 * share(7) + 2.0 * share(14) + share(28)) * (1.0 / 7.0)) - 1.0


def _bollinger(b: Bars, n: int, k: float) -> tuple[Node, Node]:
    dev, sd, _ = b.l.moments("close", b.close, n, 0)
    return (dev + k * sd) / (2.0 * k * sd), b.l.let(f"bbw{n}", lambda: (2.0 * k * sd) / b.sma(n))


def _bb_width_rel(b: Bars, n: int) -> Node:
    w = _bollinger(b, n, 2.0)[1]
    return w / b.l.mean(f"bbw{n}", w, b.n(DAY))


def _hl2(b: Bars) -> Node:
    return b.l.let("hl2", lambda: Node.apply(lambda h, lo: F.pow(ln(h) - ln(lo), F.lit(2.0)), b.high, b.low))


def _parkinson(b: Bars, n: int) -> Node:
    return Node.apply(lambda m: _null_safe_sqrt(m / (4.0 * math.log(2.0))), b.l.mean("hl2", _hl2(b), n))


def _garman_klass(b: Bars, n: int) -> Node:
    term = b.l.let("gkterm", lambda: Node.apply(
        lambda hl, c, o: 0.5 * hl - (2.0 * math.log(2.0) - 1.0) * F.pow(c - ln(o), F.lit(2.0)),
        _hl2(b), b.logc, b.open))
    return Node.apply(_null_safe_sqrt, b.l.mean("gkterm", term, n))


def _jump(b: Bars, n: int) -> Node:
    k = b.n(n)
    size = b.l.let("absr1", lambda: Node.apply(F.abs, b.r1))
    pair = b.l.let("bipower", lambda: size * b.l.lag("absr1", size, 1))
    rv = b.l.total("r1sq", b.r1sq, k)
    bv = b.l.total("bipower", pair, k) * (math.pi / 2.0)
    return Node.apply(lambda a, c: F.when(a.isNotNull() & c.isNotNull(), F.greatest(a - c, F.lit(0.0))), rv, bv) / rv


def _mfi(b: Bars, n: int) -> Node:
    move = b.l.let("dtypical", lambda: b.typical - b.l.lag("typical", b.typical, 1))
    flow = b.typical * b.volume
    # where the typical price has no predecessor the flow counts as zero, but a missing flow stays missing only on a move
    side = lambda keep: (lambda f, m: F.when(keep(m), f).otherwise(F.lit(0.0)))
    pos = b.l.let("mf.pos", lambda: Node.apply(side(lambda m: m > 0), flow, move))
    neg = b.l.let("mf.neg", lambda: Node.apply(side(lambda m: m < 0), flow, move))
    p, q = b.l.total("mf.pos", pos, n), b.l.total("mf.neg", neg, n)
    return 2.0 * (p / (p + q)) - 1.0


def _rel(b: Bars, col: str, n: int) -> Node:
    x = b.l.source(col)
    return x / b.l.mean(col, x, n)


def _cum_z(b: Bars, name: str, x: Node, n: int) -> Node:
    cum = b.l.running_total(name, x)
    return b.l.zscore(f"{name}.cum", cum, n)


def _eom(b: Bars, n: int) -> Node:
    mid = b.l.let("hlmid", lambda: (b.high + b.low) * 0.5)
    logmid = b.l.let("loghlmid", lambda: Node.apply(ln, mid))
    rel = b.span / mid
    step = (b.l.diff("loghlmid", logmid) * rel) / _rel(b, "volume", b.n(SIGMA))
    emv = b.l.let("emv", lambda: Node.apply(lambda r, s: F.when(r == 0, F.lit(0.0)).otherwise(s), rel, step))
    return b.l.mean("emv", emv, n) / (b.sigma * b.sigma)


def _tick_imb(b: Bars, n: int) -> Node:
    signed = b.l.let("ticksigned", lambda: b.l.source("_tick_sign") * b.volume)
    return b.l.total("ticksigned", signed, n) / b.sum_volume(n)


def _amihud(b: Bars, n: int) -> Node:
    size = b.l.let("absr1", lambda: Node.apply(F.abs, b.r1))
    return b.l.let(f"amihud{n}", lambda: Node.apply(ln, b.l.total("absr1", size, n) / b.l.total("quote", b.quote, n)))


def _roll(b: Bars, n: int) -> Node:
    cov, _, _ = b.l.comoment("rlag", b.r1, b.l.lag("r1", b.r1, 1), n)
    return Node.apply(lambda c: F.when(c.isNotNull(), 2.0 * F.sqrt(F.greatest(-c, F.lit(0.0)))), cov)


def _acf(b: Bars, n: int) -> Node:
    cov, vx, vy = b.l.comoment("rlag", b.r1, b.l.lag("r1", b.r1, 1), n)
    return Node.apply(lambda c, x, y: F.try_divide(c, F.sqrt(x) * F.sqrt(y)), cov, vx, vy)


def _corwin_schultz(b: Bars, n: int) -> Node:
    lh = b.l.let("lnhigh", lambda: Node.apply(ln, b.high))
    lo = b.l.let("lnlow", lambda: Node.apply(ln, b.low))
    hl = _hl2(b)
    ph, pl, phl = b.l.lag("lnhigh", lh, 1), b.l.lag("lnlow", lo, 1), b.l.lag("hl2", hl, 1)

    def spread(h, low, ph_, pl_, hl_, phl_):
        k = 3.0 - 2.0 * math.sqrt(2.0)
        beta = hl_ + phl_
        gamma = F.pow(F.greatest(h, ph_) - F.least(low, pl_), F.lit(2.0))
        alpha = (F.sqrt(2.0 * beta) - F.sqrt(beta)) / k - F.sqrt(gamma / k)
        s = 2.0 * (F.exp(alpha) - 1.0) / (1.0 + F.exp(alpha))
        return F.when(beta.isNotNull(), F.greatest(s, F.lit(0.0)))

    node = b.l.let("csspread", lambda: Node.apply(spread, lh, lo, ph, pl, hl, phl))
    return b.l.mean("csspread", node, n)


def _zero_share(b: Bars, n: int) -> Node:
    zero = b.l.let("zeroret", lambda: Node.apply(
        lambda r: F.when(r.isNotNull(), (r == 0).cast("double")), b.r1))
    return b.l.mean("zeroret", zero, n)


def _variance_ratio(b: Bars, q: int, n: int) -> Node:
    k = b.n(n)
    long = b.l.moments(f"ret{q}", b.ret(q), k)[2]
    return long / (float(q) * b.l.moments("r1", b.r1, k)[2])


def _shape(b: Bars, n: int, which: str) -> Node:
    """Bias-corrected skewness (G1) and excess kurtosis (G2) from frame sums of centred powers."""
    k = b.n(n)
    xc = b.l._centred("r1", b.r1)
    p2 = b.l.let("r1p2", lambda: xc * xc)
    p3 = b.l.let("r1p3", lambda: xc * xc * xc)
    p4 = b.l.let("r1p4", lambda: xc * xc * xc * xc)
    s1, s2, s3 = b.l.total("r1p1", xc, k), b.l.total("r1p2", p2, k), b.l.total("r1p3", p3, k)
    m1, m2, m3 = s1 * (1.0 / k), s2 * (1.0 / k), s3 * (1.0 / k)
    var = m2 - m1 * m1
    if which == "skew":
        third = m3 - 3.0 * m1 * m2 + 2.0 * m1 * m1 * m1
        g1 = third / Node.apply(lambda v: F.pow(v, F.lit(1.5)), var)
        return g1 * (math.sqrt(k * (k - 1.0)) / (k - 2.0))
    m4 = b.l.total("r1p4", p4, k) * (1.0 / k)
    fourth = m4 - 4.0 * m1 * m3 + 6.0 * m1 * m1 * m2 - 3.0 * m1 * m1 * m1 * m1
    g2 = fourth / (var * var) - 3.0
    return ((k + 1.0) * g2 + 6.0) * ((k - 1.0) / ((k - 2.0) * (k - 3.0)))


# -- clocks -----------------------------------------------------------------------------------------------------------


def _minute(tz: str = "UTC") -> Column:
    local = F.from_utc_timestamp(F.col("open_time"), tz)
    return F.hour(local) * 60 + F.minute(local)


def _weekday(tz: str = "UTC") -> Column:
    return F.weekday(F.from_utc_timestamp(F.col("open_time"), tz))


def _in_session(tz: str, start: int, end: int) -> Callable[[Bars], Node]:
    return _clock(lambda: (_minute(tz) >= start) & (_minute(tz) < end) & (_weekday(tz) < 5))


def _weekend() -> Column:
    return (_weekday() >= 5).cast("double")


def _clock(make: Callable[[], Column]) -> Callable[[Bars], Node]:
    return lambda b: Node(make().cast("double"), 0)


# -- registry ---------------------------------------------------------------------------------------------------------


def _registry() -> dict[str, Spec]:
    specs: dict[str, Spec] = {}

    def add(name, family, make, *needs):
        specs[name] = Spec(name, family, make, needs)

    V = "volume"
    for n in (5, 15, 30, 60, 240):
        add(f"sma_dist_{n}", TREND, lambda b, n=n: (b.logc - Node.apply(ln, b.sma(b.n(n)))) / b.sigma)
        add(f"ema_dist_{n}", TREND, lambda b, n=n: (b.logc - Node.apply(ln, b.ema(b.n(n)))) / b.sigma)
    for n in (15, 60, 240):
        add(f"lin_slope_{n}", TREND, lambda b, n=n: _lin_slope(b, n))
    for f, s, g in ((12, 26, 9), (6, 13, 5)):
        add(f"macd_line_{f}_{s}", TREND, lambda b, a=(f, s, g): _macd(b, *a, "line"))
        add(f"macd_signal_{f}_{s}_{g}", TREND, lambda b, a=(f, s, g): _macd(b, *a, "signal"))
        add(f"macd_hist_{f}_{s}_{g}", TREND, lambda b, a=(f, s, g): _macd(b, *a, "hist"))
    add("adx_14", TREND, lambda b: _adx(b, 14))
    add("di_diff_14", TREND, lambda b: _di(b, 14)[0] - _di(b, 14)[1])
    add("aroon_osc_25", TREND, lambda b: _aroon(b, 25))
    for f, s in ((5, 20), (15, 60), (60, 240)):
        add(f"ema_gap_{f}_{s}", TREND,
            lambda b, f=f, s=s: (b.ema(b.n(f)) - b.ema(b.n(s))) / (b.close * b.sigma))
    for n in (10, 30):
        add(f"efficiency_ratio_{n}", TREND, lambda b, n=n: Node.apply(
            F.abs, b.close - b.l.lag("close", b.close, n)) / b.l.total(
            "absdclose", b.l.let("absdclose", lambda: Node.apply(F.abs, b.dclose)), n))
    add("ichimoku_tenkan_dist", TREND, lambda b: (b.close - b.mid_range(9)) / b.atr(14))
    add("ichimoku_kijun_dist", TREND, lambda b: (b.close - b.mid_range(26)) / b.atr(14))
    add("ichimoku_tk_diff", TREND, lambda b: (b.mid_range(9) - b.mid_range(26)) / b.atr(14))
    add("ichimoku_cloud_dist", TREND, _cloud)
    add("supertrend_dist", TREND, None)
    add("supertrend_dir", TREND, None)

    for k in (1, 5, 10, 15, 30, 60, 240):
        add(f"ret_{k}", MOMENTUM, lambda b, k=k: b.ret(k))
    for k in (1, 5, 10, 15, 30, 60, 240):
        add(f"ret_vol_{k}", MOMENTUM, lambda b, k=k: b.ret_vol(k))
    for k in (5, 15, 60):
        add(f"ret_skip_{k}", MOMENTUM, lambda b, k=k: (
            b.l.lag("logc", b.logc, 1) - b.l.lag("logc", b.logc, k)) / (b.sigma * math.sqrt(k - 1)))
    for n in (2, 6, 14):
        add(f"rsi_{n}", MOMENTUM, lambda b, n=n: _rsi(b, n))
    for n, d in ((14, 3), (5, 3)):
        add(f"stoch_k_{n}", MOMENTUM, lambda b, n=n: 2.0 * b.stoch(n) - 1.0)
        add(f"stoch_d_{n}_{d}", MOMENTUM, lambda b, n=n, d=d: 2.0 * b.l.mean(f"stoch{n}", b.stoch(n), d) - 1.0)
    add("williams_r_14", MOMENTUM, lambda b: b.stoch(14) - 1.0)
    add("cci_20", MOMENTUM, lambda b: _cci(b, 20))
    add("tsi_25_13", MOMENTUM, lambda b: _tsi(b, 25, 13))
    add("ultimate_osc", MOMENTUM, _ultimate)
    for k in (15, 60):
        add(f"mom_z_{k}", MOMENTUM, lambda b, k=k: b.l.zscore(f"ret{k}", b.ret(k), b.n(DAY)))

    add("atr_pct_14", VOLATILITY, lambda b: b.atr(14) / b.close)
    add("bb_pctb_20_2", VOLATILITY, lambda b: _bollinger(b, 20, 2.0)[0])
    add("bb_width_20_2", VOLATILITY, lambda b: _bollinger(b, 20, 2.0)[1])
    add("bb_width_rel_20", VOLATILITY, lambda b: _bb_width_rel(b, 20))
    add("keltner_pos_20", VOLATILITY, lambda b: (b.close - b.ema(20)) / (2.0 * b.atr(10)))
    for n in (20, 60):
        add(f"donchian_pos_{n}", VOLATILITY, lambda b, n=n: b.stoch(n) - 0.5)
    for n in (15, 60, 240):
        add(f"rv_{n}", VOLATILITY, lambda b, n=n: b.rv(b.n(n)))
    for n in (15, 60):
        add(f"parkinson_{n}", VOLATILITY, lambda b, n=n: _parkinson(b, n))
        add(f"garman_klass_{n}", VOLATILITY, lambda b, n=n: _garman_klass(b, n))
    for x, y in ((15, 240), (60, 1440)):
        add(f"rv_ratio_{x}_{y}", VOLATILITY, lambda b, x=x, y=y: b.rv(b.n(x)) / b.rv(b.n(y)))
    add("range_atr_14", VOLATILITY, lambda b: b.span / b.atr(14))
    add("jump_ratio_240", VOLATILITY, lambda b: _jump(b, QUARTER_DAY))
    add("ret15_x_rv_ratio", VOLATILITY, lambda b: b.ret_vol(15) * (b.rv(b.n(SIGMA)) / b.rv(b.n(DAY))))

    add("obv_z_240", VOLUME, lambda b: _cum_z(b, "signed", b.signed, b.n(QUARTER_DAY)), V)
    for n in (15, 60):
        add(f"obv_slope_{n}", VOLUME, lambda b, n=n: b.l.total("signed", b.signed, n) / b.sum_volume(n), V)
    add("vwap_dev_session", VOLUME, lambda b: (b.logc - Node.apply(
        ln, b.since_session("quote", b.quote) / b.since_session("volume", b.volume))) / b.sigma, V, "session")
    for n in (60, 240):
        add(f"vwap_dev_{n}", VOLUME, lambda b, n=n: (b.logc - Node.apply(
            ln, b.l.total("quote", b.quote, b.n(n)) / b.sum_volume(b.n(n)))) / b.sigma, V)
    add("mfi_14", VOLUME, lambda b: _mfi(b, 14), V)
    add("cmf_20", VOLUME, lambda b: b.l.total(
        "clvvol", b.l.let("clvvol", lambda: b.clv * b.volume), 20) / b.sum_volume(20), V)
    add("force_index_13", VOLUME, lambda b: b.l.ema(
        "rvol", b.l.let("rvol", lambda: b.r1 * b.volume), 2.0 / 14, 13, gaps=True) / (
        b.l.ema("volume", b.volume, 2.0 / 14, 13, gaps=True) * b.sigma), V)
    for n in (60, 1440):
        add(f"rel_volume_{n}", VOLUME, lambda b, n=n: _rel(b, "volume", b.n(n)), V)
    add("rel_volume_tod", VOLUME, lambda b: b.volume / b.l.source("_tod_mean"), V)
    add("adl_z_240", VOLUME, lambda b: _cum_z(
        b, "clvvol", b.l.let("clvvol", lambda: b.clv * b.volume), b.n(QUARTER_DAY)), V)
    add("vpt_z_240", VOLUME, lambda b: _cum_z(b, "vpt", b.l.let(
        "vpt", lambda: b.volume * (b.close / b.prev_close - 1.0)), b.n(QUARTER_DAY)), V)
    add("eom_14", VOLUME, lambda b: _eom(b, 14), V)

    T = ("volume", "taker_buy_volume")
    for k in (1, 5, 15, 60):
        add(f"taker_imb_{k}", FLOW, lambda b, k=k: b.imbalance(k), *T)
    add("taker_imb_z_15", FLOW, lambda b: b.l.zscore("imb15", b.imbalance(15), b.n(DAY)), *T)
    for n in (60, 240):
        add(f"cvd_z_{n}", FLOW, lambda b, n=n: _cum_z(b, "cvd", b.l.let(
            "cvd", lambda: 2.0 * b.taker_buy_volume - b.volume), b.n(n)), *T)
    add("trades_rel_60", FLOW, lambda b: _rel(b, "trades", b.n(SIGMA)), V, "trades")
    add("avg_trade_size_rel_60", FLOW, lambda b: (b.volume / b.trades) / (
        b.sum_volume(60) / b.l.total("trades", b.trades, 60)), V, "trades")
    for n in (15, 60):
        add(f"tick_imb_{n}", FLOW, lambda b, n=n: _tick_imb(b, n), V)
    add("ret15_x_taker_abs15", FLOW, lambda b: b.ret_vol(15) * Node.apply(F.abs, b.imbalance(15)), *T)

    add("clv", MICRO, lambda b: b.clv)
    add("clv_15", MICRO, lambda b: b.l.mean("clv", b.clv, 15))
    add("body_ratio", MICRO, lambda b: b.range_ratio(b.close - b.open))
    add("upper_wick", MICRO, lambda b: b.range_ratio(b.high - Node.apply(F.greatest, b.open, b.close)))
    add("lower_wick", MICRO, lambda b: b.range_ratio(Node.apply(F.least, b.open, b.close) - b.low))
    add("amihud_60", MICRO, lambda b: _amihud(b, b.n(60)), V)
    add("amihud_rel_60", MICRO, lambda b: _amihud(b, b.n(60)) - b.l.mean(
        f"amihud{b.n(60)}", _amihud(b, b.n(60)), b.n(DAY)), V)
    for n in (60, 240):
        add(f"roll_spread_{n}", MICRO, lambda b, n=n: _roll(b, b.n(n)))
    add("cs_spread_60", MICRO, lambda b: _corwin_schultz(b, b.n(60)))
    add("zero_ret_frac_60", MICRO, lambda b: _zero_share(b, b.n(60)))

    for n in (20, 60, 240):
        add(f"zscore_{n}", STATS, lambda b, n=n: b.l.zscore("close", b.close, b.n(n)))
    for n in (60, 240):
        add(f"acf1_{n}", STATS, lambda b, n=n: _acf(b, b.n(n)))
    add("vr_5_240", STATS, lambda b: _variance_ratio(b, 5, QUARTER_DAY))
    for n in (60, 240):
        add(f"skew_{n}", STATS, lambda b, n=n: _shape(b, n, "skew"))
        add(f"kurt_{n}", STATS, lambda b, n=n: _shape(b, n, "kurt"))

    turn = 2.0 * math.pi
    add("hour_sin", CALENDAR, _clock(lambda: F.sin(_minute() * (turn / 1440.0))))
    add("hour_cos", CALENDAR, _clock(lambda: F.cos(_minute() * (turn / 1440.0))))
    add("dow_sin", CALENDAR, _clock(lambda: F.sin((_weekday() + _minute() / 1440.0) * (turn / 7.0))))
    add("dow_cos", CALENDAR, _clock(lambda: F.cos((_weekday() + _minute() / 1440.0) * (turn / 7.0))))
    add("is_weekend", CALENDAR, _clock(_weekend))
    # Local trading hours, in minutes after midnight.
    add("session_asia", CALENDAR, _in_session("Asia/Tokyo", 540, 900))
    add("session_europe", CALENDAR, _in_session("Europe/London", 480, 990))
    add("session_us", CALENDAR, _in_session("America/New_York", 570, 960))
    add("us_open_window", CALENDAR, _in_session("America/New_York", 540, 600))
    add("min_since_funding", CALENDAR, _clock(lambda: _minute() % FUNDING_MINUTES))
    add("min_to_funding", CALENDAR, _clock(lambda: FUNDING_MINUTES - _minute() % FUNDING_MINUTES))
    since_open = lambda b: b.logc - Node.apply(ln, b.session_open)
    add("ret_since_day_open", CALENDAR, since_open, "session")
    add("ret_since_day_open_vol", CALENDAR, lambda b: since_open(b) / (
        b.sigma * Node.apply(lambda k: F.sqrt(k.cast("double")), b.session_bars)), "session")
    add("ret15_x_weekend", CALENDAR, lambda b: b.ret_vol(15) * Node(_weekend(), 0))

    B = ("bench_close",)
    for k in (1, 5, 15):
        add(f"bench_ret_{k}", MARKET, lambda b, k=k: b.bench_ret(k), *B)
    for k in (5, 15, 60):
        add(f"rel_ret_{k}", MARKET, lambda b, k=k: b.ret(k) - b.bench_ret(k), *B)
    add("beta_bench_240", MARKET, lambda b: b.bench_fit(b.n(240))[0], *B)
    add("corr_bench_240", MARKET, lambda b: b.bench_fit(b.n(240))[1], *B)
    add("resid_ret_15", MARKET, lambda b: b.ret(15) - b.bench_fit(b.n(240))[0] * b.bench_ret(15), *B)

    add("funding_rate_bp", DERIVED, lambda b: b.funding_rate * 1e4, "funding_rate")
    add("funding_rate_z_30d", DERIVED, lambda b: b.l.source("_funding_z"), "funding_rate")
    for k in (5, 15, 60):
        add(f"oi_chg_{k}", DERIVED, lambda b, k=k: b.oi_change(k), "open_interest")
    add("oi_z_1440", DERIVED, lambda b: b.l.zscore("open_interest", b.open_interest, b.n(DAY)), "open_interest")
    for k in (15, 60):
        add(f"oi_x_ret_{k}", DERIVED, lambda b, k=k: b.oi_change(k) * b.ret_vol(k), "open_interest")
    for col in ("ls_ratio_top", "ls_ratio_accounts", "taker_ls_ratio"):
        add(f"{col}_log", DERIVED, lambda b, c=col: b.log_of(c), col)
        add(f"{col}_z_1440", DERIVED, lambda b, c=col: b.l.zscore(f"ln.{c}", b.log_of(c), b.n(DAY)), col)
    return specs


REGISTRY = _registry()


def list_indicators(family: str | None = None) -> list[str]:
    return [s.name for s in REGISTRY.values() if family in (None, s.family)]


def missing_requirements(columns: Iterable[str], names: Iterable[str] | None = None) -> dict[str, str]:
    """Indicators that cannot be built from the given columns, with the reason."""
    have, out = set(columns), {}
    for name in names or REGISTRY:
        if name not in REGISTRY:
            raise KeyError(f"unknown indicator: {name}")
        absent = [c for c in REGISTRY[name].needs if c not in have]
        if absent:
            out[name] = "missing column " + ", ".join(absent)
    return out


def same_clock_mean(df: DataFrame, keys: Sequence[str], value: str, out: str, *, days: int, least: int) -> DataFrame:
    """Mean of ``value`` at exactly the same time of day on the previous ``days`` days.

    A partition is one key and one minute of the day, so it grows by one row per day only.
    """
    second = F.unix_seconds(F.col("open_time"))
    w = Window.partitionBy(*keys, "_clock").orderBy("_second").rangeBetween(-days * 86400, -86400)
    return (
        df.withColumn("_second", second)
        .withColumn("_clock", F.col("_second") % 86400)
        .withColumn(out, F.when(F.count(value).over(w) >= least, F.avg(value).over(w)))
        .drop("_second", "_clock")
    )


def carried(numbered: DataFrame, keys: Sequence[str], names: Sequence[str], tile_rows: int) -> DataFrame:
    """Columns that reach back without limit: the session's open, first row and sums, and the last price move's sign."""
    w = tiling.tile_window(keys)
    df = numbered
    if any("session" in REGISTRY[x].needs for x in names):
        prev = F.lag("session").over(w)
        typical = (F.col("high") + F.col("low") + F.col("close")) / F.lit(3.0) * F.col("volume") if "volume" in df.columns else F.lit(None)
        quote = F.coalesce(F.col("quote_volume"), typical) if "quote_volume" in df.columns else typical
        sums = {"_session_quote": quote, "_session_volume": F.col("volume")} if "vwap_dev_session" in names else {}
        held = {"_session_open": F.col("open"), "_session_row": F.col(tiling.ROW)}
        df = since_event(df, keys, "open_time", prev.isNull() | (F.col("session") != prev), held=held, sums=sums, tile_rows=tile_rows)
    if any(x.startswith("tick_imb_") for x in names):
        move = F.col("close") - F.lag("close").over(w)
        held = {"_tick_sign": F.signum(F.col("_move"))}
        moved = tiling.untile(tiling.tile(df, keys, "open_time", behind=1, rows=tile_rows).withColumn("_move", move), keep_row=True)
        df = since_event(moved, keys, "open_time", F.coalesce(F.col("_move") != 0, F.lit(False)), held=held, tile_rows=tile_rows).drop("_move")
    return df


def compute_indicators(
    bars: DataFrame,
    names: Sequence[str] | None = None,
    *,
    keys: Sequence[str] = ("symbol",),
    lengths: Mapping[int, int] | None = None,
    keep: Sequence[str] | None = None,
    tile_rows: int = 2 * tiling.COARSE_ROWS,
    keep_rows: bool = False,
) -> DataFrame:
    """Bars plus one DOUBLE column per indicator; indicators whose input columns are absent are left out.

    ``lengths`` replaces window lengths (for bars other than one minute).  ``keep`` names the input columns to return
    (default: all).  ``keep_rows`` also returns the row numbers, so that a following step need not count again.
    Sessions and runs of equal closes may be of any length.
    """
    lengths = dict(lengths or {})
    n = lambda k: lengths.get(k, k)
    wanted = list(names) if names is not None else list(REGISTRY)
    skipped = missing_requirements(bars.columns, wanted)
    wanted = [w for w in wanted if w not in skipped]
    keep = list(bars.columns) if keep is None else list(keep)
    # narrow rows: every window operator buffers and copies whole rows
    used = {*keys, *keep, "open_time", "open", "high", "low", "close", "quote_volume", *(c for w in wanted for c in REGISTRY[w].needs)}
    df = bars.select(*[c for c in bars.columns if c in used])
    if "rel_volume_tod" in wanted:
        df = same_clock_mean(df, keys, "volume", "_tod_mean", days=PROFILE_DAYS, least=PROFILE_LEAST)
    df = tiling.number_rows(df, keys, "open_time")
    if "funding_rate_z_30d" in wanted:
        month = n(MONTH)
        tiled = tiling.tile(df, keys, "open_time", behind=month, rows=max(tile_rows, 2 * month))
        layers = Layers(tiled, keys)
        z = layers.zscore("funding_rate", layers.source("funding_rate"), month, n(MONTH_LEAST))
        df = tiling.untile(layers.build({"_funding_z": z}), keep_row=True)
    df = carried(df, keys, wanted, tile_rows)
    behind = max(ema_reach(2.0 / (n(240) + 1)) + 2 * n(60), 2 * ema_reach(1.0 / 14), n(DAY) + 2 * n(240))
    tiled = tiling.tile(df, keys, "open_time", behind=behind, rows=tile_rows)
    layers = Layers(tiled, keys)
    b = Bars(layers, bars.columns, lengths)
    plain = [w for w in wanted if not w.startswith("supertrend_")]
    outputs = {w: Node.apply(finite, REGISTRY[w].make(b)) for w in plain}
    band = [w for w in wanted if w.startswith("supertrend_")]
    if band:
        outputs["_atr10"] = b.atr(10)
    numbers = [tiling.ROW, tiling.TOTAL] if keep_rows else []
    wide = layers.build(outputs)
    if not band:
        return tiling.untile(wide, keep_row=keep_rows).select(*keep, *numbers, *wanted)
    rows = tiling.untile(wide, keep_row=True)
    return supertrend(rows, keys, atr="_atr10", tile_rows=tile_rows).select(*keep, *wanted)
