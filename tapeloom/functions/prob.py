"""Fees, edges, probability scores and intervals as column expressions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, functions as F

from tapeloom.functions.numeric import as_col, clip, div, normal_cdf

# Published fee schedule.
FEE_RATE = 0.07
REBATE_RATE = 0.2
WILSON_Z = 1.959963984540054


def taker_fee(price: Column, shares, rate=FEE_RATE, exponent=1.0, decimals: int | None = 5) -> Column:
    """shares x rate x (p (1 - p))^exponent; NULL outside [0, 1]; takers only, makers pay nothing."""
    p = as_col(price)
    curve = F.greatest(p * (1 - p), F.lit(0.0))
    fee = as_col(shares) * as_col(rate) * (curve if exponent == 1.0 else F.pow(curve, as_col(exponent)))
    fee = F.when((p >= 0) & (p <= 1), fee)
    scale = 10.0 ** (decimals or 0)
    return fee if decimals is None else F.rint(fee * scale) / scale  # half to even


def taker_cost(ask: Column, rate=FEE_RATE) -> Column:
    return ask + taker_fee(ask, 1.0, rate, decimals=None)


def choose_side(prob_up: Column, ask_up: Column, ask_down: Column, margin=0.0, rate=FEE_RATE) -> dict[str, Column]:
    """Expected value of buying each side, and the better side when it beats the margin (a tie goes up)."""
    ev_up = prob_up - taker_cost(ask_up, rate)
    ev_down = (1 - prob_up) - taker_cost(ask_down, rate)
    best = F.greatest(ev_up, ev_down)
    side = F.when(best > as_col(margin), F.when(F.coalesce(ev_up, F.lit(float("-inf"))) >= F.coalesce(
        ev_down, F.lit(float("-inf"))), F.lit("up")).otherwise(F.lit("down")))
    return {"ev_up": ev_up, "ev_down": ev_down, "side": side}


def pnl_per_share(side: Column, up_won: Column, price: Column, fee: Column) -> Column:
    won = F.when(side == "up", up_won).when(side == "down", ~up_won)
    return F.when(won, F.lit(1.0)).when(~won, F.lit(0.0)) - price - fee


def wilson(hits: Column, n: Column, z: float = WILSON_Z) -> tuple[Column, Column]:
    p = div(hits, n)
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, centre - half), F.when(n > 0, centre + half)


def brier(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def log_loss(p: Column, y: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def qlike(forecast: Column, realised: Column, floor: float = 1e-12) -> Column:
    ratio = F.greatest(realised, F.lit(floor)) / F.greatest(forecast, F.lit(floor))
    return F.when(forecast.isNotNull() & realised.isNotNull(), ratio - F.log(ratio) - 1)


def conservative_t(a: Column, b: Column) -> Column:
    """The smaller |t| when two estimates agree in sign, zero when they do not."""
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(
        F.signum(a) == F.signum(b), F.signum(a) * F.least(F.abs(a), F.abs(b))).otherwise(0.0)


def two_sided_p(z: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(z)))


def min_detectable_accuracy(n_eff: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Smallest true hit rate a one-sided test against one half finds with the given power."""
    k = (NormalDist().inv_cdf(1 - alpha) + NormalDist().inv_cdf(power)) ** 2
    return F.when(n_eff > 0, F.lit(0.5) + 0.5 * F.sqrt(k / (n_eff + k)))


def variance_factor(t: Column, start: Column, end: Column, average_s: float) -> Column:
    """Var(F - K)/sigma^2 of an average-against-average window, continuous form, by phase of t."""
    L = float(average_s)
    r, tau = start - t, F.greatest(end - t, F.lit(0.0))
    return (
        F.when(t <= start - L, (end - start) - L / 3.0)
        .when(t <= start, (end - start) - 2 * L / 3.0 + r - r * r / L + r * r * r / (3 * L * L))
        .when(t <= end - L, tau - 2 * L / 3.0)
        .otherwise(tau * tau * tau / (3 * L * L))
    )


def variance_factor_grid(rel: Column, duration: int, average_s: int) -> Column:
    """The same with averages of one point per second: sum of squared weights of the future one-second steps."""
    L, D = average_s, duration
    steps = F.when(rel < D, F.sequence((F.floor(rel) + 1).cast("int"), F.lit(D))).otherwise(F.array().cast("array<int>"))
    end_w = lambda u: F.least(F.lit(L), F.lit(D + 1) - F.greatest(u, F.lit(D - L + 1))) / F.lit(float(L))
    future = F.greatest(F.least(F.lit(L), -F.floor(rel).cast("int")), F.lit(0))
    first = F.greatest(F.floor(rel).cast("int") + 1, F.lit(1 - L))
    start_w = lambda u: F.when(future > 0, F.greatest(F.lit(0), F.lit(1) - F.greatest(u, first)) / F.lit(float(L))).otherwise(0.0)
    return F.aggregate(steps, F.lit(0.0), lambda acc, u: acc + F.pow(end_w(u) - start_w(u), F.lit(2.0)))


def phase_of(t: Column, start: Column, end: Column, average_s: float) -> Column:
    L = float(average_s)
    return F.when(t <= start - L, 1).when(t <= start, 2).when(t <= end - L, 3).otherwise(4)


def fair_probability(mean: Column, sigma: Column, factor: Column, basis_sd: float = 0.0) -> Column:
    """Phi(mean / sd); with no spread left a tie goes up."""
    sd = F.sqrt(sigma * sigma * factor + basis_sd * basis_sd)
    return F.when(sd > 0, normal_cdf(mean / sd)).when(mean >= 0, F.lit(1.0)).when(mean < 0, F.lit(0.0))
