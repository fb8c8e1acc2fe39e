"""Trade-tape ledgers: roles, positions, P&L per wallet and market, hourly tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.operators.ranks import ordinal_rank
from tapeloom.functions.prob import FEE_RATE, REBATE_RATE

FILL_KEY = ("tx", "wallet", "condition", "outcome", "side", "size", "price")


def attach_market_info(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Left join of the market columns; ``t_rel`` is seconds from the window start, NULL for an unknown market.

    No broadcast hint: the market table grows with the tape, so Spark chooses by its measured size.
    """
    return trades.join(markets, "condition", "left").withColumn("t_rel", F.col("ts") - F.col("window_start"))


def assign_roles(fills: DataFrame, takers: DataFrame) -> DataFrame:
    """Taker / maker role by matching equal fills one for one (the n-th copy with the n-th copy)."""
    order = Window.partitionBy(*FILL_KEY).orderBy("seq")
    a = fills.withColumn("_occ", F.row_number().over(order))
    t = takers.withColumn("_occ", F.row_number().over(order)).select(*FILL_KEY, "_occ", F.lit(True).alias("_hit"))
    hit = a.join(t, [*FILL_KEY, "_occ"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    has_taker = hit.groupBy("tx").agg(F.max("_hit").alias("_any"))
    role = F.when(F.col("_hit"), "taker").when(F.col("_any"), "maker")
    return hit.join(has_taker, "tx").withColumn("role", role).drop("_occ", "_hit", "_any")


def exposure(side: Column, outcome: Column, price: Column) -> tuple[Column, Column]:
    """A fill as a bought exposure: selling X at p is buying the opposite at 1 - p."""
    bought = F.when(side == "BUY", outcome).otherwise(F.when(outcome == "Up", "Down").otherwise("Up"))
    return bought, F.when(side == "BUY", price).otherwise(1 - price)


def wallet_market_pnl(trades: DataFrame, fee_rate: float = FEE_RATE, rebate_rate: float = REBATE_RATE, *, rebate: bool = True) -> DataFrame:
    """One row per wallet and market: signed positions, cash, fees, payout, P&L and the pro-rata maker rebate.

    The rebate needs the trades a second time, for the sums of each market; without it they are read once.
    """
    sign = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    up = F.col("outcome") == "Up"
    taker, maker = F.col("role") == "taker", F.col("role") == "maker"
    notional = F.col("price") * F.col("size")
    equiv = F.lit(fee_rate) * F.col("price") * (1 - F.col("price")) * F.col("size")
    yes = lambda c, x: F.sum(F.when(c, x).otherwise(0.0))
    number = lambda c: F.count(F.when(c, 1))
    out = trades.groupBy("wallet", "condition").agg(
        F.round(yes(up, sign * F.col("size")), 6).alias("pos_up"),
        F.round(yes(~up, sign * F.col("size")), 6).alias("pos_down"),
        F.sum(-sign * notional).alias("cash"),
        yes(taker, F.rint(equiv * 100000) / 100000).alias("fees"),
        F.sum(notional).alias("volume"),
        F.sum("size").alias("shares"),
        F.count(F.lit(1)).alias("n_trades"),
        number(taker).alias("n_taker"),
        number(maker).alias("n_maker"),
        number(F.col("role").isNull()).alias("n_role_unknown"),
        yes(taker, notional).alias("taker_notional"),
        yes(maker, equiv).alias("maker_fee_equiv"),
        F.min("t_rel").alias("first_t_rel"),
        F.max("t_rel").alias("last_t_rel"),
        F.percentile("t_rel", F.lit(0.5)).alias("median_t_rel"),
        F.max("resolved_up").alias("resolved_up"),
        F.max("asset").alias("asset"),
        F.max("window_start").alias("window_start"),
    )
    won = F.col("resolved_up").cast("double")
    out = (
        out.withColumn("payout", F.col("pos_up") * won + F.col("pos_down") * (1 - won))
        .withColumn("pnl", F.col("cash") - F.col("fees") + F.col("payout"))
        .withColumn("taker_share", F.when(F.col("volume") > 0, F.col("taker_notional") / F.col("volume")))
        .withColumn("net_up", F.round(F.col("pos_up") - F.col("pos_down"), 6))
        .withColumn("direction", F.when(F.col("net_up") > 1e-6, "Up").when(F.col("net_up") < -1e-6, "Down").otherwise("flat"))
    )
    if not rebate:
        return out
    # sums of a market come from its trades: few rows leave a task, and no ledger row is made twice
    pools = trades.groupBy("condition").agg(yes(taker, F.rint(equiv * 100000) / 100000).alias("_pool"), yes(maker, equiv).alias("_equiv"))
    share = F.when(F.col("_equiv") > 0, rebate_rate * F.col("_pool") * F.col("maker_fee_equiv") / F.col("_equiv")).otherwise(0.0)
    return out.join(pools, "condition").withColumn("rebate_est", share).withColumn("pnl_incl_rebate", F.col("pnl") + F.col("rebate_est")).drop("_pool", "_equiv")


def hourly_wallet_table(pnl: DataFrame, step_s: int = 3600) -> DataFrame:
    """Per (hour of the window start, wallet) sums, win rate and the rank of the wallet in the hour.

    Sums run over the sorted values of a wallet's markets: the last bit decides ranks of equal P&L, and must not follow the
    order in which tasks hand rows over.
    """
    total = lambda c: F.aggregate(F.array_sort(F.collect_list(c)), F.lit(0.0), lambda a, x: a + x)
    hour = (F.floor(F.col("window_start") / step_s) * step_s).alias("hour")
    out = pnl.groupBy(hour, "wallet").agg(
        *[total(c).alias(c) for c in ("pnl", "pnl_incl_rebate", "fees", "volume") if c in pnl.columns], F.countDistinct("condition").alias("n_markets"),
        F.sum("n_trades").alias("n_trades"), F.count(F.when(F.col("pnl") > 0, 1)).alias("n_wins"),
        total("taker_notional").alias("_taker"), F.percentile("first_t_rel", F.lit(0.5)).alias("first_t_rel_median"),
        F.array_join(F.array_sort(F.collect_set("asset")), ",").alias("assets"),
    )
    return (
        ordinal_rank(out, ["hour"], "pnl", ["wallet"], "rank_pnl")
        .withColumn("win_rate", F.col("n_wins") / F.col("n_markets"))
        .withColumn("pnl_per_market", F.col("pnl") / F.col("n_markets"))
        .withColumn("taker_share", F.when(F.col("volume") > 0, F.col("_taker") / F.col("volume")))
        .drop("_taker")
    )


def market_stats(markets: DataFrame, trades: DataFrame) -> DataFrame:
    """Fills, taker fills, distinct wallets and taker volume of every market, zero where it never traded."""
    taker = F.col("role") == "taker"
    s = trades.groupBy("condition").agg(
        F.count(F.lit(1)).alias("n_fills"), F.count(F.when(taker, 1)).alias("n_taker_fills"),
        F.countDistinct("wallet").alias("n_wallets"),
        F.sum(F.when(taker, F.col("price") * F.col("size")).otherwise(0.0)).alias("taker_volume"))
    return markets.join(s, "condition", "left").fillna(0, ["n_fills", "n_taker_fills", "n_wallets", "taker_volume"])


def role_consistency(trades: DataFrame, atol: float = 1e-3, rtol: float = 1e-6) -> DataFrame:
    """Per transaction exactly one taker line?  Taker size equal to the makers' sum?  One summary row."""
    taker, maker = F.col("role") == "taker", F.col("role") == "maker"
    side = lambda c: F.sum(F.when(c, F.col("size")).otherwise(0.0))
    tx = trades.groupBy("tx").agg(
        F.count(F.when(taker, 1)).alias("nt"), F.count(F.when(maker, 1)).alias("nm"), side(taker).alias("ts"),
        side(maker).alias("ms"), F.count(F.when(F.col("role").isNull(), 1)).alias("nu"), F.count(F.lit(1)).alias("n"))
    one = F.col("nt") == 1
    equal = one & (F.col("nm") > 0) & (F.abs(F.col("ts") - F.col("ms")) <= atol + rtol * F.abs("ms"))
    return tx.agg(
        F.count(F.lit(1)).alias("n_tx"), F.avg(one.cast("double")).alias("share_one_taker"),
        F.avg(equal.cast("double")).alias("share_balanced"),
        (F.sum("nu") / F.sum("n")).alias("share_role_unknown"))


def first_market_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
