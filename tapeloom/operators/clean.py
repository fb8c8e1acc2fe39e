"""Cleaning and classification of bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

PRICES = ("open", "high", "low", "close")
# Quote currencies of the crypto symbols.
CRYPTO_QUOTES = ("USDT", "USDC", "FDUSD", "BUSD")
MARKET_TIME_ZONE = {"CRYPTO": "UTC", "FR": "Europe/Paris", "US": "America/New_York"}


def keep_last(df: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """Last row per key by ingest order.  An aggregate, so duplicates combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), sequence).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def known(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c)


def clean_ohlcv(df: DataFrame, keys: Sequence[str] = ("symbol", "open_time"), sequence: str | None = None) -> DataFrame:
    """Drop rows with a missing or non-positive price, make high and low consistent, negative volumes become NULL."""
    out = keep_last(df, keys, sequence) if sequence else df
    good = F.lit(True)
    for c in PRICES:
        good = good & known(c) & (F.col(c) > 0)
    prices = [F.col(c) for c in PRICES]
    out = out.filter(good).withColumns({"high": F.greatest(*prices), "low": F.least(*prices)})
    return out.withColumns({c: F.when(known(c) & (F.col(c) >= 0), F.col(c)) for c in
                            ("volume", "quote_volume", "trades", "taker_buy_volume") if c in out.columns})


def market_of(symbol: Column) -> Column:
    return F.when(symbol.rlike("(" + "|".join(CRYPTO_QUOTES) + ")$"), "CRYPTO").when(symbol.endswith(".PA"), "FR").otherwise("US")


def session_date(open_time: Column, market: Column) -> Column:
    """Calendar date of the bar in the time zone of its market."""
    out = F.to_date(open_time)
    for name, tz in MARKET_TIME_ZONE.items():
        if tz != "UTC":
            out = F.when(market == name, F.to_date(F.from_utc_timestamp(open_time, tz))).otherwise(out)
    return out


def closed_only(df: DataFrame, bar_s: int, now_s: Column) -> DataFrame:
    return df.filter(F.unix_seconds("open_time") + bar_s <= now_s)


def coverage(bars: DataFrame, bar_s: int) -> DataFrame:
    """Expected and missing bars per symbol, with the share of known volumes."""
    t = F.unix_seconds("open_time")
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_bars"), ((F.max(t) - F.min(t)) / bar_s + 1).cast("long").alias("n_expected"),
        F.avg(F.col("volume").isNotNull().cast("double")).alias("volume_known")).withColumn(
        "n_missing", F.col("n_expected") - F.col("n_bars"))
