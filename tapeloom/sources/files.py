"""File scans with explicit schemas: bars, derivative metrics, funding, trades, market metadata, logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tapeloom.operators.clean import keep_last

KLINE = ("open_time STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, close_time BIGINT, quote_volume DOUBLE, "
         "trades DOUBLE, taker_buy_volume DOUBLE, taker_buy_quote_volume DOUBLE, ignore STRING")
# Column names of the published metric files.
METRIC_NAMES = {"sum_open_interest": "open_interest", "sum_open_interest_value": "open_interest_value",
                "sum_toptrader_long_short_ratio": "ls_ratio_top", "count_long_short_ratio": "ls_ratio_accounts",
                "count_toptrader_long_short_ratio": "ls_ratio_top_accounts", "sum_taker_long_short_vol_ratio": "taker_ls_ratio"}


METRICS = ("create_time STRING, symbol STRING, sum_open_interest STRING, sum_open_interest_value STRING, count_toptrader_long_short_ratio STRING, "
           "sum_toptrader_long_short_ratio STRING, count_long_short_ratio STRING, sum_taker_long_short_vol_ratio STRING")
FUNDING = "calc_time BIGINT, funding_interval_hours INT, last_funding_rate DOUBLE"


def file_order() -> Column:
    """Orders rows as they stand in their files, whatever the splits."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())


def epoch_to_timestamp(x: Column) -> Column:
    """Timestamp from seconds, milliseconds, microseconds or nanoseconds, told apart by magnitude."""
    us = F.when(x < 1e11, x * 1000000).when(x < 1e14, x * 1000).when(x < 1e17, x).otherwise(F.floor(x / 1000))
    return F.timestamp_micros(us.cast("long"))


def floor_to(x: Column, step: int) -> Column:
    return F.floor(x / step) * step


def ceil_to(x: Column, step: int) -> Column:
    return F.ceil(x / step) * step


def klines(spark: SparkSession, path: str | Sequence[str], symbol: str, *, bar_s: int, now_s: int) -> DataFrame:
    """Bars from headerless or headed CSV: a header line has no numeric open time and drops out.  Unclosed bars are
    dropped and the last copy of a bar is kept (by file, then position)."""
    raw = spark.read.schema(KLINE).option("mode", "PERMISSIVE").csv(path)
    at = F.expr("try_cast(open_time AS BIGINT)")
    rows = raw.withColumn("_seq", file_order())
    rows = rows.withColumn("_at", at).filter(F.col("_at").isNotNull()).withColumn("open_time", epoch_to_timestamp(F.col("_at")))
    rows = rows.filter(F.unix_seconds("open_time") + bar_s <= now_s).withColumn("symbol", F.lit(symbol))
    return keep_last(rows.drop("_at", "close_time", "taker_buy_quote_volume", "ignore"), ["symbol", "open_time"], "_seq").drop("_seq")


def metrics(spark: SparkSession, path: str | Sequence[str], lag_s: int = 300) -> DataFrame:
    """Derivative metrics, available ``lag_s`` after their creation; of rows of one time the last in the files stays."""
    raw = spark.read.schema(METRICS).option("header", True).csv(path)
    cols = [F.expr(f"try_cast({a} AS DOUBLE)").alias(b) for a, b in METRIC_NAMES.items()]
    at = F.unix_seconds(F.expr("try_to_timestamp(create_time)")) + lag_s
    rows = raw.select("symbol", at.alias("available"), *cols, file_order().alias("_seq")).filter(F.col("available").isNotNull())
    return keep_last(rows, ["symbol", "available"], "_seq").drop("_seq")


def funding(spark: SparkSession, path: str | Sequence[str], symbol: str) -> DataFrame:
    """Funding rates by the second they are known; of repeated rows the last in the files stays."""
    raw = spark.read.schema(FUNDING).option("header", True).csv(path)
    rows = raw.select(F.lit(symbol).alias("symbol"), F.ceil(F.col("calc_time") / 1000).alias("available"), F.col("last_funding_rate").alias("funding_rate"), file_order().alias("_seq"))
    return keep_last(rows.filter(F.col("available").isNotNull()), ["symbol", "available"], "_seq").drop("_seq")


def combine_measures(*frames: DataFrame) -> DataFrame:
    """Union of measures on their availability; per instant the last known value of each column, in the frames' order."""
    out = frames[0].withColumn("_order", F.lit(0))
    for k, f in enumerate(frames[1:], 1):
        out = out.unionByName(f.withColumn("_order", F.lit(k)), allowMissingColumns=True)
    values = [c for c in out.columns if c not in ("symbol", "available", "_order")]
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_order")))
    return out.groupBy("symbol", "available").agg(*[known(c).alias(c) for c in values])


def trade_tape(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Fills from JSON with snake or camel keys; wallets lower case, outcomes capitalised."""
    schema = ("timestamp BIGINT, proxyWallet STRING, proxy_wallet STRING, side STRING, outcome STRING, outcomeIndex INT, outcome_index INT, asset STRING, "
              "token_id STRING, conditionId STRING, condition_id STRING, price DOUBLE, size DOUBLE, transactionHash STRING, transaction_hash STRING, name STRING")
    r = spark.read.schema(schema).json(path)
    index = F.coalesce("outcomeIndex", "outcome_index")
    return r.select(
        F.timestamp_seconds("timestamp").alias("ts"), F.lower(F.coalesce("proxyWallet", "proxy_wallet")).alias("wallet"), F.upper("side").alias("side"),
        F.coalesce(F.initcap("outcome"), F.when(index == 0, "Up").when(index == 1, "Down")).alias("outcome"), F.coalesce("asset", "token_id").alias("token_id"),
        F.coalesce("conditionId", "condition_id").alias("condition"), "price", "size", (F.col("price") * F.col("size")).alias("notional"),
        F.coalesce("transactionHash", "transaction_hash").alias("tx"), "name", F.monotonically_increasing_id().alias("seq"))


def market_metadata(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Binary markets from JSON whose lists are JSON strings: tokens by outcome, and the outcome from final prices."""
    r = spark.read.schema("slug STRING, conditionId STRING, outcomes STRING, outcomePrices STRING, clobTokenIds STRING, closed BOOLEAN, endDate STRING, feeRate DOUBLE").json(path)
    names = F.transform(F.from_json("outcomes", "array<string>"), F.lower)
    up, down = F.array_position(names, "up").cast("int"), F.array_position(names, "down").cast("int")
    prices = F.transform(F.from_json("outcomePrices", "array<string>"), lambda x: x.cast("double"))
    tokens = F.from_json("clobTokenIds", "array<string>")
    at = lambda a, i: F.when(i > 0, F.try_element_at(a, i))
    out = r.select("slug", F.col("conditionId").alias("condition"), "closed", at(prices, up).alias("up_price"), at(prices, down).alias("down_price"),
                   at(tokens, up).alias("token_up"), at(tokens, down).alias("token_down"), F.expr("try_to_timestamp(endDate)").alias("window_end"), F.col("feeRate").alias("fee_rate"))
    known = F.when((F.col("up_price") == 1) & (F.col("down_price") == 0), True).when((F.col("up_price") == 0) & (F.col("down_price") == 1), False)
    return out.withColumn("resolved_up", F.when(F.col("closed"), known))


BOOK = ("rx BIGINT, e STRING, a INT, ts BIGINT, b ARRAY<ARRAY<DOUBLE>>, k ARRAY<ARRAY<DOUBLE>>, c ARRAY<ARRAY<STRING>>, bb DOUBLE, ba DOUBLE, "
        "p DOUBLE, s DOUBLE, side STRING, tx STRING, _bad STRING")


def book_log(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines by file) of a compact book log, one JSON object per line.

    Lines cut off by a killed writer are counted, not kept.  A trade written to two segments is kept once.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    r = lines.select("file", F.from_json("value", BOOK, {"columnNameOfCorruptRecord": "_bad"}).alias("r")).select("file", "r.*")
    bad = r.filter(F.col("_bad").isNotNull()).groupBy("file").agg(F.count(F.lit(1)).alias("bad_lines"))
    good = r.filter(F.col("_bad").isNull()).drop("_bad", "file").withColumn("_one", F.when(F.col("e") == "trade", F.struct("a", "ts", "p", "s", "side", "tx")))
    first = F.row_number().over(Window.partitionBy("_one").orderBy("rx"))
    trades = good.filter(F.col("_one").isNotNull()).withColumn("_n", first).filter(F.col("_n") == 1).drop("_n")
    return good.filter(F.col("_one").isNull()).unionByName(trades).drop("_one"), bad


def tick_log(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Quotes (with sizes) and trades of an exchange log by symbol, told apart by the stream name.

    Field names differ by case only, so they are taken from the line by path.
    """
    line = spark.read.text(path)
    at = lambda name, kind: F.get_json_object("value", f"$.{name}").cast(kind)
    stream = at("stream", "string")
    head = (at("rx", "long").alias("rx"), F.upper(F.substring_index(stream, "@", 1)).alias("symbol"))
    quotes = line.filter(stream.endswith("@bookTicker")).select(
        *head, at("b", "double").alias("bid"), at("a", "double").alias("ask"), at("B", "double").alias("bid_sz"), at("A", "double").alias("ask_sz"),
        ((at("b", "double") + at("a", "double")) / 2).alias("mid"))
    trades = line.filter(stream.endswith("@aggTrade")).select(
        *head, at("E", "long").alias("event_ms"), at("T", "long").alias("trade_ms"), at("p", "double").alias("price"), at("q", "double").alias("qty"), at("m", "boolean").alias("buyer_maker"))
    return quotes, trades


def prefer_live(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: a live update before a snapshot, then the earliest received."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("snapshot", "rx")).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = ("symbol", "day")) -> None:
    """Parquet by key and day, so readers prune by both; only the partitions that ``df`` has rows of are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).option("compression", "zstd").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows whose key is not in the new ones, and the new ones."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def fill_outcomes(log: DataFrame, outcomes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Back-fill outcome columns that were unknown when the row was written."""
    late = outcomes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = log.join(late, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in columns}).drop(*[f"_{c}" for c in columns])
