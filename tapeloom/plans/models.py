"""Probability models on Spark ML: purged walk-forward, boosted trees, isotonic calibration, batch forecasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F

from tapeloom.functions.numeric import logit
from tapeloom.operators import tiling
from tapeloom.operators.ranks import materialise


def usable(train: DataFrame, features: Sequence[str]) -> list[str]:
    """Features with at least one known value in the training rows."""
    row = train.agg(*[F.count(c).alias(c) for c in features]).first()
    return [c for c in features if row[c] > 0]


def logit_pipeline(features: Sequence[str], n_train: int, c: float = 0.1, label: str = "y") -> Pipeline:
    """Median imputation, standardisation and an L2 logistic regression with strength 1 / (C n)."""
    filled = [f"_f_{f}" for f in features]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
        LogisticRegression(featuresCol="_x", labelCol=label, regParam=1.0 / (c * max(n_train, 1)), elasticNetParam=0.0, standardization=False, maxIter=100)])


def boosted_pipeline(features: Sequence[str], label: str = "y", trees: int = 20) -> Pipeline:
    filled = [f"_f_{f}" for f in features]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_x"),
        GBTClassifier(featuresCol="_x", labelCol=label, maxDepth=3, stepSize=0.05, maxIter=trees, validationIndicatorCol="_valid", seed=7)])


def probability(model, rows: DataFrame, out: str = "p_up") -> DataFrame:
    return model.transform(rows).withColumn(out, vector_to_array("probability")[1])


def walk_forward(rows: DataFrame, features: Sequence[str], *, horizon: int, folds: int = 3, order: str = "t", kind: str = "logit") -> DataFrame:
    """Out-of-sample probabilities of growing training windows; the last ``horizon`` rows before a test fold are purged.

    Folds follow time over all symbols together, so every fit is one distributed job on the whole past.
    """
    times = tiling.number_rows(rows.select(order).distinct().withColumn("_all", F.lit(1)), ["_all"], order).select(order, F.col(tiling.ROW).alias("_pos"), F.col(tiling.TOTAL).alias("_n"))
    data = materialise(rows.join(times, order))
    n = int(data.agg(F.max("_n")).first()[0] or 0)
    size = n // (folds + 1)
    parts = []
    for k in range(folds):
        start = n - size * (folds - k)
        train = data.filter((F.col("_pos") < start - horizon) & F.col("y").isNotNull())
        test = data.filter((F.col("_pos") >= start) & (F.col("_pos") < start + size))
        cols = usable(train, features)
        if kind == "logit":
            model = logit_pipeline(cols, train.count()).fit(train)
        else:
            cut = int((start - horizon) * 0.9)
            train = train.filter((F.col("_pos") < cut - horizon) | (F.col("_pos") >= cut)).withColumn("_valid", F.col("_pos") >= cut)
            model = boosted_pipeline(cols).fit(train)
        parts.append(probability(model, test).select(*rows.columns, F.lit(k).alias("fold"), "p_up"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def isotonic_calibration(fit: DataFrame, apply_to: DataFrame, score: str, label: str, *, increasing: bool = True, out: str = "p_cal") -> DataFrame:
    """Isotonic map of the score, learnt on ``fit`` within its 1 % and 99 % quantiles, flat outside."""
    lo, hi = fit.agg(F.percentile(score, F.array(F.lit(0.01), F.lit(0.99)))).first()[0]
    clip = F.least(F.greatest(F.col(score), F.lit(float(lo))), F.lit(float(hi)))
    model = IsotonicRegression(featuresCol="_s", labelCol=label, predictionCol=out, isotonic=increasing).fit(fit.withColumn("_s", clip))
    return model.transform(apply_to.withColumn("_s", clip)).drop("_s")


def calibration_slope(rows: DataFrame, p: str, label: str) -> float:
    """Slope of a logistic regression of the outcome on logit(p): 1 for a calibrated forecast."""
    x = rows.withColumn("_l", logit(F.col(p)))
    fitted = Pipeline(stages=[VectorAssembler(inputCols=["_l"], outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol=label)]).fit(x)
    return float(fitted.stages[-1].coefficients[0])


def naive_quantiles(context: np.ndarray) -> np.ndarray:
    """Deciles of a driftless normal walk with the volatility of the context."""
    z = np.array([-1.2815515655446004, -0.8416212335729143, -0.5244005127080407, -0.2533471031357997, 0.0,
                  0.2533471031357997, 0.5244005127080407, 0.8416212335729143, 1.2815515655446004])
    steps = np.diff(context, axis=1)
    return context[:, -1:] + z[None, :] * steps.std(axis=1, keepdims=True)


def batch_forecast(contexts: DataFrame, score: Callable[[np.ndarray], np.ndarray] = naive_quantiles) -> DataFrame:
    """Quantiles for a table of context arrays (key columns, ``context``), scored in Arrow batches by any model."""
    keys = [c for c in contexts.columns if c != "context"]
    schema = ", ".join(f"{c} {t}" for c, t in contexts.dtypes if c != "context") + ", q ARRAY<DOUBLE>, last_value DOUBLE"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["context"].to_numpy()).astype(float)
                out = pdf[keys].copy()
                out["q"], out["last_value"] = list(score(x)), x[:, -1]
                yield out

    return contexts.mapInPandas(run, schema)


def context_windows(bars: DataFrame, length: int, *, bar_s: int, every: int) -> DataFrame:
    """The last ``length`` log closes at every ``every``-th bar, where no gap interrupts them."""
    tiled = tiling.tile(bars, ["symbol"], "open_time", behind=length)
    w = tiling.tile_window(["symbol"])
    frame = w.rowsBetween(-(length - 1), 0)
    t = F.unix_seconds("open_time")
    origin = F.col(tiling.ROW) % every == 0
    ready = origin & (F.count("close").over(frame) == length) & (t - F.lag(t, length - 1).over(w) == (length - 1) * bar_s)
    rows = tiled.withColumn("_ready", ready).withColumn("context", F.collect_list(F.log("close")).over(frame))
    return tiling.untile(rows.filter("_ready")).select("symbol", t.alias("t"), "context")
