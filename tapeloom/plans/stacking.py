"""Many small logistic fits at once: each Newton step is one aggregate for all groups, solved group by group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tapeloom.functions.numeric import clip, logistic, logit
from tapeloom.operators.ranks import materialise

STEPS, TOLERANCE = 40, 1e-9


def _linear(coef: str, x: Sequence[str]) -> Column:
    return sum((F.col(coef)[k + 1] * F.col(c) for k, c in enumerate(x)), F.col(coef)[0])


def newton_logits(rows: DataFrame, group: Sequence[str], x: Sequence[str], label: str, *, strength: float = 1e4, steps: int = STEPS, tolerance: float = TOLERANCE, least: int = 20) -> DataFrame:
    """group, n, coef (constant first), gradient (largest component at the optimum, over n) and loss (penalised mean log loss).

    The sum of log losses carries a penalty of half the squared slopes over ``strength``, which keeps separable groups
    finite. A step that would raise the loss is halved until it does not. Groups of fewer than ``least`` rows, or of one
    outcome, keep a NULL fit. Only whether any group still moves comes to the driver.
    """
    group, x = list(group), list(x)
    k = len(x) + 1
    known = F.col(label).isNotNull()
    for c in x:
        known = known & F.col(c).isNotNull() & ~F.isnan(c)
    data = materialise(rows.where(known).select(*group, *[F.col(c).cast("double").alias(c) for c in x], F.col(label).cast("double").alias("_y")))
    zero = F.array(*[F.lit(0.0)] * k)
    sizes = materialise(data.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), (F.min("_y") < F.max("_y")).alias("_both")))
    state = materialise(sizes.where(F.col("_both") & (F.col("n") >= least)).select(*group, "n", zero.alias("coef"), zero.alias("_step"), F.lit(float("inf")).alias("_loss"), F.lit(False).alias("done")))
    features = [F.lit(1.0), *[F.col(c) for c in x]]
    fields = [f for f in data.schema.fields if f.name in group]
    vector = T.ArrayType(T.DoubleType())
    schema = T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("coef", vector), T.StructField("_step", vector), T.StructField("_loss", T.DoubleType()), T.StructField("done", T.BooleanType()), T.StructField("gradient", T.DoubleType())])

    def advance(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                coef, step = np.array(r["coef"], float), np.array(r["_step"], float)
                n, g = r["n"], np.array(r["_g"], float)
                hessian = np.zeros((k, k))
                hessian[np.triu_indices(k)] = r["_h"]
                hessian = hessian + np.triu(hessian, 1).T
                pull = np.concatenate([[0.0], np.full(k - 1, 1 / strength)])
                loss = (r["_l"] + pull @ coef**2 / 2) / n
                g, hessian = (g - pull * coef) / n, (hessian + np.diag(pull)) / n
                if loss > r["_loss"] + 1e-15 and np.abs(step).max() > 1e-12:
                    # the last step went too far: half of it, from where it began
                    new, step, kept, done = coef - step / 2, step / 2, r["_loss"], False
                else:
                    step = np.linalg.solve(hessian, g)
                    done = bool(np.abs(g).max() < tolerance)
                    new, kept = (coef, loss) if done else (coef + step, loss)
                out.append({**{c: r[c] for c in group}, "n": n, "coef": new.tolist(), "_step": step.tolist(), "_loss": float(kept), "done": done, "gradient": float(np.abs(g).max())})
            if out:
                yield pd.DataFrame(out)[schema.names]

    finished = None
    for _ in range(steps):
        moving = data.join(state.select(*group, "coef"), group)
        p = logistic(_linear("coef", x))
        r, w = F.col("_y") - p, p * (1 - p)
        line = _linear("coef", x)
        # log(1 + exp(-s)) without overflow, s the signed margin
        margin = F.when(F.col("_y") > 0.5, line).otherwise(-line)
        soft = F.log1p(F.exp(-F.abs(margin))) + F.greatest(-margin, F.lit(0.0))
        sums = moving.groupBy(*group).agg(
            F.array(*[F.sum(r * f) for f in features]).alias("_g"), F.array(*[F.sum(w * features[a] * features[b]) for a in range(k) for b in range(a, k)]).alias("_h"), F.sum(soft).alias("_l"))
        state = materialise(state.drop("gradient").join(sums, group).mapInPandas(advance, schema))
        over = materialise(state.where("done"))
        finished = over if finished is None else finished.unionByName(over)
        state = state.where("NOT done")
        if state.limit(1).count() == 0:
            break
    fits = finished.unionByName(state).select(*group, "coef", "gradient", F.col("_loss").alias("loss"))
    return sizes.select(*group, "n").join(fits, group, "left")


def stack_features(rows: DataFrame, probabilities: Sequence[str], eps: float = 1e-4) -> DataFrame:
    """``_x_<name>``: the log odds of each probability, kept inside (eps, 1 - eps)."""
    return rows.withColumns({f"_x_{p}": logit(clip(F.col(p), eps, 1 - eps)) for p in probabilities})


def stacking(rows: DataFrame, group: Sequence[str], probabilities: Sequence[str], label: str, train: Column, **options) -> tuple[DataFrame, DataFrame]:
    """(fits on the training rows of each group; all other rows with ``p_stack``).  Without a fit the first probability stands."""
    x = [f"_x_{p}" for p in probabilities]
    seen = stack_features(rows, probabilities)
    fits = materialise(newton_logits(seen.where(train), group, x, label, **options))
    own = F.array(*[F.lit(float(k == 1)) for k in range(len(x) + 1)])
    test = seen.where(~train).join(fits.select(*group, "coef"), list(group), "left").withColumn("coef", F.coalesce("coef", own))
    return fits, test.withColumn("p_stack", logistic(_linear("coef", x))).drop("coef", *x)


def gap_slope(rows: DataFrame, group: Sequence[str], model: str, market: str, label: str) -> DataFrame:
    """Slope of (outcome - market) on (model - market) without a constant: what of the gap comes true."""
    gap, rest = F.col(model) - F.col(market), F.col(label) - F.col(market)
    return rows.groupBy(*group).agg(F.count(gap * rest).alias("n"), F.try_divide(F.sum(gap * rest), F.sum(gap * gap)).alias("slope"))
