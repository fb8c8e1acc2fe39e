"""Forecast quantiles held as arrays: spread, probability of a rise, context transforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

DECILES = tuple(i / 10 for i in range(1, 10))


def sigma_from_quantiles(q: Column) -> Column:
    """Standard deviation of a normal with these deciles (outer deciles)."""
    return (F.element_at(q, 9) - F.element_at(q, 1)) / (2 * 1.2815515655446004)


def probability_above(q: Column, threshold: Column, levels: Sequence[float] = DECILES) -> Column:
    """Probability of more than ``threshold`` under the distribution that is even between neighbouring quantiles.

    The outermost slopes go on to the probabilities 0 and 1. Each stretch between two knots adds the part of its mass
    that lies below the threshold; a stretch without width adds half of its mass when it lies on the threshold. The
    result is kept in [0.01, 0.99]; NULL when a quantile or the threshold is missing.
    """
    n = len(levels)
    gaps = [levels[0], *(b - a for a, b in zip(levels, levels[1:])), 1 - levels[-1]]
    t = threshold.cast("double")

    def below(x: Column) -> Column:
        knot = [x[i] for i in range(n)]
        first = knot[0] - gaps[0] * (knot[1] - knot[0]) / gaps[1]
        last = knot[-1] + gaps[-1] * (knot[-1] - knot[-2]) / gaps[-2]
        ends = [first, *knot, last]
        total = F.lit(0.0)
        for mass, left, right in zip(gaps, ends, ends[1:]):
            atom = F.when(t > left, 1.0).when(t == left, 0.5).otherwise(0.0)
            inside = F.least(F.greatest((t - left) / F.nullif(right - left, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
            total = total + mass * F.when(right > left, inside).otherwise(atom)
        return total

    up = 1 - F.transform(F.array(F.array_sort(q)), below)[0]
    known = F.forall(q, lambda e: e.isNotNull() & ~F.isnan(e)) & t.isNotNull()
    return F.when(known, F.least(F.greatest(up, F.lit(0.01)), F.lit(0.99)))
