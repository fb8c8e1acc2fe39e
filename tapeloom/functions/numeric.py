"""Scalar column helpers: missing is NULL everywhere, never NaN or an infinity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def finite(x: Column) -> Column:
    """NULL for NaN and for both infinities."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def div(a, b) -> Column:
    """a / b, NULL where the quotient is not a finite number."""
    return finite(F.try_divide(as_col(a), as_col(b)))


def ln(x: Column) -> Column:
    return finite(F.log(x))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def ndigits(x: Column, digits: int = 6) -> Column:
    """Rounded copy without a negative zero, for reports and comparisons."""
    return round_binary(x, digits) + F.lit(0.0)


def round_binary(x: Column, digits: int) -> Column:
    """Rounded as SQL engines with binary doubles do: the scaled number goes to the nearest whole one, halves away from zero.

    Spark's ``round`` takes the shortest decimal form of the number instead, so 0.285 becomes 0.29 there and 0.28 here.
    """
    return F.round(x * F.lit(10.0**digits), 0) / F.lit(10.0**digits)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function to double precision.

    Rational approximation published by J. F. Hart (algorithm 5666), in the form given by G. West (2005).
    """
    # Coefficients of the published approximation.
    num = [220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165,
           0.700383064443688, 0.0352624965998911]
    den = [440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461,
           16.064177579207, 1.75566716318264, 0.0883883476483184]

    def poly(coefs, z):
        acc = F.lit(coefs[-1])
        for c in reversed(coefs[:-1]):
            acc = acc * z + F.lit(c)
        return acc

    z = F.abs(x)
    tail = F.exp(-z * z / 2.0) * poly(num, z) / poly(den, z)
    frac = z + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        frac = z + F.lit(k) / frac
    far = F.exp(-z * z / 2.0) / frac / 2.506628274631
    upper = F.when(z > 37.0, F.lit(0.0)).when(z < 7.07106781186547, tail).otherwise(far)
    return F.when(x.isNotNull(), F.when(x > 0, 1.0 - upper).otherwise(upper))


def normal_ppf(p: Column) -> Column:
    """Inverse normal distribution function, NULL outside (0, 1).

    Rational approximation published by M. J. Wichura (algorithm AS 241), good to about 1e-16 relative.
    """
    # Coefficients of the published approximation, for the middle, the tails and the far tails.
    middle = (
        [3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457,
         67265.770927008700853, 33430.575583588128105, 2509.0809287301226727],
        [1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867,
         39307.895800092710610, 28729.085735721942674, 5226.4952788528545610])
    tail = (
        [1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258,
         0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640],
        [1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590,
         0.0151986665636164571966, 0.000547593808499534494600, 0.00000000105075007164441684324])
    far = (
        [6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930,
         0.00124266094738807843860, 0.0000271155556874348757815, 0.000000201033439929228813265],
        [1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 0.000786869131145613259100,
         0.0000184631831751005468180, 0.000000142151175831644588870, 0.00000000000000204426310338993978564])

    def ratio(pair, z):
        top, bottom = F.lit(pair[0][-1]), F.lit(pair[1][-1])
        for a, b in zip(reversed(pair[0][:-1]), reversed(pair[1][:-1])):
            top, bottom = top * z + F.lit(a), bottom * z + F.lit(b)
        return top / bottom

    def value(x):
        q = x - 0.5
        r = F.sqrt(-F.log(F.when(q < 0, x).otherwise(1.0 - x)))
        outer = F.when(r <= 5.0, ratio(tail, r - 1.6)).otherwise(ratio(far, r - 5.0))
        return F.when((x > 0.0) & (x < 1.0), F.when(F.abs(q) <= 0.425, q * ratio(middle, 0.180625 - q * q)).otherwise(F.when(q < 0, -outer).otherwise(outer)))

    # the argument stands in many places: a one-element array evaluates it once
    return F.element_at(F.transform(F.array(p), value), 1)


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.log(q / (1.0 - q))


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))
