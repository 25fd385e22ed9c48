"""Normal quantiles as column expressions; tail probabilities for aggregated test statistics (a handful of rows)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _stirling(n: float) -> float:
    """log(n!) less its Stirling approximation."""
    if n <= 15:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n > 0 else 0.0
    y = 1 / (n * n)
    return (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / n


def _deviance(x: float, mean: float) -> float:
    """``x log(x / mean) + mean - x`` without loss of digits where the two are near."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    total, term, j = (x - mean) * v, 2 * x * v, 1
    while True:
        term *= v * v
        more = total + term / (2 * j + 1)
        if more == total:
            return total
        total, j = more, j + 1


def _most(size: float) -> int:
    """Steps after which a loop over a tail of that size has failed; such loops need a few times its root."""
    return 10_000 + 60 * math.isqrt(int(min(size, 1e13)))


def _beta_tail(a: float, b: float, x: float, y: float) -> float:
    """Regularised incomplete beta at ``x = 1 - y`` by its continued fraction; NaN where that doesn't converge."""
    if not (a > 0 and b > 0) or math.isnan(x):
        return math.nan
    if x <= 0 or y <= 0:
        return 0.0 if x <= 0 else 1.0
    wide = a + (b - 1) / 2
    if b**3 <= 1e-8 * wide * wide:  # Wise's limit: what it leaves out is below b**3 / wide**2
        return _gamma_tail(b, -wide * math.log1p(-y))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_tail(b, a, y, x)
    n = a + b
    log_front = _stirling(n) - _stirling(a) - _stirling(b) - _deviance(a, n * x) - _deviance(b, n * y)
    front = b / n * math.sqrt(n / (2 * math.pi * a * b)) * math.exp(log_front)
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(_most(n)):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or tiny)
        c = (1 + num / c) or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            return front * (f - 1)
    return math.nan


def _gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma; NaN where its loop doesn't converge."""
    if not a > 0 or math.isnan(x):
        return math.nan
    if x <= 0:
        return 1.0
    scale = math.sqrt(a / (2 * math.pi)) * math.exp(-_stirling(a) - _deviance(a, x))
    if x < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(_most(a)):
            n += 1
            term *= x / n
            total += term
            if abs(term) <= abs(total) * 1e-16:
                return 1 - total * scale
        return math.nan
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, _most(a)):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            return h * scale
    return math.nan


def _each(fn, *series: pd.Series) -> pd.Series:
    rows = zip(*[s.astype("float64") for s in series])
    return pd.Series([np.nan if any(v != v for v in r) else fn(*r) for r in rows], index=series[0].index, dtype="float64")


@F.pandas_udf(T.DoubleType())
def f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _each(lambda f, a, b: _beta_tail(b / 2, a / 2, b / (b + a * f), a * f / (b + a * f)) if f > 0 else 1.0, f, d1, d2)


@F.pandas_udf(T.DoubleType())
def t_tail(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided."""
    return _each(lambda t, v: _beta_tail(v / 2, 0.5, v / (v + t * t), t * t / (v + t * t)), t, dof)


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _each(lambda x, v: _gamma_tail(v / 2, x / 2), x, dof)


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    return _each(lambda z: 0.5 * math.erfc(z / math.sqrt(2)), z)


def kolmogorov_tail(lam: Column) -> Column:
    """Limit distribution of the two-sample statistic scaled by ``sqrt(n m / (n + m))``."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(-2 * k * k * lam * lam),
    )
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


# Wichura's rational approximation of the normal quantile, AS 241 (1988), about 16 digits: numerator and
# denominator in the centre, in the shoulders and in the far tails, lowest power first (fixed values).
CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
SHOULDER = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def polynomial(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function; NULL outside (0, 1)."""
    q = p - 0.5
    inner = F.lit(0.180625) - q * q
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    near, far = r - 1.6, r - 5.0
    tail = F.when(r <= 5, polynomial(SHOULDER[0], near) / polynomial(SHOULDER[1], near)).otherwise(
        polynomial(FAR[0], far) / polynomial(FAR[1], far)
    )
    centre = q * polynomial(CENTRE[0], inner) / polynomial(CENTRE[1], inner)
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, centre).otherwise(F.signum(q) * tail))
