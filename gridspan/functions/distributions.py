"""Probability distributions. Densities and simple laws are Columns; incomplete gamma and beta, which Spark lacks, are
vectorised pandas UDFs, used as little steps inside a projection."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .core import NUM, Val, finite, fx, guarded, number, truth

ROOT_2PI = math.sqrt(2 * math.pi)


@F.pandas_udf(DoubleType())
def lgamma(x: pd.Series) -> pd.Series:
    """Log of the gamma function of positive numbers."""
    return x.map(lambda v: math.lgamma(v) if v > 0 else math.nan)


@F.pandas_udf(DoubleType())
def phi(z: pd.Series) -> pd.Series:
    """Standard normal distribution."""
    return z.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)) if v == v else v)


@F.pandas_udf(DoubleType())
def phi_inverse(p: pd.Series) -> pd.Series:
    """Standard normal quantile."""
    from statistics import NormalDist

    inverse = NormalDist().inv_cdf
    return p.map(lambda v: inverse(v) if 0 < v < 1 else math.nan)


@F.pandas_udf(DoubleType())
def gamma_p(a: pd.Series, x: pd.Series) -> pd.Series:
    """Lower regularised incomplete gamma: series below a + 1, continued fraction above."""

    def one(a, x):
        if not (a > 0 and x >= 0):
            return math.nan
        if x == 0:
            return 0.0
        front = math.exp(a * math.log(x) - x - math.lgamma(a))
        if x < a + 1:
            term = total = 1 / a
            for n in range(1, 10_000):
                term *= x / (a + n)
                total += term
                if term < total * 1e-16:
                    break
            return total * front
        b = x + 1 - a
        c, d = 1e300, 1 / b
        h = d
        for n in range(1, 10_000):
            k = -n * (n - a)
            b += 2
            d = 1 / ((k * d + b) or 1e-300)
            c = (b + k / c) or 1e-300
            h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return 1 - front * h

    return pd.Series([one(u, v) for u, v in zip(a, x, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def beta_i(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
    """Regularised incomplete beta by its continued fraction."""

    def fraction(a, b, x):
        c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
        h = d
        for m in range(1, 10_000):
            k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            d, c = 1 / ((1 + k * d) or 1e-300), (1 + k / c) or 1e-300
            h *= d * c
            k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d, c = 1 / ((1 + k * d) or 1e-300), (1 + k / c) or 1e-300
            h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    def one(a, b, x):
        if not (a > 0 and b > 0 and 0 <= x <= 1):
            return math.nan
        if x in (0, 1):
            return float(x)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
        return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b

    return pd.Series([one(u, v, w) for u, v, w in zip(a, b, x, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def binomial_quantile(n: pd.Series, p: pd.Series, alpha: pd.Series) -> pd.Series:
    """Smallest k whose cumulated probability reaches alpha."""

    def one(n, p, alpha):
        if not (n >= 0 and 0 < p < 1 and 0 < alpha < 1):
            return math.nan
        total, n = 0.0, int(n)
        for k in range(n + 1):
            total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
            if total >= alpha:
                return float(k)
        return float(n)

    return pd.Series([one(*t) for t in zip(n, p, alpha, strict=True)], dtype=float)


def _law(*names: str, n: int):
    """Register a distribution of n numbers and a flag: cumulated or density. f returns (density, cumulated, error rule)."""

    def put(f):
        def run(*args):
            vals, flag = [number(a) for a in args[:n]], truth(args[n])
            density, total, bad = f(*(v.value for v in vals))
            return guarded(F.when(flag.value, total).otherwise(density), (bad, NUM), args=(*vals, flag))

        run.__doc__ = f.__doc__
        return fx(*names, least=n + 1)(run)

    return put


@_law("NORM.DIST", "NORMDIST", n=3)
def norm_dist(x, mean, sd):
    """Normal."""
    z = F.try_divide(x - mean, sd)
    return F.try_divide(F.exp(-z * z / 2), sd * ROOT_2PI), phi(z), sd <= 0


@_law("NORM.S.DIST", n=1)
def norm_s_dist(z):
    """Standard normal."""
    return F.exp(-z * z / 2) / ROOT_2PI, phi(z), F.lit(False)


@fx("NORMSDIST")
def normsdist(z):
    """Standard normal, cumulated."""
    v = number(z)
    return Val(phi(v.value), v.err)


@fx("NORM.S.INV", "NORMSINV")
def norm_s_inv(p):
    """Standard normal quantile."""
    v = number(p)
    return guarded(phi_inverse(v.value), ((v.value <= 0) | (v.value >= 1), NUM), args=(v,))


@fx("NORMINV", "NORM.INV", least=3)
def norminv(p, mean, sd):
    """Normal quantile."""
    v, m, s = number(p), number(mean), number(sd)
    return guarded(m.value + s.value * phi_inverse(v.value), ((v.value <= 0) | (v.value >= 1) | (s.value <= 0), NUM), args=(v, m, s))


@_law("EXPON.DIST", "EXPONDIST", n=2)
def expon(x, rate):
    """Exponential."""
    return rate * F.exp(-rate * x), 1 - F.exp(-rate * x), (x < 0) | (rate <= 0)


@_law("WEIBULL.DIST", "WEIBULL", n=3)
def weibull(x, shape, scale):
    """Weibull."""
    r = F.try_divide(x, scale)
    return F.try_divide(shape, scale) * F.pow(r, shape - 1) * F.exp(-F.pow(r, shape)), 1 - F.exp(-F.pow(r, shape)), (x < 0) | (shape <= 0) | (scale <= 0)


@_law("POISSON.DIST", "POISSON", n=2)
def poisson(x, mean):
    """Poisson."""
    k = F.floor(x).cast("double")
    return F.exp(k * F.ln(mean) - mean - lgamma(k + 1)), 1 - gamma_p(k + 1, mean), (x < 0) | (mean <= 0)


def _choose_log(n: Column, k: Column) -> Column:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


@_law("BINOM.DIST", "BINOMDIST", n=3)
def binom(k, n, p):
    """Binomial."""
    k, n = F.floor(k).cast("double"), F.floor(n).cast("double")
    edge = F.when(p == 0, F.when(k == 0, 1.0).otherwise(0.0)).when(p == 1, F.when(k == n, 1.0).otherwise(0.0))
    density = F.coalesce(edge, F.exp(_choose_log(n, k) + k * F.ln(p) + (n - k) * F.ln(1 - p)))
    total = F.when(k >= n, 1.0).when(p == 1, 0.0).when(p == 0, 1.0).otherwise(beta_i(F.greatest(n - k, F.lit(0.5)), k + 1, 1 - p))
    return density, total, (k < 0) | (k > n) | (p < 0) | (p > 1)


@fx("BINOM.INV", least=3)
def binom_inv(n, p, alpha):
    """Binomial quantile."""
    a, b, c = number(n), number(p), number(alpha)
    return finite(Val(binomial_quantile(F.floor(a.value).cast("double"), b.value, c.value), F.coalesce(a.err, b.err, c.err)))


@_law("NEGBINOM.DIST", "NEGBINOMDIST", n=3)
def negbinom(failures, successes, p):
    """Negative binomial."""
    f, s = F.floor(failures).cast("double"), F.floor(successes).cast("double")
    return F.exp(lgamma(f + s) - lgamma(f + 1) - lgamma(s) + s * F.ln(p) + f * F.ln(1 - p)), beta_i(s, f + 1, p), (f < 0) | (s < 1) | (p <= 0) | (p >= 1)


@_law("GAMMA.DIST", "GAMMADIST", n=3)
def gamma_dist(x, shape, scale):
    """Gamma."""
    r = F.try_divide(x, scale)
    return F.exp((shape - 1) * F.ln(r) - r - lgamma(shape)) / scale, gamma_p(shape, r), (x < 0) | (shape <= 0) | (scale <= 0)


@_law("CHISQ.DIST", n=2)
def chisq(x, df):
    """Chi-squared."""
    k = F.floor(df).cast("double") / 2
    return F.exp((k - 1) * F.ln(x / 2) - x / 2 - lgamma(k)) / 2, gamma_p(k, x / 2), (x <= 0) | (df < 1) | (df >= 1e10)


@fx("CHISQ.DIST.RT", least=2)
def chisq_rt(x, df):
    """Right tail of chi-squared."""
    v, k = number(x), number(df)
    return guarded(1 - gamma_p(F.floor(k.value).cast("double") / 2, v.value / 2), ((v.value <= 0) | (k.value < 1) | (k.value >= 1e10), NUM), args=(v, k))


@_law("F.DIST", "FDIST", n=3)
def f_dist(x, d1, d2):
    """F."""
    a, b = F.floor(d1).cast("double"), F.floor(d2).cast("double")
    log = (a / 2) * F.ln(a / b) + (a / 2 - 1) * F.ln(x) - (a + b) / 2 * F.ln(1 + a * x / b) - (lgamma(a / 2) + lgamma(b / 2) - lgamma((a + b) / 2))
    return F.exp(log), beta_i(a / 2, b / 2, F.try_divide(a * x, a * x + b)), (x < 0) | (a <= 1) | (b <= 1)


@fx("GAMMALN", "GAMMALN.PRECISE")
def gammaln(x):
    """Log of the gamma function."""
    v = number(x)
    return guarded(lgamma(v.value), (v.value <= 0, NUM), args=(v,))


@fx("GAMMA")
def gamma(x):
    """Gamma function; by reflection below zero."""
    v = number(x)
    up = F.exp(lgamma(F.when(v.value > 0, v.value).otherwise(1 - v.value)))
    out = F.when(v.value > 0, up).otherwise(F.try_divide(F.lit(math.pi), F.sin(v.value * math.pi) * up))
    return guarded(out, ((v.value <= 0) & (v.value == F.floor(v.value)) | (v.value > 171), NUM), args=(v,))
