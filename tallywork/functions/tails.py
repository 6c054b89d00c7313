"""Tails of the t, F and chi-square distributions as column expressions.

The incomplete beta and gamma functions are folds over a sequence (continued fractions by the modified method of Lentz,
and the power series of gamma), as many steps as the row's parameters need. So p-values and intervals are columns of a
grouped frame, made on the executors. Tails are computed as such, never as 1 - cdf. Nulls and parameters out of range
give null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300
#: From this size of the first parameter on, the beta fraction would need too many steps: an expansion in its place.
LARGE = 40_000.0
State = Callable[[str], Column]


def _d(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("double")


def _let(values: dict[str, Column], body: Callable[[State], Column]) -> Column:
    """``body`` over named values that are made once: without it every use of a value would repeat its expression."""
    packed = F.struct(*(v.alias(k) for k, v in values.items()))
    return F.get(F.transform(F.array(packed), lambda s: body(lambda name: s[name])), F.lit(0))


def _fold(steps: Column, start: dict[str, Column], step: Callable[[State, Column], dict[str, Column]], finish: Callable[[State], Column]) -> Column:
    """Fold named doubles over 1 .. steps."""
    fields = lambda values: F.struct(*(v.cast("double").alias(k) for k, v in values.items()))
    number = F.greatest(F.coalesce(steps, F.lit(1.0)), F.lit(1.0)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), number), fields(start), lambda s, k: fields(step(lambda name: s[name], k.cast("double"))), lambda s: finish(lambda name: s[name]))


def _fraction(steps: Column, c: Column, d: Column, h: Column, term: Callable[[Column], tuple[Column, Column]]) -> Column:
    """Lentz's method from its values c, d and h after the first denominator; ``term`` gives numerators and denominators.

    The factor c * d of a step is taken up by the next one, so that a step makes its term once for each of them.
    """

    def step(s: State, k: Column) -> dict[str, Column]:
        top, bottom = term(k)
        return {"c": bottom + top / s("c") + _TINY, "d": 1.0 / (bottom + top * s("d") + _TINY), "h": F.when(k == 1, s("h")).otherwise(s("h") * s("c") * s("d"))}

    return _fold(steps, {"c": c, "d": d, "h": h}, step, lambda s: s("h") * s("c") * s("d"))


def _stirling_rest(z: Column) -> Column:
    """log gamma minus its leading terms, for z of 10 or more."""
    w = 1.0 / (z * z)
    return (1.0 / 12 - w * (1.0 / 360 - w * (1.0 / 1260 - w * (1.0 / 1680 - w * (1.0 / 1188 - w * (691.0 / 360360)))))) / z


def _log_gamma(x: Column) -> Column:
    product = x
    for k in range(1, 10):
        product = product * (x + float(k))
    raised = _let({"z": F.when(x >= 10, x).otherwise(x + 10.0)}, lambda v: (v("z") - 0.5) * F.log(v("z")) - v("z") + 0.5 * math.log(2 * math.pi) + _stirling_rest(v("z")))
    return F.when(x >= 10, raised).when(x > 0, raised - F.log(product))


def log_gamma(x) -> Column:
    """For positive x; a small argument is raised by ten."""
    return _let({"x": _d(x)}, lambda v: _log_gamma(v("x")))


def log_gamma_ratio(a, b) -> Column:
    """log gamma(a + b) - log gamma(a), without cancellation where a is large."""

    def body(v: State) -> Column:
        a, b, c = v("a"), v("b"), v("a") + v("b")
        large = (a - 0.5) * F.log1p(b / a) + b * F.log(c) - b + _stirling_rest(c) - _stirling_rest(a)
        return F.when(a >= 10, large).otherwise(log_gamma(c) - _log_gamma(a))

    return _let({"a": _d(a), "b": _d(b)}, body)


def gamma_upper(a, x) -> Column:
    """Regularised upper incomplete gamma function."""

    def body(v: State) -> Column:
        a, x, steps = v("a"), v("x"), F.least(F.lit(20_000.0), 60.0 + F.ceil(12.0 * F.sqrt(v("a"))))
        front = F.exp(a * F.log(x) - x - _log_gamma(a))
        start = {"term": 1.0 / a, "total": 1.0 / a}
        series = _fold(steps, start, lambda s, k: {"term": s("term") * x / (a + k), "total": s("total") + s("term") * x / (a + k)}, lambda s: s("total"))
        b = x + 1.0 - a
        fraction = _fraction(steps, F.lit(1.0 / _TINY), 1.0 / b, 1.0 / b, lambda k: (-k * (k - a), b + 2.0 * k))
        return F.when((a <= 0) | a.isNull() | x.isNull(), None).when(x <= 0, 1.0).when(x < a + 1.0, 1.0 - front * series).otherwise(front * fraction)

    return _let({"a": _d(a), "x": _d(x)}, body)


def _beta_by_gamma(a: Column, b: Column, log_x: Column) -> Column:
    """Incomplete beta for large a: the substitution t = exp(-u), expanded in u, gives upper gamma functions.

    Those of b + 2 and b + 4 follow from that of b by its recurrence, whose terms are all positive.
    """

    def body(v: State) -> Column:
        b, t, z = v("b"), v("t"), v("z")
        n = b - 1.0
        second = n / 24.0 * b * (b + 1.0) / (t * t)
        fourth = (n * n / 72.0 - n / 180.0) / 16.0 * b * (b + 1.0) * (b + 2.0) * (b + 3.0) / (t * t * t * t)
        up_two = v("rise") * (1.0 + z / (b + 1.0))
        up_four = up_two + v("rise") * z * z / ((b + 1.0) * (b + 2.0)) * (1.0 + z / (b + 3.0))
        q = v("q")
        return v("front") * (q + second * (q + up_two) + fourth * (q + up_four))

    def named(v: State) -> Column:
        b, t, z = v("b"), v("t"), v("z")
        rise = F.exp(b * F.log(z) - z - log_gamma(b + 1.0))
        return _let({"b": b, "t": t, "z": z, "rise": rise, "q": gamma_upper(b, z), "front": F.exp(log_gamma_ratio(v("a"), b) - b * F.log(t))}, body)

    t = a + (b - 1.0) / 2.0
    return _let({"a": a, "b": b, "t": t, "z": -t * log_x}, named)


def beta_lower(a, b, x, rest=None) -> Column:
    """Regularised incomplete beta function at x; ``rest`` is 1 - x where that is known better."""

    def usual(v: State) -> Column:
        p, q, y = v("p"), v("q"), v("y")
        steps = 2 * F.least(F.lit(1500.0), 30.0 + F.ceil(5.0 * F.sqrt(F.greatest(p, q))))

        def term(k: Column) -> tuple[Column, Column]:
            m = F.floor((k + 1.0) / 2.0).cast("double")
            uneven = m * (q - m) * y / ((p + 2.0 * m - 1.0) * (p + 2.0 * m))
            even = -(p + m) * (p + q + m) * y / ((p + 2.0 * m) * (p + 2.0 * m + 1.0))
            return F.when(k % 2 == 1, uneven).otherwise(even), F.lit(1.0)

        first = 1.0 / (1.0 - (p + q) * y / (p + 1.0) + _TINY)
        tail = F.exp(v("log_front")) * _fraction(steps, F.lit(1.0), first, first, term) / p
        return _let({"tail": tail}, lambda w: F.when(v("low"), w("tail")).otherwise(1.0 - w("tail")))

    def body(v: State) -> Column:
        a, b, x, rest = v("a"), v("b"), v("x"), v("rest")
        log_x, log_rest = F.when(x < 0.5, F.log(x)).otherwise(F.log1p(-rest)), F.when(rest < 0.5, F.log(rest)).otherwise(F.log1p(-x))
        low = x < (a + 1.0) / (a + b + 2.0)
        log_front = log_gamma_ratio(a, b) - log_gamma(b) + a * log_x + b * log_rest
        named = {"low": low, "p": F.when(low, a).otherwise(b), "q": F.when(low, b).otherwise(a), "y": F.when(low, x).otherwise(rest), "log_front": log_front}
        wrong = (a <= 0) | (b <= 0) | a.isNull() | b.isNull() | x.isNull()
        large = (a > LARGE) & (b <= LARGE)
        return F.when(wrong, None).when(x <= 0, 0.0).when(rest <= 0, 1.0).when(large, _beta_by_gamma(a, b, log_x)).otherwise(_let(named, usual))

    x = _d(x)
    return _let({"a": _d(a), "b": _d(b), "x": x, "rest": 1.0 - x if rest is None else _d(rest)}, body)


def chi2_sf(x, df) -> Column:
    return gamma_upper(_d(df) / 2.0, _d(x) / 2.0)


def f_sf(f, df1, df2) -> Column:
    """P(F > f); 1 for f of 0 or less."""
    f, df1, df2 = _d(f), _d(df1), _d(df2)
    whole = df2 + df1 * f
    return F.when(f <= 0, 1.0).otherwise(beta_lower(df2 / 2.0, df1 / 2.0, df2 / whole, df1 * f / whole))


def t_two_sided(t, df) -> Column:
    """P(|T| > |t|)."""
    t, df = _d(t), _d(df)
    whole = df + t * t
    return beta_lower(df / 2.0, 0.5, df / whole, t * t / whole)


def _normal_quantile(p: float) -> float:
    low, high = -40.0, 40.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 0.5 * math.erfc(-middle / math.sqrt(2)) < p else (low, middle)
    return (low + high) / 2


def t_quantile(p: float, df) -> Column:
    """x with P(T <= x) = p, for a level known beforehand: an expansion in 1 / df, mended by Newton's steps on the tail."""
    df = _d(df)
    if p == 0.5:
        return F.when(df > 0, 0.0)
    z, tail = abs(_normal_quantile(p)), 2.0 * min(p, 1.0 - p)
    start = z + (z**3 + z) / 4 / df + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / (df * df) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / (df * df * df)
    log_top = log_gamma_ratio(df / 2.0, 0.5) - 0.5 * F.log(df * math.pi)
    density = lambda t: F.exp(log_top - (df + 1.0) / 2.0 * F.log1p(t * t / df))
    mended = _fold(F.lit(6.0), {"t": start}, lambda s, k: {"t": s("t") + (t_two_sided(s("t"), df) - tail) / (2.0 * density(s("t")))}, lambda s: s("t"))
    two = (1.0 - tail) * math.sqrt(2.0 / (tail * (2.0 - tail)))
    one = math.tan(math.pi * (0.5 - tail / 2))
    size = F.when(df <= 0, None).when(df == 1, one).when(df == 2, two).otherwise(mended)
    return size if p > 0.5 else -size
