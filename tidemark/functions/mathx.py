"""Normal distribution and tail probabilities as column expressions.

The text builders return expressions that Spark SQL and other SQL engines share, so the
same formula stays inside whole-stage codegen and can be cross-checked elsewhere.
"""
from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, functions as F

_N = NormalDist()


def z_value(p: float) -> float:
    """Standard normal quantile as a plan-time constant."""
    return _N.inv_cdf(p)


# Rational approximation of the normal tail (Hart 1968, double precision; Numer. and Denom.).
_HART_N = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
           221.213596169931, 220.206867912376)
_HART_D = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
           637.333633378831, 793.826512519948, 440.413735824752)
# Rational approximation of the normal quantile (Acklam), relative error below 1.2e-9.
_ACK_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
          -3.066479806614716e+01, 2.506628277459239e+00)
_ACK_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
          -1.328068155288572e+01)
_ACK_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
          4.374664141464968e+00, 2.938163982698783e+00)
_ACK_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)


def _horner(coef, x: str) -> str:
    out = f"cast({coef[0]!r} as double)"
    for c in coef[1:]:
        out = f"({out} * {x} + cast({c!r} as double))"
    return out


def norm_cdf_sql(x: str) -> str:
    a = f"abs({x})"
    tail = (f"case when {a} > 37 then cast(0 as double) when {a} < 7.07106781186547 then exp(-{a} * {a} / 2) * "
            f"{_horner(_HART_N, a)} / {_horner(_HART_D, a)} else exp(-{a} * {a} / 2) / "
            f"({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65))))) / 2.506628274631 end")
    return f"(case when {x} > 0 then 1 - ({tail}) else {tail} end)"


def norm_ppf_sql(p: str) -> str:
    low, mid = f"sqrt(-2 * ln({p}))", f"({p} - 0.5)"
    high = f"sqrt(-2 * ln(1 - {p}))"
    sq = f"({mid} * {mid})"
    return (f"(case when {p} < 0.02425 then {_horner(_ACK_C, low)} / {_horner((*_ACK_D, 1.0), low)} "
            f"when {p} > 0.97575 then -({_horner(_ACK_C, high)}) / {_horner((*_ACK_D, 1.0), high)} "
            f"else {_horner(_ACK_A, sq)} * {mid} / {_horner((*_ACK_B, 1.0), sq)} end)")


def norm_cdf(c: str) -> Column:
    return F.expr(norm_cdf_sql(c))


def norm_ppf(c: str) -> Column:
    return F.expr(norm_ppf_sql(c))


def chi2_sf_even(x: Column, df: int) -> Column:
    """Upper tail of chi-squared for even degrees of freedom: a finite Poisson sum."""
    if df % 2:
        raise ValueError("even degrees of freedom only")
    term, total = F.lit(1.0), F.lit(1.0)
    for i in range(1, df // 2):
        term = term * (x / 2) / i
        total = total + term
    return F.exp(-x / 2) * total


#: Degrees of freedom above which the normal equivalents take over (their error there is below 1e-8).
MANY = 1e7


def _named(build, **cols: Column) -> Column:
    """`build` over the columns as fields of one lambda variable, so that each is worked out once."""
    return F.element_at(F.transform(F.array(F.struct(*[v.cast("double").alias(k) for k, v in cols.items()])), build), 1)


def _repeat(steps: Column, start: dict[str, Column], step) -> Column:
    """Struct of doubles after `steps` steps `step(struct, number)`."""
    pack = lambda d: F.struct(*[v.cast("double").alias(k) for k, v in d.items()])
    return F.aggregate(F.sequence(F.lit(1), steps.cast("int")), pack(start), lambda acc, i: pack(step(acc, i.cast("double"))))


def _steps(a: Column) -> Column:
    """Series and fractions below settle within some ten times the root of the larger parameter."""
    return 100 + 12 * F.sqrt(a)


def _upper_gamma(s: Column) -> Column:
    """Q(a, x) for fields a, x > 0: series of P below a + 1, continued fraction of Q above."""
    a, x = s["a"], s["x"]
    b = a + 10  # x^a e^-x / gamma(a), by Stirling's series at a + 10 in a form that does not cancel for large a
    d = (x - b) / b
    tail = 1 / (12 * b) - 1 / (360 * b * b * b) + 1 / (1260 * F.pow(b, 5)) - 1 / (1680 * F.pow(b, 7))
    front = F.exp(b * (F.log1p(d) - d) + 0.5 * F.log(b / (2 * math.pi)) - tail + sum((F.log((a + i) / x) for i in range(10)), F.lit(0.0)))
    low = _repeat(_steps(a), {"t": 1 / a, "s": 1 / a}, lambda v, i: {"t": v["t"] * x / (a + i), "s": v["s"] + v["t"] * x / (a + i)})

    def lentz(v, i):
        an, b = -i * (i - a), x + 1 - a + 2 * i
        c, d = b + an / v["c"], 1 / (an * v["d"] + b)
        return {"c": c, "d": d, "h": v["h"] * c * d}

    first = 1 / (x + 1 - a)
    high = _repeat(_steps(a), {"c": F.lit(1e300), "d": first, "h": first}, lentz)
    return F.when(x < a + 1, F.greatest(F.lit(0.0), 1 - front * low["s"])).otherwise(front * high["h"])


def chi2_sf(x: Column, df: Column) -> Column:
    """Upper tail of chi-squared: the regularized incomplete gamma function, to about 1e-12 up to `MANY` degrees of
    freedom, the Wilson-Hilferty normal equivalent beyond. 1 where x <= 0; null where an input is null or df <= 0."""
    exact = _named(_upper_gamma, a=df / 2, x=x / 2)
    z = (F.pow(x / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    many = F.element_at(F.transform(F.array(z), lambda v: _cdf_of(-v)), 1)
    return F.when((df > 0) & (x <= 0), 1.0).when((df > 0) & (df <= MANY), exact).when(df > 0, many)


def _cdf_of(v: Column) -> Column:
    """The Hart approximation as a column, for a lambda variable."""
    def poly(coef, x):
        out = F.lit(coef[0])
        for c in coef[1:]:
            out = out * x + F.lit(c)
        return out
    a = F.abs(v)
    tail = F.when(a > 37, F.lit(0.0)).otherwise(F.exp(-a * a / 2) * poly(_HART_N, a) / poly(_HART_D, a))
    return F.when(v > 0, 1 - tail).otherwise(tail)


def _beta_fraction(x: Column, a: Column, b: Column, steps: Column) -> Column:
    """Continued fraction of the incomplete beta function, two terms a step."""
    def term(v, aa):
        d, c = 1 / (1 + aa * v["d"]), 1 + aa / v["c"]
        return {"c": c, "d": d, "h": v["h"] * c * d}

    def step(v, m):
        one = term(v, m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m)))
        return term(one, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m)))

    first = 1 / (1 - (a + b) * x / (a + 1))
    return _repeat(steps, {"c": F.lit(1.0), "d": first, "h": first}, step)["h"]


def _two_tails(s: Column) -> Column:
    """I_x(a, 1/2) at x = n / (n + t^2), a = n / 2."""
    t2, n, half = s["t2"], s["n"], F.lit(0.5)
    a, x, y = n / 2, n / (n + t2), t2 / (n + t2)
    b = a + 20  # gamma(a + 1/2) / gamma(a): its asymptotic series at a + 20, carried back
    ratio = F.sqrt(b) * (1 - 1 / (8 * b) + 1 / (128 * b * b) + 5 / (1024 * F.pow(b, 3)) - 21 / (32768 * F.pow(b, 4)) - 399 / (262144 * F.pow(b, 5))
                         + 869 / (4194304 * F.pow(b, 6)))
    for i in range(20):
        ratio = ratio * ((a + i) / (a + i + 0.5))
    front = ratio / math.sqrt(math.pi) * F.exp(-a * F.log1p(t2 / n)) * F.sqrt(y)
    return F.when(x < (a + 1) / (a + 2.5), front * _beta_fraction(x, a, half, _steps(a)) / a).otherwise(1 - front * _beta_fraction(y, half, a, _steps(a)) / half)


def t_two_sided(t: Column, n: Column) -> Column:
    """Two-sided p of a t statistic with n degrees of freedom: the regularized incomplete beta function up to `MANY`,
    the normal equivalent (Wallace) beyond. Null where an input is null or n <= 0."""
    exact = _named(_two_tails, t2=t * t, n=n)
    z = F.sqrt(n * F.log1p(t * t / n)) * (8 * n + 1) / (8 * n + 3)
    many = F.element_at(F.transform(F.array(z), lambda v: 2 * _cdf_of(-v)), 1)
    return F.when((n > 0) & (t == 0), 1.0).when((n > 0) & (n <= MANY), exact).when(n > 0, many)
