"""Exact tails against closed forms and quadrature."""
import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions.mathx import chi2_sf, t_two_sided
from tidemark.operators import stats as S


def chi2_even(x, df):
    return math.fsum(math.exp(j * math.log(x / 2) - x / 2 - math.lgamma(j + 1)) for j in range(df // 2))


def t_tails(t, n):
    """Both tails by Simpson's rule in the angle, where the density is a power of the cosine."""
    top = math.atan(abs(t) / math.sqrt(n))
    at = np.linspace(top, math.pi / 2, 400_001)
    y = np.cos(at) ** (n - 1)
    area = (4 * y[1::2].sum() + 2 * y[2:-1:2].sum() + y[0] + y[-1]) * (at[1] - at[0]) / 3
    return 2 * area * math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(math.pi)


def test_chi_squared(spark):
    cases = [(float(x), df) for df in (2, 4, 10, 100, 1000, 20000) for x in (1e-6, 0.3 * df, 0.9 * df, df, df + 2.0, 1.1 * df, 3.0 * df)]
    got = spark.createDataFrame(cases, "x double, df int").select(chi2_sf(F.col("x"), F.col("df").cast("double")).alias("p")).toPandas().p
    np.testing.assert_allclose(got, [chi2_even(x, df) for x, df in cases], rtol=1e-8, atol=1e-12)
    one = [0.01, 0.5, 1.0, 3.841458820694124, 30.0]  # one degree of freedom: both normal tails
    got = spark.createDataFrame([(x,) for x in one], "x double").select(chi2_sf(F.col("x"), F.lit(1.0)).alias("p")).toPandas().p
    np.testing.assert_allclose(got, [math.erfc(math.sqrt(x / 2)) for x in one], rtol=1e-10)


def test_student(spark):
    cases = [(t, n) for n in (3, 4, 30, 301, 20000) for t in (0.001, 0.5, 1.96, 4.0, -2.0)]
    got = spark.createDataFrame(cases, "t double, n int").select(t_two_sided(F.col("t"), F.col("n").cast("double")).alias("p")).toPandas().p
    np.testing.assert_allclose(got, [t_tails(t, n) for t, n in cases], rtol=1e-7, atol=1e-10)
    cauchy = [0.0, 0.1, 1.0, 50.0]
    got = spark.createDataFrame([(t,) for t in cauchy], "t double").select(t_two_sided(F.col("t"), F.lit(1.0)).alias("p")).toPandas().p
    np.testing.assert_allclose(got, [1 - 2 * math.atan(t) / math.pi for t in cauchy], rtol=1e-10)


def test_edges_and_the_seam(spark):
    r = spark.range(1).select(chi2_sf(F.lit(0.0), F.lit(5.0)).alias("zero"), chi2_sf(F.lit(None).cast("double"), F.lit(5.0)).alias("null"), chi2_sf(F.lit(3.0), F.lit(0.0)).alias("none"),
                              chi2_sf(F.lit(1e7 + 3000), F.lit(1e7)).alias("a"), chi2_sf(F.lit(1e7 + 3000), F.lit(1e7 + 1e-3)).alias("b"),
                              t_two_sided(F.lit(1.3), F.lit(1e7)).alias("c"), t_two_sided(F.lit(1.3), F.lit(1e7 + 1)).alias("d")).first()
    assert (r.zero, r.null, r.none) == (1.0, None, None)
    assert abs(r.a - r.b) < 1e-7 and abs(r.c - r.d) < 1e-7


def test_independence_of_many_rows(spark, monkeypatch):
    cells = [(0, 0, 400_000_000), (0, 1, 100_000_000), (1, 0, 100_000_000)]  # one cell of four is empty
    monkeypatch.setattr(S, "contingency", lambda *a: spark.createDataFrame(cells, "bx int, by int, n long"))
    got = S.independence(None, "x", "y").first()
    e = {(i, j): r * c / 600_000_000 for i, r in enumerate((500_000_000, 100_000_000)) for j, c in enumerate((500_000_000, 100_000_000))}
    n = {(i, j): k for i, j, k in cells}
    np.testing.assert_allclose(got.statistic, sum((n.get(k, 0) - v) ** 2 / v for k, v in e.items()), rtol=1e-12)
    assert got.df == 1
