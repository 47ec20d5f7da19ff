"""Ordinary least squares per key from one aggregation of cross products."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def ols(df: DataFrame, keys: list[str], y: str, xs: list[str], intercept: bool = True) -> DataFrame:
    """n, coef (intercept first), se, ssr, sst, r2 per key.

    The cross products are plain sums, so Spark combines them before the shuffle; a task
    then solves one small system per key row.
    """
    names = (["_one"] if intercept else []) + list(xs)
    src = df.withColumn("_one", F.lit(1.0)).dropna(subset=[y, *xs])
    p = len(names)
    cross = [F.sum(F.col(a) * F.col(b)).alias(f"x{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    xy = [F.sum(F.col(a) * F.col(y)).alias(f"y{i}") for i, a in enumerate(names)]
    agg = src.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(y) * F.col(y)).alias("yy"),
                                 F.sum(y).alias("sy"), *cross, *xy)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in agg.schema.fields if f.name in keys]
                       + ["n double, coef array<double>, se array<double>, ssr double, sst double, r2 double"])

    def solve(frames):
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                m = np.array([[getattr(r, f"x{min(i, j)}_{max(i, j)}") for j in range(p)] for i in range(p)])
                v = np.array([getattr(r, f"y{i}") for i in range(p)])
                inv = np.linalg.pinv(m)
                b = inv @ v
                ssr = max(r.yy - b @ v, 0.0)
                sst = r.yy - r.sy ** 2 / r.n if intercept else r.yy
                s2 = ssr / (r.n - p) if r.n > p else np.nan
                rows.append((*[getattr(r, k) for k in keys], r.n, list(b), list(np.sqrt(np.abs(np.diag(inv)) * s2)), ssr, sst,
                             1 - ssr / sst if sst > 0 else np.nan))
            yield pd.DataFrame(rows, columns=[*keys, "n", "coef", "se", "ssr", "sst", "r2"])

    return agg.mapInPandas(solve, schema)
