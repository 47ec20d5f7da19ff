"""Path tables for scenario pricing: parameters x path ids -> draws -> aggregates.

A draw is a function of (seed, symbol, path, step), never of the partition, so results
do not change with the number of tasks. `normal` derives draws from md5 digests, which any
SQL engine can repeat; `path_stats` draws whole blocks of paths inside a task with a counter
generator keyed by (seed, symbol, block) and returns one row per path.
"""
from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.mathx import norm_cdf, norm_cdf_sql, z_value
from tidemark.plans.ordered import quantiles
from tidemark.plans.session import materialized

_RES = 2.0 ** 52


def uniforms(*parts) -> tuple[Column, Column]:
    """Two uniforms in (0, 1) from the digest of the joined parts."""
    h = F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))
    def one(at):
        return (F.conv(F.substring(h, at, 13), 16, 10).cast("double") + 0.5) / _RES
    return one(1), one(14)


def normal(*parts) -> Column:
    u1, u2 = uniforms(*parts)
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)


def _dealt(params: DataFrame) -> DataFrame:
    """Symbols dealt over all cores before they are drawn for: their rows are so small that they may stand in one task.
    (One partition more: dealt as by an aggregation before, the rows would stay in its joined partitions.)"""
    spark = params.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism * 2)
    return params.repartition(n + 1, "symbol")


def terminal_prices(params: DataFrame, n_paths: int, n_steps: int, years: float = 1.0, seed: int = 1) -> DataFrame:
    """(symbol, path_id, price) at the horizon. `params` has one row per symbol; steps are summed inside a path's row, so
    no path is shuffled."""
    dt = years / n_steps
    x = _dealt(params).withColumn("path_id", F.explode(F.sequence(F.lit(0), F.lit(n_paths - 1))))
    z = F.aggregate(F.sequence(F.lit(1), F.lit(n_steps)), F.lit(0.0), lambda total, k: total + normal(seed, F.col("symbol"), F.col("path_id"), k))
    return x.withColumn("_z", z).select("symbol", "path_id", "s0", "mu", "sigma", (F.col("s0") * F.exp(
        (F.col("mu") - F.col("sigma") * F.col("sigma") / 2) * years + F.col("sigma") * math.sqrt(dt) * F.col("_z"))).alias("price"))


def price_paths(params: DataFrame, n_paths: int, n_steps: int, years: float = 1.0, seed: int = 1) -> DataFrame:
    """Long path table (symbol, path_id, step, price) with step 0; each path is one row until it explodes."""
    dt = years / n_steps
    x = _dealt(params).withColumn("path_id", F.explode(F.sequence(F.lit(0), F.lit(n_paths - 1))))
    zs = F.transform(F.sequence(F.lit(1), F.lit(n_steps)), lambda k: F.named_struct(F.lit("k"), k, F.lit("z"), normal(seed, F.col("symbol"), F.col("path_id"), k)))
    flat = x.withColumn("e", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("z"))), zs)))
    flat = flat.select("symbol", "path_id", "s0", "mu", "sigma", F.col("e.k").alias("step"), F.col("e.z").alias("z"))
    from tidemark.plans.ordered import running
    r = running(flat, ["symbol", "path_id"], ["step"], {"_cz": ("sum", F.col("z"))}, split=False)  # a path has n_steps rows
    drift = (F.col("mu") - F.col("sigma") * F.col("sigma") / 2) * dt
    return r.select("symbol", "path_id", "step", (F.col("s0") * F.exp(drift * F.col("step") + F.col("sigma") * math.sqrt(dt) * F.col("_cz"))).alias("price"))


STATS = "symbol string, path_id long, s0 double, mu double, sigma double, terminal double, mean double, geo double, high double, low double"


def _draw(r, m: int, n_steps: int, years: float, seed: int) -> dict[str, np.ndarray]:
    """Statistics of the `m` paths of a unit (symbol, block)."""
    dt = years / n_steps
    rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, zlib.crc32(str(r.symbol).encode()), int(r.block)])))
    x = rng.standard_normal((m, n_steps))
    x *= r.sigma * math.sqrt(dt)
    x += (r.mu - r.sigma ** 2 / 2) * dt
    np.cumsum(x, axis=1, out=x)
    lo, hi, geo = np.minimum(x.min(1), 0.0), np.maximum(x.max(1), 0.0), x.sum(1) / (n_steps + 1)
    end = x[:, -1].copy()
    np.exp(x, out=x)
    return {"terminal": r.s0 * np.exp(end), "mean": r.s0 * (x.sum(1) + 1) / (n_steps + 1), "geo": r.s0 * np.exp(geo), "high": r.s0 * np.exp(hi), "low": r.s0 * np.exp(lo)}


def path_stats(params: DataFrame, n_paths: int, n_steps: int, years: float = 1.0, seed: int = 1, block: int = 4096) -> DataFrame:
    """One row per path: terminal, arithmetic and geometric mean (start included), high, low.

    Work is cut into (symbol, block) units that spread over the cluster; a unit draws `block` paths
    as one matrix and never leaves its task.
    """
    n_blocks = math.ceil(n_paths / block)

    def run(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                x = _draw(r, min(block, n_paths - r.block * block), n_steps, years, seed)
                yield pd.DataFrame({"symbol": r.symbol, "path_id": r.block * block + np.arange(len(x["terminal"])), "s0": r.s0, "mu": r.mu, "sigma": r.sigma, **x})

    units = params.select("symbol", F.col("s0").cast("double").alias("s0"), F.col("mu").cast("double").alias("mu"), F.col("sigma").cast("double").alias("sigma"),
                          F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    tasks = max(params.sparkSession.sparkContext.defaultParallelism * 2, 1)
    return units.repartition(tasks, "symbol", "block").mapInPandas(run, STATS)


def nearest_correlation(c: np.ndarray, floor: float = 1e-8) -> np.ndarray:
    """Symmetric, unit diagonal, eigenvalues at least `floor`."""
    c = (c + c.T) / 2
    w, v = np.linalg.eigh(c)
    if w.min() < floor:
        c = v @ np.diag(np.maximum(w, floor)) @ v.T
    d = np.sqrt(np.diag(c))
    return c / np.outer(d, d)


def cholesky(corr: DataFrame, limit: int = 2000) -> tuple[list[str], np.ndarray]:
    """Symbols in order and the lower factor of a pairwise correlation table. The matrix is a driver
    parameter, so its size is checked first."""
    n = corr.where("sym_i = sym_j").count()
    if n > limit:
        raise ValueError(f"{n} symbols: a driver-side factor is limited to {limit}")
    rows = corr.collect()
    names = sorted({r.sym_i for r in rows})
    at = {s: i for i, s in enumerate(names)}
    m = np.eye(len(names))
    for r in rows:
        m[at[r.sym_i], at[r.sym_j]] = m[at[r.sym_j], at[r.sym_i]] = r[2]
    return names, np.linalg.cholesky(nearest_correlation(m))


def correlated_normals(ids: DataFrame, names: list[str], factor: np.ndarray, seed: int = 1) -> DataFrame:
    """One row per id with `z`, an array of correlated normals in symbol order. `ids` keeps its columns;
    every one of them keys the draw."""
    n = len(names)
    eps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: normal(seed, *[F.col(c) for c in ids.columns], j))

    def product(e):
        return F.array(*[sum((e[j] * float(factor[i, j]) for j in range(1, i + 1)), e[0] * float(factor[i, 0])) for i in range(n)])

    return ids.select(*ids.columns, _once(F.transform(F.array(eps), product)[0]).alias("z"))


def _once(c: Column) -> Column:
    """Generated, so that later filters and columns read the value instead of repeating its expression (the bound
    variable of a `transform` does the same inside an expression)."""
    return F.explode(F.array(c))


def t_quantile(u: Column, df: float) -> Column:
    """Student t quantile: closed form for 1, 2 and 4 degrees of freedom, else a vectorized inversion."""
    if df == 1:
        return F.tan(math.pi * (u - 0.5))
    if df == 2:
        return (2 * u - 1) / F.sqrt(2 * u * (1 - u))
    if df == 4:
        a = F.sqrt(4 * u * (1 - u))
        q = F.cos(F.acos(a) / 3) / a
        return F.signum(u - 0.5) * 2 * F.sqrt(q - 1)

    @F.pandas_udf("double")
    def inv(p: pd.Series) -> pd.Series:
        grid = np.tan(np.linspace(-math.pi / 2 + 1e-7, math.pi / 2 - 1e-7, 400_001))
        logd = -(df + 1) / 2 * np.log1p(grid ** 2 / df)
        dens = np.exp(logd)
        cdf = np.concatenate([[0.0], np.cumsum((dens[1:] + dens[:-1]) / 2 * np.diff(grid))])
        return pd.Series(np.interp(p.to_numpy(), cdf / cdf[-1], grid))

    return inv(u)


def contract_values(stats: DataFrame, contracts: DataFrame, rate: float = 0.05, years: float = 1.0) -> DataFrame:
    """Price, standard error and barrier hit rate per contract.

    contracts: symbol, contract, style (european, asian, asian_geo, up-and-out, up-and-in, down-and-out,
    down-and-in), kind (call, put), strike, barrier, rebate.
    """
    c = F.col
    j = stats.join(contracts.hint("merge"), "symbol")  # the size of drawn paths is not known before they are drawn: never broadcast
    level = F.when(c("style") == "asian", c("mean")).when(c("style") == "asian_geo", c("geo")).otherwise(c("terminal"))
    plain = F.greatest(F.when(c("kind") == "call", level - c("strike")).otherwise(c("strike") - level), F.lit(0.0))
    hit = F.when(c("style").startswith("up"), c("high") >= c("barrier")).when(c("style").startswith("down"), c("low") <= c("barrier"))
    rebate = F.coalesce("rebate", F.lit(0.0))
    pay = F.when(c("style").endswith("-out"), F.when(hit, rebate).otherwise(plain)).when(c("style").endswith("-in"), F.when(hit, plain).otherwise(rebate)).otherwise(plain)
    disc = math.exp(-rate * years)
    return j.groupBy("symbol", "contract").agg((disc * F.avg(pay)).alias("price"), (disc * F.stddev_pop(pay) / F.sqrt(F.count(F.lit(1)))).alias("standard_error"),
                                               F.avg(hit.cast("double")).alias("hit_rate"))


def _payoffs(r, x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray | None]:
    """Payoff of a contract on each path, and whether its barrier was hit; NaN stands for null, as in `contract_values`."""
    style = r.style if isinstance(r.style, str) else ""
    level = x["mean"] if style == "asian" else x["geo"] if style == "asian_geo" else x["terminal"]
    plain = np.fmax(level - r.strike if r.kind == "call" else r.strike - level, 0.0)
    hit = None
    if r.barrier == r.barrier and style.startswith(("up", "down")):
        hit = x["high"] >= r.barrier if style.startswith("up") else x["low"] <= r.barrier
    if style.endswith("-out") and hit is not None:
        return np.where(hit, r.rebate, plain), hit
    if style.endswith("-in"):
        return np.where(hit, plain, r.rebate) if hit is not None else np.full(len(plain), r.rebate), hit
    return plain, hit


def block_contract_values(params: DataFrame, contracts: DataFrame, n_paths: int, n_steps: int, rate: float = 0.05, years: float = 1.0,
                          seed: int = 1, block: int = 4096) -> DataFrame:
    """`contract_values` of `path_stats` without a row per path: a unit (symbol, block) meets its contracts before it is drawn,
    and hands on count, mean, squared deviations and hits per contract."""
    n_blocks = math.ceil(n_paths / block)

    def run(frames):
        unit, x = None, None
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                if (r.symbol, r.block) != unit:
                    unit, x = (r.symbol, r.block), _draw(r, min(block, n_paths - r.block * block), n_steps, years, seed)
                pay, hit = _payoffs(r, x)
                mean = float(pay.mean())
                out.append((r.symbol, r.contract, len(pay), mean, float(((pay - mean) ** 2).sum()), 0 if hit is None else len(hit), 0 if hit is None else int(hit.sum())))
            if out:
                yield pd.DataFrame(out, columns=["symbol", "contract", "n", "mean", "dev", "judged", "hits"])

    num = lambda c: F.col(c).cast("double").alias(c)
    units = (params.select("symbol", num("s0"), num("mu"), num("sigma"))
             .join(contracts.select("symbol", "contract", "style", "kind", num("strike"), num("barrier"), F.coalesce(F.col("rebate").cast("double"), F.lit(0.0)).alias("rebate")), "symbol")
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))))
    tasks = max(int(params.sparkSession.conf.get("spark.sql.shuffle.partitions")), params.sparkSession.sparkContext.defaultParallelism * 2)
    kind = contracts.schema["contract"].dataType.simpleString()
    parts = units.repartition(tasks, "symbol", "block").sortWithinPartitions("symbol", "block").mapInPandas(
        run, f"symbol string, contract {kind}, n long, mean double, dev double, judged long, hits long")
    n, disc = F.col("_n"), math.exp(-rate * years)
    g = parts.groupBy("symbol", "contract").agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("mean")).alias("_s"), F.sum("dev").alias("_w"),
                                                F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("_q"), F.sum("judged").alias("_j"), F.sum("hits").alias("_h"), F.count(F.lit(1)).alias("_b"))
    mean = F.col("_s") / n
    between = F.when(F.col("_b") > 1, F.greatest(F.col("_q") / n - mean * mean, F.lit(0.0))).otherwise(0.0)
    return g.select("symbol", "contract", (disc * mean).alias("price"), (disc * F.sqrt(F.col("_w") / n + between) / F.sqrt(n)).alias("standard_error"),
                    F.try_divide(F.col("_h").cast("double"), F.col("_j").cast("double")).alias("hit_rate"))


def delta(stats: DataFrame, contracts: DataFrame, rate: float = 0.05, years: float = 1.0, bump: float = 0.01) -> DataFrame:
    """Finite-difference delta: the same draws scaled by 1 + bump."""
    up = stats.withColumns({k: F.col(k) * (1 + bump) for k in ("terminal", "mean", "geo", "high", "low")})
    a = contract_values(stats, contracts, rate, years).select("symbol", "contract", F.col("price").alias("_a"))
    b = contract_values(up, contracts, rate, years).select("symbol", "contract", F.col("price").alias("_b"))
    s0 = stats.groupBy("symbol").agg(F.first("s0").alias("s0"))
    return a.join(b, ["symbol", "contract"]).join(s0, "symbol").select("symbol", "contract", ((F.col("_b") - F.col("_a")) / (F.col("s0") * bump)).alias("delta"))


def reduction_estimators(params: DataFrame, n_paths: int, rate: float, years: float, new_drift: float, seed: int = 1) -> DataFrame:
    """At-the-money call by plain, antithetic, control-variate and importance estimators, with variance
    ratios against plain. One terminal draw per path."""
    c = F.col
    x = _dealt(params).withColumn("path_id", F.explode(F.sequence(F.lit(0), F.lit(n_paths - 1)))).withColumn("z", normal(seed, c("symbol"), F.col("path_id"), 1))
    root, disc = math.sqrt(years), math.exp(-rate * years)
    def end(z, mu):
        return c("s0") * F.exp((mu - c("sigma") * c("sigma") / 2) * years + c("sigma") * root * z)
    def pay(s):
        return disc * F.greatest(s - c("s0"), F.lit(0.0))
    theta = (new_drift - rate) / c("sigma")
    ratio = F.exp(-theta * root * c("z") - theta * theta * years / 2)
    x = x.select("symbol", pay(end(c("z"), rate)).alias("p"), pay(end(-c("z"), rate)).alias("q"), (disc * end(c("z"), rate)).alias("k"), "s0",
                 (pay(end(c("z"), new_drift)) * ratio).alias("w"))
    beta = F.covar_samp("p", "k") / F.var_pop("k")
    g = x.groupBy("symbol").agg(F.avg("p").alias("plain"), F.var_pop("p").alias("plain_var"), F.avg((c("p") + c("q")) / 2).alias("antithetic"),
                                F.var_pop((c("p") + c("q")) / 2).alias("antithetic_var"), beta.alias("beta"), (F.avg("p") - beta * (F.avg("k") - F.max("s0"))).alias("control"),
                                (F.var_pop("p") + beta * beta * F.var_pop("k") - 2 * beta * F.covar_pop("p", "k")).alias("control_var"),
                                F.avg("w").alias("importance"), F.var_pop("w").alias("importance_var"))
    return g.withColumns({f"{n}_ratio": F.try_divide("plain_var", f"{n}_var") for n in ("antithetic", "control", "importance")})


def chain_paths(start: DataFrame, matrix: DataFrame, values: DataFrame, n_paths: int, n_steps: int, seed: int = 1, block: int = 1024) -> DataFrame:
    """Resample historical transitions: (symbol, path_id, step, price) from 100.

    start(symbol, state), matrix(symbol, i, j, p), values(symbol, state, mean): a chain's matrix travels with
    its unit of paths as one array; its size is the number of states squared.
    """
    m = matrix.groupBy("symbol").agg(F.collect_list(F.struct("i", "j", "p")).alias("m"))
    v = values.groupBy("symbol").agg(F.collect_list(F.struct("state", "mean")).alias("v"))
    n_blocks = math.ceil(n_paths / block)

    def frame(out):
        return pd.DataFrame({"symbol": np.repeat(np.array([s for s, _, _ in out], object), [p.size for _, _, p in out]),
                             "path_id": np.concatenate([np.repeat(first + np.arange(len(p)), n_steps + 1) for _, first, p in out]),
                             "step": np.concatenate([np.tile(np.arange(n_steps + 1), len(p)) for _, _, p in out]), "price": np.concatenate([p.ravel() for _, _, p in out])})

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                k = 1 + max(max(e["i"], e["j"]) for e in r.m)
                k = max(k, 1 + max(e["state"] for e in r.v))
                p, val = np.zeros((k, k)), np.zeros(k)
                for e in r.m:
                    p[e["i"], e["j"]] = e["p"]
                for e in r.v:
                    val[e["state"]] = e["mean"]
                dead = p.sum(1) == 0
                p[dead, dead.nonzero()[0]] = 1.0
                cum = np.cumsum(p, axis=1)
                n = min(block, n_paths - r.block * block)
                rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, zlib.crc32(str(r.symbol).encode()), int(r.block)])))
                s, path = np.full(n, r.state), np.empty((n, n_steps + 1))
                path[:, 0] = 100.0
                for t in range(1, n_steps + 1):
                    s = np.minimum((rng.random(n)[:, None] > cum[s]).sum(1), k - 1)
                    path[:, t] = path[:, t - 1] * (1 + val[s])
                out.append((r.symbol, r.block * block, path))
                if sum(p.size for _, _, p in out) >= 200_000:  # prices of an Arrow batch
                    yield frame(out)
                    out = []
            if out:
                yield frame(out)

    chains = materialized(start.join(m, "symbol").join(v, "symbol"))  # a row per symbol: paths are drawn anew by each reader, chains are not fitted anew
    units = chains.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    tasks = max(start.sparkSession.sparkContext.defaultParallelism * 2, 1)
    return units.select("symbol", "state", "m", "v", "block").repartition(tasks, "symbol", "block").mapInPandas(
        run, "symbol string, path_id long, step long, price double")


def monte_carlo_var(params: DataFrame, n: int, levels=(0.95, 0.99, 0.999), seed: int = 1, split=False) -> DataFrame:
    """Quantiles of n draws from N(mean, std) per key: params(symbol, mean, std)."""
    from tidemark.operators.risk import tag
    x = _dealt(params).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    x = x.select("symbol", (F.col("mean") + F.col("std") * normal(seed, F.col("symbol"), F.col("draw"))).alias("ret"))
    return quantiles(x, ["symbol"], "ret", {f"var_{tag(c)}": round(1 - c, 12) for c in levels}, split=split)


def simulated_returns(ids: DataFrame, names: list[str], factor: np.ndarray, mean: list[float], std: list[float], df: float | None = None, seed: int = 1) -> DataFrame:
    """Row per id with `r`, the simulated return of each symbol; `df` switches to t marginals."""
    x = correlated_normals(ids, names, factor, seed)
    if df in (1, 2, 4):  # closed forms
        x = x.withColumn("_u", F.expr(f"transform(z, v -> {norm_cdf_sql('v')})"))
        moved = F.transform(F.transform("_u", lambda u: t_quantile(u, df)), lambda t, i: F.array(*map(F.lit, mean))[i] + F.array(*map(F.lit, std))[i] * t)
        return x.select(*ids.columns, _once(moved).alias("r"))
    if df is not None:
        for i in range(len(names)):
            x = x.withColumn(f"_z{i}", F.col("z")[i]).withColumn(f"_u{i}", norm_cdf(f"_z{i}"))
        draws = [t_quantile(F.col(f"_u{i}"), df) for i in range(len(names))]
    else:
        draws = [F.col("z")[i] for i in range(len(names))]
    return x.select(*ids.columns, F.array(*[mean[i] + std[i] * d for i, d in enumerate(draws)]).alias("r"))


def portfolio_draws(sim: DataFrame, weights: dict[str, float], names: list[str]) -> Column:
    return sum((float(weights.get(n, 0.0)) * F.col("r")[i] for i, n in enumerate(names)), F.lit(0.0))


def portfolio_var(sim: DataFrame, weights: dict[str, float], names: list[str], level: float = 0.95) -> DataFrame:
    """VaR of the simulated portfolio and correlation-based contributions, one row per symbol."""
    x = sim.withColumn("_p", portfolio_draws(sim, weights, names)).withColumn("g", F.lit(1))
    var = quantiles(x, ["g"], "_p", {"q": round(1 - level, 12)})
    agg = x.groupBy("g").agg(*[F.struct(F.lit(n).alias("symbol"), (F.corr("_p", F.col("r")[i]) * F.stddev_pop(F.col("r")[i]) / F.stddev_pop("_p")).alias("marginal"),
                                        F.lit(float(weights.get(n, 0.0))).alias("w")).alias(f"_s{i}") for i, n in enumerate(names)])
    tall = agg.select("g", F.explode(F.array(*[F.col(f"_s{i}") for i in range(len(names))])).alias("e")).select("g", "e.*")
    return tall.join(var, "g").select("symbol", "marginal", (F.col("w") * F.col("marginal")).alias("component"), (-F.col("q")).alias("portfolio_var"))


def tail_scenario(sim: DataFrame, names: list[str], confidence: float) -> DataFrame:
    """Median return of each symbol over the worst (1 - confidence) share of equal-weight outcomes."""
    w = {n: 1 / len(names) for n in names}
    x = sim.withColumn("_p", portfolio_draws(sim, w, names)).withColumn("g", F.lit(1))
    cut = quantiles(x, ["g"], "_p", {"q": round(1 - confidence, 12)})
    tail = materialized(x.join(F.broadcast(cut), "g").where("_p <= q").select("r"))  # one row; the quantiles read the tail more than once
    tall = tail.select(F.explode(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("symbol"), F.col("r").alias("ret"))).alias("e")).select("e.*")
    return quantiles(tall, ["symbol"], "ret", {"shock": 0.5})
