"""Scalar helpers as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def steady_sum(x: Column) -> Column:
    """Sum of doubles that does not depend on their order, for comparisons with a limit: added as decimals of 18 places.
    A group with a value that does not fit them is added as doubles."""
    d = F.try_sum(x.try_cast("decimal(38,18)"))
    exact = (F.count(x) == F.count(x.try_cast("decimal(38,18)"))) & d.isNotNull()
    return F.when(exact, d.cast("double")).otherwise(F.sum(x))


def fixed(x: Column, digits: int, unit: str = "") -> Column:
    """`x` with a fixed number of decimals, as C prints it: the exact value of the double is rounded, ties to the even digit.
    `format_string` rounds the shortest decimal instead (0.15, a little under it as a double, to 0.2)."""
    x = x.cast("double")
    text = F.call_function("format_number", x, F.lit("0." + "0" * digits if digits else "0"))
    return F.concat(F.when(F.isnan(x) | (F.abs(x) == float("inf")), x.cast("string")).otherwise(text), F.lit(unit))


def format_magnitude(x: Column, digits: int = 2) -> Column:
    expr = None
    for limit, unit in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")):
        text = fixed(x / limit, digits, unit)
        expr = F.when(F.abs(x) >= limit, text) if expr is None else expr.when(F.abs(x) >= limit, text)
    return expr.otherwise(fixed(x, digits))


def config_key(cols: list[str], prefix: str = "") -> Column:
    """md5 of the parameters as JSON in name order."""
    return F.concat(F.lit(prefix), F.md5(F.to_json(F.struct(*sorted(cols)))))


def equal_width_bin(x: Column, low: Column, high: Column, n: int) -> Column:
    """0-based equal-width bin, last bin closed."""
    return F.least(F.floor((x - low) / ((high - low) / n)), F.lit(n - 1)).cast("int")


def edge_bin(x: Column, edges: Column) -> Column:
    """0-based bin among sorted edges [e0, e1, ...]; the last bin is closed on the right."""
    above = F.size(F.filter(edges, lambda e: e <= x)) - 1
    return F.greatest(F.least(above, F.size(edges) - 2), F.lit(0)).cast("int")


def radical_inverse(index: Column, base: int) -> Column:
    """Van der Corput value of `index` in `base`: mirrors the digits of the id behind the point."""
    digits = 64 if base == 2 else 41
    acc = F.struct(index.cast("long").alias("rest"), F.lit(0.0).alias("x"), F.lit(1.0 / base).alias("w"))
    fold = F.aggregate(
        F.sequence(F.lit(1), F.lit(digits)), acc,
        lambda a, _: F.struct(F.floor(a["rest"] / base).cast("long").alias("rest"),
                              (a["x"] + (a["rest"] % base) * a["w"]).alias("x"), (a["w"] / base).alias("w")))
    return fold["x"]


def zip_lookup(keys: Column, values: Column, key: Column, default: float) -> Column:
    return F.coalesce(F.try_element_at(F.map_from_arrays(keys, values), key), F.lit(default))
