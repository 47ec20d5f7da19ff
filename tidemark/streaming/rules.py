"""Sequential rules (init, advance) shared by the batch runner and the streaming processor."""
from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque

import numpy as np

# Trend model of price, trend and acceleration; volatility model of log volatility.
TREND_F = [[1.0, 1.0, 0.5], [0.0, 1.0, 1.0], [0.0, 0.0, 1.0]]
TREND_Q = [0.01, 0.0001, 0.0001]
TREND_START = ([100.0, 0.0, 0.0], [1.0, 0.1, 0.01])
TREND_R = 0.01
VOL_F, VOL_Q, VOL_R, VOL_START = 0.99, 0.0001, 0.01, (math.log(0.2), 0.1)


class RollingRisk:
    """Last `lookback` prices per symbol; VaR and annual volatility once `warm` returns exist."""
    inputs, outputs = ["price"], "n int, var_95 double, vol double"

    def __init__(self, lookback: int = 252, warm: int = 30, level: float = 0.95):
        self.lookback, self.warm, self.p = lookback, warm, 1 - level

    def init(self):
        return (None, deque(), [])

    def advance(self, state, price):
        last, rets, ranked = state
        if last is not None:
            r = price / last - 1
            rets.append(r)
            insort(ranked, r)
            if len(rets) > self.lookback - 1:
                ranked.pop(bisect_left(ranked, rets.popleft()))
        n = len(rets)
        if n < self.warm:
            return (price, rets, ranked), (n, None, None)
        at = (n - 1) * self.p
        k = int(at)
        var = ranked[k] + (ranked[min(k + 1, n - 1)] - ranked[k]) * (at - k)
        return (price, rets, ranked), (n, var, float(np.std(ranked)) * math.sqrt(252))


class PreviousPrice:
    """Price before each tick."""
    inputs, outputs = ["price"], "prev double"

    def init(self):
        return None

    def advance(self, state, price):
        return price, (state,)


class Activity:
    """Ticks, first and last price of a key until it falls silent."""
    inputs, outputs, closes = ["price"], "seen bigint", "ticks bigint, first_price double, last_price double"

    def init(self):
        return (0, None, None)

    def advance(self, state, price):
        n, first, _ = state
        return (n + 1, price if n == 0 else first, price), (n + 1,)

    def closing(self, state):
        return state


class FireOnce:
    """First crossing of an alert; later ones stay silent."""
    inputs, outputs = ["crossed"], "fired boolean"

    def init(self):
        return False

    def advance(self, state, crossed):
        return state or bool(crossed), (bool(crossed) and not state,)


class PortfolioRisk:
    """Value, VaR, ES, volatility, drawdown, Sharpe, concentration of a portfolio.

    A row is one tick of one holding. Metrics of the finished `bucket` come out with the first tick of
    the next; state is one price and quantity per holding and the last `window` returns.
    """
    inputs = ["symbol", "quantity", "price", "bucket"]
    outputs = ("done string, value double, var_95 double, var_99 double, expected_shortfall double, volatility double, drawdown double, "
               "sharpe double, concentration double")

    def __init__(self, window: int = 252, warm: int = 10, rf: float = 0.02):
        self.window, self.warm, self.rf = window, warm, rf

    def init(self):
        return {"mv": {}, "value": 0.0, "peak": 0.0, "rets": deque(maxlen=self.window), "bucket": None}

    def _metrics(self, s):
        if len(s["rets"]) < self.warm:
            return (None,) * 9
        r, v = np.fromiter(s["rets"], float), s["value"]
        p5, p1 = np.percentile(r, [5, 1])
        vol = float(r.std() * math.sqrt(252))
        size = sum(abs(x) for x in s["mv"].values())
        hhi = sum((abs(x) / size) ** 2 for x in s["mv"].values()) if size else 1.0
        return (s["bucket"], v, float(p5 * v), float(p1 * v), float(r[r <= p5].mean() * v), vol, (s["peak"] - v) / s["peak"],
                (float(r.mean()) * 252 - self.rf) / vol if vol > 0 else 0.0, hhi)

    def advance(self, s, symbol, quantity, price, bucket):
        out = self._metrics(s) if s["bucket"] not in (None, bucket) else (None,) * 9
        s["bucket"], s["mv"][symbol] = bucket, quantity * price
        value = sum(s["mv"].values())
        if value > 0:
            if s["value"] > 0:
                s["rets"].append(value / s["value"] - 1)
            s["value"], s["peak"] = value, max(s["peak"], value)
        return s, out


class TrendFilter:
    """Linear Kalman filter on price: state, one-step log-likelihood. `adapt` > 0 re-estimates the
    observation noise from the innovations."""
    inputs, outputs = ["price"], "level double, trend double, acceleration double, log_likelihood double, obs_noise double"

    def __init__(self, adapt: float = 0.0):
        self.adapt = adapt
        self.f, self.q = np.array(TREND_F), np.diag(TREND_Q)

    def init(self):
        return (np.array(TREND_START[0]), np.diag(TREND_START[1]), TREND_R, None, 0)

    def advance(self, state, price):
        x, p, r, est, n = state
        x, p = self.f @ x, self.f @ p @ self.f.T + self.q
        e, s = price - x[0], p[0, 0] + r
        k = p[:, 0] / s
        x = x + k * e
        m = np.eye(3)
        m[:, 0] -= k
        p = m @ p @ m.T + r * np.outer(k, k)
        ll = -0.5 * (math.log(2 * math.pi) + math.log(s) + e * e / s)
        if self.adapt and n >= 1:
            est = e * e if est is None else (1 - self.adapt) * est + self.adapt * e * e
            r = max(est - p[0, 0], 0.001)
        return (x, p, r, est, n + 1), (float(x[0]), float(x[1]), float(x[2]), ll, r)


class VolatilityFilter:
    """Kalman filter on log volatility: predict, then observe half the log squared return."""
    inputs, outputs = ["ret"], "volatility double"

    def init(self):
        return VOL_START

    def advance(self, state, ret):
        x, p = VOL_F * state[0], VOL_F * VOL_F * state[1] + VOL_Q
        k = p / (p + VOL_R)
        x, p = x + k * (0.5 * math.log(max(ret * ret, 1e-8)) - x), (1 - k) ** 2 * p + k * k * VOL_R
        return (x, p), (math.exp(x),)
