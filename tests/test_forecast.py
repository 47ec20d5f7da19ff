"""Forecasts of order-k chains against a walk in plain Python."""
from collections import defaultdict

from tidemark.operators import markov as M


def walk(seqs, k, steps):
    n = defaultdict(lambda: defaultdict(int))
    for s in seqs.values():
        for i in range(k, len(s)):
            n[tuple(s[i - k:i])][s[i]] += 1
    out = {}
    for e, s in seqs.items():
        if len(s) < k:
            continue
        mass, lost = {tuple(s[-k:]): 1.0}, 0.0
        for _ in range(steps):
            new = defaultdict(float)
            for h, p in mass.items():
                if h not in n:
                    lost += p
                for x, c in n.get(h, {}).items():
                    new[h[1:] + (x,)] += p * c / sum(n[h].values())
            mass = new
        got = defaultdict(float)
        for h, p in mass.items():
            got[h[-1]] += p
        if lost:
            got[None] = lost
        out.update({(e, s): p for s, p in got.items()})
    return out


def test_forecast_of_order_k(spark):
    seqs = {"a": "xyzxyyxzzxyxyz", "b": "zzyxzyxyzzyxx", "c": "xq", "d": "y", "e": "xyxxyxyyzx"}
    rows = [(e, i, x) for e, s in seqs.items() for i, x in enumerate(s)]
    df = spark.createDataFrame(rows, "entity string, ts int, state string")
    for k, steps in ((1, 2), (2, 3), (3, 4)):
        matrix = M.transition_matrix(M.transition_counts(df, k))
        got = {(r.entity, r.state): r.p for r in M.forecast(M.last_states(df, k), matrix, steps).collect()}
        want = walk(seqs, k, steps)
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)
        assert k > 2 or any(s is None for _, s in want)
