"""Dominance counts against all pairs."""

import random

import numpy as np
import pytest

from marlstone.operators import dominance, strategies

FINE = lambda diff: (diff > 0.03) & (diff * 100 - 2.5 > 1.0)


def table(seed, n, ticks):
    rng = random.Random(seed)
    seen = {}
    for k in range(n):
        key = (rng.choice(["x", "x", "x", "y", "z"]), float(rng.choice([100, 200, rng.randrange(1, 300)])), rng.randrange(1, ticks) / ticks)
        first, weight = seen.get(key, (k, 0))
        seen[key] = first, weight + 1
    return [(*key, *v) for key, v in seen.items()]


def plain(rows):
    out = []
    for g, place, height, _, _ in rows:
        low = [(h, o, w) for g2, p, h, o, w in rows if g2 == g and p < place and FINE(np.float64(height) - np.float64(h))]
        if low:
            out.append((g, place, height, sum(w for *_, w in low), *min(low)[:2]))
    return sorted(out)


@pytest.mark.parametrize(("held", "ticks"), [(7, 40), (60, 1000), (1 << 18, 200)])
def test_same_as_all_pairs(spark, held, ticks):
    rows = table(held, 500, ticks)
    df = spark.createDataFrame(rows, "grp string, place double, height double, ord long, n long")
    got = dominance.dominated(df.repartition(5), FINE, 0.035, held)
    assert sorted(map(tuple, got.collect())) == plain(rows)
    assert dominance.dominated(df.where("false"), FINE, 0.035, held).count() == 0


def test_bound_is_the_last_double_that_is_fine():
    heights = np.array([0.0, 0.035, 0.535, 0.123456789, 1.0, 1e-300, 5e6, -0.4])
    low = dominance.bounds(heights, FINE, 0.035)
    assert FINE(heights - low).all() and not FINE(heights - np.nextafter(low, np.inf)).any()


def test_no_task_holds_a_topic(spark):
    """One topic over many tasks, and a third of its markets at one threshold and price."""
    rng = random.Random(1)
    rows = [(k, k, f"Will bitcoin be above ${500 if k % 3 == 0 else rng.randrange(100, 900)}?", '["0.500","0.500"]' if k % 3 == 0 else f'["0.{rng.randrange(100, 999)}","0"]', 5000.0) for k in range(600)]
    df = spark.createDataFrame(rows, "ord long, market_id long, question string, outcome_prices string, volume double")
    got = strategies.combinatorial_best(df, held=50)
    pairs = strategies.combinatorial(df, most=None).collect()
    want = {}
    for p in pairs:
        n, best = want.get(p["hi_ord"], (0, (9, 0)))
        want[p["hi_ord"]] = n + 1, min(best, (p["lo_price"], p["lo_ord"]))
    found = {r["hi_ord"]: (r["violations"], (r["lo_price"], r["lo_ord"])) for r in got.collect()}
    assert found == want and len(want) > 100
