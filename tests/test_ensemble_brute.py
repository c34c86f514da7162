"""Ensemble statistics against the rules applied one group at a time: nulls, ties, zeroes, both signs, large spreads."""

import random

import pytest

from tidewell.operators import ensemble


def by_hand(members):
    order = sorted(members, key=lambda m: (m[0] is not None, m[0] if m[0] is not None else 0.0, m[1], m[2]))
    middle = order[len(order) // 2]
    known = [m for m in order if m[0] is not None]
    mean = sum(m[0] for m in known) / len(known) if known else None
    near = min(known, key=lambda m: (abs(m[0] - mean), m[0], m[1], m[2])) if known else order[0]
    whole = [m[0] for m in known if m[0] != 0]
    low, high = (min(m[0] for m in known), max(m[0] for m in known)) if known else (None, None)
    return middle, near, mean, sum(whole) / len(whole) if whole else None, low, high, len(order)


@pytest.mark.parametrize("seed", range(3))
def test_against_single_groups(spark, seed):
    rnd = random.Random(seed)
    draw = [lambda: rnd.gauss(0, 1), lambda: float(rnd.randint(-2, 2)), lambda: rnd.choice([None, 0.0, 5.0]), lambda: 10 ** rnd.uniform(-9, 9), lambda: None, lambda: -(2.0 ** rnd.randint(-3, 3))]
    rows = [(f"g{g}", draw[g % len(draw)](), f"TP{rnd.randint(1, 3):02d}", f"n{i:03d}") for g in range(18) for i in range(rnd.randint(1, 25))]
    df = spark.createDataFrame(rows + [(None, 1.0, "TP01", "x")], "k string, v double, tp string, name string")
    got = {r["k"]: r for r in ensemble.ensemble_statistics(df, ["k"], "v", "tp", "name").collect()}
    assert set(got) == {r[0] for r in rows}
    for k, r in got.items():
        middle, near, mean, whole, low, high, n = by_hand([x[1:] for x in rows if x[0] == k])
        assert (r["median"], r["median_tp"], r["median_name"], r["low"], r["high"], r["count_tp"]) == (*middle, low, high, n), k
        assert r["mean_including_zeroes"] == (pytest.approx(mean, rel=1e-12, abs=1e-15) if mean is not None else None)
        assert r["mean_excluding_zeroes"] == (pytest.approx(whole, rel=1e-12, abs=1e-15) if whole is not None else None)
        if mean is None or abs(abs(near[0] - mean) - abs(r["mean_peak"] - mean)) > 1e-12 * (abs(mean) + 1):
            assert (r["mean_peak"], r["mean_tp"], r["mean_name"]) == near, k
