"""Exact quantiles by selection (AGG-3) against numpy, and their passes."""

import random

import numpy as np
import pytest

from mailsift.operators import profile as PR
from mailsift.operators import quantiles as Q


def _want(values, f):
    return float(np.quantile(np.array(values, dtype=float), f))


@pytest.mark.parametrize("cuts", [4, 64])
def test_equals_numpy_on_doubles(spark, monkeypatch, cuts):
    """Distinct doubles, heavy ties, heavy tails, one row, two rows; few cuts force many passes."""
    monkeypatch.setattr(Q, "CUTS", cuts)
    rnd = random.Random(3)
    groups = {"spread": [rnd.random() for _ in range(3000)], "ties": [float(rnd.randint(0, 3)) for _ in range(2000)],
              "tail": [10.0 ** rnd.uniform(-300, 300) for _ in range(1000)], "one": [4.5], "two": [-1.0, 2.0], "same": [7.0] * 500}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("spread", None), (None, 1.0), ("none", None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: r for r in Q.quantiles(df, "v", "g", (0.0, 0.25, 0.5, 0.75, 1.0)).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g].n == len(values)
        for k, f in enumerate((0.0, 0.25, 0.5, 0.75, 1.0)):
            assert got[g][f"q{k}"] == pytest.approx(_want(values, f), rel=1e-12), (g, f)


def test_infinities_clashing_names_and_empty(spark):
    rows = [(1, float("inf"), 0), (1, float("-inf"), 0), (1, 3.0, 0), (1, 3.0, 0), (1, float("inf"), 0)]
    df = spark.createDataFrame(rows, "part int, cuts double, stretch int")
    r = Q.quantiles(df, "cuts", "part", (0.0, 0.25, 0.5, 1.0)).first()
    assert (r.q0, r.q1, r.q2, r.q3, r.n) == (float("-inf"), 3.0, 3.0, float("inf"), 5)
    assert Q.quantiles(df.limit(0), "cuts", "part", (0.5,)).collect() == []


def test_box_stats_of_doubles(spark):
    values = [0.5, 1.5, 2.25, 2.5, 3.0, 99.5]
    r = PR.box_stats(spark.createDataFrame([(0, v) for v in values], "y int, v double"), "v", "y").first()
    assert (r.q1, r.median, r.q3) == (_want(values, 0.25), _want(values, 0.5), _want(values, 0.75))
    assert (r.n, r.whisker_lo, r.whisker_hi, r.n_outliers) == (6, 0.5, 3.0, 1)
