"""Parallel pooling against the max-min definition of isotonic regression."""

import numpy as np
import pytest

from tremora.operators import isotonic


def by_definition(points):
    """{x: fit}: the largest over starts of the smallest over ends of the mean between them."""
    xs = sorted({x for x, _ in points})
    totals = [sum(y for a, y in points if a == x) for x in xs]
    weights = [sum(1 for a, _ in points if a == x) for x in xs]
    mean = lambda a, b: sum(totals[a : b + 1]) / sum(weights[a : b + 1])
    return {x: max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i, x in enumerate(xs)}


def draws(seed, n, rising):
    r = np.random.default_rng(seed)
    x = np.round(r.uniform(0, 1, n), 2)
    return [(float(a), int(r.random() < (a if rising else 1 - a))) for a in x]


@pytest.mark.parametrize("window", [3, 7, 16, 100_000])
@pytest.mark.parametrize("rising", [True, False])
def test_windows_do_not_matter(spark, window, rising):
    points = draws(3, 150, rising)
    blocks = isotonic.fit(spark.createDataFrame(points, "p double, y int").repartition(4), window=window)
    wanted = by_definition(points)
    rows = sorted(blocks.collect(), key=lambda b: b.low)
    got = {x: b.total / b.weight for x in wanted for b in rows if b.low <= x <= b.high}
    assert got == pytest.approx(wanted)
    means = [b.total / b.weight for b in rows]
    assert all(a < b for a, b in zip(means, means[1:])) and sum(b.weight for b in rows) == len(points)


def test_keys_are_fitted_apart(spark):
    sets = {"a": draws(1, 80, True), "b": draws(2, 90, False), None: draws(4, 40, True)}
    rows = [(k, x, y) for k, points in sets.items() for x, y in points]
    df = spark.createDataFrame(rows, "k string, p double, y int").repartition(3)
    blocks = isotonic.fit(df, ["k"], window=5)
    scored = isotonic.apply(blocks, df, ["k"])
    wanted = {k: by_definition(points) for k, points in sets.items()}
    found = scored.collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.p_cal == pytest.approx(wanted[r.k][r.p])


def test_between_and_outside(spark):
    blocks = spark.createDataFrame([(0.2, 0.3, 1.0, 10.0), (0.5, 0.5, 3.0, 10.0), (0.8, 0.9, 12.0, 10.0)], "low double, high double, total double, weight double")
    asked = [0.0, 0.2, 0.25, 0.3, 0.4, 0.5, 0.65, 0.8, 1.0, None, float("nan"), 0.4]
    got = isotonic.apply(blocks, spark.createDataFrame([(k, p) for k, p in enumerate(asked)], "k int, p double").repartition(5)).collect()
    values = [r.p_cal for r in sorted(got)]
    assert values[9] is None and values[10] is None
    assert values[:9] + values[11:] == pytest.approx([0.1, 0.1, 0.1, 0.1, 0.2, 0.3, 0.75, 1.0, 1.0, 0.2])


def test_no_points(spark):
    empty = spark.createDataFrame([(None, 1), (0.5, None)], "p double, y int")
    blocks = isotonic.fit(empty)
    assert blocks.count() == 0
    assert [r.p_cal for r in isotonic.apply(blocks, empty).collect()] == [None, None]


def test_long_descent_needs_several_rounds(spark):
    points = [(k / 1000, 1000 - k) for k in range(1000)]
    rows = isotonic.fit(spark.createDataFrame(points, "p double, y int"), window=50).collect()
    assert [(b.low, b.high, b.weight) for b in rows] == [(0.0, 0.999, 1000.0)]
