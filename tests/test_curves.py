import math

import pytest

from ratelens.operators import curves, matching, statistics


def test_bd_rate_of_scaled_rates(spark):
    rows = [(c, float(q), k * 2.0**q) for c, k in (("a", 1.0), ("b", 0.8)) for q in range(1, 6)]
    df = spark.createDataFrame(rows, "codec string, quality double, rate double")
    assert curves.bd_rate(df, [], "codec", "a").first().bd_rate_pct == pytest.approx(-20, abs=1e-9)
    assert curves.bd_rate(df, [], "codec", "b").first().bd_rate_pct == pytest.approx(25, abs=1e-9)


def test_bd_rate_without_overlap_or_points_is_null(spark):
    rows = [("a", float(q), 2.0**q) for q in (1, 2, 3)] + [("b", float(q), 2.0**q) for q in (4, 5, 6)] + [("c", 1.0, 1.0), ("c", 2.0, 2.0), ("d", float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "codec string, quality double, rate double")
    found = {r.candidate: r.bd_rate_pct for r in curves.bd_rate(df, [], "codec", "a").collect()}
    assert found == {"b": None, "c": None, "d": None}


def _pchip_area(points, low, high, steps=20000):
    """Brute force: the monotone cubic through (x, ln y), summed by Simpson's rule."""
    x, y = [p[0] for p in points], [math.log(p[1]) for p in points]
    h = [b - a for a, b in zip(x, x[1:])]
    d = [(b - a) / w for a, b, w in zip(y, y[1:], h)]

    def end(h0, d0, h1, d1):
        m = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if m * d0 <= 0:
            return 0.0
        return 3 * d0 if d0 * d1 < 0 and abs(m) > 3 * abs(d0) else m

    m = [end(h[0], d[0], h[1], d[1])]
    for i in range(1, len(h)):
        w1, w2 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
        m.append(0.0 if d[i - 1] * d[i] <= 0 else (w1 + w2) / (w1 / d[i - 1] + w2 / d[i]))
    m.append(end(h[-1], d[-1], h[-2], d[-2]))

    def f(v):
        i = max(k for k in range(len(h)) if x[k] <= v or k == 0)
        t = (v - x[i]) / h[i]
        return (2 * t**3 - 3 * t**2 + 1) * y[i] + (t**3 - 2 * t**2 + t) * h[i] * m[i] + (3 * t**2 - 2 * t**3) * y[i + 1] + (t**3 - t**2) * h[i] * m[i + 1]

    w = (high - low) / steps
    return sum((1 if k in (0, steps) else 4 if k % 2 else 2) * f(low + k * w) for k in range(steps + 1)) * w / 3


def test_bd_rate_equals_numeric_integration(spark):
    a = [(30.0, 0.2), (33.5, 0.41), (35.0, 0.9), (38.2, 1.3), (41.0, 2.9)]
    b = [(29.0, 0.18), (32.0, 0.3), (36.1, 0.8), (37.0, 1.2), (42.0, 2.5)]
    df = spark.createDataFrame([("a", *p) for p in a] + [("b", *p) for p in b], "codec string, quality double, rate double")
    r = curves.bd_rate(df, [], "codec", "a").first()
    want = (math.exp((_pchip_area(b, 30, 41) - _pchip_area(a, 30, 41)) / 11) - 1) * 100
    assert (r.low, r.high) == (30, 41) and r.bd_rate_pct == pytest.approx(want, abs=1e-6)


def test_frontier_drops_dominated_and_near_equal_points(spark):
    rows = [("k", 1.0, 5.0), ("k", 1.0 + 1e-13, 4.0), ("k", 2.0, 3.0), ("k", 3.0, 6.0), ("k", 4.0, 6.0), ("k", 5.0, -1.0), ("k", float("inf"), 1.0)]
    df = spark.createDataFrame(rows, "k string, quality double, rate double")
    assert sorted((r.quality, r.rate) for r in curves.pareto_frontier(df, ["k"]).collect()) == [(2.0, 3.0), (4.0, 6.0)]


def test_pooled_error_before_decibels(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (3.0, 9.0, 1.0)], "w double, v double, b double")
    assert curves.weighted_curve(df, [], "w", "v", "b", "mse").first().quality == pytest.approx(10 * math.log10(65025 / 7))
    zero = spark.createDataFrame([(1.0, 0.0, 1.0)], "w double, v double, b double")
    assert curves.weighted_curve(zero, [], "w", "v", "b", "mse").first().quality == float("inf")


def test_interval_ignores_what_is_not_finite(spark):
    df = spark.createDataFrame([(float(v),) for v in range(101)] + [(None,), (float("nan"),), (float("inf"),)], "v double")
    r = statistics.percentile_interval(df, [], "v").first()
    assert (r.low, r.high) == pytest.approx((2.5, 97.5))


def test_draws_have_every_stratum_in_full(spark):
    u = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 4), ("b", 5)], "s string, id long")
    w = statistics.stratified_draws(u, "s", "id", 20).groupBy("replicate", "s").sum("weight").collect()
    assert {(r.s, r["sum(weight)"]) for r in w} == {("a", 2), ("b", 3)} and len(w) == 40


def test_pairs_are_counted_under_the_first_reason(spark):
    rows = [(1, "c", True, 10.0), (2, "c", True, 10.0), (2, "a", False, 10.0), (3, "c", True, 20.0), (3, "a", True, 10.0), (4, "c", True, 10.0), (4, "a", True, 10.0)]
    df = spark.createDataFrame(rows, "id int, side string, ok boolean, size double")
    found = {r.id: r.reason for r in matching.eligible_pairs(df, ["id"], "side", "c", "a", "ok", "size", 0.02).collect()}
    assert found == {1: "missing", 2: "unmatched", 3: "tolerance", 4: None}


def test_completeness_both_ways(spark):
    e = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    a = spark.createDataFrame([(1,), (3,), (3,), (4,)], "k int")
    assert {(r.k, r.n, r.problem) for r in matching.completeness(e, a, ["k"]).collect()} == {(2, 0, "missing"), (3, 2, "duplicate"), (4, 1, "unexpected")}


def test_brackets_are_the_first_neighbours_around_a_target(spark):
    from ratelens.operators import matching

    points = {"a": [1.0, 2.0, 2.0, 5.0], "b": [3.0], "c": [4.0, 4.0]}
    targets = [0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0, 6.0]
    rows = [(k, x, t) for k, xs in points.items() for x in xs for t in targets]
    got = {(r.k, r.t): (r.low_at, r.high_at) for r in matching.brackets(spark.createDataFrame(rows, "k string, x double, t double"), ["k"], "x", "t").collect()}
    want = {}
    for k, xs in points.items():
        for t in targets:
            around = [(a, b) for a, b in zip(xs, xs[1:]) if a <= t <= b]
            if around:
                want[k, t] = around[0]
    assert got == want
