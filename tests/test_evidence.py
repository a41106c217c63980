import gzip
import hashlib
from collections import Counter

import numpy as np
import pytest

from ratelens.operators import blocks, monitor, search, statistics
from ratelens.sources import evidence


def test_rows_round_trip_as_strings(spark, tmp_path):
    df = spark.createDataFrame([("01", 'a "b", c'), ("2", "line\nbreak"), ("3", None)], "id string, note string")
    path = str(tmp_path / "rows")
    evidence.write_rows(df, path)
    got = evidence.read_rows(spark, path)
    assert dict(got.dtypes) == {"id": "string", "note": "string"} and sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        evidence.write_rows(df.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_records_appear_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "records")
    evidence.write_records(spark.createDataFrame([(1, 0.5)], "a int, b double"), path)
    for bad in (float("nan"), float("inf")):
        with pytest.raises(ValueError):
            evidence.write_records(spark.createDataFrame([(2, bad)], "a int, b double"), path)
    assert [tuple(r) for r in spark.read.json(path).select("a", "b").collect()] == [(1, 0.5)]
    evidence.write_records(spark.createDataFrame([(3, 1.5)], "a int, b double"), path)
    assert spark.read.json(path).first().a == 3 and [p.name for p in tmp_path.iterdir()] == ["records"]


def test_archives(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else f"n{i}") for i in range(40)], "id long, name string").repartition(3)
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    evidence.write_archive(df, one, ["id"])
    evidence.write_archive(df.repartition(5), two, ["id"])
    lines = lambda p: [x for f in sorted((tmp_path / p).glob("*.gz")) for x in gzip.open(f, "rt").read().splitlines()]
    assert lines("one") == lines("two") and len(lines("one")) == 40
    got = evidence.read_archive(spark, one, "id long, name string")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    with pytest.raises(ValueError):
        evidence.write_archive(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "bad"), ["x"])


def test_digest_lists(spark, tmp_path):
    folder = tmp_path / "files"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.txt").write_bytes(b"a")
    (folder / "deep" / "b c.bin").write_bytes(b"\0\1")
    found = evidence.digest_files(spark, str(folder))
    evidence.write_digests(found, str(tmp_path / "SUMS"))
    again = evidence.read_digests(spark, str(tmp_path / "SUMS"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found.collect()))
    assert {r.name for r in again.collect()} == {"a.txt", "deep/b c.bin"}


def test_process_snapshots_and_rates(spark):
    stat = lambda pid, name, ticks, started: f"{pid} ({name}) S 1 " + " ".join(["0"] * 9) + f" {ticks} 1 " + " ".join(["0"] * 6) + f" {started} 5 6"
    rows = [(0, stat(7, "a (b) c", 10, 100)), (2, stat(7, "a (b) c", 160, 100)), (0, stat(8, "x", 5, 50)), (2, stat(8, "x", 900, 51)), (2, stat(9, "new", 1, 9)), (0, "broken"), (2, stat(8, "x", 3, 50))]
    df = evidence.process_snapshot(spark.createDataFrame(rows, "at int, value string"))
    assert df.count() == 6 and df.where("pid = 7").first().command == "a (b) c" and df.where("pid = 7 and at = 2").first().ticks == 161
    rates = {(r.pid, r.at): r.cores for r in monitor.cpu_rates(df, []).collect()}
    assert rates == {(7, 2): 0.75, (8, 2): 0.0}
    d = monitor.disturbances(monitor.cpu_rates(df, []), []).first()
    assert (d.busy, d.cores, d.disturbed) == (1, 0.75, True)


def test_search_meets_targets():
    curve = lambda c: c * c
    known = {c: float(curve(c)) for c in (1.0, 5.0, 10.0)}
    for target in (2.0, 30.0, 60.0, 99.0):
        c, v, made = search.search(known, target, 0.01, curve)
        assert abs(v - target) <= 0.01 and len(made) <= search.PROBES and len(set(made)) == len(made)
    c, v, made = search.search(known, 30.0, 0.5, curve, whole=True)
    assert c in (5.0, 6.0) and all(float(x).is_integer() for x in made)
    assert search.search(known, 500.0, 1, curve)[2] == []
    falling = {c: 100 - curve(c) for c in (1.0, 5.0, 10.0)}
    assert abs(search.search(falling, 50.0, 0.01, lambda c: 100 - curve(c), rising=False)[1] - 50) <= 0.01


def test_match_points(spark):
    df = spark.createDataFrame([(k, float(c), float(c * c), 30.0 + k, 0.01) for k in range(3) for c in (1, 5, 10)], "k long, c double, v double, target double, tolerance double")
    rows = search.match_points(df, ["k"], "c", "v", "target", "tolerance", lambda key, c: c * c).collect()
    assert len(rows) == 3 and all(r.matched and abs(r.value - 30 - r.k) <= 0.01 for r in rows)


def test_draws_follow_the_multinomial(spark):
    n, replicates = 40, 400
    units = spark.createDataFrame([(s, f"{s}{i:03}") for s in "ab" for i in range(n)], "s string, u string")
    w = statistics.stratified_draws(units, "s", "u", replicates).collect()
    total = Counter()
    for r in w:
        total[r.replicate, r.s] += r.weight
    assert set(total.values()) == {n} and len(total) == 2 * replicates
    weights = np.zeros((replicates, 2 * n))
    at = {r.u: i for i, r in enumerate(units.collect())}
    for r in w:
        weights[r.replicate, at[r.u]] = r.weight
    # Mean 1 and variance 1 - 1/n a unit, and the draws of strata differ.
    assert abs(weights.mean() - 1) < 1e-9 and abs(weights.var(axis=0).mean() - (1 - 1 / n)) < 0.05
    assert np.abs(weights.mean(axis=0) - 1).max() < 0.25 and (weights[:, :n] != weights[:, n:]).any()
    means = statistics.bootstrap_means(units.selectExpr("*", "cast(substring(u, 2) as double) as v"), "s", "u", "v", replicates)
    spread = np.std([r["mean"] for r in means.collect()])
    assert abs(spread - np.std(np.arange(n)) / np.sqrt(2 * n)) < 0.3


def test_bootstrap_broadcasts_no_units(spark, tmp_path):
    """On tables small enough for Spark to broadcast: what grows with the units must not, as it would fill the driver."""
    n = 5000  # more than a chunk of slots
    units = spark.createDataFrame([("ab"[i % 3 == 0], i, None if i == 7 else float(i * i % 1009)) for i in range(n)], "s string, u long, v double")
    units.write.parquet(str(tmp_path / "units"))  # so that Spark knows the size
    units = spark.read.parquet(str(tmp_path / "units"))
    means = statistics.bootstrap_means(units, "s", "u", "v", 2)
    for df in (means, statistics.stratified_draws(units, "s", "u", 2)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    values = {s: [r.v for r in sorted(units.collect(), key=lambda r: r.u) if r.s == s] for s in "ab"}
    for r in means.collect():
        got = [v[int(hashlib.md5(f"{r.replicate}:{s}:{i}".encode()).hexdigest()[:15], 16) % len(v)] for s, v in values.items() for i in range(len(v))]
        assert len(got) == n and abs(r["mean"] - sum(x or 0 for x in got) / n) < 1e-9


def test_smoothing_is_a_small_mean(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (6, 5))
    df = spark.createDataFrame([(0, r, c, int(x[r, c])) for r in range(6) for c in range(5)], "k long, r long, c long, v long")
    got = np.zeros_like(x)
    for q in blocks.smooth(df, ["k"], "r", "c", "v").collect():
        got[q.r, q.c] = q.v
    p = np.pad(x, 1, mode="edge")
    mean = sum(p[i : i + 6, j : j + 5] for i in range(3) for j in range(3))
    assert (got == x + np.floor((mean - 9 * x + 18) / 36)).all()
