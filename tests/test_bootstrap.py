"""Bootstrap by counted draws against the draws made one by one."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import analytics


def brute(values, key, resamples, seed):
    values = np.sort(values)
    n = len(values)
    unit = lambda b, j: int(hashlib.md5("|".join([*key, str(b), str(j), str(seed)]).encode()).hexdigest()[:13], 16) / (1 << 52)
    means = [values[[math.floor(n * unit(b, j)) for j in range(n)]].mean() for b in range(resamples)]
    return values.mean(), np.quantile(means, 0.025), np.quantile(means, 0.975)


def test_equal_to_draws_one_by_one(spark):
    rng = np.random.default_rng(2)
    groups = {("a", "x"): rng.normal(size=40), ("a", None): np.repeat([1.0, 2.0], [30, 3]), (None, "x"): rng.random(7), ("b", "y"): np.array([5.0]), ("c", "z"): np.array([])}
    rows = [(*key, float(v)) for key, values in groups.items() for v in values] + [("c", "z", None), ("c", "z", float("nan")), ("a", "x", None)]
    df = spark.createDataFrame(rows, "g string, h string, v double").repartition(5)
    got = {(r.g, r.h): (r.estimate, r.ci_low, r.ci_high) for r in analytics.bootstrap_draws(df, ["g", "h"], "v", 50, 9).collect()}
    assert set(got) == set(groups)
    for key, values in groups.items():
        if len(values):
            assert got[key] == pytest.approx(brute(values, [k for k in key if k is not None], 50, 9), abs=1e-12), key
        else:
            assert all(math.isnan(x) for x in got[key])


def test_a_large_group_is_spread(spark):
    df = spark.range(200_000).select(F.lit("g").alias("g"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("v"))
    r = analytics.bootstrap_draws(df, ["g"], "v", 20).first()
    error = 288.7 / math.sqrt(200_000)
    assert abs(r.estimate - 499.5) < 5 * error and 0 < r.ci_high - r.ci_low < 8 * error
    assert r.ci_low < r.estimate < r.ci_high


def test_draws_are_those_of_the_hash(spark):
    """Numbers of any length, a prefix of several blocks of MD5, and none."""
    from sparkloom.functions.draws import unit_draws

    b, j = np.array([0, 9, 10, 999, 999, 7]), np.array([0, 10, 99, 100_000, 2**40, 9])
    for prefix in ("", "BUILDING|", "é" * 70 + "|"):
        want = [int(hashlib.md5(f"{prefix}{x}|{y}|5".encode()).hexdigest()[:13], 16) / (1 << 52) for x, y in zip(b, j, strict=True)]
        assert unit_draws(prefix, b, j, "|5").tolist() == want


def test_a_group_of_many_stretches_and_blocks(spark, monkeypatch):
    """Stretches that end within a group, blocks that two groups share."""
    monkeypatch.setattr(analytics, "DRAWS", 100)
    monkeypatch.setattr(analytics, "HIT_BITS", 5)
    rng = np.random.default_rng(3)
    groups = {("a", "x"): rng.normal(size=730), ("b", "y"): rng.random(41), ("c", "z"): rng.random(100)}
    df = spark.createDataFrame([(*key, float(v)) for key, values in groups.items() for v in values], "g string, h string, v double").repartition(5)
    got = {(r.g, r.h): (r.estimate, r.ci_low, r.ci_high) for r in analytics.bootstrap_draws(df, ["g", "h"], "v", 40, 9).collect()}
    for key, values in groups.items():
        assert got[key] == pytest.approx(brute(values, list(key), 40, 9), abs=1e-12), key
