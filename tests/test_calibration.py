import math

import numpy as np
import pytest

from propagon.operators import calibration, sampling


@pytest.fixture(scope="module")
def scores():
    rng = np.random.default_rng(3)
    p = np.round(rng.random(800), 2)
    y = (rng.random(800) < 1 / (1 + np.exp(-(0.5 * np.log((p + 0.01) / (1.01 - p)) - 0.7)))).astype(int)
    return p, y


def logits(p):
    c = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(c / (1 - c))


def loss(y, q):
    c = np.clip(q, 1e-12, 1 - 1e-12)
    return -np.mean(y * np.log(c) + (1 - y) * np.log(1 - c))


def frame(spark, p, y):
    return spark.createDataFrame([(i, int(b), float(a)) for i, (a, b) in enumerate(zip(p, y))], "row_seq long, y_true int, y_prob double")


def test_temperature_against_halving(spark, scores):
    p, y = scores
    z, low, high = logits(p), -4.0, 4.0
    for _ in range(100):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(y, 1 / (1 + np.exp(-z / math.exp(a)))) < loss(y, 1 / (1 + np.exp(-z / math.exp(b)))) else (a, high)
    assert calibration.fit_temperature(frame(spark, p, y)) == pytest.approx(math.exp(low), rel=1e-5)


def test_platt_against_descent(spark, scores):
    p, y = scores
    z = logits(p)
    x, a, b = (z - z.mean()) / z.std(), 1.0, 0.0
    for _ in range(20_000):
        off = 1 / (1 + np.exp(-(a * x + b))) - y
        a, b = a - 0.5 * (np.mean(off * x) + 1e-4 * a), b - 0.5 * np.mean(off)
    assert calibration.fit_platt(frame(spark, p, y)) == pytest.approx((a, b, z.mean(), z.std()), rel=1e-6)


def test_fits_without_rows_and_with_one_score(spark, scores):
    none = frame(spark, [], [])
    assert calibration.fit_temperature(none) == 1.0 and calibration.fit_platt(none) == (1.0, 0.0, 0.0, 1.0)
    a, b, mean, deviation = calibration.fit_platt(frame(spark, [0.5] * 4, [1, 0, 0, 0]))
    assert deviation == 1.0 and 1 / (1 + math.exp(-b)) == pytest.approx(0.25, abs=1e-6)


def test_rest_of_a_sample_goes_to_the_fullest(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([1] * 5 + [20] * 3 + [60] * 3 + [-1] * 9)], "id long, v long")
    got = {r.bin: (r.available, r.target) for r in sampling.allocation(rows, "v", 7).collect()}
    assert got == {1: (5, 5), 2: (3, 1), 3: (3, 1)}
    assert sampling.stratified_sample(rows, "v", "id", 7).count() == 7 and sampling.stratified_sample(rows, "v", "id", 100).count() == 11
    assert sampling.stratified_sample(rows.where("false"), "v", "id", 7).count() == 0
