"""Splines by two sweeps against the whole system of equations, and turns by flat arithmetic against matrices."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from convoke.functions import vectors as V
from convoke.operators.motion import not_a_knot


def dense(y, at):
    n = len(y)
    h = 1 / (n - 1)
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = 1, 4, 1
        b[i] = 6 * (y[i - 1] - 2 * y[i] + y[i + 1]) / h**2
    a[0, :3] = a[-1, -3:] = 1, -2, 1
    m = np.linalg.solve(a, b)
    k = np.minimum((at / h).astype(int), n - 2)
    u, v = at - k * h, (k + 1) * h - at
    return (m[k] * v**3 + m[k + 1] * u**3) / (6 * h) + (y[k] / h - m[k] * h / 6) * v + (y[k + 1] / h - m[k + 1] * h / 6) * u


def test_sweeps():
    rng = np.random.default_rng(1)
    for n in [4, 5, 6, 7, 12, 100]:
        y, at = rng.normal(size=n), np.linspace(0, 1, 333)
        assert np.allclose(not_a_knot(y, at), dense(y, at))
        assert np.allclose(not_a_knot(y, np.linspace(0, 1, n)), y)
    x = np.linspace(0, 1, 50)
    assert np.allclose(not_a_knot(x[::7] ** 3 - x[::7], x[::7]), x[::7] ** 3 - x[::7])
    began = time.perf_counter()
    not_a_knot(rng.normal(size=200_000), np.linspace(0, 1, 500))
    assert time.perf_counter() - began < 5


def test_turns(spark):
    rng = random.Random(2)
    rows = [([[rng.gauss(0, 1) for _ in range(3)] for _ in range(3)], np.linalg.qr(np.array([[rng.gauss(0, 1) for _ in range(3)] for _ in range(3)]))[0].tolist()) for _ in range(100)]
    rows += [([[0.0] * 3] * 3, rows[0][1]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "a array<array<double>>, b array<array<double>>")
    one, two = V.relative_angle(F.col("a"), F.col("b"), True), V.angle(V.product(V.inverse(F.col("a")), F.col("b")), True)
    got = df.select(one.alias("one"), two.alias("two")).collect()
    assert all(abs(r.one - r.two) < 1e-4 for r in got[:100]) and got[-1].one is None and got[-2].one is None
