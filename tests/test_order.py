import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainmill.operators import order


def frame(spark, rows, schema="g string, x double, w double, k long"):
    return spark.createDataFrame(rows, schema)


def hazen(x, w, q):
    o = np.argsort(x, kind="stable")
    x, w = np.array(x)[o], np.array(w)[o]
    return np.interp(q, (np.cumsum(w) - w / 2) / w.sum(), x)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 4)), min_size=1, max_size=30))
def test_weighted_quantiles(spark, pairs):
    rows = [("a", float(x), float(w), i) for i, (x, w) in enumerate(pairs)]
    probs = [0.0, 0.01, 0.5, 0.99, 1.0]
    got = {r.p: r.value for r in order.weighted_quantiles(frame(spark, rows), ["g"], "x", "w", "k", probs).collect()}
    want = hazen([x for x, _ in pairs], [w for _, w in pairs], probs)
    assert np.allclose([got[p] for p in probs], want)


def test_even_grid_of_many_knots(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=60), 1)
    rows = [("a", float(v), 1.0 + i % 3, i) for i, v in enumerate(x)]
    grid = [i / 100 for i in range(101)]
    got = sorted((r.p, r.value) for r in order.weighted_quantiles(frame(spark, rows), [], "x", "w", "k", grid).collect())
    order_ = sorted(range(60), key=lambda i: (x[i], i))
    want = hazen(x[order_], np.array([1.0 + i % 3 for i in range(60)])[order_], grid)
    assert np.allclose([v for _, v in got], want)


def test_quantiles_and_nulls(spark):
    rows = [("a", float(v), 1.0, i) for i, v in enumerate([3, 1, 2, 2, 9])] + [("b", None, 1.0, 10), ("b", 5.0, 1.0, 11), (None, 1.0, 1.0, 12)]
    got = {r.g: list(r.q) for r in order.quantiles(frame(spark, rows), ["g"], "x", [0, 0.1, 0.5, 1], "k").where("g IS NOT NULL").collect()}
    assert np.allclose(got["a"], np.quantile([3, 1, 2, 2, 9], [0, 0.1, 0.5, 1])) and got["b"] == [5.0] * 4
    assert order.quantiles(frame(spark, []), ["g"], "x", [0.5], "k").count() == 0


def test_ranks_and_correlation(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 6, 50).astype(float), rng.integers(0, 6, 50).astype(float)
    df = spark.createDataFrame([("g", float(x), float(y), i) for i, (x, y) in enumerate(zip(a, b))] + [("c", 1.0, 2.0, 99), ("c", 1.0, 3.0, 98)], "g string, a double, b double, k long")
    got = {r.g: r.rho for r in order.spearman(df, ["g"], "a", "b", "k").collect()}
    assert got["g"] == pytest.approx(pd.Series(a).rank().corr(pd.Series(b).rank())) and got["c"] is None


def test_top_fraction_keeps_at_least_one(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 2), ("a", 0.5, 3), ("b", None, 4)], "g string, x double, k long")
    got = {r.k for r in order.top_fraction(df, ["g"], "x", "k", 0.2).where("top").collect()}
    assert got == {1, 4}


def test_ks(spark):
    df = spark.createDataFrame([(1.0, True, 1), (2.0, True, 2), (2.0, False, 3), (3.0, False, 4)], "x double, a boolean, k long")
    assert order.ks_distance(df, [], "x", F.col("a"), "k").first().ks == pytest.approx(0.5)


def test_step_up(spark):
    df = spark.createDataFrame([(0.01, 1), (0.04, 2), (0.03, 3), (0.9, 4)], "p double, k long")
    got = [r.q for r in order.bh_adjust(df, [], "p", "k").orderBy("p").collect()]
    assert np.allclose(got, [0.04, 4 / 75, 4 / 75, 0.9])


def test_ranks_of_a_hot_value(spark):
    """One value holds 40 % of the rows of a group that holds most rows; ranks are those of a plain sort, NULL groups included."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", None]), 7.0 if rng.random() < 0.4 else float(rng.randint(0, 30)), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, x double, k long")
    got = {r.k: r["rank"] for r in order.average_rank(df, ["g"], "x", "k").collect()}
    for g in ("hot", "a", None):
        mine = [(x, k) for h, x, k in rows if h == g]
        want = pd.Series([x for x, _ in mine]).rank()
        assert all(got[k] == w for (_, k), w in zip(mine, want))
    whole = {r.k: r["rank"] for r in order.average_rank(df, [], "x", "k").collect()}
    assert all(whole[k] == w for k, w in enumerate(pd.Series([x for _, x, _ in rows]).rank()))
    assert order.average_rank(df.limit(0), ["g"], "x", "k").count() == 0
