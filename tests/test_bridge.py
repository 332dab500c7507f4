import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.functions.signals import ATOMIC
from grainmill.operators import scoring
from grainmill.plans import bridge, parts, registry, schemes
from tests.conftest import SF
from tests.oracle import check


@pytest.mark.parametrize("name", ["scheme_weights", "scheme_summary", "scheme_extension", "shrinkage_sensitivity", "equal_baseline", "signal_join_audit", "mixture_pairs", "combination_extremes", "spearman_matrix", "recipe_order"])
def test_against_sql(spark, name):
    check(spark, registry.queries()[name], registry.oracle_sql()[name])


def test_families():
    w = bridge.validate_families(bridge.FIELDS, bridge.FAMILIES)
    assert w.sum() == pytest.approx(1) and w[:3].sum() == pytest.approx(1 / 3) and w[3] == pytest.approx(1 / 6)
    for bad in ({"a": ("x",)}, {"a": ("x", "y"), "b": ("y",)}):
        with pytest.raises(ValueError):
            bridge.validate_families(("x", "y"), bad)


def test_softmin():
    parts_ = np.array([[[1.0, 0.0], [0.0, 1.0]]])
    w = np.array([0.75, 0.25])
    d, s = bridge.soft(parts_, w, 1.0)
    assert np.allclose(d, [[0.75**0.5, 0.5]]) and s[0, 1] > s[0, 0] and s.sum() == pytest.approx(1)
    assert bridge.soft(parts_, w, 0.5)[1][0, 1] > s[0, 1]
    with pytest.raises(ValueError):
        bridge.soft(parts_, w, 0.0)


def test_distances_by_brute_force(spark):
    p = bridge.prepared(spark, SF).toPandas()
    b = bridge._bridge(spark, SF)
    a1 = p[p.side == "A1"]
    scale = np.maximum(a1[list(bridge.FIELDS)].std(ddof=0).to_numpy(), 1e-8)
    stats = lambda side, d: (x := p[(p.side == side) & (p.domain == d)][list(bridge.FIELDS)], x.mean().to_numpy(), x.std(ddof=0).to_numpy())[1:]
    for i, d in enumerate(b.b.domains):
        for j, q in enumerate(b.a.domains):
            (m, s), (n, t) = stats("A18", d), stats("A1", q)
            want = np.sqrt((b.weights * (((m - n) / scale) ** 2 + 0.25 * ((s - t) / scale) ** 2)).sum())
            assert b.distance[i, j] == pytest.approx(want, abs=1e-8)
    assert np.allclose(b.final.sum(1), 1) and np.allclose(b.soft.sum(1), 1)
    for i in np.flatnonzero(b.fixed):
        assert b.final[i, b.target[i]] == 1 and b.final[i].sum() == 1
    assert (~np.isnan(p[list(bridge.FIELDS)].to_numpy())).all()  # what was missing is imputed


def test_reports_of_the_bridge(spark):
    q = registry.queries()
    b = bridge._bridge(spark, SF)
    s = q["bridge_sensitivity"](spark, SF).toPandas()
    assert len(s) == len(b.b.domains) * (1 + len(bridge.FIELDS) + len(bridge.FAMILIES)) * len(bridge.TEMPERATURES)
    assert s[s.fixed].groupby("domain").q_bridge.nunique().max() <= 1  # known domains don't hang on the distances
    d = q["bridge_domains"](spark, SF).toPandas()
    assert (d.q_low <= d.q_high + 1e-9).all() and (d.q_least <= d.q_final + 1e-9).all() and (d.q_final <= d.q_most + 1e-9).all() and d.field_stability.between(0, 1).all()
    gate = q["bridge_gate"](spark, SF).first()
    assert gate is None or gate.mae_low <= gate.q_mae <= gate.mae_high and gate.top1 <= gate.top3 <= gate.n_known
    w = q["bridge_weights"](spark, SF).toPandas()
    assert np.allclose(w.groupby("domain").final_weight.sum(), 1, atol=1e-4)


def test_accepted_fields(spark):
    audit = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", True)], "field string, passed boolean")
    both = spark.createDataFrame([("A1", 1.0, 1.0, 1.0, 1.0), ("A1", 1.0, None, 1.0, 1.0), ("A18", None, 1.0, 1.0, None), ("A18", 2.0, 1.0, 1.0, None)], "side string, a double, b double, c double, d double")
    t = bridge.accepted(audit, both, ("a", "b", "c", "d", "e")[:4])
    assert {r.field: r.accepted for r in t.collect()} == {"a": True, "b": False, "c": False, "d": False}  # b lacks a value in A1, d any in A18
    assert bridge.require_accepted(t, 1) == ["a"]
    with pytest.raises(ValueError):
        bridge.require_accepted(t)


def test_calibration_and_partial_signals(spark):
    f = "rps_doc_frac_unique_words"
    df = spark.createDataFrame([(float(i) / 30, 1 - float(i) / 30) for i in range(31)], f"{f} double, r_{f} double")
    lines = bridge.calibration_lines(df, (f,))
    assert lines[f] == (0.0, pytest.approx(0.5))  # falling: no slope
    assert df.select(bridge.calibrated({f: (2.0, 0.5)}, f).alias("x")).agg(F.max("x")).first()[0] == 1 and bridge.calibration_lines(df.limit(19), (f,)) == {}
    one = spark.createDataFrame([(1.0,) * len(ATOMIC)], ", ".join(f"{c} double" for c in ATOMIC)).select(*bridge.accepted_only(None, (f,))).first().asDict()
    assert {k for k, v in one.items() if v is not None} == {f}


def test_routes_need_their_gate(spark):
    quality = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "domain string, q double")
    gate = lambda ok: spark.createDataFrame([(ok,)], "passes boolean")
    assert [r.standardised for r in bridge.quality_route(spark, "x", quality, gate(True)).orderBy("domain").collect()] == [-1.0, 1.0]
    for closed in (gate(False), gate(True).limit(0)):
        assert all(r.standardised is None and not r.eligible for r in bridge.quality_route(spark, "x", quality, closed).collect())


def test_scorer_is_the_scheme(spark):
    """The direct scorer, fitted on all reference records, gives the scheme's own scores."""
    rows, _ = parts.fitted_records(spark, SF)
    got = {r.row_key: r.q for r in bridge.Scorer(rows.where("a1"), "row_key").score(rows, ["row_key"]).collect()}
    j = schemes.SCHEMES.index("B20_hierarchical")
    want = {r.row_key: r[1] for r in schemes.scores(spark, SF).select("row_key", f"q_0_{j}").collect()}
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items()) and len(got) == len(want)


def test_concepts_from_atomic_moments(spark):
    """Weights of concepts by the moments of what they are made of equal those by the concepts' own moments."""
    from grainmill.operators.utility import balanced_weights

    model = schemes.fitted(spark, SF)["frozen_original"]
    ref = balanced_weights(schemes.profiled(spark, SF).where("a1"), "domain")
    for name in schemes.SCHEMES:
        scheme = scoring.schemes(model["inner"])[name]
        own = scoring.critic(ref.select("w", *scoring.concept_columns(scheme)), [f"c_{n}" for n in scheme], "w")
        assert np.allclose(own, model["models"][name][2], atol=1e-9)
