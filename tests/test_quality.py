import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.functions.signals import ATOMIC, FIELDS, LENGTHS, decode
from grainmill.operators import brackets, conflict, identity, scoring, utility
from grainmill.plans import parts, registry
from tests.conftest import SF
from tests.oracle import check

GOOD = {f: 0.5 for f in FIELDS} | {"fineweb_edu": [2.5], "fluency_en": [0.0, 10.0], "ad_en": [10.0, 0.0], "qurater": [1.0, 2.0, 3.0, 4.0]} | {f: [0.0] * 5 + [10.0] for f in FIELDS if f.startswith("modernbert")}
SCHEMA = ", ".join(f"{f} {'array<double>' if f in LENGTHS else 'double'}" for f in FIELDS)


def records(spark, *changes):
    return spark.createDataFrame([tuple((GOOD | c)[f] for f in FIELDS) + (i,) for i, c in enumerate(changes)], SCHEMA + ", k long")


def test_decode_directions(spark):
    r = decode(records(spark, {}), ["k"], with_ordinal=True, with_issues=True).first()
    assert r.issues == [] and r.fluency_en > 0.99 and r.ad_en < 0.01 and r.modernbert_reasoning > 0.99 and r.o_modernbert_reasoning == 1.0
    assert (r.qurater_0, r.qurater_3, r.fineweb_edu) == (1.0, 4.0, 2.5) and r.rps_doc_frac_unique_words == 0.005


def test_decode_failures(spark):
    nan, inf = float("nan"), float("inf")
    bad = [{"fineweb_edu": None}, {"ad_en": [1.0]}, {"qurater": [1.0, nan, 1.0, 1.0]}, {"dsir_math": inf}, {"rps_doc_word_count": -1.0}, {"rps_doc_frac_unique_words": 101.0}, {"fluency_en": []}, {"qurater": [1.0, None, 2.0, 3.0]}, {"dsir_wiki": None}]
    got = [r.issues for r in decode(records(spark, *bad), ["k"], with_issues=True).orderBy("k").collect()]
    assert got == [["fineweb_edu:shape"], ["ad_en:shape"], ["qurater:nonfinite"], ["dsir_math:nonfinite"], ["rps_doc_word_count:negative_statistic"], ["rps_doc_frac_unique_words:percent_range"], ["fluency_en:shape"], ["qurater:nonfinite"], ["dsir_wiki:type"]]


def test_extra_columns_and_empty(spark):
    assert decode(records(spark).withColumn("issues", F.lit(1)), ["k"]).count() == 0


def test_fit_apply_and_monotony(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "github" if i % 2 else "c4", *[None if rng.random() < 0.1 else float(rng.random()) for _ in ATOMIC[:-1]], None) for i in range(80)]
    df = spark.createDataFrame(rows, "k long, domain string, " + ", ".join(f"{c} double" for c in ATOMIC))
    f = utility.fit(df, "domain", "k")
    assert ATOMIC[-1] in f.unavailable and set(f.domain_medians) == {"github", "c4"}
    u = utility.apply_utilities(df, "domain", f, ["k"])
    low, high = u.agg(*[F.min(f"z_{c}").alias(f"a{c}") for c in FIELDS]).first(), u.agg(*[F.max(f"z_{c}") for c in FIELDS]).first()
    assert min(low) >= 0 and max(high) <= 1
    assert {r.v for r in u.join(df, "k").where("domain = 'github'").select(F.col("z_rps_lines_ending_with_terminal_punctution_mark").alias("v")).collect()} == {0.5}
    w = scoring.shrink(scoring.critic(u, [f"z_{c}" for c in FIELDS]), 0.5)
    s0 = {r.k: r.q_rule for r in scoring.scores(u, w, w, ["k"]).collect()}
    s1 = {r.k: r.q_rule for r in scoring.scores(u.withColumn("z_ad_en", F.least(F.lit(1.0), F.col("z_ad_en") + 0.2)), w, w, ["k"]).collect()}
    assert all(s1[k] >= s0[k] - 1e-12 for k in s0)
    # rows that aren't in the reference never change what was fitted
    assert utility.fit(df.where("k < 40"), "domain", "k").medians != f.medians


def test_validation():
    utility.validate(utility.SPECS)
    with pytest.raises(ValueError):
        utility.validate({})
    with pytest.raises(ValueError):
        utility.validate(utility.SPECS, high=0.2)
    with pytest.raises(ValueError):
        scoring.interaction(np.full(4, 0.25), [(0, 1)], 1.5)
    with pytest.raises(ValueError):
        scoring.edges([("a", "b"), ("b", "a")], ["a", "b"])


def test_schemes_cover_every_column_once():
    for name, n in (("A22", 22), ("B23_flat", 23), ("B20_hierarchical", 20)):
        s = scoring.schemes(np.array([0.1, 0.2, 0.3, 0.4]))[name]
        assert len(s) == n and sorted(c for p in s.values() for c in p) == sorted(ATOMIC)
    assert len(scoring.scheme_edges(list(scoring.schemes(np.ones(4) / 4)["B23_flat"]))) == 7


def test_identity(spark):
    df = spark.createDataFrame([("A3", 2, "u"), ("A1", 5, "u"), ("A2", 1, "v"), ("A2", 3, "v")], "source_label string, row_key long, uid string")
    got = {r.uid: (r.row_key, r.membership) for r in identity.first_seen(df).collect()}
    assert got == {"u": (5, "A1;A3"), "v": (1, "A2")}


def test_relevance_argmax_and_huber(spark):
    """Scenario scores of two records by plain arithmetic: the relevance score has its own weights in the pair penalties, too."""
    rng = np.random.default_rng(4)
    z = rng.random((2, 22))
    rows = [(i, *map(float, z[i]), None if i else 0.4) for i in range(2)]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"z_{f} double" for f in FIELDS) + ", o_modernbert_reasoning double")
    w = np.full(22, 1 / 22)
    got = {r.k: r for r in scoring.scores(df, w, w, ["k"]).collect()}
    at = {f: i for i, f in enumerate(FIELDS)}

    def rule(v, w):
        degree = {f: sum(f in p for p in scoring.PAIRS) for p in scoring.PAIRS for f in p}
        return v @ w - sum(0.25 * min(w[at[a]] / degree[a], w[at[b]] / degree[b]) * abs(v[at[a]] - v[at[b]]) for a, b in scoring.PAIRS)

    weak = np.array([x * (0.25 if f in scoring.DOWNWEIGHTED else 1) for f, x in zip(FIELDS, w)])
    weak /= weak.sum()
    for i in range(2):
        alt = z[i].copy()
        if i == 0:
            alt[at["modernbert_reasoning"]] = 0.4
        assert got[i].q_relevance_downweighted == pytest.approx(rule(z[i], weak)) and got[i].q_argmax == pytest.approx(rule(alt, w)) and got[i].q_rule == pytest.approx(rule(z[i], w))
        m = np.median(z[i])
        for _ in range(30):
            u = np.minimum(1, 0.15 / np.maximum(np.abs(z[i] - m), 1e-12))
            m = (u * z[i]).sum() / u.sum()
        assert got[i].q_huber == pytest.approx(m)


def test_bisected_quantiles_by_brute_force(spark):
    """Ties across groups of different weights, NULLs, a group without values, a constant column."""
    rng = np.random.default_rng(5)
    rows = [(int(g), i, [0.1, 0.02, 0.3][g], float(rng.integers(0, 6)) if rng.random() < 0.8 else None, 4.0, float(rng.lognormal(0, 3))) for i, g in enumerate(rng.integers(0, 3, 500))] + [(3, 900, 1.0, None, None, None)]
    df = spark.createDataFrame(rows, "g int, k long, w double, a double, b double, c double").repartition(5)
    probs = (0.01, 0.05, 0.5, 0.95, 1.0)
    wanted = [(g, c, p) for g in (-1, 0, 1, 2, 3) for c in range(3) for p in probs]
    got = brackets.search(df, ["a", "b", "c"], wanted)
    for g, c, p in wanted:
        mine = sorted((r[3 + c], r[1], r[2] if g < 0 else 1.0) for r in rows if r[3 + c] is not None and g in (-1, r[0]))
        if not mine:
            assert (g, c, p) not in got
            continue
        w = np.array([m[2] for m in mine])
        want = np.interp(p * w.sum(), np.cumsum(w) - w / 2, [m[0] for m in mine])
        assert got[g, c, p].value() == pytest.approx(want, abs=1e-9), (g, c, p)
    assert brackets.search(df.limit(0), ["a", "b", "c"], wanted) == {}


def test_fitted_is_saved_and_loaded(spark, tmp_path):
    rows, fitted = parts.fitted_records(spark, SF)
    utility.save(fitted, spark, f"{tmp_path}/fit")
    assert utility.load(spark, f"{tmp_path}/fit") == fitted
    with pytest.raises(Exception):
        utility.save(fitted, spark, f"{tmp_path}/fit")


def test_factor_rotation():
    load = np.array([[0.8, 0.1], [0.7, 0.0], [0.1, 0.9], [0.0, 0.6]])
    turned = conflict.varimax(load)
    assert np.allclose((turned**2).sum(1), (load**2).sum(1))
    spread = lambda m: (m**4).mean(0).sum() - ((m**2).mean(0) ** 2).sum()
    turns = [load @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]) for a in np.linspace(0, np.pi, 721)]
    assert spread(turned) >= max(map(spread, turns)) - 1e-9  # no rotation of the plane does better
    pattern, phi = conflict.promax(load)
    assert np.allclose(pattern @ phi @ pattern.T, load @ load.T, atol=1e-6) and np.allclose(np.diag(phi), 1)
    one, unit = conflict.promax(load[:, :1])
    assert np.allclose(one, load[:, :1]) and unit.shape == (1, 1)


def test_factors_of_a_known_structure():
    """Two factors that were put in come out: their number, the communalities, and which field belongs to which."""
    rng = np.random.default_rng(2)
    f = rng.standard_normal((4000, 2))
    truth = np.array([[0.8, 0], [0.7, 0], [0.75, 0], [0, 0.8], [0, 0.7], [0, 0.6]])
    x = f @ truth.T + rng.standard_normal((4000, 6)) * np.sqrt(1 - (truth**2).sum(1))
    count, values, bar = conflict.parallel_count(x, 30, 5, 1)
    assert count == 2 and (np.diff(values) <= 0).all() and len(bar) == 6
    load, settled = conflict.principal_axes(np.corrcoef(x, rowvar=False), 2)
    assert settled and np.allclose((load**2).sum(1), (truth**2).sum(1), atol=0.06)
    pattern, _ = conflict.promax(load)
    assert len({int(k) for k in np.abs(pattern[:3]).argmax(1)}) == 1 and np.allclose(np.sort(np.abs(pattern), 1)[:, 1], truth.max(1), atol=0.06)


@pytest.mark.parametrize("name", ["decode_issues", "dedup_first_seen", "weighted_bounds", "quality_scores", "domain_summary", "ks_by_domain", "group_redundancy", "conflict_pairs"])
def test_against_sql(spark, name):
    check(spark, registry.queries()[name], registry.oracle_sql()[name])


def test_conflicts_of_every_dataset(spark):
    from grainmill.plans import experiments

    u = experiments._strata(spark, SF).select("membership", "stratum", *experiments.Z).toPandas()
    got = experiments.conflict_pairs_datasets(spark, SF).toPandas()
    assert set(got.dataset) == {"A1", "A2", "A3", "union"}
    for d, t in got.groupby("dataset"):
        part = u if d == "union" else u[[d in m.split(";") for m in u.membership]]
        z = part[experiments.Z].to_numpy(float)
        h, low = (z > 0.75).astype(float), (z < 0.25).astype(float)
        want = sum(np.outer(h[g].sum(0), low[g].sum(0)) / len(g) for g in ((part.stratum == s).to_numpy().nonzero()[0] for s in part.stratum.unique()))
        at = [(FIELDS.index(a), FIELDS.index(b)) for a, b in zip(t.high_field, t.low_field)]
        assert len(t) == 22 * 21 and set(t.n) == {len(part)}
        assert [int((h.T @ low)[k]) for k in at] == t["count"].tolist() and np.allclose([want[k] for k in at], t.expected, atol=1e-4)


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and registry.FLAGSHIP in registry.queries()
    assert parts.UTILITIES and SF
