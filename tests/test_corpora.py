import json
import lzma
import math
import re
import string
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.functions import text
from grainmill.operators import conflict, mixture, transfer
from grainmill.plans import registry
from grainmill.sources import tables
from tests.oracle import check


TEXTS = ["A b a b a b.", "A b c d e f.", "A1!", None, "", "É", "Done.\n", "x y x y z z y x", " \n\n ", 'He said "yes." \nNO! (Really?)\n3 of 4', "one", "ÀB cd\r\nEF 12", "a.b.c... d", "Ends here.”", "tab\tend. \t"]


def test_text_statistics(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k long, t string")
    got = {TEXTS[r.k]: r.asDict() for r in text.add_statistics(df, "t").collect()}
    a, b = got["A b a b a b."], got["A b c d e f."]
    assert a["rps_doc_word_count"] == 6 and a["rps_doc_frac_chars_top_2gram"] > b["rps_doc_frac_chars_top_2gram"] == 0
    assert got["A1!"]["rps_doc_frac_no_alph_words"] == pytest.approx(200 / 3)
    assert {k: v for k, v in got[None].items() if k != "k"} == {k: v for k, v in got[""].items() if k != "k"} and got[""]["rps_doc_word_count"] == 0 and got[""]["rps_doc_unigram_entropy"] is None
    assert got["É"]["rps_doc_mean_word_length"] == 2  # decomposed
    assert got["x y x y z z y x"]["rps_doc_frac_chars_top_2gram"] == pytest.approx(50)  # x y twice, the first of the commonest
    assert got["Done.\n"]["rps_lines_ending_with_terminal_punctution_mark"] == 50  # the end of the last line opens an empty one
    for t, row in got.items():
        for name, want in by_hand(t or "").items():
            assert row[name] == (None if want is None else pytest.approx(want, abs=1e-6)), (t, name)


def by_hand(t: str) -> dict:
    """What can be said of a text line by line, without the package's code."""
    lines = t.splitlines(keepends=True) if "\r" not in t else [x + "\n" for x in t.split("\n")[:-1]] + [t.split("\n")[-1]]
    upper = [100 * len([c for c in x if c.isupper()]) / len(x) for x in lines if x]
    ends = [x.strip() and x.rstrip().rstrip("}])\"' ”")[-1:] in list(".!?") for x in t.split("\n")]
    words = re.sub(f"[{re.escape(string.punctuation)}]", "", t).lower().split()
    n = Counter(unicodedata.normalize("NFD", w) for w in words)
    return {
        "rps_lines_uppercase_letter_fraction": sum(upper) / len(upper) if upper else None, "rps_lines_ending_with_terminal_punctution_mark": 100 * sum(map(bool, ends)) / len(ends),
        "rps_doc_unigram_entropy": -sum(c / len(words) * math.log(c / len(words)) for c in n.values()) if words else None, "rps_doc_frac_unique_words": 100 * len(n) / len(words) if words else None,
        "rps_doc_num_sentences": float(len(re.findall(r"\b[^.!?]+[.!?]*", t))),
    }


def test_text_pass_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (3, "w" * 100_000, "z")], "k long, t string, note string")
    got = {r.k: (r.rps_doc_word_count, r.note) for r in text.add_statistics(df, "t").collect()}
    assert got == {1: (2.0, "x"), 2: (0.0, "y"), 3: (1.0, "z")}
    with pytest.raises(ValueError):
        text.add_statistics(df.withColumn("rps_doc_word_count", F.lit(1)), "t")


def test_least_hash_is_deterministic(spark):
    df = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 1)], "g string, k long")
    pick = lambda d: {(r.g, r.k) for r in conflict.least_hash(d, "g", F.col("k").cast("string"), 3, "k").collect()}
    assert pick(df) == pick(df.repartition(3)) and len(pick(df)) == 4


def test_bridge_arithmetic(spark):
    r = spark.createDataFrame([(1, "arxiv", 0.25), (1, "other", 0.75)], "index long, domain string, p double")
    known = spark.createDataFrame([("arxiv", "arxiv"), ("other", "(none)")], "domain string, quality_domain string")
    q = spark.createDataFrame([("arxiv", 0.8, 0.75, 0.85)], "quality_domain string, q double, low double, high double")
    ext = spark.createDataFrame([("arxiv", 0.7)], "quality_domain string, q_ext double")
    b = transfer.bridge(r, known, q, ext).first()
    assert [round(x, 6) for x in (b.mapped_mass, b.on_mapped_mass, b.lower, b.upper, b.lower_ci, b.upper_ci, b.extension_filled)] == [0.25, 0.8, 0.2, 0.95, 0.1875, 0.9625, 0.775]


def test_soft_weights(spark):
    d = spark.createDataFrame([("t", "a", 1.0), ("t", "b", 3.0)], "domain string, quality_domain string, distance double")
    w = {t: {r.quality_domain: r.weight for r in transfer.soft_weights(d, ["domain"], t).collect()} for t in (0.5, 1.0)}
    assert sum(w[1.0].values()) == pytest.approx(1) and w[0.5]["a"] > w[1.0]["a"] > 0.5


def test_calibration_slope_is_never_negative(spark):
    df = spark.createDataFrame([("f", x / 29, 1 - x / 29) for x in range(30)], "g string, r double, o double")
    c = transfer.calibration(df, ["g"], "r", "o").first()
    assert c.slope == 0 and c.intercept == pytest.approx(0.5)


def test_mixture_models(spark):
    rng = np.random.default_rng(19)
    p = rng.dirichlet(np.ones(17), 48)
    y = p @ rng.normal(size=(17, 3)) + 5
    assert mixture.expand(p, True).shape[1] == 153
    a, b = mixture.Ridge(p, y, 0.01, 10, True), mixture.Ridge(p, y, 0.01, 10, True, np.zeros((17, 17)))
    assert np.allclose(a.predict(p), b.predict(p), atol=1e-10)
    assert np.abs(mixture.Kernel(p, y, 0.25, 1e-8).predict(p) - y).max() < 0.05
    with pytest.raises(ValueError):
        mixture.anchor_prior(np.ones(17), np.ones(17, bool), 1.0)
    with pytest.raises(ValueError):
        mixture.validate_pair(p * 2, y)
    g = mixture.components(np.array([[1, 0, 0], [0.999, 0.001, 0], [0, 1, 0], [0, 0, 1]]), 0.01)
    assert g.tolist() == [0, 0, 2, 3] and len(set(mixture.folds(g, 2, 1)[:2])) == 1


def test_pairs_beyond_the_dense_limit(spark):
    rng = np.random.default_rng(7)
    p = rng.dirichlet(np.ones(3), mixture.MAX_RECIPES + 904)
    p[::50] = p[0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(p)], "index long, p array<double>")
    got = {r["index"]: r.nearest for r in mixture.nearest(df.where("index < 20"), df.where("index >= 20")).collect()}
    want = np.round(np.abs(p[:20, None] - p[None, 20:]).sum(2), 12).argmin(1) + 20
    assert [got[i] for i in range(20)] == want.tolist()
    label = {r["index"]: r.group_index for r in mixture.groups(df, 0.01).collect()}
    assert [label[i] for i in range(len(p))] == mixture.components(p, 0.01).tolist()
    d = mixture.squared_pairs(p, p)[np.triu_indices(len(p), 1)]
    s = mixture.pair_summary(mixture.blocks(df), mixture.squared_pairs, [0.001, 0.5, 0.9])
    assert s["pairs"] == len(d) and np.allclose(s["q"], np.quantile(d, [0.001, 0.5, 0.9]), atol=1e-11) and s["mean"] == pytest.approx(d.mean())
    assert mixture.pair_summary(mixture.blocks(df.limit(1)), mixture.squared_pairs, [0.5]) is None


@pytest.mark.parametrize("name", ["combination_effects", "median_bandwidth", "extrapolation_ratios"])
def test_pairs_against_sql(spark, name):
    check(spark, registry.queries()[name], registry.oracle_sql()[name])


def test_combinations_of_all_pairs(spark):
    from grainmill.plans import losses, mixtures
    from tests.conftest import SF

    p = np.array([r.p for r in mixtures.recipes(spark, SF)[0].orderBy("index").collect()])
    index = [r["index"] for r in mixtures.recipes(spark, SF)[0].orderBy("index").collect()]
    f = lambda v: float(mixture.expand(v[None], True)[0] @ np.array(mixtures.BETA))
    h = {(index[i], index[j]): f((p[i] + p[j]) / 2) - (f(p[i]) + f(p[j])) / 2 for i in range(len(p)) for j in range(i + 1, len(p))}
    v = np.array(list(h.values()))
    s = losses.combination_effects(spark, SF).first()
    assert s.n_pairs == len(p) * (len(p) - 1) // 2 and np.allclose(list(s)[1:], [v.mean(), *np.quantile(v, [0.1, 0.5, 0.9]), v.min(), v.max()], atol=1e-7)
    got = losses.combination_extremes(spark, SF).collect()
    for end, want in (("lowest", np.sort(v)[:10]), ("highest", np.sort(v)[-10:])):
        rows = [r for r in got if r.end == end]
        assert np.allclose(sorted(r.h for r in rows), want, atol=1e-7) and all(abs(h[r.index_a, r.index_b] - r.h) < 1e-7 for r in rows)


def test_summaries_share_their_passes(spark):
    from grainmill.plans import losses

    rng = np.random.default_rng(11)
    p = rng.dirichlet(np.ones(5), 90)
    p[60:] = p[:30]  # equal recipes, tied values
    betas = np.column_stack([rng.normal(size=(15, 3)), np.zeros(15)])
    table = mixture.blocks(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(p)], "index long, p array<double>"))
    passes = []
    squares, mixture.squares = mixture.squares, lambda *a: passes.append(mixture._square) or squares(*a)
    try:
        got = mixture.pair_summaries(table, losses._gaps(betas), [0.1, 0.5, 0.9])
    finally:
        mixture.squares = squares
    assert len(got) == 4 and len(passes) == 1
    for k, s in enumerate(got):
        v = np.concatenate([r[i + 1 :] for i, r in enumerate(losses._gap(betas[:, k])(p, p))])
        assert s["pairs"] == len(v) and np.allclose([s["mean"], *s["q"], s["low"], s["high"]], [v.mean(), *np.quantile(v, [0.1, 0.5, 0.9]), v.min(), v.max()], atol=1e-12)


def test_kernels_beyond_the_dense_limit(monkeypatch):
    rng = np.random.default_rng(23)
    p = rng.dirichlet(np.full(5, 13.0), 400)
    p[350:], y = p[:50], rng.exponential(50, (400, 2))
    far = np.vstack([rng.dirichlet(np.full(5, 13.0), 30), np.eye(5)])
    cases = [(p, 0.25, [1e-4, 1e-2]), (p, 1.0, [1e-4, 1e-2]), (p, 4.0, [1e-2, 1.0]), (np.vstack([p[:399], np.eye(5)[:1]]), 1.0, [1e-4]), (np.tile(p[:1], (400, 1)), 1.0, [1e-2])]
    want = [[m.predict(far) for m in mixture.kernels(x, y, g, lams)] for x, g, lams in cases]
    monkeypatch.setattr(mixture, "MAX_RECIPES", 9)
    for few in (2048, 20):  # recipes among which the centres are first looked for
        monkeypatch.setattr(mixture, "FIRST", few)
        for (x, g, lams), expected in zip(cases, want):
            got = mixture.kernels(x, y, g, lams)
            assert all(np.allclose(m.predict(far), w, atol=1e-3) for m, w in zip(got, expected)) and len(got[0].p) < 400
    d = mixture.squared(p, p)[np.triu_indices(400, 1)]
    for cells in (1 << 22, 10):
        monkeypatch.setattr(mixture, "CELLS", cells)
        assert mixture.median_squared(p) == pytest.approx(np.median(d), rel=1e-10) and mixture.median_squared(p[:3]) == pytest.approx(np.median(mixture.squared(p[:3], p[:3])[np.triu_indices(3, 1)]))
    assert mixture.median_squared(np.tile(p[:1], (9, 1))) < 1e-12
    assert mixture.components(np.round(p, 2), 0.021).tolist() == _closure(np.round(p, 2), 0.021)


def _closure(p, threshold):
    near = np.abs(p[:, None] - p).sum(2) <= threshold
    label = np.arange(len(p))
    for _ in range(len(p)):
        label = np.array([label[n].min() for n in near])
    return label.tolist()


@pytest.mark.parametrize("name", ["model_evaluation", "paired_bootstrap", "variant_cv", "alternative_refits", "centred_benchmark", "gain_decision", "grid_cv", "ranking_stability", "variant_metrics", "gain_intervals", "placebo_quality", "variant_output_metrics"])
def test_models_beyond_the_dense_limit(spark, name, monkeypatch, tmp_path):
    from grainmill.plans import bridge, parts
    from tests.conftest import SF

    monkeypatch.setattr(bridge, "bridge_gate", lambda spark, sf_dir: spark.createDataFrame([(True,)], "passes boolean"))
    make, dense = registry.queries()[name], mixture.MAX_RECIPES
    monkeypatch.setattr(parts, "_kept", {})
    want = make(spark, SF).collect()
    monkeypatch.setattr(parts, "_kept", {})
    monkeypatch.setattr(mixture, "MAX_RECIPES", 4)  # of fifteen recipes
    got = make(spark, SF).collect()
    assert len(got) == len(want) > 0 and dense > 4
    for a, b in zip(got, want):
        assert all(x == pytest.approx(y, abs=1e-3) if isinstance(y, float) else x == y for x, y in zip(a, b)), (a, b)


def test_gram(spark):
    x = np.arange(12.0).reshape(4, 3)
    df = spark.createDataFrame([(r.tolist(), [float(i)]) for i, r in enumerate(x)], "x array<double>, y array<double>").repartition(3)
    got = {(r.i, r.j): r.s for r in mixture.gram(df, "x", "y").collect()}
    assert got[1, 2] == (x.T @ x)[1, 2] and got[2, -1] == (x[:, 2] * np.arange(4)).sum()
    assert mixture.gram(df.limit(0), "x", "y").count() == 0


def test_jsonl_and_csv(spark, tmp_path):
    (tmp_path / "a.jsonl.xz").write_bytes(lzma.compress("\n".join(json.dumps({"id": i}) for i in range(3)).encode() + b"\n\n"))
    schema = T.StructType([T.StructField("id", T.LongType())])
    assert [(r.line, r.id) for r in tables.read_jsonl(spark, str(tmp_path), schema).orderBy("line").collect()] == [(1, 0), (2, 1), (3, 2)]
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n{broken\n')
    with pytest.raises(Exception, match="invalid JSON"):
        tables.read_jsonl(spark, str(tmp_path), schema).collect()
    tables.write_csv(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "c"))
    assert tables.read_csv(spark, str(tmp_path / "c"), "a int, b string").first().b == "x"
    assert tables.file_digests(spark, str(tmp_path / "a.jsonl.xz")).count() == 1
    assert tables.strip_names(spark.createDataFrame([(1,)], "train_x int"), "train_").columns == ["x"]


@pytest.mark.parametrize("name", ["text_light", "text_coverage", "stable_hash_sample", "completed_map", "quality_bridge", "replacement_effects", "l1_nearest", "near_duplicates", "ranking_regret", "stream_quality_counts"])
def test_against_sql(spark, name):
    check(spark, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", ["text_signals", "signal_audit", "grid_cv", "model_evaluation"])
def test_runs(spark, name):
    from tests.conftest import SF

    assert registry.queries()[name](spark, SF).count() > 0


def test_scorers_keep_results(spark, tmp_path):
    from grainmill.functions import scorers

    scorers.register("length", lambda texts: [[float(len(t))] for t in texts])
    df = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None), (4, "")], "k long, t string")
    cache = str(tmp_path / "cache")
    for _ in range(2):
        assert {r.k: r.scores for r in scorers.score_texts(df, "k", "t", "length", cache).collect()} == {1: [2.0], 2: [2.0], 3: None, 4: [0.0]}
        assert spark.read.parquet(cache).count() == 2
    with pytest.raises(KeyError):
        scorers.score_texts(df, "k", "t", "none", cache)


def test_labelled_files_in_order(spark, tmp_path):
    for name, rows in (("A2_x.jsonl", ['{"id": "c"}']), ("A1_b.jsonl.xz", ['{"id": "b"}', "", '{"id": "b2"}']), ("A1_a.jsonl", ['{"id": "a"}'])):
        data = ("\n".join(rows) + "\n").encode()
        (tmp_path / name).write_bytes(lzma.compress(data) if name.endswith("xz") else data)
    schema = T.StructType([T.StructField("id", T.StringType())])
    patterns = {"A1": "A1_*", "A2": "A2_*"}
    got = [(r.source_label, r.source_order, r.line, r.id) for r in tables.read_labelled(spark, str(tmp_path), patterns, schema).orderBy("source_order", "line").collect()]
    assert got == [("A1", 0, 1, "a"), ("A1", 1, 1, "b"), ("A1", 1, 3, "b2"), ("A2", 2, 1, "c")]
    with pytest.raises(FileNotFoundError):
        tables.labelled_files(spark, str(tmp_path), patterns | {"A3": "A3_*"})


def test_command_line(spark, tmp_path, capsys):
    from grainmill import cli
    from tests.conftest import SF

    assert cli.main(["list"]) == [] and "quality:" in capsys.readouterr().out
    assert cli.main(["mixtures", "--tables", SF, "--out", str(tmp_path), "--only", "pair_audit", "domain_support"], spark) == ["pair_audit", "domain_support"]
    assert spark.read.csv(f"{tmp_path}/domain_support", header=True).count() == 5
    assert all(r in registry.queries() for s in cli.STUDIES.values() for r in s)
    for bad in (["quality"], ["mixtures", "--tables", "x", "--out", "y", "--only", "quality_scores"]):
        with pytest.raises(SystemExit):
            cli.main(bad, spark)


def test_joins_and_key_sets(spark):
    from grainmill.operators import identity
    from grainmill.plans import schemes

    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, None)], "k long, id string")
    b = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("y", 3.0), (None, 4.0)], "id string, v double")
    rows, audit = identity.join_unique(a, b, ["id"])
    assert [(r.k, r.v) for r in rows.collect()] == [(1, 1.0)] and tuple(audit.first()) == (4, 1, 1, 2)
    with pytest.raises(ValueError):
        identity.join_unique(a, b, ["id"], strict=True)
    assert tuple(identity.same_keys(a, b, ["id"]).first()) == (1, 0, False) and identity.same_keys(a, a, ["id"]).first().equal
    c = spark.createDataFrame([("u", "h1"), ("u", "h2"), ("u", ""), ("v", "h1"), ("v", None)], "uid string, h string")
    assert [r.uid for r in identity.content_conflicts(c, "h").collect()] == ["u"] and identity.content_conflicts(c.where("uid = 'v'"), "h", strict=True).count() == 0
    with pytest.raises(ValueError):
        identity.content_conflicts(c, "h", strict=True)
    one = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k long, v double")
    assert schemes.merge_one_to_one(one, one.withColumnRenamed("v", "w"), "k").count() == 2
    for bad in (one.limit(1), one.unionByName(one), one.withColumn("k", F.lit(None).cast("long"))):
        with pytest.raises(ValueError):
            schemes.merge_one_to_one(one, bad.withColumnRenamed("v", "w"), "k")
    assert [r.z for r in transfer.standardised(one, "v", "z").orderBy("k").collect()] == [-1.0, 1.0] and transfer.standardised(one.limit(1), "v", "z").first().z == 0
    with pytest.raises(ValueError):
        transfer.standardised(one.withColumn("v", F.lit(None).cast("double")), "v", "z")


def test_validated_pairs(spark):
    p = spark.createDataFrame([(1, [0.5, 0.501]), (2, [1.0, 0.0])], "index long, p array<double>")
    y = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "index long, y array<double>")
    got = {r["index"]: r.p for r in mixture.validated_pairs(p, y).collect()}
    assert sum(got[1]) == pytest.approx(1) and got[2] == [1.0, 0.0]
    new = lambda rows, s: spark.createDataFrame(rows, s)
    for bad_p, bad_y in (
        (p.unionByName(p.limit(1)), y), (p.limit(1), y), (new([(1, [0.5, 0.6]), (2, [1.0, 0.0])], p.schema), y), (new([(1, [-0.1, 1.1]), (2, [1.0, 0.0])], p.schema), y),
        (p, new([(1, [0.0]), (2, [2.0])], y.schema)), (p, new([(1, [float("nan")]), (2, [2.0])], y.schema)), (new([(1, [1.0]), (2, [1.0, 0.0])], p.schema), y), (new([(1, None), (2, [1.0, 0.0])], p.schema), y),
    ):
        with pytest.raises(ValueError):
            mixture.validated_pairs(bad_p, bad_y)


def test_ridge_from_sums_is_the_ridge(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(3), 60)
    y = np.column_stack([p @ [1.0, 2.0, 3.0] + p[:, 0] * p[:, 1], p @ [2.0, 1.0, 1.0]])
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(p, y)], "p array<double>, y array<double>").repartition(4)
    m = mixture.fit_distributed(df, 3, 0.01, 10.0, True)
    assert np.allclose(m.predict(p), mixture.Ridge(p, y, 0.01, 10.0, True).predict(p), atol=1e-8)


def test_variants_and_measures():
    rng = np.random.default_rng(2)
    p, q, known = rng.dirichlet(np.ones(4), 50), np.array([1.0, -1.0, 0.5, 0.0]), np.array([1, 1, 1, 0], bool)
    y = np.column_stack([p @ [1.0, 2.0, 3.0, 4.0], p @ [2.0, 1.0, 1.0, 1.0]])
    for v in mixture.VARIANTS:
        assert np.abs(mixture.Variant(v, p, y, q, known, mixture.parameters(v)[0]).predict(p) - y).mean() < 0.2
    assert np.allclose(mixture.geometry("M3-RBF", p, q, 2.0)[:, 4:], 2 * p * q) and mixture.geometry("M123-RBF", p, q, 1.0).shape == (50, 9)
    same = mixture.Variant("M3prior-Scheffe", p, y, q, known, {"lam": 0.01, "ratio": 10.0, "prior": 0.0})
    assert np.allclose(same.predict(p), mixture.Ridge(p, y, 0.01, 10.0, True).predict(p), atol=1e-10)
    m = mixture.measures(y, y)
    assert m["rmse"] == 0 and m["r2"] == 1 and m["top5_overlap"] == 1 and m["regret_at_1"] == 0 and m["oracle_rank"] == m["best_rank_of_ten"] == 1 and m["macro_spearman"] == pytest.approx(1)
    assert mixture.rank_correlation(np.ones(5), np.arange(5)) is None
    gain, low, high = mixture.paired_interval(np.full(9, 4.0), np.full(9, 1.0), rng, 50)
    assert gain == low == high == 1


def test_bootstraps(spark):
    from grainmill.operators import resample

    c = resample.draws(np.arange(20_000), 5, 1)
    assert abs(c.mean() - 1) < 0.02 and abs(c.var() - 1) < 0.04 and abs(np.corrcoef(c.T)[0, 1]) < 0.03
    rng = np.random.default_rng(3)
    x = rng.normal(5, 2, 2000)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("b", 9000, 1.0), ("b", 9001, None)], "g string, k long, x double")
    got = {r.g: r for r in resample.mean_intervals(df.repartition(5), ["g"], "x", "k", 200, 7).collect()}
    assert got["a"].mean == pytest.approx(x.mean()) and got["a"].low < x.mean() < got["a"].high and (got["a"].high - got["a"].low) == pytest.approx(3.92 * 2 / np.sqrt(2000), rel=0.25)
    assert got["b"].n == 1 and got["b"].low == got["b"].high == 1
    again = {r.g: r for r in resample.mean_intervals(df.repartition(2), ["g"], "x", "k", 200, 7).collect()}
    assert again["a"].low == pytest.approx(got["a"].low) and resample.mean_intervals(df.limit(0), ["g"], "x", "k", 10, 1).count() == 0
    w = df.where("x IS NOT NULL").withColumn("w", F.lit(1.0)).withColumn("y", F.col("x") * 2)
    total, sums, gram = resample.stratified_moments(w, ["x", "y"], "g", "w", "k", 30, 5)
    assert np.allclose(total, 2001) and np.allclose(sums[:, 1], 2 * sums[:, 0]) and np.allclose(gram[:, 0, 1], 2 * gram[:, 0, 0])  # strata keep their size
    m = resample.group_moments(df, "g", ["x"], "k", 20, 5)
    assert m["a"][0] == pytest.approx([2000, x.sum(), (x * x).sum()]) and m["a"].shape == (21, 3)
