from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grainmill.llm import prose, readability, registry, residue
from grainmill.llm import textkit as tk
from grainmill.llm.common import slices
from tests.conftest import SF

PROSE = "The committee met in the old hall on Monday. It was raining, and most of the members had walked there. They agreed that the road should be repaired before the winter."
KINDS = {
    PROSE: "prose", PROSE.upper(): "prose", PROSE.lower().replace(".", "").replace(",", ""): "prose", PROSE.replace("the ", "the\n"): "prose", "Heading\n\n" + PROSE + "\n\n- one\n- two": "prose",
    "Der Garten ist klein, aber die Kinder spielen gern darin. Am Abend kommt der Vater nach Hause und liest.": "prose", "Ana: I will be there at nine.\nBen: That is fine with me, thank you.": "prose",
    "- red lamp\n- blue chair\n- old table\n- small box": "not running text", "Home\nAbout\nContact\nLogin\nHelp\nTerms": "not running text", "name | size | price\n---|---|---\nlamp | 3 | 10\nchair | 4 | 20": "not running text",
    "def f(x):\n    y = x + 1\n    return y\n\nfor (i = 0; i < 3; i++) {\n  g(i);\n}": "not running text", "2024-01-01 10:00:00 ERROR db[12]: retry=3\n2024-01-01 10:00:02 WARN db[12]: retry=4": "not running text",
    "http://a.example/x\nhttp://b.example/y/z\nhttp://c.example/q": "not running text", "buy lamps online. " * 20: "repetition", "xkcd#$%^&*@@!~~<<>>|||{{}}==++" * 4: "not running text", "": "empty", " \n\t": "empty",
}


@pytest.mark.parametrize("body", list(KINDS))
def test_kinds(body):
    assert prose.statistics(body, None)["kind"] == KINDS[body]


def test_words_without_sense():
    counts: dict[int, int] = {}
    k2 = tk.CLASSES**2
    for p in tk.class_pairs(PROSE * 40, "en"):
        counts[tk.LANGUAGES.index("en") * k2 + p] = counts.get(tk.LANGUAGES.index("en") * k2 + p, 0) + 1
    table = prose.ratios(counts)
    salad = " ".join(sorted(PROSE.split(), key=lambda w: hash((w, 1)) % 97 if False else w[::-1]))
    assert prose.order_score(PROSE, "en", table)[0] > prose.order_score(salad, "en", table)[0]
    assert prose.order_score("", None, table) == (None, 0)


def test_statistics_of_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 50_000), (4, PROSE)], "k long, body string").withColumn("note", F.lit("n"))
    got = {r.k: r for r in prose.text_statistics(df, "body", prose.ratios(prose.pair_counts(df, "body"))).collect()}
    assert got[1].kind == got[2].kind == "empty" and got[3].kind == "repetition" and got[4].is_prose and got[4].note == "n"
    assert got[4].sentences == 3 and 0 < got[4].punctuated_line_share <= 1
    with pytest.raises(ValueError):
        prose.text_statistics(df.withColumn("words", F.lit(1)), "body", np.zeros((4, 2, 2)))
    assert prose.text_statistics(df.limit(0), "body", prose.ratios({})).count() == 0


def test_kinds_of_one_pass(spark):
    """The pass that reads texts once gives the kinds of the full statistics."""
    bodies = [*KINDS, None, "word " * 3000] * 3
    df = spark.createDataFrame(list(enumerate(bodies)), "k long, body string").withColumn("kind", F.lit("clash"))
    a = {r.k: r.kind for r in prose.kinds(prose.evidence(df, "k", "body"), "k").collect()}
    b = {r.k: r.kind for r in prose.text_statistics(df.drop("kind"), "body", prose.ratios(prose.pair_counts(df, "body"))).collect()}
    assert a == b and len(a) == len(bodies)
    assert prose.kinds(prose.evidence(df.limit(0), "k", "body"), "k").count() == 0


def test_repetition_measures():
    assert prose.duplicate_share(["ab", "ab", "cd"]) == pytest.approx(1 / 3) and prose.duplicate_share([]) == 0
    assert prose.ngram_coverage("a b a b c".split(), 2) == pytest.approx(4 / 5) and prose.ngram_coverage(["a"], 2) == 0


# 1 reading levels
def test_syllables():
    assert [readability.syllables(w) for w in ("cat", "table", "make", "radio", "nation", "walked", "wanted", "rhythm", "education")] == [1, 2, 1, 3, 2, 1, 2, 2, 4]


def level(text):
    return readability.measure([text]).level[0]


def test_grades_order():
    easy, hard = "The cat sat. The dog ran. We had fun.", "Notwithstanding considerable methodological heterogeneity, the epidemiological investigation demonstrated statistically significant associations."
    assert level(easy) < 3 < 12 < level(hard) and np.isnan(level("")) and np.isnan(level(" 12 ")) and np.isnan(level(None))


def test_estimates_by_hand():
    """Three sentences of 3, 3 and 4 words: 10 words, 12 syllables, one hard word, 36 letters."""
    g = readability.measure(["The cat sat. Education is big. We had some fun."]).grades[0]
    n, k, syl, hard, letters = 10, 3, sum(map(readability.syllables, "the cat sat education is big we had some fun".split())), 1, 35
    want = [0.39 * n / k + 11.8 * syl / n - 15.59, 0.4 * (n / k + 100 * hard / n), 1.043 * (30 * hard / k) ** 0.5 + 3.1291, 4.71 * letters / n + 0.5 * n / k - 21.43, 5.88 * letters / n - 29.6 * k / n - 15.8, (n + 2 * hard) / k / 2 - 1]
    assert g == pytest.approx(want) and level("The cat sat. Education is big. We had some fun.") == pytest.approx(float(np.median(want)))


def test_long_sentences_count_whole():
    clause = "the party of the first part shall indemnify the party of the second part"
    long = "Notwithstanding the foregoing, " + ", and ".join([clause] * 4) + "."
    assert level(long) > level(long.replace(", and ", ". And ")) + 10
    unmarked = " ".join(["we had a dog and it ran to the red box"] * 12)  # no marks: the words say nothing of sentences
    assert level(unmarked) < 6 and readability.measure([unmarked]).sentences[0] == 11


HARD = "The theorem follows because the kernel of the homomorphism is a compact submodule. Hence the spectral sequence degenerates and the functor is exact. The cohomology therefore vanishes in positive degree. "
EASY = "The cat sat on the mat. The dog ran to the big red box. Mom said it is fun to play in the sun. "


def test_bands():
    rated = [(HARD, {"advanced": 2})] * 8 + [(EASY, {"elementary": 1})] * 8 + [("", {"middle": 1})]
    m = readability.fit(rated)
    band = lambda x, model=m: readability.assess([x], model, None)[1][0]
    assert band(HARD) == "advanced" and band(EASY) == "elementary"
    assert band(HARD + EASY * 3) == "elementary"  # most of it decides
    assert readability.fit([]) is None and readability.fit([("", {"middle": 1})]) is None and band(EASY, None) == "elementary"
    for body in (None, "", "One sentence only.", "- a\n- b\n- c\n- d"):
        assert band(body) is None
    assert readability.assess([], m, None)[1] == []
    texts = [HARD, EASY, None, HARD + EASY * 3]
    assert readability.assess(texts, m, None)[1] == [band(x) for x in texts]  # neighbours in a batch don't matter


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="needs the larger tables")
def test_bands_held_out(spark):
    """Records that the fit didn't see, against their raters: a third of the rated records is held out. Raters disagree in some of them."""
    sf = "/root/testdata/sf0.1"
    records = spark.read.parquet(f"{sf}/quality_reconstruction.parquet").where("corpus = 'A1'")
    rated = readability.rated_records(records, spark.read.parquet(f"{sf}/reading_labels.parquet"))
    known, held = [x for i, x in enumerate(rated) if i % 3], [x for i, x in enumerate(rated) if i % 3 == 0]
    got = readability.assess([t for t, _ in held], readability.fit(known), None)[1]
    wanted = [max(w, key=w.get) == "advanced" and 2 * w["advanced"] > sum(w.values()) for _, w in held]
    hits = sum(a and b == "advanced" for a, b in zip(wanted, got))
    assert hits >= 0.85 * sum(wanted) and hits >= 0.9 * got.count("advanced") > 0


# 9 residue
FOUND = [
    "404 Not Found\n\nThe requested URL /a/b was not found on this server.", "Please enable JavaScript in your browser to continue.\nHome | Contact", "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor.",
    "Dear {{ name }},\n\nThank you for choosing %PRODUCT%. Your order will arrive soon.", "Access Denied\nYou don't have permission to access this page.",
]
NOT_FOUND = [
    "How do I print a variable in a template? I wrote `{{ name }}` in the page but it prints nothing.", 'If you see the message "Access Denied", clear the cache and sign in again. ' + PROSE,
    "echo \"${HOME}/bin\"\nreturn f\"{name}\"", "Let $A_{{i}}$ denote the set. " + PROSE, PROSE, "My server returns error 500 when I post a form. " + PROSE, "", None,
]


def test_residue(spark):
    texts = FOUND * 6 + NOT_FOUND * 6
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("label", F.lit("clash"))
    rows = residue.featurise(df)
    got = {r.doc_id for r in residue.decide(rows, residue.fit(rows)).where("reason IS NOT NULL").collect()}
    assert got == {i for i, t in enumerate(texts) if t in FOUND}


def test_every_document_is_decided(spark):
    """Large documents without signs are decided by the classes, too, and texts without passages have a row."""
    page = "\n".join(f"The requested URL /a/b{i} was not on this server." for i in range(12))
    texts = FOUND * 20 + NOT_FOUND * 20 + [page, PROSE + " " + HARD + EASY, " \n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = residue.cut(residue.featurise(df))
    got = {r.doc_id: r for r in residue.decide(rows, residue.fit(rows)).collect()}
    assert sorted(got) == list(range(len(texts)))
    failed, prose_, blank = (got[len(texts) - i] for i in (3, 2, 1))
    assert failed.reason == "message" and failed.message_words > residue.SMALL
    assert prose_.reason is None and prose_.other_words > residue.SMALL and prose_.score < 0.5
    assert blank.reason is None and blank.score is None and blank.message_words == blank.other_words == 0


def test_residue_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    rows = residue.featurise(df)
    assert residue.decide(rows, residue.fit(rows)).count() == 0


def test_slices():
    b = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["a" * 5, None, "b" * 50, "c", "d", "e" * 9, ""])], ["k", "t"])
    got = [s.column(0).to_pylist() for s in slices(b, 1, 3, 10)]
    assert got == [[0, 1], [2], [3, 4], [5, 6]] and [s.num_rows for s in slices(b.slice(0, 0), 1, 3, 10)] == []


def test_very_long_texts(spark):
    """Texts of millions of characters pass whole, alone in their run, and aren't found for their length."""
    long = PROSE + " " + "The quiet river carried the boats past the old mill and on to the sea. " * 40_000
    df = spark.createDataFrame([(1, long, long), (2, FOUND[0], EASY)], "doc_id long, text string, content string").withColumn("record_key", F.col("doc_id"))
    rows = residue.cut(residue.featurise(df))
    assert {r.doc_id for r in residue.decide(rows, residue.fit(rows)).where("reason IS NOT NULL").collect()} <= {2}
    levels = {r.record_key: r for r in readability.reading_levels(df, None, np.zeros((len(tk.LANGUAGES), tk.CLASSES, tk.CLASSES))).collect()}
    assert levels[1].sentences == 40_003 and levels[2].sentences == 3


def test_marks():
    assert residue.marks("Dear {{ name }}, see %ORDER_ID%", False) == ["bare", "bare"] and residue.marks("use `{{ x }}` here", False) == ["quoted"]
    assert residue.marks("the set $A_{{i}}$", False) == ["formula"] and residue.marks("x = ${y}", True) == ["code"] and residue.marks("plain", False) == []


def test_classes_decide(spark):
    """Without their labels the trusted passages come out the same, and passages that no pattern knows are found by their words."""
    texts = FOUND * 20 + NOT_FOUND * 20 + ["The requested URL was not on this server.", "Your order %THING% will arrive soon."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = residue.cut(residue.featurise(df))
    m = residue.fit(rows)
    assert rows.where("label = 1").count() > 0 and rows.where("label = 0").count() > 0
    hidden = rows.withColumn("label", F.lit(-1))
    key = lambda r: (r.doc_id, r.reason)
    got = sorted(map(key, residue.decide(rows, m).collect()), key=str)
    assert sorted(map(key, residue.decide(hidden, m).collect()), key=str) == got
    assert dict(got)[len(texts) - 2] == "message" and dict(got)[len(texts) - 1] == "placeholder"


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="needs the larger tables")
def test_residue_held_out(spark):
    """A fifth of the trusted passages loses its label before the fit; the classes give it back."""
    rows = residue.cut(residue.featurise(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")))
    hide = (F.col("label") >= 0) & F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id", "f"), F.lit(5)) == 0)
    m = residue.fit(residue.cut(rows.withColumn("label", F.when(hide, -1).otherwise(F.col("label")))))
    held = rows.where(hide & (F.col("kind").bitwiseAND(F.lit(residue.SIGNS | residue.PLACED)) != 0)).toPandas()
    b = pa.RecordBatch.from_arrays([pa.array([x if x == x else None for x in held[c].tolist()] if c != "f" else list(map(bytes, held.f)), t) for c, t in zip(residue._NAMES[:6], (*residue._TYPES, pa.binary()))], residue._NAMES[:6])
    yes = m.posterior(b, False)[0] > 0.5
    true = held.label.to_numpy() == 1
    assert (yes & true).sum() >= 0.9 * true.sum() > 0 and (yes & true).sum() >= 0.9 * yes.sum()


def test_fixed_parts_cover_the_patterns():
    """Whatever a pattern finds holds one of its fixed parts, by which passages are passed over."""
    for text in FOUND:
        for p in text.split("\n"):
            for pattern, parts in residue._NEEDS.items():
                low = " ".join(p.lower().split())
                assert not pattern.search(p) or any(x in low for x in parts) or low[:1] in "45"


def test_runs(spark):
    """The found records are those whose statistics say so; at least one prose record and one other are there even in the smallest tables."""
    found = {r[0] for r in registry.queries()["p5_found"](spark, SF).collect()}
    stats = {r.record_key: r.kind for r in registry.queries()["p5_statistics"](spark, SF).collect()}
    assert found == {k for k, v in stats.items() if v not in ("prose", "empty")} and 0 < len(found) < len(stats)
    levels = {r.record_key: r.band for r in registry.queries()["p1_levels"](spark, SF).collect()}
    assert {r[0] for r in registry.queries()["p1_found"](spark, SF).collect()} == {k for k, v in levels.items() if v == "advanced"} and len(levels) > 0
    passages = {r.doc_id: r.reason for r in registry.queries()["p9_passages"](spark, SF).collect()}
    assert {r[0] for r in registry.queries()["p9_found"](spark, SF).collect()} == {k for k, v in passages.items() if v} != set()
