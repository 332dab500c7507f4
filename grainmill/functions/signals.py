"""The 22 quality signals of a record, decoded to 25 scalars.

Lists must have their exact length and only finite values, scalars must be finite, shares lie in 0..100 and statistics may not be
negative; what fails is NULL, with an issue ``field:reason``. Two-class logits become the probability of class 1, six-level
logits the expected level over 5. Probabilities and levels are rounded to 12 digits, so that equal logit differences
tie. Everything is JVM-side column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The record's fields in their order, and the lengths of those that are lists.
FIELDS = (
    "fineweb_edu", "fluency_en", "modernbert_cleanliness", "modernbert_readability", "modernbert_reasoning", "modernbert_professionalism",
    "qurater", "ad_en", "dsir_books", "dsir_wiki", "dsir_math", "rps_doc_word_count", "rps_doc_num_sentences", "rps_doc_unigram_entropy",
    "rps_doc_frac_unique_words", "rps_doc_frac_no_alph_words", "rps_doc_frac_chars_top_2gram", "rps_doc_frac_chars_top_3gram",
    "rps_lines_uppercase_letter_fraction", "rps_lines_ending_with_terminal_punctution_mark", "rps_lines_numerical_chars_fraction",
    "rps_doc_mean_word_length",
)
LENGTHS = {"fineweb_edu": 1, "fluency_en": 2, "ad_en": 2, "qurater": 4} | {f: 6 for f in FIELDS if f.startswith("modernbert_")}
ORDINAL = tuple(f for f, n in LENGTHS.items() if n == 6)
PERCENT = frozenset(f for f in FIELDS if "frac" in f or f.startswith("rps_lines_ending"))
QURATER = tuple(f"qurater_{i}" for i in range(4))
ATOMIC = tuple(c for f in FIELDS for c in (QURATER if f == "qurater" else (f,)))


def finite(c: Column) -> Column:
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def list_ok(f: str, n: int) -> str:
    """SQL: a list of exactly n finite numbers."""
    return f"(size({f}) = {n} AND NOT exists({f}, v -> v IS NULL OR isnan(v) OR abs(v) = double('infinity')))"


def first_maximum(c: Column) -> Column:
    """Level of the first largest logit over 5."""
    return (F.array_position(c, F.array_max(c)) - 1) / F.lit(5.0)


def scalar_sql(f: str) -> dict[str, str]:
    """The scalars of one field as Spark SQL expressions, NULL where the field doesn't decode: one parse each, not a call per node."""
    n = LENGTHS.get(f)
    if n:
        ok = list_ok(f, n)
        if f == "qurater":
            return {name: f"CASE WHEN {ok} THEN {f}[{i}] END" for i, name in enumerate(QURATER)}
        if n == 1:
            return {f: f"CASE WHEN {ok} THEN {f}[0] END"}
        if n == 2:
            return {f: f"CASE WHEN {ok} THEN round(1D / (1D + exp({f}[0] - {f}[1])), 12) END"}
        # shifted by the first logit, so that only their differences count
        e = [f"exp({f}[{i}] - {f}[0])" for i in range(6)]
        return {f: f"CASE WHEN {ok} THEN round(({' + '.join(f'{x} * {i / 5}D' for i, x in enumerate(e))}) / ({' + '.join(e)}), 12) END"}
    finite_ = f"{f} IS NOT NULL AND NOT isnan({f}) AND abs({f}) <> double('infinity')"
    if f in PERCENT:
        return {f: f"CASE WHEN {finite_} AND {f} BETWEEN 0 AND 100 THEN {f} / 100D END"}
    if f.startswith("rps_"):
        return {f: f"CASE WHEN {finite_} AND {f} >= 0 THEN {f} END"}
    return {f: f"CASE WHEN {finite_} THEN {f} END"}


def scalars() -> dict[str, Column]:
    """The 25 scalars by name."""
    return {name: F.expr(e) for f in FIELDS for name, e in scalar_sql(f).items()}


def issue(f: str) -> Column:
    """Reason code of one field, NULL where it decodes."""
    c, n = F.col(f), LENGTHS.get(f)
    if n:
        reason = F.when(c.isNull() | (F.size(c) != n), "shape").when(~F.expr(list_ok(f, n)), "nonfinite")
    else:
        reason = F.when(c.isNull(), "type").when(finite(c).isNull(), "nonfinite")
        if f in PERCENT:
            reason = reason.when(~c.between(0, 100), "percent_range")
        elif f.startswith("rps_"):
            reason = reason.when(c < 0, "negative_statistic")
    return F.when(reason.isNotNull(), F.concat(F.lit(f + ":"), reason))


def decode(df: DataFrame, keep: list[str], with_ordinal: bool = False, with_issues: bool = False) -> DataFrame:
    """``keep`` and the 25 scalars; ``o_*`` the alternative ordinal ratings, ``issues`` the reason codes."""
    cols = [c.alias(n) for n, c in scalars().items()]
    if with_ordinal:
        cols += [F.when(F.expr(list_ok(f, 6)), first_maximum(F.col(f))).alias(f"o_{f}") for f in ORDINAL]
    if with_issues:
        cols.append(F.array_compact(F.array(*[issue(f) for f in FIELDS])).alias("issues"))
    return df.select(*keep, *cols)


# SQL of the same rules.
def sql_scalar(f: str) -> dict[str, str]:
    """DuckDB expressions of one field's scalars."""
    n = LENGTHS.get(f)
    if n:
        ok = f"len({f}) = {n} AND len(list_filter({f}, lambda x: isfinite(x))) = {n}"
        if f == "qurater":
            return {q: f"CASE WHEN {ok} THEN {f}[{i + 1}] END" for i, q in enumerate(QURATER)}
        if n == 1:
            return {f: f"CASE WHEN {ok} THEN {f}[1] END"}
        if n == 2:
            return {f: f"CASE WHEN {ok} THEN round(1 / (1 + exp({f}[1] - {f}[2])), 12) END"}
        level = " + ".join(f"exp({f}[{i + 1}]) * {i / 5}::DOUBLE" for i in range(6))
        return {f: f"CASE WHEN {ok} THEN round(({level}) / ({' + '.join(f'exp({f}[{i + 1}])' for i in range(6))}), 12) END"}
    if f in PERCENT:
        return {f: f"CASE WHEN isfinite({f}) AND {f} BETWEEN 0 AND 100 THEN {f} / 100 END"}
    if f.startswith("rps_"):
        return {f: f"CASE WHEN isfinite({f}) AND {f} >= 0 THEN {f} END"}
    return {f: f"CASE WHEN isfinite({f}) THEN {f} END"}


SQL_SCALARS = ", ".join(f"{e} AS {n}" for f in FIELDS for n, e in sql_scalar(f).items())
SQL_ORDINALS = ", ".join(f"CASE WHEN len({f}) = 6 AND len(list_filter({f}, lambda x: isfinite(x))) = 6 THEN (list_position({f}, list_max({f})) - 1) / 5::DOUBLE END AS o_{f}" for f in ORDINAL)
