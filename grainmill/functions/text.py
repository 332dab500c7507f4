"""Eleven text statistics of a document, and light ones that stay in the JVM.

Sentences, shares of non-letters and capitals and the ends of lines are column expressions. The statistics of words need Unicode decomposition
and first-seen ties of n-grams, which built-ins lack: one row-local Arrow pass over whole texts gives them. Words are those of the text without ASCII
punctuation, lower-cased, decomposed, split at white space. NULL and empty texts have 0 words, 0 n-gram shares and NULL ratios.
"""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names of the statistics, in their order.
STATISTICS = (
    "rps_doc_word_count", "rps_doc_num_sentences", "rps_doc_unigram_entropy", "rps_doc_frac_unique_words", "rps_doc_frac_no_alph_words", "rps_doc_frac_chars_top_2gram",
    "rps_doc_frac_chars_top_3gram", "rps_lines_uppercase_letter_fraction", "rps_lines_ending_with_terminal_punctution_mark", "rps_lines_numerical_chars_fraction", "rps_doc_mean_word_length",
)
# A sentence's span, and a line's end: a mark, then what may follow it.
SPAN = r"(?U)\b[^.!?]+[.!?]*"
ENDED = "(?U)[.!?][}\\])\"' ”]*\\s*$"
_BY_WORDS = ("rps_doc_word_count", "rps_doc_unigram_entropy", "rps_doc_frac_unique_words", "rps_doc_frac_chars_top_2gram", "rps_doc_frac_chars_top_3gram", "rps_lines_numerical_chars_fraction", "rps_doc_mean_word_length")
_PUNCTUATION = dict.fromkeys(map(ord, string.punctuation))


def by_columns(text: Column) -> dict[str, Column]:
    """The statistics that built-ins express; shares in percent, NULL for NULL and empty texts."""
    t = F.coalesce(text, F.lit(""))
    lines = F.split(t, "\n", -1)
    # a line counts with its line feed; what follows the last one is a line unless it is empty
    last = F.size(lines) - 1
    whole = F.filter(F.transform(lines, lambda x, i: F.when(i < last, F.concat(x, F.lit("\n"))).otherwise(x)), lambda x: x != "")
    share = lambda x, pattern: (F.length(x) - F.length(F.regexp_replace(x, pattern, ""))) / F.length(x)
    mean = lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), F.size(a))
    return {
        "rps_doc_num_sentences": F.regexp_count(t, F.lit(SPAN)).cast("double"),
        "rps_doc_frac_no_alph_words": F.when(t != "", 100.0 - 100.0 * share(t, "[a-zA-Z]")),
        "rps_lines_uppercase_letter_fraction": F.when(t != "", 100.0 * mean(F.transform(whole, lambda x: share(x, r"(?U)\p{Upper}")))),
        "rps_lines_ending_with_terminal_punctution_mark": 100.0 * mean(F.transform(lines, lambda x: x.rlike(ENDED).cast("double"))),
    }


def normalised(text: str) -> str:
    """Without ASCII punctuation, lower case, single blanks, decomposed."""
    return unicodedata.normalize("NFD", " ".join(text.translate(_PUNCTUATION).lower().split()))


def commonest_share(ids: np.ndarray, sizes: np.ndarray, n: int) -> float:
    """Share of all word characters in the occurrences of the n-gram that occurs most, the first of them among ties; 0 where none occurs twice."""
    if len(ids) < n:
        return 0.0
    windows = np.lib.stride_tricks.sliding_window_view(ids, n)
    _, first, count = np.unique(windows, axis=0, return_index=True, return_counts=True)
    top = count.max()
    at = first[count == top].min()
    return float(top * sizes[at : at + n].sum() / sizes.sum()) if top > 1 else 0.0


def by_words(text: str | None) -> dict[str, float | None]:
    """The statistics of one text's words and of its lines' digits."""
    words = normalised(text or "").split(" ")
    words = words if words != [""] else []
    digits = [sum(map(str.isdigit, x)) / len(x) for x in map(normalised, (text or "").split("\n")) if x]
    out = dict.fromkeys(_BY_WORDS) | {"rps_doc_word_count": float(len(words)), "rps_doc_frac_chars_top_2gram": 0.0, "rps_doc_frac_chars_top_3gram": 0.0}
    out["rps_lines_numerical_chars_fraction"] = 100.0 * float(np.mean(digits)) if digits else None
    if words:
        kinds, ids, count = np.unique(np.array(words, object), return_inverse=True, return_counts=True)
        share, sizes = count / len(words), np.fromiter(map(len, words), np.int64)
        out["rps_doc_unigram_entropy"] = round(float(-(share @ np.log(share))) + 0.0, 8)
        out["rps_doc_frac_unique_words"] = 100.0 * len(kinds) / len(words)
        out["rps_doc_mean_word_length"] = float(sizes.mean())
        for n in (2, 3):
            out[f"rps_doc_frac_chars_top_{n}gram"] = 100.0 * round(commonest_share(ids, sizes, n), 8)
    return out


def add_statistics(df: DataFrame, text: str) -> DataFrame:
    """``df`` without ``text``, with the eleven columns added; clashing names are an error. No shuffle."""
    kept = [c for c in df.columns if c != text]
    if clash := {c.lower() for c in kept} & set(STATISTICS):
        raise ValueError(f"columns clash: {sorted(clash)}")
    known = by_columns(F.col(text))
    front = df.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(n) for n, c in known.items()], F.col(text).alias("_text"))
    names = [*kept, *known]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [by_words(t) for t in b.column(len(names)).to_pylist()]
            cols = [pa.array([r[c] for r in rows], pa.float64()) for c in _BY_WORDS]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), *cols], [*names, *_BY_WORDS])

    schema = ", ".join([*(f"`{c}` {front.schema[c].dataType.simpleString()}" for c in names), *(f"{c} double" for c in _BY_WORDS)])
    return front.mapInArrow(run, schema).select(*[F.col(f"`{c}`") for c in kept], *STATISTICS)


def light(t: Column) -> dict[str, Column]:
    """Statistics by built-ins alone: log size, shares of non-letters, digits, capitals and blanks, log lines. NULL for NULL and empty texts."""
    n = F.length(t)
    share = lambda p: F.try_divide(F.length(F.regexp_replace(t, p, "")).cast("double"), n)  # noqa: E731  what the pattern leaves
    return {
        "log_chars": F.when(n > 0, F.log1p(n.cast("double"))), "non_letters": share("[a-zA-Z]"), "digits": share("[^0-9]"), "capitals": share("[^A-Z]"), "blanks": share("[^ ]"),
        "log_lines": F.when(n > 0, F.log1p(F.length(F.regexp_replace(t, "[^\n]", "")).cast("double"))),
    }


SQL_LIGHT = {
    "log_chars": "ln(1 + length(t)::DOUBLE)", "non_letters": "length(regexp_replace(t, '[a-zA-Z]', '', 'g')) / length(t)::DOUBLE", "digits": "length(regexp_replace(t, '[^0-9]', '', 'g')) / length(t)::DOUBLE",
    "capitals": "length(regexp_replace(t, '[^A-Z]', '', 'g')) / length(t)::DOUBLE", "blanks": "length(regexp_replace(t, '[^ ]', '', 'g')) / length(t)::DOUBLE", "log_lines": "ln(1 + length(regexp_replace(t, '[^\n]', '', 'g'))::DOUBLE)",
}
