"""Problem 5: per-document text statistics, and the rules that separate natural prose from lists, tables, code and junk.

Two narrow passes, no shuffle of texts (``p5_found`` reads the texts once and keeps the numbers of the word classes for the second):

1. Word order of the corpus. For every text of a known language the pairs of neighbouring word classes (function words one
   by one, other words by shape) are counted over all documents; the table has at most languages * CLASSES^2 rows by construction, whatever the corpus.
2. Statistics of each document, among them repetition (duplicate lines and paragraphs, coverage of the commonest n-gram) and
   ``order``: the mean log ratio of its class pairs against chance in that table, near 0 or below for words without sense.

Each line is judged by its own kind of evidence (code, log, link, reference, field, table cell, menu entry, list fragment or running text), wrapped lines
together with their block; a document is not prose when running text makes up less than half of it, when repetition covers most
of it, or when its words come in no order. NULL, empty and blank bodies have zero statistics and kind ``empty``, and are never found.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm import textkit as tk
from grainmill.llm.common import cut, read

# Thresholds of the combined rules.
MIN_PROSE_SHARE = 0.5
MIN_FUNCTION_SHARE = 0.17
MIN_DOCUMENT_FUNCTION_SHARE = 0.04  #: of all words, before sentences with few function words count as text
MIN_WORDS = 5  #: shorter lines and sentences are fragments
MAX_REPEATED = 0.8
MAX_TOP_NGRAM = 0.45
MIN_ORDER = -0.32
MIN_ORDER_PAIRS = 16

FIELDS = (
    ("chars", "bigint"), ("words", "bigint"), ("lines", "bigint"), ("sentences", "bigint"), ("mean_word_length", "double"), ("symbol_ratio", "double"),
    ("digit_ratio", "double"), ("punctuated_line_share", "double"), ("common_word_share", "double"), ("duplicate_line_share", "double"),
    ("duplicate_paragraph_share", "double"), ("top_ngram_share", "double"), ("repeated_share", "double"), ("bullet_line_share", "double"),
    ("prose_share", "double"), ("order", "double"), ("order_pairs", "bigint"), ("lang", "string"), ("kind", "string"), ("is_prose", "boolean"),
)

_BULLET = re.compile(r"^(?:[-*•·–—▪‣>+#]|\[[ xX]?\]|\(?\d{1,3}[.)]|\[\d+\]|[a-z][.)])\s+")
_URL = re.compile(r"(?:https?://|www\.)\S+|\b[\w.+-]+@[\w-]+\.\w+")
_LOG = re.compile(r"^\W?(?:\d{4}[-/.]\d\d[-/.]\d\d|\d\d[:.]\d\d[:.]\d\d|\w{3}\s+\d+ \d\d:\d\d)\S*[ T].*\b(?:DEBUG|INFO|WARN\w*|ERROR|FATAL|TRACE)\b|^(?:\d+\.){3}\d+ - ")
_FIELD = re.compile(r"^[^\W\d_][\w /()-]{0,24}(?:\s*[:=]\s*|\s+-\s+|\s*\.{3,}\s*)\S.{0,40}$")
_REFERENCE = re.compile(r"\bpp?\.\s*\d+|\bvol\.\s*\d+|\bdoi\b|\bet al\.|\bISBN\b|\b(?:Press|Verlag|Journal|Proc\.)[^.]{0,40}\b(?:1[5-9]|20)\d\d\b", re.I)
_CODE = re.compile(
    r"[{};]\s*$|^\s*(?:def|class|import|from|export|return|for|while|if|else|elif|try|func|fn|var|let|const|static|public|private|void|int|struct|package|using|echo|printf)\b.*[(){}=;:.\[\]<_]"
    r"|^\s*#\s*(?:define|include|ifdef|endif|!)|</?\w+[^<>]*>|&&|\|\||==|!=|=>|->|::|\w\(\)|^\s*\./|--\w+[= ]|^\s*(?:SELECT|INSERT|UPDATE|DELETE|WHERE|GROUP BY|ORDER BY|CREATE TABLE|FROM)\b.*[\w_=;*(]|^\w+(?:_\w+)*\s*[:=]\s*[\[{\d\"'\w]|^\s*throw\b|^```|^\s*[}\])]"
)
_STRONG = re.compile(r"[{}\[\]<>=;_#$\\|&^~*+@%`]")
_SYMBOL = re.compile(r"[{}\[\]<>=;_#$\\|&^~*+@%`]|[^\w\s.,;:!?'\"’“”‘()\-–—«»¿¡…/\u0300-\u036f\u0900-\u0dff]")
_ALNUM = re.compile(r"\w+")
_VOWEL = re.compile(r"[aeiouy]")
_SEPARATOR = re.compile(r"\s[|·•>»]\s|[#@+]\w+\s+[#@+]\w+")
_ENTRY = re.compile(r"\d|\t| {2,}|[|;]")
_COMMENT = re.compile(r"#|//|--|/?\*|;|%")
_WIDE_GAP = re.compile(r"\S(?: {3,}\S+){2,}")
_HIGH = re.compile("[\x81-\u024f]")
_BEYOND = re.compile("[\u0300-\U0010ffff]")
# What may close a line behind its last mark, and the marks.
_CLOSERS, _MARKS = "\"'”’)]»", ".!?…。！？।:;"


def _ascii(keep) -> bytes:
    """The ASCII characters that aren't ``keep``, to be deleted before counting."""
    return bytes(i for i in range(128) if not keep(chr(i)))


_NO_LETTERS, _NO_DIGITS, _NO_STRONG, _NO_SYMBOLS = (_ascii(f) for f in (str.isalpha, str.isdigit, _STRONG.match, _SYMBOL.match))


def _count(s: str, others: bytes) -> int:
    """Characters of an ASCII text that aren't ``others``."""
    return len(s.encode("ascii").translate(None, others))


def letter_count(s: str) -> int:
    return _count(s, _NO_LETTERS) if s.isascii() else sum(map(str.isalpha, s))


def ends(s: str) -> bool:
    """Whether a line ends with a mark, perhaps behind closing quotes and brackets."""
    return s.rstrip(_CLOSERS)[-1:] in _MARKS if s.rstrip(_CLOSERS) else False


def symbol_share(s: str) -> float:
    """Share of characters that aren't letters, digits, blanks or plain punctuation."""
    return (_count(s, _NO_SYMBOLS) if s.isascii() else len(_SYMBOL.findall(s))) / len(s) if s else 0.0


def line_kind(line: str, lang: str | None) -> str:
    """What one line is, by itself: code, log, link, reference, field, cells, fragment, junk, foreign, text."""
    s = line.strip()
    bullet = _BULLET.match(s)
    bare = s[bullet.end() :] if bullet else s
    toks = tk.words(bare)
    share = tk.function_share(toks, lang)
    if ("http" in s or "www." in s or "@" in s) and sum(map(len, _URL.findall(s))) * 2 > len(s):
        return "link"
    if _LOG.match(s):
        return "log"
    if share < 0.25 and (s.count("|") > 1 or s.count("\t") > 2 or "   " in s and _WIDE_GAP.search(s)):
        return "cells"
    letters = letter_count(s)
    if not s.isascii() and max(s) > "\u02ff" and sum(map(str.isalpha, _BEYOND.findall(s))) * 2 > letters > 0:
        return "foreign"
    strong = _count(s, _NO_STRONG) if s.isascii() else len(_STRONG.findall(s))
    sentence = len(toks) >= MIN_WORDS and ends(s)
    if (share < 0.2 or strong * 12 > len(s)) and (strong or share < 0.2 and not sentence) and _CODE.search(line):
        return "code"
    if strong * 8 > len(s):
        return "code" if letters * 3 > len(s) else "junk"
    if letters * 2 < len(s) or garbled(s, toks):
        return "junk"
    if share < 0.3 and _REFERENCE.search(s):
        return "reference"
    if len(toks) < 8 and share < 0.2 and not sentence and _FIELD.match(s):
        return "field"
    if share < 0.12 and symbol_share(s) > 0.06:
        return "junk"
    if len(toks) < MIN_WORDS:
        # a heading, a short sentence or a menu entry; entries that are marked, numbered or spaced out belong to lists and tables
        return "fragment" if (share > 0.3 and ends(s)) or not (bullet or _ENTRY.search(s)) else "items"
    if share >= MIN_FUNCTION_SHARE:
        return "text"
    return "bare" if reads(bare, toks) else "items"


_vowelless = tk.Memo(lambda w: not _VOWEL.search(w))


def garbled(s: str, toks: list[str]) -> bool:
    """Words without vowels, with marks inside, or of accented letters throughout: text that lost or swapped characters."""
    longest = max(map(len, s.split()), default=0)
    if longest > 45 and longest * 2 > len(s):
        return True
    long = [w for w in toks if len(w) > 2]
    if len(long) > 3 and sum(map(_vowelless.__getitem__, long)) * 4 > len(long):
        return True
    if not s.isascii():
        high = len(_HIGH.findall(s))
        plain = len(s.encode("ascii", "ignore").translate(None, _NO_LETTERS))
        if high * 3 > plain and high * 3 > plain + sum(map(str.isalpha, re.findall("[\x80-\u024f]", s))) > 8:
            return True
    return longest > 60 and max(map(len, toks), default=0) > 60


def reads(s: str, toks: list[str]) -> bool:
    """Few function words, but a sentence by its shape: not capitalised throughout, few commas, numbers and separators."""
    if s.count(",") * 3 > len(toks):
        return False
    first = [w[0] for w in s.split()]
    title = 0 if s.isupper() else sum(map(str.isupper, first[1:]))
    return title * 2 <= len(first) and sum(map(str.isdigit, first)) * 4 <= len(first) and not _SEPARATOR.search(s)


def line_kinds(text: str, lang: str | None) -> list[tuple[str, str]]:
    """(line, kind) of all lines that aren't blank. Lines that wrap running text count as text with their block."""
    out: list[tuple[str, str]] = []
    for block in tk.blocks(text):
        if sum(x.startswith("o ") for x in block) * 2 > len(block):
            block = ["•" + x[1:] if x.startswith("o ") else x for x in block]  # the letter that word processors give as a bullet, where most lines have it
        kinds = [line_kind(x, lang) for x in block]
        if "code" in kinds and kinds.count("code") * 2 >= sum(not _COMMENT.match(x) for x in block):
            kinds = ["code" if _COMMENT.match(x) else k for x, k in zip(block, kinds)]  # remarks between lines of code
        if len(block) > 1 and kinds.count("text") < len(block):
            # wrapped or broken text: few lines end a sentence or start anew, and the joined block reads as text
            loose = [k in ("text", "bare", "foreign") or k in ("items", "fragment") and not _BULLET.match(x) for x, k in zip(block, kinds)]
            joined = " ".join(x for x, ok in zip(block, loose) if ok)
            toks = tk.words(joined)
            if sum(loose) * 2 > len(block) and toks:
                lower = sum(x[:1].islower() or not ends(y) for y, x in zip(block, block[1:]))
                parts = len(tk.sentences(joined))
                long = len(toks) >= 4.5 * sum(loose) or parts > 1 and len(toks) >= 4.5 * parts and len(joined) >= 20 * sum(loose)
                long = long and reads(joined, toks)
                if long and lower * 3 >= len(block) - 1 and not garbled(joined, toks):
                    flows = "text" if tk.function_share(toks, lang) >= MIN_FUNCTION_SHARE else "bare"
                    kinds = [flows if ok and k != "foreign" else k for k, ok in zip(kinds, loose)]
        out += zip(block, kinds)
    return out


def ngram_coverage(toks: list[str], n: int) -> float:
    """Share of the words' characters that lie in occurrences of the commonest n-gram, if it occurs more than once."""
    if len(toks) < n:
        return 0.0
    grams = Counter(zip(*(toks[i:] for i in range(n))))
    count = max(grams.values())
    if count == 1:
        return 0.0
    size = max(sum(map(len, g)) for g, c in grams.items() if c == count)
    return min(1.0, count * size / max(1, sum(map(len, toks))))


def repeated_share(toks: list[str], n: int = 4) -> float:
    """Share of n-grams that occurred before in the text."""
    if len(toks) < 3 * n:
        return 0.0
    grams = list(zip(*(toks[i:] for i in range(n))))
    return 1 - len(set(grams)) / len(grams)


def duplicate_share(parts: list[str]) -> float:
    """Share of characters in parts that occurred before."""
    seen: set[str] = set()
    total = again = 0
    for p in parts:
        total += len(p)
        if p in seen:
            again += len(p)
        seen.add(p)
    return again / total if total else 0.0


def order_score(text: str, lang: str | None, table: np.ndarray | None) -> tuple[float | None, int]:
    """Mean log ratio of the text's class pairs against chance, and their number."""
    if lang is None or table is None:
        return None, 0
    pairs = tk.class_pairs(text, lang)
    if not len(pairs):
        return None, 0
    return float(table[tk.LANGUAGES.index(lang)].ravel()[pairs].mean()), len(pairs)


def ratios(counts: dict[int, int]) -> np.ndarray:
    """log P(c1, c2) / (P(c1) P(c2)) per language from pair counts, smoothed by one expected pair."""
    k = tk.CLASSES
    n = np.zeros((len(tk.LANGUAGES), k, k))
    for key, c in counts.items():
        n.ravel()[key] += c
    total = np.maximum(n.sum((1, 2), keepdims=True), 1)
    expected = n.sum(2, keepdims=True) * n.sum(1, keepdims=True) / total
    return np.clip(np.log((n + 0.5) / (expected + 0.5)), -3, 3)


def prose_kind(stats: dict) -> str:
    """The combined rules, strongest evidence first."""
    if not stats["words"] and not stats["chars"]:
        return "empty"
    if max(stats["repeated_share"] - MAX_REPEATED, stats["top_ngram_share"] - MAX_TOP_NGRAM) > 0 and stats["words"] > 8:
        return "repetition"
    if stats["prose_share"] < MIN_PROSE_SHARE:
        return "not running text"
    if stats["order"] is not None and stats["order_pairs"] >= MIN_ORDER_PAIRS and stats["order"] < MIN_ORDER:
        return "words without sense"
    return "prose"


def repetition(toks: list[str], exact: bool = True) -> tuple[float, float]:
    """Coverage of the commonest 2- or 3-gram, and the share of 4-grams seen before. Not ``exact``: 0 where a bound shows that no limit is passed."""
    if not exact and toks:
        single = Counter(toks)
        total = sum(map(len, toks))
        # an n-gram covers at most n times what the commonest of its words covers; n-grams are at least as many as words
        few = 3 * max(map(mul, single.values(), map(len, single))) <= MAX_TOP_NGRAM * total
        if few and len(single) - 3 > (1 - MAX_REPEATED) * len(toks):
            return 0.0, 0.0
    return max(ngram_coverage(toks, 2), ngram_coverage(toks, 3)), repeated_share(toks)


def judge(text: str, table: np.ndarray | None, exact: bool = False) -> tuple[dict, list[tuple[str, str]], list[str]]:
    """What the rules need of a cleaned text that isn't blank, with the verdict; its lines and words."""
    toks = tk.words(text)
    lang = tk.language(toks)
    lines = line_kinds(text, lang)
    mass = Counter()
    for x, k in lines:
        mass[k] += len(x)
    # the same foreign line again and again is no text; fragments belong to the text around them, if that is the longer part
    foreign = mass["foreign"] if len({x for x, k in lines if k == "foreign"}) * 2 > sum(k == "foreign" for _, k in lines) else 0
    common = tk.function_share(toks, lang)
    running = mass["text"] + (mass["bare"] if common >= MIN_DOCUMENT_FUNCTION_SHARE else 0) + foreign
    if running >= mass["fragment"]:
        running += mass["fragment"]
    top, repeated = repetition(_ALNUM.findall(text.lower()) if text.isascii() else [*map(str.lower, _ALNUM.findall(text))], exact)
    order, pairs = order_score(text, lang, table)
    s = {"chars": len(text), "words": len(toks), "common_word_share": common, "top_ngram_share": top, "repeated_share": repeated, "prose_share": running / sum(mass.values()), "order": order, "order_pairs": pairs, "lang": lang}
    s["kind"] = prose_kind(s)
    return s | {"is_prose": s["kind"] == "prose"}, lines, toks


def kind_of(body: str | None, table: np.ndarray | None) -> tuple[str, str | None]:
    """Kind and language of one body, without the statistics that the rules don't need."""
    return kind_of_clean(tk.clean(body or ""), table)


def kind_of_clean(text: str, table: np.ndarray | None) -> tuple[str, str | None]:
    if not text.strip():
        return "empty", None
    s, _, _ = judge(text, table)
    return s["kind"], s["lang"]


def statistics(body: str | None, table: np.ndarray | None) -> dict:
    """All FIELDS of one body."""
    text = tk.clean(body or "")
    if not text.strip():
        return {k: (0 if t == "bigint" else 0.0) for k, t in FIELDS} | {"order": None, "lang": None, "kind": "empty", "is_prose": False}
    s, lines, toks = judge(text, table, True)
    digits = _count(text, _NO_DIGITS) if text.isascii() else sum(map(str.isdigit, text))
    more = {
        "chars": len(body), "lines": len(lines), "sentences": len(tk.sentences(text)), "mean_word_length": sum(map(len, toks)) / max(1, len(toks)),
        "symbol_ratio": symbol_share(text), "digit_ratio": digits / len(text), "punctuated_line_share": sum(ends(x) for x, _ in lines) / len(lines),
        "duplicate_line_share": duplicate_share([x for x, _ in lines]), "duplicate_paragraph_share": duplicate_share([" ".join(b) for b in tk.blocks(text)]),
        "bullet_line_share": sum(bool(_BULLET.match(x)) for x, _ in lines) / len(lines),
    }
    return s | more


def pair_counts(df: DataFrame, text: str) -> dict[int, int]:
    """Counts of class pairs per language over all texts: at most len(LANGUAGES) * CLASSES^2 numbers, summed on the executors."""
    k2 = tk.CLASSES**2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(tk.LANGUAGES) * k2, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    t = tk.clean(t)
                    lang = tk.language(tk.words(t))
                    if lang:
                        np.add.at(n, tk.class_pairs(t, lang) + tk.LANGUAGES.index(lang) * k2, 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["pair", "n"])

    rows = df.select(text).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return {r.pair: r.n for r in rows}


def body_of(corpus: Column, content: Column, text: Column) -> Column:
    return F.when(corpus == "A18", text).otherwise(content)


def text_statistics(df: DataFrame, text: str, table: np.ndarray) -> DataFrame:
    """``df`` without ``text``, with FIELDS added (their names must not occur in ``df``)."""
    kept = [c for c in df.columns if c != text]
    if clash := {c.lower() for c in kept} & {k for k, _ in FIELDS}:
        raise ValueError(f"columns clash: {sorted(clash)}")
    shared = df.sparkSession.sparkContext.broadcast(table)
    types = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t, shared.value) for t in b.column(len(kept)).to_pylist()]
            cols = [pa.array([r[k] for r in rows], types[t]) for k, t in FIELDS]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), *cols], [*kept, *(k for k, _ in FIELDS)])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), *(f"`{k}` {t}" for k, t in FIELDS)])
    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(text)).mapInArrow(run, schema)


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = read(spark, sf_dir, "quality_reconstruction", "record_key", "corpus", "content", "text")
    return q.select("record_key", "corpus", body_of(F.col("corpus"), F.col("content"), F.col("text")).alias("body"))


def p5_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bodies(spark, sf_dir)
    out = text_statistics(df, "body", ratios(pair_counts(df, "body")))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def evidence(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, the kind by all rules but that of word order, and the numbers of the class pairs, of every row: the one pass over whole texts, written."""
    k2 = tk.CLASSES**2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, pairs = [], []
            for t in b.column(1).to_pylist():
                t = tk.clean(t or "")
                kind, lang = kind_of_clean(t, None)
                kinds.append(kind)
                pairs.append(tk.class_pairs(t, lang) + tk.LANGUAGES.index(lang) * k2 if lang else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kinds, pa.string()), pa.array(pairs, pa.list_(pa.int32()))], ["k", "kind", "pairs"])

    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {df.schema[key].dataType.simpleString()}, kind string, pairs array<int>")
    return cut(out.withColumnRenamed("k", key))


def kinds(seen: DataFrame, key: str) -> DataFrame:
    """``key`` and kind of every row of ``evidence``, with the word order of the whole corpus."""
    size = len(tk.LANGUAGES) * tk.CLASSES**2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in batches:
            n += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["pair", "n"])

    rows = seen.select("pairs").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # at most ``size``
    shared = seen.sparkSession.sparkContext.broadcast(ratios({r.pair: r.n for r in rows}).ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.bincount(np.repeat(np.arange(len(n)), n), shared.value[lists.flatten().to_numpy(zero_copy_only=False)], len(n))
            odd = (n >= MIN_ORDER_PAIRS) & (total < MIN_ORDER * n)
            kind = ["words without sense" if k == "prose" and o else k for k, o in zip(b.column(1).to_pylist(), odd)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kind, pa.string())], ["k", "kind"])

    schema = f"k {seen.schema[key].dataType.simpleString()}, kind string"
    return seen.select(F.col(key).alias("k"), "kind", "pairs").mapInArrow(run, schema).withColumnRenamed("k", key)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinds(evidence(bodies(spark, sf_dir), "record_key", "body"), "record_key").where("kind NOT IN ('prose', 'empty')").select("record_key")


ORACLE: dict[str, str] = {}
QUERIES = {"p5_found": p5_found, "p5_statistics": p5_statistics}
