"""Problem 1: how demanding the prose of each document is, as a grade level and a reading band.

Level: six classic formulas (Flesch-Kincaid, fog, SMOG, automated readability, Coleman-Liau, Linsear) from sentence length and syllables, the
syllables by hyphenation-style rules; the level is the median of the six, over the sentences as they are punctuated. A block without any
sentence mark has no sentences to measure; its words count as sentences of ``UNMARKED`` words each.

Band: the formulas alone can't tell the bands here, because neither sentence length nor long words decide what a text demands of
its reader (short-worded mathematics, children's texts that explain one long word); the README has the figures. So the grades of each sentence
and document enter, as features beside its words, word parts and word pairs, a naive Bayes classifier of sentences over the four bands. It is fitted
on the rated records, a sample bounded by ``MAX_RATED`` records, by a few rounds of expectation-maximisation, since the raters judged documents and
the sentences of one document may differ. The shares of words in sentences of each band then make the document's band. No word list is built in: what
a word tells comes from the ratings. Everything but the fit covers all rows and whole texts.

Non-prose (by the rules of ``prose``), texts not in English and texts of fewer than three sentences get a level, but no band. NULL, empty and blank texts
get neither. Without any rated record, the band follows the level alone.

Speed: words are split by one pattern a sentence and numbered by a bounded memory of words; all else is array arithmetic over some hundred documents at once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm import prose
from grainmill.llm import textkit as tk
from grainmill.llm.common import read, slices

BANDS = ("elementary", "middle", "secondary", "advanced")
MAX_RATED = 6000  #: rated records that the fit uses, those of the least hash
BITS = 18  #: features are hashed to so many bits
ROUNDS = 6
OWN = 0.8  #: prior share of a document's sentences that are of its rated band
SMOOTHING = 0.3
MIN_COUNT = 2  #: rarer features are no evidence
UNMARKED = 12  #: words that count as a sentence in blocks without a sentence mark
MIN_SENTENCES = 3
GRADE_BANDS = (3.0, 7.0, 12.0)  #: level limits of the bands where there are no ratings
CHUNK, CHUNK_BYTES = 256, 2_000_000  #: documents that are assessed at once, and bytes of their texts
ESTIMATES = ("flesch_kincaid", "fog", "smog", "automated", "coleman_liau", "linsear")

_MARK = re.compile(r"[.!?…。！？।]")
_VOWELS = re.compile(r"[aeiouy]+")
_HIATUS = re.compile(r"i[aou]|[aeo]u?e[ao]|eo|ua[lrt]|ui[nt]|ya|yo|io(?!u?s)")
_CLOSED = re.compile(r"tio|sio|cia|tia|gio|cio")


def syllables(word: str) -> int:
    """Syllables of an English word: vowel groups, less silent endings, more for vowels that part."""
    w = re.sub(r"[^a-z]", "", word)
    if not w:
        return 1
    n = len(_VOWELS.findall(w))
    n += len(_HIATUS.findall(w)) - len(_CLOSED.findall(w))
    if re.search(r"[^aeiouyl]e$|[aeiouy]le$|rle$", w) or re.search(r"[^aeiouytd]ed$", w) or re.search(r"[^aeiouysxzcg]es$", w):
        n -= 1
    if w.endswith(("sm", "thm")):
        n += 1
    return max(1, n)


def estimates(words: np.ndarray, sentences: np.ndarray, syl: np.ndarray, hard: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The six grades as columns, for texts of so many words (at least one), sentences, syllables, words of three or more syllables, and letters."""
    n, k = words.astype(float), sentences.astype(float)
    linsear = (n + 2 * hard) / k
    return np.column_stack([
        0.39 * n / k + 11.8 * syl / n - 15.59, 0.4 * (n / k + 100 * hard / n), 1.043 * np.sqrt(30 * hard / k) + 3.1291,
        4.71 * letters / n + 0.5 * n / k - 21.43, 5.88 * letters / n - 29.6 * k / n - 15.8, linsear / 2 - (linsear <= 20),
    ])


def split(text: str) -> list[list[str]]:
    """Sentences as words; the lines of a block belong together. A block without a sentence mark gives runs of UNMARKED words."""
    out = []
    for block in tk.blocks(tk.clean(text)):
        joined = " ".join(block)
        if _MARK.search(joined):
            out += map(tk.words, tk.sentences(joined))
        else:
            toks = tk.words(joined)
            out += [toks[i : i + UNMARKED] for i in range(0, len(toks), UNMARKED)]
    return [s for s in out if s]


def _hash(x: str) -> int:
    return zlib.crc32(x.encode())


class Words:
    """Numbers of words with what the features and formulas need of each; cleared when it is full."""

    def __init__(self, most: int = 300_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.array = np.zeros((0, 5), np.int64)
        self.number = tk.Memo(self._add, 1 << 60)

    def _add(self, w: str) -> int:
        long = len(w) > 6
        self.rows.append((_hash(w), _hash("~" + w[-5:]) if long else -1, _hash(w[:5] + "~") if long else -1, syllables(w), len(w)))
        return len(self.rows) - 1

    def of(self, tokens: list[str]) -> np.ndarray:
        """One row per token: hashes of the word, its end and its beginning (-1 for short words), syllables, letters."""
        if len(self.rows) > self.most:
            self.clear()
        ids = np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))
        if len(self.rows) > len(self.array):
            self.array = np.concatenate([self.array, np.array(self.rows[len(self.array) :], np.int64)])
        return self.array[ids]


_words = Words()


@dataclass
class Measured:
    """Formulas and features of some documents. Documents without words have no sentences and NaN grades."""

    sentences: np.ndarray  # of each document
    grades: np.ndarray  # documents x 6, and the median as ``level``
    level: np.ndarray
    doc: np.ndarray  # of each sentence
    size: np.ndarray  # words of each sentence
    feature: np.ndarray
    owner: np.ndarray  # sentence of each feature


def measure(texts: list[str | None]) -> Measured:
    docs = [split(t or "") for t in texts]
    sents = [s for d in docs for s in d]
    count = np.array([len(d) for d in docs], np.int64)
    size = np.array([len(s) for s in sents], np.int64)
    doc = np.repeat(np.arange(len(docs)), count)
    w = _words.of([*chain.from_iterable(sents)])
    of = np.repeat(np.arange(len(sents)), size)  # the sentence of each word
    sums = np.column_stack([np.bincount(of, x, len(sents)) for x in (w[:, 3], w[:, 3] > 2, w[:, 4])]) if len(sents) else np.zeros((0, 3))
    grades = np.full((len(docs), len(ESTIMATES)), np.nan)
    if full := np.flatnonzero(count).tolist():
        per = np.column_stack([np.bincount(doc, x, len(docs)) for x in (size, *sums.T)])[full]
        grades[full] = estimates(per[:, 0], count[full], *per[:, 1:].T)
    level = np.median(grades, 1)
    mask = (1 << BITS) - 1
    own = np.median(estimates(size, np.ones(len(sents)), *sums.T), 1) if len(sents) else np.zeros(0)
    graded = [np.array([_hash(f"{kind}{int(x)}") for x in v], np.int64) for kind, v in (("g", own // 3), ("d", level[doc] // 2))]
    ends, starts = w[:, 1] >= 0, w[:, 2] >= 0
    pairs = np.flatnonzero(of[1:] == of[:-1]) if len(of) else np.zeros(0, np.int64)
    pair = (w[pairs, 0] * 0x9E3779B1 + w[pairs + 1, 0] * 0x85EBCA6B >> 7) if len(pairs) else np.zeros(0, np.int64)
    every = np.arange(len(sents))
    feature = np.concatenate([w[:, 0], w[ends, 1], w[starts, 2], pair, *graded]) & mask
    return Measured(count, grades, level, doc, size, feature, np.concatenate([of, of[ends], of[starts], of[pairs], every, every]))


class BandModel:
    """Log likelihood ratios of the hashed features over the bands."""

    def __init__(self, table: np.ndarray, prior: np.ndarray):
        self.table, self.prior = table, prior

    def scores(self, m: Measured) -> np.ndarray:
        """Log likelihoods of each sentence."""
        return np.column_stack([np.bincount(m.owner, self.table[m.feature, j], len(m.size)) for j in range(len(BANDS))])

    def shares(self, m: Measured) -> np.ndarray:
        """Per document, the share of its words in sentences of each band; the document's own mix is the sentences' prior, found in a few rounds."""
        got, n = np.zeros((len(m.sentences), len(BANDS))), len(m.sentences)
        if not len(m.size):
            return got
        x, mix = self.scores(m), np.tile(self.prior, (n, 1))
        total = np.maximum(np.bincount(m.doc, m.size, n), 1)
        for _ in range(3):
            p = normalised(x + np.log(mix)[m.doc]) * m.size[:, None]
            got = np.column_stack([np.bincount(m.doc, p[:, j], n) for j in range(len(BANDS))]) / total[:, None]
            mix = 0.85 * got + 0.15 * self.prior
        return got


def normalised(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(rated: list[tuple[str, dict[str, float]]]) -> BandModel | None:
    """From (text, weight by band) of rated records. None if there are none."""
    m = measure([t for t, _ in rated])
    if not len(m.size):
        return None
    w = np.array([[weights.get(b, 0.0) for b in BANDS] for _, weights in rated])
    w = w / w.sum(1, keepdims=True)
    overall = w[m.sentences > 0].sum(0) + 1
    prior = overall / overall.sum()
    # the bands in a document besides its own share the rest of its prior
    priors = np.maximum(OWN * w + (1 - OWN) * prior, 1e-3)[m.doc]
    resp = priors / priors.sum(1, keepdims=True)
    size, model = 1 << BITS, None
    for _ in range(ROUNDS):
        n = np.stack([np.bincount(m.feature, resp[m.owner, j], size) for j in range(len(BANDS))], 1)
        enough = n.sum(1) >= MIN_COUNT - 1e-6
        rate = (n + SMOOTHING * prior) / (n.sum(0) + SMOOTHING * enough.sum() * prior)
        table = np.log(rate)
        table -= table.mean(1, keepdims=True)
        table[~enough] = 0
        model = BandModel(table.astype(np.float32), prior)
        resp = normalised(model.scores(m) + np.log(priors))
    return model


def bands(m: Measured, model: BandModel | None) -> tuple[np.ndarray, np.ndarray]:
    """Band (-1 for documents of too few sentences) and share of advanced words, before it is known which documents are prose."""
    enough = m.sentences >= MIN_SENTENCES
    if model is None:
        return np.where(enough, (np.nan_to_num(m.level)[:, None] > np.array(GRADE_BANDS)).sum(1), -1), np.full(len(enough), np.nan)
    shares = model.shares(m)
    # the band that half of the words reach, so that one demanding passage doesn't lift a simple text
    return np.where(enough, (np.cumsum(shares, 1) > 0.5).argmax(1), -1), shares[:, -1]


def assess(texts: list[str | None], model: BandModel | None, order: np.ndarray | None, only: str | None = None) -> tuple[Measured, list[str | None], list[float | None]]:
    """Formulas, band and advanced share of each text. ``only``: other bands needn't be told from no band, so fewer texts are tested for prose."""
    m = measure(texts)
    band, share = bands(m, model)
    names: list[str | None] = [None] * len(texts)
    for i in np.flatnonzero(band >= 0 if only is None else band == BANDS.index(only)):
        kind, lang = prose.kind_of(texts[i], order)
        if kind == "prose" and lang in ("en", None):
            names[i] = BANDS[band[i]]
    return m, names, [float(s) if n and s == s else None for n, s in zip(names, share)]


def rated_records(records: DataFrame, labels: DataFrame, limit: int = MAX_RATED) -> list[tuple[str, dict[str, float]]]:
    """Texts with the votes of their raters; NULL and unknown bands are no votes. The ``limit`` records of the least key hash."""
    votes = labels.where(F.col("reading_band").isin(*BANDS)).groupBy("record_key", "reading_band").agg(F.count("*").alias("n"))
    votes = votes.groupBy("record_key").agg(F.map_from_entries(F.collect_list(F.struct("reading_band", "n"))).alias("votes"))  # at most a row per band
    chosen = votes.orderBy(F.xxhash64("record_key"), "record_key").limit(limit)
    rows = records.join(F.broadcast(chosen), "record_key").select("record_key", "content", "votes").where("content IS NOT NULL").collect()
    return [(r.content, r.votes) for r in sorted(rows, key=lambda r: r.record_key)]


_SCHEMA = "record_key bigint, sentences bigint, " + ", ".join(f"{c} double" for c in (*ESTIMATES, "level")) + ", band string, advanced_share double"


def reading_levels(records: DataFrame, model: BandModel | None, order: np.ndarray, only: str | None = None) -> DataFrame:
    """Assessment of every (record_key, content); one narrow Arrow pass over whole texts."""
    shared = records.sparkSession.sparkContext.broadcast((model and (model.table, model.prior), order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, table = shared.value
        model = BandModel(*fitted) if fitted else None
        for whole in batches:
            for b in slices(whole, 1, CHUNK, CHUNK_BYTES):
                m, names, share = assess(b.column(1).to_pylist(), model, table, only)
                grades = [pa.array(x, pa.float64(), from_pandas=True) for x in (*m.grades.T, m.level)]  # NaN: no words, NULL
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.sentences), *grades, pa.array(names, pa.string()), pa.array(share, pa.float64())], ["record_key", "sentences", *ESTIMATES, "level", "band", "advanced_share"])

    return records.select("record_key", "content").mapInArrow(run, _SCHEMA)


def _levels(spark: SparkSession, sf_dir: str, only: str | None = None) -> DataFrame:
    records = read(spark, sf_dir, "quality_reconstruction", "record_key", "corpus", "content").where("corpus = 'A1'")
    model = fit(rated_records(records, read(spark, sf_dir, "reading_labels")))
    order = prose.ratios(prose.pair_counts(records, "content"))
    return reading_levels(records, model, order, only)


def p1_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assessment of every A1 record, beside its educational score (NULL where that is malformed)."""
    levels = _levels(spark, sf_dir)
    edu = read(spark, sf_dir, "quality_reconstruction", "record_key", "corpus", "fineweb_edu").where("corpus = 'A1'")
    score = F.when((F.size("fineweb_edu") == 1) & ~F.isnan(F.element_at("fineweb_edu", 1)), F.element_at("fineweb_edu", 1))
    out = levels.join(edu.select("record_key", score.alias("fineweb_edu")), "record_key", "left")
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir, "advanced").where("band = 'advanced'").select("record_key")


ORACLE: dict[str, str] = {}
QUERIES = {"p1_found": p1_found, "p1_levels": p1_levels}
