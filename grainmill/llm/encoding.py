"""Problem 7: the whole corpus as token ids of a public byte-level BPE, by monoid tree reduction.

A text is cut in halves down to leaves. Each leaf is encoded alone; two neighbours join into one node by re-encoding a
window around their border, which grows until the tokens outside it provably hold. The proof rests on the splitting
pattern: it scans left to right without looking back, so the pieces from an offset on depend only on the text from there.

* Left of the border a piece stays as it is if its match neither touched the end of the left part nor came within the
  longest literal alternative of it (``_REACH`` characters).
* Scanning on from the last such piece, as soon as one piece ends where a piece of the right part ends, both scans stand
  at the same offset and agree from there on; only the pieces between are encoded anew.

Merges never cross a piece, so pieces fix tokens, and joining is associative: any tree gives the ids of one pass.
Decoding concatenates the bytes of the parts up the same tree.

NULL and empty texts have the empty list. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.common import read

#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF = 1024  #: characters of a leaf; texts up to this length are one leaf, longer ones are joined from several
WINDOW = 64  #: characters of the first window; it doubles until the join is proven
_REACH = 3  #: longest literal alternative of the pattern


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN)
        self.bytes_of = {i: b for b, i in ranks.items()}

    def encode(self, text: str | None, leaf: int = LEAF, window: int = WINDOW) -> list[int]:
        if not text:
            return []
        if len(text) <= leaf:
            return self.bpe.encode_ordinary(text)
        return self.tree(text, 0, len(text), leaf, window).flat()

    def tree(self, text: str, start: int, end: int, leaf: int, window: int) -> Node:
        if end - start <= leaf:
            ends = np.fromiter((m.end() for m in self.split.finditer(text[start:end])), np.int64) + start
            return Node(start, end, ends, [self.bpe.encode_ordinary(text[start:end])])
        middle = (start + end) // 2
        return self.join(text, self.tree(text, start, middle, leaf, window), self.tree(text, middle, end, leaf, window), window)

    def join(self, text: str, left: Node, right: Node, window: int) -> Node:
        """The node of both parts. Keeps all left pieces before the window and all right pieces after it."""
        m, end = left.end, right.end
        # a piece [s, e) of the left part is safe if it ended, and every literal was decided, before the border
        starts = np.concatenate(([left.start], left.ends[:-1]))
        safe = int(np.searchsorted(~((left.ends < m) & (starts + _REACH <= m)), True))
        p = int(left.ends[safe - 1]) if safe else left.start
        rights, size = right.ends, window
        while True:
            stop = min(end, m + size)
            fresh, at = [], p
            for piece in self.split.finditer(text[p:stop]):
                s, e = p + piece.start(), p + piece.end()
                if stop < end and not (e < stop and s + _REACH <= stop):
                    break  # the window's end may have decided this piece
                fresh.append(e)
                at = e
                if e >= m:
                    k = int(np.searchsorted(rights, e))
                    if e == m or (k < len(rights) and rights[k] == e):
                        keep = 0 if e == m else k + 1
                        return self._joined(text, left, right, safe, p, fresh, at, keep)
            if stop == end:
                return self._joined(text, left, right, safe, p, fresh, at, len(rights))
            size *= 2

    def _joined(self, text: str, left: Node, right: Node, safe: int, p: int, fresh: list[int], at: int, keep: int) -> Node:
        starts = [p, *fresh[:-1]]  # piece by piece: a run of blanks would split otherwise if it stood at the end
        window = [i for s, e in zip(starts, fresh) for i in self.bpe.encode_ordinary(text[s:e])]
        ids = [*left.head(self, p - left.start, text), window, *right.tail(self, at - right.start, text)]
        return Node(left.start, right.end, np.concatenate((left.ends[:safe], np.array(fresh, np.int64), right.ends[keep:])), ids)

    def decode(self, ids: list[int] | None) -> str:
        """The text of ids: bytes of the halves, concatenated up the tree."""
        return self._bytes(ids if ids is not None else [], 0, 0 if ids is None else len(ids)).decode("utf-8", "replace")

    def _bytes(self, ids: list[int], start: int, end: int) -> bytes:
        if end - start <= LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids[start:end]))
        middle = (start + end) // 2
        return self._bytes(ids, start, middle) + self._bytes(ids, middle, end)


@dataclass
class Node:
    """Text [start, end): the offsets where its pieces end, and its ids in parts that concatenate."""

    start: int
    end: int
    ends: np.ndarray
    parts: list[list[int]] = field(default_factory=list)

    def flat(self) -> list[int]:
        return [i for part in self.parts for i in part]

    def head(self, codec: Codec, chars: int, text: str) -> list[list[int]]:
        """Ids of the first ``chars`` characters, which end at a piece."""
        return _cut(codec, self.parts, len(text[self.start : self.start + chars].encode()), True)

    def tail(self, codec: Codec, chars: int, text: str) -> list[list[int]]:
        """Ids after the first ``chars`` characters, which end at a piece."""
        return _cut(codec, self.parts, len(text[self.start + chars : self.end].encode()), False)


def _cut(codec: Codec, parts: list[list[int]], size: int, front: bool) -> list[list[int]]:
    """The parts that cover the first (or last) ``size`` bytes. Walks in from the far edge, where the cut is close."""
    if not size:
        return []
    total = sum(len(codec.bytes_of[i]) for part in parts for i in part)
    drop, out = total - size, [*parts]
    while drop:
        part = out[-1] if front else out[0]
        n = 0
        while drop and n < len(part):
            drop -= len(codec.bytes_of[part[-1 - n] if front else part[n]])
            n += 1
        rest = part[: len(part) - n] if front else part[n:]
        if rest:
            out[-1 if front else 0] = rest
        else:
            out.pop(-1 if front else 0)
    return out


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec per worker process and file; where the node lacks the file, the copy that the driver sent."""
    return Codec(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))


_sent: set[tuple[str, str]] = set()


def send(spark: SparkSession, path: str) -> None:
    """Makes the driver's rank file (a few MB) available to all executors, once per application."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _sent:
        spark.sparkContext.addFile(path)
        _sent.add(key)


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key`` and ``ids``: a narrow Arrow pass, no shuffle; other columns of ``df`` are never read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in batches:
            ids = pa.array([c.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["k", "ids"])

    send(df.sparkSession, vocabulary)
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def count_tokens(df: DataFrame, text: str, out: str = "n_tokens", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """All columns of ``df`` but ``text``, and the number of its tokens (0 for NULL and empty texts). No shuffle."""
    kept = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in batches:
            n = pa.array([len(c.encode(t)) for t in b.column(len(kept)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), n], [*kept, out])

    send(df.sparkSession, vocabulary)
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), f"{out} bigint"])
    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(text)).mapInArrow(run, schema)


def decode_column(df: DataFrame, key: str, ids: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key`` and the decoded ``text``; a NULL list decodes to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["k", "text"])

    send(df.sparkSession, vocabulary)
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p7_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its tokens, and whether decoding them gives the text back (NULL as the empty text)."""
    documents = read(spark, sf_dir, "documents", "doc_id", "text")
    schema = "doc_id bigint, n_tokens bigint, same boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(DEFAULT_VOCABULARY)
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = [c.encode(t) for t in texts]
            same = [c.decode(i) == (t or "") for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, ids), pa.int64()), pa.array(same)], ["doc_id", "n_tokens", "same"])

    send(spark, DEFAULT_VOCABULARY)
    return documents.mapInArrow(run, schema)


ORACLE: dict[str, str] = {}
QUERIES = {"p7_ids": p7_ids, "p7_roundtrip": p7_roundtrip}
