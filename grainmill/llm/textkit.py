"""Row-local text kernels shared by the text operators: words, sentences, blocks, languages and word classes.

Everything here works on one whole text and is called from Arrow passes; nothing keeps state between rows.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

# The closed-class words by which a language and running text show. Without accents, lower case.
FUNCTION_WORDS = {
    "en": """the a an and or but nor so yet if of to in on at by for with from into over under about after before between through during
        without within against among upon as than that this these those there here it its he she his her him they them their we our us you
        your i my me who whom whose which what when where why how is are was were be been being am do does did has have had having can could
        will would shall should may might must not no only also very more most less many much such some any all each every both few other own
        same then too just now still while because although though since until whether up down out off again once never always even another""",
    "de": """der die das den dem des ein eine einen einem einer eines und oder aber denn weil dass wenn als ob wie von zu zum zur in im ins an am
        auf aus bei mit nach vor uber unter fur gegen ohne durch um bis seit ist sind war waren wird werden wurde hat haben hatte kann muss
        soll nicht kein keine auch nur noch schon sehr mehr so es er sie wir ihr ich du sich man sein seine ihre unsere dieser diese dieses
        jeder jede was wer wo warum dann doch hier dort etwa trotzdem wieder lieber einmal fruher spater""",
    "fr": """le la les un une des du de et ou mais donc car ni que qui quoi dont ou si comme quand dans en sur sous par pour avec sans
        entre vers chez est sont etait etaient sera ete etre a ont avait avoir ne pas plus moins tres aussi encore deja jamais toujours ce
        cet cette ces il elle on nous vous ils elles je tu se son sa ses leur leurs notre votre mon ma mes au aux pourquoi
        depuis selon faut afin meme tout tous toute""",
    "es": """el la los las un una unos unas y pero ni que quien cual cuyo si como cuando donde en de del al a por para con sin sobre entre
        hasta desde hacia segun es son era eran fue fueron sera ser esta estan estaba hay ha han habia no mas menos muy tambien aun ya nunca
        siempre este esta estos ese esa esos lo le les se su sus mi tu nos me te yo ella ellos nosotros nadie todo toda todos porque hace
        aunque otra otro tiene necesita""",
}
LANGUAGES = tuple(FUNCTION_WORDS)
_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_ANY = frozenset().union(*_SETS.values())

#: Classes of words for the word order statistic: every function word of the language is its own class, other words go by shape.
_SHAPES = ("ing", "ed", "ly", "s", "tion", "number", "short", "long")
CLASSES = max(len(s) for s in _SETS.values()) + len(_SHAPES) + 1  # the last one is the border of a sentence

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)*|[.!?…。！？।]+")
_ASCII_WORD = re.compile(r"[a-z]+(?:'[a-z]+)*")
_BREAK = re.compile(r"[.!?…][\"'”’)\]]*\s+|[。！？।]")
_SOFT = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
_BROKEN = re.compile(r"([^\W\d_])[-\u2010]\n\s*([a-z\u00df-\u00ff])")


def plain_word(word: str) -> str:
    """Lower case without accents and compatibility forms."""
    w = word.lower()
    if w.isascii() or len(w) == 1 and w not in "àáèéìíòóùú":
        return w
    return "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)).replace("’", "'").replace("ß", "ss")


def clean(text: str) -> str:
    """Line ends as \\n, invisible characters and soft hyphens gone, words that were broken at a line's end joined."""
    t = text
    if not t.isascii():
        t = _SOFT.sub("", t).replace("\u2028", "\n").replace("\u2029", "\n\n").replace("\x85", "\n")
    t = t.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", " ")
    return _BROKEN.sub(r"\1\2", t) if "-\n" in t or "\u2010\n" in t else t


def words(text: str) -> list[str]:
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return [*map(_plain.__getitem__, _WORD.findall(text))]


def sentences(text: str) -> list[str]:
    """Cut behind marks that blanks follow; quotes and brackets that close there go with the blanks."""
    out, at = [], 0
    for m in _BREAK.finditer(text):
        out.append(text[at : m.start() + 1])
        at = m.end()
    out.append(text[at:])
    return [s for s in map(str.strip, out) if s]


class Memo(dict):
    """A bounded memory of a function of words, for ``map``."""

    def __init__(self, function, most: int = 200_000):
        self.function, self.most = function, most

    def __missing__(self, word: str):
        if len(self) >= self.most:
            self.clear()
        self[word] = value = self.function(word)
        return value


def language(tokens: list[str]) -> str | None:
    """The language with most function words, at least one word in twelve; None if there is none."""
    hits = {k: sum(map(s.__contains__, tokens)) for k, s in _SETS.items()}
    best = max(hits, key=hits.get)
    return best if hits[best] * 12 >= len(tokens) > 0 else None


def function_share(tokens: list[str], lang: str | None) -> float:
    s = _SETS.get(lang, _ANY)
    return sum(map(s.__contains__, tokens)) / len(tokens) if tokens else 0.0


_plain = Memo(plain_word)


@lru_cache(maxsize=len(LANGUAGES))
def _classes(lang: str) -> Memo:
    """Token to class."""
    known = {w: i for i, w in enumerate(sorted(_SETS[lang]))}

    def of(token: str) -> int:
        if token[0] in ".!?…。！？।":
            return CLASSES - 1
        w = plain_word(token)
        return known[w] if w in known else CLASSES - 2 - _shape(w)

    return Memo(of)


def class_pairs(text: str, lang: str) -> np.ndarray:
    """Numbers c1 * CLASSES + c2 of neighbouring word classes, sentence borders included."""
    border = CLASSES - 1
    c = np.array([border, *map(_classes(lang).__getitem__, _TOKEN.findall(text)), border], np.int64)
    return (c[:-1] * CLASSES + c[1:])[(c[:-1] != border) | (c[1:] != border)]


def _shape(w: str) -> int:
    if w[0].isdigit():
        return 5
    for i, end in ((0, "ing"), (1, "ed"), (2, "ly"), (4, "tion")):
        if w.endswith(end) and len(w) > len(end) + 2:
            return i
    if w.endswith("s") and len(w) > 3:
        return 3
    return 6 if len(w) < 6 else 7


def blocks(text: str) -> list[list[str]]:
    """Runs of non-blank lines, stripped."""
    out: list[list[str]] = [[]]
    for line in text.split("\n"):
        s = line.strip()
        if s:
            out[-1].append(s)
        elif out[-1]:
            out.append([])
    return [b for b in out if b]
