"""Problem 9: template residue and failed pages, by positive-unlabelled naive Bayes on passages.

Every document is cut into passages (sentences of a line, code fences apart) with hashed features: words, word pairs, the size of the document,
and the marks in it by the way they stand: bare in prose, quoted, in code, in a formula. Patterns give signs: a placeholder, a filler, an error or
script message. Few passages with signs are trusted: positive where the sign makes up a small document or placeholders stand bare more than once;
negative where a passage with a sign asks, tells or explains, quotes the sign or is code. All others are unlabelled. Those in documents
of more than ``SMALL`` words without a single sign are negative at the start: in the first round alone, from the second on their posteriors count.
Expectation-maximisation fits the two classes over all passages of the corpus, other unlabelled ones at a lower weight. Signs are no features of the classes: a passage is positive by its words and by how its marks stand.

Record decisions come from the posteriors of all passages, the trusted ones included as if they had no label, with an exact check of what was found:

* a positive passage that holds a bare placeholder or reads as filler makes its document found, whatever surrounds it;
* other positive passages make it found only where hardly anything else is left beside furniture (menus, site names, copyright lines) and noise
  (digits, repeated or foreign-script strings).

The passages of all documents are written, read in each round of the fit and decided, with signs or without, whatever the size of the document.
A round sums at most 2^(BITS + 1) + 3 rows of counts, whatever the corpus.

NULL, empty and blank texts have no passages: they have a row without a score and are never found.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm import prose
from grainmill.llm import textkit as tk
from grainmill.llm.common import cut, read, slices

BITS = 16
ROUNDS = 4
SMOOTHING = 0.5
MAX_RATIO = 8.0  #: of one feature's log likelihood
SMALL = 60  #: words of content; the unlabelled passages of a larger document without signs start the fit as negatives
FURNITURE_WORDS = 4  #: passages of so few words that aren't positive are furniture
OTHER_WORDS = 10  #: words of other content beside a message
OTHER_SHARE = 0.35
UNLABELLED = 0.3  #: weight of passages without a label or a start beside trusted ones, so that their number doesn't make the classes
START = (0.05, 0.005, 0.5)  #: priors before the first round: passages of small and of larger documents, and those with a placeholder
CHUNK, CHUNK_BYTES = 256, 2_000_000  #: documents whose features are made at once, and bytes of their texts
NUMBERS = re.compile(r"\d[\d.,]*")

# Kinds of a passage, as bits.
MARK, FILLER, MESSAGE, TALK, NOISE, PLACED = 1, 2, 4, 8, 16, 32  # PLACED: placeholders in any way, MARK: bare ones
SIGNS = MARK | FILLER | MESSAGE

_NAME = r"[A-Za-z][\w.]*"
_MARK = re.compile(
    rf"\{{\{{\s*{_NAME}(?:\s*\|\s*\w+)?\s*\}}\}}|\{{%=?\s*{_NAME}\s*%\}}|<%=?\s*{_NAME}\s*%>|<<\s*{_NAME}\s*>>|«{_NAME}»|\[\[\s*{_NAME}\s*\]\]|%\({_NAME}\)s|%[A-Z][A-Z_]{{2,}}%"
    rf"|__[A-Z][A-Z_]{{2,}}__|##[A-Z][A-Z_]{{2,}}##|@@[A-Z][A-Z_]{{2,}}@@|\*\|[A-Z][A-Z_:]{{2,}}\|\*|\$\{{{_NAME}\}}|#\{{{_NAME}\}}|\$[A-Z][A-Z_]{{2,}}\$|(?<![\w\\}}])\{{(?:{_NAME}|\d)\}}"
    r"|<[A-Z]{3,}(?: [A-Z]+){0,4}>|\[[A-Z]{3,}(?: [A-Z]+){0,4}\]|\[(?:[A-Z][a-z]+ ){1,3}[A-Z][a-z]+\]|\[object Object\]"
    r"|\[(?:(?i:insert|enter|add|your|amount|client|company|inserte?r?|votre|ihre?|su|tu|ins[ée]rer|einf[üu]gen))\b[^\]\n]{0,40}\]"
)
_QUOTES = [re.compile(p) for p in (r"`[^`\n]*`", r'"[^"\n]*"', r"“[^”\n]*”", r"„[^“\n]*“")]
# The vocabulary of the customary Latin filler.
LOREM = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam
    quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu
    fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vestibulum
    pellentesque habitant morbi tristique senectus netus fames ac turpis egestas malesuada praesent tincidunt mauris vivamus""".split()
)
# What is typed to fill a field.
_KEYS = frozenset("asdf asdfg qwer qwert qwerty zxcv blah bla foo bar baz xxx test dummy".split())
_FILLER = re.compile(
    r"\b(?:description|text|content|copy|title|headline|caption|paragraph|bio|tagline)\s+goes\s+here\b|\bclick\s+(?:edit|here)\s+to\s+(?:change|edit|add|replace)\b|\bbody\s+copy\b|\bto\s+be\s+supplied\b"
    r"|\bsample\s+(?:paragraph|text|page)\b|\buse\s+this\s+(?:space|area|section)\s+to\b|\b(?:this\s+is\s+a\s+)?(?:place\s?holder|dummy)\s+(?:text|paragraph|copy)\b|\byour\s+text\s+here\b|\breplace\s+this\s+(?:text|paragraph)\b|\badd\s+your\s+own\b|\bi'm\s+a\s+paragraph\b|\bdouble\s+click\s+me\b"
    r"|\bbeispieltext\b|\bersetzen\s+sie\s+diesen\b|\bplatzhalter|\btexte?\s+d'exemple\b|\bremplacez\s+ce\b|\btexto\s+de\s+(?:ejemplo|relleno|muestra)\b|\bre+mplace\s+este\b|\bsustituya\s+este\b",
    re.I,
)
_THING = r"(?:page|file|document|article|product|profile|listing|resource|address|site|website|content|item|server|service|session|link|post|record|seite|p[áa]gina|url)"
_MESSAGE = re.compile(
    r"\b(?:http\s+)?(?:error|fehler|erreur)\s*(?:code\s*)?[1-5]\d\d\b|^\W*[45]\d\d\s*(?:[-–:|]|not\s+found|forbidden|bad|internal|service|gateway|error)|\b[45]\d\d\s+(?:not\s+found|forbidden|bad\s+gateway|error|service)\b"
    rf"|\b{_THING}\b[^.!?\n]{{0,40}}\b(?:not\s+(?:be\s+)?(?:found|available|accessible|exist|displayed|reached)|cannot\s+be\s+(?:found|displayed|reached)|could\s+not\s+be\s+(?:found|displayed|loaded)|can't\s+be\s+(?:reached|found)|no\s+longer\s+(?:exists?|available)|does\s+not\s+exist|failed\s+to\s+load|has\s+(?:expired|moved|been\s+(?:removed|deleted|moved|renamed))|is\s+(?:temporarily\s+)?unavailable|has\s+timed\s+out)"
    r"|\bcan't\s+seem\s+to\s+find\b|\binternal\s+server\s+error\b|\berror\s+establishing\b|\baccess\s+(?:is\s+)?denied\b|\bpermission\s+to\s+(?:access|view)\b|\bdown\s+for\s+(?:scheduled\s+)?maintenance\b|\btook\s+too\s+long\s+to\s+respond\b|\bencountered\s+an\s+(?:unexpected|internal)\b"
    r"|\bbad\s+gateway\b|\breturned\s+an\s+invalid\s+response\b|\bsomething\s+went\s+wrong\b|\bno\s+results\s+(?:were\s+)?(?:found|returned)\b|\btoo\s+many\s+requests\b|\bchecking\s+your\s+browser\b|\bsession\s+has\s+(?:timed\s+out|expired)\b|\btry\s+again\s+(?:later|in\s+\d+)|\bray\s+id\b|\bunusual\s+traffic\b|\bnot\s+available\s+in\s+your\s+(?:region|country)\b|\bverify\s+(?:that\s+)?you\s+are\s+(?:a\s+)?human\b|\brequest\s+(?:was|has\s+been)\s+blocked\b|\bnothing\s+happens\b.*\bscript\b"
    r"|\btraceback\s+\(most\s+recent|\bfatal\s+error:|^\W*warning:\s+undefined|\buncaught\s+(?:error|exception)"
    r"|sesi[óo]n\s+ha\s+caducado|session\s+a\s+expir[ée]|sitzung\s+ist\s+abgelaufen|acc[èe]s\s+refus|zugriff\s+verweigert|acceso\s+denegado|nicht\s+gefunden|introuvable|no\s+(?:se\s+)?(?:encontrad|encuentra)|n'existe\s+(?:pas|plus)|existiert\s+nicht|no\s+existe|vor[üu]bergehend\s+nicht|(?:temporairement|momentan[ée]ment)\s+indisponible|r[ée]essayer\s+plus\s+tard|sp[äa]ter\s+(?:erneut|noch\s*mal)|int[ée]ntelo\s+(?:de\s+nuevo\s+)?m[áa]s\s+tarde|no\s+(?:est[áa]\s+)?disponible",
    re.I | re.M,
)
_SCRIPT = r"(?:java\s?script|scripts?|scripting|active\s+(?:content|scripting)|client-side\s+code|cookies|js)\b"
_NOTICE = re.compile(
    rf"\b(?:enable|activate|allow|permit|switch\s+on|turn\s+on|unblock)\s+(?:\w+\s+){{0,3}}?{_SCRIPT}|\b{_SCRIPT}\s+(?:and\s+\w+\s+)?(?:is|are|has\s+been|have\s+been)\s+(?:disabled|not\s+enabled|blocked|required|switched\s+off|turned\s+off)|\b{_SCRIPT}\s+(?:blocking\s+)?is\s+(?:off|switched\s+on|not)|\bbrowser\s+does\s+not\s+support\b|\b(?:works|runs)\s+only\s+when\b"
    rf"|activer\s+{_SCRIPT}|{_SCRIPT}\s+aktivieren|aktivieren\s+sie\s+{_SCRIPT}|activ[ea]r?\s+{_SCRIPT}|necesita\s+que\s+los\s+scripts|habilit\w+\s+{_SCRIPT}|{_SCRIPT}\s+est[ée]n?\s+habilitad",
    re.I,
)
# How a passage with a message shows that it asks, tells or explains: the first person, verbs of saying, conditions, the purpose of mending a fault.
_ASKING = frozenset("i i've me my mine say says said tell tells told ask asks asked write writes wrote written explain explains explained mean means meant called why knowledge message messages".split())
_ASKING_PAIRS = {
    "when": frozenset("i you we he she they".split()), "whenever": frozenset("i you we he she they".split()), "if": frozenset(["you"]), "how": frozenset("do can to".split()),
    "to": frozenset("enable activate turn switch fix solve avoid mend repair".split()),
}


def asking(p: str, words: list[str]) -> bool:
    if "?" in p or not _ASKING.isdisjoint(words):
        return True
    if _ASKING_PAIRS.keys().isdisjoint(words):
        return False
    return any(a in _ASKING_PAIRS and b in _ASKING_PAIRS[a] for a, b in zip(words, words[1:]) if a != "to") or words[:1] == ["to"] and not _ASKING_PAIRS["to"].isdisjoint(words[1:2])


# Words beside a placeholder that is spoken of or filled in properly.
_META = re.compile(r"\b(?:templates?|place\s?holders?|variables?|syntax|render(?:s|ed|ing)?|prints?|printed|fields?|merge|writes?|wrote|written|typed?|types|says?|said|called)\b", re.I)
_PATH = re.compile(r"\S*[/_@]\S*")  # paths, addresses and identifiers aren't words
NEAR = 30  #: characters beside a placeholder
# One of these stands in every match of the pattern, so that most passages need no search.
_NEEDS = {
    _MESSAGE: """error fehler erreur found available accessible denied displayed reached exist load expired moved removed deleted renamed timed seem_to permission maintenance respond encountered gateway
        invalid wrong results requests checking again ray_id traffic human blocked happens traceback warning uncaught forbidden refus verweigert denegado gefunden introuvable
        encontr encuentra existe existiert vor indisponible essayer päter spater inténtelo intentelo disponible http caducado expiré abgelaufen""",
    _NOTICE: "script js cookie active_content active_scripting client-side browser works_only runs_only",
    _FILLER: "goes_here click body_copy supplied sample use_this holder dummy your_text replace_this add_your paragraph beispieltext ersetzen platzhalter exemple remplacez texto emplace sustituya",
}
_NEEDS = {k: tuple(x.replace("_", " ") for x in v.split()) for k, v in _NEEDS.items()}


_DENIED = re.compile(r"permission\s+to", re.I)
_TRACE = re.compile(r"\W*(?:warning:|fatal error:|traceback\b|file \")", re.I)
_SIGNS = re.compile(r"[{}<>\[%#@$«*_`|=;]")
_LETTER = re.compile(r"[A-Za-z\u00c0-\u024f]")


def marks(line: str, in_code: bool) -> list[str]:
    """How each placeholder of a line stands: bare, quoted, code or formula."""
    found = list(_MARK.finditer(line)) if _SIGNS.search(line) else []
    if not found:
        return []
    quoted = [m.span() for q in _QUOTES for m in q.finditer(line)]
    out = []
    for m in found:
        before = line[: m.start()]
        if in_code:
            out.append("code")
        elif before.count("$") % 2 and not m.group().startswith("$") or re.search(r"[\\_^]\w*$|\\\w+\{[^}]*$", before):
            out.append("formula")
        elif any(a < m.start() and m.end() < b for a, b in quoted):
            out.append("quoted")
        else:
            out.append("bare")
    return out


def is_code(line: str, lang: str | None) -> bool:
    """Code by its shape once the placeholders are taken out."""
    if not _SIGNS.search(line):
        return False
    rest = _MARK.sub("word", line)
    return bool(_SIGNS.search(rest)) and not _TRACE.match(line) and prose.line_kind(rest, lang) == "code"


_SIZES, _NUMERALS = [f"n{i}" for i in range(7)], [f"d{i}" for i in range(3)]


def passages(text: str | None) -> list[tuple[str, int, list[str], list[str]]]:
    """(text, kind bits, features beside words, words) of every passage. The words of a passage with marks are those next to the marks."""
    t = tk.clean(text or "")
    if not t.strip():
        return []
    whole = " ".join(t.lower().split())
    # most documents lack what a pattern needs, so their passages aren't searched for it
    message, notice, filler = ([x for x in _NEEDS[p] if x in whole] for p in (_MESSAGE, _NOTICE, _FILLER))
    signs, quotes, apostrophe = _SIGNS.search(t) is not None, any(map(t.__contains__, '"`“„')), "'" in whole or "’" in whole
    lang = tk.language(tk.words(t)) if signs else None
    out, fence, seen = [], False, set()
    for line in t.split("\n"):
        s = line.strip()
        if s.startswith("```"):
            fence = not fence
            continue
        if not s:
            continue
        code = fence or signs and is_code(s, lang)
        for p in [s] if code else tk.sentences(s):
            kind, stands, spoken, path = 0, marks(p, code) if signs else (), p, False
            if stands:
                spoken = _MARK.sub(" ", p)
                kind = PLACED | (MARK if "bare" in stands else 0)
            if "/" in p or "_" in p or "@" in p:
                spoken, path = _PATH.sub(" ", spoken), _PATH.search(p) is not None
            words = tk.words(spoken)
            first = p.lstrip(" \"'(#*-")[:1]
            if message or notice or filler or first in "45":
                plain, lower = p, " ".join(p.lower().split())
                if quotes:
                    for q in _QUOTES:
                        plain = q.sub(" ", plain)
                if filler and not code and any(x in lower for x in filler) and _FILLER.search(p):
                    kind |= FILLER
                if not fence and (message and any(x in lower for x in message) or first in "45") and _MESSAGE.search(p if "permission" in message and _DENIED.search(p) else plain):
                    kind |= MESSAGE
                if not fence and notice and any(x in lower for x in notice) and _NOTICE.search(plain):
                    kind |= MESSAGE
            if not code and filled(words):
                kind |= FILLER
            asks = asking(p, words)
            if stands:
                around = [(p[max(0, m.start() - NEAR) : m.start()], p[m.end() : m.end() + NEAR]) for m in _MARK.finditer(p)]
                meta = any(_META.search(x) for pair in around for x in pair)
                names = [f"m:{x}" for x in stands]
                # what stands around a placeholder is as any content: only the words next to it tell how it is used
                for before, after in around:
                    names += ["<" + w for w in tk.words(before)[-2:]] + [">" + w for w in tk.words(after)[:2]]
                if meta:
                    names.append("t:meta")
                if meta and kind & MARK or "bare" not in stands:
                    kind |= TALK
            else:
                names = [_SIZES[min(len(words) // 4, 6)], _NUMERALS[min(len(NUMBERS.findall(p)), 2)]]
                if path:
                    names.append("t:path")
                if asks:
                    names.append("t:asks")
                if len(words) > 4 and len(set(words)) * 4 <= len(words):
                    names.append("t:again")
            if code or kind & MESSAGE and asks and not kind & (FILLER | MARK) and not _TRACE.match(p):
                kind |= TALK
            if not kind & (MARK | MESSAGE) and letter_poor(p) or len(p) > 30 and words and max(map(len, words)) > 30 or p in seen or apostrophe and len(words) > 3 and sum("'" in w for w in words) * 2 > len(words):
                kind |= NOISE
            seen.add(p)
            out.append((p, kind, names, () if stands else words))
    return out


def filled(words: list[str]) -> bool:
    """Latin filler, one word again and again, or keys struck at random."""
    n = len(words)
    if n >= 4 and words[0] in LOREM | {"text", "content", "copy", "word", "title"} | _KEYS or n >= 4 and words[1] in LOREM:
        return sum(map(LOREM.__contains__, words)) * 10 >= n * 7 or n > 4 and (len(set(words)) == 1 or _KEYS.issuperset(words))
    return False


def letter_poor(p: str) -> bool:
    letters = len(_LETTER.findall(p)) if not p.isascii() else prose.letter_count(p)
    return letters * 2 < len(p.replace(" ", ""))


_PASSAGE = "doc_id bigint, label int, small boolean, kind int, words int, f binary"  # f: 32-bit numbers
_NAMES = ["doc_id", "label", "small", "kind", "words", "f"]
_TYPES = (pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32())
_hashes = tk.Memo(lambda w: zlib.crc32(w.encode()))


def featurise(documents: DataFrame) -> DataFrame:
    """One row per passage: trusted label (1, 0, -1 for none, -2 for none but negative at the start), size, kind and hashed features.

    A document without passages has one row without features.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1, CHUNK, CHUNK_BYTES):
                rows, extra, words, blank = _rows(b.column(0).to_pylist(), b.column(1).to_pylist())
                if rows:
                    f, offsets = _features(extra, words, np.array([r[3] & PLACED > 0 for r in rows], bool))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)), packed(f, np.diff(offsets))], _NAMES)
                if blank:
                    yield pa.RecordBatch.from_arrays([pa.array(blank, pa.int64()), *(pa.array([x] * len(blank), t) for x, t in zip((-1, True, 0, 0, None), (*_TYPES[1:], pa.binary())))], _NAMES)

    return documents.select("doc_id", "text").mapInArrow(run, _PASSAGE)


def packed(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of numbers as binary values, whose bytes pass between Spark and Python in one piece."""
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int32) * 4
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.astype(np.int32).tobytes())])


def unpacked(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of ``packed`` values in one run, and how many each value has."""
    if not len(a):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    _, ends, data = a.buffers()
    at = np.frombuffer(ends, np.int32)[a.offset : a.offset + len(a) + 1]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(flat.tobytes(), np.int32), np.diff(at) // 4


def _rows(keys: list[int], texts: list[str | None]) -> tuple[list[tuple], list[list[str]], list[list[str]], list[int]]:
    """(doc_id, label, small, kind, words), the other features and the words of all passages of some documents, and the documents without any."""
    rows, extra, words, blank = [], [], [], []
    for key, text in zip(keys, texts):
        parts = passages(text)
        if not parts:
            blank.append(key)
        sizes = [len(w) or len(tk.words(_MARK.sub(" ", p))) for p, _, _, w in parts]
        content = sum(n for n, (_, k, _, _) in zip(sizes, parts) if not k & NOISE and n > FURNITURE_WORDS or k & MESSAGE)
        small = content <= SMALL
        signs = any(k & (SIGNS | PLACED) for _, k, _, _ in parts)
        bare = sum(x.count("m:bare") for _, _, x, _ in parts)
        message = sum(n for n, (_, k, _, _) in zip(sizes, parts) if k & MESSAGE)
        talk = any(k & TALK for _, k, _, _ in parts)
        size = f"c{min(content.bit_length(), 8)}"
        for n, (p, kind, names, w) in zip(sizes, parts):
            trusted = not kind & TALK and (kind & FILLER or kind & MARK and bare > 1 or kind & MESSAGE and small and not talk and message * 3 > content)
            # where a sign is asked about, explained or quoted, the rest of the document is content
            proper = kind & TALK or talk and not kind & SIGNS or not small and kind & MESSAGE or not kind & SIGNS and "d2" in names
            rows.append((key, 1 if trusted else 0 if proper else -1 if small or signs else -2, small, kind, n))
            extra.append([*names, size])
            words.append(w)
    return rows, extra, words, blank


def _features(extra: list[list[str]], words: list[list[str]], placed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of all passages in one run, and where each passage begins. Passages with placeholders have the upper half to themselves."""
    n = len(words)
    of = np.repeat(np.arange(n), [len(w) for w in words])
    h = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(words)), np.int64)
    pairs = np.flatnonzero(of[1:] == of[:-1])
    pair = h[pairs] * 0x9E3779B1 + h[pairs + 1] * 0x85EBCA6B >> 7
    own = np.repeat(np.arange(n), [len(x) for x in extra])
    other = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(extra)), np.int64)
    owner = np.concatenate([of, of[pairs], own])
    keys = np.unique(owner << BITS + 1 | placed[owner] << BITS | np.concatenate([h, pair, other]) & (1 << BITS) - 1)
    return keys & (2 << BITS) - 1, np.searchsorted(keys, np.arange(n + 1) << BITS + 1)


class Classes:
    """The two classes: log ratios of features, and the prior log odds of the groups of START.

    Passages with placeholders are told apart among themselves: their features have rates of their own, in the upper half of the table.
    """

    def __init__(self, table: np.ndarray, odds: np.ndarray):
        self.table, self.odds = table, odds

    @staticmethod
    def groups(b: pa.RecordBatch) -> np.ndarray:
        return np.where(b.column(3).to_numpy() & PLACED > 0, 2, np.where(b.column(2).to_numpy(zero_copy_only=False), 0, 1))

    def posterior(self, b: pa.RecordBatch, labels: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Posterior per passage; its features in one run, and the passage of each. ``labels``: trusted passages keep theirs, as in the fit."""
        flat, size = unpacked(b.column(5))
        owner = np.repeat(np.arange(len(size)), size)
        score = np.bincount(owner, self.table[flat], len(size)) + self.odds[self.groups(b)]
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if labels:
            known = b.column(1).to_numpy()
            p = np.where(known >= 0, known, p)
        return p, flat, owner


def start() -> Classes:
    p = np.array(START)
    return Classes(np.zeros(2 << BITS, np.float32), np.log(p / (1 - p)))


def fit(rows: DataFrame, rounds: int = ROUNDS) -> Classes:
    """Expectation-maximisation over all passages; every round sums at most 2^(BITS + 1) + 3 rows of expected counts."""
    model, size = start(), 2 << BITS
    for turn in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast((model.table, model.odds))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=turn == 0) -> Iterator[pa.RecordBatch]:
            m = Classes(*shared.value)
            pos, all_ = np.zeros(size + 3), np.zeros(size + 3)
            for b in batches:
                b = b.filter(pc.is_valid(b.column(5)))
                if not b.num_rows:
                    continue
                p, flat, owner = m.posterior(b, True)
                label, group = b.column(1).to_numpy(), m.groups(b)
                weight = np.where(label == -1, UNLABELLED, 1.0)
                if first:
                    p = np.where(label == -2, 0, p)
                pos[:size] += np.bincount(flat, (p * weight)[owner], size)
                all_[:size] += np.bincount(flat, weight[owner], size)
                pos[size : size + 3] += np.bincount(group, p * weight, 3)
                all_[size : size + 3] += np.bincount(group, weight, 3)
            at = np.flatnonzero(all_)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(pos[at]), pa.array(all_[at])], ["b", "p", "n"])

        sums = rows.mapInArrow(run, "b int, p double, n double").groupBy("b").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).toPandas()
        pos, all_ = np.zeros(size + 3), np.zeros(size + 3)
        pos[sums.b.to_numpy()], all_[sums.b.to_numpy()] = sums.p, sums.n
        if not all_.any():
            break
        neg = all_ - pos
        # Bernoulli rates of the present features, of the passages of each class, with and without placeholders apart
        total = lambda x: np.repeat([x[size] + x[size + 1], x[size + 2]], size // 2)
        n_pos, n_all = total(pos), total(all_)
        table = np.log((pos[:size] + SMOOTHING * n_pos / np.maximum(1, n_all)) / (n_pos + SMOOTHING) + 1e-12) - np.log((neg[:size] + SMOOTHING) / (n_all - n_pos + SMOOTHING))
        table[all_[:size] < 2] = 0
        odds = np.log((pos[size : size + 3] + 1) / (neg[size : size + 3] + 1))
        odds[:2] = np.minimum(odds[:2], start().odds[:2])  # a class that grows beyond what can be residue has drifted
        model = Classes(np.clip(table, -MAX_RATIO, MAX_RATIO).astype(np.float32), odds)
    return model


def decide(rows: DataFrame, model: Classes) -> DataFrame:
    """One row per document: words by decision, and the reason if it is found."""
    shared = rows.sparkSession.sparkContext.broadcast((model.table, model.odds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Classes(*shared.value)
        for b in batches:
            if b.num_rows:
                p, _, _ = m.posterior(b, False)
                nothing = pc.is_null(b.column(5)).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(4), pa.array(p, mask=nothing)], ["doc_id", "kind", "words", "p"])

    scored = rows.mapInArrow(run, "doc_id bigint, kind int, words int, p double")
    has = lambda bit: F.col("kind").bitwiseAND(F.lit(bit)) != 0
    yes = F.col("p") > 0.5
    message = yes & has(MESSAGE) | yes & ~has(MARK) & ~has(FILLER)
    other = ~yes & ~has(NOISE) & (F.col("words") > FURNITURE_WORDS)
    docs = scored.groupBy("doc_id").agg(
        F.count_if(yes & has(MARK)).alias("placeholders"), F.count_if(yes & has(FILLER)).alias("fillers"), F.count_if(yes & (has(MESSAGE) | ~has(NOISE) & ~has(TALK) & (F.col("words") > FURNITURE_WORDS))).alias("messages"),
        F.coalesce(F.sum(F.when(message, F.col("words"))), F.lit(0)).alias("message_words"), F.coalesce(F.sum(F.when(other, F.col("words"))), F.lit(0)).alias("other_words"), F.max("p").alias("score"),
    )
    alone = F.col("other_words") <= F.greatest(F.lit(OTHER_WORDS), F.col("message_words") * OTHER_SHARE)
    reason = F.when(F.col("placeholders") > 0, "placeholder").when(F.col("fillers") > 0, "filler").when((F.col("messages") > 0) & alone, "message")
    return docs.withColumn("reason", reason)


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(featurise(read(spark, sf_dir, "documents", "doc_id", "text")))
    return decide(rows, fit(rows))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).where("reason IS NOT NULL").select("doc_id")


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by what its passages are, and the reason if it is found."""
    out = _decisions(spark, sf_dir)
    return out.withColumn("score", F.round("score", 6))


ORACLE: dict[str, str] = {}
QUERIES = {"p9_found": p9_found, "p9_passages": p9_passages}
