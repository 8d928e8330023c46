"""Toxicity: noisy-channel deobfuscation, then a lexicon of significant words and word beginnings.

Language model: counts of letter triples (26 letters, one class for other letters, one for the word's edge)
over the whole texts of all documents, interpolated with pairs and single letters.

Channel: tokens with digits or symbols beside their letters, tokens with repeated letters, rows of single letters, and
neighbours that the language model would rather read as one word are lattices. Each input character stands for
itself, for the letters it resembles (``LEET``), or for nothing; a run of one letter stands for one or two of it;
a space stands for nothing or for the edge between two words. The
Viterbi path of least channel cost plus language-model cost is the restored text, which is
scored along with the original. Other tokens are their own restoration.

Most lattices have letters with one reading, doubled letters and spaces only, at places that share no term of
the cost. There the path is the sum of independent choices, so ``simple`` takes the cheaper reading
at each place by arrays, with the path's own costs; the others are decoded one by one.

Lexicon: over training documents (labels of rows whose crc32(doc_id as text) modulo ``FOLDS`` is not
``HELD_OUT``; near copies count once, by their smallest shingle hash), words and their first 4, 5 and 6
bytes that toxic documents hold significantly more often (log-likelihood ratio) get their
log odds as weight. A document's evidence is its largest weight and how many distinct words hit;
a logistic fit on the training rows makes the score. Training reads at most about ``TRAIN_ROWS`` documents
of each label, chosen by hash; that bounds the broadcast ids and the lexicon. Language-model counts and
scores cover every document.

Defined cases: null and empty texts have no evidence and get the score of documents without
hits. Labels that are null or without a document are not used; without both labels every
score is 0.5. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import bytesops as B
from lexmill.llm.scratch import Scratch

FOLDS, HELD_OUT = 4, 2
ACCEPT = 0.3
TRAIN_ROWS = 200_000
LEAST_DOCS, LEAST_LLR, LEAST_WEIGHT = 4, 24.0, 1.5
CUTS = (4, 5, 6)
MERGE = 1 << 18
CLASSES = 28
OTHER, EDGE = 26, 27
START = CLASSES * EDGE + EDGE
_ROW = np.uint64(0xD6E8FEB86659FD93)

LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "*": "aeiou", "#": "", "%": "", "&": "a", ".": "", "-": "", "_": "", ",": "", "'": "", "~": "", "^": "a", "=": "", "/": "", "\\": "", ")": "", ":": "", ";": "", "?": "", '"': "", " ": ""}
SWAP, ANY, DROP, SEPARATOR, REPEAT = 0.7, 2.5, 3.0, 0.3, 0.3
_SEPARATORS = " .-_*'~,/"
_RUN = re.compile(r"(.)\1*", re.DOTALL)
#: a row of letters of which none stands twice, or else a run of one character
_STEP = re.compile(r"((?:([^\W\d_])(?!\2))+)|(.)\3*", re.DOTALL)

LETTER = B.table_of(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_DIGIT = B.table_of(b"0123456789")
_LEET = B.table_of("".join(c for c in LEET if ord(c) < 128 and c != " ").encode())
_CLASS = np.full(256, EDGE, np.uint8)
_CLASS[LETTER] = OTHER
for _c in range(26):
    _CLASS[65 + _c] = _CLASS[97 + _c] = _c
_CONTINUED = B.table_of(bytes(range(128, 192)))
_READ = B.table_of("".join(c for c, letters in LEET.items() if ord(c) < 128 and letters).encode())
_READING = _CLASS.copy()
for _c in np.flatnonzero(_READ):
    _READING[_c] = ord(LEET[chr(_c)][0]) - 97


# Language model


def triples(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of letter triples within words, with one edge on either side."""
    c = _CLASS[data]
    c = np.where(_CONTINUED[data], 255, c)  # one class for each character, not for each byte
    stop = np.zeros(len(data) + 1, bool)
    stop[at[:-1]] = True
    gaps = np.flatnonzero(stop[:-1])
    c = np.insert(c, gaps, EDGE)
    c = c[c != 255].astype(np.int32)
    c = np.concatenate([[EDGE], c, [EDGE, EDGE]])
    x, y, z = c[:-2], c[1:-1], c[2:]
    keep = (y != EDGE) | ((x != EDGE) & (z == EDGE))
    return np.bincount(((x * CLASSES + y) * CLASSES + z)[keep], minlength=CLASSES**3)


class LanguageModel:
    def __init__(self, counts: np.ndarray):
        n3 = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
        n2 = n3.sum(0)
        n1 = n2.sum(0)
        p1 = (n1 + 1) / (n1 + 1).sum()
        p2 = (n2 + 5 * p1) / (n2.sum(1, keepdims=True) + 5)
        p3 = (n3 + 5 * p2) / (n3.sum(2, keepdims=True) + 5)
        # a word's first letter: the triples leave it out, those behind it count it
        first = n3[EDGE, :EDGE].sum(1)
        p3[:, EDGE, :EDGE] = (first + 5 * p1[:EDGE]) / (first.sum() + 5)
        self._set(-np.log(p3))

    def _set(self, table: np.ndarray) -> None:
        self.table = table
        self.flat = table.ravel().tolist()
        self.gap = lru_cache(1 << 17)(lambda state, text, after: decode(state, text, after, self))

    def __reduce__(self):
        return _of_table, (self.table,)


_models: dict[bytes, LanguageModel] = {}


def _of_table(table: np.ndarray) -> LanguageModel:
    """The model of a table, one in a worker, so that tasks share its gaps."""
    name = hashlib.blake2b(table.tobytes(), digest_size=16).digest()
    if name not in _models:
        _models.clear()
        _models[name] = LanguageModel.__new__(LanguageModel)
        _models[name]._set(table)
    return _models[name]


def _class(ch: str) -> int:
    return ord(ch) - 97 if "a" <= ch <= "z" else EDGE if ch == " " else OTHER


@lru_cache(1 << 12)
def readings(ch: str, n: int) -> tuple[tuple[str, float, tuple[int, ...]], ...]:
    """The readings of a run of n equal lower-case characters, with their channel costs and classes."""
    if ch.isalpha() and ch not in LEET:
        reads = [(ch * n, 0.0 if n < 3 else REPEAT * n)]
        if n > 1:
            reads.append((ch, REPEAT if n > 2 else 4 * REPEAT))
        if n > 2:
            reads.append((ch * 2, 1.5 * REPEAT))
    else:
        letters = LEET.get(ch, "")
        price = SWAP if len(letters) < 3 else ANY
        reads = [(x, price) for x in letters]
        if n > 1:
            reads += [(x * 2, price * 1.5) for x in letters]
        reads.append(("", SEPARATOR if ch in _SEPARATORS else DROP))
        if ch == " ":
            reads.append((" ", SEPARATOR))
    return tuple((word, price, tuple(map(_class, word))) for word, price in reads)


def options(text: str) -> list[tuple[tuple[str, float, tuple[int, ...]], ...]]:
    """The lattice of a lower-case token: for each run of one character, its readings."""
    return [readings(m[0][0], len(m[0])) for m in _RUN.finditer(text)]


def viterbi(text: str, lm: LanguageModel) -> str:
    """The reading of least channel and language-model cost.

    Letters that stand alone have one reading. Behind two of them in a row all paths are in one state, so what stands
    between such rows is decoded by itself, and each such gap once.
    """
    out, state, at = [], START, 0
    for m in _STEP.finditer(text):
        row = m[1]
        if row and len(row) > 1 and row.isalpha():
            if at < m.start():
                out.append(lm.gap(state, text[at : m.start()], row[:2]))
            out.append(row)
            state, at = _class(row[-2]) * CLASSES + _class(row[-1]), m.end()
    if at < len(text):
        out.append(lm.gap(state, text[at:], ""))
    return "".join(out)


def decode(state: int, text: str, after: str, lm: LanguageModel) -> str:
    """The best reading of a text between a state (the last two classes) and the letters ``after`` it, or the end."""
    cost = lm.flat
    best = {state: (0.0, None)}  # state -> (cost, (string, previous))
    ends = (((after, 0.0, tuple(map(_class, after))),),) if after else (((" ", 0.0, (EDGE,)),),)
    for reads in (*options(text), *ends):
        nxt: dict = {}
        for state, (c, path) in best.items():
            for word, price, classes in reads:
                at, total = state, c + price
                for z in classes:
                    at = at * CLASSES + z
                    total += cost[at]
                    at %= CLASSES * CLASSES
                if at not in nxt or total < nxt[at][0]:
                    nxt[at] = total, ((word, path) if word else path)
        best = nxt
    path = min(best.values(), key=lambda r: r[0])[1][1]
    parts = []
    while path:
        parts.append(path[0])
        path = path[1]
    return "".join(reversed(parts))


def _two_bytes() -> tuple[np.ndarray, np.ndarray]:
    """(whether a letter whose lower case has two bytes too, that lower case) of the characters below 0x800."""
    low = [ord(x) if len(x := chr(c).lower()) == 1 and 0x80 <= ord(x) < 0x800 else 0 for c in range(0x800)]
    return np.array([chr(c).isalpha() and x > 0 for c, x in enumerate(low)]), np.array(low, np.uint16)


_ALPHA, _LOWERED = _two_bytes()
_GAPS = re.compile("[\t-\r ]+")
_TWICE = re.compile(r"([^\W\d_])\1")


def _code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((data[at] & 0x1F).astype(np.uint16) << 6) | (data[at + 1] & 0x3F)


class Spans:
    """The spans of a slice that need restoring, as runs of tokens; ``hard`` ones need their lattice."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lm: LanguageModel | None):
        self.data = data
        self.s, self.e, self.row = s, e, row = B.words(data, at, B.NOT_SPACE)
        self.first = self.last = np.zeros(0, np.int64)
        self.hard = np.zeros(0, bool)
        if not len(s):
            return
        low, letter = B.LOWER[data], LETTER[data]
        n = len(data)
        flag, bad = np.zeros(n, bool), _READ[data]
        flag[:-1] |= _LEET[data[:-1]] & letter[1:]
        flag[1:] |= _READ[data[1:]] & letter[:-1]
        twice = letter[:-1] & (low[:-1] == low[1:]) & (data[:-1] < 128)
        flag[:-1] |= twice
        bad[1:-1] |= twice[:-1] & twice[1:]
        wide = np.flatnonzero(data >= 0xC0)
        if len(wide):
            self._beyond_ascii(wide, flag, bad, s, e)
        letters = np.concatenate([[0], np.cumsum(letter, dtype=np.int32)])
        own = letters[e] - letters[s]
        bads = np.concatenate([[0], np.cumsum(bad, dtype=np.int32)])
        bad_token = bads[e] > bads[s]

        k = np.unique(np.searchsorted(s, np.flatnonzero(flag), "right") - 1)
        k = k[k >= 0]
        k = k[own[k] > 0]
        single = _single(data, s, e)
        both = single[1:] & single[:-1]
        split = _split(data, s, e, letters, lm) if lm is not None else np.zeros(len(s) - 1, bool)
        link = (both | split) & (row[1:] == row[:-1])
        edge = np.flatnonzero(np.diff(np.concatenate([[False], link, [False]]).astype(np.int8)))
        a, b = edge[::2], edge[1::2]
        ok = (b - a >= 3) | (letters[e[b]] > letters[s[a]])
        a, b = a[ok], b[ok]

        # Where a token's letters begin and end, and whether nothing stands between them.
        where = np.flatnonzero(letter)
        lo, hi = np.full(len(s), -1), np.full(len(s), -1)
        some = np.flatnonzero(own)
        lo[some] = where[letters[s[some]]]
        hi[some] = where[letters[e[some]] - 1]
        packed = (own > 0) & (hi - lo + 1 == own)
        to_start, to_end = packed & (lo == s), packed & (hi == e - 1)
        size = e - s
        pair = np.concatenate([twice, [False]])
        twice_first = (size > 1) & pair[s]
        twice_last = (size > 1) & pair[np.maximum(e - 2, s)]
        one = own < 2  # a character of several bytes alone in a token counts as its bytes
        alone = np.flatnonzero((size <= 4) & (data[s] >= 0xC0))
        one[alone] = np.bincount(np.repeat(np.arange(len(alone)), size[alone]), weights=~_CONTINUED[data[np.repeat(s[alone], size[alone]) + _counts(size[alone])]], minlength=len(alone)) < 2

        def among(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            """Whether any of x[lo:hi] holds."""
            c = np.concatenate([[0], np.cumsum(x, dtype=np.int32)])
            return c[np.maximum(hi, lo)] > c[lo]

        tangled = among(bad_token, a, b + 1) | among(~(to_start & to_end) | one, a + 1, b) | ~to_end[a] | ~to_start[b]
        tangled |= among(twice_last, a, b) | among(twice_first, a + 1, b + 1) | among(~split, a, b)
        plain = packed[k] & ~bad_token[k] & ~among(twice, s[k], e[k] - 1)
        k = k[~plain]  # restored, it is its own word
        self.first, self.last = np.concatenate([k, a]), np.concatenate([k, b])
        self.hard = np.concatenate([bad_token[k], tangled])

    def _beyond_ascii(self, wide: np.ndarray, flag: np.ndarray, bad: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        data = self.data
        lead = data[wide]
        flag[wide[(lead == 0xC2) & (data[np.minimum(wide + 1, len(data) - 1)] == 0xA3)]] = True  # the pound sign
        three = wide[lead >= 0xE0]
        bad[three] = True
        end = len(data) - 1
        flag[three[(data[three] == 0xE2) & (data[np.minimum(three + 1, end)] == 0x82) & (data[np.minimum(three + 2, end)] == 0xAC)]] = True  # the euro sign
        two = wide[lead < 0xE0]
        point = _code_points(data, two)
        bad[two[~_ALPHA[point]]] = True
        low = _LOWERED[point]
        again = np.flatnonzero((two[1:] == two[:-1] + 2) & (low[1:] == low[:-1]) & _ALPHA[point[1:]])
        flag[two[again]] = bad[two[again]] = True
        # longer characters side by side, perhaps equal
        width = np.where(data[three] >= 0xF0, 4, 3)
        near = three[:-1][three[1:] == three[:-1] + width[:-1]]
        raw = data.tobytes() if len(near) else b""
        for k in np.unique(np.searchsorted(s, near, "right") - 1).tolist():
            if k >= 0 and _TWICE.search(raw[s[k] : e[k]].decode("utf-8", "replace").lower()):
                flag[s[k]] = True

    def texts(self, which: np.ndarray) -> list[tuple[int, str]]:
        """(row, lower-case text) of spans, tokens joined by one space."""
        raw, a, b = self.data.tobytes(), self.first[which], self.last[which]
        rows, begin, end = self.row[a].tolist(), self.s[a].tolist(), self.e[b].tolist()
        return [(r, _GAPS.sub(" ", raw[x:y].decode("utf-8", "replace").lower())) for r, x, y in zip(rows, begin, end, strict=True)]

    def simple(self, lm: LanguageModel) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(bytes, starts, ends, row) of the restored words of the other spans, whose choices are independent."""
        which = np.flatnonzero(~self.hard)
        if not len(which):
            return []
        a, b = self.first[which], self.last[which]
        begin, size = self.s[a], self.e[b] - self.s[a]
        g = self.data[np.repeat(begin, size) + _counts(size)]
        span = np.repeat(np.arange(len(which)), size)
        keep = LETTER[g]
        at = np.flatnonzero(keep & ~_CONTINUED[g])
        own, c, low = span[at], _CLASS[g[at]], B.LOWER[g[at]]
        # The first letters of pairs: one of them is read if that costs less.
        k = np.flatnonzero((at[1:] == at[:-1] + 1) & (low[1:] == low[:-1]) & (own[1:] == own[:-1]) & (low[:-1] < 128))
        y = np.where((k > 0) & (own[np.maximum(k - 1, 0)] == own[k]), c[np.maximum(k - 1, 0)], EDGE)
        z = np.where((k + 2 < len(at)) & (own[np.minimum(k + 2, len(at) - 1)] == own[k]), c[np.minimum(k + 2, len(at) - 1)], EDGE)
        t = lm.table
        drop = t[y, c[k], z] + 4 * REPEAT < t[y, c[k], c[k]] + t[c[k], c[k], z]
        keep[at[k[drop] + 1]] = False
        two = at[(g[at] >= 0xC0) & (g[at] < 0xE0)]
        if len(two):
            low = _LOWERED[_code_points(g, two)]
            g[two], g[two + 1] = 0xC0 | (low >> 6), 0x80 | (low & 0x3F)
        ends = np.cumsum(np.bincount(span[keep], minlength=len(which)))
        starts = np.concatenate([[0], ends[:-1]])
        g = g[keep]
        row = self.row[a]
        changed = (a < b) | (np.bincount(own[k[drop]], minlength=len(which)) > 0) | (ends - starts < size)
        out = [(g, starts[changed], ends[changed], row[changed])]
        # words of spans of tokens also without their first or last letter
        lead = np.concatenate([[0], np.cumsum(~_CONTINUED[g], dtype=np.int32)])
        long = (a < b) & (lead[ends] - lead[starts] > 4)
        starts, ends, row = starts[long], ends[long], row[long]
        place = np.flatnonzero(~_CONTINUED[g])
        return [*out, (g, place[lead[starts] + 1], ends, row), (g, starts, place[lead[ends] - 1], row)]


def _counts(n: np.ndarray) -> np.ndarray:
    """0 .. n[0] - 1, 0 .. n[1] - 1, and so on."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n, n)


def suspicious(data: np.ndarray, at: np.ndarray, lm: LanguageModel | None = None) -> list[tuple[int, str]]:
    """(row, obfuscated text) of the spans of a slice that need restoring; split words are found by ``lm``."""
    spans = Spans(data, at, lm)
    return spans.texts(np.arange(len(spans.first)))


def _split(data: np.ndarray, s: np.ndarray, e: np.ndarray, letters: np.ndarray, lm: LanguageModel) -> np.ndarray:
    """Whether a token and the next one cost less as one word than as two."""
    own = ~_CONTINUED[data]
    c = _READING[data[own]]
    n = np.concatenate([[0], np.cumsum(own, dtype=np.int32)])
    a, b = n[s], n[e]
    size = b - a
    ok = (letters[e] > letters[s]) & (size > 0)
    last, first = c[np.maximum(b - 1, 0)], c[np.minimum(a, len(c) - 1)]
    before = np.where(size > 1, c[np.maximum(b - 2, 0)], EDGE)
    after = np.where(size > 1, c[np.minimum(a + 1, len(c) - 1)], EDGE)
    x, y, z, w = before[:-1], last[:-1], first[1:], after[1:]
    t = lm.table
    one = t[x, y, z] + t[y, z, w]
    two = t[x, y, EDGE] + t[y, EDGE, z] + t[EDGE, z, w]
    return ok[:-1] & ok[1:] & (y != EDGE) & (z != EDGE) & (one < two)


def _single(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Whether a token is one letter or one character that may stand for a letter, perhaps with a mark behind."""
    n = e - s
    first = data[s]
    second = data[np.minimum(s + 1, len(data) - 1)]
    one = LETTER[first] | _LEET[first]
    return one & ((n == 1) | ((n == 2) & ((first >= 128) | ~LETTER[second] & ~_DIGIT[second])))


def restore(text: str, lm: LanguageModel) -> list[str]:
    """The words of a suspicious span's best reading; rows of letters also without their first or last letter."""
    best = viterbi(text, lm)
    words = re.findall(r"[^\W\d_]+", best)
    return [*words, *(w for x in words for w in (x[1:], x[:-1]) if len(w) > 3)] if " " in text else words


def _restorer(lm: LanguageModel | None):
    kept = lru_cache(1 << 16)(lambda t: restore(t, lm))

    def parts(data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(bytes, starts, ends, row) of the restored words of a slice."""
        spans = Spans(data, at, lm)
        found, own = [], []
        for r, t in spans.texts(np.flatnonzero(spans.hard)):
            for w in kept(t) if len(t) < 200 else restore(t, lm):
                found.append(w.encode())
                own.append(r)
        out = spans.simple(lm) if lm is not None else []
        if found:
            n = np.array([len(w) for w in found])
            ends = np.cumsum(n)
            out.append((np.frombuffer(b"".join(found), np.uint8), ends - n, ends, np.array(own)))
        return out

    return parts


def features(data: np.ndarray, at: np.ndarray, restored) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row): for each word of a slice, original or restored, the hashes of itself and of its first bytes."""
    s, e, row = B.words(data, at, LETTER)
    parts = [(data, s, e, row), *restored(data, at)]
    x = [np.stack(B.hashes(g, s, e, CUTS), 1) for g, s, e, _ in parts]
    return np.concatenate(x), np.concatenate([r for *_, r in parts])


# Training


@B.lean
def _gather(batches):
    """Triple counts of the partition (kind 0), and the smallest shingle hash of each training document (kind 1)."""
    total = np.zeros(CLASSES**3, np.int64)
    for b in batches:
        label = b.column("label")
        ids, y = b.column("doc_id"), label.to_pylist()
        out_id, out_key, out_y = [], [], []
        for lo, hi, data, at in B.slices(b.column("text")):
            total += triples(data, at)
            if any(v is not None for v in y[lo:hi]):
                s, e, row = B.words(data, at, B.NOT_SPACE)
                x, r = B.shingles(B.hashes(data, s, e)[0], row, hi - lo, 4)
                cut = B.bounds(r, hi - lo)
                for i in range(hi - lo):
                    if y[lo + i] is not None and cut[i] < cut[i + 1]:
                        out_id.append(ids[lo + i].as_py())
                        out_key.append(int(x[cut[i] : cut[i + 1]].min().astype(np.int64)))
                        out_y.append(y[lo + i])
        if out_id:
            yield _rows(1, out_id, out_key, out_y)
    some = np.flatnonzero(total)
    yield _rows(0, some.tolist(), total[some].tolist(), [0] * len(some))


def _rows(kind: int, a: list, b: list, label: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(a), pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "label": pa.array(label, pa.int32())})


def _count(lm: LanguageModel, only: np.ndarray | None):
    """In how many documents of the partition each feature (of ``only``) occurs."""

    def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        k, at = np.unique(np.concatenate(keys), return_inverse=True)
        return [k], [np.bincount(at, weights=np.concatenate(counts), minlength=len(k)).astype(np.int64)]

    def every(slices):
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for x, r in slices:
            _, first = np.unique(B.spread(x + r.astype(np.uint64) * _ROW), return_index=True)  # each feature once in a document
            k, n = np.unique(x[first], return_counts=True)
            keys.append(k)
            counts.append(n)
            if sum(map(len, keys[1:])) > max(MERGE, len(keys[0])):
                keys, counts = merge(keys, counts)
        keys, counts = merge(keys, counts)
        return keys[0], counts[0]

    def known(slices):
        keys = Keys(only)
        counts = np.zeros(len(only), np.int64)
        for x, r in slices:
            at, k = keys.find(x)
            pairs = np.sort(r[at] * len(only) + k)
            pairs = pairs[np.flatnonzero(np.diff(pairs, prepend=-1))]
            counts += np.bincount(pairs % len(only), minlength=len(only))
        some = np.flatnonzero(counts)
        return keys.keys[some], counts[some]

    @B.lean
    def run(batches):
        restored = _restorer(lm)

        def slices():
            for b in batches:
                for _, _, data, at in B.slices(b.column("text")):
                    x, row = features(data, at, restored)
                    yield x.ravel(), np.repeat(row, x.shape[1])

        keys, counts = (every if only is None else known)(slices())
        yield pa.RecordBatch.from_pydict({"f": pa.array(keys.astype(np.int64)), "n": pa.array(counts)})

    return run


def weigh(n1: np.ndarray, n0: np.ndarray, t1: int, t0: int) -> tuple[np.ndarray, np.ndarray]:
    """(weight, log-likelihood ratio) of features in n1 of t1 toxic and n0 of t0 other documents."""

    def ll(k, n, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log1p(-p)

    both = (n1 + n0) / (t1 + t0)
    g = 2 * (ll(n1, t1, n1 / t1) + ll(n0, t0, n0 / t0) - ll(n1, t1, both) - ll(n0, t0, both))
    return np.log((n1 + 0.5) / (t1 + 1)) - np.log((n0 + 0.5) / (t0 + 1)), g


class Keys:
    """Sorted hashes, with a bit map of their low bits that turns most others away."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        bits = max(16, (16 * len(keys)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.low = np.zeros(1 << bits, bool)
        self.low[self.keys & self.mask] = True

    def __reduce__(self):
        return Keys, (self.keys,)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where in x, which key) of the hashes that are keys."""
        at = np.flatnonzero(self.low[x & self.mask])
        k = np.searchsorted(self.keys, x[at])
        ok = self.keys[np.minimum(k, len(self.keys) - 1)] == x[at]
        return at[ok], k[ok]


class Lexicon:
    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        self.keys, self.weights = Keys(keys), weights[np.argsort(keys)]

    def evidence(self, x: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(largest weight, distinct words that hit) by row."""
        top, hits = np.zeros(rows), np.zeros(rows, np.int64)
        if not len(self.weights) or not len(x):
            return top, hits
        w = np.zeros(len(x))
        for c in range(x.shape[1]):
            at, k = self.keys.find(x[:, c])
            w[at] = np.maximum(w[at], self.weights[k])
        some = np.flatnonzero(w)
        np.maximum.at(top, row[some], w[some])
        pairs = np.unique(np.stack([row[some].astype(np.uint64), x[some, 0]], 1), axis=0)
        return top, np.bincount(pairs[:, 0].astype(np.int64), minlength=rows)


def _evidence(lm: LanguageModel, lexicon: Lexicon):
    @B.lean
    def run(batches):
        restored = _restorer(lm)
        for b in batches:
            tops, hits = [np.zeros(0)], [np.zeros(0, np.int64)]
            for lo, hi, data, at in B.slices(b.column("text")):
                t, h = lexicon.evidence(*features(data, at, restored), hi - lo)
                tops.append(t)
                hits.append(h)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(tops)), pa.array(np.concatenate(hits).astype(np.int64))], names=["doc_id", "top", "hits"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients (constant last) of a ridge logistic fit to n rows of each (x, y)."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - y)) + ridge * w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(w)), g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of at most about ``TRAIN_ROWS`` training rows of each label."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where(f"label IN (0, 1) AND crc32(cast(doc_id AS string)) % {FOLDS} <> {HELD_OUT}").distinct()
    most = own.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    return own.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-most // TRAIN_ROWS)))) == 0)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    train = scratch.table(training(labels), "training")
    marked = docs.join(F.broadcast(train.groupBy("doc_id").agg(F.max("label").alias("label"))), "doc_id", "left")
    got = scratch.table(marked.mapInArrow(_gather, "kind int, a long, b long, label int"), "gathered")
    counts = np.zeros(CLASSES**3)
    for r in got.where("kind = 0").groupBy("a").agg(F.sum("b").alias("n")).collect():
        counts[r.a] = r.n
    lm = LanguageModel(counts)
    chosen = scratch.table(got.where("kind = 1").groupBy("b", "label").agg(F.min("a").alias("doc_id")).select("doc_id", "label"), "chosen")
    sizes = {r.label: r["count"] for r in chosen.groupBy("label").count().collect()}
    lexicon = Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    if sizes.get(0) and sizes.get(1):

        def count(label: int, only):
            own = docs.join(F.broadcast(chosen.where(F.col("label") == label).select("doc_id")), "doc_id", "left_semi")
            return own.mapInArrow(_count(lm, only), "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))

        toxic = count(1, None).where(F.col("n") >= LEAST_DOCS).toPandas()
        keys = np.sort(toxic.f.to_numpy(np.int64).astype(np.uint64))
        n1 = toxic.set_index(toxic.f.to_numpy(np.int64).astype(np.uint64)).n.reindex(keys).to_numpy(float)
        clean = count(0, keys).toPandas() if len(keys) else toxic
        n0 = clean.set_index(clean.f.to_numpy(np.int64).astype(np.uint64)).n.reindex(keys).fillna(0).to_numpy(float)
        w, g = weigh(n1, n0, sizes[1], sizes[0])
        ok = (w >= LEAST_WEIGHT) & (g >= LEAST_LLR)
        lexicon = Lexicon(keys[ok], w[ok])
    found = scratch.table(docs.mapInArrow(_evidence(lm, lexicon), "doc_id long, top double, hits long"), "evidence")
    table = found.join(F.broadcast(train), "doc_id").groupBy(F.round("top", 1).alias("top"), F.least("hits", F.lit(20)).alias("hits"), "label").count().toPandas()
    if set(table.label) == {0, 1}:
        a, b, c = logistic(np.column_stack([table.top, np.log1p(table.hits)]), table.label.to_numpy(float), table["count"].to_numpy(float)).tolist()
    else:
        a = b = c = 0.0
    score = F.expr(f"1 / (1 + exp(-(({a!r}D) * round(top, 1) + ({b!r}D) * ln(1D + least(hits, 20)) + ({c!r}D))))")
    out = found.select("doc_id", F.expr(f"coalesce(crc32(cast(doc_id AS string)) % {FOLDS} = {HELD_OUT}, false)").alias("held_out"), score.alias("score"))
    return scratch.result(out.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int")))
