"""The relational check (Q1) beside a dictionary that may be broadcast: one kernel takes blocks of texts apart.

A text's tokens, skip ranges, line states and directive typos are found in one pass. Plain words of letters are settled by arrays, the
others by the checker, once for each word, code token and state.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexmill.operators import directives, scan, skips
from lexmill.operators.checker import Checker, Config

COLUMNS = "word string, offset bigint, line int, column int, is_forbidden boolean, suggestions array<string>, _first int, _place bigint"
_PREFIX, _LOCAL = regex.compile(directives._PREFIX), regex.compile(directives._LOCAL)
_RULES = [(kind, re.compile(p, re.A), re.compile(p, re.A | re.I)) for kind, p in directives.RULES]
_LOWER_NAMES = {n.lower() for n in directives.NAMES}
_SPACE = " \t\n\x0b\f\r"
_NAME = re.compile(rf"[^{_SPACE}:]*")
_NONE: frozenset[str] = frozenset()
_SIMPLE = r"^\p{Lu}?\p{Ll}+$"
_pairs = {chr(i).lower() for i in range(0x41, 0x300) if chr(i).isalpha() and i != 0x130}
#: F23 for simple words
_REPEATED = "^(?:" + "|".join(rf"[{c}{c.upper() if len(c.upper()) == 1 and c.upper().lower() == c else ''}]{c}{{3,}}" for c in sorted(_pairs) if len(c) == 1) + ")$"
MOST = 200_000


def parse(line: str) -> tuple[str | None, list[str], str | None] | None:
    """(kind, args, name) of a line as ``directives.parse`` has them; args only of directives that set words or dictionaries."""
    low = line.lower()
    if "spell" not in low and "local" not in low:
        return None
    line = re.sub("\r{1,2}$", "", line)
    split = lambda t: [x for x in re.split("[ ,;]", t) if x]
    m = _PREFIX.search(line)
    body = m[1].strip(" ") if m else ""
    name = _NAME.match(body)[0].lower() if body else None
    own = body.lower()
    for kind, pattern, cut in _RULES:
        if pattern.match(own):
            hit = cut.match(body)
            rest = body[hit.end() :] if hit else body
            return kind, split(rest) if kind in ("words", "ignore", "forbid", "dictionaries") else [], name
    m = _LOCAL.search(line)
    words = split(m[1].strip(" ")) if m else []
    return ("local_words", words, name) if words else (None, [], name)


@lru_cache(10_000)
def near_name(name: str) -> str | None:
    """V7: the known name that a directive's unknown one is close to."""
    if name in _LOWER_NAMES or len(name) > 3 + max(map(len, _LOWER_NAMES)):
        return None
    d, _, best = min((directives._levenshtein(name, n.lower()), i, n) for i, n in enumerate(directives.NAMES))
    return best if d <= 3 else None


def states(text: str, config: Config, number) -> tuple[np.ndarray, list[tuple[str, int, int, int, str]]]:
    """For each line ``number(state)``, or -1 if it isn't checked; and (name, offset, line, column, suggestion) of directive typos."""
    lines = text.split("\n")
    found = {k: p for k, line in enumerate(lines) if (p := parse(line)) is not None}
    near = []
    for k, (kind, _, name) in found.items():
        if kind is None and name and (best := near_name(name)) is not None:
            low = lines[k].lower()
            at = low.find(name)
            column = len(low[:at].encode()) + 1 if at >= 0 else 1
            near.append((name, sum(len(x.encode()) + 1 for x in lines[:k]) + column - 1, k + 1, column, best))
    kinds = {k: (kind, args) for k, (kind, args, _) in found.items() if kind is not None}
    gather = lambda *names: frozenset(a.lower() for kind, args in kinds.values() if kind in names for a in args)
    inline, flags = gather("words", "ignore", "local_words"), gather("forbid")
    off, cased, compound, extra = False, config.case_sensitive, config.allow_compound_words, None
    out, at = np.empty(len(lines), np.int32), 0
    for k, (kind, args) in [*sorted(kinds.items()), (len(lines), (None, []))]:
        out[at:k] = -1 if off or at == k else number((compound, cased, extra, inline, flags))
        if k < len(lines):
            out[k] = -1
        at = k + 1
        if kind in ("enable", "disable"):
            off = kind == "disable"
        elif kind in ("enable_case", "disable_case"):
            cased = kind == "enable_case"
        elif kind in ("enable_compound", "disable_compound"):
            compound = kind == "enable_compound"
        elif kind == "dictionaries":
            extra = (extra or _NONE) | {a.lower() for a in args}
    closed = out < 0
    for k, (kind, _) in kinds.items():
        if kind == "disable_next_line":
            k += 1
            while k < len(lines) and (closed[k] or not lines[k].strip(_SPACE)):
                k += 1
            out[k : k + 1] = -1
    return out, near


class Lane:
    """What arrays may settle: simple words beside dictionaries that fold and have no costly forms."""

    def __init__(self, checker: Checker):
        self.c, c = checker, checker.config
        own = checker.lexicons
        self.open = not c.case_sensitive and not any(x.o.case_sensitive or x.o.configured or x.costly for x in own)
        special = {w for x in own for w in (*x.bad, *x.quiet)} | c.flag_words | c.ignore_words
        strings = lambda words: pa.array(sorted(words), pa.string())
        self.special = strings(special)
        self.exact = strings({w for x in checker.default for w in x.exact})
        self.folded = strings({w for x in checker.default for w in (*x.words, *x.loose)})
        self.settled: dict[tuple, tuple] = {}

    def outcome(self, words: pa.Array, marked: set[str]) -> np.ndarray:
        """0: reports nothing, 1: reports itself in a plain state, 2: the checker decides. ``marked``: words that some line's state is about."""
        out = np.full(len(words), 2, np.int8)
        if not self.open or not len(words):
            return out
        low, plain = scan.lowered(words)
        array = lambda x: x.to_numpy(zero_copy_only=False)
        simple = plain & array(pc.match_substring_regex(words, _SIMPLE))
        for own in (self.special, pa.array(sorted(marked), pa.string())):
            if len(own):
                simple &= ~array(pc.or_(pc.is_in(low, value_set=own), pc.is_in(pc.ascii_lower(words), value_set=own)))
        good = array(pc.or_(pc.is_in(words, value_set=self.exact), pc.is_in(low, value_set=self.folded)))
        good |= array(pc.less(pc.utf8_length(words), self.c.config.min_word_length)) | array(pc.match_substring_regex(words, _REPEATED))
        out[simple] = 1
        out[simple & good] = 0
        return out

    def plain(self, state: tuple) -> bool:
        """Whether the state leaves simple words as they are."""
        compound, _, extra, _, _ = state
        return not compound and (extra is None or self.c.active(extra) == self.c.default)

    def parts(self, word: str, code: str | None, escaped: bool, state: tuple) -> tuple:
        """(byte offset, characters before, text, forbidden) of what a word reports; nothing if the code token that it stands in is known as a whole."""
        at = word, code, escaped, state
        got = self.settled.get(at)
        if got is None:
            compound, cased, extra, inline, flags = state
            if code is not None and self.c.code(code, extra, compound, cased, inline):
                got = ()
            else:
                got = tuple((a, len(word.encode()[:a].decode()), p, bad) for a, p, bad in self.c.resolve(word, escaped, extra, compound, cased, inline, flags))
            if len(self.settled) > MOST:
                self.settled.clear()
            self.settled[at] = got
        return got


def _codes(b: scan.Block, breaks: np.ndarray) -> list[str | None]:
    """For each token the code token with digits, hyphens or underscores that it stands in."""
    p = b.points
    start, end = scan._runs(scan.classes()[p], "code")
    special = np.concatenate([[0], np.cumsum((scan.classes()[p] & (scan._DIGIT | scan._UNDERSCORE | scan._HYPHEN)) != 0)])
    marked = special[end] > special[start]
    start, end = start[marked], end[marked]
    out: list[str | None] = [None] * len(b.start)
    if not len(start):
        return out
    k = np.searchsorted(start, b.start, side="right") - 1
    held = np.flatnonzero((k >= 0) & (b.end <= end[k]))
    string = lambda a, z: "".join(map(chr, p[a:z]))
    for t in held.tolist():
        a, z = start[k[t]], end[k[t]]
        if b.start[t] > a and chr(p[b.start[t] - 1]) in "'’":
            # what joins on before a word ends with no apostrophe; the rest counts if it is a code token of the line itself
            own = string(b.start[t], z)
            k_line = int(np.searchsorted(breaks, b.start[t]))
            first = int(breaks[k_line - 1]) + 1 if k_line else 0
            last = int(breaks[k_line]) if k_line < len(breaks) else len(p)
            near = range(int(np.searchsorted(start, first)), int(np.searchsorted(start, last)))
            out[t] = own if any(string(start[j], end[j]) == own for j in near) else None
        else:
            out[t] = string(a, z)
    return out


def _flat(column: pa.Array, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins, ends, counts by text) of the texts' lists of ranges, in the block's bytes."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    both, shift = column.flatten(), np.repeat(begin, n)
    s, e = (both.field(k).to_numpy(zero_copy_only=False) + shift for k in ("s", "e"))
    return s, e, n


def check(raw: list[bytes], checker: Checker, cap: bool, more: pa.Array | None = None, include: pa.Array | None = None) -> tuple[np.ndarray, list[pa.Array]]:
    """The issues of some texts: their texts' numbers, and ``COLUMNS``. ``cap``: keep W5; ``more``, ``include``: further ranges of the texts."""
    config = checker.config
    lane = getattr(checker, "lane", None)
    if lane is None:
        lane = checker.lane = Lane(checker)
    b = scan.Block(raw, "words")
    breaks = np.flatnonzero(b.points == 10)
    ahead = np.searchsorted(breaks, b.own)
    numbers: dict[tuple, int] = {(config.allow_compound_words, config.case_sensitive, None, _NONE, _NONE): 0}
    number = lambda s: numbers.setdefault(s, len(numbers))
    of_line, near = np.zeros(len(breaks) + 1, np.int32), []
    low = b.data.lower()
    places = sorted(skips._places(low, b"spell") + skips._places(low, b"local"))
    for k in np.unique(np.searchsorted(b.begin, np.asarray(places, np.int64), side="right") - 1).tolist():
        own, typos = states(raw[k].decode(errors="replace"), config, number)
        of_line[ahead[k] : ahead[k] + len(own)] = own
        near.extend((k, *t) for t in typos)
    at = b.bytes_of(b.start)
    keep = (of_line[np.searchsorted(breaks, b.start)] >= 0) & ~skips.inside(skips.spans(raw, b.data, b.begin), at)
    if more is not None:
        keep &= ~skips.inside(_flat(more, b.begin)[:2], at)
    if include is not None:
        s, e, n = _flat(include, b.begin)
        keep &= (n[b.text] == 0) | skips.inside((s, e), at)
    b.take(keep)
    every = list(numbers)
    coded = b.words().dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    outcome = lane.outcome(coded.dictionary, {w for s in every for part in s[3:] for w in part})[index]
    b.take(outcome > 0)
    index, outcome = index[outcome > 0], outcome[outcome > 0]
    state = of_line[np.searchsorted(breaks, b.start)]
    plain = np.fromiter(map(lane.plain, every), bool, len(every))
    escaped = (b.start > 0) & (b.points[b.start - 1] == ord("\\")) if len(b.start) else np.zeros(0, bool)
    codes = _codes(b, breaks)
    coded_in = np.fromiter((c is not None for c in codes), bool, len(codes))
    slow = (outcome == 2) | escaped | coded_in | ~plain[state]
    line, offset, column = (x.to_numpy() for x in b.places())
    # issues: those of plain words, then parts that the checker names, then directive typos
    fast = np.flatnonzero(~slow)
    texts, words, rows = coded.dictionary.take(pa.array(index[fast])), [], []
    todo = np.flatnonzero(slow)
    some = np.unique(index[todo])
    held = dict(zip(some.tolist(), coded.dictionary.take(pa.array(some)).to_pylist(), strict=True))
    for t, i, s, x in zip(todo.tolist(), index[todo].tolist(), state[todo].tolist(), escaped[todo].tolist(), strict=True):
        for a, ahead_of, part, bad in lane.parts(held[i], codes[t], x, every[s]):
            words.append(part)
            rows.append((t, a, ahead_of, bad))
    r = np.array(rows, np.int64).reshape(-1, 4)
    t = r[:, 0]
    join = lambda a, b, c, kind: np.concatenate([a, b, np.array(c, np.int64)]).astype(kind)
    text = join(b.text[fast], b.text[t], [x[0] for x in near], np.int64)
    offset = join(offset[fast], offset[t] + r[:, 1], [x[2] for x in near], np.int64)
    line = join(line[fast], line[t], [x[3] for x in near], np.int32)
    column = join(column[fast], column[t] + r[:, 2], [x[4] for x in near], np.int32)
    bad = np.concatenate([np.zeros(len(fast), bool), r[:, 3] == 1, np.zeros(len(near), bool)])
    first = np.concatenate([np.ones(len(fast) + len(t), np.int32), np.zeros(len(near), np.int32)])
    word = pa.concat_arrays([texts, pa.array([*words, *(x[1] for x in near)], pa.string())])
    hint = np.full(len(text), -1, np.int64)
    hint[len(fast) + len(t) :] = np.arange(len(near))
    order = np.lexsort((offset, first, text))
    if cap:
        spelt = word.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[order]
        nth = scan._ranks(text[order] * max(len(word), 1) + spelt + first[order] * max(len(word), 1) * (len(raw) + 1))
        order = order[(nth <= config.max_duplicates) | (first[order] == 0)]
    text, hint = text[order], hint[order]
    suggested = pa.array([[x[5]] for x in near], pa.list_(pa.string())).take(pa.array(hint, mask=hint < 0))
    place = np.arange(len(text)) - np.searchsorted(text, text) + 1
    return text, [word.take(pa.array(order)), pa.array(offset[order]), pa.array(line[order]), pa.array(column[order]), pa.array(bad[order]), suggested, pa.array(first[order]), pa.array(place)]


def issues(docs: DataFrame, make, cap: bool, more: str | None = None, include: str | None = None) -> DataFrame:
    """(doc_id, ``COLUMNS``): the issues of documents (doc_id, text), and directive typos with ``_first`` 0. ``_place``: among the rows of the same document's row.

    ``make``: gives the checker; ``cap``: keep W5 in each row; ``more``, ``include``: columns of further ranges.
    """
    out = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(COLUMNS).fields])

    def run(batches):
        for batch in batches:
            for at, raw in scan.blocks(batch, "text"):
                wide = [None if c is None else batch.column(c).slice(at, len(raw)) for c in (more, include)]
                own, arrays = check(raw, make(), cap, *wide)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(own + at)), *arrays], names=out.names)

    return docs.mapInArrow(run, out)
