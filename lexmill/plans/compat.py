"""The compatible pipeline (P10-P20, Q2-Q15, W9): one document after the other, because what a document has
shown so far changes later answers. Documents are independent, so partitions run side by side.
"""

from __future__ import annotations

import heapq
from collections import Counter
from itertools import count

import pyarrow as pa
import regex

from lexmill.functions import chars
from lexmill.operators import directives
from lexmill.operators.checker import Checker, capitals_base, repeats_one_letter

ATTEMPTS = 1000
_HEX = regex.compile(r"[0-9A-Fa-f][-0-9A-Fa-f]*[0-9A-Fa-f]")
_TRIVIAL = regex.compile(r"[-.+_'’`\\ \t\r\n0-9eE]*")
_SYMBOLS = "-+_'’`. \t\r\n"
_ESCAPES = "abfnrtvABFNRTV"
_ENDINGS = ("nth", "ning", "ings", "ies", "ing", "ed", "es", "th", "s", "d")
_SHAPE = [(regex.compile(p), r) for p, r in ((r"\d+", "0"), (r"\p{Ll}\p{M}+", "a"), (r"\p{Lu}\p{M}+", "A"), (r"\p{Lu}?\p{Ll}+", "1"), (r"\p{Lu}+", "2"), (r"\p{M}", "4"), ("_", ""), (r"[-_.']+", "3"))]


def is_random(word: str, least: int) -> bool:
    """F21."""
    if 2 * len(word) < least:
        return False
    n = chars.utf16_length(word)
    if n < least:
        return False
    for p, r in _SHAPE:
        word = p.sub(r, word)
    return len(word.encode()) / n >= 0.5


# P10-P20: the splitter. Positions are characters; costs are bytes, as lengths of invalid text.


def plain(word: str) -> bool:
    """Letters, of which the first alone may be a capital: a word without breaks, which is its only camel part."""
    return word.isalpha() and word[1:].islower()


def breaks_of(line: str, lo: int, hi: int) -> list[tuple[int, list]]:
    """(position, choices) of possible breaks, by position; a choice is a gap (from, to) or None to pass."""
    if plain(line[lo:hi]) and not (lo and line[lo - 1] == "\\"):
        return []
    camel, symbols, digits, escapes, extra = [], [], [], [], []
    for k in range(lo, hi - 1):
        if chars.is_lower(line[k]) and chars.is_upper(line[k + 1]):
            camel.append((k, [(k + 1, k + 1), None]))
    for k in range(lo, hi - 2):
        if chars.is_upper(line[k]) and chars.is_upper(line[k + 1]) and chars.is_lower(line[k + 2]):
            camel.append((k, [(k + 1, k + 1), (k + 2, k + 2), None]))
    around = lambda a, b: (a, [(a, b), (a, a), (b, b), None])
    k = lo
    while k < hi:
        c, n = line[k], 1
        if c in _SYMBOLS:
            symbols.append(around(k, k + 1))
        elif c.isascii() and c.isdigit():
            while k + n < hi and line[k + n].isascii() and line[k + n].isdigit():
                n += 1
            digits.append(around(k, k + n))
        elif c in _ESCAPES and k and line[k - 1] == "\\":
            escapes.append(around(k, k + 1))
        k += n
    for k in range(lo, hi):
        if line[k] == "'" and _dangling(line, k, lo):
            extra.append((k, [(k, k + 1), None]))
        if (end := _ending(line, k, hi)) is not None:
            extra.append((k, [(k, end), None]))
    return sorted(camel + symbols + digits + escapes + extra, key=lambda b: b[0])


def _dangling(line: str, at: int, lo: int) -> bool:
    """A quote at the start, after anything but a letter, or after a single letter."""
    if at == lo:
        return True
    word = lambda c: chars.is_letter(c) or chars.is_mark(c)
    return not word(line[at - 1]) or at - 1 == lo or not word(line[at - 2])


def _ending(line: str, at: int, hi: int) -> int | None:
    """P20: where a common ending that starts here ends, after two capitals or more and before no lower-case letter."""
    k, capitals = at, 0
    while k and capitals < 2 and (chars.is_upper(line[k - 1]) or chars.is_mark(line[k - 1])):
        k -= 1
        capitals += chars.is_upper(line[k])
    if capitals < 2:
        return None
    for e in _ENDINGS:
        n = next((len(x) for x in (e, "'" + e, "’" + e) if line.startswith(x, at, hi)), 0)
        if n and not chars.is_lower(line[at + n : at + n + 1]):
            return at + n
    return None


def _size(s: str) -> int:
    return len(s.encode())


def split(line: str, at: int, valid) -> list[tuple[int, str, bool]]:
    """The cheapest split of the possible word at or after ``at``: (position, text, valid).

    Best first by estimated cost, then later start, then newer candidate; at most ``ATTEMPTS`` candidates.
    """
    m = _possible(line, at)
    if m is None:
        return []
    lo, hi = m
    check = lambda a, b: (a, line[a:b], bool(_TRIVIAL.fullmatch(line[a:b])) or valid(line[a:b], a))
    breaks = breaks_of(line, lo, hi)
    if not breaks:
        return [check(lo, hi)]
    breaks.append((hi, [None]))
    byte = [0]
    for c in line[lo:hi]:
        byte.append(byte[-1] + _size(c))
    b = lambda k: byte[k - lo]
    serial = count()
    queue: list = []
    known: dict[int, tuple] = {}  # start -> (cost, segment or None, rest)
    best: tuple | None = None
    limit = byte[-1]

    def add(parent, i: int, k: int, cost: int) -> int:
        while k < len(breaks) and breaks[k][0] < i:
            k += 1
        if k == len(breaks):
            return 0
        for gap in breaks[k][1]:
            ahead = 2 * (byte[-1] - b(i)) if gap is None else b(gap[0]) - b(i) + 2 * (byte[-1] - b(gap[1]))
            n = next(serial)
            heapq.heappush(queue, (2 * cost + ahead, -i, -n, {"parent": parent, "i": i, "k": k, "gap": gap, "cost": cost, "text": None}))
        return len(breaks[k][1])

    def remember(node, rest):
        """Paths from the node back to the start, each kept if no cheaper one starts there."""
        while node is not None:
            text = node["text"]
            cost = (0 if text is None or text[2] else _size(text[1])) + (rest[0] if rest else 0)
            if node["i"] in known and known[node["i"]][0] <= cost:
                return None
            rest = known[node["i"]] = (cost, text, rest)
            node = node["parent"]
        return rest

    add(None, lo, 0, 0)
    tries = 0
    while limit > 0 and queue and tries < ATTEMPTS:
        tries += 1
        node = heapq.heappop(queue)[3]
        if node["cost"] >= limit:
            continue
        path = None
        if node["gap"] is not None:
            start, end = node["gap"]
            text = check(node["i"], start) if start > node["i"] else None
            node["text"] = text
            node["cost"] += 0 if text is None or text[2] else _size(text[1])
            if end in known:
                path = remember(node, known[end])
            elif node["cost"] < limit:
                add(node if text else node["parent"], end, node["k"] + 1, node["cost"])
        elif not add(node["parent"], node["i"], node["k"] + 1, node["cost"]):
            text = check(node["i"], hi) if hi > node["i"] else None
            node["text"] = text
            node["cost"] += 0 if text is None or text[2] else _size(text[1])
            path = remember(node if text else node["parent"], None)
        if path is not None and (best is None or path[0] < best[0]):
            best = path
        if best is not None and best[0] < limit:
            limit = best[0]
    out = []
    while best:
        if best[1] is not None:
            out.append(best[1])
        best = best[2]
    return out


def _possible(line: str, at: int) -> tuple[int, int] | None:
    while m := chars.PY_POSSIBLE.search(line, at):
        if not chars.PY_NUMERIC.match(m[0]):
            return m.start(), m.end()
        at = m.end()
    return None


def possible_words(line: str) -> list[tuple[int, str]]:
    """P3, with positions."""
    return [(m.start(), m[0]) for m in chars.PY_POSSIBLE.finditer(line) if m[0][0] not in "-+.0123456789" or not chars.PY_NUMERIC.match(m[0])]


#: what a settled word is remembered as; nothing changes such an entry, so documents share it
_FOUND = {"ignored": False, "flagged": False, "found": True, "done": True}
_WRONG = {**_FOUND, "found": False}


class Document:
    """The state of one document, line by line."""

    def __init__(self, checker: Checker, inline: frozenset[str], flags: frozenset[str]):
        self.c, self.config = checker, checker.config
        self.inline, self.flags = inline, flags
        self.good: set[str] = set()
        self.seen: dict[str, tuple[int, list]] = {}
        self.info: dict[str, dict] = {}
        self.state: tuple = (None, self.config.allow_compound_words, self.config.case_sensitive)

    def _about(self, word: str) -> dict:
        return self.info.setdefault(word, {})

    def ignored(self, word: str) -> bool:
        """Q8."""
        a = self._about(word)
        if "ignored" not in a:
            a["ignored"] = self.c.ignored(word, self.state[0], self.state[2])
        return a["ignored"]

    def flagged(self, word: str) -> bool:
        """Q7."""
        a = self._about(word)
        if "flagged" not in a:
            low = chars.ascii_lower(word)
            bad = low in self.config.flag_words or low in self.flags or self.c.forbidden(word, self.state[0])
            a["flagged"] = bad and not self.ignored(word)
        return a["flagged"]

    def _own(self, word: str) -> bool:
        """Whether a directive of the document lists the word."""
        return bool(self.inline or self.flags) and ((low := chars.ascii_lower(word)) in self.inline or low in self.flags)

    def accepted(self, word: str) -> bool:
        return (low := chars.ascii_lower(word)) in self.inline or low in self.config.ignore_words

    def valid(self, word: str) -> bool:
        return self.c.valid(word, *self.state)

    def in_dictionary(self, word: str) -> bool:
        """Q10, Q11: without backslashes; a flagged word counts as found."""
        if "\\" in word:
            word = word.replace("\\", "")
        a = self._about(word)
        if "found" in a and a["found"] is not None:
            return a["found"]
        if a.get("flagged"):
            return True
        a["found"] = self.valid(word)
        return a["found"]

    def escaped(self, line: str, at: int, word: str) -> bool:
        """Q9: found, or found without its first character if a backslash stands before it."""
        return self.in_dictionary(word) or at > 0 and line[at - 1] == "\\" and self.in_dictionary(word[1:])

    def check(self, line: str, at: int, word: str) -> tuple[bool, bool | None]:
        """Q12: (flagged, found), remembered."""
        a = self._about(word)
        if not a.get("done"):
            ignored = self.ignored(word)
            flagged = self.flagged(word) and not ignored
            found = False if flagged else ignored or self.escaped(line, at, word)
            a = self._about(word)
            a.update(ignored=ignored, flagged=flagged, found=found, done=True)
        flagged = a["flagged"] and not a["ignored"]
        return flagged, None if flagged else a["found"]

    def capitals(self, word: str) -> bool:
        """Q13."""
        base = capitals_base(word)
        return base is not None and not self.flagged(base) and (self.valid(base) or chars.utf16_length(base) < self.config.min_word_length)

    def short(self, line: str, at: int, word: str) -> bool:
        """short, and between characters that are no letters."""
        n = self.config.min_word_length
        if chars.utf16_length(word) >= 2 * n or len(word) >= n:
            return False
        end = at + len(word)
        return not (at and chars.is_letter(line[at - 1])) and not chars.is_letter(line[end : end + 1])

    def full(self, line: str, at: int, word: str) -> list:
        """Q4."""
        if self.flagged(word):
            return [(at, word, True)]
        if self.capitals(word) or self.accepted(word):
            self.good.add(word)
            return []
        flagged, found = self.check(line, at, word)
        if found:
            self.good.add(word)
            return []
        if flagged:
            return [(at, word, True)]
        out = self.camel(line, at, word)
        if not out:
            self.good.add(word)
        return out

    def camel(self, line: str, at: int, word: str) -> list:
        """Q5."""
        out = []
        for part in chars.camel_parts(word):
            start, at = at, at + len(part)
            if part in self.good:
                continue
            if self.accepted(part):
                self.good.add(part)
                continue
            bad = self.flagged(part)
            if bad:
                out.append((start, part, True))
            elif chars.utf16_length(part) >= self.config.min_word_length:
                if self.check(line, start, part)[1] or repeats_one_letter(part):
                    self.good.add(part)
                else:
                    out.append((start, part, False))
        return out

    def split_valid(self, line: str, at: int, word: str) -> bool:
        """Q6."""
        if word in self.good:
            return True
        if self.flagged(word):
            return False
        return self.accepted(word) or self.ignored(word) or self.escaped(line, at, word) or self.short(line, at, word) or self.capitals(word)

    def possible(self, line: str, lo: int, hi: int, at: int, word: str, base: int) -> list:
        """Q3, Q14: issues (position, text, forbidden) of one possible word; ``base`` is the line's place in the document."""
        if word in self.seen:
            was, issues = self.seen[word]
            return [(p + base + at - was - base, w, f) for p, w, f in issues]
        if word not in self.info and (kind := self.c.plain_kind(word, self.state)) and not (at and line[at - 1] == "\\") and not self._own(word):
            # what the steps below come to for a plain word that neither the document nor the settings single out
            if kind == "short":
                self.info[word] = {"ignored": False, "flagged": False}
                return []
            self.info[word] = _FOUND if kind == "found" else _WRONG
            if kind != "wrong":
                self.good.add(word)
                return []
            self.seen[word] = at, [(at, word, False)]
            return self.seen[word][1]
        for w in (word, word[:-1]) if word.endswith(".") and len(word) > 1 else (word,):
            if self.flagged(w):
                self.seen[word] = at, [(at, w, True)]
                return self.seen[word][1]
        wrong = []
        for m in chars.PY_WORDS.finditer(word):
            w = m[0]
            if w not in self.good and (self.flagged(w) or chars.utf16_length(w) >= self.config.min_word_length):
                wrong += self.full(line, at + m.start(), w)
        if not wrong:
            return []
        hidden = []
        if self.config.ignore_random_strings:
            for m in _HEX.finditer(word):
                h = m[0]
                alone = not (m.start() and chars.is_letter(word[m.start() - 1])) and not chars.is_letter(word[m.end() : m.end() + 1])
                if alone and len(h) >= 8 and h in (h.lower(), h.upper()) and any(c.isdigit() or c == "-" for c in h):
                    hidden.append((at + m.start(), at + m.end()))
        visible = lambda issues: [i for i in issues if i[2] or not any(a <= i[0] < b for a, b in hidden)]
        wrong = visible(wrong)
        if not wrong:
            return []
        segment = line[lo:hi]
        other = []
        for p, w, ok in split(segment, at - lo, lambda t, p: self.split_valid(line, lo + p, t)):
            if ok:
                continue
            b = capitals_base(w)
            if b is not None and not self.flagged(b) and (chars.utf16_length(b) < self.config.min_word_length or self.valid(b)):
                continue
            other.append((lo + p, w, self.flagged(w)))
        other = visible(other)
        chosen = other if len(other) < len(wrong) else wrong
        self.seen[word] = at, chosen
        return chosen

    def line(self, line: str, segments: list[tuple[int, int]], base: int) -> list:
        """Q2: issues of a line's segments."""
        out = []
        for lo, hi in segments:
            for at, word in possible_words(line[lo:hi]):
                if self.config.ignore_random_strings and is_random(word, self.config.min_random_length) or word in self.good:
                    continue
                out += self.possible(line, lo, hi, lo + at, word, base)
        return out


def check_text(text: str, checker: Checker, ranges: list[tuple[int, int]] | None = None) -> list[tuple]:
    """Issues of a document: (word, offset, line, column, forbidden, suggestions), in order, capped by word.

    ``ranges``: the bytes to check (None for all).
    """
    lines = text.split("\n")
    found = {k: d for k, x in enumerate(lines) if (d := directives.parse_line(x.removesuffix("\r")))}
    out: list[tuple] = []
    starts, at = [], 0
    for x in lines:
        starts.append(at)
        at += _size(x) + 1
    for k, x in enumerate(lines):
        low = x.lower()
        if k not in found and ("spell" in low or "local" in low) and (near := directives.near_name(x.removesuffix("\r"))):
            p = low.find(near[0])
            col = _size(low[:p]) + 1 if p >= 0 else 1
            out.append((near[0], starts[k] + col - 1, k + 1, col, False, [near[1]]))
    words = {k: frozenset(w.lower() for d in found.values() if d[0] in kinds for w in d[1]) for k, kinds in {"inline": ("words", "ignore", "local_words"), "flags": ("forbid",)}.items()}
    doc = Document(checker, words["inline"], words["flags"])
    extra: set[str] | None = None
    compound, cased = checker.config.allow_compound_words, checker.config.case_sensitive
    off = skip = False
    counts: Counter = Counter()
    for k, raw in enumerate(lines):
        line = raw.removesuffix("\r")
        if k in found:
            kind, args = found[k]
            off = {"disable": True, "enable": False}.get(kind, off)
            skip = skip or kind == "disable_next_line"
            compound = {"enable_compound": True, "disable_compound": False}.get(kind, compound)
            cased = {"enable_case": True, "disable_case": False}.get(kind, cased)
            if kind == "dictionaries":
                extra = (extra or set()) | {a.lower() for a in args}
            continue
        if off:
            continue
        if skip:
            skip = not line.strip()
            continue
        doc.state = (None if extra is None else frozenset(extra)), compound, cased
        segments = [(0, len(line))] if ranges is None else _within(line, starts[k], ranges)
        ascii, was, size = line.isascii(), 0, 0
        for p, word, forbidden in doc.line(line, [s for s in segments if s[0] < s[1]], starts[k]):
            counts[word] += 1
            if counts[word] <= checker.config.max_duplicates:
                # bytes before p, from the last issue on, so that a line of many issues isn't encoded anew for each
                size = p if ascii else size + _size(line[was:p]) if p >= was else _size(line[:p])
                was = p
                out.append((word, starts[k] + size, k + 1, p + 1, forbidden, []))
    return out


def _within(line: str, start: int, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a line, in characters, that lie in byte ranges of the document."""
    raw = line.encode()
    out = []
    for a, b in ranges:
        a, b = max(a - start, 0), min(b - start, len(raw))
        if a < b:
            lo = len(raw[:a].decode("utf-8", "ignore"))
            out.append((lo, lo + len(raw[a:b].decode("utf-8", "ignore"))))
    return out


ISSUES = [("word", pa.string()), ("offset", pa.int64()), ("line", pa.int32()), ("column", pa.int32()), ("is_forbidden", pa.bool_()), ("suggestions", pa.list_(pa.string()))]


def kernel(make_checker, keys: list[str], ranges: str | None, entries: str | None = None):
    """mapInArrow function: documents (keys, text, ranges) to issue rows. ``make_checker`` gets a document's ``entries``, or None."""

    def run(batches):
        for b in batches:
            at, rows = [], []
            spans = b.column(ranges).to_pylist() if ranges else [None] * b.num_rows
            for k, (text, span) in enumerate(zip(b.column("text").to_pylist(), spans, strict=True)):
                checker = make_checker(b.column(entries)[k].as_py() if entries else None)
                for issue in check_text(text or "", checker, None if span is None else [(r["s"], r["e"]) for r in span]):
                    at.append(k)
                    rows.append(issue)
            cols = list(zip(*rows, strict=True)) or [()] * len(ISSUES)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at, pa.int64())) for c in keys), *(pa.array(c, t) for c, (_, t) in zip(cols, ISSUES, strict=True))], names=[*keys, *(n for n, _ in ISSUES)])

    return run
