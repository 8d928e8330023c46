"""Word validity over the active dictionaries, for kernels (M10-M31) and the native per-word order (Q1)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from lexmill.functions import chars
from lexmill.operators.dictionary import Lexicon, joins

_ENDING = re.compile(rf"(?is)(.+)[{chars.APOSTROPHES}](?:s|d|t|ll|ve|re|m)")
_CAPS_ENDING = re.compile(rf"[{chars.APOSTROPHES}]?(?:s|ing|ies|es|ings|ize|ed|ning)", re.IGNORECASE)


@dataclass
class Config:
    """What one file's check depends on besides the dictionaries."""

    min_word_length: int = 4
    case_sensitive: bool = False
    flag_words: frozenset[str] = frozenset()
    ignore_words: frozenset[str] = frozenset()
    ignore_patterns: list[str] = field(default_factory=list)
    include_patterns: list[str] = field(default_factory=list)
    late_ignore_patterns: list[str] = field(default_factory=list)
    late_include_patterns: list[str] = field(default_factory=list)
    named_patterns: frozenset[str] = frozenset()
    allow_compound_words: bool = False
    compound_mode: str | None = None
    ignore_random_strings: bool = True
    min_random_length: int = 40
    max_duplicates: int = 5
    max_problems: int = 10_000
    suggestions: bool = False


def possessive_base(word: str) -> str | None:
    """M23."""
    for mark in chars.APOSTROPHES:
        head, found, tail = word.rpartition(mark)
        if found and head and tail.lower() in ("s", "d", "t", "ll", "ve", "re", "m"):
            return head
    return None


def capitals_base(word: str) -> str | None:
    """M24."""
    n = 0
    while n < len(word) and chars.is_upper(word[n]):
        n += 1
    return word[:n] if n > 1 and len(word) > 2 and _CAPS_ENDING.fullmatch(word[n:]) else None


def repeats_one_letter(word: str) -> bool:
    """F23."""
    return len(word) > 3 and len({c.lower()[:1] for c in word}) == 1


class Checker:
    def __init__(self, lexicons: list[Lexicon], config: Config):
        self.lexicons, self.config = lexicons, config
        self.folding = all(not x.o.case_sensitive for x in lexicons)
        self.default = [x for x in lexicons if x.o.active]
        self._valid: dict[tuple, bool] = {}
        self._plain: dict[tuple, str] = {}

    def active(self, extra: frozenset[str] | None) -> list[Lexicon]:
        """The default ones, or with a directive those and the ones it named."""
        if extra is None:
            return self.default
        return [x for x in self.lexicons if not x.o.name or x.o.active or x.o.name in extra]

    def _key(self, word: str) -> str | None:
        return chars.ascii_lower(word) if word.isascii() and not self.config.case_sensitive else None

    def known(self, word: str, extra=None) -> bool:
        """Direct forms of all dictionaries, then the costly ones."""
        key, own = self._key(word), self.active(extra)
        return any(x.has_direct(word, key) for x in own) or any(x.costly and x.has(word, key) for x in own)

    def known_folded(self, word: str, extra=None) -> bool:
        """M11."""
        key, own = (chars.ascii_lower(word) if word.isascii() else word.lower()), self.active(extra)
        return any(x.has_direct(word, key) for x in own) or any(x.costly and x.has(word, key) for x in own)

    def valid(self, word: str, extra=None, compound: bool = False, cased: bool = False) -> bool:
        """M13, M14."""
        at = word, extra, compound, cased
        if at not in self._valid:
            if len(self._valid) > 200_000:
                self._valid.clear()
            self._valid[at] = self._validate(*at)
        return self._valid[at]

    def plain_kind(self, word: str, state: tuple) -> str:
        """For the compatible check, of a word of letters of which the first alone may be a capital: found, repeated, wrong or short; empty for words that take the long way."""
        at = word, state
        if at not in self._plain:
            if len(self._plain) > 200_000:
                self._plain.clear()
            self._plain[at] = self._plain_kind(word, *state)
        return self._plain[at]

    def _plain_kind(self, word: str, extra, compound: bool, cased: bool) -> str:
        c, low = self.config, chars.ascii_lower(word)
        bmp = all(x <= "\uffff" for x in word)
        if not bmp or not word.isalpha() or not word[1:].islower() or not word.lower().strip("e") or not chars.PY_WORDS.fullmatch(word):
            return ""
        if low in c.ignore_words or low in c.flag_words or self.ignored(word, extra, cased) or self.forbidden(word, extra):
            return ""
        if len(word) < c.min_word_length:
            return "short"
        if self.valid(word, extra, compound, cased):
            return "found"
        return "repeated" if repeats_one_letter(word) else "wrong"

    def _validate(self, word, extra, compound, cased) -> bool:
        forms = [word]
        if "’" in word:
            forms.append(word.replace("’", "'"))
        if "\\" in word and word.strip("\\"):
            forms.append(word.replace("\\", ""))
        for w in forms:
            if self.known(w, extra) or not cased and not self.folding and self.known_folded(w, extra):
                return True
        if not compound:
            return False
        return self.compound(word, extra, cased, self.config.compound_mode or "join")

    def compound(self, word: str, extra, cased: bool, mode: str) -> bool:
        """Parts of three bytes or more, from any dictionary (join) or all from one (separate)."""
        size = lambda p: len(p.encode())

        def with_folding(has):
            return lambda p: has(p) or not cased and not self.folding and p.lower() != p and has(p.lower())

        if mode == "join":
            return joins(word, with_folding(lambda p: self.known(p, extra)), 3, size)
        return any(joins(word, with_folding(lambda p, x=x: x.has(p, self._key(p))), 3, size) for x in self.active(extra))

    def ignored(self, word: str, extra=None, cased: bool = False) -> bool:
        """F46, M28."""
        for x in self.active(extra):
            if not x.quiet:
                continue
            if word.isascii() and not self.config.case_sensitive and not x.o.case_sensitive:
                if chars.ascii_lower(word) in x.quiet:
                    return True
            elif x.silent(word) or not cased and (x.o.case_sensitive or word.isascii()) and word.lower() != word and x.silent(word.lower()):
                return True
        return False

    def forbidden(self, word: str, extra=None) -> bool:
        """F47, M29."""
        plain = word.isascii() and not self.config.case_sensitive
        for x in self.active(extra):
            if x.bad and not x.o.ignore_forbidden and (chars.ascii_lower(word) in x.bad if plain and not x.o.case_sensitive and not x.o.configured else x.forbidden(word)):
                return True
        return False

    def flagged(self, word: str, extra, flags: frozenset[str], cased: bool) -> bool:
        low = chars.ascii_lower(word)
        return not self.ignored(word, extra, cased) and (low in self.config.flag_words or low in flags or self.forbidden(word, extra))

    def grouped(self, token: str, extra, compound, cased) -> bool:
        """Underscore segments, at most eight, in any grouping of neighbours that are all valid."""
        parts = token.split("_")
        if len(parts) < 2 or len(parts) > 8:
            return False
        good = [False] * len(parts) + [True]
        for i in reversed(range(len(parts))):
            good[i] = any(good[j] and (not (p := "_".join(parts[i:j])) or self.valid(p, extra, compound, cased)) for j in range(i + 1, len(parts) + 1))
        return good[0] and any(parts)

    def code(self, token: str, extra=None, compound=False, cased=False, inline: frozenset[str] = frozenset()) -> bool:
        """Whether a token with digits, hyphens or underscores is accepted as a whole."""
        return self.valid(token, extra, compound, cased) or token.lower() in inline or self.grouped(token, extra, compound, cased)

    def apostrophes(self, word: str, extra, compound, cased) -> bool:
        """M21."""
        parts = re.split(f"[{chars.APOSTROPHES}]", word)
        return len(parts) > 1 and all(len(p) < self.config.min_word_length or self.valid(p, extra, compound, cased) for p in parts)

    def shifted(self, token: str, parts: list[str], extra, compound, cased) -> bool:
        """Some choice of camel breaks gives parts that are valid or short, and one valid at least."""
        if len(parts) < 2 or any(p.lower() in self.config.flag_words for p in parts):
            return False
        cuts = {0, len(token)}
        for i in range(1, len(token)):
            if chars.is_lower(token[i - 1]) and chars.is_upper(token[i]):
                cuts.add(i)
            if i > 1 and chars.is_upper(token[i - 2]) and chars.is_upper(token[i - 1]) and chars.is_lower(token[i]):
                cuts |= {i - 1, i}
        at = sorted(cuts)
        # best[i]: what a row of good parts from here on can hold: None nothing, False short ones only, True a valid one
        best: list[bool | None] = [None] * (len(at) - 1) + [False]
        for i in reversed(range(len(at) - 1)):
            for j in range(i + 1, len(at)):
                if best[j] is None:
                    continue
                p = token[at[i] : at[j]]
                short = len(p) < self.config.min_word_length
                if short or self.valid(p, extra, compound, cased):
                    best[i] = bool(best[i]) or bool(best[j]) or not short
        return bool(best[0])

    def excused(self, word: str, escaped: bool, extra, compound, cased, flags) -> bool:
        """The fallbacks of an unknown word: M23, M24, M21, M25."""
        least = self.config.min_word_length
        base = possessive_base(word)
        if base is not None and (len(base) < least or self.valid(base, extra, compound, cased)):
            return True
        base = capitals_base(word)
        if base is not None and not self.flagged(base, extra, flags, cased) and (self.valid(base, extra, compound, cased) or len(base) < least):
            return True
        if any(c in word for c in chars.APOSTROPHES) and self.apostrophes(word, extra, compound, cased):
            return True
        if escaped and len(word.encode()) > 1:
            rest = word[1:]
            if rest[:1] in chars.APOSTROPHES:
                rest = rest[1:] if rest else rest
            return self.valid(rest, extra, compound, cased)
        return False

    def resolve(self, token: str, escaped=False, extra=None, compound=False, cased=False, inline: frozenset[str] = frozenset(), flags: frozenset[str] = frozenset()) -> list[tuple[int, str, bool]]:
        """What a token reports: (byte offset, text, forbidden) of its sub-words."""
        low, c = chars.ascii_lower(token), self.config
        ignored = self.ignored(token, extra, cased)
        flagged = self.flagged(token, extra, flags, cased)
        if ignored or not flagged and (low in inline or low in c.ignore_words):
            return []
        parts = chars.camel_parts(token)
        if len(parts) > 1 and not flagged and (self.known(token, extra) or self.shifted(token, parts, extra, compound, cased)):
            return []
        out, at = [], 0
        for k, part in enumerate(parts if len(parts) > 1 else [token]):
            own_low = chars.ascii_lower(part)
            own_ignored = self.ignored(part, extra, cased)
            bad = flagged if len(parts) <= 1 else self.flagged(part, extra, flags, cased)
            if bad and not own_ignored:
                out.append((at, part, True))
            elif not (
                len(part) < c.min_word_length
                or repeats_one_letter(part)
                or own_ignored
                or own_low in inline
                or own_low in c.ignore_words
                or self.valid(part, extra, compound, cased)
                or self.excused(part, escaped and k == 0, extra, compound, cased, flags)
            ):
                out.append((at, part, False))
            at += len(part.encode())
        return out
