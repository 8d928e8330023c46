"""Character classes and token patterns, as Java regular expressions and for Python's regex module.

Letters are general categories Lu, Ll, Lt, Lm and Lo; marks are M. Words leave out the scripts that are
written without spaces (Han, kana, Hangul).
"""

from __future__ import annotations

import regex

_SPANS = [(0x1100, 0x11FF), (0x3040, 0x30FF), (0x3130, 0x318F), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF)]
_JAVA = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in _SPANS)
_PY = "".join(f"{chr(a)}-{chr(b)}" for a, b in _SPANS)

#: One word letter
JAVA_LETTER = rf"[\p{{L}}&&[^{_JAVA}]]"
PY_LETTER = rf"(?:(?![{_PY}])\p{{L}})"
APOSTROPHES = "'’"
#: Endings that stay with capitals before them
ENDINGS = "nings|ings|ning|ing|ies|es|ed|s"


def _words(w: str) -> str:
    return rf"{w}\p{{M}}?(?:(?:\\?[{APOSTROPHES}])?{w}\p{{M}}?)*"


def _code(w: str) -> str:
    return rf"(?:{w}|_)\p{{M}}?(?:(?:[{APOSTROPHES}](?={w}))?(?:{w}|[0-9_\-])\p{{M}}?)*"


#: P1
JAVA_WORDS, PY_WORDS = _words(JAVA_LETTER), regex.compile(_words(PY_LETTER))
#: P2
JAVA_CODE, PY_CODE = _code(JAVA_LETTER), regex.compile(_code(PY_LETTER))
#: P3, P4
POSSIBLE = rf"[\p{{L}}0-9_{APOSTROPHES}\x60.+\-](?:[\p{{L}}\p{{M}}0-9_{APOSTROPHES}\x60.+\-]|\\[{APOSTROPHES}])*"
PY_POSSIBLE = regex.compile(POSSIBLE)
NUMERIC = r"^[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$"
PY_NUMERIC = regex.compile(NUMERIC)
#: Where a word is split
CAMEL = rf"(?<=\p{{Ll}})(?=\p{{Lu}})|(?<=\p{{Lu}})(?=\p{{Lu}}\p{{Ll}})(?!\p{{Lu}}(?i:{ENDINGS})(?!\p{{Ll}}))"
PY_CAMEL = regex.compile(CAMEL, flags=regex.V1)

PY_IS_LETTER = regex.compile(r"\p{L}")
PY_IS_UPPER = regex.compile(r"\p{Lu}")
PY_IS_LOWER = regex.compile(r"\p{Ll}")
PY_IS_MARK = regex.compile(r"\p{M}")


def is_letter(c: str) -> bool:
    return bool(c) and PY_IS_LETTER.match(c) is not None


def is_upper(c: str) -> bool:
    return bool(c) and PY_IS_UPPER.match(c) is not None


def is_lower(c: str) -> bool:
    return bool(c) and PY_IS_LOWER.match(c) is not None


def is_mark(c: str) -> bool:
    return bool(c) and PY_IS_MARK.match(c) is not None


def ascii_lower(s: str) -> str:
    return s.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}
UPPER_ASCII, LOWER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def utf16_length(s: str) -> int:
    return len(s.encode("utf-16-le")) // 2


def camel_parts(word: str) -> list[str]:
    """P5: the parts of a camelCase word."""
    return PY_CAMEL.split(word) if word else []
