"""The built-in skip patterns on blocks of texts, for kernels.

A pattern runs only on texts that arrays show to hold what it cannot do without, such as a run of 40 characters of base 64.
"""

from __future__ import annotations

import re

import numpy as np

from lexmill.operators import ranges


def _compiled(pattern: str) -> re.Pattern:
    """A Java pattern of ``ranges.SKIP`` for bytes, where case and white space are ASCII too; under its u flag alone, ſ is an s."""
    body = pattern.replace("https?", "http(?:s|\xc5\xbf)?") if "(?iu)" in pattern else pattern
    # Java's ^ follows a line break, but not the first half of one
    body = re.sub(r"\(\?[imu]+\)", "", body).replace(r"\s^", r"(?:\n|\r(?!\n))")
    return re.compile(body.encode("latin-1"), re.I if "(?i" in pattern else 0)


_SKIP = {name: _compiled(pattern) for name, (_, pattern) in ranges.SKIP.items()}


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_DIGITS, _LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGIT, _HEX, _HEX_X = _class(_DIGITS), _class(_DIGITS + "abcdefABCDEF"), _class(_DIGITS + "abcdefxABCDEFX")
_BASE64, _HASHED, _WORD = _class(_DIGITS + _LETTERS + "/+"), _class(_DIGITS + _LETTERS + "-_/+%."), _class(_DIGITS + _LETTERS + "_")


def _long(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of ``least`` or more begin and end."""
    edges = np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    keep = end - start >= least
    return start[keep], end[keep]


def _places(low: bytes, literal: bytes) -> list[int]:
    out, at = [], low.find(literal)
    while at >= 0:
        out.append(at)
        at = low.find(literal, at + 1)
    return out


def spans(raw: list[bytes], data: bytes, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends, in ``data``, of all matches in the texts ``raw``, sorted by begin. ``data``: the texts joined by line breaks, ``begin``: where each begins."""
    c = np.frombuffer(data + b"\n", np.uint8)
    low = data.lower()
    one = lambda x: np.flatnonzero(c == ord(x))
    before = lambda places, kind: places[kind[c[places + 1]]]
    hexes, b64 = _long(_HEX[c], 7), _long(_BASE64[c], 40)[0]
    digit = np.flatnonzero(_DIGIT[c])
    uuid = _long(_HEX_X[c], 8)
    hashed = _long(_HASHED[c], 25)[0]
    zero = digit[c[digit] == ord("0")]
    may = {
        "url": _places(low, b"://"),
        "email": before(one("@"), _WORD),
        "certificate": _places(low, b"-----begin"),
        "ssh-rsa": _places(low, b"ssh-rsa"),
        "commit-link": before(one("["), _HEX),
        "hex": before(zero, _class("xX")),
        "colour": before(one("#"), _HEX),
        "sha": hashed,
        "hash": hashed,
        "unicode": one("+"),
        "binary": before(zero, _class("bB")),
        "octal": before(zero, _class("oO")),
        "commit": hexes[0][np.searchsorted(digit, hexes[1]) > np.searchsorted(digit, hexes[0])],
        "uuid": uuid[0][c[uuid[1]] == ord("-")],
        "scientific": before(digit, _class("eE")),
        "base64-line": b64,
        "base64-lines": b64,
    }
    found: list[tuple[int, int]] = []
    for name, pattern in _SKIP.items():
        places = may[name]
        if len(places):
            for k in np.unique(np.searchsorted(begin, np.asarray(places), side="right") - 1).tolist():
                at = int(begin[k])
                found.extend((at + m.start(), at + m.end()) for m in pattern.finditer(raw[k]))
    found.sort()
    both = np.array(found, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def inside(spans: tuple[np.ndarray, np.ndarray], places: np.ndarray) -> np.ndarray:
    """F5 on sorted spans, which may overlap."""
    s, e = spans
    if not len(s):
        return np.zeros(len(places), bool)
    last = np.searchsorted(s, places, side="right") - 1
    return (last >= 0) & (places < np.maximum.accumulate(e)[last])
