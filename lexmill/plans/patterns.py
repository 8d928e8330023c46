"""Regular expressions of settings and directives, translated for Java before a plan is built."""

from __future__ import annotations

import re

import regex


def slash_parts(value: str) -> tuple[str, str] | None:
    """(pattern, flags) of ``/pattern/flags``."""
    v = value.strip()
    end = v.rfind("/")
    return (v[1:end], v[end + 1 :]) if v.startswith("/") and end > 0 else None


def without_blanks(pattern: str) -> str:
    """Verbose mode: unescaped blanks and comments go."""
    return re.sub(r"(\\.)|#[^\n]*(?:\n|$)|\s", lambda m: m[1] or "", pattern, flags=re.S)


def plain(value: str) -> str:
    """A directive's pattern: flags i, m, s and x count, others don't; no flags by default."""
    parts = slash_parts(value)
    if parts is None:
        return value.strip()
    body, flags = parts
    kept = "".join(f for f in "ims" if f in flags)
    return (f"(?{kept})" if kept else "") + (without_blanks(body) if "x" in flags else body)


def _group_end(p: str, start: int) -> int | None:
    """Where the group that is open at ``start`` closes."""
    depth, inside, k = 1, False, start
    while k < len(p):
        c = p[k]
        if c == "\\":
            k += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return k
        k += 1
    return None


def _flags_end(p: str) -> int:
    m = re.match(r"(?:\(\?[imsxuU-]+\))*", p)
    return m.end()


def consuming(pattern: str) -> str:
    """A leading look-behind and trailing look-aheads become part of the match."""
    at = _flags_end(pattern)
    if pattern.startswith("(?<=", at) and (end := _group_end(pattern, at + 4)) is not None:
        pattern = pattern[:at] + pattern[at + 4 : end] + pattern[end + 1 :]
    while (k := pattern.rfind("(?=", at)) >= 0 and _group_end(pattern, k + 3) == len(pattern) - 1:
        pattern = f"{pattern[:k]}(?:{pattern[k + 3 : -1]})"
    return pattern


def ascii_classes(pattern: str) -> str:
    r"""X14: \w, \d and \b mean ASCII."""
    out, inside, k = "", False, 0
    names = {"w": "A-Za-z0-9_", "d": "0-9"}
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            n = pattern[k + 1]
            if n in names:
                out += names[n] if inside else f"[{names[n]}]"
            elif n in "WD" and not inside:
                out += f"[^{names[n.lower()]}]"
            elif n == "b" and not inside:
                out += "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
            elif n == "B" and not inside:
                out += "(?:(?<![A-Za-z0-9_])(?![A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?=[A-Za-z0-9_]))"
            else:
                out += c + n
            k += 2
            continue
        inside = (c != "]") if inside else c == "["
        out += c
        k += 1
    return out


def has_lookaround(pattern: str) -> bool:
    return re.search(r"\(\?(?:<[=!]|[=!])", re.sub(r"\\.|\[(?:\\.|[^\]])*\]", "", pattern)) is not None


def has_backreference(pattern: str) -> bool:
    return re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern) is not None


def _captures(pattern: str) -> list[tuple[str, bool]]:
    """(text, optional) of the capturing groups in the order in which they close."""
    found, stack, inside, k = [], [], False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "(":
            stack.append((k + 1, not pattern.startswith("?", k + 1)))
        elif c == ")" and stack:
            start, own = stack.pop()
            if own:
                found.append((pattern[start:k], pattern[k + 1 : k + 2] in ("?", "*")))
        k += 1
    return found


def _compiles(pattern: str) -> bool:
    try:
        regex.compile(pattern)
        return True
    except regex.error:
        return False


def setting(value: str) -> tuple[str, bool] | None:
    """(Java pattern, whether it runs only on issues) of a pattern from settings; None if it can't be used.

    Bare patterns ignore case and match at lines. A pattern left with a look-around is dropped, unless a required
    back-reference sends it to the late, backtracking pass. A back-reference to an optional group is spelt out both ways.
    """
    parts = slash_parts(value)
    p = plain(value) if parts else f"(?im){value.strip()}"
    p = consuming(p)
    if has_backreference(p):
        groups = _captures(p)
        numbers = [int(n) for n in re.findall(r"\\([1-9])", p)]
        if any(n > len(groups) or not groups[n - 1][1] for n in numbers):
            p = ascii_classes(p)
            return (p, True) if _compiles(p) else None
        if len(groups) == 1 and (m := re.search(r"\((?!\?)", p)):
            end = _group_end(p, m.end())
            head, body, tail = p[: m.start()], p[m.end() : end], p[end + 2 :]
            p = f"(?:{head}(?:{body})" + tail.replace(r"\1", f"(?:{body})") + f"|{head}" + tail.replace(r"\1", "") + ")"
        else:
            p = re.sub(r"\\([1-9])", lambda n: f"(?:{groups[int(n[1]) - 1][0]})?", p)
    if has_lookaround(p):
        return None
    p = ascii_classes(p)
    return (p, False) if _compiles(p) else None


def directive(value: str) -> str | None:
    """Java pattern of a directive; those with look-arounds or back-references are dropped. Classes are Unicode."""
    p = plain(value)
    if has_lookaround(p) or has_backreference(p) or not _compiles(p):
        return None
    return "(?U)" + p


#: Names under which settings may ask for a special pattern of ranges.OPTIONAL
SPECIAL = {"Base64": "base64", "HashStrings": "hash", "ada-word-break": "ada-apostrophe", "latex-macro-names": "latex-macro-names", "latex-macros": "latex-macros", "latex-math": "latex-math"}


def resolve(tokens: list[str], defined: dict[str, str | list[str]]) -> tuple[list[str], list[str], set[str]]:
    """(patterns, late patterns, special names) of a list of names and patterns; names resolve without cycles."""
    by = {k.lower(): v for k, v in defined.items()}
    now: list[str] = []
    late: list[str] = []
    special: set[str] = set()

    def add(token: str, open_names: frozenset[str]) -> None:
        name = token.lower()
        if name in by and name not in open_names:
            value = by[name]
            for v in [value] if isinstance(value, str) else value:
                add(v, open_names | {name})
        elif token in SPECIAL:
            special.add(SPECIAL[token])
        elif (got := setting(token)) is not None:
            (late if got[1] else now).append(got[0])

    for t in tokens:
        add(t, frozenset())
    return now, late, special
