"""Globs of settings and ignore files as Java regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str, slash_stops_star: bool = True) -> str:
    """A regular expression for whole paths. ``*`` and ``?`` stop at slashes (or not), ``**`` doesn't; braces are choices, brackets classes."""
    star, one = ("[^/]*", "[^/]") if slash_stops_star else (".*", ".")
    out, k, depth = "", 0, 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**", k):
            before, after = k == 0 or glob[k - 1] == "/", glob[k + 2 : k + 3]
            if before and after == "/":
                out += "(?:.*/)?"
                k += 3
            else:
                out += ".*" if before and not after else star
                k += 2
            continue
        if c == "*":
            out += star
        elif c == "?":
            out += one
        elif c == "[" and "]" in glob[k + 2 :]:
            end = glob.index("]", k + 2)
            body = glob[k + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            k = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and k + 1 < len(glob):
            k += 1
            out += re.escape(glob[k])
        else:
            out += re.escape(c)
        k += 1
    return f"^{out}$"


def nested(pattern: str) -> list[str]:
    """A name matches at any depth and below; a path, itself and below."""
    bang, p = ("!", pattern[1:]) if pattern.startswith("!") else ("", pattern)
    if not p:
        return []
    if "/" not in p:
        return [f"{bang}**"] if p == "**" else [f"{bang}**/{p}", f"{bang}**/{p}/**"]
    rooted = p.startswith("/")
    p = p.removeprefix("/")
    if p.endswith("/"):
        return [f"{bang}{p}**/*"] if rooted or "/" in p[:-1] else [f"{bang}**/{p}**/*"]
    return [f"{bang}{p}"] if p.endswith("**") else [f"{bang}{p}", f"{bang}{p}/**"]


def extglobs(pattern: str) -> list[str]:
    """``a!(b|c)d`` is ``a*d`` without ``abd`` and ``acd``."""
    m = re.search(r"!\(([^)]*)\)", pattern)
    if not m:
        return [pattern]
    head, tail = pattern[: m.start()], pattern[m.end() :]
    return [f"{head}*{tail}", *(f"!{head}{x}{tail}" for x in m[1].split("|"))]


def ignore_regexes(patterns: list[str]) -> tuple[list[str], list[str]]:
    """(ignoring, re-including) regular expressions of ignore patterns."""
    take, back = [], []
    for p in patterns:
        for e in extglobs(p):
            for n in nested(e):
                (back if n.startswith("!") else take).append(glob_regex(n.removeprefix("!")))
    return take, back


def matches_any(path: Column, regexes: list[str]) -> Column:
    return F.lit(False) if not regexes else path.rlike("|".join(f"(?:{r})" for r in regexes))


def ignored(path: Column, patterns: list[str]) -> Column:
    """whether ignore patterns take a path, and none takes it back."""
    take, back = ignore_regexes(patterns)
    return matches_any(path, take) & ~matches_any(path, back)


def ignored_below(path: Column, root: str, patterns: list[str]) -> Column:
    """patterns of an ignore file apply to paths below its folder, relative to it."""
    root = root.rstrip("/")
    rest = F.substring(path, F.lit(len(root) + 2), F.length(path))
    return path.startswith(f"{root}/") & ignored(rest, patterns)


def git_ignored(path: Column, files: dict[str, list[str]]) -> Column:
    """ignored by any level; a deeper file can't take back what a higher one ignores."""
    out = F.lit(False)
    for root, lines in files.items():
        kept = [x for x in lines if x and not x.startswith("#")]
        if kept:
            out = out | ignored_below(path, root, kept)
    return out


def override_matches(path: Column, globs: list[str]) -> Column:
    """some positive glob matches, and no negative one."""
    yes, no = [], []
    for g in globs:
        while g.startswith("!!"):
            g = g[2:]
        for n in nested(g.removeprefix("!")):
            (no if g.startswith("!") else yes).append(glob_regex(n, slash_stops_star=False))
    return matches_any(path, yes) & ~matches_any(path, no)


def split_base(path: str) -> tuple[str, str] | None:
    """(folder, glob) of a path with a glob in it."""
    parts = path.split("/")
    k = next((k for k, x in enumerate(parts) if any(c in x for c in "*?[{")), None)
    return None if k is None else ("/".join(parts[:k]), "/".join(parts[k:]))
