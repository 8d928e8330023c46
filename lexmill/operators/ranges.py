"""Byte ranges of a document: those of skip and include patterns, merged, subtracted, tested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.arrays import fenced, let, prefix_maxima, prefix_sums, string

_B, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_C = "[A-Za-z0-9/+]"
#: Name -> (literals of which the text must hold one, Java pattern)
SKIP = {
    "url": (["://"], r'(?iu)(?:https?|ftp)://[^\s"]+'),
    "email": (["@"], rf"(?i){_B}[-A-Za-z0-9_.+]+@[A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+){{1,4}}{_E}|(?i)(?<=[A-Za-z0-9_])[-.+][-A-Za-z0-9_.+]*@[A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+){{1,4}}{_E}"),
    "certificate": (["-----"], r"-{5}BEGIN\s+[A-Za-z0-9_\s]+-{5}[A-Za-z0-9_=+\-/\\\s]+?-{5}END\s+[A-Za-z0-9_\s]+-{5}"),
    "ssh-rsa": (["ssh-rsa"], rf"(?i)ssh-rsa\s+{_C}{{28,}}={{0,3}}"),
    "commit-link": (["["], r"(?i)\[[0-9a-f]{7,}\]"),
    "hex": (["0x"], rf"(?i){_B}0x[0-9a-f_]+n?{_E}"),
    "colour": (["#"], rf"(?i)#[0-9a-f]{{3,8}}{_E}"),
    "sha": (["sha"], rf"(?i){_B}sha[0-9]+-{_C}{{25,}}={{0,3}}"),
    "hash": (["sha", "md5", "base64", "crypt", "security-token", "assertion"], rf"(?i){_B}(?:sha[0-9]+|md5|base64|crypt|bcrypt|scrypt|security-token|assertion)[-,:$=][-A-Za-z0-9_/+%.]{{25,}}={{0,3}}"),
    "unicode": (["u+"], rf"(?i){_B}U\+[0-9a-f]{{4,5}}(?:-[0-9a-f]{{4,5}})?"),
    "binary": (["0b"], rf"(?i){_B}0b[01_]+{_E}"),
    "octal": (["0o"], rf"(?i){_B}0o[0-7_]+{_E}"),
    "commit": ([], rf"{_B}(?=[a-fA-F]*[0-9])[0-9a-fA-F]{{7,}}{_E}"),
    "uuid": (["-"], rf"(?i){_B}[0-9a-fx]{{8}}-[0-9a-fx]{{4}}-[0-9a-fx]{{4}}-[0-9a-fx]{{4}}-[0-9a-fx]{{12}}{_E}"),
    "scientific": (["e"], rf"{_B}(?:[0-9]+\.[0-9]+|(?<!\.)[0-9]+)[eE][+-]?[0-9]+{_E}"),
    "base64-line": ([], rf"(?<![A-Za-z0-9/+_])(?={_C}{{0,79}}[0-9+/])(?={_C}{{0,77}}[A-Z][a-z][A-Z])(?={_C}{{0,77}}(?:[A-Za-z][0-9][A-Za-z]|[0-9][A-Za-z][0-9]))(?={_C}{{0,77}}(?:[a-z]{{3}}|[A-Z]{{3}})){_C}{{40,}}={{0,3}}"),
    "base64-lines": ([], rf"(?m)(?<!{_C})[\"']?{_C}{{40,}}[\"']?(?:\s^\s*[\"']?{_C}{{40,}}[\"']?)+(?:\s^\s*[\"']?{_C}+={{0,3}}[\"']?)?(?![A-Za-z0-9/+=])"),
}
#: Patterns that settings may switch on by name
OPTIONAL = {
    "base64": rf"(?m)(?<!{_C}){_C}{{40,}}(?:\s^\s*{_C}{{40,}})*(?:\s^\s*{_C}+=*)?(?![A-Za-z0-9/+=])",
    "latex-macro-names": r"\\(?:begin|end)?\{?[A-Za-z@]+\*?",
    "latex-macros": r"\\(?!(?:emph|text[a-z]*|caption|footnote|section|subsection|title)\b)[A-Za-z]+\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})?",
    "latex-math": r"(?<!\\)\$[^$]*(?<!\\)\$",
    "ada-apostrophe": r"(?<=[A-Za-z0-9_])'(?=[A-Za-z0-9_])(?!(?:(?<=n')t|ve|d|ll|m|s|re)(?![A-Za-z0-9_]))",
}
RANGE = "array<struct<s:bigint,e:bigint>>"


_SIZED = "array<struct<g:bigint,m:bigint>>"


def _matches(text: str, pattern: str) -> str:
    """SQL: a pattern's matches as sizes in bytes: of the gap before, and of the match."""
    gaps = f"slice(split({text}, {string(pattern)}, -1), 1, size(_k))"
    sized = f"zip_with(_k, {gaps}, (m, x) -> named_struct('g', cast(octet_length(x) AS bigint), 'm', cast(octet_length(m) AS bigint)))"
    return let("_k", f"regexp_extract_all({text}, {string(pattern)}, 0)", f"CASE WHEN size(_k) > 0 THEN {sized} ELSE cast(array() AS {_SIZED}) END")


def pattern_ranges(docs: DataFrame, patterns: dict[str, tuple[list[str], str]], name: str = "ranges", text: str = "text") -> DataFrame:
    """adds merged ranges of all matches. A pattern runs only on texts with one of its literals.

    It is one expression, so that no optimiser rule copies a part of it into a lambda, and what turns matches into
    places stands in it once, over an array of all patterns' matches.
    """
    found = []
    for needs, pattern in patterns.values():
        one = _matches(text, pattern)
        if needs:
            one = f"CASE WHEN {' OR '.join(f'contains(_low, {string(x)})' for x in needs)} THEN {one} ELSE cast(array() AS {_SIZED}) END"
        found.append(one)
    placed = let("_s", prefix_sums("transform(_q, x -> x.g + x.m)"), "transform(_q, (x, i) -> named_struct('s', _s[i] + x.g, 'e', _s[i] + x.g + x.m))")
    both = f"array_sort(flatten(transform(array({', '.join(found)}), _q -> {placed})))" if found else f"cast(array() AS {RANGE})"
    every = F.expr(let("_low", f"lower({text})", f"CASE WHEN {text} IS NULL THEN cast(array() AS {RANGE}) ELSE {merged_sql(both)} END"))
    return fenced(docs.select(*[c for c in docs.columns if c != name], every.alias(name)), name)


def merged_sql(sorted_ranges: str) -> str:
    """F6, SQL: sorted ranges with overlapping and touching ones joined.

    A range begins an island if it begins beyond all ends before it; the island ends at the largest end before the next one.
    """
    begins = "filter(transform(_r, (x, i) -> CASE WHEN i = 0 OR x.s > _m[i] THEN i END), i -> i IS NOT NULL)"
    islands = "transform(_p, (p, k) -> named_struct('s', _r[p].s, 'e', CASE WHEN k + 1 < size(_p) THEN _m[_p[k + 1]] ELSE array_max(transform(_r, x -> x.e)) END))"
    body = let("_m", prefix_maxima("transform(_r, x -> x.e)"), let("_p", begins, islands))
    return let("_r", sorted_ranges, f"CASE WHEN size(_r) = 0 THEN cast(array() AS {RANGE}) ELSE {body} END")


def merge_rows(ranges: DataFrame, *keys: str) -> DataFrame:
    """F6 on rows (keys, s, e), for documents with many ranges: gaps and islands."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("s", "e")
    far = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = ranges.withColumn("_new", F.when(far.isNull() | (F.col("s") > far), 1).otherwise(0))
    out = out.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy(*keys, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island")


def inside(ranges: str, offset: str) -> Column:
    """whether a byte offset is in one of the ranges."""
    return F.expr(f"exists({ranges}, r -> {offset} >= r.s AND {offset} < r.e)")


def subtract(include: str, exclude: str) -> Column:
    """sorted merged ranges without those of ``exclude``."""
    cut = f"""filter({exclude}, x -> x.e > r.s AND x.s < r.e)"""
    edges = f"concat(array(r.s), flatten(transform({cut}, x -> array(x.s, x.e))), array(r.e))"
    pieces = f"transform(sequence(0, size({edges}) div 2 - 1), k -> named_struct('s', {edges}[2 * k], 'e', {edges}[2 * k + 1]))"
    return F.expr(f"filter(flatten(transform({include}, r -> {pieces})), p -> p.s < p.e)").cast(RANGE)
