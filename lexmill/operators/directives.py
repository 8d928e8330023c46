"""In-document settings (V1-V10, W1-W4, W8) as SQL on lines, and the same parser for kernels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: V7: in the order in which ties are settled
NAMES = "disable enable disable-line disable-next-line disable-next ignore ignoreWord ignoreWords ignore-word ignore-words word words forbid forbidWord forbid-word flag flagWord flag-word".split() + [
    f"{a}{b}" for a in ("enable", "disable") for b in ("CompoundWords", "AllowCompoundWords")
] + ["enableCaseSensitive", "disableCaseSensitive", "ignoreRegExp", "includeRegExp", "dictionary", "dictionaries", "language", "locale", "local"]
_PREFIX = r"(?iu)(?<![\p{L}\p{M}\p{N}_])(?:spell-?checker|c?spell)::?([^\n]+)"
_LOCAL = r"(?iu)(?<![\p{L}\p{M}\p{N}_])LocalWords\s*:\s*([^\n]+)"
_END = r"(?![A-Za-z0-9_-])"
_SUFFIX = "(?:-words|-word|words|word)?"
#: (kind, start of the lower-cased text after the prefix)
RULES = [
    ("enable_compound", rf"enable(?:allow)?compoundwords{_END}"),
    ("disable_compound", rf"disable(?:allow)?compoundwords{_END}"),
    ("enable_case", rf"enablecasesensitive{_END}"),
    ("disable_case", rf"disablecasesensitive{_END}"),
    ("enable", rf"enable{_END}"),
    ("disable_next_line", rf"disable-next(?:-line)?{_END}"),
    ("disable_line", rf"disable-line{_END}"),
    ("disable", rf"disable{_END}"),
    ("words", rf"words?{_END}"),
    ("ignore", rf"ignore{_SUFFIX}{_END}"),
    ("forbid", rf"(?:forbid|flag){_SUFFIX}{_END}"),
    ("ignore_regexp", r"ignore_?reg_?exp\s+(?=\S)"),
    ("include_regexp", r"include_?reg_?exp\s+(?=\S)"),
    ("language", rf"(?:locale|local|language){_END}"),
    ("dictionaries", rf"(?:dictionaries|dictionary){_END}"),
]
#: kinds that only set words or patterns for the whole document
LISTS = ("words", "ignore", "local_words", "forbid", "dictionaries", "language")
_FLAGGED = r"^(/.*/[gimuy]*)"
_TOKEN = r"^((?:\\ |\S)+)"


def may_hold(text: Column) -> Column:
    """a cheap test before any pattern."""
    low = F.lower(text)
    return low.contains("spell") | low.contains("local")


def parse(lines: DataFrame) -> DataFrame:
    """V1-V6: adds kind (null without a directive), args, and name (the word after the prefix, for V7)."""
    body = F.trim(F.regexp_extract("line_text", _PREFIX, 1))
    out = lines.withColumn("_b", F.when(may_hold(F.col("line_text")), body).otherwise("")).withColumn("_d", F.lower("_b"))
    kind = F.lit(None).cast("string")
    rest = F.lit(None).cast("string")
    for name, pattern in reversed(RULES):
        hit = F.col("_d").rlike("^" + pattern)
        kind = F.when(hit, name).otherwise(kind)
        rest = F.when(hit, F.regexp_replace("_b", "(?i)^" + pattern, "")).otherwise(rest)
    local = F.trim(F.regexp_extract("line_text", _LOCAL, 1))
    out = out.withColumns({"kind": kind, "_rest": rest, "_local": F.when(may_hold(F.col("line_text")), local).otherwise("")})
    words = lambda c: F.filter(F.split(c, "[ ,;]"), lambda x: x != "")
    is_local = F.col("kind").isNull() & (F.size(words(F.col("_local"))) > 0)
    shown = F.when(F.col("_rest").rlike("^/.*/"), F.regexp_extract("_rest", _FLAGGED, 1)).otherwise(F.regexp_extract("_rest", _TOKEN, 1))
    args = (
        F.when(is_local, words(F.col("_local")))
        .when(F.col("kind").isin("ignore_regexp", "include_regexp"), F.array(shown))
        .when(F.col("kind") == "language", F.filter(F.split("_rest", r"[\s,]+"), lambda x: x != ""))
        .when(F.col("kind").isin("words", "ignore", "forbid", "dictionaries"), words(F.col("_rest")))
        .otherwise(F.array().cast("array<string>"))
    )
    name = F.when(F.col("_b") != "", F.lower(F.regexp_extract("_b", r"^([^\s:]*)", 1)))
    return out.withColumns({"args": args, "name": name, "kind": F.when(is_local, "local_words").otherwise(F.col("kind"))}).drop("_b", "_d", "_rest", "_local")


def typos(parsed: DataFrame) -> DataFrame:
    """V7, V8: lines whose directive has an unknown name close to a known one: adds suggestion; column is in bytes of the lower-cased line."""
    known = F.array(*(F.lit(n) for n in NAMES))
    near = F.transform(known, lambda n, i: F.struct(F.levenshtein(F.col("name"), F.lower(n)).alias("d"), i.alias("i"), n.alias("n")))
    out = parsed.where("kind IS NULL AND name <> ''").withColumn("_best", F.array_min(near))
    out = out.where((F.col("_best.d") <= 3) & ~F.array_contains(F.transform(known, F.lower), F.col("name")))
    at = F.octet_length(F.expr("substring(lower(line_text), 1, instr(lower(line_text), name) - 1)"))
    return out.withColumns({"suggestion": F.col("_best.n"), "column": F.when(F.expr("instr(lower(line_text), name)") > 0, at + 1).otherwise(1)}).drop("_best")


def states(parsed: DataFrame, *keys: str, case_sensitive: bool = False, compound: bool = False) -> DataFrame:
    """Adds checked, case_sensitive, compound, extra (dictionaries named so far, null if none) to each line.

    A line with a directive is never checked. ``disable_next_line`` holds until a line that is not blank, not a
    directive and not disabled; that line is skipped.
    """
    w = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)

    def last(on: str, off: str, default: bool) -> Column:
        flag = F.when(F.col("kind") == on, True).when(F.col("kind") == off, False)
        return F.coalesce(F.last(flag, ignorenulls=True).over(w), F.lit(default))

    out = parsed.withColumns({"_off": last("disable", "enable", False), "case_sensitive": last("enable_case", "disable_case", case_sensitive), "compound": last("enable_compound", "disable_compound", compound)})
    out = out.withColumn("_takes", F.col("kind").isNull() & ~F.col("_off") & (F.trim(F.regexp_replace("line_text", r"\s", "")) != ""))
    out = out.withColumns({"_next": F.max(F.when((F.col("kind") == "disable_next_line") , F.col("line"))).over(before), "_taken": F.max(F.when(F.col("_takes"), F.col("line"))).over(before)})
    skipped = F.coalesce(F.col("_next") > F.coalesce("_taken", F.lit(0)), F.lit(False))
    named = F.flatten(F.collect_list(F.when(F.col("kind") == "dictionaries", F.transform("args", F.lower))).over(w))
    out = out.withColumns({"checked": F.col("kind").isNull() & ~F.col("_off") & ~skipped, "extra": F.when(F.max(F.when(F.col("kind") == "dictionaries", 1)).over(w) == 1, F.array_sort(F.array_distinct(named)))})
    return out.drop("_off", "_takes", "_next", "_taken")


def settings(parsed: DataFrame, *keys: str) -> DataFrame:
    """(keys, inline, flags, ignore_regexps, include_regexps) of documents that set any, wherever they stand."""
    words = parsed.where(F.col("kind").isin("words", "ignore", "local_words", "forbid", "ignore_regexp", "include_regexp")).select(*keys, "kind", F.explode("args").alias("arg"))
    pick = lambda *kinds, f=F.lower: F.array_sort(F.collect_set(F.when(F.col("kind").isin(*kinds), f(F.col("arg")))))
    return words.groupBy(*keys).agg(pick("words", "ignore", "local_words").alias("inline"), pick("forbid").alias("flags"), pick("ignore_regexp", f=lambda x: x).alias("ignore_regexps"), pick("include_regexp", f=lambda x: x).alias("include_regexps"))


def unknown_names(lines: DataFrame) -> DataFrame:
    """V9: (…, word, column) of directive names that are not known, each as an issue."""
    from lexmill.operators.tokens import matches

    found = matches(lines, "line_text", r"(?iu)(?:cspell|spell-?checker)\s*:\s*(\S+)", "_at", "_all")
    name = F.regexp_extract("_all", r"(?iu)^(?:cspell|spell-?checker)\s*:\s*(\S+)$", 1)
    out = found.withColumn("_name", name).where(~F.lower("_name").isin([n.lower() for n in NAMES]))
    return out.select(*lines.columns, F.concat(F.lit("cspell:"), F.col("_name")).alias("word"), (F.col("_at") + F.octet_length("_all") - F.octet_length("_name") + 1).cast("int").alias("column"))


# The same for kernels

_PY = [(kind, re.compile(pattern)) for kind, pattern in RULES]
_PY_PREFIX = re.compile(r"(?i)(?<!\w)(?:spell-?checker|c?spell)::?([^\n]+)")
_PY_LOCAL = re.compile(r"(?i)(?<!\w)LocalWords\s*:\s*([^\n]+)")


def parse_line(line: str) -> tuple[str, list[str]] | None:
    """(kind, args) of a line's directive."""
    low = line.lower()
    if "spell" not in low and "local" not in low:
        return None
    split = lambda t: [x for x in re.split("[ ,;]", t) if x]
    if m := _PY_PREFIX.search(line):
        body = m[1].strip()
        for kind, pattern in _PY:
            if hit := pattern.match(body.lower()):
                rest = body[hit.end() :]
                if kind.endswith("regexp"):
                    shown = re.match(_FLAGGED, rest) if re.match("/.*/", rest) else re.match(_TOKEN, rest)
                    return kind, [shown[1] if shown else ""]
                if kind == "language":
                    return kind, [x for x in re.split(r"[\s,]+", rest) if x]
                return kind, split(rest) if kind in LISTS else []
    if (m := _PY_LOCAL.search(line)) and (words := split(m[1].strip())):
        return "local_words", words
    return None


def near_name(line: str) -> tuple[str, str] | None:
    """V7: (name as found, closest known name)."""
    m = _PY_PREFIX.search(line)
    name = re.split(r"[\s:]", m[1].strip())[0].lower() if m else ""
    if not name or name in {n.lower() for n in NAMES}:
        return None
    d, _, best = min((_levenshtein(name, n.lower()), i, n) for i, n in enumerate(NAMES))
    return (name, best) if d <= 3 else None


def _levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]
