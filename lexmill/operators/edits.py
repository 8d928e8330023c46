"""Edits of review decisions, on (path, text) rows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.text import comment_prefix
from lexmill.operators.directives import parse_line


def new_words(words: DataFrame, existing: DataFrame) -> DataFrame:
    """Words that a list doesn't hold yet, in any case; to be appended."""
    return words.withColumn("_k", F.lower("word")).join(existing.select(F.lower(F.trim("word")).alias("_k")), "_k", "left_anti").drop("_k")


def new_typos(pairs: DataFrame, existing: DataFrame) -> DataFrame:
    """(wrong, right) corrections; what is recorded already stays."""
    fresh = pairs.select(F.lower("wrong").alias("wrong"), "right").dropDuplicates(["wrong"])
    return fresh.join(existing.select(F.lower("wrong").alias("wrong")), "wrong", "left_anti")


def replaced(text: str, places: list[tuple[int, int]], old: str, new: str) -> str:
    """The word at (line, byte column) places, if it stands there in any ASCII case; from the last place to the first."""
    raw = text.encode()
    starts = [0, *(m.end() for m in re.finditer(rb"\n", raw))]
    for line, column in sorted(set(places), reverse=True):
        if not 0 < line <= len(starts):
            continue
        a = starts[line - 1] + column - 1
        b = a + len(old.encode())
        if raw[a:b].lower() == old.encode().lower():
            raw = raw[:a] + new.encode() + raw[b:]
    return raw.decode()


def replace_words(files: DataFrame, decisions: DataFrame) -> DataFrame:
    """``files`` (path, text) after ``decisions`` (path, line, column, old, new)."""
    asked = decisions.groupBy("path").agg(F.collect_list(F.struct("line", "column", "old", "new")).alias("asked"))

    @F.pandas_udf(T.StringType())
    def apply(texts: pd.Series, asked: pd.Series) -> pd.Series:
        out = []
        for t, d in zip(texts, asked, strict=True):
            for r in sorted([] if d is None else d, key=lambda r: (r["line"], r["column"]), reverse=True):
                t = replaced(t, [(r["line"], r["column"])], r["old"], r["new"])
            out.append(t)
        return pd.Series(out)

    changed = files.join(asked, "path")
    return changed.select("path", apply("text", "asked").alias("text")).unionByName(files.join(asked, "path", "left_anti").select("path", "text"))


def _lines(text: str = "text"):
    """Lines as of str.splitlines without a last empty one."""
    return F.expr(f"CASE WHEN {text} = '' THEN array() WHEN endswith({text}, '\\n') THEN slice(split({text}, '\\n', -1), 1, size(split({text}, '\\n', -1)) - 1) ELSE split({text}, '\\n', -1) END")


def _text(lines):
    return F.concat(F.array_join(lines, "\n"), F.when(F.col("text").endswith("\n"), "\n").otherwise(""))


def disable_lines(files: DataFrame, places: DataFrame) -> DataFrame:
    """A disable-next-line comment, indented alike, above each line of ``places`` (path, line)."""
    asked = places.groupBy("path").agg(F.collect_set("line").alias("asked"))
    note = F.concat(comment_prefix("path"), F.lit(" spell-checker:disable-next-line"))
    out = files.join(asked, "path").withColumns({"_l": _lines(), "_note": note})
    more = F.flatten(F.transform("_l", lambda x, i: F.when(F.array_contains("asked", i + 1), F.array(F.concat(F.regexp_extract(x, r"^(\s*)", 1), F.col("_note")), x)).otherwise(F.array(x))))
    return out.select("path", _text(more).alias("text"))


_DISABLE = r"(?iu)(?<![\p{L}\p{M}\p{N}_])(?:spell-?checker|c?spell)::?\s*disable(?![A-Za-z0-9_-])"


def disable_files(files: DataFrame) -> DataFrame:
    """A disable comment on top, unless one of the first five lines has one."""
    note = F.concat(comment_prefix("path"), F.lit(" spell-checker:disable"))
    out = files.withColumn("_l", _lines())
    has = F.exists(F.slice("_l", 1, 5), lambda x: x.rlike(_DISABLE))
    return out.select("path", F.when(has, F.col("text")).otherwise(_text(F.concat(F.array(note), F.col("_l")))).alias("text"))


def ignore_in_files(files: DataFrame, words: DataFrame) -> DataFrame:
    """Each word of ``words`` (path, word) joins an ignore directive in the first twenty lines, or a new one on top."""
    asked = words.groupBy("path").agg(F.array_sort(F.collect_set("word")).alias("asked"))

    @F.pandas_udf(T.StringType())
    def apply(texts: pd.Series, prefixes: pd.Series, asked: pd.Series) -> pd.Series:
        return pd.Series([_ignored(t, p, list(a)) for t, p, a in zip(texts, prefixes, asked, strict=True)])

    return files.join(asked, "path").select("path", apply("text", comment_prefix("path"), "asked").alias("text"))


def _ignored(text: str, prefix: str, words: list[str]) -> str:
    lines = text.split("\n")
    end = lines.pop() if text.endswith("\n") or not text else None
    for word in words:
        for k, line in enumerate(lines[:20]):
            found = parse_line(line)
            if found and found[0] == "ignore":
                if word.lower() not in (w.lower() for w in found[1]):
                    lines[k] = f"{line} {word}"
                break
        else:
            lines.insert(0, f"{prefix} spell-checker:ignore {word}")
    return "\n".join(lines) + ("\n" if end is not None and text else "")
