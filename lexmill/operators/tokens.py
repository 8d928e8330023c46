"""Lines, tokens and sub-words with byte offsets and code-point columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import chars
from lexmill.functions.arrays import prefix_sums

PATTERNS = {"words": chars.JAVA_WORDS, "code": chars.JAVA_CODE, "possible": chars.POSSIBLE}


def lines(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, line, line_text, line_offset): 1-based lines; one trailing carriage return goes; a text ends with a line, perhaps an empty one."""
    out = docs.select(*keys, F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("_l"))
    out = out.withColumn("_n", F.expr("transform(_l, x -> cast(octet_length(x) + 1 AS bigint))"))
    out = out.withColumn("_o", F.expr(prefix_sums("_n")))
    out = out.select(*keys, F.posexplode(F.arrays_zip("_l", "_o")).alias("_p", "_z"))
    return out.select(*keys, (F.col("_p") + 1).alias("line"), F.regexp_replace("_z._l", "\r$", "").alias("line_text"), F.col("_z._o").cast("bigint").alias("line_offset"))


def matches(df: DataFrame, text: str, pattern: str, start: str, value: str) -> DataFrame:
    """A row for each match of ``pattern`` in ``text``: ``start`` (bytes), ``value``, and ``before``, the text up to the match since the last one."""
    keep = df.columns
    out = df.withColumn("_k", F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    out = out.withColumn("_g", F.split(F.col(text), pattern, -1))
    out = out.withColumn("_n", F.expr("transform(_k, (m, i) -> cast(octet_length(_g[i]) + octet_length(m) AS bigint))"))
    out = out.withColumn("_s", F.expr(prefix_sums("_n")))
    out = out.select(*keep, F.explode(F.expr("transform(_k, (m, i) -> named_struct('s', _s[i] + octet_length(_g[i]), 'v', m, 'b', _g[i]))")).alias("_m"))
    return out.select(*keep, F.col("_m.s").cast("bigint").alias(start), F.col("_m.v").alias(value), F.col("_m.b").alias("before"))


def column_of(line_text: str, offset: str):
    """1-based code-point column of a byte offset within its line."""
    return F.length(F.expr(f"cast(substring(cast({line_text} AS binary), 1, cast({offset} AS int)) AS string)")) + 1


def tokens(docs: DataFrame, *keys: str, kind: str = "words", text: str = "text") -> DataFrame:
    """(keys, line, line_text, line_offset, offset, column, word, previous): tokens with byte offsets in the document.

    ``previous`` is the character before the token in its line, or empty.
    """
    found = matches(lines(docs, *keys, text=text), "line_text", PATTERNS[kind], "in_line", "word")
    if kind == "possible":
        found = found.where(~F.col("word").rlike(chars.NUMERIC))
    out = found.withColumns({"offset": F.col("line_offset") + F.col("in_line"), "column": column_of("line_text", "in_line"), "previous": F.when(F.col("before") != "", F.expr("right(before, 1)")).otherwise(F.when(F.col("in_line") > 0, F.expr("right(cast(substring(cast(line_text AS binary), 1, cast(in_line AS int)) AS string), 1)")).otherwise(""))})
    return out.drop("before")


def sub_words(found: DataFrame) -> DataFrame:
    """Tokens exploded into camelCase parts: adds part (text), part_offset, part_no, parts."""
    out = found.withColumn("_p", F.split("word", chars.CAMEL, -1))
    out = out.withColumn("_s", F.expr(prefix_sums("transform(_p, x -> cast(octet_length(x) AS bigint))")))
    out = out.withColumn("parts", F.size("_p"))
    out = out.select(*found.columns, "parts", F.posexplode(F.arrays_zip("_p", "_s")).alias("part_no", "_z"))
    return out.select(*found.columns, "parts", "part_no", F.col("_z._p").alias("part"), (F.col("offset") + F.col("_z._s")).alias("part_offset"))
