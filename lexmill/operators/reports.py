"""Reports and aggregates over issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kind_of(forbidden: str = "is_forbidden") -> Column:
    return F.when(F.col(forbidden), "Forbidden word").otherwise("Unknown word")


def show_suggestions(show_context: bool, asked: bool | None) -> bool:
    """K5: with context only if asked for, else unless declined."""
    return asked is True if show_context else asked is not False


def text_lines(issues: DataFrame, path: str = "path", suggestions: bool = True) -> DataFrame:
    """K1: (value) ``path:line:col - Unknown word (w) fix: (a, b)``."""
    head = F.concat(F.col(path), F.lit(":"), "line", F.lit(":"), "column", F.lit(" - "), kind_of(), F.lit(" ("), "word", F.lit(")"))
    fix = F.when(~F.col("is_forbidden") & (F.size("suggestions") > 0), F.concat(F.lit(" fix: ("), F.array_join("suggestions", ", "), F.lit(")"))).otherwise("") if suggestions else F.lit("")
    return issues.select(path, "line", "column", F.concat(head, fix).alias("value"))


def annotation_lines(issues: DataFrame, path: str = "path") -> DataFrame:
    """K2: (value) workflow annotations."""
    return issues.select(path, "line", "column", F.concat(F.lit("::error file="), F.col(path), F.lit(",line="), "line", F.lit(",col="), "column", F.lit("::"), kind_of(), F.lit(" ("), "word", F.lit(")")).alias("value"))


def words_only(issues: DataFrame) -> DataFrame:
    """K4."""
    return issues.select("word")


def json_files(issues: DataFrame, path: str = "path", diff: DataFrame | None = None) -> DataFrame:
    """K3: (path, json): a file's issues as JSON with keys in alphabetical order; files keep their place even if the diff leaves no issue."""
    shown = in_diff(issues, diff, path) if diff is not None else issues
    item = F.struct("column", F.col("is_forbidden").alias("forbidden"), "line", "offset", "suggestions", "word")
    listed = shown.groupBy(path).agg(F.array_sort(F.collect_list(F.struct("line", "offset", item.alias("i")))).alias("all")).select(path, F.transform("all", lambda x: x["i"]).alias("issues"))
    out = listed if diff is None else issues.select(path).distinct().join(listed, path, "left").withColumn("issues", F.coalesce("issues", F.expr("array()")))
    return json_lines(out, path)


def json_lines(listed: DataFrame, path: str = "path") -> DataFrame:
    """K3: (path, json) of files with the list of their issues (path, issues)."""
    return listed.select(path, F.to_json(F.struct("issues", F.col(path).alias("path"))).alias("json"))


def json_report(issues: DataFrame, path: str = "path") -> DataFrame:
    """(value) the lines of one JSON document: the files with issues in order, then the summary. Rows stay rows, so no task holds the report."""
    files = json_files(issues, path).withColumn("_n", F.lit(1))
    total = summary(issues, path).select(F.lit(None).cast("string").alias(path), F.concat(F.lit('],"summary":'), F.to_json(F.struct("files_with_issues", "total_issues")), F.lit("}")).alias("json"), F.lit(2).alias("_n"))
    first = files.agg(F.min(path).alias("_first"))
    head = first.select(F.lit(None).cast("string").alias(path), F.lit('{"files":[').alias("json"), F.lit(0).alias("_n"))
    files = files.join(F.broadcast(first), F.lit(True)).select(path, F.concat(F.when(F.col(path) == F.col("_first"), "").otherwise(","), "json").alias("json"), "_n")
    return head.unionByName(files).unionByName(total).orderBy("_n", path).select(F.col("json").alias("value"))


def summary(issues: DataFrame, path: str = "path") -> DataFrame:
    """K6, A3: (files_with_issues, total_issues), whatever the diff."""
    return issues.agg(F.count_distinct(path).alias("files_with_issues"), F.count("*").alias("total_issues"))


def totals(issues: DataFrame, path: str = "path") -> DataFrame:
    """A2: (issues, files, words)."""
    return issues.agg(F.count("*").alias("issues"), F.count_distinct(path).alias("files"), F.count_distinct(F.lower("word")).alias("words"))


def by_word(issues: DataFrame, path: str = "path") -> DataFrame:
    """A1: (key, word, occurrences, suggestions) by lower-cased word: first spelling, first suggestions that aren't empty, places in order.

    Places are rows of the aggregate's struct array; for words that occur without bound use ``occurrences``.
    """
    at = F.struct(F.col(path).alias("path"), "line", "column")
    some = F.when(F.size("suggestions") > 0, F.col("suggestions"))
    return issues.groupBy(F.lower("word").alias("key")).agg(
        F.min_by("word", at).alias("word"),
        F.array_sort(F.collect_list(at)).alias("occurrences"),
        F.coalesce(F.min_by(some, F.when(some.isNotNull(), at)), F.array().cast("array<string>")).alias("suggestions"),
    )


def occurrences(issues: DataFrame, path: str = "path", first: str | None = None) -> DataFrame:
    """A1 without lists: (key, word, n, files, first_path, first_line). ``first``: a column that is true for one issue of each file and word, if known; files are then counted without meeting."""
    files = F.count_distinct(path) if first is None else F.count_if(first)
    return _occurrences(issues, path, F.count("*"), files)


def _occurrences(rows: DataFrame, path: str, n: Column, files: Column) -> DataFrame:
    at = F.struct(F.col(path).alias("path"), "line", "column")
    out = rows.groupBy(F.lower("word").alias("key")).agg(F.min_by("word", at).alias("word"), n.alias("n"), files.alias("files"), F.min(at).alias("_at"))
    return out.select("key", "word", "n", "files", F.col("_at.path").alias("first_path"), F.col("_at.line").alias("first_line"))


def occurrences_of(counted: DataFrame, path: str = "path") -> DataFrame:
    """As ``occurrences``, of rows that are the first of several issues and say how many these are (n) and of how many files (files)."""
    return _occurrences(counted, path, F.sum("n"), F.sum("files"))


def first_of_each(issues: DataFrame, path: str = "path") -> DataFrame:
    """One issue for each spelling, by file order, then place."""
    rest = [c for c in issues.columns if c != "word"]
    place = F.struct(F.col(path).alias("a"), F.col("line").alias("b"), F.col("column").alias("c"))
    first = issues.groupBy("word").agg(F.min_by(F.struct(*rest), place).alias("_x"))
    return first.select(*(F.col("word") if c == "word" else F.col(f"_x.{c}").alias(c) for c in issues.columns))


def capped_by_file(issues: DataFrame, most: int, path: str = "path") -> DataFrame:
    """W6."""
    w = Window.partitionBy(path).orderBy("line", "column")
    return issues.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def in_order(issues: DataFrame, path: str = "path") -> DataFrame:
    """L5."""
    return issues.orderBy(path, "offset")


def first_failing(issues: DataFrame, path: str = "path") -> DataFrame:
    """The issues of the first file that has any."""
    first = issues.agg(F.min(path).alias(path))
    return issues.join(first, path, "left_semi")


def in_diff(issues: DataFrame, diff: DataFrame, path: str = "path") -> DataFrame:
    """issues on added lines. ``diff``: path, line."""
    return issues.join(diff.select(F.col("path").alias(path), "line").distinct(), [path, "line"], "left_semi")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(common, only_a, only_b, percent) of two issue sets on (path, line, word)."""
    keys = ["path", "line", "word"]
    return agreement_of(a.select(*keys, F.lit(True).alias("a"), F.lit(False).alias("b")).unionByName(b.select(*keys, F.lit(False).alias("a"), F.lit(True).alias("b"))))


def agreement_of(marked: DataFrame) -> DataFrame:
    """As ``agreement``, of one set (path, line, word, a, b) that says in which of the two an issue is. A null matches nothing."""
    both = marked.groupBy("path", "line", "word").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    whole = F.col("path").isNotNull() & F.col("line").isNotNull() & F.col("word").isNotNull()
    n = both.agg(F.count_if(F.col("a") & F.col("b") & whole).alias("common"), F.count_if(F.col("a") & ~(F.col("b") & whole)).alias("only_a"), F.count_if(F.col("b") & ~(F.col("a") & whole)).alias("only_b"))
    return n.withColumn("percent", F.when(F.col("common") + F.col("only_a") + F.col("only_b") > 0, 100 * F.col("common") / (F.col("common") + F.col("only_a") + F.col("only_b"))).otherwise(100.0))


def by_group(issues: DataFrame, docs: DataFrame, *groups: str) -> DataFrame:
    """Extension: issues and words by document attributes, with subtotals."""
    return by_attributes(issues.join(docs.select("doc_id", *groups), "doc_id"), *groups)


def by_attributes(issues: DataFrame, *groups: str) -> DataFrame:
    """Issues and words by columns of the issues, with subtotals: counted by word first, so that few rows meet in the roll-up."""
    counted = issues.groupBy(*groups, "word").agg(F.count("*").alias("_n"))
    return counted.rollup(*groups).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("issues"), F.count_distinct("word").alias("words"))
