"""A thin command line for spark-submit (C14-C19): check, lint, trace, suggestions, dictionaries, init, migrate, link, add, review."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import api
from lexmill.functions.text import size_in_bytes
from lexmill.operators import reports
from lexmill.plans import config
from lexmill.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lexmill")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("check", "lint"):
        c = sub.add_parser(name)
        c.add_argument("folder")
        c.add_argument("--config")
        c.add_argument("--root", help="folder that settings are searched from")
        c.add_argument("--no-config-search", action="store_true")
        c.add_argument("--no-default-configuration", action="store_true")
        c.add_argument("--format", default="text", choices=["text", "json", "github", "words-only"])
        c.add_argument("--unique", action="store_true")
        c.add_argument("--suggestions", action="store_true")
        c.add_argument("--exclude", action="append", default=[])
        c.add_argument("--type")
        c.add_argument("--diff", help="a unified diff: only issues on added lines")
        c.add_argument("--file-list", help="a file of paths to check")
        c.add_argument("--max-file-size")
        c.add_argument("--dot", action="store_true")
        c.add_argument("--gitignore", action=argparse.BooleanOptionalAction, default=name == "check")
        c.add_argument("--strict", action="store_true")
        c.add_argument("--fail-fast", action="store_true")
        c.add_argument("--stats", action="store_true")
        c.add_argument("--no-issues", action="store_true")
        c.add_argument("--no-summary", action="store_true")
        c.add_argument("--no-exit-code", action="store_true")
        c.add_argument("--show-context", action="store_true")
        c.add_argument("--locale")
        c.add_argument("--language-id")
        c.add_argument("--dictionary", action="append", default=[])
        c.add_argument("--disable-dictionary", action="append", default=[])
        c.add_argument("--cache", help="a Parquet table of clean files, left out and brought up to date")
    for name in ("trace", "suggestions"):
        c = sub.add_parser(name)
        c.add_argument("words", nargs="+")
        c.add_argument("--config")
        c.add_argument("--num-suggestions", type=int, default=8)
    sub.add_parser("dictionaries").add_argument("--config")
    c = sub.add_parser("init")
    c.add_argument("--format", default="json", choices=["json", "yaml"])
    c.add_argument("--locale", default="en")
    c = sub.add_parser("migrate")
    c.add_argument("config")
    c = sub.add_parser("link")
    c.add_argument("action", choices=["add", "remove", "list"])
    c.add_argument("imports", nargs="*")
    c.add_argument("--config", required=True)
    c = sub.add_parser("add")
    c.add_argument("words", nargs="+")
    c.add_argument("--forbidden", action="store_true")
    c.add_argument("--to", default="dict/words.txt")
    c = sub.add_parser("review")
    c.add_argument("folder")
    c.add_argument("decisions", help="a CSV file with word, action, value")
    c.add_argument("--config")
    c.add_argument("--to", required=True, help="folder for the accepted words and changed files")
    return p


def shown(rows: DataFrame) -> None:
    """Rows as tab-separated text, however many."""
    print("\t".join(rows.columns))
    for r in rows.toLocalIterator():
        print("\t".join("" if x is None else ",".join(x) if isinstance(x, list) else str(x) for x in r))


def add_words(path: str, words: list[str], forbidden: bool = False) -> list[str]:
    """Words appended to a word file unless it has them in any case; gives those that are new."""
    have = {w.lower() for w in config.read_words(path)}
    fresh = [f"!{w}" if forbidden else w for w in dict.fromkeys(words) if (f"!{w}" if forbidden else w).lower() not in have]
    if fresh:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "a", encoding="utf-8") as f:
            f.writelines(w + "\n" for w in fresh)
    return fresh


def _write_json(path: str, data: dict) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(data, indent=2, ensure_ascii=False) + "\n")


def without_session(a: argparse.Namespace) -> int | None:
    """Commands on a few driver-side files."""
    if a.command == "init":
        print(config.template(a.format, locale=a.locale), end="")
    elif a.command == "add":
        print("\n".join(add_words(a.to, a.words, a.forbidden)))
    elif a.command == "migrate":
        with open(a.config, encoding="utf-8") as f:
            out, lists = config.migrated(config.parse(a.config, f.read()))
        for name, words in lists.items():
            add_words(os.path.join(os.path.dirname(os.path.abspath(a.config)), name), words)
        _write_json(os.path.splitext(a.config)[0] + ".migrated.json", out)
    elif a.command == "link":
        with open(a.config, encoding="utf-8") as f:
            own = config.parse(a.config, f.read())
        own = config.link(own, a.imports if a.action == "add" else (), a.imports if a.action == "remove" else ())
        if a.action != "list":
            _write_json(a.config, own)
        print("\n".join(own.get("import", [])))
    else:
        return None
    return 0


def with_context(issues: DataFrame, spark: SparkSession) -> DataFrame:
    """Text lines, each followed by the line that it is about."""
    from lexmill.operators import tokens

    found = files.decoded(files.read(spark, issues.agg(F.first("_folder")).first()[0])).select("path", "text")
    lines = tokens.lines(found.join(issues.select("path").distinct(), "path", "left_semi"), "path").select("path", "line", "line_text")
    out = reports.text_lines(issues).join(lines, ["path", "line"], "left")
    return out.withColumn("value", F.concat("value", F.lit(" -- "), F.trim(F.coalesce("line_text", F.lit("")))))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if (done := without_session(a)) is not None:
        return done
    start = getattr(a, "root", None) or getattr(a, "folder", ".")
    path = a.config or (None if getattr(a, "no_config_search", False) else config.find(start))
    settings = config.load(path) if path else {}
    if not getattr(a, "no_default_configuration", False):
        settings = config.with_defaults(settings)
    spark = spark or SparkSession.builder.appName("lexmill").getOrCreate()
    if a.command == "trace":
        shown(api.trace(a.words, spark, settings))
        return 0
    if a.command == "suggestions":
        shown(api.suggestions(a.words, spark, settings, a.num_suggestions).orderBy("word", "rank"))
        return 0
    if a.command == "dictionaries":
        shown(api.list_dictionaries(spark, settings))
        return 0
    if a.command == "review":
        found = api.check_files(spark, a.folder, settings, config=path)
        docs = files.decoded(api.selected_files(spark, a.folder, settings, config=path)).where("text IS NOT NULL").select("path", "text")
        for name, rows in api.review(found, docs, spark.read.csv(a.decisions, header=True).select("word", "action", "value")).items():
            rows.write.mode("overwrite").parquet(f"{a.to}/{name}")
        return 0
    settings["suggestions"] = a.suggestions or a.command == "lint"
    settings["_switched"] = (a.disable_dictionary, a.dictionary)
    if a.locale:
        settings["language"] = a.locale
    if a.language_id:
        settings["languageId"] = a.language_id
    most = size_in_bytes(a.max_file_size) if a.max_file_size else None
    filters = {"exclude": a.exclude, "kind": a.type, "hidden": a.dot, "most": most, "config": path, "listed": files.file_list(spark, a.file_list) if a.file_list else None}
    cache = spark.read.parquet(a.cache) if a.cache and os.path.exists(a.cache) else None
    diff = files.read_diff(spark, a.diff) if a.diff else None
    issues = api.check_files(spark, a.folder, settings, compat=a.command == "lint", unique=a.unique, fail_fast=a.fail_fast, gitignore=a.gitignore, nested=not a.config, diff=diff, cache=cache, **filters).cache()
    lines = {
        "text": lambda: with_context(issues.withColumn("_folder", F.lit(a.folder)), spark) if a.show_context else reports.text_lines(issues),
        "github": lambda: reports.annotation_lines(issues),
        "words-only": lambda: reports.words_only(issues),
        "json": lambda: reports.json_report(issues),
    }[a.format]()
    if not a.no_issues:
        lines = lines.orderBy("path", "line", "column").select("value") if a.format in ("text", "github") else lines
        for r in lines.toLocalIterator():
            print(r[0])
    total = reports.summary(issues).first()
    if a.stats and not a.no_summary:
        checked = api.selected_files(spark, a.folder, settings, gitignore=a.gitignore, **filters).count()
        print(f"{checked} files, {total.files_with_issues} with issues, {total.total_issues} issues")
    if a.cache:
        clean = files.clean_files(api.selected_files(spark, a.folder, settings, gitignore=a.gitignore, **filters), issues)
        clean.write.mode("overwrite").parquet(a.cache)
    return int(bool(total.total_issues) and (a.strict or a.command == "lint") and not a.no_exit_code)


if __name__ == "__main__":
    raise SystemExit(main())
