"""One function a command, each giving a DataFrame (2.16, 2.17, Q18-Q20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lexmill.functions import chars
from lexmill.operators import edits, lookup, reports, suggest
from lexmill.operators.dictionary import Options, from_words, rep_pairs
from lexmill.plans import config as settings_
from lexmill.plans.native import check_compat, check_native, config_from
from lexmill.sources import dictionaries, files


def catalogue(spark: SparkSession, settings: dict) -> tuple[DataFrame, list[Options]]:
    """Dictionary rows and options of settings; the first definition of a name wins; words form a dictionary that is always active."""
    rows, options, seen = None, [], set()
    active = settings_.active_dictionaries(settings, [d["name"] for d in settings.get("dictionaryDefinitions", [])], *settings.get("_switched", ((), ())))
    for d in settings.get("dictionaryDefinitions", []):
        if d["name"].lower() in seen:
            continue
        seen.add(d["name"].lower())
        own = dictionaries.load(spark, d["path"], d["name"], d.get("type")) if d.get("path") else from_words(spark, d["name"], [*d.get("words", []), *(f"!{w}" for w in d.get("flagWords", [])), *d.get("suggestWords", [])])
        rows = own if rows is None else rows.unionByName(own)
        options.append(Options(d["name"], d["name"] in active, ignore_forbidden=d.get("ignoreForbiddenWords", False), use_compounds=d.get("useCompounds", False), rep_map=rep_pairs(d.get("repMap", [])), configured=bool(d.get("ignoreForbiddenWords") or d.get("useCompounds"))))
    words = [*settings.get("words", []), *settings.get("userWords", [])]
    if words or rows is None:
        own = from_words(spark, "inline", words)
        rows = own if rows is None else rows.unionByName(own)
        options.append(Options("inline"))
    return rows, options


def check(docs: DataFrame, settings: dict, *, compat: bool = False, typos: DataFrame | None = None, dictionary: tuple[DataFrame, list[Options]] | None = None) -> DataFrame:
    """Q18: issues of documents (doc_id, text). ``dictionary``: rows and options, else those of the settings."""
    rows, options = dictionary or catalogue(docs.sparkSession, settings)
    run = check_compat if compat else check_native
    return run(docs, rows, options, config_from(settings), typos)


def check_files(spark: SparkSession, folder: str, settings: dict, *, compat: bool = False, typos: DataFrame | None = None, diff: DataFrame | None = None, unique: bool = False, fail_fast: bool = False, gitignore: bool = True, nested: bool = False, cache: DataFrame | None = None, **filters) -> DataFrame:
    """(path, issue columns) of the text files below a folder. Paths with equal effective settings are checked together.

    ``gitignore``: leave out what ignore files say and attribute files mark as vendored or generated. ``nested``: files
    below a folder with settings of its own use those instead. ``cache``: clean files (path, modified, size) to leave out.
    """
    found = selected_files(spark, folder, settings, gitignore=gitignore, **filters)
    if cache is not None:
        found = files.to_check(found, cache)
    found = files.decoded(found).where("text IS NOT NULL").select(F.col("path").alias("doc_id"), "text")
    own_settings = {"": settings}
    if nested:
        for path in sorted(files.marker_files(spark, folder, "{" + ",".join(settings_.NAMES) + "}", _depth(spark, folder))):
            where = path.rpartition("/")[0]
            if where != folder.rstrip("/") and where not in own_settings and (own := settings_.find(where, (where,))):
                own_settings[where] = settings_.with_defaults(settings_.load(own))
                found = found.where(F.col("doc_id") != own)
    place = F.lit("")
    for where in sorted(own_settings, key=len)[1:]:  # the deepest folder wins
        place = F.when(F.col("doc_id").startswith(f"{where}/"), F.lit(where)).otherwise(place)
    found = found.withColumn("_place", place)
    # settings depend on a path only through its folder, its languages and the overrides: one check for each kind of path
    p = F.col("doc_id")
    kind = F.concat_ws("\n", "_place", files.extension(p), F.array_join(files.languages(p), ","), *(globs_key(o, "doc_id") for own in own_settings.values() for o in own.get("overrides", [])))
    found = found.withColumn("_kind", kind)
    groups: dict[str, tuple[dict, list[str]]] = {}
    for r in found.groupBy("_place", "_kind").agg(F.min("doc_id").alias("path")).collect():
        own = settings_.for_path(own_settings[r["_place"]], r.path)
        if own.get("enabled") is not False:
            groups.setdefault(repr(sorted(own.items(), key=lambda kv: kv[0])), (own, []))[1].append(r["_kind"])
    out = None
    for own, kinds in groups.values():
        issues = check(found.where(F.col("_kind").isin(kinds)).select("doc_id", "text"), own, compat=compat, typos=typos)
        out = issues if out is None else out.unionByName(issues)
    if out is None:
        out = check(found.where("false").select("doc_id", "text"), settings, compat=compat)
    out = out.withColumnRenamed("doc_id", "path")
    if diff is not None:
        relative = F.when(F.col("path").startswith(folder.rstrip("/") + "/"), F.substring("path", F.lit(len(folder.rstrip("/")) + 2), F.length("path"))).otherwise(F.col("path"))
        out = reports.in_diff(out.withColumn("_p", relative), diff, "_p").drop("_p")
    out = reports.first_of_each(out) if unique else out
    return reports.first_failing(out) if fail_fast else out


def _depth(spark: SparkSession, folder: str) -> int:
    """How many levels of folders a folder has."""
    most = files.read(spark, folder).agg(F.max(F.size(F.split("path", "/")))).first()[0]
    return max(0, (most or 0) - len(folder.rstrip("/").split("/")) - 1)


def selected_files(spark: SparkSession, folder: str, settings: dict, *, gitignore: bool = True, **filters) -> DataFrame:
    """The files below a folder that a check reads, with their content."""
    if gitignore:
        rules = files.marker_files(spark, folder, ".gitignore", _depth(spark, folder), above=True)
        filters["gitignore"] = {where: [x.rstrip() for x in text.splitlines()] for where, text in rules.items()}
        marked = files.marker_files(spark, folder, ".gitattributes", 0)
        filters["vendored"] = [g for text in marked.values() for g in files.vendored_globs(text.splitlines())]
    return files.selected(files.read(spark, folder), ignore=settings.get("ignorePaths", []), root=folder, **filters)


def globs_key(override: dict, path: str = "path"):
    from lexmill.plans import globs

    names = override.get("filename", [])
    names = [n if isinstance(n, str) else n["glob"] for n in ([names] if isinstance(names, (str, dict)) else names)]
    return F.when(globs.override_matches(F.col(path), names), "1").otherwise("0")


def trace(words: list[str], spark: SparkSession, settings: dict) -> DataFrame:
    """K7, K8."""
    rows, options = catalogue(spark, settings)
    dicts = spark.createDataFrame([(o.name,) for o in options], "dict string")
    return lookup.trace(spark.createDataFrame([(w,) for w in words], "word string"), rows, dicts)


def suggestions(words: list[str], spark: SparkSession, settings: dict, limit: int = 8) -> DataFrame:
    """K9, G4."""
    rows, _ = catalogue(spark, settings)
    return suggest.for_command(spark.createDataFrame([(w,) for w in words], "word string"), rows, limit)


def list_dictionaries(spark: SparkSession, settings: dict) -> DataFrame:
    """(name, path, active)."""
    named = [d["name"] for d in settings.get("dictionaryDefinitions", [])]
    active = settings_.active_dictionaries(settings, named, *settings.get("_switched", ((), ())))
    return spark.createDataFrame([(d["name"], d.get("path"), d["name"] in active) for d in settings.get("dictionaryDefinitions", [])], "name string, path string, active boolean")


def review(found: DataFrame, docs: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """Q20: what decisions (word, action, value) on issues (path, word, line, column) change: accepted words, and files (path, text).

    Actions: accept, ignore, fix (value: the new word), disable_line, disable_file.
    """
    hit = found.join(decisions.withColumn("_k", F.lower("word")).drop("word"), F.lower(found.word) == F.col("_k"))
    by = lambda a: hit.where(F.col("action") == a)
    changed = edits.replace_words(docs, by("fix").select("path", "line", "column", F.col("word").alias("old"), F.col("value").alias("new")))
    lined = edits.disable_lines(changed, by("disable_line").select("path", "line"))
    return {
        "accepted": by("accept").select(F.lower("word").alias("word")).distinct(),
        "fixed": changed,
        "line_disabled": lined,
        "file_disabled": edits.disable_files(changed.join(by("disable_file").select("path").distinct(), "path", "left_semi")),
        "ignored": edits.ignore_in_files(changed, by("ignore").select("path", "word")),
    }


class SpellCheck:
    """``spell_check(text)``: the issues of a text under fixed settings (2.16)."""

    def __init__(self):
        self.checker = None

    def eval(self, text: str):
        from lexmill.operators.checker import Checker
        from lexmill.operators.dictionary import lexicons
        from lexmill.plans import compat

        if self.checker is None:
            self.checker = Checker(lexicons(self.rows, self.options), self.config)
        for word, offset, line, column, forbidden, suggestions in compat.check_text(text or "", self.checker):
            yield word, offset, line, column, forbidden, list(suggestions)


def spell_check(spark: SparkSession, settings: dict):
    """2.16: the table function ``spell_check(text)`` for the settings' dictionaries, which travel with it; for dictionaries that may be broadcast."""
    from lexmill.plans import native

    entries, options = catalogue(spark, settings)
    rows = native._dictionary(entries)
    if rows is None:
        raise ValueError("the dictionaries are too large to travel with a function; use check")
    own = type("SpellCheck", (SpellCheck,), {"rows": rows, "options": options, "config": config_from(settings)})
    return udtf(own, returnType="word string, offset long, line int, column int, is_forbidden boolean, suggestions array<string>")


@udtf(returnType="offset int, word string")
class SpellTokens:
    """``spell_tokens(text)``: word tokens with byte offsets."""

    def eval(self, text: str):
        for m in chars.PY_WORDS.finditer(text or ""):
            yield len(text[: m.start()].encode()), m[0]


def register(spark: SparkSession, settings: dict | None = None) -> None:
    """2.16: functions for SQL; ``spell_check`` only with settings."""
    from lexmill.functions import distance

    spark.udf.register("osa_distance", distance.osa_distance)
    spark.udf.register("weighted_osa", distance.weighted_osa_distance)
    spark.udf.register("nfc", distance.nfc)
    spark.udtf.register("spell_tokens", SpellTokens)
    if settings is not None:
        spark.udtf.register("spell_check", spell_check(spark, settings))
