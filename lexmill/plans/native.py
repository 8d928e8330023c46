"""Checking documents: the relational plan (Q1) and the compatible one, with their common tail."""

from __future__ import annotations

import unicodedata
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions import chars, text
from lexmill.operators import directives, lookup, ranges, scan, suggest, tokens
from lexmill.operators.checker import Checker, Config
from lexmill.operators.dictionary import Options, key_of, lexicons
from lexmill.plans import blockwise, compat, patterns

#: Beyond so many dictionary rows or bytes, words travel with the rows that concern them instead of meeting a broadcast dictionary.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
PARTS = "array<struct<at:int,part:string,forbidden:boolean>>"
_PARTS = pa.list_(pa.struct([("at", pa.int32()), ("part", pa.string()), ("forbidden", pa.bool_())]))
STATE = ["word", "code", "escaped", "compound", "case_sensitive", "extra", "inline", "flags"]
ISSUE = T.StructType([T.StructField("word", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType()), T.StructField("is_forbidden", T.BooleanType()), T.StructField("is_known_typo", T.BooleanType()), T.StructField("suggestions", T.ArrayType(T.StringType()))])


def named(ignore: list[str], special) -> dict[str, tuple[list[str], str]]:
    """The skip patterns of a document: built in, from settings, and those asked for by name."""
    out = dict(ranges.SKIP)
    out |= {f"setting-{k}": ([], p) for k, p in enumerate(ignore)}
    out |= {f"special-{k}": ([], ranges.OPTIONAL[k]) for k in special if k in ranges.OPTIONAL}
    return out


def held(dict_words: DataFrame) -> list[tuple] | None:
    """The dictionary's rows if they may be broadcast."""
    size = dict_words.agg(F.count("*").alias("rows"), F.sum(F.octet_length("key") + F.coalesce(F.octet_length(F.array_join("payload", "")), F.lit(0))).alias("bytes")).first()
    if size.rows > BROADCAST_ROWS or (size.bytes or 0) > BROADCAST_BYTES:
        return None
    return [tuple(r) for r in dict_words.select("dict", "kind", "key", "payload").collect()]


_dictionary = held
_held: dict[str, Checker] = {}


def _checker(name: str, shared, options: list[Options], config: Config) -> Checker:
    """The checker of a broadcast dictionary, built once in a worker."""
    if name not in _held:
        _held.clear()
        _held[name] = Checker(lexicons(shared.value, options), config)
    return _held[name]


def _maker(spark, rows: list[tuple], options: list[Options], config: Config):
    """A function for kernels that gives the dictionary's checker."""
    shared, name = spark.sparkContext.broadcast(rows), uuid.uuid4().hex
    return lambda: _checker(name, shared, options, config)


def _spellings(w: str) -> set[str]:
    n = unicodedata.normalize("NFC", w)
    return {w, n, w.lower(), n.lower(), chars.ascii_lower(w), key_of(w), key_of(w, True)}


def _substrings(w: str, most: int) -> set[str]:
    return {w[i:j] for i in range(len(w)) for j in range(i + 1, min(i + most, len(w)) + 1)}


def probes(word: str, pairs: list[tuple[str, str]], lengths: frozenset[int] | None = None) -> set[str]:
    """The keys that the kernel may look up for a word: of each form, as it is and with one replacement of ``pairs``, all substrings in NFC and folded.

    ``lengths``: of the dictionary's keys; probes of other lengths find nothing. A part is at most four times as long
    as its composed form.
    """
    most = len(word) + sum(len(b) for _, b in pairs) if lengths is None else 4 * max(lengths, default=0)
    out: set[str] = set()
    for form in {word, word.replace("’", "'"), word.replace("\\", "")}:
        # Parts of a form compose and fold like the whole, but for cuts between a letter and its mark and for the final sigma.
        alike = unicodedata.normalize("NFC", form) == form and "Σ" not in form
        for v in {v for w in ([form] if alike else _substrings(form, most)) for v in _spellings(w)}:
            made = {v} | {v[:k] + b + v[k + len(a) :] for a, b in pairs if a for k in range(len(v)) if v.startswith(a, k)}
            for x in {x for m in made for x in _substrings(m, most)}:
                out |= {y for y in _spellings(x) if lengths is None or len(y) in lengths}
    return out - {""}


def _entries(words: DataFrame, dict_words: DataFrame, options: list[Options]) -> DataFrame:
    """(word, _entries): for each distinct word, the dictionary rows of all keys that a lookup may try."""
    pairs = [p for o in options for p in o.rep_map]
    lengths = frozenset(r.n for r in dict_words.select(F.length("key").alias("n")).distinct().collect())

    def run(batches):
        for b in batches:
            for w in b.column("word").to_pylist():
                own = sorted(probes(w, pairs, lengths))
                yield pa.RecordBatch.from_arrays([pa.array([w] * len(own), pa.string()), pa.array(own, pa.string())], names=["word", "key"])

    keys = words.where("word <> ''").select("word").distinct().mapInArrow(run, "word string, key string")
    return keys.join(dict_words.select("dict", "kind", "key", "payload"), "key").groupBy("word").agg(F.collect_list(F.struct("dict", "kind", "key", "payload")).alias("_entries"))


def _rows_of(entries: list[dict] | None) -> list[tuple]:
    return [(e["dict"], e["kind"], e["key"], e["payload"]) for e in entries or []]


def _each(words: DataFrame, dict_words: DataFrame, rows: list[tuple] | None, options: list[Options], config: Config, decide, schema: str, column: str, kind: pa.DataType) -> DataFrame:
    """``words`` with a column decided by the kernel ``decide(checker, row)``; ``rows``: the dictionary if it may be broadcast."""
    names = words.columns
    out = T.StructType([*words.schema.fields, T.StructField(column, T._parse_datatype_string(schema))])
    if rows is not None:
        make = _maker(words.sparkSession, rows, options, config)

        def run(batches):
            for b in batches:
                got = [decide(make(), r) for r in b.to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, kind)], names=[*b.schema.names, column])

        return words.mapInArrow(run, out)

    def run_wide(batches):
        for b in batches:
            got = []
            for r in b.to_pylist():
                own = _rows_of([*(r.pop("_entries") or []), *(r.pop("_more") or [])])
                got.append(decide(Checker(lexicons(own, options), config), r))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(got, kind)], names=[*names, column])

    asked = words.select("word").unionByName(words.where("code IS NOT NULL").select(F.col("code").alias("word")))
    held = _entries(asked, dict_words, options)
    wide = words.join(held, "word", "left").join(held.select(F.col("word").alias("code"), F.col("_entries").alias("_more")), "code", "left")
    return wide.select(*names, "_entries", "_more").mapInArrow(run_wide, out)


def line_states(docs: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(lines to check with their state, directive-typo issues). Only documents that may hold directives pass through windows."""
    marked = docs.withColumn("_may", directives.may_hold(F.coalesce("text", F.lit(""))))
    plain = tokens.lines(marked.where("NOT _may"), "doc_id")
    none = F.lit(None)
    plain = plain.withColumns({"case_sensitive": F.lit(config.case_sensitive), "compound": F.lit(config.allow_compound_words), "extra": none.cast("array<string>"), "inline": none.cast("array<string>"), "flags": none.cast("array<string>"), "ignore_regexps": none.cast("array<string>"), "include_regexps": none.cast("array<string>")})
    parsed = directives.parse(tokens.lines(marked.where("_may"), "doc_id"))
    held = directives.states(parsed, "doc_id", case_sensitive=config.case_sensitive, compound=config.allow_compound_words).where("checked")
    held = held.join(directives.settings(parsed, "doc_id"), "doc_id", "left").select(plain.columns)
    near = directives.typos(parsed).select("doc_id", F.col("name").alias("word"), (F.col("line_offset") + F.col("column") - 1).alias("offset"), "line", F.col("column").cast("int").alias("column"), F.lit(False).alias("is_forbidden"), F.array("suggestion").alias("suggestions"))
    return plain.unionByName(held), near


def found_tokens(docs: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """Word tokens in checked lines outside skip ranges, with their line's state and the code token they stand in."""
    lines, near = line_states(docs, config)
    skip = ranges.pattern_ranges(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), named(config.ignore_patterns, config.named_patterns), "skip")
    if config.include_patterns:
        skip = ranges.pattern_ranges(skip, {str(k): ([], p) for k, p in enumerate(config.include_patterns)}, "include")
    skip = skip.drop("text").where(F.lit(True) if config.include_patterns else F.size("skip") > 0)
    special = F.filter(F.regexp_extract_all("line_text", F.lit(chars.JAVA_CODE), F.lit(0)), lambda t: t.rlike("[0-9_-]"))
    lines = lines.withColumn("codes", F.when(F.col("line_text").rlike("[0-9_-]"), special).otherwise(F.array().cast("array<string>")))
    got = tokens.matches(lines, "line_text", chars.JAVA_WORDS, "in_line", "word")
    prefix = F.expr("cast(substring(cast(line_text AS binary), 1, cast(in_line AS int)) AS string)")
    got = got.withColumns({"offset": F.col("line_offset") + F.col("in_line"), "escaped": F.expr("right(before, 1)") == "\\"})
    # the code token around a word: what joins on to it on either side
    tail = F.expr("cast(substring(cast(line_text AS binary), cast(in_line + octet_length(word) + 1 AS int)) AS string)")
    left = F.regexp_extract(prefix, rf"(?:(?:{chars.JAVA_LETTER}|_)\p{{M}}?(?:(?:[{chars.APOSTROPHES}](?={chars.JAVA_LETTER}))?(?:{chars.JAVA_LETTER}|[0-9_\-])\p{{M}}?)*)$", 0)
    right = F.regexp_extract(tail, rf"^(?:(?:[{chars.APOSTROPHES}](?={chars.JAVA_LETTER}))?(?:{chars.JAVA_LETTER}|[0-9_\-])\p{{M}}?)*", 0)
    code = F.concat(left, F.col("word"), right)
    got = got.withColumn("code", F.when((F.size("codes") > 0) & (code != F.col("word")) & F.array_contains("codes", code), code))
    got = got.join(skip, "doc_id", "left")
    got = got.where(F.col("skip").isNull() | ~ranges.inside("skip", "offset"))
    if config.include_patterns:
        got = got.where((F.size("include") == 0) | ranges.inside("include", "offset"))
    column = tokens.column_of("line_text", "in_line").cast("int").alias("column")
    return got.select("doc_id", "line", column, "offset", "word", "code", F.coalesce("escaped", F.lit(False)).alias("escaped"), "compound", "case_sensitive", "extra", "inline", "flags", "ignore_regexps"), near


def _decide(c: Checker, r: dict) -> list[dict]:
    """What a word reports; nothing if the code token that it stands in is known as a whole."""
    f = lambda x: frozenset(x or ())
    extra = None if r["extra"] is None else f(r["extra"])
    if r["code"] is not None and c.code(r["code"], extra, r["compound"], r["case_sensitive"], f(r["inline"])):
        return []
    got = c.resolve(r["word"], r["escaped"], extra, r["compound"], r["case_sensitive"], f(r["inline"]), f(r["flags"]))
    return [{"at": a, "part": p, "forbidden": b} for a, p, b in got]


def check_native(docs: DataFrame, dict_words: DataFrame, options: list[Options], config: Config, typos: DataFrame | None = None) -> DataFrame:
    """Q1: (doc_id, issue columns) of documents (doc_id, text).

    Beside a dictionary that may be broadcast, a kernel takes blocks of texts apart (``blockwise``). Beside a larger one, each distinct word with
    its line's state is settled once by a kernel, after words that the dictionary holds directly have left by joins; the tokens then join those that report something.
    """
    docs = docs.select("doc_id", "text")
    rows = held(dict_words)
    if rows is not None:
        return _check_blocks(docs, dict_words, rows, options, config, typos)
    found, near = found_tokens(docs, config)
    words = found.select(*STATE).distinct()
    plain = not config.case_sensitive and all(not o.configured and not o.case_sensitive for o in options)
    if plain:
        active = dict_words.where(F.col("dict").isin([o.name for o in options if o.active]))
        good = lookup.known(words, active)
        bad = lookup.of_kind(words, active, "forbidden")
        low = text.ascii_lower("word")
        flagged = low.isin(*config.flag_words) if config.flag_words else F.lit(False)
        own = F.coalesce(F.array_contains("flags", low), F.lit(False))
        rest = words.where(~flagged & ~own).join(good.join(bad, "word", "left_anti"), "word", "left_anti")
        words = words.where(flagged | own).unionByName(rest.select(words.columns))
    settled = _each(words, dict_words, rows, options, config, _decide, PARTS, "parts", _PARTS).where(F.size("parts") > 0)
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"w.{c}")) for c in STATE[1:]]
    hits = found.alias("t").join(settled.alias("w"), [F.col("t.word") == F.col("w.word"), *same]).select("t.doc_id", "t.word", "t.line", "t.column", "t.offset", F.explode("w.parts").alias("p"))
    part_column = F.col("column") + F.length(F.expr("cast(substring(cast(word AS binary), 1, p.at) AS string)"))
    issues = hits.select("doc_id", F.col("p.part").alias("word"), (F.col("offset") + F.col("p.at")).cast("bigint").alias("offset"), "line", part_column.cast("int").alias("column"), F.col("p.forbidden").alias("is_forbidden"), F.lit(None).cast("array<string>").alias("suggestions"))
    for p in config.ignore_patterns:
        issues = issues.where(F.col("is_forbidden") | ~F.col("word").rlike(p))
    return finish(docs, capped(issues, config), near, dict_words, options, config, typos)


def _check_blocks(docs: DataFrame, dict_words: DataFrame, rows: list[tuple], options: list[Options], config: Config, typos: DataFrame | None) -> DataFrame:
    """Q1 by ``blockwise``. Issues are capped in their row where each row is a document of its own and no later pattern drops any."""
    alone = not config.ignore_patterns and not scan.repeated(docs, "doc_id")
    more = include = None
    wide = docs
    own = {k: v for k, v in named(config.ignore_patterns, config.named_patterns).items() if k not in ranges.SKIP}
    for name, asked in (("skip", own), ("include", {str(k): ([], p) for k, p in enumerate(config.include_patterns)})):
        if asked:
            wide = ranges.pattern_ranges(wide.withColumn("text", F.coalesce("text", F.lit(""))), asked, name)
            more, include = (name, include) if name == "skip" else (more, name)
    found = blockwise.issues(wide, _maker(docs.sparkSession, rows, options, config), alone, more, include)
    typo = F.col("_first") == 0
    for p in config.ignore_patterns:
        found = found.where(typo | F.col("is_forbidden") | ~F.col("word").rlike(p))
    if not alone:
        w = Window.partitionBy("_first", "doc_id", "word").orderBy("offset")
        found = found.withColumn("_n", F.row_number().over(w)).where(typo | (F.col("_n") <= config.max_duplicates)).drop("_n")
    placed = alone and not config.late_ignore_patterns and not config.late_include_patterns
    return finish(docs, found if placed else found.drop("_place"), None, dict_words, options, config, typos)


def capped(issues: DataFrame, config: Config) -> DataFrame:
    """At most ``max_duplicates`` issues of one spelling in a document."""
    w = Window.partitionBy("doc_id", "word").orderBy("offset")
    return issues.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= config.max_duplicates).drop("_n")


def check_compat(docs: DataFrame, dict_words: DataFrame, options: list[Options], config: Config, typos: DataFrame | None = None) -> DataFrame:
    """Q2-Q15: the same columns, by the compatible kernel. A dictionary too large to broadcast reaches each document as the rows that its words may meet."""
    docs = docs.select("doc_id", "text")
    out = ranges.pattern_ranges(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), named(config.ignore_patterns, config.named_patterns), "skip")
    if config.include_patterns:
        out = ranges.pattern_ranges(out, {str(k): ([], p) for k, p in enumerate(config.include_patterns)}, "include")
    else:
        out = out.withColumn("include", F.expr("array(named_struct('s', 0L, 'e', cast(octet_length(text) AS bigint)))").cast(ranges.RANGE))
    out = out.withColumn("ranges", ranges.subtract("include", "skip")).select("doc_id", "text", "ranges")
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, ISSUE[n].dataType) for n in ("word", "offset", "line", "column", "is_forbidden", "suggestions"))])
    rows = held(dict_words)
    if rows is not None:
        make = _maker(docs.sparkSession, rows, options, config)
        issues = out.mapInArrow(compat.kernel(lambda _: make(), ["doc_id"], "ranges"), schema)
    else:
        out = out.withColumn("_key", F.sha2("text", 256))
        words = out.select("_key", "text").distinct().mapInArrow(_parts_of, "_key string, word string")
        own = words.join(_entries(words, dict_words, options), "word").groupBy("_key").agg(F.array_distinct(F.flatten(F.collect_list("_entries"))).alias("_entries"))
        found = out.join(own, "_key", "left").select("doc_id", "text", "ranges", "_entries")
        issues = found.mapInArrow(compat.kernel(lambda e: Checker(lexicons(_rows_of(e), options), config), ["doc_id"], "ranges", "_entries"), schema)
    return finish(docs, issues, None, dict_words, options, config, typos)


def _parts_of(batches):
    """The distinct possible words of each text, which hold all that the compatible check looks up, and the words beside its escapes."""
    for b in batches:
        for key, text in zip(b.column("_key").to_pylist(), b.column("text").to_pylist(), strict=True):
            own = sorted({m[0] for p in (chars.PY_POSSIBLE, chars.PY_WORDS) for m in p.finditer(text or "")})
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(own), pa.string()), pa.array(own, pa.string())], names=["_key", "word"])


def finish(docs: DataFrame, issues: DataFrame, near: DataFrame | None, dict_words: DataFrame, options: list[Options], config: Config, typos: DataFrame | None) -> DataFrame:
    """Late patterns, suggestions, known typos, the cap of a document; directive typos come first.

    ``issues`` may hold directive typos too (``_first`` is 0), and the rows' places in their documents (``_place``) if they are known.
    """
    placed = "_place" in issues.columns
    if "_first" not in issues.columns:
        issues = issues.withColumn("_first", F.lit(1))
    typo = F.col("_first") == 0
    for late, want in ((config.late_ignore_patterns, False), (config.late_include_patterns, True)):
        if late:
            spans = ranges.pattern_ranges(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), {str(k): ([], p) for k, p in enumerate(late)}, "late").drop("text")
            issues = issues.join(spans, "doc_id", "left")
            hit = F.coalesce(ranges.inside("late", "offset"), F.lit(False))
            issues = (issues.where(typo | hit | (F.size("late") == 0)) if want else issues.where(typo | ~hit)).drop("late")
    out = issues.withColumn("is_known_typo", F.lit(False))
    if config.suggestions:
        got = suggest.for_issues(issues.where(~typo & ~F.col("is_forbidden")).select("word"), dict_words, [o.name for o in options if o.active]).withColumnRenamed("suggestions", "_s")
        out = out.join(got, "word", "left").withColumn("suggestions", F.when(typo | F.col("is_forbidden"), F.col("suggestions")).otherwise(F.coalesce("_s", "suggestions"))).drop("_s")
    if typos is not None:
        fixed = lookup.corrections(issues.where(~typo).select("word"), typos)
        known = ~typo & F.col("right").isNotNull() & ~F.col("is_forbidden")
        out = out.join(fixed, "word", "left").withColumns({"is_known_typo": known, "suggestions": F.when(known, suggest.with_corrections(F.col("suggestions"), F.col("right"))).otherwise(F.col("suggestions"))}).drop("right")
    out = out.withColumn("suggestions", F.coalesce("suggestions", F.array().cast("array<string>")))
    if near is not None:
        out = out.unionByName(near.withColumns({"is_known_typo": F.lit(False), "_first": F.lit(0)}))
    if placed:
        out = out.where(F.col("_place") <= config.max_problems)
    else:
        w = Window.partitionBy("doc_id").orderBy("_first", "offset")
        out = out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= config.max_problems)
    return out.select("doc_id", *(F.col(f.name).cast(f.dataType).alias(f.name) for f in ISSUE))


def config_from(settings: dict) -> Config:
    """Q17: a check's parameters from resolved settings."""
    now, late, special = patterns.resolve(settings.get("ignoreRegExpList", []), {p["name"]: p["pattern"] for p in settings.get("patterns", [])})
    inc, late_inc, _ = patterns.resolve(settings.get("includeRegExpList", []), {p["name"]: p["pattern"] for p in settings.get("patterns", [])})
    low = lambda k: frozenset(w.lower() for w in settings.get(k, []))
    get = lambda k, d: d if settings.get(k) is None else settings[k]
    return Config(
        min_word_length=get("minWordLength", 4), case_sensitive=get("caseSensitive", False), flag_words=low("flagWords"), ignore_words=low("ignoreWords"), ignore_patterns=now, include_patterns=inc, late_ignore_patterns=late, late_include_patterns=late_inc, named_patterns=frozenset(special),
        allow_compound_words=get("allowCompoundWords", False), compound_mode=settings.get("compoundWordsMode"), ignore_random_strings=get("ignoreRandomStrings", True), min_random_length=get("minRandomLength", 40), max_duplicates=get("maxDuplicateProblems", 5), max_problems=get("maxNumberOfProblems", 10_000), suggestions=get("suggestions", False),
    )
