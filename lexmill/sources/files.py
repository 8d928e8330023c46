"""Files as documents: listing, decoding, types, languages, diffs, the clean-file cache."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.plans import globs

_GENERATED_NAMES = sorted({".cspellcache", ".ds_store", ".eslintcache", "berksfile.lock", "cargo.lock", "composer.lock", "id_rsa", "id_rsa.pub", "package-lock.json"})
_GENERATED = set("bin dll exe lib o obj phar wasm jar whl spv trie mdb lock log map pdf pem pub gz zip".split())
_GENERATED |= set("bmp cur exr gif heic ico jpeg jpg pbm pgm png ppm ras sgi tiff webp xbm".split())
_GENERATED |= set("avi flv mkv mov mp4 mpeg mpg webm wmv eot ttf woff woff2".split())
#: F32: names of a file type, then its extensions
TYPES = [(a.split(), b.split()) for a, b in (x.split(":") for x in """bash sh shell:bash sh zsh|c:c h|c++ cpp:cc cpp cxx h hh hpp hxx|css:css less scss|go:go|html:htm html|java:java|javascript js:cjs js jsx mjs|json:json jsonc|kotlin kt:kt kts|markdown md:markdown md|php:php|py python:py pyi pyw|rb ruby:rb|rs rust:rs|scala:scala|sql:sql|swift:swift|toml:toml|ts typescript:cts mts ts tsx|xml:xml|yaml yml:yaml yml""".split("|"))]
#: Language ids, then extensions
_LANGUAGES = """ada:ada adb ads|asciidoc:adoc asc asciidoc|astro:astro|c:c i|cpp:cc cpp cxx h h.in hh hpp hpp.in hxx ii inl ino ipp ixx tpp txx|csharp:cake cs csx|css:css|dart:dart|dockerfile:containerfile dockerfile|elixir:ex exs|fsharp:fs fsi fsscript fsx|go:go|graphql:gql graphql|handlebars:handlebars hbs hjs|haskell:hs|html:asp aspx ejs htm html jshtm jsp mdoc rhtml shtml volt xht xhtml|html,vue:vue|jade:jade pug|java:jav java|javascript:cjs es6 js mjs pac|javascriptreact:jsx|json:json|json,jsonc:jsonc|julia:jl|kotlin:kt kts|latex:ctx latex ltx tex|less:less|lua:lua|markdown:markdn markdown md mdown mdtext mdtxt mdwn mkd workbook|markdown,mdx:mdx|perl:pl pm pod psgi t|php:ctp php php4 php5 phtml|plaintext:txt|powershell:ps1 psd1 psm1 psrc pssc|protobuf:pbtxt proto textpb textproto txtpb|python:py pyi pyw|r:r rt|restructuredtext:rst|ruby:gemspec podspec rake rb rbi rbx rjs ru|rust:rs|scala:sbt sc scala|scss:scss|shellscript:bash sh zsh|sql:sql|svelte:svelte|swift:swift|terraform:tf tfvars|toml:toml|typescript:cts mts ts|typescriptreact:tsx|vb:vb|xml:nib storyboard xib xml|yaml:cff eyaml eyml yaml yaml-tmlanguage yaml-tmpreferences yaml-tmtheme yml|zig:zig"""
LANGUAGES = {e: ids.split(",") for ids, exts in (x.split(":") for x in _LANGUAGES.split("|")) for e in exts.split()}
_NAMES = {"gnumakefile": "makefile", "makefile": "makefile", "ocamlmakefile": "makefile", "jakefile": "javascript", "readme.md": "markdown"} | {f"{n}file": "ruby" for n in "app berks brew cap chef danger deliver fast gem guard gym hobo match pod puppet rake rant".split()} | {"appraisals": "ruby"}


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the name, which must not begin with it."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def read(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, modified, size, content) of the files below a folder; the listing and the reads are Spark's."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.unix_timestamp("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """(path): trimmed lines that aren't blank."""
    p = F.trim("value")
    return spark.read.text(path).select(p.alias("path")).where("path <> ''")


def decoded(files: DataFrame) -> DataFrame:
    """Adds text, null for binary content: UTF-16 by mark or by a zero in one of the first two bytes, else UTF-8 with bad bytes replaced."""
    a, b = F.substring("content", 1, 1), F.substring("content", 2, 1)
    zero = F.unhex(F.lit("00"))
    two = F.hex(F.substring("content", 1, 2))
    big = (two == "FEFF") | ((a == zero) & (F.octet_length(b) > 0) & (b != zero))
    little = (two == "FFFE") | ((a != zero) & (b == zero))
    wide = big | little
    even = F.expr("substring(content, CASE WHEN hex(substring(content, 1, 2)) IN ('FEFF', 'FFFE') THEN 3 ELSE 1 END, cast((octet_length(content) - CASE WHEN hex(substring(content, 1, 2)) IN ('FEFF', 'FFFE') THEN 2 ELSE 0 END) div 2 * 2 AS int))")
    binary = ~generated(F.col("path")) & (F.position(zero, F.substring("content", 1, 1024)) > 0) & ~wide
    text = F.when(F.octet_length("content") == 0, "").when(binary, None).when(big, F.decode(even, "UTF-16BE")).when(little, F.decode(even, "UTF-16LE")).otherwise(F.make_valid_utf8(F.col("content").cast("string")))
    return files.withColumn("text", text)


def generated(path: Column) -> Column:
    """lock files, caches, keys, archives, images, media, fonts and the like, by name."""
    return F.lower(file_name(path)).isin(*_GENERATED_NAMES) | extension(path).isin(*sorted(_GENERATED))


def of_type(path: Column, kind: str) -> Column:
    """F32."""
    found = [e for names, exts in TYPES if kind.lower() in names for e in exts]
    return extension(path).isin(*found) if found else F.lit(False)


def languages(path: Column) -> Column:
    """array of language ids."""
    by_ext = F.create_map(*(x for e, ids in LANGUAGES.items() for x in (F.lit(e), F.array(*map(F.lit, ids)))))
    by_name = F.create_map(*(x for n, i in _NAMES.items() for x in (F.lit(n), F.array(F.lit(i)))))
    name = F.lower(file_name(path))
    docker = name.rlike(r"^(?:dockerfile|containerfile)(?:\..*)?$|\.dockerfile$|\.dockerfile\.")
    return F.coalesce(by_ext[extension(path)], F.when(docker, F.array(F.lit("dockerfile"))), by_name[name], F.array().cast("array<string>"))


def language_matches(patterns: list[str], ids: Column) -> Column:
    """none means all; a name; ``!name`` excludes; exclusions alone match the rest."""
    if not patterns:
        return F.lit(True)
    low = [p.lower() for p in patterns]
    names, barred = [p for p in low if not p.startswith("!")], [p[1:] for p in low if p.startswith("!")]

    def one(i: Column) -> Column:
        i = F.lower(i)
        out = F.when(i.isin(*names), True) if names else F.when(F.lit(False), True)
        if barred:
            out = out.when(i.isin(*barred), False)
        return out.otherwise(not names)

    return F.exists(ids, one)


def locale_matches(locale: str | None, active: str) -> bool:
    """F40."""
    if locale is None:
        return True
    have = {x.strip().lower() for x in active.split(",")}
    return any(x.strip() == "*" or x.strip().lower() in have for x in locale.split(","))


def selected(files: DataFrame, *, ignore: list[str] = (), exclude: list[str] = (), gitignore: dict[str, list[str]] | None = None, vendored: list[str] = (), kind: str | None = None, config: str | None = None, hidden: bool = False, generated_too: bool = False, most: int | None = None, listed: DataFrame | None = None, root: str | None = None) -> DataFrame:
    """Files that pass all filters, each once. Patterns are for paths below ``root``, where it is given."""
    p = F.col("path")
    below = p
    if root:
        start = root.rstrip("/") + "/"
        below = F.when(p.startswith(start), F.substring(p, F.lit(len(start) + 1), F.length(p))).otherwise(p)
    out = files
    if not hidden:
        out = out.where(~below.rlike(r"(?:^|/)\.[^/]+"))
    if config:
        out = out.where(p != config)
    if gitignore:
        out = out.where(~globs.git_ignored(p, gitignore))
    if listed is not None:
        out = out.join(listed.select("path").distinct(), "path", "left_semi")
    for patterns in (ignore, exclude, vendored):
        if patterns:
            out = out.where(~globs.ignored(below, list(patterns)))
    if kind:
        out = out.where(of_type(p, kind))
    if not generated_too:
        out = out.where(~generated(p))
    if most is not None and "size" in files.columns:
        out = out.where(F.col("size") <= most)
    return out.dropDuplicates(["path"])


def vendored_globs(lines: list[str]) -> list[str]:
    """Patterns that an attributes file marks as vendored or generated."""
    out = []
    for line in lines:
        f = line.split()
        if len(f) > 1 and not f[0].startswith("#") and any(re.fullmatch(r"linguist-(?:vendored|generated)(?:=true)?", x) for x in f[1:]):
            out.append(f[0])
    return out


def diff_lines(diff: DataFrame) -> DataFrame:
    """(path, line) of added lines. ``diff``: text: unified diffs, each whole.

    A header names the target file, a hunk its first line; within a hunk every line but removed ones counts. Diffs are
    cut at their files' headers first, so a window holds one file's part.
    """
    parts = diff.select(F.monotonically_increasing_id().alias("_d"), F.posexplode(F.split("text", r"(?m)^(?=diff --git )", -1)).alias("_f", "_part"))
    rows = parts.select("_d", "_f", F.posexplode(F.split("_part", "\r?\n", -1)).alias("no", "value"))
    w = Window.partitionBy("_d", "_f").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("value")
    file = F.when(v.rlike(r"^\+\+\+ "), F.regexp_replace(F.regexp_extract(v, r"^\+\+\+ ([^\t]*)", 1), "^b/", ""))
    hunk = F.when(v.startswith("@@"), F.col("no"))
    start = F.when(v.startswith("@@"), F.regexp_extract(v, r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).cast("int"))
    out = rows.withColumns({"path": F.last(file, ignorenulls=True).over(w), "hunk": F.last(hunk, ignorenulls=True).over(w), "start": F.last(start, ignorenulls=True).over(w)})
    inside = F.col("hunk").isNotNull() & (F.col("no") > F.col("hunk")) & ~v.rlike(r"^(?:diff --git|\+\+\+ |--- |index |\\)")
    h = Window.partitionBy("_d", "_f", "path", "hunk").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    out = out.where(inside).withColumn("line", F.col("start") - 1 + F.sum(F.when(v.startswith("-"), 0).otherwise(1)).over(h))
    return out.where(v.startswith("+") & ~F.col("path").isin("", "/dev/null")).select("path", F.col("line").cast("int").alias("line"))


def read_diff(spark: SparkSession, path: str) -> DataFrame:
    """``diff_lines`` of the diff files below a path."""
    return diff_lines(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))


def marker_files(spark: SparkSession, folder: str, name: str, depth: int, above: bool = False) -> dict[str, str]:
    """Text of the files called ``name`` (or ``{a,b}``) by folder: in a folder and the ``depth`` levels below it; with ``above``, also in those above it up to one with a ``.git``.

    The listing is one glob a level, so stores with many files but few such files stay cheap.
    """
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs = path_of(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    text_of = spark._jvm.org.apache.commons.io.IOUtils.toString
    out: dict[str, str] = {}

    def take(pattern: str) -> None:
        for status in fs.globStatus(path_of(pattern)) or []:
            if status.isFile():
                stream = fs.open(status.getPath())
                try:
                    text = text_of(stream, "UTF-8")
                finally:
                    stream.close()
                full = re.sub(r"^file:/+", "/", status.getPath().toString())
                out.setdefault(full if "{" in name else full.rpartition("/")[0], text)

    folder = folder.rstrip("/")
    for k in range(depth + 1):
        take(folder + "/*" * k + "/" + name)
    at = folder
    while above and not fs.exists(path_of(f"{at}/.git")) and "/" in at.removeprefix("file://").strip("/"):
        at = at.rpartition("/")[0]
        take(f"{at}/{name}")
    return out


def to_check(files: DataFrame, cache: DataFrame, strategy: str = "metadata") -> DataFrame:
    """files that the cache doesn't know as clean and unchanged, by (path, modified, size) or by content."""
    if strategy == "metadata":
        return files.join(cache.select("path", "modified", "size"), ["path", "modified", "size"], "left_anti")
    return files.withColumn("md5", F.md5("content")).join(cache.select("path", "md5"), ["path", "md5"], "left_anti").drop("md5")


def clean_files(files: DataFrame, issues: DataFrame) -> DataFrame:
    """Cache rows (path, modified, size, md5) of the files without issues."""
    return files.join(issues.select("path").distinct(), "path", "left_anti").select("path", "modified", "size", F.md5("content").alias("md5"))


def nearest_config(files: DataFrame, configs: DataFrame) -> DataFrame:
    """Each path with the value of the deepest folder above it that has one. ``configs``: dir, value."""
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    up = files.select("path", F.explode(F.when(F.size(parts) > 1, dirs).otherwise(F.array().cast("array<string>"))).alias("dir"))
    best = up.join(configs.select(F.regexp_replace("dir", "(?<=.)/$", "").alias("dir"), "value"), "dir").groupBy("path").agg(F.max_by(F.struct("dir", "value"), F.length("dir")).alias("b"))
    return files.join(best, "path", "left").select(*files.columns, F.col("b.dir").alias("config_dir"), F.col("b.value").alias("config"))
