"""Dictionary files (S10-S24): text of three kinds, compiled tries, affix dictionaries."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators.dictionary import entry_rows, normalised, trie_rows


def _lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(dict, no, line) in file order; gzip is transparent. One file's order is its position within the file."""
    text = spark.read.text(path, wholetext=True).select(F.lit(name).alias("dict"), F.posexplode(F.split("value", r"\r?\n", -1)).alias("no", "line"))
    return text.where("line IS NOT NULL")


def simple_entries(lines: DataFrame) -> DataFrame:
    """One entry a line. Comments may switch splitting at blanks on or off for the lines after them."""
    line = F.trim(F.regexp_replace("line", "^\\s+|\\s+$", ""))
    flags = F.regexp_extract(line, r"^#.*?(?:cspell-dictionary|cspell-tools):(.*)$", 1)
    asked = F.filter(F.split(flags, "[ ,;]+"), lambda x: x.isin("split", "no-split"))
    w = Window.partitionBy("dict").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumns({"line": line, "flag": F.when(F.size(asked) > 0, F.element_at(asked, -1))}).withColumn("mode", F.last("flag", ignorenulls=True).over(w))
    body = marked.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    return body.select("dict", F.explode(F.when(F.col("mode") == "split", F.split("line", "[ \t]+")).otherwise(F.array("line"))).alias("entry")).where("entry <> ''")


def legacy_entries(lines: DataFrame) -> DataFrame:
    """What stands before ``#``, cut at anything but letters, digits, marks, apostrophes."""
    body = F.regexp_extract("line", "^[^#]*", 0)
    return lines.select("dict", F.explode(F.split(body, r"[^A-Za-z0-9_\p{L}\p{M}\p{N}'’]+")).alias("entry")).where("entry <> ''")


def words_per_line_entries(lines: DataFrame) -> DataFrame:
    """What stands before ``#``, cut at blanks."""
    body = F.regexp_extract("line", "^[^#]*", 0)
    return lines.select("dict", F.explode(F.split(body, r"\s+")).alias("entry")).where("entry <> ''")


ENTRIES = {"S": simple_entries, "C": legacy_entries, "W": words_per_line_entries}


def text_dictionary(spark: SparkSession, path: str, name: str, kind: str = "S") -> DataFrame:
    """Rows of a text dictionary (kind S simple, C legacy, W words per line)."""
    return entry_rows(ENTRIES[kind](_lines(spark, path, name)))


# Tries


class TrieError(ValueError):
    pass


class _Node:
    __slots__ = ("children", "end")

    def __init__(self):
        self.children: dict[str, _Node] = {}
        self.end = False


def trie_words(content: str) -> list[str]:
    """The words of a compiled trie, sorted.

    After the header (``TrieXv3``, ``base=N``) and ``__DATA__``, characters descend; ``$`` ends a word and goes up
    one level, ``<`` goes up one, a digit after either goes up further, ``#n;`` points to the n-th node made, in
    base N, and a backslash escapes.
    """
    lines = content.splitlines()
    start = next((k for k, x in enumerate(lines) if "__DATA__" in x), None)
    if start is None:
        raise TrieError("the marker __DATA__ is missing")
    head = [x.strip() for x in lines[:start]]
    if "TrieXv3" not in head:
        raise TrieError("the identifier TrieXv3 is missing")
    base = next((x[5:] for x in reversed(head) if x.startswith("base=")), None)
    if base is None or not base.isdigit() or not 2 <= int(base) <= 36:
        raise TrieError(f"no usable base: {base}")
    return decode_trie("\n".join(lines[start + 1 :]), int(base))


def decode_trie(data: str, base: int) -> list[str]:
    root, leaf = _Node(), _Node()
    leaf.end = True
    frozen = {id(leaf)}
    made = [root, leaf]  # what references count
    path: list[tuple[_Node, str]] = []  # (parent, character) down to the current node
    node, state, digits = root, "main", ""

    def up(n: int) -> None:
        nonlocal node
        for _ in range(min(n, len(path))):
            node = path.pop()[0]

    def down(c: str) -> None:
        nonlocal node
        if id(node) in frozen:  # a shared end gets children: it becomes a node of its own
            own = _Node()
            own.end, own.children = node.end, dict(node.children)
            parent, via = path[-1]
            parent.children[via] = own
            made.append(own)
            node = own
        child = node.children.get(c)
        if child is None:
            child = node.children[c] = _Node()
        made.append(child)
        path.append((node, c))
        node = child

    for c in data:
        if state == "ref":
            if c != ";":
                digits += c
                continue
            k = int(digits, base) + 1 if digits else 1
            parent, via = path.pop()
            parent.children[via] = made[k]
            node = parent
            made.pop()
            state, digits = "main", ""
        elif state == "escape":
            if c == "\\":
                state = "mapped"
            else:
                down(c)
                state = "main"
        elif state == "mapped":
            down({"n": "\n", "r": "\r"}.get(c, c))
            state = "main"
        elif state == "back" and c in "23456789":
            up(int(c) - 1)
        elif c == "$":
            if node is not leaf:
                if node.children:
                    node.end = True
                else:
                    parent, via = path[-1]
                    parent.children[via] = leaf
                    if made[-1] is node:
                        made.pop()
                    node = leaf
            up(1)
            state = "back"
        elif c == "<":
            up(1)
            state = "back"
        elif c == "#":
            state = "ref"
        elif c == "\\":
            state = "escape"
        elif c in "\r\n":
            state = "main"
        else:
            down(c)
            state = "main"
    out, todo = [], [(root, "")]
    while todo:
        n, word = todo.pop()
        if n.end:
            out.append(word)
        todo.extend((child, word + ch) for ch, child in n.children.items())
    return sorted(out)


def trie_dictionary(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of compiled tries; each file is decoded by one task, many files side by side."""

    def run(batches):
        import pandas as pd

        for b in batches:
            for content in b["value"]:
                yield pd.DataFrame({"word": trie_words(content)})

    words = spark.read.text(path, wholetext=True).mapInPandas(run, "word string")
    return trie_rows(words.withColumn("dict", F.lit(name)))


# Affix dictionaries


@dataclass(frozen=True)
class Affix:
    kind: str
    flag: str
    strip: str
    add: str
    condition: str | None
    cross: bool


def parse_affixes(content: str) -> list[Affix]:
    """Prefix and suffix rules; a line of four fields whose last is a number heads a flag and says whether it crosses."""
    crosses: dict[tuple[str, str], bool] = {}
    rules = []
    for line in content.splitlines():
        f = line.split()
        if len(f) < 4 or f[0] not in ("SFX", "PFX"):
            continue
        if len(f) == 4 and f[3].isdigit():
            crosses[f[0], f[1][0]] = f[2] == "Y"
            continue
        rules.append((f[0], f[1][0], "" if f[2] == "0" else f[2], "" if f[3] == "0" else f[3], f[4] if len(f) > 4 and f[4] != "." else None))
    return [Affix(*r, cross=crosses.get((r[0], r[1]), True)) for r in rules]


def parse_words(lines: DataFrame) -> DataFrame:
    """(word, flags) of the lines (no, line) of a word file; a number on the first line is a count."""
    line = F.trim("line")
    body = lines.where(line != "")
    first = body.agg(F.min("no").alias("first"))
    body = body.crossJoin(F.broadcast(first)).where(~((F.col("no") == F.col("first")) & line.rlike("^[0-9]+$")))
    cut = F.instr(line, "/")
    word = F.when(cut > 0, F.substring(line, F.lit(1), cut - 1)).otherwise(line)
    flags = F.when(cut > 0, F.filter(F.split(F.substring(line, cut + 1, F.length(line)), ""), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    return body.select(word.alias("word"), flags.alias("flags"))


def rules_frame(spark: SparkSession, rules: list[Affix]) -> DataFrame:
    return spark.createDataFrame([(r.kind, r.flag, r.strip, r.add, r.condition, r.cross) for r in rules], "kind string, flag string, strip string, add string, condition string, cross boolean")


def _suffixed(words: DataFrame, rules: DataFrame, word: str) -> DataFrame:
    """E13."""
    ok = (F.col("condition").isNull() | F.expr(f"{word} RLIKE concat('^.*', condition, '$')")) & ((F.col("strip") == "") | F.expr(f"endswith({word}, strip)"))
    return words.join(rules, F.array_contains("flags", F.col("flag"))).where(ok).withColumn("form", F.expr(f"concat(left({word}, length({word}) - length(strip)), add)"))


def _prefixed(words: DataFrame, rules: DataFrame, word: str) -> DataFrame:
    """E14."""
    ok = (F.col("condition").isNull() | F.expr(f"{word} RLIKE concat('^', condition)")) & ((F.col("strip") == "") | F.expr(f"startswith({word}, strip)"))
    return words.join(rules, F.array_contains("flags", F.col("flag"))).where(ok).withColumn("form", F.expr(f"concat(add, substring({word}, length(strip) + 1))"))


def affix_forms(words: DataFrame, rules: DataFrame) -> DataFrame:
    """(word, form): words (word, flags) themselves, with a suffix, with a prefix, and with both where both cross."""
    suffixes, prefixes = rules.where("kind = 'SFX'"), rules.where("kind = 'PFX'")
    ended = _suffixed(words, suffixes, "word")
    begun = _prefixed(words, prefixes, "word")
    crossed = _prefixed(ended.where("cross").select("word", "flags", F.col("form").alias("ended")), prefixes.where("cross"), "ended")
    base = words.select("word", F.col("word").alias("form"))
    return base.unionByName(ended.select("word", "form")).unionByName(begun.select("word", "form")).unionByName(crossed.select("word", "form")).distinct()


def affix_dictionary(spark: SparkSession, dic: str, aff: str, name: str) -> DataFrame:
    """S21."""
    content = spark.read.text(aff, wholetext=True).first()
    rules = rules_frame(spark, parse_affixes(content.value if content else ""))
    forms = affix_forms(parse_words(_lines(spark, dic, name)), rules)
    rows = forms.select(F.lit(name).alias("dict"), F.lit("word").alias("kind"), F.col("form").alias("key"))
    return normalised(rows).withColumn("payload", F.lit(None).cast("array<string>")).distinct()


def load(spark: SparkSession, path: str, name: str, kind: str | None = None) -> DataFrame:
    """By extension: .trie and .trie.gz, .dic beside .aff, else text (``kind`` S, C, W or T for a trie)."""
    stem = re.sub(r"\.gz$", "", path)
    if kind == "T" or stem.endswith(".trie"):
        return trie_dictionary(spark, path, name)
    if stem.endswith(".dic"):
        return affix_dictionary(spark, path, re.sub(r"\.dic(\.gz)?$", ".aff", path), name)
    return text_dictionary(spark, path, name, kind or "S")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word) of word-list files: trimmed lines without blanks and comments."""
    word = F.trim("value")
    return spark.read.text(path).select(word.alias("word")).where((F.col("word") != "") & ~F.col("word").startswith("#"))


def typos(spark: SparkSession, path: str) -> DataFrame:
    """(wrong, right array) of the table ``default.extend-words`` of a TOML file."""
    import tomllib

    content = spark.read.text(path, wholetext=True).first()
    table = tomllib.loads(content.value if content else "").get("default", {}).get("extend-words", {})
    return spark.createDataFrame([(k.lower(), [v]) for k, v in table.items() if isinstance(v, str)], "wrong string, right array<string>")
