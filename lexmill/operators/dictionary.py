"""Dictionaries as rows (dict, kind, key, payload), and as sets for the kernels that need random access.

Kinds: word, non_strict, exact, folded_exact, forbidden, no_suggest, preferred, identity, suggest (payload), part, part_first,
part_last, part_mid. ``entry_rows`` parses the text format in SQL (E1-E11), ``trie_rows`` routes trie words (E4).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import chars, text
from lexmill.functions.distance import nfc

SCHEMA = "dict string, kind string, key string, payload array<string>"
_KINDS = "array<struct<kind:string,key:string>>"


def base_of(entry: Column) -> Column:
    """What stands before '->', else before ':', trimmed."""
    arrow, colon = F.instr(entry, "->"), F.instr(entry, ":")
    cut = F.when(arrow > 0, arrow).otherwise(colon)
    return F.trim(F.when(cut > 0, F.substring(entry, F.lit(1), cut - 1)).otherwise(entry))


def folded(key: Column, nfc_key: Column | None = None) -> Column:
    """The key under which a case-insensitive dictionary stores a word: NFC, lower case."""
    return F.lower(nfc_key if nfc_key is not None else key)


def entry_rows(entries: DataFrame, dict_name: str | Column = "dict", entry: str = "entry") -> DataFrame:
    """Rows of a text dictionary's entries.

    ``:x`` is a word that only carries a suggestion, ``!*x`` preferred, ``!x`` forbidden, ``~x`` a word that is not
    suggested, ``=x`` identity; ``*`` and ``+`` at the ends make compound parts.
    """
    e = F.col(entry)
    rest = lambda n: F.substring(e, F.lit(n + 1), F.length(e))
    stripped = F.regexp_replace(e, r"^[*+]+|[*+]+$", "")
    star_a, star_z, plus_a, plus_z = e.startswith("*"), e.endswith("*"), e.startswith("+"), e.endswith("+")
    inner = ~star_a & ~star_z & stripped.contains("*")
    head, tail = star_a | plus_a, star_z | plus_z
    segments = F.filter(F.split(stripped, r"\*", -1), lambda x: x != "")

    def rows(*pairs: tuple[str, Column]) -> Column:
        return F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in pairs)).cast(_KINDS)

    def only(cond: Column, *pairs: tuple[str, Column]) -> Column:
        return F.when(cond, rows(*pairs)).otherwise(F.array().cast(_KINDS))

    joined = F.concat(
        rows(("word", F.replace(stripped, F.lit("*"), F.lit("")))),
        F.flatten(F.transform(segments, lambda x: F.array(*(F.struct(F.lit(k).alias("kind"), x.alias("key")) for k in ("part", "part_first", "part_last", "part_mid"))))).cast(_KINDS),
    )
    compound = F.concat(
        only(star_a | star_z & ~plus_a, ("word", stripped)),
        rows(("part", stripped)),
        only(tail & ~plus_a, ("part_first", stripped)),
        only(head & ~plus_z, ("part_last", stripped)),
        only(head & tail, ("part_mid", stripped)),
    )
    kinds = (
        F.when(e.startswith(":"), rows(("word", base_of(rest(1)))))
        .when(e.startswith("!*"), rows(("preferred", base_of(rest(2))), ("word", base_of(rest(2)))))
        .when(e.startswith("!"), rows(("forbidden", base_of(rest(1)))))
        .when(e.startswith("~"), rows(("no_suggest", rest(1)), ("word", rest(1))))
        .when(e.startswith("="), rows(("identity", rest(1)), ("word", rest(1))))
        .when(e.contains("*") | plus_a | plus_z, F.when(inner, joined).otherwise(compound))
        .otherwise(rows(("word", base_of(e))))
    )
    name = F.col(dict_name) if isinstance(dict_name, str) else dict_name
    out = entries.select(name.alias("dict"), F.explode(kinds).alias("k")).select("dict", F.col("k.kind").alias("kind"), F.col("k.key").alias("key"))
    return normalised(out.where(F.col("key") != "")).withColumn("payload", F.lit(None).cast("array<string>")).distinct()


def normalised(rows: DataFrame) -> DataFrame:
    """Keys in NFC, and in lower case but for exact and identity words. Only non-ASCII keys pass through Python."""
    plain = text.is_ascii("key")
    both = rows.where(plain).unionByName(rows.where(~plain).withColumn("key", nfc("key")))
    return both.withColumn("key", F.when(F.col("kind").isin("exact", "identity"), F.col("key")).otherwise(F.lower("key")))


def trie_rows(words: DataFrame, dict_name: str = "dict", word: str = "word") -> DataFrame:
    """Rows of the words of a trie dictionary, by their marks: ~ non-strict, : metadata, ! forbidden, + compound part, capitals exact."""
    w = F.col(word)
    loose = w.startswith("~")
    rest = F.when(loose, F.substring(w, F.lit(2), F.length(w))).otherwise(w)
    bad = rest.startswith("!")
    body = F.when(bad, F.substring(rest, F.lit(2), F.length(rest))).otherwise(rest)
    plus_a, plus_z = body.startswith("+"), body.endswith("+")
    base = F.regexp_replace(body, r"^\++|\++$", "")
    cased = body.rlike(r"[\p{Lu}\p{Lt}]")

    def row(kind: str, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    none = F.array().cast(_KINDS)
    as_word = F.when(cased, F.array(row("exact", body), row("folded_exact", body))).otherwise(F.array(row("word", body)))
    parts = F.concat(
        F.array(row("part", base)).cast(_KINDS),
        F.when(plus_z & ~plus_a, F.array(row("part_first", base)).cast(_KINDS)).otherwise(none),
        F.when(plus_a & ~plus_z, F.array(row("part_last", base)).cast(_KINDS)).otherwise(none),
        F.when(plus_a & plus_z, F.array(row("part_mid", base)).cast(_KINDS)).otherwise(none),
    )
    whole = F.when(bad, F.array(row("forbidden", F.when(plus_a | plus_z, base).otherwise(body)))).when(loose & ~(plus_a | plus_z), F.array(row("non_strict", body))).when(loose, none).otherwise(as_word)
    kinds = F.when(rest.startswith(":") | (body == ""), none).when(plus_a | plus_z, F.when(base == "", none).otherwise(F.concat(whole.cast(_KINDS), parts))).otherwise(whole.cast(_KINDS))
    out = words.select(F.col(dict_name).alias("dict"), F.explode(kinds).alias("k")).select("dict", F.col("k.kind").alias("kind"), F.col("k.key").alias("key"))
    return normalised(out).withColumn("payload", F.lit(None).cast("array<string>")).distinct()


def suggestion_rows(pairs: DataFrame) -> DataFrame:
    """(dict, word, suggestions array) as rows of kind suggest, in order, without repeats."""
    return pairs.groupBy("dict", F.lower("word").alias("key")).agg(F.array_distinct(F.flatten(F.collect_list("suggestions"))).alias("payload")).select("dict", F.lit("suggest").alias("kind"), "key", "payload")


def sizes(dict_words: DataFrame) -> DataFrame:
    """(dict, size): words, non-strict and exact words and suggestion entries."""
    return dict_words.where(F.col("kind").isin("word", "non_strict", "exact", "suggest")).groupBy("dict").agg(F.count_distinct("kind", "key").alias("size"))


@dataclass
class Options:
    """What a configured dictionary adds to its words."""

    name: str
    active: bool = True
    case_sensitive: bool = False
    ignore_forbidden: bool = False
    use_compounds: bool = False
    rep_map: list[tuple[str, str]] = field(default_factory=list)
    configured: bool = False


def rep_pairs(raw: Iterable[Iterable[str]]) -> list[tuple[str, str]]:
    """(from, to) pairs with alternatives such as 'a|b' spelt out."""
    return [(a, pair[1]) for pair in map(list, raw) if len(pair) > 1 for a in pair[0].split("|") if a]


def alternatives(word: str, pairs: Iterable[tuple[str, str]]) -> list[str]:
    """M6: each single replacement at each place, sorted, without repeats."""
    out = set()
    for a, b in pairs:
        k = word.find(a) if a else -1
        while k >= 0:
            out.add(word[:k] + b + word[k + len(a) :])
            k = word.find(a, k + len(a))
    return sorted(out)


def key_of(word: str, case_sensitive: bool = False) -> str:
    """Lookup key (1.5): ASCII words are folded by A-Z only, others by NFC and full case."""
    if word.isascii():
        return word if case_sensitive else chars.ascii_lower(word)
    w = unicodedata.normalize("NFC", word)
    return w if case_sensitive else w.lower()


class Lexicon:
    """One dictionary's sets, for kernels."""

    def __init__(self, options: Options, sets: dict[str, set[str]], suggest: dict[str, list[str]] | None = None):
        self.o = options
        self.sets = {k: frozenset(v) for k, v in sets.items()}
        self.suggestions = suggest or {}
        none: frozenset[str] = frozenset()
        self.words, self.exact, self.loose = (self.sets.get(k, none) for k in ("word", "exact", "non_strict"))
        self.first, self.last = self.sets.get("part_first", none), self.sets.get("part_last", none)
        self.bad, self.quiet = self.sets.get("forbidden", none), self.sets.get("no_suggest", none)
        self.preferred = self.sets.get("preferred", none)

    @property
    def costly(self) -> bool:
        return bool(self.o.rep_map or self.sets.get("part") or self.o.use_compounds)

    def key(self, word: str) -> str:
        return key_of(word, self.o.case_sensitive)

    def _composed(self, word: str) -> str:
        return word if word.isascii() else unicodedata.normalize("NFC", word)

    def _compound(self, key: str) -> bool:
        """M3, M4: two parts, the first and the last."""
        tries = [key, key.lower()] if self.o.case_sensitive and key.lower() != key else [key]
        return bool(self.first) and any(len(t.encode()) > 1 and any(t[:k] in self.first and t[k:] in self.last for k in range(1, len(t))) for t in tries)

    def direct(self, word: str, compounds: bool = False) -> bool:
        """M1."""
        key = self.key(word)
        if self._composed(word) in self.exact or key in self.words or not self.o.case_sensitive and key in self.loose:
            return True
        return compounds and self._compound(key)

    def direct_folded(self, word: str, key: str, compounds: bool = False) -> bool:
        """M2."""
        return self._composed(word) in self.exact or key in self.words or key in self.loose or compounds and self._compound(key)

    def replaced(self, word: str, compounds: bool) -> bool:
        """M5, M7."""
        return any(self.direct(a, compounds) for a in alternatives(word, self.o.rep_map))

    def forbidden(self, word: str) -> bool:
        return not self.o.ignore_forbidden and self.key(word) in self.bad

    def silent(self, word: str) -> bool:
        return self.key(word) in self.quiet

    def find(self, word: str) -> tuple[bool, bool, bool]:
        """M8: (found, forbidden, no_suggest)."""
        key = self.key(word)
        return self.direct(word, True) or self.replaced(word, True), key in self.bad, key in self.quiet

    def find_configured(self, word: str) -> tuple[bool, bool, bool]:
        """Forbidden words may be masked; a case-sensitive dictionary is searched again without case."""
        mask = lambda r: (False, False, False) if self.o.ignore_forbidden and r[1] else r
        got = mask(self.find(word))
        if got[0]:
            return got
        if self.o.case_sensitive:
            key = key_of(word)
            if self.direct_folded(word, key, self.o.use_compounds) or self.replaced(word, self.o.use_compounds):
                return mask((True, self.forbidden(word), key in self.quiet))
        return False, False, False

    def legacy_compound(self, word: str) -> bool:
        """Parts of three characters or more."""
        return joins(word, lambda p: self.find_configured(p)[0], 3, len)

    def has_direct(self, word: str, key: str | None) -> bool:
        """Membership without the costly forms; ``key``: the folded word if validation folds, else None."""
        if self.o.configured:
            return self._folded_configured(word, key) if key is not None else self.find_configured(word)[0]
        return self.direct(word) if key is None else self.direct_folded(word, key)

    def has(self, word: str, key: str | None) -> bool:
        if self.o.configured:
            if key is not None:
                return self._folded_configured(word, key)
            return self.find_configured(word)[0] or self.o.use_compounds and self.legacy_compound(word)
        return (self.direct(word, True) if key is None else self.direct_folded(word, key, True)) or self.replaced(word, True)

    def _folded_configured(self, word: str, key: str) -> bool:
        for w in dict.fromkeys([word, key]) if self.o.case_sensitive else [word]:
            if (self.direct_folded(w, key, True) or self.replaced(w, True)) and not (self.o.ignore_forbidden and self.key(w) in self.bad):
                return True
        return False


def joins(word: str, valid, least: int, size, depth: int = 6) -> bool:
    """Whether a word is two parts or more, at most ``depth`` + 2, all valid and of ``least`` or more."""
    todo, seen = [(0, 0)], set()
    while todo:
        at, level = todo.pop()
        if (at, level) in seen:
            continue
        seen.add((at, level))
        for k in range(at + 1, len(word)):
            left, right = word[at:k], word[k:]
            if size(left) < least or size(right) < least or not valid(left):
                continue
            if valid(right):
                return True
            if level < depth:
                todo.append((k, level + 1))
    return False


def lexicons(rows: Iterable[tuple], options: Iterable[Options]) -> list[Lexicon]:
    """Lexicons, in the order of the options, from (dict, kind, key, payload) rows."""
    sets: dict[str, dict[str, set[str]]] = {}
    suggest: dict[str, dict[str, list[str]]] = {}
    for name, kind, key, payload in rows:
        if kind == "suggest":
            suggest.setdefault(name, {})[key] = list(payload or ())
        else:
            sets.setdefault(name, {}).setdefault(kind, set()).add(key)
    return [Lexicon(o, sets.get(o.name, {}), suggest.get(o.name)) for o in options]


def from_words(spark: SparkSession, name: str, entries: Iterable[str]) -> DataFrame:
    """An inline dictionary of entries; ``bad->good1,good2`` is a suggestion."""
    entries = list(entries)
    rows = spark.createDataFrame([(name, e) for e in entries], "dict string, entry string")
    out = entry_rows(rows)
    pairs = [(name, a.strip(), [x.strip() for x in b.split(",") if x.strip()]) for e in entries if "->" in e for a, b in [e.split("->", 1)] if a.strip()]
    if pairs:
        out = out.unionByName(suggestion_rows(spark.createDataFrame(pairs, "dict string, word string, suggestions array<string>")))
    return out
