"""Membership of words in dictionaries as joins.

Words are looked up once each: a distinct relation of words is exploded into lookup keys and joined with the dictionary rows on
(kind, key). No side is broadcast by hint; Spark broadcasts a dictionary that is small enough and shuffles else.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.functions.arrays import fenced
from lexmill.functions.distance import nfc

KEYS = "array<struct<kind:string,key:string>>"


def with_composed(words: DataFrame) -> DataFrame:
    """Adds composed: the word in NFC. Only non-ASCII words pass through Python."""
    plain = text.is_ascii("word")
    return words.where(plain).withColumn("composed", F.col("word")).unionByName(words.where(~plain).withColumn("composed", nfc("word")))


def forms(word: Column) -> Column:
    """The forms of a word that are tried: itself, with a straight apostrophe, without backslashes."""
    straight = F.when(word.contains("’"), F.replace(word, F.lit("’"), F.lit("'")))
    bare = F.when(word.contains("\\"), F.replace(word, F.lit("\\"), F.lit("")))
    return F.filter(F.array(word, straight, bare), lambda x: x.isNotNull() & (x != ""))


def direct_keys(composed: str = "composed") -> Column:
    """M1, M2: the (kind, key) pairs of which one makes a word known."""
    c = F.col(composed)
    low = F.lower(c)
    return F.array(
        F.struct(F.lit("exact").alias("kind"), c.alias("key")),
        F.struct(F.lit("word").alias("kind"), c.alias("key")),
        F.struct(F.lit("word").alias("kind"), low.alias("key")),
        F.struct(F.lit("non_strict").alias("kind"), low.alias("key")),
    ).cast(KEYS)


def known(words: DataFrame, dict_words: DataFrame) -> DataFrame:
    """The distinct words (word) that some dictionary holds directly, in any of their forms."""
    tried = words.select("word").distinct().select(F.col("word").alias("asked"), F.explode(forms(F.col("word"))).alias("word"))
    keyed = with_composed(tried).select("asked", F.explode(direct_keys()).alias("k")).select("asked", F.col("k.kind").alias("kind"), F.col("k.key").alias("key"))
    return keyed.join(dict_words.select("kind", "key"), ["kind", "key"], "left_semi").select(F.col("asked").alias("word")).distinct()


#: characters that NFC may change or that have further forms: marks, singletons, Hangul parts, compatibility forms; apostrophes, backslashes
ODD = "[\\\\’\\p{M}\u0374\u037e\u0387\u0958-\u097f\u09dc-\u09df\u0a33-\u0a5e\u0b5c\u0b5d\u0f43-\u0fb9\u1100-\u11ff\u1f00-\u1fff\u2000\u2001\u2126\u212a\u212b\u2329\u232a\u2adc\ua960-\ua97f\uac00-\ud7ff\uf900-\ufb4f\\x{11000}-\\x{11fff}\\x{1d100}-\\x{1d1ff}\\x{2f800}-\\x{2fa1f}]"


def without_known(rows: DataFrame, dict_words: DataFrame) -> DataFrame:
    """The rows whose word no dictionary holds directly, with repeats.

    Words with one form are looked up as they stand, by two anti-joins that need no distinct words first. The others
    take the way of ``known``. ``rows`` should end in an exchange, which both ways then share.
    """
    rows = fenced(rows, "word")
    odd = F.col("word").rlike(ODD)
    of = lambda *kinds: dict_words.where(F.col("kind").isin(*kinds)).select(F.col("key").alias("_key")).distinct()
    plain = rows.where(~odd).join(of("exact", "word"), F.col("word") == F.col("_key"), "left_anti")
    plain = plain.join(of("word", "non_strict"), F.lower("word") == F.col("_key"), "left_anti")
    rest = rows.where(odd)
    return plain.unionByName(rest.join(known(rest, dict_words), "word", "left_anti").select(plain.columns))


def of_kind(words: DataFrame, dict_words: DataFrame, kind: str) -> DataFrame:
    """the distinct words that a dictionary lists as ``forbidden`` or ``no_suggest``."""
    keyed = with_composed(words.select("word").distinct()).withColumn("key", F.lower("composed"))
    return keyed.join(dict_words.where(F.col("kind") == kind).select("key"), "key", "left_semi").select("word")


def unknown(words: DataFrame, dict_words: DataFrame) -> DataFrame:
    """The distinct words that no dictionary holds directly."""
    own = words.select("word").distinct()
    return own.join(known(own, dict_words), "word", "left_anti")


def two_part_compounds(words: DataFrame, dict_words: DataFrame) -> DataFrame:
    """M3, M4: distinct words that are a first and a last part of one dictionary."""
    own = words.select("word").distinct().withColumn("low", F.lower("word")).where(F.length("low") > 1)
    cut = own.select("word", "low", F.explode(F.sequence(F.lit(1), F.length("low") - 1)).alias("k"))
    cut = cut.select("word", F.expr("left(low, k)").alias("first"), F.expr("substring(low, k + 1)").alias("last"))
    first = dict_words.where("kind = 'part_first'").select("dict", F.col("key").alias("first"))
    last = dict_words.where("kind = 'part_last'").select("dict", F.col("key").alias("last"))
    return cut.join(first, "first").join(last, ["dict", "last"], "left_semi").select("word").distinct()


def _replace_at(cut: Column, a: str, b: str):
    return lambda k: F.concat(F.array_join(F.slice(cut, 1, k), a), F.lit(b), F.array_join(F.slice(cut, k + 1, F.size(cut)), a))


def replacement_forms(words: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """M6: (word, form): each single replacement at each place."""
    made = []
    for a, b in pairs:
        cut = F.split("word", F.lit("\\Q" + a + "\\E"), -1)
        made.append(F.when(F.size(cut) > 1, F.transform(F.sequence(F.lit(1), F.size(cut) - 1), _replace_at(cut, a, b))).otherwise(F.array().cast("array<string>")))
    both = F.array_sort(F.array_distinct(F.flatten(F.array(*made)))) if made else F.array().cast("array<string>")
    return words.select("word").distinct().select("word", F.explode(both).alias("form"))


def joined_compounds(words: DataFrame, dict_words: DataFrame, least: int = 3, depth: int = 6) -> DataFrame:
    """Distinct words of two to ``depth`` + 2 known parts of ``least`` bytes or more.

    Only substrings as long as some key are looked up, and only in words that begin and end with a part. They travel
    with the word's digest, not with the word, so a word of thousands of letters stays cheap.
    """
    keys = dict_words.where((F.col("kind") == "word") & (F.octet_length("key") >= least)).select("key").distinct()
    lengths = sorted(r.n for r in keys.select(F.length("key").alias("n")).distinct().collect())  # at most as many as the longest key has letters
    if not lengths:
        return words.select("word").where("false")
    own = words.select("word").distinct().select("word", F.md5("word").alias("id"), F.lower("word").alias("low")).withColumn("n", F.length("low")).where(F.col("n") > lengths[0])
    sized = own.select("id", "low", "n", F.explode(F.array(*map(F.lit, lengths))).alias("k")).where("k < n")
    for edge in ("left(low, k)", "right(low, k)"):
        held = sized.select("id", F.expr(edge).alias("key")).join(keys, "key", "left_semi").select("id").distinct()
        sized = sized.join(held, "id", "left_semi")
    cut = sized.select("id", "n", "k", F.explode(F.expr("transform(sequence(0, n - k), s -> struct(s, substring(low, s + 1, k) AS key))")).alias("x"))
    good = cut.select("id", "n", F.col("x.key").alias("key"), F.col("x.s").alias("s"), (F.col("x.s") + F.col("k")).alias("e")).join(keys, "key", "left_semi")
    by = good.groupBy("id", "n").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return own.join(by.mapInArrow(_tiled(depth + 2), "id string"), "id", "left_semi").select("word")


def _tiled(most: int):
    """Kernel: the ids whose spans lead from 0 to n in ``most`` steps or fewer."""

    def run(batches):
        for b in batches:
            keep = []
            for row, (n, spans) in enumerate(zip(b.column("n").to_pylist(), b.column("spans").to_pylist(), strict=True)):
                ahead: dict[int, list[int]] = {}
                for x in spans:
                    ahead.setdefault(x["s"], []).append(x["e"])
                at = {0}
                for _ in range(most):
                    at = {e for s in at for e in ahead.get(s, ())}
                    if n in at:
                        keep.append(row)
                        break
            yield b.select(["id"]).take(pa.array(keep, pa.int64()))

    return run


def trace(words: DataFrame, dict_words: DataFrame, dicts: DataFrame) -> DataFrame:
    """(word, dict, found, forbidden, no_suggest) for each word and dictionary.

    ``dicts``: one row a dictionary (dict), a list of settings, hence small.
    """
    own = with_composed(words.select("word").distinct())
    pairs = own.crossJoin(dicts.select("dict"))
    hits = own.select("word", F.explode(direct_keys()).alias("k")).select("word", F.col("k.kind").alias("kind"), F.col("k.key").alias("key"))
    found = hits.join(dict_words.select("dict", "kind", "key"), ["kind", "key"]).select("word", "dict").distinct().withColumn("found", F.lit(True))
    marks = own.withColumn("key", F.lower("composed")).join(dict_words.where(F.col("kind").isin("forbidden", "no_suggest")).select("dict", "kind", "key"), "key")
    marks = marks.groupBy("word", "dict").agg(F.bool_or(F.col("kind") == "forbidden").alias("forbidden"), F.bool_or(F.col("kind") == "no_suggest").alias("no_suggest"))
    out = pairs.select("word", "dict").join(found, ["word", "dict"], "left").join(marks, ["word", "dict"], "left")
    return out.select("word", "dict", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("found", "forbidden", "no_suggest")))


def corrections(words: DataFrame, typos: DataFrame) -> DataFrame:
    """(word, right) of words that a typo table (wrong, right) corrects, in any case."""
    return words.select("word").distinct().withColumn("wrong", F.lower("word")).join(typos.select(F.lower("wrong").alias("wrong"), "right"), "wrong").select("word", "right")
