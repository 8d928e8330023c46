"""Suggestions: a similarity join on deletion neighbourhoods, verified and ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.distance import osa_distance, weighted_osa_distance


def deletions(word: Column, edits: int = 2) -> Column:
    """The word and what is left of it after one or two deletions. Two words within two edits share such a form."""
    def once(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(x)), lambda k: F.concat(F.substring(x, F.lit(1), k - 1), F.substring(x, k + 1, F.length(x))))

    none = F.array().cast("array<string>")
    one = F.when(F.length(word) > 0, once(word)).otherwise(none)
    out = F.concat(F.array(word), one)
    if edits > 1:
        out = F.concat(out, F.flatten(F.transform(one, lambda x: F.when(F.length(x) > 0, once(x)).otherwise(none))))
    return F.array_distinct(out)


def candidates(words: DataFrame, entries: DataFrame, edits: int = 2) -> DataFrame:
    """(word, dict, entry): pairs whose byte lengths differ by ``edits`` at most and that share a deletion form.

    ``words``: word, key (folded). ``entries``: dict, entry.
    """
    a = words.select("word", "key").distinct().select("word", "key", F.explode(deletions(F.col("key"), edits)).alias("form"))
    b = entries.select("dict", "entry").distinct().select("dict", "entry", F.explode(deletions(F.col("entry"), edits)).alias("form"))
    near = F.abs(F.octet_length("key") - F.octet_length("entry")) <= edits
    return a.join(b, "form").where(near).select("word", "key", "dict", "entry").distinct()


def nearest(words: DataFrame, dict_words: DataFrame, limit: int = 5, edits: int = 2) -> DataFrame:
    """G1, L3: (word, dict, rank, suggestion) for each word and dictionary: explicit ones first, then preferred, then by weighted distance and spelling."""
    asked = words.select("word").distinct().withColumn("key", F.lower("word"))
    barred = dict_words.where(F.col("kind").isin("no_suggest", "forbidden")).select("dict", F.col("key").alias("entry"))
    entries = dict_words.where(F.col("kind").isin("word", "exact")).select("dict", F.col("key").alias("entry")).join(barred, ["dict", "entry"], "left_anti")
    pairs = candidates(asked, entries, edits).withColumn("raw", osa_distance("key", "entry")).where(F.col("raw") <= edits)
    preferred = dict_words.where("kind = 'preferred'").select("dict", F.col("key").alias("entry"), F.lit(1).alias("preferred")).distinct()
    pairs = pairs.withColumn("weighted", weighted_osa_distance("key", "entry")).join(preferred, ["dict", "entry"], "left")
    explicit = asked.join(dict_words.where("kind = 'suggest'").select("dict", "key", "payload"), "key").select("word", "dict", F.posexplode("payload").alias("at", "entry"))
    explicit = explicit.join(barred, ["dict", "entry"], "left_anti")
    both = pairs.select("word", "dict", "entry", F.lit(None).cast("int").alias("at"), F.coalesce("preferred", F.lit(0)).alias("preferred"), "weighted")
    both = both.unionByName(explicit.select("word", "dict", "entry", "at", F.lit(1).alias("preferred"), F.lit(0).alias("weighted")))
    one = both.groupBy("word", "dict", "entry").agg(F.min("at").alias("at"), F.max("preferred").alias("preferred"), F.min("weighted").alias("weighted"))
    w = Window.partitionBy("word", "dict").orderBy(F.col("at").asc_nulls_last(), F.col("preferred").desc(), "weighted", "entry")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("word", "dict", "rank", F.col("entry").alias("suggestion"))


def nearest_plain(words: DataFrame, entries: DataFrame, limit: int, edits: int = 2) -> DataFrame:
    """L4: (word, entry, distance, rank): by distance, then spelling."""
    pairs = candidates(words.select("word").distinct().withColumn("key", F.col("word")), entries, edits)
    pairs = pairs.withColumn("distance", osa_distance("key", "entry")).where(F.col("distance") <= edits)
    w = Window.partitionBy("word").orderBy("distance", "entry")
    return pairs.select("word", "entry", "distance").distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def for_issues(words: DataFrame, dict_words: DataFrame, order: list[str], limit: int = 5) -> DataFrame:
    """(word, suggestions): five of each dictionary in registration order, equal neighbours once, five in all."""
    found = nearest(words, dict_words.where(F.col("dict").isin(order)), limit)
    place = F.array_position(F.array(*(F.lit(d) for d in order)), F.col("dict"))
    whole = found.groupBy("word").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "rank", "suggestion"))).alias("s"))
    listed = F.transform("s", lambda x: x["suggestion"])
    kept = F.filter(listed, lambda x, i: (i == 0) | (x != F.get(listed, i - 1)))
    return whole.select("word", F.slice(kept, 1, limit).alias("suggestions"))


def for_command(words: DataFrame, dict_words: DataFrame, limit: int = 8) -> DataFrame:
    """(word, rank, suggestion) over all dictionaries, each suggestion once."""
    found = nearest(words, dict_words, limit)
    one = found.groupBy("word", "suggestion").agg(F.min("rank").alias("best"))
    w = Window.partitionBy("word").orderBy("best", "suggestion")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("word", "rank", "suggestion")


def with_corrections(suggestions: Column, right: Column) -> Column:
    """A typo table's corrections in front; those that are suggested already, in any case, stay in their place."""
    s, r = F.coalesce(suggestions, F.array().cast("array<string>")), F.coalesce(right, F.array().cast("array<string>"))
    fresh = F.filter(r, lambda x: ~F.exists(s, lambda y: F.lower(y) == F.lower(x)))
    return F.concat(fresh, s)
