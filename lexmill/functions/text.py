"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import chars


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(col(c), chars.UPPER_ASCII, chars.LOWER_ASCII)


def capitalised(c: Column | str) -> Column:
    """First letter in upper case, the rest as it is."""
    c = col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def utf16_length(c: Column | str) -> Column:
    """P25."""
    return (F.octet_length(F.encode(col(c), "UTF-16BE")) / 2).cast("int")


def is_ascii(c: Column | str) -> Column:
    c = col(c)
    return F.octet_length(c) == F.length(c)


def repeats_one_letter(c: Column | str) -> Column:
    """one letter four times or more, in any case."""
    return col(c).rlike(r"(?iu)^(.)\1{3,}$")


def categories(c: Column | str) -> Column:
    """a word's shape, a character for each run of a kind."""
    out = col(c)
    for pattern, mark in ((r"[0-9]+", "0"), (r"\p{Ll}\p{M}+", "a"), (r"\p{Lu}\p{M}+", "A"), (r"\p{Lu}?\p{Ll}+", "1"), (r"\p{Lu}+", "2"), (r"\p{M}", "4"), ("_", ""), (r"[-_.']+", "3")):
        out = F.regexp_replace(out, pattern, mark)
    return out


def is_random(c: Column | str, least: int = 40) -> Column:
    """long and of many kinds for its length."""
    c = col(c)
    n = utf16_length(c)
    return (n >= least) & (F.octet_length(categories(c)) / n >= 0.5)


def possessive_base(c: Column | str) -> Column:
    """The word before a possessive or contraction, else null."""
    base = F.regexp_extract(col(c), rf"(?iu)^(.+)[{chars.APOSTROPHES}](?:s|d|t|ll|ve|re|m)$", 1)
    return F.when(base != "", base)


def capitals_base(c: Column | str) -> Column:
    """The capitals before a common ending, else null. The capitals are all there are."""
    base = F.regexp_extract(col(c), rf"(?u)^(\p{{Lu}}{{2,}}+)[{chars.APOSTROPHES}]?(?i:s|ing|ies|es|ings|ize|ed|ning)$", 1)
    return F.when(base != "", base)


def camel_parts(c: Column | str) -> Column:
    """P5: array of the parts of a camelCase word."""
    return F.split(col(c), chars.CAMEL, -1)


def path_key(c: Column | str) -> list[Column]:
    """L1, L2: sort keys of a path: _ - . / before the rest, case folded; shorter first; lower case first."""
    c = col(c)
    folded = F.translate(F.lower(c), "_-./\\", "\x01\x02\x03\x04\x04")
    swapped = F.translate(c, chars.UPPER_ASCII + chars.LOWER_ASCII, chars.LOWER_ASCII + chars.UPPER_ASCII)
    return [F.when(is_ascii(c), folded).otherwise(F.lower(c)), F.length(c), swapped]


def comment_prefix(path: Column | str) -> Column:
    """What starts a line comment in a file of this extension."""
    return F.when(F.regexp_extract(col(path), r"\.([^./]+)$", 1).isin("bash", "pl", "pm", "py", "rb", "sh", "toml", "yaml", "yml", "zsh"), "#").otherwise("//")


def size_in_bytes(size: str) -> int | None:
    """F30, X18: '2KB' and the like, in powers of 1024."""
    import re

    m = re.fullmatch(r"\s*([0-9.]+)\s*([A-Za-z]*)\s*", size)
    unit = {"": 0, "B": 0, "KB": 1, "MB": 2, "GB": 3}.get(m[2].upper()) if m else None
    try:
        return int(float(m[1]) * 1024**unit) if unit is not None else None
    except ValueError:
        return None
