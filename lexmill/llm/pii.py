"""Personal data by regular expressions, checksums and context, in Spark SQL functions only.

For each kind a pattern proposes spans (leftmost, not overlapping within the kind), a
validator confirms them (octet range, Luhn, digit count, mod-97), and words near the span raise its score.
The base kinds (email, ip, card, phone) are reported whenever they validate; the method's own
kinds (iban, ssn, secret) only from a score of ``REPORT``.

Positions come from cutting the text at the same matches: with gaps g and matches k, match i
begins at the sum of the lengths of g[0..i] and k[0..i-1]. Prefix sums are taken in blocks of about
the square root of the number of matches, so a text full of matches stays cheap. Patterns are
anchored to the start of a run of their first character class (or the end of the previous match) and
use possessive quantifiers: the same matches, but no quadratic rescans and no deep recursion.

Rows stay where they are: no shuffle, no Python. Defined cases: a null text is empty and has
no spans; extra columns pass through ``detect`` unless they are called ``pii``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.arrays import fenced, let, prefix_maxima

REPORT = 0.5
CONTEXT = 0.35
BEFORE, AFTER = 40, 20
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
_SECRET = r'AKIA[0-9A-Z]{16}|(?:password|passwd|secret|token|api_key)\x20{0,2}[=:]\x20{0,2}"?[A-Za-z0-9_-]{8,}"?'


@dataclass(frozen=True)
class Kind:
    name: str
    #: for Java, and the same language for RE2
    pattern: str
    plain: str
    #: a literal without which no match is possible
    needs: str | None
    #: SQL conditions on the match ``m``
    spark: str
    duck: str
    score: float
    context: str
    base: bool = True


def _digits(n: str) -> tuple[str, str]:
    return f"length(regexp_replace(m, '[^0-9]', '')) {n}", f"length(regexp_replace(m, '[^0-9]', '', 'g')) {n}"


_luhn_term = "CASE WHEN {i} % 2 = 1 THEN CASE WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END ELSE {d} END"
_luhn_spark = "aggregate(transform(split(reverse(regexp_replace(m, '[^0-9]', '')), ''), (c, i) -> " + _luhn_term.format(i="i", d="cast(c AS int)") + "), 0, (a, x) -> a + x) % 10 = 0"
_luhn_duck = "list_sum(list_transform(string_split(reverse(regexp_replace(m, '[^0-9]', '', 'g')), ''), lambda c, i: " + _luhn_term.format(i="(i - 1)", d="CAST(c AS INT)") + ")) % 10 = 0"
_turned = "concat(substr({s}, 5), substr({s}, 1, 4))"
_mod_step = "CASE WHEN {c} BETWEEN '0' AND '9' THEN ({a} * 10 + {n}) % 97 ELSE ({a} * 100 + ascii({c}) - 55) % 97 END"
_mod_spark = "length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND aggregate(split(" + _turned.format(s="replace(m, ' ', '')") + ", ''), 0, (a, c) -> " + _mod_step.format(a="a", c="c", n="ascii(c) - 48") + ") = 1"
_mod_duck = "length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(" + _turned.format(s="replace(m, ' ', '')") + ", ''), lambda c: ascii(c))), lambda a, c: CASE WHEN c < 58 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END) = 1"
_octets = "'^{0}([.]{0}){{3}}$'".format(_OCTET)
_nine = _digits("BETWEEN 8 AND 15")
_card = _digits("BETWEEN 16 AND 19")

KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "@", "true", "true", 0.6, "e-?mail|contact|write|@"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", ".", f"m RLIKE {_octets}", f"regexp_matches(m, {_octets})", 0.5, r"\bip\b|host|address|server|login"),
    Kind("card", r"(?:(?<![0-9])(?<![0-9][\x20-])|\G)[0-9](?:[\x20-]?[0-9])++", r"[0-9]([\x20-]?[0-9])+", None, f"{_card[0]} AND {_luhn_spark}", f"{_card[1]} AND {_luhn_duck}", 0.6, "card|visa|credit|debit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", "+", _nine[0], _nine[1], 0.5, "phone|call|mobile|fax|tel"),
    Kind("iban", _IBAN, _IBAN, None, _mod_spark, _mod_duck, 0.6, "iban|account|bank|transfer", False),
    Kind("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "-", r"m RLIKE '^[0-8]' AND NOT m RLIKE '^000|^666|-00-|-0000$'", r"regexp_matches(m, '^[0-8]') AND NOT regexp_matches(m, '^000|^666|-00-|-0000$')", 0.3, "ssn|social security", False),
    Kind("secret", _SECRET, _SECRET, None, "true", "true", 0.5, "key|login|user|aws", False),
]
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _spans(kind: Kind) -> str:
    """SQL over the columns k (matches) and g (gaps) of this kind."""
    k, g = f"_k_{kind.name}", f"_g_{kind.name}"
    sums = f"_p_{kind.name}"
    block = f"cast(ceil(sqrt(size({k}))) AS int)"
    start = f"length({g}[0]) + {sums}[i div {block}] + aggregate(slice({k}_len, (i div {block}) * {block} + 1, i % {block}), 0L, (a, x) -> a + x)"
    near = f"lower(concat(right({g}[i], {BEFORE}), ' ', left({g}[i + 1], {AFTER})))"
    score = f"cast({kind.score} + CASE WHEN {near} RLIKE '{kind.context.replace(chr(92), chr(92) * 2)}' THEN {CONTEXT} ELSE 0 END AS double)"
    made = f"transform({k}, (m, i) -> CASE WHEN {kind.spark} THEN named_struct('kind', '{kind.name}', 'start', {start}, 'end', {start} + length(m), 'score', {score}) END)"
    keep = f"s IS NOT NULL{'' if kind.base else f' AND s.score >= {REPORT}'}"
    return f"cast(CASE WHEN size({k}) > 0 THEN filter({made}, s -> {keep}) ELSE array() END AS {_SPAN})"


def detect(docs: DataFrame, kinds: list[Kind] = KINDS) -> DataFrame:
    """``docs`` (with a ``text``) and pii: array of (kind, start, end, score), in code points, by kind as listed, then start."""
    names = [c for c in docs.columns if c != "pii"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn("_t", text)

    def matches(k: Kind) -> Column:
        found = F.regexp_extract_all("_t", F.lit(k.pattern), F.lit(0))
        return found if k.needs is None else F.when(F.contains("_t", F.lit(k.needs)), found).otherwise(F.array().cast("array<string>"))

    out = out.withColumns({f"_k_{k.name}": matches(k) for k in kinds})
    out = out.withColumns({f"_g_{k.name}": F.when(F.size(f"_k_{k.name}") > 0, F.split("_t", k.pattern, -1)) for k in kinds})
    # What match i puts between its own start and the next one's: its length and the next gap.
    out = out.withColumns({f"_k_{k.name}_len": F.expr(f"transform(_k_{k.name}, (m, i) -> cast(length(m) + length(_g_{k.name}[i + 1]) AS bigint))") for k in kinds})

    def prefix(k: Kind) -> Column:
        x, n = f"_k_{k.name}_len", f"size(_k_{k.name})"
        b = f"cast(ceil(sqrt({n})) AS int)"
        total = f"transform(sequence(0, ({n} - 1) div {b}), j -> aggregate(slice({x}, cast(j AS int) * {b} + 1, {b}), 0L, (a, y) -> a + y))"
        return F.expr(f"CASE WHEN {n} > 0 THEN transform({total}, (s, j) -> aggregate(slice({total}, 1, j), 0L, (a, y) -> a + y)) END")

    out = out.withColumns({f"_p_{k.name}": prefix(k) for k in kinds})
    return out.withColumn("pii", F.concat(*(F.expr(_spans(k)) for k in kinds))).select(*names, "pii")


def _text(spans: str) -> Column:
    return F.expr(f"concat_ws(',', transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)))")


def report(docs: DataFrame) -> DataFrame:
    """Counts and digests of ``detect``, by document."""
    base = [k.name for k in KINDS if k.base]
    found = detect(docs.select("doc_id", "text").drop("pii"))
    counts = [F.expr(f"cast(size(filter(pii, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in base]
    listed = ", ".join(f"'{k}'" for k in base)
    return found.select("doc_id", *counts, F.sha2(_text(f"filter(pii, s -> s.kind IN ({listed}))"), 256).alias("base_sha256"), _text("pii").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; of overlapping spans the first listed by start wins and the rest of the text they cover goes too."""
    found = detect(docs)
    order = "array_sort(transform(pii, s -> struct(s.start AS start, s.end AS end, s.kind AS kind)))"
    # _m: how far the spans before each reach; a span shows if it begins there or later, after the text in between
    shown = "concat(substring(text, cast(coalesce(_m[i], 0) AS int) + 1, cast(s.start - coalesce(_m[i], 0) AS int)), '[', upper(s.kind), ']')"
    parts = f"transform(_o, (s, i) -> CASE WHEN i = 0 OR s.start >= _m[i] THEN {shown} ELSE '' END)"
    tail = "substring(text, cast(array_max(transform(_o, s -> s.end)) AS int) + 1)"
    whole = let("_o", order, let("_m", prefix_maxima("transform(_o, s -> s.end)"), f"concat(array_join({parts}, ''), {tail})"))
    out = fenced(found, "pii").withColumn("text", F.when(F.size("pii") > 0, F.expr(whole)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _duck() -> str:
    parts = []
    for o, k in enumerate(KINDS):
        near = f"lower(concat(right(g[i], {BEFORE}), ' ', left(g[i + 1], {AFTER})))"
        parts.append(f"""
SELECT doc_id, {o} AS o, '{k.name}' AS kind, start, start + length(m) AS stop, {k.base} AS base FROM (
  SELECT doc_id, g, i, k[i] AS m, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(k[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT doc_id, k, g, unnest(range(1, len(k) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, '{k.plain}') AS k, string_split_regex(t, '{k.plain}') AS g FROM d) WHERE len(k) > 0))
WHERE {k.duck} AND ({k.base} OR {k.score} + CASE WHEN regexp_matches({near}, '{k.context}') THEN {CONTEXT} ELSE 0 END >= {REPORT})""")
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE kind = '{k.name}') AS BIGINT) AS n_{k.name}" for k in KINDS if k.base)
    zero = ", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in KINDS if k.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(parts)}),
a AS (
  SELECT doc_id, {counts}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start) FILTER (WHERE base) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)
"""


SQL = _duck()
