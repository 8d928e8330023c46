"""URL filters: host rules, and pattern rules indexed by their rarest literal token.

A pattern rule is text in which ``*`` stands for anything, ``^`` for one separator (anything
but a letter, digit, ``_``, ``.``, ``%`` or ``-``) or the end, ``|`` at either end for the end of the url and
``||`` at the start for the start of a host label. A pattern's literal tokens are its runs of
``[a-z0-9]`` that a url must hold as whole tokens, since pattern characters on both sides delimit
them. Token frequencies are counted over all urls; each rule is filed under its rarest token.
A url's tokens fetch the candidate rules, and only these run their regular expression. A
pattern without a whole token is filed under no token and runs for every url.

An allowing pattern overrides blocking ones; without a match the verdict is ``DEFAULT``.

Rows are judged one by one, so neither a frequent host nor a frequent url moves rows. The
index goes to the executors in parts of ``RULES_PER_PASS`` patterns, whatever their number.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no host
rule; patterns still see its text. Extra columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm import bytesops as B

DEFAULT = "allow"
RULES_PER_PASS = 100_000
TOKEN = re.compile("[a-z0-9]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    action: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Pattern:
    text: str
    action: str = "block"

    def regex(self) -> str:
        t, out = self.text.lower(), ""
        if t.startswith("||"):
            t, out = t[2:], r"^[^:/?#]*://(?:[^/?#]*\.)?"
        elif t.startswith("|"):
            t, out = t[1:], "^"
        end = t.endswith("|")
        for c in t[: len(t) - end]:
            out += ".*" if c == "*" else r"(?:[^a-z0-9_.%-]|$)" if c == "^" else re.escape(c)
        return out + ("$" if end else "")

    def tokens(self) -> list[str]:
        t = self.text.lower()
        found = []
        for m in TOKEN.finditer(t):
            before, after = t[: m.start()], t[m.end() :]
            if before[-1:] not in ("", "*") and after[:1] not in ("", "*"):
                found.append(m[0])
        return found


def _after_scheme(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def host_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)).otherwise("")


def _count(tokens: frozenset[str]):
    @B.lean
    def run(batches):
        n: Counter = Counter()
        for b in batches:
            for u in b.column("url").to_pylist():
                if u:
                    n.update(tokens.intersection(TOKEN.findall(u.lower())))
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})

    return run


def token_counts(urls: DataFrame, patterns: list[Pattern]) -> dict[str, int]:
    """In how many urls each of the patterns' tokens occurs; one row a token reaches the driver."""
    tokens = frozenset(x for p in patterns for x in p.tokens())
    if not tokens:
        return {}
    return dict(map(tuple, urls.select("url").mapInArrow(_count(tokens), "token string, n long").groupBy("token").agg(F.sum("n")).collect()))


def index(patterns: list[Pattern], counts: dict[str, int]) -> dict[str, list[tuple[str, str, str]]]:
    """Rarest token (ties: the longest, then the first) -> (text, action, regex); '' holds the patterns without a token."""
    by: dict[str, list] = {}
    for p in patterns:
        key = min(p.tokens(), key=lambda t: (counts.get(t, 0), -len(t), t), default="")
        by.setdefault(key, []).append((p.text, p.action, p.regex()))
    return by


def _judge(by: dict[str, list[tuple[str, str, str]]], hosts: dict[str, list[tuple[str, str, str]]], names: list[str], again: bool):
    @B.lean
    def run(batches):
        compiled: dict[str, re.Pattern] = {}
        for b in batches:
            rules, patterns, verdicts = [], [], []
            before = zip(b.column("pattern").to_pylist(), b.column("pattern_action").to_pylist(), strict=True) if again else None
            for url, host, path in zip(*(b.column(c).to_pylist() for c in ("url", "host", "path")), strict=True):
                best = None
                labels = host.split(".") if host else []
                for k in range(len(labels)):
                    for r in hosts.get(".".join(labels[k:]), ()):
                        if path.startswith(r[1]) and (best is None or len(r[0]) > len(best[0])):
                            best = r
                hit = next(before) if again else (None, None)
                if hit[1] != "allow" and url:
                    low = url.lower()
                    for t in ("", *sorted(set(TOKEN.findall(low)))):
                        for text, action, regex in by.get(t, ()):
                            if hit[1] is None or (action, hit[1]) == ("allow", "block") or (action == hit[1] and text < hit[0]):
                                x = compiled.get(regex) or compiled.setdefault(regex, re.compile(regex, re.S))
                                if x.search(low):
                                    hit = text, action
                rules.append(best and best[0])
                patterns.append(hit)
                verdicts.append(best[2] if best else hit[1] or DEFAULT)
            cols = {"rule": rules, "verdict": verdicts, "pattern": [p[0] for p in patterns], "pattern_action": [p[1] for p in patterns]}
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(v, pa.string()) for v in cols.values())], names=[*names, *cols])

    return run


ADDED = ("host", "path", "rule", "verdict", "pattern", "pattern_action")


def judge(pages: DataFrame, hosts: list[HostRule], patterns: list[Pattern]) -> DataFrame:
    """``pages`` (with a ``url``) and host, path, rule (longest host rule or null), pattern (that matched, or null), verdict."""
    by_host: dict[str, list] = {}
    for r in hosts:
        by_host.setdefault(r.host, []).append((r.name, r.path, r.action))
    counts = token_counts(pages, patterns)
    out = pages.drop(*ADDED).withColumn("url", F.col("url").cast("string"))
    out = out.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    for k in range(0, max(1, len(patterns)), RULES_PER_PASS):
        names = [c for c in out.columns if c not in ADDED[2:]]
        schema = T.StructType([*(out.schema[c] for c in names), *(T.StructField(c, T.StringType()) for c in ADDED[2:])])
        out = out.mapInArrow(_judge(index(patterns[k : k + RULES_PER_PASS], counts), by_host, names, k > 0), schema)
    return out.drop("pattern_action")


HOST_RULES = [
    HostRule("org", "/", "allow"),
    HostRule("example.org", "/es/", "block"),
    HostRule("example.org", "/en/1", "block"),
    HostRule("com", "/fr/", "allow"),
    HostRule("com", "/de/", "block"),
]
PATTERNS = [
    *(Pattern(f"||{x}.") for x in ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")),
    *(Pattern(x) for x in ("^ads^", "^adserver^", "^popunder^", "/wp-login.php^", "^casino^", "^viagra^", "^xxx^", "*.exe|")),
    Pattern("||ads-track.*/robots.txt|", "allow"),
]

_rest = "substr(coalesce(url, ''), strpos(coalesce(url, ''), '://') + 3)"
_fits = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
_ranked = sorted(HOST_RULES, key=lambda r: -len(r.name))
_cases = " ".join(f"WHEN {_fits.format(r.host, r.path)} THEN '{r.name}'" for r in _ranked)
_actions = " ".join(f"WHEN '{r.name}' THEN '{r.action}'" for r in _ranked)


def _any(action: str) -> str:
    return " OR ".join("regexp_matches(lower(coalesce(url, '')), '(?s)" + p.regex().replace("\\-", "-") + "')" for p in PATTERNS if p.action == action)


SQL = f"""
WITH p AS (
  SELECT page_id, url,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract({_rest}, '^[^/?#]*'), '{UPPER}', '{LOWER}') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract({_rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
r AS (SELECT *, CASE {_cases} END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE rule {_actions} ELSE CASE WHEN {_any("allow")} THEN 'allow' WHEN {_any("block")} THEN 'block' ELSE '{DEFAULT}' END END AS verdict
FROM r
"""
