"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are word sequences: A-Z lower-cased, then runs of digits, a-z and
non-ASCII characters. The automaton recognises every run of words of every item. Training
words are streamed through it, tracking the longest match that ends at each word: a match of
at least ``WINDOW`` words makes the last ``WINDOW`` of them a hit and names the items that
hold this window. An item shorter than the window, but not empty, must occur as a whole.

A word that no item holds takes the automaton back to its root. Runs of known words that are
shorter than the shortest window can't hold a hit and are skipped without a step.

The automaton is broadcast, so its size is bounded: items are dealt out by hash into shards of
about ``SHARD_BYTES`` of text, each with an automaton of its own, and documents pass through
one shard after the other. Documents are never shuffled.

Defined cases: a null text has no words. Items without words, or with a null id and hence
nothing to report, match nothing. Items of equal id count once. Extra columns pass through.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.arrays import let
from lexmill.llm import bytesops as B
from lexmill.llm.scratch import Scratch

WINDOW = 8
SHARD_BYTES = 16 << 20
#: Share of hit words from which ``clean`` drops a document whole.
COVERAGE = 0.5
ITEMS = 2


def item_words(text: str | None) -> np.ndarray:
    data, at = B.buffer(pa.array([text], pa.string()))
    s, e, _ = B.words(data, at, B.WORD)
    return B.hashes(data, s, e)[0]


class Automaton:
    """Suffix automaton of all items in flat arrays; states are indices, 0 is the root.

    Most states have one way on: its word and target stand in ``word`` and ``goal``. Further ways are in ``more`` while
    items are added, then in ``ways``, sorted numbers of (state, word), and ``goals``.
    ``at_window[v]`` is the state of the last ``window`` words at v, 0 where fewer are known; the items that hold that
    window are ``items[holders[k]]`` for k from ``first[at]`` to ``first[at + 1]``, where ``at`` numbers the window
    states. ``short[v]`` is the nearest state on the way to the root at which a shorter item is complete.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        texts = [(i, h) for i, t in items if i is not None and len(h := item_words(t))]
        self.window = window
        self.vocab = np.unique(np.concatenate([h for _, h in texts])) if texts else np.zeros(0, np.uint64)
        self.items = sorted({str(i) for i, _ in texts})
        number = {i: k for k, i in enumerate(self.items)}
        runs = [(number[str(i)], np.searchsorted(self.vocab, h).astype(np.int32)) for i, h in texts]
        self.word, self.goal = array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.size = array("i", [-1]), array("i", [0])
        for _, run in runs:
            last = 0
            for c in run.tolist():
                last = self._extend(last, c)
        ways = sorted(((v << 32) | c, to) for v, more in self.more.items() for c, to in more.items())
        self.ways, self.goals = array("q", [w for w, _ in ways]), array("i", [to for _, to in ways])
        self.forks = bytearray(len(self.size))
        for v in self.more:
            self.forks[v] = 1
        del self.more, ways
        link, size = np.frombuffer(self.link, np.int32), np.frombuffer(self.size, np.int32)
        parent = np.maximum(link, 0)
        own = (size >= window) & (size[parent] < window)
        self.at_window = array("i", _nearest(own, parent).tobytes())
        pairs, ends = [], []
        for i, run in runs:
            v, n = 0, len(run)
            for k, c in enumerate(run.tolist()):
                v = self.step(v, c)
                if k + 1 >= window:
                    pairs.append((self.at_window[v] << 32) | i)
            if n < window:
                ends.append((v, n, i))
        del link, size
        both = np.unique(np.array(pairs, np.int64))
        states, first = np.unique(both >> 32, return_index=True)
        self.states = states.astype(np.int32)
        self.first = np.append(first, len(both)).astype(np.int32)
        self.holders = (both & 0xFFFFFFFF).astype(np.int32)
        self.ends: dict[int, list[tuple[int, int]]] = {}
        for v, n, i in sorted(set(ends)):
            self.ends.setdefault(v, []).append((n, i))
        short = np.zeros(len(parent), bool)
        short[list(self.ends)] = True
        self.short = array("i", _nearest(short, parent).tobytes())
        self.least = min([window, *(len(run) for _, run in runs)])

    def step(self, v: int, c: int) -> int:
        """The state behind word c, or -1."""
        if self.word[v] == c:
            return self.goal[v]
        if not self.forks[v]:
            return -1
        way = (v << 32) | c
        k = bisect_left(self.ways, way)
        return self.goals[k] if k < len(self.ways) and self.ways[k] == way else -1

    def _way(self, v: int, c: int) -> int:
        """``step`` while items are added."""
        if self.word[v] == c:
            return self.goal[v]
        more = self.more.get(v)
        return -1 if more is None else more.get(c, -1)

    def _put(self, v: int, c: int, to: int) -> None:
        if self.word[v] in (c, -1):
            self.word[v], self.goal[v] = c, to
        else:
            self.more.setdefault(v, {})[c] = to

    def _add(self, size: int, link: int) -> int:
        self.word.append(-1)
        self.goal.append(0)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _extend(self, p: int, c: int) -> int:
        size, link = self.size, self.link
        q = self._way(p, c)
        if q >= 0:
            return q if size[q] == size[p] + 1 else self._clone(p, c, q)
        v = self._add(size[p] + 1, 0)
        while p >= 0 and (q := self._way(p, c)) < 0:
            self._put(p, c, v)
            p = link[p]
        if p >= 0:
            link[v] = q if size[q] == size[p] + 1 else self._clone(p, c, q)
        return v

    def _clone(self, p: int, c: int, q: int) -> int:
        k = self._add(self.size[p] + 1, self.link[q])
        self.word[k], self.goal[k] = self.word[q], self.goal[q]
        if q in self.more:
            self.more[k] = dict(self.more[q])
        self.link[q] = k
        while p >= 0 and self._way(p, c) == q:
            self._put(p, c, k)
            p = self.link[p]
        return k

    def nbytes(self) -> int:
        """What the automaton's arrays take in memory."""
        flat = (self.word, self.goal, self.link, self.size, self.at_window, self.short)
        return sum(len(x) * 4 for x in flat) + self.vocab.nbytes + self.states.nbytes + self.first.nbytes + self.holders.nbytes + 12 * len(self.ways) + len(self.forks)

    def stream(self, words: list[int], hit: np.ndarray, base: int, found: set[int]) -> None:
        """Track the longest match over ``words``; mark hits in ``hit[base:]`` and add the items' numbers to ``found``."""
        link, size, window, step = self.link, self.size, self.window, self.step
        windows: set[int] = set()
        v = n = 0
        for k, c in enumerate(words, base + 1):
            while (t := step(v, c)) < 0 and v:
                v = link[v]
                n = size[v]
            if t >= 0:
                v = t
                n += 1
            if n >= window:
                hit[k - window : k] = True
                windows.add(self.at_window[v])
            if w := self.short[v]:
                while w:
                    for m, i in self.ends[w]:
                        if m <= n:
                            hit[k - m : k] = True
                            found.add(i)
                    w = self.short[link[w]]
        for at in np.searchsorted(self.states, sorted(windows)).tolist():
            found.update(self.holders[self.first[at] : self.first[at + 1]].tolist())

    def scan(self, col):
        """For each row: number of words, hit words, item ids, spans of hit words in bytes (start, end, start, end, ...)."""
        for lo, hi, data, at in B.slices(col):
            s, e, row = B.words(data, at, B.WORD)
            h = B.hashes(data, s, e)[0]
            hit = np.zeros(len(h), bool)
            found: dict[int, set[int]] = {}
            if len(self.vocab) and len(h):
                word = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
                known = self.vocab[word] == h
                edge = np.ones(len(h), bool)
                edge[1:] = (known[1:] != known[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(edge)
                length = np.diff(np.append(first, len(h)))
                for a, n in zip(first[t := known[first] & (length >= self.least)], length[t], strict=True):
                    self.stream(word[a : a + n].tolist(), hit, int(a), found.setdefault(int(row[a]), set()))
            n_words = np.bincount(row, minlength=hi - lo)
            n_hit = np.bincount(row[hit], minlength=hi - lo)
            cut = B.bounds(row, hi - lo)
            for i in range(hi - lo):
                spans: list[int] = []
                if n_hit[i]:
                    a = cut[i]
                    flag = np.concatenate([[False], hit[a : cut[i + 1]], [False]])
                    flip = np.flatnonzero(flag[1:] != flag[:-1])
                    for x, y in zip(flip[::2], flip[1::2], strict=True):
                        spans += [int(s[a + x] - at[i]), int(e[a + y - 1] - at[i])]
                yield int(n_words[i]), int(n_hit[i]), [self.items[k] for k in sorted(found.get(i, ()))], spans


def _nearest(flag: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """For each state, the nearest flagged one on the way to the root (itself included), 0 if there is none. By doubling."""
    to = np.where(flag, np.arange(len(flag)), parent).astype(np.int32)
    while True:
        nxt = to[to]
        if (nxt == to).all():
            return np.where(flag[to], to, 0).astype(np.int32)
        to = nxt


def _merge(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for s, e in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _count(text: str, spans: list[int]) -> int:
    raw = text.encode()
    return sum(len(B.words(np.frombuffer(raw[s:e], np.uint8), np.array([0, e - s]), B.WORD)[0]) for s, e in zip(spans[::2], spans[1::2], strict=True))


ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("hit_bytes", T.ArrayType(T.LongType()))])


def _kernel(shared, again: bool, keep: list[str]):
    @B.lean
    def run(batches):
        automaton = shared.value
        for b in batches:
            got = list(automaton.scan(b.column("text")))
            if again:  # join with what earlier shards found
                for k, (t, ids, spans) in enumerate(zip(b.column("text"), b.column("item_ids").to_pylist(), b.column("hit_bytes").to_pylist(), strict=True)):
                    if ids:
                        n, _, more, other = got[k]
                        both = _merge(spans, other)
                        got[k] = n, _count(t.as_py(), both), sorted({*ids, *more}), both
            n, hit, ids, spans = zip(*got, strict=True) if got else ((),) * 4
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))], names=[*keep, *ADDED.fieldNames()])

    return run


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` (with a ``text``) and n_words, n_hit, item_ids (sorted as strings), hit_bytes (start, end, ...).

    ``items``: item_id, text. Columns of ``docs`` that clash with the added ones are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*ADDED.fieldNames())
    items = items.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    scratch = Scratch(spark, "leaks") if shards > 1 else None
    for k in range(shards):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        shared = spark.sparkContext.broadcast(Automaton([tuple(r) for r in part.collect()], window))
        keep = [c for c in docs.columns if c not in ADDED.fieldNames()]
        schema = T.StructType([*(docs.schema[c] for c in keep), *ADDED.fields])
        docs = docs.mapInArrow(_kernel(shared, k > 0, keep), schema)
        if k + 1 < shards:
            docs = scratch.table(docs, f"shard-{k}")
    return docs


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest columns of ``find_leaks``, by document."""
    found = find_leaks(docs.select("doc_id", "text"), items)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.size("item_ids") >= ITEMS).alias("contaminated"))


#: the text without its hit bytes: what lies before each hit span, and behind the last
_CUT = f"""CASE WHEN size(hit_bytes) > 0 THEN {let("_b", "cast(text AS binary)", """concat(
  array_join(transform(sequence(0, size(hit_bytes) div 2 - 1), k -> cast(substring(_b, cast(CASE WHEN k > 0 THEN hit_bytes[2 * k - 1] ELSE 0 END AS int) + 1,
    cast(hit_bytes[2 * k] - CASE WHEN k > 0 THEN hit_bytes[2 * k - 1] ELSE 0 END AS int)) AS string)), ''),
  cast(substring(_b, cast(element_at(hit_bytes, -1) AS int) + 1) AS string))""")} ELSE text END"""


def clean(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without leaked text: a document with ``ITEMS`` items or more, or of whose words a share of ``coverage`` or more is hit, goes; from others the hit spans are cut."""
    found = find_leaks(docs, items).where((F.size("item_ids") < ITEMS) & (F.col("n_hit") < coverage * F.greatest("n_words", F.lit(1))))
    cut = found.withColumn("text", F.expr(_CUT)).select(*docs.columns)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut


SQL = r"""
WITH it AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 8) AS k, array_to_string(ws[j:j + least(len(ws), 8) - 1], ' ') AS win
  FROM it, unnest(range(1, len(ws) - least(len(ws), 8) + 2)) AS t(j) WHERE len(ws) > 0),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
found AS (
  SELECT x.doc_id, x.p, x.k, x.win FROM (
    SELECT doc_id, k, p, array_to_string(ws[p:p + k - 1], ' ') AS win
    FROM d, (SELECT DISTINCT k FROM win) AS ks, unnest(range(1, len(ws) - k + 2)) AS t(p)) AS x
  SEMI JOIN win USING (k, win)),
hits AS (SELECT doc_id, count(DISTINCT p + o) AS n_hit FROM found, unnest(range(k)) AS t(o) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found JOIN win USING (k, win)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids.ids, '')) AS items_sha256,
       coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
