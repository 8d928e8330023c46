"""Tokens by arrays (P1-P4, P26, W5): kernels that take many texts apart at once.

What belongs to a token follows from a character and its neighbours, so whole blocks of texts are classed by a table and
cut where runs begin and end. Only tokens leave the kernel, not the lines around them.
"""

from __future__ import annotations

import unicodedata
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions import chars

#: bytes of text that are taken apart at once; a longer text is a block of its own
BLOCK = 1 << 20
_LETTER, _MARK, _APOSTROPHE, _BACKSLASH, _DIGIT, _UNDERSCORE, _HYPHEN, _SIGN, _ANY = (1 << k for k in range(9))
_table: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The classes of all characters, built once in a worker."""
    if not _table:
        t = np.zeros(0x110000, np.uint16)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            if kind == "L":
                t[c] = _LETTER | _ANY
            elif kind == "M":
                t[c] = _MARK
        for a, b in chars._SPANS:
            t[a : b + 1] &= ~np.uint16(_LETTER)
        for s, kind in ((chars.APOSTROPHES, _APOSTROPHE), ("\\", _BACKSLASH), ("0123456789", _DIGIT), ("_", _UNDERSCORE), ("-", _HYPHEN), ("`.+", _SIGN)):
            for c in s:
                t[ord(c)] = kind
        _table.append(t)
    return _table[0]


def _before(a: np.ndarray, n: int = 1) -> np.ndarray:
    out = np.zeros_like(a)
    out[n:] = a[:-n]
    return out


def _after(a: np.ndarray, n: int = 1) -> np.ndarray:
    out = np.zeros_like(a)
    out[:-n] = a[n:]
    return out


def _runs(c: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Where tokens begin and end, as the patterns of ``chars`` find them."""
    has = lambda bits: (c & bits) != 0
    letter, mark, apostrophe, backslash = has(_LETTER), has(_MARK), has(_APOSTROPHE), has(_BACKSLASH)
    first = None
    if kind == "words":
        core = letter | mark & _before(letter)
        inner = apostrophe & _after(letter) & (_before(core) | _before(backslash) & _before(core, 2))
        inside = core | inner | backslash & _before(core) & _after(apostrophe) & _after(letter, 2)
    elif kind == "code":
        core = has(_LETTER | _DIGIT | _UNDERSCORE | _HYPHEN)
        core |= mark & _before(core)
        inside, first = core | apostrophe & _after(letter) & _before(core), has(_LETTER | _UNDERSCORE)
    else:
        first = has(_ANY | _DIGIT | _UNDERSCORE | _APOSTROPHE | _HYPHEN | _SIGN)
        inside = first | mark | backslash & _after(apostrophe)
    edges = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if first is not None:  # a run may begin with what only continues a token
        places = np.append(np.flatnonzero(first), len(c))
        start = places[np.searchsorted(places, start)]
        start, end = start[start < end], end[start < end]
    return start, end


class Block:
    """The tokens of some texts: text (its number), start and end (characters), bytes (places of characters), and words."""

    def __init__(self, raw: list[bytes], kind: str, least: int = 1):
        self.data = b"\n".join(raw)
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        self.begin = np.concatenate([[0], np.cumsum(n + 1)[:-1]])
        if self.data.isascii():
            self.points, self.at = np.frombuffer(self.data, np.uint8), None
            own = self.begin
        else:
            # bytes that are no text stay single characters of no class
            self.points = p = np.frombuffer(self.data.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
            width = 1 + (p >= 0x80).view(np.int8) + (p >= 0x800) + (p >= 0x10000)
            width[(p >= 0xDC80) & (p <= 0xDCFF)] = 1
            self.at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
            own = np.searchsorted(self.at, self.begin)
        start, end = _runs(classes()[self.points], kind)
        keep = end - start >= least
        if kind == "possible":
            keep &= ~self._numeric(start, end)
        self.own, self.start, self.end = own, start[keep], end[keep]
        self.text = np.searchsorted(own, self.start, side="right") - 1

    def _numeric(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of digits, signs and e; those alone meet the pattern."""
        out = np.zeros(len(start), bool)
        few = np.isin(self.points, np.frombuffer(b"0123456789+-.eE", np.uint8))
        total = np.concatenate([[0], np.cumsum(few)])
        for k in np.flatnonzero(total[end] - total[start] == end - start):
            out[k] = chars.PY_NUMERIC.match("".join(map(chr, self.points[start[k] : end[k]]))) is not None
        return out

    def take(self, keep: np.ndarray) -> None:
        self.start, self.end, self.text = self.start[keep], self.end[keep], self.text[keep]

    def bytes_of(self, places: np.ndarray) -> np.ndarray:
        return places if self.at is None else self.at[places]

    def words(self) -> pa.StringArray:
        s, e = self.bytes_of(self.start), self.bytes_of(self.end)
        mark = np.zeros(len(self.data) + 1, np.int8)
        mark[s] += 1
        mark[e] -= 1
        held = np.frombuffer(self.data, np.uint8)[np.cumsum(mark, dtype=np.int8)[:-1].view(bool)]
        offsets = np.concatenate([[0], np.cumsum(e - s)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(s), pa.py_buffer(offsets.tobytes()), pa.py_buffer(held.tobytes()))

    def places(self) -> list[pa.Array]:
        """line, offset, column of each token."""
        breaks = np.flatnonzero(self.points == 10)
        line = np.searchsorted(breaks, self.start)
        begin = np.concatenate([[0], breaks + 1])[line]
        ahead = np.searchsorted(breaks, self.own)[self.text]
        return [pa.array((line - ahead + 1).astype(np.int32)), pa.array(self.bytes_of(self.start) - self.begin[self.text]), pa.array((self.start - begin + 1).astype(np.int32))]


def blocks(batch: pa.RecordBatch, text: str, most: int = BLOCK):
    """(first row, texts as bytes) of pieces of a batch."""
    at, raw, size = 0, [], 0
    for k, x in enumerate(batch.column(text).cast(pa.binary())):
        raw.append(x.as_py() or b"")
        size += len(raw[-1])
        if size >= most:
            yield at, raw
            at, raw, size = k + 1, [], 0
    if raw:
        yield at, raw


def _kernel(docs: DataFrame, keys: list[str], text: str, columns: str, make) -> DataFrame:
    """Rows of ``make(raw)``: the texts' numbers and the columns, with the texts' keys."""
    out = T.StructType([*(docs.schema[k] for k in keys), *T._parse_datatype_string(columns).fields])

    def run(batches):
        for b in batches:
            for at, raw in blocks(b, text):
                own, arrays = make(raw)
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(own + at)) for k in keys), *arrays], names=out.names)

    return docs.select(*keys, text).mapInArrow(run, out)


def tokens(docs: DataFrame, *keys: str, kind: str = "words", text: str = "text", least: int = 1) -> DataFrame:
    """(keys, line, offset, column, word) of tokens of ``least`` characters or more."""

    def make(raw):
        b = Block(raw, kind, least)
        return b.text, [*b.places(), b.words()]

    return _kernel(docs, list(keys), text, "line int, offset bigint, column int, word string", make)


def words(docs: DataFrame, *keys: str, text: str = "text", least: int = 1) -> DataFrame:
    """(keys, word, n): the distinct words of each text and how often they stand there."""

    def make(raw):
        b = Block(raw, "words", least)
        coded = b.words().dictionary_encode()
        size = max(len(coded.dictionary), 1)
        pairs, n = np.unique(b.text * size + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
        return pairs // size, [coded.dictionary.take(pa.array(pairs % size)), pa.array(n)]

    return _kernel(docs, list(keys), text, "word string, n bigint", make)


#: words of which Arrow and Python make the same lower case, that are their own NFC and have one form (no backslash, no U+2019)
PLAIN = r"^[^\\\x{130}\x{300}-\x{10FFFF}]*$"


def lowered(distinct: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words in lower case as Python has it, and which are ``PLAIN``; only the others pass through Python."""
    plain = pc.match_substring_regex(distinct, PLAIN)
    own = plain.to_numpy(zero_copy_only=False)
    low = pc.utf8_lower(distinct)
    if not own.all():
        rest = pa.array([w.lower() for w in distinct.filter(pc.invert(plain)).to_pylist()], pa.string())
        low = pc.replace_with_mask(low, pc.invert(plain), rest)
    return low, own


class Known:
    """M10 for kernels: whether some dictionary holds a word directly, in any of its forms."""

    _held: dict[str, tuple] = {}

    def __init__(self, spark, rows: list[tuple]):
        same = {key for _, kind, key, _ in rows if kind in ("exact", "word")}
        low = {key for _, kind, key, _ in rows if kind in ("word", "non_strict")}
        self.name, self.shared = uuid.uuid4().hex, spark.sparkContext.broadcast((same, low))

    def mask(self, distinct: pa.Array, small: pa.Array | None = None, plain: np.ndarray | None = None) -> np.ndarray:
        """``small``, ``plain``: what ``lowered`` gives for the words, if known."""
        if self.name not in Known._held:
            Known._held.clear()
            Known._held[self.name] = *self.shared.value, *(pa.array(sorted(x), pa.string()) for x in self.shared.value)
        same, low, exact, folded = Known._held[self.name]

        def known(w: str) -> bool:
            if w in same or w.isascii() and "\\" not in w:
                return w in same or w.lower() in low
            forms = (unicodedata.normalize("NFC", x) for x in {w, w.replace("’", "'"), w.replace("\\", "")} if x)
            return any(x in same or x.lower() in low for x in forms)

        if small is None:
            small, plain = lowered(distinct)
        out = pc.or_(pc.is_in(distinct, value_set=exact), pc.is_in(small, value_set=folded)).to_numpy(zero_copy_only=False).copy()
        rest = np.flatnonzero(~plain)
        out[rest] = np.fromiter(map(known, distinct.take(pa.array(rest)).to_pylist()), bool, len(rest))
        return out


def unknown(docs: DataFrame, known: Known, *keys: str, text: str = "text", least: int = 4) -> DataFrame:
    """(keys, word, n): as ``words``, of unknown words."""

    def make(raw):
        b = Block(raw, "words", least)
        coded = b.words().dictionary_encode()
        size, index = max(len(coded.dictionary), 1), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        keep = ~known.mask(coded.dictionary)[index]
        pairs, n = np.unique(b.text[keep] * size + index[keep], return_counts=True)
        return pairs // size, [coded.dictionary.take(pa.array(pairs % size)), pa.array(n)]

    return _kernel(docs, list(keys), text, "word string, n bigint", make)


def _distinct(a: np.ndarray) -> np.ndarray:
    """The distinct ones of numbers from 0, in order, by sorting; ``np.unique`` hashes them, which takes several times as long."""
    a = np.sort(a)
    return a[np.diff(a, prepend=-1) != 0]


def _ranks(group: np.ndarray) -> np.ndarray:
    """For each element its number, from 1, among the equal ones up to it."""
    order = np.argsort(group, kind="stable")
    ordered = group[order]
    head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(group) else np.zeros(0, np.int64)
    out = np.empty(len(group), np.int64)
    out[order] = np.arange(len(group)) - np.repeat(head, np.diff(np.append(head, len(group)))) + 1
    return out


class _Found:
    """Unknown words of some texts, ``most`` of one spelling in a text: block of their tokens, distinct words, their lower case, and a number of each token's word in both."""

    def __init__(self, raw: list[bytes], known: Known, most: int, least: int):
        self.block = b = Block(raw, "words", least)
        coded = b.words().dictionary_encode()
        self.words, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.size = max(len(self.words), 1)
        self.small, self.plain = lowered(self.words)
        keep = ~known.mask(self.words, self.small, self.plain)[index]
        b.take(keep)
        index = index[keep]
        nth = _ranks(b.text * self.size + index)
        keep = nth <= most
        b.take(keep)
        self.nth, self.index = nth[keep], index[keep]
        self.low = self.small.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def place(self) -> np.ndarray:
        """Of each token, its number among its text's."""
        return np.arange(len(self.index)) - np.searchsorted(self.block.text, self.block.text) + 1

    def news(self) -> np.ndarray:
        """Which tokens are the first of their word, in any case, in their text."""
        out = np.zeros(len(self.index), bool)
        out[np.unique(self.block.text * self.size + self.low[self.index], return_index=True)[1]] = True
        return out


def issues(docs: DataFrame, known: Known, most: int, *keys: str, text: str = "text", least: int = 4, few: int | None = None) -> DataFrame:
    """(keys, line, offset, column, word, nth, place, news): unknown words, ``most`` of one spelling in a text and ``few`` in all.

    ``nth``: of its spelling in the text; ``place``: among the text's rows here; ``news``: the first of its word in any case.
    """

    def make(raw):
        x = _Found(raw, known, most, least)
        arrays = x.nth.astype(np.int32), x.place(), x.news()
        if few is not None:
            keep = arrays[1] <= few
            x.block.take(keep)
            x.index, arrays = x.index[keep], [a[keep] for a in arrays]
        return x.block.text, [*x.block.places(), x.words.take(pa.array(x.index)), *map(pa.array, arrays)]

    return _kernel(docs, list(keys), text, "line int, offset bigint, column int, word string, nth int, place bigint, news boolean", make)


def _keyed(batch: pa.RecordBatch, key: str, at: int, n: int) -> np.ndarray:
    return batch.column(key).slice(at, n).is_valid().to_numpy(zero_copy_only=False)


#: bytes of text whose issues are counted at once
WIDE = 4 << 20


def first_issues(docs: DataFrame, known: Known, most: int, key: str, folded: bool, text: str = "text", least: int = 4) -> DataFrame:
    """(path, line, column, word, n, files, heads): of the issues of each block of texts, the first of each word by path (``key`` as a string, null first) and place.

    ``n``: how many there are; ``files``: texts that hold the word in any case, each counted with one of the spellings; ``heads``: texts whose
    first issue is among them. Texts without a key are no files. Words are spellings; ``folded``: those that differ by case only are one, but for odd words (``PLAIN``), which SQL may fold otherwise.
    """
    names = ["path", "line", "column", "word", "n", "files", "heads"]

    def run(batches):
        for batch in batches:
            paths = batch.column(key).cast(pa.string())
            for at, raw in blocks(batch, text, WIDE):
                x = _Found(raw, known, most, least)
                b, own = x.block, paths.slice(at, len(raw))
                group = np.where(x.plain, x.low, x.size + np.arange(len(x.words))) if folded else np.arange(len(x.words))
                group = group[x.index]
                rank = np.empty(len(raw), np.int64)
                rank[pc.sort_indices(own, null_placement="at_start").to_numpy()] = np.arange(len(raw))
                order = np.argsort(rank[b.text], kind="stable")[::-1]
                first = np.full(2 * x.size, -1)
                first[group[order]] = order  # of equal groups, the last one set stays: the first token
                held = np.flatnonzero(first >= 0)
                count = lambda g: pa.array(np.bincount(g, minlength=2 * x.size)[held])
                file = _keyed(batch, key, at, len(raw))[b.text]
                n, files, heads = count(group), count(group[file & x.news()]), count(group[file & (x.place() == 1)])
                kept = first[held]
                b.take(kept)
                line, _, column = b.places()
                yield pa.RecordBatch.from_arrays([own.take(pa.array(b.text)), line, column, x.words.take(pa.array(x.index[kept])), n, files, heads], names=names)

    return docs.select(key, text).mapInArrow(run, "path string, line int, column int, word string, n bigint, files bigint, heads bigint")


def issue_counts(docs: DataFrame, known: Known, most: int, key: str, text: str = "text", least: int = 4) -> DataFrame:
    """(files, n): how many texts with a key have issues, and how many issues there are, of each block of texts."""

    def run(batches):
        for batch in batches:
            for at, raw in blocks(batch, text, WIDE):
                own = _Found(raw, known, most, least).block.text
                files = np.count_nonzero(_keyed(batch, key, at, len(raw))[_distinct(own)])
                yield pa.RecordBatch.from_arrays([pa.array([files]), pa.array([len(own)])], names=["files", "n"])

    return docs.select(key, text).mapInArrow(run, "files bigint, n bigint")


_ITEM = pa.struct([("column", pa.int32()), ("forbidden", pa.bool_()), ("line", pa.int32()), ("offset", pa.int64()), ("suggestions", pa.list_(pa.string())), ("word", pa.string())])


def issue_lists(docs: DataFrame, known: Known, most: int, key: str, text: str = "text", least: int = 4) -> DataFrame:
    """K3: (path, issues) of texts with issues, in order, as ``reports.json_files`` lists them."""

    def run(batches):
        for batch in batches:
            paths = batch.column(key).cast(pa.string())
            for at, raw in blocks(batch, text):
                x = _Found(raw, known, most, least)
                line, offset, column = x.block.places()
                own, head = np.unique(x.block.text, return_index=True)
                none = pa.ListArray.from_arrays(pa.array(np.zeros(len(x.index) + 1, np.int32)), pa.array([], pa.string()))
                parts = [column, pa.array(np.zeros(len(x.index), bool)), line, offset, none, x.words.take(pa.array(x.index))]
                items = pa.StructArray.from_arrays(parts, fields=list(_ITEM))
                yield pa.RecordBatch.from_arrays([paths.take(pa.array(own + at)), pa.ListArray.from_arrays(pa.array(np.append(head, len(x.index)).astype(np.int32)), items)], names=["path", "issues"])

    return docs.select(key, text).mapInArrow(run, "path string, issues array<struct<column:int,forbidden:boolean,line:int,offset:bigint,suggestions:array<string>,word:string>>")


def words_counted(docs: DataFrame, key: str, text: str = "text", least: int = 1) -> DataFrame:
    """(word, n, texts): the distinct words of each block of texts, how often they stand there and in how many texts with a key."""

    def run(batches):
        for batch in batches:
            for at, raw in blocks(batch, text, WIDE):
                b = Block(raw, "words", least)
                coded = b.words().dictionary_encode()
                size, index = max(len(coded.dictionary), 1), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                pairs = _distinct(b.text * size + index)
                held = pairs[_keyed(batch, key, at, len(raw))[pairs // size]] % size
                n, texts = (np.bincount(x, minlength=len(coded.dictionary)) for x in (index, held))
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n), pa.array(texts)], names=["word", "n", "texts"])

    return docs.select(key, text).mapInArrow(run, "word string, n bigint, texts bigint")


def words_outside(docs: DataFrame, *keys: str, ranges: str = "ranges", text: str = "text") -> DataFrame:
    """(keys, word, n): as ``words``, of words that begin in none of the text's sorted, merged byte ranges."""
    out = T.StructType([*(docs.schema[k] for k in keys), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches):
        for batch in batches:
            held = batch.column(ranges)
            for at, raw in blocks(batch, text):
                b = Block(raw, "words")
                own = held.slice(at, len(raw))
                # a null list has no ranges; what it may hide is dropped by flatten, so counts come from the lengths
                n = own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                spans, shift = own.flatten(), np.repeat(b.begin, n)
                s, e = (spans.field(k).to_numpy(zero_copy_only=False) + shift for k in ("s", "e"))
                place = b.bytes_of(b.start)
                last = np.searchsorted(s, place, side="right") - 1
                b.take(~((last >= 0) & (place < e[last])) if len(s) else np.ones(len(place), bool))
                coded = b.words().dictionary_encode()
                size = max(len(coded.dictionary), 1)
                pairs, times = np.unique(b.text * size + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(pairs // size + at)) for k in keys), coded.dictionary.take(pa.array(pairs % size)), pa.array(times)], names=out.names)

    return docs.select(*keys, text, ranges).mapInArrow(run, out)


def repeated(docs: DataFrame, *keys: str) -> bool:
    """Whether several rows share their keys."""
    return not docs.groupBy(*keys).count().where("count > 1").isEmpty()
