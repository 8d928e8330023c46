"""SentencePiece encoding that keeps source offsets, and decoding.

``Normaliser`` applies a model's compiled character map: at each position the longest prefix
found in its double-array trie is replaced, else one character is copied. Each normalised
byte remembers where its source began. The normalised text, not the source, is encoded, by a copy of the model
whose own normaliser is switched off. The pieces' lengths tile the normalised bytes, so every piece projects to a
span of the original bytes; the spans are contiguous and are kept as one list of boundaries.

A normalised text of more than ``PART`` characters is encoded in parts. It is cut only between two characters that
stand side by side in no piece of the vocabulary: no merge can cross such a place, so the parts' pieces are
those of the whole text. Without such a place the text stays whole. This holds for BPE; texts of other kinds of model stay whole.
Rows are taken in slices of about ``SLICE`` bytes, so Python objects live for one slice; a longer
text has its source, its normalised bytes and four bytes a normalised byte in memory, beside one part's pieces.

Defined cases: a null text is empty and has the end id only. Extra columns pass through; those
called like the added columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from lexmill.llm import bytesops as B

PART = 1 << 17
SLICE = 1 << 20
#: rows that ``decode`` takes at a time
DECODED = 256
MARK = "▁".encode()
#: kinds of a piece in a model
_UNKNOWN, _CONTROL, _SYMBOL, _BYTE = 2, 3, 4, 6
_BPE = 2


class Trie:
    """The double array of a compiled character map, with the replacement strings behind it."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], np.uint32).tolist()
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest key that ``data`` holds at ``at``."""
        units, pos, found = self.units, 0, None
        unit = units[0]
        pos ^= (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(data)):
            c = data[k]
            pos ^= c
            if pos >= len(units):
                break
            unit = units[pos]
            if unit & 0x800000FF != c:
                break
            pos ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                start = units[pos] & 0x7FFFFFFF
                found = k + 1 - at, start
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


class Normaliser:
    """``spec``: the model's normaliser; ``symbols``: its user-defined pieces, which are copied as they are."""

    def __init__(self, spec, symbols: list[str] = (), suffix: bool = False):
        self.trie = Trie(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.squeeze = spec.remove_extra_whitespaces
        self.space = MARK if spec.escape_whitespaces else b" "
        self.before = self.space if spec.add_dummy_prefix and not suffix else b""
        self.behind = self.space if spec.add_dummy_prefix and suffix else b""
        self.symbols = sorted((s.encode() for s in symbols), key=len, reverse=True)

    def plain(self) -> bool:
        """Whether nothing but spaces changes."""
        return self.trie is None and not self.squeeze and not self.symbols

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and the source position of each of them and of their end."""
        if not data:
            return b"", np.zeros(1, np.int32)
        return self._fast(data) if self.plain() else self._slow(data)

    def _fast(self, data: bytes) -> tuple[bytes, np.ndarray]:
        width = np.ones(len(data), np.int8)
        width[np.frombuffer(data, np.uint8) == 32] = len(self.space)
        at = np.repeat(np.arange(len(data), dtype=np.int32), width)
        edges = np.zeros(len(self.before), np.int32), at, np.full(len(self.behind) + 1, len(data), np.int32)
        return self.before + data.replace(b" ", self.space) + self.behind, np.concatenate(edges)

    def _step(self, data: bytes, at: int) -> tuple[int, bytes]:
        for s in self.symbols:
            if data.startswith(s, at):
                return len(s), s
        if self.trie is not None and (hit := self.trie.longest(data, at)):
            return hit
        c = data[at]
        n = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
        return n, data[at : at + n]

    def _slow(self, data: bytes) -> tuple[bytes, np.ndarray]:
        i, out, at = 0, bytearray(), []
        if self.squeeze:
            while i < len(data):
                n, text = self._step(data, i)
                if text != b" ":
                    break
                i += n
            if i == len(data):
                return b"", np.array([i], np.int32)
        out += self.before
        at += [i] * len(self.before)
        blank = self.squeeze
        while i < len(data):
            n, text = self._step(data, i)
            while blank and text.startswith(b" "):
                text = text[1:]
            if text:
                for c in text:
                    part = self.space if c == 32 else bytes([c])
                    out += part
                    at += [i] * len(part)
                blank = self.squeeze and text.endswith(b" ")
            i += n
        if self.squeeze:
            while out.endswith(self.space):
                i = at[len(out) - len(self.space)]
                del out[-len(self.space) :], at[-len(self.space) :]
        out += self.behind
        at += [i] * len(self.behind)
        return bytes(out), np.array([*at, i], np.int32)


class Model:
    def __init__(self, blob: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(blob)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        pieces = [(p.piece, p.type) for p in proto.pieces]
        self.normalise = Normaliser(proto.normalizer_spec, [p for p, kind in pieces if kind == _SYMBOL], proto.trainer_spec.treat_whitespace_as_suffix)
        self.width = np.array([1 if kind == _BYTE else 0 if kind == _CONTROL else len(p.encode()) for p, kind in pieces], np.int32)
        self.pairs = {p[k : k + 2] for p, _ in pieces for k in range(len(p) - 1)} if proto.trainer_spec.model_type == _BPE else None
        #: an unknown piece is as long as what it stands for
        self.unknown = None if proto.trainer_spec.byte_fallback else {k for k, (_, kind) in enumerate(pieces) if kind == _UNKNOWN}
        off = proto.normalizer_spec
        off.precompiled_charsmap, off.name = b"", "identity"
        off.add_dummy_prefix = off.remove_extra_whitespaces = off.escape_whitespaces = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.end = np.array([self.library.eos_id()], np.int32)

    def cut(self, text: str) -> list[str]:
        """Parts of ``PART`` characters or more of a normalised text, none cut where a piece may stand."""
        parts, at, k = [], 0, PART
        while k < len(text):
            if self.pairs is not None and text[k - 1 : k + 1] not in self.pairs:
                parts.append(text[at:k])
                at, k = k, k + PART
            else:
                k += 1
        return [*parts, text[at:]]

    def _pieces(self, texts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, widths in bytes) of normalised texts."""
        for ids in self.bare.encode(texts, num_threads=1):
            x = np.array(ids, np.int32)
            yield x, self.width[x]

    def _named(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for models with unknown pieces."""
        for t in texts:
            x = np.array(self.bare.encode(t), np.int32)
            names = self.bare.encode(t, out_type=str)
            yield x, np.array([len(p.encode()) if int(i) in self.unknown else self.width[i] for i, p in zip(x, names, strict=True)], np.int32)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids, the end id last, and the boundaries of the pieces: piece i is bytes [b[i], b[i + 1]) of the original text."""
        known = self._pieces if self.unknown is None else self._named
        normal = [self.normalise(t.encode()) for t in texts]
        short = [k for k, (n, _) in enumerate(normal) if len(n) <= PART]
        held = dict(zip(short, known([normal[k][0].decode() for k in short]), strict=True)) if short else {}
        out = []
        for k, (norm, at) in enumerate(normal):
            if k in held:
                ids, width = held.pop(k)
            else:
                found = [next(iter(known([p]))) for p in self.cut(norm.decode())]
                ids, width = (np.concatenate(x) for x in zip(*found, strict=True))
            ends = np.zeros(len(ids) + 2, np.int32)
            np.cumsum(width, out=ends[1:-1])
            ends[-1] = ends[-2]
            if ends[-1] != len(norm):
                raise ValueError("the pieces don't tile the normalised text")
            out.append((np.concatenate([ids, self.end]), at[ends]))
        return out


@cache
def model(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


ADDED = {"ids": T.ArrayType(T.IntegerType()), "boundaries": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}


def _kernel(path: str, keep: list[str], text: str, decode: bool):
    @B.lean
    def run(batches):
        m = model(path)
        for whole in batches:
            for lo, hi, _, _ in B.slices(whole.column(text), SLICE):
                b = whole.slice(lo, hi - lo)
                found = m.encode([t or "" for t in b.column(text).to_pylist()])
                cols = [_lists([ids for ids, _ in found]), _lists([spans for _, spans in found])]
                if decode:
                    cols.append(pa.array([m.library.decode(ids.tolist()) for ids, _ in found], pa.string()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], names=[*keep, *list(ADDED)[: len(cols)]])

    return run


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(arrays).astype(np.int32, copy=False)))


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, decode: bool = False) -> DataFrame:
    """The ``keep`` columns (all but clashing ones by default) and ids, boundaries (bytes of the original text, one more than ids), and with ``decode`` the text decoded from the ids.

    ``path``: the model's file, on every executor.
    """
    keep = keep if keep is not None else [c for c in docs.columns if c not in ADDED]
    inputs = docs.select(*dict.fromkeys([*keep, text])).withColumn(text, F.col(text).cast("string"))
    names = list(ADDED)[: 3 if decode else 2]
    schema = T.StructType([*(inputs.schema[c] for c in keep), *(T.StructField(c, ADDED[c]) for c in names)])
    return inputs.mapInArrow(_kernel(path, keep, text, decode), schema)


def decode(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``decoded``; null ids decode to an empty text."""
    inputs = docs.drop("decoded")

    @B.lean
    def run(batches):
        m = model(path)
        for b in batches:
            for lo in range(0, b.num_rows, DECODED):
                part = b.slice(lo, DECODED)
                got = m.library.decode([x or [] for x in part.column(ids).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.string())], names=[*part.schema.names, "decoded"])

    return inputs.mapInArrow(run, T.StructType([*inputs.schema.fields, T.StructField("decoded", T.StringType())]))


def report(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids, of the decoded text and of the pieces' byte boundaries, by document."""
    found = encode(docs, path, keep=["doc_id"], decode=True)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2(F.concat_ws(" ", F.col("boundaries").cast("array<string>")), 256).alias("boundaries_sha256"),
    )
