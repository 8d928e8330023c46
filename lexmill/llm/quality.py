"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each text gives a vector of statistics (lengths, character classes, repetition), each
transformed towards a normal shape. For both classes the mean and covariance are gathered over all
labelled rows of the training folds; a covariance is shrunk towards the pooled one and towards its diagonal.
A document's score is the logistic of the difference of the classes' log densities plus log
priors. Mahalanobis distances are squared lengths under the inverse of each class's Cholesky factor, which is lower
triangular and computed once with the model.

Training sees labels of rows whose crc32(doc_id as text) modulo ``FOLDS`` is not 0, at most about ``TRAIN_ROWS`` of
each label, chosen by hash, so their ids can be broadcast and only their texts are read for the fit. A second fit drops
the rows that the first one finds at odds with their label beyond ``DOUBT`` (mislabelled rows widen a
class until it covers the other). Only sums reach the driver: a few hundred numbers a class.

Defined cases: null and empty texts have the statistics of no words and get a score like any
other. Labels that are null or without a document are not used. Without labels of both classes
every score is 0.5. A document labelled both ways counts once for each. Extra columns pass through ``score``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm import bytesops as B
from lexmill.llm.scratch import Scratch

FOLDS = 5
ACCEPT = 0.3
TRAIN_ROWS = 200_000
POOL, DIAGONAL, RIDGE = 0.1, 0.1, 1e-3
DOUBT = 0.02

_UP = B.table_of(bytes(range(65, 91)))
_LOW = B.table_of(bytes(range(97, 123)))
_DIGIT = B.table_of(b"0123456789")
_STOP = B.table_of(b".,;:?")
_SYMBOL = B.table_of(b"!\"#$%&()*+/<=>@[\\]^_`{|}~")
_WIDE = B.table_of(bytes(range(128, 256)))
_LINE = ~B.table_of(b"\n")
NAMES = ["words", "word_length", "word_spread", "upper", "digits", "stops", "symbols", "wide", "bare", "distinct", "top", "repeats", "symbol_ends", "lines", "equal_lines", "equal_runs", "capitals"]


def _per_row(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=rows)


def _totals(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set in each row."""
    out = np.zeros(len(at) - 1)
    some = np.flatnonzero(at[1:] > at[:-1])
    if len(some):
        out[some] = np.add.reduceat(flags, at[some], dtype=np.int32)
    return out


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text of a slice."""
    rows = len(at) - 1
    size = np.maximum(np.diff(at), 1)

    def share(table: np.ndarray) -> np.ndarray:
        return _totals(table[data], at) / size

    s, e, row = B.words(data, at, B.NOT_SPACE)
    h = B.hashes(data, s, e)[0]
    width = (e - s).astype(float)
    n = np.bincount(row, minlength=rows).astype(float)
    some = np.maximum(n, 1)
    mean = _per_row(width, row, rows) / some
    spread = np.sqrt(np.maximum(_per_row(width**2, row, rows) / some - mean**2, 0))

    letters = np.concatenate([[0], np.cumsum((_UP | _LOW | _WIDE)[data], dtype=np.int32 if len(data) < 1 << 31 else np.int64)])
    bare = _per_row((letters[e] == letters[s]).astype(float), row, rows) / some
    ends = _per_row(_SYMBOL[data[e - 1]].astype(float), row, rows) / some if len(e) else np.zeros(rows)
    initial = _per_row(_UP[data[s]].astype(float), row, rows) / some if len(s) else np.zeros(rows)

    def copies(x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entries, distinct entries, most copies of one) by row."""
        if not len(x):
            z = np.zeros(rows)
            return z, z, z
        bits = np.uint64(rows.bit_length())
        key = np.sort((r.astype(np.uint64) << (np.uint64(64) - bits)) | (x >> bits))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(first, len(x)))
        r = (key >> (np.uint64(64) - bits)).astype(np.int64)
        most = np.zeros(rows)
        own = r[first]
        begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        most[own[begin]] = np.maximum.reduceat(count, begin)
        return np.bincount(r, minlength=rows).astype(float), np.bincount(own, minlength=rows).astype(float), most

    _, distinct, most = copies(h, row)
    again = np.zeros(len(h))
    if len(h) > 1:
        again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    ls, le, lrow = B.words(data, at, _LINE)
    n_lines, own_lines, _ = copies(B.hashes(data, ls, le)[0], lrow)
    runs, own_runs, _ = copies(*B.shingles(h, row, rows, 4))
    upper, lower = share(_UP), share(_LOW)
    cols = [
        np.log1p(n),
        np.log1p(mean),
        np.log1p(spread),
        np.sqrt(upper / np.maximum(upper + lower, 1e-9)),
        np.sqrt(share(_DIGIT)),
        np.sqrt(share(_STOP)),
        np.sqrt(share(_SYMBOL)),
        np.sqrt(share(_WIDE)),
        np.sqrt(bare),
        np.log((distinct + 1) / (n + 1)),
        np.log((most + 1) / (n + 2)),
        np.sqrt(_per_row(again, row, rows) / some),
        np.sqrt(ends),
        np.log((n_lines + 1) / (n + 1)),
        np.sqrt(1 - own_lines / np.maximum(n_lines, 1)),
        np.sqrt(1 - own_runs / np.maximum(runs, 1)),
        np.sqrt(initial),
    ]
    cols[14][n_lines == 0] = 0
    cols[15][runs == 0] = 0
    return np.column_stack(cols)


def _of_column(col) -> np.ndarray:
    parts = [statistics(data, at) for _, _, data, at in B.slices(col)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


@B.lean
def _features(batches):
    for b in batches:
        x = _of_column(b.column("text"))
        values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), values], names=["doc_id", "x"])


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each document."""
    docs = docs.select("doc_id", F.col("text").cast("string"))
    return docs.mapInArrow(_features, T.StructType([docs.schema["doc_id"], T.StructField("x", T.ArrayType(T.DoubleType()))]))


@dataclass
class Model:
    """Means, inverse Cholesky factors and log constants of the classes 0 and 1."""

    mean: list[np.ndarray]
    whiten: list[np.ndarray]
    constant: list[float]

    def log_density(self, x: np.ndarray, k: int) -> np.ndarray:
        z = self.whiten[k] @ (x - self.mean[k]).T
        return self.constant[k] - 0.5 * (z * z).sum(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.mean:
            return np.full(len(x), 0.5)
        d = self.log_density(x, 1) - self.log_density(x, 0)
        return 1 / (1 + np.exp(-np.clip(d, -500, 500)))


def solve(n: np.ndarray, total: np.ndarray, outer: np.ndarray) -> Model:
    """The model from each class's number of rows, sum of vectors and sum of outer products."""
    if (n < 2).any():
        return Model([], [], [])
    d = total.shape[1]
    mean = total / n[:, None]
    cov = outer / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = (cov * n[:, None, None]).sum(0) / n.sum()
    m = Model([], [], [])
    for k in (0, 1):
        c = (1 - POOL) * cov[k] + POOL * pooled
        c = (1 - DIAGONAL) * c + DIAGONAL * np.diag(np.diag(c)) + RIDGE * np.eye(d)
        f = np.linalg.cholesky(c)
        m.mean.append(mean[k])
        m.whiten.append(np.tril(np.linalg.inv(f)))
        m.constant.append(float(np.log(n[k] / n.sum()) - np.log(np.diag(f)).sum()))
    return m


def _sums(model: Model | None):
    """Sums of each class over the partition: n, vector and outer product in one list."""

    @B.lean
    def run(batches):
        d = len(NAMES)
        held = np.zeros((2, 1 + d + d * d))
        for b in batches:
            x = np.array(b.column("x").to_pylist()).reshape(-1, d)
            y = b.column("label").to_numpy()
            if model is not None and len(x):
                p = model.score(x)
                keep = np.where(y == 1, p, 1 - p) >= DOUBT
                x, y = x[keep], y[keep]
            for k in (0, 1):
                own = x[y == k]
                held[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_pydict({"label": pa.array([0, 1], pa.int32()), "v": pa.array([*held], pa.list_(pa.float64()))})

    return run


def fit(labelled: DataFrame) -> Model:
    """The model of rows (x, label 0 or 1)."""
    d, model = len(NAMES), None
    for _ in range(2):
        sums = labelled.mapInArrow(_sums(model), "label int, v array<double>").select("label", F.posexplode("v").alias("k", "v")).groupBy("label", "k").agg(F.sum("v").alias("v"))
        held = np.zeros((2, 1 + d + d * d))
        for r in sums.collect():
            held[r.label, r.k] = r.v
        nxt = solve(held[:, 0], held[:, 1 : 1 + d], held[:, 1 + d :].reshape(2, d, d))
        if not nxt.mean:
            return model or nxt
        model = nxt
    return model


def training(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of at most about ``TRAIN_ROWS`` rows of each label outside the held-out fold; each once."""
    own = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    own = own.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0).distinct()
    most = own.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    return own.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-most // TRAIN_ROWS)))) == 0)


def score(self, x: np.ndarray) -> np.ndarray:
        if not self.mean:
            return np.full(len(x), 0.5)
        d = self.log_density(x, 1) - self.log_density(x, 0)
        return 1 / (1 + np.exp(-np.clip(d, -500, 500)))


def solve(n: np.ndarray, total: np.ndarray, outer: np.ndarray) -> Model:
    """The model from each class's number of rows, sum of vectors and sum of outer products."""
    if (n < 2).any():
        return Model([], [], [])
    d = total.shape[1]
    mean = total / n[:, None]
    cov = outer / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = (cov * n[:, None, None]).sum(0) / n.sum()
    m = Model([], [], [])
    for k in (0, 1):
        c = (1 - POOL) * cov[k] + POOL * pooled
        c = (1 - DIAGONAL) * c + DIAGONAL * np.diag(np.diag(c)) + RIDGE * np.eye(d)
        f = np.linalg.cholesky(c)
        m.mean.append(mean[k])
        m.whiten.append(np.tril(np.linalg.inv(f)))
        m.constant.append(float(np.log(n[k] / n.sum()) - np.log(np.diag(f)).sum()))
    return m


def _sums(model: Model | None):
    """Sums of each class over the partition: n, vector and outer product in one list."""

    @B.lean
    def run(batches):
        d = len(NAMES)
        held = np.zeros((2, 1 + d + d * d))
        for b in batches:
            x = np.array(b.column("x").to_pylist()).reshape(-1, d)
            y = b.column("label").to_numpy()
            if model is not None and len(x):
                p = model.score(x)
                keep = np.where(y == 1, p, 1 - p) >= DOUBT
                x, y = x[keep], y[keep]
            for k in (0, 1):
                own = x[y == k]
                held[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_pydict({"label": pa.array([0, 1], pa.int32()), "v": pa.array([*held], pa.list_(pa.float64()))})

    return run


def fit(labelled: DataFrame) -> Model:
    """The model of rows (x, label 0 or 1)."""
    d, model = len(NAMES), None
    for _ in range(2):
        sums = labelled.mapInArrow(_sums(model), "label int, v array<double>").select("label", F.posexplode("v").alias("k", "v")).groupBy("label", "k").agg(F.sum("v").alias("v"))
        held = np.zeros((2, 1 + d + d * d))
        for r in sums.collect():
            held[r.label, r.k] = r.v
        nxt = solve(held[:, 0], held[:, 1 : 1 + d], held[:, 1 + d :].reshape(2, d, d))
        if not nxt.mean:
            return model or nxt
        model = nxt
    return model


def training(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of at most about ``TRAIN_ROWS`` rows of each label outside the held-out fold; each once."""
    own = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    own = own.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0).distinct()
    most = own.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    return own.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-most // TRAIN_ROWS)))) == 0)


def scores(x: DataFrame, model: Model) -> DataFrame:
    """``features`` rows with their score: (doc_id, score)."""

    @B.lean
    def run(batches):
        for b in batches:
            v = np.array(b.column("x").to_pylist()).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(v))], names=["doc_id", "score"])

    return x.mapInArrow(run, T.StructType([x.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """``docs`` with the score of each text, in one pass."""
    inputs = docs.drop(name).withColumn("text", F.col("text").cast("string"))

    @B.lean
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(_of_column(b.column("text"))))], names=[*b.schema.names, name])

    return inputs.mapInArrow(run, T.StructType([*inputs.schema.fields, T.StructField(name, T.DoubleType())]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled training documents among ``docs``."""
    scratch = Scratch(docs.sparkSession, "quality-fit")
    chosen = scratch.table(training(labels), "training")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    x = scratch.table(features(texts), "features")
    model = fit(scratch.table(x.join(chosen, "doc_id").select("x", "label"), "labelled"))
    scratch.clear()
    return model


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    scratch = Scratch(docs.sparkSession, "quality")
    out = score(docs.select("doc_id", "text"), train(docs, labels), "score")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return scratch.result(out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted")))


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is ``ACCEPT`` or more."""
    return score(docs, train(docs, labels)).where(F.col("quality_score") >= ACCEPT).drop("quality_score")
