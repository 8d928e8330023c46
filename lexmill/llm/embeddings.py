"""Embedding near-duplicates by spherical-cap filters from random product codes.

Vectors are normalised and turned by a random rotation; the coordinates fall into ``PARTS`` blocks
with a code of random directions each, and a filter is one direction from every block. A vector
is in a filter if its cosine with the combined direction exceeds a threshold. List decoding finds all
exceeding filters from the blocks' inner products, without scoring the product of the codes. The
threshold puts about one vector in a filter by chance, and the codes are sized so that a vector is in
about ``FILTERS`` of them; a vector below half of that lowers its own threshold. Several codes with rotations of
their own are used: ``shape`` measures how often one code misses a pair at exactly the linking cosine, for the
length and number of the vectors (under a random rotation that holds for any such pair), and takes as many
codes as make a miss by all of them less likely than ``MISS``. Joins on filters give the candidates.
Sketches of 128 signs drop candidates that are far apart (beyond six standard deviations).

Groups of near copies are not expanded into pairs. Equal vectors are one. A vector within half the linking
angle of a filter's smallest id joins that id's cell, so all pairs within a cell link by the triangle
inequality, and a cell counts as its size. Two cells whose centres and radii show that all of their pairs link,
or none, are settled as a whole; from other pairs of cells the members are compared in blocks of
``BLOCK``, by matrix products in double precision.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without
an id, link with nothing (without an id: component null, kept true). Vectors of different lengths don't
link. Repeated rows are vectors that link with each other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm import bytesops as B
from lexmill.llm.graph import components
from lexmill.llm.scratch import Scratch

PARTS, FILTERS, CODES = 2, 8, 8
MISS = 1e-5
PAIRS = 2000
LEAST_COUNT = 4096
SKETCH = 128
BLOCK = 512
MARGIN = 1e-7
SIGMAS = 6.0


def unit_rows(col: pa.Array) -> list[np.ndarray | None]:
    """Each row as a unit vector in double precision, or None if it can't link."""
    out: list[np.ndarray | None] = []
    values, at = col.values.to_numpy(zero_copy_only=False).astype(float), col.offsets.to_numpy()
    valid = col.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(col)):
        x = values[at[i] : at[i + 1]]
        top = np.abs(x).max() if len(x) else 0.0
        if not valid[i] or not np.isfinite(x).all() or not top:
            out.append(None)
            continue
        x = x / top
        out.append(x / np.linalg.norm(x) + 0.0)
    return out


@cache
def code(dim: int, size: int, number: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rotation, directions of each block) of a numbered code for vectors of a length."""
    r = np.random.default_rng([dim, size, number, 20250102])
    turn = np.linalg.qr(r.standard_normal((dim, dim)))[0] * r.choice([-1, 1], dim)
    blocks = []
    for part in np.array_split(np.arange(dim), min(PARTS, dim)):
        c = r.standard_normal((size, len(part)))
        blocks.append(np.unique(c / np.linalg.norm(c, axis=1, keepdims=True), axis=0))
    return turn, blocks


@cache
def planes(dim: int) -> np.ndarray:
    """Sketch directions."""
    return np.random.default_rng([dim, 7]).standard_normal((dim, SKETCH))


def sketches(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    return np.packbits(x @ planes > 0, axis=1).view(np.int64)


def filters(x: np.ndarray, size: int, number: int, threshold: float, least: int) -> list[np.ndarray]:
    """The filters of a code that each unit row exceeds."""
    step = max(1, (1 << 21) // size)
    if len(x) > step:
        return [f for k in range(0, len(x), step) for f in filters(x[k : k + step], size, number, threshold, least)]
    turn, blocks = code(x.shape[1], size, number)
    y = x @ turn
    scores, lo = [], 0
    for c in blocks:
        scores.append(y[:, lo : lo + c.shape[1]] @ c.T)
        lo += c.shape[1]
    a, b = scores[0], scores[1] if len(scores) > 1 else np.zeros((len(x), 1))
    top_a, top_b, enough = a.max(1), b.max(1), min(least, a.shape[1] * b.shape[1])
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(x)
    t, rows = threshold * np.sqrt(len(scores)), np.arange(len(x))
    while len(rows):  # those that still have too few
        whole = len(rows) == len(x)
        own = a if whole else a[rows], b if whole else b[rows]
        (of_p, p), (of_q, q) = (np.nonzero(s >= (t - top[rows])[:, None]) for s, top in zip(own, (top_b, top_a), strict=True))
        at_p, at_q = (np.searchsorted(of, np.arange(len(rows) + 1)) for of in (of_p, of_q))
        pairs = np.diff(at_p) * np.diff(at_q)
        few = []
        for lo, hi in _pieces(pairs):
            k = np.repeat(np.arange(at_p[lo], at_p[hi]), np.diff(at_q)[of_p[at_p[lo] : at_p[hi]]])
            row = of_p[k]
            j = np.arange(len(k)) - np.repeat(np.cumsum(pairs[lo:hi]) - pairs[lo:hi], pairs[lo:hi])
            j = at_q[row] + j % np.diff(at_q)[row]
            hit = own[0][row, p[k]] + own[1][row, q[j]] >= t
            found = p[k[hit]].astype(np.int64) * b.shape[1] + q[j[hit]]
            cuts = np.searchsorted(row[hit], np.arange(lo, hi + 1))
            for i in range(lo, hi):
                out[rows[i]] = found[cuts[i - lo] : cuts[i - lo + 1]]
            few.append(rows[lo:hi][np.diff(cuts) < enough])
        rows, t = np.concatenate(few), t - 0.05
    return out


def _pieces(sizes: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int]]:
    """(begin, end) of runs of rows whose sizes add up to about ``most``, or of one row that is larger."""
    group = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    return list(zip(cuts, cuts[1:], strict=False))


def _threshold(dim: int, count: int) -> float:
    return NormalDist().inv_cdf(1 - 1 / count) / np.sqrt(dim)


@cache
def shape(dim: int, count: int, cosine: float) -> tuple[int, int, int]:
    """(directions of a block, least filters of a vector in a code, codes) that miss a pair at the cosine less often than ``MISS``."""
    want, size = FILTERS, 0
    while True:
        size = int(np.ceil((want * count) ** (1 / PARTS)))
        if dim < 2:
            return size, want // 2, 1
        r = np.random.default_rng([dim, count, want])
        x, z = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in r.standard_normal((2, PAIRS, dim)))
        z = z - (z * x).sum(1, keepdims=True) * x
        y = cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        a, b = (filters(v, size, 0, _threshold(dim, count), want // 2) for v in (x, y))
        missed = 1 + sum(not np.intersect1d(f, g, assume_unique=True).size for f, g in zip(a, b, strict=True))
        rate = min((missed + 3 * np.sqrt(missed)) / PAIRS, 1 - 1 / PAIRS)  # three standard errors above the measured rate
        codes = int(np.ceil(np.log(MISS) / np.log(rate)))
        if codes <= CODES or want >= count:
            return size, want // 2, codes
        want *= 2


@B.lean
def _load(batches):
    for b in batches:
        rows = []
        for i, x in zip(b.column("vec_id").to_pylist(), unit_rows(b.column("embedding")), strict=True):
            if x is None:
                rows.append((i, None, None, None, None))
            else:
                d = np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), np.int64)
                rows.append((i, int(d[0]), int(d[1]), len(x), x.tobytes()))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["vec_id", "d1", "d2", "dim", "unit"])


def _matrix(col, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(-1, dim)


def _filter_rows(count: int, shapes: dict[int, tuple[int, int, int]]):
    @B.lean
    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == d))
                size, least, codes = shapes[d]
                for k in range(0, part.num_rows, 512):
                    own = part.slice(k, 512)
                    x = _matrix(own.column("unit"), d)
                    s = sketches(x, planes(d))
                    for number in range(codes):
                        found = filters(x, size, number, _threshold(d, count), least)
                        n = [len(f) for f in found]
                        ids = (np.concatenate(found) * np.int64(codes) + number) * np.int64(65_536) + np.int64(d % 65_536)
                        cols = [pa.array(ids), pa.array(np.repeat(own.column("uid").to_numpy(), n)), pa.array(np.repeat(s[:, 0], n)), pa.array(np.repeat(s[:, 1], n))]
                        yield pa.RecordBatch.from_arrays(cols, names=["filter", "uid", "s1", "s2"])

    return run


def _angle(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1, 1))


def _dots(b: pa.RecordBatch) -> np.ndarray:
    out = np.full(b.num_rows, -1.0)
    same = np.flatnonzero(b.column("dim_a").to_numpy() == b.column("dim_b").to_numpy())
    dims = b.column("dim_a").to_numpy()
    for d in np.unique(dims[same]):
        k = same[dims[same] == d]
        x, y = (_matrix(b.column(c).take(pa.array(k)), int(d)) for c in ("unit_a", "unit_b"))
        out[k] = np.einsum("ij,ij->i", x, y)
    return out


def _near(limit: float):
    """Rows (a, b) within an angle, with that angle."""

    @B.lean
    def run(batches):
        for b in batches:
            angle = _angle(_dots(b))
            keep = pa.array(np.flatnonzero(angle <= limit))
            yield pa.RecordBatch.from_arrays([b.column("a").take(keep), b.column("b").take(keep), pa.array(angle).take(keep)], names=["a", "b", "angle"])

    return run


def _settle(cosine: float):
    """Pairs of cells of which all members link (kind 2) or some may (kind 1)."""
    theta = float(np.arccos(cosine))

    @B.lean
    def run(batches):
        for b in batches:
            dot = _dots(b)
            angle, spread = _angle(dot), b.column("radius_a").to_numpy() + b.column("radius_b").to_numpy()
            kind = np.where(angle + spread <= theta - MARGIN, 2, np.where(angle - spread > theta + MARGIN, 0, 1))
            kind = np.where(spread == 0, 2 * (dot >= cosine), kind).astype(np.int32)
            keep = pa.array(np.flatnonzero(kind))
            yield pa.RecordBatch.from_arrays([b.column("a").take(keep), b.column("b").take(keep), pa.array(kind).take(keep)], names=["a", "b", "kind"])

    return run


def _compare(cosine: float):
    """Links between the members of two cells, block by block; rows come sorted by (a, b, i, j)."""

    def links(t: pa.Table, cuts: list[int]):
        col = {c: t.column(c).to_numpy() for c in ("a", "b", "side", "uid", "mult", "dim")}
        unit = t.column("unit").combine_chunks().cast(pa.large_binary())
        at = np.frombuffer(unit.buffers()[1], np.int64)[unit.offset : unit.offset + len(unit) + 1]
        data = np.frombuffer(unit.buffers()[2], np.uint8)
        rows, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            side, mult = col["side"][lo:hi], col["mult"][lo:hi]
            p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(p) or not len(q):
                continue
            x = data[at[lo] : at[hi]].view(np.float64).reshape(-1, int(col["dim"][lo]))
            hit = x[p] @ x[q].T >= cosine
            if not hit.any():
                continue
            n = np.zeros(hi - lo, np.int64)
            n[p], n[q] = hit @ mult[q], mult[p] @ hit
            some = np.flatnonzero(n)
            rows.append(some + lo)
            counts.append(n[some])
        take = np.concatenate(rows)
        return pa.RecordBatch.from_arrays([*(pa.array(col[c][take], pa.int64()) for c in ("a", "b", "uid")), pa.array(np.concatenate(counts))], names=["a", "b", "uid", "n"])

    @B.lean
    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            key = [t.column(c).to_numpy() for c in ("a", "b", "i", "j")]
            cuts = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1).tolist()]
            if len(cuts) > 1:
                yield links(t.slice(0, cuts[-1]), cuts)
            held = t.slice(cuts[-1]).combine_chunks() if t.num_rows else None
        if held is not None and held.num_rows:
            yield links(held, [0, held.num_rows])

    return run


def _within(angle: str) -> str:
    """SQL: the most sketch bits that may differ at an angle (SQL, in radians)."""
    mean = f"({SKETCH} * least({angle}, 3.14159) / 3.14159265)"
    return f"bit_count(a.s1 ^ b.s1) + bit_count(a.s2 ^ b.s2) <= {mean} + {SIGMAS} * sqrt({mean} * (1 - {mean} / {SKETCH}) + 1)"


def near_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links long, component_id long, kept boolean) of each row of ``vectors`` (vec_id long, embedding array)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    theta = float(np.arccos(cosine))
    source = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    rows = scratch.table(source.mapInArrow(_load, "vec_id long, d1 long, d2 long, dim int, unit binary"), "rows")
    usable = rows.where("vec_id IS NOT NULL AND unit IS NOT NULL")
    points = usable.groupBy("d1", "d2").agg(F.min("vec_id").alias("low"), F.count("*").alias("mult"), F.first("dim").alias("dim"), F.first("unit").alias("unit"))
    # Where rows repeat an id with another vector, the later points get ids of their own.
    turn = F.row_number().over(Window.partitionBy("low").orderBy("d1", "d2"))
    points = scratch.table(points.withColumn("uid", F.when(turn == 1, F.col("low")).otherwise(F.xxhash64("d1", "d2"))), "points")
    count = max(LEAST_COUNT, points.count())
    shapes = {r.dim: shape(r.dim, count, cosine) for r in points.select("dim").distinct().collect()}
    where = scratch.table(points.select("uid", "dim", "unit").mapInArrow(_filter_rows(count, shapes), "filter long, uid long, s1 long, s2 long"), "filters")

    def attach(pairs: DataFrame) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(points.select(F.col("uid").alias(side), F.col("dim").alias(f"dim_{side}"), F.col("unit").alias(f"unit_{side}")), side)
        return pairs

    # Cells: points within half the angle of the smallest id of one of their filters.
    first = scratch.table(where.groupBy("filter").agg(F.min(F.struct("uid", "s1", "s2")).alias("low"), F.max("uid").alias("last")).where("last > low.uid").select("filter", F.col("low.uid").alias("leader"), F.col("low.s1").alias("s1"), F.col("low.s2").alias("s2")), "leaders")
    lead = where.alias("a").join(first.alias("b"), "filter").where(f"a.uid > b.leader AND {_within(str(theta / 2))}").groupBy("uid").agg(F.min("leader").alias("leader"))
    assigned = attach(lead.selectExpr("uid AS a", "leader AS b")).mapInArrow(_near(theta / 2 - MARGIN), "a long, b long, angle double")
    assigned = scratch.table(assigned, "assigned")
    members = points.select("uid", "mult", "low").join(assigned.selectExpr("a AS uid", "b AS cell", "angle"), "uid", "left").selectExpr("uid", "mult", "low", "coalesce(cell, uid) AS cell", "coalesce(angle, 0D) AS angle")
    members = scratch.table(members, "members")
    cells = scratch.table(members.groupBy("cell").agg(F.sum("mult").alias("size"), F.count("*").alias("points"), F.max("angle").alias("radius")), "cells")

    # Pairs of cells that share a filter.
    signs = where.groupBy("uid").agg(F.first("s1").alias("s1"), F.first("s2").alias("s2"))
    signed = scratch.table(cells.join(signs, F.col("cell") == F.col("uid")).select("cell", "radius", "s1", "s2"), "signed")
    owned = where.select("filter", "uid").join(members.select("uid", "cell"), "uid").select("filter", "cell").distinct()
    owned = scratch.table(owned.join(signed, "cell"), "owned")
    pairs = owned.alias("a").join(owned.alias("b"), "filter").where(f"a.cell < b.cell AND {_within(f'({theta} + a.radius + b.radius)')}")
    pairs = pairs.selectExpr("a.cell AS a", "b.cell AS b", "a.radius AS radius_a", "b.radius AS radius_b").distinct()
    settled = scratch.table(attach(pairs).mapInArrow(_settle(cosine), "a long, b long, kind int"), "settled")

    # Members of pairs of cells that aren't settled.
    open_pairs = settled.where("kind = 1").select("a", "b")
    for side in "ab":
        open_pairs = open_pairs.join(cells.select(F.col("cell").alias(side), F.ceil(F.col("points") / BLOCK).cast("int").alias(f"blocks_{side}")), side)
    open_pairs = scratch.table(open_pairs, "open")
    parts = []
    for side, other, own, far in (("a", "b", "i", "j"), ("b", "a", "j", "i")):
        x = open_pairs.join(members.select(F.col("cell").alias(side), "uid", "mult"), side)
        x = x.withColumns({own: F.pmod(F.xxhash64("uid"), F.col(f"blocks_{side}")).cast("int"), far: F.explode(F.sequence(F.lit(0), F.col(f"blocks_{other}") - 1)), "side": F.lit(0 if side == "a" else 1)})
        parts.append(x.select("a", "b", "i", "j", "side", "uid", "mult"))
    blocks = parts[0].unionByName(parts[1]).join(points.select("uid", "dim", "unit"), "uid")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    compared = scratch.table(blocks.repartition(partitions, "a", "b", "i", "j").sortWithinPartitions("a", "b", "i", "j").mapInArrow(_compare(cosine), "a long, b long, uid long, n long"), "compared")

    # Counts and components.
    whole = settled.where("kind = 2").select("a", "b")
    sizes = cells.select("cell", "size")
    extra = whole.join(sizes.withColumnRenamed("cell", "b"), "b").selectExpr("a AS cell", "size").unionByName(whole.join(sizes.withColumnRenamed("cell", "a"), "a").selectExpr("b AS cell", "size"))
    extra = extra.groupBy("cell").agg(F.sum("size").alias("extra"))
    edges = whole.unionByName(compared.select("a", "b").distinct())
    linked = components(edges, scratch)
    total = scratch.table(sizes.join(extra, "cell", "left").join(linked.withColumnRenamed("node", "cell"), "cell", "left").selectExpr("cell", "size - 1 + coalesce(extra, 0) AS links", "coalesce(component, cell) AS component"), "totals")
    single = compared.groupBy("uid").agg(F.sum("n").alias("single"))
    counted = scratch.table(members.select("uid", "cell", "low").join(total, "cell").join(single, "uid", "left").selectExpr("uid", "low", "links + coalesce(single, 0) AS n_links", "component"), "counted")
    low = scratch.table(counted.groupBy("component").agg(F.min("low").alias("component_id")), "low")
    named = scratch.table(points.select("d1", "d2", "uid").join(counted.join(low, "component"), "uid").select("d1", "d2", "n_links", "component_id"), "named")
    out = rows.select("vec_id", F.expr("CASE WHEN vec_id IS NOT NULL THEN d1 END").alias("d1"), "d2").join(named, ["d1", "d2"], "left")
    out = out.selectExpr("vec_id", "coalesce(n_links, 0L) AS n_links", "coalesce(component_id, vec_id) AS component_id")
    return scratch.result(out.withColumn("kept", F.expr("vec_id IS NULL OR vec_id = component_id")))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""
