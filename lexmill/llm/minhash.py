"""MinHash near-duplicates with sequential Bayesian verification.

Documents are sets of word shingles. 130 minima of 16 bits are cut into 26 bands of five; a
pair at a similarity of 0.8 shares no band with probability (1 - 0.8**5)**26 = 3e-5. Documents
of equal sets are one class. Candidates are verified in two rounds:

1. Each band bucket's members against the bucket's smallest id (a star, linear in the bucket).
2. Within buckets, members that round 1 has not shown to be connected. Large buckets are cut into blocks,
   and the pairs of blocks are dealt out, so no task holds a whole bucket and no pair is
   emitted before it has passed the signature test.

Each pair's signatures are compared batch by batch. After n values with m equal, similarity
has the posterior Beta(m + 1, n - m + 1); the pair is pruned once P(similarity >= threshold)
is below ``MISS``. A bound from 4096-bit maps, which never prunes a true link, follows, and
what is left is compared on the full sets of 64-bit shingle hashes.

Defined cases: a text that is null or without words has an empty set and links with nothing.
Rows without an id keep themselves (component null, kept true). Rows of equal id and equal
text share their component and are all kept; an id's different texts are linked each by itself. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm import bytesops as B
from lexmill.llm.graph import components, labels
from lexmill.llm.scratch import Scratch

BANDS, WIDTH = 26, 5
HASHES = BANDS * WIDTH
BATCH = 26
MISS = 1e-5
MAP_BITS = 4096
BLOCK = 256
_rng = np.random.default_rng(7)
_A = (_rng.integers(0, 2**31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def signature(sh: np.ndarray) -> bytes:
    """16 bits of each of the minima over a set of shingle hashes."""
    x = (sh >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 1024):
        y = x[i : i + 1024, None] * _A
        y += _B
        np.minimum(low, y.min(axis=0), out=low)
    return low.astype(np.uint16).tobytes()


def bit_map(sh: np.ndarray) -> bytes:
    z = np.zeros(MAP_BITS, bool)
    z[(sh & np.uint64(MAP_BITS - 1)).astype(np.int64)] = True
    return np.packbits(z).tobytes()


def sets_of(col, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a string column."""
    for lo, hi, data, at in B.slices(col):
        s, e, row = B.words(data, at, B.NOT_SPACE)
        x, r = B.shingles(B.hashes(data, s, e)[0], row, hi - lo, size)
        cut = B.bounds(r, hi - lo)
        for i in range(hi - lo):
            yield np.unique(x[cut[i] : cut[i + 1]])


_PROFILE = [("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sig", pa.binary()), ("map", pa.binary()), ("sh", pa.binary())]


def digest(sh: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(hashlib.blake2b(sh.tobytes(), digest_size=16).digest(), np.int64)
    return int(d[0]), int(d[1])


def _profiles(size: int):
    """Row by row: doc_id, size, digest and signature of the set."""

    @B.lean
    def run(batches):
        for b in batches:
            out = [(len(sh), *digest(sh), signature(sh)) if len(sh) else (0, None, None, None) for sh in sets_of(b.column("text"), size)]
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, (_, k) in zip(cols, _PROFILE, strict=False))], names=["doc_id", *(n for n, _ in _PROFILE[:4])])

    return run


def _full(size: int):
    """The whole profiles of texts, those of equal id and set once in a task."""

    @B.lean
    def run(batches):
        seen: set[tuple] = set()
        for b in batches:
            for lo, hi, _, _ in B.slices(b.column("text")):
                part, out = b.slice(lo, hi - lo), []
                for i, sh in zip(part.column("doc_id").to_pylist(), sets_of(part.column("text"), size), strict=True):
                    if len(sh) and (key := (i, *digest(sh))) not in seen:
                        seen.add(key)
                        out.append((i, len(sh), *key[1:], signature(sh), bit_map(sh), sh.tobytes()))
                cols = list(zip(*out, strict=True)) if out else [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), *(k for _, k in _PROFILE)), strict=True)], names=["doc_id", *(n for n, _ in _PROFILE)])

    return run


def _marked(size: int, names: list[str]):
    """Rows with the digest of their set."""

    @B.lean
    def run(batches):
        for b in batches:
            found = [digest(sh) if len(sh) else (None, None) for sh in sets_of(b.column("text"), size)]
            d1, d2 = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(d1, pa.int64()), pa.array(d2, pa.int64())], names=[*names, "_d1", "_d2"])

    return run


@cache
def least_matches(threshold: float, n: int, miss: float = MISS) -> int:
    """The fewest equal values of n with P(similarity >= threshold) >= miss, under a uniform prior.

    The posterior's tail is P(Binomial(n + 1, threshold) <= m).
    """
    total = 0.0
    for m in range(n + 1):
        k = n + 1
        total += np.exp(lgamma(k + 1) - lgamma(m + 1) - lgamma(k - m + 1) + m * log(threshold) + (k - m) * log1p(-threshold))
        if total >= miss:
            return m
    return n


def passing(sa, sb, ma, mb, na, nb, percent: int) -> np.ndarray:
    """Which aligned pairs (signatures, maps, set sizes) survive the sequential test and the map bound."""
    t = percent / 100
    alive = np.flatnonzero(100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
    m = np.zeros(len(alive), np.int64)
    for n in range(0, HASHES, BATCH):
        m += (sa[alive, n : n + BATCH] == sb[alive, n : n + BATCH]).sum(1)
        keep = m >= least_matches(t, n + BATCH)
        alive, m = alive[keep], m[keep]
    common = np.bitwise_count(ma[alive] & mb[alive]).sum(1).astype(np.int64)
    for mine, size in ((ma, na), (mb, nb)):
        most = np.minimum(common + size[alive] - np.bitwise_count(mine[alive]).sum(1), np.minimum(na, nb)[alive])
        ok = 100 * most >= percent * (na[alive] + nb[alive] - most)
        alive, common = alive[ok], common[ok]
    return alive


def _arrays(b: pa.RecordBatch, side: str):
    n = b.num_rows
    sig = np.frombuffer(b"".join(b.column(f"sig{side}").to_pylist()), np.uint16).reshape(n, HASHES)
    bits = np.frombuffer(b"".join(b.column(f"map{side}").to_pylist()), np.uint64).reshape(n, MAP_BITS // 64)
    return sig, bits, b.column(f"n{side}").to_numpy()


def _prune(percent: int):
    @B.lean
    def run(batches):
        for b in batches:
            if b.num_rows:
                (sa, ma, na), (sb, mb, nb) = _arrays(b, "_a"), _arrays(b, "_b")
                yield b.select(["a", "b"]).take(pa.array(passing(sa, sb, ma, mb, na, nb, percent)))

    return run


def _verify(percent: int):
    @B.lean
    def run(batches):
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column("sh_a"), b.column("sh_b"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _blocks(percent: int):
    """Pairs of different components inside each (bucket, block, block) of rows sorted by these."""

    def pairs(rows: pa.Table):
        n = rows.num_rows
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(n, HASHES)
        bits = np.frombuffer(b"".join(rows.column("map").to_pylist()), np.uint64).reshape(n, MAP_BITS // 64)
        size, comp, own = (rows.column(c).to_numpy() for c in ("n", "component", "own"))
        left, right = rows.column("i").to_numpy()[0], rows.column("j").to_numpy()[0]
        p, q = np.flatnonzero(own == left), np.flatnonzero(own == right)
        found = []
        for k in range(0, len(p), 64):
            x, y = (z.ravel() for z in np.meshgrid(p[k : k + 64], q, indexing="ij"))
            ok = comp[x] != comp[y]
            if left == right:
                ok &= x < y
            x, y = x[ok], y[ok]
            alive = passing(sig[x], sig[y], bits[x], bits[y], size[x], size[y], percent) if len(x) < 20_000 else _in_parts(sig, bits, size, x, y, percent)
            found.append((x[alive], y[alive]))
        ids = rows.column("rep").to_numpy()
        x, y = (np.concatenate([f[s] for f in found]) for s in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y]))], names=["a", "b"])

    @B.lean
    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            key = [t.column(c).to_numpy() for c in ("bucket", "i", "j")]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            cuts = [0, *new.tolist()]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi - lo > 1:
                    yield pairs(t.slice(lo, hi - lo))
            held = t.slice(cuts[-1]).combine_chunks() if t.num_rows else None
        if held is not None and held.num_rows > 1:
            yield pairs(held)

    return run


def _in_parts(sig, bits, size, x, y, percent):
    return np.concatenate([k + passing(sig[x[k : k + 16_384]], sig[y[k : k + 16_384]], bits[x[k : k + 16_384]], bits[y[k : k + 16_384]], size[x[k : k + 16_384]], size[y[k : k + 16_384]], percent) for k in range(0, len(x), 16_384)])


def _found(docs: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, d1, d2) of each row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = scratch.table(docs.mapInArrow(_profiles(size), "doc_id long, n long, d1 long, d2 long, sig binary"), "profiles")
    linkable = rows.where("doc_id IS NOT NULL AND n > 0")
    classes = scratch.table(linkable.groupBy("d1", "d2").agg(F.min("doc_id").alias("low"), F.first("sig").alias("sig")), "classes")
    # Where an id has several texts of its own, all but one of their classes get an id by digest.
    pair = F.struct("d1", "d2")
    several = scratch.table(classes.groupBy("low").agg(F.min(pair).alias("f"), F.max(pair).alias("l")).where("f <> l").select(F.col("low").alias("several"), "f"), "several")
    classes = classes.join(several, F.col("low") == F.col("several"), "left").withColumn("rep", F.when(F.col("several").isNull() | (F.col("f") == pair), F.col("low")).otherwise(F.xxhash64("d1", "d2")))

    # Band buckets of classes.
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring(F.col("sig"), k * (2 * WIDTH) + 1, F.lit(2 * WIDTH)))))
    bands = scratch.table(classes.select("rep", band.alias("bucket")), "bands")
    shared = scratch.table(bands.groupBy("bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("last"), F.count("*").alias("members")).where("last > leader").drop("last"), "buckets")
    members = scratch.table(bands.join(shared, "bucket"), "members")
    scratch.drop(bands)

    # Full sets of the classes that share a bucket.
    # Written, so that Spark knows their size: ids of fixed width beside texts. It broadcasts them only below its threshold.
    multi = scratch.table(linkable.groupBy("doc_id").agg(F.min(pair).alias("f"), F.max(pair).alias("l")).where("f <> l").select(F.col("doc_id").alias("multi")), "multi")
    own = scratch.table(classes.join(multi, F.col("low") == F.col("multi")).select("multi", F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("rep").alias("own")), "own")
    wanted = members.select("rep").distinct().join(own.select("own", "multi"), F.col("rep") == F.col("own"), "left").select(F.coalesce("multi", "rep").alias("id"))
    wanted = scratch.table(wanted.distinct(), "wanted")
    texts = docs.join(wanted, docs.doc_id == wanted.id, "left_semi")
    sets = texts.mapInArrow(_full(size), "doc_id long, n long, d1 long, d2 long, sig binary, map binary, sh binary")
    # An id with one set stands for that set's class; of an id with several, only sets count whose class is called after it.
    sets = sets.join(multi, F.col("doc_id") == F.col("multi"), "left").withColumnRenamed("multi", "_m")
    sets = sets.join(own, (F.col("doc_id") == F.col("multi")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left")
    sets = sets.where("_m IS NULL OR own IS NOT NULL").select(F.coalesce("own", "doc_id").alias("rep"), "n", "sig", "map", "sh")
    sets = scratch.table(sets, "sets")
    if sets.groupBy("rep").count().where("count > 1").limit(1).count():  # rows that repeat id and text in several tasks
        sets = scratch.table(sets.dropDuplicates(["rep"]), "distinct-sets")

    def attach(pairs: DataFrame, cols: list[str]) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(sets.select(F.col("rep").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in cols)), side)
        return pairs

    def links(pairs: DataFrame) -> DataFrame:
        return scratch.table(attach(pairs, ["sh"]).mapInArrow(_verify(percent), "a long, b long"), "links")

    stars = members.where("rep <> leader").selectExpr("leader AS a", "rep AS b").distinct()
    first = links(attach(stars, ["sig", "map", "n"]).mapInArrow(_prune(percent), "a long, b long"))

    # Members that share a bucket and are not known to be connected.
    near = labels(first, scratch).withColumnRenamed("node", "rep")
    placed = members.join(near, "rep", "left").select("bucket", "rep", "members", F.coalesce("label", "rep").alias("component"))
    mixed = scratch.table(placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket"), "mixed")
    count = F.ceil(F.col("members") / BLOCK).cast("int")
    blocks = (
        placed.join(mixed, "bucket")
        .withColumn("blocks", count)
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", "rep", "component", "own", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"))
        .join(sets.select("rep", "n", "sig", "map"), "rep")
    )
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = blocks.repartition(partitions, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_blocks(percent), "a long, b long")
    second = links(found.distinct())
    final = components(first.unionByName(second), scratch)

    # A component is called after its smallest id; those of classes with an id by digest have it in ``low``.
    lows = classes.where("rep <> low").select(F.col("rep").alias("node"), "low")
    names = final.join(lows, "node", "left").groupBy("component").agg(F.min(F.coalesce("low", "node")).alias("component_id"))
    named = scratch.table(final.join(names, "component").select(F.col("node").alias("rep"), "component_id"), "named")
    mapped = scratch.table(classes.select("d1", "d2", "rep", "low").join(named, "rep", "left").select("d1", "d2", F.coalesce("component_id", "low").alias("component_id")), "mapped")
    out = rows.select("doc_id", "n", "d1", "d2").join(mapped, ["d1", "d2"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.expr("CASE WHEN doc_id IS NOT NULL THEN coalesce(component_id, doc_id) END").alias("component_id"), "d1", "d2")
    return out.withColumn("kept", F.expr("doc_id IS NULL OR doc_id = component_id"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles long, component_id long, kept boolean) of each row of ``docs`` (doc_id long, text string).

    ``size``: words of a shingle. ``percent``: documents link where 100 * |A and B| >= percent * |A or B|.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    return scratch.result(_found(docs, size, percent, scratch).select("doc_id", "n_shingles", "component_id", "kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with the smallest id of each linked group, and one of rows that repeat both id and text. An id's other texts stay unless they link."""
    scratch, ids = Scratch(docs.sparkSession, "minhash"), Scratch(docs.sparkSession, "gone")
    found = scratch.result(_found(docs, size, percent, scratch).where("doc_id IS NOT NULL").select("doc_id", "kept", "d1", "d2"))
    by = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_and("kept").alias("kept")).where("rows > 1 OR NOT kept")
    other = ids.result(by.select("doc_id", (F.col("rows") > 1).alias("repeated")))
    out = docs.join(other, "doc_id", "left_anti").select(*docs.columns)
    repeated = other.where("repeated").select("doc_id")
    if repeated.isEmpty():
        return out
    names = docs.columns
    again = docs.join(repeated, "doc_id", "left_semi").select(*names)
    marked = again.mapInArrow(_marked(size, names), T.StructType([*again.schema.fields, T.StructField("_d1", T.LongType()), T.StructField("_d2", T.LongType())]))
    gone = found.where("NOT kept").join(repeated, "doc_id", "left_semi").select("doc_id", F.col("d1").alias("_d1"), F.col("d2").alias("_d2")).distinct()
    return out.unionByName(marked.join(gone, ["doc_id", "_d1", "_d2"], "left_anti").dropDuplicates(["doc_id", "text"]).select(*names))
