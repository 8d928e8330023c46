"""Chat formatting: minimum-cost role repair over a legal-turn automaton.

A conversation is a row of turns. Legal sequences start with an optional system turn, then user and assistant
turns alternate from user to assistant; they are empty or end with assistant. Each turn keeps its role,
merges into the turn before, or is relabelled; empty turns may be inserted anywhere. Dynamic
programming over the automaton's four states finds the repair of least total cost
(``MERGE``, ``RELABEL``, ``UNKNOWN`` for roles that name no known role, ``INSERT`` for each empty turn).
Ties: the lower state, then keep or relabel before merge.

One conversation may hold a third of all turns, so it is cut into segments of ``SEGMENT`` turn numbers. A
segment is a 4 x 4 matrix of least costs from state to state, and matrices combine by (min, +); levels of
matrices are combined upwards, the best states at the ends of the segments are
handed down again, and every segment is then repaired on its own. Turns are ordered by turn, role, then a hash of
the text, the text. A segment that equal turn numbers fill beyond ``CROWDED`` rows is cut further, along that order: by number, by
the role's first bytes, and by ranges of the hash, in which each ``SEGMENT`` copies of a repeated turn count anew.

The repaired sequence is rendered a turn at a time: each row holds the piece of the rendering it adds, so a
conversation's text is the concatenation of its pieces in order. A turn's texts that look like the
template's marks are broken by a space.

Defined cases: a null or unknown role can take any role at ``UNKNOWN``; null text is empty; a null turn number
comes last; rows without a conversation id are one conversation; repeated rows are repeated turns. Extra
columns are ignored.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm import bytesops as B
from lexmill.llm.scratch import Scratch

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "chatgpt": "assistant", "agent": "assistant", "developer": "system"}
MERGE, RELABEL, UNKNOWN, INSERT = 1.0, 3.0, 1.5, 2.0
SEGMENT = 256
CROWDED = 4 * SEGMENT
#: states: 0 nothing yet, else the last turn's role
LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
ACCEPT = (0, 3)
INF = float("inf")


def role_number(role: str | None) -> int:
    """1 system, 2 user, 3 assistant, 0 unknown."""
    r = (role or "").strip().lower()
    r = ALIASES.get(r, r)
    return ROLES.index(r) + 1 if r in ROLES else 0


def _routes() -> dict[tuple[int, int], tuple[int, ...]]:
    """Shortest rows of empty turns from a state to a state."""
    out = {}
    for s in LEGAL:
        todo = [(s, ())]
        while todo:
            at, path = todo.pop(0)
            if (s, at) not in out:
                out[s, at] = path
                todo += [(n, (*path, n)) for n in LEGAL[at]]
    return out


ROUTES = _routes()
#: cost of ending in a state
FINISH = [min(INSERT * len(ROUTES[s, a]) for a in ACCEPT if (s, a) in ROUTES) for s in range(4)]


def _steps(label: int) -> dict[tuple[int, int], tuple[float, str, tuple[int, ...]]]:
    """(state, state) -> (cost, action, inserted roles) of one turn with this label; the later state is the turn's role."""
    out = {}
    for s in range(4):
        for r in (1, 2, 3):
            own = 0.0 if label == r else UNKNOWN if label == 0 else RELABEL
            found = []
            for before in range(4):
                if (s, before) in ROUTES and r in LEGAL[before]:
                    path = ROUTES[s, before]
                    found.append((own + INSERT * len(path), 0, "keep" if own == 0 else "relabel", path))
            if s == r:
                found.append((own + MERGE, 1, "merge", ()))
            if found:
                cost, _, action, path = min(found)
                out[s, r] = cost, action, path
    return out


STEPS = [_steps(label) for label in range(4)]
MATRIX = np.full((4, 4, 4), INF)
for _label in range(4):
    for (_s, _r), (_cost, *_rest) in STEPS[_label].items():
        MATRIX[_label, _s, _r] = _cost
UNIT = np.where(np.eye(4) > 0, 0.0, INF)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) product."""
    return (a[:, :, None] + b[None, :, :]).min(1)


def route(matrices: list[np.ndarray], start: int, end: int) -> list[int]:
    """States between the matrices (start and end included) of least cost; the lowest states among ties, from the end."""
    cost = [np.where(np.arange(4) == start, 0.0, INF)]
    for m in matrices:
        cost.append((cost[-1][:, None] + m).min(0))
    out = [end]
    for m, c in zip(reversed(matrices), reversed(cost[:-1]), strict=True):
        out.append(int(np.argmin(c + m[:, out[-1]])))
    return out[::-1]


def last_state(matrix: np.ndarray) -> int:
    return int(np.argmin(matrix[0] + np.array(FINISH)))


def repair(labels: list[int], start: int, end: int) -> list[tuple[str, int, tuple[int, ...], float]]:
    """(action, role, inserted roles before it, cost) of each turn."""
    states = route([MATRIX[x] for x in labels], start, end)
    out = []
    for x, (s, r) in zip(labels, pairwise(states), strict=True):
        cost, action, path = STEPS[x][s, r]
        out.append((action, r, path, cost))
    return out


def _groups(batches, keys: list[str]):
    """Tables of equal keys from batches sorted by them."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        if not t.num_rows:
            continue
        new = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            c = t.column(k).combine_chunks()
            new |= np.asarray(pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False), bool)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for lo, hi in pairwise(cuts):
            yield t.slice(lo, hi - lo)
        held = t.slice(cuts[-1]).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def _flat(m: np.ndarray) -> list[float]:
    return [float(x) for x in m.ravel()]


def _batch(rows: list[tuple], schema: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, schema, strict=True)], names=[n for n, _ in schema])


_LEVEL = [("conv", pa.string()), ("g", pa.int64()), ("m", pa.list_(pa.float64()))]
_ENDS = [("conv", pa.string()), ("g", pa.int64()), ("s_in", pa.int32()), ("s_out", pa.int32())]
MANY = 2048


def _emit(rows, schema):
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= MANY:
            yield _batch(held, schema)
            held = []
    yield _batch(held, schema)


@B.lean
def _segments(batches):
    """One matrix for each (conv, g): runs of equal keys are combined as they stream by."""

    def rows():
        key, m = None, UNIT
        for b in batches:
            for conv, g, label in zip(b.column("conv").to_pylist(), b.column("g").to_pylist(), b.column("label").to_pylist(), strict=True):
                if (conv, g) != key:
                    if key is not None:
                        yield (*key, _flat(m))
                    key, m = (conv, g), UNIT
                m = combine(m, MATRIX[label])
        if key is not None:
            yield (*key, _flat(m))

    yield from _emit(rows(), _LEVEL)


@B.lean
def _upwards(batches):
    def rows():
        for t in _groups(batches, ["conv", "up"]):
            m = UNIT
            for x in t.column("m").to_pylist():
                m = combine(m, np.array(x).reshape(4, 4))
            yield t.column("conv")[0].as_py(), t.column("up")[0].as_py(), _flat(m)

    yield from _emit(rows(), _LEVEL)


@B.lean
def _top(batches):
    def rows():
        for b in batches:
            for conv, g, m in zip(*(b.column(c).to_pylist() for c in ("conv", "g", "m")), strict=True):
                yield conv, g, 0, last_state(np.array(m).reshape(4, 4))

    yield from _emit(rows(), _ENDS)


@B.lean
def _downwards(batches):
    def rows():
        for t in _groups(batches, ["conv", "up"]):
            states = route([np.array(x).reshape(4, 4) for x in t.column("m").to_pylist()], t.column("s_in")[0].as_py(), t.column("s_out")[0].as_py())
            for conv, g, (a, b) in zip(t.column("conv").to_pylist(), t.column("g").to_pylist(), pairwise(states), strict=True):
                yield conv, g, a, b

    yield from _emit(rows(), _ENDS)


def opening(role: int) -> str:
    return f"<|im_start|>{ROLES[role - 1]}\n"


CLOSING = "<|im_end|>\n"


def safe(text: str) -> str:
    return text.replace("<|im_", "<| im_")


def piece(text: str, action: str, role: int, inserted: tuple[int, ...], first: bool) -> str:
    """What a turn adds to the rendering; the turn before it is closed here, unless nothing came before."""
    if action == "merge":
        return "\n\n" + safe(text)
    return ("" if first else CLOSING) + "".join(opening(r) + CLOSING for r in inserted) + opening(role) + safe(text)


_TURNS = [("conv_id", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("action", pa.string()), ("new_role", pa.string()), ("inserted", pa.list_(pa.string())), ("cost", pa.float64()), ("rendered", pa.string())]


@B.lean
def _turns(batches):
    def rows():
        for t in _groups(batches, ["conv", "g"]):
            labels = t.column("label").to_pylist()
            state = t.column("s_in")[0].as_py()
            end = t.column("s_out")[0].as_py()
            last = bool(t.column("last")[0].as_py())
            done = repair(labels, state, end)
            for k, (conv, turn, role, text, (action, r, path, cost)) in enumerate(zip(*(t.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), done, strict=True)):
                shown = piece(text or "", action, r, path, state == 0)
                state, names = r, [ROLES[x - 1] for x in path]
                if last and k + 1 == len(done):
                    tail = min((ROUTES[r, a] for a in ACCEPT if (r, a) in ROUTES), key=len)
                    cost += INSERT * len(tail)
                    names += [f"after:{ROLES[x - 1]}" for x in tail]
                    shown += CLOSING + "".join(opening(x) + CLOSING for x in tail)
                yield conv, turn, role, action, ROLES[r - 1], names, cost, shown

    yield from _emit(rows(), _TURNS)


def _place_of(copy) -> Column:
    """31 bits that order turns of equal number and role: of the text, and of which ``SEGMENT`` of its copies a turn is in."""
    return F.shiftrightunsigned(F.xxhash64("text", copy), 33).cast("int")


def _cut(base: DataFrame, crowded: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """``base`` with crowded segments cut further (g is then a finer number), and into how many parts a segment may be cut.

    Equal turns are counted before they are dealt out, so no task meets all copies.
    """
    names = base.columns
    calm = base.join(crowded, ["conv", "g"], "left_anti").select(*names)
    full = base.join(crowded, ["conv", "g"], "left_semi").drop("h")
    full = full.groupBy(*full.columns).agg((F.count("*") - 1).alias("more")).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), "more")))
    full = full.withColumns({
        "h": _place_of(F.floor(F.col("copy") / SEGMENT)),
        "at": F.col("place") - F.col("g") * SEGMENT,
        "head": F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.col("role").cast("binary"), 1, 2)), 4, "0"), 16, 10).cast("int"), F.lit(-1)),
    })
    keys = ["conv", "g", "at", "head"]
    found = full.groupBy(*keys).agg(F.count("*").alias("n"), F.min("role").eqNullSafe(F.max("role")).alias("one"))
    found = found.withColumn("cells", F.when(F.col("one"), F.ceil(F.col("n") / SEGMENT)).otherwise(1).cast("long"))
    before = F.sum("cells").over(Window.partitionBy("conv", "g").orderBy("at", "head").rowsBetween(Window.unboundedPreceding, -1))
    found = scratch.table(found.withColumn("before", F.coalesce(before, F.lit(0).cast("long"))).select(*keys, "cells", "before"), "cells")
    parts = found.groupBy("conv", "g").agg(F.sum("cells").alias("n")).agg(F.max("n")).first()[0]
    part = F.col("before") + F.floor(F.col("h") * F.col("cells") / F.lit(1 << 31)).cast("long")
    full = full.join(found, keys).withColumn("g", F.col("g") * parts + part)
    return calm.withColumn("g", F.col("g") * parts).unionByName(full.select(*names)), parts


def format_chats(turns: DataFrame) -> DataFrame:
    """One row for each turn: conv_id, turn, role, action (keep, merge, relabel), new_role, inserted (roles of empty turns before it; ``after:`` at the conversation's end), cost, rendered.

    ``turns``: conv_id, turn long, role, text.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark, "chat")
    known = {k: i + 1 for i, k in enumerate(ROLES)} | {a: ROLES.index(r) + 1 for a, r in ALIASES.items()}
    label = F.coalesce(F.create_map(*(F.lit(x) for kv in known.items() for x in kv))[F.lower(F.trim(F.coalesce(F.col("role").cast("string"), F.lit(""))))], F.lit(0))
    base = turns.select("conv_id", F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    ends = base.agg(F.min("turn").alias("lo"), F.max("turn").alias("hi")).first()
    lo, hi = (ends.lo or 0), (ends.hi or 0)
    place = F.coalesce(F.col("turn") - F.lit(lo), F.lit(hi - lo + 1))
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    base = base.withColumns({"conv": conv, "place": place, "g": F.floor(place / SEGMENT).cast("long"), "label": label.cast("int"), "h": _place_of(F.lit(0))})
    crowded = scratch.table(base.groupBy("conv", "g").count().where(F.col("count") > CROWDED).select("conv", "g"), "crowded")
    parts = 1
    if not crowded.isEmpty():
        base, parts = _cut(base, crowded, scratch)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
        return df.repartition(partitions, *keys).sortWithinPartitions(*keys, *order)

    order = ["place", "role", "h", "text"]
    level = "conv string, g long, m array<double>"
    levels = [scratch.table(dealt(base.select("conv", "g", "label", *order), ["conv", "g"], order).mapInArrow(_segments, level), "segments")]
    width = ((hi - lo + 1) // SEGMENT + 1) * parts
    while width > 1:
        up = levels[-1].withColumn("up", F.floor(F.col("g") / SEGMENT).cast("long"))
        levels.append(scratch.table(dealt(up, ["conv", "up"], ["g"]).mapInArrow(_upwards, level), "level"))
        width = (width - 1) // SEGMENT + 1
    final = levels[0].groupBy("conv").agg(F.max("g").alias("final"))
    states = scratch.table(levels.pop().mapInArrow(_top, "conv string, g long, s_in int, s_out int"), "ends")
    while levels:
        own = levels.pop().withColumn("up", F.floor(F.col("g") / SEGMENT).cast("long"))
        own = own.join(states.withColumnRenamed("g", "up"), ["conv", "up"])
        states = scratch.table(dealt(own, ["conv", "up"], ["g"]).mapInArrow(_downwards, "conv string, g long, s_in int, s_out int"), "ends")
    states = scratch.table(states.join(final, "conv").withColumn("last", F.col("g") == F.col("final")).drop("final"), "states")
    rows = base.withColumn("conv_id", F.col("conv_id").cast("string")).join(states, ["conv", "g"])
    out = dealt(rows, ["conv", "g"], order).mapInArrow(_turns, "conv_id string, turn long, role string, action string, new_role string, inserted array<string>, cost double, rendered string")
    return scratch.result(out.withColumn("conv_id", F.col("conv_id").cast(turns.schema["conv_id"].dataType)))
