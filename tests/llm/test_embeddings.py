import numpy as np

from lexmill.llm import embeddings


def brute(rows, cosine=0.95):
    units = []
    for _, v in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) if ok else None
        units.append(x / np.linalg.norm(x) if ok else None)
    n = len(rows)
    links = [set() for _ in range(n)]
    for dim in {len(u) for u in units if u is not None}:
        own = [k for k in range(n) if units[k] is not None and len(units[k]) == dim]
        m = np.array([units[k] for k in own])
        for a, b in zip(*np.nonzero(m @ m.T >= cosine), strict=True):
            if a != b:
                links[own[a]].add(own[b])
    out = {}
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links[k]), min(rows[j][0] for j in seen))
    return out


def found(spark, rows, **kw):
    df = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), **kw)
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


def test_groups_at_many_distances(spark, monkeypatch):
    """Chains and clouds around the linking angle: cells, settled and compared pairs, several blocks."""
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    r = np.random.default_rng(5)
    rows = []
    for spread, copies in ((0.005, 60), (0.03, 60), (0.04, 50), (0.05, 40), (0.2, 30), (1, 100)):
        centre = r.standard_normal(32)
        centre /= np.linalg.norm(centre)
        for _ in range(copies):
            rows.append((centre + spread * r.standard_normal(32)) * r.choice([0.1, 1, 50]))
    rows += rows[:5]
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(r.permutation(len(rows)), rows, strict=True)]
    want = brute(rows)
    got = found(spark, rows)
    assert sum(n for n, _ in want.values()) > 4000
    missed = sum(want[i][0] - got[i][0] for i in want)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert missed <= 0.001 * sum(n for n, _ in want.values())
    assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()}


def test_defined_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, inf]), (6, [nan, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [3.0, 0.1]), (None, [1.0, 0.0]), (11, [-1.0, 0.0]), (11, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, n_links string")
    got = sorted(map(tuple, embeddings.near_duplicates(df).collect()), key=str)
    want = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 11, 11)] + [(7, 3, 7, True), (8, 3, 7, False), (8, 3, 7, False), (10, 3, 7, False), (None, 0, None, True)]
    assert got == sorted(want, key=str)


def test_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_isolated_pairs_of_a_large_table(spark, monkeypatch):
    """Pairs just within the linking angle that nothing else links, with codes sized for a million vectors."""
    monkeypatch.setattr(embeddings, "LEAST_COUNT", 1_000_000, raising=False)
    r = np.random.default_rng(11)
    rows = []
    for cosine in np.linspace(0.9501, 0.96, 2000):
        x, z = (v / np.linalg.norm(v) for v in r.standard_normal((2, 64)))
        z -= (z @ x) * x
        rows += [x, cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)]
    rows = [(i, v.tolist()) for i, v in enumerate(rows)]
    assert found(spark, rows) == {i: (1, i - i % 2) for i, _ in rows}


def test_kernels_take_many_vectors_and_groups_at_once():
    import pyarrow as pa

    r = np.random.default_rng(5)
    for dim, least in ((12, 4), (3, 4), (1, 4), (16, 40)):
        x = r.standard_normal((300, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        size, threshold = 60, embeddings._threshold(dim, 4096)
        turn, blocks = embeddings.code(dim, size, 2)
        cut = np.cumsum([0, *(c.shape[1] for c in blocks)])
        parts = [(x @ turn)[:, lo:hi] @ c.T for lo, hi, c in zip(cut, cut[1:], blocks, strict=False)]
        for i, found in enumerate(embeddings.filters(x, size, 2, threshold, least)):
            sums = (parts[0][i][:, None] + (parts[1][i] if len(parts) > 1 else np.zeros(1))[None, :]).ravel()
            t = threshold * np.sqrt(len(parts))
            while (sums >= t).sum() < min(least, len(sums)):
                t -= 0.05
            assert found.tolist() == np.flatnonzero(sums >= t).tolist()
    assert embeddings._pieces(np.array([1, 5, 0, 9, 1]), 4) == [(0, 2), (2, 4), (4, 5)]

    rows = []
    for g in range(40):  # groups of two sides, some of one side only, of vectors of two lengths
        base = r.standard_normal(3 + g % 2)
        for u in range(g % 7 + 1):
            v = base + 0.3 * r.standard_normal(len(base))
            rows.append((g // 8, g, g % 3, 0, u % 2 if g % 5 else 0, 100 * g + u, 1 + u % 3, len(v), (v / np.linalg.norm(v)).tobytes()))
    rows.sort(key=lambda x: x[:4])
    table = pa.table({c: pa.array(v, k) for c, v, k in zip(("a", "b", "i", "j", "side", "uid", "mult", "dim", "unit"), zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)})
    batches = table.to_batches(max_chunksize=11)
    got = list(embeddings._compare(0.9)(iter(batches)))
    want = []
    for x in rows:
        far = [y for y in rows if y[:4] == x[:4] and y[4] != x[4]]
        n = sum(y[6] for y in far if np.frombuffer(x[8]) @ np.frombuffer(y[8]) >= 0.9)
        want += [(x[0], x[1], x[5], n)] if n else []
    assert sorted(tuple(y.values()) for b in got for y in b.to_pylist()) == sorted(want) and want
    assert len(got) <= len(batches) + 1
