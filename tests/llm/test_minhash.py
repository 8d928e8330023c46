import random
import re
from collections import defaultdict

from lexmill.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def shingle_set(text, size):
    w = WORD.findall(lower(text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(docs, size, percent):
    sets = [(i, shingle_set(t, size)) for i, t in docs]
    by = defaultdict(set)
    for k, (_, s) in enumerate(sets):
        for x in s:
            by[x].add(k)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (_, s) in enumerate(sets):
        near = defaultdict(int)
        for x in s:
            for j in by[x]:
                if j < k:
                    near[j] += 1
        for j, both in near.items():
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                a, b = root(j), root(k)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    low = {}
    for k, (i, _) in enumerate(sets):
        low[root(k)] = min(i, low.get(root(k), i))
    return {i: (len(s), low[root(k)]) for k, (i, s) in enumerate(sets)}


def corpus(seed=3):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)] + ["Éa", "ü", "ß"]
    base = [" ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 4, 40, 90, 200]))) for _ in range(60)]
    docs = []
    for t in base:
        docs.append(t)
        for _ in range(r.choice([0, 0, 1, 3, 12])):
            w = t.split(" ")
            for _ in range(r.choice([0, 1, 2, 4, 9])):
                w[r.randrange(len(w))] = r.choice(vocab)
            docs.append(r.choice([" ", "\n", "\t "]).join(w).upper() if r.random() < 0.3 else " ".join(w))
    docs += ["", " \n", "x " * 30_000, "x " * 30_001]
    r.shuffle(docs)
    return list(enumerate(docs))


def test_matches_brute_force(spark):
    docs = corpus()
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size=4, percent=80).collect()}
    want = brute(docs, 4, 80)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert len(got) > len({c for _, c in want.values()}) > 40


def test_hot_group_is_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    r = random.Random(1)
    base = [f"t{k}" for k in range(120)]
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 5, 6])):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size=4, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, 4, 80)


def test_nulls_ties_repeats_and_other_columns(spark):
    t = " ".join(f"a{k}" for k in range(50))
    rows = [(1, t, 9, "x"), (1, t, 9, "x"), (2, t, None, None), (3, None, 1, "y"), (None, t, 1, "z"), (4, "", 0, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, component_id string")
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 46, 1, True), (1, 46, 1, True), (2, 46, 1, False), (3, 0, 3, True), (None, 46, None, True), (4, 0, 4, True)], key=str)


def test_empty(spark):
    df = minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert df.collect() == [] and df.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_pruning_bound_keeps_the_chosen_miss_probability():
    from math import comb

    for n in (26, 130):
        m = minhash.least_matches(0.8, n)
        tail = sum(comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m))
        assert tail < minhash.MISS <= tail + comb(n + 1, m) * 0.8**m * 0.2 ** (n + 1 - m)


def two_texts():
    r = random.Random(4)
    words = lambda n: [f"v{r.randrange(500)}" for _ in range(n)]
    a, b, c = words(120), words(120), words(90)
    near = " ".join([*a[:-1], "other"])
    return [(1, " ".join(a)), (7, near), (7, " ".join(b)), (9, " ".join([*b[:-1], "new"])), (9, " ".join(c)), (9, " ".join(c)), (12, " ".join(c)), (13, None), (13, "")]


def test_an_id_with_several_texts(spark):
    rows = two_texts()
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, 1, True), (7, 1, False), (7, 7, True), (9, 7, False), (9, 9, True), (9, 9, True), (12, 9, False), (13, 13, True), (13, 13, True)])
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n int")
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([rows[0], rows[2], rows[4], rows[7], rows[8]], key=str)


def test_dropping_keeps_the_smallest_id(spark):
    docs = corpus(5)
    want = brute(docs, 5, 80)
    got = {r.doc_id for r in minhash.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i for i, (_, c) in want.items() if i == c}
    assert minhash.drop_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
