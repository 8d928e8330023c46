"""The whole pipeline against a plain one: numpy densities, all-pairs shingle sets, naive windows, the re module, the library."""

import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest

from lexmill.llm import decontam, pieces, quality
from test_minhash import brute, shingle_set

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def prose(r, n):
    vocab = [f"{a}{b}" for a in ("river", "stone", "house", "garden", "letter", "window", "winter", "bridge") for b in ("", "s", "side", "less", "ward", "like")]
    out = []
    for k in range(n):
        w = r.choice(vocab) + "".join(r.choice(string.ascii_lowercase) for _ in range(r.randrange(3)))
        out.append(w.capitalize() if k % 9 == 0 else w + "." if k % 9 == 8 else w)
    return " ".join(out)


def tables(tmp_path):
    r = random.Random(8)
    items = [(k, prose(r, 20)) for k in range(1, 6)] + [(9, "tiny exam"), (10, None)]
    docs, labels = [], []

    def put(text, good=None):
        i = len(docs) + 1
        docs.append((i, text, "en", f"s{i % 3}", len(text or "")))
        if good is not None:
            labels.append((i, good, 0))
        return i

    for k in range(150):
        put(prose(r, r.randrange(40, 120)), 1 if k % 2 else None)
        put(" ".join(r.choice(["***", "###", "$$$ aa", "!!!", "@@ 7"]) for _ in range(r.randrange(30, 90))), 0 if k % 2 else None)
    base = [d for d in docs if d[0] % 2][:20]
    for d in base[:8]:
        put(d[1])
        w = d[1].split(" ")
        put(" ".join([*w[:-1], "changed"]))
    for k, d in enumerate(base[8:14]):
        put(d[1] + " once more and then " + items[k % 5][1] + " the end of it é")
    put(prose(r, 60) + " " + items[0][1] + " middle words " + items[1][1])  # two items
    put(items[2][1] + " few")  # mostly leaked
    for k in range(5):
        put(prose(r, 50) + f" write to some{k}.one@mail{k}.example.org or call +1 202-555-01{k}9 now")
    put(None)
    put("")
    docs.append((docs[0][0], docs[0][1], "en", "again", 3))  # id and text repeated
    folder = tmp_path / "tables"
    folder.mkdir()
    import pyarrow.parquet as pq

    types = {"documents": (docs, [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]), "benchmark": (items, [("item_id", pa.int64()), ("text", pa.string())]), "labels": (labels, [("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])}
    for name, (rows, cols) in types.items():
        pq.write_table(pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), cols, strict=True)], names=[n for n, _ in cols]), folder / f"{name}.parquet")
    return str(folder), docs, items, labels


def plain_quality(docs, labels):
    """Both classes' Gaussian densities written out, with a second fit without doubtful rows."""
    import zlib

    x = {d[0]: quality._of_column(pa.array([d[1]], pa.string()))[0] for d in docs}
    rows = [(x[i], y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % quality.FOLDS]
    d = len(quality.NAMES)

    def fit(rows):
        own = [np.array([v for v, y in rows if y == k]) for k in (0, 1)]
        cov = [np.cov(o.T, bias=True) for o in own]
        pooled = sum(len(o) * c for o, c in zip(own, cov, strict=True)) / len(rows)
        out = []
        for o, c in zip(own, cov, strict=True):
            c = (1 - quality.POOL) * c + quality.POOL * pooled
            c = (1 - quality.DIAGONAL) * c + quality.DIAGONAL * np.diag(np.diag(c)) + quality.RIDGE * np.eye(d)
            out.append((o.mean(0), np.linalg.inv(c), np.linalg.slogdet(c)[1], len(o) / len(rows)))
        return out

    def score(v, m):
        logs = [np.log(p) - 0.5 * (det + (v - mu) @ inv @ (v - mu)) for mu, inv, det, p in m]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))

    m = fit(rows)
    m = fit([(v, y) for v, y in rows if (score(v, m) if y else 1 - score(v, m)) >= quality.DOUBT])
    return {i: score(v, m) for i, v in x.items()}


def plain_clean(text, items):
    """The text without leaked words, or None if the document goes."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    spots = list(pattern.finditer(low))
    words, hit, found = [m[0] for m in spots], set(), set()
    for i, t in items:
        w = pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(len(w), decontam.WINDOW)
        for k in range(len(w) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == w[k : k + n]:
                    hit |= set(range(p, p + n))
                    found.add(i)
    if len(found) >= decontam.ITEMS or len(hit) >= decontam.COVERAGE * max(len(words), 1):
        return None
    out, at = "", 0
    for k in sorted(hit):
        if k - 1 not in hit:
            out += (text or "")[at : spots[k].start()]
        at = spots[k].end()
    return out + text[at:] if text is not None else None if hit else text


def plain_pii(text):
    text = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", text or "")
    return re.sub(r"\+[0-9][\x20().0-9-]+[0-9]", "[PHONE]", text)


def test_pipeline_matches_a_plain_one(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    folder, docs, items, labels = tables(tmp_path)
    scores = plain_quality(docs, labels)
    kept = [d for d in docs if scores[d[0]] >= quality.ACCEPT]
    assert 100 < len(kept) < len(docs) - 100
    unique = list(dict.fromkeys((d[0], d[1]) for d in kept))
    linked = brute(unique, corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    kept = [d for k, d in enumerate(kept) if linked[d[0]][1] == d[0] and (d[0], d[1]) not in {(e[0], e[1]) for e in kept[:k]}]
    assert len(kept) <= len(unique) - 16 and shingle_set("a b", 5) == {("a", "b")}
    cleaned = [(d[0], plain_clean(d[1], items)) for d in kept]
    gone = sum(t is None and d[1] is not None for (_, t), d in zip(cleaned, kept, strict=True))
    assert gone >= 2 and sum(t != d[1] for (_, t), d in zip(cleaned, kept, strict=True)) >= gone + 6
    want = {}
    library = pieces.model(public.path("piece_bpe_32k.model")).library
    for (i, t), d in zip(cleaned, kept, strict=True):
        if t is not None or d[1] is None:
            text = plain_pii(t)
            want[i] = (library.encode(text, add_eos=True), text)
    assert sum("[EMAIL]" in t and "[PHONE]" in t for _, t in want.values()) == 5
    got = corpus_pipeline.run(spark, folder).collect()
    assert len(got) == len(want) and {r.doc_id: list(r.ids) for r in got} == {i: ids for i, (ids, _) in want.items()}
    for r in got:
        raw = want[r.doc_id][1].encode()
        assert r.n_tokens == len(r.ids) and r.boundaries[0] == 0 and r.boundaries[-1] == len(raw)
        assert library.decode(list(r.ids)) == raw.decode()


def test_stages_keep_the_columns(spark, tmp_path):
    folder, docs, *_ = tables(tmp_path)
    df = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, folder).columns == df.columns, name
    empty = df.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).collect() == [], name
