"""Nulls, empty tables, very long rows and clashing names on DataFrames, where the other tests don't have them."""

import hashlib

import pytest
from test_minhash import brute

from lexmill.llm import decontam, minhash, pieces, pii, quality, toxicity, urls, warc

SHA = lambda t: hashlib.sha256(t.encode()).hexdigest()
DOCS = "doc_id long, text string"


def test_pieces_of_rows(spark, monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    library = pieces.model(path).library
    texts = ["Hello world", None, "", "Hello world", "é ñ " * 9, "long words stand here " * 20_000]
    df = spark.createDataFrame([(k % 4, t, "x", "y", "z", "w") for k, t in enumerate(texts)], f"{DOCS}, ids string, boundaries string, decoded string, other string")
    got = pieces.encode(df, path, decode=True)
    assert got.columns == ["doc_id", "text", "other", "ids", "boundaries", "decoded"]
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode(r.text or "", add_eos=True)
        assert list(r.ids) == want and r.decoded == library.decode(want) and r.boundaries[-1] == len((r.text or "").encode())
    back = pieces.decode(got, path).select("text", "decoded").collect()
    assert all(r.decoded == (r.text or "") for r in back)
    seen = {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.report(df, path).collect()}
    assert seen == {(len(i), SHA(" ".join(map(str, i))), SHA(library.decode(i))) for i in (library.encode(t or "", add_eos=True) for t in texts)}
    assert pieces.report(df.where("false"), path).collect() == []


def test_urls_in_passes(spark, monkeypatch):
    long = "http://x.example.net/" + "a/" * 30_000 + "ads-track.js"
    rows = [(1, long), (2, "http://ads-track.example.net/"), (3, None), (4, ""), (5, "http://a.fr.com/fr/x")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    once = sorted(map(tuple, urls.judge(df, urls.HOST_RULES, urls.PATTERNS).collect()))
    monkeypatch.setattr(urls, "RULES_PER_PASS", 2)
    assert sorted(map(tuple, urls.judge(df, urls.HOST_RULES, urls.PATTERNS).collect())) == once and len(once) == 5
    assert urls.judge(df.where("false"), urls.HOST_RULES, urls.PATTERNS).collect() == []


def test_leaks_of_nothing_and_of_long_texts(spark):
    docs = spark.createDataFrame([(1, "w " * 200_000 + "one two three four five six seven eight " + "z " * 200_000), (2, None)], DOCS)
    items = spark.createDataFrame([(5, "One two three four five six seven eight")], "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontam.report(docs, items).collect())
    assert got == [(1, 400_008, 8, 1), (2, 0, 0, 0)]
    assert {r.n_hit for r in decontam.report(docs, items.where("false")).collect()} == {0}
    assert decontam.report(docs.where("false"), items).collect() == []
    kept = {r.doc_id: r.text for r in decontam.clean(docs, items).collect()}
    assert kept[2] is None and kept[1] == "w " * 200_000 + " " + "z " * 200_000


def test_scores_of_nothing_and_of_long_texts(spark):
    rows = [(k, ("you utter blockhead " if k % 2 else "the calm river runs ") * 5 + f"w{k}") for k in range(80)] + [(80, "plain words in a row " * 40_000), (81, None)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, 1 - k % 2, k % 2) for k in range(80)], "doc_id long, quality int, toxic int")
    for report in (toxicity.report, quality.report):
        got = report(docs, labels).collect()
        assert len(got) == 82 and all(0 <= r.score <= 1 for r in got)
        assert report(docs.where("false"), labels).collect() == []


def test_a_label_given_twice_counts_once(spark):
    docs = spark.createDataFrame([(k, f"{'x1 ' if k % 2 else 'word '}" * (5 + k % 3)) for k in range(40)], DOCS)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    one, many = (sorted((r.doc_id, round(r.score, 9)) for r in quality.report(docs, x).collect()) for x in (labels, labels.unionByName(labels.where("quality = 1"))))
    assert one == many


def test_pii_of_nothing(spark):
    empty = spark.createDataFrame([], f"{DOCS}, n_chars long")
    assert pii.report(empty).collect() == [] and pii.redact(empty).collect() == []
    many = " ".join(f"a{k}@b.co" for k in range(3000))
    one = pii.redact(spark.createDataFrame([(1, many), (2, None), (3, "")], DOCS))
    assert {r.doc_id: r.text for r in one.collect()} == {1: " ".join(["[EMAIL]"] * 3000), 2: None, 3: ""}


def test_large_payloads(spark):
    big = "é" * 1_500_000
    rows = [(1, "u", big), (2, "u", big), (3, "u", big[:-1])]
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(1, 3_000_000, "revisit", 2), (2, 3_000_000, "response", None), (3, 2_999_998, "response", None)]


def test_repeated_rows_in_many_tasks(spark):
    t = " ".join(f"a{k}" for k in range(60))
    rows = [(1, t), (2, t + " more")] * 40 + [(3, "other text of its own")]
    df = spark.createDataFrame(rows, DOCS).repartition(8)
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 3)} and brute(rows[:2], 5, 80)[2][1] == 1
    assert sorted(r.doc_id for r in minhash.drop_near_duplicates(df).collect()) == [1, 3]


def test_exported_archives_and_their_index(spark, tmp_path):
    import zlib

    from lexmill.llm.scratch import Scratch

    rows = [(k, f"http://x/{k}", f"<p>{k}</p>" * 300 if k != 3 else "<p>2</p>" * 300) for k in range(1, 6)]
    scratch = Scratch(spark, "export")
    archives = warc.normalised(warc.monolithic(warc.plan(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), scratch), size=4000))
    names = warc.export(archives, str(tmp_path))
    assert names and warc.export(archives, str(tmp_path)) == names
    for name in names:
        data = (tmp_path / name).read_bytes()
        for line in (tmp_path / f"{name}.idx").read_text().splitlines():
            ident, kind, offset, length = line.split(" ")
            member = zlib.decompress(data[int(offset) : int(offset) + int(length)], 31)
            assert member.startswith(b"WARC/1.1") and ident.encode() in member and f"WARC-Type: {kind}".encode() in member
    loaded = warc.load(spark, f"{tmp_path}/*.warc.gz")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read(warc.normalised(loaded)).collect())
    assert got == [(1, "response", None), (2, "revisit", 3), (3, "response", None), (4, "response", None), (5, "response", None)]
