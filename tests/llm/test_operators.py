"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, on the operators that stay row by row."""

import hashlib
import re
import zlib

from lexmill.llm import decontam, pii, quality, toxicity, urls, warc

SHA = lambda t: hashlib.sha256(t.encode()).hexdigest()


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", m))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) < 256 for x in m[0].split(".")):
            out.append(("ip", m))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m))
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_pii(spark):
    texts = ["é a.b@c.de_x@y.zz 1.2.3.4.5 300.1.1.1 +1 (203) 555-8282, 4539 1488 0343 6467 1 2", "", None, "1 " * 40_000, "@" * 50, "a@b.c " * 500, "GB82 WEST 1234 5698 7654 32 ssn 123-45-6789 and 123-45-6789", "+12345678 +12345678"]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, "a@b.co", "y"), (0, texts[0], "x")]
    got = pii.report(spark.createDataFrame(rows, "doc_id long, text string, pii string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k, t in enumerate(texts):
        want = base_spans(t or "")
        assert by[k].base_sha256 == SHA(want), (k, by[k].spans[:200], want[:200])
        assert by[k].n_email == want.count("email:") and by[k].n_phone == want.count("phone:")
    assert "iban:0:27" in by[6].spans and "ssn:" in by[6].spans
    one = pii.redact(spark.createDataFrame([(1, "mail a@b.co now", 15)], "doc_id long, text string, n_chars long")).first()
    assert (one.text, one.n_chars) == ("mail [EMAIL] now", len("mail [EMAIL] now"))


def test_urls(spark):
    rows = [(1, "HTTP://A.example.ORG/es/x?q"), (2, None), (3, "no scheme"), (4, "x://b.com"), (5, "http://ads-track.example.net/"), (6, "http://example.org/en/12"), (6, "http://example.org/en/12")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, urls.HOST_RULES, urls.PATTERNS).collect())
    block = (6, "example.org", "/en/12", "example.org/en/1", "block")
    assert got == sorted([(1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "b.com", "", None, "allow"), (5, "ads-track.example.net", "/", None, "block"), block, block])


def test_leaks(spark):
    item = "one two three four five six seven eight nine"
    items = spark.createDataFrame([(7, item, 1), (7, item, 1), (8, "short item", 2), (9, None, 3)], "item_id long, text string, n_hit int")
    docs = spark.createDataFrame([(1, f"x {item.upper()}! y", 5), (2, None, 5), (3, "", 5), (4, f"short item, {item} " + "z " * 60, 5), (4, "short", 5)], "doc_id long, text string, n_hit int")
    got = sorted(map(tuple, decontam.report(docs, items).collect()))
    none = SHA("")
    assert got == sorted([(1, 11, 9, 1, SHA("7"), False), (2, 0, 0, 0, none, False), (3, 0, 0, 0, none, False), (4, 71, 11, 2, SHA("7,8"), True), (4, 1, 0, 0, none, False)])
    sharded = decontam.find_leaks(docs, items, shard_bytes=12).collect()
    assert sorted((r.doc_id, r.n_hit, tuple(r.item_ids)) for r in sharded) == sorted([(1, 9, ("7",)), (2, 0, ()), (3, 0, ()), (4, 11, ("7", "8")), (4, 0, ())])
    clean = {r.text for r in decontam.clean(spark.createDataFrame([(1, "a " * 20 + item + " end", 0)], "doc_id long, text string, n_chars int"), items).collect()}
    assert clean == {"a " * 20 + " end"}


def test_warc(spark):
    big, other = "é" * 600, "b" * 1000
    rows = [(1, "u", big, "x"), (5, "u\n", big, "x"), (3, None, big, "x"), (3, None, big, "x"), (None, "u", big, "x"), (7, "u", "s", "x"), (8, "u", "s", "x"), (9, "u", None, "x"), (10, "u", other, "x"), (10, "u", other, "x")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, digest string")).collect()
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = [(i, 1200, sha(big), "revisit", 5) for i in (1, 3, 3, None)] + [(5, 1200, sha(big), "response", None), (7, 1, sha("s"), "response", None), (8, 1, sha("s"), "response", None), (9, 0, sha(""), "response", None)] + [(10, 1000, sha(other), "response", None)] * 2
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def labelled(spark, column, n=240):
    good, bad = "the quiet river runs by old stone houses and " * 3, {"quality": "*** !!! ### $$$ @@@ %%% &&& ", "toxic": "you utter blockhead of a person "}[column]
    rows, marks = [], []
    for k in range(n):
        odd = k % 3 == 0
        rows.append((k, (bad * (2 + k % 5) if odd and column == "quality" else good + (bad if odd else "")) + f" w{k} {k * 7919 % 1000}", "z"))
        marks.append((k, 1 - int(odd) if column == "quality" else int(odd)))
    return spark.createDataFrame([*rows, (n, None, "z"), (n + 1, "", "z"), (None, "x", "z")], "doc_id long, text string, label string"), spark.createDataFrame([*marks, (None, 1), (5, None)], f"doc_id long, {column} int"), dict(marks)


def check_scores(got, marks, folds, held):
    assert len(got) == len(marks) + 3
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
    own = [r for r in got if r.doc_id in marks and r.held_out]
    assert sum(r.predicted == marks[r.doc_id] for r in own) >= 0.9 * len(own) > 20


def test_quality(spark):
    docs, labels, marks = labelled(spark, "quality")
    check_scores(quality.report(docs, labels).collect(), marks, 5, 0)
    kept = {r.doc_id for r in quality.filter_quality(docs, labels).collect()}
    assert {k for k, v in marks.items() if v == 1} <= kept


def test_toxicity(spark):
    docs, labels, marks = labelled(spark, "toxic")
    check_scores(toxicity.report(docs, labels).collect(), marks, 4, 2)


def test_scores_without_labels(spark):
    docs, labels, _ = labelled(spark, "toxic", 9)
    none = labels.where("false")
    assert {r.score for r in toxicity.report(docs, none).collect()} == {0.5}
    assert {r.score for r in quality.report(docs, none.withColumnRenamed("toxic", "quality")).collect()} == {0.5}
    assert toxicity.report(docs.where("false"), labels).collect() == []
