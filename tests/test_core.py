"""Behaviour of the spell-checking core on small examples."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import chars, distance, text
from lexmill.operators import dictionary, directives, edits, lookup, ranges, suggest, tokens
from lexmill.operators.checker import Checker, Config, capitals_base, possessive_base
from lexmill.operators.dictionary import Lexicon, Options
from lexmill.plans import compat, config, globs, patterns
from lexmill.sources import dictionaries, files


def rows(spark, words, kind="word", name="d"):
    return spark.createDataFrame([(name, kind, w, None) for w in words], dictionary.SCHEMA)


@pytest.mark.parametrize(
    ("word", "parts"),
    [("camelCase", ["camel", "Case"]), ("HTMLParser", ["HTML", "Parser"]), ("URLsAndDBAs", ["URLs", "And", "DBAs"]), ("XMLHttpRequest", ["XML", "Http", "Request"]), ("plain", ["plain"]), ("WALKingRUNning", ["WALKing", "RUNning"])],
)
def test_camel_parts(spark, word, parts):
    assert chars.camel_parts(word) == parts
    assert spark.createDataFrame([(word,)], "w string").select(text.camel_parts("w").alias("p")).first().p == parts


def test_distances():
    assert distance.osa("ca", "abc") == 3
    assert distance.osa("teh", "the") == 1
    assert distance.osa("", "abc") == 3
    assert distance.weighted_osa("Hello", "hello") == 0
    assert distance.weighted_osa("helko", "hello") == 75


def test_lines_and_tokens(spark):
    docs = spark.createDataFrame([(1, "don't É b\r\n\nhéllo x1_y"), (2, ""), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.line): (r.line_text, r.line_offset) for r in tokens.lines(docs, "doc_id").collect()}
    assert got == {(1, 1): ("don't É b", 0), (1, 2): ("", 12), (1, 3): ("héllo x1_y", 13), (2, 1): ("", 0), (3, 1): ("", 0)}
    words = [(r.word, r.offset, r.column) for r in tokens.tokens(docs, "doc_id").orderBy("offset").collect()]
    assert words == [("don't", 0, 1), ("É", 6, 7), ("b", 9, 9), ("héllo", 13, 1), ("x", 20, 7), ("y", 23, 10)]
    assert [r.word for r in tokens.tokens(docs, "doc_id", kind="code").orderBy("offset").collect()] == ["don't", "É", "b", "héllo", "x1_y"]


def test_endings():
    assert possessive_base("word's") == "word" and possessive_base("we’ll") == "we" and possessive_base("x'y") is None
    assert capitals_base("REPLs") == "REPL" and capitals_base("ERROR'S") == "ERROR" and capitals_base("ERRORS") is None


def test_ranges(spark):
    df = spark.createDataFrame([("see http://a.b/c and 0xFFAA or 1234567 é a@b.co",)], "text string")
    got = ranges.pattern_ranges(df, ranges.SKIP).select(F.explode("ranges").alias("r")).select("r.s", "r.e").collect()
    raw = b"see http://a.b/c and 0xFFAA or 1234567 \xc3\xa9 a@b.co"
    assert [raw[r.s : r.e] for r in got] == [b"http://a.b/c", b"0xFFAA", b"1234567", b"a@b.co"]
    both = spark.range(1).selectExpr("array(named_struct('s',0L,'e',10L)) AS a", "array(named_struct('s',2L,'e',4L),named_struct('s',8L,'e',20L)) AS b")
    assert [tuple(x) for x in both.select(ranges.subtract("a", "b").alias("r")).first().r] == [(0, 2), (4, 8)]


@pytest.mark.parametrize(
    ("line", "kind", "args"),
    [("# cspell:words a, b;c", "words", ["a", "b", "c"]), ("spell-checker: disable", "disable", []), ("// cSpell::disable-next-line", "disable_next_line", []), ("cspell:ignoreRegExp /a.b/gi x", "ignore_regexp", ["/a.b/gi"]), ("LocalWords: x y", "local_words", ["x", "y"]), ("cspell:forbid-words z", "forbid", ["z"]), ("cspell:enables", None, None), ("nothing", None, None)],
)
def test_directives(spark, line, kind, args):
    r = directives.parse(spark.createDataFrame([(1, line)], "line int, line_text string")).first()
    assert r.kind == kind and (kind is None or r.args == args)
    assert directives.parse_line(line) == (None if kind is None else (kind, args))


def test_entries(spark):
    e = spark.createDataFrame([("d", x) for x in ["Word", "!bad", "~quiet", "pre*", "+post", "a*b", ":x->y", "w:sugg"]], "dict string, entry string")
    got = {(r.kind, r.key) for r in dictionary.entry_rows(e).collect()}
    assert {("word", "word"), ("forbidden", "bad"), ("no_suggest", "quiet"), ("word", "quiet"), ("part_first", "pre"), ("word", "pre"), ("part_last", "post"), ("word", "ab"), ("word", "x"), ("word", "w")} <= got
    assert ("word", "post") not in got


def test_trie():
    assert dictionaries.decode_trie("hello$5", 10) == ["hello"]
    assert dictionaries.decode_trie("walked$2ing$3$", 10) == ["walk", "walked", "walking"]
    with pytest.raises(dictionaries.TrieError):
        dictionaries.trie_words("base=10\n__DATA__\n")


def test_affixes(spark):
    rules = dictionaries.parse_affixes("SFX D Y 2\nSFX D 0 ed [^y]\nSFX D y ied y\nPFX U Y 1\nPFX U 0 un .\n")
    words = spark.createDataFrame([("walk", ["D", "U"]), ("try", ["D"])], "word string, flags array<string>")
    got = {r.form for r in dictionaries.affix_forms(words, dictionaries.rules_frame(spark, rules)).collect()}
    assert got == {"walk", "walked", "unwalk", "unwalked", "try", "tried"}


def test_lookups(spark):
    d = rows(spark, ["house", "été", "walk"]).unionByName(rows(spark, ["news"], "part_first")).unionByName(rows(spark, ["paper"], "part_last"))
    w = spark.createDataFrame([(x,) for x in ["House", "ÉTÉ", "xyz", "newspaper", "housewalk"]], "word string")
    assert {r.word for r in lookup.known(w, d).collect()} == {"House", "ÉTÉ"}
    assert {r.word for r in lookup.two_part_compounds(w, d).collect()} == {"newspaper"}
    assert {r.word for r in lookup.joined_compounds(w, d).collect()} == {"housewalk"}
    assert dictionary.alternatives("strasse", [("ss", "ß")]) == ["straße"]


def test_suggestions(spark):
    d = rows(spark, ["hello", "help", "shell", "world"])
    got = suggest.nearest(spark.createDataFrame([("helo",)], "word string"), d).orderBy("rank").collect()
    assert [r.suggestion for r in got][:2] == ["hello", "help"] or [r.suggestion for r in got][0] in ("hello", "help")


def test_patterns_and_globs():
    assert patterns.plain("/a b/ix") == "(?i)ab"
    assert patterns.setting("foo(?=bar)") == ("(?im)foo(?:bar)", False)
    assert patterns.setting("/(?<!x)y/") is None and patterns.directive("(?=x)") is None
    assert globs.nested("foo") == ["**/foo", "**/foo/**"] and globs.nested("/a/b/") == ["a/b/**/*"]
    assert globs.extglobs("a!(b|c)d") == ["a*d", "!abd", "!acd"]


def test_config():
    assert config.without_comments('{// x\n a: 1, "b": [1, 2,], /* y */}') in ('{\n "a": 1, "b": [1, 2] }', '{\n "a": 1, "b": [1, 2], }')
    merged = config.merge({"words": ["a"], "dictionaries": ["X"], "language": "en"}, {"words": ["b"], "dictionaries": ["x", "y"], "language": "fr"})
    assert merged == {"words": ["a", "b"], "dictionaries": ["X", "y"], "language": "fr"}
    assert config.parse_yaml("words:\n  - a\n  - b\nlanguage: en\noverrides:\n  - filename: '*.md'\n    words: [x]\n")["overrides"][0]["words"] == ["x"]


def test_files(spark):
    df = spark.createDataFrame([("a/b.py",), ("Dockerfile",), ("x/package-lock.json",), ("y.vue",)], "path string")
    got = {r.path: (list(r.l), r.g) for r in df.select("path", files.languages(F.col("path")).alias("l"), files.generated(F.col("path")).alias("g")).collect()}
    assert got == {"a/b.py": (["python"], False), "Dockerfile": (["dockerfile"], False), "x/package-lock.json": (["json"], True), "y.vue": (["html", "vue"], False)}
    diff = "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -1,3 +1,4 @@\n a\n-b\n+B\n+C\n d\n"
    more = "diff --git a/g b/g\ndeleted file mode 100644\n--- a/g\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n" + diff.replace("/f", "/h").replace("+1,4", "+11,4")
    raw = spark.createDataFrame([(diff + more,)], "text string")
    assert sorted((r.path, r.line) for r in files.diff_lines(raw).collect()) == [("f", 2), ("f", 3), ("h", 12), ("h", 13)]


def tree(tmp_path, contents):
    for name, text in contents.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(tmp_path)


def test_check_of_a_folder(spark, tmp_path, capsys):
    from lexmill import cli

    root = tree(tmp_path / "repo", {
        ".git/HEAD": "", ".gitignore": "build\n# note\n*.tmp\n", "cspell.json": '{"words": ["alpha", "plain"], "minWordLength": 4}',
        "a.txt": "alpha plain wrongg\n", "b.md": "plain", "x.tmp": "badd worrd", "build/y.txt": "badd",
        ".gitattributes": "vendor/** linguist-vendored\n", "vendor/z.txt": "badd",
        "sub/.gitignore": "skip.txt\n", "sub/skip.txt": "badd", "sub/cspell.json": '{"words": ["inner"]}', "sub/c.txt": "inner alpha\nalpha", "sub/deep/d.txt": "inner beta",
    })

    def run(*options):
        code = cli.main(["check", root, *options], spark)
        return code, capsys.readouterr().out.strip().split("\n")

    code, lines = run("--strict", "--no-default-configuration", "--stats", "--show-context")
    short = sorted(x.removeprefix(root + "/") for x in lines[:-1])
    assert code == 1 and short == ["a.txt:1:13 - Unknown word (wrongg) -- alpha plain wrongg", "sub/c.txt:1:7 - Unknown word (alpha) -- inner alpha", "sub/c.txt:2:1 - Unknown word (alpha) -- alpha", "sub/deep/d.txt:1:7 - Unknown word (beta) -- inner beta"]
    assert lines[-1].endswith("3 with issues, 4 issues")
    (tmp_path / "d.diff").write_text("diff --git a/sub/c.txt b/sub/c.txt\n--- a/sub/c.txt\n+++ b/sub/c.txt\n@@ -0,0 +1 @@\n+inner alpha\n")
    (tmp_path / "list").write_text(f"{root}/sub/c.txt\n\n{root}/a.txt\n{root}/b.md\n")
    cache = str(tmp_path / "cache")
    options = ["--config", f"{root}/cspell.json", "--format", "json", "--unique", "--file-list", str(tmp_path / "list"), "--diff", str(tmp_path / "d.diff"), "--cache", cache]
    found = __import__("json").loads("".join(run(*options)[1]))
    assert found["summary"] == {"files_with_issues": 1, "total_issues": 1} and [(f["path"].removeprefix(root), f["issues"][0]["word"]) for f in found["files"]] == [("/sub/c.txt", "inner")]
    assert f"{root}/b.md" in {r.path for r in spark.read.parquet(cache).collect()}


def test_selection_of_files(spark, tmp_path):
    from lexmill import api

    root = tree(tmp_path / "r", {".gitignore": "build\n*.tmp\n", ".gitattributes": "vendor/** linguist-vendored\n", "a.txt": "x", "x.tmp": "x", "build/y.txt": "x", "vendor/z.txt": "x", "sub/.gitignore": "skip.txt\n", "sub/skip.txt": "x", "skip.txt": "x", "sub/c.txt": "x"})
    names = lambda **kw: sorted(r.path.removeprefix(root) for r in api.selected_files(spark, root, {}, **kw).select("path").collect())
    assert names() == ["/a.txt", "/skip.txt", "/sub/c.txt"]
    assert names(gitignore=False) == ["/a.txt", "/build/y.txt", "/skip.txt", "/sub/c.txt", "/sub/skip.txt", "/vendor/z.txt", "/x.tmp"]


def test_commands_on_files(tmp_path, capsys):
    from lexmill import cli

    words = str(tmp_path / "dict" / "words.txt")
    assert cli.add_words(words, ["One", "two", "One"]) == ["One", "two"] and cli.add_words(words, ["ONE", "x"], True) == ["!ONE", "!x"] and cli.add_words(words, ["one"]) == []
    conf = tmp_path / "cspell.json"
    conf.write_text('{"words": ["b", "a"], "import": ["base.json"]}')
    assert cli.main(["link", "add", "more.json", "--config", str(conf)]) == 0 and capsys.readouterr().out == "base.json\nmore.json\n"
    assert cli.main(["link", "remove", "base.json", "--config", str(conf)]) == 0 and cli.main(["migrate", str(conf)]) == 0
    assert config.read_words(words)[-2:] == ["a", "b"] and '"word_files"' in (tmp_path / "cspell.migrated.json").read_text()


def test_spell_check_function(spark):
    from lexmill import api

    api.register(spark, {"words": ["alpha"], "minWordLength": 4})
    got = spark.sql("SELECT d.id, s.word, s.line FROM VALUES (1, 'alpha bettta'), (2, 'alpha'), (3, NULL) AS d(id, t), LATERAL spell_check(d.t) s").collect()
    assert [tuple(r) for r in got] == [(1, "bettta", 1)]


def test_edits():
    assert edits.replaced("a teh b\nTeh", [(1, 3), (2, 1)], "teh", "the") == "a the b\nthe"


def checker(words, **kw):
    return Checker([Lexicon(Options("d"), {"word": set(words)})], Config(**kw))


def test_splitter_and_compat():
    c = checker({"hello", "world", "error"})
    assert [i[0] for i in compat.check_text("hello wrold errorcode", c)] == ["wrold", "errorcode"]
    assert compat.check_text("HELLOs helloWorld hello_world", c) == []
    assert [(i[0], i[1], i[2], i[3]) for i in compat.check_text("hello\n é badd", c)] == [("badd", 10, 2, 4)]
    assert [i[0] for i in compat.check_text("zzyx zzyx zzyx zzyx zzyx zzyx zzyx", c)] == ["zzyx"] * 5
    assert compat.check_text("# cspell:disable\nwrold", c) == []


def test_wide_lookups_equal_broadcast_ones(spark, monkeypatch):
    import pyarrow as pa

    from lexmill.plans import native

    options = [Options("d", rep_map=[("ss", "ß"), ("a", "ä")]), Options("c", case_sensitive=True, configured=True, use_compounds=True, rep_map=[("e", "é")])]
    entries = rows(spark, ["straße", "café", "don't", "käse", "größe", "plain"]).unionByName(rows(spark, ["Été", "wort", "Café"], name="c")).unionByName(rows(spark, ["foo"], "part_first")).unionByName(rows(spark, ["bär"], "part_last")).unionByName(rows(spark, ["übel"], "forbidden"))
    asked = ["strasse", "Strasse", "cafe\u0301", "CAFE\u0301s", "don’t", "don\\\\'t", "kase", "Kasex", "foobar", "GRÖSSE", "grösse", "U\u0308bel", "Eté", "ete", "plainCase", "wortwort", "wrong", "STRASSEs"]
    words = spark.createDataFrame([(w, None, False, False, False, None, None, None) for w in asked], "word string, code string, escaped boolean, compound boolean, case_sensitive boolean, extra array<string>, inline array<string>, flags array<string>")

    def decided():
        got = native._each(words, entries, native._dictionary(entries), options, Config(), native._decide, native.PARTS, "parts", native._PARTS)
        return {r.word: [tuple(p) for p in r.parts] for r in got.collect()}

    want = decided()
    assert want["strasse"] == [] and want["cafe\u0301"] == [] and want["foobar"] == [] and want["wrong"]
    texts = [" ".join(asked), "fooBarBaz plainCaseWrong straßeCafé don\\'t \\nplain wort-wort 12th x_y", "# cspell:words alpha\nalpha beta\n# cspell:disable\nzzzz\n# cspell:enable\nGRÖSSEs übel", "", None, "plain wrong " * 40]
    docs = spark.createDataFrame([*enumerate(texts), (None, "wrong again"), (1, texts[1])], "doc_id long, text string")

    def checked(run):
        return sorted(map(str, run(docs, entries, options, Config(max_duplicates=50)).collect()))

    whole = [checked(run) for run in (native.check_native, native.check_compat)]
    assert all(len(x) > 20 for x in whole)
    monkeypatch.setattr(native, "BROADCAST_ROWS", 0)
    assert decided() == want
    assert [checked(run) for run in (native.check_native, native.check_compat)] == whole


def test_probes_hold_all_keys_of_the_dictionary_lengths():
    from lexmill.plans.native import probes

    lengths = frozenset({2, 3, 5})
    for w in ("straße", "cafe\u0301s", "don’t", "a\\'b", "ΣΑΣ", "İx"):
        assert probes(w, [("ss", "ß"), ("a", "ä")], lengths) == {x for x in probes(w, [("ss", "ß"), ("a", "ä")]) if len(x) in lengths}


def test_ranges_merge_like_rows(spark):
    import random

    from lexmill.operators import ranges

    r = random.Random(2)
    sets = [sorted((a, a + r.randrange(1, 9)) for a in (r.randrange(200) for _ in range(n))) for n in (0, 1, 2, 7, 40, 90)]
    df = spark.createDataFrame(list(enumerate([[{"s": a, "e": b} for a, b in x] for x in sets])), f"k int, r {ranges.RANGE}")
    got = {x.k: [(y.s, y.e) for y in x.m] for x in df.selectExpr("k", f"{ranges.merged_sql('array_sort(r)')} AS m").collect()}
    for k, x in enumerate(sets):
        want = []
        for a, b in x:
            if want and a <= want[-1][1]:
                want[-1] = (want[-1][0], max(want[-1][1], b))
            else:
                want.append((a, b))
        assert got[k] == want


def test_queries_over_all_rows(spark, tmp_path):
    import hashlib

    import regex

    from lexmill.queries import QUERIES

    texts = ["aB1cD2eF3gH4iJ5kL6 éÀ1éÀ2éÀ3éÀ4éÀ5éÀ6 short straßen-ñandú_Ünïcödé", "", "  indented\nlast\n", "\n", "тестслово ééé abcdef äöüéàè abc äöü éééabc x", None]
    paths = ["http://a.org/b_c", "http://a.org/Ünder", "http://a.org/under", "http://a.org/ünder", "http://a.org/B-c", "http://a.org/é_x", "http://a.org/é.x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7 * k + 5, u) for k, u in enumerate(paths)], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(1, "abc def ééé äö ü éà è тест слово éü")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    run = lambda name: [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]

    def shape(w):
        for pattern, mark in ((r"[0-9]+", "0"), (r"\p{Ll}\p{M}+", "a"), (r"\p{Lu}\p{M}+", "A"), (r"\p{Lu}?\p{Ll}+", "1"), (r"\p{Lu}+", "2"), (r"\p{M}", "4"), ("_", ""), (r"[-_.']+", "3")):
            w = regex.sub(pattern, mark, w)
        return w

    tokens_ = {w for t in texts if t is not None for w in regex.split(r"[ \n]+", t)}
    assert set(run("random_strings_all")) == {(w, shape(w), len(w) >= 16 and len(shape(w).encode()) / len(w) >= 0.5) for w in tokens_}
    bench = {"abc", "def", "ééé", "äö", "ü", "éà", "è", "тест", "слово", "éü"}
    words = {w for t in texts if t for w in chars.PY_WORDS.findall(t)}
    want = {w for w in words if dictionary.joins(w.lower(), lambda p: p in bench, 3, lambda p: len(p.encode()))}
    assert {"тестслово", "abcdef", "éééabc"} <= want and {w for (w,) in run("compound_join_all")} == want
    fold = str.maketrans("_-./\\", "\x01\x02\x03\x04\x04")
    own = [u[7:] for u in paths]
    order = sorted(own, key=lambda p: (p.lower().translate(fold) if p.isascii() else p.lower(), len(p), "".join(c.swapcase() if c.isascii() else c for c in p)))
    assert dict(run("path_sort_all")) == {p: k + 1 for k, p in enumerate(order)}

    def disabled(t):
        lines = t.splitlines()
        if lines:
            lines.insert(0, lines[0][: len(lines[0]) - len(lines[0].lstrip())] + "# spell-checker:disable-next-line")
        return "\n".join(lines) + ("\n" if t.endswith("\n") else "")

    assert dict(run("disable_lines_all")) == {k: None if t is None else hashlib.md5(disabled(t).encode()).hexdigest() for k, t in enumerate(texts)}


def test_plain_words_skip_the_search_for_breaks(monkeypatch):
    from lexmill.operators.dictionary import lexicons

    make = lambda: Checker(lexicons([("d", "word", w, None) for w in ("good", "here", "ame", "mple")], [Options("d")]), Config())
    words = ["good", "wrng", "Wrng", "é", "naïve", "\\nGood", "\\name", "name", "goodHere", "aaaaa", "eeee", "exa\\mple", "ABCing", "wrng.", "x1", "here's", "Éé́t"]
    texts = [" ".join(words[(i * k) % len(words)] for k in range(1, 12)) for i in range(40)]
    texts += ["cspell:words wrng\n" + t + "\ncspell:forbid name\n" + t + "\ncspell:enableCompoundWords\n" + t for t in texts]
    fast = [compat.check_text(t, make()) for t in texts]
    monkeypatch.setattr(Checker, "plain_kind", lambda self, word, state: "")
    monkeypatch.setattr(compat, "plain", lambda word: False)
    assert fast == [compat.check_text(t, make()) for t in texts]
    monkeypatch.undo()
    monkeypatch.setattr(compat, "split", lambda *a: pytest.fail("searched"))
    assert [i[0] for i in compat.check_text("wrng good Trble", make())] == ["wrng", "Trble"]


def test_places_hold_however_paths_are_read_again(spark):
    from lexmill import queries

    own = spark.range(0, 60_000, 1, 7).select(F.concat(F.md5(F.col("id").cast("string")), F.lit("-./_\\Ab")).alias("path"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = [r.path for r in sorted(queries._places(own).collect(), key=lambda r: r.place)]
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert got == sorted(got) and len(set(got)) == 60_000
    assert queries._places(own.where("false")).count() == 0
    assert [r.place for r in queries._places(own.limit(1)).collect()] == [1]


def test_tokens_by_arrays_equal_the_patterns(spark):
    from lexmill.operators import scan

    texts = ["don't É b\r\n\nhéllo x1_y", "", None, "1'a -́'b \\'c d\\'e 中文x ´á̀ '", "1e5 .5 -3.e+2 e5 a.b- _x 12'3", "𐐀b A’s\n\n\\’q" * 3]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for kind in ("words", "code", "possible"):
        columns = ["doc_id", "line", "offset", "column", "word"]
        want = sorted(map(tuple, tokens.tokens(docs, "doc_id", kind=kind).select(columns).collect()))
        assert sorted(map(tuple, scan.tokens(docs, "doc_id", kind=kind).select(columns).collect())) == want
    points = spark.createDataFrame([(" ".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000),)], "t string")
    java = {ord(c) for c in points.select(F.regexp_extract_all("t", F.lit(chars.JAVA_LETTER), F.lit(0)).alias("k")).first().k}
    ours = {i for i, k in enumerate(scan.classes()) if k & scan._LETTER}
    assert java - ours == set()


def test_issues_of_repeated_ids_and_without_windows(spark, tmp_path):
    import duckdb

    from lexmill import queries

    texts = [(1, "wrng wrng wrng Wrng\ngood wrng wrng", "a", "s"), (1, "xx\nyy\n\nzz good Good wrng wrngs it’s", "a", "t"), (2, "good it's GOOD", "b", "s"), (3, None, None, "s"), (4, "Élan élan " * 4, "a", "s")]
    c = duckdb.connect()
    for repeats in (True, False):
        own = tmp_path / str(repeats)
        docs = texts if repeats else [t for i, t in enumerate(texts) if i != 1]
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(own / "documents.parquet"))
        spark.createDataFrame([(1, "good its")], "item_id long, text string").coalesce(1).write.parquet(str(own / "benchmark.parquet"))
        spark.createDataFrame([(1, 0, 1), (4, 0, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(own / "labels.parquet"))
        for t in ("documents", "benchmark", "labels"):
            c.execute(f"CREATE OR REPLACE VIEW {t} AS FROM '{own}/{t}.parquet/*.parquet'")
        names = ["unknown_words", "issue_summary", "issue_totals", "issues_by_lang", "agreement", "forbidden_words", "group_by_word"]
        # which of two tokens at one place comes first, the twin leaves open
        for name in names if repeats else [*names, "dup_capped", "file_capped", "unique_first", "report_json", "report_text", "report_github"]:
            got = sorted(map(repr, map(tuple, queries.QUERIES[name](spark, str(own)).collect())))
            assert got == sorted(map(repr, c.execute(queries.SQL[name]).fetchall())), (name, repeats)
    for name in ("dup_capped", "file_capped", "report_text", "report_github"):
        plan = queries.QUERIES[name](spark, str(own))._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Join" not in plan, name


def test_words_outside_ranges_of_many_ranges(spark):
    from lexmill.operators import scan

    texts = ["<a>bé</a> c &amp; <é>d" * 200, "", None, "no tags É", "<x>", "a<b" * 3]
    docs = ranges.pattern_ranges(spark.createDataFrame(list(enumerate(texts)), "page_id long, text string").coalesce(1), {"tag": ([], "<[^>]*>"), "amp": ([], "&[a-z]+;")})
    found = tokens.matches(docs, "text", chars.JAVA_WORDS, "at", "word").where(~ranges.inside("ranges", "at"))
    want = sorted(map(tuple, found.groupBy("page_id", "word").agg(F.count("*").alias("n")).collect()))
    got = scan.words_outside(docs, "page_id")
    assert sorted(map(tuple, got.collect())) == want and ("Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString())


def test_words_are_looked_up_at_once_as_one_by_one(spark):
    """Only words that Arrow may fold otherwise than Python pass through Python."""
    import unicodedata

    import pyarrow as pa

    from lexmill.operators import scan

    asked = ["Plain", "plain", "ÉTÉ", "été", "Été", "İx", "ΣΑΣ", "don’t", "DON'T", "a\\'b", "Ǆ", "ſs", "straße", "Straẞe", "wrong", "ŉ", "Ａ"]
    held = [("d", "word", w, None) for w in ("plain", "été", "i̇x", "σας", "don't", "a'b", "ǆ", "straße", "ａ")] + [("d", "exact", "Plain", None), ("d", "non_strict", "ſs", None)]
    same, low = {k for _, kind, k, _ in held if kind != "non_strict"}, {k for _, kind, k, _ in held if kind != "exact"}
    forms = {w: {unicodedata.normalize("NFC", x) for x in (w, w.replace("’", "'"), w.replace("\\", ""))} for w in asked}
    want = [any(x in same or x.lower() in low for x in forms[w]) for w in asked]
    assert scan.Known(spark, held).mask(pa.array(asked)).tolist() == want and True in want and False in want
    small, plain = scan.lowered(pa.array(asked))
    assert small.to_pylist() == [w.lower() for w in asked] and 0 < plain.sum() < len(asked)


def test_blocks_equal_the_check_by_joins(spark, monkeypatch):
    """Skip ranges, code tokens, line states, directive typos and caps, beside a broadcast dictionary and a larger one."""
    from lexmill import queries
    from lexmill.plans import native

    planted = [t for t, _ in queries._PLANTED]
    dense = "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVphYmNkZWZn0aG"
    texts = [
        *planted, *(f"wrng {t}\n{u} wrng" for t, u in zip(planted, reversed(planted), strict=True)), *(f"{a}\nwrng Omega omega x_wrng delta\n{b}\n\nwrng alpha\nBeta" for a in queries._INJECT for b in queries._INJECT[::4]),
        "\n".join([dense] * 3) + " wrng", "\r\n".join([dense] * 3) + " wrng", "\r".join([dense] * 3) + "\rwrng", "# cspell:disable-next-line\r\n \r\nwrng wrngs\r\nwrng\r", "# cspell:disable-next-line\ncspell:disable-next\n\nwrng\nwrngs",
        "rock-'wrng 9'wrng wrng-9 _'wrng wrng wrng_9a x-wrng'wrngs 'wrng'", "gOod goodWrng GOODS GOOds goodWRNGs İwrng Éwrng ÉWRNG ǅwrng aaaa Aaaa éééé Ééé", "\\nwrng \\good \\'wrng wrng\\'s 中wrng文 wr̀ng wr̀̀ng", "cspell:enabel\nwrng", " ".join(f"wrng{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}" for k in range(60)), "httpſ://a wrng",
    ]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(9000, None), (9001, "")], "doc_id long, text string").repartition(2)
    entries = rows(spark, ["good", "alpha", "beta"]).unionByName(rows(spark, ["plain"], "forbidden")).unionByName(rows(spark, ["words"], "no_suggest")).unionByName(rows(spark, ["wrngs"], name="fr"))
    options = [Options("d"), Options("fr", active=False)]

    def checked(c, own=docs):
        return sorted(map(str, native.check_native(own, entries, options, c).collect()))

    configs = [Config(max_problems=20), Config(ignore_patterns=["^wrng[a-c]"], include_patterns=["wrng[^\n]*"], late_ignore_patterns=["omega"])]
    got = [checked(c) for c in configs]
    assert len(got[0]) > 200 and got[0] != got[1]
    plan = native.check_native(docs, entries, options, configs[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    monkeypatch.setattr(native, "BROADCAST_ROWS", 0)
    for a, c in zip(got, configs, strict=True):
        want = checked(c)
        assert sorted(set(a) - set(want)) == sorted(set(want) - set(a)) == [] and a == want


def _unlike(spark):
    """Documents in several blocks, with odd words, words that differ by case, and one without an id; and a dictionary."""
    from lexmill.operators import scan

    bits = ["wrng", "Wrng", "WRNG", "Ünder", "ünder", "İstan", "i̇stan", "ΑΣΑΣ", "ασας", "it’s", "it's", "good", "Kelvin", "Kelvin", "a\\'bcd", "\n"]
    docs = [(k if k != 7 else None, " ".join(bits[(k * 7 + i * (1 + k % 5)) % len(bits)] for i in range(k % 60)) if k % 11 else None) for k in range(200)]
    known = scan.Known(spark, [("d", "word", "good", None)])
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(7), known


def _same(a, b):
    return sorted(map(repr, map(tuple, a.collect()))) == sorted(map(repr, map(tuple, b.collect())))


def _rows(docs, known):
    from lexmill.operators import scan

    return scan.issues(docs, known, 5, "doc_id").withColumns({"path": F.col("doc_id").cast("string"), "suggestions": F.array().cast("array<string>"), "is_forbidden": F.lit(False)})


def test_issues_are_capped_in_their_document(spark):
    from lexmill.operators import reports, scan

    docs, known = _unlike(spark)
    docs = docs.where("doc_id IS NOT NULL")
    few = reports.capped_by_file(_rows(docs, known), 20).drop("path", "suggestions", "is_forbidden", "place")
    assert _same(scan.issues(docs, known, 5, "doc_id", few=20).drop("place"), few)


def test_issues_counted_by_blocks_equal_those_that_meet(spark):
    from lexmill.operators import reports, scan

    docs, known = _unlike(spark)
    rows, columns = _rows(docs, known), ["path", "line", "column", "word"]
    assert _same(reports.occurrences_of(scan.first_issues(docs, known, 5, "doc_id", folded=True)), reports.occurrences(rows))
    assert _same(reports.first_of_each(scan.first_issues(docs, known, 5, "doc_id", folded=False).select(columns)), reports.first_of_each(rows.select(columns)))


def test_counts_of_issues_by_blocks_equal_their_summary(spark):
    from lexmill.operators import reports, scan

    docs, known = _unlike(spark)
    assert _same(scan.issue_counts(docs, known, 5, "doc_id").agg(F.sum("files"), F.sum("n")), reports.summary(_rows(docs, known)))


def test_lists_of_issues_equal_those_that_meet(spark):
    from lexmill.operators import reports, scan

    docs, known = _unlike(spark)
    docs = docs.where("doc_id IS NOT NULL")
    listed = reports.json_lines(scan.issue_lists(docs, known, 5, "doc_id"))
    assert _same(listed, reports.json_files(_rows(docs, known)))
    assert "Aggregate" not in listed._jdf.queryExecution().optimizedPlan().toString()


def test_files_of_a_diff_are_chosen_before_their_texts_are_taken_apart(spark, tmp_path):
    from lexmill import queries

    spark.createDataFrame([(k, f"wrng {k}\nwrngs good wrng") for k in range(50)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "good its")], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    plan = lambda name: queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    filtered = plan("diff_filter")
    assert filtered.count("LeftSemi") == 2 and filtered.index("LeftSemi") < filtered.index("MapInArrow") < filtered.rindex("LeftSemi")
    got = queries.diff_filter(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("0", 2, "wrng", 12), ("0", 2, "wrngs", 1), ("1", 1, "wrng", 1), ("1", 2, "wrng", 12), ("1", 2, "wrngs", 1)]


def test_words_counted_by_blocks_equal_those_that_meet(spark):
    from lexmill.operators import scan

    docs, _ = _unlike(spark)
    blocks = scan.words_counted(docs, "doc_id").groupBy("word").agg(F.sum("n"), F.sum("texts"))
    assert {tuple(r) for r in blocks.collect()} == {tuple(r) for r in scan.words(docs, "doc_id").groupBy("word").agg(F.sum("n"), F.count("doc_id")).collect()}
    assert scan.words_counted(docs, "doc_id").count() < scan.words(docs, "doc_id").count() / 5
