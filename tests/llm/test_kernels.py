"""Kernels of the operators against brute force; no session needed."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexmill.llm import bytesops as B
from lexmill.llm import decontam, pieces, quality, toxicity, urls, warc


def test_words_and_hashes():
    texts = ["Ab c", "", None, "é x", "end", "joined"]
    data, at = B.buffer(pa.array(texts, pa.string()))
    s, e, row = B.words(data, at, B.WORD)
    got = [(int(r), bytes(data[a:b]).decode()) for a, b, r in zip(s, e, row, strict=True)]
    assert got == [(k, w) for k, t in enumerate(texts) for w in (t or "").split()]
    h = B.hashes(data, s, e, (1,))
    again = B.hashes(np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([2]))[0]
    assert h[0][0] == again[0] and len(set(h[0].tolist())) == len(got)


def brute_leaks(text, items, window=8):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    d, hit, ids = words(text), set(), set()
    for i, t in items:
        w = words(t)
        n = min(len(w), window)
        for k in range(len(w) - n + 1 if n else 0):
            for p in range(len(d) - n + 1):
                if d[p : p + n] == w[k : k + n]:
                    hit |= set(range(p, p + n))
                    ids.add(str(i))
    return len(d), len(hit), sorted(ids)


def test_automaton_matches_brute_force():
    r = random.Random(4)
    vocab = ["a", "b", "c", "é", "x1"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 5, 7, 8, 12, 30])))) for i in range(1, 12) if i != 3]
    items = [x for x in items if len(x[1].split()) != 1] + [(50, "Zz"), (51, None), (None, "a b c a b c a b")]
    docs = [" ".join(r.choice([*vocab, "q"]) for _ in range(r.choice([0, 3, 60, 300]))) for _ in range(30)]
    docs += [items[2][1] + " " + (items[4][1] or ""), "zz, ZZ", None, ""]
    auto = decontam.Automaton(items)
    known = [(i, t) for i, t in items if i is not None]
    for got, d in zip(auto.scan(pa.array(docs, pa.string())), docs, strict=True):
        assert got[:3] == brute_leaks(d, known)


def test_url_patterns():
    p = urls.Pattern("||ads.example^")
    assert p.tokens() == ["ads", "example"] and re.search(p.regex(), "http://x.ads.example/a") and not re.search(p.regex(), "http://xads.example/")
    assert urls.Pattern("*.exe|").tokens() == ["exe"]
    assert set(urls.index([p], {"ads": 9, "example": 2})) == {"example"}


def test_noisy_channel():
    words = ("stupid idiot moron the and of thing inside students " * 50).split()
    data, at = B.buffer(pa.array([" ".join(words)]))
    lm = toxicity.LanguageModel(toxicity.triples(data, at))
    assert toxicity.viterbi("1d1ot", lm) == "idiot"
    assert toxicity.viterbi("$tup1d", lm) == "stupid"
    assert toxicity.viterbi("mooorrron", lm) == "moron"
    assert "stupid" in toxicity.restore("s t u p i d", lm)
    d, a = B.buffer(pa.array(["plain words here", "an 1d1ot", "s t u p i d x"]))
    assert [r for r, _ in toxicity.suspicious(d, a)] == [1, 2]


def restored_words(texts, lm):
    """The restored words of each text."""
    out = [set() for _ in texts]
    for g, starts, ends, rows in toxicity._restorer(lm)(*B.buffer(pa.array(texts, pa.string()))):
        for a, b, r in zip(starts, ends, rows, strict=True):
            out[r].add(bytes(g[a:b]).decode().lower())
    return out


def every_reading(text, lm):
    """The least cost of all readings of a lattice, and the readings of that cost."""
    best = {}
    for path in itertools.product(*toxicity.options(text)):
        word = "".join(p[0] for p in path)
        c = [toxicity.EDGE, toxicity.EDGE, *(toxicity._class(x) for x in word), toxicity.EDGE]
        total = sum(p[1] for p in path) + sum(lm.table[c[k : k + 3][0], c[k + 1], c[k + 2]] for k in range(len(c) - 2))
        best[word] = min(total, best.get(word, np.inf))
    least = min(best.values())
    return {w for w, c in best.items() if c <= least + 1e-9}


def random_texts(alphabet, n, longest, seed):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(longest))) for _ in range(n)]


def test_viterbi_takes_the_cheapest_of_all_readings():
    lm = toxicity.LanguageModel(toxicity.triples(*B.buffer(pa.array(["stupid idiot moron the and of thing inside students " * 50]))))
    for t in [*random_texts(["a", "t", "s", "i", "1", "$", "*", " ", "oo", "ddd", ".", "é"], 300, 7, 3), "1d10t", "s t u p", "m0 r0n"]:
        assert toxicity.viterbi(t, lm) in every_reading(t, lm), t


@pytest.mark.parametrize("alphabet", [["a", "b", "c", "o", "e", "é", "É", "ß", "ñ", ".", "-", "1", "$", " ", " ", "  ", "oo", "ll", "lll", "日", "ж", "Ж", "€", "£", ",", '"', "\n", "İ", "*"], ["a", "o", "e", "n", "t", "s", "i", " ", " ", "oo", "ll", "é", "."]])
def test_independent_choices_are_the_lattice_paths(alphabet):
    lm = toxicity.LanguageModel(toxicity.triples(*B.buffer(pa.array(["stupid tea stone llama noon the eat soon on it is in " * 50]))))
    texts = [*random_texts(alphabet, 600, 60, 5), "", None, "a", "aa"]
    own = [set(w.lower() for w in re.findall(r"[A-Za-z\x80-\U0010ffff]+", t or "")) for t in texts]
    want = [set() for _ in texts]
    spans = toxicity.suspicious(*B.buffer(pa.array(texts, pa.string())), lm)
    for r, t in spans:
        want[r].update(toxicity.restore(t, lm))
    assert spans
    for got, w, o in zip(restored_words(texts, lm), want, own, strict=True):
        assert got - o == w - o


def test_noisy_channel_of_doubled_split_and_spaced_words():
    words = ("stupid idiot moron trass the and of thing inside students " * 50).split()
    lm = toxicity.LanguageModel(toxicity.triples(*B.buffer(pa.array([" ".join(words)]))))

    def restored(text):
        return restored_words(["the thing", text], lm)[1]

    for text, want in (("iddiot", "idiot"), ("mmoron", "moron"), ("sttupid", "stupid"), ("tra$$", "trass"), ("th€", "the"), ("the id iot", "idiot"), ("mo ron and", "moron"), ("moro n", "moron"), ("stu pid thing", "stupid"), ("t h e", "the"), ("o f", "of"), ("stuuupid", "stupid")):
        assert want in restored(text), text
    assert {"stupid", "idiot", "the"} <= restored("s t u p i d i d i o t t h e")
    assert restored("ÉéÉ")
    assert restored("the idiot of students inside") == set()


def test_statistics_of_odd_texts():
    x = quality._of_column(pa.array(["", None, "A", "word " * 50_000, "é\n\n!!"], pa.string()))
    assert x.shape == (5, len(quality.NAMES)) and np.isfinite(x).all() and (x[0] == x[1]).all()


def test_discriminant_separates():
    r = np.random.default_rng(0)
    a, b = r.normal(0, 1, (300, 3)), r.normal(3, 2, (300, 3))
    m = quality.solve(np.array([300.0, 300.0]), np.array([a.sum(0), b.sum(0)]), np.array([a.T @ a, b.T @ b]))
    assert (m.score(a) < 0.5).mean() > 0.9 and (m.score(b) > 0.5).mean() > 0.9


def model():
    public = pytest.importorskip("public_tokenizers")
    return pieces.model(public.path("piece_bpe_32k.model"))


def mapped_model():
    """The public model with the library's own compiled character map before it."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    public = pytest.importorskip("public_tokenizers")
    proto = pb.ModelProto()
    with open(public.path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec())
    proto.normalizer_spec.add_dummy_prefix = proto.normalizer_spec.remove_extra_whitespaces = proto.normalizer_spec.escape_whitespaces = True
    assert proto.normalizer_spec.precompiled_charsmap
    return pieces.Model(proto.SerializeToString())


TEXTS = ["Hello world", "", "  two  spaces ", "é ñ ▁ x\ty\n", "日本", "日本語" * 30, "a" * 300, " ".join(["word"] * 50), "word\n" * 20 + " ", "x" * 40 + "  ", "word▁ word " * 9, "word▁word" * 9 + "▁", "▁ " * 20, "a" * 15 + "▁ b" + "c" * 30, "😀é" * 20]


@pytest.mark.parametrize("part", [16, 1 << 17])
def test_pieces_match_the_library(monkeypatch, part):
    m = model()
    monkeypatch.setattr(pieces, "PART", part)
    want = m.library.encode(TEXTS, add_eos=True)
    for t, ids, (own, at) in zip(TEXTS, want, m.encode(TEXTS), strict=True):
        assert own.tolist() == ids
        assert at[0] == 0 and at[-1] == len(t.encode()) and (np.diff(at) >= 0).all() and len(at) == len(ids) + 1


@pytest.mark.parametrize("part", [16, 1 << 17])
def test_pieces_and_offsets_of_a_model_with_a_character_map(monkeypatch, part):
    m = mapped_model()
    monkeypatch.setattr(pieces, "PART", part)
    texts = [*TEXTS, "ﬁne  ①② ", "Ａｂｃ　ｄ", "ｶﾞ ½ ㌔", " \t ", "e\u0301 ﷺ x"]
    for t, (own, at) in zip(texts, m.encode(texts), strict=True):
        proto = m.library.encode(t, return_type="proto")
        assert own.tolist() == [*(p.id for p in proto.pieces), m.library.eos_id()], t
        # where the library gives a piece its whole source, ours begins at the same byte
        for p, a in zip(proto.pieces, at.tolist(), strict=False):
            if p.end > p.begin:
                assert a == p.begin, (t, p)


def test_pieces_of_a_model_with_unknown_pieces():
    from sentencepiece import sentencepiece_model_pb2 as pb

    public = pytest.importorskip("public_tokenizers")
    proto = pb.ModelProto()
    with open(public.path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.byte_fallback = False
    for p in proto.pieces:
        p.type = 1 if p.type == 6 else p.type
    m = pieces.Model(proto.SerializeToString())
    for t, (own, at) in zip(TEXTS, m.encode(TEXTS), strict=True):
        assert own.tolist() == m.library.encode(t, add_eos=True) and at[-1] == len(t.encode())


def test_longest_prefix_normaliser_matches_the_library():
    import sentencepiece

    try:
        n = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
        blob = n.serialized_model_proto()
    except Exception:
        pytest.skip("this build has no built-in rules")
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(blob)
    own = pieces.Normaliser(proto.normalizer_spec)
    for t in ["ﬁne ①②", "Ａｂｃ　ｄ", "é x", "plain"]:
        got, at = own(t.encode())
        assert got.decode() == n.normalize(t) and len(at) == len(got) + 1


def test_monolithic_archives_become_members():
    records = [warc.page_record(k, f"http://x/{k}\n", bytes([65 + k]) * (k * 70_000), None, "") for k in range(4)]
    whole = zlib.compressobj(6, zlib.DEFLATED, 31)
    content = whole.compress(b"".join(records)) + whole.flush()
    data, index = warc.normalise(content)
    assert [x["record_id"] for x in index] == [f"urn:page:{k}" for k in range(4)]
    for x, r in zip(index, records, strict=True):
        assert zlib.decompress(data[x["offset"] : x["offset"] + x["length"]], 31) == r
    assert warc.normalise(data)[0] == data
    with pytest.raises(ValueError):
        warc.normalise(content[:-20])
