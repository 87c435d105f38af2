"""Hand cases and brute force for the training-data operators, on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reelgrid.llm import brown, chat, decontaminate, language, lines, pair_bpe, simhash, syncmers, wavelet, wordpiece
from reelgrid.llm.queries import TRICKY, tokenizer
from reelgrid.spreading import stored

PASSAGE = " ".join(f"word{i}" for i in range(60))
#: Columns whose names clash with what the operators use inside.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, fp string, bucket int, c int"


def _row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), 1, "x", 2, None)


ODD = [
    "",
    None,
    "   \n\n  ",
    "one",
    "It's naïve, I'LL <|endoftext|> go\tx  y\n\n z 12½ _a_ 'S",
    "日本語 のテキスト Σίσυφος İ é ",
    "a" * 5000,
    "ab " * 4000,
    "aaaa aaa aa a\r\n\x1cb\x85c\xa0d",
    "The the THE of of",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [_row(i, t) for i, t in enumerate(ODD)]
    rows += [_row(3, "one"), _row(None, "no id"), _row(None, None, None, None), _row(40, "the of and", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return lambda name: Tokenizer.from_file(tokenizer(name))


def _texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# --- 1


def test_wavelet_matrix_answers():
    a = np.random.default_rng(0).integers(0, 300, 3000).astype(np.uint16)
    m = wavelet.WaveletMatrix.build(a)
    assert (m.decode() == a).all()
    assert [m.access(i) for i in range(0, 3000, 7)] == a[::7].tolist()
    for value in (0, 5, 299, 70_000):
        at = np.flatnonzero(a == value).tolist()
        assert m.rank(value, 2000) == sum(i < 2000 for i in at)
        assert [m.select(value, j) for j in range(len(at))] == at and m.select(value, len(at)) == -1
    empty = wavelet.WaveletMatrix.build(a[:0])
    assert empty.decode().tolist() == [] and empty.rank(3, 0) == 0


@pytest.mark.parametrize("shards", [1, 4])
def test_wavelet_files(spark, odd, library, tmp_path, monkeypatch, shards):
    monkeypatch.setattr(wavelet, "BLOCK", 500)
    path = str(tmp_path / "shards")
    ids = wavelet.encode_documents(odd, tokenizer("word_bpe_49k.json"), 2)
    wavelet.write_shards(ids, odd.select("doc_id"), path, shards=shards)
    blocks = wavelet.read_shards(spark, path)
    got = sorted(wavelet.document_digests(blocks).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in got], key=lambda i: -1 if i is None else i)
    coder = library("word_bpe_49k.json")
    expected = Counter()
    for i, text in _texts(odd):
        own = [*coder.encode(text, add_special_tokens=False).ids, 2]
        expected[i, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ends = sorted(r.position for r in wavelet.occurrences(blocks, 2).collect())
    assert ends == [r.start + r.n_tokens - 1 for r in got]


def test_wavelet_of_nothing(spark, none, tmp_path):
    path = str(tmp_path / "empty")
    wavelet.write_shards(wavelet.encode_documents(none, tokenizer("word_bpe_49k.json"), 2), none.select("doc_id"), path)
    assert wavelet.document_digests(wavelet.read_shards(spark, path)).count() == 0


# --- 2


def _random_texts(n):
    rng = random.Random(3)
    signs = "abcdeXYZ éÀß'sdtrlm_-.,  \t\n0123½²ªºµſĳΣ<|>endoftext日本\x1c\x85İ́"
    return ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoders_equal_the_library(library, name):
    coder, cases = library(name), [t or "" for t in ODD] + _random_texts(4000)
    expected = [coder.encode(t, add_special_tokens=False).ids for t in cases]
    if name == "byte_bpe_50k.json":
        own = pair_bpe._coder(tokenizer(name))
        got = own.encode_all(cases)
        assert [np.frombuffer(i, "<u4").tolist() for i in got] == expected
        assert [own.decode(i) for i in got] == [coder.decode(i, skip_special_tokens=False) for i in expected]
    else:
        own = wavelet._coder(tokenizer(name))
        assert own.short
        assert [np.frombuffer(own.encode(t), own.kind).tolist() for t in cases] == expected


def test_known_words_are_not_cut_again(library, monkeypatch):
    monkeypatch.setattr(wavelet, "_WORDS", 20)
    monkeypatch.setattr(wavelet, "_CUT", 5)
    own, coder = wavelet._PieceCache(tokenizer("word_bpe_49k.json")), library("word_bpe_49k.json")
    for batch in (_random_texts(50), ["again the the of", "x" * 100], _random_texts(80)):
        assert [np.frombuffer(own.encode(t), own.kind).tolist() for t in batch] == [
            coder.encode(t, add_special_tokens=False).ids for t in batch
        ]
    assert max(len(c) for c in (own.words, own.words.older, own.cut, own.cut.older)) <= 20
    found, own.pieces = own.encode("It's a naïve, naïve text."), None
    assert own.encode("a naïve,\tnaïve IT'S text.") and own.encode("It's\na naïve, naïve  text.") == found


def test_words_of_a_batch_are_looked_up_once(library):
    own, coder = wavelet._PieceCache(tokenizer("word_bpe_49k.json")), library("word_bpe_49k.json")
    letters = [f"{chr(c)}a b{chr(c)} {chr(c)}" for c in range(1, 0x250)]
    cases, made = [t or "" for t in ODD] + letters + _random_texts(500) + [" ", "", " the of\tthe the ", "x" * 100], []
    make = own.words.make
    own.words.make = lambda words: made.extend(words.to_pylist()) or make(words)
    expected = [[*coder.encode(t, add_special_tokens=False).ids, 2] for t in cases]
    for _ in range(2):
        got = own.encode_all(pa.array(cases * 2), np.array([2], own.kind).tobytes()).to_pylist()
        assert [np.frombuffer(i, own.kind).tolist() for i in got] == expected * 2
    assert max(c for w, c in Counter(made).items() if len(w) <= 64) == 1 and made.count("x" * 100) == 2


def test_pair_index_forgets_and_learns_again(library, monkeypatch):
    monkeypatch.setattr(pair_bpe, "_CACHE", 20)
    own, coder = pair_bpe.PairBpe(tokenizer("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    for batch in (_random_texts(50), ["again the the of"], _random_texts(80)):
        assert [np.frombuffer(i, "<u4").tolist() for i in own.encode_all(batch)] == [coder.encode(t).ids for t in batch]


def test_bpe_round_trip(odd, none):
    path = tokenizer("byte_bpe_50k.json")
    got = Counter((r.doc_id, r.decoded_sha256) for r in pair_bpe.round_trip(odd, path).collect())
    assert got == Counter((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in _texts(odd))
    back = pair_bpe.decode(pair_bpe.encode(odd, path), path)
    assert Counter(_texts(back)) == Counter(_texts(odd))
    assert pair_bpe.round_trip(none, path).count() == 0


# --- 3


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs.where("doc_id % 2 = 0"))
    items = language.document_items(docs.where("doc_id % 2 = 1"))
    got = language.identify(items, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.language == r.lang for r in got) >= 0.99 * len(got)
    assert all(r.accepted for r in got)


def test_language_evidence_is_fused(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(docs)
    rows = [(i, "", "fr", None, "fr", "a.fr") for i in range(3)]
    rows += [(3, "en", "de-AT", "de", "org", "x.org"), (4, "th", None, None, None, None), (5, None, None, None, None, None)]
    items = spark.createDataFrame(rows, "id int, text string, declared string, named string, suffix string, host string")
    got = {r.id: r for r in language.identify(items, model).collect()}
    assert all(got[i].language is None and not got[i].accepted and got[i].probability == 0 for i in (0, 1, 2, 5))
    assert got[3].language == "de" and got[4].language == "en"
    assert language.identify(items.limit(0), model).count() == 0
    # A host whose pages are French pulls a page that says little; an unknown host does not.
    french = [(i, t, None, None, "org", "f.org") for i, t in enumerate(["treleai pourenêaire leeux éelle çque réaire"] * 40)]
    weak = [(100, "en", None, None, "org", "f.org"), (101, "en", None, None, "net", "g.net")]
    items = spark.createDataFrame(french + weak, items.schema)
    got = {r.id: r for r in language.identify(items, model).collect()}
    assert got[100].probability > 0 and got[100].language == "fr" and got[101].text_language == got[100].text_language


def test_other_languages_and_random_letters_are_refused(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(3)
    other = [
        "这是一个关于语言识别的测试文本，它不应该被接受为任何已知语言。",
        "Это текст на русском языке, который не должен быть принят.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
        " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(40)),
        " ".join(f"{rng.getrandbits(32):08x}" for _ in range(60)),
    ]
    rows = [_row(-1 - i, t, None) for i, t in enumerate(other)]
    both = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang", "source"))
    kept = {r.doc_id for r in language.keep_identified(both).collect()}
    assert not {i for i in kept if i < 0} and len(kept) == docs.count()
    judged = language.identify(language.document_items(both), language.train(both)).where("doc_id < 0").collect()
    assert all(r.language is None and not r.accepted and r.probability < 0.5 for r in judged)


def test_language_stage(odd, none):
    kept = language.keep_identified(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} >= {3, 4, 9}
    assert not {r.doc_id for r in kept.collect()} & {0, 1, 2}
    assert language.keep_identified(none).count() == 0


def test_pages(spark):
    html = '<html LANG=fr><script>var t="</p>";</script><p>le <b>un</b></p><!-- no --></html>'
    pages = spark.createDataFrame(
        [(1, "http://a.b.fr/de/x", html), (2, "not a url", None), (3, None, "plain")], "page_id int, url string, html string"
    )
    got = {r.page_id: r for r in language.page_items(pages).collect()}
    assert (got[1].declared, got[1].named, got[1].suffix, got[1].host) == ("fr", "de", "fr", "a.b.fr")
    assert got[1].text.split() == ["le", "un"] and got[2].text == "" and got[3].text == "plain"


# --- 4


def _brute_hits(text, items, window):
    found = decontaminate.words(text)
    hit, names = set(), set()
    for name, item in items:
        own = decontaminate.words(item or "")
        k = min(window, len(own))
        for part in {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if k else ():
            for i in range(len(found) - k + 1):
                if tuple(found[i : i + k]) == part:
                    hit |= set(range(i, i + k))
                    names.add(str(name))
    return len(found), hit, sorted(names)


@pytest.mark.parametrize("block_words", [200_000, 12])
def test_decontamination_equals_brute_force(spark, block_words):
    rng = random.Random(5)
    word = lambda: rng.choice("abc")
    items = [(i, " ".join(word() for _ in range(rng.randint(0, 7)))) for i in range(12)] + [(12, None), (3, "A, b! c")]
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(60, None), (60, "x"), (5, "x a b c")]
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    table = spark.createDataFrame(docs, "doc_id int, text string")
    got = decontaminate.hits(table, benchmark, window=4, block_words=block_words).collect()
    seen = Counter((r.doc_id, r.n_words, tuple(i for s in r.spans for i in range(s.start, s.end)), tuple(r["items"])) for r in got)
    expected = Counter()
    for i, text in docs:
        n, hit, names = _brute_hits(text or "", items, 4)
        expected[i, n, tuple(sorted(hit)), tuple(names)] += 1
    assert seen == expected
    kept = decontaminate.decontaminate(table, benchmark, window=4, block_words=block_words).collect()
    assert Counter(r.doc_id for r in kept) == Counter(
        i for i, t in docs if not ((b := _brute_hits(t or "", items, 4))[1] and 20 * len(b[1]) >= b[0])
    )


def test_spans_are_cut(spark):
    long = " ".join(f"own{i}" for i in range(3000))
    table = spark.createDataFrame([_row(1, f"{long}! ({PASSAGE}) end"), _row(2, PASSAGE), _row(3, None)], SCHEMA)
    benchmark = spark.createDataFrame([(1, PASSAGE.upper())], "item_id int, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(table, benchmark, cut=True).collect()}
    assert set(got) == {1, 3} and got[1].text == f"{long}! () end" and got[1].n_chars == len(got[1].text)
    whole = decontaminate.decontaminate(table, benchmark).where("doc_id = 1").first()
    assert PASSAGE in whole.text
    assert decontaminate.hits(table, benchmark.limit(0)).where(F.size("items") > 0).count() == 0
    assert decontaminate.decontaminate(table.limit(0), benchmark).count() == 0


# --- 5


def _shingle_sets(texts, size):
    words = [t.encode().lower().split() for t in texts]
    return [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set() for w in words]


def _brute_groups(rows, prints, radius, sets=None, share=(80, 100)):
    """Smallest id reachable over close fingerprints and, where sets are given, over alike sets."""
    near = lambda a, b: sets and 0 < share[0] * len(sets[a] | sets[b]) <= share[1] * len(sets[a] & sets[b])
    best = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                if best[b] is not None and (best[a] is None or best[b] < best[a]):
                    if (prints[a] ^ prints[b]).bit_count() <= radius or near(a, b):
                        best[a], changed = best[b], True
    return best


@pytest.mark.parametrize("shard", [4000, 8])
def test_groups_equal_brute_force(spark, odd, shard):
    rng = random.Random(1)
    base = [rng.choice("abcdefgh") * 2 + str(rng.randint(0, 9)) for _ in range(80)]
    texts = [" ".join(base[:k] + [f"new{k}"] * (k % 3) + base[k:]) for k in range(60)]
    table = odd.unionByName(spark.createDataFrame([_row(100 + i, t) for i, t in enumerate(texts)], SCHEMA))
    rows = _texts(table)
    prints = [simhash.fingerprint(t) for _, t in rows]
    got = simhash.near_duplicates(table, shard=shard).collect()
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == Counter(
        zip((i for i, _ in rows), prints, _brute_groups(rows, prints, 2), strict=True)
    )


def test_shards_meet_every_pair():
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 30, 3), dtype=np.uint64)
    points = np.unique(np.concatenate((seeds, np.bitwise_xor.reduce(flips, axis=2).ravel() ^ np.repeat(seeds, 30))))
    nodes = simhash.build_tree(points[::7], 16)
    leaf, who, guest = simhash.route(points, nodes, 2)
    assert sorted(who[~guest].tolist()) == list(range(len(points)))
    met = set()
    for x in np.unique(leaf):
        here, visitor = who[leaf == x], guest[leaf == x]
        for a in here[~visitor].tolist():
            met |= {(min(a, b), max(a, b)) for b in here.tolist() if a != b}
    near = {(a, b) for a in range(len(points)) for b in range(a) if int(points[a] ^ points[b]).bit_count() <= 2}
    assert {(b, a) for a, b in near} <= met
    groups = simhash.group_shard(points, np.zeros(len(points), bool), 2)
    assert all(groups[a] == groups[b] for a, b in near)


def test_chains_of_links(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.rep for r in simhash.components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_keep_one(spark, none):
    table = spark.createDataFrame(
        [_row(5, PASSAGE), _row(2, PASSAGE), _row(2, PASSAGE), _row(9, "other text here"), _row(None, PASSAGE), _row(7, None), _row(8, "")], SCHEMA
    )
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 7, 9, None]
    assert simhash.keep_one(none).count() == 0
    rows = [_row(1, PASSAGE), _row(2, PASSAGE), _row(2, "another text of its own"), _row(5, PASSAGE + " x"), _row(5, "b c d e f")]
    left = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.text[:7]) for r in left if r.text != PASSAGE + " x") == [(1, "word0 w"), (2, "another"), (5, "b c d e")]


def test_keep_one_by_two_rules(spark, odd, none):
    """A chain over both rules is one group; ids that share a text, repeats, nulls and extra columns as before."""
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 10_000)}" for _ in range(120)]
    texts = []
    for k in range(6):
        base[20 * k + 7] = f"changed{k}"
        texts += [" ".join(base), " ".join(base).upper()]
    rows = [_row(40 - i, t) for i, t in enumerate(texts)] + [_row(40, "its own"), _row(40, texts[0]), _row(None, texts[0])]
    table = odd.unionByName(spark.createDataFrame(rows, SCHEMA))
    kept = corpus_pipeline.dedup_near(spark, table, "")
    assert kept.columns == table.columns
    listed = sorted({(i, t) for i, t in _texts(table) if i is not None})
    groups = _brute_groups([(n, t) for n, (_, t) in enumerate(listed)], [simhash.fingerprint(t) for _, t in listed], 2, _shingle_sets([t for _, t in listed], 5))
    got = Counter(r.doc_id for r in kept.where("doc_id is not null").collect())
    assert got == Counter(listed[g][0] for g in set(groups))
    assert kept.where("doc_id is null").count() == table.where("doc_id is null").count()
    assert corpus_pipeline.dedup_near(spark, none, "").count() == 0


def test_columns_named_like_those_used_inside(spark):
    names = ("__id", "__version", "__gone", "__units", "__text", "__kept", "__rank", "__deleted", "id", "mark", "told", "of", "own", "deleted", "left", "spans", "items")
    schema = SCHEMA.replace(", row int", "") + "".join(f", {n} int" for n in names)
    made = [(*_row(i, t)[:5], "x", 2, None, *range(50, 50 + len(names))) for i, t in ((1, PASSAGE), (2, PASSAGE + "\nown words here"), (3, "the and of it is"))]
    table = spark.createDataFrame(made, schema)
    bench = spark.createDataFrame([(f"i{n}", " ".join(f"other{n}x{j}" for j in range(14))) for n in range(5)], "item_id string, text string")
    for stage in (
        lines.dedup_lines, lambda d: lines.dedup_lines(d, drop_emptied=True), simhash.keep_one, language.keep_identified,
        lambda d: decontaminate.decontaminate(d, bench, cut=True), lambda d: decontaminate.decontaminate(d, bench, cut=True, block_words=20),
    ):
        out = stage(table)
        assert out.columns == table.columns
        kept = out.collect()
        assert kept and all(tuple(r[n] for n in names) == tuple(range(50, 50 + len(names))) for r in kept)


def test_each_block_is_sent_and_built_once_per_pass(spark, monkeypatch):
    bench = spark.createDataFrame([(f"i{n}", " ".join(f"w{n}x{j}" for j in range(14))) for n in range(20)], "item_id string, text string")
    docs = spark.createDataFrame([_row(i, f"start w{i}x0 " + " ".join(f"w{i}x{j}" for j in range(14)) + " tail" * i) for i in range(20)], SCHEMA)
    blocks, make = decontaminate._automata(bench, 13, 40)
    assert blocks >= 5
    made = []
    monkeypatch.setattr(decontaminate, "_automata", lambda *a: (blocks, lambda b: made.append(b) or make(b)))
    few = decontaminate.decontaminate(docs, bench, share=2, cut=True, block_words=40).collect()
    assert made == list(range(blocks))
    monkeypatch.undo()
    assert sorted(map(tuple, few), key=repr) == sorted(map(tuple, decontaminate.decontaminate(docs, bench, share=2, cut=True).collect()), key=repr)
    assert 0 < len(few) < 20


# --- 6


def test_chat_round_trip(spark):
    texts = [TRICKY, "", None, "### x: </turn>\n### y: ", "\\b\\h\\e", "#### </turn", "a\n</turn>\n### user: b", "####### "]
    rows = [(1, i, ("user", "assistant")[i % 2], t, "z") for i, t in enumerate(texts)]
    rows += [(2, 0, "assistant", "x", "z"), (2, 0, "assistant", "x", "z"), (2, None, None, "y", "z"), (None, 1, "user", "u", "z"), (3, 0, "odd: ### r", "t", "z")]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, state string")
    formatted = chat.format_turns(turns)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    said = [(("user", "assistant")[i % 2], t or "") for i, t in enumerate(texts)]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
    learned = "".join(t for r, t in said if r == "assistant")
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert [got[i].valid for i in (1, 2, None, 3)] == [True, False, True, False]
    assert [got[i].n_turns for i in (1, 2, None, 3)] == [8, 3, 1, 1]
    parts = formatted.where("conv_id = 1").orderBy("n").collect()
    written = "".join(s.text for r in parts for s in r.segments)
    assert chat.Reader(chat.Template()).conversation(written) == said and len(written) == got[1].formatted_chars
    assert [s.loss for s in parts[1].segments] == [False, True, False, False]
    odd = formatted.where("conv_id = 3").first()
    assert chat.Reader(chat.Template()).turn("".join(s.text for s in odd.segments)) == ("odd: ### r", "t")
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


# --- 7


def _brute_lines(rows, run, min_words):
    units, seen = {}, {}
    for i, text in rows:
        units[i] = [(p, line.strip(" ")) for p, line in enumerate(text.split("\n")) if line.strip(" ")]
    gone = {i: set() for i in units}
    windows = []
    for i in sorted(units):
        own = units[i]
        for s in range(len(own)):
            for e in range(s + 1, len(own) + 1):
                content = tuple(t for _, t in own[s:e])
                if e - s >= run or sum(len(t.split(" ")) for t in content) >= min_words:
                    windows.append((content, i, s, e))
                    seen[content] = min(seen.get(content, (i, s)), (i, s))
    for content, i, s, e in windows:
        if (i, s) > seen[content]:
            gone[i] |= {p for p, _ in units[i][s:e]}
    return {i: sorted(g) for i, g in gone.items() if g}


def test_repeated_runs_equal_brute_force(spark):
    rng = random.Random(9)
    short = [f"l{i} x" for i in range(5)] + ["w " * 7 + "w", "v v v v v v"]
    rows = [(i, "\n".join(rng.choice([*short, "", f"own{i}{rng.random()}"]) for _ in range(rng.randint(0, 14)))) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r.deleted for r in lines.repeated(table, run=3, min_words=8).collect()}
    assert got == _brute_lines(rows, 3, 8)


def test_lines_of_awkward_rows(spark, none):
    table = spark.createDataFrame(
        [
            _row(1, f"top\n{PASSAGE}\nlast"), _row(2, f"  {PASSAGE}  "), _row(3, f"\nmine\n\n{PASSAGE}\nend"), _row(4, None),
            _row(4, ""), _row(None, PASSAGE), _row(5, "mine\nshort"), _row(1, f"top\n{PASSAGE}\nlast"), _row(6, "a b\n" * 5000),
        ],
        SCHEMA,
    )
    cut = lines.dedup_lines(table, counts=True)
    assert cut.columns == [*table.columns, "__deleted"]
    got = sorted(((r.doc_id, r.text, r.n_chars, r["__deleted"]) for r in cut.collect()), key=repr)
    assert (2, "", 0, 1) in got and (3, "\nmine\n\nend", 10, 1) in got and (4, None, None, 0) in got
    assert (None, PASSAGE, len(PASSAGE), 0) in got and (5, "mine\nshort", 10, 0) in got
    assert sum(r[:2] == (1, f"top\n{PASSAGE}\nlast") for r in got) == 2  # equal rows are answered alike
    assert next(r for r in got if r[0] == 6)[3] == 4999
    assert lines.dedup_lines(none).count() == 0


def test_lines_run_without_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = lines.dedup_lines(docs)._jdf.queryExecution().toString() + syncmers.edited_likeness(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- 8


def test_syncmers_are_context_free(spark):
    words = [f"w{i * i % 97}" for i in range(120)]
    rows = [(1, " ".join(words)), (2, "before, it " + " ".join(words) + " after"), (3, "x y"), (4, " "), (5, "")]
    got = {r.i: r.a for r in spark.createDataFrame(rows, "i int, t string").select("i", syncmers.anchors(F.col("t")).alias("a")).collect()}
    assert [(a.pos + 3, a.hash) for a in got[1]] == [(a.pos, a.hash) for a in got[2] if 3 <= a.pos <= 120 + 3 - syncmers.K]
    assert len(got[3]) == 1 and got[4] == [] and got[5] == []


def test_edited_texts(spark, odd, none):
    got = syncmers.edited_likeness(odd).collect()
    # In descending id, nulls last, ties by text.
    rows = sorted(_texts(odd), key=lambda r: (math.inf if r[0] is None else -r[0], r[1]))
    expected = Counter()
    for k, (i, text) in enumerate(rows):
        after, n = rows[(k + 1) % len(rows)][1], len(text)
        expected[i, n, hashlib.sha256((text[: n - n // 2] + after[: n // 2]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == expected
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert all((r.fingerprint == r.edited_fingerprint) <= (r.near_edited == 1) for r in got)
    assert syncmers.edited_likeness(none).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    far = syncmers.edited_likeness(docs).where("n_chars >= 500").collect()
    assert np.mean([0.2 <= r.near_edited <= 0.6 for r in far]) > 0.9
    assert np.mean([r.near_edited > r.near_next + 0.1 for r in far]) > 0.98


def _fingerprint_likeness(a, b):
    """From two returned fingerprints alone."""
    sets = [[int(f[i : i + 8], 16) for i in range(0, len(f), 8)] for f in (a, b)]
    bound = min(2**32 if len(s) < syncmers.SKETCH else max(syncmers.BELOW, s[-1] + 1) for s in sets)
    x, y = ({h for h in s if h < bound} for s in sets)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_likeness_is_that_of_the_returned_fingerprints(spark, odd):
    for docs in (odd.where("doc_id is not null"), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        texts = {r.doc_id: r.text for r in docs.collect()}
        got = sorted(syncmers.edited_likeness(docs).collect(), key=lambda r: (-r.doc_id, texts[r.doc_id] or ""))
        for r, after in zip(got, [*got[1:], got[0]], strict=True):
            assert r.near_edited == pytest.approx(_fingerprint_likeness(r.fingerprint, r.edited_fingerprint))
            assert r.near_next == pytest.approx(_fingerprint_likeness(r.fingerprint, after.fingerprint))
            assert 0 <= r.aligned_edited <= r.near_edited and 0 <= r.aligned_next <= r.near_next


def test_a_passage_shared_by_long_texts_is_seen(spark):
    rng = random.Random(6)
    passage = [f"p{rng.getrandbits(30)}" for _ in range(60)]
    first, second = ([f"{x}{rng.getrandbits(30)}" for _ in range(4000)] for x in "xy")
    texts = [" ".join(first[:900] + passage + first[900:]), " ".join(second[:2500] + passage + second[2500:])]
    frame = spark.createDataFrame([(texts[0], texts[1], " ".join(first[::-1]))], "a string, b string, c string")
    a, b, c = (syncmers.distinct(syncmers.anchors(F.col(x))) for x in "abc")
    got = frame.select(syncmers.likeness(a, b).alias("ab"), syncmers.likeness(a, c).alias("ac"), syncmers.sketch(a).alias("s")).first()
    assert 0.003 < got.ab.aligned <= got.ab.near < 0.02
    assert got.ac.aligned < 0.001
    assert len(got.s) > 3 * syncmers.SKETCH


# --- 9


def test_brown_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts, tokens = Counter(), {}
    for i, text in _texts(docs):
        tokens[i] = [*text.encode().lower().split(), b"\n"]
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(tokens[i])
    total, distinct = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in brown.score_documents(docs).collect()}
    assert len(got) == len(tokens)
    for i, own in tokens.items():
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own)
        assert got[i].base_score == pytest.approx(base) and got[i].n_tokens == len(own) and got[i].train_tokens == total
        assert got[i].n_known == sum(counts[t] > 0 for t in own) and got[i].held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_words_meet_their_counts(spark, monkeypatch):
    monkeypatch.setattr(brown, "KNOWN", 20)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    few = {r.doc_id: r for r in brown.score_documents(docs).collect()}
    monkeypatch.setattr(brown, "KNOWN", 65_536)
    # Elements are the most frequent of the known, so only the base score is the same.
    for r in brown.score_documents(docs).collect():
        assert few[r.doc_id].base_score == pytest.approx(r.base_score) and few[r.doc_id].n_known == r.n_known


def test_class_model_sums_to_one():
    rng = np.random.default_rng(0)
    coding = brown.Coding([(b"a", 5), (b"b", 3)])
    table = np.zeros((coding.size, coding.size))
    table[:30, :30] = rng.poisson(2, (30, 30))
    table[coding.end, :30] += 1
    of = brown.exchange(table, classes=8)
    assert of[coding.end] == 0 and (of[:-1] > 0).all()
    model = brown.Model(coding, table, of, {0: (10, 4)}, (100, 20))
    assert np.allclose((10**model.step).sum(axis=1), 1)
    assert np.allclose(np.bincount(of, 10**model.emit), np.bincount(of, minlength=8) > 0)


def test_exchange_raises_likelihood_to_the_planted_classes():
    rng = np.random.default_rng(4)
    planted = np.arange(40) % 2
    table = np.zeros((41, 41))
    for a in range(40):
        for b in range(40):
            table[a, b] = rng.poisson(20 if planted[a] != planted[b] else 0.2)
    table[40, :40] = table[:40, 40] = 1
    of = brown.exchange(table, classes=3)[:40]
    assert len(set(of[planted == 0])) == 1 and len(set(of[planted == 1])) == 1 and of[0] != of[1]


def _planted_docs(spark):
    """Rare words of two kinds, told apart by the words around them only; their last letters are all alike."""
    rng = random.Random(5)
    texts = []
    for k in range(60):
        own = [["one", f"a{k}xyz", "two"], ["six", f"b{k}xyz", "ten"]]
        texts += [" ".join(w for _ in range(6) for w in rng.choice(own)) for _ in range(6)]
    return spark.createDataFrame([_row(i, t) for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("sent", [1 << 20, 5])
def test_every_word_is_clustered_by_its_own_neighbours(spark, monkeypatch, sent):
    monkeypatch.setattr(brown, "SENT", sent)
    training = brown._rows(_planted_docs(spark)).where("not held_out")
    counts = {r.word: r.c for r in brown.count_words(training).collect()}
    seeds = {b"one": 1, b"two": 2, b"six": 3, b"ten": 4, brown.END: 0}
    keys = dict(zip(counts, brown.keys_of(list(counts)).tolist(), strict=True))
    words = [(keys[w], c, seeds.get(w, 5 + ((w[:1] == b"b") != (i % 3 == 0)))) for i, (w, c) in enumerate(sorted(counts.items()))]
    fixed = np.sort(brown.keys_of(list(seeds)))
    classes, table = brown.cluster(training, spark.createDataFrame(words, "key bigint, c bigint, cls int"), fixed)
    of = {r.key: r.cls for r in classes.collect()}
    first, second = ({of[keys[w]] for w in counts if w.endswith(b"xyz") and w[:1] == x} for x in (b"a", b"b"))
    assert first and second and not first & second and all(of[keys[w]] == c for w, c in seeds.items())
    assert table.sum() == sum(counts.values())


def test_sent_and_joined_classes_agree(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 80")
    whole = {r.doc_id: r.score for r in brown.score_documents(docs).collect()}
    monkeypatch.setattr(brown, "SENT", 50)
    joined = {r.doc_id: r.score for r in brown.score_documents(docs).collect()}
    assert joined == pytest.approx(whole)


def test_a_sweep_moves_no_counts(spark):
    coded = brown.encode_texts(brown._rows(_planted_docs(spark)).where("not held_out"))
    rows = list(brown._trained(coded.toArrow().to_batches()))
    counts = Counter(w for words, ids in rows for w in np.array(words, object)[ids])
    fixed = np.sort(brown.keys_of([b"one", b"two", brown.END]))
    keys = np.sort(brown.keys_of(list(counts)))
    send = spark.sparkContext.broadcast
    told = np.arange(len(keys)) % 7 + 1
    sent = send((keys, fixed, told[np.searchsorted(keys, fixed)]))
    packed = brown._sent_by_bucket(stored(brown.count_neighbours(coded, sent, 9), "near"), sent, send(told.astype(np.int8)), True)
    assert "Exchange" not in packed._jdf.queryExecution().toString()
    want = np.zeros((brown.CLASSES, brown.CLASSES))
    for words, ids in rows:
        cls = told[np.searchsorted(keys, brown.keys_of(words))][ids]
        np.add.at(want, (np.concatenate((cls[-1:], cls[:-1])), cls), 1)
    assert (brown._class_table(packed) == want).all()


def test_a_sweep_keeps_one_python_worker_a_task(spark, monkeypatch):
    made, chosen = [], brown._chosen
    monkeypatch.setattr(brown, "_chosen", lambda *args: made.append(chosen(*args)) or made[-1])
    brown.train(stored(brown.encode_texts(brown._rows(_planted_docs(spark))), "coded"))
    assert made and all(d._jdf.queryExecution().logical().toString().count("MapInArrow") == 1 for d in made)


def test_coded_texts_keep_words_and_tokens(spark, odd):
    rows = brown._rows(odd)
    got = Counter()
    for row, words, ids, many in brown._texts(brown.encode_texts(rows).toArrow().to_batches()):
        assert words[0] == brown.END and len(set(words)) == len(words) and row.column("tokens")[0].as_py()
        ends = np.cumsum(many)
        got.update(tuple(words[i] for i in ids[e - n : e]) for e, n in zip(ends, many, strict=True))
    assert got == Counter((*r.text.encode().lower().split(), brown.END) for r in rows.collect())


def test_counts_sent_by_hash_and_joined_agree(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40")
    whole = {r.doc_id: (r.n_known, r.base_score) for r in brown.score_documents(docs).collect()}
    monkeypatch.setattr(brown, "KNOWN", 20)
    monkeypatch.setattr(brown, "SENT", 60)
    for r in brown.score_documents(docs).collect():
        assert (r.n_known, r.base_score) == pytest.approx(whole[r.doc_id])


def test_brown_of_awkward_rows(odd, none):
    got = brown.score_documents(odd).collect()
    assert len(got) == odd.count() and all(r.score < 0 and r.base_score <= 0 for r in got)
    assert brown.score_documents(none).count() == 0


# --- 10


def test_longest_match_counts():
    rng = random.Random(2)
    pieces = list({"".join(rng.choices("abc", k=rng.randint(1, 5))).encode() for _ in range(25)})
    automaton = wordpiece.LongestMatch(pieces)
    for _ in range(3000):
        word = "".join(rng.choices("abcd", k=rng.randint(0, 12))).encode()
        i = n = 0
        while i < len(word):
            k = max((len(p) for p in pieces if word.startswith(p, i)), default=0)
            if not k:
                n = -1
                break
            i, n = i + k, n + 1
        assert automaton.count(word) == n, (word, pieces)


def test_token_counts(odd, none):
    path = tokenizer("byte_bpe_50k.json")
    got = wordpiece.count_tokens(odd, path).collect()
    assert Counter((r.doc_id, r.n_words) for r in got) == Counter((i, len(t.encode().split())) for i, t in _texts(odd))
    assert all(r.n_unknown == 0 and r.n_tokens >= r.n_words for r in got)
    assert wordpiece.count_tokens(none, path).count() == 0


# --- pipeline


def test_pipeline_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = {i: t for i, t in _texts(spark.read.parquet(f"{sf_dir}/documents.parquet")) if any(c.isalpha() for c in t)}
    gone = _brute_lines(list(rows.items()), lines.RUN, lines.MIN_WORDS)
    for i, where in gone.items():
        own = rows[i].split("\n")
        left = [x for p, x in enumerate(own) if p not in set(where)]
        rows[i] = "\n".join(left) if any(x.strip(" ") for x in left) else None
    rows = {i: t for i, t in rows.items() if t is not None}
    listed = sorted(rows.items())
    best = _brute_groups(listed, [simhash.fingerprint(t) for _, t in listed], 2, _shingle_sets([t for _, t in listed], 5))
    rows = {i: t for (i, t), b in zip(listed, best, strict=True) if i == b}
    for i in list(rows):
        n, hit, _ = _brute_hits(rows[i], benchmark, 13)
        if hit and 20 * len(hit) >= n:
            del rows[i]
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows.items()}


def test_stages_take_awkward_rows(spark, odd, none):
    for table in (odd, none):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
            assert docs.columns == table.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()
