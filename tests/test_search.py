from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import collect
from pyspark.sql import functions as F

from reelgrid.functions import text as tx
from reelgrid.functions.vector import conformed, norm, normalized
from reelgrid.operators import fusion, lexical, models, ranking, vectors
from reelgrid.sources.tables import read_lexical_index, write_lexical_index


def test_tokens(rows):
    df = rows([("BREAKING-news! 2½ a_b",), (" x y z",), ("...",), ("",)], "t string")
    got = [r["w"] for r in df.select(tx.tokens(F.col("t")).alias("w")).collect()]
    assert got == [["breakingnews", "2½", "a_b"], ["x", "y", "z"], [], []]


def test_tokens_equal_the_regex_rule(rows):
    samples = ["Hà Nội, Việt Nam! 12.5%", "naïve—café\tÀ\n\x85b", "日本 語_x ½ ①", "é combining"]
    expected = [re.sub(r"[^\w\s]", "", s.lower().strip()).split() for s in samples]
    df = rows([(i, s) for i, s in enumerate(samples)], "i int, t string").orderBy("i")
    assert [r["w"] for r in df.select(tx.tokens(F.col("t")).alias("w")).collect()] == expected


def test_clock(rows):
    df = rows([(-1.0,), (0.0,), (75.9,), (3661.0,)], "s double")
    assert [r[0] for r in df.select(tx.clock(F.col("s"))).collect()] == ["00:00", "00:00", "01:15", "01:01:01"]


def test_file_names(rows):
    df = rows([("/a/b.c.mp4",), (".hidden",), ("plain",)], "p string")
    got = [tuple(r) for r in df.select(tx.base_name(F.col("p")), tx.file_stem(F.col("p"))).collect()]
    assert got == [("b.c.mp4", "b.c"), (".hidden", ".hidden"), ("plain", "plain")]


def test_full_text_order(rows):
    df = rows([("a", ["o1", "o2"], [], ["s"]), ("", [], [], [])], "a string, o array<string>, l array<string>, e array<string>")
    got = [r[0] for r in df.select(tx.full_text(F.col("a"), F.col("o"), F.col("l"), F.col("e"))).collect()]
    assert got == ["a o1 o2 s", ""]


def _bm25(docs, query, k1=1.5, b=0.75):
    """Scores by the textbook, document by document."""
    words = {i: re.sub(r"[^\w\s]", "", t.lower()).split() for i, t in docs.items() if t.strip()}
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: low if v < 0 else v for w, v in idf.items()}
    out = {}
    for i, ws in words.items():
        tf = Counter(ws)
        out[i] = sum(idf.get(q, 0) * tf[q] * (k1 + 1) / (tf[q] + k1 * (1 - b + b * len(ws) / avg)) for q in query)
    return {i: s for i, s in out.items() if s > 0}


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_bm25_equals_textbook(rows, broadcast_rows):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    docs = {i: " ".join(rnd.choices(vocabulary, weights=range(30, 0, -1), k=rnd.randint(1, 40))) for i in range(60)}
    docs[60], docs[61] = "   ", "!!!"
    table = rows(list(docs.items()), "segment_id bigint, text string")
    queries = rows(
        [(1, "w3 w7 w3 nowhere", ""), (2, "w20", "w20 w21 w5"), (3, "???", "")],
        "query_id bigint, text_query string, hyde_document string",
    )
    postings = lexical.build_postings(table)
    assert postings.count() == 61
    found = lexical.bm25_search(queries, postings, k=1000, broadcast_rows=broadcast_rows)
    got = {(r["query_id"], r["segment_id"]): r["raw_score"] for r in found.collect()}
    expected = {}
    for q, words in ((1, ["w3", "w7", "w3", "nowhere"]), (2, ["w20", "w20", "w20", "w21", "w5"])):
        expected |= {(q, i): s for i, s in _bm25(docs, words).items()}
    assert got == pytest.approx(expected)
    tops = found.where("rank = 1").select("score").collect()
    assert [r["score"] for r in tops] == [1.0, 1.0]


def test_bm25_cut_keeps_ties_in_id_order(rows):
    docs = rows([(i, "same words here") for i in range(9)] + [(9, "other")], "segment_id bigint, text string")
    queries = rows([(1, "words")], "query_id bigint, text_query string")
    found = lexical.bm25_search(queries, lexical.build_postings(docs), k=3)
    assert collect(found, "rank", "segment_id") in ([(1, 0), (2, 1), (3, 2)], [])


def test_scoring_is_cut_before_it_is_shuffled_by_query(rows):
    docs = rows([(i, f"a b c d{i}") for i in range(50)], "segment_id bigint, text string")
    queries = rows([(1, "a d3 d4")], "query_id bigint, text_query string")
    plan = lexical.bm25_search(queries, lexical.build_postings(docs), k=3)._jdf.queryExecution().executedPlan().toString()
    by_query = plan.index("Exchange hashpartitioning(query_id")
    assert "WindowGroupLimit" in plan[by_query:]
    assert "hashpartitioning(query_id" not in plan[by_query + 10 :].split("WindowGroupLimit", 1)[1].split("BroadcastExchange")[0]


def test_stored_index_is_read_by_word_without_counting_the_corpus(spark, rows, tmp_path):
    docs = rows([(i, f"w{i % 40} w{i % 7} all") for i in range(200)], "segment_id bigint, text string")
    queries = rows([(1, "w3 w7"), (2, "w39 none"), (3, "")], "query_id bigint, text_query string")
    postings = lexical.build_postings(docs)
    write_lexical_index(postings, str(tmp_path / "lexical"))
    index = read_lexical_index(spark, str(tmp_path / "lexical"))
    expected = collect(lexical.bm25_search(queries, postings, k=50).select("query_id", "segment_id", F.round("raw_score", 9)))
    for options in ({}, {"sent_words": 1}, {"broadcast_rows": 1}):
        found = lexical.bm25_search(queries, index, 50, **options)
        assert collect(found.select("query_id", "segment_id", F.round("raw_score", 9))) == expected
    plan = lexical.bm25_search(queries, index, 50)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "Scan parquet" in line and "token" in line]
    assert scans and all("PushedFilters: [In(token, [" in line for line in scans)
    assert "partial_avg" not in plan
    many = rows([(1, " ".join(f"w{i}" for i in range(5_000)))], "query_id bigint, text_query string")
    assert lexical.bm25_search(many, index, 500).count() == 200
    assert lexical.bm25_search(rows([(1, "?")], "query_id bigint, text_query string"), index).collect() == []


def test_sums_and_entries_of_a_task_are_bounded(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "TASK_SUMS", 40)
    monkeypatch.setattr(lexical, "TASK_ENTRIES", 50)
    docs = rows([(f"d{i:03}", f"one two w{i % 7}") for i in range(200)], "segment_id string, text string")
    asked = rows([("a", "one w3"), ("b", "two none")], "query_id string, text_query string")
    write_lexical_index(lexical.build_postings(docs), str(tmp_path))
    index = read_lexical_index(spark, str(tmp_path))
    assert len(list((tmp_path / "entries").glob("*.parquet"))) == 12  # 600 entries
    hits = lexical.bm25_search(asked, index, 5)
    # two queries share words with all documents: 400 sums
    assert re.search(r"hashpartitioning\(segment_id#\d+, 10\)", hits._jdf.queryExecution().executedPlan().toString())
    assert collect(hits, "query_id", "rank", "segment_id") == collect(
        lexical.bm25_search(asked, lexical.build_postings(docs), 5, broadcast_rows=0), "query_id", "rank", "segment_id"
    )


def test_normalize_and_conform(rows):
    df = rows([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = df.select(normalized(F.col("v")).alias("u")).withColumn("n", norm(F.col("u"))).collect()
    assert got[0]["u"] == pytest.approx([0.6, 0.8]) and got[1]["u"] == [0.0, 0.0]
    cut = df.select(conformed(F.col("v"), 1).alias("a"), conformed(F.col("v"), 4).alias("b")).first()
    assert cut["a"] == [3.0] and cut["b"] == [3.0, 4.0, 0.0, 0.0]


def test_width_audit(rows):
    df = rows([("visual", [0.0] * 3), ("visual", [0.0] * 2), ("audio", [0.0])], "modality string, embedding array<double>")
    got = collect(vectors.dim_audit(df, {"visual": 3}), "modality", "dim", "n_vectors", "as_expected")
    assert got == [("audio", 1, 1, False), ("visual", 2, 1, False), ("visual", 3, 1, True)]


@pytest.fixture()
def vector_tables(rows):
    rng = np.random.default_rng(1)
    stored = rng.normal(size=(300, 8))
    stored[200:280] = stored[0]  # a group of copies
    asked = rng.normal(size=(12, 8))
    to_rows = lambda m, p: [(f"{p}{i:03d}", [float(x) for x in v]) for i, v in enumerate(m)]
    vectors_ = rows(to_rows(stored, "s") + [("narrow", [1.0, 2.0]), ("none", None)], "segment_id string, embedding array<double>")
    queries = rows(to_rows(asked, "q"), "query_id string, embedding array<double>")
    expected = []
    for j, q in enumerate(asked):
        sims = np.round(stored @ q, 9)
        best = sorted(range(300), key=lambda i: (-sims[i], i))[:10]
        expected += [(f"q{j:03d}", rank + 1, f"s{i:03d}") for rank, i in enumerate(best)]
    return queries, vectors_, sorted(expected, key=repr)


def test_vector_search_sent(vector_tables):
    queries, stored, expected = vector_tables
    found = vectors.vector_search(queries, stored.repartition(5), "visual", k=10)
    assert collect(found, "query_id", "rank", "segment_id") == expected


def test_vector_search_in_blocks_is_the_same(vector_tables):
    queries, stored, expected = vector_tables
    found = vectors.vector_search(queries, stored, "visual", k=10, max_sent=3)
    assert collect(found, "query_id", "rank", "segment_id") == expected


@pytest.mark.parametrize("max_sent", [100, 5])
def test_models_run_once_per_row(rows, vector_tables, max_sent):
    """Neither way of searching encodes a query or a stored row twice."""
    queries, stored, expected = vector_tables
    counts = [queries.sparkSession.sparkContext.accumulator(0) for _ in range(2)]

    def encoded(df, count):
        def run(batches):
            for batch in batches:
                count.add(batch.num_rows)
                yield batch

        return df.mapInArrow(run, df.schema)

    found = vectors.vector_search(encoded(queries, counts[0]), encoded(stored, counts[1]), "visual", k=10, max_sent=max_sent)
    assert collect(found, "query_id", "rank", "segment_id") == expected
    assert [c.value for c in counts] == [queries.count(), stored.count()]


@pytest.mark.parametrize("options", [{}, {"max_sent": 30}])
def test_a_table_can_be_searched_for_itself(vector_tables, options):
    _, stored, _ = vector_tables
    asked = stored.withColumnRenamed("segment_id", "query_id")
    own = vectors.vector_search(asked, stored, "visual", k=400, **options)
    assert own.where("query_id = segment_id").count() == 301
    assert own.count() == 300 * 300 + 1


def test_vector_scores(rows):
    queries = rows([("q", [2.0, 0.0])], "query_id string, embedding array<double>")
    stored = rows([("a", [1.0, 0.0])], "segment_id string, embedding array<double>")
    assert vectors.vector_search(queries, stored, "visual").first()["score"] == 1.0
    assert vectors.vector_search(queries, stored, "text_dense", clamp=False).first()["score"] == 1.5


@pytest.mark.parametrize("options", [{}, {"max_sent": 2}])
def test_zero_shot_labels(rows, options):
    labels = rows([(i, f"l{i}", [1.0 if j == i else 0.0 for j in range(5)]) for i in range(5)], "pos bigint, label string, embedding array<double>")
    stored = rows([("a", [5.0, 5.0, 0.0, 0.0, 0.0]), ("b", [1.0] * 5), ("c", [0.0] * 5)], "segment_id string, embedding array<double>")
    got = dict(collect(vectors.zero_shot_labels(stored, labels, threshold=0.21, **options)))
    assert got == {"a": ["l0", "l1"], "b": [], "c": []}


HITS = "query_id bigint, source string, segment_id string, rank int, score double, text string"


def test_fusion_weights_are_shares_of_found_lists(rows):
    hits = rows(
        [(1, "text_dense", "x", 1, 0.9, ""), (1, "text_dense", "y", 2, 0.8, "d"), (1, "text_sparse", "y", 1, 1.0, "s")],
        HITS,
    )
    fused = {r["segment_id"]: r for r in fusion.rrf_fuse(hits).collect()}
    dense, sparse = 0.35 / 0.55, 0.20 / 0.55
    assert fused["x"]["score"] == pytest.approx(dense / 61)
    assert fused["y"]["score"] == pytest.approx(dense / 62 + sparse / 61)
    assert fused["y"]["rank"] == 1 and fused["y"]["num_sources"] == 2 and fused["x"]["sparse_score"] == 0.0
    assert fused["y"]["text"] == "d"  # the later list with text


def test_fusion_skips_blank_ids_and_keeps_first_seen_order(rows):
    hits = rows(
        [
            (1, "visual", "", 1, 0.9, ""),
            (1, "visual", "v", 2, 0.5, ""),
            (1, "audio", "b", 1, 0.5, ""),
            (2, "audio", "z", 1, 0.5, ""),
            (2, "temporal", "a", 1, 0.5, ""),
        ],
        HITS,
    )
    fused = collect(fusion.rrf_fuse(hits), "query_id", "rank", "segment_id")
    assert fused == [(1, 1, "v"), (1, 2, "b"), (2, 1, "z"), (2, 2, "a")]


def test_fusion_does_not_depend_on_row_order(rows):
    rnd = random.Random(2)
    data = []
    for source in ("text_dense", "visual", "audio"):
        ids = rnd.sample(range(40), 20)
        data += [(1, source, f"s{i}", rank, 1 - rank / 40, "") for rank, i in enumerate(ids, 1)]
    first = collect(fusion.rrf_fuse(rows(data, HITS)), "rank", "segment_id")
    rnd.shuffle(data)
    assert collect(fusion.rrf_fuse(rows(data, HITS).repartition(3)), "rank", "segment_id") == first


def test_union_and_splice(rows):
    schema = "query_id bigint, source string, segment_id string, score double"
    a = rows([(1, "text", "x", 0.5), (1, "text", "y", 0.9)], schema)
    b = rows([(1, "visual", "x", 0.7)], schema)
    assert collect(ranking.union_rank(a, b, 2), "rank", "segment_id", "source") == [(1, "y", "text"), (2, "x", "visual")]
    listed = "query_id bigint, segment_id string, rank int, score double"
    head = rows([(1, "a", 2, 0.1), (1, "b", 1, 0.2)], listed)
    tail = rows([(1, "c", 3, 0.9), (1, "d", 4, 0.95)], listed)
    assert collect(ranking.splice(head, tail), "rank", "segment_id") == [(1, "b"), (2, "a"), (3, "c"), (4, "d")]


def test_encode_column(rows):
    def failing():
        def encode(texts):
            if "bad" in texts:
                raise ValueError("cannot encode")
            return np.asarray([[len(t), 0.0] for t in texts], dtype=float)

        return encode

    df = rows([(1, "abc"), (2, " "), (3, "bad"), (4, None)], "i int, t string").coalesce(1)
    got = dict(collect(models.encode_column(df, "t", failing, 2, batch_size=1), "i", "embedding"))
    assert got == {1: [1.0, 0.0], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [0.0, 0.0]}


def test_score_pairs_reads_the_id_of_textless_rows(rows):
    df = rows([("red car", "a red bus", "s1"), ("s2 x", "", "s2")], "query string, text string, segment_id string")
    assert collect(models.score_pairs(df, models.token_overlap), "segment_id", "logit") == [("s1", 0.5), ("s2", 0.5)]
