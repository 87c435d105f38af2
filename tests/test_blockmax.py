"""Search by blocks: equal to the plain search, with blocks left unread."""

from __future__ import annotations

import random

import pytest
from conftest import collect
from pyspark.sql import functions as F

from reelgrid.operators import blockmax
from reelgrid.operators.lexical import bm25_search, build_postings

QUERY = "query_id string, text_query string"


def shown(df):
    return collect(df.withColumns({"raw_score": F.round("raw_score", 9), "score": F.round("score", 9)}))


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(3)
    common, rare = [f"the{i}" for i in range(12)], [f"rare{i}" for i in range(300)]
    docs = []
    for i in range(900):
        words = [draw.choice(common) for _ in range(draw.randrange(4, 60))] + draw.sample(rare, draw.randrange(3))
        draw.shuffle(words)
        docs.append((f"d{i:04}", " ".join(words)))
    docs += [("blank", "  "), ("null", None), ("marks", "!!! ..."), ("same1", "rare1 the1"), ("same2", "rare1 the1")]
    asked = [(f"q{i}", f"{draw.choice(rare)} {draw.choice(rare)} {draw.choice(common)}") for i in range(12)]
    asked += [("common", "the1 the2 the3"), ("unknown", "nowhere"), ("empty", ""), ("none", None), ("twice", "rare1 rare1 the1")]
    return build_postings(spark.createDataFrame(docs, "segment_id string, text string")), spark.createDataFrame(asked, QUERY)


@pytest.mark.parametrize("k, size, words", [(3, 20, 10_000), (1, 7, 0), (100, 50, 10_000), (5, 5000, 10_000)])
def test_blocks_find_what_the_plain_search_finds(corpus, k, size, words):
    postings, queries = corpus
    index = blockmax.block_index(postings, size)
    assert shown(blockmax.search_blocks(queries, index, k, words)) == shown(bm25_search(queries, postings, k))


def test_most_blocks_of_rare_words_queries_are_not_read(spark, corpus, tmp_path):
    postings, queries = corpus
    blockmax.write_block_index(postings, str(tmp_path / "blocks"), docs_per_range=10)
    index = blockmax.read_block_index(spark, str(tmp_path / "blocks"))
    rare = queries.where("query_id like 'q%'")
    told = blockmax.ranges_read(rare, index, k=3).agg(F.sum("blocks").alias("all"), F.sum("blocks_read").alias("read")).first()
    assert 0 < told["read"] < 0.5 * told["all"]
    assert shown(blockmax.search_blocks(queries, index, 3)) == shown(bm25_search(queries, postings, 3))


def test_bounds_hold(corpus):
    """No document scores above the bound of its range, words of negative weight included."""
    postings, queries = corpus
    index = blockmax.block_index(postings, 30)
    search = blockmax._Search(queries, index, 10_000)
    every = search.hits(search.bounds.select("query_id", "range"), 10_000)
    ranged = every.withColumn("range", F.pmod(F.xxhash64("segment_id"), F.lit(index.blocks.agg(F.max("range")).first()[0] + 1)))
    over = ranged.join(search.bounds, ["query_id", "range"]).where("raw_score > bound + 1e-9")
    assert every.count() > 1000 and over.count() == 0


def test_nothing_indexed_or_asked(spark, corpus):
    postings, queries = corpus
    none = build_postings(spark.createDataFrame([], "segment_id string, text string"))
    assert blockmax.search_blocks(queries, blockmax.block_index(none)).collect() == []
    assert blockmax.search_blocks(spark.createDataFrame([], QUERY), blockmax.block_index(postings)).collect() == []


def test_no_pair_of_query_and_document_is_dealt_out(corpus):
    """Whole ranges are in one task; the ranges a query did not choose add nothing to its sums."""
    postings, queries = corpus
    index = blockmax.block_index(postings, 20)
    search = blockmax._Search(queries, index, 10_000)
    first = blockmax.stored(search.first(3), "first-ranges")
    hits = search.hits(first, 1000)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(range#" in plan and "hashpartitioning(query_id#" in plan
    assert not any("segment_id" in line or "token" in line for line in plan.splitlines() if "hashpartitioning(" in line)
    ranged = hits.withColumn("range", F.pmod(F.xxhash64("segment_id"), F.lit(search.ranges)))
    assert ranged.join(first, ["query_id", "range"], "left_anti").count() == 0


def test_many_weights_are_joined_by_block(corpus):
    postings, queries = corpus
    index = blockmax.block_index(postings, 20)
    found = blockmax.search_blocks(queries, index, 3, sent_rows=1)
    assert shown(found) == shown(bm25_search(queries, postings, 3))
