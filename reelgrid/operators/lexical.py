"""Lexical index and BM25 search.

Postings are one row per document, ``(segment_id, doc_len, terms)``, made without a shuffle. The index
turns them round: one row per word and document, stored in the order of the words, beside the words'
document counts and weights and the corpus figures. Search reads only the row groups that may hold the
queries' words, gathers each document's matching words in one task, and ranks there: a query's best
``k`` are cut per task before anything is shuffled by query.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.functions.text import is_blank, tokens
from reelgrid.operators.ranking import top_k
from reelgrid.schemas import BM25_B, BM25_EPSILON, BM25_K1, TOP_K_RETRIEVAL
from reelgrid.spreading import BROADCAST_ROWS, lookup_join, stored, tasks_for

BROADCAST_BYTES = 64_000_000  # most bytes of query words that are sent to every task
SENT_WORDS = 10_000  # most distinct words that become a filter of the index scan
TASK_ENTRIES = 2_000_000  # entries of the index that one task sorts, about
TASK_SUMS = 500_000  # sums of a query and a document that one task holds, about
WORD_RANGES = 16  # most ranges of neighbouring words in that filter: compiled code of more is not optimised


class LexicalIndex(NamedTuple):
    """``(token, segment_id, tf, doc_len)``, ``(token, df, idf)``, and one row ``(n_docs, avg_len)``."""

    entries: DataFrame
    idf: DataFrame
    corpus: DataFrame


def with_tokens(df: DataFrame, col: str, out: str = "tokens") -> DataFrame:
    return df.withColumn(out, tokens(F.col(col)))


def indexable_text(df: DataFrame, col: str = "text") -> DataFrame:
    return df.where(~is_blank(F.col(col)))


def build_postings(segments: DataFrame, key: str = "segment_id", text: str = "text") -> DataFrame:
    """One row per document with text: its length in words and its distinct words with counts.

    Word lists are sorted inside the row and cut where the word changes, so no explode, shuffle or
    group is needed. Documents whose text holds no word stay, with length zero.
    """
    docs = indexable_text(segments, text).select(
        F.col(key).alias("segment_id"), F.sort_array(tokens(F.col(text))).alias("words")
    )
    docs = docs.withColumn("doc_len", F.size("words"))
    positions = F.transform("words", lambda _, i: i)
    starts = F.filter(
        positions, lambda i: (i == 0) | (F.get("words", i) != F.get("words", i - 1))
    )
    docs = docs.withColumn("starts", starts)
    stops = F.concat(F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))), F.array("doc_len"))
    terms = F.zip_with(
        "starts",
        stops,
        lambda i, j: F.when(
            i.isNotNull(), F.struct(F.get("words", i).alias("token"), (j - i).alias("tf"))
        ),
    )
    return docs.select("segment_id", "doc_len", F.filter(terms, lambda t: t.isNotNull()).alias("terms"))


def bm25_stats(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(corpus, idf)``: one row with ``n_docs`` and ``avg_len``; one row per word with ``df`` and ``idf``.

    Words in more than half of the documents have a negative raw idf; they get a quarter of the mean
    raw idf over the vocabulary instead.
    """
    corpus = postings.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"))
    counts = (
        postings.select(F.explode_outer("terms.token").alias("token")).where("token is not null")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    rest = corpus.select("n_docs").scalar() - F.col("df") + 0.5
    raw = counts.withColumn("raw_idf", F.log(rest) - F.log(F.col("df") + 0.5))
    floor = raw.agg(F.avg("raw_idf").alias("mean_idf")).scalar() * BM25_EPSILON
    idf = raw.select(
        "token", "df", F.when(F.col("raw_idf") < 0, floor).otherwise(F.col("raw_idf")).alias("idf")
    )
    return corpus, idf


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, token, weight)``: words of the text query, twice when a hypothetical document adds its own."""
    words = tokens(F.col("text_query"))
    if "hyde_document" in queries.columns:
        extra = F.coalesce("hyde_document", F.lit(""))
        words = F.when(extra != "", F.concat(words, words, tokens(extra))).otherwise(words)
    listed = queries.select("query_id", F.explode_outer(words).alias("token")).where("token is not null")
    return listed.groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("weight"))


def lexical_index(postings: DataFrame) -> LexicalIndex:
    """The index of a table of postings, not stored: its figures are counted whenever they are used."""
    # outer, as the planner otherwise adds a filter on the list and so builds every list twice
    entries = postings.select("segment_id", "doc_len", F.inline_outer("terms")).where("token is not null")
    corpus, idf = bm25_stats(postings)
    return LexicalIndex(entries.select("token", "segment_id", "tf", "doc_len"), idf, corpus)


def ordered_entries(entries: DataFrame, counts: DataFrame, order: list[str]) -> DataFrame:
    """Entries in ranges and sorted, a bounded number to a task; ``counts`` has the words' ``df``, so their sum."""
    rows = counts.agg(F.sum("df").alias("n")).first()["n"] or 0
    parts = tasks_for(entries.sparkSession, rows, TASK_ENTRIES)
    return entries.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def one_of(words: list[str]) -> Column:
    """``token`` is one of the words, as sets of neighbours: each set prunes row groups by its own range.

    The sets are the leaves of a tree of comparisons, so an entry is looked up in one of them.
    """
    ordered = sorted(words)
    size = max(10, -(-len(ordered) // WORD_RANGES))
    sets = [ordered[i : i + size] for i in range(0, len(ordered), size)]

    def among(some: list[list[str]]) -> Column:
        if len(some) == 1:
            return F.col("token").isin(some[0])
        half = len(some) // 2
        least = F.lit(some[half][0])
        return ((F.col("token") < least) & among(some[:half])) | ((F.col("token") >= least) & among(some[half:]))

    return among(sets) if sets else F.lit(False)


def saturation(corpus: DataFrame) -> Column:
    """What ``tf`` occurrences in a document of ``doc_len`` words count for."""
    length_share = F.col("doc_len") / corpus.select("avg_len").scalar()
    return F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * length_share))


def sums_of(weighted: DataFrame, corpus: DataFrame) -> int:
    """At most so many pairs of a query and a document share a word; ``weighted`` has ``query_id`` and ``df``."""
    told = weighted.agg(F.sum("df").alias("pairs"), F.count_distinct("query_id").alias("queries")).first()
    return min(told["pairs"] or 0, told["queries"] * corpus.select("n_docs").first()["n_docs"])


def bm25_search(
    queries: DataFrame,
    index: LexicalIndex | DataFrame,
    k: int = TOP_K_RETRIEVAL,
    broadcast_rows: int = BROADCAST_ROWS,
    sent_words: int = SENT_WORDS,
) -> DataFrame:
    """Best ``k`` documents per query by BM25, as shares of the query's best score.

    ``index`` is a stored index, or a table of postings. When the queries' words are few enough to send
    to every task, in rows and bytes, the index is cut down to them where it is read and partitioned by
    document once, into as many parts as bound the sums that a task holds; otherwise both sides meet in a shuffle join on the word, with words cut apart by a
    salt. The rows are the same.
    """
    entries, idf, corpus = index if isinstance(index, LexicalIndex) else lexical_index(index)
    terms = query_terms(queries)
    size = (
        terms.limit(broadcast_rows + 1)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("token")).alias("b"), F.count_distinct("token").alias("w"))
        .first()
    )
    small = size["n"] <= broadcast_rows and (size["b"] or 0) <= BROADCAST_BYTES
    vocabulary = terms.select("token").distinct()
    if small and size["w"] <= sent_words:
        asked = one_of([r["token"] for r in vocabulary.collect()])
        known, matched = idf.where(asked), entries.where(asked)
    elif small:
        known, matched = (part.join(F.broadcast(vocabulary), "token", "left_semi") for part in (idf, entries))
    else:
        known, matched = idf.join(vocabulary, "token", "left_semi"), entries
    weighted = known.join(terms, "token").select(
        "query_id", "token", (F.col("weight") * F.col("idf")).alias("weight"), "df"
    )
    if small:
        weighted = stored(weighted, "weights")
        parts = tasks_for(weighted.sparkSession, sums_of(weighted, corpus), TASK_SUMS)
        pairs = matched.repartition(parts, "segment_id").withColumn("saturation", saturation(corpus))
        pairs = pairs.join(F.broadcast(weighted), "token")
    else:
        pairs = lookup_join(matched.withColumn("saturation", saturation(corpus)), weighted, ["token"], ["segment_id"], "inner")
    scored = (
        pairs.groupBy("query_id", "segment_id")
        .agg(F.sum(F.col("weight") * F.col("saturation")).alias("raw_score"))
        .where(F.col("raw_score") > 0)
        .withColumn("score", F.col("raw_score"))
    )
    best = F.max("raw_score").over(Window.partitionBy("query_id"))
    return top_k(scored, k).select(
        "query_id",
        F.lit("text_sparse").alias("source"),
        "segment_id",
        "rank",
        "raw_score",
        (F.col("raw_score") / best).alias("score"),
    )
