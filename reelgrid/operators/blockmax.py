"""BM25 search that reads only the postings that can matter.

Documents are dealt into ranges of about ``RANGE``; the postings of a word in a range are a block, and the
index keeps the greatest saturation of every block. For a query the weighted maxima of its words add up to
a bound that no document of the range exceeds. The ranges with the highest bounds are scored first; the score
of the ``k``-th document there is the query's bar, and only ranges whose bound reaches the bar are scored after
that. Blocks of other words and ranges are not read. The rows are those of ``bm25_search``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelgrid.operators.lexical import (
    SENT_WORDS,
    TASK_SUMS,
    LexicalIndex,
    lexical_index,
    one_of,
    ordered_entries,
    query_terms,
    saturation,
)
from reelgrid.operators.ranking import top_k
from reelgrid.schemas import TOP_K_RETRIEVAL
from reelgrid.spreading import BROADCAST_ROWS, fits, lookup_join, stored, tasks_for

RANGE = 256  # documents of a range, about
FIRST = 4  # times ``k`` documents that the first ranges hold, about
MASK = 64  # queries whose choice of a range is one number
SENT_BLOCKS = 500_000  # blocks, or ranges, that are sent to the tasks as a list at most
SLACK = 1e-9


class BlockIndex(NamedTuple):
    """``(token, range, segment_id, tf, doc_len)``, ``(token, range, n, most)``, ``(token, df, idf)``, one row ``(n_docs, avg_len)``."""

    entries: DataFrame
    blocks: DataFrame
    idf: DataFrame
    corpus: DataFrame


def block_index(index: LexicalIndex | DataFrame, docs_per_range: int = RANGE) -> BlockIndex:
    """Ranges and blocks of an index, or of a table of postings; documents are dealt by the hash of their id."""
    entries, idf, corpus = index if isinstance(index, LexicalIndex) else lexical_index(index)
    ranges = F.greatest(F.lit(1), F.ceil(corpus.select("n_docs").scalar() / docs_per_range)).cast("bigint")
    dealt = entries.withColumn("range", F.pmod(F.xxhash64("segment_id"), ranges))
    dealt = dealt.select("token", "range", "segment_id", "tf", "doc_len")
    blocks = dealt.groupBy("token", "range").agg(
        F.count(F.lit(1)).alias("n"), F.max(saturation(corpus)).alias("most")
    )
    return BlockIndex(dealt, blocks, idf, corpus)


def write_block_index(index: LexicalIndex | DataFrame, path: str, docs_per_range: int = RANGE) -> None:
    """Postings and blocks in the order of words and ranges; frequent words span several files."""
    made = block_index(index, docs_per_range)
    made.corpus.write.parquet(f"{path}/corpus")
    fixed = made.corpus.sparkSession.read.parquet(f"{path}/corpus")
    made = block_index(LexicalIndex(made.entries.drop("range"), made.idf, fixed), docs_per_range)
    made.idf.repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{path}/idf")
    counts = fixed.sparkSession.read.parquet(f"{path}/idf")
    ordered_entries(made.entries, counts, ["token", "range", "segment_id"]).write.parquet(f"{path}/entries")
    written = fixed.sparkSession.read.parquet(f"{path}/entries")
    blocks = written.groupBy("token", "range").agg(F.count(F.lit(1)).alias("n"), F.max(saturation(fixed)).alias("most"))
    by = ["token", "range"]
    blocks.repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(f"{path}/blocks")


def read_block_index(spark: SparkSession, path: str) -> BlockIndex:
    return BlockIndex(*[spark.read.parquet(f"{path}/{part}") for part in BlockIndex._fields])


class _Search:
    """One search: the words' weights, the bounds of ranges, and the scoring of chosen ranges."""

    def __init__(self, queries: DataFrame, index: BlockIndex, sent_words: int, sent_rows: int = BROADCAST_ROWS) -> None:
        self.index = index
        self.spark = queries.sparkSession
        terms = stored(query_terms(queries), "query-terms")
        words = terms.select("token").distinct().limit(sent_words + 1).collect()
        #: A filter that the scans understand, while the words are few.
        self.asked: Column = one_of([r["token"] for r in words]) if len(words) <= sent_words else F.lit(True)
        known = index.idf.where(self.asked).join(terms, "token")
        weighted = known.select("query_id", "token", (F.col("weight") * F.col("idf")).alias("weight"))
        self.weighted = stored(weighted, "weights")
        told = index.blocks.agg(F.max("range").alias("last")).first()["last"]
        self.ranges = (told or 0) + 1
        self.docs = index.corpus.first()["n_docs"]
        #: Few weights are sent to the tasks, which hold whole ranges; then no pair of a query and a document is dealt out.
        self.small = fits(self.weighted, sent_rows)
        blocks = index.blocks.where(self.asked)
        if self.small:
            asked = self.weighted.select("query_id").distinct()
            place = F.row_number().over(Window.orderBy("query_id")) - 1  # ``sent_rows`` queries at most
            numbers = asked.select("query_id", F.floor(place / MASK).alias("group"), F.pmod(place, F.lit(MASK)).alias("bit"))
            self.numbers = stored(numbers, "query-numbers")
            met = blocks.repartition(self._tasks(self.numbers.count() * self.ranges), "range")
            met = met.join(F.broadcast(self.weighted), "token")
        else:
            met = lookup_join(blocks, self.weighted, ["token"], ["range"], "inner")
        bounds = met.groupBy("query_id", "range").agg(
            F.sum(F.greatest(F.col("weight") * F.col("most"), F.lit(0.0))).alias("bound"),
            F.count(F.lit(1)).alias("blocks"),
        )
        self.bounds = stored(bounds, "bounds")

    def _tasks(self, sums: int) -> int:
        return tasks_for(self.spark, sums, TASK_SUMS)

    def first(self, ranges: int) -> DataFrame:
        """The ranges of each query with the highest bounds."""
        order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "range")
        placed = self.bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= ranges)
        return placed.select("query_id", "range")

    def rest(self, first: DataFrame, hits: DataFrame, k: int) -> DataFrame:
        """All other ranges whose bound reaches the query's bar; a query of fewer hits has none."""
        bars = hits.where(F.col("rank") == k).select("query_id", F.col("raw_score").alias("bar"))
        left = self.bounds.join(first, ["query_id", "range"], "left_anti").join(bars, "query_id", "left")
        enough = F.col("bound") >= F.coalesce(F.col("bar") * (1 - SLACK) - SLACK, F.lit(0.0))
        return left.where(enough & (F.col("bound") > 0)).select("query_id", "range")

    def hits(self, chosen: DataFrame, k: int) -> DataFrame:
        """The best ``k`` of each query in the chosen ranges; only ranges that some query has chosen are scored."""
        pairs = self._pairs_of_ranges(chosen) if self.small else self._pairs_of_blocks(chosen)
        scored = (
            pairs.withColumn("saturation", saturation(self.index.corpus))
            .groupBy("query_id", "range", "segment_id")
            .agg(F.sum(F.col("weight") * F.col("saturation")).alias("raw_score"))
            .where(F.col("raw_score") > 0)
            .withColumn("score", F.col("raw_score"))
        )
        return top_k(scored, k).select("query_id", "segment_id", "rank", "raw_score")

    def _pairs_of_ranges(self, chosen: DataFrame) -> DataFrame:
        """Entries of whole ranges in one task each, with the weights of the queries that chose their range."""
        chosen = stored(chosen, "ranges-wanted")
        parts = self._tasks(chosen.count() * -(-self.docs // self.ranges))
        bits = chosen.join(F.broadcast(self.numbers), "query_id").groupBy("range", "group")
        masks = bits.agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
        entries, ranges = self.index.entries.where(self.asked), chosen.select("range").distinct()
        if fits(ranges, SENT_BLOCKS):
            entries = entries.join(F.broadcast(ranges), "range", "left_semi")
        masked = entries.repartition(parts, "range").join(masks.repartition(parts, "range").hint("shuffle_hash"), "range")
        weights = self.weighted.join(F.broadcast(self.numbers), "query_id")
        pairs = masked.join(F.broadcast(weights), ["token", "group"])
        return pairs.where(F.expr("shiftright(mask, bit) & 1L") == 1)

    def _pairs_of_blocks(self, chosen: DataFrame) -> DataFrame:
        """Entries of the chosen blocks, joined by word and range with the weights that want them."""
        wanted = stored(chosen.join(self.weighted, "query_id"), "blocks-wanted")
        needed = wanted.select("token", "range").distinct()
        needed = F.broadcast(needed) if fits(needed, SENT_BLOCKS) else needed
        read = self.index.entries.where(self.asked).join(needed, ["token", "range"], "left_semi")
        return read.join(wanted, ["token", "range"])

    def first_ranges(self, k: int) -> int:
        """How many ranges hold ``FIRST * k`` documents, about."""
        return max(1, -(-FIRST * k * self.ranges // max(self.docs, 1)))


def ranges_read(
    queries: DataFrame, index: BlockIndex, k: int = TOP_K_RETRIEVAL, sent_words: int = SENT_WORDS
) -> DataFrame:
    """``query_id, ranges, read, blocks, blocks_read``: how much of its words' blocks a search scores."""
    search = _Search(queries, index, sent_words)
    first = stored(search.first(search.first_ranges(k)), "first-ranges")
    rest = search.rest(first, search.hits(first, k), k)
    chosen = first.unionByName(rest).withColumn("chosen", F.lit(1))
    flagged = search.bounds.join(chosen, ["query_id", "range"], "left")
    return flagged.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("ranges"),
        F.count("chosen").alias("read"),
        F.sum("blocks").alias("blocks"),
        F.coalesce(F.sum(F.when(F.col("chosen") == 1, F.col("blocks"))), F.lit(0)).alias("blocks_read"),
    )


def search_blocks(
    queries: DataFrame,
    index: BlockIndex,
    k: int = TOP_K_RETRIEVAL,
    sent_words: int = SENT_WORDS,
    sent_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Best ``k`` documents per query by BM25, as shares of the query's best score; see ``bm25_search``."""
    search = _Search(queries, index, sent_words, sent_rows)
    first = stored(search.first(search.first_ranges(k)), "first-ranges")
    hits = stored(search.hits(first, k), "first-hits")
    more = search.hits(search.rest(first, hits, k), k)
    both = hits.unionByName(more).select("query_id", "segment_id", "raw_score", F.col("raw_score").alias("score"))
    best = F.max("raw_score").over(Window.partitionBy("query_id"))
    return top_k(both, k).select(
        "query_id",
        F.lit("text_sparse").alias("source"),
        "segment_id",
        "rank",
        "raw_score",
        (F.col("raw_score") / best).alias("score"),
    )
