"""Retrieval over several sources and weighted reciprocal-rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.operators.lexical import LexicalIndex, bm25_search
from reelgrid.operators.ranking import rounded, with_rank
from reelgrid.operators.vectors import vector_search
from reelgrid.schemas import COMPONENT, RRF_K, SOURCE_WEIGHTS, SOURCES, TOP_K_RETRIEVAL
from reelgrid.spreading import fits, stored

FUSED_DIGITS = 12
PAYLOAD = ("video_file", "start_time", "end_time", "text", "keyframe_path")
HIT = ("query_id", "source", "segment_id", "rank", "score")


def _by_source(values: dict[str, float] | dict[str, int]) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.create_map(*pairs)[F.col("source")]


def retrieve(
    queries: DataFrame,
    index: LexicalIndex | DataFrame | None,
    query_vectors: dict[str, DataFrame],
    vectors: dict[str, DataFrame],
    k: int = TOP_K_RETRIEVAL,
) -> DataFrame:
    """Up to five ranked lists per query, each cut at ``k``: the lexical one and one per vector source.

    A source without a table gives no list; a query without a vector for a source gets none there.
    The dense text scores are the only ones not clamped to [0, 1].
    """
    lists = []
    if index is not None:
        lists.append(bm25_search(queries, index, k).select(*HIT))
    for source in SOURCES:
        if source in query_vectors and source in vectors:
            found = vector_search(
                query_vectors[source], vectors[source], source, k, clamp=source != "text_dense"
            )
            lists.append(found.select(*HIT))
    if not lists:
        nothing = F.lit(None)
        kinds = {"query_id": queries.schema["query_id"].dataType, "source": "string", "segment_id": "string"}
        kinds |= {"rank": "int", "score": "double"}
        return queries.limit(0).select(*[nothing.cast(kinds[c]).alias(c) for c in HIT])
    return reduce(DataFrame.unionByName, lists)


def attach_segments(hits: DataFrame, segments: DataFrame) -> DataFrame:
    """Metadata of the hit segments; unknown ids get empty values.

    The segments are cut to the hit ids where they are read, before any of them is shuffled: the ids
    are stored, counted, and sent when their number is bounded. Stored segments are looked up by their
    key, and their own id comes along as ``display_id``.
    """
    hits = stored(hits, "hits")
    wanted = hits.select("segment_id").distinct()
    if fits(wanted):
        wanted = F.broadcast(wanted)
    if "segment_key" in segments.columns:
        described = segments.select(F.col("segment_key").alias("segment_id"), F.col("segment_id").alias("display_id"), *PAYLOAD)
    else:
        described = segments.select("segment_id", *PAYLOAD)
    few = described.join(wanted, "segment_id", "left_semi")
    found = hits.join(few, "segment_id", "left")
    return found.fillna("", ["video_file", "text", "keyframe_path"]).fillna(0.0, ["start_time", "end_time"])


def rrf_fuse(
    hits: DataFrame, weights: dict[str, float] = SOURCE_WEIGHTS, rrf_k: int = RRF_K, k: int | None = None
) -> DataFrame:
    """One list per query from its ranked lists, by weighted reciprocal rank.

    Weights are shares of the lists that returned rows for the query. ``hits`` are lists cut by the
    searches, so the window over one query sees at most the retrieval depth times the sources. Ties
    keep the order in which segments are first met, list by list.
    """
    order = {source: i for i, source in enumerate(weights)}
    of_query = Window.partitionBy("query_id")
    weighted = hits.withColumn("_w", _by_source(weights)).withColumn("_list", _by_source(order))
    shares = F.array(*[F.lit(float(w)) for w in weights.values()])
    present = F.sort_array(F.collect_set("_list").over(of_query))  # a list counts also without its first row
    weighted = weighted.withColumn("_total", F.aggregate(present, F.lit(0.0), lambda t, i: t + F.get(shares, i)))
    share = F.col("_w") / F.col("_total") / (F.lit(rrf_k) + F.col("rank"))
    payload = [c for c in PAYLOAD if c in hits.columns]
    place = F.struct("_list", "rank")
    aggregates = [
        F.sum(share).alias("score"),
        F.min(place).alias("_first"),
        *[
            F.max(F.when(F.col("source") == source, F.greatest(F.col("score"), F.lit(0.0)))).alias(COMPONENT[source])
            for source in weights
        ],
    ]
    if payload:
        # the last list with text for the segment wins, otherwise the first one that has it
        has_text = (F.coalesce("text", F.lit("")) != "") if "text" in payload else F.lit(False)
        sign = F.when(has_text, F.lit(1)).otherwise(F.lit(-1))
        choice = F.struct(has_text, sign * F.col("_list"), sign * F.col("rank"))
        aggregates.append(F.max_by(F.struct(*payload), choice).alias("_payload"))
    fused = weighted.where(F.coalesce(F.col("segment_id").cast("string"), F.lit("")) != "")
    fused = fused.groupBy("query_id", "segment_id").agg(*aggregates)
    components = [COMPONENT[source] for source in weights]
    fused = fused.fillna(0.0, components)
    ordered = with_rank(fused, [rounded("score", FUSED_DIGITS).desc(), F.col("_first").asc(), F.col("segment_id")])
    if k is not None:
        ordered = ordered.where(F.col("rank") <= k)
    found_in = sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in components), F.lit(0))
    return ordered.select(
        "query_id",
        "segment_id",
        "rank",
        "score",
        *components,
        found_in.alias("num_sources"),
        *[F.col(f"_payload.{c}").alias(c) for c in payload],
    )
