"""Query tables: fan-out to modalities, enrichment, stored model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.functions.text import non_empty, strip
from reelgrid.schemas import ANALYSIS, QUERY_TYPES

FENCED = r"(?s)```(?:json)?\s*(.*?)```"
BRACES = r"(?s)(\{.*\})"
SUB_QUERIES = ("visual", "temporal", "audio", "ocr", "text")


def fan_out_queries(queries: DataFrame) -> DataFrame:
    """Fill empty sub-queries: visual, temporal and text from the original, audio and ocr stay empty.

    A query without any analysis (column ``analyzed`` false, or without that column all sub-queries
    null) uses the original for every modality.
    """
    original = F.col("original_query")
    unanalyzed = (
        ~F.col("analyzed")
        if "analyzed" in queries.columns
        else F.coalesce(*[F.col(f"{name}_query") for name in SUB_QUERIES]).isNull()
    )

    def own_or(name: str, fallback: Column) -> Column:
        own = non_empty(F.col(f"{name}_query"))
        return F.when(unanalyzed, original).otherwise(F.coalesce(own, fallback)).alias(f"{name}_query")

    kind = F.when(~unanalyzed & F.col("query_type").isin(*QUERY_TYPES), F.col("query_type")).otherwise("general")
    carried = [c for c in queries.columns if c not in {f"{n}_query" for n in SUB_QUERIES} | {"query_type", "analyzed"}]
    return queries.select(
        *carried,
        own_or("visual", original),
        own_or("temporal", original),
        own_or("audio", F.lit("")),
        own_or("ocr", F.lit("")),
        own_or("text", original),
        kind.alias("query_type"),
    )


def query_parts(fanned: DataFrame) -> DataFrame:
    """One row per query and modality that has something to search for."""
    parts = F.array(
        *[F.struct(F.lit(n).alias("modality"), F.col(f"{n}_query").alias("text")) for n in SUB_QUERIES]
    )
    return fanned.select("query_id", F.inline(parts)).where(F.col("text") != "")


def enrich_queries(
    queries: DataFrame, knowledge: DataFrame, knowledge_chars: int | None = None, snippet_chars: int | None = None
) -> DataFrame:
    """Add stored entity knowledge; entity queries carry it in their visual query.

    Whole texts are taken. A caller that wants no more than some characters of the knowledge, or of it
    in the visual query, asks for that.
    """

    def first(text: Column, chars: int | None) -> Column:
        return text if chars is None else F.substring(text, 1, chars)

    known = knowledge.select(
        "query_id", first(strip(F.col("knowledge")), knowledge_chars).alias("entity_knowledge")
    )
    joined = queries.drop("entity_knowledge").join(known, "query_id", "left")
    joined = joined.withColumn("entity_knowledge", F.coalesce("entity_knowledge", F.lit("")))
    snippet = F.concat(F.col("visual_query"), F.lit(". "), first(F.col("entity_knowledge"), snippet_chars))
    applies = (F.col("query_type") == "entity_specific") & (F.col("entity_knowledge") != "")
    return joined.withColumn("visual_query", F.when(applies, snippet).otherwise(F.col("visual_query")))


def _json_object(response: Column) -> Column:
    fenced = F.regexp_extract(response, FENCED, 1)
    body = F.when(response.rlike(FENCED), fenced).otherwise(response)
    return F.regexp_extract(body, BRACES, 1)


def parse_analysis(responses: DataFrame) -> DataFrame:
    """Analyzed queries from stored responses; undecodable ones fall back to the original query."""
    options = {"columnNameOfCorruptRecord": "broken"}
    schema = ANALYSIS.simpleString()[len("struct<") : -1] + ",broken:string"
    parsed = F.from_json(_json_object(F.col("response")), f"struct<{schema}>", options)
    rows = responses.select("query_id", "original_query", parsed.alias("a"))
    analyzed = rows.select(
        "query_id",
        "original_query",
        *[F.col(f"a.{name}_query").alias(f"{name}_query") for name in SUB_QUERIES],
        F.coalesce("a.entities", F.array().cast("array<string>")).alias("entities"),
        F.col("a.query_type").alias("query_type"),
        (F.col("a").isNotNull() & F.col("a.broken").isNull()).alias("analyzed"),
    )
    return fan_out_queries(analyzed)


def parse_rating_lists(responses: DataFrame) -> DataFrame:
    """``(query_id, segment_id, rating)`` from stored JSON arrays of ``{id, score}``; no score counts as 0.

    The last entry of an id counts. An undecodable response rates nothing.
    """
    text = strip(F.col("response"))
    fenced = F.regexp_extract(text, r"(?s)^```(?:json)?(.*)```$", 1)
    body = F.when(text.startswith("```"), fenced).otherwise(text)
    items = F.from_json(body, "array<struct<id:string,score:double>>")
    entries = responses.select("query_id", F.posexplode(items).alias("nth", "item"))
    return (
        entries.where(F.col("item.id").isNotNull())
        .groupBy("query_id", F.col("item.id").alias("segment_id"))
        .agg(F.max_by(F.coalesce("item.score", F.lit(0.0)), "nth").alias("rating"))
    )


def parse_rating_numbers(responses: DataFrame) -> DataFrame:
    """The first run of digits in a response, as a percentage limited to [0, 1]; none gives no rating."""
    digits = non_empty(F.regexp_extract("response", r"([0-9]+)", 1))
    share = F.least(F.lit(1.0), digits.cast("double") / 100.0)
    return responses.withColumn("rating", F.when(digits.isNotNull(), share))
