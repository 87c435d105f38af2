"""Alignment by runs of cells of equal cover, for cells that are short against the items.

An item is two numbers, the first and the last cell that it touches. The edges of all items of a media
item cut its cells into runs in which the cover never changes; what the streams have is gathered once
per run, and only the finished rows are expanded to cells. An item of ten hours is one row per
``SPAN`` cells and per edge of other items inside it, however short the cells are.

Edges are kept per block of ``SPAN`` cells as one sorted array of distinct numbers, so no array exceeds
``SPAN`` + 1 entries; items find theirs by salted lookups, so a media item with most rows is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.operators.align import CELL, best_item, gathered, stream_spans, with_duration
from reelgrid.operators.grid import cell_count, cell_width
from reelgrid.spreading import SPAN, explode_span, lookup_join

RUN = ["media_id", "seg_from", "seg_to"]
_SLACK = 4  # cells on which the exact rule is asked around a rounded edge


def touched_range(spans: DataFrame, media: DataFrame, d: float) -> DataFrame:
    """Spans with ``_lo`` and ``_hi``, the first and last cell they overlap; spans that touch none go.

    The rule is that of the overlap join, open at both edges. Begun cells are followed by begun cells only
    and cells still going by cells gone only, so the cells between the two edges need not be asked.
    """
    timed = with_duration(spans, media, "pos")
    timed = timed.withColumns(
        {
            "_low": F.greatest(F.lit(0), F.floor(F.col("start") / d) - 1),
            "_high": F.least(F.ceil(F.col("_stop") / d), cell_count(d) - 1),
        }
    )

    def begun(cell: Column) -> Column:
        return F.col("start") < F.least((cell + 1) * F.lit(d), F.col("duration"))

    def going(cell: Column) -> Column:
        at = cell * F.lit(d)
        return F.when(F.col("_point"), F.col("start") >= at).otherwise(F.col("_stop") > at)

    first = [F.when(begun(F.col("_low") + i), F.col("_low") + i) for i in range(_SLACK)]
    last = [F.when(going(F.col("_high") - i), F.col("_high") - i) for i in range(_SLACK)]
    ranged = timed.withColumns({"_lo": F.coalesce(*first), "_hi": F.coalesce(*last)})
    return ranged.where("_lo <= _hi").drop("_low", "_high")


def _in_blocks(ranged: DataFrame) -> DataFrame:
    """Spans once per block they reach into, with their first and last cell in it."""
    blocks = F.sequence(F.floor(F.col("_lo") / SPAN), F.floor(F.col("_hi") / SPAN))
    parts = ranged.withColumn("_block", F.explode(blocks))
    return parts.withColumns(
        {
            "_from": F.greatest(F.col("_lo"), F.col("_block") * SPAN),
            "_to": F.least(F.col("_hi"), (F.col("_block") + 1) * SPAN - 1),
        }
    )


def _edges(parts: DataFrame) -> DataFrame:
    """``media_id, _block, _cuts``: where the cover changes, ascending and distinct.

    An item with a vector shares less with its first and last cell than with those between, so these two
    stand alone.
    """
    alone = F.when(F.col("has_embedding"), F.array(F.col("_lo") + 1, F.col("_hi")))
    edges = F.concat(F.array("_from", F.col("_to") + 1), F.coalesce(alone, F.array().cast("array<bigint>")))
    begin = F.col("_block") * SPAN
    inside = (F.col("_cut") >= begin) & (F.col("_cut") <= begin + SPAN)
    cuts = parts.select("media_id", "_block", F.explode(edges).alias("_cut")).where(inside)
    return cuts.groupBy("media_id", "_block").agg(F.sort_array(F.collect_set("_cut")).alias("_cuts"))


def cover_runs(media: DataFrame, d: float = 1.0, **streams: DataFrame) -> DataFrame:
    """``media_id, seg_from, seg_to`` and what the streams ``asr, audio, ocr, clips`` have for these cells.

    Every touched cell is in exactly one run. Columns and rules are those of the alignment per cell. Runs
    also end at every ``SPAN``-th cell. Media items without a duration and streams without rows have none.
    """
    d = cell_width(d)
    spans = None
    for kind, items in streams.items():
        for part in stream_spans(kind, items):
            spans = part if spans is None else spans.unionByName(part)
    parts = _in_blocks(touched_range(spans, media, d))
    cut = lookup_join(parts, _edges(parts), ["media_id", "_block"], ["kind", "pos"], how="inner")
    own = F.array_position("_cuts", F.col("_from"))
    many = (F.array_position("_cuts", F.col("_to") + 1) - own).cast("int")
    begins, ends = (F.slice("_cuts", (own + i).cast("int"), many) for i in (0, 1))
    runs = cut.withColumn("_run", F.explode(F.arrays_zip(begins.alias("a"), ends.alias("b"))))
    runs = runs.withColumns({"seg_from": F.col("_run.a"), "seg_to": F.col("_run.b") - 1})
    covered = runs.withColumn("_best", best_item(d, F.col("seg_from")))
    return gathered(covered, RUN, list(streams))


def expand_runs(runs: DataFrame) -> DataFrame:
    """Runs as rows per cell."""
    cells = explode_span(runs, F.col("seg_from"), F.col("seg_to"), "seg_idx")
    return cells.select(*CELL, *[c for c in runs.columns if c not in RUN])


def matched_by_runs(media: DataFrame, d: float, **streams: DataFrame) -> DataFrame:
    """What the streams have per touched cell, gathered by runs: a matcher for ``align``."""
    return expand_runs(cover_runs(media, d, **streams))
