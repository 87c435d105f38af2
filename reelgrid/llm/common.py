"""What the operators of this subpackage share: column access, tables written midway, Arrow maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from unicodedata import category

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.spreading import stored

__all__ = [
    "LETTERS", "NUMBERS", "ODD", "arrow_map", "boxed", "range_bounds", "range_of", "slices", "stored", "table", "texts",
]

_LATIN = [chr(c) for c in (*range(32, 127), *range(0xA1, 0x180)) if c != 0x130]
#: Letters and numbers up to Latin Extended-A as members of a character class, for the fast patterns;
#: and a pattern that finds any character outside that range and the common white space.
LETTERS = "".join(c for c in _LATIN if category(c)[0] == "L")
NUMBERS = "".join(c for c in _LATIN if category(c)[0] == "N")
ODD = r"[^\t\n\r -~\xa1-\u012f\u0131-\u017f]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Two columns only, ``doc_id`` and ``text``, whatever else the table holds; a null text is empty."""
    return docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )


def boxed(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``row, id, mark``: the caller's columns as one struct, the id, and a hash of the text (null: empty).

    Own columns added to a boxed table clash with none of the caller's, whatever their names.
    """
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_column).cast("bigint").alias("id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"),
    )


def slices(batch: pa.RecordBatch, column: str, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of ``column``, at least one row each."""
    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if held and held + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def arrow_map(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, by: str | None = None,
    limit: int = 8_000_000,
) -> DataFrame:
    """Map record batches; with ``by``, in pieces of about ``limit`` bytes of that text or binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, by, limit) if by else (batch,):
                yield work(piece)

    return df.mapInArrow(run, schema)


def range_bounds(ids: DataFrame, parts: int) -> list[int]:
    """At most ``parts - 1`` bounds that cut ``doc_id`` into ranges of about equal numbers of rows."""
    if parts < 2:
        return []
    cuts = ids.select(F.col("doc_id").cast("double")).approxQuantile(
        "doc_id", [i / parts for i in range(1, parts)], 0.2 / parts
    )
    return sorted({int(c) for c in cuts})


def range_of(bounds: list[int], column: Column) -> Column:
    """How many bounds are at most the id; a null id is in the first range."""
    if not bounds:
        return F.lit(0)
    ends = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    return F.coalesce(F.aggregate(ends, F.lit(0), lambda n, b: n + (b <= column).cast("int")), F.lit(0))
