"""Helpers that keep work evenly spread: size-checked broadcasts, salted lookups, bounded explodes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 16
SPAN = 4096  # longest array any explode builds
BROADCAST_ROWS = 1_000_000


def tasks_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """A number of partitions that adaptive execution leaves as it is: one per core, or more of ``per_task`` rows each.

    For steps whose memory grows with their rows, while the bytes that come in, by which partitions are
    coalesced, say little about it.
    """
    return max(spark.sparkContext.defaultParallelism, -(-rows // per_task))


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than that many plus one."""
    return df.limit(max_rows + 1).count() <= max_rows


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """Join facts to a lookup whose keys may be hot on the facts side.

    The join key carries a salt, so one hot key is cut over ``salts`` partitions, and the result is
    not partitioned by ``on`` alone: a following aggregate on finer keys shuffles again instead of
    inheriting the hot partition, which also leaves adaptive skew splitting free to act. Small
    lookups are broadcast by the planner from its own size estimate; a sent lookup holds ``salts``
    copies, so at most ``salts`` times the planner's threshold.
    """
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def explode_span(df: DataFrame, lo: Column, hi: Column, out: str) -> DataFrame:
    """One row per integer in ``[lo, hi]``, through blocks so that no array exceeds ``SPAN``."""
    return (
        df.withColumns({"_lo": lo.cast("bigint"), "_hi": hi.cast("bigint")})
        .where("_lo <= _hi")
        .withColumn("_block", F.explode(F.expr(f"sequence(_lo div {SPAN}, _hi div {SPAN})")))
        .withColumn(
            out,
            F.explode(
                F.expr(f"sequence(greatest(_lo, _block * {SPAN}), least(_hi, _block * {SPAN} + {SPAN - 1}))")
            ),
        )
        .drop("_lo", "_hi", "_block")
    )


def explode_count(df: DataFrame, count: Column, key: str, out: str) -> DataFrame:
    """One row per integer in ``[0, count)``; blocks of one long item are spread over tasks first.

    The number of partitions is given, as the few rows before the explode would be coalesced to one.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        df.withColumn("_n", count.cast("bigint"))
        .where("_n > 0")
        .withColumn("_block", F.explode(F.expr(f"sequence(0, (_n - 1) div {SPAN})")))
        .repartition(partitions, key, "_block")
        .withColumn(
            out, F.explode(F.expr(f"sequence(_block * {SPAN}, least(_n, (_block + 1) * {SPAN}) - 1)"))
        )
        .drop("_n", "_block")
    )


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` only when a scan has fewer splits than the session has cores.

    Only the number of splits is asked for; large inputs are left as they are.
    """
    if df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is not set, a local session gets one temporary folder of its own and a cluster an error;
    the setting itself is never written.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="reelgrid-")
    return _LOCAL[context.applicationId]


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/reelgrid/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in this application's part of the shared folder."""
    return f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several later steps read to the shared folder, and read it back.

    The files belong to the application: whoever has written the final result calls ``clear_scratch``.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder and what is in it; false where there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def clear_scratch(spark: SparkSession) -> bool:
    """Delete all that this application has stored midway; results read from it must be written before."""
    return remove(spark, _scratch(spark))
