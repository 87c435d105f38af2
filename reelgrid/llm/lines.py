"""Line dedup by winnowing over line hashes, in DataFrame operations only.

The lines of a document that are not blank are its units. A run of consecutive units qualifies when it
has ``run`` units or ``min_words`` words; a unit is deleted when it lies in a qualifying run that occurs
earlier, in a smaller ``doc_id`` or further up in the same text. Each unit opens the shortest qualifying
run that starts with it; of each such window the line with the least hash is selected as a fingerprint.
Any repeated qualifying run holds such a window, so both copies select the same line. Fingerprints
that occur once drop out in an aggregate of bare hashes. Around the others, the windows that start at a
unit and those that end at a unit extend the match both ways: their union is exactly all repeated runs.
Only the first occurrence of a window is looked up, so groups of copies cost their size, not its square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import boxed, stored

RUN = 3
MIN_WORDS = 50


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` looks at it for every element."""
    return F.transform(F.array(value), use)[0]


def _units(text: Column) -> Column:
    """Position, two hashes and words of each line that is not blank."""
    numbered = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("p"), F.trim(line).alias("t")))
    return F.transform(
        F.filter(numbered, lambda u: u["t"] != ""),
        lambda u: F.struct(
            u["p"].alias("p"),
            F.xxhash64(u["t"]).alias("a"),
            F.xxhash64(u["t"], F.lit(1)).alias("b"),
            F.size(F.split(u["t"], " +")).alias("w"),
        ),
    )


def _windows(units: Column, run: int, min_words: int) -> Column:
    """Windows ``(s, n, opens, anchor, at, k1, k2)`` over units: the shortest qualifying ones from and to each unit.

    ``anchor`` is the least line hash of the shortest window from ``s``, ``at`` its place there, ``opens``
    whether this is that window; ``k1, k2`` hash the content.
    """

    def build(us: Column) -> Column:
        def length(at: Callable[[Column], Column]) -> Column:
            """Fewest units that qualify, of those that ``at(n)`` cuts out; null if none do."""
            enough = F.filter(
                F.sequence(F.lit(1), F.lit(run)),
                lambda n: (F.size(at(n)) == n)
                & ((n == run) | (F.aggregate(at(n), F.lit(0), lambda total, u: total + u["w"]) >= min_words)),
            )
            return F.get(enough, F.lit(0))

        def forward(i: Column) -> Column:
            return length(lambda n: F.slice(us, i + 1, n))

        def backward(i: Column) -> Column:
            return length(lambda n: F.when(n <= i + 1, F.slice(us, i + 2 - F.least(n, i + 1), n)).otherwise(F.array()))

        starts = F.transform(us, lambda u, i: F.struct(i.alias("s"), forward(i).alias("n")))
        ends = F.transform(us, lambda u, i: bind(backward(i), lambda n: F.struct((i + 1 - n).alias("s"), n.alias("n"))))
        both = F.filter(F.array_distinct(F.concat(starts, ends)), lambda x: x["n"].isNotNull())

        def least(part: Column) -> Column:
            return F.array_min(F.transform(part, lambda u, j: F.struct(u["a"].alias("a"), j.alias("j"))))

        return F.transform(
            both,
            lambda x: bind(
                F.slice(us, x["s"] + 1, x["n"]),
                lambda part: bind(
                    F.struct(forward(x["s"]).alias("n")),
                    lambda f: bind(
                        least(F.slice(part, F.lit(1), f["n"])),
                        lambda low: F.struct(
                            x["s"].alias("s"),
                            x["n"].alias("n"),
                            (x["n"] == f["n"]).alias("opens"),
                            low["a"].alias("anchor"),
                            low["j"].alias("at"),
                            F.xxhash64(F.transform(part, lambda u: u["a"])).alias("k1"),
                            F.xxhash64(F.transform(part, lambda u: u["b"])).alias("k2"),
                        ),
                    ),
                ),
            ),
        )

    return bind(units, build)


def repeated(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, version, deleted``: sorted line positions to delete, for rows that have any.

    ``version`` hashes the text: rows that repeat an id with other texts are told apart, and equal rows
    are answered alike. Rows with a null id take no part.
    """
    own = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    units = stored(
        own.select("doc_id", F.xxhash64("text").alias("version"), _units(F.col("text")).alias("units")), "line-units"
    )
    windows = stored(
        units.select("doc_id", "version", F.inline(_windows(F.col("units"), run, min_words))), "line-windows"
    )
    # A selected line counts once per place: windows of both kinds share the window from their start.
    selected = windows.where("opens").select("anchor", "doc_id", "version", F.col("s") + F.col("at")).distinct()
    often = selected.groupBy("anchor").count().where("count > 1").select("anchor")
    likely = windows.join(often, "anchor", "left_semi")
    first = (
        likely.groupBy("k1", "k2")
        .agg(F.min(F.struct("doc_id", "version", "s")).alias("first"), F.count(F.lit(1)).alias("c"))
        .where("c > 1")
    )
    later = likely.join(first, ["k1", "k2"]).where(F.struct("doc_id", "version", "s") > F.col("first"))
    places = later.select("doc_id", "version", F.explode(F.sequence("s", F.expr("s + n - 1"))).alias("i")).distinct()
    gone = places.groupBy("doc_id", "version").agg(F.collect_set("i").alias("is"))
    lines = units.select("doc_id", "version", F.col("units.p").alias("ps")).dropDuplicates(["doc_id", "version"])
    return gone.join(lines, ["doc_id", "version"]).select(
        "doc_id",
        "version",
        F.array_sort(bind(F.col("ps"), lambda ps: F.transform("is", lambda i: ps[i]))).alias("deleted"),
        F.size("ps").alias("n_units"),
    )


def dedup_lines(
    docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, counts: bool = False, drop_emptied: bool = False
) -> DataFrame:
    """``docs`` with later repeated runs deleted from ``text``; ``n_chars`` follows, where there is one.

    A text all of whose units go becomes empty; other texts without a repeat, null texts and rows with a
    null id stay as they are. With ``counts``, a last column ``__deleted`` tells how many lines went; with
    ``drop_emptied``, texts that lost all their units go. Other columns stay, whatever their names.
    """
    own = docs.columns
    gone = repeated(docs, run, min_words).withColumnsRenamed({"doc_id": "id", "version": "mark"})

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("deleted"))
        return F.array_join(F.transform(kept, lambda i: lines[i]), "\n")

    old = F.col("row").getField("text")
    new = (
        F.when(F.col("deleted").isNull(), old)
        .when(F.size("deleted") == F.col("n_units"), F.lit(""))
        .otherwise(bind(F.split(old, "\n"), rest))
    )
    joined = boxed(docs).join(gone, ["id", "mark"], "left").select("row", "deleted", new.alias("left"))
    if drop_emptied:
        joined = joined.where(F.col("deleted").isNull() | (F.col("left") != ""))
    columns = []
    for c in own:
        was = F.col("row").getField(c)
        if c == "text":
            was = F.col("left")
        elif c == "n_chars":
            was = F.when(F.col("deleted").isNull(), was).otherwise(F.length("left").cast(docs.schema["n_chars"].dataType))
        columns.append(was.alias(c))
    if counts:
        columns.append(F.coalesce(F.size("deleted"), F.lit(0)).alias("__deleted"))
    return joined.select(*columns)
