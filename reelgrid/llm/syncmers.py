"""Document fingerprints from closed syncmers, in DataFrame operations only.

A text's tokens are runs of at most 12 letters or digits and single other signs. Of ``K`` tokens in a
row, the inner substrings are the runs of ``S`` tokens; the row is a closed syncmer, an anchor, when the
least hash of them stands at its first or last place. That depends on the row alone, not on what is
around it, so equal passages give equal anchors at corresponding positions. A fingerprint holds the
distinct anchor hashes below a threshold, ``SKETCH`` at least where there are so many, 8 hex digits each, so
it grows with the text. The likeness of two fingerprints is the Jaccard similarity of their hashes below the
lower of the two bounds up to which they are complete, which estimates that of all anchors. The aligned
likeness counts of the shared hashes those whose first places lie at a difference of positions that another
one has, too: passages, not single rows of tokens met by chance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgrid.llm.common import range_bounds, range_of
from reelgrid.llm.lines import bind

K, S, SKETCH = 4, 2, 64
BELOW = 1 << 29  # of 32-bit hashes: one in eight
TOKEN = r"[\p{L}\p{N}]{1,12}|[^\p{L}\p{N}\s]"


def anchors(text: Column) -> Column:
    """Array of ``(pos, hash)``: the first token of each anchor, and its 32-bit hash.

    A text with tokens but no syncmer has one anchor of the whole text at 0; one without tokens has none.
    """

    def pick(inner: Column) -> Column:
        last = K - S

        def at(i: Column, j: int) -> Column:
            return F.get(inner, i + j)

        def closed(row: Column) -> Column:
            x, i = row["h"], row["i"]
            end = at(i, last)
            first = x <= end
            for j in range(1, last):
                first = first & (x <= at(i, j))
            other = end <= x
            for j in range(1, last):
                other = other & (end <= at(i, j))
            return first | other

        rows = F.transform(inner, lambda h, i: F.struct(i.alias("i"), h.alias("h")))
        chosen = F.filter(F.slice(rows, 1, F.greatest(F.size(rows) - last, F.lit(0))), closed)
        return F.transform(
            chosen,
            lambda r: F.struct(
                r["i"].alias("pos"),
                F.shiftrightunsigned(F.xxhash64(r["h"], *[at(r["i"], j) for j in range(S, last + 1)]), 32).alias("hash"),
            ),
        )

    def inner(hashes: Column) -> Column:
        many = F.slice(hashes, 1, F.greatest(F.size(hashes) - (S - 1), F.lit(0)))
        return F.transform(many, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, S)]))

    def whole(hashes: Column) -> Column:
        one = F.struct(F.lit(0).alias("pos"), F.shiftrightunsigned(F.xxhash64(hashes), 32).alias("hash"))
        found = bind(inner(hashes), pick)
        return bind(found, lambda f: F.when((F.size(f) > 0) | (F.size(hashes) == 0), f).otherwise(F.array(one)))

    tokens = F.regexp_extract_all(text, F.lit(TOKEN), 0)
    return bind(F.transform(tokens, lambda t: F.xxhash64(t)), whole)


def distinct(found: Column) -> Column:
    """Array of ``(hash, pos)`` of the distinct anchors, ascending, each at its first place."""
    ordered = F.array_sort(F.transform(found, lambda a: F.struct(a["hash"].alias("hash"), a["pos"].alias("pos"))))
    return bind(ordered, lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["hash"] != x["hash"])))


def sketch(own: Column) -> Column:
    """Of the distinct anchors those with a hash below the threshold, or the ``SKETCH`` least, ascending."""
    return F.slice(own, F.lit(1), F.greatest(F.lit(SKETCH), F.size(F.filter(own, lambda a: a["hash"] < BELOW))))


def shown(sketched: Column) -> Column:
    return F.array_join(F.transform(sketched, lambda a: F.lower(F.lpad(F.hex(a["hash"]), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """``(near, aligned)`` of distinct anchors: Jaccard similarity, and that of the aligned ones, 0 to 1.

    Two texts without anchors are alike; one with and one without are not. A lone shared anchor counts as
    aligned only where a text has no other.
    """

    def sided(own: Column, side: int) -> Column:
        return F.transform(own, lambda x: F.struct(x["hash"].alias("hash"), F.lit(side).alias("side"), x["pos"].alias("pos")))

    def shift(both: Column) -> Column:
        def of(x: Column, i: Column) -> Column:
            after = F.get(both, i + 1)
            return F.when(after["hash"] == x["hash"], x["pos"] - after["pos"])

        return F.sort_array(F.filter(F.transform(both, of), lambda d: d.isNotNull()))

    def judged(shifts: Column) -> Column:
        union = F.size(a) + F.size(b) - F.size(shifts)
        alone = F.least(F.size(a), F.size(b)) == 1
        runs = F.filter(shifts, lambda d, i: alone | (F.get(shifts, i - 1) == d) | (F.get(shifts, i + 1) == d))
        none = union == 0
        return F.struct(
            F.when(none, F.lit(1.0)).otherwise(F.size(shifts) / union).alias("near"),
            F.when(none, F.lit(1.0)).otherwise(F.size(runs) / union).alias("aligned"),
        )

    return bind(bind(F.array_sort(F.concat(sided(a, 0), sided(b, 1))), shift), judged)


def complete_below(sketched: Column) -> Column:
    """The bound below which a fingerprint holds every anchor hash of its text."""
    last = F.get(sketched, F.size(sketched) - 1)["hash"] + 1
    return F.when(F.size(sketched) < SKETCH, F.lit(1 << 32)).otherwise(F.greatest(F.lit(BELOW), last))


def fingerprint_likeness(a: Column, b: Column) -> Column:
    """``(near, aligned)`` of two sketches, from their hashes below the bound up to which both are complete."""

    def below(bound: Column) -> Column:
        def kept(own: Column) -> Column:
            return F.filter(own, lambda x: x["hash"] < bound)

        return bind(F.struct(kept(a).alias("a"), kept(b).alias("b")), lambda x: likeness(x["a"], x["b"]))

    return bind(F.least(complete_below(a), complete_below(b)), below)


def with_next(own: DataFrame, ids: DataFrame, mine: Callable[[Column], Column], parts: int | None = None) -> DataFrame:
    """Each row with ``next_text`` and ``next_mine``, those of the next row in descending ``doc_id``.

    After the last comes the first. Ties are in the order of their texts, null ids come last. Rows are
    dealt by ranges of ids, whose bounds come from ``ids``; only the first text of each range is sent to
    the range before, where ``mine`` of it is made again.
    """
    parts = parts or int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(ids, parts)
    bucket = range_of(bounds, F.col("doc_id"))
    plain = ids.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    plain = plain.withColumn("bucket", bucket)
    falling = Window.orderBy(F.col("bucket").desc())
    tops = plain.groupBy("bucket").agg(F.max("doc_id").alias("top")).select(  # a row per range
        "bucket",
        "top",
        F.coalesce(
            F.lag("bucket").over(falling),
            F.min("bucket").over(falling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("before"),
    )
    at_top = plain.join(F.broadcast(tops.withColumnRenamed("bucket", "of")), (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top")))
    heads = at_top.groupBy("before").agg(F.min("text").alias("head_text"))
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    rowed = own.withColumn("bucket", bucket).select("*", F.lead(F.struct("text", "mine")).over(order).alias("next"))
    after = F.col("next")
    joined = rowed.join(F.broadcast(heads.withColumn("head_mine", mine(F.col("head_text")))), F.col("bucket") == F.col("before"), "left")
    return joined.select(
        "doc_id", "text", "mine",
        F.coalesce(after["text"], F.col("head_text")).alias("next_text"),
        F.coalesce(after["mine"], F.col("head_mine")).alias("next_mine"),
    )


def packed(sketched: Column) -> Column:
    """Each anchor of a sketch as one number, in the same order."""
    return F.transform(sketched, lambda a: F.shiftleft(a["hash"], 31).bitwiseOR(a["pos"].cast("bigint")))


def unpacked(numbers: Column) -> Column:
    return F.transform(
        numbers,
        lambda x: F.struct(F.shiftright(x, 31).alias("hash"), x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("pos")),
    )


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit, whose last half comes from the next document.

    One row per row of ``docs``: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next`` and the aligned likenesses. A null text is empty; texts without tokens have an empty
    fingerprint, which is like another empty one only. Texts are taken whole, however long. Rows of one id, and
    null ids, which come last, are in the order of their texts; repeated rows follow each other. A single
    row is its own next. Other columns are left out, whatever their names. An empty table gives no row.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def found(text: Column) -> Column:
        return bind(distinct(anchors(text)), sketch)

    # Anchors are made before the rows are sorted, so that the next row's come with it.
    paired = with_next(own.withColumn("mine", packed(found(F.col("text")))), docs, lambda text: packed(found(text)))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))

    def compared(x: Column) -> Column:
        return F.struct(
            shown(x["mine"]).alias("fingerprint"),
            shown(x["changed"]).alias("edited_fingerprint"),
            fingerprint_likeness(x["mine"], x["changed"]).alias("edited"),
            fingerprint_likeness(x["mine"], x["after"]).alias("next"),
        )

    sides = F.struct(
        unpacked(F.col("mine")).alias("mine"), found(edited).alias("changed"), unpacked(F.col("next_mine")).alias("after")
    )
    both = paired.select(
        "doc_id", n.cast("bigint").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"),
        bind(sides, compared).alias("found"),
    )
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("found.fingerprint").alias("fingerprint"),
        F.col("found.edited_fingerprint").alias("edited_fingerprint"),
        F.col("found.edited.near").alias("near_edited"),
        F.col("found.next.near").alias("near_next"),
        F.col("found.edited.aligned").alias("aligned_edited"),
        F.col("found.next.aligned").alias("aligned_next"),
    )
