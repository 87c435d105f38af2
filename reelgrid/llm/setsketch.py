"""Near-duplicates by SetSketch: registers that sketch a set, bands of them, a likelihood, a check.

Every shingle is a Poisson process whose points fall on random registers; a register keeps the least point
that falls on it, as the whole part of its negative logarithm, truncated at both ends. The registers of a
union are the maxima of the registers, and two of them are equal with about the probability that the
Jaccard similarity says. Texts that agree in a band of registers share a bucket.

Of a bucket every member meets one member only, its first in a random order, never all the others. The likelihood of similarity
and register order rules out most of these pairs, the rest are measured on the full sets. The links found
group the texts; what a bucket still holds apart is compared in blocks. There the distance to the first
member, which obeys the triangle inequality, rules out a member within the limit against one beyond twice
the limit, so a large group of near copies is not compared with what only met it by chance.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import arrow_map, stored, texts
from reelgrid.llm.simhash import components
from reelgrid.spreading import fits

REGISTERS = 128
BAND = 4  # registers; at similarity 0.85 all 32 bands differ with probability (1 - 0.85 ** 4) ** 32 < 1e-10
BANDS = REGISTERS // BAND
PLACE = 63 - (BANDS - 1).bit_length()
BASE, RATE, LAST = 1.001, 20.0, 65_535
DOUBT = 20.0  # a pair is ruled out at a likelihood e ** 20 times below the best
ROWS, WEIGHT = 512, 1_000_000  # rows and shingles of a block
SENT = 2_000_000  # row numbers, or pairs of them, that are sent to all tasks at most
STAR = 512  # pairs of one first member in a task
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(REGISTERS - 1)


# --- shingles and sketches --------------------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words met lately."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[word] = found
        return found


_words = _Words()


def shingles(text: str, size: int = 3) -> np.ndarray:
    """Distinct hashes of the word shingles, ascending; of fewer words the whole sequence is one."""
    found = text.encode().lower().split()  # A-Z and the six ASCII white-space characters only
    if not found:
        return np.zeros(0, np.uint64)
    words = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    size = min(size, len(found))
    many = len(found) - size + 1
    run = np.full(many, size, np.uint64)
    for j in range(size):
        run = mixed(run * _STEP + words[j : j + many])
    return np.unique(run)


def registers(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """One row of ``m`` registers per set; an empty set has zeros. ``m`` is a power of two."""
    sizes = np.array([len(s) for s in sets], np.int64)
    low = np.full((len(sets), m), np.inf)
    flat, bar = low.reshape(-1), np.full(len(sets), np.inf)
    base, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), sizes)
    at, step, many = np.zeros(len(base)), 0, 1
    while len(base):
        points = mixed(base[:, None] + np.arange(step + 1, step + many + 1, dtype=np.uint64) * _STEP)
        gaps = -np.log1p(-((points >> np.uint64(11)) * 2.0**-53)) / m
        places = at[:, None] + np.cumsum(gaps, axis=1)
        near = places < bar[owner][:, None]
        held = (points & np.uint64(m - 1)).astype(np.int64) + owner[:, None] * m
        np.minimum.at(flat, held[near], places[near])
        live = np.unique(owner)
        bar[live] = low[live].max(axis=1)
        at = places[:, -1]
        keep = at < bar[owner]
        base, owner, at, step = base[keep], owner[keep], at[keep], step + many
        many = min(32, 2 * many)
    with np.errstate(divide="ignore"):
        out = np.floor(1 + (np.log(RATE) - np.log(low)) / np.log(BASE))
    out[sizes == 0] = 0
    return np.clip(out, 0, LAST).astype("<u2")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets, from their sketches."""
    return np.maximum(a, b)


def sketches(docs: DataFrame, size: int = 3) -> DataFrame:
    """``row, doc_id, n, key, registers, text`` per row of ``docs``; ``key`` names the set, null if empty."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, size) for t in batch.column("text").to_pylist()]
        rows = registers(sets)
        keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("row"),
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(keys, pa.binary()),
                pa.array([r.tobytes() for r in rows], pa.binary()),
                batch.column("text"),
            ],
            ["row", "doc_id", "n", "key", "registers", "text"],
        )

    schema = "row bigint, doc_id bigint, n bigint, key binary, registers binary, text string"
    numbered = texts(docs).withColumn("row", F.monotonically_increasing_id())
    return arrow_map(numbered, work, schema, by="text")


def full_sets(sk: DataFrame, rows: DataFrame, size: int, further: tuple[str, ...] = ()) -> DataFrame:
    """``row, items`` and ``further`` columns: the sets of the named rows of stored sketches, made again from their texts.

    Up to ``SENT`` row numbers are sent to the tasks, so that only the texts wanted are moved.
    """
    kept = ["row", *further]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, size) for t in batch.column("text").to_pylist()]
        ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
        items = pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))
        sets = pa.ListArray.from_arrays(pa.array(ends), items)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), sets], [*kept, "items"])

    wanted = stored(rows.distinct(), "rows-wanted")
    own = sk.select(*kept, "text").join(_sent(wanted), "row", "left_semi")
    fields = "".join(f"{c} {sk.schema[c].dataType.simpleString()}, " for c in kept)
    return stored(arrow_map(own, work, f"{fields}items array<bigint>", by="text"), "full-sets")


def _sent(narrow: DataFrame) -> DataFrame:
    """Stored rows of a few numbers, sent to all tasks if they fit, so that what they meet is not moved."""
    return F.broadcast(narrow) if fits(narrow, SENT) else narrow


# --- likelihood of similarity -----------------------------------------------------------------------


def _above(x: np.ndarray) -> np.ndarray:
    """Probability that one register is greater, if a share ``x`` of the union makes it so."""
    return np.maximum(-np.log1p(-np.maximum(x, 0) * ((BASE - 1) / BASE)) / np.log(BASE), 1e-300)


def estimate(
    greater: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, bar: float, m: int = REGISTERS
) -> tuple[np.ndarray, np.ndarray]:
    """Likeliest similarity of two sets, and how much the log-likelihood falls at ``bar`` if that is above.

    ``greater`` and ``less`` count the registers in which the first set's are so; sizes are known.
    """
    u = n_a / (n_a + n_b)
    v, most = 1 - u, np.minimum(n_a, n_b) / np.maximum(n_a, n_b)

    def told(j: np.ndarray) -> np.ndarray:
        more, fewer = _above(u - v * j), _above(v - u * j)
        even = np.maximum(1 - more - fewer, 1e-300)
        return greater * np.log(more) + less * np.log(fewer) + (m - greater - less) * np.log(even)

    a, b = np.zeros_like(u), most.copy()
    for _ in range(40):  # concave: thirds
        third = (b - a) / 3
        lower = told(a + third) < told(b - third)
        a, b = np.where(lower, a + third, a), np.where(lower, b, b - third)
    best = (a + b) / 2
    fall = told(best) - told(np.minimum(bar, most))
    return best, np.where(best >= bar, 0.0, np.maximum(fall, 0.0))


def least_equal(bar: float, m: int = REGISTERS) -> int:
    """How many equal registers a pair of similarity ``bar`` has at least, but for a chance of ``e ** -DOUBT``."""
    if bar >= 1:
        return m
    for e in range(int(m * bar), 0, -1):
        x = e / m
        if m * (x * np.log(x / bar) + (1 - x) * np.log((1 - x) / (1 - bar))) > DOUBT:
            return e + 1
    return 0


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, bar: float) -> np.ndarray:
    """Which pairs of registers, row by row, may have a similarity of ``bar`` or more."""
    out = np.minimum(n_a, n_b) >= bar * np.maximum(n_a, n_b) - 1e-6
    out &= (a == b).sum(axis=-1) >= least_equal(bar)
    at = np.flatnonzero(out)
    greater, less = (a[at] > b[at]).sum(axis=-1), (a[at] < b[at]).sum(axis=-1)
    _, fall = estimate(greater, less, n_a[at].astype(float), n_b[at].astype(float), bar)
    out[at] = fall <= DOUBT
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), REGISTERS)


# --- buckets and their first members ----------------------------------------------------------------


def buckets(reps: DataFrame) -> DataFrame:
    """``band, first, row``: the members of each bucket of two or more, of equal buckets the lowest.

    The upper bits of ``band`` say which band it is, so the lowest band that two texts share is always kept.
    Members are dealt by bucket once, for the sums and for the join: nothing is summed or sent before.
    """
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.shiftleft(i.cast("bigint"), PLACE).bitwiseOR(
            F.shiftrightunsigned(F.xxhash64(F.substring(F.col("registers"), i * (2 * BAND) + 1, F.lit(2 * BAND))), 64 - PLACE)
        ),
    )
    members = reps.select("row", F.explode(bands).alias("band")).repartition("band")
    sums = members.groupBy("band").agg(
        F.count(F.lit(1)).alias("many"),
        F.min(F.struct(F.xxhash64("band", "row"), "row"))["row"].alias("first"),
        F.bit_xor(F.xxhash64("row")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("y"),
    )
    alike = sums.where("many > 1").groupBy("many", "x", "y").agg(F.min(F.struct("band", "first")).alias("one"))
    return members.join(alike.select("one.*"), "band").select("band", "first", "row")


def _paired(pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """``first, row, a, b`` of each of the stored pairs: what ``wide`` tells by ``row`` of its members, as structs.

    What is wide moves once: that of ``row`` once per pair, to blocks of about ``STAR`` pairs of one first
    member, and that of ``first`` once per block.
    """
    told = F.struct(*(c for c in wide.columns if c != "row"))
    blocks = stored(pairs.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("blocks")), "stars")
    block = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block")
    dealt = stored(pairs.join(blocks, "first").select("first", "row", block), "dealt-pairs")
    b = wide.select("row", told.alias("b")).join(_sent(dealt), "row")
    a = wide.select(F.col("row").alias("first"), told.alias("a")).join(_sent(blocks), "first")
    a = a.select("first", "a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return b.join(a, ["first", "block"]).select("first", "row", "a", "b")


def _measured(pairs: DataFrame, sk: DataFrame, reps: DataFrame, far: tuple[int, int], size: int) -> DataFrame:
    """``first, row, shared, n``: pairs that may reach the similarity ``far``, measured on the full sets.

    ``shared`` is the size of the intersection, ``n`` that of the union.
    """
    bar = far[0] / far[1]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = [batch.column(c).to_numpy() for c in ("n_a", "n_b")]
        fit = plausible(_matrix(batch.column("a")), _matrix(batch.column("b")), *sizes, bar)
        return batch.select(["first", "row"]).filter(pa.array(fit))

    sent = _paired(pairs, reps.select("row", "registers", "n")).select(
        "first", "row", F.col("a.registers").alias("a"), F.col("b.registers").alias("b"), F.col("a.n").alias("n_a"),
        F.col("b.n").alias("n_b"),
    )
    likely = stored(arrow_map(sent, work, "first bigint, row bigint"), "likely-pairs")
    sets = full_sets(sk, likely.select("row").union(likely.select("first")), size)
    x, y = F.col("a.items"), F.col("b.items")
    shared = F.size(F.array_intersect(x, y))
    measured = _paired(likely, sets).select("first", "row", shared.alias("shared"), (F.size(x) + F.size(y)).alias("n"))
    measured = measured.select("first", "row", "shared", (F.col("n") - F.col("shared")).alias("n"))
    return measured.where(F.lit(far[1]) * F.col("shared") >= F.lit(far[0]) * F.col("n"))


# --- what is left of a bucket -----------------------------------------------------------------------


def _dealt(left: DataFrame, rows: int, weight: int) -> DataFrame:
    """Copies of the members for the pairs of blocks that they are in: ``band, same, i, j`` name a pair.

    ``left`` has ``band, row, n, group, kind, own``; ``own`` marks members of the first member's group,
    which are not compared among themselves.
    """
    many = lambda own: F.ceil(F.greatest(F.sum(own.cast("int")) / rows, F.sum(F.when(own, F.col("n"))) / weight)).cast("int")
    sums = left.groupBy("band").agg(
        F.coalesce(many(F.col("own")), F.lit(0)).alias("blocks_own"),
        F.coalesce(many(~F.col("own")), F.lit(0)).alias("blocks"),
        F.count(F.lit(1)).alias("members"),
    )
    sized = left.join(stored(sums.where("blocks > 0 and members > 1"), "open-buckets"), "band")
    block = F.pmod(F.xxhash64("row"), F.when(F.col("own"), F.col("blocks_own")).otherwise(F.col("blocks"))).cast("int")
    span = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda same, i, j: F.struct(F.lit(same).alias("same"), i.alias("i"), j.alias("j"))
    there = sized.withColumn("block", block)
    mine = F.col("block")
    across = F.when(F.col("own"), F.transform(span(F.col("blocks")), lambda o: place(False, mine, o))).otherwise(
        F.concat(
            F.transform(span(F.col("blocks_own")), lambda s: place(False, s, mine)),
            F.transform(span(F.col("blocks")), lambda o: place(True, F.least(o, mine), F.greatest(o, mine))),
        )
    )
    return there.withColumn("at", F.explode(across)).select("band", "at.*", "block", "row", "group", "kind", "own")


def _settle(share: tuple[int, int]):
    """Links between the members of a pair of blocks that are in different groups, one tree of them."""

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        get = {c: table.column(c).to_numpy() for c in ("row", "group", "kind", "own", "block", "n", "i", "j")}
        regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), "<u2").reshape(len(table), REGISTERS)
        items = table.column("items")
        bar, i, j = share[0] / share[1], get["i"][:1], get["j"][:1]
        band = table.column("band")[0].as_py() >> PLACE
        if table.column("same")[0].as_py():
            left, right = np.flatnonzero(get["block"] == i), np.flatnonzero(get["block"] == j)
        else:
            left, right = np.flatnonzero(get["own"]), np.flatnonzero(~get["own"])
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        sets: dict[int, np.ndarray] = {}

        def held(x: int) -> np.ndarray:
            if x not in sets:
                sets[x] = np.sort(items[x].values.to_numpy())  # signed here
            return sets[x]

        found, enough = [], least_equal(bar)
        for start in range(0, len(left), 64):
            mine = left[start : start + 64]
            equal = regs[mine][:, None, :] == regs[right][None, :, :]
            many = equal.sum(axis=2)
            alike = many >= enough
            alike &= get["group"][mine][:, None] != get["group"][right][None, :]
            alike &= get["kind"][mine][:, None] + get["kind"][right][None, :] != 2
            a, b = np.nonzero(alike)
            here = equal[a, b].reshape(len(a), BANDS, BAND).all(axis=2).argmax(axis=1) == band  # once, not in each band
            a, b = a[here], b[here]
            order = np.argsort(-many[a, b], kind="stable")  # links first: what they join need not be measured
            a, b = mine[a[order]], right[b[order]]
            fit = plausible(regs[a], regs[b], get["n"][a], get["n"][b], bar)
            for x, y in zip(a[fit].tolist(), b[fit].tolist(), strict=True):
                r, s = root(int(get["group"][x])), root(int(get["group"][y]))
                if r == s:
                    continue
                one, other = held(x), held(y)
                shared = int((one[np.minimum(np.searchsorted(one, other), len(one) - 1)] == other).sum())
                if share[1] * shared >= share[0] * int(get["n"][x] + get["n"][y] - shared):
                    up[max(r, s)] = min(r, s)
                    found.append((int(get["group"][x]), int(get["group"][y])))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return work


def _links_left(
    members: DataFrame, groups: DataFrame, measured: DataFrame, sk: DataFrame, share: tuple[int, int], size: int, rows: int,
    weight: int,
) -> DataFrame | None:
    """``a, b``: links between groups that only show between members neither of which is the first.

    ``kind`` is 0 for a member linked to the first, 2 for one beyond twice the limit, and 5 between; a sum
    of 2 is a pair that the triangle inequality rules out.
    """
    of = groups.select(F.col("node"), F.col("rep"))
    near = F.lit(share[1]) * F.col("shared") >= F.lit(share[0]) * F.col("n")
    kinds = measured.select("first", "row", F.when(near, 0).otherwise(5).alias("kind"))
    told = (
        members.where("row != first")
        .join(kinds, ["first", "row"], "left")
        .join(of.select(F.col("node").alias("row"), F.col("rep").alias("r")), "row", "left")
        .join(of.select(F.col("node").alias("first"), F.col("rep").alias("f")), "first", "left")
        .select(
            "band", "row", F.coalesce("kind", F.lit(2)).alias("kind"), F.coalesce("r", "row").alias("group"),
            F.coalesce("r", "row").eqNullSafe(F.coalesce("f", "first")).alias("own"),
        )
    )
    told = stored(told, "bucket-members")
    open_ = told.groupBy("band").agg(
        F.max((~F.col("own")).cast("int")).alias("apart"),
        F.max((~F.col("own") & (F.col("kind") == 5)).cast("int")).alias("between"),
    )
    left = told.join(open_.where("apart = 1").select("band", "between"), "band").where("not own or kind > 0 or between = 1")
    sizes = sk.select("row", "n")
    left = stored(left.join(sizes, "row").select("band", "row", "n", "group", "kind", "own"), "members-left")
    if left.isEmpty():
        return None
    sets = full_sets(sk, left.select("row"), size, ("n", "registers"))
    dealt = sets.join(_sent(stored(_dealt(left, rows, weight), "dealt-members")), "row")
    return dealt.groupBy("band", "same", "i", "j").applyInArrow(_settle(share), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, size: int = 3, share: tuple[int, int] = (85, 100), rows: int = ROWS, weight: int = WEIGHT
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``.

    Rows are linked where intersection over union of their distinct word shingles is ``share`` or more.
    ``component_id`` is the smallest ``doc_id`` reachable; null ids are passed over by the minimum, a group
    of null ids alone has none, and ``kept`` compares null-safely. Null, empty and wordless texts have an
    empty set and are linked with nothing. Repeated rows are answered alike. Other columns are left out,
    whatever their names. An empty table gives no row.

    A link at the limit is missed with probability below 1e-8 (no common band, or a likelihood e ** 20 times
    too low), a closer one with less; nothing is linked without being measured.
    """
    sk = stored(sketches(docs, size), "setsketches")
    sets = sk.where("n > 0").groupBy("key").agg(F.min("row").alias("row"), F.min("doc_id").alias("least"))
    reps = stored(sets.join(sk.select("row", "n", "registers"), "row"), "distinct-sets")
    members = stored(buckets(reps), "bucket-rows")
    stars = stored(members.where("row != first").select("first", "row").distinct(), "star-pairs")
    far = (max(0, 2 * share[0] - share[1]), share[1])  # at twice the distance
    measured = stored(_measured(stars, sk, reps, far, size), "measured-pairs")
    links = measured.where(F.lit(share[1]) * F.col("shared") >= F.lit(share[0]) * F.col("n"))
    groups = components(links, "first", "row")
    more = _links_left(members, groups, measured, sk, share, size, rows, weight)
    group = F.coalesce("rep", "row")
    named = reps.join(groups.withColumnRenamed("node", "row"), "row", "left").select("key", "least", group.alias("group"))
    if more is not None:
        further = components(more, "a", "b").select(F.col("node").alias("group"), F.col("rep").alias("further"))
        named = named.join(further, "group", "left").select("key", "least", F.coalesce("further", "group").alias("group"))
    named = stored(named, "named-sets")
    lowest = named.groupBy("group").agg(F.min("least").alias("component_id"))
    found = named.join(lowest, "group").select("key", "component_id")
    out = sk.where("n > 0").select("doc_id", "n", "key").join(found, "key").select("doc_id", "n", "component_id")
    out = out.unionByName(sk.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
