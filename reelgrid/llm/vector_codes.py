"""Vectors as short codes: per part the nearest of a few entries, found with slices and masks.

Every entry of a part's codebook owns a bit. Per dimension the entries' coordinates are sorted, and each
place in that order carries the mask of all entries before it. The distance to one entry, the one next in
the widest dimension, is the initial radius: in each dimension the entries within it are one range, whose
mask is the difference of two prefix masks. The masks of all dimensions are ANDed; what is left holds every
entry within the radius, the nearest among them, and only these are measured exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import stored
from reelgrid.llm.integers import integer_vectors, matrix
from reelgrid.spreading import lookup_join

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
WORD = 64


class Slices:
    """Exact nearest entry of one codebook, whole numbers, ties to the lower index."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        many, width = entries.shape
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(entries, self.order, 0).T)
        bit = np.zeros((many, -(-many // WORD)), np.uint64)
        index = np.arange(many)
        bit[index, index // WORD] = np.uint64(1) << (index % WORD).astype(np.uint64)
        #: By dimension: masks of the first 0, 1, 2 ... entries in the order of their coordinates.
        self.prefix = [
            np.concatenate((np.zeros_like(bit[:1]), np.bitwise_or.accumulate(bit[self.order[:, j]], axis=0)))
            for j in range(width)
        ]
        self.widest = int(np.argmax(self.sorted[:, -1] - self.sorted[:, 0])) if width else 0

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """Masks of the entries that no dimension rules out."""
        place = np.searchsorted(self.sorted[self.widest], x[:, self.widest])
        near = self.order[np.minimum(place, len(self.entries) - 1), self.widest]
        first = ((x - self.entries[near]) ** 2).sum(axis=1)
        radius = np.sqrt(first.astype(np.float64)).astype(np.int64) + 1  # never below the true root
        mask = None
        for j, (line, prefix) in enumerate(zip(self.sorted, self.prefix, strict=True)):
            from_, to = np.searchsorted(line, x[:, j] - radius), np.searchsorted(line, x[:, j] + radius, "right")
            part = prefix[to] ^ prefix[from_]
            mask = part if mask is None else mask & part
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to each row's nearest entry."""
        best, index = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
        mask = self.candidates(x)
        for e, entry in enumerate(self.entries):
            at = np.flatnonzero(mask[:, e // WORD] >> np.uint64(e % WORD) & np.uint64(1))
            away = ((x[at] - entry) ** 2).sum(axis=1)
            less = away < best[at]
            best[at[less]], index[at[less]] = away[less], e
        return index, best


def assign(x: np.ndarray, books: list[Slices]) -> tuple[np.ndarray, np.ndarray]:
    """Codes, one column per part, and the sum of the squared distances."""
    width = x.shape[1] // len(books)
    codes, error = np.zeros((len(x), len(books)), np.int64), np.zeros(len(x), np.int64)
    for p, book in enumerate(books):
        codes[:, p], away = book.nearest(x[:, p * width : (p + 1) * width])
        error += away
    return codes, error


def _sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``part, entry, n, s0 ...``: how many parts fell to an entry and their componentwise sums."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Slices(b) for b in books]
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            _, x = matrix(batch.column("vec"), parts * width)
            codes, _ = assign(x, made)
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                order = np.argsort(codes[:, p], kind="stable")
                used, start = np.unique(codes[order, p], return_index=True)
                if len(used):
                    count[p, used] += np.diff(np.append(start, len(order)))
                    total[p, used] += np.add.reduceat(own[order], start, axis=0)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p), pa.array(e), pa.array(count[p, e]), *[pa.array(total[p, e, j]) for j in range(width)]], names
        )

    names = ["part", "entry", "n", *[f"s{j}" for j in range(width)]]
    each = rows.select("vec").mapInArrow(run, ", ".join(f"{c} bigint" for c in names))
    return each.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names[2:]])


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks as ``parts x entries x width`` whole numbers, from stored ``vec_id, vec``.

    They begin as the parts of the vectors with the smallest ids (ties in the order of their bytes) that
    are as wide as the first of these; fewer rows make fewer entries, and no id at all makes none. Only
    sums per part and entry reach the driver.
    """
    none = np.zeros((parts, 0, 0), np.int64)
    known = rows.where(F.col("vec_id").isNotNull()).select("vec_id", "vec")
    head = known.orderBy("vec_id", "vec").first()
    if head is None or not head["vec"] or len(head["vec"]) // 4 % parts:
        return none
    alike = known.where(F.length("vec") == len(head["vec"])).orderBy("vec_id", "vec").limit(entries).collect()
    seeds = np.frombuffer(b"".join(bytes(r["vec"]) for r in alike), "<i4").astype(np.int64)
    books = np.ascontiguousarray(seeds.reshape(len(alike), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        for r in _sums(rows, books).collect():
            books[r["part"], r["entry"]] = [s // r["n"] for s in r[3:]]  # whole-number division goes down
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of stored rows; both null where the width is not the codebooks'."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Slices(b) for b in books] if books.size else []
        for batch in batches:
            code, error = [None] * batch.num_rows, [None] * batch.num_rows
            if made:
                at, x = matrix(batch.column("vec"), parts * width)
                codes, away = assign(x, made)
                for i, c, e in zip(at.tolist(), codes.tolist(), away.tolist(), strict=True):
                    code[i], error[i] = "".join([f"{v:02x}" for v in c]), e
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())],
                ["vec_id", "label", "code", "error"],
            )

    return rows.mapInArrow(run, "vec_id bigint, label bigint, code string, error bigint")


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` per row with a usable vector.

    Rows whose vector is null or holds null or non-finite components go. Vectors of another width than
    that of the smallest id, empty ones, and widths that ``parts`` does not divide have no code and no
    error. Rows without an id are coded but no seeds; repeated rows are coded alike and each counts. Null
    labels are one label. ``label_error`` is null where it leaves 64 bits. An empty table gives no row.
    """
    rows = stored(integer_vectors(vectors, scale), "integer-vectors")
    books = learn(rows, parts, entries, rounds)
    coded = stored(encode(rows, books), "codes")
    keyed = coded.withColumns({"unlabelled": F.col("label").isNull(), "of": F.coalesce("label", F.lit(0))})
    sums = keyed.groupBy("unlabelled", "of").agg(F.try_sum("error").alias("label_error"))
    found = lookup_join(keyed, sums, ["unlabelled", "of"], ["vec_id", "code"])
    return found.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
