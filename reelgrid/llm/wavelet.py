"""Token ids as wavelet-matrix shards: one compressed file per shard, rank and select on its bit-planes.

A shard is one Parquet file; its rows are blocks of about ``BLOCK`` tokens in ascending ``doc_id``
order. A block holds, from the highest bit of an id to the lowest, one plane of bits in the order left
by a stable partition on all higher planes, the number of zeros of each plane, and the count of ones
before every 512 bits. Access, rank and select walk the planes, so one block answers "which token is
at i", "how often does t occur before i" and "where is the j-th t" without decoding the rest.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from reelgrid.llm.common import LETTERS, NUMBERS, ODD, arrow_map, range_bounds, range_of, texts

BLOCK = 1 << 19
STEP = 512
BLOCKS = (
    "shard int, block int, shard_start bigint, n_tokens bigint, doc_ids array<bigint>, doc_tokens array<bigint>,"
    " zeros array<bigint>, planes array<binary>, ranks array<binary>"
)


class WaveletMatrix:
    """Bit-planes of a sequence of non-negative integers."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]) -> None:
        self.n, self.zeros = n, zeros
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, np.uint32) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        depth = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        zeros, planes, ranks = [], [], []
        for k in range(depth - 1, -1, -1):
            ones = (ids >> k & 1).view(bool) if ids.dtype == np.uint8 else (ids >> k & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            padded = np.zeros(-(-len(packed) // (STEP // 8)) * (STEP // 8), np.uint8)
            padded[: len(packed)] = packed
            per_step = np.bitwise_count(padded.view(np.uint64)).reshape(-1, STEP // 64).sum(axis=1, dtype=np.uint32)
            rank = np.zeros(len(per_step) + 1, np.uint32)
            np.cumsum(per_step, out=rank[1:])
            zeros.append(len(ids) - int(rank[-1]))
            planes.append(packed.tobytes())
            ranks.append(rank.tobytes())
            ids = np.concatenate((ids.compress(~ones), ids.compress(ones)))
        return cls(len(ids), zeros, planes, ranks)

    def stored(self) -> tuple[list[int], list[bytes], list[bytes]]:
        return self.zeros, [p.tobytes() for p in self.planes], [r.tobytes() for r in self.ranks]

    def _ones(self, level: int, i: int) -> int:
        """Ones before position ``i`` of a plane."""
        step = i // STEP
        plane, at = self.planes[level], step * STEP // 8
        count = int(self.ranks[level][step]) + int(np.bitwise_count(plane[at : i // 8]).sum())
        return count + int(plane[i // 8] & ((1 << i % 8) - 1)).bit_count() if i % 8 else count

    def access(self, i: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            one = int(self.planes[level][i // 8]) >> i % 8 & 1
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if one else i - ones
            value = value << 1 | one
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` before ``i`` lie behind the last plane."""
        lo, hi = 0, i
        if value >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if value >> (len(self.planes) - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, value: int, i: int) -> int:
        """Occurrences of ``value`` before position ``i``."""
        lo, hi = self._range(value, i)
        return hi - lo

    def _place(self, level: int, one: bool, j: int) -> int:
        """Position of the ``j``-th one (or zero) of a plane, by bisection on the counts."""
        lo, hi = 0, self.n - 1
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(level, mid + 1)
            if (ones if one else mid + 1 - ones) > j:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def select(self, value: int, j: int) -> int:
        """Position of the ``j``-th occurrence (from 0) of ``value``; -1 when there are fewer."""
        lo, hi = self._range(value, self.n)
        if not 0 <= j < hi - lo:
            return -1
        i = lo + j
        for level in range(len(self.planes) - 1, -1, -1):
            one = i >= self.zeros[level]
            i = self._place(level, one, i - self.zeros[level] if one else i)
        return i

    def decode(self) -> np.ndarray:
        """The whole sequence: planes merged from the lowest up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for k, level in enumerate(range(len(self.planes) - 1, -1, -1)):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            merged, z = np.empty_like(out), self.zeros[level]
            merged[np.flatnonzero(~ones)] = out[:z]
            merged[np.flatnonzero(ones)] = out[z:] | kind(1 << k)
            out = merged
        return out


# --- encoding ---------------------------------------------------------------------------------------

#: Fixed value: the piece pattern of this kind of tokenizer, for lower-cased texts without odd characters.
_PIECES = f"[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+"
_WORDS, _CUT = 250_000, 150_000  # words and pieces remembered, twice that with the older ones
_LONG = 64  # characters; what is longer is not remembered
#: Bytes of white space, ASCII and two-byte characters that are all within the fast patterns' range.
_PLAIN = bytes([9, 10, 13, *range(32, 127), *range(0x80, 0xC0), 0xC3, 0xC5])


class _Cache:
    """Ids by text, made where they are new, of many at once; those in use come back from the older half."""

    def __init__(self, make: Callable[[pa.StringArray], pa.BinaryArray], size: int) -> None:
        self.make, self.size = make, size
        self.texts = self.older = pa.array([], pa.string())
        self.ids = self.older_ids = pa.array([], pa.binary())

    def __len__(self) -> int:
        return len(self.texts)

    def find(self, texts: pa.StringArray) -> pa.BinaryArray:
        """Ids of texts that are all different."""
        known = pa.concat_arrays([self.texts, self.older])
        at = pc.fill_null(pc.index_in(texts, value_set=known), len(known)).to_numpy().copy()
        new = at == len(known)
        at[new] += np.arange(np.count_nonzero(new), dtype=at.dtype)
        made = self.make(texts.filter(pa.array(new))) if new.any() else self.ids[:0]
        found = pa.concat_arrays([self.ids, self.older_ids, made]).take(pa.array(at))
        short = pc.less_equal(pc.utf8_length(texts), _LONG).to_numpy(zero_copy_only=False)
        kept = pa.array(np.flatnonzero((at >= len(self)) & short)[: self.size])
        if len(self) + len(kept) > self.size:
            self.older, self.older_ids = self.texts, self.ids
            self.texts, self.ids = self.texts[:0], self.ids[:0]
        self.texts = pa.concat_arrays([self.texts, texts.take(kept)])
        self.ids = pa.concat_arrays([self.ids, found.take(kept)])
        return found


def _joined(parts: pa.BinaryArray, counts: list[int] | np.ndarray) -> pa.BinaryArray:
    """So many of the parts after one another as one each."""
    if not len(parts):
        return pa.array([b""] * len(counts), pa.binary())
    ends = np.frombuffer(parts.buffers()[1], np.int32)[np.cumsum([0, *counts])]
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), parts.buffers()[2]])


class _PieceCache:
    """Ids per word; the library's model sees each new piece of a word once, as pieces never interact in it.

    Pieces hold no white space, so a text has the ids of its words. A text with a character outside the
    common Latin range, or with what may be a special token, goes through the library as a whole: there
    white space, letters and normal forms could differ from this shortcut's. The same holds for a
    tokenizer file of another kind.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype(f"<u{array(self.code).itemsize}")
        self.strange = re.compile(ODD + r"|<\|").search
        self.pieces = re.compile(_PIECES).findall
        self.words, self.cut = _Cache(self._words, _WORDS), _Cache(self._pieces, _CUT)
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = (b for b in range(256) if b not in set(own))
        self.byte_letters = str.maketrans(
            {chr(b): chr(b) for b in own} | {chr(b): chr(256 + i) for i, b in enumerate(rest)}
        )
        probe = "It's naïve, the 3rd\tÀß_x-y's'll: ..a_1b\n ÿ2²½ I'M we've d'd '' _a_ ¡no! z¼9"
        self.short = self._text(probe) == self._whole(probe)

    def odd(self, text: str) -> bool:
        if text.encode().translate(None, _PLAIN):
            return self.strange(text) is not None
        return "<|" in text

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _pieces(self, pieces: pa.StringArray) -> pa.BinaryArray:
        ids, many = array(self.code), [0]
        for piece in pieces.to_pylist():
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.byte_letters)
            ids.extend([t.id for t in self.tokenize(shown)])
            many.append(len(ids))
        ends = np.array(many, np.int32) * np.int32(ids.itemsize)
        return pa.Array.from_buffers(pa.binary(), len(pieces), [None, pa.py_buffer(ends), pa.py_buffer(ids.tobytes())])

    def _words(self, words: pa.StringArray) -> pa.BinaryArray:
        plain = pc.utf8_is_alpha(words)  # words of letters alone are one piece
        cut = [self.pieces(w) for w in words.filter(pc.invert(plain)).to_pylist()]
        pieces = pa.concat_arrays([words.filter(plain), pa.array(chain.from_iterable(cut), pa.string())])
        pieces = pieces.dictionary_encode()
        ids = self.cut.find(pieces.dictionary).take(pieces.indices)
        ids = _joined(ids, [1] * (len(words) - len(cut)) + list(map(len, cut)))
        order = np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return ids.take(pa.array(back))

    def _text(self, text: str) -> bytes:
        return self._texts(pa.array([text]), b"")[0].as_py()

    def _texts(self, texts: pa.StringArray, end: bytes) -> pa.BinaryArray:
        lines = pc.utf8_split_whitespace(pc.utf8_lower(texts))
        words, starts = lines.flatten().dictionary_encode(), lines.offsets.to_numpy()
        ids = pa.concat_arrays([self.words.find(words.dictionary), pa.array([end], pa.binary())])
        places = np.insert(words.indices.to_numpy(), starts[1:], len(ids) - 1)
        return _joined(ids.take(pa.array(places)), np.diff(starts) + 1)

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text]))[0].as_py()

    def encode_all(self, texts: pa.StringArray, end: bytes = b"") -> pa.BinaryArray:
        """Ids of each text with ``end`` behind them; a word is looked up once, however many texts hold it."""
        texts = texts.cast(pa.string())
        odd = pa.array([not self.short or self.odd(t) for t in texts.to_pylist()], pa.bool_())
        whole = [self._whole(t) + end for t in texts.filter(odd).to_pylist()]
        if len(whole) == len(texts):
            return pa.array(whole, pa.binary())
        coded = self._texts(pc.if_else(odd, "", texts), end)
        return pc.replace_with_mask(coded, odd, pa.array(whole, pa.binary())) if whole else coded


@lru_cache(maxsize=2)
def _coder(path: str) -> _PieceCache:
    return _PieceCache(path)


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """``doc_id, ids`` per row: token ids of the whole text and the end id, as little-endian integers.

    A null text is empty and gives the end id alone; rows are taken one by one, repeated ids too.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = _coder(tokenizer_path)
        end = array(coder.code, [end_id]).tobytes()
        ids = coder.encode_all(batch.column("text"), end)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return arrow_map(texts(docs), work, "doc_id bigint, ids binary", by="text")


# --- files ------------------------------------------------------------------------------------------


def write_shards(ids: DataFrame, ids_by: DataFrame, path: str, width: int = 2, shards: int | None = None) -> None:
    """Write ``doc_id, ids`` as ``shards`` wavelet files in ascending ``doc_id`` order.

    ``ids_by`` is any cheap table with the same ``doc_id``: the bounds between shards are its
    quantiles, ``shards - 1`` numbers, so that the ids themselves are made once. Ties on ``doc_id``
    lie in the order of their ids. An empty table writes no block.
    """
    spark = ids.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(ids_by, shards)
    kind = np.uint16 if width == 2 else np.uint32

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, counts, size, start, number, shard = [], [], [], 0, 0, 0, 0

        def block() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(held), kind))
            zeros, planes, ranks = matrix.stored()
            row = {
                "shard": shard, "block": number, "shard_start": start, "n_tokens": size, "doc_ids": names,
                "doc_tokens": counts, "zeros": zeros, "planes": planes, "ranks": ranks,
            }
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            for shard_in, doc, value in zip(*(batch.column(c) for c in ("shard", "doc_id", "ids")), strict=True):
                shard = shard_in.as_py()
                value = value.as_py()
                held.append(value)
                names.append(doc.as_py())
                counts.append(len(value) // width)
                size += counts[-1]
                if size >= BLOCK:
                    yield block()
                    start, number = start + size, number + 1
                    held, names, counts, size = [], [], [], 0
        if names:
            yield block()

    (
        ids.withColumn("shard", range_of(bounds, F.col("doc_id")))
        .repartitionById(len(bounds) + 1, "shard")
        .sortWithinPartitions("doc_id", "ids")
        .mapInArrow(blocks, BLOCKS)
        .write.option("compression", "zstd")
        .parquet(path)
    )


_ARROW = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("shard_start", pa.int64()), ("n_tokens", pa.int64())]
    + [(c, pa.list_(pa.int64())) for c in ("doc_ids", "doc_tokens", "zeros")]
    + [(c, pa.list_(pa.binary())) for c in ("planes", "ranks")]
)


def read_shards(spark, path: str) -> DataFrame:
    """The blocks, with ``start``: how many ids all blocks before hold. One row per shard is summed."""
    blocks = spark.read.schema(T._parse_datatype_string(BLOCKS)).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    starts = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return blocks.join(F.broadcast(starts), "shard").withColumn("start", F.col("base") + F.col("shard_start"))


def document_digests(blocks: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of its ids as 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = WaveletMatrix(row["n_tokens"], row["zeros"], row["planes"], row["ranks"]).decode()
                wide = memoryview(ids.astype("<u4").tobytes())
                ends = [0, *np.cumsum(row["doc_tokens"]).tolist()]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "start": pa.array([row["start"] + e for e in ends[:-1]], pa.int64()),
                        "n_tokens": pa.array(row["doc_tokens"], pa.int64()),
                        "ids_crc32": pa.array(
                            [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)], pa.int64()
                        ),
                    }
                )

    return blocks.select("start", "n_tokens", "doc_ids", "doc_tokens", "zeros", "planes", "ranks").mapInArrow(
        digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def occurrences(blocks: DataFrame, token: int, at_most: int | None = None) -> DataFrame:
    """Places of one token over all shards, from rank and select alone: ``position`` from the first id on."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chain.from_iterable(b.to_pylist() for b in batches):
            matrix = WaveletMatrix(row["n_tokens"], row["zeros"], row["planes"], row["ranks"])
            n = matrix.rank(token, matrix.n)
            found = [row["start"] + matrix.select(token, j) for j in range(n if at_most is None else min(n, at_most))]
            yield pa.RecordBatch.from_pydict({"position": pa.array(found, pa.int64())})

    return blocks.select("start", "n_tokens", "zeros", "planes", "ranks").mapInArrow(find, "position bigint")
