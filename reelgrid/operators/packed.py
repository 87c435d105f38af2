"""Index entries brought to ranges of words in packed form.

A row per word and document costs some fifteen bytes in a shuffle, more than the text it comes from. Here each task
sorts what it holds, cuts it where the ranges end, and sends a range's share as one packed value: its words once with
their counts, its documents once, and per entry a document's number and ``tf``. The task that gets a range puts the
shares in one order. ``range_bounds`` takes the ranges from a sample, so that each holds a bounded number of entries;
entries of one word may lie in several.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

CHUNK_ENTRIES = 2_000_000  # entries that are sorted and packed at a time, about
BATCH_ENTRIES = 50_000  # entries of a batch that is handed back to Spark
ORDER = ["token", "media_id", "segment_id"]
PACKED = "range int, size bigint, entries binary, lengths array<struct<media_id: string, doc_len: int>>"

Bound = tuple[str, tuple]


def _place(media: object, segment: object) -> tuple:
    """A document's place among others, nulls last, as ``_ranks`` orders them."""
    return media is None, media, segment is None, segment


def range_bounds(sample: DataFrame, parts: int) -> list[Bound]:
    """The least entries of the second and later of ``parts`` ranges that share the sample evenly."""
    held = sample.select(*ORDER).toArrow().sort_by([(c, "ascending") for c in ORDER])
    at = sorted({i * held.num_rows // parts for i in range(1, parts)} - {0})
    rows = held.take(pa.array(at, pa.int64())).to_pylist()
    return [(r["token"], _place(r["media_id"], r["segment_id"])) for r in rows]


def _ranks(order: np.ndarray) -> np.ndarray:
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.arange(len(order))
    return ranks


def _sorted_docs(docs: pa.Table) -> np.ndarray:
    return pc.sort_indices(docs, sort_keys=[("media_id", "ascending"), ("segment_id", "ascending")]).to_numpy()


def _sorted_words(words: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Distinct words in order, and the place of each given one among them."""
    coded = (words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    return coded.dictionary.take(pa.array(order)), _ranks(order)[coded.indices.to_numpy()]


def _planes(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers as planes of their bytes, which compress well where neighbours are near."""
    return numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.ravel()


def _from_planes(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel()


def _written(table: pa.Table, sink: pa.BufferOutputStream) -> None:
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)


def _share(words: pa.Array, codes: np.ndarray, docs: pa.Table, doc: np.ndarray, tf: np.ndarray) -> tuple[int, bytes]:
    """Entries in order as one value: words with their counts, documents, and numbers of documents and ``tf``."""
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    told = pa.table({"token": words.take(pa.array(codes[starts])), "n": np.diff(starts, append=len(codes))})
    known, number = np.unique(doc, return_inverse=True)
    sink = pa.BufferOutputStream()
    _written(told, sink)
    _written(docs.take(pa.array(known)), sink)
    _written(pa.table({"doc": _planes(np.diff(number, prepend=0)), "tf": _planes(tf)}), sink)
    plain = sink.getvalue()
    return plain.size, pa.compress(plain, "zstd", asbytes=True)


def _opened(size: int, packed: bytes) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray]:
    source = pa.BufferReader(pa.decompress(packed, size, "zstd"))
    told, docs, rest = (pa.ipc.open_stream(source).read_all() for _ in range(3))
    doc, tf = (_from_planes(rest[c].combine_chunks().to_numpy()) for c in ("doc", "tf"))
    return told, docs, np.cumsum(doc, dtype=np.int64), tf


def _shares(tokens: pa.ChunkedArray, doc: np.ndarray, tf: np.ndarray, docs: pa.Table, bounds: list[Bound]) -> Iterator[tuple[int, int, bytes]]:
    """``(range, size, entries)`` of a chunk; ``doc`` numbers the rows of ``docs``."""
    words, codes = _sorted_words(tokens)
    in_order = _sorted_docs(docs)
    docs, doc = docs.take(pa.array(in_order)), _ranks(in_order)[doc]
    keys = codes * docs.num_rows + doc
    order = np.argsort(keys, kind="stable")
    keys, codes, doc, tf = keys[order], codes[order], doc[order], tf[order]
    listed = words.to_pylist()
    places = [_place(*p) for p in zip(docs["media_id"].to_pylist(), docs["segment_id"].to_pylist(), strict=True)]
    firsts = []
    for token, place in bounds:
        code = bisect_left(listed, token)
        known = code < len(listed) and listed[code] == token
        firsts.append(code * docs.num_rows + (bisect_left(places, place) if known else 0))
    cuts = [0, *np.searchsorted(keys, np.array(firsts, np.int64)).tolist(), len(keys)]
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if lo < hi:
            yield (k, *_share(words, codes[lo:hi], docs, doc[lo:hi], tf[lo:hi]))


def _packed(shares: Iterator[tuple[int, int, bytes]], lengths: pa.Table | None) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema(
        [("range", pa.int32()), ("size", pa.int64()), ("entries", pa.binary()), ("lengths", pa.list_(pa.struct([("media_id", pa.string()), ("doc_len", pa.int32())])))]
    )
    for k, size, entries in shares:
        yield pa.RecordBatch.from_pylist([{"range": k, "size": size, "entries": entries, "lengths": None}], kinds)
    if lengths is not None and lengths.num_rows:
        whole = [lengths[c].combine_chunks() for c in ("media_id", "doc_len")]
        pairs = pa.StructArray.from_arrays(whole, ["media_id", "doc_len"])
        listed = pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((None, pa.int32()), (None, pa.int64()), (None, pa.binary()))] + [listed], schema=kinds)


def _chunks(batches: Iterator[pa.RecordBatch], entries: Callable[[pa.RecordBatch], int]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += entries(batch)
        if n >= CHUNK_ENTRIES:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def pack_postings(postings: DataFrame, bounds: list[Bound]) -> DataFrame:
    """``PACKED`` rows of postings ``(media_id, segment_id, doc_len, terms)``: shares of ranges, and the documents' lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _chunks(batches, lambda b: len(b["terms"].flatten())):
            sizes = pc.fill_null(pc.list_value_length(held["terms"]), 0).to_numpy()
            lists = [c.flatten().flatten() for c in held["terms"].chunks]
            tokens, tf = (pa.chunked_array([x[i] for x in lists], t) for i, t in ((0, pa.string()), (1, pa.int32())))
            doc = np.repeat(np.arange(held.num_rows), sizes)
            docs = held.select(["media_id", "segment_id", "doc_len"])
            yield from _packed(_shares(tokens, doc, tf.to_numpy(), docs, bounds) if len(doc) else iter(()), docs.select(["media_id", "doc_len"]))

    return postings.select("media_id", "segment_id", "doc_len", "terms").mapInArrow(run, PACKED)


def pack_entries(entries: DataFrame, bounds: list[Bound]) -> DataFrame:
    """``PACKED`` rows of entries ``(media_id, segment_id, doc_len, token, tf)``, without lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _chunks(batches, len):
            names = ["media_id", "segment_id", "doc_len"]
            coded = [held[c].combine_chunks().dictionary_encode("encode").indices.to_numpy().astype(np.int64) for c in names]
            number = np.zeros(held.num_rows, np.int64)
            for codes in coded:  # numbered anew each time, so that the numbers stay below the square of the rows
                number = np.unique(number * (codes.max(initial=0) + 1) + codes, return_inverse=True)[1]
            first = np.unique(number, return_index=True)[1]
            if held.num_rows:
                yield from _packed(_shares(held["token"], number, held["tf"].to_numpy(), held.select(names).take(pa.array(first)), bounds), None)

    return entries.select("media_id", "segment_id", "doc_len", "token", "tf").mapInArrow(run, PACKED)


def _merged(shares: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    opened = [_opened(size, entries) for size, entries in shares]
    words, places = _sorted_words(pa.concat_tables([o[0] for o in opened])["token"])
    docs = pa.concat_tables([o[1] for o in opened])
    before = np.cumsum([0, *[o[1].num_rows for o in opened]])
    in_order = _sorted_docs(docs)
    docs = docs.take(pa.array(in_order)).combine_chunks()
    codes = np.repeat(places, np.concatenate([o[0]["n"].to_numpy() for o in opened]))
    doc = _ranks(in_order)[np.concatenate([o[2] + b for o, b in zip(opened, before[:-1], strict=True)])]
    tf = np.concatenate([o[3] for o in opened])
    order = np.argsort(codes * docs.num_rows + doc, kind="stable")
    for lo in range(0, len(order), BATCH_ENTRIES):
        some = order[lo : lo + BATCH_ENTRIES]
        rows = docs.take(pa.array(doc[some])).append_column("token", words.take(pa.array(codes[some])))
        yield from rows.append_column("tf", pa.array(tf[some], pa.int32())).combine_chunks().to_batches()


def unpack(packed: DataFrame, parts: int, segment_type: str) -> DataFrame:
    """Entries ``(media_id, segment_id, doc_len, token, tf)``, one of ``parts`` ranges to a task, in the order of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch[c].to_pylist() for c in ("range", "size", "entries")), strict=True))
        for _, shares in groupby(rows, lambda r: r[0]):
            yield from _merged([r[1:] for r in shares])

    dealt = packed.where("range is not null").select("range", "size", "entries").repartitionById(parts, "range")
    kinds = f"media_id string, segment_id {segment_type}, doc_len int, token string, tf int"
    return dealt.sortWithinPartitions("range").mapInArrow(run, kinds)
