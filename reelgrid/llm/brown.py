"""Brown class-based bigram model: exchange clustering, and log-probabilities of whole texts.

Every distinct word is counted by a shuffle, and so is every distinct pair of neighbours. Clustering is
seeded on the driver: the ``ELEMENTS`` most frequent words, the end of a text and ``SUFFIXES`` groups of all
other words (by their last letters) are elements of a bounded bigram table, and exchange moves one element
at a time to the class that raises the likelihood most. From there each word outside the elements is
clustered by its own neighbours: its counts by class of follower and predecessor are a row of a table, and
tasks choose its best class against the classes x classes table; this is repeated while the likelihood
rises. Classes of the ``SENT`` most frequent words are sent, those of all others meet the pairs in a join. A
word's probability is that of its class after the class before, times its smoothed share of the class.
Exact counts and classes of the ``KNOWN`` most frequent words are sent to the scoring tasks, and those of the
``SENT`` most frequent by two hashes of each; all other words meet theirs in a join, so no word is dropped. A
word never met in training has the class of its group.

Texts are cut into words once and kept as numbers. Counts by neighbour are dealt by word once: a sweep reads
them where they are, with the classes sent, and moves classes only. Where there are words whose classes are
not sent, these meet the counts in a join of each sweep.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import slices, stored

ELEMENTS, SUFFIXES, CLASSES, KNOWN, SWEEPS = 1024, 255, 64, 65_536, 4
SENT = 1 << 20  # words whose classes are sent while clustering, at most
RISE = 1e-3  # of the mean log-likelihood of a token: a sweep that gains less is the last
END = b"\n"  # no word holds white space
HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 7 = 2, false)"


_SIGNS = b".,;:!?#$%&*\"')"


class _Groups(dict):
    """Elements of last letters."""

    def __missing__(self, letters: bytes) -> int:
        self[letters] = i = ELEMENTS + zlib.crc32(letters) % SUFFIXES
        return i


def keys_of(words: list[bytes]) -> np.ndarray:
    """57-bit hashes of words; the seven lowest bits are free for a side and a class."""
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)).view(np.int64) & -128


def checks_of(words: list[bytes]) -> np.ndarray:
    """Other hashes of words, which tell apart words of equal keys."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).select("doc_id", "text", F.expr(HELD_OUT).alias("held_out"), F.monotonically_increasing_id().alias("row"))


# --- texts as numbers ----------------------------------------------------------------------------------

SLICE = 4_000_000  # bytes of text in a row of coded texts, or one text
CODED = (
    "doc_id array<bigint>, held_out array<boolean>, row array<bigint>, many array<int>, tokens binary,"
    " words binary, sizes array<bigint>"
)


def encode_texts(rows: DataFrame) -> DataFrame:
    """Texts cut into words once: a row holds some of them as numbers of its own distinct ``words``.

    Every text closes with the end, number 0; ``many`` counts its tokens. Later steps look up distinct words only.
    Tokens and words, joined by the end, are compressed, so that each is one short value outside Python.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                lines = pc.ascii_split_whitespace(pc.ascii_lower(batch.column("text")))
                found, starts = lines.flatten(), lines.offsets.to_numpy()
                # White space at either end of a text leaves an empty word there.
                real = pc.binary_length(found).to_numpy() > 0
                found, starts = found.filter(pa.array(real)).dictionary_encode(), np.concatenate(([0], np.cumsum(real)))[starts]
                ids = np.insert(found.indices.to_numpy() + 1, starts[1:], 0).astype(_kind(len(found.dictionary) + 1))
                words = pc.binary_join(_single(found.dictionary), END.decode())[0].as_py().encode()
                one = {c: _single(batch.column(c)) for c in ("doc_id", "held_out", "row")}
                one |= _packed_row({"tokens": ids.tobytes(), "words": words}) | {"many": _single(pa.array(np.diff(starts) + 1, pa.int32()))}
                yield pa.RecordBatch.from_pydict(one, schema=_CODED)

    return rows.select("doc_id", "held_out", "row", "text").mapInArrow(run, CODED)


_CODED = pa.schema(
    [
        ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("row", pa.list_(pa.int64())),
        ("many", pa.list_(pa.int32())), ("tokens", pa.binary()), ("words", pa.binary()), ("sizes", pa.list_(pa.int64())),
    ]
)


def _single(column: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def _packed_row(values: dict[str, bytes]) -> dict[str, pa.Array]:
    """One row of compressed values and their sizes."""
    row = {c: pa.array([pa.compress(x, "zstd", asbytes=True) if len(x) else b""], pa.binary()) for c, x in values.items()}
    return row | {"sizes": pa.array([[len(x) for x in values.values()]], pa.list_(pa.int64()))}


def _unpacked(value: bytes, size: int) -> bytes:
    return pa.decompress(value, size, "zstd", asbytes=True) if size else b""


def _kind(words: int) -> type:
    return np.uint16 if words <= 1 << 16 else np.uint32


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray, np.ndarray]]:
    """Row by row of coded texts: the row, its words, its tokens, and how many tokens each text has."""
    for batch in batches:
        for i in range(batch.num_rows):
            packed = zip((batch.column(c)[i].as_py() for c in ("tokens", "words")), batch.column("sizes")[i].as_py(), strict=True)
            ids, words = (_unpacked(*x) for x in packed)
            words = [END, *words.split(END)] if words else [END]
            ids = np.frombuffer(ids, _kind(len(words)))
            yield batch.slice(i, 1), words, ids, batch.column("many")[i].values.to_numpy()
        pa.default_memory_pool().release_unused()


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and tokens of the texts that are not held out."""
    for row, words, ids, many in _texts(batches):
        held = row.column("held_out")[0].values.to_numpy(zero_copy_only=False).astype(bool)
        yield words, ids[np.repeat(~held, many)]


def count_words(training: DataFrame) -> DataFrame:
    """``word, c`` over all texts, an end per text included. Words are counted before the shuffle."""
    return _count_coded(encode_texts(training))


def _count_coded(coded: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).group_by("word").aggregate([("n", "sum")])
            yield from table.rename_columns({"n_sum": "n"}).select(["word", "n"]).to_batches()

        for words, ids in _trained(batches):
            n = np.bincount(ids, minlength=len(words))
            met = pa.array(n > 0)
            held.append(pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).filter(met), pa.array(n).filter(met)], ["word", "n"]))
            size += len(words)
            if size > AT_ONCE:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    counted = coded.select("held_out", "many", "tokens", "words", "sizes").mapInArrow(run, "word binary, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("c"))


class Coding:
    """Numbers of elements and exact counts of the most frequent words."""

    def __init__(self, top: list[tuple[bytes, int]], ends: int = 0) -> None:
        self.number = {w: i for i, (w, _) in enumerate(top[:ELEMENTS]) if w != END}
        self.end = ELEMENTS + SUFFIXES
        self.size = self.end + 1
        self.count = dict(top) | {END: ends}
        self._own = self.number | {END: self.end}

    def elements(self, words: list[bytes]) -> np.ndarray:
        """Elements of the words, the end's its own; words outside the most frequent have those of their last letters."""
        own, groups = self._own.get, _Groups()
        return np.array(
            [i if (i := own(w)) is not None else groups[w.rstrip(_SIGNS)[-3:] or w[-1:]] for w in words], np.int64
        )


def count_bigrams(coded: DataFrame, coding) -> DataFrame:
    """``pair, n``: how often an element (in ``pair // size``) is followed by another (``pair % size``).

    Tasks send their counts as arrays, a row per range of pairs, and not as rows of pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coding.value
        counts = np.zeros(code.size * code.size, np.int64)
        for words, ids in _trained(batches):
            element = code.elements(words).astype(np.int32)[ids]
            pair = np.concatenate(([code.end], element[:-1]))[: len(ids)] * code.size + element
            counts += np.bincount(pair, minlength=len(counts))
        pairs = np.flatnonzero(counts)
        ends = np.searchsorted(pairs * RANGES // len(counts), np.arange(RANGES + 1))
        for i in np.flatnonzero(np.diff(ends)).tolist():
            own = pairs[ends[i] : ends[i + 1]]
            yield _row({"pairs": own.astype(np.int32), "counts": counts[own]}, i)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(coding.value.size ** 2, np.int64)
        for _, own, n in _arrays(batches, _PAIRS):
            counts[own] += n  # each pair once in a row
        pairs = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts[pairs])], ["pair", "n"])

    counted = coded.select("held_out", "many", "tokens", "words", "sizes").mapInArrow(run, _fields(_PAIRS))
    return counted.repartition("bucket").mapInArrow(merge, "pair bigint, n bigint")


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of elements by exchange clustering of their square table of bigram counts.

    The last element, the end, has class 0 to itself. Elements start in classes 1 on by frequency, in
    turn; each sweep visits them by frequency and moves each to the class of greatest likelihood.
    """
    n = len(bigrams)
    size = bigrams.sum(axis=0)
    order = [i for i in np.argsort(-size, kind="stable").tolist() if i != n - 1]
    of = np.zeros(n, np.int64)
    of[order] = 1 + np.arange(len(order)) % (classes - 1)

    def xlogx(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    one_hot = np.zeros((n, classes))
    one_hot[np.arange(n), of] = 1
    right = bigrams @ one_hot  # by element: followers by class
    left = bigrams.T @ one_hot  # by element: predecessors by class
    table = one_hot.T @ right
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not size[w]:
                continue
            a, self_loop = of[w], bigrams[w, w]
            # Without w: its row and column leave class a.
            r, s = right[w].copy(), left[w].copy()
            r[a] -= self_loop
            s[a] -= self_loop
            rest = table.copy()
            rest[a] -= right[w]
            rest[:, a] -= left[w]
            rest[a, a] += self_loop
            # Joining class b changes its row, its column and their crossing.
            base_row, base_column = xlogx(rest).sum(axis=1), xlogx(rest).sum(axis=0)
            diagonal = np.diag(rest)
            grown_row = xlogx(rest + r[None, :]).sum(axis=1) - xlogx(diagonal + r)
            grown_column = xlogx(rest + s[:, None]).sum(axis=0) - xlogx(diagonal + s)
            crossing = xlogx(diagonal + r + s + self_loop)
            pairs = grown_row + grown_column + crossing - (base_row + base_column - xlogx(diagonal))
            out, into = rest.sum(axis=1), rest.sum(axis=0)
            singles = xlogx(out + r.sum() + self_loop) - xlogx(out) + xlogx(into + s.sum() + self_loop) - xlogx(into)
            gain = pairs - singles
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if b != a and gain[b] > gain[a] + 1e-9:
                moved += 1
                of[w] = b
                right[:, a] -= bigrams[:, w]
                right[:, b] += bigrams[:, w]
                left[:, a] -= bigrams[w]
                left[:, b] += bigrams[w]
                rest[b] += r
                rest[:, b] += s
                rest[b, b] += self_loop
                table = rest
        if not moved:
            break
    return of


class Model:
    """Log10 tables that score texts."""

    def __init__(self, coding: Coding, bigrams: np.ndarray, of: np.ndarray, groups: dict[int, tuple[int, int]], base: tuple[int, int]) -> None:
        self.coding, self.of, self.base = coding, of, base
        #: Class by word of the known words, and of each class log10 of what a count plus one is divided by.
        self.word_class: dict[bytes, int] = {}
        self.within = np.zeros(0)
        #: Keys, ascending, of more words with a second hash, the count and the class of each.
        self.sent = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        classes = int(of.max()) + 1
        one_hot = np.zeros((len(of), classes))
        one_hot[np.arange(len(of)), of] = 1
        table = one_hot.T @ bigrams @ one_hot
        into = table.sum(axis=0)
        share = (into + 1) / (into.sum() + classes)
        self.step = np.log10((table + 10 * share[None, :]) / (table.sum(axis=1, keepdims=True) + 10))
        size = bigrams.sum(axis=0)
        # An element never met in training still has a share: half a count each.
        per_class = np.bincount(of, size + 0.5, classes)
        self.emit = np.log10((size + 0.5) / per_class[of])
        #: Of a group, -log10 of what a count plus one is divided by.
        self.group = np.array(
            [-np.log10(sum(groups.get(g, (0, 0))) + 1) for g in range(SUFFIXES)]
        )


    def known(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts and classes of the words that were sent; of all others the class is -1."""
        keys, checks, counts, classes = self.sent
        wanted = keys_of(words)
        order = np.argsort(wanted)  # places of ascending keys are found faster
        at, there = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at[order], there[order] = _place(keys, wanted[order])
        if len(keys):
            there[there] = checks[at[there]] == checks_of([words[i] for i in np.flatnonzero(there).tolist()])
        count, cls = np.zeros(len(words), np.int64), np.full(len(words), -1)
        count[there], cls[there] = counts[at[there]], classes[at[there]]
        for i in np.flatnonzero(~there).tolist():
            if (c := self.word_class.get(words[i])) is not None:
                count[i], cls[i] = self.coding.count.get(words[i], 0), c
        return count, cls


# --- clustering of the whole vocabulary --------------------------------------------------------------


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in ascending order and the sums of their counts."""
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return codes[starts], np.add.reduceat(counts, starts) if len(codes) else counts


def _place(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys``, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


#: Tokens whose neighbours are summed at once, and in a row of a bucket of words, about.
AT_ONCE, BUCKET = 500_000, 500_000
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
PSEUDO = CLASSES << 7  # keys below stand for all the fixed words of a class


def _neighbours(batches: Iterator[pa.RecordBatch], sent, opened: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """``code, other, n``: how often a word has a neighbour; ``code`` is the word's key and the neighbour's side.

    ``sent`` has the keys whose classes are sent, those that are fixed, and the classes of these. Words that are
    fixed need no counts of their own: as a word, all of a class are one, with the followers only that are fixed
    or not sent; as a neighbour, ``other`` is their class. That of another neighbour is ``CLASSES`` and its place in the keys sent, or its
    key where ``opened`` asks for the neighbours that were not sent. Counts are summed by task and side, in order of words.
    """
    places, fixed, classes = sent.value
    rows, held = [], 0

    def out() -> Iterator[tuple[np.ndarray, ...]]:
        keys, at = np.unique(np.concatenate([k for k, _ in rows]), return_inverse=True)
        starts = np.cumsum([0, *(len(k) for k, _ in rows)])
        at = at.astype(np.int32)
        ids = np.concatenate([at[s + i] for s, (_, i) in zip(starts, rows, strict=False)])
        place, there = _place(fixed, keys)
        place, cls = np.where(there, place, 0), classes[place] if len(fixed) else place
        where, met = _place(places, keys)
        if opened:
            seen, other = ~there & ~met, np.arange(len(keys))
        else:
            seen, other = there | met, np.where(there, cls, CLASSES + where)
        # Ascending keys, so that sums come out by word.
        words, own = np.unique(np.where(there, cls << 7, keys), return_inverse=True)
        own = own.astype(np.int32)
        before, after = np.concatenate((ids[-1:], ids[:-1])), ids
        # A side at a time, as its codes are the most that is held.
        for mine, its, side in ((before, after, 0), (after, before, 1)):
            # Followers of fixed words that are sent tell of them as their predecessors.
            these = seen[its] & (~there[mine] | (opened | there[its] if side == 0 else False))
            code = own[mine[these]].astype(np.int64) << 32
            code |= other[its[these]]
            code.sort()
            starts = np.flatnonzero(np.concatenate((code[:1] == code[:1], code[1:] != code[:-1])))
            n = np.diff(starts, append=len(code))
            code = code[starts]
            its = code & 0xFFFFFFFF
            yield words[code >> 32] | side * CLASSES, keys[its] if opened else its, n

    for words, ids in _trained(batches):
        if len(ids):
            rows.append((keys_of(words), ids))
            held += len(ids)
        if held > AT_ONCE:
            yield from out()
            rows, held = [], 0
    if held:
        yield from out()


def _row(arrays: dict[str, np.ndarray], bucket: int | None = None) -> pa.RecordBatch:
    """One row of arrays, with a bucket or none."""
    row = _packed_row({c: np.ascontiguousarray(x).tobytes() for c, x in arrays.items()})
    return pa.RecordBatch.from_pydict(({} if bucket is None else {"bucket": pa.array([bucket], pa.int32())}) | row)


def _arrays(batches: Iterator[pa.RecordBatch], kinds: dict[str, type]) -> Iterator[tuple]:
    """Row by row the bucket, null if there is none, and the arrays."""
    for batch in batches:
        for row in batch.to_pylist():
            yield row.get("bucket"), *(
                np.frombuffer(pa.decompress(row[c], n, "zstd") if n else b"", kind)
                for (c, kind), n in zip(kinds.items(), row["sizes"], strict=True)
            )


RANGES = 64  # of pairs of elements
_PAIRS = {"pairs": np.int32, "counts": np.int64}
_NEAR = {"codes": np.int64, "many": np.uint32, "others": np.int32, "counts": np.uint32}
_SLOTS = {"keys": np.int64, "many": np.uint8, "slots": np.uint8, "counts": np.int64}
_WORDS = {"keys": np.int64, "cls": np.uint8, "many": np.uint8, "slots": np.uint8, "counts": np.int64}


def _fields(kinds: dict[str, type], bucket: bool = True) -> str:
    return ("bucket int, " if bucket else "") + "".join(f"{c} binary, " for c in kinds) + "sizes array<bigint>"


def _near(code: np.ndarray, other: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    codes, many = np.unique(code, return_counts=True)
    return dict(zip(_NEAR, (codes, many.astype(np.uint32), other.astype(np.int32), n.astype(np.uint32)), strict=True))


def count_neighbours(coded: DataFrame, sent, buckets: int) -> DataFrame:
    """Neighbours whose classes are sent, dealt by word once: ``bucket``, ``codes``, ``many`` entries of each, ``others``, ``counts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrays in _neighbours(batches, sent, False):
            ends = np.searchsorted(_bucket(arrays[0], buckets), np.arange(buckets + 1))
            rows = [_row(_near(*(x[ends[i] : ends[i + 1]] for x in arrays)), i) for i in np.flatnonzero(np.diff(ends)).tolist()]
            yield from rows and [pa.concat_batches(rows)]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            codes, own = np.unique(np.concatenate([c for c, *_ in held]), return_inverse=True)
            starts = np.cumsum([0, *(len(c) for c, *_ in held)])
            key = np.concatenate([
                np.repeat(own[s : s + len(c)] << 32, many) | others for s, (c, many, others, _) in zip(starts, held, strict=False)
            ])
            key, n = _summed(key, np.concatenate([x.astype(np.int64) for *_, x in held]))
            return _row(_near(codes[key >> 32], key & 0xFFFFFFFF, n), bucket)

        held, bucket = [], None
        for b, *arrays in _arrays(batches, _NEAR):
            if b != bucket and held:
                yield out()
                held = []
            bucket = b
            held.append(arrays)
        if held:
            yield out()

    wanted = coded.select("held_out", "many", "tokens", "words", "sizes").mapInArrow(run, _fields(_NEAR))
    return wanted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, _fields(_NEAR))


def open_neighbours(coded: DataFrame, sent) -> DataFrame:
    """``code, other, n`` of the neighbours whose classes are not sent; ``other`` is their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrays in _neighbours(batches, sent, True):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["code", "other", "n"])

    wanted = coded.select("held_out", "many", "tokens", "words", "sizes")
    return wanted.mapInArrow(run, "code bigint, other bigint, n bigint")


def _bucket(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of keys, ascending as these are."""
    return ((codes >> 32) + (1 << 31)) * buckets >> 32


def _dealt(entries: Iterator[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Codes and counts summed by task: a row per bucket of ``keys, many, slots, counts``, sorted by word and slot.

    ``many`` is how many of the slots are a word's; its own class has the count zero.
    """
    held, size = [], 0

    def out(codes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.searchsorted(_bucket(codes, buckets), np.arange(buckets + 1))
        for i in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
            yield _row(_slots(codes[ends[i] : ends[i + 1]], counts[ends[i] : ends[i + 1]]), i)

    for codes, counts in entries:
        held.append((codes, counts))
        size += len(codes)
        if size > AT_ONCE:
            yield from out(*_compact(*map(np.concatenate, zip(*held, strict=True))))
            held, size = [], 0
    if size:
        yield from out(*_compact(*map(np.concatenate, zip(*held, strict=True))))


def _slots(codes: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    keys, many = np.unique(codes & -128, return_counts=True)
    return dict(zip(_SLOTS, (keys, many.astype(np.uint8), (codes & 127).astype(np.uint8), counts), strict=True))


def _own(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Entries of a bucket as words with their classes: those of the entries of count zero, or of the fixed words."""
    mark = counts == 0
    keys, own = codes[mark] & -128, codes[mark] & 127
    codes, counts = codes[~mark], counts[~mark]
    firm = np.unique(codes & -128)
    firm = firm[(firm >= 0) & (firm < PSEUDO)]
    keys, own = np.concatenate((keys, firm)), np.concatenate((own, firm >> 7))
    order = np.argsort(keys)
    keys, own = keys[order], own[order]
    many = np.diff(np.searchsorted(codes, keys | 127, side="right"), prepend=0)
    arrays = (keys, own.astype(np.uint8), many.astype(np.uint8), (codes & 127).astype(np.uint8), counts)
    return _row(dict(zip(_WORDS, arrays, strict=True)))


def _sent_by_bucket(near: DataFrame, keys, classes, whole: bool) -> DataFrame:
    """Counts by the classes sent, by bucket; with ``whole``, if all classes are sent, as words with theirs."""
    return near.mapInArrow(_by_classes(keys, classes, whole), _fields(_WORDS, False) if whole else _fields(_SLOTS))


def _by_classes(keys, classes, whole: bool) -> Step:
    """What a task of ``_sent_by_bucket`` does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.concatenate((np.arange(CLASSES), classes.value.astype(np.int64)))
        for bucket, codes, many, others, counts in _arrays(batches, _NEAR):
            counts = counts.astype(np.int64)
            word = np.repeat(np.arange(len(codes)), many)
            # Sorted by word and side, so sums within words come in order.
            slot, n = _summed(word << 6 | told[others], counts)
            found = [(codes[slot >> 6] | slot & (CLASSES - 1), n)]
            own = codes & -128
            place, there = _place(keys.value[0], own)
            there &= (own < 0) | (own >= PSEUDO)
            cls = np.where(there, told[CLASSES + np.where(there, place, 0)] if len(told) > CLASSES else 0, 0)
            # Of the fixed words before a word sent, the words of a class are one, with that follower's class.
            after = (codes[word] & CLASSES != 0) & (others < CLASSES) & there[word]
            found.append(_summed(others[after].astype(np.int64) << 7 | cls[word[after]], counts[after]))
            if whole:
                these, first = np.unique(own[there], return_index=True)
                found.append((these | cls[there][first], np.zeros(len(these), np.int64)))
            found = _compact(*map(np.concatenate, zip(*found, strict=True)))
            yield _own(*found) if whole else _row(_slots(*found), bucket)

    return run


def _by_bucket(entries: DataFrame, buckets: int) -> DataFrame:
    """``code, n`` by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _dealt(((b.column("code").to_numpy(), b.column("n").to_numpy()) for b in batches), buckets)

    return entries.mapInArrow(run, _fields(_SLOTS))


def _packed(rows: DataFrame) -> DataFrame:
    """``keys, cls, many, slots, counts``: of the words of a bucket their classes and their counts by side and class.

    An entry of count zero tells a word's own class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for b, keys, many, slots, counts in _arrays(batches, _SLOTS):
            if b != bucket and held:
                yield _own(*_compact(*map(np.concatenate, zip(*held, strict=True))))
                held = []
            bucket = b
            held.append((np.repeat(keys, many) | slots.astype(np.int64), counts))
        if held:
            yield _own(*_compact(*map(np.concatenate, zip(*held, strict=True))))

    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, _fields(_WORDS, False))


def _compact(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed entries in order; those of count zero stay apart, before the others of their code."""
    mark = counts == 0
    summed, n = _summed(codes[~mark], counts[~mark])
    codes, counts = np.concatenate((codes[mark], summed)), np.concatenate((counts[mark], n))
    order = np.argsort(codes, kind="stable")
    return codes[order], counts[order]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each bucket keys and classes of the words; word, slot and count of each entry."""
    for _, keys, cls, many, slots, counts in _arrays(batches, _WORDS):
        yield keys, cls.astype(np.int64), np.repeat(np.arange(len(cls)), many), slots.astype(np.int64), counts


def _class_table(packed: DataFrame, first: Step = iter) -> np.ndarray:
    """Counts of class after class; ``first`` makes the words' rows of those of ``packed``, in the same Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for _, cls, word, slot, n in _buckets(first(batches)):
            follows = slot < CLASSES
            cell = cls[word[follows]] * CLASSES + slot[follows]
            total += np.bincount(cell, n[follows], len(total)).astype(np.int64)  # exact below 2^53
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    cells = packed.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(CLASSES * CLASSES)
    table[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return table.reshape(CLASSES, CLASSES)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    """Log-likelihood of the corpus by its class bigrams, but for the words' own counts."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def best_classes(table: np.ndarray, cls: np.ndarray, word: np.ndarray, slot: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each word the class whose followers and predecessors make the word's own likeliest.

    ``cls`` are the classes now, ``word, slot, n`` the words' counts by side and class of neighbours. A
    word's own counts are out of its class's before it is judged, and do not count for another's: as all
    words are judged at once, an empty class would draw them all. Class 0, the end's, takes no word.
    """
    both = np.concatenate((table, table.T), axis=1)  # of each class its followers, then its predecessors
    sides = np.stack((table.sum(axis=1), table.sum(axis=0)))
    lean = 10 * (both.sum(axis=0) + 1) / (table.sum() + CLASSES)
    logs = np.ascontiguousarray(np.log(both + lean).T)
    gain = np.zeros((len(cls), CLASSES))
    for i in range(0, len(word), 16_384):
        w, k, c = word[i : i + 16_384], slot[i : i + 16_384], n[i : i + 16_384].astype(np.float64)
        there = logs[k]
        own = cls[w]
        there[np.arange(len(w)), own] = np.log(np.maximum(both[own, k] - c, 0) + lean[k])
        first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        gain[w[first]] += np.add.reduceat(there * c[:, None], first, axis=0)
    at = np.arange(len(cls))
    for side in (0, 1):
        own = np.bincount(word, n * ((slot >= CLASSES) == side), len(cls))
        there = np.repeat(sides[side][None, :], len(cls), axis=0)
        there[at, cls] -= own
        gain -= own[:, None] * np.log(there + 10)
    gain[:, 0] = -np.inf
    best = gain.argmax(axis=1)
    return np.where(gain[at, best] > gain[at, cls] + 1e-9, best, cls)


def _chosen(packed: DataFrame, table: np.ndarray, share: float, sweep: int, first: Step = iter) -> DataFrame:
    """``key, cls``: a share of the words, another one each sweep, choose their classes; ``first`` as above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, cls, word, slot, n in _buckets(first(batches)):
            drawn = ((key >> 7) * (2 * sweep + 1) & 1023) < share * 1024
            new = np.where(drawn, best_classes(table, cls, word, slot, n), cls)
            real = (key < 0) | (key >= PSEUDO)
            yield pa.RecordBatch.from_arrays([pa.array(key[real]), pa.array(new[real], pa.int32())], ["key", "cls"])

    return packed.mapInArrow(run, "key bigint, cls int")


def cluster(training: DataFrame, words: DataFrame, fixed: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """``key, cls`` of all words, and the table of class after class, from the seeds in ``words``.

    ``words`` has ``key, c, cls``. The keys ``fixed`` keep their seed. Sweeps end when the likelihood
    rises no more; of one that lowers it, as all words move at once, half the words are tried instead.
    """
    return _cluster(encode_texts(training), words, fixed)


def _bound(words: DataFrame) -> tuple[int, int]:
    """The count from which on at most ``SENT`` words are counted, and the sum of all counts ``c``."""
    many, bound, total = 0, 1, 0
    for c, n in sorted(((r[0], r[1]) for r in words.groupBy("c").count().collect()), reverse=True):
        many, total = many + n, total + c * n
        if many > SENT and bound == 1:
            bound = c + 1
    return bound, total


def _cluster(coded: DataFrame, words: DataFrame, fixed: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    spark = coded.sparkSession
    send = spark.sparkContext.broadcast
    seeds = stored(words.groupBy("key").agg(F.min("cls").alias("cls"), F.max("c").alias("c")), "classes")
    bound, total = _bound(seeds)
    often = seeds.where(F.col("c") >= bound).select("key")
    firm = seeds.where(F.col("key").isin(fixed.tolist())).select("key", "cls")
    kept_firm = firm.toArrow().sort_by("key")
    classes = seeds.select("key", "cls")
    loose = ~F.col("key").isin(fixed.tolist())
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    near = rest = kept = None
    share = 1.0
    for sweep in range(SWEEPS + 1):
        top = (classes.join(often, "key", "left_semi") if bound > 1 else classes).toArrow()
        order = np.argsort(keys := top["key"].to_numpy())
        if near is None:
            sent = send((keys[order], kept_firm["key"].to_numpy(), kept_firm["cls"].to_numpy().astype(np.int64)))
            near = stored(count_neighbours(coded, sent, buckets), "neighbours")
            rest = stored(open_neighbours(coded, sent), "open-neighbours") if bound > 1 else None
        told = send(top["cls"].to_numpy()[order].astype(np.int8))
        packed, first = near, _by_classes(sent, told, True)
        if rest is not None:
            met = rest.join(classes, F.col("other") == F.col("key"))
            met = met.select(F.col("code").bitwiseOR(F.col("cls").cast("bigint")).alias("code"), "n")
            own = classes.where(loose).select(F.col("key").bitwiseOR(F.col("cls").cast("bigint")).alias("code"), F.lit(0).cast("bigint").alias("n"))
            rows = _sent_by_bucket(near, sent, told, False).unionByName(_by_bucket(met, buckets)).unionByName(_by_bucket(own, buckets))
            packed, first = stored(_packed(rows), "word-neighbours"), iter
        table = _class_table(packed, first)
        now = likelihood(table)
        done = kept is not None and abs(now - kept[2]) < RISE * table.sum()
        if kept is None or now > kept[2]:
            kept = (classes, table, now, packed, first)
        else:
            share /= 2
        if done:
            break
        if sweep < SWEEPS:
            classes = stored(_chosen(kept[3], kept[1], share, sweep, kept[4]).unionByName(firm), "classes")
    return kept[0], kept[1]


# --- scoring ----------------------------------------------------------------------------------------


def _score(coded: DataFrame, sent) -> DataFrame:
    """Per row what is known without the join: tokens, partial sums, and ``open`` steps.

    A step with a word whose count was not sent is open: two numbers, each a class or, from ``CLASSES`` on,
    the number of such a word in the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        divisor = np.log10(model.base[0] + model.base[1] + 1)
        for row, words, ids, many in _texts(batches):
            found, cls = model.known(words)
            log = np.log10(found + 1)
            within = np.where(cls < 0, 0, log - model.within[cls])
            starts = np.cumsum(many) - many
            after = cls[ids]
            rare = np.flatnonzero(after < 0)
            after[rare] = CLASSES + _rare_numbers(ids, many, rare)[0]
            before = np.concatenate(([0], after[:-1]))  # after an end, of class 0, a text begins
            open_ = (after >= CLASSES) | (before >= CLASSES)
            step = np.where(open_, 0, model.step[np.where(open_, 0, before), np.where(open_, 0, after)])
            ends = np.concatenate(([0], np.cumsum(np.add.reduceat(open_, starts, dtype=np.int64)))) * 8
            steps = np.stack((before[open_], after[open_]), axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(row.column(c)[0].values for c in ("doc_id", "held_out", "row")), pa.array(many, pa.int64()),
                    pa.array(np.add.reduceat(found[ids] > 0, starts, dtype=np.int64)),
                    pa.array(np.add.reduceat(log[ids], starts) - many * divisor),
                    pa.array(np.add.reduceat(step + within[ids], starts)),
                    pa.Array.from_buffers(pa.binary(), len(many), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(steps.tobytes())]),
                ],
                ["doc_id", "held_out", "row", "n_tokens", "n_known", "base_score", "score", "open"],
            )

    return coded.mapInArrow(
        run,
        "doc_id bigint, held_out boolean, row bigint, n_tokens bigint, n_known bigint, base_score double, score double, open binary",
    )


def _rare_numbers(ids: np.ndarray, many: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, ...]:
    """Numbers in their text of the words at ``rare`` places; text, word, number and count of each such word of a text."""
    text = np.repeat(np.arange(len(many)), many)[rare]
    code, which, n = np.unique(text << 32 | ids[rare], return_inverse=True, return_counts=True)
    at = np.arange(len(code)) - np.searchsorted(code >> 32, code >> 32)
    return at[which], code >> 32, code & 0xFFFFFFFF, at, n


def _rare(coded: DataFrame, sent) -> DataFrame:
    """``row, word, at, n, seed`` of the words whose counts were not sent: number in the text, count, class if never met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for row, words, ids, many in _texts(batches):
            rare = model.known(words)[1] < 0
            _, text, own, at, n = _rare_numbers(ids, many, np.flatnonzero(rare[ids]))
            seeds = np.zeros(len(words), np.int64)
            seeds[rare] = model.of[model.coding.elements([w for w, r in zip(words, rare.tolist(), strict=True) if r])]
            yield pa.RecordBatch.from_arrays(
                [
                    row.column("row")[0].values.take(pa.array(text)), pa.array(words, pa.binary()).take(pa.array(own)),
                    pa.array(at, pa.int32()), pa.array(n), pa.array(seeds[own], pa.int32()),
                ],
                ["row", "word", "at", "n", "seed"],
            )

    wanted = coded.select("row", "many", "tokens", "words", "sizes")
    return wanted.mapInArrow(run, "row bigint, word binary, at int, n bigint, seed int")


def _closed(scored: DataFrame, sent) -> DataFrame:
    """``scored`` with the steps of ``open`` added, whose words' ``at, cls, n, c`` are in ``rare``."""
    kept = [c for c in scored.columns if c not in ("open", "rare", "n_known", "base_score", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            known, base, score = (batch.column(c).to_numpy().copy() for c in ("n_known", "base_score", "score"))
            rare = batch.column("rare")
            at, cls, n, c = (rare.flatten().field(k).to_numpy() for k in range(4))
            ends = np.cumsum(pc.fill_null(pc.list_value_length(rare), 0).to_numpy())
            for i, steps in enumerate(batch.column("open").to_pylist()):
                if not steps:
                    continue
                own = slice(ends[i - 1] if i else 0, ends[i])
                lookup = np.arange(CLASSES + own.stop - own.start)
                lookup[CLASSES + at[own]] = cls[own]
                pairs = lookup[np.frombuffer(steps, np.int32).reshape(-1, 2)]
                logs = float((n[own] * np.log10(c[own] + 1)).sum())
                known[i] += n[own][c[own] > 0].sum()
                base[i] += logs
                score[i] += logs + model.step[pairs[:, 0], pairs[:, 1]].sum() - (n[own] * model.within[cls[own]]).sum()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(known), pa.array(base), pa.array(score)],
                [*kept, "n_known", "base_score", "score"],
            )

    fields = ", ".join(f"{c} {scored.schema[c].dataType.simpleString()}" for c in kept)
    return scored.mapInArrow(run, f"{fields}, n_known bigint, base_score double, score double")


def train(coded: DataFrame) -> tuple[Model, DataFrame]:
    """The model of bounded size of the coded texts not held out, and ``word, c, cls`` of the words it does not tell."""
    spark = coded.sparkSession
    counted = stored(_count_coded(coded), "vocabulary")
    total, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = counted.orderBy(F.desc("c"), "word").limit(ELEMENTS).toArrow()
    coding = Coding(list(zip(top["word"].to_pylist(), top["c"].to_pylist(), strict=True)))
    shared = spark.sparkContext.broadcast(coding)
    pairs = count_bigrams(coded, shared).toArrow()  # at most size * size rows, whatever the corpus
    table = np.zeros(coding.size * coding.size)
    table[pairs["pair"].to_numpy()] = pairs["n"].to_numpy()
    of = exchange(table.reshape(coding.size, coding.size))

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        for batch in batches:
            words = batch.column("word").to_pylist()
            seeds = code.elements(words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("c"), pa.array(keys_of(words)), pa.array(of[seeds], pa.int32())],
                ["word", "c", "key", "cls"],
            )

    words = stored(counted.mapInArrow(seeded, "word binary, c bigint, key bigint, cls int"), "seeds")
    classes, table = _cluster(coded, words, np.sort(keys_of([*coding.number, END])))
    classes = F.broadcast(classes) if distinct <= SENT else classes
    vocabulary = stored(words.drop("cls").join(classes, "key").select("word", "c", "cls", "key"), "vocabulary")
    within = np.ones(CLASSES)
    for cls, c, v in vocabulary.groupBy("cls").agg(F.sum("c"), F.count(F.lit(1))).collect():
        within[cls] += c + (v if cls else 0)  # the end is all of its class
    top = vocabulary.orderBy(F.desc("c"), "word").limit(KNOWN).toArrow()
    ends = vocabulary.where(F.col("word") == F.lit(END)).first()
    model = Model(coding, table, np.arange(CLASSES), {}, (total, distinct))
    model.of = of
    model.within = np.log10(within)

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            checks = pa.array(checks_of(batch.column("word").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), checks, batch.column("c"), batch.column("cls")], ["key", "check", "c", "cls"])

    bound = _bound(vocabulary)[0]
    often = vocabulary.where(F.col("c") >= bound).mapInArrow(checked, "key bigint, check bigint, c bigint, cls int").toArrow().sort_by("key")
    model.sent = tuple(often[c].to_numpy().astype(kind) for c, kind in (("key", np.int64), ("check", np.int64), ("c", np.int64), ("cls", np.int8)))
    # Of words of one key only the first is found by it.
    twice = np.unique(model.sent[0][1:][np.diff(model.sent[0]) == 0]).tolist()
    # Words found by their hashes need no other way.
    top = top.filter((pc.field("c") < bound) | pc.field("key").isin(twice))
    names = top["word"].to_pylist()
    coding.count = dict(zip(names, top["c"].to_pylist(), strict=True)) | {END: ends["c"] if ends else 0}
    model.word_class = dict(zip(names, top["cls"].to_pylist(), strict=True)) | {END: 0}
    return model, vocabulary.where((F.col("c") < bound) | F.col("key").isin(twice)).drop("key")


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of all rows of ``docs``, by a model of the rows that are not held out.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. A null text is empty and
    scores its end; a null id is not held out; repeated rows are trained on and scored each. With an
    empty table, or none but held-out rows, all counts are zero and words are equally likely.
    """
    coded = stored(encode_texts(_rows(docs)), "coded-texts")
    model, vocabulary = train(coded)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    scored = _score(coded, sent)
    met = _rare(coded, sent).join(vocabulary, "word", "left").select(
        "row",
        F.struct(
            "at", F.coalesce("cls", "seed").alias("cls"), "n", F.coalesce("c", F.lit(0).cast("bigint")).alias("c")
        ).alias("rare"),
    )
    added = met.groupBy("row").agg(F.collect_list("rare").alias("rare"))
    # A word's log10(c + 1) stands in both scores; words without a count add nothing.
    return _closed(scored.join(added, "row", "left").drop("row"), sent).select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.base[0]).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )
