"""Byte-level BPE by an index of pair occurrences, and its inverse.

The distinct pre-tokens of a batch are laid out as one sequence of symbols. An index maps every pair of
adjacent symbols to all its positions; the pairs that have a merge rank wait in a heap. The lowest rank
is taken, all its positions are merged from left to right, and only the lists of the neighbouring
pairs are updated. A merge can only make pairs of higher rank, so ranks are visited in ascending order
and each once; that gives the same ids as merging every pre-token by itself. Position lists hold stale
entries, which are recognised by their symbols. Work is near-linear in the symbols, however long a
pre-token is.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reelgrid.llm.common import LETTERS, NUMBERS, ODD, arrow_map, texts

#: Fixed value: the pre-token pattern of this kind of tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts without odd characters.
_PLAIN = (
    f" ?[{LETTERS}]+| ?[{NUMBERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\\s{LETTERS}{NUMBERS}]+" + r"|\s+(?!\S)|\s+"
)
_CACHE = 150_000  # pre-tokens remembered, twice that with the older ones
LONG = 64  # characters; longer pre-tokens are not remembered
PIECE = 1_000_000  # bytes of text whose pre-tokens are merged together


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in vocabulary files of this kind."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(own))
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters = {c: b for b, c in _byte_letters().items()}
        vocab = told["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = token.encode() if token in self.added else bytes(letters[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.byte_ids = np.array([vocab[c] for _, c in sorted(_byte_letters().items())], np.int64)
        #: By rank: the two ids and the id they become; and the rank of a pair of ids.
        self.rules: list[tuple[int, int, int]] = []
        self.rank_of: dict[int, int] = {}
        for rank, merge in enumerate(told["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rules.append((vocab[a], vocab[b], vocab[a + b]))
            self.rank_of[vocab[a] << 20 | vocab[b]] = rank
        ids = self.byte_ids.tolist()
        self.byte_ranks = np.array([self.rank_of.get(a << 20 | b, -1) for a in ids for b in ids], np.int64)
        self.spelled = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths
        added = "|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))
        self.split_added = re.compile(f"({added})").split if added else lambda text: [text]
        self.pre_tokens = regex.compile(PATTERN).findall
        self.plain = re.compile(_PLAIN).findall
        self.odd = re.compile(ODD).search
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    # --- encoding

    def _merge_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as bytes: the pair index over all words at once."""
        laid = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        start = self.byte_ids[laid]
        start[ends] = -2  # between words
        symbol = [*start.tolist(), -2]
        after = list(range(1, len(symbol) + 1))
        before = list(range(-1, len(symbol) - 1))
        ranks = self.byte_ranks[laid[:-1].astype(np.int64) << 8 | laid[1:]]
        ranks[start[:-1] < 0] = -1
        ranks[start[1:] < 0] = -1
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        active, first = np.unique(ranks[at], return_index=True)
        index: dict[int, list[int]] = {
            r: p.tolist() for r, p in zip(active.tolist(), np.split(at, first[1:]), strict=True)
        } if len(at) else {}
        waiting = active.tolist()  # sorted, so a heap
        rank_of, rules, put = self.rank_of.get, self.rules, heapq.heappush
        while waiting:
            rank = heapq.heappop(waiting)
            a, b, new = rules[rank]
            places = index.pop(rank)
            if a == b:
                places.sort()
            for i in places:
                if symbol[i] != a:
                    continue
                j = after[i]
                if symbol[j] != b:
                    continue
                symbol[i], symbol[j] = new, -1
                k = after[i] = after[j]
                before[k] = i
                if (r := rank_of(new << 20 | symbol[k])) is not None and symbol[k] >= 0:
                    if r in index:
                        index[r].append(i)
                    else:
                        index[r] = [i]
                        put(waiting, r)
                h = before[i]
                if h >= 0 and (s := symbol[h]) >= 0 and (r := rank_of(s << 20 | new)) is not None:
                    if r in index:
                        index[r].append(h)
                    else:
                        index[r] = [h]
                        put(waiting, r)
        left = np.array(symbol[:-1], np.int64)
        left = left[left != -1]
        stops = np.flatnonzero(left == -2)
        out = left.astype("<u4").tobytes()
        return [out[4 * a : 4 * b] for a, b in zip([0, *(stops[:-1] + 1).tolist()], stops.tolist(), strict=True)]

    def _learn(self, wanted: set[str]) -> dict[str, bytes]:
        """Ids of pre-tokens not seen lately, by one pair index over those that are new; returns the long ones'."""
        if len(self.known) + len(wanted) > _CACHE:  # pre-tokens in use come back from the older half
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        wanted -= known.keys()
        for p in wanted & older.keys():
            known[p] = older[p]
        new = list(wanted - older.keys())
        long: dict[str, bytes] = {}
        if new:
            for p, ids in zip(new, self._merge_all([p.encode() for p in new]), strict=True):
                (known if len(p) <= LONG else long)[p] = ids
        return long

    def encode_all(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        laid: list[list] = []
        for text in batch:
            parts = []
            for i, piece in enumerate(self.split_added(text)):
                if i % 2:
                    parts.append(np.array([self.added[piece]], "<u4").tobytes())
                elif piece:
                    parts.append((self.pre_tokens if self.odd(piece) else self.plain)(piece))
            laid.append(parts)
        wanted = {c for parts in laid for p in parts if isinstance(p, list) for c in p}
        look, long = self.known, {}
        if not wanted <= look.keys():
            long = self._learn(wanted)
            look = self.known
            look.update(long)
        out = [
            b"".join([p if isinstance(p, bytes) else b"".join([look[c] for c in p]) for p in parts]) for parts in laid
        ]
        for p in long:
            del look[p]
        return out

    # --- decoding

    def decode(self, ids: bytes) -> str:
        found = np.frombuffer(ids, "<u4")
        lengths = self.lengths[found]
        ends = np.cumsum(lengths)
        if not len(found):
            return ""
        spread = np.repeat(self.places[found] - ends + lengths, lengths)
        return self.spelled[spread + np.arange(len(spread))].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _coder(path: str) -> PairBpe:
    return PairBpe(path)


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, ids`` per row: ids of the whole text as little-endian unsigned 32-bit integers.

    A null text is empty and has no ids. Strings of added tokens inside a text become their ids, as the
    library has it. Rows are taken one by one; other columns are left out.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = _coder(tokenizer_path).encode_all(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return arrow_map(texts(docs), work, "doc_id bigint, ids binary", by="text", limit=PIECE)


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; null ids are none."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = _coder(tokenizer_path)
        found = [coder.decode(i or b"") for i in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), work, "doc_id bigint, text string", by="ids")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Digests of ids and of the text decoded from them, per row, in one pass over the texts."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = _coder(tokenizer_path)
        ids = coder.encode_all(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(coder.decode(i).encode()).hexdigest() for i in ids], pa.string()),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return arrow_map(
        texts(docs), work, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", by="text",
        limit=PIECE,
    )
