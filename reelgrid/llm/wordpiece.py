"""Token counts by a linear longest-match automaton: greedy word-piece lengths without the pieces.

The vocabulary is a trie. Every node knows how many pieces are popped off when the next byte does not
follow, and the node where matching goes on (its failure link). A word is counted in one pass over its
bytes: on a mismatch the popped count is added and the link followed; no piece is ever built.
"""

from __future__ import annotations

import json
from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from reelgrid.llm.common import arrow_map, texts
from reelgrid.llm.pair_bpe import _byte_letters

_CACHE = 400_000


class LongestMatch:
    """Trie with failure links and popped-token counts over byte strings."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.moves: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces:
            node = 0
            for b in piece:
                if (nxt := self.moves[node].get(b)) is None:
                    nxt = self.moves[node][b] = len(self.moves)
                    self.moves.append({})
                    ends.append(False)
                node = nxt
            ends[node] = bool(piece) or ends[node]
        self.fail = [-1] * len(self.moves)
        self.pops = [0] * len(self.moves)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for b, v in self.moves[u].items():
                queue.append(v)
                if ends[v]:
                    self.fail[v], self.pops[v] = 0, 1
                    continue
                z, popped = self.fail[u], self.pops[u]
                while z >= 0 and b not in self.moves[z]:
                    popped += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.moves[z][b], popped

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest-match split; -1 when there is none."""
        node = found = 0
        moves, fail, pops = self.moves, self.fail, self.pops
        for b in word:
            while (nxt := moves[node].get(b)) is None:
                if fail[node] < 0:
                    return -1
                found += pops[node]
                node = fail[node]
            node = nxt
        while node:
            if fail[node] < 0:
                return -1
            found += pops[node]
            node = fail[node]
        return found


class WordCounts:
    """Counts per word of one vocabulary file, remembered for the words in use."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        added = {t["content"] for t in told["added_tokens"]}
        letters = {c: b for b, c in _byte_letters().items()}
        self.automaton = LongestMatch(
            [bytes(letters[c] for c in t) for t in told["model"]["vocab"] if t not in added]
        )
        self.known: dict[bytes, int] = {}

    def text(self, text: str) -> tuple[int, int, int]:
        """Words, pieces and words that have no split; such a word counts as one piece."""
        found = text.encode().split()
        known = self.known
        if len(known) + len(found) > _CACHE:
            known.clear()
        for w in found:
            if w not in known:
                known[w] = self.automaton.count(b" " + w)
        counts = [known[w] for w in found]
        unknown = counts.count(-1)
        return len(found), sum(counts) + 2 * unknown, unknown


@lru_cache(maxsize=2)
def _counter(path: str) -> WordCounts:
    return WordCounts(path)


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` per row.

    Words are parted by ASCII white space and begin with the vocabulary's space sign. A null or empty
    text has no words; rows are counted one by one, other columns are left out.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = _counter(vocabulary_path)
        rows = [counter.text(t) for t in batch.column("text").to_pylist()]
        words, tokens, unknown = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))],
            ["doc_id", "n_words", "n_tokens", "n_unknown"],
        )

    return arrow_map(
        texts(docs), work, "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint", by="text"
    )
