"""Benchmark decontamination by a generalised suffix automaton over the test items' words.

The automaton of all items is built once per Python worker. Each document's words stream through it;
the length of the longest match ending at each word tells whether a window of ``window`` words (or a
whole shorter item) ends there, and the state tells which items hold it. Only runs of words that occur
in the benchmark at all can match, so other words are skipped before. The benchmark is cut into blocks
of at most about ``BLOCK_WORDS`` words, one pass over the documents each, so that an automaton's size
is bounded however large the benchmark is.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import arrow_map, boxed, slices, stored

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BLOCK_WORDS = 200_000


def words(text: str) -> list[str]:
    return WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the items of every state."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        paths = []
        for name, sequence in items:
            path, last = [], 0
            for w in sequence:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                path.append(w)
            paths.append((name, path))
        self.items: list[set[str]] = [set() for _ in self.link]
        ended: dict[int, list[tuple[int, str]]] = {}
        self.shortest = window
        for name, path in paths:
            state = 0
            for w in path:
                state = self.next[state][self.vocabulary[w]]
                up = state
                while up > 0 and name not in self.items[up]:
                    self.items[up].add(name)
                    up = self.link[up]
            if 0 < len(path) < window:
                ended.setdefault(state, []).append((len(path), name))
                self.shortest = min(self.shortest, len(path))
        #: Whole items shorter than a window that end wherever a state's longest string does.
        self.short: list[list[tuple[int, str]]] = [[] for _ in self.link]
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.short[state] = self.short[self.link[state]] + ended.get(state, [])

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the longest string at ``p`` followed by ``c``, parted from ``q`` if need be."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c])
        state, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, c, self.next[p][c])
        return state

    def matches(self, sequence: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans ``[start, end)`` covered by windows of items, and those items."""
        look = self.vocabulary.get
        ids = np.fromiter((look(w, -1) for w in sequence), np.int64, len(sequence))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        length, link, window = self.length, self.link, self.window
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < self.shortest:
                continue
            state = matched = 0
            for i, w in enumerate(ids[a:b].tolist(), a):
                while state and w not in self.next[state]:
                    state = link[state]
                    matched = length[state]
                if w not in self.next[state]:
                    continue
                state = self.next[state][w]
                matched += 1
                start = i + 1
                if matched >= window:
                    holder = state
                    while length[link[holder]] >= window:
                        holder = link[holder]
                    found |= self.items[holder]
                    start = i + 1 - window
                for k, name in self.short[state]:
                    if k <= matched:
                        found.add(name)
                        start = min(start, i + 1 - k)
                if start <= i:
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
        return spans, found


_BUILT: dict[str, SuffixAutomaton] = {}


def _automata(benchmark: DataFrame, window: int, block_words: int) -> list:
    """One function per block that gives the block's automaton; each worker builds it on first use."""
    spark = benchmark.sparkSession
    asked = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    size = F.length("text") / 2 + 1  # words, or more
    blocks = max(1, int((asked.agg(F.sum(size)).first()[0] or 0) // block_words) + 1)
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))

    def make(b: int):
        items = [(r[0], words(r[1])) for r in dealt.where(F.col("block") == b).select("item_id", "text").collect()]
        sent, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def automaton() -> SuffixAutomaton:
            if key not in _BUILT:
                if len(_BUILT) >= 2:
                    _BUILT.clear()
                _BUILT[key] = SuffixAutomaton(sent.value, window)
            return _BUILT[key]

        return automaton, sent

    return blocks, make


def _judged(docs: DataFrame, blocks: int, make) -> DataFrame:
    """Per row ``doc_id, mark, n_words, spans, items``; one pass over the texts per block of items.

    Several passes are written one by one: a block is collected and sent when its pass begins and taken back
    when that ends, so each worker builds each automaton once.
    """
    schema = (
        "doc_id bigint, mark bigint, n_words bigint, spans array<struct<start: int, end: int>>, items array<string>"
    )
    kind = [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())]
    plain = boxed(docs).select(
        F.col("id").alias("doc_id"), "mark", F.coalesce(F.col("row").getField("text"), F.lit("")).alias("text")
    )

    def one(automaton) -> DataFrame:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, found = automaton(), []
            for text in batch.column("text").to_pylist():
                sequence = words(text)
                spans, items = rows.matches(sequence)
                found.append((len(sequence), [{"start": a, "end": b} for a, b in spans], sorted(items)))
            told = [pa.array([f[i] for f in found], k) for i, k in enumerate(kind)]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), *told], ["doc_id", "mark", "n_words", "spans", "items"]
            )

        return arrow_map(plain, work, schema, by="text")

    if blocks == 1:
        return one(make(0)[0])
    passes = []
    for b in range(blocks):
        automaton, sent = make(b)
        passes.append(stored(one(automaton), f"hits-{b}"))
        sent.destroy()
    # A row's results of all blocks come together by document and text; every pass has every row.
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    touched = (
        every.where(F.size("items") > 0)
        .groupBy("doc_id", "mark")
        .agg(
            F.array_sort(F.flatten(F.collect_set("spans"))).alias("_spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )
    apart = F.struct(F.col("_spans")[0]["start"].alias("start"), F.col("_spans")[0]["end"].alias("end"))
    merged = F.aggregate(
        F.slice("_spans", 2, F.size("_spans")),
        F.array(apart),
        lambda done, s: F.when(
            s["start"] <= F.element_at(done, -1)["end"],
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["start"].alias("start"),
                        F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    touched = touched.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), merged.alias("spans"), "items")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    empty = F.from_json(F.lit("[]"), "array<struct<start: int, end: int>>")
    rows = passes[0].select("doc_id", "mark", "n_words")
    return rows.join(touched, same, "left").select(
        "doc_id",
        "mark",
        "n_words",
        F.coalesce("spans", empty).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, spans, items``.

    ``spans`` are merged word ranges ``[start, end)``, ``items`` the ids (as strings, sorted) whose
    windows occur. A null text has no words; an item without words has no window; a null item id is
    the empty string. Repeated rows are answered alike, one by one.
    """
    return _judged(docs, *_automata(benchmark, window, block_words)).drop("mark")


def n_hit():
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with each span of words cut, from its first word's start to its last word's end."""
    if not spans:
        return text
    at = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return "".join([*out, text[done:]])


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    share: int = 20,
    cut: bool = False,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` without documents of which a ``share``-th of the words or more is hit.

    With ``cut``, spans of the other documents are cut from their texts (``n_chars`` follows, where
    there is one). All columns stay, whatever their names; rows are judged one by one, so null and
    repeated ids do no harm. A null text stays null and is never contaminated. Items of more than
    ``block_words`` words are dealt into blocks, each with a pass of its own over the texts.
    """
    blocks, make = _automata(benchmark, window, block_words)
    named = docs.schema

    def cleaned(batch: pa.RecordBatch, lists: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        columns, at = list(batch.columns), named.names.index("text")
        left = [t if t is None else without_spans(t, s) for t, s in zip(columns[at].to_pylist(), lists, strict=True)]
        columns[at] = pa.array(left, columns[at].type)
        if "n_chars" in named.names:
            i = named.names.index("n_chars")
            columns[i] = pa.array([None if t is None else len(t) for t in left]).cast(columns[i].type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    if blocks > 1:  # every block has its pass; what they found is looked up by document and text
        found = _judged(docs, blocks, make).where(F.size("items") > 0).dropDuplicates(["doc_id", "mark"])
        found = stored(found.withColumnsRenamed({"doc_id": "told", "mark": "of"}), "contaminated")
        same = F.col("id").eqNullSafe(F.col("told")) & (F.col("mark") == F.col("of"))
        bad = F.coalesce(F.lit(share) * n_hit() >= F.col("n_words"), F.lit(False))
        kept = boxed(docs).join(found, same, "left").where(~bad).select("row", "spans")
        if not cut:
            return kept.select("row.*")

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                own = pa.RecordBatch.from_arrays(whole.column("row").flatten(), names=named.names)
                lists = [[(x["start"], x["end"]) for x in spans or []] for spans in whole.column("spans").to_pylist()]
                yield cleaned(own, lists)

        return kept.mapInArrow(clean, named)

    part = make(0)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                keep, lists = [], []
                for text in batch.column("text").to_pylist():
                    sequence = words(text or "")
                    spans = part().matches(sequence)[0]
                    hit = sum(b - a for a, b in spans)
                    keep.append(not (hit and share * hit >= len(sequence)))
                    lists.append(spans)
                yield (cleaned(batch, lists) if cut else batch).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, named)
