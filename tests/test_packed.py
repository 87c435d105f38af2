"""Index entries that are moved in packed form against the same entries as rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from reelgrid.operators.packed import ORDER, pack_entries, pack_postings, range_bounds, unpack

WORDS = [f"w{i}" for i in range(40)] + ["é", "字", "\U0001f600", "z"]


def postings(rows, kind, n=300, seed=0):
    """Documents of which all hold the first word; some hold nothing, some come twice, some ids are missing."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = sorted({WORDS[0], *rng.choices(WORDS, k=rng.randint(0, 30))}) if i % 10 else []
        segment = None if i % 17 == 0 else (i if kind == "bigint" else f"s{i}")
        out += [(f"m{i // 3}", segment, len(words), [(w, rng.randint(1, 5)) for w in words])] * (2 if i % 13 == 0 else 1)
    return rows(out, f"media_id string, segment_id {kind}, doc_len int, terms array<struct<token: string, tf: int>>")


def plain(df):
    return sorted(((r.token, r.media_id, r.segment_id, r.doc_len, r.tf) for r in df.collect()), key=repr)


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_packed_entries_are_the_entries(spark, rows, kind):
    made = postings(rows, kind).repartition(5)
    entries = made.select("media_id", "segment_id", "doc_len", F.inline_outer("terms")).where("token is not null")
    bounds = range_bounds(entries, 30)
    assert len(bounds) == 29 and sum(token == WORDS[0] for token, _ in bounds) >= 1  # the common word is cut
    packed = pack_postings(made, bounds)
    assert sorted(map(tuple, packed.select(F.inline("lengths")).collect())) == sorted(map(tuple, made.select("media_id", "doc_len").collect()))
    for form in (packed, pack_entries(entries, bounds)):
        found = unpack(form, 30, kind)
        assert found.columns == ["media_id", "segment_id", "doc_len", "token", "tf"]
        assert plain(found) == plain(entries)
        tasks = found.select(*ORDER).rdd.glom().collect()
        place = lambda r: (r.token, r.media_id, r.segment_id is None, r.segment_id)
        in_order = [place(r) for task in tasks for r in task]
        assert len(tasks) == 30 and in_order == sorted(in_order)
        assert max(map(len, tasks)) <= 2 * len(in_order) / 30


def test_no_document_or_none_with_a_word(spark, rows):
    schema = "media_id string, segment_id string, doc_len int, terms array<struct<token: string, tf: int>>"
    for data in ([], [("m0", "s0", 0, [])]):
        made = rows(data, schema)
        entries = made.select("media_id", "segment_id", "doc_len", F.inline_outer("terms")).where("token is not null")
        assert range_bounds(entries, 4) == []
        packed = pack_postings(made, [])
        assert unpack(packed, 4, "string").count() == 0 and unpack(pack_entries(entries, []), 4, "string").count() == 0
        assert packed.select(F.inline("lengths")).count() == len(data)


def test_a_share_takes_a_few_bytes_an_entry(spark, rows):
    rng = random.Random(1)
    data = [(f"media-{i}", i, 200, [(f"word{w}", 1) for w in sorted(rng.sample(range(2000), 200))]) for i in range(1000)]
    made = rows(data, "media_id string, segment_id bigint, doc_len int, terms array<struct<token: string, tf: int>>").coalesce(2)
    entries = made.select("media_id", "segment_id", "doc_len", F.inline("terms"))
    packed = pack_postings(made, range_bounds(entries, 4))
    assert packed.agg(F.sum(F.length("entries"))).first()[0] < 4 * 200_000  # rows take about 15 bytes in a shuffle
