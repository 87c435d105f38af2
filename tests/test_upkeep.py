"""An index kept up by batches against one built at once."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reelgrid.operators.lexical import bm25_search, build_postings
from reelgrid.operators.vectors import vector_search
from reelgrid.plans import upkeep
from reelgrid.spreading import shared_dir
from reelgrid.workloads import load

SCHEMA = "media_id string, segment_id string, text string, start double"
WORDS = [f"w{i}" for i in range(60)]


def corpus(n, seed=0):
    """Segments of media items with one to six segments; some without text or without a word."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        for j in range(rng.randint(1, 6)):
            text = " ".join(rng.choices(WORDS, weights=range(60, 0, -1), k=rng.randint(0, 12)))
            out.append((f"m{i}", f"m{i}#{j}", rng.choice([text, text, text, "...", None]), float(j)))
    return out


def hits(queries, index, k=5):
    got = bm25_search(queries, index, k=k)
    return sorted((r.query_id, r["rank"], r.segment_id, round(r.raw_score, 9)) for r in got.collect())


@pytest.fixture()
def queries(rows):
    return rows([(i, " ".join(WORDS[i : i + 4])) for i in range(20)], "query_id bigint, text_query string")


def assert_equals_rebuilt(index, data):
    """All rows and figures of the index against those counted here from the segments."""
    docs = {d[1]: [w for w in re.sub(r"[^a-z0-9 ]", "", d[2]).split() if w] for d in data if d[2] and d[2].strip()}
    held = Counter(w for words in docs.values() for w in set(words))
    raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in held.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    assert sorted((r.token, r.df, round(r.idf, 9)) for r in index.lexical.idf.collect()) == sorted(
        (w, n, round(raw[w] if raw[w] >= 0 else floor, 9)) for w, n in held.items()
    )
    assert sorted((r.token, r.segment_id, r.tf, r.doc_len) for r in index.lexical.entries.collect()) == sorted(
        (w, s, n, len(words)) for s, words in docs.items() for w, n in Counter(words).items()
    )
    n_docs, avg_len = index.lexical.corpus.first()
    assert n_docs == len(docs) and avg_len == pytest.approx(sum(map(len, docs.values())) / len(docs))
    assert sorted(r.segment_id for r in index.segments.select("segment_id").collect()) == sorted(d[1] for d in data)


def test_batches_equal_a_rebuilt_index(spark, rows, queries, tmp_path):
    path = str(tmp_path / "index")
    data = corpus(100)
    of = lambda lo, hi: [d for d in data if lo <= int(d[0][1:]) < hi]
    assert upkeep.commit(spark, path, rows(of(0, 90), SCHEMA)) == 1
    assert upkeep.commit(spark, path, rows(of(90, 100), SCHEMA)) == 2
    gone = [(f"m{i}",) for i in (*range(0, 100, 20), 999)]
    assert upkeep.commit(spark, path, removed=rows(gone, "media_id string")) == 3
    left = [d for d in data if (d[0],) not in gone]
    index = upkeep.read_index(spark, path)
    assert_equals_rebuilt(index, left)
    assert hits(queries, index.lexical) == hits(queries, build_postings(rows(left, SCHEMA)))
    # an earlier version stays as it was
    assert_equals_rebuilt(upkeep.read_index(spark, path, 1), of(0, 90))
    # replaced media items: another text, other segments
    fresh = [("m1", "m1#0", "w1 w2 new", 0.0), ("m0", "m0#7", "w0 back again", 7.0)]
    upkeep.commit(spark, path, rows(fresh, SCHEMA))
    left = [d for d in left if d[0] != "m1"] + fresh
    # merging everything changes no row, and needs no mark any more
    upkeep.compact(spark, path, dead_share=-1.0)
    state = upkeep.manifest(spark, path)
    assert len(state["parts"]) == 1 and state["marks"] == []
    # old versions go, the last one stays whole
    assert upkeep.vacuum(spark, path, keep=1) > 0 and upkeep.versions(spark, path) == [state["version"]]
    assert_equals_rebuilt(upkeep.read_index(spark, path), left)
    with pytest.raises(ValueError):
        upkeep.read_index(spark, path, 1)


def test_some_parts_are_merged_while_marks_of_others_count(spark, rows, tmp_path):
    path = str(tmp_path / "index")
    data = corpus(64, seed=1)
    of = lambda lo, hi: [d for d in data if lo <= int(d[0][1:]) < hi]
    upkeep.commit(spark, path, rows(of(0, 52), SCHEMA))
    for lo in range(52, 64, 4):
        upkeep.commit(spark, path, rows(of(lo, lo + 4), SCHEMA))
    upkeep.commit(spark, path, removed=rows([("m3",), ("m53",), ("m60",)], "media_id string"))
    upkeep.compact(spark, path, fanin=2, dead_share=0.9)
    state = upkeep.manifest(spark, path)
    assert [p["part"] for p in state["parts"]] == [1, 6] and state["marks"] == [5]
    left = [d for d in data if d[0] not in ("m3", "m53", "m60")]
    assert_equals_rebuilt(upkeep.read_index(spark, path), left)


def test_a_commit_that_was_cut_off_is_done_again(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    data = corpus(20, seed=2)
    upkeep.commit(spark, path, rows(data, SCHEMA))
    with monkeypatch.context() as patched:
        patched.setattr(upkeep, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            upkeep.commit(spark, path, rows([("m0", "m0#0", "half done", 0.0)], SCHEMA))
    assert upkeep.manifest(spark, path)["version"] == 1
    fresh = [("m2", "m2#0", "w5 whole", 0.0)]
    assert upkeep.commit(spark, path, rows(fresh, SCHEMA)) == 2
    assert_equals_rebuilt(upkeep.read_index(spark, path), [d for d in data if d[0] != "m2"] + fresh)


def test_vectors_follow_their_media_items(spark, rows, tmp_path):
    path = str(tmp_path / "index")
    schema = "segment_id string, modality string, embedding array<float>"
    rng = random.Random(3)
    data = [(f"m{i}", f"m{i}#0", "w1", 0.0) for i in range(30)]
    held = [(d[1], m, [rng.uniform(-1, 1) for _ in range(8)]) for d in data for m in ("visual", "audio")]
    upkeep.commit(spark, path, rows(data[:25], SCHEMA), rows(held[:50], schema))
    upkeep.commit(spark, path, rows(data[25:], SCHEMA), rows(held[50:], schema))
    upkeep.commit(spark, path, removed=rows([("m4",), ("m27",)], "media_id string"))
    left = [h for h in held if h[0] not in ("m4#0", "m27#0")]
    asked = rows([(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(6)], "query_id bigint, embedding array<float>")
    for _ in range(2):
        index = upkeep.read_index(spark, path)
        assert sorted((r.segment_id, r.modality) for r in index.vectors.collect()) == sorted(h[:2] for h in left)
        got, expected = (
            sorted((r.query_id, r["rank"], r.segment_id) for r in vector_search(asked, v.where("modality = 'visual'"), "visual", k=4).collect())
            for v in (index.vectors, rows(left, schema))
        )
        assert got == expected
        upkeep.compact(spark, path, dead_share=-1.0)


def test_empty_indexes_and_batches(spark, rows, queries, tmp_path):
    path = str(tmp_path / "index")
    assert hits(queries, upkeep.read_index(spark, path).lexical) == []
    media = rows([("m0",)], "media_id string")
    assert upkeep.pending(media, path).count() == 1
    upkeep.commit(spark, path, rows([], SCHEMA), removed=media)
    assert upkeep.read_index(spark, path).segments.count() == 0
    upkeep.commit(spark, path, rows([("m0", "m0#0", "w1", 0.0)], SCHEMA))
    assert upkeep.pending(media, path).count() == 0
    upkeep.commit(spark, path, removed=media)
    assert upkeep.manifest(spark, path)["parts"] == [] and upkeep.pending(media, path).count() == 1


def test_few_words_reach_the_scan(spark, rows, tmp_path):
    path = str(tmp_path / "index")
    upkeep.commit(spark, path, rows(corpus(30), SCHEMA))
    upkeep.commit(spark, path, removed=rows([("m1",)], "media_id string"))
    index = upkeep.read_index(spark, path).lexical
    for table in (index.entries, index.idf):
        plan = table.where(F.col("token").isin("w1", "w2"))._jdf.queryExecution().executedPlan().toString()
        assert "In(token, [w1,w2])" in plan


def test_size_classes():
    part = lambda n, docs, dead=0: {"part": n, "docs": docs, "dead": dead}
    assert upkeep.victims({"parts": [part(1, 1000), part(2, 10), part(3, 12)]}) == []
    assert upkeep.victims({"parts": [part(1, 1000), *[part(n, 8 + n) for n in range(2, 6)]]}) == [2, 3, 4, 5]
    assert upkeep.victims({"parts": [part(1, 1000, 251), part(2, 10, 2)]}) == [1]
    assert upkeep.victims({"parts": [part(1, 1000), part(2, 10)]}, dead_share=-1.0) == [1, 2]
    with pytest.raises(ValueError):
        upkeep.victims({"parts": []}, fanin=1)


def test_a_stream_of_media_is_ingested_once(spark, rows, tmp_path):
    path, feed = str(tmp_path / "index"), str(tmp_path / "in")
    data = corpus(24, seed=4)
    table = rows(data, SCHEMA)

    def run():
        media = spark.readStream.schema("media_id string").option("maxFilesPerTrigger", 1).parquet(feed)
        make = lambda new: (table.join(new, "media_id", "left_semi"), None)
        stream = upkeep.index_stream(media, make, path, "feed", compact_every=2)
        stream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    names = [f"m{i}" for i in range(24)]
    rows([(m,) for m in names[:12]], "media_id string").repartition(3).write.parquet(feed)
    run()
    # rows come again beside new ones, and the stream's own notes of its last batch are lost
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    before = upkeep.manifest(spark, path)["version"]
    run()
    assert upkeep.manifest(spark, path)["version"] in (before, before + 1)  # at most a merge, no batch twice
    rows([(m,) for m in names[6:]], "media_id string").coalesce(1).write.mode("append").parquet(feed)
    run()
    assert_equals_rebuilt(upkeep.read_index(spark, path), data)


def test_marks_that_are_too_many_to_send_and_files_too_many_to_name(spark, rows, tmp_path, monkeypatch):
    data = corpus(40, seed=5)
    for n, limits in enumerate(({"fits": lambda _: False, "SENT_FILES": 0}, {"SENT_MARKS": 2}, {})):
        path = str(tmp_path / f"index{n}")
        with monkeypatch.context() as patched:
            for name, value in limits.items():
                patched.setattr(upkeep, name, value)
            upkeep.commit(spark, path, rows(data, SCHEMA).repartition(4))
            fresh = [(f"m{i}", f"m{i}#0", f"w{i} again", 0.0) for i in range(0, 40, 4)]
            upkeep.commit(spark, path, rows(fresh, SCHEMA), removed=rows([("m1",), ("m2",)], "media_id string"))
            left = [d for d in data if d[0] not in {"m1", "m2"} | {f[0] for f in fresh}] + fresh
            assert_equals_rebuilt(upkeep.read_index(spark, path), left)
            upkeep.compact(spark, path, dead_share=0.2)
            assert_equals_rebuilt(upkeep.read_index(spark, path), left)


def test_dead_media_are_read_from_the_files_that_hold_them(spark, rows, tmp_path):
    path = str(tmp_path / "index")
    upkeep.commit(spark, path, rows(corpus(40, seed=6), SCHEMA).repartitionByRange(4, "media_id"))
    gone = rows([("m7", 1)], "media_id string, part bigint")
    read = upkeep._segments_of(spark, path, gone, [1])
    assert len(read.inputFiles()) == 1 and read.where("media_id = 'm7'").count() == sum(d[0] == "m7" for d in corpus(40, seed=6))


def test_the_query_keeps_what_the_last_version_reads_and_no_copy(spark, rows, tmp_path):
    """Texts are not stored beside the index, nor are parts that no version reads, postings, or packed entries."""
    rng = random.Random(7)
    texts = [(i, " ".join(rng.choices(WORDS, k=20))) for i in range(60)]
    rows(texts, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows([(0, "w1 w2"), (1, "w3")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = Path(shared_dir(spark).removeprefix("file://")) / "reelgrid" / spark.sparkContext.applicationId
    before = set(kept.glob("*"))
    found = load()[0]["index_upkeep"](spark, str(tmp_path))
    whole = bm25_search(rows([(0, "w1 w2"), (1, "w3")], "query_id bigint, text_query string"), build_postings(rows(texts, "segment_id bigint, text string")), k=5)
    assert sorted((r.query_id, r["rank"], r.segment_id) for r in found.collect()) == sorted((r.query_id, r["rank"], r.segment_id) for r in whole.collect())
    left = {p.name.split("-")[0]: p for p in set(kept.glob("*")) - before}
    assert "media" not in left
    parts = {t: sorted(p.name for p in (left["upkeep"] / t).glob("part=*")) for t in ("segments", "entries", "media", "runs", "postings")}
    live = ["part=2", "part=4", "part=5"]
    assert parts == {"segments": live, "entries": live, "media": live, "runs": [], "postings": []}
