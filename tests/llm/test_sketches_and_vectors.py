"""Brute force and hand cases for set sketches, vector codes and hard negatives."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrid.llm import hard_negatives, integers, setsketch, vector_codes
from reelgrid.spreading import stored

DOCS = "doc_id bigint, text string, row int, key string, n string, items int, component_id int"
VECS = "vec_id bigint, embedding array<float>, label int, code int, v string, vec int, anchor int"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, 1, "k", "n", 2, None) for i, t in texts], DOCS)


def vecs_of(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "v", 2, None) for i, v, y in rows], VECS)


# --- set sketches -----------------------------------------------------------------------------------


def shingle_set(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def grouped(texts):
    """Component of each row by comparing all pairs."""
    sets = [shingle_set(t) for _, t in texts]
    part = list(range(len(texts)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 85 * len(a | sets[j]):
                part[root(i)] = root(j)
    lowest = {}
    for i, (doc_id, _) in enumerate(texts):
        if doc_id is not None:
            lowest[root(i)] = min(lowest.get(root(i), doc_id), doc_id)
    return sorted(
        ((d, len(s), lowest.get(root(i)), d == lowest.get(root(i))) for i, ((d, _), s) in enumerate(zip(texts, sets, strict=True))),
        key=repr,
    )


def answered(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def families(seed, many=6, size=9, words=120, changes=14):
    """Texts that drift away from each other in steps, so that links chain and some pairs lie just apart."""
    draw, out = random.Random(seed), []
    for f in range(many):
        text = [f"w{draw.randrange(4000)}" for _ in range(words)]
        for _ in range(size):
            out.append(" ".join(text))
            for _ in range(draw.randrange(changes)):
                text[draw.randrange(words)] = f"x{draw.randrange(4000)}"
    draw.shuffle(out)
    return [(i * 3, t) for i, t in enumerate(out)]


ODD = ["", None, " \t\n", "one", "ONE", "one two", "one two three", "a\x0bb\x0cc\rd", "É é É", "no\xa0break here", "z " * 3000, "z " * 9]


def test_sets_of_awkward_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "one"), (None, "one"), (None, "alone here now"), (None, None), (2, "one")]
    assert answered(setsketch.near_duplicates(docs_of(spark, rows))) == grouped(rows)
    assert answered(setsketch.near_duplicates(docs_of(spark, []))) == []
    none = [(1, None), (2, "")]
    assert answered(setsketch.near_duplicates(docs_of(spark, none))) == grouped(none)


def test_sets_equal_brute_force(spark):
    rows = families(1) + [(1000 + i, t) for i, (_, t) in enumerate(families(1)[:20])]
    found = answered(setsketch.near_duplicates(docs_of(spark, rows)))
    assert found == grouped(rows)
    assert len({r[2] for r in found}) < len(found) - 20


@pytest.mark.parametrize("rows, weight", [(5, 10**6), (1000, 400), (1000, 10**6)])
def test_members_that_are_not_first_meet_in_blocks(spark, monkeypatch, rows, weight):
    """All texts in one bucket: only the blocks can find the links of those far from its first member."""

    def one_bucket(reps):
        first = reps.agg(F.min("row").alias("first"))
        return reps.select(F.lit(7).cast("bigint").alias("band"), "row").crossJoin(first).select("band", "first", "row")

    def alike_in_band_0(docs, size):
        kept = F.substring("registers", 9, 248)
        return made(docs, size).withColumn("registers", F.concat(F.lit(b"\7" * 8), kept))

    made = setsketch.sketches
    monkeypatch.setattr(setsketch, "sketches", alike_in_band_0)
    monkeypatch.setattr(setsketch, "buckets", one_bucket)
    texts = families(2, many=5, size=8)
    found = answered(setsketch.near_duplicates(docs_of(spark, texts), rows=rows, weight=weight))
    assert found == grouped(texts)
    monkeypatch.setattr(setsketch, "_links_left", lambda *a: None)
    assert answered(setsketch.near_duplicates(docs_of(spark, texts))) != grouped(texts)


def test_members_of_buckets_are_shuffled_once(spark):
    """Also where the buckets are too many to send, so that they meet their members in a shuffle join."""
    texts = families(3, many=5, size=8)
    reps = stored(setsketch.sketches(docs_of(spark, texts), 3).where("n > 0"), "sketches")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = setsketch.buckets(reps)
        told = answered(found)
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Generate explode") == 1 and "ReusedExchange" in plan
    assert told == answered(setsketch.buckets(reps))
    members = {}
    for band, first, row in told:
        members.setdefault((band, first), set()).add(row)
    assert members and all(first in rows and len(rows) > 1 for (_, first), rows in members.items())
    assert len({frozenset(rows) for rows in members.values()}) == len(members)


def test_registers_are_mergeable_and_tell_similarity():
    draw = np.random.default_rng(5)
    for n in (1, 7, 200, 3000):
        for j in (0.5, 0.85):
            shared = round(2 * n * j / (1 + j))
            all_ = draw.integers(0, 2**63, (40, 2 * n - shared)).astype(np.uint64)
            a, b = setsketch.registers(list(all_[:, :n])), setsketch.registers(list(np.concatenate((all_[:, :shared], all_[:, n:]), axis=1)))
            assert (setsketch.registers(list(all_)) == setsketch.merged(a, b)).all()
            true, size = shared / (2 * n - shared), np.full(40, float(n))
            told, _ = setsketch.estimate((a > b).sum(1), (a < b).sum(1), size, size, 0.85)
            assert abs(told.mean() - true) < 0.04
            assert setsketch.plausible(a, b, size, size, true).all()
    assert not setsketch.registers([np.zeros(0, np.uint64)]).any()


def test_likelihood_is_the_greatest_there_is():
    best, fall = setsketch.estimate(np.array([20]), np.array([9]), np.array([110.0]), np.array([100.0]), 0.95)
    every = np.linspace(0, 100 / 110, 4001)
    u = 110 / 210
    p, q = setsketch._above(u - (1 - u) * every), setsketch._above(1 - u - u * every)
    told = 20 * np.log(p) + 9 * np.log(q) + 99 * np.log(1 - p - q)
    assert abs(best[0] - every[told.argmax()]) < 1e-3
    assert abs(fall[0] - (told.max() - told[-1])) < 1e-3  # 0.95 is beyond what the sizes allow


# --- vector codes -----------------------------------------------------------------------------------


def coded(rows, parts=8, entries=16, rounds=6):
    """Codes by measuring every entry, in Python's whole numbers."""
    kept = [(i, [math.floor(4096 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((r for r in kept if r[0] is not None), key=lambda r: r[0])[:entries]
    width = len(seeds[0][1]) // parts
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]
    books = [[cut(s[1])[p] for s in seeds] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, v, _ in kept:
                held.setdefault(near(p, cut(v)[p])[1], []).append(cut(v)[p])
            for k, own in held.items():
                books[p][k] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    out = []
    for i, v, y in kept:
        told = [near(p, cut(v)[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in told), sum(d for d, _ in told), y))
    sums = {}
    for _, _, e, y in out:
        sums[y] = sums.get(y, 0) + e
    flat = np.array([x for b in books for e in b for x in e], dtype=object)
    return sorted(((i, c, e, sums[y], vector_codes.books_sha256(flat)) for i, c, e, y in out), key=repr)


def random_vectors(seed, many, width=16, spread=1.0):
    draw = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.float32(draw.normal(size=width) * spread)], int(draw.integers(4))) for i in range(many)]
    return rows


def test_codes_equal_brute_force(spark):
    rows = random_vectors(3, 150)
    rows += [(200 + i, v, None) for i, (_, v, _) in enumerate(rows[:9])] + [(3, rows[3][1], 1), (None, rows[5][1], 2)]
    rows += [(-1, None, 1), (-2, [None] * 16, 1), (-3, [math.nan] * 16, 1), (-4, [math.inf] + [0.0] * 15, 1)]
    rows += [(300, [0.25] * 16, 1)] * 3  # a tie of several rows
    assert answered(vector_codes.compress(vecs_of(spark, rows))) == coded(rows)


def test_codes_of_few_odd_and_no_rows(spark):
    few = random_vectors(4, 5)
    assert answered(vector_codes.compress(vecs_of(spark, few))) == coded(few)
    assert answered(vector_codes.compress(vecs_of(spark, []))) == []
    odd = [*few, (50, [1.0, 2.0], 1), (51, [], 2), (52, [5e30] * 16, 3)]
    found = {r["vec_id"]: r for r in vector_codes.compress(vecs_of(spark, odd)).collect()}
    assert len(found) == 8
    assert found[50]["code"] is None and found[51]["error"] is None  # other widths
    assert found[52]["error"] >= 0 and len(found[52]["code"]) == 16  # stops at the bound
    unknown = [(None, v, y) for _, v, y in few]
    assert {r["code"] for r in vector_codes.compress(vecs_of(spark, unknown)).collect()} == {None}


@pytest.mark.parametrize("entries, width", [(16, 8), (64, 3), (100, 2), (1, 4)])
def test_masks_hold_the_nearest_entry(entries, width):
    draw = np.random.default_rng(entries)
    book = draw.integers(-40, 40, (entries, width))
    book[-1] = book[0]  # a tie goes to the lower index
    x = np.concatenate((draw.integers(-60, 60, (500, width)), book))
    slices = vector_codes.Slices(book)
    index, away = slices.nearest(x)
    every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (away == every.min(axis=1)).all()
    bits = sum(np.bitwise_count(slices.candidates(x)[:, w]).sum() for w in range(-(-entries // 64)))
    assert bits < len(x) * entries or entries == 1  # some entries were ruled out by the masks


# --- hard negatives ---------------------------------------------------------------------------------


def mined(rows):
    kept = []
    for i, v, y in rows:
        if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v], math.fmod(y + 1, 10) if i % 7 == 0 else y))
    out = []
    anchors = {(i, tuple(v), y) for i, v, y in kept if i % 50 == 0 and v}
    for a, q, label in anchors:
        told = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, y) for i, v, y in kept if i != a and len(v) == len(q))
        for s, p, _ in [t for t in told if t[2] == label][:5]:
            hard = [t for t in told if t[2] != label and 50 * -s <= 100 * -t[0] <= 95 * -s][:3]
            out += [(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(hard, 1)]
    return sorted(out, key=repr)


def unit(rows):
    return [(i, [float(np.float32(x / max(1e-9, math.sqrt(sum(y * y for y in v))))) for x in v], y) for i, v, y in rows]


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    rows = unit(random_vectors(6, 400, width=6))
    rows += [(1000 + i, v, (y + 1) % 4) for i, (_, v, y) in enumerate(rows[:60])]  # equal scores
    rows += [(150, [0.5] * 6, 2), (50, *rows[50][1:]), (7, rows[8][1], 1)]  # an id, an anchor and a row again
    rows += [(2000, [0.0] * 6, 1), (2001, [0.0] * 6, 1), (2002, [0.0] * 6, 2), (2050, [-0.5] * 6, -3)]
    rows += [(None, rows[0][1], 1), (2100, None, 1), (2150, rows[1][1], None), (2200, [math.nan] * 6, 1), (2250, [], 1)]
    rows += [(3000, [0.1, 0.2], 1), (3001, [0.1, 0.3], 1), (3002, [0.1, 0.25], 2)]  # another width
    want = mined(rows)
    assert want
    assert answered(hard_negatives.hard_negatives(vecs_of(spark, rows))) == want
    monkeypatch.setattr(hard_negatives, "CHUNK", 37)
    assert answered(hard_negatives.hard_negatives(vecs_of(spark, rows), block=4)) == want
    assert answered(hard_negatives.hard_negatives(vecs_of(spark, []))) == []
    assert answered(hard_negatives.hard_negatives(vecs_of(spark, rows[1:40]))) == []  # no anchor


def test_the_threshold_stops_before_all_rows_are_met():
    draw = np.random.default_rng(9)
    x = (draw.normal(size=(3000, 3)) * 200).astype(np.int64)
    lists = hard_negatives.Lists(np.arange(3000), np.zeros(3000, np.int64), x)
    for q in x[:20]:
        best = hard_negatives.Best(5)
        met = hard_negatives.scan(lists, q, lists.thresholds(q[None])[0], [best], np.ones(3000, bool))
        every = x @ q
        order = np.lexsort((np.arange(3000), -every))[:5]
        assert (best.ids == order).all() and (best.scores == every[order]).all()
        assert met < 3000


def test_whole_numbers_go_down_and_stop_at_the_bound(spark):
    rows = [(1, [-0.1, 0.99, 1e30], 0), (2, None, 0), (3, [1.0, None, 0.0], 0)]
    found = integers.integer_vectors(vecs_of(spark, rows), 256).collect()
    assert [np.frombuffer(bytes(r["vec"]), "<i4").tolist() for r in found] == [[-26, 253, integers.LIMIT]]


def test_what_is_wide_moves_once_to_blocks_of_a_star(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "STAR", 4)
    pairs = [(0, i) for i in range(1, 30)] + [(5, 6), (40, 6)]
    wide = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "row bigint, text string")
    found = setsketch._paired(spark.createDataFrame(pairs, "first bigint, row bigint"), wide)
    assert sorted((r["first"], r.row, r.a.text, r.b.text) for r in found.collect()) == sorted((a, b, f"t{a}", f"t{b}") for a, b in pairs)
