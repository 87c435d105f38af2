"""Vector search by cells: equal to the plain search, with cells left out exactly."""

from __future__ import annotations

import re

import numpy as np
import pytest
from conftest import collect
from pyspark.sql import functions as F

from reelgrid.operators import cells
from reelgrid.operators.vectors import vector_search

SCHEMA = "segment_id string, embedding array<double>"
ASKED = "query_id string, embedding array<double>"


def clustered(seed, many=600, centres=12, width=8, spread=0.05):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centres, width))
    rows = middle[draw.integers(centres, size=many)] + draw.normal(size=(many, width)) * spread
    return rows * draw.uniform(0.5, 2.0, size=(many, 1)), middle


def shown(df):
    return collect(df.withColumns({c: F.round(c, 7) for c in ("similarity", "score")}))


@pytest.fixture(scope="module")
def tables(spark):
    x, middle = clustered(1)
    held = [(f"s{i:04}", v.tolist()) for i, v in enumerate(x)]
    held += [("s0001", x[1].tolist()), ("zero", [0.0] * 8), ("zero2", [0.0] * 8), ("none", None), ("empty", [])]
    held += [(f"w{i}", [float(i), 1.0]) for i in range(5)] + [("lone", [1.0, 2.0, 3.0])]
    asked = [(f"q{i}", m.tolist()) for i, m in enumerate(middle[:4])]
    asked += [("q0", middle[5].tolist()), ("opposite", (-middle[0]).tolist()), ("nothing", [0.0] * 8), ("two", [1.0, -1.0]), ("three", [1.0, 0.0, 0.0]), ("four", [1.0] * 4)]
    return spark.createDataFrame(held, SCHEMA), spark.createDataFrame(asked, ASKED)


@pytest.mark.parametrize("k, n_cells, block", [(1, 12, 8192), (7, 40, 8192), (7, 12, 16), (100, 12, 8192), (2000, 3, 50)])
def test_cells_find_what_the_plain_search_finds(tables, k, n_cells, block):
    held, asked = tables
    index = cells.build_cells(held, n_cells)
    assert shown(cells.search_cells(asked, index, "visual", k=k, block=block)) == shown(vector_search(asked, held, "visual", k=k))


def test_random_vectors_and_more_queries(spark):
    draw = np.random.default_rng(4)
    held = spark.createDataFrame([(f"s{i}", draw.normal(size=6).tolist()) for i in range(300)], SCHEMA)
    asked = spark.createDataFrame([(f"q{i}", draw.normal(size=6).tolist()) for i in range(150)], ASKED)
    index = cells.build_cells(held, 30)
    assert shown(cells.search_cells(asked, index, "visual", k=4)) == shown(vector_search(asked, held, "visual", k=4))


def test_most_cells_are_left_out(spark, tables, tmp_path):
    held, asked = tables
    near = asked.where("query_id in ('q1', 'q2')")
    index = cells.build_cells(held, 40)
    own = index.cells.where("dim = 8").count()
    visits = cells.visits_of(near, index, k=5).collect()
    assert len({(r["query_id"], r["cell"]) for r in visits}) == len(visits) < 0.5 * 2 * own
    assert {r["query_id"] for r in visits if r["first"]} == {"q1", "q2"}
    cells.write_cells(index, str(tmp_path / "cells"))
    again = cells.read_cells(spark, str(tmp_path / "cells"))
    visited = sorted({r["cell"] for r in visits})
    plan = again.entries.where(F.col("cell").isin(visited))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\n]*cell#", plan)  # folders of other cells are not opened
    assert shown(cells.search_cells(near, again, "visual", k=5)) == shown(vector_search(near, held, "visual", k=5))


def test_bounds_hold(tables):
    held, _ = tables
    index = cells.build_cells(held, 25)
    bounds, draw = cells._bounds(index.cells), np.random.default_rng(8)
    members = index.entries.where(F.size("embedding") == 8).toPandas()
    q = draw.normal(size=(50, 8)) * draw.uniform(0.1, 5, size=(50, 1))
    most = bounds[8].of(q)
    place = {c: i for i, c in enumerate(bounds[8].cell.tolist())}
    products = q @ np.array(members["embedding"].tolist()).T
    assert (products <= most[:, [place[c] for c in members["cell"]]]).all()


def test_jobs_do_not_grow_with_queries(spark, tables):
    held, _ = tables
    index = cells.build_cells(held, 12)
    x, _ = clustered(2, many=400)
    seen = []
    for many in (5, 400):
        asked = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(x[:many])], ASKED)
        spark.sparkContext.setJobGroup(f"cells-{many}", "")
        cells.search_cells(asked, index, "visual", k=3).count()
        seen.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"cells-{many}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert seen[1] <= seen[0] + 4  # adaptive stages may differ, blocks of queries do not add jobs


def test_nothing_held_or_asked(spark, tables):
    held, asked = tables
    none = spark.createDataFrame([], SCHEMA)
    assert cells.search_cells(asked, cells.build_cells(none), "visual").collect() == []
    assert cells.search_cells(spark.createDataFrame([], ASKED), cells.build_cells(held, 5), "visual").collect() == []
    odd = spark.createDataFrame([("nan", [float("nan"), 1.0]), ("inf", [float("inf"), 1.0]), ("null", [None, 1.0]), ("ok", [1.0, 1.0])], SCHEMA)
    assert [r["segment_id"] for r in cells.build_cells(odd).entries.collect()] == ["ok"]
