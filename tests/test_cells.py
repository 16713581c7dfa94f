"""The index of cells gives the rows of the plain search, and leaves cells unread where vectors form groups."""

import numpy as np
import pytest

from casework.operators import cells, retrieve
from casework.session import scratch_path


def grouped(spark, groups=12, each=60, dim=8):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(groups, dim)) * 10
    points = (centres[:, None, :] + rng.normal(size=(groups, each, dim)) * 0.2).reshape(-1, dim)
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, embedding array<double>")


def rows(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_equals_plain_search(spark, metric):
    df = grouped(spark)
    queries, path = df.filter("id % 37 = 0"), scratch_path(spark, "cells")
    cells.write_cells(df, path, cells=12)
    plain = rows(retrieve.top_k(queries, df, 4, metric=metric))
    assert rows(cells.search_cells(queries, path, 4, metric, probes=1)) == plain
    assert rows(cells.search_cells(queries, path, 4, metric, probes=50)) == plain
    near = rows(cells.search_cells(queries, path, 4, metric, probes=3, exact=False))
    assert len(set(near) & set(plain)) >= 0.9 * len(plain)


def test_more_wanted_than_the_nearest_cells_hold(spark):
    df, path = grouped(spark, groups=6, each=5), scratch_path(spark, "cells")
    cells.write_cells(df, path, cells=6)
    assert rows(cells.search_cells(df.limit(3), path, 12, "l2", probes=1)) == rows(retrieve.top_k(df.limit(3), df, 12, metric="l2"))
    assert len(rows(cells.search_cells(df.limit(1), path, 99, "l2", probes=1))) == 30


def test_far_cells_are_not_matched(spark):
    df, path = grouped(spark), scratch_path(spark, "cells")
    cells.write_cells(df, path, cells=12)
    exact = cells.search_cells(df.filter("id = 5"), path, 4, "l2", probes=1)
    close = cells.search_cells(df.filter("id = 5"), path, 4, "l2", probes=1, exact=False)
    assert rows(exact) == rows(close)  # one cell holds all that can rank


def test_equal_vectors_nulls_and_empty_tables(spark):
    equal = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)] + [(99, None)], "id long, embedding array<double>")
    path = scratch_path(spark, "cells")
    cells.write_cells(equal, path, cells=5)
    assert [r[2] for r in rows(cells.search_cells(equal.filter("id in (3, 99)"), path, 3))] == [0, 1, 2]
    none, path = equal.limit(0), scratch_path(spark, "cells")
    cells.write_cells(none, path)
    assert cells.search_cells(equal, path, 3).collect() == []


def test_tiles_of_one_class_and_missing_classes(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(size=4)], None if i % 5 == 0 else f"c{i % 3}") for i in range(90)]
    df = spark.createDataFrame(data, "id long, embedding array<double>, label string")
    plain = rows(retrieve.top_k(df, df, 3, same="label", skip="id"))
    assert rows(retrieve.top_k(df, df, 3, same="label", skip="id", broadcast_queries=0, tile_rows=7)) == plain
