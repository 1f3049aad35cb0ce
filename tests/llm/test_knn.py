import numpy as np
import pytest
from pyspark.sql import types as T

from draftsmith.llm.knn import bounds, groups_of, knn_join

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("cell", T.StringType()), T.StructField("g", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "c", "g") for i, v in rows], SCHEMA)


def plain(q_rows, rows, k):
    fine = [(i, np.floor(64 * np.asarray(v, dtype=np.float32).astype(float)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, v in q_rows:
        v = np.floor(64 * np.asarray(v, dtype=np.float32).astype(float)).astype(np.int64)
        best = sorted((-int(v @ w), i) for i, w in fine if i != q)[:k]
        out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def result(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in out.items()}


@pytest.mark.parametrize("per_group,per_task", [(2048, 16384), (3, 40)])
def test_against_brute_force(spark, per_group, per_task):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 8)) * 2
    rows = [(i, centers[i % 6] + rng.normal(size=8) * (0.1 if i % 2 else 1.0)) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)]  # one vector held by many rows
    data = frame(spark, rows)
    queries = [r for r in rows if r[0] % 20 == 0]
    got = result(knn_join(data.where("vec_id % 20 = 0"), data, k=20, pivots=12, queries_per_group=per_group, rows_per_task=per_task))
    assert got == plain(queries, rows, 20)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [-3.0, 0.5]), (7, [1.0]), (0, [1.0, 2.0])]
    data = frame(spark, rows)
    got = result(knn_join(data.where("vec_id = 0"), data, k=3))
    assert got == {0: [(1, 1, 64 * 64 * 5), (2, 7, 64 * 64), (3, 6, 64 * 64 * -2)]}
    assert knn_join(data.limit(0), data.limit(0)).count() == 0
    assert knn_join(data.where("vec_id = 2"), data).count() == 0
    assert knn_join(data.where("vec_id = 0"), data.where("vec_id = 2")).count() == 0


@pytest.mark.parametrize("per_task", [16384, 4])
def test_an_id_of_many_rows(spark, per_task):
    # equal norms, each vector a pivot of its own: the nearest rows of the query are all its own
    points = [(5, 0), (3, 4), (4, 3), (0, 5), (-3, 4), (-4, 3), (-5, 0), (3, -4), (4, -3), (0, -5), (-3, -4), (-4, -3)]
    rows = list(enumerate(points)) + [(0, points[0])] * 30
    rows += [(20 + i % 2, points[1 + i]) for i in range(8)] + [(0, points[6])]  # ids with rows in several cells
    data = frame(spark, rows)
    for k in (3, 10):
        got = result(knn_join(data.where("vec_id = 0 AND embedding[0] = 5"), data, k=k, pivots=12, rows_per_task=per_task))
        assert got == plain([rows[0]], rows, k)


def test_large_components(spark):
    rows = [(i, [float(2**22 + i * 1000), float(-(2**21))]) for i in range(12)]
    data = frame(spark, rows)
    assert result(knn_join(data.where("vec_id % 5 = 0"), data, k=4)) == plain([r for r in rows if r[0] % 5 == 0], rows, 4)


def test_bounds_need_enough_rows():
    assert np.isinf(bounds(np.zeros((2, 2)), {0: 1.0}, [(0, 0.5)], 1)).all()
    assert bounds(np.array([[0.0, 3.0], [3.0, 0.0]]), {0: 1.0}, [(0, 0.5), (1, 0.25)], 1)[0] == 4.25


def test_groups_split_large_cells():
    g = groups_of(np.array([[0.0, 1, 5], [1, 0, 5], [5, 5, 0]]), {0: 3, 1: 4, 2: 25}, 10)
    assert g[0] == g[1] and g[2][1] == 3 and g[2][0] != g[0][0]
