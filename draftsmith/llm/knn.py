"""Exact top-k search as a Voronoi kNN join.

Scores are integer inner products of vectors quantised to ``floor(scale * x)``.
The largest inner product is the nearest neighbour once data vectors get one
more component that brings them all to the same length (queries get zero
there), so Voronoi bounds apply:

1. ``pivots`` vectors (a fixed number, smallest by hash) cut the space into
   cells; every vector goes to its nearest pivot.
2. Per cell a summary is kept: the largest distance of a query to its pivot,
   and the ``k + 1`` smallest distances of data vectors to theirs, of one row an
   id, its nearest (one more, as no row of a query's own id counts; other rows
   of an id can only bring neighbours nearer).  From these the triangle inequality gives
   every query cell an upper bound on the distance of its k-th neighbour.
3. A data vector is sent to a query cell only if the triangle inequality does
   not put it beyond that bound.
4. Cells that lie close are solved together, each (cell group, share of the
   data sent to it) in one task; the partial top-k lists are merged.

On Spark: the summaries are aggregates of at most ``pivots * (k + 1)`` rows
(the only thing the driver reads besides three numbers and the pivots), after
one aggregate by id that is combined before its shuffle; data sent to a group is
salted by row number into shares of ``rows_per_task`` rows, a cell with more
than ``queries_per_group`` queries is split, so neither a vector nor an id that
a third of all rows hold makes a large task.

Defined results: vectors that are null or hold null or non-finite components
take no part; shorter vectors count as padded with zeros; rows with a null id
are not candidates or queries; repeated data rows are candidates each, repeated
query rows are one query; fewer than ``k`` candidates give as many rows; a
quantised vector whose squared length does not fit a long raises an error; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftsmith.session import checkpoint_dir

_RESULT = "query_id long, rank int, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``(id, v array<long>, norm)`` of the vectors that take part."""
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = x.where(F.col("id").isNotNull() & F.col("x").isNotNull()).where(fine)
    x = x.select("id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))
    return x.withColumn("norm", F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c))


def _matrix(v: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(v), dim), dtype=np.int64)
    for i, row in enumerate(v):
        out[i, : len(row)] = row
    return out


class Pivots:
    """Pivot vectors in the space with the added component."""

    def __init__(self, rows: list, dim: int, top: int):
        self.dim, self.top = dim, top
        p = _matrix(pd.Series(rows, dtype=object), dim).astype(np.float64)
        self.at = np.column_stack([p, self._lift(p)])

    def _lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.top - (x * x).sum(axis=1)))

    def nearest(self, x: np.ndarray, is_query: bool) -> tuple[np.ndarray, np.ndarray]:
        x = x.astype(np.float64)
        full = np.column_stack([x, np.zeros(len(x)) if is_query else self._lift(x)])
        d2 = (full * full).sum(axis=1)[:, None] + (self.at * self.at).sum(axis=1)[None, :] - 2.0 * full @ self.at.T
        cell = d2.argmin(axis=1)
        return cell, np.sqrt(np.maximum(0.0, d2[np.arange(len(x)), cell]))

    def apart(self) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, ((self.at[:, None, :] - self.at[None, :, :]) ** 2).sum(axis=2)))


def _assigned(q: DataFrame, pivots: Pivots, is_query: bool) -> DataFrame:
    """``(id, vec binary, cell, dist)``; the vector as 64-bit integers."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            x = _matrix(p["v"], pivots.dim)
            cell, dist = pivots.nearest(x, is_query) if len(x) else ([], [])
            yield pd.DataFrame({"id": p["id"], "vec": [r.tobytes() for r in x], "cell": cell, "dist": dist})

    return q.select("id", "v").mapInPandas(run, "id long, vec binary, cell int, dist double")


def bounds(apart: np.ndarray, reach: dict[int, float], least: list[tuple[int, float]], k: int) -> np.ndarray:
    """Upper bound on the distance of the k-th neighbour of any query of a cell;
    ``least`` holds rows of distinct ids."""
    out = np.full(len(apart), np.inf)
    if len(least) < k + 1:
        return out
    cells = np.array([c for c, _ in least])
    dist = np.array([d for _, d in least])
    for i, r in reach.items():
        out[i] = np.partition(r + apart[i, cells] + dist, k)[k]
    return out


def groups_of(apart: np.ndarray, counts: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    """Query cell to (first group, number of groups): close cells share a group
    of about ``size`` queries, larger cells get several groups of their own."""
    left, out, group, held = set(counts), {}, 0, 0
    at = min(left, default=None)
    while left:
        left.remove(at)
        n = counts[at]
        if n > size:
            group += held > 0
            out[at] = (group, -(-n // size))
            group, held = group + out[at][1], 0
        else:
            if held and held + n > size:
                group, held = group + 1, 0
            out[at] = (group, 1)
            held += n
        if left:
            at = min(left, key=lambda j: (apart[at, j], j))
    return out


def local_top(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, exact_float: bool) -> tuple[np.ndarray, ...]:
    """Rows (query position, id, score) of the best ``k`` of ``x`` per query;
    ``x`` is sorted by id, ties go to the smaller id."""
    n = len(x)
    at, ids, scores = [], [], []
    xt = (x.astype(np.float64) if exact_float else x).T
    for s in range(0, len(q), 256):
        block = q[s : s + 256]
        score = np.rint(block.astype(np.float64) @ xt).astype(np.int64) if exact_float else block @ xt
        own = q_ids[s : s + 256][:, None] == x_ids[None, :]
        top = int(np.abs(score).max(initial=0)) + 1
        if top * 2 * (n + 1) < 1 << 62:
            key = np.where(own, -(top + 1) * (n + 1), score * (n + 1) - np.arange(n))
            m = min(k, n)
            best = np.argpartition(-key, m - 1, axis=1)[:, :m]
        else:
            best = np.lexsort((np.broadcast_to(np.arange(n), score.shape), -score, own), axis=1)[:, : min(k, n)]
        rows = np.repeat(np.arange(len(block)), best.shape[1])
        best = best.ravel()
        ok = ~own[rows, best]
        at.append(rows[ok] + s)
        ids.append(x_ids[best[ok]])
        scores.append(score[rows[ok], best[ok]])
    return tuple(np.concatenate(z) for z in (at, ids, scores))


def knn_join(queries: DataFrame, data: DataFrame, *, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, pivots: int = 64, queries_per_group: int = 2048, rows_per_task: int = 16384) -> DataFrame:
    """Per query the ``k`` highest scores among the data rows of another id:
    ``query_id, rank, vec_id, score``."""
    spark = data.sparkSession
    checkpoint_dir(spark)
    dq, qq = quantised(data, id_col, vec_col, scale), quantised(queries, id_col, vec_col, scale)
    facts = dq.agg(F.max("norm").alias("top"), F.max(F.size("v")).alias("dim"), F.count(F.lit(1)).alias("n")).first()
    q_facts = qq.agg(F.max("norm").alias("top"), F.max(F.size("v")).alias("dim")).first()
    if not facts["n"] or q_facts["dim"] is None:
        return spark.createDataFrame([], _RESULT)
    top, dim = facts["top"], max(facts["dim"], q_facts["dim"], 1)
    exact_float = max(top, q_facts["top"]) < 1 << 52
    chosen = dq.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(pivots).collect()  # a fixed number of rows
    piv = Pivots([r["v"] for r in chosen], dim, top)
    apart = piv.apart()

    x = _assigned(dq, piv, False).withColumn("nr", F.monotonically_increasing_id()).checkpoint()  # numbers stay as written
    q = _assigned(qq, piv, True).dropDuplicates(["id", "vec"]).checkpoint()
    reach, counts = {}, {}
    for r in q.groupBy("cell").agg(F.max("dist").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # a row per pivot
        reach[r["cell"]], counts[r["cell"]] = r["far"], r["n"]
    nearest = x.groupBy("id").agg(F.min_by("cell", "dist").alias("cell"), F.min("dist").alias("dist"))
    nth = F.row_number().over(Window.partitionBy("cell").orderBy("dist"))
    least = [(r["cell"], r["dist"]) for r in nearest.select("cell", "dist", nth.alias("nth")).where(F.col("nth") <= k + 1).collect()]  # pivots * (k + 1) rows
    limit = bounds(apart, reach, least, k)
    group = groups_of(apart, counts, queries_per_group)
    slack = 1e-6 * (1.0 + np.sqrt(float(top)))
    cells = np.array(sorted(group))
    near = apart[cells] - np.array([reach[c] for c in cells])[:, None] - limit[cells][:, None] - slack
    first, many = (np.array([group[c][j] for c in cells]) for j in (0, 1))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def sent_to(cell: pd.Series, dist: pd.Series) -> pd.Series:
        out = []
        for c, d in zip(cell.to_numpy(), dist.to_numpy()):
            hit = np.flatnonzero(near[:, c] <= d)  # not beyond the bound of these query cells
            out.append(sorted({g for h in hit for g in range(first[h], first[h] + many[h])}))
        return pd.Series(out, dtype=object)

    shares = -(-facts["n"] // rows_per_task)
    home = F.create_map(*[F.lit(int(z)) for c in cells for z in (c, group[c][0])])
    split = F.create_map(*[F.lit(int(z)) for c in cells for z in (c, group[c][1])])
    spread = lambda n, *by: F.pmod(F.xxhash64(*by), n)
    q = q.withColumn("g", (home[F.col("cell")] + spread(split[F.col("cell")].cast("long"), "id", "vec")).cast("int"))
    q = q.select("id", "vec", "g", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    x = x.select("id", "vec", F.explode(sent_to("cell", "dist")).alias("g"), spread(F.lit(shares).cast("long"), "nr").cast("int").alias("share"))

    def solve(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(xs):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "qkey", "vec_id", "score")})
        xs = xs.sort_values("id", kind="stable")
        load = lambda s: np.frombuffer(b"".join(s), dtype=np.int64).reshape(len(s), dim)
        at, ids, scores = local_top(load(qs["vec"]), qs["id"].to_numpy(), load(xs["vec"]), xs["id"].to_numpy(), k, exact_float)
        return pd.DataFrame({"query_id": qs["id"].to_numpy()[at], "qkey": qs["qkey"].to_numpy()[at], "vec_id": ids, "score": scores})

    q = q.withColumn("qkey", F.xxhash64("vec"))
    parts = q.groupBy("g", "share").cogroup(x.groupBy("g", "share")).applyInPandas(solve, "query_id long, qkey long, vec_id long, score long")
    rank: Column = F.row_number().over(Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
