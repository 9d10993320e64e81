"""Exact top-k search by inner product as a Voronoi kNN join.

Components are turned into integers, so scores are exact. A bounded set of pivots cuts the space into Voronoi
cells. Summaries (per cell the row count, the largest distance to the pivot and the k smallest distances)
bound every inner product: with pivot p and |x - p| = d, q.p - |q| d <= q.x <= q.p + |q| d. From the summaries
alone each query gets a score that its k-th answer reaches for certain; a cell's row is needed by a group of queries
only if its upper bound reaches the weakest such score of the group. Just these rows are replicated to the
group, in salted blocks of bounded size, as many as the group's own rows fill; there a matrix product solves them,
and the blocks' top k are merged. Pivots grow with the queries up to MOST_PIVOTS; a group of more than
QUERY_CHUNK queries is cut into chunks.

Defined results: a vector that is null or empty, or holds a null, NaN or infinite component, or has a null id, takes no
part, as query or as candidate; vectors of different lengths have no inner product and are searched apart, each
among those of its length; a query's own id is never its answer; every repeated row of another id is a candidate
of its own, a repeated query row (same id and vector) is answered once, and different vectors of one
id are answered each; ties go to the smaller id; fewer than k candidates give fewer rows; no vectors give none; scores
beyond 64 bits are clamped to the largest or smallest long; further columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import materialize

SCALE = 1024
#: Pivots at least and at most.
PIVOTS, MOST_PIVOTS = 64, 1024
#: Queries that are solved together, queries of a task, candidate rows of a block, and blocks whose answers are merged first.
GROUP_QUERIES = 256
QUERY_CHUNK = 4096
BLOCK_ROWS = 8192
MERGE = 64
#: Below these every product is exact in doubles, and in 64-bit integers.
EXACT, WHOLE = 2.0**52, 2.0**63


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x: the integer vectors that take part."""
    v = F.col(vector_col)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double"))).alias("x"))
    return rows.where(F.col("vec_id").isNotNull())


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; through floating point where that is exact, clamped where a long can't hold them."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < WHOLE:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def top_k(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of one row: highest score first, smaller id on ties."""
    if len(ids) > k:
        kth = np.partition(scores, len(ids) - k)[len(ids) - k]
        cand = np.flatnonzero(scores >= kth)
    else:
        cand = np.arange(len(ids))
    return cand[np.lexsort((ids[cand], -scores[cand]))][:k]


def knn_join(vectors: DataFrame, k: int = 10, query_every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for every id divisible by query_every its k best candidates."""
    data = quantised(vectors, id_col, vector_col)
    queries = F.count(F.when(F.col("vec_id") % query_every == 0, 1)).alias("queries")
    out = None
    for r in sorted(data.groupBy(F.size("x").alias("dim")).agg(queries).collect()):  # a row a length
        count = pivots or min(MOST_PIVOTS, max(PIVOTS, -(-r["queries"] // GROUP_QUERIES)))
        found = _knn(data.where(F.size("x") == r["dim"]), r["dim"], k, query_every, count) if r["queries"] else None
        out = found if out is None else out.unionByName(found) if found is not None else out
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long") if out is None else out


def _knn(data: DataFrame, dim: int, k: int, query_every: int, pivots: int) -> DataFrame:
    """knn_join of the vectors of one length."""
    seeds = data.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(pivots).collect()
    pivot = np.unique(np.array([r["x"] for r in seeds], np.float64), axis=0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dim).astype(np.float64)
            cells, dist = np.zeros(len(x), np.int32), np.zeros(len(x))
            for i in range(0, len(x), 4096):
                part = x[i : i + 4096]
                d2 = (part**2).sum(1)[:, None] - 2 * part @ pivot.T + (pivot**2).sum(1)[None, :]
                cells[i : i + 4096] = d2.argmin(1)
                dist[i : i + 4096] = np.sqrt(((part - pivot[cells[i : i + 4096]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells), pa.array(dist)], ["vec_id", "x", "cell", "dist"])

    placed = materialize(data.mapInArrow(assign, "vec_id long, x array<long>, cell int, dist double"), "knn-placed")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial summaries: of each cell the k + 1 smallest distances and the largest, from this partition."""
        near: dict[int, np.ndarray] = {}
        far: dict[int, float] = {}
        for batch in batches:
            cell, dist = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for c in np.unique(cell).tolist():
                d = dist[cell == c]
                far[c] = max(far.get(c, 0.0), float(d.max()))
                near[c] = np.sort(np.concatenate([near.get(c, d[:0]), d]))[: k + 1]
        cells = sorted(near)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array([near[c].tolist() for c in cells], pa.list_(pa.float64())), pa.array([far[c] for c in cells], pa.float64())], ["cell", "near", "far"])

    # at most `pivots` rows of k + 1 distances from each partition, merged by cell before they reach the driver
    partial = placed.select("cell", "dist").mapInArrow(summarise, "cell int, near array<double>, far double")
    merged = partial.groupBy("cell").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"), F.max("far").alias("far")).collect()
    cells = np.array([r["cell"] for r in merged])
    reach = np.array([r["far"] for r in merged])
    nearest = np.full((len(merged), k + 1), np.inf)
    for i, r in enumerate(merged):
        nearest[i, : len(r["near"])] = r["near"]
    centre = pivot[cells]
    queries = placed.where(F.col("vec_id") % query_every == 0)
    copies = queries.groupBy("vec_id").agg(F.count(F.lit(1)).alias("copies"))
    queries = materialize(queries.dropDuplicates(["vec_id", "x"]).join(copies, "vec_id"), "knn-queries")
    n_queries = queries.count()
    groups = max(1, min(len(pivot), -(-n_queries // GROUP_QUERIES)))
    # neighbouring cells share a query group: pivots in the order of their projection on the first principal axis
    axis = np.linalg.svd(pivot - pivot.mean(0), full_matrices=False)[2][0] if len(pivot) > 1 else np.ones(dim)
    rank = np.argsort(np.argsort(pivot @ axis, kind="stable"), kind="stable")
    group_of = (rank * groups // len(pivot)).astype(np.int32)
    slack = 1e-6

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each query: its group and, per cell, the distance from the pivot at which a row becomes needed."""
        for batch in batches:
            q = matrix(batch.column(1), dim).astype(np.float64)
            size = np.sqrt((q**2).sum(1))
            dot = q @ centre.T
            lower = (dot[:, :, None] - size[:, None, None] * nearest[None]).reshape(len(q), -1)
            lower.sort(axis=1)
            # rows of the query's own id may be among those that reach the bound
            reached = k + batch.column(3).to_numpy()
            bound = np.where(reached <= lower.shape[1], lower[np.arange(len(q)), -np.minimum(reached, lower.shape[1])], -np.inf)
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(size[:, None] > 0, (bound[:, None] - dot) / size[:, None], -np.inf)
            least = np.where(np.isfinite(bound)[:, None], least, -np.inf) - slack * (1 + np.abs(least, where=np.isfinite(least), out=np.zeros_like(least)))
            yield pa.RecordBatch.from_arrays([pa.array(group_of[batch.column(2).to_numpy()]), pa.array(list(least), pa.list_(pa.float64()))], ["grp", "least"])

    asked = queries.select("vec_id", "x", "cell", "copies")
    wanted = asked.mapInArrow(needs, "grp int, least array<double>")
    place = {int(c): i for i, c in enumerate(cells)}
    weakest = wanted.groupBy("grp").agg(*[F.min(F.element_at("least", i + 1)).alias(f"c{i}") for i in range(len(cells))]).collect()  # groups x cells numbers
    table = np.full((len(pivot), groups), np.inf)
    for r in weakest:
        for c, i in place.items():
            table[c, r["grp"]] = r[f"c{i}"]

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, dist = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            row, grp = np.nonzero((table[cell] <= dist[:, None]) & (table[cell] <= reach_of[cell][:, None]))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(grp.astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take)], ["grp", "vec_id", "x"])

    reach_of = np.full(len(pivot), -1.0)
    reach_of[cells] = reach

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that each group needs, of this partition."""
        seen = np.zeros(groups, np.int64)
        for batch in batches:
            cell, dist = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a in range(0, len(cell), 4096):
                c, d = cell[a : a + 4096], dist[a : a + 4096, None]
                seen += ((table[c] <= d) & (table[c] <= reach_of[c][:, None])).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(groups), pa.int32()), pa.array(seen)], ["grp", "n"])

    needed = placed.select("cell", "dist").mapInArrow(tally, "grp int, n long").groupBy("grp").agg(F.sum("n").alias("n")).collect()  # a row a group
    rows_of = {r["grp"]: r["n"] for r in needed}
    blocks = [max(1, -(-rows_of.get(g, 0) // BLOCK_ROWS)) for g in range(groups)]
    of_cell = F.element_at(F.lit(group_of.tolist()), F.col("cell") + 1)
    asked = asked.withColumn("grp", of_cell)
    in_group = {r["grp"]: r["n"] for r in asked.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    chunks = [max(1, -(-in_group.get(g, 0) // QUERY_CHUNK)) for g in range(groups)]
    number = lambda counts: F.element_at(F.lit(counts), F.col("grp") + 1)
    every = lambda counts: F.explode(F.sequence(F.lit(0), number(counts) - 1))
    deal = lambda counts, salt: F.pmod(F.xxhash64("vec_id", "x", F.lit(salt)), number(counts)).cast("int")
    salted = placed.select("vec_id", "x", "cell", "dist").mapInArrow(replicate, "grp int, vec_id long, x array<long>")
    salted = salted.withColumn("block", deal(blocks, 1)).withColumn("chunk", every(chunks))
    sent = asked.select("grp", "vec_id", "x").withColumn("chunk", deal(chunks, 2)).withColumn("block", every(blocks))
    sent = sent.withColumn("query", F.xxhash64("vec_id", "x"))

    def solve(asks: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[np.ndarray] = [np.zeros((0, 5), np.int64)]
        if asks.num_rows and rows.num_rows:
            x, ids = matrix(rows.column("x"), dim), rows.column("vec_id").to_numpy()
            y, own, query = matrix(asks.column("x"), dim), asks.column("vec_id").to_numpy(), asks.column("query").to_numpy()
            block = asks.column("block")[0].as_py()
            for a in range(0, len(own), GROUP_QUERIES):
                for i, row in enumerate(products(y[a : a + GROUP_QUERIES], x), a):
                    other = np.flatnonzero(ids != own[i])
                    best = other[top_k(row[other], ids[other], k)]
                    out.append(np.column_stack([np.full(len(best), own[i]), np.full(len(best), query[i]), np.full(len(best), block), ids[best], row[best]]))
        flat = np.concatenate(out)
        return pa.Table.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(5)], names=["query_id", "query", "block", "vec_id", "score"])

    keys = ["grp", "chunk", "block"]
    found = sent.groupBy(*keys).cogroup(salted.groupBy(*keys)).applyInArrow(solve, "query_id long, query long, block long, vec_id long, score long")
    # the best k of some blocks, then of all: a list holds at most MERGE lists of k, or one k for every MERGE blocks
    best_k = F.slice(F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("s"), "vec_id", "score"))), 1, k).alias("best")
    some = found.groupBy("query_id", "query", (F.col("block") / MERGE).cast("long").alias("part")).agg(best_k)
    some = some.select("query_id", "query", F.explode("best").alias("b")).select("query_id", "query", "b.vec_id", "b.score")
    best = some.groupBy("query_id", "query").agg(best_k)
    return best.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
