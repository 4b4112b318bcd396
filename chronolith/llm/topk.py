"""Exact top-k search by tiled matrix products and tree merging of top lists."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, pick, table

#: Numbers of the queries, and of the vectors, that meet in one cell: about 65,536 vectors of 64 components each.
CELL_NUMBERS = 1 << 22
#: Vectors of a tile, and queries of a product: a tile of scores is of QUERY_TILE x TILE numbers.
TILE, QUERY_TILE = 4096, 512
#: Tiles of the table whose lists one task of the first merge takes.
FAN = 32
#: Cells of one task, where there are more of them than a shuffle's usual partitions.
CELLS_A_TASK = 8


def quantised(column: pa.ChunkedArray | pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of vector: the rows of such vectors, and floor(256 * x) of each component, x as double.

    Null vectors and those with null or non-finite components are left out. Components of 2**40 and more stay floats,
    which are whole numbers, and turn into Python integers in exact products. A component that is finite and 256 times
    of which isn't raises an error, as its scores have more than 64 bits.
    """
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    widths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(np.maximum(widths, 0)) - np.maximum(widths, 0)
    out = {}
    for width in np.unique(widths[widths >= 0]).tolist():
        rows = np.flatnonzero(widths == width)
        numbers = flat[starts[rows][:, None] + np.arange(width)]
        finite = np.isfinite(numbers).all(axis=1)
        with np.errstate(over="raise"):
            out[width] = rows[finite], np.floor(256 * numbers[finite])
    return out


def exact_products(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: floats where all sums are below 2**53, and Python integers otherwise."""
    most = (np.abs(queries).max(initial=0) * np.abs(tile).max(initial=0)) * max(1, queries.shape[1])
    if most < 2**53:
        return queries @ tile.T
    whole = np.vectorize(int, otypes=[object])
    return whole(queries).dot(whole(tile).T)


def tile_top(scores: np.ndarray, ids: np.ndarray, same: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k highest of each row of scores, ties to smaller ids; places that are ``same`` take no part.

    Columns are in the order of ids. Where it is exact, score and column share one number, so that partial selection
    of k numbers also settles ties.
    """
    q, n = scores.shape
    if scores.dtype != object and n and np.abs(scores).max(initial=0) < 2**52 / n:
        packed = scores * n + (n - 1 - np.arange(n))
        packed[same] = -np.inf
        at = np.argpartition(packed, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), (q, n))
        rows = np.repeat(np.arange(q), at.shape[1])
        cols = at.ravel()
    else:
        rows, cols = [], []
        for r in range(q):
            best = sorted((-scores[r, c], ids[c], c) for c in range(n) if not same[r, c])[:k]
            rows += [r] * len(best)
            cols += [c for *_, c in best]
        rows, cols = np.array(rows, np.int64), np.array(cols, np.int64)
    keep = ~same[rows, cols]
    rows, cols = rows[keep], cols[keep]
    return rows, ids[cols], scores[rows, cols]


class _Lists:
    """The k best of each query of what a part has shown so far."""

    def __init__(self, k: int):
        self.k, self.rows, self.ids, self.scores, self.fresh = k, [], [], [], 0

    def add(self, rows, ids, scores) -> None:
        self.rows.append(rows), self.ids.append(ids), self.scores.append(scores)
        self.fresh += len(rows)
        if self.fresh > 2_000_000:
            self.merge()

    def merge(self):
        rows, ids, scores = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.rows, self.ids, self.scores))
        order = np.lexsort((ids, -scores, rows)) if scores.dtype != object else np.array(
            sorted(range(len(rows)), key=lambda i: (rows[i], -scores[i], ids[i])), np.int64
        )
        rows, ids, scores = rows[order], ids[order], scores[order]
        begins = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else np.zeros(0, np.int64)
        place = np.arange(len(rows)) - np.repeat(begins, np.diff(np.concatenate((begins, [len(rows)]))))
        keep = place < self.k
        self.rows, self.ids, self.scores, self.fresh = [rows[keep]], [ids[keep]], [scores[keep]], 0
        return self.rows[0], self.ids[0], self.scores[0]


def _cell(k: int):
    """The k best of each query of a cell among the cell's vectors, tile by tile."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        found = [pa.table({c: pa.array([], pa.int64()) for c in ("query", "query_id", "vec_id", "score", "tile")})]
        if not queries.num_rows or not vectors.num_rows:
            return found[0]
        own_ids, all_ids = (t.column("vec_id").to_numpy() for t in (queries, vectors))
        own_rows, all_rows = (t.column("row").to_numpy() for t in (queries, vectors))
        number = vectors.column("tile")[0].as_py()
        blocks = quantised(queries.column("vector"))
        lists = {width: _Lists(k) for width in blocks}
        for at in range(0, vectors.num_rows, TILE):
            for width, (rows, tile) in quantised(vectors.column("vector").slice(at, TILE)).items():
                if width not in blocks:
                    continue
                ids = all_ids[at + rows]
                order = np.argsort(ids, kind="stable")
                ids, tile, tags = ids[order], tile[order], all_rows[at + rows][order]
                of, block = blocks[width]
                for q in range(0, len(of), QUERY_TILE):
                    some = slice(q, q + QUERY_TILE)
                    best, at_ids, scores = tile_top(exact_products(block[some], tile), ids, own_rows[of[some]][:, None] == tags[None, :], k)
                    lists[width].add(best + q, at_ids, scores)
        for width, some in lists.items():
            rows, ids, scores = some.merge()
            whole = pa.array([int(x) for x in scores] if scores.dtype == object else scores.astype(np.int64), pa.int64())
            at = blocks[width][0][rows]
            found.append(pa.table({"query": own_rows[at], "query_id": own_ids[at], "vec_id": pa.array(ids, pa.int64()), "score": whole, "tile": pa.array(np.full(len(rows), number, np.int64))}))
        return pa.concat_tables(found)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with every other vector.

    vectors: vec_id, embedding. ``is_query`` chooses the queries by vec_id. Ties go to the smaller vec_id. Null vectors,
    vectors with null or non-finite components and rows without vec_id take no part. A query meets vectors of its own
    length only, and every row but its own; rows that repeat a vec_id are queries and vectors of their own, so a repeated
    query_id has as many lists, and may itself be listed.
    Fewer than k vectors are all listed; no queries or an empty table give an empty result. A score beyond 64 bits
    raises an error.

    Queries are dealt over blocks and the table over tiles, each of some ``CELL_NUMBERS`` numbers, by hashes of which no
    hot id or vector makes one large; each pair of a block and a tile is a cell, whose sides meet by an equi-join on the
    two numbers. So a task holds one block and one tile, whatever the table's size, nothing is broadcast, and no vector
    comes to the driver, which takes two counts and the greatest length. A row is sent once for each block or tile of
    the other side, whose thousands of rows it meets there. Lists of tiles merge in two levels, so no task takes the
    lists of all tiles.
    """
    base = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))

    def usable(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))

    base = base.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", usable))
    # A row's number is written with it, as it could differ if an executor is lost and the row computed anew.
    base = materialize(base.withColumn("row", F.monotonically_increasing_id()), "vectors")
    queries = base.where(is_query)
    n_queries, width = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    base = base.where(F.size("vector") <= width)
    tiles, blocks = (max(1, math.ceil(rows * max(1, width) / CELL_NUMBERS)) for rows in (base.count(), n_queries))
    usual = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(4 * tiles * blocks, max(usual, math.ceil(tiles * blocks / CELLS_A_TASK)))

    def every(n: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    of_tile = base.select("row", "vec_id", "vector", F.pmod(F.xxhash64("row"), F.lit(tiles)).cast("int").alias("tile"), every(blocks, "block"))
    own = [F.col(c).alias(c) for c in ("row", "vec_id", "vector")]  # columns of their own, as both sides read one table
    of_block = queries.select(*own, F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), every(tiles, "tile"))
    of_tile, of_block = (side.repartition(tasks, "tile", "block") for side in (of_tile, of_block))
    cells = of_block.groupBy("tile", "block").cogroup(of_tile.groupBy("tile", "block"))
    return _merged(cells.applyInArrow(_cell(k), "query bigint, query_id bigint, vec_id bigint, score bigint, tile bigint"), k)


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """The k best of each query, over groups of tiles and then over groups."""
    best = [F.col("score").desc(), F.col("vec_id")]
    near = Window.partitionBy("query", "group").orderBy(*best)
    lists = lists.withColumn("group", F.expr(f"tile div {FAN}")).withColumn("place", F.row_number().over(near)).where(F.col("place") <= k)
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*best)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of every other vector for each vector whose vec_id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = r"""
WITH v AS (
  SELECT row_number() OVER () AS line, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.line, a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.line <> b.line AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
