"""Exact top-k inner-product search through a vector-approximation file.

The file holds for every vector one signed 8-bit cell per component and the vector's
step, so that component = step * (cell +- 1/2); exact vectors are a column beside the
cells that scans of cells never read.  Queries go in blocks of bounded bytes, each
broadcast to tasks that scan the cells in place, without moving a candidate:

1. the first scan finds the kth largest lower bound of each query,
2. the second keeps the candidates whose upper bound reaches it,
3. their exact vectors are read in two batches in the order of upper bounds: the first
   few of each query, whose kth exact score then decides which others can still matter.

Only survivors meet exact vectors, so what is shuffled is a few rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import prepare, shared_dir, write_table

#: Bounds of a query block, which is broadcast: bytes of its components, and queries.
BLOCK_BYTES, BLOCK_QUERIES = 32 << 20, 16_384
#: Cells that a task works on at once: rows, bytes, and queries against them.
CHUNK_ROWS, CHUNK_BYTES, TILE = 8192, 8 << 20, 256
#: Survivors (16 bytes each) that are broadcast to the exact vectors at most; more are shuffled.
BROADCAST_SURVIVORS = 1 << 20
#: Bounds are kept in units of 2**40 times the query's largest component, so that no finite input overflows.
_UNIT = 2.0**-40


def integer_vectors(df: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, dim, step, class, cells, v): v has floor(scale * x) as 32-bit integers or, beyond their range, as doubles (both exact).

    Vectors that are null, or hold a null or non-finite component (scaled ones included),
    and rows without an id are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.list_(pa.float64()))
            ok = lists.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
            size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            owner = np.repeat(np.arange(len(ids)), size)
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            ok[owner[~np.isfinite(whole)]] = False
            rows = np.flatnonzero(ok)
            whole, size = whole[ok[owner]], size[rows]
            first = np.cumsum(size) - size
            most = np.zeros(len(rows))
            some = size > 0
            if some.any():
                most[some] = np.maximum.reduceat(np.abs(whole), first[some])
            step = most / 127
            each = np.repeat(step, size)
            cells = np.divide(whole, each, out=np.zeros(len(whole)), where=each > 0)
            cells = np.clip(np.rint(cells), -127, 127).astype(np.int8).tobytes()
            ends = first + size
            exact = [(whole[a:b].astype("<i4") if m < 2**31 else whole[a:b]).tobytes() for a, b, m in zip(first.tolist(), ends.tolist(), most.tolist())]
            columns = [ids.take(pa.array(rows)), pa.array(size.astype(np.int32)), pa.array(step), pa.array([cells[a:b] for a, b in zip(first.tolist(), ends.tolist())], pa.binary()), pa.array(exact, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "dim", "step", "cells", "v"])

    out = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).mapInArrow(run, "id long, dim int, step double, cells binary, v binary")
    return out.select(F.monotonically_increasing_id().alias("row"), "id", "dim", "step", F.xxhash64("v").alias("class"), "cells", "v")


def decoded(v: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(v, "<i4" if len(v) == 4 * dim else "<f8").astype(np.float64)


class QueryBlock:
    """Queries of one block by their length, scaled to components of at most one."""

    def __init__(self, rows: pa.Table):
        self.by_dim: dict[int, dict[str, np.ndarray]] = {}
        dims = rows.column("dim").to_numpy()
        for d in np.unique(dims[dims > 0]).tolist():
            own = rows.filter(pa.array(dims == d))
            exact = np.stack([decoded(v, d) for v in own.column("v").to_pylist()])
            most = np.abs(exact).max(1)
            scaled = exact / np.where(most > 0, most, 1)[:, None]
            self.by_dim[d] = {"q": own.column("row").to_numpy(), "id": own.column("id").to_numpy(), "scaled": scaled.astype(np.float32), "l1": np.abs(scaled).sum(1), "reach": np.full(len(exact), -np.inf)}

    def set_reach(self, found: dict[int, float]) -> None:
        """Lower bound that a candidate's upper bound must reach."""
        for own in self.by_dim.values():
            own["reach"] = np.array([found.get(q, -np.inf) for q in own["q"].tolist()])


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= CHUNK_ROWS or size >= CHUNK_BYTES:
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def distinct_enough(ids: np.ndarray, kind: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among k: not those with k + 1 smaller ids of the same vector, nor beyond k of one id."""
    order = np.lexsort((ids, kind))
    c, i = kind[order], ids[order]
    new_class = np.append(True, c[1:] != c[:-1])
    new_id = new_class | np.append(True, i[1:] != i[:-1])
    at = np.arange(len(order))
    nth = np.cumsum(new_id)
    smaller = nth - np.maximum.accumulate(np.where(new_class, nth, 0))
    again = at - np.maximum.accumulate(np.where(new_id, at, 0))
    return np.sort(order[(smaller <= k) & (again < k)])


def bounds(table: pa.Table, block: QueryBlock, k: int) -> Iterator[tuple[dict, slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(queries of a length, tile of them, rows, about, slack): rows by queries, own ids at -infinity."""
    dims = table.column("dim").to_numpy()
    for d, own in block.by_dim.items():
        mine = np.flatnonzero(dims == d)
        if not len(mine):
            continue
        part = table.take(pa.array(mine))
        ids, step = part.column("id").to_numpy(), part.column("step").to_numpy()
        cells = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.int8).reshape(-1, d)
        some = distinct_enough(ids, part.column("class").to_numpy(), k)
        ids, step, cells, rows = ids[some], step[some] * _UNIT, cells[some].astype(np.float32), part.column("row").to_numpy()[some]
        # Half a cell, and what single precision loses: each product and sum at most one part in 2**23.
        wide = 0.5 + 127 * (d + 4) * 2.0**-23
        for a in range(0, len(own["q"]), TILE):
            tile = slice(a, a + TILE)
            about = (cells @ own["scaled"][tile].T).astype(np.float64) * step[:, None]
            slack = step[:, None] * (wide * own["l1"][tile])[None, :] * (1 + 2.0**-40)
            same = ids[:, None] == own["id"][tile][None, :] if np.isin(own["id"][tile], ids).any() else None
            if same is not None:
                about[same] = -np.inf
            yield own, tile, rows, about, slack


def lower_bounds(batches: Iterator[pa.RecordBatch], block: QueryBlock, k: int) -> Iterator[pa.RecordBatch]:
    """(q, low): each query's k largest lower bounds in this task."""
    best = {d: np.full((len(own["q"]), k), -np.inf) for d, own in block.by_dim.items()}
    for table in chunks(batches):
        for own, tile, _, about, slack in bounds(table, block, k):
            held = best[own["scaled"].shape[1]]
            low = about - slack
            more = low > held[tile].min(1)[None, :]
            for j in np.flatnonzero(more.any(0)).tolist():
                both = np.concatenate([held[tile.start + j], low[more[:, j], j]])
                held[tile.start + j] = np.partition(both, len(both) - k)[len(both) - k :]
    for d, held in best.items():
        i, j = np.nonzero(held > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(block.by_dim[d]["q"][i]), pa.array(held[i, j])], ["q", "low"])


def survivors(batches: Iterator[pa.RecordBatch], block: QueryBlock, k: int) -> Iterator[pa.RecordBatch]:
    """(q, row, high): candidates whose upper bound reaches the query's kth lower bound."""
    for table in chunks(batches):
        for own, tile, rows, about, slack in bounds(table, block, k):
            high = about + slack
            i, j = np.nonzero((high >= own["reach"][tile][None, :]) & (high > -np.inf))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(own["q"][tile][j]), pa.array(rows[i]), pa.array(high[i, j])], ["q", "row", "high"])


def sortable(x: int) -> bytes:
    """Bytes in the order of integers of any size."""
    size = (abs(x).bit_length() + 7) // 8
    if x >= 0:
        return (0x8000 + size).to_bytes(2) + x.to_bytes(size)
    return (0x8000 - size).to_bytes(2) + ((1 << 8 * size) - 1 + x).to_bytes(size)


def exact_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(q, query_id, vec_id, score, order, unit) of pairs with their vectors qv and v."""
    for batch in batches:
        scores, units = [], []
        for d, x, y in zip(*(batch.column(c).to_pylist() for c in ("dim", "qv", "v"))):
            a, b = decoded(x, d), decoded(y, d)
            most = float(np.abs(a).max(initial=0))
            if d * most * float(np.abs(b).max(initial=0)) < 2.0**53:
                score = int(a @ b)
            else:
                score = sum(int(p) * int(q) for p, q in zip(a.tolist(), b.tolist()))
            scores.append(score)
            units.append(score / (int(most) << 40) if most else 0.0)
        held = [min(max(s, -(1 << 63)), (1 << 63) - 1) for s in scores]
        yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("query_id"), batch.column("vec_id"), pa.array(held, pa.int64()), pa.array([sortable(s) for s in scores], pa.binary()), pa.array(units, pa.float64())], ["q", "query_id", "vec_id", "score", "order", "unit"])


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates by inner product of floor(scale * x).

    Scores are exact integers whatever the size of components; one beyond 64 bits is
    ranked by its exact value and shown as the nearest 64-bit one.  Candidates with the
    query's own id take no part; ties go to the smaller id; a query with fewer
    candidates has fewer rows.  Vectors of another length than the query's do not meet
    it; empty ones meet nothing.  Vectors with null or non-finite components and rows
    without an id are left out.  Repeated rows count once each, as candidates and as
    queries: a query id that is there twice has two sets of ranks.
    """
    spark = prepare(candidates.sparkSession)
    folder = shared_dir(spark)
    file = write_table(integer_vectors(candidates, scale, id_col, vector_col), folder, "file")
    asks = write_table(integer_vectors(queries, scale, id_col, vector_col).select("row", "id", "dim", "v"), folder, "asks")
    size = asks.agg(F.count("*"), F.sum(F.col("dim") * 8)).first()
    blocks = max(1, -(-size[0] // BLOCK_QUERIES), -(-(size[1] or 0) // BLOCK_BYTES))
    cells = file.select("row", "id", "dim", "step", "class", "cells")
    in_order = Window.partitionBy("q").orderBy(F.col("low").desc())
    found = []
    for number in range(blocks):
        block = QueryBlock(asks.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == number).toArrow())  # about BLOCK_BYTES
        sent = spark.sparkContext.broadcast(block)
        low = cells.mapInArrow(lambda b, sent=sent: lower_bounds(b, sent.value, k), "q long, low double")
        kth = low.withColumn("n", F.row_number().over(in_order)).where(F.col("n") == k).select("q", "low").toArrow()  # one row a query of the block
        block.set_reach(dict(zip(kth.column(0).to_pylist(), kth.column(1).to_pylist())))
        sent.destroy()
        sent = spark.sparkContext.broadcast(block)
        found.append(write_table(cells.mapInArrow(lambda b, sent=sent: survivors(b, sent.value, k), "q long, row long, high double"), folder, f"survivors_{number}"))
    near = found[0]
    for more in found[1:]:
        near = near.unionByName(more)
    near = write_table(near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.col("high").desc(), "row"))), folder, "near")

    def scored(pairs: DataFrame) -> DataFrame:
        small = near.count() <= BROADCAST_SURVIVORS
        vectors = file.select("row", F.col("id").alias("vec_id"), "dim", "v").join(F.broadcast(pairs) if small else pairs, "row")
        with_query = vectors.join(asks.select(F.col("row").alias("q"), F.col("id").alias("query_id"), F.col("v").alias("qv")), "q")
        return with_query.select("q", "query_id", "vec_id", "dim", "qv", "v").mapInArrow(exact_scores, "q long, query_id long, vec_id long, score long, order binary, unit double")

    best_first = Window.partitionBy("q").orderBy(F.col("order").desc(), "vec_id")
    first = write_table(scored(near.where(F.col("n") <= 4 * k).select("q", "row")), folder, "first")
    certain = first.withColumn("n", F.row_number().over(best_first)).where(F.col("n") == k).select("q", F.col("unit").alias("least"))
    rest = near.where(F.col("n") > 4 * k).join(certain, "q").where("high * (1 + sign(high) * 1e-12) >= least").select("q", "row")
    out = first.unionByName(scored(rest)).withColumn("rank", F.row_number().over(best_first))
    return out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
