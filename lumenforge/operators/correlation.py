"""Two-dimensional correlation spectroscopy on long tables (j: perturbation, k: variable, value).

Rows of the matrix are packed into blocks; a task multiplies blocks, or convolves them with the Hilbert-Noda kernel, and sums up
its products, so that what moves are matrices of variables by variables and moments of blocks, never pairs of rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of a block.
BLOCK = 256


def hilbert_noda(j1: str, j2: str) -> Column:
    """Entry of the Hilbert-Noda matrix: 0 on the diagonal, else 1 / (pi (j2 - j1)); j are row numbers."""
    return F.when(F.col(j1) == F.col(j2), 0.0).otherwise(1.0 / (math.pi * (F.col(j2) - F.col(j1))))


def hilbert_noda_matrix(spark, m: int) -> DataFrame:
    """j1, j2, value of the matrix of m rows."""
    if m < 1:
        raise ValueError("one row at least is needed")
    return spark.range(m).select(F.col("id").alias("j1"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias("j2")).withColumn("value", hilbert_noda("j1", "j2"))


def _blocks(table: DataFrame, reference: DataFrame | None, size: int = BLOCK) -> tuple[DataFrame, list, int]:
    """Blocks of `size` centred rows (block, rows, values, row-major), the variables in order, and the number of rows."""
    rows = table.select("j").distinct()
    m = rows.count()
    if m < 2:
        raise ValueError("two perturbations at least are needed")
    mean = table.groupBy("k").agg(F.avg("value").alias("c")) if reference is None else reference.select("k", F.col("value").alias("c"))
    # Means stay out of the cells, whose values take less room as they come.
    means = sorted(((r[0], r[1]) for r in mean.where("k is not null").select("k", "c").collect()), key=lambda r: r[0])
    ks, centre = [k for k, _ in means], np.array([np.nan if c is None else c for _, c in means], float)
    if reference is not None and {r[0] for r in table.select("k").distinct().collect()} != set(ks):
        raise ValueError("the reference is of another shape")
    ranked = rows.withColumn("at", F.row_number().over(Window.orderBy("j")).cast("long") - 1)
    cells = table.where("k is not null").join(ranked, "j").select((F.col("at") / size).cast("long").alias("block"), (F.col("at") % size).cast("int").alias("at"), "k", "value")
    order = np.array(ks)

    def build(key, part):
        at, col = part.column("at").to_numpy(), np.searchsorted(order, part.column("k").to_numpy())
        n = int(at.max()) + 1
        dense = np.zeros((n, len(order)))
        dense[at, col] = part.column("value").to_numpy() - centre[col]
        return pa.table({"block": [key[0].as_py()], "rows": [n], "values": [dense.ravel()]})

    return cells.groupBy("block").applyInArrow(build, "block long, rows long, values array<double>"), ks, m


def _summed(products: DataFrame, ks: list, m: int, name: str, kind: str) -> DataFrame:
    """k1, k2 and the sum of the tasks' matrices, which come as rows (row, values)."""
    cells = products.select("row", F.posexplode("values").alias("col", "v")).groupBy("row", "col").agg((F.sum("v") / (m - 1)).alias(name))
    names = cells.sparkSession.createDataFrame(list(enumerate(ks)), f"n long, k {kind}")
    one, two = names.toDF("row", "k1"), names.withColumn("n", F.col("n").cast("int")).toDF("col", "k2")
    return cells.join(F.broadcast(one), "row").join(F.broadcast(two), "col").select("k1", "k2", name)


def _emit(total, width: int):
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(total), pa.list_(pa.float64()))], ["row", "values"])


def synchronous(table: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """k1, k2, sync: covariance over j of the centred columns; the reference (k, value) replaces column means. A value that
    the table lacks counts as its column's mean."""
    blocks, ks, m = _blocks(table, reference)
    width = len(ks)

    def multiply(batches):
        total = None
        for b in batches:
            for values in b.column(0):
                d = values.values.to_numpy().reshape(-1, width)
                total = d.T @ d if total is None else total + d.T @ d
        yield from _emit(total, width)

    return _summed(blocks.select("values").mapInArrow(multiply, "row long, values array<double>"), ks, m, "sync", dict(table.dtypes)["k"])


#: Rows of a leaf at a chunk's edge, points of an interpolation, and bytes of a chunk. With 20 points the kernel between pieces
#: that are as far apart as they are long is met to 15 digits.
LEAF, POINTS, CHUNK_BYTES = 32, 20, 8 << 20
#: Where the chunks' own sums and their moments meet; edges meet under the number of the chunk before them.
FAR = -2


def _kernel(gap: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(gap > 0, 1.0 / (math.pi * gap), 0.0)


def _nodes(first: float, rows: int) -> np.ndarray:
    """Chebyshev points over the places of so many rows."""
    return first + (rows - 1) / 2 + rows / 2 * np.cos((2 * np.arange(POINTS) + 1) * math.pi / (2 * POINTS))


def _weights(at: np.ndarray, first: float, rows: int) -> np.ndarray:
    """Values of the Lagrange polynomials of _nodes at places, a row a point, by sums of Chebyshev polynomials."""
    x = np.clip((at - first - (rows - 1) / 2) / (rows / 2), -1.0, 1.0)
    n, q = np.arange(POINTS)[:, None], (2 * np.arange(POINTS) + 1) * math.pi / (2 * POINTS)
    scale = np.where(n == 0, 1.0, 2.0) / POINTS
    return (scale * np.cos(n * q[None, :])).T @ np.cos(n * np.arccos(x)[None, :])


def _pieces(rows: int) -> list[tuple[int, int]]:
    """Where a chunk's pieces begin, seen from an edge, and their rows: a leaf, and from there on each as long as all before."""
    out = [(0, LEAF)]
    while sum(out[-1]) < rows:
        out.append((sum(out[-1]),) * 2)
    return out


def _within_chunk(d: np.ndarray) -> np.ndarray:
    """Sum over rows i < j of kernel(j - i) d[i] d[j]^T, by a convolution."""
    n = len(d)
    spectrum = np.conj(np.fft.rfft(_kernel(np.arange(n, dtype=float)), 2 * n))
    later = np.empty_like(d)
    for c in range(0, d.shape[1], 16):
        later[:, c : c + 16] = np.fft.irfft(np.fft.rfft(d[:, c : c + 16], 2 * n, axis=0) * spectrum[:, None], 2 * n, axis=0)[:n]
    return d.T @ later


def _across_edge(tail: np.ndarray, head: np.ndarray, rows: int) -> np.ndarray:
    """The same for i in one chunk and j in the next, of the chunks' moments by pieces from their common edge; the first LEAF
    rows of each are the leaf itself."""
    width, pieces = tail.shape[1], _pieces(rows)
    total = tail[:LEAF].T @ _kernel(np.arange(LEAF)[None, :] + np.arange(LEAF)[:, None] + 1.0) @ head[:LEAF]
    # Places are counted from the edge; a leaf meets what is farther by its moments too.
    spots = np.concatenate([_nodes(first, n) for first, n in pieces])
    moments = [np.concatenate([_weights(np.arange(LEAF, dtype=float), 0, LEAF) @ x[:LEAF], x[LEAF:]]) for x in (tail, head)]
    near = _kernel(spots[:, None] + spots[None, :] + 1.0)
    near[:POINTS, :POINTS] = 0.0
    return total + moments[0].T @ near @ moments[1]


def _far(moments: np.ndarray, rows: int) -> np.ndarray:
    """The same over chunks that aren't neighbours, of the chunks' moments (chunk, point, variable): each level of a tree meets
    what the level above has as neighbours."""
    width = moments.shape[2]
    total = np.zeros((width, width))
    while len(moments) > 2:
        for apart, step in ((2, 1), (3, 2)):
            a, b = moments[:-apart:step], moments[apart::step]
            k = _kernel(_nodes(apart * rows, rows)[None, :] - _nodes(0, rows)[:, None])
            total += np.tensordot(a, np.einsum("qr,crv->cqv", k, b), ((0, 1), (0, 1)))
        if len(moments) % 2:
            moments = np.concatenate([moments, np.zeros_like(moments[:1])])
        left, right = (_weights(_nodes(half * rows, rows), 0, 2 * rows) for half in (0, 1))
        moments, rows = np.einsum("pq,cqv->cpv", left, moments[::2]) + np.einsum("pq,cqv->cpv", right, moments[1::2]), 2 * rows
    return total


def asynchronous(table: DataFrame, reference: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """k1, k2, async: the same with the Hilbert-Noda transform of the columns, over row numbers of j in order.

    No two blocks meet. A chunk of rows (a power of two) is convolved with the kernel where it is. Neighbours meet by moments of
    pieces that grow with the distance from their common edge, all others by one set of moments a chunk, in a tree. The kernel
    is interpolated by Chebyshev points only between pieces that are a piece or more apart, to the precision of doubles. What
    moves after the chunks is some 3 % of their bytes.
    """
    width = table.where("k is not null").select("k").distinct().count()
    rows = rows or max(LEAF, 1 << max(0, (CHUNK_BYTES // (8 * max(1, width))).bit_length() - 1))
    if rows < LEAF or rows & (rows - 1):
        raise ValueError(f"a chunk takes a power of two of rows, {LEAF} at least")
    blocks, ks, m = _blocks(table, reference, rows)
    pieces = _pieces(rows)

    def sums(batches):
        total, schema = None, pa.schema([("meet", pa.int64()), ("part", pa.string()), ("chunk", pa.int64()), ("values", pa.list_(pa.float64()))])
        edge = lambda x: np.concatenate([x[:LEAF], *(_weights(np.arange(f, f + n, dtype=float), f, n) @ x[f : f + n] for f, n in pieces[1:])])
        for batch in batches:
            for chunk, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                d, whole = values.values.to_numpy().reshape(-1, width), np.zeros((rows, width))
                whole[: len(d)] = d
                total = _within_chunk(d) + (0.0 if total is None else total)
                out = [(FAR, "far", _weights(np.arange(rows, dtype=float), 0, rows) @ whole), (chunk, "tail", edge(whole[::-1])), (chunk - 1, "head", edge(whole))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([o[0] for o in out], [o[1] for o in out], [chunk] * 3, [o[2].ravel() for o in out]), schema.types)], schema=schema)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((FAR, "within", -1, total.ravel()), schema.types)], schema=schema)

    def meet(key, part):
        found: dict[str, list] = {}
        part = part.sort_by("chunk")
        for name, v in zip(part.column("part").to_pylist(), part.column("values").combine_chunks()):
            found.setdefault(name, []).append(v.values.to_numpy().reshape(-1, width))
        total = sum(found.get("within", []), np.zeros((width, width)))
        if "far" in found:
            total = total + _far(np.stack(found["far"]), rows)
        if "tail" in found and "head" in found:
            total = total + _across_edge(found["tail"][0], found["head"][0], rows)
        total = total - total.T  # pairs i > j are those i < j with the other sign
        return pa.table({"row": np.arange(width), "values": pa.array(list(total), pa.list_(pa.float64()))})

    made = blocks.select("block", "values").mapInArrow(sums, "meet long, part string, chunk long, values array<double>")
    products = made.groupBy("meet").applyInArrow(meet, "row long, values array<double>")
    return _summed(products, ks, m, "async", dict(table.dtypes)["k"])


def disrelation(both: DataFrame) -> DataFrame:
    """|sync| / (|sync| + |async|); NaN where both are 0."""
    total = F.abs("sync") + F.abs("async")
    return both.withColumn("disrelation", F.when(total > 0, F.abs("sync") / total).otherwise(F.lit(float("nan"))))
