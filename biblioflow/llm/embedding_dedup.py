"""Embedding near-dedup: int8 tile products with per-vector error bounds, full precision only where they leave doubt."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._forest import Forest
from ._shared import connected_components, table

#: Most vectors of a block (a task holds two), and those of a tile of its product matrix.
BLOCK_ROWS, TILE = 8_192, 1_024
#: Small tables are cut into so many blocks, of 512 vectors at least, so that there are tasks for all cores.
MIN_BLOCKS = 12
#: Covers rounding of the scaled products in single precision.
SLACK = 2e-6


class Quantised:
    """Unit vectors, their int8 codes, and a bound of the length of what the codes miss of each."""

    def __init__(self, x: np.ndarray):
        x = x / np.abs(x).max(axis=1, keepdims=True)  # against over- and underflow of squares
        self.unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        self.scale = np.abs(self.unit).max(axis=1) / 127
        self.code = np.rint(self.unit / self.scale[:, None]).astype(np.int8)
        near = self.code * self.scale[:, None]
        miss = self.unit - near
        self.error = np.sqrt(np.einsum("ij,ij->i", miss, miss)) * (1 + 1e-9) + 1e-12
        self.length = np.sqrt(np.einsum("ij,ij->i", near, near)) * (1 + 1e-9)


def tile_pairs(a: Quantised, b: Quantised, rows: slice, cols: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers (within a and b) of the pairs of a tile whose cosine reaches the threshold.

    |u.v - u'.v'| <= |u - u'| |v| + |u'| |v - v'| bounds each product of codes. Sums of int8 products are exact in single precision up to
    1,040 dimensions, in double precision beyond.
    """
    kind = np.float32 if a.code.shape[1] <= 1_040 else np.float64
    product = a.code[rows].astype(kind) @ b.code[cols].astype(kind).T
    product *= a.scale[rows].astype(kind)[:, None]
    product *= b.scale[cols].astype(kind)[None, :]
    widest = a.error[rows].max() + a.length[rows].max() * b.error[cols].max() + SLACK
    x, y = np.nonzero(product >= threshold - widest)
    near = product[x, y].astype(np.float64)
    x, y = x + rows.start, y + cols.start
    bound = a.error[x] + a.length[x] * b.error[y] + SLACK
    sure, maybe = near - bound >= threshold, near + bound >= threshold
    doubt = np.flatnonzero(maybe & ~sure)
    for at in range(0, len(doubt), 65_536):
        k = doubt[at : at + 65_536]
        sure[k] = np.einsum("ij,ij->i", a.unit[x[k]], b.unit[y[k]]) >= threshold
    return x[sure], y[sure]


def _block_links(threshold: float):
    def run(key, rows):
        i, j = key[1].as_py(), key[2].as_py()
        rows = rows.combine_chunks()
        vectors = rows.column("embedding").combine_chunks()
        block, number, copies = rows.column("block").to_numpy(), rows.column("number").to_numpy(), rows.column("copies").to_numpy()
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(block), -1)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            return pa.table({"a": number[:0], "b": number[:0], "n": pa.array([], pa.int64())})
        a = Quantised(x[left])
        b = a if i == j else Quantised(x[right])
        links, forest = np.zeros(len(block), np.int64), Forest(len(block))
        for r in range(0, len(left), TILE):
            for c in range(r if i == j else 0, len(right), TILE):
                p, q = tile_pairs(a, b, slice(r, min(r + TILE, len(left))), slice(c, min(c + TILE, len(right))), threshold)
                if i == j:
                    p, q = p[p < q], q[p < q]
                p, q = left[p], right[q]
                links += np.bincount(p, copies[q], len(block)).astype(np.int64) + np.bincount(q, copies[p], len(block)).astype(np.int64)
                forest.add(p, q)
        hit = np.flatnonzero(links)
        return pa.table({"a": number[hit], "b": number[forest.roots(hit)], "n": links[hit]})

    return run


def dedup(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links between vectors of cosine >= threshold: (id, n_links, component_id, kept).

    Equal vectors form a class with a number, its smallest id and a count (pre-aggregated), so copies are never compared. The
    classes are dealt by hash into blocks of about BLOCK_ROWS, and each pair of blocks is one task of bounded size that returns link counts and
    a spanning forest, never pairs. The number of block pairs grows with the square of the table: this is the exact comparison of all
    with all that the threshold asks for, at int8 cost.

    Null, empty and zero vectors, and those that hold null or non-finite elements, link with nothing and are their own component.
    Vectors of different lengths don't link. Rows that share an id are separate vectors of one name: each counts as a link of the other
    where they link, and their components are one. Rows without an id link and join others like any row; a component is named by its smallest
    id, null where none of its rows has one, and a row without an id is never the one kept. An empty table gives no rows. Other columns are not read.
    """
    v = F.col("embedding")
    base = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"))
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    base = base.withColumn("valid", F.coalesce(finite, F.lit(False)))
    classes = base.where("valid").groupBy("embedding").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = table(classes.withColumn("number", F.monotonically_increasing_id()))  # numbers are fixed once written
    n = classes.count()
    blocks = max(1, -(-n // BLOCK_ROWS), min(MIN_BLOCKS, n // 512))
    block = F.pmod(F.xxhash64("embedding"), F.lit(blocks)).cast("int")
    placed = classes.withColumn("block", block).withColumn("dim", F.size("embedding"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    placed = placed.select("dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "number", "copies", "embedding")
    tasks = min(2_000, blocks * (blocks + 1))
    found = table(placed.repartition(tasks, "dim", "i", "j").groupBy("dim", "i", "j").applyInArrow(_block_links(threshold), "a bigint, b bigint, n bigint"))
    parts = connected_components(found.select("a", "b").union(_shared_ids(base, classes)))
    links = found.groupBy("a").agg(F.sum("n").alias("n"))
    known = classes.join(links, F.col("number") == F.col("a"), "left").join(parts, F.col("number") == F.col("node"), "left")
    known = known.select(F.col("embedding").alias("e"), "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "number").alias("c"))
    names = known.groupBy("c").agg(F.min("rep").alias("part"))
    known = known.drop("rep").join(names, "c").drop("c")
    out = base.join(known, F.col("valid") & (v == F.col("e")), "left")
    component = F.coalesce("part", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _shared_ids(base: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges that make the classes of one id one component."""
    again = base.where("valid and id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    named = base.where("valid").join(again, "id").join(classes.select(F.col("embedding").alias("e"), "number"), F.col("embedding") == F.col("e")).select("id", "number")
    first = named.groupBy("id").agg(F.min("number").alias("first"))
    return named.join(first, "id").select(F.col("number").alias("a"), F.col("first").alias("b"))
