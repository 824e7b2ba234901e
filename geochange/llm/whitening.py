"""Whitening of embeddings by block matrices of Spark MLlib.

Rows are centred exactly, in whole numbers, before anything is multiplied, and numbered without gaps; they become a
matrix of blocks. Its transpose times itself is the scatter matrix, whose eigenvectors (of as many rows as a vector has
components, so on the driver) make the whitening matrix; the blocks times that matrix are the whitened rows.

MLlib numbers the rows of a matrix in 32 bits when it turns blocks back into rows, and its planning of a product holds the
blocks' numbers on the driver. So a matrix is of a slab of rows, and scatter matrices of slabs are added up: the driver
holds the numbers of one slab's blocks, whatever the table's size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """components: at most so many; scale, shift: of a component before it is a whole number; block: rows of a block;
    slab: rows of a matrix at most (a slab is of whole tasks of the table's writing, and so of one at least); floor:
    components whose share of the variance is under it are none, as no double holds them."""

    components: int = 32
    scale: int = 64
    shift: int = 1_000_000
    block: int = 2048
    slab: int = 2**27
    floor: float = 1e-11


def whole_vectors(vectors: DataFrame, opts: Whitening) -> DataFrame:
    """(vec_id, x array<long>) of vectors without null or non-finite entries."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(e, lambda x: F.floor(x.cast("double") * opts.scale) + opts.shift)
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def _times(a: BlockMatrix, b: BlockMatrix, splits: int) -> BlockMatrix:
    """a times b, whose inner dimension is worked on in so many parts at a time: a task holds a few blocks of it."""
    made = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, a.rowsPerBlock, b.colsPerBlock)


def _scatter(m: BlockMatrix) -> np.ndarray:
    """The transpose of m times m: as many numbers as a vector has components, squared."""
    return _times(m.transpose(), m, -(-m.numRowBlocks // 4)).toLocalMatrix().toArray()


@dataclass
class Centred:
    """rows: (place, vec_id, x), written; place is the number of the writing task and the row's number in it. slabs: of
    each the first place, that after the last, and the rows before each of its tasks. n, sums: of the fit list."""

    rows: DataFrame
    slabs: list[tuple[int, int, list[tuple[int, int]]]]
    n: int
    sums: list[int]
    opts: Whitening

    def less_mean(self) -> Column:
        """n times x less the sums, exact; ANSI mode ends the run should it not fit a long."""
        return F.zip_with("x", F.lit(self.sums), lambda x, s: x * self.n - s)

    def numbered(self, k: int) -> DataFrame:
        """Rows of a slab with `index` from 0 without gaps."""
        low, high, before = self.slabs[k]
        # A row for each task that wrote the slab, of two numbers.
        tasks = F.broadcast(self.rows.sparkSession.createDataFrame(before, "task long, before long"))
        rows = self.rows.where(F.col("place").between(low, high - 1)).withColumn("task", F.shiftright("place", 33))
        return rows.join(tasks, "task").withColumn("index", F.col("before") + F.col("place").bitwiseAND(2**33 - 1)).drop("task", "before")

    def matrix(self, k: int) -> BlockMatrix:
        """The centred rows of a slab as blocks; a row of doubles is made in the JVM, of the exact differences."""
        rows = self.numbered(k).select("index", array_to_vector(F.transform(self.less_mean(), lambda v: v.cast("double") / self.n)).alias("vector"))
        made = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(rows, "vector"), 0, len(self.sums))
        return made.toBlockMatrix(self.opts.block, len(self.sums))


def centred(vectors: DataFrame, opts: Whitening = Whitening()) -> Centred | None:
    """The fit list of vectors; None if it is empty or of vectors without components. Vectors of other lengths than
    most have (of equally frequent ones: the longest) are not of it."""
    whole = whole_vectors(vectors, opts)
    sizes = whole.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if not sizes or not sizes["d"]:
        return None
    d, n = sizes
    rows = common.written(whole.where(F.size("x") == d).select(F.monotonically_increasing_id().alias("place"), "vec_id", "x"), "centred")
    sums = list(rows.agg(*[F.sum(F.col("x")[i]) for i in range(d)]).first())
    slabs, held = [], opts.slab
    for task, size in rows.groupBy(F.shiftright("place", 33)).count().orderBy("shiftright(place, 33)").collect():  # a row a task
        if held + size > opts.slab:
            slabs.append((task << 33, 0, []))
            held = 0
        slabs[-1][2].append((task, held))
        held += size
        slabs[-1] = (slabs[-1][0], (task + 1) << 33, slabs[-1][2])
    return Centred(rows, slabs, n, sums, opts)


def principal(scatter: np.ndarray, n: int, opts: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance, falling, and their eigenvectors as columns, as many as count."""
    e, v = np.linalg.eigh(scatter / n)
    order = np.argsort(-e)[: opts.components]
    order = order[e[order] > opts.floor * max(np.trace(scatter) / n, 0.0)]
    return e[order], v[:, order]


def whiten(vectors: DataFrame, opts: Whitening = Whitening()) -> DataFrame:
    """Per remaining row and component: vec_id, component int (from 1), n long, deviation long, whitened double,
    explained double, identity_error double.

    Needs vec_id and embedding; other columns are not read. Rows remain whose vector is not null and has no null or
    non-finite entry, and is as long as most are (see centred). deviation is the exact sum of (n * x - S) squared, null
    where it doesn't fit a long. Components without variance (under opts.floor of all) are left out: they can't be
    whitened; a table of equal vectors, or of one, gives no row, and so does an empty one. identity_error is of the
    whitened rows' own scatter: their mean is 0 but for rounding, as rows are centred exactly. Rows that repeat a vec_id
    are rows of their own.
    """
    spark = vectors.sparkSession
    found = centred(vectors, opts)
    if not found:
        return spark.createDataFrame([], _ROWS)
    d, n = len(found.sums), found.n
    scatter = sum(_scatter(found.matrix(k)) for k in range(len(found.slabs)))
    e, v = principal(scatter, n, opts)
    if not len(e):
        return spark.createDataFrame([], _ROWS)
    by = v / np.sqrt(e)
    to = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(d, len(e), by.T.ravel().tolist()))], 1), d, len(e))
    parts, error = [], np.zeros((len(e), len(e)))
    for k in range(len(found.slabs)):
        projected = _times(found.matrix(k), to, 1)
        error += _scatter(projected) / n
        rows = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
        white = rows.select(F.col("index"), vector_to_array("vector").alias("white"))
        squares = F.aggregate(found.less_mean(), F.lit(0).cast("long"), lambda s, x: F.try_add(s, F.try_multiply(x, x)))
        parts.append(common.written(found.numbered(k).select("index", "vec_id", squares.alias("deviation")).join(white, "index"), "whitened"))
    common.dropped(found.rows)
    all_rows = parts[0]
    if len(parts) > 1:
        all_rows = spark.read.schema(parts[0].schema).parquet(*[p.written_path for p in parts])
    share = (e / (np.trace(scatter) / n)).tolist()
    off = float(np.abs(error - np.eye(len(e))).max())
    spread = all_rows.select("vec_id", "deviation", F.posexplode("white").alias("i", "whitened"))
    return spread.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.lit(share)[F.col("i")].alias("explained"), F.lit(off).alias("identity_error"))
