"""Embedding whitening on distributed block matrices.

Entries become whole numbers, so counts and sums are exact. Centred rows are indexed from 0 without gaps and
cut into row blocks of a ``BlockMatrix``; its transpose times itself is the scatter matrix, whose eigenvectors are found
locally (it is as large as the vectors are long, however many there are); the block matrix times the whitening matrix
projects the rows. The products are split over the rows, so no task gets more than a few blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texteval.llm.shared import settle

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Entries of a block, and blocks that one task of a product takes from each side.
BLOCK_ENTRIES = 1 << 17
BLOCKS_A_TASK = 4
#: From this size on an entry has no whole number of 64 bits.
LARGEST = 1e17

SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def _numbers(col: str) -> Column:
    return F.transform(col, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)


def _usable(col: str) -> Column:
    # nan counts as larger than any number
    inside = F.forall(col, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))
    return F.coalesce((F.size(col) > 0) & inside, F.lit(False))


def _indexed(vectors: DataFrame) -> DataFrame:
    """Usable rows of the commonest length, written once: index (0 to n-1), vec_id, x."""
    usable = vectors.filter(_usable("embedding")).select("vec_id", _numbers("embedding").alias("x"))
    length = usable.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return None
    # a row's place is its task's number and its place in the task; both are stored, so later reads can't change them
    place = F.monotonically_increasing_id()
    stored = settle(
        usable.filter(F.size("x") == length.d).select(
            "vec_id", "x", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("at")
        )
    )
    # one row a task of the scan
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    parts = parts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    return stored.join(parts, "part").select((F.col("first") + F.col("at")).alias("index"), "vec_id", "x")


def _product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """left * right with the inner dimension dealt to ``splits`` tasks, summed after."""
    model = left._java_matrix_wrapper._java_model.multiply(right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(model, left.rowsPerBlock, right.colsPerBlock)


def _gram(blocks: BlockMatrix) -> np.ndarray:
    splits = -(-blocks.numRowBlocks // BLOCKS_A_TASK)
    return _product(blocks.transpose(), blocks, splits).toLocalMatrix().toArray()


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each usable row of ``vectors`` (vec_id, embedding) and component, numbered from 1.

    Vectors that are null or empty, or hold null, non-finite or immense (1e17 and over) entries are left out, and so are those
    whose length is not the commonest one (of equally common ones the longest). Components without variance, to double
    precision, are not returned: constant vectors, or a single one, give no rows. ``deviation`` is null where it exceeds
    64 bits. Repeated rows and ids, and null ids, count as rows of their own; other columns are ignored; an empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    rows = _indexed(vectors)
    if rows is None:
        return spark.createDataFrame([], SCHEMA)
    sums = (
        rows.select(F.posexplode("x").alias("at", "v")).groupBy("at")
        .agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
        .orderBy("at").collect()
    )
    n, d = sums[0].n, len(sums)
    # S / n as a whole number and a rest over n, so that differences stay small and exact
    whole, rest = zip(*[divmod(int(r.s), n) for r in sums])
    wholes = F.array(*[F.lit(m).cast("long") for m in whole])
    centred = F.zip_with(
        F.zip_with("x", wholes, lambda v, m: v.cast("double") - m.cast("double")),
        F.array(*[F.lit(r / n) for r in rest]), lambda v, r: v - r,
    )
    indexed = rows.select("index", array_to_vector(centred).alias("vector"))
    blocks = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(indexed, "vector"), n, d).toBlockMatrix(
        max(1, BLOCK_ENTRIES // d), d
    )
    covariance = _gram(blocks) / n
    covariance = (covariance + covariance.T) / 2
    value, vector = np.linalg.eigh(covariance)
    value, vector = value[::-1], vector[:, ::-1]
    keep = min(components, int((value > max(value[0], 0) * d * np.finfo(float).eps).sum()))
    if keep == 0:
        return spark.createDataFrame([], SCHEMA)
    matrix = vector[:, :keep] / np.sqrt(value[:keep])
    local = DenseMatrix(d, keep, matrix.ravel(order="F").tolist())
    whitening = BlockMatrix(spark.sparkContext.parallelize([((0, 0), local)], 1), d, keep, d, keep)
    projected = blocks.multiply(whitening)
    identity_error = float(np.abs(_gram(projected) / n - np.eye(keep)).max())
    model = projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model
    lines = MLUtils.convertVectorColumnsToML(callMLlibFunc("getIndexedRows", model), "vector")

    from_mean = F.zip_with("x", wholes, lambda v, m: F.try_subtract(v, m))
    spread = F.zip_with(
        from_mean, F.array(*[F.lit(r).cast("long") for r in rest]),
        lambda v, r: F.try_subtract(F.try_multiply(v, F.lit(n).cast("long")), r),
    )
    deviation = F.aggregate(spread, F.lit(0).cast("long"), lambda a, v: F.try_add(a, F.try_multiply(v, v)))
    explained = F.array(*[F.lit(float(e)) for e in value[:keep] / np.trace(covariance)])
    return (
        rows.select("index", "vec_id", deviation.alias("deviation"))
        .join(lines.select("index", vector_to_array("vector").alias("line")), "index")
        .select("vec_id", "deviation", F.posexplode("line").alias("at", "whitened"))
        .select(
            "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
            F.get(explained, F.col("at")).alias("explained"), F.lit(identity_error).alias("identity_error"),
        )
    )
