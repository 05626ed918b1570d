"""Near-duplicate embeddings by Euclidean p-stable hashing and exact cosine checks.

Normalised vectors are projected on Gaussian directions, shifted and cut into steps; the
steps of ``per_table`` projections are one bucket of one table. A cosine of 0.9 is a distance of
0.447 on the sphere, so vectors that close fall into one step with known probability.
Vectors of a bucket are compared in double precision. Equal vectors are one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texteval.llm.shared import block_links, components, settle, shared_buckets

THRESHOLD = 0.9
TABLES = 64
PER_TABLE = 10
STEP = 1.6
CHUNK = 1000


def collision(distance: float, step: float) -> float:
    """Probability that two points at ``distance`` fall into one step of a random projection."""
    from math import erf, exp, pi, sqrt

    r = step / distance
    return erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def recall_at(cosine: float, tables: int = TABLES, per_table: int = PER_TABLE, step: float = STEP) -> float:
    """Expected share of the pairs of that cosine that meet in some table."""
    return 1 - (1 - collision((2 - 2 * cosine) ** 0.5, step) ** per_table) ** tables


def _hasher(tables: int, per_table: int, step: float):
    directions: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def keys(vectors: np.ndarray) -> np.ndarray:
        """Table keys of valid vectors of one length, scaled to largest component 1."""
        dim = vectors.shape[1]
        if dim not in directions:
            rng = np.random.default_rng([10, dim])
            directions[dim] = rng.standard_normal((dim, tables * per_table)), rng.uniform(0, step, tables * per_table)
        normal = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        towards, shift = directions[dim]
        steps = np.floor((normal @ towards + shift) / step).astype(np.int64).astype(np.uint64)
        steps = steps.reshape(len(vectors), tables, per_table)
        key = np.broadcast_to(np.arange(tables, dtype=np.uint64) + np.uint64(dim * 1000), steps.shape[:2]).copy()
        for k in range(per_table):
            key = (key ^ steps[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key.view(np.int64)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[int]] = [[] for _ in range(batch.num_rows)]
            vectors: list[bytes | None] = [None] * batch.num_rows
            by_dim: dict[int, list[tuple[int, np.ndarray]]] = {}
            for i, cell in enumerate(batch.column(1)):
                values = cell.as_py()
                if not values or None in values:
                    continue
                v = np.asarray(values, dtype=np.float64)
                top = np.abs(v).max()
                if np.isfinite(v).all() and top > 0:
                    by_dim.setdefault(len(v), []).append((i, v / top))
            for rows in by_dim.values():
                block = np.stack([v for _, v in rows])
                for (i, v), own in zip(rows, keys(block).tolist()):
                    found[i], vectors[i] = own, v.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(vectors, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                ["vec_id", "vector", "keys"],
            )

    return hashed


def _similar(threshold: float):
    def similar(payloads: list[bytes]) -> np.ndarray:
        vectors = [np.frombuffer(v, dtype=np.float64) for v in payloads]
        if len({len(v) for v in vectors}) > 1:  # two lengths under one key: only equal lengths compare
            linked = np.zeros((len(vectors), len(vectors)), dtype=bool)
            for dim in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == dim]
                linked[np.ix_(at, at)] = similar([payloads[i] for i in at])
            return linked
        x = np.stack(vectors)
        length = np.sqrt((x * x).sum(1))
        return x @ x.T / (length[:, None] * length[None, :]) >= threshold

    return similar


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, per_table: int = PER_TABLE,
    step: float = STEP, chunk: int = CHUNK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    Two rows are linked if they share a bucket and their cosine is at least ``threshold``; ``recall_at``
    says how many pairs of a cosine meet. Vectors that are null, empty, zero or hold a null or
    non-finite component link with nothing, nor do vectors of different lengths. Rows that repeat
    a vec_id count as rows of their own; null vec_ids take part but name no component; an empty table
    gives no rows.
    """
    hashed = settle(vectors.select("vec_id", "embedding").mapInArrow(
        _hasher(tables, per_table, step), "vec_id long, vector binary, keys array<long>"
    ))
    classes = settle(
        hashed.filter("vector is not null").groupBy("vector").agg(
            F.min("vec_id").alias("first_vec"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys")
        ).withColumn("id", F.monotonically_increasing_id())
    )
    buckets = shared_buckets(classes.select(F.explode(F.array_distinct("keys")).alias("bucket"), "id"))
    payload = classes.select("id", F.col("vector").alias("payload"), "copies")
    links = settle(block_links(buckets, payload, chunk, _similar(threshold)))
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    reach = components(links.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = (
        classes.select("id", "vector", "copies", "first_vec")
        .join(counts, "id", "left").join(reach, "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    smallest = named.groupBy("component").agg(F.min("first_vec").alias("component_id"))
    named = named.join(smallest, "component").select(
        "vector", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return hashed.join(named, "vector", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vector").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        (F.col("vector").isNull() | F.col("vec_id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )
