"""What the operators of this folder share: scratch tables, block joins, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from texteval.session import checkpoint_dir

#: A word is a run of anything but blanks; ``bytes.split()`` cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_path(spark: SparkSession) -> str:
    """A new folder under the shared folder that the cluster names."""
    root = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)
    return f"{root.rstrip('/')}/texteval-llm-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder once and read it from there.

    Later jobs read files instead of running the plan again, so a lost executor
    costs a read, not the lineage.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def slices(batch, column: int, most: int):
    """An Arrow batch in runs of rows with about ``most`` bytes in a column of texts."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    place = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(sizes)]
    for start, end in zip(cuts, cuts[1:]):
        if end > start:
            yield batch.slice(start, end - start)


def discard(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing will read any more."""
    path = getattr(df, "_scratch", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fold(col: Column, modulus: int) -> Column:
    """crc32 of a value as text, modulo ``modulus``; null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def components(edges: DataFrame) -> DataFrame:
    """Smallest id reachable from each id of ``edges`` (a, b): rows (id, component).

    Alternating stars: every id hands its larger neighbours, then its smaller ones,
    to the smallest neighbour, until only stars are left. Minima are pre-aggregated,
    and each round is settled in the shared folder. Ids without an edge don't occur;
    loops and repeated edges are harmless; no edges give no rows.
    """

    def toward_minimum(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("a").agg(F.min("b").alias("m"))
        return pairs.join(least, "a")

    def measure(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return row[0], row[1]

    current = settle(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = measure(current)
    while seen[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hung = toward_minimum(both)
        large = hung.filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = settle(large.distinct())
        small = toward_minimum(large)
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            small.select("a", F.col("m").alias("b"))
        )
        following = settle(small.distinct())
        discard(large)
        discard(current)
        current, before = following, seen
        seen = measure(current)
        if seen == before:
            break
    stars = current.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return stars.unionByName(roots)


def shared_buckets(members: DataFrame) -> DataFrame:
    """(bucket, id, size) rows of buckets with several ids, buckets of equal content kept once.

    Copies of one group meet in many hash tables; only one of equal buckets has to
    be compared. Content is told by count, smallest id and two sums of hashes.
    """
    members = settle(members.select("bucket", "id"))
    kept = (
        members.groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.min("id").alias("least"),
            F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("x"),
            F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(20,0)")).alias("y"),
        )
        .filter("size > 1")
        .groupBy("size", "least", "x", "y")
        .agg(F.min("bucket").alias("bucket"))
        .select("bucket", "size")
    )
    return settle(members.join(kept, "bucket"))


def deal_blocks(buckets: DataFrame, payload: DataFrame, chunk: int) -> DataFrame:
    """Rows for comparing each pair of a bucket in exactly one block of bounded size.

    A bucket of m ids is cut into ceil(m / chunk) parts by a hash of the id; a block
    holds two parts (or one part with itself), so no task gets more than about
    2 * chunk ids whatever the bucket's size. Each row carries all buckets of its id,
    so that a pair that meets in several is counted in the first only.
    """
    lists = buckets.groupBy("id").agg(F.sort_array(F.collect_list("bucket")).alias("buckets"))
    parts = F.ceil(F.col("size") / F.lit(chunk)).cast("int")
    dealt = (
        buckets.withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("bucket", "id", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    )
    return dealt.join(lists.join(payload, "id"), "id")


def _first_shared(buckets: list, bucket: int):
    """Boolean matrix: pairs whose smallest common bucket is ``bucket``."""
    import numpy as np

    rows = [np.asarray(b)[: np.searchsorted(b, bucket)] for b in buckets]
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    earlier, column, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    use = (count > 1)[column]
    held = np.zeros((len(rows), int((count > 1).sum())), dtype=np.float32)
    held[at[use], shared[column[use]]] = 1.0
    return held @ held.T == 0


def _spanning(linked) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a boolean matrix."""
    import numpy as np

    seen, edges = np.zeros(len(linked), dtype=bool), []
    for start in range(len(linked)):
        stack = [] if seen[start] else [start]
        seen[start] = True
        while stack:
            u = stack.pop()
            new = np.flatnonzero(linked[u] & ~seen)
            seen[new] = True
            edges += [(u, v) for v in new.tolist()]
            stack += new.tolist()
    return edges


#: Rows that one call compares: as many small buckets as come to this, or one block of a large one.
PACK_ROWS = 4000


def block_links(buckets: DataFrame, payload: DataFrame, chunk: int, similar) -> DataFrame:
    """Compare the pairs of each bucket: rows (id, links, other).

    ``payload`` is (id, payload, copies); ``similar(list of payloads)`` is the boolean matrix of
    verified pairs. ``links`` adds the copies of the ids linked with id in one
    block; a row with ``other`` is an edge of a spanning forest of the block's links.
    A pair counts only in the block of its two parts and in the first bucket it shares, so
    sums over all blocks are exact, and no list of pairs is ever made.
    """
    import numpy as np
    import pandas as pd

    rows = buckets.agg(F.sum(F.ceil(F.col("size") / chunk))).first()[0] or 0
    packs = max(1, -(-int(rows) // PACK_ROWS))

    def compare(pack: pd.DataFrame) -> pd.DataFrame:
        pack = pack.sort_values(["bucket", "lo", "hi"], kind="stable")
        bucket, lo, hi, ids, part, copies = (
            pack[c].to_numpy() for c in ("bucket", "lo", "hi", "id", "part", "copies")
        )
        payloads, lists = pack["payload"].tolist(), pack["buckets"].tolist()
        turn = (bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        bounds = [0, *(np.flatnonzero(turn) + 1).tolist(), len(pack)]
        made = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            linked = similar(payloads[a:b])
            np.fill_diagonal(linked, False)
            if lo[a] != hi[a]:
                linked &= part[a:b, None] != part[None, a:b]
            if not linked.any():
                continue
            linked &= _first_shared(lists[a:b], bucket[a])
            links = linked @ copies[a:b]
            some = np.flatnonzero(links)
            own = ids[a:b][some].tolist()
            made += [(i, n, None) for i, n in zip(own, links[some].tolist())]
            made += [(own[x], 0, own[y]) for x, y in _spanning(linked[np.ix_(some, some)])]
        return pd.DataFrame(made, columns=["id", "links", "other"]).astype({"other": "Int64"})

    dealt = deal_blocks(buckets, payload, chunk)
    pack = F.pmod(F.xxhash64("bucket", "lo", "hi"), F.lit(packs))
    return dealt.groupBy(pack).applyInPandas(compare, "id long, links long, other long")
