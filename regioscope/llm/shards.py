"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

Rows stand in source partitions (buckets of the hashed key). How many rows of each partition go to
each shard is drawn exactly: row by row of a multivariate hypergeometric with the shards' sizes as
margins, which is the law of a uniform permutation cut into shards. Each partition is then permuted
locally by a keyed hash, cut at its row of the matrix, exchanged, and permuted again inside the
shard. Shard sizes are exact (counts differ by one at most) and no global sort takes place.

Only numbers reach the driver: one count for each partition (100,000 rows or more), and one count for
each shard and slice. All row work is DataFrame functions. Slots come from slices of the second hash,
so no task holds a whole shard.

Edge cases: null text has 0 bytes (size 8) and the CRC of the empty text; null ids hash as null;
an empty table gives an empty result; repeated rows are rows of their own and get own slots.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


#: The generator draws exactly below this size.
DRAWN = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n draws without replacement from good + bad; exact at every size.

    Beyond the generator's range every item is taken with probability n / total (two binomials), and the few
    that are too many or missing are put back or drawn singly: places without repeats among those taken, or left.
    Given their number the taken ones are a uniform subset, and so is what remains.
    """
    if good == 0 or n == 0:
        return 0
    if bad == 0:
        return n
    if good < DRAWN and bad < DRAWN:
        return int(rng.hypergeometric(good, bad, n))
    p = n / (good + bad)
    x, y = int(rng.binomial(good, p)), int(rng.binomial(bad, p))
    surplus = x + y - n
    of, other = (x, y) if surplus > 0 else (good - x, bad - y)
    places: set[int] = set()
    while len(places) < abs(surplus):
        places.update(rng.integers(0, of + other, abs(surplus) - len(places)).tolist())
    return x - sum(i < of for i in places) if surplus > 0 else x + sum(i < of for i in places)


def matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Rows: partitions; columns: shards; margins are exactly counts and sizes."""
    rng, left = np.random.default_rng(seed), list(sizes)
    out = np.zeros((len(counts), len(sizes)), np.int64)
    for p, n in enumerate(counts):
        rest = sum(left)
        for s in range(len(sizes)):
            rest -= left[s]
            out[p, s] = x = hypergeometric(rng, left[s], rest, n)
            n -= x
        left = [a - int(b) for a, b in zip(left, out[p], strict=True)]
    return out


def shard(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = 24, partitions: int | None = None, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs``; by default a source partition for every 100,000 rows, 512 at least."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{key}`").alias("doc_id"), (F.octet_length(body) + 8).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"),
    )
    # the row's place spreads equal rows; it is written, so no later stage sees another one
    rows = cut(rows.withColumn("first", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size", F.monotonically_increasing_id())))
    partitions = partitions or max(512, rows.count() // 100_000)
    rows = rows.withColumn("part", F.pmod(F.col("first"), F.lit(partitions)).cast("int"))
    counts = {r.part: r["count"] for r in rows.groupBy("part").count().collect()}
    total = sum(counts.values())
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    slices = max(256, total // shards // 100_000)
    drawn = matrix([counts.get(p, 0) for p in range(partitions)], sizes, seed)
    cuts = spark.createDataFrame([(p, row.tolist()) for p, row in enumerate(np.cumsum(drawn, axis=1))], "part int, cuts array<bigint>")
    local = Window.partitionBy("part").orderBy("first", "doc_id", "text_crc32", "size")
    moved = (
        rows.withColumn("rank", F.row_number().over(local))
        .join(F.broadcast(cuts), "part")
        .withColumn("shard", F.size(F.filter("cuts", lambda c: c < F.col("rank"))).cast("int"))
        .withColumn("second", F.xxhash64(F.lit(seed + 1), "first", "rank"))
        .withColumn("slice", F.pmod(F.shiftrightunsigned("second", 20), F.lit(slices)).cast("int"))
        .drop("cuts", "rank", "part")
    )
    moved = cut(moved)
    held = {(r.shard, r.slice): r["count"] for r in moved.groupBy("shard", "slice").count().collect()}
    starts, at = [], 0
    for s in range(shards):
        at = 0
        for z in range(slices):
            if n := held.get((s, z), 0):
                starts.append((s, z, at))
                at += n
    base = spark.createDataFrame(starts, "shard int, slice int, base bigint")
    inside = Window.partitionBy("shard", "slice").orderBy("second", "first", "doc_id", "text_crc32", "size")
    return (
        moved.withColumn("k", F.row_number().over(inside))
        .join(F.broadcast(base), ["shard", "slice"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("k") - 1).cast("bigint").alias("slot"))
    )
