"""Session helpers shared by the text operators: durable cuts of lineage and connected components."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_written: dict[int, str] = {}
_made: list[str] = []  # every cut's folder, in order, until it is deleted
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; they cross to Python in Arrow batches of at most 2,000 rows, and of the session's bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return read(spark, sf_dir, "documents")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session without one (tests) gets its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def small_batches(spark: SparkSession) -> None:
    """From now on rows cross to Python in Arrow batches of at most 2,000 rows and some 4 MB: what operators hold is counted in whole batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder as Parquet and read back: lineage ends there and columns can be pruned.

    The shuffle files of the write go as soon as it is done, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before else spark.conf.unset(_CLEANUP)
    _made.append(path)
    got = spark.read.schema(df.schema).parquet(path)
    _written[id(got)] = path
    weakref.finalize(got, _written.pop, id(got), None)
    return got


def release(*frames: DataFrame) -> None:
    """Deletes the files of cut frames that nothing lazy reads any more: all that was derived from them is written."""
    for df in frames:
        if path := _written.get(id(df)):
            _delete(df.sparkSession, path)


def mark() -> int:
    """A place in the order of cuts, for ``release_since``."""
    return len(_made)


def release_since(place: int, kept: DataFrame) -> None:
    """Deletes the files of all cuts made since ``mark`` but those of ``kept``, which is itself a cut of what was derived from them."""
    for path in _made[place:]:
        if path != _written.get(id(kept)):
            _delete(kept.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _made:
        _made.remove(path)


#: Rows of two longs up to which a lookup table is broadcast (16 MB); beyond, a merge join that the engine splits on skew.
LOOKUP_ROWS = 1_000_000
#: A small step runs in so many tasks at least.
TASKS = 12


def few(df: DataFrame, rows: int, each: int = 10_000) -> DataFrame:
    """A shuffle's result in no more tasks than its counted rows ask for; a large one keeps all its partitions."""
    return df.coalesce(max(TASKS, rows // each))


def lookup(df: DataFrame, rows: int) -> DataFrame:
    """A table of counted rows, for a join: broadcast if small."""
    return F.broadcast(df) if rows <= LOOKUP_ROWS else df


def _with_least(e: DataFrame, rows: int, files: int) -> tuple[DataFrame, DataFrame]:
    """(e with m, the least of each u and its neighbours; the lookup u, m). A hub's edges stay spread over tasks.

    The lookup is broadcast where it is small, as counted; else it is written first, so that the join
    reads two plain shuffles and adaptive execution deals a hub's rows out.
    """
    low = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(files)
    low = F.broadcast(low) if rows <= LOOKUP_ROWS else cut(low)
    return e.join(low, "u"), low


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component), written: the least node reachable, for every node with an edge.

    Alternating large-star and small-star steps: each is one grouped minimum and one join on the
    node, so a node of any degree is handled by partial aggregation, and the number of rounds grows
    with the logarithm of a component's diameter. Every round is written to the shared folder, and
    rounds go on until nothing changes. An edge may stand several times. A round's steps run in as many
    tasks as its edges ask for, whatever the session's number of shuffle partitions.
    """
    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"))
    rows = e.count()
    files = max(4, rows // 200_000)  # a round's edges are no more than the first ones; small graphs stay in few files
    last = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, _ = _with_least(both, 2 * rows, files)
        large = cut(large.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(files))
        small, low = _with_least(large, rows, files)  # u's neighbours are all smaller, and so is m
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        before, e = e, cut(small.distinct().coalesce(files))
        release(before, large)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    star = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").coalesce(files)
    roots = star.select(F.col("component").alias("node"), "component").distinct().coalesce(files)
    got = cut(star.union(roots))
    release(e)
    return got
