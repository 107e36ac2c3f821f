"""Helpers that the training-data operators share: written tables, Arrow batches, components."""

from __future__ import annotations

import ctypes
import gc
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_CHUNK = 1 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, default: int = 64 << 20, size: int = 4 << 20) -> None:
    """Arrow batches of 4 MB instead of 64 MB (a longer row is a batch of its own), unless the session has a size of its own."""
    if spark.conf.get(BATCH_BYTES).rstrip("b") == str(default):
        spark.conf.set(BATCH_BYTES, size)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where the session names none, a temporary one serves a
    local session, whose executor is this process; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="annalist-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/annalist-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def tidy(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """run, followed by the return of free memory to the system: Python workers outlive their tasks and stages."""

    def release() -> None:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: nothing to do
            pass

    if len(inspect.signature(run).parameters) == 1:

        def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from run(batches)
            release()

        return of_partition

    def of_group(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(key, batches)
        release()

    return of_group


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = TEXT_CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows whose `column` holds about `limit` bytes; a longer row is a slice of its own."""
    for batch in batches:
        array = batch.column(column)
        sizes = pc.binary_length(array).fill_null(0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Alternating large-star and small-star rounds in join form: a node's neighbours are never gathered in one row, and
    every half round is a written table, so plans stay small. Rounds go on until nothing moves (a round count that grows
    with the logarithm of the longest chain). Null ends and edges from a node to itself are ignored.
    """
    ends = lambda *pairs: F.explode(F.array(*(F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in pairs))).alias("e")
    pairs = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    state = None
    while True:
        # Large star: neighbours above a node move to the least of its neighbours and itself.
        low = pairs.select(ends("uv", "vu")).select("e.*").groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = materialize(pairs.join(low, "v").select("u", F.least("m", "v").alias("v")).distinct(), "cc")
        # Small star: neighbours below a node, and the node, move to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(ends("um", "vm")).select("e.*").where("u <> v").distinct()
        before, pairs = pairs, materialize(small, "cc")
        discard(before, large)
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    nodes = pairs.select(ends("uv", "vv")).select("e.*").groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    out = materialize(nodes, "components")
    discard(pairs)
    return out
