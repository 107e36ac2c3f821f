"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a temporary folder serves a local session, on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="annalist-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table: later plans start from it and do not compute it again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if (paths := _written.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


@contextlib.contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are deleted at the end, whether or not it succeeds; no later plan may read them."""
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(token)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
