"""Resumable extraction of dumps with Structured Streaming: chunks of files, a checkpoint, and guarded outputs."""

from __future__ import annotations

import enum

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession

from annalist import sinks
from annalist.scratch import cleared
from annalist.sources import dump
from annalist.sources.tables import exists


class Status(enum.IntEnum):
    MORE = 0
    ERROR = 1
    DONE = 2


def preflight(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that do not exist."""
    return [p for p in paths if not exists(spark, p)]


def guard_outputs(spark: SparkSession, output: str, checkpoint: str, force: bool = False) -> None:
    """Refuses output that no checkpoint explains, unless forced."""
    if not force and exists(spark, f"{output}/*") and not exists(spark, f"{checkpoint}/*"):
        raise FileExistsError(f"{output} has data, but {checkpoint} has no checkpoint")


def split_lines(spark: SparkSession, source: str, target: str, items: int) -> None:
    """The lines of a dump as files of `items` lines at most, once: a finished target stays as it is."""
    if not exists(spark, f"{target}/_SUCCESS"):
        spark.read.text(source).write.mode("overwrite").option("maxRecordsPerFile", items).text(target)


def ingest(spark: SparkSession, source: str, output: str, checkpoint: str, files_per_chunk: int = 16, max_chunks: int | None = None, force: bool = False, items_per_chunk: int | None = None, **options) -> Status:
    """Extract all files of `source` that the checkpoint has not seen, chunk by chunk, into tables under `output`.

    A chunk is written per batch, each output table under its batch's id, so a chunk that is run again replaces itself. An
    item that an earlier chunk has written is not written again. With max_chunks the run stops early and reports MORE; the
    next run goes on where this one ended. With items_per_chunk a chunk is so many lines at most, also inside one file: the
    dump is first split, in one distributed pass, into files under the checkpoint. A failed chunk gives ERROR, and the next
    run tries it again.
    """
    if preflight(spark, [source]):
        return Status.ERROR
    guard_outputs(spark, output, checkpoint, force)
    if items_per_chunk is not None:
        split_lines(spark, source, f"{checkpoint}-lines", items_per_chunk)
        source, files_per_chunk = f"{checkpoint}-lines", 1
    done = 0

    def write(batch: DataFrame, epoch: int) -> None:
        nonlocal done
        with cleared(batch.sparkSession):
            entities, bad = dump.parse_entities(batch)
            for name, table in dump.extract(entities, **options).items():
                if name in ("items", "items_not_used"):
                    table = sinks.first_wins(table, ["qid"], f"{output}/{name}", but=f"batch = {epoch}")
                sinks.replace(table, f"{output}/{name}/batch={epoch}")
            sinks.replace(bad, f"{output}/bad_lines/batch={epoch}")
        done += 1

    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_chunk).load(source)
    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if max_chunks is None:
        query = writer.trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except StreamingQueryException:
            return Status.ERROR
        return Status.DONE
    query = writer.trigger(processingTime="0 seconds").start()
    try:
        while query.isActive and done < max_chunks:
            if not (query.status["isDataAvailable"] or query.status["isTriggerActive"]) and (done or query.lastProgress):
                return Status.DONE
            query.awaitTermination(0.05)
    except StreamingQueryException:
        return Status.ERROR
    finally:
        query.stop()
    return Status.ERROR if query.exception() is not None and done < max_chunks else Status.MORE
