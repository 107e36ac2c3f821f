"""Sinks: keyed and appending writes, separated values, routing, discard, and the training log."""

from __future__ import annotations

import datetime
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.sources.tables import exists

OUTPUTS = ("items", "items_not_used", "sites", "item_classes", "attributes", "events")


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the one of the largest `order`."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("__v")).select(*keys, "__v.*")


def first_wins(df: DataFrame, keys: list[str], path: str, order: str | None = None, but: str | None = None) -> DataFrame:
    """Rows whose key the Parquet table at path does not have yet; per key the row of the smallest `order` (without one, the
    least row). Rows of the table that meet the condition `but` do not count."""
    others = [c for c in df.columns if c not in keys]
    row = F.struct(*others)
    first = F.min(row) if order is None else F.min_by(row, order)
    fresh = df.groupBy(*keys).agg(first.alias("__v")).select(*keys, "__v.*").select(*df.columns) if others else df.distinct()
    if exists(df.sparkSession, f"{path}/*"):
        there = df.sparkSession.read.parquet(path)
        fresh = fresh.join((there if but is None else there.where(f"NOT ({but})")).select(*keys), keys, "left_anti")
    return fresh


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    """Semicolon-separated rows without a header; a field is quoted where it must be, with quotes doubled."""
    df.write.mode(mode).csv(path, sep=";", quote='"', escape='"', header=False, emptyValue="", nullValue="")


def quote_field(field: str) -> str:
    return '"' + field.replace('"', '""') + '"' if any(c in field for c in ';"\n\r') else field


def route(tables: dict[str, DataFrame], path: str) -> list[str]:
    """Append the known outputs to their own tables; other names are ignored. Returns what was written."""
    done = [name for name in OUTPUTS if name in tables]
    for name in done:
        append(tables[name], f"{path}/{name}")
    return done


def discard(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def log_training_example(path: str, prompt: str, completion: str, **details) -> dict:
    """Append one example as a JSON line: when, which model, what it was asked and said, the plan that ran and the one that the
    compiler made (gold), and how the run went; human_correct stays open."""
    fields = ("model", "sql", "sql_source", "gold_sql", "db_status", "db_error", "row_count")
    record = {"timestamp": datetime.datetime.now(datetime.UTC).isoformat(), "prompt": prompt, "completion": completion, "human_correct": None, **dict.fromkeys(fields), **details}
    with Path(path).open("a", encoding="utf-8") as out:
        out.write(json.dumps(record, ensure_ascii=False) + "\n")
    return record
