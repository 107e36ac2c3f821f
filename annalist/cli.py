"""Command line: python -m annalist.cli COMMAND ... ; each command is one function of the library on files."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from annalist import model as models
from annalist import sinks
from annalist.constants import ATTRIBUTE_PROPERTIES, CLASS_WHITELIST, DATE_PROPERTIES
from annalist.operators import closure as graph
from annalist.operators.resolve import resolve_values, wanted_ids
from annalist.plans.ask import run_status, train_step
from annalist.plans.intent import Unsupported, answer
from annalist.sources import tables
from annalist.streaming.ingest import ingest


def _extract(spark: SparkSession, a: argparse.Namespace) -> int:
    pick = lambda path, default: [r.id for r in tables.selection(spark, path, default)[0].collect()] if path else default
    classes = tables.selection(spark, a.classes, CLASS_WHITELIST)[0] if a.classes else CLASS_WHITELIST
    return int(ingest(spark, a.source, a.output, a.checkpoint, a.files, a.chunks, a.force, a.items, dates=pick(a.dates, DATE_PROPERTIES), classes=classes, attributes=pick(a.attributes, ATTRIBUTE_PROPERTIES)))


def _load(spark: SparkSession, a: argparse.Namespace) -> int:
    found = {}
    for name in models.SCHEMAS:
        path = f"{a.folder}/{name}.csv"
        if name == "properties":
            there = tables.exists(spark, f"{a.folder}/properties.json")
            found[name] = tables.read_properties(spark, f"{a.folder}/properties.json") if there else spark.createDataFrame([], models.SCHEMAS[name])
        elif name == "items" and a.tolerant and tables.exists(spark, path):
            found[name] = tables.read_items_tolerant(spark, path)
        else:
            found[name] = tables.load_table(spark, name, path, a.multi_line)
    models.save(models.Model(**found), a.model)
    for row in models.listing(models.load(spark, a.model)):
        print(*row)
    return 0


def _edges(spark: SparkSession, a: argparse.Namespace):
    read = lambda path, schema: tables.read_csv(spark, path, schema) if path else spark.createDataFrame([], schema)
    return read(a.edges, "child string, parent string"), read(a.instances, "item string, class string")


def _closure(spark: SparkSession, a: argparse.Namespace) -> int:
    edges, instances = _edges(spark, a)
    labels = tables.read_csv(spark, a.labels, "qid string, label string, description string")
    dump = tables.read_class_labels(spark, a.dump) if a.dump else None
    out = graph.class_vocabulary(edges, instances, labels, only_in=dump if a.only_in_dump else None)
    for name, table in out.items():
        sinks.write_csv(graph.by_number(table), f"{a.output}/{name}", "overwrite")
    sinks.write_csv(graph.seed_report(edges, instances), f"{a.output}/report", "overwrite")
    print(*graph.coverage(out["classes"], out["occupations"], dump if dump is not None else out["classes"]).first())
    return 0


def _areas(spark: SparkSession, a: argparse.Namespace) -> int:
    model = models.load(spark, a.model)
    used = graph.used_occupations(model.attributes, model.value_items)
    areas = graph.occupation_areas(*_edges(spark, a), used, min_people=a.min_people)
    sinks.write_csv(areas, a.output, "overwrite")
    for row in [*graph.area_coverage(areas, used).collect(), *graph.uncovered(areas, used, a.show).collect()]:
        print(*row)
    return 0


def _resolve(spark: SparkSession, a: argparse.Namespace) -> int:
    wanted = wanted_ids(tables.load_table(spark, "attributes", a.attributes), tables.load_table(spark, "item_classes", a.classes) if a.classes else None)
    names = tables.read_csv(spark, a.dictionary, "qid string, label string, description string")
    sinks.write_csv(resolve_values(names, wanted), a.output, "overwrite")
    return 0


def _answer(spark: SparkSession, a: argparse.Namespace) -> int:
    model = models.load(spark, a.model)
    if a.folder:
        train_step(model, a.folder, a.log, limit=a.limit, max_files=a.max_files)
        return 0
    intent = json.loads(Path(a.intent).read_text(encoding="utf-8"))
    try:
        found = answer(model, intent.get("intent", intent), a.limit)
    except Unsupported as e:
        print(e, file=sys.stderr)
        return 1
    for note in found.dropped:
        print("dropped:", note)
    found.rows.select(F.to_json(F.struct("*")).alias("row")).show(a.limit, truncate=False)
    return 0 if run_status(found)[0] == "success" else 1


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="annalist")
    commands = top.add_subparsers(required=True)

    def command(name, run, *needed, **more):
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        for x in needed:
            p.add_argument(x)
        for flag, (kind, default) in more.items():
            flag = "--" + flag.replace("_", "-")
            if kind is bool:
                p.add_argument(flag, action="store_true")
            else:
                p.add_argument(flag, type=kind, default=default)

    command("extract", _extract, "source", "output", "checkpoint", files=(int, 16), chunks=(int, None), items=(int, None), force=(bool, 0), dates=(str, None), classes=(str, None), attributes=(str, None))
    command("load", _load, "folder", "model", tolerant=(bool, 0), multi_line=(bool, 0))
    command("closure", _closure, "edges", "labels", "output", instances=(str, None), dump=(str, None), only_in_dump=(bool, 0))
    command("areas", _areas, "model", "edges", "output", instances=(str, None), min_people=(int, 1), show=(int, 20))
    command("resolve", _resolve, "dictionary", "attributes", "output", classes=(str, None))
    command("answer", _answer, "model", intent=(str, None), folder=(str, None), log=(str, "training.jsonl"), limit=(int, 200), max_files=(int, None))
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit codes of `extract`: 0 more to do, 1 error, 2 done; of the others 0 or 1."""
    parsed = parser().parse_args(args)
    return parsed.run(spark or SparkSession.builder.appName("annalist").getOrCreate(), parsed)


if __name__ == "__main__":
    sys.exit(main())
