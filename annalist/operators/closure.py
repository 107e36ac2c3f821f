"""Transitive class closures over an edge table, pruning, and the mapping of occupations to areas."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.constants import AREA_SEEDS, CLASS_SEEDS, EXCLUDED_CLASSES, EXCLUDED_OCCUPATIONS, OCCUPATION, SUBCLASS
from annalist.scratch import written


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(qid, root): every descendant-or-self of every root. edges: (child, parent), cycles allowed; seeds: (qid, root).

    Each round's new pairs are written once; all pairs so far are one scan of the rounds' files, so no pair is written again.
    """
    frontier = written(seeds.select("qid", "root").distinct())
    seen, rounds = frontier, [frontier.written_to]
    links = edges.select("child", F.col("parent").alias("qid")).distinct()
    while True:
        step = frontier.join(links, "qid").select(F.col("child").alias("qid"), "root").distinct()
        frontier = written(step.join(seen, ["qid", "root"], "left_anti"))
        if frontier.isEmpty():
            return seen
        rounds.append(frontier.written_to)
        seen = edges.sparkSession.read.schema(frontier.schema).parquet(*rounds)


def seed_rows(seeds: DataFrame, instances: DataFrame) -> DataFrame:
    """(qid, root): the seeds themselves and, for seeds not of mode `subclass`, the instances of them. instances: (item, class)."""
    more = seeds.where(F.col("mode") != SUBCLASS).join(instances, F.col("qid") == F.col("class")).select(F.col("item").alias("qid"), F.col("qid").alias("root"))
    return seeds.select("qid", F.col("qid").alias("root")).unionByName(more)


def class_vocabulary(edges: DataFrame, instances: DataFrame, labels: DataFrame, seeds: Iterable[tuple] = CLASS_SEEDS, excluded: Iterable[tuple] = EXCLUDED_CLASSES, only_in: DataFrame | None = None) -> dict[str, DataFrame]:
    """classes and occupations (qid, label, description, domains), and the audit of what was pruned (with reasons).

    Descendants of excluded roots are subtracted; only_in (qid) restricts to ids that occur in a dump.
    """
    spark: SparkSession = edges.sparkSession
    table = spark.createDataFrame(list(seeds), "qid string, domain string, mode string")
    reached = closure(edges, seed_rows(table, instances)).join(table.select(F.col("qid").alias("root"), "domain", "mode"), "root")
    pruned_roots = spark.createDataFrame(list(excluded), "root string, reason string")
    pruned = closure(edges, pruned_roots.select(F.col("root").alias("qid"), "root")).join(pruned_roots, "root").groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("reason")), "|").alias("reasons"))
    named = labels.select("qid", "label", "description").dropDuplicates(["qid"])
    out = {}
    for name, own in (("classes", F.col("mode") != OCCUPATION), ("occupations", F.col("mode") == OCCUPATION)):
        tagged = reached.where(own).groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("domain")), "|").alias("domains"))
        if only_in is not None:
            tagged = tagged.join(only_in.select("qid").distinct(), "qid", "left_semi")
        full = tagged.join(named, "qid", "left").select("qid", "label", "description", "domains")
        out[name] = full.join(pruned, "qid", "left_anti")
        out[f"excluded_{name}"] = full.join(pruned, "qid")
    return out


def coverage(classes: DataFrame, occupations: DataFrame, in_dump: DataFrame) -> DataFrame:
    """One row: sizes of the class selection and of the occupation vocabulary, and how many selected classes (qid) a dump has."""
    met = classes.join(in_dump.select("qid").distinct(), "qid", "left_semi")
    return classes.agg(F.count("*").alias("classes")).crossJoin(met.agg(F.count("*").alias("in_dump"))).crossJoin(occupations.agg(F.count("*").alias("occupations")))


def seed_report(edges: DataFrame, instances: DataFrame, seeds: Iterable[tuple] = CLASS_SEEDS) -> DataFrame:
    """(seed, domain, mode, classes): how many classes each seed reaches, itself included."""
    table = edges.sparkSession.createDataFrame(list(seeds), "qid string, domain string, mode string")
    reached = closure(edges, seed_rows(table, instances)).groupBy(F.col("root").alias("qid")).agg(F.count("*").alias("classes"))
    return table.join(reached, "qid", "left").select(F.col("qid").alias("seed"), "domain", "mode", F.coalesce("classes", F.lit(0)).alias("classes"))


def by_number(df: DataFrame, column: str = "qid") -> DataFrame:
    """In the order of the ids' numbers."""
    return df.orderBy(F.substring(F.col(column), 2, 30).try_cast("long").asc_nulls_last(), column)


def used_occupations(attributes: DataFrame, value_items: DataFrame) -> DataFrame:
    """(qid, label, people): occupations in use with the number of distinct people who hold them."""
    used = attributes.where("property = 'P106'").groupBy(F.col("value").alias("qid")).agg(F.countDistinct("qid").alias("people"))
    return used.join(value_items.groupBy("qid").agg(F.max("label").alias("label")), "qid", "left").select("qid", "label", "people")


def occupation_areas(edges: DataFrame, instances: DataFrame, used: DataFrame, seeds: Iterable[tuple] = AREA_SEEDS, excluded: Iterable[tuple] = EXCLUDED_OCCUPATIONS, min_people: int = 1) -> DataFrame:
    """(qid, label, areas, people) of used occupations, most people first; teaching subtrees are subtracted."""
    spark = edges.sparkSession
    table = spark.createDataFrame([(qid, area, OCCUPATION) for area, qid in seeds], "qid string, area string, mode string")
    reached = closure(edges, seed_rows(table, instances)).join(table.select(F.col("qid").alias("root"), "area"), "root")
    pruned = spark.createDataFrame([(q, q) for q, _ in excluded], "qid string, root string")
    areas = reached.join(closure(edges, pruned), "qid", "left_anti").groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("area")), "|").alias("areas"))
    return used.where(F.col("people") >= min_people).join(areas, "qid").select("qid", "label", "areas", "people").orderBy(F.desc("people"), "qid")


def area_coverage(areas: DataFrame, used: DataFrame) -> DataFrame:
    """(area, occupations, pairs, share): person-occupation pairs per area and their share of all pairs."""
    total = used.agg(F.sum("people")).first()[0] or 1
    each = areas.select(F.explode(F.split("areas", r"\|")).alias("area"), "people")
    return each.groupBy("area").agg(F.count("*").alias("occupations"), F.sum("people").alias("pairs")).withColumn("share", F.col("pairs") / total)


def uncovered(areas: DataFrame, used: DataFrame, n: int = 20) -> DataFrame:
    """The n largest used occupations without an area."""
    return used.join(areas, "qid", "left_anti").orderBy(F.desc("people"), F.desc("label")).limit(n)
