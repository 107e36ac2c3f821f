"""The analytic model: nine tables with fixed schemas, kept as DataFrames."""

from __future__ import annotations

import dataclasses
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "items": "qid string, label string, description string, label_ru string, description_ru string",
    "properties": "pid string, label string, description string, kind string",
    "classes": "qid string, label string, description string, domains string",
    "value_items": "qid string, label string, description string",
    "occupation_areas": "qid string, label string, areas string, people long",
    "events": "qid string, property string, class string, time_raw string, year long, month short, day short, bc boolean, timezone int, qual_property string, qual_value string",
    "attributes": "qid string, property string, value string",
    "item_classes": "qid string, class string",
    "sites": "qid string, sitelinks int, enwiki string, ruwiki string",
}
#: Facts are written by property, which nearly every query filters on.
PARTITIONED = {"events": "property", "attributes": "property"}


@dataclasses.dataclass(frozen=True)
class Model:
    items: DataFrame
    properties: DataFrame
    classes: DataFrame
    value_items: DataFrame
    occupation_areas: DataFrame
    events: DataFrame
    attributes: DataFrame
    item_classes: DataFrame
    sites: DataFrame

    @functools.cached_property
    def lifespan(self) -> DataFrame:
        """(qid, born, died): the latest birth and death year of every item that has one of them."""
        return self.lives()

    def lives(self, of: DataFrame | None = None) -> DataFrame:
        """`lifespan` of the items of `of` (qid), which are picked before anything is grouped."""
        pick = lambda p: F.max(F.when(F.col("property") == p, F.col("year")))
        dated = self.events.where(F.col("property").isin("P569", "P570"))
        if of is not None:
            dated = dated.join(of.select("qid").distinct(), "qid", "left_semi")
        return dated.groupBy("qid").agg(pick("P569").alias("born"), pick("P570").alias("died"))

    @functools.cached_property
    def best_sites(self) -> DataFrame:
        return self.sites.groupBy("qid").agg(F.max("sitelinks").alias("sitelinks"))

    def labelled(self, *properties: str) -> DataFrame:
        """(qid, property, value, vlabel): attributes of these properties whose value has a label row."""
        names = self.value_items.select(F.col("qid").alias("value"), F.col("label").alias("vlabel"))
        return self.attributes.where(F.col("property").isin(*properties)).join(names, "value").select("qid", "property", "value", "vlabel")

    def of_domain(self, *tags: str) -> DataFrame:
        """(qid): distinct items with a class of any of the domains."""
        wanted = self.classes.where(F.arrays_overlap(F.split("domains", r"\|"), F.array(*map(F.lit, tags)))).select(F.col("qid").alias("class"))
        return self.item_classes.join(wanted, "class", "left_semi").select("qid").distinct()


def empty_model(spark: SparkSession) -> Model:
    return Model(**{name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()})


def save(model: Model, path: str) -> None:
    """Full rebuild of all tables under path."""
    for name in SCHEMAS:
        writer = getattr(model, name).write.mode("overwrite")
        (writer.partitionBy(PARTITIONED[name]) if name in PARTITIONED else writer).parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Model:
    """The saved tables; a table that was never written is empty."""
    found = {}
    for name, schema in SCHEMAS.items():
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
        found[name] = spark.read.schema(schema).parquet(f"{path}/{name}") if there else spark.createDataFrame([], schema)
    return Model(**found)


def listing(model: Model) -> list[tuple[str, int, int]]:
    """(table, rows, columns) of every table."""
    return [(name, getattr(model, name).count(), len(getattr(model, name).columns)) for name in SCHEMAS]
