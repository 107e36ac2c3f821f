"""Scans of the flat inputs: separated values, property dictionaries, selection lists, id lists and scraped pages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.constants import ATTRIBUTE_PROPERTIES, DATE_PROPERTIES
from annalist.functions.time import parse_time
from annalist.model import SCHEMAS

FILES = {
    "events": "key string, property string, time_raw string, type string, timezone string, qual_property string, qual_value string, qid string, class string",
    "items": "qid string, label string, description string, lng string, label_ru string, description_ru string",
    "attributes": "key string, property string, value string, qid string",
    "item_classes": "key string, qid string, class string",
    "sites": "qid string, sitelinks int, enwiki string, ruwiki string",
    "value_items": SCHEMAS["value_items"],
    "classes": SCHEMAS["classes"],
    "occupation_areas": SCHEMAS["occupation_areas"],
}


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place))


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """Semicolon-separated rows: quotes are doubled inside quotes, short rows end in nulls, # starts a comment line.

    Files are split among tasks; with multi_line, which line ends inside quotes need, a file is read by one task.
    """
    return spark.read.csv(path, sep=";", quote='"', escape='"', comment="#", schema=schema, mode="PERMISSIVE", multiLine=multi_line)


def parse_csv_line(line: str) -> list[str]:
    """Fields of one line; an empty line has none."""
    import csv

    return next(csv.reader([line], delimiter=";"), [])


def load_table(spark: SparkSession, name: str, path: str | None, multi_line: bool = False) -> DataFrame:
    """A model table from its file; a missing file gives an empty table."""
    if path is None or not exists(spark, path):
        return spark.createDataFrame([], SCHEMAS[name])
    raw = read_csv(spark, path, FILES[name], multi_line)
    if name == "events":
        zone, qual = F.col("timezone").try_cast("int"), lambda c: F.nullif(F.col(c), F.lit("0"))
        time = parse_time(F.col("time_raw"))
        raw = raw.select("qid", "property", "class", "time_raw", *(v.alias(k) for k, v in time.items()), zone.alias("timezone"), qual("qual_property").alias("qual_property"), qual("qual_value").alias("qual_value")).distinct()
    elif name == "items":
        raw = raw.drop("lng")
    elif name in ("attributes", "item_classes"):
        raw = raw.drop("key").distinct()
    elif name == "sites":
        raw = raw.select("qid", "sitelinks", F.nullif("enwiki", F.lit("")).alias("enwiki"), F.nullif("ruwiki", F.lit("")).alias("ruwiki"))
    return raw.select(*[c.split()[0] for c in SCHEMAS[name].split(", ")])


def read_items_tolerant(spark: SparkSession, path: str, lng: str = "ru") -> DataFrame:
    """Items of files whose descriptions hold unquoted semicolons: the language block splits each line reliably."""
    mark = f";{lng};"
    line = spark.read.text(path).select(F.regexp_extract("value", "^([^;]*);(.*)$", 1).alias("qid"), F.regexp_extract("value", "^([^;]*);(.*)$", 2).alias("rest"))
    has = F.instr("rest", mark) > 0
    line = line.select("qid", F.when(has, F.substring_index("rest", mark, 1)).otherwise(F.col("rest")).alias("en"), F.when(has, F.split_part("rest", F.lit(mark), F.lit(2))).alias("other"))
    name = lambda c: F.split_part(c, F.lit(";"), F.lit(1))
    tail = lambda c: F.when(F.instr(c, ";") > 0, F.substring(F.col(c), F.instr(c, ";") + 1, F.length(c)))
    return line.where("qid <> ''").select("qid", name(F.col("en")).alias("label"), tail("en").alias("description"), name(F.col("other")).alias("label_ru"), tail("other").alias("description_ru"))


def read_properties(spark: SparkSession, path: str, dates: Iterable[str] = DATE_PROPERTIES, attributes: Iterable[str] = ATTRIBUTE_PROPERTIES) -> DataFrame:
    """The property dictionary: one JSON object of [label, description] arrays, with each property's kind."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("pid", "pair"))
    kind = F.when(F.col("pid").isin(*dates), "date").when(F.col("pid").isin(*attributes), "attribute").otherwise("other")
    return whole.select("pid", F.get("pair", 0).alias("label"), F.get("pair", 1).alias("description"), kind.alias("kind"))


def get_property(properties: DataFrame, pid: str) -> tuple[str, str, str] | tuple:
    """(pid, label, description) of one property; an empty tuple if it is unknown."""
    row = properties.where(F.col("pid") == pid).select("pid", "label", "description").first()
    return tuple(row) if row else ()


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """(id): the first field of each line that is neither blank nor a comment."""
    first = F.trim(F.split_part(F.regexp_replace("value", "\r$", ""), F.lit(";"), F.lit(1)))
    return spark.read.text(path).where(~F.col("value").startswith("#")).select(first.alias("id")).where("id <> ''").distinct()


def selection(spark: SparkSession, path: str, default: Iterable[str]) -> tuple[DataFrame, int]:
    """(ids, their number) of the list at path, which replaces the default; the default and -1 if there is no such file."""
    if not exists(spark, path):
        return spark.createDataFrame([(x,) for x in default], "id string"), -1
    ids = read_selection(spark, path)
    return ids, ids.count()


def read_class_labels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, label, description) of rows with three fields or more; the second field is skipped."""
    raw = read_csv(spark, path, "qid string, skipped string, label string, description string").where("label IS NOT NULL")
    return raw.select("qid", "label", F.coalesce("description", F.lit("")).alias("description"))


def scrape_properties(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """(pid, label, description) from a list page: a line with a property link, its label and description on the next two.

    Known ids keep their rows, and so does the first of repeated ids. The page is one file, numbered as it is read.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line"))
    ahead = Window.orderBy("n")  # a page has a few thousand lines
    cut = lambda c: F.substring(c, 5, F.greatest(F.length(c) - 9, F.lit(0)))
    found = lines.select("n", "line", F.lead("line", 1).over(ahead).alias("l"), F.lead("line", 2).over(ahead).alias("d")).where(F.instr("line", '">P') > 1)
    found = found.select("n", F.regexp_extract("line", '">(P[^<]*)<', 1).alias("pid"), cut(F.col("l")).alias("label"), cut(F.col("d")).alias("description"))
    found = found.groupBy("pid").agg(F.min_by(F.struct("label", "description"), "n").alias("v")).select("pid", "v.*")
    return found if known is None else known.select("pid", "label", "description").unionByName(found.join(known, "pid", "left_anti"))
