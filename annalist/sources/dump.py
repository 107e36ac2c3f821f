"""Extraction from JSON-lines entity dumps: documents in, model tables out, in one distributed pass."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.constants import ATTRIBUTE_PROPERTIES, CLASS_WHITELIST, DATE_PROPERTIES, QUALIFIER_PROPERTIES
from annalist.functions.time import parse_time
from annalist.scratch import written

SNAK = "struct<property:string,datavalue:struct<type:string,value:string>>"
ENTITY = f"""id string, labels map<string,struct<value:string>>, descriptions map<string,struct<value:string>>,
claims map<string,array<struct<mainsnak:{SNAK},qualifiers:map<string,array<{SNAK}>>,`qualifiers-order`:array<string>>>>,
sitelinks map<string,struct<title:string>>"""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def parse_entities(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, bad lines). A trailing comma is cut; brackets and broken lines have no id and are bad (brackets are dropped)."""
    text = F.regexp_replace("value", r",\s*$", "")
    # A generator, as the optimiser would parse a line again for every field that a filter or projection takes of it.
    parsed = lines.select(F.col("value").alias("line"), F.explode(F.array(F.from_json(text, ENTITY))).alias("e"))
    bad = parsed.where("e.id IS NULL AND trim(line) NOT IN ('', '[', ']')").select("line")
    return parsed.where("e.id IS NOT NULL AND e.id <> ''").select("e.*"), bad


def snak_value(snak: Column) -> Column:
    """(type, value, zone) of a snak with an entity or a time, else null."""
    kind, raw = snak["datavalue"]["type"], snak["datavalue"]["value"]
    entity, time = F.get_json_object(raw, "$.id"), F.get_json_object(raw, "$.time")
    zone = F.coalesce(F.get_json_object(raw, "$.timezone").try_cast("int"), F.lit(0))
    return F.when((kind == "wikibase-entityid") & (entity != ""), F.struct(kind.alias("type"), entity.alias("value"), F.lit(None).cast("int").alias("zone"))).when((kind == "time") & (time != ""), F.struct(kind.alias("type"), time.alias("value"), zone.alias("zone")))


def qualifier(claim: Column, wanted: Iterable[str] = QUALIFIER_PROPERTIES) -> Column:
    """(property, value) of the first wanted qualifier, in the claim's order, whose first snak has a value."""
    named = F.filter(F.coalesce(claim["qualifiers-order"], F.array().cast("array<string>")), lambda p: p.isin(*wanted))
    pairs = F.transform(named, lambda p: F.struct(p.alias("property"), snak_value(F.get(claim["qualifiers"][p], 0))["value"].alias("value")))
    return F.get(F.filter(pairs, lambda q: q["value"].isNotNull()), 0)


def statements(entities: DataFrame, properties: Iterable[str] | None = None) -> DataFrame:
    """(qid, property, pos, value, qual): a row per statement with a usable value, whatever its rank."""
    claims = entities.select(F.col("id").alias("qid"), F.explode("claims").alias("property", "list"))
    if properties is not None:
        claims = claims.where(F.col("property").isin(*properties))
    each = claims.select("qid", "property", F.posexplode("list").alias("pos", "claim"))
    same = F.col("claim.mainsnak.property") == F.col("property")
    return each.select("qid", "property", "pos", F.when(same, snak_value(F.col("claim.mainsnak"))).alias("value"), qualifier(F.col("claim")).alias("qual")).where("value IS NOT NULL")


def extract(entities: DataFrame, dates: Iterable[str] = DATE_PROPERTIES, classes: DataFrame | Iterable[str] = CLASS_WHITELIST, attributes: Iterable[str] = ATTRIBUTE_PROPERTIES, lng: str = "ru") -> dict[str, DataFrame]:
    """items, items_not_used, sites, item_classes, attributes and events of all entities.

    An entity is kept if it has a listed class and a dated statement. Repeated documents: the smallest struct of an id is
    its item. Of equal (item, property, time) the last statement wins; the first listed class is the event's class.
    classes is a list, or a DataFrame (id) that is joined whatever its size. Statements and heads are written once to the
    shared folder, so that the documents are parsed twice however many outputs are used.
    """
    found = written(statements(entities, [*dates, *attributes, "P31"]), "statements")
    kinds = found.where("property = 'P31' AND value.type = 'wikibase-entityid'").select("qid", "pos", F.col("value.value").alias("class"))
    if isinstance(classes, DataFrame):
        kinds = kinds.join(classes.select(F.col("id").alias("class")).distinct(), "class", "left_semi")
    else:
        kinds = kinds.where(F.col("class").isin(*classes))
    dated = found.where(F.col("property").isin(*dates) & (F.col("value.type") == "time"))
    first = kinds.groupBy("qid").agg(F.min_by("class", "pos").alias("class"))
    event = dated.groupBy("qid", "property", F.col("value.value").alias("time_raw")).agg(F.max_by(F.struct("value.zone", "qual"), "pos").alias("last"))
    event = event.join(first, "qid")
    time = parse_time(F.col("time_raw"))
    events = event.select("qid", "property", "class", "time_raw", *(v.alias(k) for k, v in time.items()), F.col("last.zone").alias("timezone"), F.col("last.qual.property").alias("qual_property"), F.col("last.qual.value").alias("qual_value"))
    kept = event.select("qid").distinct()
    label = lambda c, lang: F.col(c)[lang]["value"]
    extra = label("labels", lng)
    has = F.coalesce(extra, F.lit("")) != ""
    head = F.struct(F.coalesce(label("labels", "en"), F.lit("")).alias("label"), F.coalesce(label("descriptions", "en"), F.lit("")).alias("description"), F.when(has, extra).alias("label_ru"), F.when(has, label("descriptions", lng)).alias("description_ru"))
    link = F.struct(F.size("sitelinks").alias("sitelinks"), F.col("sitelinks")["enwiki"]["title"].alias("enwiki"), F.col("sitelinks")[f"{lng}wiki"]["title"].alias("ruwiki"))
    core = written(entities.select(F.col("id").alias("qid"), head.alias("head"), F.when(F.col("sitelinks").isNotNull(), link).alias("link")), "heads")
    heads = core.groupBy("qid").agg(F.min("head").alias("v")).select("qid", "v.*")
    links = core.where("link IS NOT NULL").groupBy("qid").agg(F.max("link").alias("v")).select("qid", "v.*")
    values = found.where(F.col("property").isin(*attributes) & (F.col("value.type") == "wikibase-entityid")).select("qid", "property", F.col("value.value").alias("value"))
    keep = lambda df: df.join(kept, "qid", "left_semi")
    return {
        "items": keep(heads),
        "items_not_used": heads.join(kept, "qid", "left_anti"),
        "sites": keep(links),
        "item_classes": keep(kinds.select("qid", "class").distinct()),
        "attributes": keep(values.distinct()),
        "events": events,
    }


def detect_classes(events: DataFrame) -> DataFrame:
    """(class): the distinct classes of events."""
    return events.where("class IS NOT NULL").select("class").distinct()
