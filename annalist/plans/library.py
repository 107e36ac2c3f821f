"""The canned analytic queries, each a function of the model and its parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.constants import CITIZENSHIP, OCCUPATION_PROPERTY
from annalist.functions.time import century_bucket
from annalist.model import Model


def _tagged(model: Model, *tags: str) -> DataFrame:
    """(qid, class, class_label, area): memberships in classes that carry any of the tags (all classes if none is named)."""
    classes = model.classes.select(F.col("qid").alias("class"), F.col("label").alias("class_label"), F.col("domains").alias("area"))
    if tags:
        classes = classes.where(F.arrays_overlap(F.split("area", r"\|"), F.array(*map(F.lit, tags))))
    return model.item_classes.join(classes, "class")


def joined(values: Column) -> Column:
    """Distinct values as one sorted, comma-separated text; null if there is none."""
    return F.nullif(F.array_join(F.array_sort(F.collect_set(values)), ", "), F.lit(""))


def events_of_year(model: Model, year: int, domains: tuple[str, ...]) -> DataFrame:
    names = model.properties.select(F.col("pid").alias("property"), F.col("label").alias("date_type"))
    dated = model.events.where(F.col("year") == year).select("qid", "property", "year")
    rows = dated.join(_tagged(model, *domains), "qid").join(names, "property").join(model.items.select("qid", "label", "description"), "qid")
    return rows.select("label", "description", F.col("class_label").alias("class"), "area", "date_type", "year").orderBy(F.asc_nulls_last("area"), F.asc_nulls_last("label"))


def items_by_century(model: Model, first: int, last: int) -> DataFrame:
    rows = model.events.where(F.col("year").between(first, last)).join(_tagged(model), "qid")
    return rows.groupBy(century_bucket(F.col("year")).alias("century"), "area").agg(F.countDistinct("qid").alias("items")).orderBy(F.desc("items"))


def people_of_area(model: Model, country: str, area: str, first: int, last: int) -> DataFrame:
    in_area = model.occupation_areas.where(F.array_contains(F.split("areas", r"\|"), area)).select(F.col("qid").alias("value"))
    experts = model.attributes.where(F.col("property") == OCCUPATION_PROPERTY).join(in_area, "value", "left_semi").select("qid")
    lives = model.lives(experts).where(F.col("born").between(first, last) | F.col("died").between(first, last))
    works = model.labelled(OCCUPATION_PROPERTY).select("qid", F.col("vlabel").alias("occupation"))
    citizens = model.labelled(CITIZENSHIP).where(F.col("vlabel").ilike(country)).select("qid", F.col("vlabel").alias("country"))
    rows = lives.join(citizens, "qid").join(works, "qid").join(model.items.select("qid", "label"), "qid")
    out = rows.groupBy("label").agg(joined(F.col("occupation")).alias("occupations"), joined(F.col("country")).alias("countries"), F.min("born").alias("born"), F.min("died").alias("died"))
    return out.orderBy(F.asc_nulls_last("born"), "label")


def people_by_occupation(model: Model, occupation: str, first: int, last: int) -> DataFrame:
    holders = model.labelled(OCCUPATION_PROPERTY).where(F.col("vlabel") == occupation).select("qid", F.col("vlabel").alias("occupation"))
    lives = model.lives(holders).where(F.col("born").between(first, last))
    return holders.join(lives, "qid").join(model.items.select("qid", "label"), "qid").select("label", "occupation", "born", "died").orderBy("born")


def _pivot(model: Model, dated: DataFrame, tag: str, properties: tuple[str, ...], aggregates: list[Column]) -> DataFrame:
    facts = model.attributes.where(F.col("property").isin(*properties)).select("qid", F.col("property").alias("prop"), "value")
    names = model.value_items.select(F.col("qid").alias("value"), F.col("label").alias("vlabel"))
    rows = dated.join(_tagged(model, tag).select("qid"), "qid").join(model.items.select("qid", "label"), "qid").join(facts, "qid", "left").join(names, "value", "left")
    return rows.groupBy("label").agg(*aggregates, F.min("year").alias("year"))


def _of(prop: str) -> Column:
    return F.when(F.col("prop") == prop, F.col("vlabel"))


def works_of_year(model: Model, year: int, domain: str) -> DataFrame:
    dated = model.events.where(F.col("year") == year).select("qid", "year")
    out = _pivot(model, dated, domain, ("P86", "P175", "P136"), [F.max(_of("P86")).alias("composer"), F.max(_of("P175")).alias("performer"), F.max(_of("P136")).alias("genre")])
    return out.withColumnRenamed("label", "work").orderBy("work")


def events_of_period(model: Model, first: int, last: int, domain: str, limit: int = 50) -> DataFrame:
    """The earliest `limit` events; equal years in order of the label."""
    dated = model.events.where(F.col("year").between(first, last)).select("qid", "year")
    out = _pivot(model, dated, domain, ("P17", "P276", "P710"), [F.max(_of("P17")).alias("country"), F.max(_of("P276")).alias("location"), joined(_of("P710")).alias("participants")])
    return out.withColumnRenamed("label", "event").orderBy(F.asc_nulls_last("year"), "event").limit(limit)


def occupation_counts(model: Model, limit: int = 200) -> DataFrame:
    rows = model.labelled(OCCUPATION_PROPERTY).groupBy(F.col("vlabel").alias("occupation")).agg(F.count("*").alias("people"))
    return rows.orderBy(F.desc("people"), "occupation").limit(limit)


def date_quality(model: Model) -> DataFrame:
    names = model.properties.select(F.col("pid").alias("property"), F.col("label").alias("date_type"))
    out = model.events.join(names, "property").groupBy("date_type").agg(F.count("*").alias("dates"), F.count_if(F.col("month") == 0).alias("year_only"), F.count_if("bc").alias("bc"), F.min("year").alias("earliest"), F.max("year").alias("latest"))
    return out.orderBy(F.desc("dates"))


def unresolved_values(model: Model) -> DataFrame:
    known = model.value_items.select(F.col("qid").alias("value"))
    return model.attributes.join(known, "value", "left_anti").groupBy("property").agg(F.count("*").alias("unresolved")).orderBy(F.desc("unresolved"))


def works_of_creator(model: Model, creator: str) -> DataFrame:
    made = model.labelled("P50", "P86", "P170").where(F.col("vlabel") == creator).select("qid").distinct()
    years = model.events.join(made, "qid", "left_semi").groupBy("qid").agg(F.min("year").alias("year"))
    return model.items.select("qid", F.col("label").alias("work")).join(made, "qid", "left_semi").distinct().join(years, "qid", "left").select("work", "year").orderBy(F.asc_nulls_last("year"))
