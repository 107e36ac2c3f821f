"""Compiles a structured question (intent) into a DataFrame plan over the model.

Every filter is a left-semi join on the item id with a distinct key set, so filters never multiply rows and do not
depend on each other; answers are grouped by item before they are joined. `answer` returns the plan with the list of
filters that had to be dropped.
"""

from __future__ import annotations

import dataclasses
import operator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.constants import ANSWER_PLACES, AREA_WORDS, BIRTH, CITIZENSHIP, CREATOR_PROPERTIES, DEATH, DOMAINS, LONGEST_LIFE, OCCUPATION_PROPERTY, PARTICIPANT_PROPERTIES, PLACE_PROPERTIES, SUBJECT_PROPERTIES, TARGET_TYPES
from annalist.functions.text import fuzzy_labels, title_match, word_match
from annalist.model import Model
from annalist.plans.library import joined
from annalist.scratch import written


class Unsupported(ValueError):
    """The intent asks for something that no plan can answer."""


@dataclasses.dataclass
class Answer:
    rows: DataFrame
    dropped: list[str]


@dataclasses.dataclass
class Compiler:
    model: Model
    target: str
    strict: bool = False  # also keeps people out of answers about works and events
    dropped: list[str] = dataclasses.field(default_factory=list)

    def by_value(self, properties: tuple[str, ...], mention: str) -> DataFrame:
        """Items one of whose values under these properties has the mention in its label."""
        hits = self.model.value_items.where(word_match(F.col("label"), mention)).select(F.col("qid").alias("value"))
        return self.model.attributes.where(F.col("property").isin(*properties)).join(hits, "value", "left_semi").select("qid")

    def titled(self, mention: str) -> DataFrame:
        return self.model.items.where(title_match(F.col("label"), mention) | title_match(F.col("label_ru"), mention)).select("qid")

    def in_area(self, area: str) -> DataFrame:
        held = self.model.occupation_areas.where(F.array_contains(F.split("areas", r"\|"), area)).select(F.col("qid").alias("value"))
        return self.model.attributes.where(F.col("property") == OCCUPATION_PROPERTY).join(held, "value", "left_semi").select("qid")

    def related(self, relation: str | None, mention: str | None) -> DataFrame:
        if not mention:
            raise Unsupported("related_entity names no entity")
        attributes = self.model.attributes
        if relation == "creates" and self.target == "work":
            return self.by_value(CREATOR_PROPERTIES, mention)
        if relation == "creates" and self.target == "person":
            works = self.titled(mention)
            return attributes.where(F.col("property").isin(*CREATOR_PROPERTIES)).join(works, "qid", "left_semi").select(F.col("value").alias("qid"))
        if relation == "participates_in":
            back = attributes.where(F.col("property").isin(*PARTICIPANT_PROPERTIES)).join(self.titled(mention), "qid", "left_semi").select(F.col("value").alias("qid"))
            return self.by_value(PARTICIPANT_PROPERTIES, mention).union(back)
        if relation == "located_in":
            return self.by_value(PLACE_PROPERTIES[self.target], mention)
        raise Unsupported(f"relation {relation!r} of a {self.target}")

    def in_range(self, first: Any, last: Any) -> DataFrame:
        if first is None or last is None:
            raise Unsupported("in_range needs both years")
        dates = self.model.events
        if self.target == "person":
            dates = dates.where(F.col("property").isin(BIRTH, DEATH))
        return dates.where(F.col("year").between(first, last)).select("qid")

    def anchor(self, mention: str) -> DataFrame:
        """(a_born, a_died): the life of the best-documented item of that name; no row if there is none."""
        named = self.model.items.where(word_match(F.coalesce("label", "label_ru"), mention)).select("qid")
        lives = self.model.lives(named).where("born IS NOT NULL")
        facts = self.model.attributes.join(named, "qid", "left_semi").groupBy("qid").agg(F.count("*").alias("facts"))
        best = lives.join(facts, "qid", "left").orderBy(F.coalesce("facts", F.lit(0)).desc(), "qid").limit(1)
        return best.select(F.col("born").alias("a_born"), F.col("died").alias("a_died"))

    def relative(self, relation: str | None, mention: str | None) -> DataFrame:
        if not mention:
            raise Unsupported("relative_to_entity names no entity")
        born, end = F.col("born"), F.coalesce("died", "born")
        rules = {"overlap": (born <= F.col("a_died")) & (end >= F.col("a_born")), "before": end <= F.col("a_born"), "after": born >= F.col("a_died")}
        if relation not in rules:
            raise Unsupported(f"time relation {relation!r}")
        lives = self.model.lifespan.where(F.col("born").isNotNull() & (F.coalesce(F.col("died") - F.col("born"), F.lit(0)) <= LONGEST_LIFE))
        # The anchor is one row, by its limit.
        return lives.crossJoin(F.broadcast(self.anchor(mention))).where(rules[relation]).select("qid")

    def time(self, constraint: dict) -> DataFrame:
        kind = constraint.get("type")
        if kind == "in_range":
            return self.in_range(constraint.get("start_year"), constraint.get("end_year"))
        if kind == "relative_to_entity":
            return self.relative(constraint.get("relation"), constraint.get("entity_mention"))
        raise Unsupported(f"time constraint {kind!r}")

    def keys(self, filters: dict) -> list[DataFrame]:
        """The key sets that an item must be in."""
        out, areas = [], set()
        if self.target == "person":
            out.append(self.model.of_domain("person"))
        if name := filters.get("name"):
            out.append(self.titled(name))
        if work := (filters.get("occupation") or "").strip():
            if area := AREA_WORDS.get(work.lower()):
                areas.add(area)
                out.append(self.in_area(area))
            else:
                out.append(self.by_value((OCCUPATION_PROPERTY,), work))
        if place := filters.get("location"):
            out.append(self.by_value(PLACE_PROPERTIES[self.target], place))
        if domain := (filters.get("domain") or "").strip().lower():
            if self.target == "person" and domain in AREA_WORDS:
                if AREA_WORDS[domain] not in areas:
                    out.append(self.in_area(AREA_WORDS[domain]))
            elif domain in DOMAINS:
                out.append(self.model.of_domain(domain))
            else:
                self.dropped.append(f"domain={domain}")
        if subject := filters.get("subject"):
            out.append(self.by_value(SUBJECT_PROPERTIES, subject))
        if related := filters.get("related_entity"):
            out.append(self.related(related.get("relation"), related.get("entity_mention")))
        if constraint := filters.get("time_constraint"):
            out.append(self.time(constraint))
        return out


def _years(model: Model, filters: dict) -> DataFrame:
    constraint = filters.get("time_constraint") or {}
    dates = model.events
    if constraint.get("type") == "in_range":
        dates = dates.where(F.col("year").between(constraint["start_year"], constraint["end_year"]))
    return dates.groupBy("qid").agg(F.min("year").alias("year"))


def answer(model: Model, intent: dict, limit: int | None = 200, strict: bool = False) -> Answer:
    """The plan of an intent; a limit of None shows all rows. Ties of its order are broken by the item's id, which the answer does not show."""
    if not isinstance(intent, dict):
        raise Unsupported("the intent is no object")
    target, field, filters = intent.get("target_type"), intent.get("answer_field"), intent.get("filters") or {}
    if target not in TARGET_TYPES:
        raise Unsupported(f"target_type {target!r}")
    if filters.get("compare_entities"):
        return Answer(compare(model, filters["compare_entities"]), [])
    if field not in (None, "time", "location"):
        raise Unsupported(f"answer_field {field!r}")
    compiler = Compiler(model, target, strict)
    keys = compiler.keys(filters)
    if not keys:  # no filter, or none that constrains the answer
        raise Unsupported("no filter that can be applied")
    rows = model.items.select("qid", F.coalesce("label", "label_ru").alias(target))
    for k in keys:
        rows = rows.join(k.distinct(), "qid", "left_semi")
    if strict and target != "person":
        rows = rows.join(model.of_domain("person"), "qid", "left_anti")
    rows = rows.join(model.best_sites, "qid", "left")
    by_sites = [F.desc_nulls_last("sitelinks"), F.asc("qid")]
    if field == "location":
        places = model.labelled(*ANSWER_PLACES[target]).groupBy("qid").agg(joined(F.col("vlabel")).alias("location"))
        rows, order, shown = rows.join(places, "qid", "left"), by_sites, [target, "location", "sitelinks"]
    elif target == "person":
        rows = rows.join(model.lifespan, "qid", "left")
        order, shown = [F.asc_nulls_last("born"), *by_sites], ["person", "born", "died", "sitelinks"]
    else:
        rows = rows.join(_years(model, filters), "qid", "left")
        order, shown = [F.asc_nulls_last("year"), *by_sites], [target, "year", "sitelinks"]
    if filters.get("name"):
        order = by_sites
    rows = rows.orderBy(*order)
    return Answer((rows if limit is None else rows.limit(limit)).select(*shown), compiler.dropped)


def _facts(model: Model, mention: str, n: int) -> DataFrame:
    """One row about the best-known person of that name (none if there is none), columns ending in n."""
    people = model.items.select("qid", F.coalesce("label", "label_ru").alias("label")).join(model.of_domain("person"), "qid", "left_semi")
    near = fuzzy_labels(people, mention).select(F.col("label").alias("near"))
    named = people.join(near, people.label == near.near, "left").where(word_match(F.col("label"), mention) | F.col("near").isNotNull()).select("qid", "label")
    lives = model.lifespan.where("born IS NOT NULL")
    best = named.join(lives, "qid").join(model.best_sites, "qid", "left").orderBy(F.desc_nulls_last("sitelinks"), "qid").limit(1)
    best = written(best.select("qid", "label", "born", "died"), "entity")  # one row, which the facts below all start from
    works = model.attributes.where(F.col("property").isin(*CREATOR_PROPERTIES)).join(best.select(F.col("qid").alias("value")), "value", "left_semi").groupBy(F.col("value").alias("qid")).agg(F.countDistinct("qid").alias("works"))
    countries = model.labelled(CITIZENSHIP).join(best.select("qid"), "qid", "left_semi").groupBy("qid").agg(joined(F.col("vlabel")).alias("country"))
    out = best.join(works, "qid", "left").join(countries, "qid", "left")
    return out.select(F.col("label").alias(f"entity_{n}"), F.col("born").alias(f"born_{n}"), F.col("died").alias(f"died_{n}"), F.coalesce("works", F.lit(0).cast("long")).alias(f"works_{n}"), F.col("country").alias(f"country_{n}"))


def compare(model: Model, request: dict) -> DataFrame:
    """Two people head to head: their facts and `answer`; no row if one of them is unknown."""
    entities, aspect, relation = request.get("entities") or [], request.get("aspect"), request.get("relation")
    if len(entities) != 2:
        raise Unsupported("two entities are needed")
    both = _facts(model, entities[0], 1).crossJoin(F.broadcast(_facts(model, entities[1], 2)))  # one row each, by their limits
    b1, d1, b2, d2 = (F.col(c) for c in ("born_1", "died_1", "born_2", "died_2"))
    sane = (d1 - b1).between(0, LONGEST_LIFE) & (d2 - b2).between(0, LONGEST_LIFE)
    sizes: dict[str, Any] = {"more": operator.gt, "fewer": operator.lt, "equal": operator.eq}
    met = F.arrays_overlap(F.split("country_1", ", "), F.split("country_2", ", "))
    life = ["born_1", "died_1", "born_2", "died_2"]
    rules: dict[str, tuple[dict[str, Column], list[str]]] = {
        "time": ({"overlap": (b1 <= d2) & (d1 >= b2), "before": d1 <= b2, "after": b1 >= d2}, life),
        "age": ({k: f(d1 - b1, d2 - b2) for k, f in sizes.items()}, ["age_1", "age_2"]),
        "work_count": ({k: f(F.col("works_1"), F.col("works_2")) for k, f in sizes.items()}, ["works_1", "works_2"]),
        "location": ({"same": met, "different": ~met}, ["country_1", "country_2"]),
    }
    if aspect not in rules or relation not in rules[aspect][0]:
        raise Unsupported(f"comparison {aspect!r} {relation!r}")
    found = rules[aspect][0][relation]
    if aspect in ("time", "age"):
        found = F.when(sane, found)
    both = both.withColumns({"age_1": d1 - b1, "age_2": d2 - b2})
    return both.select("entity_1", "entity_2", *rules[aspect][1], found.alias("answer"))
