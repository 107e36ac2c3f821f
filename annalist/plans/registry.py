"""Registered queries over the knowledge graph derived from the star-schema tables, and SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions.text import jaro_winkler_udf
from annalist.functions.time import century_bucket, century_floor
from annalist.operators import closure as graph
from annalist.operators.resolve import resolve_lines, resolve_values, wanted_ids
from annalist.plans import library
from annalist.plans.derived import derived_model, with_views
from annalist.plans.intent import answer
from annalist.sources import dump

Query = Callable[[SparkSession, str], DataFrame]

LIBRARY = {
    "q1_events_of_year": lambda m: library.events_of_year(m, 1995, ("music", "literature")),
    "q2_items_by_century": lambda m: library.items_by_century(m, 1900, 1999),
    "q3_people_of_area": lambda m: library.people_of_area(m, "%NATION_1%", "science", 1992, 1996),
    "q4_people_by_occupation": lambda m: library.people_by_occupation(m, "building", 1995, 1996),
    "q5_works_of_year": lambda m: library.works_of_year(m, 1996, "literature"),
    "q6_events_of_period": lambda m: library.events_of_period(m, 1995, 1996, "event"),
    "q7_occupation_counts": lambda m: library.occupation_counts(m),
    "q8a_date_quality": lambda m: library.date_quality(m),
    "q8b_unresolved_values": lambda m: library.unresolved_values(m),
    "q9_works_of_creator": lambda m: library.works_of_creator(m, CREATOR),
}
CREATOR = "Customer#000000010"

TAGGED = "SELECT ic.qid, k.label AS class, k.domains AS area FROM kg_item_classes ic JOIN kg_classes k ON k.qid = ic.class"
LIVES = "SELECT qid, max(CASE WHEN property = 'P569' THEN year END) AS born, max(CASE WHEN property = 'P570' THEN year END) AS died FROM kg_events GROUP BY qid"
VALUES = "SELECT a.qid, a.property, a.value, v.label AS vlabel FROM kg_attributes a JOIN kg_value_items v ON v.qid = a.value"
LISTED = "array_to_string(list_sort(list_distinct(list({0}) FILTER (WHERE {0} IS NOT NULL))), ', ')"

LIBRARY_SQL = {
    "q1_events_of_year": f", t AS ({TAGGED}) SELECT i.label, i.description, t.class, t.area, p.label AS date_type, e.year FROM kg_events e, t, kg_items i, kg_properties p WHERE t.qid = e.qid AND i.qid = e.qid AND p.pid = e.property AND e.year = 1995 AND list_has_any(string_split(t.area, '|'), ['music', 'literature'])",
    "q2_items_by_century": f", t AS ({TAGGED}) SELECT CAST(round_even(e.year / 100, 0) AS BIGINT) * 100 AS century, t.area, count(DISTINCT e.qid) AS items FROM kg_events e JOIN t ON t.qid = e.qid WHERE e.year >= 1900 AND e.year <= 1999 GROUP BY ALL",
    "q3_people_of_area": f", lf AS ({LIVES}), va AS ({VALUES}) SELECT i.label, {LISTED.format('o.vlabel')} AS occupations, {LISTED.format('z.vlabel')} AS countries, min(lf.born) AS born, min(lf.died) AS died FROM lf JOIN kg_items i ON i.qid = lf.qid JOIN va o ON o.qid = lf.qid AND o.property = 'P106' JOIN va z ON z.qid = lf.qid AND z.property = 'P27' WHERE z.vlabel ILIKE '%NATION_1%' AND lf.qid IN (SELECT a.qid FROM kg_attributes a, kg_occupation_areas oa WHERE oa.qid = a.value AND a.property = 'P106' AND list_contains(string_split(oa.areas, '|'), 'science')) AND (lf.born BETWEEN 1992 AND 1996 OR lf.died BETWEEN 1992 AND 1996) GROUP BY i.label",
    "q4_people_by_occupation": f", lf AS ({LIVES}), va AS ({VALUES}) SELECT i.label, va.vlabel AS occupation, lf.born, lf.died FROM va, kg_items i, lf WHERE i.qid = va.qid AND lf.qid = va.qid AND va.property = 'P106' AND va.vlabel = 'building' AND lf.born BETWEEN 1995 AND 1996",
    "q5_works_of_year": f", t AS ({TAGGED}), va AS ({VALUES}) SELECT i.label AS work, max(va.vlabel) FILTER (WHERE va.property = 'P86') AS composer, max(va.vlabel) FILTER (WHERE va.property = 'P175') AS performer, max(va.vlabel) FILTER (WHERE va.property = 'P136') AS genre, min(e.year) AS year FROM kg_events e JOIN kg_items i ON i.qid = e.qid JOIN t ON t.qid = e.qid LEFT JOIN va ON va.qid = e.qid AND va.property IN ('P86', 'P175', 'P136') WHERE e.year = 1996 AND list_contains(string_split(t.area, '|'), 'literature') GROUP BY i.label",
    "q6_events_of_period": f", t AS ({TAGGED}), va AS ({VALUES}) SELECT i.label AS event, max(va.vlabel) FILTER (WHERE va.property = 'P17') AS country, max(va.vlabel) FILTER (WHERE va.property = 'P276') AS location, {LISTED.format(chr(40) + 'CASE WHEN va.property = ' + chr(39) + 'P710' + chr(39) + ' THEN va.vlabel END' + chr(41))} AS participants, min(e.year) AS year FROM kg_events e JOIN kg_items i ON i.qid = e.qid JOIN t ON t.qid = e.qid LEFT JOIN va ON va.qid = e.qid AND va.property IN ('P17', 'P276', 'P710') WHERE e.year BETWEEN 1995 AND 1996 AND list_contains(string_split(t.area, '|'), 'event') GROUP BY i.label ORDER BY year NULLS LAST, event LIMIT 50",
    "q7_occupation_counts": f", va AS ({VALUES}) SELECT vlabel AS occupation, count(*) AS people FROM va WHERE property = 'P106' GROUP BY vlabel ORDER BY people DESC, occupation LIMIT 200",
    "q8a_date_quality": " SELECT p.label AS date_type, count(*) AS dates, count(CASE WHEN e.month = 0 THEN 1 END) AS year_only, count(CASE WHEN e.bc THEN 1 END) AS bc, min(e.year) AS earliest, max(e.year) AS latest FROM kg_events e, kg_properties p WHERE p.pid = e.property GROUP BY p.label",
    "q8b_unresolved_values": " SELECT property, count(*) AS unresolved FROM kg_attributes WHERE value NOT IN (SELECT qid FROM kg_value_items) GROUP BY property",
    "q9_works_of_creator": f", va AS ({VALUES}) SELECT i.label AS work, min(e.year) AS year FROM kg_items i LEFT JOIN kg_events e ON e.qid = i.qid WHERE i.qid IN (SELECT qid FROM va WHERE property IN ('P50', 'P86', 'P170') AND vlabel = '{CREATOR}') GROUP BY i.qid, i.label",
}


def _intent(target: str, field: str | None = None, **filters) -> dict:
    return {"target_type": target, "answer_field": field, "filters": filters}


ALL = None  # the composer's limit is a feature; here all rows are asked for
RANGE = {"type": "in_range", "start_year": 1994, "end_year": 1995}
INTENTS = {
    "intent_name": _intent("person", name="Customer 00001"),
    "intent_area_location": _intent("person", occupation="scientists", location="NATION_1"),
    "intent_occupation_range": _intent("person", occupation="furniture", time_constraint=RANGE),
    "intent_domain_range": _intent("event", domain="event", time_constraint=RANGE),
    "intent_creates_work": _intent("work", related_entity={"relation": "creates", "entity_mention": CREATOR}),
    "intent_creates_person": _intent("person", related_entity={"relation": "creates", "entity_mention": "Order 100"}),
    "intent_participates": _intent("event", related_entity={"relation": "participates_in", "entity_mention": "Supplier#000000001"}),
    "intent_subject_location": _intent("work", "location", subject="small", location="NATION_2"),
    "intent_before": _intent("person", time_constraint={"type": "relative_to_entity", "relation": "before", "entity_mention": CREATOR}),
    "intent_after": _intent("person", time_constraint={"type": "relative_to_entity", "relation": "after", "entity_mention": CREATOR}),
    "intent_located_in": _intent("event", domain="event", related_entity={"relation": "located_in", "entity_mention": "NATION_3"}),
    "intent_work_name": _intent("work", name="small"),
    "intent_work_name_location": _intent("work", "location", name="small"),
    "intent_person_location": _intent("person", "location", name="Customer 0001"),
    "intent_everyone_of_unknown_domain": _intent("person", domain="architecture"),
    "intent_overlap_area": _intent("person", domain="music", time_constraint={"type": "relative_to_entity", "relation": "overlap", "entity_mention": CREATOR}),
}
PEOPLE = "i.qid IN (SELECT ic.qid FROM kg_item_classes ic, kg_classes k WHERE k.qid = ic.class AND k.domains = 'person')"
IN_AREA = "i.qid IN (SELECT a.qid FROM kg_attributes a, kg_occupation_areas o WHERE o.qid = a.value AND a.property = 'P106' AND list_contains(string_split(o.areas, '|'), '{}'))"
BY_VALUE = r"i.qid IN (SELECT qid FROM va WHERE property IN ({}) AND regexp_matches(vlabel, '(?i)\b{}'))"
DATED = "i.qid IN (SELECT qid FROM kg_events WHERE year BETWEEN 1994 AND 1995{})"
ANCHOR = rf"(SELECT lf.born, lf.died FROM kg_items x JOIN lf ON lf.qid = x.qid LEFT JOIN (SELECT qid, count(*) AS n FROM kg_attributes GROUP BY qid) c ON c.qid = x.qid WHERE regexp_matches(x.label, '(?i)\b{CREATOR}') AND lf.born IS NOT NULL ORDER BY coalesce(n, 0) DESC, x.qid LIMIT 1)"
REL = f"i.qid IN (SELECT lf.qid FROM lf, {ANCHOR} z WHERE lf.born IS NOT NULL AND coalesce(lf.died - lf.born, 0) <= 110 AND {{}})"


def _person_sql(*tests: str) -> str:
    return f", lf AS ({LIVES}), va AS ({VALUES}), st AS (SELECT qid, max(sitelinks) AS sitelinks FROM kg_sites GROUP BY qid) SELECT coalesce(i.label, i.label_ru) AS person, lf.born, lf.died, st.sitelinks FROM kg_items i LEFT JOIN lf ON lf.qid = i.qid LEFT JOIN st ON st.qid = i.qid WHERE " + " AND ".join((PEOPLE, *tests))


def _dated_sql(target: str, window: str, *tests: str) -> str:
    return f", va AS ({VALUES}), st AS (SELECT qid, max(sitelinks) AS sitelinks FROM kg_sites GROUP BY qid), y AS (SELECT qid, min(year) AS year FROM kg_events {window} GROUP BY qid) SELECT coalesce(i.label, i.label_ru) AS {target}, y.year, st.sitelinks FROM kg_items i LEFT JOIN y ON y.qid = i.qid LEFT JOIN st ON st.qid = i.qid WHERE " + " AND ".join(tests)


NAMED = "(i.label ILIKE '%{0}%' OR i.label_ru ILIKE '%{0}%')"


def _place_sql(target: str, properties: str, *tests: str) -> str:
    return f", va AS ({VALUES}), st AS (SELECT qid, max(sitelinks) AS sitelinks FROM kg_sites GROUP BY qid), pl AS (SELECT qid, {LISTED.format('vlabel')} AS location FROM va WHERE property IN ({properties}) GROUP BY qid) SELECT coalesce(i.label, i.label_ru) AS {target}, pl.location, st.sitelinks FROM kg_items i LEFT JOIN pl ON pl.qid = i.qid LEFT JOIN st ON st.qid = i.qid WHERE " + " AND ".join(tests)


INTENT_SQL = {
    "intent_name": _person_sql("i.label ILIKE '%Customer%00001%'"),
    "intent_area_location": _person_sql(IN_AREA.format("science"), BY_VALUE.format("'P27','P19','P20','P937'", "NATION_1")),
    "intent_occupation_range": _person_sql(BY_VALUE.format("'P106'", "furniture"), DATED.format(" AND property IN ('P569', 'P570')")),
    "intent_domain_range": _dated_sql("event", "WHERE year BETWEEN 1994 AND 1995", "i.qid IN (SELECT ic.qid FROM kg_item_classes ic, kg_classes k WHERE k.qid = ic.class AND list_contains(string_split(k.domains, '|'), 'event'))", DATED.format("")),
    "intent_creates_work": _dated_sql("work", "", BY_VALUE.format("'P50','P86','P170','P175','P676'", CREATOR)),
    "intent_creates_person": _person_sql("i.qid IN (SELECT a.value FROM kg_attributes a JOIN kg_items w ON w.qid = a.qid WHERE a.property IN ('P50','P86','P170','P175','P676') AND w.label ILIKE '%Order%100%')"),
    "intent_participates": _dated_sql("event", "", "(" + BY_VALUE.format("'P710','P1344'", "Supplier#000000001") + " OR i.qid IN (SELECT a.value FROM kg_attributes a JOIN kg_items w ON w.qid = a.qid WHERE a.property IN ('P710','P1344') AND w.label ILIKE '%Supplier#000000001%'))"),
    "intent_subject_location": _place_sql("work", "'P17', 'P276'", BY_VALUE.format("'P921','P101','P136'", "small"), BY_VALUE.format("'P17','P276'", "NATION_2")),
    "intent_located_in": _dated_sql("event", "", "i.qid IN (SELECT ic.qid FROM kg_item_classes ic, kg_classes k WHERE k.qid = ic.class AND list_contains(string_split(k.domains, '|'), 'event'))", BY_VALUE.format("'P17','P276'", "NATION_3")),
    "intent_work_name": _dated_sql("work", "", NAMED.format("small")),
    "intent_work_name_location": _place_sql("work", "'P17', 'P276'", NAMED.format("small")),
    "intent_person_location": _place_sql("person", "'P19'", PEOPLE, NAMED.format("Customer%0001")),
    "intent_everyone_of_unknown_domain": _person_sql(),
    "intent_before": _person_sql(REL.format("coalesce(lf.died, lf.born) <= z.born")),
    "intent_after": _person_sql(REL.format("lf.born >= z.died")),
    "intent_overlap_area": _person_sql(IN_AREA.format("music"), REL.format("lf.born <= z.died AND coalesce(lf.died, lf.born) >= z.born")),
}

PAIR = [CREATOR, "Customer#000000013"]
COMPARES = {
    f"compare_{aspect}{'' if i == 0 else '_' + relation}": {"entities": PAIR, "aspect": aspect, "relation": relation}
    for aspect, relations in (("time", ("overlap", "before", "after")), ("age", ("more", "fewer", "equal")), ("work_count", ("more", "fewer", "equal")), ("location", ("same", "different")))
    for i, relation in enumerate(relations)
}
_FACTS = r"""(SELECT i.qid, coalesce(i.label, i.label_ru) AS label, lf.born, lf.died, (SELECT count(DISTINCT a.qid) FROM kg_attributes a WHERE a.value = i.qid AND a.property IN ('P50','P86','P170','P175','P676')) AS works, (SELECT list_sort(list_distinct(list(vlabel))) FROM va WHERE va.qid = i.qid AND property = 'P27') AS countries
 FROM kg_items i JOIN lf ON lf.qid = i.qid LEFT JOIN (SELECT qid, max(sitelinks) AS s FROM kg_sites GROUP BY qid) st ON st.qid = i.qid
 WHERE %s AND lf.born IS NOT NULL AND (regexp_matches(coalesce(i.label, i.label_ru), '(?i)\b{0}') OR len(list_filter(string_split('{0}', ' '), lambda w: len(list_filter(string_split(coalesce(i.label, i.label_ru), ' '), lambda x: jaro_winkler_similarity(w, x) >= 0.9)) > 0)) = len(string_split('{0}', ' ')))
 ORDER BY s DESC NULLS LAST, i.qid LIMIT 1)""" % PEOPLE  # noqa: UP031
_SANE = "CASE WHEN a.died - a.born BETWEEN 0 AND 110 AND b.died - b.born BETWEEN 0 AND 110 THEN {} END"
_RULES = {
    "time": {"overlap": _SANE.format("a.born <= b.died AND a.died >= b.born"), "before": _SANE.format("a.died <= b.born"), "after": _SANE.format("a.born >= b.died")},
    "age": {k: _SANE.format(f"a.died - a.born {o} b.died - b.born") for k, o in (("more", ">"), ("fewer", "<"), ("equal", "="))},
    "work_count": {k: f"a.works {o} b.works" for k, o in (("more", ">"), ("fewer", "<"), ("equal", "="))},
    "location": {"same": "list_has_any(a.countries, b.countries)", "different": "NOT list_has_any(a.countries, b.countries)"},
}
_SHOWN = {
    "time": "a.born AS born_1, a.died AS died_1, b.born AS born_2, b.died AS died_2",
    "age": "a.died - a.born AS age_1, b.died - b.born AS age_2",
    "work_count": "a.works AS works_1, b.works AS works_2",
    "location": "array_to_string(a.countries, ', ') AS country_1, array_to_string(b.countries, ', ') AS country_2",
}
COMPARE_SQL = {k: f", lf AS ({LIVES}), va AS ({VALUES}) SELECT a.label AS entity_1, b.label AS entity_2, {_SHOWN[c['aspect']]}, {_RULES[c['aspect']][c['relation']]} AS answer FROM {_FACTS.format(PAIR[0])} a, {_FACTS.format(PAIR[1])} b" for k, c in COMPARES.items()}

DUMP_LINES = """
SELECT to_json(named_struct('id', qid, 'labels', map('en', named_struct('value', label)), 'descriptions', map('en', named_struct('value', description)),
 'claims', map('P31', kinds, 'P571', dates, 'P170', makers), 'sitelinks', map('enwiki', named_struct('title', label)))) || ',' AS value
FROM (SELECT 'Q' || o_orderkey AS qid, 'Order No. ' || o_orderkey AS label, o_orderpriority AS description,
 array(named_struct('mainsnak', named_struct('property', 'P31', 'datavalue', named_struct('type', 'wikibase-entityid', 'value', named_struct('id', if(o_orderpriority LIKE '1%', 'KU', 'KO'), 'time', cast(null as string)))))) AS kinds,
 array(named_struct('mainsnak', named_struct('property', 'P571', 'datavalue', named_struct('type', 'time', 'value', named_struct('id', cast(null as string), 'time', date_format(o_orderdate, '+yyyy-MM-dd') || 'T00:00:00Z'))))) AS dates,
 array(named_struct('mainsnak', named_struct('property', 'P170', 'datavalue', named_struct('type', 'wikibase-entityid', 'value', named_struct('id', 'QC' || o_custkey, 'time', cast(null as string)))))) AS makers
 FROM {orders})"""


def _lines(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Lines of a dump, spread over the cores as the splits of a real dump would be (the table is one small file)."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").repartition(spark.sparkContext.defaultParallelism)
    return spark.sql(text, orders=orders)


def _dump(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    entities, _ = dump.parse_entities(_lines(spark, sf_dir, DUMP_LINES))
    return dump.extract(entities, classes=["KU"])


def dump_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dump(spark, sf_dir)["events"].select("qid", "property", "class", "time_raw", "year", F.col("month").cast("int").alias("month"), F.col("day").cast("int").alias("day"), "bc", "timezone")


def dump_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dump(spark, sf_dir)["attributes"]


def dump_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dump(spark, sf_dir)["items_not_used"].select("qid", "label", "description")


def _snak(prop: str, kind: str, value: str) -> str:
    field = f"'id', {value}, 'time', cast(null as string), 'timezone', cast(null as int)" if kind == "wikibase-entityid" else f"'id', cast(null as string), 'time', {value}, 'timezone', 60"
    return f"named_struct('property', '{prop}', 'datavalue', named_struct('type', '{kind}', 'value', named_struct({field})))"


def _claim(prop: str, kind: str, value: str, qualifiers: str = "map()", order: str = "array()") -> str:
    return f"named_struct('mainsnak', {_snak(prop, kind, value)}, 'rank', 'deprecated', 'qualifiers', {qualifiers}, 'qualifiers-order', {order})"


_QUAL = "map('P1', array({0}), 'P805', array({1}))".format(_snak("P1", "wikibase-entityid", "'Q1'"), _snak("P805", "wikibase-entityid", "'QC' || o_custkey"))
#: Two classes, an unwanted one first; three statements of one date, the last of them with a qualifier; a BC date.
RICH_LINES = f"""
SELECT to_json(named_struct('id', 'Q' || o_orderkey, 'labels', map('ru', named_struct('value', 'Заказ ' || o_orderkey)), 'descriptions', map('ru', named_struct('value', o_orderpriority)),
 'claims', map('P31', array({_claim("P31", "wikibase-entityid", "'KX'")}, {_claim("P31", "wikibase-entityid", "if(o_orderkey % 2 = 0, 'KA', 'KB')")}, {_claim("P31", "wikibase-entityid", "'KB'")}),
  'P571', array({_claim("P571", "time", "date_format(o_orderdate, '+yyyy-MM-dd') || 'T00:00:00Z'")}, {_claim("P571", "time", "'-0' || (100 + o_orderkey % 400) || '-00-00T00:00:00Z'")}, {_claim("P571", "time", "date_format(o_orderdate, '+yyyy-MM-dd') || 'T00:00:00Z'", _QUAL, "array('P1', 'P805')")})),
 'sitelinks', map('ruwiki', named_struct('title', 'Заказ'), 'x', named_struct('title', cast(null as string))))) AS value
FROM {{orders}}"""


def _rich(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return dump.extract(dump.parse_entities(_lines(spark, sf_dir, RICH_LINES))[0], classes=["KA", "KB"])


def rich_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rich(spark, sf_dir)["events"].select("qid", "class", "time_raw", "year", "bc", "timezone", "qual_property", "qual_value")


def rich_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rich(spark, sf_dir)["item_classes"]


def rich_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _rich(spark, sf_dir)
    return out["items"].join(out["sites"], "qid").select("qid", F.nullif("label", F.lit("")).alias("label"), "label_ru", "description_ru", "sitelinks", "ruwiki")


def vocabulary(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Class vocabularies over regions, nations and customers: two subclass seeds, one with instances, one excluded subtree."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region", "customer")}
    instances = spark.sql("SELECT 'C' || c_custkey AS item, 'M' || c_mktsegment AS class FROM {customer}", customer=tables["customer"])
    labels = spark.sql("SELECT 'N' || n_nationkey AS qid, n_name AS label, 'nation' AS description FROM {nation}", nation=tables["nation"])
    seeds = [("R1", "place", graph.SUBCLASS), ("R2", "event", graph.SUBCLASS), ("N8", "event", graph.SUBCLASS), ("MBUILDING", "art", graph.OCCUPATION)]
    out = graph.class_vocabulary(spark.sql(EDGES, **tables), instances, labels, seeds, [("N1", "one"), ("N2", "two")], only_in=None)
    return out[which]


def areas_of_occupations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupations in use by area: the segments as occupations under areas, one pruned, one without an area."""
    m = derived_model(spark, sf_dir)
    edges = spark.createDataFrame([("QM_BUILDING", "A1"), ("QM_FURNITURE", "A1"), ("QM_FURNITURE", "A2"), ("QM_MACHINERY", "A3"), ("A3", "A2")], "child string, parent string")
    used = graph.used_occupations(m.attributes, m.value_items)
    none = spark.createDataFrame([], "item string, class string")
    return graph.occupation_areas(edges, none, used, [("art", "A1"), ("music", "A2")], [("A3", "pruned")])


def resolved_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    lines = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("N"), (F.col("c_nationkey") + F.col("c_custkey") % 3 * 10).cast("string")).alias("line"))
    return resolve_lines(lines, nation.select(F.concat(F.lit("N"), "n_nationkey").alias("qid"), F.concat(F.lit(";"), "n_name").alias("rest")))


EDGES = "SELECT 'N' || n_nationkey AS child, 'R' || n_regionkey AS parent FROM {nation} UNION ALL SELECT 'R' || r_regionkey, 'W' FROM {region} UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM {customer} UNION ALL SELECT 'W', 'R0'"


def class_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region", "customer")}
    seeds = spark.createDataFrame([("R1", "R1"), ("R0", "R0"), ("N3", "N3")], "qid string, root string")
    return graph.closure(spark.sql(EDGES, **tables), seeds)


def occupations_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = derived_model(spark, sf_dir)
    return graph.used_occupations(m.attributes, m.value_items)


def resolved_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = derived_model(spark, sf_dir)
    return resolve_values(m.items, wanted_ids(m.attributes))


def fuzzy_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    scored = names.select("word", jaro_winkler_udf(F.lit("smoll"), "word").alias("s"))
    return scored.select("word", F.round("s", 6).alias("similarity"), (F.col("s") >= 0.9).alias("near"))


def centuries(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") % 4000 - 2000).alias("year")).distinct()
    return years.select("year", century_bucket(F.col("year")).alias("bucket"), century_floor(F.col("year")).alias("hundred"))


VOCABULARY = "WITH RECURSIVE e AS (" + EDGES.replace("{", "").replace("}", "") + """), s(root, domain, mode) AS (VALUES ('R1', 'place', 'subclass'), ('R2', 'event', 'subclass'), ('N8', 'event', 'subclass'), ('MBUILDING', 'art', 'occupation')),
b AS (SELECT root AS qid, domain, mode FROM s UNION SELECT 'C' || c_custkey, domain, mode FROM customer JOIN s ON root = 'M' || c_mktsegment AND mode <> 'subclass'),
c(qid, domain, mode) AS (SELECT qid, domain, mode FROM b UNION SELECT e.child, c.domain, c.mode FROM c JOIN e ON e.parent = c.qid),
p(qid, reason) AS (SELECT * FROM (VALUES ('N1', 'one'), ('N2', 'two')) UNION SELECT e.child, p.reason FROM p JOIN e ON e.parent = p.qid)"""

OTHERS: dict[str, tuple[Query, str]] = {
    "dump_events": (dump_events, "SELECT 'Q' || o_orderkey AS qid, 'P571' AS property, 'KU' AS class, strftime(o_orderdate, '+%Y-%m-%dT00:00:00Z') AS time_raw, year(o_orderdate) AS year, month(o_orderdate)::INT AS month, day(o_orderdate)::INT AS day, false AS bc, 0 AS timezone FROM orders WHERE o_orderpriority LIKE '1%'"),
    "dump_attributes": (dump_attributes, "SELECT 'Q' || o_orderkey AS qid, 'P170' AS property, 'QC' || o_custkey AS value FROM orders WHERE o_orderpriority LIKE '1%'"),
    "dump_rejects": (dump_rejects, "SELECT 'Q' || o_orderkey AS qid, 'Order No. ' || o_orderkey AS label, o_orderpriority AS description FROM orders WHERE o_orderpriority NOT LIKE '1%'"),
    "class_closure": (class_closure, "WITH RECURSIVE e AS (" + EDGES.replace("{", "").replace("}", "") + "), c(qid, root) AS (SELECT * FROM (VALUES ('R1', 'R1'), ('R0', 'R0'), ('N3', 'N3')) UNION SELECT e.child, c.root FROM c JOIN e ON e.parent = c.qid) SELECT qid, root FROM c"),
    "rich_events": (rich_events, """WITH o AS (SELECT 'Q' || o_orderkey AS qid, CASE WHEN o_orderkey % 2 = 0 THEN 'KA' ELSE 'KB' END AS class, * FROM orders)
SELECT qid, class, strftime(o_orderdate, '+%Y-%m-%dT00:00:00Z') AS time_raw, year(o_orderdate) AS year, false AS bc, 60 AS timezone, 'P805' AS qual_property, 'QC' || o_custkey AS qual_value FROM o
UNION ALL SELECT qid, class, '-0' || (100 + o_orderkey % 400) || '-00-00T00:00:00Z', -(100 + o_orderkey % 400), true, 60, NULL, NULL FROM o"""),
    "rich_classes": (rich_classes, "SELECT 'Q' || o_orderkey AS qid, 'KB' AS class FROM orders UNION SELECT 'Q' || o_orderkey, 'KA' FROM orders WHERE o_orderkey % 2 = 0"),
    "rich_heads": (rich_heads, "SELECT 'Q' || o_orderkey AS qid, NULL::VARCHAR AS label, 'Заказ ' || o_orderkey AS label_ru, o_orderpriority AS description_ru, 2 AS sitelinks, 'Заказ' AS ruwiki FROM orders"),
    "vocabulary_classes": (lambda s, d: vocabulary(s, d, "classes"), VOCABULARY + " SELECT qid, n_name AS label, CASE WHEN n_name IS NOT NULL THEN 'nation' END AS description, domains FROM (SELECT qid, array_to_string(list_sort(list_distinct(list(domain))), '|') AS domains FROM c WHERE mode <> 'occupation' GROUP BY qid) x LEFT JOIN nation ON 'N' || n_nationkey = qid WHERE qid NOT IN (SELECT qid FROM p)"),
    "vocabulary_occupations": (lambda s, d: vocabulary(s, d, "occupations"), VOCABULARY + " SELECT qid, n_name AS label, CASE WHEN n_name IS NOT NULL THEN 'nation' END AS description, domains FROM (SELECT qid, array_to_string(list_sort(list_distinct(list(domain))), '|') AS domains FROM c WHERE mode = 'occupation' GROUP BY qid) x LEFT JOIN nation ON 'N' || n_nationkey = qid WHERE qid NOT IN (SELECT qid FROM p)"),
    "vocabulary_excluded": (lambda s, d: vocabulary(s, d, "excluded_classes"), VOCABULARY + " SELECT x.qid, n_name AS label, CASE WHEN n_name IS NOT NULL THEN 'nation' END AS description, domains, reasons FROM (SELECT qid, array_to_string(list_sort(list_distinct(list(domain))), '|') AS domains FROM c WHERE mode <> 'occupation' GROUP BY qid) x JOIN (SELECT qid, array_to_string(list_sort(list_distinct(list(reason))), '|') AS reasons FROM p GROUP BY qid) y ON y.qid = x.qid LEFT JOIN nation ON 'N' || n_nationkey = x.qid"),
    "areas_of_occupations": (areas_of_occupations, with_views(" SELECT u.qid, u.label, t.areas, u.people FROM (SELECT a.value AS qid, max(v.label) AS label, count(DISTINCT a.qid) AS people FROM kg_attributes a LEFT JOIN kg_value_items v ON v.qid = a.value WHERE a.property = 'P106' GROUP BY a.value) u JOIN (VALUES ('QM_BUILDING', 'art'), ('QM_FURNITURE', 'art|music')) t(qid, areas) ON t.qid = u.qid")),
    "resolved_lines": (resolved_lines, "SELECT line || coalesce(';' || n_name, '') AS line FROM (SELECT 'N' || (c_nationkey + c_custkey % 3 * 10) AS line FROM customer) x LEFT JOIN nation ON line = 'N' || n_nationkey"),
    "occupations_in_use": (occupations_in_use, with_views(" SELECT a.value AS qid, max(v.label) AS label, count(DISTINCT a.qid) AS people FROM kg_attributes a LEFT JOIN kg_value_items v ON v.qid = a.value WHERE a.property = 'P106' GROUP BY a.value")),
    "resolved_values": (resolved_values, with_views(" SELECT DISTINCT qid, label, description FROM kg_items WHERE qid IN (SELECT value FROM kg_attributes)")),
    "fuzzy_parts": (fuzzy_parts, "WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part) SELECT word, round(jaro_winkler_similarity('smoll', word), 6) AS similarity, jaro_winkler_similarity('smoll', word) >= 0.9 AS near FROM w"),
    "centuries": (centuries, "SELECT year, CAST(round_even(year / 100, 0) AS BIGINT) * 100 AS bucket, CAST(floor(year / 100) AS BIGINT) * 100 AS hundred FROM (SELECT DISTINCT o_orderkey % 4000 - 2000 AS year FROM orders)"),
}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: (lambda s, d, f=f: f(derived_model(s, d))) for name, f in LIBRARY.items()}
    out |= {name: (lambda s, d, i=i: answer(derived_model(s, d), i, ALL).rows) for name, i in INTENTS.items()}
    out |= {name: (lambda s, d, c=c: answer(derived_model(s, d), _intent("person", compare_entities=c)).rows) for name, c in COMPARES.items()}
    return out | {name: query for name, (query, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in (LIBRARY_SQL | INTENT_SQL | COMPARE_SQL).items()} | {name: sql for name, (_, sql) in OTHERS.items()}
