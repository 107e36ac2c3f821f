"""A knowledge graph derived from the star-schema tables: the same SQL text builds it in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import SparkSession

from annalist.functions.time import parse_time
from annalist.model import Model

TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem")

VIEWS = {
    "kg_items": """
select 'QN'||cast(n_nationkey as string) qid, n_name label, 'nation' description, cast(null as string) label_ru, cast(null as string) description_ru from nation
union all select 'QC'||cast(c_custkey as string), c_name, c_mktsegment, null, null from customer
union all select 'QS'||cast(s_suppkey as string), s_name, 'supplier', null, null from supplier
union all select 'QP'||cast(p_partkey as string), case when p_partkey % 5 > 0 then p_name end, p_brand, case when p_partkey % 5 < 2 then p_name end, null from part
union all select 'QO'||cast(o_orderkey as string), 'Order No. '||cast(o_orderkey as string), o_orderpriority, null, null from orders
union all select distinct 'QM_'||c_mktsegment, lower(c_mktsegment), 'occupation', cast(null as string), cast(null as string) from customer
union all select distinct 'QT_'||p_type, lower(p_type), 'genre', cast(null as string), cast(null as string) from part""",
    "kg_dates": """
select 'QO'||cast(o_orderkey as string) qid, 'P571' property, 'KO' class, o_orderdate ts from orders
union all select 'QO'||cast(l_orderkey as string), 'P577', 'KO', max(l_shipdate) from lineitem group by l_orderkey
union all select 'QC'||cast(o_custkey as string), 'P569', 'KC', min(o_orderdate) from orders group by o_custkey
union all select 'QC'||cast(o_custkey as string), 'P570', 'KC', max(o_orderdate) from orders group by o_custkey""",
    "kg_events_raw": """
select qid, property, class, '+'||lpad(cast(year(ts) as string),4,'0')||'-'||lpad(cast(month(ts) as string),2,'0')||'-'||lpad(cast(day(ts) as string),2,'0')||'T00:00:00Z' time_raw from kg_dates""",
    "kg_attributes": """
select distinct qid, property, value from (
select 'QC'||cast(c_custkey as string) qid, 'P27' property, 'QN'||cast(c_nationkey as string) value from customer
union all select 'QS'||cast(s_suppkey as string), 'P27', 'QN'||cast(s_nationkey as string) from supplier
union all select 'QC'||cast(c_custkey as string), 'P106', 'QM_'||c_mktsegment from customer
union all select 'QP'||cast(p_partkey as string), 'P136', 'QT_'||p_type from part
union all select 'QO'||cast(o_orderkey as string), 'P170', 'QC'||cast(o_custkey as string) from orders
union all select 'QO'||cast(o_orderkey as string), 'P17', 'QN'||cast(c_nationkey as string) from orders join customer on c_custkey=o_custkey
union all select 'QO'||cast(l_orderkey as string), 'P710', 'QS'||cast(l_suppkey as string) from lineitem
union all select 'QO'||cast(l_orderkey as string), 'P921', 'QP'||cast(l_partkey as string) from lineitem) u""",
    "kg_item_classes": """
select 'QC'||cast(c_custkey as string) qid, 'KC' class from customer union all select 'QS'||cast(s_suppkey as string), 'KS' from supplier
union all select 'QO'||cast(o_orderkey as string), 'KO' from orders union all select 'QO'||cast(o_orderkey as string), 'KU' from orders where o_orderpriority like '1%'
union all select 'QP'||cast(p_partkey as string), 'KP' from part""",
    "kg_sites": """
select 'QC'||cast(o_custkey as string) qid, cast(count(*) as int) sitelinks, cast(null as string) enwiki, cast(null as string) ruwiki from orders group by o_custkey
union all select 'QO'||cast(l_orderkey as string), cast(count(*) as int), null, null from lineitem group by l_orderkey""",
    "kg_classes": """
select * from (values ('KC','customer','buyer','person'),('KS','supplier','seller','person'),('KO','order','purchase','event|literature'),('KU','urgent order','purchase','event'),('KP','part','product','art|music')) t(qid, label, description, domains)""",
    "kg_properties": """
select * from (values ('P569','date of birth','','date'),('P570','date of death','','date'),('P571','inception','','date'),('P577','publication date','','date'),('P27','country of citizenship','','attribute'),('P106','occupation','','attribute'),('P17','country','','attribute')) t(pid, label, description, kind)""",
    "kg_value_items": """
select qid, label, description from kg_items where qid not like 'QS%7'""",
    "kg_occupation_areas": """
select 'QM_'||c_mktsegment qid, lower(c_mktsegment) label, case when c_mktsegment in ('AUTOMOBILE','MACHINERY') then 'science' when c_mktsegment = 'FURNITURE' then 'art|music' when c_mktsegment = 'BUILDING' then 'art' else 'literature' end areas, count(*) people from customer group by c_mktsegment""",
    "kg_events": """
select qid, property, class, time_raw, cast(substr(time_raw,2,4) as bigint) as year, cast(substr(time_raw,7,2) as smallint) as month, cast(substr(time_raw,10,2) as smallint) as day, false as bc, 0 as timezone, cast(null as string) qual_property, cast(null as string) qual_value from kg_events_raw""",
}


def derived_model(spark: SparkSession, sf_dir: str) -> Model:
    known = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}
    for name, text in VIEWS.items():
        if name == "kg_events":
            raw = known["kg_events_raw"]
            time = parse_time(raw["time_raw"])
            known[name] = raw.selectExpr("*", "0 AS timezone", "cast(null as string) AS qual_property", "cast(null as string) AS qual_value").select("qid", "property", "class", "time_raw", *(v.alias(k) for k, v in time.items()), "timezone", "qual_property", "qual_value")
            continue
        for other in known:
            text = _named(text, other)
        known[name] = spark.sql(text, **{k: v for k, v in known.items() if "{" + k + "}" in text})
    return Model(**{name: known[f"kg_{name}"] for name in Model.__dataclass_fields__})


def _named(text: str, table: str) -> str:
    """The text with references to the table as parameters of spark.sql."""
    import re

    return re.sub(rf"(?<=from ){table}\b|(?<=join ){table}\b", "{" + table + "}", text)


def with_views(body: str) -> str:
    """SQL for DuckDB: all views of the graph, then the body (which may begin with further named queries and a comma)."""
    views = ", ".join(f"{name} AS ({text.replace(' string', ' VARCHAR')})" for name, text in VIEWS.items())
    return f"WITH {views}{body}"
