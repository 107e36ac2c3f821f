"""Resolve attribute values and classes to labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wanted_ids(attributes: DataFrame, item_classes: DataFrame | None = None) -> DataFrame:
    """(qid): distinct non-empty attribute values, and class ids if given."""
    ids = attributes.select(F.col("value").alias("qid"))
    if item_classes is not None:
        ids = ids.union(item_classes.select("class"))
    return ids.where("qid IS NOT NULL AND qid <> ''").distinct()


def resolve_values(dictionary: DataFrame, wanted: DataFrame) -> DataFrame:
    """(qid, label, description) of the wanted ids that the dictionary knows, the smallest row of repeated ids."""
    found = dictionary.select("qid", "label", "description").join(wanted, "qid", "left_semi")
    return found.groupBy("qid").agg(F.min(F.struct("label", "description")).alias("v")).select("qid", "v.*")


def resolve_lines(lines: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(line): each id line followed at once by its dictionary text; unresolved lines stay as they are.

    lines: (line) holding an id; dictionary: (qid, rest).
    """
    known = dictionary.groupBy("qid").agg(F.min("rest").alias("rest"))
    return lines.join(known, F.trim("line") == F.col("qid"), "left").select(F.concat("line", F.coalesce("rest", F.lit(""))).alias("line"))
