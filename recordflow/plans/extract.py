"""Values of filled forms with their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from recordflow.functions.scalars import field_kind, leaf_name
from recordflow.operators.layout import field_labels
from recordflow.operators.ordered import last_wins


def resolve_leaf(inspected: DataFrame, values: DataFrame) -> DataFrame:
    """Full dotted names for inspected leaf names; the last full name of a leaf counts,
    unmatched ones stay as they are. ``values``: doc_id, pos, full_name."""
    leaves = last_wins(values.select("doc_id", leaf_name("full_name").alias("name"), "pos", "full_name"), ["doc_id", "name"], "pos")
    return inspected.join(leaves.select("doc_id", "name", "full_name"), ["doc_id", "name"], "left").withColumn(
        "full_name", F.coalesce("full_name", "name"))


def extract(values: DataFrame, fields: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """Rows doc_id, name, label, value, page, field_type, source, position.

    ``values``: doc_id, pos, full_name, value. With ``fields`` and ``words`` names
    are labelled, and detected ones come first. Sort by source, position, name;
    ``position`` is (page, y, x), null for names that were not detected.

    A full name and the leaf it may stand for share their last part, so labelled fields and
    values meet by document and last part, and all that follows stays there; where both come partitioned by document, nothing moves.
    """
    place = "struct<page:int,y:int,x:int>"
    read = values.select("doc_id", F.col("full_name").alias("name"), F.coalesce("value", F.lit("")).alias("value"), "pos")
    if fields is None or words is None:
        empty = [F.lit(None).cast(t).alias(n) for n, t in (("label", "string"), ("page", "int"), ("field_type", "string"))]
        return read.select("doc_id", "name", empty[0], "value", *empty[1:], F.lit(1).alias("source"), F.lit(None).cast(place).alias("position"))
    seen = field_labels(fields, words).select(
        "doc_id", "name", F.struct("page", "y", "x").cast(place).alias("at"), "label", (F.col("page") + 1).cast("int").alias("page"), field_kind("type").alias("field_type"))
    # Both sides alias the document alike, so that Spark sees that their union is partitioned as they are.
    doc = F.col("doc_id").alias("_doc")
    sides = [d.select(doc, *[c for c in d.columns if c != "doc_id"]) for d in (seen, read)]
    both = sides[0].unionByName(sides[1], allowMissingColumns=True).withColumn("_leaf", leaf_name("name"))
    family, detected = Window.partitionBy("_doc", "_leaf"), F.col("at").isNotNull()
    # The last full name of a leaf is the field's name; names with dots stand for themselves.
    last = F.max_by(F.when(~detected, F.col("name")), F.when(~detected, F.col("pos"))).over(family)
    named = both.withColumn("name", F.when(detected & (F.col("name") == F.col("_leaf")), F.coalesce(last, F.col("name"))).otherwise(F.col("name")))
    same = Window.partitionBy("_doc", "_leaf", "name")
    known = named.select(
        "*", F.max_by(F.when(detected, F.struct("label", "page", "field_type")), "at").over(same).alias("_facts"), F.min("at").over(same).alias("position"),
        F.min(detected.cast("int")).over(same).alias("_unread"), F.row_number().over(same.orderBy(F.col("at"))).alias("_nth"))
    # Every value is a row; a field without a value is one.
    kept = known.where(~detected | ((F.col("_unread") == 1) & (F.col("_nth") == 1)))
    return kept.select(F.col("_doc").alias("doc_id"), "name", "_facts.label", F.coalesce("value", F.lit("")).alias("value"), "_facts.page", "_facts.field_type",
                       F.when(F.col("position").isNull(), 1).otherwise(0).alias("source"), "position")
