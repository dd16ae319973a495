"""Catalogue search by an index of three-letter parts.

Three tables lie beside the catalogue. ``facts`` has one narrow row per template with what is
compared as a whole. ``grams`` lists the parts of every distinct drug and payer name, sorted by
part, so that a search reads the row groups of its own parts only. ``texts`` holds the names and
``owners`` the templates of each name: names are few beside templates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recordflow.operators.matching import GRAM, grams

NAMES = {"drug": ("drug.name", "drug.generic_name"), "payer": ("payer.name",)}


def _texts(catalog: DataFrame) -> DataFrame:
    """(id, kind, text): the lower-cased names of each template."""
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lower(c).alias("text")) for kind, columns in NAMES.items() for c in columns])
    return catalog.select("id", F.explode(F.array_distinct(pairs)).alias("n")).select("id", "n.*").where("text IS NOT NULL")


def build_index(catalog: DataFrame, path: str) -> None:
    """Write the index of a catalogue with distinct ids; an earlier one is replaced."""
    spark = catalog.sparkSession
    facts = catalog.select(
        "id", F.lower("category").alias("category"), F.lower("specialty").alias("specialty"), F.transform("tags", F.lower).alias("tags"), "is_public",
        F.col("payer").isNotNull().alias("has_payer"), F.upper("payer.state").alias("state"))
    facts.write.mode("overwrite").parquet(f"{path}/facts")
    key = F.xxhash64("kind", "text")
    _texts(catalog).select(key.alias("text_id"), "id").repartitionByRange("text_id", "id").sortWithinPartitions("text_id").write.mode("overwrite").parquet(f"{path}/owners")
    _texts(catalog).select("kind", "text").distinct().withColumn("text_id", key).write.mode("overwrite").parquet(f"{path}/texts")
    parts = spark.read.parquet(f"{path}/texts").select("kind", F.explode(grams(F.col("text"), GRAM)).alias("gram"), "text_id")
    parts.repartitionByRange("kind", "gram", "text_id").sortWithinPartitions("kind", "gram").write.mode("overwrite").parquet(f"{path}/grams")


def names_with(spark: SparkSession, path: str, kind: str, term: str) -> DataFrame:
    """text_id of the names of a kind that hold a term. All parts of the term must be among
    those of a name; whether they stand together is then seen in the name. Terms shorter than a part look through the names."""
    term = term.lower()
    wanted = sorted({term[i:i + GRAM] for i in range(len(term) - GRAM + 1)})
    texts = spark.read.parquet(f"{path}/texts").where((F.col("kind") == kind) & F.contains("text", F.lit(term)))
    if not wanted:
        return texts.select("text_id")
    held = spark.read.parquet(f"{path}/grams").where((F.col("kind") == kind) & F.col("gram").isin(wanted))
    near = held.groupBy("text_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted))
    return texts.join(near, "text_id", "left_semi").select("text_id")


def search_ids(spark: SparkSession, path: str, category: str | None = None, drug: str | None = None, payer: str | None = None,
               state: str | None = None, specialty: str | None = None, tag: str | None = None, is_public: bool | None = None) -> DataFrame:
    """Ids of the templates that fit every given condition, from the index alone."""
    conditions: list[Column] = []
    if category:
        conditions.append(F.col("category") == category.lower())
    if specialty:
        conditions.append(F.col("specialty") == specialty.lower())
    if is_public is not None:
        conditions.append(F.col("is_public") == is_public)
    if tag:
        conditions.append(F.array_contains("tags", tag.lower()))
    if state:
        conditions.append(F.col("has_payer") & (F.col("state").isNull() | (F.col("state") == state.upper())))
    named = [(kind, term) for kind, term in (("drug", drug), ("payer", payer)) if term]
    found = None
    if conditions or not named:
        found = spark.read.parquet(f"{path}/facts")
        for c in conditions:
            found = found.where(c)
        found = found.select("id")
    for kind, term in named:
        ids = spark.read.parquet(f"{path}/owners").join(names_with(spark, path, kind, term), "text_id", "left_semi").select("id")
        found = ids.distinct() if found is None else found.join(ids, "id", "left_semi")
    return found


def search_indexed(catalog: DataFrame, path: str, **conditions) -> DataFrame:
    """Whole manifests of a search; only those found are read in full."""
    return catalog.join(search_ids(catalog.sparkSession, path, **conditions), "id", "left_semi")
