"""Geometry of forms: label inference, bands, signature zones.

``fields``: doc_id, name, type, page, x0, x1, x, y. ``words``: doc_id, page,
word_no, text, x0, x1, top.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from recordflow.functions import fixed
from recordflow.functions.geometry import band, box_to_pct
from recordflow.functions.responses import parse_zone_response
from recordflow.functions.scalars import field_kind, slug, strip
from recordflow.operators.ordered import last_wins, running
from recordflow.operators.records import stage

CELL_X = 220


def fields_from_annotations(annots: DataFrame) -> DataFrame:
    """Form fields of annotation rows (doc_id, name, ft, page, page_height, rect ARRAY<DOUBLE>)."""
    rect = F.col("rect")

    def at(i: int) -> Column:
        return F.coalesce(F.get(rect, F.lit(i)), F.lit(0.0))

    top = F.when(rect.isNull(), F.lit(0.0)).otherwise(F.col("page_height") - F.greatest(at(1), at(3)))
    return annots.where(F.col("name").isNotNull()).select(
        "doc_id", "name", F.coalesce("ft", F.lit("/Tx")).alias("type"), "page",
        F.round(at(0)).cast("int").alias("x0"), F.round(at(2)).cast("int").alias("x1"),
        F.round((at(0) + at(2)) / 2).cast("int").alias("x"), F.round(top).cast("int").alias("y"))


def _cell(c: Column, width: int) -> Column:
    return F.floor(c / F.lit(width)).cast("long")


def label_probes(fields: DataFrame) -> DataFrame:
    """Distinct places to look from: fields at the same place share one label.

    A text field looks left of x0, a field at the left edge looks right of x1.
    """
    is_box = F.col("x0") < fixed.CHECKBOX_X
    return fields.select("doc_id", "page", "y", is_box.alias("is_box"),
                         F.when(is_box, F.col("x1")).otherwise(F.col("x0")).alias("edge")).distinct()


def proximity(probes: DataFrame, words: DataFrame) -> DataFrame:
    """Words within reach of each probe: a range join on a grid.

    Each probe is put into every grid cell it can reach (3 bands of 12 points by
    at most 4 columns), each word lies in one cell, so the join is an equi-join on
    (doc, page, cell) and no pair comes twice.
    """
    edge, y = F.col("edge"), F.col("y")
    lo = F.when(F.col("is_box"), edge - fixed.LABEL_SLACK).otherwise(edge - fixed.LABEL_LEFT)
    hi = F.when(F.col("is_box"), edge + fixed.LABEL_RIGHT).otherwise(edge + fixed.LABEL_SLACK)
    cells = (
        probes
        .withColumn("cx", F.explode(F.sequence(_cell(lo, CELL_X), _cell(hi, CELL_X))))
        .withColumn("cy", F.explode(F.sequence(_cell(y - fixed.LABEL_DY, fixed.LABEL_DY), _cell(y + fixed.LABEL_DY, fixed.LABEL_DY))))
    )
    placed = words.select("doc_id", "page", "word_no", "text", F.col("x0").alias("wx0"), F.col("x1").alias("wx1"), "top",
                          _cell(F.col("x0"), CELL_X).alias("cx"), _cell(F.col("top"), fixed.LABEL_DY).alias("cy"))
    near = cells.join(placed, ["doc_id", "page", "cx", "cy"])
    right = (F.col("wx0") >= edge - fixed.LABEL_SLACK) & (F.col("wx0") - edge <= fixed.LABEL_RIGHT)
    left = (F.col("wx1") <= edge + fixed.LABEL_SLACK) & (edge - F.col("wx0") <= fixed.LABEL_LEFT)
    return near.where((F.abs(F.col("top") - y) <= fixed.LABEL_DY)
                      & F.when(F.col("is_box"), right).otherwise(left)).drop("cx", "cy")


def nearest_label(candidates: DataFrame) -> DataFrame:
    """Label per probe: its first 6 words to the right or last 4 to the left.

    The limit on row_number runs before the shuffle too, so a crowded probe
    moves few rows, and at most 6 words are gathered per probe.
    """
    probe = ["doc_id", "page", "y", "is_box", "edge"]
    sign = F.when(F.col("is_box"), F.lit(1)).otherwise(F.lit(-1))
    w = Window.partitionBy(*probe).orderBy(F.col("wx0") * sign, F.col("word_no") * sign)
    keep = F.when(F.col("is_box"), fixed.CHECKBOX_WORDS).otherwise(fixed.TEXT_WORDS)
    top = (
        candidates.withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= max(fixed.CHECKBOX_WORDS, fixed.TEXT_WORDS)).where(F.col("_rn") <= keep)
    )
    words = F.array_sort(F.collect_list(F.struct("wx0", "word_no", "text")))
    return top.groupBy(*probe).agg(
        strip(F.array_join(F.transform(words, lambda x: x["text"]), " ")).alias("label"))


def field_labels(fields: DataFrame, words: DataFrame) -> DataFrame:
    """Every field with its inferred label, its own name where no word is near."""
    labels = nearest_label(proximity(label_probes(fields), words))
    is_box = F.col("x0") < fixed.CHECKBOX_X
    placed = fields.withColumn("is_box", is_box).withColumn("edge", F.when(is_box, F.col("x1")).otherwise(F.col("x0")))
    return placed.join(labels, ["doc_id", "page", "y", "is_box", "edge"], "left").withColumn(
        "label", F.coalesce("label", "name")).select(*fields.columns, "label")


def infer_labels(fields: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, name, label; of fields with the same name the last in reading order counts."""
    return last_wins(field_labels(fields, words).select("doc_id", "name", "page", "y", "x", "label"),
                     ["doc_id", "name"], ["page", "y", "x"]).select("doc_id", "name", "label")


def page_extents(fields: DataFrame) -> DataFrame:
    """Smallest and largest x0 and y per page; a largest of 0 counts as 1."""
    def top(c: str) -> Column:
        return F.when(F.max(c) == 0, 1).otherwise(F.max(c))
    return fields.groupBy("doc_id", "page").agg(
        F.min("x0").alias("x_min"), top("x0").alias("x_max"), F.min("y").alias("y_min"), top("y").alias("y_max"))


def labeled_fields(fields: DataFrame, labels: DataFrame, coords: bool = False) -> DataFrame:
    """Field descriptors for a mapper: name, type, label and, with ``coords``, page and bands."""
    named = fields.join(labels.select("doc_id", "name", "label"), ["doc_id", "name"], "left")
    base = [F.col("doc_id"), F.col("name").alias("field_name"), field_kind("type", prompt=True).alias("type"),
            F.coalesce("label", "name").alias("label")]
    if not coords:
        return named.select(*base)
    placed = named.join(page_extents(fields), ["doc_id", "page"])
    position = F.concat(F.lit("x:"), band("x0", "x_min", "x_max"), F.lit(" y:"), band("y", "y_min", "y_max"))
    return placed.select(*base, "page", position.alias("position"))


def inspect_form(fields: DataFrame, words: DataFrame) -> DataFrame:
    """All fields with kind, label and geometry."""
    labels = infer_labels(fields, words)
    return fields.join(labels, ["doc_id", "name"], "left").select(
        "doc_id", "name", field_kind("type").alias("field_type"), "page",
        F.coalesce("label", "name").alias("label"), "x0", "x1", "y")


def detect_signature_fields(fields: DataFrame) -> DataFrame:
    """Widgets that are, or read like, signature or date fields: adds kind and label."""
    def says(pattern: str) -> Column:
        return F.coalesce(F.col("name").rlike(f"(?i){pattern}"), F.lit(False)) | F.coalesce(F.col("tooltip").rlike(f"(?i){pattern}"), F.lit(False))
    is_sig = F.coalesce(F.col("type") == "/Sig", F.lit(False))
    signs, dates = says(fixed.SIGN_WORDS), says(fixed.DATE_WORDS)
    kind = F.when(dates & ~is_sig & ~signs, "date").otherwise("signature")
    label = F.coalesce(F.nullif(strip("tooltip"), F.lit("")), F.nullif(strip("name"), F.lit("")), F.initcap("kind"))
    return fields.where(is_sig | signs | dates).withColumn("kind", kind).withColumn("label", label)


def dedupe_keys(df: DataFrame, by: str, key: str, order: list[str], out: str = "unique_key") -> DataFrame:
    """Make keys unique per group: the first keeps its base, later ones take the
    lowest free ``_1``, ``_2`` …

    Repeats of a base are numbered by ``running``. Names can collide only where a base
    repeats and another looks like it with a suffix (``sign`` twice and ``sign_1``); the rows of such
    a family are streamed in order through one task, which keeps the names alone.
    Families without a repeat (``field_1``, ``field_2`` …) keep their names.
    """
    columns = [*df.columns, out]
    marked = running(df, [by, key], order, index="_n").withColumn("_root", F.regexp_replace(key, r"(_[0-9]+)+$", ""))
    mixed = marked.groupBy(by, "_root").agg(((F.min(key) != F.max(key)) & (F.max("_n") > 1)).alias("_mixed")).where("_mixed").select(by, "_root")
    plain = marked.join(mixed, [by, "_root"], "left_anti").withColumn(
        out, F.when(F.col("_n") == 1, F.col(key)).otherwise(F.concat(key, F.lit("_"), (F.col("_n") - 1).cast("string"))))

    def take_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        family, taken, following = None, set(), {}
        for pdf in batches:
            names = []
            for group, root, base in zip(pdf[by], pdf["_root"], pdf[key]):
                if (group, root) != family:
                    family, taken, following = (group, root), set(), {}
                name, n = base, following.get(base, 1)
                while name in taken:
                    name = f"{base}_{n}"
                    n += 1
                following[base] = n
                taken.add(name)
                names.append(name)
            yield pdf.assign(**{out: names})[columns]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.select(*columns).schema.fields)
    clashing = (
        marked.join(mixed, [by, "_root"], "left_semi").repartition(by, "_root")
        .sortWithinPartitions(by, "_root", *order).mapInPandas(take_names, schema))
    return plain.select(*columns).unionByName(clashing)


def detect_zones(fields: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Signature zones per document.

    ``fields``: doc_id, seq, name, tooltip, type, page, rx0, ry0, rx1, ry1, page_w,
    page_h. ``fallback``: doc_id, page, response, the model answers used only for
    documents without a detected field.
    """
    found = detect_signature_fields(fields).withColumn(
        "_box", box_to_pct("rx0", "ry0", "rx1", "ry1", "page_w", "page_h")).where(F.col("_box").isNotNull())
    based = found.withColumn("base_key", slug("name", F.col("kind")))
    unique = dedupe_keys(based.select("doc_id", "page", "seq", "label", "base_key", "_box.*"), "doc_id", "base_key", ["page", "seq"], "key")
    zones = unique.select("doc_id", "key", "label", F.col("page").cast("int").alias("page_index"), "x_pct", "y_pct", "width_pct", "height_pct",
                          F.lit("acroform").alias("source"), F.lit(1.0).alias("confidence"))
    if fallback is None:
        return zones
    # Documents with a zone, before keys are made unique: a cheaper side for the anti join.
    other = fallback.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(
        "doc_id", "page", "response")
    other = stage(other, _zones=parse_zone_response("response", "page")).select("doc_id", F.explode("_zones").alias("z")).select("doc_id", "z.*")
    return zones.unionByName(other.select(*zones.columns))
