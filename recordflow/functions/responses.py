"""Parsing of model answers held in a text column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from recordflow.functions.scalars import _col, slug, strip, variant_text
from recordflow.functions.geometry import top_to_bottom_origin

FENCE = "```"


def strip_fence(text) -> Column:
    """Trimmed text without a surrounding code fence and its json tag."""
    text = strip(text)
    inner = F.get(F.split(text, FENCE), F.lit(1))
    inner = F.regexp_replace(inner, r"^json", "")
    return F.when(text.startswith(FENCE), strip(inner)).otherwise(text)


def parse_mapping_response(text) -> Column:
    """Answer text to an array of (field_name, value, confidence).

    Values may be scalars (confidence 1) or objects with value and confidence.
    Anything that is not a JSON object gives an empty array.
    """
    doc = F.try_parse_json(strip_fence(text))
    body = F.when(F.schema_of_variant(doc).startswith("OBJECT"), F.try_variant_get(doc, "$", "map<string,variant>"))

    def entry(e: Column) -> Column:
        v = e["value"]
        nested = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
        inner = F.try_variant_get(v, "$.value", "variant")
        none = F.when(F.schema_of_variant(inner) == "VOID", "None").otherwise(F.coalesce(variant_text(inner), F.lit("")))
        flat = F.when(F.schema_of_variant(v) == "VOID", "None").otherwise(variant_text(v))
        return F.struct(
            e["key"].alias("field_name"),
            F.when(nested, none).otherwise(flat).alias("value"),
            F.when(nested, F.coalesce(F.try_variant_get(v, "$.confidence", "double"), F.lit(1.0)))
            .otherwise(F.lit(1.0)).alias("confidence"),
        )

    entries = F.transform(F.map_entries(body), entry)
    kept = F.filter(entries, lambda e: e["value"] != "")
    return F.coalesce(kept, F.array().cast("array<struct<field_name:string,value:string,confidence:double>>"))


ZONE = "struct<key:string,label:string,page_index:int,x_pct:double,y_pct:double,width_pct:double,height_pct:double,source:string,confidence:double>"


def parse_zone_response(text, page) -> Column:
    """Answer text to an array of signature zones; bad items are skipped."""
    page = _col(page)
    doc = F.try_parse_json(strip_fence(text))
    items = F.when(F.schema_of_variant(doc).startswith("ARRAY"), F.try_variant_get(doc, "$", "array<variant>"))

    def number(item: Column, name: str, default: float) -> Column:
        v = F.try_variant_get(item, f"$.{name}", "variant")
        return F.when(v.isNull(), F.lit(default)).otherwise(F.try_variant_get(item, f"$.{name}", "double"))

    def word(item: Column, name: str, default: str) -> Column:
        v = F.try_variant_get(item, f"$.{name}", "variant")
        return F.when(v.isNull(), F.lit(default)).otherwise(F.coalesce(variant_text(v), F.lit("None")))

    def zone(item: Column, i: Column) -> Column:
        label = word(item, "label", "Signature")
        box = top_to_bottom_origin(number(item, "x_pct", 50.0), number(item, "y_pct", 80.0),
                                   number(item, "width_pct", 30.0), number(item, "height_pct", 8.0))
        auto = F.concat_ws("_", word(item, "kind", "signature"), page.cast("string"), i.cast("string"))
        valid = (F.schema_of_variant(item).startswith("OBJECT")
                 & box["x_pct"].isNotNull() & number(item, "y_pct", 80.0).isNotNull()
                 & number(item, "width_pct", 30.0).isNotNull() & number(item, "height_pct", 8.0).isNotNull())
        return F.when(F.coalesce(valid, F.lit(False)), F.struct(
            F.coalesce(F.nullif(slug(label, ""), F.lit("")), auto).alias("key"), label.alias("label"),
            page.cast("int").alias("page_index"),
            box["x_pct"].alias("x_pct"), box["y_pct"].alias("y_pct"),
            box["width_pct"].alias("width_pct"), box["height_pct"].alias("height_pct"),
            F.lit("ai").alias("source"), F.lit(0.80).alias("confidence")))

    zones = F.filter(F.transform(items, zone), lambda z: z.isNotNull())
    return F.coalesce(zones.cast(f"array<{ZONE}>"), F.array().cast(f"array<{ZONE}>"))
