"""Records as ordered entries: overlay, merge, alias fan-out.

A record is ``entries ARRAY<STRUCT<key STRING, value VARIANT>>`` in input order.
``as_map`` gives the map a reader of the record sees: for a repeated key the
first position and the last value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordflow.functions import scalars as S

ENTRIES = "array<struct<key:string,value:variant>>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    A plain projection lets the optimizer push a later filter (also one it infers
    from an explode) below it by repeating its expressions at every mention.
    Where these are costly (a JSON parse, resolved entries, a key derivation) they pass
    through a one-row generator, which filters are not pushed below.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.explode(F.array(row)).alias("_stage")).select("*", "_stage.*").drop("_stage")


def entries_of_json(text) -> Column:
    """Entries of a JSON object text."""
    return F.map_entries(F.from_json(_col(text), "map<string,variant>"))


def entries_of_map(data) -> Column:
    """Entries of a MAP<STRING,STRING>."""
    return F.transform(F.map_entries(_col(data)), lambda e: F.struct(e["key"].alias("key"), e["value"].cast("variant").alias("value")))


def entries_of(columns: dict[str, Column]) -> Column:
    """Entries of named text columns, in the order given."""
    return F.array(*[F.struct(F.lit(k).alias("key"), c.cast("string").cast("variant").alias("value"))
                     for k, c in columns.items()])


def as_map(entries) -> Column:
    """MAP<STRING,VARIANT>; needs LAST_WIN map building, see ``session``."""
    return F.map_from_entries(_col(entries))


def dedupe(entries) -> Column:
    return F.map_entries(as_map(entries))


def rekey(entries, fn) -> Column:
    return F.transform(_col(entries), lambda e: F.struct(fn(e["key"]).alias("key"), e["value"].alias("value")))


def resolve_keys(entries) -> Column:
    """Snake-cased, synonym-resolved entries without repeats."""
    snake = dedupe(rekey(entries, S.to_snake))
    return dedupe(rekey(snake, S.canonical_key))


def overlay_entries(record, base) -> Column:
    """Base entries under record entries: the record wins per raw key and an
    overridden key stays where the base had it."""
    empty = F.array().cast(ENTRIES)
    return dedupe(F.concat(F.coalesce(_col(base), empty), F.coalesce(_col(record), empty)))


def overlay(records: DataFrame, profiles: DataFrame, on: str = "profile_id") -> DataFrame:
    """Put each record's profile under it; an unknown profile changes nothing.

    ``profiles`` has ``on`` and ``data MAP<STRING,STRING>``. No broadcast is
    forced: Spark compares the side with its threshold, and AQE splits a profile
    that many records share.
    """
    base = profiles.select(on, entries_of_map("data").alias("_base"))
    return (
        records.join(base, on, "left")
        .withColumn("entries", overlay_entries("entries", "_base"))
        .drop("_base")
    )


def merge_profiles(links: DataFrame, profiles: DataFrame, record: str = "record_id") -> DataFrame:
    """Merge several profiles per record, later ids over earlier ones.

    ``links``: ``record``, ``profile_ids ARRAY``. ``profiles``: ``profile_id,
    profile_type, data MAP``. With more than one id each key is also emitted as
    ``{profile_type}_{key}``. Returns one row per (record, key).
    """
    ids = links.select(record, (F.size("profile_ids") > 1).alias("_many"), F.posexplode("profile_ids").alias("_pos", "profile_id"))
    pairs = ids.join(profiles, "profile_id").select(
        record, "_many", "_pos", "profile_type", F.explode(F.map_entries("data")).alias("e"))
    names = F.when(
        F.col("_many") & (F.coalesce(F.col("profile_type"), F.lit("")) != ""),
        F.array(F.struct(F.lit(0).alias("own"), F.col("e.key").alias("key")),
                F.struct(F.lit(1).alias("own"), F.concat("profile_type", F.lit("_"), "e.key").alias("key"))),
    ).otherwise(F.array(F.struct(F.lit(0).alias("own"), F.col("e.key").alias("key"))))
    named = pairs.select(record, "_pos", F.explode(names).alias("k"), F.col("e.value").alias("value"))
    return named.groupBy(record, F.col("k.key").alias("key")).agg(
        F.max_by("value", F.struct(F.col("_pos"), F.col("k.own"))).alias("value"))


def emit_aliases(entries) -> Column:
    """Each key with its synonyms, all with the same value."""
    return F.flatten(F.transform(_col(entries), lambda e: F.transform(
        S.alias_keys(e["key"]), lambda k: F.struct(k.alias("key"), e["value"].alias("value")))))


# Levels that one pass over the rows unpacks; rows still open after it go round once more.
LEVELS_A_PASS = 4


def _opened(value: str, in_list: str) -> str:
    """SQL: an object, or a list that is no item of a list, is unpacked."""
    kind = f"schema_of_variant({value})"
    return f"coalesce(startswith({kind}, 'OBJECT') OR (startswith({kind}, 'ARRAY') AND NOT {in_list}), false)"


def _unpacked(source: str, ids: str) -> str:
    """SQL: rows (ids, key, value, in_list, open) with the open ones replaced by their parts. Empty ones leave a null."""
    for _ in range(LEVELS_A_PASS):
        parts = f"""SELECT {ids}, CASE WHEN NOT w.open OR e.pos IS NULL THEN w.key WHEN e.key IS NULL THEN concat(w.key, '_', e.pos + 1)
            WHEN w.key = '' THEN e.key ELSE concat(w.key, '__', e.key) END AS key, CASE WHEN w.open THEN e.value ELSE w.value END AS value,
            CASE WHEN w.open THEN e.key IS NULL ELSE w.in_list END AS in_list, w.open AS was_open
            FROM {source} w, LATERAL variant_explode_outer(CASE WHEN w.open THEN w.value END) e"""
        source = f"(SELECT {ids}, key, value, in_list, was_open AND {_opened('value', 'in_list')} AS open FROM ({parts}))"
    return f"SELECT * FROM {source}"


def flatten_nested(raw: DataFrame, ids: list[str], value: str = "raw") -> DataFrame:
    """Leaves of a VARIANT as rows (ids, key, value), at any depth.

    Object keys are joined by ``__``, list items numbered ``_1``, ``_2`` …; nulls
    are dropped and a list inside a list is kept as its JSON text. Parts are unpacked level by level by lateral
    joins, some levels per pass, and a recursive query repeats the pass for what is still open.
    """
    names = {c: f"_id{i}" for i, c in enumerate(ids)}
    given = raw.select(*[F.col(c).alias(n) for c, n in names.items()], F.col(value).alias("value"))
    cols = ", ".join(names.values()) or "1 AS _none"
    rows = given.sparkSession.sql(f"""WITH RECURSIVE walk AS (
        {_unpacked(f"(SELECT {cols}, '' AS key, value, false AS in_list, {_opened('value', 'false')} AS open FROM {{given}})", cols.replace("1 AS ", ""))}
        UNION ALL
        {_unpacked("(SELECT * FROM walk WHERE open)", cols.replace("1 AS ", ""))})
        SELECT * FROM walk WHERE NOT open AND key <> '' AND value IS NOT NULL AND NOT is_variant_null(value)""", given=given)
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()], "key", S.variant_text("value").alias("value"))


def flatten_json(df: DataFrame, ids: list[str], text: str = "raw") -> DataFrame:
    """Leaves of JSON texts as rows (ids, key, value, error); a text that cannot be parsed gives one row with an error.

    A null text gives no row. The parser refuses more than 1000 levels, so deeper texts are errors.
    """
    parsed = df.select(*ids, F.col(text).isNotNull().alias("_given"), F.try_parse_json(text).alias("_raw"))
    good = flatten_nested(parsed, ids, "_raw").withColumn("error", F.lit(None).cast("string"))
    none = F.lit(None).cast("string")
    bad = parsed.where(F.col("_given") & F.col("_raw").isNull()).select(*ids, none.alias("key"), none.alias("value"), F.lit("Invalid JSON").alias("error"))
    return good.unionByName(bad)


def drop_blank_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with at least one value that is not blank."""
    return df.where(F.exists(F.array(*[F.col(c).cast("string") for c in columns]),
                             lambda v: F.coalesce(S.strip(v), F.lit("")) != ""))


def non_empty(data) -> Column:
    """Map entries whose key and value are not empty."""
    return F.map_filter(_col(data), lambda k, v: (k != "") & F.coalesce(v != "", F.lit(False)))


def apply_patch(state: DataFrame, patch: DataFrame, on: str) -> DataFrame:
    """Non-null patch fields replace those of the state; null means no change."""
    fields = [c for c in patch.columns if c != on]
    joined = state.alias("s").join(patch.alias("p"), on, "left")
    return joined.select(*[
        F.coalesce(F.col(f"p.{c}"), F.col(f"s.{c}")).alias(c) if c in fields else (F.col(on) if c == on else F.col(f"s.{c}"))
        for c in state.columns
    ])


def check_batch_size(df: DataFrame, by: str = "batch_id", max_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Split off the batches above ``max_rows``; returns (rows kept, rejected batches)."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"))
    over = counts.where(F.lit(False) if max_rows is None else F.col("rows") > max_rows)
    rejected = over.withColumn("error", F.lit(f"Maximum {max_rows} rows per batch"))
    return df.join(over.select(by), by, "left_anti"), rejected
