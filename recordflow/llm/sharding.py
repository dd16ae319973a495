"""Sharding by fixed virtual slots.

Records hash into ``SLOTS`` slots that never change. Bytes are added up per slot, and a
small table says which shard holds each slot. Shards are balanced by editing that table:
every edit is a new version of it, written to a folder, and moves as few slots as it can.
The table has one row per slot and version, so it may pass through the driver.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLOTS = 4096
SHARDS = 16
# Ids with more rows than this, and more than the share below, are spread over slots.
HOT_ROWS = 1000
# A hot id has over 1 / (HOT_SHARE * shards) of all rows or bytes.
HOT_SHARE = 32


def slot_of(id_col: str = "doc_id", slots: int = SLOTS) -> Column:
    """A record's slot: the leading bits of the MD5 of its id, null as the empty text."""
    return slot_of_text(F.coalesce(F.col(id_col).cast("string"), F.lit("")), slots)


def slot_of_text(text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def record_size(text_col: str = "text") -> Column:
    """UTF-8 bytes of the text and one more."""
    return (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")


def place(sizes: dict[int, int], shards: int) -> dict[int, int]:
    """First map: slots from the largest down, each to the shard with the fewest bytes, the first of equals."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def rebalance(current: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """The map after slots grew or shards were added: slots move from the fullest to the
    emptiest shard while that narrows the gap, the largest that does so first."""
    out = dict(current)
    load, held = {s: 0 for s in range(shards)}, {s: [] for s in range(shards)}
    for slot, shard in out.items():
        load[shard] += sizes.get(slot, 0)
        held[shard].append(slot)
    for _ in range(len(out)):
        low, high = min(load, key=lambda s: (load[s], s)), max(load, key=lambda s: (load[s], -s))
        gap = load[high] - load[low]
        fit = [s for s in held[high] if 0 < 2 * sizes.get(s, 0) <= gap]
        if not fit:
            break
        slot = max(fit, key=lambda s: (sizes[s], -s))
        held[high].remove(slot)
        held[low].append(slot)
        load[high] -= sizes[slot]
        load[low] += sizes[slot]
        out[slot] = low
    return out


def write_version(spark: SparkSession, slot_map: dict[int, int], version: int, folder: str) -> None:
    """One version of the map: (version, slot, shard)."""
    rows = [(version, slot, shard) for slot, shard in sorted(slot_map.items())]
    spark.createDataFrame(rows, "version int, slot int, shard int").coalesce(1).write.mode("append").parquet(folder)


def read_version(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """(slot, shard) of a version, the latest if none is named."""
    m = spark.read.schema("version int, slot int, shard int").parquet(folder)
    if version is None:
        version = m.agg(F.max("version")).first()[0]
    return m.where(F.col("version") == version).select("slot", "shard")


def slot_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot that has any (at most ``slots`` entries)."""
    s = docs.select(slot_of(id_col, slots).alias("slot"), record_size(text_col).alias("size"))
    return {r["slot"]: (r["bytes"], r["rows"]) for r in s.groupBy("slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}


def _latest(spark: SparkSession, folder: str) -> tuple[int, dict[int, int]]:
    """Number and content of the latest version of the map; 0 and an empty one if there is none yet."""
    try:
        m = spark.read.schema("version int, slot int, shard int").parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}
    version = m.agg(F.max("version")).first()[0]
    return (0, {}) if version is None else (version, {r["slot"]: r["shard"] for r in read_version(spark, folder, version).collect()})


def _figures(rows: DataFrame) -> dict[int, tuple[int, int]]:
    return {r["virtual_slot"]: (r["bytes"], r["rows"]) for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}


def _hot_ids(rows: DataFrame, figures: dict[int, tuple[int, int]], shards: int) -> DataFrame | None:
    """Ids (null among them) of several rows that hold too large a share; fewer than 2 * HOT_SHARE * shards."""
    size = sum(b for b, _ in figures.values()) / (HOT_SHARE * shards)
    count = max(HOT_ROWS, sum(n for _, n in figures.values()) / (HOT_SHARE * shards))
    heavy = [s for s, (b, n) in figures.items() if b > size or n > count]
    if not heavy:
        return None
    by = rows.where(F.col("virtual_slot").isin(heavy)).groupBy("id").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    ids = by.where((F.col("n") > 1) & ((F.col("b") > size) | (F.col("n") > count))).select("id").collect()
    return rows.sparkSession.createDataFrame([tuple(r) for r in ids], rows.select("id").schema) if ids else None


def _spread(rows: DataFrame, hot: DataFrame, slots: int) -> DataFrame:
    """Rows whose hot ids take slots by id, checksum and a number within equal rows."""
    same = F.col("r.id").eqNullSafe(F.col("h.id"))
    named = F.broadcast(hot.alias("h"))
    calm = rows.alias("r").join(named, same, "left_anti")
    # Equal rows are counted and dealt out again by number, so that none needs to be told from another.
    equal = rows.alias("r").join(named, same, "left_semi").groupBy("id", "size", "text_crc32").agg(F.count("*").alias("n"))
    part = equal.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(HOT_ROWS).cast("long")))).repartition("id", "text_crc32", "first")
    each = part.withColumn("number", F.explode(F.sequence("first", F.least(F.col("first") + HOT_ROWS, "n") - 1)))
    salt = F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("")), "text_crc32", "size", "number")
    return calm.unionByName(each.select("id", "size", "text_crc32", slot_of_text(salt, slots).alias("virtual_slot")))


def shard(docs: DataFrame, folder: str, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, virtual_slot, shard, place): place counts a shard's rows from 0.

    The latest version of the map in ``folder`` is balanced anew by the slots' bytes and written
    as the next one; the first places all slots. Records with equal or null ids share a slot, but
    for ids with so many rows or bytes that no map could balance them: their rows are spread. A
    null text counts as empty. A row's place is the start of its slot in the shard and its rank in the slot, by id
    and checksum; repeated rows take places next to each other. Empty tables give no rows; other columns are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), record_size(text_col).alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"), slot_of(id_col, slots).alias("virtual_slot"))
    figures = slot_figures(docs, id_col, text_col, slots)
    if (hot := _hot_ids(rows, figures, shards)) is not None:
        rows = _spread(rows, hot, slots)
        figures = _figures(rows)
    sizes = {s: b for s, (b, _) in figures.items()}
    version, current = _latest(spark, folder)
    slot_map = {s: s % shards for s in range(slots)} | (rebalance(current, sizes, shards) if current else place(sizes, shards))
    write_version(spark, slot_map, version + 1, folder)
    at, starts = [0] * shards, []
    for slot in sorted(figures):
        starts.append((slot, slot_map[slot], at[slot_map[slot]]))
        at[slot_map[slot]] += figures[slot][1]
    side = spark.createDataFrame(starts, "virtual_slot int, shard int, start long")
    # At most ``slots`` rows, so the side is small at every size of the input.
    ranked = rows.join(F.broadcast(side), "virtual_slot").selectExpr(
        "id", "size", "text_crc32", "virtual_slot", "shard", "start + row_number() OVER (PARTITION BY virtual_slot ORDER BY id, text_crc32, size) - 1 AS place")
    return ranked.select(F.col("id").alias(id_col), "size", "text_crc32", "virtual_slot", "shard", "place")
