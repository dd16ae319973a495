"""Ordered work inside groups: numbering, running sums, top-n, segments.

A group may hold a large share of all rows, so nothing here sorts a whole group
in one task. Groups above ``HOT_ROWS`` are cut into chunks at quantiles of their own order
values; each chunk is numbered alone and shifted by the totals of the chunks
before it. Without such groups a plain window does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordflow.functions.scalars import strip
from recordflow.session import materialize

HOT_ROWS = 2_000_000
# Most chunks of one group.
QUANTILES = 1024
CHUNK = "_chunk"
WHOLE = ("tinyint", "smallint", "int", "bigint")


def _names(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _numbers(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """The order columns that can cut a group: the first, and the second if the
    first is whole numbers (its ties are then cut by the second)."""
    types = dict(df.dtypes)

    def number(c: str) -> Column | None:
        if types[c].startswith("timestamp"):
            return F.unix_micros(F.col(c).cast("timestamp")).cast("double")
        return F.col(c).cast("double") if types[c].split("(")[0] in (*WHOLE, "float", "double", "decimal") else None

    first = number(order[0])
    if first is None:
        raise TypeError(f"{order[0]} must be a number or timestamp")
    whole = types[order[0]] in WHOLE or types[order[0]].startswith("timestamp")
    second = number(order[1]) if whole and len(order) > 1 else None
    return [first] if second is None else [first, second]


def _same(by: Sequence[str], left: str, right: str) -> Column:
    condition = F.lit(True)
    for c in by:
        condition = condition & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return condition


def _place(at: list[Column]) -> Column:
    """Where a row stands in its group, by the first order column, ties by the second."""
    place = at[0] - F.col("_lo0")
    if len(at) == 2:
        place = place + F.coalesce((at[1] - F.col("_lo1")) / (F.col("_hi1") - F.col("_lo1") + 1), F.lit(0.0))
    return place


def hot_cuts(df: DataFrame, by: Sequence[str], order: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Places at which groups above ``hot_rows`` are cut; None if there is no such group.

    The cuts are quantiles of the order values, so that chunks hold about as many rows however
    the values are spread; rows with equal values stay together. They are approximate, so the table (at most
    rows / hot_rows groups) is written once and shared by all that must cut alike. Where the rows are too few for
    any hot group, or a count of the groups alone finds none, nothing is written.
    """
    at = _numbers(df, order)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    if df.count() <= hot_rows or sizes.isEmpty():
        return None
    ends = [f(c).alias(f"_{n}{i}") for i, c in enumerate(at) for n, f in (("lo", F.min), ("hi", F.max))]
    hot = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *ends).where(F.col("_n") > hot_rows)
    hot = materialize(hot, "hot-groups")
    rows = df.select(*by, *[c for c in order if c not in by]).alias("d").join(hot.alias("h"), _same(by, "d", "h")).select("d.*", *[f"h.{c}" for c in hot.columns if c not in by])
    grid = F.array(*[F.lit(i / QUANTILES) for i in range(1, QUANTILES)])
    cuts = rows.groupBy(*by).agg(F.percentile_approx(_place(_numbers(df, order)), grid, 10 * QUANTILES).alias("_grid"), F.first("_n").alias("_n"),
                                 *[F.first(f"_{n}{i}").alias(f"_{n}{i}") for i in range(len(at)) for n in ("lo", "hi")])
    parts = F.least(F.lit(QUANTILES), F.ceil(2 * F.col("_n") / F.lit(hot_rows))).cast("int")
    chosen = F.array_distinct(F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.get("_grid", F.floor(i * QUANTILES / parts).cast("int") - 1)))
    return materialize(cuts.withColumn("_cuts", F.when(parts > 1, chosen).otherwise(F.array().cast("array<double>"))).drop("_grid", "_n"), "hot-cuts")


def with_chunks(df: DataFrame, by: Sequence[str], order: Sequence[str], cuts: DataFrame | None, only_hot: bool = False) -> DataFrame:
    """Add ``_chunk`` by the cuts of ``hot_cuts``: 0 in small groups, rising with ``order`` in hot ones.

    Nothing is broadcast by force: the list of hot groups is short, and Spark goes
    by its size.
    """
    if cuts is None:
        return df.withColumn(CHUNK, F.lit(0).cast("long")).where(F.lit(not only_hot))
    place = _place(_numbers(df, order))
    chunk = F.size(F.filter("_cuts", lambda c: c < place)).cast("long")
    joined = df.alias("d").join(cuts.alias("h"), _same(by, "d", "h"), "inner" if only_hot else "left")
    return joined.select("d.*", F.when(F.col("_cuts").isNull(), F.lit(0).cast("long")).otherwise(chunk).alias(CHUNK))


def running(df: DataFrame, by: str | Sequence[str], order: Sequence[str], index: str | None = None,
            sums: dict[str, Column] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Row number and running sums per group, in ascending ``order``.

    ``order[0]`` must be a number or timestamp; the other columns break ties.
    """
    by, sums = _names(by), sums or {}
    parts = [f"_s{i}" for i in range(len(sums))]
    rows = df.select("*", *[c.alias(n) for n, c in zip(parts, sums.values())])
    cuts = hot_cuts(rows, by, order, hot_rows)
    here = (Window.partitionBy(*by) if cuts is None else Window.partitionBy(*by, CHUNK)).orderBy(*order)
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if cuts is None:
        out = [F.col(c) for c in df.columns]
        out += [F.row_number().over(here).cast("long").alias(index)] if index else []
        return rows.select(*out, *[F.sum(n).over(so_far).alias(name) for name, n in zip(sums, parts)])
    # Totals of the chunks of hot groups, one row per chunk.
    totals = with_chunks(rows.select(*by, *[c for c in order if c not in by], *parts), by, order, cuts, only_hot=True).groupBy(*by, CHUNK).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(n).alias(f"_t{n}") for n in parts])
    earlier = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, CHUNK, F.sum("_rows").over(earlier).alias("_before"),
        *[F.sum(f"_t{n}").over(earlier).alias(f"_b{n}") for n in parts])
    numbered = with_chunks(rows, by, order, cuts).select(
        "*", F.row_number().over(here).cast("long").alias("_rn"), *[F.sum(n).over(so_far).alias(f"_r{n}") for n in parts])
    shifted = numbered.alias("c").join(
        offsets.alias("o"), _same(by, "c", "o") & (F.col(f"c.{CHUNK}") == F.col(f"o.{CHUNK}")), "left")
    out = [F.col(f"c.{c}") for c in df.columns]
    if index:
        out.append((F.col("c._rn") + F.coalesce(F.col("o._before"), F.lit(0))).alias(index))
    for name, n in zip(sums, parts):
        out.append((F.col(f"c._r{n}") + F.coalesce(F.col(f"o._b{n}"), F.lit(0))).alias(name))
    return shifted.select(*out)


def with_index(df: DataFrame, by: str | Sequence[str], order: Sequence[str], name: str = "idx",
               hot_rows: int = HOT_ROWS) -> DataFrame:
    """1-based index in arrival order."""
    return running(df, by, order, index=name, hot_rows=hot_rows)


def running_progress(results: DataFrame, by: str | Sequence[str] = "batch_id", order: Sequence[str] = ("idx",),
                     ok: str = "success", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Completed, successful and failed so far, after each record."""
    good = F.coalesce(F.col(ok), F.lit(False))
    return running(results, by, list(order), index="completed", hot_rows=hot_rows,
                   sums={"successful": good.cast("long"), "failed": (~good).cast("long")})


def last_wins(df: DataFrame, by: Sequence[str], position: str | Sequence[str]) -> DataFrame:
    """The row with the highest position per key, by a map-side combined aggregate."""
    at = F.struct(*_names(position))
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), at).alias("_w")).select(*by, "_w.*").select(*df.columns)


def newest(df: DataFrame, ts: str, n: int, by: Sequence[str] | None = None, tie: str | None = None) -> DataFrame:
    """The n newest rows, overall or per key."""
    order = [F.col(ts).desc(), *([F.col(tie).desc()] if tie else [])]
    if not by:
        return df.orderBy(*order).limit(n)
    # A filter on row_number lets Spark keep n rows per key before the shuffle.
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def tail(df: DataFrame, position: str, n: int) -> DataFrame:
    """The last n rows of a log, newest first. Callers that must hold n within bounds do so themselves."""
    return df.orderBy(F.col(position).desc()).limit(max(1, n))


def reading_order(fields: DataFrame) -> DataFrame:
    """Fields from the top left of the first page to the bottom right of the last."""
    docs = [c for c in ("doc_id",) if c in fields.columns]
    return fields.orderBy(*docs, "page", "y", "x")


def number_fields(fields: DataFrame, name: str = "place", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Fields with their place in reading order within the document, from 1; ties by name."""
    return with_index(fields, "doc_id", ["page", "y", "x", "name"], name, hot_rows)


def parse_ranges(spec: Column) -> Column:
    """'1-3,4-7,8' to an array of (label, first, last, error)."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: strip(p)), lambda p: p != "")

    def one(p: Column) -> Column:
        pair = F.split(p, "-", 2)
        first = strip(F.get(pair, F.lit(0))).try_cast("int")
        last = F.when(F.size(pair) == 2, strip(F.get(pair, F.lit(1))).try_cast("int")).otherwise(first)
        label = F.when(F.size(pair) == 2, F.concat(F.lit("pages_"), first, F.lit("-"), last)) \
            .otherwise(F.concat(F.lit("page_"), F.lpad(first.cast("string"), F.greatest(F.lit(3), F.length(first.cast("string"))), F.lit("0"))))
        error = F.when(first.isNull() | last.isNull(), F.concat(F.lit("invalid range "), p))
        return F.struct(label.alias("label"), first.alias("first"), last.alias("last"), error.alias("error"))

    return F.transform(parts, one)


def split_segments(df: DataFrame, by: str, order: Sequence[str], mode: str, ranges: str | None = None,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """Ordered items of each group as segments: 'pages', 'half' or 'range'.

    A range that does not fit a group gives one row with ``error`` for it.
    """
    items = with_index(df, by, order, "item", hot_rows)
    pad = F.lpad(F.col("item").cast("string"), F.greatest(F.lit(3), F.length(F.col("item").cast("string"))), F.lit("0"))
    if mode == "pages":
        return items.withColumn("label", F.concat(F.lit("page_"), pad)).withColumn("error", F.lit(None).cast("string"))
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("_count"))
    if mode == "half":
        half = F.when(F.col("item") <= F.floor(F.col("_count") / 2), "part1").otherwise("part2")
        return items.join(counts, by).withColumn("label", half).withColumn("error", F.lit(None).cast("string")).drop("_count")
    if mode != "range" or not ranges:
        raise ValueError("mode must be 'pages', 'half', or 'range' with ranges")
    parsed = counts.select(by, "_count", F.explode(parse_ranges(F.lit(ranges))).alias("r")).select(
        by, "r.label", "r.first", "r.last",
        F.coalesce(F.col("r.error"), F.when(
            (F.col("r.first") < 1) | (F.col("r.last") > F.col("_count")) | (F.col("r.first") > F.col("r.last")),
            F.concat(F.lit("out of bounds: "), F.col("r.label")))).alias("error"))
    # The ranges are a short literal list, so each item picks its segments in its own row.
    segments = F.filter(parse_ranges(F.lit(ranges)), lambda r: (F.col("item") >= r["first"]) & (F.col("item") <= r["last"]))
    held = (
        items.join(counts, by)
        .withColumn("r", F.explode(F.filter(segments, lambda r: (r["first"] >= 1) & (r["last"] <= F.col("_count")))))
        .select(*df.columns, "item", F.col("r.label").alias("label"), F.lit(None).cast("string").alias("error"))
    )
    bad = parsed.where(F.col("error").isNotNull()).select(by, "label", "error")
    return held.unionByName(bad, allowMissingColumns=True)


def concat_groups(inputs: DataFrame, by: str, input_pos: str, item_pos: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Items of several inputs as one sequence, inputs in their given order."""
    items = running(inputs, [by, input_pos], [item_pos], index="_in_input", hot_rows=hot_rows)
    sizes = inputs.groupBy(by, input_pos).agg(F.count(F.lit(1)).alias("_size"))
    # One row per input, of which a group may have many: the same cuts.
    offsets = running(sizes, by, [input_pos], sums={"_through": F.col("_size")}, hot_rows=hot_rows).select(by, input_pos, (F.col("_through") - F.col("_size")).alias("_before"))
    return items.join(offsets, [by, input_pos]).select(
        *inputs.columns, (F.col("_in_input") + F.col("_before")).alias("item"))


def ordered_union(detected: DataFrame, raw: DataFrame, by: str, name: str, position: str) -> DataFrame:
    """Detected names in detection order, then the other raw names sorted.

    ``source`` (0 detected, 1 raw) and ``position`` give the order: sort by
    source, position, name.
    """
    both = detected.select(by, name, F.lit(0).alias("source"), F.col(position).cast("long").alias("position")).unionByName(
        raw.select(by, name, F.lit(1).alias("source"), F.lit(0).cast("long").alias("position")))
    return both.groupBy(by, name).agg(F.min(F.struct("source", "position")).alias("_at")).select(by, name, "_at.*")


def key_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The keys of either side, sorted."""
    return a.select(key).union(b.select(key)).distinct().orderBy(key)
