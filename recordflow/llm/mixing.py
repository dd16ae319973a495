"""Mixing sources to target weights by Pareto order sampling, DataFrame operations only.

A source's target is its share by weight of the mix, stopped at ``max_copies`` times its
size; what is over is shared again among the others. A document is wanted
``e = target / size of its source`` times (times its relative score, if there is one, and
``max_copies`` at most): floor(e) copies are certain, the rest p = e - floor(e) is its
inclusion probability. Documents are ranked by the odds of a fixed random number over the
odds of p, and the first are taken until the source's open words are filled. Documents larger than
what is open are passed over, and further passes fill what the document at the edge would leave open with those behind
it. At last the one that fits the rest best takes one more place.

The ranking needs no sort of a source: ranks fall into ``BUCKETS`` buckets, word counts are
added up per bucket, and only the bucket at the edge is sorted. A source with a third of all
rows is thus spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from recordflow.llm.common import n_words, saved, unit

BUCKETS = 4096
SEED = 42
CYCLE = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
# Most sources whose figures are sent to every task; more are joined by a shuffle.
FEW_SOURCES = 10_000
ROUNDS = 8
# Passes down the ranking. What is larger than the open words is passed over, so after the first pass little is open.
PASSES = 4


def targets(rows: DataFrame, weight: Column, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from rows (source, size). ``weight`` may use ``place``,
    the source's place (from 1) by code point, null last.

    The common level is found by filling: sources in order of the level at which they stop;
    the first that does not stop at the level of what is left sets it. The windows run over
    one row per source.
    """
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", weight)
    s = s.withColumn("stop", float(max_copies) * F.col("source_size") / F.col("weight"))
    whole = W.partitionBy()
    before = W.orderBy("stop", "place").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("budget", share * F.sum("source_size").over(whole)).withColumn("weights", F.sum("weight").over(whole))
    s = s.withColumn("level", (F.col("budget") - F.coalesce(max_copies * F.sum("source_size").over(before), F.lit(0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    s = s.withColumn("common", F.min(F.when(F.col("stop") >= F.col("level"), F.struct("stop", "place", "level"))).over(whole)["level"])
    open_ = F.coalesce(F.col("stop") >= F.col("common"), F.lit(False))
    return s.select("source", "source_size", F.when(open_, F.col("common") * F.col("weight")).otherwise(float(max_copies) * F.col("source_size")).alias("target"))


def cycle_weight(weights: tuple[int, ...] = CYCLE) -> Column:
    """Weights repeating in the order of sources."""
    return F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))


def _join(rows: DataFrame, side: DataFrame, few: bool) -> DataFrame:
    named = side.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _levels(rows: DataFrame, plan: DataFrame, few: bool, max_copies: int) -> DataFrame:
    """Adds ``rate``: wanted copies of a document per unit of score, so that the capped copies fill the target."""
    level = plan.withColumn("rate", F.lit(0.0))
    for _ in range(ROUNDS):
        at = _join(rows, level.select("source", "rate"), few)
        full = (F.col("rate") * F.col("score") >= max_copies)
        sums = at.groupBy("source").agg(F.sum(F.when(full, max_copies * F.col("size")).otherwise(0)).alias("stopped"), F.sum(F.when(~full, F.col("size") * F.col("score")).otherwise(0)).alias("rest"))
        s = sums.withColumnRenamed("source", "_source")
        level = saved(level.join(s, F.col("source").eqNullSafe(F.col("_source"))).select(
            "source", "source_size", "target", F.when(F.col("rest") > 0, (F.col("target") - F.col("stopped")) / F.col("rest")).otherwise(F.col("rate")).alias("rate")), "mix-rate")
    return level


def _draw(r: DataFrame, few: bool) -> DataFrame:
    """One pass down the ranking: documents not drawn yet that fit the open words are drawn from the first on until these run out."""
    gap = r.groupBy("source").agg((F.first("need") - F.sum(F.col("size") * F.col("drawn"))).alias("open"))
    columns, r = r.columns, _join(r, gap, few)
    r = r.withColumn("fits", F.coalesce((F.col("drawn") == 0) & F.col("rank").isNotNull() & (F.col("size") <= F.col("open")), F.lit(False)))
    # Words per bucket; the edge is the first bucket in which the open words run out.
    b = r.where("fits").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("open").alias("open"))
    up = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    b = b.withColumn("through", F.sum("words").over(up))
    edge = b.groupBy("source").agg(F.min(F.when(F.col("through") > F.col("open"), F.col("bucket"))).alias("edge"), F.max(F.when(F.col("through") <= F.col("open"), F.col("through"))).alias("under"))
    edge = saved(edge.select(F.col("source").alias("_source"), F.coalesce("edge", F.lit(BUCKETS + 1)).alias("edge"), F.coalesce("under", F.lit(0)).alias("under")), "mix-edge")
    r = r.join(F.broadcast(edge) if few else edge, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    inside = F.col("fits") & F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))
    order = W.partitionBy("source").orderBy("rank", "id", "n").rowsBetween(W.unboundedPreceding, 0)
    at_edge = r.where(inside).withColumn("drawn", (F.col("under") + F.sum("size").over(order) <= F.col("open")).cast("long"))
    others = r.where(~inside).withColumn("drawn", F.greatest("drawn", (F.col("fits") & F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False))).cast("long")))
    return others.unionByName(at_edge).select(*columns)


def copies(rows: DataFrame, plan: DataFrame, seed: int = SEED, max_copies: int = MAX_COPIES, scored: bool = False) -> DataFrame:
    """Adds the plan's columns and ``copies`` to rows (id, source, size, n, score); ``n`` tells repeated rows apart.

    ``plan``: (source, source_size, target), one row per source.
    """
    few = plan.count() <= FEW_SOURCES
    if scored:
        plan = _levels(rows, plan, few, max_copies)
        wanted = F.least(F.lit(float(max_copies)), F.col("rate") * F.col("score"))
    else:
        wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    r = _join(rows, plan, few).withColumn("wanted", F.when(F.col("size") > 0, wanted).otherwise(0.0))
    r = r.withColumn("certain", F.floor("wanted").cast("long")).withColumn("p", F.col("wanted") - F.col("certain"))
    u = unit(F.lit(seed), F.col("id"))
    r = r.withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), u / (1 - u) * ((1 - F.col("p")) / F.col("p"))))
    r = r.withColumn("bucket", F.floor(BUCKETS * (F.col("rank") / (1 + F.col("rank")))).cast("int"))
    sure = r.groupBy("source").agg((F.first("target") - F.sum(F.col("certain") * F.col("size"))).alias("need"))
    r = saved(_join(r, sure, few).withColumn("drawn", F.lit(0).cast("long")), "mix-ranked")
    for _ in range(PASSES):
        r = saved(_draw(r, few), "mix-drawn")
    # The last place of each source.
    gap = r.groupBy("source").agg(F.sum(F.col("size") * F.col("drawn")).alias("drawn_words"))
    left = _join(r.where("drawn = 0 AND rank IS NOT NULL"), gap, few).withColumn("open", F.col("need") - F.col("drawn_words"))
    off = F.abs(F.col("open") - F.col("size"))
    last = left.where((F.col("certain") < max_copies) & (off < F.col("open"))).groupBy("source").agg(F.min(F.struct(off.alias("off"), "rank", "id", "n")).alias("one"))
    named = last.select(F.col("source").alias("_source"), F.col("one.n").alias("last"))
    r = r.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    return r.withColumn("copies", F.col("certain") + F.col("drawn") + F.coalesce((F.col("n") == F.col("last")).cast("long"), F.lit(0)))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, score_col: str | None) -> DataFrame:
    score = F.greatest(F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if score_col else F.lit(1.0)
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), score.alias("score"), F.monotonically_increasing_id().alias("n"))


def mix(docs: DataFrame, weight: Column | None = None, share: float = SHARE, max_copies: int = MAX_COPIES, seed: int = SEED,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", score_col: str | None = None) -> DataFrame:
    """(id_col, source, size, source_size, target, copies, taken) of every document.

    Size is in words. A null or empty text has none and is never taken. A null source is a
    source of its own, the last. Repeated rows are drawn one by one; equal ones are
    exchangeable. Empty tables give no rows; other columns are left out.
    """
    rows = saved(_rows(docs, id_col, text_col, source_col, score_col), "mix")
    plan = saved(targets(rows, cycle_weight() if weight is None else weight, share, max_copies), "mix-targets")
    out = copies(rows, plan, seed, max_copies, score_col is not None)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, weight: Column | None = None, share: float = SHARE, max_copies: int = MAX_COPIES, seed: int = SEED,
               id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every document as many times as it is taken, with all its columns, whatever their names."""
    m = mix(docs, weight, share, max_copies, seed, id_col, text_col, source_col)
    # Repeated rows share their copies: one list of counts per (id, size, source), dealt to the rows of that key.
    take = m.groupBy(F.col(id_col).alias("id"), F.col(source_col).alias("source"), "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    row = docs.select(F.struct(*docs.columns).alias("row")).withColumn("size", n_words(f"row.{text_col}"))
    both = row.alias("r").join(take.alias("t"), F.col(f"r.row.{id_col}").eqNullSafe(F.col("t.id")) & F.col(f"r.row.{source_col}").eqNullSafe(F.col("t.source")) & (F.col("r.size") == F.col("t.size")))
    one = both.where("t.rows = 1").select("row", "copies")
    many = both.where("t.rows > 1").withColumn("i", F.row_number().over(W.partitionBy(f"row.{id_col}", f"row.{source_col}", "t.size").orderBy(f"row.{text_col}")) - 1)
    many = many.withColumn("copies", F.floor(F.col("copies") / F.col("rows")) + (F.col("i") < F.col("copies") % F.col("rows")).cast("long")).select("row", "copies")
    return one.unionByName(many).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
