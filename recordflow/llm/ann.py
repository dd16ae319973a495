"""Nearest neighbours by stable projections and a kd-tree.

Inner products become distances: a vector x is lengthened by sqrt(M^2 - |x|^2), M being
the largest length, a query by 0; then the nearest by distance is the one with the largest product.
Both are projected on ``DIMS`` Gaussian directions. Stable projections keep distances: the
square of a projected distance, over that of the true one, is chi-square distributed.

The projected vectors form a kd-tree. Its top is fitted on a bounded sample and splits
the table into cells, which are cut into blocks of bounded size; each block has a tree of
its own in the task that holds it. A query first searches its own cell. Then it visits every other block, unless
the stopping test already holds for the block's box. In a block its leaves are visited
in the order of their projected distance, their vectors verified by exact products, and the
search stops when the chance that a true neighbour still lies behind the projected distance reached
is at most 1 - ``CONFIDENCE``: r^2 > chi2(CONFIDENCE, DIMS) * d_k^2, d_k being the distance of the k-th best so far.

Equal vectors are searched once, and only the k + 1 smallest ids of each can be in a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from recordflow.llm.common import saved

DIMS = 16
CONFIDENCE = 0.97
LEAF = 64
# Vectors that fit the top of the tree, rows in a block, queries searched at once.
SAMPLE = 20_000
BLOCK = 8_192
# Most cells of the tree's top; a cell that holds more than a block is cut into parts.
CELLS = 2_048
QUERIES = 2_048
SEED = 42


def chi2_quantile(p: float, m: int) -> float:
    """Quantile of the chi-square distribution, by bisection on the incomplete gamma series."""
    def cdf(x: float) -> float:
        a, x = m / 2, x / 2
        term = total = 1 / a
        n = 0
        while term > total * 1e-15:
            n += 1
            term *= x / (a + n)
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0
    low, high = 0.0, 10.0 * m + 100
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def directions(width: int, dims: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, dims))


def kd_split(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree: halves at the median of the widest dimension."""
    out, stack = [], [np.arange(len(points))]
    while stack:
        rows = stack.pop()
        spread = np.ptp(points[rows], axis=0) if len(rows) else np.zeros(1)
        if len(rows) <= most or not spread.max():
            out += [rows[i:i + most] for i in range(0, len(rows), most)]
            continue
        d = int(spread.argmax())
        order = rows[np.argsort(points[rows, d], kind="stable")]
        stack += [order[len(order) // 2:], order[: len(order) // 2]]
    return out


def kd_top(points: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """Top of the tree as nodes (dimension, cut, left, right); a negative child -c - 1 is cell c."""
    nodes: list = []
    made = 0

    def grow(rows: np.ndarray, n: int) -> int:
        nonlocal made
        spread = np.ptp(points[rows], axis=0) if len(rows) > 1 else np.zeros(1)
        if n <= 1 or not spread.max():
            made += 1
            return -made
        d = int(spread.argmax())
        cut = float(np.median(points[rows, d]))
        low = points[rows, d] < cut
        if not low.any():
            cut = float(points[rows, d][points[rows, d] > cut].min())
            low = points[rows, d] < cut
        at = len(nodes)
        nodes.append(None)
        left = grow(rows[low], n // 2)
        right = grow(rows[~low], n - n // 2)
        nodes[at] = (d, cut, left, right)
        return at

    grow(np.arange(len(points)), cells)
    return nodes


def cell_of(nodes: list, points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int32)
    stack = [(0, np.arange(len(points)))] if nodes else []
    while stack:
        at, rows = stack.pop()
        if at < 0:
            out[rows] = -at - 1
            continue
        d, cut, left, right = nodes[at]
        low = points[rows, d] < cut
        stack += [(left, rows[low]), (right, rows[~low])]
    return out


def search_block(points: np.ndarray, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, projected: np.ndarray, norms: np.ndarray, bound: np.ndarray,
                 k: int, top_norm: float, factor: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """The best k (scores, ids) of a block for each query.

    ``bound``: for each query the k-th best product known so far. Leaves are visited in
    rounds; in a round each query that still searches takes its next leaves.
    """
    leaves = kd_split(points, LEAF)
    low = np.stack([points[r].min(0) for r in leaves])
    high = np.stack([points[r].max(0) for r in leaves])
    n, m = len(queries), len(leaves)
    gap = np.zeros((n, m))
    for d in range(points.shape[1]):
        x = projected[:, d:d + 1]
        away = np.maximum(0, np.maximum(low[None, :, d] - x, x - high[None, :, d]))
        gap += away * away
    order = np.argsort(gap, axis=1, kind="stable")
    best = [(np.empty(0), np.empty(0, np.int64))] * n
    kth = bound.copy()
    active = np.arange(n)
    at = 0
    step = 2
    while len(active) and at < m:
        take = order[active, at:at + step]
        reached = gap[active, order[active, at]]
        square = np.maximum(0, norms[active] ** 2 + top_norm ** 2 - 2 * kth[active])
        go = reached <= factor * square + 1e-9
        active, take = active[go], take[go]
        leaf_of, query_of = take.ravel(), np.repeat(active, take.shape[1])
        by = np.argsort(leaf_of, kind="stable")
        leaf_of, query_of = leaf_of[by], query_of[by]
        edges = np.flatnonzero(np.concatenate(([True], leaf_of[1:] != leaf_of[:-1]))) if len(leaf_of) else np.empty(0, np.int64)
        for a, b in zip(edges, np.append(edges[1:], len(leaf_of))):
            rows, who = leaves[leaf_of[a]], query_of[a:b]
            products = queries[who] @ vectors[rows].T
            # Nothing is lost to rounding here: what is within a hair of the bound stays.
            hit = products >= kth[who][:, None] - 1e-9 * (1 + np.abs(kth[who][:, None]))
            for i in np.flatnonzero(hit.any(1)).tolist():
                q = int(who[i])
                found = rows[hit[i]]
                score = (vectors[found] * queries[q]).sum(1)
                s, v = np.concatenate((best[q][0], score)), np.concatenate((best[q][1], ids[found]))
                keep = np.lexsort((v, -s))[:k]
                best[q] = s[keep], v[keep]
                if len(keep) == k:
                    kth[q] = max(kth[q], s[keep[-1]])
        at += step
        step = min(64, step * 2)
    return best


def valid_vector(vec: Column) -> Column:
    """Neither null nor empty nor zero, and no component null, NaN or infinite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def _matrix(column: pd.Series | pa.Array) -> np.ndarray:
    """Rows of a column of lists of one length."""
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()).astype(np.float64)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def _top(flat: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("name").orderBy(F.desc("score"), "id")
    return flat.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")


def _flat(found: DataFrame) -> DataFrame:
    return found.select("name", F.explode(F.arrays_zip("scores", "ids")).alias("x")).select("name", F.col("x.scores").alias("score"), F.col("x.ids").alias("id"))


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, confidence: float = CONFIDENCE,
            block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest rows of each query row by inner product, itself left out.

    ``is_query`` may use the column ``id``. Vectors that are null, empty or zero or hold a null
    or non-finite component take no part; neither do null ids. All vectors must have one length, the
    commonest; others are left out. Fewer candidates than k give fewer rows, no query no
    rows. Rows repeated with their id count as one. Other columns are left out.
    """
    v = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & valid_vector(F.col("vec")))
    v = v.withColumn("query", F.coalesce(is_query, F.lit(False)))
    # One row for equal vectors: its smallest id names it; the k + 1 smallest ids can be results.
    ranked = v.distinct().withColumn("hash", F.xxhash64("vec")).withColumn("copy", F.row_number().over(W.partitionBy("hash", "vec").orderBy("id"))).where(F.col("copy") <= k + 1)
    one = saved(ranked.groupBy("hash", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("name"), "hash", "vec", "ids"), "ann-vectors")
    asked = v.where("query").select("id", F.xxhash64("vec").alias("hash"), "vec").distinct()
    asked = saved(asked.alias("a").join(one.alias("o"), (F.col("a.hash") == F.col("o.hash")) & (F.col("a.vec") == F.col("o.vec"))).select("a.id", "o.name"), "ann-asked")
    sizes = one.groupBy(F.size("vec").alias("width")).agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")).orderBy(F.desc("n"), "width").first()
    out = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return rows.sparkSession.createDataFrame([], out)
    width, n, top_norm = sizes["width"], sizes["n"], math.sqrt(sizes["norm"])
    one = one.where(F.size("vec") == width)
    matrix = directions(width + 1, dims)
    factor = chi2_quantile(confidence, dims)

    def project(vectors: np.ndarray, query: bool) -> np.ndarray:
        norm = (vectors * vectors).sum(1)
        last = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(0, top_norm ** 2 - norm))
        return vectors @ matrix[:-1] + last[:, None] * matrix[-1]

    sample = one.orderBy("hash").limit(SAMPLE).select("vec").toPandas()  # a bounded sample
    nodes = kd_top(project(_matrix(sample["vec"]), False), min(CELLS, max(1, math.ceil(n / block))))

    def to_cells(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    vectors = _matrix(b.column(1))
                    points = project(vectors, query)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cell_of(nodes, points)), _lists(points)], ["name", "vec", "ids", "cell", "point"])
        return run

    kind = "name long, vec array<double>, ids array<long>, cell int, point array<double>"
    index = one.select("name", "vec", "ids").mapInArrow(to_cells(False), kind)
    counts = index.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("parts"), *[f(F.col("point")[d]).alias(f"{a}{d}") for d in range(dims) for f, a in ((F.min, "l"), (F.max, "h"))])
    cells = saved(counts.select("cell", "parts", F.array(*[f"l{d}" for d in range(dims)]).alias("low"), F.array(*[f"h{d}" for d in range(dims)]).alias("high")), "ann-cells")
    spread = cells.select("cell", F.col("parts").alias("cell_parts"))
    index = saved(index.join(spread, "cell").withColumn("part", F.pmod(F.xxhash64("name"), F.col("cell_parts")).cast("int")).drop("cell_parts"), "ann-index")
    names = asked.select("name").distinct()
    queries = saved(one.join(names, "name", "left_semi").select("name", "vec", "ids").mapInArrow(to_cells(True), kind).withColumn("chunk", F.pmod(F.xxhash64("name"), F.lit(1 << 30)).cast("int")), "ann-queries")
    chunks = max(1, math.ceil(queries.count() / QUERIES))
    queries = queries.withColumn("chunk", F.col("chunk") % chunks)
    k1 = k + 1

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=["name", "scores", "ids"], dtype=object)
        vectors, points = _matrix(left["vec"]), _matrix(left["point"])
        groups = list(left["ids"])
        asked_vectors = _matrix(right["vec"])
        norms = np.sqrt((asked_vectors ** 2).sum(1))
        found = search_block(points, vectors, left["name"].to_numpy(), asked_vectors, _matrix(right["point"]), norms, right["bound"].to_numpy(), k1, top_norm, factor)
        where = {name: i for i, name in enumerate(left["name"].tolist())}
        rows = []
        for name, (scores, ids) in zip(right["name"].tolist(), found):
            # Back to all ids of equal vectors.
            both = sorted(((-s, i) for s, v in zip(scores.tolist(), ids.tolist()) for i in groups[where[v]]))[:k1]
            if both:
                rows.append((name, [-s for s, _ in both], [i for _, i in both]))
        return pd.DataFrame(rows, columns=["name", "scores", "ids"]).astype({"scores": object, "ids": object})

    found_kind = "name long, scores array<double>, ids array<long>"
    split = index.select("name", "vec", "ids", "point", "cell", "part").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    low = F.lit(-float("inf"))
    ask = queries.select("name", "vec", "point", "cell", "chunk")
    # First the query's own cell, all parts of it.
    home = ask.join(spread, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("cell_parts").cast("int") - 1))).drop("cell_parts").withColumn("bound", low)
    near = saved(split.groupBy("cell", "part", "chunk").cogroup(home.groupBy("cell", "part", "chunk")).applyInPandas(search, found_kind), "ann-near")
    bounds = _top(_flat(near), k1).groupBy("name").agg(F.min("score").alias("least"), F.count("*").alias("n")).select("name", F.when(F.col("n") >= k1, F.col("least")).otherwise(low).alias("bound"))
    # Then every other cell that the stopping test does not rule out (at most CELLS boxes).
    boxes = cells.orderBy("cell").collect()
    numbers = np.array([b["cell"] for b in boxes])
    parts = np.array([b["parts"] for b in boxes])
    box_low, box_high = np.array([b["low"] for b in boxes]), np.array([b["high"] for b in boxes])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                points, vectors, bound = _matrix(b.column("point")), _matrix(b.column("vec")), b.column("bound").to_numpy()
                away = np.maximum(0, np.maximum(box_low[None] - points[:, None], points[:, None] - box_high[None]))
                square = np.maximum(0, (vectors * vectors).sum(1) + top_norm ** 2 - 2 * bound)
                ask, box = np.nonzero(((away * away).sum(2) <= factor * square[:, None] + 1e-9) & (numbers[None] != b.column("cell").to_numpy()[:, None]))
                ask, box = np.repeat(ask, parts[box]), np.repeat(box, parts[box])
                first = np.concatenate(([True], (ask[1:] != ask[:-1]) | (box[1:] != box[:-1]))) if len(ask) else np.empty(0, bool)
                part = np.arange(len(ask)) - np.maximum.accumulate(np.where(first, np.arange(len(ask)), 0))
                rows = b.take(pa.array(ask))
                yield pa.RecordBatch.from_arrays([rows.column("name"), rows.column("vec"), rows.column("point"), pa.array(numbers[box].astype(np.int32)), rows.column("chunk"), pa.array(part.astype(np.int32)), rows.column("bound")],
                                                 ["name", "vec", "point", "cell", "chunk", "part", "bound"])

    bounded = ask.join(bounds, "name", "left").withColumn("bound", F.coalesce("bound", low))
    visit = bounded.mapInArrow(visits, "name long, vec array<double>, point array<double>, cell int, chunk int, part int, bound double")
    far = saved(split.groupBy("cell", "part", "chunk").cogroup(visit.groupBy("cell", "part", "chunk")).applyInPandas(search, found_kind), "ann-far")
    best = _top(_flat(near).unionByName(_flat(far)), k1).groupBy("name").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))).alias("best"))
    results = asked.join(best, "name").withColumn("best", F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, k))
    return results.select(F.col("id").alias("query_id"), F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias(id_col), (-F.col("b.less")).alias("score"))
