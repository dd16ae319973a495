"""Hard negatives of embedded rows by a secondary sort.

Scores are whole numbers: inner products of vectors scaled by ``SCALE`` and rounded down. Each
pair's score is packed into a key of (anchor, descending score, id), so that a shuffle by anchor
which sorts within its partitions brings an anchor's rows in the order of the ranking. One pass over
them opens a window at each of the first ``POSITIVES`` rows of the anchor's label and gives it the first
``NEGATIVES`` other rows that lie in it; it holds a few counters, never an anchor's rows.

Anchors meet all rows in cells of ``CHUNK`` anchors and ``BLOCK`` rows. A cell computes all its
scores but emits only what can be in the answer: first each anchor's best rows of its own label; then, with
the windows known, the first rows of every window. So a block puts at most ``POSITIVES`` or
``POSITIVES * NEGATIVES`` keys of an anchor into the shuffle, whatever ties and copies there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recordflow.llm.common import saved

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
# A negative's score is between these shares (in percent) of the positive's score.
LOWEST, HIGHEST = 80, 100
# Anchors and rows of a cell. Each row is sent once per chunk of anchors, each anchor once per block of rows.
CHUNK = 4096
BLOCK = 8192
# Anchors whose scores a task holds at once.
TILE = 256
# Scores must fit into a long: rows whose scaled vector has this squared length or more take no part.
LONGEST = float(2 ** 62)

KEY = np.dtype([("anchor", ">u8"), ("variant", ">u8"), ("down", ">u8"), ("id", ">u8"), ("positive", "u1")])
ANCHOR_BYTES = 16
SIGN = np.uint64(1 << 63)
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _ordered(values: np.ndarray) -> np.ndarray:
    """Longs as unsigned numbers of the same order."""
    return np.ascontiguousarray(values, dtype=np.int64).view(np.uint64) ^ SIGN


def pack(anchor: np.ndarray, variant: np.ndarray, score: np.ndarray, ids: np.ndarray, positive: bool) -> pa.Array:
    """Binary keys whose byte order is (anchor, variant, score descending, id)."""
    keys = np.empty(len(ids), KEY)
    keys["anchor"], keys["variant"] = _ordered(anchor), _ordered(variant)
    keys["down"], keys["id"], keys["positive"] = ~_ordered(score), _ordered(ids), positive
    ends = np.arange(len(ids) + 1, dtype=np.int32) * KEY.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(keys.tobytes())])


def unpack(key: bytes) -> tuple[int, int, int, int, bool]:
    """(anchor, variant, score, id, positive) of a key."""
    anchor, variant, down, row, positive = (int(x) for x in np.frombuffer(key, KEY)[0])
    top = 1 << 63
    return anchor - top, variant - top, top - 1 - down, row - top, bool(positive)


def _scaled(table: pa.Table) -> np.ndarray:
    column = table.column("vector").combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).reshape(table.num_rows, -1)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products: in doubles where no sum can leave their whole numbers, else in longs."""
    most = a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0)
    return (a @ b.T).astype(np.int64) if most < 2 ** 53 else a.astype(np.int64) @ b.astype(np.int64).T


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def first_rows(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, largest first, ties by place."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        places = np.concatenate([above, np.flatnonzero(scores == least)[:k - len(above)]])
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((places, -scores[places]))]


def _keys(found: list[tuple[np.ndarray, ...]], positive: bool) -> pa.Table:
    parts = [np.concatenate(p) for p in zip(*found)] if found else [np.empty(0, np.int64)] * 4
    return pa.table({"key": pack(*parts, positive)})


def best_of_label(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """Keys of each anchor's first ``POSITIVES`` rows of its label in one cell."""
    found: list[tuple[np.ndarray, ...]] = []
    if not anchors.num_rows or not rows.num_rows:
        return _keys(found, True)
    ids, labels, vectors = _column(rows, "id"), _column(rows, "label"), _scaled(rows)
    own_ids, own_labels, variants, own = _column(anchors, "id"), _column(anchors, "label"), _column(anchors, "variant"), _scaled(anchors)
    for label in np.unique(own_labels):
        at = np.flatnonzero(labels == label)
        at = at[np.argsort(ids[at], kind="stable")]
        who = np.flatnonzero(own_labels == label)
        for tile in (who[i:i + TILE] for i in range(0, len(who), TILE)):
            for a, scores in zip(tile, _scores(own[tile], vectors[at])):
                other = np.flatnonzero(ids[at] != own_ids[a])
                best = other[first_rows(scores[other], POSITIVES)]
                found.append((np.full(len(best), own_ids[a]), np.full(len(best), variants[a]), scores[best], ids[at[best]]))
    return _keys(found, True)


def first_in_windows(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """Keys of the first ``NEGATIVES`` rows of every window of each anchor in one cell; ``opened`` holds the positives' scores."""
    found: list[tuple[np.ndarray, ...]] = []
    if not anchors.num_rows or not rows.num_rows:
        return _keys(found, False)
    rows = rows.take(pa.array(np.argsort(_column(rows, "id"), kind="stable")))
    ids, labels, vectors = _column(rows, "id"), _column(rows, "label"), _scaled(rows)
    own_ids, own_labels, variants, own = _column(anchors, "id"), _column(anchors, "label"), _column(anchors, "variant"), _scaled(anchors)
    opened = anchors.column("opened").to_pylist()
    for start in range(0, len(own_ids), TILE):
        for a, scores in enumerate(_scores(own[start:start + TILE], vectors), start):
            windows = [(-(-LOWEST * s // 100), s) for s in set(opened[a]) if s >= 0]
            if not windows:
                continue
            reach = (scores >= min(w[0] for w in windows)) & (scores <= max(w[1] for w in windows))
            places = np.flatnonzero(reach & (labels != own_labels[a]))
            places = places[np.lexsort((places, -scores[places]))]
            down = -scores[places]
            keep = np.zeros(len(places), bool)
            for low, high in windows:
                first = np.searchsorted(down, -high, side="left")
                keep[first:min(first + NEGATIVES, np.searchsorted(down, -low, side="right"))] = True
            places = places[keep]
            found.append((np.full(len(places), own_ids[a]), np.full(len(places), variants[a]), scores[places], ids[places]))
    return _keys(found, False)


def first_positives(keys: Iterable[tuple[bytes, None]]) -> Iterator[tuple[int, int, int, bytes]]:
    """(anchor, variant, score, key) of each anchor's first ``POSITIVES`` keys of an ordered stream."""
    now, n = None, 0
    for key, _ in keys:
        if key[:ANCHOR_BYTES] != now:
            now, n = key[:ANCHOR_BYTES], 0
        n += 1
        if n <= POSITIVES:
            anchor, variant, score, _, _ = unpack(key)
            yield anchor, variant, score, key


def open_windows(keys: Iterable[tuple[bytes, None]]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Rows of the result from an ordered stream of keys.

    A positive opens a window. A negative goes to every open window with a place left that reaches down to its
    score. Negatives of a score equal to a positive's belong to it even where their
    smaller ids come first, so the first ones of the current score are remembered.
    """
    now, windows, level, same = None, [], None, []
    for key, _ in keys:
        if key[:ANCHOR_BYTES] != now:
            now, windows, level, same, seen = key[:ANCHOR_BYTES], [], None, [], 0
        anchor, _, score, row, positive = unpack(key)
        if score != level:
            level, same = score, []
        if positive:
            seen += 1
            if seen > POSITIVES or score < 0:
                continue
            window = [row, score, 0]
            windows.append(window)
            waiting, fits = same, [window]
        else:
            if len(same) < NEGATIVES:
                same.append(row)
            waiting, fits = [row], windows
        for window in fits:
            for negative in waiting:
                if window[2] < NEGATIVES and LOWEST * window[1] <= 100 * score <= HIGHEST * window[1]:
                    window[2] += 1
                    yield anchor, window[0], window[2], negative, window[1], score


def _anchor_hash(key: bytes) -> int:
    return zlib.crc32(key[:ANCHOR_BYTES])


def _secondary_sort(keys: DataFrame):
    """The keys dealt out by anchor, and in their order within each partition."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.rdd.map(lambda r: (bytes(r[0]), None)).repartitionAndSortWithinPartitions(parts, _anchor_hash)


def usable(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector, dim) of the rows that take part."""
    vector, label = F.col(vector_col), F.col(label_col).cast("long")
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.pow(F.floor(SCALE * x.cast("double")).cast("double"), 2))
    rows = df.where(F.col(id_col).isNotNull() & label.isNotNull() & vector.isNotNull() & finite)
    return rows.where(square < LONGEST).select(F.col(id_col).cast("long").alias("id"), label.alias("label"), vector.alias("vector"), F.size(vector).alias("dim"))


def mine(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` says which rows are anchors. Rows with a null id, label or vector or any null or non-finite
    component take no part, nor do vectors so long (a squared length of 2**62 after scaling) that scores
    could leave a long. Vectors only meet vectors of their length; empty ones have score 0. Rows with an anchor's own id are not among its
    candidates. Anchors alike in id, label and vector count once; repeated candidates each take
    a place. A positive with a negative score opens no window. Empty tables give no rows; other columns are left out.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col, label_col)
    chosen = usable(df.where(is_anchor), id_col, vector_col, label_col).dropDuplicates(["id", "label", "vector"])
    anchors = saved(chosen.withColumn("variant", F.xxhash64("label", "vector")), "anchors")
    n_anchors, n_rows = anchors.count(), rows.count()
    chunks, blocks = -(-n_anchors // CHUNK) or 1, -(-n_rows // BLOCK) or 1
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chunks * blocks // 16)
    cell = ["dim", "chunk", "block"]

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # Copies are dealt out by their place in the table, so that no block holds more of them than others.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("chunk", each(chunks)).repartition(parts, *cell).groupBy(*cell)

    def meet(side: DataFrame, fn) -> DataFrame:
        side = side.withColumn("chunk", F.pmod(F.xxhash64("id", "variant"), F.lit(chunks)).cast("int")).withColumn("block", each(blocks))
        return side.repartition(parts, *cell).groupBy(*cell).cogroup(dealt).applyInArrow(fn, "key binary")

    ranked = _secondary_sort(meet(anchors, best_of_label)).mapPartitions(first_positives)
    positives = saved(spark.createDataFrame(ranked, "id long, variant long, score long, key binary", verifySchema=False), "positives")
    opened = positives.groupBy("id", "variant").agg(F.collect_list("score").alias("opened"))
    negatives = meet(anchors.join(opened, ["id", "variant"]), first_in_windows)
    stream = _secondary_sort(negatives.unionByName(positives.select("key")))
    return spark.createDataFrame(stream.mapPartitions(open_windows), OUT, verifySchema=False)
