"""Best-fit packing of documents into sequences, certified by lower bounds.

A document becomes pieces: only documents longer than a sequence are cut, into full pieces
behind a first one that takes the remainder. Full pieces are sequences of their own. The
others are dealt into partitions and packed there by best-fit decreasing. Dual feasible
functions give a lower bound on the bins of a partition and of all rows together: a length
is counted by a function whose sum over any full bin is at most one, so the sum over all
lengths, rounded up, bounds the number of bins.

Bins that are full, or whose partition packs at its bound without waste, stay. Partitions
with a gap exchange documents: those of their unfilled bins meet anew, fewer in each round,
until the total is at the bound or a round saves nothing. The bound of the whole table needs
only the count of each length (at most ``size`` numbers).
"""

from __future__ import annotations

import json
import math
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recordflow.llm.common import saved, text_bytes

SIZE = 1024
END = 2
VOCABULARY = "byte_bpe_50k.json"
# Pieces packed together in one task.
PARTITION = 20_000
ROUNDS = 6

PIECES = "struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint>"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in a byte-level vocabulary: printable bytes for
    themselves, the others from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """Function from text to token ids by the byte-level vocabulary file at ``path``.

    The same vocabulary and merges run in a faster library; a text on which that one gives
    up (runs of a million blanks, say) is encoded by the file's own. Added tokens of the file that stand in a text are read as such.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    letters = _byte_letters()
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    special = {t["content"]: t["id"] for t in given["added_tokens"]}
    ranks = {bytes(letters[c] for c in t): i for t, i in given["model"]["vocab"].items() if t not in special and all(c in letters for c in t)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @lru_cache(maxsize=1)
    def own():
        return Tokenizer.from_file(path)

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except BaseException as e:
            # The library's own failures come as panics, which are no ordinary exceptions.
            if not isinstance(e, (ValueError, RuntimeError)) and type(e).__name__ != "PanicException":
                raise
            return own().encode(text, add_special_tokens=False).ids

    return encode


def cut(ids: array, size: int) -> list[dict]:
    """Pieces of a document's ids: a first one with the remainder, then full ones."""
    n = len(ids)
    first = n if n <= size else n % size or size
    edges = [0, *range(first, n + 1, size)]
    raw = memoryview(ids.tobytes())
    return [{"piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(raw[4 * a:4 * b])} for i, (a, b) in enumerate(zip(edges, edges[1:]))]


def pieces(text: Column, size: int = SIZE, end: int = END, path: str | None = None) -> Column:
    """Array of PIECES for a column of UTF-8 bytes."""
    path = path or vocabulary_path()

    @F.arrow_udf(f"array<{PIECES}>")
    def run(texts: pa.Array) -> pa.Array:
        encode = encoder(path)
        out = []
        for t in texts.to_pylist():
            ids = array("I", encode(t.decode("utf-8", "replace")))
            ids.append(end)
            out.append(cut(ids, size))
        kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
        return pa.array(out, kind)

    return run.asNondeterministic()(text)


# --- bounds ---

def lower_bound(counts: np.ndarray, size: int) -> int:
    """Fewest bins that lengths with these counts (index: length) can take, by dual feasible functions."""
    x = np.arange(len(counts))
    total = int((counts * x).sum())
    best = -(-total // size)
    by_length, by_size = np.cumsum(counts), np.cumsum(counts * x)
    # Lengths above size - t fill a bin alone, those under t count as nothing, others as they are.
    t = np.arange(1, size // 2 + 1)
    large = by_length[-1] - by_length[size - t]
    middle = by_size[size - t] - by_size[t - 1]
    best = max(best, int((large - (-middle // size)).max()))
    # Steps: a length counts as the number of whole parts of 1/(k+1) in it, of k.
    for k in range(1, 32):
        scaled = (k + 1) * x
        exact = scaled % size == 0
        # Doubled denominators keep this whole: sums of k * size.
        value = np.where(exact, k * x, scaled // size * size)
        best = max(best, -(-int((counts * value).sum()) // (k * size)))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: bin and offset of each length, and what each bin leaves free."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[int] = []
    open_at: list[list[int]] = [[] for _ in range(size + 1)]
    room = 0  # bit f is set if a bin has f free
    for i in order.tolist():
        n = int(lengths[i])
        above = room >> n
        if above:
            f = n + (above & -above).bit_length() - 1
            b = open_at[f].pop()
            if not open_at[f]:
                room ^= 1 << f
        else:
            b, f = len(free), size
            free.append(size)
        bins[i], offsets[i] = b, size - f
        free[b] = f - n
        if f > n:
            open_at[f - n].append(b)
            room |= 1 << (f - n)
    return bins, offsets, free


PACKED = "n long, length long, part long, bin long, offset long, free long, bound long, bins long"


def _pack(rows: DataFrame, parts: int, size: int) -> DataFrame:
    """Packs rows (n, length) in ``parts`` partitions."""

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy()
        bins, offsets, free = best_fit(lengths, size)
        bound = lower_bound(np.bincount(lengths, minlength=size + 1), size)
        return pd.DataFrame({"n": group["n"], "length": lengths, "part": key[0], "bin": bins, "offset": offsets, "free": np.array(free, np.int64)[bins], "bound": bound, "bins": len(free)})

    dealt = rows.select("n", "length", F.pmod(F.xxhash64("n", F.lit(parts)), F.lit(parts)).alias("part"))
    return dealt.groupBy("part").applyInPandas(run, PACKED)


def pack_lengths(rows: DataFrame, size: int = SIZE, partition: int = PARTITION, rounds: int = ROUNDS) -> tuple[DataFrame, dict]:
    """(n, sequence_id, offset) for rows (n unique, length from 1 to size), and the certificate:
    bins, the bound on them, and the rounds it took."""
    counts = np.zeros(size + 1, np.int64)
    for r in rows.groupBy("length").count().collect():  # at most ``size`` rows
        counts[r["length"]] = r["count"]
    bound = lower_bound(counts, size)
    full = rows.where(F.col("length") == size).select("n", (F.lit(31 << 58) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed, pool = [full], rows.where(F.col("length") < size)
    settled, waiting = int(counts[size]), int(counts[1:size].sum())
    best, used = None, 0
    for used in range(1, rounds + 1):
        if not waiting:
            break
        step = saved(_pack(pool, max(1, math.ceil(waiting / partition)), size), "pack")
        # A bin is closed if it is full, or if its partition packs at its bound and nothing but one bin is unfilled.
        one = step.where("offset = 0")
        sums = one.agg(F.count("*").alias("bins"), F.sum((F.col("free") > 0).cast("long")).alias("unfilled")).first()
        if best is not None and sums["bins"] >= best[1]:
            break
        best = (step, sums["bins"], used)
        if settled + sums["bins"] <= bound or sums["unfilled"] <= 1:
            break
        closed = step.where("free = 0")
        rest = saved(step.where("free > 0").select("n", "length"), "pack-rest")
        waiting = rest.count()
        settled += sums["bins"] - sums["unfilled"]
        placed.append(_named(closed, used))
        pool, best = rest, (step.where("free > 0"), sums["unfilled"], used)
    if best is not None:
        placed.append(_named(best[0], best[2]))
    total = settled + (best[1] if best is not None else 0)
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out, {"bins": total, "bound": bound, "rounds": used}


def _named(step: DataFrame, number: int) -> DataFrame:
    return step.select("n", (F.lit(number << 58) + F.shiftleft(F.col("part"), 20) + F.col("bin")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, size: int = SIZE, end: int = END, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
         partition: int = PARTITION) -> tuple[DataFrame, dict]:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset) per piece, and the certificate.

    A null or empty text is one piece with the end id alone. Repeated rows are packed one by
    one. An empty table gives no rows; other columns are left out.
    """
    p = docs.select(F.col(id_col).alias("id"), F.explode(pieces(text_bytes(text_col), size, end, path)).alias("p"))
    p = saved(p.select("id", "p.*").withColumn("n", F.monotonically_increasing_id()), "pieces")
    where, proof = pack_lengths(p.select("n", "length"), size, partition)
    out = p.join(where, "n").select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    return out, proof
