"""SimHash near-duplicate groups by bit-sliced comparison.

A document's fingerprint has ``words64`` 64-bit words; a bit is set if it is set in over
half the hashes of the document's shingles. Fingerprints link at ``radius`` differing
bits or fewer, and documents joined by links form a group.

1. Equal fingerprints are one row from the start, so exact copies cost nothing further.
2. Every distinct fingerprint is dealt into buckets. For a small radius the 64 bits are cut
   into ``radius + 2`` blocks and each pair of blocks is a key: two fingerprints within the
   radius agree in at least two blocks, so no link is lost. For a wide radius each key is a
   fixed random choice of bits (``bands`` of ``width``), which finds a pair that differs in
   a share p of its bits with probability 1 - (1 - (1 - p)^width)^bands.
3. In a bucket the fingerprints lie as vertical bit planes. One fingerprint is held against
   all others at once: carry-save counters, themselves bit planes, add up the differing
   bits, and a block of fingerprints is abandoned once every counter is past the radius.
   A bucket only emits links that span its groups, never all pairs.
4. Buckets above ``MOST`` rows are set aside by the first pass and cut into cells of a
   triangle (part i against part j), which keeps every link with bounded memory.
5. Groups are connected components by contraction: nodes go to their least neighbour, each
   round written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from recordflow.llm.common import keyed_runs, saved, text_bytes

# Most rows of one bucket in a task's memory; larger ones are cut.
MOST = 20_000
# Buckets up to this size are compared row by row in one vectorised step.
SMALL = 24
# Odd multipliers that derive further hash words from the first (fixed values).
MIX = [int(xxhash.xxh64_intdigest(f"word {i}", seed=42)) | 1 for i in range(16)]
SHINGLE_BLOCK = 1 << 16


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle of a text, lower-cased in A-Z, in order."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist())], np.uint64)


def _counts(h: np.ndarray) -> np.ndarray:
    """How often each bit is set in the rows of ``h`` (n x words64), as words64 x 64.

    Rows are added by carry-save adders: three rows of one weight become a row of that
    weight and one of twice it, so that few rows are left to unpack.
    """
    total = np.zeros((h.shape[1], 64), np.int64)
    weight, row = 1, h
    while len(row):
        carry = []
        while len(row) >= 12:
            n = len(row) // 3
            a, b, c, rest = row[:n], row[n:2 * n], row[2 * n:3 * n], row[3 * n:]
            part = a ^ b
            carry.append((a & b) | (part & c))
            row = np.concatenate((part ^ c, rest))
        bits = np.unpackbits(np.ascontiguousarray(row).view(np.uint8).reshape(len(row), h.shape[1], 8), axis=2, bitorder="little")
        total += weight * bits.reshape(len(row), h.shape[1], 64).sum(0, dtype=np.int64)
        row = np.concatenate(carry) if carry else row[:0]
        weight *= 2
    return total


def fingerprint(text: bytes, k: int, words64: int = 1, repeats: bool = True) -> np.ndarray:
    """Fingerprint words of a text; all zero for a text without words."""
    base = shingle_hashes(text, k)
    if not repeats:
        base = np.unique(base)
    n = len(base)
    total = np.zeros((words64, 64), np.int64)
    for at in range(0, n, SHINGLE_BLOCK):
        part = base[at:at + SHINGLE_BLOCK]
        rows = np.empty((len(part), words64), np.uint64)
        rows[:, 0] = part
        for i in range(1, words64):
            x = (part ^ (part >> np.uint64(32))) * np.uint64(MIX[i])
            x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX[(i + 7) % 16])
            rows[:, i] = x ^ (x >> np.uint64(32))
        total += _counts(rows)
    bits = (2 * total > n).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(words64)


def fingerprints(text: Column, k: int, words64: int = 1, repeats: bool = True) -> Column:
    """Column of fingerprints in hex, most significant digit of each word first."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(["".join(f"{int(w):016x}" for w in fingerprint(t, k, words64, repeats)) for t in texts.to_pylist()], pa.string())

    return run.asNondeterministic()(text)


def _unhex(column: pa.ChunkedArray | pa.Array, words64: int) -> np.ndarray:
    joined = bytes.fromhex("".join(column.to_pylist()))
    return np.frombuffer(joined, ">u8").astype(np.uint64).reshape(-1, words64)


# --- buckets ---

def _pair_masks(blocks: int) -> list[int]:
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    masks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:])]
    return [masks[i] | masks[j] for i in range(blocks) for j in range(i)]


def _band_bits(words64: int, bands: int, width: int) -> list[np.ndarray]:
    rng = np.random.default_rng(42)
    return [np.sort(rng.choice(words64 * 64, width, replace=False)) for _ in range(bands)]


def bucket_keys(fp: np.ndarray, radius: int, bands: int | None, width: int) -> np.ndarray:
    """Bucket keys of fingerprints (n x words64), n x number of keys. Keys of different
    kinds differ; that two share a hash by chance only adds a comparison."""
    out = []
    if bands is None:
        for i, mask in enumerate(_pair_masks(radius + 2)):
            x = fp[:, 0] & np.uint64(mask)
            x = (x + np.uint64(i + 1)) * np.uint64(MIX[i % 16])
            out.append((x ^ (x >> np.uint64(31))) * np.uint64(MIX[(i + 3) % 16]))
    else:
        bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")
        weights = np.uint64(1) << np.arange(width, dtype=np.uint64)
        for i, chosen in enumerate(_band_bits(fp.shape[1], bands, width)):
            x = bits[:, chosen].astype(np.uint64) @ weights
            out.append((np.uint64(i) << np.uint64(width)) | x)
    return np.stack(out, axis=1).view(np.int64)


# --- comparison within a bucket ---

def planes_of(fp: np.ndarray) -> np.ndarray:
    """Vertical bit planes of fingerprints: row b holds bit b of all of them, packed."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little")


def within(planes: np.ndarray, n: int, one: np.ndarray, radius: int) -> np.ndarray:
    """Which of n fingerprints in planes differ from ``one`` in at most ``radius`` bits.

    Counters are bit planes that start at the value at which ``radius + 1`` differences
    carry out of the top one; a carry marks a fingerprint as too far for good.
    """
    depth = int(radius).bit_length()
    start = (1 << depth) - 1 - radius
    width = planes.shape[1]
    counters = [np.full(width, 255 if start >> i & 1 else 0, np.uint8) for i in range(depth)]
    far = np.packbits(np.arange(width * 8) >= n, bitorder="little")  # places past the last fingerprint
    bits = np.unpackbits(np.ascontiguousarray(one).view(np.uint8), bitorder="little")
    for b in range(len(planes)):
        carry = ~planes[b] if bits[b] else planes[b].copy()
        for i in range(depth):
            kept = counters[i] & carry
            counters[i] ^= carry
            carry = kept
        far |= carry
        if b % 8 == 7 and b >= radius and (far == 255).all():
            break
    return np.unpackbits(far, bitorder="little")[:n] == 0


def bucket_links(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links from the first row of each group of one bucket to its others: each row found is
    held against those not yet found."""
    links, left = [], np.arange(len(fp))
    while len(left) > 1:
        first, left = int(left[0]), left[1:]
        queue = [first]
        planes = planes_of(fp[left])
        while queue and len(left):
            at = queue.pop()
            near = within(planes, len(left), fp[at], radius)
            if near.any():
                found = left[near].tolist()
                links += [(first, x) for x in found]
                queue += found
                left = left[~near]
                planes = planes_of(fp[left])
    return links


def _small_links(keys: np.ndarray, sizes: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of all buckets of up to SMALL rows: row i against row i + d, for all i at once.
    Each row is then linked to the first of its group."""
    a, b = [], []
    for d in range(1, SMALL):
        rows = np.flatnonzero(sizes[: len(keys) - d] > d) if len(keys) > d else np.empty(0, np.int64)
        rows = rows[keys[rows] == keys[rows + d]]
        if not len(rows):
            break
        rows = rows[np.bitwise_count(fp[rows] ^ fp[rows + d]).sum(1) <= radius]
        a.append(rows)
        b.append(rows + d)
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    both = np.concatenate(a), np.concatenate(b)
    first = np.arange(len(keys))
    while (first[both[0]] != first[both[1]]).any():
        np.minimum.at(first, both[1], first[both[0]])
        np.minimum.at(first, both[0], first[both[1]])
    rows = np.flatnonzero(first < np.arange(len(keys)))
    return first[rows], rows


def _names(table: pa.Table, words64: int) -> np.ndarray:
    return np.stack([table.column(f"w{i}").to_numpy() for i in range(words64)], axis=1).view(np.uint64)


LINK = "a string, b string, bucket long, part int, parts int"


def _hex_rows(fp: np.ndarray) -> list[str]:
    text = np.ascontiguousarray(fp.astype(">u8")).tobytes().hex()
    n = fp.shape[1] * 16
    return [text[i:i + n] for i in range(0, len(text), n)]


def _link_buckets(words64: int, radius: int, most: int):
    """Arrow function over rows sorted by bucket: links; fingerprints of buckets above ``most`` rows are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = 0
        for table, hot in keyed_runs(batches, "bucket", most):
            fp, keys = _names(table, words64), table.column("bucket").to_numpy()
            if hot:
                parts += 1
                names = _hex_rows(fp)
                yield pa.RecordBatch.from_pydict({"a": names, "b": [None] * len(names), "bucket": keys, "part": np.full(len(names), parts, np.int32), "parts": np.zeros(len(names), np.int32)},
                                                 schema=pa.schema([("a", pa.string()), ("b", pa.string()), ("bucket", pa.int64()), ("part", pa.int32()), ("parts", pa.int32())]))
                continue
            at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            size = np.diff(np.append(at, len(keys)))
            sizes = np.repeat(size, size)
            small = np.where(sizes <= SMALL, sizes, 0)
            a, b = _small_links(keys, small, fp, radius)
            pairs = [np.stack((a, b), axis=1)]
            for start, n in zip(at[size > SMALL].tolist(), size[size > SMALL].tolist()):
                if found := bucket_links(fp[start:start + n], radius):
                    pairs.append(np.array(found, np.int64) + start)
            both = np.concatenate(pairs)
            if len(both):
                n = len(both)
                yield pa.RecordBatch.from_pydict({"a": _hex_rows(fp[both[:, 0]]), "b": _hex_rows(fp[both[:, 1]]), "bucket": np.zeros(n, np.int64), "part": np.zeros(n, np.int32), "parts": np.zeros(n, np.int32)},
                                                 schema=pa.schema([("a", pa.string()), ("b", pa.string()), ("bucket", pa.int64()), ("part", pa.int32()), ("parts", pa.int32())]))
    return run


def _deal(words64: int, radius: int, bands: int | None, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                fp = _unhex(batch.column(0).slice(at, 2048), words64)
                keys = bucket_keys(fp, radius, bands, width)
                rows = np.repeat(fp, keys.shape[1], axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1))] + [pa.array(rows[:, i]) for i in range(words64)],
                                                 names=["bucket"] + [f"w{i}" for i in range(words64)])
    return run


def links(distinct: DataFrame, radius: int, words64: int = 1, bands: int | None = None, width: int = 18, most: int = MOST) -> DataFrame:
    """Links (a, b) between fingerprints of a one-column table of distinct ones, spanning the groups of every bucket."""
    schema = ", ".join(["bucket long", *(f"w{i} long" for i in range(words64))])
    dealt = distinct.mapInArrow(_deal(words64, radius, bands, width), schema)
    step = _link_buckets(words64, radius, most)
    # In the order of fingerprints, so that buckets that share a group link to the same member.
    order = ["bucket", *(f"w{i}" for i in range(words64))]
    first = saved(dealt.repartition("bucket").sortWithinPartitions(*order).mapInArrow(step, LINK), "links")
    done = first.where("b IS NOT NULL").select("a", "b")
    aside = first.where("b IS NULL").select("a", "bucket")
    # The triangle: a fingerprint of part i of a large bucket goes to the cells (i, j) and (j, i).
    sizes = aside.groupBy("bucket").agg(F.ceil(F.count("*") / (most // 4)).cast("int").alias("n"))
    part = F.pmod(F.xxhash64("a"), "n").cast("int")
    cells = aside.join(sizes, "bucket").withColumn("i", part).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cell = F.xxhash64("bucket", F.least("i", "j"), F.greatest("i", "j"))
    words = [F.conv(F.substring("a", 16 * i + 1, 16), 16, -10).cast("long").alias(f"w{i}") for i in range(words64)]
    rest = cells.select(cell.alias("bucket"), *words).repartition("bucket").sortWithinPartitions(*order).mapInArrow(_link_buckets(words64, radius, 4 * most), LINK)
    return done.unionByName(rest.select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """Least member of each node's connected component: (node, label), for nodes that have an edge.

    In each round every node goes to its least neighbour, or to where that one goes, and
    the edges are contracted accordingly: those inside a group vanish, so that the next round sees few. The
    rounds' maps are put together from the last, smallest one back.
    """
    e = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    maps = []
    while not e.isEmpty():
        near = e.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("near")))
        up = near.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("label"))
        for _ in range(2):
            far = up.select(F.col("node").alias("label"), F.col("label").alias("far"))
            up = saved(up.join(far, "label").select("node", F.col("far").alias("label")), "labels")
        maps.append(up)
        to_a = up.select(F.col("node").alias("a"), F.col("label").alias("a1"))
        to_b = up.select(F.col("node").alias("b"), F.col("label").alias("b1"))
        moved = e.join(to_a, "a").join(to_b, "b").where("a1 <> b1")
        e = saved(moved.select(F.least("a1", "b1").alias("a"), F.greatest("a1", "b1").alias("b")).distinct(), "edges")
    found = None
    for up in reversed(maps):
        if found is None:
            found = up
            continue
        last = found.select(F.col("node").alias("label"), F.col("label").alias("final"))
        found = up.join(last, "label", "left").select("node", F.coalesce("final", "label").alias("label"))
    return found if found is not None else e.select(F.col("a").alias("node"), F.col("b").alias("label"))


def groups(rows: DataFrame, radius: int, words64: int = 1, bands: int | None = None, width: int = 18, most: int = MOST) -> DataFrame:
    """(fingerprint, component): for a table (id, fingerprint) the least id of each fingerprint's group."""
    least = saved(rows.groupBy("fingerprint").agg(F.min("id").alias("least")), "fingerprints")
    found = components(links(least.select("fingerprint"), radius, words64, bands, width, most))
    named = least.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("label", F.coalesce("label", "fingerprint"))
    top = named.groupBy("label").agg(F.min("least").alias("component"))
    return named.join(top, "label").select("fingerprint", "component")


def simhash_groups(docs: DataFrame, k: int = 3, radius: int = 2, words64: int = 1, repeats: bool = True, bands: int | None = None, width: int = 18,
                   id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """Fingerprint and group of every document: (id_col, fingerprint, component_id).

    A null text counts as empty; texts without words have fingerprint zero and link like
    any other. Repeated rows give repeated rows. A group's name is its least id (null only
    if all its ids are). Other columns are left out; an empty table gives no rows.
    """
    rows = saved(docs.select(F.col(id_col).alias("id"), fingerprints(text_bytes(text_col), k, words64, repeats).alias("fingerprint")), "simhash")
    found = groups(rows, radius, words64, bands, width, most)
    return rows.join(found, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", F.col("component").alias("component_id"))


def drop_near_copies(docs: DataFrame, k: int = 5, words64: int = 4, radius: int = 44, bands: int | None = 96, width: int = 18,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with one of each near-duplicate group: the one with the least id, then text.

    The defaults stand for a similarity of 0.8 on sets of five-word shingles: such sets
    meet at an angle of 27.3 degrees, which is 38.6 of 256 bits, with a deviation of 5.7;
    the radius adds one deviation. Such pairs share a bucket with a chance of 99.4 %, pairs at
    the radius with 96 %. All columns stay, whatever their names. Documents without
    words are not near copies of one another unless their texts are equal; one of each is kept.
    """
    names = docs.columns
    row = docs.select(F.struct(*names).alias("row")).select("row", F.col(f"row.{id_col}").alias("id"), F.coalesce(f"row.{text_col}", F.lit("")).alias("text"))
    mark = row.select("row", "id", F.xxhash64("id", "text").alias("mark"), fingerprints(text_bytes("text"), k, words64, False).alias("fp"), "text")
    rows = saved(mark.select("id", "mark", F.when(F.col("fp") == "0" * 16 * words64, F.sha2("text", 256).substr(1, 16 * words64)).otherwise(F.col("fp")).alias("fingerprint")), "simhash")
    found = groups(rows, radius, words64, bands, width)
    best = rows.join(found, "fingerprint").groupBy("component", "fingerprint").agg(F.min(F.struct("id", "mark")).alias("one"))
    best = best.groupBy("component").agg(F.min("one").alias("one")).select("one.id", "one.mark", F.lit(True).alias("keep"))
    same = rows.groupBy("id", "mark").agg(F.count("*").alias("n"))
    best = best.alias("b").join(same.alias("s"), F.col("b.id").eqNullSafe(F.col("s.id")) & (F.col("b.mark") == F.col("s.mark"))).select("b.id", "b.mark", "s.n")
    kept = row.withColumn("mark", F.xxhash64("id", "text")).alias("r").join(best.alias("b"), (F.col("r.mark") == F.col("b.mark")) & F.col("r.id").eqNullSafe(F.col("b.id"))).select("r.row", "r.mark", "b.n")
    one = kept.where("n = 1").select("row.*")
    # Repeated rows: only these few meet once more.
    rest = kept.where("n > 1").groupBy("row.%s" % id_col, "mark").agg(F.first("row").alias("row")).select("row.*")
    return one.unionByName(rest)
