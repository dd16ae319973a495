"""Sharding by slots against a plain version."""

import hashlib
import zlib

import pytest

from recordflow.llm import queries, sharding as S
from recordflow.session import work_folder

SF = "/root/testdata/sf0.001"


def plain(docs, shards=16, slots=4096):
    rows = [(i, t or "", int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16) % slots) for i, t in docs]
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t.encode()) + 1
    load, where = [0] * shards, {}
    for s in sorted(size, key=lambda s: (-size[s], s)):
        where[s] = load.index(min(load))
        load[where[s]] += size[s]
    out, at = [], [0] * shards
    for i, t, s in sorted(rows, key=lambda r: (r[2], r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode()))):
        out.append((i, len(t.encode()) + 1, zlib.crc32(t.encode()), s, where[s], at[where[s]]))
        at[where[s]] += 1
    return out


KEY = lambda r: tuple((x is not None, x or 0) for x in r)


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op3_sharding"](spark, SF).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["virtual_slot"], r["shard"], r["slot"]) for r in got) == sorted(plain(docs))
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    for s in range(16):
        places = sorted(r["slot"] for r in got if r["shard"] == s)
        assert places == list(range(len(places)))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "é" * 9), (3, "é" * 9), (None, "x"), (None, None), (4, "long " * 50_000)]
    docs = spark.createDataFrame([(*r, 5, "y") for r in rows], "doc_id long, text string, shard int, start string")
    got = S.shard(docs, work_folder(spark, "m"), shards=3).collect()
    assert sorted(map(tuple, got), key=KEY) == sorted(plain(rows, 3), key=KEY)
    assert S.shard(docs.limit(0), work_folder(spark, "m")).collect() == []


def test_versions_and_rebalancing(spark):
    sizes = {s: 100 + s % 37 for s in range(400)}
    first = S.place(sizes, 4)
    load = lambda m, n: [sum(sizes[s] for s in m if m[s] == k) for k in range(n)]
    assert max(load(first, 4)) - min(load(first, 4)) < 137
    grown = S.rebalance(first, sizes, 5)
    moved = {s for s in first if first[s] != grown[s]}
    assert max(load(grown, 5)) - min(load(grown, 5)) <= 137 and {grown[s] for s in moved} == {4} and len(moved) < 400 / 5 + 5
    sizes[7] *= 50
    again = S.rebalance(grown, sizes, 5)
    assert max(load(again, 5)) < max(load(grown, 5))
    folder = work_folder(spark, "map")
    for v, m in enumerate((first, grown), 1):
        S.write_version(spark, m, v, folder)
    assert {r["slot"]: r["shard"] for r in S.read_version(spark, folder).collect()} == grown
    assert {r["slot"]: r["shard"] for r in S.read_version(spark, folder, 1).collect()} == first


@pytest.mark.parametrize("n", [0, 1])
def test_few(n):
    assert S.place({3: 5} if n else {}, 4) == ({3: 0} if n else {})


def test_hot_ids_are_spread(spark):
    """A third of the rows without id, and one id with many equal rows: the shards stay even."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, "same" * 20 if i % 3 == 1 else f"text {i} " * 8) for i in range(18_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.shard(docs, work_folder(spark, "hot")).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=KEY) == sorted(((i, len(t) + 1, zlib.crc32(t.encode())) for i, t in rows), key=KEY)
    load, slots = [0] * 16, {}
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["virtual_slot"]] = slots.get(r["virtual_slot"], 0) + 1
    assert max(load) - min(load) < 0.02 * sum(load) / 16 and max(slots.values()) < 50
    for s in range(16):
        assert sorted(r["place"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_next_call_edits_the_map(spark):
    folder = work_folder(spark, "again")
    docs = spark.createDataFrame([(i, "x" * (50 + i % 7)) for i in range(3000)], "doc_id long, text string")
    S.shard(docs, folder)
    first = {r["slot"]: r["shard"] for r in S.read_version(spark, folder).collect()}
    more = docs.unionByName(spark.createDataFrame([(10_000 + i, "y" * 90) for i in range(500)], docs.schema))
    got = S.shard(more, folder).collect()
    second = {r["slot"]: r["shard"] for r in S.read_version(spark, folder).collect()}
    assert set(first) == set(second) == set(range(4096)) and {r["slot"]: r["shard"] for r in S.read_version(spark, folder, 1).collect()} == first
    assert sum(first[s] != second[s] for s in first) < 400 and len(got) == 3500
    assert all(r["shard"] == second[r["virtual_slot"]] for r in got)
    load = [sum(r["size"] for r in got if r["shard"] == s) for s in range(16)]
    assert max(load) - min(load) < 0.02 * sum(load) / 16
