"""The manifest against a plain recursion, and its proofs against tampering."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from recordflow.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, level int, tree string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    i, s, y, n, t = row
    if lower and t is not None:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, y, n, t)))


def climb(nodes):
    """Root of digests and each one's siblings before and after, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in zip(at, paths):
            run = nodes[k // 8 * 8:k // 8 * 8 + 8]
            p.append(("".join(run[:k % 8]), "".join(run[k % 8 + 1:])))
        nodes = [sha("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
        at = [k // 8 for k in at]
    return nodes[0], paths


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda y: (y is not None, (y or "").encode()))
    trees = {}
    for y in langs:
        mine = sorted((r for r in rows if r[2] == y), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[y] = (mine, *climb([leaf(r) for r in mine]))
    root, tops = climb([trees[y][1] for y in langs])
    out = []
    for y, top in zip(langs, tops):
        mine, subroot, paths = trees[y]
        for r, path in zip(mine, paths):
            whole = path + top
            folded = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for before, after in whole:
                folded = sha(before + folded + after)
            out.append((r[0], leaf(r), subroot, root, sha("".join(b + a for b, a in whole)), folded, folded == root))
    return sorted(out, key=repr)


def made(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = M.manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513])
def test_sizes(spark, n):
    rows = [(i * 3, "s", "en", i, f"Text {i}") for i in range(n)]
    got = made(spark, rows)
    assert got == plain(rows)
    assert {r[0] for r in got if r[6]} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 3}


def test_many_groups_and_odd_rows(spark):
    rows = [(i, f"s{i % 3}", f"l{i % 11}", i, f"Ünï {i} ABC" * (i % 5)) for i in range(200)]
    rows += [(None, None, None, None, None)] * 3 + [(5, "s", "en", 1, "A")] * 20 + [(5, "s", "en", 1, "B"), (6, "s", "", 1, ""), (7, None, "é", None, "no capital"), (-9, "s", "en", 0, "Z" * 300_000)]
    assert made(spark, rows) == plain(rows)


def test_more_groups_than_one_level(spark):
    rows = [(i, "s", f"g{i % 70:03}", i, "T") for i in range(150)]
    assert made(spark, rows) == plain(rows)


def test_empty(spark):
    assert made(spark, []) == []


def test_hot_copies_are_spread(spark):
    """A third of all rows alike: the ordered leaves still lie in even partitions."""
    rows = [(7, "s", "en", 1, "same")] * 1000 + [(i, "s", "en", 1, "x") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    at = M.placed(docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("id"), F.unhex(F.sha2("text", 256)).alias("digest"), F.lit(None).cast("binary").alias("start")))
    assert sorted(r[0] for r in at.select("idx").collect()) == list(range(3000))
    limit = spark.conf.get(M.ROW_LIMIT)
    assert made(spark, rows) == plain(rows)
    assert spark.conf.get(M.ROW_LIMIT) == limit
