"""Mixing: targets, sampling by the definition, and the SQL on small tables."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from recordflow.llm import mixing as M, queries

WEIGHTS = (5, 2, 1)


def fill(sizes, share=1.5, cap=2):
    """Targets by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    budget, stopped = share * sum(sizes.values()), set()
    while True:
        rest = budget - sum(cap * sizes[s] for s in stopped)
        total = sum(weight[s] for s in sizes if s not in stopped)
        over = {s for s in sizes if s not in stopped and rest * weight[s] / total > cap * sizes[s] * (1 + 1e-12)}
        if not over:
            return {s: cap * sizes[s] if s in stopped else rest * weight[s] / total for s in sizes}
        stopped |= over


def docs_of(n, sources, seed):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * int(rng.lognormvariate(3, 1))), rng.choice(sources)) for i in range(n)]


def by_definition(docs):
    size = {i: len(t.split()) for i, t, _ in docs}
    sizes = {}
    for i, _, s in docs:
        sizes[s] = sizes.get(s, 0) + size[i]
    target, out = fill(sizes), {}
    for s in sizes:
        own = [i for i, _, x in docs if x == s and size[i]]
        want = target[s] / sizes[s] if sizes[s] else 0
        sure, p = int(want), want - int(want)
        need = target[s] - sure * sizes[s]
        u = {i: (int(hashlib.md5(f"42|{i}".encode()).hexdigest()[:13], 16) + .5) / 2 ** 52 for i in own}
        order = sorted(own, key=lambda i: (u[i] / (1 - u[i]), i)) if p else []
        drawn, words = set(), 0
        for _ in range(4):
            start = need - words
            for i in [i for i in order if i not in drawn and size[i] <= start]:
                if words + size[i] > need:
                    break
                drawn.add(i)
                words += size[i]
        rest = [i for i in order if i not in drawn and sure < 2 and abs(need - words - size[i]) < need - words]
        if rest:
            drawn.add(min(rest, key=lambda i: (abs(need - words - size[i]), u[i] / (1 - u[i]), i)))
        out |= {i: (sure + (i in drawn)) * size[i] for i in own}
    return {i: out.get(i, 0) for i in size}, target


@pytest.mark.parametrize("n,sources", [(400, ["a", "b", "c", "d", "é", "Z"]), (300, ["hot"] * 20 + ["b", None]), (5, ["a"]), (60, ["a", "b"])])
def test_mix(spark, n, sources):
    docs = docs_of(n, sources, n)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = M.mix(df).collect()
    taken, target = by_definition(docs)
    assert {r["doc_id"]: r["taken"] for r in got} == taken
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["taken"] <= 2 * r["size"]
    assert sorted(map(str, got)) == sorted(map(str, M.mix(df).collect()))


def test_words_come_near_targets(spark):
    docs = docs_of(3000, ["a", "b", "c", "d"], 1)
    got = M.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()
    assert all(abs(r["t"] - r["w"]) <= .002 * r["w"] for r in got)


def test_large_documents_leave_no_gap(spark):
    """One document holds 60 % of a source's words: whatever its rank, small ones fill what is open."""
    rng = random.Random(8)
    docs = [(0, "w " * 156_000, "a")] + [(i, "w " * 20, "a") for i in range(1, 5200)] + [(10_000 + i, "w " * int(rng.lognormvariate(5, 1.5)), "b") for i in range(1500)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for seed in range(2):
        got = M.mix(rows, seed=seed).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()
        assert all(abs(r["t"] - r["w"]) <= 20 for r in got), (seed, got)


def test_scores_raise_inclusion(spark):
    """With scores, wanted copies go with the score, whole ones are certain and none is above the cap."""
    docs = [(i, "w " * 10, "ab"[i % 2], [0.0, 1.0, 2.0, 40.0][i % 4 if i % 2 else 1]) for i in range(2000)]
    got = M.mix(spark.createDataFrame(docs, "doc_id long, text string, source string, score double"), weight=F.lit(1), share=1.5, score_col="score").collect()
    copies = {r["doc_id"]: r["copies"] for r in got}
    mean = lambda k: sum(copies[d[0]] for d in docs if d[2] == "b" and d[3] == k) / max(1, sum(1 for d in docs if d[2] == "b" and d[3] == k))
    assert mean(40.0) == 2 and mean(1.0) < mean(40.0) and max(copies.values()) <= 2
    for s in "ab":
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - next(r["target"] for r in got if r["source"] == s)) <= 10


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", "a"), (3, "x y", "a"), (None, "x y z", None), (4, "w " * 30_000, "b"), (5, " \n", "c")]
    docs = spark.createDataFrame([(*r, 9, "q") for r in rows], "doc_id long, text string, source string, size int, copies string")
    got = M.mix(docs).collect()
    assert len(got) == 7 and all(r["taken"] <= 2 * r["size"] for r in got) and {r["size"] for r in got} == {0, 2, 3, 30_000}
    mixed = M.mixed_rows(docs)
    assert mixed.columns == docs.columns
    counts = {}
    for r in mixed.collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + len((r["text"] or "").split())
    want = {}
    for r in got:
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    assert counts == {k: v for k, v in want.items() if v}
    assert M.mix(docs.limit(0)).collect() == [] and M.mixed_rows(docs.limit(0)).collect() == []


def test_sql(spark, tmp_path):
    docs = docs_of(500, ["a", "b", "c", "d", "e"], 9)
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(queries.SQL["op9_mixing"]).fetchall()
    got = queries.QUERIES["op9_mixing"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
