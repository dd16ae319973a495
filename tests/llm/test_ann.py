"""Neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordflow.llm import ann as A, queries

SF = "/root/testdata/sf0.001"


def brute(rows, asked, k):
    out = {}
    for q in asked:
        v = dict(rows)[q]
        found = sorted((-float((np.array(x) * np.array(v)).sum()), i) for i, x in rows if i != q)[:k]
        out[q] = [(i, -s) for s, i in found]
    return out


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r[0], []).append((r[2], r[3]))
        assert r[1] == len(out[r[0]])
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_query(spark):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    got = result(queries.QUERIES["op4_neighbours"](spark, SF))
    assert recall(got, want) >= .95
    for q, w in want.items():
        score = dict(brute(rows, [q], len(rows))[q])
        assert len(got[q]) == 20 and all(s == pytest.approx(score[i], abs=1e-12) for i, s in got[q])


def test_cells_blocks_and_lengths(spark):
    """Several cells and parts, vectors of many lengths."""
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((6, 24))
    rows = [(i, (centre[i % 6] * (1 + i % 3) + .3 * rng.standard_normal(24)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, range(0, 1500, 20), 10)
    got = result(A.nearest(df, F.col("id") % 20 == 0, k=10, block=100))
    assert recall(got, want) >= .9


def test_equal_vectors(spark):
    """A third of all rows is one vector: ties go to the smaller ids, and nothing is lost."""
    rng = np.random.default_rng(2)
    hot = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, hot if i % 3 == 0 else rng.standard_normal(4).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = result(A.nearest(df, F.col("id") % 20 == 0, k=7, block=100))
    want = brute(rows, range(0, 600, 20), 7)
    assert recall(got, want) >= .95
    assert [i for i, _ in got[0]] == [3, 6, 9, 12, 15, 18, 21] and [i for i, _ in got[60]] == [0, 3, 6, 9, 12, 15, 18]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, None]), (6, [2.0, 0.0]), (6, [2.0, 0.0]), (7, [-1.0, 1.0]), (None, [9.0, 9.0]), (8, [1.0]), (9, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, name string, hash int")
    got = result(A.nearest(df, F.lit(True), k=20))
    assert got == {0: [(6, 2.0), (7, -1.0)], 6: [(0, 2.0), (7, -2.0)], 7: [(0, -1.0), (6, -2.0)]}
    assert result(A.nearest(df, F.col("id") == 77, k=3)) == {} and result(A.nearest(df.limit(0), F.lit(True))) == {}


@pytest.mark.parametrize("p,m,x", [(.95, 1, 3.841459), (.9, 8, 13.361566), (.97, 16, 28.1907), (.5, 2, 1.386294)])
def test_chi_square(p, m, x):
    assert A.chi2_quantile(p, m) == pytest.approx(x, rel=1e-3)


def test_tree():
    points = np.random.default_rng(0).standard_normal((500, 5))
    points[:100] = points[0]
    leaves = A.kd_split(points, 16)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(500)) and max(map(len, leaves)) <= 16
    nodes = A.kd_top(points, 8)
    cells = A.cell_of(nodes, points)
    assert set(cells.tolist()) <= set(range(8)) and len(set(cells[:100].tolist())) == 1
