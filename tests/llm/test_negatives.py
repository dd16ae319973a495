"""Hard negatives against a plain version."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordflow.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, key int"


def plain(rows, k=5):
    rows = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    seen, out = set(), []
    for i, v, y in rows:
        if i % 100 or (i, tuple(v), y) in seen:
            continue
        seen.add((i, tuple(v), y))
        others = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in rows if j != i and len(w) == len(v))
        for s, j, _ in [o for o in others if o[2] == y][:k]:
            fit = [(-t, n) for t, n, z in others if z != y and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(i, j, r, n, -s, t) for r, (t, n) in enumerate(fit[:k], 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(map(tuple, N.mine(df, F.col("vec_id") % 100 == 0).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain(spark, seed, monkeypatch):
    """Few values, so that scores tie; small cells, so that anchors meet rows in many of them."""
    r = random.Random(seed)
    rows = [(i * 10, [r.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(4)], r.randrange(3)) for i in range(-40, 160)]
    rows += [(7, [0.5] * 4, 1)] * 12 + [(200, [1.0, 0.5], 0), (3, [1.0, 0.25], 0), (4, [0.9, 0.5], 1)]
    monkeypatch.setattr(N, "CHUNK", 8)
    monkeypatch.setattr(N, "BLOCK", 50)
    got = mined(spark, rows)
    assert got == plain(rows) and len(got) > 100


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (1, [0.9, 0.1], 2), (2, [0.95, nan], 2), (3, [inf, 0.0], 2), (4, [0.9, None], 2), (5, None, 2),
            (6, [0.9, 0.1], None), (None, [0.9, 0.1], 2), (300, [], 1), (8, [], 1), (9, [], 2), (400, [-1.0, 0.0], 1), (10, [1e30, 0.0], 2), (500, [0.0, 0.0], 7)]
    assert mined(spark, rows) == plain([r for r in rows if r[0] not in (None, 10)])
    assert mined(spark, []) == []


def test_hot_label_and_copies(spark, monkeypatch):
    """A third of all rows are copies of one row: no block emits more than its share, nothing is lost."""
    rows = [(i, [1.0, 0.5], 1) for i in range(100)] + [(200 + i, [1.0, 0.5 + i / 256], i % 2) for i in range(200)]
    monkeypatch.setattr(N, "BLOCK", 64)
    assert mined(spark, rows) == plain(rows)


def test_cells_emit_only_what_can_win():
    n = 5000
    rows = pa.table({"id": list(range(n)), "label": [i % 2 for i in range(n)], "vector": [[1.0, 1.0]] * n})
    anchor = pa.table({"id": [-1], "variant": [0], "label": [0], "vector": [[1.0, 1.0]], "opened": [[131072, 131072]]})
    assert [N.unpack(k.as_py())[3] for k in N.best_of_label(anchor, rows).column("key")] == [0, 2, 4, 6, 8]
    assert [N.unpack(k.as_py())[3] for k in N.first_in_windows(anchor, rows).column("key")] == [1, 3, 5, 7, 9]


def test_keys_sort_as_the_ranking():
    r = random.Random(3)
    rows = [(r.randrange(-3, 3), 0, r.randrange(-4, 4) * 10 ** 15, r.randrange(-5, 5)) for _ in range(300)]
    keys = N.pack(*[np.array(c, dtype="int64") for c in zip(*rows)], True).to_pylist()
    assert [N.unpack(k)[:4] for k in keys] == rows
    assert [N.unpack(k)[:4] for k in sorted(keys)] == sorted(rows, key=lambda x: (x[0], x[1], -x[2], x[3]))


def test_scores_beyond_doubles(spark):
    """Whole sums over 2**53 stay exact."""
    rows = [(0, [400_000.0, 3.0], 1), (1, [400_000.0, 3.0], 1), (2, [399_999.5, 2.0], 2), (3, [390_000.25, 1.0], 2)]
    assert mined(spark, rows) == plain(rows) != []
