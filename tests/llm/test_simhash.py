"""SimHash groups against all pairs."""

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from recordflow.llm import queries, simhash as S
from recordflow.llm.common import keyed_runs

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text, k=3):
    words = text.lower().split()
    grams = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(pairs, nodes):
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n
    for a, b in pairs:
        top[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def all_pairs(rows, radius):
    """rows: (id, fingerprint int) -> least id of the group of each row."""
    by = {}
    for i, f in rows:
        by.setdefault(f, []).append(i)
    fps = list(by)
    joined = union([(x, y) for n, x in enumerate(fps) for y in fps[:n] if (x ^ y).bit_count() <= radius], fps)
    least = {}
    for f, t in joined.items():
        ids = [i for i in by[f] if i is not None]
        if ids:
            least[t] = min(least.get(t, min(ids)), min(ids))
    return {(i, f): least.get(joined[f]) for i, f in rows}


@pytest.mark.parametrize("text", [b"", b"one", b"One  two", b"a b c", b"a b c a b c a b c", "Éa b c D\ne f".encode(), b"x y z " * 5000, b" \t\n"])
def test_fingerprint(text):
    assert int(S.fingerprint(text, 3)[0]) == slow_fingerprint(text)


def test_counts_many_words():
    h = np.random.default_rng(1).integers(0, 1 << 63, (1001, 3)).astype(np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(1001, 3, 8), axis=2, bitorder="little").reshape(1001, 3, 64)
    assert (S._counts(h) == bits.sum(0)).all()


@pytest.mark.parametrize("radius,words", [(0, 1), (2, 1), (7, 2), (44, 4)])
def test_within(radius, words):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, words).astype(np.uint64)
    rows = np.repeat(base[None], 77, axis=0)
    for i in range(77):
        for b in rng.choice(64 * words, min(i % (2 * radius + 3), 64 * words), replace=False):
            rows[i, b // 64] ^= np.uint64(1 << (int(b) % 64))
    want = np.bitwise_count(rows ^ base).sum(1) <= radius
    assert (S.within(S.planes_of(rows), 77, base, radius) == want).all()


def test_keyed_runs_keep_runs_whole():
    keys = np.repeat(np.arange(9), [3, 1, 40, 2, 2, 60, 1, 1, 5])
    batches = [pa.record_batch({"key": keys[i:i + 7], "v": np.arange(i, min(i + 7, len(keys)))}) for i in range(0, len(keys), 7)]
    seen, hot = [], set()
    for table, is_hot in keyed_runs(iter(batches), "key", 20):
        got = table.column("key").to_pylist()
        seen += table.column("v").to_pylist()
        if is_hot:
            hot |= set(got)
        else:
            assert all(got.count(k) == (keys == k).sum() for k in set(got))
    assert sorted(seen) == list(range(len(keys))) and hot == {2, 5}


def noisy(n, seed, words=1, spread=3):
    rng = np.random.default_rng(seed)
    centres = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    out = []
    for i in range(n):
        f = centres[int(rng.integers(len(centres)))] if i % 3 else int(rng.integers(0, 1 << 63))
        for b in rng.choice(64, int(rng.integers(spread)), replace=False):
            f ^= 1 << int(b)
        out.append((i, f))
    return out


@pytest.mark.parametrize("most", [20_000, 40])
def test_groups_against_all_pairs(spark, most):
    rows = noisy(600, 5)
    df = spark.createDataFrame([(i, f"{f:016x}") for i, f in rows], "id long, fingerprint string")
    got = {r["fingerprint"]: r["component"] for r in S.groups(df, 2, most=most).collect()}
    want = all_pairs(rows, 2)
    assert all(got[f"{f:016x}"] == want[i, f] for i, f in rows)


def test_large_bucket_is_cut(spark):
    """Fingerprints that share half their bits land in one bucket above ``most``; no link is lost."""
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 1 << 20))) for i in range(500)]
    df = spark.createDataFrame([(i, f"{f:016x}") for i, f in rows], "id long, fingerprint string")
    got = {r["fingerprint"]: r["component"] for r in S.groups(df, 2, most=64).collect()}
    want = all_pairs(rows, 2)
    assert all(got[f"{f:016x}"] == want[i, f] for i, f in rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b c d"), (3, "a b c d"), (None, "A  B c\nd"), (4, "z " * 50_000), (5, "only"), (None, "alone here now then")]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, fingerprint string, component long, id int")
    got = sorted(S.simhash_groups(docs).collect(), key=str)
    want = all_pairs([(i, slow_fingerprint((t or "").encode())) for i, t in rows], 2)
    assert sorted((r[0], int(r[1], 16), r[2]) for r in got if r[0] is not None) == sorted((i, f, c) for (i, f), c in want.items() for _ in range(2 if i == 3 else 1) if i is not None)
    assert {(int(r[1], 16), r[2]) for r in got if r[0] is None} == {(f, c) for (i, f), c in want.items() if i is None}
    assert S.simhash_groups(docs.limit(0)).collect() == []


def test_query_against_all_pairs(spark):
    docs = [(r["doc_id"], slow_fingerprint((r["text"] or "").encode())) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = all_pairs(docs, 2)
    got = queries.QUERIES["op5_simhash"](spark, SF).collect()
    assert sorted((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in got) == sorted((i, f, c) for (i, f), c in want.items())


def sets(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_drop_near_copies(spark):
    rng = np.random.default_rng(11)
    vocabulary = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(3000)]
    base = [" ".join(rng.choice(vocabulary, 400)) for _ in range(40)]
    rows, n = [], 0
    for t in base:
        rows.append((n, t)); n += 1
        for edits in (0, 1, 4):
            w = t.split()
            for at in rng.choice(400, edits, replace=False):
                w[at] = "changed"
            rows.append((n, " ".join(w))); n += 1
    rows += [(1000, None), (1001, ""), (1002, " "), (0, rows[0][1])]
    assert all(len(sets(a) & sets(b)) / len(sets(a) | sets(b)) > 0.85 for (i, a), (j, b) in zip(rows[0:160:4], rows[3:160:4]))
    docs = spark.createDataFrame([(i, t, "k", i) for i, t in rows], "doc_id long, text string, row string, component long")
    got = S.drop_near_copies(docs)
    assert got.columns == docs.columns
    kept = sorted(r["doc_id"] for r in got.collect())
    assert kept == [*range(0, 160, 4), 1000, 1002]  # null and empty texts are equal, a blank one is another
    assert S.drop_near_copies(docs.limit(0)).collect() == []
