"""The pipeline's stages and its whole against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from recordflow.llm import packing, pii, quality, simhash

from test_mixing import by_definition
from test_packing import laid_out
from test_quality import slow
from test_simhash import union

SF = "/root/testdata/sf0.001"
TEXTS = [(1, None), (2, ""), (3, "x"), (4, "call +1 (555) 555-5657 or jo@example.com " * 6 + " ".join(f"u{i}" for i in range(30))), (4, "call +1 (555) 555-5657 or jo@example.com " * 6 + " ".join(f"u{i}" for i in range(30))),
         (None, " ".join(f"n{i}" for i in range(50))), (5, " ".join(f"v{i}" for i in range(9000)))]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The smallest documents with awkward rows among them."""
    d = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(None if i is None else 100_000 + i, t, "en", "src1", 0) for i, t in TEXTS], docs.schema)
    docs.unionByName(more).coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{d}/labels.parquet")
    return str(d)


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def near(docs, radius=44):
    """One row of each group, by all pairs of fingerprints."""
    fp = {}
    for r in docs:
        f = simhash.fingerprint((r[1] or "").encode(), 5, 4, False)
        fp.setdefault(tuple(f.tolist()) if f.any() else ("text", r[1] or ""), []).append(r)
    real = [k for k in fp if k[0] != "text"]
    a = np.array(real, np.uint64)
    pairs = [(k, real[j]) for i, k in enumerate(real) for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]).sum(1) <= radius)]
    joined = union(pairs, real) | {k: k for k in fp if k[0] == "text"}
    groups = {}
    for k, rows in fp.items():
        groups.setdefault(joined[k], []).extend(rows)
    return [min(g, key=lambda r: (r[0] is not None, r[0] or 0)) for g in groups.values()]


def test_stages(spark, tables):
    docs = rows_of(spark.read.parquet(f"{tables}/documents.parquet"))
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    step = spark.read.parquet(f"{tables}/documents.parquet")
    key = lambda r: tuple(str(x) for x in r)

    step = C.STAGES[0][1](spark, step, tables).cache()
    figures = [slow(r[1]) for r in docs]
    want = [r for r, n in zip(docs, figures) if n[0] >= 20 and 100 * n[4] <= 30 * n[0]]  # too few labels for a cut
    assert step.columns == names and sorted(rows_of(step), key=key) == sorted(want, key=key)

    step = C.STAGES[1][1](spark, step, tables).cache()
    before, want = want, near(want)
    got = rows_of(step)
    assert step.columns == names and {key(r) for r in want} <= {key(r) for r in got} <= {key(r) for r in before}
    # What buckets may miss lies between the similarity asked for (39 bits) and the radius.
    assert {key(r) for r in got} <= {key(r) for r in near(before, 39)} and len(got) <= 1.02 * len(want)
    want = got

    step = C.STAGES[2][1](spark, step, tables).cache()
    work = pii.Pseudonyms(pii.DEMO_KEY)
    want = [(r[0], t := work.rewrite(r[1].encode())[0].decode(), r[2], r[3], len(t)) for r in want]
    assert step.columns == names and sorted(rows_of(step), key=key) == sorted(want, key=key)

    step = C.STAGES[3][1](spark, step, tables).cache()
    taken, _ = by_definition([(r[0], r[1], r[3]) for r in want])
    copies = [r for r in want for _ in range(taken[r[0]] // len(r[1].split()))]
    assert step.columns == names and sorted(rows_of(step), key=key) == sorted(copies, key=key)

    own = Tokenizer.from_file(packing.vocabulary_path())
    own.encode_special_tokens = True
    out = C.STAGES[4][1](spark, step, tables).collect()
    ids = {}
    for r in copies:
        ids.setdefault(r[0], []).append([*own.encode(r[1], add_special_tokens=False).ids, 2])
    sequences = laid_out(out, ids)
    total = sum(len(i) for d in ids.values() for i in d)
    assert sequences <= 1.01 * total / 1024 + 2

    whole = C.run(spark, tables).collect()
    key = lambda r: (str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, out))


def test_empty(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for name, stage in C.STAGES:
        assert stage(spark, docs, tables).collect() == []


def test_extra_columns_stay(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumns({c: F.lit(1) for c in ("id", "row", "size", "copies", "fingerprint", "stratum", "bins", "mark", "n", "p")})
    for name, stage in C.STAGES[:-1]:
        assert stage(spark, docs, tables).columns == docs.columns
        assert stage(spark, docs, tables).count() > 0
    assert quality.keep_good(docs, spark.read.parquet(f"{tables}/labels.parquet")).where("id <> 1 OR row <> 1").count() == 0
