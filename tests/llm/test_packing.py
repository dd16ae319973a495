"""Packing: token ids, bounds and the layout of sequences."""

import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from recordflow.llm import packing as P, queries

SF = "/root/testdata/sf0.001"
TEXTS = ["", " ", "Hello  world\n\n", "naïve café ß 你好 🙂👍🏽", "<|endoftext|> inside", "I'll we've don't 'S", "a" * 5000, "  x​y", " " * 300, "1234567 x²³ ٣٤", "\t\r\n\x0b\x0c z", "é" * 700]


@pytest.fixture(scope="module")
def own():
    t = Tokenizer.from_file(P.vocabulary_path())
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids(own, spark):
    encode = P.encoder(P.vocabulary_path())
    for text in TEXTS + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]:
        assert encode(text) == own(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    t = Tokenizer.from_file(P.vocabulary_path()) if not hasattr(test_ids_of_any_text, "t") else test_ids_of_any_text.t
    test_ids_of_any_text.t = t
    assert P.encoder(P.vocabulary_path())(text) == t.encode(text, add_special_tokens=False).ids


def fewest(lengths, size):
    """Fewest bins by search."""
    best = [len(lengths)]

    def go(i, free):
        if len(free) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(free)
            return
        for f in {f for f in free if f >= lengths[i]}:
            j = free.index(f)
            go(i + 1, free[:j] + [f - lengths[i]] + free[j + 1:])
        go(i + 1, free + [size - lengths[i]])
    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bound_and_best_fit(lengths):
    lengths = sorted(lengths, reverse=True)
    bins, offsets, free = P.best_fit(np.array(lengths, np.int64), 20)
    bound = P.lower_bound(np.bincount(np.array(lengths, np.int64), minlength=21), 20)
    assert bound <= fewest(lengths, 20) <= len(free)
    for b in range(len(free)):
        at = 0
        for o, n in sorted((o, n) for o, n, x in zip(offsets, lengths, bins) if x == b):
            assert o == at
            at += n
        assert at + free[b] == 20


def laid_out(rows, ids_of, size=1024):
    """Checks the layout of pieces (id, piece, start, length, crc, sequence, offset) and returns the number of sequences."""
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for parts in by_sequence.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
    for doc, parts in by_doc.items():
        for ids in ids_of[doc]:
            pass
        want = sorted((i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for ids in ids_of[doc] for i, (a, b) in enumerate(edges(len(ids), size)))
        assert sorted((p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in parts) == want
    assert by_doc.keys() == ids_of.keys()
    return len(by_sequence)


def edges(n, size):
    first = n if n <= size else n % size or size
    e = [0, *range(first, n + 1, size)]
    return list(zip(e, e[1:]))


def test_query(spark, own):
    ids = {r["doc_id"]: [[*own(r["text"] or ""), 2]] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op2_packing"](spark, SF).collect()
    n = laid_out(rows, ids)
    assert n <= 1.01 * math.ceil(sum(r["length"] for r in rows) / 1024) + 1


def test_exchange(spark):
    """Small partitions leave gaps; exchanges close them to the bound."""
    rng = random.Random(4)
    lengths = [min(64, max(1, int(rng.gauss(20, 12)))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(lengths)), "n long, length long")
    placed, proof = P.pack_lengths(rows, 64, partition=60)
    got = placed.join(rows, "n").collect()
    assert len(got) == 3000 and len({r["sequence_id"] for r in got}) == proof["bins"]
    free = {}
    for r in got:
        free.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in free.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert proof["bound"] <= proof["bins"] <= proof["bound"] + 1


def test_edges(spark, own):
    texts = [(1, None), (2, ""), (3, "word " * 6000), (4, "same"), (4, "same"), (None, "x")]
    docs = spark.createDataFrame([(*t, 1, 2) for t in texts], "doc_id long, text string, piece int, n int")
    ids = {}
    for i, t in texts:
        ids.setdefault(i, []).append([*own(t or ""), 2])
    laid_out(P.pack(docs)[0].collect(), ids)
    out, proof = P.pack(docs.limit(0))
    assert out.collect() == [] and proof["bins"] == 0


@pytest.mark.parametrize("text", [" " * 1_200_000 + "a", "\n" * 2_000_000 + "b", "a" * 300_000, "x<|endoftext|> y<|endoftext|>", "<|endoftext", "a " * 500_000])
def test_long_runs_and_markers(own, text):
    """Where the fast library gives up the file's own takes over; an added token in a text is one id."""
    got = P.encoder(P.vocabulary_path())(text)
    assert got == own(text) and (got.count(50256) == text.count("<|endoftext|>"))
