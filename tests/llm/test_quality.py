"""Quality figures against plain counting, cuts against exact sums."""

import math
import re
from fractions import Fraction

import pytest

from recordflow.llm import quality as Q, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    words = WORD.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


TEXTS = [None, "", " \n\t", "one", "a b\na b\n\na b \n", "x y z w a b c d " * 5, "Ä#*$%&|<> é b c", "a b c d e f g h i j a b c d e f g h", "w " * 40_000, "a\r\nb\r\na\r\n"]


@pytest.mark.parametrize("text", TEXTS)
def test_figures(text):
    assert Q.text_figures((text or "").encode())[:5] == slow(text)


@pytest.mark.parametrize("k,n,p", [(0, 100, .01), (3, 50, .1), (20, 1000, .02), (5, 5, .3), (700, 2000, .36)])
def test_binomial(k, n, p):
    assert Q.binomial_cdf(k, n, p) == pytest.approx(float(sum(math.comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1))), rel=1e-9)


def test_strictest_stops_at_the_first_cut_that_fails():
    assert Q.strictest([900, 40, 5, 0, 0], 5000, .01, .01) == 2
    assert Q.strictest([900, 90, 5, 80, 0], 5000, .01, .01) == 4
    assert Q.strictest([0, 0], 20, .01, .01) is None  # too few labels


def rows(spark, texts, name="documents"):
    return spark.createDataFrame([(i, t, lang, "b", 1) for i, t, lang in texts], "doc_id long, text string, lang string, bins string, n_words int")


@pytest.fixture(scope="module")
def planted(spark):
    good = [" ".join(f"w{(i * 37 + j * 101) % 9973}" for j in range(60)) for i in range(1500)]
    bad = [" ".join(f"W{(i * 31 + j * 103) % 9973}***" for j in range(60)) for i in range(300)]
    docs = [(i, t, "en") for i, t in enumerate(good)] + [(2000 + i, t, "en") for i, t in enumerate(bad)] + [(5000, bad[0], None), (5001, good[0], None)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1500)] + [(2000 + i, 0, 0) for i in range(300)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_verdicts(spark, planted):
    docs, labels = planted
    got = {r["doc_id"]: r for r in Q.quality_verdicts(rows(spark, docs), labels, alpha=.05).collect()}
    assert all(got[i]["kept"] for i in range(1500)) and not any(got[2000 + i]["kept"] for i in range(300))
    assert got[5000]["kept"] and got[5001]["kept"]  # a stratum without labels has no cut
    kept = Q.keep_good(rows(spark, docs), labels, alpha=.05)
    assert kept.columns == ["doc_id", "text", "lang", "bins", "n_words"]
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_edges(spark, planted):
    docs = rows(spark, [(i, t, "en" if i % 2 else None) for i, t in enumerate(TEXTS)] + [(3, "one", None), (None, "one", "xx")])
    labels = planted[1]
    got = Q.quality_verdicts(docs, labels.limit(0)).collect()
    assert sorted((r["doc_id"], *[r[c] for c in Q.BASE]) for r in got if r["doc_id"] is not None) == sorted((i, *slow(t)) for i, t in [*enumerate(TEXTS), (3, "one")])
    assert all(r["kept"] == (not r["base_failed"]) for r in got)
    assert Q.quality_verdicts(docs.limit(0), labels).collect() == [] and Q.keep_good(docs.limit(0), labels).collect() == []


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op6_quality"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        n = slow(docs[r["doc_id"]])
        assert tuple(r[c] for c in Q.BASE) == n
        assert r["base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (r["base_failed"] and r["kept"])
