"""Reply trees against walking them, the template against its inverse."""

import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from recordflow.llm import chat as C

SCHEMA = "conv long, node long, parent long, score double, role string, text string"


def tree(seed, n=120, convs=6):
    rng = random.Random(seed)
    rows, of = [], {}
    for node in range(n):
        conv = rng.randrange(convs)
        parent = rng.choice(of[conv]) if conv in of and rng.random() < .97 else None
        if conv in of and parent is None:
            parent = of[conv][0]
        of.setdefault(conv, []).append(node)
        rows.append((conv, node, parent, rng.randrange(8) / 4, rng.choice(["user", "assistant", "system"]), f"t{node} <|im_end|> \\ <\\|x"))
    return rows


def best_paths(rows, top):
    by = {r[1]: r for r in rows}
    parents = {r[2] for r in rows}
    paths = {}
    for r in rows:
        if r[1] not in parents:
            path, at = [], r[1]
            while at is not None:
                path.append(at)
                at = by[at][2]
            paths.setdefault(r[0], []).append((-sum(by[p][3] for p in path), r[1], path[::-1]))
    return {(c, leaf): path for c, found in paths.items() for _, leaf, path in sorted(found)[:top]}


@pytest.mark.parametrize("top", [1, 3])
def test_branches(spark, top):
    rows = tree(top)
    messages = spark.createDataFrame(rows, SCHEMA)
    got = C.read_back(C.transcripts(messages, top)).collect()
    want, by = best_paths(rows, top), {r[1]: r for r in rows}
    assert {(r["conv"], r["leaf"]): [(t["role"], t["text"]) for t in r["turns"]] for r in got} == {k: [by[n][4:] for n in path] for k, path in want.items()}
    for r in got:
        assert sum(x["length"] for x in r["mask"]) == len(r["formatted"])
        at, loss = 0, []
        for x in r["mask"]:
            if x["loss"]:
                loss.append(r["formatted"][at:at + x["length"]])
            at += x["length"]
        assert [s.replace("<\\|", "<|").replace("<\\\\|", "<\\|") for s in loss] == [by[n][5] for n in want[r["conv"], r["leaf"]] if by[n][4] == "assistant"]


def test_long_chain(spark):
    rows = [(1, i, i - 1 if i else None, 1.0, "user", str(i)) for i in range(700)]
    got = C.read_back(C.transcripts(spark.createDataFrame(rows, SCHEMA))).first()
    assert [t["text"] for t in got["turns"]] == [str(i) for i in range(700)]


def slow_escape(text):
    out, i = "", 0
    while i < len(text):
        if text[i] == "<":
            j = i + 1
            while j < len(text) and text[j] == "\\":
                j += 1
            if j < len(text) and text[j] == "|":
                out += text[i:j] + "\\|"
                i = j + 1
                continue
        out += text[i]
        i += 1
    return out


@settings(max_examples=25, deadline=None)
@given(texts=st.lists(st.text(alphabet="<|\\a\n%>im_endé", max_size=12), min_size=1, max_size=20))
def test_escapes(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("t", C.escape(F.col("t")).alias("e"), C.unescape(C.escape(F.col("t"))).alias("u"), C.unescape_role(C.escape_role(F.col("t"))).alias("r"), C.escape_role(F.col("t")).alias("er")).collect()
    for r in rows:
        assert r["u"] == r["t"] == r["r"] and r["e"] == slow_escape(r["t"]) and "<|" not in r["e"] and "\n" not in r["er"] and "<" not in r["er"]


def test_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (1, None, "assistant", ""), (2, 5, "a%<\nb", "y"), (None, 0, "assistant", "z"), (None, 1, "user", "w " * 50_000), (3, 0, "assistant", "<|im_end|>\n<|im_start|>")]
    turns = spark.createDataFrame([(*r, 1, "n") for r in rows], "conv_id long, turn long, role string, text string, node int, head string")
    got = {r["conv"]: r for r in C.read_back(C.transcripts(C.reply_chain(turns))).collect()}
    assert {c: [tuple(t) for t in r["turns"]] for c, r in got.items()} == {
        1: [("assistant", ""), ("user", ""), ("", "x"), ("", "x")], 2: [("a%<\nb", "y")], None: [("assistant", "z"), ("user", "w " * 50_000)], 3: [("assistant", "<|im_end|>\n<|im_start|>")]}
    f = {r["conv_id"]: r for r in C.figures(C.read_back(C.transcripts(C.reply_chain(turns)))).collect()}
    assert all(r["mask_chars"] == r["formatted_chars"] for r in f.values()) and f[3]["masked_chars"] == f[3]["loss_chars"] + 2
    assert C.transcripts(C.reply_chain(turns.limit(0))).collect() == []


def test_loss_comes_from_the_mask(spark):
    rows = [(1, 0, "user", "ask <|im_end|>"), (1, 1, "assistant", "one <|x|> é😀"), (1, 2, "assistant", "two\n<|im_end|>\n")]
    lines = C.transcripts(C.reply_chain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert C.read_back(lines).first()["loss"] == "one <|x|> é😀two\n<|im_end|>\n"
    turned = lines.withColumn("mask", F.transform("mask", lambda r, i: F.struct(r["length"].alias("length"), (i == 1).alias("loss"))))
    f = C.figures(C.read_back(turned)).first()
    assert f["loss_sha256"] == hashlib.sha256(b"ask <|im_end|>").hexdigest() and f["loss_chars"] == 14
    for wrong in (F.slice("mask", 1, 8), F.transform("mask", lambda r: F.struct((r["length"] + 1).alias("length"), r["loss"].alias("loss")))):
        with pytest.raises(Exception, match="does not fit"):
            C.read_back(lines.withColumn("mask", wrong)).collect()


def test_no_python_on_the_executors(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    plan = C.figures(C.read_back(C.transcripts(C.reply_chain(turns))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
