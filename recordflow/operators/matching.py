"""Matching of form fields to record keys by their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordflow.session import materialize, spread

EXACT, CONTAINED = 100, 60
# Characters of the parts by which containing texts are looked up.
GRAM = 3
# Rows of (entry, field) that score, by task of the last aggregate, which sorts them.
MATCHES_A_TASK = 500_000


def squash(text) -> Column:
    """Lower case without dashes, underscores and white space."""
    return F.regexp_replace(F.lower(F.col(text) if isinstance(text, str) else text), r"[-_\s]", "")


def grams(text: Column, n: int) -> Column:
    """All substrings of n characters, without repeats."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: text.substr(i, F.lit(n))))


def candidates(short: DataFrame, long: DataFrame, form: str) -> DataFrame:
    """Pairs (form, s, t) of texts of one form where t holds the rarest part of s.

    Long texts are listed under their parts of up to ``GRAM`` characters. A short text asks for itself if it is
    no longer than that, else for that one of its parts that the fewest long texts of its form hold; a part
    that none holds ends the search. Both sides are distinct and not empty.
    """
    parts = F.flatten(F.array(*[grams(F.col("t"), n) for n in range(1, GRAM + 1)]))
    postings = long.select(form, "t", F.explode(parts).alias("gram"))
    whole = short.where(F.length("s") <= GRAM).select(form, "s", F.col("s").alias("gram"))
    held = postings.where(F.length("gram") == GRAM).groupBy(form, "gram").agg(F.count(F.lit(1)).alias("n"))
    asked = short.where(F.length("s") > GRAM).select(form, "s", F.explode(grams(F.col("s"), GRAM)).alias("gram"))
    rarest = asked.join(held, [form, "gram"], "left").groupBy(form, "s").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("w"))
    probes = whole.unionByName(rarest.where("w.n > 0").select(form, "s", F.col("w.gram").alias("gram")))
    return probes.join(postings, [form, "gram"]).select(form, "s", "t")


def contained(short: DataFrame, long: DataFrame, form: str) -> DataFrame:
    """Pairs (form, s, t) where t contains s and they differ."""
    return candidates(short, long, form).where(F.contains("t", "s") & (F.col("s") != F.col("t")))


def text_scores(texts: DataFrame, keys: DataFrame, form: str) -> DataFrame:
    """Scores above 0 of the distinct non-empty texts and keys of each form: (form, a, b, score)."""
    a = texts.select(form, "a").where("a <> ''").distinct()
    b = keys.select(form, "b").where("b <> ''").distinct()
    equal = a.join(b, (a[form] == b[form]) & (F.col("a") == F.col("b"))).select(a[form], "a", "b", F.lit(EXACT).alias("score"))
    key_in_text = contained(b.withColumnRenamed("b", "s"), a.withColumnRenamed("a", "t"), form).select(form, F.col("t").alias("a"), F.col("s").alias("b"))
    text_in_key = contained(a.withColumnRenamed("a", "s"), b.withColumnRenamed("b", "t"), form).select(form, F.col("s").alias("a"), F.col("t").alias("b"))
    return equal.unionByName(key_in_text.unionByName(text_in_key).withColumn("score", F.lit(CONTAINED)))


def match_fields(fields: DataFrame, entries: DataFrame, record: str = "record_id", form: str = "form_id") -> DataFrame:
    """Best entry per (record, field).

    ``fields``: form, field_name, candidates ARRAY<STRING> in order of weight.
    ``entries``: record, form, pos, key, value. Ties go to the earliest entry. Only scores of 60 and more count. The
    distinct keys of each form and their scores are written once: they are few beside the
    entries, and Spark then sees how few and can leave the entries where they are. Entries meet the scores by their key as it
    is, so a key is squashed once per form, not once per entry. The keys come with the number of
    their entries, so the number of scoring rows is known before these are made, and they are dealt over as many tasks as
    they need.
    """
    texts = fields.select(form, "field_name", F.explode("candidates").alias("text")).where(
        F.coalesce(F.col("text"), F.lit("")) != "").select(form, "field_name", squash("text").alias("a"))
    texts = materialize(texts, "field-texts")
    counted = materialize(entries.groupBy(form, "key").agg(F.count(F.lit(1)).alias("n")), "keys").withColumn("b", squash("key"))
    keys_of_form = counted.select(form, "b").distinct()
    # A key of separators only is contained in every text.
    in_all = texts.select(form, "field_name", F.lit("").alias("b"), F.when(F.col("a") == "", EXACT).otherwise(CONTAINED).alias("score"))
    scores = texts.join(text_scores(texts, keys_of_form, form), [form, "a"]).select(form, "field_name", "b", "score").unionByName(
        in_all.join(keys_of_form.where("b = ''"), [form, "b"]).select(form, "field_name", "b", "score"))
    per_form = scores.groupBy(form, "field_name", "b").agg(F.max("score").alias("score"))
    by_key = materialize(per_form.join(counted, [form, "b"]).select(form, "field_name", "key", "score", "n"), "key-scores")
    scored = entries.join(by_key, [form, "key"]).select(record, form, "field_name", "pos", "key", "value", "score")
    rows = by_key.agg(F.sum("n").alias("rows")).first()["rows"] or 0
    # A text of separators only is contained in every key, so there the earliest entry scores.
    blank = texts.where("a = ''").select(form, "field_name").distinct()
    if not blank.isEmpty():
        first = entries.join(blank.select(form).distinct(), form, "left_semi").groupBy(record, form).agg(
            F.min_by(F.struct("pos", "key", "value"), "pos").alias("e"))
        scored = scored.unionByName(first.join(blank, form).select(
            record, form, "field_name", "e.pos", "e.key", "e.value", F.when(squash("e.key") == "", EXACT).otherwise(CONTAINED).alias("score")))
        rows += counted.join(blank.groupBy(form).agg(F.count(F.lit(1)).alias("fields")), form).agg(F.sum(F.col("n") * F.col("fields")).alias("rows")).first()["rows"] or 0
    return spread(scored, rows, MATCHES_A_TASK, record, form, "field_name").groupBy(record, form, "field_name").agg(
        F.max_by(F.struct("key", "value", "score"), F.struct(F.col("score"), -F.col("pos"))).alias("m")
    ).select(record, form, "field_name", "m.key", "m.value", "m.score")
