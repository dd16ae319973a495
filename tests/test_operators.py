import random

import pytest
from pyspark.sql import functions as F

from recordflow.operators import catalog as K, jobs as J, layout as L, matching as M, ordered as O, reports as A
from recordflow.plans import extract as X, fill as P
from recordflow.operators import cache as CA, cache_store as ST, records as R


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_running_is_the_same_cut_or_whole(spark):
    rnd = random.Random(3)
    data = [("hot" if rnd.random() < 0.6 else f"g{rnd.randrange(5)}", rnd.randrange(400), i, rnd.randrange(10)) for i in range(1500)]
    d = spark.createDataFrame(data, "g string, at int, id int, v int")
    whole, cut = [O.running(d, "g", ["at", "id"], "n", {"total": F.col("v")}, hot_rows=h) for h in (10_000, 60)]
    want, seen = [], {}
    for g, at, i, v in sorted(data, key=lambda r: (r[1], r[2])):
        n, t = seen.get(g, (0, 0))
        seen[g] = (n + 1, t + v)
        want.append((i, n + 1, t + v))
    assert rows(whole, "id", "n", "total") == rows(cut, "id", "n", "total") == sorted(want, key=repr)


def test_ties_of_the_first_position_are_cut_by_the_second(spark):
    d = spark.createDataFrame([("g", 5, i) for i in range(100)] + [("g", 6, None), ("h", 1, 1)], "g string, at int, id int")
    chunks = O.with_chunks(d, ["g"], ["at", "id"], O.hot_cuts(d, ["g"], ["at", "id"], 10)).groupBy("g", "at", O.CHUNK).count().collect()
    assert sum(r["g"] == "g" and r["at"] == 5 for r in chunks) >= 5 and max(r["count"] for r in chunks) <= 25


def test_chunks_hold_as_many_rows_however_values_are_spread(spark):
    d = spark.range(10_000).select(F.lit("g").alias("g"), F.when(F.col("id") == 9_999, 10 ** 15).when(F.col("id") < 5_000, F.col("id") % 50).otherwise(F.col("id")).alias("at"), "id")
    for order in (["at", "id"], ["id"]):
        cuts = O.hot_cuts(d, ["g"], order, 1_000)
        sizes = [r["count"] for r in O.with_chunks(d, ["g"], order, cuts).groupBy(O.CHUNK).count().collect()]
        assert max(sizes) <= 2_000 and len(sizes) >= 10
    got = O.with_index(d, "g", ["at", "id"], "n", hot_rows=1_000).orderBy("n").select("at", "id", "n").collect()
    assert [(r["at"], r["id"]) for r in got] == sorted((r["at"], r["id"]) for r in got) and [r["n"] for r in got] == list(range(1, 10_001))


def test_concat_of_many_inputs_in_one_group(spark):
    d = spark.range(3_000).select(F.lit("g").alias("g"), (F.col("id") % 700).alias("input"), F.col("id").alias("item_at"))
    whole, cut = [sorted((r["input"], r["item_at"], r["item"]) for r in O.concat_groups(d, "g", "input", "item_at", hot_rows=h).collect()) for h in (10_000, 100)]
    assert whole == cut and [r[2] for r in whole] == list(range(1, 3_001))


def test_running_with_one_position_and_null_group(spark):
    d = spark.createDataFrame([(None, 1, i) for i in range(30)], "g string, at int, id int")
    assert rows(O.with_index(d, "g", ["at", "id"], "n", hot_rows=5), "id", "n") == sorted([(i, i + 1) for i in range(30)], key=repr)


@pytest.fixture
def page(spark):
    rnd = random.Random(7)
    words = [("d", p, i, f"w{i}", float(x := rnd.randrange(0, 600)), x + rnd.random() * 60, rnd.random() * 120) for p in range(2) for i in range(160)]
    edges = [("d", 0, 900 + i, f"e{i}", x0, x1, top) for i, (x0, x1, top) in enumerate([(75.0, 105.0, 62.0), (31.0, 40.0, 50.0), (531.0, 540.0, 38.0), (100.0 - 220 + 20, 40.0, 62.0)])]
    fields = [("d", f"f{i % 50}", "/Tx", rnd.randrange(2), x0 := rnd.choice([20, 40, 79, 80, 100, 300]), x0 + 16, x0 + 8, rnd.randrange(120)) for i in range(80)]
    schema = "doc_id string, page int, word_no int, text string, x0 double, x1 double, top double"
    return (spark.createDataFrame(fields, "doc_id string, name string, type string, page int, x0 int, x1 int, x int, y int"),
            spark.createDataFrame(words + edges, schema), fields, words + edges)


def brute_label(f, words):
    _, name, _, pg, x0, x1, _, y = f
    box, near = x0 < 80, []
    for _, p, no, text, wx0, wx1, top in words:
        if p != pg or abs(top - y) > 12:
            continue
        if (box and x1 - 5 <= wx0 <= x1 + 500) or (not box and wx1 <= x0 + 5 and x0 - wx0 <= 220):
            near.append((wx0, no, text))
    near = sorted(near)
    return " ".join(t for _, _, t in (near[:6] if box else near[-4:])) or name


def test_labels_against_brute_force(page):
    fields, words, f, w = page
    assert rows(L.field_labels(fields, words), "name", "page", "x0", "y", "label") == sorted([(r[1], r[3], r[4], r[7], brute_label(r, w)) for r in f], key=repr)
    last = {}
    for r in sorted(f, key=lambda r: (r[3], r[7], r[6])):
        last[r[1]] = brute_label(r, w)
    got = dict(rows(L.infer_labels(fields, words), "name", "label"))
    assert got.keys() == last.keys() and sum(got[k] != last[k] for k in got) == 0


def test_unique_keys_with_collisions(spark):
    rnd = random.Random(5)
    keys = [rnd.choice(["sign", "sign_1", "sign_1_1", "date", "date_2", "x"]) for _ in range(60)]
    d = spark.createDataFrame([("d", 0, i, k) for i, k in enumerate(keys)], "doc string, page int, seq int, key string")
    taken, want = set(), []
    for i, k in enumerate(keys):
        name, n = k, 1
        while name in taken:
            name, n = f"{k}_{n}", n + 1
        taken.add(name)
        want.append((i, name))
    assert rows(L.dedupe_keys(d, "doc", "key", ["page", "seq"]), "seq", "unique_key") == sorted(want, key=repr)


def squash(s):
    return "".join(c for c in s.lower() if c not in "-_ \t\n")


def test_containment_candidates_are_few(spark):
    """Only texts of one form meet, through the rarest part of the shorter one; no pair is lost."""
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcde") for _ in range(n))
    long = {(f"f{rnd.randrange(4)}", word(rnd.randrange(1, 30))) for _ in range(300)}
    short = {(f, t[i:i + rnd.randrange(1, 12)]) for f, t in long for i in [rnd.randrange(len(t))]} | {(f"f{rnd.randrange(5)}", word(7)) for _ in range(200)}
    s, t = spark.createDataFrame(sorted(short), "form string, s string"), spark.createDataFrame(sorted(long), "form string, t string")
    want = sorted((f, a, b) for f, a in short for g, b in long if f == g and a in b and a != b)
    assert sorted(map(tuple, M.contained(s, t, "form").collect())) == want
    assert M.candidates(s, t, "form").count() < 5 * len(want)


def test_missing_templates_fill_ranges(spark, monkeypatch):
    """The first free ids, whatever ranges they lie in."""
    lists = ([("D", "g")], [("P", "medicaid")], ["TX"])
    monkeypatch.setattr(K, "RANGE", 10)
    name = lambda i: f"pa_g_p_tx_stub{i}"
    have = [name(i) for i in [*range(3, 27), 40, 41]] + ["other", "other"]
    got = K.missing_templates(spark.createDataFrame([(x,) for x in have], "id string"), *lists, 60)
    want = [i for i in range(60) if name(i) not in have][:60 - len(set(have))]
    assert sorted(r["seq"] for r in got.collect()) == want and len(want) == 33
    assert K.missing_templates(spark.createDataFrame([(x,) for x in have], "id string"), *lists, 20).count() == 0


def test_matching_against_brute_force(spark):
    rnd = random.Random(11)
    parts = ["first", "name", "Zip", "date-of", "_", "phone", "x", ""]
    word = lambda: "_".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 3)))
    fields = [("f", f"n{i}", [word(), word()]) for i in range(25)]
    entries = [(r, "f", p, word(), f"v{r}-{p}") for r in range(12) for p in range(6)]
    got = M.match_fields(spark.createDataFrame(fields, "form_id string, field_name string, candidates array<string>"),
                         spark.createDataFrame(entries, "record_id int, form_id string, pos int, key string, value string"))
    want = []
    for _, name, cands in fields:
        for r in range(12):
            best = (0, None)
            for _, _, _, key, value in [e for e in entries if e[0] == r]:
                for c in filter(None, cands):
                    a, b = squash(c), squash(key)
                    s = 100 if a == b else 60 if a in b or b in a else 0
                    best = (s, value) if s > best[0] else best
            if best[0] >= 60:
                want.append((r, name, best[1], best[0]))
    assert rows(got, "record_id", "field_name", "value", "score") == sorted(want, key=repr)


def test_threshold_is_inclusive_and_missing_counts_as_one(spark):
    m = spark.createDataFrame([("b", 1, "a", .9), ("b", 1, "b", .3), ("b", 1, "c", .01), ("b", 1, "d", None)], "batch_id string, idx int, field_name string, confidence double")
    kept = lambda t: [r[0] for r in A.apply_threshold(m, t).select("field_name").orderBy("field_name").collect()]
    assert kept(0.0) == list("abcd") and kept(0.3) == list("abd") and kept(0.95) == ["d"]
    s = A.record_stats(m, 0.3).first()
    assert (s["fields_filled"], s["fields_skipped"], s["avg_confidence"]) == (3, 1, 0.403)


def test_state_filter(spark):
    t = spark.createDataFrame([("a", ("P", "TX")), ("b", ("P", None)), ("c", None), ("d", ("P", "RI"))], "id string, payer struct<name:string,state:string>")
    assert [r[0] for r in K.search_catalog(t, state="tx").select("id").orderBy("id").collect()] == ["a", "b"]


def test_jobs_filter_then_limit(spark):
    d = spark.createDataFrame([(f"j{i}", "done" if i % 3 else "queued", "k", f"2024-01-{i + 10}") for i in range(12)], "id string, status string, kind string, created_at string")
    assert [r["id"] for r in J.list_recent(d, status="queued", limit=2).collect()] == ["j9", "j6"]


def test_job_cancel(spark):
    ev = [("a", 1, "create", "queued"), ("a", 2, "cancel", None), ("b", 1, "create", "queued"), ("b", 2, "update", "running"), ("b", 3, "cancel", None),
          ("c", 1, "create", "queued"), ("c", 2, "cancel", None), ("c", 3, "cancel", None), ("d", 1, "create", "queued"), ("d", 2, "update", None), ("d", 3, "update", "done")]
    d = spark.createDataFrame(ev, "job_id string, seq int, action string, status string")
    assert rows(J.fold_jobs(d), "job_id", "status") == [("a", "cancelled"), ("d", "done")]


def test_segments(spark):
    d = spark.createDataFrame([("c", i) for i in range(5)], "c string, turn int")
    r = rows(O.split_segments(d, "c", ["turn"], "range", "1-2, 4,2-9,x"), "turn", "label", "error")
    assert [x for x in r if x[2] is None] == [(0, "pages_1-2", None), (1, "pages_1-2", None), (3, "page_004", None)]
    assert sorted(x[2] for x in r if x[2]) == ["invalid range x", "out of bounds: pages_2-9"]
    assert [x[1] for x in rows(O.split_segments(d, "c", ["turn"], "half"), "turn", "label")] == ["part1", "part1", "part2", "part2", "part2"]


def test_extract(spark):
    values = spark.createDataFrame([("d", 0, "F.P.a", "1"), ("d", 1, "b", "")], "doc_id string, pos int, full_name string, value string")
    fields = spark.createDataFrame([("d", "a", "/Tx", 0, 100, 140, 120, 50), ("d", "z", "/Btn", 0, 20, 30, 25, 90)], "doc_id string, name string, type string, page int, x0 int, x1 int, x int, y int")
    words = spark.createDataFrame([("d", 0, 0, "Doctor", 50.0, 90.0, 52.0)], "doc_id string, page int, word_no int, text string, x0 double, x1 double, top double")
    got = [tuple(r) for r in X.extract(values, fields, words).orderBy("source", "position", "name").select("name", "label", "value", "page", "field_type").collect()]
    assert got == [("F.P.a", "Doctor", "1", 1, "text"), ("z", "z", "", 1, "checkbox"), ("b", None, "", None, None)]
    # Places far below, left of and above the page's origin keep their order; a repeated value keeps its rows, a name with dots stands for itself.
    far = spark.createDataFrame([("d", n, "/Tx", p, 100, 140, x, y) for n, p, x, y in (("q", 0, -7, 200_000), ("r", 0, 150_000, 200_000), ("t.u", 1, 0, -50), ("v", 0, 5, -3))], fields.schema)
    more = spark.createDataFrame([("d", 0, "A.q", "1"), ("d", 1, "B.q", "2"), ("d", 2, "t.u", "3"), ("d", 3, "t.u", "4"), ("e", 0, "q", "5"), ("d", 4, "A.q", None)], values.schema)
    got = [tuple(r) for r in X.extract(more, far, words).orderBy("source", "position", "name", "doc_id", "value").select("doc_id", "name", "value", "page").collect()]
    assert got == [("d", "v", "", 1), ("d", "A.q", "", 1), ("d", "A.q", "1", 1), ("d", "r", "", 1), ("d", "t.u", "3", 2), ("d", "t.u", "4", 2), ("d", "B.q", "2", None), ("e", "q", "5", None)]
    assert [tuple(r) for r in O.reading_order(far).select("name").collect()] == [("v",), ("q",), ("r",), ("t.u",)]
    for hot in (1, 100):
        assert rows(O.number_fields(far, hot_rows=hot), "place", "name") == [(1, "v"), (2, "q"), (3, "r"), (4, "t.u")]
    plain = X.extract(values)
    assert rows(A.extract_summary(plain, values), "fields_detected", "non_empty_fields", "hint") == [(2, 1, None)]


def test_cached_requests_are_not_mapped_again(spark):
    bundles = spark.createDataFrame([("b", i, "form", {"zip": str(i % 2)}) for i in range(4)], "batch_id string, idx int, doc_id string, flat map<string,string>")
    labeled = spark.createDataFrame([("form", "Zip", "zip code")], "doc_id string, field_name string, label string")
    first, fresh = P.map_fields(bundles, labeled)
    assert rows(first, "idx", "value", "cache_hit") == [(i, str(i % 2), False) for i in range(4)] and fresh.count() == 2
    cache = P.fresh_entries(fresh, F.lit("2024-01-01")).withColumn("field_labels", F.create_map(F.lit("Zip"), F.lit("zip code")))
    again, none = P.map_fields(bundles, labeled, cache=cache)
    assert rows(again, "idx", "value", "cache_hit") == [(i, str(i % 2), True) for i in range(4)] and none.count() == 0
    relabeled, fresh2 = P.map_fields(bundles, labeled.withColumn("label", F.lit("other")), cache=cache)
    assert fresh2.count() == 2


def test_pluggable_mappers(spark):
    bundles = spark.createDataFrame([("b", 1, "form", {"k": "v"})], "batch_id string, idx int, doc_id string, flat map<string,string>")
    labeled = spark.createDataFrame([("form", "F", "l")], "doc_id string, field_name string, label string")
    fp = bundles.join(P.labels_digest(labeled), "doc_id").select(P.request_fingerprint().alias("fingerprint"), F.lit('{"F": {"value": "t", "confidence": 0.2}}').alias("response"))
    assert rows(P.map_fields(bundles, labeled, mapper=fp)[0], "value", "confidence") == [("t", 0.2)]

    def mapper(batches):
        for pdf in batches:
            yield pdf.assign(field_name="F", value="fn", confidence=0.5)[["fingerprint", "field_name", "value", "confidence"]]

    assert rows(P.map_fields(bundles, labeled, mapper=mapper)[0], "value", "confidence") == [("fn", 0.5)]


def test_matches_are_dealt_over_tasks_by_their_number(spark, monkeypatch):
    """Every entry scores for every field: 2,000 rows, and the fields without a text take one of each record."""
    monkeypatch.setattr(M, "MATCHES_A_TASK", 100)
    fields = spark.createDataFrame([("f", f"zip{i}", [f"zip {i}"]) for i in range(10)] + [("g", "none", ["-"])], "form_id string, field_name string, candidates array<string>")
    entries = spark.createDataFrame([(i, "f", 0, "zip", str(i)) for i in range(200)] + [(i, "g", 0, "k", str(i)) for i in range(1000)], "record_id int, form_id string, pos int, key string, value string")
    d = M.match_fields(fields, entries)
    assert d.rdd.getNumPartitions() >= 30 and d.count() == 3000
    assert d.where("value <> CAST(record_id AS STRING) OR score <> 60").count() == 0


def test_keys_are_squashed_once_a_form(spark):
    """Entries meet the scores by their key as it is; keys that squash alike count as one, and each keeps its own name."""
    fields = spark.createDataFrame([("f", "zip", ["Zip-Code"])], "form_id string, field_name string, candidates array<string>")
    entries = spark.createDataFrame([(i, "f", p, k, f"{i}{k}") for i in range(6) for p, k in enumerate(["other", ["zip_code", "ZIP code", "zip"][i % 3]])], "record_id int, form_id string, pos int, key string, value string")
    d = M.match_fields(fields, entries)
    assert "regexp_replace" not in d._jdf.queryExecution().executedPlan().toString().lower()
    assert rows(d, "record_id", "key", "score") == [(i, ["zip_code", "ZIP code", "zip"][i % 3], [100, 100, 60][i % 3]) for i in range(6)]


def test_a_mapper_sees_each_request_once(spark):
    """Filled fields, results and new cache rows read what the mapper gave; it is not called again for each."""
    made = spark.createDataFrame([("b", i, "form", f"P{i % 2}") for i in range(4)], "batch_id string, idx int, doc_id string, name string")
    records = made.select("batch_id", "idx", "doc_id", R.entries_of({"patientName": F.col("name")}).alias("entries"))
    labeled = spark.createDataFrame([("form", "F", "l")], "doc_id string, field_name string, label string")
    seen = spark.sparkContext.accumulator(0)

    def mapper(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf.assign(field_name="F", value="fn", confidence=0.5)[["fingerprint", "field_name", "value", "confidence"]]

    out = P.fill_batch(records, labeled, shape="flat", mapper=mapper)
    assert [out[k].count() for k in ("filled", "results", "fresh")] == [4, 4, 2] and seen.value == 2
    bundles = P.request_bundles(records, labeled.where("field_name = 'none'"), shape="flat")
    assert bundles.where("fingerprint IS NOT NULL").count() == 0
    assert rows(P.fill_bundles(bundles, labeled.where("field_name = 'none'"), mapper=mapper)["results"], "success", "error") == [(False, "No fillable form fields found")] * 4


def _entries(spark, rows):
    return spark.createDataFrame(rows, "fingerprint string, n int, day string").select("fingerprint", "n", F.col("day").cast("timestamp").alias("cached_at"))


def _held(spark, path):
    return sorted((r["fingerprint"], r["n"]) for r in ST.read_cache(spark, path).collect())


def test_cache_upsert_keeps_the_latest(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert ST.read_cache(spark, path) is None
    for n, day in ((1, "2024-01-01"), (3, "2024-01-03"), (2, "2024-01-02")):
        ST.upsert_cache(_entries(spark, [("f", n, day)]), path)
    assert _held(spark, path) == [("f", 3)]
    assert ST.upsert_cache(_entries(spark, []), path) == 3


def test_cache_upsert_writes_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "cache")
    ST.upsert_cache(_entries(spark, [(f"f{i}", i, "2024-01-01") for i in range(200)]), path, buckets=16)
    first = ST.snapshot(spark, path)
    assert len(first.folders) == 16
    ST.upsert_cache(_entries(spark, [("f7", 1000, "2024-01-02")]), path)
    second = ST.snapshot(spark, path)
    moved = [b for b in range(16) if first.folders[b] != second.folders[b]]
    assert len(moved) == 1 and sum(1 for d in tmp_path.glob("cache/data-*/bucket=*")) == 17
    assert _held(spark, path) == sorted([(f"f{i}", 1000 if i == 7 else i) for i in range(200)])
    assert {r["fingerprint"] for r in ST.read_cache(spark, path, _entries(spark, [("f7", 0, "2024-01-02")])).collect()} < {f"f{i}" for i in range(200)}


def test_cache_deletions_last(spark, tmp_path):
    path = str(tmp_path / "cache")
    day = lambda d: F.lit(d).cast("timestamp")
    assert ST.invalidate_store(spark, path, day("2024-01-05"), _entries(spark, [("f1", 0, "2024-01-01")])).collect() == [("f1", False)]
    ST.upsert_cache(_entries(spark, [(f"f{i}", i, "2024-01-01") for i in range(5)]), path)
    asked = ST.invalidate_store(spark, path, day("2024-01-05"), _entries(spark, [("f1", 0, "2024-01-01"), ("f2", 0, "2024-01-01"), ("f9", 0, "2024-01-01")]))
    assert sorted(map(tuple, asked.collect())) == [("f1", True), ("f2", True), ("f9", False)]
    ST.upsert_cache(_entries(spark, [("f1", 10, "2024-01-04"), ("f2", 20, "2024-01-06")]), path)
    assert _held(spark, path) == [("f0", 0), ("f2", 20), ("f3", 3), ("f4", 4)]
    number = ST.compact(spark, path, day("2024-01-06"))
    assert _held(spark, path) == [("f0", 0), ("f2", 20), ("f3", 3), ("f4", 4)] and len(list(tmp_path.glob("cache/_commits/*.json"))) == 1
    assert {f.name for f in tmp_path.glob("cache/data-*")} == set(ST.snapshot(spark, path).folders.values())
    assert ST.compact(spark, path, day("2024-01-06")) == number
    ST.invalidate_store(spark, path, day("2024-01-07"))
    assert _held(spark, path) == []


def test_cache_expires(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([("a", 2, "2024-01-01"), ("b", 2, "2024-01-09"), ("c", 1, "2024-01-09")], "fingerprint string, version int, day string")
    ST.upsert_cache(rows.select("fingerprint", "version", F.col("day").cast("timestamp").alias("cached_at")), path)
    gone = ST.expire(spark, path, F.lit("2024-01-10").cast("timestamp"), 3)
    assert sorted(r["fingerprint"] for r in gone.collect()) == ["a", "c"] and [r["fingerprint"] for r in ST.read_cache(spark, path).collect()] == ["b"]


@pytest.mark.parametrize("other", ["f1", "f2"])
def test_two_cache_writers_lose_nothing(spark, tmp_path, monkeypatch, other):
    """A writer that finds another's commit in place merges again if it changed the same bucket, and else keeps what it wrote."""
    path, real, merges = str(tmp_path / "cache"), ST._commit, []
    ST.upsert_cache(_entries(spark, [("f0", 0, "2024-01-01")]), path)

    def late(files, state):
        monkeypatch.setattr(ST, "_commit", real)
        ST.upsert_cache(_entries(spark, [(other, 2, "2024-01-02")]), path)
        return real(files, state)

    monkeypatch.setattr(ST, "_commit", late)
    monkeypatch.setattr(ST, "last_wins", lambda *a, f=ST.last_wins: merges.append(1) or f(*a))
    ST.upsert_cache(_entries(spark, [("f1", 1, "2024-01-03")]), path)
    assert _held(spark, path) == sorted({("f0", 0), ("f1", 1), *([("f2", 2)] if other == "f2" else [])})
    assert ST.snapshot(spark, path).number == 3 and len(merges) == (3 if other == "f1" else 2)
    assert not ST._commit(ST._Files(spark, path), ST.Snapshot(3)) and not list(tmp_path.glob("cache/_drafts/*"))
