"""A Merkle manifest of a table, and proofs climbed by a recursive query.

Rows become leaves: SHA-256 of their columns, each with its length in front. Leaves of a group
(a language, say) stand in order; every ``FAN`` consecutive nodes become their parent, until one is left, the
group's subroot; the subroots in order of their groups become the root in the same way. Built levels are stored as
rows that carry their siblings and a link to their parent. A recursive query takes every leaf up along these links, level
by level, adding siblings to its proof and folding its own, perhaps tampered, digest. The leaves of one run share all siblings
above them, so they climb in one row, each with its own digest; their siblings in the run are the run's other leaves.

A place in its group is found without sorting a group in one task: rows are range-partitioned by group
and order, and a row's place is its place in its partition and the rows of the group in the partitions before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordflow.llm.common import saved

FAN = 8
TOP = -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The row limit of recursive queries is lifted while one runs: it counts the rows of all levels.
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
CLIMB = """WITH RECURSIVE climb AS (
    SELECT kids, subroot, tree, level, idx, siblings FROM {leaves}
    UNION ALL
    SELECT /*+ SHUFFLE_HASH(n) */ transform(c.kids, k -> named_struct('id', k.id, 'leaf', k.leaf, 'folded', unhex(sha2(concat(lower(hex(n.before)), lower(hex(k.folded)), lower(hex(n.after))), 256)))),
        coalesce(c.subroot, n.subroot), n.up_tree, n.up_level, n.up_idx, concat(c.siblings, n.before, n.after)
    FROM climb c JOIN {nodes} n ON c.tree = n.tree AND c.level = n.level AND c.idx = n.idx)
SELECT kids, subroot, siblings FROM climb WHERE tree = {tree} AND level = {level}"""
OUT = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _sha(*text: Column) -> Column:
    """SHA-256 of joined texts, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*text), 256))


def record_text(columns: Sequence[Column]) -> Column:
    """``-`` for a null, else the value's UTF-8 length, a colon and the value, one after another."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def placed(rows: DataFrame) -> DataFrame:
    """(tree, idx, m, digest, id, start) of rows (group, id, digest, start): tree numbers the groups
    in order from 0, null first; idx a group's rows by id, null first, and digest; m is the group's row count.

    Equal rows are told apart by their place in the table, so copies do not gather in one partition.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("group").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("digest"), F.col("row")]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The upper bits of this number are the partition, the lower 33 the place in it.
    at = saved(dealt.drop("row").withColumn("at", F.monotonically_increasing_id()), "ordered-leaves")
    at = at.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
    # One row per partition and group in it.
    runs = saved(at.groupBy("group", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")), "group-runs")
    earlier = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("shift", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first"))
    groups = runs.groupBy("group").agg(F.min("part").alias("starts"), F.sum("n").alias("m"))
    # At most one row per partition, so that a window over all of them is small.
    before = groups.groupBy("starts").count().select("starts", (F.sum("count").over(Window.orderBy("starts")) - F.col("count")).alias("before"))
    by_start = Window.partitionBy("starts").orderBy(F.col("group").asc_nulls_first())
    numbered = groups.join(before, "starts").select("group", "m", (F.col("before") + F.row_number().over(by_start) - 1).alias("tree"))
    runs = runs.alias("r").join(numbered.alias("g"), F.col("r.group").eqNullSafe(F.col("g.group"))).select("r.group", "r.part", "r.shift", "g.m", "g.tree")
    joined = at.alias("a").join(runs.alias("r"), (F.col("a.part") == F.col("r.part")) & F.col("a.group").eqNullSafe(F.col("r.group")))
    return joined.select("r.tree", (F.col("a.at") + F.col("r.shift")).alias("idx"), "r.m", "a.digest", "a.id", "a.start")


def levels(rows: DataFrame, payload: Sequence[str], name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Runs of nodes, one table (tree, up, m, kids) per level, and the topmost nodes of the trees, one table per level.

    ``rows`` are (tree, idx, m, digest) and the payload of the lowest level. ``up`` is the place of a run's parent in its
    level, ``kids`` are the run's (idx, digest, payload) in order.
    """
    runs, tops, level = [], [], 0
    m = rows.agg(F.max("m")).first()[0] or 0
    while m:
        tops.append(rows.where("m = 1").select("tree", F.lit(level).alias("level"), "digest", *payload))
        if m == 1:
            break
        kid = F.struct("idx", "digest", *payload)
        runs.append(saved(rows.where("m > 1").groupBy("tree", F.expr(f"idx div {FAN}").alias("up"), "m").agg(F.array_sort(F.collect_list(kid)).alias("kids")), f"{name}-{level}"))
        whole = F.array_join(F.transform("kids", lambda k: _hex(k["digest"])), "")
        rows = runs[-1].select("tree", F.col("up").alias("idx"), F.ceil(F.col("m") / FAN).alias("m"), _sha(whole).alias("digest"))
        payload, level, m = [], level + 1, -(-m // FAN)
    return runs, tops


def _joined(kids: Column, field: str) -> Column:
    return F.aggregate(kids, F.lit(b""), lambda s, k: F.concat(s, k[field]))


def _around(kids: str, at: Column, field: str) -> tuple[Column, Column]:
    """Digests before and after the place ``at`` of a run."""
    return _joined(F.slice(kids, F.lit(1), at), field), _joined(F.slice(kids, at + 2, F.lit(FAN)), field)


def linked(runs: DataFrame, level: int, *payload: str) -> DataFrame:
    """Nodes of a level with their siblings before and after them and the link to their parent."""
    before, after = _around("kids", F.col("at"), "digest")
    return runs.select("tree", "up", "kids", F.posexplode("kids").alias("at", "kid")).select(
        "tree", F.lit(level).alias("level"), F.col("kid.idx").alias("idx"), before.alias("before"), after.alias("after"),
        F.col("tree").alias("up_tree"), F.lit(level + 1).alias("up_level"), F.col("up").alias("up_idx"), *[f"kid.{p}" for p in payload])


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def manifest(df: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "lang", id_col: str = "doc_id",
             text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """(id_col, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row.

    Rows where ``tampered`` holds are folded as if their text's A-Z were lower case, all others as they are.
    Null ids come first in their group, null groups first of all; rows with equal ids stand by leaf, so that equal rows
    are interchangeable. A lone leaf is its group's subroot, a lone subroot the root; without siblings the proof is the digest of the empty text. Empty
    tables give no rows. Other columns are left out.
    """
    spark = df.sparkSession
    original = _sha(record_text([F.col(c) for c in columns]))
    changed = _sha(record_text([lower_ascii(F.col(c)) if c == text_col else F.col(c) for c in columns]))
    start = F.when(tampered, changed) if tampered is not None else F.lit(None).cast("binary")
    given = df.select(F.col(group_col).alias("group"), F.col(id_col).alias("id"), original.alias("digest"), start.alias("start"))
    # Written once: finding the ranges would read and hash all texts once more.
    rows = placed(saved(given, "leaves"))
    runs, tops = levels(rows, ["id", "start"], "merkle")
    if not tops:
        return spark.createDataFrame([], df.select(id_col).schema).select(id_col, *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in OUT.split(", ")])

    def kid(k: Column, before: Column | None = None, after: Column | None = None) -> Column:
        own = F.coalesce(k["start"], k["digest"])
        folded = own if before is None else _sha(_hex(before), _hex(own), _hex(after))
        return F.struct(k["id"].alias("id"), k["digest"].alias("leaf"), folded.alias("folded"))

    lone = F.struct("id", "digest", "start")
    first = tops[0].select(F.array(kid(lone)).alias("kids"), "tree", "level", F.lit(0).cast("long").alias("idx"))
    if runs:
        climbing = F.transform("kids", lambda k, i: kid(k, *_around("kids", i, "digest")))
        first = first.unionByName(runs[0].select(climbing.alias("kids"), "tree", F.lit(1).alias("level"), F.col("up").alias("idx")))
    leaves = first.withColumn("subroot", F.lit(None).cast("binary")).withColumn("siblings", F.lit(b""))
    # The subroots are the leaves of one more tree; where a group's tree ends, its link leads into that.
    subroots = saved(_union([t.select("tree", "level", "digest") for t in tops]), "subroots")
    n_trees = subroots.count()
    links, summit = [linked(r, i) for i, r in enumerate(runs[1:], 1)], subroots
    if n_trees > 1:
        entered = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n_trees).cast("long").alias("m"), "digest", F.col("level").alias("own"))
        upper, ends = levels(entered, ["own"], "merkle-top")
        turn = linked(upper[0], 0, "own", "digest").select(F.col("idx").alias("tree"), F.col("own").alias("level"), F.lit(0).cast("long").alias("idx"), "before", "after", "up_tree", "up_level", "up_idx", F.col("digest").alias("subroot"))
        links, summit = [*links, *[linked(r, i) for i, r in enumerate(upper[1:], 1)]], ends[-1]
    links = [n.withColumn("subroot", F.lit(None).cast("binary")) for n in links] + ([turn] if n_trees > 1 else [])
    top = summit.select("tree", "level", "digest").first()
    root = bytes(top["digest"]).hex()
    done = leaves
    if links:
        limit = spark.conf.get(ROW_LIMIT)
        spark.conf.set(ROW_LIMIT, "-1")
        try:
            done = saved(spark.sql(CLIMB, leaves=leaves, nodes=saved(_union(links), "merkle-nodes"), tree=top["tree"], level=top["level"]), "climbed")
        finally:
            spark.conf.set(ROW_LIMIT, limit)
    each = done.select("kids", "subroot", "siblings", F.posexplode("kids").alias("at", "kid"))
    siblings = F.concat(*_around("kids", F.col("at"), "leaf"), F.col("siblings"))
    folded = _hex(F.col("kid.folded"))
    return each.select(
        F.col("kid.id").alias(id_col), _hex(F.col("kid.leaf")).alias("leaf"), F.coalesce(_hex(F.col("subroot")), F.lit(root)).alias("subroot"), F.lit(root).alias("root"),
        F.sha2(_hex(siblings), 256).alias("proof_sha256"), folded.alias("folded_root"), (folded == root).alias("verified"))
