"""The operators as queries over the test tables, with the SQL that checks them where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from recordflow.llm import ann, chat, html_text, licenses, merkle, mixing, negatives, packing, pii, ppm, quality, sharding, simhash
from recordflow.session import configure, work_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)
        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_pii(spark, sf_dir):
    """Every document with pseudonyms for its personal data."""
    return pii.pseudonymised(table(spark, sf_dir, "documents"))


@query()
def op2_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))[0]


@query()
def op3_sharding(spark, sf_dir):
    """Law ``bytes``: shards of near equal sizes. ``slot`` is a row's place in its shard."""
    s = sharding.shard(table(spark, sf_dir, "documents"), work_folder(spark, "slot-map"))
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


@query()
def op4_neighbours(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query()
def op5_simhash(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@query()
def op6_quality(spark, sf_dir):
    return quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


CHAT_SQL = r"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(12 + length(role) + 1 + n + 11) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""


@query(CHAT_SQL)
def op7_chat(spark, sf_dir):
    """Every conversation, and one whose texts hold the template's own markers."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    lines = chat.transcripts(chat.reply_chain(given.unionByName(own)))
    return chat.figures(chat.read_back(lines)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


@query()
def op8_html(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


MIX_SQL = """WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('42|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
s1 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
s2 AS (SELECT *, ([5, 2, 1])[(place - 1) % 3 + 1] AS weight FROM s1),
s3 AS (SELECT *, 2.0::DOUBLE * source_size / weight AS stop, 1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(weight) OVER () AS weights FROM s2),
s4 AS (SELECT *, (budget - coalesce(2 * sum(source_size) OVER b, 0)) / (weights - coalesce(sum(weight) OVER b, 0)) AS level FROM s3
    WINDOW b AS (ORDER BY stop, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s5 AS (SELECT *, (SELECT arg_min(level, row(stop, place)) FROM s4 WHERE stop >= level) AS common FROM s4),
s AS (SELECT source, source_size, CASE WHEN stop >= common THEN common * weight ELSE 2.0::DOUBLE * source_size END AS target FROM s5),
r1 AS (SELECT d.*, source_size, target, CASE WHEN size > 0 AND source_size > 0 THEN target / source_size ELSE 0 END AS wanted FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
r2 AS (SELECT *, CAST(floor(wanted) AS BIGINT) AS certain, wanted - floor(wanted) AS p FROM r1),
r3 AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN u / (1 - u) * ((1 - p) / p) END AS rank, target - sum(certain * size) OVER (PARTITION BY source) AS need FROM r2),
p0 AS (SELECT *, 0 AS drawn, need AS open FROM r3),
""" + "".join(f"""f{i} AS (SELECT *, drawn = 0 AND rank IS NOT NULL AND size <= open AS fits FROM p{i - 1}),
q{i} AS (SELECT * REPLACE (CASE WHEN fits AND sum(CASE WHEN fits THEN size END) OVER (PARTITION BY source ORDER BY CASE WHEN fits THEN rank END NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) <= open THEN 1 ELSE drawn END AS drawn) FROM f{i}),
p{i} AS (SELECT * EXCLUDE (fits) REPLACE (need - sum(drawn * size) OVER (PARTITION BY source) AS open) FROM q{i}),
""" for i in range(1, 5)) + """r5 AS (SELECT * FROM p4),
last AS (SELECT source, arg_min(doc_id, row(abs(open - size), rank, doc_id)) AS doc_id FROM r5 WHERE drawn = 0 AND rank IS NOT NULL AND certain < 2 AND abs(open - size) < open GROUP BY source)
SELECT r5.doc_id, r5.size, r5.source_size, r5.target, CAST((certain + drawn + CASE WHEN last.doc_id IS NOT NULL THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r5 LEFT JOIN last ON r5.source IS NOT DISTINCT FROM last.source AND r5.doc_id = last.doc_id"""


@query(MIX_SQL)
def op9_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op10_licenses(spark, sf_dir):
    return licenses.licence_scan(table(spark, sf_dir, "documents"))


NEGATIVES_SQL = """WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 5"""


@query(NEGATIVES_SQL)
def op13_negatives(spark, sf_dir):
    """Rows whose id 7 divides take the next label, so that labels and vectors disagree in places."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


MERKLE_SQL = """WITH RECURSIVE bytes AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t
    FROM (SELECT unnest(range(256)) AS i)),
d AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS lowered,
    xor(4294967295, list_reduce([4294967295] || [ascii(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')], lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 3 = 0 AS tampered
    FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
        || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM documents), bytes),
g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) AS n FROM d GROUP BY lang),
l AS (SELECT doc_id, leaf, CASE WHEN tampered THEN lowered ELSE leaf END AS start, tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
    FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang),
n AS (SELECT tree, 0 AS level, idx, leaf AS digest, n FROM l
    UNION ALL SELECT tree, level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (n + 7) // 8 FROM n WHERE n > 1 GROUP BY tree, level, idx // 8, n),
s AS (SELECT tree, max(level) AS top, arg_max(digest, level) AS subroot FROM n GROUP BY tree),
u AS (SELECT -1 AS tree, 0 AS level, tree AS idx, subroot AS digest, count(*) OVER () AS n FROM s
    UNION ALL SELECT tree, level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (n + 7) // 8 FROM u WHERE n > 1 GROUP BY tree, level, idx // 8, n),
nodes AS (SELECT a.tree, a.level, a.idx, a.tree AS up_tree, a.level + 1 AS up_level, a.idx // 8 AS up_idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
    FROM (SELECT * FROM n UNION ALL SELECT * FROM u) a JOIN (SELECT * FROM n UNION ALL SELECT * FROM u) b ON a.tree = b.tree AND a.level = b.level AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY ALL
    UNION ALL SELECT tree, top, 0, -1, 0, tree, '', '' FROM s),
climb AS (SELECT doc_id, leaf, tree AS own, tree, 0 AS level, idx, start AS folded, '' AS siblings FROM l
    UNION ALL SELECT doc_id, leaf, own, up_tree, up_level, up_idx, CASE WHEN up_level = 0 THEN folded ELSE sha256(before || folded || after) END, siblings || before || after
    FROM climb c JOIN nodes n ON c.tree = n.tree AND c.level = n.level AND c.idx = n.idx)
SELECT c.doc_id, c.leaf, s.subroot, r.root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = r.root AS verified
FROM climb c JOIN s ON c.own = s.tree JOIN (SELECT max(level) AS level, arg_max(digest, level) AS root FROM u) r ON c.tree = -1 AND c.level = r.level"""


@query(MERKLE_SQL)
def op12_merkle(spark, sf_dir):
    """Rows whose id's checksum 3 divides are tampered with."""
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)


@query()
def op11_language(spark, sf_dir):
    """A quarter of the documents, by their ids' checksums, is held out of what is learned. Null ids are neither learned from nor held out."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold == 2, F.lit(False)))
    return ppm.identify(docs, fold != 2, keep=("doc_id", "held_out"))
