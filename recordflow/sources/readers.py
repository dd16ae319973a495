"""Readers: records, profiles, manifests, jobs, audit events.

All are Spark file sources. ``idx`` follows the order of rows in their file: by
block, then by row within it, as splits of a file may be planned in any order.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recordflow.functions.scalars import strip
from recordflow.operators.catalog import MANIFEST
from recordflow.operators.ordered import with_index
from recordflow.operators.records import ENTRIES, entries_of, entries_of_json

JOB = ("id string, status string, kind string, template_id string, record_count int, "
       "progress struct<total:int,completed:int,successful:int,failed:int>, created_at string, started_at string, completed_at string, "
       "download_url string, avg_confidence double, cache_hits int, error string, webhook_url string, webhook_delivered boolean")
AUDIT = ("audit_id string, event string, at string, output_filename string, download_url string, page_index int, signature_mode string, "
         "signer_name string, signer_email string, api_key_id string, client_ip string, placement_pct map<string,double>, "
         "document_sha256 string, consent_given boolean, certificate_filename string")
SIGNER = ("struct<index:int,name:string,email:string,field_key:string,page_index:int,x_pct:double,y_pct:double,width_pct:double,"
          "height_pct:double,status:string,signed_at:string,audit_id:string,signed_pdf_filename:string>")
SESSION = ("session_id string, title string, status string, template_id string, base_pdf_filename string, current_pdf_filename string, "
           f"current_signer_index int, signers array<{SIGNER}>, final_pdf_filename string, created_by_key_id string, created_at string, updated_at string")
APPROVAL = ("approval_id string, title string, pdf_filename string, review_token string, status string, reviewer_name string, reviewer_email string, "
            "requester_email string, webhook_url string, expires_at string, decided_at string, comment string, created_at string, updated_at string")
PROFILE = "id string, name string, profile_type string, data map<string,string>, created_at string, updated_at string, usage_count int"
API_KEY = "id string, name string, tier string, created_at string, last_used_at string, request_count long"
CACHE = ("version int, cached_at string, fingerprint string, field_labels map<string,string>, "
         "mappings map<string,struct<value:string,confidence:double,source:string>>")


def _row_order(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_row"))


def _indexed(df: DataFrame, name: str = "idx") -> DataFrame:
    return with_index(df, "file", ["_block", "_row"], name).drop("_block", "_row")


def _require_rows(df: DataFrame, path: str) -> None:
    """Looks at the bare scan, so that the check stops at the first row."""
    if df.isEmpty():
        raise ValueError(f"no data rows in {path}")


def csv_kinds(spark: SparkSession, path: str) -> DataFrame:
    """Files of a path by what a reader must know of them: (header, utf8, breaks, files).

    One light pass over lines, without parsing: the first line of each file, whether all its lines
    are valid UTF-8, and whether a quoted cell holds a line break (a line with an odd
    number of quotes).
    """
    lines = spark.read.text(path).select(
        F.ltrim("value", F.lit("\ufeff")).alias("value"), F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at")).where(strip("value") != "")
    by_file = lines.groupBy("file").agg(
        F.min_by("value", "at").alias("header"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(F.regexp_count("value", F.lit('"')) % 2 == 1).alias("breaks"))
    return by_file.groupBy("header", "utf8", "breaks").agg(F.array_sort(F.collect_list("file")).alias("files"))


def _csv_scans(spark: SparkSession, path: str) -> list[tuple[DataFrame, list[str]]]:
    """One scan, with its column names, for each kind of file. Files are read by their own
    header; what is not UTF-8 is read as Latin-1; only files with line breaks in cells are not split."""
    out = []
    for kind in csv_kinds(spark, path).orderBy("files").collect():  # one row per distinct header
        df = spark.read.csv([unquote(f) for f in kind["files"]], header=True, multiLine=kind["breaks"], encoding="UTF-8" if kind["utf8"] else "ISO-8859-1", escape='"', mode="PERMISSIVE")
        names = [c.lstrip("\ufeff").removeprefix("ï»¿") for c in df.columns]
        out.append((_row_order(df).toDF(*names, "file", "_block", "_row"), names))
    return out


def _filled(names: list[str]) -> Column:
    return F.exists(F.array(*[F.col(f"`{n}`") for n in names]), lambda v: F.coalesce(strip(v), F.lit("")) != "")


def _union(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for p in parts:
        out = out.unionByName(p)
    return out


def read_csv_records(spark: SparkSession, path: str, require_rows: bool = True) -> DataFrame:
    """Records (file, idx, entries) of CSV files, each read by its own header; all values are text."""
    scans = _csv_scans(spark, path)
    # The reader skips blank lines and gives empty cells as null; to a record they are ''.
    rows = [df.select("file", "_block", "_row", entries_of({n: F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names}).alias("entries")) for df, names in scans]
    out = _union(rows, spark, f"file string, _block bigint, _row bigint, entries {ENTRIES}")
    if require_rows:
        _require_rows(out, path)
    return _indexed(out).select("file", "idx", "entries")


def read_profile_import(spark: SparkSession, path: str) -> DataFrame:
    """Import rows (import_id, row, data); blank rows are dropped, the first row is 2."""
    rows = []
    for df, names in _csv_scans(spark, path):
        data = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names]))
        rows.append(df.where(_filled(names)).select("file", "_block", "_row", data.alias("data")))
    out = _indexed(_union(rows, spark, "file string, _block bigint, _row bigint, data map<string,string>"), "row")
    return out.select(F.col("file").alias("import_id"), (F.col("row") + 1).alias("row"), "data")


def read_json_records(spark: SparkSession, path: str, lines: bool = False, require_rows: bool = True) -> DataFrame:
    """Records (file, idx, entries, error) of JSON arrays, one array per file, or of JSON lines.

    An array file is read by one task; large inputs should be lines. A file that is no
    array, or is cut off, gives one row with ``error`` and neither idx nor entries; a line that is no object
    gives a row with its idx and ``error``.
    """
    if lines:
        raw = _row_order(spark.read.text(path)).where(strip("value") != "")
        if require_rows:
            _require_rows(raw, path)
        out = _indexed(raw).select("file", "idx", entries_of_json("value").alias("entries"))
        return out.withColumn("error", F.when(F.col("entries").isNull(), "not a JSON object"))
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    if require_rows:
        _require_rows(text.where(strip("value") != "[]"), path)
    doc = text.select("file", F.try_parse_json("value").alias("doc"))
    is_list = F.coalesce(F.schema_of_variant("doc").startswith("ARRAY"), F.lit(False))
    items = doc.where(is_list).select("file", F.posexplode(F.col("doc").cast("array<variant>")).alias("pos", "v"))
    good = items.select("file", (F.col("pos") + 1).cast("long").alias("idx"), entries_of_json(F.to_json("v")).alias("entries"))
    good = good.withColumn("error", F.when(F.col("entries").isNull(), "not a JSON object"))
    bad = doc.where(~is_list).select("file", F.lit(None).cast("long").alias("idx"), F.lit(None).cast(ENTRIES).alias("entries"), F.lit("not a JSON array").alias("error"))
    return good.unionByName(bad)


def read_documents(spark: SparkSession, path: str, schema: str, glob: str | None = None) -> DataFrame:
    """One JSON document per file; unreadable ones are skipped."""
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED")
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    return reader.json(path)


def read_catalog(spark: SparkSession, path: str, glob: str = "manifest.json") -> DataFrame:
    """Manifests of a catalogue, in folder order when sorted by ``folder``."""
    docs = read_documents(spark, path, MANIFEST, glob)
    return docs.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("folder")).where(
        F.col("id").isNotNull() & F.col("name").isNotNull())


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job documents; payload files beside them are left out."""
    docs = read_documents(spark, path, JOB, "*.json")
    return docs.select("*", F.col("_metadata.file_name").alias("_file")).where(
        ~F.col("_file").endswith("_payload.json") & F.col("id").isNotNull()).drop("_file")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit events of JSON lines; blank and malformed lines are skipped."""
    return spark.read.schema(AUDIT).option("mode", "DROPMALFORMED").json(path).where(F.col("audit_id").isNotNull())


def stream_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(AUDIT).option("mode", "DROPMALFORMED").json(path).where(F.col("audit_id").isNotNull())


def read_sessions(spark: SparkSession, path: str, glob: str = "sess_*.json") -> DataFrame:
    return read_documents(spark, path, SESSION, glob)


def read_approvals(spark: SparkSession, path: str, glob: str = "appr_*.json") -> DataFrame:
    return read_documents(spark, path, APPROVAL, glob)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return read_documents(spark, path, PROFILE, "*.json")


def read_api_keys(spark: SparkSession, path: str) -> DataFrame:
    return read_documents(spark, path, API_KEY, "*.json")


def read_cache_documents(spark: SparkSession, path: str) -> DataFrame:
    docs = read_documents(spark, path, CACHE, "*.json")
    return docs.withColumn("cached_at", F.try_to_timestamp("cached_at"))
