"""Text, number and map functions: Column in, Column out, all JVM-side."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from recordflow.functions import fixed


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Without white space of any kind (also tabs, line ends, wide blanks) at either end."""
    return F.btrim(_col(c), F.lit(fixed.WHITE_SPACE))


def sql_strip(text: str) -> str:
    """SQL form of ``strip``, for generated expressions."""
    blanks = "".join(f"\\u{ord(c):04x}" for c in fixed.WHITE_SPACE)
    return f"btrim({text}, '{blanks}')"


def blank_to_null(c) -> Column:
    return F.nullif(_col(c), F.lit(""))


# --- keys -------------------------------------------------------------------

def to_snake(key) -> Column:
    """camelCase and PascalCase to snake_case. Keys without capitals, most of them, skip the patterns."""
    key = _col(key)
    words = F.regexp_replace(key, r"(.)([A-Z][a-z]+)", "$1_$2")
    return F.when(key == F.lower(key), key).otherwise(F.lower(F.regexp_replace(words, r"([a-z0-9])([A-Z])", "$1_$2")))


BUCKETS = 256


def _lookup(table: dict[str, str], kind: str, key: Column) -> Column:
    """Value of a key in a fixed table, written as SQL literals of ``kind``.

    A literal map is searched from its start. The table is therefore dealt into an array of
    small maps by the key's checksum, of which one is looked at.
    """
    dealt: list[list[str]] = [[] for _ in range(BUCKETS)]
    for k, value in table.items():
        dealt[zlib.crc32(k.encode()) % BUCKETS] += [f"'{k}'", value]
    maps = ", ".join(f"map({', '.join(m)})" if m else f"CAST(map() AS MAP<STRING,{kind}>)" for m in dealt)
    at = F.pmod(F.crc32(key.cast("binary")), F.lit(BUCKETS)).cast("int")
    return F.get(F.expr(f"array({maps})"), at)[key]


def canonical_key(key) -> Column:
    """The canonical key of a synonym, other keys unchanged."""
    key = _col(key)
    return F.coalesce(_lookup({k: f"'{v}'" for k, v in fixed.CANONICAL_OF.items()}, "STRING", key), key)


def alias_keys(key) -> Column:
    """A key with all its synonyms, itself first."""
    key = _col(key)
    names = {k: "array(" + ", ".join(f"'{n}'" for n in [k, *also]) + ")" for k, also in fixed.ALIASES.items()}
    return F.coalesce(_lookup(names, "ARRAY<STRING>", key), F.array(key))


def is_question(key) -> Column:
    key = _col(key)
    return (
        key.startswith("question_") | key.startswith("q_") | key.rlike(r"^q\d")
        | (key.contains("__") & ~key.endswith("__notes"))
    )


def question_section(key) -> Column:
    key = _col(key)
    return F.when(key.contains("__"), F.substring_index(key, "__", 1))


def question_name(key) -> Column:
    key = _col(key)
    return F.when(key.contains("__"), F.substring(key, F.locate("__", key) + 2, F.length(key))).otherwise(key)


def has_any(text, parts: Sequence[str]) -> Column:
    return _col(text).rlike("|".join(parts))


def is_sensitive(key) -> Column:
    return has_any(F.lower(_col(key)), fixed.SENSITIVE_PARTS)


def has_any_key(keys, wanted: Sequence[str]) -> Column:
    """Whether an array of keys shares one with a fixed list."""
    return F.arrays_overlap(_col(keys), F.array(*[F.lit(k) for k in wanted]))


# --- values -----------------------------------------------------------------

def _dial(d: Column) -> Column:
    return F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "),
                    F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4))


def normalise_phone(s) -> Column:
    s = _col(s)
    digits = F.regexp_replace(s, r"[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(n == 10, _dial(digits))
        .when((n == 11) & digits.startswith("1"), _dial(F.substring(digits, 2, 10)))
        .otherwise(s)
    )


def normalise_date(s) -> Column:
    """ISO and dd-mm-yyyy to mm/dd/yyyy, by text only."""
    s = strip(_col(s))
    iso = r"\A([0-9]{4})-([0-9]{2})-([0-9]{2})\z"
    dmy = r"\A([0-9]{2})-([0-9]{2})-([0-9]{4})\z"
    return (
        F.when(s.rlike(iso), F.regexp_replace(s, iso, "$2/$3/$1"))
        .when(s.rlike(dmy), F.regexp_replace(s, dmy, "$2/$1/$3"))
        .otherwise(s)
    )


def normalise_bool(s) -> Column:
    s = _col(s)
    word = F.lower(strip(s))
    return (
        F.when(word.isin(fixed.YES_WORDS), "Yes").when(word.isin(fixed.NO_WORDS), "No").otherwise(s)
    )


def sql_bool(text: str) -> str:
    """SQL form of ``normalise_bool``, for generated expressions."""
    words = [", ".join(f"'{w}'" for w in ws) for ws in (fixed.YES_WORDS, fixed.NO_WORDS)]
    return (f"CASE WHEN lower({sql_strip(text)}) IN ({words[0]}) THEN 'Yes' "
            f"WHEN lower({sql_strip(text)}) IN ({words[1]}) THEN 'No' ELSE {text} END")


def normalise_value(key, value, is_bool=None) -> Column:
    """Normalise a text by what its key mentions; blank becomes null.

    ``key`` may be a Python string (decided at planning time) or a Column.
    ``is_bool`` marks values that were native booleans.
    """
    text = blank_to_null(strip(_col(value)))
    plain = text if is_bool is None else F.when(is_bool, normalise_bool(text)).otherwise(text)
    if isinstance(key, str):
        if any(h in key for h in fixed.PHONE_HINTS):
            return normalise_phone(text)
        if any(h in key for h in fixed.DATE_HINTS):
            return normalise_date(text)
        return plain
    return (
        F.when(has_any(key, fixed.PHONE_HINTS), normalise_phone(text))
        .when(has_any(key, fixed.DATE_HINTS), normalise_date(text))
        .otherwise(plain)
    )


def join_present(sep: str, *parts) -> Column:
    """Join the parts that are neither null nor empty; null if none is."""
    return blank_to_null(F.concat_ws(sep, *[blank_to_null(p) for p in parts]))


def full_name(given, first, last, title=None, middle=None, suffix=None, credentials=None) -> Column:
    parts = [p for p in (title, first, middle, last, suffix, credentials) if p is not None]
    first, last = _col(first), _col(last)
    named = F.coalesce(first != "", F.lit(False)) | F.coalesce(last != "", F.lit(False))
    return F.when((F.coalesce(_col(given), F.lit("")) == "") & named, join_present(" ", *parts)).otherwise(_col(given))


def city_state_zip(city, state, postal_code) -> Column:
    return join_present(", ", city, state, postal_code)


def date_range_display(start, end) -> Column:
    return join_present(" – ", start, end)


def variant_text(v) -> Column:
    """The text of a VARIANT; booleans as True / False, objects as JSON."""
    v = _col(v)
    text = v.cast("string")
    return F.when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(text)).otherwise(text)


def variant_is_bool(v) -> Column:
    return F.coalesce(F.schema_of_variant(_col(v)) == "BOOLEAN", F.lit(False))


def cell_to_text(c, kind: str = "string") -> Column:
    """Spreadsheet cell text for a typed column (boolean, integer, double or string)."""
    c = _col(c)
    if kind == "boolean":
        text = F.when(c, "TRUE").otherwise("FALSE")
    elif kind == "double":
        text = F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    else:
        text = strip(c.cast("string"))
    return F.when(c.isNull(), "").otherwise(text)


def output_name(flat, idx, keys: Sequence[str] = fixed.BATCH_NAME_KEYS) -> Column:
    """File name of a filled record from its name values."""
    flat = _col(flat)
    parts = F.filter(F.array(*[F.replace(flat[k], F.lit(" "), F.lit("_")) for k in keys]),
                     lambda x: x.isNotNull() & (x != ""))
    stem = F.when(F.size(parts) > 0, F.array_join(parts, "_")).otherwise(F.concat(F.lit("record_"), _col(idx)))
    return F.concat(F.regexp_replace(stem, r"[^\p{L}\p{N}_-]", ""), F.lit(".pdf"))


def progress_pct(completed, total) -> Column:
    completed, total = _col(completed), _col(total)
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round(completed / F.nullif(total, F.lit(0)) * 100, 1))


def field_kind(ftype, prompt: bool = False) -> Column:
    """text / checkbox / other; textbox / checkbox in the prompt form."""
    ftype = _col(ftype)
    if prompt:
        return F.when(ftype.contains("/Tx"), "textbox").otherwise("checkbox")
    return F.when(ftype.contains("/Tx"), "text").when(ftype.contains("/Btn"), "checkbox").otherwise("other")


def leaf_name(name) -> Column:
    return F.substring_index(_col(name), ".", -1)


def checkbox_state(value) -> Column:
    return F.when(F.lower(strip(_col(value))).isin("yes", "true", "1", "on"), "/Yes").otherwise("/Off")


def slug(name, fallback="signature") -> Column:
    """Lower-case key of at most 40 characters."""
    fallback = F.lit(fallback) if isinstance(fallback, str) else fallback
    named = F.when(F.coalesce(_col(name), F.lit("")) == "", fallback).otherwise(_col(name))
    return F.substring(F.regexp_replace(F.lower(named), "[^a-z0-9]", "_"), 1, 40)


def safe_name(s, default: str = "merged") -> Column:
    named = F.coalesce(blank_to_null(s), F.lit(default))
    kept = F.substring(F.regexp_replace(named, r"[^\p{L}\p{N}_-]", ""), 1, 60)
    return F.coalesce(blank_to_null(kept), F.lit(default))


def normalise_profile_type(s) -> Column:
    return F.replace(F.lower(strip(_col(s))), F.lit(" "), F.lit("_"))


def safe_request_id(s) -> Column:
    s = strip(_col(s))
    return F.when(s.rlike(r"\A[A-Za-z0-9_-]{8,128}\z"), s)


def host_class(url) -> Column:
    """private for loopback, private ranges and local suffixes, else external."""
    raw = F.lower(F.try_parse_url(_col(url), F.lit("HOST")))
    host = F.regexp_replace(raw, r"^\[|\]$", "")
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    v4 = (
        rf"^(127|10)(\.{octet}){{3}}$"
        rf"|^172\.(1[6-9]|2[0-9]|3[01])(\.{octet}){{2}}$"
        rf"|^192\.168(\.{octet}){{2}}$"
    )
    private = (
        host.isin("localhost", "127.0.0.1", "::1", "0.0.0.0")
        | host.rlike(v4)
        | (raw.startswith("[") & host.rlike(r"^(fd[0-9a-f]{2}:|(0{1,4}:){7}0{0,3}1$)"))
        | host.rlike(r"\.(local|internal|lan)$")
    )
    return F.when(F.coalesce(private, F.lit(False)), "private").otherwise("external")


# --- maps and digests ---------------------------------------------------------

def data_preview(data) -> Column:
    """Profile data without protected values."""
    return F.map_filter(_col(data), lambda k, _: ~k.endswith("_encrypted"))


def _sorted_pairs(m: Column) -> Column:
    pairs = F.array_sort(F.map_entries(m))
    return F.array_join(
        F.transform(pairs, lambda e: F.concat(e["key"], F.lit("\x1f"), F.coalesce(e["value"], F.lit("")))), "\x1e")


def fingerprint(labels, data=None) -> Column:
    """32 hex characters over labels and data, whatever the order of their keys."""
    user = F.lit("") if data is None else F.coalesce(_sorted_pairs(_col(data)), F.lit(""))
    return F.substring(F.sha2(F.concat(_sorted_pairs(_col(labels)), F.lit("\x00"), user), 256), 1, 32)


def content_hash(content) -> Column:
    return F.sha2(_col(content), 256)
