"""The canonical record: schema, parsing, validation, derived fields, question gating.

Everything happens inside one row with Column expressions, so a record never
crosses a shuffle on its way from raw entries to its canonical form.
"""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from recordflow.functions import fixed, scalars as S
from recordflow.operators import records as R

# --- schema -------------------------------------------------------------------
# A leaf is a (kind, default, allowed) triple; nested ones are dicts, lists of
# either are in a list.


@dataclass(frozen=True)
class Leaf:
    kind: str = "string"
    required: bool = False
    default: object = None
    allowed: tuple[str, ...] = dc_field(default=())


def _enum(*allowed: str, **kw) -> Leaf:
    return Leaf(allowed=allowed, **kw)


TEXT, NEEDED = Leaf(), Leaf(required=True)
INT, BOOL, CUSTOM, IDENTIFIERS = Leaf("int"), Leaf("boolean"), Leaf("custom"), Leaf("identifiers")


def _texts(*names: str) -> dict:
    return {n: TEXT for n in names}


# Fields, enumerations and defaults of the canonical record.
ADDRESS = {**_texts("line1", "line2", "city", "state", "postal_code"), "country": Leaf(default="US"), "custom": CUSTOM}
CONTACT = {**_texts("phone", "phone_alt", "fax", "email"), "custom": CUSTOM}
PERSON = {
    **_texts("first_name", "middle_name", "last_name", "full_name", "suffix", "title", "credentials", "dob", "ssn"),
    "gender": _enum("M", "F", "X", "U"), "marital_status": _enum("single", "married", "mfs", "hoh", "qw"),
    "identifiers": IDENTIFIERS, "address": ADDRESS, "contact": CONTACT, "relationship_to_primary": TEXT, "custom": CUSTOM,
}
PROVIDER = {**PERSON, **_texts("npi", "dea", "tax_id", "license_number", "specialty")}
ORGANIZATION = {**_texts("name", "tax_id", "npi"), "identifiers": IDENTIFIERS, "address": ADDRESS, "contact": CONTACT, "custom": CUSTOM}
DIAGNOSIS = {"code": NEEDED, "code_system": _enum("ICD10", "ICD9", "SNOMED", default="ICD10"),
             **_texts("description", "onset_date"), "primary": Leaf("boolean", default=False)}
MEDICATION = {"name": NEEDED, **_texts("j_code", "ndc", "strength", "dose", "frequency", "route", "quantity"),
              "days_supply": INT, "refills": INT, "sig": TEXT}
PROCEDURE = {"cpt_code": NEEDED, **_texts("description", "date_of_service")}
PRIOR_THERAPY = {"medication": NEEDED, **_texts("duration", "start_date", "end_date"),
                 "outcome": _enum("failed", "intolerant", "contraindicated", "ineffective"), "notes": TEXT}
BENEFIT_TYPES = ("pharmacy", "medical", "dme", "both")
REQUEST_TYPES = ("initial", "renewal", "continuation", "appeal", "urgent")
MEDICAL = {
    "diagnoses": [DIAGNOSIS], "medications": [MEDICATION], "procedures": [PROCEDURE], "service_dates": _texts("start", "end"),
    "benefit_type": _enum(*BENEFIT_TYPES), "request_type": _enum(*REQUEST_TYPES), **_texts("indication", "clinical_notes"),
    "prior_therapies": [PRIOR_THERAPY], "contraindications": [TEXT], "allergies": [TEXT], "custom": CUSTOM,
}
TAX = {"tax_year": INT, **_texts("filing_status", "claim_dependents_amount", "other_income", "deductions", "extra_withholding"),
       "multiple_jobs": BOOL, "exempt": BOOL, "custom": CUSTOM}
INSURANCE = {**_texts("carrier", "plan_name", "policy_number", "group_number"), "subscriber": PERSON,
             **_texts("effective_date", "termination_date"), "coverage_type": _enum("primary", "secondary", "tertiary"), "custom": CUSTOM}
EMPLOYMENT = {"employer": ORGANIZATION, **_texts("job_title", "start_date", "end_date"),
              "employment_type": _enum("full_time", "part_time", "contract", "intern"), "income": TEXT,
              "pay_frequency": _enum("hourly", "weekly", "biweekly", "monthly", "annual"), "custom": CUSTOM}
SIGNATURE = {"signer_role": _enum("primary", "prescriber", "guardian", "witness", "agent", "employer", required=True),
             **_texts("signer_name", "date", "signature_text")}
QUESTION = {"value": Leaf("answer", required=True), **_texts("section", "notes"), "applicable": Leaf("boolean", default=True)}
FORM_CONTEXT = {**_texts("form_name", "form_version", "indication", "request_type"), "language": Leaf(default="en"), "submission_date": TEXT}
RECORD = {
    "primary": PERSON, "secondary": PERSON, "dependents": [PERSON], "provider": PROVIDER, "organization": ORGANIZATION,
    "facility": ORGANIZATION, "medical": MEDICAL, "tax": TAX, "insurance": INSURANCE, "employment": EMPLOYMENT,
    "questions": {"*": QUESTION}, "signatures": [SIGNATURE], "form_context": FORM_CONTEXT, "custom": CUSTOM,
}

_LEAF_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "answer": T.VariantType(),
               "custom": T.MapType(T.StringType(), T.VariantType()), "identifiers": T.MapType(T.StringType(), T.StringType())}


def spark_type(spec, raw: bool = False) -> T.DataType:
    """Spark type of a spec; ``raw`` keeps single values as VARIANT, to be checked."""
    if isinstance(spec, Leaf):
        if not raw or spec.kind == "custom":
            return _LEAF_TYPES[spec.kind]
        return T.MapType(T.StringType(), T.VariantType()) if spec.kind == "identifiers" else T.VariantType()
    if isinstance(spec, list):
        return T.ArrayType(spark_type(spec[0], raw))
    if "*" in spec:
        return T.MapType(T.StringType(), spark_type(spec["*"], raw))
    return T.StructType([T.StructField(k, spark_type(v, raw)) for k, v in spec.items()])


CANONICAL = spark_type(RECORD)


# The expressions below enumerate the schema, so they are generated as SQL text:
# one parse in the JVM instead of thousands of calls into it.

def _ddl(spec) -> str:
    return spark_type(spec).simpleString()


def _quoted(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def text_of(v: str) -> str:
    """SQL for the text of a VARIANT, see ``scalars.variant_text``."""
    return f"CASE WHEN schema_of_variant({v}) = 'BOOLEAN' THEN initcap(CAST({v} AS STRING)) ELSE CAST({v} AS STRING) END"


# --- validation ----------------------------------------------------------------

def _leaf_bad(v: str, leaf: Leaf) -> str | None:
    """SQL that is true where a VARIANT does not fit a leaf."""
    if leaf.kind == "custom":
        return None
    if leaf.kind == "identifiers":
        return f"exists(map_values({v}), x -> schema_of_variant(x) <> 'STRING')"
    kind, text = f"schema_of_variant({v})", f"CAST({v} AS STRING)"
    bit = f"{kind} = 'BIGINT' AND {text} IN ('0', '1')"
    if leaf.kind == "int":
        fits = f"{kind} = 'BIGINT' OR ({kind} = 'STRING' AND {text} RLIKE '^ *[+-]?[0-9]+ *$')"
    elif leaf.kind == "boolean":
        fits = f"{kind} = 'BOOLEAN' OR ({bit})"
    elif leaf.kind == "answer":
        fits = f"{kind} IN ('STRING', 'BOOLEAN') OR ({bit})"
    else:
        fits = f"{kind} = 'STRING'" + (f" AND {text} IN ({_quoted(leaf.allowed)})" if leaf.allowed else "")
    if not leaf.required and leaf.default is None:
        fits = f"({fits}) OR {kind} = 'VOID'"
    return f"CASE WHEN {v} IS NULL THEN {str(leaf.required).lower()} ELSE NOT ({fits}) END"


def _first(items: str) -> str:
    return f"get(filter({items}, e -> e IS NOT NULL), 0)"


def violations(v: str, spec, path: str, depth: int = 0) -> list[str]:
    """SQL texts giving the path of a value that does not fit, null where all do."""
    if isinstance(spec, Leaf):
        bad = _leaf_bad(v, spec)
        return [] if bad is None else [f"CASE WHEN {bad} THEN '{path}' END"]
    if isinstance(spec, list) or "*" in spec:
        item, values = (spec[0], v) if isinstance(spec, list) else (spec["*"], f"map_values({v})")
        x = f"x{depth}"
        inner = _first(f"array({', '.join(violations(x, item, path, depth + 1))})")
        return [_first(f"transform({values}, {x} -> {inner})")]
    checks = [c for k, s in spec.items() for c in violations(f"{v}.{k}", s, f"{path}.{k}" if path else k, depth)]
    return [f"CASE WHEN {v} IS NOT NULL THEN {_first(f'array({chr(44).join(checks)})')} END"]


# --- nested input ----------------------------------------------------------------

def _with_defaults(v: str, spec, depth: int = 0) -> str:
    """SQL that fills defaults and derives names in a typed value."""
    if isinstance(spec, Leaf):
        if spec.kind in ("custom", "identifiers"):
            return f"coalesce({v}, CAST(map() AS {_ddl(spec)}))"
        return v if spec.default is None else f"coalesce({v}, {_literal(spec.default)})"
    x = f"x{depth}"
    if isinstance(spec, list):
        out = v if isinstance(spec[0], Leaf) else f"transform({v}, {x} -> {_with_defaults(x, spec[0], depth + 1)})"
        return f"coalesce({out}, CAST(array() AS {_ddl(spec)}))"
    if "*" in spec:
        inner = f"transform_values({v}, (k{depth}, {x}) -> {_with_defaults(x, spec['*'], depth + 1)})"
        return f"coalesce({inner}, CAST(map() AS {_ddl(spec)}))"
    fields = {k: _with_defaults(f"{v}.{k}", s, depth) for k, s in spec.items()}
    if "marital_status" in spec:
        parts = [f"{v}.{p}" for p in ("title", "first_name", "middle_name", "last_name", "suffix", "credentials")]
        fields["full_name"] = _full_name(f"{v}.full_name", f"{v}.first_name", f"{v}.last_name", parts)
    return f"CASE WHEN {v} IS NOT NULL THEN {_named(fields)} END"


def _literal(value) -> str:
    return str(value).lower() if isinstance(value, bool) else f"'{value}'"


def _named(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {e}" for k, e in fields.items()) + ")"


def _full_name(given: str, first: str, last: str, parts: list[str]) -> str:
    joined = ", ".join(f"nullif({p}, '')" for p in parts)
    return (f"CASE WHEN coalesce({given}, '') = '' AND (coalesce({first}, '') <> '' OR coalesce({last}, '') <> '') "
            f"THEN concat_ws(' ', {joined}) ELSE {given} END")


# --- flat input --------------------------------------------------------------------

def _struct(spec: dict, **given: str) -> str:
    """SQL for a struct of a spec with some members given and defaults elsewhere."""
    fields = {}
    for k, s in spec.items():
        empty = isinstance(s, (Leaf, list)) or "*" in s
        value = given.get(k, f"CAST(NULL AS {_ddl(s)})")
        fields[k] = _with_defaults(value, s) if empty and k not in given else value
    return _named(fields)


def _present(*items: tuple[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN {cond} THEN {item} END" for cond, item in items)
    return f"filter(array({cases}), e -> e IS NOT NULL)"


def promote_flat(flat: str, text: str) -> str:
    """SQL for the canonical record of resolved entries: ``flat`` names a MAP<STRING,VARIANT>,
    ``text`` a MAP<STRING,STRING> of its trimmed texts."""
    def g(k: str) -> str:
        return f"{text}['{k}']"

    def has(k: str) -> str:
        return f"coalesce({g(k)} <> '', false)"

    member = f"map_filter(map('member_id', {g('patient_id')}), (k, v) -> coalesce(v <> '', false))"
    primary = _struct(
        PERSON, first_name=g("patient_first_name"), last_name=g("patient_last_name"), dob=g("patient_dob"), ssn=g("patient_ssn"),
        full_name=_full_name(g("patient_name"), g("patient_first_name"), g("patient_last_name"), [g("patient_first_name"), g("patient_last_name")]),
        contact=_struct(CONTACT, phone=g("patient_phone")), identifiers=member,
        address=_struct(ADDRESS, line1=g("patient_address"), city=g("patient_city"), state=g("patient_state"), postal_code=g("patient_zip")))
    provider = _struct(
        PROVIDER, full_name=g("physician_name"), npi=g("physician_npi"),
        contact=_struct(CONTACT, phone=g("physician_phone"), fax=g("physician_fax")),
        address=_struct(ADDRESS, line1=g("physician_address"), city=g("physician_city"), state=g("physician_state"), postal_code=g("physician_zip")))
    diagnoses = _present(
        (has("icd_code"), _struct(DIAGNOSIS, code=g("icd_code"), description=g("diagnosis"), primary="true")),
        (has("icd_code_2"), _struct(DIAGNOSIS, code=g("icd_code_2"))))
    medications = _present((has("drug_name"), _struct(
        MEDICATION, name=g("drug_name"), j_code=g("drug_j_code"), strength=g("drug_strength"), frequency=g("drug_frequency"),
        quantity=g("drug_quantity"), sig=g("drug_sig"))))
    procedures = _present(*[(has(f"cpt_code_{i}"), _struct(PROCEDURE, cpt_code=g(f"cpt_code_{i}"))) for i in range(1, 5)])
    dates = MEDICAL["service_dates"]
    service = (f"CASE WHEN {has('dates_of_service')} THEN {_struct(dates, start=g('dates_of_service'))} "
               f"WHEN {has('service_start_date')} OR {has('service_end_date')} "
               f"THEN {_struct(dates, start=g('service_start_date'), end=g('service_end_date'))} END")
    medical = _struct(
        MEDICAL, diagnoses=diagnoses, medications=medications, procedures=procedures, service_dates=service, benefit_type=g("benefit_type"),
        request_type=g("request_type"), indication=g("indication"), clinical_notes=g("clinical_notes"))
    section = "CASE WHEN contains(e.key, '__') THEN substring_index(e.key, '__', 1) END"
    answer = _struct(QUESTION, value="e.value", section=section, applicable="true")
    questions = (f"map_from_entries(transform(filter(map_entries({flat}), e -> {QUESTION_KEY.format(k='e.key')}), "
                 f"e -> named_struct('key', {QUESTION_NAME.format(k='e.key')}, 'value', {answer})))")
    signatures = _present((f"{has('signature_date')} OR {has('prescriber_signature')}", _struct(
        SIGNATURE, signer_role="'prescriber'", signer_name=g("physician_name"), date=g("signature_date"), signature_text=g("prescriber_signature"))))
    return _struct(
        RECORD, primary=primary, provider=provider, facility=_struct(ORGANIZATION, name=g("facility_name"), npi=g("facility_npi")),
        medical=medical, questions=questions, signatures=signatures,
        form_context=_struct(FORM_CONTEXT, indication=g("indication"), request_type=g("request_type")), custom=leftovers(flat))


QUESTION_KEY = "({k} RLIKE '^(question_|q_|q[0-9])' OR (contains({k}, '__') AND NOT endswith({k}, '__notes')))"
QUESTION_NAME = "CASE WHEN contains({k}, '__') THEN substring({k}, locate('__', {k}) + 2) ELSE {k} END"
PLACED = f"({_quoted(fixed.PLACED_KEYS)})"


def leftovers(flat: str) -> str:
    """SQL for the entries that are neither placed nor questions."""
    return f"map_filter({flat}, (k, v) -> k NOT IN {PLACED} AND NOT {QUESTION_KEY.format(k='k')})"


def split_entries(df: DataFrame, entries: str = "entries") -> DataFrame:
    """Split resolved entries into placed, question and custom ones."""
    flat = R.stage(df, _flat=R.as_map(R.resolve_keys(entries)))
    return flat.select(
        *df.columns, F.expr(f"map_filter(_flat, (k, v) -> k IN {PLACED})").alias("placed"),
        F.expr(f"map_filter(_flat, (k, v) -> k NOT IN {PLACED} AND {QUESTION_KEY.format(k='k')})").alias("questions"),
        F.expr(leftovers("_flat")).alias("custom"))


def flat_violations(flat: str, text: str) -> str:
    """SQL for the first member of a flat record that its enumeration or answer type refuses."""
    def wrong(k: str, allowed: tuple[str, ...]) -> str:
        return f"CASE WHEN {text}['{k}'] NOT IN ({_quoted(allowed)}) THEN 'medical.{k}' END"
    bad = f"filter(map_entries({flat}), e -> {QUESTION_KEY.format(k='e.key')} AND {_leaf_bad('e.value', QUESTION['value'])})"
    return (f"coalesce({wrong('benefit_type', BENEFIT_TYPES)}, {wrong('request_type', REQUEST_TYPES)}, "
            f"'questions.' || get(transform({bad}, e -> {QUESTION_NAME.format(k='e.key')}), 0))")


def parse(records: DataFrame, keep_unknown: bool = False, entries: str = "entries", shape: str = "auto", error_only: bool = False) -> DataFrame:
    """Add ``canonical`` and ``error``; with ``error_only`` no canonical record is made.

    A record with a nested key is read as nested; where that does not validate,
    it is read as flat like any other. ``error`` names the member that made a flat record
    fail; its ``canonical`` is null. Keys that the schema lacks are dropped from
    nested input; ``keep_unknown`` puts top-level ones into ``custom``.
    ``shape='flat'`` is for sources that cannot hold nested values (CSV, workbooks):
    their records never validate as nested, so that branch is left out of the plan.
    """
    if shape not in ("auto", "flat"):
        raise ValueError("shape must be 'auto' or 'flat'")
    resolved = R.as_map(R.resolve_keys(entries))
    texts = F.expr(f"transform_values(_flat, (k, v) -> {S.sql_strip(text_of('v'))})")
    flat_error, promoted = F.expr(flat_violations("_flat", "_text")), F.expr(promote_flat("_flat", "_text"))
    if shape == "flat":
        read = R.stage(R.stage(R.stage(records, _flat=resolved), _text=texts), error=flat_error)
        if error_only:
            return read.drop("_flat", "_text")
        return R.stage(read, canonical=F.when(F.col("error").isNull(), promoted)).drop("_flat", "_text")
    keys = F.transform(entries, lambda e: e["key"])
    raw_type = T.StructType([*spark_type(RECORD, raw=True).fields, T.StructField("_corrupt", T.StringType())])
    nested_json = F.when(S.has_any_key(keys, fixed.NESTED_KEYS), F.to_json(R.as_map(entries)))
    raw = F.from_json("_json", raw_type, {"columnNameOfCorruptRecord": "_corrupt"})
    wrong = F.expr(
        "CASE WHEN _json IS NOT NULL THEN CASE WHEN _raw IS NULL OR _raw._corrupt IS NOT NULL THEN 'not readable' "
        f"ELSE {violations('_raw', RECORD, '')[0]} END END")
    staged = R.stage(R.stage(records, _json=nested_json), _raw=raw)
    staged = R.stage(staged, _is_nested=F.col("_json").isNotNull() & wrong.isNull()).drop("_raw")
    staged = R.stage(staged, _flat=F.when(~F.col("_is_nested"), resolved), _typed=F.when(F.col("_is_nested"), F.from_json("_json", CANONICAL)))
    staged = R.stage(R.stage(staged, _text=texts), error=F.when(~F.col("_is_nested"), flat_error))
    if error_only:
        return staged.drop("_json", "_is_nested", "_flat", "_text", "_typed")
    nested = F.expr(_with_defaults("_typed", RECORD))
    if keep_unknown:
        extra = F.map_filter(R.as_map(entries), lambda k, _: ~k.isin(list(RECORD)))
        nested = nested.withField("custom", F.map_concat(extra, nested["custom"]))
    canonical = F.when(F.col("_is_nested"), nested).when(F.col("error").isNull(), promoted)
    return R.stage(staged, canonical=canonical).drop("_json", "_is_nested", "_flat", "_text", "_typed")


def validate(records: DataFrame, keep_unknown: bool = False) -> tuple[DataFrame, DataFrame]:
    """Parsed records as (good, errors)."""
    parsed = parse(records, keep_unknown)
    return parsed.where(F.col("error").isNull()), parsed.where(F.col("error").isNotNull()).drop("canonical")


# --- derived fields, gating ---------------------------------------------------------

def _put(custom: Column, *pairs: tuple[str, Column]) -> Column:
    """Set text entries in a custom map; null texts are left out."""
    added = F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v.cast("string") for _, v in pairs])),
        lambda _, v: v.isNotNull())
    return F.map_concat(custom, F.transform_values(added, lambda _, v: v.cast("variant")))


def _derived(c: Column) -> Column:
    def with_csz(person: Column, role: str) -> Column:
        a = person["address"]
        csz = S.city_state_zip(a["city"], a["state"], a["postal_code"])
        return F.when(csz.isNotNull(), person.withField("custom", _put(person["custom"], (f"{role}_city_state_zip", csz)))).otherwise(person)

    med = c["medical"]
    main = F.get(F.filter(med["diagnoses"], lambda d: d["primary"]), F.lit(0))
    drug = F.get(med["medications"], F.lit(0))
    shortcuts = _put(
        med["custom"], ("primary_icd_code", main["code"]), ("primary_diagnosis", S.blank_to_null(main["description"])),
        ("primary_drug_name", drug["name"]), ("primary_drug_sig", S.blank_to_null(drug["sig"])),
        ("service_dates_display", S.date_range_display(med["service_dates"]["start"], med["service_dates"]["end"])))
    signed = S.blank_to_null(F.get(c["signatures"], F.lit(0))["date"])
    return (
        c.withField("primary", with_csz(c["primary"], "primary"))
        .withField("provider", with_csz(c["provider"], "provider"))
        .withField("medical", F.when(med.isNotNull(), med.withField("custom", shortcuts)))
        .withField("custom", _put(c["custom"], ("signature_date", signed)))
    )


def _gated(c: Column) -> Column:
    indication = F.coalesce(S.blank_to_null(c["form_context"]["indication"]), S.blank_to_null(c["medical"]["indication"]))
    return gate(c["questions"], indication)


def _replace(df: DataFrame, column: str, new) -> DataFrame:
    """Replace the canonical column, computing it once per row."""
    c = F.col("_before")
    return R.stage(df.withColumnRenamed(column, "_before"), **{column: F.when(c.isNotNull(), new(c))}).drop("_before")


def derive(df: DataFrame, column: str = "canonical") -> DataFrame:
    """Add the shortcuts: city/state/zip, primary diagnosis, first medication, dates, signature date."""
    return _replace(df, column, _derived)


def gate(questions: Column, indication: Column) -> Column:
    """Applicable questions whose section fits the indication."""
    wanted = F.replace(F.lower(S.blank_to_null(indication)), F.lit(" "), F.lit("_"))

    def keep(_: Column, q: Column) -> Column:
        section = F.lower(S.blank_to_null(q["section"]))
        free = wanted.isNull() | section.isNull()
        return F.coalesce(q["applicable"], F.lit(True)) & (
            free | section.isin(fixed.SHARED_SECTIONS) | F.coalesce(section.startswith(wanted), F.lit(False)))

    return F.map_filter(questions, keep)


def gate_questions(df: DataFrame, column: str = "canonical") -> DataFrame:
    """Drop questions that do not apply; the form's indication goes before the medical one."""
    return _replace(df, column, lambda c: c.withField("questions", _gated(c)))


def derive_and_gate(df: DataFrame, column: str = "canonical") -> DataFrame:
    """Both in one pass over the record."""
    return _replace(df, column, lambda c: _derived(c).withField("questions", _gated(c)))
