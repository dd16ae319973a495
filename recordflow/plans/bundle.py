"""Canonical records to flat bundles with all synonyms, and to structured JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordflow.functions import fixed, scalars as S
from recordflow.operators import records as R
from recordflow.plans import canonical as C

def _put(key: str, value: str, keys: list[str] | None = None, is_bool: str = "false") -> str:
    """SQL for one emission. The synonyms of a fixed key are written out at planning
    time (``keys``); those of a computed key are looked up later."""
    names = "CAST(NULL AS ARRAY<STRING>)" if keys is None else "array(" + ", ".join(f"'{k}'" for k in keys) + ")"
    return f"named_struct('keys', {names}, 'key', {key}, 'value', {value}, 'is_bool', {is_bool})"


def _fixed(key: str, value: str) -> str:
    return _put(f"'{key}'", value, [key, *fixed.ALIASES.get(key, [])])


def _some(*puts: str) -> str:
    return f"array({', '.join(puts)})"


def _custom(custom: str) -> str:
    put = _put("e.key", C.text_of("e.value"), is_bool="coalesce(schema_of_variant(e.value) = 'BOOLEAN', false)")
    return f"transform(map_entries({custom}), e -> {put})"


def number_items(arr: str, *stems: tuple[str, str], always: bool = False) -> str:
    """SQL for the emissions of a list of structs, member by member within each item.

    The first item goes under the stem itself, the others under ``_2``, ``_3`` …;
    with ``always`` the first is numbered too.
    """
    end = "'_' || (i + 1)" if always else "CASE WHEN i = 0 THEN '' ELSE '_' || (i + 1) END"
    puts = ", ".join(_put(f"'{stem}' || {end}", f"x.{member}") for stem, member in stems)
    return f"flatten(transform({arr}, (x, i) -> array({puts})))"


def _csz(a: str) -> str:
    return f"nullif(concat_ws(', ', nullif({a}.city, ''), nullif({a}.state, ''), nullif({a}.postal_code, '')), '')"


def emissions(c: str) -> str:
    """SQL for all emissions of a canonical record in order; later ones overwrite earlier ones."""
    p, pr, med = f"{c}.primary", f"{c}.provider", f"{c}.medical"
    none = f"filter({_some(_fixed('patient_id', chr(39) * 2))}, e -> false)"
    identifiers = (f"flatten(transform(map_entries({p}.identifiers), e -> concat({_some(_put(chr(39) + 'patient_' + chr(39) + ' || e.key', 'e.value'))}, "
                   f"CASE WHEN e.key = 'member_id' THEN {_some(_fixed('patient_id', 'e.value'))} ELSE {none} END)))")
    dates = f"nullif(concat_ws(' – ', nullif({med}.service_dates.start, ''), nullif({med}.service_dates.end, '')), '')"
    answer = S.sql_bool(C.text_of("e.value.value"))
    prefixed = "CASE WHEN nullif(e.value.section, '') IS NOT NULL THEN e.value.section || '__' || e.key ELSE e.key END"
    questions = (f"flatten(transform(map_entries({c}.questions), e -> "
                 f"{_some(_put(prefixed, answer), _put('e.key', answer), _put('e.key || ' + chr(39) + '__notes' + chr(39), 'e.value.notes'))}))")
    signatures = (f"flatten(transform({c}.signatures, s -> "
                  f"{_some(_fixed('signature_date', 's.date'), _fixed('prescriber_signature', 's.signature_text'), _put('s.signer_role || ' + chr(39) + '_signature_name' + chr(39), 's.signer_name'))}))")
    parts = [
        _some(_fixed("patient_name", f"{p}.full_name"), _fixed("patient_first_name", f"{p}.first_name"),
              _fixed("patient_last_name", f"{p}.last_name"), _fixed("patient_dob", f"{p}.dob"), _fixed("patient_ssn", f"{p}.ssn")),
        identifiers,
        _some(_fixed("patient_phone", f"{p}.contact.phone"), _fixed("patient_address", f"{p}.address.line1"),
              _fixed("patient_city", f"{p}.address.city"), _fixed("patient_state", f"{p}.address.state"),
              _fixed("patient_zip", f"{p}.address.postal_code"), _fixed("patient_city_state_zip", _csz(f"{p}.address"))),
        _custom(f"{p}.custom"),
        _some(_fixed("physician_name", f"{pr}.full_name"), _fixed("physician_npi", f"{pr}.npi"), _fixed("physician_phone", f"{pr}.contact.phone"),
              _fixed("physician_fax", f"{pr}.contact.fax"), _fixed("physician_address", f"{pr}.address.line1"),
              _fixed("physician_city_state_zip", _csz(f"{pr}.address"))),
        _custom(f"{pr}.custom"),
        _some(_fixed("facility_name", f"{c}.facility.name"), _fixed("facility_npi", f"{c}.facility.npi"),
              _fixed("benefit_type", f"{med}.benefit_type"), _fixed("request_type", f"{med}.request_type"),
              _fixed("indication", f"{med}.indication"), _fixed("clinical_notes", f"{med}.clinical_notes"), _fixed("dates_of_service", dates)),
        number_items(f"{med}.diagnoses", ("icd_code", "code"), ("diagnosis", "description")),
        number_items(f"{med}.medications", ("drug_name", "name"), ("drug_j_code", "j_code"), ("drug_strength", "strength"),
                     ("drug_frequency", "frequency"), ("drug_quantity", "quantity"), ("drug_sig", "sig")),
        number_items(f"{med}.procedures", ("cpt_code", "cpt_code"), always=True),
        _custom(f"{med}.custom"), questions, signatures, _custom(f"{c}.custom"),
    ]
    return "concat(" + ", ".join(f"coalesce({x}, {none})" for x in parts) + ")"


def flatten(df: DataFrame, column: str = "canonical", out: str = "flat") -> DataFrame:
    """Add the flat MAP<STRING,STRING> with every synonym."""
    def normalise(e: Column) -> Column:
        return F.struct(F.coalesce(e["keys"], S.alias_keys(e["key"])).alias("keys"),
                        S.normalise_value(e["key"], e["value"], e["is_bool"]).alias("value"))

    present = F.filter(F.expr(emissions(column)), lambda e: F.coalesce(e["value"] != "", F.lit(False)))
    kept = F.filter(F.transform(present, normalise), lambda e: F.coalesce(e["value"] != "", F.lit(False)))
    pairs = F.flatten(F.transform(kept, lambda e: F.transform(e["keys"], lambda k: F.struct(k.alias("key"), e["value"].alias("value")))))
    return R.stage(df, **{out: F.when(F.col(column).isNotNull(), F.map_from_entries(pairs))})


def _without_defaults(v: str, spec, depth: int = 0) -> str:
    """SQL that nulls out what equals its default, so that JSON leaves it out."""
    x = f"x{depth}"
    if isinstance(spec, C.Leaf):
        if spec.kind in ("custom", "identifiers"):
            return f"CASE WHEN size({v}) > 0 THEN {v} END"
        return v if spec.default is None else f"nullif({v}, {C._literal(spec.default)})"
    if isinstance(spec, list):
        inner = v if isinstance(spec[0], C.Leaf) else f"transform({v}, {x} -> {_without_defaults(x, spec[0], depth + 1)})"
        return f"CASE WHEN size({v}) > 0 THEN {inner} END"
    if "*" in spec:
        return (f"CASE WHEN size({v}) > 0 THEN transform_values({v}, (k{depth}, {x}) -> "
                f"{_without_defaults(x, spec['*'], depth + 1)}) END")
    return f"CASE WHEN {v} IS NOT NULL THEN {C._named({k: _without_defaults(f'{v}.{k}', s, depth) for k, s in spec.items()})} END"


def structured(df: DataFrame, column: str = "canonical", out: str = "structured") -> DataFrame:
    """Add the record as JSON without nulls and defaults."""
    return df.withColumn(out, F.to_json(F.expr(_without_defaults(column, C.RECORD))))


def to_bundle(records: DataFrame, base: DataFrame | None = None, on: str = "profile_id", keep_unknown: bool = False,
              with_structured: bool = True, shape: str = "auto", with_flat: bool = True) -> DataFrame:
    """Records to bundles: overlay, parse, derive, gate, flatten.

    Adds ``flat``, ``structured`` and ``error``, the first two only where asked for: what is costly
    is not computed to be dropped. Only the join with ``base`` can shuffle; the rest
    is one projection.
    """
    merged = records if base is None else R.overlay(records, base, on)
    if not with_flat and not with_structured:
        return C.parse(merged, keep_unknown, shape=shape, error_only=True)
    if not with_flat:
        return structured(C.derive_and_gate(C.parse(merged, keep_unknown, shape=shape))).drop("canonical")
    done = flatten(C.derive_and_gate(C.parse(merged, keep_unknown, shape=shape)))
    if with_structured:
        done = structured(done)
    return done.drop("canonical")
