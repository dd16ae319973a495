"""Vocabularies and limits that results depend on."""

from __future__ import annotations

# What counts as white space at the ends of a text.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# Canonical key -> synonyms.
ALIASES: dict[str, list[str]] = {
    # patient
    "patient_name": ["enrollees_name", "members_name", "name", "full_name",
                     "patient_full_name", "member_name", "insured_name"],
    "patient_first_name": ["first_name", "enrollee_first_name"],
    "patient_last_name": ["last_name", "enrollee_last_name"],
    "patient_dob": ["dob", "date_of_birth", "birthdate", "birth_date",
                    "enrollee_dob", "member_dob"],
    "patient_id": ["member_id", "enrollee_id", "plan_id", "policy_number",
                   "patient_member_id", "enrollees_member_id"],
    "patient_ssn": ["ssn", "social_security", "taxpayer_id"],
    "patient_phone": ["phone", "patient_phone_number", "enrollee_phone"],
    "patient_address": ["address", "home_address", "street_address"],
    "patient_city": ["city", "patient_city"],
    "patient_state": ["state", "patient_state"],
    "patient_zip": ["zip", "zip_code", "postal_code"],
    "patient_city_state_zip": ["city_state_zip"],
    # physician
    "physician_name": ["prescriber_name", "provider_name", "doctor_name",
                       "prescribers_name", "name_and_npi", "prescriber_name_npi"],
    "physician_npi": ["npi", "prescriber_npi", "provider_npi", "name_and_npi_number"],
    "physician_phone": ["office_phone", "prescriber_phone", "provider_phone",
                        "doctor_phone", "physician_office_phone"],
    "physician_fax": ["fax", "prescriber_fax", "provider_fax"],
    "physician_address": ["prescriber_address", "provider_address"],
    "physician_city_state_zip": ["prescriber_city_state_zip"],
    # facility
    "facility_name": ["provider_facility_name", "facility", "clinic_name"],
    "facility_npi": ["provider_facility_npi", "facility_npi"],
    # drug
    "drug_name": ["medication_name", "medication_j_code", "drug_requested",
                  "medication", "drug"],
    "drug_j_code": ["j_code", "medication_j_code"],
    "drug_strength": ["strength", "dose", "strength_units", "units_per_dose",
                      "strength_units_per_dose"],
    "drug_frequency": ["frequency", "frequency_of_administration", "frequency_per_dose"],
    "drug_sig": ["directions", "directions_for_administration", "sig",
                 "dosing_instructions"],
    "drug_quantity": ["quantity", "qty", "qty_fill", "qty_per_fill", "quantity_per_fill"],
    "benefit_type": ["pharmacy_or_medical_benefit", "benefit", "drug_obtained_via"],
    # diagnosis
    "diagnosis": ["diagnosis_description", "primary_diagnosis"],
    "icd_code": ["icd_10_code", "icd10_code", "icd_code_1", "primary_icd_code",
                 "diagnosis_code"],
    "icd_code_2": ["icd_10_code_2", "secondary_icd_code"],
    # dates of service, procedures
    "dates_of_service": ["service_dates", "date_of_service"],
    "service_start_date": ["start_date_of_service"],
    "service_end_date": ["end_date_of_service"],
    "cpt_code_1": ["cpt_1", "cpt_code", "procedure_code_1"],
    "cpt_code_2": ["cpt_2", "procedure_code_2"],
    # clinical
    "clinical_notes": ["additional_clinical_info", "additional_information", "comments",
                       "additional_notes", "clinical_information"],
    "request_type": ["prior_auth_type", "pa_request_type"],
    "indication": ["indication_for_use", "diagnosis_indication"],
    "prior_therapy_1": ["previously_tried_drug_1", "failed_medication_1"],
    "prior_therapy_2": ["previously_tried_drug_2", "failed_medication_2"],
    # signature, tax
    "signature_date": ["date_of_signature", "prescriber_signature_date", "date"],
    "prescriber_signature": ["signature", "prescriber_sign"],
    "filing_status": ["tax_filing_status", "withholding_status"],
}

# Synonym -> canonical key; a synonym listed twice belongs to the later key.
CANONICAL_OF: dict[str, str] = {s: key for key, names in ALIASES.items() for s in names}

# Canonical keys with a place of their own in a flat record.
PLACED_KEYS = [
    "patient_name", "patient_first_name", "patient_last_name", "patient_dob",
    "patient_ssn", "patient_phone", "patient_address", "patient_city", "patient_state",
    "patient_zip", "patient_id",
    "physician_name", "physician_npi", "physician_phone", "physician_fax",
    "physician_address", "physician_city", "physician_state", "physician_zip",
    "facility_name", "facility_npi",
    "icd_code", "icd_code_2", "diagnosis",
    "drug_name", "drug_j_code", "drug_strength", "drug_frequency", "drug_quantity",
    "drug_sig",
    "cpt_code_1", "cpt_code_2", "cpt_code_3", "cpt_code_4",
    "dates_of_service", "service_start_date", "service_end_date",
    "benefit_type", "request_type", "indication", "clinical_notes",
    "signature_date", "prescriber_signature",
]

# Keys that mark a record as nested.
NESTED_KEYS = ["primary", "provider", "medical", "tax", "insurance", "employment",
               "facility", "organization", "questions", "signatures", "form_context"]

# Sections of questions kept for every indication.
SHARED_SECTIONS = ["universal", "continuation", "continuation_request"]

# Words that mark a phone, a date, a yes and a no.
PHONE_HINTS = ["phone", "fax", "tel"]
DATE_HINTS = ["dob", "date", "birthdate", "service_date"]
YES_WORDS = ["true", "yes", "y", "1", "x"]
NO_WORDS = ["false", "no", "n", "0"]

# Parts of a key that make its value sensitive.
SENSITIVE_PARTS = ["ssn", "social", "security", "tax", "ein", "itin", "account",
                   "routing", "card", "credit", "debit", "password", "pin", "dob",
                   "birth", "license", "passport"]

# Key derivation and cipher layout of protected values.
PBKDF2_ROUNDS = 100_000
SALT_BYTES = 16
NONCE_BYTES = 12
DECRYPTION_ERROR = "[DECRYPTION_ERROR]"

# Words that mark a signature field and a date field.
SIGN_WORDS = r"\b(sign(ature|ed|ing)?|signhere|autograph)\b"
DATE_WORDS = r"\b(date|dated|sign.?date|date.?sign)\b"

# Reach of a label around its field, in points.
LABEL_DY = 12
LABEL_LEFT = 220
LABEL_RIGHT = 500
LABEL_SLACK = 5
CHECKBOX_X = 80
TEXT_WORDS = 4
CHECKBOX_WORDS = 6

# Name keys of an output file, for a batch and for a template.
BATCH_NAME_KEYS = ["first_name", "last_name", "name", "full_name", "FirstName", "LastName"]
TEMPLATE_NAME_KEYS = ["first_name", "last_name", "full_name", "name"]

# Plans (id, name, calls per day, profiles, records per job, sessions).
PLANS = [
    ("free", "Free", 10000, 1, 100, 3),
    ("pro", "Pro", 100000, -1, 1000, -1),
    ("business", "Business", 1000000, -1, 10000, -1),
]
# Request limits (tier, window, calls).
RATE_LIMITS = [
    ("free", "minute", 60), ("free", "day", 10000),
    ("pro", "minute", 600), ("pro", "day", 100000),
    ("business", "minute", 6000), ("business", "day", 1000000),
    ("admin", "minute", 100000),
]
# Saved profiles per tier, -1 for no limit.
PROFILE_LIMITS = {"free": 1, "pro": -1, "business": -1, "admin": -1}

CACHE_VERSION = 2
REPLAY_SECONDS = 600
