"""Thresholds, word lists, rules and field specifications. Pass changed copies to the operators."""

from __future__ import annotations

import os
from dataclasses import dataclass

# The domain's terms, in their own spelling.
DOMAIN_TERMS = (
    "Old", "Mutual", "Insure", "Ltd", "Pty", "Payal", "Trading", "Projects", "Policyholder", "Details", "Address", "The",
    "Insured", "Physical", "Contact", "Work", "Tel", "Cell", "Email", "Registration", "No", "VAT", "Number", "Business",
    "Description", "Retail", "Hire", "Plant", "Own", "Operator", "Intermediary", "Agency", "Risk", "Brokers", "Policy", "Type",
    "Contract", "Monthly", "Period", "Insurance", "Original", "Inception", "Date", "Review", "Territorial", "Limits", "Republic",
    "South", "Africa", "Botswana", "Eswatini", "Kingdoms", "Kingdom", "Lesotho", "Zimbabwe", "Republics", "Malawi", "Namibia",
    "Mozambique", "Payment", "Method", "Debit", "Order", "Strike", "Date", "Reason", "For", "Issue", "Adding", "Geysers",
    "Authorised", "Signatory", "Signed", "At", "Printed", "By", "Application", "Version", "Endorsement", "Processed", "Page",
    "Of", "Company", "Broker", "Agent", "Premium", "Schedule", "Cover", "Benefit", "Limit", "Amount", "Total", "Balance",
    "Account", "Bank", "Johannesburg", "Roodepoort", "Hadeda", "Crescent", "Pune",
)
# General words that count as real in the word-likeness test.
GENERAL_WORDS = (
    "the", "and", "for", "ltd", "inc", "company", "policy", "number", "date", "name", "address", "phone", "email", "fax", "vat",
    "registration", "office", "head", "branch", "insurance", "insured", "insurer", "broker", "agent", "intermediary", "period",
    "premium", "schedule", "details", "contact", "signed", "signature", "printed", "version", "page", "monthly", "annual",
    "republic", "south", "africa", "claim", "cover", "benefit", "limit", "amount", "total", "balance", "account", "bank",
    "payment", "method", "debit", "order", "type", "contract", "renewal", "review", "inception", "territorial", "authorised",
    "authorized", "signatory", "behalf",
)
# Misread tokens and their corrections.
CORRECTIONS = {
    "cel": "Cell", "hinoewadi": "HINJEWADI", "e-mal": "E-mail", "emal": "E-mail", "e-mail": "E-mail", "lad": "Ltd",
    "mutral": "Mutual", "mutul": "Mutual", "ineure": "Insure", "numbar": "Number", "printad": "Printed",
    "apploation": "Application", "venion": "Version", "endorserment": "Endorsement", "prosessed": "Processed",
    "bohalf": "Behalf", "lcenned": "Licensed", "rauer": "Insurer", "tumber": "Number", "oriata": "Old", "yule": "Payal",
    "lfe": "life", "non-lfe": "non-life", "p57": "FSP",
}
# Keyword rules in order of precedence: type, hits needed, patterns (on lower case).
CLASS_RULES = (
    ("travel", 2, (r"pnr\s*number", r"train\s*name", r"originating\s*station", r"irctc")),
    ("car", 2, (r"registration\s*number", r"engine\s*number", r"chassis\s*number", r"two.wheeler", r"vehicle\s*idv")),
    ("health", 2, (r"basic\s*floater\s*sum\s*insured", r"scheme\s*description", r"irdai\s*regn", r"star\s*health", r"family\s*accident\s*care")),
    ("property", 2, (r"the\s*business\s*:", r"mast\.\s*pol\.\s*number", r"multisure", r"broadform\s*liability", r"sasria")),
    (
        "life", 1,
        (
            r"personal\s*scheme", r"omi.multisure", r"quicksure\s*personal", r"policy\s*number\s*\(broker\)", r"intermediary\s*:",
            r"period\s*of\s*insurance", r"policyholder\s*details", r"the\s*insured\s*:", r"insured.s\s*date\s*of\s*birth",
            r"occupation\s*of\s*the\s*insured",
        ),
    ),
)
CLASSIFY_CHARS, CLASSIFY_LLM_CHARS = 6000, 4000
# Extension -> kind of document.
KINDS = {
    "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "tiff": "image", "bmp": "image", "webp": "image", "docx": "docx",
    "doc": "doc", "mp3": "audio", "wav": "audio", "m4a": "audio", "aac": "audio", "flac": "audio", "mp4": "video", "avi": "video",
    "mov": "video", "mkv": "video", "webm": "video",
}
# Extension -> format as the evaluation counts it.
FORMATS = {
    **{e: k for e, k in KINDS.items() if k not in ("docx", "doc") and e != "webm"}, "docx": "word", "doc": "word",
}
UPLOADS = ("pdf", "docx", "doc", "png", "jpg", "jpeg", "mp3", "wav", "m4a", "aac", "flac", "mp4", "avi", "mov", "mkv", "webm")
REMOVED_FIELDS = ("policy_type", "policy_status")
META_FIELD = "_extraction_meta"
UNKNOWN = "Unknown"


@dataclass(frozen=True)
class Field:
    name: str
    format: str = "free_text"
    required: bool = False


# Fields by document type, in order. Formats are those of functions/formats.py.
FIELDS: dict[str, list[Field]] = {
    "life": [
        Field("insured_name"),
        Field("date_of_birth", "date"),
        Field("occupation"),
        Field("postal_address"),
        Field("physical_address"),
        Field("cell_phone", "phone"),
        Field("email", "email"),
        Field("policy_number_broker"),
        Field("start_date_of_cover", "date"),
        Field("anniversary_date", "date"),
        Field("original_inception_date", "date"),
        Field("period_of_insurance"),
        Field("total_premium", "currency"),
        Field("payment_method"),
        Field("co_insured_name"),
        Field("insurer_name", required=True),
        Field("insurer_phone", "phone"),
        Field("intermediary_name", required=True),
    ],
    "car": [
        Field("proposer_name"),
        Field("proposer_address"),
        Field("proposer_mobile", "phone"),
        Field("proposer_email", "email"),
        Field("policy_number"),
        Field("previous_policy_number"),
        Field("registration_number"),
        Field("vehicle_make"),
        Field("vehicle_model"),
        Field("vehicle_sub_type"),
        Field("engine_number"),
        Field("chassis_number"),
        Field("year_of_manufacture", "integer"),
        Field("vehicle_idv", "currency"),
        Field("total_idv", "currency"),
        Field("ncb_percent", "percent"),
        Field("policy_period_start", "date"),
        Field("policy_period_end", "date"),
        Field("own_damage_premium", "currency"),
        Field("liability_premium", "currency"),
        Field("total_premium", "currency"),
        Field("final_premium", "currency"),
        Field("broker_name"),
        Field("broker_code"),
        Field("customer_id"),
    ],
    "travel": [
        Field("master_policy_number"),
        Field("certificate_number"),
        Field("group_policyholder_name"),
        Field("insured_name"),
        Field("insured_age", "integer"),
        Field("insured_gender"),
        Field("insured_mobile", "phone"),
        Field("insured_email", "email"),
        Field("trip_start"),
        Field("trip_end"),
        Field("originating_station"),
        Field("destination_station"),
        Field("train_number"),
        Field("train_name"),
        Field("pnr_number"),
        Field("cover_death", "currency"),
        Field("cover_permanent_total_disability", "currency"),
        Field("cover_permanent_partial_disability", "currency"),
        Field("cover_hospitalization_expenses", "currency"),
        Field("cover_transportation_mortal_remains", "currency"),
        Field("base_premium", "currency"),
        Field("igst", "currency"),
        Field("total_premium", "currency"),
        Field("certificate_issue_date", "date"),
        Field("insurer_name"),
        Field("gst_number"),
        Field("pan_number"),
    ],
    "health": [
        Field("policy_number"),
        Field("insurer_name"),
        Field("proposer_name"),
        Field("proposer_address"),
        Field("proposer_mobile", "phone"),
        Field("proposer_email", "email"),
        Field("customer_code"),
        Field("gstin"),
        Field("date_of_inception", "date"),
        Field("period_start", "date"),
        Field("period_end", "date"),
        Field("sum_insured", "currency"),
        Field("scheme_description"),
        Field("base_premium", "currency"),
        Field("stamp_duty", "currency"),
        Field("total_premium", "currency"),
        Field("intermediary_code"),
        Field("intermediary_name"),
        Field("insured_members"),
        Field("nominee_name"),
        Field("issuing_office"),
    ],
    "property": [
        Field("policy_number"),
        Field("insurer_name"),
        Field("insured_name"),
        Field("insured_reg_number"),
        Field("insured_vat_number"),
        Field("postal_address"),
        Field("business_description"),
        Field("endorsement_number"),
        Field("first_inception_date", "date"),
        Field("effective_date", "date"),
        Field("anniversary_date", "date"),
        Field("period_of_insurance"),
        Field("territorial_limits"),
        Field("master_policy_number"),
        Field("broker_name"),
        Field("broker_vat_number"),
        Field("broker_fsp_number"),
        Field("total_premium", "currency"),
        Field("broker_fee", "currency"),
        Field("final_debit", "currency"),
        Field("payment_frequency"),
        Field("narrative"),
    ],
}


@dataclass(frozen=True)
class CleanConfig:
    high_confidence: float = 0.90
    medium_confidence: float = 0.70
    garbage_score: float = 60.0
    drop_garbage: bool = False
    iou: float = 0.5
    text_similarity: float = 80.0
    snap_similarity: float = 75.0
    band_px: float = 5.0
    terms: tuple[str, ...] = DOMAIN_TERMS
    words: tuple[str, ...] = GENERAL_WORDS

    def dictionary(self) -> dict[str, str]:
        """Lower case -> own spelling, in order of first mention; a later spelling of the same term wins."""
        return {t.lower(): t for t in self.terms}

    def real_words(self) -> list[str]:
        return sorted({*self.words, *self.dictionary()})


def load_env(paths: tuple[str, ...], environ: dict[str, str] = os.environ) -> str | None:
    """Reads NAME=value lines of the first of ``paths`` that exists into ``environ``, over what is there; says which it was.

    Blank lines and comments are skipped, quotes around a value go. The driver reads it; jobs pass what executors need.
    """
    for path in paths:
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as lines:
                for line in lines:
                    name, sign, value = line.strip().removeprefix("export ").partition("=")
                    if sign and not name.startswith("#"):
                        environ[name.strip()] = value.strip().strip("'\"")
            return path
    return None
