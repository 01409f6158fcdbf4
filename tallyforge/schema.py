"""Schemas and the catalogue of signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = (
    "vendor_name string, vendor_address string, vendor_tax_id string, invoice_number string, invoice_date date, due_date date, "
    "subtotal double, tax double, total double, currency string, line_items array<map<string,string>>, raw_text string"
)
EVIDENCE = (
    "matched_invoice_id string, vendor_similarity_pct int, amount_match boolean, date_match boolean, tax_id string, expected_tax_id string, "
    "actual_tax_id string, high_intensity_fraction double, max_intensity int, mean_intensity double"
)
EVIDENCE_FIELDS = tuple(part.split()[0] for part in EVIDENCE.split(", "))


def struct_type(ddl: str) -> str:
    """struct<...> from a list of columns, whose own types have no ", "."""
    return f"struct<{','.join(part.replace(' ', ':', 1) for part in ddl.split(', '))}>"


EVIDENCE_TYPE = struct_type(EVIDENCE)
SIGNAL_TYPE = struct_type(f"source string, code string, description string, weight double, confidence double, score double, evidence {EVIDENCE_TYPE}, ord int")
DIRECTORY = "vendor_name string, tax_id string, ord int"

# Weight and confidence of each code; None where the detector sets the confidence.
SIGNALS = {
    "DUP_EXACT_FILE_HASH": ("duplicate", 0.95, 1.0),
    "DUP_FUZZY_MATCH": ("duplicate", 0.85, None),
    "VENDOR_NAME_MISSING": ("vendor", 0.40, 0.55),
    "VENDOR_NO_TAX_ID": ("vendor", 0.50, 0.65),
    "VENDOR_INVALID_TAX_ID": ("vendor", 0.80, 0.85),
    "VENDOR_NO_ADDRESS": ("vendor", 0.45, 0.60),
    "VENDOR_GENERIC_ADDRESS": ("vendor", 0.75, 0.85),
    "VENDOR_MALFORMED_ADDRESS": ("vendor", 0.45, 0.60),
    "VENDOR_NOT_IN_DIRECTORY": ("vendor", 0.55, 0.80),
    "VENDOR_TAX_ID_MISMATCH": ("vendor", 0.92, 0.95),
    "ELA_LOCAL_REGION_EDITED": ("ela", 0.7, None),
    "FONT_INCONSISTENCY": ("gpt4v", 0.85, None),
    "LOGO_QUALITY": ("gpt4v", 0.45, None),
    "PIXEL_ARTIFACTS": ("gpt4v", 0.65, None),
    "ALIGNMENT_SHIFT": ("gpt4v", 0.55, None),
    "WHITESPACE_REDACTION": ("gpt4v", 0.70, None),
}
VISION_CODES = tuple(code for code, (source, _, _) in SIGNALS.items() if source == "gpt4v")
#: Emission order of detectors; a signal's ``ord`` is detector * ORD_STEP + its place there.
DETECTORS = ("ela", "duplicate", "vendor", "gpt4v")
ORD_STEP = 1000


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def signal(code: str, description: Column, place: int = 0, confidence: Column | None = None, **evidence: Column) -> Column:
    """One signal as a struct; evidence that the code doesn't have is null."""
    source, weight, fixed = SIGNALS[code]
    own = F.lit(fixed) if confidence is None else confidence.cast("double")
    return F.struct(
        F.lit(source).alias("source"), F.lit(code).alias("code"), description.alias("description"), F.lit(weight).alias("weight"),
        own.alias("confidence"), (clamp01(F.lit(weight)) * clamp01(own)).alias("score"),
        F.struct(*[evidence.get(k, F.lit(None)).alias(k) for k in EVIDENCE_FIELDS]).cast(EVIDENCE_TYPE).alias("evidence"),
        F.lit(DETECTORS.index(source) * ORD_STEP + place).alias("ord"),
    )


def no_signals() -> Column:
    return F.array().cast(f"array<{SIGNAL_TYPE}>")
