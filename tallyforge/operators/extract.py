"""Fields of an invoice from its text, as one projection of column expressions.

Helper columns (the lines, the windows after anchors) are made in steps of
their own, so that no expression is repeated and generated code stays small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import first_group, lines, strip
from ..schema import FIELDS

# Patterns of the fields.
AMOUNT = r"(?U)\$?\s?([0-9]{1,3}(?:,[0-9]{3})*\.[0-9]{2})"
AMOUNT_STRICT = r"(?U)\$?\s?(?<![0-9,.])([0-9]{1,3}(?:,[0-9]{3})+\.[0-9]{2}|[0-9]+\.[0-9]{2})(?![0-9])"
INVOICE_NUMBER = r"(?iU)(?:invoice|inv|inv\.|invoice\s*number|invoice\s*#)\s*[#:]?\s*([A-Z0-9\-/]*\d[A-Z0-9\-/]*)"
TAX_ID = r"(?iU)(?:tax\s*id|ein|vat)\s*[#:]?\s*([A-Z0-9\-]{6,20})"
TAX_ID_STRICT = r"(?iU)\b(?:tax\s*id|ein|vat)\b\s*(?:no\.?|number)?\s*[#:]?\s*((?=[A-Z0-9\-]*\d)[A-Z0-9\-]{6,20})"
ADDRESS_LINE = r"(?iU)\d+\s+[A-Z][a-z]+\s+(?:St|Ave|Rd|Blvd|Dr|Lane|Ln|Way|Pl|Pkwy)"
DATES = (
    (r"(?U)(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"),
    (r"(?U)(\d{1,2}/\d{1,2}/\d{4})", "M/d/yyyy"),
    (r"(?iU)((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4})", "MMMM d, yyyy"),
)
CURRENCIES = (("USD", ("$", "USD")), ("EUR", ("€", "EUR")), ("GBP", ("£", "GBP")))
AMOUNT_ANCHORS = {"total": ("total", "amount due", "balance due"), "subtotal": ("subtotal", "sub-total"), "tax": ("tax", "vat", "gst")}
DATE_ANCHORS = {"invoice_date": ("invoice date", "date"), "due_date": ("due date", "payment due")}
AMOUNT_WINDOW, DATE_WINDOW = 40, 60


def _after(anchor: str, size: int) -> str:
    """Captures what follows a whole-word anchor without consuming it."""
    return rf"(?iU)\b{anchor}\b(?=([\s\S]{{0,{size}}}))"


def folded_case(text: Column) -> Column:
    """Lower case, with the letters that a pattern without case takes for s, k and i. Where a pattern's
    words aren't in it, the pattern needn't be tried, and a plain search is far cheaper."""
    return F.lower(F.translate(text, "\u017f\u212a\u0130\u0131", "skii"))


def vendor_name(text_lines: Column) -> Column:
    fits = lambda x: (F.length(x) >= 3) & ~F.lower(x).startswith("invoice") & ~F.lower(x).startswith("bill") & x.rlike(r"\p{L}")
    return F.try_element_at(F.filter(F.transform(text_lines, strip), fits), F.lit(1))


def vendor_address(text_lines: Column) -> Column:
    full = F.filter(F.transform(text_lines, strip), lambda x: x != "")
    hit = F.try_element_at(F.filter(F.transform(F.slice(full, 1, 8), lambda x, i: F.when(x.rlike(ADDRESS_LINE), i + 1)), lambda i: i.isNotNull()), F.lit(1))
    return F.when((F.size(full) >= 3) & hit.isNotNull(), F.array_join(F.slice(full, F.coalesce(hit, F.lit(1)), F.lit(3)), " · "))


def amount(text: Column, anchors: tuple[str, ...], folded: Column, config: Config = DEFAULT) -> Column:
    """The first amount in a window after an anchor; earlier anchors go first. ``folded``: the text by ``folded_case``."""
    pattern = AMOUNT_STRICT if config.strict_extract else AMOUNT
    guard = r"(?<![-\w])" if config.strict_extract else ""
    found = []
    for anchor in anchors:
        windows = F.regexp_extract_all(text, F.lit(_after(guard + anchor, AMOUNT_WINDOW)), F.lit(1))
        hits = F.filter(F.transform(windows, lambda w: F.regexp_extract(w, pattern, 1)), lambda a: a != "")
        found.append(F.when(folded.contains(anchor), F.try_element_at(hits, F.lit(1))))
    return F.regexp_replace(F.coalesce(*found), ",", "").try_cast("double")


#: What a text must contain, in lower case, for a date pattern to match.
DATE_MARKS = (("-",), ("/",), ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"))


def _dates(text: Column, folded: Column) -> list[Column]:
    found = []
    for (pattern, fmt), marks in zip(DATES, DATE_MARKS, strict=True):
        found.append(F.when(_holds(folded, marks), F.try_to_date(F.regexp_replace(first_group(text, pattern), r"(?U)\s+", " "), fmt)))
    return found


def _holds(folded: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda p, q: p | q, [folded.contains(w) for w in words])


def with_dates(df: DataFrame, text: str, folded: str, config: Config = DEFAULT) -> DataFrame:
    """``df`` with the date fields: the first date in the window after each anchor's first place; else the first in the whole text.

    Windows are made once for all patterns, and the dates of the whole text once for all fields.
    """
    t, low = F.col(text), F.col(folded)
    every = [(k, a) for k, anchors in DATE_ANCHORS.items() for a in anchors]
    df = df.withColumn("__windows", F.array(*[F.when(low.contains(a), first_group(t, _after(a, DATE_WINDOW))) for _, a in every]))
    df = df.withColumn("__near", F.transform("__windows", lambda w: F.coalesce(*_dates(w, folded_case(w)))))
    at = {k: [n for n, (own, _) in enumerate(every) if own == k] for k in DATE_ANCHORS}
    near = {k: F.coalesce(*[F.get("__near", F.lit(n)) for n in places]) for k, places in at.items()}
    if config.strict_extract:
        return df.withColumns({f"__{k}": v for k, v in near.items()}).drop("__windows", "__near")
    lacks = reduce(lambda p, q: p | q, [v.isNull() for v in near.values()])
    df = df.withColumn("__whole", F.when(lacks, F.coalesce(*_dates(t, low))))
    return df.withColumns({f"__{k}": F.coalesce(v, F.col("__whole")) for k, v in near.items()}).drop("__windows", "__near", "__whole")


def currency(text: Column) -> Column:
    found = None
    for code, marks in CURRENCIES:
        hit = reduce(lambda p, q: p | q, [text.contains(m) for m in marks])
        found = F.when(hit, code) if found is None else found.when(hit, code)
    return found


def extract(df: DataFrame, text: str = "raw_text", out: str = "fields", config: Config = DEFAULT) -> DataFrame:
    """``df`` with a struct of all fields of the text column. Null text counts as empty."""
    df = df.withColumn("__text", F.coalesce(F.col(text), F.lit(""))).withColumns({"__lines": lines(F.col("__text")), "__folded": folded_case(F.col("__text"))})
    df = with_dates(df, "__text", "__folded", config)
    t, low, parts = F.col("__text"), F.col("__folded"), {}
    parts["vendor_name"] = vendor_name(F.col("__lines"))
    parts["vendor_address"] = vendor_address(F.col("__lines"))
    parts["vendor_tax_id"] = F.when(_holds(low, ("tax", "ein", "vat")), strip(first_group(t, TAX_ID_STRICT if config.strict_extract else TAX_ID)))
    parts["invoice_number"] = F.when(low.contains("inv"), first_group(t, INVOICE_NUMBER))
    parts |= {k: amount(t, AMOUNT_ANCHORS[k], low, config) for k in ("subtotal", "tax", "total")}
    parts["currency"] = currency(t)
    df = df.withColumns({f"__{k}": v for k, v in parts.items()})
    parts |= dict.fromkeys(DATE_ANCHORS)
    struct = F.struct(*[F.col(f"__{k}").alias(k) for k in parts], F.lit(None).cast("array<map<string,string>>").alias("line_items"), t.alias("raw_text"))
    order = [p.split()[0] for p in FIELDS.split(", ")]
    return df.withColumn("__struct", struct).withColumn(out, F.struct(*[F.col(f"__struct.{k}").alias(k) for k in order])).drop("__text", "__lines", "__folded", "__struct", *[f"__{k}" for k in parts])
