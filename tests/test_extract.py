from datetime import date

import pytest

from tallyforge.config import Config
from tallyforge.operators.extract import extract

PAGE = """Northwind Traders LLC
48 Harbor Rd Suite 9
Portland, OR
Tax ID: 45-9876543
Invoice #: NW-2024-77
Invoice Date: 2024-03-05
Due Date: 2024-04-04
Subtotal: $1,200.00
Tax: $96.50
Total: $1,296.50
"""


def _fields(spark, *texts, config=Config()):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, raw_text string")
    return [r.fields for r in extract(df, config=config).orderBy("id").collect()]


def test_full_page(spark):
    (f,) = _fields(spark, PAGE)
    assert (f.vendor_name, f.vendor_tax_id, f.invoice_number) == ("Northwind Traders LLC", "45-9876543", "NW-2024-77")
    assert f.vendor_address == "48 Harbor Rd Suite 9 · Portland, OR · Tax ID: 45-9876543"
    assert (f.invoice_date, f.due_date) == (date(2024, 3, 5), date(2024, 4, 4))
    assert (f.subtotal, f.tax, f.total, f.currency) == (1200.0, 96.5, 1296.5, "USD")


def test_prose_and_nothing(spark):
    prose, empty, none = _fields(spark, "Just some words without any structure.", "", None)
    assert prose.total is None and prose.invoice_number is None
    assert empty.vendor_name is None and empty.raw_text == "" and none.raw_text == ""


@pytest.mark.parametrize(
    ("text", "field", "value"),
    [
        ("Total 1362.50", "total", 362.5), ("Sub-total: 10.00\nTotal: 12.00", "total", 10.0), ("x VAT number 12", "vendor_tax_id", "number"),
        ("Date: Apr 15, 2024", "invoice_date", None), ("Date: April 15 2024", "invoice_date", None), ("Date: April  5, 2024", "invoice_date", date(2024, 4, 5)),
        ("Date: 2/30/2024", "invoice_date", None), ("Date: 2/3/2024", "invoice_date", date(2024, 2, 3)), ("INV-2024-1", "invoice_number", "-2024-1"),
        ("Issued 2024-01-02", "due_date", date(2024, 1, 2)), ("pay £5", "currency", "GBP"), ("$ or €", "currency", "USD"),
    ],
)
def test_quirks(spark, text, field, value):
    assert _fields(spark, text)[0][field] == value


def test_strict_options(spark):
    strict = Config(strict_extract=True)
    assert _fields(spark, "Total 1362.50", config=strict)[0].total == 1362.5
    assert _fields(spark, "Sub-total: 10.00\nTotal: 12.00", config=strict)[0].total == 12.0
    assert _fields(spark, "Issued 2024-01-02", config=strict)[0].due_date is None


def test_line_ends_and_blanks(spark):
    f = _fields(spark, "\f   Acme  \r\nline\x0bother")[0]
    assert f.vendor_name == "Acme"
