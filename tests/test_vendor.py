import pytest
from pyspark.sql import functions as F

from tallyforge.config import Config
from tallyforge.operators import vendor
from tallyforge.operators.vendor import address_class, valid_ein, vendor_signals
from tallyforge.sources.directory import directory_of

GOOD = ("Globex LLC", "200 Industrial Pkwy, Austin", "98-7654320")


def _codes(spark, row, directory=None):
    df = spark.createDataFrame([row], "vendor_name string, vendor_address string, vendor_tax_id string")
    return [s.code for s in vendor_signals(df, directory).first().vendor_signals]


def test_rules_in_order(spark):
    known = directory_of(spark)
    assert _codes(spark, GOOD, known) == []
    assert _codes(spark, ("Nobody Inc", "123 Main St.", "11-1111111"), known) == ["VENDOR_INVALID_TAX_ID", "VENDOR_GENERIC_ADDRESS", "VENDOR_NOT_IN_DIRECTORY"]
    assert _codes(spark, (" globex llc ", None, "98-0000001"), known) == ["VENDOR_NO_ADDRESS", "VENDOR_TAX_ID_MISMATCH"]
    assert _codes(spark, ("Globex LLC", "1 Research Plaza", None), known) == ["VENDOR_NO_TAX_ID", "VENDOR_MALFORMED_ADDRESS"]
    assert _codes(spark, (None, None, None), known) == _codes(spark, ("", "x", "y"), known) == ["VENDOR_NAME_MISSING"]


def test_no_directory_and_empty_directory(spark):
    assert _codes(spark, GOOD) == []
    assert _codes(spark, GOOD, directory_of(spark, [])) == ["VENDOR_NOT_IN_DIRECTORY"]


def test_first_entry_of_a_name_wins(spark):
    twice = directory_of(spark, [("Globex LLC", "98-7654320"), ("GLOBEX LLC", "00-1234567")])
    assert _codes(spark, GOOD, twice) == []


@pytest.mark.parametrize(("tax_id", "ok"), [("45-6789012", True), ("00-0000000", False), ("12-3456789", False), ("22-2222222", True), ("456789012", False), ("VAT12345", False), ("45-6789012\n", True)])
def test_ein(spark, tax_id, ok):
    assert spark.range(1).select(valid_ein(F.lit(tax_id))).first()[0] is ok


def test_strict_ein(spark):
    assert spark.range(1).select(valid_ein(F.lit("22-2222222"), Config(strict_ein=True))).first()[0] is False


@pytest.mark.parametrize(
    ("address", "kind"),
    [
        ("123 Main St.", "generic"), ("  P.O. BOX 1 ", "generic"), ("123 Main St, Springfield", "ok"), ("PO Box 47", "ok"), ("P.O. Box 01", "malformed"),
        ("1 Research Plaza, Springfield", "malformed"), ("77 St", "malformed"), ("", "missing"), (None, "missing"), ("9 Old Mill court", "ok"), ("Box 9", "malformed"),
    ],
)
def test_address(spark, address, kind):
    df = spark.createDataFrame([(address,)], "a string")
    assert df.select(address_class(F.col("a"))).first()[0] == kind


def test_a_directory_on_both_sides_of_its_bound(spark, monkeypatch):
    """Small: broadcast. Large: cut down by a bitmap of the probed names, then shuffled; the same answers."""
    rows = [(f"Vendor {k}", f"{k:02d}-{k:07d}" if k % 3 else None, k) for k in range(5000)] + [("vendor 7", "late", 9999), (None, "x", 1), ("VENDOR 8", None, -1)]
    directory = spark.createDataFrame(rows, "vendor_name string, tax_id string, ord int")
    probes = spark.createDataFrame([(k, n) for k, n in enumerate(["Vendor 7", " vendor 8 ", "Vendor 4999", "Nobody", None, ""])] + [(100 + k, f"Vendor {k * 61}") for k in range(200)], "k int, name string")
    run = lambda: vendor.with_directory(probes, directory, F.col("name"))
    small = run()
    monkeypatch.setattr(vendor, "BROADCAST_BYTES", 1000)
    large = run()
    got = {r.k: (r["__known"], r["__expected"]) for r in large.collect()}
    assert got == {r.k: (r["__known"], r["__expected"]) for r in small.collect()}
    assert got[0] == (True, "07-0000007") and got[1] == (True, None) and got[3] == got[4] == got[5] == (False, None) and len(got) == 206
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(small) and "SortMergeJoin" not in plan(small)
    assert "SortMergeJoin" in plan(large) and "bitmap_construct_agg" in plan(large)
    keyed = directory.where("vendor_name is not null").withColumn("__key", F.lower("vendor_name"))
    left = vendor.probed_only(keyed, probes.select(vendor.directory_key(F.col("name")).alias("__probe")).where("__probe is not null"))
    wanted = {r.name.strip().lower() for r in probes.collect() if r.name}
    assert {r["__key"] for r in left.collect()} == wanted & {r["__key"] for r in keyed.collect()}
