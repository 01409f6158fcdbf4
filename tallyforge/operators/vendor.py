"""Vendor rules and the lookup in a directory of approved vendors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import present, strip
from ..schema import signal

# Identifiers and addresses.
EIN = r"(?U)^\d{2}-\d{7}\n?\z"
SENTINEL_EINS = ("00-0000000", "11-1111111", "12-3456789")
STREET = r"(?iU)\d+\s+\w+(?:\s+\w+)*\s+(?:st|street|ave|avenue|rd|road|blvd|boulevard|dr|drive|lane|ln|way|pl|place|pkwy|parkway|ct|court)\b"
PO_BOX = r"(?iU)p\.?\s?o\.?\s?box\s+\d+"
BOX_NUMBER = r"(?iU)box\s+(\d+)"
OVER_ONE = r"^0*([2-9]|[1-9][0-9]+)$"
GENERIC = ("123 main st", "123 main street", "1 main st", "1 main street", "p.o. box 1", "po box 1")
#: A directory of more bytes than this isn't broadcast.
BROADCAST_BYTES = 64 << 20
FILTER_BITS = 1 << 26  # of the bitmap of probed names: 8 MB in pieces of 4 KB, whatever the sizes of the tables


def valid_ein(x: Column, config: Config = DEFAULT) -> Column:
    known = x.rlike(EIN) & ~x.isin(*SENTINEL_EINS)
    return known & ~F.regexp_replace(x, "-", "").rlike(r"^(\d)\1+$") if config.strict_ein else known


def generic_address(x: Column) -> Column:
    return F.regexp_replace(strip(F.lower(x)), "[.,]+$", "").isin(*GENERIC)


def malformed_address(x: Column) -> Column:
    boxed = x.rlike(PO_BOX) & F.regexp_extract(x, BOX_NUMBER, 1).rlike(OVER_ONE)
    return ~x.rlike(STREET) & ~boxed


def address_class(x: Column) -> Column:
    return F.when(~present(x), "missing").when(generic_address(x), "generic").when(malformed_address(x), "malformed").otherwise("ok")


def directory_key(x: Column) -> Column:
    return F.lower(strip(x))


def prepared(directory: DataFrame) -> DataFrame:
    """One row per lower-case name: the first by ``ord`` wins."""
    rows = directory.where("vendor_name is not null").groupBy(F.lower("vendor_name").alias("__key"))
    return rows.agg(F.min_by(F.struct("tax_id"), "ord").alias("__first")).select("__key", F.col("__first.tax_id").alias("__expected"), F.lit(True).alias("__known"))


def _bytes(df: DataFrame, most: int) -> int:
    """An upper bound of a table's bytes: what the planner knows of its files, or else what one job adds up."""
    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if known <= most:
        return known
    return df.agg(F.sum(F.lit(40) + sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("vendor_name", "tax_id")), F.lit(0)))).first()[0] or 0


def probed_only(directory: DataFrame, probes: DataFrame) -> DataFrame:
    """The rows of a directory (__key, ...) whose name may be among the probed ones (__probe).

    The probed names set bits of one bitmap by their hash. It is of a fixed size, so it
    is broadcast in pieces, and a directory's row meets the piece that its own bit is in.
    Names that are probed always pass; of the others as few as the bitmap has bits set.
    """
    spot = lambda name: F.pmod(F.xxhash64(name), F.lit(FILTER_BITS)) + 1
    pieces = probes.select(spot("__probe").alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("__piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("__bits"))
    rows = directory.withColumn("__spot", spot("__key")).withColumns({"__own": F.bitmap_bucket_number("__spot"), "__at": F.bitmap_bit_position("__spot")})
    met = rows.join(F.broadcast(pieces), F.col("__own") == F.col("__piece"))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.bit_get(byte, (F.col("__at") % 8).cast("int")) == 1).select(*directory.columns)


def with_directory(df: DataFrame, directory: DataFrame | None, name: Column) -> DataFrame:
    """``df`` with __known and __expected; one left join answers both directory rules.

    A directory is broadcast where its bytes are known to be few. A larger one is cut
    down to the names that are probed before it is shuffled for the join.
    """
    if directory is None:
        return df.withColumns({"__known": F.lit(True), "__expected": F.lit(None).cast("string")})
    probes = df.withColumn("__probe", directory_key(name))
    if _bytes(directory, BROADCAST_BYTES) <= BROADCAST_BYTES:
        rows = F.broadcast(prepared(directory))
    else:
        rows = probed_only(directory.withColumn("__key", F.lower("vendor_name")).where("__key is not null"), probes.where("__probe is not null"))
        rows = prepared(rows.select(*directory.columns)).hint("merge")
    return probes.join(rows, F.col("__probe") == F.col("__key"), "left").withColumn("__known", F.coalesce("__known", F.lit(False))).drop("__probe", "__key")


def vendor_signals(df: DataFrame, directory: DataFrame | None = None, name: str = "vendor_name", address: str = "vendor_address", tax_id: str = "vendor_tax_id", out: str = "vendor_signals", config: Config = DEFAULT) -> DataFrame:
    """``df`` with an array of vendor signals: tax id, then address, then directory.

    A missing name gives that one signal only. ``directory`` None turns the
    directory rules off; an empty directory knows nobody.
    """
    n, a, t = F.col(name), F.col(address), F.col(tax_id)
    named = present(n)
    joined = with_directory(df, directory, n)
    tax = F.when(~present(t), signal("VENDOR_NO_TAX_ID", F.concat(F.lit("No tax identifier is given for "), n), 0)).when(
        ~valid_ein(t, config), signal("VENDOR_INVALID_TAX_ID", F.concat(F.lit("Tax identifier "), t, F.lit(" can't be a real one")), 0, tax_id=t)
    )
    kind = address_class(a)
    place = (
        F.when(kind == "missing", signal("VENDOR_NO_ADDRESS", F.lit("The vendor has no address"), 1))
        .when(kind == "generic", signal("VENDOR_GENERIC_ADDRESS", F.concat(F.lit("Placeholder address: "), a), 1))
        .when(kind == "malformed", signal("VENDOR_MALFORMED_ADDRESS", F.concat(F.lit("Neither a street nor a box address: "), a), 1))
    )
    expected, known = F.col("__expected"), F.col("__known")
    listed = F.when(~known, signal("VENDOR_NOT_IN_DIRECTORY", F.concat(n, F.lit(" is not an approved vendor")), 2)).when(
        present(t) & present(expected) & (expected != t),
        signal("VENDOR_TAX_ID_MISMATCH", F.concat(F.lit("Tax identifier differs from the one on file for "), n), 2, expected_tax_id=expected, actual_tax_id=t),
    )
    missing = F.when(~named, signal("VENDOR_NAME_MISSING", F.lit("No vendor name was found"), 0))
    rules = [missing, *(F.when(named, s) for s in (tax, place, listed))]
    return joined.withColumn(out, F.array_compact(F.array(*rules))).drop("__known", "__expected")
