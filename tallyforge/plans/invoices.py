"""A table of invoices derived from ``orders``, with the same rules in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.directory import directory_of

STEMS = ("Acme Widgets", "Globex Trading", "Initech Systems", "Umbrella Labs", "Wayne Works", "Hooli Data", "Stark Parts", "Wonka Foods")
SUFFIXES = ("", " Corp", " Corporation", " LLC", " Inc.", " Partners")
TAX_IDS = {0: None, 1: "11-1111111", 2: "00-0000000", 3: "VAT12345", 4: "22-2222222"}  # by order key modulo 11
ADDRESSES = {0: None, 1: "123 Main St.", 2: "P.O. Box 1", 3: "PO Box 47", 4: "1 Research Plaza, Springfield", 5: "P.O. Box 01, Dover"}  # modulo 13
USUAL_ADDRESS = "200 Industrial Pkwy, Austin"


def directory_rows() -> list[tuple[str, str | None]]:
    """Seven of the eight stems with five suffixes; one without tax ids, one with others."""
    return [(stem + suffix, None if k == 5 else f"99-345678{k}" if k == 3 else f"12-345678{k}") for k, stem in enumerate(STEMS) if k != 6 for suffix in SUFFIXES[:5]]


def directory(spark: SparkSession) -> DataFrame:
    return directory_of(spark, directory_rows())


def _choose(values: dict, at, otherwise):
    out = None
    for k, v in values.items():
        out = (F if out is None else out).when(at == k, F.lit(v))
    return out.otherwise(otherwise)


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    name = F.concat(F.element_at(F.array(*map(F.lit, STEMS)), (customer % 8 + 1).cast("int")), F.element_at(F.array(*map(F.lit, SUFFIXES)), (key % 6 + 1).cast("int")))
    worth = F.floor(F.col("o_totalprice") / 20000).cast("long").cast("string")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        key.alias("seq"), F.concat(F.lit("inv"), key.cast("string")).alias("invoice_id"), F.when(key % 97 != 0, name).alias("vendor_name"),
        _choose(ADDRESSES, key % 13, F.lit(USUAL_ADDRESS)).alias("vendor_address"), _choose(TAX_IDS, key % 11, F.concat(F.lit("12-345678"), (customer % 8).cast("string"))).alias("vendor_tax_id"),
        F.when(key % 89 != 0, (customer % 500) + (key % 3) / F.lit(100.0)).alias("total"), F.when(key % 83 != 0, F.to_date("o_orderdate")).alias("invoice_date"),
        F.sha2(F.concat(customer.cast("string"), F.lit("|"), worth), 256).alias("content_hash"),
    )


def _sql(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _sql_choose(values: dict, at: str, otherwise: str) -> str:
    return f"CASE {at} " + " ".join(f"WHEN {k} THEN {_sql(v)}" for k, v in values.items()) + f" ELSE {otherwise} END"


def _sql_list(values) -> str:
    return "[" + ", ".join(map(_sql, values)) + "]"


SQL = f"""inv AS (
  SELECT o_orderkey AS seq, 'inv' || o_orderkey AS invoice_id,
    CASE WHEN o_orderkey % 97 <> 0 THEN ({_sql_list(STEMS)})[o_custkey % 8 + 1] || ({_sql_list(SUFFIXES)})[o_orderkey % 6 + 1] END AS vendor_name,
    {_sql_choose(ADDRESSES, 'o_orderkey % 13', _sql(USUAL_ADDRESS))} AS vendor_address,
    {_sql_choose(TAX_IDS, 'o_orderkey % 11', "'12-345678' || (o_custkey % 8)")} AS vendor_tax_id,
    CASE WHEN o_orderkey % 89 <> 0 THEN (o_custkey % 500) + (o_orderkey % 3) / 100.0::DOUBLE END AS total,
    CASE WHEN o_orderkey % 83 <> 0 THEN CAST(o_orderdate AS DATE) END AS invoice_date,
    sha256(o_custkey || '|' || CAST(floor(o_totalprice / 20000) AS BIGINT)) AS content_hash
  FROM orders)"""
DIRECTORY_SQL = "dir AS (SELECT * FROM (VALUES " + ", ".join(f"({_sql(n)}, {_sql(t)})" for n, t in directory_rows()) + ") t(name, expected))"
#: One row per vendor signal; with directory rules.
SIGNALS_SQL = (
    DIRECTORY_SQL
    + """, flags AS (
  SELECT inv.*, coalesce(vendor_name, '') = '' AS nameless, d.name IS NOT NULL AS known, d.expected,
    CASE WHEN coalesce(vendor_address, '') = '' THEN 'missing'
         WHEN regexp_replace(trim(lower(vendor_address)), '[.,]+$', '') IN ('123 main st', '123 main street', '1 main st', '1 main street', 'p.o. box 1', 'po box 1') THEN 'generic'
         WHEN NOT regexp_matches(vendor_address, '(?i)\\d+\\s+\\w+(?:\\s+\\w+)*\\s+(?:st|street|ave|avenue|rd|road|blvd|boulevard|dr|drive|lane|ln|way|pl|place|pkwy|parkway|ct|court)\\b')
          AND NOT (regexp_matches(vendor_address, '(?i)p\\.?\\s?o\\.?\\s?box\\s+\\d+') AND coalesce(TRY_CAST(regexp_extract(vendor_address, '(?i)box\\s+(\\d+)', 1) AS BIGINT), 0) > 1) THEN 'malformed'
         ELSE 'ok' END AS address_class,
    CASE WHEN coalesce(vendor_tax_id, '') = '' THEN 'missing'
         WHEN regexp_matches(vendor_tax_id, '^\\d{2}-\\d{7}$') AND vendor_tax_id NOT IN ('00-0000000', '11-1111111', '12-3456789') THEN 'valid' ELSE 'invalid' END AS ein_class
  FROM inv LEFT JOIN dir d ON lower(trim(vendor_name)) = lower(d.name)),
 sig AS (
  SELECT seq, invoice_id, 0 AS ord, 'VENDOR_NAME_MISSING' AS code, 0.40::DOUBLE AS weight, 0.55::DOUBLE AS confidence FROM flags WHERE nameless
  UNION ALL SELECT seq, invoice_id, 0, 'VENDOR_NO_TAX_ID', 0.50, 0.65 FROM flags WHERE NOT nameless AND ein_class = 'missing'
  UNION ALL SELECT seq, invoice_id, 0, 'VENDOR_INVALID_TAX_ID', 0.80, 0.85 FROM flags WHERE NOT nameless AND ein_class = 'invalid'
  UNION ALL SELECT seq, invoice_id, 1, 'VENDOR_NO_ADDRESS', 0.45, 0.60 FROM flags WHERE NOT nameless AND address_class = 'missing'
  UNION ALL SELECT seq, invoice_id, 1, 'VENDOR_GENERIC_ADDRESS', 0.75, 0.85 FROM flags WHERE NOT nameless AND address_class = 'generic'
  UNION ALL SELECT seq, invoice_id, 1, 'VENDOR_MALFORMED_ADDRESS', 0.45, 0.60 FROM flags WHERE NOT nameless AND address_class = 'malformed'
  UNION ALL SELECT seq, invoice_id, 2, 'VENDOR_NOT_IN_DIRECTORY', 0.55, 0.80 FROM flags WHERE NOT nameless AND NOT known
  UNION ALL SELECT seq, invoice_id, 2, 'VENDOR_TAX_ID_MISMATCH', 0.92, 0.95 FROM flags WHERE NOT nameless AND known AND coalesce(vendor_tax_id, '') <> '' AND coalesce(expected, '') <> '' AND expected <> vendor_tax_id)"""
)
#: Similarity of every two names that occur.
NAMES_SQL = """names AS (
  SELECT vendor_name, list_distinct(list_filter(string_split_regex(lower(trim(vendor_name)), '\\s+'),
    lambda w: w <> '' AND w NOT IN ('inc', 'inc.', 'corp', 'corp.', 'corporation', 'llc', 'ltd', 'ltd.', 'limited', 'co', 'co.', 'company'))) AS tokens
  FROM (SELECT DISTINCT vendor_name FROM inv WHERE coalesce(vendor_name, '') <> '')),
 counted AS (
  SELECT a.vendor_name AS a, b.vendor_name AS b, len(a.tokens) AS na, len(b.tokens) AS nb, len(list_intersect(a.tokens, b.tokens)) AS common
  FROM names a, names b),
 sim AS (
  SELECT a, b, CAST(CASE WHEN na = 0 OR nb = 0 THEN CASE WHEN lower(trim(a)) = lower(trim(b)) THEN 100 ELSE 0 END
    WHEN common = least(na, nb) THEN trunc(least(100.0::DOUBLE, 70.0::DOUBLE + 30.0::DOUBLE * (common::DOUBLE / (na + nb - common))))
    ELSE trunc(100.0::DOUBLE * (common::DOUBLE / (na + nb - common))) END AS INTEGER) AS similarity
  FROM counted)"""
