"""Labelled synthetic invoices for measuring detection quality.

``scenarios`` draws from one seeded generator, in a fixed order of draws per
label, so its figures can be compared; ``scenarios_at_scale`` makes any number
of rows in parallel, each from digests of its number alone. A duplicate there
copies an earlier clean row without a join: further digests of its number name
earlier rows until one of them is a clean one, whose fields are worked out anew.
"""

from __future__ import annotations

import random
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "seq long, label string, vendor_name string, vendor_address string, vendor_tax_id string, invoice_number string, invoice_date date, total double, currency string"
# Vendors of the scenarios (name, tax id, address).
KNOWN = (
    ("Acme Corporation", "12-3456780", "123 Industry Way, San Francisco, CA"),
    ("Globex LLC", "98-7654320", "200 Industrial Pkwy, Austin, TX"),
    ("Initech Inc.", "45-6789012", "500 Technology Dr, Seattle, WA"),
    ("Umbrella Corp.", "33-4455667", "1 Research Plaza, Raccoon City, IL"),
    ("Wayne Enterprises", "77-8899001", "1007 Mountain Dr, Gotham, NJ"),
)
FAKE = (
    ("Quick Pay Solutions LLC", "11-1111111", "123 Main St"),
    ("Premium Services Inc", "00-0000000", "P.O. Box 1"),
    ("Total Business Corp", "12-3456789", "1 Main Street"),
    ("Apex Holdings", None, "456 Anywhere Ave"),
    ("Globex Services Inc", "99-9999998", "P.O. Box 1"),
)
# The shares of labels, the totals of tampered rows, and how many of these have another name.
SHARES = (("clean", 0.50), ("synthetic_vendor", 0.20), ("tampered", 0.15), ("duplicate", 0.15))
ROUND_TOTALS = (10000, 50000, 100000)
VARIANT_SHARE = 0.60
# How a tampered name differs from the vendor's.
VARIANTS = (("Corporation", "Corp."), ("Inc.", ""))


class Draws:
    """Rows of COLUMNS (without seq), one label at a time."""

    def __init__(self, seed: int):
        self.rng, self.past = random.Random(seed), []

    def number(self, digits: int) -> str:
        return f"INV-{self.rng.randint(10 ** (digits - 1), 10**digits - 1)}"

    def row(self, label: str, vendor, number, when, total, currency=None) -> tuple:
        name, tax_id, address = vendor
        return (label, name, address, tax_id, number, when, float(total), currency)

    def clean(self) -> tuple:
        vendor = self.rng.choice(KNOWN)
        total = round(self.rng.uniform(100, 50000) + self.rng.random(), 2)
        number = self.number(6)
        when = date(2024, self.rng.randint(1, 12), self.rng.randint(1, 28))
        self.past.append((vendor, when, total))
        return self.row("clean", vendor, number, when, total, "USD")

    def synthetic_vendor(self) -> tuple:
        vendor = self.rng.choice(FAKE)
        number = self.number(5)
        return self.row("synthetic_vendor", vendor, number, None, round(self.rng.uniform(100, 5000), 2))

    def tampered(self) -> tuple:
        name, tax_id, address = self.rng.choice(KNOWN)
        if self.rng.random() < VARIANT_SHARE:
            for old, new in VARIANTS:
                name = name.replace(old, new)
            tax_id = None
        number = self.number(5)
        return self.row("tampered", (name, tax_id, address), number, None, self.rng.choice(ROUND_TOTALS))

    def duplicate(self) -> tuple:
        if not self.past:
            return self.clean()
        vendor, when, total = self.rng.choice(self.past)
        number = self.number(5)
        return self.row("duplicate", vendor, number, when + timedelta(days=self.rng.randint(1, 20)), total)

    def any(self) -> tuple:
        at, upto = self.rng.random(), 0.0
        for label, share in SHARES:
            upto += share
            if at < round(upto, 9):
                break
        return getattr(self, label)()


def scenarios(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    draws = Draws(seed)
    return spark.createDataFrame([(k, *draws.any()) for k in range(n)], COLUMNS)


#: How many earlier rows a duplicate looks at; each is clean in half of all cases, so none is in one of 2 ** 48.
TRIES = 48
HEX = 13  # digits of a digest that make a draw, exact in a double


def scenarios_at_scale(spark: SparkSession, n: int, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """n rows numbered from 0 with the same shares of labels, each a function of its number alone."""
    return scenarios_of(spark.range(0, n, 1, partitions).withColumnRenamed("id", "seq"), seed).select(*[c.split()[0] for c in COLUMNS.split(", ")])


def scenarios_of(rows: DataFrame, seed: int = 42) -> DataFrame:
    """COLUMNS and source_seq (the row that a duplicate copies) for rows (seq), which are numbered from 0 without gaps.

    A row without a clean one among the earlier rows that it looks at is clean itself.
    """

    def draw(salt: str, at: Column) -> Column:
        """A number from 0 to 1, by what it is for and the row's number."""
        text = F.md5(F.concat(F.lit(f"{seed}:{salt}:"), at.cast("string")))
        return F.conv(F.substring(text, 1, HEX), 16, 10).cast("long").cast("double") / F.lit(float(16**HEX))

    def pick(values, u: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.floor(u * len(values)) + 1).cast("int"))

    clean, fake, tampered = (sum(x for _, x in SHARES[: k + 1]) for k in range(3))
    seq, roll = F.col("seq"), draw("label", F.col("seq"))
    tried = F.transform(F.sequence(F.lit(0), F.lit(TRIES - 1)), lambda k: F.floor(draw("source", F.concat(seq.cast("string"), F.lit("."), k.cast("string"))) * seq).cast("long"))
    source = F.when(roll >= round(tampered, 9), F.get(F.filter(tried, lambda j: (seq > 0) & (draw("label", j) < clean)), 0))
    label = F.when((roll < clean) | ((roll >= round(tampered, 9)) & F.col("source_seq").isNull()), "clean").when(roll < round(fake, 9), "synthetic_vendor").when(roll < round(tampered, 9), "tampered").otherwise("duplicate")
    df = rows.select("seq").withColumn("source_seq", source).withColumn("label", label)
    at = F.coalesce("source_seq", "seq")  # whose vendor, total and date a row has
    df = df.withColumns({"__vendor": draw("vendor", at), "__total": draw("total", at), "__day": draw("day", at), "__variant": draw("variant", seq), "__later": draw("later", seq)})
    made_up, varied = F.col("label") == "synthetic_vendor", (F.col("label") == "tampered") & (F.col("__variant") < VARIANT_SHARE)
    of = lambda k: F.when(made_up, pick([v[k] for v in FAKE], F.col("__vendor"))).otherwise(pick([v[k] for v in KNOWN], F.col("__vendor")))
    other = of(0)
    for old, new in VARIANTS:
        other = F.replace(other, F.lit(old), F.lit(new))
    cents = lambda low, high: (F.floor(F.col("__total") * (high - low) * 100) + low * 100) / F.lit(100.0)
    total = F.when(F.col("label") == "tampered", pick(ROUND_TOTALS, F.col("__total")).cast("double")).when(made_up, cents(100, 5000)).otherwise(cents(100, 50000))
    day = F.date_add(F.lit(date(2024, 1, 1)), F.floor(F.col("__day") * 336).cast("int"))
    later = F.date_add(day, (F.floor(F.col("__later") * 20) + 1).cast("int"))
    return df.select(
        "seq", "label", F.when(varied, other).otherwise(of(0)).alias("vendor_name"), of(2).alias("vendor_address"), F.when(~varied, of(1)).alias("vendor_tax_id"),
        F.concat(F.lit("INV-"), (seq + 100000).cast("string")).alias("invoice_number"), F.when(F.col("label") == "clean", day).when(F.col("label") == "duplicate", later).alias("invoice_date"),
        total.alias("total"), F.when(F.col("label") == "clean", "USD").alias("currency"), "source_seq",
    )
