import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions.scoring import any_of, level, ranked
from tallyforge.operators import evaluate, risk
from tallyforge.schema import clamp01


def _any(spark, *rows):
    df = spark.createDataFrame([(list(r),) for r in rows], "s array<double>")
    return [r[0] for r in df.select(any_of(F.col("s"))).collect()]


def test_probability_of_any(spark):
    got = _any(spark, [], [0.3], [0.3, 0.2], [1.0] * 5)
    assert got == [0.0, pytest.approx(0.3), pytest.approx(0.44), 1.0]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.floats(0, 1), min_size=1, max_size=5), min_size=1, max_size=6))
def test_any_is_bounded_monotone_and_free_of_order(spark, rows):
    plain, turned, more = _any(spark, *rows), _any(spark, *[r[::-1] for r in rows]), _any(spark, *[[*r, 0.5] for r in rows])
    for a, b, c in zip(plain, turned, more, strict=True):
        assert 0 <= a <= 1 and abs(a - b) < 1e-12 and c >= a - 1e-12


@pytest.mark.parametrize(("score", "expected"), [(0.0, "LOW"), (0.29, "LOW"), (0.30, "MEDIUM"), (0.64, "MEDIUM"), (0.65, "HIGH"), (1.0, "HIGH")])
def test_cutoffs(spark, score, expected):
    assert spark.range(1).select(level(F.lit(score))).first()[0] == expected


def test_clamp_takes_nan_as_one(spark):
    df = spark.createDataFrame([(-1.0,), (0.5,), (7.0,), (float("nan"),)], "x double")
    assert [r[0] for r in df.select(clamp01(F.col("x"))).collect()] == [0.0, 0.5, 1.0, 1.0]


def test_rank_is_stable(spark):
    df = spark.sql("select array(named_struct('score', 0.2D, 'ord', 5), named_struct('score', 0.9D, 'ord', 7), named_struct('score', 0.2D, 'ord', 1)) s")
    assert [x.ord for x in df.select(ranked(F.col("s"))).first()[0]] == [7, 1, 5]


def test_product_aggregate_equals_fold(spark):
    df = spark.createDataFrame([("a", 0.3), ("a", 0.2), ("b", 1.0)], "k string, score double")
    got = {r.k: (r.risk_score, r.risk_level) for r in risk.risk_from_rows(df, "k").collect()}
    assert got["a"] == (pytest.approx(0.44), "MEDIUM") and got["b"] == (1.0, "HIGH")


def test_confusion_has_every_label(spark):
    df = spark.createDataFrame([("clean", "LOW"), ("tampered", "LOW"), ("tampered", "HIGH")], "label string, risk_level string")
    got = {r.label: (r.tp, r.fp, r.tn, r.fn) for r in evaluate.confusion(df).collect()}
    assert got == {"overall": (1, 0, 1, 1), "clean": (0, 0, 1, 0), "tampered": (1, 0, 0, 1), "duplicate": (0,) * 4, "synthetic_vendor": (0,) * 4}


def test_published_quality(spark):
    from tallyforge.plans.catalog import scenario_quality

    got = {r.label: r for r in scenario_quality(spark, "").collect()}
    o = got["overall"]
    assert (o.tp, o.fp, o.tn, o.fn) == (421, 0, 508, 71)
    assert (round(o.precision, 3), round(o.recall, 3), round(o.f1, 3)) == (1.0, 0.856, 0.922)
    assert round(got["tampered"].recall, 3) == 0.556 and got["duplicate"].recall == got["synthetic_vendor"].recall == 1.0


def test_scenarios_at_scale_have_the_same_shares(spark):
    from tallyforge.sources.scenarios import SHARES, scenarios_at_scale

    df = scenarios_at_scale(spark, 20_000)
    counts = {r.label: r["count"] / 20_000 for r in df.groupBy("label").count().collect()}
    assert all(abs(counts[k] - v) < 0.02 for k, v in SHARES)
    assert df.where("label = 'tampered' and vendor_tax_id is null").count() > 0
    assert list(itertools.islice(df.select("seq").toLocalIterator(), 2))


def test_duplicates_at_scale_copy_an_earlier_clean_row(spark):
    from tallyforge.plans.pipeline import evaluate
    from tallyforge.sources.directory import directory_of
    from tallyforge.sources.scenarios import KNOWN, scenarios_at_scale, scenarios_of

    rows = {r.seq: r for r in scenarios_of(spark.range(4000).withColumnRenamed("id", "seq"), seed=7).collect()}
    copies = [r for r in rows.values() if r.label == "duplicate"]
    assert len(copies) > 400 and rows[0].label != "duplicate"
    for r in copies:
        s = rows[r.source_seq]
        assert s.seq < r.seq and s.label == "clean" and (s.vendor_name, s.vendor_address, s.vendor_tax_id, s.total) == (r.vendor_name, r.vendor_address, r.vendor_tax_id, r.total)
        assert 1 <= (r.invoice_date - s.invoice_date).days <= 20 and s.invoice_number != r.invoice_number
    assert len({r.source_seq for r in copies}) > len(copies) / 2  # sources are spread over all earlier rows
    assert all(r.source_seq is None for r in rows.values() if r.label != "duplicate")
    # a row is the same whatever stands beside it
    assert {r.seq: r for r in scenarios_of(spark.range(100, 200).withColumnRenamed("id", "seq"), seed=7).collect()} == {k: rows[k] for k in range(100, 200)}
    known = directory_of(spark, [(n, t) for n, t, _ in KNOWN])
    scored = evaluate(scenarios_at_scale(spark, 4000, seed=7), known)
    assert scored.where("label = 'duplicate' and risk_level = 'LOW'").count() == 0
