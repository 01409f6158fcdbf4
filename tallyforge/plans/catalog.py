"""Queries by name and the SQL that checks them.

Every query runs over its whole tables. Those without SQL (regular expressions
with look-ahead, VARIANT, images, streams) are tested against small
re-implementations instead.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import level
from ..functions.similarity import name_keys, token_similarity
from ..functions.text import lines, present
from ..operators import duplicates, evaluate, extract, imaging, risk, vendor, vision
from ..sources.directory import directory_of
from ..sources.scenarios import FAKE, KNOWN, scenarios, scenarios_of
from . import invoices as view
from .pipeline import analyse
from .pipeline import evaluate as evaluated


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPREAD = 100_000  # rows of a task whose work goes by the row


def _spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores, and to tasks of ``SPREAD`` rows where it has more, if its scan has fewer tasks than that.

    Small rows pack well, so a scan cut by bytes may have millions in a task; the count is read from the files' footers.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SPREAD))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def _r(name: str):
    return F.round(name, 6).alias(name)


def _with_signals(spark, sf_dir) -> DataFrame:
    return vendor.vendor_signals(view.invoices(spark, sf_dir), view.directory(spark))


def _vendor_risk(spark, sf_dir) -> DataFrame:
    return risk.with_risk(_with_signals(spark, sf_dir), F.col("vendor_signals"))


def vendor_signals(spark, sf_dir):
    return _with_signals(spark, sf_dir).select("invoice_id", F.explode("vendor_signals").alias("s")).select("invoice_id", "s.code", "s.weight", "s.confidence", F.round("s.score", 6).alias("score"))


def vendor_signal_counts(spark, sf_dir):
    return vendor_signals(spark, sf_dir).groupBy("code").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def ein_validity(spark, sf_dir):
    t = F.col("vendor_tax_id")
    kind = F.when(~present(t), "missing").when(vendor.valid_ein(t), "valid").otherwise("invalid")
    return view.invoices(spark, sf_dir).select(kind.alias("ein_class")).groupBy("ein_class").agg(F.count("*").alias("n"))


def address_class(spark, sf_dir):
    return view.invoices(spark, sf_dir).select(vendor.address_class(F.col("vendor_address")).alias("address_class")).groupBy("address_class").agg(F.count("*").alias("n"))


def directory_anti_join(spark, sf_dir):
    df = view.invoices(spark, sf_dir).where(present(F.col("vendor_name")))
    return vendor.with_directory(df, view.directory(spark), F.col("vendor_name")).where(~F.col("__known")).select("invoice_id", "vendor_name")


def directory_mismatch(spark, sf_dir):
    df = vendor.with_directory(view.invoices(spark, sf_dir), view.directory(spark), F.col("vendor_name"))
    hit = F.col("__known") & present(F.col("vendor_tax_id")) & present(F.col("__expected")) & (F.col("__expected") != F.col("vendor_tax_id"))
    return df.where(hit).select("invoice_id", "vendor_tax_id", F.col("__expected").alias("expected_tax_id"))


def signal_scores(spark, sf_dir):
    rows = vendor_signals(spark, sf_dir)
    return risk.risk_from_rows(rows.select("invoice_id", (F.col("weight") * F.col("confidence")).alias("score")), "invoice_id").select("invoice_id", F.round("risk_score", 12).alias("risk_score"), "risk_level")


def risk_scores(spark, sf_dir):
    return _vendor_risk(spark, sf_dir).select("invoice_id", F.size("signals").cast("long").alias("n_signals"), F.round("risk_score", 12).alias("risk_score"), "risk_level")


def risk_level_counts(spark, sf_dir):
    return _vendor_risk(spark, sf_dir).groupBy("risk_level").agg(F.count("*").alias("n"))


def signal_ranking(spark, sf_dir):
    return risk.signal_rows(_vendor_risk(spark, sf_dir), "invoice_id").select("invoice_id", F.col("rank").cast("long").alias("rank"), "code", _r("score"))


def dup_exact_orders(spark, sf_dir):
    df = duplicates.exact_matches(view.invoices(spark, sf_dir))
    return df.where("exact_match is not null").select("invoice_id", "exact_match")


def dup_exact_documents(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("invoice_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return duplicates.exact_matches(docs).where("exact_match is not null").select(F.col("seq").alias("doc_id"), F.col("exact_match").alias("first_doc_id"))


def dup_fuzzy_pairs(spark, sf_dir):
    df = view.invoices(spark, sf_dir)
    return duplicates.fuzzy_pair_counts(df).withColumn("similarity", F.col("similarity").cast("int"))


def dup_fuzzy_best(spark, sf_dir):
    df = view.invoices(spark, sf_dir)
    return duplicates.fuzzy_matches(df, df).select("seq", "matched_invoice_id", F.col("similarity").cast("int").alias("similarity"), "date_match")


def duplicate_signals(spark, sf_dir):
    df = duplicates.duplicate_signals(view.invoices(spark, sf_dir)).select("invoice_id", F.explode("duplicate_signals").alias("s"))
    return df.select("invoice_id", "s.code", F.col("s.evidence.matched_invoice_id").alias("matched_invoice_id"), F.round("s.score", 6).alias("score"))


def full_risk(spark, sf_dir):
    df = analyse(view.invoices(spark, sf_dir), view.directory(spark))
    return df.select("invoice_id", F.size("signals").cast("long").alias("n_signals"), F.round("risk_score", 12).alias("risk_score"), "risk_level")


def date_proximity(spark, sf_dir):
    df = duplicates.exact_matches(view.invoices(spark, sf_dir)).select("invoice_id", "invoice_date", "exact_match")
    prior = view.invoices(spark, sf_dir).select(F.col("invoice_id").alias("prior_id"), F.col("invoice_date").alias("prior_date"))
    joined = df.join(prior, F.col("exact_match") == F.col("prior_id"))
    return joined.select("invoice_id", duplicates.dates_close(F.col("invoice_date"), F.col("prior_date")).alias("date_match"))


def name_similarity(spark, sf_dir):
    """Pairs of names that have a word in common, which a similarity over 0 needs; names of suffixes alone have their whole name as a word."""
    names = view.invoices(spark, sf_dir).where(present(F.col("vendor_name"))).select("vendor_name").distinct()
    words = names.withColumn("word", F.explode(name_keys(F.col("vendor_name"))))
    a, b = words.withColumnRenamed("vendor_name", "a"), words.withColumnRenamed("vendor_name", "b")
    pairs = a.join(b, "word").where(F.col("a") <= F.col("b")).select("a", "b").distinct()
    return pairs.select("a", "b", token_similarity(F.col("a"), F.col("b")).cast("int").alias("similarity"))


def currency_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", extract.currency(F.coalesce("text", F.lit(""))).alias("currency"))


def first_line_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", extract.vendor_name(lines(F.coalesce("text", F.lit("")))).alias("first_line"))


def _invoice_text():
    """A page of text for each invoice, from its fields."""
    blank = F.lit("")
    return F.concat(
        F.coalesce("vendor_name", F.lit("--")), F.lit("\n"), F.coalesce("vendor_address", blank), F.lit("\nTax ID: "), F.coalesce("vendor_tax_id", F.lit("-")), F.lit("\nInvoice #: N-"), F.col("seq").cast("string"),
        F.when(F.col("invoice_date").isNotNull(), F.concat(F.lit("\nInvoice Date: "), F.date_format("invoice_date", "yyyy-MM-dd"))).otherwise(blank),
        F.when(F.col("total").isNotNull(), F.concat(F.lit("\nSubtotal: $"), F.call_function("format_number", F.col("total"), F.lit("#,##0.00")), F.lit("\nTotal: $"), F.call_function("format_number", F.col("total"), F.lit("#,##0.00")))).otherwise(blank),
    )


def extract_fields(spark, sf_dir):
    df = view.invoices(spark, sf_dir).select("invoice_id", _invoice_text().alias("raw_text"))
    df = _spread(df)
    out = extract.extract(df)
    names = ("vendor_name", "vendor_address", "vendor_tax_id", "invoice_number", "invoice_date", "due_date", "subtotal", "tax", "total", "currency")
    return out.select("invoice_id", *[F.col(f"fields.{n}").alias(n) for n in names])


def _dated_text():
    """A page with dates in many shapes and places, by what the order key leaves when divided by 12."""
    d, k = F.col("invoice_date"), F.col("seq") % 12
    iso, us = F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "M/d/yyyy")
    full, short = F.date_format(d, "MMMM d, yyyy"), F.date_format(d, "MMM d, yyyy")
    due = F.date_add(d, 30)
    far = F.lit(" " * 61)
    text = (
        F.when(k == 0, F.concat(F.lit("Invoice Date: "), iso, F.lit("\nDue Date: "), F.date_format(due, "M/d/yyyy")))
        .when(k == 1, F.concat(F.lit("Date "), us, F.lit("\nPayment due by "), F.date_format(due, "MMMM d, yyyy")))
        .when(k == 2, F.concat(F.lit("INVOICE DATE\n"), full))
        .when(k == 3, F.concat(F.lit("Invoice date: "), short, F.lit("\ndate: "), iso))  # no format has short months, but May
        .when(k == 4, F.concat(F.lit("Printed "), iso, F.lit("\nUpdated, no anchor")))
        .when(k == 5, F.concat(F.lit("Due date"), far, iso, F.lit("\ndate "), us))  # out of the window
        .when(k == 6, F.concat(F.lit("Date: 2024-13-45 or "), us))
        .when(k == 7, F.concat(F.lit("date: 13/13/2023\ninvoice date "), F.lower(full)))
        .when(k == 8, F.concat(F.lit("mandate "), iso, F.lit(" Due Date: "), F.regexp_replace(full, ",", "")))
        .when(k == 9, F.concat(F.lit("Payment due "), F.date_format(due, "yyyy-MM-dd"), F.lit(" invoice date "), F.regexp_replace(full, " ", "  ")))
        .when(k == 10, F.concat(us, F.lit(" "), iso, F.lit(" "), full))
        .otherwise(F.lit("No date at all"))
    )
    return F.when(d.isNotNull(), text).otherwise("Invoice date: to come")


def extract_dates(spark, sf_dir):
    """Invoice and due dates from pages with dates in many shapes; what the pages say goes along."""
    df = _spread(view.invoices(spark, sf_dir).select("invoice_id", _dated_text().alias("raw_text")))
    out = extract.extract(df)
    return out.select("invoice_id", "raw_text", "fields.invoice_date", "fields.due_date")


def extract_documents(spark, sf_dir):
    out = extract.extract(_spread(_table(spark, sf_dir, "documents").select("doc_id", "text")), "text")
    names = ("vendor_name", "vendor_address", "vendor_tax_id", "invoice_number", "invoice_date", "due_date", "subtotal", "tax", "total", "currency")
    return out.select("doc_id", *[F.col(f"fields.{n}").alias(n) for n in names])


def vision_findings(spark, sf_dir):
    """Answers made from events: one valid finding, one unknown code, one of the wrong kind."""
    code = F.element_at(F.array(*[F.lit(c) for c in (*vision.VISION_CODES, "OTHER")]), (F.col("event_id") % 6 + 1).cast("int"))
    answer = F.concat(F.lit('{"findings": [{"code": "'), code, F.lit('", "description": "seen", "confidence": '), (F.col("event_id") % 101 / F.lit(100.0)).cast("string"), F.lit("}, 7]}"))
    answer = F.when(F.col("event_id") % 7 == 0, F.lit("not json")).otherwise(answer)
    df = _table(spark, sf_dir, "events").select(F.col("event_id"), answer.alias("answer"))
    return vision.vision_findings(df, "event_id", "answer").select("event_id", F.col("pos").cast("long").alias("pos"), "code", _r("confidence"), _r("score"))


def ela_stats(spark, sf_dir):
    """A small image per part: a ramp, and on every third one a patch of noise."""
    import numpy as np

    @F.pandas_udf("binary")
    def paint(keys: pd.Series) -> pd.Series:
        y, x = np.mgrid[:32, :48]
        ramp = np.stack([x * 4 % 256, y * 6 % 256, x + y], -1)
        out = []
        for k in keys.tolist():
            a = ramp.copy()
            a[..., 2] = (a[..., 2] + k) % 256
            a = a.astype(np.uint8)
            if k % 3 == 0:
                a[8:24, 8:40] = np.random.default_rng(k).integers(0, 256, (16, 32, 3), np.uint8)
            out.append(a.tobytes())
        return pd.Series(out)

    keys = _spread(_table(spark, sf_dir, "part").select("p_partkey"))
    df = keys.select("p_partkey", paint("p_partkey").alias("pixels"), F.lit(32).alias("height"), F.lit(48).alias("width"))
    out = imaging.ela_signals(imaging.ela_stats(df))
    return out.select("p_partkey", "ela.max_intensity", F.round("ela.mean_intensity", 6).alias("mean_intensity"), F.round("ela.high_intensity_fraction", 6).alias("high_intensity_fraction"), F.size("ela_signals").alias("n_signals"))


def pixel_stats(spark, sf_dir):
    """The image statistics in relational form, over pixels made from line items."""
    px = _table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 256).cast("int").alias("r"), (F.col("l_suppkey") % 256).cast("int").alias("g"), (F.col("l_linenumber") * 20).cast("int").alias("b"))
    return imaging.pixel_stats(px, "l_orderkey").select("l_orderkey", "max_intensity", _r("mean_intensity"), _r("high_intensity_fraction"))


def _labelled(spark, sf_dir) -> DataFrame:
    """Labelled documents against a rule on their text: marks per word."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marks = F.length("text") - F.length(F.translate("text", "#*$%&|<>!", ""))
    words = F.length("text") - F.length(F.translate("text", " ", "")) + 1
    joined = docs.join(_table(spark, sf_dir, "labels"), "doc_id")
    score = F.least(F.lit(1.0), marks / words)
    return joined.select("doc_id", F.when(F.col("quality") == 1, "clean").when(F.col("toxic") == 1, "toxic").otherwise("junk").alias("label"), level(score).alias("risk_level"))


def confusion_by_label(spark, sf_dir):
    return evaluate.confusion(_labelled(spark, sf_dir), None).where("label <> 'overall'")


def confusion_overall(spark, sf_dir):
    return evaluate.confusion(_labelled(spark, sf_dir), None).where("label = 'overall'")


def precision_recall_f1(spark, sf_dir):
    return evaluate.quality(evaluate.confusion(_labelled(spark, sf_dir), None))


def label_distribution(spark, sf_dir):
    return evaluate.distribution(_labelled(spark, sf_dir))


def scenario_quality(spark, sf_dir):
    """The published evaluation: 1000 scenarios, seed 42. It reads no table."""
    known = directory_of(spark, [(n, t) for n, t, _ in KNOWN])
    return evaluate.quality(evaluate.confusion(evaluated(scenarios(spark), known)))


def _scenarios(spark, sf_dir) -> DataFrame:
    """A labelled scenario for each order; their keys go from 0 without gaps. Stored, as an evaluation reads it several times."""
    from ..storage import stored

    return stored(scenarios_of(_spread(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq")))), "scenarios")


def scenario_sources(spark, sf_dir):
    """Each duplicate of the scenarios with the row that it copies."""
    df = _scenarios(spark, sf_dir).where("label = 'duplicate'")
    return df.select("seq", "source_seq", "vendor_name", "vendor_tax_id", "total", F.date_format("invoice_date", "yyyy-MM-dd").alias("invoice_date"))


def scenario_scale(spark, sf_dir):
    """The evaluation over one scenario for each order."""
    known = directory_of(spark, [(n, t) for n, t, _ in KNOWN])
    return evaluate.quality(evaluate.confusion(evaluated(_scenarios(spark, sf_dir).drop("source_seq"), known)))


def report_json(spark, sf_dir):
    from ..sources.sinks import as_json

    df = _vendor_risk(spark, sf_dir).select("invoice_id", "risk_level", "risk_score", "signals")
    return as_json(risk.report(df))


def report_fields(spark, sf_dir):
    """Reports read back from their JSON: how many signals, their codes in order, and the ids that they give as evidence."""
    shape = "invoice_id string, risk_level string, risk_score double, signals array<struct<source:string,code:string,weight:double,confidence:double,score:double,evidence:struct<tax_id:string,expected_tax_id:string,actual_tax_id:string>>>"
    df = report_json(spark, sf_dir).select(F.from_json("value", shape).alias("r")).select("r.*")
    listed = lambda f: F.array_join(F.transform("signals", f), ",")
    return df.select(
        "invoice_id", "risk_level", F.size("signals").cast("long").alias("n_signals"), listed(lambda s: s.code).alias("codes"),
        listed(lambda s: F.coalesce(s.evidence.tax_id, s.evidence.actual_tax_id, F.lit("-"))).alias("tax_ids"), listed(lambda s: F.coalesce(s.evidence.expected_tax_id, F.lit("-"))).alias("expected_tax_ids"),
    )


def history_match(spark, sf_dir):
    """Two halves of the invoices: the later one against the earlier one as stored history."""
    df = view.invoices(spark, sf_dir)
    old, new = df.where("seq % 4 <> 0"), df.where("seq % 4 = 0")
    return duplicates.exact_in_history(new, old).select("invoice_id", "exact_match")


def stream_history(spark, sf_dir):
    """The invoices as a stream of three files, in the order of ``seq``; each batch is matched with all before it, by keyed state."""
    from ..storage import shared_folder
    from ..streaming.ingest import ingest, read_reports

    folder = shared_folder(spark, "stream")
    df = view.invoices(spark, sf_dir)
    third = [int(x) for x in df.agg(F.percentile_approx("seq", [1 / 3, 2 / 3])).first()[0]]
    for part in (df.where(F.col("seq") <= third[0]), df.where((F.col("seq") > third[0]) & (F.col("seq") <= third[1])), df.where(F.col("seq") > third[1])):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
        ingest(stream, f"{folder}/ledger", f"{folder}/offsets").awaitTermination()
    found = read_reports(spark, f"{folder}/ledger").select("invoice_id", F.explode("signals").alias("s")).where("s.source = 'duplicate'")
    return found.select("invoice_id", "s.code", F.col("s.evidence.matched_invoice_id").alias("matched_invoice_id"), F.round("s.score", 6).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        vendor_signals, vendor_signal_counts, ein_validity, address_class, directory_anti_join, directory_mismatch, signal_scores, risk_scores, risk_level_counts, signal_ranking,
        dup_exact_orders, dup_exact_documents, dup_fuzzy_pairs, dup_fuzzy_best, duplicate_signals, full_risk, date_proximity, name_similarity, currency_documents, first_line_documents,
        extract_fields, extract_dates, extract_documents, vision_findings, ela_stats, pixel_stats, confusion_by_label, confusion_overall, precision_recall_f1, label_distribution, scenario_quality, scenario_sources, scenario_scale, report_json, report_fields, history_match, stream_history,
    )
}

_WITH = f"WITH {view.SQL}, {view.SIGNALS_SQL}, risk AS (SELECT f.invoice_id, count(s.code) AS n_signals, coalesce(1 - product(1 - s.weight * s.confidence), 0) AS risk_score FROM flags f LEFT JOIN sig s USING (invoice_id) GROUP BY ALL) "
_LEVEL = "CASE WHEN risk_score >= 0.65 THEN 'HIGH' WHEN risk_score >= 0.30 THEN 'MEDIUM' ELSE 'LOW' END"
_EXACT = """exact AS (SELECT *, first_value(invoice_id) OVER w AS first_id, row_number() OVER w AS nth FROM inv WINDOW w AS (PARTITION BY content_hash ORDER BY seq))"""
_CLOSE = "coalesce(abs(date_diff('day', {a}, {b})) <= 30, false)"
_PAIRS = f"""pairs AS (SELECT a.seq, b.seq AS prior_seq, b.invoice_id AS matched_invoice_id, similarity, {_CLOSE.format(a='b.invoice_date', b='a.invoice_date')} AS date_match
  FROM inv a JOIN inv b ON abs(a.total - b.total) <= 0.01::DOUBLE AND b.seq < a.seq JOIN sim ON sim.a = a.vendor_name AND sim.b = b.vendor_name WHERE similarity >= 85)"""
_BEST = "best AS (SELECT seq, matched_invoice_id, similarity, date_match FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY similarity DESC, prior_seq) AS nth FROM pairs) WHERE nth = 1)"
_DUP = """dup AS (SELECT e.invoice_id, CASE WHEN nth > 1 THEN 'DUP_EXACT_FILE_HASH' ELSE 'DUP_FUZZY_MATCH' END AS code, CASE WHEN nth > 1 THEN first_id ELSE b.matched_invoice_id END AS matched_invoice_id,
  CASE WHEN nth > 1 THEN 0.95::DOUBLE ELSE 0.85::DOUBLE END AS weight, CASE WHEN nth > 1 THEN 1.0::DOUBLE WHEN b.date_match THEN 0.90::DOUBLE ELSE 0.80::DOUBLE END AS confidence
  FROM exact e LEFT JOIN best b USING (seq) WHERE nth > 1 OR b.seq IS NOT NULL)"""
_LABELLED = """WITH m AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'clean' WHEN toxic = 1 THEN 'toxic' ELSE 'junk' END AS label,
    (length(text) - length(translate(text, '#*$%&|<>!', '')))::DOUBLE / (length(text) - length(replace(text, ' ', '')) + 1) >= 0.30 AS predicted, quality <> 1 AS actual
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) JOIN labels USING (doc_id)),
 c AS (SELECT label, count_if(predicted AND actual) AS tp, count_if(predicted AND NOT actual) AS fp, count_if(NOT predicted AND NOT actual) AS tn, count_if(NOT predicted AND actual) AS fn FROM m GROUP BY label
  UNION ALL SELECT 'overall', count_if(predicted AND actual), count_if(predicted AND NOT actual), count_if(NOT predicted AND NOT actual), count_if(NOT predicted AND actual) FROM m) """

# the scenarios again, with duplicates joined to the rows that they copy
_DRAW = "CAST('0x' || substr(md5('42:{0}:' || {1}), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE"
_OF = lambda values, u: f"([{', '.join('NULL' if v is None else repr(v) for v in values)}])[CAST(floor({u} * {len(values)}) AS INTEGER) + 1]"
_SCENARIOS = f"""drawn AS (SELECT o_orderkey AS seq, {_DRAW.format('label', 'o_orderkey')} AS roll FROM orders),
 tried AS (SELECT d.seq, k, CAST(floor({_DRAW.format('source', "(d.seq || '.' || k)")} * d.seq) AS BIGINT) AS j FROM drawn d, range(48) r(k) WHERE roll >= 0.85 AND d.seq > 0),
 sources AS (SELECT t.seq, arg_min(t.j, t.k) AS source_seq FROM tried t JOIN drawn d ON d.seq = t.j WHERE d.roll < 0.5 GROUP BY t.seq),
 labelled AS (SELECT d.seq, source_seq, CASE WHEN roll < 0.5 OR roll >= 0.85 AND source_seq IS NULL THEN 'clean' WHEN roll < 0.7 THEN 'synthetic_vendor' WHEN roll < 0.85 THEN 'tampered' ELSE 'duplicate' END AS label FROM drawn d LEFT JOIN sources s ON s.seq = d.seq),
 facts AS (SELECT seq, {_DRAW.format('vendor', 'seq')} AS v, {_DRAW.format('total', 'seq')} AS t, {_DRAW.format('day', 'seq')} AS w FROM drawn),
 sc AS (SELECT l.seq, l.label, l.source_seq, label = 'tampered' AND {_DRAW.format('variant', 'l.seq')} < 0.6 AS varied,
   CASE WHEN label = 'synthetic_vendor' THEN {_OF([x[0] for x in FAKE], 'v')} ELSE {_OF([x[0] for x in KNOWN], 'v')} END AS name,
   CASE WHEN label = 'synthetic_vendor' THEN {_OF([x[1] for x in FAKE], 'v')} ELSE {_OF([x[1] for x in KNOWN], 'v')} END AS tax,
   CASE WHEN label = 'synthetic_vendor' THEN {_OF([x[2] for x in FAKE], 'v')} ELSE {_OF([x[2] for x in KNOWN], 'v')} END AS vendor_address,
   CASE label WHEN 'tampered' THEN ([10000.0::DOUBLE, 50000, 100000])[CAST(floor(t * 3) AS INTEGER) + 1] WHEN 'synthetic_vendor' THEN (floor(t * 4900 * 100) + 10000) / 100.0::DOUBLE ELSE (floor(t * 49900 * 100) + 10000) / 100.0::DOUBLE END AS total,
   CASE label WHEN 'clean' THEN DATE '2024-01-01' + CAST(floor(w * 336) AS INTEGER) WHEN 'duplicate' THEN DATE '2024-01-01' + CAST(floor(w * 336) AS INTEGER) + CAST(floor({_DRAW.format('later', 'l.seq')} * 20) AS INTEGER) + 1 END AS invoice_date
   FROM labelled l JOIN facts f ON f.seq = coalesce(l.source_seq, l.seq)),
 inv AS (SELECT seq, 's' || seq AS invoice_id, label, source_seq, CASE WHEN varied THEN replace(replace(name, 'Corporation', 'Corp.'), 'Inc.', '') ELSE name END AS vendor_name, vendor_address,
   CASE WHEN NOT varied THEN tax END AS vendor_tax_id, total, invoice_date FROM sc)"""
_KNOWN_SQL = "dir AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{t}')" for n, t, _ in KNOWN) + ") t(name, expected))"
_SCALE = f"""{_SCENARIOS}, {_KNOWN_SQL}, {view.SIGNALS_SQL.removeprefix(view.DIRECTORY_SQL + ", ")}, {view.NAMES_SQL},
 past AS (SELECT vendor_name, total, min(seq) AS first_seq FROM inv WHERE label = 'clean' GROUP BY ALL),
 same AS (SELECT inv.seq FROM inv JOIN past p ON p.vendor_name = inv.vendor_name AND p.total = inv.total AND p.first_seq < inv.seq),
 near AS (SELECT DISTINCT inv.seq, first_value({_CLOSE.format(a='inv.invoice_date', b='p.invoice_date')}) OVER (PARTITION BY inv.seq ORDER BY similarity DESC, p.seq) AS date_match
   FROM inv JOIN inv p ON p.label = 'clean' AND p.seq < inv.seq AND abs(inv.total - p.total) <= 0.01::DOUBLE JOIN sim ON sim.a = inv.vendor_name AND sim.b = p.vendor_name WHERE similarity >= 85 AND inv.seq NOT IN (SELECT seq FROM same)),
 every AS (SELECT seq, weight * confidence AS score FROM sig UNION ALL SELECT seq, 0.95::DOUBLE FROM same UNION ALL SELECT seq, CASE WHEN date_match THEN 0.85::DOUBLE * 0.90::DOUBLE ELSE 0.85::DOUBLE * 0.80::DOUBLE END FROM near),
 m AS (SELECT inv.seq, any_value(label) AS label, coalesce(1 - product(1 - score), 0) >= 0.30 AS predicted, any_value(label) <> 'clean' AS actual FROM inv LEFT JOIN every USING (seq) GROUP BY inv.seq),
 c AS (SELECT label, count_if(predicted AND actual) AS tp, count_if(predicted AND NOT actual) AS fp, count_if(NOT predicted AND NOT actual) AS tn, count_if(NOT predicted AND actual) AS fn FROM m GROUP BY label
  UNION ALL SELECT 'overall', count_if(predicted AND actual), count_if(predicted AND NOT actual), count_if(NOT predicted AND NOT actual), count_if(NOT predicted AND actual) FROM m)"""
_QUALITY = ", x AS (SELECT *, tp::DOUBLE / greatest(tp + fp, 1) AS p, tp::DOUBLE / greatest(tp + fn, 1) AS r FROM c) SELECT label, tp, fp, tn, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2.0::DOUBLE * p * r / greatest(p + r, 1e-9::DOUBLE), 6) AS f1, round(fp::DOUBLE / greatest(fp + tn, 1), 6) AS fp_rate FROM x"

# dates as the extraction looks for them: anchors in order, of each the window after its first place, patterns in order; then the whole page
_PARSED = lambda x: f"coalesce(CAST(try_strptime(nullif(regexp_extract({x}, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), ''), '%Y-%m-%d') AS DATE), CAST(try_strptime(nullif(regexp_extract({x}, '(\\d{{1,2}}/\\d{{1,2}}/\\d{{4}})', 1), ''), '%m/%d/%Y') AS DATE), CAST(try_strptime(regexp_replace(nullif(regexp_extract({x}, '(?i)((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\\.?\\s+\\d{{1,2}},?\\s+\\d{{4}})', 1), ''), '\\s+', ' ', 'g'), '%B %d, %Y') AS DATE))"
_WINDOW = lambda anchor: f"regexp_extract(raw_text, '(?i)\\b{anchor}\\b([\\s\\S]{{0,60}})', 1)"
_FOUND = lambda *anchors: f"coalesce({', '.join(_PARSED(_WINDOW(a)) for a in anchors)}, {_PARSED('raw_text')})"
_PAGES = """pages AS (SELECT invoice_id, CASE WHEN invoice_date IS NULL THEN 'Invoice date: to come' ELSE CASE seq % 12
    WHEN 0 THEN 'Invoice Date: ' || iso || chr(10) || 'Due Date: ' || strftime(due, '%-m/%-d/%Y') WHEN 1 THEN 'Date ' || us || chr(10) || 'Payment due by ' || strftime(due, '%B %-d, %Y')
    WHEN 2 THEN 'INVOICE DATE' || chr(10) || whole WHEN 3 THEN 'Invoice date: ' || strftime(invoice_date, '%b %-d, %Y') || chr(10) || 'date: ' || iso WHEN 4 THEN 'Printed ' || iso || chr(10) || 'Updated, no anchor'
    WHEN 5 THEN 'Due date' || repeat(' ', 61) || iso || chr(10) || 'date ' || us WHEN 6 THEN 'Date: 2024-13-45 or ' || us WHEN 7 THEN 'date: 13/13/2023' || chr(10) || 'invoice date ' || lower(whole)
    WHEN 8 THEN 'mandate ' || iso || ' Due Date: ' || replace(whole, ',', '') WHEN 9 THEN 'Payment due ' || strftime(due, '%Y-%m-%d') || ' invoice date ' || replace(whole, ' ', '  ')
    WHEN 10 THEN us || ' ' || iso || ' ' || whole ELSE 'No date at all' END END AS raw_text
  FROM (SELECT *, strftime(invoice_date, '%Y-%m-%d') AS iso, strftime(invoice_date, '%-m/%-d/%Y') AS us, strftime(invoice_date, '%B %-d, %Y') AS whole, invoice_date + 30 AS due FROM inv))"""

ORACLE_SQL = {
    "extract_dates": f"WITH {view.SQL}, {_PAGES} SELECT invoice_id, raw_text, {_FOUND('invoice date', 'date')} AS invoice_date, {_FOUND('due date', 'payment due')} AS due_date FROM pages",
    "report_fields": _WITH + f"""SELECT r.invoice_id, {_LEVEL} AS risk_level, any_value(n_signals) AS n_signals, coalesce(string_agg(code, ',' ORDER BY weight * confidence DESC, ord) FILTER (WHERE code IS NOT NULL), '') AS codes,
        coalesce(string_agg(CASE WHEN code IN ('VENDOR_INVALID_TAX_ID', 'VENDOR_TAX_ID_MISMATCH') THEN vendor_tax_id ELSE '-' END, ',' ORDER BY weight * confidence DESC, ord) FILTER (WHERE code IS NOT NULL), '') AS tax_ids,
        coalesce(string_agg(CASE WHEN code = 'VENDOR_TAX_ID_MISMATCH' THEN expected ELSE '-' END, ',' ORDER BY weight * confidence DESC, ord) FILTER (WHERE code IS NOT NULL), '') AS expected_tax_ids
        FROM risk r JOIN flags USING (invoice_id) LEFT JOIN sig USING (invoice_id) GROUP BY r.invoice_id, risk_score""",
    "scenario_sources": f"WITH {_SCENARIOS} SELECT i.seq, i.source_seq, i.vendor_name, p.vendor_tax_id, p.total, strftime(i.invoice_date, '%Y-%m-%d') AS invoice_date FROM inv i JOIN inv p ON p.seq = i.source_seq AND p.label = 'clean' AND p.vendor_name = i.vendor_name WHERE i.label = 'duplicate' AND i.invoice_date - p.invoice_date BETWEEN 1 AND 20",
    "scenario_scale": f"WITH {_SCALE}{_QUALITY}",
    "vendor_signals": _WITH + "SELECT invoice_id, code, weight, confidence, round(weight * confidence, 6) AS score FROM sig",
    "vendor_signal_counts": _WITH + "SELECT code, count(*) AS n, round(avg(round(weight * confidence, 6)), 6) AS mean_score FROM sig GROUP BY code",
    "ein_validity": _WITH + "SELECT ein_class, count(*) AS n FROM flags GROUP BY 1",
    "address_class": _WITH + "SELECT address_class, count(*) AS n FROM flags GROUP BY 1",
    "directory_anti_join": _WITH + "SELECT invoice_id, vendor_name FROM flags WHERE NOT nameless AND NOT known",
    "directory_mismatch": _WITH + "SELECT invoice_id, vendor_tax_id, expected AS expected_tax_id FROM flags WHERE known AND coalesce(vendor_tax_id, '') <> '' AND coalesce(expected, '') <> '' AND expected <> vendor_tax_id",
    "signal_scores": _WITH + f"SELECT invoice_id, round(risk_score, 12) AS risk_score, {_LEVEL} AS risk_level FROM risk WHERE n_signals > 0",
    "risk_scores": _WITH + f"SELECT invoice_id, n_signals, round(risk_score, 12) AS risk_score, {_LEVEL} AS risk_level FROM risk",
    "risk_level_counts": _WITH + f"SELECT {_LEVEL} AS risk_level, count(*) AS n FROM risk GROUP BY 1",
    "signal_ranking": _WITH + "SELECT invoice_id, row_number() OVER (PARTITION BY invoice_id ORDER BY weight * confidence DESC, ord) AS rank, code, round(weight * confidence, 6) AS score FROM sig",
    "dup_exact_orders": f"WITH {view.SQL}, {_EXACT} SELECT invoice_id, first_id AS exact_match FROM exact WHERE nth > 1",
    "dup_exact_documents": "SELECT doc_id, first_doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_doc_id FROM documents) WHERE doc_id <> first_doc_id",
    "dup_fuzzy_pairs": f"WITH {view.SQL}, {view.NAMES_SQL}, {_PAIRS} SELECT similarity, date_match, count(*) AS n FROM pairs GROUP BY ALL",
    "dup_fuzzy_best": f"WITH {view.SQL}, {view.NAMES_SQL}, {_PAIRS}, {_BEST} SELECT * FROM best",
    "duplicate_signals": f"WITH {view.SQL}, {view.NAMES_SQL}, {_PAIRS}, {_BEST}, {_EXACT}, {_DUP} SELECT invoice_id, code, matched_invoice_id, round(weight * confidence, 6) AS score FROM dup",
    "stream_history": f"WITH {view.SQL}, {view.NAMES_SQL}, {_PAIRS}, {_BEST}, {_EXACT}, {_DUP} SELECT invoice_id, code, matched_invoice_id, round(weight * confidence, 6) AS score FROM dup",
    "full_risk": f"WITH {view.SQL}, {view.SIGNALS_SQL}, {view.NAMES_SQL}, {_PAIRS}, {_BEST}, {_EXACT}, {_DUP}, every AS (SELECT invoice_id, weight, confidence FROM sig UNION ALL SELECT invoice_id, weight, confidence FROM dup), risk AS (SELECT inv.invoice_id, count(e.weight) AS n_signals, coalesce(1 - product(1 - e.weight * e.confidence), 0) AS risk_score FROM inv LEFT JOIN every e USING (invoice_id) GROUP BY ALL) SELECT invoice_id, n_signals, round(risk_score, 12) AS risk_score, {_LEVEL} AS risk_level FROM risk",
    "date_proximity": f"WITH {view.SQL}, {_EXACT} SELECT e.invoice_id, {_CLOSE.format(a='p.invoice_date', b='e.invoice_date')} AS date_match FROM exact e JOIN inv p ON p.invoice_id = e.first_id WHERE e.nth > 1",
    "name_similarity": f"WITH {view.SQL}, {view.NAMES_SQL} SELECT a, b, similarity FROM sim WHERE a <= b AND similarity > 0",
    "currency_documents": "SELECT doc_id, CASE WHEN contains(text, '$') OR contains(text, 'USD') THEN 'USD' WHEN contains(text, '€') OR contains(text, 'EUR') THEN 'EUR' WHEN contains(text, '£') OR contains(text, 'GBP') THEN 'GBP' END AS currency FROM documents",
    "first_line_documents": "SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'), lambda x: regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda x: length(x) >= 3 AND NOT starts_with(lower(x), 'invoice') AND NOT starts_with(lower(x), 'bill') AND regexp_matches(x, '\\p{L}'))[1] AS first_line FROM documents",
    "extract_fields": f"""WITH {view.SQL}, txt AS (SELECT *, 'ID: ' || coalesce(vendor_tax_id, '-') || chr(10) || 'Invoice #: N-' || seq || coalesce(chr(10) || 'Invoice Date: ' || strftime(invoice_date, '%Y-%m-%d'), '')
          || coalesce(chr(10) || 'Subtotal: $' || printf('%.2f', total) || chr(10) || 'Total: $' || printf('%.2f', total), '') AS after_tax FROM inv)
        SELECT invoice_id, coalesce(vendor_name, nullif(coalesce(vendor_address, 'Tax ID: ' || coalesce(vendor_tax_id, '-')), '')) AS vendor_name,
        CASE WHEN regexp_matches(vendor_address, '(?i)\\d+\\s+[A-Z][a-z]+\\s+(?:St|Ave|Rd|Blvd|Dr|Lane|Ln|Way|Pl|Pkwy)') THEN vendor_address || ' · Tax ID: ' || coalesce(vendor_tax_id, '-') || ' · Invoice #: N-' || seq END AS vendor_address,
        nullif(regexp_extract(coalesce(vendor_tax_id, '-'), '(?i)^([A-Z0-9-]{{6,20}})', 1), '') AS vendor_tax_id, 'N-' || seq AS invoice_number, invoice_date, invoice_date AS due_date,
        total AS subtotal, TRY_CAST(nullif(regexp_extract(substr(' ' || after_tax, 1, 40), '\\$?\\s?([0-9]{{1,3}}(?:,[0-9]{{3}})*\\.[0-9]{{2}})', 1), '') AS DOUBLE) AS tax, total, CASE WHEN total IS NOT NULL THEN 'USD' END AS currency FROM txt""",
    "vision_findings": """SELECT event_id, CAST(0 AS BIGINT) AS pos, (['FONT_INCONSISTENCY', 'LOGO_QUALITY', 'PIXEL_ARTIFACTS', 'ALIGNMENT_SHIFT', 'WHITESPACE_REDACTION', 'OTHER'])[event_id % 6 + 1] AS code,
        round((event_id % 101) / 100.0::DOUBLE, 6) AS confidence, round(([0.85::DOUBLE, 0.45, 0.65, 0.55, 0.70])[event_id % 6 + 1] * ((event_id % 101) / 100.0::DOUBLE), 6) AS score FROM events WHERE event_id % 7 <> 0 AND event_id % 6 < 5""",
    "pixel_stats": "SELECT l_orderkey, max(v) AS max_intensity, round(avg(v), 6) AS mean_intensity, round(avg(CASE WHEN v >= 25 THEN 1.0::DOUBLE ELSE 0 END), 6) AS high_intensity_fraction FROM (SELECT l_orderkey, CAST(greatest(l_partkey % 256, l_suppkey % 256, l_linenumber * 20) AS INTEGER) AS v FROM lineitem) GROUP BY 1",
    "confusion_by_label": _LABELLED + "SELECT * FROM c WHERE label <> 'overall'",
    "confusion_overall": _LABELLED + "SELECT * FROM c WHERE label = 'overall'",
    "precision_recall_f1": _LABELLED + _QUALITY,
    "label_distribution": _LABELLED + "SELECT label, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM m GROUP BY label",
    "history_match": f"WITH {view.SQL}, h AS (SELECT content_hash, min(seq) AS first_seq FROM inv WHERE seq % 4 <> 0 GROUP BY 1) SELECT i.invoice_id, CASE WHEN h.first_seq < i.seq THEN 'inv' || h.first_seq END AS exact_match FROM inv i LEFT JOIN h USING (content_hash) WHERE i.seq % 4 = 0",
}
