"""Checked queries: exports and result tables written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.plans import stand_ins as S
from tidemark.session import checkpoint_folder
from tidemark.sources import exports, ingest_report, reports

QUERIES = {}
SQL = {}


def _place(spark) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def _orders(spark, folder):
    return S.tables(spark, folder, "orders")["orders"].select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")


def _exports(spark, folder):
    """Two exports of the orders whose headers differ: one more column, another order."""
    place, rows = _place(spark), _orders(spark, folder)
    reports.write_csv(rows.where("o_orderkey % 2 = 0"), f"{place}/even.csv")
    odd = rows.where("o_orderkey % 2 = 1").select("o_totalprice", "o_orderkey", F.when(F.col("o_custkey") % 3 == 0, "N/A").otherwise("x").alias("note"))
    reports.write_csv(odd, f"{place}/odd.csv")
    return exports.read_exports(spark, [f"{place}/even.csv", f"{place}/odd.csv"])


def src_read_exports(spark, folder):
    """Rows of differing exports united by name; missing columns and null words are null."""
    return _exports(spark, folder).select(
        F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"), "o_orderpriority",
        F.round(F.col("o_totalprice").cast("double"), 2).alias("o_totalprice"), "note",
    )


QUERIES["src_read_exports"] = src_read_exports
SQL["src_read_exports"] = """SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS BIGINT) END AS o_custkey,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS o_orderpriority, round(o_totalprice, 2) AS o_totalprice,
  CASE WHEN o_orderkey % 2 = 1 AND o_custkey % 3 <> 0 THEN 'x' END AS note FROM orders"""


def src_rows_per_file(spark, folder):
    rows = _exports(spark, folder)
    counts = exports.rows_per_file(rows.withColumn("export", F.regexp_extract(exports.FILE, r"/(\w+)\.csv/", 1)), "export")
    broken = exports.broken_rows(rows).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return counts.withColumn("broken", F.lit(broken))


QUERIES["src_rows_per_file"] = src_rows_per_file
SQL["src_rows_per_file"] = """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS export, count(*) AS rows, CAST(0 AS BIGINT) AS broken
FROM orders GROUP BY 1"""


def snk_tables(spark, folder):
    """A set of result tables, partitioned or not, read back from where it was written."""
    rows = _orders(spark, folder)
    sums = rows.groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    places = reports.write_tables({"sums": sums, "rows": rows}, _place(spark))
    parts = reports.write_table(rows, _place(spark), "parts", ["o_orderpriority"])
    back = {name: spark.read.parquet(path) for name, path in places.items()}
    counted = back["rows"].groupBy("o_orderpriority").agg(F.count("*").alias("rows"))
    again = spark.read.parquet(parts).groupBy("o_orderpriority").agg(F.count("*").alias("in_parts"))
    return back["sums"].join(counted, "o_orderpriority").join(again, "o_orderpriority")


QUERIES["snk_tables"] = snk_tables
SQL["snk_tables"] = """SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total, count(*) AS rows, count(*) AS in_parts
FROM orders GROUP BY o_orderpriority"""


def snk_report(spark, folder):
    """A report as JSON lines, read back."""
    counts = _orders(spark, folder).groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.max("o_custkey").alias("last"))
    path = reports.write_report(counts, _place(spark), "report")
    return spark.read.schema("o_orderpriority string, orders long, last long").json(path)


QUERIES["snk_report"] = snk_report
SQL["snk_report"] = "SELECT o_orderpriority, count(*) AS orders, CAST(max(o_custkey) AS BIGINT) AS last FROM orders GROUP BY o_orderpriority"


def _ingest(spark, folder):
    normal, found = S.normalized(spark, folder, whole=False), S.cleaned(spark, folder, written=False)
    return ingest_report.write_ingest(found.frame, _place(spark), normal.headers, found.judged)


def snk_ingest_figures(spark, folder):
    """Figures, labels and warnings of the written report, read back."""
    report = _ingest(spark, folder)
    figures = report.table(spark, "figures").select(F.col("figure").alias("name"), F.coalesce(F.col("value").cast("bigint").cast("string"), "day").alias("value"))
    labels = report.table(spark, "labels").select(F.concat_ws("=", "column", "label").alias("name"), F.col("rows").cast("string").alias("value"))
    warnings = report.table(spark, "warnings").select(F.lit("warning").alias("name"), F.col("warning").alias("value"))
    return figures.unionByName(labels).unionByName(warnings)


_END = "greatest(close_date, pending_date, off_market_date)"
_REPORTED = {
    "rows_out": "count(*)", "non_sold": "count(*) - count(*) FILTER (status = 'SOLD')", "censored": "count(*) FILTER (status IN ('EXPIRED', 'WITHDRAWN', 'CANCELED'))",
    "pending_as_sold": "count(*) FILTER (pending_treated_as_sold)", "events": "coalesce(sum(event_sold), 0)",
    "usable_rows": "count(*) FILTER (mls_number IS NOT NULL AND status IS NOT NULL AND original_list_price IS NOT NULL AND list_date IS NOT NULL AND living_area_sqft IS NOT NULL AND zip_code IS NOT NULL AND duration_days IS NOT NULL AND submarket IS NOT NULL)",
    "rows_with_submarket": "count(submarket)", "rows_without_submarket": "count(*) - count(submarket)", "list_ppsf_implausible": "count(*) FILTER (list_ppsf_source = 'implausible')",
    "outlier_flagged": "count(*) FILTER (list_ppsf_outlier)", "list_date_recovered": "count(*) FILTER (list_date_source = 'derived_from_dom')",
    "rows_with_both_dates": f"count(*) FILTER (list_date IS NOT NULL AND {_END} IS NOT NULL)",
    "list_min": "CAST(min(list_date) AS DATE)", "list_max": "CAST(max(list_date) AS DATE)", "terminal_min": f"CAST(min({_END}) AS DATE)", "terminal_max": f"CAST(max({_END}) AS DATE)",
    **{f"{c}={x}": f"count(*) FILTER ({c} = '{x}')" for c, labels in ingest_report.LABELS.items() for x in labels},
    **{f"{c}=other": f"count(*) FILTER ({c} IS NULL OR {c} NOT IN {labels})" for c, labels in ingest_report.LABELS.items()},
}
QUERIES["snk_ingest_figures"] = snk_ingest_figures
SQL["snk_ingest_figures"] = f"""WITH {S.CLEAN_SQL}, v AS ({" UNION ALL ".join(f"SELECT '{k}' AS name, CAST({x} AS VARCHAR) AS value FROM clean" for k, x in _REPORTED.items())}),
w AS (SELECT (SELECT CAST(value AS BIGINT) FROM v WHERE name = 'censored') AS censored, (SELECT CAST(value AS DOUBLE) FROM v WHERE name = 'rows_without_submarket') / (SELECT CAST(value AS DOUBLE) FROM v WHERE name = 'rows_out') AS gap,
  (SELECT CAST(value AS BIGINT) FROM v WHERE name = 'list_ppsf_implausible') AS odd, (SELECT CAST(value AS BIGINT) FROM v WHERE name = 'list_date_recovered') AS back)
SELECT name, value FROM v UNION ALL SELECT 'warning', 'elasticity not identifiable: only sold records' FROM w WHERE censored = 0 UNION ALL SELECT 'warning', 'submarket coverage gap' FROM w WHERE gap > 0.05
UNION ALL SELECT 'warning', 'implausible price per square foot nulled' FROM w WHERE odd > 0 UNION ALL SELECT 'warning', 'list dates recovered from days on market' FROM w WHERE back > 0"""


def snk_ingest_groups(spark, folder):
    """The grouped tables of the written report, and the rows of the cleaned table, read back."""
    report = _ingest(spark, folder)
    read = lambda name: report.table(spark, name)
    number = lambda c: F.round(F.col(c).cast("double"), 6)
    parts = [
        read("cells").select(F.lit("cells").alias("part"), F.lit("dense_cells").alias("name"), number("dense_cells").alias("value")),
        read("cells").select(F.lit("cells"), F.lit("cells"), number("cells")),
        read("buildings").select(F.lit("buildings"), F.lit("buildings_dense"), number("buildings_dense")),
        read("buildings").select(F.lit("buildings"), F.lit("median_rows"), number("median_rows")),
        read("top_unmapped").select(F.lit("top_unmapped"), "zip_code", number("rows")),
        read("waterfall").select(F.lit("waterfall"), "reason", number("rows")),
        read("types").select(F.lit("nulls"), "field", number("nulls")).where(F.col("field").isin("status", "list_date", "floor", "submarket", "duration_days", "list_ppsf")),
        read("cleaned").groupBy().agg(F.count("*").alias("n")).select(F.lit("cleaned"), F.lit("rows"), number("n")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


QUERIES["snk_ingest_groups"] = snk_ingest_groups
SQL["snk_ingest_groups"] = f"""WITH {S.CLEAN_SQL}, c AS (SELECT count(*) AS n FROM clean WHERE submarket IS NOT NULL AND list_date IS NOT NULL GROUP BY submarket, strftime(list_date, '%Y-%m')),
b AS (SELECT building_text, count(*) AS n FROM clean WHERE building_text IS NOT NULL GROUP BY 1)
SELECT 'cells' AS part, 'dense_cells' AS name, CAST(count(*) FILTER (n >= 8) AS DOUBLE) AS value FROM c UNION ALL SELECT 'cells', 'cells', count(*) FROM c
UNION ALL SELECT 'buildings', 'buildings_dense', count(*) FILTER (n >= 5) FROM b UNION ALL SELECT 'buildings', 'median_rows', round(quantile_cont(n, 0.5), 6) FROM b
UNION ALL (SELECT 'top_unmapped', zip_code, count(*) FROM clean WHERE submarket IS NULL AND zip_code IS NOT NULL GROUP BY zip_code ORDER BY count(*) DESC, zip_code LIMIT 10)
UNION ALL SELECT 'waterfall', coalesce(drop_reason, 'kept'), count(*) FROM judged GROUP BY 2
UNION ALL {" UNION ALL ".join(f"SELECT 'nulls', '{c}', count(*) - count({c}) FROM clean" for c in ("status", "list_date", "floor", "submarket", "duration_days", "list_ppsf"))}
UNION ALL SELECT 'cleaned', 'rows', count(*) FROM clean"""
