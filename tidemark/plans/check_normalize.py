"""Checked queries: normalization and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates, floors
from tidemark.operators import clean, normalize
from tidemark.plans import stand_ins as S
from tidemark.sources.exports import quarter_of_file
from tidemark.sources.headers import leftover_counts, resolve_headers

ROW = ("orderkey", "linenumber", "partkey")
WITH = f"WITH {S.NORMALIZED_SQL}\n"
WITH_CLEAN = f"WITH {S.CLEAN_SQL}\n"

QUERIES = {}
SQL = {}


def _frame(spark, folder):
    return S.normalized(spark, folder, whole=False).frame


def _typed(names):
    def run(spark, folder):
        mapped, _ = normalize.map_columns(S.raw_export(spark, folder, whole=False), S.KEEP)
        return normalize.coerce_types(mapped).select(*ROW, *names)

    return run


QUERIES["nrm_money_area_zip"] = _typed(
    ("mls_number", "original_list_price", "last_list_price", "close_price", "living_area_sqft", "zip_code")
)
SQL["nrm_money_area_zip"] = (
    WITH + "SELECT orderkey, linenumber, partkey, mls_number, original_list_price, last_list_price, "
    "close_price, living_area_sqft, zip_code FROM typed"
)

QUERIES["nrm_integers_booleans"] = _typed(
    ("days_on_market", "unit_floor", "total_stories", "beds", "year_built", "baths_full", "baths_half", "new_construction")
)
SQL["nrm_integers_booleans"] = (
    WITH + "SELECT orderkey, linenumber, partkey, days_on_market, unit_floor, total_stories, beds, "
    "year_built, baths_full, baths_half, new_construction FROM typed"
)

QUERIES["nrm_dates"] = _typed(("list_date", "pending_date", "close_date", "off_market_date", "status_change_date"))
SQL["nrm_dates"] = (
    WITH + "SELECT orderkey, linenumber, partkey, listed AS list_date, pending_date, close_date, "
    "off_market_date, status_change_date FROM typed"
)


def nrm_date_layouts(spark, folder):
    mapped, _ = normalize.map_columns(S.raw_export(spark, folder), S.KEEP)
    return normalize.layout_counts(normalize.coerce_types(mapped))


_LAYOUT = """CASE WHEN t IS NULL THEN NULL WHEN regexp_full_match(t, '\\d{4}-\\d+-\\d+') THEN '%Y-%m-%d'
  WHEN t LIKE '%:%' THEN '%Y-%m-%d %H:%M:%S' WHEN regexp_full_match(t, '\\d+/\\d+/\\d{4}') THEN '%m/%d/%Y'
  WHEN t LIKE '%/%' THEN '%m/%d/%y' WHEN t = 'soon' THEN 'unparsed' WHEN t LIKE '%-%' THEN '%d-%b-%Y' ELSE '%Y%m%d' END"""
QUERIES["nrm_date_layouts"] = nrm_date_layouts
SQL["nrm_date_layouts"] = WITH + f""", long AS (
  SELECT field, trim(t) AS t FROM (
    SELECT 'list_date' AS field, list_date_text AS t FROM raw UNION ALL SELECT 'pending_date', pending_text FROM raw
    UNION ALL SELECT 'close_date', close_text FROM raw UNION ALL SELECT 'off_market_date', off_text FROM raw
    UNION ALL SELECT 'status_change_date', change_text FROM raw)),
counts AS (SELECT field, {_LAYOUT} AS layout, count(*) AS rows FROM long WHERE t IS NOT NULL GROUP BY ALL)
SELECT *, count(*) FILTER (layout <> 'unparsed') OVER (PARTITION BY field) > 1 AS mixed FROM counts"""


def nrm_hoa(spark, folder):
    mapped, _ = normalize.map_columns(S.raw_export(spark, folder), S.KEEP)
    typed = normalize.coerce_types(mapped)
    return typed.select(*ROW, F.round("hoa_monthly", 6).alias("hoa_monthly"), "hoa_frequency")


QUERIES["nrm_hoa"] = nrm_hoa
SQL["nrm_hoa"] = WITH + (
    "SELECT orderkey, linenumber, partkey, round(hoa_monthly, 6) AS hoa_monthly, hoa_frequency FROM norm"
)


def nrm_status(spark, folder):
    return _frame(spark, folder).groupBy("status").agg(F.count("*").alias("rows"))


QUERIES["nrm_status"] = nrm_status
SQL["nrm_status"] = WITH + "SELECT status, count(*) AS rows FROM typed GROUP BY status"


def nrm_unit_floor(spark, folder):
    return _frame(spark, folder).select(
        *ROW, "unit_number", "unit_key", "floor", "floor_source", "is_penthouse", "floor_resolution"
    )


QUERIES["nrm_unit_floor"] = nrm_unit_floor
SQL["nrm_unit_floor"] = WITH + (
    "SELECT orderkey, linenumber, partkey, unit_number, unit_key, floor, floor_source, is_ph AS is_penthouse, "
    "floor_resolution FROM norm"
)


def nrm_parse_floor(spark, folder):
    mapped, _ = normalize.map_columns(S.raw_export(spark, folder, whole=False), S.KEEP)
    typed = normalize.coerce_types(mapped)
    parsed = floors.parse_floor(typed, "unit_number", "total_stories", "unit_floor")
    return parsed.select(*ROW, "floor", "floor_source", "is_penthouse", "floor_rejected")


QUERIES["nrm_parse_floor"] = nrm_parse_floor
SQL["nrm_parse_floor"] = WITH + """, u AS (
  SELECT *, coalesce(regexp_full_match(c, '(?i)(ph|lph)\\d*'), FALSE) AS ph, regexp_extract(c, '^[A-Za-z]*(\\d+)[A-Za-z]*$', 1) AS d
  FROM (SELECT orderkey, linenumber, partkey, unit_floor AS f, total_stories AS h, regexp_replace(unit_text, '[\\s#]', '', 'g') AS c FROM typed)),
g AS (SELECT *, CASE WHEN ph THEN NULL WHEN c LIKE 'TH%' THEN 1 WHEN c LIKE '%-%' THEN CAST(split_part(c, '-', 1) AS INTEGER)
  WHEN length(d) = 1 THEN CAST(d AS INTEGER) WHEN length(d) = 3 THEN CAST(d[1:1] AS INTEGER)
  WHEN length(d) > 3 THEN CAST(d[1:2] AS INTEGER) END AS n FROM u),
v AS (SELECT *, CASE WHEN f > 0 AND f > h THEN 'x' WHEN f > 0 THEN 'r' WHEN ph THEN 'p' WHEN c LIKE 'TH%' THEN 't'
  WHEN n > h THEN 'x' WHEN n IS NOT NULL THEN 't' ELSE 'm' END AS how FROM g)
SELECT orderkey, linenumber, partkey, CASE how WHEN 'r' THEN f WHEN 't' THEN n END AS floor,
  CASE how WHEN 'r' THEN 'reported' WHEN 'p' THEN 'parsed' WHEN 't' THEN 'parsed' ELSE 'missing' END AS floor_source,
  how = 'p' AS is_penthouse, how = 'x' AS floor_rejected FROM v"""


def nrm_floor_counts(spark, folder):
    return normalize.floor_counts(_frame(spark, folder))


QUERIES["nrm_floor_counts"] = nrm_floor_counts
SQL["nrm_floor_counts"] = WITH + (
    "SELECT floor_source, floor_resolution, count(*) AS rows, count(*) FILTER (floor_rejected) AS rejected "
    "FROM norm GROUP BY ALL"
)


def nrm_list_date(spark, folder):
    return _frame(spark, folder).select(*ROW, "list_date", "list_date_source", "_list_date_rejected")


QUERIES["nrm_list_date"] = nrm_list_date
SQL["nrm_list_date"] = WITH + (
    "SELECT orderkey, linenumber, partkey, list_date, list_date_source, "
    "list_date_rejected AS _list_date_rejected FROM norm"
)


def nrm_list_date_counts(spark, folder):
    return normalize.list_date_counts(_frame(spark, folder), ["status"])


QUERIES["nrm_list_date_counts"] = nrm_list_date_counts
SQL["nrm_list_date_counts"] = WITH + (
    "SELECT status, count(*) AS rows, count(*) FILTER (list_date_source = 'derived_from_dom') AS recovered, "
    "count(*) FILTER (list_date_rejected) AS rejected FROM norm GROUP BY status"
)


def nrm_duration_event(spark, folder):
    return _frame(spark, folder).select(
        *ROW, "duration_days", "duration_source", "event_sold", "pending_treated_as_sold", "submarket"
    )


QUERIES["nrm_duration_event"] = nrm_duration_event
SQL["nrm_duration_event"] = WITH + (
    "SELECT orderkey, linenumber, partkey, CAST(duration_days AS DOUBLE) AS duration_days, duration_source, "
    "event_sold, pending_treated_as_sold, submarket FROM norm"
)


def nrm_price_per_area(spark, folder):
    return _frame(spark, folder).select(
        *ROW, F.round("list_ppsf", 6).alias("list_ppsf"), F.round("close_ppsf", 6).alias("close_ppsf")
    )


QUERIES["nrm_price_per_area"] = nrm_price_per_area
SQL["nrm_price_per_area"] = WITH + (
    "SELECT orderkey, linenumber, partkey, round(list_ppsf, 6) AS list_ppsf, round(close_ppsf, 6) AS close_ppsf FROM norm"
)


def nrm_leftover_headers(spark, folder):
    raw = S.raw_export(spark, folder)
    return leftover_counts(raw, resolve_headers([c for c in raw.columns if c not in S.KEEP]))


QUERIES["nrm_leftover_headers"] = nrm_leftover_headers
SQL["nrm_leftover_headers"] = WITH + (
    "SELECT 'Remarks' AS header, count(remark_text) AS non_null FROM raw "
    "UNION ALL SELECT 'MLS', count(board_text) FROM raw"
)


def nrm_unmapped_map(spark, folder):
    frame = _frame(spark, folder)
    return frame.groupBy(
        F.element_at("_unmapped", "Remarks").alias("remarks"), F.element_at("_unmapped", "MLS").alias("board")
    ).agg(F.count("*").alias("rows"))


QUERIES["nrm_unmapped_map"] = nrm_unmapped_map
SQL["nrm_unmapped_map"] = WITH + (
    "SELECT remark_text AS remarks, board_text AS board, count(*) AS rows FROM raw GROUP BY ALL"
)


def nrm_snapshot(spark, folder):
    frame = S.normalized(spark, folder, whole=False)
    return frame.frame.groupBy(F.lit(frame.snapshot).alias("snapshot")).agg(
        F.count(F.when(F.col("list_date") > F.lit(frame.snapshot), 1)).alias("listed_after")
    )


QUERIES["nrm_snapshot"] = nrm_snapshot
SQL["nrm_snapshot"] = WITH + (
    "SELECT CAST(snapshot AS DATE) AS snapshot, count(*) FILTER (list_date > snapshot) AS listed_after FROM norm GROUP BY 1"
)


def nrm_cancelled_choices(spark, folder):
    frame = S.listings(spark, folder, "status", "pending_date")
    coded = None
    for choice in ("censored", "excluded", "event"):
        part = frame.withColumns(normalize.sale_event(choice))
        part = part.groupBy("cancelled_treatment").agg(
            F.sum("event_sold").alias("events"),
            F.count(F.when(F.col("cancelled_excluded"), 1)).alias("excluded"),
        )
        coded = part if coded is None else coded.unionByName(part)
    return coded


QUERIES["nrm_cancelled_choices"] = nrm_cancelled_choices
SQL["nrm_cancelled_choices"] = WITH + """, n AS (SELECT sum(event_sold) AS e, count(*) FILTER (status = 'CANCELED') AS c FROM norm)
SELECT 'censored' AS cancelled_treatment, CAST(e AS BIGINT) AS events, 0 AS excluded FROM n
UNION ALL SELECT 'excluded', CAST(e AS BIGINT), c FROM n UNION ALL SELECT 'event', CAST(e + c AS BIGINT), 0 FROM n"""


def src_file_quarter(spark, folder):
    docs = S.tables(spark, folder, "orders")["orders"]
    name = F.concat(
        F.when(F.col("o_custkey") % 3 == 0, "~ ").otherwise(""),
        F.when(F.col("o_custkey") % 2 == 0, "Q").otherwise("q"),
        F.quarter("o_orderdate").cast("string"),
        F.when(F.col("o_custkey") % 5 == 0, "").otherwise("-"),
        F.year("o_orderdate").cast("string"),
        F.lit(".csv"),
    )
    named = docs.select(F.when(F.col("o_custkey") % 7 == 0, "notes.csv").otherwise(name).alias("file"))
    return named.groupBy(quarter_of_file(F.col("file")).alias("file_quarter")).agg(F.count("*").alias("rows"))


QUERIES["src_file_quarter"] = src_file_quarter
SQL["src_file_quarter"] = """SELECT CASE WHEN o_custkey % 7 <> 0 THEN concat(year(o_orderdate), 'Q', quarter(o_orderdate)) END AS file_quarter,
  count(*) AS rows FROM orders GROUP BY 1"""


def cln_waterfall(spark, folder):
    return S.cleaned(spark, folder, columns=()).waterfall


QUERIES["cln_waterfall"] = cln_waterfall
SQL["cln_waterfall"] = WITH_CLEAN + (
    "SELECT coalesce(drop_reason, 'kept') AS reason, count(*) AS rows FROM judged GROUP BY 1"
)


def cln_rows(spark, folder):
    columns = (*ROW, "mls_number", "list_ppsf_source", "close_ppsf_source", "list_ppsf_outlier")
    rows = S.cleaned(spark, folder, columns=(*columns, "list_ppsf")).frame
    return rows.select(*columns, F.round("list_ppsf", 6).alias("list_ppsf"))


QUERIES["cln_rows"] = cln_rows
SQL["cln_rows"] = WITH_CLEAN + (
    "SELECT orderkey, linenumber, partkey, mls_number, list_ppsf_source, close_ppsf_source, list_ppsf_outlier, "
    "round(list_ppsf, 6) AS list_ppsf FROM clean"
)


def cln_counts(spark, folder):
    columns = ("list_ppsf_outlier", "list_ppsf_source", "close_ppsf_source")
    return clean.clean_counts(S.cleaned(spark, folder, columns=columns).frame)


QUERIES["cln_counts"] = cln_counts
SQL["cln_counts"] = WITH_CLEAN + (
    "SELECT count(*) AS rows_out, count(*) FILTER (list_ppsf_outlier) AS outlier_flagged, "
    "count(*) FILTER (list_ppsf_source = 'implausible') AS list_ppsf_implausible, "
    "count(*) FILTER (close_ppsf_source = 'implausible') AS close_ppsf_implausible FROM clean"
)


def cln_outlier_cells(spark, folder):
    lines = S.tables(spark, folder, "lineitem")["lineitem"].withColumns(
        {"ppsf": F.col("l_extendedprice") / F.col("l_quantity"), "cell": dates.quarter_key("l_shipdate")}
    )
    marked = clean.flag_outliers(lines, "ppsf", ["l_suppkey", "cell"], "outlier", sigmas=2)
    return marked.groupBy("cell", "outlier").agg(F.count("*").alias("rows"))


QUERIES["cln_outlier_cells"] = cln_outlier_cells
SQL["cln_outlier_cells"] = """WITH l AS (
  SELECT l_suppkey, concat(year(l_shipdate), 'Q', quarter(l_shipdate)) AS cell, l_extendedprice / l_quantity AS ppsf FROM lineitem),
m AS (SELECT cell, coalesce(abs(ppsf - avg(ppsf) OVER c) > 2 * stddev_samp(ppsf) OVER c AND count(ppsf) OVER c >= 5, FALSE) AS outlier
  FROM l WINDOW c AS (PARTITION BY l_suppkey, cell))
SELECT cell, outlier, count(*) AS rows FROM m GROUP BY ALL"""


def cln_keep_first(spark, folder):
    lines = S.tables(spark, folder, "lineitem")["lineitem"].withColumn(
        "id", F.concat_ws("-", "l_orderkey", "l_linenumber")
    )
    order = ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    kept = clean.mark_duplicates(lines, "id", order, F.lit(True)).where(~F.col("_duplicate"))
    return kept.select("id", *order)


QUERIES["cln_keep_first"] = cln_keep_first
SQL["cln_keep_first"] = """SELECT id, l_partkey, l_suppkey, l_shipdate, l_extendedprice FROM (
  SELECT concat(l_orderkey, '-', l_linenumber) AS id, *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS r FROM lineitem) WHERE r = 1"""
