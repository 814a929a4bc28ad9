"""The ingest report: the cleaned table and its report tables, out of one scan of the input.

All figures of the whole table (counts, null counts, spans, totals per known label) are
observed while the cleaned table is being written.  Tables that need groups (cells, buildings,
codes without a submarket) read a few columns of the written copy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from tidemark.functions.common import all_of, tally
from tidemark.operators import profile
from tidemark.operators.sampling import NARROW_SHARE, TERMINAL
from tidemark.sources.headers import CANONICAL, IMPORTANT, REQUIRED, HeaderMap
from tidemark.sources.reports import write_tables

# Labels that are counted by name; anything else is counted as other.
STATUSES = ("SOLD", "ACTIVE", "PENDING", "EXPIRED", "WITHDRAWN", "CANCELED")
FLOOR_SOURCES = ("reported", "parsed", "missing")
LIST_DATE_SOURCES = ("reported", "derived_from_dom", "missing")
CENSORED = ("EXPIRED", "WITHDRAWN", "CANCELED")
DERIVED = ("floor", "floor_source", "list_ppsf", "duration_days", "submarket", "event_sold")
LABELS = {"status": STATUSES, "floor_source": FLOOR_SOURCES, "list_date_source": LIST_DATE_SOURCES}


@dataclass
class IngestReport:
    """Where everything was written, and the figures of the whole table."""

    paths: dict[str, str]
    figures: dict

    def table(self, spark, name: str) -> DataFrame:
        """One of the written tables: figures, types, labels, cells, buildings, top_unmapped, waterfall, mapping, warnings, cleaned."""
        return spark.read.parquet(self.paths[name])


def _figures(df: DataFrame, fields: list[str]) -> dict[str, Column]:
    """Aggregates over the whole cleaned table, by the name of the figure."""
    status = F.col("status")
    terminal = F.greatest(*[F.col(c) for c in TERMINAL])
    usable = all_of(F.col(c).isNotNull() for c in (*REQUIRED, "duration_days", "submarket"))
    found = {
        "rows_out": F.count(F.lit(1)),
        "non_sold": F.count(F.lit(1)) - tally(status == "SOLD"),
        "censored": tally(status.isin(*CENSORED)),
        "pending_as_sold": tally(F.col("pending_treated_as_sold")),
        "events": F.coalesce(F.sum("event_sold").cast("bigint"), F.lit(0)),
        "usable_rows": tally(usable),
        "rows_with_submarket": F.count("submarket"),
        "rows_without_submarket": tally(F.col("submarket").isNull()),
        "list_ppsf_implausible": tally(F.col("list_ppsf_source") == "implausible"),
        "outlier_flagged": tally(F.col("list_ppsf_outlier")),
        "list_date_recovered": tally(F.col("list_date_source") == "derived_from_dom"),
        "rows_with_both_dates": tally(F.col("list_date").isNotNull() & terminal.isNotNull()),
        "list_min": F.min("list_date").cast("date"), "list_max": F.max("list_date").cast("date"),
        "terminal_min": F.min(terminal).cast("date"), "terminal_max": F.max(terminal).cast("date"),
    }
    for column, labels in LABELS.items():
        for label in labels:
            found[f"{column}={label}"] = tally(F.col(column) == label)
        found[f"{column}=other"] = tally(~F.coalesce(F.col(column), F.lit("")).isin(*labels))
    return found | {f"null:{c}": tally(F.col(c).isNull()) for c in fields}


def _warnings(v: dict, mixed: list[str]) -> list[str]:
    found = [f"mixed date formats in {c}" for c in mixed]
    if v["censored"] == 0:
        found.append("elasticity not identifiable: only sold records")
    if v["rows_out"] and v["rows_without_submarket"] / v["rows_out"] > profile.COVERAGE_WARN:
        found.append("submarket coverage gap")
    if v["list_ppsf_implausible"]:
        found.append("implausible price per square foot nulled")
    if v["list_date_recovered"]:
        found.append("list dates recovered from days on market")
    if all(v[c] for c in ("list_min", "list_max", "terminal_min", "terminal_max")):
        listed, ended = (v["list_max"] - v["list_min"]).days, (v["terminal_max"] - v["terminal_min"]).days
        if listed > 0 and ended < NARROW_SHARE * listed and v["status=ACTIVE"] == 0:
            found.append("sample selected on the end of the spell")
    return found


def write_ingest(
    frame: DataFrame, folder: str, headers: HeaderMap | None = None, judged: DataFrame | None = None,
    layouts: DataFrame | None = None, min_cell: int = profile.MIN_CELL,
) -> IngestReport:
    """Write the cleaned listings and every table of their report under ``folder``.

    ``frame`` is read once.  ``judged`` (every row with its drop reason) gives the waterfall,
    ``headers`` the mapping, ``layouts`` (field, mixed) the date formats that did not agree.
    """
    spark = frame.sparkSession
    fields = [c for c in dict.fromkeys([*CANONICAL, *DERIVED]) if c in frame.columns]
    wanted = _figures(frame, fields)
    names = {f"c{i}": n for i, n in enumerate(wanted)}
    seen = Observation("ingest")
    observed = frame.observe(seen, *[c.alias(f"c{i}") for i, c in enumerate(wanted.values())])
    place = f"{folder.rstrip('/')}/cleaned"
    observed.write.mode("overwrite").parquet(place)
    v = {names[k]: x for k, x in seen.get.items()}
    back = spark.read.parquet(place)
    types, n = dict(frame.dtypes), v["rows_out"]
    kind = "field string, type string, nulls bigint, rate double"
    tables = {
        "figures": spark.createDataFrame(
            [(k, None if x is None or hasattr(x, "year") else float(x), x.isoformat() if hasattr(x, "year") else None) for k, x in v.items() if ":" not in k and "=" not in k],
            "figure string, value double, day string",
        ),
        "types": spark.createDataFrame([(c, types[c], v[f"null:{c}"], round(v[f"null:{c}"] / n, 4) if n else None) for c in fields], kind),
        "labels": spark.createDataFrame([(*k.split("=", 1), x) for k, x in v.items() if "=" in k], "column string, label string, rows bigint"),
        "cells": profile.dense_cells(
            back.where(F.col("submarket").isNotNull() & F.col("list_date").isNotNull()).withColumn("list_month", F.date_format("list_date", "yyyy-MM")),
            ["submarket", "list_month"], min_cell,
        ),
        "buildings": profile.building_support(back),
        "top_unmapped": profile.top_unmapped(back),
    }
    if judged is not None:
        from tidemark.operators.clean import waterfall

        tables["waterfall"] = waterfall(judged)
    if headers is not None:
        rows = [(h, f, "matched") for f, h in headers.chosen.items()] + [(h, None, "unmapped") for h in headers.leftover]
        rows += [(None, f, "required missing") for f in headers.required_missing] + [(None, f, "important missing") for f in headers.important_missing if f in IMPORTANT]
        tables["mapping"] = spark.createDataFrame(rows, "header string, field string, state string")
    mixed = [] if layouts is None else [r["field"] for r in layouts.where(F.col("mixed")).select("field").distinct().orderBy("field").collect()]
    tables["warnings"] = spark.createDataFrame([(w,) for w in _warnings(v, mixed)], "warning string")
    return IngestReport({"cleaned": place, **write_tables(tables, folder)}, v)
