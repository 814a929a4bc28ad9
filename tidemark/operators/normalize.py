"""Typed listings out of text: dates, status, floor, duration, event."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.errors import SchemaError
from tidemark.functions import dates, floors, text
from tidemark.functions.common import col, first_match, tally
from tidemark.functions.finance import safe_ratio
from tidemark.session import attach
from tidemark.sources.headers import HeaderMap, map_columns
from tidemark.sources.settings import CANCELLED_CHOICES

MONEY = ("original_list_price", "last_list_price", "close_price", "hoa_monthly", "tax_annual")
DATES = ("list_date", "pending_date", "close_date", "off_market_date", "status_change_date")
BOOLEANS = ("new_construction", "waterfront")
WHOLE = (
    "days_on_market", "cumulative_days_on_market", "beds", "unit_floor",
    "year_built", "total_stories",
)
REAL = ("baths_full", "baths_half")
LAYOUT_SUFFIX = "_layout"


def coerce_types(df: DataFrame) -> DataFrame:
    """Typed canonical columns, plus ``<date>_layout`` for every date column."""
    typed: dict[str, Column] = {name: text.money(name) for name in MONEY}
    typed |= {name + "_moment": dates.read_date(name) for name in DATES}
    typed |= {name: text.boolean(name) for name in BOOLEANS}
    typed |= {name: text.whole(name) for name in WHOLE}
    typed |= {name: text.real(name) for name in REAL}
    typed["living_area_sqft"] = text.area("living_area_sqft")
    typed["zip_code"] = text.postal_code("zip_code")
    typed["mls_number"] = text.strip("mls_number")
    df = df.withColumns(typed)
    settled: dict[str, Column] = {}
    for name in DATES:
        settled[name] = F.col(name + "_moment")
        settled[name + LAYOUT_SUFFIX] = dates.date_layout(name, name + "_moment")
    settled["hoa_monthly"] = text.monthly_fee("hoa_monthly", "hoa_frequency")
    settled["hoa_frequency"] = text.fee_label("hoa_monthly", "hoa_frequency")
    return df.withColumns(settled).drop(*[name + "_moment" for name in DATES])


def layout_counts(typed: DataFrame, columns: tuple[str, ...] = DATES) -> DataFrame:
    """``(field, layout, rows, mixed)``: how each date column was read."""
    pairs = [
        F.struct(F.lit(c).alias("field"), F.col(c + LAYOUT_SUFFIX).alias("layout")) for c in columns
    ]
    long = typed.select(F.inline(F.array(*pairs))).where(F.col("layout").isNotNull())
    counts = long.groupBy("field", "layout").agg(F.count("*").alias("rows"))
    # At most a handful of layouts per field.
    read = counts.where(F.col("layout") != "unparsed").groupBy("field").agg(
        (F.count("*") > 1).alias("mixed")
    )
    return counts.join(read, "field", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False)))


def export_snapshot(
    df: DataFrame,
    columns: tuple[str, ...] = ("status_change_date", "close_date", "pending_date", "list_date"),
):
    """Day of the export: the maximum of the first column that has a value; later ones are not read."""
    days = (df.agg(F.max(c).cast("date")).first()[0] for c in columns)
    return next((day for day in days if day is not None), None)


def with_list_date(df: DataFrame, snapshot, quarter: str | None = None) -> DataFrame:
    """Fill a missing list date as anchor minus days on market.

    The anchor is the snapshot for active rows, else the first of off-market,
    pending and status-change date.  A derived date outside the quarter of its
    own file is dropped again.  Adds ``list_date_source`` and
    ``_list_date_rejected``.
    """
    snapshot = F.lit(snapshot).cast("timestamp_ntz")
    ended = F.coalesce("off_market_date", "pending_date", "status_change_date")
    live = F.coalesce(F.col("status") == "ACTIVE", F.lit(False))
    anchor = F.when(live, F.coalesce(snapshot, ended)).otherwise(ended)
    dom = F.col("days_on_market")
    derived = F.when(
        F.col("list_date").isNull() & (dom >= 0), dates.minus_days(anchor, dom)
    )
    df = df.withColumn("_derived", derived)
    outside = F.lit(False)
    if quarter is not None:
        outside = F.coalesce(dates.quarter_key("_derived") != F.col(quarter), F.lit(False))
    df = df.withColumn("_list_date_rejected", F.col("_derived").isNotNull() & outside)
    kept = F.when(~F.col("_list_date_rejected"), F.col("_derived"))
    return df.withColumns(
        {
            "list_date_source": F.when(F.col("list_date").isNotNull(), "reported")
            .when(kept.isNotNull(), "derived_from_dom")
            .otherwise("missing"),
            "list_date": F.coalesce("list_date", kept),
        }
    ).drop("_derived")


def with_duration(df: DataFrame, snapshot) -> DataFrame:
    """Days on the market and the rule that gave them; only positive spans count."""
    status = F.col("status")
    ends = {
        "pending_date": (status.isin("SOLD", "PENDING"), F.col("pending_date")),
        "close_date": (status == "SOLD", F.col("close_date")),
        "off_market_date": (
            status.isin("EXPIRED", "WITHDRAWN", "CANCELED"), F.col("off_market_date"),
        ),
        "export_date": (status == "ACTIVE", F.lit(snapshot).cast("timestamp_ntz")),
    }
    df = df.withColumns(
        {
            f"_to_{name}": F.when(rule, dates.whole_days(end, "list_date"))
            for name, (rule, end) in ends.items()
        }
    )
    spans = {name: F.col(f"_to_{name}") for name in ends}
    spans["days_on_market"] = F.col("days_on_market").cast("double")
    return df.withColumns(
        {
            "duration_days": first_match([(days > 0, days) for days in spans.values()]),
            "duration_source": first_match([(days > 0, F.lit(name)) for name, days in spans.items()]),
        }
    ).drop(*[f"_to_{name}" for name in ends])


def sale_event(cancelled: str = "censored") -> dict[str, Column]:
    """Event flag, the pending-as-sold mark and the cancelled-excluded mark."""
    if cancelled not in CANCELLED_CHOICES:
        raise SchemaError(f"cancelled must be one of {CANCELLED_CHOICES}, got {cancelled!r}")
    status = F.coalesce("status", F.lit(""))
    pending = (status == "PENDING") & F.col("pending_date").isNotNull()
    sold = (status == "SOLD") | pending
    if cancelled == "event":
        sold = sold | (status == "CANCELED")
    return {
        "event_sold": sold.cast("int"),
        "pending_treated_as_sold": pending,
        "cancelled_excluded": (status == "CANCELED") & F.lit(cancelled == "excluded"),
        "cancelled_treatment": F.lit(cancelled),
    }


def with_submarket(df: DataFrame, zips: DataFrame, zip_column: str = "zip_code") -> DataFrame:
    """Left lookup of the submarket; unlisted codes stay null."""
    table = zips.select(F.col("zip_code").alias(zip_column), "submarket")
    return attach(df, table, [zip_column])


def with_unit_and_floor(df: DataFrame) -> DataFrame:
    """Unit number out of the address where blank, floor verdict, unit key."""
    unit = F.nullif(text.strip("unit_number"), F.lit(""))
    unit = F.when(~unit.isin("<NA>", "nan", "None"), F.col("unit_number"))
    df = df.withColumn(
        "unit_number", F.coalesce(unit, floors.unit_from_address("street_address"))
    )
    df = floors.resolve_floor(df, "unit_number", "unit_floor", "total_stories")
    return text.with_unit_key(df, "building_name", "street_address", "unit_number")


@dataclass
class Normalized:
    """The typed listing frame, the header map and the snapshot it was read at."""

    frame: DataFrame
    headers: HeaderMap | None
    snapshot: object


def normalize_listings(
    raw: DataFrame,
    zips: DataFrame,
    cancelled: str = "censored",
    snapshot=None,
    quarter: str | None = None,
    keep: tuple[str, ...] = (),
) -> Normalized:
    """The whole path from export text to typed listings.

    Lazy but for one aggregate: the snapshot date, when it is not given.
    """
    mapped, headers = map_columns(raw, keep)
    typed = text.with_status(coerce_types(mapped))
    if snapshot is None:
        snapshot = export_snapshot(typed)
    frame = with_unit_and_floor(with_list_date(typed, snapshot, quarter))
    area = F.col("living_area_sqft")
    frame = with_duration(frame, snapshot).withColumns(
        {
            "list_ppsf": F.when(area > 0, safe_ratio("original_list_price", area)),
            "close_ppsf": F.when(area > 0, safe_ratio("close_price", area)),
            **sale_event(cancelled),
        }
    )
    return Normalized(with_submarket(frame, zips), headers, snapshot)


def floor_counts(frame: DataFrame) -> DataFrame:
    """``(floor_source, floor_resolution, rows, rejected)``."""
    return frame.groupBy("floor_source", "floor_resolution").agg(
        F.count("*").alias("rows"), tally(F.col("floor_rejected")).alias("rejected")
    )


def list_date_counts(frame: DataFrame, keys: list[str] = []) -> DataFrame:
    """Recovered and rejected list dates."""
    return frame.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        tally(F.col("list_date_source") == "derived_from_dom").alias("recovered"),
        tally(col("_list_date_rejected")).alias("rejected"),
    )
