"""Unit and floor numbers out of unit text, addresses and building heights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.common import col, first_match
from tidemark.functions.text import strip

# Patterns of unit text.
PENTHOUSE = r"(?i)^(ph|lph|phl|penthouse|lowerpenthouse)(-?[A-Za-z]?\d+)?$"
TOWNHOUSE = r"(?i)^(ts|th|townhouse)(-?\d+)?$"
UNIT_MARKERS = (
    r"(?i)\b(?:unit|apt|suite|ste)\s*#?\s*([A-Za-z0-9-]+)\b",
    r"#\s*([A-Za-z0-9-]+)\b",
)
# The last word before the first comma, when it has a digit or a unit prefix.
# No street suffix has either, so "12 Main Ave" names no unit.
LAST_WORD = r"(?i)\s#*((?=\S*\d|ph|lph|th|ts)[^#\s]\S*)$"

# Highest believable floor, lowest believable building height.
MAX_FLOOR = 150
MIN_STORIES = 2

FLOOR_BANDS = (("low", 1, 5), ("mid", 6, 12), ("high", 13, 25))
TOP_BAND = "tower"


def unit_from_address(address) -> Column:
    """The unit a street address names, by marker or as its last word."""
    text = strip(address)
    head = strip(F.regexp_extract(text, "^[^,]*", 0))
    found = [F.regexp_extract(text, p, 1) for p in UNIT_MARKERS]
    found.append(F.regexp_extract(head, LAST_WORD, 1))
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found])


def _with_reading(df: DataFrame, unit: str) -> DataFrame:
    """Add what the unit text says alone: ``_penthouse``, ``_townhouse``, ``_unit_floor``.

    Each step is a column of its own: later steps use it many times.
    """
    df = df.withColumn("_compact", F.regexp_replace(strip(unit), r"[\s#]", ""))
    df = df.withColumns(
        {
            "_penthouse": F.coalesce(
                F.col("_compact").rlike(f"{PENTHOUSE}|(?i)penthouse"), F.lit(False)
            ),
            "_townhouse": F.coalesce(F.col("_compact").rlike(TOWNHOUSE), F.lit(False)),
            "_dashed": F.regexp_extract("_compact", r"^([^-]*)-", 1),
            "_digits": F.regexp_extract("_compact", r"^[A-Za-z]*(\d+)[A-Za-z]*$", 1),
        }
    )
    n = F.length("_digits")
    digits = first_match(
        [
            (F.col("_penthouse"), F.lit(None)),
            (F.col("_townhouse"), F.lit("1")),
            (F.col("_compact").contains("-"), F.regexp_replace("_dashed", "[^0-9]", "")),
            (n == 1, F.col("_digits")),
            (n == 3, F.substring("_digits", 1, 1)),
            (n >= 4, F.substring("_digits", 1, 2)),
        ]
    )
    return df.withColumn("_unit_floor", digits.try_cast("int")).drop(
        "_compact", "_dashed", "_digits"
    )


def _verdict(kind: Column, reported: Column) -> dict[str, Column]:
    """Columns of a decision: where the floor is taken from, or why there is none."""
    return {
        "floor": F.when(kind == "reported", reported).when(kind == "parsed", F.col("_unit_floor")),
        "floor_source": F.when(kind.isin("reported", "parsed"), kind)
        .when(kind == "penthouse", "parsed")
        .otherwise("missing"),
        "floor_rejected": kind == "rejected",
    }


def parse_floor(df: DataFrame, unit: str, stories: str, reported: str) -> DataFrame:
    """Add ``floor, floor_source, is_penthouse, floor_rejected``.

    A reported floor wins; a floor above the building height is rejected.
    """
    df = _with_reading(df, unit)
    stated, height = F.col(reported), F.col(stories)
    kind = first_match(
        [
            ((stated > 0) & (stated > height), F.lit("rejected")),
            (stated > 0, F.lit("reported")),
            (F.col("_penthouse"), F.lit("penthouse")),
            (F.col("_townhouse"), F.lit("parsed")),
            (F.col("_unit_floor") > height, F.lit("rejected")),
            (F.col("_unit_floor").isNotNull(), F.lit("parsed")),
        ],
        F.lit("missing"),
    )
    df = df.withColumn("_kind", kind)
    verdict = _verdict(F.col("_kind"), stated)
    verdict["is_penthouse"] = F.col("_kind") == "penthouse"
    return df.withColumns(verdict).drop("_kind", "_penthouse", "_townhouse", "_unit_floor")


# How a floor was settled, and what the floor is then taken from.
RESOLUTIONS = {
    "from_unit_number": "parsed",
    "reported_no_height": "reported",
    "reported_ok": "reported",
    "height_impeached_by_unit_number": "reported",
    "floor_impeached_by_unit_number": "parsed",
    "unresolved_conflict": "rejected",
}


def resolve_floor(df: DataFrame, unit: str, reported: str, stories: str) -> DataFrame:
    """Settle a reported floor, a building height and a unit number.

    The unit number decides when the other two disagree; when it backs neither,
    the floor stays null.  Adds ``floor, floor_source, is_penthouse,
    floor_resolution, floor_rejected``.
    """
    df = _with_reading(df, unit).withColumns(
        {
            "_stated": F.when(F.col(reported).between(1, MAX_FLOOR), F.col(reported)),
            "_height": F.when(F.col(stories).between(MIN_STORIES, MAX_FLOOR), F.col(stories)),
        }
    )
    stated, height, floor = F.col("_stated"), F.col("_height"), F.col("_unit_floor")
    too_high = F.coalesce((floor > height) & ~F.col("_townhouse"), F.lit(False))
    resolution = first_match(
        [
            (stated.isNull() & floor.isNotNull() & ~too_high, F.lit("from_unit_number")),
            (stated.isNull(), F.lit("unresolved")),
            (height.isNull(), F.lit("reported_no_height")),
            (stated <= height, F.lit("reported_ok")),
            (F.abs(floor - stated) <= 1, F.lit("height_impeached_by_unit_number")),
            (floor <= height, F.lit("floor_impeached_by_unit_number")),
        ],
        F.lit("unresolved_conflict"),
    )
    df = df.withColumn("floor_resolution", resolution)
    label = F.col("floor_resolution")
    kind = first_match(
        [
            *[(label == name, F.lit(source)) for name, source in RESOLUTIONS.items()],
            (F.col("_penthouse"), F.lit("penthouse")),
            (too_high, F.lit("rejected")),
        ],
        F.lit("missing"),
    )
    df = df.withColumn("_kind", kind)
    verdict = _verdict(F.col("_kind"), stated)
    verdict["is_penthouse"] = F.col("_penthouse")
    return df.withColumns(verdict).drop(
        "_kind", "_stated", "_height", "_penthouse", "_townhouse", "_unit_floor"
    )


def floor_band(floor) -> Column:
    """``low``, ``mid``, ``high`` or ``tower``; null below the first floor."""
    floor = col(floor).cast("int")
    rules = [(floor.between(lo, hi), F.lit(name)) for name, lo, hi in FLOOR_BANDS]
    return first_match([*rules, (floor > FLOOR_BANDS[-1][2], F.lit(TOP_BAND))])
