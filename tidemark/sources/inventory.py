"""Developer inventories: reading, validating, and the scoring view of a unit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.errors import SchemaError
from tidemark.functions.common import all_of
from tidemark.functions.text import strip

# Inventory columns and the plausible range of each number.
REQUIRED = (
    "unit_id", "living_area_sqft", "floor", "beds", "cost_basis_ppsf",
    "completion_date", "unit_type", "submarket",
)
OPTIONAL = ("baths", "view", "building", "hoa_monthly")
RANGES = {
    "living_area_sqft": (200.0, 20_000.0),
    "floor": (1.0, 150.0),
    "beds": (0.0, 12.0),
    "cost_basis_ppsf": (50.0, 5_000.0),
}


def read_inventory(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """Inventory rows of a CSV or JSON file, every column a string."""
    if kind == "csv":
        return spark.read.option("header", True).option("escape", '"').csv(path)
    return spark.read.option("primitivesAsString", True).json(path)


def check_inventory(
    df: DataFrame,
    row_number: str,
    keys: list[str] = [],
    submarkets: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Split an inventory into valid typed rows and a table of row errors.

    ``row_number`` orders the rows within ``keys`` (one inventory per key).
    Duplicates point at the first row of the same id, even if that row is
    invalid itself.
    """
    absent = [c for c in REQUIRED if c not in df.columns]
    if absent:
        raise SchemaError(f"inventory misses required columns: {absent}")
    unit = F.nullif(strip(F.col("unit_id").cast("string")), F.lit(""))
    df = df.withColumn("unit_id", unit)
    first = df.where(F.col("unit_id").isNotNull()).groupBy(*keys, "unit_id").agg(
        F.min(row_number).alias("_first")
    )
    df = df.join(first, [*keys, "unit_id"], "left")

    def issue(condition, field, message):
        return F.when(
            condition, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"))
            if isinstance(message, str)
            else F.struct(F.lit(field).alias("field"), message.alias("message")),
        )

    issues = [
        issue(F.col("unit_id").isNull(), "unit_id", "missing"),
        issue(
            F.col("_first") < F.col(row_number),
            "unit_id",
            F.concat(F.lit("duplicate of row "), F.col("_first").cast("string")),
        ),
    ]
    typed = {}
    for name, (low, high) in RANGES.items():
        value = F.col(name).try_cast("double")
        value = F.when(~F.isnan(value), value)
        typed[name] = value
        issues.append(issue(value.isNull(), name, "missing or not a number"))
        issues.append(issue(~value.between(low, high), name, f"outside {low:g}-{high:g}"))
    completion = F.col("completion_date").try_cast("date")
    issues.append(issue(completion.isNull(), "completion_date", "missing or not a date"))
    kind = F.coalesce(strip(F.col("unit_type").cast("string")), F.lit(""))
    issues.append(issue(kind == "", "unit_type", "missing"))
    place = F.coalesce(strip(F.col("submarket").cast("string")), F.lit(""))
    issues.append(issue(place == "", "submarket", "missing"))
    if submarkets:
        issues.append(
            issue((place != "") & ~place.isin(*submarkets), "submarket", "not a known submarket")
        )

    checked = df.withColumn("_issues", F.filter(F.array(*issues), lambda x: x.isNotNull()))
    errors = checked.select(*keys, F.col(row_number).alias("row_number"), "unit_id", F.inline("_issues"))
    valid = (
        checked.where(F.size("_issues") == 0)
        .withColumns({**typed, "completion_date": completion})
        .drop("_issues", "_first")
    )
    return valid, errors


def scoring_view(units: DataFrame, view_tokens: dict[str, str] | None = None) -> DataFrame:
    """The unit in the words of the fitted models.

    ``view_tokens`` is the fitted vocabulary (token to column); the indicator
    columns always follow it, never the inventory's own tokens.
    """
    floor, area = F.col("floor").cast("double"), F.col("living_area_sqft").cast("double")
    nothing = F.lit(None).cast("double")
    baths = F.col("baths").cast("double") if "baths" in units.columns else nothing
    fee = F.col("hoa_monthly").cast("double") if "hoa_monthly" in units.columns else nothing
    view = F.col("view") if "view" in units.columns else F.lit(None).cast("string")
    derived = {
        "log_floor": F.when(floor >= 0, F.log1p(floor)),
        "log_living_area": F.when(area > 0, F.log(area)),
        "baths_full": F.floor(baths).cast("double"),
        "baths_half": (baths - F.floor(baths) >= 0.5).cast("double"),
        "hoa_per_sqft": F.when(area > 0, fee / area),
        "view_description": view,
        "is_new_construction": F.lit(True),
    }
    units = units.withColumns(derived)
    if view_tokens:
        parts = F.transform(F.split("view_description", ","), lambda t: strip(t))
        units = units.withColumns(
            {
                name: F.coalesce(F.array_contains(parts, token), F.lit(False)).cast("double")
                for token, name in view_tokens.items()
            }
        )
    return units


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with no null in the named columns."""
    return df.where(all_of(F.col(c).isNotNull() for c in columns))
