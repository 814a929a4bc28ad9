"""Features of a cleaned listing table."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import dates
from tidemark.functions.common import all_of, col, finite, first_match
from tidemark.functions.finance import safe_ratio
from tidemark.functions.floors import floor_band
from tidemark.functions.text import strip
from tidemark.operators.quantiles import grouped_median, grouped_quantiles, right_closed_bucket
from tidemark.session import attach, land

# The covariates whose nulls decide the usable sample.
COVARIATES = (
    "rel_price_premium", "log_floor", "living_area_sqft", "beds",
    "hoa_per_sqft", "is_new_construction", "submarket", "season",
    "inventory_competition",
)

# Multi-valued fields and the prefix of their indicators.
TOKEN_FIELDS = {
    "view_description": "view",
    "waterfront_description": "wf",
    "parking_description": "park",
    "restrictions": "rest",
}
LEVEL_FIELDS = ("furnished_info", "special_assessment", "association_type")
TOKEN_MIN_SHARE = 0.01
MISSING_LEVEL = "__missing__"
NEW_BUILD_YEARS = 2
MIN_CELL = 8
AGE_RANGE = (-5, 150)


def cell_median_premium(
    df: DataFrame,
    value: str,
    place: str,
    month: str,
    quarter: str,
    min_cell: int = MIN_CELL,
    labels: tuple[str, str] = ("submarket_month", "submarket_quarter"),
) -> DataFrame:
    """Premium of each row over the median of its cell.

    The cell is (place, month) when it holds enough usable rows, else (place,
    quarter), else there is none.  Medians always use every usable row of the
    cell.  Adds ``cell_median_ppsf``, ``rel_price_premium``, ``median_basis``.
    """
    usable = (col(value) > 0) & F.col(place).isNotNull() & F.col(month).isNotNull()
    usable = F.coalesce(usable, F.lit(False))
    rows = df.where(usable).select(place, month, quarter, value)
    months = grouped_median(rows, [place, month], value, "_m_med", "_m_n")
    quarters = grouped_median(rows, [place, quarter], value, "_q_med", "_q_n")
    # The quarter table is needed only for thin months, but it is tiny either way.
    joined = attach(attach(df, months, [place, month]), quarters, [place, quarter])
    dense_month = usable & (F.coalesce("_m_n", F.lit(0)) >= min_cell)
    dense_quarter = usable & (F.coalesce("_q_n", F.lit(0)) >= min_cell)
    median = F.when(dense_month, F.col("_m_med")).when(dense_quarter, F.col("_q_med"))
    basis = first_match(
        [
            (~usable, F.lit("missing")),
            (dense_month, F.lit(labels[0])),
            (dense_quarter, F.lit(labels[1])),
        ],
        F.lit("insufficient"),
    )
    return joined.withColumns(
        {
            "cell_median_ppsf": median,
            "rel_price_premium": col(value) / median - 1,
            "median_basis": basis,
        }
    ).drop("_m_med", "_m_n", "_q_med", "_q_n")


def cell_sizes(df: DataFrame, keys: list[str], count_as: str = "n") -> DataFrame:
    """Rows per cell, null keys left out."""
    return df.where(all_of(F.col(k).isNotNull() for k in keys)).groupBy(*keys).agg(
        F.count("*").alias(count_as)
    )


def entry_competition(df: DataFrame, place: str, month: str) -> DataFrame:
    """Other rows that enter the same cell; null where a key is missing."""
    table = cell_sizes(df, [place, month], "_entries")
    return (
        attach(df, table, [place, month])
        .withColumn("inventory_competition", (F.col("_entries") - 1).cast("double"))
        .drop("_entries")
    )


def size_bucket(df: DataFrame, place: str, area: str) -> DataFrame:
    """Quartile of the area within its place, ties in one bucket.

    A place without four distinct areas and five distinct edges has no bucket.
    """
    quarters = {"_e0": 0.0, "_e1": 0.25, "_e2": 0.5, "_e3": 0.75, "_e4": 1.0}
    rows = df.where(F.col(place).isNotNull())
    edges = grouped_quantiles(rows, [place], area, quarters, "_n")
    # Five distinct edges imply at least four distinct areas among four or more rows.
    rising = all_of(F.col(f"_e{i}") < F.col(f"_e{i + 1}") for i in range(4))
    edges = edges.where((F.col("_n") >= 4) & rising).drop("_n")
    bucket = right_closed_bucket(area, [F.col(e) for e in quarters])
    return (
        attach(df, edges, [place])
        .withColumn("size_bucket", F.concat(F.lit("q"), bucket.cast("string")))
        .drop(*quarters)
    )


def hoa_rate(fee="hoa_monthly", area="living_area_sqft") -> dict[str, Column]:
    """Fee per square foot and where it comes from."""
    fee, area = col(fee), col(area)
    ok = (fee >= 0) & (area > 0)
    return {
        "hoa_per_sqft": F.when(ok, fee / area),
        "hoa_per_sqft_source": F.when(fee < 0, "negative").when(ok, "reported").otherwise("missing"),
    }


def new_construction(reported="new_construction", built="year_built", listed="list_date"):
    """Reported flag, else derived from age at listing."""
    age = F.year(col(listed)) - col(built)
    derived = age <= NEW_BUILD_YEARS
    return {
        "is_new_construction": F.coalesce(col(reported), derived),
        "is_new_construction_source": F.when(col(reported).isNotNull(), "reported")
        .when(derived.isNotNull(), "derived")
        .otherwise("missing"),
    }


def row_features() -> dict[str, Column]:
    """Features that need nothing but the row."""
    area, floor = F.col("living_area_sqft"), F.col("floor").cast("double")
    half = F.coalesce("baths_half", F.lit(0.0))
    baths = F.col("baths_full") + half * 0.5
    age = (F.year("list_date") - F.col("year_built")).cast("double")
    lease = finite(F.col("min_lease_days").cast("string").try_cast("double"))
    return {
        "list_month": dates.month_key("list_date"),
        "list_quarter": dates.quarter_key("list_date"),
        "season": dates.season("list_date"),
        "log_living_area": F.when(area > 0, F.log(area)),
        "log_floor": F.when(floor >= 0, F.log(floor + 1)),
        "floor_bucket": floor_band("floor"),
        "bed_bath_ratio": F.when(
            F.col("beds").isNotNull(),
            safe_ratio(baths, F.greatest(F.col("beds").cast("double"), F.lit(1.0))),
        ),
        **hoa_rate(),
        **new_construction(),
        "sold_to_list_ratio": safe_ratio("close_price", "original_list_price"),
        "price_cut_pct": safe_ratio("last_list_price", "original_list_price") - 1,
        "min_lease_days_value": F.coalesce(lease, F.lit(0.0)),
        "min_lease_days_missing": lease.isNull().cast("double"),
        "building_age_years": F.when(age.between(*AGE_RANGE), age),
        **{
            f"{name}_level": F.coalesce(strip(F.col(name).cast("string")), F.lit(MISSING_LEVEL))
            for name in LEVEL_FIELDS
        },
    }


def tokens_of(column) -> Column:
    """Distinct trimmed tokens of a comma-separated text; empty when blank."""
    parts = F.transform(F.split(col(column).cast("string"), ","), lambda t: strip(t))
    kept = F.array_distinct(F.filter(parts, lambda t: t != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))


def token_column(prefix: str, token: str) -> str:
    """Column name of a token."""
    return f"{prefix}_{re.sub(r'[^a-z0-9]+', '_', token.lower()).strip('_')}"


def token_counts(df: DataFrame, column: str) -> DataFrame:
    """``(token, rows)``: rows that carry each token."""
    return (
        df.select(F.explode(tokens_of(column)).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("rows"))
    )


@dataclass
class TokenVocabulary:
    """Kept tokens of one field and their columns, frozen at fit time."""

    prefix: str
    columns: dict[str, str] = field(default_factory=dict)
    dropped: str | None = None

    @property
    def names(self) -> list[str]:
        """Indicator columns in order, the missing mark last."""
        return [*dict.fromkeys(self.columns.values()), f"{self.prefix}_missing"]


def learn_tokens(
    df: DataFrame, column: str, prefix: str, min_share: float = TOKEN_MIN_SHARE
) -> TokenVocabulary:
    """Choose the tokens that reach the share of all rows, missing rows included.

    A row has few tokens, so at most (tokens per row / share) tokens qualify:
    the vocabulary is small whatever the table size.  Two tokens with one
    column name resolve to the later one in sort order.  When every row sums to
    one the most common token is left out as the reference.
    """
    total = df.count()
    least = max(1, int(min_share * total))
    found = token_counts(df, column).where(F.col("rows") >= least).collect()
    counts = {r["token"]: r["rows"] for r in found}
    by_column: dict[str, str] = {}
    for token in sorted(counts):
        by_column[token_column(prefix, token)] = token
    vocabulary = TokenVocabulary(prefix, {t: c for c, t in by_column.items()})
    if vocabulary.columns:
        block = sum(indicators(column, vocabulary).values(), F.lit(0.0))
        spread = df.select(block.alias("s")).agg(F.min("s"), F.max("s")).first()
        if tuple(spread) == (1.0, 1.0):
            top = max(sorted(counts), key=counts.get)
            vocabulary.columns = {
                t: c for t, c in vocabulary.columns.items() if c != token_column(prefix, top)
            }
            vocabulary.dropped = top
    return vocabulary


def indicators(column: str, vocabulary: TokenVocabulary) -> dict[str, Column]:
    """One 0/1 column per kept token, and the missing mark."""
    tokens = tokens_of(column)
    blank = F.coalesce(strip(F.col(column).cast("string")), F.lit("")) == ""
    block = {
        name: F.array_contains(tokens, token).cast("double")
        for token, name in vocabulary.columns.items()
    }
    block[f"{vocabulary.prefix}_missing"] = blank.cast("double")
    return block


@dataclass
class FeatureTable:
    """The feature frame and the vocabularies that shaped its columns."""

    frame: DataFrame
    tokens: dict[str, TokenVocabulary]
    premium_model: object | None = None


def build_features(
    df: DataFrame,
    min_cell: int = MIN_CELL,
    token_fields: dict[str, str] = TOKEN_FIELDS,
    hedonic: bool = True,
) -> FeatureTable:
    """All features, then the premium respecified as a hedonic residual."""
    from tidemark.errors import IdentificationError, SchemaError
    from tidemark.operators.hedonic import fit_premium, score_premium

    frame = df.withColumns(row_features())
    vocabularies: dict[str, TokenVocabulary] = {}
    filled = frame.agg(*[F.count(c).alias(c) for c in token_fields]).first()
    for column, prefix in token_fields.items():
        if filled[column]:
            vocabularies[column] = learn_tokens(frame, column, prefix)
            frame = frame.withColumns(indicators(column, vocabularies[column]))
    frame = cell_median_premium(
        frame, "list_ppsf", "submarket", "list_month", "list_quarter", min_cell
    )
    frame = entry_competition(frame, "submarket", "list_month")
    frame = size_bucket(frame, "submarket", "living_area_sqft")
    frame = frame.withColumn("cell_median_premium", F.col("rel_price_premium"))
    model = None
    if hedonic:
        # Scanned by every fit that follows.
        frame = land(frame, "features")
        tokens = [n for v in vocabularies.values() for n in v.names]
        try:
            model = fit_premium(frame, tokens=tokens)
        except (SchemaError, IdentificationError):
            model = None
        # Every later fit scans the scored table, not the scoring expression.
        frame = land(score_premium(frame, model), "scored")
    return FeatureTable(frame, vocabularies, model)
