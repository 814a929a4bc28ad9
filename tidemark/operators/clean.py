"""Cleaning: ordered drop reasons, keep-first dedup, plausibility, outlier marks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.common import col, first_match, tally
from tidemark.functions.dates import quarter_key
from tidemark.functions.text import contains_any, flag, squash
from tidemark.session import attach, land, settle

# Phrases that mark a distressed sale, a rental or a condo.
DISTRESS_WORDS = ("foreclosure", "shortsale", "auction", "reo", "bankowned")
RENTAL_WORDS = ("rent", "lease", "forrent")
CONDO_WORDS = ("condo", "condominium", "coop", "cooperative")

# Believable dollars per square foot, longest spell, outlier band.
PPSF_RANGE = (100.0, 20_000.0)
MAX_DURATION = 1095
PPSF = ("list_ppsf", "close_ppsf")
OUTLIER_SIGMAS = 3
OUTLIER_MIN_ROWS = 5

REASON = "drop_reason"


def distressed(sale_type, excluded: list[str]) -> Column:
    """Any excluded type or distress word inside the squashed sale type."""
    words = [w for w in ("".join(ch for ch in e.lower() if ch.isalnum()) for e in excluded) if w]
    return contains_any(squash(sale_type), [*words, *DISTRESS_WORDS])


def rental(property_type, sale_type) -> Column:
    """A rental word in either column."""
    return contains_any(F.concat_ws("|", squash(property_type), squash(sale_type)), RENTAL_WORDS)


def allowed_property(property_type, allowed: list[str]) -> Column:
    """A known property type; blank and punctuation-only text counts as unknown and stays."""
    word = F.coalesce(squash(property_type), F.lit(""))
    names = ["".join(ch for ch in a.lower() if ch.isalnum()) for a in allowed]
    return (word == "") | contains_any(word, [*(n for n in names if n), *CONDO_WORDS])


def static_reason(
    excluded_sales: list[str] = [],
    allowed_properties: list[str] = [],
    min_price: float | None = None,
) -> Column:
    """First filter a row fails on its own, in the fixed order; null when none."""
    rules: list[tuple[Column, str]] = [
        (distressed("sale_type", excluded_sales), "distressed_sale_type"),
        (flag(F.col("is_reo").cast("string")), "distressed_reo"),
        (flag(F.col("is_short_sale").cast("string")), "distressed_short_sale"),
        (rental("property_type", "sale_type"), "rental_or_lease"),
    ]
    if allowed_properties:
        rules.append((~allowed_property("property_type", allowed_properties), "wrong_property_type"))
    if min_price is not None:
        rules.append((F.col("original_list_price") < min_price, "below_min_list_price"))
    rules.append((F.col("cancelled_excluded"), "cancelled_excluded"))
    return first_match([(rule, F.lit(name)) for rule, name in rules])


def bad_duration(days="duration_days") -> Column:
    """Outside one day to the longest believable spell; null passes."""
    days = col(days)
    return F.coalesce((days <= 0) | (days > MAX_DURATION), F.lit(False))


def _hashable(df: DataFrame) -> list[Column]:
    """The columns in a form that can be hashed: anything that holds a map as text."""
    return [F.to_json(F.struct(F.col(f"`{n}`"))) if "map<" in t else F.col(f"`{n}`") for n, t in df.dtypes]


def mark_duplicates(df: DataFrame, ident: str, order: list[str], among: Column, whole: DataFrame | None = None) -> DataFrame:
    """Flag ``_duplicate``: rows of ``among`` that share an id with an earlier one.

    The earliest order value per id is aggregated, so an id that fills a third of the table
    costs one row per task and value, not one task.  Exactly one row of an id stays: rows tied
    on ``order`` are told apart by a hash of all their values, and of rows equal in every
    column any one stays.  Null ids are never duplicates.  The table is read twice: for the
    ids with copies, a table of counted size, and for the rows beside it.

    ``df`` may hold fewer columns than the table has; ``whole`` is then the table itself, read
    only for the rows that tie.
    """
    position = F.struct(*[F.col(c) for c in order])
    seen = df.where(among & F.col(ident).isNotNull()).select(ident, position.alias("_first"))
    each = seen.groupBy(ident, "_first").agg(F.count("*").alias("_tied"))
    first = settle(
        each.groupBy(ident).agg(F.min("_first").alias("_first"), F.min_by("_tied", "_first").alias("_tied"), F.sum("_tied").alias("_copies"))
        .where(F.col("_copies") > 1).drop("_copies")
    )
    joined = attach(df, first, [ident]).withColumn("_among", among)
    found = F.col("_among") & F.col("_first").isNotNull()
    joined = joined.withColumn("_duplicate", F.coalesce(found & (position > F.col("_first")), F.lit(False)))
    columns = [*df.columns, "_duplicate"]
    tied = first.where(F.col("_tied") > 1)
    if tied.isEmpty():
        return joined.select(columns)
    at_tie = F.coalesce(found & (position == F.col("_first")) & (F.col("_tied") > 1), F.lit(False))
    whole = df if whole is None else whole
    ties = attach(whole.where(among), tied.select(ident, "_first"), [ident], "inner").where(position == F.col("_first"))
    ties = settle(ties.withColumn("_hash", F.xxhash64(*_hashable(whole))))
    equal = ties.groupBy(ident, "_hash").agg(F.count("*").alias("_equal"))
    least = equal.groupBy(ident).agg(F.min("_hash").alias("_least"), F.min_by("_equal", "_hash").alias("_equal"))
    ties = attach(ties, least, [ident])
    # Rows equal to the first one in every column: one of them stays, the others are its copies.
    is_first = F.col("_hash") == F.col("_least")
    copies = F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("_equal")), lambda i: i > 1))
    same = ties.where(is_first).dropDuplicates([ident]).withColumn("_duplicate", copies)
    later = ties.where(~is_first).withColumn("_duplicate", F.lit(True))
    return joined.where(~at_tie).select(columns).unionByName(same.select(columns)).unionByName(later.select(columns))


def plausible_ppsf(df: DataFrame, columns: tuple[str, ...] = PPSF) -> DataFrame:
    """Null prices per square foot outside the believable range and say so."""
    for name in columns:
        value = F.col(name)
        label = F.when(value.isNull(), "missing").when(value.between(*PPSF_RANGE), "computed")
        df = df.withColumn(f"{name}_source", label.otherwise("implausible"))
        df = df.withColumn(name, F.when(F.col(f"{name}_source") == "computed", value))
    return df


def flag_outliers(
    df: DataFrame,
    value: str,
    keys: list[str],
    flag_as: str,
    min_rows: int = OUTLIER_MIN_ROWS,
    sigmas: float = OUTLIER_SIGMAS,
) -> DataFrame:
    """Mark values beyond the sigma band of their cell; null keys form a cell.

    Cell moments are one pre-aggregated pass joined back, so no cell is ever
    gathered in one task.
    """
    safe = {f"_k{i}": F.struct(F.col(k).alias("k")) for i, k in enumerate(keys)}
    df = df.withColumns(safe)
    cells = (
        df.groupBy(*safe)
        .agg(
            F.avg(value).alias("_mu"),
            F.stddev_samp(value).alias("_sd"),
            F.count(value).alias("_n"),
        )
        .where((F.col("_n") >= min_rows) & (F.col("_sd") > 0))
    )
    joined = attach(df, cells, list(safe))
    band = sigmas * F.col("_sd")
    beyond = (F.col(value) < F.col("_mu") - band) | (F.col(value) > F.col("_mu") + band)
    return joined.withColumn(flag_as, F.coalesce(beyond, F.lit(False))).drop(
        "_mu", "_sd", "_n", *safe
    )


@dataclass
class Cleaned:
    """Kept rows, every row with its drop reason, and the waterfall."""

    frame: DataFrame
    judged: DataFrame
    waterfall: DataFrame


def clean_listings(
    df: DataFrame,
    order: list[str],
    excluded_sales: list[str] = [],
    allowed_properties: list[str] = [],
    min_price: float | None = None,
    ident: str = "mls_number",
    columns: list[str] | None = None,
) -> Cleaned:
    """Filter in order, null implausible prices, mark outliers.

    Every reason counts only rows that no earlier reason took.  ``columns`` names the columns
    of the kept rows that will be read; the filters then run over these and their own inputs
    alone, and the rows are the same.
    """
    df = df.withColumn(REASON, static_reason(excluded_sales, allowed_properties, min_price))
    rows, prices = df, list(PPSF)
    if columns is not None:
        prices = [c for c in PPSF if c == "list_ppsf" or {c, f"{c}_source"} & set(columns)]
        wanted = [*order, ident, *columns, *prices, "duration_days", "submarket", "list_date", REASON]
        # Written once: read for the ids with copies and for the rows beside them.
        rows = land(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(wanted) if c in df.columns]), "typed")
    judged = mark_duplicates(rows, ident, order, F.col(REASON).isNull(), df)
    judged = judged.withColumn(
        REASON,
        F.coalesce(
            F.col(REASON),
            F.when(F.col("_duplicate"), "duplicate_mls_number"),
            F.when(bad_duration(), "bad_duration"),
        ),
    ).drop("_duplicate")
    # Written once: the kept rows and the waterfall are both read from it.
    judged = land(judged, "judged")
    frame = plausible_ppsf(judged.where(F.col(REASON).isNull()).drop(REASON), tuple(prices))
    frame = frame.withColumn("_list_quarter", quarter_key("list_date"))
    frame = flag_outliers(frame, "list_ppsf", ["submarket", "_list_quarter"], "list_ppsf_outlier")
    return Cleaned(frame.drop("_list_quarter"), judged, waterfall(judged))


def waterfall(judged: DataFrame, keys: list[str] = []) -> DataFrame:
    """``(reason, rows)``; kept rows are the reason ``kept``."""
    return judged.groupBy(*keys, F.coalesce(REASON, F.lit("kept")).alias("reason")).agg(
        F.count("*").alias("rows")
    )


def clean_counts(frame: DataFrame) -> DataFrame:
    """Outliers marked and prices nulled among the kept rows."""
    return frame.agg(
        F.count("*").alias("rows_out"),
        tally(F.col("list_ppsf_outlier")).alias("outlier_flagged"),
        tally(F.col("list_ppsf_source") == "implausible").alias("list_ppsf_implausible"),
        tally(F.col("close_ppsf_source") == "implausible").alias("close_ppsf_implausible"),
    )
