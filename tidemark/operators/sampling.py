"""How an export was drawn: date windows, runs in file order, cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.common import col, tally
from tidemark.functions.dates import quarter_key
from tidemark.operators.quantiles import grouped_quantiles
from tidemark.session import attach, settle

TERMINAL = ("close_date", "pending_date", "off_market_date")
NARROW_SHARE = 0.75


def with_terminal(df: DataFrame, columns: tuple[str, ...] = TERMINAL) -> DataFrame:
    """Latest of the dates that may end a spell."""
    return df.withColumn("terminal_date", F.greatest(*[F.col(c) for c in columns]))


def sampling_window(df: DataFrame, keys: list[str] = []) -> DataFrame:
    """Spans of list and terminal dates, and whether the sample was selected on the end."""
    df = with_terminal(df)
    spans = df.groupBy(*keys).agg(
        F.min("list_date").cast("date").alias("list_min"),
        F.max("list_date").cast("date").alias("list_max"),
        F.min("terminal_date").cast("date").alias("terminal_min"),
        F.max("terminal_date").cast("date").alias("terminal_max"),
        tally(F.col("status") == "ACTIVE").alias("active"),
        F.round(F.avg((F.col("list_date").isNotNull() & F.col("terminal_date").isNotNull()).cast("double")), 4).alias(
            "complete_share"
        ),
    )
    spans = settle(spans)
    if keys:
        early = attach(df, spans.select(*keys, "terminal_min"), keys).where(F.col("list_date") < F.col("terminal_min"))
        counts = early.groupBy(*keys).agg(F.count("*").alias("started_before"))
        spans = attach(spans, counts, keys)
    else:
        start = spans.first()["terminal_min"]
        n = df.where(F.col("list_date") < F.lit(start)).count() if start else 0
        spans = spans.withColumn("started_before", F.lit(n).cast("bigint"))
    list_span = F.date_diff("list_max", "list_min")
    terminal_span = F.date_diff("terminal_max", "terminal_min")
    selected = (list_span > 0) & (terminal_span < NARROW_SHARE * list_span) & (F.col("active") == 0)
    return spans.withColumns(
        {
            "started_before": F.coalesce("started_before", F.lit(0)),
            "list_span_days": list_span,
            "terminal_span_days": terminal_span,
            "selected_on_terminal": F.coalesce(selected, F.lit(False)),
        }
    )


def runs(df: DataFrame, keys: list[str], block: str, order: list[str], value: str) -> DataFrame:
    """``(keys, run, value, rows)``: maximal stretches of equal values in order.

    ``block`` cuts each sequence into pieces that follow the order (a file
    split, an hour).  Runs are found inside the pieces, then pieces are joined
    at their ends from two values each; no whole file is ever in one task.
    """
    text = F.coalesce(F.col(value).cast("string"), F.lit("nan"))
    rows = df.select(*keys, block, *order, text.alias("_v"))
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    changed = F.coalesce((F.col("_v") != F.lag("_v").over(inside)).cast("int"), F.lit(0))
    rows = rows.withColumn("_change", changed)
    rows = rows.withColumn(
        "_local", F.sum("_change").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    pieces = rows.groupBy(*keys, block, "_local").agg(F.first("_v").alias("_v"), F.count("*").alias("_n"))
    pieces = settle(pieces)
    # One row per piece of a sequence: its first and last value, its changes.
    ends = pieces.groupBy(*keys, block).agg(
        F.min_by("_v", "_local").alias("_first"), F.max_by("_v", "_local").alias("_last"), F.max("_local").alias("_changes")
    )
    across = Window.partitionBy(*keys).orderBy(block)
    opens = F.coalesce((F.col("_first") != F.lag("_last").over(across)).cast("int"), F.lit(0))
    ends = ends.withColumn("_opens", opens)
    before = F.sum(F.col("_changes") + F.col("_opens")).over(across.rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.select(*keys, block, (before - F.col("_changes")).alias("_offset"))
    return (
        attach(pieces, ends, [*keys, block])
        .groupBy(*keys, (F.col("_offset") + F.col("_local")).alias("run"))
        .agg(F.first("_v").alias("value"), F.sum("_n").alias("rows"))
    )


def sorted_by_value(run_table: DataFrame, keys: list[str]) -> DataFrame:
    """Whether each sequence is one block per value, and its last block."""
    per_value = run_table.groupBy(*keys, "value").agg(
        F.count("*").alias("blocks"), F.max(F.struct("run", "rows")).alias("last")
    )
    table = per_value.groupBy(*keys).agg(
        F.sum("blocks").alias("runs"), F.count("*").alias("distinct_values"),
        F.max_by("value", "last").alias("last_value"), F.max("last.run").alias("_r"),
        F.max_by("last.rows", "last").alias("last_rows"),
    )
    return table.drop("_r").withColumn(
        "sorted_by_value", (F.col("runs") == F.col("distinct_values")) & (F.col("runs") > 1)
    )


def terminal_by_status(df: DataFrame, keys: list[str] = []) -> DataFrame:
    """Range of terminal dates per status."""
    return with_terminal(df).groupBy(*keys, "status").agg(
        F.count("*").alias("rows"),
        F.min("terminal_date").cast("date").alias("first_end"),
        F.max("terminal_date").cast("date").alias("last_end"),
    )


def start_cohorts(df: DataFrame, keys: list[str] = []) -> DataFrame:
    """Rows, median spell and event rate per quarter of listing."""
    rows = with_terminal(df).where(F.col("list_date").isNotNull() & F.col("terminal_date").isNotNull())
    rows = rows.withColumns(
        {"cohort": quarter_key("list_date"), "spell": F.date_diff("terminal_date", "list_date")}
    )
    medians = grouped_quantiles(rows, [*keys, "cohort"], "spell", {"median_days": 0.5})
    sums = rows.groupBy(*keys, "cohort").agg(
        F.count("*").alias("rows"), F.avg("event_sold").alias("event_rate")
    )
    return sums.join(medians, [*keys, "cohort"])


def observable_bounds(df: DataFrame, window_start, window_end) -> DataFrame:
    """Shortest and longest spell that can be seen per quarter of listing."""
    rows = df.where(F.col("list_date").isNotNull())
    low = F.greatest(F.date_diff(F.lit(window_start), "list_date"), F.lit(0))
    high = F.date_diff(F.lit(window_end), "list_date")
    return rows.groupBy(quarter_key("list_date").alias("cohort")).agg(
        F.min(low).alias("least_days"), F.max(low).alias("least_days_max"), F.max(high).alias("most_days")
    )


def edge_censoring(df: DataFrame, days: int = 180, keys: list[str] = []) -> DataFrame:
    """Late against earlier listings: event rate and median duration."""
    latest = df.agg(F.max("list_date")).first()[0]
    rows = df.where(F.col("list_date").isNotNull()).withColumn(
        "late", F.date_diff(F.lit(latest).cast("date"), "list_date") < days
    )
    medians = grouped_quantiles(rows, [*keys, "late"], "duration_days", {"median_days": 0.5})
    sums = rows.groupBy(*keys, "late").agg(
        F.count("*").alias("rows"), F.avg(col("event_sold").cast("double")).alias("event_rate")
    )
    return sums.join(medians, [*keys, "late"], "left")
