"""Data-quality and identification audits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.common import finite, tally
from tidemark.functions.dates import minus_days, quarter_key, whole_days
from tidemark.functions.distributions import chi_square_p, t_p
from tidemark.operators.concordance import parts_for
from tidemark.operators.features import cell_sizes
from tidemark.operators.quantiles import (
    MAX_GROUP, grouped_middle, grouped_quantiles, weighted_quantiles,
)
from tidemark.session import attach, beside, settle

CELL_SIZES = (1, 2, 4, 8, 16, 32)
# Interquartile range of the standard normal.
NORMAL_IQR = 1.349
PREMIUM_TAILS = (0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999)


def cell_size_ladder(df: DataFrame, keys: list[str]) -> DataFrame:
    """``(least, cells, rows)`` for cells of at least each size."""
    sums = cell_sizes(df, keys).agg(
        *[tally(F.col("n") >= k).alias(f"c{k}") for k in CELL_SIZES],
        *[F.coalesce(F.sum(F.when(F.col("n") >= k, F.col("n"))), F.lit(0)).alias(f"r{k}") for k in CELL_SIZES],
    )
    steps = [
        F.struct(F.lit(k).alias("least"), F.col(f"c{k}").alias("cells"), F.col(f"r{k}").alias("rows"))
        for k in CELL_SIZES
    ]
    return sums.select(F.inline(F.array(*steps)))


def median_cell_size(df: DataFrame, keys: list[str]) -> DataFrame:
    """Median rows per cell, from counts of counts."""
    sizes = cell_sizes(df, keys).groupBy("n").agg(F.count("*").alias("c"))
    return weighted_quantiles(sizes, [], "n", "c", {"median_size": 0.5})


def median_noise(df: DataFrame, keys: list[str], value: str, premium: str, least: int = 4) -> DataFrame:
    """Sampling noise of the cell medians and the attenuation it implies."""
    cells = grouped_quantiles(df, keys, value, {"q1": 0.25, "m": 0.5, "q3": 0.75}, "n")
    spread = (F.col("q3") - F.col("q1")) / NORMAL_IQR
    noise = (math.pi / 2) * spread * spread / F.col("n") / (F.col("m") * F.col("m"))
    usable = cells.where((F.col("n") >= least) & (F.col("q3") > F.col("q1")))
    left = usable.agg(F.avg(noise).alias("noise_variance"), F.count("*").alias("cells"))
    right = df.agg(F.var_samp(finite(premium)).alias("premium_variance"))
    both = beside(left, right)
    return both.withColumn(
        "attenuation", 1 - F.try_divide(F.col("noise_variance"), F.col("premium_variance"))
    )


def leave_one_out_median(
    df: DataFrame, keys: list[str], value: str, least: int = 8, max_group: int = MAX_GROUP
) -> DataFrame:
    """Median of a cell without the row itself, as ``loo_median``.

    Leaving one value out moves the median to a neighbouring rank, so three
    order statistics per cell answer every row, without a self-join.  Cells under ``least`` rows have none.
    """
    middle = grouped_middle(df, keys, value, max_group)
    middle = middle.where(F.col("_n") >= least)
    joined = attach(df, middle, keys)
    v, lo, mid, hi = F.col(value), F.col("_lo"), F.col("_mid"), F.col("_hi")
    odd = F.when(v < mid, (mid + hi) / 2).when(v > mid, (lo + mid) / 2).otherwise((lo + hi) / 2)
    even = F.when(v <= lo, hi).otherwise(lo)
    loo = F.when(v.isNotNull() & F.col("_n").isNotNull(), F.when(F.col("_n") % 2 == 1, odd).otherwise(even))
    return joined.withColumn("loo_median", loo).drop("_lo", "_mid", "_hi", "_n")


def inclusive_vs_left_out(df: DataFrame, premium: str, left_out: str) -> DataFrame:
    """Bias, deviation and correlation of two versions of the premium."""
    both = df.where(finite(premium).isNotNull() & finite(left_out).isNotNull())
    gap = F.col(premium) - F.col(left_out)
    return both.agg(
        F.count("*").alias("rows"), F.avg(gap).alias("mean_gap"), F.stddev_pop(gap).alias("sd_gap"),
        F.corr(premium, left_out).alias("corr"),
        F.stddev_pop(premium).alias("sd_inclusive"), F.stddev_pop(left_out).alias("sd_left_out"),
    )


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """``(row, column, rows, column_share)`` of two categories, nulls as text."""
    a = F.coalesce(F.col(row).cast("string"), F.lit("<blank>")).alias("row")
    b = F.coalesce(F.col(column).cast("string"), F.lit("<blank>")).alias("column")
    cells = df.groupBy(a, b).agg(F.count("*").alias("rows"))
    totals = cells.groupBy("column").agg(F.sum("rows").alias("_t"))
    return attach(cells, totals, ["column"]).select(
        "row", "column", "rows", (F.col("rows") / F.col("_t")).alias("column_share")
    )


def chi_square(cells: DataFrame) -> DataFrame:
    """Independence test of a crosstab; empty cells count as zero."""
    left = cells.groupBy("row").agg(F.sum("rows").alias("a"))
    top = cells.groupBy("column").agg(F.sum("rows").alias("b"))
    # sum (o - e)^2 / e = n * (sum o^2 / (a b) - 1), so empty cells need no rows.
    joined = attach(attach(cells, left, ["row"]), top, ["column"])
    sums = joined.agg(
        F.sum("rows").cast("double").alias("n"),
        F.sum(F.col("rows") * F.col("rows") / (F.col("a").cast("double") * F.col("b"))).alias("s"),
        F.count_distinct("row").alias("r"), F.count_distinct("column").alias("k"),
    )
    row = sums.first()
    freedom = (row["r"] - 1) * (row["k"] - 1)
    value = row["n"] * (row["s"] - 1)
    p = chi_square_p(value, freedom) if freedom > 0 else 1.0
    return cells.sparkSession.createDataFrame(
        [(float(value), int(freedom), float(p))], "chi2 double, freedom int, p_value double"
    )


def welch(df: DataFrame, group: Column, value: str) -> DataFrame:
    """Welch's t between the rows of a group and the rest."""
    v = finite(value)
    a, b = F.when(group, v), F.when(~group, v)
    row = df.agg(
        F.count(a).alias("n1"), F.avg(a).alias("m1"), F.var_samp(a).alias("v1"),
        F.count(b).alias("n2"), F.avg(b).alias("m2"), F.var_samp(b).alias("v2"),
    ).first()
    e1, e2 = row["v1"] / row["n1"], row["v2"] / row["n2"]
    t = (row["m1"] - row["m2"]) / math.sqrt(e1 + e2)
    freedom = (e1 + e2) ** 2 / (e1**2 / (row["n1"] - 1) + e2**2 / (row["n2"] - 1))
    return df.sparkSession.createDataFrame(
        [(row["m1"], row["m2"], t, freedom, t_p(t, freedom))],
        "mean_in double, mean_out double, t double, freedom double, p_value double",
    )


def _gaps(total_in: int, total_out: int):
    """Per task of values in order: its counts, and the largest and least gap from its start on."""

    def run(batches):
        upto = np.zeros(2)
        high, low = -math.inf, math.inf
        for batch in batches:
            if len(batch):
                running = upto + np.cumsum(batch[["a", "b"]].to_numpy(dtype="float64"), axis=0)
                gap = running[:, 0] / max(total_in, 1) - running[:, 1] / max(total_out, 1)
                high, low, upto = max(high, gap.max()), min(low, gap.min()), running[-1]
        if low < math.inf:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "a": [upto[0]], "b": [upto[1]], "high": [high], "low": [low]})

    return run


def kolmogorov_smirnov(df: DataFrame, group: Column, value: str) -> DataFrame:
    """Largest gap between the distributions of a group and the rest, exactly.

    Values are counted first and sorted by range; a task's running counts start from the totals
    of the tasks before it, which are two numbers a task.
    """
    rows = df.select(finite(value).alias("v"), F.coalesce(group, F.lit(False)).alias("g"))
    rows = rows.where(F.col("v").isNotNull())
    counts = settle(rows.groupBy("v").agg(tally(F.col("g")).alias("a"), tally(~F.col("g")).alias("b")))
    many, sa, sb = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    sorted_ = counts.repartitionByRange(parts_for(counts, many), "v").sortWithinPartitions("v")
    found = sorted_.mapInPandas(_gaps(sa, sb), "part int, a double, b double, high double, low double").collect()
    d, upto = None, 0.0
    for r in sorted(found, key=lambda r: r["part"]):
        d = max(d or 0.0, abs(upto + r["high"]), abs(upto + r["low"]))
        upto += r["a"] / max(sa, 1) - r["b"] / max(sb, 1)
    root = math.sqrt(sa * sb / (sa + sb)) if sa and sb else 0.0
    return df.sparkSession.createDataFrame(
        [(sa, sb, d, _kolmogorov_tail(root * (d or 0.0)))], "n_in bigint, n_out bigint, d double, p_value double"
    )


def _kolmogorov_tail(x: float) -> float:
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def spell_sanity(df: DataFrame) -> DataFrame:
    """``(span, rows, negative, zero, longest)`` of each date difference."""
    ends = ("pending_date", "close_date", "off_market_date")
    spans = [whole_days(e, "list_date") for e in ends]
    sums = df.agg(
        *[F.count(s).alias(f"n{i}") for i, s in enumerate(spans)],
        *[tally(s < 0).alias(f"m{i}") for i, s in enumerate(spans)],
        *[tally(s == 0).alias(f"z{i}") for i, s in enumerate(spans)],
        *[F.max(s).alias(f"x{i}") for i, s in enumerate(spans)],
    )
    rows = [
        F.struct(
            F.lit(e).alias("span"), F.col(f"n{i}").alias("rows"), F.col(f"m{i}").alias("negative"),
            F.col(f"z{i}").alias("zero"), F.col(f"x{i}").alias("longest"),
        )
        for i, e in enumerate(ends)
    ]
    return sums.select(F.inline(F.array(*rows)))


def duration_fallbacks(df: DataFrame) -> DataFrame:
    """Rows that fell back to reported days, with and without a list date."""
    fell = F.col("duration_source") == "days_on_market"
    return df.agg(
        tally(fell).alias("fallback"),
        tally(fell & F.col("list_date").isNotNull()).alias("fallback_with_list_date"),
        tally(F.col("duration_days").isNull()).alias("no_duration"),
    )


def relists(df: DataFrame, unit_key: str = "unit_key") -> DataFrame:
    """Distinct unit keys, keys seen again, rows they cover, the largest group."""
    counts = df.where(F.col(unit_key) != "").groupBy(unit_key).agg(F.count("*").alias("n"))
    again = F.col("n") > 1
    return counts.agg(
        F.count("*").alias("distinct_keys"), tally(again).alias("repeated_keys"),
        F.coalesce(F.sum(F.when(again, F.col("n"))), F.lit(0)).alias("repeated_rows"),
        F.coalesce(F.max(F.when(again, F.col("n"))), F.lit(0)).alias("largest"),
    )


def tail_quantiles(df: DataFrame, value: str) -> DataFrame:
    """``(probability, value)`` far into both tails."""
    names = {f"q{i}": p for i, p in enumerate(PREMIUM_TAILS)}
    wide = grouped_quantiles(df, [], value, names)
    rows = [F.struct(F.lit(p).alias("probability"), F.col(n).alias("value")) for n, p in names.items()]
    return wide.select(F.inline(F.array(*rows)))


def list_date_identity(df: DataFrame, anchor: str, keys: list[str] = ["status"]) -> DataFrame:
    """Reported list date against anchor minus days on market: share of exact and near hits."""
    error = whole_days(minus_days(anchor, "days_on_market"), "list_date")
    known = df.where(
        (F.col("list_date_source") == "reported") & F.col(anchor).isNotNull() & F.col("days_on_market").isNotNull()
    ).withColumn("_e", error)
    return known.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.avg((F.col("_e") == 0).cast("double")).alias("exact"),
        F.avg((F.abs("_e") <= 1).cast("double")).alias("within_1"),
        F.avg((F.abs("_e") <= 3).cast("double")).alias("within_3"),
    )


def anchor_scores(
    df: DataFrame, anchors: list[str], quarter: str, keys: list[str] = []
) -> DataFrame:
    """Candidate anchors ranked by how often they land in the file's own quarter.

    Scored on rows without a reported list date.
    """
    need = df.where(F.col("list_date_source") != "reported")
    pairs = [
        F.struct(F.lit(a).alias("anchor"), minus_days(a, "days_on_market").alias("candidate")) for a in anchors
    ]
    long = need.select(*keys, quarter, F.inline(F.array(*pairs)))
    hit = F.coalesce(quarter_key("candidate") == F.col(quarter), F.lit(False))
    return long.groupBy(*keys, "anchor").agg(
        F.count("*").alias("rows"), F.count("candidate").alias("available"), tally(hit).alias("in_quarter"),
        F.avg(hit.cast("double")).alias("coverage"),
    )


def snapshot_per_file(df: DataFrame, file: str, columns: list[str]) -> DataFrame:
    """Latest date seen anywhere in each file."""
    return df.groupBy(file).agg(F.max(F.greatest(*columns)).cast("date").alias("snapshot"))


def file_profile(df: DataFrame, file: str, ident: str, columns: list[str]) -> DataFrame:
    """``(file, field, rows, filled, distinct)`` and id uniqueness per file.

    Values are counted once per (file, field, value) and then again per field,
    so no exact-distinct expansion holds a hot file together.
    """
    pairs = [F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in [ident, *columns]]
    values = df.select(F.col(file).alias("file"), F.inline(F.array(*pairs))).groupBy("file", "field", "value").agg(
        F.count("*").alias("n")
    )
    filled = F.when(F.col("value").isNotNull(), F.col("n"))
    return values.groupBy("file", "field").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(filled), F.lit(0)).alias("filled"),
        F.count("value").alias("distinct"),
    )


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Most common values; ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows"))
    return counts.orderBy(F.desc("rows"), column).limit(k)


def column_ratio(df: DataFrame, top: str, bottom: str) -> DataFrame:
    """Quantiles of the ratio of two overlapping columns, shares near 1 and near 12."""
    ratio = F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom))
    rows = df.select(ratio.alias("r")).where(F.col("r").isNotNull())
    quantiles = grouped_quantiles(rows, [], "r", {"p10": 0.1, "median": 0.5, "p90": 0.9})
    sums = rows.agg(
        F.count("*").alias("rows"), F.avg("r").alias("mean"),
        F.avg(F.col("r").between(0.95, 1.05).cast("double")).alias("near_1"),
        F.avg(F.col("r").between(11, 13).cast("double")).alias("near_12"),
    )
    return beside(sums, quantiles)


def floor_conflicts(df: DataFrame, floor: str = "unit_floor", stories: str = "total_stories") -> DataFrame:
    """Floors above the building height, and how many of those heights are blank-coded."""
    above = F.col(floor) > F.col(stories)
    return df.agg(
        F.count(floor).alias("floors"), F.count(stories).alias("heights"), tally(above).alias("conflicts"),
        tally(above & (F.col(stories) <= 1)).alias("unusable_height"),
    )


def status_evidence(df: DataFrame, sold: Column, evidence: str = "close_date") -> DataFrame:
    """How a claim of sale agrees with a closing date."""
    claim = F.coalesce(sold, F.lit(False))
    proof = F.col(evidence).isNotNull()
    return df.agg(
        tally(claim & proof).alias("agreed"), tally(claim & ~proof).alias("unproven"), tally(~claim & proof).alias("missed")
    )


def status_by_previous(df: DataFrame, status: str, previous: str, blank: str = "<blank>") -> DataFrame:
    """``(status, previous, rows)``: a long cross table, blanks named."""
    return df.groupBy(
        F.coalesce(F.col(status).cast("string"), F.lit(blank)).alias("status"),
        F.coalesce(F.col(previous).cast("string"), F.lit(blank)).alias("previous"),
    ).agg(F.count("*").alias("rows"))


def sale_claims(df: DataFrame, status: str, previous: str, sold: str, evidence: str = "close_date") -> DataFrame:
    """How well the status and the previous status agree with a closing date, a row each.

    ``other_only`` counts the rows where the claim is made by this column alone.
    """
    proof = F.col(evidence).isNotNull()
    said = {c: F.coalesce(F.col(c) == sold, F.lit(False)) for c in (status, previous)}
    rows = []
    for column, other in ((status, previous), (previous, status)):
        claim = said[column]
        rows.append(
            F.struct(
                F.lit(column).alias("column"), F.count(F.col(column)).alias("filled"), tally(claim).alias("claims"),
                tally(claim & proof).alias("agreed"), tally(claim & ~proof).alias("unproven"), tally(~claim & proof).alias("missed"),
                tally(claim & ~said[other]).alias("alone"),
            )
        )
    return df.agg(F.array(*rows).alias("found")).select(F.inline("found"))


def _ends(k: int):
    """Keep the k lowest and k highest rows of every group seen so far, by value then ident."""

    def best(table: pa.Table) -> pa.Table:
        ordered = table.sort_by([("__g", "ascending"), ("__side", "ascending"), ("__by", "ascending"), ("ident", "ascending")])
        group = pd.MultiIndex.from_arrays([ordered["__g"].to_pandas(), ordered["__side"].to_pandas()])
        rank = pd.Series(np.ones(len(ordered), int)).groupby([group.get_level_values(0), group.get_level_values(1)]).cumsum().to_numpy()
        kept = ordered.filter(pa.array(rank <= k))
        # The batches' own field, so that kept rows and the next batch have one schema.
        at = kept.schema.get_field_index("rank")
        return kept.set_column(at, kept.schema.field(at), pa.array(rank[rank <= k], pa.int32()))

    def run(batches):
        held = None
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                held = best(table if held is None else pa.concat_tables([held, table]))
        if held is not None:
            yield from held.to_batches()

    return run


def extreme_rows(df: DataFrame, keys: list[str], value: str, ident: str, k: int = 10, columns: list[str] = []) -> DataFrame:
    """The k rows of the lowest and of the highest value of every group.

    Returns the keys, ``side`` (low, high), ``rank``, ``ident``, ``value`` and ``columns``.  Equal
    values are ranked by ``ident``.  Each task keeps 2 k rows a group, twice, so a group is never
    gathered or sorted; null and NaN values take no part, a null key is a group.
    """
    sides = F.explode(F.array(F.lit("low"), F.lit("high")))
    rows = df.select(*keys, finite(value).alias("value"), F.col(ident).alias("ident"), *columns).where(F.col("value").isNotNull())
    group = F.to_json(F.struct(*[F.col(c) for c in keys]), {"ignoreNullFields": "false"}) if keys else F.lit("")
    rows = rows.withColumns({"__g": group, "__side": sides, "rank": F.lit(0)})
    rows = rows.withColumn("__by", F.when(F.col("__side") == "low", F.col("value")).otherwise(-F.col("value")))
    kept = rows.mapInArrow(_ends(k), rows.schema).repartition("__g", "__side").mapInArrow(_ends(k), rows.schema)
    return kept.select(*keys, F.col("__side").alias("side"), "rank", "ident", "value", *columns)


def column_wedge(left: DataFrame, right: DataFrame, ident: str, value: str) -> DataFrame:
    """Two versions of one column matched by id: correlation, deviations, attenuation."""
    both = left.select(ident, finite(value).alias("x")).join(
        right.select(ident, finite(value).alias("y")), ident
    ).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    gap = F.col("y") - F.col("x")
    sums = both.agg(
        F.count("*").alias("rows"), F.corr("x", "y").alias("corr"), F.stddev_samp("x").alias("sd_x"),
        F.stddev_samp("y").alias("sd_y"), F.stddev_samp(gap).alias("sd_gap"), F.max(F.abs(gap)).alias("max_gap"),
        tally(F.abs(gap) > 1e-12).alias("rows_differing"),
        F.var_samp("x").alias("_v"), F.var_samp(gap).alias("_w"),
    )
    attenuation = F.try_divide(F.col("_v"), F.col("_v") + F.col("_w"))
    return sums.withColumn("attenuation", attenuation).drop("_v", "_w")


def outside_support(cube: DataFrame, support: dict[str, float], keys: list[str] = []) -> DataFrame:
    """Grid points of a cube outside the fitted premium range."""
    premium = F.col("rel_price_premium")
    return cube.groupBy(*keys).agg(
        F.count("*").alias("points"),
        tally((premium < support["low"]) | (premium > support["high"])).alias("outside"),
        tally((premium < support["p1"]) | (premium > support["p99"])).alias("outside_or_tail"),
    )


def decompose_change(
    old: DataFrame, new: DataFrame, old_variable: str, new_variable: str, covariates: list[str],
    categorical: list[str] = ["submarket", "season"], least: int = 200,
) -> DataFrame:
    """``(part, value, error)``: the price coefficient of both tables under both variables, fitted in
    one run, and the parts of the change from the first cell to the last."""
    from tidemark.operators.keyed import Cell, fit_cells

    cells = [
        Cell(f"{when} data, {which} variable", frame, variable)
        for when, frame in (("old", old), ("new", new)) for which, variable in (("old", old_variable), ("new", new_variable))
    ]
    found = fit_cells(cells, covariates, categorical, least)
    values, rows = [], []
    for cell in cells:
        fit = found[cell.label]
        own = None if isinstance(fit, str) else fit.coefficient("rel_price_premium")
        values.append(own and own["value"])
        rows.append((cell.label, own and own["value"], fit if isinstance(fit, str) else None))
    if None not in values:
        rows += [(name, value, None) for name, value in decomposition(*values).items()]
    return old.sparkSession.createDataFrame(rows, "part string, value double, error string")


def decomposition(old_old: float, old_new: float, new_old: float, new_new: float) -> dict[str, float]:
    """Two paths and the average attribution of a change in two steps.

    Arguments are (data, variable): ``old_new`` is old data with the new variable.
    """
    respecify = ((old_new - old_old) + (new_new - new_old)) / 2
    sample = ((new_old - old_old) + (new_new - old_new)) / 2
    return {
        "total": new_new - old_old,
        "respecify_first": old_new - old_old, "sample_second": new_new - old_new,
        "sample_first": new_old - old_old, "respecify_second": new_new - new_old,
        "interaction": (new_new - new_old) - (old_new - old_old),
        "respecify_average": respecify, "sample_average": sample,
    }
