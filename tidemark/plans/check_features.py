"""Checked queries: features, profiles, sampling, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators import audit, features, profile, sampling
from tidemark.operators.clean import REASON
from tidemark.operators.quantiles import grouped_quantiles, right_closed_bucket
from tidemark.plans import stand_ins as S
from tidemark.session import spread
from tidemark.sources.headers import REQUIRED

QUERIES = {}
SQL = {}

ROW = ("orderkey", "linenumber", "partkey")
WITH_NORM = f"WITH {S.NORMALIZED_SQL}\n"
WITH_CLEAN = f"WITH {S.CLEAN_SQL}\n"


def lines(spark, folder):
    """Order lines with their part: price per piece, brand as place, ship month."""
    found = S.tables(spark, folder, "lineitem", "part")
    part = found["part"].select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size", "p_name", "p_type")
    joined = spread(found["lineitem"], "l_orderkey").join(part, "l_partkey")
    return joined.withColumns(
        {
            "ppsf": F.col("l_extendedprice") / F.col("l_quantity"),
            "month": dates.month_key("l_shipdate"),
            "quarter": dates.quarter_key("l_shipdate"),
        }
    )


LINES = """lines AS (
  SELECT l.*, p_brand, p_size, p_name, p_type, l_extendedprice / l_quantity AS ppsf, strftime(l_shipdate, '%Y-%m') AS month,
    concat(year(l_shipdate), 'Q', quarter(l_shipdate)) AS quarter
  FROM lineitem l JOIN part ON l_partkey = p_partkey)"""

PREMIUM = LINES + """,
m AS (SELECT p_brand, month, median(ppsf) AS med, count(*) AS n FROM lines GROUP BY ALL),
q AS (SELECT p_brand, quarter, median(ppsf) AS med, count(*) AS n FROM lines GROUP BY ALL),
premium AS (
  SELECT lines.*, CASE WHEN m.n >= 30 THEN m.med WHEN q.n >= 30 THEN q.med END AS cell_median_ppsf,
    lines.ppsf / CASE WHEN m.n >= 30 THEN m.med WHEN q.n >= 30 THEN q.med END - 1 AS rel_price_premium,
    CASE WHEN m.n >= 30 THEN 'submarket_month' WHEN q.n >= 30 THEN 'submarket_quarter' ELSE 'insufficient' END AS median_basis
  FROM lines LEFT JOIN m USING (p_brand, month) LEFT JOIN q USING (p_brand, quarter))"""


def premium_lines(spark, folder):
    return features.cell_median_premium(lines(spark, folder), "ppsf", "p_brand", "month", "quarter", 30)


def ft_cell_median_premium(spark, folder):
    return premium_lines(spark, folder).select(
        "l_orderkey", "l_linenumber", "l_partkey", "median_basis",
        F.round("cell_median_ppsf", 6).alias("cell_median_ppsf"),
        F.round("rel_price_premium", 8).alias("rel_price_premium"),
    )


QUERIES["ft_cell_median_premium"] = ft_cell_median_premium
SQL["ft_cell_median_premium"] = f"""WITH {PREMIUM} SELECT l_orderkey, l_linenumber, l_partkey, median_basis,
  round(cell_median_ppsf, 6) AS cell_median_ppsf, round(rel_price_premium, 8) AS rel_price_premium FROM premium"""


def ft_entry_competition(spark, folder):
    rows = features.entry_competition(lines(spark, folder), "p_brand", "month")
    return rows.groupBy("p_brand", "month", "inventory_competition").agg(F.count("*").alias("rows"))


QUERIES["ft_entry_competition"] = ft_entry_competition
SQL["ft_entry_competition"] = f"""WITH {LINES} SELECT p_brand, month, CAST(count(*) - 1 AS DOUBLE) AS inventory_competition, count(*) AS rows
FROM lines GROUP BY p_brand, month"""


def ft_size_bucket(spark, folder):
    rows = features.size_bucket(lines(spark, folder), "p_brand", "l_quantity")
    return rows.groupBy("p_brand", "size_bucket").agg(F.count("*").alias("rows"))


QUERIES["ft_size_bucket"] = ft_size_bucket
SQL["ft_size_bucket"] = f"""WITH {LINES},
e AS (SELECT p_brand, quantile_cont(l_quantity, [0, 0.25, 0.5, 0.75, 1]) AS q FROM lines GROUP BY p_brand)
SELECT p_brand, CASE WHEN q[1] < q[2] AND q[2] < q[3] AND q[3] < q[4] AND q[4] < q[5] THEN
    CASE WHEN l_quantity <= q[2] THEN 'q1' WHEN l_quantity <= q[3] THEN 'q2' WHEN l_quantity <= q[4] THEN 'q3' ELSE 'q4' END END AS size_bucket,
  count(*) AS rows FROM lines JOIN e USING (p_brand) GROUP BY 1, 2"""


def ft_decile_bucket(spark, folder):
    rows = lines(spark, folder)
    wanted = {f"q{i}": i / 10 for i in range(11)}
    edges = sorted(set(grouped_quantiles(rows, [], "l_extendedprice", wanted).first()))
    bucket = right_closed_bucket("l_extendedprice", edges)
    return rows.groupBy(bucket.alias("decile")).agg(
        F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 2).alias("mean_price")
    )


QUERIES["ft_decile_bucket"] = ft_decile_bucket
SQL["ft_decile_bucket"] = f"""WITH {LINES},
e AS (SELECT quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM lines)
SELECT CAST(1 + len(list_filter(q, lambda x: x < l_extendedprice)) AS INTEGER) AS decile, count(*) AS n,
  round(avg(l_extendedprice), 2) AS mean_price FROM lines, e GROUP BY 1"""


def ft_tokens(spark, folder):
    rows = lines(spark, folder).withColumn("tokens", F.translate("p_name", " ", ","))
    return features.token_counts(rows, "tokens")


QUERIES["ft_tokens"] = ft_tokens
SQL["ft_tokens"] = f"""WITH {LINES} SELECT token, count(*) AS rows FROM (
  SELECT unnest(list_distinct(string_split(p_name, ' '))) AS token FROM lines) GROUP BY token"""


def ft_token_indicators(spark, folder):
    name = F.when(F.col("l_linenumber") != 3, F.translate("p_name", " ", ","))
    rows = lines(spark, folder).withColumn("tokens", name)
    vocabulary = features.learn_tokens(rows, "tokens", "view")
    marked = rows.withColumns(features.indicators("tokens", vocabulary))
    cells = F.inline(F.array(*[F.struct(F.lit(n).alias("indicator"), F.col(n).alias("v")) for n in vocabulary.names]))
    return marked.select(cells).groupBy("indicator").agg(F.sum("v").alias("rows"))


QUERIES["ft_token_indicators"] = ft_token_indicators
SQL["ft_token_indicators"] = f"""WITH {LINES}, t AS (
  SELECT unnest(list_distinct(string_split(p_name, ' '))) AS token FROM lines WHERE l_linenumber <> 3)
SELECT concat('view_', token) AS indicator, CAST(count(*) AS DOUBLE) AS rows FROM t GROUP BY token
  HAVING count(*) >= greatest(1, floor(0.01 * (SELECT count(*) FROM lines)))
UNION ALL SELECT 'view_missing', CAST(count(*) AS DOUBLE) FROM lines WHERE l_linenumber = 3"""


def feature_frame(spark, folder, columns, names):
    """Some columns of the cleaned listings, and the named features of their rows."""
    made = features.row_features()
    return S.cleaned(spark, folder, columns=columns).frame.withColumns({name: made[name] for name in names})


FEAT = f"""{S.CLEAN_SQL}, feat AS (
  SELECT *, CASE month(list_date) WHEN 12 THEN 'winter' WHEN 1 THEN 'winter' WHEN 2 THEN 'winter' WHEN 3 THEN 'spring' WHEN 4 THEN 'spring'
      WHEN 5 THEN 'spring' WHEN 6 THEN 'summer' WHEN 7 THEN 'summer' WHEN 8 THEN 'summer' WHEN 9 THEN 'fall' WHEN 10 THEN 'fall' WHEN 11 THEN 'fall' END AS season,
    CASE WHEN living_area_sqft > 0 THEN ln(living_area_sqft) END AS log_living_area,
    CASE WHEN floor >= 0 THEN ln(floor + 1) END AS log_floor,
    CASE WHEN floor < 1 THEN NULL WHEN floor <= 5 THEN 'low' WHEN floor <= 12 THEN 'mid' WHEN floor <= 25 THEN 'high' WHEN floor > 25 THEN 'tower' END AS floor_bucket,
    CASE WHEN beds IS NOT NULL THEN (baths_full + coalesce(baths_half, 0) * 0.5) / greatest(beds, 1) END AS bed_bath_ratio,
    CASE WHEN hoa_monthly >= 0 AND living_area_sqft > 0 THEN hoa_monthly / living_area_sqft END AS hoa_per_sqft,
    CASE WHEN hoa_monthly < 0 THEN 'negative' WHEN hoa_monthly >= 0 AND living_area_sqft > 0 THEN 'reported' ELSE 'missing' END AS hoa_per_sqft_source,
    coalesce(new_construction, year(list_date) - year_built <= 2) AS is_new_construction,
    CASE WHEN new_construction IS NOT NULL THEN 'reported' WHEN year(list_date) - year_built IS NOT NULL THEN 'derived' ELSE 'missing' END AS is_new_construction_source,
    close_price / nullif(original_list_price, 0) AS sold_to_list_ratio, last_list_price / nullif(original_list_price, 0) - 1 AS price_cut_pct,
    coalesce(try_cast(lease_text AS DOUBLE), 0) AS min_lease_days_value, CAST(try_cast(lease_text AS DOUBLE) IS NULL AS DOUBLE) AS min_lease_days_missing,
    CASE WHEN year(list_date) - year_built BETWEEN -5 AND 150 THEN CAST(year(list_date) - year_built AS DOUBLE) END AS building_age_years,
    coalesce(trim(furnished_text), '__missing__') AS furnished_info_level
  FROM clean)"""
WITH_FEAT = f"WITH {FEAT}\n"
_ROUNDED = ("log_living_area", "log_floor", "bed_bath_ratio", "hoa_per_sqft", "sold_to_list_ratio", "price_cut_pct")
_PLAIN = (
    "list_month", "list_quarter", "season", "floor_bucket", "hoa_per_sqft_source", "is_new_construction",
    "is_new_construction_source", "min_lease_days_value", "min_lease_days_missing", "building_age_years",
    "furnished_info_level",
)


# The columns that features are made of, by feature.
_MADE_OF = {
    "list_month": ("list_date",), "list_quarter": ("list_date",), "season": ("list_date",),
    "log_living_area": ("living_area_sqft",), "log_floor": ("floor",), "floor_bucket": ("floor",),
    "bed_bath_ratio": ("beds", "baths_full", "baths_half"),
    "hoa_per_sqft": ("hoa_monthly", "living_area_sqft"), "hoa_per_sqft_source": ("hoa_monthly", "living_area_sqft"),
    "is_new_construction": ("new_construction", "year_built", "list_date"),
    "is_new_construction_source": ("new_construction", "year_built", "list_date"),
    "sold_to_list_ratio": ("close_price", "original_list_price"), "price_cut_pct": ("last_list_price", "original_list_price"),
    "min_lease_days_value": ("min_lease_days",), "min_lease_days_missing": ("min_lease_days",),
    "building_age_years": ("year_built", "list_date"), "furnished_info_level": ("furnished_info",),
}


def _inputs(names):
    return tuple(sorted({column for name in names for column in _MADE_OF[name]}))


def ft_row_features(spark, folder):
    names = (*_PLAIN, *_ROUNDED)
    return feature_frame(spark, folder, (*ROW, *_inputs(names)), names).select(*ROW, *_PLAIN, *[F.round(c, 8).alias(c) for c in _ROUNDED])


QUERIES["ft_row_features"] = ft_row_features
SQL["ft_row_features"] = WITH_FEAT + (
    f"SELECT {', '.join(ROW)}, {', '.join(_PLAIN)}, {', '.join(f'round({c}, 8) AS {c}' for c in _ROUNDED)} FROM feat"
)


def agg_value_counts(spark, folder):
    names = ("is_new_construction_source",)
    rows = feature_frame(spark, folder, ("status", "floor_source", *_inputs(names)), names)
    parts = None
    for column in ("status", "floor_source", "is_new_construction_source"):
        part = profile.value_counts(rows, column).withColumn("field", F.lit(column))
        parts = part if parts is None else parts.unionByName(part)
    return parts


QUERIES["agg_value_counts"] = agg_value_counts
SQL["agg_value_counts"] = WITH_FEAT + " UNION ALL ".join(
    f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value, count(*) AS rows FROM feat GROUP BY 2"
    for c in ("status", "floor_source", "is_new_construction_source")
)

_PROFILED = ["mls_number", "status", "list_date", "close_price", "floor", "list_ppsf", "duration_days", "submarket"]


def agg_null_profile(spark, folder):
    return profile.null_profile(S.cleaned(spark, folder, columns=tuple(_PROFILED)).frame, _PROFILED).drop("type")


QUERIES["agg_null_profile"] = agg_null_profile
SQL["agg_null_profile"] = WITH_CLEAN + " UNION ALL ".join(
    f"SELECT '{c}' AS field, count(*) - count({c}) AS nulls, round((count(*) - count({c})) / count(*), 4) AS rate FROM clean"
    for c in _PROFILED
)


def agg_identification(spark, folder):
    columns = ("pending_treated_as_sold", "event_sold", *REQUIRED, "duration_days", "submarket")
    return profile.identification_counts(S.cleaned(spark, folder, columns=columns).frame)


QUERIES["agg_identification"] = agg_identification
SQL["agg_identification"] = WITH_CLEAN + """SELECT count(*) FILTER (status = 'SOLD') AS sold, count(*) - count(*) FILTER (status = 'SOLD') AS non_sold,
  count(*) FILTER (status IN ('EXPIRED', 'WITHDRAWN', 'CANCELED')) AS censored, count(*) FILTER (status = 'ACTIVE') AS active,
  count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (pending_treated_as_sold) AS pending_as_sold,
  CAST(sum(event_sold) AS BIGINT) AS events, count(*) FILTER (mls_number IS NOT NULL AND status IS NOT NULL AND original_list_price IS NOT NULL
    AND list_date IS NOT NULL AND living_area_sqft IS NOT NULL AND zip_code IS NOT NULL AND duration_days IS NOT NULL AND submarket IS NOT NULL) AS usable_rows
FROM clean"""


def agg_coverage(spark, folder):
    return profile.coverage(S.cleaned(spark, folder, columns=("status", "submarket")).frame, ["status"])


QUERIES["agg_coverage"] = agg_coverage
SQL["agg_coverage"] = WITH_CLEAN + """SELECT status, count(*) AS rows, count(submarket) AS rows_with, count(*) - count(submarket) AS rows_without,
  round((count(*) - count(submarket)) / count(*), 4) AS unmapped_rate, (count(*) - count(submarket)) / count(*) > 0.05 AS coverage_gap FROM clean GROUP BY status"""


def agg_top_unmapped(spark, folder):
    return profile.top_unmapped(S.cleaned(spark, folder, columns=("zip_code", "submarket")).frame)


QUERIES["agg_top_unmapped"] = agg_top_unmapped
SQL["agg_top_unmapped"] = WITH_CLEAN + (
    "SELECT zip_code, count(*) AS rows FROM clean WHERE submarket IS NULL AND zip_code IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
)


def agg_dense_cells(spark, folder):
    return profile.dense_cells(lines(spark, folder), ["p_brand", "month"], 30)


QUERIES["agg_dense_cells"] = agg_dense_cells
SQL["agg_dense_cells"] = f"""WITH {LINES} SELECT count(*) FILTER (n >= 30) AS dense_cells, count(*) AS cells
FROM (SELECT count(*) AS n FROM lines GROUP BY p_brand, month)"""


def agg_building_support(spark, folder):
    return profile.building_support(S.cleaned(spark, folder, columns=("building_name",)).frame, least=200)


QUERIES["agg_building_support"] = agg_building_support
SQL["agg_building_support"] = WITH_CLEAN + """, b AS (SELECT building_text AS b, count(*) AS n FROM clean GROUP BY 1)
SELECT count(b) AS buildings_named, CAST(coalesce(sum(n) FILTER (b IS NULL), 0) AS BIGINT) AS rows_missing_name,
  count(*) FILTER (b IS NOT NULL AND n >= 200) AS buildings_dense, CAST(coalesce(sum(n) FILTER (b IS NOT NULL AND n >= 200), 0) AS BIGINT) AS rows_in_dense,
  median(n) FILTER (b IS NOT NULL) AS median_rows FROM b"""


def agg_premium_stats(spark, folder):
    # One of the two groups has no key.
    rows = premium_lines(spark, folder).withColumns(
        {"event": (F.col("l_returnflag") == "R").cast("int"), "l_linestatus": F.when(F.col("l_linestatus") != "O", F.col("l_linestatus"))}
    )
    stats = profile.premium_stats(rows, "rel_price_premium", "event", ["l_linestatus"])
    return stats.select("l_linestatus", "n", *[F.round(c, 8).alias(c) for c in ("mean", "sd", "corr_event", "p5", "median", "p95", "iqr")])


QUERIES["agg_premium_stats"] = agg_premium_stats
SQL["agg_premium_stats"] = f"""WITH {PREMIUM} SELECT nullif(l_linestatus, 'O') AS l_linestatus, count(*) AS n, round(avg(x), 8) AS mean, round(stddev_samp(x), 8) AS sd,
  round(corr(x, CAST(l_returnflag = 'R' AS INT)), 8) AS corr_event, round(quantile_cont(x, 0.05), 8) AS p5, round(median(x), 8) AS median,
  round(quantile_cont(x, 0.95), 8) AS p95, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 8) AS iqr
FROM (SELECT *, rel_price_premium AS x FROM premium WHERE rel_price_premium IS NOT NULL) GROUP BY 1"""

_GAPS = ("log_floor", "living_area_sqft", "beds", "hoa_per_sqft", "is_new_construction", "submarket", "season")


def agg_covariate_gaps(spark, folder):
    names = [name for name in _GAPS if name in _MADE_OF]
    columns = [name for name in _GAPS if name not in _MADE_OF]
    return profile.covariate_gaps(feature_frame(spark, folder, (*columns, *_inputs(names)), names), _GAPS)


QUERIES["agg_covariate_gaps"] = agg_covariate_gaps
SQL["agg_covariate_gaps"] = WITH_FEAT + (
    f"SELECT count(*) AS rows, count(*) FILTER ({' AND '.join(f'{c} IS NOT NULL' for c in _GAPS)}) AS complete_rows, "
    + ", ".join(f"round(avg(CAST({c} IS NULL AS INT)), 4) AS null_{c}" for c in _GAPS)
    + " FROM feat"
)


def agg_feature_flags(spark, folder):
    names = ("log_floor", "hoa_per_sqft_source")
    rows = feature_frame(spark, folder, ("is_penthouse", "list_ppsf_source", *_inputs(names)), names)
    rows = rows.withColumn("median_basis", F.coalesce("list_ppsf_source", F.lit("missing")))
    return profile.feature_flags(rows)


QUERIES["agg_feature_flags"] = agg_feature_flags
SQL["agg_feature_flags"] = WITH_FEAT + """SELECT count(*) FILTER (is_ph AND log_floor IS NULL) AS penthouses_without_floor,
  count(*) FILTER (hoa_per_sqft_source = 'negative') AS negative_fees, count(*) FILTER (list_ppsf_source = 'missing') AS rows_without_median,
  count(*) AS rows FROM feat"""


def agg_sampling_window(spark, folder):
    return sampling.sampling_window(S.listings(spark, folder, "status", "list_date", *sampling.TERMINAL), ["status"])


QUERIES["agg_sampling_window"] = agg_sampling_window
SQL["agg_sampling_window"] = WITH_NORM + """, t AS (
  SELECT *, greatest(close_date, pending_date, off_market_date) AS te, min(CAST(greatest(close_date, pending_date, off_market_date) AS DATE)) OVER (PARTITION BY status) AS t0 FROM norm)
SELECT status, min(CAST(list_date AS DATE)) AS list_min, max(CAST(list_date AS DATE)) AS list_max, min(CAST(te AS DATE)) AS terminal_min, max(CAST(te AS DATE)) AS terminal_max,
  count(*) FILTER (status = 'ACTIVE') AS active, round(avg(CAST(list_date IS NOT NULL AND te IS NOT NULL AS INT)), 4) AS complete_share,
  count(*) FILTER (list_date < t0) AS started_before,
  CAST(max(CAST(list_date AS DATE)) - min(CAST(list_date AS DATE)) AS INT) AS list_span_days,
  CAST(max(CAST(te AS DATE)) - min(CAST(te AS DATE)) AS INT) AS terminal_span_days,
  coalesce(max(CAST(list_date AS DATE)) - min(CAST(list_date AS DATE)) > 0 AND max(CAST(te AS DATE)) - min(CAST(te AS DATE))
    < 0.75 * (max(CAST(list_date AS DATE)) - min(CAST(list_date AS DATE))) AND count(*) FILTER (status = 'ACTIVE') = 0, FALSE) AS selected_on_terminal
FROM t GROUP BY status"""


def _event_runs(spark, folder):
    events = S.tables(spark, folder, "events")["events"].withColumns(
        {"source": F.col("user_id") % 3, "hour": F.date_trunc("hour", "ts")}
    )
    return sampling.runs(events, ["source"], "hour", ["ts", "event_id"], "event_type")


def win_status_runs(spark, folder):
    return _event_runs(spark, folder).groupBy("source", "value", "rows").agg(F.count("*").alias("runs"))


_RUNS = """e AS (SELECT user_id % 3 AS source, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id)
    - row_number() OVER (PARTITION BY user_id % 3, event_type ORDER BY ts, event_id) AS island FROM events),
r AS (SELECT source, event_type AS value, island, count(*) AS rows, max(ts) AS last_ts, max(event_id) AS last_id FROM e GROUP BY ALL)"""
QUERIES["win_status_runs"] = win_status_runs
SQL["win_status_runs"] = f"WITH {_RUNS} SELECT source, value, rows, count(*) AS runs FROM r GROUP BY ALL"


def agg_sorted_by_status(spark, folder):
    return sampling.sorted_by_value(_event_runs(spark, folder), ["source"])


QUERIES["agg_sorted_by_status"] = agg_sorted_by_status
SQL["agg_sorted_by_status"] = f"""WITH {_RUNS} SELECT source, count(*) AS runs, count(DISTINCT value) AS distinct_values,
  arg_max(value, last_ts) AS last_value, arg_max(rows, last_ts) AS last_rows, count(*) = count(DISTINCT value) AND count(*) > 1 AS sorted_by_value FROM r GROUP BY source"""


def aud_cell_size_ladder(spark, folder):
    return audit.cell_size_ladder(lines(spark, folder), ["p_brand", "month"])


QUERIES["aud_cell_size_ladder"] = aud_cell_size_ladder
SQL["aud_cell_size_ladder"] = f"""WITH {LINES}, c AS (SELECT count(*) AS n FROM lines GROUP BY p_brand, month)
SELECT CAST(k AS INT) AS least, count(*) FILTER (n >= k) AS cells, CAST(coalesce(sum(n) FILTER (n >= k), 0) AS BIGINT) AS rows
FROM c, (SELECT unnest([1, 2, 4, 8, 16, 32]) AS k) GROUP BY k"""


def aud_median_cell_size(spark, folder):
    return audit.median_cell_size(lines(spark, folder), ["p_brand", "month"])


QUERIES["aud_median_cell_size"] = aud_median_cell_size
SQL["aud_median_cell_size"] = f"WITH {LINES} SELECT median(n) AS median_size FROM (SELECT count(*) AS n FROM lines GROUP BY p_brand, month)"


def aud_median_noise(spark, folder):
    found = audit.median_noise(premium_lines(spark, folder), ["p_brand", "month"], "ppsf", "rel_price_premium")
    return found.select("cells", *[F.round(c, 10).alias(c) for c in ("noise_variance", "premium_variance", "attenuation")])


QUERIES["aud_median_noise"] = aud_median_noise
SQL["aud_median_noise"] = f"""WITH {PREMIUM}, c AS (SELECT quantile_cont(ppsf, 0.25) AS a, median(ppsf) AS m, quantile_cont(ppsf, 0.75) AS b, count(*) AS n FROM lines GROUP BY p_brand, month),
v AS (SELECT avg(pi() / 2 * ((b - a) / 1.349) ^ 2 / n / (m * m)) AS nv, count(*) AS cells FROM c WHERE n >= 4 AND b > a),
w AS (SELECT var_samp(rel_price_premium) AS pv FROM premium)
SELECT cells, round(nv, 10) AS noise_variance, round(pv, 10) AS premium_variance, round(1 - nv / pv, 10) AS attenuation FROM v, w"""


def aud_leave_one_out(spark, folder):
    rows = audit.leave_one_out_median(premium_lines(spark, folder), ["p_brand", "month"], "ppsf")
    rows = rows.withColumn("loo_premium", F.col("ppsf") / F.col("loo_median") - 1)
    found = audit.inclusive_vs_left_out(rows, "rel_price_premium", "loo_premium")
    return found.select("rows", *[F.round(c, 9).alias(c) for c in found.columns if c != "rows"])


QUERIES["aud_leave_one_out"] = aud_leave_one_out
SQL["aud_leave_one_out"] = f"""WITH {PREMIUM},
l AS (SELECT p_brand, month, list_sort(list(ppsf)) AS v FROM lines GROUP BY ALL HAVING count(*) >= 8),
x AS (SELECT rel_price_premium AS a, ppsf / list_median(list_concat(v[:list_position(v, ppsf) - 1], v[list_position(v, ppsf) + 1:])) - 1 AS b
  FROM premium JOIN l USING (p_brand, month) WHERE rel_price_premium IS NOT NULL)
SELECT count(*) AS rows, round(avg(a - b), 9) AS mean_gap, round(stddev_pop(a - b), 9) AS sd_gap, round(corr(a, b), 9) AS corr,
  round(stddev_pop(a), 9) AS sd_inclusive, round(stddev_pop(b), 9) AS sd_left_out FROM x"""


def aud_crosstab(spark, folder):
    rows = S.normalized(spark, folder, whole=False).frame.withColumn("lost", F.col("list_date").isNull())
    cells = audit.crosstab(rows, "status", "lost")
    return cells.withColumn("column_share", F.round("column_share", 8))


QUERIES["aud_crosstab"] = aud_crosstab
SQL["aud_crosstab"] = WITH_NORM + """SELECT coalesce(status, '<blank>') AS "row", CAST(list_date IS NULL AS VARCHAR) AS "column", count(*) AS rows,
  round(count(*) / sum(count(*)) OVER (PARTITION BY list_date IS NULL), 8) AS column_share FROM norm GROUP BY status, list_date IS NULL"""


def aud_chi_square(spark, folder):
    rows = lines(spark, folder)
    return audit.chi_square(audit.crosstab(rows, "l_returnflag", "p_type")).select(
        F.round("chi2", 6).alias("chi2"), "freedom"
    )


QUERIES["aud_chi_square"] = aud_chi_square
SQL["aud_chi_square"] = f"""WITH {LINES}, c AS (SELECT l_returnflag AS a, p_type AS b, count(*) AS o FROM lines GROUP BY ALL),
t AS (SELECT *, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM c)
SELECT round(sum((o - e) ^ 2 / e), 6) AS chi2, CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS INT) AS freedom FROM t"""


def aud_welch(spark, folder):
    found = audit.welch(lines(spark, folder), F.col("l_returnflag") == "R", "l_extendedprice")
    return found.select(*[F.round(c, 6).alias(c) for c in ("mean_in", "mean_out", "t", "freedom")])


QUERIES["aud_welch"] = aud_welch
SQL["aud_welch"] = """WITH s AS (SELECT avg(l_extendedprice) FILTER (l_returnflag = 'R') AS m1, var_samp(l_extendedprice) FILTER (l_returnflag = 'R') / count(*) FILTER (l_returnflag = 'R') AS e1,
  count(*) FILTER (l_returnflag = 'R') AS n1, avg(l_extendedprice) FILTER (l_returnflag <> 'R') AS m2, var_samp(l_extendedprice) FILTER (l_returnflag <> 'R') / count(*) FILTER (l_returnflag <> 'R') AS e2,
  count(*) FILTER (l_returnflag <> 'R') AS n2 FROM lineitem)
SELECT round(m1, 6) AS mean_in, round(m2, 6) AS mean_out, round((m1 - m2) / sqrt(e1 + e2), 6) AS t,
  round((e1 + e2) ^ 2 / (e1 ^ 2 / (n1 - 1) + e2 ^ 2 / (n2 - 1)), 6) AS freedom FROM s"""


def aud_ks(spark, folder):
    found = audit.kolmogorov_smirnov(lines(spark, folder), F.col("l_returnflag") == "R", "l_extendedprice")
    return found.select("n_in", "n_out", F.round("d", 10).alias("d"))


QUERIES["aud_ks"] = aud_ks
SQL["aud_ks"] = """WITH c AS (SELECT l_extendedprice AS v, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_returnflag <> 'R') AS b FROM lineitem GROUP BY 1),
r AS (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () - sum(b) OVER (ORDER BY v) / sum(b) OVER () AS g FROM c)
SELECT (SELECT CAST(sum(a) AS BIGINT) FROM c) AS n_in, (SELECT CAST(sum(b) AS BIGINT) FROM c) AS n_out, round(max(abs(g)), 10) AS d FROM r"""


def aud_spell_sanity(spark, folder):
    return audit.spell_sanity(S.normalized(spark, folder, whole=False).frame)


QUERIES["aud_spell_sanity"] = aud_spell_sanity
SQL["aud_spell_sanity"] = WITH_NORM + " UNION ALL ".join(
    f"SELECT '{name}' AS span, count({d}) AS rows, count(*) FILTER ({d} < 0) AS negative, count(*) FILTER ({d} = 0) AS zero, "
    f"CAST(max({d}) AS DOUBLE) AS longest FROM norm"
    for name, d in (("pending_date", "d_pending"), ("close_date", "d_close"), ("off_market_date", "d_off"))
)


def aud_duration_fallbacks(spark, folder):
    return audit.duration_fallbacks(S.normalized(spark, folder, whole=False).frame)


QUERIES["aud_duration_fallbacks"] = aud_duration_fallbacks
SQL["aud_duration_fallbacks"] = WITH_NORM + """SELECT count(*) FILTER (duration_source = 'days_on_market') AS fallback,
  count(*) FILTER (duration_source = 'days_on_market' AND list_date IS NOT NULL) AS fallback_with_list_date,
  count(*) FILTER (duration_days IS NULL) AS no_duration FROM norm"""


def aud_edge_censoring(spark, folder):
    found = sampling.edge_censoring(S.cleaned(spark, folder, columns=("list_date", "duration_days", "event_sold")).frame, 180)
    return found.withColumn("event_rate", F.round("event_rate", 8))


QUERIES["aud_edge_censoring"] = aud_edge_censoring
SQL["aud_edge_censoring"] = WITH_CLEAN + """SELECT CAST(z AS DATE) - CAST(list_date AS DATE) < 180 AS late, count(*) AS rows,
  round(avg(event_sold), 8) AS event_rate, CAST(median(duration_days) AS DOUBLE) AS median_days
FROM (SELECT *, max(list_date) OVER () AS z FROM clean) WHERE list_date IS NOT NULL GROUP BY 1"""


def aud_relists(spark, folder):
    return audit.relists(S.cleaned(spark, folder, columns=("unit_key",)).frame)


QUERIES["aud_relists"] = aud_relists
SQL["aud_relists"] = WITH_CLEAN + """SELECT count(*) AS distinct_keys, count(*) FILTER (n > 1) AS repeated_keys,
  CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS repeated_rows, CAST(coalesce(max(n) FILTER (n > 1), 0) AS BIGINT) AS largest
FROM (SELECT unit_key, count(*) AS n FROM clean WHERE unit_key <> '' GROUP BY 1)"""


def aud_terminal_by_status(spark, folder):
    return sampling.terminal_by_status(S.normalized(spark, folder, whole=False).frame)


QUERIES["aud_terminal_by_status"] = aud_terminal_by_status
SQL["aud_terminal_by_status"] = WITH_NORM + """SELECT status, count(*) AS rows, min(CAST(t AS DATE)) AS first_end, max(CAST(t AS DATE)) AS last_end
FROM (SELECT *, greatest(close_date, pending_date, off_market_date) AS t FROM norm) GROUP BY status"""


def aud_start_cohorts(spark, folder):
    found = sampling.start_cohorts(S.listings(spark, folder, "list_date", "event_sold", *sampling.TERMINAL))
    return found.withColumn("event_rate", F.round("event_rate", 8))


QUERIES["aud_start_cohorts"] = aud_start_cohorts
SQL["aud_start_cohorts"] = WITH_NORM + """SELECT concat(year(list_date), 'Q', quarter(list_date)) AS cohort, count(*) AS rows,
  round(avg(event_sold), 8) AS event_rate, CAST(median(CAST(t AS DATE) - CAST(list_date AS DATE)) AS DOUBLE) AS median_days
FROM (SELECT *, greatest(close_date, pending_date, off_market_date) AS t FROM norm) WHERE list_date IS NOT NULL AND t IS NOT NULL GROUP BY 1"""


def aud_observable_bounds(spark, folder):
    rows = S.listings(spark, folder, "list_date", *sampling.TERMINAL)
    window = sampling.with_terminal(rows).agg(
        F.min("terminal_date").cast("date").alias("a"), F.max("terminal_date").cast("date").alias("b")
    ).first()
    return sampling.observable_bounds(rows, window["a"], window["b"])


QUERIES["aud_observable_bounds"] = aud_observable_bounds
SQL["aud_observable_bounds"] = WITH_NORM + """, w AS (SELECT min(CAST(greatest(close_date, pending_date, off_market_date) AS DATE)) AS a,
  max(CAST(greatest(close_date, pending_date, off_market_date) AS DATE)) AS b FROM norm)
SELECT concat(year(list_date), 'Q', quarter(list_date)) AS cohort, CAST(min(greatest(a - CAST(list_date AS DATE), 0)) AS INT) AS least_days,
  CAST(max(greatest(a - CAST(list_date AS DATE), 0)) AS INT) AS least_days_max, CAST(max(b - CAST(list_date AS DATE)) AS INT) AS most_days
FROM norm, w WHERE list_date IS NOT NULL GROUP BY 1"""


def aud_tail_quantiles(spark, folder):
    found = audit.tail_quantiles(premium_lines(spark, folder), "rel_price_premium")
    return found.withColumn("value", F.round("value", 8))


QUERIES["aud_tail_quantiles"] = aud_tail_quantiles
SQL["aud_tail_quantiles"] = f"WITH {PREMIUM} " + " UNION ALL ".join(
    f"SELECT CAST({p} AS DOUBLE) AS probability, round(quantile_cont(rel_price_premium, {p}), 8) AS value FROM premium"
    for p in audit.PREMIUM_TAILS
)


def aud_list_date_identity(spark, folder):
    found = audit.list_date_identity(S.normalized(spark, folder, whole=False).frame, "status_change_date")
    return found.select("status", "rows", *[F.round(c, 8).alias(c) for c in ("exact", "within_1", "within_3")])


QUERIES["aud_list_date_identity"] = aud_list_date_identity
SQL["aud_list_date_identity"] = WITH_NORM + """SELECT status, count(*) AS rows, round(avg(CAST(e = 0 AS INT)), 8) AS exact,
  round(avg(CAST(abs(e) <= 1 AS INT)), 8) AS within_1, round(avg(CAST(abs(e) <= 3 AS INT)), 8) AS within_3
FROM (SELECT *, floor(epoch(status_change_date - to_days(days_on_market) - list_date) / 86400) AS e FROM norm
  WHERE list_date_source = 'reported' AND status_change_date IS NOT NULL AND days_on_market IS NOT NULL) GROUP BY status"""


def aud_anchor_scores(spark, folder):
    anchors = ["status_change_date", "off_market_date", "pending_date", "close_date"]
    found = audit.anchor_scores(S.normalized(spark, folder, whole=False).frame, anchors, "file_quarter", ["status"])
    return found.withColumn("coverage", F.round("coverage", 8))


QUERIES["aud_anchor_scores"] = aud_anchor_scores
SQL["aud_anchor_scores"] = WITH_NORM + ", need AS (SELECT * FROM norm WHERE list_date_source <> 'reported'), long AS (" + " UNION ALL ".join(
    f"SELECT status, file_quarter, '{a}' AS anchor, {a} - to_days(days_on_market) AS c FROM need"
    for a in ("status_change_date", "off_market_date", "pending_date", "close_date")
) + """) SELECT status, anchor, count(*) AS rows, count(c) AS available, count(*) FILTER (c IS NOT NULL AND concat(year(c), 'Q', quarter(c)) = file_quarter) AS in_quarter,
  round(avg(CAST(c IS NOT NULL AND concat(year(c), 'Q', quarter(c)) = file_quarter AS INT)), 8) AS coverage FROM long GROUP BY ALL"""


def aud_snapshot_per_file(spark, folder):
    return audit.snapshot_per_file(
        S.normalized(spark, folder, whole=False).frame, "file_quarter", ["status_change_date", "close_date", "list_date"]
    )


QUERIES["aud_snapshot_per_file"] = aud_snapshot_per_file
SQL["aud_snapshot_per_file"] = WITH_NORM + (
    "SELECT file_quarter, CAST(max(greatest(status_change_date, close_date, list_date)) AS DATE) AS snapshot FROM norm GROUP BY 1"
)


def aud_file_profile(spark, folder):
    return audit.file_profile(S.raw_export(spark, folder), "file_quarter", "ML#", ["Status", "Unit View", "Remarks"])


QUERIES["aud_file_profile"] = aud_file_profile
SQL["aud_file_profile"] = f"WITH raw AS ({S.RAW_SQL}) " + " UNION ALL ".join(
    f"SELECT file_quarter AS file, '{h}' AS field, count(*) AS rows, count({c}) AS filled, count(DISTINCT {c}) AS \"distinct\" FROM raw GROUP BY 1"
    for h, c in (("ML#", "id_text"), ("Status", "status_text"), ("Unit View", "view_text"), ("Remarks", "remark_text"))
)


def aud_top_values(spark, folder):
    return audit.top_values(S.raw_export(spark, folder), "Unit View")


QUERIES["aud_top_values"] = aud_top_values
SQL["aud_top_values"] = f"""WITH raw AS ({S.RAW_SQL}) SELECT view_text AS "Unit View", count(*) AS rows FROM raw
WHERE view_text IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""


def aud_column_ratio(spark, folder):
    found = audit.column_ratio(S.listings(spark, folder, "original_list_price", "last_list_price"), "original_list_price", "last_list_price")
    return found.select("rows", *[F.round(c, 8).alias(c) for c in ("mean", "near_1", "near_12", "p10", "median", "p90")])


QUERIES["aud_column_ratio"] = aud_column_ratio
SQL["aud_column_ratio"] = WITH_NORM + """SELECT count(*) AS rows, round(avg(r), 8) AS mean, round(avg(CAST(r BETWEEN 0.95 AND 1.05 AS INT)), 8) AS near_1,
  round(avg(CAST(r BETWEEN 11 AND 13 AS INT)), 8) AS near_12, round(quantile_cont(r, 0.1), 8) AS p10, round(median(r), 8) AS median, round(quantile_cont(r, 0.9), 8) AS p90
FROM (SELECT original_list_price / last_list_price AS r FROM norm WHERE last_list_price > 0) WHERE r IS NOT NULL"""


def aud_floor_conflicts(spark, folder):
    return audit.floor_conflicts(S.normalized(spark, folder, whole=False).frame)


QUERIES["aud_floor_conflicts"] = aud_floor_conflicts
SQL["aud_floor_conflicts"] = WITH_NORM + """SELECT count(unit_floor) AS floors, count(total_stories) AS heights,
  count(*) FILTER (unit_floor > total_stories) AS conflicts, count(*) FILTER (unit_floor > total_stories AND total_stories <= 1) AS unusable_height FROM norm"""


def aud_status_evidence(spark, folder):
    return audit.status_evidence(S.normalized(spark, folder, whole=False).frame, F.col("status") == "SOLD")


QUERIES["aud_status_evidence"] = aud_status_evidence
SQL["aud_status_evidence"] = WITH_NORM + """SELECT count(*) FILTER (s AND close_date IS NOT NULL) AS agreed, count(*) FILTER (s AND close_date IS NULL) AS unproven,
  count(*) FILTER (NOT s AND close_date IS NOT NULL) AS missed FROM (SELECT *, coalesce(status = 'SOLD', FALSE) AS s FROM norm)"""


def aud_column_wedge(spark, folder):
    rows = premium_lines(spark, folder)
    ident = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    left = rows.select(ident.alias("id"), F.col("rel_price_premium").alias("x"))
    right = rows.select(ident.alias("id"), (F.col("rel_price_premium") + F.col("l_tax") * F.col("l_discount")).alias("x"))
    found = audit.column_wedge(left, right, "id", "x")
    return found.select("rows", "rows_differing", *[F.round(c, 8).alias(c) for c in ("corr", "sd_x", "sd_y", "sd_gap", "max_gap", "attenuation")])


QUERIES["aud_column_wedge"] = aud_column_wedge
SQL["aud_column_wedge"] = f"""WITH {PREMIUM}, b AS (SELECT rel_price_premium AS x, rel_price_premium + l_tax * l_discount AS y FROM premium WHERE rel_price_premium IS NOT NULL)
SELECT count(*) AS rows, count(*) FILTER (abs(y - x) > 1e-12) AS rows_differing, round(corr(x, y), 8) AS corr, round(stddev_samp(x), 8) AS sd_x, round(stddev_samp(y), 8) AS sd_y,
  round(stddev_samp(y - x), 8) AS sd_gap, round(max(abs(y - x)), 8) AS max_gap, round(var_samp(x) / (var_samp(x) + var_samp(y - x)), 8) AS attenuation FROM b"""


def set_dropped_reasons(spark, folder):
    """Reasons that took rows of some files but not of others."""
    judged = S.cleaned(spark, folder, columns=("file_quarter",)).judged.where(F.col(REASON).isNotNull())
    seen = judged.groupBy("file_quarter").agg(F.collect_set(REASON).alias("seen"))
    # The reasons are a short fixed list.
    known = F.array(*[F.lit(r[0]) for r in judged.select(REASON).distinct().collect()])
    return seen.select("file_quarter", F.explode(F.array_except(known, "seen")).alias(REASON))


QUERIES["set_dropped_reasons"] = set_dropped_reasons
SQL["set_dropped_reasons"] = WITH_CLEAN + """, j AS (SELECT * FROM judged WHERE drop_reason IS NOT NULL)
SELECT * FROM (SELECT DISTINCT a.file_quarter, b.drop_reason FROM j a, (SELECT DISTINCT drop_reason FROM j) b)
EXCEPT SELECT DISTINCT file_quarter, drop_reason FROM j"""
