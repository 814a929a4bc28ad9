"""Checked queries of parts that no other query runs: fills, surfaces, probabilities, caveats, reading back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import common
from tidemark.operators import audit, design, diagnostics, hedonic, ladder, logit, profile, scenario, survival
from tidemark.plans import check_plans as P
from tidemark.plans import stand_ins as S
from tidemark.plans.check_features import LINES, lines
from tidemark.plans.check_models import ONE_COX, WITH_SPELLS, spells
from tidemark.plans.check_sources import _orders, _place
from tidemark.session import land
from tidemark.sources import exports, inventory, reports, settings

QUERIES = {}
SQL = {}
WITH_LINES = f"WITH {LINES}"


# ---- sources ----------------------------------------------------------------


def src_export_folder(spark, folder):
    """All exports of a folder, found by listing it."""
    place = f"{_place(spark)}/all"
    reports.write_csv(_orders(spark, folder).repartition(5, "o_orderkey"), place)
    rows = exports.read_exports(spark, place)
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("rows"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total"))


QUERIES["src_export_folder"] = src_export_folder
SQL["src_export_folder"] = "SELECT o_orderpriority, count(*) AS rows, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"


def inv_read(spark, folder):
    """An inventory written as CSV and as JSON and read back as strings."""
    place = _place(spark)
    rows = P.units(spark, folder).select("project", "unit_id", "floor", "living_area_sqft", F.when(F.col("unit_number") % 7 > 0, F.col("view")).alias("view"))
    reports.write_csv(rows, f"{place}/units.csv")
    reports.write_report(rows, place, "units.json")
    read = [inventory.read_inventory(spark, f"{place}/units.csv").withColumn("kind", F.lit("csv")), inventory.read_inventory(spark, f"{place}/units.json", "json").withColumn("kind", F.lit("json"))]
    both = read[0].unionByName(read[1])
    return both.groupBy("kind", "project").agg(
        F.count("*").alias("rows"), F.count("view").alias("views"), F.sum(F.col("floor").cast("long")).alias("floors"), F.max("living_area_sqft").alias("last_area"),
    )


QUERIES["inv_read"] = inv_read
SQL["inv_read"] = P.WITH + """SELECT kind, project, count(*) AS rows, count(CASE WHEN k % 7 > 0 THEN 1 END) AS views, sum(floor)::BIGINT AS floors, max(CAST(area AS VARCHAR)) AS last_area
FROM units, (VALUES ('csv'), ('json')) t(kind) GROUP BY 1, 2"""


def _market(spark, folder):
    nations = S.tables(spark, folder, "nation")["nation"].orderBy("n_nationkey").collect()
    return {
        "market": "stand_in", "currency": "USD", "area_unit": "sqft", "price_unit": "usd", "defaults": {}, "filters": {},
        "view_categories": [r["n_name"] for r in nations if r["n_regionkey"] == 2],
        "submarkets": {r["n_name"]: {"zips": [str(33100 + r["n_nationkey"] * 3 % 40), 33150 - r["n_nationkey"] % 9], "tier": r["n_regionkey"]} for r in nations},
    }


def set_zip_table(spark, folder):
    """Codes of the settings, each with the first submarket that lists it."""
    return settings.zip_table(spark, settings.load_settings(_market(spark, folder), "stand_in"))


QUERIES["set_zip_table"] = set_zip_table
SQL["set_zip_table"] = """SELECT CAST(code AS VARCHAR) AS zip_code, n_name AS submarket, CAST(n_regionkey AS INT) AS tier FROM (
  SELECT *, unnest([33100 + n_nationkey * 3 % 40, 33150 - n_nationkey % 9]) AS code, unnest([0, 1]) AS place FROM nation)
QUALIFY row_number() OVER (PARTITION BY code ORDER BY n_nationkey, place) = 1"""


def set_view_ranks(spark, folder):
    return settings.view_ranks(spark, _market(spark, folder))


QUERIES["set_view_ranks"] = set_view_ranks
SQL["set_view_ranks"] = "SELECT n_name AS view, CAST(row_number() OVER (ORDER BY n_nationkey DESC) AS INT) AS rank FROM nation WHERE n_regionkey = 2"


def nrm_missing(spark, folder):
    """Null and NaN are both missing."""
    rows = lines(spark, folder).withColumn("v", F.when(F.col("l_linenumber") == 2, F.lit(float("nan"))).when(F.col("l_linenumber") != 4, F.col("ppsf")))
    return rows.groupBy("p_brand").agg(common.tally(common.missing("v")).alias("missing"), common.tally(~common.missing("v")).alias("present"))


QUERIES["nrm_missing"] = nrm_missing
SQL["nrm_missing"] = WITH_LINES + "SELECT p_brand, count(*) FILTER (l_linenumber IN (2, 4)) AS missing, count(*) FILTER (l_linenumber NOT IN (2, 4)) AS present FROM lines GROUP BY 1"


def cln_excluded(spark, folder):
    """The waterfall when cancelled listings are left out."""
    return S.cleaned(spark, folder, "excluded", columns=()).waterfall


QUERIES["cln_excluded"] = cln_excluded
SQL["cln_excluded"] = f"WITH {S.CLEAN_SQL}".replace(
    "THEN 'below_min_list_price' END", "THEN 'below_min_list_price' WHEN status = 'CANCELED' THEN 'cancelled_excluded' END"
) + "SELECT coalesce(drop_reason, 'kept') AS reason, count(*) AS rows FROM judged GROUP BY 1"


# ---- ladders and scenarios ---------------------------------------------------


def cube_unmatched(spark, folder):
    """Units of a ladder that another inventory does not have."""
    found, _ = ladder.price_ladder(P.units(spark, folder), P.KEYS)
    return ladder.unmatched_units(found, P.units(spark, folder).where(F.col("unit_number") % 9 != 0), P.KEYS)


QUERIES["cube_unmatched"] = cube_unmatched
SQL["cube_unmatched"] = P.WITH + "SELECT project, unit_id FROM bands WHERE exclusion IS NULL AND k % 9 = 0"


def cube_given_bounds(spark, folder):
    """Bands given from outside instead of a surface's."""
    rows = P.units(spark, folder).withColumns({"least": F.col("cost_basis_ppsf") * 1.1, "most": F.col("cost_basis_ppsf") * 1.1 + 50 + F.col("floor")})
    return ladder.check_bounds(rows, "least", "most").select(
        "project", "unit_id", *[F.round(c, 6).alias(c) for c in ("band_floor", "band_ceiling", "predicted_ppsf")], "floor_source", "exclusion"
    )


QUERIES["cube_given_bounds"] = cube_given_bounds
SQL["cube_given_bounds"] = P.WITH + """SELECT project, unit_id, round(cost * 1.1, 6) AS band_floor, round(cost * 1.1 + 50 + floor, 6) AS band_ceiling, round(cost * 1.1 + (50 + floor) / 2, 6) AS predicted_ppsf,
  'hedonic_comps' AS floor_source, CAST(NULL AS VARCHAR) AS exclusion FROM units"""


def cube_pinned_period(spark, folder):
    """Time controls held at the latest fitted period, and what the surface then predicts."""
    rows = lines(spark, folder).withColumns({"list_quarter": F.col("quarter"), "y": F.log("ppsf")})
    made, encoded = design.learn_design(rows, ["list_quarter"], ["list_quarter"], min_level=1, extra=["y"])
    fit = hedonic.least_squares_fit("close", encoded, made, "y")
    pinned = ladder.pinned_time_controls(made)
    scored = rows.withColumns(pinned).withColumn("p", F.round(design.linear_predictor(made, fit.lookup), 7))
    return scored.groupBy("list_quarter", "p").agg(F.count("*").alias("rows"))


QUERIES["cube_pinned_period"] = cube_pinned_period
SQL["cube_pinned_period"] = WITH_LINES + """SELECT max(quarter) AS list_quarter, (SELECT round(avg(ln(ppsf)), 7) FROM lines WHERE quarter = (SELECT max(quarter) FROM lines)) AS p, count(*) AS rows FROM lines"""


def scn_caveats(spark, folder):
    """Caveats that breaches, assumed spreads and a missing baseline call for."""
    flags = P.phases(spark, folder).select("project", "phase_index", ((F.length("project") + F.col("phase_index")) % 3 == 0).alias("is_alarming"))
    return scenario.simulation_caveats(flags, P.sigmas(spark, folder).where(F.col("sigma") != 4), P.KEYS, False)


QUERIES["scn_caveats"] = scn_caveats
SQL["scn_caveats"] = """WITH s AS (SELECT concat('Brand#', n_nationkey + 1) AS project, channel, s * (1 + n_nationkey % 4) AS sigma FROM nation,
  (VALUES ('beta_price', 0.03), ('absorption', 0.15), ('competing_listings', 2.0), ('comps_drift', 0.03), ('completion_delay_months', 2.0)) t(channel, s))
SELECT project, concat('assumed, not fitted: ', channel) AS caveat FROM s WHERE channel <> 'beta_price' AND sigma <> 4
UNION ALL SELECT concat('Brand#', n_nationkey + 1), concat('cash floor missed in phase ', j) FROM nation, range(4) t(j) WHERE (length(concat('Brand#', n_nationkey + 1)) + j) % 3 = 0
UNION ALL SELECT DISTINCT project, 'no baseline at comparables' FROM s"""


# ---- profiles ---------------------------------------------------------------


def agg_feature_warnings(spark, folder):
    """Warnings that the feature numbers call for, with and without a respecified premium."""
    rows = lines(spark, folder).withColumns(
        {
            "rel_price_premium": F.col("l_tax") - F.col("l_discount") * 2, "event_sold": (F.col("l_returnflag") == "R").cast("int"),
            "is_penthouse": F.col("p_size") > 45, "log_floor": F.when(F.col("l_linenumber") != 3, F.log("p_size")),
            "hoa_per_sqft_source": F.when(F.col("l_linenumber") == 7, "negative").otherwise("computed"),
            "median_basis": F.when(F.col("l_linenumber") < 3, "insufficient").otherwise("submarket_month"),
        }
    )
    stats, flags = profile.premium_stats(rows), profile.feature_flags(rows)
    found = [profile.feature_warnings(stats, flags, kind).withColumn("residual", F.lit(kind)) for kind in (False, True)]
    return found[0].unionByName(found[1])


QUERIES["agg_feature_warnings"] = agg_feature_warnings
SQL["agg_feature_warnings"] = WITH_LINES + """, v AS (SELECT l_tax - l_discount * 2 AS x, CAST(l_returnflag = 'R' AS DOUBLE) AS e, l_linenumber AS n FROM lines),
s AS (SELECT quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, corr(x, e) AS r, avg(CAST(n < 3 AS DOUBLE)) AS thin, count(*) FILTER (n = 7) AS neg FROM v),
k AS (SELECT unnest([FALSE, TRUE]) AS residual)
SELECT 'pricing variation too narrow' AS warning, residual FROM s, k WHERE iqr < 0.03 UNION ALL SELECT 'pricing variation too wide', residual FROM s, k WHERE iqr > 0.35 AND NOT residual
UNION ALL SELECT 'thin cells', residual FROM s, k WHERE thin > 0.2 UNION ALL SELECT 'negative fees', residual FROM s, k WHERE neg > 0
UNION ALL SELECT 'smoke signal failed: premium and sale are not negatively related', residual FROM s, k WHERE r >= 0
UNION ALL SELECT 'identification variable respecified as a residual', residual FROM k WHERE residual"""


def agg_comps(spark, folder):
    """Median reference price per place at fit time."""
    rows = lines(spark, folder).select(F.when(F.col("p_brand") != "Brand#13", F.col("p_brand")).alias("submarket"), F.col("ppsf").alias("cell_median_ppsf"))
    return profile.fit_time_comps(rows).select("submarket", F.round("median_ppsf", 7).alias("median_ppsf"))


QUERIES["agg_comps"] = agg_comps
SQL["agg_comps"] = WITH_LINES + "SELECT p_brand AS submarket, round(median(ppsf), 7) AS median_ppsf FROM lines WHERE p_brand <> 'Brand#13' GROUP BY 1"


# ---- fits -------------------------------------------------------------------


def reg_filled_design(spark, folder):
    """Means of the columns of a design that keeps every row: filled numbers, missing marks, a level for missing."""
    rows = lines(spark, folder).withColumns(
        {"gappy": F.when(F.col("l_linenumber") != 4, F.col("l_quantity")), "kind": F.when(F.col("l_linenumber") != 5, F.col("p_type"))}
    )
    made = design.learn_filled_design(rows, ["gappy", "l_tax"], [], ["kind"], 1)
    encoded = made.encoded(rows)
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.round(F.col(f"m{i}"), 8).alias("mean"), F.round(F.col(f"s{i}"), 8).alias("sd")) for i, n in enumerate(made.names)])
    sums = [f(F.col(f"`{n}`")).alias(f"{k}{i}") for i, n in enumerate(made.names) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    return encoded.agg(*sums).select(F.inline(cells))


QUERIES["reg_filled_design"] = reg_filled_design
SQL["reg_filled_design"] = WITH_LINES + """, r AS (SELECT CASE WHEN l_linenumber <> 4 THEN l_quantity END AS gappy, l_tax, CASE WHEN l_linenumber <> 5 THEN p_type ELSE '__missing__' END AS kind FROM lines),
f AS (SELECT coalesce(gappy, avg(gappy) OVER ()) AS g, CAST(gappy IS NULL AS INT) AS na, l_tax, kind FROM r),
levels AS (SELECT DISTINCT kind AS shown FROM r ORDER BY shown OFFSET 1)
SELECT 'gappy' AS name, round(avg(g), 8) AS mean, round(stddev_pop(g), 8) AS sd FROM f UNION ALL SELECT 'gappy_isna', round(avg(na), 8), round(stddev_pop(na), 8) FROM f
UNION ALL SELECT 'l_tax', round(avg(l_tax), 8), round(stddev_pop(l_tax), 8) FROM f
UNION ALL SELECT concat('kind=', shown), round(avg(CAST(kind = shown AS INT)), 8), round(stddev_pop(CAST(kind = shown AS INT)), 8) FROM f, levels GROUP BY shown"""


def reg_unknown_levels(spark, folder):
    """Levels that a fit on some of the rows has never seen."""
    rows = lines(spark, folder).withColumn("y", F.log("ppsf"))
    made, _ = design.learn_design(rows.where(F.col("p_brand") < "Brand#20"), ["p_brand"], ["p_brand"], min_level=1, extra=["y"])
    return design.unknown_levels(rows, made)


QUERIES["reg_unknown_levels"] = reg_unknown_levels
SQL["reg_unknown_levels"] = WITH_LINES + "SELECT 'p_brand' AS source, p_brand AS level, count(*) AS rows FROM lines WHERE p_brand >= 'Brand#20' GROUP BY 2"


def reg_logit_probability(spark, folder):
    """A logit on one 0/1 covariate predicts the share of each of its two groups."""
    rows = spells(spark, folder)
    fit = logit.fit_logit(rows, ["late"], 180, [], held_out=False)
    return rows.select("late", F.round(fit.probability(), 5).alias("probability")).groupBy("late", "probability").agg(F.count("*").alias("rows"))


QUERIES["reg_logit_probability"] = reg_logit_probability
SQL["reg_logit_probability"] = WITH_SPELLS + """, y AS (SELECT late, avg(CAST(event_sold = 1 AND duration_days <= 180 AS INT)) AS p FROM spells WHERE (event_sold = 1 AND duration_days <= 180) OR duration_days >= 180 GROUP BY 1)
SELECT late, round(p, 5) AS probability, count(*) AS rows FROM spells JOIN y USING (late) GROUP BY 1, 2"""


def reg_holdout(spark, folder):
    """AUC of a one-covariate logit on exactly a quarter of each class."""
    rows = spells(spark, folder).withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    fit = logit.fit_logit(rows, ["l_quantity"], 60, [], id_columns=["line"]).fit
    return spark.createDataFrame([(float(fit.stats["auc_holdout"]),)], "auc double").select(F.round("auc", 9).alias("auc"))


QUERIES["reg_holdout"] = reg_holdout
SQL["reg_holdout"] = WITH_SPELLS + f""", t AS (SELECT l_quantity AS x, CAST(event_sold = 1 AND duration_days <= 60 AS INT) AS y, CAST('0x' || substr(md5(concat('{logit.SEED}|', l_orderkey * 10 + l_linenumber)), 1, 15) AS BIGINT) AS h
  FROM spells WHERE (event_sold = 1 AND duration_days <= 60) OR duration_days >= 60),
m AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h) <= floor(0.25 * count(*) OVER (PARTITION BY y) + 0.5) AS test FROM t),
s AS (SELECT sign(covar_pop(x, y)) AS way FROM m WHERE NOT test),
g AS (SELECT x * way AS x, sum(y) AS a, sum(1 - y) AS b FROM m, s WHERE test GROUP BY 1),
c AS (SELECT a, b, coalesce(sum(b) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT round(sum(a * (below + b / 2)) / (sum(a) * sum(b)), 9) AS auc FROM c"""


def reg_close_surface(spark, folder):
    """The close-price surface on one covariate: slope, floor premium, spread and bounds."""
    rows = lines(spark, folder).withColumns({"close_ppsf": F.col("ppsf"), "log_floor": F.log1p("p_size")})
    made = hedonic.fit_close(rows, covariates=["log_floor"], categorical=[])
    scored = rows.withColumns(made.columns()).withColumn("premium", made.floor_log_premium("p_size"))
    # Adding zero makes a negative zero a plain one.
    sums = scored.groupBy("p_size").agg(*[(F.round(F.avg(c), 6) + F.lit(0.0)).alias(c) for c in ("predicted_ppsf", "p_floor_ppsf", "p_ceiling_ppsf", "premium")])
    return sums.withColumns({k: F.lit(round(made.floor_premium[k], 8)) for k in ("alpha", "gamma", "alpha_std_error", "gamma_std_error")})


QUERIES["reg_close_surface"] = reg_close_surface
SQL["reg_close_surface"] = WITH_LINES + """, f AS (SELECT regr_slope(ln(ppsf), ln(p_size + 1)) AS a, regr_intercept(ln(ppsf), ln(p_size + 1)) AS c, count(*) AS n, var_pop(ln(p_size + 1)) AS vx, var_pop(ln(ppsf)) AS vy FROM lines),
e AS (SELECT *, sqrt((vy - a * a * vx) * n / (n - 2)) AS sd, sqrt((vy - a * a * vx) / (n - 2) / vx) AS se FROM f)
SELECT p_size, round(exp(c + a * ln(p_size + 1)), 6) AS predicted_ppsf, round(exp(c + a * ln(p_size + 1) - 1.5 * sd), 6) AS p_floor_ppsf, round(exp(c + a * ln(p_size + 1) + 1.5 * sd), 6) AS p_ceiling_ppsf,
  round(a * (ln(p_size + 1) - ln(2)), 6) + CAST(0 AS DOUBLE) AS premium, round(a, 8) AS alpha, round(-a * ln(2), 8) AS gamma, round(se, 8) AS alpha_std_error, round(se * ln(2), 8) AS gamma_std_error
FROM (SELECT DISTINCT p_size FROM lines), e"""


def reg_probability(spark, folder):
    """Probabilities of a sale by day 60 under a fitted hazard, averaged per brand, and the baseline between days."""
    rows = land(spells(spark, folder).select("p_brand", "rel_price_premium", "duration_days", "event_sold"), "spells")
    fit = survival.fit_cox(rows, ["rel_price_premium"], [], with_concordance=False)
    found = rows.withColumn("p", fit.probability(60.5)).groupBy("p_brand").agg(F.round(F.avg("p"), 8).alias("probability"), F.round(F.max("p"), 8).alias("most"))
    return found.withColumn("base", F.lit(round(float(fit.survival_at(60.5)[0]), 8)))


QUERIES["reg_probability"] = reg_probability
SQL["reg_probability"] = ONE_COX + """,
c AS (SELECT avg(x) AS c FROM src),
h AS (SELECT t, sum(e) AS m, sum(exp(b * (x - c))) AS w FROM src, b6, c GROUP BY t),
k AS (SELECT t, m / sum(w) OVER (ORDER BY t DESC) AS hazard FROM h),
u AS (SELECT t, sum(hazard) OVER (ORDER BY t) AS total FROM k),
p AS (SELECT max(t) FILTER (t <= 60.5) AS lo, arg_max(total, t) FILTER (t <= 60.5) AS a, min(t) FILTER (t > 60.5) AS hi, arg_min(total, t) FILTER (t > 60.5) AS z FROM u),
v AS (SELECT a + (60.5 - lo) / (hi - lo) * (z - a) AS total, exp(-a) + (60.5 - lo) / (hi - lo) * (exp(-z) - exp(-a)) AS base FROM p),
q AS (SELECT p_brand, 1 - exp(-total * exp(b * (rel_price_premium - c))) AS p, base FROM spells, b6, c, v)
SELECT p_brand, round(avg(p), 8) AS probability, round(max(p), 8) AS most, round(any_value(base), 8) AS base FROM q GROUP BY 1"""


def aud_time_residuals(spark, folder):
    """Scaled residuals against ranked time: the statistic of a one-covariate hazard."""
    rows = spells(spark, folder)
    fit = survival.fit_cox(rows, ["rel_price_premium"], [], with_concordance=False)
    return survival.day_residuals(rows, fit).select("name", F.round("statistic", 6).alias("statistic"))


QUERIES["aud_time_residuals"] = aud_time_residuals
SQL["aud_time_residuals"] = ONE_COX + """,
d AS (SELECT t, sum(e) AS m, sum(e * x) AS ex, sum(exp(b * x)) AS s0, sum(x * exp(b * x)) AS s1 FROM src, b6 GROUP BY t),
r AS (SELECT t, m, ex, sum(s0) OVER (ORDER BY t DESC) AS r0, sum(s1) OVER (ORDER BY t DESC) AS r1, sum(m) OVER (ORDER BY t) - (m - 1) / 2 AS rank FROM d),
z AS (SELECT m, ex - m * r1 / r0 AS res, rank - sum(m * rank) OVER () / sum(m) OVER () AS mid FROM r WHERE m > 0)
SELECT 'rel_price_premium' AS name, round(pow(sum(mid * res) * sum(m) / any_value(i), 2) / (sum(m) / any_value(i) * sum(m * mid * mid)), 6) AS statistic FROM z, g6"""


def aud_inflation(spark, folder):
    """Variance inflation of two columns, and the condition number."""
    fit = survival.fit_cox(spells(spark, folder), ["rel_price_premium", "l_tax"], [], with_concordance=False).fit
    return diagnostics.collinearity(spark, fit).select("name", F.round("value", 7).alias("value"))


QUERIES["aud_inflation"] = aud_inflation
SQL["aud_inflation"] = WITH_SPELLS + """, m AS (SELECT corr(rel_price_premium, l_tax) AS r, abs(sum(rel_price_premium * l_tax)) / sqrt(sum(rel_price_premium * rel_price_premium) * sum(l_tax * l_tax)) AS c FROM spells)
SELECT 'rel_price_premium' AS name, round(1 / (1 - r * r), 7) AS value FROM m UNION ALL SELECT 'l_tax', round(1 / (1 - r * r), 7) FROM m UNION ALL SELECT 'condition_number', round(sqrt((1 + c) / (1 - c)), 7) FROM m"""


def aud_extremes_all(spark, folder):
    """Both ends of all rows, told with their ties."""
    rows = spells(spark, folder).withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return audit.extreme_rows(rows, [], "l_extendedprice", "line", 5)


QUERIES["aud_extremes_all"] = aud_extremes_all
SQL["aud_extremes_all"] = WITH_SPELLS + """, r AS (SELECT l_orderkey * 10 + l_linenumber AS line, l_extendedprice AS v, CAST(row_number() OVER (ORDER BY l_extendedprice, l_orderkey * 10 + l_linenumber) AS INT) AS lo,
  CAST(row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS INT) AS hi FROM spells)
SELECT 'low' AS side, lo AS rank, line AS ident, v AS value FROM r WHERE lo <= 5 UNION ALL SELECT 'high', hi, line, v FROM r WHERE hi <= 5"""


def reg_close_absorbed(spark, folder):
    """The close-price surface within suppliers: slope, floor premium and what each supplier's pieces should bring."""
    rows = lines(spark, folder).withColumns({"close_ppsf": F.col("ppsf"), "log_floor": F.log1p("p_size")})
    made = hedonic.fit_close(rows, covariates=["log_floor"], categorical=[], absorb=["l_suppkey"])
    sums = made.with_columns(rows).groupBy("l_suppkey").agg(*[F.round(F.avg(F.log(c)), 7).alias(c) for c in ("predicted_ppsf", "p_floor_ppsf", "p_ceiling_ppsf")])
    return sums.withColumns({k: F.lit(round(made.floor_premium[k], 8)) for k in ("alpha", "alpha_std_error")})


QUERIES["reg_close_absorbed"] = reg_close_absorbed
SQL["reg_close_absorbed"] = WITH_LINES + """, d AS (SELECT l_suppkey, ln(p_size + 1) AS x, ln(ppsf) AS y FROM lines),
g AS (SELECT l_suppkey, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM d GROUP BY 1),
s AS (SELECT sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) AS a, sum((x - mx) * (x - mx)) AS xx, sum((y - my) * (y - my)) AS yy, count(*) AS n, count(DISTINCT l_suppkey) AS k FROM d JOIN g USING (l_suppkey)),
e AS (SELECT a, sqrt((yy - a * a * xx) / (n - 1 - k)) AS sd, sqrt((yy - a * a * xx) / (n - 1 - k) / xx) AS se FROM s)
SELECT l_suppkey, round(my, 7) AS predicted_ppsf, round(my - 1.5 * sd, 7) AS p_floor_ppsf, round(my + 1.5 * sd, 7) AS p_ceiling_ppsf, round(a, 8) AS alpha, round(se, 8) AS alpha_std_error FROM g, e"""
