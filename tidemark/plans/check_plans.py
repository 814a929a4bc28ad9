"""Checked queries: ladders, cubes, plans, scenarios.

A project is a brand and its units are the parts of that brand; its phases come
from the nation of the same number, its scenario draws from the customers of
that nation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.floors import floor_band
from tidemark.operators import audit, cube, ladder, plan, scenario
from tidemark.plans import stand_ins as S
from tidemark.session import land, spread
from tidemark.sources import inventory

QUERIES = {}
SQL = {}

KEYS = ["project"]
LEVELS = 15
BETA = -1.6
BETA_INVENTORY = -0.01
SUPPORT = {"low": -0.45, "high": 0.35, "p1": -0.30, "p99": 0.20}
RATE = 0.12
# A known baseline: survival on a grid of days.
GRID = [0.0, 15.0, 30.0, 60.0, 90.0, 120.0, 150.0, 180.0]
SURVIVAL = [1.0, 0.95, 0.9, 0.8, 0.72, 0.65, 0.6, 0.55]


def units(spark, folder):
    part = spread(S.tables(spark, folder, "part")["part"])
    key = F.col("p_partkey")
    return part.select(
        F.col("p_brand").alias("project"),
        key.cast("string").alias("unit_id"),
        key.alias("unit_number"),
        F.col("p_size").alias("floor"),
        (400 + 40 * F.col("p_size")).cast("double").alias("living_area_sqft"),
        F.col("p_type").alias("unit_type"),
        F.concat(F.lit("T"), (key % 3).cast("string")).alias("building"),
        F.element_at(F.split("p_name", " "), 1).alias("submarket"),
        F.element_at(F.split("p_name", " "), 2).alias("view"),
        (450 + key % 400).cast("double").alias("cost_basis_ppsf"),
        (900 + key % 211 + 4 * F.col("p_size")).cast("double").alias("predicted_ppsf"),
        F.date_add(F.lit("2026-06-01").cast("date"), (key % 900).cast("int")).cast("timestamp_ntz").alias("completion_date"),
    ).withColumns(
        {"p_floor_ppsf": F.col("predicted_ppsf") * 0.75, "p_ceiling_ppsf": F.col("predicted_ppsf") * 1.25}
    )


def phases(spark, folder):
    nation = S.tables(spark, folder, "nation")["nation"]
    n, j = F.col("n_nationkey"), F.col("phase_index")
    return nation.select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("phase_index")).select(
        F.concat(F.lit("Brand#"), (n + 1).cast("string")).alias("project"),
        "phase_index",
        (6.0 * j).alias("start_month"),
        F.lit("2026-01-01").cast("timestamp_ntz").alias("project_start"),
        (100_000.0 * (1 + n) * (1 + j)).alias("cash_flow_floor_usd"),
        (10 + n).alias("max_units"),
        (20.0 + 5 * j).alias("competing_listings"),
        F.create_map(F.lit("ECONOMY"), (5 + n % 3).cast("int"), F.lit("PROMO"), F.lit(2)).alias("min_type_counts"),
    )


def comps(spark, folder):
    base = units(spark, folder).select("submarket").distinct()
    return base.select("submarket", (900.0 + 10 * F.length("submarket")).alias("median_ppsf"))


UNITS = """units AS (
  SELECT p_brand AS project, CAST(p_partkey AS VARCHAR) AS unit_id, p_partkey AS k, p_size AS floor, CAST(400 + 40 * p_size AS DOUBLE) AS area,
    p_type AS unit_type, concat('T', p_partkey % 3) AS building, split_part(p_name, ' ', 1) AS submarket, split_part(p_name, ' ', 2) AS view,
    CAST(450 + p_partkey % 400 AS DOUBLE) AS cost, CAST(900 + p_partkey % 211 + 4 * p_size AS DOUBLE) AS predicted,
    TIMESTAMP '2026-06-01' + to_days(CAST(p_partkey % 900 AS INT)) AS completion FROM part),
bands AS (
  SELECT *, greatest(predicted * 0.75, cost * 1.15) AS lo, predicted * 1.25 AS hi,
    CASE WHEN cost * 1.15 >= predicted * 0.75 THEN 'cost_basis' ELSE 'hedonic_comps' END AS floor_source,
    CASE WHEN predicted * 1.25 - greatest(predicted * 0.75, cost * 1.15) < 1 THEN 'cost_exceeds_comps' END AS exclusion FROM units),
phases AS (
  SELECT concat('Brand#', n_nationkey + 1) AS project, n_nationkey AS n, CAST(j AS INT) AS phase_index, 6.0 * j AS start_month,
    TIMESTAMP '2026-01-01' + to_seconds(6 * j * 2629800) AS opens, 100000.0 * (1 + n_nationkey) * (1 + j) AS cash, 10 + n_nationkey AS max_units, 20.0 + 5 * j AS competing
  FROM nation, range(4) t(j)),
ladder AS (
  SELECT *, CAST(l AS INT) AS level_index, CASE WHEN l = 14 THEN hi ELSE lo + l * ((hi - lo) / 14) END AS price FROM bands, range(15) t(l) WHERE exclusion IS NULL),
cells AS (
  SELECT u.project, unit_id, k, phase_index, level_index, start_month, price, area, floor, unit_type, opens, completion, building,
    price / ((900.0 + 10 * length(submarket)) * pow(1.002, start_month)) - 1 AS premium,
    pow(1.12, -start_month / 12) AS discount, opens >= completion - to_seconds(24 * 2629800) AS releasable,
    epoch(opens - (completion - to_seconds(24 * 2629800))) / 2629800 AS slack
  FROM ladder u JOIN phases p ON u.project = p.project),
cube AS (SELECT *, price * area * p AS expected, price * area * p * discount AS discounted
  FROM (SELECT *, 1 - exp(-0.7 * exp(-1.6 * premium)) AS p FROM cells))"""
WITH = f"WITH {UNITS}\n"


def phase_frame(spark, folder):
    bands = ladder.price_bands(units(spark, folder)).where(F.col("exclusion").isNull()).drop("exclusion")
    rows = cube.phase_rows(bands, phases(spark, folder), comps(spark, folder), KEYS, drift=0.002)
    return rows.withColumn("gate_slack_months", cube.gate_slack_months())


def full_cube(spark, folder, **options):
    rows = phase_frame(spark, folder)
    return cube.revenue_cube(
        rows, cube.planted_probability(BETA), KEYS, LEVELS, RATE,
        keep=["gate_slack_months", "unit_type", "floor", "unit_number", "building"], **options,
    )


def given_plan(spark, folder):
    """A plan by formula: one unit in five is not released, some are released twice."""
    k = F.col("unit_number")
    bands = ladder.price_bands(units(spark, folder)).where(F.col("exclusion").isNull())
    once = bands.where(k % 5 < 4).select(
        "project", "unit_id", (k % 5).cast("int").alias("phase_index"), ((k * 7) % 15).cast("int").alias("level_index")
    )
    twice = bands.where(k % 97 == 0).select(
        "project", "unit_id", F.lit(3).alias("phase_index"), F.lit(14).alias("level_index")
    )
    return once.unionByName(twice)


PLAN = UNITS + """,
plan AS (SELECT project, unit_id, CAST(k % 5 AS INT) AS phase_index, CAST((k * 7) % 15 AS INT) AS level_index FROM bands WHERE exclusion IS NULL AND k % 5 < 4
  UNION ALL SELECT project, unit_id, 3, 14 FROM bands WHERE exclusion IS NULL AND k % 97 = 0),
rows_ AS (SELECT c.*, concat(unit_type, '|', CASE WHEN floor <= 5 THEN 'low' WHEN floor <= 12 THEN 'mid' WHEN floor <= 25 THEN 'high' ELSE 'tower' END) AS grp
  FROM plan JOIN cube c USING (project, unit_id, phase_index, level_index))"""
WITH_PLAN = f"WITH {PLAN}\n"


def plan_rows(spark, folder):
    rows = plan.plan_cells(given_plan(spark, folder), full_cube(spark, folder), KEYS)
    return rows.withColumn("comparable_group", plan.comparable_group())


def _rounded(df, plain, rounded, digits=4):
    return df.select(*plain, *[F.round(c, digits).alias(c) for c in rounded])


def cube_ladder(spark, folder):
    rows, _ = ladder.price_ladder(units(spark, folder), KEYS)
    return _steps(rows, ["project", "unit_id", "level_index", "floor_source"], {"price_ppsf": 1000})


QUERIES["cube_ladder"] = cube_ladder
SQL["cube_ladder"] = WITH + "SELECT project, unit_id, level_index, floor_source, CAST(floor(price * 1000 + 0.37) AS BIGINT) AS price_ppsf FROM ladder"


def cube_ladder_excluded(spark, folder):
    _, excluded = ladder.price_ladder(units(spark, folder), KEYS, margin=1.0)
    return excluded.groupBy("project", "exclusion").agg(F.count("*").alias("units"))


QUERIES["cube_ladder_excluded"] = cube_ladder_excluded
SQL["cube_ladder_excluded"] = WITH + """SELECT project, 'cost_exceeds_comps' AS exclusion, count(*) AS units FROM units
WHERE predicted * 1.25 - greatest(predicted * 0.75, cost * 2) < 1 GROUP BY project"""


def _steps(df, plain, scales):
    """Whole steps of a scale: cell prices are exact multiples, so rounding would meet ties."""
    return df.select(*plain, *[F.floor(F.col(c) * s + 0.37).cast("bigint").alias(c) for c, s in scales.items()])


def cube_revenue(spark, folder):
    return _steps(
        full_cube(spark, folder), ["project", "unit_id", "phase_index", "level_index", "releasable"],
        {"rel_price_premium": 1e6, "probability": 1e6, "expected_usd": 10, "discounted_usd": 10},
    )


QUERIES["cube_revenue"] = cube_revenue
SQL["cube_revenue"] = WITH + """SELECT project, unit_id, phase_index, level_index, releasable, CAST(floor(premium * 1e6 + 0.37) AS BIGINT) AS rel_price_premium,
  CAST(floor(p * 1e6 + 0.37) AS BIGINT) AS probability, CAST(floor(expected * 10 + 0.37) AS BIGINT) AS expected_usd, CAST(floor(discounted * 10 + 0.37) AS BIGINT) AS discounted_usd FROM cube"""


def cube_arrival_discount(spark, folder):
    rows = full_cube(spark, folder, baseline=(SURVIVAL, GRID))
    return rows.groupBy("project", "phase_index").agg(
        F.round(F.sum("discounted_usd"), 2).alias("arrival_usd"), F.round(F.sum("release_discounted_usd"), 2).alias("release_usd")
    )


QUERIES["cube_arrival_discount"] = cube_arrival_discount
SQL["cube_arrival_discount"] = WITH + f""", g AS (SELECT unnest(range(7)) AS i, unnest({SURVIVAL[:-1]}) AS s0, unnest({SURVIVAL[1:]}) AS s1, unnest({GRID[:-1]}) AS t0, unnest({GRID[1:]}) AS t1),
w AS (SELECT project, unit_id, phase_index, level_index, any_value(expected) AS expected, any_value(discounted) AS release, any_value(p) AS p,
    sum((pow(s0, ln(1 - p) / ln({SURVIVAL[-1]})) - pow(s1, ln(1 - p) / ln({SURVIVAL[-1]}))) * pow(1.12, -(start_month + (t0 + t1) / 2 / 30.4375) / 12)) AS d FROM cube, g GROUP BY ALL)
SELECT project, phase_index, round(sum(expected * d / p), 2) AS arrival_usd, round(sum(release), 2) AS release_usd FROM w GROUP BY ALL"""


def cube_gate(spark, folder):
    return cube.cube_notes(full_cube(spark, folder), KEYS, 180, 150.0, SUPPORT).select(
        "project", "unit_phase_cells", "gated_cells", "horizon_beyond_follow_up",
        F.round("release_total_usd", 2).alias("release_total_usd"),
    )


QUERIES["cube_gate"] = cube_gate
SQL["cube_gate"] = WITH + """SELECT project, count(*) FILTER (level_index = 0) AS unit_phase_cells, count(*) FILTER (level_index = 0 AND NOT releasable) AS gated_cells,
  TRUE AS horizon_beyond_follow_up, round(sum(discounted), 2) AS release_total_usd FROM cube GROUP BY project"""


def cube_clamp(spark, folder):
    rows = phase_frame(spark, folder)
    clamped, projects = cube.clamp_to_support(rows, SUPPORT, KEYS)
    cells = cube.revenue_cube(clamped, cube.planted_probability(BETA), KEYS, LEVELS, RATE)
    sums = cube.scorable_cube(cells, KEYS).groupBy("project").agg(
        F.count("*").alias("cells"), F.round(F.sum("price_ppsf"), 2).alias("price_sum")
    )
    return projects.join(sums, "project", "left")


QUERIES["cube_clamp"] = cube_clamp
SQL["cube_clamp"] = WITH + """, ref AS (SELECT project, unit_id, any_value(lo) AS lo, any_value(hi) AS hi, avg((900.0 + 10 * length(submarket)) * pow(1.002, start_month)) AS r
  FROM bands JOIN phases USING (project) WHERE exclusion IS NULL GROUP BY ALL),
b AS (SELECT *, greatest(lo, r * 0.70) AS a, least(hi, r * 1.20) AS z FROM ref),
s AS (SELECT *, coalesce(z > a, FALSE) AS ok, bool_and(NOT coalesce(z > a, FALSE)) OVER (PARTITION BY project) AS down FROM b),
c AS (SELECT s.project, CASE WHEN ok AND NOT down THEN least(greatest(price, a), z) ELSE price END AS price FROM s JOIN cube USING (project, unit_id) WHERE ok OR down),
t AS (SELECT project, count(*) AS cells, round(sum(price), 2) AS price_sum FROM c GROUP BY project)
SELECT project, count(*) AS units, count(*) FILTER (NOT ok) AS unsupported, bool_and(down) AS stood_down, any_value(cells) AS cells, any_value(price_sum) AS price_sum
FROM s LEFT JOIN t USING (project) GROUP BY project"""


def cube_best_cells(spark, folder):
    best = cube.best_cells(full_cube(spark, folder), KEYS)
    return _steps(best, ["project", "unit_id", "phase_index", "level_index"], {"price_ppsf": 100, "discounted_usd": 10})


QUERIES["cube_best_cells"] = cube_best_cells
SQL["cube_best_cells"] = WITH + """SELECT project, unit_id, phase_index, level_index, CAST(floor(price * 100 + 0.37) AS BIGINT) AS price_ppsf, CAST(floor(discounted * 10 + 0.37) AS BIGINT) AS discounted_usd FROM cube WHERE releasable
QUALIFY row_number() OVER (PARTITION BY project, unit_id ORDER BY discounted DESC, phase_index, level_index) = 1"""


def cube_demand_curve(spark, folder):
    return _rounded(
        cube.demand_curve(full_cube(spark, folder), "7", 2), ["level_index"],
        ["price_ppsf", "rel_price_premium", "probability", "expected_usd"],
    )


QUERIES["cube_demand_curve"] = cube_demand_curve
SQL["cube_demand_curve"] = WITH + """SELECT level_index, round(price, 4) AS price_ppsf, round(premium, 4) AS rel_price_premium, round(p, 4) AS probability,
  round(expected, 4) AS expected_usd FROM cube WHERE unit_id = '7' AND phase_index = 2"""


def cube_nearest_level(spark, folder):
    rows, _ = ladder.price_ladder(units(spark, folder), KEYS, levels=10)
    return ladder.nearest_levels(rows, KEYS).groupBy("project", "level_index").agg(F.count("*").alias("units"))


QUERIES["cube_nearest_level"] = cube_nearest_level
SQL["cube_nearest_level"] = WITH + """, l AS (SELECT project, unit_id, predicted, CAST(l AS INT) AS level_index, CASE WHEN l = 9 THEN hi ELSE lo + l * ((hi - lo) / 9) END AS price
  FROM bands, range(10) t(l) WHERE exclusion IS NULL),
b AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY project, unit_id ORDER BY abs(price - predicted), level_index) = 1)
SELECT project, level_index, count(*) AS units FROM b GROUP BY ALL"""


def cube_groups(spark, folder):
    rows = units(spark, folder).withColumn("g", plan.comparable_group())
    return rows.groupBy("g", floor_band("floor").alias("band")).agg(F.count("*").alias("units"))


QUERIES["cube_groups"] = cube_groups
SQL["cube_groups"] = WITH + """, b AS (SELECT *, CASE WHEN floor < 1 THEN NULL WHEN floor <= 5 THEN 'low' WHEN floor <= 12 THEN 'mid' WHEN floor <= 25 THEN 'high' ELSE 'tower' END AS band FROM units)
SELECT concat(unit_type, '|', coalesce(band, concat('floor_unknown:', unit_id))) AS g, band, count(*) AS units FROM b GROUP BY 1, 2"""


def cube_outside_support(spark, folder):
    return audit.outside_support(full_cube(spark, folder), SUPPORT, KEYS)


QUERIES["cube_outside_support"] = cube_outside_support
SQL["cube_outside_support"] = WITH + """SELECT project, count(*) AS points, count(*) FILTER (premium < -0.45 OR premium > 0.35) AS outside,
  count(*) FILTER (premium < -0.30 OR premium > 0.20) AS outside_or_tail FROM cube GROUP BY project"""


def cube_npv(spark, folder):
    flows = full_cube(spark, folder).where(F.col("level_index") == 0).withColumn("m", F.col("phase_index") * 6)
    return cube.npv(flows, ["project"], "expected_usd", "m", 0.1).select("project", F.round("npv_usd", 2).alias("npv_usd"))


QUERIES["cube_npv"] = cube_npv
SQL["cube_npv"] = WITH + "SELECT project, round(sum(expected * pow(1.1, -phase_index * 6 / 12.0)), 2) AS npv_usd FROM cube WHERE level_index = 0 GROUP BY project"


def plan_phase_rollup(spark, folder):
    found = plan.phase_rollup(plan_rows(spark, folder), phases(spark, folder), KEYS)
    return _rounded(found, ["project", "phase_index", "units_released", "floor_met"], ["expected_usd", "discounted_usd", "mean_price_ppsf"], 2)


QUERIES["plan_phase_rollup"] = plan_phase_rollup
SQL["plan_phase_rollup"] = WITH_PLAN + """SELECT p.project, p.phase_index, count(r.unit_id) AS units_released, coalesce(sum(expected), 0) >= any_value(cash) - 0.01 AS floor_met,
  round(coalesce(sum(expected), 0), 2) AS expected_usd, round(coalesce(sum(discounted), 0), 2) AS discounted_usd, round(avg(price), 2) AS mean_price_ppsf
FROM phases p LEFT JOIN rows_ r USING (project, phase_index) GROUP BY 1, 2"""


def plan_totals(spark, folder):
    found = plan.plan_totals(plan_rows(spark, folder), KEYS, LEVELS)
    return _rounded(found, ["project", "units_released"], ["gross_ask_usd", "expected_usd", "discounted_usd", "unmodelled_mass", "unmodelled_usd", "ceiling_share"], 2)


QUERIES["plan_totals"] = plan_totals
SQL["plan_totals"] = WITH_PLAN + """SELECT project, count(*) AS units_released, round(sum(price * area), 2) AS gross_ask_usd, round(sum(expected), 2) AS expected_usd, round(sum(discounted), 2) AS discounted_usd,
  round(sum(1 - p), 2) AS unmodelled_mass, round(sum(price * area * (1 - p)), 2) AS unmodelled_usd, round(avg(CAST(level_index = 14 AS INT)), 2) AS ceiling_share FROM rows_ GROUP BY project"""


def plan_violations(spark, folder):
    rows = land(plan_rows(spark, folder), "plan")
    found = plan.plan_violations(rows, phases(spark, folder), KEYS)
    return _rounded(found, ["project", "rule", "subject"], ["measured", "bound"], 2)


QUERIES["plan_violations"] = plan_violations
SQL["plan_violations"] = WITH_PLAN + """, roll AS (SELECT p.project, p.phase_index, any_value(cash) AS cash, any_value(max_units) AS max_units, any_value(n) AS n, count(r.unit_id) AS c, coalesce(sum(expected), 0) AS e
  FROM phases p LEFT JOIN rows_ r USING (project, phase_index) GROUP BY 1, 2),
need AS (SELECT project, phase_index, 'ECONOMY' AS t, 5 + n % 3 AS least FROM roll WHERE c > 0 UNION ALL SELECT project, phase_index, 'PROMO', 2 FROM roll WHERE c > 0),
have AS (SELECT project, phase_index, unit_type AS t, count(*) AS c FROM rows_ GROUP BY ALL),
g AS (SELECT project, grp, phase_index, min(level_index) AS lo, max(level_index) AS hi FROM rows_ GROUP BY ALL),
h AS (SELECT *, max(hi) OVER (PARTITION BY project, grp ORDER BY phase_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM g),
v AS (SELECT project, 'at_most_once' AS rule, unit_id AS subject, count(*) AS measured, 1 AS bound FROM rows_ GROUP BY project, unit_id HAVING count(*) > 1
UNION ALL SELECT project, 'max_units', CAST(phase_index AS VARCHAR), c, max_units FROM roll WHERE c > max_units
UNION ALL SELECT project, 'cash_flow_floor', CAST(phase_index AS VARCHAR), e, cash FROM roll WHERE e < cash - 0.01
UNION ALL SELECT project, 'construction_gate', concat(unit_id, '@', phase_index), 0, 1 FROM rows_ WHERE NOT releasable
UNION ALL SELECT need.project, 'min_type_count', concat(need.t, '@', need.phase_index), coalesce(have.c, 0), least FROM need LEFT JOIN have USING (project, phase_index, t) WHERE coalesce(have.c, 0) < least
UNION ALL SELECT project, 'monotone_path', concat(grp, '@', phase_index), lo, e FROM h WHERE lo < e)
SELECT project, rule, subject, round(CAST(measured AS DOUBLE), 2) AS measured, round(CAST(bound AS DOUBLE), 2) AS bound FROM v"""


def plan_extrapolation(spark, folder):
    counts, _ = plan.extrapolation_report(plan_rows(spark, folder), SUPPORT, KEYS)
    return _rounded(counts, ["project", "outside", "tail"], ["min_premium", "max_premium"], 8)


QUERIES["plan_extrapolation"] = plan_extrapolation
SQL["plan_extrapolation"] = WITH_PLAN + """SELECT project, count(*) FILTER (premium < -0.45 OR premium > 0.35) AS outside,
  count(*) FILTER (premium BETWEEN -0.45 AND 0.35 AND (premium < -0.30 OR premium > 0.20)) AS tail, round(min(premium), 8) AS min_premium, round(max(premium), 8) AS max_premium FROM rows_ GROUP BY project"""


def _pools(spark, folder):
    return phases(spark, folder).select("project", "phase_index", F.col("competing_listings").alias("buyer_pool"))


def plan_crowding(spark, folder):
    rows = land(plan_rows(spark, folder), "plan")
    scaled, clusters = plan.crowded_plan(rows, _pools(spark, folder), KEYS)
    totals = plan.crowding_totals(clusters, KEYS)
    worst = plan.worst_cluster(clusters, KEYS)
    sums = scaled.groupBy("project").agg(F.sum("discounted_usd").alias("discounted_usd"))
    joined = totals.join(worst, "project", "left").join(sums, "project")
    return _rounded(
        joined, ["project", "comparable_group", "phase_index"],
        ["uncorrected_usd", "corrected_usd", "share_removed", "removed_usd", "factor", "discounted_usd"], 2,
    )


QUERIES["plan_crowding"] = plan_crowding
SQL["plan_crowding"] = WITH_PLAN + """, c AS (SELECT r.project, r.phase_index, grp, count(*) AS n, sum(expected) AS raw, sum(discounted) AS d, any_value(competing) AS pool
  FROM rows_ r JOIN phases USING (project, phase_index) GROUP BY 1, 2, 3),
f AS (SELECT *, greatest(0.1, 1 - 0.3 * n / pool) AS factor FROM c),
w AS (SELECT * FROM f WHERE factor < 1 QUALIFY row_number() OVER (PARTITION BY project ORDER BY raw * (1 - factor) DESC, phase_index) = 1)
SELECT f.project, any_value(w.grp) AS comparable_group, any_value(w.phase_index) AS phase_index, round(sum(f.raw), 2) AS uncorrected_usd, round(sum(f.raw * f.factor), 2) AS corrected_usd,
  round(1 - sum(f.raw * f.factor) / sum(f.raw), 2) AS share_removed, round(any_value(w.raw * (1 - w.factor)), 2) AS removed_usd, round(any_value(w.factor), 2) AS factor, round(sum(f.d * f.factor), 2) AS discounted_usd
FROM f LEFT JOIN w ON f.project = w.project GROUP BY f.project"""


def plan_level_histogram(spark, folder):
    return plan.level_histogram(given_plan(spark, folder), KEYS)


QUERIES["plan_level_histogram"] = plan_level_histogram
SQL["plan_level_histogram"] = WITH_PLAN + "SELECT project, level_index, count(*) AS rows FROM plan GROUP BY ALL"


def plan_unreleased(spark, folder):
    return plan.unreleased_units(units(spark, folder), given_plan(spark, folder), KEYS)


QUERIES["plan_unreleased"] = plan_unreleased
SQL["plan_unreleased"] = WITH_PLAN + "SELECT project, unit_id FROM units EXCEPT SELECT project, unit_id FROM plan"


def plan_objective(spark, folder):
    """The recomputed objective against one reported with a part of it lost."""
    cells = full_cube(spark, folder)
    given = given_plan(spark, folder)
    reported = plan_rows(spark, folder).where(F.col("phase_index") < 3).groupBy("project").agg(
        F.sum("discounted_usd").alias("objective_usd")
    )
    found = plan.objective_difference(given, cells, reported, KEYS)
    return _rounded(found, ["project"], ["objective_usd", "recomputed_usd", "difference_usd"], 2)


QUERIES["plan_objective"] = plan_objective
SQL["plan_objective"] = WITH_PLAN + """SELECT project, round(sum(discounted) FILTER (phase_index < 3), 2) AS objective_usd, round(sum(discounted), 2) AS recomputed_usd,
  round(sum(discounted) - sum(discounted) FILTER (phase_index < 3), 2) AS difference_usd FROM rows_ GROUP BY project"""


def plan_search(spark, folder):
    rows = plan.enrich(given_plan(spark, folder), units(spark, folder), KEYS)
    return plan.search(rows, "ECO", ["unit_id", "unit_type", "building"], "unit_id").select(
        "project", "unit_id", "phase_index", "level_index", "unit_type", "building", "view"
    )


QUERIES["plan_search"] = plan_search
SQL["plan_search"] = WITH_PLAN + """SELECT plan.project, unit_id, phase_index, level_index, unit_type, building, view FROM plan JOIN units USING (project, unit_id)
WHERE lower(unit_id) LIKE '%eco%' OR lower(unit_type) LIKE '%eco%' OR lower(building) LIKE '%eco%'"""


def plan_floor_grid(spark, folder):
    first = F.min(F.struct("phase_index", "price_ppsf")).alias("p")
    rows = plan_rows(spark, folder).groupBy("project", "unit_id").agg(first).select("project", "unit_id", "p.*")
    # Every eleventh unit has no building, every thirteenth no floor.
    seats = units(spark, folder).withColumns(
        {
            "building": F.when(F.col("unit_number") % 11 != 0, F.col("building")),
            "floor": F.when(F.col("unit_number") % 13 != 0, F.col("floor")),
        }
    )
    found = cube.floor_grid(seats, rows, KEYS)
    return _rounded(found, ["project", "unit_id", "building", "floor", "position"], ["price_ppsf", "min_price", "max_price"], 2)


QUERIES["plan_floor_grid"] = plan_floor_grid
SQL["plan_floor_grid"] = WITH_PLAN + """, seats AS (SELECT project, unit_id, CASE WHEN k % 11 <> 0 THEN building END AS building, CASE WHEN k % 13 <> 0 THEN floor END AS floor FROM units),
first AS (SELECT * FROM rows_ QUALIFY row_number() OVER (PARTITION BY project, unit_id ORDER BY phase_index, price) = 1)
SELECT s.project, s.unit_id, s.building, s.floor, CASE WHEN s.building IS NOT NULL AND s.floor IS NOT NULL THEN
    CAST(row_number() OVER (PARTITION BY s.project, s.building, s.floor ORDER BY s.unit_id) AS INT) END AS position,
  round(price, 2) AS price_ppsf, round(min(price) OVER (PARTITION BY s.project, s.building), 2) AS min_price,
  round(max(price) OVER (PARTITION BY s.project, s.building), 2) AS max_price
FROM seats s LEFT JOIN first f ON s.project = f.project AND s.unit_id = f.unit_id"""


def inv_validation(spark, folder):
    raw = units(spark, folder)
    k = F.col("unit_number")
    messy = raw.select(
        "project", k.alias("row_number"),
        F.when(k % 31 == 0, None).when(k % 37 == 0, F.lit(" 7 ")).otherwise(F.col("unit_id")).alias("unit_id"),
        F.when(k % 17 == 0, "n/a").when(k % 19 == 0, "50").otherwise(F.col("living_area_sqft").cast("int").cast("string")).alias("living_area_sqft"),
        (F.col("floor") - F.lit(2)).cast("string").alias("floor"),
        (k % 15).cast("string").alias("beds"),
        F.when(k % 23 == 0, "9000").otherwise(F.col("cost_basis_ppsf").cast("int").cast("string")).alias("cost_basis_ppsf"),
        F.when(k % 29 == 0, "later").otherwise(F.col("completion_date").cast("date").cast("string")).alias("completion_date"),
        F.when(k % 41 == 0, " ").otherwise(F.col("unit_type")).alias("unit_type"),
        F.when(k % 43 == 0, None).otherwise(F.col("submarket")).alias("submarket"),
    )
    _, errors = inventory.check_inventory(messy, "row_number", KEYS, ["small", "large", "red", "blue"])
    return errors


QUERIES["inv_validation"] = inv_validation
SQL["inv_validation"] = WITH + """, r AS (SELECT project, k AS row_number, CASE WHEN k % 31 = 0 THEN NULL WHEN k % 37 = 0 THEN '7' ELSE unit_id END AS unit_id,
  CASE WHEN k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN 50 ELSE area END AS area, floor - 2 AS f, k % 15 AS beds, CASE WHEN k % 23 = 0 THEN 9000 ELSE cost END AS cost,
  CASE WHEN k % 29 = 0 THEN NULL ELSE 1 END AS done, CASE WHEN k % 41 = 0 THEN NULL ELSE unit_type END AS ty, CASE WHEN k % 43 = 0 THEN NULL ELSE submarket END AS sub FROM units),
d AS (SELECT *, min(row_number) OVER (PARTITION BY project, unit_id) AS first FROM r)
SELECT project, row_number, unit_id, 'unit_id' AS field, 'missing' AS message FROM d WHERE unit_id IS NULL
UNION ALL SELECT project, row_number, unit_id, 'unit_id', concat('duplicate of row ', first) FROM d WHERE unit_id IS NOT NULL AND first < row_number
UNION ALL SELECT project, row_number, unit_id, 'living_area_sqft', CASE WHEN area IS NULL THEN 'missing or not a number' ELSE 'outside 200-20000' END FROM d WHERE area IS NULL OR area NOT BETWEEN 200 AND 20000
UNION ALL SELECT project, row_number, unit_id, 'floor', 'outside 1-150' FROM d WHERE f NOT BETWEEN 1 AND 150
UNION ALL SELECT project, row_number, unit_id, 'beds', 'outside 0-12' FROM d WHERE beds > 12
UNION ALL SELECT project, row_number, unit_id, 'cost_basis_ppsf', 'outside 50-5000' FROM d WHERE cost > 5000
UNION ALL SELECT project, row_number, unit_id, 'completion_date', 'missing or not a date' FROM d WHERE done IS NULL
UNION ALL SELECT project, row_number, unit_id, 'unit_type', 'missing' FROM d WHERE ty IS NULL
UNION ALL SELECT project, row_number, unit_id, 'submarket', CASE WHEN sub IS NULL THEN 'missing' ELSE 'not a known submarket' END FROM d WHERE sub IS NULL OR sub NOT IN ('small', 'large', 'red', 'blue')"""


def inv_scoring_view(spark, folder):
    rows = units(spark, folder).withColumns(
        {"baths": (F.col("unit_number") % 7) / 2, "hoa_monthly": F.col("living_area_sqft") * 0.9}
    )
    found = inventory.scoring_view(rows, {"ring": "view_ring", "widget": "view_widget"})
    return found.select(
        "project", "unit_id", "baths_full", "baths_half", "view_ring", "view_widget", "is_new_construction",
        *[F.round(c, 8).alias(c) for c in ("log_floor", "log_living_area", "hoa_per_sqft")],
    )


QUERIES["inv_scoring_view"] = inv_scoring_view
SQL["inv_scoring_view"] = WITH + """SELECT project, unit_id, CAST(floor(k % 7 / 2.0) AS DOUBLE) AS baths_full, CAST((k % 7) % 2 AS DOUBLE) AS baths_half, CAST(view = 'ring' AS DOUBLE) AS view_ring,
  CAST(view = 'widget' AS DOUBLE) AS view_widget, TRUE AS is_new_construction, round(ln(floor + 1), 8) AS log_floor, round(ln(area), 8) AS log_living_area, round(0.9::DOUBLE, 8) AS hoa_per_sqft FROM units"""


def set_uncovered(spark, folder):
    known = comps(spark, folder).where(F.length("submarket") > 4)
    return ladder.uncovered_submarkets(units(spark, folder), known)


QUERIES["set_uncovered"] = set_uncovered
SQL["set_uncovered"] = WITH + "SELECT DISTINCT submarket FROM units WHERE length(submarket) <= 4"


# ---- scenarios ------------------------------------------------------------


def draws(spark, folder):
    c = F.col("c_custkey")
    return S.tables(spark, folder, "customer")["customer"].select(
        F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string")).alias("project"),
        c.alias("draw_id"),
        (BETA + (F.col("c_acctbal") / 10000 - 0.45) * 0.5).alias("beta_price"),
        ((c % 21 - 10) / 50).alias("absorption"),
        (c % 7 - 3).cast("double").alias("competing_listings"),
        ((c % 11 - 5) / 100).alias("comps_drift"),
        F.greatest(F.lit(0.0), (c % 9 - 4) * 3.0).alias("completion_delay_months"),
    )


def _dealt(draw, unit):
    """The sum of two remainders of 10,007, as a share of it."""
    total = draw + unit
    total -= 10007.0 * (total >= 10007.0)
    return total / 10007.0


def _lottery():
    draw, unit = F.col("draw_id") * 7919, F.col("unit_id").cast("bigint") * 104729
    return scenario.Lottery(F.pmod(draw, F.lit(10007)), F.pmod(unit, F.lit(10007)), _dealt, F.pmod(draw + unit, F.lit(10007)) / 10007.0)


def scenario_rows(spark, folder):
    """Plan rows beside the same unit and phase at the level nearest its comparables."""
    cells = full_cube(spark, folder)
    rows = plan.plan_cells(given_plan(spark, folder), cells, KEYS)
    steps, _ = ladder.price_ladder(units(spark, folder), KEYS)
    nearest = ladder.nearest_levels(steps, KEYS)
    base = cells.join(nearest, [*KEYS, "unit_id", "level_index"]).select(
        *KEYS, "unit_id", "phase_index", F.col("price_ppsf").alias("base_price_ppsf"),
        F.col("probability").alias("base_probability"), F.col("rel_price_premium").alias("base_premium"),
    )
    return rows.join(base, [*KEYS, "unit_id", "phase_index"], "left")


DRAWS = PLAN + """,
draws AS (SELECT concat('Brand#', c_nationkey + 1) AS project, c_custkey AS draw_id, -1.6 + (c_acctbal / 10000 - 0.45) * 0.5 AS b, (c_custkey % 21 - 10) / 50.0 AS ab,
  CAST(c_custkey % 7 - 3 AS DOUBLE) AS inv, (c_custkey % 11 - 5) / 100.0 AS drift, greatest(0.0, (c_custkey % 9 - 4) * 3.0) AS delay FROM customer),
near_ AS (SELECT project, unit_id, level_index FROM ladder QUALIFY row_number() OVER (PARTITION BY project, unit_id ORDER BY abs(price - predicted), level_index) = 1),
base AS (SELECT c.project, c.unit_id, phase_index, c.price AS bprice, c.p AS bp, c.premium AS bx FROM cube c JOIN near_ USING (project, unit_id, level_index)),
pairs AS (SELECT r.project, r.unit_id, r.phase_index, draw_id, price * area AS gross, price * area * discount AS net, bprice * area * discount AS bnet,
    CASE WHEN delay <= slack THEN 1 - pow(1 - p, exp(b * ((1 + premium) / (1 + drift) - 1) + 1.6 * premium - 0.01 * inv + ab)) ELSE 0 END AS q,
    CASE WHEN delay <= slack THEN 1 - pow(1 - bp, exp(b * ((1 + bx) / (1 + drift) - 1) + 1.6 * bx - 0.01 * inv + ab)) ELSE 0 END AS bq,
    ((draw_id * 7919 + r.k * 104729) % 10007) / 10007.0 AS u
  FROM rows_ r JOIN base USING (project, unit_id, phase_index) JOIN draws d ON r.project = d.project),
revenue AS (SELECT project, draw_id, sum(q * gross) AS en, sum(q * net) AS ed, sum(CASE WHEN u < q THEN gross ELSE 0 END) AS rn, sum(CASE WHEN u < q THEN net ELSE 0 END) AS rd,
    sum(CASE WHEN u < bq THEN bnet ELSE 0 END) AS bd FROM pairs GROUP BY ALL)"""
WITH_DRAWS = f"WITH {DRAWS}\n"


def revenue(spark, folder, by=()):
    return scenario.scenario_revenue(
        scenario_rows(spark, folder), draws(spark, folder), KEYS, BETA, BETA_INVENTORY, _lottery(), True, list(by)
    )


_MEASURES = [
    "expected_nominal_usd", "expected_discounted_usd", "realized_nominal_usd", "realized_discounted_usd", "baseline_discounted_usd",
]


def scn_revenue(spark, folder):
    return _rounded(revenue(spark, folder), ["project", "draw_id"], _MEASURES, 1)


QUERIES["scn_revenue"] = scn_revenue
SQL["scn_revenue"] = WITH_DRAWS + """SELECT project, draw_id, round(en, 1) AS expected_nominal_usd, round(ed, 1) AS expected_discounted_usd, round(rn, 1) AS realized_nominal_usd,
  round(rd, 1) AS realized_discounted_usd, round(bd, 1) AS baseline_discounted_usd FROM revenue"""


def scn_summary(spark, folder):
    found = scenario.summarize(land(revenue(spark, folder), "revenue"), KEYS, "realized_discounted_usd")
    return _rounded(found, ["project", "draws"], ["mean", "sd", "p5", "p25", "p50", "p75", "p95", "minimum", "maximum", "cvar5"], 1)


QUERIES["scn_summary"] = scn_summary
SQL["scn_summary"] = WITH_DRAWS + """, q AS (SELECT project, quantile_cont(rd, 0.05) AS p5 FROM revenue GROUP BY project)
SELECT project, count(*) AS draws, round(avg(rd), 1) AS mean, round(stddev_samp(rd), 1) AS sd, round(any_value(p5), 1) AS p5, round(quantile_cont(rd, 0.25), 1) AS p25, round(quantile_cont(rd, 0.5), 1) AS p50,
  round(quantile_cont(rd, 0.75), 1) AS p75, round(quantile_cont(rd, 0.95), 1) AS p95, round(min(rd), 1) AS minimum, round(max(rd), 1) AS maximum, round(avg(rd) FILTER (rd <= p5), 1) AS cvar5
FROM revenue JOIN q USING (project) GROUP BY project"""


def scn_variance(spark, folder):
    found = scenario.variance_shares(revenue(spark, folder), KEYS, "realized_discounted_usd", "expected_discounted_usd")
    return _rounded(found, ["project"], ["parameter_share", "idiosyncratic_share", "total_sd_usd"])


QUERIES["scn_variance"] = scn_variance
SQL["scn_variance"] = WITH_DRAWS + """SELECT project, round(least(1, var_samp(ed) / var_samp(rd)), 4) AS parameter_share, round(greatest(0, 1 - var_samp(ed) / var_samp(rd)), 4) AS idiosyncratic_share,
  round(stddev_samp(rd), 4) AS total_sd_usd FROM revenue GROUP BY project"""


def scn_breaches(spark, folder):
    by_phase = land(revenue(spark, folder, ["phase_index"]), "revenue")
    floors = phases(spark, folder).withColumn("cash_flow_floor_usd", F.col("cash_flow_floor_usd") * 5)
    found = scenario.phase_breaches(by_phase, floors, KEYS)
    money = ["floor_usd", "expected_usd", "p5_usd", "buffered_floor_usd"]
    return _rounded(found.withColumn("breach_probability", F.round("breach_probability", 6)), ["project", "phase_index", "is_alarming", "breach_probability"], money, 2)


QUERIES["scn_breaches"] = scn_breaches
SQL["scn_breaches"] = WITH_DRAWS + """, r AS (SELECT project, phase_index, draw_id, sum(CASE WHEN u < q THEN gross ELSE 0 END) AS rn FROM pairs GROUP BY ALL),
s AS (SELECT p.project, p.phase_index, any_value(cash) * 5 AS f, coalesce(avg(rn), 0) AS e, coalesce(quantile_cont(rn, 0.05), 0) AS p5, coalesce(avg(CAST(rn < cash * 5 AS INT)), 1) AS br
  FROM phases p LEFT JOIN r USING (project, phase_index) GROUP BY 1, 2)
SELECT project, phase_index, br > 0.05 AS is_alarming, round(f, 2) AS floor_usd, round(e, 2) AS expected_usd, round(p5, 2) AS p5_usd, round(br, 6) AS breach_probability,
  round(CASE WHEN p5 > 0 AND p5 < f THEN f * f / p5 END, 2) AS buffered_floor_usd FROM s"""


def scn_uplift(spark, folder):
    gap, won = scenario.paired_uplift(land(revenue(spark, folder), "revenue"), KEYS)
    medians = scenario.summarize(gap, KEYS, "uplift_usd").select("project", "p50", "mean")
    return _rounded(won.join(medians, "project"), ["project", "draws"], ["share_won", "p50", "mean"], 2)


QUERIES["scn_uplift"] = scn_uplift
SQL["scn_uplift"] = WITH_DRAWS + """SELECT project, count(*) AS draws, round(avg(CAST(rd > bd AS INT)), 2) AS share_won, round(quantile_cont(rd - bd, 0.5), 2) AS p50, round(avg(rd - bd), 2) AS mean FROM revenue GROUP BY project"""


def sigmas(spark, folder):
    nation = S.tables(spark, folder, "nation")["nation"]
    scale = 1 + F.col("n_nationkey") % 4
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("channel"), (F.lit(s) * scale).alias("sigma"))
            for c, s in (("beta_price", 0.03), ("absorption", 0.15), ("competing_listings", 2.0), ("comps_drift", 0.03), ("completion_delay_months", 2.0))
        ]
    )
    project = F.concat(F.lit("Brand#"), (F.col("n_nationkey") + 1).cast("string"))
    return nation.select(project.alias("project"), F.inline(cells))


def scn_tornado(spark, folder):
    rows = plan.plan_cells(given_plan(spark, folder), full_cube(spark, folder), KEYS)
    found = scenario.tornado(rows, sigmas(spark, folder), KEYS, BETA, BETA_INVENTORY)
    return _rounded(found, ["project", "channel", "fitted"], ["low_value", "high_value", "low_delta_usd", "high_delta_usd", "swing_usd", "baseline_usd"], 2)


QUERIES["scn_tornado"] = scn_tornado
SQL["scn_tornado"] = WITH_PLAN + """, sg AS (SELECT concat('Brand#', n_nationkey + 1) AS project, channel, s * (1 + n_nationkey % 4) AS sigma FROM nation,
  (VALUES ('beta_price', 0.03), ('absorption', 0.15), ('competing_listings', 2.0), ('comps_drift', 0.03), ('completion_delay_months', 2.0)) t(channel, s)),
d AS (SELECT project, channel, side, CASE WHEN channel = 'beta_price' THEN -1.6 + side * sigma WHEN channel = 'completion_delay_months' THEN greatest(0, side * sigma) ELSE side * sigma END AS v
  FROM sg, (VALUES (-1), (1)) t(side) UNION ALL SELECT DISTINCT project, 'baseline', 0, 0 FROM sg),
e AS (SELECT d.project, channel, side, any_value(v) AS v, sum(CASE WHEN (CASE WHEN channel = 'completion_delay_months' THEN v ELSE 0 END) <= slack THEN
    (1 - pow(1 - p, exp((CASE WHEN channel = 'beta_price' THEN v ELSE -1.6 END) * ((1 + premium) / (1 + CASE WHEN channel = 'comps_drift' THEN v ELSE 0 END) - 1) + 1.6 * premium
      - 0.01 * (CASE WHEN channel = 'competing_listings' THEN v ELSE 0 END) + (CASE WHEN channel = 'absorption' THEN v ELSE 0 END)))) * price * area * discount ELSE 0 END) AS r
  FROM rows_ r JOIN d ON r.project = d.project GROUP BY 1, 2, 3)
SELECT l.project, l.channel, l.channel = 'beta_price' AS fitted, round(l.v, 2) AS low_value, round(h.v, 2) AS high_value, round(l.r - b.r, 2) AS low_delta_usd, round(h.r - b.r, 2) AS high_delta_usd,
  round(abs(h.r - l.r), 2) AS swing_usd, round(b.r, 2) AS baseline_usd
FROM e l JOIN e h ON l.project = h.project AND l.channel = h.channel AND l.side = -1 AND h.side = 1 JOIN e b ON b.project = l.project AND b.channel = 'baseline'"""


def scn_stability(spark, folder):
    cells = full_cube(spark, folder)
    base = plan.plan_cells(given_plan(spark, folder), cells, KEYS).dropDuplicates([*KEYS, "unit_id", "phase_index"])
    base = base.where((F.col("phase_index") < 3) | (F.col("unit_number") % 97 != 0))
    found = scenario.plan_stability(base, cube.best_cells(cells, KEYS), KEYS)
    return _rounded(found, ["project", "matched"], ["same_phase_share", "same_level_share", "mean_level_shift", "regret_usd"], 2)


QUERIES["scn_stability"] = scn_stability
SQL["scn_stability"] = WITH_PLAN + """, o AS (SELECT * FROM cube WHERE releasable QUALIFY row_number() OVER (PARTITION BY project, unit_id ORDER BY discounted DESC, phase_index, level_index) = 1)
SELECT r.project, count(*) AS matched, round(avg(CAST(r.phase_index = o.phase_index AS INT)), 2) AS same_phase_share, round(avg(CAST(r.level_index = o.level_index AS INT)), 2) AS same_level_share,
  round(avg(abs(r.level_index - o.level_index)), 2) AS mean_level_shift, round(sum(o.discounted - r.discounted), 2) AS regret_usd
FROM rows_ r JOIN o USING (project, unit_id) WHERE r.phase_index < 3 OR r.k % 97 <> 0 GROUP BY r.project"""


def scn_cube(spark, folder):
    """Whole cubes under all draws of their project."""
    found = scenario.scenario_cube(full_cube(spark, folder), draws(spark, folder), KEYS, BETA, BETA_INVENTORY, ["phase_index"])
    return found.select("project", "phase_index", "cells", "open_cells", F.round(F.col("discounted_usd") / 1000, 1).alias("discounted_kusd"))


QUERIES["scn_cube"] = scn_cube
SQL["scn_cube"] = WITH_DRAWS + """SELECT c.project, phase_index, count(*) AS cells, count(*) FILTER (releasable AND delay <= slack) AS open_cells,
  round(sum(CASE WHEN delay > 0 AND NOT (releasable AND delay <= slack) THEN 0 ELSE (1 - pow(1 - p, exp(b * ((1 + premium) / (1 + drift) - 1) + 1.6 * premium - 0.01 * inv + ab))) * price * area * discount END) / 1000, 1) AS discounted_kusd
FROM cube c JOIN draws d ON c.project = d.project GROUP BY 1, 2"""


def scn_correlations(spark, folder):
    found = scenario.channel_correlations(draws(spark, folder), KEYS)
    return _rounded(found, ["project", "pair"], ["rho"], 6)


QUERIES["scn_correlations"] = scn_correlations
SQL["scn_correlations"] = WITH_DRAWS + " UNION ALL ".join(
    f"SELECT project, '{a}|{b}' AS pair, round(corr({x}, {y}), 6) AS rho FROM draws GROUP BY project HAVING stddev_pop({x}) > 0 AND stddev_pop({y}) > 0"
    for i, (a, x) in enumerate((("beta_price", "b"), ("absorption", "ab"), ("competing_listings", "inv"), ("comps_drift", "drift"), ("completion_delay_months", "delay")))
    for b, y in (("beta_price", "b"), ("absorption", "ab"), ("competing_listings", "inv"), ("comps_drift", "drift"), ("completion_delay_months", "delay"))[i + 1 :]
)


def scn_sigma_resolution(spark, folder):
    derived = sigmas(spark, folder).withColumn("source", F.lit("series"))
    custom = derived.where((F.col("channel") == "absorption") & F.col("project").endswith("3")).select(
        "project", "channel", (F.col("sigma") * 2).alias("sigma")
    )
    found = scenario.resolve_sigmas(derived, custom, KEYS, False)
    return _rounded(found, ["project", "channel", "source"], ["sigma"], 6)


QUERIES["scn_sigma_resolution"] = scn_sigma_resolution
SQL["scn_sigma_resolution"] = """WITH sg AS (SELECT concat('Brand#', n_nationkey + 1) AS project, channel, s * (1 + n_nationkey % 4) AS sigma FROM nation,
  (VALUES ('beta_price', 0.03), ('absorption', 0.15), ('competing_listings', 2.0), ('comps_drift', 0.03), ('completion_delay_months', 2.0)) t(channel, s))
SELECT project, channel, CASE WHEN channel = 'absorption' AND project LIKE '%3' THEN 'custom' WHEN channel = 'competing_listings' THEN 'disabled' ELSE 'series' END AS source,
  round(CASE WHEN channel = 'absorption' AND project LIKE '%3' THEN sigma * 2 WHEN channel = 'competing_listings' THEN 0 ELSE sigma END, 6) AS sigma FROM sg"""


def scn_competing_baseline(spark, folder):
    rows = phases(spark, folder).withColumn(
        "competing_listings", F.when(~F.col("project").endswith("4"), F.col("competing_listings"))
    )
    return scenario.competing_baseline(rows, KEYS)


QUERIES["scn_competing_baseline"] = scn_competing_baseline
SQL["scn_competing_baseline"] = WITH + "SELECT project, CAST(CASE WHEN project LIKE '%4' THEN 30 ELSE median(competing) END AS DOUBLE) AS baseline FROM phases GROUP BY project"
