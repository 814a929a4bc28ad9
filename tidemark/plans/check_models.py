"""Checked queries: macro series, payloads, and fits over the table."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.operators import absorb, audit, bootstrap, concordance, design, diagnostics, features, hedonic, logit, macro, survival
from tidemark.plans import fit_demand
from tidemark.operators.gram import condition_number, explained_share, gram, gram_table, least_squares
from tidemark.plans import stand_ins as S
from tidemark.plans.check_features import LINES, lines
from tidemark.session import land
from tidemark.sources import payloads
from tidemark.sources.reports import fingerprint

QUERIES = {}
SQL = {}

# ---- macro series: largest order value per month, one role per priority ---------

ROLES = {
    "1-URGENT": "home_price_index", "2-HIGH": "median_days_on_market", "3-MEDIUM": "active_listings",
    "4-NOT SPECIFIED": "mortgage_rate", "5-LOW": "area_cpi",
}
MARKET = ["market"]


def series(spark, folder):
    """Monthly maxima of order values; every seventh month of a role is a gap."""
    orders = S.tables(spark, folder, "orders")["orders"]
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    means = orders.groupBy(
        (F.col("o_custkey") % 4).alias("market"), names[F.col("o_orderpriority")].alias("role"), month.alias("date")
    ).agg(F.max("o_totalprice").alias("value"))
    gap = (F.month("date") + 3 * F.year("date") + F.length("role")) % 7 == 0
    return means.withColumn("value", F.when(~gap, F.col("value")))


SERIES = f"""s AS (SELECT *, CASE WHEN (month(date) + 3 * year(date) + length(role)) % 7 <> 0 THEN v END AS value FROM (
  SELECT o_custkey % 4 AS market, CASE o_orderpriority {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLES.items())} END AS role,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS date, max(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3)),
f AS (SELECT *, ln(value) - ln(lag(value) OVER (PARTITION BY market, role ORDER BY date)) AS step FROM s WHERE value IS NOT NULL),
a AS (SELECT * FROM (SELECT *, ln(value) - ln(lag(value) OVER (PARTITION BY market, role ORDER BY date)) AS step FROM s) WHERE step IS NOT NULL)"""
WITH = f"WITH {SERIES}\n"


def mac_dispersion(spark, folder):
    found = macro.dispersions(series(spark, folder), ["market", "role"], 180)
    return found.withColumn("sigma", F.round("sigma", 8))


QUERIES["mac_dispersion"] = mac_dispersion
SQL["mac_dispersion"] = WITH + """, g AS (SELECT market, role, date - lag(date) OVER (PARTITION BY market, role ORDER BY date) AS gap FROM s),
p AS (SELECT market, role, least(greatest(round(365.25 / median(gap)), 1), 365) AS ppy FROM g GROUP BY ALL)
SELECT market, role, round(coalesce(stddev_samp(step) * sqrt(any_value(ppy) * 180 / 365.25), 0), 8) AS sigma FROM p LEFT JOIN f USING (market, role) GROUP BY ALL"""

_AT = ["home_price_index", "median_days_on_market", "active_listings"]


def mac_correlations(spark, folder):
    aligned = macro.aligned_innovations(series(spark, folder), MARKET, _AT, {"median_days_on_market": -1.0})
    found = macro.correlations(aligned, MARKET, _AT)
    return found.withColumn("rho", F.round("rho", 8))


QUERIES["mac_correlations"] = mac_correlations
SQL["mac_correlations"] = WITH + """, w AS (SELECT market, date, max(step) FILTER (role = 'home_price_index') AS h, -max(step) FILTER (role = 'median_days_on_market') AS d,
  max(step) FILTER (role = 'active_listings') AS l FROM a GROUP BY ALL HAVING h IS NOT NULL AND d IS NOT NULL AND l IS NOT NULL)
SELECT market, count(*) AS n, 'home_price_index' AS a, 'median_days_on_market' AS b, round(corr(h, d), 8) AS rho FROM w GROUP BY market
UNION ALL SELECT market, count(*), 'home_price_index', 'active_listings', round(corr(h, l), 8) FROM w GROUP BY market
UNION ALL SELECT market, count(*), 'median_days_on_market', 'active_listings', round(corr(d, l), 8) FROM w GROUP BY market"""


def mac_correlation_set(spark, folder):
    rows = series(spark, folder)
    names = ["comps_drift", "absorption"]
    renamed = rows.withColumn(
        "role", F.when(F.col("role") == "home_price_index", "comps_drift").when(F.col("role") == "median_days_on_market", "absorption")
    ).where(F.col("role").isNotNull())
    found = macro.correlations(macro.aligned_innovations(renamed, MARKET, names), MARKET, names)
    return macro.correlation_set(found, rows, MARKET).withColumn("rho", F.round("rho", 8))


QUERIES["mac_correlation_set"] = mac_correlation_set
SQL["mac_correlation_set"] = WITH + """, w AS (SELECT market, date, max(step) FILTER (role = 'home_price_index') AS h, max(step) FILTER (role = 'median_days_on_market') AS d FROM a GROUP BY ALL HAVING h IS NOT NULL AND d IS NOT NULL)
SELECT market, 'comps_drift' AS a, 'absorption' AS b, round(corr(h, d), 8) AS rho, 'data' AS source FROM w GROUP BY market
UNION ALL SELECT m.market, x.a, x.b, x.rho, x.source FROM (SELECT DISTINCT market FROM s) m, (VALUES ('absorption', 'competing_listings', -0.4, 'prior'),
  ('beta_price', 'absorption', 0.5, 'fixed'), ('beta_price', 'competing_listings', -0.3, 'fixed'), ('beta_price', 'comps_drift', 0.2, 'fixed')) x(a, b, rho, source)"""


def mac_context(spark, folder):
    rows = series(spark, folder).withColumn(
        "role", F.when((F.col("role") == "active_listings"), "unemployment_rate").otherwise(F.col("role"))
    )
    found = macro.context(rows, MARKET)
    return found.select("market", *[F.round(c, 8).alias(c) for c in found.columns if c != "market"])


QUERIES["mac_context"] = mac_context
SQL["mac_context"] = WITH + """, r AS (SELECT market, role, value, row_number() OVER (PARTITION BY market, role ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY market, role) AS n FROM s WHERE value IS NOT NULL),
w AS (SELECT market, role, any_value(n) AS n, max(value) FILTER (k = 1) AS v1, max(value) FILTER (k = 12) AS v12, max(value) FILTER (k = 13) AS v13, max(value) FILTER (k = 52) AS v52 FROM r GROUP BY ALL)
SELECT market, round(max(ln(v1) - ln(v13)) FILTER (role = 'home_price_index'), 8) AS appreciation_nominal, round(max(ln(v1) - ln(v13)) FILTER (role = 'area_cpi'), 8) AS inflation,
  round(max(v1) FILTER (role = 'mortgage_rate'), 8) AS mortgage_rate, round(max(CASE WHEN n >= 53 THEN v1 - v52 END) FILTER (role = 'mortgage_rate'), 8) AS mortgage_rate_change,
  round(max(v1) FILTER (role = 'active_listings'), 8) AS unemployment, round(max(CASE WHEN n >= 13 THEN v1 - v12 END) FILTER (role = 'active_listings'), 8) AS unemployment_change,
  round(max(ln(v1) - ln(v13)) FILTER (role = 'home_price_index') - max(ln(v1) - ln(v13)) FILTER (role = 'area_cpi'), 8) AS appreciation_real FROM w GROUP BY market"""


def mac_snapshot(spark, folder):
    rows = series(spark, folder).where((F.col("market") != 2) | (F.col("role") != "active_listings"))
    return macro.snapshot(rows, MARKET, 180).withColumn("sigma", F.round("sigma", 6))


QUERIES["mac_snapshot"] = mac_snapshot
SQL["mac_snapshot"] = WITH + """, d AS (SELECT market, role, stddev_samp(step) * sqrt(12 * 180 / 365.25) AS x FROM f GROUP BY ALL)
SELECT market, c AS channel, round(CASE WHEN market = 2 THEN fb ELSE x * CASE WHEN c = 'competing_listings' THEN 30 ELSE 1 END END, 6) AS sigma, CASE WHEN market = 2 THEN 'static_fallback' ELSE 'series' END AS source
FROM d JOIN (VALUES ('comps_drift', 'home_price_index', 0.03), ('absorption', 'median_days_on_market', 0.15), ('competing_listings', 'active_listings', 0.0)) t(c, r, fb) ON role = r"""


def src_dated_payload(spark, folder):
    s = series(spark, folder).withColumn("text", F.coalesce(F.col("value").cast("decimal(12,2)").cast("string"), F.lit(".")))
    obs = F.struct(F.col("date").cast("string").alias("date"), F.col("text").alias("value"))
    # One payload per series, as a service answers it.
    packed = s.groupBy("market", "role").agg(F.to_json(F.struct(F.collect_list(obs).alias("observations"))).alias("payload"))
    return payloads.dated_observations(packed, "payload", ["market", "role"])


QUERIES["src_dated_payload"] = src_dated_payload
SQL["src_dated_payload"] = WITH + "SELECT market, role, date, value FROM s"


def src_period_payload(spark, folder):
    s = series(spark, folder)
    code = F.when(F.month("date") == 12, "M13").when(F.month("date") == 6, "S02").otherwise(F.date_format("date", "'M'MM"))
    row = F.struct(
        F.year("date").cast("string").alias("year"), code.alias("period"), F.col("value").cast("decimal(12,2)").cast("string").alias("value")
    )
    data = s.groupBy("market", "role").agg(F.collect_list(row).alias("data"))
    answer = F.struct(
        F.when(F.col("market") == 3, "REQUEST_FAILED").otherwise("REQUEST_SUCCEEDED").alias("status"),
        F.struct(F.array(F.struct(F.col("role").alias("seriesID"), "data")).alias("series")).alias("Results"),
    )
    return payloads.period_observations(data.select("market", F.to_json(answer).alias("payload")), "payload", ["market"])


QUERIES["src_period_payload"] = src_period_payload
SQL["src_period_payload"] = WITH + """SELECT market, role AS series_id, CASE WHEN month(date) = 6 THEN make_date(year(date), 7, 1) ELSE date END AS date, value
FROM s WHERE market <> 3 AND month(date) <> 12"""

# ---- fits -------------------------------------------------------------------


def spells(spark, folder):
    """Order lines as spells: days from order to shipment, returned means sold."""
    found = S.tables(spark, folder, "orders")["orders"].select(
        F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_totalprice"
    )
    rows = lines(spark, folder).join(found, "l_orderkey")
    days = F.date_diff("l_shipdate", "o_orderdate").cast("double")
    return rows.withColumns(
        {
            "duration_days": days,
            "event_sold": (F.col("l_returnflag") == "R").cast("int"),
            "log_price": F.log("ppsf"),
            "rel_price_premium": F.col("l_tax") - F.col("l_discount") * 2,
            "size": F.col("p_size").cast("double"),
            "late": (F.col("l_linestatus") == "O").cast("double"),
        }
    ).where((F.col("duration_days") > 0) & (F.col("duration_days") <= 1095))


SPELLS = LINES + """,
spells AS (SELECT * FROM (SELECT lines.*, CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS DOUBLE) AS duration_days, CAST(l_returnflag = 'R' AS INT) AS event_sold, ln(ppsf) AS log_price,
    l_tax - l_discount * 2 AS rel_price_premium, CAST(p_size AS DOUBLE) AS size, CAST(l_linestatus = 'O' AS DOUBLE) AS late, o_totalprice
  FROM lines JOIN orders ON l_orderkey = o_orderkey) WHERE duration_days BETWEEN 1 AND 1095)"""
WITH_SPELLS = f"WITH {SPELLS}\n"


def reg_gram(spark, folder):
    rows = spells(spark, folder)
    found = gram_table(rows, gram(rows, ["size", "rel_price_premium", "log_price"]))
    return found.withColumn("value", F.round("value", 4))


_G = {"const": "1", "size": "size", "rel_price_premium": "rel_price_premium", "log_price": "log_price"}
QUERIES["reg_gram"] = reg_gram
SQL["reg_gram"] = WITH_SPELLS + " UNION ALL ".join(
    f"SELECT '{a}' AS \"row\", '{b}' AS \"column\", round(sum(CAST({x} AS DOUBLE) * {y}), 4) AS value FROM spells" for a, x in _G.items() for b, y in _G.items()
)


def reg_least_squares(spark, folder):
    """Log price on two covariates, solved in closed form on the other side."""
    rows = spells(spark, folder)
    fit = least_squares(gram(rows, ["size", "rel_price_premium", "log_price"]), "log_price", ["size", "rel_price_premium"])
    pairs = [*zip(fit.names, fit.values.tolist()), ("r_squared", fit.r_squared)]
    table = spark.createDataFrame([(n, float(v)) for n, v in pairs], "name string, value double")
    return table.withColumn("value", F.round("value", 7))


QUERIES["reg_least_squares"] = reg_least_squares
SQL["reg_least_squares"] = WITH_SPELLS + """, m AS (SELECT avg(size) AS a, avg(rel_price_premium) AS b, avg(log_price) AS c, var_pop(size) AS aa, var_pop(rel_price_premium) AS bb, var_pop(log_price) AS cc,
  covar_pop(size, rel_price_premium) AS ab, covar_pop(size, log_price) AS ac, covar_pop(rel_price_premium, log_price) AS bc FROM spells),
k AS (SELECT *, (ac * bb - bc * ab) / (aa * bb - ab * ab) AS s, (bc * aa - ac * ab) / (aa * bb - ab * ab) AS t FROM m)
SELECT 'const' AS name, round(c - s * a - t * b, 7) AS value FROM k UNION ALL SELECT 'size', round(s, 7) FROM k UNION ALL SELECT 'rel_price_premium', round(t, 7) FROM k
UNION ALL SELECT 'r_squared', round((s * ac + t * bc) / cc, 7) FROM k"""


def reg_hedonic_premium(spark, folder):
    """A surface with one category is its level means: the residual is known."""
    rows = lines(spark, folder).withColumnsRenamed({"ppsf": "list_ppsf", "p_type": "submarket"})
    model = hedonic.fit_premium(rows, numeric=[], categorical=["submarket"])
    scored = rows.withColumns(model.columns("list_ppsf"))
    return scored.groupBy("submarket").agg(
        F.round(F.avg("hedonic_reference_ppsf"), 6).alias("reference"), F.round(F.max("hedonic_price_premium"), 7).alias("top"),
        F.round(F.stddev_samp("hedonic_price_premium"), 7).alias("sd"),
    )


QUERIES["reg_hedonic_premium"] = reg_hedonic_premium
SQL["reg_hedonic_premium"] = f"""WITH {LINES} SELECT p_type AS submarket, round(exp(avg(ln(ppsf))), 6) AS reference, round(max(ln(ppsf)) - avg(ln(ppsf)), 7) AS top,
  round(stddev_samp(ln(ppsf)), 7) AS sd FROM lines GROUP BY 1"""


def reg_design(spark, folder):
    """Listwise deletion, rare levels, constants and dependent columns."""
    rows = spells(spark, folder).withColumns(
        {
            "gappy": F.when(F.col("l_linenumber") != 4, F.col("size")),
            "twice": F.col("size") * 2, "flat": F.lit(3.0),
            "kind": F.when((F.col("l_partkey") == 5), "only").otherwise(F.col("p_type")),
        }
    )
    made, _ = design.learn_design(rows, ["gappy", "rel_price_premium", "flat", "late", "kind"], ["kind"], min_level=1000)
    table = made.summary(spark)
    return table.select("name", "binary", F.round("scale", 7).alias("scale"), F.round("mean", 7).alias("mean"))


QUERIES["reg_design"] = reg_design
SQL["reg_design"] = WITH_SPELLS + """, r AS (SELECT *, CASE WHEN l_linenumber <> 4 THEN size END AS gappy, CASE WHEN l_partkey = 5 THEN 'only' ELSE p_type END AS kind FROM spells),
used AS (SELECT * FROM r WHERE gappy IS NOT NULL AND rel_price_premium IS NOT NULL AND late IS NOT NULL),
x AS (SELECT u.*, CASE WHEN n >= 1000 THEN u.kind ELSE '__rare__' END AS level FROM used u JOIN (SELECT kind, count(*) AS n FROM used GROUP BY kind) c USING (kind)),
levels AS (SELECT DISTINCT level AS shown FROM x ORDER BY shown OFFSET 1)
SELECT 'gappy' AS name, FALSE AS "binary", round(stddev_pop(gappy), 7) AS scale, round(avg(gappy), 7) AS mean FROM used
UNION ALL SELECT 'rel_price_premium', FALSE, round(stddev_pop(rel_price_premium), 7), round(avg(rel_price_premium), 7) FROM used
UNION ALL SELECT 'late', TRUE, round(stddev_pop(late), 7), round(avg(late), 7) FROM used
UNION ALL SELECT concat('kind=', shown), TRUE, round(stddev_pop(CAST(level = shown AS INT)), 7), round(avg(CAST(level = shown AS INT)), 7) FROM x, levels GROUP BY shown"""


def reg_horizon_label(spark, folder):
    return logit.horizon_counts(spells(spark, folder), 180, ["p_brand"])


QUERIES["reg_horizon_label"] = reg_horizon_label
SQL["reg_horizon_label"] = WITH_SPELLS + """SELECT p_brand, count(*) FILTER (event_sold = 1 AND duration_days <= 180) AS sold_by_horizon,
  count(*) FILTER (duration_days >= 180 AND NOT (event_sold = 1 AND duration_days <= 180)) AS survived_horizon,
  count(*) FILTER (event_sold = 0 AND duration_days < 180) AS unknown_at_horizon FROM spells GROUP BY p_brand"""


def reg_logit(spark, folder):
    """A logit on one 0/1 covariate is a log odds ratio."""
    fit = logit.fit_logit(spells(spark, folder), ["late"], 180, [], held_out=False).fit
    table = fit.tables(spark)["coefficients"]
    return table.select("name", F.round("value", 5).alias("value"), F.round("std_error", 5).alias("std_error"))


QUERIES["reg_logit"] = reg_logit
SQL["reg_logit"] = WITH_SPELLS + """, t AS (SELECT late, CAST(event_sold = 1 AND duration_days <= 180 AS INT) AS y FROM spells WHERE (event_sold = 1 AND duration_days <= 180) OR duration_days >= 180),
c AS (SELECT CAST(count(*) FILTER (late = 1 AND y = 1) AS DOUBLE) AS a, CAST(count(*) FILTER (late = 1 AND y = 0) AS DOUBLE) AS b, CAST(count(*) FILTER (late = 0 AND y = 1) AS DOUBLE) AS c, CAST(count(*) FILTER (late = 0 AND y = 0) AS DOUBLE) AS d FROM t)
SELECT 'const' AS name, round(ln(c / d), 5) AS value, round(sqrt(1 / c + 1 / d), 5) AS std_error FROM c UNION ALL SELECT 'late', round(ln(a / b) - ln(c / d), 5), round(sqrt(1 / a + 1 / b + 1 / c + 1 / d), 5) FROM c"""


def reg_exponential(spark, folder):
    """A constant hazard on one 0/1 covariate is a log rate ratio."""
    fit = logit.fit_exponential(spells(spark, folder), ["late"], "duration_days", "event_sold")
    table = fit.tables(spark)["coefficients"]
    return table.select("name", F.round("value", 5).alias("value"), F.round("std_error", 5).alias("std_error"))


QUERIES["reg_exponential"] = reg_exponential
SQL["reg_exponential"] = WITH_SPELLS + """, c AS (SELECT CAST(sum(event_sold) FILTER (late = 1) AS DOUBLE) AS a, sum(duration_days) FILTER (late = 1) AS ta, CAST(sum(event_sold) FILTER (late = 0) AS DOUBLE) AS b, sum(duration_days) FILTER (late = 0) AS tb FROM spells)
SELECT 'const' AS name, round(ln(b / tb), 5) AS value, round(sqrt(1 / b), 5) AS std_error FROM c UNION ALL SELECT 'late', round(ln(a / ta) - ln(b / tb), 5), round(sqrt(1 / a + 1 / b), 5) FROM c"""


def reg_concordance(spark, folder):
    found = concordance.concordance(spells(spark, folder), "size", "duration_days", "event_sold")
    return spark.createDataFrame([tuple(float(v) for v in found.values())], ", ".join(f"{k} double" for k in found)).withColumn(
        "concordance", F.round("concordance", 9)
    )


QUERIES["reg_concordance"] = reg_concordance
SQL["reg_concordance"] = WITH_SPELLS + """, g AS (SELECT size AS s, duration_days AS d, event_sold AS e, CAST(count(*) AS DOUBLE) AS n FROM spells GROUP BY ALL),
x AS (SELECT sum(CASE WHEN a.s > b.s THEN a.n * b.n END) AS c, sum(CASE WHEN a.s < b.s THEN a.n * b.n END) AS w, sum(CASE WHEN a.s = b.s THEN a.n * b.n END) AS t
  FROM g a JOIN g b ON a.e = 1 AND (b.d > a.d OR (b.d = a.d AND b.e = 0)))
SELECT c AS concordant, w AS discordant, t AS tied, c + w + t AS pairs, round((c + 0.5 * t) / (c + w + t), 9) AS concordance FROM x"""


def reg_support(spark, folder):
    found = survival.premium_support(spells(spark, folder))
    return spark.createDataFrame(
        [tuple(float(v) for v in found.values())], ", ".join(f"{k} double" for k in found)
    ).select(*[F.round(k, 8).alias(k) for k in found])


QUERIES["reg_support"] = reg_support
SQL["reg_support"] = WITH_SPELLS + """SELECT round(min(x), 8) AS low, round(quantile_cont(x, 0.01), 8) AS p1, round(quantile_cont(x, 0.99), 8) AS p99, round(max(x), 8) AS high, CAST(count(*) AS DOUBLE) AS n_observations
FROM (SELECT rel_price_premium AS x FROM spells)"""


def reg_calibration(spark, folder):
    rows = spells(spark, folder).withColumn("p", (F.col("size") + F.col("l_linenumber")) / 60)
    found = logit.calibration(rows, "p", "event_sold")
    return found.select("decile", "n", F.round("predicted_mean", 8).alias("predicted_mean"), F.round("observed_rate", 8).alias("observed_rate"))


QUERIES["reg_calibration"] = reg_calibration
SQL["reg_calibration"] = WITH_SPELLS + """, t AS (SELECT (size + l_linenumber) / 60 AS p, event_sold FROM spells),
e AS (SELECT list_sort(list_distinct(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS q FROM t)
SELECT CAST(greatest(1, len(list_filter(q, lambda x: x < p))) AS INT) AS decile, count(*) AS n, round(avg(p), 8) AS predicted_mean, round(avg(event_sold), 8) AS observed_rate FROM t, e GROUP BY 1"""


def reg_quality_share(spark, folder):
    rows = spells(spark, folder)
    moments = gram(rows, ["rel_price_premium", "l_tax"])
    share = explained_share(moments, "rel_price_premium")
    return spark.createDataFrame([(float(share), float(condition_number(moments)))], "share double, condition double").select(
        F.round("share", 8).alias("share"), F.round("condition", 6).alias("condition")
    )


QUERIES["reg_quality_share"] = reg_quality_share
SQL["reg_quality_share"] = WITH_SPELLS + """, m AS (SELECT sum(rel_price_premium * l_tax) / sqrt(sum(rel_price_premium * rel_price_premium) * sum(l_tax * l_tax)) AS c, corr(rel_price_premium, l_tax) AS r FROM spells)
SELECT round(r * r, 8) AS share, round(sqrt((1 + abs(c)) / (1 - abs(c))), 6) AS condition FROM m"""


def reg_cox(spark, folder):
    """Hazard model of the spells; checked against dense arithmetic in the tests."""
    fit = survival.fit_cox(spells(spark, folder), ["rel_price_premium", "size", "p_type"], ["p_type"])
    return fit.fit.tables(spark)["coefficients"].select(
        "name", *[F.round(c, 6).alias(c) for c in ("value", "std_error", "p_value")]
    )


QUERIES["reg_cox"] = reg_cox


def reg_cox_baseline(spark, folder):
    """Baseline of a model without signal: close to events over rows at risk."""
    fit = survival.fit_cox(spells(spark, folder), ["rel_price_premium"], [], with_concordance=False)
    return fit.baseline_table(spark).select("t", F.round("survival", 9).alias("survival"))


QUERIES["reg_cox_baseline"] = reg_cox_baseline


def _newton_sql(steps: int) -> str:
    """Newton steps of one-covariate hazard models with Efron ties, one after another.

    Over ``src`` (fit, stratum, t, e, x, n): rows counted n times, risk sets per stratum, a
    coefficient per fit.
    """
    text = "b0 AS (SELECT DISTINCT fit, CAST(0 AS DOUBLE) AS b FROM src)"
    for k in range(1, steps + 1):
        text += f""",
d{k} AS (SELECT fit, stratum, t, sum(w) AS s0, sum(w * x) AS s1, sum(w * x * x) AS s2, sum(n * e) AS m, sum(e * w) AS d0, sum(e * w * x) AS d1, sum(e * w * x * x) AS d2, sum(n * e * x) AS ex
  FROM (SELECT src.*, n * exp(b * x) AS w FROM src JOIN b{k - 1} USING (fit)) GROUP BY ALL),
r{k} AS (SELECT *, sum(s0) OVER o AS r0, sum(s1) OVER o AS r1, sum(s2) OVER o AS r2 FROM d{k} WINDOW o AS (PARTITION BY fit, stratum ORDER BY t DESC)),
l{k} AS (SELECT *, unnest(range(CAST(m AS BIGINT))) / m AS f FROM r{k} WHERE m > 0),
g{k} AS (SELECT fit, sum((r1 - f * d1) / (r0 - f * d0)) AS g, sum((r2 - f * d2) / (r0 - f * d0) - pow((r1 - f * d1) / (r0 - f * d0), 2)) AS i FROM l{k} GROUP BY fit),
b{k} AS (SELECT fit, b + (x - g) / i AS b FROM g{k} JOIN b{k - 1} USING (fit) JOIN (SELECT fit, sum(ex) AS x FROM d{k} GROUP BY fit) USING (fit))"""
    return text


def _source(fit: str = "0", stratum: str = "0", x: str = "rel_price_premium", n: str = "1", rows: str = "spells") -> str:
    return f"src AS (SELECT {fit} AS fit, {stratum} AS stratum, duration_days AS t, event_sold AS e, {x} AS x, {n} AS n FROM {rows})"


ONE_COX = WITH_SPELLS + ", " + _source() + ", " + _newton_sql(6)
SQL["reg_cox_baseline"] = ONE_COX + """,
h AS (SELECT t, sum(m) AS m, sum(w) AS w FROM (SELECT duration_days AS t, event_sold AS m, exp(b * (rel_price_premium - (SELECT avg(rel_price_premium) FROM spells))) AS w FROM spells, b6) GROUP BY t),
k AS (SELECT t, m / sum(w) OVER (ORDER BY t DESC) AS hazard FROM h)
SELECT t, round(exp(-sum(hazard) OVER (ORDER BY t)), 9) AS survival FROM k"""


def reg_cox_price(spark, folder):
    """Coefficient, its error and the test value of a hazard model with one covariate."""
    fit = survival.fit_cox(spells(spark, folder), ["rel_price_premium"], [], with_concordance=False)
    return fit.fit.tables(spark)["coefficients"].select("name", F.round("value", 5).alias("value"), F.round("std_error", 5).alias("std_error"))


QUERIES["reg_cox_price"] = reg_cox_price
SQL["reg_cox_price"] = ONE_COX + """
SELECT 'rel_price_premium' AS name, round(b, 5) AS value, round(1 / sqrt(i), 5) AS std_error FROM b6 JOIN g6 USING (fit)"""


def reg_cox_strata(spark, folder):
    """Every supplier a baseline of its own; the covariate is compared within suppliers."""
    fit = survival.fit_cox(spells(spark, folder), ["rel_price_premium"], [], with_concordance=False, strata="l_suppkey")
    table = fit.fit.tables(spark)["coefficients"].select("name", F.round("value", 7).alias("value"), F.round("std_error", 7).alias("std_error"))
    return table.withColumns({"rows": F.lit(float(fit.fit.rows)), "strata": F.lit(fit.fit.stats["strata"])})


QUERIES["reg_cox_strata"] = reg_cox_strata
STRATA_COX = WITH_SPELLS + ", " + _source(stratum="l_suppkey") + ", " + _newton_sql(6)
SQL["reg_cox_strata"] = STRATA_COX + """
SELECT 'rel_price_premium' AS name, round(b, 7) AS value, round(1 / sqrt(i), 7) AS std_error, (SELECT CAST(count(*) AS DOUBLE) FROM src) AS rows,
  (SELECT CAST(count(DISTINCT stratum) AS DOUBLE) FROM src) AS strata FROM b6 JOIN g6 USING (fit)"""


def reg_strata_baseline(spark, folder):
    """Each supplier's cumulative baseline hazard at day 45, between its own days."""
    fit = survival.fit_cox(spells(spark, folder), ["rel_price_premium"], [], with_concordance=False, strata="l_suppkey")
    return fit.cumulative_per_stratum(45).select("l_suppkey", F.round("total", 9).alias("total"))


QUERIES["reg_strata_baseline"] = reg_strata_baseline
SQL["reg_strata_baseline"] = STRATA_COX + """,
h AS (SELECT stratum, t, sum(e) AS m, sum(w) AS w FROM (SELECT stratum, t, e, exp(b * (x - (SELECT avg(x) FROM src))) AS w FROM src, b6) GROUP BY 1, 2),
k AS (SELECT stratum, t, m / sum(w) OVER (PARTITION BY stratum ORDER BY t DESC) AS hazard FROM h),
c AS (SELECT stratum, t, sum(hazard) OVER (PARTITION BY stratum ORDER BY t) AS total FROM k),
p AS (SELECT stratum, coalesce(max(t) FILTER (t <= 45), 0) AS lo, coalesce(arg_max(total, t) FILTER (t <= 45), 0) AS a,
  min(t) FILTER (t > 45) AS hi, arg_min(total, t) FILTER (t > 45) AS z FROM c GROUP BY 1)
SELECT stratum AS l_suppkey, round(CASE WHEN hi IS NULL THEN a ELSE a + (45 - lo) / (hi - lo) * (z - a) END, 9) AS total FROM p"""


def reg_cox_pair(spark, folder):
    """Two covariates at once: values, errors and the log likelihood's pieces agree with plain Newton steps."""
    fit = survival.fit_cox(spells(spark, folder), ["rel_price_premium", "size"], [], with_concordance=False)
    return fit.fit.tables(spark)["coefficients"].select("name", *[F.round(c, 7).alias(c) for c in ("value", "std_error", "ci_low", "ci_high")])


def _pair_sql(steps: int) -> str:
    text = "b0 AS (SELECT CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS c)"
    sums = [f"sum({pre}w{x}) AS {name}{i}" for pre, name in (("", "s"), ("e * ", "d")) for i, x in (("0", ""), ("x", " * x"), ("y", " * y"), ("xx", " * x * x"), ("xy", " * x * y"), ("yy", " * y * y"))]
    share = lambda i: f"(r{i} - f * d{i}) / (r0 - f * d0)"
    for k in range(1, steps + 1):
        text += f""",
d{k} AS (SELECT t, sum(e) AS m, sum(e * x) AS ex, sum(e * y) AS ey, {', '.join(sums)} FROM (SELECT p.*, exp(b * x + c * y) AS w FROM p, b{k - 1}) GROUP BY t),
r{k} AS (SELECT *, {', '.join(f'sum(s{i}) OVER o AS r{i}' for i in ('0', 'x', 'y', 'xx', 'xy', 'yy'))} FROM d{k} WINDOW o AS (ORDER BY t DESC)),
l{k} AS (SELECT *, unnest(range(CAST(m AS BIGINT))) / m AS f FROM r{k} WHERE m > 0),
g{k} AS (SELECT (SELECT sum(ex) FROM d{k}) - sum({share('x')}) AS gx, (SELECT sum(ey) FROM d{k}) - sum({share('y')}) AS gy,
  sum({share('xx')} - {share('x')} * {share('x')}) AS ixx, sum({share('xy')} - {share('x')} * {share('y')}) AS ixy, sum({share('yy')} - {share('y')} * {share('y')}) AS iyy FROM l{k}),
b{k} AS (SELECT b + (gx * iyy - gy * ixy) / (ixx * iyy - ixy * ixy) AS b, c + (gy * ixx - gx * ixy) / (ixx * iyy - ixy * ixy) AS c FROM g{k}, b{k - 1})"""
    return text


PAIR_COX = WITH_SPELLS + ", p AS (SELECT duration_days AS t, event_sold AS e, rel_price_premium AS x, size AS y FROM spells), " + _pair_sql(6) + """,
fitted AS (SELECT 'rel_price_premium' AS name, b AS value, sqrt(iyy / (ixx * iyy - ixy * ixy)) AS std_error FROM b6, g6
  UNION ALL SELECT 'size', c, sqrt(ixx / (ixx * iyy - ixy * ixy)) FROM b6, g6)"""
QUERIES["reg_cox_pair"] = reg_cox_pair
SQL["reg_cox_pair"] = PAIR_COX + """
SELECT name, round(value, 7) AS value, round(std_error, 7) AS std_error, round(value - 1.959963984540054 * std_error, 7) AS ci_low,
  round(value + 1.959963984540054 * std_error, 7) AS ci_high FROM fitted"""


def reg_absorbed(spark, folder):
    """Slopes of the log price within suppliers, of which none has a column."""
    rows = spells(spark, folder)
    fit = absorb.absorbed_least_squares("close", rows, ["rel_price_premium", "l_quantity"], "log_price", ["l_suppkey"]).fit
    pairs = [(n, v, fit.coefficient(n)["std_error"]) for n, v in fit.lookup.items()]
    pairs += [("r_squared_within", fit.stats["r_squared_within"], None), ("levels", fit.stats["levels"], None)]
    table = spark.createDataFrame([(n, float(v), e) for n, v, e in pairs], "name string, value double, std_error double")
    return table.select("name", F.round("value", 9).alias("value"), F.round("std_error", 9).alias("std_error"))


QUERIES["reg_absorbed"] = reg_absorbed
SQL["reg_absorbed"] = WITH_SPELLS + """, d AS (SELECT l_suppkey, rel_price_premium - avg(rel_price_premium) OVER g AS x, l_quantity - avg(l_quantity) OVER g AS z, log_price - avg(log_price) OVER g AS y
  FROM spells WINDOW g AS (PARTITION BY l_suppkey)),
m AS (SELECT sum(x * x) AS xx, sum(z * z) AS zz, sum(x * z) AS xz, sum(x * y) AS xy, sum(z * y) AS zy, sum(y * y) AS yy, count(*) AS n, count(DISTINCT l_suppkey) AS k FROM d),
s AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS a, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b FROM m),
v AS (SELECT *, (yy - a * xy - b * zy) / (n - 2 - k) / (xx * zz - xz * xz) AS u FROM s)
SELECT 'rel_price_premium' AS name, round(a, 9) AS value, round(sqrt(u * zz), 9) AS std_error FROM v UNION ALL SELECT 'l_quantity', round(b, 9), round(sqrt(u * xx), 9) FROM v
UNION ALL SELECT 'r_squared_within', round((a * xy + b * zy) / yy, 9), NULL FROM v UNION ALL SELECT 'levels', CAST(k AS DOUBLE), NULL FROM v"""


def reg_level_effects(spark, folder):
    """What absorbing leaves as each supplier's own level."""
    rows = spells(spark, folder)
    found = absorb.absorbed_least_squares("close", rows, ["rel_price_premium"], "log_price", ["l_suppkey"])
    return found.effects.select("l_suppkey", "n", F.round("effect", 9).alias("effect"))


QUERIES["reg_level_effects"] = reg_level_effects
SQL["reg_level_effects"] = WITH_SPELLS + """, g AS (SELECT l_suppkey, count(*) AS n, avg(rel_price_premium) AS x, avg(log_price) AS y FROM spells GROUP BY 1),
b AS (SELECT sum((rel_price_premium - x) * (log_price - y)) / sum((rel_price_premium - x) * (rel_price_premium - x)) AS b FROM spells JOIN g USING (l_suppkey))
SELECT l_suppkey, n, round(y - b * x, 9) AS effect FROM g, b"""


def coded(spark, folder, choice):
    """The spells under one reading of the second return flag."""
    rows = spells(spark, folder)
    cancelled = F.col("l_returnflag") == "A"
    if choice == "excluded":
        return rows.where(~cancelled)
    return rows.withColumn("event_sold", F.when(cancelled, F.lit(int(choice == "event"))).otherwise(F.col("event_sold")))


def reg_cancelled_sweep(spark, folder):
    """The coefficient under each reading of cancelled rows, all three fitted together."""
    found = fit_demand.cancelled_sweep(lambda choice: coded(spark, folder, choice), ["rel_price_premium"], [])
    return found.select("treatment", "rows", "events", *[F.round(c, 7).alias(c) for c in ("beta_price", "ci_low", "ci_high")], "error")


QUERIES["reg_cancelled_sweep"] = reg_cancelled_sweep
SQL["reg_cancelled_sweep"] = WITH_SPELLS + """, c AS (SELECT 'censored' AS treatment, duration_days, event_sold, rel_price_premium FROM spells
  UNION ALL SELECT 'excluded', duration_days, event_sold, rel_price_premium FROM spells WHERE l_returnflag <> 'A'
  UNION ALL SELECT 'event', duration_days, CAST(l_returnflag IN ('A', 'R') AS INT), rel_price_premium FROM spells), """ + _source(fit="treatment", rows="c") + ", " + _newton_sql(6) + """
SELECT b6.fit AS treatment, rows, events, round(b, 7) AS beta_price, round(b - 1.959963984540054 / sqrt(i), 7) AS ci_low, round(b + 1.959963984540054 / sqrt(i), 7) AS ci_high, CAST(NULL AS VARCHAR) AS error
FROM b6 JOIN g6 USING (fit) JOIN (SELECT fit, count(*) AS rows, CAST(sum(e) AS BIGINT) AS events FROM src GROUP BY fit) USING (fit)"""


def reg_two_by_two(spark, folder):
    """Old and new rows by old and new variable, four fits at once, and what the change is made of."""
    rows = spells(spark, folder).withColumn("other_premium", F.col("l_tax") - F.col("l_discount"))
    rows = land(rows.select("l_linenumber", "duration_days", "event_sold", "rel_price_premium", "other_premium"), "spells")
    early = F.col("l_linenumber") <= 3
    found = audit.decompose_change(rows.where(early), rows, "rel_price_premium", "other_premium", ["rel_price_premium"], [])
    return found.select("part", F.round("value", 6).alias("value"))


QUERIES["reg_two_by_two"] = reg_two_by_two
SQL["reg_two_by_two"] = WITH_SPELLS + """, c AS (SELECT 'oo' AS cell, duration_days, event_sold, rel_price_premium AS x FROM spells WHERE l_linenumber <= 3
  UNION ALL SELECT 'on', duration_days, event_sold, l_tax - l_discount FROM spells WHERE l_linenumber <= 3
  UNION ALL SELECT 'no', duration_days, event_sold, rel_price_premium FROM spells UNION ALL SELECT 'nn', duration_days, event_sold, l_tax - l_discount FROM spells), """ + _source(fit="cell", x="x", rows="c") + ", " + _newton_sql(6) + """,
v AS (SELECT max(b) FILTER (fit = 'oo') AS oo, max(b) FILTER (fit = 'on') AS en, max(b) FILTER (fit = 'no') AS ne, max(b) FILTER (fit = 'nn') AS nn FROM b6)
SELECT part, round(value, 6) AS value FROM (SELECT unnest(['old data, old variable', 'old data, new variable', 'new data, old variable', 'new data, new variable', 'total', 'respecify_first', 'sample_second', 'sample_first',
  'respecify_second', 'interaction', 'respecify_average', 'sample_average']) AS part, unnest([oo, en, ne, nn, nn - oo, en - oo, nn - en, ne - oo, nn - ne, (nn - ne) - (en - oo), ((en - oo) + (nn - ne)) / 2, ((ne - oo) + (nn - en)) / 2]) AS value FROM v)"""


REPLICATES = 3


def _md5_share(text):
    """A number in [0, 1) that SQL can form too."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(16**12)


def reg_bootstrap(spark, folder):
    """Both stages of three weighted replicates, refitted side by side."""
    rows = spells(spark, folder).withColumnsRenamed({"ppsf": "list_ppsf"}).withColumn("rel_price_premium", F.lit(0.0))
    premium = hedonic.fit_premium(rows, numeric=[], categorical=["p_type"])
    scored = rows.drop("rel_price_premium").withColumn("rel_price_premium", F.expm1(F.log("list_ppsf") - F.log(premium.reference())))
    cox = survival.fit_cox(scored, ["rel_price_premium"], [], with_concordance=False)
    key = F.concat_ws("|", "l_orderkey", "l_linenumber")
    weights = F.array(*[bootstrap.poisson_weight(_md5_share(F.concat(F.lit(f"{r}|"), key))) for r in range(REPLICATES)])
    found = bootstrap.bootstrap_price(scored, cox, premium, [], REPLICATES, weights=weights)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(found.draws)], "replicate int, beta double").withColumn("beta", F.round("beta", 7))


QUERIES["reg_bootstrap"] = reg_bootstrap
_POISSON = " ".join(f"WHEN u < {sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))!r} THEN {k}" for k in range(18))
SQL["reg_bootstrap"] = WITH_SPELLS + f""", u AS (SELECT r, p_type, duration_days, event_sold, log_price, CAST('0x' || substr(md5(concat(r, '|', l_orderkey, '|', l_linenumber)), 1, 12) AS BIGINT) / {float(16**12)!r} AS u
  FROM spells, (SELECT unnest(range({REPLICATES})) AS r)),
w AS (SELECT *, CASE {_POISSON} ELSE 18 END AS n FROM u),
y AS (SELECT r, p_type, sum(n * log_price) / sum(n) AS y FROM w GROUP BY ALL),
c AS (SELECT r, duration_days, event_sold, exp(log_price - y) - 1 AS x, n FROM w JOIN y USING (r, p_type) WHERE n > 0), """ + _source(fit="r", x="x", n="n", rows="c") + ", " + _newton_sql(6) + """
SELECT CAST(fit AS INT) AS replicate, round(b, 7) AS beta FROM b6"""


def reg_diagnostics(spark, folder):
    rows = spells(spark, folder)
    cox = survival.fit_cox(rows, ["rel_price_premium", "size"], []).fit
    return diagnostics.diagnose(rows, cox).checks.select("name", "requirement", F.round("value", 6).alias("value"), "status")


QUERIES["reg_diagnostics"] = reg_diagnostics


def snk_fingerprint(spark, folder):
    found = fingerprint(spells(spark, folder), ["p_brand"], "event_sold", "l_extendedprice", 60, 7, "1")
    return found.select("p_brand", "rows", "events", F.col("total").cast("double").alias("total"), "fingerprint")


QUERIES["snk_fingerprint"] = snk_fingerprint
SQL["snk_fingerprint"] = WITH_SPELLS + """, g AS (SELECT p_brand, count(*) AS rows, CAST(sum(event_sold) AS BIGINT) AS events, sum(CAST(round(l_extendedprice, 4) AS DECIMAL(30, 4))) AS total FROM spells GROUP BY 1)
SELECT p_brand, rows, events, CAST(total AS DOUBLE) AS total, sha256(concat(rows, '|', events, '|', total, '|60|7|1')) AS fingerprint FROM g"""


def ft_hedonic_features(spark, folder):
    """The whole feature build, premium respecified, over the cleaned listings."""
    # The columns that the features of a row, its cell and the list-price surface are made of.
    columns = (
        "submarket", "list_date", "list_ppsf", "living_area_sqft", "floor", "beds", "baths_full", "baths_half", "hoa_monthly",
        "new_construction", "year_built", "close_price", "original_list_price", "last_list_price", "min_lease_days", "total_stories",
        *features.LEVEL_FIELDS, *features.TOKEN_FIELDS,
    )
    cleaned = S.cleaned(spark, folder, columns=columns).frame
    table = features.build_features(land(cleaned, "cleaned"))
    return table.frame.groupBy("median_basis", "rel_price_premium_spec").agg(
        F.count("*").alias("rows"), F.round(F.avg("hedonic_price_premium"), 6).alias("mean_residual"),
        F.round(F.stddev_samp("cell_median_premium"), 6).alias("sd_cell_premium"),
    )


QUERIES["ft_hedonic_features"] = ft_hedonic_features


def aud_extremes(spark, folder):
    """The three lowest and highest premiums of every brand; many are equal."""
    rows = spells(spark, folder).withColumns(
        {"line": F.col("l_orderkey") * 10 + F.col("l_linenumber"), "brand": F.when(F.col("p_brand") != "Brand#11", F.col("p_brand"))}
    )
    return audit.extreme_rows(rows, ["brand"], "rel_price_premium", "line", 3, ["duration_days"]).withColumn("value", F.round("value", 9))


QUERIES["aud_extremes"] = aud_extremes
SQL["aud_extremes"] = WITH_SPELLS + """, x AS (SELECT CASE WHEN p_brand <> 'Brand#11' THEN p_brand END AS brand, l_orderkey * 10 + l_linenumber AS line, rel_price_premium AS v, duration_days FROM spells),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY brand ORDER BY v, line) AS INT) AS lo, CAST(row_number() OVER (PARTITION BY brand ORDER BY v DESC, line) AS INT) AS hi FROM x)
SELECT brand, 'low' AS side, lo AS rank, line AS ident, round(v, 9) AS value, duration_days FROM r WHERE lo <= 3
UNION ALL SELECT brand, 'high', hi, line, round(v, 9), duration_days FROM r WHERE hi <= 3"""


def statuses(spark, folder):
    """Lines with a status, the status before it, and a closing date of their own."""
    return lines(spark, folder).withColumns(
        {
            "status": F.when(F.col("l_returnflag") == "R", "Closed").when(F.col("l_returnflag") == "A", "Cancelled").otherwise("Active"),
            "previous": F.when(F.col("l_linestatus") == "F", F.when(F.col("l_linenumber") < 3, "Closed").otherwise("Active")),
            "close_date": F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") != 2) | (F.col("l_linenumber") == 6), F.col("l_shipdate")),
        }
    )


STATUSES = f"""WITH {LINES}, t AS (SELECT CASE l_returnflag WHEN 'R' THEN 'Closed' WHEN 'A' THEN 'Cancelled' ELSE 'Active' END AS status,
  CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_linenumber < 3 THEN 'Closed' ELSE 'Active' END END AS previous, (l_returnflag = 'R' AND l_linenumber <> 2) OR l_linenumber = 6 AS proof FROM lines)
"""


def aud_previous_status(spark, folder):
    return audit.status_by_previous(statuses(spark, folder), "status", "previous")


QUERIES["aud_previous_status"] = aud_previous_status
SQL["aud_previous_status"] = STATUSES + "SELECT status, coalesce(previous, '<blank>') AS previous, count(*) AS rows FROM t GROUP BY ALL"


def aud_sale_claims(spark, folder):
    return audit.sale_claims(statuses(spark, folder), "status", "previous", "Closed")


QUERIES["aud_sale_claims"] = aud_sale_claims
SQL["aud_sale_claims"] = STATUSES + """, s AS (SELECT coalesce(status = 'Closed', FALSE) AS a, coalesce(previous = 'Closed', FALSE) AS b, status, previous, proof FROM t)
SELECT 'status' AS "column", count(status) AS filled, count(*) FILTER (a) AS claims, count(*) FILTER (a AND proof) AS agreed, count(*) FILTER (a AND NOT proof) AS unproven,
  count(*) FILTER (NOT a AND proof) AS missed, count(*) FILTER (a AND NOT b) AS alone FROM s
UNION ALL SELECT 'previous', count(previous), count(*) FILTER (b), count(*) FILTER (b AND proof), count(*) FILTER (b AND NOT proof), count(*) FILTER (NOT b AND proof), count(*) FILTER (b AND NOT a) FROM s"""
