"""Segments, anomalies, price models, forecasts, recommendations.

All run at the operators' defaults, which are the full sizes.
"""

from __future__ import annotations

import datetime as dt

from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from forecourt.functions.numbers import half_up
from forecourt.operators import anomalies as an
from forecourt.operators import forecasting as fc
from forecourt.operators import neighbours as nb
from forecourt.operators import pricing as pr
from forecourt.operators import segments as sg
from forecourt.operators.density import density_clusters
from forecourt.operators.features import one_for_zero
from forecourt.operators.joins import attach_group_stats, known_size
from forecourt.operators.sampling import split
from forecourt.operators.series import resample, robust_daily, trailing_mean
from forecourt.operators.shap import mean_shap
from forecourt.plans.registry import n, query, r
from forecourt.session import checkpoint_dir

INPUTS = pr.Inputs()
AS_OF = dt.date(2001, 11, 5)
AS_OF_YEAR = 2002


def _model_rows(k, *more):
    """Listings for a price model, written by all cores: encoding, fitting and scoring read them again and again, and a
    table of one row group would be one task each time."""
    return k.listings("listing_id", "price", *INPUTS.categorical, *INPUTS.numeric, *more, spread=True).transform(known_size)


@query("market_segments", "ML3 SF16 AG48")
def _(k):
    found = sg.segment(k.listings("price", "year", "odometer", "manufacturer", "model"))
    return sg.segment_figures(found)


@query("segment_totals", "ML3 AG48", f"""SELECT {n()} AS listings, cast(5 as bigint) AS segments, {r('avg(price)')} AS avg_price, {r('avg(odometer)')} AS avg_mileage
FROM listings WHERE price IS NOT NULL AND year IS NOT NULL AND odometer IS NOT NULL""")
def _(k):
    # the segments make up all listings, none empty, whichever way the centres fall
    found = sg.segment(k.listings("price", "year", "odometer", "manufacturer", "model"))
    return found.agg(F.count("*").alias("listings"), F.count_distinct("cluster").alias("segments"), half_up(F.avg("price")).alias("avg_price"),
                     half_up(F.avg("odometer")).alias("avg_mileage"))


@query("segment_makes", "AG45 ML3")
def _(k):
    return sg.cluster_by_make(sg.segment(k.listings("price", "year", "odometer", "manufacturer"), k=4, how="minmax"))


@query("segment_elbow", "ML4")
def _(k):
    return sg.elbow(k.listings("price", "year", "odometer"))


@query("density_clusters", "ML5")
def _(k):
    found = density_clusters(k.listings("price", "year", "odometer"), ["price", "year", "odometer"], eps=0.05, min_points=10)
    return found.groupBy("cluster").agg(F.count("*").alias("listings"), half_up(F.avg("price")).alias("avg_price"))


@query("state_clusters", "ML6")
def _(k):
    return sg.state_clusters(k.listings("state", "price", "year", "odometer"))


@query("extreme_states", "ML6", f"""WITH s AS (SELECT state, {r('avg(price)')} AS avg_price FROM listings GROUP BY 1),
t AS (SELECT avg(avg_price) AS m, stddev_samp(avg_price) AS d FROM s)
SELECT state, avg_price, CASE WHEN avg_price > m + d THEN 'high' ELSE 'low' END AS price_level FROM s, t WHERE avg_price > m + d OR avg_price < m - d""")
def _(k):
    return sg.extreme_states(k.listings("state", "price", "year", "odometer"))


@query("isolation_anomalies", "ML1")
def _(k):
    rows = an.isolation_anomalies(k.listings("listing_id", "price", "year", "odometer"), ["price", "year", "odometer"],
                                  "listing_id")
    return rows.groupBy("is_anomaly").agg(F.count("*").alias("listings"), half_up(F.avg("price")).alias("avg_price"),
                                          half_up(F.avg("anomaly_score"), 4).alias("avg_score"))


@query("residual_anomalies", "ST9 ML15")
def _(k):
    rows = an.price_anomalies(_model_rows(k), INPUTS, "listing_id", times=1.8)
    return rows.groupBy("by_residual", "by_price").agg(F.count("*").alias("listings"))


@query("local_outliers", "ML2")
def _(k):
    rows = nb.local_outliers(k.listings("listing_id", "price", "year", "odometer"), "listing_id",
                             ["price", "year", "odometer"])
    return rows.groupBy("is_outlier").agg(F.count("*").alias("listings"), half_up(F.avg("lof"), 4).alias("avg_lof"),
                                          half_up(F.max("lof"), 4).alias("max_lof"))


@query("neighbour_fill", "ST14", f"""WITH b AS (SELECT min(price) AS p0, max(price) AS p1, min(year) AS y0, max(year) AS y1 FROM listings WHERE price IS NOT NULL AND year IS NOT NULL),
x AS (SELECT listing_id, odometer, (price - p0) / (p1 - p0) AS p, (cast(year as double) - y0) / (y1 - y0) AS y FROM listings, b WHERE price IS NOT NULL AND year IS NOT NULL),
w AS (SELECT DISTINCT p, y FROM x WHERE odometer IS NULL), d AS (SELECT * FROM x WHERE odometer IS NOT NULL),
n AS (SELECT w.p, w.y, min({{'d': sqrt((w.p - d.p) * (w.p - d.p) + (w.y - d.y) * (w.y - d.y)), 'id': d.listing_id, 'v': d.odometer}}, 5) AS near FROM w, d GROUP BY 1, 2),
f AS (SELECT coalesce(l.odometer, list_avg(list_transform(near, lambda e: e.v))) AS odometer FROM listings l LEFT JOIN x USING (listing_id) LEFT JOIN n ON n.p = x.p AND n.y = x.y)
SELECT {n()} AS listings, {n('odometer')} AS known, {r('avg(odometer)')} AS avg_mileage FROM f""")
def _(k):
    df = k.listings("listing_id", "price", "year", "odometer")
    filled = nb.fill_from_neighbours(df, "listing_id", "odometer", ["price", "year"])
    return filled.agg(F.count("*").alias("listings"), F.count("odometer").alias("known"), half_up(F.avg("odometer")).alias("avg_mileage"))


@query("price_model_metrics", "ML7")
def _(k):
    learn, check = split(_model_rows(k), "listing_id")
    return pr.regression_metrics(pr.predict(pr.train(learn, INPUTS), check, INPUTS))


@query("price_model_importances", "ML7 ML13")
def _(k):
    return pr.importances(pr.train(_model_rows(k), INPUTS), INPUTS)


@query("permutation_importances", "ML13")
def _(k):
    df = _model_rows(k)
    return pr.permutation_importance(pr.train(df, INPUTS), df, INPUTS)


@query("shap_importances", "ML13")
def _(k):
    df = _model_rows(k)
    return mean_shap(pr.train(df, INPUTS), df, INPUTS)


@query("forest_with_dummies", "ML8")
def _(k):
    learn, check = split(_model_rows(k, "type"), "listing_id")
    inputs = pr.Inputs((*INPUTS.categorical, "type"))
    forest = RandomForestRegressor(labelCol="price", numTrees=100, maxDepth=6, seed=42)
    return pr.regression_metrics(pr.predict(pr.train(learn, inputs, forest, one_hot=True, scaler="standard"), check, inputs))


@query("model_comparison", "ML9")
def _(k):
    learn, check = split(_model_rows(k), "listing_id")
    return pr.compare_models(learn, check, INPUTS)


@query("parameter_grid", "ML9")
def _(k):
    return pr.grid_search(_model_rows(k), INPUTS)


@query("time_validation", "ML10")
def _(k):
    return pr.time_validation(_model_rows(k, "posting_date"), "posting_date", INPUTS)


@query("prediction_spread", "ML11")
def _(k):
    return pr.prediction_spread(_model_rows(k), "listing_id", INPUTS).agg(
        F.count("*").alias("listings"), half_up(F.avg("prediction")).alias("avg_prediction"), half_up(F.avg("uncertainty")).alias("avg_uncertainty"))


@query("residual_figures", "ML12", f"""WITH p AS (SELECT price, avg(price) OVER (PARTITION BY manufacturer, year) AS h FROM listings WHERE manufacturer IS NOT NULL AND price IS NOT NULL),
e AS (SELECT *, price - h AS e FROM p), mu AS (SELECT avg(e) AS m FROM e)
SELECT {n()} AS listings, {r('avg(e)', 4)} AS residuals_mean, {r('stddev_pop(e)', 4)} AS residuals_std, {r('avg(pow(e - m, 3)) / pow(var_pop(e), 1.5)', 6)} AS residuals_skew,
{r('kurtosis_pop(e)', 6)} AS residuals_kurtosis, {r('count(*) * pow(corr(h, e * e), 2)', 4)} AS white_statistic FROM e, mu""")
def _(k):
    df = k.listings("manufacturer", "year", "price").where("manufacturer is not null and price is not null")
    rows = attach_group_stats(df, ["manufacturer", "year"], prediction=F.avg("price"))
    out = pr.residual_figures(rows).drop("white_p")
    return out.withColumns({c: half_up(c, 6 if c in ("residuals_skew", "residuals_kurtosis") else 4) for c in out.columns[1:]})


@query("residual_report", "ML12")
def _(k):
    df = _model_rows(k)
    return pr.residual_figures(pr.predict(pr.train(df, INPUTS), df, INPUTS))


@query("fair_price_metrics", "ML15")
def _(k):
    return pr.regression_metrics(pr.fair_prices(_model_rows(k), INPUTS), predicted="fair_price")


@query("batch_pricing", "ML16")
def _(k):
    df = _model_rows(k)
    return pr.predict(pr.train(df, INPUTS), df, INPUTS).select("listing_id", "price", "prediction")


@query("resale_opportunities", "ML26", f"""WITH g AS (SELECT manufacturer, model, avg(price) AS fair FROM listings WHERE manufacturer IS NOT NULL GROUP BY 1, 2)
SELECT listing_id, price, {r('fair')} AS fair_price, {r('fair - price')} AS margin, {r('(fair - price) / nullif(price, 0) * 100')} AS margin_pct FROM listings JOIN g USING (manufacturer, model)
WHERE price > 0 AND (fair - price) / nullif(price, 0) >= 0.1 AND price <= 40000 AND year >= 1997 AND odometer <= 30000 ORDER BY fair - price DESC, listing_id LIMIT 10""")
def _(k):
    df = k.listings("listing_id", "manufacturer", "model", "price", "year", "odometer").where("manufacturer is not null")
    rows = attach_group_stats(df, ["manufacturer", "model"], fair_price=F.avg("price"))
    best = pr.opportunities(rows, 0.1, max_outlay=40000, min_year=1997, max_km=30000)
    return best.select("listing_id", "price", *[half_up(c).alias(c) for c in ("fair_price", "margin", "margin_pct")])


@query("listing_forecast", "ML17 ML18")
def _(k):
    return fc.listing_forecast(k.listings("price", "year", "posting_date", "manufacturer", "model", "type", "region"), AS_OF)


@query("volume_forecast", "ML18")
def _(k):
    daily = resample(k.listings("posting_date"), "posting_date", "day", listings=F.count("*"))
    return fc.volume_forecast(daily, "listings", start=AS_OF)


@query("price_forecast", "ML19 ML20 WN10")
def _(k):
    checkpoint_dir(k.spark)
    daily = robust_daily(k.listings("posting_date", "price"), "posting_date").checkpoint()
    return fc.seasonal_forecast(daily, "price_median", 30, regressor="listing_count", regressor_ahead=trailing_mean(daily, "listing_count"))


@query("price_trend", "ML19")
def _(k):
    daily = resample(k.listings("posting_date", "price"), "posting_date", "day", price=F.avg("price"))
    return fc.price_trend(fc.seasonal_forecast(daily, "price", 30))


@query("demand_forecasts", "ML21")
def _(k):
    return fc.demand_forecasts(k.listings("state", "model", "posting_date"), ["state", "model"], "posting_date")


_SIX = ["year", "price", "odometer", "vehicle_age", "price_per_year", "price_per_mile"]


@query("similar_listings", "ML25", f"""WITH f AS (SELECT listing_id, cast(year as double) AS year, price, odometer, {AS_OF_YEAR} - year AS vehicle_age, price / CASE WHEN year = {AS_OF_YEAR} THEN 1 ELSE {AS_OF_YEAR} - year END AS price_per_year,
price / nullif(odometer, 0) AS price_per_mile FROM listings), s AS (SELECT {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in _SIX)} FROM f),
x AS (SELECT listing_id, {', '.join(f'({c} - lo_{c}) / (hi_{c} - lo_{c}) AS x{i}' for i, c in enumerate(_SIX))} FROM f, s WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _SIX)}),
y AS (SELECT *, sqrt({' + '.join(f'x{i} * x{i}' for i in range(6))}) AS norm FROM x), a AS (SELECT * FROM y ORDER BY listing_id LIMIT 3),
p AS (SELECT y.listing_id, a.listing_id AS asked, {r('(' + ' + '.join(f'y.x{i} * a.x{i}' for i in range(6)) + ') / nullif(y.norm * a.norm, 0)', 9)} AS similarity FROM y, a WHERE y.listing_id != a.listing_id),
o AS (SELECT *, cast(row_number() OVER (PARTITION BY asked ORDER BY similarity DESC, listing_id) as int) AS place FROM p WHERE similarity IS NOT NULL) SELECT * FROM o WHERE place <= 5""")
def _(k):
    df = k.listings("listing_id", "year", "price", "odometer").withColumn("vehicle_age", F.lit(AS_OF_YEAR) - F.col("year"))
    df = df.withColumns({"price_per_year": F.col("price") / one_for_zero(F.col("vehicle_age")),
                         "price_per_mile": F.col("price") / F.nullif("odometer", F.lit(0.0))})
    df = known_size(df)
    asked = [x.listing_id for x in df.dropna(subset=_SIX).orderBy("listing_id").limit(3).collect()]
    return nb.similar_listings(df, "listing_id", _SIX, asked)



@query("similar_to_all", "ML25")
def _(k):
    df = k.listings("listing_id", "year", "price", "odometer").withColumn("vehicle_age", F.lit(AS_OF_YEAR) - F.col("year"))
    df = df.withColumns({"price_per_year": F.col("price") / one_for_zero(F.col("vehicle_age")),
                         "price_per_mile": F.col("price") / F.nullif("odometer", F.lit(0.0))})
    return nb.similar_to_all(df, "listing_id", _SIX)
