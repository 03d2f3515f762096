"""Demand and occupancy models."""

from functools import reduce

from pyspark.sql import functions as F

from curbline.functions.times import as_instant
from curbline.operators import boosting, demand, demand_models, forecast, linear, occupancy, schedule
from curbline.plans.inputs import AS_OF
from curbline.plans.registry import query
from curbline.plans.schedule import scheduled
from curbline.session import cut_lineage

CALENDAR_KEY = ["station_id", "day_of_week", "hour", "is_weekend"]


def features(t):
    """The demand feature table, stored once: every model step reads it several times."""
    return cut_lineage(demand.demand_features(t.bike_trips, t.station_info))


def mean_models(t):
    """Two mean predictors as model stand-ins with an exact reference."""
    rows = features(t).withColumn("y_true", F.col("pickups").cast("double"))
    by_key = demand_models.mean_predictor(rows, rows, "pickups", CALENDAR_KEY, "station_mean")
    both = demand_models.mean_predictor(by_key, rows, "pickups", ["hour"], "hour_mean")
    return demand_models.long_predictions(both, ["station_mean", "hour_mean"], [*CALENDAR_KEY, "station_name"])


_MEANS = """
WITH preds AS (SELECT station_id, station_name, day_of_week, hour, is_weekend, pickups AS y, avg(pickups) OVER (PARTITION BY station_id, day_of_week, hour, is_weekend) AS p1,
  avg(pickups) OVER (PARTITION BY hour) AS p2 FROM demand),
metrics AS (SELECT 'station_mean' AS model_name, sqrt(avg(pow(y - p1, 2))) AS rmse FROM preds UNION ALL SELECT 'hour_mean', sqrt(avg(pow(y - p2, 2))) FROM preds)
"""


@query("model_errors", "A-10 U-1 M-6", _MEANS + "SELECT model_name, round(rmse, 6) AS rmse FROM metrics")
def model_errors(t):
    return demand_models.model_rmse(mean_models(t)).withColumn("rmse", F.round("rmse", 6))


@query(
    "model_errors_by_join_weight",
    "J-10 J-11",
    _MEANS + """
SELECT m.model_name, round(sqrt(sum(n * sse) / sum(CAST(n AS DOUBLE) * n)), 6) AS rmse FROM
 (SELECT 'station_mean' AS model_name, count(*) AS n, sum(pow(y - p1, 2)) AS sse FROM preds GROUP BY station_id, day_of_week, hour, is_weekend
  UNION ALL SELECT 'hour_mean', count(*), sum(pow(y - p2, 2)) FROM preds GROUP BY station_id, day_of_week, hour, is_weekend) m GROUP BY m.model_name""",
)
def model_errors_by_join_weight(t):
    errors = demand_models.group_weighted_rmse(mean_models(t), CALENDAR_KEY)
    return errors.withColumn("rmse", F.round("rmse", 6))


@query(
    "best_model",
    "W-2 M-7 U-1",
    _MEANS + "SELECT model_name, round(rmse, 6) AS rmse FROM metrics QUALIFY rmse = min(rmse) OVER ()",
)
def best_model(t):
    best = demand_models.select_best(demand_models.model_rmse(mean_models(t)))
    return best.withColumn("rmse", F.round("rmse", 6))


_PREDICTED = """
SELECT station_id, day_of_week, hour, is_weekend, min(station_name) AS station_name, avg(p1) AS predicted_pickups FROM preds GROUP BY station_id, day_of_week, hour, is_weekend"""


def predicted(t):
    chosen = mean_models(t).filter(F.col("model_name") == "station_mean")
    return demand_models.predicted_table(chosen, "y_pred", "predicted_pickups")


@query(
    "predicted_demand_table",
    "A-11 M-8",
    _MEANS + f"SELECT * REPLACE (round(predicted_pickups, 6) AS predicted_pickups) FROM ({_PREDICTED}) q",
)
def predicted_demand_table(t):
    return predicted(t).withColumn("predicted_pickups", F.round("predicted_pickups", 6))


@query(
    "top_predicted_stations",
    "K-6",
    _MEANS + f"""
, slots AS (SELECT step, dayofweek(TIMESTAMP '2024-01-31 00:00:00' + step * INTERVAL '1' HOUR) + 1 AS day_of_week, hour(TIMESTAMP '2024-01-31 00:00:00' + step * INTERVAL '1' HOUR) AS hour FROM range(1, 25) r(step))
SELECT h.horizon_hours, p.station_id, min(p.station_name) AS station_name, round(sum(predicted_pickups), 6) AS demand,
  row_number() OVER (PARTITION BY h.horizon_hours ORDER BY round(sum(predicted_pickups), 6) DESC, p.station_id) AS rank
FROM ({_PREDICTED}) p JOIN slots s ON s.day_of_week = p.day_of_week AND s.hour = p.hour JOIN (SELECT unnest([1, 4, 24]) AS horizon_hours) h ON s.step <= h.horizon_hours
GROUP BY h.horizon_hours, p.station_id QUALIFY rank <= 10""",
)
def top_predicted_stations(t):
    return demand_models.top_predicted(predicted(t), "predicted_pickups", AS_OF)


_SERIES = """
WITH counts AS (SELECT station_id, date_trunc('hour', snapshot_ts) AS ts_hour, count(*) AS n FROM station_status GROUP BY ALL),
spine AS (SELECT station_id, unnest(generate_series(min(ts_hour), max(ts_hour), INTERVAL '1' HOUR)) AS ts_hour FROM counts GROUP BY station_id),
dense AS (SELECT s.station_id, s.ts_hour, coalesce(c.n, 0) AS n FROM spine s LEFT JOIN counts c ON c.station_id = s.station_id AND c.ts_hour = s.ts_hour)
"""


def snapshot_counts(t):
    return cut_lineage(demand.hourly_counts(t.station_status, "station_id", "snapshot_ts", "n"))


@query(
    "hourly_lags",
    "W-4",
    _SERIES + """
SELECT station_id, ts_hour, n, coalesce(lag(n, 24) OVER w, -1) AS lag_24, coalesce(lag(n, 168) OVER w, -1) AS lag_168 FROM dense WINDOW w AS (PARTITION BY station_id ORDER BY ts_hour)""",
)
def hourly_lags(t):
    lagged = forecast.with_lags(forecast.dense_hours(snapshot_counts(t), "n"), "n")
    return lagged.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("lag_24", "lag_168")})


_FIT = _SERIES + """
, diffs AS (SELECT station_id, ts_hour, n - lag(n, 168) OVER w AS d FROM dense WINDOW w AS (PARTITION BY station_id ORDER BY ts_hour)),
pairs AS (SELECT station_id, ts_hour, d AS y, lag(d) OVER (PARTITION BY station_id ORDER BY ts_hour) AS x FROM diffs),
fitted AS (SELECT station_id, count(*) AS hours, coalesce(regr_slope(y, x), 0) AS slope, coalesce(regr_intercept(y, x), avg(y)) AS intercept,
  regr_syy(y, x) / count(*) - coalesce(regr_slope(y, x), 0) * coalesce(regr_slope(y, x), 0) * regr_sxx(y, x) / count(*) AS residual_variance
  FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY station_id)
"""


@query(
    "seasonal_fit",
    "M-5",
    _FIT + "SELECT station_id, hours, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(residual_variance, 6) AS residual_variance FROM fitted",
)
def seasonal_fit(t):
    params = forecast.fit_seasonal_ar(snapshot_counts(t), "n").filter(F.col("hours") > 0)
    return params.withColumns({c: F.round(c, 6) for c in ("slope", "intercept", "residual_variance")})


@query(
    "seasonal_forecast",
    "M-5 M-6",
    _FIT + """
, past AS (SELECT station_id, ts_hour, lag(n, 168) OVER w AS base, lag(n, 1) OVER w AS last, lag(n, 169) OVER w AS before FROM dense WINDOW w AS (PARTITION BY station_id ORDER BY ts_hour))
SELECT c.station_id, c.ts_hour, c.n, round(greatest(coalesce(p.base, 0) + coalesce(f.intercept, 0) + coalesce(f.slope, 0) * (coalesce(p.last, 0) - coalesce(p.before, 0)), 0), 6) AS forecast
FROM counts c JOIN past p ON p.station_id = c.station_id AND p.ts_hour = c.ts_hour LEFT JOIN fitted f ON f.station_id = c.station_id""",
)
def seasonal_forecast(t):
    counts = snapshot_counts(t)
    params = forecast.fit_seasonal_ar(counts, "n")
    rows = forecast.one_step_forecast(counts, counts, params, "n", "forecast")
    return rows.withColumn("forecast", F.round("forecast", 6))


@query(
    "station_mean_features",
    "M-1 M-3",
    """
WITH cells AS (SELECT station_id, hour, sum(pickups) AS s, count(*) AS n FROM demand GROUP BY ALL), o AS (SELECT sum(s) / sum(n) AS m FROM cells),
st AS (SELECT station_id, (sum(s) + 5.0 * any_value(o.m)) / (sum(n) + 5.0) AS sm FROM cells, o GROUP BY station_id)
SELECT c.station_id, c.hour, round(st.sm, 6) AS station_mean, round((c.s + 5.0 * st.sm) / (c.n + 5.0), 6) AS station_hour_mean FROM cells c JOIN st ON st.station_id = c.station_id""",
)
def station_mean_features(t):
    means = demand_models.station_means(features(t), "pickups")
    return means.withColumns({c: F.round(c, 6) for c in ("station_mean", "station_hour_mean")})


@query(
    "holdout_split",
    "M-1",
    """
SELECT ts_hour >= (SELECT max(ts_hour) FROM demand) - INTERVAL '28' DAY AS holdout, count(*) AS n FROM demand GROUP BY 1""",
)
def holdout_split(t):
    train, holdout = demand_models.split_by_time(features(t), 28)
    flagged = train.withColumn("holdout", F.lit(False)).unionByName(holdout.withColumn("holdout", F.lit(True)))
    return flagged.groupBy("holdout").agg(F.count("*").alias("n"))


def _least_squares(rows: str, y: str) -> str:
    """CTEs ``station`` and ``slope``: least squares on the calendar with one intercept per station, by Cramer's rule."""
    x = ["day_of_week", "hour", "is_weekend"]
    sums = [f"sum({c}) :: DOUBLE AS s{i}, sum({c} * {y}) :: DOUBLE AS y{i}" for i, c in enumerate(x)]
    sums += [f"sum({x[i]} * {x[j]}) :: DOUBLE AS x{i}{j}" for i in range(3) for j in range(i, 3)]
    a = [f"sum(x{i}{j} - s{i} * s{j} / n) AS a{i}{j}" for i in range(3) for j in range(i, 3)]
    b = [f"sum(y{i} - s{i} * sy / n) AS b{i}" for i in range(3)]

    def det(column: int | None) -> str:
        m = [[f"b{i}" if j == column else f"a{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
        two = lambda j, k: f"({m[1][j]} * {m[2][k]} - {m[1][k]} * {m[2][j]})"
        return f"({m[0][0]} * {two(1, 2)} - {m[0][1]} * {two(0, 2)} + {m[0][2]} * {two(0, 1)})"

    slopes = ", ".join(f"{det(i)} / {det(None)} AS w{i}" for i in range(3))
    return f"""
station AS (SELECT station_id, count(*) :: DOUBLE AS n, sum({y}) :: DOUBLE AS sy, {", ".join(sums)} FROM {rows} GROUP BY station_id),
normal AS (SELECT {", ".join(a + b)} FROM station), slope AS (SELECT {slopes} FROM normal),
intercept AS (SELECT station_id, (sy - w0 * s0 - w1 * s1 - w2 * s2) / n AS c FROM station, slope),
overall AS (SELECT (sum(sy) - any_value(w0) * sum(s0) - any_value(w1) * sum(s1) - any_value(w2) * sum(s2)) / sum(n) AS c0 FROM station, slope)
"""


@query(
    "linear_demand_fit",
    "M-2",
    f"""
WITH {_least_squares("demand", "pickups")}
SELECT station_id, round(c, 6) AS intercept, round(w0, 6) AS day_of_week, round(w1, 6) AS hour, round(w2, 6) AS is_weekend FROM intercept, slope""",
)
def linear_demand_fit(t):
    """The linear pickup model: slopes of the calendar and one intercept per station."""
    fit = linear.fit_linear(features(t), "station_id", demand_models.CALENDAR, "pickups")
    slopes = {c: F.round(F.lit(b), 6) for c, b in fit.slopes.items()}
    return fit.intercepts.withColumn("intercept", F.round("intercept", 6)).withColumns(slopes)


@query(
    "linear_residuals",
    "M-2 M-6",
    """
SELECT l.label, s.station_id, count(*) AS n, CAST(0 AS DOUBLE) AS residual, CAST(0 AS DOUBLE) AS by_weekday, CAST(0 AS DOUBLE) AS by_hour
FROM demand s, (SELECT unnest(['pickups', 'dropoffs']) AS label) l GROUP BY l.label, s.station_id""",
)
def linear_residuals(t):
    """What defines least squares, for both labels: residuals add up to 0 per station, and times an input over all."""
    rows, out = features(t), []
    for label in ("pickups", "dropoffs"):
        fit = linear.fit_linear(rows, "station_id", demand_models.CALENDAR, label)
        e = cut_lineage(fit.transform(rows).withColumn("e", F.col(label) - F.col("prediction")))
        whole = e.agg(*[F.round(F.abs(F.sum(F.col("e") * F.col(c))), 3).alias(c) for c in ("day_of_week", "hour")])
        each = e.groupBy("station_id").agg(F.count("*").alias("n"), F.round(F.abs(F.sum("e")), 6).alias("residual"))
        totals = whole.select(F.struct(F.col("day_of_week").alias("by_weekday"), F.col("hour").alias("by_hour"))).scalar()
        out.append(each.withColumn("_t", totals).select(F.lit(label).alias("label"), "station_id", "n", "residual", "_t.*"))
    return out[0].unionByName(out[1])


@query(
    "predicted_linear_pickups",
    "M-2 M-6 M-8 A-11",
    f"""
WITH {_least_squares("demand", "pickups")}
SELECT d.station_id, d.day_of_week, d.hour, d.is_weekend, min(station_name) AS station_name, round(avg(c + w0 * day_of_week + w1 * hour + w2 * is_weekend), 6) AS predicted_pickups
FROM demand d JOIN intercept i ON i.station_id = d.station_id, slope GROUP BY d.station_id, d.day_of_week, d.hour, d.is_weekend""",
)
def predicted_linear_pickups(t):
    """The predicted table of a fitted model, value by value."""
    rows = features(t)
    scored = linear.fit_linear(rows, "station_id", demand_models.CALENDAR, "pickups").transform(rows)
    table = demand_models.predicted_table(scored, "prediction", "predicted_pickups")
    return table.withColumn("predicted_pickups", F.round("predicted_pickups", 6))


@query(
    "fitted_model_choice",
    "M-2 M-6 M-7 W-2 U-1",
    f"""
WITH cut AS (SELECT max(ts_hour) - INTERVAL '28' DAY AS cut_at FROM demand), train AS (SELECT * FROM demand, cut WHERE ts_hour < cut_at),
{_least_squares("train", "pickups")},
held AS (SELECT d.*, (SELECT avg(t.pickups) FROM train t WHERE t.hour = d.hour) AS h FROM demand d, cut WHERE ts_hour >= cut_at),
errors AS (SELECT 'linreg' AS model_name, sqrt(avg(pow(pickups - (coalesce(c, c0) + w0 * day_of_week + w1 * hour + w2 * is_weekend), 2))) AS rmse
  FROM held LEFT JOIN intercept i ON i.station_id = held.station_id, slope, overall
  UNION ALL SELECT 'hour_mean', sqrt(avg(pow(pickups - coalesce(h, 0), 2))) FROM held)
SELECT model_name, round(rmse, 6) AS rmse, rmse = min(rmse) OVER () AS is_best FROM errors""",
)
def fitted_model_choice(t):
    """Errors on the last 28 days of models fitted on the days before, and the better one."""
    train, held = demand_models.split_by_time(features(t), 28)
    fit = linear.fit_linear(train, "station_id", demand_models.CALENDAR, "pickups", demand_models.LINEAR)
    scored = demand_models.mean_predictor(fit.transform(held), train, "pickups", ["hour"], "hour_mean")
    scored = scored.withColumn("y_true", F.col("pickups").cast("double"))
    errors = cut_lineage(demand_models.model_rmse(demand_models.long_predictions(scored, [demand_models.LINEAR, "hour_mean"], [])))
    best = demand_models.select_best(errors).select("model_name", F.lit(True).alias("is_best"))
    return errors.join(best, "model_name", "left").fillna(False, ["is_best"]).withColumn("rmse", F.round("rmse", 6))


def _first_splits(model, outputs):
    """Root and leaves of the first tree of each output."""
    inputs, rows = model.inputs, []
    for tree, output in zip(model.rounds[0], outputs, strict=True):
        name = inputs.names[int(tree.feature[0])]
        threshold = inputs.edges[name][int(tree.left[0].nonzero()[0].max()) - 1]
        rows.append((output, name, threshold, float(tree.value[1]), float(tree.value[2])))
    return rows


_CALENDAR_ROWS = """
cells AS (SELECT d.*, x.fid, x.name, CASE x.fid WHEN 0 THEN day_of_week WHEN 1 THEN hour ELSE is_weekend END AS v
  FROM demand d, (SELECT unnest([0, 1, 2]) AS fid, unnest(['day_of_week', 'hour', 'is_weekend']) AS name) x),
total AS (SELECT count(*) AS n, sum(pickups) :: DOUBLE AS s, avg(pickups) AS m, var_pop(pickups) AS spread FROM demand),
cuts AS (SELECT fid, name, v, sum(count(*)) OVER w AS nl, sum(sum(pickups) :: DOUBLE) OVER w AS sl FROM cells GROUP BY fid, name, v WINDOW w AS (PARTITION BY fid ORDER BY v)),
best AS (SELECT *, pow(sl - nl * m, 2) / nl + pow(s - sl - (n - nl) * m, 2) / (n - nl) AS gain FROM cuts, total WHERE nl < n
  QUALIFY row_number() OVER (ORDER BY round(gain, 6) DESC, fid, v) = 1)
"""


@query(
    "boosted_demand_first_split",
    "M-4",
    f"""
WITH {_CALENDAR_ROWS}
SELECT name AS input, v :: DOUBLE AS threshold, round(sl / nl, 6) AS left_mean, round((s - sl) / (n - nl), 6) AS right_mean,
  round(spread, 6) AS loss_before, round(spread - gain / n, 6) AS loss_after FROM best""",
)
def boosted_demand_first_split(t):
    """Boosting's first tree with one split: its leaves are the means of both sides, its loss what they leave."""
    model = boosting.fit_boosted_regression(
        features(t), demand_models.CALENDAR, "pickups", rounds=1, depth=1, rate=1.0, penalty=0.0
    )
    mean = model.start[0]
    rows = [
        (name, at, round(mean + left, 6), round(mean + right, 6), round(float(model.losses[0]), 6), round(float(model.losses[1]), 6))
        for _, name, at, left, right in _first_splits(model, ["pickups"])
    ]
    return t.spark.createDataFrame(
        rows, "input string, threshold double, left_mean double, right_mean double, loss_before double, loss_after double"
    )


_FAMILIES = [demand_models.LINEAR, demand_models.FOREST, demand_models.BOOSTED, demand_models.SERIES]


def _scored(t, label):
    """Predictions of all families for every feature row."""
    _, scored = demand_models.compare_families(features(t), label)
    extra = [*CALENDAR_KEY, "station_name", "holdout"]
    # stored with a column per family: half the size of a row per family, and one pass
    stored = cut_lineage(scored.select(*extra, "y_true", *_FAMILIES))
    return demand_models.long_predictions(stored, _FAMILIES, extra)


def _selection(t, label):
    errors = cut_lineage(demand_models.model_rmse(_scored(t, label).where("holdout")))
    best = demand_models.select_best(errors).select("model_name", F.lit(True).alias("is_best"))
    return errors.join(best, "model_name", "left").fillna(False, ["is_best"])


def _predicted(t, label, output):
    """Demand table over all feature rows from the family with the least hold-out error."""
    scored = _scored(t, label)
    winner = demand_models.select_best(demand_models.model_rmse(scored.where("holdout"))).select("model_name")
    chosen = scored.join(winner.limit(1), "model_name", "left_semi")
    return demand_models.predicted_table(chosen, "y_pred", output)


@query("pickup_model_selection", "M-2 M-3 M-4 M-5 M-6 M-7 W-2")
def pickup_model_selection(t):
    """Errors of the four families on the same hold-out rows, the best one marked."""
    return _selection(t, "pickups")


@query("dropoff_model_selection", "M-2 M-3 M-4 M-5 M-6 M-7 W-2")
def dropoff_model_selection(t):
    return _selection(t, "dropoffs")


@query("predicted_dropoffs", "M-2 M-3 M-4 M-5 M-8 A-11")
def predicted_dropoffs(t):
    return _predicted(t, "dropoffs", "predicted_dropoffs")


@query("predicted_pickups", "M-2 M-3 M-4 M-5 M-8 A-11")
def predicted_pickups(t):
    return _predicted(t, "pickups", "predicted_pickups")


@query(
    "predicted_demand_keys",
    "M-8",
    """
SELECT station_id, day_of_week, hour, is_weekend, 1 AS predictions FROM demand GROUP BY station_id, day_of_week, hour, is_weekend""",
)
def predicted_demand_keys(t):
    """The keys of the fitted pickup table with a prediction: one for every key of the features."""
    keys = ["station_id", "day_of_week", "hour", "is_weekend"]
    table = _predicted(t, "pickups", "predicted_pickups").where("predicted_pickups IS NOT NULL")
    return table.groupBy(*keys).agg(F.count("*").cast("int").alias("predictions"))


@query("occupancy_features", "M-9 P-5 P-9 P-15 P-16", "SELECT * FROM occupancy")
def occupancy_features(t):
    return occupancy.occupancy_features(t.vehicle_positions)


_SPLIT = """
WITH parts AS (SELECT 'train' AS part, * FROM occupancy WHERE ts < TIMESTAMP '2024-01-24 00:00:00' AND ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '67' DAY
  UNION ALL SELECT 'eval', * FROM occupancy WHERE ts >= TIMESTAMP '2024-01-24 00:00:00')
"""


def _parts(t):
    rows = occupancy.occupancy_features(t.vehicle_positions)
    return occupancy.train_rows(rows, AS_OF), occupancy.eval_rows(rows, AS_OF)


@query("occupancy_split", "M-10 P-7", _SPLIT + "SELECT part, label, route_id, count(*) AS n FROM parts GROUP BY ALL")
def occupancy_split(t):
    train, evaluation = _parts(t)
    both = train.withColumn("part", F.lit("train")).unionByName(evaluation.withColumn("part", F.lit("eval")))
    return both.groupBy("part", "label", "route_id").agg(F.count("*").alias("n"))


@query(
    "class_weights",
    "M-11",
    _SPLIT + """
SELECT label, count(*) AS n, round((SELECT count(*) FROM parts WHERE part = 'train') / ((SELECT count(DISTINCT label) FROM parts WHERE part = 'train') * count(*)), 6) AS weight
FROM parts WHERE part = 'train' GROUP BY label""",
)
def class_weights(t):
    train, _ = _parts(t)
    weighted = occupancy.with_class_weights(train)
    return weighted.groupBy("label").agg(F.count("*").alias("n"), F.round(F.min("weight"), 6).alias("weight"))


@query(
    "occupancy_metrics",
    "M-14 U-1",
    """
WITH preds AS (SELECT 'by_hour' AS model, label, CASE hour_of_day % 3 WHEN 0 THEN 'FULL' WHEN 1 THEN 'FEW_SEATS_AVAILABLE' ELSE 'MANY_SEATS_AVAILABLE' END AS guess FROM occupancy
  UNION ALL SELECT 'always_full', label, 'FULL' FROM occupancy),
labels_ AS (SELECT DISTINCT model, label FROM preds UNION SELECT DISTINCT model, guess FROM preds),
per AS (SELECT l.model, l.label, count(*) FILTER (WHERE p.label = l.label) AS actual, count(*) FILTER (WHERE p.guess = l.label) AS guessed, count(*) FILTER (WHERE p.label = l.label AND p.guess = l.label) AS hits
  FROM labels_ l JOIN preds p ON p.model = l.model GROUP BY l.model, l.label),
pr AS (SELECT *, CASE WHEN guessed > 0 THEN hits / guessed ELSE 0 END AS p, CASE WHEN actual > 0 THEN hits / actual ELSE 0 END AS r FROM per)
SELECT model, round(sum(hits) / sum(actual), 6) AS accuracy, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall,
  round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1_score, CAST(sum(actual) AS BIGINT) AS rows FROM pr GROUP BY model""",
)
def occupancy_metrics(t):
    """The evaluation step over two fixed guesses, which has an exact reference."""
    rows = occupancy.occupancy_features(t.vehicle_positions)
    levels = F.array(F.lit("FULL"), F.lit("FEW_SEATS_AVAILABLE"), F.lit("MANY_SEATS_AVAILABLE"))
    guesses = F.array(
        F.struct(F.lit("by_hour").alias("model"), F.get(levels, F.col("hour_of_day") % 3).alias("predicted_label")),
        F.struct(F.lit("always_full").alias("model"), F.lit("FULL").alias("predicted_label")),
    )
    metrics = occupancy.classification_metrics(occupancy.confusion(rows.select("label", F.inline(guesses))))
    return metrics.withColumns(
        {c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1_score")}
    )


_STUMP_INPUTS = ["hour_of_day", "day_of_week", "is_weekend"]

# The first boosting round with one split per label, from gradients weight * (1 / labels - [label]) on.
_STUMPS = _SPLIT + """
, weighted AS (SELECT *, (SELECT count(*) FROM parts WHERE part = 'train') / ((SELECT count(DISTINCT label) FROM parts WHERE part = 'train') * count(*) OVER (PARTITION BY label)) AS weight
  FROM parts WHERE part = 'train'),
levels AS (SELECT DISTINCT label AS class_label, (SELECT count(DISTINCT label) FROM weighted) :: DOUBLE AS k FROM weighted),
cells AS (SELECT l.class_label, x.fid, x.name, CASE x.fid WHEN 0 THEN hour_of_day WHEN 1 THEN day_of_week ELSE is_weekend END AS v,
    weight * (1 / k - CASE WHEN label = class_label THEN 1 ELSE 0 END) AS g, weight * (1 / k) * (1 - 1 / k) AS h
  FROM weighted, levels l, (SELECT unnest([0, 1, 2]) AS fid, unnest(['hour_of_day', 'day_of_week', 'is_weekend']) AS name) x),
total AS (SELECT class_label, sum(g) / 3 AS gt, sum(h) / 3 AS ht FROM cells GROUP BY class_label),
cuts AS (SELECT class_label, fid, name, v, sum(sum(g)) OVER w AS gl, sum(sum(h)) OVER w AS hl FROM cells GROUP BY class_label, fid, name, v WINDOW w AS (PARTITION BY class_label, fid ORDER BY v)),
stumps AS (SELECT c.*, gt, ht, pow(gl, 2) / (hl + 1) + pow(gt - gl, 2) / (ht - hl + 1) - pow(gt, 2) / (ht + 1) AS gain,
    -0.3 * gl / (hl + 1) AS left_value, -0.3 * (gt - gl) / (ht - hl + 1) AS right_value FROM cuts c JOIN total t ON t.class_label = c.class_label
  WHERE hl >= 1 AND ht - hl >= 1 QUALIFY row_number() OVER (PARTITION BY c.class_label ORDER BY round(gain, 9) DESC, fid, v) = 1)
"""


def _stump_model(t):
    train, evaluation = _parts(t)
    rows = cut_lineage(occupancy.with_class_weights(train))
    return boosting.fit_boosted(rows, _STUMP_INPUTS, rounds=1, trees=1, depth=1), evaluation


@query(
    "boosted_occupancy_first_split",
    "M-11 M-12",
    _STUMPS + "SELECT class_label, name AS input, v :: DOUBLE AS threshold, round(left_value, 6) AS left_value, round(right_value, 6) AS right_value FROM stumps",
)
def boosted_occupancy_first_split(t):
    """The first round of the seat level model with one split per level: inputs, thresholds and leaf values."""
    model, _ = _stump_model(t)
    rows = [(*split[:3], round(split[3], 6), round(split[4], 6)) for split in _first_splits(model, model.labels)]
    return t.spark.createDataFrame(rows, "class_label string, input string, threshold double, left_value double, right_value double")


@query(
    "boosted_occupancy_probabilities",
    "M-12 M-13 M-15",
    _STUMPS + """
, asked AS (SELECT hour_of_day, day_of_week, is_weekend, count(*) AS n FROM parts WHERE part = 'eval' GROUP BY ALL),
scores AS (SELECT a.*, class_label, exp(CASE WHEN CASE fid WHEN 0 THEN hour_of_day WHEN 1 THEN day_of_week ELSE is_weekend END <= v THEN left_value ELSE right_value END) AS e FROM asked a, stumps)
SELECT hour_of_day, day_of_week, is_weekend, n, class_label, round(e / sum(e) OVER (PARTITION BY hour_of_day, day_of_week, is_weekend), 6) AS prob FROM scores""",
)
def boosted_occupancy_probabilities(t):
    """Every level's probability for the rows of the evaluation days, after that round."""
    model, evaluation = _stump_model(t)
    scored = occupancy.label_probabilities(model, occupancy.predict(model, evaluation))
    return scored.groupBy(*_STUMP_INPUTS, "class_label").agg(F.count("*").alias("n"), F.round(F.max("prob"), 6).alias("prob"))


@query("occupancy_model_metrics", "M-11 M-12 M-13 M-14")
def occupancy_model_metrics(t):
    train, evaluation = _parts(t)
    models = occupancy.fit_classifiers(cut_lineage(occupancy.with_class_weights(train)))
    return occupancy.evaluate(models, evaluation)


@query("occupancy_probabilities", "M-15")
def occupancy_probabilities(t):
    """Class probabilities for the rows of the evaluation days."""
    train, evaluation = _parts(t)
    models = occupancy.fit_classifiers(cut_lineage(occupancy.with_class_weights(train)), ["lr"])
    return occupancy.label_probabilities(models["lr"], occupancy.predict(models["lr"], evaluation))


@query(
    "occupancy_request_scores",
    "M-15",
    _SPLIT + """
SELECT r.route_id, h.hour_of_day, (SELECT count(DISTINCT label) FROM parts WHERE part = 'train') AS levels, CAST(1 AS DOUBLE) AS total
FROM (SELECT DISTINCT route_id FROM occupancy) r, (SELECT unnest([8, 17]) AS hour_of_day) h""",
)
def occupancy_request_scores(t):
    """Requests (route, time) to probabilities: one per seat level, which add up to 1."""
    train, _ = _parts(t)
    model = occupancy.fit_classifiers(cut_lineage(occupancy.with_class_weights(train)), ["lr"])["lr"]
    routes = occupancy.occupancy_features(t.vehicle_positions).select("route_id").distinct()
    times_asked = F.explode(F.array(*[F.timestamp_add("HOUR", F.lit(h), as_instant(AS_OF)) for h in (8, 17)]))
    requests = routes.select("route_id", F.lit("IN_TRANSIT_TO").alias("current_status"), times_asked.alias("ts"))
    asked = occupancy.serving_features(requests, schedule.route_centres(scheduled(t)))
    scored = occupancy.label_probabilities(model, occupancy.predict(model, asked))
    return scored.groupBy("route_id", "hour_of_day").agg(
        F.count("*").alias("levels"), F.round(F.sum("prob"), 6).alias("total")
    )


@query(
    "occupancy_rows_scored",
    "M-12 M-13 M-14 U-1",
    _SPLIT + """
SELECT m.model, (SELECT count(*) FROM parts WHERE part = 'eval') AS rows, true AS in_range
FROM (SELECT unnest(['lr', 'bt', 'rf', 'dnn']) AS model) m""",
)
def occupancy_rows_scored(t):
    """Every fitted family scores every evaluation row; all measures are shares."""
    train, evaluation = _parts(t)
    models = occupancy.fit_classifiers(cut_lineage(occupancy.with_class_weights(train)))
    measures = {
        name: occupancy.evaluate({name: model}, evaluation).drop("model") for name, model in models.items()
    }
    shares = [F.col(c).between(0, 1) for c in ("accuracy", "precision", "recall", "f1_score")]
    return demand_models.union_metrics(measures, "model").select(
        "model", "rows", reduce(lambda a, b: a & b, shares).alias("in_range")
    )
