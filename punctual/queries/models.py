"""Fitted models. Results of fits have no SQL; their inputs do."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import functions as F

from punctual.operators import calibration, metrics, quality, rates, splits
from punctual.operators.ranks import position_ids
from punctual.plans import boosting, explain, modelling
from punctual.queries import feeds
from punctual.queries.evaluation import BASE, SAMPLES, SEED, _round, base_frame
from punctual.queries.features import FEATURES, frame
from punctual.queries.registry import query, table
from punctual.session import written
from punctual.settings import EvaluationSettings, Inputs, growing_inputs, inputs_of

TIME = "scheduled_datetime"
FOLDS = EvaluationSettings().folds
MINUTES = modelling.TreeSettings(few_values=True)  # delays are whole minutes in the plausible range


def model_rows(spark, sf_dir):
    """The feature frame with a row number of its own for each flight, stored."""
    rows = frame(spark, sf_dir).withColumn("_flight", F.concat_ws("|", "airport", "flight_number", F.date_format(TIME, "yyyy-MM-dd HH:mm")))
    rows = written(rows, "flights")
    return written(rows.join(position_ids(rows, "_flight", name="row_number"), "_flight").drop("_flight"), "frame")


def _parts(rows):
    cut = F.lit("2024-01-24").cast("timestamp_ntz")
    return rows.filter(F.col(TIME) < cut), rows.filter(F.col(TIME) >= cut)


_SCALED = ["scheduled_turnaround_min", "prev_departure_delay_min", "airline_delay_rate_7d", "has_inbound"]


def _scaled_sql(c: str) -> str:
    fill = f"coalesce(CAST({c} AS DOUBLE), (SELECT median(CAST({c} AS DOUBLE)) FROM frame))"
    return f"round(({fill} - avg({fill}) OVER ()) / coalesce(nullif(stddev_pop({fill}) OVER (), 0), 1), 5) AS {c}"


@query(
    "scaled_inputs",
    f"WITH {FEATURES} SELECT airport, flight_number, {feeds.sql_stamp(TIME)}, {', '.join(_scaled_sql(c) for c in _SCALED)} FROM frame",
)
def scaled_inputs(spark, sf_dir):
    rows = model_rows(spark, sf_dir)
    scales = modelling.fit_scales(rows, tuple(_SCALED))
    shown = [F.round(modelling.scaled(c, s), 5).alias(c) for c, s in scales.items()]
    return rows.select("airport", "flight_number", feeds.stamp(TIME), *shown)


@query(
    "category_indexes",
    """WITH v AS (SELECT 'p_brand' AS feature, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part)
    SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, value) - 1 AS idx FROM v GROUP BY feature, value""",
)
def category_indexes(spark, sf_dir):
    """One-hot positions of every category, the most common first."""
    part = table(spark, sf_dir, "part")
    encoder = modelling.Encoder.fit(part, Inputs((), ("p_brand", "p_type")))
    coded = encoder.transform(part)
    long = coded.selectExpr("stack(2, 'p_brand', p_brand, i_p_brand, 'p_type', p_type, i_p_type) as (feature, value, idx)")
    return long.distinct().withColumn("idx", F.col("idx").cast("long"))


@query(
    "unknown_to_the_model",
    """WITH v AS (SELECT 'register' AS feature, 'EP' || user_id AS value, ts >= TIMESTAMP '2024-01-02' AS new FROM events UNION ALL SELECT 'event_type', event_type, ts >= TIMESTAMP '2024-01-02' FROM events)
    SELECT feature, value, count(*) AS n FROM v WHERE new AND (feature, value) NOT IN (SELECT (feature, value) FROM v WHERE NOT new) GROUP BY ALL""",
)
def unknown_to_the_model(spark, sf_dir):
    """Categories of later events that an encoder fitted on the first day has not seen."""
    names = ("register", "event_type")
    events = table(spark, sf_dir, "events").withColumn("register", F.concat(F.lit("EP"), F.col("user_id").cast("string")))
    later = F.col("ts") >= F.lit("2024-01-02").cast("timestamp_ntz")
    encoder = modelling.Encoder.fit(events.filter(~later), Inputs((), names))
    return quality.unseen_categories(events.filter(later), modelling.known_categories(encoder, events), list(names))


@query("leaf_quantile_ranges")
def leaf_quantile_ranges(spark, sf_dir):
    features = inputs_of(["calendar", "identity", "rotation", "rates"])
    fit, test = _parts(model_rows(spark, sf_dir))
    fit, test = (modelling.prepare_input(p, features, ["row_number", "delay_minutes"]) for p in (fit, test))
    model = modelling.LeafQuantiles.fit(fit, modelling.Encoder.fit(fit, features), "delay_minutes", MINUTES)
    return model.predict(test).select("row_number", "delay_minutes", "q10", "q50", "q90")


@query(
    "boosted_first_round",
    f"""WITH {BASE}, rows AS (SELECT row_id, split, delay_minutes::DOUBLE AS y, hour(scheduled_datetime) AS h, dayofweek(scheduled_datetime) AS d FROM base),
      start AS (SELECT unnest(range(3)) AS i, unnest(quantile_cont(y, [0.1, 0.5, 0.9])) AS b, unnest([0.1, 0.5, 0.9]) AS q FROM rows WHERE split <> 'test'),
      cells AS (SELECT i, q, f.c, f.v, count(*) AS n, sum(CASE WHEN y < b THEN 1 ELSE 0 END) - q * count(*) AS g FROM rows, start, LATERAL (VALUES (0, h), (1, d)) f(c, v) WHERE split <> 'test' GROUP BY i, q, f.c, f.v),
      sides AS (SELECT i, c, v, sum(n) OVER w AS ln, sum(g) OVER w AS lg, sum(n) OVER a - sum(n) OVER w AS rn, sum(g) OVER a - sum(g) OVER w AS rg FROM cells WINDOW w AS (PARTITION BY i, c ORDER BY v), a AS (PARTITION BY i, c)),
      cut AS (SELECT i, c, v FROM sides WHERE ln >= 20 AND rn >= 20 QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(lg * lg / ln + rg * rg / rn, 6) DESC, c, v) = 1),
      parted AS (SELECT r.*, s.i, s.b, CASE c WHEN 0 THEN h ELSE d END <= v AS low FROM rows r, start s JOIN cut USING (i)),
      leaf AS (SELECT i, low, quantile_cont(y - b, [0.1, 0.5, 0.9])[i + 1] AS step FROM parted WHERE split <> 'test' GROUP BY i, low),
      found AS (SELECT row_id, list_sort(list(b + step)) AS p FROM parted JOIN leaf USING (i, low) GROUP BY row_id)
    SELECT row_id, round(p[1], 6) AS q10, round(p[2], 6) AS q50, round(p[3], 6) AS q90 FROM found""",
)
def boosted_first_round(spark, sf_dir):
    """Boosted quantiles after one round of one split each."""
    rows = base_frame(spark, sf_dir).select("row_id", "split", "delay_minutes", F.hour(TIME).alias("hour"), F.dayofweek(TIME).alias("weekday"))
    rows = written(rows, "rows")
    once = boosting.QuantileBoostSettings(rounds=1, depth=1, step=1.0)
    model = boosting.fit_boosted(rows.filter("split <> 'test'"), ["hour", "weekday"], "delay_minutes", once)
    return _round(model.predict(rows), *boosting.PROBS).select("row_id", *boosting.PROBS)


@query("range_model_losses")
def range_model_losses(spark, sf_dir):
    """Pinball loss on held-out departures of one tree and of boosted trees."""
    features = inputs_of(["calendar", "identity", "rotation", "rates"])
    parts = _parts(model_rows(spark, sf_dir))
    fit, test = (written(modelling.prepare_input(p, features, ["row_number", "delay_minutes"]), "part") for p in parts)
    single = modelling.LeafQuantiles.fit(fit, modelling.Encoder.fit(fit, features), "delay_minutes", MINUTES).predict(test)
    orders = boosting.target_order(fit, list(features.categorical), "delay_minutes")
    names = [*features.numerical, *features.categorical]
    model = boosting.fit_boosted(boosting.scored(fit, orders), names, "delay_minutes", boosting.QuantileBoostSettings(rounds=15, depth=3, step=0.3))
    boosted = model.predict(boosting.scored(test, orders))
    loss = boosting.pinball(F.col("delay_minutes"), {q: F.col(q) for q in boosting.PROBS})
    out = [df.agg(F.lit(name).alias("model"), F.count("delay_minutes").alias("n"), F.avg(loss).alias("pinball")) for name, df in (("tree", single), ("boosted", boosted))]
    return out[0].unionByName(out[1])


def _bundle(rows, groups):
    return modelling.fit_bundle(rows, inputs_of(groups), folds=FOLDS, tree=MINUTES)


@query("scored_requests")
def scored_requests(spark, sf_dir):
    """Calibrated probability, flag and conformal range of held-out departures."""
    fit, test = _parts(model_rows(spark, sf_dir))
    bundle = _bundle(fit, ["calendar", "identity", "rotation", "rates"])
    return bundle.predict(test, ["row_number", "delay_minutes"])


@query("rolling_origin_predictions")
def rolling_origin_predictions(spark, sf_dir):
    features = inputs_of(["calendar", "rotation"])
    rows = modelling.prepare_input(model_rows(spark, sf_dir), features, ["row_number", TIME, "is_delayed"])
    rows = written(splits.rolling_folds(rows, TIME, "row_number", FOLDS), "folds")

    def step(encoder, fit, test):
        model = modelling.fit_classifier(fit, encoder, "is_delayed", modelling.LogisticSettings())
        return modelling.predict_probability(model, encoder, test, "p").select("row_number", "fold", "is_delayed", "p")

    return modelling.out_of_fold(rows, modelling.fold_encoders(rows, features, FOLDS), step)


@query("tuning_scores")
def tuning_scores(spark, sf_dir):
    features = inputs_of(["calendar", "rotation"])
    rows = modelling.prepare_input(model_rows(spark, sf_dir), features, ["row_number", TIME, "delay_minutes", "is_delayed"])
    rows = written(splits.rolling_folds(rows, TIME, "row_number", FOLDS), "folds")
    grids = {
        "range": {"depth": [2, 4, 6]},
        "boost": {"depth": [2, 3]},
        "logistic": {"c": [0.01, 0.1, 1.0, 10.0], "l1": [False]},
    }
    fixed = {"range": {"few_values": True}}
    encoders = modelling.fold_encoders(rows, features, FOLDS)  # the kinds share them
    tried = [modelling.tune(rows, features, FOLDS, grid, kind, fixed=fixed.get(kind), encoders=encoders).withColumn("kind", F.lit(kind)) for kind, grid in grids.items()]
    return reduce(lambda a, b: a.unionByName(b), tried)


@query("factor_contributions")
def factor_contributions(spark, sf_dir):
    features = inputs_of(["calendar", "identity", "rotation"])
    fit, test = _parts(model_rows(spark, sf_dir))
    fit, test = (modelling.prepare_input(p, features, ["row_number", "is_delayed"]) for p in (fit, test))
    encoder = modelling.Encoder.fit(fit, features)
    model = modelling.fit_classifier(fit, encoder, "is_delayed", modelling.LogisticSettings())
    parts = modelling.contributions(model, encoder, test, ["row_number"])
    factors = modelling.top_factors(parts, ["row_number"], 6)
    return factors.select("row_number", F.posexplode("factors").alias("rank", "f")).select("row_number", "rank", "f.feature", "f.contribution")


@query("factor_importance")
def factor_importance(spark, sf_dir):
    features = inputs_of(["calendar", "identity", "rotation"])
    rows = modelling.prepare_input(model_rows(spark, sf_dir), features, ["row_number", "is_delayed"])
    encoder = modelling.Encoder.fit(rows, features)
    model = modelling.fit_classifier(rows, encoder, "is_delayed", modelling.LogisticSettings())
    return modelling.importance(modelling.contributions(model, encoder, rows, ["row_number"]), ["row_number"])


def _boosted(spark, sf_dir):
    """A boosted classifier of late departures, its encoder and held-out rows with their explanations and log-odds."""
    features = inputs_of(["calendar", "identity", "rotation"])
    fit, test = _parts(model_rows(spark, sf_dir))
    fit, test = (modelling.prepare_input(p, features, ["row_number", "is_delayed"]) for p in (fit, test))
    encoder = modelling.Encoder.fit(fit, features)
    model = modelling.fit_classifier(fit, encoder, "is_delayed", modelling.BoostSettings())
    return model, encoder, written(test, "held-out")


@query("boosted_explanations")
def boosted_explanations(spark, sf_dir):
    """The six inputs that matter most to each score of the boosted classifier."""
    model, encoder, test = _boosted(spark, sf_dir)
    parts = explain.tree_contributions(model, encoder, test, ["row_number"]).drop("base")
    factors = modelling.top_factors(parts, ["row_number"], 6)
    return factors.select("row_number", F.posexplode("factors").alias("rank", "f")).select("row_number", "rank", "f.feature", "f.contribution")


@query("explanations_add_up", f"""WITH {BASE} SELECT count(*) AS n, count(*) AS equal FROM base WHERE scheduled_datetime >= TIMESTAMP '2024-01-24'""")
def explanations_add_up(spark, sf_dir):
    """Of the held-out departures, those whose base and contributions give the boosted classifier's own probability."""
    model, encoder, test = _boosted(spark, sf_dir)
    parts = explain.tree_contributions(model, encoder, test, ["row_number"])
    total = reduce(lambda a, b: a + b, [F.col(c) for c in parts.columns if c != "row_number"])
    own = modelling.predict_probability(model, encoder, test, "p").select("row_number", "p")
    both = parts.select("row_number", (1 / (1 + F.exp(-total))).alias("q")).join(own, "row_number")
    return both.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("p") - F.col("q")) < 1e-9).alias("equal"))


@query("ablation_report")
def ablation_report(spark, sf_dir):
    """MAE and Brier per cumulative feature set, paired against the first one."""
    fit, test = _parts(model_rows(spark, sf_dir))
    outputs = test.select("row_number", "delay_minutes", "is_delayed")
    points, classes, sets = {}, {}, growing_inputs()
    *_, every = sets.values()  # the last set has the columns of all: they are scaled once
    scales = modelling.fit_scales(modelling.prepare_input(fit, every), every.numerical)
    for i, (label, features) in enumerate(sets.items()):
        f, t = (modelling.prepare_input(p, features, ["row_number", "delay_minutes", "is_delayed"]) for p in (fit, test))
        encoder = modelling.Encoder.fit(f, features, {c: scales[c] for c in features.numerical})
        tree = modelling.LeafQuantiles.fit(f, encoder, "delay_minutes", MINUTES)
        logit = modelling.fit_classifier(f, encoder, "is_delayed", modelling.LogisticSettings())
        scored = modelling.predict_probability(logit, encoder, tree.predict(t), f"p{i}")
        scored = scored.select("row_number", F.col("q50").alias(f"m{i}"), f"p{i}", (F.col(f"p{i}") >= 0.5).cast("int").alias(f"l{i}"))
        outputs = outputs.join(scored, "row_number")
        points[label], classes[label] = (f"m{i}",), (f"l{i}", f"p{i}")
    outputs = written(outputs, "ablation")
    first = (next(iter(points)),)
    reports = []
    for columns, task, y, compared in ((points, "regression", "delay_minutes", ("mae",)), (classes, "classification", "is_delayed", ("brier",))):
        models = metrics.Models(columns, first, task, compared)
        p, d = metrics.estimates(outputs, "row_number", y, models, SAMPLES, SEED, ranked=False)
        table_ = metrics.summarize(p, d).filter(F.col("metric").isin(*compared))
        change = metrics.compare_with_best(p, d, models).select("model", "metric", "difference", "verdict")
        reports.append(table_.join(change, ["model", "metric"], "left"))
    return reports[0].unionByName(reports[1])


@query("learning_curve")
def learning_curve(spark, sf_dir):
    """Test error of the tree and of the grouped median per training window, with the paired change."""
    rows = model_rows(spark, sf_dir)
    features = inputs_of(["calendar", "identity", "rotation"])
    keep = ["row_number", "delay_minutes", TIME]
    windows, reached = splits.training_windows(rows, TIME, date(2024, 1, 24), [1, 2, 3])
    test = modelling.prepare_input(_parts(rows)[1], features, keep)
    out = None
    for w in reached:
        fit = modelling.prepare_input(windows.filter(F.col("weeks") == w), features, keep)
        model = modelling.LeafQuantiles.fit(fit, modelling.Encoder.fit(fit, features), "delay_minutes", MINUTES)
        grouped = rates.group_quantiles(fit, ["airline", "scheduled_time_of_day"], "delay_minutes", {"g": 0.5}, few_values=True)
        overall = rates.group_quantiles(fit, [], "delay_minutes", {"g": 0.5}, few_values=True)
        scored = rates.lookup_or_global(model.predict(test), grouped, overall, ["airline", "scheduled_time_of_day"], ["g"])
        models = metrics.Models({"model": ("q50",), "baseline": ("g",)}, ("baseline",), "regression", ("mae",))
        p, d = metrics.estimates(written(scored, "curve"), "row_number", "delay_minutes", models, SAMPLES, SEED, ranked=False)
        change = metrics.compare_with_best(p, d, models).select(F.lit(w).alias("weeks"), "difference", "low", "high", "verdict")
        point = p.filter("metric = 'mae'").groupBy().pivot("model", ["model", "baseline"]).agg(F.first("value"))
        line = change.withColumns({"model_mae": rates.single_row(point)["model"], "baseline_mae": rates.single_row(point)["baseline"]})
        out = line if out is None else out.unionByName(line)
    return out


@query("platt_calibrated")
def platt_calibrated(spark, sf_dir):
    rows = written(base_frame(spark, sf_dir).select("row_id", "split", "is_delayed", "p"), "probabilities")
    fitted = calibration.Calibrator.fit(rows.filter("split <> 'test'"), "is_delayed", "p", "sigmoid")
    return _round(fitted.transform(rows, "p", "calibrated"), "calibrated").select("row_id", "is_delayed", "p", "calibrated")


@query(
    "isotonic_calibrated",
    f"""WITH {BASE}, f AS (SELECT p AS x, count(*) AS n, sum(is_delayed) AS s FROM base WHERE split <> 'test' AND p IS NOT NULL GROUP BY 1),
      c AS (SELECT x, n, s, row_number() OVER (ORDER BY x) AS i, sum(n) OVER (ORDER BY x) AS cn, sum(s) OVER (ORDER BY x) AS cs FROM f),
      m AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS mean FROM c a JOIN c b ON b.i >= a.i),
      least AS (SELECT a, b AS i, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS v FROM m), rising AS (SELECT i, max(v) AS v FROM least GROUP BY i),
      points AS (SELECT x, v, lead(x) OVER (ORDER BY x) AS nx, lead(v) OVER (ORDER BY x) AS nv FROM c JOIN rising USING (i))
    SELECT row_id, is_delayed, p, round(CASE WHEN x IS NULL THEN (SELECT arg_min(v, x) FROM points) WHEN nx IS NULL THEN v ELSE v + (nv - v) * (p - x) / (nx - x) END, 6) AS calibrated
    FROM base ASOF LEFT JOIN points ON base.p >= points.x""",
)
def isotonic_calibrated(spark, sf_dir):
    """The rising function nearest to the outcomes, by pooled blocks; in SQL by the largest of the least means."""
    rows = written(base_frame(spark, sf_dir).select("row_id", "split", "is_delayed", "p"), "probabilities")
    fitted = calibration.Calibrator.fit(rows.filter("split <> 'test'"), "is_delayed", "p", "isotonic")
    return _round(fitted.transform(rows, "p", "calibrated"), "calibrated").select("row_id", "is_delayed", "p", "calibrated")


