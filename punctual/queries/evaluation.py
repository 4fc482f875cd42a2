"""Splits, baselines, metrics, bootstrap comparisons, calibration and the promotion gate."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from punctual.functions.clock import time_of_day
from punctual.functions.numeric import TARGET_TRANSFORMS, hash_uniform, late_flag, logit, ordered_range, poisson_limits
from punctual.functions.text import flight_key, slug
from punctual.operators import calibration, gate, metrics, rates, splits
from punctual.operators.ranks import rank_values
from punctual.operators.resamples import resampled_means, resamples
from punctual.plans import modelling
from punctual.queries import feeds
from punctual.queries.registry import query, table
from punctual.session import scratch_path, written
from punctual.settings import EvaluationSettings, GateSettings
from punctual.sources import predictions
from punctual.sources.store import write_splits

SAMPLES = EvaluationSettings().bootstrap_samples
SEED = 42
GROUPS = ["airline", "scheduled_time_of_day"]
TRAIN_END, VAL_END = "2024-01-21", "2024-01-24"


def _round(df, *columns):
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


# ------------------------------------------------------------------ the frame everything is scored on


def base_frame(spark, sf_dir):
    """Departed flights with a key, both targets, a split and one model's stand-in outputs."""
    rows = feeds.departed(spark, sf_dir)
    key = flight_key(F.col("airport"), F.col("flight_number"), F.col("scheduled_datetime"))
    rows = rows.withColumns(
        {
            "row_id": key,
            "scheduled_time_of_day": time_of_day(F.hour("scheduled_datetime")),
            "is_delayed": late_flag(F.col("delay_minutes")),
        }
    )
    rows = splits.time_split(rows, "scheduled_datetime", TRAIN_END, VAL_END)
    return feeds.model_outputs(rows, 7)


PROBS = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


def scored_test(spark, sf_dir):
    """Test rows with the outputs of the model and of the global and grouped baselines."""
    frame = written(base_frame(spark, sf_dir).select(
        "row_id", "airline", "scheduled_time_of_day", "split", "delay_minutes", "is_delayed", "p10", "p50", "p90", "p"
    ), "frame")
    fit, test = frame.filter("split <> 'test'"), frame.filter("split = 'test'")
    rename = {f"g_{n}": p for n, p in PROBS.items()}
    overall = rates.group_quantiles(fit, [], "delay_minutes", rename, few_values=True)
    test = test.withColumns({f"all_{n}": rates.single_row(overall)[f"g_{n}"] for n in PROBS})
    grouped = rates.group_quantiles(fit, GROUPS, "delay_minutes", rename, few_values=True)
    test = rates.lookup_or_global(test, grouped, overall, GROUPS, list(rename))
    rate = rates.group_rate(fit, ["airline"], "is_delayed", "airline_rate")
    share = fit.agg(F.avg("is_delayed").alias("airline_rate"))
    test = test.withColumn("all_rate", share.scalar())
    test = rates.lookup_or_global(test, rate, share, ["airline"], ["airline_rate"])
    label = {f"{c}_label": (F.col(c) >= 0.5).cast("int") for c in ("airline_rate", "all_rate", "p")}
    return written(test.withColumns(label), "scored")


BASE = f"""{feeds.DEPARTED}, dep AS (SELECT *, airport || '|' || flight_number || '|' || strftime(scheduled_datetime, '%Y-%m-%d %H:%M') AS row_id,
    CASE WHEN hour(scheduled_datetime) BETWEEN 5 AND 11 THEN 'Morning' WHEN hour(scheduled_datetime) BETWEEN 12 AND 16 THEN 'Afternoon'
      WHEN hour(scheduled_datetime) BETWEEN 17 AND 20 THEN 'Evening' ELSE 'Night' END AS scheduled_time_of_day,
    CASE WHEN delay_minutes > 15 THEN 1 ELSE 0 END AS is_delayed,
    CASE WHEN scheduled_datetime < TIMESTAMP '{TRAIN_END}' THEN 'train' WHEN scheduled_datetime < TIMESTAMP '{VAL_END}' THEN 'val' ELSE 'test' END AS split FROM departed),
  base AS (SELECT * FROM {feeds.model_outputs_sql('dep', 7)})"""

SCORED = f"""{BASE}, fit AS (SELECT * FROM base WHERE split <> 'test'),
  ov AS (SELECT quantile_cont(delay_minutes, 0.1) AS q1, quantile_cont(delay_minutes, 0.5) AS q5, quantile_cont(delay_minutes, 0.9) AS q9, avg(is_delayed) AS r FROM fit),
  gr AS (SELECT airline, scheduled_time_of_day, quantile_cont(delay_minutes, 0.1) AS q1, quantile_cont(delay_minutes, 0.5) AS q5, quantile_cont(delay_minutes, 0.9) AS q9 FROM fit GROUP BY ALL),
  al AS (SELECT airline, avg(is_delayed) AS r FROM fit GROUP BY 1),
  scored AS (SELECT t.row_id, t.delay_minutes, t.is_delayed, t.p10, t.p50, t.p90, t.p, ov.q1 AS all_p10, ov.q5 AS all_p50, ov.q9 AS all_p90,
    coalesce(gr.q1, ov.q1) AS g_p10, coalesce(gr.q5, ov.q5) AS g_p50, coalesce(gr.q9, ov.q9) AS g_p90, coalesce(al.r, ov.r) AS airline_rate, ov.r AS all_rate,
    CASE WHEN coalesce(al.r, ov.r) >= 0.5 THEN 1 ELSE 0 END AS airline_rate_label, CASE WHEN ov.r >= 0.5 THEN 1 ELSE 0 END AS all_rate_label, CASE WHEN t.p >= 0.5 THEN 1 ELSE 0 END AS p_label
  FROM base t CROSS JOIN ov LEFT JOIN gr ON gr.airline IS NOT DISTINCT FROM t.airline AND gr.scheduled_time_of_day = t.scheduled_time_of_day
  LEFT JOIN al ON al.airline IS NOT DISTINCT FROM t.airline WHERE t.split = 'test')"""


def drawn_sql(source: str, samples: int = SAMPLES) -> str:
    """CTE `drawn`: each row per replicate b it is drawn in, with its weight w."""
    weight = " ".join(f"WHEN x < '{limit}' THEN {k}" for k, limit in enumerate(poisson_limits()))
    hashes = f"SELECT t.*, k, md5('{SEED}|' || row_id || '|' || k) AS h FROM {source} t, range(0, {-(-samples // 4)}) r(k)"
    chunks = f"SELECT * EXCLUDE (h, k, i), k * 4 + i AS b, substr(h, CAST(1 + 8 * i AS INTEGER), 8) AS x FROM ({hashes}), range(0, 4) s(i)"
    return f"""drawn AS (SELECT * FROM (SELECT *, CASE {weight} ELSE {len(poisson_limits())} END AS w FROM ({chunks})) WHERE w > 0 AND b < {samples})"""


REGRESSION = metrics.Models({"global": ("all_p50",), "grouped": ("g_p50",), "model": ("p50",)}, ("global", "grouped"), "regression", ("mae",))
CLASSES = metrics.Models(
    {"majority": ("all_rate_label", "all_rate"), "airline": ("airline_rate_label", "airline_rate"), "model": ("p_label", "p")},
    ("majority", "airline"), "classification", ("brier", "pr_auc"),
)
RANGES = metrics.Models(
    {"global": ("all_p10", "all_p50", "all_p90"), "grouped": ("g_p10", "g_p50", "g_p90"), "model": ("p10", "p50", "p90")},
    ("global", "grouped"), "intervals", ("pinball",),
)


def _pieces(models):
    """Per model: (name, point expressions) in SQL; `{w}` is the weight, 1 for the point estimate."""
    out = {}
    for name, cols in models.columns.items():
        if models.task == "regression":
            e = f"abs(delay_minutes - {cols[0]})"
            out[name] = {"mae": e, "within_15": f"CASE WHEN {e} <= 15 THEN 1.0 ELSE 0.0 END"}
        elif models.task == "classification":
            label, p = cols
            out[name] = {
                "accuracy": f"CASE WHEN {label} = is_delayed THEN 1.0 ELSE 0.0 END",
                "precision": f"CASE WHEN {label} = 1 THEN is_delayed END",
                "recall": f"CASE WHEN is_delayed = 1 THEN {label} END",
                "brier": f"({p} - is_delayed) * ({p} - is_delayed)",
            }
        else:
            loss = " + ".join(f"greatest({q} * (delay_minutes - {c}), ({q} - 1) * (delay_minutes - {c}))" for c, q in zip(cols, (0.1, 0.5, 0.9)))
            out[name] = {
                "coverage": f"CASE WHEN delay_minutes BETWEEN {cols[0]} AND {cols[2]} THEN 1.0 ELSE 0.0 END",
                "width": f"{cols[2]} - {cols[0]}",
                "pinball": f"({loss}) / 3",
            }
    return out


def _means_sql(models) -> str:
    """CTEs `points` (model, metric, value) and `draws` (b, model, metric, value) of the mean-type metrics."""
    each = [(m, k, e) for m, terms in _pieces(models).items() for k, e in terms.items()]
    point = " UNION ALL ".join(f"SELECT '{m}' AS model, '{k}' AS metric, CAST(avg({e}) AS DOUBLE) AS value FROM scored" for m, k, e in each)
    aggs = ", ".join(f"sum(w * CAST({e} AS DOUBLE)) / sum(CASE WHEN {e} IS NOT NULL THEN w END) AS c{i}" for i, (_, _, e) in enumerate(each))
    unpivot = " UNION ALL ".join(f"SELECT b, '{m}' AS model, '{k}' AS metric, c{i} AS value FROM wide" for i, (m, k, _) in enumerate(each))
    return f"{drawn_sql('scored')}, points0 AS ({point}), wide AS (SELECT b, {aggs} FROM drawn GROUP BY b), draws0 AS ({unpivot})"


def _ranked_sql(models) -> str:
    """The same for median error, average precision and calibration error."""
    points, draws = ["SELECT * FROM points0"], ["SELECT * FROM draws0"]
    for m, cols in models.columns.items():
        if models.task == "regression":
            e = f"abs(delay_minutes - {cols[0]})"
            points.append(f"SELECT '{m}', 'medae', median({e}) FROM scored")
            # repeat each row w times: the weighted median is the median of the repeated rows
            draws.append(f"SELECT b, '{m}', 'medae', median(e) FROM (SELECT b, {e} AS e, unnest(range(0, w)) FROM drawn) GROUP BY b")
        elif models.task == "classification":
            s = cols[1]
            for source, w, by, out in (("scored", "1", "", points), ("drawn", "w", "b, ", draws)):
                part = "PARTITION BY b" if by else ""
                grp = "GROUP BY b" if by else ""
                curve = f"SELECT {by}{s} AS s, sum({w}) AS n, sum({w} * is_delayed) AS pos FROM {source} GROUP BY ALL"
                run = f"SELECT *, sum(n) OVER ({part} ORDER BY s DESC) AS rn, sum(pos) OVER ({part} ORDER BY s DESC) AS rp, sum(n) OVER ({part}) AS tn, sum(pos) OVER ({part}) AS tp FROM ({curve})"
                out.append(f"SELECT {by}'{m}', 'pr_auc', CASE WHEN max(tp) > 0 AND max(tp) < max(tn) THEN sum(pos / nullif(tp, 0) * rp / rn) END FROM ({run}) {grp}")
                bins = f"SELECT {by}least(CAST(floor({s} * 10) AS INTEGER), 9) AS bin, sum({w} * {s}) AS sp, sum({w} * is_delayed) AS sy, sum({w}) AS n FROM {source} GROUP BY ALL"
                out.append(f"SELECT {by}'{m}', 'ece', sum(abs(sp / n - sy / n) * n) / sum(n) FROM ({bins}) {grp}")
    return f"points AS ({' UNION ALL '.join(points)}), draws AS ({' UNION ALL '.join(draws)})"


def _report_sql(models) -> str:
    return f"""WITH {SCORED}, {_means_sql(models)}, {_ranked_sql(models)},
    spans AS (SELECT model, metric, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM draws WHERE value IS NOT NULL GROUP BY ALL)
    SELECT p.model, p.metric, round(p.value, 6) AS point, round(s.low, 6) AS low, round(s.high, 6) AS high FROM points p LEFT JOIN spans s USING (model, metric)"""


def _compare_sql(models) -> str:
    listed = ", ".join(f"'{m}'" for m in models.compare)
    bases = ", ".join(f"'{b}'" for b in models.baselines)
    lower = ", ".join(f"('{k}', {'1' if v else '-1'})" for k, v in metrics.DIRECTIONS.items())
    return f"""WITH {SCORED}, {_means_sql(models)}, {_ranked_sql(models)}, sides(metric, sgn) AS (VALUES {lower}),
    toppers AS (SELECT metric, model AS baseline, value AS bv, sgn FROM points JOIN sides USING (metric) WHERE model IN ({bases}) AND metric IN ({listed})
      QUALIFY row_number() OVER (PARTITION BY metric ORDER BY sgn * value, model) = 1),
    d AS (SELECT x.model, baseline, x.metric, sgn, x.value - y.value AS d FROM draws x JOIN toppers ON toppers.metric = x.metric
      JOIN draws y ON y.metric = x.metric AND y.b = x.b AND y.model = toppers.baseline WHERE x.model NOT IN ({bases})),
    spans AS (SELECT model, baseline, metric, sgn, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM d WHERE d IS NOT NULL GROUP BY ALL)
    SELECT s.model, s.baseline, s.metric, round(p.value - b.bv, 6) AS difference, round(s.low, 6) AS low, round(s.high, 6) AS high,
      CASE WHEN s.low <= 0 AND s.high >= 0 THEN 'no evidence' WHEN (s.high < 0) = (s.sgn = 1) THEN 'better' ELSE 'worse' END AS verdict
    FROM spans s JOIN points p ON p.model = s.model AND p.metric = s.metric JOIN toppers b ON b.metric = s.metric"""


def _y(models):
    return "is_delayed" if models.task == "classification" else "delay_minutes"


def _estimates(spark, sf_dir, models):
    return metrics.estimates(scored_test(spark, sf_dir), "row_id", _y(models), models, SAMPLES, SEED)


def _report(spark, sf_dir, models):
    return _round(metrics.summarize(*_estimates(spark, sf_dir, models)), "point", "low", "high")


def _comparison(spark, sf_dir, models):
    return _round(metrics.compare_with_best(*_estimates(spark, sf_dir, models), models), "difference", "low", "high")


for _name, _models in (("regression", REGRESSION), ("classification", CLASSES), ("interval", RANGES)):
    query(f"{_name}_report", _report_sql(_models))(lambda spark, sf_dir, m=_models: _report(spark, sf_dir, m))
    query(f"{_name}_comparison", _compare_sql(_models))(lambda spark, sf_dir, m=_models: _comparison(spark, sf_dir, m))


@query(
    "metric_export",
    f"""WITH {SCORED}, {_means_sql(RANGES)}, {_ranked_sql(RANGES)},
    spans AS (SELECT model, metric, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM draws GROUP BY ALL),
    r AS (SELECT 'test/' || p.model || '/' || p.metric AS k, p.value, s.low, s.high FROM points p JOIN spans s USING (model, metric))
    SELECT k AS name, round(value, 6) AS value FROM r UNION ALL SELECT k || '_low', round(low, 6) FROM r UNION ALL SELECT k || '_high', round(high, 6) FROM r""",
)
def metric_export(spark, sf_dir):
    flat = metrics.metric_names(metrics.summarize(*_estimates(spark, sf_dir, RANGES)))
    return _round(flat, "value")


@query(
    "offline_lookup",
    f"""WITH {SCORED}, {_means_sql(RANGES)} SELECT round(max(value) FILTER (model = 'model' AND metric = 'coverage'), 6) AS offline_coverage,
      round(max(value) FILTER (model = 'model' AND metric = 'pinball'), 6) AS offline_pinball, CAST(NULL AS DOUBLE) AS offline_mae FROM points0""",
)
def offline_lookup(spark, sf_dir):
    flat = metrics.metric_names(metrics.summarize(*_estimates(spark, sf_dir, RANGES)))
    names = {"offline_coverage": "test/model/coverage", "offline_pinball": "test/model/pinball", "offline_mae": "test/model/mae_min"}
    return _round(metrics.offline_numbers(flat, names), *names)


@query(
    "bootstrap_draws",
    f"WITH {BASE}, ids AS (SELECT row_id FROM base WHERE split = 'test'), {drawn_sql('ids')} SELECT b, CAST(sum(w) AS BIGINT) AS rows_drawn, count(*) AS distinct_rows, max(w) AS most FROM drawn GROUP BY b",
)
def bootstrap_draws(spark, sf_dir):
    ids = base_frame(spark, sf_dir).filter("split = 'test'").select("row_id")
    drawn = metrics.replicates(ids, "row_id", SAMPLES, SEED).groupBy(F.col("replicate").alias("b"))
    return drawn.agg(F.sum("times").alias("rows_drawn"), F.count(F.lit(1)).alias("distinct_rows"), F.max("times").alias("most"))


@query(
    "resampled_rows",
    f"WITH {BASE}, t AS (SELECT count(*) AS n FROM base WHERE split = 'test') SELECT CAST(b AS INTEGER) AS replicate, CAST(n AS BIGINT) AS rows_drawn FROM t, range({SAMPLES}) r(b) WHERE n > 0",
)
def resampled_rows(spark, sf_dir):
    ids = base_frame(spark, sf_dir).filter("split = 'test'").select("row_id")
    return resamples(ids, "row_id", SAMPLES, SEED).groupBy("replicate").agg(F.sum("times").alias("rows_drawn"))


@query("resampled_errors")
def resampled_errors(spark, sf_dir):
    """Mean absolute errors of the model and of the grouped baseline over exact resamples, and how much less the model's is, with intervals."""
    error = lambda c: F.abs(F.col("delay_minutes") - F.col(c))
    rows = written(scored_test(spark, sf_dir).select("row_id", error("p50").alias("model"), error("g_p50").alias("grouped")), "errors")
    drawn = resampled_means(rows, "row_id", ["model", "grouped"], SAMPLES, SEED).withColumn("gain", F.col("grouped") - F.col("model"))
    long = drawn.select(F.explode(F.map_from_arrays(*[F.array(*[make(c) for c in ("model", "grouped", "gain")]) for make in (F.lit, F.col)])).alias("name", "x"))
    found = long.groupBy("name").agg(F.avg("x").alias("mean"), *metrics.interval("x"))
    return _round(found, "mean", "low", "high")


# ------------------------------------------------------------------ baselines


@query(
    "group_quantiles_events",
    """SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, count(*) AS n FROM events GROUP BY 1""",
)
def group_quantiles_events(spark, sf_dir):
    found = rates.group_quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", PROBS)
    return _round(found, *PROBS)


@query(
    "price_quantiles",
    """SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def price_quantiles(spark, sf_dir):
    found = rates.group_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", PROBS)
    return _round(found, *PROBS)


@query(
    "baseline_predictions",
    f"WITH {SCORED} SELECT row_id, round(all_p50, 6) AS all_p50, round(g_p10, 6) AS g_p10, round(g_p50, 6) AS g_p50, round(g_p90, 6) AS g_p90, round(airline_rate, 6) AS airline_rate, round(all_rate, 6) AS all_rate, airline_rate_label, all_rate_label FROM scored",
)
def baseline_predictions(spark, sf_dir):
    shown = ["all_p50", "g_p10", "g_p50", "g_p90", "airline_rate", "all_rate"]
    return _round(scored_test(spark, sf_dir).select("row_id", *shown, "airline_rate_label", "all_rate_label"), *shown)


@query(
    "source_quality_rate",
    """WITH j AS (SELECT source, lang, quality FROM documents JOIN labels USING (doc_id)) SELECT source, lang, round(avg(quality), 6) AS rate, count(*) AS n FROM j GROUP BY ALL""",
)
def source_quality_rate(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return _round(rates.group_rate(rows, ["source", "lang"], "quality"), "rate")


# ------------------------------------------------------------------ splits


@query(
    "split_summary",
    f"WITH {BASE} SELECT split, count(*) AS n, strftime(min(scheduled_datetime), '%Y-%m-%d %H:%M:%S') AS first_time, strftime(max(scheduled_datetime), '%Y-%m-%d %H:%M:%S') AS last_time FROM base GROUP BY 1",
)
def split_summary(spark, sf_dir):
    rows = written(base_frame(spark, sf_dir).select("split", "scheduled_datetime"), "split-times")
    splits.check_split(rows, "scheduled_datetime")
    found = splits.split_summary(rows, "scheduled_datetime")
    return found.select("split", "n", feeds.stamp("first_time"), feeds.stamp("last_time"))


@query(
    "recent_dates_split",
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders ORDER BY d DESC LIMIT 5), c AS (SELECT (SELECT min(d) FROM d) AS a, (SELECT min(d) FROM (SELECT d FROM d ORDER BY d DESC LIMIT 3)) AS b)
    SELECT CASE WHEN o_orderdate < a THEN 'train' WHEN o_orderdate < b THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM orders, c GROUP BY 1""",
)
def recent_dates_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    a, b = splits.recent_cut_dates(orders, "o_orderdate", 3, 2)
    return splits.time_split(orders, "o_orderdate", a, b).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "rolling_folds",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders),
    f AS (SELECT *, n // 5 AS size FROM r)
    SELECT CASE WHEN rn < n - 4 * size THEN 0 ELSE (rn - (n - 4 * size)) // size + 1 END AS fold, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM f GROUP BY 1""",
)
def rolling_folds(spark, sf_dir):
    folds = splits.rolling_folds(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", 4)
    return folds.groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query(
    "reference_sample",
    """SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 200""",
)
def reference_sample(spark, sf_dir):
    return splits.sample_rows(table(spark, sf_dir, "documents"), "doc_id", 200, SEED).select("doc_id")


@query(
    "sampled_share",
    f"""SELECT o_orderkey FROM orders WHERE {feeds.uniform_sql(42, 'o_orderkey')} < 0.1""",
)
def sampled_share(spark, sf_dir):
    return splits.sample_share(table(spark, sf_dir, "orders"), "o_orderkey", 0.1, SEED).select("o_orderkey")


@query(
    "random_split",
    f"""SELECT CASE WHEN {feeds.uniform_sql(42, 'event_id')} < 0.2 THEN 'test' ELSE 'train' END AS split, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1""",
)
def random_split(spark, sf_dir):
    return splits.random_split(table(spark, sf_dir, "events"), "event_id", 0.2, SEED).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")
    )


@query(
    "training_windows",
    f"""WITH {feeds.DEPARTED}, w(weeks) AS (VALUES (1), (2), (3), (8)), x AS (SELECT weeks, d.* FROM w, departed d WHERE scheduled_datetime >= TIMESTAMP '2024-01-24' - to_days(weeks * 7) AND scheduled_datetime < TIMESTAMP '2024-01-24')
    SELECT weeks, count(*) AS n, round(avg(delay_minutes), 6) AS mean_delay FROM x GROUP BY weeks HAVING min(scheduled_datetime) <= TIMESTAMP '2024-01-24' - to_days(weeks * 7) + INTERVAL 3 DAY""",
)
def training_windows(spark, sf_dir):
    windows, _ = splits.training_windows(feeds.departed(spark, sf_dir), "scheduled_datetime", date(2024, 1, 24), [1, 2, 3, 8])
    return windows.groupBy("weeks").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("delay_minutes"), 6).alias("mean_delay"))


# ------------------------------------------------------------------ calibration, thresholds, ranges


@query(
    "calibration_table",
    f"WITH {BASE} SELECT split, least(CAST(floor(p * 10) AS INTEGER), 9) AS bin, round(avg(p), 6) AS predicted, round(avg(is_delayed), 6) AS observed, count(*) AS n FROM base GROUP BY ALL",
)
def calibration_table(spark, sf_dir):
    found = metrics.calibration_table(base_frame(spark, sf_dir), ["split"], "is_delayed", "p")
    return _round(found, "predicted", "observed")


@query(
    "label_average_precision",
    f"""WITH s AS (SELECT source, toxic, round({feeds.uniform_sql(3, 'doc_id')} * 0.6 + toxic * 0.3, 3) AS score FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT source, score, count(*) AS n, sum(toxic) AS pos FROM s GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY score DESC) AS rn, sum(pos) OVER (PARTITION BY source ORDER BY score DESC) AS rp, sum(n) OVER (PARTITION BY source) AS tn, sum(pos) OVER (PARTITION BY source) AS tp FROM c)
    SELECT source, round(CASE WHEN max(tp) > 0 AND max(tp) < max(tn) THEN sum(pos / nullif(tp, 0) * rp / rn) END, 6) AS pr_auc FROM r GROUP BY 1""",
)
def label_average_precision(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.withColumn("score", F.round(hash_uniform(3, F.col("doc_id")) * 0.6 + F.col("toxic") * 0.3, 3))
    return _round(metrics.average_precision(rows, ["source"], "toxic", "score"), "pr_auc")


@query(
    "conformal_range",
    f"""WITH {BASE}, s AS (SELECT greatest(p10 - delay_minutes, delay_minutes - p90) AS score FROM base WHERE split = 'val'),
    c AS (SELECT count(*) AS n, least(1.0, ceil((count(*) + 1) * 0.8) / count(*)) AS level FROM s),
    m AS (SELECT score AS margin FROM (SELECT score, row_number() OVER (ORDER BY score) - 1 AS rn FROM s), c WHERE rn = ceil((n - 1) * level)),
    t AS (SELECT delay_minutes, least(list_sort([p10, p50, p90])[1] - margin, list_sort([p10, p50, p90])[2]) AS low, greatest(list_sort([p10, p50, p90])[3] + margin, list_sort([p10, p50, p90])[2]) AS high, margin FROM base, m WHERE split = 'test')
    SELECT round(max(margin), 6) AS margin, count(*) AS n, round(avg(CASE WHEN delay_minutes BETWEEN low AND high THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(high - low), 6) AS width FROM t""",
)
def conformal_range(spark, sf_dir):
    rows = written(base_frame(spark, sf_dir).select("split", "delay_minutes", "p10", "p50", "p90"), "ranges")
    margin = calibration.conformal_margin(rows.filter("split = 'val'"), "delay_minutes", "p10", "p90", 0.8)
    low, mid, high = ordered_range(F.col("p10"), F.col("p50"), F.col("p90"), margin)
    test = rows.filter("split = 'test'").withColumns({"low": low, "mid": mid, "high": high})
    terms = metrics.range_terms(F.col("delay_minutes"), F.col("low"), F.col("mid"), F.col("high"))
    return test.agg(
        F.round(F.lit(margin), 6).alias("margin"),
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(terms["coverage"]), 6).alias("coverage"),
        F.round(F.avg(terms["width"]), 6).alias("width"),
    )


_CHOSEN = f"""v AS (SELECT round_even(p, 4) AS t, p, is_delayed FROM base WHERE split <> 'test'), ts AS (SELECT DISTINCT t FROM v),
    f AS (SELECT ts.t, count(*) AS flagged, avg(is_delayed) AS precision FROM ts JOIN v ON v.p >= ts.t GROUP BY 1), c AS (SELECT min(t) AS t FROM f WHERE flagged >= 20 AND precision >= 0.75)"""


@query(
    "decision_threshold",
    f"WITH {BASE}, {_CHOSEN} SELECT round(coalesce(t, 0.5), 6) AS threshold, CASE WHEN t IS NULL THEN 0 ELSE 1 END AS reached FROM c",
)
def decision_threshold(spark, sf_dir):
    rows = base_frame(spark, sf_dir).filter("split <> 'test'")
    found = calibration.choose_threshold(rows, "is_delayed", "p", 0.75)
    return found.select(F.round("threshold", 6).alias("threshold"), F.col("reached").cast("int").alias("reached"))


@query(
    "threshold_report",
    f"""WITH {BASE}, {_CHOSEN}, x AS (SELECT base.*, p >= coalesce(t, 0.5) AS flag FROM base, c)
    SELECT split, round(avg(CASE WHEN flag THEN is_delayed END), 6) AS precision, round(avg(CASE WHEN is_delayed = 1 THEN CAST(flag AS INTEGER) END), 6) AS recall, round(avg(CAST(flag AS INTEGER)), 6) AS flagged FROM x GROUP BY 1""",
)
def threshold_report(spark, sf_dir):
    rows = written(base_frame(spark, sf_dir).select("split", "is_delayed", "p"), "probabilities")
    chosen = calibration.choose_threshold(rows.filter("split <> 'test'"), "is_delayed", "p", 0.75).first()["threshold"]
    return _round(calibration.threshold_report(rows, "is_delayed", "p", chosen, ["split"]), "precision", "recall", "flagged")


@query(
    "target_transforms",
    """SELECT event_id, round(ln(value + 61), 6) AS log_target, round(least(value, 300.0), 6) AS clipped, round(value, 6) AS back,
      round(ln(greatest(least(value / 100, 1 - 1e-6), 1e-6) / (1 - greatest(least(value / 100, 1 - 1e-6), 1e-6))), 5) AS log_odds FROM events""",
)
def target_transforms(spark, sf_dir):
    y = F.col("value")
    forward, backward = TARGET_TRANSFORMS["log"]
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.round(forward(y), 6).alias("log_target"),
        F.round(TARGET_TRANSFORMS["clip_300"][0](y), 6).alias("clipped"),
        F.round(backward(forward(y)), 6).alias("back"),
        F.round(logit(y / 100), 5).alias("log_odds"),
    )


@query(
    "metric_slugs",
    """SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ') × ' || p_type), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part""",
)
def metric_slugs(spark, sf_dir):
    text = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(") × "), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", slug(text).alias("slug"))


@query(
    "order_statistics",
    """SELECT rn AS rank, round(o_totalprice, 6) AS value FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) - 1 AS rn FROM orders) WHERE rn IN (0, 10, 777, 1499)""",
)
def order_statistics(spark, sf_dir):
    found = rank_values(table(spark, sf_dir, "orders"), "o_totalprice", [0, 10, 777, 1499])
    return found.select("rank", F.round("value", 6).alias("value"))


@query(
    "rolling_origin_baseline",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS rn, count(*) OVER () // 5 AS size, count(*) OVER () AS n FROM orders),
    f AS (SELECT *, CASE WHEN rn < n - 4 * size THEN 0 ELSE (rn - (n - 4 * size)) // size + 1 END AS fold, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS y FROM r),
    g AS (SELECT k.fold, f.o_orderpriority, avg(y) AS p FROM f JOIN (VALUES (1), (2), (3), (4)) k(fold) ON f.fold < k.fold GROUP BY ALL)
    SELECT f.fold, f.o_orderpriority AS priority, count(*) AS n, round(avg(p), 6) AS p, round(avg((p - y) ** 2), 6) AS brier FROM f JOIN g ON g.fold = f.fold AND g.o_orderpriority = f.o_orderpriority GROUP BY ALL""",
)
def rolling_origin_baseline(spark, sf_dir):
    """Every fold scored by the group rates of the folds before it."""
    orders = table(spark, sf_dir, "orders").withColumn("y", (F.col("o_totalprice") > 250000).cast("int"))
    rows = written(splits.rolling_folds(orders, "o_orderdate", "o_orderkey", 4), "folds")
    out = None
    for i in range(1, 5):
        fit, test = rows.filter(F.col("fold") < i), rows.filter(F.col("fold") == i)
        rate = rates.group_rate(fit, ["o_orderpriority"], "y", "p")
        scored = rates.lookup_or_global(test, rate, fit.agg(F.avg("y").alias("p")), ["o_orderpriority"], ["p"])
        out = scored if out is None else out.unionByName(scored)
    grouped = out.groupBy("fold", F.col("o_orderpriority").alias("priority"))
    found = grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))
    return _round(found, "p", "brier")


@query(
    "split_files",
    f"WITH {BASE} SELECT split, count(*) AS n, round(avg(delay_minutes), 6) AS mean_delay FROM base GROUP BY 1",
)
def split_files(spark, sf_dir):
    """Splits handed over as one Parquet folder each."""
    path = scratch_path(spark, "splits")
    write_splits(base_frame(spark, sf_dir).select("row_id", "split", "delay_minutes"), path)
    back = spark.read.parquet(path).groupBy("split")
    return _round(back.agg(F.count(F.lit(1)).alias("n"), F.avg("delay_minutes").alias("mean_delay")), "mean_delay")


@query(
    "drift_reference",
    f"""WITH {BASE} SELECT row_id FROM base WHERE scheduled_datetime BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' ORDER BY md5('42|' || row_id), row_id LIMIT 150""",
)
def drift_reference(spark, sf_dir):
    """A sample of training rows inside a model's window, both ends included."""
    first, last = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-05", "2024-01-20"))
    rows = written(base_frame(spark, sf_dir).select("row_id", "scheduled_datetime"), "frame")
    return predictions.drift_reference(rows, "scheduled_datetime", "row_id", first, last, 150, SEED).select("row_id")


@query(
    "largest_line_parts",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, unnest(list_sort([{'o': -abs(l_quantity - 25), 'f': 'l_quantity', 'v': round(l_quantity - 25, 3)}, {'o': -abs((l_discount - 0.05) * 500), 'f': 'l_discount', 'v': round((l_discount - 0.05) * 500, 3)},
      {'o': -abs((l_tax - 0.04) * 600), 'f': 'l_tax', 'v': round((l_tax - 0.04) * 600, 3)}])[1:2]) AS s FROM lineitem)
    SELECT s.f AS feature, count(*) AS n, round(sum(abs(s.v)), 3) AS total FROM x GROUP BY 1""",
)
def largest_line_parts(spark, sf_dir):
    """The two largest of three contributions of every order line, counted by feature."""
    parts = {"l_quantity": F.col("l_quantity") - 25, "l_discount": (F.col("l_discount") - 0.05) * 500, "l_tax": (F.col("l_tax") - 0.04) * 600}
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    lines = table(spark, sf_dir, "lineitem").select(*keys, *[c.alias(n) for n, c in parts.items()])
    top = modelling.top_factors(lines, keys, 2).select(F.explode("factors").alias("f")).select("f.*")
    return top.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.abs("contribution")), 3).alias("total"))


# ------------------------------------------------------------------ gate


def gate_frame(spark, sf_dir):
    """Held-out rows with two models and the grouped baseline."""
    test = scored_test(spark, sf_dir).select("row_id", F.col("delay_minutes").alias("y"), F.col("is_delayed").alias("delayed"), "g_p50", "p10", "p50", "p90", "p")
    y, u = F.col("y"), hash_uniform(11, F.col("row_id"))
    return test.select(
        "row_id",
        "y",
        "delayed",
        F.col("g_p50").alias("baseline_p50"),
        F.col("p50").alias("champion_p50"),
        F.col("p").alias("champion_p"),
        (y + u * 20 - 10).alias("challenger_p50"),
        F.col("p10").alias("challenger_p10"),
        (F.col("p90") + 20).alias("challenger_p90"),
        (F.col("p") * 0.9 + F.col("delayed") * 0.1).alias("challenger_p"),
    )


_GATE = f"""{SCORED}, gf AS (SELECT row_id, delay_minutes AS y, is_delayed AS delayed, g_p50 AS baseline_p50, p50 AS champion_p50, p AS champion_p,
      delay_minutes + {feeds.uniform_sql(11, 'row_id')} * 20 - 10 AS challenger_p50, p10 AS challenger_p10, p90 + 20 AS challenger_p90, p * 0.9 + is_delayed * 0.1 AS challenger_p FROM scored),
    {drawn_sql('gf')}, dd AS (SELECT b, sum(w * (abs(y - challenger_p50) - abs(y - champion_p50))) / sum(w) AS a, sum(w * (abs(y - challenger_p50) - abs(y - baseline_p50))) / sum(w) AS c FROM drawn GROUP BY b),
    s AS (SELECT quantile_cont(a, 0.975) AS a_high, quantile_cont(c, 0.975) AS c_high FROM dd),
    n AS (SELECT count(*) AS n, avg((challenger_p - delayed) * (challenger_p - delayed)) - avg((champion_p - delayed) * (champion_p - delayed)) AS rise, avg(CASE WHEN y BETWEEN challenger_p10 AND challenger_p90 THEN 1.0 ELSE 0.0 END) AS cov FROM gf),
    listed AS (SELECT 0 AS ord, 'enough held-out rows' AS rule, CAST(n AS DOUBLE) AS value, n >= 100 AS ok FROM n
      UNION ALL SELECT 1, 'MAE better than champion beyond noise', a_high, a_high < 0 FROM s
      UNION ALL SELECT 2, 'MAE better than baseline beyond noise', c_high, c_high < 0 FROM s
      UNION ALL SELECT 3, 'calibration not worse than champion', rise, rise <= 0.005 FROM n
      UNION ALL SELECT 4, 'range coverage within limits', cov, cov BETWEEN 0.7 AND 0.9 FROM n),
    checks AS (SELECT * FROM listed WHERE ord = 0 OR (SELECT n.n FROM n) >= 100)"""


def _gate_checks(spark, sf_dir):
    numbers = gate.gate_numbers(gate_frame(spark, sf_dir), "row_id", SAMPLES, SEED)
    return gate.gate_checks(numbers, GateSettings())


@query("gate_checks", f"WITH {_GATE} SELECT ord, rule, round(value, 6) AS value, CAST(ok AS INTEGER) AS passed FROM checks")
def gate_checks(spark, sf_dir):
    return _round(_gate_checks(spark, sf_dir), "value").withColumn("passed", F.col("passed").cast("int"))


@query("gate_decision", f"WITH {_GATE} SELECT count(*) AS checks, count(*) FILTER (ok) AS passed, CASE WHEN bool_and(ok) THEN 'promote' ELSE 'reject' END AS decision FROM checks")
def gate_decision(spark, sf_dir):
    return gate.gate_decision(_gate_checks(spark, sf_dir))

