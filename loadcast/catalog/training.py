"""Queries on loads, features, splits and models."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.catalog import views as V
from loadcast.catalog.registry import query, rounded, sql_round
from loadcast.catalog.views import with_views
from loadcast.functions.calendar import (
    days_in_month,
    days_in_year,
    month_start,
    next_month_start,
    representative_time,
    weekday_count,
)
from loadcast.operators import crosscheck, mlp
from loadcast.operators import training as networks
from loadcast.operators.features import (
    cooling_profile,
    cyclic_season,
    month_hour_mean,
    previous_hour,
    previous_hour_wrapped,
    projection_features,
    training_table,
)
from loadcast.operators.metrics import correlation_matrix, regression_metrics, trend_line
from loadcast.operators.reshape import strip_text
from loadcast.operators.scaling import bounds, ordered_split, scale
from loadcast.params import FEATURES, LABEL, LAGGED
from loadcast.plans import charts, forecast, study
from loadcast.sources.scratch import materialize, scratch_path

LOCATIONS = ["jkt", "smg"]
TRAINING_YEARS = {"jkt": 1997, "smg": 1998}
COLUMNS = [*FEATURES, LABEL]

_SEASON = "case when month(time) between 5 and 10 then 1.0 else 0.0 end"
_CYCLE = f"{_SEASON} as dry, sin(2 * pi() * hour(time) / 24) as xhour, cos(2 * pi() * hour(time) / 24) as yhour"
_LAGS = ", ".join(f"lag({c}) over w as ph_{c}" for c in LAGGED)
TRAINING_SQL = {
    "TR": f"""select t.*, {_CYCLE.replace("(time)", "(t.time)")}, B.avg_cooling_load
from (select *, {_LAGS} from T window w as (partition by location order by time)) t
left join B on B.location = t.location and B.time = t.time""",
}
SPLIT_SQL = {
    **TRAINING_SQL,
    "N": "select *, row_number() over (partition by location order by time) as row, count(*) over (partition by location) as n"
    " from TR where " + " and ".join(f"{c} is not null" for c in COLUMNS),
    "C": "select *, floor(n * 2 / 3) as cut, floor(floor(n * 2 / 3) * 0.8 + 1e-9) as fit from N",
    "SP": "select *, case when row <= fit then 'fit' when row <= cut then 'val' else 'test' end as part from C",
}
LIMITS_SQL = {
    **SPLIT_SQL,
    "LI": "select location, "
    + ", ".join(f"min({c}) as min_{c}, max({c}) as max_{c}" for c in COLUMNS)
    + " from SP where part <> 'test' group by location",
}


def scaled_sql(columns: list[str], fill: bool = False) -> dict[str, str]:
    out = {c: f"({c} - min_{c}) / nullif(max_{c} - min_{c}, 0)" for c in columns}
    return {c: f"coalesce({e}, 0)" for c, e in out.items()} if fill else out


def full_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_table(V.month_weather(spark, sf_dir), V.mean_load(spark, sf_dir))


_WEEKDAYS = (
    "len(list_filter(generate_series(date_trunc('month', time), date_trunc('month', time) + interval 1 month,"
    " interval 1 day), lambda d: dayofweek(d) not in (0, 6)))"
)
_MONTH_DAYS = "day(last_day(cast(time as date)))"
_SHEET = f"""select location, {V._STAMP.format(y="year", m="month", h="hour")} as time,
 max(case when kind = 'Weekend' then load_kw end) as "Weekend", max(case when kind = 'Weekday' then load_kw end) as "Weekday"
from L group by 1, 2"""


@query(
    "cooling_profile",
    with_views(
        "L",
        "select location, time, "
        + sql_round(
            {
                "Weekend": '"Weekend"',
                "Weekday": '"Weekday"',
                LABEL: f'("Weekday" * {_WEEKDAYS} + "Weekend" * ({_MONTH_DAYS} - {_WEEKDAYS})) / {_MONTH_DAYS}',
            }
        )
        + " from K",
        {"K": _SHEET},
    ),
)
def cooling_profile_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cooling_profile(V.load_sheet(spark, sf_dir)))


@query(
    "load_cooling_sheet",
    with_views(
        "L",
        "select location, time, "
        + sql_round(
            {
                "Weekend": '"Weekend"',
                "Weekday": '"Weekday"',
                LABEL: f'("Weekday" * {_WEEKDAYS} + "Weekend" * ({_MONTH_DAYS} - {_WEEKDAYS})) / {_MONTH_DAYS}',
            }
        )
        + " from K",
        {"K": _SHEET},
    ),
)
def load_cooling_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet as a CSV file, beside lines of later years whose load is NA: those are dropped."""
    path = scratch_path(spark, "sheet")
    sheet = V.load_sheet(spark, sf_dir).select("location", "Year", "Month", "Hour", "Weekday", "Cooling Load (kW)")
    missing = sheet.withColumns({"Year": F.col("Year") + 50, "Cooling Load (kW)": F.lit(None).cast("double")})
    sheet.unionByName(missing).write.option("header", True).option("nullValue", "NA").csv(path)
    return rounded(study.load_cooling(spark, path))


@query(
    "weekday_counts",
    with_views(
        "L",
        f"""select location, time, cast({_WEEKDAYS} as int) as weekdays, cast({_MONTH_DAYS} - {_WEEKDAYS} as int) as weekends,
 cast({_MONTH_DAYS} as int) as month_days, cast(dayofyear(make_date(year(time), 12, 31)) as int) as year_days from K""",
        {"K": _SHEET},
    ),
)
def weekday_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("time")
    days = weekday_count(month_start(t), next_month_start(t))
    return V.mean_load(spark, sf_dir).select(
        "location",
        "time",
        days.alias("weekdays"),
        (days_in_month(t) - days).alias("weekends"),
        days_in_month(t).alias("month_days"),
        days_in_year(F.year(t)).alias("year_days"),
    )


@query(
    "representative_time",
    with_views(
        "L",
        f"""select location, year, month, hour, kind, {V._STAMP.format(y="year", m="month", h="hour")} as time from L""",
    ),
)
def representative_time_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = V.load_sheet(spark, sf_dir).drop("Cooling Load (kW)")
    named = sheet.withColumnsRenamed({"Year": "year", "Month": "month", "Hour": "hour", "Weekday": "kind"})
    return named.withColumn("time", representative_time(F.col("year"), F.col("month"), F.col("hour")))


@query(
    "cyclic_features",
    with_views(
        "H", f"select location, time, {sql_round({'dry': _SEASON, 'xhour': 'xhour', 'yhour': 'yhour'})} from K",
        {"K": f"select location, time, {_CYCLE} from H"},
    ),
)
def cyclic_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cyclic_season(V.history(spark, sf_dir).select("location", "time")))


@query(
    "prev_hour_features",
    with_views(
        "H",
        "select location, time, "
        + sql_round({f"ph_{c}": f"lag({c}) over w" for c in LAGGED})
        + " from H window w as (partition by location order by time)",
    ),
)
def prev_hour_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    lagged = previous_hour(V.history(spark, sf_dir))
    return rounded(lagged.select("location", "time", *[f"ph_{c}" for c in LAGGED]))


@query(
    "prev_hour_wrap",
    with_views(
        "T",
        "select location, time, "
        + sql_round(
            {
                f"ph_{c}": f"case when row_number() over w = 1 then nth_value({c}, 24) over (partition by location order by time"
                f" rows between unbounded preceding and unbounded following) else lag({c}) over w end"
                for c in LAGGED
            }
        )
        + " from T window w as (partition by location order by time)",
    ),
)
def prev_hour_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = previous_hour_wrapped(V.month_weather(spark, sf_dir), keys=["location"])
    return rounded(wrapped.select("location", "time", *[f"ph_{c}" for c in LAGGED]))


_MONTH_HOURS = "select location, scenario, year(time) as year, month(time) as month, hour(time) as hour, " + ", ".join(
    f"avg({c}) as {c}" for c in LAGGED
) + " from S group by 1, 2, 3, 4, 5"
FUTURE_SQL = {
    "MH": _MONTH_HOURS,
    "MT": f"select location, scenario, {V._STAMP.format(y='year', m='month', h='hour')} as time, {', '.join(LAGGED)} from MH",
    "FU": f"select *, {_CYCLE}, "
    + ", ".join(
        f"case when row_number() over w = 1 then nth_value({c}, 24) over (partition by location, scenario order by time"
        f" rows between unbounded preceding and unbounded following) else lag({c}) over w end as ph_{c}"
        for c in LAGGED
    )
    + " from MT window w as (partition by location, scenario order by time)",
}


@query(
    "month_hour_mean",
    with_views(
        "S",
        "select location, scenario, cast(year as int) as year, cast(month as int) as month, cast(hour as int) as hour, "
        + sql_round(LAGGED)
        + " from MH",
        {"MH": _MONTH_HOURS},
    ),
)
def month_hour_mean_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(month_hour_mean(strip_text(V.synthetic(spark, sf_dir)), LAGGED))


@query(
    "projection_features",
    with_views("S", f"select location, scenario, time, {sql_round(FEATURES)} from FU", FUTURE_SQL),
)
def projection_features_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(projection_features(strip_text(V.synthetic(spark, sf_dir))))


@query(
    "training_table",
    with_views(
        "TB",
        f"""select location, time, {sql_round(COLUMNS)} from TR
where (location = 'jkt' and year(time) = 1997) or (location = 'smg' and year(time) = 1998)""",
        TRAINING_SQL,
    ),
)
def training_table_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(training_table(V.month_weather(spark, sf_dir), V.mean_load(spark, sf_dir), TRAINING_YEARS))


@query(
    "ordered_split",
    with_views("TB", "select location, time, cast(row as int) as row, part from SP", SPLIT_SQL),
)
def ordered_split_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_split(full_training(spark, sf_dir)).select("location", "time", "row", "part")


@query(
    "minmax_scale",
    with_views(
        "TB",
        f"select location, time, part, {sql_round(scaled_sql(COLUMNS))} from SP join LI using (location)",
        LIMITS_SQL,
    ),
)
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = materialize(ordered_split(full_training(spark, sf_dir)), "split")  # for the bounds and the scaling
    scaled = scale(split, bounds(split), COLUMNS, len(LOCATIONS))
    return rounded(scaled.select("location", "time", "part", *COLUMNS))


def _pairs_sql() -> str:
    parts = []
    for a in COLUMNS:
        for b in COLUMNS:
            r = f"case when min({a}) < max({a}) and min({b}) < max({b}) then round(corr({a}, {b}), 2) + 0.0 end"
            parts.append(f"select location, '{a}' as a, '{b}' as b, {r} as r from SP where part <> 'test' group by location")
    return "\nunion all ".join(parts)


@query("correlation_matrix", with_views("TB", _pairs_sql(), SPLIT_SQL))
def correlation_matrix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = ordered_split(full_training(spark, sf_dir)).filter(F.col("part") != "test")
    return correlation_matrix(train, COLUMNS)


_METRICS = {
    "mse": "avg((y - p) * (y - p))",
    "rmse": "sqrt(avg((y - p) * (y - p)))",
    "cv_rmse": "100 * sqrt(avg((y - p) * (y - p))) / avg(y)",
    "mape": "100 * avg(abs(y - p) / greatest(abs(y), 1e-7))",
    "r2": "pow(corr(y, p), 2)",
}


@query(
    "regression_metrics",
    with_views("Y", f"select model, {sql_round(_METRICS)} from Y group by model"),
)
def regression_metrics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(regression_metrics(V.predictions(spark, sf_dir), ["model"], "y", "p"))


@query(
    "trend_line",
    with_views(
        "Y",
        "select model, "
        + sql_round({"slope": "regr_slope(p, y)", "intercept": "regr_intercept(p, y)"})
        + " from Y group by model",
    ),
)
def trend_line_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trend_line(V.predictions(spark, sf_dir), ["model"], "y", "p"))


@query(
    "melt_profile",
    with_views(
        "TB",
        f"""select location, time, cast(hour(time) as int) as hour, cast(month(time) as int) as month,
 strftime(time, '%b') as month_label, 'precip' as category, {sql_round({"values": "precip"})} from TR""",
        TRAINING_SQL,
    ),
)
def melt_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(charts.hour_by_month(full_training(spark, sf_dir), "precip"))


# Networks by rule, so that scoring has an exact counterpart in SQL.
RULE_LAYERS = {"ann": mlp.shallow(5), "dnn": mlp.deep(4, [(3, 0.2)])}


def _rule_weight(location: str, layer: int, i: int, j: int) -> float:
    return round(0.6 * math.sin(1.7 * i + 2.9 * j + 0.8 * layer + (0.5 if location == "smg" else 0.0)), 6)


def rule_weights(location: str, layers: Sequence[mlp.Layer]) -> mlp.Weights:
    width, weights = len(FEATURES), []
    for n, layer in enumerate(layers):
        table = [[_rule_weight(location, n, i, j) for j in range(layer.units)] for i in range(width + 1)]
        weights.append((np.array(table[:-1]), np.array(table[-1])))
        width = layer.units
    return weights


def rule_networks(spark: SparkSession, layers: dict[str, list[mlp.Layer]], rate: float = 1e-3) -> DataFrame:
    """A network of each kind for each location, with weights by rule."""
    rows = [networks.plan_row(place, model, l, rate, rule_weights(place, l)) for place in LOCATIONS for model, l in layers.items()]
    return networks.plans(spark, rows)


def _forward_sql(source: str, keep: str) -> dict[str, str]:
    """One CTE per layer; the CASE picks the location's weight."""
    steps, inputs = {}, {m: list(FEATURES) for m in RULE_LAYERS}
    before = source
    for n in range(max(len(v) for v in RULE_LAYERS.values())):
        items = []
        for model, layers in RULE_LAYERS.items():
            if n >= len(layers):
                items += inputs[model]
                continue
            names = []
            for j in range(layers[n].units):
                terms = []
                for i, x in enumerate([*inputs[model], "1.0"]):
                    pair = [_rule_weight(place, n, i, j) for place in LOCATIONS]
                    terms.append(f"{x} * case location when 'jkt' then {pair[0]}::double else {pair[1]}::double end")
                z = " + ".join(terms)
                name = f"{model}_{n}_{j}"
                items.append((f"greatest({z}, 0)" if layers[n].activation == "relu" else z) + f" as {name}")
                names.append(name)
            inputs[model] = names
        passed = sorted({f for v in inputs.values() for f in v if f in FEATURES})
        steps[f"FW{n}"] = f"select {keep}, {', '.join([*items, *[p for p in passed if p not in items]])} from {before}"
        before = f"FW{n}"
    steps["SC"] = f"select {keep}, {', '.join(f'{v[0]} as {m}_cooling_load' for m, v in inputs.items())} from {before}"
    return steps


_SCALED = ", ".join(f"{e} as {c}" for c, e in scaled_sql(FEATURES, fill=True).items())
_BACK = {
    f"{m}_cooling_load": f"{m}_cooling_load * (max_{LABEL} - min_{LABEL}) + min_{LABEL}" for m in RULE_LAYERS
}
_TEST_SQL = {
    **LIMITS_SQL,
    "SX": f"select location, time, row, cut, {LABEL}, {_SCALED} from SP join LI using (location) where part = 'test'",
    **_forward_sql("SX", f"location, time, row, cut, {LABEL}"),
    "PR": "select location, time, cast(row - cut as int) as hour, "
    + ", ".join(f"{e} as {c}" for c, e in _BACK.items())
    + f", {LABEL} from SC join LI using (location)",
}


@query(
    "mlp_score",
    with_views(
        "TB",
        f"select location, time, hour, {sql_round([*_BACK, LABEL])} from PR",
        _TEST_SQL,
    ),
)
def mlp_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks go through a written table first; predictions in kW."""
    nets = materialize(rule_networks(spark, RULE_LAYERS), "networks")
    data = forecast.split_scale(full_training(spark, sf_dir), len(LOCATIONS))
    return rounded(forecast.test_predictions(data, nets, len(LOCATIONS)))


@query(
    "evaluate",
    with_views(
        "TB",
        f"select location, model, {sql_round(_METRICS)} from EV group by 1, 2",
        {
            **_TEST_SQL,
            "EV": "\nunion all ".join(
                f"select location, '{m}' as model, {LABEL} as y, {m}_cooling_load as p from PR" for m in RULE_LAYERS
            ),
        },
    ),
)
def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = forecast.split_scale(full_training(spark, sf_dir), len(LOCATIONS))
    return rounded(forecast.evaluate(forecast.test_predictions(data, rule_networks(spark, RULE_LAYERS), len(LOCATIONS))))


@query(
    "chart_predictions",
    with_views(
        "TB",
        "\nunion all ".join(
            f"select location, hour, '{c}' as category, {sql_round({'values': c})} from PR" for c in [*_BACK, LABEL]
        ),
        _TEST_SQL,
    ),
)
def chart_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = forecast.split_scale(full_training(spark, sf_dir), len(LOCATIONS))
    return rounded(charts.prediction_lines(forecast.test_predictions(data, rule_networks(spark, RULE_LAYERS), len(LOCATIONS))))


# Dew point follows temperature in these tables, which leaves least squares without a single solution.
LINEAR_FEATURES = [f for f in FEATURES if "dewpoint" not in f]


def _normal_sql() -> dict[str, str]:
    """Least squares by elimination on the sums of products: one CTE per pivot."""
    xs = [*LINEAR_FEATURES, "one"]
    n = len(xs)
    told = [*xs, "y"]
    label = scaled_sql([LABEL])[LABEL]
    steps = {
        "NX": f"select location, part, time, {_SCALED}, 1.0::double as one, {label} as y from SP join LI using (location)",
        "E0": "select location, "
        + ", ".join(f"sum({xs[i]} * {told[j]}) as c{i}_{j}" for i in range(n) for j in range(n + 1))
        + " from NX where part <> 'test' group by 1",
    }
    for k in range(n):
        items = []
        for i in range(n):
            for j in range(k, n + 1):
                items.append(f"c{k}_{j} / c{k}_{k} as c{i}_{j}" if i == k else f"c{i}_{j} - c{i}_{k} * c{k}_{j} / c{k}_{k} as c{i}_{j}")
        steps[f"E{k + 1}"] = f"select location, {', '.join(items)} from E{k}"
    steps["LP"] = "select location, NX.time, y, " + " + ".join(f"{x} * c{i}_{n}" for i, x in enumerate(xs)) + f" as p from NX join E{n} using (location) where part = 'test'"
    return steps


def _yardstick(data: forecast.TrainingData, model, name: str, features: Sequence[str] = FEATURES) -> DataFrame:
    tests = data.matrix.filter(F.col("part") == "test")
    return crosscheck.predict(tests, model, name, LOCATIONS, features)


@query(
    "linear_check",
    with_views("TB", f"select location, time, {sql_round({'linear': 'p'}, 5)} from LP", {**LIMITS_SQL, **_normal_sql()}),
)
def linear_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled loads of the test rows by linear regression, beside which the networks stand."""
    data = forecast.split_scale(full_training(spark, sf_dir), len(LOCATIONS))
    told = _yardstick(data, crosscheck.fit_linear(data.matrix, LOCATIONS, LINEAR_FEATURES), crosscheck.LINEAR, LINEAR_FEATURES)
    return rounded(told.select("location", "time", "linear"), 5)


@query("yardstick_metrics")
def yardstick_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of linear regression and boosted trees on the test rows, in scaled units."""
    data = forecast.split_scale(full_training(spark, sf_dir), len(LOCATIONS))
    matrix = materialize(data.matrix, "matrix")  # the learners pass over it many times
    data = forecast.TrainingData(data.loads, data.split, data.limits, matrix)
    fitted = {crosscheck.LINEAR: crosscheck.fit_linear(matrix, LOCATIONS), crosscheck.TREES: crosscheck.fit_trees(matrix, LOCATIONS)}
    parts = [_yardstick(data, m, n).select("location", F.lit(n).alias("model"), "label", F.col(n).alias("p")) for n, m in fitted.items()]
    return regression_metrics(parts[0].unionByName(parts[1]), ["location", "model"], "label", "p")


_TREND = {"slope": f"regr_slope(dnn_cooling_load, {LABEL})", "intercept": f"regr_intercept(dnn_cooling_load, {LABEL})"}


@query(
    "chart_prediction_trend",
    with_views("TB", f"select location, {sql_round(_TREND, 6)} from PR group by 1", _TEST_SQL),
)
def chart_prediction_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = forecast.split_scale(full_training(spark, sf_dir), len(LOCATIONS))
    predictions = forecast.test_predictions(data, rule_networks(spark, RULE_LAYERS), len(LOCATIONS))
    return rounded(charts.prediction_trend(predictions, "dnn"), 6)


FORECAST_SQL = {
    **LIMITS_SQL,
    **FUTURE_SQL,
    "FX": f"select location, scenario, time, {_SCALED} from FU join LI using (location)",
    **_forward_sql("FX", "location, scenario, time"),
    "PL": "select location, scenario, time, "
    + ", ".join(f"{e} as {c}" for c, e in _BACK.items())
    + " from SC join LI using (location)",
}


def projected(
    spark: SparkSession, sf_dir: str, training: DataFrame | None = None, models: Sequence[str] = forecast.MODELS
) -> DataFrame:
    """Projected loads of the rule's networks (or of the kinds named), scaled by the training table's bounds."""
    training = full_training(spark, sf_dir) if training is None else training
    # Read twice, for scaling and for the way back, so it is written once.
    limits = materialize(bounds(ordered_split(training)), "limits")
    features = projection_features(strip_text(V.synthetic(spark, sf_dir)))
    return forecast.project_load(features, limits, rule_networks(spark, RULE_LAYERS), len(LOCATIONS), models)


@query(
    "project_load",
    with_views("TBS", f"select location, scenario, time, {sql_round(list(_BACK))} from PL", FORECAST_SQL),
)
def project_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(projected(spark, sf_dir))


STEP_RATE, STEP_SEED = 1e-2, 500


def _layer_names(layers: list[mlp.Layer]) -> list[list[list[str]]]:
    """Weight names by layer, input (the last is the bias) and unit."""
    widths = [len(FEATURES), *(l.units for l in layers)]
    return [[[f"k{n}_{i}_{j}" for j in range(layer.units)] for i in range(widths[n] + 1)] for n, layer in enumerate(layers)]


def _mask_sql(epoch: int, layer: int, units: int, j: int, rate: float) -> str:
    """The kept share of a unit: the hash of its row, unrolled."""
    salt = mlp.mask_salt(STEP_SEED, epoch, layer)
    z = f"((row::hugeint * {units} + {j} + {salt}) & 4294967295)"
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        z = f"((xor({z}, {z} >> {shift}) * {factor}) & 4294967295)"
    return f"(case when xor({z}, {z} >> 16) >= {rate * 2.0**32!r}::double then {1 / (1 - rate)!r}::double else 0 end)"


def _pass_sql(layers: list[mlp.Layer], source: str, weights: str, name: str, epoch: int | None) -> dict[str, str]:
    """Forward sums layer by layer, then the error; dropout masks where an epoch is given."""
    steps, before = {}, [*FEATURES]
    names = _layer_names(layers)
    every = ", ".join(f"w_{n}" for table in names for row in table for n in row)
    for l, layer in enumerate(layers):
        items = []
        for j in range(layer.units):
            z = " + ".join([*(f"{x} * w_{names[l][i][j]}" for i, x in enumerate(before)), f"w_{names[l][-1][j]}"])
            z = f"greatest({z}, 0)" if layer.activation == "relu" else f"({z})"
            masked = layer.dropout > 0 and epoch is not None
            items.append(f"{z} * {_mask_sql(epoch, l, layer.units, j, layer.dropout)} as a{l}_{j}" if masked else f"{z} as a{l}_{j}")
        carried = "x.*, " + every if l == 0 else "*"
        origin = f"{source} x join {weights} using (location)" if l == 0 else f"{name}_{l - 1}"
        steps[f"{name}_{l}"] = f"select {carried}, {', '.join(items)} from {origin}"
        before = [f"a{l}_{j}" for j in range(layer.units)]
    steps[f"{name}_e"] = f"select *, {before[0]} - y as e from {name}_{len(layers) - 1}"
    return steps


def _back_sql(layers: list[mlp.Layer], name: str, epoch: int) -> tuple[dict[str, str], dict[str, str]]:
    """Derivatives by unit, the last layer first, and the gradient of each weight of a row."""
    steps, grads, source = {}, {}, f"{name}_e"
    names = _layer_names(layers)
    for l in range(len(layers) - 1, -1, -1):
        items = []
        for j in range(layers[l].units):
            if l == len(layers) - 1:
                d = "2 * e"
            else:
                d = "(" + " + ".join(f"d{l + 1}_{k} * w_{names[l + 1][j][k]}" for k in range(layers[l + 1].units)) + ")"
            if layers[l].dropout > 0:
                d += f" * {_mask_sql(epoch, l, layers[l].units, j, layers[l].dropout)}"
            if layers[l].activation == "relu":
                d += f" * (case when a{l}_{j} > 0 then 1 else 0 end)"
            items.append(f"{d} as d{l}_{j}")
        steps[f"{name}_d{l}"] = f"select *, {', '.join(items)} from {source}"
        source = f"{name}_d{l}"
        inputs = [*FEATURES, "1"] if l == 0 else [*(f"a{l - 1}_{i}" for i in range(layers[l - 1].units)), "1"]
        grads |= {names[l][i][j]: f"{x} * d{l}_{j}" for i, x in enumerate(inputs) for j in range(layers[l].units)}
    return steps, grads


def training_sql(layers: list[mlp.Layer], epochs: int, batch_rows: int, batches: int) -> dict[str, str]:
    """Training unrolled: per step the forward sums, gradients and Adam, then the losses of each epoch as L1, L2 and so on.

    A location with fewer rows takes no step in the batches it does not reach.
    """
    names = [n for table in _layer_names(layers) for row in table for n in row]
    start: dict[str, list[float]] = {}
    for place in LOCATIONS:
        for flat, n in zip(mlp.flatten(rule_weights(place, layers)).tolist(), names):
            start.setdefault(n, []).append(flat)
    first = ", ".join(
        f"case location when 'jkt' then {a!r}::double else {b!r}::double end as w_{n}, 0.0::double as m_{n}, 0.0::double as v_{n}" for n, (a, b) in start.items()
    )
    label = scaled_sql([LABEL])[LABEL]
    steps = {
        "X": f"select location, part, row, {_SCALED}, {label} as y from SP join LI using (location) where part <> 'test'",
        "W0": f"select distinct location, 0 as t, {first} from X",
    }
    now = 0
    for epoch in range(epochs):
        seen = []
        for batch in range(batches):
            name = f"S{now}"
            steps[f"X{now}"] = f"select * from X where part = 'fit' and (row - 1) // {batch_rows} = {batch}"
            steps |= _pass_sql(layers, f"X{now}", f"W{now}", name, epoch)
            back, grads = _back_sql(layers, name, epoch)
            steps |= back
            each = ", ".join(f"sum({g}) / count(*) as g_{n}" for n, g in grads.items())
            steps[f"G{now}"] = f"select location, sum(e * e) as sse, count(*) as n, {each} from {name}_d0 group by 1"
            moments = ", ".join(
                f"{mlp.BETA1} * m_{n} + {1 - mlp.BETA1!r} * g_{n} as m_{n}, {mlp.BETA2} * v_{n} + {1 - mlp.BETA2!r} * g_{n} * g_{n} as v_{n}, w_{n}" for n in names
            )
            steps[f"M{now}"] = f"select location, t + 1 as t, {moments} from W{now} join G{now} using (location)"
            rate = f"{STEP_RATE} * sqrt(1 - pow({mlp.BETA2}::double, t)) / (1 - pow({mlp.BETA1}::double, t))"
            moved = ", ".join(f"w_{n} - {rate} * m_{n} / (sqrt(v_{n}) + {mlp.ADAM_EPSILON!r}::double) as w_{n}, m_{n}, v_{n}" for n in names)
            kept = ", ".join(f"w_{n}, m_{n}, v_{n}" for n in names)
            steps[f"W{now + 1}"] = (
                f"select location, t, {moved} from M{now} union all select location, t, {kept} from W{now} where location not in (select location from G{now})"
            )
            seen.append(f"select location, sse, n from G{now}")
            now += 1
        steps[f"XV{epoch}"] = "select * from X where part = 'val'"
        steps |= _pass_sql(layers, f"XV{epoch}", f"W{now}", f"V{epoch}", None)
        steps[f"T{epoch}"] = "select location, sum(sse) / sum(n) as loss from (" + " union all ".join(seen) + ") group by 1"
        steps[f"L{epoch + 1}"] = f"select location, {epoch + 1} as epoch, loss, val_loss from T{epoch} join (select location, avg(e * e) as val_loss from V{epoch}_e group by 1) using (location)"
    return steps


def _losses_sql(model: str, epochs: int) -> str:
    parts = [f"select location, '{model}' as model, epoch, {sql_round(['loss', 'val_loss'], 7)} from L{e + 1}" for e in range(epochs)]
    return "\nunion all ".join(parts)


def _loss_history(spark: SparkSession, sf_dir: str, model: str, layers: list[mlp.Layer], epochs: int, batch_rows: int) -> DataFrame:
    data = forecast.split_scale(full_training(spark, sf_dir), len(LOCATIONS))
    plan = rule_networks(spark, {model: layers}, STEP_RATE)
    return rounded(networks.history(networks.fit(data.matrix, plan, epochs, None, batch_rows, STEP_SEED)), 7)


ONE_BATCH = 1 << 20
STEPS = {
    "mlp_fit_steps": ("ann", mlp.shallow(2), 3, ONE_BATCH, 1),
    "mlp_batch_steps": ("ann", mlp.shallow(2), 2, 600, 2),
    "mlp_deep_steps": ("dnn", mlp.deep(2, [(3, 0.2)]), 2, 600, 2),
}


def _steps_query(name: str, model: str, layers: list[mlp.Layer], epochs: int, batch_rows: int, batches: int) -> None:
    sql = with_views("TB", _losses_sql(model, epochs), {**LIMITS_SQL, **training_sql(layers, epochs, batch_rows, batches)})

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Loss history of networks that start from weights by rule."""
        return _loss_history(spark, sf_dir, model, layers, epochs, batch_rows)


for _name, _told in STEPS.items():
    _steps_query(_name, *_told)


@query("mlp_fit")
def mlp_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss history of both kinds of network at both locations."""
    data = forecast.split_scale(full_training(spark, sf_dir), len(LOCATIONS))
    kinds = {"ann": mlp.shallow(21), "dnn": mlp.deep(16, [(12, 0.2), (8, 0.0)])}
    plan = networks.plans(spark, [networks.plan_row(p, m, l, 1e-2) for p in LOCATIONS for m, l in kinds.items()])
    return networks.history(networks.fit(data.matrix, plan, epochs=250))


@query("mlp_search")
def mlp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten trials of three executions for both kinds at both locations."""
    data = forecast.split_scale(full_training(spark, sf_dir), len(LOCATIONS))
    return networks.trial_scores(networks.search(data.matrix, epochs=250))


_TRIALS = """select if(l_linestatus = 'F', 'jkt', 'smg') as location, if(l_returnflag = 'R', 'dnn', 'ann') as model,
 cast(l_orderkey % 97 as int) as trial, cast(l_linenumber % 3 as int) as execution, min(l_extendedprice) as best_loss from lineitem group by 1, 2, 3, 4"""


@query(
    "best_trial",
    f"""with TR as ({_TRIALS}),
SC as (select location, model, trial, avg(best_loss) as val_loss from TR group by 1, 2, 3),
BE as (select *, row_number() over (partition by location, model order by val_loss, trial) as nth from SC),
EX as (select location, model, trial, execution, row_number() over (partition by location, model, trial order by best_loss, execution) as nth from TR)
select location, model, trial, execution, {sql_round(['val_loss'])} from BE join EX using (location, model, trial) where BE.nth = 1 and EX.nth = 1""",
)
def best_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best trial and execution of networks whose losses are prices of line items."""
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
    layers = f"cast(array(named_struct('units', 3, 'activation', 'relu', 'dropout', 0.0D)) as {networks.LAYERS}) as layers"
    told = spark.sql(_TRIALS).selectExpr("*", "0.01D as learning_rate", layers, "array(best_loss) as weights", "array(best_loss) as best_weights")
    told = materialize(told, "trials")
    winners = networks.best_trials(networks.trial_scores(told)).drop("trial")
    best = networks.best_networks(told).select("location", "model", "trial", "execution")
    return rounded(best.join(winners, ["location", "model"]))
