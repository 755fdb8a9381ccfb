"""Uses of models with fixed weights, so that SQL can follow every step."""

from __future__ import annotations

from itertools import combinations
from math import factorial

from pyspark.sql import functions as F

from airspark import fixtures as fx
from airspark.catalog.learning import LABELLED_SQL, FULL_SQL, W, _state_sql, rated
from airspark.catalog.modeling import WEIGHTS, labelled_table
from airspark.catalog.registry import q6, query, rounded
from airspark.catalog.sql import NOW_SQL
from airspark.catalog.summaries import RATED, union_all
from airspark.operators.features import full_features
from airspark.plans import dataset, evaluate, explain, forecast, models
from airspark.plans.dataset import Scaler
from airspark.plans.ensemble import Ensemble
from airspark.plans.margin import MarginModel
from airspark.plans.models import Fitted
from airspark.plans.serving import recent_state
from airspark.session import scratch_path

TREE_INPUTS = ["pm2_5", "pm2_5_lag24", "pm2_5_rolling_mean_24h", "hour_raw", "is_weekend", "pm10"]
# (feature, threshold, left, right) or a leaf (value, training weight).
TREES = [
    (0, 60.0, (1, 40.0, (30.0, 50.0), (42.0, 30.0)), (1, 80.0, (70.0, 25.0), (95.0, 15.0))),
    (3, 11.0, (2, 55.0, (-4.0, 40.0), (3.0, 20.0)), (4, 0.0, (2.5, 35.0), (-1.5, 25.0))),
    (5, 120.0, (0, 45.0, (-6.0, 33.0), (0, 90.0, (1.0, 27.0), (9.0, 11.0))), (6.0, 49.0)),
]
TREE_WEIGHTS = [1.0, 0.8, 0.5]


def _unscaled(names) -> Scaler:
    return Scaler({n: 0.0 for n in names}, {n: 1.0 for n in names})


def fixed_linear() -> Fitted:
    return Fitted("fixed_linear", MarginModel(list(WEIGHTS.values()), 4.0), list(WEIGHTS), _unscaled(WEIGHTS))


def fixed_trees() -> Fitted:
    return Fitted("fixed_trees", Ensemble.nested(TREES, TREE_WEIGHTS), TREE_INPUTS, _unscaled(TREE_INPUTS))


# ---- predictions in SQL ---------------------------------------------------

LINEAR_SQL = "(4.0::double + " + " + ".join(f"{w}::double * {n}" for n, w in WEIGHTS.items()) + ")"


def _tree_sql(node) -> str:
    if len(node) == 2:
        return f"{node[0]}::double"
    return f"(case when {TREE_INPUTS[node[0]]} <= {node[1]}::double then {_tree_sql(node[2])} else {_tree_sql(node[3])} end)"


def _whole(names, value: str) -> str:
    return f"(case when {' and '.join(f'{n} is not null' for n in names)} then {value} end)"


TREES_SQL = _whole(TREE_INPUTS, "(" + " + ".join(f"{w}::double * {_tree_sql(t)}" for t, w in zip(TREES, TREE_WEIGHTS)) + ")")


def _lag(k: int) -> str:
    return f"case when len(hist) >= 72 then hist[-{k}] else pm2_5 end pm2_5_lag{k}"


def walk_sql(value: str, steps: int, keys: str) -> str:
    """CTE ``done``: the forecast of every row of ``st`` (keys, ts, pm2_5, pm10, o3, no2, hist) as a list."""
    return (
        f" walk as (select {keys}, ts, 0 as k, hist, pm2_5, pm10, o3, no2, []::double[] as ahead from st"
        f" union all select {keys}, ts, k + 1, case when len(hist) >= 72 then hist[-71:] || [y] else hist || [y] end, y, pm10 * s, o3 * 0.995::double, no2 * s, ahead || [y]"
        f" from (select *, case when pm2_5 > 0 then y / pm2_5 else 1 end s from (select *, {value} y from (select *, (pm2_5_lag24 + pm2_5_lag48 + pm2_5_lag72) / 3 recent_hour_avg from (select *,"
        f" {', '.join(_lag(k) for k in (1, 2, 3, 24, 48, 72))},"
        " case when len(hist) >= 24 then pm2_5 - hist[-24] else 0 end diff_24h,"
        " case when len(hist) >= 24 then list_sum(hist[-24:]) / 24 else pm2_5 end pm2_5_rolling_mean_24h,"
        " hour(ts + to_hours(k + 1)) hour_raw, cast(isodow(ts + to_hours(k + 1)) >= 6 as int) is_weekend"
        f" from walk where k < {steps}))))), done as (select {keys}, ts, ahead, hist from walk where k = {steps})"
    )


def _recent_forecast_sql(value: str) -> str:
    newest = ", ".join(f"max({p}) filter (r = 1) {p}" for p in ("pm2_5", "pm10", "o3", "no2"))
    # The histories of the start are the last rows; a walk that lacks a value falls back on their last one.
    return (
        f"with recursive {_state_sql()}, st as (select station_id, max(ts) ts, {newest}, list(pm2_5 order by ts) hist from k group by 1),"
        f"{walk_sql(value, 72, 'station_id')}, x as (select station_id, ts, list_count(ahead) = 72 whole, ahead, (select any_value(list_filter(st.hist, lambda v: v is not null)[-1]) from st where st.station_id = done.station_id) known from done),"
        " y as (select *, unnest(range(1, 73)) step from x)"
        " select station_id, case when whole then 'model' when known is not null then 'last value' else 'not enough data' end status, ts origin, cast(step as int) step,"
        f" ts + to_hours(step) ts, {q6('case when whole then ahead[step] else known end')} pm2_5 from y"
    )


def _recent_forecast(model):
    def run(spark, sf_dir):
        state = recent_state(rated(spark, sf_dir), fx.NOW)
        return rounded(forecast.forecast_rows(forecast.or_last_value(forecast.recursive_forecast(state, model()))), "pm2_5")

    return run


query(_recent_forecast_sql(LINEAR_SQL), "forecast_fixed_linear")(_recent_forecast(fixed_linear))
query(_recent_forecast_sql(TREES_SQL), "forecast_fixed_trees")(_recent_forecast(fixed_trees))


def _score_sql(value: str, names) -> str:
    return f"with {FULL_SQL} select station_id, ts, {q6(_whole(names, value))} prediction from f"


query(_score_sql(LINEAR_SQL, WEIGHTS), "score_fixed_linear")(
    lambda spark, sf_dir: rounded(fixed_linear().predict(full_features(rated(spark, sf_dir))), "prediction")
)


# ---- back-tests -----------------------------------------------------------

_METRICS = ", ".join(
    f"{q6(e)} {n}" for n, e in (("mae", "avg(abs(a - p))"), ("rmse", "sqrt(avg((a - p) * (a - p)))"), ("r2", "1 - avg((a - p) * (a - p)) / nullif(var_pop(a) filter (p is not null), 0)"))
)


def _backtest_sql(value: str, name: str) -> str:
    """Origins are the labelled test rows; histories are the labelled rows before them."""
    return (
        f"with recursive {LABELLED_SQL}, n as (select *, row_number() {W} rn, count(*) over (partition by station_id) c from s),"
        " m as (select n.*, case when b.ts is not null then b.pm2_5 else n.pm2_5 end actual from n left join s b on b.station_id = n.station_id and b.ts = n.ts + interval '72 hours'),"
        " h as (select *, list(pm2_5) over (partition by station_id order by ts rows between 71 preceding and current row) hist from m),"
        " st as (select station_id, ts, actual, pm2_5, pm10, o3, no2, hist from h where rn > floor(0.8::double * c)),"
        f"{walk_sql(value, 72, 'station_id, actual')}, g as (select actual a, ahead[72] p from done)"
        f" select '{name}' model, count(a - p) n, {_METRICS} from g"
    )


def _backtest(model):
    def run(spark, sf_dir):
        rows = labelled_table(spark, sf_dir)
        return rounded(forecast.backtest_t72(dataset.chrono_split(rows), ~F.col("is_train"), model()), "mae", "rmse", "r2")

    return run


query(_backtest_sql(LINEAR_SQL, "fixed_linear"), "backtest_fixed_linear")(_backtest(fixed_linear))
query(_backtest_sql(TREES_SQL, "fixed_trees"), "backtest_fixed_trees")(_backtest(fixed_trees))


_NEWEST = ", ".join(f"max({p}) filter (r = 25) {p}" for p in ("ts", "pm2_5", "pm10", "o3", "no2"))


@query(f"with recursive {RATED}, n as (select *, row_number() over (partition by station_id order by ts desc) r from rated where ts <= {NOW_SQL}), k as (select * from n where r <= 96),"
       f" sz as (select station_id, count(*) c from k group by 1), st as (select station_id, {_NEWEST}, list(pm2_5 order by ts) filter (r > 24) hist, list(pm2_5 order by ts) filter (r <= 24) actual"
       f" from k join sz using (station_id) where c >= 48 group by 1), {walk_sql(LINEAR_SQL, 24, 'station_id, actual')}, g as (select station_id, unnest(actual) a, unnest(ahead) p from done),"
       f" sc as (select station_id, count(a - p) n, {_METRICS}, avg(abs((a - p) / case when a = 0 then 1 else a end)) * 100 mape from g group by 1)"
       f" select station_id, case when c < 48 then 'not enough data' when n > 0 then 'scored' else 'no forecast' end status, coalesce(n, 0) n, case when n > 0 then mae end mae, case when n > 0 then rmse end rmse,"
       f" case when n > 0 then r2 end r2, {q6('case when n > 0 then mape end')} mape, {q6('case when n > 0 then greatest(0, 100 - mape) end')} accuracy from sz left join sc using (station_id)")
def live_fixed_linear(spark, sf_dir):
    out = forecast.live_metrics(fx.actual(rated(spark, sf_dir)), fixed_linear())
    return rounded(out, "mae", "rmse", "r2", "mape", "accuracy")


@query(f"with {LABELLED_SQL}, g as (select target a, {LINEAR_SQL} p from s), m as (select {_METRICS} from g)"
       " select unnest([1, 2])::int \"version\", 'fixed_linear' model, rmse, mae, r2, 12 features from m")
def register_fixed(spark, sf_dir):
    """Two versions in a registry, and the number of features of the model loaded from it."""
    rows, model = labelled_table(spark, sf_dir), fixed_linear()
    guessed = model.predict(rows).join(rows.select("station_id", "ts", "target"), ["station_id", "ts"])
    scores = evaluate.regression_metrics(guessed.select(F.lit(model.name).alias("model"), F.col("target").alias("actual"), F.col("prediction").alias("predicted")), ["model"])
    root = scratch_path(spark, "models")
    for _ in range(2):
        models.register(spark, root, model, scores.first().asDict())
    loaded = models.load(spark, root, MarginModel)
    same = loaded.model.coefficients == model.model.coefficients and loaded.names == model.names
    return rounded(models.registry(spark, root), "rmse", "mae", "r2").withColumn("features", F.lit(len(loaded.names) if same else 0))


# ---- Shapley values of the trees ------------------------------------------


def _cover(node) -> float:
    return node[1] if len(node) == 2 else _cover(node[2]) + _cover(node[3])


def _known_sql(node, known: frozenset) -> str:
    """The value of a tree when only some features are known: branches by training weight elsewhere."""
    if len(node) == 2:
        return f"{node[0]}::double"
    left, right = (_known_sql(n, known) for n in node[2:])
    if node[0] in known:
        return f"(case when {TREE_INPUTS[node[0]]} <= {node[1]}::double then {left} else {right} end)"
    share = _cover(node[2]) / _cover(node)
    return f"({share!r}::double * {left} + {1 - share!r}::double * {right})"


def _features(node) -> set:
    return set() if len(node) == 2 else {node[0]} | _features(node[2]) | _features(node[3])


def _shapley_sql(feature: int) -> str:
    """All subsets of the features of each tree that uses this one."""
    terms = []
    for tree, weight in zip(TREES, TREE_WEIGHTS):
        own = _features(tree)
        if feature not in own:
            continue
        rest = sorted(own - {feature})
        for k in range(len(rest) + 1):
            for s in combinations(rest, k):
                share = factorial(k) * factorial(len(rest) - k) / factorial(len(rest) + 1)
                gain = f"({_known_sql(tree, frozenset({*s, feature}))} - {_known_sql(tree, frozenset(s))})"
                terms.append(f"{weight * share!r}::double * {gain}")
    return " + ".join(terms) or "0.0::double"


_SHAPLEY_SQL = f"{LABELLED_SQL}, im as (" + union_all(
    f"select station_id, ts, '{n}' feature, {n}::double \"value\", {_shapley_sql(i)} impact from s" for i, n in enumerate(TREE_INPUTS)
) + ")"


def _fixed_shapley(spark, sf_dir):
    return explain.tree_shapley(labelled_table(spark, sf_dir), fixed_trees(), ["station_id", "ts"])


@query(f"with {_SHAPLEY_SQL} select station_id, ts, feature, {q6('value')} \"value\", {q6('impact')} impact from im")
def shapley_fixed_trees(spark, sf_dir):
    return rounded(_fixed_shapley(spark, sf_dir), "value", "impact")


@query(f"with {_SHAPLEY_SQL}, g as (select feature, avg(abs(impact)) a, avg(impact) m from im group by 1)"
       f" select feature, {q6('a')} mean_abs, {q6('m')} mean_impact, cast(rank() over (order by a desc) as int) rank from g")
def importance_fixed_trees(spark, sf_dir):
    return rounded(explain.importance(_fixed_shapley(spark, sf_dir)), "mean_abs", "mean_impact")
