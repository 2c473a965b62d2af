from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadcast.operators import mlp, training
from loadcast.operators.metrics import correlation_matrix, regression_metrics, trend_line
from loadcast.operators.scaling import bounds, ordered_split, scale, unscale
from loadcast.plans import forecast

FEATURES = ["a", "b"]


def matrix(spark, n=120, partitions=3):
    rng = np.random.default_rng(3)
    rows = []
    for place in ("jkt", "smg"):
        x = rng.uniform(0, 1, (n, 2))
        y = 0.3 * x[:, 0] + np.maximum(0, x[:, 1] - 0.5)
        parts = ["fit"] * (n * 8 // 10) + ["val"] * (n - n * 8 // 10)
        rows += [(place, i + 1, parts[i], *map(float, x[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "location string, row int, part string, a double, b double, label double")
    return df.repartition(partitions)


def numeric_gradient(layers, weights, x, y, masks, step=1e-6):
    out = []
    for k, b in weights:
        for arr in (k, b):
            for at in np.ndindex(arr.shape):
                keep = arr[at]
                side = []
                for sign in (1, -1):
                    arr[at] = keep + sign * step
                    side.append(((mlp.forward(layers, weights, x, masks)[-1][:, 0] - y) ** 2).sum())
                arr[at] = keep
                out.append((side[0] - side[1]) / (2 * step))
    return np.array(out)


@pytest.mark.parametrize("interleaved", [False, True])
def test_gradient(interleaved):
    rng = np.random.default_rng(0)
    layers = mlp.deep(4, [(3, 0.4), (5, 0.0)], interleaved)
    weights = mlp.initial_weights(layers, 2, [1])
    for _, bias in weights:
        bias += rng.normal(size=bias.shape)  # keeps units off the kink at zero
    x, y = rng.normal(size=(9, 2)), rng.normal(size=9)
    masks = {i: mlp.keep_mask(1, 2, i, np.arange(9), l.units, l.dropout) for i, l in enumerate(layers) if l.dropout}
    grad, error = mlp.gradient_sum(layers, weights, x, y, masks)
    assert grad == pytest.approx(numeric_gradient(layers, weights, x, y, masks), abs=1e-4)
    assert error == pytest.approx(((mlp.forward(layers, weights, x, masks)[-1][:, 0] - y) ** 2).sum())
    again = mlp.unflatten(mlp.flatten(weights), layers, 2)
    assert all(np.array_equal(k, k2) and np.array_equal(v, v2) for (k, v), (k2, v2) in zip(weights, again))


def test_interleaved_layout():
    units = [layer.units for layer in mlp.deep(7, [(5, 0.2), (4, 0.0)], True)]
    assert units == [7, 5, 1, 4, 1]
    assert [layer.units for layer in mlp.deep(7, [(5, 0.2), (4, 0.0)])] == [7, 5, 4, 1]


def test_dropout_mask_depends_on_rows_only():
    rows = np.arange(1000)
    whole = mlp.keep_mask(5, 3, 1, rows, 8, 0.4)
    assert np.array_equal(whole[300:500], mlp.keep_mask(5, 3, 1, rows[300:500], 8, 0.4))
    assert (whole > 0).mean() == pytest.approx(0.6, abs=0.03)
    assert not np.array_equal(whole, mlp.keep_mask(5, 4, 1, rows, 8, 0.4))


def trained(spark, plan_rows, partitions=3, **options):
    out = training.fit(matrix(spark, partitions=partitions), training.plans(spark, plan_rows), features=FEATURES, **options)
    return {(r.location, r.model): r for r in out.collect()}


def test_partitioning_and_slots_do_not_change_training(spark):
    """Batches by row number: any partitioning, and rows in memory or in the file, give the same history."""
    layers = mlp.deep(6, [(4, 0.2)])
    rows = [training.plan_row(p, m, layers, 1e-2) for p in ("jkt", "smg") for m in ("dnn", "other")]
    first = trained(spark, rows, 1, epochs=4, batch_rows=32, slots=1)
    second = trained(spark, rows, 7, epochs=4, batch_rows=32, slots=5)
    assert len(first) == 4
    for key, net in first.items():
        assert [tuple(h) for h in net.history] == [tuple(h) for h in second[key].history] and len(net.history) == 4
        assert net.weights == second[key].weights


def test_rows_in_a_file(monkeypatch):
    monkeypatch.setattr(training, "HELD_ROWS", 10)
    rows = np.arange(3 * 47, dtype=float).reshape(47, 3)
    store = training._Rows(3)
    for at in range(0, 47, 7):
        store.add(rows[at : at + 7])
    assert store.file is not None and store.spilled < 47
    for size in (1, 5, 16, 47, 100):
        for _ in range(2):
            blocks = list(store.blocks(size))
            assert [len(y) for _, y, _ in blocks] == [min(size, 47 - at) for at in range(0, 47, size)]
            assert np.array_equal(np.concatenate([x for x, _, _ in blocks])[:, 0], rows[:, 2])
            assert np.array_equal(np.concatenate([n for _, _, n in blocks]), rows[:, 0])


def test_batches_by_hand(spark):
    """Two batches of an epoch: a step each, the second from the weights of the first."""
    layers, start = mlp.shallow(3), mlp.initial_weights(mlp.shallow(3), 2, [7])
    net = trained(spark, [training.plan_row("jkt", "ann", layers, 0.01, start)], epochs=2, batch_rows=50)["jkt", "ann"]
    rows = sorted(matrix(spark).filter("location = 'jkt'").collect(), key=lambda r: r.row)
    x, y = np.array([[r.a, r.b] for r in rows]), np.array([r.label for r in rows])
    flat, steps, losses = mlp.flatten(start), mlp.Adam(13, 0.01), []
    for _ in range(2):
        total = 0.0
        for at, end in ((0, 50), (50, 96)):
            grad, error = mlp.gradient_sum(layers, mlp.unflatten(flat, layers, 2), x[at:end], y[at:end])
            flat, total = flat - steps.step(grad / (end - at)), total + error
        gap = mlp.forward(layers, mlp.unflatten(flat, layers, 2), x[96:])[-1][:, 0] - y[96:]
        losses.append((total / 96, (gap**2).mean()))
    assert [(h.loss, h.val_loss) for h in net.history] == [pytest.approx(l) for l in losses]
    assert net.weights == pytest.approx(flat.tolist())


def test_fit_learns_and_stops_early(spark):
    nets = trained(spark, [training.plan_row(p, "ann", mlp.shallow(12), 0.05) for p in ("jkt", "smg")], epochs=60)
    for net in nets.values():
        assert net.history[-1].loss < net.history[0].loss / 4
    rows = [training.plan_row("jkt", "ann", mlp.shallow(3), 0.0), training.plan_row("nowhere", "ann", mlp.shallow(3), 0.1)]
    nets = trained(spark, rows, epochs=50, patience=4)
    assert len(nets["jkt", "ann"].history) == 5 and nets["nowhere", "ann"].history == []
    more = matrix(spark).withColumn("part", F.lit("fit"))
    out = training.fit(more, training.plans(spark, rows[:1]), epochs=6, patience=1, features=FEATURES)
    assert [tuple(h) for h in training.history(out).select("epoch", "val_loss").collect()] == [(e, None) for e in range(1, 7)]


def test_search_and_best_networks(spark, tmp_path):
    tried = training.search(matrix(spark), trials=3, executions=2, epochs=4, features=FEATURES)
    rows = training.trial_scores(tried).collect()
    assert len(rows) == 2 * 2 * 3 and all(np.isfinite(r["val_loss"]) for r in rows)
    losses = {(r.location, r.model, r.trial, r.execution): r.best_loss for r in tried.collect()}
    assert len(losses) == 24
    for r in rows:
        assert r.val_loss == pytest.approx(np.mean([losses[r.location, r.model, r.trial, e] for e in (0, 1)]))
    best = training.best_networks(tried)
    path = str(tmp_path / "weights")
    best.write.parquet(path)
    back = spark.read.parquet(path).collect()
    assert {(n.location, n.model) for n in back} == {(p, m) for p in ("jkt", "smg") for m in ("ann", "dnn")}
    for n in back:
        same = [r for r in rows if (r.location, r.model) == (n.location, n.model)]
        assert n.trial == min(same, key=lambda r: r.val_loss).trial
        assert losses[n.location, n.model, n.trial, n.execution] == min(losses[n.location, n.model, n.trial, e] for e in (0, 1))
    again = training.fit(matrix(spark), spark.read.parquet(path), epochs=1, features=FEATURES)
    assert again.count() == 4


def test_draws_do_not_depend_on_other_sites(spark):
    sites = spark.createDataFrame([(f"s{i}",) for i in range(40)], "location string")
    every = {(r.location, r.model, r.trial): r for r in training.search_plans(sites, trials=4, executions=1).collect()}
    one = training.search_plans(sites.filter("location = 's7'"), trials=4, executions=1).collect()
    assert len(every) == 320 and all(every[r.location, r.model, r.trial] == r for r in one)
    assert len({str((r.layers, r.learning_rate)) for r in every.values()}) > 100
    for site in ("s1", "s2"):
        assert len({str((every[site, "ann", t].layers, every[site, "ann", t].learning_rate)) for t in range(1, 5)}) == 4


def test_many_sites(spark):
    """Hundreds of sites, one with a third of all rows: a row of losses for each network, no state in the driver."""
    base = matrix(spark).filter("location = 'jkt'").drop("location")
    sites = spark.range(300).select(F.concat(F.lit("s"), "id").alias("location"))
    many = base.crossJoin(sites).unionByName(base.crossJoin(spark.range(150)).select(F.lit("hot").alias("location"), (F.col("row") + 200 * F.col("id")).cast("int").alias("row"), "part", "a", "b", "label"))
    tried = training.search(many, models=("ann",), trials=2, executions=1, epochs=2, features=FEATURES)
    assert tried.count() == 602 and tried.filter("size(history) = 2").count() == 602
    scored = training.score(many.limit(2000), training.best_networks(tried), FEATURES, models=["ann"])
    assert scored.filter("ann_cooling_load is null").count() == 0


def test_score_equals_numpy(spark):
    weights, rows = {}, []
    for i, place in enumerate(("jkt", "smg")):
        for j, layers in enumerate((mlp.shallow(4), mlp.deep(3, [(2, 0.4)]))):
            model = ("ann", "dnn")[j]
            weights[place, model] = layers, mlp.initial_weights(layers, 2, [i, j])
            rows.append(training.plan_row(place, model, layers, weights=weights[place, model][1]))
    odd = [("other", 1, "fit", 0.1, 0.2, 0.3), (None, 1, "fit", 0.1, 0.2, 0.3), ("jkt", 999, "fit", None, 0.2, 0.3)]
    extra = spark.createDataFrame(odd, matrix(spark).schema)
    out = training.score(matrix(spark).union(extra), training.plans(spark, rows), FEATURES).collect()
    assert len(out) == 243
    for r in out:
        for (place, model), (layers, told) in weights.items():
            if place == r["location"] and r["a"] is not None:
                want = mlp.forward(layers, told, np.array([[r["a"], r["b"]]]))[-1][0, 0]
                assert r[f"{model}_cooling_load"] == pytest.approx(want)
        if r["location"] in ("other", None) or r["a"] is None:
            assert r["ann_cooling_load"] is None
    empty = training.score(matrix(spark).limit(0), training.plans(spark, rows), FEATURES)
    assert empty.columns[-2:] == ["ann_cooling_load", "dnn_cooling_load"] and empty.count() == 0


def series(spark, n=30):
    t = datetime(2021, 1, 1)
    rows = [(p, t + timedelta(hours=i * 11), float(i * (k + 1)), 3.0) for k, p in enumerate(("jkt", "smg")) for i in range(n)]
    return spark.createDataFrame(rows, "location string, time timestamp_ntz, x double, flat double")


def test_split_and_scale(spark):
    split = ordered_split(series(spark))
    counts = {(r["location"], r["part"]): r["count"] for r in split.groupBy("location", "part").count().collect()}
    assert counts == {(p, k): n for p in ("jkt", "smg") for k, n in (("fit", 16), ("val", 4), ("test", 10))}
    limits = bounds(split, ["x", "flat"])
    scaled = scale(split, limits, ["x", "flat"], 2)
    train = scaled.filter("part <> 'test'").agg(F.min("x"), F.max("x"), F.count("flat")).first()
    assert tuple(train) == (0.0, 1.0, 0)  # a constant column has no scale
    back = unscale(scaled, limits, ["x"], "x").orderBy("location", "time").collect()
    assert [r["x"] for r in back] == pytest.approx([r["x"] for r in split.orderBy("location", "time").collect()])


def test_metrics(spark):
    rows = [("m", 1.0, 2.0), ("m", 2.0, 2.5), ("m", 4.0, 3.0), ("flat", 1.0, 5.0), ("flat", 1.0, 6.0)]
    df = spark.createDataFrame(rows, "model string, y double, p double")
    out = {r["model"]: r for r in regression_metrics(df, ["model"], "y", "p").collect()}
    y, p = np.array([1, 2, 4.0]), np.array([2, 2.5, 3])
    rmse = np.sqrt(((y - p) ** 2).mean())
    assert out["m"]["rmse"] == pytest.approx(rmse) and out["m"]["cv_rmse"] == pytest.approx(100 * rmse / y.mean())
    assert out["m"]["mape"] == pytest.approx(100 * (abs(y - p) / y).mean())
    assert out["m"]["r2"] == pytest.approx(np.corrcoef(y, p)[0, 1] ** 2)
    assert out["flat"]["r2"] is None
    line = trend_line(df.filter("model = 'm'"), ["model"], "y", "p").first()
    assert (line["slope"], line["intercept"]) == pytest.approx(tuple(np.polyfit(y, p, 1)))


def test_correlation_of_constant_column_is_missing(spark):
    out = {(r["location"], r["a"], r["b"]): r["r"] for r in correlation_matrix(series(spark), ["x", "flat"]).collect()}
    assert out["jkt", "x", "x"] == 1.0 and out["jkt", "x", "flat"] is None and out["jkt", "flat", "flat"] is None


def test_forecast_end_to_end(spark):
    """Train on a known relation, then project and roll up."""
    from loadcast.operators.features import projection_features, training_table
    from loadcast.params import LAGGED

    def profile(year, warm=0.0):
        rows = []
        for p in ("jkt", "smg"):
            for m in range(1, 13):
                for h in range(24):
                    t = datetime(year, m, 1 if h >= 8 else 2, h)
                    temp = 26 + 4 * np.sin((h - 8) / 24 * 2 * np.pi) + m / 12 + warm
                    rows.append((p, t, 20.0 + m / 10, float(temp), float(max(0, 12 - abs(12 - h)) * 60), m / 20))
        return spark.createDataFrame(rows, "location string, time timestamp_ntz, " + ", ".join(f"{c} double" for c in LAGGED))

    weather = profile(2021)
    load = weather.select("location", "time", (F.col("temp") * 40 + F.col("ssrd") / 10).alias("avg_cooling_load"))
    table = training_table(weather, load, {"jkt": 2021, "smg": 2021})
    data = forecast.split_scale(table, 2)
    plan = training.plans(spark, [training.plan_row(p, m, mlp.shallow(10), 0.05) for p in ("jkt", "smg") for m in ("ann", "dnn")])
    nets = training.fit(data.matrix, plan, epochs=60, patience=None)
    scores = forecast.evaluate(forecast.test_predictions(data, nets)).collect()
    assert len(scores) == 4 and all(r["cv_rmse"] < 15 for r in scores)

    synthetic = None
    for code, warm in (("26", 0.5), ("45", 1.0), ("85", 2.0)):
        part = profile(2022, warm).withColumn("scenario", F.lit(code))
        synthetic = part if synthetic is None else synthetic.unionByName(part)
    loads = forecast.project_load(projection_features(synthetic), data.limits, nets, 2)
    monthly = forecast.monthly_loads(forecast.loads_by_scenario(loads))
    assert monthly.count() == 24
    annual = forecast.annual_loads(monthly, table).orderBy("location", "year").collect()
    assert [(r["location"], r["year"]) for r in annual] == [("jkt", 2021), ("jkt", 2022), ("smg", 2021), ("smg", 2022)]
    for r in annual:
        if r["year"] == 2022:
            assert r["dnn_cooling_load_26"] < r["dnn_cooling_load_45"] < r["dnn_cooling_load_85"]


def test_yardsticks(spark):
    """Linear regression equals least squares per location; trees follow what is not linear."""
    from loadcast.operators import crosscheck

    places = ["jkt", "smg"]
    rows = matrix(spark).withColumn("part", F.when(F.col("row") % 6 == 0, "test").otherwise(F.col("part")))
    line = crosscheck.predict(rows, crosscheck.fit_linear(rows, places, FEATURES), "linear", places, FEATURES).collect()
    for place in places:
        train = [r for r in line if r.location == place and r.part != "test"]
        x = np.array([[r.a, r.b, 1.0] for r in train])
        told = np.linalg.lstsq(x, np.array([r.label for r in train]), rcond=None)[0]
        for r in line:
            if r.location == place:
                assert r.linear == pytest.approx(np.array([r.a, r.b, 1.0]) @ told, abs=1e-6)
    trees = crosscheck.predict(rows, crosscheck.fit_trees(rows, places, FEATURES), "trees", places, FEATURES)
    assert trees.columns == [*rows.columns, "trees"]
    errors = trees.filter("part = 'test'").select(F.avg((F.col("trees") - F.col("label")) ** 2)).first()[0]
    assert errors < 0.002
