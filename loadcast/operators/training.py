"""Networks as tables: searched, trained, chosen and applied as Spark jobs.

A network is a row: its place (location, model, trial, execution), its layers,
learning rate, weights, losses.  No list of networks and no weights are ever in
the driver, and nothing is broadcast.

Training goes through rows in order, a step per batch, so a network's steps
follow one another however many machines there are; what runs in parallel are
networks.  The matrix is partitioned by location and slot (a share of a
location's networks) and sorted, networks first, rows behind them by number.  A
task reads this stream once, keeps the rows of one location as arrays, beyond
``HELD_ROWS`` in an unnamed file where Spark itself spills, and trains the
slot's networks for all their epochs.  So a search is one job, its matrix is
read once, and a location with a third of all rows costs disk, not memory.

Scoring likewise sorts a location's networks before its rows, which are dealt to
``SCORE_PARTS`` parts per location.
"""

from __future__ import annotations

import itertools
import os
import sys
import tempfile
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcast.operators.mlp import Layer, draw_trials, flatten, forward, initial_weights, train, unflatten
from loadcast.params import FEATURES, LABEL
from loadcast.sources.scratch import materialize

# Workers get this module's functions with the task, wherever the package lives.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LAYERS = "array<struct<units: int, activation: string, dropout: double>>"
PLACE = "location string, model string, trial int, execution int"
PLAN = f"{PLACE}, learning_rate double, layers {LAYERS}, weights array<double>"
HISTORY = "array<struct<epoch: int, loss: double, val_loss: double>>"
NETWORKS = f"{PLAN}, best_loss double, best_weights array<double>, history {HISTORY}"

FIT_BATCH, SEARCH_BATCH = 256, 128  # rows a step
FIT_SLOTS, SEARCH_SLOTS = 2, 8  # shares of a location's networks
TASKS_PER_PARTITION = 4
HELD_ROWS = 1 << 18
SCORE_PARTS = 32

ArrowRun = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def plan_row(location: str, model: str, layers: Sequence[Layer], learning_rate: float = 1e-3, weights=None) -> tuple:
    """A network to be trained, as a row of ``PLAN``."""
    start = None if weights is None else flatten(weights).tolist()
    return (location, model, 0, 0, learning_rate, [(l.units, l.activation, l.dropout) for l in layers], start)


def plans(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), PLAN)


def search_plans(
    locations: DataFrame, models: Sequence[str] = ("ann", "dnn"), trials: int = 10, executions: int = 3, seed: int = 500, interleaved_output: bool = False
) -> DataFrame:
    """Random points of the search space for each location and kind of network, ``executions`` networks each."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for location, model in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rng = np.random.default_rng([seed, _number(location), _number(model)])
                for trial, (layers, rate) in enumerate(draw_trials(rng, model, trials, interleaved_output), 1):
                    told = [{"units": l.units, "activation": l.activation, "dropout": l.dropout} for l in layers]
                    rows += [(location, model, trial, e, rate, told, None) for e in range(executions)]
            columns = zip(*rows) if rows else [()] * len(_PLAN_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PLAN_TYPES.values())], names=list(_PLAN_TYPES))

    named = locations.select("location").distinct().withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    return named.mapInArrow(drawn, PLAN)


_LAYERS_TYPE = pa.list_(pa.struct([("units", pa.int32()), ("activation", pa.string()), ("dropout", pa.float64())]))
_DOUBLES = pa.list_(pa.float64())
_PLAN_TYPES = {
    "location": pa.string(),
    "model": pa.string(),
    "trial": pa.int32(),
    "execution": pa.int32(),
    "learning_rate": pa.float64(),
    "layers": _LAYERS_TYPE,
    "weights": _DOUBLES,
}
_NETWORK_TYPES = {
    **_PLAN_TYPES,
    "best_loss": pa.float64(),
    "best_weights": _DOUBLES,
    "history": pa.list_(pa.struct([("epoch", pa.int32()), ("loss", pa.float64()), ("val_loss", pa.float64())])),
}


def _number(text: str) -> int:
    return zlib.crc32(text.encode())


def fit(
    matrix: DataFrame,
    plan: DataFrame,
    epochs: int = 250,
    patience: int | None = 20,
    batch_rows: int = FIT_BATCH,
    seed: int = 500,
    features: Sequence[str] = FEATURES,
    slots: int = FIT_SLOTS,
) -> DataFrame:
    """The networks of ``plan`` trained on ``matrix`` (location, row, part, features, label), as a written table.

    Rows of part ``fit`` train in batches of ``batch_rows`` by their number, those
    of part ``val`` validate, others are not read.  A network goes on from its
    weights if it has any.  Networks without training rows stay as they are, with
    an empty history; rows without networks are ignored.
    """
    features = list(features)
    slot = F.pmod(F.xxhash64("model", "trial", "execution"), F.lit(slots)).cast("int")
    told = F.struct(*[c for c in plan.columns if c != "location"])
    networks = plan.select("location", slot.alias("slot"), F.lit(0).alias("row"), told.alias("plan"))
    every_slot = F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")
    values = [F.col(c).cast("double") for c in ("label", *features)]
    rows = matrix.filter(F.col("part").isin("fit", "val")).select("location", every_slot, "row", (F.col("part") == "fit").alias("is_fit"), *values)
    stream = networks.unionByName(rows, allowMissingColumns=True).select("location", "slot", "row", "plan", "is_fit", "label", *features)
    parts = TASKS_PER_PARTITION * int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = stream.repartition(parts, "location", "slot").sortWithinPartitions("location", "slot", F.col("plan").isNull(), "row")
    return materialize(ordered.mapInArrow(_training(epochs, patience, batch_rows, seed, len(features)), NETWORKS), "networks")


def search(
    matrix: DataFrame,
    models: Sequence[str] = ("ann", "dnn"),
    trials: int = 10,
    executions: int = 3,
    epochs: int = 250,
    batch_rows: int = SEARCH_BATCH,
    seed: int = 500,
    features: Sequence[str] = FEATURES,
    interleaved_output: bool = False,
) -> DataFrame:
    """All networks of a random search over every location of ``matrix``, trained."""
    plan = search_plans(matrix, models, trials, executions, seed, interleaved_output)
    return fit(matrix, plan, epochs, None, batch_rows, seed, features, SEARCH_SLOTS)


def trial_scores(networks: DataFrame) -> DataFrame:
    """One row per trial; its ``val_loss`` is the mean over its executions of their lowest validation loss."""
    shape = [F.col(f"layers.{c}").alias(c) for c in ("units", "dropout")]
    told = networks.select("location", "model", "trial", "execution", *shape, "learning_rate", "best_loss")
    first = [F.min_by(c, "execution").alias(c) for c in ("units", "dropout", "learning_rate")]
    return told.groupBy("location", "model", "trial").agg(*first, F.avg("best_loss").alias("val_loss"))


def best_trials(trials: DataFrame) -> DataFrame:
    """(location, model, trial, val_loss) of the least loss, of equal ones the first trial."""
    best = F.min(F.struct("val_loss", "trial")).alias("best")
    return trials.groupBy("location", "model").agg(best).select("location", "model", "best.trial", "best.val_loss")


def best_networks(networks: DataFrame) -> DataFrame:
    """The best execution of the best trial of each location and kind, its best weights as a plan to go on from."""
    winners = best_trials(trial_scores(networks)).select("location", "model", "trial")
    of_winners = networks.select("location", "model", "trial", "execution", "best_loss").join(winners, ["location", "model", "trial"])
    best = of_winners.groupBy("location", "model", "trial").agg(F.min(F.struct("best_loss", "execution")).alias("best"))
    chosen = best.select("location", "model", "trial", F.col("best.execution").alias("execution"))
    kept = networks.join(chosen, ["location", "model", "trial", "execution"])
    columns = [c for c in _PLAN_TYPES if c != "weights"]
    return kept.select(*columns, F.coalesce("best_weights", "weights").alias("weights"))


def history(networks: DataFrame) -> DataFrame:
    """(location, model, epoch, loss, val_loss) of each network."""
    return networks.select("location", "model", F.inline("history"))


class _Rows:
    """Rows of one location in order, as arrays; many go to a file."""

    def __init__(self, width: int):
        self.width, self.held, self.n, self.file, self.spilled = width, [], 0, None, 0

    def add(self, rows: np.ndarray) -> None:
        self.held.append(rows)
        self.n += len(rows)
        if self.n - self.spilled > HELD_ROWS:
            self.file = self.file or tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
            self.file.seek(0, os.SEEK_END)
            self.file.write(np.concatenate(self.held).tobytes())
            self.spilled, self.held = self.n, []

    def blocks(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(inputs, labels, numbers) of ``size`` rows each, the last ones fewer."""
        tail = np.concatenate(self.held) if self.held else np.empty((0, self.width))
        self.held = [tail]
        for at in range(0, self.n, size):
            parts = [tail[max(at - self.spilled, 0) : max(at + size - self.spilled, 0)]]
            if at < self.spilled:
                self.file.seek(at * self.width * 8)
                count = min(size, self.spilled - at) * self.width
                parts.insert(0, np.frombuffer(self.file.read(count * 8)).reshape(-1, self.width))
            block = np.concatenate(parts) if len(parts) > 1 else parts[0]
            yield block[:, 2:], block[:, 1], block[:, 0].astype(np.int64)


def _runs(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows with equal keys."""
    at = 0
    for key, group in itertools.groupby(zip(*[batch.column(k).to_pylist() for k in keys])):
        n = sum(1 for _ in group)
        yield key, batch.slice(at, n)
        at += n


def _training(epochs: int, patience: int | None, batch_rows: int, seed: int, inputs: int) -> ArrowRun:
    def networks(location: str, told: list[dict], fit_rows: _Rows, val_rows: _Rows) -> pa.RecordBatch:
        rows = []
        for p in told:
            layers = [Layer(**l) for l in p["layers"]]
            salt = [_number(location), _number(p["model"]), p["trial"], p["execution"]]
            start = np.array(p["weights"], float) if p["weights"] is not None else flatten(initial_weights(layers, inputs, [seed, *salt]))
            done = train(layers, start, p["learning_rate"], lambda: fit_rows.blocks(batch_rows), lambda: val_rows.blocks(8192), epochs, patience, mask_seed(seed, p["trial"], p["execution"]))
            kept = {**p, "location": location, "weights": done.weights.tolist(), "best_loss": done.best_loss if done.best_weights is not None else float("nan")}
            kept["best_weights"] = None if done.best_weights is None else done.best_weights.tolist()
            kept["history"] = [{"epoch": e, "loss": l, "val_loss": None if np.isnan(v) else v} for e, l, v in done.history]
            rows.append(kept)
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in _NETWORK_TYPES.items()], names=list(_NETWORK_TYPES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, told, fit_rows, val_rows = None, [], None, None
        for batch in batches:
            for key, part in _runs(batch, ("location", "slot")):
                if key != now:
                    if told:
                        yield networks(now[0], told, fit_rows, val_rows)
                    now, told, fit_rows, val_rows = key, [], _Rows(inputs + 2), _Rows(inputs + 2)
                plan = part.column("plan")
                told += part.filter(plan.is_valid()).column("plan").to_pylist()
                rows = part.filter(plan.is_null())
                if not told or not rows.num_rows:
                    continue
                values = np.column_stack([rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("row", *rows.schema.names[5:])])
                is_fit = rows.column("is_fit").to_numpy(zero_copy_only=False).astype(bool)
                for store, some in ((fit_rows, values[is_fit]), (val_rows, values[~is_fit])):
                    if len(some):
                        store.add(some)
        if told:
            yield networks(now[0], told, fit_rows, val_rows)

    return run


def mask_seed(seed: int, trial: int, execution: int) -> int:
    return seed + trial * 101 + execution


def score(
    df: DataFrame, networks: DataFrame, features: Sequence[str] = FEATURES, suffix: str = "_cooling_load", models: Sequence[str] = ("ann", "dnn")
) -> DataFrame:
    """Add one prediction column (scaled units) per kind of network named.

    ``networks`` has one row per location and model, with layers and weights.
    Locations without a network, a null one among them, get null.  A null
    feature gives null.
    """
    features, models = list(features), list(models)
    part = F.pmod(F.xxhash64(*df.columns), F.lit(SCORE_PARTS)).cast("int")
    names = [f"{m}{suffix}" for m in models]
    rows = df.select(*df.columns, part.alias("_part"), F.lit(None).cast(f"struct<model: string, layers: {LAYERS}, weights: array<double>>").alias("_net"))
    sent = networks.filter(F.col("model").isin(models)).select(
        "location", F.explode(F.sequence(F.lit(0), F.lit(SCORE_PARTS - 1))).alias("_part"), F.struct("model", "layers", "weights").alias("_net")
    )
    stream = rows.unionByName(sent, allowMissingColumns=True).repartition("location", "_part").sortWithinPartitions("location", "_part", F.col("_net").isNull())
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    return stream.mapInArrow(_scoring(models, features, df.columns, names), schema)


def _scoring(models: list[str], features: list[str], columns: list[str], names: list[str]) -> ArrowRun:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nets = None, {}
        for batch in batches:
            for key, part in _runs(batch, ("location", "_part")):
                if key != now:
                    now, nets = key, {}
                plan = part.column("_net")
                for net in part.filter(plan.is_valid()).column("_net").to_pylist():
                    layers = [Layer(**l) for l in net["layers"]]
                    nets[net["model"]] = layers, unflatten(np.array(net["weights"], float), layers, len(features))
                rows = part.filter(plan.is_null())
                if not rows.num_rows:
                    continue
                x = np.column_stack([rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features])
                out = [rows.column(c) for c in columns]
                for model in models:
                    told = forward(*nets[model], x)[-1][:, 0] if model in nets else np.full(len(x), np.nan)
                    out.append(pa.array(told, pa.float64(), from_pandas=True))
                yield pa.RecordBatch.from_arrays(out, names=[*columns, *names])

    return run


def training_matrix(scaled: DataFrame, features: Sequence[str] = FEATURES, label: str | Column = LABEL) -> DataFrame:
    """Scaled split rows in the layout ``fit`` reads; constant features count as 0."""
    return scaled.na.fill(0.0, list(features)).select("location", "time", "row", "part", *features, F.col(label).alias("label"))
