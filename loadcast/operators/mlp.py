"""Small dense regression networks on arrays: layers, gradients, dropout, optimiser, training.

Everything here works on one network and rows that a task hands over in blocks;
``training`` brings networks and rows together.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import cloudpickle

# Workers get this module's functions with the task, wherever the package lives.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Optimizer constants and the search space of the study.
BETA1, BETA2, ADAM_EPSILON = 0.9, 0.999, 1e-7
UNITS = (1, 22)
HIDDEN_LAYERS = (1, 10)
DROPOUT_RATES = (0.0, 0.2, 0.4)
LEARNING_RATES = (1e-2, 1e-3, 1e-4)

# A point of the search space that was tried already is drawn again so often.
REDRAWS = 100

Weights = list[tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Layer:
    units: int
    activation: str = "relu"
    dropout: float = 0.0


OUTPUT = Layer(1, "linear")


def shallow(units: int) -> list[Layer]:
    return [Layer(units), OUTPUT]


def deep(units: int, hidden: Sequence[tuple[int, float]], interleaved_output: bool = False) -> list[Layer]:
    """First layer, then (units, dropout) layers, then one linear output.

    ``interleaved_output`` puts a one-unit linear layer behind every hidden layer.
    """
    layers = [Layer(units)]
    for n, rate in hidden:
        layers.append(Layer(n, "relu", rate))
        if interleaved_output:
            layers.append(OUTPUT)
    return layers if interleaved_output else [*layers, OUTPUT]


def initial_weights(layers: Sequence[Layer], inputs: int, seed: Sequence[int]) -> Weights:
    """Glorot-uniform kernels and zero biases."""
    rng = np.random.default_rng(seed)
    weights = []
    for layer in layers:
        limit = np.sqrt(6.0 / (inputs + layer.units))
        weights.append((rng.uniform(-limit, limit, (inputs, layer.units)), np.zeros(layer.units)))
        inputs = layer.units
    return weights


def flatten(weights: Weights) -> np.ndarray:
    return np.concatenate([part.ravel() for pair in weights for part in pair])


def unflatten(flat: np.ndarray, layers: Sequence[Layer], inputs: int) -> Weights:
    out, at = [], 0
    for layer in layers:
        k = flat[at : at + inputs * layer.units].reshape(inputs, layer.units)
        at += k.size
        out.append((k, flat[at : at + layer.units]))
        at += layer.units
        inputs = layer.units
    return out


def mixed(z):
    """A 32-bit hash of 32-bit numbers, with products that stay below 2 ** 64."""
    z = ((z ^ (z >> 16)) * 0x7FEB352D) & 0xFFFFFFFF
    z = ((z ^ (z >> 15)) * 0x846CA68B) & 0xFFFFFFFF
    return z ^ (z >> 16)


def mask_salt(seed: int, epoch: int, layer: int) -> int:
    return mixed(mixed(mixed(seed & 0xFFFFFFFF) + epoch & 0xFFFFFFFF) + layer & 0xFFFFFFFF)


def keep_mask(seed: int, epoch: int, layer: int, rows: np.ndarray, units: int, rate: float) -> np.ndarray:
    """Inverted-dropout mask that depends on the row's number, not on its partition.

    A unit of a row is kept where a hash of (seed, epoch, layer, row, unit) is at
    least ``rate`` of its range.
    """
    cells = rows.astype(np.uint64)[:, None] * np.uint64(units) + np.arange(units, dtype=np.uint64)[None, :]
    z = mixed((cells + np.uint64(mask_salt(seed, epoch, layer))) & np.uint64(0xFFFFFFFF))
    return (z >= rate * 2.0**32) / (1.0 - rate)


def forward(layers: Sequence[Layer], weights: Weights, x: np.ndarray, masks: dict[int, np.ndarray] | None = None) -> list[np.ndarray]:
    """Inputs of each layer, then the output."""
    values = [x]
    for i, (layer, (kernel, bias)) in enumerate(zip(layers, weights)):
        z = values[-1] @ kernel + bias
        if layer.activation == "relu":
            z = np.maximum(z, 0.0)
        if masks and i in masks:
            z = z * masks[i]
        values.append(z)
    return values


def gradient_sum(layers, weights, x, y, masks=None) -> tuple[np.ndarray, float]:
    """Gradient of the summed squared error as one flat vector, and that error."""
    values = forward(layers, weights, x, masks)
    error = values[-1][:, 0] - y
    delta = 2.0 * error[:, None]
    parts = []
    for i in range(len(layers) - 1, -1, -1):
        if masks and i in masks:
            delta = delta * masks[i]
        if layers[i].activation == "relu":
            delta = delta * (values[i + 1] > 0)
        parts.append(np.concatenate([(values[i].T @ delta).ravel(), delta.sum(axis=0)]))
        delta = delta @ weights[i][0].T
    return np.concatenate(parts[::-1]), float(error @ error)


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = BETA1 * self.m + (1 - BETA1) * grad
        self.v = BETA2 * self.v + (1 - BETA2) * grad * grad
        rate = self.rate * np.sqrt(1 - BETA2**self.t) / (1 - BETA1**self.t)
        return rate * self.m / (np.sqrt(self.v) + ADAM_EPSILON)


# Blocks of rows as (inputs, labels, row numbers); each call reads them again from the first.
Blocks = Callable[[], Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]]


@dataclass
class Trained:
    weights: np.ndarray
    history: list[tuple[int, float, float]] = field(default_factory=list)
    best_loss: float = float("inf")
    best_weights: np.ndarray | None = None


def train(
    layers: Sequence[Layer], start: np.ndarray, rate: float, fit: Blocks, val: Blocks, epochs: int, patience: int | None, seed: int
) -> Trained:
    """Epochs of one optimiser step per block of ``fit``, in the order of the blocks.

    An epoch's loss is the mean squared error of its blocks, each before its own
    step; the validation loss is that of the weights after the epoch.  Training
    ends once the latter has not improved for ``patience`` epochs; the last and the
    best weights are kept.  Without rows to validate nothing ends it early.
    """
    out, flat, waited = Trained(start), start, 0
    for epoch in range(epochs):
        steps = steps if epoch else Adam(len(flat), rate)
        total, n = 0.0, 0
        for x, y, rows in fit():
            masks = {i: keep_mask(seed, epoch, i, rows, layer.units, layer.dropout) for i, layer in enumerate(layers) if layer.dropout > 0}
            grad, error = gradient_sum(layers, unflatten(flat, layers, x.shape[1]), x, y, masks)
            flat = flat - steps.step(grad / len(y))
            total, n = total + error, n + len(y)
        if not n:
            return out
        val_total, val_n = 0.0, 0
        for x, y, _ in val():
            gap = forward(layers, unflatten(flat, layers, x.shape[1]), x)[-1][:, 0] - y
            val_total, val_n = val_total + float(gap @ gap), val_n + len(y)
        loss = val_total / val_n if val_n else float("nan")
        out.history.append((epoch + 1, total / n, loss))
        out.weights = flat
        if loss < out.best_loss:
            out.best_loss, out.best_weights, waited = loss, flat, 0
        else:
            waited += 1
            if val_n and patience is not None and waited >= patience:
                break
    return out


def draw_trial(rng: np.random.Generator, model: str, interleaved_output: bool = False) -> tuple[list[Layer], float]:
    """One random point of the search space."""

    def units() -> int:
        return int(rng.integers(UNITS[0], UNITS[1] + 1))

    rate = float(rng.choice(LEARNING_RATES))
    if model == "ann":
        return shallow(units()), rate
    depth = int(rng.integers(HIDDEN_LAYERS[0], HIDDEN_LAYERS[1] + 1))
    hidden = [(units(), float(rng.choice(DROPOUT_RATES))) for _ in range(depth)]
    return deep(units(), hidden, interleaved_output), rate


def draw_trials(rng: np.random.Generator, model: str, trials: int, interleaved_output: bool = False) -> list[tuple[list[Layer], float]]:
    """Points of the search space, different ones as long as ``REDRAWS`` draws find any."""
    tried: list[tuple[list[Layer], float]] = []
    for _ in range(trials):
        point = draw_trial(rng, model, interleaved_output)
        for _ in range(REDRAWS):
            if point not in tried:
                break
            point = draw_trial(rng, model, interleaved_output)
        tried.append(point)
    return tried
