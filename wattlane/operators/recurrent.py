"""Recurrent sequence model (M5): stacked LSTM layers over the window and a linear output, trained on mean squared error.

Training is data parallel.  The windows stay where they are; a step sends the
parameters (a few kB) to the tasks, each sums loss and gradient over its Arrow
batches by back-propagation through time, and one aggregate adds the sums up.
The driver holds parameters and their Adam moments, nothing of the data.  With
``batch_share`` under 1 a step takes the windows that a hash of their key and of
the step picks, so a rerun takes the same ones.

Inputs and target are standardised by the mean and deviation of the training
targets (one aggregate).  The fitted network is served through
``models.sequence_model_udf``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.config import SEQUENCE_LENGTH
from wattlane.operators.models import sequence_model_udf

#: Units of the two stacked layers of the sequence model.
LAYERS = (64, 32)
KEY = ("series_id", "ts", "arrival_no")
#: Windows that a task takes through the network at once.
PACK = 1024


def _sigmoid_of_negative(z: np.ndarray) -> None:
    """1 / (1 + exp(z)), in place."""
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
    z += 1
    np.reciprocal(z, out=z)


class Network:
    """Shapes of the stacked layers over one flat parameter vector."""

    def __init__(self, inputs: int, layers: Sequence[int]):
        self.layers = list(zip([inputs, *layers[:-1]], layers))
        self.shapes = [s for i, h in self.layers for s in ((i, 4 * h), (h, 4 * h), (4 * h,))] + [(layers[-1],), (1,)]
        self.size = sum(int(np.prod(s)) for s in self.shapes)

    def parts(self, flat: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes])
        return [flat[e - int(np.prod(s)):e].reshape(s) for e, s in zip(ends, self.shapes)]

    def start(self, seed: int) -> np.ndarray:
        """Uniform in plus and minus one over the root of the units; forget gates start open."""
        rng, flat = np.random.default_rng(seed), np.zeros(self.size)
        parts = self.parts(flat)
        for k, (_, h) in enumerate(self.layers):
            for p in parts[3 * k:3 * k + 2]:
                p[...] = rng.uniform(-1, 1, p.shape) / np.sqrt(h)
            parts[3 * k + 2][h:2 * h] = 1.0
        parts[-2][...] = rng.uniform(-1, 1, parts[-2].shape) / np.sqrt(len(parts[-2]))
        return flat

    def forward(self, flat: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Outputs for x (windows, steps, inputs), and per layer what the way back needs. Arrays are (steps, units, windows), so
        a gate is one stretch of memory; tanh x is twice the sigmoid of 2 x less 1, so one exp serves the four gates."""
        parts, kept = self.parts(flat), []
        x = np.ascontiguousarray(x.transpose(1, 2, 0))
        steps, _, n = x.shape
        for k, (_, h) in enumerate(self.layers):
            wx, wh, b = parts[3 * k:3 * k + 3]
            sign = np.repeat((-1.0, -2.0), (3 * h, h))
            from_out = np.ascontiguousarray((wh * sign).T)
            gates = np.matmul((wx * sign).T, x) + (b * sign)[:, None]  # in, forget, out, candidate
            out, cell, bent = (np.zeros((steps, h, n)) for _ in range(3))
            for t in range(steps):
                z = gates[t]
                if t:
                    z += from_out @ out[t - 1]
                _sigmoid_of_negative(z)
                z[3 * h:] *= 2
                z[3 * h:] -= 1
                np.multiply(z[:h], z[3 * h:], out=cell[t])
                if t:
                    cell[t] += z[h:2 * h] * cell[t - 1]
                np.multiply(cell[t], -2, out=bent[t])
                _sigmoid_of_negative(bent[t])
                bent[t] *= 2
                bent[t] -= 1
                np.multiply(z[2 * h:3 * h], bent[t], out=out[t])
            kept.append((x, out, cell, bent, gates))
            x = out
        return parts[-2] @ x[-1] + parts[-1][0], kept

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of squared errors over the windows and its gradient, back through time."""
        parts, grad = self.parts(flat), np.zeros(self.size)
        into = self.parts(grad)
        pred, kept = self.forward(flat, x)
        err = pred - y
        d = 2 * err
        into[-2][...] = kept[-1][1][-1] @ d
        into[-1][...] = d.sum()
        above = None
        for k in range(len(self.layers) - 1, -1, -1):
            h = self.layers[k][1]
            wx, wh, _ = parts[3 * k:3 * k + 3]
            gx, gh, gb = into[3 * k:3 * k + 3]
            x_in, out, cell, bent, gates = kept[k]
            dz = np.empty(gates.shape)
            d_out = np.outer(parts[-2], d) if above is None else above[-1]
            d_cell = np.zeros(out[0].shape)
            for t in range(len(gates) - 1, -1, -1):
                i, f, o, c = (gates[t, j * h:(j + 1) * h] for j in range(4))
                d_cell += d_out * o * (1 - bent[t] ** 2)
                z = dz[t]
                z[:h] = d_cell * c * i * (1 - i)
                z[h:2 * h] = d_cell * cell[t - 1] * f * (1 - f) if t else 0.0
                z[2 * h:3 * h] = d_out * out[t] * (1 - o)
                z[3 * h:] = d_cell * i * (1 - c ** 2)
                if t:
                    d_out = wh @ z if above is None else wh @ z + above[t - 1]
                    d_cell *= f
            back = dz.transpose(0, 2, 1)
            gx += np.matmul(x_in, back).sum(axis=0)
            gh += np.matmul(out[:-1], back[1:]).sum(axis=0)
            gb += dz.sum(axis=(0, 2))
            above = np.matmul(wx, dz) if k else None
        return float(err @ err), grad


@dataclass
class RecurrentModel:
    """A fitted network; ``losses`` is the standardised mean squared error of each step's windows before the step."""

    layers: tuple[int, ...]
    steps: int
    mean: float
    scale: float
    weights: np.ndarray
    losses: list[float] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Next values for windows (rows, steps)."""
        x = (np.asarray(x, np.float64).reshape(len(x), self.steps) - self.mean) / self.scale
        return Network(1, self.layers).forward(self.weights, x[:, :, None])[0] * self.scale + self.mean

    def udf(self, batch_size: int = 1024):
        """The network behind the sequence-model hook."""
        return sequence_model_udf(lambda: self.predict, self.steps, batch_size)

    def transform(self, sequences: DataFrame, seq_col: str = "seq", prediction: str = "seq_pred") -> DataFrame:
        return sequences.withColumn(prediction, self.udf()(F.col(seq_col)))


def window_rows(batch: pa.RecordBatch, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows and targets of a batch of rows (x: array<double>, y)."""
    for lo in range(0, batch.num_rows, PACK):
        part = batch.slice(lo, PACK)
        yield part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, steps), part.column(1).to_numpy(zero_copy_only=False)


def pack(rows: DataFrame, steps: int) -> DataFrame:
    """Rows (x, y) as stretches of ``PACK`` windows, each a binary of doubles: every step of the fit reads them as they are."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in window_rows(b, steps):
                yield pa.RecordBatch.from_arrays([pa.array([a.astype("<f8").tobytes()], pa.binary()) for a in (x, y)], names=["x", "y"])

    return rows.mapInArrow(packed, "x binary, y binary")


def spread(data: DataFrame, *by: str) -> DataFrame:
    """Over all cores, some tasks each: a window is a few bytes and much arithmetic, so partitions cut by bytes are too few."""
    return data.repartition(4 * data.sparkSession.sparkContext.defaultParallelism, *by)


def packed_rows(batch: pa.RecordBatch, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for x, y in zip(batch.column(0), batch.column(1), strict=True):
        yield np.frombuffer(x.as_py(), "<f8").reshape(-1, steps), np.frombuffer(y.as_py(), "<f8")


def block_rows(batch: pa.RecordBatch, steps: int, share: float = 1.0, seed: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Training windows and targets of a batch of blocks (values, n_train, key hash): strided views over the values.
    Windows with a NULL or NaN in them or as target do not train; under a ``share`` of 1 the draw hangs on key hash and seed."""
    for values, n, key in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
        if not n:
            continue
        v = values.values.to_numpy(zero_copy_only=False)[:steps + n]
        windows = np.lib.stride_tricks.sliding_window_view(v, steps + 1)
        take = ~np.isnan(windows).any(axis=1)
        if share < 1:
            take &= np.random.default_rng([key & (1 << 63) - 1, seed]).random(n) < share
        if take.any():
            yield windows[take, :steps], windows[take, steps]


def gradient_sums(data: DataFrame, layers: Sequence[int], weights: np.ndarray, mean: float, scale: float, steps: int,
                  read: Callable[..., Iterator] = window_rows, **how) -> tuple[float, float, np.ndarray]:
    """(windows, squared error, gradient) summed over the windows that ``read`` finds in the Arrow batches of ``data``:
    one aggregate of a row per parameter."""
    layers, size = tuple(layers), len(weights)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, out = Network(1, layers), np.zeros(size + 2)
        for b in batches:
            for x, y in read(b, steps, **how):
                for lo in range(0, len(y), PACK):
                    own = slice(lo, lo + PACK)
                    loss, grad = net.gradient(weights, ((x[own] - mean) / scale)[:, :, None], (y[own] - mean) / scale)
                    out += np.concatenate(([len(y[own]), loss], grad))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2)), pa.array(out)], names=["at", "value"])

    rows = data.mapInArrow(partial, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(size + 2)
    for at, value in rows:
        total[at] = value
    return total[0], total[1], total[2:]


def _descend(model: RecurrentModel, steps: int, rate: float, sums: Callable[[int, RecurrentModel], tuple]) -> RecurrentModel:
    """Adam; ``sums(step, model)`` adds up the gradient of a step."""
    first, second = np.zeros(len(model.weights)), np.zeros(len(model.weights))
    for k in range(1, steps + 1):
        count, loss, grad = sums(k, model)
        if not count:
            continue
        model.losses.append(loss / count)
        grad = grad / count
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad ** 2
        model.weights = model.weights - rate * (first / (1 - 0.9 ** k)) / (np.sqrt(second / (1 - 0.999 ** k)) + 1e-8)
    return model


def _start(targets: DataFrame, layers: Sequence[int], seq_len: int, seed: int) -> RecurrentModel:
    """An unfitted network, scaled by the training targets (one aggregate)."""
    n, mean, scale = targets.agg(F.count("*"), F.avg("y"), F.stddev_pop("y")).first()
    if not n:
        raise ValueError("no whole window to train on")
    return RecurrentModel(tuple(layers), seq_len, mean, scale or 1.0, Network(1, layers).start(seed))


def train_recurrent(sequences: DataFrame, seq_col: str = "seq", label: str = "y", layers: Sequence[int] = LAYERS, steps: int = 200, rate: float = 0.01,
                    batch_share: float = 1.0, seed: int = 42, seq_len: int = SEQUENCE_LENGTH, split_col: str | None = None, train_value: str = "train",
                    key: Sequence[str] = KEY) -> RecurrentModel:
    """M5: Adam on the mean squared error, ``steps`` steps. Windows with a NULL in them, or without a target, do not train."""
    train = sequences if split_col is None else sequences.where(F.col(split_col) == train_value)
    whole = F.col(label).isNotNull() & (F.size(seq_col) == seq_len) & ~F.exists(seq_col, lambda v: v.isNull())
    keys = [c for c in key if c in train.columns]
    train = train.where(whole).select(F.col(seq_col).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), *keys)
    if batch_share >= 1:
        train = spread(pack(train.select("x", "y"), seq_len))
    train = train.persist()

    def targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, y in packed_rows(b, seq_len):
                yield pa.RecordBatch.from_arrays([pa.array(y)], names=["y"])

    def sums(k: int, m: RecurrentModel) -> tuple:
        if batch_share >= 1:
            return gradient_sums(train, layers, m.weights, m.mean, m.scale, seq_len, packed_rows)
        part = train.where(F.pmod(F.xxhash64(*keys, F.lit(seed + k)), F.lit(1 << 20)) < int(batch_share * (1 << 20)))
        return gradient_sums(part.select("x", "y"), layers, m.weights, m.mean, m.scale, seq_len)

    try:
        return _descend(_start(train.mapInArrow(targets, "y double") if batch_share >= 1 else train, layers, seq_len, seed), steps, rate, sums)
    finally:
        train.unpersist()


def train_recurrent_blocks(blocks: DataFrame, layers: Sequence[int] = LAYERS, steps: int = 200, rate: float = 0.01, batch_share: float = 1.0,
                           seed: int = 42, seq_len: int = SEQUENCE_LENGTH, keys: Sequence[str] = ("series_id",)) -> RecurrentModel:
    """M5 over ``sequence_blocks``: the training windows (the first ``n_train`` of each block) are views inside the tasks, so
    cache and Arrow batches hold each value once, not ``seq_len`` times. The same steps as ``train_recurrent``; a NaN trains
    neither as input nor as target."""
    train = spread(blocks.where("n_train > 0").select("values", "n_train", F.xxhash64(*keys, "block").alias("key")), "key").persist()

    def targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, y in block_rows(b, seq_len):
                yield pa.RecordBatch.from_arrays([pa.array(y)], names=["y"])

    def sums(k: int, m: RecurrentModel) -> tuple:
        return gradient_sums(train, layers, m.weights, m.mean, m.scale, seq_len, block_rows, share=batch_share, seed=seed + k)

    try:
        return _descend(_start(train.mapInArrow(targets, "y double"), layers, seq_len, seed), steps, rate, sums)
    finally:
        train.unpersist()
