"""A feed-forward and a recurrent scorer in numpy, applied in Arrow batches.

``train`` is for arrays on one machine; ``averaging`` trains on all rows of a table. Rows to train on are all positives and a multiple of them in negatives, drawn anew each epoch. The weights of the epoch with
the best average precision on validation rows are kept, and training stops after ``patience`` epochs without a better one.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystream.sources.artifacts import opened, sealed

Weights = dict[str, np.ndarray]
BETTER = 1e-7
#: Rows that are scored at once, so few that what is between stays in a core's cache.
BLOCK = 1024


@dataclass(frozen=True)
class TrainConfig:
    hidden: tuple[int, ...] = (64, 32)
    dropout: float = 0.1
    rate: float = 1e-3
    decay: float = 1e-4
    epochs: int = 20
    patience: int = 4
    batch: int = 256
    negatives: float = 3.0
    clip: float = 5.0
    seed: int = 42


def average_precision(y: np.ndarray, p: np.ndarray) -> float:
    order = np.argsort(-p, kind="stable")
    y, p = y[order], p[order]
    ends = np.flatnonzero(np.append(np.diff(p) != 0, True))
    tp = np.cumsum(y)[ends]
    return float((np.diff(np.append(0, tp)) / max(1, y.sum()) * tp / (ends + 1)).sum())


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


#: Grid of the error function: steps to 1, and how far it goes (beyond, the function is 1 in double precision).
_STEPS, _FAR = 128, 6


def _erf_table() -> np.ndarray:
    """The value and, by powers of the distance, the Taylor terms at each point of the grid."""
    x = np.arange(-_FAR * _STEPS, _FAR * _STEPS + 1) / _STEPS
    slope = 2 / math.sqrt(math.pi) * np.exp(-x * x)
    terms = [np.ones_like(x), -x, (4 * x**2 - 2) / 6, (12 * x - 8 * x**3) / 24, (16 * x**4 - 48 * x**2 + 12) / 120]
    return np.stack([[math.erf(v) for v in x], *[slope * t for t in terms]])


_ERF = _erf_table()


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function of all elements at once, to 1e-15: Taylor's series at the nearest point of a grid."""
    held = np.clip(x, -_FAR, _FAR)
    near = np.rint(held * _STEPS)
    with np.errstate(invalid="ignore"):  # what is no number stays none, by its distance
        d, at = held - near / _STEPS, near.astype(np.intp) + _FAR * _STEPS
    value, *terms = (np.take(row, at, mode="clip") for row in _ERF)
    out = terms[-1]
    for term in terms[-2::-1]:
        out *= d
        out += term
    out *= d
    return np.add(value, out, out=value)


def _gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and slope, by the normal distribution function itself."""
    below = _erf(x / math.sqrt(2))
    below += 1
    below *= 0.5
    slope = -0.5 * x
    slope *= x
    np.exp(slope, out=slope)
    slope *= x
    slope /= math.sqrt(2 * math.pi)
    slope += below
    return x * below, slope


def _row_means(x: np.ndarray) -> np.ndarray:
    return np.add.reduce(x, axis=1, keepdims=True) / x.shape[1]


class FeedForward:
    """Blocks of linear, GELU, layer norm and dropout, and a logit."""

    def __init__(self, inputs: int, config: TrainConfig):
        self.config, draw = config, np.random.default_rng(config.seed)
        self.w: Weights = {}
        sizes = [inputs, *config.hidden]
        for i, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
            self.w |= {f"w{i}": draw.normal(0, math.sqrt(2 / a), (a, b)), f"b{i}": np.zeros(b), f"g{i}": np.ones(b), f"s{i}": np.zeros(b)}
        self.w |= {"out": draw.normal(0, math.sqrt(1 / sizes[-1]), sizes[-1]), "bias": np.zeros(1)}

    def forward(self, x: np.ndarray, draw: np.random.Generator | None = None) -> tuple[np.ndarray, list]:
        """Logits, and what the backward pass needs; dropout only with ``draw``."""
        tape = []
        for i in range(len(self.config.hidden)):
            z = x @ self.w[f"w{i}"] + self.w[f"b{i}"]
            a, slope = _gelu(z)
            centred = a - _row_means(a)
            spread = np.sqrt(_row_means(centred * centred) + 1e-5)
            unit = centred / spread
            keep = (draw.random(unit.shape) >= self.config.dropout) / (1 - self.config.dropout) if draw is not None else 1.0
            tape.append((x, slope, unit, spread, keep))
            x = (unit * self.w[f"g{i}"] + self.w[f"s{i}"]) * keep
        tape.append(x)
        return x @ self.w["out"] + self.w["bias"][0], tape

    def backward(self, tape: list, g: np.ndarray) -> Weights:
        out = {"out": tape[-1].T @ g, "bias": np.array([g.sum()])}
        g = np.outer(g, self.w["out"])
        for i in reversed(range(len(self.config.hidden))):
            x, slope, unit, spread, keep = tape[i]
            g = g * keep
            out |= {f"g{i}": (g * unit).sum(axis=0), f"s{i}": g.sum(axis=0)}
            u = g * self.w[f"g{i}"]
            g = (u - _row_means(u) - unit * _row_means(u * unit)) / spread * slope
            out |= {f"w{i}": x.T @ g, f"b{i}": g.sum(axis=0)}
            g = g @ self.w[f"w{i}"].T
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        parts = [self.forward(x[i : i + BLOCK])[0] for i in range(0, max(1, len(x)), BLOCK)]
        return sigmoid(np.concatenate(parts))


class Recurrent:
    """A linear projection, one LSTM layer per size after the first, and a logit of the last valid step.

    Inputs are (rows, steps, features) with zero padding on the right, and lengths.
    """

    def __init__(self, inputs: int, config: TrainConfig):
        self.config, draw = config, np.random.default_rng(config.seed)
        sizes = config.hidden if len(config.hidden) > 1 else (config.hidden[0], config.hidden[0])
        self.layers = len(sizes) - 1
        self.w = {"project": draw.normal(0, math.sqrt(1 / inputs), (inputs, sizes[0])), "project_b": np.zeros(sizes[0])}
        for i, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
            bias = np.zeros(4 * b)
            bias[b : 2 * b] = 1.0  # remember at first
            self.w |= {f"x{i}": draw.normal(0, math.sqrt(1 / a), (a, 4 * b)), f"h{i}": draw.normal(0, math.sqrt(1 / b), (b, 4 * b)), f"b{i}": bias}
        self.w |= {"out": draw.normal(0, math.sqrt(1 / sizes[-1]), sizes[-1]), "bias": np.zeros(1)}

    def forward(self, data: tuple[np.ndarray, np.ndarray], draw: np.random.Generator | None = None) -> tuple[np.ndarray, list]:
        x, lengths = data
        if x.ndim != 3 or (lengths < 1).any() or (lengths > x.shape[1]).any():
            raise ValueError("lengths must lie between 1 and the number of steps")
        seq, tape = x @ self.w["project"] + self.w["project_b"], [x]
        for layer in range(self.layers):
            h = c = np.zeros((len(x), self.w[f"h{layer}"].shape[0]))
            n, hs, steps = h.shape[1], [], []
            for t in range(x.shape[1]):
                z = seq[:, t] @ self.w[f"x{layer}"] + h @ self.w[f"h{layer}"] + self.w[f"b{layer}"]
                i, f, o, g = sigmoid(z[:, :n]), sigmoid(z[:, n : 2 * n]), sigmoid(z[:, 2 * n : 3 * n]), np.tanh(z[:, 3 * n :])
                c2 = f * c + i * g
                h2 = o * np.tanh(c2)
                steps.append((h, c, i, f, o, g, c2))
                h, c = h2, c2
                hs.append(h)
            tape.append((seq, steps))
            seq = np.stack(hs, axis=1)
        last = seq[np.arange(len(x)), lengths - 1]
        keep = (draw.random(last.shape) >= self.config.dropout) / (1 - self.config.dropout) if draw is not None else 1.0
        tape.append((seq.shape, lengths, last * keep, keep))
        return (last * keep) @ self.w["out"] + self.w["bias"][0], tape

    def backward(self, tape: list, g: np.ndarray) -> Weights:
        shape, lengths, last, keep = tape[-1]
        out = {"out": last.T @ g, "bias": np.array([g.sum()])}
        d_seq = np.zeros(shape)
        d_seq[np.arange(len(g)), lengths - 1] = np.outer(g, self.w["out"]) * keep
        for layer in reversed(range(self.layers)):
            seq, steps = tape[1 + layer]
            wx, wh = self.w[f"x{layer}"], self.w[f"h{layer}"]
            gx, gh, gb = np.zeros_like(wx), np.zeros_like(wh), np.zeros(wx.shape[1])
            below, dh, dc = np.zeros_like(seq), 0.0, 0.0
            for t in reversed(range(len(steps))):
                h, c, i, f, o, k, c2 = steps[t]
                dh = dh + d_seq[:, t]
                tanh = np.tanh(c2)
                dc = dc + dh * o * (1 - tanh**2)
                z = np.concatenate([dc * k * i * (1 - i), dc * c * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - k**2)], axis=1)
                gx += seq[:, t].T @ z
                gh += h.T @ z
                gb += z.sum(axis=0)
                below[:, t], dh, dc = z @ wx.T, z @ wh.T, dc * f
            out |= {f"x{layer}": gx, f"h{layer}": gh, f"b{layer}": gb}
            d_seq = below
        x = tape[0]
        return out | {"project": np.einsum("nti,ntj->ij", x, d_seq), "project_b": d_seq.sum(axis=(0, 1))}

    def predict(self, data: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return sigmoid(self.forward(data)[0])


def sampled_rows(y: np.ndarray, per_positive: float, draw: np.random.Generator) -> np.ndarray:
    """All positives and a multiple of them in negatives, shuffled."""
    good, bad = np.flatnonzero(y == 0), np.flatnonzero(y == 1)
    return draw.permutation(np.concatenate([bad, draw.choice(good, min(len(good), int(per_positive * len(bad))), replace=False)]))


def _take(data, rows: np.ndarray):
    return tuple(d[rows] for d in data) if isinstance(data, tuple) else data[rows]


@dataclass
class Fitted:
    model: FeedForward | Recurrent
    best: float
    epochs: int
    history: list[float] = field(default_factory=list)


def train(make: Callable[[], FeedForward | Recurrent], data, y: np.ndarray, valid, y_valid: np.ndarray, config: TrainConfig) -> Fitted:
    """Weighted log loss with AdamW and clipped gradients."""
    if not y.any() or y.all():
        raise ValueError("both classes must occur")
    model, draw = make(), np.random.default_rng(config.seed)
    m, v = ({k: np.zeros_like(w) for k, w in model.w.items()} for _ in range(2))
    best, kept, since, step, history = -np.inf, dict(model.w), 0, 0, []
    for _ in range(config.epochs):
        rows = sampled_rows(y, config.negatives, draw)
        positive = (y[rows] == 0).sum() / max(1, (y[rows] == 1).sum())
        for start in range(0, len(rows), config.batch):
            part = rows[start : start + config.batch]
            z, tape = model.forward(_take(data, part), draw)
            weight = np.where(y[part] == 1, positive, 1.0)
            grads = model.backward(tape, weight * (sigmoid(z) - y[part]) / len(part))
            norm = math.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            scale, step = min(1.0, config.clip / (norm + 1e-12)), step + 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * scale * g
                v[k] = 0.999 * v[k] + 0.001 * (scale * g) ** 2
                move = m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                model.w[k] = model.w[k] - config.rate * (move + config.decay * model.w[k])
        score = average_precision(y_valid, model.predict(valid))
        history.append(score)
        if score > best + BETTER:
            best, kept, since = score, {k: w.copy() for k, w in model.w.items()}, 0
        else:
            since += 1
            if since >= config.patience:
                break
    model.w = kept
    return Fitted(model, best, len(history), history)


def to_dict(model: FeedForward | Recurrent, inputs: list[str]) -> dict:
    """The sealed document of a network: its kind, configuration, input columns and weights."""
    kind = "feed_forward" if isinstance(model, FeedForward) else "recurrent"
    config = {k: list(v) if isinstance(v, tuple) else v for k, v in vars(model.config).items()}
    return sealed({"type": "network", "version": 1, "network": kind, "config": config, "inputs": list(inputs), "weights": {k: w.tolist() for k, w in model.w.items()}})


def from_dict(document: dict, inputs: list[str] | None = None) -> FeedForward | Recurrent:
    """The network of a document, after its digest was verified; with ``inputs`` it must be made for these columns."""
    d = opened(document, kind="network", version=1)
    if inputs is not None and list(inputs) != d["inputs"]:
        raise ValueError("the network was made for other inputs")
    config = TrainConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in d["config"].items()})
    model = (FeedForward if d["network"] == "feed_forward" else Recurrent)(len(d["inputs"]), config)
    weights = {k: np.array(w, dtype=float) for k, w in d["weights"].items()}
    if {k: w.shape for k, w in weights.items()} != {k: w.shape for k, w in model.w.items()}:
        raise ValueError("the weights do not have the network's shapes")
    model.w = weights
    return model


#: Finite grids to draw networks from.
SPACES: dict[str, dict[str, list]] = {
    "feed_forward": {"hidden": [(64, 32), (128, 64), (32,)], "dropout": [0.0, 0.1, 0.2], "rate": [1e-3, 3e-4], "decay": [1e-4, 1e-3]},
    "recurrent": {"hidden": [(32, 32), (64, 64), (64, 64, 64)], "dropout": [0.0, 0.1], "rate": [1e-3, 3e-4], "decay": [1e-4, 1e-3]},
}


def drawn(kind: str, tries: int, seed: int) -> list[dict]:
    """Distinct points of the grid, in a seeded order."""
    space = SPACES[kind]
    grid = [dict(zip(space, values, strict=True)) for values in product(*space.values())]
    return random.Random(seed).sample(grid, min(tries, len(grid)))


def search(kind: str, inputs: list[str], data, y: np.ndarray, valid, y_valid: np.ndarray, *, tries: int = 4, epochs: int = 20, seed: int = 42) -> tuple[Fitted, dict]:
    """Train each drawn configuration and keep the one of the best average precision on validation rows (the first wins ties).

    Returns it with the sealed report of all that were tried and the digest of its document.
    """
    make = FeedForward if kind == "feed_forward" else Recurrent
    best, rows = None, []
    for i, params in enumerate(drawn(kind, tries, seed)):
        config = TrainConfig(**params, epochs=epochs, seed=seed)
        fitted = train(lambda config=config: make(len(inputs), config), data, y, valid, y_valid, config)
        rows.append({"candidate": i, "parameters": {k: list(v) if isinstance(v, tuple) else v for k, v in params.items()}, "average_precision": fitted.best, "epochs": fitted.epochs})
        if best is None or fitted.best > best.best:
            best, chosen = fitted, i
    report = sealed({"type": "network_report", "version": 1, "network": kind, "chosen": chosen, "tried": rows, "network_sha256": to_dict(best.model, inputs)["sha256"]})
    return best, report


def tensor(histories: list, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of item vectors to (rows, length, features), zero-padded on the right, and lengths."""
    lengths = np.array([len(h) for h in histories])
    out = np.zeros((len(histories), length, len(histories[0][0])))
    for i, h in enumerate(histories):
        out[i, : len(h)] = h
    return out, lengths


def score_rows(df: DataFrame, model: FeedForward, features: list[str], name: str = "probability") -> DataFrame:
    """Add the score of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{name: model.predict(batch[features].to_numpy(dtype=float)) if len(batch) else []})

    return df.mapInPandas(run, _with(df, name))


def score_histories(df: DataFrame, model: Recurrent, history: str, length: int, name: str = "probability") -> DataFrame:
    """Add the score of each row's history (an array of arrays)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{name: model.predict(tensor([np.stack(h) for h in batch[history]], length)) if len(batch) else []})

    return df.mapInPandas(run, _with(df, name))


def _with(df: DataFrame, name: str):
    return df.withColumn(name, F.lit(0.0)).schema
