"""Networks trained on all rows of a table, by tasks that average their gradients at every step.

An epoch is one job: all positives and a share of the negatives, drawn anew by a hash of key and epoch, are dealt to tasks by that
hash and put in its order, which shuffles them. All slots put them in order, by ranges of the hash, and pack them as chunks of numbers
ready to train on; only chunks reach the tasks. The tasks run at once (a barrier stage). Each streams its own rows in batches; at a
step every task sends the first one the sum of its gradients and how many rows it is of, all make the same move by their mean, and
the epoch ends when no task has rows left. So a step of w tasks equals one machine's step on their w batches together. Spark's own
exchange between barrier tasks takes a second each time; it only tells where the first task listens. A lost executor or connection
fails the stage, which Spark repeats. The driver holds the weights; rows never reach it. The average precision of validation rows
is exact.
"""

from __future__ import annotations

import json
import math
import secrets
import socket
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystream.operators import metrics, neural
from tallystream.operators.neural import FeedForward, Fitted, Recurrent, TrainConfig, Weights
from tallystream.sources.artifacts import sealed
from tallystream.sources.shared import drop_table, written

#: Tasks of an epoch unless the session has fewer slots.
TASKS = 4
#: Seconds that a task waits for another one.
WAIT = 600.0
#: Rows of a chunk at most; rows that are put in order together, about.
CHUNK, RANGE = 1024, 250_000

Data = np.ndarray | tuple[np.ndarray, np.ndarray]


def gradients(model: FeedForward | Recurrent, data: Data, y: np.ndarray, positive: float, draw: np.random.Generator | None) -> Weights:
    """The sum over rows of the gradients of the weighted log loss."""
    z, tape = model.forward(data, draw)
    return model.backward(tape, np.where(y == 1, positive, 1.0) * (neural.sigmoid(z) - y))


class Moves:
    """AdamW with clipped gradients; the same gradients make the same moves everywhere."""

    def __init__(self, weights: Weights, config: TrainConfig, saved: dict | None = None):
        self.config, self.step = config, 0
        self.m, self.v = ({k: np.zeros_like(w) for k, w in weights.items()} for _ in range(2))
        if saved:
            self.step, self.m, self.v = saved["step"], saved["m"], saved["v"]

    def saved(self) -> dict:
        return {"step": self.step, "m": self.m, "v": self.v}

    def apply(self, weights: Weights, mean: Weights) -> None:
        scale = min(1.0, self.config.clip / (math.sqrt(sum(float((g**2).sum()) for g in mean.values())) + 1e-12))
        self.step += 1
        for k, g in mean.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * scale * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * (scale * g) ** 2
            move = self.m[k] / (1 - 0.9**self.step) / (np.sqrt(self.v[k] / (1 - 0.999**self.step)) + 1e-8)
            weights[k] = weights[k] - self.config.rate * (move + self.config.decay * weights[k])


@lru_cache
def _head(kinds: tuple) -> bytes:
    head = json.dumps(kinds).encode()
    return len(head).to_bytes(8, "big") + head


@lru_cache
def _kinds(head: bytes) -> list:
    return [(name, tuple(shape), math.prod(shape)) for name, shape in json.loads(head)]


def _packed(arrays: Weights) -> bytes:
    """Names and shapes, and the numbers as they are: what a step sends must cost less than the step."""
    return _head(tuple((k, np.shape(v)) for k, v in arrays.items())) + b"".join(np.asarray(v, dtype=float).tobytes() for v in arrays.values())


def _unpacked(data: bytes) -> Weights:
    at = 8 + int.from_bytes(data[:8], "big")
    numbers, out, start = np.frombuffer(data[at:], dtype=float), {}, 0
    for name, shape, size in _kinds(data[8:at]):
        out[name] = numbers[start : start + size].reshape(shape)
        start += size
    return out


class Exchange:
    """Connections of all tasks of a barrier stage to the first one."""

    def __init__(self, context: BarrierTaskContext):
        self.rank, tasks = context.partitionId(), context.getTaskInfos()
        self.peers: list[socket.socket] = []
        server = socket.create_server(("", 0)) if self.rank == 0 else None
        note = f"{tasks[0].address.rsplit(':', 1)[0]}|{server.getsockname()[1]}|{secrets.token_hex(16)}" if server else ""
        host, port, token = context.allGather(note)[0].split("|")
        if server is None:
            self.first = socket.create_connection((host, int(port)), timeout=WAIT)
            self.first.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
            self._send(self.first, token.encode() + self.rank.to_bytes(4, "big"))
            return
        server.settimeout(WAIT)
        known: dict[int, socket.socket] = {}
        while len(known) < len(tasks) - 1:
            peer, _ = server.accept()
            peer.settimeout(WAIT)
            peer.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
            hello = self._receive(peer, 4096)
            if secrets.compare_digest(hello[:-4], token.encode()):
                known[int.from_bytes(hello[-4:], "big")] = peer
            else:
                peer.close()
        server.close()
        self.peers = [known[r] for r in sorted(known)]

    @staticmethod
    def _send(to: socket.socket, data: bytes) -> None:
        to.sendall(len(data).to_bytes(8, "big") + data)

    @staticmethod
    def _receive(of: socket.socket, most: int | None = None) -> bytes:
        def read(n: int) -> bytes:
            parts = []
            while n:
                part = of.recv(min(n, 1 << 20))
                if not part:
                    raise ConnectionError("another task has ended")
                parts.append(part)
                n -= len(part)
            return b"".join(parts)

        size = int.from_bytes(read(8), "big")
        if most is not None and size > most:
            raise ConnectionError("not a task's greeting")
        return read(size)

    def mean(self, message: bytes) -> Weights | None:
        """``averaged`` of the messages of all tasks."""
        if self.rank:
            self._send(self.first, message)
            data = self._receive(self.first)
            return _unpacked(data) if data else None
        found = averaged([message, *[self._receive(p) for p in self.peers]])
        data = _packed(found) if found is not None else b""
        for peer in self.peers:
            self._send(peer, data)
        return found

    def close(self) -> None:
        for s in self.peers if self.rank == 0 else [self.first]:
            s.close()


def averaged(messages: list[bytes]) -> Weights | None:
    """The mean gradients of all tasks' rows, added in the order of tasks; None where no task has rows left."""
    found = [_unpacked(m) for m in messages if m]
    if not found:
        return None
    rows = sum(float(f.pop("rows")) for f in found)
    return {k: sum(f[k] for f in found) / rows for k in found[0]}


def _flat(weights: Weights) -> np.ndarray:
    """All numbers in one array: what is done to every weight at a step is then done once."""
    return np.concatenate([np.ravel(w) for w in weights.values()])


def _shaped(flat: np.ndarray, like: Weights) -> Weights:
    out, start = {}, 0
    for k, w in like.items():
        out[k] = flat[start : start + w.size].reshape(w.shape)
        start += w.size
    return out


def _chunks(arrays: Callable[[pd.DataFrame], Data]):
    """For mapInArrow over one task's rows in their order: (order of the first row, chunk of rows)."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows, starts, chunks = batch.to_pandas(), range(0, batch.num_rows, CHUNK), []
            for a in starts:
                part = rows.iloc[a : a + CHUNK]
                data = arrays(part)
                chunks.append(_packed({"y": part["y"].to_numpy()} | {f"x{i}": v for i, v in enumerate(data if isinstance(data, tuple) else (data,))}))
            yield pa.RecordBatch.from_arrays([batch["order"].take(pa.array(starts, pa.int64())), pa.array(chunks, pa.binary())], ["order", "chunk"])

    return run


def _batches(stream: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, Data]]:
    """The labels and data of a task's rows in batches of ``size``."""
    data = lambda parts: parts[1] if len(parts) == 2 else (parts[1], parts[2].astype(int))
    held = None
    for batch in stream:
        for chunk in batch["chunk"]:
            part = list(_unpacked(chunk.as_py()).values())
            held = part if held is None else [np.concatenate(v) for v in zip(held, part, strict=True)]
            whole = len(held[0]) - len(held[0]) % size
            for start in range(0, whole, size):
                now = [v[start : start + size] for v in held]
                yield now[0], data(now)
            held = [v[whole:] for v in held]
    if held is not None and len(held[0]):
        yield held[0], data(held)


def _epoch(model: FeedForward | Recurrent, saved: dict | None, config: TrainConfig, positive: float, epoch: int):
    """For mapInArrow in barrier mode: one epoch; the first task gives the weights and moments as one array each."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        draw = np.random.default_rng([config.seed, epoch, context.partitionId()]) if config.dropout else None
        weights, shapes = {"all": _flat(model.w)}, model.w
        moves, rows, exchange = Moves(weights, config, saved), _batches(stream, config.batch), Exchange(context)
        while True:
            part, message = next(rows, None), b""
            if part is not None:
                y, data = part
                model.w = _shaped(weights["all"], shapes)
                found = gradients(model, data, y, positive, draw)
                message = _packed({"all": _flat({k: found[k] for k in shapes}), "rows": np.array(len(y))})
            mean = exchange.mean(message)
            if mean is None:
                break
            moves.apply(weights, mean)
        exchange.close()
        if context.partitionId() == 0:
            state = {"w": weights["all"], "m": moves.m["all"], "v": moves.v["all"]}
            yield pa.RecordBatch.from_arrays([pa.array([moves.step], pa.int64()), pa.array([_packed(state)], pa.binary())], ["step", "state"])

    return run


def _dealt(rows: DataFrame, names: list[str], n: float, tasks: int, arrays: Callable[[pd.DataFrame], Data]) -> DataFrame:
    """The chunks of an epoch's about ``n`` rows (y, order and ``names``), in the partition of their task and the order of their
    rows. Rows of one order have one key; they go by their labels and columns."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / (tasks * RANGE))))
    task = F.pmod(F.hash("order"), F.lit(tasks))  # the partition of repartition(tasks, "order")
    place = F.shiftleft(task, bits) + (F.shiftright("order", 64 - bits) + (1 << bits >> 1)).cast("int") if bits else task
    ranges = rows.select("y", "order", *names).repartitionById(tasks << bits, place).sortWithinPartitions("order", "y", *names)
    return ranges.mapInArrow(_chunks(arrays), "order long, chunk binary").repartition(tasks, "order").sortWithinPartitions("order", "chunk").select("chunk")


def epoch_rows(train: DataFrame, negatives: float, counts: tuple[int, int], seed: int, epoch: int) -> tuple[DataFrame, float]:
    """The rows of an epoch (all positives, and negatives by a hash of key and epoch) with their order, and the weight of a
    positive that balances the classes. ``counts`` is (negatives, positives)."""
    share = min(1.0, negatives * counts[1] / counts[0])
    order = F.xxhash64(F.lit(seed), F.lit(epoch), F.col("key"))
    drawn = F.pmod(F.xxhash64(F.lit("draw"), order), F.lit(1 << 30)) < round(share * (1 << 30))
    return train.withColumn("order", order).filter((F.col("y") == 1) | drawn), share * counts[0] / counts[1]


def train_on_all(
    make: Callable[[], FeedForward | Recurrent], train: DataFrame, validation: DataFrame, config: TrainConfig, *, inputs: list[str], length: int | None = None, label: str = "label", key: str = "key", tasks: int | None = None
) -> Fitted:
    """Train on every row of ``train`` and keep the weights of the epoch with the best average precision on ``validation``.

    ``inputs`` are number columns of a feed-forward network, or, with ``length``, the one column of a recurrent one's histories
    (arrays of arrays). Labels are 0 or 1 and both occur in both tables. The session needs as many free slots as ``tasks``.
    """
    spark = train.sparkSession
    tasks = tasks or max(1, min(TASKS, spark.sparkContext.defaultParallelism))
    columns = [F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(inputs)]
    names = [f"x{i}" for i in range(len(inputs))]
    arrays = (lambda part: neural.tensor([np.stack(h) for h in part["x0"]], length)) if length else (lambda part: part[names].to_numpy(dtype=float))
    known = []
    for rows in (train, validation):
        rows = written(rows.select(F.col(label).cast("int").alias("y"), F.col(key).cast("string").alias("key"), *columns), "training")
        counts = tuple(rows.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first())
        if not all(counts):
            raise ValueError("both classes must occur")
        known.append((rows, counts))
    (train, counts), (validation, _) = known
    model = make()
    saved, history = None, []
    best, kept, since = -np.inf, dict(model.w), 0
    for epoch in range(config.epochs):
        rows, positive = epoch_rows(train, config.negatives, counts, config.seed, epoch)
        dealt = _dealt(rows, names, counts[1] * (1 + positive), tasks, arrays)
        found = dealt.mapInArrow(_epoch(model, saved, config, positive, epoch), "step long, state binary", barrier=True).collect()  # the first task's row
        if len(found) != 1:
            raise RuntimeError("an epoch gives one state")
        state = _unpacked(bytes(found[0]["state"]))
        model.w, saved = _shaped(state["w"], model.w), {"step": found[0]["step"], "m": {"all": state["m"]}, "v": {"all": state["v"]}}
        scored = written(_scored(validation, model, arrays), "scores")
        history.append(metrics.average_precision(scored, "y", "p").first()[0])
        drop_table(scored)
        if history[-1] > best + neural.BETTER:
            best, kept, since = history[-1], dict(model.w), 0
        else:
            since += 1
            if since >= config.patience:
                break
    model.w = kept
    for rows in (train, validation):
        drop_table(rows)
    return Fitted(model, best, len(history), history)


def _scored(rows: DataFrame, model: FeedForward | Recurrent, arrays: Callable[[pd.DataFrame], Data]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"y": part["y"], "p": model.predict(arrays(part)) if len(part) else []})

    return rows.drop("key").mapInPandas(run, "y int, p double")


def search(kind: str, train: DataFrame, validation: DataFrame, *, inputs: list[str], features: list[str] | None = None, length: int | None = None, label: str = "label", key: str = "key", tries: int = 4, epochs: int = 20, seed: int = 42, tasks: int | None = None) -> tuple[Fitted, dict]:
    """Train each drawn configuration on all rows and keep the one of the best average precision (the first wins ties).

    ``features`` names the items of a history's vectors, where ``inputs`` is the column of histories. Returns the network with the
    sealed report of all that were tried and the digest of its document.
    """
    make, names = (FeedForward if kind == "feed_forward" else Recurrent), list(features or inputs)
    best, rows, chosen = None, [], 0
    for i, params in enumerate(neural.drawn(kind, tries, seed)):
        config = TrainConfig(**params, epochs=epochs, seed=seed)
        fitted = train_on_all(lambda config=config: make(len(names), config), train, validation, config, inputs=inputs, length=length, label=label, key=key, tasks=tasks)
        rows.append({"candidate": i, "parameters": {k: list(v) if isinstance(v, tuple) else v for k, v in params.items()}, "average_precision": fitted.best, "epochs": fitted.epochs})
        if best is None or fitted.best > best.best:
            best, chosen = fitted, i
    return best, sealed({"type": "network_report", "version": 1, "network": kind, "chosen": chosen, "tried": rows, "network_sha256": neural.to_dict(best.model, names)["sha256"]})
