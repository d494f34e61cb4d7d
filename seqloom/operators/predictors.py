"""Learned next-bit predictors: small networks for each sequence and check, trained side by side with NumPy in the tasks that Spark deals the sequences to."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Network:
    """Hidden layers of rectified units, Adam, mini-batches, early stop on the training loss."""

    def __init__(self, hidden: int | tuple[int, ...], classify: bool, seed: int, rate: float = 1e-3, decay: float = 1e-4, epochs: int = 200, batch: int = 200):
        self.hidden = (hidden,) if isinstance(hidden, int) else hidden
        self.classify, self.rng, self.rate, self.decay, self.epochs, self.batch = classify, np.random.default_rng(seed), rate, decay, epochs, batch

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        y = y.reshape(len(x), -1).astype(float)
        sizes = [x.shape[1], *self.hidden, y.shape[1]]
        last = len(sizes) - 2
        self.weights = []
        for i in range(last + 1):
            bound = np.sqrt((2.0 if i == last and self.classify else 6.0) / (sizes[i] + sizes[i + 1]))
            self.weights += [self.rng.uniform(-bound, bound, (sizes[i], sizes[i + 1])), self.rng.uniform(-bound, bound, sizes[i + 1])]
        m, v = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        size, step, best, stale = min(self.batch, len(x)), 0, np.inf, 0
        for _ in range(self.epochs):
            order, loss = self.rng.permutation(len(x)), 0.0
            for at in range(0, len(x), size):
                rows = order[at : at + size]
                layers, out = self._forward(x[rows])
                error = out - y[rows]
                if self.classify:
                    p = np.clip(out, 1e-12, 1 - 1e-12)
                    loss -= (y[rows] * np.log(p) + (1 - y[rows]) * np.log(1 - p)).sum()
                else:
                    loss += (error**2).sum() / 2
                n, grads = len(rows), []
                for i in range(last, -1, -1):
                    grads = [(layers[i].T @ error + self.decay * self.weights[2 * i]) / n, error.mean(axis=0), *grads]
                    if i:
                        error = (error @ self.weights[2 * i].T) * (layers[i] > 0)
                step += 1
                rate = self.rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in enumerate(grads):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.weights[k] -= rate * m[k] / (np.sqrt(v[k]) + 1e-8)
            loss /= len(x)
            stale = stale + 1 if loss > best - 1e-4 else 0
            best = min(best, loss)
            if stale >= 10:
                break
        return self

    def _forward(self, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        layers = [x]
        for i in range(0, len(self.weights) - 2, 2):
            layers.append(np.maximum(layers[-1] @ self.weights[i] + self.weights[i + 1], 0))
        out = layers[-1] @ self.weights[-2] + self.weights[-1]
        return layers, 1 / (1 + np.exp(-np.clip(out, -500, 500))) if self.classify else out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[1]


def fit_all(data: list[tuple[np.ndarray, np.ndarray]], hidden: int | tuple[int, ...], classify: bool, seed: int, dtype: type = np.float64, **options) -> list[Network]:
    """Network(hidden, classify, seed, **options).fit(x, y) of every (x, y), trained side by side: each step is one operation
    for many networks. All x are equally wide, all y too. Each network goes through its own batches; one that has stopped makes
    room for the next one. dtype: what is calculated in."""
    nets = [Network(hidden, classify, seed, **options) for _ in data]
    if not data:
        return nets
    first = nets[0]
    wide, most = data[0][0].shape[1], max(len(x) for x, _ in data)
    told = data[0][1].reshape(len(data[0][0]), -1).shape[1]
    sizes = [wide, *first.hidden, told]
    last, batch = len(sizes) - 2, min(first.batch, most)
    # a layer's weights are (units, inputs + 1), the last column its offsets: a unit's values for all rows of a batch lie side by side
    shapes = [(sizes[i + 1], sizes[i] + 1) for i in range(last + 1)]
    ends = np.cumsum([0, *(a * b for a, b in shapes)])
    # bits stay bytes until a batch takes them
    kept = np.dtype(np.int8 if all(part.dtype == np.int8 for pair in data for part in pair) else dtype)
    # so many that a step's layers stay in the cache and the rows in bounded memory
    slots = int(max(1, min(len(data), 64, (1 << 17) // (batch * max(sizes)) + 4, (1 << 26) // (most * (wide + 1 + told) * kept.itemsize) + 1)))
    given = np.ones((slots, most, wide + 1 + told), kept)  # rows of x, a one for the offsets, y
    w, grad, m, v, spare = (np.zeros((slots, ends[-1]), dtype) for _ in range(5))
    decay = np.concatenate([np.where(np.arange(a * b) % b < b - 1, first.decay, 0.0) for a, b in shapes]).astype(dtype)
    n, own, at, epoch, step, stale = (np.zeros(slots, np.int64) for _ in range(6))
    loss, best = np.zeros(slots), np.zeros(slots)
    done = np.arange(1.0, first.epochs * -(-most // batch) + 1)
    # m is ten times the mean slope, v a thousand times the mean square
    rates, least = (first.rate * np.sqrt(1 - 0.999**done) / (1 - 0.9**done) * 0.1 * 1000**0.5).astype(dtype), 1e-8 * 1000**0.5
    order = np.zeros((slots, most + batch), np.int64)  # a slot's rows in the order of its epoch, then some row of it
    starts = np.arange(slots) * (most + batch)
    batches = np.lib.stride_tricks.sliding_window_view(order.reshape(-1), batch)
    # memory that every step uses again: new pages for each of its arrays cost more than the arithmetic
    room_rows = {t: np.empty((slots, batch, given.shape[2]), t) for t in {kept, np.dtype(dtype)}}
    room_layers, room_errors = [np.ones((slots, s + 1, batch), dtype) for s in first.hidden], [np.empty((slots, s, batch), dtype) for s in sizes[1:]]
    room_above, room_zeros = [np.empty((slots, s, batch), bool) for s in first.hidden], [np.zeros((slots, s, batch), dtype) for s in first.hidden]
    odds, top = np.empty_like(room_errors[-1]), dtype(-np.log(1e-12))
    span, waiting = np.arange(batch), iter(sorted(range(len(data)), key=lambda i: -len(data[i][0])))
    # all draw from one seed, so that those of equally many rows go through them in the same orders: drawn once, kept while they train
    users, streams = Counter(len(x) for x, _ in data), {}
    drawn = {rows: [] for rows, times in users.items() if times > 1 and rows * first.epochs * slots < 1 << 26}

    def parts(flat: np.ndarray) -> list[np.ndarray]:
        return [flat[:, a:b].reshape(len(flat), *s) for a, b, s in zip(ends, ends[1:], shapes, strict=False)]

    def turn(k: int) -> None:
        known = drawn.get(n[k])
        if known is None:
            order[k, : n[k]] = nets[own[k]].rng.permutation(n[k])
        else:
            if epoch[k] == len(known):
                known.append(streams.setdefault(n[k], nets[own[k]].rng).permutation(n[k]).astype(np.uint16 if n[k] <= 1 << 16 else np.int32))
            order[k, : n[k]] = known[epoch[k]]
        order[k, : n[k]] += k * most
        order[k, n[k] :] = k * most
        at[k], loss[k] = 0, 0.0

    def load(k: int) -> bool:
        i = next(waiting, None)
        if i is None:
            return False
        x, y = data[i]
        own[k], n[k] = i, len(x)
        given[k, : n[k], :wide], given[k, : n[k], wide + 1 :] = x, np.where(y > 0, -1, 1).reshape(len(x), -1) if classify else y.reshape(len(x), -1)
        for j, part in enumerate(parts(w[k : k + 1])):
            bound = np.sqrt((2.0 if j == last and classify else 6.0) / (sizes[j] + sizes[j + 1]))
            part[0, :, :-1] = nets[i].rng.uniform(-bound, bound, (sizes[j], sizes[j + 1])).T
            part[0, :, -1] = nets[i].rng.uniform(-bound, bound, sizes[j + 1])
        m[k], v[k], epoch[k], step[k], stale[k], best[k] = 0, 0, 0, 0, 0, np.inf
        turn(k)
        return True

    live, seen = sum(load(k) for k in range(slots)), 0
    while live:
        if live != seen:
            seen = live
            flat, slope, ms, vs, free = w[:live], grad[:live], m[:live], v[:live], spare[:live]
            weights, slopes = parts(flat), parts(slope)
            taken, rows = room_rows[kept][:live], room_rows[np.dtype(dtype)][:live]
            xs, ys = rows[:, :, : wide + 1], rows[:, :, wide + 1 :].transpose(0, 2, 1)
            layers, errors = [a[:live] for a in room_layers], [a[:live] for a in room_errors]
            above, zeros = [a[:live] for a in room_above], [a[:live] for a in room_zeros]
            below = [xs.transpose(0, 2, 1), *layers]
        np.take(given.reshape(-1, given.shape[2]), batches[starts[:live] + at[:live]], axis=0, out=taken, mode="clip")
        if kept != dtype:
            np.copyto(rows, taken)
        for i in range(last):
            z = layers[i][:, :-1]
            np.matmul(weights[i], below[i], out=z)
            np.maximum(z, zeros[i], out=z)
        error = np.matmul(weights[-1], below[-1], out=errors[-1])
        if classify:  # ys is 1 for a 0, -1 for a 1
            error *= ys
            np.exp(np.minimum(error, top, out=error), out=error)
            lost = np.add(error, 1, out=odds[:live])
            error /= lost
            error *= ys
            lost = np.log(lost, out=lost)
        else:
            error -= ys
            lost = np.multiply(error, error, out=odds[:live])
        count = np.minimum(n[:live] - at[:live], batch)
        if count.min() < batch:
            here = (span < count[:, None])[:, None]
            lost *= here
            error *= here
        loss[:live] += lost.sum(axis=(1, 2))
        for i in range(last, -1, -1):
            np.matmul(error, below[i].transpose(0, 2, 1), out=slopes[i])
            if i == 0:
                break
            on, back = np.greater(below[i][:, :-1], 0, out=above[i - 1]), weights[i][:, :, :-1].transpose(0, 2, 1)
            if told > 1 or i < last:
                error = np.matmul(back, error, out=errors[i - 1])
                error *= on
            elif i > 1:
                error = np.multiply(on, error, out=errors[i - 1])
                error *= back
            else:  # one output: its weight of a unit is the same for all rows
                np.matmul(np.multiply(on, error, out=errors[0]), xs, out=slopes[0])
                slopes[0] *= back
                break
        slope += np.multiply(flat, decay, out=free)
        slope /= count[:, None].astype(dtype)
        ms *= 0.9
        ms += slope
        vs *= 0.999
        vs += np.multiply(slope, slope, out=slope)
        np.sqrt(vs, out=free)
        free += least
        np.divide(ms, free, out=free)
        free *= rates[step[:live], None]
        flat -= free
        step[:live] += 1
        at[:live] += batch
        for k in np.flatnonzero(at[:live] >= n[:live])[::-1]:
            mean = loss[k] / n[k] * (1 if classify else 0.5)
            stale[k] = stale[k] + 1 if mean > best[k] - 1e-4 else 0
            best[k] = min(best[k], mean)
            epoch[k] += 1
            if stale[k] < 10 and epoch[k] < first.epochs:
                turn(k)
                continue
            nets[own[k]].weights = [part for layer in parts(w[k : k + 1]) for part in (layer[0, :, :-1].T.copy(), layer[0, :, -1].copy())]
            users[n[k]] -= 1
            if not users[n[k]]:
                drawn.pop(n[k], None)
            if load(k):
                continue
            live -= 1
            if k < live:  # the last one moves here
                for a in (given, w, m, v, n, own, at, epoch, step, stale, loss, best):
                    a[k] = a[live]
                order[k] = order[live] + (k - live) * most
    return nets


def _bit_task(bits: np.ndarray, w: int, seed: int, share: float = 0.8, most: int | None = None, least: int = 200):
    """(tested, data to train on or None, what a network's test gives); the last is the delta itself where nothing is trained."""
    n = len(bits) - w
    train = int(share * n) if n > 0 else 0
    if n <= 0 or n - train < least or not train:
        return max(n - train, 0), None, None
    bits = np.asarray(bits, np.int8)
    x, y = np.lib.stride_tricks.sliding_window_view(bits, w)[:n], bits[w:]
    begin = train - min(train, most or train)
    if len(np.unique(y[begin:train])) < 2:
        return n - train, None, float((y[train:] == y[begin]).mean() - 0.5)
    return n - train, (x[begin:train], y[begin:train]), lambda net: float(((net.predict(x[train:].astype(float))[:, 0] > 0.5) == y[train:]).mean() - 0.5)


def _block_task(bits: np.ndarray, w: int, seed: int, share: float = 0.8, most: int | None = None, least: int = 200):
    b = bits[: len(bits) // w * w].reshape(-1, w).astype(float)
    pairs = len(b) - 1
    train = int(share * pairs) if pairs > 0 else 0
    tested = max(pairs - train, 0) * w
    if tested < least or not train:
        return tested, None, None
    begin = train - min(train, most or train)
    x = b[:-1]
    centre, scale = x[begin:train].mean(axis=0), x[begin:train].std(axis=0)
    x = (x - centre) / np.where(scale > 0, scale, 1)
    return tested, (x[begin:train], b[1:][begin:train]), lambda net: float(((net.predict(x[train:]) > 0.5) == b[1:][train:].astype(bool)).mean() - 0.5)


def _deltas(task, sequences: list[np.ndarray], classify: bool, w: int, seed: int, mosts: list[int | None] | None = None, **options) -> list[tuple[float | None, int]]:
    # in single precision, as the reference's networks of these checks, whose inputs are float32
    tasks = [task(s, w, seed, most=most, **options) for s, most in zip(sequences, mosts or [None] * len(sequences), strict=True)]
    trained = iter(fit_all([t[1] for t in tasks if t[1] is not None], w, classify, seed, dtype=np.float32))
    return [(found if data is None else found(next(trained)), tested) for tested, data, found in tasks]


def bit_deltas(sequences: list[np.ndarray], w: int, seed: int, mosts: list[int | None] | None = None, **options) -> list[tuple[float | None, int]]:
    """Of each sequence the test accuracy, less a half, of the next bit after each window of w bits, and the number of tests."""
    return _deltas(_bit_task, sequences, True, w, seed, mosts, **options)


def block_deltas(sequences: list[np.ndarray], w: int, seed: int, mosts: list[int | None] | None = None, **options) -> list[tuple[float | None, int]]:
    """Of each sequence the bit accuracy, less a half, of the next block of w bits after each, and the number of tests."""
    return _deltas(_block_task, sequences, False, w, seed, mosts, **options)


def bit_delta(bits: np.ndarray, w: int, seed: int, share: float = 0.8, most: int | None = None, least: int = 200) -> tuple[float | None, int]:
    """Test accuracy, less a half, of the next bit after each window of w bits."""
    return bit_deltas([bits], w, seed, [most], share=share, least=least)[0]


def block_delta(bits: np.ndarray, w: int, seed: int, share: float = 0.8, most: int | None = None, least: int = 200) -> tuple[float | None, int]:
    """Bit accuracy, less a half, of the next block of w bits after each."""
    return block_deltas([bits], w, seed, [most], share=share, least=least)[0]


def rhos(series: list[np.ndarray], w: int, seed: int, share: float = 0.8, least: int = 10) -> list[float | None]:
    """Of each series one less the ratio of the prediction's squared error to the variance of the next value."""
    tasks = []
    for d in series:
        n = len(d) - w
        train = int(share * n) if n > 0 else 0
        if train < least or n - train < least:
            tasks.append(None)
            continue
        x, y = np.lib.stride_tricks.sliding_window_view(d, w)[:n], d[w:]
        centre, scale = x[:train].mean(axis=0), x[:train].std(axis=0)
        tasks.append(((x - centre) / np.where(scale > 0, scale, 1), y, train))
    trained = iter(fit_all([(x[:train], y[:train]) for x, y, train in filter(None, tasks)], w, False, seed))

    def tested(x: np.ndarray, y: np.ndarray, train: int) -> float | None:
        guess = next(trained).predict(x[train:])[:, 0]
        spread = y[train:].var()
        return float(1 - ((y[train:] - guess) ** 2).mean() / spread) if spread > 0 else None

    return [None if t is None else tested(*t) for t in tasks]


def rho(d: np.ndarray, w: int, seed: int, share: float = 0.8, least: int = 10) -> float | None:
    return rhos([d], w, seed, share, least)[0]


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows that are small but long to work on, dealt over four tasks a core, however few bytes they are: fewer would leave
    cores idle, more would leave too few sequences in a task to train side by side."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def checks(seq: DataFrame, bit: str, windows: tuple[int, ...] = (8, 16, 32), modes: tuple[str, ...] = ("bit", "block"), directions: tuple[str, ...] = ("fwd", "bwd"), seed: int = 42, most: int | Callable[[int], int] | None = None, together: int = 32) -> DataFrame:
    """clip, mode, w, dir, n_test, delta for every check of the grid. A task trains the networks of `together` clips side by side.
    most: the training windows at most, or a function of the sequence's length that gives them."""
    rows = dealt(seq.groupBy("clip").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col(bit).cast("tinyint").alias("b")))), lambda s: s["b"]).alias("bits")), "clip")
    kind = seq.schema["clip"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), together):
                part = pdf.iloc[at : at + together]
                each = [np.asarray(b, np.int64) for b in part["bits"]]
                mosts = [most(len(x)) if callable(most) else most for x in each]
                # both directions of all clips side by side, a group for each network's shape
                turned = [x[::-1] if d == "bwd" else x for d in directions for x in each]
                out = []
                for mode in modes:
                    for w in windows:
                        found = iter((bit_deltas if mode == "bit" else block_deltas)(turned, w, seed, mosts * len(directions)))
                        out += [(clip, mode, w, d, n, delta) for d in directions for clip, (delta, n) in zip(part["clip"], found)]  # noqa: B905
                yield pd.DataFrame(out, columns=["clip", "mode", "w", "dir", "n_test", "delta"])

    return rows.mapInPandas(run, f"clip {kind}, mode string, w int, dir string, n_test long, delta double")
