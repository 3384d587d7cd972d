"""Logistic regressions on hashed bags, those of all folds in the same passes over the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from passagework.session import materialize

#: Buckets of rows that a block holds before the next begins.
BLOCK = 500_000
#: Tasks of a pass at most: each gives back a gradient of every fold.
TASKS = 32
#: A fold is done when its gradient is this small beside the first.
TOLERANCE = 1e-6
#: Steps that the next one is drawn from.
MEMORY = 10

BLOCKS = "fold int, sizes binary, at binary, code binary, worth binary, positive binary"


def blocks(rows: DataFrame, bag) -> DataFrame:
    """`rows` (fold, positive, text) as blocks of a fold each, written once; `bag` gives the buckets of a text with their values."""

    def packed(fold: int, held: list[tuple[dict[int, float], bool]]) -> pa.RecordBatch:
        order = [sorted(b) for b, _ in held]
        at = np.array([k for ks in order for k in ks], dtype=np.int32)
        values = np.array([b[k] for (b, _), ks in zip(held, order) for k in ks], dtype=np.float64)
        # A value is told by its place among the few that there are.
        worth, code = np.unique(values, return_inverse=True)
        code = code.astype(np.uint16 if len(worth) <= 1 << 16 else np.uint32)
        sizes = np.array([len(ks) for ks in order], dtype=np.int32)
        parts = (sizes, at, code, worth, np.array([p for _, p in held], dtype=np.uint8))
        return pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["fold", "sizes", "at", "code", "worth", "positive"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        room: dict[int, int] = {}
        for batch in batches:
            for fold, positive, text in zip(*(batch.column(n).to_pylist() for n in ("fold", "positive", "text"))):
                b = bag(text)
                held.setdefault(fold, []).append((b, positive))
                # A row without words takes room too.
                room[fold] = room.get(fold, 0) + max(1, len(b))
                if room[fold] >= BLOCK:
                    yield packed(fold, held.pop(fold))
                    room[fold] = 0
        for fold, rest in held.items():
            yield packed(fold, rest)

    return materialize(rows.select("fold", "positive", "text").mapInArrow(run, BLOCKS), "bags")


class _Block:
    """The rows of one block, opened."""

    def __init__(self, row):
        self.fold, self.sizes, self.at = row[0], np.frombuffer(row[1], np.int32), np.frombuffer(row[2], np.int32)
        self.worth = np.frombuffer(row[4], np.float64)
        code = np.frombuffer(row[3], np.uint16 if len(self.worth) <= 1 << 16 else np.uint32)
        self.values, self.positive = self.worth[code], np.frombuffer(row[5], np.uint8)
        self.full = np.flatnonzero(self.sizes)
        self.starts = (np.cumsum(self.sizes) - self.sizes)[self.full]

    def decided(self, weights: np.ndarray) -> np.ndarray:
        """The decision value of every row; the last weight is the intercept."""
        out = np.full(len(self.sizes), weights[-1])
        if len(self.full):
            out[self.full] += np.add.reduceat(self.values * weights[self.at], self.starts)
        return out

    def gathered(self, rows: np.ndarray, features: int) -> np.ndarray:
        """Sums of a number of each row over its buckets, and over all rows."""
        return np.append(np.bincount(self.at, self.values * np.repeat(rows, self.sizes), features), rows.sum())


def _descent(scale: np.ndarray) -> Iterator[np.ndarray]:
    """A generator of points that is sent (loss, gradient) at each and returns the point where the gradient is as good as zero.

    Limited-memory quasi-Newton steps from `scale`, halved until they lower the loss.
    """
    w = np.zeros(len(scale))
    loss, g = yield w
    first = np.linalg.norm(g)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    while np.linalg.norm(g) > TOLERANCE * first:
        d, drawn = -g, []
        for s, y, r in reversed(steps):
            drawn.append(a := r * (s @ d))
            d = d - a * y
        if steps:
            s, y, r = steps[-1]
            d = d / (r * (y @ (y / scale)))
        d = d / scale
        for (s, y, r), a in zip(steps, reversed(drawn)):
            d = d + s * (a - r * (y @ d))
        slope, t = g @ d, 1.0
        while True:
            new, ng = yield w + t * d
            if new <= loss + 1e-4 * t * slope:
                break
            t /= 2
            if t < 1e-12:  # no step lowers the loss any more, as far as it can be told
                return w
        s, y = (t * d).astype(np.float32), (ng - g).astype(np.float32)
        if (sy := float(s @ y)) > 0:
            steps = [*steps[1 - MEMORY :], (s, y, 1 / sy)]
        w, loss, g = w + t * d, new, ng
    return w


def by_fold(made: DataFrame, folds: int, features: int) -> DataFrame:
    """(fold, score, positive): the decision value of each row by a regression on the rows of the other folds.

    The loss is summed over the rows, and the weights, not the intercept, are
    held down by half their square. A fold that lacks a kind of rows, in itself
    or in the rest, has none. The rows are never moved after the first time:
    a pass sends the weights of all folds out and brings their gradients back.
    """
    spark = made.sparkSession
    sc = spark.sparkContext
    opened = made.repartition(min(TASKS, sc.defaultParallelism)).rdd.map(tuple)

    def squares(rows):
        n, sums = np.zeros((folds, 2), dtype=np.int64), {}
        for b in map(_Block, rows):
            n[b.fold] += (np.sum(b.positive == 0), np.sum(b.positive != 0))
            got = np.bincount(b.at, b.values**2, features)
            sums[b.fold] = sums[b.fold] + got if b.fold in sums else got
        # They only scale the steps.
        yield n, {fold: got.astype(np.float32) for fold, got in sums.items()}

    def summed(sent, rows):
        asked = sent.value
        out = {}
        for b in map(_Block, rows):
            for fold, weights in asked.items():
                if fold == b.fold:
                    continue
                s = b.decided(weights)
                loss = np.sum(np.logaddexp(0, s) - b.positive * s)
                g = b.gathered((1 + np.tanh(s / 2)) / 2 - b.positive, len(weights) - 1)
                if fold in out:
                    out[fold] = (out[fold][0] + loss, out[fold][1] + g)
                else:
                    out[fold] = (loss, g)
        # Single precision on the way is far finer than TOLERANCE; sums are double.
        yield {fold: (loss, g.astype(np.float32)) for fold, (loss, g) in out.items()}

    n, sums = np.zeros((folds, 2), dtype=np.int64), np.zeros((folds, features))
    for k, held in opened.mapPartitions(squares).collect():
        n += k
        for fold, got in held.items():
            sums[fold] += got
    rest, total = n.sum(axis=0) - n, sums.sum(axis=0)
    # The weight of a bucket that no row has stays 0, so only the others are numbered.
    used = np.flatnonzero(total)
    number = np.zeros(features, dtype=np.int32)
    number[used] = np.arange(len(used))
    runs, asked, found = {}, {}, {}
    for fold in range(folds):
        if n[fold].all() and rest[fold].all():
            scale = np.append(np.maximum(total - sums[fold], 0)[used], rest[fold].sum()) / 4
            scale[:-1] += 1
            runs[fold] = _descent(np.sqrt(scale))
            asked[fold] = next(runs[fold])
    del sums, total
    numbers = sc.broadcast(number)
    passed = opened.map(lambda r: (*r[:2], numbers.value[np.frombuffer(r[2], np.int32)].tobytes(), *r[3:])).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        while asked:
            sent = sc.broadcast(asked)
            parts = passed.mapPartitions(lambda rows, sent=sent: summed(sent, rows)).collect()
            sent.destroy()
            after = {}
            for fold, w in asked.items():
                loss, g = w[:-1] @ w[:-1] / 2, np.append(w[:-1], 0.0)
                for part in parts:
                    if fold in part:
                        loss, g = loss + part[fold][0], g + part[fold][1]
                try:
                    after[fold] = runs[fold].send((loss, g))
                except StopIteration as e:
                    found[fold] = np.zeros(features + 1)
                    found[fold][used], found[fold][-1] = e.value[:-1], e.value[-1]
            del parts
            asked = after
    finally:
        passed.unpersist()
        numbers.destroy()
    sent = sc.broadcast(found)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] in sent.value:
                    b = _Block(row)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.sizes), b.fold, dtype=np.int32)), pa.array(b.decided(sent.value[b.fold])), pa.array(b.positive != 0)], ["fold", "score", "positive"])

    return materialize(made.mapInArrow(told, "fold int, score double, positive boolean"), "decided")
