"""Filling containers of a fixed capacity with whole texts: linear grouping.

1. Sizes are counted. There are at most as many different sizes as the
   capacity, so the plan is made from a small table, whatever the number of texts.
2. Large sizes are cut into groups of equal numbers of texts and rounded up to
   the largest of their group. The few sizes that remain are packed by
   configurations, found by column generation over the linear programme.
3. The texts themselves take the places of the rounded sizes: each has a
   position among the texts of its group, and a position belongs to a container.
4. The room that is left, and new containers after it, are filled with the
   small texts by best fit, planned on counts of equal rooms and equal sizes.

Positions are counted in buckets, so that a size which a third of all texts
have is numbered by many tasks.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.words import word_and_sign_count
from passagework.session import materialize

CAPACITY = 1024


@dataclass
class Plan:
    """Where the texts of each large size go.

    `places`: (size, first, last, container, per) - texts `first`..`last`
    (exclusive) of a size, in their order, go `per` at a time into the
    containers from number `container` on.
    """

    containers: int = 0
    places: list[tuple[int, int, int, int, int]] = field(default_factory=list)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how often, pieces of each size) that cover the demand, near the fewest containers.

    The linear programme is solved by column generation: the basis is priced,
    a knapsack finds the configuration that is worth most, and it enters until
    none is worth more than a container by a ten-millionth. Whole numbers of times are taken, and
    what then remains is packed largest first.
    """
    k = len(sizes)
    if not k:
        return []
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, float)
    x = np.linalg.solve(basis, need)
    knapsack = Knapsack(sizes, capacity)
    while True:
        price = np.linalg.solve(basis.T, np.ones(k))
        column = knapsack.best(np.maximum(price, 0))
        if price @ column <= 1 + 1e-7:
            break
        direction = np.linalg.solve(basis, column)
        ok = direction > 1e-9
        ratio = np.where(ok, x / np.where(ok, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        x = np.maximum(np.linalg.solve(basis, need), 0)
    left = np.array(demand, np.int64)
    used: list[tuple[int, list[int]]] = []
    for times, column in sorted(((int(np.floor(t + 1e-9)), basis[:, i].astype(np.int64)) for i, t in enumerate(x)), key=lambda p: (-p[0], p[1].tolist())):
        # A basis may cover more than is asked for; no configuration is used beyond what is left.
        while times > 0 and (take := np.minimum(column, left)).any():
            often = min(times, int((left[take > 0] // take[take > 0]).min()))
            used.append((often, take.tolist()))
            left -= often * take
            times -= often
    while left.any():
        room, take = capacity, np.zeros(k, np.int64)
        for i in sorted(range(k), key=lambda i: -sizes[i]):
            take[i] = min(left[i], room // sizes[i])
            room -= take[i] * sizes[i]
        often = int((left[take > 0] // take[take > 0]).min())
        used.append((often, take.tolist()))
        left -= often * take
    return used


class Knapsack:
    """Finds the configuration within the capacity that is worth most, for one list of sizes and many prices.

    Layer k holds the best worth of at most k pieces in every room; a layer is
    one step over a table of sizes by rooms. Large sizes leave few layers.
    """

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = np.array(sizes), capacity
        room = np.arange(capacity + 1)
        left = room[None, :] - self.sizes[:, None]
        self.fits, self.left = left >= 0, np.maximum(left, 0)
        self.layers = capacity // min(sizes)

    def best(self, worth: np.ndarray) -> np.ndarray:
        best = np.zeros(self.capacity + 1)
        taken: list[np.ndarray] = []
        for _ in range(self.layers):
            offered = np.where(self.fits, best[self.left] + worth[:, None], -1.0)
            which = offered.argmax(axis=0)
            told = offered[which, np.arange(self.capacity + 1)]
            better = told > best + 1e-12
            if not better.any():
                break
            taken.append(np.where(better, which, -1))
            best = np.where(better, told, best)
        column, room = np.zeros(len(self.sizes)), self.capacity
        for choice in reversed(taken):
            if (i := choice[room]) >= 0:
                column[i] += 1
                room -= int(self.sizes[i])
        return column


def plan_large(counts: dict[int, int], capacity: int, groups: int) -> Plan:
    """Places of the large texts; `counts` has how many there are of each size."""
    plan = Plan()
    total = sum(counts.values())
    if not total:
        return plan
    # Groups of about equal numbers, from the largest size down. A size is in one group, and one that
    # would overfill a group begins its own, so that a common size is never rounded up to rare ones.
    grouped: list[list[int]] = [[]]
    held = 0
    for size in sorted(counts, reverse=True):
        if grouped[-1] and held + counts[size] > total / groups:
            grouped.append([])
            held = 0
        grouped[-1].append(size)
        held += counts[size]
    tops = [g[0] for g in grouped]
    number = [sum(counts[s] for s in g) for g in grouped]
    given = [0] * len(grouped)  # texts of the group that have their place
    # (first text of the group, last, container, per) by group; the group's texts are in order of size.
    spans: list[list[tuple[int, int, int, int]]] = [[] for _ in grouped]
    for often, take in configurations(tops, number, capacity):
        for i, per in enumerate(take):
            if per:
                spans[i].append((given[i], given[i] + often * per, plan.containers, per))
                given[i] += often * per
        plan.containers += often
    for sizes, held_spans in zip(grouped, spans):
        at = 0
        for size in sizes:
            for first, last, container, per in held_spans:
                low, high = max(first, at), min(last, at + counts[size])
                while low < high:
                    # A container may hold texts of two sizes of a group: the pieces before it is full come singly.
                    inside = (low - first) % per
                    stop = min(high, low + per - inside) if inside else (high if high - low < per else low + (high - low) // per * per)
                    width = per if not inside and stop - low >= per else stop - low
                    plan.places.append((size, low - at, stop - at, container + (low - first) // per, width))
                    low = stop
            at += counts[size]
    return plan


def rooms_of(plan: Plan, capacity: int) -> dict[int, int]:
    """How many containers of a plan have how much room left; from the runs of the plan, without any text."""
    filled: dict[int, int] = defaultdict(int)  # where the fill changes, and by how much
    for size, first, last, container, per in plan.places:
        full, rest = divmod(last - first, per)
        for at, n, times in ((container, per, full), (container + full, rest, 1)):
            filled[at] += n * size
            filled[at + times] -= n * size
    out: dict[int, int] = defaultdict(int)
    level, cuts = 0, sorted({0, plan.containers, *filled})
    for at, end in zip(cuts, cuts[1:]):
        level += filled[at]
        if level < capacity and at < plan.containers:
            out[capacity - level] += min(end, plan.containers) - at
    return dict(out)


def best_plan(counts: dict[int, int], capacity: int, groups: int, small_parts: tuple[int, ...]) -> tuple[int, Plan]:
    """(largest small size, plan) with the fewest containers over several limits between large and small texts."""
    tried = []
    for part in small_parts:
        least = capacity // part
        plan = plan_large({s: n for s, n in counts.items() if s > least}, capacity, groups)
        _, new = plan_small(rooms_of(plan, capacity), {s: n for s, n in counts.items() if s <= least}, capacity)
        tried.append((plan.containers + new, part, least, plan))
    _, _, least, plan = min(tried, key=lambda t: t[:2])
    return least, plan


def plan_small(rooms: dict[int, int], counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best fit of small texts: (size, first, last, room, first container of that room, per), and the number
    of new containers. Room -1 stands for new containers.

    Equal rooms are kept as runs of containers; a text goes to the smallest
    room that takes it, and then the next to what is left of that room.
    """
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # room -> (original room, first, last)
    for room, n in rooms.items():
        runs[room].append((room, 0, n))
    heap = sorted(runs)
    fills: list[tuple[int, int, int, int, int, int]] = []
    new = 0
    for size in sorted(counts, reverse=True):
        at, n = 0, counts[size]
        usable = sorted(r for r in runs if r >= size and runs[r])
        heapq.heapify(usable)
        while at < n:
            while usable and not runs[usable[0]]:
                heapq.heappop(usable)
            if not usable:
                per = capacity // size
                need = -(-(n - at) // per)
                runs[capacity].append((-1, new, new + need))
                new += need
                heapq.heappush(usable, capacity)
            room = usable[0]
            origin, first, last = runs[room].pop()
            per = room // size
            full = min(last - first, (n - at) // per)
            if full:
                fills.append((size, at, at + full * per, origin, first, per))
                at += full * per
                _back(runs, usable, room - per * size, (origin, first, first + full), size)
                first += full
            if first < last and at < n and (n - at) < per:
                fills.append((size, at, n, origin, first, n - at))
                _back(runs, usable, room - (n - at) * size, (origin, first, first + 1), size)
                at, first = n, first + 1
            if first < last:
                runs[room].append((origin, first, last))
    return fills, new


def _back(runs, usable, room: int, run: tuple[int, int, int], size: int) -> None:
    if room > 0:
        runs[room].append(run)
        if room >= size:
            heapq.heappush(usable, room)


def pieces_of(texts: DataFrame, id: str, text: str, capacity: int, count) -> DataFrame:
    """(id, piece_no, n_pieces, n_tokens): a text within the capacity is one piece, a
    longer one full pieces and a rest. Texts without tokens take no room and have none."""
    sized = texts.select(F.col(id).alias("id"), count(F.col(text)).cast("bigint").alias("n")).where("n > 0")
    sized = sized.withColumn("n_pieces", F.ceil(F.col("n") / capacity).cast("int"))
    exploded = sized.select("id", "n", "n_pieces", F.explode(F.sequence(F.lit(1), "n_pieces")).alias("piece_no"))
    last = F.col("piece_no") == F.col("n_pieces")
    return exploded.select("id", "piece_no", "n_pieces", F.when(last, F.col("n") - (F.col("n_pieces") - 1) * capacity).otherwise(capacity).cast("int").alias("n_tokens"))


def _numbered(rows: DataFrame, by: str, order: list[Column], buckets: int, label: str) -> DataFrame:
    """`rows` with `pos`: numbers from 0 within each value of `by`.

    Rows are numbered inside buckets of a hash, and a bucket starts where the
    ones before it end; the sums run over one row a value and bucket.
    """
    held = materialize(rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")), label)
    counts = held.groupBy(by, "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(by, "bucket", F.coalesce(before, F.lit(0)).alias("start"))
    local = F.row_number().over(Window.partitionBy(by, "bucket").orderBy(*order)) - 1
    return held.withColumn("local", local).join(starts, [by, "bucket"]).withColumn("pos", F.col("start") + F.col("local")).drop("local", "start", "bucket")


def _spans(df: DataFrame, rows: list[tuple], fields: str) -> DataFrame:
    """`df` (size, pos) with the span of the plan that holds its position.

    The plan has a bounded number of rows (it follows the capacity and the
    groups, not the texts), a few of each size; how it is joined is left to the
    optimiser, which knows its size.
    """
    spark = df.sparkSession
    plan = spark.createDataFrame(rows, f"size int, first bigint, last bigint, {fields}")
    return df.join(plan, (F.col("n_tokens") == F.col("size")) & (F.col("pos") >= F.col("first")) & (F.col("pos") < F.col("last"))).drop("size", "last")


def packed(texts: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, count=word_and_sign_count, groups: int = 48, small_parts: tuple[int, ...] = (4, 8, 16), bucket_rows: int = 50_000) -> DataFrame:
    """(container, id, piece_no, n_pieces, n_tokens) of every text that has tokens.

    No container holds more than `capacity` tokens, and no text is cut unless
    it alone is longer. Texts over a part of the capacity are large; of several
    `small_parts` the one is taken whose plan needs the fewest containers.
    `count` gives a text's tokens. Equal ids are told apart by nothing but
    their order; null ids are allowed.
    """
    pieces = pieces_of(texts, id, text, capacity, count)
    held = materialize(pieces, "pieces")
    # At most `capacity` rows.
    counts = {r.n_tokens: r.n for r in held.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    buckets = max(1, -(-total // bucket_rows))
    least, plan = best_plan(counts, capacity, groups, small_parts)
    order = [F.col("id"), F.col("piece_no")]
    numbered = materialize(_numbered(held, "n_tokens", order, buckets, "items"), "numbered")
    put = _spans(numbered.where(F.col("n_tokens") > least), plan.places, "container bigint, per bigint")
    put = put.select((F.col("container") + F.floor((F.col("pos") - F.col("first")) / F.col("per"))).alias("container"), "id", "piece_no", "n_pieces", "n_tokens")
    put = materialize(put, "large")
    rooms = put.groupBy("container").agg((F.lit(capacity) - F.sum("n_tokens")).cast("int").alias("room"))
    rooms = materialize(_numbered(rooms.where("room > 0"), "room", [F.col("container")], buckets, "rooms"), "rooms")
    room_counts = {r.room: r.n for r in rooms.groupBy("room").agg(F.count(F.lit(1)).alias("n")).collect()}
    fills, _ = plan_small(room_counts, {s: n for s, n in counts.items() if s <= least}, capacity)
    small = _spans(numbered.where(F.col("n_tokens") <= least), fills, "origin int, at bigint, per bigint")
    small = small.withColumn("rank", F.col("at") + F.floor((F.col("pos") - F.col("first")) / F.col("per")))
    fresh = small.where("origin < 0").select((F.col("rank") + plan.containers).alias("container"), "id", "piece_no", "n_pieces", "n_tokens")
    fitted = small.where("origin >= 0").join(rooms.select(F.col("room").alias("origin"), F.col("pos").alias("rank"), "container"), ["origin", "rank"])
    out = put.unionByName(fresh).unionByName(fitted.select("container", "id", "piece_no", "n_pieces", "n_tokens"))
    return out.withColumnRenamed("id", id) if id != "container" else out


def tokenizer_count(path: str):
    """A `count` for `packed` by a tokenizer file (`tokenizers` JSON); the file's path is the parameter."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        tok = _tokenizer(path)
        found = tok.encode_batch([t or "" for t in texts], add_special_tokens=False)
        return pd.Series([len(x.ids) for x in found], dtype="int64")

    return count


_TOKENIZERS: dict = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        _TOKENIZERS[path] = tok
    return _TOKENIZERS[path]


def fill_summary(packing: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, least_containers, unused_share): how well the room is used."""
    per = packing.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    total = per.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))
    return total.select("containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_containers"), (1 - F.col("tokens") / (F.col("containers") * capacity)).alias("unused_share"))
