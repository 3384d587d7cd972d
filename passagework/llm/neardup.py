"""Near-duplicates by min-max hashing.

The distinct shingles of a text are hashed by K permutations; of each both the
minimum and the maximum are kept, which gives 2K signature values for K hash
evaluations. The chance that two texts share a minimum, or a maximum, is the
similarity of their shingle sets, so bands over either are unbiased. Texts that
share a band are candidates; candidates whose sizes or signatures rule the
threshold out are dropped, and the shingle sets of the rest are compared
exactly, so no pair below the threshold is reported.

Texts with equal shingle sets are one class, worked through its smallest id. A
band that many texts share (boilerplate, say) is not paired: its texts are
joined on the rarest part of their shingle sets, which no pair that reaches the
threshold can fail to share, so that nothing is lost and common shingles make
no candidates.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.session import materialize

_WORD = re.compile(r"\w+")
#: Texts in a band beyond which its texts are not paired but joined on their rarest shingles.
HOT = 64


@dataclass(frozen=True)
class Shape:
    """What is compared, and how wide the net is.

    A pair at similarity s is missed with a chance of (1 - s**rows)**bands: with
    the default 3e-5 at 0.8 and 4e-3 at 0.7 (below its threshold), with
    `MAP_TEXTS` 6e-5 at 0.6, 5e-8 at 0.7 and less than 1e-12 at 0.8.
    """

    shingle: int = 5
    threshold: float = 0.8
    min_words: int = 1
    bands: int = 20
    rows: int = 4
    seed: int = 20111

    @property
    def permutations(self) -> int:
        return self.bands * self.rows // 2

    @property
    def least_matches(self) -> int:
        """Signature bytes that a pair at the threshold has in common at least: 5.5 standard deviations below the mean, missed by 2 in 10**8."""
        n, q = 2 * self.permutations, self.threshold + (1 - self.threshold) / 256
        return max(0, math.floor(n * q - 5.5 * math.sqrt(n * q * (1 - q))))


#: Three words, 0.6, twenty words at least: the passages and files of a map.
MAP_TEXTS = Shape(shingle=3, threshold=0.6, min_words=20, bands=40, rows=3)


class _WordHashes(dict):
    """64-bit hashes of words, kept as long as they are few enough."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _WordHashes()


def _words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(texts: list[str | None], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles in order, number of shingles of each text).

    A text of fewer words than a shingle, but not fewer than `min_words`, has
    one shingle of all its words; one of fewer has none.
    """
    w = shape.shingle
    hashes: list[int] = []
    lengths = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        found = _words(text)
        if len(found) >= max(1, shape.min_words):
            hashes += map(_HASHES.__getitem__, found)
            if len(found) < w:
                hashes += [0] * (w - len(found))  # no word hashes to this in practice
            lengths[i] = max(len(found), w)
    x = np.array(hashes, np.uint64)
    n = len(x)
    counts = np.maximum(lengths - w + 1, 0)
    if not n:
        return np.empty(0, np.uint64), counts
    h = x[: n - w + 1].copy()
    for k in range(1, w):
        h = _mix(h) + x[k : n - w + 1 + k]
    # A shingle that runs into the next text is none.
    ends = np.cumsum(lengths[lengths > 0])
    ok = np.ones(n, bool)
    for k in range(1, w):
        ok[ends - k] = False
    return _mix(h)[ok[: n - w + 1]], counts


def _distinct(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles sorted and distinct within each text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[first], np.bincount(owner[first], minlength=len(counts))


def signatures(h: np.ndarray, counts: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(band keys: texts x bands, signature bytes: texts x 2 permutations) of texts with at least one shingle each.

    Band 2j holds the minima and band 2j+1 the maxima of the permutations of
    group j; the values of a band are of different permutations.
    """
    rng = np.random.default_rng(shape.seed)
    a = rng.integers(0, 1 << 63, shape.permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, shape.permutations, dtype=np.uint64)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    out = np.empty((len(counts), shape.bands), np.uint64)
    sketch = np.empty((len(counts), 2 * shape.permutations), np.uint8)
    for j in range(shape.bands // 2):
        low = np.full(len(counts), 2 * j + 1, np.uint64)
        high = np.full(len(counts), 2 * j + 2, np.uint64)
        for k in range(j * shape.rows, (j + 1) * shape.rows):
            v = h * a[k] + b[k]
            least, most = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
            low, high = _mix(low) + least, _mix(high) + most
            sketch[:, 2 * k], sketch[:, 2 * k + 1] = _mix(least) & np.uint64(0xFF), _mix(most) & np.uint64(0xFF)
        out[:, 2 * j], out[:, 2 * j + 1] = _mix(low), _mix(high)
    return out, sketch


def _signer(shape: Shape, block: int = 400_000):
    """Rows (id, class of equal shingle sets, number of shingles, signature bytes, band keys) of the texts that have shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):  # bounded blocks, whatever the batch holds
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size < 6 * block):
                    size += len(texts[stop] or "")
                    stop += 1
                h, counts = shingle_hashes(texts[at:stop], shape)
                kept = np.flatnonzero(counts)
                if len(kept):
                    h, counts = _distinct(h, counts)
                    counts = counts[kept]
                    ends = np.cumsum(counts)
                    same = [xxhash.xxh3_128_digest(h[e - c : e].tobytes()) for e, c in zip(ends.tolist(), counts.tolist())]
                    keys, sketch = signatures(h, counts, shape)
                    bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), shape.bands).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(kept + at)), pa.array(same, pa.binary()), pa.array(counts, pa.int32()), pa.array([row.tobytes() for row in sketch], pa.binary()), bands], names=["id", "same", "n", "sketch", "bands"])
                at = stop

    return run


def _shingle_sets(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, counts = shingle_hashes(batch.column(1).to_pylist(), shape)
            h, counts = _distinct(h, counts)
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64)))], names=["id", "shingles"])

    return run


def _similar_sketches(least: int, fields: str):
    """Pairs whose signature bytes agree in `least` places at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            ok = pa.array((a == b).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return run, fields


class NearDuplicates:
    """Near-duplicates of one collection; the steps are made once and shared.

    Ids are of an orderable type; rows with a null id do not take part, an id
    that occurs with several texts stands for each of them, and rows that are
    repeated count once. Null and empty texts, and texts under `min_words`, are
    no duplicates of anything.
    """

    def __init__(self, texts: DataFrame, id: str, text: str, shape: Shape = Shape()):
        self.shape, self.kind = shape, texts.schema[id].dataType.simpleString()
        self.texts = texts.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"))
        signed = self.texts.mapInArrow(_signer(shape), f"id {self.kind}, same binary, n int, sketch binary, bands array<bigint>")
        self.signed = materialize(signed, "signatures")
        #: (same, rep): the smallest id of each class; one row a class and task is shuffled.
        self.classes = self.signed.groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))

    def members(self) -> DataFrame:
        """(id, rep) of every text that takes part."""
        return self.signed.select("id", "same").distinct().join(self.classes.select("same", "rep"), "same").select("id", "rep")

    def _bands(self) -> DataFrame:
        """(id, n, band) of the representatives, with the number of their shingles."""
        reps = self.classes.select(F.col("rep").alias("id"))
        held = self.signed.select("id", "n", "bands").join(reps, "id", "left_semi")
        return held.select("id", "n", F.explode("bands").alias("band"))  # a repeated row repeats its bands; pairs are made distinct

    def _could_reach(self):
        """Whether two sets of these sizes can reach the threshold: an exact bound."""
        return F.least("na", "nb") >= (self.shape.threshold - 1e-9) * F.greatest("na", "nb")

    def candidates(self, bands: DataFrame | None = None, part: DataFrame | None = None) -> DataFrame:
        """(a, b), a < b: representatives that share a band and whose sizes allow the threshold.

        With `part` (id, group_id), only those of different groups. Bands of
        more than `HOT` texts are left to `_by_rare_shingles`.
        """
        bands = materialize(self._bands(), "bands") if bands is None else bands
        hot = materialize(bands.groupBy("band").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > HOT).select("band"), "hot")
        some = not hot.isEmpty()
        cold = bands.join(hot, "band", "left_anti") if some else bands
        pairs = self._joined(cold, "band", part)
        if some:
            pairs = pairs.unionByName(self._by_rare_shingles(bands.join(hot, "band", "left_semi").select("id").distinct(), part))
        return pairs.distinct()

    def _joined(self, rows: DataFrame, on: str, part: DataFrame | None) -> DataFrame:
        """(a, b) of rows (id, n, on) that share a value of `on`."""
        apart = F.lit(True)
        if part is not None:
            rows = rows.join(part, "id")
            apart = F.col("ga") != F.col("gb")
        side = lambda x: rows.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), on, *([F.col("group_id").alias(f"g{x}")] if part is not None else []))
        return side("a").join(side("b"), on).where((F.col("a") < F.col("b")) & apart & self._could_reach()).select("a", "b")

    def _by_rare_shingles(self, ids: DataFrame, part: DataFrame | None) -> DataFrame:
        """(a, b) of the texts `ids` that share one of their rarest shingles.

        Of n shingles a text takes the n - ceil(t n) + 1 that fewest of these
        texts have; two sets that reach the threshold t share one of those.
        """
        sets = self.texts.join(ids, "id", "left_semi").mapInArrow(_shingle_sets(self.shape), f"id {self.kind}, shingles array<bigint>")
        rows = materialize(sets.select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("s")), "hot-shingles")
        often = rows.groupBy("s").agg(F.count(F.lit(1)).alias("texts"))
        ranked = rows.join(often, "s").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("texts", "s"))).alias("r"))
        first = F.col("n") - F.ceil((F.lit(self.shape.threshold) - 1e-9) * F.col("n")) + 1
        prefix = ranked.select("id", "n", F.explode(F.slice("r", F.lit(1), first.cast("int"))).alias("x")).select("id", "n", F.col("x.s").alias("s"))
        return self._joined(prefix, "s", part)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b, similarity) of those pairs that reach the threshold exactly; signatures go first, so that few pairs carry shingles."""
        signs = self.signed.select("id", "sketch")
        signed = pairs.join(signs.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").join(signs.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
        run, fields = _similar_sketches(self.shape.least_matches, f"a {self.kind}, b {self.kind}")
        pairs = materialize(signed.select("a", "b", "sa", "sb").mapInArrow(run, fields).distinct(), "candidates")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = self.texts.join(ids, "id", "left_semi").mapInArrow(_shingle_sets(self.shape), f"id {self.kind}, shingles array<bigint>")
        sets = materialize(sets, "shingles")
        with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
        both = with_a.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        similarity = shared / (F.size("sa") + F.size("sb") - shared)
        return both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= self.shape.threshold - 1e-12)

    def pairs(self) -> DataFrame:
        """(a, b, similarity) between representatives; with `members` that is every link."""
        return self.verified(self.candidates())

    def all_pairs(self) -> DataFrame:
        """(a, b), a < b, of all texts, copies included. As large as its answer: for groups use `groups`."""
        members = materialize(self.members(), "members")
        many = members.join(self.classes.where("n > 1").select("rep"), "rep", "left_semi")
        copies = many.select("rep", F.col("id").alias("a")).join(many.select("rep", F.col("id").alias("b")), "rep").where("a < b").select("a", "b")
        links = self.pairs().select(F.col("a").alias("ra"), F.col("b").alias("rb"))
        out = links.join(members.select(F.col("rep").alias("ra"), F.col("id").alias("x")), "ra").join(members.select(F.col("rep").alias("rb"), F.col("id").alias("y")), "rb")
        pairs = copies.unionByName(out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
        return pairs.where("a < b").distinct()

    def groups(self) -> DataFrame:
        """(id, group_id): one row per text that takes part; the group is its smallest id.

        Groups are the connected parts of the links between candidates. A band
        that many texts share is first linked through its smallest id alone;
        texts that this leaves apart are then candidates with all others of
        their bands in other groups, so that no link is lost and a band whose
        texts are all alike costs one comparison a text.
        """
        bands = materialize(self._bands(), "bands")
        heads = bands.groupBy("band").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        stars = bands.join(heads, "band").where("id > head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
        links = self.verified(stars).select("a", "b")
        reps = self.classes.select(F.col("rep").alias("id"))
        part = materialize(connected(reps, links), "parts")
        told = bands.join(part, "id")
        mixed = told.groupBy("band").agg(F.min("group_id").alias("low"), F.max("group_id").alias("high")).where("low <> high").select("band")
        open_ = materialize(bands.join(mixed, "band", "left_semi"), "mixed")
        left = self.candidates(open_, part)
        more = self.verified(left.join(stars, ["a", "b"], "left_anti")).select("a", "b")
        # Parts found so far enter as one link a text.
        known = part.where("id <> group_id").select(F.col("group_id").alias("a"), F.col("id").alias("b"))
        final = connected(reps, known.unionByName(more))
        grouped = self.members().join(final.select(F.col("id").alias("rep"), "group_id"), "rep")
        return grouped.groupBy("id").agg(F.min("group_id").alias("group_id"))


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, group_id) of every node: connected parts by alternating large and small stars.

    Each round is two shuffles of the edges, and its result is written to the
    shared folder; it goes on until nothing changes, in rounds that grow with the logarithm of the longest chain. Hot
    nodes are pre-aggregated: a node's smallest neighbour is a minimum.
    """
    kind = nodes.schema["id"].dataType
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    held = materialize(both, "edges")
    mark, before = _fingerprint(held), None
    while mark != before:
        # Large star: every larger neighbour of u is tied to the smallest of u and its neighbours.
        two = held.select("u", "v").unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = two.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = two.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours are tied to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        held = materialize(small, "edges")
        mark, before = _fingerprint(held), mark
    parents = held.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("group_id"))
    return nodes.select(F.col("id").cast(kind)).distinct().join(parents, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


def _fingerprint(edges: DataFrame) -> tuple:
    """Size and order-free hash of an edge list: two numbers, whatever its size."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head()
    return tuple(row)


def near_duplicate_pairs(texts: DataFrame, id: str, text: str, shape: Shape = MAP_TEXTS) -> DataFrame:
    """(a, b), a < b: ids of texts whose similarity reaches the threshold, copies included."""
    return NearDuplicates(texts, id, text, shape).all_pairs()


def near_duplicate_groups(texts: DataFrame, id: str, text: str, shape: Shape = Shape()) -> DataFrame:
    """(id, group_id) of every text that takes part."""
    return NearDuplicates(texts, id, text, shape).groups()
