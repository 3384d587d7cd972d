"""Evaluation passages that stand in training text: suffix arrays over the corpus.

Each task sorts the suffixes of the words of its documents (a shard), block by
block so that memory is bounded, and looks up every suffix of the test
passages in it by binary search. The neighbours in sorted order give the
longest verbatim match of a test suffix, the range of entries with its first
words gives all places. The corpus is never shuffled; only (document, item)
rows leave a task, each with the place of its longest match.

`leaked_passages` makes the arrays of the words that the tests know, uses them
once and keeps nothing. `SuffixShards` stores the arrays of a whole corpus, to
be searched by any number of test sets without reading texts again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.canonical import fold_caseless
from passagework.session import materialize

#: Words that must match in a row.
MIN_WORDS = 12
#: Words in one suffix array; about 60 bytes of memory each.
BLOCK_WORDS = 1 << 20
#: Bytes of passages sent to the tasks at a time; a larger test set takes several passes.
TEST_BYTES = 32 << 20

_WORD = re.compile(r"\w+")


def leak_words(text: str) -> list[str]:
    """Words for matching: case, signs, markup (outer underscores too) and look-alikes don't count."""
    found = _WORD.findall(fold_caseless(text))
    return [w for x in found if (w := x.strip("_"))] if "_" in text or "＿" in text else found


class Numbers(dict):
    """Numbers from 1 for the words of the passages; any other word is 0 and ends every match."""

    def __missing__(self, word: str) -> int:
        return 0


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Places of `codes` sorted by their next `depth` codes, at least.

    By prefix doubling: each round sorts by pairs of ranks, twice as deep as
    the round before; it ends when no two ranks are equal or the depth is reached.
    """
    n = len(codes)
    rank = codes.astype(np.int64)
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - width)] = rank[width:] + 1
        pair = rank * (int(second.max(initial=0)) + 1) + second
        order = np.argsort(pair, kind="stable")
        new = np.empty(n, np.int64)
        held = pair[order]
        new[order] = np.cumsum(np.concatenate(([0], held[1:] != held[:-1]))) if n else 0
        rank, width = new, width * 2
        if width >= depth or n == 0 or rank[order[-1]] == n - 1:
            return order


def _compare(codes: np.ndarray, places: np.ndarray, tests: np.ndarray, suffixes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(sign of corpus suffix against test suffix, words in common) of each pair, within `most` words."""
    common = np.zeros(len(places), np.int64)
    sign = np.zeros(len(places), np.int8)
    open_ = np.arange(len(places))
    for step in range(most):
        p, s = places[open_] + step, suffixes[open_] + step
        a = np.where(p < len(codes), codes[np.minimum(p, len(codes) - 1)], -1)
        b = np.where(s < len(tests), tests[np.minimum(s, len(tests) - 1)], -1)
        differ = (a != b) | (b <= 0)  # a passage ends at a break
        sign[open_[differ]] = np.sign(a[differ] - b[differ])
        open_ = open_[~differ]
        if not len(open_):
            break
        common[open_] += 1
    return sign, common


def _edge(codes, order, tests, suffixes, words: int, upper: bool) -> np.ndarray:
    """First entry of `order` not below (with `upper`: above) the first `words` words of each suffix."""
    low, high = np.zeros(len(suffixes), np.int64), np.full(len(suffixes), len(order), np.int64)
    while (todo := low < high).any():
        mid = (low + high) // 2
        at = np.flatnonzero(todo)
        sign, common = _compare(codes, order[mid[at]], tests, suffixes[at], words)
        below = (sign < 0) & (common < words) | upper & (common >= words)
        low[at] = np.where(below, mid[at] + 1, low[at])
        high[at] = np.where(below, high[at], mid[at])
    return low


#: Columns of matches: document, item, words in common, place in the document's codes, place in the tests' codes.
Matches = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _longest_first(docs, items, words, places, suffixes) -> Matches:
    """One match a document and item: the longest, then the first in the document, then the first in the passage."""
    order = np.lexsort((suffixes, places, -words, items, docs))
    docs, items = docs[order], items[order]
    first = np.ones(len(order), bool)
    first[1:] = (docs[1:] != docs[:-1]) | (items[1:] != items[:-1])
    kept = order[first]
    return docs[first], items[first], words[kept], places[kept], suffixes[kept]


def block_matches(codes: np.ndarray, doc_of: np.ndarray, tests: np.ndarray, item_of: np.ndarray, min_words: int, most: int, order: np.ndarray | None = None) -> Matches:
    """The matches of a block: the longest in each document and item.

    `order` is the block's suffix array, if it is there already; it must be
    sorted by `min_words` codes at least.
    """
    order = suffix_array(codes, most) if order is None else order
    # Where a match of the needed length begins, an entry has that many words of the passages before a break.
    suffixes = _starts(tests, min_words)
    empty = (np.empty(0, np.int64),) * 5
    if not len(order) or not len(suffixes):
        return empty
    low, high = _edge(codes, order, tests, suffixes, min_words, False), _edge(codes, order, tests, suffixes, min_words, True)
    met = high > low
    hit, low, counts = suffixes[met], low[met], (high - low)[met]
    parts: list[Matches] = []
    # The places of a suffix are taken in runs of bounded size: a hot passage may stand in every document.
    ends = np.cumsum(counts)
    start = 0
    while start < len(hit):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + (1 << 20), "right")))
        which = np.repeat(np.arange(start, stop), counts[start:stop])
        offset = np.arange(len(which)) - np.repeat(ends[start:stop] - counts[start:stop] - done, counts[start:stop])
        places = order[low[which] + offset]
        _, common = _compare(codes, places, tests, hit[which], most)
        parts.append(_longest_first(doc_of[places], item_of[hit[which]], common, places, hit[which]))
        start = stop
    return _longest_first(*(np.concatenate(x) for x in zip(*parts))) if parts else empty


def _starts(codes: np.ndarray, words: int) -> np.ndarray:
    """Places from which at least `words` codes follow without a break."""
    n = len(codes)
    if n < words:
        return np.empty(0, np.int64)
    breaks = np.concatenate(([0], np.cumsum(codes <= 0)))
    at = np.arange(n - words + 1)
    return at[breaks[at + words] == breaks[at]]


RESULT = "words int, doc_word bigint, item_word bigint"


def leaked_passages(documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS, test_bytes: int = TEST_BYTES) -> DataFrame:
    """(doc, item, words, doc_word, item_word): documents in which at least `min_words` consecutive
    words of an item's passage stand consecutively, with the longest such run
    and the number, from 0, of its first word in the document and in the passage.

    Null and empty texts and passages match nothing; passages shorter than
    `min_words` can't leak. Ids may repeat: a row stands for its text. The
    passages go to the tasks in blocks of at most `test_bytes`; a document
    beyond `block_words` words is worked in parts that overlap by the longest
    passage. The number of blocks of either kind does not change the result.
    """
    doc_type, item_type = documents.schema[doc].dataType.simpleString(), items.schema[item].dataType.simpleString()
    corpus = documents.where(F.length(text) > 0).select(doc, text)
    out = None
    for held in _test_blocks(items, item, passage, test_bytes):
        sent = documents.sparkSession.sparkContext.broadcast(held)
        found = corpus.mapInArrow(_searcher(sent, min_words, block_words, item, item_type), f"`{doc}` {doc_type}, `{item}` {item_type}, {RESULT}")
        out = found if out is None else out.unionByName(found)
    return out


def _test_blocks(items: DataFrame, item: str, passage: str, test_bytes: int) -> Iterator[list[tuple]]:
    """(item, passage) of the tests, in blocks of about `test_bytes`; one block at least."""
    told = items.where(F.length(passage) > 0).select(item, passage)
    size = told.agg(F.coalesce(F.sum(F.octet_length(passage)), F.lit(0)).alias("n")).head().n
    blocks = max(1, -(-size // test_bytes))
    for b in range(blocks):
        yield [(r[0], r[1]) for r in told.where(F.pmod(F.xxhash64(item, passage), F.lit(blocks)) == b).toLocalIterator()]


class Tests:
    """The passages of a block as codes; one is followed by a break."""

    def __init__(self, rows: list[tuple], number):
        self.ids = [item for item, _ in rows]
        coded = [np.array([number(w) for w in leak_words(passage)] + [0], np.int64) for _, passage in rows]
        lengths = [len(c) for c in coded]
        self.codes = np.concatenate(coded) if coded else np.empty(0, np.int64)
        self.item_of = np.repeat(np.arange(len(rows)), lengths)
        self.starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64) if coded else np.empty(0, np.int64)
        self.most = _longest_run(self.codes)


class Found:
    """The longest match of each document and item, over the blocks and the test rows of equal ids."""

    def __init__(self, tests: Tests):
        self.tests, self.best = tests, {}

    def add(self, matches: Matches, doc_of, word_of) -> None:
        """`doc_of` tells the document of its number in the block, `word_of` the word in it of a place."""
        for d, i, n, place, suffix in zip(*(x.tolist() for x in matches)):
            key, told = (doc_of(d), self.tests.ids[i]), (n, -word_of(d, place), -(suffix - int(self.tests.starts[i])))
            if key not in self.best or told > self.best[key]:
                self.best[key] = told

    def batch(self, doc_type: pa.DataType, doc: str, item_type: str, item: str) -> pa.RecordBatch:
        keys, told = list(self.best), list(self.best.values())
        self.best = {}
        columns = [pa.array([k[0] for k in keys], doc_type), pa.array([k[1] for k in keys], _arrow(item_type)), pa.array([t[0] for t in told], pa.int32()), *(pa.array([-t[k] for t in told], pa.int64()) for k in (1, 2))]
        return pa.RecordBatch.from_arrays(columns, names=[doc, item, "words", "doc_word", "item_word"])


#: Characters of a text that are cut into words at a time, up to the next space.
SEGMENT = 1 << 22


def text_codes(body: str, number) -> np.ndarray:
    """Codes of the words of a text, cut at spaces where it is long."""
    if len(body) <= SEGMENT:
        return np.fromiter(map(number, leak_words(body)), np.int64)
    parts, at = [], 0
    space = re.compile(r"\s")
    while at < len(body):
        m = space.search(body, at + SEGMENT)
        stop = m.end() if m else len(body)
        parts.append(np.fromiter(map(number, leak_words(body[at:stop])), np.int64))
        at = stop
    return np.concatenate(parts)


def _searcher(sent, min_words: int, block_words: int, item: str, item_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        tests = Tests(sent.value, lambda w: numbers.setdefault(w, len(numbers) + 1))
        number, most, found = numbers.__getitem__, max(tests.most, min_words), Found(tests)
        docs, codes, words, held, field = [], [], [], 0, None

        def search() -> pa.RecordBatch:
            ends = np.cumsum([len(c) for c in codes])
            found.add(block_matches(np.concatenate(codes), np.repeat(np.arange(len(codes)), np.diff(ends, prepend=0)), tests.codes, tests.item_of, min_words, most), docs.__getitem__, lambda d, place: int(words[d][place - (int(ends[d - 1]) if d else 0)]))
            return found.batch(field.type, field.name, item_type, item)

        for batch in batches:
            field = batch.schema.field(0)
            for d, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # Only runs of known words that are long enough can match; the rest of a text is a break.
                kept, at = _long_runs(text_codes(body, number), min_words)
                # A part reaches into the next by what a match may need.
                for low in range(0, len(kept), block_words):
                    part = slice(low, low + block_words + most)
                    docs.append(d)
                    codes.append(np.append(kept[part], 0))
                    words.append(np.append(at[part], 0))
                    held += len(codes[-1])
                    if held >= block_words:
                        yield search()
                        docs, codes, words, held = [], [], [], 0
        if codes:
            yield search()

    return run


def _longest_run(codes: np.ndarray) -> int:
    ends = np.flatnonzero(codes <= 0)
    return int(np.diff(np.concatenate(([-1], ends))).max(initial=1)) if len(ends) else max(1, len(codes))


def _long_runs(codes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(`codes` without what no match of `words` words can touch, with a break after each run; their places)."""
    at = _starts(codes, words)
    keep = np.zeros(len(codes) + 1, np.int32)
    keep[at] += 1
    np.subtract.at(keep, at + words, 1)
    inside = np.concatenate((np.cumsum(keep)[: len(codes)] > 0, [False]))
    edge = np.concatenate(([False], inside[:-1])) & ~inside
    out = np.concatenate((codes, [0]))
    out[edge] = 0
    some = np.flatnonzero(inside | edge)
    return out[some], some


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def without_leaks(documents: DataFrame, leaks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The documents in which no passage stands."""
    return documents.join(leaks.select(doc).distinct(), doc, "left_anti")


def word_code(word: str) -> int:
    """A code of a word that is the same for every text and test: 62 bits of its hash, never 0."""
    return (xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 2) + 1


class _Codes(dict):
    """Codes of words, kept as long as they are few enough."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = code = word_code(word)
        return code


_CODES = _Codes()
#: Words by which stored suffixes are sorted at least; tests may ask for matches of up to so many.
DEPTH = 16


class SuffixShards:
    """Stored suffix arrays of a corpus: a row a shard, about 12 bytes a word.

    Built once by tasks that see their own documents only, and searched by
    every test set by binary search, a pass over the shards for each block of
    tests; texts are not read again.
    """

    SCHEMA = "first_words array<bigint>, starts array<int>, codes binary, suffixes binary"

    def __init__(self, shards: DataFrame, doc: str):
        self.shards, self.doc = shards, doc

    @classmethod
    def build(cls, documents: DataFrame, doc: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS, halo: int = 4096) -> SuffixShards:
        """Shards of all words of all texts. A document beyond a block is stored in parts that overlap by `halo` words, the longest match that is told in full."""
        doc_type = documents.schema[doc].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            docs, firsts, codes, held, kind = [], [], [], 0, None

            def shard() -> pa.RecordBatch:
                joined = np.concatenate(codes)
                starts = np.concatenate(([0], np.cumsum([len(c) for c in codes])[:-1])).astype(np.int32)
                dense = np.unique(joined, return_inverse=True)[1]
                order = suffix_array(dense, DEPTH).astype(np.int32)
                one = [pa.array([docs], pa.list_(kind)), pa.array([firsts], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int32())), pa.array([joined.tobytes()], pa.binary()), pa.array([order.tobytes()], pa.binary())]
                return pa.RecordBatch.from_arrays(one, names=["docs", "first_words", "starts", "codes", "suffixes"])

            for batch in batches:
                kind = batch.schema.field(0).type
                for d, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    told = text_codes(body, _CODES.__getitem__)
                    for low in range(0, len(told), block_words):
                        docs.append(d)
                        firsts.append(low)
                        codes.append(np.append(told[low : low + block_words + halo], 0))
                        held += len(codes[-1])
                        if held >= block_words:
                            yield shard()
                            docs, firsts, codes, held = [], [], [], 0
            if codes:
                yield shard()

        rows = documents.where(F.length(text) > 0).select(doc, text).mapInArrow(run, f"docs array<{doc_type}>, {cls.SCHEMA}")
        return cls(materialize(rows, "suffixes"), doc)

    def search(self, items: DataFrame, item: str = "item_id", passage: str = "passage", min_words: int = MIN_WORDS, test_bytes: int = TEST_BYTES) -> DataFrame:
        """The rows of `leaked_passages`, from the stored arrays; a document in several parts has a row a part."""
        if min_words > DEPTH:
            raise ValueError(f"stored suffixes are sorted by {DEPTH} words")
        doc, item_type = self.doc, items.schema[item].dataType.simpleString()
        doc_type = self.shards.schema["docs"].dataType.elementType.simpleString()
        out = None
        for rows in _test_blocks(items, item, passage, test_bytes):
            sent = items.sparkSession.sparkContext.broadcast(rows)

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                tests = Tests(sent.value, _CODES.__getitem__)
                found = Found(tests)
                for batch in batches:
                    for k in range(batch.num_rows):
                        docs, firsts, starts = (batch.column(n)[k].as_py() for n in range(3))
                        codes, order = np.frombuffer(batch.column(3)[k].as_py(), np.int64), np.frombuffer(batch.column(4)[k].as_py(), np.int32)
                        doc_of = np.repeat(np.arange(len(docs)), np.diff([*starts, len(codes)]))
                        matches = block_matches(codes, doc_of, tests.codes, tests.item_of, min_words, max(tests.most, min_words), order)
                        found.add(matches, docs.__getitem__, lambda d, place: firsts[d] + place - starts[d])  # noqa: B023 - used at once
                    yield found.batch(batch.schema.field(0).type.value_type, doc, item_type, item)

            some = self.shards.mapInArrow(run, f"`{doc}` {doc_type}, `{item}` {item_type}, {RESULT}")
            out = some if out is None else out.unionByName(some)
        return out
