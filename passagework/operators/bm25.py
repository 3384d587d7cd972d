"""BM25 over the index for a whole table of queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from passagework.functions import fixed, text
from passagework.functions.words import WORD
from passagework.operators.index import Index
from passagework.session import materialize

#: Scores are rounded to this many places before ranking, so that the order of a sum can't turn a rank.
PLACES = 9


def query_phrases(queries: DataFrame, phrases: bool | None = None) -> DataFrame:
    """(query_id, phrase, terms): what a query is matched by.

    `queries` has (query_id, text). Each word of two characters or more is a
    phrase of its index terms (`a_b` is the phrase `a b`); with `phrases`, or
    where it is None in Vietnamese queries, so is each pair of adjacent words.
    Equal spellings count once, spellings that the index folds into one count
    each. A null or empty query has no phrases.
    """
    said = F.coalesce(F.col("text"), F.lit(""))
    held = queries.select("query_id", F.regexp_extract_all(F.lower(said), F.lit(WORD), F.lit(0)).alias("w"), (F.lit(phrases) if phrases is not None else text.is_vietnamese(said)).alias("paired"))
    single = F.filter("w", lambda x: F.char_length(x) > 1)
    pairs = F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.get("w", i), x))
    none = F.array().cast("array<string>")
    spelled = held.select("query_id", F.explode(F.array_distinct(F.concat(single, F.when(F.col("paired"), pairs).otherwise(none)))).alias("spelling"))
    told = spelled.select("query_id", text.terms(F.col("spelling")).alias("terms")).where(F.size("terms") > 0)
    return told.select("query_id", F.array_join("terms", " ").alias("phrase"), "terms")


def _long_hits(index: Index, phrases: DataFrame, weight, several: int) -> DataFrame:
    """Hits of phrases of several terms: only the places of a phrase's rarest term
    are looked at, and the other terms are asked for at theirs in the same chunk.

    These places are written once; where they are few, they too go to the postings."""
    parts = phrases.select("phrase", F.size("terms").alias("n"), F.posexplode("terms").alias("i", "term"))
    # Few phrases go to the postings, which are not moved to meet them.
    sent = F.broadcast if several <= PHRASES_SENT else lambda rows: rows
    held = index.postings.join(sent(parts.select("term").distinct()), "term", "left_semi")
    # A term that no chunk has drops out here, and its phrase lacks an agreeing part below.
    known = parts.join(index.terms.select("term", "df"), "term")
    rarest = known.groupBy("phrase").agg(F.min_by(F.struct("i", "term"), F.struct("df", "i")).alias("r")).select("phrase", F.col("r.i").alias("at"), F.col("r.term").alias("term"))
    starts = held.join(sent(rarest), "term").select("phrase", "at", "chunk_id", "len", "head_len", F.explode("positions").alias("pos"))
    wanted = materialize(starts, "starts").join(sent(parts), "phrase").where("i <> at").select("phrase", "n", "chunk_id", "len", "head_len", (F.col("pos") - F.col("at")).alias("start"), "i", "term")
    if several <= PHRASES_SENT and wanted.count() <= PLACES_SENT:
        wanted = F.broadcast(wanted)
    met = wanted.join(held.select("chunk_id", "term", "positions"), ["chunk_id", "term"]).where(F.array_contains("positions", F.col("start") + F.col("i")))
    whole = met.groupBy("phrase", "n", "chunk_id", "len", "head_len", "start").agg(F.count(F.lit(1)).alias("agree")).where("agree = n - 1")
    return whole.groupBy("phrase", "chunk_id", "len").agg(weight(F.count_if(F.col("start") < F.col("head_len")), F.count_if(F.col("start") >= F.col("head_len"))).alias("f"))


def scores(index: Index, queries: DataFrame, phrases: bool | None = None, head_weight: float = 1.0, inside: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of every chunk that has a phrase of the query.

    Numbers of chunks, lengths and document frequencies are those of the whole
    index, whatever is filtered later. A phrase that more than half of the
    chunks have still counts a little. With `inside` (chunk_id, part) and a
    column `part` of the queries, a query only meets the chunks of its part,
    before anything is summed.
    """
    told = query_phrases(queries, phrases)
    keep = ["query_id", "phrase"]
    if inside is not None:
        told = told.join(queries.select("query_id", "part"), "query_id")
        keep.append("part")
    worth = phrase_worth(index, told, head_weight)
    if inside is not None:
        worth = worth.join(inside.select("chunk_id", "part"), "chunk_id")
    return told.select(*keep).join(worth, keep[1:]).groupBy("query_id", "chunk_id").agg(F.round(F.sum("worth"), PLACES).alias("score"))


def idf(n: Column, df: Column) -> Column:
    raw = F.ln((n - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, fixed.LEAST_IDF).otherwise(raw)


def top(scored: DataFrame, k: int | Column, tie: str = "chunk_id") -> DataFrame:
    """(query_id, chunk_id, score, bm25_rank): the `k` best of each query, ties by `tie`.

    A fixed limit is taken in every task before the rows of a query meet; one by query is not.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), tie)
    return scored.withColumn("bm25_rank", F.row_number().over(order)).where(F.col("bm25_rank") <= k)


#: Rows of (phrase, chunk) that one task holds at a time when it scores queries.
ROWS_AT_ONCE = 3_000_000
#: Phrases up to which the weights of all are sent to every task; beyond that the join is left to the optimiser.
PHRASES_SENT = 200_000
#: Places of terms up to which all are sent to every task, when phrases of several terms are looked for.
PLACES_SENT = 200_000


def search(index: Index, queries: DataFrame, k: int | DataFrame, allowed: DataFrame | None = None, phrases: bool | None = None, head_weight: float = 1.0) -> DataFrame:
    """The `k` best chunks of each query among `allowed` (chunk_id, or query_id and chunk_id).

    `k` is a number or a table (query_id, k). The result is written once: it is
    small, and widenings read it many times.
    """
    told = query_phrases(queries, phrases)
    if allowed is None or "query_id" not in allowed.columns:
        return best(index, told, k, allowed=allowed, head_weight=head_weight)
    # Each query has a part of its own.
    pairs = allowed.select("query_id", "chunk_id").distinct()
    return best(index, told, k, pairs.select("query_id", F.col("query_id").alias("part")), pairs.select("chunk_id", F.col("query_id").alias("part")), head_weight=head_weight)


def best(index: Index, told: DataFrame, k: int | DataFrame, asked_parts: DataFrame | None = None, chunk_parts: DataFrame | None = None, allowed: DataFrame | None = None, head_weight: float = 1.0) -> DataFrame:
    """(query_id, chunk_id, score, bm25_rank): the `k` best chunks of each query by its phrases (query_id, phrase, terms).

    With `asked_parts` (query_id, part) and `chunk_parts` (chunk_id, part) a
    query only meets the chunks of its parts. Rows of (query, phrase, chunk)
    grow with the product of queries and chunks, so they are never made: a
    task holds a share of a part's chunks with what each phrase is worth in
    them, sums the queries over it one at a time, and only the best of a query
    in each share leave it. A chunk lies in one share of a part with all its
    phrases, so the best of the best are exact.
    """
    told = told.select("query_id", "phrase", "terms")
    known = weights(index, told)
    number = _numbers(known)
    if not number.n:
        kinds = [(n, (told if n == "query_id" else index.postings).schema[n].dataType.simpleString()) for n in ("query_id", "chunk_id")]
        return told.sparkSession.createDataFrame([], ", ".join(f"{n} {kind}" for n, kind in kinds) + ", score double, bm25_rank int")
    at_once = max(100, ROWS_AT_ONCE)
    total = number.rows or 0
    hits = _hits_by_number(index, known, head_weight, number)
    if allowed is not None:
        hits = hits.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
    depth = F.lit(k).cast("int") if isinstance(k, int) else F.col("k").cast("int")
    asked = told.join(known.select("phrase", "pid"), "phrase").groupBy("query_id").agg(F.array_sort(F.collect_list("pid")).alias("pids"))
    asked = asked if isinstance(k, int) else asked.join(k.select("query_id", "k"), "query_id")
    asked = asked.select("query_id", "pids", depth.alias("k"))
    least = told.sparkSession.sparkContext.defaultParallelism
    if asked_parts is None:
        shares = max(least, -(-total // at_once))
        asked = asked.withColumn("part", F.lit(0)).withColumn("shares", F.lit(shares))
        worth, of_share = _packed(hits, shares).withColumn("part", F.lit(0)), _best_of_packed
    else:
        wanted = asked_parts.select("query_id", "part").distinct()
        held = chunk_parts.select("chunk_id", "part").distinct().join(wanted.select("part").distinct(), "part", "left_semi")
        sizes = held.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        # What a part's chunks have is judged by their number.
        shares = F.ceil(F.col("n") / F.greatest(F.lit(1), F.floor(F.lit(at_once) * F.col("all") / max(total, 1)))).cast("int")
        sizes = sizes.crossJoin(F.broadcast(index.stats.select(F.col("n").alias("all")))).select("part", shares.alias("shares"))
        # Where they are few, what the phrases are worth is not moved to meet the parts of the chunks.
        worth = hits.withColumn("worth", _worth(F.col("f"))).join(sent(materialize(held.join(sizes, "part"), "members")), "chunk_id")
        asked = asked.join(wanted, "query_id").join(sizes, "part")
        worth, of_share = worth.select("part", _share(F.col("shares")), "pid", "chunk_id", "worth"), _best_of_share
    asked = asked.select("part", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "query_id", "pids", "k")
    names = {n: rows.schema[n].dataType.simpleString() for n, rows in (("query_id", asked), ("chunk_id", hits))}
    found = worth.groupBy("part", "share").cogroup(asked.groupBy("part", "share")).applyInArrow(of_share, f"query_id {names['query_id']}, chunk_id {names['chunk_id']}, score double, k int")
    if asked_parts is not None:
        found = found.distinct()  # a chunk may be in several parts of a query
    out = top(found, k) if isinstance(k, int) else top(found, F.col("k"))
    return materialize(out.drop("k"), "best")


def _share(shares: Column) -> Column:
    return F.pmod(F.xxhash64("chunk_id"), shares).cast("int").alias("share")


#: Rows of (phrase, chunk) that a task packs at a time.
PACKED_AT_ONCE = 1_000_000


def _squeezed(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones and so on: most are the same."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), codec="zstd", asbytes=True)


def _loosened(held: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(held, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _packed(hits: DataFrame, shares: int) -> DataFrame:
    """`hits` by share, thousands to a row, each chunk with its length and each phrase with its idf once.

    What is shuffled is a small part of the rows one by one, of which there are as many as postings.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    key = hits.schema["chunk_id"].dataType
    kinds = [("share", pa.int32()), ("avg_len", pa.float64()), ("n", pa.int32()), ("chunks", pa.list_(to_arrow_type(key))), ("lens", pa.list_(pa.int64())), ("pids", pa.list_(pa.int64())), ("idfs", pa.list_(pa.float64())), ("sizes", pa.list_(pa.int32())), ("at", pa.binary()), ("f", pa.binary())]

    def packed(rows: pa.Table) -> pa.RecordBatch:
        share = rows["share"].to_numpy()
        ids = pc.unique(rows["chunk_id"])
        at, pid, f = pc.index_in(rows["chunk_id"], ids).to_numpy().astype(np.int32), rows["pid"].to_numpy(), rows["f"].to_numpy()
        order = np.lexsort((at, pid, share))
        bounds = np.flatnonzero(np.r_[True, np.diff(share[order]) != 0, True])
        idf, lens, avg_len = rows["idf"].to_numpy(), rows["len"].to_numpy(), rows["avg_len"].to_numpy()
        out: list[tuple] = []
        for s, e in zip(bounds[:-1], bounds[1:]):
            some = order[s:e]
            held, first, here = np.unique(at[some], return_index=True, return_inverse=True)
            starts = np.flatnonzero(np.r_[True, np.diff(pid[some]) != 0])
            steps = np.diff(here.astype(np.int32), prepend=np.int32(0))
            out.append((share[some[0]], avg_len[some[0]], len(some), ids.take(pa.array(held)), lens[some[first]], pid[some[starts]], idf[some[starts]], np.diff(np.r_[starts, len(some)]), _squeezed(steps), _squeezed(f[some])))
        return pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], kind) for i, (_, kind) in enumerate(kinds)], schema=pa.schema(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACKED_AT_ONCE:
                yield packed(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield packed(pa.Table.from_batches(held))

    rows = hits.select(_share(F.lit(shares)), "pid", "chunk_id", F.col("f").cast("double").alias("f"), F.col("len").cast("bigint").alias("len"), "idf", "avg_len")
    return rows.mapInArrow(run, f"share int, avg_len double, n int, chunks array<{key.simpleString()}>, lens array<bigint>, pids array<bigint>, idfs array<double>, sizes array<int>, at binary, f binary")


def _best_of_packed(packed: pa.Table, asked: pa.Table) -> pa.Table:
    """What `_best_of_share` gives of the rows that were packed."""
    ids = pc.list_flatten(packed["chunks"]).combine_chunks()
    pids, ats, worths, before = [], [], [], 0
    for row in packed.select(["avg_len", "n", "lens", "pids", "idfs", "sizes", "at", "f"]).to_pylist():
        at = np.cumsum(_loosened(row["at"], "int32", row["n"]), dtype=np.int64)
        f, sizes = _loosened(row["f"], "float64", row["n"]), row["sizes"]
        idf, length = np.repeat(np.array(row["idfs"], np.float64), sizes), np.array(row["lens"], np.int64)[at]
        worths.append(_worth_of(idf, f, length, row["avg_len"]))
        pids.append(np.repeat(np.array(row["pids"], np.int64), sizes))
        ats.append(at + before)
        before += len(row["lens"])
    some = np.concatenate(ats) if ats else np.zeros(0, np.int64)
    columns = [np.concatenate(pids) if pids else np.zeros(0, np.int64), ids.take(pa.array(some)), np.concatenate(worths) if worths else np.zeros(0)]
    return _best_of_share(pa.table(columns, ["pid", "chunk_id", "worth"]), asked)


def _best_of_share(worth: pa.Table, asked: pa.Table) -> pa.Table:
    """(query_id, chunk_id, score, k): the best of every query in one share of the chunks."""
    kinds = [("query_id", asked.schema.field("query_id").type), ("chunk_id", worth.schema.field("chunk_id").type), ("score", pa.float64()), ("k", pa.int32())]
    if not len(worth) or not len(asked):
        return pa.schema(kinds).empty_table()
    # Chunks by number, in the order that ties go by.
    ids = pc.unique(worth["chunk_id"])
    ids = ids.take(pc.sort_indices(ids))
    at = pc.index_in(worth["chunk_id"], ids).to_numpy()
    pid, value = worth["pid"].to_numpy(), worth["worth"].to_numpy()
    order = np.lexsort((at, pid))
    pid, at, value = pid[order], at[order], value[order]
    # Chunks that are indexed twice count with the sum of both.
    first = np.flatnonzero(np.r_[True, (pid[1:] != pid[:-1]) | (at[1:] != at[:-1])])
    if len(first) < len(pid):
        pid, at, value = pid[first], at[first], np.add.reduceat(value, first)
    lists, starts = np.unique(pid, return_index=True)
    span = dict(zip(lists.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(pid)])))
    total = np.zeros(len(ids))
    who, chunks, scores = [], [], []
    for i, (pids, k) in enumerate(zip(asked["pids"].to_pylist(), asked["k"].to_pylist())):
        spans = sorted((span[p] for p in pids if p in span), key=lambda s: s[1] - s[0])
        if not spans or k < 1:
            continue
        for s, e in spans:
            total[at[s:e]] += value[s:e]
        # The k-th best chunk of one phrase is a score that the k best have at least.
        least = next((np.partition(total[at[s:e]], e - s - k)[e - s - k] for s, e in spans if e - s >= k), 0.0)
        if least > 1e-6:
            some = np.flatnonzero(total >= least - 1e-7)
        else:
            some = np.unique(np.concatenate([at[s:e] for s, e in spans]))
        score = np.round(total[some], PLACES)
        picked = np.lexsort((some, -score))[:k]
        who.append(np.full(len(picked), i))
        chunks.append(some[picked])
        scores.append(score[picked])
        for s, e in spans:
            total[at[s:e]] = 0.0
    if not who:
        return pa.schema(kinds).empty_table()
    rows = pa.array(np.concatenate(who))
    columns = [asked["query_id"].combine_chunks().take(rows), ids.take(pa.array(np.concatenate(chunks))), pa.array(np.concatenate(scores)), asked["k"].combine_chunks().take(rows)]
    return pa.Table.from_arrays(columns, schema=pa.schema(kinds))


def weights(index: Index, phrases: DataFrame) -> DataFrame:
    """(phrase, pid, terms, df, idf, avg_len) of every distinct phrase, written once; df and idf are null for those of several terms.

    A term that no chunk has is left out.
    """
    known = phrases.groupBy("phrase").agg(F.first("terms").alias("terms"))
    held = known.join(index.terms.select("term", "df"), F.col("phrase") == F.col("term"), "left").where("df is not null or size(terms) > 1")
    # `stats` is one row.
    weighed = held.crossJoin(F.broadcast(index.stats)).withColumn("idf", idf(F.col("n"), F.col("df")))
    return materialize(weighed.select("phrase", F.monotonically_increasing_id().alias("pid"), "terms", "df", "idf", "avg_len"), "weights")


def _worth_of(idf, f, length, avg_len):
    """Of columns or of arrays: the steps are the same, and so is every bit."""
    return idf * f * (fixed.K1 + 1) / (f + fixed.K1 * (1 - fixed.B + fixed.B * length / avg_len))


def _worth(f: Column) -> Column:
    return _worth_of(F.col("idf"), f, F.col("len"), F.col("avg_len"))


def sent(rows: DataFrame) -> DataFrame:
    """`rows` (a written table) for every task where they are few; else a join with them is left to the optimiser."""
    return F.broadcast(rows) if rows.count() <= PHRASES_SENT else rows


def _numbers(known: DataFrame) -> Row:
    """How many phrases there are, how many of several terms, and the rows of postings of the others."""
    return known.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("terms") > 1).alias("several"), F.sum("df").alias("rows")).head()


def _hits_by_number(index: Index, known: DataFrame, head_weight: float, number: Row) -> DataFrame:
    """(pid, chunk_id, f, len, idf, avg_len) of the phrases of `known`; `f` is how often a chunk has one.

    Terms have their numbers of chunks from the index, so their postings are
    read once, where they lie; those of longer phrases are counted.
    """
    weight = lambda head, body: F.lit(head_weight) * head + body
    sent = F.broadcast if number.n <= PHRASES_SENT else lambda rows: rows
    columns = ["pid", "chunk_id", "f", "len", "idf", "avg_len"]
    singles = known.where(F.size("terms") == 1).select(F.col("phrase").alias("term"), "pid", "idf", "avg_len")
    single = index.postings.join(sent(singles), "term").withColumn("f", weight(F.col("head_tf"), F.col("body_tf"))).select(*columns)
    if not number.several:
        return single
    hits = materialize(_long_hits(index, known.where(F.size("terms") > 1).select("phrase", "terms"), weight, number.several), "phrase-hits")
    frequency = hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    weighed = frequency.crossJoin(F.broadcast(index.stats)).select("phrase", "avg_len", idf(F.col("n"), F.col("df")).alias("idf")).join(known.select("phrase", "pid"), "phrase")
    return single.unionByName(hits.join(weighed, "phrase").select(*columns))


def _worth_by_number(index: Index, known: DataFrame, head_weight: float, number: Row) -> DataFrame:
    """(pid, chunk_id, worth) of the phrases of `known`."""
    return _hits_by_number(index, known, head_weight, number).select("pid", "chunk_id", _worth(F.col("f")).alias("worth"))


def phrase_worth(index: Index, phrases: DataFrame, head_weight: float = 1.0) -> DataFrame:
    """(phrase, chunk_id, worth): what each phrase adds to the score of a chunk that has it."""
    known = weights(index, phrases)
    return _worth_by_number(index, known, head_weight, _numbers(known)).join(known.select("phrase", "pid"), "pid").select("phrase", "chunk_id", "worth")
