"""The positional inverted index and its statistics, always over the whole map."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions import text
from passagework.session import materialize


@dataclass(frozen=True)
class Index:
    """`postings`: (chunk_id, len, head_len, term, head_tf, body_tf, positions), a row a chunk and term.

    Positions count the head, then a gap of one, then the body, so that no
    phrase reaches from one column into the other. `stats` is one row:
    (n, avg_len) over all chunks; a filter of a query never changes it.
    `terms` is (term, df, body_df): in how many chunks a term stands, at all and in the body.
    """

    postings: DataFrame
    stats: DataFrame
    terms: DataFrame

    def stored(self) -> Index:
        """The index written once, for a session that asks it many times.

        The terms of all chunks are summed over the written postings, so texts are read and cut into terms once;
        that chunks without terms count too is known without the texts.
        """
        postings = materialize(self.postings, "postings")
        total = postings.agg(F.coalesce(F.sum(F.col("head_tf") + F.col("body_tf")), F.lit(0)).alias("total"))
        stats = self.stats.select("n").crossJoin(F.broadcast(total)).select("n", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("avg_len"))
        return Index(postings, materialize(stats, "stats"), materialize(term_counts(postings), "index-terms"))

    def vocabulary(self) -> DataFrame:
        """(term, col, docs, occurrences) of every term and column."""
        sides = F.explode(F.array(F.struct(F.lit("head").alias("col"), F.col("head_tf").alias("tf")), F.struct(F.lit("body").alias("col"), F.col("body_tf").alias("tf"))))
        some = self.postings.select("term", sides.alias("s")).where("s.tf > 0")
        return some.groupBy("term", F.col("s.col").alias("col")).agg(F.count(F.lit(1)).alias("docs"), F.sum("s.tf").alias("occurrences"))


def term_counts(postings: DataFrame) -> DataFrame:
    """(term, df, body_df) of postings; combined in the tasks before anything is shuffled."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.count_if(F.col("body_tf") > 0).alias("body_df"))


def stats_of(lengths: DataFrame) -> DataFrame:
    """(n, avg_len): one row over (len) of every chunk, those without terms among them."""
    return lengths.agg(F.count(F.lit(1)).alias("n"), (F.sum("len") / F.count(F.lit(1))).alias("avg_len"))


def _posting_rows(key: pa.DataType):
    """Rows of postings from (chunk_id, terms of the head, terms of the body); a document is worked by itself."""
    fields = [("chunk_id", key), ("len", pa.int32()), ("head_len", pa.int32()), ("term", pa.string()), ("head_tf", pa.int32()), ("body_tf", pa.int32()), ("positions", pa.list_(pa.int32()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, sizes, rows = [], [], []
            for i, (head, body) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                at: dict[str, list[int]] = {}
                for k, term in enumerate(head):
                    at.setdefault(term, []).append(k)
                in_head = {term: len(places) for term, places in at.items()}
                for k, term in enumerate(body, len(head) + 1):
                    at.setdefault(term, []).append(k)
                which += [i] * len(at)
                sizes += [(len(head) + len(body), len(head))] * len(at)
                rows += [(term, in_head.get(term, 0), len(places) - in_head.get(term, 0), places) for term, places in at.items()]
            columns = [batch.column(0).take(pa.array(which, pa.int64())), *([s[k] for s in sizes] for k in range(2)), *([r[k] for r in rows] for k in range(4))]
            yield pa.RecordBatch.from_arrays([c if k == 0 else pa.array(c, t) for k, (c, (_, t)) in enumerate(zip(columns, fields))], schema=pa.schema(fields))

    return run


def build(documents: DataFrame, key: str, head: Column, body: Column) -> Index:
    """Index of `documents` by `key`, with two columns of text. Null text is empty; rows with equal keys are indexed as they come."""
    from pyspark.sql.pandas.types import to_arrow_type

    tokens = documents.select(F.col(key).alias("chunk_id"), text.terms(head).alias("h"), text.terms(body).alias("b"))
    kind = tokens.schema["chunk_id"].dataType
    postings = tokens.mapInArrow(_posting_rows(to_arrow_type(kind)), f"chunk_id {kind.simpleString()}, len int, head_len int, term string, head_tf int, body_tf int, positions array<int>")
    return Index(postings, stats_of(tokens.select((F.size("h") + F.size("b")).alias("len"))), term_counts(postings))


#: Files up to which the paths of all are sent to every task; beyond that texts are shuffled to meet them.
FILES_SENT = 500_000


def of_corpus(corpus) -> Index:
    """The index of a map, of written tables: the head is the path and the headings, the body the text.

    Texts are not moved to meet few paths, unless they lie in fewer tasks than there are cores.
    """
    chunks, files = corpus.chunks, corpus.files.select("id", "path")
    spread = chunks.select("id").rdd.getNumPartitions() >= chunks.sparkSession.sparkContext.defaultParallelism
    return of_chunks(chunks, F.broadcast(files) if spread and files.count() <= FILES_SENT else files)


def _texts(chunks: DataFrame, files: DataFrame) -> DataFrame:
    return chunks.select("id", "file_id", "heading_path", "text").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")


def of_chunks(chunks: DataFrame, files: DataFrame) -> Index:
    """The index of some chunks of these files."""
    return build(_texts(chunks, files), "id", text.head_text(F.col("path"), F.col("heading_path")), F.col("text"))


def lengths(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(chunk_id, len) of every chunk, in terms of the index."""
    n = F.size(text.terms(text.head_text(F.col("path"), F.col("heading_path")))) + F.size(text.terms(F.col("text")))
    return _texts(chunks, files).select(F.col("id").alias("chunk_id"), n.cast("bigint").alias("len"))
