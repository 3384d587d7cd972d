"""How distinctive a term is for a record: divergence from randomness.

Model G L 2: information content under a geometric collection model (the
limit of Bose-Einstein statistics), times the Laplace after-effect gain, with
the term frequency normalised by length (normalisation 2).

    tfn   = tf * log2(1 + c * avg_len / len)
    inf1  = log2(1 + l) + tfn * log2((1 + l) / l)      l = collection frequency / records
    score = inf1 / (tfn + 1)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.functions.words import words
from passagework.session import materialize


def term_lists(records: DataFrame, record: str, text: str) -> DataFrame:
    """(record, len, terms: array of (term, tf)), made inside each record: no shuffle.

    The words of a record are sorted, a term begins where a word differs from
    the one before, and its count is the way to the next such place. Records
    are whole rows, so a record id that occurs twice is counted as two records.
    """
    listed = records.select(F.col(record).alias("record"), F.sort_array(words(F.col(text))).alias("w"))
    n = F.size("w")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    # A filter on the length would be pushed down and find the words twice.
    marked = listed.select("record", "w", n.alias("len"), F.when(n > 0, starts).alias("s"))
    terms = F.transform("s", lambda at, k: F.struct(F.get("w", at).alias("term"), (F.coalesce(F.get("s", k + 1), F.col("len")) - at).alias("tf")))
    return marked.select("record", "len", terms.alias("terms"))


def distinctive_terms(records: DataFrame, record: str = "id", text: str = "text", c: float = 1.0) -> DataFrame:
    """(record, term, tf, n_records, n_rows, score) of every term of every record.

    `n_records` is in how many records the term occurs, `n_rows` how often in
    the collection; both are over all records, whatever a caller filters
    later. Null and empty texts have no terms but count as records. Filters on
    `tf` reach the records' side and filters on the counts reach the
    vocabulary's side before the two meet.
    """
    # Written once: texts are cut into words once, for the vocabulary and for the scores.
    listed = materialize(term_lists(records, record, text), "terms")
    counts = listed.select("record", "len", F.explode("terms").alias("t")).select("record", "len", "t.term", "t.tf")
    vocabulary = materialize(counts.groupBy("term").agg(F.count(F.lit(1)).alias("n_records"), F.sum("tf").alias("n_rows")), "vocabulary")
    size = listed.agg(F.count(F.lit(1)).alias("n")).crossJoin(vocabulary.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("words")))
    scored = counts.join(vocabulary, "term").crossJoin(F.broadcast(size))  # `size` is one row
    tfn = F.col("tf") * F.log2(1 + F.lit(c) * (F.col("words") / F.col("n")) / F.col("len"))
    rate = F.col("n_rows") / F.col("n")
    score = (F.log2(1 + rate) + tfn * F.log2((1 + rate) / rate)) / (tfn + 1)
    return scored.select(F.col("record").alias(record), "term", "tf", "n_records", "n_rows", score.alias("score"))
