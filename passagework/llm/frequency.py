"""Frequency of every distinct name, with marks on names too rare or too common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A name in more records than this is too common to tell records apart, by role.
COMMON_ABOVE = {"mentions": 5, "defines": 3}
#: A name mentioned in exactly this many records draws no link.
RARE_AT = {"mentions": 1}


def name_form(name: Column) -> Column:
    """Outer blanks off, then outer parentheses off, then lower case."""
    return F.lower(F.btrim(F.btrim(name), F.lit("()")))


def term_frequencies(rows: DataFrame, record: str, term: str, by: str, form=name_form, common_above: dict[str, int] | None = None, rare_at: dict[str, int] | None = None) -> DataFrame:
    """(term, by, n_rows, n_records, mark) of every distinct term, for each value of `by`.

    Counts are first combined per (term, by, record), which spreads a term
    that holds a third of all rows over its records, and then per (term, by);
    both steps combine by hash before the shuffle. Null terms and terms that
    are empty after normalising are no terms; a null `record` counts its rows
    but no record; a null `by` is a value of its own without bounds. `mark` is
    `common`, `rare` or null.
    """
    above, at = common_above or COMMON_ABOVE, rare_at or RARE_AT
    named = rows.select(F.col(record).alias("__record"), form(F.col(term)).alias(term), F.col(by)).where(F.col(term) != "")
    per_record = named.groupBy(term, by, "__record").agg(F.count(F.lit(1)).alias("n"))
    totals = per_record.groupBy(term, by).agg(F.sum("n").alias("n_rows"), F.count("__record").alias("n_records"))
    mark = F.lit(None).cast("string")
    for role, n in at.items():
        mark = F.when((F.col(by) == role) & (F.col("n_records") == n), "rare").otherwise(mark)
    for role, n in above.items():
        mark = F.when((F.col(by) == role) & (F.col("n_records") > n), "common").otherwise(mark)
    return totals.select(term, by, "n_rows", "n_records", mark.alias("mark"))
