"""Word patterns shared by several operators.

A word is a longest run of letters, digits (Unicode categories L and N) and
underscores. The pattern is written out for Java and RE2, whose `\\w` is ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: White space as Python's `str.isspace` has it, for Java and RE2 classes.
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A word, or a longest run of other characters that are not white space.
WORD_OR_SIGNS = rf"{WORD}|[^\p{{L}}\p{{N}}_{SPACE}]+"


def words(text: Column) -> Column:
    """Lower-cased words of `text` in order; null and empty text give an empty array."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    return F.transform(found, F.lower)


def word_and_sign_count(text: Column) -> Column:
    """How many words and runs of signs `text` has; 0 for null and empty text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_OR_SIGNS))
