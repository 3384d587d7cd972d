"""Pairs of texts that look the same but differ in their characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.canonical import canonical_texts
from passagework.session import materialize


def look_alike_groups(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, look, raw): the texts whose canonical form is shared by a text with other characters.

    `look` and `raw` are 128-bit hashes of the canonical and of the given text.
    Null and empty texts do not count.
    """
    some = texts.where(F.col(text) != "")
    forms = canonical_texts(some, [key], text).select(key, F.md5("canonical").alias("look"), F.md5(text).alias("raw"))
    forms = materialize(forms, "looks")
    # One row a task and look goes through the shuffle, however many texts share it.
    mixed = forms.groupBy("look").agg(F.min("raw").alias("low"), F.max("raw").alias("high")).where("low <> high")
    return forms.join(mixed.select("look"), "look", "left_semi").select(key, "look", "raw")


def look_alike_classes(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, group_id): one row a record that looks like one with other characters; the group is the least key among those of its look."""
    groups = materialize(look_alike_groups(texts, key, text), "groups")
    least = groups.groupBy("look").agg(F.min(key).alias("group_id"))
    return groups.join(least, "look").select(key, "group_id")


def look_alike_pairs(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(<key>_a, <key>_b), a < b: pairs of records whose texts look the same and differ.

    Equal texts make no pair. The pairs are the result that is asked for; they
    are made by a join on the look, whose large keys adaptive execution splits.
    """
    groups = look_alike_groups(texts, key, text)
    a = groups.select(F.col(key).alias(f"{key}_a"), "look", F.col("raw").alias("raw_a"))
    b = groups.select(F.col(key).alias(f"{key}_b"), "look", F.col("raw").alias("raw_b"))
    held = a.join(b, "look").where((F.col("raw_a") != F.col("raw_b")) & (F.col(f"{key}_a") < F.col(f"{key}_b")))
    return held.select(f"{key}_a", f"{key}_b")
