"""A compact filter language, compiled to predicates and semi/anti joins.

`kind:jira -status:Done updated:>=-90d path:Ops/* assignee:"An Nguyen"`: terms
that must all hold; `a,b` is either; `-` negates; `>= > <= <` compare a field's
text; `*` and `?` are wildcards; case does not matter in equality.
"""

from __future__ import annotations

import datetime
import re
import shlex
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.functions.text import matches

#: Keys that every map has, and the column of each; `category` is a table of its own.
BUILT_IN = {"source": "source", "kind": "source_kind", "type": "type", "lang": "lang", "path": "path", "category": None}
COMPARISONS = (">=", "<=", ">", "<")


class ScopeError(ValueError):
    """A filter that can't be read, or that names an unknown field."""


@dataclass(frozen=True)
class Term:
    key: str
    values: tuple[str, ...]
    op: str = "="
    negated: bool = False


@dataclass(frozen=True)
class Scope:
    """A conjunction of terms."""

    terms: tuple[Term, ...] = ()
    text: str = ""

    @classmethod
    def parse(cls, text: str | None, sources: list[str] | None = None, today: datetime.date | None = None) -> Scope:
        try:
            tokens = shlex.split(text or "")
        except ValueError as e:
            raise ScopeError(f"filter {text!r}: {e}") from None
        found = [_term(t, today or datetime.date.today()) for t in tokens]
        shown = [text] if text else []
        if sources:
            found.append(Term("source", tuple(sources)))
            shown.append("source:" + ",".join(sources))
        return cls(tuple(found), " ".join(shown))

    @classmethod
    def only(cls, sources: list[str]) -> Scope:
        return cls.parse(None, sources)

    def check(self, file_meta: DataFrame) -> None:
        """Raise on a key that no item of the map has; the keys are a small set, told apart on the cluster."""
        asked = {t.key for t in self.terms} - set(BUILT_IN)
        if not asked:
            return
        known = {r.key for r in file_meta.select("key").distinct().where(F.col("key").isin(*asked)).collect()}
        if asked - known:
            every = sorted({r.key for r in file_meta.select("key").distinct().collect()} | set(BUILT_IN))
            raise ScopeError(f"no filter key {', '.join(sorted(asked - known))} in this map; keys: {', '.join(every)}")

    def files(self, corpus) -> DataFrame:
        """Rows of `corpus.placed_files()` in scope; a category term holds for a file if one of its chunks has it."""
        rows = corpus.placed_files()
        for term in self.terms:
            rows = _narrow(rows, term, corpus, "file_id")
        return rows

    def chunks(self, corpus, *more: str) -> DataFrame:
        """Rows of `corpus.placed(...)` in scope."""
        rows = corpus.placed(*more)
        for term in self.terms:
            rows = _narrow(rows, term, corpus, "chunk_id")
        return rows

    def count(self, corpus) -> DataFrame:
        """(chunks): how many chunks are in scope; tells an empty scope from a query without a match."""
        return self.chunks(corpus).agg(F.count(F.lit(1)).alias("chunks"))


def _term(token: str, today: datetime.date) -> Term:
    negated = token.startswith("-") and ":" in token
    key, colon, value = token[int(negated) :].partition(":")
    key = key.lower()
    if not colon or value == "" or not re.fullmatch(r"[a-z_][\w.\-]*", key):
        raise ScopeError(f"not a filter term: {token!r} (write key:value, e.g. status:Done)")
    op = next((o for o in COMPARISONS if value.startswith(o)), "=")
    if op == "=":
        values = tuple(v for v in value.split(",") if v)
    else:
        if key in BUILT_IN:
            raise ScopeError(f"{key} is compared by value, not by {op}")
        values = (day(value[len(op) :], today),)
    if not values:
        raise ScopeError(f"not a filter term: {token!r}")
    return Term(key, values, op, negated)


def day(value: str, today: datetime.date) -> str:
    """`-90d` and `-2w` as the ISO day so long before `today`; any other value as it is."""
    if m := re.fullmatch(r"-(\d+)([dw])", value):
        return (today - datetime.timedelta(days=int(m[1]) * {"d": 1, "w": 7}[m[2]])).isoformat()
    return value


def _narrow(rows: DataFrame, term: Term, corpus, level: str) -> DataFrame:
    """A built-in key is a predicate on the row. A field is a semi-join, its negation an
    anti-join: a file without the field fails the term and passes the negation."""
    if BUILT_IN.get(term.key):
        test = matches(F.coalesce(BUILT_IN[term.key], F.lit("")), list(term.values))
        return rows.where(~test if term.negated else test)
    if term.key == "category":
        held = corpus.categories.where("kept").where(matches(F.col("category"), list(term.values))).select("chunk_id")
        if level == "file_id":
            held = corpus.chunks.select(F.col("id").alias("chunk_id"), "file_id").join(held, "chunk_id", "left_semi").select("file_id")
        on = level
    else:
        value = F.col("value")
        compare = {">=": lambda v: value >= v, "<=": lambda v: value <= v, ">": lambda v: value > v, "<": lambda v: value < v}
        test = matches(value, list(term.values)) if term.op == "=" else compare[term.op](term.values[0])
        held, on = corpus.file_meta.where((F.col("key") == term.key) & test).select("file_id"), "file_id"
    return rows.join(held, on, "left_anti" if term.negated else "left_semi")


def scope_types(corpus, scope: Scope) -> DataFrame:
    """(type): the document types in scope."""
    return scope.files(corpus).where("type is not null").select("type").distinct()
